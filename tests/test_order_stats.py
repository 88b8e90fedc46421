"""Percentiles against sorted values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sonogrid.operators import order_stats


@pytest.mark.parametrize(("bins", "most"), [(1024, 10_000), (64, 3)])
def test_percentiles_are_exact(spark, bins, most):
    rng = random.Random(1)
    rows = [("even", rng.random()) for _ in range(400)] + [("steep", 10 ** rng.uniform(-200, 200) * rng.choice([-1, 1])) for _ in range(300)] + [("equal", 7.0)] * 200
    rows += [("few", float(rng.randrange(3))) for _ in range(500)] + [("one", 2.5), ("none", None), ("none", math.nan), (None, 1.0), (None, 4.0), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.0)]
    shares = {"least": 0.0, "median": 0.5, "p95": 0.95, "most": 1.0}
    got = {r.g: r for r in order_stats.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares, bins, most).collect()}
    assert set(got) == {g for g, _ in rows}
    for g in got:
        v = sorted(x for k, x in rows if k == g and x is not None and not math.isnan(x))
        for name, share in shares.items():
            if not v:
                assert got[g][name] is None
                continue
            at = share * (len(v) - 1)
            a, b = v[math.floor(at)], v[math.ceil(at)]
            assert got[g][name] == pytest.approx(a + (b - a) * (at - math.floor(at)), rel=1e-12), (g, name)


def test_many_groups_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "GROUPS", 5)
    rows = [(k % 40, k % 3, float((k * 7919) % 1009)) for k in range(4000)]
    got = order_stats.percentiles(spark.createDataFrame(rows, "a int, b int, x double"), ["a", "b"], "x", {"m": 0.3}, 4, 5).collect()
    for r in got:
        assert r.m == pytest.approx(np.quantile([x for a, b, x in rows if (a, b) == (r.a, r.b)], 0.3))
    assert len(got) == 120 and order_stats.percentiles(spark.createDataFrame([], "a int, x double"), ["a"], "x", {"m": 0.5}).count() == 0
