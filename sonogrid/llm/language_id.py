"""Operator 4: language identification by cross-parsing.

For each language a suffix automaton of labelled text accepts just the strings in it.
Parsing a text greedily into longest matches takes few phrases in the text's own
language. A phrase is a place in the labelled text or one of the 256 single bytes, and
costs the logarithm of their number; the language with the lowest cost wins. Bytes of
many texts are parsed in step by numpy, long texts in blocks of BLOCK bytes: each block
starts anew at first, and again from where its predecessor ended until both ways meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonogrid.llm.common import blocks, fold, sums, whole

#: Bytes of labelled text for each language, and documents that are looked at for them.
SAMPLE, SAMPLE_DOCS = 32_768, 64
#: Bytes of a text that are parsed in step with other blocks, and of a block's head, within which most ways meet.
BLOCK, HEAD = 2048, 128
UNKNOWN = "und"


#: ASCII signs and digits count as spaces, and runs of spaces as one: they tell of the genre, not of the language.
SIGNS = bytes(c for c in range(128) if not chr(c).isalpha())
TO_SPACE = bytes.maketrans(SIGNS, b" " * len(SIGNS))


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(TO_SPACE).split())


def samples(docs: DataFrame, size: int = SAMPLE, rows: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """Languages and labelled text of at most `size` bytes each, from rows outside fold 2 with a language and a text.

    Different texts chosen by a hash of the text, short ones (an eighth of the size) first, of long ones the first
    `size` characters, while they fit; if even the first is too long, its start. Every language has its text of the
    smallest hash at least; one whose texts have no letter isn't learned. At most about twice the size reaches the driver for each language.
    """
    known = docs.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & (F.length("text") > 0))
    known = known.select("lang", F.xxhash64("text", F.lit(11)).alias("order"), F.substring("text", 1, size).alias("text"))
    share = known.groupBy("lang").agg((F.lit(4.0 * rows) / F.approx_count_distinct("order", 0.05)).alias("share"), F.min("order").alias("least"))
    some = known.join(F.broadcast(share), "lang").where((F.col("order") == F.col("least")) | (F.pmod("order", F.lit(1 << 20)) <= F.col("share") * (1 << 20)))
    distinct = some.groupBy("lang", "order").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.octet_length("text") > size // 8, "order", "text")
    before = F.coalesce(F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = distinct.select("lang", "text", F.row_number().over(first).alias("n"), before.alias("before")).where((F.col("n") <= rows) & (F.col("before") < 2 * size)).select("lang", "n", "text").orderBy("lang", "n").collect()
    out: dict[str, bytes] = {}
    for lang, _, text in chosen:
        raw = letters(text)
        if not out.get(lang):
            out[lang] = raw[:size]
        elif len(out[lang]) + len(raw) < size:
            out[lang] += b"\0" + raw
    return sorted((lang, text) for lang, text in out.items() if text)


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of the codes; state 0 is the start."""
    moves, link, longest, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


@lru_cache(maxsize=2)
def tables(texts: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Codes of bytes, all automata in one table of moves (0: none), codes in use, and each automaton's start."""
    used = sorted(set(b"".join(texts)) - {0})
    codes = np.zeros(256, np.int64)
    codes[used] = np.arange(1, len(used) + 1)
    wide, parts, starts = len(used) + 1, [], []
    for text in texts:
        moves = automaton(codes[np.frombuffer(text, np.uint8)].tolist())
        starts.append(sum(map(len, parts)))
        table = np.zeros((len(moves), wide), np.int32)
        for state, to in enumerate(moves):
            if to:
                table[state, list(to)] = list(to.values())
        table[:, 0] = 0
        # Moves lead to states of the same automaton, which stand after its start.
        parts.append(np.where(table > 0, table + starts[-1], 0).astype(np.int32))
    return codes, np.concatenate(parts).ravel(), wide, np.array(starts, dtype=np.int64)


def parsed(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, learned: tuple[np.ndarray, int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each automaton and stretch of codes (begin, size): the phrases that end in it when it is entered in `state` (0: between phrases), and the state after it."""
    moves, wide, starts = learned
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    count, state, root = np.zeros(state.shape, np.int32), state[:, order], starts[:, None]
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
    for j, m in enumerate(active.tolist()):
        c = raw[begin[:m] + j]
        now = state[:, :m]
        to = moves[(now + root * (now == 0)) * wide + c]
        ended = to == 0
        again = moves[root * wide + c]
        count[:, :m] += ended & (now != 0)
        count[:, :m] += ended & (again == 0)
        state[:, :m] = np.where(ended, again, to)
    back = np.argsort(order, kind="stable")
    return count[:, back], state[:, back]


def phrases(texts: list[bytes], learned: tuple[bytes, ...], block: int = BLOCK, head: int = HEAD) -> np.ndarray:
    """The phrases that each text takes with each automaton; a byte unknown to it is a phrase."""
    codes, moves, wide, starts = tables(learned)
    by = (moves, wide, starts)
    raw = codes[np.frombuffer(b"".join(texts), np.uint8)]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    cuts = -(-lengths // block)
    owner = np.repeat(np.arange(len(texts)), cuts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = (np.cumsum(lengths) - lengths)[owner] + nth * block
    size = np.minimum(block, lengths[owner] - nth * block)
    first = np.minimum(size, head)
    entered = np.zeros((len(starts), len(owner)), np.int64)
    head_count, met = parsed(raw, begin, first, entered, by)
    tail_count, left = parsed(raw, begin + first, size - first, met, by)
    while True:
        # What blocks were entered in, and what their predecessors left them in.
        really = np.where(nth > 0, np.roll(left, 1, axis=1), 0)
        wrong = np.flatnonzero((really != entered).any(axis=0))
        if not len(wrong):
            break
        entered[:, wrong] = really[:, wrong]
        head_count[:, wrong], now = parsed(raw, begin[wrong], first[wrong], really[:, wrong], by)
        apart = (now != met[:, wrong]).any(axis=0)
        far = wrong[apart]
        met[:, far] = now[:, apart]
        if len(far):
            tail_count[:, far], left[:, far] = parsed(raw, (begin + first)[far], (size - first)[far], met[:, far], by)
    count = head_count + tail_count
    last = nth == cuts[owner] - 1
    count += (left != 0) & last
    out = np.zeros((len(starts), len(texts)))
    for k in range(len(starts)):
        out[k] = np.bincount(owner, count[k], len(texts))
    return out


def costs(texts: list[bytes], learned: tuple[bytes, ...]) -> np.ndarray:
    """What each text costs with each automaton: for a phrase, a place in the sample or a byte; for a byte that the sample doesn't have, the same in all languages, more than a phrase of the largest sample."""
    known = np.zeros((len(learned), 256), bool)
    for k, sample in enumerate(learned):
        known[k, list(set(sample) - {0})] = True
    raw, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], dtype=np.int64)
    strange = np.stack([sums(~known[k][raw], lengths) for k in range(len(learned))])
    place = np.log2(np.array([len(t) + 256 for t in learned], dtype=float))
    return (phrases(texts, learned) - strange) * place[:, None] + strange * (8 + place.max())


def language_id(docs: DataFrame, size: int = SAMPLE, rows: int = SAMPLE_DOCS) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred and score.

    score is the second lowest cost over the sum of the lowest two (1 with one language).
    A null text, a text without a letter, and all texts if nothing was learned, are `und`
    with score 0. Equal costs go to the first language in order. Rows with a null or
    repeated doc_id are judged one by one. Other columns than doc_id, text and lang are not read.
    """
    learned = samples(docs, size, rows)
    names, texts_by_lang = [x[0] for x in learned], tuple(x[1] for x in learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            lettered = np.array([any(map(str.isalpha, t)) for t in texts])
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if names and lettered.any():
                cost = costs([letters(t) for t in texts], texts_by_lang)
                pred = np.where(lettered, np.array(names, object)[np.argmin(cost, axis=0)], UNKNOWN)
                two = np.sort(cost, axis=0)[:2]
                score = np.where(lettered, two[1] / np.maximum(two.sum(axis=0), 1e-9) if len(two) > 1 else 1.0, 0.0)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = whole(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
