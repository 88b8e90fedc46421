"""Models on top of frozen vectors, and a hook for encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_probe(train: DataFrame, test: DataFrame, vector: str, label: str, rounds: int = 50) -> DataFrame:
    """test with prediction, by logistic regression on train. Labels may be any integers; those that train lacks are never predicted."""
    numbers = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep").fit(train)
    fitted = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=rounds).fit(numbers.transform(train).withColumn("_x", array_to_vector(vector)))
    names = F.array(*(F.lit(int(x)) for x in numbers.labels))
    out = fitted.transform(test.withColumn("_x", array_to_vector(vector)))
    return out.withColumn("_p", F.get(names, F.col("prediction").cast("int"))).drop("prediction", "_x", "rawPrediction", "probability").withColumnRenamed("_p", "prediction")


def coordinates(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """rows with axis0 to axis k - 1: projections on the principal axes, each axis turned so that its largest weight is positive."""
    fitted = PCA(k=k, inputCol="_x", outputCol="_y").fit(rows.withColumn("_x", array_to_vector(vector)))
    axes = fitted.pc.toArray()
    signs = [1.0 if axes[np.abs(axes[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = fitted.transform(rows.withColumn("_x", array_to_vector(vector))).withColumn("_y", vector_to_array("_y"))
    return out.withColumns({f"axis{j}": F.get("_y", F.lit(j)) * signs[j] for j in range(k)}).drop("_x", "_y")


def encoded(windows: DataFrame, key: str, spec: str, encode: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Key and h, an encoder's vector for each window's (mel, time) array. The encoder is any function of a batch."""
    kind = windows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [encode(np.asarray(x, np.float32)) for x in batch[spec].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array([np.asarray(h, np.float32) for h in out], pa.list_(pa.float32()))], [key, "h"])

    return windows.select(key, spec).mapInArrow(run, f"{key} {kind}, h array<float>")
