"""Losses over batches of vector pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 64  # pairs that stand against each other


def _losses(temperature: float):
    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                pairs = batch.column(1).slice(i, 1).flatten()
                n = len(pairs)
                order = np.argsort(np.asarray(pairs.field(0)))
                x, y = (np.asarray(pairs.field(k).flatten(), np.float64).reshape(n, -1)[order] for k in (1, 2))
                x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, y))
                z = x @ y.T / temperature
                own = np.diag(z)
                top = z.max()
                both = [np.log(np.exp(z - top).sum(axis=axis)) + top - own for axis in (1, 0)]
                out.append(float((both[0].mean() + both[1].mean()) / 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["batch", "loss"])

    return run


def info_nce(pairs: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(batch, loss) of pairs (batch, pair, x, y): cross entropy of each vector's own partner among those of its batch, the mean of both directions.

    A batch holds a bounded number of pairs, as those of one training step do; it is one matrix
    product. Pairs with a NULL vector are left out. Vectors of a batch must be of one size.
    """
    rows = pairs.filter(F.col("batch").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    packed = rows.groupBy(F.col("batch").cast("bigint").alias("batch")).agg(F.collect_list(F.struct(F.col("pair").cast("bigint").alias("pair"), "x", "y")).alias("pairs"))
    return packed.mapInArrow(_losses(temperature), "batch bigint, loss double")
