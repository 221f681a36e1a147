"""Retrieval of translations among vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import written

BLOCK = 4096


def gold_ranks(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, rank) of each source's own target among all targets by cosine, 1 + the number of better ones.

    Both sides have ``id`` and ``v`` (array of double). Targets are packed into blocks of rows; each
    block meets each block of queries once and gives a matrix product, whose counts of better targets
    are summed by query: no pair of single rows is ever made. Ids without a target of their own, and
    NULL vectors, are left out.
    """
    t = targets.filter(F.col("v").isNotNull()).select(F.col("id").cast("bigint").alias("id"), "v")
    s = sources.filter(F.col("v").isNotNull()).select(F.col("id").cast("bigint").alias("id"), "v")
    own = written(s.join(t.select("id", F.col("v").alias("own")), "id"))

    def packed(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        blocks = F.expr(f"cast(floor(gm_row / {BLOCK}) as bigint)")
        numbered = df.withColumn("gm_row", F.monotonically_increasing_id())
        return numbered.groupBy(blocks.alias(name)).agg(*(F.collect_list(c).alias(f"{name}_{c}") for c in cols))

    queries, pool = packed(own, ["id", "v", "own"], "q"), packed(t, ["v"], "t")
    # A stated set of queries against all rows, block by block.
    met = queries.join(pool.hint("shuffle_replicate_nl"), how="cross").select("q_id", "q_v", "q_own", "t_v")

    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.asarray(batch.column(0).slice(i, 1).flatten())
                q, own_, pool_ = (np.asarray(batch.column(k).slice(i, 1).flatten().flatten(), np.float64) for k in (1, 2, 3))
                d = len(q) // max(1, len(ids))
                unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
                q, own_, pool_ = (unit(a.reshape(-1, d)) for a in (q, own_, pool_))
                gold = (q * own_).sum(axis=1)
                better = (q @ pool_.T > gold[:, None] + 1e-12).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(better.astype(np.int64))], names=["id", "better"])

    return met.mapInArrow(count, "id bigint, better bigint").groupBy("id").agg((F.sum("better") + 1).alias("rank"))


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """Share of ranks 1, share of ranks up to 5, mean reciprocal rank."""
    return ranks.agg(F.avg((F.col("rank") == 1).cast("double")).alias("r1"), F.avg((F.col("rank") <= 5).cast("double")).alias("r5"), F.avg(1 / F.col("rank")).alias("mrr"))
