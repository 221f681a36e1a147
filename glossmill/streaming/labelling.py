"""Streaming form of resumable labelling: a file stream of pool rows, scored once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossmill.operators.incremental import Scorer, resume, rule_scorer
from glossmill.sources.io import SCHEMAS, append_log, try_read

BUCKETS = 256


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def label_stream(spark: SparkSession, pool: DataFrame, cache_path: str, checkpoint: str, version: str, scorer: Scorer = rule_scorer) -> StreamingQuery:
    """Start labelling a stream of (text_cree, prompt): every batch skips what the cache holds, scores the rest and appends it.

    The cache is a JSON log in one folder for each of 256 numbers of keys; a batch reads only the
    folders of its own keys. A batch that is run again adds nothing twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.dropDuplicates(["text_cree"]).withColumn("bucket", bucket("text_cree")).persist()
        own = [r[0] for r in rows.select("bucket").distinct().collect()]  # 256 at most
        cache = try_read(rows.sparkSession, cache_path, SCHEMAS["label_cache"] + ", bucket int", "json").filter(F.col("bucket").isin(own))
        new = resume(rows, cache, "text_cree", "prompt", version, scorer)
        append_log(new.withColumn("bucket", bucket("text_cree")), cache_path, ["bucket"])
        rows.unpersist()

    return pool.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
