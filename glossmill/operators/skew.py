"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import cut

HOT_SHARE = 1000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """Inner join of ``rows`` to ``groups``, which has one row per key and its row count in ``count_col``.

    Keys with at least 1/1000 of all rows, of which there can be no more than 1000, are broadcast;
    the rest is joined by shuffle. NULL keys match nothing. ``rows`` should be a written table, as it
    is read twice.
    """
    groups = cut(groups)
    least = max(1, rows.count() // HOT_SHARE)
    hot = groups.filter(F.col(count_col) >= least)
    cold = groups.filter(F.col(count_col) < least)
    by_broadcast = rows.join(F.broadcast(hot), keys)
    by_shuffle = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return by_broadcast.unionByName(by_shuffle)


SALTS = 64


def salted(rows: DataFrame, other: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` to ``other``, which may have several rows of a key, even where one key holds a large part of ``rows``.

    Keys with at least 1/1000 of ``rows``, of which there can be no more than 1000, are spread over
    64 numbers by a hash of the column ``by``, and their rows in ``other`` are repeated under each
    number. NULL keys match nothing and are spread alike. ``rows`` should be a written table, as it
    is read twice.
    """
    sizes = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("gm_n"))
    hot = F.broadcast(cut(sizes.filter(F.col("gm_n") >= max(1000, rows.count() // HOT_SHARE)).select(*keys, F.lit(True).alias("gm_hot"))))
    null = F.lit(False)
    for k in keys:
        null |= F.col(k).isNull()
    drawn = F.when(F.coalesce("gm_hot", null), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    all_ = F.when(F.col("gm_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").withColumn("gm_salt", drawn).drop("gm_hot")
    right = other.join(hot, keys, "left").withColumn("gm_salt", F.explode(all_)).drop("gm_hot")
    return left.join(right, [*keys, "gm_salt"], how).drop("gm_salt")
