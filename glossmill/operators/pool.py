"""Sentence-pool operators: loading, exclusion, deduplication, unions, key allocation. Orders are always explicit columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions import text as X


def _one_per_key(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("gm_row"))
    return best.select(*(c if c in keys else F.col(f"gm_row.{c}").alias(c) for c in df.columns))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, NULLs first; NULL keys are one key.

    An aggregate and not a window, so each partition sends at most one row per key and a key with
    very many rows does not meet in one task.
    """
    return _one_per_key(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, NULLs first."""
    return _one_per_key(df, keys, order, F.max_by)


def load_pool(pool: DataFrame, exclude_source: str | None = None, limit: int | None = None, order: str = "row_id") -> DataFrame:
    """Rows with both texts, without the excluded source (rows without a source stay), stripped, first of each Cree text, then the first ``limit``."""
    df = pool.dropna(subset=["text_cree", "text_en"])
    if exclude_source is not None:
        df = df.filter(~F.col("source_file").eqNullSafe(exclude_source))
    df = df.withColumns({"text_cree": X.strip(F.col("text_cree")), "text_en": X.strip(F.col("text_en"))})
    df = first_wins(df, ["text_cree"], [order])
    return df if limit is None else df.orderBy(order).limit(limit)


def long_enough(df: DataFrame, k: int, left: str = "text_cree", right: str = "text_en") -> DataFrame:
    """Both sides have at least k characters."""
    return df.filter((F.length(left) >= k) & (F.length(right) >= k))


def confident(df: DataFrame, threshold: float) -> DataFrame:
    """Rows of the confidence or above; no filter, NULLs included, for a threshold of 0."""
    return df.filter(F.col("confidence") >= threshold) if threshold > 0 else df


def gold_gate(df: DataFrame) -> DataFrame:
    """Rows whose footnote applies; NULL is out."""
    return df.filter(F.col("footnote_applies").eqNullSafe(True))


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that exist."""
    return df.select(*[c for c in columns if c in df.columns])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself, or ValueError naming the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def without(df: DataFrame, held_out: DataFrame, keys: list[str], stripped: bool = False) -> DataFrame:
    """Rows whose key is not held out. NULL keys are kept. The held-out side is reduced to its distinct keys."""
    norm = (lambda c: X.strip(F.col(c))) if stripped else F.col
    left = df.withColumns({f"gm_{k}": norm(k) for k in keys})
    right = held_out.select(*[norm(k).alias(f"gm_{k}") for k in keys]).dropna().distinct()
    return left.join(right, [f"gm_{k}" for k in keys], "left_anti").select(*df.columns)


def within(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is among the wanted ones."""
    return df.join(wanted.select(*keys).dropna().distinct(), keys, "left_semi").select(*df.columns)


def union_sources(frames: dict[str, DataFrame], columns: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """Union of the sources' rows, each with its name; skipped sources give no rows, empty ones keep the schema."""
    parts = [df.select(*columns, F.lit(name).alias("source")) for name, df in frames.items()]
    kept = [part for name, part in zip(frames, parts, strict=True) if name not in skip]
    return reduce(DataFrame.unionByName, kept) if kept else parts[0].limit(0)


def append(pool: DataFrame, new: DataFrame, backfill: dict[str, object]) -> DataFrame:
    """Pool and new rows, columns that one side lacks filled with constants."""
    return pool.unionByName(new, allowMissingColumns=True).fillna(backfill)


def gold_first(gold: DataFrame, silver: DataFrame, key: str, order: str) -> DataFrame:
    """Union in which the gold row wins on equal stripped keys, then the earlier one."""
    both = gold.withColumn("gm_rank", F.lit(0)).unionByName(silver.withColumn("gm_rank", F.lit(1)))
    return first_wins(both.withColumn("gm_key", X.strip(F.col(key))), ["gm_key"], ["gm_rank", order]).drop("gm_rank", "gm_key")


def next_id(df: DataFrame, column: str) -> int:
    """Greatest id plus 1, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(column) + 1, F.lit(0))).collect()[0][0]


def ordinals(df: DataFrame, order: str, name: str, base: int = 0) -> DataFrame:
    """Dense ordinals by ``order`` without one task for the whole table.

    Rows are range-partitioned once; each partition numbers its own rows and adds the rows of the
    partitions before it, which are counted in a small table. Order values must be unique and not NULL.
    """
    from glossmill.session import written

    parts = written(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("gm_part", F.spark_partition_id()))
    w = Window.partitionBy("gm_part").orderBy(order)
    sizes = parts.groupBy("gm_part").agg(F.count("*").alias("n"))
    before = sizes.select("gm_part", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("gm_part")) - F.col("n")).alias("gm_before"))
    numbered = parts.join(F.broadcast(before), "gm_part").withColumn(name, (F.row_number().over(w) - 1 + F.col("gm_before") + base).cast("bigint"))
    return numbered.drop("gm_part", "gm_before")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without the new keys, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def prefix_matches(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(token, lemma) where the lemma, without case and diacritics, is the token or starts with it.

    An equi-join on exploded prefixes of lemmas of three characters or more, not a nested loop.
    """
    a = tokens.select("token").distinct().withColumn("gm_key", X.unaccented(F.col("token")))
    b = lemmas.select("lemma").distinct().withColumn("gm_norm", X.unaccented(F.col("lemma"))).filter(F.length("gm_norm") >= 3)
    prefix = F.explode(F.transform(F.sequence(F.lit(3), F.length("gm_norm")), lambda n: F.substring(F.col("gm_norm"), F.lit(1), n)))
    return a.join(b.withColumn("gm_key", prefix), "gm_key").select("token", "lemma")


def zipped(left: DataFrame, right: DataFrame, group: str, ordinal: str) -> DataFrame:
    """I-th row of the left with the i-th of the right in each group, as far as the shorter reaches."""
    w = Window.partitionBy(group).orderBy(ordinal)
    a, b = (df.withColumn("gm_i", F.row_number().over(w)).drop(ordinal) for df in (left, right))
    return a.join(b, [group, "gm_i"])
