"""Deterministic sampling, splitting and balancing (D01 to D12): rows are ordered by a hash of seed and key, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions.text import draw, roll

BUCKETS = 4096


def ranked(df: DataFrame, key: str, seed: int | str, by: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Rank of every row in hashed order, from 1, within the groups of ``by`` or in the whole table, and the size ``n`` of the group.

    Hash values are cut into buckets; rows are sorted only inside one bucket of one group, and ranks
    continue over the running sums of a small table of bucket sizes, so no group goes to one task.
    """
    by = by or []
    drawn = df.withColumn("gm_h", draw(F.col(key), seed)).withColumn("gm_b", F.floor(F.col("gm_h") / ((1 << 32) // BUCKETS)))
    sizes = drawn.groupBy(*by, "gm_b").agg(F.count("*").alias("gm_n"))
    group = Window.partitionBy(*(by or [F.lit(1)]))
    before = sizes.select(*by, "gm_b", (F.sum("gm_n").over(group.orderBy("gm_b")) - F.col("gm_n")).alias("gm_before"), F.sum("gm_n").over(group).alias("n"))
    renamed = before.select(*[F.col(c).alias(f"gm_{c}") for c in by], F.col("gm_b").alias("gm_b2"), "gm_before", "n")
    on = F.col("gm_b") == F.col("gm_b2")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"gm_{c}"))
    w = Window.partitionBy(*by, "gm_b").orderBy("gm_h", key)
    joined = drawn.join(renamed, on).withColumn(name, F.row_number().over(w) + F.col("gm_before"))
    return joined.drop("gm_h", "gm_b", "gm_b2", "gm_before", *[f"gm_{c}" for c in by])


def holdout(df: DataFrame, key: str, rate: float, seed: int | str = 42) -> DataFrame:
    """``split`` train for the first max(1, floor(n (1 - rate))) rows in hashed order, dev for the rest."""
    r = ranked(df, key, seed)
    return r.withColumn("split", F.when(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(1 - rate) + F.lit(1e-9))), "train").otherwise("dev")).drop("rn", "n")


def small_split(df: DataFrame, key: str, rate: float = 0.1, least: int = 20, seed: int | str = 42) -> DataFrame:
    """As holdout, but each row is in both splits where there are fewer than ``least``."""
    r = ranked(df, key, seed)
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(1 - rate) + F.lit(1e-9)))
    return r.withColumn("split", F.when(F.col("n") < least, "both").when(F.col("rn") <= cut, "train").otherwise("dev")).drop("rn", "n")


def stratified(df: DataFrame, key: str, label: str, test: float = 0.2, seed: int | str = 42) -> DataFrame:
    """``split`` test for a share of each label."""
    r = ranked(df, key, seed, [label])
    return r.withColumn("split", F.when(F.col("rn") <= F.floor(F.col("n") * F.lit(test) + F.lit(0.5)), "test").otherwise("train")).drop("rn", "n")


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int | str = 42) -> DataFrame:
    """``fold`` from 0 to k - 1, even within each label."""
    return ranked(df, key, seed, [label]).withColumn("fold", ((F.col("rn") - 1) % k).cast("bigint")).drop("rn", "n")


def per_class(df: DataFrame, key: str, label: str, k: int | Column, seed: int | str = 42) -> DataFrame:
    """At most k rows of each label."""
    return ranked(df, key, seed, [label]).filter(F.col("rn") <= k).drop("rn", "n")


def balanced(df: DataFrame, key: str, label: str, plain: str = "literal", ratio: float = 3.0, seed: int | str = 42) -> DataFrame:
    """All rows of other labels and at most ``ratio`` times as many of the plain one."""
    figurative = df.filter(F.col(label) != plain)
    most = figurative.agg(F.floor(F.count("*") * F.lit(float(ratio))).alias("gm_most"))
    literal = ranked(df.filter(F.col(label) == plain), key, seed).join(F.broadcast(most)).filter(F.col("rn") <= F.col("gm_most"))
    return figurative.unionByName(literal.select(*df.columns))


def resampled(df: DataFrame, key: str, label: str, draws: int, seed: int | str = 42) -> DataFrame:
    """(draw, key) of weighted draws with replacement, each label with the same weight.

    The label comes from one hash of the draw and the rank within it from another, which is the
    inverse of the cumulative weights without building them.
    """
    spark = df.sparkSession
    labels = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("size"))
    labels = labels.withColumn("no", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(label)) - 1).withColumn("kinds", F.count("*").over(Window.partitionBy(F.lit(1))))
    picks = spark.range(draws).withColumnRenamed("id", "draw").withColumn("a", draw(F.col("draw"), f"{seed}a")).withColumn("b", draw(F.col("draw"), f"{seed}b"))
    chosen = picks.join(F.broadcast(labels), F.col("a") % F.col("kinds") == F.col("no")).withColumn("rn", F.col("b") % F.col("size") + 1)
    return chosen.join(ranked(df.filter(F.col(label).isNotNull()), key, seed, [label]).select(key, label, "rn"), [label, "rn"]).select("draw", key, label)


def bootstrap(counts: DataFrame, replicates: int = 2000) -> DataFrame:
    """(replicate, t, p, n) of resampling the rows behind confusion counts (t, p, n) with replacement.

    Rows of one cell are the same to every metric, so a draw only needs its cell: draws are whole
    numbers below the number of rows, told apart by the bounds of at most 16 cells. No row is joined
    or shuffled; partial counts of (replicate, cell) are. Labels outside the four raise an error.
    """
    spark = counts.sparkSession
    cells = counts.orderBy("t", "p").select("t", "p", "n").limit(17).collect()
    if len(cells) > 16 or any(r[0] is None or r[1] is None for r in cells):
        raise ValueError("counts of the four labels are wanted")
    size = sum(r[2] for r in cells)
    if not size:
        return counts.select(F.lit(0).cast("bigint").alias("replicate"), "t", "p", "n").limit(0)
    grid = spark.range(size * replicates).select((F.col("id") / size).cast("bigint").alias("replicate"), (F.col("id") % size).alias("k"))
    at, bound = None, 0
    drawn = roll(F.col("replicate"), F.col("k")) % size
    for i, r in enumerate(cells):
        bound += r[2]
        at = F.when(F.col("draw") < bound, i) if at is None else at.when(F.col("draw") < bound, i)
    hits = grid.select("replicate", drawn.alias("draw")).select("replicate", at.alias("cell")).groupBy("replicate", "cell").agg(F.count("*").alias("n"))
    names = [F.get(F.array(*(F.lit(r[k]) for r in cells)), F.col("cell")) for k in (0, 1)]
    return hits.select("replicate", names[0].alias("t"), names[1].alias("p"), "n")


def masked(tokens: Column, key: Column, rate: float = 0.15, seed: int | str = 42) -> Column:
    """Tokens with a share replaced by [MASK]; tokens in brackets are special and stay."""
    bound = int(rate * (1 << 32))
    hit = lambda x, i: (draw(F.concat_ws("-", key.cast("string"), i.cast("string")), seed) < bound) & ~x.rlike(r"^\[.*\]$")
    return F.transform(tokens, lambda x, i: F.when(hit(x, i), F.lit("[MASK]")).otherwise(x))
