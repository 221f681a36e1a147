"""Splits that keep related records together.

Method: iterative minimum-label propagation over the bipartite record-entity graph (entities are
files, whatever way they are written, and paragraphs), then stratified assignment of whole groups
that keeps each split's label distribution near the overall one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators.skew import attach, salted
from glossmill.session import cut, free, written

BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
MAX_LABELS = 100  # strata: the most frequent labels; all others together are the last one
OTHER = "(other)"
LARGE = 1000  # groups below 1/LARGE of all rows are placed in bundles, so that there are few units to place
BUNDLES = 256  # bundles of groups of one main label


def file_name(source: Column) -> Column:
    """The file that a stored value names: letter case, blanks around it, leading path, final .html disregarded."""
    bare = F.regexp_replace(F.lower(source), rf"^{BLANK}|{BLANK}$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^.*[/\\]", ""), r"\.html$", "")
    return F.regexp_replace(bare, rf"^{BLANK}|{BLANK}$", "")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) over a bipartite graph ``edges`` (node, hub): label is the least node of the component.

    Nodes whose hubs hold no other node are left out by the caller or simply keep their own label.
    Every round sends the least label of each hub to its nodes and then jumps once over labels, so
    the number of rounds grows with the logarithm of the longest path.
    """
    edges = written(edges.distinct())
    labels = written(edges.select("node").distinct().withColumn("label", F.col("node")))
    kept = [labels]  # tables of the round before, which go as soon as the next one stands
    while True:
        hubs = edges.join(labels, "node").groupBy("hub").agg(F.min("label").alias("least"))
        seen = edges.join(hubs, "hub").groupBy("node").agg(F.min("least").alias("least"))
        moved = labels.join(seen, "node").select("node", "label", F.least("label", "least").alias("to"))
        jump = moved.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = written(moved.join(jump, "to").select("node", "label", F.least("to", "further").alias("new")))
        free(*kept)
        kept = [after]
        if after.filter(F.col("label") != F.col("new")).isEmpty():
            return after.select("node", "label")
        labels = after.select("node", F.col("new").alias("label"))


def tied_files(rows: DataFrame, source_col: str = "source_file", paragraph_col: str = "paragraph_id") -> tuple[DataFrame, DataFrame]:
    """(stored values with their file name and component, paragraphs with their file name)."""
    pairs = written(rows.select(F.col(source_col).alias("stored"), file_name(F.col(source_col)).alias("node"), F.col(paragraph_col).alias("hub")).distinct())
    edges = pairs.filter(F.col("node").isNotNull() & F.col("hub").isNotNull()).select("node", "hub").distinct()
    # Paragraphs of one file tie nothing to it; only the others go through the propagation.
    ties = edges.groupBy("hub").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter(F.col("a") != F.col("b")).select("hub")
    found = components(edges.join(ties, "hub", "left_semi").select("node", "hub"))
    stored = pairs.filter(F.col("stored").isNotNull()).select("stored", "node").distinct().join(found, "node", "left")
    return stored.select("stored", "node", F.coalesce("label", "node").alias("label")), edges


def shared_split_pairs(rows: DataFrame) -> DataFrame:
    """Each two different stored values of source_file whose rows must share a split, smaller value first."""
    stored, _ = tied_files(rows)
    stored = cut(stored.select("stored", "label"))
    a, b = stored.alias("a"), stored.alias("b")
    both = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.stored") < F.col("b.stored")))
    return both.select(F.col("a.stored").alias("source_file_a"), F.col("b.stored").alias("source_file_b"))


def tied_groups(rows: DataFrame) -> DataFrame:
    """Class form of the pairs: (source_file, grp, links) of each stored value: its group and the number of other values tied to it."""
    stored, _ = tied_files(rows)
    stored = cut(stored.select("stored", "label"))
    sizes = stored.groupBy("label").agg(F.count("*").alias("n"))
    return stored.join(sizes, "label").select(F.col("stored").alias("source_file"), F.col("label").alias("grp"), (F.col("n") - 1).alias("links"))


def grouped(rows: DataFrame, id_col: str, label: Column) -> DataFrame:
    """(row_id, grp, label) of every row.

    The group is the component of the row's file, else that of its paragraph, else the paragraph
    itself, else the row. NULL labels are a stratum of their own.
    """
    stored, edges = tied_files(rows)
    named = stored.select("node", "label").distinct()
    by_paragraph = edges.groupBy("hub").agg(F.min("node").alias("node")).join(named, "node").select(F.col("hub").alias("paragraph"), F.col("label").alias("grp_p"))
    base = rows.select(F.col(id_col).alias("row_id"), file_name(F.col("source_file")).alias("node"), F.col("paragraph_id").alias("paragraph"), label.alias("stratum"))
    # A paragraph's rows are tied to its named rows, so the paragraph decides for all rows that have one.
    # Rows without paragraph or file, and those of a file with a third of all rows, are spread.
    with_p = salted(written(salted(written(base), by_paragraph, ["paragraph"], "row_id", "left")), named.withColumnRenamed("label", "grp_f"), ["node"], "row_id", "left")
    grp = F.coalesce("grp_p", "grp_f", F.concat(F.lit("paragraph "), F.col("paragraph").cast("string")), F.concat(F.lit("row "), F.col("row_id").cast("string")))
    return with_p.select("row_id", grp.alias("grp"), F.coalesce("stratum", F.lit("none")).alias("label"))


def place(sizes: list[tuple], shares: list[float], totals: dict[str, int]) -> dict[str, int]:
    """Split of each unit (name, {label: rows}), largest first, each where the deviation from the wanted counts grows least.

    The deviation is the sum over labels of squared differences, each over the wanted count, and that
    of all rows together, which weighs as much as all labels do.
    """
    filled = [dict.fromkeys(totals, 0) for _ in shares]
    rows, whole = [0] * len(shares), sum(totals.values())
    placed = {}

    def growth(have: int, more: int, wanted: float) -> float:
        return more * (2 * (have - wanted) + more) / max(1.0, wanted)

    for unit, counts in sorted(sizes, key=lambda x: (-sum(x[1].values()), x[0])):
        n = sum(counts.values())
        # A label of which the unit holds nothing deviates as before.
        costs = [len(totals) * growth(rows[i], n, s * whole) + sum(growth(filled[i][k], c, s * totals[k]) for k, c in counts.items()) for i, s in enumerate(shares)]
        best = costs.index(min(costs))
        placed[unit] = best
        rows[best] += n
        for k, c in counts.items():
            filled[best][k] += c
    return placed


def assign(rows: DataFrame, id_col: str = "row_id", label: Column | None = None, names=("train", "validation", "test"), shares=(0.8, 0.1, 0.1), seed: int = 7) -> DataFrame:
    """(row_id, grp, split): all rows of a group have one split, the splits near their shares label by label.

    Units are placed one by one where the deviation of the label distribution grows least. A unit is
    a group, or a bundle of groups that are below a thousandth of all rows, drawn by hash among those
    of one main label. NULL labels are a stratum of their own; of more than a hundred labels the
    rarest are one stratum. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    given = written(grouped(rows, id_col, F.lit("all") if label is None else label))
    counted = cut(given.groupBy("grp", "label").agg(F.count("*").alias("n")))
    strata = counted.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LABELS).collect()
    kept = strata if len(strata) < MAX_LABELS else strata[: MAX_LABELS - 1]
    named = spark.createDataFrame([(r["label"], r["label"]) for r in kept], "label string, stratum string")
    counts = counted.join(F.broadcast(named), "label", "left").groupBy("grp", F.coalesce("stratum", F.lit(OTHER)).alias("label")).agg(F.sum("n").alias("n"))
    counts = cut(counts)
    totals = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    whole = sum(totals.values())
    sizes = counts.groupBy("grp").agg(F.sum("n").alias("rows"), F.max_by("label", F.struct("n", "label")).alias("main"))
    bundle = F.concat_ws(" ", F.lit("bundle"), F.pmod(F.xxhash64("grp", F.lit(seed)), F.lit(BUNDLES)).cast("string"), "main")
    units = cut(sizes.select("grp", "rows", F.when(F.col("rows") * LARGE >= whole, F.concat(F.lit("group "), "grp")).otherwise(bundle).alias("unit")))
    profile = counts.join(units.select("grp", "unit"), "grp").groupBy("unit", "label").agg(F.sum("n").alias("n"))
    profile = profile.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m")).collect()
    placed = place([(r["unit"], r["m"]) for r in profile], list(shares), totals)
    chosen = spark.createDataFrame([(u, names[i]) for u, i in placed.items()], "unit string, split string")
    return attach(given, units.join(F.broadcast(chosen), "unit").select("grp", "rows", "split"), ["grp"], "rows").select("row_id", "grp", "split")
