"""Classification metrics and agreement (E01 to E13), from counts of (true, predicted) pairs: rows are aggregated first, metrics come from at most 16 counts a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.labels import LABELS
from glossmill.functions.text import round_at

K = len(LABELS)


def confusion(df: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """Counts of each pair of labels, long form."""
    return df.groupBy(*(by or []), F.col(truth).alias("t"), F.col(guess).alias("p")).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def scores(counts: DataFrame, by: list[str] | None = None, places: int | None = 4) -> DataFrame:
    """Precision, recall and F1 of the four labels, their means over all four, and accuracy, by group.

    A label that does not occur counts as 0 in the means. Where a label outside the four occurs,
    the accuracy is 0.
    """
    by = by or []
    tidy = (lambda c: round_at(c, places)) if places else (lambda c: c)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    known = F.col("t").isin(*LABELS) & F.col("p").isin(*LABELS)
    sums = [n(F.col("t").eqNullSafe(F.col("p"))).alias("same"), F.sum("n").alias("all"), n(~F.coalesce(known, F.lit(False))).alias("odd")]
    for c in LABELS:
        sums += [n((F.col("t") == c) & (F.col("p") == c)).alias(f"tp_{c}"), n(F.col("p") == c).alias(f"said_{c}"), n(F.col("t") == c).alias(f"is_{c}")]
    one = counts.groupBy(*by).agg(*sums)
    cols: dict[str, Column] = {}
    for c in LABELS:
        tp, said, real = F.col(f"tp_{c}"), F.col(f"said_{c}"), F.col(f"is_{c}")
        cols |= {f"p_{c}": _ratio(tp, said), f"r_{c}": _ratio(tp, real), f"f1_{c}": _ratio(2 * tp, said + real)}
    mean = lambda m: sum((cols[f"{m}_{c}"] for c in LABELS[1:]), cols[f"{m}_{LABELS[0]}"]) / K
    cols |= {f"macro_{m}": mean(m) for m in ("p", "r", "f1")}
    cols["accuracy"] = F.when(F.col("odd") > 0, 0.0).otherwise(_ratio(F.col("same"), F.col("all")))
    return one.select(*by, *(tidy(v).alias(k) for k, v in cols.items()))


def kappa(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa over the four labels; NULL where chance agreement is 1."""
    by = by or []
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    sums = [F.sum("n").alias("all"), n(F.col("t") == F.col("p")).alias("same")]
    for c in LABELS:
        sums += [n(F.col("p") == c).alias(f"said_{c}"), n(F.col("t") == c).alias(f"is_{c}")]
    chance = sum((F.col(f"said_{c}") * F.col(f"is_{c}") for c in LABELS[1:]), F.col(f"said_{LABELS[0]}") * F.col(f"is_{LABELS[0]}"))
    both = F.col("all") * F.col("all")
    one = counts.filter(F.col("t").isin(*LABELS) & F.col("p").isin(*LABELS)).groupBy(*by).agg(*sums)
    return one.select(*by, ((F.col("same") * F.col("all") - chance) / F.nullif(both - chance, F.lit(0))).alias("kappa"))


def agreement_summary(counts: DataFrame) -> DataFrame:
    """Scope (overall and each true label), n, agreement (NULL without rows), kappa for the overall scope only."""
    spark = counts.sparkSession
    per = counts.groupBy(F.col("t").alias("scope")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("same"))
    labels = spark.createDataFrame([(c,) for c in LABELS], "scope string")
    rows = labels.join(per, "scope", "left").select("scope", F.coalesce("n", F.lit(0)).alias("n"), (F.col("same") / F.nullif(F.col("n"), F.lit(0))).alias("agreement"), F.lit(None).cast("double").alias("kappa"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("same"))
    overall = total.join(F.broadcast(kappa(counts)), how="left").select(F.lit("overall").alias("scope"), "n", (F.col("same") / F.nullif(F.col("n"), F.lit(0))).alias("agreement"), "kappa")
    return overall.unionByName(rows)


def weighted_agreement(rates: DataFrame, sizes: DataFrame, label: str) -> DataFrame:
    """Mean of ``rate`` over the labels that have one, weighted by their size ``n`` in the population."""
    both = sizes.join(rates, label)
    return both.agg((F.sum(F.col("rate") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("weighted_rate"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weight N / (K n) of each label that occurs, K = 4."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n", round_at(F.col("total") / (K * F.col("n"))).alias("weight"))


def bootstrap_ci(counts_by_replicate: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval of macro F1 and the three figurative F1 over replicates, each rounded to four places first."""
    per = scores(counts_by_replicate, ["replicate"])
    a = (1 - level) / 2
    picks = ["macro_f1", *(f"f1_{c}" for c in LABELS[1:])]
    return per.agg(*(round_at(F.percentile(F.col(m), F.lit(q))).alias(f"{m}_ci_{end}") for m in picks for end, q in (("lo", a), ("hi", 1 - a))))


def deltas(rows: DataFrame, key: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Each row's metrics minus those of the baseline row."""
    base = rows.filter(F.col(key) == baseline).select(*(F.col(m).alias(f"gm_{m}") for m in metrics))
    return rows.filter(F.col(key) != baseline).join(F.broadcast(base)).select(key, *(round_at(F.col(m) - F.col(f"gm_{m}")).alias(f"delta_{m}") for m in metrics))


def unpivoted(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, value) rows."""
    return rows.unpivot(key, metrics, "metric", "value")


def from_logits(rows: DataFrame, logits: str, truth: str) -> DataFrame:
    """Macro F1 and F1 of each label, not rounded, of the greatest logit against the true class number.

    ValueError unless all four classes occur among the true or the guessed ones.
    """
    guess = F.array_position(F.col(logits), F.array_max(logits)).cast("int") - 1
    names = F.array(*map(F.lit, LABELS))
    counts = rows.filter(F.col(logits).isNotNull()).groupBy(F.get(names, F.col(truth).cast("int")).alias("t"), F.get(names, guess).alias("p")).agg(F.count("*").alias("n"))
    seen = {x for r in counts.select("t", "p").collect() for x in r}
    if not seen >= set(LABELS):
        raise ValueError(f"labels that do not occur: {sorted(set(LABELS) - seen)}")
    s = scores(counts, places=None)
    return s.select("macro_f1", *(F.col(f"f1_{c}").alias(f"{c}_f1") for c in LABELS))


def overridden(defaults: list[tuple[str, str]], changes: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """(place, label, checkpoint): the defaults in their order, with changed checkpoints of the same label, then new labels."""
    final = dict(defaults) | dict(changes)
    return [(i, k, v) for i, (k, v) in enumerate(final.items())]


def three(x: Column) -> Column:
    """A share with three decimals, as text."""
    n = F.floor(x * 1000 + F.lit(0.5)).cast("bigint")
    return F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def results_table(order: list[tuple[str, str | None]], rows: DataFrame, missing: str = "no checkpoint given") -> DataFrame:
    """Rows of a fixed order of (model, checkpoint) with their metrics, an error where there are none, and the line of a table.

    ``rows`` has model, macro_p, macro_r, macro_f1, the F1 of each label and the bounds of macro F1, which may be NULL.
    """
    spark = rows.sparkSession
    skeleton = spark.createDataFrame([(i, m, c) for i, (m, c) in enumerate(order)], "place int, model string, checkpoint string")
    cols = ["macro_p", "macro_r", "macro_f1", "macro_f1_ci_lo", "macro_f1_ci_hi", *(f"f1_{c}" for c in LABELS)]
    both = skeleton.join(rows.select("model", *cols), "model", "left")
    error = F.when(F.col("macro_f1").isNull(), missing)
    bounds = F.coalesce(F.concat(F.lit(" ["), three(F.col("macro_f1_ci_lo")), F.lit(", "), three(F.col("macro_f1_ci_hi")), F.lit("]")), F.lit(""))
    cells = [F.col("model"), three(F.col("macro_p")), three(F.col("macro_r")), F.concat(three(F.col("macro_f1")), bounds), *(three(F.col(f"f1_{c}")) for c in LABELS)]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    bare = F.concat(F.lit("| "), "model", F.lit(" | — | — | — | — | — | — | — | (not available: "), error, F.lit(")"))
    return both.select("place", "model", "checkpoint", *cols, error.alias("error"), F.when(error.isNull(), line).otherwise(bare).alias("line"))
