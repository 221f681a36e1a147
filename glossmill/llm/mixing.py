"""Mixing sources to target weights.

Method: Efraimidis-Spirakis sampling. A document's key is -ln(u)/w with u from a hash of its id and
w its quality weight; within a source the smallest keys come first. Complete epochs precede the
fractional selection, which is prefix-summed to the source's token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.operators.skew import salted
from glossmill.session import cut, written

BUCKETS = 1024
MAX_TARGETS = 100_000  # a plan of so many target sources is broadcast; documents meet a larger one by a salted join


def fill(sources: list[tuple[str, float, int, int]], budget: int | None = None) -> dict[str, int]:
    """Token quota of each (source, share, max_repeats, tokens).

    Quotas are proportional to the shares except where a source's cap (tokens x max_repeats) is
    lower; what it leaves goes to the others in proportion. The default budget is all tokens of the
    target sources. If all caps together are below the budget, every source gets its cap.
    """
    cap = {s: t * max(0, r or 0) for s, _, r, t in sources}
    share = {s: max(0.0, w or 0.0) for s, w, _, _ in sources}
    left = sum(t for *_, t in sources) if budget is None else budget
    quota = {s: 0 for s in cap}
    open_ = {s for s in cap if cap[s] > 0 and share[s] > 0}
    while open_:
        scale = left / sum(share[s] for s in open_)
        full = {s for s in open_ if cap[s] <= share[s] * scale}
        if not full:
            quota |= {s: round(share[s] * scale) for s in open_}
            break
        for s in full:
            quota[s] = cap[s]
            left -= cap[s]
        open_ -= full
    return quota


def quotas(goal: DataFrame, budget: int | None = None) -> DataFrame:
    """The quotas of :func:`fill` as a column ``quota`` of (source, target_share, max_repeats, tokens), for any number of sources.

    A source gets its cap where cap over share is no greater than the scale, else share times scale;
    the scale grows from round to round as capped sources leave their rest to the others. Only sums
    and counts come to the driver.
    """
    cap = F.col("tokens") * F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(0)))
    rows = goal.withColumns({"cap": cap.cast("double"), "share": F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0)))})
    able = rows.filter((F.col("cap") > 0) & (F.col("share") > 0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    left = budget if budget is not None else goal.agg(F.coalesce(F.sum("tokens"), F.lit(0))).collect()[0][0]
    scale, seen = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("share") * scale
        n, caps, shares = able.agg(F.count_if(full), total(F.when(full, F.col("cap"))), total(F.when(~full, F.col("share")))).collect()[0]
        if n == seen or not shares:
            break
        seen, scale = n, max(scale, (left - caps) / shares)
    free_ = F.round(F.col("share") * F.lit(float(scale))).cast("bigint")
    capped = (F.col("cap") <= F.col("share") * F.lit(float(scale))) | F.lit(not shares)
    given = F.when((F.col("cap") > 0) & (F.col("share") > 0), F.when(capped, F.col("cap").cast("bigint")).otherwise(free_)).otherwise(F.lit(0))
    return rows.withColumn("quota", given.cast("bigint")).drop("cap", "share")


def quality(text: Column) -> Column:
    """Weight of a document from 0.5 to 1.5: its share of letters and blanks among all characters."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{M} ]", ""))
    return F.lit(0.5) + F.coalesce(kept / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 17, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents of the mix with their copies, report per target source).

    ``sized`` has doc_id, source, n_tokens, weight; ``targets`` source, target_share, max_repeats.
    Documents without a source or with one that has no target get nothing; so do those without
    tokens. A target without documents is reported with 0. NULL shares and repeats count as 0.
    Repeated target rows of a source add their shares, with the largest max_repeats.
    """
    sized = sized.filter(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.col("n_tokens") > 0))
    goal = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("t"))
    known = cut(goal.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("t", F.lit(0)).alias("tokens")))
    repeats, tokens = F.coalesce("max_repeats", F.lit(0)), F.col("tokens")
    plan = quotas(known, budget).withColumn("epochs", F.when(tokens > 0, F.least(F.floor(F.col("quota") / tokens), repeats.cast("bigint"))).otherwise(F.lit(0)).cast("bigint"))
    plan = cut(plan.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), repeats.cast("int").alias("max_repeats"), F.col("tokens").cast("bigint").alias("tokens_available"), "epochs", (F.col("quota") - F.col("epochs") * tokens).alias("rest")))
    few = plan.count() <= MAX_TARGETS

    def met(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(F.broadcast(per_source), "source", how) if few else salted(rows, per_source, ["source"], "doc_id", how)

    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    keyed = met(sized, plan.select("source", "epochs", "rest")).withColumn("k", -F.ln(u) / F.col("weight"))
    keyed = keyed.withColumn("b", F.least(F.lit(BUCKETS - 1), F.floor(F.lit(BUCKETS) * (1 - F.exp(-F.col("k"))))))
    # Running sums are taken over buckets of keys, and only inside the one bucket of a source where its budget ends.
    sums = keyed.groupBy("source", "rest", "b").agg(F.sum("n_tokens").alias("s"))
    upto = F.sum("s").over(Window.partitionBy("source").orderBy("b"))
    edge = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest")).groupBy("source").agg(
        F.min("b").alias("edge"), F.min_by(F.col("upto") - F.col("s"), "b").alias("before")
    )
    keyed = met(keyed, edge, "left")
    at_edge = keyed.filter(F.col("b") == F.col("edge"))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = at_edge.withColumn("run", F.col("before") + running).filter(F.col("run") - F.col("n_tokens") / 2 <= F.col("rest")).filter(F.col("rest") > 0)
    picked = taken.select("doc_id", "source", "n_tokens", (F.col("epochs") + 1).alias("copies"))
    others = keyed.join(picked.select("doc_id", "source"), ["doc_id", "source"], "left_anti").select(
        "doc_id", "source", "n_tokens",
        (F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("b") < F.col("edge"))), 1).otherwise(0)).alias("copies"),
    )
    chosen = picked.unionByName(others).filter(F.col("copies") > 0)
    return chosen.select("doc_id", "source", "n_tokens", "copies"), plan


def report(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Actual against target share of each target source."""
    got = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    joined = plan.join(got, "source", "left").fillna(0, ["mix_tokens", "documents", "most_copies"])
    whole = F.broadcast(got.agg(F.sum("mix_tokens").alias("gm_total")))
    return joined.join(whole).select(
        "source", "target_share", (F.col("mix_tokens") / F.nullif(F.col("gm_total"), F.lit(0))).alias("actual_share"), "tokens_available", "mix_tokens",
        "documents", "most_copies", "max_repeats",
    )


def sized_documents(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with source, tokens and quality weight, from the encoder's counts."""
    facts = docs.select("doc_id", "source", quality(F.col("text")).alias("weight"))
    return written(facts.join(counts, "doc_id"))
