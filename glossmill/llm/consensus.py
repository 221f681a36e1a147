"""Consensus from several annotators' labels.

Method: expectation-maximisation over per-annotator confusion matrices and item label posteriors
(Dawid and Skene), with smoothing; chance-corrected agreement is reported apart from it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import free, written

LABELS = ("literal", "idiom", "metaphor", "simile")
K = len(LABELS)
GOLD, MODEL = "(gold)", "(model)"
SMOOTH, TRUST = 0.1, 0.3  # added to every cell of a confusion matrix, and to its diagonal besides
ROUNDS, ENOUGH = 60, 1e-4
MAX_ANNOTATORS = 100_000  # up to here the confusion matrices (128 bytes each) are held by the driver; beyond, they stay a table
ITEM = ("paragraph_id", "sentence_id")


def label_no(label: Column) -> Column:
    """Number of a label in any writing (case, blanks around, one-letter key); NULL for any other text."""
    bare = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    found = F.when(bare == LABELS[0], 0).when(bare == LABELS[0][0], 0)
    for i, name in enumerate(LABELS[1:], 1):
        found = found.when(bare.isin(name, name[0]), i)
    return found


def votes(log: DataFrame, gold: DataFrame) -> DataFrame:
    """(paragraph_id, sentence_id, annotator, label): the latest answered vote of each annotator on each item, and the gold label as one more opinion.

    Rows without item key, annotator or known label are no votes. Of answers at the same time the
    greater label counts; answers without a time come before all others.
    """
    said = log.select(*ITEM, "annotator", label_no(F.col("human_label")).alias("label"), F.col("reviewed_at").alias("at"))
    judged = gold.select(*ITEM, F.lit(GOLD).alias("annotator"), label_no(F.col("label")).alias("label"), F.col("annotated_at").alias("at"))
    known = said.filter(F.col("annotator") != GOLD).unionByName(judged.join(log.select(*ITEM).distinct(), list(ITEM), "left_semi"))
    known = known.filter(F.col("label").isNotNull() & F.col("paragraph_id").isNotNull() & F.col("sentence_id").isNotNull())
    return known.groupBy(*ITEM, "annotator").agg(F.max_by("label", F.struct("at", "label")).alias("label"))


def model_labels(log: DataFrame) -> DataFrame:
    """(paragraph_id, sentence_id, model): the model's latest known label of each item."""
    return (
        log.select(*ITEM, label_no(F.col("deepseek_label")).alias("model"), "reviewed_at")
        .filter(F.col("model").isNotNull())
        .groupBy(*ITEM)
        .agg(F.max_by("model", F.struct("reviewed_at", "model")).alias("model"))
    )


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    who, what = batch.column(0), batch.column(1)
    n = np.asarray(who.value_lengths().fill_null(0)).astype(np.int64)
    return np.repeat(np.arange(batch.num_rows), n), np.asarray(who.flatten()), np.asarray(what.flatten())


def _posterior(batch: pa.RecordBatch, log_prior: np.ndarray, log_conf: np.ndarray | None) -> tuple[np.ndarray, tuple]:
    item, who, what = flat = _flat(batch)
    t = np.zeros((batch.num_rows, K))
    if log_conf is None:
        np.add.at(t, (item, what), 1.0)
        t += 1e-9
    else:
        np.add.at(t, item, log_conf[who, :, what])
        t += log_prior
        t = np.exp(t - t.max(axis=1, keepdims=True))
    return t / t.sum(axis=1, keepdims=True), flat


def _expected(shared):
    """Expected counts (annotator, said, true) of one partition; annotator -1 holds the items by true label."""

    def run(batches):
        prior, conf, n = shared.value
        total, items = np.zeros((n, K, K)), np.zeros(K)
        for batch in batches:
            t, (item, who, what) = _posterior(batch, prior, conf)
            np.add.at(total, (who, what), t[item])
            items += t.sum(axis=0)
        who, said = np.nonzero(total.any(axis=2))
        rows = np.concatenate([total[who, said], items[None, :]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(who, -1), pa.int32()), pa.array(np.append(said, 0), pa.int32()), *(pa.array(rows[:, k]) for k in range(K))],
            names=["who", "said", *(f"t{k}" for k in range(K))],
        )

    return run


def _scored(shared):
    def run(batches):
        prior, conf, _ = shared.value
        for batch in batches:
            t, _ = _posterior(batch, prior, conf)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(t.argmax(axis=1), pa.int32()), pa.array(t.max(axis=1))], names=[*batch.schema.names[2:], "label", "certainty"])

    return run


def _maximise(rows: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts, items = np.zeros((n, K, K)), np.ones(K)
    for r in rows:
        if r[0] < 0:
            items = np.array(r[2:]) + SMOOTH
        else:
            counts[r[0], :, r[1]] = r[2:]
    counts += SMOOTH + TRUST * np.eye(K)
    return np.log(items / items.sum()), np.log(counts / counts.sum(axis=2, keepdims=True))


def estimate(cast: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) from votes.

    items: key, n_annotators (without gold), agreement (share of agreeing pairs of opinions, NULL for
    one opinion), label, certainty. annotators: annotator, n_votes, reliability (expected share of
    right labels on items of the estimated label distribution). Empty votes give empty tables.
    """
    spark = cast.sparkSession
    cast = written(cast)
    names = cast.groupBy("annotator").agg(F.count("*").alias("n_votes"))
    n = names.count()
    if n > MAX_ANNOTATORS:
        return _estimate_as_table(cast, names)
    order = sorted(r for r in names.collect())
    numbers = spark.createDataFrame([(a, i) for i, (a, _) in enumerate(order)], "annotator string, who int")
    grouped = cast.join(F.broadcast(numbers), "annotator").groupBy(*ITEM).agg(
        F.collect_list("who").alias("who"), F.collect_list("label").alias("what"), _people(), *_pairs()
    )
    items = written(grouped.select("who", "what", *ITEM, "n_annotators", _agreement()))
    lists = items.select("who", "what")
    prior, conf = np.zeros(K), None
    sums = ["who", "said", *(F.sum(f"t{k}").alias(f"t{k}") for k in range(K))]
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((prior, conf, n))
        counted = lists.mapInArrow(_expected(shared), "who int, said int, " + ", ".join(f"t{k} double" for k in range(K)))
        rows = [tuple(r) for r in counted.groupBy("who", "said").agg(*sums[2:]).collect()]
        new_prior, new_conf = _maximise(rows, n)
        change = 1.0 if conf is None else max(np.abs(np.exp(new_conf) - np.exp(conf)).max(initial=0), np.abs(np.exp(new_prior) - np.exp(prior)).max())
        prior, conf = new_prior, new_conf
        shared.unpersist()
        if change < ENOUGH:
            break
    shared = spark.sparkContext.broadcast((prior, conf, n))
    schema = "paragraph_id bigint, sentence_id bigint, n_annotators bigint, agreement double, label int, certainty double"
    scored = items.mapInArrow(_scored(shared), schema)
    right = np.exp(prior)[None, :] * np.exp(conf)[:, np.arange(K), np.arange(K)]
    trust = spark.createDataFrame([(a, c, float(right[i].sum())) for i, (a, c) in enumerate(order)], "annotator string, n_votes bigint, reliability double")
    return scored, trust


def _people() -> Column:
    return F.count(F.when(F.col("annotator") != GOLD, 1)).alias("n_annotators")


def _pairs() -> list[Column]:
    return [F.count(F.when(F.col("label") == k, 1)).alias(f"c{k}") for k in range(K)]


def _agreement() -> Column:
    c = [F.col(f"c{k}") for k in range(K)]
    n = sum(c[1:], c[0])
    return (sum((x * (x - 1) for x in c[1:]), c[0] * (c[0] - 1)) / F.nullif(n * (n - 1), F.lit(0))).alias("agreement")


def _estimate_as_table(cast: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same estimate with the confusion matrices as a table that is joined to the votes."""
    vote = F.array(*(F.when(F.col("label") == k, 1.0 + 1e-9).otherwise(1e-9) for k in range(K)))
    total = lambda x: [F.sum(x[k]).alias(f"t{k}") for k in range(K)]
    vector = F.array(*(F.col(f"t{k}") for k in range(K)))
    norm = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    post = written(cast.withColumn("v", vote).groupBy(*ITEM).agg(*total(F.col("v"))).select(*ITEM, norm(vector).alias("t")))
    last, settled = None, False
    for _ in range(ROUNDS):
        items = post.agg(*total(F.col("t"))).collect()[0]
        size = sum(x + SMOOTH for x in items if x is not None) or 1.0
        prior = [((x or 0.0) + SMOOTH) / size for x in items]
        counts = cast.join(post, list(ITEM)).groupBy("annotator", "label").agg(*total(F.col("t")))
        counts = counts.groupBy("annotator").agg(*(F.sum(F.when(F.col("label") == s, F.col(f"t{k}")).otherwise(0.0)).alias(f"m{k}{s}") for k in range(K) for s in range(K)))
        cell = lambda k, s: F.col(f"m{k}{s}") + SMOOTH + (TRUST if k == s else 0.0)
        row = lambda k: sum((cell(k, s) for s in range(1, K)), cell(k, 0))
        conf = written(counts.select("annotator", *((cell(k, s) / row(k)).alias(f"p{k}{s}") for k in range(K) for s in range(K))))
        if last is not None:
            pairs = conf.alias("n").join(last.alias("o"), "annotator")
            change = pairs.agg(F.max(F.greatest(*(F.abs(F.col(f"n.p{k}{s}") - F.col(f"o.p{k}{s}")) for k in range(K) for s in range(K))))).collect()[0][0]
            settled = change is None or change < ENOUGH
            free(last)
        last = conf
        logs = [F.element_at(F.array(*(F.ln(f"p{k}{s}") for s in range(K))), F.col("label") + 1).alias(f"t{k}") for k in range(K)]
        scores = cast.join(conf, "annotator").select(*ITEM, *logs).groupBy(*ITEM).agg(*(F.sum(f"t{k}").alias(f"t{k}") for k in range(K)))
        shifted = scores.select(*ITEM, F.array(*(F.col(f"t{k}") + float(np.log(prior[k])) for k in range(K))).alias("a"))
        powers = F.transform("a", lambda x: F.exp(x - F.array_max("a")))
        before, post = post, written(shifted.select(*ITEM, norm(powers).alias("t")))
        free(before)
        # As in the other form, the newest matrices have scored the items when the rounds end.
        if settled:
            break
    facts = cast.groupBy(*ITEM).agg(_people(), *_pairs()).select(*ITEM, "n_annotators", _agreement())
    best = post.select(*ITEM, (F.array_position("t", F.array_max("t")) - 1).cast("int").alias("label"), F.array_max("t").alias("certainty"))
    trust = conf.join(names, "annotator").select("annotator", "n_votes", sum((F.col(f"p{k}{k}") * prior[k] for k in range(1, K)), F.col("p00") * prior[0]).alias("reliability"))
    return facts.join(best, list(ITEM)), trust


def name_of(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), number + 1)


def disputed(log: DataFrame, gold: DataFrame) -> DataFrame:
    """Items with votes of at least three annotators whose consensus differs from the model's label."""
    items, _ = estimate(votes(log, gold))
    both = items.filter(F.col("n_annotators") >= 3).join(model_labels(log), list(ITEM)).filter(F.col("label") != F.col("model"))
    return both.select(*ITEM, name_of(F.col("label")).alias("consensus_label"))


def consensus(log: DataFrame, gold: DataFrame) -> DataFrame:
    items, _ = estimate(votes(log, gold))
    return items.select(*ITEM, name_of(F.col("label")).alias("consensus_label"), "certainty", "agreement", "n_annotators")


def reliability(log: DataFrame, gold: DataFrame) -> DataFrame:
    """Per annotator, gold and model: votes, expected accuracy, and Cohen's kappa against the consensus."""
    cast = written(votes(log, gold))
    items, trust = estimate(cast)
    items = written(items.select(*ITEM, F.col("label").alias("truth")))
    model = model_labels(log).select(*ITEM, F.lit(MODEL).alias("annotator"), F.col("model").alias("label"))
    pairs = cast.unionByName(model).join(items, list(ITEM)).groupBy("annotator").agg(
        F.count("*").alias("n"), F.sum((F.col("label") == F.col("truth")).cast("long")).alias("same"),
        *(F.sum((F.col(c) == k).cast("long")).alias(f"{c}{k}") for c in ("label", "truth") for k in range(K)),
    )
    by_chance = sum((F.col(f"label{k}") * F.col(f"truth{k}") for k in range(1, K)), F.col("label0") * F.col("truth0")) / (F.col("n") * F.col("n"))
    seen = F.col("same") / F.col("n")
    pairs = pairs.select("annotator", "n", seen.alias("seen"), ((seen - by_chance) / F.nullif(1 - by_chance, F.lit(0.0))).alias("kappa"))
    return pairs.join(trust, "annotator", "left").select("annotator", F.col("n").alias("n_votes"), F.coalesce("reliability", "seen").alias("reliability"), "kappa")


def agreement(log: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: items and opinions with at least two opinions, observed pairwise agreement, and Krippendorff's alpha for nominal labels."""
    c = [F.col(f"c{k}") for k in range(K)]
    n = sum(c[1:], c[0])
    items = votes(log, gold).groupBy(*ITEM).agg(*_pairs()).withColumn("n", n).filter(F.col("n") > 1)
    apart = F.sum((F.col("n") * F.col("n") - sum((x * x for x in c[1:]), c[0] * c[0])) / (F.col("n") - 1))
    sums = items.agg(F.count("*").alias("items"), F.sum("n").alias("opinions"), apart.alias("apart"), *(F.sum(f"c{k}").alias(f"s{k}") for k in range(K)))
    s = [F.col(f"s{k}") for k in range(K)]
    total = F.col("opinions")
    expected = (total * total - sum((x * x for x in s[1:]), s[0] * s[0])) / F.nullif(total - 1, F.lit(0))
    return sums.select("items", "opinions", (1 - F.col("apart") / F.nullif(total, F.lit(0))).alias("observed"), (1 - F.col("apart") / F.nullif(expected, F.lit(0.0))).alias("alpha"))
