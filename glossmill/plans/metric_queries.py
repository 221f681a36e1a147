"""Queries over samples, splits, metrics, vectors and losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from glossmill.functions import labels as L
from glossmill.functions import text as X
from glossmill.functions import vectors as V
from glossmill.operators import losses, metrics, ml, pool, retrieval, sample
from glossmill.plans import registry as R
from glossmill.plans.registry import query
from glossmill.session import table

S, D, G, SILVER = "bloomfield_texts_sentences", "documents", "bloomfield_annotated", "deepseek_labels"
LABELS = L.LABELS


def judged(spark, d):
    """Gold labels with a reproducible noisy copy as the prediction: one label in five is drawn anew."""
    g = table(spark, d, G).filter(F.col("label").isNotNull())
    h = X.draw(F.col("row_id"), "noise")
    names = F.array(*map(F.lit, LABELS))
    guess = F.when(h % 5 == 0, F.get(names, (h % 4).cast("int"))).otherwise(L.strict(F.col("label")))
    return g.select("row_id", "source_file", "text_cree", "footnote_applies", L.strict(F.col("label")).alias("t"), guess.alias("p"))


# Sampling


def _rank(key: str, by: str = "", seed: int | str = 42) -> str:
    return f"row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {R.draw(key, seed)}, {key})"


@query(f"SELECT row_id, CASE WHEN rn <= greatest(1, floor(n * 0.95::DOUBLE + 1e-9)) THEN 'train' ELSE 'dev' END AS split FROM (SELECT row_id, {_rank('row_id')} AS rn, count(*) OVER () AS n FROM {SILVER})")
def split_holdout(spark, d):
    return sample.holdout(table(spark, d, SILVER).select("row_id"), "row_id", 0.05)


@query(f"SELECT source, CASE WHEN n < 20 THEN 'both' WHEN rn <= greatest(1, floor(n * 0.9::DOUBLE + 1e-9)) THEN 'train' ELSE 'dev' END AS split FROM (SELECT source, {_rank('source')} AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM mix_targets))")
def split_small(spark, d):
    return sample.small_split(table(spark, d, "mix_targets").select("source").distinct(), "source")


@query(f"SELECT row_id, label, CASE WHEN rn <= floor(n * 0.2::DOUBLE + 0.5::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM (SELECT row_id, label, {_rank('row_id', 'label')} AS rn, count(*) OVER (PARTITION BY label) AS n FROM (SELECT row_id, deepseek_label AS label FROM {SILVER} WHERE deepseek_label IS NOT NULL))")
def split_stratified(spark, d):
    rows = table(spark, d, SILVER).select("row_id", F.col("deepseek_label").alias("label")).filter(F.col("label").isNotNull())
    return sample.stratified(rows, "row_id", "label")


@query(f"SELECT row_id, rn FROM (SELECT row_id, {_rank('row_id')} AS rn FROM {SILVER})")
def shuffled(spark, d):
    return sample.ranked(table(spark, d, SILVER).select("row_id"), "row_id", 42).select("row_id", F.col("rn").cast("bigint").alias("rn"))


@query(f"SELECT row_id, label FROM (SELECT row_id, label, {_rank('row_id', 'label')} AS rn FROM (SELECT row_id, deepseek_label AS label FROM {SILVER} WHERE deepseek_label IS NOT NULL)) WHERE rn <= 50")
def sample_per_class(spark, d):
    rows = table(spark, d, SILVER).select("row_id", F.col("deepseek_label").alias("label")).filter(F.col("label").isNotNull())
    return sample.per_class(rows, "row_id", "label", 50)


_FIG = f"(SELECT count(*) FROM {SILVER} WHERE deepseek_label <> 'literal')"


@query(f"SELECT row_id, label FROM (SELECT row_id, deepseek_label AS label, {_rank('row_id', 'deepseek_label')} AS rn FROM {SILVER} WHERE deepseek_label IS NOT NULL) WHERE label <> 'literal' OR rn <= floor({_FIG} * 1.5::DOUBLE)")
def balance_ratio(spark, d):
    rows = table(spark, d, SILVER).select("row_id", F.col("deepseek_label").alias("label")).filter(F.col("label").isNotNull())
    return sample.balanced(rows, "row_id", "label", ratio=1.5)


@query(f"SELECT row_id, part, split FROM (SELECT row_id, CASE WHEN {_rank('row_id')} <= greatest(1, floor(count(*) OVER () * 0.8::DOUBLE + 1e-9)) THEN 'train' ELSE 'dev' END AS split FROM {SILVER}), (SELECT unnest(['figure', 'literal']) AS part)")
def pair_group_split(spark, d):
    pairs = sample.holdout(table(spark, d, SILVER).select("row_id"), "row_id", 0.2)
    return pairs.select("row_id", F.explode(F.array(F.lit("figure"), F.lit("literal"))).alias("part"), "split")


@query(f"""WITH g AS (SELECT row_id, label, {_rank('row_id', 'label')} AS rn FROM {G} WHERE label IS NOT NULL),
k AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY label) - 1 AS no, count(*) OVER () AS kinds FROM g GROUP BY label),
p AS (SELECT i AS draw, {R.draw('i', '42a')} AS a, {R.draw('i', '42b')} AS b FROM range(400) t(i))
SELECT p.draw AS draw, g.row_id AS row_id, g.label AS label FROM p JOIN k ON p.a % k.kinds = k.no JOIN g ON g.label = k.label AND g.rn = p.b % k.size + 1""")
def weighted_resample(spark, d):
    return sample.resampled(table(spark, d, G).select("row_id", "label"), "row_id", "label", 400)


_MASK = R.words("text_cree")


@query(f"SELECT row_id, array_to_string(list_transform(range(len(w)), lambda i: CASE WHEN ('0x' || substr(md5(concat_ws('|', '42', row_id || '-' || i)), 1, 8))::BIGINT < {int(0.15 * (1 << 32))} THEN '[MASK]' ELSE w[i + 1] END), ' ') AS masked FROM (SELECT row_id, {_MASK} AS w FROM {G} WHERE text_cree IS NOT NULL)")
def mask_tokens(spark, d):
    rows = table(spark, d, G).filter(F.col("text_cree").isNotNull())
    return rows.select("row_id", F.array_join(sample.masked(X.words(F.col("text_cree")), F.col("row_id")), " ").alias("masked"))


@query(f"SELECT row_id, label FROM (SELECT row_id, label, {_rank('row_id', 'label')} AS rn FROM {G} WHERE label IS NOT NULL) WHERE label <> 'literal' OR rn <= 3 * (SELECT count(*) FROM {G} WHERE label = 'idiom')")
def cap_class(spark, d):
    g = table(spark, d, G).select("row_id", "label").filter(F.col("label").isNotNull())
    most = g.filter(F.col("label") == "idiom").agg((F.count("*") * 3).alias("most"))
    capped = sample.ranked(g.filter(F.col("label") == "literal"), "row_id", 42).join(F.broadcast(most)).filter(F.col("rn") <= F.col("most"))
    return g.filter(F.col("label") != "literal").unionByName(capped.select("row_id", "label"))


# Metrics

_COUNTS = f"(SELECT t, p, count(*) AS n FROM {R.JUDGED} GROUP BY t, p)"


@query(R.scores_sql(_COUNTS))
def metrics_macro(spark, d):
    return metrics.scores(metrics.confusion(judged(spark, d), "t", "p"))


@query(R.scores_sql(f"(SELECT t, p, count(*) AS n FROM {R.JUDGED} WHERE footnote_applies GROUP BY t, p)"))
def metrics_gold_gated(spark, d):
    return metrics.scores(metrics.confusion(pool.gold_gate(judged(spark, d)), "t", "p"))


def _kappa(rel: str) -> str:
    marg = " + ".join(f"coalesce(sum(n) FILTER (WHERE p = '{c}'), 0)::BIGINT * coalesce(sum(n) FILTER (WHERE t = '{c}'), 0)::BIGINT" for c in LABELS)
    return f"(coalesce(sum(n) FILTER (WHERE t = p), 0)::BIGINT * sum(n)::BIGINT - ({marg}))::DOUBLE / nullif(sum(n)::BIGINT * sum(n)::BIGINT - ({marg}), 0)"


@query(f"SELECT {R.rnd(_kappa('x'), 6)} AS kappa FROM {_COUNTS}")
def kappa(spark, d):
    return metrics.kappa(metrics.confusion(judged(spark, d), "t", "p")).select(X.round_at(F.col("kappa"), 6).alias("kappa"))


@query(f"""SELECT 'overall' AS scope, sum(n)::BIGINT AS n, {R.rnd('coalesce(sum(n) FILTER (WHERE t = p), 0)::DOUBLE / nullif(sum(n)::BIGINT, 0)')} AS agreement, {R.rnd(_kappa('x'), 6)} AS kappa FROM {_COUNTS}
UNION ALL SELECT l.scope, coalesce(sum(n), 0)::BIGINT, {R.rnd('coalesce(sum(n) FILTER (WHERE t = p), 0)::DOUBLE / nullif(sum(n)::BIGINT, 0)')}, NULL FROM (SELECT unnest({R.array(LABELS)}) AS scope) l LEFT JOIN {_COUNTS} c ON c.t = l.scope GROUP BY l.scope""")
def agreement_summary(spark, d):
    rows = metrics.agreement_summary(metrics.confusion(judged(spark, d), "t", "p"))
    return rows.select("scope", "n", X.round_at(F.col("agreement")).alias("agreement"), X.round_at(F.col("kappa"), 6).alias("kappa"))


@query(R.scores_sql(f"(SELECT t, 'literal' AS p, count(*) AS n FROM {R.JUDGED} GROUP BY t)"))
def majority_baseline(spark, d):
    return metrics.scores(metrics.confusion(judged(spark, d).withColumn("p", F.lit("literal")), "t", "p"))


_TRIALS = 200
_RANDOM = f"(SELECT trial, t, {R.array(LABELS)}[{R.roll('trial', 'row_id')} % 4 + 1] AS p, count(*) AS n FROM {R.JUDGED}, range({_TRIALS}) r(trial) GROUP BY ALL)"


def _random(spark, d):
    rows = judged(spark, d).select("row_id", "t").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(_TRIALS - 1)).cast("array<bigint>")))
    return metrics.confusion(rows.withColumn("p", F.get(F.array(*map(F.lit, LABELS)), (X.roll(F.col("trial"), F.col("row_id")) % 4).cast("int"))), "t", "p", ["trial"])


@query(f"SELECT {R.rnd('avg(macro_f1)')} AS macro_f1, {R.rnd('quantile_cont(macro_f1, 0.025)')} AS lo, {R.rnd('quantile_cont(macro_f1, 0.975)')} AS hi FROM ({R.scores_sql(_RANDOM, ('trial',))})")
def random_baseline(spark, d):
    per = metrics.scores(_random(spark, d), ["trial"])
    q = lambda p: X.round_at(F.percentile("macro_f1", F.lit(p)))
    return per.agg(X.round_at(F.avg("macro_f1")).alias("macro_f1"), q(0.025).alias("lo"), q(0.975).alias("hi"))


_B = 2000
_BOOT = f"""(WITH j AS (SELECT t, p, count(*) AS n FROM {R.JUDGED} GROUP BY t, p), c AS (SELECT t, p, (sum(n) OVER (ORDER BY t, p))::BIGINT AS hi, (sum(n) OVER (ORDER BY t, p))::BIGINT - n AS lo, (sum(n) OVER ())::BIGINT AS size FROM j),
g AS (SELECT b AS replicate, {R.roll('b', 'k')} % (SELECT max(size) FROM c) AS i, count(*) AS n FROM range({_B}) x(b), range((SELECT max(size) FROM c)) y(k) GROUP BY ALL)
SELECT replicate, t, p, sum(g.n)::BIGINT AS n FROM g JOIN c ON i >= lo AND i < hi GROUP BY replicate, t, p)"""
_PICKS = ("macro_f1", *(f"f1_{c}" for c in LABELS[1:]))
_CI = f"SELECT {', '.join(R.rnd(f'quantile_cont({m}, {q})') + f' AS {m}_ci_{e}' for m in _PICKS for e, q in (('lo', 0.025), ('hi', 0.975)))} FROM ({R.scores_sql(_BOOT, ('replicate',))})"


@query(_CI)
def bootstrap_ci(spark, d):
    return metrics.bootstrap_ci(sample.bootstrap(metrics.confusion(judged(spark, d), "t", "p"), _B), level=0.95)


_FOLD = f"(SELECT f.fold AS fold, j.t AS t, j.p AS p, count(*) AS n FROM (SELECT row_id, (row_number() OVER (PARTITION BY t ORDER BY {R.draw('row_id')}, row_id) - 1) % 5 AS fold FROM {R.JUDGED}) f JOIN {R.JUDGED} j USING (row_id) GROUP BY ALL)"


@query(R.scores_sql(_FOLD, ("fold",)))
def cv_metrics(spark, d):
    return metrics.scores(metrics.confusion(sample.folds(judged(spark, d), "row_id", "t"), "t", "p", ["fold"]), ["fold"])


_CONDS = ("full", "gloss", "none")
_ABL = f"(SELECT condition, t, CASE WHEN ('0x' || substr(md5(concat_ws('|', condition, row_id)), 1, 8))::BIGINT % 10 < level THEN 'literal' ELSE p END AS p, count(*) AS n FROM {R.JUDGED}, (SELECT unnest(['full', 'gloss', 'none']) AS condition, unnest([0, 3, 6]) AS level) GROUP BY ALL)"


def _ablation(spark, d):
    conds = F.explode(F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(v).alias("level")) for c, v in zip(_CONDS, (0, 3, 6), strict=True))))
    rows = judged(spark, d).withColumn("c", conds).select("row_id", "t", "p", "c.condition", "c.level")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "condition", F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return metrics.confusion(rows.withColumn("p", F.when(h % 10 < F.col("level"), "literal").otherwise(F.col("p"))), "t", "p", ["condition"])


@query(R.scores_sql(_ABL, ("condition",)))
def ablation_metrics(spark, d):
    return metrics.scores(_ablation(spark, d), ["condition"])


_ROWS = f"({R.scores_sql(_ABL, ('condition',))})"


@query(f"SELECT a.condition AS condition, {R.rnd('a.macro_f1 - b.macro_f1')} AS delta_macro_f1, {R.rnd('a.accuracy - b.accuracy')} AS delta_accuracy FROM {_ROWS} a, {_ROWS} b WHERE b.condition = 'full' AND a.condition <> 'full'")
def metric_deltas(spark, d):
    return metrics.deltas(ablation_metrics(spark, d), "condition", "full", ["macro_f1", "accuracy"])


@query(f"SELECT condition, macro_f1 FROM {_ROWS} WHERE NOT starts_with(condition, 'n') ORDER BY macro_f1 DESC")
def model_rank(spark, d):
    return ablation_metrics(spark, d).filter(~F.col("condition").startswith("n")).select("condition", "macro_f1").orderBy(F.desc("macro_f1"))


@query(f"SELECT condition, unnest(['macro_f1', 'accuracy']) AS metric, unnest([macro_f1, accuracy]) AS value FROM {_ROWS}")
def metrics_wide_to_long(spark, d):
    return metrics.unpivoted(ablation_metrics(spark, d).select("condition", "macro_f1", "accuracy"), "condition", ["macro_f1", "accuracy"])


_LOGITS = "(SELECT {0}[label % 4 + 1] AS t, {0}[list_position(a, list_max(a))] AS p, count(*) AS n FROM (SELECT label, list_transform(embedding, lambda x: x::DOUBLE)[1:4] AS a FROM embeddings) GROUP BY ALL)".format(R.array(LABELS))


@query(f"SELECT macro_f1, {', '.join(f'f1_{c} AS {c}_f1' for c in LABELS)} FROM ({R.scores_sql(_LOGITS, places=None)})")
def logits_metrics(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("label") % 4).alias("y"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("a"))
    return metrics.from_logits(rows, "a", "y")


_ORDER = (("Majority", None), ("Random", None), ("No adapt.", None), ("+TLM", None), ("+TLM+CLKD", None), ("Full", "folds 0 to 4"))
_COLS = ("macro_p", "macro_r", "macro_f1", *(f"f1_{c}" for c in LABELS))
_BASE_ROWS = f"""(SELECT 'Majority' AS model, {', '.join(_COLS)}, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM ({R.scores_sql(f"(SELECT t, 'literal' AS p, count(*) AS n FROM {R.JUDGED} GROUP BY t)")})
UNION ALL SELECT 'Random', {', '.join(R.rnd(f'avg({c})') for c in _COLS)}, {R.rnd('quantile_cont(macro_f1, 0.025)')}, {R.rnd('quantile_cont(macro_f1, 0.975)')} FROM ({R.scores_sql(_RANDOM, ('trial',))})
UNION ALL SELECT 'Full', {', '.join(_COLS)}, macro_f1_ci_lo, macro_f1_ci_hi FROM ({R.scores_sql(_COUNTS)}), ({_CI}))"""
_SHORT = lambda x: f"(floor(({x}) * 1000 + 0.5)::BIGINT // 1000) || '.' || lpad((floor(({x}) * 1000 + 0.5)::BIGINT % 1000)::VARCHAR, 3, '0')"


@query(f"""SELECT o.i AS place, o.model AS model, o.checkpoint AS checkpoint, {', '.join(_COLS)}, lo AS macro_f1_ci_lo, hi AS macro_f1_ci_hi, CASE WHEN macro_f1 IS NULL THEN 'no checkpoint given' END AS error,
CASE WHEN macro_f1 IS NULL THEN '| ' || o.model || ' | — | — | — | — | — | — | — | (not available: no checkpoint given)' ELSE '| ' || o.model || ' | ' || {_SHORT('macro_p')} || ' | ' || {_SHORT('macro_r')} || ' | ' || {_SHORT('macro_f1')}
|| coalesce(' [' || {_SHORT('lo')} || ', ' || {_SHORT('hi')} || ']', '') || ' | ' || {" || ' | ' || ".join(_SHORT(f'f1_{c}') for c in LABELS)} || ' |' END AS line
FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest({R.array(m for m, _ in _ORDER)}) AS model, unnest([NULL, NULL, NULL, NULL, NULL, 'folds 0 to 4']) AS checkpoint) o LEFT JOIN {_BASE_ROWS} r ON o.model = r.model""")
def results_table(spark, d):
    none = [F.lit(None).cast("double").alias(f"macro_f1_ci_{e}") for e in ("lo", "hi")]
    row = lambda df, name, bounds: df.select(F.lit(name).alias("model"), *_COLS, *bounds)
    per = metrics.scores(_random(spark, d), ["trial"])
    spread = [X.round_at(F.percentile("macro_f1", F.lit(q))).alias(f"macro_f1_ci_{e}") for e, q in (("lo", 0.025), ("hi", 0.975))]
    drawn = per.agg(*(X.round_at(F.avg(c)).alias(c) for c in _COLS), *spread)
    full = metrics_macro(spark, d).join(F.broadcast(bootstrap_ci(spark, d).select("macro_f1_ci_lo", "macro_f1_ci_hi")))
    ends = ["macro_f1_ci_lo", "macro_f1_ci_hi"]
    have = row(majority_baseline(spark, d), "Majority", none).unionByName(row(drawn, "Random", ends)).unionByName(row(full, "Full", ends))
    return metrics.results_table(list(_ORDER), have)


# Models stand for the number of leading dimensions of the vectors that they see.
_DEFAULTS = [("Base", "4"), ("+TLM", "16"), ("+TLM+InfoNCE", "32")]
_CHANGES = [("+TLM", "24"), ("Wide", "64"), ("Broken", "none")]


def _direction(dims: int, odd: int) -> str:
    cos = f"list_cosine_similarity({{}}[1:{dims}], {{}}[1:{dims}])"
    return f"""(SELECT {R.rnd('avg((rank = 1)::INTEGER::DOUBLE)')} AS r1, {R.rnd('avg((rank <= 5)::INTEGER::DOUBLE)')} AS r5, {R.rnd('avg(1.0::DOUBLE / rank)')} AS mrr FROM (
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), t AS (SELECT vec_id - vec_id % 2 AS id, e FROM u WHERE vec_id % 2 = {odd}), s AS (SELECT vec_id - vec_id % 2 AS id, e FROM u WHERE (vec_id - vec_id % 2) % 50 = 0 AND vec_id % 2 = {1 - odd})
SELECT s.id AS id, 1 + count(*) FILTER (WHERE {cos.format('s.e', 'x.e')} > {cos.format('s.e', 'g.e')} + 1e-12) AS rank FROM s JOIN t g ON g.id = s.id, t x GROUP BY s.id))"""


_TLM = " UNION ALL ".join(
    f"SELECT {i} AS place, '{m}' AS model, '{c}' AS checkpoint, " + (", ".join(f"{x}.{k} AS {y}_{k}" for x, y in (("a", "cree_to_en"), ("b", "en_to_cree")) for k in ("r1", "r5", "mrr")) + f", NULL AS error FROM {_direction(int(c), 1)} a, {_direction(int(c), 0)} b" if c.isdigit() else ", ".join(f"NULL::DOUBLE AS {y}_{k}" for y in ("cree_to_en", "en_to_cree") for k in ("r1", "r5", "mrr")) + ", 'no checkpoint: none' AS error")
    for i, m, c in metrics.overridden(_DEFAULTS, _CHANGES)
)


@query(_TLM)
def tlm_table(spark, d):
    e = emb(spark, d).select((F.col("vec_id") - F.col("vec_id") % 2).alias("id"), (F.col("vec_id") % 2).alias("odd"), "e")
    out = []
    for place, model, checkpoint in metrics.overridden(_DEFAULTS, _CHANGES):
        head = [F.lit(place).alias("place"), F.lit(model).alias("model"), F.lit(checkpoint).alias("checkpoint")]
        if not checkpoint.isdigit():
            empty = [F.lit(None).cast("double").alias(f"{y}_{k}") for y in ("cree_to_en", "en_to_cree") for k in ("r1", "r5", "mrr")]
            out.append(spark.range(1).select(*head, *empty, F.lit(f"no checkpoint: {checkpoint}").alias("error")))
            continue
        seen = e.withColumn("v", F.slice("e", 1, int(checkpoint))).select("id", "odd", "v")
        sides = []
        for y, own in (("cree_to_en", 0), ("en_to_cree", 1)):
            ranks = retrieval.gold_ranks(seen.filter((F.col("odd") == own) & (F.col("id") % 50 == 0)).select("id", "v"), seen.filter(F.col("odd") == 1 - own).select("id", "v"))
            sides.append(retrieval.retrieval_metrics(ranks).select(*(X.round_at(F.col(k)).alias(f"{y}_{k}") for k in ("r1", "r5", "mrr"))))
        out.append(sides[0].join(F.broadcast(sides[1])).select(*head, "*", F.lit(None).cast("string").alias("error")))
    return reduce(lambda a, b: a.unionByName(b), out)


_STATISTICS = (
    "total_words", "total_sentences", "vocabulary_size", "type_token_ratio", "avg_words_per_paragraph", "avg_sentences_per_paragraph", "avg_words_per_sentence",
    "avg_word_length_chars", "avg_chars_per_paragraph", "mean_cree_en_word_ratio", "footnote_coverage_pct",
)
_P = "bloomfield_texts"


def _stats(c: str) -> str:
    x = f"coalesce({c}, '')"
    rows = f"(SELECT {R.words(x)} AS w, {R.sentences_bare(x)} AS s, length({x}) AS n FROM {_P})"
    per = f"(SELECT len(w) AS w, len(s) AS s, n, {R.average('list_transform(w, lambda z: length(z))')} AS wl, {R.average(f'list_transform(s, lambda z: len({R.words("z")}))')} AS sl FROM {rows})"
    vocabulary = f"(SELECT count(DISTINCT v) AS types, count(*) AS tokens FROM (SELECT unnest(w) AS v FROM {rows}))"
    return f"""(SELECT coalesce(sum(w), 0)::DOUBLE AS total_words, coalesce(sum(s), 0)::DOUBLE AS total_sentences, any_value(types)::DOUBLE AS vocabulary_size, {R.rnd('any_value(types)::DOUBLE / nullif(any_value(tokens), 0)')} AS type_token_ratio,
{R.rnd('avg(w)', 2)} AS avg_words_per_paragraph, {R.rnd('avg(s)', 2)} AS avg_sentences_per_paragraph, {R.rnd('avg(sl)', 2)} AS avg_words_per_sentence, {R.rnd('avg(wl)', 2)} AS avg_word_length_chars, {R.rnd('avg(n)', 2)} AS avg_chars_per_paragraph FROM {per}, {vocabulary})"""


_WIDE = f"""(SELECT {R.rnd("avg(a::DOUBLE / nullif(b, 0))", 3)} AS mean_cree_en_word_ratio, {R.rnd("avg(f::DOUBLE) * 100", 2)} AS footnote_coverage_pct FROM (
SELECT len({R.words("coalesce(text_cree, '')")}) AS a, len({R.words("coalesce(text_en, '')")}) AS b, (footnote_en IS NOT NULL AND {R.strip('footnote_en')} <> '')::INTEGER AS f FROM {_P}))"""


@query("WITH c AS " + _stats("text_cree") + ", e AS " + _stats("text_en") + ", o AS " + _WIDE + " " + " UNION ALL ".join(f"SELECT {i} AS place, '{k}' AS statistic, " + (f"c.{k} AS cree, e.{k} AS english FROM c, e" if i < 9 else f"o.{k} AS cree, NULL::DOUBLE AS english FROM o") for i, k in enumerate(_STATISTICS)))
def corpus_summary(spark, d):
    rows = table(spark, d, _P).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text_cree", "text_en")), "footnote_en")

    def side(c: str, name: str):
        w, s = X.words(F.col(c)), X.sentences_bare(F.col(c))
        per = rows.select(F.size(w).alias("w"), F.size(s).alias("s"), F.length(c).alias("n"), X.word_length(F.col(c)).alias("wl"), X.sentence_length(F.col(c)).alias("sl"))
        # Words are counted where they stand before they are shuffled.
        types = rows.select(F.explode(w).alias("v")).groupBy("v").agg(F.count("*").alias("n")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))
        total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("double")
        mean = lambda x: X.round_at(F.avg(x), 2)
        one = per.agg(total("w").alias(_STATISTICS[0]), total("s").alias(_STATISTICS[1]), *(mean(x).alias(k) for x, k in zip(("w", "s", "sl", "wl", "n"), _STATISTICS[4:9], strict=True)))
        ratio = X.round_at(F.col("types") / F.nullif(F.col("tokens"), F.lit(0)))
        both = one.join(F.broadcast(types.select(F.col("types").cast("double").alias(_STATISTICS[2]), ratio.alias(_STATISTICS[3]))))
        return both.unpivot([], list(_STATISTICS[:9]), "statistic", name)

    noted = F.col("footnote_en").isNotNull() & (X.strip(F.col("footnote_en")) != "")
    ratio = F.size(X.words(F.col("text_cree"))) / F.nullif(F.size(X.words(F.col("text_en"))), F.lit(0))
    wide = rows.agg(X.round_at(F.avg(ratio), 3).alias(_STATISTICS[9]), X.round_at(F.avg(noted.cast("double")) * 100, 2).alias(_STATISTICS[10]))
    rest = wide.unpivot([], list(_STATISTICS[9:]), "statistic", "cree").withColumn("english", F.lit(None).cast("double"))
    all_ = side("text_cree", "cree").join(side("text_en", "english"), "statistic").unionByName(rest)
    return all_.select((F.array_position(F.array(*map(F.lit, _STATISTICS)), F.col("statistic")) - 1).cast("int").alias("place"), "statistic", "cree", "english")


@query(f"""SELECT source, {R.rnd('sum(letters)::DOUBLE / nullif(sum(n), 0)')} AS letters_per_word, {R.rnd('avg(sl)', 3)} AS words_per_sentence FROM (SELECT source, list_sum(list_transform(w, lambda z: length(z))) AS letters, len(w) AS n,
{R.average(f'list_transform(s, lambda z: len({R.words("z")}))')} AS sl FROM (SELECT source, {R.words('text')} AS w, {R.sentences_bare('text')} AS s FROM {D} WHERE text IS NOT NULL AND source IS NOT NULL)) GROUP BY source""")
def word_lengths(spark, d):
    rows = table(spark, d, D).dropna(subset=["text", "source"]).select("source", X.words(F.col("text")).alias("w"), X.sentence_length(F.col("text")).alias("sl"))
    size = F.aggregate("w", F.lit(0), lambda s, x: s + F.length(x))
    return rows.groupBy("source").agg(X.round_at(F.sum(size) / F.nullif(F.sum(F.size("w")), F.lit(0))).alias("letters_per_word"), X.round_at(F.avg("sl"), 3).alias("words_per_sentence"))


# Vectors: the first four values of an embedding serve as class logits, the next four as those of a student.

_E = "list_transform(embedding, lambda x: x::DOUBLE)"
_EMB = f"(SELECT vec_id, label, {_E} AS e, list_transform({_E}[1:4], lambda x: x * 4.0::DOUBLE) AS a, list_transform({_E}[5:8], lambda x: x * 4.0::DOUBLE) AS b FROM embeddings)"
_SM = lambda v, t="1.0": f"list_transform(list_transform({v}, lambda x: exp((x - list_max({v})) / {t}::DOUBLE)), lambda y: y / list_sum(list_transform({v}, lambda x: exp((x - list_max({v})) / {t}::DOUBLE))))"
_LSM = lambda v: f"list_transform({v}, lambda y: y - (ln(list_sum(list_transform({v}, lambda x: exp(x - list_max({v}))))) + list_max({v})))"


def emb(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    four = lambda k: F.transform(F.slice(e, k, 4), lambda x: x * F.lit(4.0))
    return table(spark, d, "embeddings").select("vec_id", "label", e.alias("e"), four(1).alias("a"), four(5).alias("b"))


@query(f"SELECT vec_id, {R.array(LABELS)}[list_position(p, list_max(p))] AS model_label, {R.rnd('list_max(p)')} AS confidence, " + ", ".join(f"{R.rnd(f'p[{i + 1}]')} AS prob_{c}" for i, c in enumerate(LABELS)) + f" FROM (SELECT vec_id, {_SM('a')} AS p FROM {_EMB})")
def softmax_predict(spark, d):
    p = emb(spark, d).select("vec_id", V.softmax(F.col("a")).alias("p"))
    names = F.array(*map(F.lit, LABELS))
    return p.select("vec_id", F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int")).alias("model_label"), X.round_at(F.array_max("p")).alias("confidence"), *(X.round_at(F.get("p", F.lit(i))).alias(f"prob_{c}") for i, c in enumerate(LABELS)))


@query(f"SELECT vec_id, {R.rnd('list_sum(list_transform(range(1, 5), lambda i: p[i] * (ln(p[i]) - q[i])))', 6)} AS kl FROM (SELECT vec_id, {_SM('a', '4.0')} AS p, {_LSM('b')} AS q FROM {_EMB})")
def kl_distill(spark, d):
    return emb(spark, d).select("vec_id", X.round_at(V.kl(F.col("a"), F.col("b"), 4.0), 6).alias("kl"))


@query(f"SELECT vec_id, {R.rnd('p * ln((p + 1e-8::DOUBLE) / (q + 1e-8::DOUBLE)) + (1.0::DOUBLE - p) * ln((1.0::DOUBLE - p + 1e-8::DOUBLE) / (1.0::DOUBLE - q + 1e-8::DOUBLE))', 6)} AS kl FROM (SELECT vec_id, ({_SM('a')})[1] AS p, ({_SM('b')})[1] AS q FROM {_EMB})")
def kl_binary(spark, d):
    first = lambda c: F.get(V.softmax(F.col(c)), F.lit(0))
    return emb(spark, d).select("vec_id", X.round_at(V.kl_binary(first("a"), first("b")), 6).alias("kl"))


@query(f"SELECT x.vec_id AS vec_id, {R.rnd('1.0::DOUBLE - list_cosine_similarity(x.e, y.e)', 6)} AS loss FROM {_EMB} x JOIN {_EMB} y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0")
def cosine_align(spark, d):
    e = emb(spark, d)
    both = e.filter(F.col("vec_id") % 2 == 0).select("vec_id", "e").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return both.select("vec_id", X.round_at(1 - V.cosine(F.col("e"), F.col("f")), 6).alias("loss"))


_SIG = lambda x: f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))))"


@query(f"SELECT vec_id, {R.rnd('ln(' + _SIG('-a[1]') + ')', 6)} AS lp_literal, " + ", ".join(f"{R.rnd(f'k[{i}] + ln({_SIG('a[1]')})', 6)} AS lp_{c}" for i, c in enumerate(LABELS[1:], 1)) + f" FROM (SELECT vec_id, a, {_LSM('a[2:4]')} AS k FROM {_EMB})")
def hier_logprobs(spark, d):
    lp = V.hierarchy(F.get("a", F.lit(0)), F.slice("a", 2, 3))
    return emb(spark, d).select("vec_id", lp.alias("lp")).select("vec_id", *(X.round_at(F.get("lp", F.lit(i)), 6).alias(f"lp_{c}") for i, c in enumerate(LABELS)))


@query(f"""SELECT {R.rnd('avg(CASE WHEN y > 0 THEN -ln(' + _SIG('a[1]') + ') ELSE -ln(' + _SIG('-a[1]') + ') END) + coalesce(avg(-k[y]) FILTER (WHERE y > 0), 0)', 5)} AS loss FROM (SELECT (label % 4) AS y, a, {_LSM('a[2:4]')} AS k FROM {_EMB})""")
def hier_loss(spark, d):
    y = F.col("label") % 4
    z = F.get("a", F.lit(0))
    rows = emb(spark, d).select(y.alias("y"), z.alias("z"), F.get(V.log_softmax(F.slice("a", 2, 3)), (y - 1).cast("int")).alias("k"))
    bce = F.when(F.col("y") > 0, -F.ln(V.sigmoid(F.col("z")))).otherwise(-F.ln(V.sigmoid(-F.col("z"))))
    return rows.agg(X.round_at(F.avg(bce) + F.coalesce(F.avg(F.when(F.col("y") > 0, -F.col("k"))), F.lit(0.0)), 5).alias("loss"))


@query(f"WITH x AS (SELECT label % 4 AS y, {_LSM('a')} AS q FROM {_EMB}), w AS (SELECT y, (SELECT count(*) FROM x)::DOUBLE / (4 * count(*)) AS w FROM x GROUP BY y) SELECT {R.rnd('sum(w * -q[y + 1]) / sum(w)', 5)} AS loss FROM x JOIN w USING (y)")
def weighted_ce(spark, d):
    x = emb(spark, d).select((F.col("label") % 4).alias("y"), V.log_softmax(F.col("a")).alias("q"))
    sizes = x.groupBy("y").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    w = sizes.join(F.broadcast(total)).select("y", (F.col("total") / (4 * F.col("n"))).alias("w"))
    nll = -F.get("q", F.col("y").cast("int"))
    return x.join(F.broadcast(w), "y").agg(X.round_at(F.sum(F.col("w") * nll) / F.sum("w"), 5).alias("loss"))


# A vector serves as 16 tokens of four values, of which those that begin with a positive value are unmasked.
_MASKS = "list_transform(range(16), lambda k: CASE WHEN e[k * 4 + 1] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@query("SELECT vec_id, " + ", ".join(R.rnd(f"list_sum(list_transform(range(16), lambda k: e[k * 4 + {i + 1}] * m[k + 1])) / greatest(list_sum(m), 1e-9::DOUBLE)", 5) + f" AS mean_{i}" for i in range(4)) + f" FROM (SELECT vec_id, e, {_MASKS} AS m FROM {_EMB})")
def mean_pool(spark, d):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("e", k * 4 + 1, F.lit(4)))
    rows = emb(spark, d).select("vec_id", tokens.alias("tokens")).withColumn("mask", F.transform("tokens", lambda v: F.when(F.get(v, F.lit(0)) > 0, 1.0).otherwise(0.0)))
    pooled = rows.select("vec_id", V.masked_mean(F.col("tokens"), F.col("mask"), 4).alias("p"))
    return pooled.select("vec_id", *(X.round_at(F.get("p", F.lit(i)), 5).alias(f"mean_{i}") for i in range(4)))


@query(f"""WITH u AS (SELECT vec_id, {_E} AS e FROM embeddings), q AS (SELECT x.vec_id AS i, x.vec_id // {2 * losses.BATCH} AS batch, x.e AS x, y.e AS y FROM u x JOIN u y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0),
s AS (SELECT a.batch AS batch, a.i AS i, b.i AS j, list_cosine_similarity(a.x, b.y) / 0.05::DOUBLE AS z FROM q a JOIN q b ON a.batch = b.batch),
r AS (SELECT batch, avg(l) AS l FROM (SELECT batch, i, ln(sum(exp(z - 20))) + 20 - max(z) FILTER (WHERE i = j) AS l FROM s GROUP BY batch, i) GROUP BY batch),
c AS (SELECT batch, avg(l) AS l FROM (SELECT batch, j, ln(sum(exp(z - 20))) + 20 - max(z) FILTER (WHERE i = j) AS l FROM s GROUP BY batch, j) GROUP BY batch)
SELECT r.batch AS batch, {R.rnd('(r.l + c.l) / 2', 4)} AS loss FROM r JOIN c ON r.batch = c.batch""")
def info_nce(spark, d):
    e = emb(spark, d)
    x = e.filter(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("pair"), F.floor(F.col("vec_id") / (2 * losses.BATCH)).alias("batch"), F.col("e").alias("x"))
    y = e.filter(F.col("vec_id") % 2 == 1).select((F.col("vec_id") - 1).alias("pair"), F.col("e").alias("y"))
    return losses.info_nce(x.join(y, "pair")).select("batch", X.round_at(F.col("loss"), 4).alias("loss"))


@query(f"SELECT o_orderstatus, {R.rnd('exp(sum(l * n)::DOUBLE / greatest(sum(n), 1))', 5)} AS perplexity FROM (SELECT o_orderstatus, (o_orderkey % 7)::BIGINT AS n, (o_custkey % 5)::BIGINT AS l FROM orders) GROUP BY o_orderstatus")
def pseudo_ppl(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", (F.col("o_orderkey") % 7).alias("n"), (F.col("o_custkey") % 5).alias("l"))
    return o.groupBy("o_orderstatus").agg(X.round_at(F.exp(F.sum(F.col("l") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))), 5).alias("perplexity"))


@query(f"SELECT vec_id, {R.rnd('list_sum(list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-9::DOUBLE)))', 5)} AS total FROM {_EMB}")
def unit_vectors(spark, d):
    return emb(spark, d).select("vec_id", X.round_at(V.total(V.unit(F.col("e"))), 5).alias("total"))


_RANKS = f"""(WITH u AS (SELECT vec_id, {_E} AS e FROM embeddings), t AS (SELECT vec_id - 1 AS id, e FROM u WHERE vec_id % 2 = 1), s AS (SELECT vec_id AS id, e FROM u WHERE vec_id % 50 = 0)
SELECT s.id AS id, 1 + count(*) FILTER (WHERE list_cosine_similarity(s.e, x.e) > list_cosine_similarity(s.e, g.e) + 1e-12) AS rank FROM s JOIN t g ON g.id = s.id, t x GROUP BY s.id)"""


def _ranks(spark, d):
    e = emb(spark, d)
    targets = e.filter(F.col("vec_id") % 2 == 1).select((F.col("vec_id") - 1).alias("id"), F.col("e").alias("v"))
    return retrieval.gold_ranks(e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("id"), F.col("e").alias("v")), targets)


@query(f"SELECT id, rank FROM {_RANKS}")
def gold_rank(spark, d):
    return _ranks(spark, d)


@query(f"SELECT {R.rnd('avg((rank = 1)::INTEGER::DOUBLE)')} AS r1, {R.rnd('avg((rank <= 5)::INTEGER::DOUBLE)')} AS r5, {R.rnd('avg(1.0::DOUBLE / rank)')} AS mrr FROM {_RANKS}")
def retrieval_metrics(spark, d):
    return retrieval.retrieval_metrics(_ranks(spark, d)).select(*(X.round_at(F.col(c)).alias(c) for c in ("r1", "r5", "mrr")))


# Models


@query()
def classifier_predictions(spark, d):
    silver = table(spark, d, SILVER).select("text_cree", "deepseek_label")
    model = ml.fit(silver, "text_cree", "deepseek_label")
    return ml.predict(model, table(spark, d, G).select("row_id", "text_cree"), "row_id", "text_cree")


@query()
def classifier_scores(spark, d):
    guessed = classifier_predictions(spark, d).join(judged(spark, d).select("row_id", "t"), "row_id")
    return metrics.scores(metrics.confusion(guessed, "t", "model_label"))


@query(f"""SELECT row_id, 'agreed' AS verdict FROM {R.JUDGED} WHERE t = p UNION ALL SELECT row_id, 'changed from ' || p || ' to ' || t FROM {R.JUDGED} WHERE t <> p""")
def review_report(spark, d):
    same = F.col("t") == F.col("p")
    return judged(spark, d).select("row_id", F.when(same, "agreed").otherwise(F.concat(F.lit("changed from "), "p", F.lit(" to "), "t")).alias("verdict"))


@query(f"SELECT (length(text_en) // 20 * 20)::BIGINT AS bin, count(*) AS n FROM {S} WHERE text_en IS NOT NULL GROUP BY 1")
def length_histogram(spark, d):
    return table(spark, d, S).filter(F.col("text_en").isNotNull()).groupBy((F.floor(F.length("text_en") / 20) * 20).alias("bin")).agg(F.count("*").alias("n"))

