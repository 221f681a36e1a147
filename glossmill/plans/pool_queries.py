"""Queries over joins, unions, aggregates, windows and top rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions import labels as L
from glossmill.functions import text as X
from glossmill.operators import incremental, metrics, pool, sample, skew
from glossmill.plans import registry as R
from glossmill.plans.registry import query
from glossmill.plans.text_queries import POOL_SQL
from glossmill.session import table

S, D, P, G, V, C = "bloomfield_texts_sentences", "documents", "bloomfield_texts", "bloomfield_annotated", "deepseek_labels", "silver_verification_cache"


def rows_of(spark, d, name, *cols):
    return table(spark, d, name).select(*cols)


# Joins


@query(f"""SELECT g.row_id AS gold_row, v.row_id AS silver_row, g.label AS label, v.deepseek_label AS deepseek_label, g.label = v.deepseek_label AS agree
FROM {G} g JOIN {V} v ON g.text_cree = v.text_cree""")
def agree_join(spark, d):
    g = rows_of(spark, d, G, F.col("row_id").alias("gold_row"), "text_cree", "label")
    v = rows_of(spark, d, V, F.col("row_id").alias("silver_row"), "text_cree", "deepseek_label")
    # One silver text may have very many copies.
    return skew.salted(v, g, ["text_cree"], "silver_row").select("gold_row", "silver_row", "label", "deepseek_label", (F.col("label") == F.col("deepseek_label")).alias("agree"))


@query(f"""SELECT (SELECT count(*) FROM {G}) - (SELECT count(*) FROM {G} g JOIN {V} v ON g.text_cree = v.text_cree) AS left_dropped,
(SELECT count(*) FROM {V}) - (SELECT count(*) FROM {G} g JOIN {V} v ON g.text_cree = v.text_cree) AS right_dropped""")
def agree_join_drops(spark, d):
    a = rows_of(spark, d, G, "text_cree").groupBy("text_cree").agg(F.count("*").alias("a"))
    b = rows_of(spark, d, V, "text_cree").groupBy("text_cree").agg(F.count("*").alias("b"))
    both = a.join(b, "text_cree", "full")
    met = F.sum(F.when(F.col("text_cree").isNotNull(), F.coalesce(F.col("a") * F.col("b"), F.lit(0))).otherwise(0))
    return both.agg((F.sum(F.coalesce("a", F.lit(0))) - met).alias("left_dropped"), (F.sum(F.coalesce("b", F.lit(0))) - met).alias("right_dropped"))


_DIM = f"(SELECT text_cree, arg_min(source_file, row_id) FILTER (WHERE source_file IS NOT NULL) AS source_file FROM {S} WHERE text_cree IS NOT NULL GROUP BY text_cree)"


def dimension(spark, d):
    named = rows_of(spark, d, S, "row_id", "text_cree", "source_file").filter(F.col("text_cree").isNotNull())
    return named.groupBy("text_cree").agg(F.min_by("source_file", F.when(F.col("source_file").isNotNull(), F.col("row_id"))).alias("source_file"))


@query(f"SELECT v.row_id AS row_id, s.source_file AS source_file FROM {V} v LEFT JOIN {_DIM} s ON v.text_cree = s.text_cree")
def dimension_left(spark, d):
    return rows_of(spark, d, V, "row_id", "text_cree").join(dimension(spark, d), "text_cree", "left").select("row_id", "source_file")


@query(f"SELECT count(*) AS rows, (count(*) FILTER (WHERE s.source_file IS NULL))::BIGINT AS unresolved FROM {V} v LEFT JOIN {_DIM} s ON v.text_cree = s.text_cree")
def left_lookup_unresolved(spark, d):
    return dimension_left(spark, d).agg(F.count("*").alias("rows"), F.count_if(F.col("source_file").isNull()).alias("unresolved"))


_GOLD1 = f"(SELECT text_cree, row_id, label, row_number() OVER (PARTITION BY text_cree ORDER BY row_id) AS k FROM {G} WHERE label IS NOT NULL AND text_cree IS NOT NULL)"
_FOLDS = f"(SELECT text_cree, row_id, {R.strict('label')} AS label, (row_number() OVER (PARTITION BY {R.strict('label')} ORDER BY {R.draw('row_id')}, row_id) - 1) % 5 AS fold FROM {_GOLD1} WHERE k = 1)"


def folded(spark, d):
    g = rows_of(spark, d, G, "row_id", "text_cree", "label").dropna(subset=["label", "text_cree"])
    g = pool.first_wins(g, ["text_cree"], ["row_id"]).withColumn("label", L.strict(F.col("label")))
    return sample.folds(g, "row_id", "label")


@query(f"SELECT text_cree, row_id, label, fold FROM {_FOLDS}")
def folds5(spark, d):
    return folded(spark, d).select("text_cree", "row_id", "label", "fold")


@query(f"SELECT f.text_cree AS text_cree, f.fold AS fold, v.deepseek_label AS deepseek_label FROM {_FOLDS} f LEFT JOIN (SELECT text_cree, arg_min(deepseek_label, row_id) AS deepseek_label FROM {V} WHERE deepseek_label IS NOT NULL GROUP BY text_cree) v ON f.text_cree = v.text_cree")
def folds_labels(spark, d):
    v = rows_of(spark, d, V, "row_id", "text_cree", "deepseek_label").filter(F.col("deepseek_label").isNotNull()).groupBy("text_cree").agg(F.min_by("deepseek_label", "row_id").alias("deepseek_label"))
    return folded(spark, d).select("text_cree", "fold").join(v, "text_cree", "left")


@query(f"SELECT f.text_cree AS text_cree, f.fold AS fold, v.deepseek_label AS deepseek_label FROM {_FOLDS} f JOIN (SELECT text_cree, arg_min(deepseek_label, row_id) AS deepseek_label FROM {V} WHERE deepseek_label IS NOT NULL GROUP BY text_cree) v ON f.text_cree = v.text_cree")
def left_then_dropna(spark, d):
    return folds_labels(spark, d).filter(F.col("deepseek_label").isNotNull())


@query(f"SELECT row_id FROM {V} v WHERE NOT EXISTS (SELECT 1 FROM {G} g WHERE g.text_cree = v.text_cree)")
def anti_gold_raw(spark, d):
    return pool.without(rows_of(spark, d, V, "row_id", "text_cree"), table(spark, d, G), ["text_cree"]).select("row_id")


@query(f"SELECT row_id FROM {V} v WHERE NOT EXISTS (SELECT 1 FROM {G} g WHERE {R.strip('g.text_cree')} = {R.strip('v.text_cree')})")
def anti_gold_stripped(spark, d):
    return pool.without(rows_of(spark, d, V, "row_id", "text_cree"), table(spark, d, G), ["text_cree"], stripped=True).select("row_id")


@query(f"SELECT row_id FROM {S} v WHERE NOT EXISTS (SELECT 1 FROM {G} g WHERE g.paragraph_id = v.paragraph_id AND g.sentence_id = v.sentence_id)")
def anti_composite(spark, d):
    return pool.without(rows_of(spark, d, S, "row_id", "paragraph_id", "sentence_id"), table(spark, d, G), ["paragraph_id", "sentence_id"]).select("row_id")


@query(f"SELECT row_id FROM {V} v WHERE NOT EXISTS (SELECT 1 FROM {_FOLDS} g WHERE g.text_cree = v.text_cree AND fold = 0)")
def anti_fold(spark, d):
    return pool.without(rows_of(spark, d, V, "row_id", "text_cree"), folded(spark, d).filter(F.col("fold") == 0), ["text_cree"]).select("row_id")


@query(f"SELECT row_id FROM {V} v WHERE EXISTS (SELECT 1 FROM {G} g WHERE g.text_cree = v.text_cree)")
def semi_gold(spark, d):
    return pool.within(rows_of(spark, d, V, "row_id", "text_cree"), table(spark, d, G), ["text_cree"]).select("row_id")


_TODO = f"SELECT DISTINCT paragraph_id, sentence_id FROM {S} s WHERE NOT EXISTS (SELECT 1 FROM {C} c WHERE c.paragraph_id = s.paragraph_id AND c.sentence_id = s.sentence_id AND c.human_label IS NOT NULL)"


@query(_TODO)
def cache_todo(spark, d):
    done = table(spark, d, C).filter(F.col("human_label").isNotNull())
    return pool.without(rows_of(spark, d, S, "paragraph_id", "sentence_id").distinct(), done, ["paragraph_id", "sentence_id"])


@query(f"SELECT row_id FROM {S} s WHERE EXISTS (SELECT 1 FROM {C} c WHERE c.paragraph_id = s.paragraph_id AND c.sentence_id = s.sentence_id)")
def reviewed(spark, d):
    return pool.within(rows_of(spark, d, S, "row_id", "paragraph_id", "sentence_id"), table(spark, d, C), ["paragraph_id", "sentence_id"]).select("row_id")


@query(f"WITH w AS (SELECT DISTINCT text_cree FROM {G} WHERE text_cree IS NOT NULL), h AS (SELECT DISTINCT text_cree FROM {V}) SELECT (SELECT count(*) FROM w) AS wanted, (SELECT count(*) FROM w WHERE text_cree NOT IN (SELECT text_cree FROM h WHERE text_cree IS NOT NULL)) AS missing")
def restrict_to_missing(spark, d):
    w = rows_of(spark, d, G, "text_cree").dropna().distinct()
    h = rows_of(spark, d, V, "text_cree").dropna().distinct().withColumn("here", F.lit(1))
    return w.join(h, "text_cree", "left").agg(F.count("*").alias("wanted"), F.count_if(F.col("here").isNull()).alias("missing"))


_PTOK = "(SELECT DISTINCT lower(unnest(regexp_extract_all(text_en, '[a-zA-Z]{3,}'))) AS token FROM bloomfield_annotated)"


@query(f"SELECT DISTINCT t.token AS token, l.lemma AS lemma FROM {_PTOK} t JOIN (SELECT DISTINCT token AS lemma FROM dictionary) l ON starts_with(strip_accents(lower(l.lemma)), strip_accents(t.token)) WHERE length(l.lemma) >= 3")
def prefix_join_dictionary(spark, d):
    words = F.regexp_extract_all("text_en", F.lit("([a-zA-Z]{3,})"), F.lit(1))
    tokens = rows_of(spark, d, G, "text_en").select(F.explode(words).alias("t")).select(F.lower("t").alias("token")).distinct()
    return pool.prefix_matches(tokens, rows_of(spark, d, "dictionary", F.col("token").alias("lemma")))


_ZIP = f"SELECT paragraph_id, k, text_cree FROM (SELECT paragraph_id, text_cree, row_number() OVER (PARTITION BY paragraph_id ORDER BY row_id) AS k FROM {S} WHERE text_cree IS NOT NULL)"


@query(f"SELECT a.paragraph_id AS paragraph_id, a.text_cree AS text_cree, b.text_en AS text_en FROM ({_ZIP}) a JOIN ({_ZIP.replace('text_cree', 'text_en')}) b ON a.paragraph_id = b.paragraph_id AND a.k = b.k")
def pair_zip(spark, d):
    rows = table(spark, d, S)
    left = rows.select("paragraph_id", "row_id", "text_cree").dropna(subset=["text_cree"])
    right = rows.select("paragraph_id", "row_id", "text_en").dropna(subset=["text_en"])
    return pool.zipped(left, right, "paragraph_id", "row_id").select("paragraph_id", "text_cree", "text_en")


@query(f"""SELECT s.row_id AS row_id, coalesce(g.label, 'literal') AS label, coalesce(g.footnote_applies, false) AS footnote_applies, coalesce(g.rationale, '') AS rationale FROM {S} s
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY paragraph_id, sentence_id ORDER BY row_id) AS k FROM {G}) g ON s.paragraph_id = g.paragraph_id AND s.sentence_id = g.sentence_id AND g.k = 1""")
def positional_default(spark, d):
    g = pool.first_wins(rows_of(spark, d, G, "row_id", "paragraph_id", "sentence_id", "label", "footnote_applies", "rationale"), ["paragraph_id", "sentence_id"], ["row_id"]).drop("row_id")
    rows = rows_of(spark, d, S, "row_id", "paragraph_id", "sentence_id").join(g, ["paragraph_id", "sentence_id"], "left")
    return rows.select("row_id", F.coalesce("label", F.lit("literal")).alias("label"), F.coalesce("footnote_applies", F.lit(False)).alias("footnote_applies"), F.coalesce("rationale", F.lit("")).alias("rationale"))


_LAST = f"(SELECT paragraph_id, sentence_id, {R.strict('human_label')} AS human, {R.strict('deepseek_label')} AS model, row_number() OVER (PARTITION BY paragraph_id, sentence_id ORDER BY reviewed_at DESC NULLS LAST, annotator DESC NULLS LAST, human_label DESC, deepseek_label DESC NULLS LAST) AS k FROM {C} WHERE human_label IS NOT NULL)"


def last_review(spark, d):
    log = rows_of(spark, d, C, "paragraph_id", "sentence_id", "annotator", "reviewed_at", "human_label", "deepseek_label").filter(F.col("human_label").isNotNull())
    last = pool.last_wins(log, ["paragraph_id", "sentence_id"], ["reviewed_at", "annotator", "human_label", "deepseek_label"])
    return last.select("paragraph_id", "sentence_id", L.strict(F.col("human_label")).alias("human"), L.strict(F.col("deepseek_label")).alias("model"))


@query(f"SELECT paragraph_id, sentence_id, human, model FROM {_LAST} WHERE k = 1")
def cache_last_wins(spark, d):
    return last_review(spark, d)


@query(f"""SELECT g.row_id AS row_id, coalesce(c.human, g.label) AS label, g.label AS label_before, c.human IS NOT NULL AS human_verified, coalesce(c.human <> g.label, false) AS human_corrected
FROM {G} g LEFT JOIN {_LAST} c ON g.paragraph_id = c.paragraph_id AND g.sentence_id = c.sentence_id AND c.k = 1""")
def corrections_apply(spark, d):
    both = rows_of(spark, d, G, "row_id", "paragraph_id", "sentence_id", "label").join(last_review(spark, d), ["paragraph_id", "sentence_id"], "left")
    return both.select(
        "row_id", F.coalesce("human", "label").alias("label"), F.col("label").alias("label_before"), F.col("human").isNotNull().alias("human_verified"),
        F.coalesce(F.col("human") != F.col("label"), F.lit(False)).alias("human_corrected"),
    )


@query(f"SELECT v.row_id AS row_id, c.human AS human, c.human IS NOT NULL AS verified FROM {V} v LEFT JOIN {_LAST} c ON v.paragraph_id = c.paragraph_id AND v.sentence_id = c.sentence_id AND c.k = 1")
def human_label_lookup(spark, d):
    both = rows_of(spark, d, V, "row_id", "paragraph_id", "sentence_id").join(last_review(spark, d), ["paragraph_id", "sentence_id"], "left")
    return both.select("row_id", "human", F.col("human").isNotNull().alias("verified"))


# Aggregates


@query(f"SELECT deepseek_label AS label, count(*) AS n FROM {V} WHERE deepseek_label IS NOT NULL GROUP BY 1")
def label_dist(spark, d):
    return rows_of(spark, d, V, F.col("deepseek_label").alias("label")).filter(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT l.label AS label, coalesce(c.n, 0)::BIGINT AS n, {R.rnd('coalesce(c.n, 0)::DOUBLE / nullif(sum(coalesce(c.n, 0)) OVER (), 0)')} AS share FROM (SELECT unnest({R.array((*L.LABELS, 'proverb'))}) AS label) l LEFT JOIN (SELECT deepseek_label AS label, count(*) AS n FROM {V} GROUP BY 1) c ON l.label = c.label")
def label_dist_fixed(spark, d):
    labels = spark.createDataFrame([(x,) for x in (*L.LABELS, "proverb")], "label string")
    n = F.coalesce("n", F.lit(0))
    return labels.join(label_dist(spark, d), "label", "left").select("label", n.alias("n"), X.round_at(n / F.nullif(F.sum(n).over(Window.partitionBy(F.lit(1))), F.lit(0))).alias("share"))


@query(f"SELECT source_file, label, count(*) AS n FROM {G} WHERE source_file IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2")
def label_by_source(spark, d):
    return rows_of(spark, d, G, "source_file", "label").dropna().groupBy("source_file", "label").agg(F.count("*").alias("n"))


@query(f"SELECT count(text) AS texts, sum(length(text))::BIGINT AS chars, median(length(text))::DOUBLE AS median_chars, {R.rnd(f'sum({R.blank_words("text")})::DOUBLE / nullif(count(text), 0)')} AS mean_words FROM {D}")
def derived_stats(spark, d):
    t = F.col("text")
    return rows_of(spark, d, D, "text").agg(F.count(t).alias("texts"), F.sum(F.length(t)).alias("chars"), F.median(F.length(t)).alias("median_chars"), X.round_at(F.sum(F.when(t.isNotNull(), X.blank_words(t))) / F.nullif(F.count(t), F.lit(0))).alias("mean_words"))


@query(f"SELECT source, {R.rnd('sum(length(text))::DOUBLE / nullif(count(text), 0)', 1)} AS mean_chars, {R.rnd('sum(len(string_split(text, chr(10))))::DOUBLE / nullif(count(text), 0)', 1)} AS mean_lines FROM {D} WHERE source IS NOT NULL GROUP BY source")
def per_source_means(spark, d):
    t = F.col("text")
    per = rows_of(spark, d, D, "source", "text").filter(F.col("source").isNotNull()).groupBy("source")
    return per.agg(X.round_at(F.sum(F.length(t)) / F.nullif(F.count(t), F.lit(0)), 1).alias("mean_chars"), X.round_at(F.sum(F.when(t.isNotNull(), F.size(F.split(t, "\n")))) / F.nullif(F.count(t), F.lit(0)), 1).alias("mean_lines"))


@query(f"SELECT count(DISTINCT w) AS types, count(*) AS tokens, {R.rnd('count(DISTINCT w)::DOUBLE / nullif(count(*), 0)')} AS ttr FROM (SELECT unnest({R.words('text_cree')}) AS w FROM {S} WHERE text_cree IS NOT NULL)")
def vocab_ttr(spark, d):
    words = rows_of(spark, d, S, "text_cree").dropna().select(F.explode(X.words(F.col("text_cree"))).alias("w"))
    # Two levels, so that the distinct count is pre-aggregated word by word.
    per = words.groupBy("w").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), X.round_at(F.count("*") / F.nullif(F.sum("n"), F.lit(0))).alias("ttr"))


_MARKS = ".,!?;:\"''()[]“”‘’«»—–-"


@query(f"SELECT count(DISTINCT trim(w, '{_MARKS}')) AS types FROM (SELECT unnest(regexp_split_to_array(trim(lower(text_en), '{_MARKS}'), '{R.WS}+')) AS w FROM {S} WHERE text_en IS NOT NULL)")
def vocab_stripped(spark, d):
    return rows_of(spark, d, S, "text_en").dropna().select(F.explode(X.words_of(F.col("text_en"))).alias("w")).distinct().agg(F.count("*").alias("types"))


@query(f"SELECT greatest(quantile_cont(length(text_cree), 0.99), quantile_cont(length(text_en), 0.99))::DOUBLE AS p99 FROM {S}")
def p99_bounds(spark, d):
    return rows_of(spark, d, S, "text_cree", "text_en").agg(F.greatest(F.percentile(F.length("text_cree"), F.lit(0.99)), F.percentile(F.length("text_en"), F.lit(0.99))).alias("p99"))


@query(f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY lower(text_cree) ORDER BY row_id) AS k FROM {V} WHERE text_cree IS NOT NULL) WHERE k = 1")
def pair_dedup_ci(spark, d):
    rows = rows_of(spark, d, V, "row_id", "text_cree").filter(F.col("text_cree").isNotNull())
    return rows.groupBy(F.lower("text_cree").alias("k")).agg(F.min("row_id").alias("row_id")).select("row_id")


@query("SELECT l_orderkey, CASE WHEN sum((l_returnflag = 'R')::INTEGER) >= 2 THEN 'metaphor' ELSE 'literal' END AS label FROM lineitem GROUP BY l_orderkey")
def token_to_sentence_label(spark, d):
    hits = F.sum((F.col("l_returnflag") == "R").cast("int"))
    return rows_of(spark, d, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.when(hits >= 2, "metaphor").otherwise("literal").alias("label"))


@query(f"SELECT source_file, paragraph_num, string_agg('[' || row_id || '] ' || footnote_en, chr(10) ORDER BY row_id) AS notes FROM {P} WHERE source_file IS NOT NULL AND footnote_en IS NOT NULL AND paragraph_num IS NOT NULL GROUP BY source_file, paragraph_num")
def ordered_notes(spark, d):
    rows = rows_of(spark, d, P, "source_file", "paragraph_num", "row_id", "footnote_en").dropna()
    notes = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "footnote_en"))), lambda x: F.concat(F.lit("["), x["row_id"].cast("string"), F.lit("] "), x["footnote_en"]))
    return rows.groupBy("source_file", "paragraph_num").agg(F.array_join(notes, "\n").alias("notes"))


@query(f"SELECT label, count(*) AS n, {R.rnd('sum(count(*)) OVER ()::DOUBLE / (4 * count(*))')} AS weight FROM {G} WHERE label IS NOT NULL GROUP BY label")
def class_weights(spark, d):
    return metrics.class_weights(rows_of(spark, d, G, "label"), "label")


@query(f"SELECT row_id, {R.rnd('1.0::DOUBLE / count(*) OVER (PARTITION BY label)', 8)} AS weight FROM {G} WHERE label IS NOT NULL")
def row_weights(spark, d):
    g = rows_of(spark, d, G, "row_id", "label").filter(F.col("label").isNotNull())
    sizes = g.groupBy("label").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(sizes), "label").select("row_id", X.round_at(1 / F.col("n"), 8).alias("weight"))


@query(f"SELECT coalesce(max(paragraph_id) + 1, 0)::BIGINT AS next_id FROM {S}")
def next_surrogate(spark, d):
    return rows_of(spark, d, S, "paragraph_id").agg(F.coalesce(F.max("paragraph_id") + 1, F.lit(0)).alias("next_id"))


_PAIRS = f"(SELECT model AS t, human AS p FROM {_LAST} WHERE k = 1)"


def review_counts(spark, d):
    return metrics.confusion(last_review(spark, d), "model", "human")


@query(f"SELECT t, p, count(*) AS n FROM {_PAIRS} GROUP BY t, p")
def confusion_long(spark, d):
    return review_counts(spark, d)


@query(f"WITH r AS (SELECT t, sum((t = p)::INTEGER)::DOUBLE / count(*) AS rate FROM {_PAIRS} GROUP BY t), s AS (SELECT deepseek_label AS t, count(*) AS n FROM {V} GROUP BY 1) SELECT {R.rnd('sum(rate * n) / sum(n)')} AS weighted_rate FROM r JOIN s USING (t)")
def weighted_agreement(spark, d):
    rates = review_counts(spark, d).groupBy(F.col("t").alias("label")).agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))
    return metrics.weighted_agreement(rates, label_dist(spark, d), "label").select(X.round_at(F.col("weighted_rate")).alias("weighted_rate"))


_SOURCES = ("edtekla", "bloomfield_1930", "okimasis", "ojibwe", "(all)")


@query(f"""SELECT l.source AS source, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT unnest({R.array(_SOURCES)}) AS source) l LEFT JOIN (SELECT source_file AS source, count(*) AS n FROM {S} WHERE source_file IS NOT NULL GROUP BY 1 UNION ALL SELECT '(all)', count(*) FROM {S}) c ON l.source = c.source""")
def source_counts(spark, d):
    rolled = rows_of(spark, d, S, "source_file").groupBy("source_file").agg(F.count("*").alias("n"))
    total = rolled.agg(F.lit("(all)").alias("source"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    counts = rolled.filter(F.col("source_file").isNotNull()).select(F.col("source_file").alias("source"), "n").unionByName(total)
    return spark.createDataFrame([(x,) for x in _SOURCES], "source string").join(counts, "source", "left").fillna(0, ["n"])


@query(f"SELECT w, count(*) AS n FROM (SELECT row_id, unnest({R.words('text_en')}) AS w FROM {S} WHERE text_en IS NOT NULL) GROUP BY w ORDER BY n DESC, min(row_id), w LIMIT 15")
def top_words(spark, d):
    words = rows_of(spark, d, S, "row_id", "text_en").filter(F.col("text_en").isNotNull()).select("row_id", F.explode(X.words(F.col("text_en"))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n"), F.min("row_id").alias("f")).orderBy(F.desc("n"), "f", "w").limit(15).select("w", "n")


@query(f"SELECT label, row_id, text_en FROM (SELECT label, row_id, text_en, row_number() OVER (PARTITION BY label ORDER BY row_id) AS k FROM {G} WHERE label IS NOT NULL) WHERE k = 1")
def first_per_label(spark, d):
    g = rows_of(spark, d, G, "label", "row_id", "text_en").filter(F.col("label").isNotNull())
    return g.groupBy("label").agg(F.min_by(F.struct("row_id", "text_en"), "row_id").alias("f")).select("label", "f.row_id", "f.text_en")


# Ordinals, surrogates


@query(f"SELECT row_id, row_number() OVER (PARTITION BY paragraph_num ORDER BY row_id) - 1 AS idx FROM {P}")
def ordinal_group(spark, d):
    return rows_of(spark, d, P, "row_id", "paragraph_num").withColumn("idx", (F.row_number().over(Window.partitionBy("paragraph_num").orderBy("row_id")) - 1).cast("bigint")).select("row_id", "idx")


@query(f"SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS ord FROM {P}")
def ordinal_global(spark, d):
    return pool.ordinals(rows_of(spark, d, P, "row_id"), "row_id", "ord")


_NEW = f"(SELECT row_id, {R.strip('text_cree')} AS k FROM {P})"
_OLD = f"(SELECT DISTINCT {R.strip('text_cree')} AS k FROM {V} WHERE text_cree IS NOT NULL)"
_BASE = f"(SELECT coalesce(max(paragraph_id) + 1, 0) FROM {S})"


@query(f"SELECT row_id, surrogate FROM (SELECT row_id, k, {_BASE} + row_number() OVER (ORDER BY row_id) - 1 AS surrogate FROM {_NEW}) WHERE k IS NULL OR k NOT IN (SELECT k FROM {_OLD})")
def surrogate_per_input(spark, d):
    base = pool.next_id(rows_of(spark, d, S, "paragraph_id"), "paragraph_id")
    numbered = pool.ordinals(rows_of(spark, d, P, "row_id", "text_cree"), "row_id", "surrogate", base)
    return pool.without(numbered, table(spark, d, V), ["text_cree"], stripped=True).select("row_id", "surrogate")


@query(f"SELECT row_id, {_BASE} + row_number() OVER (ORDER BY row_id) - 1 AS surrogate FROM {_NEW} WHERE k IS NULL OR k NOT IN (SELECT k FROM {_OLD})")
def surrogate_per_accepted(spark, d):
    base = pool.next_id(rows_of(spark, d, S, "paragraph_id"), "paragraph_id")
    kept = pool.without(rows_of(spark, d, P, "row_id", "text_cree"), table(spark, d, V), ["text_cree"], stripped=True)
    return pool.ordinals(kept.select("row_id"), "row_id", "surrogate", base)


# Top rows


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def best_run(spark, d):
    return rows_of(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
def best_run_filtered(spark, d):
    o = rows_of(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus").filter(F.col("o_orderstatus").isin("F", "O"))
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice"))


@query(f"SELECT left(source, 45) AS source, n FROM (SELECT source, count(*) AS n FROM {D} WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 20) ORDER BY n, source")
def top20_sources(spark, d):
    top = rows_of(spark, d, D, "source").dropna().groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(20)
    return top.select(F.left("source", F.lit(45)).alias("source"), "n").orderBy("n", "source")


@query(f"SELECT row_id FROM {V} ORDER BY {R.draw('row_id')} DESC, row_id DESC LIMIT 300")
def holdout_tail(spark, d):
    return rows_of(spark, d, V, "row_id").orderBy(X.draw(F.col("row_id")).desc(), F.desc("row_id")).limit(300)


@query(f"SELECT paragraph_id, string_agg(text_en, ' ' ORDER BY sentence_id, row_id) AS body FROM {S} WHERE text_en IS NOT NULL GROUP BY paragraph_id")
def sort_within_paragraph(spark, d):
    rows = rows_of(spark, d, S, "paragraph_id", "sentence_id", "row_id", "text_en").filter(F.col("text_en").isNotNull())
    return rows.groupBy("paragraph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", "row_id", "text_en"))), lambda x: x["text_en"]), " ").alias("body"))


@query("SELECT l_orderkey, arg_min(l_linenumber, (-l_quantity, l_linenumber)) AS best_epoch FROM lineitem GROUP BY l_orderkey")
def best_epoch(spark, d):
    return rows_of(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(-F.col("l_quantity"), "l_linenumber")).alias("best_epoch"))


# Unions


@query(f"""SELECT text_cree, text_en, 'pool' AS source FROM {S} UNION ALL SELECT text_cree, text_en, 'silver' FROM {V} UNION ALL SELECT text_cree, text_en, 'gold' FROM {G}""")
def union_sources(spark, d):
    cols = ["text_cree", "text_en"]
    empty = spark.createDataFrame([], "text_cree string, text_en string")
    return pool.union_sources({"pool": rows_of(spark, d, S, *cols), "silver": rows_of(spark, d, V, *cols), "gold": rows_of(spark, d, G, *cols), "none": empty}, cols)


@query(f"SELECT row_id, text_cree, coalesce(confidence, 1.0) AS confidence, coalesce(source_file, 'bloomfield_1934') AS source_file FROM {S} UNION ALL SELECT row_id, text_cree, 1.0, coalesce(source_file, 'bloomfield_1934') FROM {P}")
def pool_append(spark, d):
    new = rows_of(spark, d, P, "row_id", "text_cree", "source_file")
    return pool.append(rows_of(spark, d, S, "row_id", "text_cree", "confidence", "source_file"), new, {"confidence": 1.0, "source_file": "bloomfield_1934"})


@query(f"SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (PARTITION BY {R.strip('text_cree')} ORDER BY r, row_id) AS k FROM (SELECT row_id, text_cree, label, 0 AS r FROM {G} WHERE text_cree IS NOT NULL UNION ALL SELECT row_id, text_cree, deepseek_label, 1 FROM {V} WHERE text_cree IS NOT NULL)) WHERE k = 1")
def gold_wins_union(spark, d):
    g = rows_of(spark, d, G, "row_id", "text_cree", "label").filter(F.col("text_cree").isNotNull())
    v = rows_of(spark, d, V, "row_id", "text_cree", F.col("deepseek_label").alias("label")).filter(F.col("text_cree").isNotNull())
    return pool.gold_first(g, v, "text_cree", "row_id").select("row_id", "label")


@query(f"SELECT row_id FROM (SELECT row_id, k, row_number() OVER (PARTITION BY k ORDER BY row_id) AS rn FROM {_NEW} WHERE k IS NOT NULL) WHERE rn = 1 AND k NOT IN (SELECT k FROM {_OLD}) AND k NOT IN (SELECT {R.strip('text_cree')} FROM {S} WHERE text_cree IS NOT NULL)")
def append_unknown(spark, d):
    known = rows_of(spark, d, V, "text_cree").union(rows_of(spark, d, S, "text_cree"))
    new = rows_of(spark, d, P, "row_id", "text_cree").filter(F.col("text_cree").isNotNull()).withColumn("text_cree", X.strip(F.col("text_cree")))
    kept = pool.without(new, known, ["text_cree"], stripped=True)
    return kept.groupBy("text_cree").agg(F.min("row_id").alias("row_id")).select("row_id")


@query(f"SELECT row_id, 'figure' AS part, text_cree AS text FROM {V} UNION ALL SELECT row_id, 'literal', text_en FROM {V}")
def interleaved_pairs(spark, d):
    both = F.explode(F.array(F.struct(F.lit("figure").alias("part"), F.col("text_cree").alias("text")), F.struct(F.lit("literal").alias("part"), F.col("text_en").alias("text"))))
    return rows_of(spark, d, V, "row_id", "text_cree", "text_en").select("row_id", both.alias("x")).select("row_id", "x.part", "x.text")


# Incremental


@query(f"SELECT event_type, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'click') WHERE k = 1")
def cache_version_filter(spark, d):
    log = rows_of(spark, d, "events", "event_id", "ts", "user_id", "value", F.col("event_type").alias("prompt_version"))
    return incremental.cache_current(log, "user_id", ["ts", "event_id"], "click").select(F.col("prompt_version").alias("event_type"), "user_id", "value")


@query(f"SELECT row_id, 'pool' AS origin FROM {P} WHERE row_id NOT IN (SELECT row_id FROM {G}) UNION ALL SELECT row_id, 'gold' FROM {G}")
def upsert_by_key(spark, d):
    old = rows_of(spark, d, P, "row_id").withColumn("origin", F.lit("pool"))
    return pool.upsert(old, rows_of(spark, d, G, "row_id").withColumn("origin", F.lit("gold")), ["row_id"])


_SCORED = f"(SELECT row_id, text_cree, CASE WHEN regexp_matches(lower('Cree sentence  : ' || text_cree || chr(10) || 'English gloss  : ' || coalesce(text_en, '')), 'like|as if|tâpiskôc') THEN 'simile' ELSE 'literal' END AS label FROM {G} WHERE text_cree IS NOT NULL)"


@query(f"SELECT row_id, label FROM {_SCORED}")
def incremental_labels(spark, d):
    rows = rows_of(spark, d, G, "row_id", "text_cree", "text_en").filter(F.col("text_cree").isNotNull()).withColumn("prompt", incremental.prompt())
    cache = spark.createDataFrame([], "row_id bigint, label string, reasoning string, prompt_version string")
    done = incremental.resume(rows, cache, "row_id", "prompt", "v1")
    return incremental.joined_back(rows, done, "row_id").select("row_id", "label")


_FLAG = POOL_SQL % " AND source_file IS DISTINCT FROM 'edtekla'"


@query(f"""SELECT coalesce(label, 'none') AS label, count(*) AS sentences FROM (SELECT paragraph_id, sentence_id, unnest({R.sentences('text_en')}) AS s FROM ({_FLAG})) p
LEFT JOIN (SELECT paragraph_id, sentence_id, {R.strict('label')} AS label FROM (SELECT *, row_number() OVER (PARTITION BY paragraph_id, sentence_id ORDER BY row_id) AS k FROM {G} WHERE label IS NOT NULL) WHERE k = 1) l
USING (paragraph_id, sentence_id) WHERE length(s) >= 20 GROUP BY 1""")
def flagship(spark, d):
    loaded = pool.load_pool(rows_of(spark, d, S, "row_id", "paragraph_id", "sentence_id", "source_file", "text_cree", "text_en"), exclude_source="edtekla")
    sents = loaded.select("paragraph_id", "sentence_id", F.explode(X.sentences_kept(F.col("text_en"))).alias("s")).filter(F.length("s") >= 20)
    labels = pool.first_wins(rows_of(spark, d, G, "row_id", "paragraph_id", "sentence_id", "label").filter(F.col("label").isNotNull()), ["paragraph_id", "sentence_id"], ["row_id"])
    joined = sents.join(labels.select("paragraph_id", "sentence_id", L.strict(F.col("label")).alias("label")), ["paragraph_id", "sentence_id"], "left")
    return joined.groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(F.count("*").alias("sentences"))


@query(f"""WITH v AS (SELECT 'tokens' AS part, CAST(l_orderkey AS VARCHAR) AS key, CASE WHEN sum((l_returnflag = 'R')::INTEGER) >= 2 THEN 'metaphor' ELSE 'literal' END AS label FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'pairs', row_id || ' figure', deepseek_label FROM {V} WHERE deepseek_label IS NOT NULL UNION ALL SELECT 'pairs', row_id || ' literal', 'literal' FROM {V} WHERE deepseek_label IS NOT NULL),
c AS (SELECT label, key, part, row_number() OVER (PARTITION BY label ORDER BY {R.draw("part || ' ' || key")}, part || ' ' || key) AS rn FROM v)
SELECT part, key, label FROM c WHERE label <> 'literal' OR rn <= 3 * (SELECT count(*) FROM v WHERE label = 'metaphor')""")
def teacher_dataset(spark, d):
    tokens = token_to_sentence_label(spark, d).select(F.lit("tokens").alias("part"), F.col("l_orderkey").cast("string").alias("key"), "label")
    silver = rows_of(spark, d, V, "row_id", "deepseek_label").filter(F.col("deepseek_label").isNotNull())
    halves = F.explode(F.array(F.struct(F.lit("figure").alias("h"), F.col("deepseek_label").alias("label")), F.struct(F.lit("literal").alias("h"), F.lit("literal").alias("label"))))
    pairs = silver.select("row_id", halves.alias("x")).select(F.lit("pairs").alias("part"), F.concat(F.col("row_id").cast("string"), F.lit(" "), "x.h").alias("key"), "x.label")
    both = tokens.unionByName(pairs).withColumn("id", F.concat_ws(" ", "part", "key"))
    most = both.filter(F.col("label") == "metaphor").agg((F.count("*") * 3).alias("most"))
    literal = sample.ranked(both.filter(F.col("label") == "literal"), "id", 42).join(F.broadcast(most)).filter(F.col("rn") <= F.col("most"))
    return both.filter(F.col("label") != "literal").unionByName(literal.select(*both.columns)).select("part", "key", "label")
