"""Queries over sources, sinks, runs and reports; files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.functions import text as X
from glossmill.operators import pool, sample, steps
from glossmill.plans import registry as R
from glossmill.plans.registry import query
from glossmill.session import scratch, table
from glossmill.sources import io

S, D, G, V, P = "bloomfield_texts_sentences", "documents", "bloomfield_annotated", "deepseek_labels", "bloomfield_texts"


@query(f"SELECT paragraph_id, (k + sentence_id)::INTEGER AS sentence_num, label, footnote_applies, rationale FROM {G}, (SELECT unnest([0, 1]) AS k) WHERE paragraph_id IS NOT NULL AND sentence_id IS NOT NULL AND label IS NOT NULL AND rationale IS NOT NULL")
def paragraph_cache(spark, d):
    """A log of paragraphs with nested annotations."""
    rows = table(spark, d, G).dropna(subset=["paragraph_id", "sentence_id", "label", "rationale"])
    note = lambda k: F.struct((F.col("sentence_id") + k).cast("int").alias("sentence_num"), "label", "footnote_applies", "rationale")
    path = scratch(spark)
    io.append_log(rows.select("paragraph_id", F.array(note(0), note(1)).alias("annotations")), path)
    return io.read_log(spark, path, "paragraph_cache").select("paragraph_id", F.inline("annotations"))


@query("SELECT paragraph_id, sentence_id, count(*) AS lines, max(human_label) AS human_label FROM silver_verification_cache WHERE paragraph_id IS NOT NULL AND sentence_id IS NOT NULL GROUP BY paragraph_id, sentence_id")
def review_log(spark, d):
    """A log keyed by paragraph and sentence, appended to twice, with a broken and a blank line that are dropped."""
    rows = table(spark, d, "silver_verification_cache").select("paragraph_id", "sentence_id", "deepseek_label", "human_label", "note", (X.draw(F.col("paragraph_id")) % 2).alias("half"))
    path = scratch(spark)
    for half in (0, 1):
        io.append_log(rows.filter(F.coalesce("half", F.lit(0)) == half).drop("half"), path)
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(path)
    log = io.read_log(spark, path, "review_log").dropna(subset=["paragraph_id", "sentence_id"])
    return log.groupBy("paragraph_id", "sentence_id").agg(F.count("*").alias("lines"), F.max("human_label").alias("human_label"))


@query(f"SELECT row_id, label_raw FROM {G}")
def tab_rows(spark, d):
    """S06."""
    path = scratch(spark)
    table(spark, d, G).select("row_id", "label_raw").write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return io.read_tabs(spark, path).select(F.col("row_id").cast("bigint").alias("row_id"), "label_raw")


@query(f"SELECT lang, (sum(length(text)) + count(*))::BIGINT AS chars FROM {D} WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY lang")
def whole_files(spark, d):
    """Whole text files, one row each."""
    path = scratch(spark)
    table(spark, d, D).dropna(subset=["text", "lang"]).select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    found = io.read_whole(spark, path).select(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), F.length("value").alias("n"))
    return found.groupBy("lang").agg(F.sum("n").cast("bigint").alias("chars"))


@query(f"SELECT doc_id, CASE WHEN h = '' THEN text ELSE substr(text, strpos(text, h)) END AS body FROM (SELECT doc_id, text, regexp_extract(text, '[A-Z][a-z]+[?]') AS h FROM {D} WHERE text IS NOT NULL)")
def front_matter(spark, d):
    """S12."""
    return table(spark, d, D).filter(F.col("text").isNotNull()).select("doc_id", X.after_front(F.col("text"), "[A-Z][a-z]+[?]").alias("body"))


@query(f"SELECT 'here' AS source, count(*) AS n FROM {G} UNION ALL SELECT 'missing', 0")
def missing_source(spark, d):
    """A source that is not there gives an empty table of its schema."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
    return count(io.try_read(spark, f"{d}/{G}.parquet", "row_id bigint"), "here").unionByName(count(io.try_read(spark, scratch(spark), "row_id bigint"), "missing"))


@query(f"SELECT text_cree, {R.merged('label_raw')} AS label FROM {G} WHERE text_cree IS NOT NULL UNION ALL SELECT text_cree, {R.merged('deepseek_label')} FROM {V} WHERE text_cree IS NOT NULL")
def eval_file_override(spark, d):
    """An evaluation file in place of the default, and the default."""
    gold, silver = table(spark, d, G), table(spark, d, V)
    return io.eval_rows(spark, f"{d}/{G}.parquet", silver, "label_raw").unionByName(io.eval_rows(spark, None, silver, "deepseek_label").select(*gold.select("text_cree", "label").columns))


_FIRST = "entries[1].definitions[1]"
_WORDS = f"(SELECT token, {R.strip('token')} AS src, {R.strip(_FIRST)} AS tgt FROM dictionary WHERE len(entries) > 0 AND len(entries[1].definitions) > 0 AND {R.strip('token')} <> '' AND {R.strip(_FIRST)} <> '')"


@query(f"SELECT 'words' AS label, src, tgt, NULL::VARCHAR AS error FROM {_WORDS} UNION ALL SELECT 'gone', NULL, NULL, 'AnalysisException'")
def pair_manifest(spark, d):
    """File pairs of a manifest, one of which is not there. The dictionary is a resource of fixed size, so a file holds it whole."""
    first = F.get(F.get("entries", F.lit(0))["definitions"], F.lit(0))
    rows = table(spark, d, "dictionary").select("token", X.strip(F.col("token")).alias("src"), X.strip(first).alias("tgt")).filter((F.col("src") != "") & (F.col("tgt") != "")).orderBy("token")
    paths = [scratch(spark) for _ in range(3)]
    for path, column in zip(paths, ("src", "tgt"), strict=False):
        rows.coalesce(1).sortWithinPartitions("token").select(F.col(column).alias("value")).write.text(path)
    pairs, report = io.read_manifest(spark, [(paths[0], paths[1], "words"), (paths[2], paths[1], "gone")])
    failed = spark.createDataFrame([r for r in report if r[2]], "label string, n bigint, error string").select("label", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("tgt"), "error")
    return pairs.withColumn("error", F.lit(None).cast("string")).unionByName(failed)


@query(f"SELECT row_id, upper(deepseek_label) AS label FROM {V}")
def overwritten_table(spark, d):
    """A table overwritten by what is read from it."""
    path = scratch(spark)
    table(spark, d, V).select("row_id", F.col("deepseek_label").alias("label")).write.parquet(path)
    io.overwrite(spark.read.parquet(path).withColumn("label", F.upper("label")), path)
    return spark.read.parquet(path)


@query(f"SELECT row_id, label, 'first' AS run FROM {G} UNION ALL SELECT NULL, NULL, 'refused'")
def guarded_update(spark, d):
    """An update after a backup; a second one is refused."""
    path, backup = scratch(spark), scratch(spark)
    table(spark, d, G).select("row_id", "label").write.parquet(path)
    first = io.guarded(spark, path, backup).withColumn("run", F.lit("first"))
    try:
        io.guarded(spark, path, backup)
        refused = []
    except FileExistsError:
        refused = [(None, None, "refused")]
    return first.unionByName(spark.createDataFrame(refused, first.schema))


@query(f"SELECT 'kept' AS outcome, count(*) AS n FROM {G} UNION ALL SELECT 'missing columns: nothing, nowhere', 0")
def required_columns(spark, d):
    """P19."""
    gold = table(spark, d, G)
    try:
        pool.require(gold, ["row_id", "nothing", "nowhere"])
        said = ""
    except ValueError as problem:
        said = str(problem)
    return pool.require(gold, ["row_id", "label"]).agg(F.count("*").alias("n")).select(F.lit("kept").alias("outcome"), "n").unionByName(spark.createDataFrame([(said, 0)], "outcome string, n bigint"))


@query(f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY label ORDER BY {R.draw('row_id', 1)}, row_id) AS rn FROM {G} WHERE label IS NOT NULL) WHERE rn <= 20")
def persisted_sample(spark, d):
    """A sample that is drawn once; asking again with another seed gives the first."""
    rows, path = table(spark, d, G).select("row_id", "label").filter(F.col("label").isNotNull()), scratch(spark)
    io.drawn_once(sample.per_class(rows, "row_id", "label", 20, seed=1).select("row_id"), path)
    return io.drawn_once(sample.per_class(rows, "row_id", "label", 20, seed=2).select("row_id"), path)


@query(f"SELECT replace(replace(replace(m, '/', '_'), ':', '_'), '.', 'p') AS model, row_id, deepseek_label AS label FROM {V}, (SELECT unnest(['org/model:1.5', 'other']) AS m) WHERE row_id % 2 = CASE WHEN m = 'other' THEN 1 ELSE 0 END")
def outputs_by_model(spark, d):
    """Outputs of several models, each in a folder of its own, read as one table."""
    rows, path = table(spark, d, V).select("row_id", F.col("deepseek_label").alias("label")), scratch(spark)
    for i, name in enumerate(("org/model:1.5", "other")):
        io.write_by(rows.filter(F.col("row_id") % 2 == i).withColumn("model", X.slug(F.lit(name))), path)
    return spark.read.parquet(path).select(F.col("model").cast("string").alias("model"), "row_id", "label")


_LINE = "CASE WHEN row_id % 2 = 0 THEN 'API_KEY= ' || coalesce(label_raw, '') || '=x ' ELSE 'OTHER_API_KEY=1' END"


@query(f"SELECT row_id, CASE WHEN starts_with(line, 'API_KEY=') THEN {R.strip('substr(line, 9)')} END AS value FROM (SELECT row_id, {_LINE} AS line FROM {G})")
def env_lines(spark, d):
    """X24."""
    line = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("API_KEY= "), F.coalesce("label_raw", F.lit("")), F.lit("=x "))).otherwise("OTHER_API_KEY=1")
    return table(spark, d, G).select("row_id", X.env_value(line, "API_KEY").alias("value"))


@query(f"SELECT doc_id, CASE WHEN length(text) - length(replace(text, ' when ', '')) = 6 THEN replace(text, ' when ', ' at the time ') END AS text FROM {D}")
def marker_patch(spark, d):
    """X25."""
    return table(spark, d, D).select("doc_id", X.patched(F.col("text"), " when ", " at the time ").alias("text"))


@query(f"""SELECT row_id, array_to_string(list_transform(range(12), lambda i: CASE WHEN i < len(w) THEN length(w[i + 1]) ELSE 0 END), ' ') AS input_ids,
array_to_string(list_transform(range(12), lambda i: CASE WHEN i < len(w) THEN 1 ELSE 0 END), ' ') AS attention_mask FROM (SELECT row_id, {R.words('text_en')} AS w FROM {S} WHERE text_en IS NOT NULL)""")
def padded_ids(spark, d):
    """Arrays of one size; word lengths stand for ids."""
    rows = table(spark, d, S).filter(F.col("text_en").isNotNull()).select("row_id", X.padded(F.transform(X.words(F.col("text_en")), F.length), 12).alias("p"))
    return rows.select("row_id", *(F.array_join(F.col(f"p.{c}").cast("array<string>"), " ").alias(c) for c in ("input_ids", "attention_mask")))


_LR = "printf('%.2e', (o_orderkey % 997 + 0.123) / 1000000)"


@query(f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'pipeline' WHEN 'F' THEN 'calibrate' ELSE 'tlm' END AS stage,
CASE o_orderstatus WHEN 'O' THEN 'run --clkd-lr ' || {_LR} || ' --calibrate-epochs 3' WHEN 'F' THEN 'run --calibrate-lr ' || {_LR} || ' --literal-ratio 2' ELSE 'run --tlm-lr ' || {_LR} || ' --batch-size 8' END AS command FROM orders WHERE o_orderkey IS NOT NULL""")
def run_commands(spark, d):
    """Command lines of configurations."""
    lr = F.format_string("%.2e", (F.col("o_orderkey") % 997 + F.lit(0.123)) / 1000000)
    config = F.when(F.col("o_orderstatus") == "O", F.create_map(F.lit("calibrate_epochs"), F.lit("3"), F.lit("clkd_lr"), lr))
    config = config.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("literal_ratio"), F.lit("2"), F.lit("learning_rate"), lr)).otherwise(F.create_map(F.lit("learning_rate"), lr, F.lit("batch_size"), F.lit("8")))
    rows = table(spark, d, "orders").filter(F.col("o_orderkey").isNotNull()).select("o_orderkey", config.alias("config"))
    return rows.select("o_orderkey", steps.stage(F.col("config")).alias("stage"), steps.command(F.col("config")).alias("command"))


_RUNS = "(SELECT o_orderkey, 'run ' || o_orderkey AS name, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value FROM orders WHERE o_orderstatus IN ('F', 'P'))"


@query(f"SELECT name, 'run --tlm-epochs ' || (o_orderkey % 5) AS command, value, (SELECT count(*) FROM {_RUNS}) AS n_runs FROM {_RUNS} ORDER BY value DESC NULLS LAST, name LIMIT 1")
def best_sweep_run(spark, d):
    """The best run of a sweep and its command line."""
    o = table(spark, d, "orders").filter(F.col("o_orderkey").isNotNull())
    state = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "P", "crashed").otherwise("running")
    summary = F.create_map(F.lit("eval/macro_f1"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    runs = o.select(F.concat(F.lit("run "), F.col("o_orderkey").cast("string")).alias("name"), state.alias("state"), F.create_map(F.lit("epochs"), (F.col("o_orderkey") % 5).cast("string")).alias("config"), summary.alias("summary"))
    return steps.best_of(runs, "eval/macro_f1").select("name", steps.command(F.col("config")).alias("command"), "value", "n_runs")


@query("SELECT unnest([0, 1, 2, 3]) AS step, unnest(['count', 'broken', 'skipped', 'last']) AS name, unnest(['OK', 'FAILED', 'SKIPPED', 'OK']) AS status, unnest([NULL, 'ValueError', NULL, NULL]) AS error")
def step_report(spark, d):
    """E20."""
    gold = table(spark, d, G)
    return steps.run_steps(spark, [("count", gold.count), ("broken", lambda: pool.require(gold, ["x"])), ("skipped", lambda: 1 / 0), ("last", lambda: gold.select("label").distinct().count())], skip=("skipped",))


@query(f"SELECT row_id, {R.merged('label_raw')} AS label FROM {G} WHERE label_raw IS NOT NULL AND footnote_applies")
def staged_pipeline(spark, d):
    """Stages that leave tables behind; a stage that is skipped leaves its input in place, a table that is there is not made again."""
    paths = {name: scratch(spark) for name in ("load", "gate", "rename", "label")}
    from glossmill.functions import labels as L

    def read(*names):
        return next(spark.read.parquet(paths[n]) for n in names if io.exists(spark, paths[n]))

    report = steps.run_steps(
        spark,
        [
            ("load", lambda: io.local_or(spark, paths["load"], lambda: table(spark, d, G)).select("row_id", "label_raw", "footnote_applies").write.parquet(paths["load"])),
            ("gate", lambda: pool.gold_gate(read("load")).write.parquet(paths["gate"])),
            ("rename", lambda: read("gate").withColumnRenamed("label_raw", "x").write.parquet(paths["rename"])),
            ("label", lambda: read("rename", "gate").filter(F.col("label_raw").isNotNull()).select("row_id", L.merged(F.col("label_raw")).alias("label")).write.parquet(paths["label"])),
        ],
        skip=("rename",),
    )
    if report.filter("status = 'FAILED'").count():
        raise RuntimeError("a stage failed")
    return spark.read.parquet(paths["label"])


@query(f"SELECT text_cree, text_en, 'pool' AS source FROM {S} WHERE text_cree IS NOT NULL AND text_en IS NOT NULL UNION ALL SELECT text_cree, text_en, 'gold' FROM {G} WHERE text_cree IS NOT NULL AND text_en IS NOT NULL")
def corpus_build(spark, d):
    """A corpus of several sources, one of them skipped."""
    cols = ["text_cree", "text_en"]
    frames = {"pool": table(spark, d, S), "silver": table(spark, d, V), "gold": table(spark, d, G)}
    return pool.union_sources({k: v.dropna(subset=cols) for k, v in frames.items()}, cols, skip=("silver",))


_SHARE = lambda rel, key, section: f"SELECT '{section}' AS section, coalesce({key}, '(none)') AS key, {R.rnd(f'count(*)::DOUBLE * 100 / (SELECT count(*) FROM {rel})', 2)} AS value FROM {rel} GROUP BY {key}"


@query(f"""{_SHARE(V, 'deepseek_label', 'label share')} UNION ALL {_SHARE(S, 'source_file', 'source share')}
UNION ALL SELECT 'mean length', coalesce(deepseek_label, '(none)'), {R.rnd('avg(length(text_cree))', 2)} FROM {V} GROUP BY deepseek_label
UNION ALL SELECT 'vocabulary', 'cree', count(DISTINCT w)::DOUBLE FROM (SELECT unnest({R.words('text_cree')}) AS w FROM {V}) UNION ALL SELECT 'vocabulary', 'english', count(DISTINCT w)::DOUBLE FROM (SELECT unnest({R.words('text_en')}) AS w FROM {V})""")
def dataset_report(spark, d):
    """Label and source shares, mean lengths and vocabulary sizes as one long table."""
    v, s = table(spark, d, V), table(spark, d, S)

    def share(df, key, section):
        counts = df.groupBy(key).agg(F.count("*").alias("n"))
        whole = counts.agg(F.sum("n").alias("all"))
        return counts.join(F.broadcast(whole)).select(F.lit(section).alias("section"), F.coalesce(key, F.lit("(none)")).alias("key"), X.round_at(F.col("n").cast("double") * 100 / F.col("all"), 2).alias("value"))

    length = v.groupBy("deepseek_label").agg(X.round_at(F.avg(F.length("text_cree")), 2).alias("value")).select(F.lit("mean length").alias("section"), F.coalesce("deepseek_label", F.lit("(none)")).alias("key"), "value")
    out = share(v, "deepseek_label", "label share").unionByName(share(s, "source_file", "source share")).unionByName(length)
    for column, name in (("text_cree", "cree"), ("text_en", "english")):
        words = v.select(F.explode(X.words(F.col(column))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        out = out.unionByName(words.agg(F.count("*").cast("double").alias("value")).select(F.lit("vocabulary").alias("section"), F.lit(name).alias("key"), "value"))
    return out


_BOX = lambda c, i: R.rnd(f"quantile_cont({c}, {i})", 3)


@query(f"""WITH r AS (SELECT source_file, len({R.words('text_cree')}) AS c, len({R.words('text_en')}) AS e, len({R.sentences_bare('text_en')}) AS s FROM {P} WHERE text_cree IS NOT NULL AND text_en IS NOT NULL AND source_file IS NOT NULL)
SELECT source_file, count(*) AS paragraphs, {_BOX('c', 0.5)} AS median_cree, {_BOX('e', 0.5)} AS median_en, {_BOX('e', 0.25)} AS q1_en, {_BOX('e', 0.75)} AS q3_en, sum(s)::BIGINT AS sentences FROM r GROUP BY source_file""")
def figure_data(spark, d):
    """What the figures of lengths by text are drawn from."""
    rows = table(spark, d, P).dropna(subset=["text_cree", "text_en", "source_file"]).select("source_file", F.size(X.words(F.col("text_cree"))).alias("c"), F.size(X.words(F.col("text_en"))).alias("e"), F.size(X.sentences_bare(F.col("text_en"))).alias("s"))
    at = lambda c, q: X.round_at(F.percentile(c, F.lit(q)), 3)
    return rows.groupBy("source_file").agg(F.count("*").alias("paragraphs"), at("c", 0.5).alias("median_cree"), at("e", 0.5).alias("median_en"), at("e", 0.25).alias("q1_en"), at("e", 0.75).alias("q3_en"), F.sum("s").alias("sentences"))
