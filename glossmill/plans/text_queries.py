"""Queries over texts: loading, filters, scalar functions, parsing, HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.functions import labels as L
from glossmill.functions import text as X
from glossmill.operators import align, html, parse, pool
from glossmill.plans import registry as R
from glossmill.plans.registry import query
from glossmill.session import table
from glossmill.sources import io

S, D, P = "bloomfield_texts_sentences", "documents", "bloomfield_texts"
POOL_SQL = f"""SELECT row_id, paragraph_id, sentence_id, source_file, text_cree, text_en FROM (
  SELECT row_id, paragraph_id, sentence_id, source_file, {R.strip('text_cree')} AS text_cree, {R.strip('text_en')} AS text_en,
         row_number() OVER (PARTITION BY {R.strip('text_cree')} ORDER BY row_id) AS rn
  FROM {S} WHERE text_cree IS NOT NULL AND text_en IS NOT NULL%s) WHERE rn = 1"""
COLS = ["row_id", "paragraph_id", "sentence_id", "source_file", "text_cree", "text_en"]


def pool_of(spark, d):
    return table(spark, d, S).select(*COLS)


@query(POOL_SQL % "")
def pool_load(spark, d):
    return pool.load_pool(pool_of(spark, d))


@query(POOL_SQL % " AND source_file IS DISTINCT FROM 'edtekla'")
def pool_exclude_null_safe(spark, d):
    return pool.load_pool(pool_of(spark, d), exclude_source="edtekla")


@query((POOL_SQL % "") + " ORDER BY row_id LIMIT 250")
def pool_limit(spark, d):
    return pool.load_pool(pool_of(spark, d), limit=250)


_LINES = "SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) - 1 AS line_no FROM documents"


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, {R.strip("split_part(" + R.strip('line') + ", '|||', 1)")} AS src, {R.strip("substr(" + R.strip('line') + ", strpos(" + R.strip('line') + ", '|||') + 3)")} AS tgt FROM ({_LINES} WHERE lang = 'mul') WHERE contains(line, '|||')")
def pair_lines(spark, d):
    lines = parse.lines_of(table(spark, d, D).filter(F.col("lang") == "mul"), "doc_id", "text")
    return io.split_pairs(lines, "line", ("doc_id", "line_no")).withColumn("line_no", F.col("line_no").cast("bigint"))


@query(f"SELECT row_id, concat_ws(' ||| ', text_cree, text_en) AS value FROM {S} WHERE text_cree IS NOT NULL AND text_en IS NOT NULL")
def pair_text(spark, d):
    return pool_of(spark, d).dropna(subset=["text_cree", "text_en"]).select("row_id", io.pair_line("text_cree", "text_en").alias("value"))


@query(f"SELECT row_id FROM {S} WHERE length(text_cree) >= 60 AND length(text_en) >= 60")
def pair_min_len(spark, d):
    return pool.long_enough(pool_of(spark, d), 60).select("row_id")


@query(f"SELECT row_id, confidence FROM {S} WHERE confidence >= 0.9")
def pair_conf_filter(spark, d):
    return pool.confident(table(spark, d, S).select("row_id", "confidence"), 0.9)


@query("SELECT row_id, label FROM bloomfield_annotated WHERE footnote_applies")
def gold_gate(spark, d):
    return pool.gold_gate(table(spark, d, "bloomfield_annotated")).select("row_id", "label")


@query(f"SELECT row_id, footnote_en IS NOT NULL AND {R.strip('footnote_en')} <> '' AS has_footnote FROM {P}")
def footnote_flag(spark, d):
    return table(spark, d, P).select("row_id", (F.col("footnote_en").isNotNull() & (X.strip(F.col("footnote_en")) != "")).alias("has_footnote"))


@query(f"SELECT doc_id FROM {D} WHERE length(text) >= 20 AND {R.letters('text')}::DOUBLE / nullif(length(text), 0) >= 0.80 AND {R.blank_words('text')} >= 5")
def alpha_gate(spark, d):
    return table(spark, d, D).filter(X.real_paragraph(F.col("text"), 0.80)).select("doc_id")


def _ascii(x: str) -> str:
    word = "[\\p{L}\\p{N}_]+"
    return f"list_filter(regexp_extract_all(lower({x}), '{word}'), lambda w: regexp_full_match(w, '[a-z]+'))"


@query(f"""SELECT row_id FROM (SELECT row_id, text_en AS x, {_ascii('text_en')} AS w FROM {S} WHERE text_en IS NOT NULL)
WHERE length(x) >= 20 AND {R.letters('x')}::DOUBLE / nullif(length(x), 0) >= 0.45
AND NOT (len(w) >= 6 AND len(list_filter(w, lambda z: z IN {R.listed(X.NOTE_WORDS)})) >= 0.40::DOUBLE * len(w))""")
def stopword_gate(spark, d):
    return pool_of(spark, d).filter(F.col("text_en").isNotNull()).filter(X.cree_sentence(F.col("text_en"))).select("row_id")


@query(f"""SELECT doc_id, len(w) >= 5 AND len(list_filter(w, lambda z: z IN {R.listed(X.ENGLISH_WORDS)})) >= 0.30::DOUBLE * len(w) AS english
FROM (SELECT doc_id, {_ascii('text')} AS w FROM {D} WHERE text IS NOT NULL)""")
def english_paragraphs(spark, d):
    return table(spark, d, D).filter(F.col("text").isNotNull()).select("doc_id", X.english_paragraph(F.col("text")).alias("english"))


_B = "(^|[^\\p{L}\\p{N}_])"
_E = "([^\\p{L}\\p{N}_]|$)"


@query(f"""SELECT row_id FROM {S} WHERE length(text_cree) >= 5 AND regexp_matches(text_cree, '[āēīōĀĒĪŌ]')
AND NOT regexp_matches(text_cree, '{_B}[a-zāēīō]{{1,3}} [a-zāēīō]{{1,3}} [a-zāēīō]{{1,3}}{_E}') AND NOT regexp_matches(text_cree, '[+=]') AND NOT regexp_matches(text_cree, '\\([a-z]')
AND NOT regexp_matches(text_en, '(?i)\\b(subject|verb|object|noun|stem|suffix|prefix)\\b') AND NOT regexp_matches(text_en, '^\\d+\\.')
AND NOT regexp_matches(text_en, '(?i)(isbn|pm\\d{{3}}|\\d{{4}}-\\d{{4}}|edition\\.|new edition)') AND NOT regexp_matches(text_en, '^(Includes|As a result|Some changes|This edition)')
AND NOT regexp_matches(text_cree, '^Jean L\\.')""")
def noise_rules(spark, d):
    return pool_of(spark, d).filter(X.clean_example(F.col("text_cree"), F.col("text_en"))).select("row_id")


@query(f"SELECT row_id, source_file FROM {S} WHERE source_file = 'okimasis' ORDER BY row_id LIMIT 1")
def row_lookup(spark, d):
    return pool_of(spark, d).filter(F.col("source_file") == "okimasis").orderBy("row_id").limit(1).select("row_id", "source_file")


@query(f"SELECT row_id FROM {S} WHERE starts_with(source_file, 'bloomfield')")
def prefix_filter(spark, d):
    return pool_of(spark, d).filter(F.col("source_file").startswith("bloomfield")).select("row_id")


@query("SELECT paragraph_id, sentence_id, NULL::VARCHAR AS source_file, text_cree, text_en, deepseek_label AS label, deepseek_label AS label_raw, false AS footnote_applies, reasoning AS rationale, '' AS footnote_en FROM deepseek_labels")
def silver_as_gold(spark, d):
    return table(spark, d, "deepseek_labels").select(
        "paragraph_id", "sentence_id", F.lit(None).cast("string").alias("source_file"), "text_cree", "text_en", F.col("deepseek_label").alias("label"),
        F.col("deepseek_label").alias("label_raw"), F.lit(False).alias("footnote_applies"), F.col("reasoning").alias("rationale"), F.lit("").alias("footnote_en"),
    )


@query("SELECT paragraph_id, sentence_id, deepseek_label FROM deepseek_labels")
def existing_columns(spark, d):
    return pool.existing(table(spark, d, "deepseek_labels"), ["paragraph_id", "sentence_id", "source_file", "deepseek_label", "confidence"])


@query(f"SELECT row_id, text_cree, 'bloomfield_1934' AS source FROM {P} WHERE text_cree IS NOT NULL")
def provenance(spark, d):
    return table(spark, d, P).filter(F.col("text_cree").isNotNull()).select("row_id", "text_cree", F.lit("bloomfield_1934").alias("source"))


@query("SELECT paragraph_id, sentence_id, annotator, reviewed_at, human_label = deepseek_label AS agree FROM silver_verification_cache")
def agree_flag(spark, d):
    return table(spark, d, "silver_verification_cache").select("paragraph_id", "sentence_id", "annotator", "reviewed_at", (F.col("human_label") == F.col("deepseek_label")).alias("agree"))


@query(f"SELECT row_id, CASE WHEN text_en IS NULL THEN 'no English text' END AS error, CASE WHEN text_en IS NOT NULL THEN length(text_en) END::DOUBLE AS chars FROM {S} WHERE text_cree IS NOT NULL")
def error_rows(spark, d):
    rows = pool_of(spark, d).filter(F.col("text_cree").isNotNull())
    bad = F.col("text_en").isNull()
    return rows.select("row_id", F.when(bad, "no English text").alias("error"), F.when(~bad, F.length("text_en")).cast("double").alias("chars"))


@query("SELECT row_id FROM deepseek_labels WHERE deepseek_label IS NULL OR reasoning IS NULL")
def pending_rows(spark, d):
    return table(spark, d, "deepseek_labels").filter(F.col("deepseek_label").isNull() | F.col("reasoning").isNull()).select("row_id")


@query(f"SELECT row_id, coalesce(list_position({R.array(L.LABELS)}, label) - 1, 0)::INTEGER AS code FROM bloomfield_annotated")
def label_codes(spark, d):
    return table(spark, d, "bloomfield_annotated").select("row_id", L.code(F.col("label")).alias("code"))


@query("SELECT token, e.lemma AS lemma, e.pos AS pos, array_to_string(e.definitions, ' / ') AS definitions FROM (SELECT token, unnest(entries) AS e FROM dictionary)")
def nested_entries(spark, d):
    return table(spark, d, "dictionary").select("token", F.inline("entries")).select("token", "lemma", "pos", F.array_join("definitions", " / ").alias("definitions"))


# Scalar functions


@query(f"SELECT row_id, {R.strip('text_cree')} AS stripped, {R.collapse('text_en')} AS collapsed FROM {P}")
def strip_collapse(spark, d):
    return table(spark, d, P).select("row_id", X.strip(F.col("text_cree")).alias("stripped"), X.collapse(F.col("text_en")).alias("collapsed"))


@query(f"SELECT row_id, array_to_string({R.words('text_cree')}, ' ') AS words, len({R.words('text_en')})::INTEGER AS n_en FROM {S} WHERE text_cree IS NOT NULL AND text_en IS NOT NULL")
def word_tokens(spark, d):
    rows = pool_of(spark, d).dropna(subset=["text_cree", "text_en"])
    return rows.select("row_id", F.array_join(X.words(F.col("text_cree")), " ").alias("words"), F.size(X.words(F.col("text_en"))).alias("n_en"))


@query(f"SELECT row_id, array_to_string({R.sentences('text_en')}, chr(10)) AS sents FROM {P} WHERE text_en IS NOT NULL")
def sentence_split_v1(spark, d):
    return table(spark, d, P).filter(F.col("text_en").isNotNull()).select("row_id", F.array_join(X.sentences_kept(F.col("text_en")), "\n").alias("sents"))


@query(f"SELECT row_id, array_to_string({R.nonempty("list_transform(regexp_split_to_array(text_en, '[.!?]+'), lambda z: " + R.strip('z') + ")")}, chr(10)) AS sents FROM {P} WHERE text_en IS NOT NULL")
def sentence_split_v2(spark, d):
    return table(spark, d, P).filter(F.col("text_en").isNotNull()).select("row_id", F.array_join(X.sentences_bare(F.col("text_en")), "\n").alias("sents"))


_V3 = R.nonempty(f"list_transform(regexp_split_to_array({R.collapse('text_cree')}, '\\.{R.WS}+'), lambda z: {R.strip("trim(trim(" + R.strip('z') + ", '\"'), '''')")})")


@query(f"SELECT row_id, array_to_string(list_transform({_V3}, lambda z: CASE WHEN right(z, 1) IN ('.', '?', '!') THEN z ELSE z || '.' END), chr(10)) AS sents FROM {P} WHERE text_cree IS NOT NULL")
def sentence_split_v3(spark, d):
    return table(spark, d, P).filter(F.col("text_cree").isNotNull()).select("row_id", F.array_join(X.sentences_restored(F.col("text_cree")), "\n").alias("sents"))


_NOISE = (
    f"regexp_matches(ln, '^{R.WS}*\\d{{1,4}}{R.WS}*$|^{R.WS}*\\*{R.WS}*|^{R.WS}*\\d+{R.WS}+|^{R.WS}*[Ww]ord{R.WS}|^{R.WS}*[Oo]r{R.WS}+read|^{R.WS}*[Pp]robably{R.WS}|^{R.WS}*[Tt]ranslation{R.WS}|^{R.WS}*[Cc][Ff]\\.|^{R.WS}*[Ii]\\.e\\.|(?i:sacred\\s+stories|sweet\\s+grass\\s+cree|national\\s+museum|department\\s+of\\s+mines|anthropological\\s+ser)')"
)


@query(f"""SELECT doc_id, array_to_string(list_filter(ps, lambda p: len(list_filter(string_split(p, chr(10)), lambda ln: NOT {_NOISE})) > 0), '¶') AS paragraphs
FROM (SELECT doc_id, {R.nonempty("list_transform(regexp_split_to_array(text, chr(10) || '" + R.WS + "*' || chr(10)), lambda z: " + R.strip('z') + ")")} AS ps FROM {D} WHERE text IS NOT NULL)""")
def paragraph_split(spark, d):
    return table(spark, d, D).filter(F.col("text").isNotNull()).select("doc_id", F.array_join(X.paragraphs(F.col("text")), "¶").alias("paragraphs"))


@query(f"""SELECT doc_id, {R.collapse("regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda ln: NOT " + _NOISE + "), ' '), '\\^[\\p{L}\\p{N}_]?', '', 'g')")} AS body FROM {D} WHERE text IS NOT NULL""")
def line_denoise(spark, d):
    return table(spark, d, D).filter(F.col("text").isNotNull()).select("doc_id", X.denoised(F.col("text")).alias("body"))


_BLOCK = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^{R.WS}*\\p{{Nd}}+{R.WS}{{2,}}', '', 'g'), '  +', ' ', 'g'), '-{R.WS}*\\n{R.WS}*', '', 'g'), '{R.WS}*\\n{R.WS}*', ' ', 'g')"


@query(f"SELECT doc_id, {R.strip(_BLOCK)} AS body FROM {D} WHERE text IS NOT NULL")
def block_clean(spark, d):
    return table(spark, d, D).filter(F.col("text").isNotNull()).select("doc_id", X.block(F.col("text")).alias("body"))


@query(f"SELECT source, upper(regexp_replace({R.strip("regexp_replace(" + R.collapse("'  2. the  ' || source || ' . 17 '") + ", '\\d+\\s*$', '')")}, '\\.+$', '')) AS header FROM (SELECT DISTINCT source FROM {D})")
def header_keys(spark, d):
    return table(spark, d, D).select("source").distinct().select("source", X.header_key(F.concat(F.lit("  2. the  "), "source", F.lit(" . 17 "))).alias("header"))


@query(f"""SELECT row_id, array_to_string(list_transform(list_filter(list_zip(w, range(len(w))), lambda z: list_position(w, z[1]) = z[2] + 1), lambda z: z[1]), ' ') AS tokens FROM (
SELECT row_id, list_transform(list_filter(regexp_extract_all(text_cree, '[a-zA-ZâêîôÂÊÎÔāēīōĀĒĪŌ''ʼ\\-]+'), lambda t: length(t) >= 3 AND lower(t) NOT IN {R.listed(X.PARTICLES)}), lambda t: lower(t)) AS w FROM {S} WHERE text_cree IS NOT NULL)""")
def content_tokens(spark, d):
    return pool_of(spark, d).filter(F.col("text_cree").isNotNull()).select("row_id", F.array_join(X.content_tokens(F.col("text_cree")), " ").alias("tokens"))


@query("SELECT token, strip_accents(lower(token)) AS folded FROM dictionary")
def accent_fold(spark, d):
    return table(spark, d, "dictionary").select("token", X.unaccented(F.col("token")).alias("folded"))


_TOK = R.nonempty(f"regexp_split_to_array(text_cree, '{R.WS}+')")


@query(f"""SELECT row_id, CASE WHEN len(w) = 0 THEN false WHEN len(w) <= 3 THEN m >= 1 ELSE m >= 0.25::DOUBLE * len(w) END AS macron FROM (
SELECT row_id, w, len(list_filter(w, lambda z: regexp_matches(z, '[āēīōĀĒĪŌ]'))) AS m FROM (SELECT row_id, {_TOK} AS w FROM {S} WHERE text_cree IS NOT NULL))""")
def macron_dominant(spark, d):
    return pool_of(spark, d).filter(F.col("text_cree").isNotNull()).select("row_id", X.macron_dominant(F.col("text_cree")).alias("macron"))


@query(f"""SELECT row_id, {R.strip('text_cree')} AS cree, {R.strip('text_en')} AS en FROM {S} WHERE source_file = 'okimasis' AND text_cree IS NOT NULL AND text_en IS NOT NULL
AND regexp_matches(text_cree, '[āēīōĀĒĪŌ]') AND NOT regexp_matches(text_en, '[āēīōĀĒĪŌ]') AND length({R.strip('text_en')}) > 4 AND NOT contains(text_cree || text_en, '   ')""")
def inline_split(spark, d):
    rows = pool_of(spark, d).filter(F.col("source_file") == "okimasis").dropna(subset=["text_cree", "text_en"]).filter(~F.concat("text_cree", "text_en").contains("   "))
    return rows.select("row_id", X.inline_pair(F.concat("text_cree", F.lit("     "), "text_en")).alias("p")).filter(F.col("p").isNotNull()).select("row_id", "p.cree", "p.en")


_W = "regexp_extract_all(t, '[\\p{L}\\p{N}_]+')"
_OJI = "(len(regexp_extract_all(t, '[aeiou][\'\'][a-z]|[a-z][0-9]{1,2}[a-z]|[/\'\'\\\\][uia][/\\\\]|ugri|midac|misa|kaga|cigwa|anlc|mldac|ugrl|uglwab')) + len(list_filter(" + _W + ", lambda z: regexp_matches(z, '^(tc|dc)[a-z]'))))"
_ENG = "len(list_filter(" + _W + ", lambda z: lower(z) IN " + R.listed("the was and that had her him with this then they were have from upon when said told thus what where some did now one who verily therefore hither thereof".split()) + "))"
_CLASS = f"""CASE WHEN t = '' OR regexp_matches(t, '^[IVXLC]+$|^\\d+$') OR regexp_matches(t, '(?i)^(SERIES|PART|I\\s*[.—-]|II\\s*[.—-])') THEN 'meta'
WHEN regexp_matches(t, '^[A-Z\\s.,''\\-]{{3,60}}$') AND {R.blank_words('t')} <= 8 THEN 'meta'
WHEN regexp_matches(t, '(?i)^[ivxlc\\d]+\\.\\s+[A-Z][A-Z\\s,''\\-]{{4,}}[.\\d]*\\s*$') THEN 'header'
WHEN regexp_matches(t, '^\\d+\\s+\\S') AND length(t) < 300 THEN 'footnote'
WHEN {_OJI} = 0 AND {_ENG} = 0 THEN 'meta' WHEN {_OJI} >= {_ENG} THEN 'ojibwe' ELSE 'english' END"""


@query(f"SELECT doc_id, pos, {_CLASS} AS cls FROM (SELECT doc_id, pos, {R.collapse('b')} AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{{2,}}')) AS b, (generate_subscripts(regexp_split_to_array(text, '\\n{{2,}}'), 1) - 1)::INTEGER AS pos FROM {D}))")
def block_class(spark, d):
    return table(spark, d, D).select("doc_id", F.posexplode(F.split("text", r"\n{2,}")).alias("pos", "b")).select("doc_id", "pos", X.block_class(F.col("b")).alias("cls"))


@query(f"SELECT row_id, replace(replace(replace(source_file, '/', '_'), ':', '_'), '.', 'p') AS slug, regexp_replace(list_extract(string_split(source_file, '/'), -1), '\\.html$', '') AS file, CASE WHEN starts_with(source_file, '/') AND ends_with(source_file, '.html') THEN 'http://host' || source_file END AS link FROM {S}")
def slugs(spark, d):
    s = F.col("source_file")
    return pool_of(spark, d).select("row_id", X.slug(s).alias("slug"), X.file_slug(s).alias("file"), X.absolute("http://host", s).alias("link"))


@query("SELECT source, CASE WHEN contains(lower(source), 'tlm') THEN 'tlm' WHEN contains(lower(source), 'clkd') THEN 'clkd' WHEN contains(lower(source), 'calib') THEN 'calibrated' WHEN contains(lower(source), 'silver') THEN 'silver' ELSE 'other' END AS kind FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def model_categories(spark, d):
    return table(spark, d, D).filter(F.col("source").isNotNull()).select("source").distinct().select("source", X.model_category(F.col("source")).alias("kind"))


_ANSWER = "'thinking' || chr(10) || 'LABEL: ' || coalesce(label_raw, '?') || chr(10) || 'label: simile' || chr(10) || 'EXPRESSION: x'"


@query(f"SELECT row_id, CASE WHEN x IN ('literal', 'idiom', 'metaphor', 'simile') THEN x END AS label FROM (SELECT row_id, lower({R.strip("regexp_extract(" + _ANSWER + ", '(?im)^\\s*label:(.*)$', 1)")}) AS x FROM bloomfield_annotated)")
def parse_label(spark, d):
    answer = F.concat(F.lit("thinking\nLABEL: "), F.coalesce("label_raw", F.lit("?")), F.lit("\nlabel: simile\nEXPRESSION: x"))
    return table(spark, d, "bloomfield_annotated").select("row_id", L.parsed(answer).alias("label"))


@query(f"SELECT row_id, substr(sha256(text_cree), 1, 10) AS version FROM {S} WHERE text_cree IS NOT NULL")
def prompt_version(spark, d):
    return pool_of(spark, d).filter(F.col("text_cree").isNotNull()).select("row_id", X.fingerprint(F.col("text_cree")).alias("version"))


@query("SELECT token, token || ' [' || entries[1].pos || ']: ' || array_to_string(list_transform(entries[1:2], lambda e: array_to_string(e.definitions[1:2], ' / ')), '; ') AS line FROM dictionary WHERE len(entries) > 0")
def prompt_render(spark, d):
    from glossmill.operators.incremental import entry_lines

    rows = table(spark, d, "dictionary").filter(F.size("entries") > 0)
    return rows.select("token", F.concat("token", F.lit(" ["), F.get("entries", F.lit(0))["pos"], F.lit("]: "), entry_lines(F.col("entries"))).alias("line"))


@query("SELECT row_id, [sentence_id, 99][k]::INTEGER AS sentence_num, [label, 'idiom'][k] AS label FROM bloomfield_annotated, (SELECT unnest([1, 2]) AS k) WHERE label IS NOT NULL AND sentence_id IS NOT NULL")
def json_salvage(spark, d):
    rows = table(spark, d, "bloomfield_annotated").dropna(subset=["label", "sentence_id"])
    raw = F.concat(F.lit('noise {"sentence_num": '), F.col("sentence_id").cast("string"), F.lit(', "label": "'), "label", F.lit('"} and {"sentence_num": 99, "label": "idiom"} tail'))
    return rows.select("row_id", F.explode(L.salvaged(raw)).alias("a")).select("row_id", "a.sentence_num", "a.label")


@query("SELECT row_id, split_part(label_raw, ' ', 1) AS first_token, regexp_replace(label_raw, '[^\\p{L}\\p{N}_\\s-]', '', 'g') AS plain FROM bloomfield_annotated")
def label_tokens(spark, d):
    return table(spark, d, "bloomfield_annotated").select("row_id", F.split_part("label_raw", F.lit(" "), F.lit(1)).alias("first_token"), F.regexp_replace("label_raw", r"[^\p{L}\p{N}_\s-]", "").alias("plain"))


@query(f"SELECT doc_id, right(text, 500) AS tail, left(text, 40) AS head, {R.blank_words('text')}::INTEGER AS n_words FROM {D} WHERE text IS NOT NULL")
def text_edges(spark, d):
    return table(spark, d, D).filter(F.col("text").isNotNull()).select("doc_id", F.right("text", F.lit(500)).alias("tail"), F.left("text", F.lit(40)).alias("head"), X.blank_words(F.col("text")).alias("n_words"))


@query(f"SELECT row_id, {R.merged('label_raw')} AS v1 FROM bloomfield_annotated WHERE text_cree IS NOT NULL")
def label_normalise_v1(spark, d):
    return table(spark, d, "bloomfield_annotated").filter(F.col("text_cree").isNotNull()).select("row_id", L.merged(F.col("label_raw")).alias("v1"))


@query(f"SELECT row_id, {R.strict('label_raw')} AS v2 FROM bloomfield_annotated WHERE label_raw IS NOT NULL")
def label_normalise_v2(spark, d):
    return table(spark, d, "bloomfield_annotated").filter(F.col("label_raw").isNotNull()).select("row_id", L.strict(F.col("label_raw")).alias("v2"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'status=' || o_orderstatus || ';' ELSE '' END || 'price=' || floor(o_totalprice)::BIGINT AS config FROM orders")
def config_keys(spark, d):
    o = table(spark, d, "orders")
    config = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.floor("o_totalprice").cast("string"), F.lit("clerk"), F.lit("x"))
    kept = F.map_filter(config, lambda k, v: F.array_contains(F.array(F.lit("status"), F.lit("price")), k) & ((k != "status") | (v != "P")))
    return o.select("o_orderkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("config"))


# HTML: pages are rendered from paragraph rows, the same way on both sides, with texts escaped.


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def escaped(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


_PAGE = f"""'<html><a href="/texts/' || coalesce({_esc('source_file')}, 'none') || '.html">x</a><a class=z href=''#top''>y</a><p class="paragraph crk" id="' || paragraph_num || '">' || {_esc('text_cree')} || '<sup>2</sup></p><p class="paragraph crk">no number</p><p>more</p><p class="footnote"><sup>2</sup> note ' || row_id || '</p><p class=''eng paragraph''><strong>(' || paragraph_num || ')</strong> ' || {_esc('text_en')} || '</p><p>after</p></html>'"""


def pages(spark, d):
    rows = table(spark, d, P).dropna(subset=["text_cree", "text_en", "paragraph_num"])
    c = lambda s: F.lit(s)
    num = F.col("paragraph_num").cast("string")
    body = [
        c('<html><a href="/texts/'), F.coalesce(escaped(F.col("source_file")), c("none")), c(""".html">x</a><a class=z href='#top'>y</a><p class="paragraph crk" id=\""""), num, c('">'), escaped(F.col("text_cree")),
        c('<sup>2</sup></p><p class="paragraph crk">no number</p><p>more</p><p class="footnote"><sup>2</sup> note '), F.col("row_id").cast("string"), c("</p><p class='eng paragraph'><strong>("), num, c(")</strong> "), escaped(F.col("text_en")), c("</p><p>after</p></html>"),
    ]
    return rows.select("row_id", "paragraph_num", "text_cree", "text_en", F.concat(*body).alias("html"))


_PAGES = f"(SELECT row_id, paragraph_num, text_cree, text_en, {_PAGE} AS html FROM {P} WHERE text_cree IS NOT NULL AND text_en IS NOT NULL AND paragraph_num IS NOT NULL)"


@query(f"SELECT row_id, unnest(list_filter(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1), lambda z: ends_with(z, '.html'))) AS href FROM {_PAGES}")
def page_links(spark, d):
    return pages(spark, d).select("row_id", F.explode(F.filter(html.links(F.col("html")), lambda x: x.endswith(".html"))).alias("href"))


_BOTH = f"(SELECT row_id, paragraph_num, {R.collapse('text_cree')} AS c, {R.collapse('text_en')} AS e FROM {_PAGES})"


@query(f"SELECT row_id, paragraph_num, CASE WHEN c = '' THEN 'more' ELSE c || chr(10) || 'more' END AS text_cree, e AS text_en, '[2] note ' || row_id AS footnote_en FROM {_BOTH}")
def page_paragraphs(spark, d):
    return html.page_paragraphs(pages(spark, d), "row_id", "html")


@query(f"SELECT row_id, 2::BIGINT AS n, 'note ' || row_id AS note FROM {_PAGES}")
def page_footnotes(spark, d):
    return html.footnotes(pages(spark, d), "row_id", "html")


@query(f"SELECT row_id, unnest(regexp_extract_all(html, '<sup>\\s*(\\d+)\\s*</sup>', 1)) AS ref FROM {_PAGES}")
def page_sup_refs(spark, d):
    return pages(spark, d).select("row_id", F.explode(html.superscripts(F.col("html"))).alias("ref"))


@query(f"SELECT row_id, e AS body FROM {_BOTH}")
def page_visible_text(spark, d):
    part = F.concat(F.lit("<p> <strong>(1)</strong> "), escaped(F.col("text_en")), F.lit("<sup>2</sup></p>"))
    return pages(spark, d).select("row_id", html.visible_text(part).alias("body"))


@query("SELECT token, e.lemma AS lemma, e.pos AS pos, 'Kind of ' || e.pos AS pos_label, e.definitions[1] AS first, len(e.definitions)::INTEGER AS n FROM (SELECT token, unnest(entries) AS e FROM dictionary) WHERE len(e.definitions) > 0 AND e.lemma IS NOT NULL AND e.pos IS NOT NULL")
def page_sections(spark, d):
    def entry(x):
        item = lambda y: F.concat(F.lit("<li>\n "), escaped(y), F.lit(" <cite>MD</cite></li>"))
        return F.concat(
            F.lit('<li class="x search-results__result"><h2 class="definition-title__title"><a href="#">'), escaped(x["lemma"]), F.lit("</a></h2><div class='definition__elaboration'><i>"), x["pos"],
            F.lit(' - more</i></div><span class="wordclass">\U0001f333 Kind of '), x["pos"], F.lit('</span><ol class="meanings">'), F.array_join(F.transform(x["definitions"], item), ""), F.lit("</ol></li>"),
        )

    rows = table(spark, d, "dictionary").filter(F.size("entries") > 0)
    rows = rows.select("token", F.concat(F.lit("<ul>"), F.array_join(F.transform("entries", entry), ""), F.lit("</ul>")).alias("html"))
    return rows.select("token", F.explode(html.dictionary_entries("html")).alias("e")).select("token", "e.lemma", "e.pos", "e.pos_label", F.get("e.definitions", F.lit(0)).alias("first"), F.size("e.definitions").alias("n"))


# Alignment and parsing


@query(f"""SELECT row_id, (k - 1)::BIGINT AS sentence_id, s[k] AS src, t[k] AS tgt, {R.rnd("1 - abs(x - y) / greatest(x, y, 1e-9::DOUBLE)", 3)} AS conf FROM (
SELECT row_id, s, t, k, length(s[k])::DOUBLE / coalesce(nullif(list_sum(list_transform(s, lambda z: length(z))), 0), 1)::DOUBLE AS x, length(t[k])::DOUBLE / coalesce(nullif(list_sum(list_transform(t, lambda z: length(z))), 0), 1)::DOUBLE AS y
FROM (SELECT row_id, s, t, unnest(range(1, len(s) + 1)) AS k FROM (SELECT row_id, {R.sentences('text_cree')} AS s, {R.sentences('text_en')} AS t FROM {P}) WHERE len(s) = len(t) AND len(s) > 0)) WHERE length(s[k]) >= 20 AND length(t[k]) >= 20""")
def pair_align_equal(spark, d):
    rows = table(spark, d, P).select("row_id", "text_cree", "text_en")
    return align.split_and_align(rows.filter(F.size(X.sentences_kept(F.col("text_cree"))) == F.size(X.sentences_kept(F.col("text_en")))), "row_id", "text_cree", "text_en")


@query()
def pair_align_dp(spark, d):
    return align.split_and_align(table(spark, d, P).select("row_id", "text_cree", "text_en"), "row_id", "text_cree", "text_en")


@query(f"""SELECT source, (k - 1)::BIGINT AS pos, a[k] AS left_text, b[k] AS right_text FROM (SELECT source, a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS k FROM (
SELECT source, list(text ORDER BY doc_id) FILTER (WHERE lang = 'crk') AS a, list(text ORDER BY doc_id) FILTER (WHERE lang = 'en') AS b FROM {D} WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source) WHERE len(a) > 0 AND len(b) > 0 AND abs(len(a) - len(b)) <= 10)""")
def paragraph_pairs(spark, d):
    rows = table(spark, d, D).dropna(subset=["text", "source"])
    return align.positional_pairs(rows, "source", "doc_id", F.when(F.col("lang") == "crk", True).when(F.col("lang") == "en", False), "text")


_ENDS = f"regexp_matches(t, '[.!?][\"''”’]*\\s*$') AND {R.blank_words('t')} >= 8"


@query(f"""WITH RECURSIVE a AS (SELECT doc_id, {R.nonempty("list_transform(string_split(text, chr(10)), lambda y: " + R.strip('y') + ")")} AS w FROM {D} WHERE text IS NOT NULL),
l AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS p FROM a),
r AS (SELECT doc_id, 0::BIGINT AS i, '' AS open, NULL::VARCHAR AS x, NULL::VARCHAR AS y FROM a UNION ALL SELECT doc_id, i, CASE WHEN ends THEN '' ELSE t END, x, CASE WHEN ends THEN {R.strip('t')} END FROM (SELECT doc_id, i, t, x, {_ENDS} AS ends FROM (
SELECT r.doc_id AS doc_id, l.i::BIGINT AS i, CASE WHEN r.open <> '' AND regexp_matches(l.p, '^\\.\\s+[A-Z]') THEN {R.strip('r.open')} END AS x, CASE WHEN r.open <> '' AND regexp_matches(l.p, '^\\.\\s+[A-Z]') THEN regexp_replace(l.p, '^[. ]+', '')
WHEN r.open = '' THEN l.p ELSE regexp_replace(r.open, '{R.WS}+$', '') || ' ' || l.p END AS t FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1))),
e AS (SELECT doc_id, i, 0 AS k, x AS paragraph FROM r WHERE x IS NOT NULL UNION ALL SELECT doc_id, i, 1, y FROM r WHERE y IS NOT NULL UNION ALL SELECT doc_id, max(i), 2, {R.strip('arg_max(open, i)')} FROM r GROUP BY doc_id)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INTEGER AS pos, paragraph FROM e WHERE k < 2 OR paragraph <> ''""")
def fragment_merge(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "")
    return table(spark, d, D).filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(parse.merged_fragments(lines)).alias("pos", "paragraph"))


_HAS = "[āēīōĀĒĪŌ]"
_MARK = r"^\s{1,6}\d{1,2}\.\s+(.+)"
_PROSE_SQL = parse.PROSE.replace("'", "''")
_CUTS = "regexp_split_to_array(content, ' {3,}')"
_PART = lambda x: R.strip(f"array_to_string({_CUTS}[{x}], '   ')")
_SIDES = f"list_transform(range(1, len({_CUTS})), lambda k: {{'cree': {_PART('1:k')}, 'en': {_PART('k + 1:')}}})"
_TOKENS = R.nonempty(f"regexp_split_to_array(content, '{R.WS}+')")
_MACRON = f"len(list_filter({_TOKENS}, lambda z: regexp_matches(z, '{_HAS}')))"
_BODY = R.strip(f"regexp_extract(line, '{_MARK}', 1)")
_TIDY = lambda x: f"trim(trim({R.collapse(x)}, '\"'), '''')"


@query(f"""WITH p AS (SELECT row_id, 'Chapter 1' || chr(10) || chr(10) || '  1. ' || text_cree || chr(10) || '     ' || text_en || chr(10) || '12' || chr(10) || text_cree || '     ' || text_en AS text FROM {S} WHERE text_cree IS NOT NULL AND text_en IS NOT NULL),
n AS (SELECT row_id, generate_subscripts(a, 1) AS no, unnest(a) AS line FROM (SELECT row_id, regexp_split_to_array(text, '\\r\\n|[\\r\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS a FROM p)),
f AS (SELECT row_id, no, line, lead(line) OVER (PARTITION BY row_id ORDER BY no) AS next_line, regexp_matches(line, '{_MARK}') AS marked, CASE WHEN regexp_matches(line, '{_MARK}') THEN {_BODY} ELSE {R.strip('line')} END AS content, {R.strip('line')} AS bare FROM n WHERE {R.strip('line')} <> ''),
g AS (SELECT *, NOT regexp_matches(bare, '^\\p{{Nd}}+$') AND NOT regexp_matches(bare, '{_PROSE_SQL}') AS told, NOT regexp_matches(content, '{_PROSE_SQL}') AND CASE WHEN len({_TOKENS}) = 0 THEN false WHEN len({_TOKENS}) <= 3 THEN {_MACRON} >= 1 ELSE {_MACRON} >= 0.25::DOUBLE * len({_TOKENS}) END AS cree,
list_filter(list_reverse({_SIDES}), lambda z: regexp_matches(z.cree, '{_HAS}') AND NOT regexp_matches(z.en, '{_HAS}') AND length(z.en) > 4)[1] AS pair FROM f),
h AS (SELECT * REPLACE (CASE WHEN told AND (marked OR cree) THEN pair END AS pair), row_number() OVER (PARTITION BY row_id ORDER BY no) AS i FROM g),
s AS (SELECT *, told AND cree AND pair IS NULL AND (marked OR length(content) > 5) AND coalesce(NOT regexp_matches({R.strip('next_line')}, '{_HAS}') AND length({R.strip('next_line')}) > 3 AND NOT (marked AND regexp_matches(next_line, '{_MARK}')), false) AS stacked FROM h),
u AS (SELECT *, (i - coalesce(max(CASE WHEN NOT stacked THEN i END) OVER (PARTITION BY row_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS free FROM s)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY no) - 1 AS pos, {_TIDY('coalesce(pair.cree, content)')} AS cree, {_TIDY('coalesce(pair.en, next_line)')} AS en FROM u WHERE free AND (stacked OR pair IS NOT NULL)""")
def line_machine(spark, d):
    rows = table(spark, d, S).dropna(subset=["text_cree", "text_en"])
    page = F.concat(F.lit("Chapter 1\n\n  1. "), "text_cree", F.lit("\n     "), "text_en", F.lit("\n12\n"), "text_cree", F.lit("     "), "text_en")
    return parse.grammar_examples(rows.select("row_id", page.alias("text")), "row_id", "text")


_NUM = "TRY_CAST(nullif(regexp_extract(line, '(\\d{1,3})', 1), '') AS BIGINT)"
_L0 = f"({_LINES})"


@query(f"""SELECT doc_id, line_no::BIGINT AS line_no, num FROM (SELECT doc_id, line_no, num, coalesce(max(num) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m
FROM (SELECT doc_id, line_no, {_NUM} AS num FROM {_L0}) WHERE num <= 36) WHERE num > m""")
def header_monotonic(spark, d):
    lines = parse.lines_of(table(spark, d, D), "doc_id", "text")
    number = F.nullif(F.regexp_extract("line", r"(\d{1,3})", 1), F.lit("")).cast("bigint")
    return parse.rising_headers(lines, "doc_id", number).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "num")


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, last_value(CASE WHEN ends_with(line, '?') THEN left(line, 30) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM {_L0}")
def carry_forward_title(spark, d):
    lines = parse.lines_of(table(spark, d, D), "doc_id", "text")
    return parse.carried(lines, "doc_id", F.when(F.col("line").endswith("?"), F.left("line", F.lit(30)))).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "title")


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM {_L0} WHERE {R.strip('line')} <> ''")
def next_nonblank(spark, d):
    return parse.next_filled(parse.lines_of(table(spark, d, D), "doc_id", "text"), "doc_id").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "next_line")


@query("""SELECT source, coalesce(min(i) FILTER (WHERE e AND nx), max(i) FILTER (WHERE e), count(*))::BIGINT AS at FROM (
SELECT source, e, row_number() OVER w - 1 AS i, coalesce(lead(e) OVER w, false) AS nx FROM (SELECT source, doc_id, coalesce(lang = 'en', false) AS e FROM documents WHERE source IS NOT NULL) WINDOW w AS (PARTITION BY source ORDER BY doc_id)) GROUP BY source""")
def block_switch_index(spark, d):
    rows = table(spark, d, D).filter(F.col("source").isNotNull()).select("source", "doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("e"))
    return parse.switch_index(rows, "source", "doc_id", "e")


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), -1)::BIGINT AS end_line FROM {_L0} WHERE ends_with(line, '?')")
def story_spans(spark, d):
    lines = parse.lines_of(table(spark, d, D), "doc_id", "text").filter(F.col("line").endswith("?"))
    return parse.spans(lines, "doc_id").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.coalesce("end_line", F.lit(-1)).cast("bigint").alias("end_line"))


_KEY = "upper(regexp_replace(" + R.strip("regexp_replace(t, '\\p{Nd}+\\s*$', '')") + ", '\\.+$', ''))"
_CLEAN = R.strip(_BLOCK.replace("(text,", "(b,"))


@query(f"""WITH p AS (SELECT doc_id, regexp_split_to_array('1. THE FIRST STORY' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || 'The man said that he had told them what was there then.' || chr(10) || chr(10), '\\n{{2,}}') AS a FROM {D} WHERE text IS NOT NULL),
n AS (SELECT doc_id, no, b, {R.collapse('b')} AS t FROM (SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS b FROM p)),
c AS (SELECT doc_id, no, b, t, {_CLASS} AS cls FROM n),
h AS (SELECT doc_id, no, cls, {_CLEAN} AS body, last_value(CASE WHEN cls = 'header' THEN {_KEY} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM c),
r AS (SELECT doc_id, title, cls, body, row_number() OVER (PARTITION BY doc_id, title, cls ORDER BY no) - 1 AS i FROM h WHERE title IS NOT NULL AND cls IN ('ojibwe', 'english') AND length(body) >= 10)
SELECT x.doc_id AS doc_id, x.title AS title, x.i AS para_idx, x.body AS text_ojibwe, y.body AS text_en FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.title = y.title AND x.i = y.i WHERE x.cls = 'ojibwe' AND y.cls = 'english'""")
def facing_pages(spark, d):
    rows = table(spark, d, D).filter(F.col("text").isNotNull()).select("doc_id", F.concat(F.lit("1. THE FIRST STORY\n\n"), F.regexp_replace("text", r"\n", "\n\n"), F.lit("\n\nThe man said that he had told them what was there then.\n\n")).alias("text"))
    return parse.facing_pages(rows, "doc_id", "text")


@query()
def story_pairs(spark, d):
    rows = table(spark, d, P).dropna(subset=["source_file", "text_cree", "text_en"])
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", c))), lambda x: F.regexp_replace(x[c], r"\s+", " ")), "\n\n")
    # A book holds the rows of one file under two hundred neighbouring ids, so that no file makes a text without bound.
    book = F.concat_ws("#", "source_file", F.floor(F.col("row_id") / 200).cast("string"))
    docs = rows.withColumn("source_file", book).groupBy("source_file").agg(F.concat(F.lit("Contents\n(2) Story\nTEXTS AND TRANSLATIONS\n(1) A Story\n\n"), side("text_cree"), F.lit("\n\n"), side("text_en")).alias("text"))
    found = parse.stories(docs, "source_file", "text")
    return align.paragraph_pairs(found.withColumn("story", F.concat_ws(" ", "source_file", F.col("num").cast("string"))), "story", "cree", "en")
