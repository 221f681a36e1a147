"""DuckDB equivalents of the queries that SQL can express on whole tables."""

from __future__ import annotations

_FILE = r"trim(regexp_replace(regexp_replace(trim(lower(source_file)), '^.*[/\\]', ''), '\.html$', ''))"
_LETTERS = r"regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
_RECORD = "(SELECT row_id, least(l, r) || chr(31) || greatest(l, r) AS record FROM (SELECT row_id, " + _LETTERS.format("text_cree") + " AS l, " + _LETTERS.format("text_en") + " AS r FROM deepseek_labels))"
_FOLD = r"regexp_replace(strip_accents(lower(text_cree)), '[^\p{L}\p{N}]+', '', 'g')"
_NEAR = f"""(SELECT g.row_id AS gold_row_id, s.row_id AS silver_row_id, g.eval_split AS eval_split, g.source_file AS source_file
FROM (SELECT *, {_FOLD} AS t FROM bloomfield_annotated WHERE text_cree IS NOT NULL) g JOIN (SELECT row_id, {_FOLD} AS t FROM deepseek_labels WHERE text_cree IS NOT NULL) s
ON abs(length(g.t) - length(s.t)) * 100 <= 15 * greatest(length(g.t), length(s.t)) WHERE g.t <> '' AND s.t <> '' AND levenshtein(g.t, s.t) * 100 <= 15 * greatest(length(g.t), length(s.t)))"""

_TIES = f"""WITH RECURSIVE n AS (SELECT DISTINCT source_file, paragraph_id, {_FILE} AS node FROM bloomfield_texts_sentences WHERE source_file IS NOT NULL),
e AS (SELECT DISTINCT a.node AS x, b.node AS y FROM n a JOIN n b ON a.paragraph_id = b.paragraph_id),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS node, min(y) AS label FROM (SELECT x, y FROM r UNION ALL SELECT node, node FROM n) GROUP BY x),
s AS (SELECT DISTINCT n.source_file AS stored, c.label AS label FROM n JOIN c ON n.node = c.node)"""


_BARE = r"lower(regexp_replace({}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g'))"
_NUMBER = "CASE " + " ".join(f"WHEN {_BARE} IN ('{x}', '{x[0]}') THEN {i}" for i, x in enumerate(("literal", "idiom", "metaphor", "simile"))) + " END"
_SAME = " + ".join(f"c{k} * c{k}" for k in range(4))
_AGREEMENT = f"""WITH said AS (SELECT paragraph_id, sentence_id, annotator, {_NUMBER.format(*["human_label"] * 4)} AS v, reviewed_at AS t FROM silver_verification_cache WHERE annotator <> '(gold)'
UNION ALL SELECT paragraph_id, sentence_id, '(gold)', {_NUMBER.format(*["label"] * 4)}, annotated_at FROM bloomfield_annotated g WHERE EXISTS (SELECT 1 FROM silver_verification_cache s WHERE s.paragraph_id = g.paragraph_id AND s.sentence_id = g.sentence_id)),
last AS (SELECT *, row_number() OVER (PARTITION BY paragraph_id, sentence_id, annotator ORDER BY t DESC NULLS LAST, v DESC) AS rn FROM said WHERE v IS NOT NULL AND paragraph_id IS NOT NULL AND sentence_id IS NOT NULL),
items AS (SELECT {", ".join(f"count(*) FILTER (WHERE v = {k}) AS c{k}" for k in range(4))}, count(*) AS n FROM last WHERE rn = 1 GROUP BY paragraph_id, sentence_id HAVING count(*) > 1),
sums AS (SELECT count(*) AS items, sum(n)::BIGINT AS opinions, sum((n * n - ({_SAME}))::DOUBLE / (n - 1)) AS apart, {", ".join(f"sum(c{k})::BIGINT AS s{k}" for k in range(4))} FROM items)
SELECT items, opinions, floor((1 - apart / nullif(opinions, 0)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS observed,
floor((1 - apart / nullif((opinions * opinions - ({" + ".join(f"s{k} * s{k}" for k in range(4))}))::DOUBLE / nullif(opinions - 1, 0), 0)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS alpha FROM sums"""


def oracle_sql() -> dict[str, str]:
    first = f"(SELECT record, min(row_id) AS first_row_id, count(*) AS copies FROM {_RECORD} GROUP BY record)"
    return {
        "p1_found": f"{_TIES} SELECT a.stored AS source_file_a, b.stored AS source_file_b FROM s a JOIN s b ON a.label = b.label AND a.stored < b.stored",
        "p1_groups": f"{_TIES} SELECT stored AS source_file, label AS grp, count(*) OVER (PARTITION BY label) - 1 AS links FROM s",
        "p2_found": f"SELECT gold_row_id, silver_row_id FROM {_NEAR}",
        "p2_counts": f"SELECT eval_split, source_file, count(*) AS pairs, count(DISTINCT gold_row_id) AS gold_rows, count(DISTINCT silver_row_id) AS silver_rows FROM {_NEAR} GROUP BY eval_split, source_file",
        "p3_found": f"SELECT f.first_row_id AS first_row_id, r.row_id AS copy_row_id FROM {_RECORD} r JOIN {first} f ON r.record = f.record WHERE r.row_id <> f.first_row_id",
        "p3_collapsed": f"SELECT first_row_id AS row_id, copies FROM {first}",
        "p3_collisions": f"SELECT upper(md5(record)) AS key FROM {_RECORD} GROUP BY md5(record) HAVING count(DISTINCT record) > 1",
        "p4_agreement": _AGREEMENT,
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
