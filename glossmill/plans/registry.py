"""Registry of named queries and their SQL equivalents, and the SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WS = r"[\s\x0b\x{85}\p{Z}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def nonempty(x: str) -> str:
    return f"list_filter({x}, lambda z: z != '')"


def sentences(x: str) -> str:
    return nonempty(f"string_split(regexp_replace({collapse(x)}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))")


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[^\\s\\x0b\\x{{85}}\\p{{Z}}.,;:!?\"''()\\[\\]]+')"


def blank_words(x: str) -> str:
    return f"len({nonempty(f"regexp_split_to_array({x}, '{WS}+')")})"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"


def draw(key: str, seed: int | str = 42) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR))), 1, 8))::BIGINT"


def merged(x: str) -> str:
    return f"CASE lower({strip(x)}) WHEN 'idiom' THEN 'idiom' WHEN 'proverb' THEN 'idiom' WHEN 'metaphor' THEN 'metaphor' WHEN 'simile' THEN 'simile' ELSE 'literal' END"


def strict(x: str) -> str:
    return f"CASE WHEN lower({strip(x)}) IN ('literal', 'idiom', 'metaphor', 'simile') THEN lower({strip(x)}) ELSE 'literal' END"


def rnd(x: str, places: int = 4) -> str:
    p = f"{10**places}.0::DOUBLE"
    return f"floor(({x}) * {p} + 0.5::DOUBLE) / {p}"


def listed(items) -> str:
    return "(" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + ")"


def array(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


LABELS = ("literal", "idiom", "metaphor", "simile")
GUESS = f"CASE WHEN {draw('row_id', 'noise')} % 5 = 0 THEN ['literal', 'idiom', 'metaphor', 'simile'][{draw('row_id', 'noise')} % 4 + 1] ELSE {strict('label')} END"
JUDGED = f"(SELECT row_id, source_file, text_cree, footnote_applies, {strict('label')} AS t, {GUESS} AS p FROM bloomfield_annotated WHERE label IS NOT NULL)"


def roll(a: str, b: str) -> str:
    m = 2147483647
    x = f"((({a})::BIGINT * 1000003 + ({b})::BIGINT + 1) * 48271 % {m})"
    return f"(list_reduce([{x}, 3, 5], lambda x, k: (x * x + x * k + 1) % {m}) * 69621 + 12345) % {m}"


def sentences_bare(x: str) -> str:
    return nonempty(f"list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda y: {strip('y')})")


def average(a: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN list_sum({a})::DOUBLE / len({a}) ELSE 0.0 END"


def scores_sql(counts: str, by: tuple[str, ...] = (), places: int | None = 4) -> str:
    """SELECT of the E01 columns from a relation of (by..., t, p, n)."""
    rnd = globals()["rnd"] if places else lambda x, _: x
    cols, macro = [], {"p": [], "r": [], "f1": []}
    n = lambda cond: f"coalesce(sum(n) FILTER (WHERE {cond}), 0)::BIGINT"
    ratio = lambda a, b: f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0.0)"
    for c in LABELS:
        tp, said, real = n(f"t = '{c}' AND p = '{c}'"), n(f"p = '{c}'"), n(f"t = '{c}'")
        for m, x in (("p", ratio(tp, said)), ("r", ratio(tp, real)), ("f1", ratio(f"2 * {tp}", f"{said} + {real}"))):
            cols.append(f"{rnd(x, places)} AS {m}_{c}")
            macro[m].append(x)
    cols += [f"{rnd('(' + ' + '.join(macro[m]) + ') / 4', places)} AS macro_{m}" for m in macro]
    cols.append(f"{rnd(ratio(n('t = p'), 'sum(n)::BIGINT'), places)} AS accuracy")
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT {', '.join((*by, *cols))} FROM {counts}{group}"
