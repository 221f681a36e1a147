"""Extraction from landed HTML (H01 to H06), by column expressions.

Character references are decoded first, in Arrow batches; characters that would then be taken for
markup stand as private-use characters until tags and attributes have been read.
"""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from glossmill.functions import text as X

_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
_HIDDEN, _SHOWN = "", "<>\"'"
_HIDE = str.maketrans(_SHOWN, _HIDDEN)


def _decode(page: str | None) -> str | None:
    return page if page is None or "&" not in page else _REFERENCE.sub(lambda m: _html.unescape(m[0]).translate(_HIDE), page)


@F.pandas_udf(StringType())
def _decoded(pages: pd.Series) -> pd.Series:
    return pages.map(_decode)


def decoded(html: Column | str) -> Column:
    """HTML without comments, its character references decoded; markup characters among them are hidden until :func:`shown`."""
    return _decoded(F.regexp_replace(html, r"(?s)<!--.*?-->", " "))


def shown(x: Column) -> Column:
    return F.translate(x, _HIDDEN, _SHOWN)


def links(html: Column) -> Column:
    """Targets of all links, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')"""), F.lit(0))
    return F.transform(found, lambda a: F.regexp_extract(a, r"""(?i)\bhref\s*=\s*["'](.*)["']$""", 1))


def superscripts(html: Column) -> Column:
    """Numbers that stand alone in superscripts."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<sup\b[^>]*>\s*(\d+)\s*</sup>"), F.lit(1))


def tagless(html: Column) -> Column:
    return X.collapse(F.regexp_replace(html, r"<[^>]*>", " "))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, in whichever quotes or none; empty without it."""
    return F.regexp_replace(F.regexp_extract(tag, rf"""(?is)^<\w+[^>]*?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), "^[\"']|[\"']$", "")


def classes(tag: Column) -> Column:
    return F.split(X.collapse(attribute(tag, "class")), " ")


def visible(decoded_html: Column) -> Column:
    """Text of a decoded fragment without superscripts and without a <strong> before any other text, pieces joined by blanks."""
    x = F.regexp_replace(decoded_html, r"(?is)^((?:\s|<(?!strong\b)[^>]*>)*)<strong\b[^>]*>.*?</strong>", "$1")
    return shown(tagless(F.regexp_replace(x, r"(?is)<sup\b[^>]*>.*?</sup>", " ")))


def visible_text(html: Column | str) -> Column:
    """Visible text of a fragment; NULL stays NULL."""
    return visible(decoded(html))


def _paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    found = pages.select(key, decoded(html).alias("gm_page"))
    tags = F.regexp_extract_all("gm_page", F.lit(r"(?is)<p(?:\s[^>]*)?>.*?(?=</p>|<p[\s>]|$)"), F.lit(0))
    return found.select(key, F.posexplode(tags).alias("pos", "p")).withColumn("cls", classes(F.col("p")))


def footnotes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, note) of paragraphs of class footnote whose first superscript is a number; the last of a number wins."""
    return _footnotes(_paragraphs(pages, key, html), key)


def _footnotes(paragraphs: DataFrame, key: str) -> DataFrame:
    first = X.strip(F.regexp_extract("p", r"(?is)<sup\b[^>]*>(.*?)</sup>", 1))
    rest = F.regexp_replace("p", r"(?is)^(.*?)<sup\b[^>]*>.*?</sup>", "$1 ")
    notes = paragraphs.filter(F.array_contains("cls", "footnote") & first.rlike(r"^\d{1,18}$")).select(key, "pos", first.cast("bigint").alias("n"), shown(tagless(rest)).alias("note"))
    return notes.groupBy(key, "n").agg(F.max_by("note", "pos").alias("note"))


def page_paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, paragraph_num, text_cree, text_en, footnote_en) of a page of numbered parallel paragraphs.

    A source paragraph (classes paragraph and crk) opens the number of its id; paragraphs of no such
    class continue it, footnotes do not; a target paragraph (paragraph and eng) with a leading
    (number) belongs to that number and ends the continuation. A number that is opened again starts
    anew. Notes are those whose numbers stand in the source paragraphs. Numbers without any text
    are left out; so are pages that are NULL.
    """
    rows = _paragraphs(pages, key, html)
    has = lambda c: F.array_contains("cls", c)
    id_, strong = attribute(F.col("p"), "id"), X.strip(shown(tagless(F.regexp_extract("p", r"(?is)<strong\b[^>]*>(.*?)</strong>", 1))))
    cree, eng = has("paragraph") & has("crk"), has("paragraph") & has("eng") & ~has("crk")
    opens = F.when(cree & id_.rlike(r"^\d{1,18}$"), id_.cast("bigint"))
    told = F.when(eng, F.nullif(F.regexp_extract(strong, r"^\(?(\d{1,18})\)?", 1), F.lit("")).cast("bigint"))
    rows = rows.withColumns({"opens": opens, "told": told, "more": ~cree & ~eng & ~has("footnote")})
    w = Window.partitionBy(key).orderBy("pos")
    state = F.when(F.col("opens").isNotNull(), F.col("opens")).when(F.col("told").isNotNull(), F.lit(-1))
    current = F.nullif(F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    num = F.coalesce("opens", "told", F.when(F.col("more"), current))
    lines = rows.withColumn("num", num).filter(F.col("num").isNotNull()).withColumn("body", visible(F.col("p")))
    began = F.max(F.when(F.col("opens").isNotNull(), F.col("pos"))).over(Window.partitionBy(key, "num"))
    lines = lines.withColumn("began", began).filter(F.col("began").isNull() | (F.col("pos") >= F.col("began")))
    part = lambda cond: X.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond & (F.col("body") != ""), F.struct("pos", "body")))), lambda x: x["body"]), "\n"))
    target = F.col("told").isNotNull() & F.col("opens").isNull()
    refs = F.when(~target & (F.col("opens").isNotNull() | (F.col("body") != "")), superscripts(F.col("p")))
    both = lines.groupBy(key, "num").agg(part(~target).alias("text_cree"), part(target).alias("text_en"), F.array_distinct(F.flatten(F.collect_list(refs))).alias("refs"))
    both = both.filter((F.col("text_cree") != "") | (F.col("text_en") != ""))
    notes = _footnotes(rows, key)
    used = both.select(key, "num", F.explode("refs").alias("n")).select(key, "num", F.try_to_number("n", F.lit("9" * 18)).cast("bigint").alias("n")).join(notes, [key, "n"]).distinct()
    lines_ = F.transform(F.array_sort(F.collect_list(F.struct("n", "note"))), lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["note"]))
    joined = used.groupBy(key, "num").agg(F.array_join(lines_, "\n").alias("footnote_en"))
    return both.drop("refs").join(joined, [key, "num"], "left").select(key, F.col("num").alias("paragraph_num"), "text_cree", "text_en", F.coalesce("footnote_en", F.lit("")).alias("footnote_en"))


def _with_class(tag: str, name: str) -> str:
    """Pattern of an opening tag that has the class."""
    return rf"""<{tag}\b(?=[^>]*\sclass\s*=\s*["']?(?:[^"'>]*\s)?{name}(?:[\s"'>]))[^>]*>"""


def dictionary_entries(html: Column | str) -> Column:
    """Array of struct(lemma, pos, pos_label, definitions) of a page of dictionary results.

    An entry is a list item of class search-results__result with a title heading; pos is the first
    word of the elaboration, pos_label the word class without signs, a definition the first text of
    an item of a list of meanings. Entries without lemma or definitions are left out; NULL gives NULL.
    """
    parts = F.slice(F.split(decoded(html), rf"(?i)(?={_with_class('li', 'search-results__result')})"), 2, 1 << 20)
    inner = lambda x, tag, name: F.regexp_extract(x, rf"(?is){_with_class(tag, name)}(.*?)</{tag}>", 1)

    def entry(x):
        elaboration = shown(tagless(F.regexp_extract(x, rf"(?is){_with_class('div', 'definition__elaboration')}((?:\s|<[^>]*>)*[^<]*)", 1)))
        lists = F.array_join(F.regexp_extract_all(x, F.lit(rf"(?is)({_with_class('ol', 'meanings')}.*?)</ol>"), F.lit(1)), " ")
        items = F.slice(F.split(lists, r"(?i)<li\b[^>]*>"), 2, 1 << 20)
        first = F.transform(items, lambda i: X.strip(shown(F.regexp_extract(i, r"^(?:\s|<[^>]*>)*([^<]+)", 1))))
        return F.struct(
            shown(tagless(inner(x, "h2", "definition-title__title"))).alias("lemma"),
            F.split_part(elaboration, F.lit(" "), F.lit(1)).alias("pos"),
            X.strip(F.regexp_replace(F.regexp_replace(shown(inner(x, "span", "wordclass")), r"<[^>]*>", ""), r"[^\p{L}\p{N}_\s-]", "")).alias("pos_label"),
            F.filter(first, lambda d: d != "").alias("definitions"),
        )

    return F.filter(F.transform(parts, entry), lambda e: (e["lemma"] != "") & (F.size(e["definitions"]) > 0))
