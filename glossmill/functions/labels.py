"""Label expressions: the four classes, their two normalizers, and parsing of scorer answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import strip

LABELS = ("literal", "idiom", "metaphor", "simile")
_JSON = "array<struct<sentence_num:int,label:string,footnote_applies:boolean,rationale:string>>"


def merged(label: Column) -> Column:
    """None counts as literal, proverb as idiom, anything else unknown, NULL included, as literal."""
    x = F.lower(strip(label))
    return F.when(x.isin("idiom", "proverb"), "idiom").when(x.isin("metaphor", "simile"), x).otherwise("literal")


def strict(label: Column) -> Column:
    """One of the four labels, any other text literal; rows with NULL labels are to be dropped before."""
    x = F.lower(strip(label))
    return F.when(label.isNotNull(), F.when(x.isin(*LABELS), x).otherwise("literal"))


def code(label: Column) -> Column:
    """P20: position of the label from 0, 0 for an unknown or NULL one."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LABELS)), label), F.lit(0)) - 1, F.lit(0)).cast("int")


def parsed(answer: Column) -> Column:
    """The label of the first line that starts with label:, NULL unless it is one of the four."""
    found = F.lower(strip(F.regexp_extract(answer, r"(?im)^\s*label:(.*)$", 1)))
    return F.when(found.isin(*LABELS), found)


def salvaged(raw: Column) -> Column:
    """Annotations of an answer: a JSON array, else every flat object that can be found in it."""
    whole = F.from_json(raw, _JSON)
    flat = F.transform(F.regexp_extract_all(raw, F.lit(r"(\{[^{}]+\})"), F.lit(1)), lambda x: F.from_json(x, _JSON.removeprefix("array<").removesuffix(">")))
    return F.when(F.size(F.filter(F.coalesce(whole, F.array()), lambda x: x["label"].isNotNull())) > 0, whole).otherwise(flat)
