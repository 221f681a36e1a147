"""Duplicates hidden by formatting differences.

Method: canonicalize characters, case, white space, punctuation and field order, hash to 128 bits,
and aggregate counts with map-side combining and collision checks.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators.skew import attach
from glossmill.session import written

RANGES = ((0x00, 0x250), (0x1400, 0x1680), (0x2010, 0x2028), (0x2030, 0x205F))  # characters of most texts


def _same(c: str) -> bool:
    """Whether a text of such characters keeps its letters under normalization: the character is its own form and composes with none before it, or neither holds a letter, mark or number."""
    form = unicodedata.normalize("NFKC", c)
    kept = [unicodedata.category(x)[0] in "LMN" for x in (c, *form)]
    return (form == c and unicodedata.combining(c) == 0) or not any(kept)


@lru_cache(maxsize=1)
def plain_texts() -> str:
    """Pattern of the texts that need no normalizer: no character of theirs is changed by it, so every text has the normalizer's form."""
    codes = [c for a, b in RANGES for c in range(a, b) if _same(chr(c))]
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "^[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]*$"


def _nfkc(batches):
    for batch in batches:
        cols = [batch.column(0)]
        for c in (1, 2):
            cols.append(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in batch.column(c).to_pylist()], pa.string()))
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def letters(text: Column) -> Column:
    """Letters, digits and their diacritics of a text in order, in lower case; NULL counts as empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", "")
    return F.translate(bare, "ς", "σ")  # the lower case of this letter depends on what follows it


def canonical(df: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    """``row_id`` with the 128-bit key and a second, independent check hash of its canonical record."""
    rows = df.select(F.col(id_col).alias("row_id"), F.col(left).alias("l"), F.col(right).alias("r")).filter(F.col("row_id").isNotNull())
    plain = F.coalesce(F.col("l"), F.lit("")).rlike(plain_texts()) & F.coalesce(F.col("r"), F.lit("")).rlike(plain_texts())
    other = rows.filter(~plain).mapInArrow(_nfkc, rows.schema)
    both = rows.filter(plain).unionByName(other).select("row_id", letters(F.col("l")).alias("l"), letters(F.col("r")).alias("r"))
    record = F.concat_ws("\x1f", F.least("l", "r"), F.greatest("l", "r"))
    return both.select("row_id", F.unhex(F.md5(record)).alias("key"), F.xxhash64(record).alias("check"))


def groups(keyed: DataFrame) -> DataFrame:
    """One row per canonical record: first row_id, number of copies; keys that collide are kept apart by the check hash."""
    return keyed.groupBy("key", "check").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("copies"))


def collisions(keyed: DataFrame) -> DataFrame:
    """Keys shared by different records; empty unless two records collide in 128 bits."""
    return keyed.groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter(F.col("a") != F.col("b")).select(F.hex("key").alias("key"))


def collapse(df: DataFrame, id_col: str = "row_id", left: str = "text_cree", right: str = "text_en") -> DataFrame:
    """Each record once: ``row_id`` of its first copy and ``copies``.

    NULL equals empty. Records without any letter or digit are all the same empty record.
    Rows with a NULL id are left out. Other columns are ignored.
    """
    return groups(canonical(df, id_col, left, right)).select(F.col("first_row_id").alias("row_id"), "copies")


def members(df: DataFrame, id_col: str = "row_id", left: str = "text_cree", right: str = "text_en") -> DataFrame:
    """(first_row_id, copy_row_id) of every row that repeats another.

    Only hashes meet here. Records that hold a thousandth of all rows or more, at most a thousand,
    are joined by broadcast, so no task gets all copies of one record.
    """
    keyed = written(canonical(df, id_col, left, right))
    many = groups(keyed).filter(F.col("copies") > 1)
    hit = attach(keyed, many, ["key", "check"], "copies")
    return hit.filter(F.col("row_id") != F.col("first_row_id")).select("first_row_id", F.col("row_id").alias("copy_row_id"))
