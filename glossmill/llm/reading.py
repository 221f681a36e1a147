"""Reading level of each document.

Method: classic readability formulas (Flesch-Kincaid, Gunning fog, SMOG, automated readability
index, Coleman-Liau) from sentence length and syllable counts by hyphenation-style rules, combined
by the median of their grade estimates. A formula adds up a sentence term and a word term; long
everyday words in short sentences and rare short words in long ones can have the same sum, so each
formula's grade is read off the plane of its two terms, where labelled documents of one grade lie
together, and not off a scale of sums. The document's grade is the median of the five grades.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import written

MAX_LABELS = 2_000  # labelled documents that the others are held against, the first in hashed order
NEIGHBOURS, FORMULAS = 5, 5
GRADES = 5
# Frequent function words of English, by which documents without language are told.
FUNCTION_WORDS = frozenset(
    "the a an of and to in it is was he she they that this by for with on at from as but so or not be were which when while because before after "
    "although since until near its his her their had has have who under over into".split()
)
_WORDS = r"(?U)\p{L}[\p{L}\p{M}'’]*"
# Endings that carry no syllable of their own, and vowel pairs that carry two.
_SILENT = re.compile(r"(?:[^laeiouy]e|[^aeiouytd]ed|[^aeiouyszxcg]es)$")
_TWO = re.compile(r"ia|io(?!n|us)|eo|iu|ua(?!r)|uou|ying|eing|ism$")
_VOWELS = re.compile(r"[aeiouy]+")


def syllables(word: str) -> int:
    """Syllables of a lower-case word: groups of vowels, without silent endings, with vowel pairs that are spoken apart; at least 1."""
    n = len(_VOWELS.findall(word))
    if n > 1 and _SILENT.search(word):
        n -= 1
    return max(1, n + len(_TWO.findall(word)))


def _counts(batches):
    for batch in batches:
        words = batch.column(2)
        n = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        facts = np.array([(len(w), s := syllables(w), s > 2, w in FUNCTION_WORDS) for w in vocabulary], np.int64).reshape(-1, 4)
        rows = facts[np.asarray(coded.indices)] if len(vocabulary) else np.zeros((0, 4), np.int64)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(rows, axis=0)])
        ends = np.cumsum(n)
        per = sums[ends] - sums[ends - n]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(n), *(pa.array(per[:, k]) for k in range(4))], names=_NAMES)


_NAMES = ["doc_id", "lang", "sentences", "words", "letters", "syllables", "long_words", "function_words"]


def measures(docs: DataFrame) -> DataFrame:
    """Per document: language, words, sentences, five grade estimates and their median (both NULL without words).

    Line ends that end no sentence, page numbers and invisible characters do not count. A NULL or
    empty text has no words. Documents with a NULL id are left out.
    """
    text = F.regexp_replace(F.regexp_replace(F.col("text"), r"[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]", ""), r"(?m)^[ \t]*\d+[ \t]*$", " ")
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "lang", F.lower(text).alias("t"))
    ends = F.greatest(F.lit(1), F.regexp_count("t", F.lit(r"(?U)\p{L}[\p{L}\p{M}]+[\"'”’»)\]]*[.!?…]+(?=[\"'”’»)\]]*(?:\s|$))")))
    rows = rows.select("doc_id", "lang", F.regexp_extract_all("t", F.lit(_WORDS), F.lit(0)).alias("w"), ends.alias("sentences"))
    types = "doc_id bigint, lang string, sentences int, words bigint, letters bigint, syllables bigint, long_words bigint, function_words bigint"
    c = rows.mapInArrow(_counts, types)
    w, s = F.nullif(F.col("words"), F.lit(0)).cast("double"), F.col("sentences").cast("double")
    terms = [
        (0.39 * w / s, 11.8 * F.col("syllables") / w, -15.59),
        (0.4 * w / s, 40 * F.col("long_words") / w, 0.0),
        (1.043 * F.sqrt(F.col("long_words") * 30 / s), F.lit(0.0), 3.1291),
        (0.5 * w / s, 4.71 * F.col("letters") / w, -21.43),
        (-29.6 * s / w, 5.88 * F.col("letters") / w, -15.8),
    ]
    english = F.coalesce(F.col("lang") == "en", F.col("function_words") >= 0.15 * F.col("words")) & (F.col("words") > 0)
    estimates = F.when(F.col("words") > 0, F.array(*(a + b + c for a, b, c in terms)))
    flat = F.when(F.col("words") > 0, F.array(*(x for a, b, _ in terms for x in (a, b))))
    return c.select("doc_id", english.alias("english"), "words", "sentences", flat.alias("terms"), estimates.alias("estimates"), F.element_at(F.array_sort(estimates), 3).alias("score"))


def grades_of(terms: np.ndarray, points: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Grade of each row of terms (rows, formulas, 2): the median over formulas of the median grade of the labelled documents nearest in the formula's plane."""
    near = min(NEIGHBOURS, len(grades))
    each = np.empty((len(terms), FORMULAS))
    for j in range(FORMULAS):
        mine = points[:, j]
        squares = (mine**2).sum(axis=1)
        far = squares[None, :] - 2 * terms[:, j] @ mine.T
        closest = np.argpartition(far, near - 1, axis=1)[:, :near]
        each[:, j] = np.floor(np.median(grades[closest], axis=1) + 0.5)
    return np.floor(np.median(each, axis=1) + 0.5).astype(np.int32)


def _graded(shared):
    def run(batches):
        points, grades, mean, scale = shared.value
        for batch in batches:
            known = np.asarray(batch.column(2).is_valid())
            rows = (np.asarray(batch.column(2).flatten()).reshape(-1, FORMULAS, 2) - mean) / scale
            level = np.zeros(batch.num_rows, np.int32)
            level[known] = np.concatenate([grades_of(rows[k : k + 1024], points, grades) for k in range(0, len(rows), 1024)] or [np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(level, mask=~known)], names=["doc_id", "english", "score", "grade"])

    return run


def levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, english, score, grade 1 to 5) of each document; score and grade are NULL for documents without words.

    Labelled documents are a bounded sample of the English ones. Without any labels the grades are NULL.
    """
    spark = docs.sparkSession
    found = written(measures(docs))
    sample = labels.filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).select("doc_id", "grade").distinct().orderBy(F.xxhash64("doc_id", "grade"), "doc_id").limit(MAX_LABELS)
    known = found.filter("english").join(F.broadcast(sample), "doc_id").select("terms", "grade").collect()
    if not known:
        return found.select("doc_id", "english", "score", F.lit(None).cast("int").alias("grade"))
    points = np.array([r[0] for r in known], np.float64).reshape(-1, FORMULAS, 2)
    mean, scale = points.mean(axis=0), np.maximum(points.std(axis=0), 1e-6)
    shared = spark.sparkContext.broadcast(((points - mean) / scale, np.array([r[1] for r in known], np.float64), mean, scale))
    return found.select("doc_id", "english", "terms", "score").mapInArrow(_graded(shared), "doc_id bigint, english boolean, score double, grade int")
