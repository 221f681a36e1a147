"""Incremental, resumable labelling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators.pool import last_wins

Scorer = Callable[[str], tuple[str | None, str]]
# Words that mark a comparison, for the scorer that needs no model.
SIMILE_MARKS = ("like", "as if", "tâpiskôc")


def rule_scorer(prompt: str) -> tuple[str | None, str]:
    """Deterministic stand-in for a model: a marked comparison is a simile, anything else literal; an empty prompt fails."""
    if not prompt or not prompt.strip():
        return None, ""
    found = [m for m in SIMILE_MARKS if m in prompt.lower()]
    return ("simile", f"marked by {found[0]}") if found else ("literal", "nothing marked")


def cache_current(log: DataFrame, key: str, order: list[str], version: str | None = None) -> DataFrame:
    """Last entry of each key, of one version only where one is given."""
    return last_wins(log if version is None else log.filter(F.col("prompt_version").eqNullSafe(version)), [key], order)


def todo(pool: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows of the pool whose key the cache lacks."""
    return pool.join(cache.select(key).distinct(), key, "left_anti")


def attempted(rows: DataFrame, key: str, prompt: str, scorer: Scorer = rule_scorer, tries: int = 2) -> DataFrame:
    """Q04: (key, label, reasoning, error) by a scorer applied in the executors, tried again where it raises.

    A scorer that keeps raising leaves a NULL label and the name and message of its error; one that
    gives no label leaves the error "no label". Nothing is dropped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, p in zip(frame[key], frame[prompt], strict=True):
                label, why, error = None, "", None
                for _ in range(tries):
                    try:
                        label, why = scorer(p)
                        error = None if label is not None else "no label"
                        break
                    except Exception as problem:
                        error = f"{type(problem).__name__}: {problem}"
                out.append((k, label, why, error))
            yield pd.DataFrame(out, columns=[key, "label", "reasoning", "error"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, label string, reasoning string, error string")


def scored(rows: DataFrame, key: str, prompt: str, scorer: Scorer = rule_scorer) -> DataFrame:
    """(key, label, reasoning) of what got a label; the rest stays to be done."""
    return attempted(rows, key, prompt, scorer).filter(F.col("label").isNotNull()).drop("error")


def failures(rows: DataFrame, key: str, prompt: str, scorer: Scorer = rule_scorer) -> DataFrame:
    """(error, n): how many rows got no label, by reason."""
    return attempted(rows, key, prompt, scorer).filter(F.col("label").isNull()).groupBy("error").agg(F.count("*").alias("n"))


def resume(pool: DataFrame, cache: DataFrame, key: str, prompt: str, version: str, scorer: Scorer = rule_scorer) -> DataFrame:
    """New cache entries, with the version, for what the cache of that version lacks. Appending them and running again gives none."""
    current = cache.filter(F.col("prompt_version").eqNullSafe(version))
    return scored(todo(pool, current, key), key, prompt, scorer).withColumn("prompt_version", F.lit(version))


def joined_back(pool: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Pool rows with their label; rows without one are dropped."""
    return pool.join(cache.select(key, "label", "reasoning"), key)


def prompt(cree: str = "text_cree", en: str = "text_en"):
    """Prompt column of a sentence and its gloss."""
    return F.concat(F.lit("Cree sentence  : "), F.coalesce(cree, F.lit("")), F.lit("\nEnglish gloss  : "), F.coalesce(en, F.lit("")))


def entry_lines(entries):
    """Up to two entries with up to two definitions each, as one line."""
    return F.array_join(F.transform(F.slice(entries, 1, 2), lambda e: F.array_join(F.slice(e["definitions"], 1, 2), " / ")), "; ")


def version_of(text: str) -> str:
    """X19 on the driver."""
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:10]


