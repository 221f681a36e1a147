"""Runs of several steps, and commands from configurations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Options of each stage and their flags.
FLAGS = {
    "calibrate": {"learning_rate": "--calibrate-lr", "epochs": "--calibrate-epochs", "literal_ratio": "--literal-ratio"},
    "clkd": {"learning_rate": "--clkd-lr", "epochs": "--clkd-epochs", "temperature": "--clkd-temperature", "freeze_n_layers": "--freeze-layers"},
    "tlm": {"learning_rate": "--tlm-lr", "epochs": "--tlm-epochs", "batch_size": "--batch-size", "grad_accum": "--grad-accum", "sentences_file": "--sentences-file"},
    "pipeline": {
        "clkd_lr": "--clkd-lr", "clkd_epochs": "--clkd-epochs", "clkd_temperature": "--clkd-temperature", "clkd_freeze_layers": "--freeze-layers",
        "calibrate_lr": "--calibrate-lr", "calibrate_epochs": "--calibrate-epochs", "calibrate_literal_ratio": "--literal-ratio",
    },
}


def run_steps(spark: SparkSession, steps: list[tuple[str, Callable[[], object]]], skip: tuple[str, ...] = ()) -> DataFrame:
    """(step, name, status, error) after running each step once; a failure is reported and stops no other step."""
    out = []
    for i, (name, step) in enumerate(steps):
        status, error = "SKIPPED", None
        if name not in skip:
            try:
                step()
                status = "OK"
            except Exception as problem:
                status, error = "FAILED", type(problem).__name__
        out.append((i, name, status, error))
    return spark.createDataFrame(out, "step int, name string, status string, error string")


def stage(config: Column) -> Column:
    """Stage that a configuration (a map of texts) belongs to, by its keys."""
    has = lambda *keys: F.arrays_overlap(F.map_keys(config), F.array(*map(F.lit, keys)))
    return F.when(has("clkd_lr", "calibrate_lr"), "pipeline").when(has("literal_ratio"), "calibrate").when(has("temperature", "freeze_n_layers"), "clkd").otherwise("tlm")


def command(config: Column, base: str = "run") -> Column:
    """Command line of a configuration: the flags of its stage, in their stated order, for the keys that it has."""
    kind, line = stage(config), None
    for name, flags in FLAGS.items():
        words = [F.when(F.map_contains_key(config, k), F.concat(F.lit(f" {flag} "), F.element_at(config, k))) for k, flag in flags.items()]
        text = F.concat(F.lit(base), *(F.coalesce(w, F.lit("")) for w in words))
        line = F.when(kind == name, text) if line is None else line.when(kind == name, text)
    return line


def best_of(runs: DataFrame, metric: str, higher: bool = True) -> DataFrame:
    """(name, config, value, n_runs) of the best run that has ended (state finished or crashed); one without the metric is worse than any other, ties go to the first name.

    ``runs`` has name, state, config and summary (maps). Without such a run the result is empty.
    """
    done = runs.filter(F.col("state").isin("finished", "crashed")).select("name", "config", F.element_at("summary", metric).cast("double").alias("value"))
    worse = F.coalesce(-F.col("value") if higher else F.col("value"), F.lit(float("inf")))
    best = done.agg(F.min_by(F.struct("name", "config", "value"), F.struct(worse, "name")).alias("b"), F.count("*").alias("n_runs")).filter(F.col("n_runs") > 0)
    return best.select("b.name", "b.config", "b.value", "n_runs")
