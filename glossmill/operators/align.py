"""Length-based alignment of sentence lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.functions import text as X
from glossmill.session import written

# Spans that one step may join, in the order in which ties are decided.
STEPS = ((1, 1), (2, 1), (1, 2), (3, 1), (1, 3))
CELLS = 4_000_000  # of the tables that are filled together


def _conf(s: float, t: float) -> float:
    return round(max(0.0, 1 - abs(s - t) / max(s, t, 1e-9)), 3)


def _choices(src: np.ndarray, tgt: np.ndarray) -> np.ndarray | None:
    """Step into every cell (paragraphs, n + 1, m + 1) of the cheapest path, for paragraphs of one size; None where no path exists.

    ``src`` and ``tgt`` hold running sums of lengths. Every step goes at least one sentence ahead on
    the source side, so a row of cells follows from the three before it, for all targets at once.
    """
    count, n, m = len(src), src.shape[1] - 1, tgt.shape[1] - 1
    whole = src[:, -1:].astype(np.float64), tgt[:, -1:].astype(np.float64)
    rows = [np.full((count, m + 1), np.inf)]
    rows[0][:, 0] = 0.0
    steps = np.full((count, n + 1, m + 1), -1, np.int8)
    parts = {b: (tgt[:, b:] - tgt[:, : m + 1 - b]) / whole[1] for _, b in STEPS if b <= m}
    for i in range(1, n + 1):
        row = np.full((count, m + 1), np.inf)
        for k, (a, b) in enumerate(STEPS):
            if a > i or b > m:
                continue
            own = (src[:, i : i + 1] - src[:, i - a : i - a + 1]) / whole[0]
            cost = rows[-a][:, : m + 1 - b] + (own - parts[b]) ** 2
            less = cost < row[:, b:]
            np.copyto(row[:, b:], cost, where=less)
            steps[:, i, b:][less] = k
        rows = [*rows[-2:], row]
    return steps if np.isfinite(rows[-1][0, m]) else None


def align_many(src: list[list[str]], tgt: list[list[str]]) -> list[list[tuple[str, str, float]]]:
    """Alignments of many paragraphs; those with as many sentences on both sides are solved together."""
    out: list[list[tuple[str, str, float]]] = [[] for _ in src]
    same: dict[tuple[int, int], list[int]] = {}
    for k, (s, t) in enumerate(zip(src, tgt, strict=True)):
        if s and t:
            same.setdefault((len(s), len(t)), []).append(k)
    sums = lambda texts: np.cumsum([[0, *(max(len(x), 1) for x in row)] for row in texts], axis=1)
    for (n, m), all_ in same.items():
        each = max(1, CELLS // ((n + 1) * (m + 1)))
        for at in range(0, len(all_), each):
            own = all_[at : at + each]
            a, b = sums([src[k] for k in own]), sums([tgt[k] for k in own])
            steps = _choices(a, b)
            for r, k in enumerate(own):
                if steps is None:
                    out[k] = [(" ".join(src[k]), " ".join(tgt[k]), 0.0)]
                    continue
                i, j, path = n, m, []
                while i:
                    di, dj = STEPS[steps[r, i, j]]
                    s, t = src[k][i - di : i], tgt[k][j - dj : j]
                    path.append((" ".join(s), " ".join(t), _conf((a[r, i] - a[r, i - di]) / a[r, n], (b[r, j] - b[r, j - dj]) / b[r, m])))
                    i, j = i - di, j - dj
                out[k] = path[::-1]
    return out


def align_lists(src: list[str], tgt: list[str]) -> list[tuple[str, str, float]]:
    """Monotone alignment that minimises squared differences of length shares.

    Every step joins 1 to 3 sentences of one side with 1 of the other. Where the counts allow no
    such path, all sentences make one pair of confidence 0. Empty lists give none.
    """
    return align_many([src], [tgt])[0]


def _aligned(batches):
    for batch in batches:
        found = align_many(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = [p for one in found for p in one]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))),
                pa.array(np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)),
                pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.string()), pa.array([float(p[2]) for p in flat], pa.float64()),
            ],
            names=[batch.schema.names[0], "sentence_id", "src", "tgt", "conf"],
        )


def split_and_align(rows: DataFrame, key: str, left: str, right: str, least: int = 20) -> DataFrame:
    """(key, sentence_id, src, tgt, conf) of paragraphs split into sentences.

    Equal counts are zipped inside the JVM and scored by M01; only the others go to the aligner.
    The ordinal is given before pairs with a side shorter than ``least`` are dropped, so gaps stay.
    NULL sides and sides without sentences give nothing.
    """
    base = rows.select(F.col(key), X.sentences_kept(F.col(left)).alias("s"), X.sentences_kept(F.col(right)).alias("t")).filter((F.size("s") > 0) & (F.size("t") > 0))
    size = lambda a: F.nullif(F.aggregate(a, F.lit(0), lambda x, y: x + F.length(y)), F.lit(0))
    # Lengths are summed once for a paragraph, before its pairs are scored.
    equal = base.filter(F.size("s") == F.size("t")).withColumns({"ls": size(F.col("s")), "lt": size(F.col("t"))})
    pairs = equal.select(key, F.posexplode(F.arrays_zip("s", "t")).alias("sentence_id", "x"), "ls", "lt")
    s, t = F.length("x.s") / F.coalesce("ls", F.lit(1)), F.length("x.t") / F.coalesce("lt", F.lit(1))
    conf = X.round_at(1 - F.abs(s - t) / F.greatest(s, t, F.lit(1e-9)), 3)
    direct = pairs.select(key, F.col("sentence_id").cast("bigint").alias("sentence_id"), F.col("x.s").alias("src"), F.col("x.t").alias("tgt"), conf.alias("conf"))
    others = base.filter(F.size("s") != F.size("t")).mapInArrow(_aligned, f"`{key}` {dict(rows.dtypes)[key]}, sentence_id bigint, src string, tgt string, conf double")
    return direct.unionByName(others).filter((F.length("src") >= least) & (F.length("tgt") >= least))


def paragraph_pairs(stories: DataFrame, key: str, left: str, right: str, apart: int = 10) -> DataFrame:
    """Paragraphs of two arrays paired by position, stories left out whose numbers of paragraphs differ by more than ``apart``."""
    ok = stories.filter((F.size(left) > 0) & (F.size(right) > 0) & (F.abs(F.size(left) - F.size(right)) <= apart))
    n = F.least(F.size(left), F.size(right))
    pairs = ok.select(key, F.posexplode(F.arrays_zip(F.slice(F.col(left), F.lit(1), n).alias("l"), F.slice(F.col(right), F.lit(1), n).alias("r"))).alias("pos", "p"))
    return pairs.select(key, F.col("pos").cast("bigint").alias("pos"), F.col("p.l").alias("left_text"), F.col("p.r").alias("right_text"))


def positional_pairs(rows: DataFrame, key: str, order: str, side: Column, text: str, apart: int = 10) -> DataFrame:
    """L04 over rows in place of arrays: (key, pos, left_text, right_text), for stories that may hold a third of all rows.

    ``side`` is true for rows of the left, false for those of the right and NULL for neither. Stories
    whose sides are empty or differ by more than ``apart`` rows are left out by their counts alone;
    rows are numbered bucket by bucket of their order values, which must be unique and not NULL.
    """
    given = rows.select(key, order, side.alias("gm_left"), text).filter(F.col("gm_left").isNotNull() & F.col(key).isNotNull())
    sizes = given.groupBy(key).agg(F.count_if("gm_left").alias("a"), F.count_if(~F.col("gm_left")).alias("b"))
    good = sizes.filter((F.col("a") > 0) & (F.col("b") > 0) & (F.abs(F.col("a") - F.col("b")) <= apart)).select(key)
    numbered = written(ranked_by(given.join(good, key, "left_semi"), [key, "gm_left"], order))
    one, other = numbered.filter("gm_left"), numbered.filter(~F.col("gm_left"))
    return one.select(key, "pos", F.col(text).alias("left_text")).join(other.select(key, "pos", F.col(text).alias("right_text")), [key, "pos"])


def ranked_by(rows: DataFrame, keys: list[str], order: str, bucket: int = 4096) -> DataFrame:
    """Rows with ``pos``, their number from 0 in the order of a whole-number column within their key.

    Order values are cut into runs of ``bucket`` values; rows are sorted inside one run of one key,
    and numbers go on over the running sums of a small table of run sizes.
    """
    cut_ = rows.withColumn("gm_run", F.floor(F.col(order) / bucket))
    sizes = cut_.groupBy(*keys, "gm_run").agg(F.count("*").alias("gm_n"))
    before = sizes.select(*keys, "gm_run", (F.sum("gm_n").over(Window.partitionBy(*keys).orderBy("gm_run")) - F.col("gm_n")).alias("gm_before"))
    w = Window.partitionBy(*keys, "gm_run").orderBy(order)
    return cut_.join(before, [*keys, "gm_run"]).withColumn("pos", F.row_number().over(w) - 1 + F.col("gm_before")).drop("gm_run", "gm_before")
