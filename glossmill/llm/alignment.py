"""Sentence alignment in bilingual documents.

Method: entropic optimal transport between sentence vectors with null masses. Cree and English
sentences get vectors over the same features: English content words, reached from Cree through the
stems of a dictionary, and names and numbers that both sides share; features are weighted by inverse
document frequency. Sinkhorn scaling runs for all paragraphs of a batch that have the same size at
once; the transport is then turned into links, so omissions, merges and reordering come out alike.
The transport of a very long paragraph is solved over its sparse pairs, found by a join on features.
"""

from __future__ import annotations

import math
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.confusables import consistent
from glossmill.session import cut, written

MAX_DICTIONARY = 100_000  # dictionary rows; a resource of fixed size, held by every worker
EPSILON, NULL_COST, ROUNDS = 0.08, 0.36, 40
MASS, COSINE = 0.2, 0.3  # least transported mass and cosine of a link
LONG = 1024  # rows of a paragraph beyond which its transport is not held as one matrix; the links are the same

# English words without content of their own.
STOP = frozenset("the a an of to it its someone something s he she they his her their and so that but because while although until then than this there here is was were be been one's as or not".split())
# Consonants of the syllabic rows in their order of vowels e, i, o, a, and the finals.
_ROWS = {"": "ᐁᐃᐅᐊ", "p": "ᐯᐱᐳᐸ", "t": "ᑌᑎᑐᑕ", "k": "ᑫᑭᑯᑲ", "c": "ᒉᒋᒍᒐ", "m": "ᒣᒥᒧᒪ", "n": "ᓀᓂᓄᓇ", "s": "ᓭᓯᓱᓴ", "y": "ᔦᔨᔪᔭ", "r": "ᕃᕆᕈᕋ", "l": "ᓓᓕᓗᓚ"}
_FINALS = {"ᐟ": "t", "ᐠ": "k", "ᐢ": "s", "ᐣ": "n", "ᐤ": "w", "ᐦ": "h", "ᐧ": "w", "ᐨ": "c", "ᐩ": "y", "ᑊ": "p", "ᒼ": "m", "ᕀ": "y", "ᕽ": "hk", "᙮": "."}
_ROMAN = str.maketrans({c: row + v for row, cs in _ROWS.items() for c, v in zip(cs, "eioa", strict=True)} | _FINALS)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_UNIT = re.compile(r"(?<=[.!?᙮…])[\"'”’»)\]]*\s+")
_ODD = re.compile(r"[^\x00-\x7fÀ-ſ᐀-ᙿ]")


def fold(text: str) -> str:
    """Roman letters without case and diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.translate(_ROMAN)) if not unicodedata.combining(c)).lower()


def stem(word: str, past: dict[str, str]) -> str:
    if word in past:
        return past[word]
    for end in ("ied", "ies"):
        if word.endswith(end) and len(word) > 4:
            return word[:-3] + "y"
    for end in ("ing", "ed", "es", "s", "e"):
        if word.endswith(end) and len(word) - len(end) > 2 and not word.endswith("ss"):
            word = word[: -len(end)]
            return word[:-1] if len(word) > 3 and word[-1] == word[-2] and word[-1] not in "ls" else word
    return word


class Lexicon:
    """Features of words of both languages, from a dictionary of (lemma, part of speech, definitions)."""

    def __init__(self, entries: list[tuple[str, str, tuple[str, ...]]]):
        self.past: dict[str, str] = {}
        for _, _, definitions in entries:
            base = {x[0] for d in definitions if (x := d.lower().removeprefix("to ").split()) and not d.lower().startswith("s/he ")}
            told = {x[0] for d in definitions if d.lower().startswith("s/he ") and (x := d.lower().removeprefix("s/he ").split())}
            if len(base) == 1 and len(told) == 1:
                self.past[told.pop()] = base.pop()
        self.past = {a: stem(b, {}) for a, b in self.past.items()}
        stems: dict[str, dict[str, float]] = {}
        seen: dict[str, set] = {}
        for lemma, pos, definitions in entries:
            s = fold(lemma)
            s = s[:-2] if pos == "V" and s.endswith("ew") else s
            if len(s) < 2:
                continue
            for d in definitions:
                words = {stem(w, self.past) for w in re.findall(r"[a-z]+", d.lower().replace("s/he", " ")) if w not in STOP}
                if words:
                    seen.setdefault(s, set()).add(frozenset(words))
        for s, variants in seen.items():
            total: dict[str, float] = {}
            for words in variants:
                for w in words:
                    total[w] = total.get(w, 0.0) + 1.0 / len(variants)
            stems[s] = total
        self.stems = stems
        self.automaton = ahocorasick.Automaton()
        for s in stems:
            self.automaton.add_word(s, s)
        self.automaton.make_automaton()
        self.vocabulary = {w for t in stems.values() for w in t}
        self._cree: dict[str, tuple] = {}
        self._english: dict[str, tuple] = {}

    def cree(self, word: str) -> tuple[tuple[str, float], ...]:
        got = self._cree.get(word)
        if got is None:
            w = fold(word)
            if w.isdigit():
                got = (("#" + w, 1.0),)
            else:
                best = max((len(s), s) for s in (*(s for _, s in self.automaton.iter(w)), ""))[1] if len(self.stems) else ""
                if w in self.stems:
                    best = w
                if len(best) >= 2 and 2 * len(best) >= len(w):
                    got = tuple(self.stems[best].items())
                elif len(w) > 3 and word[0].isupper():
                    got = (("@" + w, 1.0),)
                else:
                    got = ()
            if len(self._cree) > 300_000:
                self._cree.clear()
            self._cree[word] = got
        return got

    def english(self, word: str) -> tuple[tuple[str, float], ...]:
        got = self._english.get(word)
        if got is None:
            w = word.lower()
            s = stem(w, self.past)
            if w.isdigit():
                got = (("#" + w, 1.0),)
            elif w in STOP:
                got = ()
            elif s in self.vocabulary:
                got = ((s, 1.0),)
            elif len(w) > 3 and word[0].isupper():
                got = (("@" + fold(word), 1.0),)
            else:
                got = ((s, 1.0),)
            if len(self._english) > 300_000:
                self._english.clear()
            self._english[word] = got
        return got


def units(text: str | None) -> list[str]:
    """The sentences that one stored text holds."""
    return [u for u in _UNIT.split(text) if u.strip()] if text else []


def vector(text: str, look, idf: dict[str, float], rare: float) -> dict[str, float]:
    v: dict[str, float] = {}
    for word in _WORD.findall(text):
        for f, w in look(word):
            v[f] = v.get(f, 0.0) + w
    total = 0.0
    for f, w in v.items():
        v[f] = w = w * idf.get(f, rare)
        total += w * w
    if total:
        scale = 1.0 / math.sqrt(total)
        for f in v:
            v[f] *= scale
    return v


def cosines(left: list[dict[str, float]], right: list[dict[str, float]]) -> list[list[float]]:
    """Products of unit vectors of both sides, by inverted lists of the features of the right side."""
    lists: dict[str, list[tuple[int, float]]] = {}
    for j, y in enumerate(right):
        for f, w in y.items():
            lists.setdefault(f, []).append((j, w))
    out = [[0.0] * len(right) for _ in left]
    for row, x in zip(out, left, strict=True):
        for f, w in x.items():
            for j, u in lists.get(f, ()):
                row[j] += w * u
    return out


def transport(cosines: np.ndarray) -> np.ndarray:
    """Entropic transport plans of a stack of cosine matrices (k, n, m), each with a null row and a null column that take up what has no partner.

    Cosines below that of a link count as 0, as they do for :func:`sparse_links`, so both give the same links.
    """
    k, n, m = cosines.shape
    cost = np.full((k, n + 1, m + 1), NULL_COST)
    cost[:, :n, :m] = 1.0 - np.where(cosines >= COSINE, cosines, 0.0)
    cost[:, n, m] = 0.0
    kernel = np.exp(-cost / EPSILON)
    a, b = np.ones((k, n + 1)), np.ones((k, m + 1))
    a[:, n], b[:, m] = m, n
    v = np.ones((k, m + 1))
    for _ in range(ROUNDS):
        u = a / np.maximum(np.einsum("knm,km->kn", kernel, v), 1e-300)
        v = b / np.maximum(np.einsum("knm,kn->km", kernel, u), 1e-300)
    return (u[:, :, None] * kernel * v[:, None, :])[:, :n, :m]


def _aligner(shared):
    state: dict = {}

    def run(batches):
        entries, idf, rare = shared.value
        lexicon = state.get("lexicon") or state.setdefault("lexicon", Lexicon(entries))
        for batch in batches:
            paragraphs = batch.column(0).to_pylist()
            sids, crees, ens = (batch.column(i) for i in (1, 2, 3))
            found: dict[tuple[int, int], list] = {}
            for p, ids, cs, es in zip(paragraphs, sids.to_pylist(), crees.to_pylist(), ens.to_pylist(), strict=True):
                left = sorted({(i, u) for i, c in zip(ids, cs, strict=True) if c for u in units(consistent(c) if _ODD.search(c) else c)})
                right = sorted({(i, u) for i, e in zip(ids, es, strict=True) if e for u in units(e)})
                if not left or not right:
                    continue
                lv = [vector(u, lexicon.cree, idf, rare) for _, u in left]
                rv = [vector(u, lexicon.english, idf, rare) for _, u in right]
                cos = cosines(lv, rv)
                found.setdefault((len(left), len(right)), []).append((p, [i for i, _ in left], [i for i, _ in right], cos))
            out: set[tuple[int, int, int]] = set()
            for same in found.values():
                step = max(1, 2_000_000 // (len(same[0][1]) * len(same[0][2])))
                for start in range(0, len(same), step):
                    part = same[start : start + step]
                    cos = np.array([x[3] for x in part])
                    plan = transport(cos)
                    for k, i, j in zip(*np.nonzero((plan >= MASS) & (cos >= COSINE)), strict=True):
                        p, left, right, _ = part[k]
                        if left[i] != right[j]:
                            out.add((p, left[i], right[j]))
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.int64()) for x in range(3)], names=["paragraph_id", "cree_sentence_id", "en_sentence_id"])

    return run


def _units(batches):
    for batch in batches:
        out = [
            (p, i, side, u)
            for p, i, c, e in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for side, text in ((0, consistent(c) if c and _ODD.search(c) else c), (1, e))
            for u in units(text)
        ]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["p", "sid", "side", "unit"])


def _features(shared):
    state: dict = {}

    def run(batches):
        entries, idf, rare = shared.value
        lexicon = state.get("lexicon") or state.setdefault("lexicon", Lexicon(entries))
        for batch in batches:
            names, weights, rest = [], [], []
            for side, unit in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                v = vector(unit, lexicon.english if side else lexicon.cree, idf, rare)
                order = sorted(v, key=lambda f: (-idf.get(f, rare), f))  # one order for all texts, rare features first
                norms = dict(zip(order, np.sqrt(np.cumsum(np.array([v[f] for f in order])[::-1] ** 2)[::-1]), strict=True))
                names.append(list(v))
                weights.append(list(v.values()))
                rest.append([norms[f] for f in v])
            lists = [pa.array(names, pa.list_(pa.string())), *(pa.array(x, pa.list_(pa.float64())) for x in (weights, rest))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *lists], names=["node", "p", "sid", "side", "names", "weights", "rest"])

    return run


def _kernel(batches):
    for batch in batches:
        xn, xw, yn, yw = (batch.column(k).to_pylist() for k in range(5, 9))
        cos = []
        for a, u, b, v in zip(xn, xw, yn, yw, strict=True):
            other, c = dict(zip(b, v, strict=True)), 0.0
            for f, w in zip(a, u, strict=True):  # added in the order of cosines(), so that a cosine is the same number
                c += w * other.get(f, 0.0)
            cos.append(c)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(cos, pa.float64())], names=["p", "x", "y", "i", "j", "cosine"])


def sparse_links(rows: DataFrame, shared) -> DataFrame:
    """Links of very long paragraphs, whose partners may stand anywhere in them.

    Pairs with the least cosine of a link are found by a join on features, pruned by residual norms.
    All other pairs have the kernel of cosine 0, here as in :func:`transport`, which needs only sums over the paragraph, so Sinkhorn
    scaling runs over the found pairs alone. Texts without such a pair share one scaling.
    """
    cells = rows.distinct().mapInArrow(_units, "p bigint, sid bigint, side int, unit string").distinct()
    cells = cells.select(F.xxhash64("p", "sid", "side", "unit").alias("node"), "p", "sid", "side", "unit")
    nodes = written(cells.mapInArrow(_features(shared), "node bigint, p bigint, sid bigint, side int, names array<string>, weights array<double>, rest array<double>"))
    at = nodes.select("node", "p", "side", F.posexplode("names").alias("k", "name"), "rest").select("node", "p", "side", "name", F.get("rest", F.col("k")).alias("rest")).filter(F.col("rest") >= COSINE - 1e-9)
    one, other = at.filter(F.col("side") == 0).alias("a"), at.filter(F.col("side") == 1).alias("b")
    met = one.join(other, (F.col("a.p") == F.col("b.p")) & (F.col("a.name") == F.col("b.name")) & (F.col("a.rest") * F.col("b.rest") >= COSINE - 1e-9))
    met = met.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()
    side = lambda k, c, i: nodes.filter(F.col("side") == k).select(F.col("node").alias(c), "p" if k == 0 else F.col("p").alias("q"), F.col("sid").alias(i), F.col("names").alias(f"{c}n"), F.col("weights").alias(f"{c}w"))
    met = met.join(side(0, "x", "i"), "x").join(side(1, "y", "j"), "y").select("p", "x", "y", "i", "j", "xn", "xw", "yn", "yw")
    edges = met.mapInArrow(_kernel, "p bigint, x bigint, y bigint, i bigint, j bigint, cosine double").filter(F.col("cosine") >= COSINE)
    ground, null = math.exp(-1.0 / EPSILON), math.exp(-NULL_COST / EPSILON)
    edges = written(edges.withColumn("k", F.exp((F.col("cosine") - 1.0) / EPSILON) - ground))
    linked = edges.groupBy("p").agg(F.count_distinct("x").alias("lx"), F.count_distinct("y").alias("ly"))
    sizes = nodes.groupBy("p").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m")).join(linked, "p")
    # Of each long paragraph that has links: sizes, texts without links, and the scalings of its null column and free texts.
    state = {r["p"]: {"n": r["n"], "m": r["m"], "fx": r["n"] - r["lx"], "fy": r["m"] - r["ly"]} for r in sizes.collect()}
    for z in state.values():
        z |= {"sum": float(z["m"]), "null": 1.0}
    spark = rows.sparkSession
    scale = edges.select("p", F.col("y").alias("node")).distinct().withColumn("w", F.lit(1.0))
    kept = {}
    for step in range(2 * ROUNDS):
        mine, theirs = ("x", "y") if step % 2 == 0 else ("y", "x")
        size, free = ("m", "fx") if step % 2 == 0 else ("n", "fy")
        base = spark.createDataFrame([(p, ground * z["sum"] + null * z["null"]) for p, z in state.items()], "p bigint, base double")
        sums = edges.join(scale.select(F.col("node").alias(theirs), "w"), theirs).groupBy("p", mine).agg(F.sum(F.col("k") * F.col("w")).alias("s"))
        scale = cut(sums.join(F.broadcast(base), "p").select("p", F.col(mine).alias("node"), (1.0 / F.greatest(F.col("s") + F.col("base"), F.lit(1e-300))).alias("w")))
        kept[mine] = scale
        total = {r["p"]: r["w"] for r in scale.groupBy("p").agg(F.sum("w").alias("w")).collect()}
        for p, z in state.items():
            own_null = z[size] / max(null * z["sum"] + z["null"], 1e-300)
            z["sum"], z["null"] = total[p] + z[free] / max(ground * z["sum"] + null * z["null"], 1e-300), own_null
    if not state:
        return edges.select(F.col("p").alias("paragraph_id"), F.col("i").alias("cree_sentence_id"), F.col("j").alias("en_sentence_id"))
    planned = edges.join(kept["x"].select(F.col("node").alias("x"), F.col("w").alias("u")), "x").join(kept["y"].select(F.col("node").alias("y"), F.col("w").alias("v")), "y")
    links = planned.filter((F.col("u") * (F.col("k") + ground) * F.col("v") >= MASS) & (F.col("i") != F.col("j")))
    return links.select(F.col("p").alias("paragraph_id"), F.col("i").alias("cree_sentence_id"), F.col("j").alias("en_sentence_id")).distinct()


def lexicon_entries(dictionary: DataFrame) -> list[tuple[str, str, tuple[str, ...]]]:
    rows = dictionary.select(F.explode("entries").alias("e")).filter(F.col("e.lemma").isNotNull()).select("e.lemma", "e.pos", "e.definitions").distinct().limit(MAX_DICTIONARY + 1).collect()
    if len(rows) > MAX_DICTIONARY:
        raise ValueError(f"the dictionary has more than {MAX_DICTIONARY} entries")
    return [(lemma, pos or "", tuple(d for d in definitions or [] if d)) for lemma, pos, definitions in rows]


def document_frequencies(spark: SparkSession, rows: DataFrame, lexicon: Lexicon) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the dictionary's English words over all English texts, and that of a feature seen nowhere."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text_en"), F.lit(r"[a-z]+"), F.lit(0)))
    # Words are counted as they are written; only those that lead to dictionary words come to the driver.
    counted = rows.filter(F.col("text_en").isNotNull()).select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = rows.filter(F.col("text_en").isNotNull()).count()
    forms = {v for v in lexicon.vocabulary} | set(lexicon.past)
    wanted = spark.createDataFrame([(f + e,) for f in sorted(forms) for e in ("", "d", "ed", "s", "es", "ing", "e")] or [("",)], "w string").distinct()
    df: dict[str, float] = {}
    for w, c in counted.join(F.broadcast(wanted), "w").collect():
        s = stem(w, lexicon.past)
        if s in lexicon.vocabulary:
            df[s] = df.get(s, 0.0) + c
    return {w: math.log1p(n / (1.0 + c)) for w, c in df.items()}, math.log1p(n / 50.0) if n else 1.0


def misaligned(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(paragraph_id, cree_sentence_id, en_sentence_id) of texts of one paragraph that translate each other, in whole or in part, under different sentence ids.

    NULL and empty texts have no partner; rows with a NULL paragraph or sentence id are left out; copies
    of rows count once. Paragraphs of one sentence id have nothing to give. Partners may stand any
    number of sentence ids apart, in paragraphs of more than LONG rows too.
    """
    spark = rows.sparkSession
    base = rows.select("paragraph_id", "sentence_id", "text_cree", "text_en").filter(F.col("paragraph_id").isNotNull() & F.col("sentence_id").isNotNull())
    entries = lexicon_entries(dictionary)
    idf, rare = document_frequencies(spark, base, Lexicon(entries))
    shared = spark.sparkContext.broadcast((entries, idf, rare))
    sizes = base.groupBy("paragraph_id").agg(F.count("*").alias("n"), F.min("sentence_id").alias("a"), F.max("sentence_id").alias("b")).filter(F.col("a") != F.col("b"))
    long_ = cut(sizes.filter(F.col("n") > LONG).select("paragraph_id"))
    lists = [F.collect_list("sentence_id"), F.collect_list(F.coalesce("text_cree", F.lit(""))), F.collect_list(F.coalesce("text_en", F.lit("")))]
    any_long = not long_.isEmpty()
    usual = base.join(long_, "paragraph_id", "left_anti") if any_long else base
    usual = usual.groupBy("paragraph_id").agg(F.min("sentence_id").alias("a"), F.max("sentence_id").alias("b"), *(x.alias(f"l{i}") for i, x in enumerate(lists)))
    grouped = usual.filter(F.col("a") != F.col("b")).select("paragraph_id", "l0", "l1", "l2")
    links = grouped.mapInArrow(_aligner(shared), "paragraph_id bigint, cree_sentence_id bigint, en_sentence_id bigint")
    return links.unionByName(sparse_links(base.join(long_, "paragraph_id", "left_semi"), shared)) if any_long else links
