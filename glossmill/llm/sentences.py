"""Sentence boundaries across languages and scripts.

Method: document-centred disambiguation. Which tokens are abbreviations, and which capitalised words
are proper names, is read off their unambiguous occurrences: in the same document where it has enough
of them, else in the whole corpus, else (abbreviations only) from a short stated list. An initial
before a word that is no name ends a sentence; a name with a word that reports speech goes on with
the quotation before it. Which words report speech is read off the corpus. Marks of a script end
sentences only in texts that have letters of it; texts without capitals are told from others and lose
the evidence of letter case.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import cut, written

# Abbreviations assumed where neither document nor corpus shows enough of a token.
NEVER_END = frozenset("Mr Mrs Ms Dr Rev St Capt Prof Fr Sr Col Gen Lt Sgt Hon ca cf vol ch p pp No fig e.g i.e vs Jan Feb Mar Apr Aug Sept Oct Nov Dec".split())
MAY_END = frozenset("etc a.m p.m Jr Inc Co Ltd".split())
ENOUGH = 3  # occurrences with a full stop from which a document, or the corpus, decides for itself
TWICE = 2  # sure cases from which a word counts as one that reports speech, however large the table
CHANCE = 1e-5  # greatest chance, at the corpus's share of full stops, of a document's stops that make an abbreviation
SALTS = 64
SHARE = 0.05  # of the occurrences may go against a decision
MAX_TABLE = 100_000  # decisions and reporting words up to this number are broadcast, beyond it they are joined by shuffle

TERMINATORS = ".!?…"  # of every script
# Terminators that belong to scripts, with the letters of the scripts.
OF_SCRIPT = (("᙮", "\u1400-\u167f\u18b0-\u18ff"), ("。！？", "\u2e80-\u2fdf\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"), ("।॥", "\u0900-\u0dff"), ("։", "\u0530-\u058f"), ("؟۔", "\u0600-\u06ff\u0750-\u077f"), ("።፧", "\u1200-\u137f"))
_OPEN = {"«": "»", "“": "”", "‘": "’", '"': '"', "„": "“", "「": "」", "『": "』"}
_QUOTES = re.compile("[«»“”‘’\"„「」『』]")
_SPECIAL = re.compile("[" + "".join(marks for marks, _ in OF_SCRIPT) + "]")
_SCRIPTS = [(marks, re.compile(f"(?![{marks}])[{letters}]")) for marks, letters in OF_SCRIPT]
_LEADING = frozenset("([{«“‘\"„「『")
_CLOSERS = frozenset(")]}»”’」』")
_NOTE = re.compile(r"(?:[¹²³⁰⁴-⁹*†‡]|\s*\[\d{1,4}\])+")
_TOKEN = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*$")
_WORD = re.compile(r"[^\W\d_]+")
_AFTER = r"[)\]\"'”’»]*+\s++[\"'“‘«(]*+"


@lru_cache(maxsize=64)
def _runs(marks: str) -> re.Pattern:
    return re.compile(rf"[{re.escape(TERMINATORS + marks)}]+")


def terminator_runs(text: str) -> re.Pattern:
    """Pattern of runs of the terminators that hold in a text: the common ones and those of the scripts of its letters."""
    if not _SPECIAL.search(text):
        return _runs("")
    return _runs("".join(marks for marks, letters in _SCRIPTS if letters.search(text)))


def has_capitals(text: Column) -> Column:
    """Whether sentences of a text begin with capitals, by what mostly follows its sentence ends; by its first letter where nothing does."""
    up = F.regexp_count(text, F.lit(rf"[.!?…](?<=\p{{L}}.){_AFTER}\p{{Lu}}\p{{L}}"))
    low = F.regexp_count(text, F.lit(rf"[.!?](?<=\p{{Ll}}{{3}}.){_AFTER}\p{{Ll}}"))
    return F.when(up != low, up > low).otherwise(F.coalesce(F.regexp_extract(text, r"\p{L}", 0).rlike(r"\p{Lu}"), F.lit(False)))


def _sides(texts: DataFrame) -> DataFrame:
    rows = texts.select("row_id", "source_file", F.explode(F.array(F.struct(F.lit("cree").alias("side"), F.col("text_cree").alias("text")), F.struct(F.lit("en").alias("side"), F.col("text_en").alias("text")))).alias("s"))
    return rows.select("row_id", "source_file", "s.side", "s.text").filter(F.col("text").isNotNull() & F.col("row_id").isNotNull()).withColumn("cased", has_capitals(F.col("text")))


def _all(pattern: str) -> Column:
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(1))


def decisions(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions of the corpus (side, token, kind) and those of documents that differ (source_file, side, token, kind).

    Kinds of abbreviations: never (no sentence ends there), may (one ends where a capital follows),
    none. Capitalised words stand with ^ before them: name (capitalised inside sentences and never in
    small letters) or common (the other way round).
    """
    token = r"(?<![\p{L}\p{N}.])(\p{L}{2,}+)"
    found = sides.filter("cased").select("source_file", "side", F.explode(F.regexp_extract_all("text", F.lit(rf"{token}\.\s++[^\s]"), F.lit(0))).alias("x"))
    next_ = F.substring("x", -1, 1)
    kinds = found.select(
        "source_file", "side", F.substring_index("x", ".", 1).alias("token"),
        next_.rlike(r"[\p{Ll}\p{N},;(]").cast("long").alias("on"), next_.rlike(r"\p{Lu}").cast("long").alias("up"),
    )
    dotted = cut(kinds.groupBy("source_file", "side", "token").agg(F.count("*").alias("dots"), F.sum("on").alias("on"), F.sum("up").alias("up")))
    corpus = dotted.groupBy("side", "token").agg(*(F.sum(c).alias(c) for c in ("dots", "on", "up"))).filter(F.col("dots") >= ENOUGH)
    title = F.col("token").rlike(r"^\p{Lu}") & (F.col("up") >= (1 - SHARE) * F.col("dots"))
    likely = cut(corpus.filter((F.col("on") > 0) | title))
    # Capitals after a small letter, a comma or a semicolon and one blank stand inside a sentence; those after an initial may or may not.
    met = F.explode(F.regexp_extract_all("text", F.lit(r"(?:[\p{Ll},;] |\p{Lu}\.\s)\p{Lu}[\p{Ll}\p{M}]++"), F.lit(0)))
    initial = F.substring("x", 2, 1) == "."
    capitals = sides.filter("cased").select("source_file", "side", met.alias("x")).select("source_file", "side", F.when(initial, F.expr("substring(x, 4)")).otherwise(F.expr("substring(x, 3)")).alias("token"), (~initial).cast("long").alias("mid"))
    capitals = cut(capitals.groupBy("source_file", "side", "token").agg(F.sum("mid").alias("mid"), F.count_if(F.col("mid") == 0).alias("after")))
    words = cut(capitals.groupBy("side", "token").agg(F.sum("mid").alias("mid")).withColumn("small", F.lower("token")))
    wanted = likely.select("side", "token").unionByName(words.select("side", F.col("small").alias("token"))).distinct()
    few = wanted.count() <= MAX_TABLE
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    # A document counts for itself only where it may decide for itself; all else is counted for the corpus alone.
    able = dotted.filter((F.col("dots") >= ENOUGH) & F.col("source_file").isNotNull()).join(near(likely.select("side", "token")), ["side", "token"])
    mine = capitals.filter(F.col("source_file").isNotNull() & ((F.col("mid") >= ENOUGH) | (F.col("after") > 0)))
    pairs = able.select("source_file", "side", "token").unionByName(mine.select("source_file", "side", F.lower("token").alias("token"))).distinct()
    pairs = cut(pairs.withColumn("own", F.lit(True)))
    plain = sides.select("source_file", "side", F.explode(_all(rf"{token}(?!\.)")).alias("token")).join(near(wanted), ["side", "token"])
    if pairs.count() <= MAX_TABLE:
        plain = plain.join(F.broadcast(pairs), ["source_file", "side", "token"], "left").withColumn("source_file", F.when(F.col("own"), F.col("source_file")))
    bare = cut(plain.groupBy("source_file", "side", "token").agg(F.count("*").alias("bare")))
    all_bare = bare.groupBy("side", "token").agg(F.sum("bare").alias("bare"))

    def kind(bare_count: Column) -> Column:
        never = title | (F.col("up") <= SHARE * F.col("dots"))
        abbreviation = (bare_count <= SHARE * F.col("dots")) & ((F.col("on") >= SHARE * F.col("dots")) | title)
        return F.when(abbreviation & never, "never").when(abbreviation, "may").otherwise("none")

    def sort(mid: Column, low: Column) -> Column:
        return F.when((mid >= ENOUGH) & (low <= SHARE * mid), "name").when((low >= ENOUGH) & (mid <= SHARE * low), "common")

    everywhere = likely.join(all_bare, ["side", "token"], "left")
    everywhere = everywhere.select("side", "token", kind(F.coalesce("bare", F.lit(0))).alias("kind"), (F.col("dots") / (F.col("dots") + F.coalesce("bare", F.lit(0)))).alias("stops"))
    here = able.join(bare, ["source_file", "side", "token"], "left").select("source_file", "side", "token", "dots", kind(F.coalesce("bare", F.lit(0))).alias("kind"))
    # A document's own decision only counts against the corpus where it says more than "may" against "never".
    other = here.join(everywhere.withColumnRenamed("kind", "usual"), ["side", "token"]).filter((F.col("kind") != F.col("usual")) & ((F.col("kind") == "none") | (F.col("usual") == "none")))
    # Names and last words stand before a few full stops in a row by chance: that makes no abbreviation.
    other = other.filter((F.col("kind") == "none") | (F.pow("stops", "dots") <= CHANCE))

    low = F.coalesce("bare", F.lit(0))
    small = all_bare.withColumnRenamed("token", "small")
    names = words.join(small, ["side", "small"], "left").select("side", "token", sort(F.col("mid"), low).alias("kind"))
    own = mine.withColumn("small", F.lower("token"))
    own = own.join(bare.withColumnRenamed("token", "small"), ["source_file", "side", "small"], "left").select("source_file", "side", "token", sort(F.col("mid"), low).alias("kind")).filter(F.col("kind").isNotNull())
    own = own.join(names.withColumnRenamed("kind", "usual"), ["side", "token"]).filter(~F.col("kind").eqNullSafe(F.col("usual")))
    marked = F.concat(F.lit("^"), "token").alias("token")
    of_corpus = everywhere.select("side", "token", "kind").unionByName(names.filter(F.col("kind").isNotNull()).select("side", marked, "kind"))
    of_documents = other.select("source_file", "side", "token", "kind").unionByName(own.select("source_file", "side", marked, "kind"))
    return of_corpus, of_documents


def reporting_words(sides: DataFrame) -> DataFrame:
    """(side, word) of words that follow closing quotes inside a sentence: after a comma within the quotes, or in small letters in a text with capitals."""
    sure = sides.select("side", F.explode(F.regexp_extract_all("text", F.lit(r"[,][\"”’»]\s+(\p{Ll}[\p{Ll}\p{M}]*)"), F.lit(1))).alias("word"))
    small = sides.filter("cased").select("side", F.explode(F.regexp_extract_all("text", F.lit(r"[.!?…][\"”’»]\s+(\p{Ll}[\p{Ll}\p{M}]*)"), F.lit(1))).alias("word"))
    counted = sure.unionByName(small).groupBy("side", "word").agg(F.count("*").alias("n"))
    return cut(counted.filter(F.col("n") >= TWICE).select("side", "word"))


def _quoted(text: str) -> list[tuple[int, int]]:
    spans, opened = [], []
    for m in _QUOTES.finditer(text):
        c = m[0]
        depth = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][1] == c), -1)
        if depth >= 0:
            first = opened[depth][0]
            while spans and spans[-1][0] > first:
                spans.pop()
            spans.append((first, m.start()))
            del opened[depth:]
        elif c in _OPEN:
            opened.append((m.start(), _OPEN[c]))
    return spans


def _kind(token: str, table: dict, own: dict) -> str:
    if token in own:
        return own[token]
    if token in table:
        return table[token]
    if token in NEVER_END:
        return "never"
    if token in MAY_END or "." in token and all(len(x) < 3 for x in token.split(".")):
        return "may"
    if len(token) == 1:
        return "never" if token.isupper() else "may"
    return "none"


def split(text: str, cased: bool, table: dict, own: dict, reporters: frozenset | set) -> list[tuple[int, int]]:
    """Sentences of a text as offsets; every character but white space around them belongs to one."""
    n = len(text)
    out: list[tuple[int, int]] = []

    def skip(i: int) -> int:
        while i < n and text[i].isspace():
            i += 1
        return i

    start = skip(0)
    spans = _quoted(text)
    openers = {a for a, _ in spans}
    at = 0

    def absorb(i: int) -> int:
        while i < n:
            if text[i] in _CLOSERS or text[i] == '"' and i not in openers:
                i += 1
            elif m := _NOTE.match(text, i):
                i = m.end()
            else:
                break
        return i

    def close(i: int) -> None:
        nonlocal start
        if i > start:
            out.append((start, i))
            start = skip(i)

    def known(word: str) -> str | None:
        word = "^" + word
        return own[word] if word in own else table.get(word)

    def speaker(i: int) -> bool:
        """Whether a proper name and a word that reports speech follow, and no further speech."""
        name = _WORD.match(text, i)
        if name is None or not name[0][0].isupper() or known(name[0]) != "name":
            return False
        verb = _WORD.match(text, skip(name.end()))
        if verb is None or verb[0] not in reporters:
            return False
        stop = runs.search(text, verb.end())
        rest = text[verb.end() : stop.start() if stop else n]
        return ":" not in rest and not _QUOTES.search(rest)

    runs = terminator_runs(text)
    for m in runs.finditer(text):
        s, e = m.span()
        if s < start:
            continue
        while at < len(spans) and spans[at][1] < s:
            at += 1
        if at < len(spans) and spans[at][0] < s:
            opened, closed = spans[at]
            if absorb(e) <= closed and skip(absorb(e)) < closed:
                continue
            end = absorb(closed + 1)
            follows = skip(end)
            first = not text[start:opened].strip("([ \n\t")
            if follows < n:
                c = text[follows]
                word = _WORD.match(text, follows)
                reports = word is not None and word[0] in reporters
                if c in ",;:" or c.islower() and cased or first and reports and not c.isupper() or first and cased and c.isupper() and speaker(follows):
                    continue
            close(end)
            continue
        end = absorb(e)
        follows = skip(end)
        c = text[follows] if follows < n else ""
        lead = next((x for x in text[follows : follows + 3] if x not in _LEADING), c)
        run = m[0]
        if c and c in ",;":
            continue
        if run == ".":
            beside = text[e] if e < n else ""
            if beside.isdigit() and s and text[s - 1].isdigit():
                continue
            before = s
            while before > start and (text[before - 1].isalpha() or text[before - 1] == "."):
                before -= 1
            token = _TOKEN.search(text, before, s)
            token = token[0] if token else ""
            if "." in token and any(len(x) > 2 for x in token.split(".")):
                token = token.rpartition(".")[2]  # a sentence end without a blank stands inside
            if beside.islower() and (cased or len(token.split(".")[-1]) < 3 or not (w := _WORD.match(text, e)) or len(w[0]) < 3):
                continue
            if token:
                kind = _kind(token, table, own)
                if kind == "never" and len(token) == 1 and cased and (w := _WORD.match(text, follows)) and known(w[0]) == "common":
                    kind = "none"
                if kind == "never" and c or kind == "may" and c and (lead.islower() or lead.isdigit() or beside.isalpha()):
                    continue
        elif run == "…" or not run.strip("."):
            if cased and lead.islower():
                continue
        close(end)
    if start < n:
        close(len(text.rstrip()))
    return out


def _cutter(shared):
    def run(batches):
        tables, reporters, decided = shared.value
        for batch in batches:
            ids, sources, sides, texts, cased, own, near, says = (batch.column(i).to_pylist() for i in range(8))
            rows, names, starts, ends = [], [], [], []
            for i, source, side, text, caps, more, known, words in zip(ids, sources, sides, texts, cased, own, near, says, strict=True):
                mine = decided.get((source, side)) or (dict(more) if more else {})
                for a, b in split(text, caps, tables.get(side, {}) if known is None else dict(known), mine, reporters.get(side, frozenset()) if words is None else set(words)):
                    rows.append(i)
                    names.append(side)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["row_id", "side", "sent_start", "sent_end"],
            )

    return run


def _of_rows(sides: DataFrame, words: Column, table: DataFrame, key: str, name: str) -> DataFrame:
    """Per row the entries of ``table`` for the words of its text; an empty list where there are none."""
    found = sides.select("row_id", "side", F.explode(F.array_distinct(words)).alias(key))
    entry = F.array(key, "kind") if "kind" in table.columns else F.col(key)
    return found.join(table, ["side", key]).groupBy("row_id", "side").agg(F.collect_list(entry).alias(name))


def sentences(texts: DataFrame) -> DataFrame:
    """(row_id, side, sent_start, sent_end) of every sentence of both sides of every paragraph.

    NULL, empty and blank texts have no sentence; a text without any terminator is one. Rows with a
    NULL source_file follow the corpus alone; rows with a NULL id are left out. Other columns are
    ignored.
    """
    spark = texts.sparkSession
    # Read four times below; the test for capitals, the dearest expression, runs once.
    sides = written(_sides(texts.select("row_id", "source_file", "text_cree", "text_en")))
    corpus, documents = decisions(sides)
    tables: dict[str, dict[str, str]] = {}
    # Beyond the bound a row gets the entries for its own words alone.
    near = says = None
    corpus = cut(corpus)
    if corpus.count() <= MAX_TABLE:
        for side, token, kind in corpus.collect():
            tables.setdefault(side, {})[token] = kind
    else:
        capitals = F.transform(_all(r"[.!?…\"”’»)\]]\s+(\p{Lu}[\p{Ll}\p{M}]+)"), lambda w: F.concat(F.lit("^"), w))
        near = _of_rows(sides, F.concat(_all(r"(\p{L}+)\."), capitals), corpus, "token", "near")
    reporters: dict[str, set[str]] = {}
    words = reporting_words(sides)
    if words.count() <= MAX_TABLE:
        for side, word in words.collect():
            reporters.setdefault(side, set()).add(word)
    else:
        says = _of_rows(sides, F.concat(_all(r"[\"”’»」』][^\p{L}\p{N}]*([\p{L}\p{M}]+)"), _all(r"[\"”’»」』][^\p{L}\p{N}]*[\p{L}\p{M}]+\s+([\p{L}\p{M}]+)")), words, "word", "says")
    documents = cut(documents)
    decided: dict[tuple, dict] = {}
    if documents.count() <= MAX_TABLE:
        for source, side, token, kind in documents.collect():
            decided.setdefault((source, side), {})[token] = kind
        rows = sides.withColumn("own", F.lit(None).cast("array<struct<token:string,kind:string>>"))
    else:
        # A document may hold a third of all rows, so they meet its decisions under several numbers.
        numbers = F.array(*(F.lit(i) for i in range(SALTS)))
        per = documents.groupBy("source_file", "side").agg(F.collect_list(F.struct("token", "kind")).alias("own")).withColumn("gm_salt", F.explode(numbers))
        rows = sides.withColumn("gm_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(per, ["source_file", "side", "gm_salt"], "left").drop("gm_salt")
    shared = spark.sparkContext.broadcast((tables, {k: frozenset(v) for k, v in reporters.items()}, decided))
    for extra, name, empty in ((near, "near", "array<array<string>>"), (says, "says", "array<string>")):
        rows = rows.withColumn(name, F.lit(None).cast(empty)) if extra is None else rows.join(extra, ["row_id", "side"], "left").withColumn(name, F.coalesce(name, F.array().cast(empty)))
    rows = rows.select("row_id", "source_file", "side", "text", "cased", F.transform("own", lambda x: F.array(x["token"], x["kind"])).alias("own"), "near", "says")
    return rows.mapInArrow(_cutter(shared), "row_id bigint, side string, sent_start bigint, sent_end bigint")
