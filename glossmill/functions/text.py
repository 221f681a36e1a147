"""Text expressions. Each takes and gives Columns, so plans stay inside generated code; NULL in gives NULL out unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles and preverbs that carry no dictionary meaning.
PARTICLES = (
    "kâ ka ê e wî wi nî ni ki kî pê pî isko isi mâh âh nôh mêk êkwa êkosi mîna piko tâpwê êsa ana awa ôma ôhi ôho anima aniki ôki nêhiyaw peyak nisto nîso"
).split()
# English words that give away a translator's note among Cree sentences.
NOTE_WORDS = "the he she was had his her and then to of that this it in for on at by with as said not but they them were from when all one have".split()
# English words by which a paragraph is taken for English.
ENGLISH_WORDS = (
    "the he she was had his her and then to of that this it in for on at by with as said not but they them were from when all one have so what would who him "
    "their upon time once there which into out up an no its did will be are is a my me we you us now very went came could told come like do got asked thought "
    "saw took made just back away man woman old new good great too if how"
).split()
MACRONS = "āēīōĀĒĪŌ"
SPACE_SQL = r"[\s\x0b\x{85}\p{Z}]"


def strip(x: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space to one blank, ends stripped."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def words(x: Column) -> Column:
    """Words of the lower-cased text, cut at white space and the usual punctuation."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)([^\s.,;:!?\"'()\[\]]+)"), F.lit(1))


def nonempty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def sentences_kept(x: Column) -> Column:
    """Sentences cut after . ! ? and white space, terminators kept."""
    return nonempty(F.split(collapse(x), r"(?U)(?<=[.!?])\s+"))


def sentences_bare(x: Column) -> Column:
    """Pieces between runs of terminators, without them; blank pieces dropped."""
    return nonempty(F.transform(F.split(x, r"[.!?]+"), strip))


def sentences_restored(x: Column) -> Column:
    """Pieces between full stops and white space, quotes stripped, the full stop put back where none of . ? ! ends a piece."""
    bare = F.transform(F.split(collapse(x), r"(?U)\.\s+"), lambda p: strip(F.btrim(F.btrim(strip(p), F.lit('"')), F.lit("'"))))
    return F.transform(nonempty(bare), lambda p: F.when(F.right(p, F.lit(1)).isin(".", "?", "!"), p).otherwise(F.concat(p, F.lit("."))))


# Starts of page-number and note lines, and running headers anywhere in a line.
NOTE_STARTS = r"(?U)^\s*\d{1,4}\s*$|^\s*\*\s*|^\s*\d+\s+|^\s*[Ww]ord\s|^\s*[Oo]r\s+read|^\s*[Pp]robably\s|^\s*[Tt]ranslation\s|^\s*[Cc][Ff]\.|^\s*[Ii]\.e\."
RUNNING_HEADERS = r"(?i:sacred\s+stories|sweet\s+grass\s+cree|national\s+museum|department\s+of\s+mines|anthropological\s+ser)"
NOISE_LINE = f"{NOTE_STARTS}|{RUNNING_HEADERS}"


def paragraphs(x: Column) -> Column:
    """Paragraphs between blank lines, without those whose lines are all page numbers or notes."""
    parts = nonempty(F.transform(F.split(x, r"(?U)\n\s*\n"), strip))
    return F.filter(parts, lambda p: F.exists(F.split(p, "\n"), lambda ln: ~ln.rlike(NOISE_LINE)))


def denoised(x: Column) -> Column:
    """A paragraph without page-number and note lines and without caret marks, white space collapsed."""
    kept = F.array_join(F.filter(F.split(x, "\n"), lambda ln: ~ln.rlike(NOISE_LINE)), " ")
    return collapse(F.regexp_replace(kept, r"(?U)\^\w?", ""))


def block(x: Column) -> Column:
    """An OCR block without margin numbers and double blanks, hyphenated line ends joined, lines joined."""
    x = F.regexp_replace(x, r"(?Um)^\s*\d+\s{2,}", "")
    x = F.regexp_replace(F.regexp_replace(x, r"  +", " "), r"(?U)-\s*\n\s*", "")
    return strip(F.regexp_replace(x, r"(?U)\s*\n\s*", " "))


def header_key(x: Column) -> Column:
    """White space collapsed, trailing digits and full stops off, upper case."""
    return F.upper(F.regexp_replace(strip(F.regexp_replace(collapse(x), r"\d+\s*$", "")), r"\.+$", ""))


def content_tokens(x: Column) -> Column:
    """Distinct content tokens in order of first occurrence: three letters or more, no particles."""
    found = F.regexp_extract_all(x, F.lit(r"([a-zA-ZâêîôÂÊÎÔāēīōĀĒĪŌ'ʼ\-]+)"), F.lit(1))
    skip = F.array(*map(F.lit, PARTICLES))
    kept = F.filter(found, lambda t: (F.length(t) >= 3) & ~F.array_contains(skip, F.lower(t)))
    return F.array_distinct(F.transform(kept, F.lower))


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Lower-case letters that are composed with diacritics, and their bases, from the canonical decompositions."""
    pairs = []
    for code in range(0xC0, 0x10000):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") if c == c.lower() else c
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(x: Column) -> Column:
    """Lower case without diacritics, composed or combining (category Mn)."""
    return F.regexp_replace(F.translate(F.lower(x), *accents()), r"\p{Mn}+", "")


def letters(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}]", ""))


def blank_words(x: Column) -> Column:
    """Number of words between white space."""
    return F.size(nonempty(F.split(x, r"(?U)\s+")))


def share(count: Column, total: Column) -> Column:
    """Quotient, NULL for a zero denominator."""
    return count / F.nullif(total, F.lit(0))


def real_paragraph(x: Column, ratio: float = 0.40, least: int = 5) -> Column:
    """20 characters, the given share of letters and number of words or more."""
    return (F.length(x) >= 20) & (share(letters(x), F.length(x)) >= ratio) & (blank_words(x) >= least)


def _ascii_words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?<![\p{L}\p{N}_])([a-z]+)(?![\p{L}\p{N}_])"), F.lit(1))


def _listed(found: Column, listed: list[str]) -> Column:
    known = F.array(*map(F.lit, listed))
    return F.size(F.filter(found, lambda w: F.array_contains(known, w)))


def cree_sentence(x: Column) -> Column:
    """Long enough, 45 % letters, and not six or more words of which 40 % are English note words."""
    found = _ascii_words(x)
    english = (F.size(found) >= 6) & (_listed(found, NOTE_WORDS) >= 0.40 * F.size(found))
    return (F.length(x) >= 20) & (share(letters(x), F.length(x)) >= 0.45) & ~english


def english_paragraph(x: Column) -> Column:
    """At least five ASCII words, of which 30 % are common English ones."""
    found = _ascii_words(x)
    return (F.size(found) >= 5) & (_listed(found, ENGLISH_WORDS) >= 0.30 * F.size(found))


def clean_example(cree: Column, en: Column, least: int = 5) -> Column:
    """The ten rules by which lines of a grammar book are no example sentences."""
    # The patterns of the rules.
    return (
        (F.length(cree) >= least)
        & cree.rlike(f"[{MACRONS}]")
        & ~cree.rlike(r"(?U)\b[a-zāēīō]{1,3} [a-zāēīō]{1,3} [a-zāēīō]{1,3}\b")
        & ~cree.rlike(r"[+=]")
        & ~cree.rlike(r"\([a-z]")
        & ~en.rlike(r"(?i)\b(subject|verb|object|noun|stem|suffix|prefix)\b")
        & ~en.rlike(r"^\d+\.")
        & ~en.rlike(r"(?i)(isbn|pm\d{3}|\d{4}-\d{4}|edition\.|new edition)")
        & ~en.rlike(r"^(Includes|As a result|Some changes|This edition)")
        & ~cree.rlike(r"^Jean L\.")
    )


def macron_dominant(x: Column) -> Column:
    """A quarter of the tokens have a macron, or one of at most three."""
    tokens = nonempty(F.split(x, r"(?U)\s+"))
    marked = F.size(F.filter(tokens, lambda t: t.rlike(f"[{MACRONS}]")))
    n = F.size(tokens)
    return F.when(n == 0, False).when(n <= 3, marked >= 1).otherwise(marked >= 0.25 * n)


def inline_pair(x: Column) -> Column:
    """struct(cree, en) of a line with both, cut at the last gap of three blanks that has a macron on the left and none, but more than four characters, on the right; NULL without one."""
    parts = F.split(x, r" {3,}")
    n = F.size(parts)
    tries = F.transform(
        F.reverse(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))),
        lambda k: F.struct(
            strip(F.array_join(F.slice(parts, F.lit(1), k), "   ")).alias("cree"), strip(F.array_join(F.slice(parts, k + 1, F.greatest(n - k, F.lit(0))), "   ")).alias("en")
        ),
    )
    good = F.filter(tries, lambda p: p["cree"].rlike(f"[{MACRONS}]") & ~p["en"].rlike(f"[{MACRONS}]") & (F.length(p["en"]) > 4))
    return F.when(n > 1, F.get(good, F.lit(0)))


# Marks of old Ojibwe spelling in OCR, and English words, by which a block is told.
_OJIBWE = r"[aeiou]['][a-z]|[a-z][0-9]{1,2}[a-z]|\b(?:tc|dc)[a-z]|[/'\\][uia][/\\]|ugri|midac|misa|kaga|cigwa|anlc|mldac|ugrl|uglwab"
_BLOCK_ENGLISH = (
    r"(?i)\b(?:the|was|and|that|had|her|him|with|this|then|they|were|have|from|upon|when|said|told|thus|what|where|some|did|now|one|who|verily|therefore|hither|thereof)\b"
)


def block_class(raw: Column) -> Column:
    """Meta, header, footnote, ojibwe or english; equal marks of both languages count as Ojibwe, none of either as meta."""
    t = collapse(raw)
    oji, eng = F.regexp_count(t, F.lit(_OJIBWE)), F.regexp_count(t, F.lit(_BLOCK_ENGLISH))
    return (
        F.when((t == "") | t.rlike(r"^[IVXLC]+$|^\d+$"), "meta")
        .when(t.rlike(r"(?i)^(SERIES|PART|I\s*[.—-]|II\s*[.—-])"), "meta")
        .when(t.rlike(r"^[A-Z\s.,'\-]{3,60}$") & (blank_words(t) <= 8), "meta")
        .when(t.rlike(r"(?i)^[ivxlc\d]+\.\s+[A-Z][A-Z\s,'\-]{4,}[.\d]*\s*$"), "header")
        .when(t.rlike(r"^\d+\s+\S") & (F.length(t) < 300), "footnote")
        .when((oji == 0) & (eng == 0), "meta")
        .when(oji >= eng, "ojibwe")
        .otherwise("english")
    )


def model_category(name: Column) -> Column:
    """Kind of a model by parts of its name."""
    n = F.lower(name)
    return F.when(n.contains("tlm"), "tlm").when(n.contains("clkd"), "clkd").when(n.contains("calib"), "calibrated").when(n.contains("silver"), "silver").otherwise("other")


def slug(x: Column) -> Column:
    """/ and : to _, full stops to p."""
    return F.translate(x, "/:.", "__p")


def file_slug(url: Column) -> Column:
    """Last part of a path without .html."""
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.html$", "")


def absolute(base: str, href: Column) -> Column:
    """Base and link where the link starts with / and ends with .html; NULL otherwise."""
    return F.when(href.startswith("/") & href.endswith(".html"), F.concat(F.lit(base), href))


def fingerprint(x: Column) -> Column:
    """First ten hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 10)


def words_of(x: Column) -> Column:
    """Words with punctuation off the whole text and off each word; may hold the empty word."""
    marks = F.lit(".,!?;:\"'()[]“”‘’«»—–-")
    return F.transform(F.split(F.btrim(F.lower(x), marks), r"(?U)\s+"), lambda w: F.btrim(w, marks))


def round_at(x: Column, places: int = 4) -> Column:
    """Half up on the binary value; the same IEEE expression in any engine."""
    p = float(10**places)
    return F.floor(x * F.lit(p) + F.lit(0.5)) / F.lit(p)


def draw(key: Column, seed: int | str = 42) -> Column:
    """Number from 0 to 2^32-1 that orders rows at random, the same at every partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def roll(a: Column, b: Column) -> Column:
    """Pseudo-random number below 2^31 - 1 from two whole numbers (a below 2,000, b below 10^11), in whole-number arithmetic alone."""
    m = F.lit(2147483647)
    x = ((a * 1000003 + b + 1) * 48271) % m
    for k in (3, 5):
        x = (x * x + x * k + 1) % m
    return (x * 69621 + 12345) % m


def average(a: Column) -> Column:
    """Mean of an array of numbers, 0 for an empty one."""
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0), lambda s, y: s + y) / F.size(a)).otherwise(0.0)


def word_length(x: Column) -> Column:
    """Mean length of the words of a text, 0 without any."""
    return average(F.transform(words(x), F.length))


def sentence_length(x: Column) -> Column:
    """Mean number of words of the sentences of a text, 0 without any."""
    return average(F.transform(sentences_bare(x), lambda s: F.size(words(s))))


def env_value(line: Column, name: str) -> Column:
    """Value of a line NAME=value, cut at the first sign and stripped; NULL for any other line."""
    return F.when(F.startswith(line, F.lit(f"{name}=")), strip(F.substr(line, F.lit(len(name) + 2))))


def patched(x: Column, marker: str, patch: str) -> Column:
    """Text with the marker replaced where it stands exactly once; NULL where it does not, so that a caller can tell."""
    times = (F.length(x) - F.length(F.replace(x, F.lit(marker), F.lit("")))) / len(marker)
    return F.when(times == 1, F.replace(x, F.lit(marker), F.lit(patch)))


def after_front(x: Column, header: str) -> Column:
    """Text from the first match of a header on, or the whole text without one."""
    at = F.regexp_instr(x, F.lit(header))
    return F.when(at > 0, F.substr(x, at)).otherwise(x)


def padded(ids: Column, size: int) -> Column:
    """Struct of two arrays of the given size: ids cut or filled with 0, and their mask."""
    n = F.least(F.size(ids), F.lit(size))
    fill = F.array_repeat(F.lit(0), F.lit(size) - n)
    return F.struct(F.concat(F.slice(ids, F.lit(1), n), fill).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), fill).alias("attention_mask"))
