"""Visually identical text with different characters.

Method: intersect the resolved script sets of each token's letters, detect mixed-script tokens and
tokens that are confusable as a whole, choose the spelling in one script, and normalize the
remaining forms (width, composition, spaces, hyphens, invisible characters).
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators.skew import attach, salted
from glossmill.session import cut, written

# Letters of other scripts drawn like Latin ones, from the Unicode table of confusables.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХУԌԚԜаеѕіјорсухһԁԛԝɡ", "ABESIJKMHOPCTXYGQWaesijopcyxhdqwg", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνϳ", "ABEZHIKMNOPTYXopvj", strict=True))
ARMENIAN = dict(zip("ՕՍՏԼօոսհց", "OUSLonuhg", strict=True))
OTHER = dict(zip("ıɑɩ", "iai", strict=True))
HYPHENS = "\u2010\u2011\u2012\u2013\u2043\u2212\ufe58\uff0d\u02d7\u2796"
APOSTROPHES = "\u2018\u2019\u201b\u2032\u02b9\u02bb\u02bc\u02bd\u02c8\u0060\u00b4\u02be\u02bf\uff07"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
SYLLABIC = {"·": "ᐧ", "•": "ᐧ", "∙": "ᐧ", "⋅": "ᐧ", "・": "ᐧ", "ᕽ": "᙮", "×": "᙮"}  # only next to syllabics

_LATIN = CYRILLIC | GREEK | ARMENIAN
_CYRILLIC_OF = {v: k for k, v in CYRILLIC.items() if v != "g"}
_GREEK_OF = {v: k for k, v in GREEK.items()}
_FORMS = str.maketrans(dict.fromkeys(HYPHENS, "-") | dict.fromkeys(APOSTROPHES, "'") | dict.fromkeys(SPACES, " ") | dict.fromkeys(INVISIBLE) | OTHER)
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = r"^[\x20-\x{5F}\x{61}-\x{7E}\x{C0}-\x{D6}\x{D8}-\x{130}\x{132}-\x{17F}\x{1401}-\x{157C}\x{157E}-\x{167F}]*$"  # no form of these needs a change
SCRIPTS = {"LATIN": "Latn", "CYRILLIC": "Cyrl", "GREEK": "Grek", "ARMENIAN": "Armn"}


def scripts(letter: str) -> frozenset[str]:
    """Resolved script set of a letter: its own script and each one that draws a letter like it."""
    own = SCRIPTS.get(unicodedata.name(letter, "").split(" ")[0], "Zyyy")
    found = {own}
    if letter in _LATIN:
        found.add("Latn")
        latin = _LATIN[letter]
    else:
        latin = letter if own == "Latn" else ""
    if latin in _CYRILLIC_OF:
        found.add("Cyrl")
    if latin in _GREEK_OF:
        found.add("Grek")
    return frozenset(found)


def _resolve(token: str, home: str) -> str:
    """The spelling of a token (decomposed) in one script.

    The scripts in which the whole token can be written are the intersection of its letters' sets.
    Latin is chosen where possible unless the text around it is in another script of that set; a
    token that only another script can write in full is written in that one; one that none can is
    brought to Latin letter by letter where the majority of its own letters is Latin.
    """
    if token.isascii():
        if home == "Latn":
            return token
    letters = [c for c in token if c.isalpha()]
    sets = [scripts(c) for c in letters]
    common = frozenset.intersection(*sets) if sets else frozenset()
    if "Latn" in common and (home == "Latn" or home not in common):
        return "".join(_LATIN.get(c, c) for c in token)
    for script, table in (("Cyrl", _CYRILLIC_OF), ("Grek", _GREEK_OF)):
        if script in common and (home == script or "Latn" not in common):
            return "".join(c if c not in _LATIN and c not in table else table.get(_LATIN.get(c, c), c) for c in token)
    latin = sum("Latn" in s for s in sets)
    return "".join(_LATIN.get(c, c) for c in token) if 2 * latin > len(sets) else token


def _home(text: str) -> str:
    """The script of the letters that cannot be taken for others; Latin where there are none."""
    seen: dict[str, int] = {}
    for c in text:
        if c.isalpha() and len(s := scripts(c)) == 1:
            (own,) = s
            seen[own] = seen.get(own, 0) + 1
    seen.pop("Zyyy", None)
    return max(sorted(seen), key=lambda k: (seen[k], k == "Latn")) if seen else "Latn"


def consistent(text: str | None) -> str | None:
    """One form for all texts that are drawn alike; NULL stays NULL.

    Letter case, visible punctuation and diacritics are kept.
    """
    if text is None:
        return None
    text = text.translate(_FORMS)
    wide = any("\uff00" <= c <= "\uffef" for c in text)
    if wide:
        text = "".join(unicodedata.normalize("NFKC", c) if "\uff00" <= c <= "\uffef" else c for c in text).translate(_FORMS)
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    if any("᐀" <= c <= "ᙿ" for c in text):
        text = re.sub(r"(?<=[᐀-ᙿ])[·•∙⋅・ᕽ×]+|[·•∙⋅・]+(?=[᐀-ᙿ])", lambda m: "".join(SYLLABIC[c] for c in m[0]), text)
    if any(c in _LATIN for c in text):
        home = _home(text)
        text = re.sub(r"(?:[^\W\d_][\u0300-\u036f]*)+", lambda m: _resolve(m[0], home), text)
    return unicodedata.normalize("NFC", text)


def _fold(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([consistent(t) for t in batch.column(1).to_pylist()], pa.string())], names=["row_id", "text", "form"]
        )


def normalized(rows: DataFrame, id_col: str = "row_id", text_col: str = "text_cree") -> DataFrame:
    """(row_id, text, form): every text and its one consistent form; NULL texts have a NULL form, other columns are ignored."""
    base = rows.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    plain = F.col("text").isNull() | F.col("text").rlike(_PLAIN)
    return base.filter(plain).withColumn("form", F.col("text")).unionByName(base.filter(~plain).mapInArrow(_fold, "row_id bigint, text string, form string"))


def lookalikes(rows: DataFrame, id_col: str = "row_id", text_col: str = "text_cree") -> DataFrame:
    """(row_id_a, row_id_b) of each two rows drawn alike but stored in different characters, smaller id first.

    Rows are first brought down to forms and spellings by hash; only forms stored in more than one
    spelling go on to the pairs. Equal texts make no pair. NULL texts make none.
    """
    both = normalized(rows, id_col, text_col).filter(F.col("text").isNotNull() & F.col("row_id").isNotNull())
    hashed = written(both.select("row_id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("spelling")))
    classes = cut(hashed.groupBy("form", "spelling").agg(F.count("*").alias("n")))
    x, y = classes.select("form", F.col("spelling").alias("a")), classes.select("form", F.col("spelling").alias("b"))
    # Spellings of one form, each pair of them once, are expanded to rows; a spelling with very many rows is spread.
    pairs = salted(x.withColumn("at", F.xxhash64("a")), y, ["form"], "at").filter(F.col("a") < F.col("b")).select("a", "b")
    for c in ("a", "b"):
        pairs = salted(hashed.select(F.col("spelling").alias(c), F.col("row_id").alias(f"row_{c}")), pairs, [c], f"row_{c}")
    return pairs.select(F.least("row_a", "row_b").alias("row_id_a"), F.greatest("row_a", "row_b").alias("row_id_b"))


def spellings(rows: DataFrame, id_col: str = "row_id", text_col: str = "text_cree") -> DataFrame:
    """Class form of the pairs: (row_id, form_id, links) of every row with a text; form_id is the least row_id of its form, links the number of rows drawn alike but stored otherwise.

    Only sizes of forms and spellings meet the rows, so nothing grows with the square of a form.
    """
    both = normalized(rows, id_col, text_col).filter(F.col("text").isNotNull() & F.col("row_id").isNotNull())
    hashed = written(both.select("row_id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("spelling")))
    classes = cut(hashed.groupBy("form", "spelling").agg(F.count("*").alias("n"), F.min("row_id").alias("least")))
    forms = classes.groupBy("form").agg(F.sum("n").alias("all"), F.min("least").alias("form_id"))
    sizes = classes.join(forms, "form").select("spelling", "n", "form_id", (F.col("all") - F.col("n")).alias("links"))
    return attach(hashed, sizes, ["spelling"], "n").select("row_id", "form_id", "links")
