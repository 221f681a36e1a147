import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossmill.llm import alignment, confusables, reading, sentences, tokenizer


def cut(text, cased=True, table=None, reporters=frozenset({"said", "micôhwêpan"})):
    return [text[a:b] for a, b in sentences.split(text, cased, table or {}, {}, reporters)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("He came. She left.", ["He came.", "She left."]),
        ("Mr. Osawan paid $20.91. He left!", ["Mr. Osawan paid $20.91.", "He left!"]),
        ("J. R. Osawan wrote at 5 p.m. the day ended.", ["J. R. Osawan wrote at 5 p.m. the day ended."]),
        ("It ended at 5 p.m. The bear left.", ["It ended at 5 p.m.", "The bear left."]),
        ("At 5 p.m. (The bear left.) So it was.", ["At 5 p.m.", "(The bear left.)", "So it was."]),
        ("Axes, etc. in the sled (ca. 1893)? Yes.", ["Axes, etc. in the sled (ca. 1893)?", "Yes."]),
        ("“It is cold!” said Osawan. “Go.” Then he left.", ["“It is cold!” said Osawan.", "“Go.”", "Then he left."]),
        ("He said: «Is it? It is.» The bear left.", ["He said: «Is it? It is.»", "The bear left."]),
        ("The ... bear left…  In time.", ["The ... bear left…", "In time."]),
        ("One.² Two![24] Three", ["One.²", "Two![24]", "Three"]),
        ("Miles off!The bear.Mr. Osawan left.", ["Miles off!", "The bear.", "Mr. Osawan left."]),
        ("a line\nbreak ends nothing. Yes!?  No", ["a line\nbreak ends nothing.", "Yes!?", "No"]),
        ("ᑭᓂᐤ᙮ ᒥᐢᑕ?ᐯᔨᐦ", ["ᑭᓂᐤ᙮", "ᒥᐢᑕ?", "ᐯᔨᐦ"]),
        ("", []),
        (" \n ", []),
        (" x ", ["x"]),
    ],
)
def test_boundaries(text, expected):
    assert cut(text) == expected


def test_texts_without_capitals():
    assert cut("ê-pimât atim. kôna nipâw… “atim?” micôhwêpan Osawan. êyankihwak, «atim.» kôna.", cased=False) == [
        "ê-pimât atim.", "kôna nipâw…", "“atim?” micôhwêpan Osawan.", "êyankihwak, «atim.»", "kôna.",
    ]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB .!?…\n“”\"'()«»1²[]᙮ᐁ,", max_size=60), st.booleans())
def test_every_character_is_in_one_sentence(text, cased):
    spans = sentences.split(text, cased, {}, {}, frozenset())
    covered = [i for a, b in spans for i in range(a, b)]
    assert len(covered) == len(set(covered))
    assert {i for i, c in enumerate(text) if not c.isspace()} <= set(covered)
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


TEXTS = "row_id bigint, source_file string, text_cree string, text_en string, side string, text string"


def test_abbreviations_are_learned_from_the_corpus(spark):
    en = ["The bear left by Xyz. Osawan the old."] * 4 + ["He came by bar. The bear left. Nobody saw the bar here."] * 4 + ["They took axes, nets, qux. in the sled. The end came."] * 4
    data = [(i, f"f{i % 2}", None, t, "", "") for i, t in enumerate(en)] + [(90, None, "", " ", "", ""), (91, None, None, None, "", ""), (None, "f0", "x.", "y.", "", "")]
    got = {}
    for r in sentences.sentences(spark.createDataFrame(data, TEXTS)).collect():
        got.setdefault(r["row_id"], []).append(data[r["row_id"]][3][r["sent_start"] : r["sent_end"]])
    assert set(got) == set(range(12))
    assert sorted(got[8]) == ["The end came.", "They took axes, nets, qux. in the sled."]
    assert len(got[4]) == 3 and len(got[0]) == 1
    assert sentences.sentences(spark.createDataFrame([], TEXTS)).count() == 0


def test_long_tokens_are_tested_for_abbreviations(spark):
    en = ["Then Messrs. Osawan and Kisowat left."] * 4 + ["He took approx. five nets home. The end came."] * 4 + ["We met Kisowat here. The bear saw Kisowat."] * 4
    data = [(i, f"f{i % 2}", None, t, "", "") for i, t in enumerate(en)]
    got = {}
    for r in sentences.sentences(spark.createDataFrame(data, TEXTS)).collect():
        got.setdefault(r["row_id"], []).append(data[r["row_id"]][3][r["sent_start"] : r["sent_end"]])
    assert got[0] == [en[0]]
    assert sorted(got[4]) == ["He took approx. five nets home.", "The end came."]
    assert len(got[8]) == 2


def found_sentences(spark, data):
    got = {}
    for r in sorted(sentences.sentences(spark.createDataFrame(data, TEXTS)).collect(), key=lambda r: (r["row_id"], r["sent_start"])):
        got.setdefault(r["row_id"], []).append(data[r["row_id"]][3][r["sent_start"] : r["sent_end"]])
    return got


NAMED = "We met Kisowat here. The bear saw Kisowat. He and Kisowat left with the dog."


def test_proper_names_from_document_and_corpus(spark, monkeypatch):
    en = [
        "He took vitamin A. The dog left.", "Then A. Kisowat left.", "“Go!” Kisowat said. The end.", "“Go!” Kisowat said: “No!” The end.", "“Go!” The dog said nothing of it, said he.",
        NAMED, NAMED, "The dog saw the end of the dog and the end. They met, said he. “No,” said he. “Yes,” said he.",
        # In its own document Brown is a colour, in the corpus a name.
        "Then B. Brown left.",
    ] + ["We saw Brown there."] * 9
    data = [(i, "f", None, t, "", "") for i, t in enumerate(en)]
    own = [(len(en) + i, "g", None, t, "", "") for i, t in enumerate(["He sat by plan B. Brown dogs left.", "A brown dog and a brown bear, a brown fox. The brown end."])]
    got = found_sentences(spark, data + own)
    assert got[0] == ["He took vitamin A.", "The dog left."] and got[1] == [en[1]] and got[8] == [en[8]]
    assert got[2] == ["“Go!” Kisowat said.", "The end."] and got[3] == ["“Go!”", "Kisowat said: “No!”", "The end."]
    assert got[len(en)] == ["He sat by plan B.", "Brown dogs left."]
    monkeypatch.setattr(sentences, "MAX_TABLE", 0)
    assert found_sentences(spark, data + own) == got


@pytest.mark.parametrize(
    ("text", "n"),
    [("猫が来た。犬も来た！終わり", 3), ("ᐊᐢᑭ᙮ ᓂᔭ᙮", 2), ("Roman ᙮ text 。 here", 1), ("राम आया। वह गया॥", 2), ("جاء الولد۔ هل ذهب؟ نعم", 3), ("Ես եկա։ Դու գնացիր։", 2), ("ሰላም። ነው።", 2)],
)
def test_terminators_follow_the_script(text, n):
    assert len(cut(text, cased=False)) == n


def test_rare_reporting_words_count_in_large_tables(spark):
    rows = [(1, "f", None, "“Go,” said he. " * 6100, "", ""), (2, "f", None, "“Go,” cried he. “No,” cried she.", "", "")]
    sides = sentences._sides(spark.createDataFrame(rows, TEXTS))
    assert {r["word"] for r in sentences.reporting_words(sides).collect()} == {"said", "cried"}


def test_long_quotations_and_large_tables(spark, monkeypatch):
    text = "“" + "a. " * 1200 + "“b.” c.” The end."
    assert sentences._quoted(text) == [(0, text.rindex("”"))]
    assert len(cut(text)) == 2
    en = ["The bear left by Xyz. Osawan the old. “Go,” said he. “Go!” said he."] * 4
    df = spark.createDataFrame([(i, f"f{i % 2}", None, t, "", "") for i, t in enumerate(en)], TEXTS)
    small = sorted(map(tuple, sentences.sentences(df).collect()))
    monkeypatch.setattr(sentences, "MAX_TABLE", 0)
    assert sorted(map(tuple, sentences.sentences(df).collect())) == small


@pytest.mark.parametrize(
    ("odd", "plain"),
    [
        ("ｎｉｐｉｙ．", "nipiy."), ("ni​pi­y﻿", "nipiy"), ("ni pi y　k", "ni pi y k"), ("ê-kī", "ê-kī"), ("ê‑kî−kî‐pi", "ê-kî-kî-pi"),
        ("nірiу", "nipiy"), ("Νаnуаmа̂", "Nanyamâ"), ("сосо maskwa", "coco maskwa"), ("ᑲ·ᐃ", "ᑲᐧᐃ"), ("plain text", "plain text"), ("", ""),
        ("привет мир", "привет мир"), ("слово оса", "слово оса"), ("Ένα όνομα", "Ένα όνομα"),
    ],
)
def test_consistent_forms(odd, plain):
    assert confusables.consistent(odd) == plain


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeioнσсоеêâ ̂​·ᐁᑲＡ-−", max_size=20))
def test_forms_are_stable(text):
    once = confusables.consistent(text)
    assert confusables.consistent(once) == once


def test_visible_differences_stay(spark):
    data = [(1, "nipiy", 0), (2, "nірiу", 0), (3, "Nipiy", 0), (4, "nîpiy", 0), (5, "nīpiy", 0), (6, "nipiy!", 0), (7, None, 0), (8, "", 0), (9, "nipiy", 0), (10, "nîpiy", 0), (None, "nipiy​", 0)]
    df = spark.createDataFrame(data, "row_id bigint, text_cree string, form int")
    assert sorted(map(tuple, confusables.lookalikes(df).collect())) == [(1, 2), (2, 9), (4, 10)]
    assert confusables.lookalikes(df.limit(0)).count() == 0
    assert sorted(map(tuple, confusables.spellings(df).collect())) == [(1, 1, 1), (2, 1, 2), (3, 3, 0), (4, 4, 1), (5, 5, 0), (6, 6, 0), (8, 8, 0), (9, 1, 1), (10, 4, 1)]


def test_one_spelling_with_very_many_rows(spark):
    df = spark.createDataFrame([(i, "nipiy") for i in range(3000)] + [(5000, "nірiу"), (5001, "nipіy")], "row_id bigint, text_cree string")
    assert confusables.lookalikes(df).count() == 2 * 3000 + 1


def test_no_changed_character_is_taken_for_plain(spark):
    texts = ["nıpiy", "nipiy", "k`a", "k'a", "ᑭᓂᐤ×", "ᑭᓂᐤᕽ", "ᑭᓂᐤ᙮"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text_cree string")
    assert {r["row_id"]: r["form"] for r in confusables.normalized(df).collect()} == {i: confusables.consistent(t) for i, t in enumerate(texts)}
    assert sorted(map(tuple, confusables.lookalikes(df).collect())) == [(0, 1), (2, 3), (4, 5), (4, 6), (5, 6)]


DICTIONARY = "token string, entries array<struct<lemma:string,pos:string,pos_label:string,definitions:array<string>>>"
WORDS = {"atim": "dog", "maskwa": "bear", "sîsîp": "duck", "kinosêw": "fish", "nipiy": "water", "iskotêw": "fire", "mistik": "tree", "asiniy": "stone"}
SENTENCES = "row_id bigint, paragraph_id bigint, sentence_id bigint, text_cree string, text_en string, source_file string, block int"


def dictionary(spark):
    return spark.createDataFrame([(c, [(c, "N", "", [e])]) for c, e in WORDS.items()] + [("failed", [])], DICTIONARY)


def test_misaligned_sentences(spark):
    c, e = list(WORDS), list(WORDS.values())
    cree = [f"{c[2 * i]} o{c[2 * i + 1]}a." for i in range(4)]
    en = [f"The {e[2 * i]} and the {e[2 * i + 1]}." for i in range(4)]
    data = [(1, 1, 0, cree[0], en[1], "s", 0), (2, 1, 1, cree[1], en[0], "s", 0), (3, 1, 2, cree[2], en[2], "s", 0), (4, 1, 3, cree[3], None, "s", 0)]
    data += [(5, 2, 0, f"{cree[0]} {cree[1]}", en[0], "s", 0), (6, 2, 1, None, en[1], "s", 0), (7, 2, 2, cree[3], en[3], "s", 0), (8, 2, 2, cree[3], en[3], "s", 0)]
    data += [(9, 3, 0, cree[0], en[0], "s", 0), (10, None, 0, cree[0], en[1], "s", 0), (11, 4, None, cree[0], en[1], "s", 0), (12, 5, 0, "", "", "s", 0), (13, 5, 1, None, " ", "s", 0)]
    df = spark.createDataFrame(data, SENTENCES)
    assert sorted(map(tuple, alignment.misaligned(df, dictionary(spark)).collect())) == [(1, 0, 1), (1, 1, 0), (2, 0, 1)]
    assert alignment.misaligned(df.limit(0), dictionary(spark)).count() == 0
    assert alignment.misaligned(df, dictionary(spark).limit(0)).count() == 0


def test_very_long_paragraph_goes_in_windows(spark):
    c, e = list(WORDS), list(WORDS.values())
    n = 1100
    line = lambda i: (f"{c[i % 8]} {c[i // 8 % 8]} {i}.", f"The {e[i % 8]} and the {e[i // 8 % 8]} {i}.")
    data = [(i, 1, i, line(i)[0], line(min(i + 1, n - 1))[1], "s", 0) for i in range(n)]
    got = {tuple(r)[1:] for r in alignment.misaligned(spark.createDataFrame(data, SENTENCES), dictionary(spark)).collect()}
    wanted = {(i + 1, i) for i in range(n - 2)}
    assert len(got & wanted) >= 0.97 * len(wanted)


def test_distant_partners_in_a_very_long_paragraph(spark):
    c, e = list(WORDS), list(WORDS.values())
    n = 1100
    line = lambda i: (f"{c[i % 8]} {c[i // 8 % 8]} {i}.", f"The {e[i % 8]} and the {e[i // 8 % 8]} {i}.")
    data = [(i, 1, i, line(i)[0], line((i + 400) % n)[1], "s", 0) for i in range(n)]
    data += [(n + i, 2, i, line(i)[0], line((i + 3) % 9)[1] if i != 4 else None, "s", 0) for i in range(9)]
    df = spark.createDataFrame(data, SENTENCES)
    got = {tuple(r) for r in alignment.misaligned(df, dictionary(spark)).collect()}
    wanted = {(1, (i + 400) % n, i) for i in range(n)}
    assert len(got & wanted) >= 0.97 * n and len({x for x in got if x[0] == 1} - wanted) <= 0.03 * n
    assert {(2, (i + 3) % 9, i) for i in range(9) if i != 4} == {x for x in got if x[0] == 2}


def test_links_do_not_depend_on_the_size_of_a_paragraph(spark, monkeypatch):
    rng, c = random.Random(7), list(WORDS)
    said = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    data = [(9 * p + i, p, i, said(c), said(list(WORDS.values())), "s", 0) for p in range(300) for i in range(4 + p % 5)]
    df = spark.createDataFrame(data, SENTENCES)
    small = sorted(map(tuple, alignment.misaligned(df, dictionary(spark)).collect()))
    monkeypatch.setattr(alignment, "LONG", 0)
    assert len(small) > 300 and sorted(map(tuple, alignment.misaligned(df, dictionary(spark)).collect())) == small


def test_transport_moves_all_mass_of_a_clear_match():
    import numpy as np

    plan = alignment.transport(np.array([[[0.9, 0.1], [0.0, 0.0]]]))[0]
    assert plan[0, 0] > 0.9 and plan[1].max() < 0.1


TRICKY = ["", None, "Hello  world\n\n", "don't 'S 12,5 ²  x", " \n \t", "ê-kî-âpacihtât ᐊᑎᒼ 🐻", "<|endoftext|>", "a" * 100_000, "a b " * 30_000, "Hello  world\n\n"]


def test_ids_equal_the_public_tokenizer(spark):
    import tiktoken

    enc = tokenizer._encoding(tokenizer.DEFAULT_PATH)
    assert isinstance(enc, tiktoken.Encoding)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TRICKY)], "doc_id bigint, text string, ids int").repartition(3)
    got = {r["doc_id"]: list(r["ids"]) for r in tokenizer.encode(df).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TRICKY)}
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokenizer.encode(df, only_counts=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    back = {r["doc_id"]: r["text"] for r in tokenizer.decode(tokenizer.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TRICKY)}
    assert tokenizer.encode(df.limit(0)).count() == 0


def test_chunks_end_by_words_too(spark, monkeypatch):
    monkeypatch.setattr(tokenizer, "CHUNK_WORDS", 10)
    monkeypatch.setattr(tokenizer, "CHUNK_DOCS", 4)
    n = np.array([3, 3, 3, 3, 0, 25, 1, 1, 1, 1, 1])
    bounds = tokenizer.chunk_bounds(n)
    assert [a for a, _ in bounds][1:] == [b for _, b in bounds][:-1] and bounds[0][0] == 0 and bounds[-1][1] == len(n)
    assert (5, 6) in bounds and all(n[a:b].sum() <= 20 or b - a == 1 for a, b in bounds) and all(b - a <= 4 for a, b in bounds)
    assert tokenizer.chunk_bounds(np.zeros(0, np.int64)) == []


@pytest.mark.parametrize(("word", "n"), [("the", 1), ("make", 1), ("table", 2), ("remembered", 3), ("walked", 1), ("wanted", 2), ("interpretation", 5), ("x", 1), ("being", 2), ("grandmother", 3)])
def test_syllables(word, n):
    assert reading.syllables(word) == n


DOCS = "doc_id bigint, text string, lang string, english int"


def test_reading_levels(spark):
    easy, hard = "The cat sat. The dog ran. ", "The epistemological subordination of interpretation necessitates heterogeneous discontinuity, whereby classification recontextualises the institutional historiography of the language. "
    data = [(i, easy * (3 + i % 4), "en", 0) for i in range(20)] + [(100 + i, hard * (2 + i % 3), "en" if i % 2 else None, 0) for i in range(20)]
    data += [(200, None, "en", 0), (201, "", None, 0), (202, "êkwa atim nipâw kôna", None, 0), (203, hard, "crk", 0), (None, easy, "en", 0)]
    labels = spark.createDataFrame([(i, 1) for i in range(8)] + [(101 + 2 * i, 5) for i in range(6)] + [(7, None), (None, 3), (202, 2)], "doc_id bigint, grade int")
    got = {r["doc_id"]: r for r in reading.levels(spark.createDataFrame(data, DOCS), labels).collect()}
    assert {got[i]["grade"] for i in range(20)} == {1} and {got[100 + i]["grade"] for i in range(20)} == {5}
    assert got[200]["grade"] is None and not got[201]["english"] and not got[202]["english"] and not got[203]["english"] and got[100]["english"]
    none = reading.levels(spark.createDataFrame(data, DOCS), labels.limit(0)).collect()
    assert all(r["grade"] is None for r in none)
    assert reading.levels(spark.createDataFrame([], DOCS), labels).count() == 0


def test_grades_tell_equal_sums_apart():
    # Each formula adds its two terms to the same sum for both kinds of documents; one formula errs and is outvoted.
    low, high = np.tile([1.0, 9.0], (5, 1)), np.tile([9.0, 1.0], (5, 1))
    points = np.stack([low + 0.01 * i for i in range(6)] + [high + 0.01 * i for i in range(6)])
    grades = np.array([2.0] * 6 + [5.0] * 6)
    assert reading.grades_of(np.stack([low, high]), points, grades).tolist() == [2, 5]
    astray = low.copy()
    astray[2] = high[2]
    assert reading.grades_of(astray[None], points, grades).tolist() == [2]
    assert reading.grades_of(low[None], points[:1], grades[:1]).tolist() == [2]
