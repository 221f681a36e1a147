import pytest
from pyspark.sql import functions as F

from glossmill.functions import labels as L
from glossmill.functions import text as X
from glossmill.functions import vectors as V


def one(spark, column, **values):
    types = {str: "string", int: "bigint", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).collect()[0][0]


@pytest.mark.parametrize(
    ("f", "text", "expected"),
    [
        (X.sentences_kept, "A b. C d! E", ["A b.", "C d!", "E"]),
        (X.sentences_bare, "A b. C d! E", ["A b", "C d", "E"]),
        (X.sentences_restored, 'A b. "C d!" E. F', ["A b.", 'C d!" E.', "F."]),
        (X.unaccented, "Nêhiyawêwin", "nehiyawewin"),
        (X.strip, " 　 x  ", "x"),
        (X.collapse, " a   b\n c ", "a b c"),
        (X.header_key, " 2. The  Birth . 17 ", "2. THE BIRTH "),
        (X.content_tokens, "Kîsikâw êkwa kîsikâw nipiy ka", ["kîsikâw", "nipiy"]),
        (X.block, "12   foo  bar-\n  baz\nqux", "foo barbaz qux"),
        (X.denoised, "12\n* note\nkeep ^2 this\ncf. x", "keep this"),
        (X.blank_words, "  a  b c ", 3),
        (X.sentences_kept, None, None),
        (X.strip, None, None),
    ],
)
def test_text(spark, f, text, expected):
    got = one(spark, f(F.col("t")), t=text)
    if f is X.header_key:
        got, expected = got.strip(), expected.strip()
    assert got == expected


def test_paragraphs_drop_page_numbers(spark):
    assert one(spark, X.paragraphs(F.col("t")), t="12\n\nreal text\n13\n\n* note") == ["real text\n13"]


def test_inline_pair(spark):
    got = one(spark, X.inline_pair(F.col("t")), t="nōhkom   ē   Grandmother sings")
    assert (got["cree"], got["en"]) == ("nōhkom   ē", "Grandmother sings")
    assert one(spark, X.inline_pair(F.col("t")), t="no gap ē here") is None
    assert one(spark, X.inline_pair(F.col("t")), t="ē   abc") is None


@pytest.mark.parametrize(
    ("block", "kind"),
    [("", "meta"), ("XIV", "meta"), ("SERIES I", "meta"), ("2. THE BIRTH OF A MAN", "header"), ("1 Saga, when you go", "footnote"), ("a'pi mi i'u", "ojibwe"), ("then the man said", "english"), ("xx yy zz", "meta")],
)
def test_block_class(spark, block, kind):
    assert one(spark, X.block_class(F.col("t")), t=block) == kind


@pytest.mark.parametrize(("raw", "v1", "v2"), [("Proverb", "idiom", "literal"), (" none ", "literal", "literal"), ("pun", "literal", "literal"), (" simile ", "simile", "simile"), (None, "literal", None)])
def test_label_normalizers(spark, raw, v1, v2):
    assert one(spark, L.merged(F.col("t")), t=raw) == v1
    assert one(spark, L.strict(F.col("t")), t=raw) == v2


@pytest.mark.parametrize(("answer", "label"), [("LABEL: Metaphor\nEXPRESSION: x", "metaphor"), ("label: literal / idiom\nLABEL: idiom", None), ("none here", None)])
def test_parse_label(spark, answer, label):
    assert one(spark, L.parsed(F.col("t")), t=answer) == label


def test_salvaged_json(spark):
    whole = one(spark, L.salvaged(F.col("t")), t='[{"sentence_num": 1, "label": "idiom"}]')
    parts = one(spark, L.salvaged(F.col("t")), t='x {"sentence_num": 2, "label": "simile"} broken {')
    assert [(r["sentence_num"], r["label"]) for r in whole] == [(1, "idiom")]
    assert [(r["sentence_num"], r["label"]) for r in parts] == [(2, "simile")]


def test_label_codes(spark):
    assert [one(spark, L.code(F.col("t")), t=x) for x in ("literal", "simile", "pun", None)] == [0, 3, 0, 0]


def test_softmax_and_divergence(spark):
    row = spark.sql("select array(1d, 2d, 3d) a, array(1d, 2d, 3d) b").select(V.softmax(F.col("a")).alias("p"), V.kl(F.col("a"), F.col("b"), 1.0).alias("kl"), V.cosine(F.col("a"), F.col("b")).alias("c")).collect()[0]
    assert sum(row["p"]) == pytest.approx(1) and row["kl"] == pytest.approx(0, abs=1e-12) and row["c"] == pytest.approx(1)


def test_hierarchy_is_a_distribution(spark):
    row = spark.sql("select 0.3d z, array(1d, 0d, -1d) k").select(F.transform(V.hierarchy(F.col("z"), F.col("k")), F.exp).alias("p")).collect()[0]
    assert sum(row["p"]) == pytest.approx(1)
