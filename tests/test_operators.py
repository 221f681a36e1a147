import math
import random

import pytest
from pyspark.sql import functions as F

from glossmill.functions import vectors
from glossmill.operators import align, html, incremental, losses, metrics, parse, pool, retrieval, sample, skew, steps


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pool_keeps_null_sources_and_first_texts(spark):
    df = spark.createDataFrame([(2, "x", " a ", "A"), (1, None, "a", "B"), (3, "x", "b", None), (4, "y", "c", "C")], "row_id bigint, source_file string, text_cree string, text_en string")
    assert rows(pool.load_pool(df, "y").select("row_id", "text_cree")) == [(1, "a")]
    assert rows(pool.load_pool(df).select("row_id")) == [(1,), (4,)]
    assert pool.load_pool(df.limit(0)).count() == 0


def test_null_source_survives_exclusion(spark):
    df = spark.createDataFrame([(1, None, "a", "b"), (2, "x", "c", "d")], "row_id int, source_file string, text_cree string, text_en string")
    assert rows(pool.load_pool(df, "x").select("row_id")) == [(1,)]


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("k", 1, "L1"), ("k", 2, "L2"), (None, 3, "L3"), (None, 4, "L4")], "key string, line int, label string")
    assert rows(pool.first_wins(df, ["key"], ["line"]).select("label")) == [("L1",), ("L3",)]
    assert rows(pool.last_wins(df, ["key"], ["line"]).select("label")) == [("L2",), ("L4",)]


def test_cache_versions(spark):
    log = spark.createDataFrame([("k", 1, "v2", "L2"), ("k", 2, "v1", "L1")], "key string, line int, prompt_version string, label string")
    pick = lambda v: rows(incremental.cache_current(log, "key", ["line"], v).select("label"))
    assert pick("v2") == [("L2",)] and pick(None) == [("L1",)]


def test_surrogates_before_and_after_the_filter(spark):
    df = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "ord int, key string")
    known = spark.createDataFrame([("b",)], "key string")
    numbered = pool.ordinals(df, "ord", "id", 10)
    assert rows(pool.without(numbered, known, ["key"]).select("id")) == [(10,), (12,)]
    assert rows(pool.ordinals(pool.without(df, known, ["key"]), "ord", "id", 10).select("id")) == [(10,), (11,)]


def test_prefix_matches(spark):
    tokens = spark.createDataFrame([("kisê",)], "token string")
    lemmas = spark.createDataFrame([("kisê-manitow",), ("okisê",), ("kise",)], "lemma string")
    assert rows(pool.prefix_matches(tokens, lemmas)) == [("kisê", "kise"), ("kisê", "kisê-manitow")]


def test_zip_truncates(spark):
    a = spark.createDataFrame([(1, i, f"s{i}") for i in range(3)], "g int, o int, s string")
    b = spark.createDataFrame([(1, i, f"t{i}") for i in range(2)], "g int, o int, t string")
    assert rows(pool.zipped(a, b, "g", "o").select("s", "t")) == [("s0", "t0"), ("s1", "t1")]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = pool.upsert(old, new, ["k"])
    assert rows(once) == rows(pool.upsert(once, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]


def text(n, c="x"):
    return c * n


@pytest.mark.parametrize(
    ("src", "tgt", "spans"),
    [((10, 10, 10), (20, 10), [(2, 1), (1, 1)]), ((10, 20), (10, 10, 10), [(1, 1), (1, 2)]), ((10,), (5, 5, 5, 5), None), ((), (3,), [])],
)
def test_alignment(src, tgt, spans):
    got = align.align_lists([text(n) for n in src], [text(n) for n in tgt])
    if spans is None:
        assert got == [(text(10), " ".join([text(5)] * 4), 0.0)]
    else:
        assert [(len(s.split()), len(t.split())) for s, t, _ in got] == spans


def test_alignment_against_all_paths():
    rng = random.Random(3)

    def costs(n, m, i=0, j=0):
        if (i, j) == (len(n), len(m)):
            yield 0.0
        for a, b in align.STEPS:
            if i + a <= len(n) and j + b <= len(m):
                step = (sum(n[i : i + a]) / sum(n) - sum(m[j : j + b]) / sum(m)) ** 2
                yield from (step + c for c in costs(n, m, i + a, j + b))

    for _ in range(40):
        n = [rng.randint(1, 30) for _ in range(rng.randint(1, 5))]
        m = [rng.randint(1, 30) for _ in range(rng.randint(1, 5))]
        found = list(costs(n, m))
        pairs = align.align_lists([text(x) for x in n], [text(x) for x in m])
        if found:
            got = sum((sum(map(len, s.split())) / sum(n) - sum(map(len, t.split())) / sum(m)) ** 2 for s, t, _ in pairs)
            assert got == pytest.approx(min(found))


def test_sentence_ids_keep_gaps(spark):
    df = spark.createDataFrame([(1, "One long sentence here now. No. Another long sentence here.", "Une longue phrase bien ici. Non. Une autre longue phrase ici.")], "k int, a string, b string")
    assert rows(align.split_and_align(df, "k", "a", "b").select("sentence_id")) == [(0,), (2,)]


def test_rising_headers(spark):
    df = spark.createDataFrame([(1, i, str(n)) for i, n in enumerate((1, 2, 40, 2, 3, 36, 37, 5))], "d int, line_no int, line string")
    assert rows(parse.rising_headers(df, "d", F.col("line").cast("int")).select("num")) == [(1,), (2,), (3,), (36,)]


@pytest.mark.parametrize(("flags", "at"), [("FTFTT", 3), ("FFT", 2), ("FF", 2)])
def test_switch_index(spark, flags, at):
    df = spark.createDataFrame([(1, i, c == "T") for i, c in enumerate(flags)], "d int, i int, e boolean")
    assert parse.switch_index(df, "d", "i", "e").collect()[0]["at"] == at


def test_fragments(spark):
    parts = ["one two three four", "five six seven eight.", ". Then more words", "and an end"]
    got = spark.createDataFrame([(parts,)], "p array<string>").select(parse.merged_fragments(F.col("p")).alias("r")).collect()[0][0]
    assert got == ["one two three four five six seven eight.", ". Then more words and an end"]


def test_example_pairs_use_up_the_translation(spark):
    lines = ["Chapter 2", "", "  1. nōhkom nikamow.", "", "     Grandmother sings.", "12", "ēkwa nipāw   And she sleeps", "kīsikāw mīna", "Nothing else", "kīsikāw anohc"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (4, "nīpin ēsa\nsummer\rmīna pōna\r\nwinter too")], "k int, t string")
    got = rows(parse.grammar_examples(df, "k", "t"))
    assert [r[2:] for r in got if r[0] == 1] == [("nōhkom nikamow.", "Grandmother sings."), ("ēkwa nipāw", "And she sleeps"), ("kīsikāw mīna", "Nothing else")]
    assert [r for r in got if r[0] != 1] == [(4, 0, "nīpin ēsa", "summer"), (4, 1, "mīna pōna", "winter too")]


def test_a_line_of_both_languages_that_served_is_no_pair(spark):
    # The first line takes the second, which has a pair of its own; "x" lines take none.
    text = "kīsikāw mīna\nplain gloss   of this one\nkīsikāw anohc\nGloss\nnipāw ēkwa   she sleeps"
    got = rows(parse.grammar_examples(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").select("cree", "en"))
    assert got == [("kīsikāw anohc", "Gloss"), ("kīsikāw mīna", "plain gloss of this one"), ("nipāw ēkwa", "she sleeps")]


def test_html(spark):
    page = """<p class='crk paragraph' id='3'>a<b>b</b> &amp; c &lt;i&gt;<sup>2</sup></p><p>more<sup> 9 </sup></p><p class="footnote"><sup>9</sup> nine</p><p class=footnote><sup>2</sup> old</p>
    <p class="footnote"><sup>2</sup> two <sup>x</sup></p><p class="paragraph crk" id="x4">none</p><p class="paragraph eng"><strong>(3)</strong> en <strong>kept</strong></p><p>not taken</p><p class="paragraph eng"><strong>7</strong> only</p><!-- <p id="8" class="paragraph crk">gone</p> -->"""
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, '<p class="paragraph eng"><strong>(5)</strong> lost</p><p class="paragraph crk" id="5"></p><p class="paragraph eng"><strong>(5)</strong> k</p>')], "k int, html string")
    assert rows(html.page_paragraphs(df, "k", "html")) == [(1, 3, "a b & c <i>\nmore", "en kept", "[2] two x\n[9] nine"), (1, 7, "", "only", ""), (4, 5, "", "k", "")]
    assert rows(html.footnotes(df, "k", "html")) == [(1, 2, "two x"), (1, 9, "nine")]
    got = df.select(html.visible_text("html").alias("t")).collect()
    assert got[0]["t"].startswith("a b & c <i> more nine") and got[1]["t"] is None and got[2]["t"] == ""


def test_dictionary_html(spark):
    raw = """<ul><li class='search-results__result'><h2 class="a definition-title__title">x &amp; y</h2><div class="definition__elaboration"> <b>NA-1</b> more</div><span class="wordclass">\U0001f333 Naming word</span>
    <ol class="meanings"><li> one <cite>A</cite></li><li><i>two</i> B</li><li></li></ol></li><li class="search-results__result"><h2 class="definition-title__title">y</h2></li><li class="search-results__result"><ol class="meanings"><li>z</li></ol></li></ul>"""
    got = spark.createDataFrame([(raw,), (None,), ("",)], "h string").select(html.dictionary_entries("h").alias("e")).collect()
    assert [tuple(e) for e in got[0][0]] == [("x & y", "NA-1", "Naming word", ["one", "two"])]
    assert not got[1][0] and got[2][0] == []


def labelled(spark, truth, guess):
    return spark.createDataFrame([("lims".index(a), {"l": "literal", "i": "idiom", "m": "metaphor", "s": "simile"}[a], {"l": "literal", "i": "idiom", "m": "metaphor", "s": "simile"}[b]) for a, b in zip(truth, guess, strict=True)], "k int, t string, p string")


def test_scores_and_kappa(spark):
    counts = metrics.confusion(labelled(spark, "llim", "liil"), "t", "p")
    r = metrics.scores(counts).collect()[0]
    assert [r[f"f1_{c}"] for c in ("literal", "idiom", "metaphor", "simile")] == [0.5, 0.6667, 0.0, 0.0]
    assert r["macro_f1"] == 0.2917 and r["accuracy"] == 0.5
    assert metrics.kappa(counts).collect()[0]["kappa"] == pytest.approx(0.2)


def test_agreement_of_empty_labels(spark):
    got = {r["scope"]: (r["n"], r["agreement"]) for r in metrics.agreement_summary(metrics.confusion(labelled(spark, "ll", "li"), "t", "p")).collect()}
    assert got["overall"] == (2, 0.5) and got["simile"] == (0, None)


def test_class_weights(spark):
    df = spark.createDataFrame([(c,) for c in ["literal"] * 6 + ["idiom"] * 2 + ["metaphor", "simile", None]], "label string")
    assert {r["label"]: r["weight"] for r in metrics.class_weights(df, "label").collect()} == {"literal": 0.4167, "idiom": 1.25, "metaphor": 2.5, "simile": 2.5}


def test_weighted_agreement(spark):
    rates = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "label string, rate double")
    sizes = spark.createDataFrame([("a", 900), ("b", 100), ("c", 50)], "label string, n bigint")
    assert metrics.weighted_agreement(rates, sizes, "label").collect()[0][0] == pytest.approx(0.86)


def test_balancing(spark):
    df = spark.createDataFrame([(i, "idiom" if i < 4 else "literal") for i in range(24)], "k int, label string")
    got = dict(sample.balanced(df, "k", "label").groupBy("label").count().collect())
    assert got == {"idiom": 4, "literal": 12}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(500)], "k int, label string")
    a, b = (rows(sample.folds(x, "k", "label")) for x in (df.repartition(1), df.repartition(7)))
    assert a == b
    sizes = {}
    for _, label, fold in a:
        sizes[label, fold] = sizes.get((label, fold), 0) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_holdout_parts_the_input(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    got = dict(sample.holdout(df, "k", 0.05).groupBy("split").count().collect())
    assert got == {"train": 95, "dev": 6}
    assert rows(sample.holdout(df.limit(1), "k", 0.05).select("split")) == [("train",)]
    assert sample.holdout(df.limit(0), "k", 0.05).count() == 0


def test_retrieval(spark):
    t = spark.createDataFrame([(i, [float(i == j) for j in range(12)]) for i in range(12)], "id int, v array<double>")
    s = spark.createDataFrame([(0, [1.0] + [0.0] * 11), (1, [0.9, 0.5] + [0.0] * 10), (99, [1.0] * 12), (2, None)], "id int, v array<double>")
    assert rows(retrieval.gold_ranks(s, t)) == [(0, 1), (1, 2)]
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, 10)], "id int, rank int")
    r = retrieval.retrieval_metrics(ranks).collect()[0]
    assert (round(r["r1"], 4), round(r["r5"], 4), round(r["mrr"], 4)) == (0.3333, 0.6667, 0.5333)


def test_resume_leaves_failures_to_do(spark):
    pool_ = spark.createDataFrame([("a", "x like y"), ("b", " "), ("c", "plain")], "text_cree string, prompt string")
    cache = spark.createDataFrame([("c", "literal", "", "v1"), ("a", "literal", "", "v0")], "text_cree string, label string, reasoning string, prompt_version string")
    new = incremental.resume(pool_, cache, "text_cree", "prompt", "v1")
    assert rows(new.select("text_cree", "label", "prompt_version")) == [("a", "simile", "v1")]
    again = incremental.resume(pool_, cache.unionByName(new), "text_cree", "prompt", "v1")
    assert again.count() == 0


def test_failures_are_counted_by_reason(spark):
    def scorer(prompt):
        if prompt == "bad":
            raise ValueError("no answer")
        return (None, "") if prompt == "none" else ("literal", "")

    df = spark.createDataFrame([(1, "bad"), (2, "bad"), (3, "none"), (4, "x")], "k int, prompt string")
    assert rows(incremental.failures(df, "k", "prompt", scorer)) == [("ValueError: no answer", 2), ("no label", 1)]
    assert rows(incremental.scored(df, "k", "prompt", scorer).select("k")) == [(4,)]


def test_steps_and_commands(spark):
    got = rows(steps.run_steps(spark, [("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: 1 / 0)], skip=("c",)))
    assert got == [(0, "a", "OK", None), (1, "b", "FAILED", "ZeroDivisionError"), (2, "c", "SKIPPED", None)]
    df = spark.createDataFrame([({"temperature": "4", "learning_rate": "2e-5", "other": "x"},), ({},)], "c map<string,string>")
    assert rows(df.select(steps.stage(F.col("c")), steps.command(F.col("c")))) == [("clkd", "run --clkd-lr 2e-5 --clkd-temperature 4"), ("tlm", "run")]


def test_symmetric_loss_against_sums(spark):
    rng = random.Random(2)
    data = [(i // 5, i, [rng.gauss(0, 1) for _ in range(4)], [rng.gauss(0, 1) for _ in range(4)]) for i in range(10)] + [(9, 99, None, [1.0] * 4)]

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for batch, loss in losses.info_nce(spark.createDataFrame(data, "batch int, pair int, x array<double>, y array<double>"), 0.5).collect():
        own = [d for d in data if d[0] == batch]
        z = [[cos(a[2], b[3]) / 0.5 for b in own] for a in own]
        row = sum(math.log(sum(map(math.exp, r))) - r[i] for i, r in enumerate(z)) / len(own)
        col = sum(math.log(sum(math.exp(r[j]) for r in z)) - z[j][j] for j in range(len(own))) / len(own)
        assert loss == pytest.approx((row + col) / 2)


def test_masked_mean_of_nothing(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [0.0, 1.0]), ([[1.0, 2.0]], [0.0])], "t array<array<double>>, m array<double>")
    assert [r[0] for r in df.select(vectors.masked_mean(F.col("t"), F.col("m"), 2)).collect()] == [[3.0, 4.0], [0.0, 0.0]]


def test_bootstrap_counts_keep_the_size(spark):
    counts = spark.createDataFrame([("literal", "literal", 7), ("idiom", "literal", 3)], "t string, p string, n bigint")
    got = sample.bootstrap(counts, 300)
    assert {r["n"] for r in got.groupBy("replicate").agg(F.sum("n").alias("n")).collect()} == {10}
    assert abs(got.filter("t = 'idiom'").agg(F.sum("n")).collect()[0][0] / 3000 - 0.3) < 0.03
    assert sample.bootstrap(counts.limit(0), 5).count() == 0


def test_logits_want_all_labels(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0, 0.0], 1), ([1.0, 0.0, 0.0, 0.0], 0)], "a array<double>, y int")
    with pytest.raises(ValueError, match="metaphor"):
        metrics.from_logits(df, "a", "y")


def test_attach_with_a_hot_key(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(3000)] + [(9999, None)], "id int, key string")
    groups = df.groupBy("key").agg(F.count("*").alias("n"))
    assert skew.attach(df, groups, ["key"], "n").count() == 3000


def test_salted_joins_equal_plain_ones(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(6000)] + [(9000 + i, None) for i in range(5)], "id int, key string")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "key string, v int")
    for how in ("inner", "left"):
        assert sorted(map(repr, skew.salted(df, other, ["key"], "id", how).select("id", "key", "v").collect())) == sorted(map(repr, df.join(other, "key", how).select("id", "key", "v").collect()))
    assert skew.salted(df.limit(0), other, ["key"], "id").count() == 0


def test_stories(spark):
    cree = "Êkwa kisêyiniw kî-pê-itohtêw ôta mîna."
    en = "And then the old man came to this place and said it to them all."
    text = f"(3) Contents\nTEXTS AND TRANSLATIONS\n(1) First Story\n\n12\n\n{cree}\n* note\n\n{cree}\n\n{en}\n\n{en}\n\n(1) Not Again\n\n(2) Second Story\n\n{cree}\n"
    got = {r["num"]: (len(r["cree"]), len(r["en"])) for r in parse.stories(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").collect()}
    assert got == {1: (2, 2), 2: (1, 0)}


def test_line_machine_takes_rows_of_every_source(spark, tmp_path):
    from glossmill.plans.text_queries import line_machine

    rows = [(1, "okimasis", "nīpiy kī-wāpamēw", "the dog saw the water"), (2, "other", "nīpiy kī-wāpamēw", "the dog saw the water"), (3, None, "nīpiy kī-wāpamēw", "the dog saw the water"), (4, "other", None, "x")]
    spark.createDataFrame(rows, "row_id bigint, source_file string, text_cree string, text_en string").write.parquet(f"{tmp_path}/bloomfield_texts_sentences.parquet")
    got = [tuple(r)[1:] for k in (1, 2, 3) for r in line_machine(spark, str(tmp_path)).filter(f"row_id = {k}").collect()]
    assert got and len(got) % 3 == 0 and got[: len(got) // 3] * 3 == got
