import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from glossmill.llm import consensus, formatting, mixing, overlap, splits

POOL = "row_id bigint, source_file string, paragraph_id bigint, grp int, node string, label string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def tied(data):
    """Brute force: union-find over rows by file name and paragraph."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, s, p, *_ in data:
        if s is not None:
            name = s.strip().lower().rpartition("/")[2].removesuffix(".html").strip()
            parent[find(("r", i))] = find(("f", name))
        if p is not None:
            parent[find(("r", i))] = find(("p", p))
    return {i: find(("r", i)) for i, *_ in data}, parent


def pool_rows(seed, n=300):
    rng = random.Random(seed)
    forms = ["f{}", " F{}", "texts/f{}", "/f{}.html", "F{}.HTML "]
    out = []
    for i in range(n):
        s = rng.choice(forms).format(rng.randint(0, 40)) if rng.random() < 0.8 else None
        out.append((i, s, rng.choice([None, rng.randint(0, 150)]), 0, "x", "y"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_split_pairs_against_union_find(spark, seed):
    data = pool_rows(seed)
    comp, _ = tied(data)
    stored = {(s, comp[i]) for i, s, *_ in data if s is not None}
    expected = sorted((a, b) for a, ca in stored for b, cb in stored if ca == cb and a.encode() < b.encode())
    assert rows(splits.shared_split_pairs(spark.createDataFrame(data, POOL))) == expected


def test_long_chain_of_ties(spark):
    data = [(2 * i, f"f{i}", i, 0, "", "") for i in range(60)] + [(2 * i + 1, f"f{i + 1}", i, 0, "", "") for i in range(60)]
    assert splits.shared_split_pairs(spark.createDataFrame(data, POOL)).count() == 61 * 60 // 2


def test_splits_keep_groups_and_proportions(spark):
    data = pool_rows(5, 200) + [(1000 + i, None, None, 0, "", "") for i in range(2000)] + [(5000 + i, "big", None, 0, "", "") for i in range(300)]
    df = spark.createDataFrame(data, POOL)
    got = {r["row_id"]: r["split"] for r in splits.assign(df, label=F.when(F.col("row_id") % 2 == 0, "even")).collect()}
    assert set(got) == {d[0] for d in data}
    comp, _ = tied(data)
    seen = {}
    for i, c in comp.items():
        assert seen.setdefault(c, got[i]) == got[i]
    share = sum(v == "train" for v in got.values()) / len(got)
    assert 0.7 < share < 0.9
    assert splits.assign(df.limit(0)).count() == 0


def test_groups_name_their_links(spark):
    data = [(1, "a", 1, 0, "", ""), (2, "A.html", 2, 0, "", ""), (3, "b", 2, 0, "", ""), (4, "c", None, 0, "", ""), (5, None, 1, 0, "", "")]
    assert rows(splits.tied_groups(spark.createDataFrame(data, POOL))) == [("A.html", "a", 2), ("a", "a", 2), ("b", "a", 2), ("c", "c", 0)]


def test_many_labels_and_small_groups_are_placed_by_one_rule(spark):
    data = [(i, f"s{i % 700}", None, 0, "", f"l{i % 150}") for i in range(6000)] + [(9000 + i, "big", None, 0, "", "l0") for i in range(2500)]
    out = splits.assign(spark.createDataFrame(data, POOL), label=F.col("label")).groupBy("split").count().collect()
    share = {r["split"]: r["count"] / 8500 for r in out}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03


def fold(t):
    t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    return "".join(c for c in t if c.isalnum())


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[j - 1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeiokmnpstwy") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    gold = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 12)))) for i in range(60)]
    silver = [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 12)))) for i in range(200)]
    for k, (_, t) in enumerate(gold[:40]):
        w = t.split()
        if k % 4 == 0:
            w.insert(rng.randrange(len(w)), "âka")
        elif k % 4 == 1:
            w[rng.randrange(len(w))] = w[0].upper()
        elif k % 4 == 2:
            i = rng.randrange(len(w))
            w[i] = w[i][:-1] + "z"
        silver.append((2000 + k, "  ".join(w) + "!"))
    silver += [(3000, gold[0][1]), (3001, gold[0][1]), (3002, None), (3003, ""), (3004, " -- ")]
    gold += [(61, None), (62, ""), (63, gold[0][1])]
    g, s = (spark.createDataFrame([(*r, 0, 0) for r in x], "row_id bigint, text_cree string, cls int, words int") for x in (gold, silver))
    expected = sorted(
        (i, j) for i, a in gold for j, b in silver
        if a and b and (x := fold(a)) and (y := fold(b)) and 100 * distance(x, y) <= 15 * max(len(x), len(y))
    )
    assert rows(overlap.cross_split(g, s)) == expected
    assert overlap.cross_split(g.limit(0), s).count() == 0


def test_overlap_of_very_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("aeiokmnpstwy") for _ in range(7000))
    near = list(text)
    for k in rng.sample(range(7000), 700):
        near[k] = "z"
    del near[100:200]
    far = "".join(rng.choice("aeiokmnpstwy") for _ in range(7000))
    gold = spark.createDataFrame([(1, text), (2, "atim nipaw"), (3, far[:3100])], "row_id int, text_cree string")
    silver = spark.createDataFrame([(10, "".join(near)), (11, far), (12, "atim nipâw!"), (13, far[50:3050]), (14, text[:3000])], "row_id int, text_cree string")
    expected = [(1, 10), (2, 12), (3, 13)]
    assert rows(overlap.near_pairs(gold, silver).select("left_id", "right_id")) == expected
    monkeypatch.setattr(overlap, "BLOCK_LETTERS", 8000)
    assert rows(overlap.near_pairs(gold, silver).select("left_id", "right_id")) == expected


def test_overlap_of_short_texts(spark):
    g = spark.createDataFrame([(1, "Nipiy"), (2, "kôna")], "row_id bigint, text_cree string")
    s = spark.createDataFrame([(10, "nipiy!"), (11, "KONA"), (12, "maskwa")], "row_id bigint, text_cree string")
    assert rows(overlap.cross_split(g, s)) == [(1, 10), (2, 11)]


def test_counts_keep_null_groups(spark):
    g = spark.createDataFrame([(1, "sînipak kîsikâw nipiy maskwa", "test", None)], "row_id bigint, text_cree string, eval_split string, source_file string")
    s = spark.createDataFrame([(10, "sinipak kisikaw nipiy maskwa"), (11, "SINIPAK kîsikâw, nipiy maskwa")], "row_id bigint, text_cree string")
    assert rows(overlap.counts(g, s)) == [("test", None, 2, 1, 2)]


SILVER = "row_id bigint, text_cree string, text_en string, key string, copies int"


def test_formatting_duplicates(spark):
    data = [(5, "Ê-pimohtêt, ana.", "He walks!", "", 0), (2, "he  walks", "ê pimohtêt ANA", "", 0), (3, "e-pimohtet ana", "He walks", "", 0), (4, None, "x", "", 0), (6, "X", "", "", 0), (7, None, None, "", 0), (8, " ", "--", "", 0), (9, "ê-pimohtêt ana", "he walks", "", 0)]
    df = spark.createDataFrame(data, SILVER)
    assert rows(formatting.members(df)) == [(2, 5), (2, 9), (4, 6), (7, 8)]
    assert rows(formatting.collapse(df)) == [(2, 3), (3, 1), (4, 2), (7, 2)]
    assert formatting.collisions(formatting.canonical(df, "row_id", "text_cree", "text_en")).count() == 0
    assert formatting.members(df.limit(0)).count() == 0


def test_the_form_of_a_text_does_not_hang_on_its_other_characters(spark):
    rng = random.Random(4)
    odd = "aB2²ª½ĳŀſé¨µº\u0301\u0308ᐊᐢᕽÅÅﬁＡς Σ.-…‗"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    data = [(2 * i, t, None) for i, t in enumerate(texts)] + [(2 * i + 1, t + "☃\u00a0", "") for i, t in enumerate(texts)]
    keyed = {r["row_id"]: bytes(r["key"]) for r in formatting.canonical(spark.createDataFrame(data, "row_id bigint, a string, b string"), "row_id", "a", "b").collect()}
    assert [i for i, t in enumerate(texts) if keyed[2 * i] != keyed[2 * i + 1]] == []


def test_one_record_with_many_copies(spark):
    df = spark.createDataFrame([(i, "a b" if i % 3 == 0 else f"t{i}", "A. B" if i % 3 == 0 else "", "", 0) for i in range(1, 3001)], SILVER)
    got = formatting.members(df)
    assert got.count() == 999 and {r["first_row_id"] for r in got.collect()} == {3}


LOG = "paragraph_id bigint, sentence_id bigint, deepseek_label string, human_label string, note string, annotator string, reviewed_at timestamp, label string"
GOLD = "paragraph_id bigint, sentence_id bigint, label string, annotated_at timestamp"


def simulated(spark, seed=4, items=400):
    import datetime

    rng = random.Random(seed)
    names = consensus.LABELS
    truth = {i: rng.choices(names, (5, 2, 2, 1))[0] for i in range(items)}
    log = []
    t0 = datetime.datetime(2024, 1, 1)
    for i, t in truth.items():
        said = "simile" if i % 4 == 0 else t
        for a in rng.sample(range(12), 6):
            if a < 5:
                v = "literal"  # never looks
            elif a < 7:
                v = rng.choice(names)
            else:
                v = t if rng.random() < 0.95 else rng.choice(names)
            log.append((i, 0, said, rng.choice([v, v.upper(), f" {v}", v[0]]), "", f"a{a}", t0 + datetime.timedelta(minutes=len(log)), "x"))
    log += [(0, 0, "simile", None, "", "a1", t0 + datetime.timedelta(days=9), "x"), (None, 0, "idiom", "idiom", "", "a1", t0, "x"), (1, 0, "idiom", "pun", "", "a9", t0 + datetime.timedelta(days=9), "x"), (1, 0, "idiom", "idiom", "", None, t0, "x")]
    gold = [(i, 0, truth[i], t0) for i in range(0, 60)] + [(9999, 0, "idiom", t0), (5, 0, None, t0)]
    return truth, spark.createDataFrame(log, LOG), spark.createDataFrame(gold, GOLD)


def test_consensus_follows_the_trustworthy_few(spark):
    truth, log, gold = simulated(spark)
    got = {r["paragraph_id"]: r["consensus_label"] for r in consensus.consensus(log, gold).collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 0.93 * len(truth)
    trust = {r["annotator"]: r["reliability"] for r in consensus.reliability(log, gold).collect()}
    assert min(trust[f"a{i}"] for i in range(7, 12)) > 0.85 > 0.7 > max(trust[f"a{i}"] for i in range(7))
    assert consensus.GOLD in trust and consensus.MODEL in trust
    wrong = {r["paragraph_id"] for r in consensus.disputed(log, gold).collect()}
    right = {i for i, t in truth.items() if i % 4 == 0 and t != "simile"}
    assert len(wrong & right) >= 0.9 * len(right)


def test_table_form_gives_the_same_estimate(spark, monkeypatch):
    _, log, gold = simulated(spark, 8, 80)
    cast = consensus.votes(log, gold)
    items, trust = consensus.estimate(cast)
    monkeypatch.setattr(consensus, "MAX_ANNOTATORS", 1)
    monkeypatch.setattr(consensus, "ROUNDS", 12)
    items2, trust2 = consensus.estimate(cast)
    a, b = ({(r[0], r[1]): r["label"] for r in x.collect()} for x in (items, items2))
    assert sum(a[k] == b[k] for k in a) >= 0.97 * len(a)
    x, y = ({r["annotator"]: r["reliability"] for r in t.collect()} for t in (trust, trust2))
    assert max(abs(x[k] - y[k]) for k in x) < 0.05


def test_agreement_is_chance_corrected(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, 0, "x", v, "", a, t, "") for i, pair in enumerate((("l", "l"), ("i", "i"), ("m", "m"))) for a, v in zip("ab", pair, strict=True)], LOG)
    r = consensus.agreement(log, spark.createDataFrame([], GOLD)).collect()[0]
    assert (r["items"], r["opinions"], r["observed"], r["alpha"]) == (3, 6, 1.0, 1.0)


def test_consensus_of_nothing(spark):
    empty = spark.createDataFrame([], LOG), spark.createDataFrame([], GOLD)
    assert consensus.consensus(*empty).count() == 0 and consensus.disputed(*empty).count() == 0


def test_quotas_respect_caps_and_shares():
    got = mixing.fill([("a", 0.5, 1, 100), ("b", 0.3, 9, 1000), ("c", 0.2, 2, 0), ("d", 0.0, 3, 50)], 1000)
    assert got["a"] == 100 and got["b"] == 900 and got["c"] == got["d"] == 0
    assert mixing.fill([("a", 1.0, 2, 10)], 1000) == {"a": 20}


def test_quotas_of_a_table_equal_those_of_a_list(spark):
    rng = random.Random(8)
    for _ in range(4):
        sources = [(f"s{i}", rng.choice([0.0, rng.random()]), rng.choice([None, 0, 1, 2, 9]), rng.choice([0, rng.randint(1, 2000)])) for i in range(30)]
        df = spark.createDataFrame(sources, "source string, target_share double, max_repeats int, tokens bigint")
        budget = rng.choice([None, 500, 10**7])
        expected = mixing.fill(sources, budget)
        got = {r["source"]: r["quota"] for r in mixing.quotas(df, budget).collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) <= 1 for k in got)


def test_mix_of_many_targets(spark, monkeypatch):
    usual = [rows(x) for x in mixed(spark, 2)]
    monkeypatch.setattr(mixing, "MAX_TARGETS", 0)
    assert [rows(x) for x in mixed(spark, 2)] == usual


def mixed(spark, parts):
    docs = [(i, f"s{i % 3}" if i % 10 else None, 50 + i % 7, 1.0) for i in range(1, 1001)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, weight double").repartition(parts)
    targets = spark.createDataFrame([("s0", 0.7, 2), ("s1", 0.2, 1), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    return mixing.mix(sized, targets)


def test_mix_is_reproducible_and_near_its_shares(spark):
    chosen, plan = mixed(spark, 1)
    again, _ = mixed(spark, 7)
    assert rows(chosen) == rows(again)
    report = {r["source"]: r for r in mixing.report(chosen, plan).collect()}
    assert report["none"]["mix_tokens"] == 0 and report["s0"]["most_copies"] <= 2
    total = sum(r["mix_tokens"] for r in report.values())
    assert abs(report["s0"]["mix_tokens"] / total - 0.7 / 0.9) < 0.01 and report["s0"]["actual_share"] == pytest.approx(report["s0"]["mix_tokens"] / total)
    assert {r["source"] for r in chosen.collect()} == {"s0", "s1"}


def test_mix_prefers_weighty_documents(spark):
    sized = spark.createDataFrame([(i, "a", 10, 5.0 if i % 2 else 0.2) for i in range(2000)], "doc_id bigint, source string, n_tokens bigint, weight double")
    chosen, _ = mixing.mix(sized, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"), budget=5000)
    ids = [r["doc_id"] for r in chosen.collect()]
    assert abs(len(ids) - 500) <= 1 and sum(i % 2 for i in ids) > 400


def test_mix_of_nothing(spark):
    sized = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, weight double")
    chosen, plan = mixing.mix(sized, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert chosen.count() == 0 and mixing.report(chosen, plan).collect()[0]["mix_tokens"] == 0


def test_overlaps_without_a_common_word(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeiokmnpstwy") for _ in range(rng.randint(5, 9))) for _ in range(300)]
    gold = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))) for i in range(60)] + [(90, "a"), (91, "ab"), (92, "maskwa")]
    silver = []
    for k, (_, t) in enumerate(gold):
        letters = t.replace(" ", "")
        silver.append((1000 + k, letters if k % 2 else " ".join(letters[i : i + 3] for i in range(0, len(letters), 3))))
        silver.append((2000 + k, " ".join(w[:j] + rng.choice("zqx") + w[j + 1 :] for w in t.split() for j in [rng.randrange(len(w))])))
        edited = list(letters)
        for i in sorted(rng.sample(range(len(edited)), len(edited) * 15 // 100), reverse=True):
            edited[i : i + 1] = rng.choice([[], ["z"], [edited[i], "z"]])
        silver.append((3000 + k, "".join(edited)))
    g, s = (spark.createDataFrame(x, "row_id bigint, text_cree string") for x in (gold, silver))
    expected = sorted((i, j) for i, a in gold for j, b in silver if 100 * distance(x := fold(a), y := fold(b)) <= 15 * max(len(x), len(y)))
    assert len(expected) > 100
    assert rows(overlap.cross_split(g, s)) == expected


def test_overlap_shuffles_no_block_twice(spark, monkeypatch):
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sum(sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(False).size()))

    rng = random.Random(3)
    gold = [(i, "".join(rng.choice("aeiokmnpstwy") for _ in range(rng.randint(150, 900)))) for i in range(60)]
    silver = [(100 + i, "".join(rng.choice("aeiokmnpstwy") for _ in range(rng.randint(150, 900)))) for i in range(60)]
    silver += [(1000 + i, t[:70] + "z" + t[72:]) for i, t in gold[::2]]
    g, s = (spark.createDataFrame(x, "row_id bigint, text_cree string") for x in (gold, silver))
    moved = [shuffled()]
    for block in (50_000, 5):
        monkeypatch.setattr(overlap, "BLOCK", block)
        assert rows(overlap.cross_split(g, s)) == [(i, 1000 + i) for i in range(0, 60, 2)]
        moved.append(shuffled())
    assert moved[2] - moved[1] < 2 * (moved[1] - moved[0])
