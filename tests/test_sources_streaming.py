from glossmill.operators import incremental
from glossmill.sources import io
from glossmill.streaming.labelling import label_stream


def test_pairs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a ", " b ||| c"), ("x", "y")], "s string, t string")
    io.write_pairs(df, str(tmp_path / "p"), "s", "t")
    assert sorted(map(tuple, io.read_pairs(spark, str(tmp_path / "p")).collect())) == [("a", "b ||| c"), ("x", "y")]
    lines = spark.createDataFrame([("no separator",), (" l ||| r ",), (None,)], "value string")
    assert [tuple(r) for r in io.split_pairs(lines).collect()] == [("l", "r")]


def test_missing_source_is_empty(spark, tmp_path):
    assert io.try_read(spark, str(tmp_path / "none"), io.SCHEMAS["review_log"]).count() == 0


def test_logs_skip_blank_and_broken_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"paragraph_id": 1, "annotations": [{"sentence_num": 1, "label": "idiom"}]}\n\n{broken\n')
    got = io.read_log(spark, str(tmp_path / "log.json"), "paragraph_cache").selectExpr("paragraph_id", "inline(annotations)").collect()
    assert [(r["paragraph_id"], r["sentence_num"], r["label"]) for r in got] == [(1, 1, "idiom")]


def test_tabs_and_whole_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("sentence\tusage\nab\tfigurative\n")
    assert [tuple(r) for r in io.read_tabs(spark, str(tmp_path / "t.tsv")).collect()] == [("ab", "figurative")]
    assert io.read_whole(spark, str(tmp_path / "t.tsv")).collect()[0]["value"].startswith("sentence")


def test_overwrite_of_what_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    io.overwrite(spark.read.parquet(path).filter("id > 1"), path)
    assert spark.read.parquet(path).count() == 3


def test_backup_only_once(spark, tmp_path):
    path, backup = str(tmp_path / "t"), str(tmp_path / "b")
    spark.range(2).write.parquet(path)
    io.guarded(spark, path, backup)
    try:
        io.guarded(spark, path, backup)
    except FileExistsError:
        return
    raise AssertionError("a second backup was made")


def test_drawn_sample_is_reused(spark, tmp_path):
    path = str(tmp_path / "s")
    assert io.drawn_once(spark.range(3), path).count() == 3
    assert io.drawn_once(spark.range(9), path).count() == 3
    assert io.drawn_once(spark.range(9), path, redraw=True).count() == 9


def test_label_stream_is_idempotent(spark, tmp_path):
    src, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", "as if b"), ("a", "as if b"), ("c", "")], "text_cree string, prompt string")
    rows.coalesce(1).write.json(src)
    for run in range(2):
        stream = spark.readStream.schema("text_cree string, prompt string").json(src)
        label_stream(spark, stream, cache, str(tmp_path / f"check{run}"), "v1").awaitTermination(120)
    got = io.try_read(spark, cache, io.SCHEMAS["label_cache"], "json").collect()
    assert [(r["text_cree"], r["label"], r["prompt_version"]) for r in got] == [("a", "simile", "v1")]
    assert incremental.version_of("x") == incremental.version_of("x")
