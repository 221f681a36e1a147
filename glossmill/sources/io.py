"""Readers and writers: Parquet, `src ||| tgt` text, JSON lines, tabs; missing sources give empty frames of the right schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from glossmill.functions.labels import merged
from glossmill.functions.text import strip
from glossmill.operators.align import align_lists
from glossmill.session import written

SCHEMAS = {
    "label_cache": "text_cree string, label string, reasoning string, prompt_version string",
    "paragraph_cache": "paragraph_id bigint, annotations array<struct<sentence_num:int,label:string,footnote_applies:boolean,rationale:string>>",
    "review_log": "paragraph_id bigint, sentence_id bigint, deepseek_label string, human_label string, note string",
}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def try_read(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet") -> DataFrame:
    """The table, or an empty one of the schema where nothing is there."""
    return spark.read.schema(schema).format(fmt).load(path) if exists(spark, path) else spark.createDataFrame([], schema)


def split_pairs(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(src, tgt) of lines with the separator, cut once, both sides stripped."""
    has = lines.filter(F.col(column).contains("|||"))
    cut = F.split(strip(F.col(column)), r"\|\|\|", 2)
    return has.select(*keep, strip(F.get(cut, F.lit(0))).alias("src"), strip(F.get(cut, F.lit(1))).alias("tgt"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return split_pairs(spark.read.text(path))


def pair_line(src: str, tgt: str):
    """One line of a pair."""
    return F.concat_ws(" ||| ", F.col(src), F.col(tgt))


def write_pairs(df: DataFrame, path: str, src: str, tgt: str, mode: str = "overwrite") -> None:
    df.select(pair_line(src, tgt).alias("value")).write.mode(mode).text(path)


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a known schema; blank and broken lines are dropped. An order must be a column of the log, as files have none."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "DROPMALFORMED").json(path)


def append_log(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Lines appended to a log, in folders by the values of columns where some are named."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_tabs(spark: SparkSession, path: str) -> DataFrame:
    """S06."""
    return spark.read.csv(path, sep="\t", header=True)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def eval_rows(spark: SparkSession, path: str | None, default: DataFrame, label: str = "label") -> DataFrame:
    """(text_cree, label) of another evaluation file where a path is given, else of the default table; labels by the first normalizer, rows without text dropped."""
    df = default if path is None else spark.read.parquet(path)
    return df.filter(F.col("text_cree").isNotNull()).select("text_cree", merged(F.col(label)).alias("label"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one text file, in its order, stripped, blank lines dropped; the order is that of the file, so a file is read whole."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "line")).withColumn("line", strip(F.col("line"))).filter(F.col("line") != "")
    return lines.withColumn("line_no", F.row_number().over(Window.orderBy("pos")) - 1).select("line_no", "line")


def read_manifest(spark: SparkSession, manifest: list[tuple[str, str, str]], least: int = 1) -> tuple[DataFrame, list[tuple[str, int | None, str | None]]]:
    """((label, src, tgt), report) of a manifest of (source file, target file, label).

    Files of as many lines are paired line by line, others by the length-based aligner. A pair that
    cannot be read is skipped and named in the report, which has (label, pairs, error); it stops nothing.
    """
    pairs, report = spark.createDataFrame([], "label string, src string, tgt string"), []
    for left, right, label in manifest:
        try:
            sides = [text_lines(spark, p) for p in (left, right)]
            sizes = [s.count() for s in sides]
            a, b = (s.withColumnRenamed("line", name) for s, name in zip(sides, ("src", "tgt"), strict=True))
            if sizes[0] == sizes[1]:
                found = a.join(b, "line_no").select("src", "tgt")
            else:
                src, tgt = ([r[1] for r in s.orderBy("line_no").collect()] for s in sides)
                found = spark.createDataFrame([(s, t) for s, t, _ in align_lists(src, tgt)], "src string, tgt string")
            found = found.filter((F.length("src") >= least) & (F.length("tgt") >= least))
            report.append((label, found.count(), None))
            pairs = pairs.unionByName(found.select(F.lit(label).alias("label"), "src", "tgt"))
        except Exception as problem:
            report.append((label, None, type(problem).__name__))
    return pairs, report


def local_or(spark: SparkSession, path: str, other) -> DataFrame:
    """The table at a path where there is one, else what ``other`` gives."""
    return spark.read.parquet(path) if exists(spark, path) else other()


def write_by(df: DataFrame, path: str, column: str = "model") -> None:
    """One folder per value, such as the slug of a model; other values stay."""
    df.write.mode("append").partitionBy(column).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Overwrite a table, also one that ``df`` reads: the result is staged in the shared folder first."""
    written(df).write.mode("overwrite").parquet(path)


def guarded(spark: SparkSession, path: str, backup: str) -> DataFrame:
    """The table, after a backup has been made once; FileExistsError if there is one already."""
    if exists(spark, backup):
        raise FileExistsError(backup)
    spark.read.parquet(path).write.mode("errorifexists").parquet(backup)
    return spark.read.parquet(path)


def drawn_once(df: DataFrame, path: str, redraw: bool = False) -> DataFrame:
    """The persisted sample, drawn and written where there is none or a new one is wanted."""
    spark = df.sparkSession
    if redraw or not exists(spark, path):
        overwrite(df, path)
    return spark.read.parquet(path)
