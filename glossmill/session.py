"""Session helpers: table access, shared storage, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder; columns are pruned by whoever selects."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="glossmill-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager)


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Columnar, so later readers prune columns; used where one result feeds several stages.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glossmill-tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written.append((spark, path))
    table_ = spark.read.schema(df.schema).parquet(path)
    table_._glossmill_path = path
    return table_


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder for files of one job; :func:`release` deletes it."""
    path = f"{shared_dir(spark)}/glossmill-tables/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def free(*frames: DataFrame) -> None:
    """Delete the tables behind frames that :func:`written` gave, as soon as nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_glossmill_path", None)
        for item in [x for x in _written if x[1] == path]:
            _delete(*item)
            _written.remove(item)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession | None = None) -> None:
    """Delete the tables that :func:`written` made, of one session or of all."""
    for item in [x for x in _written if spark is None or x[0] is spark]:
        _delete(*item)
        _written.remove(item)


atexit.register(release)
