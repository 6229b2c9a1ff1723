"""What the training-data operators share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: White space of the word definition ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at exactly these bytes.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of the decontamination contract, after A-Z were lower-cased.
PLAIN_WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``; only in local mode, and where that is unset, a temporary folder is
    made and set, so that ``checkpoint()`` uses the same place.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quarrymill-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rsplit("/", 1)[0])
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, f)
