"""New paths, and tables that are read more than once, in the folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, in local mode a temporary one where that is unset; deleted at the end."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        sc.setCheckpointDir(named)
    top = f"{named.rstrip('/')}/quarrymill-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):
            p = sc._jvm.org.apache.hadoop.fs.Path(top)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    return f"{top}/{name}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as Parquet into the shared folder and read again, for what is read more than once."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
