"""Run documents: one JSON file for each site and run, ``<site>/output_<time>.json``, that readers see whole or not at all.

A site's document is written as lines, in order, by one task that holds none but the line at hand; Spark's commit protocol
keeps what failed tasks have written out of sight. Only when all documents of a run are there are the files moved to
their names, each by a rename, and only then is the run's mark written, which ``finished_runs`` goes by.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.shared import fresh_path

_PART = re.compile(r"/doc=([^/]+)/part-[^/]*$")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def slug(site: Column) -> Column:
    """A site's folder: its host and path with other characters than letters and digits as dashes."""
    bare = F.regexp_replace(F.lower(F.coalesce(site, F.lit(""))), "^[a-z][a-z0-9+.-]*://(?:www\\.)?", "")
    named = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(named == "", "none").otherwise(named)


def _named(sites: DataFrame) -> DataFrame:
    """``sites`` (site) with ``doc``, the site's folder; sites that share one have a part of their hash in its name."""
    own = sites.withColumn("doc", slug(F.col("site")))
    shared = F.count("*").over(Window.partitionBy("doc")) > 1
    return own.withColumn("doc", F.when(shared, F.concat("doc", F.lit("-"), F.substring(F.md5("site"), 1, 8))).otherwise(F.col("doc")))


def write_documents(lines: DataFrame, path: str, name: str) -> list[str]:
    """``lines`` (doc, at, line) to ``path/<doc>/<name>``, a file per doc, its lines by ``at``; gives the names of the files.

    Files that are there already are replaced one by one. The number of documents is the driver's only list.
    """
    spark = lines.sparkSession
    staged = fresh_path(spark, "staged")
    whole = lines.select("doc", "at", F.col("line").alias("value")).repartition("doc").sortWithinPartitions("doc", "at").drop("at")
    whole.write.partitionBy("doc").option("maxRecordsPerFile", 0).text(staged)
    Path, fs = _fs(spark, path)
    made, found = [], fs.listFiles(Path(staged), True)
    while found.hasNext():
        part = found.next().getPath()
        if m := _PART.search(part.toString()):
            to = Path(f"{path}/{m[1]}/{name}")
            fs.mkdirs(to.getParent())
            near = Path(f"{path}/{m[1]}/.{name}.new")  # beside its place first: a rename between folders of one file system is whole, a copy is not
            if fs.exists(near):
                fs.delete(near, False)
            if not fs.rename(part, near):
                raise OSError(f"can't move {part} to {near}")
            if fs.exists(to):
                fs.delete(to, False)
            if not fs.rename(near, to):
                raise OSError(f"can't move {near} to {to}")
            made.append(f"{m[1]}/{name}")
    return sorted(made)


def run_lines(records: DataFrame, site: str, order: str, metadata: DataFrame | None = None) -> DataFrame:
    """``(doc, at, line)`` of a run's documents: site and metadata, then an item a line, then the end.

    ``metadata`` (site, metadata) may add a struct per site; sites without records but with metadata have an empty list.
    """
    item = F.struct(*[c for c in records.columns if c != site])
    place = F.row_number().over(Window.partitionBy(site).orderBy(order))
    items = records.select(F.col(site).alias("site"), place.cast("long").alias("at"), F.to_json(item, {"ignoreNullFields": "false"}).alias("json"))
    body = items.select("site", "at", F.concat(F.when(F.col("at") > 1, ",").otherwise(""), "json").alias("line"))
    sites = records.select(F.col(site).alias("site")).distinct()
    if metadata is not None:
        said = metadata.select("site", F.to_json("metadata").alias("m"))
        heads = sites.union(said.select("site")).distinct().join(said, "site", "left")
    else:
        heads = sites.withColumn("m", F.lit(None).cast("string"))
    opened = F.concat(F.lit('{"site":'), F.to_json(F.struct(F.col("site").alias("url"))), F.lit(',"metadata":'), F.coalesce("m", F.lit("{}")), F.lit(',"products":['))
    head = heads.select("site", F.lit(0).cast("long").alias("at"), opened.alias("line"))
    foot = heads.select("site", F.lit(2**62).cast("long").alias("at"), F.lit("]}").alias("line"))
    return head.union(body).union(foot).join(_named(heads.select("site")), "site").select("doc", "at", "line")


def write_run_documents(records: DataFrame, path: str, run: str, site: str = "site", order: str = "id", metadata: DataFrame | None = None) -> list[str]:
    """A run's records as ``<site>/output_<run>.json``; the mark ``_runs/<run>`` says that all of them are there."""
    made = write_documents(run_lines(records, site, order, metadata), path, f"output_{run}.json")
    Path, fs = _fs(records.sparkSession, path)
    fs.mkdirs(Path(f"{path}/_runs"))
    fs.create(Path(f"{path}/_runs/{run}"), True).close()
    return made


def finished_runs(spark: SparkSession, path: str) -> list[str]:
    """The runs whose documents are all there, oldest first."""
    Path, fs = _fs(spark, path)
    marks = Path(f"{path}/_runs")
    return sorted(f.getPath().getName() for f in fs.listStatus(marks)) if fs.exists(marks) else []


def sync_lists(urls: DataFrame, path: str, site: str = "site", order: str = "pos") -> list[str]:
    """A site's ``urls.json`` beside its runs, written anew from its rows: ``{"urls": [...]}``; gives the names of the files."""
    place = F.row_number().over(Window.partitionBy(site).orderBy(order))
    each = urls.select(F.col(site).alias("site"), place.cast("long").alias("at"), F.to_json(F.struct("url")).alias("u"))
    body = each.select("site", "at", F.concat(F.when(F.col("at") > 1, ",").otherwise(""), F.expr("substring(u, 8, length(u) - 8)")).alias("line"))
    heads = urls.select(F.col(site).alias("site")).distinct()
    lines = heads.select("site", F.lit(0).cast("long").alias("at"), F.lit('{"urls":[').alias("line")).union(body).union(heads.select("site", F.lit(2**62).cast("long").alias("at"), F.lit("]}").alias("line")))
    return write_documents(lines.join(_named(heads), "site").select("doc", "at", "line"), path, "urls.json")
