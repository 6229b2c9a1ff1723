"""File sources and sinks. Readers give every file's rows with an explicit schema, so nothing is inferred at scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill import schemas as S

RUN_NAME = r"output_(\d{4}-\d{2}-\d{2}_\d{6})\.json$"


def read_url_lists(spark: SparkSession, path: str) -> DataFrame:
    """``{"urls": [...]}`` documents to ``(file, pos, url)``; blank entries are dropped."""
    docs = spark.read.schema(S.URL_LIST).option("multiLine", True).json(path)
    rows = docs.select(F.col("_metadata.file_path").alias("file"), F.posexplode("urls").alias("pos", "url"))
    return rows.withColumn("url", F.trim("url")).filter("url <> ''")


def write_url_list(urls: DataFrame, path: str, group: str, order: str) -> None:
    """One ``{"urls": [...]}`` line per group, in order; a group is one site's list."""
    listed = urls.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "url"))).alias("u"))
    listed.select(group, F.transform("u", lambda x: x["url"]).alias("urls")).write.partitionBy(group).mode("overwrite").json(path)


def read_run_outputs(spark: SparkSession, path: str, latest: bool = False) -> DataFrame:
    """Run documents to one row per item with the run's name and site; ``latest`` keeps each site's last run by name."""
    runs = spark.read.schema(S.RUN_OUTPUT).option("multiLine", True).json(path).select(F.regexp_extract("_metadata.file_name", RUN_NAME, 1).alias("run"), "*")
    if latest:
        last = runs.groupBy("site.url").agg(F.max("run").alias("run"))
        runs = runs.join(last.withColumnRenamed("url", "_url"), (F.col("site.url") == F.col("_url")) & (runs["run"] == last["run"]), "left_semi")
    return runs.select("run", F.col("site.url").alias("site_url"), "metadata", F.inline("products"))


def count_items(spark: SparkSession, path: str) -> DataFrame:
    """Items per run document; a document without the key counts none."""
    runs = spark.read.schema(S.RUN_OUTPUT).option("multiLine", True).json(path)
    return runs.select(F.col("_metadata.file_name").alias("file"), F.greatest(F.size("products"), F.lit(0)).cast("long").alias("items"))


def write_run(records: DataFrame, path: str, run: str) -> None:
    """A run's records as a partition of their own."""
    records.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def runs_since(names: DataFrame, started_at: Column, slack_seconds: int = 120) -> DataFrame:
    """``names`` (file): runs not older than the job's start; names without a time are kept."""
    at = F.try_to_timestamp(F.regexp_extract("file", RUN_NAME, 1), F.lit("yyyy-MM-dd_HHmmss"))
    return names.withColumn("at", at).filter(F.col("at").isNull() | (F.col("at") >= started_at - F.expr(f"INTERVAL {slack_seconds} SECONDS")))


def parse_pasted_urls(pasted: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Pasted JSON arrays: ``(accepted, rejected)``; rows that are no array of http URLs are rejected whole."""
    urls = F.filter(F.transform(F.from_json(column, "array<string>"), lambda u: F.trim(u)), lambda u: u != "")
    parsed = pasted.withColumn("urls", urls)
    good = F.coalesce(F.forall("urls", lambda u: u.rlike("^https?://[^/]+")), F.lit(False))
    return parsed.filter(good), parsed.filter(~good).drop("urls")


def parse_artifact(raw: Column) -> Column:
    """JSON as VARIANT; stray backslashes are doubled where the text doesn't parse as it is; null if it never does."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_replace(raw, r'\\(?!["\\/bfnrtu])', r"\\\\")))


def embedded_json(raw: Column) -> Column:
    """The JSON under a ``### Result`` heading, also where it is text in quotes, else the first object that the text holds.

    An object is tried at every opening brace in turn, with strings and escapes as JSON has them, so that braces in prose and in
    strings do no harm.
    """

    @F.pandas_udf("string")
    def first_object(texts):
        import json

        decoder = json.JSONDecoder()

        def found(text):
            at = text.find("{") if text else -1
            while at >= 0:
                try:
                    return text[at : decoder.raw_decode(text, at)[1]]
                except (ValueError, RecursionError):
                    at = text.find("{", at + 1)
            return None

        return texts.map(found)

    headed = F.regexp_extract(raw, r"(?s)###\s*Result\s*\n(?:```(?:json)?\s*\n)?(.*?)(?:\n```|\n###|\z)", 1)
    whole = F.try_parse_json(F.regexp_replace(headed, r"^\s+|\s+$", ""))
    quoted = F.try_parse_json(F.when(F.schema_of_variant(whole) == "STRING", F.try_variant_get(whole, "$", "string")))
    plain = F.when(F.schema_of_variant(whole) != "STRING", whole)
    return F.coalesce(quoted, plain, F.try_parse_json(first_object(raw)))


def search_text(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Lines of text files that match, with file, line number and the first 200 characters."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    return files.filter(F.col("text").rlike(pattern)).select("file", (F.col("at") + 1).alias("line"), F.substring("text", 1, 200).alias("excerpt"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names and sizes, newest names first; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("length").alias("bytes"), "modificationTime").orderBy(F.desc("file"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A relational table, read in ranges of a numeric column by as many connections as parts."""
    bounds = {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load()


def fold_api_pages(pages: DataFrame, site: str, page_no: str, items: str, key: str, page_size: int) -> DataFrame:
    """Stored answers of a paged API: items up to the first short page, each key once, in order."""
    from quarrymill.operators.links import first_of_each

    short = pages.filter(F.size(items) < page_size).groupBy(site).agg(F.min(page_no).alias("_last"))
    kept = pages.join(short, site, "left").filter(F.col("_last").isNull() | (F.col(page_no) <= F.col("_last")))
    each = kept.select(site, page_no, F.posexplode(items).alias("pos", "item")).withColumn(key, F.col(f"item.{key}"))
    return first_of_each(each, [site], key, [page_no, "pos"])
