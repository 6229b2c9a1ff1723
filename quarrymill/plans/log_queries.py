"""Queries over session logs; ``conversations`` stand for logs (conversation = job, turn = order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.operators import history as O

from .catalog import query, table


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations")
def log_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sequence(logs(spark, sf_dir), "conv_id", ["turn"]).select("conv_id", "turn", "seq")


@query("SELECT conv_id, seq, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations) WHERE seq > 1 AND seq <= 4")
def log_page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.log_page(O.sequence(logs(spark, sf_dir), "conv_id", ["turn"]), 1, 3).select("conv_id", "seq", "role")


_AGENT = "CASE turn % 3 WHEN 0 THEN 'site-analyzer' WHEN 1 THEN 'code-writer' ELSE '' END"


@query(f"""
SELECT conv_id, agent, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS tool_calls, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS said,
  CASE agent WHEN 'site-analyzer' THEN 0 WHEN 'code-writer' THEN 5 ELSE 999 END::BIGINT AS rank FROM (SELECT *, CASE WHEN {_AGENT} = '' THEN 'system' ELSE {_AGENT} END AS agent FROM conversations) GROUP BY conv_id, agent
""")
def agent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agent's messages in order, with its place in the pipeline."""
    own = logs(spark, sf_dir).withColumn("agent", F.coalesce(F.nullif(F.expr(_AGENT), F.lit("")), F.lit("system")))
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.col("text").alias("t")))))
    per = own.groupBy("conv_id", "agent").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("tool_calls"), said.alias("said"))
    rank = F.when(F.col("agent") == "site-analyzer", 0).when(F.col("agent") == "code-writer", 5).otherwise(999).cast("long")
    return per.select("conv_id", "agent", "messages", "tool_calls", F.array_join(F.transform("said", lambda s: s["t"]), "|").alias("said"), rank.alias("rank"))


@query("SELECT DISTINCT conv_id, role FROM conversations")
def agents_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("conv_id", "role").distinct()


@query("""
WITH m AS (SELECT *, sum(CASE WHEN role = 'system' THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id) AS sys, sum(CASE WHEN role = 'system' THEN 0 ELSE length(text) END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
SELECT conv_id, turn FROM m WHERE role = 'system' OR used <= 1500 - sys
""")
def log_suffix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.suffix_in_budget(logs(spark, sf_dir), "conv_id", "turn", "role", "text", 1500).select("conv_id", "turn")


@query("""
WITH m AS (SELECT *, 1000 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM conversations)
SELECT conv_id, turn, CASE WHEN length(text) <= left_ THEN text ELSE substr(text, 1, left_::BIGINT) || chr(10) || '[...truncated]' END AS text FROM m WHERE length(text) <= left_ OR left_ > 100
""")
def log_prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.prefix_in_budget(logs(spark, sf_dir), "conv_id", "turn", "text", 1000).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, substr(text, 1, 300) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE trim(text) <> '') WHERE rn <= 5")
def log_last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = logs(spark, sf_dir).filter(F.trim("text") != "")
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return said.withColumn("rn", rn).filter("rn <= 5").select("conv_id", "turn", F.substring("text", 1, 300).alias("excerpt"))


@query("SELECT role, count(*) AS messages, sum(length(text))::BIGINT AS chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def log_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).groupBy("role").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.count_distinct("conv_id").alias("conversations"))
