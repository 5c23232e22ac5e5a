"""Views of the driver's tables in the shape of sessions, run cases, tool calls and messages, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> F.Column:
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def named(prefix: str, column: str, n: int) -> F.Column:
    return F.concat(F.lit(prefix), (F.col(column) % n).cast("string"))


def sess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user and day."""
    of = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    out = days.agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_event_at"),
        F.count("*").alias("n_events"),
        of("click", "view").alias("tool_calls"),
        of("error").alias("tool_errors"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("cost"),
        F.count_if((F.col("event_type") == "signup")).alias("signups"),
    )
    return out.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("day").cast("string")).alias("session_id"),
        "*",
        millis("started_at").alias("at_ms"),
        millis("last_event_at").alias("until"),
        named("m", "user_id", 5).alias("model"),
        named("p", "user_id", 11).alias("project"),
        named("s", "user_id", 3).alias("source"),
    )


SESS = """SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, user_id, CAST(ts AS DATE) AS day, min(ts) AS started_at, max(ts) AS last_event_at,
 count(*) AS n_events, count(*) FILTER (event_type IN ('click', 'view')) AS tool_calls, count(*) FILTER (event_type = 'error') AS tool_errors,
 coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS cost, count(*) FILTER (event_type = 'signup') AS signups, epoch_us(min(ts)) // 1000 AS at_ms, epoch_us(max(ts)) // 1000 AS until,
 'm' || CAST(user_id % 5 AS VARCHAR) AS model, 'p' || CAST(user_id % 11 AS VARCHAR) AS project, 's' || CAST(user_id % 3 AS VARCHAR) AS source FROM events GROUP BY user_id, CAST(ts AS DATE)"""


def run_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples of evaluation cases."""
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("run_id"),
        (F.col("o_orderkey") % 25).alias("case_id"),
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", "passed").when(F.col("o_orderstatus") == "F", "failed").otherwise("error").alias("status"),
        F.col("o_orderpriority").alias("difficulty"),
        F.col("o_totalprice").alias("cost"),
        named("h", "o_custkey", 7).alias("harness"),
    )
    return o.withColumn("sample", F.row_number().over(Window.partitionBy("run_id", "case_id").orderBy("o_orderkey")) - 1)


RUN_CASE = """SELECT o_custkey % 40 AS run_id, o_orderkey % 25 AS case_id, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'passed' WHEN 'F' THEN 'failed' ELSE 'error' END AS status,
 o_orderpriority AS difficulty, o_totalprice AS cost, 'h' || CAST(o_custkey % 7 AS VARCHAR) AS harness, row_number() OVER (PARTITION BY o_custkey % 40, o_orderkey % 25 ORDER BY o_orderkey) - 1 AS sample FROM orders"""
