"""Queries on event logs, telemetry of cases, and tables written for people."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators import evaluation
from quarry.plans.catalogue import NOW_MS
from quarry.plans.registry import query
from quarry.plans.views import RUN_CASE, millis, run_case, table
from quarry.sources import sinks
from quarry.sources.shared import application_dir
from quarry.streaming import events, watch

_LOG = """SELECT event_id AS id, CAST(user_id AS VARCHAR) AS run_id, CASE WHEN event_type = 'purchase' THEN 'run_finished' ELSE event_type END AS type, epoch_us(ts) // 1000 AS at_ms, CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE props END AS payload FROM events"""


def _rounded(c):
    """Off the halves, which the two engines round differently."""
    return F.round(F.col(c) + 1e-7, 2)


def log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("run_id"), F.when(F.col("event_type") == "purchase", "run_finished").otherwise(F.col("event_type")).alias("type"), millis("ts").alias("at_ms"), F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props")).alias("payload"))


@query(f"WITH l AS ({_LOG}) SELECT id, payload <> '{{broken' AS readable FROM l")
def poison_payloads(spark, sf):
    return events.parsed(log(spark, sf)).select("id", F.col("data").isNotNull().alias("readable"))


@query(f"WITH l AS ({_LOG}), e AS (SELECT run_id, min(id) AS last_ FROM l WHERE type = 'run_finished' GROUP BY run_id) SELECT id, l.run_id, type FROM l LEFT JOIN e USING (run_id) WHERE last_ IS NULL OR id <= last_")
def events_until_end(spark, sf):
    return events.until_end(log(spark, sf)).select("id", "run_id", "type")


@query(f"WITH l AS ({_LOG}) SELECT id, run_id FROM l WHERE id > 300 ORDER BY id LIMIT 200")
def next_events(spark, sf):
    return events.page(log(spark, sf), 300).select("id", "run_id")


@query(f"""WITH l AS ({_LOG}), r AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 'running' ELSE 'done' END AS status, {NOW_MS} - (c_custkey % 30) * 60000 AS started_ms FROM customer), m AS (SELECT run_id, max(at_ms) AS last_ms FROM l GROUP BY run_id)
SELECT r.run_id, CASE WHEN status = 'running' AND {NOW_MS} - coalesce(last_ms, started_ms) > 600000 THEN 'aborted' ELSE status END AS status FROM r LEFT JOIN m ON CAST(r.run_id AS VARCHAR) = m.run_id""")
def silent_runs(spark, sf):
    k = F.col("c_custkey")
    runs = table(spark, sf, "customer").select(k.cast("string").alias("run_id"), F.when(k % 2 == 0, "running").otherwise("done").alias("status"), (F.lit(NOW_MS) - (k % 30) * 60_000).alias("started_ms"))
    return events.silent(runs, log(spark, sf), NOW_MS).select(F.col("run_id").cast("long").alias("run_id"), "status")


@query("SELECT o_orderkey AS case_id, o_custkey AS run_id, CASE WHEN o_custkey % 3 = 0 AND o_orderstatus = 'P' THEN 'error' WHEN o_orderstatus = 'O' THEN 'passed' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'open' END AS status FROM orders")
def closed_cases(spark, sf):
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "passed").when(F.col("o_orderstatus") == "F", "failed").otherwise("open").alias("status"))
    runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 3 == 0, "aborted").otherwise("done").alias("status"))
    return events.close_cases(cases, runs).select("case_id", "run_id", "status")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_rows(spark, sf):
    return sinks.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


_GAP = 86_400_000


@query(f"""WITH e AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts) // 1000 AS ms, event_id, event_type = 'signup' AS fin FROM events),
n AS (SELECT *, lead(ms) OVER (PARTITION BY run_id ORDER BY ms, event_id) AS after_ms, (SELECT max(ms) FROM e) AS top, bool_or(fin) OVER (PARTITION BY run_id ORDER BY ms, event_id) AS ended FROM e),
g AS (SELECT run_id, min(ms) AS last_ms FROM n WHERE NOT ended AND coalesce(after_ms, top) - ms > {_GAP} GROUP BY run_id)
SELECT run_id, 'run_aborted' AS type, last_ms + {_GAP} AS at_ms FROM g""")
def aborts_of_silent_runs(spark, sf):
    """The log as a stream of files: a run that is silent for a day gets its abort, once."""
    log = table(spark, sf, "events")
    rows = log.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.when(F.col("event_type") == "signup", "run_finished").otherwise(F.col("event_type")).alias("type"), millis("ts").alias("at_ms"), F.lit("{}").alias("payload"))
    path = f"{application_dir(spark)}/log-{uuid.uuid4().hex}"
    # the files that are there come as one batch, whatever the order in which they were written
    rows.write.json(f"{path}/log")
    watch.run(events.read_stream(spark, f"{path}/log", 1_000_000), f"{path}/aborts", f"{path}/offsets", _GAP)
    return spark.read.schema(watch.ABORTS).parquet(f"{path}/aborts")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_brand END AS p_brand FROM part UNION ALL SELECT -1, 'new'")
def upserted_rows(spark, sf):
    old = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand")
    new = old.where("p_partkey % 4 = 0").select("p_partkey").union(spark.range(1).select(F.lit(-1).cast("long"))).withColumn("p_brand", F.lit("new"))
    return sinks.upserted(old, new, ["p_partkey"])


@query(f"""WITH c AS ({RUN_CASE}), t AS (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'passed') AS ok, sum(cost) AS cost FROM c GROUP BY run_id),
l AS (SELECT run_id, 0 AS part, NULL AS case_id, NULL AS sample, '# Run ' || CAST(run_id AS VARCHAR) AS line FROM t UNION ALL SELECT run_id, 1, NULL, NULL, '| case | sample | status | cost |' || chr(10) || '| --- | --- | --- | --- |' FROM t
 UNION ALL SELECT run_id, 2, case_id, sample, '| ' || CAST(case_id AS VARCHAR) || ' | ' || CAST(sample AS VARCHAR) || ' | ' || status || ' | ' || printf('%.2f', cost) || ' |' FROM c UNION ALL SELECT run_id, 3, NULL, NULL, 'Passed ' || CAST(ok AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) FROM t)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY part, case_id, sample) - 1 AS place, line FROM l""")
def run_report(spark, sf):
    # the total's cost is a sum whose last digit depends on the order of adding, so it is left out here
    r = sinks.report_rows(run_case(spark, sf))
    return r.select("run_id", F.col("place").cast("long").alias("place"), F.when(F.col("line").startswith("Passed "), F.regexp_replace("line", ", [^,]*$", "")).otherwise(F.col("line")).alias("line"))


_TEL = """t AS (SELECT l_orderkey AS run_id, l_linenumber AS case_id, l_quantity AS duration, l_extendedprice AS tokens, l_tax AS cached, l_discount AS fresh, l_returnflag AS flag FROM lineitem)"""


@query(f"""WITH {_TEL} SELECT run_id, quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.95) AS p95, round(sum(tokens) / sum(duration) + 1e-7, 2) AS tokens_per_s, round(max(tokens / duration) + 1e-7, 2) AS fastest, round(CASE WHEN sum(cached) + sum(fresh) > 0 THEN sum(cached) / (sum(cached) + sum(fresh)) ELSE 0.0 END, 6) AS cache_hit,
 round(avg(CAST(flag = 'R' AS INT)), 6) AS error_rate, round(avg(CAST(flag = 'A' AS INT)), 6) AS fail_rate, min(duration) FILTER (flag = 'N') AS cheapest_pass FROM t GROUP BY run_id""")
def run_telemetry(spark, sf):
    line = table(spark, sf, "lineitem")
    t = line.select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("duration"), F.col("l_extendedprice").alias("tokens"), F.col("l_tax").alias("cached"), F.col("l_discount").alias("fresh"), F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "failed").otherwise("passed").alias("status"))
    out = evaluation.run_telemetry(t.withColumn("cost", F.col("duration")))
    return out.withColumns({c: _rounded(c) for c in ("tokens_per_s", "fastest")})


@query("""SELECT o_orderkey AS case_id, round(CASE WHEN o_custkey % 5 > 0 THEN o_totalprice / (o_custkey % 5) ELSE 0.0 END + 1e-7, 2) AS rate, concat_ws('; ', CASE WHEN o_custkey % 5 = 0 THEN 'no duration' END, CASE WHEN o_orderkey % 3 = 0 THEN 'cost missing' END, CASE WHEN o_orderkey % 4 = 0 THEN 'no tool calls' END) AS warnings FROM orders""")
def case_telemetry(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("tokens"), (F.col("o_custkey") % 5).alias("duration"), F.when(F.col("o_orderkey") % 3 != 0, F.lit(1.0)).alias("cost"), (F.col("o_orderkey") % 4).alias("tool_calls"))
    return evaluation.case_telemetry(o).withColumn("rate", _rounded("rate"))
