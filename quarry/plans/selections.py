"""Queries on the selections and orders of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import messages
from quarry.operators import insights, selection
from quarry.plans.registry import query
from quarry.plans.views import SESS, millis, sess, table
from quarry.sources import fold
from quarry.streaming import events

#: How names are ordered, for the other engine: letters, then accents, then small letters first.
_PEOPLE = "lower(strip_accents({0})), lower({0}), {0} DESC"


@query(f"SELECT session_id FROM (SELECT *, CASE WHEN model <> 'm2' THEN model END AS named FROM ({SESS})) WHERE source = 's1' AND coalesce(named, 'unknown') = 'unknown'")
def sessions_of_no_model(spark, sf):
    s = sess(spark, sf).withColumn("model", F.when(F.col("model") != "m2", F.col("model")))
    return selection.of_source_and_model(s, "s1", "unknown").select("session_id")


@query("SELECT event_id FROM events WHERE event_id % 4 IN (0, 3) AND value > 0")
def valid_event_values(spark, sf):
    i = F.col("event_id") % 4
    e = table(spark, sf, "events").withColumn("at", F.when(i == 1, float("nan")).when(i == 2, float("inf")).otherwise(F.col("value")))
    return selection.valid_points(e, "at").select("event_id")


@query(f"SELECT 'model' AS kind, model AS name, min(at_ms) AS first_seen_at, count(DISTINCT session_id) AS sessions FROM ({SESS}) GROUP BY model")
def markers_of_one_kind(spark, sf):
    s = sess(spark, sf)
    return selection.of_kind(insights.markers(s, {"model": F.col("model"), "project": F.col("project")}), "model")


_AUDIT = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Ä' WHEN 1 THEN 'a' WHEN 2 THEN 'A' ELSE 'ä' END || CAST(p_size AS VARCHAR) AS name, p_brand AS category, p_partkey % 3 AS weak FROM part"


def _audit(spark, sf):
    k = F.col("p_partkey")
    first = F.when(k % 4 == 0, "Ä").when(k % 4 == 1, "a").when(k % 4 == 2, "A").otherwise("ä")
    return table(spark, sf, "part").select(k.cast("string").alias("id"), F.concat(first, F.col("p_size").cast("string")).alias("name"), F.col("p_brand").alias("category"), (k % 2 == 0).alias("has_oracle"), (k % 5 == 0).alias("has_known_bad"),
                                           (k % 7).alias("deterministic"), F.lit(0).alias("trace"), F.array_repeat(F.lit("w"), (k % 3).cast("int")).alias("weaknesses"))


@query(f"""WITH a AS ({_AUDIT}), x AS (SELECT 'weak' AS chip, id FROM a WHERE weak > 0 UNION ALL SELECT 'oracle', id FROM a WHERE id % 2 = 0 UNION ALL SELECT 'deterministic', id FROM a WHERE id % 7 > 0
 UNION ALL SELECT 'said', id FROM a WHERE CAST(id AS VARCHAR) LIKE '%1%' OR lower(name) LIKE '%1%' OR lower(category) LIKE '%1%') SELECT chip, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM x GROUP BY chip""")
def audit_chips(spark, sf):
    a = _audit(spark, sf)
    parts = [selection.audited(a, stat=c).withColumn("chip", F.lit(c)) for c in ("weak", "oracle", "deterministic")] + [selection.audited(a, said="1").withColumn("chip", F.lit("said"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("chip").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


@query(f"WITH a AS ({_AUDIT}) SELECT CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY weak DESC, {_PEOPLE.format('name')}, CAST(id AS VARCHAR)) AS rank FROM a QUALIFY rank <= 50")
def weakest_audits(spark, sf):
    """Names with capitals and accents, ordered as people do."""
    return selection.audit_rank(_audit(spark, sf), "weak", 50).select("id", F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT o_custkey % 300 AS run_id, max(o_orderdate) AS created_at, CASE WHEN o_custkey % 300 % 4 <> 0 THEN avg(CAST(o_orderstatus = 'O' AS INT)) END AS pass_rate FROM orders GROUP BY 1)
SELECT run_id, row_number() OVER (ORDER BY round(coalesce(pass_rate, 0.0), 9) DESC, created_at DESC, run_id) AS rank FROM r QUALIFY rank <= 40""")
def runs_by_pass_rate(spark, sf):
    k = F.col("o_custkey") % 300
    r = table(spark, sf, "orders").groupBy(k.alias("run_id")).agg(F.max("o_orderdate").alias("created_at"), F.round(F.avg((F.col("o_orderstatus") == "O").cast("int")), 9).alias("rate"))
    return selection.run_rank(r.withColumn("pass_rate", F.when(F.col("run_id") % 4 != 0, F.col("rate"))), "pass-desc", 40).select("run_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH m AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'beta' WHEN 1 THEN 'alpha' WHEN 2 THEN 'new' ELSE 'other' END AS family, p_partkey % 5 = 0 AS is_alias, CASE p_partkey % 2 WHEN 0 THEN 'é' ELSE 'E' END || p_brand AS label FROM part)
SELECT id, row_number() OVER (ORDER BY CASE family WHEN 'alpha' THEN 1 WHEN 'beta' THEN 2 WHEN 'other' THEN 3 ELSE 4 END, is_alias DESC, {_PEOPLE.format('label')}, id) AS rank FROM m""")
def model_catalogue_order(spark, sf):
    k = F.col("p_partkey")
    m = table(spark, sf, "part").select(k.alias("id"), F.when(k % 4 == 0, "beta").when(k % 4 == 1, "alpha").when(k % 4 == 2, "new").otherwise("other").alias("family"), (k % 5 == 0).alias("is_alias"), F.concat(F.when(k % 2 == 0, "é").otherwise("E"), "p_brand").alias("label"))
    return selection.catalogue_rank(m, ["alpha", "beta", "other"]).select("id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH s AS ({SESS}) SELECT source, session_id, row_number() OVER (PARTITION BY source ORDER BY last_event_at DESC, session_id) AS rank, count(*) OVER (PARTITION BY source) AS all_sessions FROM s QUALIFY rank <= 100""")
def retained_sessions(spark, sf):
    return selection.retained(sess(spark, sf)).select("source", "session_id", F.col("rank").cast("long").alias("rank"), "all_sessions")


@query("""SELECT o_custkey % 40 AS run_id, o_orderkey AS seq, o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS cost, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 2 END AS duration_ms FROM orders WHERE o_custkey % 40 % 3 = 0""")
def summaries_of_many_runs(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    result = F.to_json(F.struct(F.struct(F.col("o_totalprice").alias("costUsd"), F.col("o_custkey").alias("inputTokens")).alias("usage"), (k * 2).alias("durationMs")))
    cases = o.select((F.col("o_custkey") % 40).alias("run_id"), k.alias("seq"), F.col("o_orderstatus").alias("status"), F.when(k % 5 == 0, "{broken").otherwise(result).alias("result"))
    return selection.case_summaries(cases, cases.select("run_id").where("run_id % 3 = 0"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'other' WHEN o_custkey % 3 = 1 THEN 'm' END AS model, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 2 = 0 THEN 2.5 ELSE 0.0 END, 2) AS cost,
 CASE WHEN o_orderkey % 3 = 0 THEN 'measured' WHEN o_orderkey % 2 = 0 THEN 'inferred' ELSE 'missing' END AS source FROM orders""")
def costs_after_runs(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 3
    model, cost, source = selection.cost_after_run(F.when(c == 1, " m ").otherwise("<synthetic>"), F.when(c == 0, "other"), F.col("o_totalprice"), F.when(k % 3 == 0, "measured"), F.when(k % 2 == 0, 2.5))
    return table(spark, sf, "orders").select("o_orderkey", model.alias("model"), F.round(cost, 2).alias("cost"), source.alias("source"))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'ASSISTANT: ' || text WHEN role = 'assistant' THEN 'TOOL_USE(t' || CAST(turn AS VARCHAR) || '): ' || substr(text, 1, 1000) WHEN role = 'user' THEN 'TOOL_RESULT(c' || CAST(turn AS VARCHAR) || '): ' || substr(text || text || text, 1, 2000) END AS line FROM conversations)
SELECT conv_id AS run_id, md5(string_agg(line, chr(10) ORDER BY turn)) AS digest FROM l WHERE line IS NOT NULL GROUP BY conv_id""")
def transcripts_as_text(spark, sf):
    c = table(spark, sf, "conversations")
    turn = F.col("turn")
    kind = F.when(F.col("role") == "user", "tool_result").when(turn % 4 == 1, "text").otherwise("tool_use")
    b = c.select(F.col("conv_id").alias("run_id"), turn.alias("seq"), "role", kind.alias("type"), "text", F.concat(F.lit("t"), turn.cast("string")).alias("name"), F.col("text").alias("input"), F.concat(F.lit("c"), turn.cast("string")).alias("tool_use_id"), F.concat("text", "text", "text").alias("content"))
    return selection.transcript_text(b).select("run_id", F.md5("text").alias("digest"))


@query(f"""WITH s AS ({SESS}) SELECT source, count(*) AS sessions, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, max(last_event_at) AS last_event_at, least(count(*), 90) AS shown, count(*) > 90 AS truncated FROM s GROUP BY source""")
def scan_of_all_sources(spark, sf):
    return selection.scanned(sess(spark, sf), 90)


@query("""WITH r AS (SELECT o_custkey % 300 AS run_id, max(o_orderdate) AS created_at, CASE WHEN o_custkey % 300 % 3 = 0 THEN 'running' ELSE 'completed' END AS status FROM orders GROUP BY ALL)
SELECT run_id, row_number() OVER (ORDER BY created_at DESC, run_id) AS rank FROM r WHERE status = 'running' QUALIFY rank <= 20""")
def latest_running_runs(spark, sf):
    k = F.col("o_custkey") % 300
    r = table(spark, sf, "orders").groupBy(k.alias("run_id")).agg(F.max("o_orderdate").alias("created_at")).withColumn("status", F.when(F.col("run_id") % 3 == 0, "running").otherwise("completed"))
    return selection.runs_of_status(r, "running", 20).select("run_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT user_id, epoch_us(min(ts)) // 1000 AS a, CASE WHEN user_id % 3 <> 0 THEN epoch_us(max(ts)) // 1000 END AS z FROM events GROUP BY user_id), n AS (SELECT (SELECT epoch_us(max(ts)) // 1000 FROM events) AS now)
SELECT user_id AS run_id, (least(coalesce(z, now), now) - a) // 3600000 AS beats, a + (least(coalesce(z, now), now) - a) // 3600000 * 3600000 AS last_ms FROM r, n WHERE least(coalesce(z, now), now) - a >= 3600000""")
def heartbeats_of_runs(spark, sf):
    e = table(spark, sf, "events")
    now = e.select(F.max(millis("ts"))).first()[0]
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min(millis("ts")).alias("started_ms"), F.max(millis("ts")).alias("last")).withColumn("ended_ms", F.when(F.col("run_id") % 3 != 0, F.col("last")))
    return events.heartbeats(runs, now, 3_600_000).groupBy("run_id").agg(F.count("*").alias("beats"), F.max("at_ms").alias("last_ms"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY conv_id)
SELECT conv_id, n AS lines, CASE WHEN conv_id % 5 = 1 THEN n ELSE 0 END AS malformed, CASE WHEN conv_id % 5 = 1 THEN 'malformed' WHEN users > 0 THEN 'inferred' ELSE 'missing' END AS turns_source, CASE WHEN conv_id % 5 = 1 THEN 'malformed' ELSE 'missing' END AS cost_source FROM c WHERE conv_id % 5 <> 0 OR users = 0""")
def odd_session_files(spark, sf):
    """Files of a judge's own sessions are no sessions; where all lines are broken every source says so."""
    c = table(spark, sf, "conversations")
    k = F.col("conv_id")
    said = F.when((k % 5 == 0) & (F.col("role") == "user"), F.concat(F.lit(messages.JUDGE_STUB), "text")).otherwise(F.col("text"))
    raw = F.to_json(F.struct(F.when(F.col("role") == "user", "user").otherwise("system").alias("type"), F.struct(said.alias("content")).alias("message")))
    s = fold.fold(c.select(k.cast("string").alias("file"), F.col("turn").alias("line_no"), F.when(k % 5 == 1, F.concat(F.lit("{"), raw)).otherwise(raw).alias("raw")))
    return s.select(F.col("file").cast("long").alias("conv_id"), "lines", "malformed", "turns_source", "cost_source")
