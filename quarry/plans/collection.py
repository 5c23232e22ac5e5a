"""Queries on the whole collection, markers' figures, and transcripts of the second format."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import collection
from quarry.plans.catalogue import NOW_MS
from quarry.plans.registry import query
from quarry.plans.transcripts import lines
from quarry.plans.views import SESS, sess, table
from quarry.sources import fold, rollouts, transcripts


@query("SELECT s_suppkey AS source, CASE WHEN s_suppkey % 4 = 0 THEN 'absent' WHEN s_suppkey % 4 = 1 THEN 'empty' ELSE 'present' END AS status, CASE WHEN s_suppkey % 4 > 1 THEN n ELSE 0 END AS files, CASE WHEN s_suppkey % 4 > 1 THEN m END AS last_at FROM supplier JOIN (SELECT l_suppkey, count(*) AS n, max(l_orderkey) AS m FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey")
def discovered_sources(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("mtime"), "l_linenumber")
    files = line.where("source % 4 > 0").withColumn("file", F.when(F.col("source") % 4 > 1, F.col("l_linenumber").cast("string")))
    sources = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source")).join(line.select("source").distinct(), "source")
    return collection.discover(sources, files)


@query("SELECT 'a' || CAST(n_nationkey AS VARCHAR) AS source, '/r' || CAST(n_nationkey AS VARCHAR) AS root FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'b' || CAST(n_nationkey AS VARCHAR), '/r' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 2 <> 0 AND n_nationkey % 3 = 0")
def source_catalogue(spark, sf):
    key = F.col("n_nationkey").cast("string")
    n = table(spark, sf, "nation")
    a = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("a"), key).alias("source"), F.concat(F.lit("/r"), key, F.lit("/")).alias("root"))
    b = n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("b"), key).alias("source"), F.concat(F.lit("/r"), key).alias("root"))
    return collection.catalogue(a, b)


@query(f"WITH s AS ({SESS}) SELECT session_id, source AS source_id, 'Source ' || source AS source_label FROM s WHERE model <> 'm3'")
def sessions_of_all_sources(spark, sf):
    s = sess(spark, sf)
    parts = [(x, f"Source {x}", s.where(F.col("source") == x)) for x in ("s0", "s1", "s2")]
    return collection.all_sessions(parts).where("model <> 'm3'").select("session_id", "source_id", "source_label")


@query("SELECT l_returnflag || l_linestatus AS tool, count(*) AS calls, count(*) FILTER (l_discount > 0.08) AS errors FROM lineitem GROUP BY ALL ORDER BY calls DESC, tool LIMIT 3")
def merged_tool_rollups(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("tool", F.concat("l_returnflag", "l_linestatus"))
    per = [line.where(F.col("l_linenumber") % 3 == i).groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(F.col("l_discount") > 0.08).alias("errors")) for i in range(3)]
    return collection.merge_tools(per, 3)


@query("""WITH c AS (SELECT conv_id, turn, role, text, conv_id % 13 = 0 AS side, role = 'assistant' AND (conv_id + turn) % 3 <> 0 AS called FROM conversations), f AS (SELECT conv_id, count(DISTINCT CASE WHEN turn <> 1 OR conv_id % 5 <> 0 THEN turn % 3 END) FILTER (role = 'assistant') AS models FROM c GROUP BY conv_id)
SELECT (SELECT count(*) FROM f) AS sessions, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN turn * 10 ELSE 0 END) AS BIGINT) AS output_tokens, count(*) FILTER (called) AS tool_calls, count(*) FILTER (called AND (conv_id + turn) % 5 = 0) AS tool_errors,
 count(*) FILTER (role = 'assistant') AS text_blocks, count(*) FILTER (role = 'system') AS hook_errors, count(*) FILTER (turn = 1 AND conv_id % 9 = 0) AS malformed, count(DISTINCT conv_id) FILTER (side) AS subagent_sessions, count(*) FILTER (called AND conv_id % 5 = 3) AS subagents, count(*) FILTER (called AND conv_id % 5 = 0) AS reads, count(*) FILTER (called AND conv_id % 5 = 1) AS writes FROM c""")
def collection_totals(spark, sf):
    s = fold.fold(lines(spark, sf)).withColumn("project", F.lit("p"))
    return collection.totals(s).select("sessions", "input_tokens", "output_tokens", "tool_calls", "tool_errors", "text_blocks", "hook_errors", "malformed", "subagent_sessions", "subagents", "reads", "writes")


@query(f"""WITH s AS ({SESS}) SELECT CASE WHEN user_id % 5 = 4 THEN 'unknown' ELSE model END AS model, count(DISTINCT session_id) AS sessions, CAST(sum(tool_calls) AS BIGINT) AS input, CAST(sum(n_events) AS BIGINT) AS output, CAST(sum(tool_calls) AS BIGINT) AS calls, CAST(sum(tool_errors) AS BIGINT) AS errors, round(avg(100 - user_id % 50), 6) AS mean_quality FROM s GROUP BY 1""")
def attributed_models(spark, sf):
    s = sess(spark, sf)
    usage = s.select(F.col("session_id").alias("session"), F.when(F.col("user_id") % 5 != 4, F.col("model")).alias("model"), F.col("tool_calls").alias("input"), F.col("n_events").alias("output"), F.col("tool_calls").alias("calls"), F.col("tool_errors").alias("errors"))
    return collection.by_model(usage, s.select(F.col("session_id").alias("session"), (100 - F.col("user_id") % 50).alias("quality")))


@query("SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0")
def page_append(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("/p/"), F.col("o_orderkey").cast("string"))).alias("path"), F.col("o_orderkey").cast("string").alias("session_id"))
    return collection.page_append(o.where("session_id % 3 = 0"), o.where("session_id % 2 = 0")).select(F.col("session_id").cast("long").alias("session_id"))


@query("WITH b AS (SELECT 'h' || CAST(o_custkey % 7 AS VARCHAR) AS harness, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 1) AS pass_rate FROM orders GROUP BY 1) SELECT harness, pass_rate FROM b ORDER BY pass_rate DESC, harness LIMIT 1")
def board_leader(spark, sf):
    b = table(spark, sf, "orders").groupBy(F.concat(F.lit("h"), (F.col("o_custkey") % 7).cast("string")).alias("harness")).agg(F.round(F.avg((F.col("o_orderstatus") == "O").cast("double")), 1).alias("pass_rate"))
    return collection.leader(b.withColumn("place", F.col("harness"))).select("harness", "pass_rate")


@query("SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def table_rows(spark, sf):
    return collection.row_counts({n: table(spark, sf, n) for n in ("nation", "orders", "part")})


_POINT = f"SELECT session_id, at_ms, model, ['sk' || CAST(user_id % 4 AS VARCHAR)] AS skills, CASE WHEN user_id % 3 = 0 THEN ['srv'] ELSE [] END AS mcp, user_id % 6 AS subagents FROM ({SESS})"


@query(f"""WITH p AS ({_POINT}), m AS (SELECT 'skill' AS kind, unnest(skills) AS name, at_ms FROM p UNION ALL SELECT 'mcp', unnest(mcp), at_ms FROM p UNION ALL SELECT 'model', model, at_ms FROM p UNION ALL SELECT 'subagent', 'subagent usage', at_ms FROM p WHERE subagents > 0)
SELECT kind, name, min(at_ms) AS first_seen_at, count(*) AS sessions FROM m GROUP BY kind, name""")
def all_markers(spark, sf):
    u = F.col("user_id")
    p = sess(spark, sf).select("at_ms", "model", F.array(F.concat(F.lit("sk"), (u % 4).cast("string"))).alias("skills"), F.when(u % 3 == 0, F.array(F.lit("srv"))).otherwise(F.array().cast("array<string>")).alias("mcp_servers"), (u % 6).alias("subagents"))
    return collection.markers(p)


_SIDES = f"""SELECT 'user' AS kind, 'u' || CAST(user_id % 20 AS VARCHAR) AS name, CASE WHEN day(day) <= 12 THEN 'before' ELSE 'after' END AS side, at_ms, CASE WHEN user_id % 7 <> 0 THEN model END AS model, user_id % 9 / 8.0 AS outcome, day(day) % 3 = 0 AND user_id % 2 = 0 AS judged, day(day) % 2 = 0 AS has_signal,
 CASE WHEN tool_calls > 0 THEN tool_errors / tool_calls ELSE 0.0 END AS error_rate, cost, tool_calls / 2.0 AS calls_per_turn, user_id % 3 AS subagents, n_events / 4.0 AS minutes FROM ({SESS}) WHERE user_id < 60 AND day(day) < 25"""


@query(f"""WITH s AS ({_SIDES}), n AS (SELECT kind, name, side, model, at_ms, row_number() OVER (PARTITION BY kind, name, side, model ORDER BY at_ms) AS nth FROM s WHERE model IS NOT NULL), m AS (SELECT kind, name, side, model FROM n QUALIFY row_number() OVER (PARTITION BY kind, name, side ORDER BY nth DESC, at_ms) = 1),
g AS (SELECT kind, name, side, count(*) AS n, CASE WHEN count(*) FILTER (judged) >= 5 THEN 'judged' ELSE 'heuristic' END AS pool, median(error_rate) AS e, median(cost) AS c, median(calls_per_turn) AS t, median(minutes) AS d, avg(CAST(subagents > 0 AS INT)) AS a,
 coalesce(CASE WHEN count(*) FILTER (judged) >= 5 THEN median(outcome) FILTER (judged) ELSE median(outcome) FILTER (has_signal) END, 0) AS o FROM s GROUP BY kind, name, side),
j AS (SELECT coalesce(x.kind, y.kind) AS kind, coalesce(x.name, y.name) AS name, coalesce(x.n, 0) AS n_before, coalesce(y.n, 0) AS n_after, coalesce(x.pool, 'heuristic') AS pb, coalesce(y.pool, 'heuristic') AS pa, x.e AS xe, y.e AS ye, x.c AS xc, y.c AS yc, x.t AS xt, y.t AS yt, x.d AS xd, y.d AS yd, x.a AS xa, y.a AS ya, x.o AS xo, y.o AS yo
 FROM (SELECT * FROM g WHERE side = 'before') x FULL JOIN (SELECT * FROM g WHERE side = 'after') y ON x.kind = y.kind AND x.name = y.name)
SELECT j.kind, j.name, n_before, n_after, round(coalesce(yo, 0) - coalesce(xo, 0), 6) AS outcome_delta, round(coalesce(ye, 0) - coalesce(xe, 0), 6) AS error_rate_delta, round(coalesce(yc, 0) - coalesce(xc, 0), 6) AS cost_delta, round(coalesce(yt, 0) - coalesce(xt, 0), 6) AS calls_per_turn_delta,
 round(coalesce(yd, 0) - coalesce(xd, 0), 6) AS minutes_delta, round(coalesce(ya, 0) - coalesce(xa, 0), 6) AS subagent_rate_delta, concat_ws('; ', CASE WHEN b.model <> a.model THEN 'dominant model changed ' || b.model || ' → ' || a.model || ' around this point' END,
 CASE WHEN pb <> pa THEN 'outcome medians mix ' || pa || ' (after) with ' || pb || ' (before) scores' END, CASE WHEN n_before < 5 OR n_after < 5 THEN 'thin sample (' || CAST(n_before AS VARCHAR) || ' before / ' || CAST(n_after AS VARCHAR) || ' after)' END) AS confounds, n_before < 5 OR n_after < 5 AS low_confidence
FROM j LEFT JOIN m b ON b.kind = j.kind AND b.name = j.name AND b.side = 'before' LEFT JOIN m a ON a.kind = j.kind AND a.name = j.name AND a.side = 'after'""")
def marker_figures(spark, sf):
    u, d = F.col("user_id"), F.dayofmonth("day")
    s = sess(spark, sf).where((u < 60) & (d < 25)).select(
        F.lit("user").alias("kind"), F.concat(F.lit("u"), (u % 20).cast("string")).alias("name"), F.when(d <= 12, "before").otherwise("after").alias("side"), "at_ms", F.when(u % 7 != 0, F.col("model")).alias("model"), (u % 9 / 8.0).alias("outcome"), ((d % 3 == 0) & (u % 2 == 0)).alias("judged"), (d % 2 == 0).alias("has_signal"),
        F.when(F.col("tool_calls") > 0, F.col("tool_errors") / F.col("tool_calls")).otherwise(0.0).alias("error_rate"), "cost", (F.col("tool_calls") / 2.0).alias("calls_per_turn"), (u % 3).alias("subagents"), (F.col("n_events") / 4.0).alias("minutes"),
    )
    return collection.impact_figures(s)


# --- the second format: events as counts of tokens and calls

def rollout_lines(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    k, total = F.col("event_id"), F.round(F.col("value") * 10).cast("long")
    stamp = F.lit(1_704_067_200.0) + k
    use = lambda i, c, o: F.struct(i.cast("long").alias("input_tokens"), c.cast("long").alias("cached_input_tokens"), o.cast("long").alias("output_tokens"))
    info = F.struct(use(total, k % 3, k % 50).alias("total_token_usage"), F.when(k % 4 == 0, use(F.lit(5), k % 2, F.lit(7))).alias("last_token_usage"))
    count = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload")))
    call = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.lit("function_call").alias("type"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("name"), F.concat(F.lit("c"), k.cast("string")).alias("call_id")).alias("payload")))
    end = F.to_json(F.struct((stamp + 2).alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.lit("function_call_output").alias("type"), F.concat(F.lit("c"), k.cast("string")).alias("call_id"), F.when(k % 5 == 0, "Exit code: 1\nbad").otherwise("Exit code: 0\nerror: none").alias("output")).alias("payload")))
    context = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.concat(F.lit("m"), (k % 2).cast("string")).alias("model")).alias("payload")))
    file = F.concat(F.lit("/r/"), F.col("user_id").cast("string"))
    parts = [(0, context, k % 7 == 0), (1, count, F.lit(True)), (2, call, k % 2 == 0), (3, end, k % 6 == 0), (3, end, k % 12 == 0)]
    out = None
    for i, raw, cond in parts:
        one = e.where(cond).select(file.alias("file"), (k * 5 + i).alias("line_no"), raw.alias("raw"))
        out = one if out is None else out.union(one)
    return out


_COUNTS = """u AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN 5 WHEN b IS NULL OR v < b THEN v ELSE v - b END AS input, CASE WHEN event_id % 4 = 0 THEN event_id % 2 WHEN bc IS NULL OR c < bc THEN c ELSE c - bc END AS cached, CASE WHEN event_id % 4 = 0 THEN 7 WHEN bo IS NULL OR o < bo THEN o ELSE o - bo END AS output
 FROM (SELECT *, lag(v) OVER w AS b, lag(c) OVER w AS bc, lag(o) OVER w AS bo FROM (SELECT user_id, event_id, CAST(round(value * 10) AS BIGINT) AS v, event_id % 3 AS c, event_id % 50 AS o FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)))"""


@query(f"WITH {_COUNTS} SELECT '/r/' || CAST(user_id AS VARCHAR) AS file, CAST(greatest(0, sum(input) - sum(cached)) AS BIGINT) AS input_tokens, CAST(sum(cached) AS BIGINT) AS cache_tokens, CAST(sum(output) AS BIGINT) AS output_tokens FROM u GROUP BY user_id")
def rollout_tokens(spark, sf):
    return rollouts.totals(rollouts.usage(rollouts.records(rollout_lines(spark, sf))))


@query("""WITH e AS (SELECT user_id, event_id, last_value(CASE WHEN event_id % 7 = 0 THEN 'm' || CAST(event_id % 2 AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS model FROM events)
SELECT '/r/' || CAST(user_id AS VARCHAR) AS file, event_id * 5 + 2 AS line_no, 'f' || CAST(event_id % 3 AS VARCHAR) AS tool, model, event_id % 6 = 0 AND event_id % 5 = 0 AS is_error, CASE WHEN event_id % 6 = 0 THEN 2000 END AS duration_ms FROM e WHERE event_id % 2 = 0""")
def rollout_calls(spark, sf):
    return rollouts.calls(rollouts.records(rollout_lines(spark, sf))).withColumn("duration_ms", F.col("duration_ms").cast("int"))


@query("""WITH f AS (SELECT o_orderkey AS file, o_custkey AS size FROM orders WHERE o_orderkey % 5 <> 0) SELECT o_orderkey AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'old' WHEN o_orderkey % 4 = 1 AND o_orderkey % 2 = 1 THEN 'new' WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'kept' END AS session FROM orders WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 4 = 1 OR o_orderkey % 2 = 0) OR o_orderkey % 5 = 0 AND o_orderkey % 2 = 0""")
def merged_parse_cache(spark, sf):
    k = F.col("file")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), F.lit(1).alias("mtime"), F.col("o_custkey").alias("size"))
    files = o.where("file % 5 <> 0")
    cache = o.where("file % 2 = 0").withColumn("version", F.lit(18)).withColumn("session", F.when(k % 5 == 0, "old").otherwise("kept"))
    parsed = files.where("file % 3 = 0 or file % 4 = 1").withColumn("session", F.lit("new"))
    return collection.cached_parses(files, cache, parsed, 18).select("file", "session")
