"""Queries on lists of cases, sessions, runs and markers, and on totals of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import insights, lists, sessions
from quarry.plans.catalogue import _POINTS, _SCORES, NOW_MS, _points
from quarry.plans.registry import query
from quarry.plans.views import SESS, sess, table

_CASES = "SELECT p_partkey AS case_id, p_brand AS category, CASE WHEN p_size % 4 <> 0 THEN 'd' || CAST(p_size % 4 AS VARCHAR) END AS difficulty, string_split(lower(p_type), ' ') AS tags, p_name AS name FROM part"


def _cases(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("category"), F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("d"), (F.col("p_size") % 4).cast("string"))).alias("difficulty"), F.split(F.lower("p_type"), " ").alias("tags"), F.col("p_name").alias("name"))


@query(f"WITH c AS ({_CASES}), t AS (SELECT unnest(tags) AS tag FROM c), b AS (SELECT min(tag) AS first_, max(tag) AS last_ FROM t) SELECT case_id FROM c, b WHERE difficulty IN ('d1', 'd3') AND (list_contains(tags, first_) OR list_contains(tags, last_))")
def selected_cases(spark, sf):
    tags = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("t")).agg(F.min("t"), F.max("t")).first()
    return lists.select_cases(_cases(spark, sf), ids=[], tags=list(tags), difficulties=["d1", "d3"]).select("case_id")


@query(f"WITH c AS ({_CASES}) SELECT DISTINCT unnest(tags) AS tag FROM c ORDER BY tag")
def case_tags(spark, sf):
    return _cases(spark, sf).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


@query(f"WITH c AS ({_CASES}) SELECT case_id FROM c WHERE lower(name) LIKE '%re%' OR CAST(case_id AS VARCHAR) LIKE '%re%' OR len(list_filter(tags, lambda t: t LIKE '%re%')) > 0")
def case_search(spark, sf):
    return _cases(spark, sf).where(lists.holds("RE", F.col("name"), F.col("case_id").cast("string")) | lists.any_holds("RE", F.col("tags"))).select("case_id")


@query(f"WITH c AS ({_CASES}) SELECT category, count(*) AS total, count(*) FILTER (difficulty IS NULL) AS untiered FROM c GROUP BY category")
def cases_by_category(spark, sf):
    return _cases(spark, sf).groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("difficulty").isNull()).alias("untiered"))


_LIVE = f"SELECT *, until AS last_event_at, tool_errors > 2 AS is_error, CAST(user_id % 4 = 1 AS INT) AS hook_errors, 100 - user_id % 50 AS quality, CAST(user_id % 9 = 0 AS INT) AS malformed, CASE WHEN user_id % 6 = 0 THEN 'missing' ELSE 'measured' END AS src FROM ({SESS})"


def _live(spark, sf):
    u = F.col("user_id")
    return sess(spark, sf).withColumns({"last_event_at": F.col("until"), "is_error": F.col("tool_errors") > 2, "hook_errors": (u % 4 == 1).cast("int"), "quality": 100 - u % 50, "malformed": (u % 9 == 0).cast("int"), "sources": F.array(F.lit("measured"), F.when(u % 6 == 0, "missing").otherwise("measured"))})


@query(f"""WITH l AS ({_LIVE}) SELECT 'attention' AS what, session_id FROM l WHERE is_error OR tool_errors > 0 OR hook_errors > 0 OR quality < 70 OR malformed > 0 UNION ALL SELECT 'stale', session_id FROM l WHERE greatest(0, {NOW_MS} - until) > 43200000 UNION ALL SELECT 'missing', session_id FROM l WHERE src = 'missing' UNION ALL
SELECT 'all', session_id FROM l WHERE session_id LIKE '%p1%' OR project LIKE '%p1%' OR model LIKE '%p1%'""")
def live_filters(spark, sf):
    s = _live(spark, sf)
    parts = [lists.sessions_where(s, what, NOW_MS, "P1" if what == "all" else "").select(F.lit(what).alias("what"), "session_id") for what in ("attention", "stale", "missing", "all")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"WITH l AS ({_LIVE}) (SELECT 'quality' AS how, session_id FROM l ORDER BY quality, until DESC, session_id LIMIT 30) UNION ALL (SELECT 'errors', session_id FROM l ORDER BY tool_errors DESC, until DESC, session_id LIMIT 30) UNION ALL (SELECT 'tools', session_id FROM l ORDER BY tool_calls DESC, tool_errors DESC, session_id LIMIT 30) UNION ALL (SELECT 'recent', session_id FROM l ORDER BY until DESC, session_id LIMIT 30)")
def session_orders(spark, sf):
    s = _live(spark, sf)
    parts = [lists.ordered(s, how, "session_id").limit(30).select(F.lit(how).alias("how"), "session_id") for how in ("quality", "errors", "tools", "recent")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND lower(text) LIKE '%the%'")
def turn_filter(spark, sf):
    t = table(spark, sf, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))).withColumn("severity", F.lit("info"))
    return lists.turns_where(t, "tools", "THE").select("conv_id", "turn")


@query("SELECT count(*) AS turns, count(*) FILTER (role <> 'system') AS chat, count(*) FILTER (role = 'assistant' AND turn % 5 = 1) AS tools, count(*) FILTER (role = 'assistant' AND turn % 5 = 1) AS errors FROM conversations")
def turn_chips(spark, sf):
    t = table(spark, sf, "conversations").withColumn("severity", F.when((F.col("role") == "assistant") & (F.col("turn") % 5 == 1), "error").otherwise("info"))
    return lists.turn_counts(t)


_RUNS = "SELECT o_custkey % 300 AS run_id, 'h' || CAST(o_custkey % 7 AS VARCHAR) AS harness, max(o_orderdate) AS created_at, count(*) FILTER (o_orderstatus = 'O') AS passed, count(*) AS n FROM orders GROUP BY o_custkey % 300, o_custkey % 7"


@query(f"WITH r AS ({_RUNS}) SELECT run_id, harness, passed, CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN 'This week' WHEN d < 30 THEN 'This month' ELSE 'Older' END AS \"group\" FROM (SELECT *, date_diff('day', CAST(created_at AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) AS d FROM r) WHERE passed > 0 AND harness LIKE '%3%' OR passed > 0 AND CAST(run_id AS VARCHAR) LIKE '%3%'")
def runs_by_day(spark, sf):
    o = table(spark, sf, "orders")
    r = o.groupBy((F.col("o_custkey") % 300).alias("run_id"), F.concat(F.lit("h"), (F.col("o_custkey") % 7).cast("string")).alias("harness")).agg(F.max("o_orderdate").alias("created_at"), F.count_if(F.col("o_orderstatus") == "O").alias("passed"))
    today = F.lit(o.agg(F.max(F.to_date("o_orderdate"))).first()[0])
    return lists.day_groups(lists.runs_where(r.withColumn("name", F.lit("")), "passes", "3"), today, "created_at").select("run_id", "harness", "passed", "group")


@query("""WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events), t AS (SELECT user_id, event_type, max(nth) AS count, arg_max(event_id, nth) AS reached FROM n GROUP BY ALL)
SELECT user_id, event_type AS mode, count FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count DESC, reached) = 1""")
def mode_by_arrival(spark, sf):
    return lists.mode_by_arrival(table(spark, sf, "events"), "user_id", "event_type", "event_id").select("user_id", "mode", F.col("count").cast("long").alias("count"))


@query("""WITH a AS (SELECT p_partkey AS id, p_brand AS label, p_partkey AS place FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS id, p_type AS label, 10000000 + p_partkey AS place FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(a.id, b.id) AS id, coalesce(b.label, a.label) AS label, coalesce(a.place, b.place) AS place FROM a FULL JOIN b ON a.id = b.id""")
def override_by_id(spark, sf):
    """The later list's row wins, at the former's position."""
    p = table(spark, sf, "part")
    a = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_partkey").cast("long").alias("place"))
    b = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"), (10_000_000 + F.col("p_partkey")).cast("long").alias("place"))
    return lists.precedence([a, b], "id", "place")


#: z from which a place is looked at beside the markers; the smallest tables have weak ones alone. Days are markers, too: the
#: models are all seen before a series has places.
_NEAR = 0.5


@query(f"""WITH {_SCORES}, m AS (SELECT 'model' AS kind, model AS name, min(at_ms) AS first_seen_at FROM p GROUP BY model UNION ALL SELECT 'day', CAST(day AS VARCHAR), min(at_ms) FROM p GROUP BY day)
SELECT series, i, kind, name, abs(first_seen_at - at_ms) AS gap, row_number() OVER (PARTITION BY series, i ORDER BY abs(first_seen_at - at_ms), first_seen_at, kind, name) AS r FROM (SELECT series, i, z.at_ms, kind, name, first_seen_at FROM z, m WHERE z > {_NEAR} AND abs(first_seen_at - z.at_ms) <= 7 * 86400000) QUALIFY r <= 3""")
def change_points_near_markers(spark, sf):
    p = _points(spark, sf)
    z = insights.change_scores(p, "tool_calls").where(F.col("z") > _NEAR)
    marks = insights.markers(p, {"model": F.col("model"), "day": F.col("day").cast("string")})
    return lists.near_markers(z.select("series", "i", "at_ms"), marks).select("series", "i", "kind", "name", "gap", F.col("r").cast("long").alias("r"))


_JUDGE = f"""j AS (SELECT session_id, at_ms, CASE WHEN user_id % 10 = 0 THEN CASE WHEN user_id % 20 = 0 THEN 'after' ELSE 'before' END END AS side, CASE WHEN user_id % 10 = 0 THEN day(day) END AS rk FROM ({SESS})),
f AS (SELECT session_id, 'marker' AS why FROM j WHERE rk <= 20 ORDER BY 2 * rk - CAST(side = 'after' AS INT), at_ms, session_id LIMIT 60), n AS (SELECT 60 - count(*) AS budget FROM f),
r AS (SELECT session_id, row_number() OVER (ORDER BY at_ms, session_id) - 1 AS i, count(*) OVER () AS n FROM j WHERE NOT coalesce(rk <= 20, false))"""


@query(f"WITH {_JUDGE} SELECT session_id, why FROM f UNION ALL SELECT session_id, 'stride' FROM r, n AS b WHERE b.budget > 0 AND (r.n <= b.budget OR list_contains([(k * r.n) // b.budget FOR k IN range(b.budget)], i))")
def judge_sample(spark, sf):
    u = F.col("user_id")
    s = sess(spark, sf).select("session_id", "at_ms", F.col("session_id").alias("tie"), F.when(u % 20 == 0, "after").when(u % 10 == 0, "before").alias("side"), F.when(u % 10 == 0, F.dayofmonth("day")).alias("rank"))
    return lists.judge_sample(s, 60).select("session_id", "why")


@query("""WITH f AS (SELECT o_custkey AS file, count(*) + 2 * count(*) FILTER (o_orderkey % 10 = 0) AS attempts, bool_or(o_orderkey % 10 = 0) AS permanent FROM orders GROUP BY o_custkey) SELECT file, CAST(attempts AS BIGINT) AS attempts, permanent FROM f WHERE file % 4 <> 0""")
def failure_ledger(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 10 == 0).alias("permanent"))
    return lists.ledger(o, o.where("file % 4 = 0"))


@query("""WITH f AS (SELECT o_custkey AS file, count(*) + 2 * count(*) FILTER (o_orderkey % 10 = 0) AS attempts, bool_or(o_orderkey % 10 = 0) AS permanent FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey)
SELECT c_custkey AS file FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey NOT IN (SELECT file FROM f WHERE permanent OR attempts >= 9)""")
def files_to_judge(spark, sf):
    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("file"))
    failed = table(spark, sf, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 10 == 0).alias("permanent"))
    return lists.to_judge(files, files.where("file % 5 = 0"), lists.ledger(failed, files.limit(0)), 9)


@query("""WITH e AS (SELECT l_orderkey AS run_id, l_linenumber AS ln, unnest([l_linestatus, l_returnflag]) AS warning, unnest([0, 1]) AS pos FROM lineitem), f AS (SELECT run_id, warning, min(ln * 10 + pos) AS place FROM e GROUP BY ALL)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY place, warning) AS r, warning FROM f QUALIFY r <= 8""")
def first_warnings(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", F.array("l_linestatus", "l_returnflag").alias("w"))
    return lists.first_warnings(rows, "run_id", "l_linenumber", "w").select("run_id", F.col("r").cast("long").alias("r"), "warning")


@query("SELECT o_orderkey, left(o_orderpriority, 3) AS o_orderpriority FROM orders")
def lite_rows(spark, sf):
    return lists.lite(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), {"o_orderpriority": 3}, ["o_totalprice"])


@query(f"""WITH s AS ({SESS}) SELECT count(*) AS sessions, count(DISTINCT project) AS projects, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(tool_errors) AS BIGINT) AS tool_errors, round(sum(tool_errors) / sum(tool_calls), 6) AS tool_error_share, round(sum(cost), 2) AS cost, round(count(*) FILTER (cost > 0) / count(*), 6) AS priced_share,
 max(until) AS last_event_at, round(sum(cost) FILTER (model = 'm0') / sum(cost), 6) AS first_model_share FROM s""")
def collection_ratios(spark, sf):
    return sessions.ratios(sess(spark, sf), "m0")


@query("""WITH g AS (SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL), h AS (SELECT hour, sum(n) AS n FROM g GROUP BY hour), w AS (SELECT weekday, sum(n) AS n FROM g GROUP BY weekday)
SELECT CAST((SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS INT) AS peak_hour, CAST((SELECT weekday FROM w ORDER BY n DESC, weekday LIMIT 1) AS INT) AS busiest_day, round((SELECT sum(n) FROM w WHERE weekday >= 5) / (SELECT sum(n) FROM w), 6) AS weekend_share""")
def rhythm(spark, sf):
    return sessions.rhythm(sessions.heatmap(table(spark, sf, "events")))


@query(f"WITH p AS ({_POINTS}) SELECT series, round(avg(CAST(cost > 0 AS INT)), 6) AS signal_share, round(avg(CAST(user_id % 3 = 0 AS INT)), 6) AS judged_share FROM p GROUP BY series")
def coverage_shares(spark, sf):
    p = _points(spark, sf)
    return p.groupBy("series").agg(F.round(F.avg((F.col("cost") > 0).cast("double")), 6).alias("signal_share"), F.round(F.avg((F.col("user_id") % 3 == 0).cast("double")), 6).alias("judged_share"))


@query("SELECT o_custkey % 40 AS run_id, CAST(max(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 = 0 THEN 3 WHEN o_orderstatus = 'P' THEN 2 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INT) AS code, count(*) FILTER (o_orderstatus IN ('O', 'F')) AS done, count(*) AS total FROM orders GROUP BY o_custkey % 40")
def exit_codes(spark, sf):
    """The gravest of a run's cases decides: a grader that broke, infrastructure, a failure."""
    o = table(spark, sf, "orders")
    code = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 11 == 0), 3).when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return o.groupBy((F.col("o_custkey") % 40).alias("run_id")).agg(F.max(code).alias("code"), F.count_if(F.col("o_orderstatus").isin("O", "F")).alias("done"), F.count("*").alias("total"))


@query("""WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS span, epoch_us(l_shipdate) // 1000 AS a, epoch_us(l_shipdate) // 1000 + CAST(l_quantity AS BIGINT) * 86400000 AS b FROM lineitem), w AS (SELECT *, min(a) OVER p AS lo, max(b) OVER p AS hi FROM s WINDOW p AS (PARTITION BY run_id))
SELECT run_id, span, round(100.0 * (a - lo) / (hi - lo), 4) AS "left", round(greatest(0.4, 100.0 * (b - a) / (hi - lo)), 4) AS width FROM w""")
def run_timeline(spark, sf):
    from quarry.plans.views import millis

    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("span"), millis("l_shipdate").alias("a"), (F.col("l_quantity").cast("long") * 86_400_000).alias("took"))
    return insights.timeline(line.withColumn("b", F.col("a") + F.col("took")).drop("took"), "run_id")
