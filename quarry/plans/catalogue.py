"""Queries on runs, sessions, insight, search and messages, with the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import stats, text
from quarry.operators import evaluation, insights, sessions
from quarry.plans.registry import query
from quarry.plans.views import RUN_CASE, SESS, millis, run_case, sess, table

NOW = "2024-01-30 12:00:00"
NOW_MS = 1_706_616_000_000


_COUNTS = """count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'error') AS errored,
 count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status NOT IN ('passed', 'failed', 'error', 'skipped')) AS stranded, round(count(*) FILTER (status = 'passed') / count(*), 6) AS pass_rate"""


@query(f"WITH c AS ({RUN_CASE}) SELECT run_id, {_COUNTS} FROM c GROUP BY run_id")
def run_status_summary(spark, sf):
    return evaluation.status_counts(run_case(spark, sf), "run_id")


@query(f"WITH c AS ({RUN_CASE}) SELECT difficulty, {_COUNTS} FROM c GROUP BY difficulty")
def run_by_difficulty(spark, sf):
    return evaluation.status_counts(run_case(spark, sf).withColumn("difficulty", F.coalesce("difficulty", F.lit("untiered"))), "difficulty")


@query(f"""WITH c AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'measured' WHEN 1 THEN 'inferred' ELSE 'missing' END AS provenance FROM ({RUN_CASE}))
SELECT provenance, count(*) AS cases, round(sum(CASE WHEN provenance = 'missing' THEN 0.0 ELSE cost END), 2) AS cost FROM c GROUP BY provenance""")
def run_cost_provenance(spark, sf):
    p = F.when(F.col("o_orderkey") % 3 == 0, "measured").when(F.col("o_orderkey") % 3 == 1, "inferred").otherwise("missing")
    return evaluation.cost_by_provenance(run_case(spark, sf).withColumn("provenance", p))


@query(f"""WITH r AS ({RUN_CASE}), b AS (SELECT run_id, case_id, count(*) AS n, count(*) FILTER (status = 'passed') AS c FROM r GROUP BY ALL), k AS (SELECT run_id, max(sample) + 1 AS k FROM r GROUP BY run_id),
e AS (SELECT b.*, k, CASE WHEN c = 0 THEN 0.0 ELSE c / n END AS p1, CASE WHEN c = 0 THEN 0.0 WHEN n - c < least(k, n) THEN 1.0
  ELSE 1 - list_reduce([1 - least(k, n) / i FOR i IN range(n - c + 1, n + 1)], lambda a, x: a * x) END AS pk FROM b JOIN k USING (run_id)),
a AS (SELECT run_id, count(*) AS cases, max(k) AS k, avg(p1) AS p1, avg(pk) AS pk, avg(CAST(c = n AS INT)) AS ap FROM e GROUP BY run_id),
w AS (SELECT *, round(round(p1 * cases, 9)) / cases AS p FROM a)
SELECT run_id, cases, CAST(k AS BIGINT) AS k, round(p1, 6) AS pass_at_1, round(pk, 6) AS pass_at_k, round(ap, 6) AS all_pass,
 round(greatest(0.0, (p + 3.8416 / (2 * cases) - 1.96 * sqrt(p * (1 - p) / cases + 3.8416 / (4 * cases * cases))) / (1 + 3.8416 / cases)), 6) AS lo,
 round(least(1.0, (p + 3.8416 / (2 * cases) + 1.96 * sqrt(p * (1 - p) / cases + 3.8416 / (4 * cases * cases))) / (1 + 3.8416 / cases)), 6) AS hi FROM w""")
def run_pass_at_k(spark, sf):
    return evaluation.pass_at_k(run_case(spark, sf))


@query(f"""WITH c AS ({RUN_CASE}) SELECT run_id, quantile_disc(cost, 0.5) AS p50, quantile_disc(cost, 0.95) AS p95, max(cost) AS most, round(sum(cost), 2) AS cost, round(avg(CAST(status = 'error' AS INT)), 6) AS error_rate,
 round(avg(CAST(status = 'failed' AS INT)), 6) AS fail_rate, min(cost) FILTER (status = 'passed') AS cheapest_pass FROM c GROUP BY run_id""")
def telemetry_percentiles(spark, sf):
    return evaluation.telemetry(run_case(spark, sf))


@query("""WITH d AS (SELECT l_orderkey AS file, l_returnflag AS tool, list_sort(list(l_quantity)) AS d FROM lineitem GROUP BY ALL)
SELECT file, tool, CAST(len(d) AS BIGINT) AS n, d[least(len(d) - 1, CAST(floor(len(d) * 0.5) AS INT)) + 1] AS p50, d[least(len(d) - 1, CAST(floor(len(d) * 0.95) AS INT)) + 1] AS p95, list_max(d) AS longest FROM d""")
def tool_duration_floor_pct(spark, sf):
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("tool"), F.col("l_quantity").alias("duration"))
    return evaluation.tool_durations(calls)


@query("SELECT l_returnflag || l_linestatus AS tool, count(*) AS calls FROM lineitem GROUP BY ALL ORDER BY calls DESC, tool LIMIT 8")
def top_tools_map_merge(spark, sf):
    each = table(spark, sf, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("tool")).agg(F.count("*").alias("n"))
    return evaluation.top_tools(each.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("tool", "n"))).alias("counts")), 8)


@query(f"""WITH c AS ({RUN_CASE}) SELECT harness, count(DISTINCT run_id) AS runs, count(*) FILTER (status IN ('passed', 'failed', 'error')) AS cases, count(*) FILTER (status = 'passed') AS passed, round(sum(cost), 2) AS cost,
 round(count(*) FILTER (status = 'passed') / count(*) FILTER (status IN ('passed', 'failed', 'error')), 6) AS pass_rate FROM c GROUP BY harness""")
def leaderboard(spark, sf):
    return evaluation.leaderboard(run_case(spark, sf))


@query(f"""WITH c AS ({RUN_CASE}), a AS (SELECT * FROM c WHERE run_id = 0), b AS (SELECT * FROM c WHERE run_id = 1)
SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.sample, b.sample) AS sample, a.status AS a_status, b.status AS b_status, coalesce(b.difficulty, a.difficulty) AS difficulty,
 CASE WHEN a.status IS NULL THEN 'added' WHEN b.status IS NULL THEN 'removed' WHEN a.status = b.status THEN 'same' WHEN b.status = 'passed' THEN 'fixed' WHEN a.status = 'passed' THEN 'regressed' ELSE 'changed' END AS change,
 round(b.cost - a.cost, 2) AS cost_delta FROM a FULL JOIN b ON a.case_id = b.case_id AND a.sample = b.sample""")
def run_diff_full_outer(spark, sf):
    c = run_case(spark, sf)
    return evaluation.run_diff(c.where("run_id = 0"), c.where("run_id = 1"))


@query("""WITH g AS (SELECT l_orderkey AS case_id, l_linenumber * 0.5 AS weight, l_discount < 0.05 AS passed, l_linenumber % 7 = 0 AS forbidden FROM lineitem)
SELECT case_id, round(CASE WHEN sum(weight) > 0 THEN sum(weight * CAST(passed AS INT)) / sum(weight) ELSE 1.0 END, 6) AS pass_ratio,
 sum(weight * CAST(passed AS INT)) / sum(weight) >= 1 AND NOT bool_or(forbidden AND NOT passed) AS passed FROM g GROUP BY case_id""")
def weighted_grade(spark, sf):
    g = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") * 0.5).alias("weight"), (F.col("l_discount") < 0.05).alias("passed"), (F.col("l_linenumber") % 7 == 0).alias("forbidden"))
    return evaluation.weighted_grades(g)


@query("""WITH c AS (SELECT l_orderkey AS file, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS t FROM lineitem GROUP BY ALL)
SELECT file, CAST(len(list_filter(t, lambda x: x = 'R')) AS BIGINT) AS n, CAST(coalesce(list_position(t, 'R'), 0) AS BIGINT) AS first, len(list_filter(t, lambda x: x = 'R')) >= 2 AS passed FROM c""")
def step_checks(spark, sf):
    return evaluation.step_checks(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("tool")), "R", 2)


@query("""WITH a AS (SELECT p_partkey AS path, p_brand AS content FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS path, CASE WHEN p_size < 10 THEN p_type ELSE p_brand END AS content FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.content = b.content THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path""")
def files_unchanged(spark, sf):
    p = table(spark, sf, "part")
    now = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("content"))
    return evaluation.files_unchanged(now, p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") < 10, F.col("p_type")).otherwise(F.col("p_brand")).alias("content")))


@query(f"""WITH s AS ({SESS}), w AS (SELECT CAST(date_trunc('week', TIMESTAMP '{NOW}') AS DATE) - CAST(7 * i AS INT) AS week FROM range(16) t(i)),
f AS (SELECT CAST(date_trunc('week', started_at) AS DATE) AS week, count(*) AS n, sum(cost) AS cost, sum(tool_calls) AS calls FROM s GROUP BY ALL)
SELECT CAST(w.week AS VARCHAR) AS week, coalesce(n, 0) AS sessions, round(coalesce(cost, 0.0), 2) AS cost, CAST(coalesce(calls, 0) AS BIGINT) AS tool_calls FROM w LEFT JOIN f ON w.week = f.week""")
def weekly_usage_spine(spark, sf):
    return sessions.weekly(sess(spark, sf), NOW, 16)


@query(f"WITH s AS ({SESS}) SELECT project, count(*) AS sessions, round(sum(cost), 2) AS cost, CAST(sum(n_events) AS BIGINT) AS events, max(until) AS last_active FROM s GROUP BY project ORDER BY cost DESC, project LIMIT 8")
def project_rank(spark, sf):
    return sessions.projects(sess(spark, sf), 8)


_GRID = """g AS (SELECT CAST(d AS INT) AS weekday, CAST(h AS INT) AS hour FROM range(7) a(d), range(24) b(h)), c AS (SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT g.weekday, g.hour, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.weekday = c.weekday AND g.hour = c.hour)"""


@query(f"WITH {_GRID} SELECT * FROM m")
def heatmap_weekday_hour(spark, sf):
    return sessions.heatmap(table(spark, sf, "events"))


@query(f"WITH {_GRID} SELECT CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END AS part, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT sum(n) FROM m), 6) AS share FROM m GROUP BY part")
def day_parts(spark, sf):
    return sessions.day_parts(sessions.heatmap(table(spark, sf, "events")))


_TOTALS = """count(*) AS sessions, count(DISTINCT project) AS projects, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(tool_errors) AS BIGINT) AS tool_errors, round(sum(cost), 2) AS cost, count(*) FILTER (cost > 0) AS priced,
 round(avg(CASE WHEN tool_calls > 0 THEN tool_errors / tool_calls ELSE 0.0 END), 6) AS mean_error_rate"""


@query(f"WITH s AS ({SESS}) SELECT source, {_TOTALS} FROM s GROUP BY source")
def session_totals(spark, sf):
    return sessions.totals(sess(spark, sf), "source")


@query(f"WITH s AS ({SESS}) SELECT model, {_TOTALS} FROM s GROUP BY model")
def by_model_rollup(spark, sf):
    return sessions.by_model(sess(spark, sf))


@query(f"WITH s AS ({SESS}) SELECT model, count(*) AS sessions, round(sum(cost), 2) AS cost, CAST(sum(tool_calls) AS BIGINT) AS tool_calls FROM s GROUP BY model ORDER BY cost DESC, model LIMIT 4")
def merge_rollups_across_sources(spark, sf):
    s = sess(spark, sf)
    per = lambda name: s.where(F.col("source") == name).groupBy("model").agg(F.count("*").alias("sessions"), F.sum("cost").alias("cost"), F.sum("tool_calls").alias("tool_calls"))
    return sessions.merge_rollups([per("s0"), per("s1"), per("s2")], 4)


@query(f"""WITH s AS ({SESS}), r(model, rate_in, rate_out) AS (VALUES ('m0', 5.0, 25.0), ('m1', 3.0, 15.0), ('m2', 1.0, 5.0), ('m3', 0.75, 4.5))
SELECT session_id, s.model, CASE WHEN tool_calls + tool_errors > 0 AND rate_in IS NOT NULL THEN round((tool_calls * 1000 * CAST(rate_in AS DOUBLE) + tool_errors * 500 * CAST(rate_out AS DOUBLE)) / 1000000, 9) END AS estimate FROM s LEFT JOIN r ON s.model = r.model""")
def cost_estimate(spark, sf):
    rates = spark.createDataFrame([("m0", 5.0, 25.0), ("m1", 3.0, 15.0), ("m2", 1.0, 5.0), ("m3", 0.75, 4.5)], "model string, rate_in double, rate_out double")
    return sessions.costs(sess(spark, sf), rates)


@query(f"""WITH s AS ({SESS}) SELECT session_id, round(CASE WHEN sum(tool_calls) OVER w > 0 THEN sum(cost) OVER w * tool_calls / sum(tool_calls) OVER w
 WHEN row_number() OVER (PARTITION BY user_id ORDER BY day) = 1 THEN sum(cost) OVER w ELSE 0.0 END + 1e-9, 5) AS share FROM s WINDOW w AS (PARTITION BY user_id)""")
def cost_allocation(spark, sf):
    # off the halves, which two orders of adding round differently
    return sessions.allocated(sess(spark, sf)).withColumn("share", F.round(F.col("share") + 1e-9, 5))


def _provenances():
    p = lambda n: F.element_at(F.array(*map(F.lit, ("measured", "inferred", "missing", "malformed"))), ((F.col("user_id") + n * F.dayofmonth("day")) % 4 + 1).cast("int"))
    return [p(i) for i in range(1, 6)]


_P = ["['measured', 'inferred', 'missing', 'malformed'][CAST((user_id + {0} * day(day)) % 4 AS INT) + 1]".format(i) for i in range(1, 6)]
_GONE = " - ".join(f"CASE WHEN {p} IN ('missing', 'malformed') THEN {n} ELSE 0 END" for p, n in zip(_P, (12, 14, 8, 12)))
_ERR = "CASE WHEN tool_calls > 0 THEN tool_errors / tool_calls ELSE 0.0 END"


@query(f"""WITH s AS ({SESS}) SELECT session_id, CAST(greatest(0, least(100, 100 - {_GONE} - CASE WHEN {_P[4]} = 'missing' THEN 8 WHEN {_P[4]} = 'inferred' THEN 3 ELSE 0 END
 - CASE WHEN signups > 0 THEN least(20, ceil(signups * 100.0 / n_events)) ELSE 0 END - CASE WHEN tool_errors > 0 THEN least(12, tool_errors * 2) ELSE 0 END - CASE WHEN {_ERR} > 0.25 THEN 6 ELSE 0 END)) AS BIGINT) AS quality FROM s""")
def quality_score(spark, sf):
    s = sess(spark, sf)
    return s.select("session_id", stats.quality_score(*_provenances(), F.col("signups"), F.col("n_events"), F.col("tool_errors"), stats.rate(F.col("tool_errors"), F.col("tool_calls"))).alias("quality"))


_OUTCOME = f"""greatest(0.0, least(1.0, 0.5 + 0.25 * tanh(signups) - 0.30 * tanh(tool_errors) - 0.08 * tanh(tool_calls / 2) + CASE WHEN tool_errors > 1 THEN -0.12 ELSE 0.0 END
 + CASE WHEN n_events > 3 THEN 0.1 ELSE 0.0 END - 0.06 * tanh(n_events / 3) - 0.1 * least(1.0, {_ERR} * 2)))"""


def _outcome():
    return stats.outcome_score(F.col("signups"), F.col("tool_errors"), F.col("tool_calls"), F.col("tool_errors") > 1, F.col("n_events") > 3, F.col("n_events"), stats.rate(F.col("tool_errors"), F.col("tool_calls")))


@query(f"WITH s AS ({SESS}) SELECT session_id, round({_OUTCOME}, 6) AS outcome FROM s")
def outcome_score(spark, sf):
    return sess(spark, sf).select("session_id", F.round(_outcome(), 6).alias("outcome"))


@query("""SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'heuristic' ELSE 'judged' END AS provenance, round(coalesce(CAST(quality AS DOUBLE), 1.0 / (1 + length(source))), 6) AS outcome FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def outcome_blend_judged(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality").isNull(), "heuristic").otherwise("judged").alias("provenance"), F.round(F.coalesce(F.col("quality").cast("double"), 1.0 / (1 + F.length("source"))), 6).alias("outcome"))


@query(f"""WITH s AS ({SESS}), m AS (SELECT 'model' AS kind, model AS name, at_ms, session_id FROM s UNION ALL SELECT 'project', project, at_ms, session_id FROM s UNION ALL SELECT 'signup', 'signup', at_ms, session_id FROM s WHERE signups > 0)
SELECT kind, name, min(at_ms) AS first_seen_at, count(DISTINCT session_id) AS sessions FROM m GROUP BY kind, name""")
def markers_first_seen(spark, sf):
    return insights.markers(sess(spark, sf), {"model": F.col("model"), "project": F.col("project"), "signup": F.when(F.col("signups") > 0, "signup")})


_POINTS = f"SELECT *, project AS series, {_ERR} AS error_rate, user_id * 100 + day(day) AS ord FROM ({SESS})"


def _points(spark, sf):
    return sess(spark, sf).withColumns({"series": F.col("project"), "error_rate": stats.rate(F.col("tool_errors"), F.col("tool_calls")), "ord": F.col("user_id") * 100 + F.dayofmonth("day")})


@query(f"""WITH p AS ({_POINTS}) SELECT series, session_id, at_ms, round(median(cost) OVER w, 6) AS median, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY series ORDER BY at_ms, session_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""")
def trailing_median(spark, sf):
    return insights.trailing_median(_points(spark, sf), "cost")


@query(f"""WITH p AS ({_POINTS}), m AS (SELECT 'project' AS kind, project AS name, min(at_ms) AS first_seen_at FROM p WHERE day >= DATE '2024-01-05' GROUP BY project),
j AS (SELECT m.kind, m.name, p.*, CASE WHEN at_ms < first_seen_at THEN 'before' ELSE 'after' END AS side FROM p, m),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, name, side ORDER BY CASE WHEN side = 'before' THEN -at_ms ELSE at_ms END, CASE WHEN side = 'before' THEN -ord ELSE ord END) AS rk FROM j QUALIFY rk <= 20)
SELECT kind, name, count(*) FILTER (side = 'before') AS n_before, count(*) FILTER (side = 'after') AS n_after,
 round(coalesce(median(cost) FILTER (side = 'after'), 0) - coalesce(median(cost) FILTER (side = 'before'), 0), 6) AS cost_delta,
 round(coalesce(median(error_rate) FILTER (side = 'after'), 0) - coalesce(median(error_rate) FILTER (side = 'before'), 0), 6) AS errors_delta,
 count(*) FILTER (side = 'before') < 5 OR count(*) FILTER (side = 'after') < 5 AS low_confidence FROM r GROUP BY kind, name""")
def marker_impact(spark, sf):
    p = _points(spark, sf)
    marks = p.where("day >= date'2024-01-05'").groupBy("project").agg(F.min("at_ms").alias("first_seen_at")).select(F.lit("project").alias("kind"), F.col("project").alias("name"), "first_seen_at")
    return insights.impact(p.select("at_ms", "ord", "cost", "error_rate"), marks)


@query(f"""WITH p AS ({_POINTS}), h AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY at_ms, session_id) > floor(count(*) OVER (PARTITION BY series) / 2) AS late FROM p)
SELECT series, count(*) AS n, round(coalesce(median(cost) FILTER (NOT late), 0), 6) AS before, round(coalesce(median(cost) FILTER (late), 0), 6) AS after,
 round(coalesce(median(cost) FILTER (late), 0) - coalesce(median(cost) FILTER (NOT late), 0), 6) AS trend FROM h GROUP BY series""")
def overall_trend(spark, sf):
    return insights.trend(_points(spark, sf), "cost")


_SCORES = f"""p AS ({_POINTS}), s AS (SELECT series, at_ms, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series) AS n, avg(tool_calls) OVER a AS ma, avg(tool_calls) OVER b AS mb, var_samp(tool_calls) OVER a AS va, var_samp(tool_calls) OVER b AS vb
  FROM p WINDOW w AS (PARTITION BY series ORDER BY at_ms, session_id), a AS (PARTITION BY series ORDER BY at_ms, session_id ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series ORDER BY at_ms, session_id ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)),
z AS (SELECT series, i, at_ms, ma, mb, CASE WHEN sqrt(va / 25 + vb / 25) > 1e-9 THEN abs(mb - ma) / sqrt(va / 25 + vb / 25) ELSE 0.0 END AS z FROM s WHERE n >= 50 AND i >= 25 AND i <= n - 25)"""


@query(f"WITH {_SCORES} SELECT series, i, at_ms, round(ma, 6) AS before, round(mb, 6) AS after, round(z, 6) AS z FROM z")
def change_point_scores(spark, sf):
    s = insights.change_scores(_points(spark, sf), "tool_calls")
    return s.select("series", "i", "at_ms", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round("z", 6).alias("z"))


@query()
def change_points_selected(spark, sf):
    return insights.change_points(insights.change_scores(_points(spark, sf), "tool_calls"), least=1.5)


@query("""WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, i FROM x WHERE n <= 20 OR list_contains([(k * n) // 20 FOR k IN range(20)], i)""")
def stride_downsample(spark, sf):
    return insights.stride(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", 20).select("event_id", "user_id", F.col("i").cast("long").alias("i"))


@query("""WITH x AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT *, (SELECT min(k) FROM range(40) t(k) WHERE ceil(n / pow(2, k)) <= 20) AS r FROM x)
SELECT user_id, CAST(floor(i / pow(2, r)) AS BIGINT) AS slot, max(event_id) AS event_id, round(sum(value), 2) AS value FROM r GROUP BY ALL""")
def pairwise_downsample(spark, sf):
    return insights.pairwise(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value", 20)


@query("""SELECT event_id, user_id, round(CASE WHEN lag(value) OVER w IS NULL OR value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END, 6) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def counter_reset_delta(spark, sf):
    return insights.reset_deltas(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value").select("event_id", "user_id", F.round("delta", 6).alias("delta"))


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def running_tokens(spark, sf):
    return insights.running(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value").select("event_id", "user_id", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward(spark, sf):
    return insights.carry_forward(table(spark, sf, "events"), "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value"))).select("event_id", "user_id", "carried")


@query("""WITH x AS (SELECT *, event_type = 'error' AS e FROM events) SELECT event_id, user_id, event_type FROM (SELECT *, e OR coalesce(lag(e) OVER w, false) OR coalesce(lead(e) OVER w, false) AS near FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE near""")
def error_context(spark, sf):
    return insights.error_context(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS echo FROM events) WHERE NOT echo")
def adjacent_echo_dedup(spark, sf):
    return insights.without_echo(table(spark, sf, "events"), "user_id", "event_id", ["event_type"]).select("event_id", "user_id", "event_type")


_SAID = [(1, "Thanks, that works now"), (2, "no"), (3, "No, that is wrong"), (4, "check that there is no slowdown"), (5, "still failing on main"), (6, "perfect"), (7, "perfect, yet it is broken"), (8, "please add the login page"), (9, "please add that login page again"), (10, "actually, use another name")]
_SAID_SQL = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in _SAID)


def _said(spark, sf):
    probes = spark.createDataFrame(_SAID, "turn long, text string").select(F.lit(-1).cast("long").alias("conv_id"), "turn", "text")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text").unionByName(probes)


_SAID_VIEW = f"SELECT conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT -1, i, t FROM (VALUES {_SAID_SQL}) v(i, t)"
_NEG = text.NEGATIVE.replace("'", "''")
_POS = text.POSITIVE.replace("'", "''")


@query(rf"""WITH m AS ({_SAID_VIEW}) SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(?:^[ \t\r\n]*no(?:[ \t\r\n]*$|[,.!]|[ \t\r\n]+thanks?\b)|\b(?:{_NEG})\b)') THEN 'negative'
 WHEN regexp_matches(text, '(?i)\b(?:{_POS})\b') THEN 'positive' ELSE 'neutral' END AS sentiment FROM m""")
def sentiment(spark, sf):
    return _said(spark, sf).select("conv_id", "turn", text.sentiment(F.col("text")).alias("sentiment"))


@query(rf"""WITH m AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS t FROM ({_SAID_VIEW})), l AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY conv_id ORDER BY turn), []) AS b FROM m WHERE length(text) <= 600)
SELECT conv_id, turn, regexp_matches(text, '(?i){text.REPHRASE_LEAD}') OR (least(len(t), len(b)) >= 3 AND len(list_intersect(t, b)) >= 0.6 * least(len(t), len(b))) AS rephrase FROM l""")
def rephrase_overlap(spark, sf):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return _said(spark, sf).where("length(text) <= 600").withColumn("before", before).select("conv_id", "turn", text.is_rephrase(F.col("text"), F.col("before")).alias("rephrase"))


@query("""SELECT l_orderkey AS file, count(*) AS calls, count(o_orderkey) AS paired, CAST(max(CASE WHEN o_orderkey IS NOT NULL THEN greatest(0, date_diff('day', o_orderdate, l_shipdate)) END) AS BIGINT) AS longest
FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) o ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def tool_pairing(spark, sf):
    starts = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderdate")
    j = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").join(starts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    took = F.greatest(F.lit(0), F.datediff("l_shipdate", "o_orderdate"))
    return j.groupBy(F.col("l_orderkey").alias("file")).agg(F.count("*").alias("calls"), F.count("o_orderkey").alias("paired"), F.max(F.when(F.col("o_orderkey").isNotNull(), took)).cast("long").alias("longest"))


@query("SELECT count(DISTINCT o_custkey) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def orphan_anti_join(spark, sf):
    parents = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_custkey").distinct().join(parents, "o_custkey", "left_anti").agg(F.count("*").alias("orphans"))


_FILES = "SELECT o_orderkey AS file, (epoch_us(o_orderdate) // 1000) AS mtime, CAST(o_totalprice AS BIGINT) AS size, 18 AS version FROM orders"


@query(f"WITH f AS ({_FILES}), c AS (SELECT file, mtime, size + CAST(file % 5 = 0 AS INT) AS size, 18 - CAST(file % 7 = 0 AS INT) AS version FROM f WHERE file % 2 = 0) SELECT f.file FROM f ANTI JOIN c ON f.file = c.file AND f.mtime = c.mtime AND f.size = c.size AND f.version = c.version")
def cache_pending_anti_join(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), millis("o_orderdate").alias("mtime"), F.round("o_totalprice").cast("long").alias("size"), F.lit(18).alias("version"))
    cache = f.where("file % 2 = 0").select("file", "mtime", (F.col("size") + (F.col("file") % 5 == 0).cast("int")).alias("size"), (18 - (F.col("file") % 7 == 0).cast("int")).alias("version"))
    return sessions.pending(f, cache).select("file")


@query("""WITH d AS (SELECT o_orderkey AS file, o_custkey AS session_id, (epoch_us(o_orderdate) // 1000) AS mtime FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 = 0), c AS (SELECT o_orderkey AS file, o_custkey AS session_id, (epoch_us(o_orderdate) // 1000) AS mtime FROM orders),
g AS (SELECT * FROM c WHERE file NOT IN (SELECT file FROM d) AND session_id NOT IN (SELECT session_id FROM d) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY mtime DESC, file) = 1)
SELECT file, session_id, mtime, false AS archived FROM d UNION ALL SELECT file, session_id, mtime, true FROM g""")
def archive_merge(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("session_id"), millis("o_orderdate").alias("mtime"))
    return sessions.archive_merge(c.where("file % 2 = 0 and session_id % 3 = 0"), c)


# the shapes that documents hold, written out for the other engine
_HOMES = r"regexp_replace(regexp_replace(regexp_replace(t, '/(Users|home)/([^/\s]+)', '/\1/[redacted]', 'g'), '(-Users-)([^-\s/]+)([-/\s]|$)', '\1[redacted]\3', 'g'), '(-home-)([^-\s/]+)([-/\s]|$)', '\1[redacted]\3', 'g')"
_KEYS = r"regexp_replace(regexp_replace(regexp_replace({0}, 'eyJ[\w-]+[.][\w-]+[.][\w-]+', '[REDACTED:jwt]', 'g'), 'sk-[\w-]{{20,}}', '[REDACTED:openai-key]', 'g'), 'AKIA[0-9A-Z]{{16}}', '[REDACTED:aws-key]', 'g')".format(_HOMES)


@query(f"WITH d AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5({_KEYS}) AS digest, {_KEYS} <> t AS changed FROM d")
def redact_paths_secrets(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").withColumn("safe", text.redact(F.col("text")))
    return d.select("doc_id", F.md5("safe").alias("digest"), (F.col("safe") != F.col("text")).alias("changed"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.none') IS NULL AS absent FROM events")
def json_field_mapping(spark, sf):
    v = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none", "bigint").isNull().alias("absent"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def event_resume_page(spark, sf):
    return table(spark, sf, "events").where("event_id > 500").select("event_id", "user_id", "event_type").orderBy("event_id").limit(200)


@query("SELECT event_id, user_id FROM events")
def event_dedup(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return e.union(e.where("event_id % 3 = 0")).dropDuplicates(["event_id"])


@query(f"SELECT user_id AS run_id, (epoch_us(max(ts)) // 1000) AS last_event_at, {NOW_MS} - (epoch_us(max(ts)) // 1000) > 600000 AS timed_out FROM events GROUP BY user_id")
def stale_runs(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("ts"))
    return g.select("run_id", millis("ts").alias("last_event_at"), (F.lit(NOW_MS) - millis("ts") > 600_000).alias("timed_out"))


@query(f"WITH s AS ({SESS}) SELECT session_id, until FROM s WHERE until < 1705622400000 OR (until = 1705622400000 AND session_id > '5-2024-01-18') ORDER BY until DESC, session_id LIMIT 160")
def keyset_page(spark, sf):
    return sessions.page_after(sess(spark, sf), 1_705_622_400_000, "5-2024-01-18", 160).select("session_id", "until")


@query(f"WITH s AS ({SESS}) SELECT session_id, greatest(0, {NOW_MS} - until) AS stale_ms, greatest(0, {NOW_MS} - until) > 43200000 AS is_stale FROM s WHERE tool_errors > 0 OR 100 - 10 * n_events < 70 OR greatest(0, {NOW_MS} - until) > 43200000")
def session_attention(spark, sf):
    return sessions.attention(sess(spark, sf).withColumn("quality", 100 - 10 * F.col("n_events")), NOW_MS).select("session_id", "stale_ms", "is_stale")


@query(f"SELECT user_id AS key, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, coalesce((epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) // 1000) > 21600000, true) AS fresh FROM events)) GROUP BY ALL")
def extension_gap_sessions(spark, sf):
    """An extension: sessions by a gap of six hours."""
    w = Window.partitionBy("user_id").orderBy("ts")
    fresh = F.coalesce(millis("ts") - F.lag(millis("ts")).over(w) > 21_600_000, F.lit(True))
    e = table(spark, sf, "events").withColumn("fresh", fresh.cast("int")).withColumn("session", F.sum("fresh").over(w))
    return e.groupBy(F.col("user_id").alias("key"), "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
