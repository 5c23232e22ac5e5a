"""Queries on graders, trust and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import grading, pricing
from quarry.operators import trust
from quarry.plans.registry import query
from quarry.plans.views import table

# --- graders over collected evidence: orders as cases

_RAN = """SELECT o_orderkey AS case_id, CAST(o_orderkey % 3 AS INT) AS code, CAST(o_custkey % 5 AS VARCHAR) || ' passed, ' || CAST(o_custkey % 2 AS VARCHAR) || ' failed' AS output, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority || chr(10) || o_orderstatus END AS content,
 '{"a": {"b": [' || CAST(o_orderkey % 5 AS VARCHAR) || ']}, "s": "' || o_orderstatus || '"}' AS doc, o_orderkey % 6 = 0 AS failed FROM orders"""


def _ran(spark, sf):
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    return table(spark, sf, "orders").select(
        k.alias("case_id"), (k % 3).cast("int").alias("code"), F.concat(text(F.col("o_custkey") % 5), F.lit(" passed, "), text(F.col("o_custkey") % 2), F.lit(" failed")).alias("output"), F.when(k % 4 != 0, F.concat("o_orderpriority", F.lit("\n"), "o_orderstatus")).alias("content"),
        F.concat(F.lit('{"a": {"b": ['), text(k % 5), F.lit(']}, "s": "'), F.col("o_orderstatus"), F.lit('"}')).alias("doc"), (k % 6 == 0).alias("failed"),
    )


@query(f"""WITH r AS ({_RAN}) SELECT case_id, code = 0 AS exit_code, code = 0 AND output LIKE '%, 0 failed' AND CAST(left(output, 1) AS INT) >= 2 AS tests_pass, coalesce(split_part(content, chr(10), 2) = 'O', false) AS file_contains,
 content IS NOT NULL AND split_part(content, chr(10), 2) <> 'O' AS file_lacks, false AS bad_pattern, content IS NOT NULL AS file_exists, content IS NULL AS file_deleted, coalesce(content = '5-LOW' || chr(10) || 'O', false) AS file_eq,
 case_id % 5 = 2 AS json_path, doc LIKE '%"s": "F"%' AS json_text, coalesce(content IS NOT NULL AND case_id % 2 = 0, false) AS checksum,
 CASE WHEN failed THEN false ELSE coalesce(split_part(content, chr(10), 2) = 'O', false) END AS regex_match, true AS manual_fails FROM r""")
def grader_checks(spark, sf):
    r, c = _ran(spark, sf), F.col("content")
    bad = grading.contains(c, "(open") if grading.valid_pattern(spark, "(open") else F.lit(False)
    expected = F.when(F.col("case_id") % 2 == 0, F.sha2(c, 256)).otherwise(F.lit("0"))
    return r.select(
        "case_id", grading.exit_code(F.col("code")).alias("exit_code"), grading.tests_pass(F.col("code"), F.col("output"), 2).alias("tests_pass"), grading.contains(c, "^O$").alias("file_contains"), grading.contains(c, "^O$", negate=True).alias("file_lacks"),
        bad.alias("bad_pattern"), grading.exists(c).alias("file_exists"), grading.exists(c, negate=True).alias("file_deleted"), grading.equals(c, " 5-LOW\nO\n", trim=True).alias("file_eq"), grading.json_path(F.col("doc"), "a.b[0]", "2").alias("json_path"),
        grading.json_path(F.col("doc"), "s", '"F"').alias("json_text"), grading.checksum(c, expected).alias("checksum"), grading.regex_match(F.lit(""), c, F.lit(""), F.col("failed"), "^O$").alias("regex_match"), (grading.evidence_tier(F.lit("manual")) == "manual").alias("manual_fails"),
    )


@query("""WITH c AS (SELECT l_orderkey AS file, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_linestatus) AS t, list(l_linestatus ORDER BY l_linenumber, l_returnflag, l_linestatus) AS s FROM lineitem GROUP BY ALL)
SELECT file, len(list_filter(t, lambda x: x = 'R')) >= 2 AS enough, NOT list_contains(t, 'A') AS none, coalesce(t[2] = 'N', false) AS at_place,
 list_position(t, 'N') IS NOT NULL AND list_position(t, 'N') > 0 AND (coalesce(list_position(t, 'R'), 0) = 0 OR list_position(t, 'N') < list_position(t, 'R')) AS before_it, len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'N' AND (s[i] LIKE '%O%' OR s[i] LIKE '%X%'))) >= 1 AS with_input FROM c""")
def step_graders(spark, sf):
    """The calls of a file are one row's array: their number is that of an agent's steps."""
    calls = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("input")))), lambda x: F.struct(x["name"].alias("name"), x["input"].alias("input"))).alias("calls"))
    c = F.col("calls")
    return calls.select("file", grading.step(c, "R", least=2).alias("enough"), grading.step(c, "A", negate=True).alias("none"), grading.step(c, "N", at_index=1).alias("at_place"), grading.step(c, "N", before_tool="R").alias("before_it"), grading.step(c, "N", includes_any=["O", "X"]).alias("with_input"))


@query("""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'failed' WHEN o_custkey % 4 = 0 OR o_custkey % 11 = 0 THEN 'error' WHEN o_custkey % 2 = 1 THEN 'passed' ELSE 'failed' END AS status FROM orders""")
def final_statuses(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(k.alias("case_id"), grading.final_status(k % 7 == 0, k % 5 == 0, k % 3 == 0, c % 4 == 0, c % 11 == 0, c % 2 == 1).alias("status"))


# --- trust: parts as cases, their graders and results

_KINDS = ["exit_code", "regex_match", "step", "rubric_llm", "files_unchanged", "manual", "file_exists"]
_GRADERS = f"""SELECT p_partkey AS case_id, i, {_KINDS}[CAST((p_partkey + i * i) % 7 AS INT) + 1] AS kind, (p_partkey + i) % 2 = 0 AS negate, (p_partkey * 3 + i) % 4 <> 0 AS passed FROM part, range(1, 4) t(i) WHERE i <= p_partkey % 4"""
_TIER = "CASE WHEN kind IN ('exit_code', 'regex_match', 'files_unchanged', 'file_exists') THEN 'deterministic' WHEN kind = 'step' THEN 'trace' WHEN kind = 'rubric_llm' THEN 'llm_judge' ELSE 'manual' END"
_CASES = """SELECT p_partkey AS case_id, p_size % 10 AS run_id, p_partkey % 3 <> 0 AS has_oracle, p_partkey % 5 <> 0 AS has_known_bad, p_partkey % 2 = 0 AS has_budget, CASE WHEN p_partkey % 6 = 0 THEN p_partkey % 4 END AS declared_visual, p_partkey % 12 = 0 AS needs_vision, p_partkey % 8 = 0 AS noop_guard,
 CASE WHEN p_partkey % 3 = 1 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 5 / 4 END AS pass_ratio FROM part"""


def _graders(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("case_id")).withColumn("i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("i <= case_id % 4")
    k, i = F.col("case_id"), F.col("i")
    return p.select("case_id", "i", F.element_at(F.array(*map(F.lit, _KINDS)), ((k + i * i) % 7 + 1).cast("int")).alias("kind"), ((k + i) % 2 == 0).alias("negate"), ((k * 3 + i) % 4 != 0).alias("passed"))


def _cases(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("case_id"), (F.col("p_size") % 10).alias("run_id"), (k % 3 != 0).alias("has_oracle"), (k % 5 != 0).alias("has_known_bad"), (k % 2 == 0).alias("has_budget"), F.when(k % 6 == 0, k % 4).alias("declared_visual"), (k % 12 == 0).alias("needs_vision"), (k % 8 == 0).alias("noop_guard"),
        F.when(k % 3 == 1, "passed").otherwise("failed").alias("status"), F.when(k % 7 != 0, k % 5 / 4).alias("pass_ratio"),
    )


@query(f"""WITH g AS (SELECT *, {_TIER} AS tier FROM ({_GRADERS})) SELECT case_id, tier, count(*) AS total, count(*) FILTER (passed) AS passed FROM g GROUP BY ALL""")
def evidence_by_tier(spark, sf):
    e = trust.evidence(_graders(spark, sf))
    tiers = F.array(*(F.struct(F.lit(t).alias("tier"), F.col(t).alias("total"), F.col(f"{t}_passed").alias("passed")) for t in trust.TIERS))
    return e.select("case_id", F.inline(tiers)).where("total > 0")


_AUDIT = f"""g AS (SELECT *, {_TIER} AS tier, kind = 'files_unchanged' OR (kind IN ('file_exists', 'regex_match', 'step') AND negate) AS idle FROM ({_GRADERS})),
n AS (SELECT case_id, count(*) FILTER (tier = 'deterministic') AS det, count(*) FILTER (tier = 'trace') AS tra, count(*) FILTER (tier = 'llm_judge') AS llm, count(*) FILTER (tier = 'manual') AS man, bool_and(idle) FILTER (tier = 'deterministic') AS all_idle, bool_and(kind = 'regex_match') FILTER (tier = 'deterministic') AS all_regex,
 count(*) FILTER (tier = 'deterministic' AND passed) AS det_ok, count(*) FILTER (tier = 'trace' AND passed) AS tra_ok FROM g GROUP BY case_id),
j AS (SELECT c.*, coalesce(det, 0) AS det, coalesce(tra, 0) AS tra, coalesce(llm, 0) AS llm, coalesce(man, 0) AS man, coalesce(det_ok, 0) AS det_ok, coalesce(tra_ok, 0) AS tra_ok, all_idle, all_regex FROM ({_CASES}) c LEFT JOIN n USING (case_id)),
a AS (SELECT *, list_filter([CASE WHEN NOT has_oracle THEN 'missing oracle solve script' END, CASE WHEN NOT has_known_bad THEN 'no known-bad rejection script' END, CASE WHEN det + tra = 0 THEN 'no deterministic or trace grader' END, CASE WHEN llm > 0 AND det = 0 THEN 'LLM judge without deterministic backstop' END,
 CASE WHEN needs_vision AND coalesce(declared_visual, 0) = 0 THEN 'vision-input task has no visual artifact contract' END, CASE WHEN det > 0 AND all_idle AND NOT noop_guard THEN 'deterministic graders all pass on a no-op run; no oracle.noop_max_score guard' END,
 CASE WHEN llm > 0 AND det > 0 AND all_regex THEN 'rubric_llm backstop is only regex_match graders (weak deterministic teeth)' END], lambda x: x IS NOT NULL) AS weak FROM j)"""


def _audited(spark, sf):
    return trust.audit(_cases(spark, sf).withColumnRenamed("declared_visual", "visual"), _graders(spark, sf))


@query(f"WITH {_AUDIT} SELECT case_id, det AS deterministic, tra AS trace, llm AS llm_judge, man AS manual, array_to_string(weak, '; ') AS weaknesses FROM a")
def case_audit(spark, sf):
    return _audited(spark, sf).select("case_id", "deterministic", "trace", "llm_judge", "manual", F.array_join("weaknesses", "; ").alias("weaknesses"))


@query(f"""WITH {_AUDIT} SELECT count(*) AS cases, count(*) FILTER (has_oracle) AS oracle, count(*) FILTER (has_known_bad) AS known_bad, count(*) FILTER (det + tra > 0) AS proven, count(*) FILTER (len(weak) > 0) AS weak, CAST(sum(det) AS BIGINT) AS deterministic_graders,
 CAST(sum(tra) AS BIGINT) AS trace_graders, CAST(sum(llm) AS BIGINT) AS llm_judge_graders, CAST(sum(man) AS BIGINT) AS manual_graders FROM a""")
def audit_totals(spark, sf):
    return trust.audit_totals(_audited(spark, sf))


_TRUST = f"""{_AUDIT}, w AS (SELECT *, declared_visual IS NULL OR declared_visual > 0 AS shown, list_filter([CASE WHEN NOT has_oracle THEN 'missing oracle' END, CASE WHEN NOT has_known_bad THEN 'no known-bad' END, CASE WHEN det + tra = 0 THEN 'no deterministic/trace proof' END,
 CASE WHEN llm > 0 AND det = 0 THEN 'LLM judge lacks backstop' END, CASE WHEN NOT has_budget THEN 'no budget' END, CASE WHEN declared_visual = 0 THEN 'visual has no artifacts' END, CASE WHEN man > 0 THEN 'manual grader' END], lambda x: x IS NOT NULL) AS weaknesses FROM a),
t AS (SELECT *, CAST(greatest(0, least(100, floor(coalesce(pass_ratio, CASE WHEN status = 'passed' THEN 1.0 ELSE 0.0 END) * 35 + CASE WHEN det + tra > 0 THEN (det_ok + tra_ok) / (det + tra) ELSE 0.0 END * 20 + CASE WHEN has_oracle THEN 15 ELSE 0 END + CASE WHEN has_known_bad THEN 15 ELSE 0 END
 + CASE WHEN has_budget THEN 8 ELSE 0 END + CASE WHEN shown THEN 7 ELSE 0 END - greatest(0, len(weaknesses) - 1) * 5 + 0.5))) AS BIGINT) AS score FROM w)"""
_GRADE = "CASE WHEN score >= 90 THEN 'High confidence' WHEN score >= 75 THEN 'Solid confidence' WHEN score >= 60 THEN 'Needs review' ELSE 'Weak proof' END AS grade"


def _trusted(spark, sf):
    return trust.case_trust(_cases(spark, sf), trust.evidence(_graders(spark, sf)))


@query(f"WITH {_TRUST} SELECT case_id, score, {_GRADE}, array_to_string(weaknesses, '; ') AS weaknesses FROM t")
def case_trust(spark, sf):
    return _trusted(spark, sf).select("case_id", "score", "grade", F.array_join("weaknesses", "; ").alias("weaknesses"))


@query(f"""WITH {_TRUST}, q AS (SELECT run_id, count(*) AS cases, count(*) FILTER (len(weaknesses) > 0) AS weak, CAST(greatest(0, least(100, floor(avg(CAST(status = 'passed' AS INT)) * 30 + avg(score) * 0.35 + floor(100 * avg(CAST(det + tra > 0 AS INT)) + 0.5) * 0.15 + floor(100 * avg(CAST(has_known_bad AS INT)) + 0.5) * 0.1
 + floor(100 * avg(CAST(has_oracle AS INT)) + 0.5) * 0.05 + CASE WHEN count(declared_visual) > 0 THEN floor(100.0 * count(*) FILTER (shown) / count(declared_visual) + 0.5) ELSE 100 END * 0.05 + 0.5))) AS BIGINT) AS score FROM t GROUP BY run_id) SELECT run_id, cases, weak, score, {_GRADE} FROM q""")
def run_confidence(spark, sf):
    return trust.run_confidence(_trusted(spark, sf)).select("run_id", "cases", "weak", "score", "grade")


@query(f"WITH {_TRUST}, q AS (SELECT run_id, unnest(weaknesses) AS weakness FROM t) SELECT * FROM (SELECT run_id, weakness, count(*) AS count FROM q GROUP BY run_id, weakness) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY count DESC, weakness) <= 5")
def run_weaknesses(spark, sf):
    return trust.top_weaknesses(_trusted(spark, sf))


# --- costs: lines as the usage of models in sessions

_NAMES = ["alpha-large", "VEND/beta-mini", "beta-mini-20240101", "gamma local", "<synthetic>", "/data/models/hf/Org__Delta-1"]
_CATALOGUE = [("alpha-large", "vend/alpha-large", 5.0, 25.0, 0.5, 6.25), ("vend/alpha-large", "vend/alpha-large", 5.0, 25.0, 0.5, 6.25), ("beta-mini", "vend/beta-mini", 1.0, 5.0, 0.1, 1.25), ("vend/beta-mini", "vend/beta-mini", 1.0, 5.0, 0.1, 1.25)]
_FAMILIES = [("is", "nothing", "vend/alpha-large"), ("starts", "beta-mini-", "vend/beta-mini"), ("holds", "delta", "vend/alpha-large")]
_USAGE = f"""SELECT l_orderkey AS session, min(l_linenumber) AS place, {_NAMES}[CAST(l_suppkey % 6 AS INT) + 1] AS model, CAST(sum(l_quantity) * 100 AS BIGINT) AS input, CAST(sum(l_quantity) * 10 AS BIGINT) AS output, CAST(sum(l_linenumber) AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_write,
 count(*) AS calls, count(*) FILTER (l_discount > 0.08) AS errors FROM lineitem GROUP BY l_orderkey, l_suppkey % 6"""
_RATES = """r(model, confidence, source_model, ri, ro, rc, rw) AS (VALUES ('alpha-large', 'listed', 'vend/alpha-large', 5.0, 25.0, 0.5, 6.25), ('VEND/beta-mini', 'listed', 'vend/beta-mini', 1.0, 5.0, 0.1, 1.25), ('beta-mini-20240101', 'family', 'vend/beta-mini', 1.0, 5.0, 0.1, 1.25),
 ('gamma local', 'fallback', 'fallback', 1.0, 3.0, 0.1, 1.25), ('<synthetic>', NULL, NULL, NULL, NULL, NULL, NULL), ('/data/models/hf/Org__Delta-1', 'family', 'vend/alpha-large', 5.0, 25.0, 0.5, 6.25))"""
_COST = "CASE WHEN ri IS NOT NULL AND input + output + cache_read > 0 THEN (input * CAST(ri AS DOUBLE) + output * CAST(ro AS DOUBLE) + cache_read * CAST(rc AS DOUBLE)) / 1000000 END"


def _usage(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("m", (F.col("l_suppkey") % 6 + 1).cast("int"))
    g = line.groupBy(F.col("l_orderkey").alias("session"), "m").agg(F.min("l_linenumber").alias("place"), (F.sum("l_quantity") * 100).cast("long").alias("input"), (F.sum("l_quantity") * 10).cast("long").alias("output"), F.sum("l_linenumber").cast("long").alias("cache_read"), F.count("*").alias("calls"), F.count_if(F.col("l_discount") > 0.08).alias("errors"))
    return g.select("session", "place", F.element_at(F.array(*map(F.lit, _NAMES)), F.col("m")).alias("model"), "input", "output", "cache_read", F.lit(0).cast("long").alias("cache_write"), "calls", "errors")


def _catalogue(spark):
    return spark.createDataFrame(_CATALOGUE, "alias string, source_model string, input double, output double, cache_read double, cache_write double")


def _priced(spark):
    return pricing.rates(spark.createDataFrame([(n,) for n in _NAMES], "model string"), _catalogue(spark), _FAMILIES)


@query(f"WITH {_RATES}, u AS ({_USAGE}), c AS (SELECT u.*, {_COST} AS cost FROM u JOIN r USING (model)) SELECT session, round(CASE WHEN NOT bool_or(cost IS NULL) THEN sum(cost) END, 9) AS cost FROM c GROUP BY session")
def mixed_model_cost(spark, sf):
    return pricing.mixed_cost(pricing.estimate(_usage(spark, sf), _priced(spark))).select("session", F.round("cost", 9).alias("cost"))


_FIELDS = ("input", "output", "cache_read", "cache_write", "calls", "errors")
_SESSIONS = f"""s AS (SELECT session, arg_max(model, input) AS model, {", ".join(f"CAST(sum({f}) AS BIGINT) + {'CASE WHEN session % 3 = 0 THEN 50 WHEN session % 7 = 1 THEN -1 ELSE 0 END' if f == 'input' else '0'} AS {f}" for f in _FIELDS)} FROM (SELECT * FROM u ORDER BY session, place) GROUP BY session),
p AS (SELECT session, model AS own FROM u QUALIFY row_number() OVER (PARTITION BY session ORDER BY input DESC, place, model DESC) = 1)"""


def _totals(spark, sf):
    u = _usage(spark, sf)
    g = u.groupBy("session").agg(F.max_by("model", F.struct("input", -F.col("place"), "model")).alias("model"), *(F.sum(f).alias(f) for f in _FIELDS))
    return g.withColumn("input", F.col("input") + F.when(F.col("session") % 3 == 0, 50).when(F.col("session") % 7 == 1, -1).otherwise(0))


_ATTRIBUTED = f"""u AS ({_USAGE}), {_SESSIONS}, att AS (SELECT s.session, 0 AS place, own AS model, {", ".join("s." + f for f in _FIELDS)} FROM s JOIN p USING (session) WHERE s.session % 3 <> 0 AND s.session % 7 = 1
 UNION ALL SELECT u.session, u.place, u.model, u.input + CASE WHEN u.session % 3 = 0 AND u.model = own THEN 50 ELSE 0 END, {", ".join("u." + f for f in _FIELDS[1:])} FROM u JOIN p USING (session) WHERE u.session % 3 = 0 OR u.session % 7 <> 1)"""


@query(f"WITH {_ATTRIBUTED} SELECT session, CAST(place AS BIGINT) AS place, model, {', '.join(_FIELDS)} FROM att")
def attributed_usage(spark, sf):
    return pricing.attributed(_totals(spark, sf), _usage(spark, sf)).select("session", "place", "model", *_FIELDS)


@query(f"""WITH {_RATES}, {_ATTRIBUTED}, e AS (SELECT att.*, coalesce({_COST}, 0.0) AS guess, CASE WHEN session % 5 = 0 THEN 0.0 ELSE o_totalprice END AS spent FROM att JOIN r USING (model) JOIN orders ON o_orderkey = session)
SELECT session, model, round(CASE WHEN spent <= 0 THEN 0.0 WHEN sum(guess) OVER w > 0 THEN spent * guess / sum(guess) OVER w ELSE spent * (input + output + cache_read) / sum(input + output + cache_read) OVER w END, 4) AS share FROM e WINDOW w AS (PARTITION BY session)""")
def model_cost_shares(spark, sf):
    rows = pricing.estimate(pricing.attributed(_totals(spark, sf), _usage(spark, sf)), _priced(spark))
    spent = table(spark, sf, "orders").select(F.col("o_orderkey").alias("session"), F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("cost"))
    return pricing.shared_costs(rows, spent).select("session", "model", F.round("share", 4).alias("share"))


@query("""SELECT o_orderkey AS session, round(CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 3 THEN o_totalprice WHEN 1 THEN coalesce(CASE WHEN o_custkey % 3 <> 0 THEN 2.5 END, 0.0) ELSE coalesce(CASE WHEN o_custkey % 3 <> 0 THEN 2.5 END, 0.0) END, 2) AS cost,
 CASE o_orderkey % 4 WHEN 0 THEN 'measured' WHEN 3 THEN 'malformed' ELSE CASE WHEN o_custkey % 3 <> 0 THEN 'inferred' ELSE 'missing' END END AS source FROM orders""")
def refreshed_costs(spark, sf):
    k = F.col("o_orderkey") % 4
    source = F.when(k == 0, "measured").when(k == 1, "inferred").when(k == 2, "missing").otherwise("malformed")
    cost, new = pricing.refreshed(F.col("o_totalprice"), source, F.when(F.col("o_custkey") % 3 != 0, 2.5))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("session"), F.round(cost, 2).alias("cost"), new.alias("source"))
