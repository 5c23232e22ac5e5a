"""Evaluation runs: status counts, pass@k, telemetry, leaderboard, run diff, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import stats


def status_counts(cases: DataFrame, *by: str) -> DataFrame:
    """Counts by status and the pass rate over all cases, stranded ones (not terminal) included."""
    done = ("passed", "failed", "error", "skipped")
    count = lambda s: F.count_if(F.col("status") == s)
    out = cases.groupBy(*by).agg(
        F.count("*").alias("total"), count("passed").alias("passed"), count("failed").alias("failed"), count("error").alias("errored"), count("skipped").alias("skipped"),
        F.count_if(~F.col("status").isin(*done)).alias("stranded"),
    )
    return out.withColumn("pass_rate", F.round(stats.rate(F.col("passed"), F.col("total")), 6))


def cost_by_provenance(cases: DataFrame) -> DataFrame:
    """Cost and cases by how the cost is known; a missing cost adds none."""
    return cases.groupBy("provenance").agg(F.count("*").alias("cases"), F.round(F.sum(F.when(F.col("provenance") == "missing", 0.0).otherwise(F.col("cost"))), 2).alias("cost"))


def pass_at_k(cases: DataFrame) -> DataFrame:
    """Per run the means over its cases of pass@1, pass@k (k: most samples of a case) and all-pass, with Wilson bounds."""
    by_case = cases.groupBy("run_id", "case_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "passed").alias("c"))
    k = cases.groupBy("run_id").agg((F.max("sample") + 1).cast("long").alias("k"))
    each = by_case.join(k, "run_id").withColumn("p1", stats.pass_at_k(F.col("n"), F.col("c"), F.lit(1))).withColumn("pk", stats.pass_at_k(F.col("n"), F.col("c"), F.col("k")))
    out = each.groupBy("run_id").agg(F.count("*").alias("cases"), F.max("k").alias("k"), F.avg("p1").alias("p1"), F.avg("pk").alias("pk"), F.avg((F.col("c") == F.col("n")).cast("double")).alias("all_pass"))
    lo, hi = stats.wilson(F.round(F.round(F.col("p1") * F.col("cases"), 9)), F.col("cases"))
    return out.select("run_id", "cases", "k", F.round("p1", 6).alias("pass_at_1"), F.round("pk", 6).alias("pass_at_k"), F.round("all_pass", 6).alias("all_pass"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def telemetry(cases: DataFrame) -> DataFrame:
    """Per run: nearest-rank percentiles of the cost, its total, error and fail rates, cheapest pass."""
    return cases.groupBy("run_id").agg(
        stats.nearest_rank("cost", 0.5).alias("p50"), stats.nearest_rank("cost", 0.95).alias("p95"), F.max("cost").alias("most"), F.round(F.sum("cost"), 2).alias("cost"),
        F.round(F.avg((F.col("status") == "error").cast("double")), 6).alias("error_rate"), F.round(F.avg((F.col("status") == "failed").cast("double")), 6).alias("fail_rate"),
        F.min(F.when(F.col("status") == "passed", F.col("cost"))).alias("cheapest_pass"),
    )


def leaderboard(cases: DataFrame) -> DataFrame:
    """Per harness: runs, terminal cases that were not skipped, pass rate; cost of all cases."""
    counted = F.col("status").isin("passed", "failed", "error")
    out = cases.groupBy("harness").agg(F.count_distinct("run_id").alias("runs"), F.count_if(counted).alias("cases"), F.count_if(F.col("status") == "passed").alias("passed"), F.round(F.sum("cost"), 2).alias("cost"))
    return out.withColumn("pass_rate", F.round(stats.rate(F.col("passed"), F.col("cases")), 6)).orderBy(F.desc("pass_rate"), F.desc("runs"), "harness")


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two runs by case and sample; the second describes."""
    cols = ["case_id", "sample", "status", "cost", "difficulty"]
    x, y = (d.select(*(F.col(c).alias(f"{s}_{c}" if c not in ("case_id", "sample") else c) for c in cols)) for d, s in ((a, "a"), (b, "b")))
    j = x.join(y, ["case_id", "sample"], "full_outer")
    change = F.when(F.col("a_status").isNull(), "added").when(F.col("b_status").isNull(), "removed").when(F.col("a_status") == F.col("b_status"), "same").when(F.col("b_status") == "passed", "fixed").when(F.col("a_status") == "passed", "regressed").otherwise("changed")
    return j.select("case_id", F.col("sample").cast("long").alias("sample"), "a_status", "b_status", F.coalesce("b_difficulty", "a_difficulty").alias("difficulty"), change.alias("change"), F.round(F.col("b_cost") - F.col("a_cost"), 2).alias("cost_delta"))


def weighted_grades(results: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Per case the weighted share of passed graders (1 without weight); a failed forbidden grader fails the case."""
    out = results.groupBy("case_id").agg(
        F.sum(F.col("weight") * F.col("passed").cast("double")).alias("got"), F.sum("weight").alias("all"), F.bool_or(F.col("forbidden") & ~F.col("passed")).alias("broke")
    )
    ratio = F.when(F.col("all") > 0, F.col("got") / F.col("all")).otherwise(1.0)
    return out.select("case_id", F.round(ratio, 6).alias("pass_ratio"), ((ratio >= threshold) & ~F.col("broke")).alias("passed"))


def files_unchanged(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Full outer join by path of content hashes: added, removed, changed or same."""
    h = lambda d, n: d.select("path", F.sha2(F.col("content").cast("string"), 256).alias(n))
    j = h(now, "new").join(h(baseline, "old"), "path", "full_outer")
    return j.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed").alias("state"))


def step_checks(calls: DataFrame, tool: str, at_least: int) -> DataFrame:
    """calls: file, pos, tool. Per file: number of calls of the tool, place of its first among the calls, whether there are enough."""
    w = Window.partitionBy("file").orderBy("pos", "tool")
    mine = F.col("tool") == tool
    placed = calls.withColumn("place", F.row_number().over(w))
    return placed.groupBy("file").agg(F.count_if(mine).alias("n"), F.coalesce(F.min(F.when(mine, F.col("place"))), F.lit(0)).cast("long").alias("first"), (F.count_if(mine) >= at_least).alias("passed"))


def tool_durations(calls: DataFrame, most: int | None = None) -> DataFrame:
    """Per file and tool: calls, floor-index percentiles and the longest; with is_error also errors. most: tools with most calls."""
    # all figures are windows over one sort, without a table of groups; only the first holds a whole group, it hands on at most three of its rows
    by = Window.partitionBy("file", "tool")
    w = by.orderBy("duration")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_all = [F.count("*").over(whole).alias("n"), F.max("duration").over(whole).alias("longest"), *([F.count_if("is_error").over(whole).alias("errors")] if "is_error" in calls.columns else [])]
    x = calls.select("file", "tool", "duration", (F.row_number().over(w) - 1).alias("i"), *of_all)
    here = lambda p: F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    at = lambda p: F.max(F.when(here(p), F.col("duration"))).over(by)
    few = x.where((F.col("i") == 0) | here(0.5) | here(0.95))
    out = few.select("file", "tool", "i", "n", at(0.5).alias("p50"), at(0.95).alias("p95"), *x.columns[5:]).where("i = 0").drop("i")
    if most is None:
        return out
    return out.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "tool"))).where(F.col("r") <= most).drop("r")


def top_tools(counts: DataFrame, k: int) -> DataFrame:
    """Sum of per-file maps tool -> calls, the k most called; ties by name."""
    return counts.select(F.explode("counts").alias("tool", "n")).groupBy("tool").agg(F.sum("n").alias("calls")).orderBy(F.desc("calls"), "tool").limit(k)


def run_telemetry(cases: DataFrame) -> DataFrame:
    """Per run: nearest-rank percentiles of the duration, tokens a second (of all and of the fastest), cache hits, errors apart from failures, the cheapest pass."""
    cached = F.sum("cached")
    return cases.groupBy("run_id").agg(
        stats.nearest_rank("duration", 0.5).alias("p50"), stats.nearest_rank("duration", 0.95).alias("p95"), stats.rate(F.sum("tokens"), F.sum("duration")).alias("tokens_per_s"), F.max(stats.rate(F.col("tokens"), F.col("duration"))).alias("fastest"),
        F.round(stats.rate(cached, cached + F.sum("fresh")), 6).alias("cache_hit"), F.round(F.avg((F.col("status") == "error").cast("double")), 6).alias("error_rate"), F.round(F.avg((F.col("status") == "failed").cast("double")), 6).alias("fail_rate"),
        F.min(F.when(F.col("status") == "passed", F.col("cost"))).alias("cheapest_pass"),
    )


def case_telemetry(cases: DataFrame) -> DataFrame:
    """Per case its rate and what its figures lack."""
    lacks = F.array_compact(F.array(F.when(F.coalesce("duration", F.lit(0)) == 0, "no duration"), F.when(F.col("cost").isNull(), "cost missing"), F.when(F.coalesce("tool_calls", F.lit(0)) == 0, "no tool calls")))
    return cases.select("case_id", stats.rate(F.col("tokens"), F.col("duration")).alias("rate"), F.array_join(lacks, "; ").alias("warnings"))
