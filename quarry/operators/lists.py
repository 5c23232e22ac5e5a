"""Filters, orders and groups of the lists that people look at: cases, sessions, runs, turns, audits, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.positions import positions

STALE_MS = 12 * 3_600_000
MISSING = ("missing", "malformed")


def select_cases(cases: DataFrame, ids: list | None = None, categories: list[str] | None = None, tags: list[str] | None = None, difficulties: list[str] | None = None) -> DataFrame:
    """Cases that fit all lists given; one of a list is enough; an empty list asks for nothing; no difficulty fits none."""
    for column, wanted in (("case_id", ids), ("category", categories), ("difficulty", difficulties)):
        if wanted:
            cases = cases.where(F.col(column).isin(*wanted))
    return cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else cases


def holds(text: str, *columns: Column) -> Column:
    """Whether one of the columns (text or arrays of it) holds the text, whatever its case; an empty text fits all."""
    if not text:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return out


def any_holds(text: str, values: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.lower(v).contains(text.lower())), F.lit(False))


def needs_attention() -> Column:
    return F.col("is_error") | (F.col("tool_errors") > 0) | (F.col("hook_errors") > 0) | (F.col("quality") < 70) | (F.col("malformed") > 0)


def sessions_where(sessions: DataFrame, what: str, now: int, text: str = "") -> DataFrame:
    """what: all, attention, stale (12 hours), or missing (a source of sources is missing or malformed)."""
    stale = F.greatest(F.lit(0), F.lit(now) - F.col("last_event_at")) > STALE_MS
    cond = {"all": F.lit(True), "attention": needs_attention(), "stale": stale, "missing": F.exists("sources", lambda s: s.isin(*MISSING))}[what]
    return sessions.where(cond & holds(text, F.col("session_id"), F.col("project"), F.col("model")))


def turns_where(turns: DataFrame, what: str, text: str = "") -> DataFrame:
    """what: all, chat (users and assistants), tools (tool turns and errors), errors."""
    cond = {"all": F.lit(True), "chat": F.col("role").isin("user", "assistant"), "tools": (F.col("role") == "tool") | (F.col("severity") == "error"), "errors": F.col("severity") == "error"}[what]
    return turns.where(cond & holds(text, F.col("text")))


def turn_counts(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count("*").alias("turns"), F.count_if(F.col("role").isin("user", "assistant")).alias("chat"), F.count_if((F.col("role") == "tool") | (F.col("severity") == "error")).alias("tools"), F.count_if(F.col("severity") == "error").alias("errors"))


def runs_where(runs: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """status: one of the runs' own, or passes (runs with a passed case)."""
    cond = F.lit(True) if not status else F.col("passed") > 0 if status == "passes" else F.col("status") == status
    return runs.where(cond & holds(text, F.col("name"), F.col("run_id").cast("string"), F.col("harness")))


def ordered(rows: DataFrame, how: str, tie: str) -> DataFrame:
    """Rows in one of the orders of lists; nulls count as 0; ties by the column tie."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    by = {
        "recent": lambda: [F.desc("last_event_at")], "tokens": lambda: [zero("tokens").desc()], "duration": lambda: [zero("duration_ms").desc()], "tools": lambda: [zero("tool_calls").desc(), zero("tool_errors").desc()],
        "quality": lambda: [zero("quality").asc(), F.desc("last_event_at")], "errors": lambda: [zero("tool_errors").desc(), F.desc("last_event_at")],
        "newest": lambda: [F.desc("created_at")], "oldest": lambda: [F.asc("created_at")], "pass_asc": lambda: [zero("pass_rate").asc()], "pass_desc": lambda: [zero("pass_rate").desc()],
        "weakest": lambda: [zero("weak").desc()], "name": lambda: [F.lower("name").asc()],
    }[how]()
    return rows.orderBy(*by, tie)


def lite(rows: DataFrame, limits: dict[str, int], drop: list[str]) -> DataFrame:
    """Heavy texts cut to their limits and columns left out, for lists."""
    return rows.select(*(F.substring(c, 1, limits[c]).alias(c) if c in limits else F.col(c) for c in rows.columns if c not in drop))


def day_groups(runs: DataFrame, today: Column, at: str) -> DataFrame:
    """runs with group: Today, Yesterday, This week (7 days), This month (30) or Older by whole days."""
    days = F.datediff(today, F.to_date(at))
    return runs.withColumn("group", F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, "This week").when(days < 30, "This month").otherwise("Older"))


def mode_by_arrival(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of several, the one that reached the count first."""
    w = Window.partitionBy(by, value).orderBy(order)
    n = rows.withColumn("nth", F.row_number().over(w))
    top = n.groupBy(by, value).agg(F.max("nth").alias("count"), F.max_by(order, "nth").alias("reached"))
    return top.groupBy(by).agg(F.max_by(F.struct(F.col(value), F.col("count")), F.struct("count", (-F.col("reached")).alias("early"))).alias("m")).select(by, F.col(f"m.{value}").alias("mode"), F.col("m.count").alias("count"))


def precedence(parts: list[DataFrame], key: str, position: str) -> DataFrame:
    """One row of each key: the last part's that has it, at the first part's position."""
    one = None
    for i, p in enumerate(parts):
        p = p.withColumn("__rank", F.lit(i))
        one = p if one is None else one.unionByName(p)
    w = Window.partitionBy(key)
    out = one.withColumn("__at", F.min_by(position, "__rank").over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc("__rank"))))
    return out.where("__n = 1").withColumn(position, F.col("__at")).drop("__rank", "__at", "__n")


def near_markers(points: DataFrame, marks: DataFrame, days: int = 7, most: int = 3) -> DataFrame:
    """points (series, i, at_ms) with the nearest markers (kind, name, first_seen_at) within days, most at a point.

    Markers and points meet by the day of the marker, so no point is held against markers that are far."""
    span = days * 86_400_000
    day = lambda c: F.floor(c / 86_400_000)
    p = points.withColumn("day", F.explode(F.sequence(day(F.col("at_ms") - span), day(F.col("at_ms") + span))))
    m = marks.withColumn("day", day(F.col("first_seen_at")))
    gap = F.abs(F.col("first_seen_at") - F.col("at_ms"))
    near = p.join(m, "day").withColumn("gap", gap).where(F.col("gap") <= span)
    r = F.row_number().over(Window.partitionBy("series", "i").orderBy("gap", "first_seen_at", "kind", "name"))
    return near.withColumn("r", r).where(F.col("r") <= most).select("series", "i", "kind", "name", "gap", "r")


def judge_sample(points: DataFrame, budget: int, window: int = 20) -> DataFrame:
    """points (series, at_ms, tie, side, rank): which to judge. First those beside a marker, after and before by turns, then an even stride of the rest.

    side: after or before the marker; rank: distance from it in sessions, from 1; null: beside none."""
    beside = F.col("rank") <= window
    first = points.where(beside).withColumn("priority", 2 * F.col("rank") - F.when(F.col("side") == "after", 1).otherwise(0))
    first = first.orderBy("priority", "at_ms", "tie").limit(budget)
    left = budget - first.count()
    rest = points.where(~F.coalesce(beside, F.lit(False)))
    n = rest.count()
    if left <= 0 or not n:
        return first.withColumn("why", F.lit("marker")).drop("priority")
    some = positions(rest, [], ["at_ms", "tie"], "i")
    place = F.ceil(F.col("i") * left / n)
    even = some.where((F.lit(n) <= left) | ((F.floor(place * n / left) == F.col("i")) & (place < left))).drop("i")
    return first.drop("priority").withColumn("why", F.lit("marker")).unionByName(even.withColumn("why", F.lit("stride")))


def ledger(failures: DataFrame, successes: DataFrame) -> DataFrame:
    """file, attempts, permanent from an append-only list (file, permanent): an attempt counts 1, a permanent one 3; a success clears the file."""
    g = failures.groupBy("file").agg(F.sum(F.when(F.col("permanent"), 3).otherwise(1)).alias("attempts"), F.max("permanent").alias("permanent"))
    return g.join(successes.select("file").distinct(), "file", "left_anti")


def to_judge(files: DataFrame, judged: DataFrame, failed: DataFrame, most: int = 3) -> DataFrame:
    """files that are neither judged nor failed for good (permanently, or most times)."""
    skip = judged.select("file").union(failed.where(F.col("permanent") | (F.col("attempts") >= most)).select("file")).distinct()
    return files.join(skip, "file", "left_anti")


def first_warnings(rows: DataFrame, by: str, order: str, warnings: str, most: int = 8) -> DataFrame:
    """The first distinct warnings of each group, in the order in which they come up."""
    each = rows.select(by, F.col(order).alias("at"), F.posexplode(warnings).alias("pos", "warning"))
    first = each.groupBy(by, "warning").agg(F.min(F.struct("at", "pos")).alias("at"))
    r = F.row_number().over(Window.partitionBy(by).orderBy("at", "warning"))
    return first.withColumn("r", r).where(F.col("r") <= most).select(by, "r", "warning")
