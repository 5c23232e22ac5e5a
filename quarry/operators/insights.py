"""Longitudinal insight: markers, trailing medians, before/after impact, change points, downsampling, running state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import stats
from quarry.operators.positions import positions

DAY = 86_400_000
#: Points from which a series is cut into pieces.
LARGE = 1_000_000


def markers(points: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """First time and number of sessions for each name of each kind; kinds: kind -> name column (null: none)."""
    one = [points.select(F.lit(kind).alias("kind"), name.alias("name"), "at_ms", "session_id").where("name is not null") for kind, name in kinds.items()]
    return reduce(DataFrame.union, one).groupBy("kind", "name").agg(F.min("at_ms").alias("first_seen_at"), F.count_distinct("session_id").alias("sessions"))


def spread(points: DataFrame, halo: int, keep: list[str]) -> DataFrame:
    """series, at_ms, session_id, the columns keep, i (place in the series, from 0), n (its points), piece, own.

    A series of more than LARGE points is cut into pieces of that many by place, so that no task holds a series; a piece also
    has copies of the halo points before and behind it (own false), for windows that reach over its ends."""
    some = points.select("series", "at_ms", "session_id", *keep)
    sizes = some.groupBy("series").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= LARGE:
        w = Window.partitionBy("series").orderBy("at_ms", "session_id")
        return some.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("series")), "piece": F.lit(0), "own": F.lit(True)})
    at = positions(some, ["series"], ["at_ms", "session_id"], "i").join(sizes, "series")
    home, place = F.floor(F.col("i") / LARGE), F.col("i") % LARGE
    copies = F.array_compact(F.array(home, F.when(place >= LARGE - halo, home + 1), F.when((place < halo) & (home > 0), home - 1)))
    return at.withColumn("piece", F.explode(copies)).withColumn("own", F.col("piece") == home)


def trailing_median(points: DataFrame, value: str, window: int = 15) -> DataFrame:
    """Median of the last window points of each series, by time."""
    values = F.collect_list(value).over(Window.partitionBy("series", "piece").orderBy("i").rowsBetween(-(window - 1), 0))
    told = spread(points, window, [value]).withColumn("values", values).where("own")
    return told.select("series", "session_id", "at_ms", F.round(stats.array_median(F.col("values")), 6).alias("median"), F.size("values").cast("long").alias("n"))


def impact(points: DataFrame, marks: DataFrame, window: int = 20, least: int = 5) -> DataFrame:
    """Medians of the window sessions before and after each marker (ties land after), and their differences.

    Points and marks are put in one order of time, by days: a mark then needs the points of the days around it alone, as
    many as hold window points on each side, so no mark meets all points."""
    days = points.groupBy(F.floor(F.col("at_ms") / DAY).alias("day")).agg(F.count("*").alias("n"))
    # per day of a mark the first and last day that its windows can reach: a row a day
    upto = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    m = marks.withColumn("day", F.floor(F.col("first_seen_at") / DAY)).select("kind", "name", "first_seen_at", "day")
    at = m.select("day").distinct().join(F.broadcast(days.select(F.col("day").alias("d"), "upto", "before")))
    reach = at.groupBy("day").agg(F.coalesce(F.max(F.when(F.col("d") < F.col("day"), F.col("upto"))), F.lit(0)).alias("past"), F.coalesce(F.max(F.when(F.col("d") <= F.col("day"), F.col("upto"))), F.lit(0)).alias("now")).withColumnRenamed("day", "mark_day")
    near = reach.join(F.broadcast(days)).where((F.col("upto") > F.col("past") - window) & (F.col("before") < F.col("now") + window)).select("mark_day", "day")
    j = points.withColumn("day", F.floor(F.col("at_ms") / DAY)).join(near, "day").join(m.withColumnRenamed("day", "mark_day"), "mark_day")
    before = F.col("at_ms") < F.col("first_seen_at")
    j = j.withColumn("side", F.when(before, "before").otherwise("after"))
    close = F.when(before, -F.col("at_ms")).otherwise(F.col("at_ms"))
    tie = F.when(before, -F.col("ord")).otherwise(F.col("ord"))
    j = j.withColumn("r", F.row_number().over(Window.partitionBy("kind", "name", "side").orderBy(close, tie))).where(F.col("r") <= window)
    agg = j.groupBy("kind", "name").agg(*(x for s in ("before", "after") for x in (
        F.count_if(F.col("side") == s).alias(f"n_{s}"),
        F.coalesce(F.median(F.when(F.col("side") == s, F.col("cost"))), F.lit(0.0)).alias(f"cost_{s}"),
        F.coalesce(F.median(F.when(F.col("side") == s, F.col("error_rate"))), F.lit(0.0)).alias(f"errors_{s}"),
    )))
    return agg.select("kind", "name", "n_before", "n_after", F.round(F.col("cost_after") - F.col("cost_before"), 6).alias("cost_delta"), F.round(F.col("errors_after") - F.col("errors_before"), 6).alias("errors_delta"), ((F.col("n_before") < least) | (F.col("n_after") < least)).alias("low_confidence"))


def trend(points: DataFrame, value: str) -> DataFrame:
    """Per series the medians of its first and second half and their difference."""
    w = Window.partitionBy("series")
    half = F.row_number().over(w.orderBy("at_ms", "session_id")) > F.floor(F.count("*").over(w) / 2)
    m = points.withColumn("late", half).groupBy("series").agg(F.count("*").alias("n"), F.coalesce(F.median(F.when(~F.col("late"), F.col(value))), F.lit(0.0)).alias("a"), F.coalesce(F.median(F.when(F.col("late"), F.col(value))), F.lit(0.0)).alias("b"))
    return m.select("series", "n", F.round("a", 6).alias("before"), F.round("b", 6).alias("after"), F.round(F.col("b") - F.col("a"), 6).alias("trend"))


def change_scores(points: DataFrame, value: str, window: int = 25) -> DataFrame:
    """z of the difference of means of window points before and from each place; series of two windows or more."""
    w = Window.partitionBy("series", "piece").orderBy("i")
    a, b = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    means = {"ma": F.avg(value).over(a), "mb": F.avg(value).over(b), "va": F.coalesce(F.var_samp(value).over(a), F.lit(0.0)), "vb": F.coalesce(F.var_samp(value).over(b), F.lit(0.0))}
    s = spread(points, window, [value]).withColumns(means).where("own")
    se = F.sqrt(F.col("va") / window + F.col("vb") / window)
    z = F.when(se > 1e-9, F.abs(F.col("mb") - F.col("ma")) / se).otherwise(0.0)
    return s.where((F.col("n") >= 2 * window) & (F.col("i") >= window) & (F.col("i") <= F.col("n") - window)).select("series", F.col("i").cast("long").alias("i"), "at_ms", F.col("ma").alias("before"), F.col("mb").alias("after"), z.alias("z"))


def change_points(scores: DataFrame, window: int = 25, least: float = 3.0, top: int = 12) -> DataFrame:
    """Greedy suppression: by falling z (ties to the earlier), places within a window of one that is taken are dropped.

    A place is dropped only by one within a window, so a series is cut at gaps of a window between strong places and each
    piece is thinned by itself."""
    w = Window.partitionBy("series").orderBy("i")
    strong = scores.where(F.col("z") >= least)
    piece = F.sum((F.coalesce(F.col("i") - F.lag("i").over(w), F.lit(window)) >= window).cast("int")).over(w)
    pieces = strong.withColumn("piece", piece).groupBy("series", "piece").agg(F.array_sort(F.collect_list(F.struct((-F.col("z")).alias("minus"), "i", "at_ms", "before", "after"))).alias("all"))
    none = F.slice(F.col("all"), 1, 0)
    taken = F.aggregate("all", none, lambda acc, s: F.when(F.exists(acc, lambda t: F.abs(t["i"] - s["i"]) < window), acc).otherwise(F.concat(acc, F.array(s))))
    rows = pieces.select("series", F.inline(taken))
    return rows.select("series", "i", "at_ms", F.round(-F.col("minus"), 6).alias("z"), F.round(F.col("after") - F.col("before"), 6).alias("delta")).orderBy(F.desc("z"), "series", "i").limit(top)


def timeline(spans: DataFrame, by: str) -> DataFrame:
    """by, span, left, width: spans (a to b) of each group in per cent of its whole time, 0.4 wide at least."""
    whole = spans.groupBy(by).agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    j = spans.join(whole, by)
    share = lambda c: F.when(F.col("hi") > F.col("lo"), 100.0 * c / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return j.select(by, "span", F.round(share(F.col("a") - F.col("lo")), 4).alias("left"), F.round(F.greatest(F.lit(0.4), share(F.col("b") - F.col("a"))), 4).alias("width"))


def stride(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key: those at floor(i * n / most)."""
    w = Window.partitionBy(key)
    x = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    first = F.ceil(F.col("i") * most / F.col("n"))
    return x.where((F.col("n") <= most) | (F.floor(first * F.col("n") / most) == F.col("i")) & (first < most)).drop("n")


def pairwise(rows: DataFrame, key: str, order: str, value: str, most: int) -> DataFrame:
    """Neighbours merged in pairs until each key has at most ``most`` rows: values summed, the later order kept."""
    w = Window.partitionBy(key)
    x = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    r = F.aggregate(F.sequence(F.lit(0), F.lit(40)), F.lit(0), lambda a, k: F.when(F.ceil(F.col("n") / F.pow(F.lit(2), a)) > most, a + 1).otherwise(a))
    return x.withColumn("slot", F.floor(F.col("i") / F.pow(F.lit(2), r)).cast("long")).groupBy(key, "slot").agg(F.max(order).alias(order), F.round(F.sum(value), 2).alias(value))


def reset_deltas(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Growth of a counter that may start anew: the difference, or the value itself after a fall."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("delta", F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before))


def running(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.withColumn("total", F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def carry_forward(rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """The last known value at each row."""
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def error_context(rows: DataFrame, key: str, order: str, is_error: Column) -> DataFrame:
    """Errors and their neighbours."""
    w = Window.partitionBy(key).orderBy(order)
    near = is_error | F.coalesce(F.lag(is_error).over(w), F.lit(False)) | F.coalesce(F.lead(is_error).over(w), F.lit(False))
    return rows.withColumn("near", near).where("near").drop("near")


def without_echo(rows: DataFrame, key: str, order: str, same: list[str]) -> DataFrame:
    """Rows that do not repeat the row before in the given columns."""
    w = Window.partitionBy(key).orderBy(order)
    me, before = F.struct(*same), F.lag(F.struct(*same)).over(w)
    return rows.withColumn("echo", F.coalesce(me == before, F.lit(False))).where("not echo").drop("echo")
