"""Session analytics: totals, rollups, weekly spine, heatmap, costs, paging, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import stats


def totals(sessions: DataFrame, *by: str) -> DataFrame:
    return sessions.groupBy(*by).agg(
        F.count("*").alias("sessions"), F.count_distinct("project").alias("projects"), F.sum("tool_calls").alias("tool_calls"), F.sum("tool_errors").alias("tool_errors"),
        F.round(F.sum("cost"), 2).alias("cost"), F.count_if(F.col("cost") > 0).alias("priced"), F.round(F.avg(stats.rate(F.col("tool_errors"), F.col("tool_calls"))), 6).alias("mean_error_rate"),
    )


def by_model(sessions: DataFrame) -> DataFrame:
    """Rollup by model (null: unknown), most errors first."""
    rows = sessions.withColumn("model", F.coalesce("model", F.lit("unknown")))
    return totals(rows, "model").orderBy(F.desc("tool_errors"), "mean_error_rate", "model")


def merge_rollups(rollups: list[DataFrame], cap: int) -> DataFrame:
    """Same model across sources summed, dearest first, capped."""
    one = rollups[0]
    for r in rollups[1:]:
        one = one.unionByName(r)
    out = one.groupBy("model").agg(F.sum("sessions").alias("sessions"), F.round(F.sum("cost"), 2).alias("cost"), F.sum("tool_calls").alias("tool_calls"))
    return out.orderBy(F.desc("cost"), "model").limit(cap)


def weekly(sessions: DataFrame, now: str, weeks: int) -> DataFrame:
    """The last weeks up to now's, from Monday to Monday, oldest first; weeks without a session are there too."""
    this = F.to_date(F.date_trunc("week", F.lit(now).cast("timestamp_ntz")))
    spine = sessions.sparkSession.range(weeks).select(F.date_sub(this, (7 * F.col("id")).cast("int")).alias("week"))
    found = sessions.groupBy(F.to_date(F.date_trunc("week", "started_at")).alias("week")).agg(F.count("*").alias("sessions"), F.sum("cost").alias("cost"), F.sum("tool_calls").alias("tool_calls"))
    return spine.join(found, "week", "left").select(F.col("week").cast("string").alias("week"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.round(F.coalesce("cost", F.lit(0.0)), 2).alias("cost"), F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"))


def projects(sessions: DataFrame, top: int) -> DataFrame:
    out = sessions.groupBy("project").agg(F.count("*").alias("sessions"), F.round(F.sum("cost"), 2).alias("cost"), F.sum("n_events").alias("events"), F.max("until").alias("last_active"))
    return out.orderBy(F.desc("cost"), "project").limit(top)


def heatmap(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Counts on the dense grid of weekday (Monday 0) and hour."""
    spark = rows.sparkSession
    grid = spark.range(7 * 24).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    found = rows.groupBy(F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    return grid.join(found, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def day_parts(grid: DataFrame) -> DataFrame:
    """Share of night, morning, afternoon and evening of a heatmap."""
    part = F.when(F.col("hour") < 6, "night").when(F.col("hour") < 12, "morning").when(F.col("hour") < 18, "afternoon").otherwise("evening")
    by = grid.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
    return by.join(F.broadcast(by.agg(F.sum("n").alias("all")))).select("part", "n", F.round(stats.rate(F.col("n"), F.col("all")), 6).alias("share"))


def costs(sessions: DataFrame, rates: DataFrame) -> DataFrame:
    """Estimated cost by model rates; a model without a rate, or no tokens, has none. Tokens here: calls in, errors out."""
    j = sessions.join(F.broadcast(rates), "model", "left")
    cost = stats.cost_usd({"i": F.col("tool_calls") * 1000, "o": F.col("tool_errors") * 500}, {"i": F.col("rate_in"), "o": F.col("rate_out")})
    return j.select("session_id", "model", F.round(cost, 9).alias("estimate"))


def allocated(sessions: DataFrame) -> DataFrame:
    """Each user's cost split over its days by tool calls; without any, to its first day."""
    w = Window.partitionBy("user_id")
    share = F.when(F.sum("tool_calls").over(w) > 0, F.sum("cost").over(w) * F.col("tool_calls") / F.sum("tool_calls").over(w)).when(F.row_number().over(w.orderBy("day")) == 1, F.sum("cost").over(w)).otherwise(0.0)
    return sessions.select("session_id", share.alias("share"))


def page_after(sessions: DataFrame, until: int, session_id: str, size: int) -> DataFrame:
    """The page after a cursor, newest first; ties by id."""
    size = max(1, min(500, size))
    older = (F.col("until") < until) | ((F.col("until") == until) & (F.col("session_id") > session_id))
    return sessions.where(older).orderBy(F.desc("until"), "session_id").limit(size)


def attention(sessions: DataFrame, now: int) -> DataFrame:
    """Sessions with errors, low quality, or stale for 12 hours, with their staleness."""
    stale = F.greatest(F.lit(0), F.lit(now) - F.col("until"))
    out = sessions.withColumn("stale_ms", stale).withColumn("is_stale", F.col("stale_ms") > 12 * 3_600_000)
    return out.where((F.col("tool_errors") > 0) | (F.col("quality") < 70) | F.col("is_stale"))


def pending(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the cache does not hold in this version."""
    return files.join(cache, ["file", "mtime", "size", "version"], "left_anti")


def archive_merge(on_disk: DataFrame, cached: DataFrame) -> DataFrame:
    """Sessions on disk, and cached ones whose file is gone and whose session is not on disk, the newest of each."""
    gone = cached.join(on_disk, "file", "left_anti").join(on_disk, "session_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("mtime"), "file"))
    gone = gone.withColumn("n", first).where("n = 1").drop("n")
    return on_disk.withColumn("archived", F.lit(False)).unionByName(gone.withColumn("archived", F.lit(True)))


def ratios(sessions: DataFrame, model: str) -> DataFrame:
    """Totals of a collection with its shares: errors of calls, priced sessions, a model's part of the cost (of sessions without any)."""
    mine = F.col("model") == model
    cost = stats.rate(F.sum(F.when(mine, F.col("cost"))), F.sum("cost"))
    return sessions.agg(
        F.count("*").alias("sessions"), F.count_distinct("project").alias("projects"), F.sum("tool_calls").alias("tool_calls"), F.sum("tool_errors").alias("tool_errors"), F.round(stats.rate(F.sum("tool_errors"), F.sum("tool_calls")), 6).alias("tool_error_share"), F.round(F.sum("cost"), 2).alias("cost"),
        F.round(F.avg((F.col("cost") > 0).cast("double")), 6).alias("priced_share"), F.max("until").alias("last_event_at"), F.round(F.when(F.sum("cost") > 0, cost).otherwise(F.avg(mine.cast("double"))), 6).alias("first_model_share"),
    )


def rhythm(grid: DataFrame) -> DataFrame:
    """The busiest hour and weekday of a heatmap (the first of several) and the weekend's share."""
    by = lambda c: grid.groupBy(c).agg(F.sum("n").alias("n")).agg(F.max_by(c, F.struct("n", -F.col(c))).alias(c))
    weekend = grid.agg(F.round(stats.rate(F.sum(F.when(F.col("weekday") >= 5, F.col("n"))), F.sum("n")), 6).alias("weekend_share"))
    return by("hour").withColumnRenamed("hour", "peak_hour").join(F.broadcast(by("weekday").withColumnRenamed("weekday", "busiest_day"))).join(F.broadcast(weekend))
