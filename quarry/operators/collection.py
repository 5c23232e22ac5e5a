"""The whole collection: its sources, totals over all of them, merged rollups, pages, and markers with all their figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catalogue(declared: DataFrame, curated: DataFrame) -> DataFrame:
    """source, root, parseable: all declared sources and those curated ones whose root nobody has claimed; roots without a last slash."""
    root = F.regexp_replace("root", "/+$", "")
    a, b = (d.withColumn("root", root) for d in (declared, curated))
    first = F.row_number().over(Window.partitionBy("root").orderBy("source"))
    a = a.withColumn("n", first).where("n = 1").drop("n")
    return a.unionByName(b.join(a.select("root"), "root", "left_anti").select(*a.columns))


def discover(sources: DataFrame, files: DataFrame) -> DataFrame:
    """sources with status (absent: no root, empty, present), number of files and last activity. files: source, file (null: the root alone), mtime."""
    g = files.groupBy("source").agg(F.count("file").alias("files"), F.max(F.when(F.col("file").isNotNull(), F.col("mtime"))).alias("last_at"))
    j = sources.join(g, "source", "left")
    status = F.when(F.col("files").isNull(), "absent").when(F.col("files") == 0, "empty").otherwise("present")
    return j.select(*sources.columns, status.alias("status"), F.coalesce("files", F.lit(0)).alias("files"), "last_at")


def all_sessions(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Sessions of all sources, with each source's id and label; (id, label, sessions)."""
    return reduce(DataFrame.unionByName, (d.withColumns({"source_id": F.lit(i), "source_label": F.lit(label)}) for i, label, d in parts))


def merge_tools(rollups: list[DataFrame], most: int) -> DataFrame:
    """Tools of several rollups (tool, calls, errors) summed, the most called first."""
    return reduce(DataFrame.unionByName, rollups).groupBy("tool").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors")).orderBy(F.desc("calls"), "tool").limit(most)


def totals(sessions: DataFrame) -> DataFrame:
    """One row: what all sessions add up to, their means, and how much of each is known."""
    known = lambda c: F.round(F.avg((F.col(f"{c}_source") == "measured").cast("double")), 6).alias(f"{c}_known")
    counted = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return sessions.agg(
        F.count("*").alias("sessions"), F.count_distinct("project").alias("projects"), F.count_distinct(F.coalesce("model", F.lit("unknown"))).alias("models"),
        *(counted(c) for c in ("input_tokens", "output_tokens", "cache_tokens", "tool_calls", "tool_errors", "turns", "lines", "malformed", "hook_errors", "thinking_blocks", "text_blocks", "attachments", "snapshots", "subagents", "reads", "writes", "orphans", "rework_files")),
        F.count_if("error_tail").alias("failed_tails"), F.count_if("passed_tail").alias("passed_tails"), F.count_if(F.col("tool_errors") > 0).alias("with_errors"), F.count_if(F.col("malformed") > 0).alias("with_malformed"), F.count_if(F.col("quality") < 70).alias("weak"), F.count_if("is_subagent").alias("subagent_sessions"), F.count_if(F.col("models") > 1).alias("mixed_models"),
        F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.avg("tool_error_rate"), 6).alias("mean_tool_error_rate"), F.min("started_at").alias("first_at"), F.max("last_event_at").alias("last_at"), known("model"), known("tokens"), known("duration"), known("turns"),
        # mean of the sessions' own rates, of those that have one
        F.round(F.avg(F.when((F.col("output_tokens") > 0) & (F.col("duration_ms") > 0), F.col("output_tokens") * 1000.0 / F.col("duration_ms"))), 6).alias("mean_tokens_per_s"),
    )


def by_model(usage: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per model (null: unknown) of attributed usage (session, model, input, output, calls, errors): sessions, sums, mean quality; most errors, then least quality first."""
    j = usage.join(sessions.select("session", "quality"), "session").withColumn("model", F.coalesce("model", F.lit("unknown")))
    out = j.groupBy("model").agg(F.count_distinct("session").alias("sessions"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.round(F.avg("quality"), 6).alias("mean_quality"))
    return out.orderBy(F.desc("errors"), "mean_quality", "model")


def page_append(shown: DataFrame, page: DataFrame) -> DataFrame:
    """Rows of the next page that are not shown already, by path, or by id without one."""
    key = F.coalesce("path", "session_id")
    return page.withColumn("__key", key).join(shown.select(key.alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def leader(board: DataFrame) -> DataFrame:
    """The first row of the highest pass rate; board: place, harness, pass_rate."""
    return board.where(F.col("pass_rate").isNotNull()).orderBy(F.desc("pass_rate"), "place").limit(1)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (d.agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, d in sorted(tables.items())))


def markers(points: DataFrame) -> DataFrame:
    """kind, name, first_seen_at, sessions of skills, servers, models and the use of subagents; points: at_ms, skills, mcp_servers (arrays), model, subagents."""
    each = lambda kind, names: points.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(names)).alias("name"), "at_ms")
    one = [each("skill", F.col("skills")), each("mcp", F.col("mcp_servers")), each("model", F.array_compact(F.array("model"))), each("subagent", F.array_compact(F.array(F.when(F.col("subagents") > 0, "subagent usage"))))]
    return reduce(DataFrame.union, one).groupBy("kind", "name").agg(F.min("at_ms").alias("first_seen_at"), F.count("*").alias("sessions")).orderBy("first_seen_at", "kind", "name")


MEDIANS = ("error_rate", "cost", "calls_per_turn", "minutes")


def impact_figures(sides: DataFrame, judged_enough: int = 5, least: int = 5) -> DataFrame:
    """sides: kind, name, side (before, after), at_ms, model, outcome, judged, has_signal, error_rate, cost, calls_per_turn, subagents, minutes, at most a window each.

    Per marker the six differences of after and before, and what else may explain them. Outcomes are judged ones where a side
    has enough, else those with a signal."""
    n_judged = F.count_if("judged")
    g = sides.groupBy("kind", "name", "side").agg(
        F.count("*").alias("n"), n_judged.alias("n_judged"), *(F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in MEDIANS), F.avg((F.col("subagents") > 0).cast("double")).alias("subagent_rate"),
        F.coalesce(F.when(n_judged >= judged_enough, F.median(F.when(F.col("judged"), F.col("outcome")))).otherwise(F.median(F.when(F.col("has_signal"), F.col("outcome")))), F.lit(0.0)).alias("outcome"),
    )
    w = Window.partitionBy("kind", "name", "side", "model").orderBy("at_ms")
    nth = sides.where("model is not null").withColumn("nth", F.row_number().over(w))
    mode = nth.groupBy("kind", "name", "side").agg(F.max_by("model", F.struct("nth", -F.col("at_ms"))).alias("model"))
    g = g.join(mode, ["kind", "name", "side"], "left").withColumn("pool", F.when(F.col("n_judged") >= judged_enough, "judged").otherwise("heuristic"))
    names = ["n", "model", "pool", "outcome", *MEDIANS, "subagent_rate"]
    side = lambda s: g.where(F.col("side") == s).select("kind", "name", *(F.col(c).alias(f"{s}_{c}") for c in names))
    j = side("before").join(side("after"), ["kind", "name"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    pool = lambda s: F.coalesce(f"{s}_pool", F.lit("heuristic"))
    n = lambda s: F.coalesce(f"{s}_n", F.lit(0))
    thin = (n("before") < least) | (n("after") < least)
    why = F.array_compact(F.array(
        F.when(F.col("before_model") != F.col("after_model"), F.concat(F.lit("dominant model changed "), "before_model", F.lit(" → "), "after_model", F.lit(" around this point"))),
        F.when(pool("before") != pool("after"), F.concat(F.lit("outcome medians mix "), pool("after"), F.lit(" (after) with "), pool("before"), F.lit(" (before) scores"))),
        F.when(thin, F.concat(F.lit("thin sample ("), n("before").cast("string"), F.lit(" before / "), n("after").cast("string"), F.lit(" after)"))),
    ))
    deltas = [F.round(zero(f"after_{c}") - zero(f"before_{c}"), 6).alias(f"{c}_delta") for c in ("outcome", *MEDIANS, "subagent_rate")]
    return j.select("kind", "name", n("before").alias("n_before"), n("after").alias("n_after"), *deltas, F.array_join(why, "; ").alias("confounds"), thin.alias("low_confidence"))


def local_week(at_ms: Column, zone: str) -> Column:
    """The Monday of a time's week where the clock is the zone's, also over a change of the clock."""
    return F.to_date(F.date_trunc("week", F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_millis(at_ms).cast("timestamp_ntz"))))


def weekly_local(sessions: DataFrame, now_ms: int, weeks: int, zone: str) -> DataFrame:
    """week, sessions: the last weeks of a zone's calendar up to now's, oldest first, also those without a session."""
    spine = sessions.sparkSession.range(weeks).select(F.date_sub(local_week(F.lit(now_ms), zone), (7 * F.col("id")).cast("int")).alias("week"))
    found = sessions.groupBy(local_week(F.col("at_ms"), zone).alias("week")).agg(F.count("*").alias("sessions"))
    return spine.join(found, "week", "left").select("week", F.coalesce("sessions", F.lit(0)).alias("sessions")).orderBy("week")


def cached_parses(files: DataFrame, cache: DataFrame, parsed: DataFrame, version: int) -> DataFrame:
    """The parse cache after a pass: rows of files as they are now stay, new parses (null ones too) replace older ones of their file.

    files: file, mtime, size; cache: file, mtime, size, version, session; parsed: file, mtime, size, session."""
    hit = cache.where(F.col("version") == version).join(files, ["file", "mtime", "size"], "left_semi")
    new = parsed.withColumn("version", F.lit(version)).select(*hit.columns)
    gone = cache.join(files, "file", "left_anti").where("session is not null")
    return hit.join(new, "file", "left_anti").unionByName(new).unionByName(gone.join(new, "file", "left_anti"))
