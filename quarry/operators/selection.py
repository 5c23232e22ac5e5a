"""Selections and orders of sessions, markers, audits, runs and models as lists show them, and rows of runs for lists.

Names are ordered as people order them: by Spark's UNICODE collation, where case and accents only decide between names that
are alike otherwise. A rank is told instead of an order, so that it lives on in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import messages

#: Caps of a transcript as text (fixed values).
INPUT_CHARS, RESULT_CHARS = 1000, 2000
RETAINED = 100


def people(name: Column | str) -> Column:
    """A name to be ordered by."""
    return F.collate(F.col(name) if isinstance(name, str) else name, "UNICODE")


def ranked(rows: DataFrame, *order: Column, by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """rows with their rank (from 1) in each group; most: only so many, which Spark bounds before it moves rows."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))
    return out if most is None else out.where(F.col("rank") <= most)


def of_source_and_model(sessions: DataFrame, source: str | None = None, model: str | None = None) -> DataFrame:
    """Sessions of a source and a model, if given; sessions without a model are of the model unknown."""
    out = sessions if source is None else sessions.where(F.col("source") == source)
    return out if model is None else out.where(F.coalesce("model", F.lit("unknown")) == model)


def valid_points(points: DataFrame, at: str = "at_ms") -> DataFrame:
    """Points whose time is a finite number above 0."""
    t = F.col(at).cast("double")
    return points.where((t > 0) & ~F.isnan(t) & (t < float("inf")))


def of_kind(marks: DataFrame, kind: str = "all") -> DataFrame:
    return marks if kind == "all" else marks.where(F.col("kind") == kind)


def audited(rows: DataFrame, category: str = "all", stat: str = "all", said: str = "") -> DataFrame:
    """Audit rows (id, name, category, has_oracle, has_known_bad, deterministic, trace, weaknesses) of a category, with what the
    chosen figure counts, and with a text in id, name or category, in any case."""
    keep = {"all": F.lit(True), "oracle": F.col("has_oracle"), "knownBad": F.col("has_known_bad"), "deterministic": F.col("deterministic") + F.col("trace") > 0, "weak": F.size("weaknesses") > 0}[stat]
    out = rows.where(keep if category == "all" else keep & (F.col("category") == category))
    q = said.lower()
    return out.where(F.lower("id").contains(q) | F.lower("name").contains(q) | F.lower("category").contains(q)) if q else out


def audit_rank(rows: DataFrame, how: str = "weak", most: int | None = None) -> DataFrame:
    """By name, by category and name, or the weakest first; ties by name, then id."""
    first = {"name": [], "category": [people("category")], "weak": [F.desc(F.size("weaknesses"))]}[how]
    return ranked(rows, *first, people("name"), F.col("id"), most=most)


def run_rank(runs: DataFrame, how: str = "newest", most: int | None = None) -> DataFrame:
    """runs (run_id, created_at, pass_rate) newest, oldest, or by pass rate either way; no rate counts as 0."""
    rate = F.coalesce("pass_rate", F.lit(0.0))
    first = {"newest": F.desc("created_at"), "oldest": F.asc("created_at"), "pass-desc": F.desc(rate), "pass-asc": F.asc(rate)}[how]
    return ranked(runs, first, F.desc("created_at"), F.col("run_id"), most=most)


def column_rank(rows: DataFrame, column: str, tie: str, descending: bool = True, most: int | None = None) -> DataFrame:
    """By any column: texts as people order them, numbers with null as 0."""
    text = rows.schema[column].dataType.typeName() == "string"
    key = people(F.coalesce(column, F.lit(""))) if text else F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    return ranked(rows, key.desc() if descending else key.asc(), F.col(tie), most=most)


def catalogue_rank(models: DataFrame, families: list[str]) -> DataFrame:
    """models (family, is_alias, label, id) by a list of families (others last), aliases first, then label."""
    place = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    return ranked(models, F.when(place > 0, place).otherwise(len(families) + 1), F.desc("is_alias"), people("label"), F.col("id"))


def retained(sessions: DataFrame, most: int = RETAINED) -> DataFrame:
    """The latest sessions of each source that are kept for display, with the number of all: totals never depend on the bound."""
    latest = ranked(sessions, F.desc("last_event_at"), F.col("session_id"), by=["source"], most=most)
    return latest.join(sessions.groupBy("source").agg(F.count("*").alias("all_sessions")), "source")


def case_summaries(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, seq, status, cost, tokens and duration of the cases of many runs at once; results that are no JSON have none."""
    v = F.try_parse_json("result")
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    some = cases.join(runs.select("run_id").distinct(), "run_id", "left_semi")
    return some.select("run_id", "seq", "status", get("usage.costUsd", "double").alias("cost"), get("usage.inputTokens", "long").alias("input_tokens"), get("usage.outputTokens", "long").alias("output_tokens"), get("durationMs", "long").alias("duration_ms"))


def cost_after_run(model: Column, fallback: Column, cost: Column, source: Column, estimate: Column) -> tuple[Column, Column, Column]:
    """(model, cost, source) of a run's result: a cost without a known source is thrown away and estimated, if it can be."""
    known = source.isin("measured", "inferred")
    new = F.when(known, cost).otherwise(F.coalesce(estimate, F.lit(0.0)))
    return F.coalesce(messages.model_or_null(model), messages.model_or_null(fallback)), new, F.when(known, source).when(estimate.isNotNull(), "inferred").otherwise("missing")


def transcript_text(blocks: DataFrame) -> DataFrame:
    """run_id, text: a transcript as text, from its blocks (run_id, seq, role, type, text, name, input, tool_use_id, content).

    What assistants say, the tools they call with their input's first characters, and results' first characters; the rest
    is left out."""
    said = (F.col("role") == "assistant") & (F.col("type") == "text")
    called = (F.col("role") == "assistant") & (F.col("type") == "tool_use")
    told = (F.col("role") == "user") & (F.col("type") == "tool_result")
    line = F.when(said, F.concat(F.lit("ASSISTANT: "), F.coalesce("text", F.lit("")))).when(called, F.concat(F.lit("TOOL_USE("), "name", F.lit("): "), F.substring("input", 1, INPUT_CHARS)))
    line = line.when(told, F.concat(F.lit("TOOL_RESULT("), "tool_use_id", F.lit("): "), F.substring(F.coalesce("content", F.lit("")), 1, RESULT_CHARS)))
    listed = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return blocks.where(line.isNotNull()).groupBy("run_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))


def scanned(sessions: DataFrame, limit: int) -> DataFrame:
    """For each source its totals over all sessions, how many of them a list of at most limit shows, and whether that cuts any off."""
    g = sessions.groupBy("source").agg(F.count("*").alias("sessions"), F.sum("tool_calls").alias("tool_calls"), F.max("last_event_at").alias("last_event_at"))
    return g.withColumns({"shown": F.least(F.col("sessions"), F.lit(limit).cast("long")), "truncated": F.col("sessions") > limit})


def runs_of_status(runs: DataFrame, status: str, most: int = 100) -> DataFrame:
    """The latest runs (run_id, created_at, status) of a status."""
    return ranked(runs.where(F.col("status") == status), F.desc("created_at"), F.col("run_id"), most=most)
