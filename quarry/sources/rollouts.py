"""Transcripts of the second format: records with a payload (function calls, their outputs, counts of tokens, context)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import messages

FIELDS = ("input", "cached", "output")
CALLS, OUTPUTS = ("function_call", "custom_tool_call", "local_shell_call"), ("function_call_output", "custom_tool_call_output")
_NAMES = {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens"}


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def records(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, raw) -> v, at_ms, type, kind (of the payload), call_id, name, is_error (of outputs) and the model in force.

    What a query does not use of these is not read; the fields are taken before rows are dealt out, so v stays behind unless it is used."""
    v = lines.where(F.col("raw").rlike(r"\S")).withColumn("v", messages.strict_json(F.col("raw")))
    at = messages.timestamp_ms(_get("timestamp"), _get("timestamp", "double"))
    out = v.select("file", "line_no", "v", at.alias("at_ms"), _get("type").alias("type"), _get("payload.type").alias("kind"), _get("payload.call_id").alias("call_id"), _get("payload.name").alias("name"), messages.model_or_null(_get("payload.model")).alias("said_model"))
    out = out.withColumn("is_error", F.when(F.col("kind").isin(*OUTPUTS), messages.is_tool_error(F.coalesce(_get("payload.output"), F.lit("")))))
    return out.withColumn("model", F.last("said_model", ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no"))).drop("said_model")


def calls(recs: DataFrame) -> DataFrame:
    """file, line_no, tool, model, is_error, duration_ms of function calls.

    An output belongs to the last call of its id before it, and the first output of a call counts: a call is over with it, and
    a later call of the same id takes the earlier one's place."""
    start = F.col("kind").isin(*CALLS)
    marks = recs.where(start | F.col("kind").isin(*OUTPUTS)).select("file", "line_no", "call_id", "name", "model", "at_ms", "is_error", start.alias("start"))
    # the next record of the id, if it is an output, is the call's first: seen from the end of the file, the last record so far
    after = Window.partitionBy("file", "call_id").orderBy(F.desc("line_no")).rangeBetween(Window.unboundedPreceding, -1)
    told = marks.withColumn("e", F.last(F.struct("start", F.col("at_ms").alias("end_ms"), "is_error")).over(after)).where("start")
    told = told.withColumn("e", F.when(F.col("call_id").isNotNull() & ~F.col("e.start"), F.col("e")))
    took = F.when(F.col("e.end_ms").isNotNull() & F.col("at_ms").isNotNull(), F.greatest(F.lit(0), F.col("e.end_ms") - F.col("at_ms")))
    return told.select("file", "line_no", F.coalesce("name", F.lit("shell")).alias("tool"), "model", F.coalesce("e.is_error", F.lit(False)).alias("is_error"), took.alias("duration_ms"))


def usage(recs: DataFrame) -> DataFrame:
    """file, line_no, model and the tokens of each count: those of the turn, if it says so, else the growth of the totals, which may start anew."""
    number = lambda path: F.coalesce(_get(path, "long"), F.lit(0).cast("long"))
    c = recs.where("kind = 'token_count'").select(
        "file", "line_no", "model", _get("payload.info.last_token_usage", "variant").isNotNull().alias("exact"), *(number(f"payload.info.total_token_usage.{n}").alias(f"total_{f}") for f, n in _NAMES.items()), *(number(f"payload.info.last_token_usage.{n}").alias(f"last_{f}") for f, n in _NAMES.items()),
    )
    w = Window.partitionBy("file").orderBy("line_no")
    out = []
    for f in FIELDS:
        now, before = F.col(f"total_{f}"), F.lag(f"total_{f}").over(w)
        out.append(F.when(F.col("exact"), F.col(f"last_{f}")).otherwise(F.when(before.isNull() | (now < before), now).otherwise(now - before)).alias(f))
    return c.select("file", "line_no", "model", *out)


def totals(used: DataFrame) -> DataFrame:
    """file, input_tokens (fresh), cache_tokens, output_tokens."""
    return used.groupBy("file").agg(F.greatest(F.lit(0), F.sum("input") - F.sum("cached")).alias("input_tokens"), F.sum("cached").alias("cache_tokens"), F.sum("output").alias("output_tokens"))


def prompts(recs: DataFrame, subagent: Column | bool = False) -> DataFrame:
    """file, line_no, text of what users asked for: without an editor's context, and without what a harness put in front."""
    said = F.coalesce(_get("payload.message"), _get("payload.content[0].text"))
    user = recs.where("kind = 'user_message' or (kind = 'message' and try_variant_get(v, '$.payload.role', 'string') = 'user')").select("file", "line_no", F.trim(messages.without_context(said)).alias("text"), said.alias("raw"))
    flag = subagent if isinstance(subagent, Column) else F.lit(subagent)
    return user.where(~messages.is_injected(F.col("raw"), flag) & (F.col("text") != "")).select("file", "line_no", "text")
