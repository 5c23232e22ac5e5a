"""Agent transcripts: lists of session files, the records of their lines, and what is told by a file's records.

A file is one session. Its lines are records: user and assistant messages with blocks (text, tool_use, tool_result,
thinking), system lines, attachments, queue operations, snapshots, results, titles. Everything goes by file through
aggregates and windows over lines; ``lines`` reads files, ``fold`` makes the sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import messages, stats

#: Tool name parts of reading, names of writing (fixed values).
READ_LIKE = ("read", "grep", "glob", "webfetch", "websearch")
WRITE_NAMES = ("write", "edit", "multiedit")
PLACEHOLDER_MODELS = ("<synthetic>", "unknown", "")


def list_files(spark: SparkSession, root: str, pattern: str = "*.jsonl", depth: int | None = None) -> DataFrame:
    """file, project (folder), mtime_ms, size of the files below root whose name fits; nothing is read.

    depth: most folders between root and a file. Links to a folder that is listed already are followed once by Spark."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    out = found.select(F.col("path").alias("file"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))
    inner = F.regexp_replace("file", "^file:/*", "/")
    below = F.size(F.split(F.substr(inner, F.lit(len(root.rstrip("/")) + 2)), "/")) - 1
    out = out.withColumn("depth", below).withColumn("project", F.element_at(F.split("file", "/"), -2))
    return out if depth is None else out.where(F.col("depth") <= depth)


def newest(files: DataFrame, sessions: DataFrame, limit: int = 200) -> DataFrame:
    """Sessions of the newest files, until limit are there or 5 * limit files were looked at; sessions: file, ... (parsed ones only)."""
    order = Window.orderBy(F.desc("mtime_ms"), "file")
    near = files.orderBy(F.desc("mtime_ms"), "file").limit(5 * limit).withColumn("place", F.row_number().over(order))
    return near.join(sessions, "file").orderBy("place").limit(limit)


def archived(files: DataFrame, folder: str = "archived_sessions") -> DataFrame:
    """files with whether they lie below a folder of that name."""
    return files.withColumn("archived", F.array_contains(F.split("file", "/"), folder))


def below(files: DataFrame, prefix: str) -> DataFrame:
    """Files below a folder; marks of patterns in its name mean themselves."""
    return files.where(F.col("file").startswith(prefix.rstrip("/") + "/"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One hash of all (file, mtime_ms, size), whatever their order: sums of row hashes, so no task sees all."""
    h = F.xxhash64("file", "mtime_ms", "size").cast("decimal(38,0)")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("fingerprint"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def records(lines: DataFrame) -> DataFrame:
    """A row for each line that is not blank: v (variant, null: malformed), at_ms, and the fields that the fold looks at."""
    v = lines.where(F.col("raw").rlike(r"\S")).withColumn("v", messages.strict_json(F.col("raw")))
    at = F.coalesce(messages.timestamp_ms(_get("timestamp"), _get("timestamp", "double")), messages.timestamp_ms(_get("created_at"), _get("created_at", "double")))
    blocks = _get("message.content", "array<variant>")
    return v.select(
        "file", "line_no", "v", F.col("v").isNull().alias("malformed"), at.alias("at_ms"), _get("type").alias("type"), _get("uuid").alias("uuid"), _get("parentUuid").alias("parent"),
        _get("sessionId").alias("session_id"), _get("isSidechain", "boolean").alias("sidechain"), _get("agentId").alias("agent"), messages.model_or_null(_get("message.model")).alias("model"),
        F.when(blocks.isNull(), _get("message.content")).alias("said"), blocks.alias("blocks"),
    )


def message_text(glue: str = " ") -> Column:
    """Text of a message: the string, or its text blocks joined."""
    part = lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))
    texts = F.transform(F.filter("blocks", lambda b: F.try_variant_get(b, "$.type", "string") == "text"), part)
    return F.coalesce(F.array_join(texts, glue), F.col("said"))


def turns(recs: DataFrame) -> DataFrame:
    """file, line_no, role, text, severity, tool of messages as a reader sees them: what is said, tools called, their results."""
    block = F.explode_outer("blocks")
    kind, b = F.try_variant_get("b", "$.type", "string"), lambda p, t="string": F.try_variant_get("b", f"$.{p}", t)
    rows = recs.where("type in ('user', 'assistant', 'system')").select("file", "line_no", "type", "said", block.alias("b"))
    content = F.coalesce(b("text"), b("thinking"), b("content"), F.when(kind == "tool_use", F.concat(b("name"), F.lit(" "), F.coalesce(F.to_json(F.try_variant_get("b", "$.input", "variant")), F.lit("{}")))), F.col("said"))
    role = F.when(kind.isin("tool_use", "tool_result"), "tool").otherwise(F.col("type"))
    severity = F.when(F.coalesce(b("is_error", "boolean"), F.lit(False)), "error").when(kind == "thinking", "muted").otherwise("info")
    return rows.select("file", "line_no", role.alias("role"), content.alias("text"), severity.alias("severity"), b("name").alias("tool")).where("text is not null")


def tool_calls(recs: DataFrame) -> DataFrame:
    """A row for each tool_use block: file, line_no, pos, call_id, tool, model, target, at_ms, and its result's error and duration.

    A result belongs to the start of its id that comes before it; the first result of a start counts."""
    b = lambda p, t="string": F.try_variant_get("b", f"$.{p}", t)
    blocks = recs.select("file", "line_no", "type", "at_ms", "model", F.posexplode("blocks").alias("pos", "b")).withColumn("kind", b("type"))
    target = F.coalesce(b("input.file_path"), b("input.path"))
    starts = blocks.where("type = 'assistant' and kind = 'tool_use'").select("file", "line_no", "pos", b("id").alias("call_id"), b("name").alias("tool"), "model", "at_ms", target.alias("target"), F.coalesce(b("input.skill"), b("input.command"), b("input.name")).alias("argument"))
    # results and starts of an id in the order of lines: a result sees the last start before it
    results = blocks.where("type = 'user' and kind = 'tool_result'").select("file", b("tool_use_id").alias("call_id"), "line_no", F.col("pos"), F.col("at_ms").alias("end_ms"), F.coalesce(b("is_error", "boolean"), F.lit(False)).alias("is_error"))
    marks = starts.where("call_id is not null").select("file", "call_id", F.col("line_no").alias("l"), F.col("pos").alias("p"), F.struct("line_no", "pos").alias("start"), F.lit(None).cast("long").alias("end_ms"), F.lit(None).cast("boolean").alias("is_error"))
    marks = marks.unionByName(results.select("file", "call_id", F.col("line_no").alias("l"), F.col("pos").alias("p"), F.lit(None).cast(marks.schema["start"].dataType).alias("start"), "end_ms", "is_error"))
    w = Window.partitionBy("file", "call_id").orderBy("l", "p")
    ends = marks.withColumn("s", F.last("start", ignorenulls=True).over(w)).where("start is null and s is not null")
    first = ends.groupBy("file", F.col("s.line_no").alias("line_no"), F.col("s.pos").alias("pos")).agg(F.min_by("end_ms", F.struct("l", "p")).alias("end_ms"), F.count_if("is_error").alias("errors"), F.count("*").alias("results"))
    out = starts.join(first, ["file", "line_no", "pos"], "left")
    return out.withColumn("duration_ms", F.when(F.col("end_ms") >= F.col("at_ms"), F.col("end_ms") - F.col("at_ms")).when(F.col("end_ms").isNotNull() & F.col("at_ms").isNotNull(), 0)).fillna({"errors": 0, "results": 0})


def model_usage(recs: DataFrame, calls: DataFrame) -> DataFrame:
    """file, model, tokens, volume, calls, errors, first_line: what each model of a session did. Results count for the caller."""
    number = lambda name: F.coalesce(messages.numeric_or_null(F.try_variant_get("v", f"$.message.usage.{name}", "string")), F.lit(0.0)).cast("long")
    # a message without a model is the last known one's
    w = Window.partitionBy("file").orderBy("line_no")
    spoke = recs.withColumn("model", F.last("model", ignorenulls=True).over(w)).where("type = 'assistant' and blocks is not null and model is not null")
    said = spoke.groupBy("file", "model").agg(F.sum(number("input_tokens")).alias("input_tokens"), F.sum(number("output_tokens")).alias("output_tokens"), F.sum(number("cache_read_input_tokens")).alias("cache_tokens"), F.min("line_no").alias("first_line"))
    caller = calls.drop("model").join(spoke.select("file", "line_no", "model"), ["file", "line_no"])
    did = caller.groupBy("file", "model").agg(F.count("*").alias("calls"), F.sum("errors").alias("errors"))
    out = said.join(did, ["file", "model"], "left").fillna(0, ["calls", "errors"])
    return out.withColumn("volume", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_tokens")).where("volume > 0 or calls > 0 or errors > 0")


def with_ladders(s: DataFrame) -> DataFrame:
    """Turns and duration by the first source that a session has, provenances, quality, warnings, and the session's name."""
    span = F.col("last_event_at") - F.col("started_at")
    turns_from = F.when(F.col("declared").isNotNull(), "userMessages").when(F.col("prompts") > 0, "userMessages")
    broken = (F.col("malformed") > 0) & (F.col("malformed") == F.col("lines"))
    source = lambda c: F.when(broken, "malformed").otherwise(c)
    s = s.withColumns({
        "turns": F.coalesce("declared", "prompts"), "turns_source": source(F.when(turns_from.isNotNull(), "inferred").otherwise("missing")),
        "duration_ms": F.coalesce("took", F.when((F.col("stamps") >= 2) & (span > 0), span), F.lit(0)),
        "duration_source": source(F.when(F.col("took").isNotNull(), "measured").when((F.col("stamps") >= 2) & (span > 0), "inferred").otherwise("missing")),
        "model_source": source(F.when(F.col("model").isNotNull(), "measured").otherwise("missing")), "tokens_source": source(F.when(F.col("has_tokens"), "measured").otherwise("missing")), "cost_source": source(F.lit("missing")),
        "tool_error_rate": stats.rate(F.col("tool_errors"), F.col("tool_calls")),
        "error_tail": F.col("sorry"), "passed_tail": F.col("passed"),
        "is_subagent": (F.col("root") == 0) & (F.col("side") > 0) & (F.col("agents") == 1),
    })
    base = F.coalesce("session_id", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl$", ""))
    s = s.withColumn("session_id", F.when(F.col("is_subagent"), F.concat(base, F.lit("/agent-"), F.col("agent"))).otherwise(base))
    s = s.withColumn("quality", stats.quality_score(*(F.col(f"{c}_source") for c in ("model", "tokens", "cost", "duration", "turns")), F.col("malformed"), F.col("lines"), F.col("hook_errors"), F.col("tool_error_rate")))
    missing = [F.when(F.col(f"{c}_source") == "missing", f"{what} missing from trace") for c, what in (("model", "model"), ("tokens", "token usage"), ("cost", "cost"), ("duration", "duration"))]
    s = s.withColumn("warnings", F.array_compact(F.array(
        *missing, F.when(F.col("turns_source") == "inferred", "turn count inferred from user messages"), F.when(~F.col("has_result"), "no final result event found"),
        F.when(F.col("malformed") > 0, F.concat(F.col("malformed").cast("string"), F.lit("/"), F.col("lines").cast("string"), F.lit(" malformed line(s) skipped"))),
        F.when(F.col("hook_errors") > 0, F.concat(F.col("hook_errors").cast("string"), F.lit(" hook error(s) reported"))), F.when(F.col("is_subagent"), "source: subagent"),
    )))
    return s.withColumn("outcome", stats.outcome_score(F.col("positive"), F.col("negative"), F.col("rephrases"), F.col("error_tail"), F.col("passed_tail"), F.col("rework_files"), F.col("tool_error_rate")))


def orphans(recs: DataFrame) -> DataFrame:
    """file, uuid of parents that no record of their file has."""
    return recs.select("file", F.col("parent").alias("uuid")).where("uuid <> ''").distinct().join(recs.select("file", "uuid").distinct(), ["file", "uuid"], "left_anti")


def looks_like_transcript(heads: DataFrame) -> DataFrame:
    """heads: file, head (the first 64 KiB). Whether half of the first eight lines that are not blank look like records of talk or tools."""
    lines = F.slice(F.filter(F.split("head", "\n"), lambda x: x.rlike(r"\S")), 1, 8)
    hit = lambda x: F.coalesce(F.try_variant_get(F.try_parse_json(x), "$.type", "string").isin("user", "assistant", "system", "tool", "message", "event_msg", "response_item") | F.try_variant_get(F.try_parse_json(x), "$.role", "string").isin("user", "assistant", "system", "tool"), F.lit(False))
    n = F.size(F.filter("lines", hit))
    return heads.withColumn("lines", lines).select("file", (n >= F.greatest(F.lit(1), F.floor(F.size("lines") / 2))).alias("looks_like"))
