"""The fold of a transcript's records to one session, in one pass: lines are scanned and parsed once and dealt out once.

Each record becomes one row for itself and one for each thing in it that is looked up by a key: tool calls and their
results (by call id), its id and its parent's (by uuid), files that are written (by path), permission modes. These rows are
dealt out by file; what came before (the last model, the last short prompt, the start that a result belongs to) is told by
windows within the file, and two steps of grouping, by file and model and by file, make the session. All of it keeps the
rows' one exchange, no step gathers a file's texts, and whatever is summed up of a file is a number or a few names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import messages, text
from quarry.sources.transcripts import READ_LIKE, WRITE_NAMES, message_text, records, with_ladders

PREVIEWS, PREVIEW_CHARS, PROMPT_CHARS, SHORT = 3, 220, 260, 600
QUEUE = ("enqueue", "dequeue", "remove", "popAll")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def _last(value: Column | str, when: Column) -> Column:
    """The value of the last line for which when holds, as a struct that can be merged."""
    return F.max(F.when(when, F.struct("line_no", F.col(value).alias("x") if isinstance(value, str) else value.alias("x"))))


def _preview(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def things(lines: DataFrame) -> DataFrame:
    """The rows that are dealt out: file, line_no, pos, kind (record, start, end, node, parent, mode), key, and their fields."""
    recs = records(lines)
    said = F.trim(message_text())
    side = F.coalesce(F.col("sidechain"), F.lit(False))
    human = F.coalesce((F.col("type") == "user") & ~side & (said != "") & ~said.startswith("<") & ~said.startswith("Caveat:"), F.lit(False))
    spoke = F.coalesce((F.col("type") == "assistant") & F.col("blocks").isNotNull(), F.lit(False))
    usage = lambda name: F.when(spoke, F.coalesce(messages.numeric_or_null(_get(f"message.usage.{name}")), F.lit(0.0)).cast("long")).otherwise(0)
    system = F.col("type") == "system"
    b = lambda x, p, t="string": F.try_variant_get(x, f"$.{p}", t)
    of_kind = lambda name: F.when(spoke, F.size(F.filter("blocks", lambda x: b(x, "type") == name))).otherwise(0)
    rows = recs.select(
        "file", "line_no", "malformed", "at_ms", "type", "session_id", "sidechain", "agent", "model", "uuid", "parent", "blocks", human.alias("human"), said.alias("text"), spoke.alias("spoke"),
        usage("input_tokens").alias("input"), usage("output_tokens").alias("output"), usage("cache_read_input_tokens").alias("cache"),
        F.coalesce(spoke & (_get("message.usage.input_tokens").isNotNull() | _get("message.usage.output_tokens").isNotNull()), F.lit(False)).alias("measured"),
        F.when(system, _get("turnCount", "long")).alias("declared"), F.when(system, F.coalesce(_get("totalDurationMs", "long"), _get("durationMs", "long"))).alias("took"), F.when(system, F.coalesce(_get("hookErrors", "long"), F.lit(0))).otherwise(0).alias("hooks"),
        of_kind("text").alias("texts"), of_kind("thinking").alias("thoughts"), _get("permissionMode").alias("mode"), _get("gitBranch").alias("branch"), _get("entrypoint").alias("entrypoint"), _get("userType").alias("user_type"),
        F.when(F.col("type") == "queue-operation", _get("operation")).alias("operation"), F.when(F.col("type") == "queue-operation", _preview(_get("content"), PREVIEW_CHARS)).alias("queued"),
        F.when(F.col("type") == "last-prompt", _preview(_get("lastPrompt"), PROMPT_CHARS)).alias("prompt"), F.when(F.col("type") == "custom-title", _get("customTitle")).alias("title"),
    )
    thing = lambda kind, key, pos=F.lit(-1), **more: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), pos.cast("int").alias("pos"), *(more.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("tool", "string"), ("target", "string"), ("argument", "string"), ("is_error", "boolean"))))
    block = lambda when, kind, make: F.when(when, F.filter(F.transform(F.coalesce("blocks", F.array().cast("array<variant>")), lambda x, i: F.when(b(x, "type") == kind, make(x, i))), lambda x: x.isNotNull())).otherwise(F.array())
    starts = block(spoke, "tool_use", lambda x, i: thing("start", b(x, "id"), i, tool=b(x, "name"), target=F.coalesce(b(x, "input.file_path"), b(x, "input.path")), argument=F.coalesce(b(x, "input.skill"), b(x, "input.command"), b(x, "input.name"))))
    ends = block(F.col("type") == "user", "tool_result", lambda x, i: thing("end", b(x, "tool_use_id"), i, is_error=F.coalesce(b(x, "is_error", "boolean"), F.lit(False))))
    single = F.array_compact(F.array(thing("record", F.lit(None)), F.when(F.col("uuid").isNotNull(), thing("node", F.col("uuid"))), F.when(F.col("parent") != "", thing("parent", F.col("parent"))), F.when(F.col("mode").isNotNull(), thing("mode", F.col("mode")))))
    fields = [c for c in rows.columns if c not in ("file", "line_no", "blocks", "uuid", "parent", "mode", "model", "text", "spoke")]
    record = F.col("t.kind") == "record"
    # what is said is looked at here, so that no long text is dealt out
    mood = text.sentiment(F.col("text"))
    short = F.col("human") & (F.length("text") <= SHORT)
    rows = rows.withColumns({
        "mood": F.when(short, mood), "words": F.when(short, F.col("text")), "judge": (F.col("type") == "user") & ~F.coalesce(F.col("sidechain"), F.lit(False)) & F.col("text").startswith(messages.JUDGE_STUB),
        "tail": F.when(F.col("spoke") & (F.col("text") != ""), F.struct(messages.is_apology(F.col("text")).alias("sorry"), messages.tests_passed(F.col("text")).alias("passed"))),
    })
    out = rows.withColumn("t", F.explode(F.concat(single, starts, ends)))
    kept = [F.when(record, F.col(c)).alias(c) for c in [*fields, "mood", "words", "judge", "tail"]]
    return out.select("file", "line_no", "t.*", F.when(F.col("t.kind").isin("record", "start"), F.col("model")).alias("model"), (F.col("spoke") & record).alias("spoke"), *kept)


def fold(lines: DataFrame) -> DataFrame:
    """One row for each file: identity, times, tokens, tools, signals, queue, modes, provenances, quality and warnings."""
    dealt = things(lines).repartition(F.col("file"))
    kind = lambda k: F.col("kind") == k
    line = Window.partitionBy("file").orderBy("line_no", "pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("line_no", "pos").rowsBetween(Window.unboundedPreceding, -1)
    s = dealt.withColumns({
        "model": F.last("model", ignorenulls=True).over(line), "before": F.last("words", ignorenulls=True).over(earlier), "queued_so_far": F.count("queued").over(line),
    })
    # by key: the start that a result follows; whether a parent's id is there; how often a file was written
    name = F.lower("tool")
    by_key = Window.partitionBy("file", "group", "key")
    group = F.when(F.col("kind").isin("start", "end"), "call").when(F.col("kind").isin("node", "parent"), "id").otherwise(F.col("kind"))
    ordered = by_key.orderBy("line_no", "pos")
    s = s.withColumn("group", group)
    s = s.withColumns({
        "start": F.last(F.when(kind("start") & F.col("key").isNotNull(), F.struct("model", F.lit(True).alias("there"))), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
        "known": F.max(kind("node").cast("int")).over(by_key), "nth": F.row_number().over(ordered),
    })
    s = s.withColumn("path", F.when(kind("start") & name.rlike("^(?:" + "|".join(WRITE_NAMES) + ")"), F.col("target")))
    s = s.withColumn("written", F.row_number().over(Window.partitionBy("file", "path").orderBy("line_no", "pos")))
    failed = kind("end") & F.col("start.there") & F.col("is_error")
    s = s.withColumn("of", F.when(kind("end"), F.col("start.model")).when(kind("start") | (kind("record") & F.col("spoke")), F.col("model"))).withColumn("mode", F.when(kind("mode"), F.col("key")))
    is_side = F.coalesce(F.col("sidechain"), F.lit(False))
    sums = {
        "lines": kind("record"), "malformed": F.col("malformed"), "prompts": F.col("human"), "attachments": F.col("type") == "attachment", "snapshots": F.col("type") == "file-history-snapshot", "side": kind("record") & is_side, "root": kind("record") & ~F.coalesce(F.col("sidechain"), F.lit(True)),
        "positive": F.col("mood") == "positive", "negative": F.col("mood") == "negative", "rephrases": F.col("words").isNotNull() & F.coalesce(text.is_rephrase(F.col("words"), F.col("before")), F.lit(False)),
        "tool_calls": kind("start"), "tool_errors": failed, "reads": kind("start") & name.rlike("|".join(READ_LIKE)), "writes": kind("start") & (name.contains("write") | name.contains("edit")), "subagents": kind("start") & F.col("tool").isin("Task", "Agent"),
        "orphans": kind("parent") & (F.col("known") == 0) & (F.col("nth") == 1), "rework_files": F.col("path").isNotNull() & (F.col("written") == 2), "queue_operations": F.col("type") == "queue-operation", "modes_seen": kind("mode"),
        **{f"queue_{q.lower()}": F.col("operation") == q for q in QUEUE},
    }
    first = s.groupBy("file", "of", "mode").agg(
        *(F.count_if(c).alias(n) for n, c in sums.items()), *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(n) for n, c in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_tokens", "cache"), ("hook_errors", "hooks"), ("text_blocks", "texts"), ("thinking_blocks", "thoughts"))),
        F.min("at_ms").alias("started_at"), F.max("at_ms").alias("last_event_at"), F.count("at_ms").alias("stamps"), F.max("measured").alias("has_tokens"), F.max(kind("record") & (F.col("type") == "result")).alias("has_result"), F.max("took").alias("took"), F.max("judge").alias("stub"),
        F.min("agent").alias("agent"), F.max("agent").alias("last_agent"), F.min(F.when(F.col("spoke"), F.col("line_no"))).alias("first_line"),
        *(_last(c, when).alias(c) for c, when in (("session_id", F.col("session_id") != ""), ("declared", F.col("declared").isNotNull()), ("tail", F.col("tail").isNotNull()), ("branch", F.col("branch") != ""), ("entrypoint", F.col("entrypoint") != ""), ("user_type", F.col("user_type").isNotNull()), ("prompt", F.col("prompt").isNotNull()), ("title", F.col("title").isNotNull()))),
        F.collect_set(F.when(kind("start"), text.mcp_server(F.col("tool")))).alias("mcp_servers"), F.collect_set(F.when(kind("start") & (F.col("tool") == "Skill"), F.col("argument"))).alias("skills"),
        F.collect_list(F.when(F.col("queued").isNotNull() & (F.col("queued_so_far") <= PREVIEWS), F.struct("line_no", "queued"))).alias("queue_preview"),
    )
    volume = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_tokens")
    used = F.col("of").isNotNull() & F.col("first_line").isNotNull() & ((volume > 0) | (F.col("tool_calls") > 0) | (F.col("tool_errors") > 0))
    total = [*sums, "input_tokens", "output_tokens", "cache_tokens", "hook_errors", "text_blocks", "thinking_blocks", "stamps"]
    merged_set = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    out = first.groupBy("file").agg(
        *(F.sum(c).alias(c) for c in total), F.min("started_at").alias("started_at"), F.max("last_event_at").alias("last_event_at"), *(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("has_tokens", "has_result", "stub")), F.max("took").alias("took"),
        F.min("agent").alias("agent"), F.max("last_agent").alias("last_agent"), *(F.max(c)["x"].alias(c) for c in ("session_id", "declared", "tail", "branch", "entrypoint", "user_type", "prompt", "title")), merged_set("mcp_servers"), merged_set("skills"),
        F.transform(F.array_sort(F.flatten(F.collect_list("queue_preview"))), lambda x: x["queued"]).alias("queue_preview"), F.count_if(used).alias("models"),
        F.max(F.when(used, F.struct(volume.alias("volume"), F.col("tool_calls").alias("calls"), (-F.col("first_line")).alias("early"), F.col("of").alias("model"))))["model"].alias("model"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("mode").isNotNull(), F.struct("mode", F.col("modes_seen").alias("n")))))).alias("permission_modes"),
    )
    agents = F.when(F.col("agent").isNull(), 0).when(F.col("agent") == F.col("last_agent"), 1).otherwise(2)
    out = out.where("not stub").withColumn("agents", agents).withColumn("sorry", F.coalesce(F.col("tail.sorry"), F.lit(False))).withColumn("passed", F.coalesce(F.col("tail.passed"), F.lit(False)))
    return with_ladders(out.drop("tail", "last_agent", "modes_seen", "stub"))
