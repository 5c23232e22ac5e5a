"""Queries on transcripts: JSON lines that are written from the conversations, parsed and folded to sessions again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import evaluation
from quarry.plans.registry import query
from quarry.plans.views import table
from quarry.sources import fold, transcripts
from quarry.sources.lines import numbered_lines
from quarry.sources.shared import application_dir
from quarry.streaming import collect

START = 1_704_067_200_000
TOOLS = ["Read", "Edit", "mcp__srv__go", "Task", "Skill"]
#: What users say, by the remainder of conversation plus turn.
SAID = ["Thanks, that works now", "no", "add page {} to the site menu", "still failing on main", "add page {} to the site menu again", "<context>put in front</context>"]


def _iso(ms: Column) -> Column:
    ts = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.date_format(F.timestamp_add("MILLISECOND", ms, ts.cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def lines(spark, sf) -> DataFrame:
    """file, line_no, raw: a line for each turn, one for each tool's result, and some that are broken."""
    c = table(spark, sf, "conversations")
    conv, turn, n = F.col("conv_id"), F.col("turn"), F.col("conv_id") + F.col("turn")
    at = START + conv * 3_600_000 + turn * 61_000
    side = conv % 13 == 0
    call = F.concat(F.lit("t"), conv.cast("string"), F.lit("-"), turn.cast("string"))
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), (conv % 5 + 1).cast("int"))
    says = F.element_at(F.array(*(F.replace(F.lit(s), F.lit("{}"), conv.cast("string")) for s in SAID)), (n % 6 + 1).cast("int"))
    tail = F.when(conv % 4 == 0, "All tests passed.").when(conv % 4 == 1, "Sorry, I was unable to finish.").otherwise(F.col("text"))
    common = {
        "uuid": F.concat_ws("-", conv.cast("string"), turn.cast("string")), "parentUuid": F.when(conv % 8 == 0, F.concat(F.lit("gone"), turn.cast("string"))).when(turn > 0, F.concat_ws("-", conv.cast("string"), (turn - 1).cast("string"))),
        "sessionId": F.concat(F.lit("s"), conv.cast("string")), "timestamp": _iso(at), "isSidechain": side, "agentId": F.when(side, F.concat(F.lit("a"), conv.cast("string"))),
    }
    row = lambda **more: F.to_json(F.struct(*(v.alias(k) for k, v in (common | more).items())))
    text_block = F.struct(F.lit("text").alias("type"), tail.alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<file_path:string,skill:string>").alias("input"))
    tool_block = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), call.alias("id"), tool.alias("name"), F.struct(F.concat(F.lit("/home/u/f"), (conv % 2).cast("string"), F.lit(".py")).alias("file_path"), F.concat(F.lit("k"), (conv % 2).cast("string")).alias("skill")).alias("input"))
    called = n % 3 != 0
    usage = F.struct(F.length("text").alias("input_tokens"), (turn * 10).alias("output_tokens"), (conv % 10).alias("cache_read_input_tokens"))
    model = F.when((conv % 5 == 0) & (turn == 1), "<synthetic>").otherwise(F.concat(F.lit("m"), (turn % 3).cast("string")))
    assistant = row(type=F.lit("assistant"), message=F.struct(model.alias("model"), F.when(called, F.array(text_block, tool_block)).otherwise(F.array(text_block)).alias("content"), usage.alias("usage")))
    user = row(type=F.lit("user"), message=F.struct(says.alias("content")))
    system = row(type=F.lit("system"), turnCount=F.lit(3), durationMs=F.lit(1234), hookErrors=F.lit(1))
    raw = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(system)
    result = F.to_json(F.struct(F.lit("user").alias("type"), _iso(at + 500 * (1 + conv % 3)).alias("timestamp"), side.alias("isSidechain"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), (n % 5 == 0).alias("is_error"), F.lit("out").alias("content"))).alias("content")).alias("message")))
    file = F.concat(F.lit("/data/proj-"), (conv % 7).cast("string"), F.lit("/c"), conv.cast("string"), F.lit(".jsonl"))
    one = c.select(file.alias("file"), (turn * 3).alias("line_no"), raw.alias("raw"))
    two = c.where((F.col("role") == "assistant") & called).select(file.alias("file"), (turn * 3 + 1).alias("line_no"), result.alias("raw"))
    three = c.where((conv % 9 == 0) & (turn == 1)).select(file.alias("file"), (turn * 3 + 2).alias("line_no"), F.lit("{broken").alias("raw"))
    blank = c.where((conv % 9 == 1) & (turn == 1)).select(file.alias("file"), (turn * 3 + 2).alias("line_no"), F.lit("  ").alias("raw"))
    return one.union(two).union(three).union(blank)


_C = f"""c AS (SELECT conv_id, turn, role, text, conv_id + turn AS n, conv_id % 13 = 0 AS side, '/data/proj-' || CAST(conv_id % 7 AS VARCHAR) || '/c' || CAST(conv_id AS VARCHAR) || '.jsonl' AS file,
 {START} + conv_id * 3600000 + turn * 61000 AS ms, role = 'assistant' AND (conv_id + turn) % 3 <> 0 AS called, CASE WHEN role = 'assistant' AND (conv_id % 5 <> 0 OR turn <> 1) THEN 'm' || CAST(turn % 3 AS VARCHAR) END AS own,
 ['Read', 'Edit', 'mcp__srv__go', 'Task', 'Skill'][CAST(conv_id % 5 AS INT) + 1] AS tool FROM conversations),
d AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS model FROM c)"""


@query(f"""WITH {_C},
h AS (SELECT *, n % 6 AS kind FROM c WHERE role = 'user' AND NOT side AND n % 6 <> 5),
r AS (SELECT conv_id, count(*) FILTER (kind = 4 AND before = 2) AS rephrases FROM (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM h) GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS prompts, count(*) FILTER (kind = 0) AS positive, count(*) FILTER (kind IN (1, 3)) AS negative FROM h GROUP BY conv_id),
u AS (SELECT conv_id, model, sum(length(text) + turn * 10 + conv_id % 10) AS volume, count(*) FILTER (called) AS calls, min(turn) AS t FROM d WHERE role = 'assistant' AND model IS NOT NULL GROUP BY conv_id, model),
m AS (SELECT conv_id, model, count(*) OVER (PARTITION BY conv_id) AS models FROM u QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY volume DESC, calls DESC, t) = 1),
o AS (SELECT conv_id, count(*) AS orphans FROM c WHERE conv_id % 8 = 0 GROUP BY conv_id),
b AS (SELECT conv_id, file, count(*) + count(*) FILTER (called) + CAST(bool_or(conv_id % 9 = 0 AND turn = 1) AS INT) AS lines, CAST(bool_or(conv_id % 9 = 0 AND turn = 1) AS INT) AS malformed, min(ms) AS started_at,
  max(ms + CASE WHEN called THEN 500 * (1 + conv_id % 3) ELSE 0 END) AS last_event_at, count(*) + count(*) FILTER (called) AS stamps, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS input_tokens, sum(CASE WHEN role = 'assistant' THEN turn * 10 ELSE 0 END) AS output_tokens,
  count(*) FILTER (called) AS tool_calls, count(*) FILTER (called AND n % 5 = 0) AS tool_errors, count(*) FILTER (role = 'assistant') AS replies, count(*) FILTER (role = 'system') AS systems, bool_or(side) AS side FROM c GROUP BY conv_id, file),
f AS (SELECT b.*, coalesce(prompts, 0) AS prompts, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(rephrases, 0) AS rephrases, model, coalesce(models, 0) AS models, coalesce(orphans, 0) AS orphans,
  CASE WHEN systems > 0 THEN 'inferred' WHEN coalesce(prompts, 0) > 0 THEN 'inferred' ELSE 'missing' END AS turns_source, CASE WHEN systems > 0 THEN 'measured' WHEN stamps >= 2 AND last_event_at > started_at THEN 'inferred' ELSE 'missing' END AS duration_source
  FROM b LEFT JOIN s USING (conv_id) LEFT JOIN r USING (conv_id) LEFT JOIN m USING (conv_id) LEFT JOIN o USING (conv_id))
SELECT file, 's' || CAST(conv_id AS VARCHAR) || CASE WHEN side THEN '/agent-a' || CAST(conv_id AS VARCHAR) ELSE '' END AS session_id, lines, CAST(malformed AS BIGINT) AS malformed, started_at, last_event_at, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, tool_calls, tool_errors,
 CASE WHEN systems > 0 THEN 3 WHEN prompts > 0 THEN prompts END AS turns, turns_source, CASE WHEN systems > 0 THEN 1234 WHEN last_event_at > started_at THEN last_event_at - started_at ELSE 0 END AS duration_ms, duration_source, positive, negative, rephrases, models, model, orphans,
 replies > 0 AND conv_id % 4 = 1 AS error_tail, replies > 0 AND conv_id % 4 = 0 AS passed_tail, CASE WHEN conv_id % 5 = 1 AND tool_calls >= 2 THEN 1 ELSE 0 END AS rework_files, CASE WHEN conv_id % 5 = 3 THEN tool_calls ELSE 0 END AS subagents,
 100 - CASE WHEN model IS NULL THEN 12 ELSE 0 END - CASE WHEN replies = 0 THEN 14 ELSE 0 END - 8 - CASE WHEN duration_source = 'missing' THEN 12 ELSE 0 END - CASE turns_source WHEN 'missing' THEN 8 ELSE 3 END
  - CASE WHEN malformed > 0 THEN least(20, CAST(ceil(malformed * 100.0 / lines) AS BIGINT)) ELSE 0 END - CASE WHEN systems > 0 THEN 2 ELSE 0 END - CASE WHEN tool_calls > 0 AND tool_errors / tool_calls > 0.25 THEN 6 ELSE 0 END AS quality,
 concat_ws('; ', CASE WHEN model IS NULL THEN 'model missing from trace' END, CASE WHEN replies = 0 THEN 'token usage missing from trace' END, 'cost missing from trace', CASE WHEN duration_source = 'missing' THEN 'duration missing from trace' END, CASE WHEN turns_source = 'inferred' THEN 'turn count inferred from user messages' END,
  'no final result event found', CASE WHEN malformed > 0 THEN '1/' || CAST(lines AS VARCHAR) || ' malformed line(s) skipped' END, CASE WHEN systems > 0 THEN '1 hook error(s) reported' END, CASE WHEN side THEN 'source: subagent' END) AS warnings FROM f""")
def session_fold(spark, sf):
    s = fold.fold(lines(spark, sf))
    return s.select("file", "session_id", "lines", "malformed", "started_at", "last_event_at", "input_tokens", "output_tokens", "tool_calls", "tool_errors", F.when(F.col("turns_source") != "missing", F.col("turns")).alias("turns"), "turns_source", "duration_ms", "duration_source", "positive", "negative", "rephrases", "models", "model", "orphans",
                    "error_tail", "passed_tail", "rework_files", "subagents", "quality", F.array_join("warnings", "; ").alias("warnings"))


def _files(spark, sf) -> str:
    """The transcripts as files of JSON lines, one a folder, in the shared folder."""
    path = f"{application_dir(spark)}/sessions-{uuid.uuid4().hex}"
    name = F.regexp_extract("file", r"/(c\d+)\.jsonl$", 1)
    # small files cost by their number, not their bytes, by which Spark would put them into a few tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    ordered = lines(spark, sf).select(name.alias("name"), "line_no", "raw").repartition(tasks, F.col("name")).sortWithinPartitions("name", "line_no")
    ordered.select("name", "raw").write.partitionBy("name").text(path)
    return path


def _folder_name() -> Column:
    return F.regexp_extract("file", r"name=([^/]+)/", 1)


@query("""SELECT 'c' || CAST(conv_id AS VARCHAR) AS name, count(*) + count(*) FILTER (role = 'assistant' AND (conv_id + turn) % 3 <> 0) + count(*) FILTER (conv_id % 9 IN (0, 1) AND turn = 1) AS lines,
 count(*) FILTER (role = 'system') AS systems FROM conversations GROUP BY conv_id""")
def lines_of_files(spark, sf):
    """Files that are read in blocks: numbers go from 0 to the last without a gap, whichever task read a line."""
    read = numbered_lines(spark, _files(spark, sf), "*.txt").withColumn("name", _folder_name())
    g = read.groupBy("name").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.count_distinct("line_no").alias("d"), F.count_if(F.col("raw").contains('"turnCount":3')).alias("systems"))
    return g.select("name", F.when((F.col("last") == F.col("n") - 1) & (F.col("d") == F.col("n")), F.col("n")).alias("lines"), "systems")


@query(f"""WITH {_C} SELECT 'c' || CAST(conv_id AS VARCHAR) AS name, 's' || CAST(conv_id AS VARCHAR) || CASE WHEN any_value(side) THEN '/agent-a' || CAST(conv_id AS VARCHAR) ELSE '' END AS session_id, count(*) FILTER (called) AS tool_calls, count(*) FILTER (called AND n % 5 = 0) AS tool_errors,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS input_tokens, min(ms) AS started_at FROM c GROUP BY conv_id""")
def sessions_of_files(spark, sf):
    """The fold of files that are read."""
    s = fold.fold(numbered_lines(spark, _files(spark, sf), "*.txt"))
    return s.select(_folder_name().alias("name"), "session_id", "tool_calls", "tool_errors", "input_tokens", "started_at")


@query(f"""WITH {_C} SELECT 'c' || CAST(conv_id AS VARCHAR) AS name, count(*) FILTER (called) AS tool_calls, CAST(bool_or(conv_id % 9 = 0 AND turn = 1) AS BIGINT) AS malformed, CAST(0 AS BIGINT) AS attempts FROM c GROUP BY conv_id""")
def collected_sessions(spark, sf):
    """The same files, collected by micro-batches into a stored cache with its ledger of failures."""
    cache = f"{application_dir(spark)}/cache-{uuid.uuid4().hex}"
    files = _files(spark, sf)
    collect.run(spark, files, cache, f"{cache}-offsets", "*.txt", most=100)
    s = collect.sessions(spark, cache)
    known = collect.failures(spark, cache)
    return s.join(known, "file", "left").select(_folder_name().alias("name"), "tool_calls", "malformed", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"))


_EVENT = f"""e AS (SELECT *, 'u' || CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line FROM events)"""


@query(f"""WITH {_EVENT}, q AS (SELECT file, event_id, row_number() OVER (PARTITION BY file ORDER BY line) AS k FROM e WHERE event_type = 'click')
SELECT file, count(*) FILTER (event_type IN ('click', 'view')) AS queue_operations, count(*) FILTER (event_type = 'click') AS queue_enqueue, count(*) FILTER (event_type = 'view') AS queue_dequeue,
 coalesce((SELECT string_agg('c' || CAST(q.event_id AS VARCHAR), ' ' ORDER BY k) FROM q WHERE q.file = e.file AND k <= 3), '') AS preview,
 concat_ws(' ', CASE WHEN count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) > 0 THEN 'auto:' || CAST(count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) AS VARCHAR) END, CASE WHEN count(*) FILTER (event_type = 'error' AND event_id % 2 = 1) > 0 THEN 'plan:' || CAST(count(*) FILTER (event_type = 'error' AND event_id % 2 = 1) AS VARCHAR) END) AS modes,
 't' || CAST(max(event_id) FILTER (event_type = 'purchase') AS VARCHAR) AS title, 'b' || CAST(arg_max(event_id, line) % 4 AS VARCHAR) AS branch FROM e GROUP BY file""")
def session_extras(spark, sf):
    """Queue operations, modes, previews, titles and branches of sessions, each event a line."""
    e = table(spark, sf, "events")
    i = F.col("event_id").cast("string")
    kind = F.when(F.col("event_type").isin("click", "view"), "queue-operation").when(F.col("event_type") == "error", "user").when(F.col("event_type") == "purchase", "custom-title").otherwise("last-prompt")
    of = lambda name, value: F.when(F.col("event_type") == name, value)
    raw = F.to_json(F.struct(kind.alias("type"), F.when(F.col("event_type") == "click", "enqueue").when(F.col("event_type") == "view", "dequeue").alias("operation"), of("click", F.concat(F.lit("c"), i)).alias("content"),
                             of("error", F.when(F.col("event_id") % 2 == 0, "auto").otherwise("plan")).alias("permissionMode"), of("purchase", F.concat(F.lit("t"), i)).alias("customTitle"), of("signup", i).alias("lastPrompt"), F.concat(F.lit("b"), (F.col("event_id") % 4).cast("string")).alias("gitBranch")))
    s = fold.fold(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("line_no"), raw.alias("raw")))
    modes = F.array_join(F.transform(F.map_entries("permission_modes"), lambda m: F.concat_ws(":", m["key"], m["value"].cast("string"))), " ")
    return s.select("file", "queue_operations", "queue_enqueue", "queue_dequeue", F.array_join("queue_preview", " ").alias("preview"), modes.alias("modes"), "title", "branch")


@query(f"""WITH {_C} SELECT file, tool, count(*) AS calls, count(*) FILTER (n % 5 = 0) AS errors, CAST(min(500 * (1 + conv_id % 3)) AS BIGINT) AS shortest, CAST(max(500 * (1 + conv_id % 3)) AS BIGINT) AS longest FROM c WHERE called GROUP BY file, tool""")
def tool_calls_paired(spark, sf):
    calls = transcripts.tool_calls(transcripts.records(lines(spark, sf)))
    return calls.groupBy("file", "tool").agg(F.count("*").alias("calls"), F.sum("errors").alias("errors"), F.min("duration_ms").cast("long").alias("shortest"), F.max("duration_ms").cast("long").alias("longest"))


@query(f"""WITH {_C} SELECT file, model, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(turn * 10) AS BIGINT) AS output_tokens, count(*) FILTER (called) AS calls, count(*) FILTER (called AND n % 5 = 0) AS errors FROM d WHERE role = 'assistant' AND model IS NOT NULL GROUP BY file, model""")
def transcript_model_usage(spark, sf):
    recs = transcripts.records(lines(spark, sf))
    return transcripts.model_usage(recs, transcripts.tool_calls(recs)).select("file", "model", "input_tokens", "output_tokens", "calls", "errors")


@query(f"""WITH {_C}, t AS (SELECT file, 'user' AS role, 'info' AS severity FROM c WHERE role = 'user' UNION ALL SELECT file, 'assistant', 'info' FROM c WHERE role = 'assistant' UNION ALL SELECT file, 'tool', 'info' FROM c WHERE called UNION ALL SELECT file, 'tool', CASE WHEN n % 5 = 0 THEN 'error' ELSE 'info' END FROM c WHERE called)
SELECT file, role, severity, count(*) AS turns FROM t GROUP BY ALL""")
def transcript_turns(spark, sf):
    return transcripts.turns(transcripts.records(lines(spark, sf))).groupBy("file", "role", "severity").agg(F.count("*").alias("turns"))


@query(f"""WITH {_C}, f AS (SELECT DISTINCT file, conv_id FROM c), n AS (SELECT file, conv_id, row_number() OVER (ORDER BY conv_id % 50 DESC, file) AS place FROM f QUALIFY place <= 100)
SELECT file, place, file LIKE '%/archived_sessions/%' AS archived FROM n WHERE conv_id % 3 <> 0 ORDER BY place LIMIT 20""")
def newest_sessions(spark, sf):
    all_ = lines(spark, sf).select("file").distinct()
    conv = F.regexp_extract("file", r"c(\d+)\.jsonl$", 1).cast("long")
    files = all_.withColumn("mtime_ms", conv % 50)
    return transcripts.archived(transcripts.newest(files, all_.where(conv % 3 != 0), 20)).select("file", F.col("place").cast("long").alias("place"), "archived")


@query(f"WITH {_C} SELECT DISTINCT file FROM c WHERE starts_with(file, '/data/proj-3/')")
def files_below_folder(spark, sf):
    return transcripts.below(lines(spark, sf).select("file").distinct(), "/data/proj-3")


@query(f"WITH {_C} SELECT DISTINCT file, true AS looks_like FROM c UNION ALL SELECT '/data/notes.txt', false")
def transcript_lookalikes(spark, sf):
    heads = lines(spark, sf).groupBy("file").agg(F.substring(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), 1, 12), lambda x: x["raw"]), "\n"), 1, 1 << 16).alias("head"))
    other = spark.createDataFrame([("/data/notes.txt", "dear diary\n\n{}\n[1]\nall is well")], "file string, head string")
    return transcripts.looks_like_transcript(heads.union(other))


@query("""WITH f AS (SELECT l_orderkey AS file, l_returnflag AS tool, list_sort(list(l_quantity)) AS d, count(*) FILTER (l_discount > 0.08) AS errors FROM lineitem GROUP BY ALL)
SELECT file, tool, CAST(len(d) AS BIGINT) AS n, d[least(len(d) - 1, CAST(floor(len(d) * 0.5) AS INT)) + 1] AS p50, d[least(len(d) - 1, CAST(floor(len(d) * 0.95) AS INT)) + 1] AS p95, list_max(d) AS longest, errors FROM f QUALIFY row_number() OVER (PARTITION BY file ORDER BY len(d) DESC, tool) <= 2""")
def tool_duration_summary(spark, sf):
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("tool"), F.col("l_quantity").alias("duration"), (F.col("l_discount") > 0.08).alias("is_error"))
    return evaluation.tool_durations(calls, most=2)
