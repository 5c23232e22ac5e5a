"""Queries on text rules, redaction, coercions, rates and definitions, over texts that are put together from table rows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quarry.functions import grading, messages, pricing, text
from quarry.operators import jsonwalk
from quarry.plans.registry import query
from quarry.plans.views import millis, table
from quarry.sources import rollouts, sinks


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts: str | Column) -> Column:
    """Texts and columns in a row; a plain text stands for itself."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _by(column: Column, *cases: Column | str | None) -> Column:
    """The case of the remainder of column by the number of cases."""
    out = F.lit(None).cast("string")
    for i, c in enumerate(cases):
        value = F.lit(c) if isinstance(c, str) or c is None else c
        out = F.when(F.pmod(column, F.lit(len(cases))) == i, value).otherwise(out)
    return out


@query("SELECT event_id, CASE event_type WHEN 'error' THEN event_id % 3 <> 0 WHEN 'click' THEN event_id % 2 <> 0 WHEN 'view' THEN event_id % 4 <> 0 WHEN 'signup' THEN event_id % 2 = 0 ELSE false END AS is_error FROM events")
def tool_error_sniffing(spark, sf):
    i, kind = F.col("event_id"), F.col("event_type")
    out = F.when(kind == "error", _cat("Exit code: ", i % 3, "\nerror: beside it")).when(kind == "click", _cat('{"output": "error: x", "metadata": {"exit_code": ', i % 2, "}}"))
    out = out.when(kind == "view", _cat("command exited with code ", i % 4)).when(kind == "signup", F.when(i % 2 == 0, "sh: x: command not found").otherwise("terror: not one")).otherwise(_cat("all good ", F.col("props")))
    return table(spark, sf, "events").select("event_id", messages.is_tool_error(out).alias("is_error"))


@query("""SELECT conv_id, turn, './src/m' || CAST(turn AS VARCHAR) || '.rs|/home/u' || CAST(conv_id AS VARCHAR) || '/a.py|/tmp/x' || CAST(turn AS VARCHAR) || '.log' AS paths FROM conversations""")
def file_paths(spark, sf):
    said = _cat("see /home/u", F.col("conv_id"), "/a.py, and (/tmp/x", F.col("turn"), ".log). ", F.col("text"), " ./src/m", F.col("turn"), ".rs: /Users/b/*.py https://h/home/x/ /home/c/ /tmp/x", F.col("turn"), ".log")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(messages.file_paths(said), "|").alias("paths"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_us(ts) // 1000000 * 1000 - 7200000 WHEN 2 THEN epoch_us(ts) // 1000000 * 1000 WHEN 3 THEN epoch_us(ts) // 1000 END AS ms FROM events""")
def parsed_timestamps(spark, sf):
    i, at = F.col("event_id"), millis("ts")
    written = _by(i, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"), None, None, "soon")
    number = F.when(i % 5 == 2, F.floor(at / 1000)).when(i % 5 == 3, at).cast("double")
    return table(spark, sf, "events").select("event_id", messages.timestamp_ms(written, number).alias("ms"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN 0.0 WHEN 3 THEN 1.0 WHEN 6 THEN l_quantity WHEN 7 THEN 0.0 END AS number,
 CASE l_linenumber WHEN 1 THEN l_quantity <> 0 WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 6 THEN l_quantity <> 0 WHEN 7 THEN false END AS truth FROM lineitem""")
def coercions(spark, sf):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    value = F.when(n == 1, _s(q)).when(n == 2, "").when(n == 3, "True").when(n == 4, "no").when(n == 5, F.col("l_comment") if "l_comment" in table(spark, sf, "lineitem").columns else F.lit("words")).when(n == 6, _cat(" ", q, " ")).when(n == 7, "0")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", messages.numeric_or_null(value).alias("number"), messages.boolean_or_null(value).alias("truth"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN quality / 2.0 WHEN 1 THEN CAST(toxic AS DOUBLE) WHEN 4 THEN 0.25 END AS score FROM labels""")
def judge_answers(spark, sf):
    i = F.col("doc_id")
    said = _by(i, _cat('so {not json} but {"score": ', F.col("quality") / 2, ', "passed": true} end'), _cat('a {"x": {"y": 1}, "score": ', F.col("toxic"), "} or {"), _cat('{"score": ', F.col("quality") + 2, "}"), "nothing said", '{{{"score": 0.25}')
    return table(spark, sf, "labels").select("doc_id", messages.judge_score(said).alias("score"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN quality = 1 THEN 'passed' ELSE 'failed' END WHEN 1 THEN CASE WHEN toxic = 1 THEN 'failed' ELSE 'passed' END WHEN 2 THEN 'error' ELSE CASE WHEN quality + toxic = 0 THEN 'failed' ELSE 'error' END END AS verdict FROM labels""")
def rubric_answers(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    answer = _by(F.col("doc_id"), _cat('{"passed": ', F.when(q == 1, "true").otherwise("false"), ', "score": 0.1}'), _cat("verdict: ", '{"score": ', F.when(t == 1, "0.6").otherwise("0.8"), "} bye"), "no idea", _cat('{"score": ', (q + t) * 7, "}"))
    return table(spark, sf, "labels").select("doc_id", grading.rubric(answer).alias("verdict"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 3 THEN o_custkey ELSE 0 END AS passed, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 7 WHEN 1 THEN o_orderkey % 7 ELSE 0 END AS failed FROM orders""")
def test_counts(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    out = _by(k, _cat("1 passed of those before\n# pass ", c, "\n  # fail ", k % 7, " \nend"), _cat(c, " passed, ", k % 7, " failed"), "pass the salt, 7", _cat("ran ", c, " passing tests"))
    return table(spark, sf, "orders").select("o_orderkey", messages.test_count(out).alias("passed"), messages.test_count(out, "fail").alias("failed"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'other' END AS family, CASE p_partkey % 3 WHEN 0 THEN 'Alpha Large 4.' || CAST(p_size AS VARCHAR) WHEN 1 THEN 'Beta Mini ' || CAST(p_size AS VARCHAR) ELSE 'Gamma' END AS label FROM part""")
def model_names(spark, sf):
    model = _by(F.col("p_partkey"), _cat("vend/alpha-large-4-", F.col("p_size"), "-20240101"), _cat("beta_mini_", F.col("p_size")), "gamma")
    return table(spark, sf, "part").select("p_partkey", messages.model_family(model, [("alpha", "alpha"), ("beta", "beta")]).alias("family"), messages.model_label(model).alias("label"))


_KEY = "CAST(c_custkey AS VARCHAR)"


@query(f"""SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '/Users/[redacted]/w and /home/[redacted]' WHEN 1 THEN 'key [REDACTED:aws-key] of ' || {_KEY} WHEN 2 THEN '[REDACTED:github-token]' WHEN 3 THEN 'at -Users-[redacted]-w' || {_KEY}
 WHEN 4 THEN 'Authorization: Bearer [REDACTED:bearer]' WHEN 5 THEN '[REDACTED:private-key]!' ELSE 'nothing of ' || {_KEY} END AS shown FROM customer""")
def redaction_rules(spark, sf):
    k = F.col("c_custkey")
    digest = F.md5(_s(k))
    said = _by(k, _cat("/Users/u", k, "/w and /home/v", k), _cat("key AKIA", F.upper(F.substring(digest, 1, 16)), " of ", k), _cat("ghp_", F.substring(F.concat(digest, digest), 1, 36)), _cat("at -Users-u", k, "-w", k),
               _cat("Authorization: Bearer ", digest), _cat("-----BEGIN RSA PRIVATE KEY-----\n", digest, "\n-----END RSA PRIVATE KEY-----!"), _cat("nothing of ", k))
    return table(spark, sf, "customer").select("c_custkey", text.redact(said).alias("shown"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'user' || CAST(s_suppkey AS VARCHAR) WHEN 1 THEN '' ELSE 'a.b+c' || CAST(s_suppkey AS VARCHAR) END AS names,
 CASE s_suppkey % 3 WHEN 0 THEN '/home/[redacted]/x by [redacted] and user' || CAST(s_suppkey AS VARCHAR) || '-ann' WHEN 1 THEN '/Users/[redacted]/x bob' ELSE '/home/[redacted]/ [redacted] axb+c' || CAST(s_suppkey AS VARCHAR) END AS shown FROM supplier""")
def redact_named_users(spark, sf):
    k = F.col("s_suppkey")
    said = _by(k, _cat("/home/user", k, "/x by user", k, " and user", k, "-ann"), "/Users/bob/x bob", _cat("/home/a.b+c", k, "/ a.b+c", k, " axb+c", k))
    d = table(spark, sf, "supplier").select("s_suppkey", said.alias("said")).withColumn("n", text.path_users(F.col("said")))
    return d.select("s_suppkey", F.array_join("n", "|").alias("names"), text.redact_users(text.redact_paths(F.col("said")), F.col("n")).alias("shown"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '~/x' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'AKIA' || upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16)) ELSE 'plain/path' || CAST(c_custkey AS VARCHAR) END AS short, c_custkey % 3 = 1 AS secrets, c_custkey % 3 = 0 AS paths FROM customer""")
def redaction_layers(spark, sf):
    k = F.col("c_custkey")
    said = _by(k, _cat("/home/dora/x", k), _cat("AKIA", F.upper(F.substring(F.md5(_s(k)), 1, 16))), _cat("plain/path", k))
    d = table(spark, sf, "customer").select("c_custkey", said.alias("said")).withColumn("r", text.redacted_with_report(F.col("said")))
    return d.select("c_custkey", text.compact_path(F.col("said")).alias("short"), "r.secrets", "r.paths")


@query("""SELECT 'f' || CAST(conv_id AS VARCHAR) AS file, turn AS line_no, CASE WHEN (conv_id + turn) % 4 = 3 THEN 'You are a worker ' || CAST(turn AS VARCHAR) ELSE trim(text) END AS text FROM conversations WHERE (conv_id + turn) % 4 <> 1""")
def rollout_prompts(spark, sf):
    c = table(spark, sf, "conversations")
    said = _by(F.col("conv_id") + F.col("turn"), _cat("# Context from my IDE setup\nopen file\n## My request for Codex: ", F.col("text")), _cat("# AGENTS.md instructions ", F.col("text")), _cat("  ", F.col("text"), " "), _cat("You are a worker ", F.col("turn")))
    raw = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), said.alias("message")).alias("payload")))
    return rollouts.prompts(rollouts.records(c.select(_cat("f", F.col("conv_id")).alias("file"), F.col("turn").alias("line_no"), raw.alias("raw"))))


_RATE = "round(s_acctbal / 100, 4)"


def _catalogue(spark, sf):
    k, rate = F.col("s_suppkey"), F.round(F.col("s_acctbal") / 100, 4)
    return table(spark, sf, "supplier").select(_cat("m", k).alias("alias"), _cat("vend/m", k).alias("source_model"), rate.alias("input"), (rate * 2).alias("output"), F.lit(0.5).alias("cache_read"), F.lit(1.25).alias("cache_write"))


@query(f"""WITH m AS (SELECT p_partkey % (SELECT count(*) FROM supplier) + 1 AS k, CASE p_partkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'm' WHEN 2 THEN 'fam-' WHEN 3 THEN 'other ' ELSE '<synthetic>' END AS head, p_partkey % 5 AS kind FROM part),
d AS (SELECT DISTINCT CASE WHEN kind = 4 THEN head ELSE head || CAST(k AS VARCHAR) END AS model, CASE WHEN kind IN (0, 1) THEN k WHEN kind = 2 THEN 1 END AS k, kind FROM m)
SELECT model, CASE WHEN kind IN (0, 1) THEN 'listed' WHEN kind = 2 THEN 'family' WHEN kind = 3 THEN 'fallback' END AS confidence, CASE WHEN kind IN (0, 1, 2) THEN 'vend/m' || CAST(d.k AS VARCHAR) WHEN kind = 3 THEN 'fallback' END AS source_model,
 CASE WHEN kind = 3 THEN 1.0 WHEN kind < 3 THEN {_RATE} END AS rate_input, CASE WHEN kind = 3 THEN 3.0 WHEN kind < 3 THEN {_RATE} * 2 END AS rate_output FROM d LEFT JOIN supplier ON s_suppkey = d.k""")
def model_rates(spark, sf):
    n = table(spark, sf, "supplier").count()
    k = F.col("p_partkey") % n + 1
    model = _by(F.col("p_partkey"), _cat("M", k), _cat("m", k), _cat("fam-", k), _cat("other ", k), "<synthetic>")
    return pricing.rates(table(spark, sf, "part").select(model.alias("model")), _catalogue(spark, sf), [("is", "nothing", "vend/m2"), ("starts", "fam-", "vend/m1")]).select("model", "confidence", "source_model", "rate_input", "rate_output")


@query(f"""SELECT 'vend/m' || CAST(s_suppkey AS VARCHAR) AS source_model, kind, CASE kind WHEN 'input' THEN {_RATE} WHEN 'output' THEN {_RATE} * 2 WHEN 'cache_read' THEN 0.5 ELSE 1.25 END AS local, CASE WHEN s_suppkey % 5 <> 0 THEN {_RATE} * 2 + 1 END AS remote
 FROM supplier, (VALUES ('input'), ('output'), ('cache_read'), ('cache_write')) v(kind) WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 AND kind = 'output'""")
def catalogue_drift(spark, sf):
    """Local rates against a list from elsewhere that lacks some models and prices others otherwise."""
    local = _catalogue(spark, sf)
    k = F.substring("alias", 2, 20).cast("long")
    return pricing.drift(local, local.where(k % 5 != 0).withColumn("output", F.when(k % 3 == 0, F.col("output") + 1).otherwise(F.col("output"))))


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 3 = 0 THEN 'id missing; id has marks' WHEN p_partkey % 3 = 1 THEN 'id has marks' END, CASE WHEN p_partkey % 4 = 0 THEN 'prompt missing' END, CASE WHEN p_size % 3 = 0 THEN 'no grader' END,
 CASE WHEN p_partkey % 5 = 0 THEN 'unknown difficulty' END, CASE WHEN p_size > 40 THEN 'pass_threshold beyond 0 to 1' END) AS problem FROM part""")
def case_problems(spark, sf):
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select("p_partkey", _by(k, "", _cat("b ", k), _cat("c-", k)).alias("id"), F.when(k % 4 != 0, F.col("p_name") if "p_name" in table(spark, sf, "part").columns else F.col("p_brand")).alias("prompt"),
                                        F.array_repeat(F.lit("g"), F.col("p_size").cast("int") % 3).alias("graders"), F.when(k % 5 == 0, "wild").when(k % 2 == 0, "hard").alias("difficulty"), (F.col("p_size") / 40).alias("pass_threshold"), F.lit(None).cast("string").alias("_corrupt_record"))
    return sinks.problems(d).select("p_partkey", F.array_join("problems", "; ").alias("problem"))


@query("""SELECT o_orderkey, unnest(['m' || CAST(o_custkey % 5 AS VARCHAR), 'n' || CAST(o_custkey AS VARCHAR)]) AS id, unnest(['providers.a' || CAST(o_orderkey % 3 AS VARCHAR) || '.models[0].id', 'providers.a' || CAST(o_orderkey % 3 AS VARCHAR) || '.models[1].id']) AS path FROM orders WHERE o_orderkey % 4 <> 0""")
def ids_by_wildcard(spark, sf):
    """Ids found by a wildcard path in configuration documents; broken documents have none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    doc = _cat('{"default": {"id": "no"}, "providers": {"a', k % 3, '": {"models": [{"id": "m', c % 5, '", "x": {"id": "deep"}}, {"id": "n', c, '"}, {"id": 7}], "id": "up"}}}')
    docs = table(spark, sf, "orders").select("o_orderkey", messages.strict_json(F.when(k % 4 == 0, F.concat(doc, F.lit("}"))).otherwise(doc)).alias("v"))
    return jsonwalk.matching(docs, "v", "providers.*.models[*].id").select("o_orderkey", F.col("text").alias("id"), "path")


@query("""WITH l AS (SELECT conv_id, turn, unnest(['/home/u' || CAST(conv_id AS VARCHAR) || '/a.py', '/tmp/t' || CAST(turn AS VARCHAR)]) AS p FROM conversations) SELECT conv_id, p AS path, count(*) AS times FROM l GROUP BY ALL""")
def touched_files(spark, sf):
    """Paths in any string of a tool's input, however deep it lies."""
    raw = _cat('{"edits": [{"file": "/home/u', F.col("conv_id"), '/a.py", "more": [["see /tmp/t', F.col("turn"), '."]]}], "n": 3, "flag": true}')
    leaves = jsonwalk.leaves(table(spark, sf, "conversations").select("conv_id", "turn", F.try_parse_json(raw).alias("v")), "v")
    return leaves.select("conv_id", F.explode(messages.file_paths(F.col("text"))).alias("path")).groupBy("conv_id", "path").agg(F.count("*").alias("times"))


@query("""SELECT c_custkey, '/home/[redacted]/' || CAST(c_custkey AS VARCHAR) AS plain, 'key [REDACTED:aws-key]' AS deep, '/Users/[redacted]/m' AS name, '{"p":"/home/[redacted]/v"}' AS loose, c_custkey % 4 = 0 AS gone FROM customer""")
def redacted_bundle(spark, sf):
    """Texts in structs, arrays, maps and JSON values, all redacted."""
    k = F.col("c_custkey")
    key = _cat("key AKIA", F.upper(F.substring(F.md5(_s(k)), 1, 16)))
    some = table(spark, sf, "customer").select("c_custkey", _cat("/home/u", k, "/", k).alias("plain"), F.struct(F.array(F.struct(key.alias("said"), k.alias("n"))).alias("turns")).alias("deep"), F.create_map(_cat("/Users/u", k, "/m"), F.lit(1)).alias("names"),
                                               F.parse_json(_cat('{"p": "/home/u', k, '/v"}')).alias("loose"), F.when(k % 4 != 0, F.struct(key.alias("x"))).alias("empty"))
    r = sinks.redacted_rows(some)
    return r.select("c_custkey", "plain", F.col("deep.turns")[0]["said"].alias("deep"), F.col("names")[0]["key"].alias("name"), F.to_json("loose").alias("loose"), F.col("empty").isNull().alias("gone"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT '/r/' || CAST(user_id AS VARCHAR) AS file, k * 2 AS line_no, k % 3 = 2 AND k < n AND (k + 1) % 2 = 0 AS is_error, CASE WHEN k % 3 = 2 AND k < n THEN CAST(1000 AS BIGINT) END AS duration_ms FROM e WHERE k % 3 <> 0""")
def rollout_calls_of_one_id(spark, sf):
    """Each event is a call or an output of the same id: an output belongs to the last call before it, and only to that."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").withColumn("k", F.row_number().over(w))
    # two calls, then one output, over and over
    kind = F.when(F.col("k") % 3 == 0, "function_call_output").otherwise("function_call")
    at = F.lit(1_704_067_200) + F.col("k")
    raw = F.to_json(F.struct(at.alias("timestamp"), F.lit("response_item").alias("type"), F.struct(kind.alias("type"), F.lit("c").alias("call_id"), F.when(F.col("k") % 3 != 0, "f").alias("name"), F.when(F.col("k") % 3 == 0, _cat("Exit code: ", (F.col("k") % 2 == 0).cast("int"))).alias("output")).alias("payload")))
    calls = rollouts.calls(rollouts.records(e.select(_cat("/r/", F.col("user_id")).alias("file"), (F.col("k") * 2).alias("line_no"), raw.alias("raw"))))
    return calls.select("file", F.col("line_no").cast("long").alias("line_no"), "is_error", F.col("duration_ms").cast("long").alias("duration_ms"))
