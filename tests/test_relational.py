"""What SQL over the given tables does not show: files, streams, greedy choices, odd rows."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import grading, messages, pricing, stats, text
from quarry.operators import evaluation, insights, lists, search, sessions
from quarry.sources import fold, sinks, transcripts
from quarry.sources.lines import numbered_lines
from quarry.streaming import events


def test_change_points_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(s, i, 1000 * i, rng.choice([0.5, 2.0, 3.0, 3.5]) + rng.random() * (rng.random() < 0.3), float(i), float(i + s)) for s in range(3) for i in sorted(rng.sample(range(1500), 150))]
    d = spark.createDataFrame(rows, "series int, i long, at_ms long, z double, before double, after double")
    want = []
    for s in range(3):
        taken = []
        for r in sorted((r for r in rows if r[0] == s and r[3] >= 3.0), key=lambda r: (-r[3], r[1])):
            if all(abs(r[1] - t[1]) >= 25 for t in taken):
                taken.append(r)
        want += taken
    want = sorted(((round(r[3], 6), r[0], r[1]) for r in want), key=lambda r: (-r[0], r[1], r[2]))[:12]
    got = [(r.z, r.series, r.i) for r in insights.change_points(d, 25, 3.0, 12).collect()]
    assert got == want and len(want) == 12
    assert insights.change_points(d.limit(0)).count() == 0


def test_impact_by_brute_force(spark):
    rng = random.Random(6)
    day = 86_400_000
    points = [(rng.randint(0, 40) * day // 2 + rng.randint(0, 3), i, rng.random(), rng.random()) for i in range(300)]
    marks = [("k", f"m{j}", rng.choice([points[j][0], rng.randint(-day, 25 * day)])) for j in range(12)]
    p = spark.createDataFrame(points, "at_ms long, ord long, cost double, error_rate double")
    m = spark.createDataFrame(marks, "kind string, name string, first_seen_at long")
    got = {r.name: (r.n_before, r.n_after, r.cost_delta) for r in insights.impact(p, m).collect()}
    mid = lambda v: 0.0 if not v else (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    for _, name, t in marks:
        before = sorted((x for x in points if x[0] < t), key=lambda x: (-x[0], -x[1]))[:20]
        after = sorted((x for x in points if x[0] >= t), key=lambda x: (x[0], x[1]))[:20]
        assert got[name] == (len(before), len(after), pytest.approx(mid([x[2] for x in after]) - mid([x[2] for x in before]), abs=1e-6))


def test_transcript_files(spark, tmp_path):
    root = tmp_path / "root"
    lines = [
        json.dumps({"type": "user", "uuid": "1", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "isSidechain": False, "message": {"content": "please fix it"}}),
        "", "{bad", '{"a": 1} trailing',
        json.dumps({"type": "assistant", "uuid": "2", "parentUuid": "1", "timestamp": 1704067260, "isSidechain": False, "message": {"model": "m", "content": [{"type": "tool_use", "id": "t", "name": "Edit", "input": {"file_path": "/home/u/a"}}], "usage": {"input_tokens": 5, "output_tokens": "7"}}}),
        json.dumps({"type": "user", "timestamp": "2024-01-01T00:01:02.500Z", "isSidechain": False, "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True}, {"type": "tool_result", "tool_use_id": "other", "is_error": True}]}}),
    ]
    (root / "p" / "deep" / "er").mkdir(parents=True)
    (root / "p" / "one.jsonl").write_text("\n".join(lines))
    (root / "p" / "deep" / "er" / "two.jsonl").write_text("{}\n")
    (root / "p" / "other.txt").write_text("x")
    files = transcripts.list_files(spark, str(root), depth=2)
    assert [(r.project, r.size) for r in files.collect()] == [("p", len("\n".join(lines)))]
    assert transcripts.list_files(spark, str(root)).count() == 2
    raw = numbered_lines(spark, str(root / "p" / "one.jsonl"))
    assert [r.raw for r in raw.orderBy("line_no").collect()] == lines
    s = fold.fold(raw).collect()
    assert len(s) == 1
    s = s[0]
    assert (s.session_id, s.lines, s.malformed, s.prompts, s.turns, s.input_tokens, s.output_tokens) == ("s", 5, 2, 1, 1, 5, 7)
    assert (s.tool_calls, s.tool_errors, s.duration_ms, s.duration_source, s.model, s.orphans) == (1, 1, 62_500, "inferred", "m", 0)
    assert s.warnings[-1] == "2/5 malformed line(s) skipped"
    call = transcripts.tool_calls(transcripts.records(raw)).first()
    assert (call.tool, call.duration_ms, call.errors, call.target) == ("Edit", 2500, 1, "/home/u/a")
    assert fold.fold(raw.limit(0)).count() == 0
    broken = spark.createDataFrame([("f", 0, "{x"), ("f", 1, "no")], "file string, line_no int, raw string")
    b = fold.fold(broken).first()
    assert {b.model_source, b.tokens_source, b.cost_source, b.duration_source, b.turns_source} == {"malformed"}
    one, two = (transcripts.fingerprint(transcripts.list_files(spark, str(root)).orderBy(o)).first().fingerprint for o in (F.asc("size"), F.desc("size")))
    assert one == two


def test_judge_stub_is_no_session(spark):
    raw = spark.createDataFrame([("f", 0, json.dumps({"type": "user", "message": {"content": messages.JUDGE_STUB + " went well"}})), ("g", 0, json.dumps({"type": "user", "message": {"content": "hello"}}))], "file string, line_no int, raw string")
    assert [r.file for r in fold.fold(raw).collect()] == ["g"]


def test_results_belong_to_the_start_before_them(spark):
    use = lambda t: json.dumps({"type": "assistant", "timestamp": t, "message": {"content": [{"type": "tool_use", "id": "x", "name": "Bash"}]}})
    result = lambda t: json.dumps({"type": "user", "timestamp": t, "message": {"content": [{"type": "tool_result", "tool_use_id": "x"}]}})
    at = 1_704_067_200_000
    rows = [("f", i, x) for i, x in enumerate([result(at), use(at + 1000), result(at + 3000), result(at + 9000), use(at + 10_000)])]
    got = transcripts.tool_calls(transcripts.records(spark.createDataFrame(rows, "file string, line_no int, raw string"))).orderBy("line_no").collect()
    assert [(r.line_no, r.duration_ms, r.results) for r in got] == [(1, 2000, 2), (4, None, 0)]


def test_streams(spark, tmp_path):
    rng = random.Random(7)
    rows = [{"id": i, "run_id": f"r{rng.randint(0, 4)}", "type": "run_finished" if rng.random() < 0.05 else "step", "at_ms": 1_700_000_000_000 + i, "payload": "{bad" if i % 7 == 0 else '{"a": 1}'} for i in range(200)]
    folder = tmp_path / "log"
    folder.mkdir()
    for n, a in enumerate(range(0, 200, 50)):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows[a : a + 50] + rows[a : a + 3]))
        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in the order of their times
    stream = events.stream_until_end(events.read_stream(spark, str(folder), 1))
    q = stream.writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.until_end(events.once(events.parsed(spark.read.schema(events.SCHEMA).json(str(folder)))))
    assert sorted(r.id for r in spark.table("ended").collect()) == sorted(r.id for r in batch.collect()) and batch.count() < 200
    single = events.once(events.read_stream(spark, str(folder), 1), "1 hour")
    q = single.writeStream.format("memory").queryName("single").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("single").collect()
    assert sorted(r.id for r in got) == list(range(200)) and sum(r.data is None for r in got) == sum(i % 7 == 0 for i in range(200))


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "q", b\n', [1, 2]), (2, None, [])], "id int, t string, l array<int>")
    sinks.write_csv(d.coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part*")).read_text().startswith('"id","t","l"\n"1","a ""q"", b\n","[1,2]"')
    sinks.write_json(spark.createDataFrame([(1, "at /home/bob/x"), (2, "y")], "run_id int, t string"), str(tmp_path / "json"), "run_id", safe=True)
    assert json.loads(next((tmp_path / "json" / "run_id=1").glob("part*")).read_text())["t"] == "at /home/[redacted]/x"
    cases = spark.createDataFrame([(1, "c|1", 0, "passed", 1.5), (1, "c2", 0, "failed", 0.25)], "run_id int, case_id string, sample int, status string, cost double")
    sinks.write_reports(cases, str(tmp_path / "md"))
    report = next((tmp_path / "md" / "run_id=1").glob("part*")).read_text().splitlines()
    assert report == ["# Run 1", "| case | sample | status | cost |", "| --- | --- | --- | --- |", "| c2 | 0 | failed | 0.25 |", "| c\\|1 | 0 | passed | 1.50 |", "Passed 1 of 2, 1.75"]
    folder = tmp_path / "cases"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"id": "a", "prompt": "p", "graders": [{"type": "manual"}]}))
    (folder / "b.json").write_text("{broken")
    good, bad = sinks.read_cases(spark, str(folder))
    assert [r.id for r in good.collect()] == ["a"] and [r.problem.split(";")[0] for r in bad.collect()] == ["not valid JSON"]


def test_index_is_stored_and_replaced(spark, tmp_path):
    d = spark.createDataFrame([(1, "foo-bar baz", "title one"), (2, "foo baz bar", None), (3, None, "foo bar"), (4, "foo bar foo bar", "")], "id int, body string, title string")
    search.save(search.postings(d, "id", "body", "title"), str(tmp_path / "index"))
    index, sizes = search.load(spark, str(tmp_path / "index")), search.sizes(d, "id", "body", "title")
    found = lambda q, i=index: sorted(r.doc for r in search.search(i, sizes, q).collect())
    assert found("foo-bar") == [1, 3, 4] and found("foo bar") == [1, 2, 3, 4] and found("BA*") == [1, 2, 3, 4] and found("one foo") == [1] and found("the the") == []
    assert found("") == found("*") == found('"') == [] and found("foo foo") == [1, 2, 3, 4]
    new = search.replaced(index, spark.createDataFrame([(1, "qux", None)], "id int, body string, title string"), "id", "body", "title")
    assert found("qux", new) == [1] and found("foo-bar", new) == [3, 4]
    assert search.search(index, sizes, "foo", 0).count() == 1


def test_null_and_tied_rows(spark):
    e = spark.createDataFrame([], "file string, tool string, duration long")
    assert evaluation.tool_durations(e).count() == 0
    d = spark.createDataFrame([("f", None, 3), ("f", None, None), ("f", "a", 3), ("f", "a", 3)], "file string, tool string, duration long")
    assert sorted((str(r.tool), r.n, r.longest) for r in evaluation.tool_durations(d).collect()) == [("None", 2, 3), ("a", 2, 3)]
    steps = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b"), ("g", None, None)], "file string, pos int, tool string")
    assert sorted((r.file, r.n, r.first, r.passed) for r in evaluation.step_checks(steps, "b", 1).collect()) == [("f", 1, 2, True), ("g", 0, 0, False)]
    cases = spark.createDataFrame([(1, "c", None, ["x"]), (2, None, "easy", None), (3, "c", "easy", [])], "case_id int, category string, difficulty string, tags array<string>")
    assert [r.case_id for r in lists.select_cases(cases, difficulties=["easy"]).collect()] == [2, 3] and [r.case_id for r in lists.select_cases(cases, tags=["x"]).collect()] == [1]
    usage = spark.createDataFrame([("s", "m", 0, 0, 0, 0)], "session string, model string, input long, output long, cache_read long, cache_write long")
    cat = spark.createDataFrame([("m", "m", 1.0, 1.0, 1.0, 1.0)], "alias string, source_model string, input double, output double, cache_read double, cache_write double")
    assert pricing.mixed_cost(pricing.estimate(usage, pricing.rates(usage, cat, []))).first().cost is None
    m = spark.createDataFrame([(None,), ("",), ("unknown",), ("x",)], "model string")
    assert {r.model: r.confidence for r in pricing.rates(m, cat, []).collect()} == {None: None, "": None, "unknown": None, "x": "fallback"}
    none = spark.createDataFrame([(None, None)], "final string, code int")
    r = none.select(grading.exit_code(F.col("code")).alias("a"), grading.contains(F.col("final"), "x", negate=True).alias("b"), grading.equals(F.col("final"), "").alias("c"), grading.checksum(F.col("final"), F.lit("x")).alias("d")).first()
    assert not any(r)
    s = spark.createDataFrame([("mcp__srv__go", "-home-u--x-y"), ("Read", "a"), (None, None)], "tool string, folder string").select(text.mcp_server(F.col("tool")).alias("a"), text.project_path(F.col("folder")).alias("b")).collect()
    assert [tuple(x) for x in s] == [("srv", "/home/u/.x/y"), (None, "a"), (None, None)]
    live = spark.createDataFrame([("a", 0, 100, 10), ("b", 0, 100, 10**9)], "session_id string, tool_errors int, quality int, until long")
    assert [r.session_id for r in sessions.attention(live, 10**9).collect()] == ["a"]
    assert spark.range(1).select(stats.floor_index(F.array().cast("array<int>"), 0.5).alias("x")).first().x is None


def test_judge_sample_keeps_its_budget(spark):
    rows = [(f"s{i}", i, f"s{i}", None, None) for i in range(500)] + [(f"m{i}", i, f"m{i}", "after" if i % 2 else "before", i + 1) for i in range(30)]
    d = spark.createDataFrame(rows, "session_id string, at_ms long, tie string, side string, rank int")
    got = lists.judge_sample(d, 40).collect()
    assert len(got) == 40 and sum(r.why == "marker" for r in got) == 20 and len({r.session_id for r in got}) == 40
    assert lists.judge_sample(d, 10).count() == 10 and lists.judge_sample(d.limit(0), 10).count() == 0


def test_weeks_follow_the_clock_of_the_zone(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    from quarry.operators import collection

    zone, rng = ZoneInfo("America/New_York"), random.Random(9)
    ms = [1_709_200_000_000 + rng.randint(0, 20 * 86_400_000) for _ in range(300)]  # over the change of 2024-03-10
    d = spark.createDataFrame([(m,) for m in ms], "at_ms long")
    got = {r.at_ms: r.week for r in d.select("at_ms", collection.local_week(F.col("at_ms"), "America/New_York").alias("week")).collect()}
    for m in ms:
        t = datetime.fromtimestamp(m / 1000, zone).date()
        assert got[m] == t.fromordinal(t.toordinal() - t.weekday())
    weeks = collection.weekly_local(d, max(ms), 6, "America/New_York").collect()
    assert len(weeks) == 6 and sum(r.sessions for r in weeks) == len(ms) and [r.week for r in weeks] == sorted(r.week for r in weeks) and weeks[0].sessions == 0


def test_markers_and_figures_of_nothing(spark):
    from quarry.operators import collection

    none = spark.createDataFrame([], "at_ms long, skills array<string>, mcp_servers array<string>, model string, subagents int")
    assert collection.markers(none).count() == 0
    odd = spark.createDataFrame([(1, None, [], None, 0), (2, ["a", "a"], None, "m", 2)], none.schema)
    assert sorted((r.kind, r.name, r.sessions) for r in collection.markers(odd).collect()) == [("model", "m", 1), ("skill", "a", 1), ("subagent", "subagent usage", 1)]


def test_numbers_of_lines_in_many_blocks(spark, tmp_path):
    """A file that is cut into many blocks is numbered as a plain reader does it, without a last newline and with returns."""
    import random

    rng = random.Random(3)
    want = {}
    for name, end in (("a.jsonl", ""), ("b.jsonl", "\n"), ("c.jsonl", "\r\n"), ("empty.jsonl", "")):
        body = [] if name == "empty.jsonl" else ["é" * rng.randint(0, 40) + str(i) + rng.choice(["", "\r", " "]) for i in range(3000)]
        (tmp_path / name).write_bytes(("\n".join(body) + end).encode())
        kept = ("\n".join(body) + end).split("\n")
        if kept[-1] == "":
            kept.pop()
        want |= {(name, i): x for i, x in enumerate(kept)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.file.rsplit("/", 1)[1], r.line_no): r.raw for r in got} == want and len(got) == len(want)


def test_fold_scans_and_deals_out_once(spark):
    rows = [("f", i, json.dumps({"type": "user", "uuid": str(i), "message": {"content": "hi"}})) for i in range(9)]
    df = spark.createDataFrame(rows, "file string, line_no int, raw string")
    plan = fold.fold(df)._jdf.queryExecution().sparkPlan().toString()
    executed = fold.fold(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and executed.count("Exchange") == 1


def test_positions_in_a_group_that_spans_ranges(spark):
    from quarry.operators.positions import positions

    df = spark.range(5000).selectExpr("id % 3 as g", "(id * 7919) % 5000 as v", "cast(null as int) as extra").union(spark.createDataFrame([(None, 1, None)] * 3, "g long, v long, extra int"))
    got = positions(df, ["g"], ["v"]).collect()
    for g in (0, 1, 2, None):
        own = sorted(r.pos for r in got if r.g == g)
        assert own == list(range(len(own)))
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.pos)] == sorted(r.v for r in got if r.g == g)
    assert sorted(r.pos for r in positions(df, [], ["v"]).collect()) == list(range(5003))
    assert positions(df.limit(0), ["g"], ["v"]).count() == 0


def test_a_silent_run_is_aborted_once(spark, tmp_path):
    """Runs that end, fall silent between batches or within one, and come back; the stream is stopped and goes on."""
    from quarry.streaming import watch

    minute, log = 60_000, tmp_path / "log"
    log.mkdir()

    def add(n, rows):
        (log / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "run_id": r, "type": t, "at_ms": 1_700_000_000_000 + m * minute, "payload": "{}"}) for i, r, t, m in rows))
        os.utime(log / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
        watch.run(events.read_stream(spark, str(log), 1), str(tmp_path / "aborts"), str(tmp_path / "offsets"))

    add(1, [(1, "quiet", "start", 0), (2, "beats", "heartbeat", 0), (3, "ends", "start", 0), (4, "ends", "run_finished", 1), (5, "clock", "start", 2)])
    add(2, [(6, "beats", "heartbeat", 9), (7, "clock", "heartbeat", 10), (8, "beats", "heartbeat", 18), (9, "clock", "heartbeat", 19)])
    add(3, [(10, "quiet", "late", 26), (11, "beats", "heartbeat", 27), (12, "within", "start", 28), (13, "clock", "heartbeat", 29), (14, "within", "more", 39), (15, "clock", "heartbeat", 39)])
    add(4, [(16, "clock", "run_finished", 45), (17, "quiet", "later", 80), (18, "other", "start", 100)])
    got = sorted((r.run_id, (r.at_ms - 1_700_000_000_000) // minute) for r in spark.read.schema(watch.ABORTS).parquet(str(tmp_path / "aborts")).collect())
    assert got == [("beats", 37), ("quiet", 10), ("within", 38)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    from quarry.streaming import collect

    root, cache, offsets = tmp_path / "in", str(tmp_path / "cache"), str(tmp_path / "offsets")
    root.mkdir()
    say = lambda text: json.dumps({"type": "user", "sessionId": "s", "message": {"content": text}}) + "\n"
    (root / "a.jsonl").write_text(say("one"))
    (root / "b.jsonl").write_text("{broken\n{broken\n")
    (root / "none.jsonl").write_text("")
    collect.run(spark, str(root), cache, offsets)
    see = lambda: (sorted((r.file.rsplit("/", 1)[1], r.prompts, r.malformed) for r in collect.sessions(spark, cache).collect()), sorted((r.file.rsplit("/", 1)[1], r.attempts) for r in collect.failures(spark, cache).collect()))
    assert see() == ([("a.jsonl", 1, 0), ("b.jsonl", 0, 2)], [("b.jsonl", 1)])
    # the batch was killed after its write: its number is done again, in full
    files = spark.read.format("binaryFile").load(str(root)).select("path", "modificationTime", "length")
    collect.batch(files, 0, cache)
    assert see() == ([("a.jsonl", 1, 0), ("b.jsonl", 0, 2)], [("b.jsonl", 1)])
    collect.run(spark, str(root), cache, offsets)
    (root / "c.jsonl").write_text(say("one") + say("two"))
    collect.run(spark, str(root), cache, offsets)
    assert see()[0] == [("a.jsonl", 1, 0), ("b.jsonl", 0, 2), ("c.jsonl", 2, 0)]


def test_windows_over_a_series_that_is_cut(spark, monkeypatch):
    """Pieces with halos give what one window gives."""
    from quarry.operators import insights

    df = spark.range(700).selectExpr("'a' as series", "(id * 37) % 701 as at_ms", "concat('s', id) as session_id", "cast((id * 7919) % 101 as double) as v").union(spark.range(60).selectExpr("'b'", "id", "concat('t', id)", "cast(id % 7 as double)"))
    see = lambda: (sorted(map(tuple, insights.trailing_median(df, "v").collect())), sorted((r.series, r.i, round(r.z, 9)) for r in insights.change_scores(df, "v").collect()))
    whole = see()
    monkeypatch.setattr(insights, "LARGE", 40)
    assert see() == whole and len(whole[0]) == 760 and len(whole[1]) > 600
