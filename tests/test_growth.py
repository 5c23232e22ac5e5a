"""Plans and results of steps that must not grow faster than their input."""

import gzip
import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from quarry.operators import evaluation, search
from quarry.plans import registry
from quarry.sources import lines, rollouts
from quarry.streaming import collect

QUERIES, _ = registry.load()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def durations(rng, errors):
    rows = [(rng.randint(0, 5), rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, rng.random()]), rng.choice([None, True, False])) for _ in range(400)]
    want = {}
    for f, t, d, e in rows:
        want.setdefault((f, t), []).append((d, e))
    out = {}
    for key, got in want.items():
        s = sorted((d for d, _ in got), key=lambda d: (d is not None, d or 0.0))
        n = len(s)
        out[key] = (n, s[min(n - 1, int(n * 0.5))], s[min(n - 1, int(n * 0.95))], max((d for d in s if d is not None), default=None), *([sum(e is True for _, e in got)] if errors else []))
    return rows, out


def test_durations_with_errors_hold_no_table_of_groups(spark):
    rows, want = durations(random.Random(11), True)
    df = evaluation.tool_durations(spark.createDataFrame(rows, "file int, tool string, duration double, is_error boolean"), most=2)
    got = {(r.file, r.tool): (r.n, r.p50, r.p95, r.longest, r.errors) for r in df.collect()}
    best = {f: sorted((k for k in want if k[0] == f), key=lambda k: (-want[k][0], k[1] is not None, k[1] or ""))[:2] for f in range(6)}
    assert got == {k: want[k] for ks in best.values() for k in ks}
    assert "HashAggregate" not in executed(df)


def test_durations_of_one_sort(spark):
    rows, want = durations(random.Random(12), False)
    df = evaluation.tool_durations(spark.createDataFrame([r[:3] for r in rows], "file int, tool string, duration double"))
    plan = executed(df)
    assert {(r.file, r.tool): (r.n, r.p50, r.p95, r.longest) for r in df.collect()} == want
    assert "HashAggregate" not in plan and plan.count("Sort [") == plan.count("Exchange") == 1


def test_durations_hold_a_large_group_once(spark):
    rows = [("f", "a", float(i * 7919 % 5003), i % 5 == 0) for i in range(5003)]
    df = evaluation.tool_durations(spark.createDataFrame(rows, "file string, tool string, duration double, is_error boolean"))
    assert re.findall(r"(Window|Filter|Sort|Exchange)\b", executed(df)) == ["Filter", "Window", "Filter", "Window", "Sort", "Exchange"]
    assert [tuple(r) for r in df.collect()] == [("f", "a", 5003, 2501.0, 4752.0, 5002.0, 1001)]


def test_snippet_by_a_loop_over_words(spark):
    rng = random.Random(13)
    pieces = ["the", "The", "t-h.e", "«the»", "thé", "then", "and", "AND", "Androids", "--and--", "İ", "the ", "\u0085the", "😀the", "-", "…", "band", "x", "ΣΑΣ", "1"]
    texts = ["".join(rng.choice(pieces if rng.random() < 0.2 else ["w", "-", "é"]) + rng.choice([" ", "  ", "\n", "\t\x0b", "\r\n"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["", " ", "the", " the", "the ", "\nthe\n", *("a " * n + "and" + " b" * 20 for n in range(12))]

    def loop(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        bare = ["".join(c for c in w.lower() if unicodedata.category(c)[0] in "LN") for w in words]
        hit = [b == "the" or b.startswith("and") for b in bare]
        if True not in hit:
            return None
        start = max(0, hit.index(True) - 5)
        return ("… " if start else "") + " ".join(f"«{w}»" if h else w for w, h in zip(words[start : start + 14], hit[start : start + 14], strict=True))

    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string")
    got = df.select("i", search.snippet(F.col("text"), "the and*").alias("s"), search.fits(F.col("text"), "the and*").alias("f")).collect()
    want = [*map(loop, texts), None]
    assert {r.i: r.s for r in got} == dict(enumerate(want)) and all(bool(r.f) == (r.s is not None) for r in got)
    assert df.select(search.snippet(F.col("text"), "-").alias("s")).where("s is not null").count() == 0


def test_snippets_are_made_once(spark):
    plan = QUERIES["fts_snippets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform" not in plan.split("Filter")[1]


def test_calls_are_read_and_dealt_out_once(spark):
    kinds = ["function_call", "function_call_output", "local_shell_call", "custom_tool_call_output", "message"]
    rng = random.Random(14)
    rows, at = [], 1_704_067_200
    for f in "abc":
        for i in range(200):
            p = {"type": rng.choice(kinds), "call_id": rng.choice(["x", "y", None]), "output": rng.choice(["Exit code: 1", "Exit code: 0", None])}
            rows.append((f, i, json.dumps({"timestamp": rng.choice([at + i, at + i, None]), "type": "response_item", "payload": p})))
    want = {}
    for f in "abc":
        open_ = {}
        for _, i, raw in (r for r in rows if r[0] == f):
            r = json.loads(raw)
            p, t, c = r["payload"], r["timestamp"], r["payload"]["call_id"]
            if p["type"] in ("function_call", "local_shell_call"):
                want[f, i] = (False, None)
                if c:
                    open_[c] = (i, t)
            elif p["type"] != "message" and c in open_:
                start, t0 = open_.pop(c)
                want[f, start] = (p["output"] == "Exit code: 1", None if t is None or t0 is None else (t - t0) * 1000)
    df = rollouts.calls(rollouts.records(spark.createDataFrame(rows, "file string, line_no int, raw string")))
    plan = executed(df)
    assert {(r.file, r.line_no): (r.is_error, r.duration_ms) for r in df.collect()} == want
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange") == 1 and "variant" not in plan.split("Exchange")[0]


def test_small_files_are_not_stored_and_large_ones_read_alike(spark, tmp_path, monkeypatch):
    bodies = {"a": b"", "b": b"\n", "c": b"x", "d": b"x\n\ny\r\n", "e": b"\xef\xbb\xbffirst\nsecond", "f": b"\n\n", "g": "é ü\x85z\n".encode() * 50, "h": b" \r\r\n", "i": b"\xef\xbb\xbf"}
    for name, body in bodies.items():
        (tmp_path / f"{name}.jsonl").write_bytes(body)
    (tmp_path / "j.jsonl.gz").write_bytes(gzip.compress(b"packed\nlines\n"))
    (tmp_path / "other.txt").write_text("x")
    see = lambda: sorted((r.file.rsplit("/", 1)[1], r.line_no, r.raw) for r in lines.numbered_lines(spark, str(tmp_path), "*.jsonl").collect())
    want = []
    for name, body in bodies.items():
        kept = body.decode("utf-8-sig").split("\n")
        want += [(f"{name}.jsonl", i, x) for i, x in enumerate(kept[:-1] if kept[-1] == "" else kept)]
    monkeypatch.setattr(lines, "SMALL", 100)
    assert see() == want
    monkeypatch.setattr(lines, "SMALL", -1)
    assert see() == want
    monkeypatch.setattr(lines, "SMALL", 1 << 20)
    monkeypatch.setattr(lines, "store", None)
    assert see() == want
    monkeypatch.undo()
    assert [r.raw for r in lines.numbered_lines(spark, str(tmp_path), "*.gz").orderBy("line_no").collect()] == ["packed", "lines"]


def test_folders_are_written_and_listed_by_a_few_tasks(spark, tmp_path):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, group = spark.conf.get(name), "folders"
    for i in range(200):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "a.jsonl").write_text("x\n")
    spark.sparkContext.setJobGroup(group, group)
    found = lines.numbered_lines(spark, str(tmp_path)).count()
    status = spark.sparkContext.statusTracker()
    tasks = max(status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds if status.getStageInfo(s))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == 200 and tasks <= 4 * spark.sparkContext.defaultParallelism and spark.conf.get(name) == before


def test_a_backlog_is_one_trigger_of_many_batches(spark, tmp_path):
    root, cache, offsets = tmp_path / "in", str(tmp_path / "cache"), tmp_path / "offsets"
    root.mkdir()
    for i in range(25):
        (root / f"{i}.jsonl").write_text("{broken\n" if i % 5 == 0 else json.dumps({"type": "user", "message": {"content": "hi"}}) + "\n")
    see = lambda: (sorted((r.file.rsplit("/", 1)[1], r.prompts, r.malformed) for r in collect.sessions(spark, cache).collect()), sorted((r.file.rsplit("/", 1)[1], r.attempts) for r in collect.failures(spark, cache).collect()))
    collect.run(spark, str(root), cache, str(offsets), most=4)
    once = see()
    assert len(once[0]) == 25 and once[1] == sorted((f"{i}.jsonl", 1) for i in range(0, 25, 5))
    assert sorted(p.name for p in (offsets / "commits").iterdir() if p.name.isdigit()) == ["0"]
    sizes = spark.read.parquet(f"{cache}/sessions").groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in sizes) == [(i, 4) for i in range(6)] + [(6, 1)]
    files = spark.read.format("binaryFile").load(str(root)).select("path", "modificationTime", "length")
    collect.batch(files, 0, cache, 4)
    assert see() == once
    (root / "5.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "now"}}) + "\n")
    collect.batch(spark.read.format("binaryFile").load(str(root / "5.jsonl")).select("path", "modificationTime", "length"), 1, cache, 4)
    assert ("5.jsonl", 1, 0) in see()[0] and "5.jsonl" not in dict(see()[1])
