"""Hard negatives, toxicity and conversation repair against brute force, held-out labels, and on odd rows."""

import hashlib
import heapq
import itertools
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quarry.llm import convrepair, hardneg, toxicity  # noqa: E402

WHITE = " \t\n\x0b\x0c\r"


# Conversation repair


def cheapest(rows):
    """The result for one conversation by a shortest-path search over rows and states."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    after, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    todo, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, q, out = heapq.heappop(todo)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            break
        heapq.heappush(todo, (cost + 5, audit + "I", i, after[q], (*out, name[after[q]] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(todo, (cost + 2, audit + "D", i + 1, q, out))
            if fault[i] not in ("b", "d"):
                more = 5 if fault[i] else 0
                heapq.heappush(todo, (cost + 1 + more, audit + "R", i + 1, after[q], (*out, f"{name[after[q]]}:{text}")))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                if kept:
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, kept, (*out, f"{role}:{text}")))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.mark.parametrize("long", [20_000, 3])
def test_repair_is_the_cheapest(spark, monkeypatch, long):
    """Both ways: conversations that a task holds, and ones that are cut into pieces."""
    monkeypatch.setattr(convrepair, "LONG_ROWS", long)
    monkeypatch.setattr(convrepair, "PIECE", 4)
    rng = random.Random(5)
    data, want = [], {}
    for c in [None, *range(60)]:
        rows = [(rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", "User"]), rng.choice(["a.", "b!", "c", "", " \t", "a. ", "é?", "x"])) for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 33]))]
        data += [(c, *r, 1) for r in rows]
        want[c] = cheapest(rows)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, code int")
    assert {r[0]: tuple(r)[1:] for r in convrepair.repair(df).collect()} == want


def test_repair_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, 0, "user", None), (3, 5, "user", "x" * 300_000 + "."), (3, 9, "assistant", "y!")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in convrepair.repair(df, turns=True).collect()}
    assert (got[1]["blank"], got[1]["audit"], got[1]["gaps"], got[1]["repaired"]) == (2, "DD", 0, "")
    assert (got[3]["audit"], got[3]["gaps"], got[3]["cost"]) == ("KK", 3, 0)
    nobody = convrepair.repair(df.withColumn("present", F.col("conv_id") > 1)).where("conv_id = 1").first()
    assert tuple(nobody)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert convrepair.repair(convrepair.damaged(df.limit(0))).count() == 0


def test_damage_follows_the_checksum(spark):
    df = spark.createDataFrame([(c, t, "assistant", "a.b!") for c in range(20) for t in range(20)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = convrepair.damaged(df).where("conv_id is not null").groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max("text").alias("text"), F.max("role").alias("role"), F.max("present").alias("present")).collect()
    for r in got:
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        assert (r["n"], r["text"], r["role"], r["present"]) == (2 if kind == 3 else 1, {1: "", 2: "ab"}.get(kind, "a.b!"), "user" if kind == 4 else "assistant", kind != 0)


# Hard negatives


def all_products(rows, anchors, positives=5, negatives=3):
    """rows: (vec_id, label, vector), as they repeat."""
    out = []
    for i, (a, la, va) in enumerate(rows):
        if not anchors(a):
            continue
        score = sorted((-int(np.dot(va, v)), b, lb == la) for j, (b, lb, v) in enumerate(rows) if j != i)
        for s, p, _ in [x for x in score if x[2]][:positives]:
            near = [x for x in score if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["alike", "clustered", "copies"])
def test_hard_negatives_are_those_of_all_products(spark, monkeypatch, kind):
    monkeypatch.setattr(hardneg, "PIECE", 40)
    monkeypatch.setattr(hardneg, "LEAF", 8)
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (6, 8))
    v = {"alike": rng.integers(-99, 99, (240, 8)), "clustered": centres[rng.integers(6, size=240)] + rng.integers(-9, 9, (240, 8)), "copies": np.repeat(rng.integers(-9, 9, (4, 8)), 60, 0)}[kind]
    rows = [(int(i // 2 if kind == "copies" else i), int(rng.integers(3)), x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    got = sorted(tuple(r) for r in hardneg.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == all_products(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, 0, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 2, [0.8, 0.5]), (50, None, [1.0, 1.0]), (100, 1, None), (150, 1, [1.0, None]), (200, 1, [nan, 1.0]), (250, 1, [float("inf"), 1.0]), (300, 1, [1.0]), (None, 1, [1.0, 1.0]), (7, 9, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 3, 4.0) for r in rows], "vec_id long, label int, embedding array<float>, uid int, score double")
    got = [tuple(r) for r in hardneg.mined(df).collect()]
    assert [(r[0], r[1], r[3]) for r in got] == [(0, 1, 2)]
    assert hardneg.mined(df.limit(0)).count() == 0


def test_whole_nodes_are_pruned_on_clustered_vectors():
    """Of a clustered set the walk scores few pairs; of vectors alike in all directions it may score all."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((64, 32)) * 100
    v = centres[np.arange(8192) % 64] + rng.standard_normal((8192, 32)) * 2
    part, anchors = hardneg.Tree(v, hardneg.LEAF), hardneg.Tree(v[::5], hardneg.ANCHOR_LEAF)
    best = np.full(len(anchors.rows), -np.inf)

    def leaves(s, e, x, y):
        best[s:e] = np.maximum(best[s:e], (anchors.rows[s:e] @ part.rows[x:y].T).max(axis=1))

    made = hardneg.dual(anchors, part, lambda s, e: best[s:e].min(), lambda s, e: np.inf, leaves)
    assert np.allclose(best, (anchors.rows @ v.T).max(axis=1))
    assert made < 0.2 * len(anchors.rows) * len(v)


# Toxicity


def plain_kernel(s, t):
    """All common subsequences of ORDER characters, each weighed by its spans."""
    def sums(x):
        out = {}
        for at in itertools.combinations(range(len(x)), toxicity.ORDER):
            key = "".join(x[i] for i in at)
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = sums(s), sums(t)
    return sum(w * b.get(k, 0.0) for k, w in a.items())


def test_string_kernel_is_that_of_all_subsequences():
    words, marks = ["idiot", "idxiot", "aaaa", "ab", "été", "stupid", "tion"], ["idiot", "aaa", "stupid", "étéé"]
    got = toxicity.kernel(words, marks)
    for i, s in enumerate(words):
        for j, t in enumerate(marks):
            norm = (plain_kernel(s, s) * plain_kernel(t, t)) ** 0.5
            assert got[i, j] == pytest.approx(plain_kernel(s, t) / norm if norm else 0.0, abs=1e-5)


def invented(n, seed):
    rng = random.Random(seed)
    syllables = ["ra", "to", "ne", "mi", "lu", "ka", "so", "ve", "di", "po"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["grumblox", "snerfwit", "blighter"])
        out.append((" ".join(words), int(i % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def machine():
    some = invented(400, 1)
    return toxicity.train([t for t, _ in some], np.array([y for _, y in some]))


def test_toxic_words_are_found_in_other_texts(machine):
    fresh = invented(200, 2)
    got = machine.scores([t for t, _ in fresh]) >= toxicity.CUT
    assert np.mean(got == np.array([y for _, y in fresh])) > 0.97


def test_gapped_and_padded_words_are_found(machine):
    clean = [t for t, y in invented(80, 3) if not y]
    for form in ("GRUMBLOX", "g.r.u.m.b.l.o.x", "g r u m b l o x", "grumb-lox", "grumbblox", "snerfwits", "sn3rfwit", "bli*ghter"):
        assert np.mean(machine.scores([f"{t} {form} {t}" for t in clean]) >= toxicity.CUT) > 0.8, form


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.toxicity_scores(labelled, labels).join(labels, "doc_id").where("held_out")
    r = got.agg(F.count_if(F.expr("toxic = 1 and predicted = 1")).alias("tp"), F.count_if(F.expr("toxic = 1 and predicted = 0")).alias("fn"), F.count_if(F.expr("toxic = 0 and predicted = 1")).alias("fp"), F.count("*").alias("n")).first()
    assert r["fp"] < 0.01 * r["n"]
    assert r["tp"] > 0.8 * (r["tp"] + r["fn"])  # one in ten labels is at odds with its text


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "12 ! ?"), (None, "grumblox"), (5, "grumblox"), (5, "grumblox"), (6, "x" * 300_000), (7, "a b c " * 5)]
    df = spark.createDataFrame([(*r, 0, 1.0) for r in rows], "doc_id long, text string, id int, score double")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert {r["score"] for r in toxicity.toxicity_scores(df, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity_scores(df.limit(0), labels).count() == 0
