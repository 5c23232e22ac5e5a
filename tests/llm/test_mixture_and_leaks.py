"""Budgets against an iterative brute force, row numbers that stay, fingerprints and their index."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import common, decontam, mixing

SF = "/root/testdata/sf0.001"
WORDS = {"domain": {"a": 0.5, "b": 0.3, "": 0.2}, "lang": {"en": 0.6, "de": 0.3, "": 0.1}, "source": {"": 1.0, "s1": 3.0, "s2": 0.0}}


def filled(budget, nodes):
    """nodes: (name, weight, capacity). Shares by weight; whoever can't take its share takes all it can, the rest is shared out again."""
    out, open_ = {}, {n: (w, c) for n, w, c in nodes if w > 0 and c > 0}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c <= budget * w / total + 1e-9]
        if not full:
            return out | {n: budget * w / total for n, (w, _) in open_.items()}
        for n in full:
            out[n] = open_.pop(n)[1]
            budget -= out[n]
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_budgets_by_brute_force(spark, most):
    rng = random.Random(6)
    for _ in range(1 + (most > 0)):
        leaves = {(rng.choice("abcd"), rng.choice(["en", "de", "fr"]), f"s{rng.randint(0, 9)}"): rng.choice([1, 5, 50, 700, 20000]) for _ in range(60)}
        fraction, epochs = rng.choice([(0.3, 1), (0.8, 2), (1.7, 2)])
        rows = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
        got = {(r.domain, r.lang, r.source): r.quota for r in mixing.budgets(rows, fraction, epochs, WORDS, most).collect()}
        weight = lambda level, name: WORDS[level].get(name, WORDS[level][""])
        sums = lambda depth, of=(): {k: sum(v for x, v in leaves.items() if x[:depth] == k) * epochs for k in {x[:depth] for x in leaves} if k[: len(of)] == of}
        all_ = sum(leaves.values())
        want = {}
        for d, b1 in filled(min(int(all_ * fraction), all_ * epochs), [(k, weight("domain", k[0]), c) for k, c in sums(1).items()]).items():
            for x, b2 in filled(b1, [(k, weight("lang", k[1]), c) for k, c in sums(2, d).items()]).items():
                want |= filled(b2, [(k, weight("source", k[2]), c) for k, c in sums(3, x).items()])
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1 + 1e-6 * want[k] for k in want)


def test_prefixes_by_brute_force(spark):
    from hashlib import md5

    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randint(0, 20)), "en", f"s{rng.randint(0, 3)}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.c for r in mixing.mixture(d, fraction=1.3).groupBy("doc_id").agg(F.count("*").alias("c")).collect()}
    leaves: dict = {}
    for i, t, _, s in rows:
        leaves.setdefault(s, []).append((i, len(t.split())))
    tokens = spark.createDataFrame([(f"domain{int(s[1:]) % 4}", "en", s, sum(n for _, n in x)) for s, x in leaves.items()], "domain string, lang string, source string, tokens long")
    for q in mixing.budgets(tokens, 1.3, mixing.MAX_EPOCHS, mixing.WEIGHTS).collect():
        ahead = 0
        for i, n in sorted(leaves[q.source], key=lambda x: md5(f"{mixing.SEED}:{q.whole}:{x[0]}".encode()).hexdigest()):
            assert got.get(i, 0) == q.whole + (ahead < q.part)
            ahead += n


@pytest.fixture
def resplit(spark, monkeypatch):
    """Tables are split otherwise with every table that is written, as after the loss of an executor."""
    kept, conf, turn = common.store, "spark.sql.files.maxPartitionBytes", []

    def store(df, name):
        out = kept(df, name)
        turn.append(1)
        spark.conf.set(conf, str(20000 + 15000 * (len(turn) % 3)))
        return out

    for module in (common, decontam, mixing):
        monkeypatch.setattr(module, "store", store)
    yield
    spark.conf.unset(conf)


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_rows_stay_who_they_are(spark, request):
    d, b = read(spark, "documents"), read(spark, "benchmark")
    found = sorted(map(str, decontam.leaks(d, b).drop("uid").collect()))
    left = sorted(r.doc_id for r in decontam.drop_leaks(d, b).collect())
    mixed = sorted((r.doc_id, r.text or "", r.epoch) for r in mixing.mix(d).collect())
    request.getfixturevalue("resplit")
    assert sorted(map(str, decontam.leaks(d, b).drop("uid").collect())) == found
    assert sorted(r.doc_id for r in decontam.drop_leaks(d, b).collect()) == left and len(left) < d.count()
    assert sorted((r.doc_id, r.text or "", r.epoch) for r in mixing.mix(d).collect()) == mixed


def test_fingerprints(spark):
    rng = random.Random(8)
    rows = [(k, rng.getrandbits(63) - (1 << 62), rng.choice([1, 2, 4]), rng.randint(1, 3)) for k in range(20) for _ in range(rng.randint(1, 40))]
    d = spark.createDataFrame(rows, "k long, h long, w long, n long").withColumn("h2", F.xxhash64("h", F.lit(1)))
    raw = d.collect()
    for r in decontam.fingerprints(d.drop("h2"), ["k"]).collect():
        mine = [(x.h, x.h2, x.w * x.n) for x in raw if x.k == r.k]
        total = sum(w for *_, w in mine)
        for j, fp in enumerate((r.fp0, r.fp1)):
            want = sum(1 << i for i in range(64) if 2 * sum(x[2] for x in mine if (x[j] >> i) & 1) > total)
            assert fp & ((1 << 64) - 1) == want
        assert r.weight == total


def test_index_finds_all_within_radius(spark):
    rng = random.Random(9)
    items = [(i, rng.choice([20, 30]), 5, rng.getrandbits(128)) for i in range(30)]
    signed = lambda x: (x & ((1 << 64) - 1)) - (1 << 64) * ((x >> 63) & 1)
    windows = []
    for u in range(600):
        _, n, s, fp = rng.choice(items)
        for bit in rng.sample(range(128), rng.choice([0, 3, 30, 46, 47, 48, 60])):
            fp ^= 1 << bit
        windows.append((u, 0, n, s, fp))
    w = spark.createDataFrame([(u, p, n, s, signed(f), signed(f >> 64)) for u, p, n, s, f in windows], "uid long, pos int, len int, size int, fp0 long, fp1 long")
    i = spark.createDataFrame([(k, n, s, signed(f), signed(f >> 64)) for k, n, s, f in items], "iid long, len int, size int, fp0 long, fp1 long")
    got = {(r.uid, r.iid) for r in decontam.within_radius(w, i).collect()}
    assert got == {(u, k) for u, _, n, _, f in windows for k, m, _, g in items if n == m and (f ^ g).bit_count() <= decontam.RADIUS}


def test_empty_tables(spark):
    d, b = read(spark, "documents"), read(spark, "benchmark")
    assert decontam.drop_leaks(d.limit(0), b).count() == 0 and decontam.drop_leaks(d, b.limit(0)).count() == d.count()
    out = mixing.mix(d.limit(0))
    assert out.count() == 0 and out.columns == [*d.columns, "domain", "n_tokens", "epoch"]


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "en", "src1"), (2, "", None, None), (None, "a b c", "en", "src1"), (3, "a b c", "en", "src1"), (3, "a b c", "en", "src1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "7 as uid", "8 as key", "9 as times", "10 as domain", "11 as budget", "12 as whole")
    out = mixing.mix(d, fraction=2.0)
    # two whole epochs of the only leaf with tokens
    assert sorted(str((r.doc_id, r.text, r.epoch)) for r in out.collect()) == sorted(str((x, t, e)) for x, t, lang, _ in rows if lang for e in (1, 2))
    assert {(r.uid, r.key, r.times, r.budget, r.whole) for r in out.collect()} == {(7, 8, 9, 11, 12)}
