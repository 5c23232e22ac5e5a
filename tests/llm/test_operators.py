"""The corpus operators against SQL, brute force, round trips and held-out accuracy, and their odd cases."""

import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import connect, same  # noqa: E402

from quarry.llm import ann, decontam, html, langid, lm, mixing, neardup, quality, secrets, tokens  # noqa: E402
from quarry.llm.queries import ORACLE, QUERIES  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
EXTRA = ["uid", "id", "key", "score", "n", "sig", "rep", "comp", "h", "w", "pos", "words", "times", "rank", "k0", "spans", "masked", "capacity"]


def docs(spark, name="documents", sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long and repeated texts, null ids and groups, and columns with the operators' own names."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Straße", "éte", "中文", "x9"]
    body = " ".join(rng.choice(words) for _ in range(80))
    rows = [
        (1, None, "en", "src1"), (2, "", "en", "src1"), (3, " \t\n ", None, None), (4, "word", "de", "src0"), (4, "word", "de", "src0"), (None, body, "en", "src0"), (5, body, "en", "src0"),
        (6, body + " tail", None, "src0"), (7, "x" * 300_000, "en", "src2"), (8, body * 400, "fr", "src2"), (9, "1234 !!", "en", ""), (None, None, None, None), (10, body.upper(), "es", "web"),
        (11, "token = 'abcdef12' \0 end", "en", "src1"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in EXTRA})


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (9, 0, 0), (9, 0, 0), (None, 1, 0), (8, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert same(QUERIES[name](spark, SF), ORACLE[name], connect(SF)) > 0


PER_ROW = {
    "quality": lambda s, d: quality.quality_scores(d, labels(s)),
    "langid": lambda s, d: langid.language_ids(d),
    "tokens": lambda s, d: tokens.token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
    "lm": lambda s, d: lm.lm_scores(d),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "secrets": lambda s, d: secrets.secret_scan(d),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_odd_rows(spark, odd, name):
    out = PER_ROW[name](spark, odd).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert PER_ROW[name](spark, odd.limit(0)).count() == 0


def test_odd_values(spark, odd):
    got = {r.doc_id: r for r in langid.language_ids(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[9].lang_pred == "und" and got[5].lang_pred != "und"
    got = {r.doc_id: r for r in neardup.near_duplicates(odd).collect() if r.doc_id}
    assert got[1].n_shingles == 0 and got[1].component_id == 1 and got[4].n_shingles == 1
    assert got[5].component_id == got[6].component_id == 5 and got[5].kept and not got[6].kept
    assert sum(r.is_first for r in neardup.near_duplicates(odd).where("component_id = 4").collect()) == 1
    got = {r.doc_id: r for r in tokens.token_counts(odd, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 0 and got[7].over_limit
    got = {r.doc_id: r for r in lm.lm_scores(odd).collect()}
    assert got[1].n_tokens == 1 and all(r.score < 0 and math.isfinite(r.score) for r in got.values())


def test_filters_keep_columns(spark, odd):
    bench = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(30))), (1, None), (2, ""), (3, "tiny item")], "item_id long, text string")
    for out in (quality.keep_good(odd, labels(spark)), neardup.drop_near_duplicates(odd), decontam.drop_leaks(odd, bench), secrets.mask_secrets(odd)):
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        out.collect()
    masked = {r.doc_id: r for r in secrets.mask_secrets(odd).collect()}
    assert "abcdef12" not in masked[11].text and masked[11].n_chars == len(masked[11].text) and masked[5].text == {r.doc_id: r for r in odd.collect()}[5].text
    assert {"doc_id", "text", "epoch", *EXTRA} <= set(mixing.mix(odd).columns)


def test_mixture(spark, odd):
    out = mixing.mixture(odd)
    # a document without tokens is part of whole epochs: its small leaf is taken twice
    assert out.where("doc_id = 1").count() == 2 and out.where("doc_id = 11").count() == 2
    assert mixing.mixture(odd.limit(0)).count() == 0
    # a branch that cannot give its share passes it to its siblings first
    rows = [(i, "a b c d e f g h i j", lang, f"src{s}") for i, (lang, s) in enumerate([("en", 0)] * 2 + [("en", 4)] * 50 + [("de", 0)] * 50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"domain": {"": 1.0}, "lang": {"en": 0.5, "de": 0.5}, "source": {"": 1.0}}
    got = {(r.lang, r.source): r.t for r in mixing.mixture(d, fraction=0.5, max_epochs=1, weights=weights).groupBy("lang", "source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert got[("en", "src0")] == 20 and 230 <= got[("en", "src4")] <= 250 and 250 <= got[("de", "src0")] <= 270
    twice = mixing.mixture(d, fraction=1.5, max_epochs=2, weights=weights)
    assert twice.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    assert sorted(map(str, twice.collect())) == sorted(map(str, mixing.mixture(d.repartition(7), fraction=1.5, max_epochs=2, weights=weights).collect()))


def test_leaks_planted(spark):
    item = " ".join(f"w{i}" for i in range(30))
    noise = " ".join(f"n{i}" for i in range(100))
    near = " ".join("zz" if i == 3 else f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, noise + " " + item + " " + noise), (2, noise), (3, f"{noise} {near} {noise}"), (4, " ".join(f"w{i}" for i in range(10)) + " " + noise), (None, item), (5, None), (6, ""), (7, " ".join([item] * 50)), (8, "before tiny item after")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "tiny item"), (4, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(d, bench).collect()}
    assert got == {(x, y) for x in (1, 3, None, 7) for y in (0, 4)} | {(8, 3)}
    assert decontam.leaks(d.limit(0), bench).count() == 0 and decontam.leaks(d, bench.limit(0)).count() == 0


def test_tokens_equal_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, raw = Tokenizer.from_file(path), {r.doc_id: r.text for r in docs(spark).collect()}
    got = tokens.token_counts(docs(spark), path).collect()
    assert all(len(lib.encode(raw[r.doc_id], add_special_tokens=False).ids) == r.n_tokens and r.n_bytes == len(raw[r.doc_id].encode()) for r in got)
    import json

    text = open(path, encoding="utf-8").read()
    model = json.loads(text)["model"]
    single = tokens.proven_single(model["vocab"], [tuple(m) for m in model["merges"]])
    assert all(len(lib.encode(s, add_special_tokens=False).ids) == 1 for s in random.Random(2).sample(sorted(s for s in single if s.isascii() and s.isalpha()), 300))
    counter, rng = tokens.Counter(text, single), random.Random(3)
    long = "".join(rng.choice("aeinrst") for _ in range(3000))
    assert counter.count(long) == len(lib.encode(long, add_special_tokens=False).ids)
    parts = ["a", "b", "'s", "'LL", " ", "\n", "\x1c", "\x85", " ", "é", "é", "Σ", "ΑΣ", "İ", "ß", "1", "²", "<|endoftext|>", "<|startoftext|>", "<|END", "#", "中", "\U0001f600", "​", "don't", "\u0000", "Å", "ſ"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert counter.count(s) == len(lib.encode(s, add_special_tokens=False).ids), s


def test_nearest_recall(spark):
    e = docs(spark, "embeddings", "/root/testdata/sf0.1")
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got: dict[int, list] = {}
    for r in ann.nearest(e).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        mine = sorted(got[ids[i]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [r.score for r in mine] == sorted(r.score for r in mine)
        hit += len({r.vec_id for r in mine} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hit / (10 * len(got)) >= 0.9 and len(got) == (ids % 100 == 0).sum()


def test_nearest_odd(spark):
    v = [float(i) for i in range(1, 5)]
    rows = [(0, v), (1, v), (2, v), (3, [2.0, 2.0, 3.0, 4.0]), (4, None), (5, [0.0] * 4), (6, [1.0, None, 2.0, 3.0]), (7, [1.0, float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0, 1.0]), (9, [1.0]), (None, v), (100, v)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("shard", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(e).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 0.0), (0, 4, 3, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0), (100, 4, 3, 1.0)]
    assert ann.nearest(e.limit(0)).count() == 0


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 1 << 63, (3000, 4), dtype=np.uint64)
    code[100:200] = code[5]
    index = ann.Index(code)
    for r in (0, 5, 60, 115, 128):
        q = code[r] ^ np.uint64(r)
        assert set(index.within(q, r)) == set(np.flatnonzero(np.bitwise_count(code ^ q).sum(axis=1) <= r))


def test_nearest_share_of_rows(spark):
    """What probing and the radius leave of vectors alike in all directions."""
    x = np.array([r.embedding for r in docs(spark, "embeddings", "/root/testdata/sf0.1").collect()], float)
    codes = ann.Codes(x, 10)
    code = codes.of(x)
    index = ann.Index(code)
    probed, within = (np.mean([len(f(code[i], codes.radius)) for i in range(0, len(x), 50)]) / len(x) for f in (index.probed, index.within))
    print("probed", probed, "within", within, codes.radius)
    assert probed < 0.25 and within < 0.04


def test_nearest_of_ids_that_repeat(spark):
    """Each row is a query of its own; its candidates are all rows but itself."""
    e = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(e).collect())
    far, off, side = round(2**0.5, 6), 0.1, round((0.9**2 + 1) ** 0.5, 6)
    assert got == sorted([(100, 1, 1, off), (100, 2, 2, side), (100, 3, 100, far), (100, 1, 2, off), (100, 2, 1, side), (100, 3, 100, far)])


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.quality_scores(docs(spark, sf=sf), docs(spark, "labels", sf)).join(docs(spark, "labels", sf), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.93 and np.mean([r.predicted for r in got if r.quality == 1]) >= 0.97


def test_quality_gradients():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 5, 300, 700)]
    y, off = np.array([0, 1, 1, 0], np.float32), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    p = {k: v.astype(np.float64) for k, v in quality.train(texts, y, epochs=1).items()}
    s, first = quality.prepared(np.frombuffer(b"".join(texts), np.uint8), off)
    g = quality.backward(p, quality.forward(p, s, first), s, first, y)

    def loss(q):
        f = quality.forward(q, s, first)["p"]
        return -np.mean(y * np.log(f) + (1 - y) * np.log(1 - f))

    for k in ("dense", "filters", "out"):
        i = tuple(0 for _ in p[k].shape)
        up, down = {a: b.copy() for a, b in p.items()}, {a: b.copy() for a, b in p.items()}
        up[k][i] += 1e-3
        down[k][i] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - g[k][i]) < 2e-3


def test_langid_held_out(spark):
    d = docs(spark, sf="/root/testdata/sf0.01")
    got = langid.language_ids(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97


def test_lm_base_and_probabilities(spark):
    raw = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    got = lm.lm_scores(docs(spark)).collect()
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())), "end"]
    count = Counter(w for i, t in raw.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
    n, v = sum(count.values()), len(count)
    for r in got:
        w = split(raw[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * abs(r.base_score)


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_trie_sums_to_one(most):
    """After any history the probabilities of all 256 bytes sum to one, pruned or not."""
    text = b"the cat sat on the mat and the hat; then that was that. " * 20 + bytes(range(40, 120))
    code, _ = lm.codes(np.frombuffer(text, np.uint8), np.array([0, 500, len(text)]))
    grams, contexts = [], []
    for k in range(lm.ORDER + 1):
        keys, n = lm.runs(code & lm._mask(k + 1))
        names, back = np.unique(keys >> np.uint64(8), return_inverse=True)
        ok = n * most >= len(code)
        grams.append((keys[ok], n[ok]))
        total, top = np.bincount(back, n), np.zeros(len(names))
        np.maximum.at(top, back, n)
        contexts.append((names[top * most >= len(code)], total[top * most >= len(code)]))
    trie = lm.Trie(grams, contexts)
    for c in [*code[:60], np.uint64(0x0102030405FF), np.uint64(0x7A7A746865FF)]:
        every = (c & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** trie.log10(every)).sum() - 1) < 1e-9


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = docs(spark)
    leaked = {r.doc_id for r in decontam.leaks(d, docs(spark, "benchmark")).collect()}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        if name == "near duplicates":
            kept = {r.doc_id for r in neardup.near_duplicates(d).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        if name == "decontamination":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in d.collect()} - leaked and leaked
        if name == "secrets":
            # the smallest documents hold no secret
            d1 = docs(spark, sf="/root/testdata/sf0.01")
            out1 = stage(spark, d1, "/root/testdata/sf0.01")
            assert out.count() == d.count() and out1.count() == d1.count()
            assert secrets.secret_scan(out1).where("spans <> ''").count() == 0 < secrets.secret_scan(d1).where("spans <> ''").count()
    good = {r.doc_id for r in quality.quality_scores(d, docs(spark, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, d, SF).collect()} == good
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in final.select("doc_id").collect()} <= good - leaked


def test_langid_of_rows_that_repeat(spark):
    """Languages whose rows are one row, repeated beyond what is ranked, are learned all the same."""
    d = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    d = d.crossJoin(spark.range(50)).drop("id")
    got = {(r.doc_id, r.lang_pred) for r in langid.language_ids(d, rows_each=2).collect()}
    assert got == {(1, "en"), (2, "de")}


@pytest.mark.parametrize("most", [1 << 20, 300, 0])
def test_lm_scores_by_whole_trie(spark, most):
    """No context is pruned, however few codes are sent to the tasks: scores equal those of a trie with every count."""
    raw = [(r.doc_id, r.text or "") for r in docs(spark).collect()]
    parts = []
    for i, t in raw:
        data = np.frombuffer(t.encode(), np.uint8)
        parts.append((zlib.crc32(str(i).encode()) % 7 != 2, lm.codes(data, np.array([0, len(data)]))[0]))
    code = np.concatenate([c for train, c in parts if train])
    grams, contexts = [], []
    for k in range(lm.ORDER + 1):
        keys, n = lm.runs(code & lm._mask(k + 1))
        names, back = np.unique(keys >> np.uint64(8), return_inverse=True)
        grams.append((keys, n))
        contexts.append((names, np.bincount(back, n)))
    trie = lm.Trie(grams, contexts)
    want = sorted((i, float(trie.log10(c).sum())) for (i, _), (_, c) in zip(raw, parts, strict=True))
    got = sorted((r.doc_id, r.score) for r in lm.lm_scores(docs(spark), most=most).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(x - y) <= 1e-9 * abs(y) for (_, x), (_, y) in zip(got, want, strict=True))


def test_leaks_near_the_threshold(spark):
    """Copies of every item with words changed, or cut by the document's end: all that SQL's exact similarity reports are found."""
    import duckdb

    rng = random.Random(3)
    items = [(i, [f"i{i}x{j}" for j in range(rng.choice([11, 16, 28, 32, 40, 52]))]) for i in range(400)]
    rows = []
    for i, w in items:
        changed = list(w)
        for j in (len(w) // 3, 2 * len(w) // 3)[: 1 + (len(w) > 45)] if len(w) > 11 else (0,):
            changed[j] = f"z{i}"
        rows += [(2 * i, " ".join(["before", *changed, "after", "that"])), (2 * i + 1, " ".join(["before", *w[: len(w) - (len(w) - 4) // 4]]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    con.register("benchmark", bench.toArrow())
    want = sorted(con.execute(ORACLE["op2_benchmark_leaks"]).fetchall())
    got = sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in decontam.leaks(d, bench).collect())
    assert len(want) > 400 and [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(x[3] - y[3]) < 1e-6 for x, y in zip(got, want, strict=True))


def test_row_numbers_are_stored(spark, monkeypatch):
    """Rows stay who they are when the tables are split otherwise in between, as after the loss of an executor."""
    want = sorted(r.doc_id for r in neardup.near_duplicates(docs(spark)).where("kept").collect())
    conf, kept = "spark.sql.files.maxPartitionBytes", neardup.store

    def store(df, name):
        out = kept(df, name)
        spark.conf.set(conf, "20000")
        return out

    monkeypatch.setattr(neardup, "store", store)
    try:
        got = sorted(r.doc_id for r in neardup.drop_near_duplicates(docs(spark)).collect())
    finally:
        spark.conf.unset(conf)
    assert got == want
