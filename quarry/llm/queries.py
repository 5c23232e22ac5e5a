"""The queries of the corpus operators, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import ann, convrepair, convsql, decontam, hardneg, html, langid, lm, mixing, neardup, quality, secrets, tokens, toxicity
from quarry.llm.common import clear, read


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("uid")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(read(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op8_language_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_ids(read(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mined(read(spark, sf_dir, "embeddings"))


def op12_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair(convrepair.damaged(read(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixture, op2_benchmark_leaks, op3_token_counts, op4_nearest_neighbours, op5_quality_scores, op6_lm_scores, op7_main_text, op8_language_ids, op9_near_duplicates, op10_secret_scan, op11_hard_negatives, op12_toxicity_scores, op13_conversation_repair)
}

_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _case(column: str) -> str:
    table = mixing.WEIGHTS[column]
    listed = " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in table.items() if k)
    return f"CAST(CASE {listed} ELSE {table['']} END AS DOUBLE)" if listed else f"CAST({table['']} AS DOUBLE)"


def _filled(name: str, nodes: str, parent: str, child: str) -> str:
    """Water-filling among siblings, as common table expressions."""
    by = f"PARTITION BY {parent}" if parent else ""
    columns = f"{parent}, {child}" if parent else child
    return f"""
{name}_w AS (SELECT * FROM (SELECT *, {_case(child)} AS weight FROM ({nodes})) WHERE weight > 0 AND capacity > 0),
{name}_l AS (SELECT *, capacity <= weight * ((budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS full_ FROM {name}_w WINDOW o AS ({by} ORDER BY capacity / weight, {child})),
{name} AS (SELECT {columns}, CASE WHEN full_ THEN capacity ELSE greatest(0.0, budget - coalesce(sum(capacity) FILTER (full_) OVER p, 0)) * weight / sum(weight) FILTER (NOT full_) OVER p END AS budget
  FROM {name}_l WINDOW p AS ({by}))"""


ORACLE: dict[str, str] = {
    "op11_hard_negatives": hardneg.SQL,
    "op13_conversation_repair": convsql.SQL,
    "op1_mixture": rf"""
WITH d AS (SELECT doc_id, coalesce(CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'unknown'
    ELSE 'domain' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4 AS VARCHAR) END, 'unknown') AS domain,
  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
total AS (SELECT least(floor(sum(tokens) * {mixing.FRACTION}), sum(tokens) * {mixing.MAX_EPOCHS}) AS budget FROM leaf),
{_filled("b1", f"SELECT domain, sum(tokens) * {mixing.MAX_EPOCHS} AS capacity, any_value(total.budget) AS budget FROM leaf, total GROUP BY domain", "", "domain")},
{_filled("b2", f"SELECT leaf.domain, lang, sum(tokens) * {mixing.MAX_EPOCHS} AS capacity, any_value(b1.budget) AS budget FROM leaf JOIN b1 ON leaf.domain = b1.domain GROUP BY leaf.domain, lang", "domain", "lang")},
{_filled("b3", f"SELECT leaf.domain, leaf.lang, source, tokens * {mixing.MAX_EPOCHS} AS capacity, b2.budget FROM leaf JOIN b2 ON leaf.domain = b2.domain AND leaf.lang = b2.lang", "domain, lang", "source")},
q AS (SELECT domain, lang, source, CAST(floor(b3.budget + 1e-6) AS BIGINT) AS quota, CAST(tokens AS BIGINT) AS tokens FROM b3 JOIN leaf USING (domain, lang, source)),
r AS (SELECT d.*, quota // tokens AS whole, quota % tokens AS part, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mixing.SEED}:' || CAST(quota // tokens AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR))
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN q USING (domain, lang, source) WHERE quota > 0),
t AS (SELECT *, whole + CASE WHEN ahead < part THEN 1 ELSE 0 END AS times FROM r)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(1, times + 1)) AS INTEGER) AS epoch FROM t""",
    "op2_benchmark_leaks": rf"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
il AS (SELECT *, len(ws) AS l, least(5, len(ws)) AS sz FROM iw WHERE len(ws) > 0),
ia AS (SELECT item_id, l, sz, unnest([array_to_string(ws[i:i + sz - 1], ' ') FOR i IN range(1, l - sz + 2)]) AS s FROM il),
ic AS (SELECT item_id, l, sz, s, count(*) AS n FROM ia GROUP BY ALL),
wt AS (SELECT s, greatest(1, 4 // count(DISTINCT item_id)) AS w FROM ic GROUP BY s),
i AS (SELECT ic.*, w FROM ic JOIN wt USING (s)),
iwt AS (SELECT item_id, l, sum(n * w) AS iweight FROM i GROUP BY ALL),
p AS (SELECT doc_id, len(ws) AS nw, sz, unnest(range(0, len(ws) - sz + 1)) AS pos, ws FROM dw, (SELECT DISTINCT sz FROM il)),
ps AS (SELECT doc_id, nw, sz, pos, array_to_string(ws[pos + 1:pos + sz], ' ') AS s FROM p),
h AS (SELECT ps.*, w FROM ps JOIN wt USING (s)),
st AS (SELECT DISTINCT doc_id, nw, pos, i.l, i.sz FROM h JOIN i ON h.s = i.s AND h.sz = i.sz),
f AS (SELECT st.doc_id, st.nw, st.pos, st.l, st.sz, h.s, any_value(h.w) AS w, count(*) AS n FROM st JOIN h ON h.doc_id = st.doc_id AND h.sz = st.sz AND h.pos BETWEEN st.pos AND st.pos + st.l - st.sz GROUP BY ALL),
fw AS (SELECT doc_id, nw, pos, l, sz, sum(w * n) + (least(l, nw - pos) - sz + 1 - sum(n)) AS weight FROM f GROUP BY doc_id, nw, pos, l, sz),
c AS (SELECT f.doc_id, f.pos, f.l, i.item_id, sum(least(f.n, i.n) * i.w) AS common FROM f JOIN i ON f.s = i.s AND f.l = i.l GROUP BY ALL),
r AS (SELECT c.doc_id, c.item_id, c.pos, common / CAST(weight + iweight - common AS DOUBLE) AS similarity FROM c JOIN fw ON fw.doc_id = c.doc_id AND fw.pos = c.pos AND fw.l = c.l JOIN iwt ON iwt.item_id = c.item_id)
SELECT doc_id, item_id, CAST(pos AS INTEGER) AS start, round(similarity, 6) AS similarity FROM r WHERE similarity >= 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, pos) = 1""",
    "op9_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.sh) + len(y.sh) - n)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS top FROM documents UNION SELECT g.b, r.top FROM r JOIN g ON g.a = r.node),
m AS (SELECT node, min(top) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.node = s.doc_id""",
}

__all__ = ["ORACLE", "QUERIES", "clear"]
