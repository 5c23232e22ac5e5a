"""Queries on full-text search and on the texts of conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import messages
from quarry.operators import search
from quarry.plans.registry import query
from quarry.plans.views import millis, table

_TERMS = r"t AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term, unnest(range(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')))) AS pos, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS len FROM documents)"
_SIZES = "z AS (SELECT count(*) AS docs, avg(len) AS mean FROM (SELECT DISTINCT doc, len FROM t))"


def _ranked(parts: str, n: int) -> str:
    """SQL of BM25 over p (doc, len, part, tf)."""
    return f"""WITH {_TERMS}, {_SIZES}, p AS ({parts}), d AS (SELECT part, count(*) AS df FROM p GROUP BY part)
SELECT doc, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM p JOIN d USING (part), z GROUP BY doc HAVING count(*) = {n}"""


def _index(spark, sf):
    d = table(spark, sf, "documents")
    return search.postings(d, "doc_id", "text"), search.sizes(d, "doc_id", "text")


@query(_ranked("SELECT doc, any_value(len) AS len, 0 AS part, count(*) AS tf FROM t WHERE term = 'the' GROUP BY doc UNION ALL SELECT doc, any_value(len), 1, count(*) FROM t WHERE starts_with(term, 'th') GROUP BY doc", 2))
def fts_and_search(spark, sf):
    return search.search(*_index(spark, sf), "the th*", None)


@query(_ranked("SELECT doc, any_value(len) AS len, 0 AS part, count(*) AS tf FROM t WHERE starts_with(term, 'onou') GROUP BY doc", 1))
def fts_prefix(spark, sf):
    return search.search(*_index(spark, sf), "onou*", None)


@query(_ranked("SELECT a.doc, any_value(a.len) AS len, 0 AS part, count(*) AS tf FROM t a JOIN t b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc UNION ALL SELECT doc, any_value(len), 1, count(*) FROM t WHERE term = 'and' GROUP BY doc", 2))
def fts_words_with_marks(spark, sf):
    """A word with marks in it is a phrase of its parts."""
    return search.search(*_index(spark, sf), 'of-the "and"', None)


@query(_ranked("SELECT doc, any_value(len) AS len, 0 AS part, count(*) AS tf FROM t WHERE term = 'and' GROUP BY doc", 1) + " ORDER BY score DESC, doc LIMIT 50")
def fts_top(spark, sf):
    return search.search(*_index(spark, sf), "and")


@query(rf"WITH {_TERMS} SELECT a.doc, count(*) AS times FROM t a JOIN t b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc")
def fts_phrase(spark, sf):
    return search.phrase(search.postings(table(spark, sf, "documents"), "doc_id", "text"), ["of", "the"])


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'brand new text' ELSE text END AS text FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM d)
SELECT term, count(*) AS n, count(DISTINCT doc) AS docs FROM t WHERE term IN ('the', 'brand', 'new', 'text') GROUP BY term""")
def fts_replaced_documents(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    new = d.where("doc_id % 5 = 0").withColumn("text", F.lit("brand new text"))
    index = search.replaced(search.postings(d, "doc_id", "text"), new, "doc_id", "text")
    return index.where(F.col("term").isin("the", "brand", "new", "text")).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') = 'the' OR starts_with(regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g'), 'and')) AS hit FROM w), a AS (SELECT *, list_position(hit, true) AS f FROM h)
SELECT doc_id, CASE WHEN f - 5 > 1 THEN '… ' ELSE '' END || array_to_string([CASE WHEN hit[i] THEN '«' || w[i] || '»' ELSE w[i] END FOR i IN range(greatest(1, f - 5), least(len(w), greatest(1, f - 5) + 13) + 1)], ' ') AS snippet FROM a WHERE f > 0""")
def fts_snippets(spark, sf):
    found = table(spark, sf, "documents").where(search.fits(F.col("text"), "the and*"))
    return found.select("doc_id", search.snippet(F.col("text"), "the and*").alias("snippet"))


_FILES = "SELECT o_orderkey AS file, (epoch_us(o_orderdate) // 1000) AS mtime, CAST(o_totalprice AS BIGINT) AS size, 18 AS version FROM orders"


def _files(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), millis("o_orderdate").alias("mtime"), F.round("o_totalprice").cast("long").alias("size"), F.lit(18).alias("version"))


@query(f"WITH f AS ({_FILES}), t AS (SELECT * FROM f WHERE file % 4 <> 1) SELECT file, mtime, size, version, (SELECT count(*) FROM t) - 25 AS remaining FROM t ORDER BY mtime DESC, file LIMIT 25")
def fts_pending_files(spark, sf):
    f = _files(spark, sf)
    return search.pending(f, f.where("file % 4 = 1"))


@query(f"WITH f AS ({_FILES}) SELECT count(*) AS total, count(*) FILTER (file % 4 = 1) AS indexed FROM f")
def fts_coverage(spark, sf):
    f = _files(spark, sf)
    return search.coverage(f, f.where("file % 4 = 1"))


_TALK = """m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations)"""


@query(f"""WITH {_TALK} SELECT conv_id, max(left(text, 600)) FILTER (role = 'user' AND nth = 1) AS first_user, max(left(text, 400)) FILTER (role = 'assistant' AND nth = n) AS last_assistant,
 string_agg(left(text, 240), chr(10) ORDER BY turn) FILTER (role = 'user' AND nth > 1 AND nth > n - 8) AS later_users FROM m GROUP BY conv_id""")
def judge_digest(spark, sf):
    """The first user turn, the last eight later ones, the last answer. Only these nine turns of a conversation are gathered."""
    m = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id", "role")
    m = m.withColumn("nth", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w))
    user, late = F.col("role") == "user", (F.col("nth") > 1) & (F.col("nth") > F.col("n") - 8)
    g = m.where((user & ((F.col("nth") == 1) | late)) | ((F.col("role") == "assistant") & (F.col("nth") == F.col("n")))).groupBy("conv_id")
    later = F.transform(F.array_sort(F.collect_list(F.when(user & late, F.struct("turn", F.substring("text", 1, 240).alias("text"))))), lambda x: x["text"])
    out = g.agg(F.max(F.when(user & (F.col("nth") == 1), F.substring("text", 1, 600))).alias("first_user"), F.max(F.when(F.col("role") == "assistant", F.substring("text", 1, 400))).alias("last_assistant"), later.alias("later"))
    every = m.select("conv_id").distinct()
    return every.join(out, "conv_id", "left").select("conv_id", "first_user", "last_assistant", F.when(F.size("later") > 0, F.array_join("later", "\n")).alias("later_users"))


@query("""SELECT conv_id, left(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), 100000) AS user_text, left(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), 100000) AS assistant_text,
 left(arg_min(text, turn) FILTER (role = 'user'), 120) AS title FROM conversations GROUP BY conv_id""")
def search_text(spark, sf):
    """What is indexed of a conversation: both sides, of 100,000 characters at most, and a title. Turns beyond a side's length are cut before they are gathered."""
    m = table(spark, sf, "conversations").where("role in ('user', 'assistant')")
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("conv_id", "role").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = m.withColumn("before", before).where("before < 100000").withColumn("text", F.substring("text", 1, 100000))
    side = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    g = near.groupBy("conv_id").agg(side("user").alias("u"), side("assistant").alias("a"), F.count_if(F.col("role") == "user").alias("nu"), F.count_if(F.col("role") == "assistant").alias("na"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("t"))
    every = table(spark, sf, "conversations").select("conv_id").distinct()
    return every.join(g, "conv_id", "left").select("conv_id", F.when(F.col("nu") > 0, F.substring("u", 1, 100000)).alias("user_text"), F.when(F.col("na") > 0, F.substring("a", 1, 100000)).alias("assistant_text"), F.substring("t", 1, 120).alias("title"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview, regexp_replace(regexp_replace(lower(role) || ' ' || CAST(turn AS VARCHAR) || '/x', '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS part,
 '"' || replace(text, '"', '""') || '"' AS cell FROM conversations""")
def message_previews(spark, sf):
    m = table(spark, sf, "conversations")
    name = F.concat(F.lower("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("/x"))
    return m.select("conv_id", "turn", messages.preview(F.col("text"), 100).alias("preview"), messages.path_part(name).alias("part"), messages.csv_cell(F.col("text")).alias("cell"))


@query("SELECT conv_id, turn, 'at' || CAST(turn AS VARCHAR) AS key, turn AS ms FROM conversations")
def cursor_round_trip(spark, sf):
    """A page's cursor, written and read again."""
    key = F.concat(F.lit("at"), F.col("turn").cast("string"))
    c = messages.from_cursor(messages.cursor(F.col("turn"), key))
    return table(spark, sf, "conversations").select("conv_id", "turn", c["key"].alias("key"), c["at"].alias("ms"))
