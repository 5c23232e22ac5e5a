"""Full-text search: stored postings of several fields, AND of words, phrases and prefixes, BM25 ranks, snippets.

The index is a table of postings (term, doc, field, pos, len), where len is the document's number of terms: it is counted in
the document's own row, so building the index shuffles nothing. Stored, it is clustered by a bucket of the term and sorted
by the term in it, so a query reads the buckets of its terms; updates replace whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BUCKETS = 64
TERM = r"([\p{L}\p{N}]+)"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), 1)


def postings(docs: DataFrame, id_col: str, *fields: str) -> DataFrame:
    """(term, doc, field, pos, len) for every run of letters and digits of the fields, in lower case."""
    lists = F.array(*(F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("terms")) for f in fields))
    size = F.aggregate(lists, F.lit(0), lambda n, x: n + F.size(x["terms"]))
    each = docs.select(F.col(id_col).alias("doc"), size.alias("len"), F.explode(lists).alias("f"))
    return each.select(F.posexplode("f.terms").alias("pos", "term"), "doc", F.col("f.field").alias("field"), "len").select("term", "doc", "field", "pos", "len")


def sizes(docs: DataFrame, id_col: str, *fields: str) -> DataFrame:
    """docs and mean: number of documents with a term, and their mean number of terms."""
    n = sum((F.size(terms(F.col(f))) for f in fields[1:]), F.size(terms(F.col(fields[0]))))
    return docs.select(n.alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))


def save(index: DataFrame, path: str) -> None:
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    index.withColumn("bucket", bucket).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replaced(index: DataFrame, docs: DataFrame, id_col: str, *fields: str) -> DataFrame:
    """The index with the given documents in place of their former postings."""
    rest = index.join(docs.select(F.col(id_col).alias("doc")).distinct(), "doc", "left_anti")
    return rest.select("term", "doc", "field", "pos", "len").unionByName(postings(docs, id_col, *fields))


def pending(files: DataFrame, indexed: DataFrame, most: int = 25) -> DataFrame:
    """The newest files that the index lacks in this version, 1 to 200, with how many remain after them."""
    todo = files.join(indexed, ["file", "mtime", "size", "version"], "left_anti")
    most = max(1, min(200, most))
    return todo.orderBy(F.desc("mtime"), "file").limit(most).join(F.broadcast(todo.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("remaining"))))


def coverage(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Number of files, and of those that the index has."""
    hit = files.join(indexed.select("file").distinct().withColumn("hit", F.lit(True)), "file", "left")
    return hit.agg(F.count("*").alias("total"), F.count("hit").alias("indexed"))


def parse(query: str) -> list[list[tuple[str, bool]]]:
    """The parts of a query, all required: each a run of (term, prefix) next to each other; marks inside a word only part it."""
    out = []
    for word in query.split():
        found = [t for t in "".join(c if c.isalnum() else " " for c in word.lower()).split()]
        if found:
            out.append([(t, word.endswith("*") and i + 1 == len(found)) for i, t in enumerate(found)])
    return out


def _fits(term: str, prefix: bool) -> Column:
    return F.col("term").startswith(term) if prefix else F.col("term") == term


def occurrences(index: DataFrame, parts: list[list[tuple[str, bool]]]) -> DataFrame:
    """doc, len, part, tf: how often each document has each part. A posting counts for every place of a part that it fits."""
    slots = [(i, j, w, p) for i, part in enumerate(parts) for j, (w, p) in enumerate(part)]
    some = index.where(F.array_contains(F.array(*(_fits(w, p) for _, _, w, p in slots)), True))
    places = F.filter(F.array(*(F.when(_fits(w, p), F.struct(F.lit(i).alias("part"), F.lit(j).alias("slot"))) for i, j, w, p in slots)), lambda x: x.isNotNull())
    each = some.select("doc", "len", "field", "pos", F.explode(places).alias("x")).select("doc", "len", "field", "x.part", (F.col("pos") - F.col("x.slot")).alias("start"))
    whole = each.groupBy("doc", "len", "part", "field", "start").agg(F.count("*").alias("n"))
    need = F.element_at(F.array(*(F.lit(len(p)) for p in parts)), F.col("part") + 1)
    return whole.where(F.col("n") == need).groupBy("doc", "len", "part").agg(F.count("*").alias("tf"))


def search(index: DataFrame, stats: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """doc, score of the documents with all parts of the query, best BM25 first, ties by id; limit: 1 to 200, None for all.

    stats: sizes(). Without a word in the query nothing is found."""
    parts = parse(query)
    if not parts:
        return index.select("doc", F.lit(0.0).alias("score")).where(F.lit(False))
    tf = occurrences(index, parts)
    df = tf.groupBy("part").agg(F.count("*").alias("df"))  # a row for each part of the query
    hit = tf.join(F.broadcast(df), "part").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    found = hit.groupBy("doc").agg(F.count("*").alias("parts"), F.sum(weight).alias("score")).where(F.col("parts") == len(parts))
    ranked = found.select("doc", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc")
    return ranked if limit is None else ranked.limit(max(1, min(200, limit)))


def phrase(index: DataFrame, words: list[str]) -> DataFrame:
    """Documents that have the words next to each other, and how often."""
    return occurrences(index, [[(w, False) for w in words]]).select("doc", F.col("tf").alias("times"))


#: Words are parted by these characters; what else is neither letter nor digit does not count in a word.
_SPACE, _MARK = r"[\x20\x09-\x0D]", r"[^\p{L}\p{N}\x20\x09-\x0D]*+"


def _first(slots: list[tuple[str, bool]]) -> str:
    """The pattern of a word that fits, with the space before it, in a text in lower case."""
    each = ("".join(_MARK + c for c in t) + ("" if p else _MARK + rf"(?:{_SPACE}|\z)") for t, p in slots)
    return rf"(?:\A|{_SPACE})(?:{'|'.join(each)})"


def fits(text: Column, query: str) -> Column:
    """Whether any word of the text fits the query: one search that ends with the first."""
    slots = [x for part in parse(query) for x in part]
    return F.lower(text).rlike(_first(slots)) if slots else F.lit(False)


def snippet(text: Column, query: str, most: int = 14, before: int = 5) -> Column:
    """The words around the first that fits the query, those that fit marked; null without one.

    The first is found by one search in the text, and only the words around it are looked at one by one."""
    slots = [x for part in parse(query) for x in part]
    if not slots:
        return F.lit(None).cast("string")

    def marked(w: Column) -> Column:
        bare = F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")
        out = F.lit(False)
        for t, p in slots:
            out = out | (bare.startswith(t) if p else bare == t)
        return F.when(out, F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w)

    parted = F.split(F.lower(text), _first(slots), 2)
    at = F.size(F.filter(F.split(F.get(parted, F.lit(0)), _SPACE + "+"), lambda w: w != "")) + 1
    start = F.greatest(F.lit(1), at - before)
    words = F.split(F.ltrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(_SPACE + "+"), start + most)  # the last piece is the rest
    shown = F.transform(F.filter(F.slice(words, start, most), lambda w: w != ""), marked)
    return F.when(F.size(parted) == 2, F.concat(F.when(start > 1, "… ").otherwise(""), F.array_join(shown, " ")))
