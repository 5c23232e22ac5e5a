"""Mixing sources to target weights: hierarchical budgets over a tree of domain, language and source.

A token budget is shared out from the root. At each node the children's shares follow their weights, but no child gets more
than its subtree can give (its tokens times ``max_epochs``); what it can't give goes to its siblings in proportion to their
weights, and only what a whole subtree can't give has been passed to its parent's siblings before. This is water-filling,
here in closed form with window functions: children are ordered by capacity over weight, and those below the water level
give all they have.

Each leaf then takes whole epochs of its documents and a prefix of one more: documents in the order of
md5(seed:epoch:id), as long as the tokens before a document are under the leaf's quota (so the last one may reach over it).
The prefix is found without sorting a leaf: tokens are summed by the first two hex digits of the key, the bucket of 256
that the quota falls into is found, its tokens are summed by the next two digits, and so on; only the documents of the last
bucket are ordered. A leaf has 256 rows at most in a window then. Siblings are put in order in one task while a level of
the tree has at most BROADCAST_ROWS nodes; larger levels are sorted by ranges, with sums carried over from range to range.

Everything is DataFrame functions; texts are never shuffled. Rows are told apart by a stored number.

Nulls and odd cases: a null text has no tokens; a document without tokens is chosen only as part of a whole epoch or
before the quota is reached; a null language, source or domain forms a branch named ``unknown``; a null id counts as an
empty id in the key; equal keys (repeated ids) are taken in the order of the rows. A branch of weight 0 or less gets
nothing. A budget of 0, an empty table, or one without tokens gives an empty result. Extra columns are kept in mix() and
may have any names; columns named domain, n_tokens and epoch are replaced by the mixture's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, numbered, store, tidy

#: HEX digits of the key are looked at in each of DEPTH steps.
SEED, FRACTION, MAX_EPOCHS, HEX, DEPTH = 7, 0.8, 2, 2, 2
RANGES = 200
LEVELS = ("domain", "lang", "source")
#: Target weights; a name that is not listed has the weight under "".
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"domain0": 0.4, "domain1": 0.3, "domain2": 0.2, "domain3": 0.1, "": 0.05},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, "": 0.05},
    "source": {"": 1.0},
}


def default_domain() -> Column:
    """The domain of a source: its trailing number modulo 4."""
    n = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(n == "", "unknown").otherwise(F.concat(F.lit("domain"), (n.try_cast("int") % 4).cast("string")))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    table = weights[level]
    out = F.lit(None).cast("double")
    for name, w in table.items():
        if name:
            out = F.coalesce(out, F.when(F.col(level) == name, F.lit(float(w))))
    return F.coalesce(out, F.lit(float(table.get("", 0.0))))


def _sums_before(df: DataFrame, parent: list[str], order: list[str], values: list[str], most: int) -> DataFrame:
    """df with before_x for each x of values: the sum of x over its siblings that come earlier.

    Up to ``most`` rows by a window of siblings; more are sorted by ranges and each range gets the sums of those before."""
    if df.limit(most + 1).count() <= most:
        w = Window.partitionBy(*parent, "budget").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(w), F.lit(0.0)) for v in values})
    parts = store(df.repartitionByRange(RANGES, *parent, *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    whole = Window.partitionBy(*parent, "budget").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.groupBy(*parent, "budget", "range").agg(*(F.sum(v).alias(f"all_{v}") for v in values))
    ahead = ahead.select(*parent, "budget", "range", *(F.coalesce(F.sum(f"all_{v}").over(whole), F.lit(0.0)).alias(f"ahead_{v}") for v in values))
    inside = Window.partitionBy(*parent, "budget", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0.0)) for v in values}).join(ahead, [*parent, "budget", "range"])
    return out.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"ahead_{v}") for v in values}).drop("range", *(f"ahead_{v}" for v in values))


def _fill(nodes: DataFrame, parent: list[str], child: str, weights: dict[str, dict[str, float]], most: int) -> DataFrame:
    """nodes: parent columns, child, capacity, budget of the parent -> the child's own budget as ``share``."""
    w = store(nodes.withColumn("weight", _weight(child, weights)).where("weight > 0 and capacity > 0").withColumn("ratio", F.col("capacity") / F.col("weight")), "mix-nodes")
    by = [*parent, "budget"]
    before = _sums_before(w, parent, ["ratio", child], ["capacity", "weight"], most)
    total = w.groupBy(*by).agg(F.sum("weight").alias("all_weight"))
    level = (F.col("budget") - F.col("before_capacity")) / (F.col("all_weight") - F.col("before_weight"))
    full = store(before.join(total, by).withColumn("full", F.col("capacity") <= F.col("weight") * level), "mix-full")
    given = full.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))), F.lit(0.0)).alias("given"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("left"))
    share = F.when(F.col("full"), F.col("capacity")).otherwise(F.greatest(F.lit(0.0), F.col("budget") - F.col("given")) * F.col("weight") / F.col("left"))
    return full.join(given, by).withColumn("share", share).drop("weight", "ratio", "full", "budget", "given", "left", "all_weight", "before_capacity", "before_weight")


def budgets(leaves: DataFrame, fraction: float, max_epochs: int, weights: dict[str, dict[str, float]], most: int = BROADCAST_ROWS) -> DataFrame:
    """leaves (domain, lang, source, tokens) -> each leaf's quota of tokens. Sizes follow the number of leaves, not of rows."""
    capacity = (F.sum("tokens") * max_epochs).cast("double").alias("capacity")
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(fraction)).cast("double").alias("all"), F.coalesce(F.sum("tokens") * max_epochs, F.lit(0)).cast("double").alias("most"))
    budget = total.select(F.least("all", "most").alias("budget"))
    domains = _fill(leaves.groupBy("domain").agg(capacity).join(F.broadcast(budget)), [], "domain", weights, most).select("domain", F.col("share").alias("budget"))
    langs = _fill(leaves.groupBy("domain", "lang").agg(capacity).join(domains, "domain"), ["domain"], "lang", weights, most).select("domain", "lang", F.col("share").alias("budget"))
    sources = _fill(leaves.groupBy("domain", "lang", "source").agg(capacity, F.sum("tokens").alias("tokens")).join(langs, ["domain", "lang"]), ["domain", "lang"], "source", weights, most)
    quota = F.floor(F.col("share") + 1e-6).cast("long")
    return sources.select(*LEVELS, "tokens", quota.alias("quota"), F.floor(quota / F.col("tokens")).cast("int").alias("whole"), (quota % F.col("tokens")).alias("part"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, float]] | None = None, seed: int = SEED, uid: Column | None = None) -> DataFrame:
    """One row for each row of docs: uid, id, domain, lang, source, n_tokens, and times (copies that the mixture takes).

    Copies number 1 to times; all but a last, partial one are whole epochs. uid: a stored row number, if docs has one."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    rows = docs.select(
        (uid if uid is not None else F.monotonically_increasing_id()).alias("uid"),
        F.col(id_col).alias("id"),
        name(domain if domain is not None else default_domain()).alias("domain"),
        name(F.col("lang")).alias("lang"),
        name(F.col("source")).alias("source"),
        n_words(F.col(text_col)).alias("n_tokens"),
    )
    tidy(docs.sparkSession)
    rows = store(rows, "mix-rows")
    # the leaves are many times fewer than the rows; their number is checked before they are sent to tasks
    tokens = store(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "mix-tokens")
    leaves = store(budgets(tokens, fraction, max_epochs, weights or WEIGHTS), "mix-leaves")
    small = leaves.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda df: df
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = rows.join(hint(leaves.where("quota > 0").drop("tokens", "quota")), list(LEVELS)).withColumn("key", key)
    keyed = store(keyed, "mix-keyed")
    # a leaf's edge: the start of the keys of the bucket that its quota falls into, and the tokens in the buckets before
    edge = leaves.where("quota > 0 and part > 0").select(*LEVELS, F.lit("").alias("edge"), F.lit(0).cast("long").alias("before"))
    upto = F.sum("inside").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    for depth in range(1, DEPTH + 1):
        inside = keyed.where("part > 0").join(hint(edge), list(LEVELS)).where(F.col("key").startswith(F.col("edge")))
        by_bucket = inside.groupBy(*LEVELS, F.substring("key", 1, HEX * depth).alias("bucket")).agg(F.sum("n_tokens").alias("inside"), F.first("part").alias("part"), F.first("before").alias("before"))
        summed = by_bucket.withColumn("upto", F.col("before") + upto)
        edge = store(summed.where("upto >= part and upto - inside < part").select(*LEVELS, F.col("bucket").alias("edge"), (F.col("upto") - F.col("inside")).alias("before")), "mix-edges")
    keyed = keyed.join(hint(edge), list(LEVELS), "left")
    ahead = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at_edge = F.coalesce(F.col("key").startswith(F.col("edge")), F.lit(False))
    inside = keyed.where(at_edge).withColumn("ahead", F.col("before") + ahead).withColumn("times", F.col("whole") + F.when(F.col("ahead") < F.col("part"), 1).otherwise(0))
    other = keyed.where(~at_edge).withColumn("times", F.col("whole") + F.when(F.col("key") < F.col("edge"), 1).otherwise(0))
    return inside.select(*rows.columns, "times").union(other.select(*rows.columns, "times")).where("times > 0")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col, domain, lang, source, n_tokens, epoch (from 1): one row for each copy of a document that the mixture takes."""
    chosen = plan(docs, id_col, text_col, **options)
    return chosen.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(1), "times")).alias("epoch"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with its columns, a row for each copy taken, and the columns domain, n_tokens and epoch."""
    whole = numbered(docs, "__quarry_uid")
    chosen = plan(whole, id_col, text_col, uid=F.col("__quarry_uid"), **options)
    chosen = store(chosen.select(F.col("uid").alias("__quarry_uid"), F.col("domain").alias("__quarry_domain"), F.col("n_tokens").alias("__quarry_tokens"), F.col("times").alias("__quarry_times")), "mix-chosen")
    small = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = whole.join(F.broadcast(chosen) if small else chosen, "__quarry_uid")
    own = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")]
    return rows.select(*own, F.col("__quarry_domain").alias("domain"), F.col("__quarry_tokens").alias("n_tokens"), F.explode(F.sequence(F.lit(1), "__quarry_times")).alias("epoch"))
