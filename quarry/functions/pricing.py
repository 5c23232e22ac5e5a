"""Model rates and costs. Rates are data: a catalogue (alias, source_model, input, output, cache_read, cache_write per million)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import stats

KINDS = ("input", "output", "cache_read", "cache_write")
#: What a named model without a known family costs (fixed values).
DEFAULT_RATE = {"input": 1.0, "output": 3.0, "cache_read": 0.1, "cache_write": 1.25}
PLACEHOLDERS = ("<synthetic>", "synthetic", "unknown", "null", "none")
STORE = "/data/models/hf/"


def display_model(model: Column) -> Column:
    """A model's name without the folder of a machine's model store; null if blank."""
    id_ = F.trim(model)
    low = F.lower(id_)
    at = F.length(low) - F.locate(STORE[::-1], F.reverse(low)) + 2
    stored = F.concat(F.lit("hf:"), F.lower(F.replace(F.substr(id_, at), F.lit("__"), F.lit("/"))))
    return F.when(id_ == "", F.lit(None)).when(low.contains(STORE), stored).otherwise(id_)


def is_placeholder(model: Column) -> Column:
    return F.coalesce(F.lower(F.trim(model)).isin("", *PLACEHOLDERS), F.lit(True))


def rates(models: DataFrame, catalogue: DataFrame, families: list[tuple[str, str, str]]) -> DataFrame:
    """models (model, distinct) -> model, confidence (listed, family, fallback; null: no price), source_model and a rate of each kind.

    families: (how: is, starts or holds; text; source_model), the first that fits counts. The catalogue is a list of models
    and is sent to the tasks."""
    id_ = F.lower(display_model(F.col("model")))
    family = F.lit(None).cast("string")
    for how, text, source in reversed(families):
        fits = id_ == text if how == "is" else id_.startswith(text) if how == "starts" else id_.contains(text)
        family = F.when(fits, source).otherwise(family)
    named = models.select("model").distinct().withColumn("id", F.when(~is_placeholder(F.col("model")), id_)).withColumn("family", family)
    by_alias = catalogue.select(F.col("alias").alias("id"), F.col("source_model").alias("listed"), *(F.col(k).alias(f"l_{k}") for k in KINDS))
    by_source = catalogue.dropDuplicates(["source_model"]).select(F.col("source_model").alias("family"), *(F.col(k).alias(f"f_{k}") for k in KINDS))
    j = named.join(F.broadcast(by_alias), "id", "left").join(F.broadcast(by_source), "family", "left")
    confidence = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("listed").isNotNull(), "listed").when(F.col("f_input").isNotNull(), "family").otherwise("fallback")
    rate = [F.when(F.col("id").isNotNull(), F.coalesce(f"l_{k}", f"f_{k}", F.lit(DEFAULT_RATE[k]))).alias(f"rate_{k}") for k in KINDS]
    return j.select("model", confidence.alias("confidence"), F.when(F.col("id").isNotNull(), F.coalesce("listed", F.when(F.col("f_input").isNotNull(), F.col("family")), F.lit("fallback"))).alias("source_model"), *rate)


def estimate(usage: DataFrame, priced: DataFrame) -> DataFrame:
    """usage (model, input, output, cache_read, cache_write) with cost: null without tokens or a price."""
    j = usage.join(F.broadcast(priced), usage["model"].eqNullSafe(priced["model"]), "left").drop(priced["model"])
    return j.withColumn("cost", stats.cost_usd({k: F.col(k) for k in KINDS}, {k: F.col(f"rate_{k}") for k in KINDS})).drop("confidence", "source_model", *(f"rate_{k}" for k in KINDS))


def volume() -> Column:
    return sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))


def mixed_cost(costs: DataFrame) -> DataFrame:
    """session, cost: the sum over its models; null if a model with tokens has no price, or none has tokens."""
    used = costs.where(volume() > 0)
    return costs.select("session").distinct().join(used.groupBy("session").agg(F.when(~F.bool_or(F.col("cost").isNull()), F.sum("cost")).alias("cost")), "session", "left")


FIELDS = (*KINDS, "calls", "errors")


def attributed(sessions: DataFrame, usage: DataFrame) -> DataFrame:
    """session, place, model and FIELDS: a session's totals by model. What its models leave goes to the primary model.

    sessions: session, model (primary) and FIELDS; usage: session, place (order), model and FIELDS. A session without usage,
    or whose usage exceeds a total, is one row."""
    sums = usage.groupBy("session").agg(*(F.sum(f).alias(f"sum_{f}") for f in FIELDS))
    all_ = sessions.select("session", F.col("model").alias("primary"), *(F.col(f).alias(f"all_{f}") for f in FIELDS)).join(sums, "session", "left")
    over = F.col("sum_input").isNull()
    for f in FIELDS:
        over = over | (F.col(f"sum_{f}") > F.col(f"all_{f}"))
    all_ = all_.withColumn("whole", over)
    one = all_.where("whole").select("session", F.lit(0).cast("long").alias("place"), F.coalesce("primary", F.lit("unknown")).alias("model"), *(F.col(f"all_{f}").alias(f) for f in FIELDS))
    rows = usage.join(all_.where("not whole"), "session")
    first = F.row_number().over(Window.partitionBy("session").orderBy(F.when(F.col("model") == F.col("primary"), 0).otherwise(1), "place")) == 1
    rows = rows.withColumn("gets", first)
    more = [(F.col(f) + F.when(F.col("gets"), F.col(f"all_{f}") - F.col(f"sum_{f}")).otherwise(0)).alias(f) for f in FIELDS]
    return one.unionByName(rows.select("session", F.col("place").cast("long").alias("place"), "model", *more))


def shared_costs(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """rows (session, place, model, FIELDS, cost: their estimate) with share: the session's cost by estimate, else by tokens or calls, else to the first."""
    w = Window.partitionBy("session")
    j = rows.withColumn("guess", F.coalesce("cost", F.lit(0.0))).drop("cost").join(sessions.select("session", F.col("cost").alias("spent")), "session")
    amount = F.when(volume() > 0, volume()).otherwise(F.col("calls")).cast("double")
    guessed, measured = F.sum("guess").over(w), F.sum(amount).over(w)
    first = F.row_number().over(w.orderBy("place")) == 1
    share = F.when(F.col("spent") <= 0, 0.0).when(guessed > 0, F.col("spent") * F.col("guess") / guessed).when(measured > 0, F.col("spent") * amount / measured).when(first, F.col("spent")).otherwise(0.0)
    return j.withColumn("share", share).drop("guess", "spent")


def refreshed(cost: Column, source: Column, now: Column) -> tuple[Column, Column]:
    """(cost, source) on reading: inferred and missing costs follow the present rates, measured ones stay."""
    new = source.isin("inferred", "missing")
    return F.when(new, F.coalesce(now, F.lit(0.0))).otherwise(cost), F.when(new, F.when(now.isNotNull(), "inferred").otherwise("missing")).otherwise(source)


def drift(local: DataFrame, remote: DataFrame) -> DataFrame:
    """source_model, kind, local, remote of rates that differ by more than 1e-9, or that the remote list lacks."""
    long = lambda d, name: d.dropDuplicates(["source_model"]).select("source_model", F.explode(F.create_map(*(x for k in KINDS for x in (F.lit(k), F.col(k))))).alias("kind", name))
    j = long(local, "local").join(long(remote, "remote"), ["source_model", "kind"], "left")
    return j.where(F.col("remote").isNull() | (F.abs(F.col("local") - F.col("remote")) > 1e-9))
