"""Walks over JSON values of any shape (variants): every leaf with its path, and leaves whose path fits a pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Objects and arrays inside one another that are gone into.
DEPTH = 12


def leaves(df: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """df's other columns, path and text (a leaf's value as text) for every leaf of the variant column.

    Paths have names joined by dots and places in brackets: a.b[0].c. Values deeper than depth are left as one text. Each
    level opens the objects and arrays of a row's list where they stand, so rows are read once, and one explode ends it."""
    one = lambda path, v: F.struct(path.alias("path"), v.alias("v"))

    def opened(x: Column) -> Column:
        inner, listed = F.try_variant_get(x["v"], "$", "map<string,variant>"), F.try_variant_get(x["v"], "$", "array<variant>")
        named = F.transform(F.map_entries(inner), lambda e: one(F.concat(x["path"], F.when(x["path"] == "", "").otherwise("."), e["key"]), e["value"]))
        placed = F.transform(listed, lambda y, i: one(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), y))
        return F.when(inner.isNotNull(), named).when(listed.isNotNull(), placed).otherwise(F.array(x))

    found = F.array(one(F.lit(""), F.col(column)))
    for _ in range(depth):
        found = F.flatten(F.transform(found, opened))
    own = [c for c in df.columns if c != column]
    out = df.where(F.col(column).isNotNull()).select(*own, F.explode(found).alias("leaf"))
    return out.select(*own, F.col("leaf.path").alias("path"), F.try_variant_get("leaf.v", "$", "string").alias("text"))


def fits(path: Column, pattern: str) -> Column:
    """Whether a path fits: * stands for one name, [*] for any place."""
    parts = re.split(r"(\[\*\]|\*)", pattern)
    rule = "".join({"*": r"[^.\[\]]+", "[*]": r"\[[0-9]+\]"}.get(p, re.escape(p)) for p in parts)
    return path.rlike(f"^{rule}$")


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """leaves whose path fits the pattern and whose value is a text."""
    steps = pattern.count(".") + pattern.count("[") + 1
    kept = leaves(df, column, steps)
    return kept.where(fits(F.col("path"), pattern) & F.col("text").try_cast("double").isNull())
