"""Tables written for people and other programs: upserts, CSV, JSON bundles, markdown reports; and case definitions read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import messages, text

CASE_SCHEMA = "id string, name string, category string, difficulty string, tags array<string>, prompt string, pass_threshold double, graders array<struct<type:string,weight:double,negate:boolean,forbidden:boolean,path:string,pattern:string>>, _corrupt_record string"
DIFFICULTIES = ("easy", "medium", "hard", "expert")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: an append-only table read as one of upserts."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those of their keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def write_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, nested values as JSON, a header."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def redacted(value: Column, kind: T.DataType) -> Column:
    """A value of any shape with every text in it redacted, names of a map too."""
    if isinstance(kind, T.StringType):
        return text.redact(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(redacted(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        # names that become alike would clash, so a map is a list of its pairs
        return F.transform(F.map_entries(value), lambda e: F.struct(redacted(e["key"], kind.keyType).alias("key"), redacted(e["value"], kind.valueType).alias("value")))
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(text.redact(F.to_json(value)))
    return value


def redacted_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """df with every text in it redacted by the rules for paths and secrets, however deep it lies; keep: columns left as they are."""
    return df.select(*(F.col(f.name) if f.name in keep else redacted(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields))


def write_json(df: DataFrame, path: str, by: str, safe: bool = False) -> None:
    """A folder for each value of by with its rows as JSON lines; safe: all texts are redacted."""
    (redacted_rows(df, (by,)) if safe else df).write.mode("overwrite").partitionBy(by).json(path)


def report_rows(cases: DataFrame) -> DataFrame:
    """run_id, place, line: a run's report as lines of markdown: its title, a table with a row for each case, its total."""
    cell = lambda c: messages.markdown_cell(F.col(c))
    row = cases.select("run_id", F.lit(2).alias("part"), "case_id", "sample", F.concat(F.lit("| "), cell("case_id"), F.lit(" | "), cell("sample"), F.lit(" | "), cell("status"), F.lit(" | "), F.format_string("%.2f", "cost"), F.lit(" |")).alias("line"))
    total = cases.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "passed").alias("ok"), F.sum("cost").alias("cost"))
    null = lambda c: F.lit(None).cast(cases.schema[c].dataType).alias(c)
    extra = lambda part, line: total.select("run_id", F.lit(part).alias("part"), null("case_id"), null("sample"), line.alias("line"))
    head = extra(0, F.concat(F.lit("# Run "), F.col("run_id").cast("string"))).union(extra(1, F.lit("| case | sample | status | cost |\n| --- | --- | --- | --- |")))
    foot = extra(3, F.concat(F.lit("Passed "), F.col("ok").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(", "), F.format_string("%.2f", "cost")))
    out = head.union(row).union(foot)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("part", "case_id", "sample")) - 1
    return out.select("run_id", place.alias("place"), "line")


def write_reports(cases: DataFrame, path: str) -> None:
    """A folder for each run with its report, lines in order."""
    rows = report_rows(cases)
    rows.repartition("run_id").sortWithinPartitions("run_id", "place").select("run_id", "line").write.mode("overwrite").partitionBy("run_id").text(path)


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases by id, errors: file, problem) of a folder of JSON case definitions."""
    raw = spark.read.schema(CASE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("file", F.col("_metadata.file_path"))
    checked = problems(raw)
    good = checked.where(F.size("problems") == 0).drop("problems", "_corrupt_record").orderBy("id")
    return good, checked.where(F.size("problems") > 0).select("file", F.array_join("problems", "; ").alias("problem"))


def problems(cases: DataFrame) -> DataFrame:
    """cases with problems: what is wrong with each definition, in order."""
    return cases.withColumn("problems", F.array_compact(F.array(
        F.when(F.col("_corrupt_record").isNotNull(), "not valid JSON"), F.when(F.coalesce("id", F.lit("")) == "", "id missing"), F.when(~F.coalesce("id", F.lit("x")).rlike("^[A-Za-z0-9._-]+$"), "id has marks"),
        F.when(F.coalesce("prompt", F.lit("")) == "", "prompt missing"), F.when(F.coalesce(F.size("graders"), F.lit(0)) <= 0, "no grader"), F.when(~F.coalesce("difficulty", F.lit("easy")).isin(*DIFFICULTIES), "unknown difficulty"),
        F.when((F.col("pass_threshold") < 0) | (F.col("pass_threshold") > 1), "pass_threshold beyond 0 to 1"),
    )))
