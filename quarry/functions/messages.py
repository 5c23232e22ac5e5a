"""Column functions on messages and records: times, coercions, signals, paths, previews, labels, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a judge's own session starts (fixed value).
JUDGE_STUB = "You are grading whether an AI coding-agent session"
#: Times before 2020 are placeholders.
LEAST_MS = 1_577_836_800_000
#: Phrases of failure, and of passing tests (fixed values); boundaries as ASCII look-arounds.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
APOLOGY = "sorry|apolog|i was wrong|my mistake|unable to|couldn'?t|could not|failed to|i can'?t|cannot complete|didn'?t work|not able to"
PASSED = r"all tests? passed?|tests? pass(?:ing|ed)?|\d+ pass(?:ing|ed)|build succe(?:eded|ss(?:ful(?:ly)?)?)?|passing"
#: Shapes of failed tools' output (fixed values).
TOOL_ERRORS = (r"(?:exit(?:ed)? with code|exit code)\s+[1-9]", r"traceback \(most recent call last\)", rf"{_L}(?:error|fatal|panic)\s*:", rf"{_L}(?:command not found|no such file or directory|permission denied|segmentation fault|command failed){_R}")
PATHS = r"(/Users/[^\s\"'<>`]+|/home/[^\s\"'<>`]+|/private/tmp/[^\s\"'<>`]+|/tmp/[^\s\"'<>`]+|\.{1,2}/[A-Za-z0-9._/-]+)"


def timestamp_ms(written: Column, number: Column) -> Column:
    """Milliseconds of a time that is written as ISO text, or a number of seconds (below 1e12) or milliseconds; null before 2020."""
    ms = F.when(number.isNotNull(), F.floor(F.when(number < 1e12, number * 1000).otherwise(number))).otherwise(F.unix_millis(F.try_to_timestamp(written)))
    return F.when(ms >= LEAST_MS, ms)


def numeric_or_null(value: Column) -> Column:
    """A number from a value's text: empty counts as 0, true as 1, false as 0; null if it is none."""
    v = F.trim(value)
    return F.when(v == "", 0.0).when(F.lower(v) == "true", 1.0).when(F.lower(v) == "false", 0.0).otherwise(v.try_cast("double"))


def strict_json(text: Column) -> Column:
    """A text as one JSON value (variant); null if it is none or more follows it."""
    v = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.try_variant_get(v, "$[0]", "variant")
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), one)


def boolean_or_null(value: Column) -> Column:
    v = F.lower(F.trim(value))
    number = v.try_cast("double")
    return F.when(v.isin("true", "1", "yes", "y", "on"), True).when(v.isin("false", "0", "no", "n", "off", ""), False).when(number.isNotNull(), number != 0)


def first_text(value: Column, fallback: Column) -> Column:
    """The value if it is text that is not empty, else the fallback."""
    return F.when(value != "", value).otherwise(fallback)


def model_or_null(model: Column) -> Column:
    """A model's name, null for placeholders."""
    m = F.trim(model)
    return F.when(~F.lower(m).isin("", "<synthetic>", "unknown", "null", "none", "default"), m)


def is_apology(said: Column) -> Column:
    return said.rlike(f"(?i){_L}(?:{APOLOGY}){_R}")


def tests_passed(said: Column) -> Column:
    return said.rlike(f"(?i)(?:{_L}(?:{PASSED}){_R}|✓|✔)")


def is_tool_error(output: Column) -> Column:
    """A leading exit marker, or one in a JSON envelope, decides; otherwise the shapes of errors do."""
    head = F.regexp_extract(output, r"^Exit code: (-?\d+)", 1)
    code = F.when(output.startswith("{"), F.try_variant_get(F.try_parse_json(output), "$.metadata.exit_code", "double"))
    sniffed = F.lit(False)
    for shape in TOOL_ERRORS:
        sniffed = sniffed | output.rlike(f"(?i){shape}")
    return F.coalesce(F.when(head != "", head != "0").when(code.isNotNull(), code != 0).otherwise(sniffed), F.lit(False))


def file_paths(raw: Column) -> Column:
    """Distinct paths in a text, sorted: home and temporary folders and relative ones; no patterns, no addresses."""
    found = F.transform(F.regexp_extract_all(raw, F.lit(PATHS), 1), lambda p: F.regexp_replace(p, r"[),.;:]+$", ""))
    ok = lambda p: ~p.contains("://") & ~p.startswith("//") & ~p.rlike(r"[\[\]^?*|\\`]") & p.contains("/") & ~p.endswith("/")
    return F.array_sort(F.array_distinct(F.filter(found, ok)))


def preview(value: Column, most: int) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value)


def without_context(said: Column) -> Column:
    """What a user wrote after an editor's context in front of it; the text itself if there is none."""
    marker = "## My request for Codex:"
    at = F.locate(marker, said)
    return F.when(said.startswith("# Context from my IDE setup") & (at > 0), F.substr(said, at + len(marker))).otherwise(said)


def is_injected(said: Column, subagent: Column) -> Column:
    """Whether a harness wrote the text: instruction files, and roles that are given to agents."""
    t = F.ltrim(said)
    roles = rf"(?i){_L}(?:team of agents|coordinator|orchestrat\w*|primary agent|worker \d|subagent|multi-agent){_R}"
    return t.startswith("# AGENTS.md instructions") | (t.rlike(rf"^You are{_R}") & (subagent | ((F.length(t) > 120) & t.rlike(roles))))


def test_count(output: Column, what: str = "pass") -> Column:
    """The number of tests that passed or failed: a TAP summary first, then the usual one; 0 without either."""
    tap = F.regexp_extract(output, rf"(?im)^\s*#\s*{what}\s+(\d+)\s*$", 1)
    kinds = "pass(?:ing|ed)?|passing tests?" if what == "pass" else "fail(?:ing|ed)?"
    usual = F.regexp_extract(output, rf"(?i)(?:^|\s)(\d+)\s+(?:{kinds}){_R}", 1)
    return F.coalesce(F.when(tap != "", tap.try_cast("long")).when(usual != "", usual.try_cast("long")), F.lit(0).cast("long"))


def model_family(model: Column, families: list[tuple[str, str]]) -> Column:
    """The first family whose part the name holds, else other."""
    out = F.lit("other")
    for part, family in reversed(families):
        out = F.when(F.lower(model).contains(part), family).otherwise(out)
    return out


def model_label(model: Column) -> Column:
    """A name for people: provider and date cut off, words apart and capital."""
    bare = F.regexp_replace(F.regexp_replace(model, r"^.*/", ""), r"-\d{8}$", "")
    return F.initcap(F.regexp_replace(F.regexp_replace(bare, r"(\d)-(\d)", "$1.$2"), r"[-_]+", " "))


def cost_label(cost: Column, source: Column, known: Column, cases: Column) -> Column:
    """How a cost is to be shown: missing, partial, estimated or measured."""
    return F.when(cases == 0, "missing").when(known == 0, "missing").when(known < cases, "partial").when(source == "inferred", "estimated").when(source == "measured", "measured").otherwise("legacy")


def cursor(at: Column, key: Column) -> Column:
    """A page's cursor as text that fits an address."""
    raw = F.to_json(F.struct(at.alias("at"), key.alias("key")))
    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(raw, "UTF-8")), r"\s", ""), "+/", "-_"), F.lit("="))


def from_cursor(c: Column) -> Column:
    """(at, key) of a cursor, null for anything else."""
    full = F.translate(c, "-_", "+/")
    padded = F.concat(full, F.repeat(F.lit("="), F.pmod(-F.length(full), F.lit(4))))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "at long, key string")


def csv_cell(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def markdown_cell(value: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def path_part(value: Column) -> Column:
    """A name that is safe as a file's."""
    return F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def judge_json(said: Column) -> Column:
    """The widest {...} of a text that parses: from the first brace on, the start advances until the rest up to the last brace does."""
    last = F.length(said) - F.locate("}", F.reverse(said)) + 1
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(said), F.lit(1))), lambda i: F.substr(said, i, F.lit(1)) == "{")
    tried = F.filter(F.transform(starts, lambda i: F.substr(said, i, last - i + 1)), lambda x: strict_json(x).isNotNull() & x.startswith("{"))
    return F.when(F.locate("}", said) > 0, F.get(tried, F.lit(0)))


def judge_score(said: Column) -> Column:
    """The score of a judge's answer if it is a number from 0 to 1."""
    n = F.try_variant_get(F.try_parse_json(judge_json(said)), "$.score", "double")
    return F.when((n >= 0) & (n <= 1), n)
