"""Column functions of graders over evidence that is already collected: outputs, files, diffs, tool calls."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.functions import messages

#: What kind of evidence a grader gives (fixed values).
DETERMINISTIC = ("exit_code", "tests_pass", "file_contains", "file_exists", "file_eq", "regex_match", "json_path", "files_unchanged", "file_deleted", "git_diff_contains", "checksum")
NEGATABLE = ("file_exists", "file_contains", "regex_match", "git_diff_contains", "step")


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether Java takes the pattern; a grader whose pattern it doesn't take fails."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  the driver's view of a Java error
        return False
    return True


def _either(hit: Column, negate: bool) -> Column:
    return ~hit if negate else hit


def exit_code(code: Column) -> Column:
    return F.coalesce(code == 0, F.lit(False))


def tests_pass(code: Column, output: Column, least: int = 1) -> Column:
    """Exit code 0, no failed test and at least that many passed ones."""
    return exit_code(code) & (messages.test_count(output, "fail") == 0) & (messages.test_count(output, "pass") >= least)


def contains(content: Column, pattern: str, negate: bool = False) -> Column:
    """A pattern, by lines, in a file's content or a diff; without the file it fails, also when negated."""
    return F.coalesce(_either(content.rlike(f"(?m){pattern}"), negate), F.lit(False))


def exists(content: Column, negate: bool = False) -> Column:
    return _either(content.isNotNull(), negate)


def equals(content: Column, expected: str, trim: bool = False) -> Column:
    mine = F.regexp_replace(content, r"^\s+|\s+$", "") if trim else content
    return F.coalesce(mine == (expected.strip() if trim else expected), F.lit(False))


def regex_match(final: Column, result: Column, transcript: Column, failed: Column, pattern: str, source: str = "final_text", negate: bool = False) -> Column:
    """A pattern in what the agent said. After a runner's error only what the agent itself wrote counts."""
    final, result, transcript = (F.coalesce(c, F.lit("")) for c in (final, result, transcript))
    text = transcript if source == "transcript" else F.when(failed, final).otherwise(F.concat(result, final) if source == "stdout" else F.when(final != "", final).otherwise(result))
    return _either(text.rlike(f"(?m){pattern}"), negate)


def json_path(content: Column, path: str, expected: str) -> Column:
    """Whether the value at a path (a.b[0].c) of a JSON text is the expected one, compared as written JSON."""
    v = F.try_parse_json(content)
    mine = F.to_json(F.try_variant_get(v, f"$.{path}", "variant"))
    return F.coalesce(mine == F.to_json(F.parse_json(F.lit(expected))), F.lit(False))


def checksum(content: Column, expected: Column, algorithm: str = "sha256") -> Column:
    return F.coalesce((F.md5(content) if algorithm == "md5" else F.sha2(content, 256)) == expected, F.lit(False))


def step(calls: Column, tool: str | None = None, includes: str | None = None, includes_any: list[str] | None = None, negate: bool = False, at_index: int | None = None, before_tool: str | None = None, least: int = 1) -> Column:
    """calls: array of structs (name, input) in order. None at all, one at a place, one before a tool's first, or enough of them."""
    def fits(c: Column) -> Column:
        ok = F.lit(True)
        if tool:
            ok = ok & F.coalesce(c["name"] == tool, F.lit(False))
        given = F.coalesce(c["input"], F.lit('""'))
        if includes:
            ok = ok & given.contains(includes)
        if includes_any is not None:
            some = F.lit(False)
            for s in includes_any:
                some = some | given.contains(s)
            ok = ok & some
        return ok

    hits = F.filter(calls, fits)
    if negate:
        return F.size(hits) == 0
    if at_index is not None:
        return F.coalesce(fits(F.get(calls, F.lit(at_index))) & F.get(calls, F.lit(at_index)).isNotNull(), F.lit(False))
    if before_tool:
        first = F.array_position(F.transform(calls, fits), True)
        other = F.array_position(F.transform(calls, lambda c: F.coalesce(c["name"] == before_tool, F.lit(False))), True)
        return (first > 0) & ((other == 0) | (first < other))
    return F.size(hits) >= least


def evidence_tier(kind: Column) -> Column:
    return F.when(kind.isin(*DETERMINISTIC), "deterministic").when(kind == "step", "trace").when(kind == "rubric_llm", "llm_judge").otherwise("manual")


def passes_without_work(kind: Column, negate: Column) -> Column:
    """Whether an agent that does nothing passes the grader."""
    return (kind == "files_unchanged") | (kind.isin(*NEGATABLE) & F.coalesce(negate, F.lit(False)))


def final_status(runner_error: Column, over_budget: Column, agent_failed: Column, infra_failed: Column, transcript_lost: Column, passed: Column) -> Column:
    """A case's status: the runner's error first, then budget, the agent's failure, failed infrastructure, a lost transcript, the verdict."""
    return F.when(runner_error, "error").when(over_budget | agent_failed, "failed").when(infra_failed | transcript_lost, "error").when(passed, "passed").otherwise("failed")


def rubric(answer: Column, least: float = 0.7) -> Column:
    """A judge's answer as passed, failed or, without a verdict, error."""
    v = F.try_parse_json(messages.judge_json(answer))
    said, score = F.try_variant_get(v, "$.passed", "boolean"), messages.judge_score(answer)
    return F.when(said.isNull() & score.isNull(), "error").when(F.coalesce(said, score >= least), "passed").otherwise("failed")
