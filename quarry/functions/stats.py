"""Column functions for evaluation statistics and session scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - prod_{i=n-c+1..n} (1 - k/i): chance that one of k samples out of n with c passes is a pass."""
    k = F.least(k, n)
    c = F.greatest(F.lit(0), F.least(c, n))
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - k.cast("double") / i))
    return F.when((n <= 0) | (c <= 0) | (k <= 0), 0.0).when(n - c < k, 1.0).otherwise(1 - product)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval within [0, 1]; 0, 0 without trials."""
    p = F.try_divide(successes.cast("double"), n)
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    lo, hi = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, lo).otherwise(0.0), F.when(n > 0, hi).otherwise(0.0)


def nearest_rank(value: str, p: float) -> Column:
    """Aggregate: sorted[ceil(p * n) - 1], 0 without values."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0))


def floor_index(sorted_values: Column, p: float) -> Column:
    """sorted[min(n - 1, floor(p * n))] of a sorted array."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(n - 1, F.floor(n * F.lit(p)).cast("int")))


def array_median(values: Column) -> Column:
    """Mean of the middle one or two of an array, 0 without values."""
    s, n = F.array_sort(values), F.size(values)
    mid = (n / 2).cast("int")
    return F.when(n == 0, 0.0).when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, F.greatest(mid - 1, F.lit(0))) + F.get(s, mid)) / 2)


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def quality_score(model: Column, tokens: Column, cost: Column, duration: Column, turns: Column, malformed: Column, lines: Column, hook_errors: Column, tool_error_rate: Column) -> Column:
    """0 to 100 by what is known of a session. The first five are provenances: measured, inferred, missing or malformed."""
    gone = lambda c, n: F.when(c.isin("missing", "malformed"), n).otherwise(0)
    # fixed values: what each gap costs
    off = gone(model, 12) + gone(tokens, 14) + gone(cost, 8) + gone(duration, 12)
    off += F.when(turns == "missing", 8).when(turns == "inferred", 3).otherwise(0)
    off += F.when(malformed > 0, F.least(F.lit(20), F.ceil(malformed * 100.0 / F.greatest(lines, F.lit(1))))).otherwise(0)
    off += F.when(hook_errors > 0, F.least(F.lit(12), hook_errors * 2)).otherwise(0)
    off += F.when(tool_error_rate > 0.25, 6).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - off)).cast("long")


def outcome_score(positive: Column, negative: Column, rephrases: Column, error_tail: Column, passed_tail: Column, rework: Column, tool_error_rate: Column) -> Column:
    """0 to 1 from signals in a session, 0.5 without any; each signal saturates."""
    sat = lambda c: F.tanh(F.greatest(F.lit(0.0), c.cast("double")))
    # fixed values: the weight of each signal
    s = 0.5 + 0.25 * sat(positive) - 0.30 * sat(negative) - 0.08 * sat(rephrases / 2)
    s = s + F.when(error_tail, -0.12).otherwise(0.0) + F.when(passed_tail, 0.1).otherwise(0.0)
    s = s - 0.06 * sat(rework / 3) - 0.1 * F.least(F.lit(1.0), tool_error_rate * 2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def cost_usd(tokens: dict[str, Column], rates: dict[str, Column]) -> Column:
    """Sum of tokens times rates per million; null if there are no tokens or no rate."""
    kept = {k: F.greatest(F.lit(0), F.coalesce(v, F.lit(0))) for k, v in tokens.items()}
    total = sum(kept.values(), F.lit(0))
    return F.when(total > 0, sum((kept[k] * rates[k] for k in tokens), F.lit(0.0)) / 1_000_000)
