"""How far a case's and a run's verdict can be trusted: evidence by tier, audits of case definitions, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import grading

TIERS = ("deterministic", "trace", "visual", "llm_judge", "manual")


def _say(cond: Column, what: str) -> Column:
    return F.when(cond, what)


def evidence(results: DataFrame) -> DataFrame:
    """results (case_id, kind, passed) -> per case the number and passes of each tier."""
    r = results.withColumn("tier", grading.evidence_tier(F.col("kind")))
    return r.groupBy("case_id").agg(*(x for t in TIERS for x in (F.count_if(F.col("tier") == t).alias(t), F.count_if((F.col("tier") == t) & F.col("passed")).alias(f"{t}_passed"))))


def audit(cases: DataFrame, graders: DataFrame) -> DataFrame:
    """cases: case_id, has_oracle, has_known_bad, visual (artifacts listed, null: no contract), needs_vision, noop_guard; graders: case_id, kind, negate.

    Per case its graders by tier and its weaknesses, in order."""
    g = graders.withColumn("tier", grading.evidence_tier(F.col("kind")))
    sure = F.col("tier") == "deterministic"
    n = g.groupBy("case_id").agg(
        *(F.count_if(F.col("tier") == t).alias(t) for t in TIERS if t != "visual"), F.count("*").alias("graders"),
        F.count_if(sure & ~grading.passes_without_work(F.col("kind"), F.col("negate"))).alias("teeth"), F.count_if(sure & (F.col("kind") != "regex_match")).alias("not_regex"),
    )
    j = cases.join(n, "case_id", "left").fillna(0, ["deterministic", "trace", "llm_judge", "manual", "graders", "teeth", "not_regex"]).withColumn("visual", F.coalesce("visual", F.lit(0)))
    judged, sure = F.col("llm_judge") > 0, F.col("deterministic") > 0
    weak = F.array_compact(F.array(
        _say(~F.col("has_oracle"), "missing oracle solve script"), _say(~F.col("has_known_bad"), "no known-bad rejection script"), _say(F.col("deterministic") + F.col("trace") == 0, "no deterministic or trace grader"),
        _say(judged & ~sure, "LLM judge without deterministic backstop"), _say(F.col("needs_vision") & (F.col("visual") == 0), "vision-input task has no visual artifact contract"),
        _say(sure & (F.col("teeth") == 0) & ~F.col("noop_guard"), "deterministic graders all pass on a no-op run; no oracle.noop_max_score guard"),
        _say(judged & sure & (F.col("not_regex") == 0), "rubric_llm backstop is only regex_match graders (weak deterministic teeth)"),
    ))
    return j.withColumn("weaknesses", weak).drop("teeth", "not_regex")


def audit_totals(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count("*").alias("cases"), F.count_if("has_oracle").alias("oracle"), F.count_if("has_known_bad").alias("known_bad"), F.count_if(F.col("deterministic") + F.col("trace") > 0).alias("proven"),
        F.count_if(F.size("weaknesses") > 0).alias("weak"), *(F.coalesce(F.sum(t), F.lit(0)).alias(f"{t}_graders") for t in TIERS if t != "visual"),
    )


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5))).cast("long")


def grade(score: Column) -> Column:
    # fixed values: the grades and where they begin
    return F.when(score >= 90, "High confidence").when(score >= 75, "Solid confidence").when(score >= 60, "Needs review").otherwise("Weak proof")


def case_trust(cases: DataFrame, counts: DataFrame) -> DataFrame:
    """cases: case_id, status, pass_ratio, has_oracle, has_known_bad, has_budget, visual (null: no contract), ...; counts: evidence().

    A score of 0 to 100 from passed graders, proof, and what the case declares, less for each weakness beyond the first."""
    j = cases.join(counts, "case_id", "left").fillna(0, [c for t in TIERS for c in (t, f"{t}_passed")])
    shown = F.col("declared_visual").isNull() | (F.col("declared_visual") > 0)
    proof = F.col("deterministic") + F.col("trace")
    weak = F.array_compact(F.array(
        _say(~F.col("has_oracle"), "missing oracle"), _say(~F.col("has_known_bad"), "no known-bad"), _say(proof == 0, "no deterministic/trace proof"), _say((F.col("llm_judge") > 0) & (F.col("deterministic") == 0), "LLM judge lacks backstop"),
        _say(~F.col("has_budget"), "no budget"), _say(~shown, "visual has no artifacts"), _say(F.col("manual") > 0, "manual grader"),
    ))
    proven = F.when(proof > 0, (F.col("deterministic_passed") + F.col("trace_passed")) / proof).otherwise(0.0)
    ratio = F.coalesce("pass_ratio", F.when(F.col("status") == "passed", 1.0).otherwise(0.0))
    # fixed values: what each part is worth
    declared = F.when(F.col("has_oracle"), 15).otherwise(0) + F.when(F.col("has_known_bad"), 15).otherwise(0) + F.when(F.col("has_budget"), 8).otherwise(0) + F.when(shown, 7).otherwise(0)
    j = j.withColumn("weaknesses", weak)
    score = _clamped(ratio * 35 + proven * 20 + declared - F.greatest(F.lit(0), F.size("weaknesses") - 1) * 5)
    return j.withColumn("score", score).withColumn("grade", grade(F.col("score"))).withColumn("has_proof", proof > 0).withColumn("shown", shown)


def run_confidence(trusted: DataFrame, by: str = "run_id") -> DataFrame:
    """A run's score from its pass rate, its cases' trust and the share of cases with proof, known-bad, oracle and visual contract."""
    share = lambda c: F.floor(100 * F.avg(c.cast("double")) + 0.5)
    visual = F.col("declared_visual").isNotNull()
    g = trusted.groupBy(by).agg(
        F.count("*").alias("cases"), F.count_if(F.size("weaknesses") > 0).alias("weak"), F.avg((F.col("status") == "passed").cast("double")).alias("pass"), F.avg("score").alias("trust"), share(F.col("has_proof")).alias("proof"), share(F.col("has_known_bad")).alias("bad"), share(F.col("has_oracle")).alias("oracle"),
        F.when(F.count_if(visual) > 0, F.floor(100.0 * F.count_if(F.col("shown")) / F.count_if(visual) + 0.5)).otherwise(100).alias("visual_share"),
    )
    # fixed values: the weight of each part
    score = _clamped(F.col("pass") * 30 + F.col("trust") * 0.35 + F.col("proof") * 0.15 + F.col("bad") * 0.1 + F.col("oracle") * 0.05 + F.col("visual_share") * 0.05)
    return g.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def top_weaknesses(trusted: DataFrame, by: str = "run_id", most: int = 5) -> DataFrame:
    from pyspark.sql import Window

    n = trusted.select(by, F.explode("weaknesses").alias("weakness")).groupBy(by, "weakness").agg(F.count("*").alias("count"))
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("count"), "weakness"))
    return n.withColumn("r", r).where(F.col("r") <= most).drop("r")
