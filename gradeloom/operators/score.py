"""Metrics, quality, error type, status and feedback of compared answers.

Metrics that have no reference are null and never count as 0.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import config
from gradeloom.functions.plan import computed
from gradeloom.functions.text import round_half_even, round_text
from gradeloom.operators.semantic import Scorer

_METRICS = list(config.WEAKEST)


def quality(weights: Mapping[str, float] = config.WEIGHTS) -> Column:
    """The weighted mean of the metrics that are there; null where none is or they weigh nothing."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name).cast("double") * F.lit(float(w)), F.lit(0.0))
        weight = weight + F.when(F.col(name).isNotNull(), float(w)).otherwise(0.0)
    return F.when(weight > 0, round_half_even(total / weight))


def weakest() -> Column:
    """struct(error, metric, score) of the lowest metric; ties go to the first."""
    options = [F.when(F.col(m).isNotNull(), F.struct(F.col(m).cast("double").alias("score"), F.lit(i).alias("turn"), F.lit(e).alias("error"), F.lit(m).alias("metric"))) for i, (m, e) in enumerate(config.WEAKEST.items())]
    least = F.array_min(F.array_compact(F.array(*options)))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(3).alias("turn"), F.lit("Incomplete Answer").alias("error"), F.lit("completeness_score").alias("metric"))
    return F.coalesce(least, none)


def error_type(rules: str = "rules", conflict: str = "conflict", supported: str = "supported") -> Column:
    """The first error that applies."""
    r, rel, cor, gro, com = F.col(rules), *(F.col(m) for m in _METRICS)
    return (
        F.when(r["empty"], "Empty Answer").when(r["placeholder"], "Insufficient Data").when(r["unwanted_refusal"], "Unwanted Refusal")
        .when(r["question_repetition"], "Incomplete Answer").when(F.col(conflict), "Contradictory Answer").when(r["formatting_problem"], "Formatting Issue")
        .when(r["excessively_verbose"], "Overly Verbose").when(rel < 35, "Irrelevant Answer").when(cor < 30, "Contradictory Answer").when(cor < 55, "Incorrect Answer")
        .when(gro < 50, "Unsupported Answer").when((r["extremely_short"] & ~F.col(supported)) | r["excessive_repetition"] | (com < 55), "Incomplete Answer").otherwise("No Error")
    )


def conflict_text(c: Column) -> Column:
    """What a conflict tells the reader; null without one."""
    name = F.create_map(*(F.lit(x) for pair in config.CONFLICT_NAMES.items() for x in pair))[c["kind"]]
    article = F.when(c["kind"] == "polarity", "an").otherwise("a")
    return F.when(c.isNotNull(), F.concat(F.lit('The answer uses "'), c["answer_value"], F.lit('", while the '), c["source"], F.lit(' uses "'), c["reference_value"], F.lit('"; this is '), article, F.lit(" "), name, F.lit(" conflict.")))


def feedback(threshold: int, rules: str = "rules", primary: str = "primary", fell_short: str = "fell_short", lowest: str = "lowest", error: str = "error_type") -> Column:
    """The advice, what could not be measured, and the disclaimer."""
    low = F.col(lowest)
    short = F.concat(F.lit("The "), F.regexp_replace(low["metric"], "_score$", ""), F.lit(" score ("), round_text(low["score"], 1), F.lit(") was the weakest available metric and the main reason the overall quality score fell below the configured pass threshold ("), F.lit(str(threshold)), F.lit(")."))
    advice = F.create_map(*(F.lit(x) for pair in config.FEEDBACK.items() for x in pair))[F.col(error)]
    said = F.when(F.col(rules)["question_repetition"], config.REPEATS_QUESTION).when(F.col(primary).isNotNull(), conflict_text(F.col(primary))).when(F.col(fell_short), short).otherwise(advice)
    lacking = F.concat_ws("; ", F.when(F.col("correctness_score").isNull(), config.NO_EXPECTED), F.when(F.col("groundedness_score").isNull(), config.NO_CONTEXT))
    return F.concat_ws(" ", said, F.when(lacking != "", F.concat(F.lit("Unavailable: "), lacking, F.lit("."))), F.lit(config.DISCLAIMER))


def with_scores(compared: DataFrame, scorer: Scorer, threshold: int = config.THRESHOLD, weights: Mapping[str, float] = config.WEIGHTS) -> DataFrame:
    """compared, which has rules and both comparisons and cleaned texts, with the result columns."""
    if not 0 <= threshold <= 100:
        raise ValueError("threshold must be between 0 and 100")
    r, exp, ctx = F.col("rules"), F.col("against_expected"), F.col("against_context")
    ec, cc = F.size(exp["conflicts"]) > 0, F.size(ctx["conflicts"]) > 0

    def adjusted(reference: str, conflict: Column, agrees: Column) -> Column:
        # least and greatest skip nulls, so a metric that is not there must be kept null
        alike = scorer.similarity(reference, "answer")
        return F.when(F.col(reference).isNotNull(), F.when(conflict, F.least(alike, F.lit(25.0))).when(agrees, F.greatest(alike, F.lit(85.0))).otherwise(alike))

    alike = scorer.similarity("question", "answer")
    out = computed(compared, {
        "__rel": F.when(r["empty"], 0.0).when(r["question_repetition"], F.least(alike, F.lit(20.0))).otherwise(alike),
        "correctness_score": adjusted("expected_answer", ec, exp["agrees"] | exp["short_value_met"]),
        "groundedness_score": adjusted("context", cc, ctx["agrees"]),
        "conflict": ec | cc, "primary": F.coalesce(F.get(exp["conflicts"], F.lit(0)), F.get(ctx["conflicts"], F.lit(0))),
    })
    supported = F.coalesce(r["extremely_short"] & (F.greatest("correctness_score", "groundedness_score") >= 70) & ~F.col("conflict"), F.lit(False))
    by_length = F.least(F.lit(100.0), r["word_count"] / F.lit(20.0) * 100)
    length_score = F.when(supported, 100.0).when(r["word_count"] >= 5, F.greatest(F.lit(60.0), by_length)).otherwise(by_length)
    penalty = F.when(supported, F.greatest(F.lit(0.0), r["penalty"] - 45)).otherwise(r["penalty"])
    parts = length_score + (F.lit(100.0) - penalty)
    complete = round_half_even(F.when(F.col("correctness_score").isNotNull(), (parts + F.col("correctness_score")) / 3).otherwise(parts / 2))
    out = computed(out, {
        "supported": supported, "relevance_score": F.when(supported, F.greatest("__rel", F.lit(70.0))).otherwise(F.col("__rel")),
        "completeness_score": F.when(r["question_repetition"], F.least(complete, F.lit(20.0))).otherwise(complete),
    })
    whole = quality(weights)
    out = computed(out, {"quality_score": F.when(F.col("conflict") & whole.isNotNull(), F.least(whole, F.lit(60.0))).otherwise(whole), "__error": error_type(), "lowest": weakest()})
    fine, reached = F.col("__error") == "No Error", F.coalesce(F.col("quality_score") >= threshold, F.lit(False))
    out = computed(out, {"status": F.when(reached & fine, "Pass").otherwise("Fail"), "fell_short": fine & ~reached, "error_type": F.when(fine & ~reached, F.col("lowest.error")).otherwise(F.col("__error"))})
    out = computed(out, {
        "improvement_feedback": feedback(threshold), "evaluation_mode": F.lit(config.MODE),
        "evaluated_at": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), "evaluator_version": F.lit(config.VERSION),
    })
    return out.drop("__rel", "__error", "fell_short", "lowest")
