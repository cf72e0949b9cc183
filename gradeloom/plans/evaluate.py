"""The evaluation as one lazy plan: clean, find, compare, score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom import config
from gradeloom.functions.text import strip
from gradeloom.operators.compare import with_comparisons
from gradeloom.operators.rules import with_findings
from gradeloom.operators.score import with_scores
from gradeloom.operators.semantic import Jaccard, Scorer

_TEXTS = ("question", "answer", "expected_answer", "context")
_ORIGINAL = "__original"


def cleaned(records: DataFrame) -> DataFrame:
    """The texts stripped, absent or blank references null; the original columns in one struct."""
    kept = [c for c in records.columns if c not in config.RESULT_COLUMNS]

    def text(name: str):
        return strip(F.col(name).cast("string")) if name in records.columns else F.lit(None).cast("string")

    return records.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias(_ORIGINAL),
        F.coalesce(text("question"), F.lit("")).alias("question"), F.coalesce(text("answer"), F.lit("")).alias("answer"),
        F.nullif(text("expected_answer"), F.lit("")).alias("expected_answer"), F.nullif(text("context"), F.lit("")).alias("context"),
    )


def evaluate_detailed(records: DataFrame, scorer: Scorer | None = None, threshold: int = config.THRESHOLD, weights: Mapping[str, float] = config.WEIGHTS) -> DataFrame:
    """The evaluation with its findings, comparisons and primary conflict; the original row is a struct."""
    return with_scores(with_comparisons(with_findings(cleaned(records))), scorer or Jaccard(), threshold, weights)


def evaluate(records: DataFrame, scorer: Scorer | None = None, threshold: int = config.THRESHOLD, weights: Mapping[str, float] = config.WEIGHTS) -> DataFrame:
    """records, every column kept but those that results replace, and the eleven result columns.

    Rows depend on themselves alone: no shuffle. An embedding scorer finds its vector columns in
    the struct of the original row. A null question or answer is an empty text.
    """
    return evaluate_detailed(records, scorer, threshold, weights).select(f"{_ORIGINAL}.*", *config.RESULT_COLUMNS)


def evaluate_one(spark: SparkSession, question: str, answer: str, expected_answer: str | None = None, context: str | None = None, **options) -> dict:
    """The evaluation of one record; both question and answer must have content."""
    if not (question or "").strip() or not (answer or "").strip():
        raise ValueError("question and answer must not be blank")
    row = spark.createDataFrame([(question, answer, expected_answer, context)], "question string, answer string, expected_answer string, context string")
    return evaluate(row, **options).first().asDict()
