"""Summaries and views of evaluated results.

Columns that a result lacks count as null. Defined results: an empty table has 0 rows, rates of 0
and null averages; ties of the lowest rows are ordered by the row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import config
from gradeloom.functions.text import display_score, display_text, round_half_even

SCORES = ("quality_score", "relevance_score", "correctness_score", "groundedness_score", "completeness_score")
ALL = "All"


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _number(df: DataFrame, name: str) -> Column:
    n = _column(df, name).try_cast("double")
    return F.when(~F.isnan(n), n)


def summary(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed, their rates and the averages of the scores, with one decimal."""
    passed = _column(results, "status").eqNullSafe(F.lit("Pass"))
    one = results.agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"), *(F.avg(_number(results, s)).alias(s) for s in SCORES))

    def rate(n: Column) -> Column:
        return F.when(F.col("total") == 0, 0.0).otherwise(round_half_even(n / F.col("total") * 100, 1))

    failed = F.col("total") - F.col("passed")
    return one.select("total", "passed", failed.alias("failed"), rate(F.col("passed")).alias("pass_rate"), rate(failed).alias("fail_rate"), *(round_half_even(F.col(s), 1).alias(f"average_{s}") for s in SCORES))


def error_counts(results: DataFrame) -> DataFrame:
    """(error_type, count), most frequent first."""
    return results.where("error_type IS NOT NULL").groupBy("error_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "error_type")


def error_options(results: DataFrame) -> DataFrame:
    """(error_type, turn): the error types that occur, known ones in their order, then others by name."""
    known = F.array(*map(F.lit, config.ERROR_TYPES))
    place = F.array_position(known, F.col("error_type"))
    return results.where("error_type IS NOT NULL").select("error_type").distinct().withColumn("turn", F.when(place == 0, len(config.ERROR_TYPES) + 1).otherwise(place)).orderBy("turn", "error_type")


def filtered(results: DataFrame, status: str = ALL, error_type: str = ALL) -> DataFrame:
    """The rows of a status and an error type; All, or a column that is not there, keeps all."""
    for name, value in (("status", status), ("error_type", error_type)):
        if value != ALL and name in results.columns:
            results = results.where(F.col(name) == value)
    return results


def _compact(df: DataFrame) -> dict[str, Column]:
    return {
        "Status": F.upper(display_text(_column(df, "status"))), "Quality": display_score(_column(df, "quality_score")), "Error Type": display_text(_column(df, "error_type")),
        "Question": display_text(_column(df, "question")), "Answer": display_text(_column(df, "answer")), "Expected Answer": display_text(_column(df, "expected_answer")), "Context": display_text(_column(df, "context")),
    }


def compact(results: DataFrame) -> DataFrame:
    """The seven columns of the results table, readable."""
    return results.select(*(c.alias(n) for n, c in _compact(results).items()))


def lowest_rows(results: DataFrame, row_id: str, limit: int = 5) -> DataFrame:
    """The lowest failed rows, filled up with the lowest of the others; nulls last, ties by row id."""
    failed = F.when(_column(results, "status").eqNullSafe(F.lit("Fail")), 0).otherwise(1)
    return results.orderBy(failed, _number(results, "quality_score").asc_nulls_last(), row_id).limit(max(0, limit))


def lowest(results: DataFrame, row_id: str, limit: int = 5) -> DataFrame:
    """lowest_rows in five readable columns."""
    shown = {n: c for n, c in _compact(results).items() if n not in ("Expected Answer", "Context")}
    return lowest_rows(results, row_id, limit).select(*(c.alias(n) for n, c in shown.items()))


def row_details(results: DataFrame) -> DataFrame:
    """The twelve fields of the view of one row, for every row."""
    c = _compact(results)
    fields = {"Status": c["Status"], "Quality score": c["Quality"], "Error type": c["Error Type"], "Question": c["Question"], "Answer": c["Answer"], "Expected answer": c["Expected Answer"], "Context": c["Context"]}
    fields |= {n: display_score(_column(results, f"{n.lower()}_score")) for n in ("Relevance", "Correctness", "Groundedness", "Completeness")}
    fields["Improvement feedback"] = display_text(_column(results, "improvement_feedback"))
    return results.select(*(v.alias(n) for n, v in fields.items()))


def row_label(results: DataFrame, position: str) -> Column:
    """Row n, its status and its question, a long one cut to 65 characters."""
    question = display_text(_column(results, "question"))
    short = F.when(F.length(question) > 68, F.concat(F.rtrim(F.substring(question, 1, 65)), F.lit("…"))).otherwise(question)
    return F.concat(F.lit("Row "), F.col(position).cast("string"), F.lit(" · "), F.upper(display_text(_column(results, "status"))), F.lit(" · "), short)


def export_columns(results: DataFrame) -> DataFrame:
    """The original columns, then the result columns, those that are lacking as nulls."""
    original = [F.col(f"`{c}`") for c in results.columns if c not in config.RESULT_COLUMNS]
    return results.select(*original, *(_column(results, c).alias(c) for c in config.RESULT_COLUMNS))
