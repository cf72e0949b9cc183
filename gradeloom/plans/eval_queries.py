"""Queries of the evaluation and reporting operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom import config
from gradeloom.functions.facts import KINDS, acronym_sql, alias_sql, content_sql, with_facts
from gradeloom.functions.plan import spread
from gradeloom.operators import report
from gradeloom.operators.adapters import compare_runs, with_references
from gradeloom.operators.compare import with_comparisons
from gradeloom.operators.rules import with_findings
from gradeloom.operators.score import quality, weakest
from gradeloom.operators.semantic import Constant, Exact, Jaccard, cosine
from gradeloom.operators.validate import ERROR, Validation, validate
from gradeloom.plans.evaluate import cleaned, evaluate, evaluate_detailed
from gradeloom.sources.files import read_csv, write_csv
from gradeloom.sources.sample import sample_records
from gradeloom.sources.shared import shared_folder
from gradeloom.sources.tables import table

FINDINGS = tuple(config.PENALTIES)
METRICS = tuple(config.WEAKEST)
_STACKED = "stack(3, 'answer', answer, 'expected_answer', expected_answer, 'context', context) AS (field_name, text)"
OTHER_WEIGHTS = {"correctness_score": 2.0, "relevance_score": 1.0}


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_evaluations")


def _spread(spark: SparkSession, d: str) -> DataFrame:
    """The records for work that is long for each row."""
    return spread(_records(spark, d))


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluation_results")


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """Results with the texts of their records: a left join by row id."""
    texts = _records(spark, d).select("row_id", "question", "answer", "expected_answer", "context")
    return _results(spark, d).join(texts, "row_id", "left")


def _validated(spark: SparkSession, d: str) -> Validation:
    return validate(_records(spark, d), row_id="row_id")


def validate_counts(spark, d):
    return _validated(spark, d).counts


def validate_valid(spark, d):
    return _validated(spark, d).valid.select("row_id", "question", "answer")


def validate_reasons(spark, d):
    return _validated(spark, d).invalid.select("row_id", F.col(ERROR).alias("validation_error"))


def dedupe_first(spark, d):
    return _validated(spark, d).tagged.where("NOT _duplicate").select("row_id")


def rules_findings(spark, d):
    return with_findings(_records(spark, d)).select("row_id", "rules.*").withColumn("word_count", F.col("word_count").cast("bigint"))


def _finding(name: str):
    def query(spark, d):
        return with_findings(_records(spark, d)).select("row_id", (F.col(f"rules.{name}").cast("bigint") if name == "word_count" else F.col(f"rules.{name}")).alias(name))

    return query


def sim_jaccard(spark, d):
    return _records(spark, d).select("row_id", Jaccard().similarity("question", "answer").alias("similarity"))


def sim_cosine(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(nxt, "vec_id").select("vec_id", cosine("embedding", "next").alias("similarity"))


def content_words(spark, d):
    texts = _records(spark, d).select("row_id", F.expr(_STACKED))
    return texts.select("row_id", "field_name", F.expr(f"array_join(array_sort({content_sql("coalesce(text, '')")}), ' ')").alias("words"))


def acronym_match(spark, d):
    return _records(spark, d).where("answer IS NOT NULL AND expected_answer IS NOT NULL").select("row_id", F.expr(acronym_sql("answer", "expected_answer")).alias("matches"))


def fact_alias(spark, d):
    return _records(spark, d).where("answer IS NOT NULL AND context IS NOT NULL").select("row_id", F.expr(alias_sql("answer", "context")).alias("matches"))


def _key_columns(kind: str) -> list:
    """The key of a fact as columns: what it compares within, and the amount, or a name."""
    k = F.col("fact.k")
    if kind in ("dates", "entities"):
        return [k.alias({"dates": "date_key", "entities": "entity"}[kind])]
    amount = F.regexp_extract(k, "[^ ]+$", 0).cast("double").alias("amount")
    return [F.regexp_extract(k, "^[a-z]+", 0).alias("family"), amount] if kind in ("durations", "temperatures") else [amount]


def _listed(texts: DataFrame, kind: str) -> DataFrame:
    found = with_facts(texts, "text", "facts").select("row_id", "field_name", F.explode(F.arrays_zip(f"facts.{kind}.k", f"facts.{kind}.s")).alias("fact"))
    return found.select("row_id", "field_name", *_key_columns(kind), F.col("fact.s").alias("surface"))


def _facts(kind: str):
    def query(spark, d):
        return _listed(_spread(spark, d).select("row_id", F.expr(_STACKED)), kind)

    return query


#: Statements put together from the parts table: percentages, fractions, dates and opposites that its own texts never have.
_STATED = {
    "answer": (
        "concat('The discount is ', n, '%.')", "concat('About ', n, ' percent, or one half.')", "concat('It is three quarters of ', n, ' GB.')", "concat('It was approved on March ', day, ', 2024.')",
        "concat('It is not sealed and holds ', n, ' degrees Celsius.')", "concat('It lasts ', n, ' weeks from 2023-05-', day, '.')", "concat('One fifth was allowed at ', n, ' °F before noon.')", "concat('Twenty-one of the ', n, ' percentage points.')",
    ),
    "expected_answer": (
        "concat('The discount is 0.', n, '.')", "concat('50% or ', n + n % 2, ' percent')", "concat('75 percent of ', n * 1024, ' MB')", "concat('It was rejected on ', day, 'th March 2024.')",
        "concat('It is sealed and holds ', n + n % 2, ' °C.')", "concat(n * 7, ' days from May ', day, ', 2023')", "concat('20% was prohibited at ', n, ' fahrenheit after noon.')", "'The Label Office of Lisbon says twenty-one.'",
    ),
}


def _stated(spark, d) -> DataFrame:
    parts = table(spark, d, "part").selectExpr("p_partkey AS row_id", "p_size AS n", "p_size % 28 + 1 AS day")
    texts = [f"CASE row_id % 8 {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(forms))} END AS {c}" for c, forms in _STATED.items()]
    return parts.selectExpr("row_id", "'What does the label say?' AS question", *texts, "CAST(NULL AS STRING) AS context")


def _stated_facts(kind: str):
    def query(spark, d):
        texts = _stated(spark, d).select("row_id", F.expr(_STACKED)).where("field_name <> 'context'")
        return _listed(texts, kind)

    return query


def stated_conflicts(spark, d):
    found = with_comparisons(cleaned(_stated(spark, d)))
    return found.select(F.col("__original.row_id").alias("row_id"), F.explode("against_expected.conflicts").alias("c")).select("row_id", "c.*")


def stated_agreements(spark, d):
    found = with_comparisons(cleaned(_stated(spark, d)))
    return found.select(F.col("__original.row_id").alias("row_id"), F.col("against_expected.agrees").alias("agrees"), F.col("against_expected.short_value_met").alias("met"))


def _compared(spark, d) -> DataFrame:
    return with_comparisons(cleaned(_spread(spark, d)))


def conflicts(spark, d):
    """Every conflict with either reference."""
    both = F.concat("against_expected.conflicts", "against_context.conflicts")
    return _compared(spark, d).select(F.col("__original.row_id").alias("row_id"), F.explode(both).alias("c")).select("row_id", "c.*")


def equivalences(spark, d):
    return _compared(spark, d).select(F.col("__original.row_id").alias("row_id"), F.col("against_expected.agrees").alias("agrees_with_expected"), F.col("against_context.agrees").alias("agrees_with_context"))


def short_value_match(spark, d):
    return _compared(spark, d).select(F.col("__original.row_id").alias("row_id"), F.col("against_expected.short_value_met").alias("met"))


def conflict_primary(spark, d):
    return evaluate_detailed(_spread(spark, d)).where("primary IS NOT NULL").select(F.col("__original.row_id").alias("row_id"), "primary.*")


def evaluate_full(spark, d):
    return evaluate(_spread(spark, d)).drop("evaluated_at")


def evaluate_summary(spark, d):
    """The summary of the evaluation itself: one pass from records to one row."""
    return report.summary(evaluate(_spread(spark, d)))


def evaluate_changes(spark, d):
    """Stored results beside a new evaluation of the same records: a full outer join of two runs."""
    new = evaluate(_spread(spark, d)).select("row_id", F.col("status").alias("new_status"), F.col("error_type").alias("new_error_type"))
    latest = _results(spark, d).groupBy("row_id").agg(F.max_by("status", "result_id").alias("old_status"), F.max_by("error_type", "result_id").alias("old_error_type"))
    both = latest.join(new, "row_id", "full")
    return both.groupBy("old_status", "new_status").agg(F.count("*").alias("n_records"))


def evaluate_adjusted(spark, d):
    """The metrics before and after references, conflicts and short answers change them."""
    e = evaluate_detailed(_spread(spark, d))
    return e.select(F.col("__original.row_id").alias("row_id"), *METRICS, "quality_score", "conflict", "supported")


def quality_score(spark, d):
    return _results(spark, d).select("result_id", quality().alias("quality"))


def quality_custom_weights(spark, d):
    return _results(spark, d).select("result_id", quality(OTHER_WEIGHTS).alias("quality"))


def threshold_failure(spark, d):
    low = weakest()
    return _results(spark, d).select("result_id", low["error"].alias("error"), low["metric"].alias("metric"), low["score"].alias("score"))


def joined_thresholds(spark, d):
    """Records with the threshold of their suite; a tenth of all records share one suite."""
    suites = table(spark, d, "eval_suites").withColumnRenamed("pass_threshold", "suite_threshold")
    return with_references(_records(spark, d), suites, "suite_id", ["suite_threshold", "topic"]).select("row_id", "suite_id", "suite_threshold", "topic")


def compared_runs(spark, d):
    """The latest result of each record by the two last evaluator versions."""

    def latest(version: str) -> DataFrame:
        own = _results(spark, d).where(F.col("evaluator_version") == version)
        return own.groupBy("row_id").agg(*(F.max_by(c, "result_id").alias(c) for c in ("status", "error_type")))

    return compare_runs(latest("1.2.0"), latest("1.3.0"), "row_id", ["status", "error_type"])


def summary(spark, d):
    return report.summary(_results(spark, d))


def error_counts(spark, d):
    return report.error_counts(_results(spark, d))


def error_options(spark, d):
    return report.error_options(_results(spark, d))


def lowest_k(spark, d):
    # the rows first, then the texts of these alone; the rows are as many as the limit
    rows = report.lowest_rows(_results(spark, d), "result_id", 25)
    texts = _records(spark, d).select("row_id", "question", "answer").join(F.broadcast(rows.select("row_id").distinct()), "row_id", "left_semi")
    return report.lowest(rows.join(texts, "row_id", "left"), "result_id", 25)


def filter_results(spark, d):
    return report.filtered(_results(spark, d), status="Fail", error_type="Unsupported Answer").select("result_id", "row_id", "quality_score")


def compact_results(spark, d):
    return report.compact(_shown(spark, d))


def row_details(spark, d):
    return report.row_details(_shown(spark, d))


def row_labels(spark, d):
    shown = _shown(spark, d)
    return shown.select("result_id", report.row_label(shown, "result_id").alias("label"))


def export_columns(spark, d):
    return report.export_columns(_results(spark, d))


def export_missing(spark, d):
    """Result columns that a table lacks are nulls."""
    return report.export_columns(_results(spark, d).drop("evaluator_version", "quality_score")).select("result_id", "quality_score", "evaluator_version", "status")


def csv_round_trip(spark, d):
    """Records written as CSV and read back: every field as text, blanks as nulls."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(_records(spark, d).select("row_id", "question", "answer", "expected_answer", "context"), path)
    return read_csv(spark, path).select("row_id", "question", "answer", "expected_answer", "context")


def validate_missing(spark, d):
    """A table without a required column: every row is invalid, with the reason."""
    v = validate(_records(spark, d).drop("answer"), row_id="row_id")
    return v.invalid.select("row_id", F.col(ERROR).alias("validation_error"), F.lit(v.can_evaluate()).alias("can_evaluate"))


def sample_evaluated(spark, d):
    """The bundled sample, evaluated with a constant similarity."""
    return evaluate(sample_records(spark), Constant(90)).select("id", "quality_score", "status", "error_type")


def sim_exact(spark, d):
    return _records(spark, d).select("row_id", Exact().similarity("answer", "expected_answer").alias("similarity"), Constant(90).similarity("question", "answer").alias("constant"))


QUERIES = {f.__name__: f for f in (
    validate_counts, validate_valid, validate_reasons, dedupe_first, rules_findings, sim_jaccard, sim_cosine, content_words, acronym_match, fact_alias,
    conflicts, equivalences, short_value_match, conflict_primary, evaluate_full, evaluate_adjusted, evaluate_summary, evaluate_changes,
    quality_score, quality_custom_weights, threshold_failure, joined_thresholds, compared_runs, summary, error_counts, error_options, lowest_k, filter_results, compact_results, row_details, row_labels, export_columns, export_missing, csv_round_trip, validate_missing, sample_evaluated, sim_exact, stated_conflicts, stated_agreements,
)}
QUERIES |= {f"rule_{n}": _finding(n) for n in (*FINDINGS, "word_count", "penalty")}
QUERIES |= {f"facts_{k}": _facts(k) for k in (*KINDS, "entities")}
QUERIES |= {f"stated_{k}": _stated_facts(k) for k in KINDS}
