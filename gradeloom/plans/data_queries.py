"""Queries of the core's data preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.operators.units import to_common_units
from gradeloom.sources.lines import parse_lines, split_lines
from gradeloom.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_lines(table(spark, d, "upload_lines"))[1]


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    good = split_lines(table(spark, d, "upload_lines"))[0]
    return good.withColumns({"pass_threshold": F.expr("try_cast(pass_threshold AS INT)"), "asked_at": F.col("asked_at").cast("timestamp_ntz")})


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rows loaded and rejected by file."""
    lines = table(spark, d, "upload_lines")
    parsed = parse_lines(lines).select("line_id", "reason")
    return parsed.groupBy(F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n_lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """These values state exactly one quantity."""
    amounts = to_common_units(table(spark, d, "sample_evaluations"), table(spark, d, "unit_targets"), every=False)
    return amounts.select("row_id", "field_name", F.round("amount").cast("bigint").alias("amount"))


def p6_stated(spark: SparkSession, d: str) -> DataFrame:
    """Statements put together from the parts table, several quantities in each, in common units."""
    parts = table(spark, d, "part").selectExpr(
        "p_partkey AS row_id", "'What does the label say?' AS question", "concat('It weighs ', p_size, ' kg, is ', p_size * 3, ' cm long and lasts ', p_size + 1, ' minutes.') AS answer",
        "concat('Holds ', p_size, ' litres at ', p_size + 20, ' °C.') AS expected_answer", "concat('One file has ', p_size, ' MB, the other ', p_size * 2, ' GB; box ', p_size, '.') AS context",
    )
    return to_common_units(parts, table(spark, d, "unit_targets")).select("row_id", "field_name", F.col("place").cast("bigint").alias("place"), "quantity", F.round("amount", 3).alias("amount"))


QUERIES = {f.__name__: f for f in (p3_found, p3_records, p3_reasons, p6_found, p6_stated)}

_QUOTED_OK = r"""^(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*$"""
_FIELD = r"""("(?:[^"]|"")*"|[^",\r\n]*)"""
#: The lines judged by regular expressions alone: as many groups as declared columns.
_LINES = f"""
judged AS (
  SELECT line_id, raw_line, coalesce(regexp_matches(raw_line, '{_QUOTED_OK}'), true) AS quoted_ok,
         coalesce(regexp_matches(raw_line, '^{",".join([_FIELD] * 7)}$'), false) AS seven,
         regexp_extract(raw_line, '^{",".join([_FIELD] * 7)}$', ['id','question','answer','expected_answer','context','pass_threshold','asked_at']) AS raw
  FROM upload_lines),
cells AS (
  SELECT line_id, quoted_ok, seven, {", ".join(f"CASE WHEN raw.{c} LIKE '\"%' THEN replace(raw.{c}[2:-2], '\"\"', '\"') ELSE raw.{c} END AS {c}" for c in ("id", "question", "answer", "expected_answer", "context", "pass_threshold", "asked_at"))}
  FROM judged),
labelled AS (
  SELECT *, CASE WHEN NOT quoted_ok THEN 'bad_quoting' WHEN NOT seven THEN 'column_count'
                 WHEN NOT regexp_matches(question, '\\S') OR NOT regexp_matches(answer, '\\S')
                   OR NOT (pass_threshold = '' OR (regexp_matches(pass_threshold, '^[0-9]+$') AND coalesce(try_cast(pass_threshold AS BIGINT), 999) <= 100))
                   OR NOT regexp_matches(asked_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$')
                   OR try_cast(asked_at AS TIMESTAMP) IS NULL OR asked_at LIKE '% 24:%' THEN 'bad_value' END AS reason
  FROM cells)
"""
ORACLES = {
    "p6_stated": """WITH s AS (SELECT p_partkey AS row_id, p_size AS n FROM part), q AS (
        SELECT row_id, 'answer' AS field_name, 0 AS place, 'mass' AS quantity, n * 1000 AS base FROM s UNION ALL SELECT row_id, 'answer', 1, 'length', n * 30 FROM s UNION ALL SELECT row_id, 'answer', 2, 'duration', (n + 1) * 60 FROM s
        UNION ALL SELECT row_id, 'expected_answer', 0, 'volume', n * 1000 FROM s UNION ALL SELECT row_id, 'expected_answer', 1, 'temperature', n + 20 FROM s
        UNION ALL SELECT row_id, 'context', 0, 'storage', n * 1024 FROM s UNION ALL SELECT row_id, 'context', 1, 'storage', n * 2097152 FROM s)
      SELECT row_id, field_name, CAST(place AS BIGINT) AS place, quantity, CAST(base AS DOUBLE) AS amount FROM q JOIN (SELECT DISTINCT quantity FROM unit_targets) USING (quantity)""",
    "p3_found": f"WITH {_LINES} SELECT line_id, reason FROM labelled WHERE reason IS NOT NULL",
    "p3_records": f"WITH {_LINES} SELECT line_id, id, question, answer, expected_answer, context, try_cast(pass_threshold AS INT) AS pass_threshold, CAST(asked_at AS TIMESTAMP) AS asked_at FROM labelled WHERE reason IS NULL",
    "p3_reasons": f"WITH {_LINES} SELECT coalesce(reason, 'loaded') AS outcome, count(*) AS n_lines FROM labelled GROUP BY 1",
}
