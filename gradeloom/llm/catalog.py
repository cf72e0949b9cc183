"""Queries of the text operators, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm.copies import copy_groups, further_copies
from gradeloom.llm.leakage import leaks
from gradeloom.llm.mixing import mixture, shares
from gradeloom.llm.pairs import defects
from gradeloom.llm.plain_text import not_plain, plain_columns
from gradeloom.llm.repetition import repetition
from gradeloom.llm.truncation import ENDED, OMITTED, cut_shares, cut_texts, storage_limits
from gradeloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return not_plain(table(spark, d, "sample_evaluations"), "row_id", ["answer", "expected_answer"])


def p1_plain(spark: SparkSession, d: str) -> DataFrame:
    """Both texts in plain form, and whether they agree."""
    plain = plain_columns(table(spark, d, "sample_evaluations"), "row_id", ["answer", "expected_answer"])
    return plain.select("row_id", "answer", "expected_answer", F.col("answer").eqNullSafe(F.col("expected_answer")).alias("same_text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts(table(spark, d, "sample_evaluations"))


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut answers of each source."""
    return cut_shares(table(spark, d, "sample_evaluations"))


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    """The storage limits that the lengths show."""
    return storage_limits(table(spark, d, "sample_evaluations"))


TEXTS = ["question", "answer", "expected_answer", "context"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return further_copies(table(spark, d, "sample_evaluations"), "row_id", TEXTS)


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One record of each group of copies, with their number."""
    groups = copy_groups(table(spark, d, "sample_evaluations"), "row_id", TEXTS)
    return groups.where("row_id = first_id").select("row_id", "n_copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return defects(table(spark, d, "sample_evaluations"))


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs have each kind of defect."""
    return defects(table(spark, d, "sample_evaluations")).groupBy("defect").agg(F.count("*").alias("n_pairs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "benchmark_items"), table(spark, d, "documents")).select("item_id", "doc_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked: into how many documents, and at most to what share."""
    found = leaks(table(spark, d, "benchmark_items"), table(spark, d, "documents"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("share").alias("most"), F.max("longest_phrase").alias("longest_phrase"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    targets = table(spark, d, "mix_targets")
    return shares(mixture(table(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition(table(spark, d, "documents"), least=0.3).select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of every document."""
    return repetition(table(spark, d, "documents")).select("doc_id", "n_words", "n_repeated", "share")


QUERIES = {f.__name__: f for f in (p1_found, p1_plain, p2_found, p2_sources, p2_limits, p4_found, p4_records, p5_found, p5_kinds, p7_found, p7_items, p8_mixture, p8_shares, p9_found, p9_shares)}

_FIGURE = {".": 1, ",": 2}


def _folded(c: str) -> str:
    """SQL of a text without whitespace, case and punctuation, the signs of figures kept as control characters."""
    sql = f"replace(lower(coalesce({c}, '')), '%', chr(4))"
    sql = f"regexp_replace({sql}, '(^|[\\s(])-([0-9])', '\\1' || chr(3) || '\\2', 'g')"
    for sign, code in _FIGURE.items():
        for _ in range(2):
            sql = f"regexp_replace({sql}, '([0-9])[{sign}]([0-9])', '\\1' || chr({code}) || '\\2', 'g')"
    return f"replace(regexp_replace({sql}, '[\\s\\p{{P}}\\p{{Z}}]+', '', 'g'), 'ß', 'ss')"


_FOLDED = ", ".join(map(_folded, TEXTS))
_GROUPS = f"SELECT row_id, min(row_id) OVER g AS first_id, count(*) OVER g AS n_copies FROM (SELECT row_id, list_sort([{_FOLDED}]) AS k FROM sample_evaluations) WINDOW g AS (PARTITION BY k)"
_FORMS = {
    "characters": "length(t)", "utf8": "strlen(t)", "utf16": r"length(t) + len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]'))",
    "entities": "length(t) + 4 * n_amp + 3 * n_lt + 3 * n_gt + 5 * n_quote + 4 * n_tick", "json": "length(t) + n_quote + n_back + n_line + n_return + n_tab",
    "two_character_breaks": "length(t) + n_line - n_both",
}
_SIGNS = {"n_amp": "'&'", "n_lt": "'<'", "n_gt": "'>'", "n_quote": "chr(34)", "n_tick": "chr(39)", "n_back": "chr(92)", "n_line": "chr(10)", "n_return": "chr(13)", "n_tab": "chr(9)", "n_both": "chr(13) || chr(10)"}
_ENDED, _OMITTED = (p.replace("'", "''") for p in (ENDED, OMITTED))
_LIMITS = f"""
WITH a AS (SELECT coalesce(source, '') AS source, answer AS t, NOT regexp_matches(answer, '{_ENDED}') OR regexp_matches(answer, '{_OMITTED}') AS no_end FROM sample_evaluations WHERE length(trim(answer)) > 0),
s AS (SELECT *, {", ".join(f"(length(t) - length(replace(t, {sign}, ''))) // length({sign}) AS {name}" for name, sign in _SIGNS.items())} FROM a),
l AS ({" UNION ALL ".join(f"SELECT source, no_end, '{form}' AS form, {sql} AS len FROM s" for form, sql in _FORMS.items())}),
c AS (SELECT source, form, len, count(*) AS n, count(*) FILTER (no_end) AS n_open FROM l GROUP BY ALL),
w AS (SELECT *, (sum(n_open) OVER (PARTITION BY source, form ORDER BY len RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) - n_open) / 16 AS around,
        coalesce(sum(n) OVER (PARTITION BY source, form ORDER BY len RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS n_beyond FROM c)
SELECT source, form, len AS "limit", n_open AS n_at, CAST(n_beyond AS BIGINT) AS n_beyond FROM w
WHERE n_open >= 5 AND n_open >= 6 * (around + 0.5) AND n_beyond <= n_open * 0.1 AND len >= 16
"""
_SHARES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, run) AS first FROM g) WHERE i > first),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM later, range(0, 8) AS t(k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_repeated, coalesce(n, 0) / greatest(len(ws), 1) AS share FROM w LEFT JOIN covered USING (doc_id)
"""
ORACLES: dict[str, str] = {
    "p2_limits": _LIMITS,
    "p4_found": f"SELECT first_id AS row_id_a, row_id AS row_id_b FROM ({_GROUPS}) WHERE row_id <> first_id",
    "p4_records": f"SELECT row_id, n_copies FROM ({_GROUPS}) WHERE row_id = first_id",
    "p9_found": f"SELECT doc_id FROM ({_SHARES}) WHERE share >= 0.3",
    "p9_shares": _SHARES,
}
