"""The SQL beside which the validation, rule, score and report queries are run."""

from __future__ import annotations

from gradeloom import config
from gradeloom.functions.text import in_list

_RULES = tuple(config.PENALTIES)
_OTHER_WEIGHTS = {"correctness_score": 2.0, "relevance_score": 1.0}
_SCORES = ("quality_score", "relevance_score", "correctness_score", "groundedness_score", "completeness_score")
_WS = r"[\s\p{Z}\x1c-\x1f\x{85}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _norm(c: str) -> str:
    return f"lower({_strip(f"coalesce({c}, '')")})"


_VALIDATED = f"""
tagged AS (
  SELECT *, {_norm('question')} = '' AS eq, {_norm('answer')} = '' AS ea,
         row_id > min(row_id) OVER (PARTITION BY {_norm('question')}, {_norm('answer')}, {_norm('expected_answer')}, {_norm('context')}) AS dup
  FROM sample_evaluations)"""
_W = r"[\p{L}\p{N}_]+(?:[''-]+[\p{L}\p{N}_]+)*"
_IGNORED = in_list([*config.FUNCTION_WORDS, *config.QUESTION_WORDS, *config.COMMAND_WORDS])
_ASKING = in_list([*config.QUESTION_WORDS, *config.COMMAND_WORDS])
_LINE = r"[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FINDINGS = rf"""
t AS (SELECT row_id, coalesce(question, '') AS q, {_strip("coalesce(answer, '')")} AS a FROM sample_evaluations),
w AS (SELECT *, regexp_extract_all(lower(a), '{_W}') AS words, regexp_extract_all(replace(lower(a), 'ß', 'ss'), '{_W}') AS folded,
       regexp_extract_all(replace(lower(q), 'ß', 'ss'), '{_W}') AS asked, len(regexp_extract_all(q, '{_W}')) AS nq,
       list_filter(list_transform(string_split_regex(a, '[.!?\n]+'), lambda c: lower({_strip('c')})), lambda c: c <> '') AS chunks FROM t),
s AS (SELECT *, len(words) AS n, list_distinct(list_filter(folded, lambda x: x NOT IN {_IGNORED})) AS own, list_distinct(list_filter(asked, lambda x: x NOT IN {_IGNORED})) AS wanted,
       coalesce(list_max(map_values(list_histogram(words))), 0) AS most FROM w),
f AS (SELECT row_id, a = '' AS empty, a <> '' AND n < 5 AS extremely_short,
       CASE WHEN len(asked) = 0 OR len(folded) = 0 THEN false WHEN asked = folded THEN true WHEN len(wanted) = 0 THEN false
            ELSE ((ends_with(a, '?') OR folded[1] IN {_ASKING}) AND len(list_intersect(wanted, own)) / len(wanted) >= 0.65)
              OR (len(list_intersect(wanted, own)) / len(wanted) >= 0.8 AND len(list_filter(own, lambda x: NOT list_contains(wanted, x))) = 0) END AS question_repetition,
       (len(chunks) >= 3 AND (len(chunks) - len(list_distinct(chunks))) / len(chunks) >= 0.4) OR (n >= 12 AND most / n >= 0.35) AS excessive_repetition,
       regexp_matches(a, '(?i)^(?:{'|'.join(config.PLACEHOLDERS)})[.!]?$') AS placeholder,
       regexp_matches(a, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(config.REFUSALS).replace(chr(39), chr(39) * 2)})(?:$|[^\p{{L}}\p{{N}}_])') AS unwanted_refusal,
       n > 350 OR (n > 160 AND nq > 0 AND n / nq > 30) AS excessively_verbose,
       regexp_matches(a, '[!?]{{4,}}') OR regexp_matches(a, '\b[A-Z]{{5,}}(?:\s+[A-Z]{{5,}}){{2,}}\b') OR regexp_matches(a, '{_LINE}{{501}}') AS formatting_problem,
       n AS word_count FROM s),
found AS (SELECT *, CAST(least(100, {' + '.join(f'CASE WHEN {k} THEN {p} ELSE 0 END' for k, p in config.PENALTIES.items())}) AS DOUBLE) AS penalty FROM f)"""


def rounded(x: str, n: int = 2) -> str:
    return f"CAST(format('{{:.{n}f}}', {x}) AS DOUBLE)"


def quality(weights: dict) -> str:
    total = " + ".join(f"coalesce({m} * {float(w)}::DOUBLE, 0)" for m, w in weights.items())
    weight = " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE {float(w)}::DOUBLE END" for m, w in weights.items())
    return f"CASE WHEN {weight} > 0 THEN {rounded(f'(0 + {total}) / (0 + {weight})')} END"


def _show(c: str) -> str:
    return f"coalesce(nullif({_strip(c)}, ''), 'N/A')"


def _show_score(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 'N/A' ELSE format('{{:.1f}}', {c}) END"


_SHOWN = "shown AS (SELECT r.*, s.question, s.answer, s.expected_answer, s.context FROM evaluation_results r LEFT JOIN sample_evaluations s USING (row_id))"
_COMPACT = {"Status": f"upper({_show('status')})", "Quality": _show_score("quality_score"), "Error Type": _show("error_type"), "Question": _show("question"), "Answer": _show("answer"), "Expected Answer": _show("expected_answer"), "Context": _show("context")}
_DETAILS = {"Status": _COMPACT["Status"], "Quality score": _COMPACT["Quality"], "Error type": _COMPACT["Error Type"], "Question": _COMPACT["Question"], "Answer": _COMPACT["Answer"], "Expected answer": _COMPACT["Expected Answer"], "Context": _COMPACT["Context"],
            **{n: _show_score(f"{n.lower()}_score") for n in ("Relevance", "Correctness", "Groundedness", "Completeness")}, "Improvement feedback": _show("improvement_feedback")}


def _select(fields: dict) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in fields.items())


_KNOWN = "[" + ", ".join(f"'{e}'" for e in config.ERROR_TYPES) + "]"
_LOW = ", ".join(f"CASE WHEN {m} IS NOT NULL THEN {{'score': {m}, 'turn': {i}, 'error': '{e}', 'metric': '{m}'}} END" for i, (m, e) in enumerate(config.WEAKEST.items()))


def _word_set(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+'))"


def jaccard(a: str, b: str) -> str:
    both, all_ = f"len(list_intersect({_word_set(a)}, {_word_set(b)}))", f"len(list_distinct(list_concat({_word_set(a)}, {_word_set(b)})))"
    return f"CASE WHEN {all_} = 0 THEN 0.0::DOUBLE ELSE {rounded(f'100.0::DOUBLE * {both} / {all_}')} END"


_SCORE_LIST = ", ".join(f"{rounded(f'avg({s})', 1)} AS average_{s}" for s in _SCORES)


def summary(results: str) -> str:
    return f"SELECT count(*) AS total, count(*) FILTER (status = 'Pass') AS passed, count(*) - count(*) FILTER (status = 'Pass') AS failed, CASE WHEN count(*) = 0 THEN 0.0 ELSE {rounded('count(*) FILTER (status = $$Pass$$) / count(*) * 100', 1)} END AS pass_rate, CASE WHEN count(*) = 0 THEN 0.0 ELSE {rounded('(count(*) - count(*) FILTER (status = $$Pass$$)) / count(*) * 100', 1)} END AS fail_rate, {_SCORE_LIST} FROM {results}"


ORACLES = {
    "validate_counts": f"WITH {_VALIDATED} SELECT count(*) AS total_rows, count(*) FILTER (NOT (eq OR ea OR dup)) AS valid_rows, count(*) FILTER (eq OR ea OR dup) AS invalid_rows, CAST(coalesce(sum(eq::INT + ea::INT), 0) AS BIGINT) AS empty_required_values, count(*) FILTER (dup) AS duplicate_rows FROM tagged",
    "validate_valid": f"WITH {_VALIDATED} SELECT row_id, question, answer FROM tagged WHERE NOT (eq OR ea OR dup)",
    "validate_reasons": f"WITH {_VALIDATED} SELECT row_id, concat_ws('; ', CASE WHEN eq OR ea THEN 'Empty required value(s): ' || concat_ws(', ', CASE WHEN eq THEN 'question' END, CASE WHEN ea THEN 'answer' END) END, CASE WHEN dup THEN 'Duplicate row' END) AS validation_error FROM tagged WHERE eq OR ea OR dup",
    "dedupe_first": f"WITH {_VALIDATED} SELECT row_id FROM tagged WHERE NOT dup",
    "rules_findings": f"WITH {FINDINGS} SELECT * FROM found",
    "sim_jaccard": f"SELECT row_id, {jaccard('question', 'answer')} AS similarity FROM sample_evaluations",
    "sim_cosine": f"SELECT a.vec_id, {rounded('least(100.0, greatest(0.0, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * 100))')} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "quality_score": f"SELECT result_id, {quality(config.WEIGHTS)} AS quality FROM evaluation_results",
    "quality_custom_weights": f"SELECT result_id, {quality(_OTHER_WEIGHTS)} AS quality FROM evaluation_results",
    "threshold_failure": f"WITH l AS (SELECT result_id, list_min(list_filter([{_LOW}], lambda x: x IS NOT NULL)) AS low FROM evaluation_results) SELECT result_id, coalesce(low.error, 'Incomplete Answer') AS error, coalesce(low.metric, 'completeness_score') AS metric, coalesce(low.score, 0.0) AS score FROM l",
    "joined_thresholds": "SELECT row_id, suite_id, s.pass_threshold AS suite_threshold, topic FROM sample_evaluations LEFT JOIN eval_suites s USING (suite_id)",
    "compared_runs": "WITH o AS (SELECT row_id, arg_max_null(status, result_id) AS os, arg_max_null(error_type, result_id) AS oe FROM evaluation_results WHERE evaluator_version = '1.2.0' GROUP BY 1), n AS (SELECT row_id, arg_max_null(status, result_id) AS ns, arg_max_null(error_type, result_id) AS ne FROM evaluation_results WHERE evaluator_version = '1.3.0' GROUP BY 1) SELECT coalesce(o.row_id, n.row_id) AS row_id, os AS old_status, oe AS old_error_type, ns AS new_status, ne AS new_error_type, o.row_id IS NULL OR n.row_id IS NULL OR os IS DISTINCT FROM ns OR oe IS DISTINCT FROM ne AS differs FROM o FULL JOIN n ON o.row_id = n.row_id",
    "summary": summary("evaluation_results"),
    "error_counts": "SELECT error_type, count(*) AS count FROM evaluation_results WHERE error_type IS NOT NULL GROUP BY 1",
    "error_options": f"SELECT DISTINCT error_type, CAST(coalesce(list_position({_KNOWN}, error_type), {len(config.ERROR_TYPES) + 1}) AS BIGINT) AS turn FROM evaluation_results WHERE error_type IS NOT NULL",
    "lowest_k": f"WITH {_SHOWN} SELECT {_select({k: v for k, v in _COMPACT.items() if k not in ('Expected Answer', 'Context')})} FROM (SELECT * FROM shown ORDER BY CASE WHEN status = 'Fail' THEN 0 ELSE 1 END, quality_score ASC NULLS LAST, result_id LIMIT 25)",
    "filter_results": "SELECT result_id, row_id, quality_score FROM evaluation_results WHERE status = 'Fail' AND error_type = 'Unsupported Answer'",
    "compact_results": f"WITH {_SHOWN} SELECT {_select(_COMPACT)} FROM shown",
    "row_details": f"WITH {_SHOWN} SELECT {_select(_DETAILS)} FROM shown",
    "row_labels": f"WITH {_SHOWN}, l AS (SELECT result_id, upper({_show('status')}) AS st, {_show('question')} AS q FROM shown) SELECT result_id, 'Row ' || result_id || ' · ' || st || ' · ' || CASE WHEN length(q) > 68 THEN rtrim(q[1:65]) || '…' ELSE q END AS label FROM l",
    "export_columns": "SELECT result_id, row_id, loaded_at, relevance_score, correctness_score, groundedness_score, completeness_score, quality_score, status, error_type, improvement_feedback, evaluation_mode, evaluated_at, evaluator_version FROM evaluation_results",
    "export_missing": "SELECT result_id, CAST(NULL AS VARCHAR) AS quality_score, CAST(NULL AS VARCHAR) AS evaluator_version, status FROM evaluation_results",
    "csv_round_trip": "SELECT CAST(row_id AS VARCHAR) AS row_id, nullif(question, '') AS question, nullif(answer, '') AS answer, nullif(expected_answer, '') AS expected_answer, nullif(context, '') AS context FROM sample_evaluations",
    "validate_missing": "SELECT row_id, 'Missing required column(s): answer' AS validation_error, false AS can_evaluate FROM sample_evaluations",
    "sample_evaluated": "SELECT * FROM (VALUES ('s1', 89.0::DOUBLE, 'Pass', 'No Error'), ('s2', 46.75, 'Fail', 'Contradictory Answer'), ('s3', 89.0, 'Pass', 'No Error'), ('s4', 20.0, 'Fail', 'Incomplete Answer'), ('s5', 86.75, 'Fail', 'Unwanted Refusal'), ('s6', 91.33, 'Pass', 'No Error')) t(id, quality_score, status, error_type)",
    "sim_exact": f"SELECT row_id, CASE WHEN lower({_strip('answer')}) = lower({_strip('expected_answer')}) THEN 100.0::DOUBLE ELSE 20.0::DOUBLE END AS similarity, 90.0::DOUBLE AS constant FROM sample_evaluations",
}
ORACLES |= {f"rule_{n}": f"WITH {FINDINGS} SELECT row_id, {n} FROM found" for n in (*_RULES, "word_count", "penalty")}
