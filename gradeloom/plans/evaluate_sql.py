"""The SQL beside which the whole evaluation is run: findings, comparison, metrics, status and feedback."""

from __future__ import annotations

from gradeloom import config
from gradeloom.plans.eval_sql import FINDINGS, jaccard, quality, rounded, summary
from gradeloom.plans.fact_sql import both

_METRICS = ("relevance_score", "correctness_score", "groundedness_score", "completeness_score")


def _metric(alike: str, conflict: str, agree: str) -> str:
    return f"CASE WHEN {alike} IS NULL THEN NULL WHEN {conflict} THEN least({alike}, 25.0::DOUBLE) WHEN {agree} THEN greatest({alike}, 85.0::DOUBLE) ELSE {alike} END"


_BY_LENGTH = "least(100.0::DOUBLE, word_count / 20.0::DOUBLE * 100)"
_LENGTH = f"CASE WHEN supported THEN 100.0::DOUBLE WHEN word_count >= 5 THEN greatest(60.0::DOUBLE, {_BY_LENGTH}) ELSE {_BY_LENGTH} END"
_KEPT = "100.0::DOUBLE - CASE WHEN supported THEN greatest(0.0::DOUBLE, penalty - 45) ELSE penalty END"
_WHOLE = f"CASE WHEN correctness_score IS NULL THEN {rounded(f'({_LENGTH} + ({_KEPT})) / 2')} ELSE {rounded(f'({_LENGTH} + ({_KEPT}) + correctness_score) / 3')} END"
_ERROR = """CASE WHEN empty THEN 'Empty Answer' WHEN placeholder THEN 'Insufficient Data' WHEN unwanted_refusal THEN 'Unwanted Refusal' WHEN question_repetition THEN 'Incomplete Answer'
    WHEN conflict THEN 'Contradictory Answer' WHEN formatting_problem THEN 'Formatting Issue' WHEN excessively_verbose THEN 'Overly Verbose' WHEN relevance_score < 35 THEN 'Irrelevant Answer'
    WHEN correctness_score < 30 THEN 'Contradictory Answer' WHEN correctness_score < 55 THEN 'Incorrect Answer' WHEN groundedness_score < 50 THEN 'Unsupported Answer'
    WHEN (extremely_short AND NOT supported) OR excessive_repetition OR completeness_score < 55 THEN 'Incomplete Answer' ELSE 'No Error' END"""
_LOWEST = "list_min(list_filter([" + ", ".join(f"CASE WHEN {m} IS NOT NULL THEN {{'score': {m}, 'turn': {i}}} END" for i, m in enumerate(_METRICS)) + "], lambda x: x IS NOT NULL))"
_ADVICE = "CASE error_type " + " ".join(f"WHEN '{e}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for e, t in config.FEEDBACK.items()) + " END"
_NAMES = {"named entity": "a named-entity", "duration": "a duration", "percentage": "a percentage", "temperature": "a temperature", "storage": "a storage-unit", "date": "a date", "number": "a numeric", "polarity": "an opposite-answer"}
_CONFLICT = "'The answer uses \"' || first.answer_value || '\", while the ' || source || ' uses \"' || first.reference_value || '\"; this is ' || CASE first.kind " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in _NAMES.items()) + " END || ' conflict.'"
_SHORT = f"'The ' || ['relevance', 'correctness', 'groundedness', 'completeness'][lowest.turn + 1] || ' score (' || format('{{:.1f}}', lowest.score) || ') was the weakest available metric and the main reason the overall quality score fell below the configured pass threshold ({config.THRESHOLD}).'"
_LACKING = "concat_ws('; ', CASE WHEN correctness_score IS NULL THEN 'correctness (no expected answer)' END, CASE WHEN groundedness_score IS NULL THEN 'groundedness estimate (no context)' END)"
_TEXT = f"""concat_ws(' ', CASE WHEN question_repetition THEN '{config.REPEATS_QUESTION}' WHEN first IS NOT NULL THEN {_CONFLICT} WHEN fell_short THEN {_SHORT} ELSE {_ADVICE} END,
    CASE WHEN {_LACKING} <> '' THEN 'Unavailable: ' || {_LACKING} || '.' END, '{config.DISCLAIMER}')"""

EVALUATED = f"""{both()}, {FINDINGS},
joined AS (SELECT k.*, found.* EXCLUDE (row_id), coalesce(len(e.conflicts), 0) > 0 AS ec, coalesce(len(c.conflicts), 0) > 0 AS cc, coalesce(e.agrees OR e.met, false) AS ea, coalesce(c.agrees, false) AS ca,
    coalesce(e.conflicts[1], c.conflicts[1]) AS first, CASE WHEN len(e.conflicts) > 0 THEN 'expected answer' ELSE 'context' END AS source
  FROM clean k JOIN found USING (row_id) LEFT JOIN e USING (row_id) LEFT JOIN c USING (row_id)),
alike AS (SELECT *, ec OR cc AS conflict, {jaccard('question', 'answer')} AS rel, CASE WHEN expected_answer IS NOT NULL THEN {jaccard('expected_answer', 'answer')} END AS cor, CASE WHEN context IS NOT NULL THEN {jaccard('context', 'answer')} END AS gro FROM joined),
referred AS (SELECT *, {_metric('cor', 'ec', 'ea')} AS correctness_score, {_metric('gro', 'cc', 'ca')} AS groundedness_score FROM alike),
backed AS (SELECT *, extremely_short AND NOT conflict AND greatest(coalesce(correctness_score, -1), coalesce(groundedness_score, -1)) >= 70 AS supported FROM referred),
measured AS (SELECT *, CASE WHEN supported THEN greatest(70.0::DOUBLE, CASE WHEN question_repetition THEN least(rel, 20.0::DOUBLE) ELSE rel END) WHEN empty THEN 0.0::DOUBLE WHEN question_repetition THEN least(rel, 20.0::DOUBLE) ELSE rel END AS relevance_score,
    CASE WHEN question_repetition THEN least({_WHOLE}, 20.0::DOUBLE) ELSE {_WHOLE} END AS completeness_score FROM backed),
weighed AS (SELECT *, {quality(config.WEIGHTS)} AS uncapped FROM measured),
capped AS (SELECT *, CASE WHEN conflict AND uncapped IS NOT NULL THEN least(uncapped, 60.0::DOUBLE) ELSE uncapped END AS quality_score, {_ERROR} AS error, {_LOWEST} AS lowest FROM weighed),
decided AS (SELECT *, CASE WHEN quality_score >= {config.THRESHOLD} AND error = 'No Error' THEN 'Pass' ELSE 'Fail' END AS status, error = 'No Error' AND NOT coalesce(quality_score >= {config.THRESHOLD}, false) AS fell_short FROM capped),
named AS (SELECT *, CASE WHEN fell_short THEN ['Irrelevant Answer', 'Incorrect Answer', 'Unsupported Answer', 'Incomplete Answer'][lowest.turn + 1] ELSE error END AS error_type FROM decided),
evaluated AS (SELECT *, {_TEXT} AS improvement_feedback FROM named)"""

ORACLES = {
    "evaluate_full": f"{EVALUATED} SELECT s.*, {', '.join(_METRICS)}, quality_score, status, error_type, improvement_feedback, 'Offline Hybrid' AS evaluation_mode, '1.3.0' AS evaluator_version FROM sample_evaluations s JOIN (SELECT row_id, {', '.join(_METRICS)}, quality_score, status, error_type, improvement_feedback FROM evaluated) USING (row_id)",
    "evaluate_adjusted": f"{EVALUATED} SELECT row_id, {', '.join(_METRICS)}, quality_score, conflict, supported FROM evaluated",
    "evaluate_summary": f"{EVALUATED} {summary('evaluated')}",
    "evaluate_changes": f"{EVALUATED}, latest AS (SELECT row_id, arg_max_null(status, result_id) AS old_status FROM evaluation_results GROUP BY 1) SELECT old_status, status AS new_status, count(*) AS n_records FROM latest FULL JOIN evaluated USING (row_id) GROUP BY ALL",
}
