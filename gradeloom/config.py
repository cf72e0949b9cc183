"""Settings of the evaluation. Everything here is a fixed value that results depend on."""

from __future__ import annotations

#: Columns of the input, and those that the evaluation adds, in their order.
REQUIRED = ("question", "answer")
OPTIONAL = ("expected_answer", "context", "id")
RESULT_COLUMNS = (
    "relevance_score", "correctness_score", "groundedness_score", "completeness_score", "quality_score",
    "status", "error_type", "improvement_feedback", "evaluation_mode", "evaluated_at", "evaluator_version",
)

#: Weights of the metrics in the quality score, in the order in which they are summed.
WEIGHTS = {"correctness_score": 0.35, "relevance_score": 0.25, "groundedness_score": 0.25, "completeness_score": 0.15}
THRESHOLD = 70
MODE, VERSION = "Offline Hybrid", "1.3.0"

ERROR_TYPES = (
    "No Error", "Empty Answer", "Irrelevant Answer", "Incorrect Answer", "Incomplete Answer", "Unsupported Answer",
    "Contradictory Answer", "Overly Verbose", "Unwanted Refusal", "Formatting Issue", "Insufficient Data",
)
#: The error of a metric that is the weakest where only the threshold fails; ties go to the first.
WEAKEST = {
    "relevance_score": "Irrelevant Answer", "correctness_score": "Incorrect Answer",
    "groundedness_score": "Unsupported Answer", "completeness_score": "Incomplete Answer",
}

#: What each finding takes from completeness.
PENALTIES = {
    "empty": 100, "extremely_short": 45, "question_repetition": 80, "excessive_repetition": 25,
    "placeholder": 65, "unwanted_refusal": 45, "excessively_verbose": 15, "formatting_problem": 10,
}
QUESTION_WORDS = "what which who whom whose when where why how".split()
COMMAND_WORDS = "answer identify name state tell".split()
#: Words that do not count when an answer is compared with its question; question and command words don't either.
FUNCTION_WORDS = "a an are as be being can could did do does for from has have in is it of on please question query asked asking that the this to was were would".split()
PLACEHOLDERS = ("n/?a", "none", "unknown", "todo", "tbd", "placeholder", "no answer", "not sure", "idk")
REFUSALS = ("i (?:cannot|can't|won't|am unable to)", "as an ai", "i must refuse", "i do not have the ability", "i'm sorry,? but i can't")

#: Words that do not count as content when texts are compared.
STOPWORDS = "a an and are as at be by for from in is it of on or that the to was were with".split()
#: Capitalised words that are no entities; number words aren't either.
NO_ENTITIES = (
    "a an the this that these those yes no true false approved rejected accepted denied allowed prohibited enabled disabled at there "
    "celsius fahrenheit kelvin january february march april may june july august september october november december"
).split()
SAME_ENTITY = {"japanese": "japan", "saudi": "saudi arabia", "british": "britain"}
OPPOSITES = (
    ("yes", "no"), ("approved", "rejected"), ("approved", "denied"), ("accepted", "rejected"), ("accepted", "denied"), ("allowed", "prohibited"),
    ("enabled", "disabled"), ("true", "false"), ("successful", "failed"), ("increase", "decrease"), ("increased", "decreased"), ("before", "after"),
)
#: Formulas and the names of what they stand for.
ALIASES = ((r"h\s*2\s*o", "water"), (r"co\s*2", r"carbon\s+dioxide"))

NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
MONTHS = "january february march april may june july august september october november december".split()
#: Duration units: the family in which they compare, and the factor.
DURATIONS = {
    "second": ("fixed", 1), "minute": ("fixed", 60), "hour": ("fixed", 3600), "day": ("fixed", 86400), "week": ("fixed", 604800),
    "month": ("calendar", 1), "year": ("calendar", 12),
}
STORAGE = {"kilobyte": 1, "kb": 1, "megabyte": 1024, "mb": 1024, "gigabyte": 1048576, "gb": 1048576}
FRACTIONS = {
    "halfway": 0.5, "half": 0.5, "one half": 0.5, "one halves": 0.5, "one quarter": 0.25, "one quarters": 0.25,
    "three quarter": 0.75, "three quarters": 0.75, "one fifth": 0.2, "one fifths": 0.2,
}

#: How a conflict of each kind is named.
CONFLICT_NAMES = {
    "named entity": "named-entity", "duration": "duration", "percentage": "percentage", "temperature": "temperature",
    "storage": "storage-unit", "date": "date", "number": "numeric", "polarity": "opposite-answer",
}
FEEDBACK = {
    "Empty Answer": "Provide a substantive answer before evaluating it.",
    "Irrelevant Answer": "Revise the answer so it directly addresses the question.",
    "Incorrect Answer": "The answer does not closely match the expected answer; review the key claims and missing details.",
    "Incomplete Answer": "Expand the answer with the essential details needed to resolve the question.",
    "Unsupported Answer": "The groundedness estimate is low. Remove unsupported claims or connect them more clearly to the supplied context.",
    "Contradictory Answer": "The answer strongly conflicts with the expected answer. Recheck its central claim.",
    "Overly Verbose": "Make the answer more concise while preserving the information needed to answer the question.",
    "Unwanted Refusal": "Answer the request directly when it is safe and possible instead of using a generic refusal.",
    "Formatting Issue": "Improve readability by using normal capitalization, punctuation, and shorter lines.",
    "Insufficient Data": "Replace placeholder text with a complete, meaningful answer.",
    "No Error": "The answer passed the available offline quality checks.",
}
REPEATS_QUESTION = "The response repeats or closely reformulates the question without providing an answer. Supply the requested factual value or conclusion."
NO_EXPECTED, NO_CONTEXT = "correctness (no expected answer)", "groundedness estimate (no context)"
DISCLAIMER = "These local semantic and rule-based checks are estimates, not a guarantee of factual correctness."
