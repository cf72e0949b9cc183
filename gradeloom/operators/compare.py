"""Conflicts and agreements of an answer with a reference text.

Conflicts come in a fixed order, kinds of values first, then percentages against plain shares,
then opposite words, then entities; the first is the one reported. Defined results: a null or
blank reference is not compared, and its comparison has no conflict and no agreement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gradeloom import config
from gradeloom.functions.facts import BOUNDARY, KINDS, acronym_sql, alias_sql, content_sql, facts, whole_words
from gradeloom.functions.plan import computed
from gradeloom.functions.text import SPACE, fold_sql, let, quoted

_KIND_NAMES = {"durations": "duration", "percentages": "percentage", "temperatures": "temperature", "storage": "storage", "dates": "date", "numbers": "number"}
CONFLICT = "struct<kind:string,answer_value:string,reference_value:string,source:string>"


def _conflict(kind: str, a: str, r: str, source: str) -> str:
    return f"named_struct('kind', {quoted(kind)}, 'answer_value', {a}, 'reference_value', {r}, 'source', {quoted(source)})"


def _equal(a: str, r: str) -> str:
    return f"size(array_except({a}, {r})) = 0 AND size(array_except({r}, {a})) = 0"


def _shared(a: str, r: str) -> str:
    return f"arrays_overlap({a}, {r})"


def _values(kind: str, a: str, r: str, source: str, agree: Callable[[str, str], str]) -> tuple[str, str]:
    """SQL of the conflict, or null, and of the agreement of two lists of facts; they conflict where they share none."""
    some = f"size({a}.k) > 0 AND size({r}.k) > 0"
    conflict = _conflict(kind, f"{a}.s[0]", f"{r}.s[0]", source)
    return f"CASE WHEN {some} AND NOT {_shared(f'{a}.k', f'{r}.k')} THEN {conflict} END", f"({some} AND {agree(f'{a}.k', f'{r}.k')})"


def _has(word: str) -> str:
    """A pattern, as SQL, of a word that SQL gives and that may end in a mark."""
    return f"concat({quoted(r'(?<![\p{L}\p{N}_])\Q')}, {word}, {quoted(r'\E' + BOUNDARY)})"


#: The opposites in their order, each in both directions.
_OPPOSITES = "array(" + ", ".join(f"struct({quoted(x)} AS x, {quoted(y)} AS y)" for pair in config.OPPOSITES for x, y in (pair, pair[::-1])) + ")"
_OPPOSITE_WORDS = quoted(whole_words(f"(?:{'|'.join(sorted({w for pair in config.OPPOSITES for w in pair}, key=lambda w: (-len(w), w)))})"))
_NEGATED = quoted(whole_words(rf"(?:not|never){SPACE}+[a-z]+"))


def _polarity(a: str, r: str, source: str) -> str:
    """The first opposite pair, in either direction, else the first negated word that stands plain in the other text."""

    def negation(x: str, y: str) -> str:
        word = f"regexp_extract(m, {quoted('[a-z]+$')}, 0)"
        return f"get(filter(regexp_extract_all({x}, {_NEGATED}, 0), m -> {word} <> 'only' AND {y} RLIKE {_has(word)}), 0)"

    def told(hit: str, first: str, second: str) -> str:
        return let("h", hit, f"CASE WHEN h IS NOT NULL THEN {_conflict('polarity', first, second, source)} END")

    pair = f"get(filter({_OPPOSITES}, p -> array_contains({a}_opposites, p.x) AND array_contains({r}_opposites, p.y)), 0)"
    pair = f"IF(size({a}_opposites) > 0 AND size({r}_opposites) > 0, {told(pair, 'h.x', 'h.y')}, NULL)"
    word = f"regexp_extract(h, {quoted('[a-z]+$')}, 0)"
    return f"coalesce({pair}, {told(negation(f'{a}_not', f'{r}_not'), 'h', word)}, {told(negation(f'{r}_not', f'{a}_not'), word, 'h')})"


def _entities(p: str, a: str, r: str, source: str) -> str:
    """A conflict of entities that only one text has, where the texts have something else in common."""

    def only(mine: str, others: str, other_text: str) -> str:
        return f"get(filter({mine}.k, x -> NOT array_contains({others}.k, x) AND NOT {other_text} RLIKE {_has('x')}), 0)"

    mine, others = only(f"{a}.entities", f"{r}.entities", f"{p}r_plain"), only(f"{r}.entities", f"{a}.entities", f"{p}a_plain")
    near = f"({_shared(f'{a}.entities.k', f'{r}.entities.k')} OR {_shared(f'{p}a_content', f'{p}r_content')} OR (size({p}a_content) <= 4 AND size({p}r_content) <= 4))"
    said = _conflict("named entity", f"{a}.entities.s[array_position({a}.entities.k, only.mine) - 1]", f"{r}.entities.s[array_position({r}.entities.k, only.others) - 1]", source)
    both = let("only", f"struct({mine} AS mine, {others} AS others)", f"CASE WHEN only.mine IS NOT NULL AND only.others IS NOT NULL THEN {said} END")
    return f"IF(size({a}.entities.k) > 0 AND size({r}.entities.k) > 0 AND NOT {p}acronym AND {near}, {both}, NULL)"


def comparison_sql(answer: str, a: str, reference: str, r: str, source: str) -> str:
    """A struct of the conflicts in their order, whether anything agrees, and whether a short reference is met.

    a and r are the facts of the answer and of the reference.
    """
    p = "read."
    possessive, not_ = quoted(r"(?:'s|’s)(?![\p{L}\p{N}_])"), quoted(r"n['’]t(?![\p{L}\p{N}_])")
    pairs = [_values(_KIND_NAMES[k], f"{a}.{k}", f"{r}.{k}", source, _equal) for k in KINDS]
    # percentages of one text against plain numbers from 0 to 1 of the other; one shared is enough to agree
    pairs += [_values("percentage", f"{a}.percentages", f"{p}r_shares", source, _shared), _values("percentage", f"{p}a_shares", f"{r}.percentages", source, _shared)]
    conflicts = [c for c, _ in pairs] + [_polarity(f"{p}a", f"{p}r", source), _entities(p, a, r, source)]
    agree = " OR ".join(e for _, e in pairs)
    agree += f" OR {_shared(f'{a}.entities.k', f'{r}.entities.k')} OR {p}acronym OR {alias_sql(f'{p}a', f'{p}r')}"
    short_words = quoted(r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])[\p{L}\p{N}_%°'-]*(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])")
    stated = " OR ".join(f"size({r}.{k}.k) > 0" for k in KINDS)
    held = " AND ".join(f"size(array_except({r}.{k}.k, {a}.{k}.k)) = 0" for k in KINDS)
    short = f"""{reference} IS NOT NULL AND size({p}r_content) <= 5 AND size(met.conflicts) = 0 AND size(regexp_extract_all({fold_sql(f'{p}r')}, {short_words}, 0)) <= 8
        AND ((({stated}) AND {held}) OR met.agrees OR (size({p}r_content) > 0 AND size(array_except({p}r_content, {p}a_content)) = 0))"""
    read = {"a": "said.a", "r": "said.r", "acronym": acronym_sql("said.a", "said.r")}
    for side, own in (("a", a), ("r", r)):
        text = f"said.{side}"
        read[f"{side}_content"] = content_sql(text)
        read[f"{side}_plain"] = f"regexp_replace({fold_sql(text)}, {possessive}, '')"
        read[f"{side}_not"] = f"regexp_replace({fold_sql(text)}, {not_}, ' not')"
        read[f"{side}_opposites"] = f"regexp_extract_all({read[f'{side}_not']}, {_OPPOSITE_WORDS}, 0)"
        shares = f"filter(arrays_zip({own}.numbers.k, {own}.numbers.s), x -> CAST(x.k AS DOUBLE) BETWEEN 0D AND 1D)"
        read[f"{side}_shares"] = let("shares", shares, "struct(shares.k AS k, shares.s AS s)")
    found = f"struct(CAST(filter(array({', '.join(conflicts)}), x -> x IS NOT NULL) AS array<{CONFLICT}>) AS conflicts, coalesce({agree}, false) AS agrees)"
    body = let("met", found, f"struct(met.conflicts AS conflicts, met.agrees AS agrees, coalesce({short}, false) AS short_value_met)")
    body = let("read", "struct(" + ", ".join(f"{sql} AS {k}" for k, sql in read.items()) + ")", body)
    compared = let("said", f"struct(coalesce({answer}, '') AS a, {reference} AS r)", body)
    nothing = f"struct(CAST(array() AS array<{CONFLICT}>) AS conflicts, false AS agrees, false AS short_value_met)"
    return f"IF({reference} IS NULL, {nothing}, {compared})"


def with_comparisons(df: DataFrame, answer: str = "answer", expected: str = "expected_answer", context: str = "context") -> DataFrame:
    """df and the comparisons with both references, the answer's facts extracted once."""
    texts = {"answer_facts": answer, "expected_facts": expected, "context_facts": context}
    out = computed(df, {name: facts(f"`{text}`") for name, text in texts.items()})
    return computed(out, {
        "against_expected": F.expr(comparison_sql(f"`{answer}`", "answer_facts", f"`{expected}`", "expected_facts", "expected answer")),
        "against_context": F.expr(comparison_sql(f"`{answer}`", "answer_facts", f"`{context}`", "context_facts", "context")),
    })
