"""Typed facts of a text, read in Arrow batches, and the word sets in which texts are compared.

A fact is a key in normal form and the words that state it; keys and words of a kind lie in two
arrays of one order. Where forms overlap, the earlier one takes the text: full dates, durations, percentages, temperatures, fractions, storage
sizes, years, plain numbers. Which characters are taken is kept as one byte for each character, so
a text is read in time linear in its length, however many facts it has. Built-in functions cannot
say where a match begins; worked out from gaps and matches, the numbers of a text took three times as
long and grew with the square of the matches.

Kept as they are: a duration may overlap a date; days and months are not compared with each
other; Celsius and Fahrenheit neither; "1,000" is the numbers 1 and 0. Defined results: null and
empty texts have no facts; of several statements of one key the first counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import config
from gradeloom.functions.plan import computed
from gradeloom.functions.text import fold_sql, in_list, quoted

KINDS = ("durations", "percentages", "temperatures", "storage", "dates", "numbers")

_NUMBER_WORD = "|".join(config.NUMBER_WORDS)
_SMALL = "|".join(w for w, v in config.NUMBER_WORDS.items() if 1 <= v <= 9)
NUMBER = rf"(?:\d+(?:\.\d+)?|(?:{_NUMBER_WORD})(?:[-\s](?:{_SMALL}))?)"
_MONTH = "|".join(config.MONTHS)
_YEAR = r"(?:19|20)\d{2}"
_DAY = r"[0-3]?\d"

#: How facts are written.
PATTERNS = {
    "iso": rf"\b({_YEAR})[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])\b",
    "month_first": rf"(?i)\b({_MONTH})\s+({_DAY})(?:st|nd|rd|th)?(?:,\s*|\s+)({_YEAR})\b",
    "day_first": rf"(?i)\b({_DAY})(?:st|nd|rd|th)?\s+({_MONTH})(?:,\s*|\s+)({_YEAR})\b",
    "duration": rf"(?i)\b({NUMBER})\s*(seconds?|minutes?|hours?|days?|weeks?|months?|years?)\b",
    "percent": rf"(?i)\b({NUMBER})\s*(?:%(?!\w)|percent(?:age points?)?\b)",
    "temperature": rf"(?i)\b({NUMBER})\s*(?:(?:degrees?\s*)?(celsius|fahrenheit)|°\s*([cf]))\b",
    "fraction": r"(?i)\b(?:three[-\s]+quarters?|one[-\s]+quarters?|one[-\s]+halves?|one[-\s]+half|one[-\s]+fifths?|halfway|half)\b",
    "storage": rf"(?i)\b({NUMBER})\s*(kilobytes?|kb|megabytes?|mb|gigabytes?|gb)\b",
    "year": rf"\b{_YEAR}\b",
    "number": rf"(?i)\b{NUMBER}\b",
    "entity": r"\b[A-Z][A-Za-z'-]*(?:\s+(?:(?:of|the|and|bin|al)\s+)?[A-Z][A-Za-z'-]*)*\b",
}
#: A number begins with a digit or the first letter of a number word; to look for that first saves trying all words.
_READ = {form: re.compile(p.replace("(?i)\\b", rf"(?i)\b(?=[\d{''.join(sorted({w[0] for w in config.NUMBER_WORDS}))}])") if NUMBER in p else p) for form, p in PATTERNS.items()}
_MONTHS = {m: i + 1 for i, m in enumerate(config.MONTHS)}
#: Letters that a pattern without case takes for a Latin one.
_SAME_LETTER = str.maketrans("ıİſK", "iisk")


def _low(written: str) -> str:
    return written.lower() if written.isascii() else written.translate(_SAME_LETTER).lower()


def figure(written: str) -> float:
    """The value of digits or of number words."""
    try:
        return float(written)
    except ValueError:
        words = _low(written).replace("-", " ").split()
    total = sum(config.NUMBER_WORDS[w] for w in words if w != "hundred")
    return float(max(1, total) * 100 if "hundred" in words else total)


def _unit(m: re.Match) -> str:
    return _low(m[2]).removesuffix("s")


def _duration(m: re.Match) -> str:
    family, factor = config.DURATIONS[_unit(m)]
    return f"{family} {figure(m[1]) * factor}"


def _date(year: int, month: int, day: int) -> Callable[[re.Match], str]:
    """The key of a full date whose year, month and day are in these groups."""
    return lambda m: f"{m[year]}-{_MONTHS.get(_low(m[month])) or int(m[month])}-{int(m[day])}"


#: The forms in their turns: kind, key, and what the text in lower case must have for the form to be sought.
_FORMS: dict[str, tuple[str, Callable[[re.Match], str], re.Pattern]] = {
    form: (kind, key, re.compile(hint))
    for form, kind, key, hint in (
        ("iso", "dates", _date(1, 2, 3), "[-/]0?[1-9][0-2]?[-/]"),
        ("month_first", "dates", _date(3, 1, 2), _MONTH),
        ("day_first", "dates", _date(3, 2, 1), _MONTH),
        ("duration", "durations", _duration, "|".join(config.DURATIONS)),
        ("percent", "percentages", lambda m: repr(figure(m[1]) / 100), "%|percent"),
        ("temperature", "temperatures", lambda m: f"{'celsius' if (m[2] or m[3])[0] in 'cC' else 'fahrenheit'} {figure(m[1])}", "°|celsius|fahrenheit"),
        ("fraction", "percentages", lambda m: repr(config.FRACTIONS[re.sub(r"[-\s]+", " ", _low(m[0]))]), "hal[fv]|quarter|fifth"),
        ("storage", "storage", lambda m: repr(figure(m[1]) * config.STORAGE[_unit(m)]), "byte|[kmg]b"),
        ("year", "dates", lambda m: f"year {int(m[0])}", "19|20"),
        ("number", "numbers", lambda m: repr(figure(m[0])), rf"\d|{_NUMBER_WORD}"),
    )
}
#: Forms that may begin in what an earlier one took.
_ANYWHERE = ("duration",)
_NO_ENTITIES = frozenset(config.NO_ENTITIES) | frozenset(config.NUMBER_WORDS)
_FIELDS = (*KINDS, "entities")
FACTS = "struct<" + ",".join(f"{k}:struct<k:array<string>,s:array<string>>" for k in _FIELDS) + ">"


def canonical_entity(name: str) -> str:
    """An entity's name without case, possessive and article; people and adjectives as their country."""
    name = name.casefold()
    if name.endswith(("'s", "’s")):
        name = name[:-2]
    name = name.strip()
    if name.startswith(("the", "a")):
        name = re.sub(r"^(?:the|a|an)\s+", "", name)
    return config.SAME_ENTITY.get(name, name)


def read_facts(text: str | None) -> dict[str, dict[str, str]]:
    """For each kind, and for entities, the keys in the order of their first statements, and these."""
    found: dict[str, dict[str, str]] = {k: {} for k in _FIELDS}
    if not text:
        return found
    low, taken = _low(text), bytearray(len(text))
    for form, (kind, key, hint) in _FORMS.items():
        if hint.search(low) is None:
            continue
        for m in _READ[form].finditer(text):
            begin, end = m.span()
            if form in _ANYWHERE or taken.find(1, begin, end) < 0:
                found[kind].setdefault(key(m), m[0])
                taken[begin:end] = b"\x01" * (end - begin)
    for m in _READ["entity"].finditer(text):
        name = canonical_entity(m[0])
        if len(name) != 1 and name not in _NO_ENTITIES:
            found["entities"].setdefault(name, m[0])
    return found


def facts_of(texts: pa.Array) -> pa.Array:
    """The facts of each text of an Arrow array."""
    read = [read_facts(t) for t in texts.to_pylist()]
    lists = []
    for k in _FIELDS:
        ends, keys, said = [0], [], []
        for facts in read:
            keys += facts[k]
            said += facts[k].values()
            ends.append(len(keys))
        at = pa.array(ends, pa.int32())
        lists.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(x, pa.string())) for x in (keys, said)], ["k", "s"]))
    return pa.StructArray.from_arrays(lists, list(_FIELDS))


def facts(text: str | Column) -> Column:
    """A struct of the facts of a text: the six kinds, and the entities."""
    return F.arrow_udf(facts_of, FACTS)(F.col(text) if isinstance(text, str) else text)


def with_facts(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and a struct of the facts of a text column."""
    return computed(df, {name: facts(f"`{text}`")})


_WORD = r"[\p{L}\p{N}_]"
#: Where a word begins or ends; what stands before may be a mark.
BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def whole_words(pattern: str) -> str:
    """A pattern that begins and ends with words; letters, digits and underscores of any script make them."""
    return f"(?<!{_WORD}){pattern}(?!{_WORD})"


def content_sql(t: str) -> str:
    """The content words of t, each once: no stopwords, a final s dropped from words of more than four letters."""
    words = f"regexp_extract_all({fold_sql(t)}, {quoted(rf"(?<!{_WORD})[a-z][a-z'-]*{BOUNDARY}")}, 0)"
    kept = f"filter({words}, w -> w NOT IN {in_list(config.STOPWORDS)})"
    return f"array_distinct(transform({kept}, w -> IF(length(w) > 4, regexp_replace(w, 's$', ''), w)))"


def acronym_sql(left: str, right: str) -> str:
    """Whether an abbreviation in one text is spelled out by words in the other."""

    def initials(t: str) -> str:
        return f"array_join(transform(regexp_extract_all({t}, '[A-Za-z]+', 0), w -> IF(lower(w) IN {in_list(config.STOPWORDS)}, '#', lower(substr(w, 1, 1)))), '')"

    def one_way(a: str, b: str) -> str:
        short = quoted(whole_words("[A-Z][A-Z0-9]{1,5}"))
        return f"exists(regexp_extract_all({a}, {short}, 0), x -> contains({initials(b)}, lower(x)))"

    return f"({one_way(left, right)} OR {one_way(right, left)})"


def alias_sql(left: str, right: str) -> str:
    """Whether one text has a formula and the other the name of what it stands for."""
    one = []
    for short, long in config.ALIASES:
        s, n = quoted("(?i)" + whole_words(short)), quoted("(?i)" + whole_words(long))
        one.append(f"({left} RLIKE {s} AND {right} RLIKE {n}) OR ({left} RLIKE {n} AND {right} RLIKE {s})")
    return "(" + " OR ".join(one) + ")"
