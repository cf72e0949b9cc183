"""Text functions as SQL expressions and columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A word: letters, digits and underscores of any script, joined by apostrophes and hyphens.
WORD = r"[\p{L}\p{N}_]+(?:['-]+[\p{L}\p{N}_]+)*"
#: White space of any kind.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def quoted(s: str) -> str:
    """s as a SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def let(name: str, value: str, body: str) -> str:
    """body with name standing for value, which is computed once and which no rewriting takes apart."""
    return f"transform(array({value}), {name} -> {body})[0]"


def strip_sql(c: str) -> str:
    """c without white space of any kind at its ends."""
    return f"regexp_replace({c}, {quoted(f'^{SPACE}+|{SPACE}+$')}, '')"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def fold_sql(c: str) -> str:
    """c for comparison without case."""
    return f"replace(lower({c}), 'ß', 'ss')"


def words_sql(c: str) -> str:
    return f"regexp_extract_all({c}, {quoted(WORD)}, 0)"


def round_text(c: Column, digits: int) -> Column:
    """c with so many decimals, half to even on the exact binary value."""
    return F.replace(F.format_number(c, digits), F.lit(","))


def round_half_even(c: Column, digits: int = 2) -> Column:
    """c rounded half to even on its exact binary value, as the text form of doubles rounds."""
    return round_text(c, digits).cast("double")


def display_text(c: Column) -> Column:
    """c stripped, or N/A where it is null or blank."""
    return F.coalesce(F.nullif(strip(c.cast("string")), F.lit("")), F.lit("N/A"))


def display_score(c: Column) -> Column:
    """c with one decimal, or N/A where it is no number."""
    n = F.expr("1") if c is None else c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), "N/A").otherwise(round_text(n, 1))
