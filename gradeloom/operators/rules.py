"""Deterministic checks of an answer, one struct of findings per row.

Defined results: a null question or answer is an empty text; texts are taken whole; the
findings of a row depend on that row alone, so ties and repeated rows need no rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import config
from gradeloom.functions.text import in_list, quoted, strip_sql, words_sql, fold_sql

_ASKING = [*config.QUESTION_WORDS, *config.COMMAND_WORDS]
_LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"


def with_findings(records: DataFrame, question: str = "question", answer: str = "answer", name: str = "rules") -> DataFrame:
    """records and a struct of the eight findings, the number of words and the penalty."""
    ignored = in_list([*config.FUNCTION_WORDS, *_ASKING])
    a, q = "__a", "__q"
    out = records.withColumns({q: F.expr(f"coalesce(`{question}`, '')"), a: F.expr(strip_sql(f"coalesce(`{answer}`, '')"))})
    out = out.withColumns({
        "__words": F.expr(words_sql(f"lower({a})")),
        "__folded": F.expr(words_sql(fold_sql(a))),
        "__asked": F.expr(words_sql(fold_sql(q))),
        "__chunks": F.expr(f"filter(transform(split({a}, '[.!?\\n]+', -1), c -> lower({strip_sql('c')})), c -> c <> '')"),
    })
    out = out.withColumns({
        "__n": F.expr("size(__words)"),
        "__own": F.expr(f"array_distinct(filter(__folded, w -> w NOT IN {ignored}))"),
        "__wanted": F.expr(f"array_distinct(filter(__asked, w -> w NOT IN {ignored}))"),
        # the most frequent word by runs of the sorted words: one pass, however long the text
        "__most": F.expr("aggregate(array_sort(__words), struct('' AS w, 0 AS n, 0 AS most), (s, w) -> struct(w AS w, IF(w = s.w, s.n + 1, 1) AS n, greatest(s.most, IF(w = s.w, s.n + 1, 1)) AS most), s -> s.most)"),
    })
    covered = "size(array_intersect(__wanted, __own)) / size(__wanted)"
    asking = f"({a} LIKE '%?' OR __folded[0] IN {in_list(_ASKING)})"
    findings = {
        "empty": f"{a} = ''",
        "extremely_short": f"{a} <> '' AND __n < 5",
        "question_repetition": f"""CASE WHEN size(__asked) = 0 OR size(__folded) = 0 THEN false
            WHEN __asked = __folded THEN true WHEN size(__wanted) = 0 THEN false
            ELSE ({asking} AND {covered} >= 0.65D) OR ({covered} >= 0.8D AND size(array_except(__own, __wanted)) = 0) END""",
        "excessive_repetition": "(size(__chunks) >= 3 AND (size(__chunks) - size(array_distinct(__chunks))) / size(__chunks) >= 0.4D) OR (__n >= 12 AND __most / __n >= 0.35D)",
        "placeholder": f"{a} RLIKE {quoted('(?i)^(?:' + '|'.join(config.PLACEHOLDERS) + ')[.!]?$')}",
        "unwanted_refusal": f"{a} RLIKE {quoted('(?i)' + chr(92) + 'b(?:' + '|'.join(config.REFUSALS) + ')' + chr(92) + 'b')}",
        "excessively_verbose": f"__n > 350 OR (__n > 160 AND size(__question_words) > 0 AND __n / size(__question_words) > 30)",
        "formatting_problem": rf"""{a} RLIKE '[!?]{{4,}}' OR {a} RLIKE '\\b[A-Z]{{5,}}(?:\\s+[A-Z]{{5,}}){{2,}}\\b' OR {a} RLIKE {quoted('[^' + _LINE_END + ']{501,}')}""",
    }
    out = out.withColumn("__question_words", F.expr(words_sql(q)))
    out = out.withColumns({f"__{k}": F.expr(f"coalesce({v}, false)") for k, v in findings.items()})
    penalty = " + ".join(f"IF(__{k}, {p}, 0)" for k, p in config.PENALTIES.items())
    struct = ", ".join(f"__{k} AS {k}" for k in findings)
    out = out.withColumn(name, F.expr(f"struct({struct}, __n AS word_count, CAST(least(100, {penalty}) AS DOUBLE) AS penalty)"))
    return out.drop(q, a, "__words", "__folded", "__asked", "__chunks", "__n", "__own", "__wanted", "__most", "__question_words", *(f"__{k}" for k in findings))
