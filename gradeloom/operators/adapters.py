"""Joins around the evaluation: references by key, vectors by text, and two runs beside each other.

No side is broadcast by hint: Catalyst does so where a side is small by its statistics. Rows without a
partner stay, with nulls; a key of the smaller side that occurs twice is an error of the caller and
gives a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_references(records: DataFrame, references: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """records and columns of the references of the same key; columns that records has are replaced."""
    kept = records.drop(*(c for c in columns if c in records.columns and c != key))
    return kept.join(references.select(key, *columns), key, "left")


def text_key(text: str | Column) -> Column:
    """The key under which the vector of a text is stored."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def with_vectors(records: DataFrame, vectors: DataFrame, texts: dict[str, str], key: str = "text_key", vector: str = "embedding") -> DataFrame:
    """records and for each text column the vector of its text, so that each distinct text is encoded once."""
    out = records
    for text, name in texts.items():
        own = vectors.select(F.col(key).alias("__key"), F.col(vector).alias(name))
        out = out.join(own, text_key(text) == F.col("__key"), "left").drop("__key")
    return out


def compare_runs(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Both runs' columns by key, and whether they differ; keys of one run only count as differing."""
    a = old.select(key, *(F.col(c).alias(f"old_{c}") for c in columns))
    b = new.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return a.withColumn("__in_old", F.lit(True)).join(b.withColumn("__in_new", F.lit(True)), key, "full").withColumn("differs", differs | F.col("__in_old").isNull() | F.col("__in_new").isNull()).drop("__in_old", "__in_new")
