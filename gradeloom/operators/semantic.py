"""Similarity scorers: each gives a column from 0 to 100 for two text columns.

Defined results: a text that is null or blank is similar to nothing, 0; scores are rounded to two
decimals, half to even.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from gradeloom.functions.text import let, quoted, round_half_even, strip


class Scorer(ABC):
    """Where another similarity plugs in."""

    @abstractmethod
    def similarity(self, left: str, right: str) -> Column:
        """The similarity of two text columns of one frame, by their names."""


class Jaccard(Scorer):
    """Shared words over all words, without case; the offline default."""

    def similarity(self, left: str, right: str) -> Column:
        def words(c: str) -> str:
            return f"array_distinct(regexp_extract_all(lower(coalesce({c}, '')), {quoted('[\\p{L}\\p{N}_]+')}, 0))"

        share = let("n", "size(array_union(u, v))", "IF(n = 0, 0D, 100D * size(array_intersect(u, v)) / n)")
        return round_half_even(F.expr(let("u", words(left), let("v", words(right), share))))


class Constant(Scorer):
    """The same value for all texts."""

    def __init__(self, value: float):
        self.value = float(value)

    def similarity(self, left: str, right: str) -> Column:
        return F.lit(self.value)


class Exact(Scorer):
    """One value for texts that agree without case and outer spaces, another for the rest."""

    def __init__(self, same: float = 100.0, other: float = 20.0):
        self.same, self.other = float(same), float(other)

    def similarity(self, left: str, right: str) -> Column:
        return F.when(F.lower(strip(F.col(left))) == F.lower(strip(F.col(right))), self.same).otherwise(self.other)


def cosine(a: Column | str, b: Column | str) -> Column:
    """100 times the product of two unit vectors, from 0 to 100."""
    product = F.aggregate(F.zip_with(F.col(a).cast("array<double>") if isinstance(a, str) else a.cast("array<double>"), F.col(b).cast("array<double>") if isinstance(b, str) else b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return round_half_even(F.least(F.lit(100.0), F.greatest(F.lit(0.0), product * 100)))


class Embedded(Scorer):
    """Cosine of unit vectors that lie in columns of the frame; vectors names the column of each text column."""

    def __init__(self, vectors: dict[str, str]):
        self.vectors = vectors

    def similarity(self, left: str, right: str) -> Column:
        blank = (F.coalesce(strip(F.col(left)), F.lit("")) == "") | (F.coalesce(strip(F.col(right)), F.lit("")) == "")
        return F.when(blank, 0.0).otherwise(F.coalesce(cosine(self.vectors[left], self.vectors[right]), F.lit(0.0)))


#: The models of this Python worker, by name.
_MODELS: dict[str, object] = {}


def _model(name: str, load: Callable[[], object]) -> object:
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


class Encoder(Scorer):
    """Cosine of what a model encodes, in Arrow batches; load makes the model once in each Python worker, under its name.

    The model has ``encode(texts, normalize_embeddings=True)``. Each distinct text of a batch is
    encoded once. Over large tables it is cheaper to encode each distinct text of the table once,
    join the vectors with ``with_vectors`` and score with ``Embedded``.
    """

    def __init__(self, load: Callable[[], object], name: str | None = None):
        self.load, self.name = load, name or f"{load.__module__}.{load.__qualname__}"

    def similarity(self, left: str, right: str) -> Column:
        load, name = self.load, self.name

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = _model(name, load)
            for a, b in batches:
                a, b = a.fillna(""), b.fillna("")
                texts = [t for t in pd.unique(pd.concat([a, b])) if t.strip()]
                vectors = dict(zip(texts, model.encode(texts, normalize_embeddings=True))) if texts else {}
                yield pd.Series([_between(vectors.get(x), vectors.get(y)) for x, y in zip(a, b)], dtype="float64")

        return score(F.col(left), F.col(right))


def _between(x, y) -> float:
    if x is None or y is None:
        return 0.0
    return round(float(max(0.0, min(100.0, sum(float(u) * float(v) for u, v in zip(x, y)) * 100))), 2)
