"""The share of repeated content within each document.

A word is repeated when it lies in a run of eight words that also began earlier in the document.
Where only documents of a least share are wanted, bounds that any such document keeps are tried
first: each rules documents out without finding their runs. What each bound costs and how many
documents it rules out is measured on a bounded sample, and the bounds are tried in the order of
documents ruled out per second; only what passes all of them has its runs found. The order
changes the time, never the result. One pass, no shuffle.

Defined results: null, empty and wordless texts have no words and a share of 0; texts are taken
whole; repeated rows each give their own result.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RUN = 8
#: Documents of the sample on which cost and selectivity are measured.
SAMPLE = 400

_WORD = re.compile(r"[^\W_]+")
#: Odd multipliers of the window hash, one for each place.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


class Words:
    """The words of some documents as numbers, with the first word of each document."""

    def __init__(self, texts: list[str | None]):
        numbers: dict[str, int] = {}
        flat: list[int] = []
        counts = []
        number = numbers.setdefault
        for t in texts:
            words = _WORD.findall(t.lower()) if t else ()
            counts.append(len(words))
            flat += [number(w, len(numbers)) for w in words]
        self.ids = np.array(flat, dtype=np.int64)
        self.counts = np.array(counts, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def of(self, keep: np.ndarray) -> Words:
        """The words of the documents where keep is true."""
        w = object.__new__(Words)
        w.counts = self.counts[keep]
        inside = keep[self.doc]
        w.ids = self.ids[inside]
        w.doc = np.repeat(np.arange(len(w.counts)), w.counts)
        w.starts = np.concatenate([[0], np.cumsum(w.counts)])
        return w


def _windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of n words inside one document."""
    if len(w.ids) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(w.doc[: len(w.ids) - n + 1] == w.doc[n - 1 :])
    mixed = (w.ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    h = w.doc[at].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + mixed[at + k] * _PLACE[k]
    return at, h


def _later(w: Words, n: int) -> np.ndarray:
    """Starts of the runs of n words that also began earlier in their document."""
    at, h = _windows(w, n)
    if not len(at):
        return at
    order = np.argsort(h, kind="stable")
    a, hs = at[order], h[order]
    same = hs[1:] == hs[:-1]
    # a hash is only a hint: the words themselves decide
    for k in range(n):
        same[same] = w.ids[a[1:][same] + k] == w.ids[a[:-1][same] + k]
    same[same] = w.doc[a[1:][same]] == w.doc[a[:-1][same]]
    return a[1:][same]


def repeated_words(w: Words, n: int = RUN) -> np.ndarray:
    """For each document, how many words lie in a run that began earlier."""
    marks = np.zeros(len(w.ids) + 1, np.int64)
    later = _later(w, n)
    np.add.at(marks, later, 1)
    np.add.at(marks, later + n, -1)
    inside = (np.cumsum(marks[:-1]) > 0).astype(np.int64)
    return np.bincount(w.doc, weights=inside, minlength=len(w.counts)).astype(np.int64)


def _enough_words(w: Words, least: float) -> np.ndarray:
    """Two different starts of a run need nine words."""
    return w.counts > RUN


def _pairs(n: int):
    def bound(w: Words, least: float) -> np.ndarray:
        """A repeated run repeats its runs of n words: the document cannot have many different ones.

        Of r repeated words at least r * (9 - n) / 8 start a run of n words inside repeated runs,
        and each of these began earlier too.
        """
        at, h = _windows(w, n)
        several = np.bincount(w.doc[at], minlength=len(w.counts))
        different = np.zeros(len(w.counts), np.int64)
        if len(at):
            doc = w.doc[at]
            order = np.lexsort((h, doc))
            d, hs = doc[order], h[order]
            first = np.concatenate([[True], (hs[1:] != hs[:-1]) | (d[1:] != d[:-1])])
            different = np.bincount(d[first], minlength=len(w.counts))
        return several - different >= np.floor(least * w.counts * (RUN + 1 - n) / RUN)

    bound.__name__ = f"different_runs_of_{n}"
    return bound


#: Bounds kept by every document whose share is at least the wanted one.
BOUNDS = {"enough_words": _enough_words, "different_words": _pairs(1), "different_pairs": _pairs(2), "different_fours": _pairs(4)}


def measured_order(texts: list[str | None], least: float) -> list[str]:
    """The bounds by documents ruled out per second, each measured on what those before it leave."""
    w = Words(texts)
    order: list[str] = []
    while len(order) < len(BOUNDS):
        rate, left = {}, {}
        for name in BOUNDS.keys() - set(order):
            began = time.perf_counter()
            left[name] = BOUNDS[name](w, least)
            rate[name] = int((~left[name]).sum()) / max(time.perf_counter() - began, 1e-7)
        best = max(sorted(rate), key=rate.get)
        order.append(best)
        w = w.of(left[best])
    return order


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text", least: float | None = None) -> DataFrame:
    """(key, n_words, n_repeated, share) of each document, or of those whose share is at least ``least``."""
    kept = documents.select(key, F.col(text).cast("string").alias("text"))
    order: list[str] = []
    if least is not None:
        # a bounded sample for cost and selectivity only; it does not change what is found
        order = measured_order([r[0] for r in kept.select("text").limit(SAMPLE).collect()], least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            w = Words(b.column(1).to_pylist())
            left = np.arange(len(w.counts))
            for name in order:
                if not len(left):
                    break
                passed = BOUNDS[name](w, least)
                w, left = w.of(passed), left[passed]
            n = repeated_words(w)
            share = n / np.maximum(w.counts, 1)
            if least is not None:
                ok = share >= least
                left, n, share, counts = left[ok], n[ok], share[ok], w.counts[ok]
            else:
                counts = w.counts
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(left)), pa.array(counts), pa.array(n), pa.array(share)], [key, "n_words", "n_repeated", "share"])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, n_words bigint, n_repeated bigint, share double")
