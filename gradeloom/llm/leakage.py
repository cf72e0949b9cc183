"""Held-out test items found in training documents, whole or in part.

The documents are indexed where they lie: each task keeps the positional postings of its own
documents for the words that occur in test items, and answers every test item from them, so that
the corpus is read once and never shuffled. Test items come in blocks of a bounded size, one scan
for each block.

A word counts where it lies in a passage: a window of PASSAGE words in which at least
PASSAGE_LEAST agree at one offset, the place in the document less the place in the item, be it an
exact phrase or one with changed words. The passages are put together in the item's order.

Items are sought from their rarest words, three quarters of their places or, for small shares, more.
Rarity is counted in each local index; it changes the time, never the result. First the merged
postings of these seeds tell the documents that hold enough of them at all; in these the
offset-adjusted lists are intersected: a passage shows at least PASSAGE_LEAST less the window's
other words among the seeds. What could reach the share by these counts, and it is only these
documents, is aligned with all its words. Both steps are bounds that a leaking document cannot
miss: they save work and never decide.

Letter case, punctuation, layout, markup and entities do not matter. Defined results: null, empty
and wordless texts leak nothing; very long documents are aligned in overlapping stretches; items
shorter than a passage must agree throughout the wanted share of their words in one stretch; copies of a
document and items with equal texts each give their own rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words of a passage window, and how many of them must agree.
PASSAGE, PASSAGE_LEAST = 16, 11
#: Share of an item's places, the rarest, that serve as seeds, at least.
SEEDS = 0.75
#: Share of the words of an item that make a leak.
LEAST_SHARE = 0.5
#: Characters of test items that one scan answers; more items take more scans.
BLOCK_CHARS = 32_000_000
#: Words that one local index holds at most, and words of a document aligned at once.
INDEX_WORDS, STRETCH = 4_000_000, 8192

#: A tag or a comment, however long: a name, then attributes up to the next bracket.
_MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text without case, punctuation and markup."""
    if not text:
        return []
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _UNSEEN.sub("", text)
    return _WORD.findall(text.lower())


class Items:
    """Test items as word numbers."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.numbers: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                self.words.append(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int32))


class Index:
    """Positional postings of some documents for the words of test items."""

    def __init__(self, documents: list[np.ndarray], n_words: int):
        self.documents = documents
        lengths = np.array([len(d) for d in documents], np.int64)
        flat = np.concatenate(documents) if documents else np.empty(0, np.int32)
        doc = np.repeat(np.arange(len(documents)), lengths)
        self.document = doc
        known = np.flatnonzero(flat >= 0)
        order = known[np.argsort(flat[known], kind="stable")]
        self.positions = order
        self.bounds = np.searchsorted(flat[order], np.arange(n_words + 1))
        # the documents of each word, each once
        pairs = np.unique(flat[known].astype(np.int64) * max(len(documents), 1) + doc[known])
        self.holder = (pairs % max(len(documents), 1)).astype(np.int64)
        self.holder_bounds = np.searchsorted(pairs // max(len(documents), 1), np.arange(n_words + 1))
        self.frequency = np.diff(self.holder_bounds)

    def holders(self, word: int) -> np.ndarray:
        return self.holder[self.holder_bounds[word] : self.holder_bounds[word + 1]]

    def candidates(self, item: np.ndarray, least_share: float = LEAST_SHARE) -> np.ndarray:
        """The documents whose seeds allow the share of the item's words in passages."""
        n = len(item)
        size, least = _window(n)
        wanted = int(np.ceil(least_share * n))
        # so many seeds that the wanted words cannot all be others
        places = np.sort(np.argsort(self.frequency[item], kind="stable")[: max(-int(-SEEDS * n // 1), n - wanted // 2)])
        need = max(1, wanted - (n - len(places)))
        words, times = np.unique(item[places], return_counts=True)
        lists = [self.holders(w) for w in words]
        held = np.bincount(np.concatenate(lists), weights=np.repeat(times, [len(x) for x in lists]), minlength=len(self.documents)) >= need
        if not held.any():
            return np.empty(0, np.int64)
        lists = [self.positions[self.bounds[w] : self.bounds[w + 1]] for w in item[places]]
        at, place = np.concatenate(lists), np.repeat(places, [len(x) for x in lists])
        inside = held[self.document[at]]
        at, place = at[inside], place[inside]
        line = (at - place + n) * np.int64(2 * n + 2 * size) + place
        line.sort()
        # how many places near each one are no seeds, at most, in any window over it
        seed = np.zeros(n + 2 * size, np.int64)
        seed[places + size] = 1
        seeds_until = np.concatenate([[0], np.cumsum(seed)])
        begins = np.arange(n + size)
        no_seeds = np.minimum(begins + size, n + size) - np.maximum(begins, size) - (seeds_until[begins + size] - seeds_until[begins])
        most = np.array([no_seeds[b + 1 : b + size + 1].max() for b in range(n)])
        place = line % (2 * n + 2 * size)
        last = np.searchsorted(line, line + size)
        full = last - np.arange(len(line)) >= np.maximum(1, least - most[place])
        marks = np.zeros(len(line) + 1, np.int64)
        np.add.at(marks, np.flatnonzero(full), 1)
        np.add.at(marks, last[full], -1)
        kept = np.cumsum(marks[:-1]) > 0
        at = line[kept] // (2 * n + 2 * size) - n + place[kept]
        return np.flatnonzero(np.bincount(self.document[at], minlength=len(self.documents)) >= need)


def _window(n: int) -> tuple[int, int]:
    """Words of a window of an item of n words, and how many of them must agree."""
    size = min(PASSAGE, n)
    return size, -(-size * PASSAGE_LEAST // PASSAGE)


def _in_passages(item: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the item, in the document) of the words that agree within passages."""
    n = len(item)
    size, least = _window(n)
    found_i, found_j = [], []
    for begin in range(0, len(doc), STRETCH):
        low, high = max(0, begin - PASSAGE), min(len(doc), begin + STRETCH + PASSAGE)
        i, j = np.nonzero(item[:, None] == doc[None, low:high])
        if not len(i):
            continue
        # along each offset: how many words agree in the windows around each agreeing word
        offset = j - i
        order = np.lexsort((i, offset))
        i, j, offset = i[order], j[order], offset[order]
        line = (offset + n).astype(np.int64) * (n + 4 * PASSAGE) + i
        inside = np.zeros(len(line), bool)
        # a window that begins at an agreeing word covers what follows it on its line
        last = np.searchsorted(line, line + size)
        full = last - np.arange(len(line)) >= least
        marks = np.zeros(len(line) + 1, np.int64)
        np.add.at(marks, np.flatnonzero(full), 1)
        np.add.at(marks, last[full], -1)
        inside = np.cumsum(marks[:-1]) > 0
        j = j + low
        own = inside & (j >= begin) & (j < begin + STRETCH)
        found_i.append(i[own])
        found_j.append(j[own])
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def matched_words(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """How many of the item's words the document holds in passages in the item's order, and the longest exact phrase."""
    i, j = _in_passages(item, doc)
    order = np.lexsort((-j, i))
    i, j = i[order], j[order]
    tails: list[int] = []
    for y in j.tolist():
        k = bisect_left(tails, y)
        if k == len(tails):
            tails.append(y)
        else:
            tails[k] = y
    longest = 0
    if len(i):
        order = np.lexsort((i, j - i))
        d, p = (j - i)[order], i[order]
        breaks = np.flatnonzero((np.diff(d) != 0) | (np.diff(p) != 1))
        longest = int(np.diff(np.concatenate([[-1], breaks, [len(p) - 1]])).max())
    return len(tails), longest


def _answer(keys: list, documents: list[np.ndarray], items: Items, least_share: float) -> Iterator[tuple]:
    index = Index(documents, len(items.numbers))
    for item_id, item in zip(items.ids, items.words):
        for d in index.candidates(item, least_share).tolist():
            n, phrase = matched_words(item, documents[d])
            if n >= least_share * len(item):
                yield item_id, keys[d], n, n / len(item), phrase


def _blocks(items: DataFrame, item_key: str, item_text: str, block_chars: int) -> list[DataFrame]:
    """The items in blocks of a bounded size; one block unless they are too large for that."""
    size = items.select(F.sum(F.length(item_text))).first()[0] or 0
    n = max(1, -(-size // block_chars))
    return [items.where(F.pmod(F.xxhash64(item_key), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def leaks(items: DataFrame, documents: DataFrame, item_key: str = "item_id", doc_key: str = "doc_id", item_text: str = "text", doc_text: str = "text", least_share: float = LEAST_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_key, doc_key, n_matched, share, longest_phrase) of each document that holds an item."""
    if not 0 < least_share <= 1:
        raise ValueError("a share of an item's words lies above 0 and at most at 1")
    documents = documents.select(F.col(doc_key).cast("bigint").alias(doc_key), F.col(doc_text).cast("string").alias("text"))
    names = [item_key, doc_key, "n_matched", "share", "longest_phrase"]
    result = None
    for block in _blocks(items.select(item_key, item_text), item_key, item_text, block_chars):
        sought = Items([tuple(r) for r in block.collect()])  # bounded by block_chars

        def run(batches: Iterator[pa.RecordBatch], sought: Items = sought) -> Iterator[pa.RecordBatch]:
            keys: list = []
            held: list[np.ndarray] = []
            size = 0

            def answered() -> pa.RecordBatch:
                rows = list(zip(*_answer(keys, held, sought, least_share))) or [[]] * 5
                return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.float64()), pa.array(rows[4], pa.int64())], names)

            number = sought.numbers.get
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                    words = words_of(text.as_py())
                    keys.append(key)
                    held.append(np.array([number(w, -1) for w in words], np.int32))
                    size += len(words)
                    if size >= INDEX_WORDS:
                        yield answered()
                        keys, held, size = [], [], 0
            if keys and sought.ids:
                yield answered()

        part = documents.mapInArrow(run, f"`{item_key}` bigint, `{doc_key}` bigint, n_matched bigint, share double, longest_phrase bigint")
        result = part if result is None else result.unionByName(part)
    return result
