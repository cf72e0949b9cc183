"""Texts cut off by a field limit or in transfer.

The length of every text is computed as characters, as UTF-8 bytes, as UTF-16 units, with escaped
entities, with JSON escapes and with line breaks of two characters, and counted by source. A
length at which texts without an end pile up and beyond which hardly any go is a storage limit of
that source in that form. Then the endings are inspected: a text without an end mark is cut when
it has a limit's length, when it ends in half a character, when its last word is the beginning of
a common word or of a name that the record spells out elsewhere, or when what it ends with is not
how sentences end. A text that the record has again as another text is whole.

How sentences end is an n-gram model of all records: for the last words, names and figures masked,
how often a sentence ended there. Which words are masked, the n-grams and the complete values are
counted over every row, nothing is sampled; the times that a word or value must occur are for
PER_ROWS records and grow with their number. Three scans: lengths, words, which are written as numbers
and counted from these, and endings. Copies of a cut text
that differ in formatting, such as an added full stop, are cut too: they are found by their folded
text, short ones by that and their folded question.

Defined results: null, blank and wordless texts are not cut (half a character at the end aside); a
bare word is cut only as the beginning of a name or word that its record spells out; a null source counts under none and is held against the limits of all sources; an empty table gives
an empty result; repeated rows each give their own row. A length below LEAST_LIMIT, or that fewer
than LEAST_TEXTS open texts have, is no limit: what was cut there is told by its ending alone.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.plain_text import CYRILLIC_STRICT, GREEK_STRICT
from gradeloom.sources.shared import checkpointed

#: Of so many records are the times that a word or value must occur; of more records they are more in proportion.
PER_ROWS = 12000
#: Below this chance of an end, a text without an end mark counts as cut: as a whole that may be a bare value, in its first sentence, and later.
LEAST_SHORT, LEAST_FIRST, LEAST_LATER = 0.15, 0.25, 0.3
#: Times that a word must occur to stand for itself, and beyond which the beginning of such a word is a word.
OWN_WORD, SEEN_WORD = 12, 2
#: A copy with an end mark of fewer words counts with the cut text it copies only where the question is the same too.
COPIED = 4
#: Parts into which copies of one text are spread when they are sought, so that a text of very many records is no hot key.
SALTS = 8
#: The shortest length that may be a limit, and how many open texts must have it.
LEAST_LIMIT, LEAST_TEXTS = 16, 5
#: Limits up to this number are sent to every executor (about 30 bytes each); more are joined by source.
MOST_SENT = 100_000
#: Words that the model looks back on.
ORDER = 4
#: A text of at most SHORT words that VALUE_TIMES different records have whole is a complete value.
SHORT, VALUE_TIMES = 6, 3
#: Marks before the first word of a text's first sentence and of later ones.
FIRST, LATER = "<<", "<"
#: What a run of capitalised words counts as.
NAME = "Name\x00"
#: The numbers of words and marks that stand for others; a word's own number is higher.
UNKNOWN, FIGURE, YEAR, OWN = 1, 2, 3, 6
PLACE = {FIRST: 4, LATER: 5}
#: Characters that are scanned at once, and distinct words that a task remembers.
SCANNED, REMEMBERED = 1 << 22, 1 << 18

_END_MARK = "[.!?。！？．]"
_CLOSING = "[\"'”’»)\\]}*_]"
#: A text with an end mark, other than marks of omission.
ENDED = f"{_END_MARK}{_CLOSING}*\\s*$"
OMITTED = f"(\\.\\.|…|\\x{{FFFD}}){_CLOSING}*\\s*$"

_TOKEN = re.compile(r"\d[\d.,]*|[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?。！？．]+[\"'”’»)\]]*(?=\s|$)")
#: What Scanned finds in arrays: the words, sentence ends and ends of texts joined by _TEXT_END; a figure stops where a sentence ends.
_SCAN = re.compile(rf"[^\W\d_]+|\d(?:(?!{_SENTENCE_END.pattern})[\d.,])*|{_SENTENCE_END.pattern}|\x00")
_TEXT_END = "\n\x00"
_YEAR = re.compile("1[5-9][0-9]{2}|20[0-9]{2}")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_OTHER_LETTERS = re.compile("[\u0370-\u052f]")
_LATIN = re.compile("[a-zA-Z]")
_TO_LATIN = str.maketrans(CYRILLIC_STRICT[0] + GREEK_STRICT[0], CYRILLIC_STRICT[1] + GREEK_STRICT[1])


def _readable(text: str) -> str:
    """text with plain widths and without invisible characters; words of two alphabets in Latin letters."""
    if text.isascii():
        return text
    text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    if not _OTHER_LETTERS.search(text) or not _LATIN.search(text):
        return text
    return re.sub(r"[^\W\d_]+", lambda m: m[0].translate(_TO_LATIN) if re.search("[a-zA-Z]", m[0]) else m[0], text)


def _words(sentence: str) -> list[str]:
    """The words and figures of a sentence, runs of capitalised words after the first one as one name."""
    words = _TOKEN.findall(sentence)
    upper = bytes([w[0].isupper() for w in words])
    capitals = upper.count(1)
    if capitals <= 0.6 * len(words) and b"\1\1" not in upper[1:] and sentence.isascii():
        return words  # nothing to join
    if len(words) > SHORT and capitals > 0.8 * len(words) or sum(w.isupper() for w in words) > 0.6 * len(words):
        return [w.lower() for w in words]
    whole = capitals == len(words)
    joined: list[str] = []
    for i, w in enumerate(words):
        if joined and w[0].isupper() and words[i - 1][0].isupper() and (i > 1 or whole):
            joined[-1] = NAME
        else:
            joined.append(w)
    return joined


def lengths(text: str) -> dict[str, Column]:
    """The length of a text in the forms in which a field may be stored."""

    def times(what: str) -> Column:
        return (F.length(text) - F.length(F.replace(F.col(text), F.lit(what)))) / len(what)

    chars = F.length(text)
    return {
        "characters": chars,
        "utf8": F.octet_length(text),
        "utf16": chars + F.when(F.octet_length(text) > chars, F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))).otherwise(0),
        "entities": F.when(F.col(text).rlike("[&<>\"']"), (chars + 4 * times("&") + 3 * times("<") + 3 * times(">") + 5 * times('"') + 4 * times("'")).cast("int")).otherwise(chars),
        "json": F.when(F.col(text).rlike('["\\\\\n\r\t]'), (chars + times('"') + times("\\") + times("\n") + times("\r") + times("\t")).cast("int")).otherwise(chars),
        "two_character_breaks": F.when(F.contains(F.col(text), F.lit("\n")), (chars + times("\n") - times("\r\n")).cast("int")).otherwise(chars),
    }


def _counted(records: DataFrame, source: str, text: str) -> DataFrame:
    """(source, form, length, n, n_open): how many texts have each length."""
    measured = records.where(F.length(F.trim(text)) > 0).select(F.coalesce(F.col(source), F.lit("")).alias("source"), has_no_end(text).alias("open"), *(c.alias(n) for n, c in lengths(text).items()))
    forms = list(lengths(text))
    long = measured.select("source", "open", F.expr(f"stack({len(forms)}, {', '.join(f"'{n}', {n}" for n in forms)}) AS (form, length)"))
    return long.groupBy("source", "form", "length").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"))


def _limits(counted: DataFrame) -> DataFrame:
    of = Window.partitionBy("source", "form").orderBy("length")
    near = of.rangeBetween(-8, 8)
    counted = counted.withColumns({
        "around": (F.sum("n_open").over(near) - F.col("n_open")) / 16,
        "n_beyond": F.coalesce(F.sum("n").over(of.rangeBetween(1, Window.unboundedFollowing)), F.lit(0)),
    })
    piled = (F.col("n_open") >= LEAST_TEXTS) & (F.col("n_open") >= 6 * (F.col("around") + 0.5)) & (F.col("n_beyond") <= F.col("n_open") * 0.1)
    return counted.where(piled & (F.col("length") >= LEAST_LIMIT)).select("source", "form", F.col("length").cast("bigint").alias("limit"), F.col("n_open").alias("n_at"), "n_beyond")


def storage_limits(records: DataFrame, source: str = "source", text: str = "answer") -> DataFrame:
    """(source, form, limit, n_at, n_beyond): the lengths at which a source's texts are cut."""
    return _limits(_counted(records, source, text))


#: What a character may be.
_LETTER, _DIGIT, _POINT, _MARK, _CLOSE, _SPACE, _OPEN, _ANGLED = (1 << i for i in range(8))


def _kind(ch: str) -> int:
    kind = _DIGIT if ch.isdecimal() else _LETTER if ch.isalnum() else _SPACE if ch.isspace() else 0
    return kind + _POINT * (ch in ".,") + _MARK * (ch in ".!?。！？．") + _CLOSE * (ch in "\"'”’»)]") + _OPEN * (ch in '"“') + _ANGLED * (ch == "«")


class _Kinds:
    """The kinds of characters, and powers of an odd number and of its inverse, made when they are needed."""

    def __init__(self):
        self.of, self.powers = None, np.empty((2, 0), np.uint64)

    def __call__(self, chars: np.ndarray) -> np.ndarray:
        if self.of is None:
            self.of = np.zeros(0x110000, np.uint8)
            self.of[:0x10000] = [_kind(chr(i)) for i in range(0x10000)]
        if len(chars) and chars.max() > 0xFFFF:
            for i in np.unique(chars[chars > 0xFFFF]).tolist():
                self.of[i] = _kind(chr(i))
        return self.of.take(chars)

    def up_to(self, n: int) -> np.ndarray:
        if self.powers.shape[1] < n:
            self.powers = np.stack([np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64))])
        return self.powers


_BASE = 0xD1B54A32D192ED03
_KINDS = _Kinds()


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin and end; the last place is in none."""
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edges = np.insert(edges, 0, 0)
    return edges[::2], edges[1::2]


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct code, and the number that each code then has."""
    bits = max(8, len(codes).bit_length())
    slots = ((codes * np.uint64(_ODD)) >> np.uint64(64 - bits)).astype(np.int64)
    first = np.zeros(1 << bits, np.int64)
    first[slots] = np.arange(len(codes))
    of = first[slots]
    # codes that lost their slot to another one
    lost = np.flatnonzero(codes[of] != codes)
    _, index, inverse = np.unique(codes[lost], return_index=True, return_inverse=True)
    of[lost] = lost[index][inverse]
    taken = np.zeros(len(codes), bool)
    taken[of] = True
    return np.flatnonzero(taken), (np.cumsum(taken) - 1)[of]


class Scanned:
    """The words of the texts of records in arrays, and the sentences that have words; names are joined as _words does.

    words are _SCAN's, by their number in strings, whose last one is NAME. sizes has the words of
    each sentence, texts the text in which it is, ended whether it is known to end there: by a
    mark, or because only the last text of a record may be cut.
    """

    def __init__(self, records: list[tuple]):
        self.n_records, self.columns = len(records), len(records[0])
        text = _TEXT_END.join([(t if t.isascii() else _readable(t)).replace("\0", "\1") if t else "" for r in records for t in r]) + _TEXT_END
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _KINDS(chars)
        # a run of marks is a sentence end where white space follows it and what closes quotes
        begins, after = _runs(kinds & _MARK > 0)
        closing, closed = _runs(kinds & _CLOSE > 0)
        ends = after.copy()
        if len(closing):
            at = np.minimum(np.searchsorted(closing, after), len(closing) - 1)
            ends = np.where(closing[at] == after, closed[at], after)
        real = kinds[ends] & _SPACE > 0
        begins, after, ends = begins[real], after[real], ends[real]
        # figures: digits and what stands between them, up to a sentence end
        figure = kinds & (_DIGIT | _POINT) > 0
        n = after - begins
        figure[np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())] = False
        from_, to = _runs(figure)
        digits = np.append(np.flatnonzero(kinds & _DIGIT), len(chars))
        from_ = digits[np.searchsorted(digits, from_)]
        from_, to = from_[from_ < to], to[from_ < to]
        starts, stops = _runs(kinds & _LETTER > 0)
        order = np.argsort(np.concatenate((starts, from_)), kind="stable")
        is_figure = order >= len(starts)
        starts, stops = np.concatenate((starts, from_))[order], np.concatenate((stops, to))[order]
        powers, inverse = _KINDS.up_to(len(chars))
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(chars * powers[: len(chars)], out=sums[1:])
        places, words = _numbered((sums[stops] - sums[starts]) * inverse[starts])
        self.words = words.astype(np.int32)
        self.strings = [text[x:y] for x, y in zip(starts[places].tolist(), stops[places].tolist())] + [NAME]
        # words that begin with a capital, and that have no other letters
        self.capital = np.array([s[0].isupper() for s in self.strings], bool)
        self.loud = np.array([s.isupper() for s in self.strings], bool)
        # _TOKEN's figures go on with the points of a sentence end
        dotted = np.flatnonzero(is_figure & (chars[stops] == ord(".")))
        self.dotted = dotted.astype(np.int32)
        self.points = [len(text[x : x + 64]) - len(text[x : x + 64].lstrip(".")) for x in stops[dotted].tolist()]
        breaks = np.flatnonzero(chars == 0)
        order = np.argsort(np.concatenate((begins, breaks)), kind="stable")
        is_text = order >= len(begins)
        n = np.diff(np.searchsorted(starts, np.concatenate((begins, breaks))[order]), prepend=0)
        ends = np.concatenate((ends, breaks))[order]
        kept = n > 0
        self.sizes = n[kept].astype(np.int32)
        self.texts = (np.cumsum(is_text) - is_text)[kept].astype(np.int32)
        self.marked = ~is_text[kept]
        self._look(text, chars, kinds, np.append(0, ends + is_text)[:-1][kept], ends[kept])

    def _look(self, text: str, chars: np.ndarray, kinds: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """What else is taken from the text, its characters and their kinds; begins and ends are those of its sentences."""

    @property
    def ended(self) -> np.ndarray:
        return self.marked | (self.texts % self.columns < self.columns - 1)

    def tokens(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in small letters as _TOKEN has them: the distinct ones, the number of each, and those of strings."""
        numbers: dict[str, int] = {}
        small = np.array([numbers.setdefault(s.lower(), len(numbers)) for s in self.strings], np.int32)
        of = small[self.words]
        words = self.words[self.dotted].tolist()
        of[self.dotted] = [numbers.setdefault(self.strings[w].lower() + "." * n, len(numbers)) for w, n in zip(words, self.points)]
        return list(numbers), of, small

    def joined(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of parts of these sizes, runs of capitalised words after the first one as one name, and the sizes then."""
        if not len(sizes):
            return self.words, sizes
        sizes = sizes.astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        capital, loud = self.capital[self.words], self.loud[self.words]
        capitals, loud = (np.add.reduceat(x.astype(np.int64), begins) for x in (capital, loud))
        apart = (sizes > SHORT) & (capitals > 0.8 * sizes) | (loud > 0.6 * sizes)
        place = np.arange(len(self.words)) - np.repeat(begins, sizes)
        # a word that goes on with the name before it
        on = capital.copy()
        on[1:] &= capital[:-1]
        on &= (place > 1) | (place == 1) & np.repeat(capitals == sizes, sizes)
        on &= np.repeat(~apart, sizes)
        words = self.words.copy()
        words[:-1][on[1:]] = len(self.strings) - 1
        return words[~on], np.add.reduceat((~on).astype(np.int64), begins)

    def said(self) -> np.ndarray:
        """How often the sentences have each string that was met."""
        return np.bincount(self.joined(self.sizes)[0], minlength=len(self.strings))

    def wholes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of the short texts that are whole, the size of each and its record."""
        begins = np.flatnonzero(np.diff(self.texts, prepend=-1))
        n_sentences = np.diff(begins, append=len(self.texts))
        sizes = np.add.reduceat(self.sizes.astype(np.int64), begins) if len(begins) else begins
        words, sizes = self.joined(sizes)
        whole = (sizes <= SHORT) & ((n_sentences == 1) | self.marked[begins + n_sentences - 1])
        return words[np.repeat(whole, sizes)], sizes[whole], self.texts[begins][whole] // self.columns


def packed(x: object) -> bytes:
    data = pickle.dumps(x, pickle.HIGHEST_PROTOCOL)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator:
    """The objects that the rows of a binary column are."""
    for b in batches:
        for row in b.column(0):
            data = row.as_buffer()
            yield pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"))


def _portions(records: Iterable[tuple]) -> Iterator[list[tuple]]:
    """The records in portions of about SCANNED characters."""
    some, size = [], 0
    for r in records:
        some.append(r)
        size += sum([len(t) for t in r if t.__class__ is str])
        if size >= SCANNED:
            yield some
            some, size = [], 0
    if some:
        yield some


_ODD, _BITS = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _joined(code: int, number: int) -> int:
    """The 64-bit code of a sequence and one more number."""
    code = ((code ^ number) * _ODD) & _BITS
    return code ^ (code >> 29)


def _joined_all(codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    codes = codes ^ numbers
    codes *= np.uint64(_ODD)
    codes ^= codes >> np.uint64(29)
    return codes


def _gram(code: int, k: int) -> int:
    """The code of an n-gram of k words, which tells k."""
    return code & (_BITS - 3) | (k - 1)


def _counted_grams(numbers: np.ndarray, place: np.ndarray, counts: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, times, times at an end) of the n-grams that end at each word that counts; place is a word's place in its sentence."""
    codes, ends = [], []
    code = np.zeros(len(numbers) + 1, np.uint64)
    for k in range(1, ORDER + 1):
        # the codes of the k - 1 words up to each place, and the word before them
        code = _joined_all(code[1:], numbers[: max(0, len(numbers) - k + 1)])
        at = np.flatnonzero(counts[k - 1 :] & (place[k - 1 :] >= k - 1))
        found = np.uint64(k - 1) | code[at] & np.uint64(_BITS - 3)
        codes.append(found)
        ends.append(found[final[k - 1 :][at]])
    distinct, times = np.unique(np.concatenate(codes), return_counts=True)
    ended, n_ended = np.unique(np.concatenate(ends), return_counts=True)
    at_end = np.zeros(len(distinct), np.int64)
    at_end[np.searchsorted(distinct, ended)] = n_ended
    return distinct, times, at_end


def scanned(records: DataFrame, scan: type[Scanned] = Scanned) -> DataFrame:
    """The records, scanned and written: a number for each first text, and the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for some in _portions(zip(*(c.to_pylist() for c in b.columns[1:]))):
                found = scan(some)
                found.asked = b.column(0).slice(at, len(some)).to_numpy()
                at += len(some)
                yield pa.RecordBatch.from_arrays([pa.array([packed(found)], pa.binary())], ["scanned"])

    return checkpointed(records.mapInArrow(run, "scanned binary"))


class Endings:
    """How often a sentence ends after given words, fitted on records of other texts and the text asked about.

    Every marked end counts, and of the other texts, which no limit cut, the last words too. Fitted
    on records at hand, or with counted() on all records of a table; both give the same.
    """

    def __init__(self, records: list[tuple]):
        scans = [Scanned(some) for some in _portions(records)]
        said: Counter[str] = Counter()
        for scan in scans:
            for word, n, _ in zip(*self._said(scan)):
                said[word] += n
        self._know(said, len(records))
        grams, asked = [], {}
        for scan in scans:
            counted, values, rows = self._masked(scan)
            grams.append(counted)
            for v, r in zip(values.tolist(), rows.tolist()):
                asked.setdefault(v, set()).add(records[r][0])
            records = records[scan.n_records :]
        codes, times, final = map(np.concatenate, zip(*grams)) if grams else np.empty((3, 0), np.uint64)
        distinct, where = np.unique(codes, return_inverse=True)
        self._keep(distinct, *(np.bincount(where, x, len(distinct)).astype(np.int64) for x in (times, final)))
        # short texts that several records have whole are values
        self.values = {v for v, a in asked.items() if len(a) >= VALUE_TIMES * self.scale}

    @classmethod
    def counted(cls, records: DataFrame, columns: list[str]) -> Endings:
        """The same of all records of a table, which are read once."""
        return cls.of(scanned(records.select(F.xxhash64(columns[0]).alias("asked"), *columns)))

    @classmethod
    def of(cls, scans: DataFrame) -> Endings:
        """The same of scanned records: tasks count, and the counts are added up by word and by n-gram."""
        model = cls.__new__(cls)

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for scan in unpacked(batches):
                word, n, all_ = cls._said(scan)
                yield pa.RecordBatch.from_arrays([pa.array([None, *word], pa.string()), pa.array([scan.n_records, *n], pa.int64()), pa.array([0, *all_], pa.int64())], ["word", "n", "all_"])

        said = scans.mapInArrow(words, "word string, n bigint, all_ bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("all_").alias("all_"))
        said = checkpointed(said.where(f"word IS NULL OR n > {SEEN_WORD} OR all_ > {SEEN_WORD}"))
        n_records = said.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
        least = SEEN_WORD * max(1.0, n_records / PER_ROWS)
        often = said.where(F.col("word").isNotNull() & ((F.col("n") > least) | (F.col("all_") > least))).toArrow()
        often = [often[c].to_pylist() for c in ("word", "n", "all_")]
        model._know({w: n for w, n, _ in zip(*often) if n > least}, n_records)
        #: how often words occur in all texts, names not joined
        model.all = {w: n for w, _, n in zip(*often) if n > least}

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for scan in unpacked(batches):
                (codes, times, final), values, rows = model._masked(scan)
                nothing, asked = pa.nulls(len(codes), pa.int64()), pa.array(scan.asked[rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(times), pa.array(final), nothing], ["code", "n", "final", "asked"])
                nothing = pa.nulls(len(values), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), nothing, nothing, asked], ["code", "n", "final", "asked"])

        found = scans.mapInArrow(grams, "code bigint, n bigint, final bigint, asked bigint").groupBy("code", "asked").agg(F.sum("n").alias("n"), F.sum("final").alias("final"))
        # what occurs once tells nothing that shorter contexts don't
        found = checkpointed(found.where("asked IS NOT NULL OR n > 1 OR code & 3 = 0"))
        kept = found.where("asked IS NULL").select("code", "n", "final").toArrow()
        model._keep(*(kept[c].to_numpy() for c in ("code", "n", "final")))
        often = found.where("asked IS NOT NULL").groupBy("code").count().where(F.col("count") >= VALUE_TIMES * model.scale)
        model.values = {v & _BITS for v in often.toArrow()["code"].to_pylist()}
        return model

    @staticmethod
    def _said(scan: Scanned) -> tuple[list[str], list[int], list[int]]:
        """The words in small letters, how often they occur in sentences, names joined, and how often in all."""
        strings, tokens, small = scan.tokens()
        n = np.bincount(small, scan.said(), len(strings)).astype(np.int64)
        return strings, n.tolist(), np.bincount(tokens, minlength=len(strings)).tolist()

    def _masked(self, scan: Scanned) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """The n-grams of the sentences, counted; the forms of the short whole texts, and the record of each."""
        numbers = np.array([self.mask(w) for w in scan.strings], np.uint64)
        words, sizes = scan.joined(scan.sizes)
        values, rows = self._values(scan, numbers)
        return self._grams(scan, numbers[words], sizes), values, rows

    def _know(self, words: dict[str, int], n_records: int) -> None:
        """Which words stand for themselves, and the beginnings of these that are no words; words are those beyond SEEN_WORD times."""
        self.n_records, self.scale = n_records, max(1.0, n_records / PER_ROWS)
        self.own = {w: i for i, w in enumerate(sorted(w for w, n in words.items() if n >= OWN_WORD * self.scale), OWN)}
        self.begun = {w[:n] for w in self.own for n in range(2, len(w))} - {w for w, n in words.items() if n > SEEN_WORD * self.scale}

    @staticmethod
    def _grams(scanned: Scanned, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of sentences: their codes, how often each occurs, and how often at an end."""
        first = np.diff(scanned.texts, prepend=-1) > 0
        numbers = np.insert(numbers, np.cumsum(sizes) - sizes, np.where(first, PLACE[FIRST], PLACE[LATER]).astype(np.uint64))
        sizes = sizes + 1
        after = np.cumsum(sizes)
        place = np.arange(len(numbers)) - np.repeat(after - sizes, sizes)
        counts, final = place > 0, np.zeros(len(numbers), bool)
        # where it is unknown whether the last word ends the sentence, that place tells nothing
        counts[after[~scanned.ended] - 1] = False
        final[after[scanned.ended] - 1] = True
        return _counted_grams(numbers, place, counts, final)

    @staticmethod
    def _values(scanned: Scanned, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """value() of the short whole texts, and the record of each."""
        words, sizes, rows = scanned.wholes()
        numbers = np.where(numbers == YEAR, np.uint64(FIGURE), numbers)[words]
        begins, codes = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.uint64)
        for i in range(SHORT):
            longer = sizes > i
            codes[longer] = _joined_all(codes[longer], numbers[begins[longer] + i])
        return codes, rows

    def _keep(self, codes: np.ndarray, times: np.ndarray, final: np.ndarray) -> None:
        """The n-grams in the order of their codes, without those that occur once."""
        codes = codes.view(np.uint64)
        which = np.flatnonzero((times > 1) | (codes & np.uint64(3) == 0))
        which = which[np.argsort(codes[which])]
        self.codes, self.times, self.final = (array(kind, x[which].tobytes()) for kind, x in (("Q", codes), ("q", times), ("q", final)))

    def mask(self, word: str) -> int:
        if word[0].isdigit():
            return YEAR if _YEAR.fullmatch(word) else FIGURE
        return self.own.get(word.lower(), UNKNOWN)

    def value(self, tokens: list[str]) -> int:
        """The form of a whole text: the code of its masked words, all figures alike."""
        code = 0
        for n in map(self.mask, tokens):
            code = _joined(code, FIGURE if n == YEAR else n)
        return code

    def chance(self, tokens: list[str], first: str) -> float:
        """The chance that a sentence ends after tokens; first says whether it is the text's first one."""
        if first == FIRST and self.value(tokens) in self.values:
            return 1.0
        p, code = 0.1, 0
        for k, number in enumerate([*map(self.mask, reversed(tokens[-ORDER:])), PLACE[first]][:ORDER], 1):
            code = _joined(code, number)
            at = bisect_left(self.codes, _gram(code, k))
            found = at < len(self.codes) and self.codes[at] == _gram(code, k)
            n, ends = (self.times[at], self.final[at]) if found else (0, 0)
            p = (ends + 2 * p) / (n + 2)
        return p

    def evidence(self, text: str, others: list[str | None]) -> tuple[str | None, float]:
        """What the end of a text without an end mark tells: a mark, or the chance of an end there as a multiple of the least one.

        "half": half a character; "whole": the record has the same text elsewhere; "begun": the
        last word begins a common one; "spelled": the record spells the last word further; "none":
        nothing to go by.
        """
        body = text.strip()
        if body.endswith("\ufffd"):
            return "half", 0.0
        if any(t and t.strip() == body for t in others):
            return "whole", 9.0
        body = _readable(body).rstrip(".… \"'”’»)]}*_;:,")
        last = max((m.end() for m in _SENTENCE_END.finditer(body)), default=0)
        tokens = _words(body[last:])
        if not tokens:
            return "none", 9.0
        word, bare = tokens[-1], len(tokens) < 2 and not last
        if word.lower() in self.begun and not bare:
            return "begun", 0.0
        ratio = 9.0
        if not bare:
            least = LEAST_LATER if last else LEAST_FIRST if len(tokens) > SHORT else LEAST_SHORT
            ratio = self.chance(tokens, LATER if last else FIRST) / least
        if ratio >= 1 and self.mask(word) == UNKNOWN and word != NAME and len(word) > (2 if bare else 1):
            spelled = {w for t in others if t for w in _TOKEN.findall(_readable(t))}
            if word not in spelled and any(len(w) > len(word) and w.startswith(word) for w in spelled):
                return "spelled", ratio
        return None, ratio

    def is_open(self, text: str, others: list[str | None]) -> bool:
        """Whether a text without an end mark stops before its end."""
        mark, ratio = self.evidence(text, others)
        return mark in ("half", "begun", "spelled") or (mark is None and ratio < 1)


class Limits:
    """The storage limits of every source, and how many texts were counted for them; one scan."""

    def __init__(self, records: DataFrame, source: str, text: str):
        counted = checkpointed(_counted(records, source, text))
        self.source, self.text = source, text
        self.n_texts = counted.where("form = 'characters'").agg(F.sum("n")).first()[0] or 0
        place = F.array_position(F.array(*map(F.lit, lengths(text))), F.col("form")).cast("int") - 1
        pair = F.struct(place.alias("form"), F.col("limit").cast("int").alias("limit"))
        limits = checkpointed(_limits(counted))
        every = limits.agg(F.collect_set(pair).alias("__limits")).select(F.lit(None).cast("string").alias("__of"), "__limits")
        by_source = limits.groupBy(F.col("source").alias("__of")).agg(F.collect_set(pair).alias("__limits")).unionByName(every)
        # a table of a checked size goes to every executor
        self.by_source = F.broadcast(by_source) if limits.limit(MOST_SENT + 1).count() <= MOST_SENT else by_source

    def marked(self, records: DataFrame, name: str = "__at_limit") -> DataFrame:
        """records and whether the text has no end and the length of a limit of its source; a null source has those of all."""
        measured = F.array(*(c.cast("int") for c in lengths(self.text).values()))
        # a character that would pass the limit of bytes is left out whole
        short_of = f"lens[l.form] = l.limit OR (l.form = 1 AND lens[1] > lens[0] AND lens[1] BETWEEN l.limit - 3 AND l.limit)"
        joined = records.withColumn("__open", has_no_end(self.text)).join(self.by_source, F.col(self.source).eqNullSafe(F.col("__of")), "left").withColumn("__lens", F.when(F.col("__open") & F.col("__limits").isNotNull(), measured))
        at = F.expr(f"coalesce(exists(__limits, l -> {short_of.replace('lens', '__lens')}), false)")
        return joined.withColumn(name, at).drop("__of", "__limits", "__lens")


def has_no_end(text: str) -> Column:
    """Whether a text has no end mark, or a mark of omission: ENDED and OMITTED, searched only where the last characters leave it open."""
    last = F.right(text, F.lit(1))
    told = F.when(last.isin(*".!?") & (F.right(text, F.lit(2)) != F.concat(last, last)), False).when(last.rlike("[\\p{L}\\p{N},;:]"), True)
    return told.otherwise(~F.col(text).rlike(ENDED) | F.col(text).rlike(OMITTED))


def with_copy_key(records: DataFrame, text: str, question: str) -> DataFrame:
    """records and two hashes, a and b, that tell copies of a text whatever their formatting."""

    def folded(c: str) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[\\s\\p{Z}\\p{P}\\p{C}]+", "")

    short = ~F.trim(text).rlike(f"^(?:[^\\s\\p{{Z}}]*+[\\s\\p{{Z}}]++){{{COPIED - 1}}}")
    own = records.withColumn("__own", F.concat(folded(text), F.when(short, F.concat(F.lit("\x01"), folded(question))).otherwise("")))
    return own.withColumns({"a": F.xxhash64("__own"), "b": F.hash("__own")}).drop("__own")


def ended_copies(inspected: DataFrame, key: str) -> DataFrame:
    """(key) of the texts with an end mark that are copies of cut ones; inspected has key, cut, ended, a and b."""
    salted = inspected.where("ended").withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).select(key, "a", "b", "salt")
    cut = inspected.where("cut").select("a", "b").distinct().select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(cut, ["a", "b", "salt"], "left_semi").select(key)


def cut_texts(records: DataFrame, key: str = "row_id", text: str = "answer", others: tuple[str, ...] = ("question", "expected_answer", "context"), source: str = "source") -> DataFrame:
    """(key) of each record whose text was cut; the first of others is the question."""
    records = records.select(key, text, *others, source)
    limits = Limits(records, source, text)
    model = Endings.counted(records, [*others, text])
    texts = limits.marked(records.where(F.length(F.trim(text)) > 0))
    # only texts without an end are read in Python
    asked = with_copy_key(texts, text, others[0]).select(F.col(key).cast("bigint").alias(key), "a", "b", "__open", "__at_limit", *(F.when(F.col("__open"), F.col(c)).alias(f"__{i}") for i, c in enumerate([text, *others])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            open_, at, texts, *spelled = (c.to_pylist() for c in b.columns[3:])
            cut = [o and (a or model.is_open(t, s)) for o, a, t, *s in zip(open_, at, texts, *spelled)]
            ended = [not o for o in open_]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cut, pa.bool_()), pa.array(ended, pa.bool_())], [key, "a", "b", "cut", "ended"])

    inspected = checkpointed(asked.mapInArrow(run, f"`{key}` bigint, a bigint, b int, cut boolean, ended boolean").where("cut OR ended"))
    return inspected.where("cut").select(key).unionByName(ended_copies(inspected, key))


def cut_shares(records: DataFrame, key: str = "row_id", text: str = "answer", source: str = "source", **options) -> DataFrame:
    """(source, n_texts, n_cut, share) by source."""
    # a repeated row has one key several times
    cut = cut_texts(records, key, text, source=source, **options).distinct().withColumn("cut", F.lit(True))
    marked = records.where(F.length(F.trim(text)) > 0).select(key, source).join(cut, key, "left")
    return marked.groupBy(source).agg(F.count("*").alias("n_texts"), F.count("cut").alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_texts"))
