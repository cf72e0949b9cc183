"""Defective question and answer pairs, each with its kind of defect.

An answer is cut into clauses, and a linear-chain conditional random field tags each clause as
answer, refusal, echo of the question, foreign or unfinished. The words that the tags cover
decide the pair's defect, and nothing else does: no clause at all is an empty answer, an
unfinished last clause a cut one.

The field is fitted here, on all records; equal sequences of clauses are learned as one with their
number as weight, which is the same fit. The clauses are labelled by cues: refusal formulas, the question's words in sequence, words that belong to another
language's records, and the ending rule of the truncation operator. Each answer is learned
twice, once without its cues, so that the field tags from what else shows a defect: the words of
a clause, how much it shares with the question and the record, which everyday words it has, the
length limit of its field, how likely a sentence ends as it does, and the clauses beside it. Which
language a word belongs to is counted on all records by the languages of the questions. The times that
a word must occur are for PER_ROWS records and grow with their number.

Copies of a cut answer that differ in formatting are cut too; they are found by their folded text,
as in the truncation operator. Two scans: lengths, and the words of all texts, which are written as
numbers; n-grams, words by language and clauses are taken from these, and fit and tags read the described
clauses, which are written once too. Defined results: null,
blank and wordless answers and those that only stand for no answer have no clause and are
``empty``; a null question has no language and is never echoed; an empty table gives an empty
result; repeated rows each give their own row; a pair has at most one defect, the first of empty,
truncated, refusal, copies_question and other_language.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.truncation import _ANGLED, _OPEN, _TOKEN, REMEMBERED, Endings, Limits, Scanned, _joined_all, _numbered, _portions, _readable, ended_copies, packed, scanned, unpacked, with_copy_key
from gradeloom.sources.shared import checkpointed

#: The signs that label clauses and that the field also learns to do without: foreign words, one or more, the question in sequence, a refusal formula.
FOREIGN_MANY, FOREIGN_ONE, ECHOED, FORMULA = 13, 14, 16, 24
CUES = frozenset((FOREIGN_MANY, FOREIGN_ONE, ECHOED, FORMULA))
#: The signs of a last clause without an end mark: at a limit, its marks, and steps of the chance of an end there.
AT_LIMIT, MARKS, CHANCE = 26, {"half": 27, "begun": 28, "spelled": 29, "whole": 30, "none": 31}, 32
CHANCE_STEPS = (0.15, 0.3, 0.6, 1.0, 1.6, 3.0)
#: The signs of everyday words of the question's language only, and of another one's; of words that the question has not, none to three and more; of all its words.
EVERYDAY_OWN, EVERYDAY_OTHER, NEW_WORDS, ALL_ASKED = 40, 41, 42, 46
#: The sign of a text that stops within something, and how many signs there are.
STOPPED, N_SIGNS = 47, 48
#: The signs of a clause that shares little with its question and expected answer, and of one in the first person outside quotes.
UNGROUNDED, FIRST_PERSON = 9, 23
#: Signs that hold for clauses of any kind and are kept from outweighing the others.
SOFT = frozenset((17, 21, 22, FIRST_PERSON))
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)

#: Of so many records are the times that a feature must occur; of more records they are more in proportion. The longest answer, in clauses, that is learned.
PER_ROWS, LONGEST = 6000, 12
#: Bytes of sequences up to which the driver fits the field, beyond which the executors do; sequences whose gradient is computed at once.
FIT_HERE, BLOCK = 100_000_000, 100_000
#: Rounds in which features that stand together are merged, in parts of at least so many lists; lists in which pairs are looked for, and up to which distance.
MERGES, LEAST_MERGED, LOOKED_AT, LOOKED_ON = 6, 1000, 8_000, 24
#: Times that a word or pair of words must occur to be a feature.
FEATURE_TIMES = 8
#: Records of a language that must have a word, and how much more often than others, for the word to belong to it.
LANGUAGE_RECORDS, LANGUAGE_TIMES = 3, 8.0
#: Rounds of the fit (after 100 it still moves answers of rare forms), and its penalty on what the signs, the sign of a refusal formula and the words of a clause
#: say. The formula is held back so that the words of refusals are learned beside it.
ROUNDS, SIGN_PENALTY, SOFT_PENALTY, FORMULA_PENALTY, WORD_PENALTY = 200, 1e-6, 1e-3, 1e-5, 3e-3
#: Words of the longest text that stands for no answer.
FILLER_WORDS = 4

#: Texts that stand for no answer, without punctuation.
FILLERS = frozenset(
    "|na|n a|null|nil|none|nan|blank|empty|no answer|not available|not applicable|todo|to do|tbd|tba|unknown|placeholder|idk|xxx|undefined|"
    "keine antwort|k a|leer|sans réponse|vide|sin respuesta|vacío|нет ответа|пусто".split("|")
)
#: Everyday words of each language.
EVERYDAY = {
    "en": "the what which who when where how is was are does did of to for in at by name give expand must at a an it",
    "de": "der die das wie von und ist wo was wer welches welcher muss man um zu in des einen eine woraus lange schwer",
    "fr": "le la les du de des quelle quel où est un une pour que faut combien dans en qui",
    "es": "el la los las del de qué cuál dónde es está un una para hay que cuánto desde en se",
    "ru": "в на и что как где какой каком какого из чего нужно чтобы кто когда сколько",
}
#: What the languages are called in them.
LANGUAGE_NAMES = {
    "en": "english englisch englische englischen anglais inglés английский английском",
    "de": "german deutsch deutsche deutschen allemand alemán немецкий немецком",
    "fr": "french französisch französische französischen français francés французский французском",
    "es": "spanish spanisch spanische spanischen espagnol español испанский испанском",
    "ru": "russian russisch russische russischen russe ruso русский русском",
}
#: Formulas of declining to answer.
REFUSALS = re.compile(
    r"\b(?:(?:i|we)(?: am|'m|’m| are|'re|’re)? ?(?:sorry|(?:unable|not able) to (?:help|answer|assist|say|provide|respond|share|discuss))|(?:i|we) (?:cannot|can't|can’t|can not|could not|won't|won’t|will not|must decline|have to (?:pass|decline)|do not share|don't share|refuse to)"
    r"|(?:i'd|i’d|i would|we'd) rather not|must decline to|as an (?:ai|assistant)|not (?:be )?appropriate for (?:me|us)|no (?:response|answer) can be given|not allowed to (?:answer|say|share)|outside (?:of )?what i can"
    r"|kann ich (?:leider )?(?:nicht|keine)|ich kann (?:leider )?(?:nicht|keine|dazu)|möchte ich (?:nicht|keine)|ich darf (?:\w+ ){0,5}nicht (?:beantworten|sagen)|ich darf keine|tut mir leid"
    r"|je ne (?:peux|puis|souhaite) pas|je préfère ne pas|je suis désolé|je regrette|pas en mesure de|m'est impossible de|m’est impossible de"
    r"|no puedo|prefiero no|lo siento|no me (?:es posible|está permitido)|no estoy autorizado"
    r"|не могу|не получится|не в состоянии|предпочитаю не|извините|к сожалению)\b",
    re.IGNORECASE,
)
#: Of every refusal formula one of these words is a part: clauses without them need no search.
_HINTS = frozenset(
    "sorry unable able cannot can could won will decline pass share refuse rather ai assistant appropriate given allowed outside kann möchte darf leid "
    "peux puis souhaite préfère désolé regrette mesure impossible puedo prefiero siento posible permitido autorizado могу получится состоянии предпочитаю извините сожалению".split()
)
_QUOTED = re.compile("[\"“«][^\"“”«»]*[\"”»]")
_SELF = frozenset("i we me us my ich mir wir je nous moi yo me мне я мы puedo prefiero".split())


LANGUAGES = list(EVERYDAY)
_PLACE = {lang: j for j, lang in enumerate(LANGUAGES)}
#: The question, expected answer, context and answer of a record are its texts, in this order.
QUESTION, EXPECTED, CONTEXT, TEXT = range(4)


def _contains(words: list[str], part: list[str]) -> bool:
    """Whether part stands in words as one sequence."""
    n = len(part)
    return any(words[i : i + n] == part for i in range(len(words) - n + 1)) if 0 < n <= len(words) else False


def _within(some: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of some are among of, which are in order."""
    if not len(of):
        return np.zeros(len(some), bool)
    return of[np.minimum(np.searchsorted(of, some), len(of) - 1)] == some


def _marked(strings: list[str], words: dict[str, str]) -> np.ndarray:
    """Which strings are among the words of each language."""
    numbers, out = {s: i for i, s in enumerate(strings)}, np.zeros((len(strings), len(LANGUAGES)), bool)
    for j, lang in enumerate(LANGUAGES):
        out[[numbers[w] for w in words[lang].split() if w in numbers], j] = True
    return out


class Clauses(Scanned):
    """Scanned records and which sentences are clauses of answers; of clauses, what their words don't show."""

    def __init__(self, records: list[tuple], refusals: re.Pattern = REFUSALS):
        self.refusals = refusals
        super().__init__(records)
        del self.refusals

    def _look(self, text: str, chars: np.ndarray, kinds: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        clause = self.texts % self.columns == TEXT
        begins, ends = begins[clause], ends[clause]
        self.quote, quoted = (np.searchsorted(at, ends) > np.searchsorted(at, begins) for at in (np.flatnonzero(kinds & kind) for kind in (_OPEN, _OPEN | _ANGLED)))
        self.asks = chars[ends - 1] == ord("?")
        strings, tokens, _ = self.tokens()
        tokens = tokens[np.repeat(clause, self.sizes)]
        of = np.repeat(np.arange(len(begins)), self.sizes[clause])
        self.first_person, hinted = (np.bincount(of, np.array([x in words for x in strings], bool)[tokens], len(begins)) > 0 for words in (_SELF, _HINTS))
        self.formula = np.zeros(len(begins), bool)
        for i in np.flatnonzero(self.first_person & quoted | hinted).tolist():
            own_words = text[begins[i] : ends[i]].strip()
            if quoted[i]:
                own_words = _QUOTED.sub(" ", own_words)
                self.first_person[i] &= not _SELF.isdisjoint(_TOKEN.findall(own_words.lower()))
            self.formula[i] = hinted[i] and self.refusals.search(own_words) is not None

    def note(self, open_: list[bool | None], at: list[bool], records: list[tuple]) -> None:
        """Keeps which answers have no content, and those without an end with their records."""
        n_words = np.bincount(self.texts, self.sizes, self.n_records * self.columns)[TEXT :: self.columns]
        self.filler, self.at = n_words <= FILLER_WORDS, np.array(at, bool)
        for i in np.flatnonzero(self.filler).tolist():
            self.filler[i] = is_filler(records[i][TEXT])
        self.open = np.flatnonzero([bool(x) for x in open_] & ~self.filler)
        self.open_texts = [records[i] for i in self.open.tolist()]

    def keys(self, strings: list[str], tokens: np.ndarray, columns: tuple[int, ...]) -> np.ndarray:
        """The distinct words of each record in these columns, as record * len(strings) + word, in order."""
        text = np.repeat(self.texts, self.sizes)
        some = np.isin(text % self.columns, columns)
        return _distinct(text[some].astype(np.int64) // self.columns * len(strings) + tokens[some])

    def languages(self, strings: list[str], asked: np.ndarray) -> np.ndarray:
        """The language of each question by its everyday words; -1 where two agree equally."""
        k, records, words = len(LANGUAGES), asked // len(strings), _marked(strings, EVERYDAY)[asked % len(strings)]
        votes = np.stack([np.bincount(records[words[:, j]], minlength=self.n_records) for j in range(k)], 1)
        best = np.sort(votes, 1)
        return np.where(best[:, -1] > best[:, -2], votes.argmax(1), -1)

    def by_language(self, candidates: dict[str, int]) -> pa.RecordBatch:
        """(asked, lang, words) of each record whose question has a language: the numbers of the candidates that it has."""
        strings, tokens, _ = self.tokens()
        lang = self.languages(strings, self.keys(strings, tokens, (QUESTION,)))
        numbers = np.array([candidates.get(x, -1) for x in strings], np.int32)
        text, words = np.repeat(self.texts, self.sizes), numbers[tokens]
        kept = (words >= 0) & (text % self.columns != TEXT)
        records = text[kept].astype(np.int64) // self.columns
        kept, records = words[kept][lang[records] >= 0], records[lang[records] >= 0]
        keys, n_words = _distinct(records * len(candidates) + kept), max(1, len(candidates))
        which = np.flatnonzero(lang >= 0)
        n, words = np.bincount(keys // n_words, minlength=self.n_records)[which], (keys % n_words).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(np.append(0, 4 * np.cumsum(n)).astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(self.asked[which], pa.int64()), pa.array(lang[which], pa.int32()), found], ["asked", "lang", "words"])


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) > 0]


def _words_by_language(batches: Iterable[pa.RecordBatch], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """How many questions of each language have a word among their records, and the records of each language; batches come in the order of asked."""
    having, size = np.zeros(len(LANGUAGES) * n_words, np.int64), np.zeros(len(LANGUAGES), np.int64)
    last, seen = None, np.empty(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        asked, lang, words = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
        size += np.bincount(lang, minlength=len(size))
        question = np.cumsum(np.append(0, np.diff(asked) != 0))
        keys = _distinct(np.repeat(question, [len(w) // 4 for w in words]) * n_words + np.frombuffer(b"".join(words), np.int32))
        if asked[0] != last:
            seen = np.empty(0, np.int64)
        keys = keys[~_within(keys, seen)]
        having += np.bincount(lang[np.flatnonzero(np.diff(question, prepend=-1))][keys // n_words] * n_words + keys % n_words, minlength=len(having))
        # the words of the last question, which may go on in the next batch
        own = keys[keys // n_words == question[-1]] % n_words
        seen = np.union1d(seen, own) if question[-1] == 0 else own
        last = asked[-1]
    return having.reshape(len(LANGUAGES), n_words), size


def _candidates(times: dict[str, int], scale: float) -> list[str]:
    """The words that may belong to a language; times says how often each occurs in all texts."""
    return sorted(w for w, n in times.items() if n >= LANGUAGE_RECORDS * scale and len(w) > 1 and not w[0].isdigit())


def _belonging(words: list[str], having: np.ndarray, size: np.ndarray, scale: float) -> dict[str, str]:
    """The language to which a word belongs, of the words that belong to one."""
    belongs = {}
    for w, by in zip(words, having.T.tolist()):
        rates = sorted(((n / size[j], LANGUAGES[j], n) for j, n in enumerate(by) if n), reverse=True)
        if rates and rates[0][2] >= LANGUAGE_RECORDS * scale and (len(rates) == 1 or rates[0][0] >= LANGUAGE_TIMES * rates[1][0]):
            belongs[w] = rates[0][1]
    return belongs


def _language_words(scans: DataFrame, times: dict[str, int], scale: float) -> dict[str, str]:
    """The words of scanned records that belong to a language: the records by question, each word of a question's records counted once."""
    words = _candidates(times, scale)
    numbers = {w: i for i, w in enumerate(words)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (scan.by_language(numbers) for scan in unpacked(batches))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having, size = _words_by_language(batches, len(words))
        lang, word = np.nonzero(having)
        n, nothing = having[lang, word], np.full(len(size), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(x, y), pa.int64()) for x, y in ((word, nothing), (lang, np.arange(len(size))), (n, size))], ["word", "lang", "n"])

    asked = scans.mapInArrow(find, "asked bigint, lang int, words binary").repartition("asked").sortWithinPartitions("asked")
    found = asked.mapInArrow(count, "word bigint, lang bigint, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n")).toArrow()
    word, lang, n = (found[c].to_numpy() for c in ("word", "lang", "n"))
    having, size = np.zeros((len(LANGUAGES), len(words)), np.int64), np.zeros(len(LANGUAGES), np.int64)
    having[lang[word >= 0], word[word >= 0]] = n[word >= 0]
    size[lang[word < 0]] = n[word < 0]
    return _belonging(words, having, size, scale)


def language_words(records: DataFrame, question: str, expected: str, context: str, scale: float) -> dict[str, str]:
    """The words of a table that belong to a language."""
    scans = scanned(records.select(F.xxhash64(question).alias("asked"), question, expected, context, F.lit(None).cast("string").alias("none")), Clauses)
    return _language_words(scans, Endings.of(scans).all, scale)


def _features(codes: np.ndarray, times: np.ndarray, scale: float) -> np.ndarray:
    """The codes of the features in order: of the signs that occur, and of the terms that occur often enough."""
    return np.sort(codes[(times > 0) & ((codes < 1 << 63) | (times >= FEATURE_TIMES * scale))])


class Codes(dict):
    """The 64-bit codes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = code = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1 << 63
        return code


class Described:
    """The described clauses of records in arrays: their terms, words and labels, and which records are learned.

    signs says which signs each clause has; owners and codes are the clause and the code of its other terms.
    """

    def __init__(self, lengths: np.ndarray, n_words: np.ndarray, signs: np.ndarray, cut: np.ndarray, owners: list[np.ndarray], codes: list[np.ndarray]):
        self.lengths, self.n_words = lengths, n_words
        clause, sign = np.nonzero(signs)
        owners, codes = np.concatenate([clause, *owners]), np.concatenate([sign.astype(np.uint64), *codes])
        order = np.argsort(owners, kind="stable")
        places, terms = _numbered(codes[order])
        self.sizes, self.codes, self.terms = np.bincount(owners, minlength=len(n_words)), codes[order][places], terms.astype(np.int32)
        record = np.repeat(np.arange(len(lengths)), lengths)
        self.labels = self._cues(signs, cut, record)
        # no cue, nothing of the record, and it speaks of itself: it may be a refusal that no cue names
        begins = np.flatnonzero(np.diff(record, prepend=-1))
        itself = np.zeros(len(lengths), bool)
        itself[record[begins]] = ((self.labels == ANSWER) & signs[:, UNGROUNDED] & signs[:, FIRST_PERSON])[begins]
        self.learned = (lengths > 0) & (lengths <= LONGEST) & ~itself

    @staticmethod
    def _cues(signs: np.ndarray, cut: np.ndarray, record: np.ndarray) -> np.ndarray:
        """Labels by cues alone."""
        foreign = signs[:, FOREIGN_MANY] | signs[:, FOREIGN_ONE]
        labels = np.select([cut, signs[:, ECHOED], signs[:, FORMULA], foreign], [UNFINISHED, ECHO, REFUSAL, FOREIGN], ANSWER).astype(np.int32)
        # what follows a refusal and says nothing of the record belongs to it
        follows = np.append(False, record[1:] == record[:-1])[: len(record)] & signs[:, UNGROUNDED] & ((labels == ANSWER) | (labels == FOREIGN))
        at = np.flatnonzero(labels == REFUSAL) + 1
        while len(at := at[at < len(labels)]) and len(at := at[follows[at] & (labels[at] != REFUSAL)]):
            labels[at] = REFUSAL
            at = at + 1
        return labels

    def times(self) -> tuple[np.ndarray, np.ndarray]:
        """(code, clauses that have it) of the terms of the records that are learned."""
        learned = np.repeat(np.repeat(self.learned, self.lengths), self.sizes)
        n = max(1, len(self.codes))
        each = _distinct(np.repeat(np.arange(len(self.sizes)), self.sizes)[learned] * n + self.terms[learned]) % n
        return self.codes, np.bincount(each, minlength=len(self.codes))

    def rows(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all clauses, in any order within a clause, and how many each clause has; features are their codes in order."""
        at = np.searchsorted(features, self.codes)
        known = at < len(features)
        known[known] = features[at[known]] == self.codes[known]
        flat, clause = at[self.terms], np.repeat(np.arange(len(self.sizes)), self.sizes)
        kept = known[self.terms]
        flat, clause = flat[kept], clause[kept]
        return flat.astype(np.int32), np.bincount(clause, minlength=len(self.sizes))

    def lessons(self, features: np.ndarray) -> Iterator[tuple[bytes, float]]:
        """What is learned of each record and its weight: clauses, features of each, labels and features.

        An answer with cues is learned with and without them; one without cues is the same both times.
        """
        cue = np.isin(features, np.array(sorted(CUES), np.uint64))
        flat, sizes = self.rows(features)
        clause = np.repeat(np.arange(len(sizes)), sizes)
        flat = (np.sort(clause * (len(features) + 1) + flat) - clause * (len(features) + 1)).astype(np.int32)
        bare = ~cue[flat]
        without, n_without = flat[bare], np.bincount(clause[bare], minlength=len(sizes))
        ends = np.cumsum(self.lengths)
        labels, parts = self.labels.tobytes(), []
        for f, n in ((flat, sizes), (without, n_without)):
            parts.append((f.tobytes(), n.astype(np.int32).tobytes(), np.append(0, np.cumsum(n)).tolist()))
        for end, length, learned in zip(ends.tolist(), self.lengths.tolist(), self.learned.tolist()):
            if learned:
                begin, out = end - length, []
                for f, n, to in parts:
                    out.append(b"".join((length.to_bytes(4, "little"), n[4 * begin : 4 * end], labels[4 * begin : 4 * end], f[4 * to[begin] : 4 * to[end]])))
                if out[0] == out[1]:
                    yield out[0], 2.0
                else:
                    yield out[0], 1.0
                    yield out[1], 1.0


def _merged(flat: np.ndarray, owner: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """flat and owner with two features that stand together often as one more feature, again and again, and which these are.

    What is added up over the features is the same, of fewer summands.
    """
    joined = []
    for _ in range(MERGES):
        # features of neighbouring places in some of the lists, that stand together
        some = owner < LOOKED_AT
        f, o = flat[some], owner[some]
        pairs = [np.minimum(f[d:], f[:-d])[o[d:] == o[:-d]] * n_features + np.maximum(f[d:], f[:-d])[o[d:] == o[:-d]] for d in range(1, LOOKED_ON)]
        keys, times = np.unique(np.concatenate(pairs), return_counts=True)
        order = np.argsort(-times, kind="stable")[: 20 * n_features]
        place, n = np.full(n_features, -1), 0
        for x, y in zip(*(k.tolist() for k in np.divmod(keys[order[times[order] >= 4]], n_features))):
            if x != y and place[x] < 0 and place[y] < 0:
                place[x], place[y], n = 2 * n, 2 * n + 1, n + 1
        if not n:
            break
        rest = place < 0
        place[rest] = np.arange(2 * n, n_features)
        at = np.argsort(place)
        joined.append((at[0 : 2 * n : 2], at[1 : 2 * n : 2]))
        order = np.argsort(owner * n_features + place[flat])
        flat, owner = flat[order], owner[order]
        both = np.flatnonzero((place[flat[:-1]] < 2 * n) & (place[flat[:-1]] % 2 == 0) & (place[flat[1:]] == place[flat[:-1]] + 1) & (owner[1:] == owner[:-1]))
        flat = flat.copy()
        flat[both] = n_features + place[flat[both]] // 2
        kept = np.ones(len(flat), bool)
        kept[both + 1] = False
        flat, owner, n_features = flat[kept], owner[kept], n_features + n
    return flat, owner, joined


class _Part:
    """The features in a part of each clause, from begins to ends in data; equal parts are one."""

    def __init__(self, data: bytes, begins: np.ndarray, ends: np.ndarray, n_features: int):
        numbers: dict[bytes, int] = {}
        self.clause = np.array([numbers.setdefault(data[4 * x : 4 * y], len(numbers)) for x, y in zip(begins.tolist(), ends.tolist())], np.int64)
        self.n, self.joined = len(numbers), []
        self.flat, self.owner = np.frombuffer(b"".join(numbers), np.int32).astype(np.int64), np.repeat(np.arange(self.n), [len(x) // 4 for x in numbers])
        if self.n >= LEAST_MERGED:
            self.flat, self.owner, self.joined = _merged(self.flat, self.owner, n_features)

    def scores(self, emit: np.ndarray) -> np.ndarray:
        """The score under each tag of each clause's part; emit has a row for each tag."""
        out = []
        for e in emit:
            for x, y in self.joined:
                e = np.append(e, e[x] + e[y])
            out.append(np.bincount(self.owner, e.take(self.flat), self.n).take(self.clause))
        return np.stack(out)

    def spread(self, off: np.ndarray, n_features: int) -> np.ndarray:
        """What is off in the clauses under each tag, added up by feature."""
        out, n_all = [], n_features + sum(len(x) for x, _ in self.joined)
        for o in off:
            g = np.bincount(self.flat, np.bincount(self.clause, o, self.n).take(self.owner), n_all)
            for x, y in reversed(self.joined):
                g, more = g[: -len(x)], g[-len(x) :]
                g[x] += more
                g[y] += more
            out.append(g)
        return np.stack(out)


class Block:
    """Some lessons of one length with their weights, and the gradient of their likelihood."""

    def __init__(self, lessons: list[bytes], weights: list[float], features: np.ndarray):
        lessons = [np.frombuffer(x, np.int32) for x in lessons]
        self.weights, self.length = np.array(weights), int(lessons[0][0])
        sizes = np.stack([x[1 : 1 + self.length] for x in lessons]).astype(np.int64)
        # by place: the first clauses of all lessons, then the second ones
        said = (np.stack([x[1 + self.length : 1 + 2 * self.length] for x in lessons]).T == np.arange(len(TAGS))[:, None, None]) * self.weights
        flat = np.concatenate([x[1 + 2 * self.length :] for x in lessons])
        # a clause's signs come first in its features; equal signs and equal words of clauses are scored once
        to = np.append(0, np.cumsum(sizes))
        middle = to[:-1] + np.diff(np.append(0, np.cumsum(flat < int((features < 1 << 63).sum())))[to])
        data, by_place = flat.tobytes(), np.arange(sizes.size).reshape(sizes.shape).T.ravel()
        self.parts = [_Part(data, x[by_place], y[by_place], len(features)) for x, y in ((to[:-1], middle), (middle, to[1:]))]
        # what the labels say is the same each time
        self.said_emit, self.said_move = self._spread(said, len(features)), np.zeros((len(TAGS) + 1, len(TAGS)))
        self.said_move[-1] = said[:, 0].sum(1)
        for t in range(1, self.length):
            self.said_move[:-1] += np.einsum("in,jn->ij", said[:, t - 1] > 0, said[:, t])

    def _spread(self, off: np.ndarray, n_features: int) -> np.ndarray:
        off = off.reshape(len(TAGS), -1)
        return np.ascontiguousarray(sum(p.spread(off, n_features) for p in self.parts).T)

    def gradient(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, weights = len(TAGS), self.weights
        by_tag = np.ascontiguousarray(emit.T)
        here = sum(p.scores(by_tag) for p in self.parts)
        here -= here.max(0)
        here, step = np.exp(here, out=here).reshape(k, self.length, -1), np.exp(move[:k])
        # chances forward and backward, scaled to 1 at each place; einsum, since products with matrices this small only keep threads busy
        forward, g_move, scale = [], np.zeros_like(move), []
        for t in range(self.length):
            forward.append(here[:, t] * (np.einsum("in,ij->jn", forward[-1], step) if t else np.exp(move[k])[:, None]))
            scale.append(1 / forward[t].sum(0))
            forward[t] *= scale[t]
        # from the last place on, times the weights
        off, backward = np.empty_like(here), weights
        for t in range(self.length - 1, -1, -1):
            np.multiply(forward[t], backward, out=off[:, t])
            if t:
                ahead = here[:, t] * scale[t]
                ahead *= backward
                backward = np.einsum("jn,ij->in", ahead, step)
                g_move[:k] += step * np.einsum("in,jn->ij", forward[t - 1], ahead)
        g_move[k] = off[:, 0].sum(1)
        return self._spread(off, len(emit)) - self.said_emit, g_move - self.said_move


def _blocks(lessons: Iterable[tuple[bytes, float]], features: np.ndarray) -> Iterator[Block]:
    """Lessons, which come in the order of their lengths, in blocks of one length."""
    for _, alike in groupby(lessons, lambda x: x[0][:4]):
        while some := list(islice(alike, BLOCK)):
            yield Block(*map(list, zip(*some)), features)


class Pairs:
    """Language words, features and the fitted field."""

    def __init__(self, records: list[tuple], endings: Endings, refusals: re.Pattern = REFUSALS):
        """records are (question, expected answer, context, answer, whether it has no end, whether at a limit)."""
        self.endings, self.refusals, self.common = endings, refusals, None
        scale = max(1.0, len(records) / PER_ROWS)
        asked: dict[str | None, int] = {}
        scans, times = [], Counter()
        for some in _portions(records):
            scans.append(self._scan(some))
            scans[-1].asked = np.array([asked.setdefault(r[0], len(asked)) for r in some], np.int64)
            strings, tokens, _ = scans[-1].tokens()
            times.update(dict(zip(strings, np.bincount(tokens, minlength=len(strings)).tolist())))
        words = _candidates(times, endings.scale)
        found = pa.Table.from_batches([x.by_language({w: i for i, w in enumerate(words)}) for x in scans]).sort_by("asked") if scans else pa.table({})
        self.belongs = _belonging(words, *_words_by_language(found.combine_chunks().to_batches(), len(words)), endings.scale)
        described, codes = [self.described(x, Codes()) for x in scans], Counter()
        for d in described:
            codes.update(dict(zip(*(x.tolist() for x in d.times()))))
        self.features = _features(np.array(list(codes), np.uint64), np.array(list(codes.values()), np.int64), scale)
        lessons: Counter = Counter()
        for d in described:
            for lesson, weight in d.lessons(self.features):
                lessons[lesson] += weight
        self._fit_here(sorted(lessons.items()))

    def _scan(self, records: list[tuple]) -> Clauses:
        """Scanned records of the form that __init__ takes."""
        scan = Clauses([r[:4] for r in records], self.refusals)
        scan.note([r[4] for r in records], [r[5] for r in records], [r[:4] for r in records])
        return scan

    def describe(self, question: str | None, answer: str | None, expected: str | None, context: str | None, no_end: bool, at: bool) -> Described:
        """One record's clauses."""
        return self.described(self._scan([(question, expected, context, answer, no_end, at)]), Codes())

    def described(self, scan: Clauses, codes: Codes) -> Described:
        """The clauses of scanned records: their signs, words and pairs of words."""
        strings, tokens, _ = scan.tokens()
        n_strings, k = len(strings), len(LANGUAGES)
        asked, known = scan.keys(strings, tokens, (QUESTION,)), scan.keys(strings, tokens, (QUESTION, EXPECTED))
        # what stands for no answer is no clause
        own = scan.texts % scan.columns == TEXT
        own[own] = real = ~scan.filler[scan.texts[own] // scan.columns]
        sizes, record = scan.sizes[own].astype(np.int64), scan.texts[own].astype(np.int64) // scan.columns
        n, every = len(sizes), np.arange(len(sizes))
        words, clause = tokens[np.repeat(own, scan.sizes)].astype(np.int64), np.repeat(every, sizes)
        keys = np.sort(clause * n_strings + words)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        times, keys = np.diff(first, append=len(keys)), keys[first]
        of, word = keys // n_strings, keys % n_strings
        in_asked, in_known = (_within(record[of] * n_strings + word, x) for x in (asked, known))
        n_asked = np.bincount(asked // n_strings, minlength=scan.n_records)[record]
        shared = np.bincount(of, times * in_asked, n) / sizes
        grounded = np.bincount(of, times * in_known, n) / sizes
        covered = np.bincount(of, in_asked, n) / np.maximum(n_asked, 1)
        new = np.bincount(of, ~in_asked, n)

        lang = scan.languages(strings, asked)[record]
        # words of a language that the question names may be what it asks for
        named = np.zeros((scan.n_records, k), bool)
        at, names = asked // n_strings, _marked(strings, LANGUAGE_NAMES)[asked % n_strings]
        for j in range(k):
            named[at[names[:, j]], j] = True
        named = named[record]

        def split(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Votes for the question's language, and the most for another one that it does not name."""
            mine = np.where(lang >= 0, votes[every, lang], 0)
            votes = np.where(named | (lang[:, None] == np.arange(k)), 0, votes)
            return mine, votes.max(1)

        belongs = np.array([_PLACE[self.belongs[x]] if x in self.belongs else -1 for x in strings], np.int64)[words]
        mine, other = split(np.stack([np.bincount(clause[belongs == j], minlength=n) for j in range(k)], 1))
        foreign = (lang >= 0) & (other > 0) & (other >= 3 * mine)
        everyday = _marked(strings, EVERYDAY)[word]
        mine_said, other_said = split(np.stack([np.bincount(of[everyday[:, j]], minlength=n) for j in range(k)], 1))

        signs, cut = np.zeros((n, N_SIGNS), bool), np.zeros(n, bool)
        signs[:, 0] = True
        for base, x in ((1, (4 * shared).astype(int)), (5, (4 * covered).astype(int)), (UNGROUNDED, (4 * grounded).astype(int)), (NEW_WORDS, new.astype(int))):
            signs[every, base + np.minimum(x, 3)] = True
        whole = (n_asked > 0) & (covered == 1.0)
        last = np.append(record[1:] != record[:-1], True)[:n]
        for sign, x in (
            (ALL_ASKED, whole), (FOREIGN_MANY, foreign & (other > 1)), (FOREIGN_ONE, foreign & (other == 1)), (15, mine > 0), (17, scan.asks[real]),
            (18, np.diff(record, prepend=-1) > 0), (19, last), (21, sizes < 4), (22, scan.quote[real]), (FIRST_PERSON, scan.first_person[real]), (FORMULA, scan.formula[real]),
            (EVERYDAY_OWN, (lang >= 0) & (mine_said > other_said)), (EVERYDAY_OTHER, (lang >= 0) & (mine_said < other_said)),
        ):
            signs[:, sign] = x
        after, to = np.cumsum(sizes), np.append(0, np.cumsum(np.bincount(scan.texts, scan.sizes, scan.n_records * scan.columns).astype(np.int64)))
        for i in np.flatnonzero(whole).tolist():
            question = tokens[slice(*to[scan.columns * record[i] + QUESTION :][:2])].tolist()
            signs[i, ECHOED] = len(question) > 2 and _contains(words[after[i] - sizes[i] : after[i]].tolist(), question)
        ends = np.flatnonzero(last)
        place = dict(zip(record[ends].tolist(), ends.tolist()))
        for r, (question, expected, context, answer) in zip(scan.open.tolist(), scan.open_texts):
            if r in place:
                found, cut[place[r]] = self._ending(answer, [question, expected, context], bool(scan.at[r]))
                signs[place[r], found] = True

        common = np.array([self.common is None or x in self.common for x in strings], bool)
        of_words = np.zeros(n_strings, np.uint64)
        used = np.zeros(n_strings, bool)
        used[words] = True
        for i in np.flatnonzero(used & common).tolist():
            of_words[i] = codes[strings[i]]
        coded = of_words[words]
        pairs = np.flatnonzero((clause[1:] == clause[:-1]) & (coded[1:] > 0) & (coded[:-1] > 0))
        told = np.flatnonzero(coded)
        return Described(
            np.bincount(record, minlength=scan.n_records), sizes, signs, cut,
            [clause[told], clause[pairs]], [coded[told], _joined_all(coded[pairs], coded[pairs + 1]) | np.uint64(1 << 63)],
        )

    def _ending(self, answer: str, others: list[str | None], at: bool) -> tuple[list[int], bool]:
        """The signs of an end without a mark, and whether the ending rule calls it cut."""
        mark, ratio = self.endings.evidence(answer, others)
        signs = [25, MARKS[mark] if mark else CHANCE + sum(ratio >= step for step in CHANCE_STEPS)]
        if at:
            signs.append(AT_LIMIT)
        if at or mark in ("half", "begun", "spelled"):
            signs.append(STOPPED)
        return signs, at or mark in ("half", "begun", "spelled") or (mark is None and ratio < 1)

    def _fit_here(self, lessons: list[tuple[bytes, float]]) -> None:
        """The fit on lessons in order."""
        blocks = list(_blocks(lessons, self.features))
        self._fit(sum(weight for _, weight in lessons), lambda emit, move: [x.gradient(emit, move) for x in blocks])

    def _fit(self, total_weight: float, gradients: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]) -> None:
        """Maximum likelihood with a penalty, by full-batch gradient steps of adapted size; gradients gives the parts of each step's."""
        k = len(TAGS)
        self.emit, self.move = np.zeros((len(self.features), k)), np.zeros((k + 1, k))
        if not total_weight:
            return
        penalty = np.array([FORMULA_PENALTY if t == FORMULA else SOFT_PENALTY if t in SOFT else SIGN_PENALTY if t < 1 << 63 else WORD_PENALTY for t in self.features.tolist()])[:, None]
        first, second = [np.zeros_like(self.emit), np.zeros_like(self.move)], [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for step in range(1, ROUNDS + 1):
            g_emit, g_move = (sum(g) for g in zip(*gradients(self.emit, self.move)))
            for w, g, a, b, pen in ((self.emit, g_emit, first[0], second[0], penalty), (self.move, g_move, first[1], second[1], SIGN_PENALTY)):
                g = g / total_weight + pen * w
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= 0.3 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)

    def tag(self, described: list[Described]) -> list[np.ndarray]:
        """The best tags of each."""
        return [self.tags(d) for d in described]

    def tags(self, described: Described) -> np.ndarray:
        """The best tags of the clauses of each record, one after the other."""
        flat, sizes = described.rows(self.features)
        k, owner, lengths = len(TAGS), np.repeat(np.arange(len(sizes)), sizes), described.lengths
        sums = np.stack([np.bincount(owner, self.emit[flat, j], len(sizes)) for j in range(k)], 1)
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(len(sizes), np.int8)
        # sequences of one length together: nothing is padded, however long some are
        for size in np.unique(lengths[lengths > 0]).tolist():
            which = np.flatnonzero(lengths == size)
            places = starts[which][:, None] + np.arange(size)
            s = sums[places]
            best, came = s[:, 0] + self.move[k], np.zeros((len(which), size, k), np.int8)
            for t in range(1, size):
                step = best[:, :, None] + self.move[:k][None]
                came[:, t] = step.argmax(1)
                best = step.max(1) + s[:, t]
            at = best.argmax(1)
            for t in range(size - 1, -1, -1):
                out[places[:, t]] = at
                at = came[np.arange(len(which)), t, at]
        return out

    @staticmethod
    def _cues(described: Described) -> list[int]:
        """Labels by cues alone."""
        return described.labels.tolist()

    @staticmethod
    def defect(described: Described, tags: np.ndarray) -> str | None:
        """The defect that the words of one record under each tag make."""
        return _made(np.bincount(tags, described.n_words, len(TAGS)).tolist())

    def defects(self, described: Described) -> list[str | None]:
        """The defect of each record."""
        k, record = len(TAGS), np.repeat(np.arange(len(described.lengths)), described.lengths)
        words = np.bincount(record * k + self.tags(described), described.n_words, len(described.lengths) * k)
        return [_made(w) for w in words.reshape(-1, k).tolist()]


def _made(words: list[float]) -> str | None:
    """The defect that the number of words under each tag makes."""
    told = sum(words)
    if not told:
        return "empty"
    if words[UNFINISHED]:
        return "truncated"
    if words[REFUSAL] >= 0.5 * told:
        return "refusal"
    if words[ECHO] and not words[ANSWER] and words[ECHO] >= words[FOREIGN]:
        return "copies_question"
    if words[FOREIGN] >= 0.5 * told:
        return "other_language"
    return None


def is_filler(answer: str | None) -> bool:
    """Whether an answer has no content."""
    if not answer:
        return True
    if len(answer) > 40 and answer.isascii() and any(map(str.isalnum, answer[:40])):
        return False
    words = re.findall(r"[^\W_]+", _readable(answer).casefold())
    return len(words) <= FILLER_WORDS and " ".join(words) in FILLERS


def fit(model: Pairs, described: DataFrame, n_records: int) -> None:
    """Fits the field of model on all described records; equal lessons are learned as one of their common weight."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in unpacked(batches):
            codes, n = d.times()
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], ["code", "n"])

    scale = max(1.0, n_records / PER_ROWS)
    # the signs are the codes that are not negative
    often = described.mapInArrow(times, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where((F.col("n") > 0) & ((F.col("code") >= 0) | (F.col("n") >= FEATURE_TIMES * scale))).toArrow()
    features = model.features = _features(often["code"].to_numpy().view(np.uint64), often["n"].to_numpy(), scale)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in unpacked(batches):
            some: Counter = Counter()
            for lesson, weight in d.lessons(features):
                some[lesson] += weight
            yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.binary()), pa.array(list(some.values()), pa.float64())], ["lesson", "weight"])

    lessons = checkpointed(described.mapInArrow(learn, "lesson binary, weight double").groupBy("lesson").agg(F.sum("weight").alias("weight")))
    total, size = lessons.agg(F.sum("weight"), F.sum(F.length("lesson"))).first()
    if (size or 0) <= FIT_HERE:
        found = lessons.toArrow()
        model._fit_here(sorted(zip(found["lesson"].to_pylist(), found["weight"].to_pylist())))
        return

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), features):
            yield pa.RecordBatch.from_arrays([pa.array([packed(block)], pa.binary())], ["block"])

    blocks = checkpointed(lessons.sortWithinPartitions("lesson").mapInArrow(pack, "block binary"))

    def gradients(emit: np.ndarray, move: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros_like(emit), np.zeros_like(move)]
            for block in unpacked(batches):
                for own, g in zip(sums, block.gradient(emit, move)):
                    own += g
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in sums], ["emit", "move"])

        return [tuple(np.frombuffer(x).reshape(y.shape) for x, y in zip(r, (emit, move))) for r in blocks.mapInArrow(gradient, "emit binary, move binary").collect()]

    model._fit(total, gradients)


def defects(records: DataFrame, key: str = "row_id", question: str = "question", answer: str = "answer", expected: str = "expected_answer", context: str = "context", source: str = "source") -> DataFrame:
    """(key, defect) of each defective pair."""
    records = records.select(key, question, answer, expected, context, source)
    limits = Limits(records, source, answer)
    pairs = with_copy_key(limits.marked(records), answer, question).select(F.col(key).cast("bigint").alias(key), "a", "b", F.xxhash64(question).alias("asked"), "__open", "__at_limit", question, expected, context, answer)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            open_, at, begin = b.column(4).to_pylist(), b.column(5).to_pylist(), 0
            for some in _portions(zip(*(x.to_pylist() for x in b.columns[6:]))):
                found, end = Clauses(some), begin + len(some)
                found.note(open_[begin:end], at[begin:end], some)
                found.of = [x.slice(begin, len(some)) for x in b.columns[:5]]
                found.asked, begin = found.of[3].to_numpy(), end
                yield pa.RecordBatch.from_arrays([pa.array([packed(found)], pa.binary())], ["scanned"])

    scans = checkpointed(pairs.mapInArrow(scan, "scanned binary"))
    model = Pairs.__new__(Pairs)
    model.endings, model.refusals = Endings.of(scans), REFUSALS
    model.belongs = _language_words(scans, model.endings.all, model.endings.scale)
    # a rarer word is no feature, nor is a pair with it
    model.common = {w for w, n in model.endings.all.items() if n >= FEATURE_TIMES * max(1.0, model.endings.n_records / PER_ROWS)}
    del model.endings.all

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for found in unpacked(batches):
            described = model.described(found, codes)
            described.of = [*found.of[:3], found.of[4]]
            yield pa.RecordBatch.from_arrays([pa.array([packed(described)], pa.binary())], ["described"])

    described = checkpointed(scans.mapInArrow(describe, "described binary"))
    field = Pairs.__new__(Pairs)
    fit(field, described, model.endings.n_records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in unpacked(batches):
            found = field.defects(d)
            cut = pa.array([x == "truncated" for x in found], pa.bool_())
            ended = [x != "empty" and o is False for x, o in zip(found, d.of[3].to_pylist())]
            yield pa.RecordBatch.from_arrays([*d.of[:3], pa.array(found, pa.string()), cut, pa.array(ended, pa.bool_())], [key, "a", "b", "defect", "cut", "ended"])

    tagged = checkpointed(described.mapInArrow(run, f"`{key}` bigint, a bigint, b int, defect string, cut boolean, ended boolean").where("defect IS NOT NULL OR ended"))
    own = tagged.where("defect IS NOT NULL").select(key, "defect")
    copies = ended_copies(tagged, key).withColumn("defect", F.lit("truncated"))
    # a copy of a cut answer is cut first, whatever its words say
    rank = F.when(F.col("defect") == "empty", 0).when(F.col("defect") == "truncated", 1).otherwise(2)
    return own.unionByName(copies).groupBy(key).agg(F.min_by("defect", rank).alias("defect"))
