"""Plain text, cut texts, copies, defective pairs and repetition on small fixtures, against brute force where there is one."""

import random
import re
import tempfile
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import catalog, copies, pairs, truncation
from gradeloom.llm.copies import copy_groups, further_copies
from gradeloom.llm.pairs import REFUSALS, Pairs, defects, is_filler
from gradeloom.llm.plain_text import not_plain, plain_columns
from gradeloom.llm.repetition import BOUNDS, Words, repeated_words, repetition
from gradeloom.llm.truncation import Endings, Limits, cut_shares, cut_texts, storage_limits

PLAIN = {
    "Ｔｈｅ　ｃａｔ．": "The cat.", "kilómetros": "kilómetros", "cla‍y﻿": "clay", "a\xa0b c": "a b c", "Іt takes 224.5 daуs.": "It takes 224.5 days.", "ΚΒ": "KB", "4 КВ": "4 KB",
    "PIP means РІР": "PIP means PIP", "ﬁne": "fine", "сelsius": "celsius", "приbет": "приbет",
}
SAME = ["plain", "", None, "tab\tand\nbreak", "“quotes” – and — dashes…", "é ü ñ", "Совет округа", "It is 'окно', he said.", "IN RUSSIAN: 'ОКНО'.", "мост", "x́", "№ 5 ½ °C", "Fexu и Zaya в городе", "Երևան", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ˈɡɑːdən", "ılık su", "m² ¼ ª ™", "น้ำ"]


def test_plain_text(spark):
    rows = [(i, t, None, "mine") for i, t in enumerate([*PLAIN, *SAME])] + [(0, "Ｔｈｅ　ｃａｔ．", None, "mine")]
    df = spark.createDataFrame(rows, "row_id bigint, answer string, expected_answer string, field_name string")
    texts = [r[1] for r in rows]
    for r in plain_columns(df, "row_id", ["answer", "expected_answer"]).collect():
        stored = texts[r["row_id"]]
        if stored in SAME:
            assert r["answer"] == stored and r["answer_stored_plain"], stored
        elif stored != "приbет":
            assert r["answer"] == PLAIN[stored] and not r["answer_stored_plain"], (stored, r["answer"])
        assert r["expected_answer"] is None and r["expected_answer_stored_plain"]
    found = not_plain(df, "row_id", ["answer", "expected_answer"]).collect()
    assert sorted(r["row_id"] for r in found if texts[r["row_id"]] != "приbет") == [0, 0, *range(1, len(PLAIN) - 1)]
    again = spark.createDataFrame([(i, p) for i, p in enumerate(PLAIN.values()) if p != "приbет"], "row_id bigint, answer string")
    assert not_plain(again, "row_id", ["answer"]).count() == 0
    long = spark.createDataFrame([(1, "ａ" * 300_000)], "row_id bigint, answer string")
    assert plain_columns(long, "row_id", ["answer"]).first()["answer"] == "a" * 300_000
    assert not_plain(df.where("false"), "row_id", ["answer"]).count() == 0


def _copy_key(row):
    def fold(t):
        t = (t or "").lower().replace("ß", "ss")
        keep = [(c if not (c.isspace() or unicodedata.category(c)[0] in "PZ") else c if c in ".," and 0 < i < len(t) - 1 and t[i - 1].isdigit() and t[i + 1].isdigit() else "") for i, c in enumerate(t)]
        return "".join(keep)

    return tuple(sorted(map(fold, row)))


@pytest.mark.parametrize("limits", [{}, {"most_records": 5}, {"most_records": 1}, {"most_bytes": 60}])
def test_copies_against_brute_force(spark, limits):
    rng = random.Random(2)
    bases = [[rng.choice(["The long common opening of a text " + str(i), "It holds 2.5 l", "It holds 25 l", "", None, "Straße"]) for _ in range(4)] for i in range(25)]
    rows = []
    for i in range(240):
        row = list(rng.choice(bases if i % 3 else bases[:1]))  # a third of all rows are copies of one
        rng.shuffle(row)
        row = [t and "".join(rng.choice([c, c.upper(), c + ("  " if c == " " else "")]) for c in t) + rng.choice(["", ".", "!", "\n"]) for t in row]
        rows.append((i + 100, *row, 1))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "row_id bigint, q string, a string, e string, c string, n_copies int")
    groups = {}
    for r in rows[:-1]:
        groups.setdefault(_copy_key(r[1:5]), []).append(r[0])
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    got = {(r[0], r[1]) for r in further_copies(df.dropDuplicates(["row_id"]), "row_id", ["q", "a", "e", "c"], **limits).collect()}
    assert got == want
    sizes = copy_groups(df, "row_id", ["q", "a", "e", "c"], **limits).where("row_id = first_id").dropDuplicates(["row_id"]).agg(F.sum("n_copies")).first()[0]
    assert sizes == len(rows)
    assert copy_groups(df.where("false"), "row_id", ["q", "a"], **limits).count() == 0


def test_long_records_lie_in_many_tries(spark):
    """A task holds one bucket at a time: long texts make more parts, and no trie holds more than a bucket."""
    rows = [(i, f"{i % 90:03d} heading " + "long text " * 3000, None) for i in range(180)]
    df = spark.createDataFrame(rows, "row_id bigint, q string, a string")
    groups = copy_groups(df, "row_id", ["q", "a"], most_bytes=1 << 19)
    assert groups.rdd.getNumPartitions() >= 180 * 24000 // (1 << 19)
    assert {(r["row_id"], r["first_id"], r["n_copies"]) for r in groups.collect()} == {(i, i % 90, 2) for i in range(180)}
    held = []

    class Seen(copies.Trie):
        def add(self, rid, key):
            super().add(rid, key)
            held.append(sum(len(k) for k in self.root))

    own, copies.Trie = copies.Trie, Seen
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"a", b"b", b"b"]), pa.array([1, 2, 3, 4]), pa.array([b"ax", b"ay", b"bx", b"bx"])], ["bucket", "row_id", "canonical"])
        out = [r for t in copies._trie_counts(iter([batch])) for r in t.to_pylist()]
    finally:
        copies.Trie = own
    assert max(held) == 4 and [(r["first_id"], r["n_copies"]) for r in out] == [(1, 1), (2, 1), (3, 2), (3, 2)]


def _repeated(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    seen, marked = set(), [False] * len(w)
    for i in range(len(w) - 7):
        run = tuple(w[i : i + 8])
        if run in seen:
            marked[i : i + 8] = [True] * 8
        seen.add(run)
    return len(w), sum(marked)


def test_repetition_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "...", "a b c", "x " * 9, "x " * 8, "word " * 30_000]
    for _ in range(300):
        w = [rng.choice("abcdefghij") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            at, n = rng.randrange(len(w)), rng.randint(5, 14)
            w[rng.randrange(len(w)) : 0] = w[at : at + n]
        texts.append(" ".join(w).replace("a1", "A1,"))
    texts += texts[-3:]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, share double")
    want = {i: _repeated(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["n_words"], r["n_repeated"]) for r in repetition(df).collect()} == want
    for least in (0.1, 0.3, 0.9):
        hits = {i for i, (n, k) in want.items() if n and k / n >= least}
        assert {r["doc_id"] for r in repetition(df, least=least).collect()} == hits
        w = Words(texts)
        for bound in BOUNDS.values():
            assert bound(w, least)[sorted(hits)].all()
    assert repeated_words(Words([])).size == 0 and repetition(df.where("false"), least=0.3).count() == 0


SUBJECTS = ["The reading room", "A spot check", "The map room", "Every closed ticket", "The glossary"]
VERBS = ["merges list {n} with an older one", "never mentions {w}", "keeps a copy for the {w} branch", "sends {n} forms to {w}"]
TAILS = ["under the {w} agreement.", "as table {n} shows.", "on behalf of {w}.", "once ticket {n} is closed."]


def _sentence(rng):
    def name():
        return rng.choice("BCDFGKLM") + rng.choice("aeiou") + rng.choice("bdfgkln") + rng.choice("aeiou") + rng.choice(["grad", "ford", "wick"])

    return " ".join(p.replace("{n}", str(rng.randint(10, 999))).replace("{w}", name()) for p in (rng.choice(SUBJECTS), rng.choice(VERBS), rng.choice(TAILS)))


def _answers(spark, limit=120, rows=900):
    rng = random.Random(9)
    data, cut = [], set()
    for i in range(rows):
        whole = " ".join(_sentence(rng) for _ in range(rng.randint(1, 4)))
        source = ["wide", "narrow", None][i % 3 if i % 30 else 2] if i % 3 < 2 else "wide"
        answer = whole[:limit] if source == "narrow" else whole
        if source == "narrow" and len(whole) > limit and not re.search(r"\.\s*$", answer):
            cut.add(i)
        data.append((i, f"What does {i} say?", answer, None, whole if i % 5 else None, source, 1))
    data.append((rows, "q", next(d[2] for d in data if d[0] in cut).upper() + "!", None, None, "wide", 1))  # a copy with an end mark
    data += [(rows + 1, "q", None, None, None, None, 1), (rows + 2, "q", "  ", None, None, "wide", 1), (rows + 3, "q", "The map room", "The map room", None, "wide", 1), (rows + 4, None, "half a charact�", None, None, "wide", 1), (rows + 5, "q", "word " * 50_000 + "end.", None, None, "wide", 1)]
    return spark.createDataFrame(data, "row_id bigint, question string, answer string, expected_answer string, context string, source string, limit int"), cut | {rows, rows + 4}


def test_cut_texts(spark):
    df, want = _answers(spark)
    found = {(r["source"], r["form"], r["limit"]) for r in storage_limits(df).collect()}
    assert ("narrow", "characters", 120) in found and not any(s == "wide" for s, *_ in found)
    got = {r[0] for r in cut_texts(df).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want), (len(got - want), len(want - got))
    assert {900, 904, *range(900, 906)} & got == {900, 904}
    shares = {r["source"]: r["share"] for r in cut_shares(df).collect()}
    assert shares["narrow"] > 0.5 and shares["wide"] < 0.02
    assert cut_texts(df.where("false")).count() == 0


def test_defective_pairs(spark):
    rng = random.Random(6)
    questions = {"en": ("What is the seal of {w} made of?", "The seal of {w} is made of {m}.", ["copper", "birch bark", "tin", "oak"]), "de": ("Woraus besteht das Siegel von {w}?", "Das Siegel von {w} besteht aus {m}.", ["Kupfer", "Birkenrinde", "Zinn", "Eichenholz"])}
    refusals = {"en": ["I'm sorry, but I can't answer that.", "I must decline to comment on {w}. Please ask someone else."], "de": ["Dazu kann ich leider keine Auskunft geben.", "Tut mir leid, bei dieser Anfrage kann ich nicht helfen."]}
    data, want = [], {}
    for i in range(1500):
        lang = "de" if i % 3 == 0 else "en"
        q, a, m = questions[lang]
        w = rng.choice("BCDFGK") + rng.choice("aeiou") + rng.choice("bdfgk") + rng.choice("aeiou") + rng.choice(["ne", "ta", "go"])
        kind = i % 15
        answer, defect = a.format(w=w, m=rng.choice(m)), None
        if kind == 0:
            answer, defect = rng.choice(refusals[lang]).format(w=w), "refusal"
        elif kind == 1:
            answer, defect = rng.choice(["", "You asked: "]) + q.format(w=w), "copies_question"
        elif kind == 2:
            o = "en" if lang == "de" else "de"
            answer, defect = questions[o][1].format(w=w, m=rng.choice(questions[o][2])), "other_language"
        elif kind == 3:
            answer, defect = rng.choice(["n/a", "", None, " - ", "null", "(empty)"]), "empty"
        elif kind == 4:
            answer = f'The desk quotes a clerk with "I cannot answer that", yet the seal of {w} is made of {rng.choice(m)}.' if lang == "en" else answer
        data.append((i, q.format(w=w), answer, a.format(w=w, m=rng.choice(m)), None, "s", "mine"))
        if defect:
            want[i] = defect
    df = spark.createDataFrame(data, "row_id bigint, question string, answer string, expected_answer string, context string, source string, defect string")
    got = {r["row_id"]: r["defect"] for r in defects(df).collect()}
    wrong = {i for i in {*got, *want} if got.get(i) != want.get(i)}
    assert len(wrong) <= 0.02 * len(want), [(data[i][1:3], got.get(i), want.get(i)) for i in sorted(wrong)[:8]]
    odd = spark.createDataFrame([(1, None, "An answer.", None, None, None), (2, None, None, None, None, None), (3, "q?", "long " * 40_000 + ".", None, None, "s"), (3, "q?", "long " * 40_000 + ".", None, None, "s")], df.drop("defect").schema)
    assert [r["defect"] for r in defects(odd).collect() if r["row_id"] == 2] == ["empty"]
    assert defects(df.where("false")).count() == 0
    assert is_filler("#N/A") and is_filler("​") and not is_filler("No.") and not is_filler("0")


def test_the_field_finds_refusals_that_no_cue_names():
    """Fitted without one formula among its cues, the field must find most of what that formula said."""
    rng = random.Random(12)
    refusals = ["I'm sorry, but I can't answer that.", "I must decline to comment on {w}.", "I would rather not answer that.", "As an assistant I am unable to say."]
    rows = []
    for i in range(2400):
        w = rng.choice("BCDFGK") + rng.choice("aeiou") + rng.choice("bdfgk") + rng.choice(["ane", "ota", "igo"])
        m = rng.choice(["copper", "birch bark", "tin", "oak"])
        answer = rng.choice(refusals).format(w=w) if i % 8 == 0 else rng.choice([f"The seal of {w} is made of {m}.", f"It is made of {m}.", f'A clerk of {w} said "I would rather not say", but it is made of {m}.'])
        rows.append((f"What is the seal of {w} made of?", f"The seal of {w} is made of {m}.", None, answer, False, False))
    reduced = re.compile(REFUSALS.pattern.replace("|(?:i'd|i’d|i would|we'd) rather not", ""), re.IGNORECASE)
    assert reduced.pattern != REFUSALS.pattern
    model = Pairs(rows[:1600], Endings([r[:4] for r in rows[:1600]]), reduced)
    described = [model.describe(q, a, e, c, no_end, at) for q, e, c, a, no_end, at in rows[1600:]]
    found = [model.defect(c, tags) for c, tags in zip(described, model.tag(described))]
    cues = [model.defect(c, np.array(model._cues(c))) for c in described]
    unnamed = [i for i, r in enumerate(rows[1600:]) if r[3].startswith("I would rather not")]
    assert unnamed and all(cues[i] is None for i in unnamed)
    assert sum(found[i] == "refusal" for i in unnamed) >= 0.8 * len(unnamed)
    assert not [r[3] for r, f in zip(rows[1600:], found) if f == "refusal" and "made of" in r[3]]


def test_short_copies_and_bare_words(spark):
    whole = [(i, f"What does {i} say?", f"The map room keeps list {i} for the clerk of Dafoford.", None, "The clerk of Dafoford keeps it.", "wide") for i in range(60)]
    rows = whole + [(100, "Who?", "Dafof", None, "The clerk of Dafoford keeps it.", "wide"), (101, "Who?", "Dafof.", None, None, "wide"), (102, "Where?", "Dafof.", None, None, "wide"), (103, "Who?", "Dafoford", None, "The clerk of Dafoford keeps it.", None), (104, "Who?", "...", None, None, "wide")]
    df = spark.createDataFrame(rows, "row_id bigint, question string, answer string, expected_answer string, context string, source string")
    # a bare word that the record spells out further is cut, and its ended copy under the same question; under another it is no copy
    assert {r[0] for r in cut_texts(df).collect()} & set(range(100, 105)) == {100, 101}


def test_endings_are_counted_on_all_records(spark):
    """A value that only records outside of any sample of 12,000 have is known; the counts of a table are those of its records."""
    place = F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(1 << 40))
    last = {r[0] for r in spark.range(13_000).orderBy(place.desc()).limit(6).collect()}
    rows = [(i, f"What does {i} say?", "Kept in blue ink" if i in last else f"The map room keeps list {i} for the clerk.", None, None, "wide") for i in range(13_000)]
    df = spark.createDataFrame(rows, "row_id bigint, question string, answer string, expected_answer string, context string, source string")
    assert {r[0] for r in cut_texts(df).collect()} == set()
    columns = ["question", "expected_answer", "context", "answer"]
    for some in (df, _answers(spark)[0], df.where("false")):
        here, there = Endings([tuple(r) for r in some.select(*columns).collect()]), Endings.counted(some, columns)
        for what in ("scale", "own", "begun", "codes", "times", "final", "values"):
            assert getattr(here, what) == getattr(there, what), what


def test_the_field_is_fitted_on_all_records(spark, monkeypatch):
    """A word that only records outside of any sample of 12,000 have is known as foreign; tables and records at hand give one field."""
    place = F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(1 << 40))
    last = [r[0] for r in spark.range(13_000).orderBy(place.desc()).limit(24).collect()]
    rng, rows = random.Random(8), []
    materials = {"en": ["copper", "birch bark", "tin", "oak"], "de": ["Kupfer", "Birkenrinde", "Zinn", "Eichenholz"]}
    for i in range(13_000):
        lang, w = "de" if i % 3 == 0 else "en", rng.choice("BCDFGK") + rng.choice("aeiou") + rng.choice("bdfgk") + rng.choice("aeiou") + rng.choice(["ne", "ta", "go"])
        m = rng.choice(materials[lang])
        answer = f"{rng.choice(materials[lang])}."
        if i % 15 == 1:
            answer = f"{rng.choice(materials['en' if lang == 'de' else 'de'])}."
        elif i % 15 == 2:
            answer = "".join(rng.choice(["ba", "ko", "lu", "mi", "zu"]) for _ in range(4)).capitalize() + "."
        if i in last:
            # German records name a wood, and one English question is answered with it
            lang, m, answer = ("en", "oak", "Schwarzpappel.") if i == last[0] else ("de", "Schwarzpappel", "Kupfer.")
        rows.append((i, f"What is the seal of {w} {i} made of?" if lang == "en" else f"Woraus besteht das Siegel von {w} {i}?", answer, f"The seal of {w} is made of {m}." if lang == "en" else f"Das Siegel von {w} besteht aus {m}.", None, "s"))
    df = spark.createDataFrame(rows, "row_id bigint, question string, answer string, expected_answer string, context string, source string")
    found = {r["row_id"]: r["defect"] for r in defects(df).collect()}
    assert found.get(last[0]) == "other_language" and not set(last[1:]) & set(found)

    monkeypatch.setattr(pairs, "ROUNDS", 15)
    fields = []
    monkeypatch.setattr(pairs, "fit", lambda field, *rest, own=pairs.fit: (own(field, *rest), fields.append(field)))
    some = df.where("row_id < 1500").withColumn("question", F.when(F.col("row_id") != 7, F.col("question")))
    for here in (pairs.FIT_HERE, 0):  # on the driver and on the executors
        monkeypatch.setattr(pairs, "FIT_HERE", here)
        defects(some).count()
    records = [tuple(r) for r in Limits(some, "source", "answer").marked(some).select("question", "expected_answer", "context", "answer", "__open", "__at_limit").collect()]
    want = Pairs(records, Endings([r[:4] for r in records]))
    assert want.belongs and pairs.language_words(some, "question", "expected_answer", "context", 1.0) == want.belongs
    for field in fields:
        assert (field.features == want.features).all() and np.allclose(field.emit, want.emit, atol=1e-6) and np.allclose(field.move, want.move, atol=1e-6)


def test_texts_are_read_twice_and_cut_into_words_once(spark, tmp_path):
    df, _ = _answers(spark, rows=200)
    df, folder = df.coalesce(1), str(tmp_path)

    def seen(batches):
        tempfile.mkstemp(dir=folder)
        yield from batches

    read = df.mapInArrow(seen, df.schema)
    assert {r["row_id"]: r["defect"] for r in defects(read).collect()} == {r["row_id"]: r["defect"] for r in defects(df).collect()}
    assert len(list(tmp_path.iterdir())) == 2  # lengths, and words


def test_words_in_arrays_are_those_of_the_patterns():
    rng = random.Random(3)
    alphabet = "ab Zé.?!,,..  \n\t\"'”»)]12٣½²_\0。！３ßЖa-—😀𝟙中文"
    records = [tuple(None if rng.random() < 0.05 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4)) for _ in range(3000)]
    scan = truncation.Scanned(records)
    texts = [truncation._readable(t).replace("\0", "\1") if t else "" for r in records for t in r]
    text = truncation._TEXT_END.join(texts) + truncation._TEXT_END
    assert [scan.strings[i] for i in scan.words.tolist()] == [w for w in truncation._SCAN.findall(text) if w[0] not in ".!?。！？．\0"]
    strings, tokens, _ = scan.tokens()
    assert [strings[i] for i in tokens.tolist()] == [w.lower() for t in texts for w in truncation._TOKEN.findall(t)]


def test_features_that_stand_together_add_up_to_the_same():
    rng = np.random.default_rng(1)
    lists = [np.sort(np.concatenate([rng.choice(40, 5), np.arange(40, 40 + rng.integers(0, 12))])).astype(np.int32) for _ in range(3000)]
    data, ends = b"".join(x.tobytes() for x in lists), np.cumsum([len(x) for x in lists])
    part, emit, off = pairs._Part(data, ends - [len(x) for x in lists], ends, 60), rng.normal(size=(5, 60)), rng.normal(size=(5, 3000))
    assert part.joined and np.allclose(part.scores(emit), np.stack([emit[:, x].sum(1) for x in lists], 1))
    want = np.zeros((5, 60))
    for i, x in enumerate(lists):
        np.add.at(want.T, x, off[:, i])
    assert np.allclose(part.spread(off, 60), want)


def test_names():
    assert {f"p{n}_found" for n in (1, 2, 4, 5, 7, 9)} <= set(catalog.QUERIES) and "p8_mixture" in catalog.QUERIES and set(catalog.ORACLES) <= set(catalog.QUERIES)
