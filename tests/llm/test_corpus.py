"""Leaked items and mixtures on small fixtures, against brute force."""

import random
from itertools import product

import numpy as np
import pytest

from gradeloom.llm import mixing
from gradeloom.llm.leakage import Index, Items, leaks, matched_words, words_of
from gradeloom.llm.mixing import budgets, fill, mixture, plan_source, shares


def _text(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def _corpus():
    rng = random.Random(8)
    common = [f"common{i}" for i in range(40)]
    items = [(i, _text(rng, rng.randint(60, 110), common + [f"rare{i}x{k}" for k in range(30)])) for i in range(12)]
    docs, want = [], set()
    for d in range(120):
        body = [_text(rng, rng.randint(0, 80), common)]
        if d % 2:
            i, text = rng.choice(items)
            w = text.split()
            share = rng.choice([0.15, 0.3, 0.7, 0.85, 1.0])
            part = w[: int(len(w) * share)] if rng.random() < 0.5 else w[len(w) - int(len(w) * share) :]
            part = [x if k % 9 else "changed" for k, x in enumerate(part)] if rng.random() < 0.4 else part
            half = len(part) // 2
            passage = [part] if rng.random() < 0.6 else [part[:half], part[half:]]
            for p in passage:
                body += [rng.choice([" ".join(p).upper(), "<p>" + "</b>, ".join(p) + "</p>", "\n".join(p)]), _text(rng, rng.randint(0, 30), common)]
            if share >= 0.7:
                want.add((i, d))
        docs.append((d, " ".join(body)))
    return items, docs, want


def test_leaks(spark):
    items, docs, want = _corpus()
    extra = [(500, None), (501, ""), (502, docs[1][1]), (503, "word " * 30_000 + items[0][1] + " word" * 10)]
    want |= {(i, 502) for i, d in want if d == 1} | {(0, 503)}
    df = spark.createDataFrame([(*r, 1) for r in docs + extra], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame([*items, (90, None), (91, ""), (92, items[0][1])], "item_id bigint, text string")
    want |= {(92, d) for i, d in want if i == 0}
    got = {(r["item_id"], r["doc_id"]) for r in leaks(it, df).collect()}
    assert got == want
    blocks = {(r["item_id"], r["doc_id"]) for r in leaks(it, df, block_chars=1500).collect()}
    assert blocks == want
    assert leaks(it, df.where("false")).count() == 0 and leaks(it.where("false"), df).count() == 0
    with pytest.raises(ValueError):
        leaks(it, df, least_share=0.0)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_leaks_of_any_share_against_every_alignment(spark, share):
    items, docs, _ = _corpus()
    items += [(70, "alone"), (71, "two words"), (72, "now three words")]
    docs += [(900, "here it stands alone"), (901, "the two words and now three words"), (902, '<a title="' + "x y " * 200 + '">' + items[3][1].replace(" ", '<img alt="' + "long " * 80 + '"> ', 3) + "</a>")]
    known = Items(items)
    want = set()
    for d, text in docs:
        words = np.array([known.numbers.get(w, -1) for w in words_of(text)], np.int32)
        want |= {(known.ids[i], d) for i, w in enumerate(known.words) if matched_words(w, words)[0] >= share * len(w)}
    assert (70, 900) in want and (71, 901) in want and (3, 902) in want
    got = leaks(spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string"), least_share=share).collect()
    assert {(r["item_id"], r["doc_id"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_seeds_lose_nothing(share):
    items, docs, _ = _corpus()
    known = Items(items)
    held = [np.array([known.numbers.get(w, -1) for w in words_of(t)], np.int32) for _, t in docs]
    index = Index(held, len(known.numbers))
    for item in known.words:
        every = {d for d, words in enumerate(held) if matched_words(item, words)[0] >= share * len(item)}
        assert every <= set(index.candidates(item, share).tolist())


def test_fill_is_the_nearest_from_below():
    rng = random.Random(1)
    for _ in range(150):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(2, 30), rng.randint(1, 5))}
        total = sum(n * c for n, c in counts.items())
        budget = rng.randint(1, total + 5)
        best = max(s for s in (sum(n * k for n, k in zip(counts, ks)) for ks in product(*(range(c + 1) for c in counts.values()))) if s <= budget)
        took = fill(counts, budget)
        assert all(0 <= took[n] <= counts[n] for n in took) and sum(n * k for n, k in took.items()) == best, (counts, budget)
    plan = plan_source({10: 3, 7: 1}, 60, 4)
    assert plan.rounds == 1 and plan.tokens <= 60 and plan.tokens == 57
    assert plan_source({}, 10, 2).tokens == 0 and plan_source({5: 2}, 100, 2).tokens == 20


def test_large_fill_is_exact():
    counts = {n: 50 for n in range(100, 1500, 7)}
    budget = sum(n * c for n, c in counts.items()) // 3 + 11
    assert sum(n * k for n, k in fill(counts, budget).items()) == budget


def _documents(spark, n=400):
    rng = random.Random(3)
    rows = [(i, _text(rng, rng.randint(3, 60), ["some", "words", "of", "text", "here"]), rng.choice(["big", "big", "big", "small", "other"]), 1) for i in range(n)]
    rows += [(n, None, "big", 1), (n + 1, " ", "small", 1), (n + 2, "text", None, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_uses int")


@pytest.mark.parametrize("most_ranked", [mixing.MOST_RANKED, 2])
def test_mixture(spark, most_ranked):
    docs = _documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    mixed = mixture(docs, targets, most_ranked=most_ranked)
    rows = {r["doc_id"]: r for r in mixed.collect()}
    assert {r["source"] for r in rows.values()} == {"big", "small"} and all(r["n_uses"] <= (1 if r["source"] == "big" else 2) for r in rows.values())
    got = {r["source"]: (r["n_tokens"], r["share"]) for r in shares(mixed, targets).collect()}
    assert abs(got["big"][1] - 0.5) < 1e-3 and abs(got["small"][1] - 0.5) < 1e-3 and got["absent"] == (0, 0.0)
    again = {r["doc_id"] for r in mixture(docs, targets, most_ranked=most_ranked).collect()}
    assert again == set(rows)
    other = {r["doc_id"] for r in mixture(docs, targets, most_ranked=most_ranked, seed=8).collect()}
    assert other != again
    fixed = mixture(docs, targets, total=1000, most_ranked=most_ranked)
    assert sum(r["n_tokens"] * r["n_uses"] for r in fixed.collect()) == 1000


def test_mixture_of_nothing(spark):
    docs = _documents(spark, 5)
    targets = spark.createDataFrame([("absent", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixture(docs, targets).count() == 0 and mixture(docs.where("false"), targets).count() == 0
    assert budgets({}, {}, None) == {}
