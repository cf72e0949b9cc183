"""Fact extraction: texts put together from facts that are known, and what overlaps, case by case."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.facts import figure, read_facts, with_facts

#: A statement, its kind and its key.
STATEMENTS = [
    ("2021-03-04", "dates", "2021-3-4"), ("1999/12/31", "dates", "1999-12-31"), ("July 9, 2011", "dates", "2011-7-9"), ("22nd june 2003", "dates", "2003-6-22"), ("1875", "numbers", "1875.0"), ("2016", "dates", "year 2016"),
    ("90 minutes", "durations", "fixed 5400.0"), ("six weeks", "durations", "fixed 3628800.0"), ("2.5 days", "durations", "fixed 216000.0"), ("forty-two months", "durations", "calendar 42.0"), ("3 years", "durations", "calendar 36.0"),
    ("12.5%", "percentages", "0.125"), ("eighty percent", "percentages", "0.8"), ("4 percentage points", "percentages", "0.04"), ("three-quarters", "percentages", "0.75"), ("halfway", "percentages", "0.5"), ("one fifth", "percentages", "0.2"),
    ("37 degrees celsius", "temperatures", "celsius 37.0"), ("451°F", "temperatures", "fahrenheit 451.0"), ("64 KB", "storage", "64.0"), ("two gigabytes", "storage", "2097152.0"), ("1.5 megabytes", "storage", "1536.0"),
    ("18", "numbers", "18.0"), ("0.75", "numbers", "0.75"), ("seventeen", "numbers", "17.0"), ("sixty-one", "numbers", "61.0"), ("hundred five", "numbers", "500.0"),
]
BETWEEN = [" beside ", ", then ", "; later ", " (noted) ", "\nbelow "]


def test_statements_are_found_as_they_were_put_in():
    rng = random.Random(5)
    for _ in range(400):
        chosen = rng.sample(STATEMENTS, rng.randint(0, 8))
        text = "it says " + "".join(s + rng.choice(BETWEEN) for s, _, _ in chosen) + "no more"
        want = {}
        for said, kind, key in chosen:
            want.setdefault(kind, {}).setdefault(key, said)
        got = {k: v for k, v in read_facts(text).items() if v and k != "entities"}
        assert {k: set(v.items()) for k, v in got.items()} == {k: set(v.items()) for k, v in want.items()}, text


@pytest.mark.parametrize(("text", "want"), [
    # an earlier form takes the text, and what reaches into it is dropped
    ("due 2020-02-03 days", {"dates": {"2020-2-3": "2020-02-03"}, "durations": {"fixed 259200.0": "03 days"}}),
    ("5 weeks", {"durations": {"fixed 3024000.0": "5 weeks"}}), ("half 5%", {"percentages": {"0.05": "5%", "0.5": "half"}}),
    ("7%é and 7%", {"percentages": {"0.07": "7%"}, "numbers": {"7.0": "7"}}), ("2,500 seats", {"numbers": {"2.0": "2", "500.0": "500"}}), ("x9 9x", {}), ("４２ hours", {"durations": {"fixed 151200.0": "４２ hours"}}),
    ("two hundred", {"numbers": {"2.0": "two", "100.0": "hundred"}}), ("8 MINUTES", {"durations": {"fixed 480.0": "8 MINUTES"}}), ("8 mınuteſ", {"durations": {"fixed 480.0": "8 mınuteſ"}}),
    ("ten, 10, TEN", {"numbers": {"10.0": "ten"}}), ("1 January 1850 in 1850", {"numbers": {"1.0": "1", "1850.0": "1850"}}),
])
def test_overlaps_and_odd_writing(text, want):
    assert {k: v for k, v in read_facts(text).items() if v and k != "entities"} == want


@pytest.mark.parametrize(("text", "names"), [
    ("Over the Ural Mountains to Lake Baikal", {"over the ural mountains": "Over the Ural Mountains", "lake baikal": "Lake Baikal"}), ("The British's", {"britain": "The British's"}), ("Museum of North Wales", {"museum of north wales": "Museum of North Wales"}), ("Museum of the North", {"museum": "Museum", "north": "North"}),
    ("Japanese or Saudi", {"japan": "Japanese", "saudi arabia": "Saudi"}), ("A B Eight March", {"b eight march": "A B Eight March"}), ("Seven. March. X.", {}), ("Émile", {}), ("O'Hara-Lee", {"o'hara-lee": "O'Hara-Lee"}), ("L'été", {"l'": "L'"}),
])
def test_entities(text, names):
    assert read_facts(text)["entities"] == names


def test_many_facts_take_linear_time():
    text = " ".join(f"{i} days {i}%" for i in range(20_000))
    began = time.perf_counter()
    found = read_facts(text)
    assert len(found["durations"]) == 20_000 and len(found["percentages"]) == 20_000 and not found["numbers"]
    assert time.perf_counter() - began < 5


def test_columns(spark):
    df = spark.createDataFrame([(1, "16 hours at Port Louis"), (2, None), (3, ""), (4, "16 hours, then 960 minutes")], "i int, t string")
    rows = {r["i"]: r["f"] for r in with_facts(df, "t", "f").collect()}
    assert rows[1]["durations"] == (["fixed 57600.0"], ["16 hours"]) and rows[1]["entities"]["k"] == ["port louis"] and rows[4]["durations"]["s"] == ["16 hours"]
    assert all(rows[i][k] == ([], []) for i in (2, 3) for k in ("durations", "numbers", "entities", "dates"))
    assert with_facts(df.where(F.lit(False)), "t", "f").count() == 0


def test_figures():
    assert [figure(x) for x in ("7", "0.50", "Ninety", "thirty three", "zero", "hundred", "hundred-two")] == [7, 0.5, 90, 33, 0, 100, 200]
