"""The evaluation: golden rows, conflicts and agreements, repetition, scoring units, empty and odd input."""

import pytest
from pyspark.sql import functions as F

from gradeloom import config
from gradeloom.operators.report import export_columns
from gradeloom.operators.score import quality, weakest
from gradeloom.operators.semantic import Constant, Encoder, Exact, Jaccard, cosine
from gradeloom.plans.evaluate import evaluate, evaluate_detailed, evaluate_one

SCHEMA = "id string, question string, answer string, expected_answer string, context string"
ASKED = "Which river flows through the city of Lisbon?"
SAMPLE = [
    ("agrees", ASKED, "The Tagus flows through the city of Lisbon.", "Lisbon lies on the Tagus river.", "The Tagus reaches the sea in the west of Lisbon."),
    ("conflicts", ASKED, "The Douro flows through the city of Lisbon.", "The river through Lisbon is the Tagus.", "The Tagus reaches the sea in the west of Lisbon."),
    ("converts", "For how long is a parking permit valid?", "Residents may use the permit for three weeks.", "A permit is valid for 21 days.", "Residents keep a permit for 21 days from the day of issue."),
    ("repeats", "Which metal is liquid at room temperature?", "Which metal is liquid at room temperature?", None, None),
    ("refuses", "Who painted the ceiling of the chapel?", "I cannot answer this question.", "The ceiling was painted by Michelangelo.", "Michelangelo worked on the ceiling for four years."),
    ("spells out", "What is GPS short for?", "Global Positioning System.", "Global Positioning System.", None),
]
GOLDEN = {
    "agrees": (90.0, 90.0, 90.0, 83.33, 89.0, "Pass", "No Error"), "conflicts": (90.0, 25.0, 25.0, 61.67, 46.75, "Fail", "Contradictory Answer"),
    "converts": (90.0, 90.0, 90.0, 83.33, 89.0, "Pass", "No Error"), "repeats": (20.0, None, None, 20.0, 20.0, "Fail", "Incomplete Answer"),
    "refuses": (90.0, 90.0, 90.0, 68.33, 86.75, "Fail", "Unwanted Refusal"), "spells out": (90.0, 90.0, None, 96.67, 91.33, "Pass", "No Error"),
}
SCORES = [c for c in config.RESULT_COLUMNS if c.endswith("_score")]


def test_golden_sample(spark):
    rows = evaluate(spark.createDataFrame(SAMPLE, SCHEMA), Constant(90)).collect()
    assert {r["id"]: (*(r[c] for c in SCORES), r["status"], r["error_type"]) for r in rows} == GOLDEN
    by = {r["id"]: r["improvement_feedback"] for r in rows}
    assert by["conflicts"].startswith('The answer uses "The Douro", while the expected answer uses "Tagus"; this is a named-entity conflict.')
    assert by["repeats"].startswith(config.REPEATS_QUESTION + " Unavailable: correctness (no expected answer); groundedness estimate (no context).")


#: answer, expected, what the comparison must say: conflict kind, or "agrees", or "met" for a short value, or "" for no conflict.
TRIPLES = [
    ("The Douro flows through Lisbon.", "The river of Lisbon is the Tagus.", "named entity"), ("A pass lasts 20 minutes.", "A pass lasts 45 minutes.", "duration"), ("Yes, it is.", "No, it is not.", "polarity"),
    ("About 35% agree.", "About 53% agree.", "percentage"), ("Opened in 1994.", "Opened in 1987.", "date"), ("The motion was accepted.", "The motion was denied.", "polarity"), ("sales increased", "sales decreased", "polarity"),
    ("after three days", "72 hours", "agrees"), ("for 24 months", "two years", "agrees"), ("25 percent", "0.25", "agrees"), ("October 12, 1998", "1998-10-12", "agrees"), ("3rd May 2010", "2010/05/03", "agrees"),
    ("nineteen chairs", "19 chairs", "agrees"), ("The Tagus runs by Lisbon.", "Lisbon is on the Tagus.", "agrees"), ("It melts at 660 degrees Celsius.", "660°C", "agrees"), ("We crossed the Indian Ocean.", "Indian Ocean", "agrees"),
    ("It is mostly carbon dioxide.", "CO2", "agrees"), ("H2O", "plain water", "agrees"), ("forty-eight hours", "two days", "agrees"), ("It has 6 legs.", "It has 8 legs.", "number"), ("There are nine.", "Nine.", "met"), ("It is made of rubber, mostly", "Rubber.", "met"),
    ("OCR is optical character recognition.", "Optical Character Recognition", "agrees"), ("GPS", "Global Positioning System", "agrees"), ("graphical user interface", "GUI", "agrees"), ("Japan", "Japanese", "agrees"), ("Saudi Arabia", "Saudi", "agrees"), ("Britain", "British", "agrees"),
    ("halfway", "50%", "agrees"), ("one quarter", "0.25", "agrees"), ("20 percent", "one fifth", "agrees"), ("three quarters", "half", "percentage"), ("2 gigabytes", "2048 megabytes", "agrees"), ("3 MB", "3 GB", "storage"), ("20°C", "20 degrees Fahrenheit", "temperature"),
    # kept as they are
    ("It was never opened.", "It was never opened.", "polarity"), ("June 3, 2020", "2020", "date"), ("12 months and 0", "365 days", "duration"), ("some 40%", "zero of them", "percentage"),
    ("", "something", ""), ("They don't rust.", "They rust.", "polarity"), ("not only tin", "only", ""),
]


def test_comparisons(spark):
    df = spark.createDataFrame([(str(i), "q", a, e, None) for i, (a, e, _) in enumerate(TRIPLES)], SCHEMA)
    for r in evaluate_detailed(df, Constant(90)).select("__original.id", "against_expected").collect():
        a, e, said = TRIPLES[int(r["id"])]
        c = r["against_expected"]
        kinds = [x["kind"] for x in c["conflicts"]]
        if said == "agrees":
            assert c["agrees"] and not kinds, (a, e, c)
        elif said == "met":
            assert c["short_value_met"] and not kinds, (a, e, c)
        elif said:
            assert kinds and kinds[0] == said, (a, e, c)
        else:
            assert not kinds, (a, e, c)


def test_conflict_order_and_surfaces(spark):
    df = spark.createDataFrame([("1", "q", "It takes 30 days and costs 5.", "It takes 14 days and costs 6.", "It takes 30 days.")], SCHEMA)
    r = evaluate_detailed(df, Constant(90)).first()
    assert [(c["kind"], c["answer_value"], c["reference_value"]) for c in r["against_expected"]["conflicts"]] == [("duration", "30 days", "14 days"), ("number", "5", "6")]
    assert r["against_context"]["agrees"] and r["primary"]["source"] == "expected answer"
    assert r["quality_score"] <= 60 and r["correctness_score"] == 25.0


@pytest.mark.parametrize("answer", [ASKED, ASKED.rstrip("?"), "What is the name of the river that flows through the city of Lisbon?", "The river flows through the city of Lisbon", "The river through Lisbon city flows what."])
def test_question_repetition(spark, answer):
    r = evaluate_one(spark, ASKED, answer, scorer=Constant(100))
    assert (r["status"], r["error_type"]) == ("Fail", "Incomplete Answer") and r["relevance_score"] <= 20


def test_short_supported_answers(spark):
    r = evaluate_one(spark, ASKED, "Tagus.", "Tagus.", scorer=Exact())
    assert r["status"] == "Pass" and r["completeness_score"] >= 90
    r = evaluate_one(spark, "May dogs come in?", "No.", "No.", scorer=Exact())
    assert r["status"] == "Pass"


def test_scoring_units(spark):
    row = spark.createDataFrame([(80.0, None, None, 60.0)], "relevance_score double, correctness_score double, groundedness_score double, completeness_score double")
    assert row.select(quality()).first()[0] == 72.5
    assert row.select(quality({"correctness_score": 1.0})).first()[0] is None
    low = row.select(weakest().alias("w")).first()["w"]
    assert (low["error"], low["metric"], low["score"]) == ("Incomplete Answer", "completeness_score", 60.0)
    tie = spark.createDataFrame([(50.0, 50.0, None, 50.0)], row.schema).select(weakest().alias("w")).first()["w"]
    assert tie["error"] == "Irrelevant Answer"
    none = spark.createDataFrame([(None, None, None, None)], row.schema).select(weakest().alias("w"), quality().alias("q")).first()
    assert none["w"]["metric"] == "completeness_score" and none["w"]["score"] == 0.0 and none["q"] is None
    vectors = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8])], "a array<double>, b array<double>")
    assert vectors.select(cosine("a", "b")).first()[0] == 60.0
    words = spark.createDataFrame([("a b", "b c"), ("", ""), (None, "x")], "l string, r string")
    assert [r[0] for r in words.select(Jaccard().similarity("l", "r")).collect()] == [33.33, 0.0, 0.0]


def test_encoder_scorer(spark):
    class Model:
        def encode(self, texts, normalize_embeddings):
            return [[1.0, 0.0] if "x" in t else [0.6, 0.8] for t in texts]

    df = spark.createDataFrame([("x", "y"), ("x", " "), (None, "y")], "l string, r string")
    assert [r[0] for r in df.select(Encoder(Model).similarity("l", "r")).collect()] == [60.0, 0.0, 0.0]


def test_threshold_and_empty(spark):
    r = evaluate_one(spark, "How are the meeting rooms booked here?", "They are booked by phone every morning before nine.", threshold=99, scorer=Constant(80))
    assert r["status"] == "Fail" and "was the weakest available metric" in r["improvement_feedback"] and "(99)" in r["improvement_feedback"]
    with pytest.raises(ValueError):
        evaluate_one(spark, " ", "a")
    with pytest.raises(ValueError):
        evaluate(spark.createDataFrame([], SCHEMA), threshold=101)
    assert evaluate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd_rows_and_clashing_columns(spark):
    rows = [("1", None, None, None, None, "mine", 5), ("2", "q", "", "", " ", "mine", 5), ("3", "q", "word " * 60_000, None, None, "mine", 5), ("3", "q", "word " * 60_000, None, None, "mine", 5)]
    df = spark.createDataFrame(rows, SCHEMA + ", status string, rules int")
    out = evaluate(df)
    assert out.columns == ["id", "question", "answer", "expected_answer", "context", "rules", *config.RESULT_COLUMNS]
    got = {(r["id"], r["error_type"], r["rules"]) for r in out.collect()}
    assert got == {("1", "Empty Answer", 5), ("2", "Empty Answer", 5), ("3", "Overly Verbose", 5)} or ("3", "Formatting Issue", 5) in got
    assert out.where("status = 'Fail'").count() == 4
    assert export_columns(df).columns[-len(config.RESULT_COLUMNS):] == list(config.RESULT_COLUMNS)


def test_filter_and_join_of_results_stay_small(spark):
    out = evaluate(spark.createDataFrame(SAMPLE, SCHEMA), Constant(90))
    joined = out.where(F.col("status") == "Fail").join(out.select("id", "error_type").withColumnRenamed("error_type", "e"), "id")
    assert joined.count() == 3
    assert len(joined._jdf.queryExecution().optimizedPlan().toString()) < 3_000_000
