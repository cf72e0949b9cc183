"""Reports, streams and the driver's contract."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from gradeloom.operators import report
from gradeloom.plans import catalog
from gradeloom.streaming.evaluate import evaluate_stream, first_deliveries, summary_by_window

SCHEMA = "i int, status string, quality_score double, relevance_score double, error_type string, question string, answer string"
ROWS = [(1, "Pass", 88.2, 90.0, "No Error", "q" * 80, " a "), (2, "Fail", 42.25, None, "Incorrect Answer", "q", None), (3, "Fail", 51.0, 50.0, "Custom", "q", ""), (4, None, None, None, None, None, None), (5, "Fail", 42.25, 1.0, "Custom", "q", "b")]


def test_summary(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    s = report.summary(df).first()
    assert (s["total"], s["passed"], s["failed"], s["pass_rate"], s["fail_rate"]) == (5, 1, 4, 20.0, 80.0)
    assert s["average_quality_score"] == 55.9 and s["average_groundedness_score"] is None
    none = report.summary(df.where("false")).first()
    assert (none["total"], none["pass_rate"], none["average_quality_score"]) == (0, 0.0, None)


def test_lists(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [(r[0], r[1]) for r in report.error_counts(df).collect()] == [("Custom", 2), ("Incorrect Answer", 1), ("No Error", 1)]
    assert [r["error_type"] for r in report.error_options(df).collect()] == ["No Error", "Incorrect Answer", "Custom"]
    assert [r["Quality"] for r in report.lowest(df, "i", 4).collect()] == ["42.2", "42.2", "51.0", "88.2"]
    assert report.lowest(df, "i", 0).count() == 0 and report.lowest(df, "i", 1).columns == ["Status", "Quality", "Error Type", "Question", "Answer"]
    assert report.filtered(df, "Fail", "Custom").count() == 2 and report.filtered(df).count() == 5 and report.filtered(df.drop("status"), "Fail").count() == 5
    c = report.compact(df.where("i = 4")).first()
    assert set(c.asDict().values()) == {"N/A"} and len(c) == 7
    assert report.compact(df.where("i = 1")).first()["Status"] == "PASS"
    assert len(report.row_details(df).columns) == 12
    label = df.where("i = 1").select(report.row_label(df, "i")).first()[0]
    assert label == "Row 1 · PASS · " + "q" * 65 + "…"


def test_stream_gives_the_same_rows(spark, tmp_path):
    batch = spark.createDataFrame([(1, "q one", "an answer of six words here"), (2, "q", "n/a"), (3, "Q", "N/A ")], "row_id int, question string, answer string").withColumn("at", F.lit("2025-01-01 10:00:00").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    from gradeloom.plans.evaluate import evaluate

    want = {(r["row_id"], r["quality_score"], r["error_type"]) for r in evaluate(batch).collect()}
    assert {(r["row_id"], r["quality_score"], r["error_type"]) for r in run(evaluate_stream(stream), "append", "evaluated")} == want
    assert len(run(first_deliveries(stream, "at"), "append", "firsts")) == 2
    totals = run(summary_by_window(evaluate_stream(stream), "at"), "complete", "windows")
    assert [(r["total"], r["passed"]) for r in totals] == [(3, sum(r["status"] == "Pass" for r in evaluate(batch).collect()))]


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(catalog.QUERIES) <= set(names)
    assert entry.entry(spark).columns[-1] == "evaluator_version"


def test_adapters(spark):
    from gradeloom.operators.adapters import compare_runs, text_key, with_references, with_vectors

    records = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", None)], "i int, suite string, text string")
    refs = spark.createDataFrame([("a", 5)], "suite string, n int")
    assert {r["i"]: r["n"] for r in with_references(records, refs, "suite", ["n"]).collect()} == {1: 5, 2: None, 3: None}
    vectors = spark.createDataFrame([("x", [1.0])], "t string, embedding array<double>").select(text_key("t").alias("text_key"), "embedding")
    assert {r["i"]: r["v"] for r in with_vectors(records, vectors, {"text": "v"}).collect()} == {1: [1.0], 2: None, 3: None}
    old, new = spark.createDataFrame([(1, "P"), (2, None), (3, "F")], "i int, s string"), spark.createDataFrame([(1, "P"), (2, None), (4, "F")], "i int, s string")
    assert {r["i"]: r["differs"] for r in compare_runs(old, new, "i", ["s"]).collect()} == {1: False, 2: False, 3: True, 4: True}
