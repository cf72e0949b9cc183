"""Validation, sources, sinks, parsed lines and quantities."""

import pytest
from pyspark.sql import functions as F

from gradeloom import config
from gradeloom.operators.rules import with_findings
from gradeloom.operators.units import to_common_units
from gradeloom.operators.validate import ERROR, validate
from gradeloom.sources.files import fingerprint, read_csv, write_csv, write_parquet
from gradeloom.sources.lines import parse_lines, split_lines

RECORD = "row_id bigint, question string, answer string, expected_answer string, context string"


def test_counts_and_reasons(spark):
    df = spark.createDataFrame([("Q1", "A1", "1", 0), (" q1", "a1 ", "2", 1), ("Q2", "", "3", 2), ("q2", None, "4", 3)], "Question string, ` Answer ` string, id string, n int")
    v = validate(df, "n")
    assert v.counts.first().asDict() == {"total_rows": 4, "valid_rows": 1, "invalid_rows": 3, "empty_required_values": 2, "duplicate_rows": 2}
    assert {r["id"]: r[ERROR] for r in v.invalid.collect()} == {"2": "Duplicate row", "3": "Empty required value(s): answer", "4": "Empty required value(s): answer; Duplicate row"}
    assert v.can_evaluate() and [r["id"] for r in v.valid.collect()] == ["1"]


def test_texts_stay_out_of_the_shuffle(spark):
    df = spark.createDataFrame([(1, "q", "a", None, None)], RECORD)
    plan = validate(df, "row_id").counts._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line]
    assert exchanges and "question" not in validate(df, "row_id").counts._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_sample_and_mode(spark, monkeypatch):
    from gradeloom.sources.sample import mode, sample_records

    rows = sample_records(spark).collect()
    assert len(rows) == 6 and rows[3]["expected_answer"] is None and validate(sample_records(spark)).can_evaluate()
    monkeypatch.delenv("APP_MODE", raising=False)
    assert [mode(), mode({"APP_MODE": " Demo "}), mode({"APP_MODE": "other"})] == ["local", "demo", "local"]
    monkeypatch.setenv("APP_MODE", "demo")
    assert mode({"APP_MODE": "local"}) == "demo"


def test_missing_and_clashing_columns(spark):
    v = validate(spark.createDataFrame([("q",)], "question string"))
    assert v.missing == ["answer"] and not v.can_evaluate() and v.counts.first()["valid_rows"] == 0
    assert v.invalid.first()[ERROR] == "Missing required column(s): answer"
    with pytest.raises(ValueError):
        validate(spark.createDataFrame([("q", "r")], "Question string, `question ` string"))
    empty = validate(spark.createDataFrame([], "question string, answer string"))
    assert not empty.can_evaluate() and empty.counts.first()["empty_required_values"] == 0


def test_placeholders_stay_literal(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('question,answer\nq1,N/A\nq2,"NA"\nq3,None\nq4,\n"q ""5""\nmore",x\n')
    df = read_csv(spark, str(p))
    assert [r["answer"] for r in df.orderBy("_row_id").collect()] == ["N/A", "NA", "None", None, "x"]
    assert validate(df).counts.first()["valid_rows"] == 4
    assert len(fingerprint(spark, str(p)).first()["sha256"]) == 64
    write_csv(df, str(tmp_path / "out"))
    write_parquet(df, str(tmp_path / "out2"))
    back = read_csv(spark, str(tmp_path / "out"))
    assert back.columns[:2] == ["question", "answer"] and set(config.RESULT_COLUMNS) <= set(back.columns) and back.count() == 5


RULES = {
    "empty": ["", " \t　"], "placeholder": ["N/A", "tbd!", "No answer."], "unwanted_refusal": ["As an AI I see.", "Sorry, I can't do it"], "formatting_problem": ["what!!!!", "THESE WORDS SHOUT LOUDLY", "x" * 501],
    "excessive_repetition": ["a. a. a.", "word " * 13], "excessively_verbose": ["w%d " * 351], "extremely_short": ["two words"], "question_repetition": ["What is it called", "is it called?"],
}


def test_findings(spark):
    rows = [(k, "What is it called?", a) for k, v in RULES.items() for a in v]
    for r in with_findings(spark.createDataFrame(rows, "k string, question string, answer string")).collect():
        assert r["rules"][r["k"]], r
    fine = with_findings(spark.createDataFrame([("q", "It runs well on every day of the week"), (None, None)], "question string, answer string")).collect()
    assert fine[0]["rules"]["penalty"] == 0 and fine[0]["rules"]["word_count"] == 9 and fine[1]["rules"]["empty"]
    curly = with_findings(spark.createDataFrame([("q", "I can’t say this at all")], "question string, answer string")).first()
    assert not curly["rules"]["unwanted_refusal"]


GOOD = '"a","q","x ""y"", z\nn","","",,2024-02-29 10:00:00'
LINES = {
    GOOD: None, "i,q,a,e,c,50,2025-01-31 00:00:00": None, "i,q,a,e,c,100,2025-01-31 00:00:00,extra": "column_count", "": "column_count", None: "column_count", "i;q;a": "column_count",
    'i,q"x,a,e,c,1,2025-01-31 00:00:00': "bad_quoting", '"i,q,a,e,c,1,2025-01-31 00:00:00': "bad_quoting", '"i"x,q,a,e,c,1,2025-01-31 00:00:00': "bad_quoting", 'i,q\na,e,c,1,2025-01-31 00:00:00,"': "bad_quoting",
    "i, ,a,e,c,1,2025-01-31 00:00:00": "bad_value", "i,q,a,e,c,101,2025-01-31 00:00:00": "bad_value", "i,q,a,e,c,-1,2025-01-31 00:00:00": "bad_value", "i,q,a,e,c,7O,2025-01-31 00:00:00": "bad_value",
    "i,q,a,e,c," + "9" * 40 + ",2025-01-31 00:00:00": "bad_value", "i,q,a,e,c,1,2025-02-29 00:00:00": "bad_value", "i,q,a,e,c,1,2025-04-31 00:00:00": "bad_value", "i,q,a,e,c,1,2025-01-01 24:00:00": "bad_value", "i,q,a,e,c,1,": "bad_value",
    'i,q,"' + "long " * 100_000 + '",e,c,1,2025-01-31 00:00:00': None,
}


def test_lines(spark):
    lines = list(LINES)
    df = spark.createDataFrame([(i, x, "mine") for i, x in enumerate(lines)] + [(0, GOOD, "mine")], "line_id bigint, raw_line string, question string")
    got = parse_lines(df).collect()
    assert len(got) == len(lines) + 1
    for r in got:
        assert r["reason"] == LINES[lines[r["line_id"]]], lines[r["line_id"]]
    assert [r["answer"] for r in got if r["line_id"] == 0] == ['x "y", z\nn'] * 2
    good, bad = split_lines(df)
    assert good.count() == 4 and bad.columns == ["line_id", "reason"]
    assert parse_lines(df.where(F.lit(False))).count() == 0


UNITS = [
    ("q", "It weighs 1 kg 701 g.", 1701.0), ("q", "16632 h", 16632 * 3600.0), ("q", "six days", 518400.0), ("q", "eight and a half kilometres", 8.5e6), ("q", "It takes half an hour.", 1800.0), ("q", "half a litre", 500.0), ("How long; in seconds?!", "555", 555.0), ("q", "half of them", None), ("q", "5.4 thousand fl oz", 5400 * 29.5735295625),
    ("Wie lang?", "33.060 Minuten", 33060 * 60.0), ("Wie schwer?", "184,3 Gramm", 184.3), ("Quelle longueur?", "7 620 centimètres", 76200.0), ("q", "1,219 millimeters", 1219.0), ("q", "１２ ｋｇ", 12000.0), ("q", "5632‌ ﻿KB", 5632.0),
    ("q", "36864 КВ", 36864.0), ("q", "212 °F", 100.0), ("q", "-5 °C", -5.0), ("q", "300 kelvin", 26.85), ("q", "18ft", 18 * 304.8), ("q", "2 hours and 30 minutes", 9000.0), ("q", "9.45 in", 9.45 * 25.4),
    ("How heavy (answer in metric tons)?", "0.16", 160000.0), ("How long, in seconds?", "The figure is 555.", 555.0), ("q", "Unit used by X: minutes. Entry refund, value 22,560.", 22560 * 60.0), ("q", "X inventory (seconds): appeal = 3720.", 3720.0),
    ("q", "opened in 1898", None), ("q", "815 forms in 1900 to X", None), ("q", "page 20 and later", None), ("q", "", None), ("q", None, None), ("q", "no number here", None), (None, "3 kg", 3000.0),
]


def test_units(spark):
    targets = spark.createDataFrame([(q, "u") for q in ("mass", "length", "duration", "temperature", "volume", "storage")], "quantity string, common_unit string")
    df = spark.createDataFrame([(i, q, a, None, None, 1) for i, (q, a, _) in enumerate(UNITS)], RECORD + ", quantity int")
    got = {r["row_id"]: r["amount"] for r in to_common_units(df, targets, every=False).collect()}
    several = {(r["row_id"], r["place"]): r["amount"] for r in to_common_units(df, targets).collect()}
    assert {i: a for (i, place), a in several.items() if place == 0} == got
    for i, (q, a, want) in enumerate(UNITS):
        assert (i in got) == (want is not None), (q, a, got.get(i))
        assert want is None or got[i] == pytest.approx(want, rel=1e-9), (q, a, got[i])
    both = spark.createDataFrame([(1, "q", "First 3 m, then 250 g after 2 h.", None, None)], RECORD)
    assert [(r["place"], r["amount"]) for r in to_common_units(both, targets).orderBy("place").collect()] == [(0, 3000.0), (1, 250.0), (2, 7200.0)]
    other = spark.createDataFrame([(1, "q", "5400", "3 m", "All figures on this sheet are in grams. The line reads 5400.")] * 2, RECORD)
    rows = sorted((r["field_name"], r["amount"]) for r in to_common_units(other, targets).collect())
    assert rows == [("answer", 5400.0)] * 2 + [("context", 5400.0)] * 2 + [("expected_answer", 3000.0)] * 2
    assert to_common_units(df.where("false"), targets).count() == 0
    assert to_common_units(df, targets.where("quantity = 'mass'")).where("quantity <> 'mass'").count() == 0
