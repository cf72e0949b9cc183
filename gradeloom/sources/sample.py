"""The bundled sample: six records, one for each outcome that the evaluation is first shown on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SAMPLE = Path(__file__).with_name("sample.csv")
COLUMNS = "id string, question string, answer string, expected_answer string, context string"


def sample_records(spark: SparkSession) -> DataFrame:
    """The sample, read by the driver: executors need not have the file."""
    import pandas as pd

    rows = pd.read_csv(SAMPLE, dtype=str, keep_default_na=False)
    return spark.createDataFrame([tuple(v or None for v in r) for r in rows.itertuples(index=False)], COLUMNS)


def mode(settings: dict[str, str] | None = None) -> str:
    """Where no input is given: "demo" takes the sample, "local", the default, asks for input. The environment goes before settings."""
    told = os.environ.get("APP_MODE", (settings or {}).get("APP_MODE")) or ""
    return "demo" if told.strip().lower() == "demo" else "local"
