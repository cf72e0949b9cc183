"""Files of records: CSV in, CSV and Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.operators.report import export_columns
from gradeloom.operators.validate import ROW_ID


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files with a header, every field as text, quoted line breaks kept, and a row id in file order.

    Literal placeholders such as N/A stay; a file that does not parse raises when it is read.
    """
    options = dict(header=True, inferSchema=False, multiLine=True, escape='"', nullValue="", encoding="UTF-8", mode="FAILFAST")
    return spark.read.options(**options).csv(path).withColumn(ROW_ID, F.monotonically_increasing_id())


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file: whether an upload is the same one."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_csv(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The exported columns as CSV, nulls as empty fields."""
    out = export_columns(results)
    out = out.drop(ROW_ID) if ROW_ID in out.columns else out
    out.write.mode(mode).options(header=True, escape='"', emptyValue="", nullValue="", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_parquet(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The exported columns as Parquet."""
    export_columns(results).write.mode(mode).parquet(path)
