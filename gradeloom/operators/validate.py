"""Validation of an uploaded dataset: missing columns, blanks, duplicates.

Defined results: headers are matched without case and outer spaces, two that then agree are an
error; null and blank texts are empty; of records that agree in all texts but ``id``, without
case and outer spaces, the one of the smallest row id stays; an empty table is valid and cannot
be evaluated; columns that are not declared are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gradeloom import config
from gradeloom.functions.text import strip

ROW_ID = "_row_id"
ERROR = "_validation_error"


def normal_headers(df: DataFrame) -> DataFrame:
    """df with stripped lower-case column names."""
    names = [c.strip().lower() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns agree without case and spaces: {', '.join(twice)}")
    return df.toDF(*names)


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in config.REQUIRED if c not in df.columns]


@dataclass
class Validation:
    """The rows by validity, lazily, and a one-row frame of counts."""

    tagged: DataFrame
    missing: list[str]

    @property
    def valid(self) -> DataFrame:
        return self.tagged.where("NOT _empty AND NOT _duplicate").drop("_empty", "_duplicate", "_n_empty", ERROR)

    @property
    def invalid(self) -> DataFrame:
        return self.tagged.where("_empty OR _duplicate").drop("_empty", "_duplicate", "_n_empty")

    @property
    def counts(self) -> DataFrame:
        bad = F.col("_empty") | F.col("_duplicate")
        if self.missing:
            return self.tagged.agg(F.count("*").alias("total_rows"), F.lit(0).cast("bigint").alias("valid_rows"), F.count("*").alias("invalid_rows"), F.lit(0).cast("bigint").alias("empty_required_values"), F.lit(0).cast("bigint").alias("duplicate_rows"))
        return self.tagged.agg(
            F.count("*").alias("total_rows"), F.count_if(~bad).alias("valid_rows"), F.count_if(bad).alias("invalid_rows"),
            F.coalesce(F.sum("_n_empty"), F.lit(0)).cast("bigint").alias("empty_required_values"), F.count_if("_duplicate").alias("duplicate_rows"),
        )

    def can_evaluate(self) -> bool:
        """Whether no required column is missing and there is a valid row."""
        return not self.missing and not self.valid.isEmpty()


def validate(df: DataFrame, row_id: str = ROW_ID) -> Validation:
    """df's rows tagged with what is wrong with them; row_id gives their order, and is made where df lacks it."""
    frame = normal_headers(df)
    row_id = row_id.lower()
    if row_id not in frame.columns:
        frame = frame.withColumn(row_id, F.monotonically_increasing_id())
    missing = missing_columns(frame)
    if missing:
        said = F.lit("Missing required column(s): " + ", ".join(missing))
        return Validation(frame.withColumns({"_empty": F.lit(True), "_duplicate": F.lit(False), "_n_empty": F.lit(0), ERROR: said}), missing)
    blank = {c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) == "" for c in config.REQUIRED}
    compared = [F.lower(F.coalesce(strip(F.col(c).cast("string")), F.lit(""))) for c in (*config.REQUIRED, *config.OPTIONAL) if c in frame.columns and c != "id"]
    names = F.array_compact(F.array(*(F.when(b, c) for c, b in blank.items())))
    # a key of fixed size, and all else that comes from the texts, before the join: what needs no texts afterwards joins without them
    frame = frame.withColumns({
        "_key": F.unhex(F.sha2(F.to_json(F.array(*compared)), 256)), "_empty": blank["question"] | blank["answer"], "_n_empty": sum(b.cast("int") for b in blank.values()),
        "_said": F.when(F.size(names) > 0, F.concat(F.lit("Empty required value(s): "), F.array_join(names, ", "))),
    })
    # only keys that repeat come back, so a key that many rows share is combined before the shuffle
    repeated = frame.groupBy("_key").agg(F.min(row_id).alias("_first"), F.count("*").alias("_times")).where("_times > 1").drop("_times")
    frame = frame.join(repeated, "_key", "left").withColumn("_duplicate", F.coalesce(F.col(row_id) > F.col("_first"), F.lit(False)))
    reason = F.concat_ws("; ", "_said", F.when(F.col("_duplicate"), "Duplicate row"))
    return Validation(frame.withColumn(ERROR, F.nullif(reason, F.lit(""))).drop("_key", "_first", "_said"), [])
