"""The evaluation on streams; rows depend on themselves alone, so the same plan serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import config
from gradeloom.functions.text import strip
from gradeloom.plans.evaluate import evaluate


def first_deliveries(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """The first of records that agree in all texts within delay; the state of older ones is dropped."""
    texts = [c for c in (*config.REQUIRED, *config.OPTIONAL) if c in stream.columns and c != "id"]
    key = F.sha2(F.to_json(F.array(*(F.lower(F.coalesce(strip(F.col(c).cast("string")), F.lit(""))) for c in texts))), 256)
    return stream.withWatermark(event_time, delay).withColumn("_key", key).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def evaluate_stream(stream: DataFrame, **options) -> DataFrame:
    """The evaluated stream."""
    return evaluate(stream, **options)


def summary_by_window(results: DataFrame, event_time: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts and average quality of evaluated records by time window; late records count up to delay."""
    window = F.window(event_time, width)
    counted = results.withWatermark(event_time, delay).groupBy(window).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "Pass").alias("passed"), F.avg("quality_score").alias("average_quality"))
    return counted.select(F.col("window.start").alias("window_start"), "total", "passed", "average_quality")
