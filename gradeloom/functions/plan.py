"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns added or replaced, each computed once and here.

    Later filters, joins and projections would otherwise be rewritten over everything the columns
    are made of, and a chain of columns that each use earlier ones several times grows beyond any
    bound. A value that the optimizer must not move, the number of the partition, is put beside the
    new columns in one struct; the other columns pass by. Nothing is shuffled or stored.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    packed = df.select(*kept, F.struct(*(c.alias(n) for n, c in columns.items()), F.spark_partition_id().alias("__partition")).alias("__computed"))
    return packed.select(*kept, *(F.col("__computed").getField(n).alias(n) for n in columns))


def spread(df: DataFrame) -> DataFrame:
    """A plain scan of fewer partitions than there are cores, spread over all of them; others as they are.

    A small file of one row group is one task's work whatever the number of cores. Large inputs
    have partitions enough and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df
