"""Records that differ only in formatting or in the column a text sits in, collapsed and counted.

A record's canonical bytes are its texts without whitespace, case and punctuation, in sorted
order. Buckets of equal leading bytes are counted over all records; a bucket that holds too many
is split by further bytes, again and again, until each fits one task. A bucket that cannot be
split because it is one value throughout needs no task at all: its smallest id and its count are
known from the counting. The records of the other buckets meet in one shuffle of as many parts as
their number and their bytes ask for, lie bucket by bucket, and are counted in a trie per bucket
whose leaves carry the counters; a trie is emptied when its bucket ends, so a task never holds more
than one bucket.

Points and commas between digits, a minus sign before a digit and the percent sign are part of a
figure and stay. Defined results: null and empty texts are the same; records whose texts are all
empty are copies of each other; exact repeats count; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Records and canonical bytes that one bucket may hold before it is split.
MOST_RECORDS, MOST_BYTES = 100_000, 64 << 20
#: Leading bytes of the first counting; every further one doubles them.
FIRST_BYTES = 16
#: Bytes by which a trie node branches.
STEP = 16

#: Whitespace and punctuation outside figures.
_DROPPED = r"[\s\p{Z}\p{P}&&[^.,%\-]]+|(?<![0-9])[.,]+|[.,]+(?![0-9])|-(?![0-9])|(?<=[^\s\p{Z}(])-"


def canonical_bytes(columns: Sequence[str]) -> Column:
    """The canonical bytes of a record: its texts, folded, in sorted order."""

    def folded(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), _DROPPED, ""), "ß", "ss")

    return F.array_join(F.sort_array(F.array(*map(folded, columns)), asc=False), "\x01").cast("binary")


def _leading(depth: int) -> Column:
    return F.substring(F.col("canonical"), 1, depth)


class Trie:
    """Counts the records of one bucket; a leaf is [rest of the bytes, count, smallest id]."""

    def __init__(self):
        self.root: dict = {}
        self.ids: list[int] = []
        self.leaves: list[list] = []

    def add(self, rid: int, key: bytes) -> None:
        node, at, part = self.root, STEP, key[:STEP]
        while True:
            child = node.get(part)
            if child is None:
                leaf = node[part] = [key[at:], 1, rid]
                break
            if type(child) is list:
                rest = child[0]
                if rest == key[at:]:
                    child[1] += 1
                    if rid < child[2]:
                        child[2] = rid
                    leaf = child
                    break
                below: dict = {rest[:STEP]: child}
                child[0] = rest[STEP:]
                node[part] = child = below
            node = child
            part = key[at : at + STEP]
            at += STEP
        self.ids.append(rid)
        self.leaves.append(leaf)


def _trie_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a partition, sorted by bucket, with the smallest id and the count of their leaf."""
    trie, current = Trie(), None
    ids: list[int] = []
    leaves: list[list] = []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x[2] for x in leaves], pa.int64()), pa.array([x[1] for x in leaves], pa.int64())], ["row_id", "first_id", "n_copies"])

    for b in batches:
        for bucket, rid, key in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != current:
                ids += trie.ids
                leaves += trie.leaves
                trie, current = Trie(), bucket
                if len(ids) >= 50_000:
                    yield told()
                    ids, leaves = [], []
            trie.add(rid, key)
    ids += trie.ids
    leaves += trie.leaves
    yield told()


def copy_groups(records: DataFrame, key: str, columns: Sequence[str], most_records: int = MOST_RECORDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, first_id, n_copies) of each record: the smallest key among its copies, and how many they are."""
    spark = records.sparkSession
    rows = records.select(F.col(key).cast("bigint").alias("row_id"), canonical_bytes(columns).alias("canonical"))
    depth, open_rows, split, single, total, size = FIRST_BYTES, rows, [], [], 0, 0
    while True:
        counted = open_rows.groupBy(_leading(depth).alias("lead")).agg(
            F.count("*").alias("n"), F.sum(F.length("canonical")).alias("bytes"), F.min("row_id").alias("first_id"),
            (F.min(F.xxhash64("canonical")) == F.max(F.xxhash64("canonical"))).alias("x"), (F.min(F.hash("canonical")) == F.max(F.hash("canonical"))).alias("y"),
        )
        if not split:
            # one job for both: how many records there are, and the buckets too large, of which there are at most total / most
            summary = counted.agg(F.sum("n").alias("total"), F.sum("bytes").alias("size"), F.collect_list(F.when((F.col("n") > most_records) | (F.col("bytes") > most_bytes), F.struct("lead", "n", "first_id", (F.col("x") & F.col("y")).alias("one")))).alias("large")).first()
            total, size, large = summary["total"] or 0, summary["size"] or 0, summary["large"]
        else:
            large = counted.where((F.col("n") > most_records) | (F.col("bytes") > most_bytes)).select("lead", "n", "first_id", (F.col("x") & F.col("y")).alias("one")).collect()
        single += [(depth, bytes(r["lead"]), r["first_id"], r["n"]) for r in large if r["one"]]
        larger = [(bytes(r["lead"]),) for r in large if not r["one"]]
        if not larger:
            break
        split.append((depth, larger))
        open_rows = open_rows.join(spark.createDataFrame(larger, "lead binary"), _leading(depth) == F.col("lead"), "left_semi")
        depth *= 2
    bucket = _leading(FIRST_BYTES)
    for at, larger in split:
        # below a split bucket the next bytes count too
        marks = spark.createDataFrame(larger, f"lead_{at} binary")
        rows = rows.join(marks, _leading(at) == F.col(f"lead_{at}"), "left")
        bucket = F.when(F.col(f"lead_{at}").isNotNull(), _leading(2 * at)).otherwise(bucket)
    rows = rows.select("row_id", "canonical", bucket.alias("bucket"))
    known = None
    if single:
        ones = spark.createDataFrame([(lead, first, n) for _, lead, first, n in single], "bucket binary, first_id bigint, n_copies bigint")
        marked = rows.join(ones, "bucket", "left")
        known = marked.where("n_copies IS NOT NULL").select("row_id", "first_id", "n_copies")
        rows = marked.where("n_copies IS NULL")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most_records), -(-size // most_bytes))
    met = rows.repartition(parts, "bucket").sortWithinPartitions("bucket").select("bucket", "row_id", "canonical").mapInArrow(_trie_counts, "row_id bigint, first_id bigint, n_copies bigint")
    return (met.unionByName(known) if known is not None else met).withColumnRenamed("row_id", key)


def further_copies(records: DataFrame, key: str, columns: Sequence[str], **limits) -> DataFrame:
    """(row_id_a, row_id_b): the smallest key of a group and each further copy."""
    return copy_groups(records, key, columns, **limits).where(F.col(key) != F.col("first_id")).select(F.col("first_id").alias("row_id_a"), F.col(key).alias("row_id_b"))
