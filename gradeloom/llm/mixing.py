"""Sources combined so that each supplies its target share of all tokens.

Documents are counted by source and exact token length. Each source's budget is its share of the
total; whole rounds of a source come first, then every length gets its part of what remains, and
a bounded-knapsack dynamic program over the lengths fills the rest to the token, or as near below
it as any choice of documents comes. Which documents of a length are taken is decided by a seeded
hash, so the same seed gives the same mixture.

Only the counts by length reach the driver, as many as there are different lengths. A length that
very many documents share is first split into slots by the same hash, so that no task ranks all
of them. Defined results: null, empty and wordless texts, null sources and sources without a
target are not used; a source that cannot fill its part even at its cap bounds the total, or,
under a given total, supplies all it may; a target without documents gets 0 tokens and does not
bound the total; an empty table gives an empty mixture.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.sources.shared import checkpointed

#: Folder of the tokenizer files, and the file.
TOKENIZERS, TOKENIZER = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: how that tokenizer cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one length that one task may rank.
MOST_RANKED = 200_000
#: Tokens, at least, that are left to the dynamic program.
PLANNED = 4096


@functools.lru_cache(2)
def _encoder(folder: str, name: str):
    """The tokenizer of this Python worker."""
    import base64

    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_counts(documents: DataFrame, key: str, text: str, carried: list[str], folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(key, carried columns, n_tokens) of each document."""
    kept = documents.select(key, *carried, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(folder, name)
        for b in batches:
            n = [len(encode(t)) if t and not t.isspace() else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [key, *carried, "n_tokens"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    return kept.mapInArrow(run, f"{types}, n_tokens bigint")


@dataclass
class Plan:
    """How often each document of a length is used: rounds times, and extra of them once more."""

    rounds: int
    extra: dict[int, int]
    tokens: int


def fill(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents to take of each length, at most counts, to come nearest to budget from below."""
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    # each length's part, less a little, so that the dynamic program has documents to choose from
    taken = {n: c * budget // total for n, c in counts.items()}
    left = budget - sum(n * c for n, c in taken.items())
    lengths = sorted(counts, reverse=True)
    reserve = max(PLANNED, 2 * sorted(counts)[len(counts) // 2])
    for n in lengths:
        more = max(0, min(counts[n] - taken[n], (left - reserve) // n))
        taken[n] += more
        left -= more * n
    spare = min((n for n in lengths if taken[n]), default=0)
    while left < reserve // 2 and spare:
        # too little left to choose from: give some of the shortest back
        back = min(taken[spare], -(-(reserve // 2 - left) // spare))
        taken[spare] -= back
        left += back * spare
        spare = min((n for n in lengths if taken[n]), default=0)
    # bounded knapsack: bit t of reach says that t tokens can be taken; counts go by powers of two
    keep = (1 << (left + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        free, k = min(counts[n] - taken[n], left // n), 1
        while free > 0:
            k = min(k, free)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & keep
            free -= k
            k *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n] += k
            at -= n * k
    return taken


def plan_source(counts: dict[int, int], budget: int, most: int) -> Plan:
    """The use of one source's documents for budget tokens with no document used more than most times."""
    total = sum(n * c for n, c in counts.items())
    if not total or most < 1 or budget <= 0:
        return Plan(0, {}, 0)
    budget = min(budget, most * total)
    rounds = budget // total
    extra = {n: c for n, c in fill(counts, budget - rounds * total).items() if c} if budget > rounds * total else {}
    return Plan(rounds, extra, rounds * total + sum(n * c for n, c in extra.items()))


def budgets(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None) -> dict[str, int]:
    """Whole tokens for each source; without a total the largest that no cap bounds."""
    usable = {s: (share, most) for s, (share, most) in targets.items() if totals.get(s) and share and share > 0 and most and most > 0}
    if not usable:
        return {}
    if total is None:
        total = int(min(most * totals[s] / share for s, (share, most) in usable.items()))
    exact = {s: share * total for s, (share, _) in usable.items()}
    whole = {s: int(x) for s, x in exact.items()}
    missing = round(sum(exact.values())) - sum(whole.values())
    for s in sorted(exact, key=lambda s: (whole[s] - exact[s], s))[: max(0, missing)]:
        whole[s] += 1
    return {s: min(whole[s], usable[s][1] * totals[s]) for s in whole}


def mixture(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, seed: int = 7, most_ranked: int = MOST_RANKED, folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(key, source, n_tokens, n_uses) of the documents used; n_uses says how many times."""
    spark = documents.sparkSession
    wanted = {r[0]: (r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").collect()}
    counted = token_counts(documents.where(F.col(source).isin(list(wanted))), key, text, [source], folder, name)
    counted = checkpointed(counted.withColumnRenamed(source, "source").where("n_tokens > 0"))
    lengths: dict[str, dict[int, int]] = {}
    for r in counted.groupBy("source", "n_tokens").count().collect():
        lengths.setdefault(r[0], {})[r[1]] = r[2]
    budget = budgets({s: sum(n * c for n, c in x.items()) for s, x in lengths.items()}, wanted, total)
    slots, rows = [], []
    for s, b in budget.items():
        p = plan_source(lengths[s], b, wanted[s][1])
        for n, c in lengths[s].items():
            extra = p.extra.get(n, 0)
            if p.rounds or extra:
                parts = -(-c // most_ranked) if 0 < extra < c else 1
                rows.append((s, n, p.rounds, extra, c, parts))
                if parts > 1:
                    slots.append((s, n, extra))
    schema = "source string, n_tokens bigint, rounds bigint, extra bigint, n bigint, parts int"
    planned = counted.join(spark.createDataFrame(rows, schema), ["source", "n_tokens"])
    planned = planned.withColumn("draw", F.xxhash64(F.lit(seed), F.col(key))).withColumn("slot", F.pmod(F.col("draw"), F.col("parts")))
    if slots:
        # slots of a length are used up one after another; only in one of them some are taken and some left
        left = {(s, n): extra for s, n, extra in slots}
        quota = []
        for r in planned.where("parts > 1").groupBy("source", "n_tokens", "slot").count().orderBy("source", "n_tokens", "slot").collect():
            take = min(left[r[0], r[1]], r[3])
            left[r[0], r[1]] -= take
            quota.append((r[0], r[1], r[2], take, r[3]))
        quotas = spark.createDataFrame(quota, "source string, n_tokens bigint, slot bigint, slot_extra bigint, slot_n bigint")
        planned = planned.join(quotas, ["source", "n_tokens", "slot"], "left").withColumns({"extra": F.coalesce("slot_extra", "extra"), "n": F.coalesce("slot_n", "n")})
    whole = planned.where("extra = 0 OR extra >= n").withColumn("once_more", (F.col("extra") > 0).cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "slot").orderBy("draw", key))
    part = planned.where("extra > 0 AND extra < n").withColumn("once_more", (rank <= F.col("extra")).cast("bigint"))
    used = whole.unionByName(part).withColumn("n_uses", F.col("rounds") + F.col("once_more"))
    return used.where("n_uses > 0").select(key, "source", "n_tokens", "n_uses")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_documents, n_tokens, share) reached by a mixture."""
    by_source = mixed.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n_tokens"))
    # one row for each target
    joined = targets.select("source", "target_share").join(by_source, "source", "left").withColumn("all_tokens", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))
    n = F.coalesce("n_tokens", F.lit(0))
    return joined.select("source", "target_share", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), n.alias("n_tokens"), F.coalesce(n / F.col("all_tokens"), F.lit(0.0)).alias("share"))
