"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

Rows fall into a fixed number of virtual partitions by a hash of all their columns and their place,
so that equal rows part. From the counts per partition alone the driver draws how many rows each
partition sends to each block of slots (a matrix of bounded size, row by row multivariate
hypergeometric: the law of a uniform permutation). Each partition permutes its rows by a second hash
and deals them out by that matrix; each block permutes what it gets by a third hash. A shard is a run
of whole blocks. A rank by hash within a partition or block is that within a range of the hash plus
the counts of the ranges before it, so that no task holds more than CELL_ROWS rows or so at any size.
Law: rows (shard counts at most one apart).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import prepare, store, without

SHARDS = 24
#: Virtual partitions, rows a block should hold, and the most blocks of a shard: they bound the
#: matrix at PARTITIONS * SHARDS * MOST_BLOCKS cells (about a million) at any input size.
PARTITIONS, BLOCK_ROWS, MOST_BLOCKS = 1024, 20_000, 40
#: Rows that a window holds, on average; rows of offsets that are still broadcast.
CELL_ROWS, MOST_BROADCAST = 100_000, 200_000
ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def block_sizes(rows: int, shards: int, block_rows: int, most: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, size) of each block: shard sizes at most one apart, block sizes too."""
    out = []
    for shard in range(shards):
        size = rows // shards + (shard < rows % shards)
        n = min(most, max(1, -(-size // block_rows)))
        at = 0
        for b in range(n):
            part = size // n + (b < size % n)
            out.append((shard, at, part))
            at += part
    return out


def communication_matrix(counts: list[int], blocks: list[int], seed: int) -> np.ndarray:
    """Row p: how many of partition p's rows go to each block, drawn without replacement."""
    rng, free = np.random.default_rng(seed), np.array(blocks, dtype=np.int64)
    out = np.zeros((len(counts), len(blocks)), dtype=np.int64)
    for p, n in enumerate(counts):
        left, pool = int(n), int(free.sum())
        for b in range(len(blocks)):  # one hypergeometric draw a cell: any population size
            if left == 0:
                break
            pool -= int(free[b])
            got = left if pool == 0 else int(draw(rng, int(free[b]), pool, left))
            out[p, b], left = got, left - got
        free -= out[p]
    return out


def draw(rng: np.random.Generator, good: int, bad: int, n: int, limit: int = 1_000_000_000) -> int:
    """Hypergeometric, exact at any size; numpy's own below its limit.

    Beyond it, give each item a uniform number and look at those below n / (good + bad): two
    binomials. They are a uniform subset of some size near n, and a uniform draw among the rest (or
    among themselves) makes up the small difference.
    """
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    total = good + bad
    if total < limit:
        return int(rng.hypergeometric(good, bad, n))
    if 2 * n > total:
        return good - draw(rng, good, bad, total - n, limit)
    if n <= 64:
        got = 0
        for k in range(n):
            got += int(rng.integers(total - k) < good - got)
        return got
    x, y = int(rng.binomial(good, n / total)), int(rng.binomial(bad, n / total))
    if x + y <= n:
        return x + draw(rng, good - x, bad - y, n - x - y, limit)
    return x - draw(rng, x, y, x + y - n, limit)


def ranked(rows: DataFrame, group: str, by: str, per_group: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows with _rank: their place (from 0) by a 64-bit hash within the group, in windows of about cell_rows rows.

    rows: a stored table. per_group: rows of a group, on average.
    """
    bits = max(0, int(np.ceil(np.log2(max(1.0, per_group / cell_rows)))))
    if not bits:
        return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(by)) - 1)
    cell = F.shiftrightunsigned(F.col(by).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)  # in the order of the signed hash
    celled = rows.withColumn("_cell", cell)
    counts = celled.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(counts.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets").df
    if offsets.count() <= MOST_BROADCAST:
        offsets = F.broadcast(offsets)
    own = Window.partitionBy(group, "_cell").orderBy(by)
    return celled.join(offsets, [group, "_cell"]).withColumn("_rank", F.row_number().over(own) - 1 + F.col("_before")).drop("_cell", "_before")


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 10, columns: list[str] | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (null).

    Null text: size 8, checksum of no bytes. Repeated rows are rows of their own and part like all
    others. Empty input: no rows. Input columns named like an added one give way to it. columns:
    those of docs to return (default all), of any type; the others don't cross the exchanges.
    """
    spark = prepare(docs.sparkSession)
    base = without(docs, ADDED)
    shown = columns or base.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = base.select(
        *[F.col(f"`{c}`") for c in shown],
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", "text", F.monotonically_increasing_id()).alias("_deal"),
    )
    keyed = store(keyed.withColumn("_part", F.pmod(F.xxhash64("_deal"), F.lit(PARTITIONS)).cast("int")), "keyed").df
    counted = {r["_part"]: r["n"] for r in keyed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # PARTITIONS rows at most
    counts = [counted.get(p, 0) for p in range(PARTITIONS)]
    rows = sum(counts)
    blocks = block_sizes(rows, shards, BLOCK_ROWS, MOST_BLOCKS)
    ends = communication_matrix(counts, [b[2] for b in blocks], seed).cumsum(axis=1)
    matrix = spark.createDataFrame([(p, ends[p].tolist()) for p in range(PARTITIONS)], "_part int, _ends array<bigint>")
    starts = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(at).cast("long").alias("at")) for s, at, _ in blocks])
    dealt = ranked(keyed, "_part", "_deal", rows / PARTITIONS, cell_rows).join(F.broadcast(matrix), "_part")
    dealt = dealt.withColumn("_block", F.size(F.filter("_ends", lambda e: e <= F.col("_rank")))).drop("_ends", "_rank", "_part").withColumn("_mix", F.xxhash64(F.lit(seed + 1), "_deal"))
    per_block = rows / len(blocks)
    if per_block > cell_rows:  # the ranks are asked for twice
        dealt = store(dealt, "dealt").df
    placed = ranked(dealt, "_block", "_mix", per_block, cell_rows).withColumn("_at", F.element_at(starts, F.col("_block") + 1))
    return placed.select(
        *[F.col(f"`{c}`") for c in shown],
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_at.s").cast("int").alias("shard"),
        (F.col("_at.at") + F.col("_rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
