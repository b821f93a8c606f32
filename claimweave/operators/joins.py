"""Joins that no frequent key slows down: on terms of any frequency, by shared terms, and to the last earlier row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import store

#: Terms of one side that are still shared with all tasks as an index; beyond it rows meet term by term.
MOST_INDEXED = 2_000_000
#: Pairs counted at a time in a task, and pairs held before only the best of each left row stay.
CELLS, HELD = 1 << 22, 1 << 20


def met_on_terms(a: DataFrame, b: DataFrame, on: str = "term", block: int = 10_000) -> DataFrame:
    """a join b on a term. Rows of b without a term of a are dropped before they move, and frequent terms are cut into blocks of b."""
    asked = store(a, "asked-terms").df
    terms = store(asked.select(on).distinct(), "terms").df
    named = F.broadcast(terms) if terms.count() <= 500_000 else terms
    held = store(b.join(named, on, "left_semi"), "held-terms").df
    crowded = store(held.groupBy(on).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).where("_blocks > 1"), "crowded-terms").df
    if crowded.isEmpty():
        return asked.join(held, on)
    few = F.broadcast(crowded) if crowded.count() <= 100_000 else crowded
    blocks = F.coalesce(F.col("_blocks"), F.lit(1))
    left = asked.join(few, on, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    right = held.join(few, on, "left").withColumn("_block", F.pmod(F.xxhash64(*held.columns), blocks).cast("int")).drop("_blocks")
    return left.join(right, [on, "_block"]).drop("_block")


def last_before(rows: DataFrame, keys: list[str], order: str, told: Column) -> DataFrame:
    """rows with _last: what the last row of the same keys and a smaller order tells (told; null tells nothing).

    A scan over ranges of (keys, order): each range is worked off by itself, and begins with what the
    last one before it told. So a key with most of the rows costs no more than any other. Rows of one order
    don't see each other; null keys are a key; of several that tell at the last order, the greatest counts.
    """
    spread = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    marked = rows.withColumn("_told", told)
    says = marked.where("_told is not null").select(*keys, order, F.lit(1).alias("_role"), "_told", F.lit(None).cast(marked.select(F.struct(*[f"`{c}`" for c in rows.columns])).schema[0].dataType).alias("_row"))
    asks = marked.select(*keys, order, F.lit(0).alias("_role"), F.lit(None).cast(says.schema["_told"].dataType).alias("_told"), F.struct(*[f"`{c}`" for c in rows.columns]).alias("_row"))
    line = [*keys, order, "_role", "_told"]
    ranged = store(asks.unionByName(says).repartitionByRange(spread, *line).withColumn("_part", F.spark_partition_id()), "ranges").df
    said = F.struct(*keys, order, "_told")
    ends = ranged.where("_role = 1").groupBy("_part").agg(F.max(said).alias("_end"))  # a row for each range
    parts = ranged.select("_part").distinct().join(ends, "_part", "left")
    carried = parts.select("_part", F.max("_end").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    so_far = Window.partitionBy("_part").orderBy(*line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("_seen", F.last(F.when(F.col("_role") == 1, said), ignorenulls=True).over(so_far)).where("_role = 0").join(F.broadcast(carried), "_part")
    last = F.coalesce("_seen", "_carried")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_near.{k}").eqNullSafe(F.col(k))
    return seen.withColumn("_near", last).select("_row.*", F.when(same, F.col("_near._told")).alias("_last"))


def best_overlaps(left: DataFrame, right: DataFrame, top: int, score: Callable, least: int = 1, least_score: float = 0.0) -> DataFrame:
    """left_id, right_id, shared, score, place: for each left row the top right rows by score, shared terms, weight, id.

    left, right: id (whole number), terms (array); right may have weight. score(shared, n_left, n_right)
    works on Columns and on arrays alike; pairs need least shared terms and least_score. Exact. If the left
    side's terms are few enough, an index of them goes to all tasks, which count what each right row
    shares with all left ones and keep their own best: neither the right rows nor pairs are
    shuffled. Else rows meet term by term.
    """
    weight = F.col("weight") if "weight" in right.columns else F.lit(0)
    bare = F.array_distinct(F.coalesce("terms", F.array()))
    a = store(left.select(F.col("id").cast("long").alias("left_id"), bare.alias("terms")), "left-terms").df
    b = right.select(F.col("id").cast("long").alias("right_id"), weight.cast("long").alias("weight"), bare.alias("terms"))
    if (a.agg(F.sum(F.size("terms"))).first()[0] or 0) <= MOST_INDEXED:
        met = indexed_overlaps(a, b, top, score, least, least_score)
    else:
        each = lambda df, i, n, *more: df.select(i, *more, F.size("terms").alias(n), F.explode("terms").alias("term"))
        pairs = met_on_terms(each(a, "left_id", "n_left"), each(b, "right_id", "n_right", "weight")).groupBy("left_id", "right_id", "weight", "n_left", "n_right").agg(F.count("*").alias("shared"))
        met = pairs.withColumn("score", score(F.col("shared"), F.col("n_left"), F.col("n_right"))).where((F.col("shared") >= least) & (F.col("score") >= least_score)).drop("n_left", "n_right")
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), F.desc("shared"), F.desc("weight"), "right_id"))
    return met.withColumn("place", rank).where(F.col("place") <= top).select("left_id", "right_id", "shared", "score", "place")


def indexed_overlaps(left: DataFrame, right: DataFrame, top: int, score: Callable, least: int, least_score: float) -> DataFrame:
    """best_overlaps' pairs by an index of the left side's terms: those that are among their task's best."""
    table = left.toArrow()  # MOST_INDEXED terms at most
    ids, lists = np.asarray(table["left_id"]), table["terms"].combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    order = np.argsort(np.asarray(coded.indices), kind="stable")
    holders = np.repeat(np.arange(len(ids)), sizes)[order]
    ends = np.cumsum(np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)))
    shared = right.sparkSession.sparkContext.broadcast((ids, sizes, coded.dictionary.to_pylist(), holders, ends))
    names, kinds = ["left_id", "right_id", "weight", "shared", "score"], [pa.int64()] * 4 + [pa.float64()]

    def best(held: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort((held[1], -held[2], -held[3], -held[4], held[0]))
        lefts = held[0][order]
        begins = np.flatnonzero(np.append(True, lefts[1:] != lefts[:-1]))
        rank = np.arange(len(lefts)) - np.repeat(begins, np.diff(np.append(begins, len(lefts))))
        return [h[order][rank < top] for h in held]

    def run(batches):
        ids, sizes, words, holders, ends = shared.value
        known = pa.array(words, pa.string())
        held = [np.zeros(0, np.int64) for _ in range(4)] + [np.zeros(0)]
        wide = max(1, CELLS // max(1, len(ids)))
        for batch in batches if len(words) else ():
            terms = batch.column(2)
            own = np.asarray(pc.list_value_length(terms)).astype(np.int64)
            code = pc.fill_null(pc.index_in(terms.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), own)[code >= 0]
            code = code[code >= 0]
            begin = np.where(code > 0, ends[code - 1], 0)
            work = np.bincount(row, weights=ends[code] - begin, minlength=batch.num_rows)
            at = 0
            while at < batch.num_rows:  # rows that make about CELLS meetings, and no more than CELLS pairs
                upto = at + max(1, min(wide, int(np.searchsorted(np.cumsum(work[at : at + wide]), CELLS))))
                use = slice(*np.searchsorted(row, [at, upto]))
                many = (ends[code[use]] - begin[use]).astype(np.int64)
                first = np.repeat(begin[use] - (np.cumsum(many) - many), many)
                cell = np.repeat(row[use] - at, many) * len(ids) + holders[first + np.arange(many.sum())]
                count = np.bincount(cell)
                hit = np.flatnonzero(count >= least)
                r, q = hit // len(ids) + at, hit % len(ids)
                s = np.asarray(score(count[hit].astype(float), sizes[q], own[r]), dtype=float)
                good = s >= least_score
                new = [ids[q], np.asarray(batch.column(0))[r], np.asarray(batch.column(1))[r], count[hit], s]
                held = [np.concatenate([h, n[good]]) for h, n in zip(held, new, strict=True)]
                if len(held[0]) > HELD:
                    held = best(held)
                at = upto
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(h, type=k) for h, k in zip(best(held), kinds, strict=True)], names=names)

    return right.mapInArrow(run, "left_id long, right_id long, weight long, shared long, score double")
