"""Mixing sources to target weights: repetition rates, whole copies and one Bernoulli copy.

Sizes are added up per source (map-side first, so a source with a third of all rows costs
one row a task), targets follow by water-filling over the per-source sums, and each document
is taken floor(rate) times plus once more with probability rate - floor(rate): a coin from a hash
of seed, doc_id and text, so reruns and retried tasks agree, however the table is cut into files
and partitions. Rows that share both get coins from all their columns, and k equal rows k coins, from
the numbers below k: which of them falls to which row makes no difference.

The coins of a source are not independent, or one long document would decide over it. Documents
are put into strata by size (powers of two), the long ones first. What the coins of longer strata
took beyond or below their share changes the probability of all shorter ones, whose expectation
stays rate - floor(rate), and within a stratum the documents of the lowest hashes are taken up to
the length wanted. So a source misses its target by about its shortest documents, unless its
longest outweigh all others. Only sums by source, stratum and CELLS ranges of the hash are needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import hashable, n_words, row_key, set_aside
from claimweave.session import prepare, store, without

#: The weights that sources get in turn.
WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all sizes that the mix takes, and the most times that a source may repeat.
SHARE, MOST = 1.5, 2.0
#: Rows of per-source targets (some 50 bytes each) that are still broadcast to the documents.
MOST_BROADCAST = 200_000
#: Ranges of the hash that a stratum's sizes are added up by: a source has at most 64 * CELLS sums.
CELLS = 2048
#: Equal rows that one task writes.
TWINS = 10_000
ADDED = ["size", "source_size", "target", "rate", "copies", "taken"]
#: Columns that it works with.
WORKED = ["_u", "_key", "_n", "_at", "_block", "stratum", "threshold", "_stratum", "_mix_source"]


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, rate: one row per source (null is a source of its own).

    A source's target is min(most * size, level * weight), with the one level at which targets
    add up to share * all sizes: the fixed point of resharing what is above a cap by weight.
    Sources fill up in order of cap / weight; level is found by running sums over the
    per-source rows. A source of size 0 has target 0 and rate 0. Empty input: no rows.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # UTF-8 order is code point order, and Spark compares strings by their bytes
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    w = per_source.select("*", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    w = w.withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(rest).alias("open_weight"),
        (F.sum("source_size").over(everything) * share).alias("wanted"),
    )
    # the level if this source and all later ones stay open; the first that stays below its cap gives the level, the highest of those that do
    w = w.withColumn("level_here", (F.col("wanted") - F.col("capped")) / F.col("open_weight"))
    level = F.max(F.when(F.col("level_here") <= F.col("fills_at"), F.col("level_here"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return w.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from a hash: the same row and seed, the same number."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def stratum(size: Column) -> Column:
    """The power of two below a size; -1 for 0."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double")) + 1e-9)).otherwise(-1).cast("int")


def thresholds(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """source, stratum, threshold: a document is taken once more if its number lies below.

    sized: source, size, _u. One grouped task a source over at most 64 * CELLS sums.
    """
    cell = F.floor(F.col("_u") * CELLS).cast("int")
    sums = sized.groupBy("source", stratum(F.col("size")).alias("stratum"), cell.alias("cell")).agg(F.sum("size").alias("size"), F.min("_u").alias("least"), F.max("_u").alias("most"))
    rated = sums.join(targets.select(F.col("source").alias("_s"), "rate"), sums["source"].eqNullSafe(F.col("_s"))).drop("_s")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        share = float(frame["rate"].iloc[0]) % 1.0
        rest, out = float(frame["size"].sum()), []
        wanted = share * rest
        for level, own in sorted(frame.groupby("stratum"), key=lambda x: -x[0]):
            own = own.sort_values("cell")
            size = own["size"].to_numpy(dtype=float)
            total = size.sum()
            if level < 0 or not total:
                out.append((level, share))
                continue
            chance = min(1.0, max(0.0, wanted / rest))
            cut, took = cut_at(size, own["least"].to_numpy(), own["most"].to_numpy(), chance * total)
            out.append((level, cut))
            wanted, rest = wanted - took, rest - total
        return pd.DataFrame({"source": frame["source"].iloc[0], "stratum": [x for x, _ in out], "threshold": [c for _, c in out]}).astype({"stratum": "int32"})

    return rated.groupBy("source").applyInPandas(run, "source string, stratum int, threshold double")


def cut_at(size: np.ndarray, least: np.ndarray, most: np.ndarray, wanted: float) -> tuple[float, float]:
    """The number below which cells (in order) hold about the wanted size, and what it takes.

    A cell of one document is taken whole with the wanted part as its chance (the coin is the tail
    of its hash); of a cell of several, the part that is wanted, as if they were spread evenly over it.
    """
    before = np.cumsum(size) - size
    at = int(np.searchsorted(before, wanted, side="right")) - 1
    if at < 0:
        return 0.0, 0.0
    part = min(1.0, (wanted - before[at]) / size[at])
    if least[at] == most[at]:
        part = float(least[at] * 2.0**40 % 1 < part)
        return (float(np.nextafter(most[at], 2)), before[at] + size[at]) if part else (float(least[at]), before[at])
    return float(least[at] + part * (np.nextafter(most[at], 2) - least[at])), before[at] + part * size[at]


def each_twin(rows: DataFrame, seed: int, block: int = TWINS) -> DataFrame:
    """Each row _n times, with a _u for each; blocks of them are dealt out before they are written."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block)))).repartition("_key", "_block")
    first = F.col("_block") * block
    every = blocks.withColumn("_at", F.explode(F.sequence(first, F.least(first + block, F.col("_n")) - 1)))
    return every.withColumn("_u", uniform(seed + 1, F.col("_u"), F.col("_key"), F.col("_at"))).drop("_at", "_block", "_n")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 8) -> DataFrame:
    """Documents with size, source_size, target, rate, copies, taken: one row per document.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: drawn by text alone.
    Repeated rows: each draws for itself. Columns may be of any type, maps as well. Empty table: no rows.
    Input columns named like an added one give way to it. Size is the number of words; a target is
    at most most times its source's size, so copies <= ceil(most), and no document exceeds most
    times its size where most is whole.
    """
    prepare(docs.sparkSession)
    rows = without(docs, [*ADDED, *WORKED])
    own = [*rows.columns, "size"]
    sized = rows.withColumns({"size": n_words(F.col("text")), "_u": uniform(seed, F.col("doc_id"), F.col("text")), "_key": row_key(hashable(rows), seed)})
    columns = [F.col("source").cast("string").alias("source"), "size", "_u", "_key"]
    narrow = store(sized.select(*columns), "sizes").df
    again = store(narrow.groupBy("_u").agg(F.count("*").alias("_n")).where("_n > 1").select("_u"), "repeated").df
    if not again.isEmpty():
        again = F.broadcast(again) if again.count() <= MOST_BROADCAST else again
        part = lambda df, how: df.join(again, "_u", how)
        one = lambda df, names: part(df, "left_semi").groupBy("_key").agg(F.count("*").alias("_n"), *[F.first(F.col(f"`{c}`")).alias(c) for c in [*names, "_u"]])
        narrow = store(part(narrow, "left_anti").unionByName(each_twin(one(narrow, ["source", "size"]), seed)), "sizes").df
        sized = part(sized, "left_anti").unionByName(each_twin(one(sized, own), seed))
    targets = store(source_targets(narrow, weights, share, most), "targets").df
    cuts = store(thresholds(narrow, targets, seed).join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "thresholds").df
    named = cuts.withColumnsRenamed({"source": "_mix_source", "stratum": "_stratum"})
    if named.count() <= MOST_BROADCAST:  # else an ordinary join, which shuffles the documents by source and stratum
        named = F.broadcast(named)
    rated = sized.join(named, sized["source"].eqNullSafe(named["_mix_source"]) & (stratum(F.col("size")) == F.col("_stratum")), "left")
    copies = (F.floor(F.col("rate")) + (F.col("_u") < F.col("threshold")).cast("int")).cast("int")
    return rated.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("_mix_source", "_stratum", "threshold", "_u", "_key")


def emit_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 8) -> DataFrame:
    """The mix itself: each document as many times as mix_sources takes it, with all its own columns.

    Documents without words are taken by their coin alone. Nulls, repeated rows, empty tables and
    clashing columns: see mix_sources.
    """
    aside, back = set_aside(docs, [*ADDED, *WORKED, "_copy"])
    taken = mix_sources(aside, weights, share, most, seed).where("copies > 0")
    return back(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
