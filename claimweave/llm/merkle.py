"""Merkle manifest of a dataset: leaves, trees per group, coordinate lookup proofs.

A node is named by its coordinate (tree, level, index). Trees are built in tiers: a block of
RUN ** TIER consecutive nodes gives all its levels in one task, and the blocks' tops are the nodes
of the next tier. A proof is a lookup: each node of a tier explodes the coordinates of its siblings,
which follow from its index and the tree's size alone, joins the tier's stored node table, and
orders what it got. A node is asked for by at most RUN ** TIER others, however large a tree is;
what all nodes of a block share, the path above it, is looked up once a block by the next tier.
Leaves are numbered by ranges of one total order, so a tree with most of the rows costs no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import prepare, store

#: Consecutive nodes that become one, and levels of a tier.
RUN, TIER = 2, 8
#: Rows of per-tree figures that are still broadcast to the leaves.
MOST_BROADCAST = 200_000
#: What is hashed of a row, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that a task turns into levels at once.
BATCH_NODES = 1 << 16
PATH = "array<struct<before: string, after: string>>"


def encoded(value: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value."""
    said = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf_hash(row: dict[str, Column], fields: tuple[str, ...] = FIELDS) -> Column:
    """Lowercase hex SHA-256 of a row's encoded fields."""
    return F.sha2(F.concat(*[encoded(row[f]) for f in fields]).cast("binary"), 256)


def placed(rows: DataFrame, order: list[Column], name: str, tag: str) -> DataFrame:
    """rows with their place (from 0) in a total order; ranges are sorted, and each adds the rows before it.

    rows: a stored table, so that ranges are drawn from what stays as it is.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    made = store(ranged.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in")).drop("_at"), tag).df
    counts = made.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return made.join(F.broadcast(before), "_part").withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


def bounded(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small enough; else an ordinary join follows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def block_levels(run: int, tier: int):
    """Work of a task: blocks (tree, block, size, last level, hashes in order) to rows of their node table; tops are marked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "size", "level", "index", "hash", "top"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
        rows: list[list] = [[] for _ in names]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(rows, kinds, strict=True)], names=names)
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            for at in range(batch.num_rows):
                tree, block, size, last, now = (c[at].as_py() for c in batch.columns)
                number = block * run**tier
                for level in range(last + 1):
                    if level:
                        text = [h.hex() for h in now]
                        now = [hashlib.sha256("".join(text[i : i + run]).encode()).digest() for i in range(0, len(text), run)]
                        number //= run
                    same = [tree, size, level]
                    for column, value in zip(rows, same, strict=False):
                        column += [value] * len(now)
                    rows[3] += range(number, number + len(now))
                    rows[4] += now
                    rows[5] += [level == last] * len(now)
                if len(rows[0]) >= BATCH_NODES:
                    yield flush()
        if rows[0]:
            yield flush()

    return work


def paths(nodes: DataFrame, run: int = RUN, tier: int = TIER) -> tuple[DataFrame, DataFrame]:
    """(tree, index, path) for each node and (tree, hash) of each tree's top.

    nodes: rows of a stored table, tree long, index long (gapless from 0 in a tree), size long (the tree's
    nodes), hash binary. path: a struct for each level from the bottom, the hex hashes of the run's
    nodes before and after one's own. No nodes give no rows.
    """
    width = run**tier
    # levels of this tier for each tree: until one node is left, tier at most
    levels = sum(((F.col("size") > run**i).cast("int") for i in range(tier)), F.lit(0))
    grouped = nodes.groupBy("tree", (F.col("index") - F.pmod("index", F.lit(width))).alias("first"), "size").agg(F.sort_array(F.collect_list(F.struct("index", "hash"))).alias("own"))
    blocks = grouped.select("tree", (F.col("first") / width).cast("long").alias("block"), "size", levels.alias("last"), F.transform("own", lambda n: n["hash"]).alias("hashes"))
    table = store(blocks.mapInArrow(block_levels(run, tier), "tree long, size long, level int, index long, hash binary, top boolean"), "nodes").df
    tops = table.where("top").select("tree", "index", upper_size(F.col("size"), run, tier).alias("size"), "hash")
    table = table.select("tree", "level", "index", "hash")

    asked = nodes.select("tree", "index", "size", F.explode(F.when(levels > 0, F.sequence(F.lit(0), levels - 1))).alias("level"))
    step = F.element_at(F.array(*[F.lit(run**i).cast("long") for i in range(tier)]), F.col("level") + 1)
    mine = F.floor(F.col("index") / step).cast("long")
    head = mine - F.pmod(mine, F.lit(run))
    wide = F.floor((F.col("size") + step - 1) / step).cast("long")
    run_of = F.sequence(head, F.least(head + run, wide) - 1)
    asked = asked.select("tree", "level", F.col("index").alias("node"), mine.alias("mine"), F.explode(run_of).alias("index"))
    got = asked.where("index != mine").join(table, ["tree", "level", "index"])
    entry = F.struct("level", "index", F.when(F.col("index") < F.col("mine"), True).otherwise(False).alias("ahead"), "hash")
    found = got.groupBy("tree", F.col("node").alias("index")).agg(F.collect_list(entry).alias("got"))
    own = nodes.select("tree", "index", levels.alias("levels")).join(found, ["tree", "index"], "left")
    side = lambda level, ahead: F.array_join(
        F.transform(F.filter(F.sort_array(F.coalesce("got", F.array())), lambda s: (s["level"] == level) & (s["ahead"] == F.lit(ahead))), lambda s: F.lower(F.hex(s["hash"]))), ""
    )
    each = F.transform(F.sequence(F.lit(0), F.col("levels") - 1), lambda v: F.struct(side(v, True).alias("before"), side(v, False).alias("after")))
    own = own.select("tree", "index", F.when(F.col("levels") > 0, each).otherwise(F.array().cast(PATH)).alias("path"))
    more = tops.where("size > 1")
    if more.isEmpty():
        return own, tops.select("tree", "hash")
    above, summits = paths(more, run, tier)
    above = above.select("tree", F.col("index").alias("_block"), F.col("path").alias("_above"))
    whole = own.withColumn("_block", F.floor(F.col("index") / width).cast("long")).join(above, ["tree", "_block"], "left")
    joined = whole.select("tree", "index", F.concat("path", F.coalesce("_above", F.array().cast(PATH))).alias("path"))
    return joined, tops.where("size = 1").select("tree", "hash").unionByName(summits)


def upper_size(size: Column, run: int, tier: int) -> Column:
    """Nodes of a tree after a tier."""
    width = run**tier
    return F.floor((size + (width - 1)) / width).cast("long")


def fold(leaf: Column, path: Column) -> Column:
    """The top that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda now, s: F.sha2(F.concat(s["before"], now, s["after"]).cast("binary"), 256))


def manifest(leaves: DataFrame, run: int = RUN, tier: int = TIER) -> DataFrame:
    """leaves' columns with subroot, root, path: one row per leaf.

    leaves: group string, key (orders the leaves of a group, nulls first), leaf (hex), and more
    columns. Leaves of equal key are ordered by their hash, and of equal hash by nothing, as they
    can change places without any node changing. A null group comes first. Empty table: no rows.
    """
    prepare(leaves.sparkSession)
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]
    rows = placed(store(leaves, "leaves").df, order, "_place", "ordered")
    trees = store(rows.groupBy("group").agg(F.min("_place").alias("_first"), F.count("*").alias("size")), "groups").df
    trees = placed(trees, [F.col("_first")], "tree", "trees").select("tree", "_first", "size", F.col("group").alias("_group"))
    met = F.col("group").eqNullSafe(F.col("_group"))
    rows = rows.join(bounded(trees), met).withColumn("index", F.col("_place") - F.col("_first")).drop("_group", "_first", "_place")
    rows = store(rows, "indexed").df
    up, tops = paths(rows.select("tree", "index", "size", F.unhex("leaf").alias("hash")), run, tier)
    subroots = store(tops, "subroots").df
    many = subroots.count()
    over, top = paths(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(many).cast("long").alias("size"), "hash"), run, tier)
    summit = top.select(F.lower(F.hex("hash")).alias("root")).first()  # one row, none for an empty table
    last = subroots.join(over.select(F.col("index").alias("tree"), F.col("path").alias("_over")), "tree").select("tree", F.lower(F.hex("hash")).alias("subroot"), "_over")
    last = store(last.withColumn("root", F.lit(summit["root"] if summit else None).cast("string")), "roots").df
    whole = rows.join(up, ["tree", "index"]).join(bounded(last), "tree")
    return whole.withColumn("path", F.concat("path", "_over")).drop("_over", "tree", "index", "size")


def proofs(docs: DataFrame, run: int = RUN, tier: int = TIER) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, tampered, folded_root, verified: one row per document.

    The manifest is that of docs as they are. Then rows whose checksum of doc_id is divisible by 7
    have one added to n_chars, and each row's leaf of now is folded with the siblings of before: it
    leads to the root only if the row is as it was. Null values are hashed as '-'; null lang is a
    group of its own, first; a null doc_id comes first and is never tampered with; a null n_chars
    stays; repeated rows are leaves of their own; other columns aren't read. Empty table: no rows.
    """
    values = {f: F.col(f) for f in FIELDS}
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = values | {"n_chars": F.col("n_chars") + F.when(chosen, F.lit(1)).otherwise(F.lit(0))}
    rows = docs.select(
        F.col("doc_id").alias("key"),
        F.col("lang").cast("string").alias("group"),
        leaf_hash(values).alias("leaf"),
        F.when(chosen & F.col("n_chars").isNotNull(), leaf_hash(changed)).alias("_now"),
    )
    known = manifest(rows, run, tier)
    sides = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    told = known.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(sides.cast("binary"), 256).alias("proof_sha256"),
        F.col("_now").isNotNull().alias("tampered"),
        fold(F.coalesce("_now", "leaf"), F.col("path")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
