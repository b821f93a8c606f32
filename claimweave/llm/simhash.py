"""SimHash near-dedup by a generalised pigeonhole.

Fingerprints are 64 bits. Bits are put into partitions so that correlated ones lie together; the
partitions get unequal thresholds that sum to radius + 1 - their number, so any two fingerprints
within the radius are within some partition's threshold there. Thresholds (and the number of
partitions) come from dynamic programming on estimated candidate counts. Each distinct
fingerprint probes the keys around its own in each partition; matches are verified by their full
distance inside the join. Buckets of over HOT fingerprints are instead cut into blocks, and a
pair of blocks gives a spanning forest of its verified links: no link that matters to the
components is lost, no bucket is held by one task, and no group's pairs are all written out.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import hashable, map_text, row_key, set_aside
from claimweave.llm.components import components
from claimweave.session import prepare, store

SHINGLE, RADIUS, BITS = 4, 4, 64
HOT, BLOCK = 64, 1024
#: The cost of one probe row in candidates verified.
PROBE_COST = 30.0


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half the XXH64 values (seed 42) of the text's word shingles."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 2:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[:n].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 200_000):
        part = np.unpackbits(values[at : at + 200_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and _fp, the fingerprint as a signed long; null and wordless texts: 0."""

    def start():
        return lambda texts, _: [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]

    return map_text(docs, keep, [("_fp", "long")], start)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often bits i and j are both set, over all of them."""

    def run(frames):
        total, n = np.zeros((BITS, BITS)), 0
        for f in frames:
            x = np.unpackbits(f["_fp"].to_numpy(dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + x.T @ x, n + len(x)
        yield pd.DataFrame({"at": np.arange(BITS * BITS + 1), "n": np.append(total.reshape(-1), n)})

    rows = prints.select("_fp").mapInPandas(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def partition_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of nearly equal size: each part is grown by the bit most correlated with it."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(tie, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        group = [max(sorted(left), key=lambda b: tie[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: tie[b, group].sum())
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def within(differ: np.ndarray, most: int) -> np.ndarray:
    """Chance that at most 0..most of the bits differ, given each bit's chance to."""
    law = np.zeros(most + 2)
    law[0] = 1
    for q in differ:
        law[1:] = law[1:] * (1 - q) + law[:-1] * q
        law[0] *= 1 - q
    return np.cumsum(law[: most + 1])


def allocate(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition at least estimated cost; threshold -1: not probed."""
    p = np.diag(both) / max(1, n)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, radius + 2):
        groups = partition_bits(n, both, parts)
        budget = radius + 1  # thresholds plus one sum to this
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            chance, new = within(differ[bits], radius), {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, budget - spent):
                    probes = sum(comb(len(bits), k) for k in range(t + 1))
                    more = cost + (probes * PROBE_COST + n * chance[t] / 2 if t >= 0 else 0)
                    if spent + t + 1 not in new or more < new[spent + t + 1][0]:
                        new[spent + t + 1] = (more, [*chosen, t])
            table = new
        cost, chosen = table[budget]
        if best is None or cost < best[0]:
            best = (cost, list(zip(groups, chosen, strict=True)))
    return best[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys_of(prints: DataFrame, plan: list[tuple[list[int], int]], probing: bool) -> DataFrame:
    """_fp with each partition's key, or, when probing, with all keys within its threshold."""
    flips = []
    for part, (bits, most) in enumerate(plan):
        if most >= 0:
            keep = signed(sum(1 << b for b in bits))
            for k in range(most + 1 if probing else 1):
                flips += [(part, keep, signed(sum(1 << b for b in some))) for some in combinations(bits, k)]
    spots = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(m).cast("long").alias("keep"), F.lit(f).cast("long").alias("flip")) for p, m, f in flips])
    return prints.select("_fp", F.explode(spots).alias("s")).select("_fp", F.col("s.part").alias("part"), F.col("_fp").bitwiseAND(F.col("s.keep")).bitwiseXOR(F.col("s.flip")).alias("key"))


def linked(prints: DataFrame, radius: int = RADIUS, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints within the radius that join the same components as all such links."""
    plan = allocate(*bit_statistics(prints), radius)
    index, probes = keys_of(prints, plan, False), keys_of(prints, plan, True)
    crowded = store(index.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot").df
    near = F.bit_count(F.col("p._fp").bitwiseXOR(F.col("i._fp"))) <= radius
    on = (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & (F.col("p._fp") < F.col("i._fp")) & near
    if crowded.isEmpty():
        return probes.alias("p").join(index.alias("i"), on).select(F.col("p._fp").alias("a"), F.col("i._fp").alias("b"))
    cold_index, cold_probes = (x.join(crowded.select("part", "key"), ["part", "key"], "left_anti") for x in (index, probes))
    cold = cold_probes.alias("p").join(cold_index.alias("i"), on).select(F.col("p._fp").alias("a"), F.col("i._fp").alias("b"))
    return cold.unionByName(linked_in_blocks(index, probes, crowded, radius, block))


def linked_in_blocks(index: DataFrame, probes: DataFrame, crowded: DataFrame, radius: int, block: int) -> DataFrame:
    """The links of crowded buckets: a spanning forest for each pair of an index and a probe block."""
    across = crowded.select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("across"))
    asked = probes.join(across, ["part", "key"])
    down = asked.groupBy("part", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("down"))
    shape = across.join(down, ["part", "key"])
    to_block = lambda n: F.pmod(F.xxhash64("_fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.join(shape, ["part", "key"]).select("part", "key", "_fp", F.lit(True).alias("held"), to_block("across").alias("x"), every("down").alias("y"))
    asking = probes.join(shape, ["part", "key"]).select("part", "key", "_fp", F.lit(False).alias("held"), every("across").alias("x"), to_block("down").alias("y"))
    rows = held.unionByName(asking)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["held"].to_numpy()
        fp = frame["_fp"].to_numpy(dtype=np.int64)
        return pd.DataFrame(forest(np.unique(fp[own]), np.unique(fp[~own]), radius), columns=["a", "b"])

    return rows.groupBy("part", "key", "x", "y").applyInPandas(run, "a long, b long")


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Links that span the components of all pairs (left, right) within the radius."""
    near = np.empty((len(left), len(right)), dtype=bool)
    for i, x in enumerate(left.view(np.uint64)):
        near[i] = np.bitwise_count(right.view(np.uint64) ^ x) <= radius
    out, free, done = [], np.ones(len(right), dtype=bool), np.zeros(len(left), dtype=bool)
    for root in range(len(left)):
        if done[root]:
            continue
        done[root], queue = True, [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(near[i] & free)
            free[new] = False
            out += [(left[i], right[j]) for j in new.tolist() if left[i] != right[j]]
            for j in new.tolist():
                more = np.flatnonzero(near[:, j] & ~done)
                done[more] = True
                out += [(left[k], right[j]) for k in more.tolist() if left[k] != right[j]]
                queue += more.tolist()
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def print_components(prints: DataFrame, radius: int) -> DataFrame:
    """_fp, least: the least of the column first over all fingerprints that links reach. prints: a stored table of _fp, first.

    Written between the steps, so that a component's or fingerprint's rows are no fixed partition
    and the join can be split where they are many.
    """
    found = store(components(linked(prints.select("_fp"), radius)), "print-components").df
    label = store(prints.join(found, prints["_fp"] == found["node"], "left").select("_fp", "first", F.coalesce("component", "_fp").alias("_class")), "print-classes").df
    least = store(label.groupBy("_class").agg(F.min("first").alias("least")), "class-least").df
    return store(label.select("_fp", "_class").join(least, "_class").select("_fp", "least"), "print-least").df


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per document.

    component_id is the least doc_id that links reach. Null and wordless texts: fingerprint 0,
    linked like any other. A null doc_id counts as none when the least is taken. Repeated rows
    give a row each. Empty table: no rows. Only doc_id and text are read.
    """
    prepare(docs.sparkSession)
    rows = store(fingerprints(docs, ["doc_id"]), "prints").df
    prints = store(rows.groupBy("_fp").agg(F.min("doc_id").alias("first")), "distinct-prints").df
    least = print_components(prints, radius)
    return rows.join(least, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component stays, with its own columns: one of the least doc_id, null ids last.

    Null and wordless texts are one component. Rows of one doc_id with texts of different
    components, or without id, stay each; of equal rows one stays. Columns may be of any type, maps
    as well. Empty table: no rows.
    """
    prepare(docs.sparkSession)
    aside, back = set_aside(docs, ["_row", "_fp"])
    numbered = aside.withColumn("_row", row_key(hashable(aside)))
    rows = store(fingerprints(numbered, ["doc_id", "_row"]), "prints").df
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    prints = store(rows.groupBy("_fp").agg(first), "distinct-prints").df
    kept = print_components(prints, radius).select(F.col("least.doc_id").alias("_id"), F.col("least._row").alias("_kept")).distinct()
    one = numbered.join(kept, numbered["doc_id"].eqNullSafe(F.col("_id")) & (numbered["_row"] == F.col("_kept")), "left_semi")
    return back(one.dropDuplicates(["doc_id", "_row"]).drop("_row"))
