"""Concepts: embeddings of labels, candidate joins, blocking, merging, resolution."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.functions import words as W
from claimweave.operators.joins import best_overlaps
from claimweave.operators.similar import cosine_above, overlap_pairs
from claimweave.session import discard, read_if_there, store

DIMENSIONS = 256


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """a unit vector of hashed character trigrams: the default embedder, deterministic and JVM-side.

    A model can take its place: any Column of array<double> (for example a pandas UDF).
    """
    padded = F.concat(F.lit("  "), F.lower(T.squeezed(text)), F.lit("  "))
    grams = T.let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    slots = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(dimensions)).cast("int"))
    counted = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(held, lambda s: s == d)).cast("double"))
    scaled = lambda raw: T.let(F.greatest(F.sqrt(T.dot(raw, raw)), F.lit(1e-9)), lambda n: F.transform(raw, lambda v: v / n))
    return T.let(T.let(slots, counted), scaled)


def semantic_negation(clause: Column, relation: Column, embed: Callable[[Column], Column], least: float = W.SEMANTIC_NEGATION) -> Column:
    """whether a word near the relation is formed like a negation (un-, non-, -less, ...) and means one.

    embed: a real embedder of words; hashed trigrams only know words of the same letters. Near: within
    the reach of a negation before and after the relation. Null or missing relation: false.
    """
    far = W.LIMITS["negation_chars"]
    formed = rf"^(?:{W.phrases(W.NEGATION_PREFIXES)})[a-z]{{3,}}$|^[a-z]+(?:{W.phrases(W.NEGATION_SUFFIXES)})$|^(?:{W.phrases(W.NEGATION_TERMS)})$"
    prototypes = F.transform(T.strings(W.NEGATION_PROTOTYPES), embed)

    def near(x: Column) -> Column:
        low, rel = x["text"], x["rel"]
        at = F.when(rel == "", 0).otherwise(F.instr(low, rel))
        return F.when(at > 0, F.substr(low, F.greatest(at - far, F.lit(1)), F.length(rel) + 2 * far)).otherwise("")

    def means(token: Column) -> Column:
        return T.let(embed(token), lambda v: F.exists(prototypes, lambda p: T.cosine(v, p) >= least))

    base = F.struct(F.lower(T.clean(clause)).alias("text"), F.lower(T.clean_part(relation)).alias("rel"))
    tokens = F.filter(T.tokens(T.let(base, near)), lambda t: (F.length(t) >= 4) & ~T.one_of(t, W.STOP) & t.rlike(formed))
    return F.exists(tokens, means)


def vector_specificity(v: Column) -> Column:
    """.8 * half (a unit vector) + .2 * share of zeros."""
    zeros = F.size(F.filter(v, lambda x: x == 0)) / F.greatest(F.size(v), F.lit(1))
    norm = F.sqrt(T.dot(v, v))
    return T.clamp01(0.8 * norm / (1 + norm) + 0.2 * zeros)


def merge_threshold(specificity: Column) -> Column:
    """Between the two merge bounds by specificity."""
    return F.lit(W.MERGE_LOW) + (W.MERGE_HIGH - W.MERGE_LOW) * T.clamp01(specificity)


def merged_vector(old: Column, new: Column, count: Column) -> Column:
    """The running centroid (v * n + x) / (n + 1)."""
    return F.zip_with(old, new, lambda a, b: (a * count + b) / (count + 1))


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Key, centroid: the mean vector of each key, combined before the shuffle."""
    each = rows.select(key, F.posexplode(vector).alias("pos", "v")).groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("centroid"))


def candidates(left: DataFrame, right: DataFrame, limit: int = W.LIMITS["candidates"]) -> DataFrame:
    """left_id, right_id, overlap: right rows that share terms, the most shared first, at most limit.

    left, right: id, terms (arrays); right may have merge_count.
    """
    weighed = right.select("id", "terms", (F.col("merge_count") if "merge_count" in right.columns else F.lit(0)).alias("weight"))
    found = best_overlaps(left.select("id", "terms"), weighed, limit, lambda shared, n_left, n_right: shared * 1.0)
    return found.select("left_id", "right_id", F.col("shared").alias("overlap"), "place")


def best_match(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, similarity: of each left row's candidates the one of highest cosine, ties to the least id."""
    scored = pairs.join(left.select(F.col("id").alias("left_id"), F.col("vector").alias("_a")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("vector").alias("_b")), "right_id")
    scored = scored.withColumn("similarity", T.cosine(F.col("_a"), F.col("_b")))
    return scored.groupBy("left_id").agg(F.max(F.struct("similarity", (-F.col("right_id")).alias("n"))).alias("m")).select("left_id", (-F.col("m.n")).alias("right_id"), "m.similarity")


def cosine_search(queries: DataFrame, rows: DataFrame, least: float | None = None, top: int | None = None, chunk: int = 10_000) -> DataFrame:
    """J4 over all rows: id, other, similarity (six digits): for each query the rows of at least that cosine, or the top nearest.

    Both sides: id, vector. The query set is worked off in chunks (the only data that goes to the
    driver and the workers, chunk vectors at a time), each against all rows in blocks; a task keeps
    its own nearest of each query, so that few rows meet. Rows of the query's own id are left out;
    ties go to the least id; vectors that are null, hold a null or are all zeros have cosine 0.
    """
    parts = max(1, -(-queries.count() // chunk))
    out = None
    for k in range(parts):
        held = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).select("id", "vector").toArrow()
        ids, matrix = np.asarray(held["id"].to_pylist(), dtype=np.int64), arrow_rows(held["vector"].combine_chunks())
        shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches, shared=shared):
            ids, matrix = shared.value
            best_s, best_i = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    own = np.asarray(part.column(0).to_pylist(), dtype=np.int64)
                    s = np.round(matrix @ fitted(arrow_rows(part.column(1)), matrix.shape[1]).T, 6) + 0.0
                    other = ids[:, None] != own[None]
                    if top is None:
                        q, r = np.nonzero(other & (s >= least))
                        yield pair_batch(ids[q], own[r], s[q, r])
                        continue
                    best_s = np.concatenate([best_s, np.where(other, s, -np.inf)], axis=1)
                    best_i = np.concatenate([best_i, np.broadcast_to(own, s.shape)], axis=1)
                    order = np.lexsort((best_i, -best_s), axis=1)[:, :top]
                    best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            if top is not None:
                q, r = np.nonzero(best_s > -np.inf)
                yield pair_batch(ids[q], best_i[q, r], best_s[q, r])

        found = rows.where("id is not null").select("id", "vector").mapInArrow(run, "id long, other long, similarity double")
        out = found if out is None else out.unionByName(found)
    if top is None:
        return out
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return out.withColumn("place", rank).where(F.col("place") <= top)


def pair_batch(ids: np.ndarray, others: np.ndarray, similarity: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(similarity)], names=["id", "other", "similarity"])


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors of one length as rows of length one, zeros where there is none."""
    width = max((len(v) for v in vectors if v), default=1)
    x = np.array([[0.0] * width if v is None or None in v else [*v, *[0.0] * (width - len(v))] for v in vectors], dtype=float).reshape(-1, width)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def arrow_rows(column: pa.Array) -> np.ndarray:
    """unit_rows of an Arrow column; vectors of one length without nulls are read as they lie in memory."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    if not len(lengths) or lengths[0] < 1 or (lengths != lengths[0]).any() or column.flatten().null_count:
        return unit_rows(column.to_pylist())
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, int(lengths[0]))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]


def block_keys(name: Column, vector: Column, tokens: int = 6, dims: int = 8) -> Column:
    """J5: 'token:*' of the first six tokens longer than two, and 'vector:i:sign' of the eight largest dimensions."""
    words_ = F.slice(F.filter(T.tokens(name), lambda t: F.length(t) > 2), 1, tokens)
    ranked = F.slice(F.array_sort(F.transform(vector, lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("i"), v.alias("v")))), 1, dims)
    signs = F.transform(F.filter(ranked, lambda x: x["v"] != 0), lambda x: F.concat_ws(":", F.lit("vector"), x["i"].cast("string"), F.when(x["v"] > 0, "+").otherwise("-")))
    return F.array_distinct(F.concat(F.transform(words_, lambda t: F.concat(F.lit("token:"), t)), signs))


def blocked_pairs(rows: DataFrame, keys: Column, least_shared: int = 1) -> DataFrame:
    """A, b, shared: pairs (a < b) that share at least so many block keys. rows: id."""
    return overlap_pairs(rows, keys, least_shared)


def similar_labels(rows: DataFrame, least_shared: int = 1) -> DataFrame:
    """Pairs of rows (id, name, vector) that share block keys and whose cosine reaches the merge threshold of the less specific one.

    The pairs of enough cosine are found first: few share what that takes, while any block key is
    shared by a constant part of all rows.
    """
    keys = block_keys(F.col("name"), F.col("vector"))
    made = store(rows.select("id", "vector", merge_threshold(vector_specificity(F.col("vector"))).alias("need"), F.transform(keys, lambda k: F.xxhash64(k)).alias("keys")), "label-needs").df
    least = made.agg(F.min("need")).first()[0]
    if least is None:
        return made.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("need").alias("similarity")).limit(0)
    side = lambda k: made.select(F.col("id").alias(k), F.col("need").alias(f"need_{k}"), F.col("keys").alias(f"keys_{k}"))
    near = cosine_above(made.select("id", "vector"), None, least).join(side("a"), "a").join(side("b"), "b")
    return near.where((F.col("similarity") >= F.least("need_a", "need_b")) & (F.size(F.array_intersect("keys_a", "keys_b")) >= least_shared)).select("a", "b", "similarity")


def groups(pairs: DataFrame, max_rounds: int = 30) -> DataFrame:
    """id, root: the least id that merges reach, by passing on the least label and jumping to labels' labels."""
    spark = pairs.sparkSession
    ends = store(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "merge-pairs")
    now = store(ends.df.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("root")).withColumnRenamed("x", "id"), "merge-roots")
    for _ in range(max_rounds):
        label_of = now.df.select(F.col("id").alias("y"), "root")
        around = ends.df.join(label_of, "y").groupBy("x").agg(F.min("root").alias("near"))
        stepped = now.df.join(around, now.df["id"] == around["x"]).select("id", F.least("root", "near").alias("via"), F.col("root").alias("was"))
        jumped = stepped.join(now.df.select(F.col("id").alias("via"), F.col("root").alias("next")), "via", "left").select("id", F.least("via", F.coalesce("next", "via")).alias("root"), "was")
        new = store(jumped, "merge-roots")
        changed = not new.df.where("root <> was").isEmpty()
        discard(spark, now.path)
        now = type(new)(new.df.select("id", "root"), new.path)
        if not changed:
            return now.df
    raise RuntimeError(f"merges did not settle in {max_rounds} rounds")


def interned(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Norm, literal_id, literal: one literal per normalised text: its least order value and the text that came with it."""
    return rows.where(F.col(text).isNotNull()).groupBy(F.lower(T.squeezed(F.col(text))).alias("norm")).agg(F.min(order).alias("literal_id"), F.min_by(text, order).alias("literal"))


def looked_up(rows: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """Rows with the literal_id of their text, null where it is not known."""
    return rows.join(known.select(F.col("norm").alias("_norm"), "literal_id"), F.lower(T.squeezed(F.col(text))) == F.col("_norm"), "left").drop("_norm")


def literal_of(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (literal_id) with the text of their literal."""
    return rows.join(known.select("literal_id", "literal"), "literal_id", "left")


def canonical_quality(name: Column) -> Column:
    """How good a label is as the name of its concept: content tokens, then few characters."""
    return F.struct(F.size(T.content_tokens(name)).alias("content"), (-F.length(name)).alias("short"), name.alias("name"))


def resolve(labels: DataFrame, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """Norm, concept_id, canonical, merge_count for labels (name): order-free resolution.

    Distinct normalised labels are embedded once, blocked pairs at the threshold are merged, a
    concept is a connected group, and its name the label of best quality.
    """
    norm = F.lower(T.squeezed(F.col("name")))
    one = store(labels.where(F.col("name").isNotNull()).groupBy(norm.alias("norm")).agg(F.min("name").alias("name")).withColumn("id", F.xxhash64("norm")), "labels").df
    vectors = store(one.withColumn("vector", embed(F.col("name"))), "label-vectors").df
    root = one.join(groups(similar_labels(vectors)), "id", "left").select("norm", "name", F.coalesce("root", "id").alias("concept_id"))
    named = root.groupBy("concept_id").agg(F.max_by("name", canonical_quality(F.col("name"))).alias("canonical"), F.count("*").alias("merge_count"))
    return root.join(named, "concept_id").select("norm", "concept_id", "canonical", "merge_count")


def resolve_in_order(labels: DataFrame) -> DataFrame:
    """A8 as it comes: ord, name, vector in, ord, concept out; the first label near enough takes the next.

    Order makes this one task by nature: for small batches (group_id splits it). Use resolve() otherwise.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, int] = {}
        centres, counts, out = [], [], []
        for name, vector in frame.sort_values("ord")[["name", "vector"]].itertuples(index=False):
            x, key = np.asarray(vector, dtype=float), " ".join(str(name).lower().split())
            if key not in known:
                near = [(float(c @ x / max(np.linalg.norm(c) * np.linalg.norm(x), 1e-12)), -i) for i, c in enumerate(centres)]
                best = max(near, default=(0.0, 0))
                norm = float(np.linalg.norm(x))
                need = W.MERGE_LOW + (W.MERGE_HIGH - W.MERGE_LOW) * min(1.0, 0.8 * norm / (1 + norm) + 0.2 * float((x == 0).mean()))
                if near and best[0] >= need:
                    i = -best[1]
                    centres[i], counts[i] = (centres[i] * counts[i] + x) / (counts[i] + 1), counts[i] + 1
                else:
                    i = len(centres)
                    centres.append(x)
                    counts.append(1)
                known[key] = i
            out.append(known[key])
        return pd.DataFrame({"group_id": frame["group_id"].iloc[0], "ord": np.sort(frame["ord"].to_numpy()), "concept": out})

    return labels.groupBy("group_id").applyInPandas(run, "group_id long, ord long, concept long")


def resolved_labels(nodes: DataFrame, labels: DataFrame, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """Norm, node: the known node of each label: that of the same text, else the nearest one that shares a block key
    and whose cosine reaches the merge threshold of the more specific of the two. nodes: label; labels: name.

    Labels without either are left out.
    """
    norm = lambda c: F.lower(T.squeezed(F.col(c)))
    known = store(nodes.groupBy(norm("label").alias("norm")).agg(F.min("label").alias("node")).withColumn("vector", embed(F.col("norm"))), "known-nodes").df
    asked = store(labels.where("name is not null").select(norm("name").alias("norm")).distinct(), "asked-labels").df
    exact = asked.join(known.select("norm", "node"), "norm")
    rest = asked.join(known, "norm", "left_anti").withColumn("vector", embed(F.col("norm")))
    made = lambda df: store(df.select(F.col("norm").alias("id"), "vector", merge_threshold(vector_specificity(F.col("vector"))).alias("need"), block_keys(F.col("norm"), F.col("vector")).alias("keys")), "needs").df
    ours, theirs = made(rest), made(known)
    least = ours.unionByName(theirs).agg(F.min("need")).first()[0] or 1.0
    side = lambda df, k: df.select(F.col("id").alias(k), F.col("need").alias(f"need_{k}"), F.col("keys").alias(f"keys_{k}"))
    scored = cosine_above(ours, theirs, least).join(side(ours, "a"), "a").join(side(theirs, "b"), "b").where(F.arrays_overlap("keys_a", "keys_b"))
    scored = scored.select(F.col("a").alias("asked"), F.col("b").alias("norm"), "similarity", "need_a", "need_b")
    near = scored.where(F.col("similarity") >= F.greatest("need_a", "need_b")).groupBy("asked").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "norm")).alias("m"))
    merged = near.select("asked", F.col("m.norm").alias("norm")).join(known.select("norm", "node"), "norm").select(F.col("asked").alias("norm"), "node")
    return exact.unionByName(merged)


def refine(nodes: DataFrame, claims: DataFrame, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """Late claims whose ends both resolve to known nodes and differ: they update, never create. nodes: label; claims: subject, predicate."""
    names = claims.select(F.col("subject").alias("name")).unionByName(claims.select(F.col("predicate").alias("name")))
    known = store(resolved_labels(nodes, names, embed), "resolved").df
    end = lambda df, c: df.withColumn("norm", F.lower(T.squeezed(F.col(c)))).join(known, "norm").withColumn(c, F.col("node")).drop("norm", "node")
    return end(end(claims, "subject"), "predicate").where("subject <> predicate").select(*claims.columns)


def stored_concepts(spark: SparkSession, labels: DataFrame, path: str, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """Norm, concept_id, canonical of a concept table that survives calls.

    Labels that the table at path knows keep their concept; new ones join the nearest known concept
    as in resolved_labels, and what is left is resolved among itself and added. Each call adds one part.
    """
    norm = F.lower(T.squeezed(F.col("name")))
    known = read_if_there(spark, path)
    if known is None:
        resolve(labels, embed).select("norm", "concept_id", "canonical").write.parquet(path)
        return spark.read.parquet(path)
    fresh = store(labels.where("name is not null").select("name", norm.alias("norm")).join(known.select("norm"), "norm", "left_anti"), "fresh-labels").df
    names = known.groupBy("canonical").agg(F.min("concept_id").alias("concept_id"))
    joined = resolved_labels(names.select(F.col("canonical").alias("label")), fresh.select("name"), embed)
    near = store(joined.join(names, joined["node"] == names["canonical"]).select("norm", "concept_id", "canonical"), "near-labels").df
    new = resolve(fresh.join(near, "norm", "left_anti").select("name"), embed).select("norm", "concept_id", "canonical")
    store(near.unionByName(new), "new-concepts").df.write.mode("append").parquet(path)
    return spark.read.parquet(path)
