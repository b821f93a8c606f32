"""Near-duplicates of records kept before them, in order, for a key of any size.

Which records stay is the lexicographically first maximal independent set of the graph of
near-duplicates: a record goes if one that stays stands before it. It is found in rounds, in each of
which all records are decided whose earlier neighbours are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import words as W
from claimweave.operators.joins import met_on_terms
from claimweave.session import discard, store


def alike(a: Column, b: Column) -> Column:
    """Token sets of four or more that overlap by .72 of the smaller or .60 of the union."""
    both = F.size(F.array_intersect(a, b))
    least, every = F.least(F.size(a), F.size(b)), F.size(a) + F.size(b) - both
    return (least >= 4) & (both > 0) & ((both / least >= W.DUP_OVERLAP) | (both / every >= W.DUP_JACCARD))


def near_pairs(records: DataFrame) -> DataFrame:
    """first, then: ids of near-duplicates of one key. records (stored): key, id (orderable), tokens (distinct).

    Sixty percent of the union is more than .72 of the smaller set, so near-duplicates hold .72 of the
    smaller one, and one at least of its rarest tokens beyond that: those meet all tokens of the others.
    """
    rows = records.where(F.size("tokens") >= 4)
    each = rows.select("key", "id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = store(each.groupBy("key", "token").agg(F.count("*").alias("held")).where("held > 1"), "token-counts").df
    term = F.struct(F.col("key").alias("k"), F.col("token").alias("t"))
    shared = each.join(counts.withColumnsRenamed({"key": "_key", "token": "_token"}), F.col("key").eqNullSafe(F.col("_key")) & (F.col("token") == F.col("_token"))).drop("_key", "_token")
    # a token that no other record has counts for the length, and is rarest
    lone = F.col("n") - F.size("met")
    rare = F.col("n") - F.ceil(F.col("n") * W.DUP_OVERLAP - 1e-9) + 1
    ranked = shared.groupBy("key", "id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("met"))
    left = ranked.withColumn("token", F.explode(F.transform(F.slice("met", 1, F.greatest(rare - lone, F.lit(0)).cast("int")), lambda m: m["token"])))
    a = left.select(F.col("id").alias("a"), F.col("n").alias("n_a"), term.alias("term"))
    b = shared.select(F.col("id").alias("b"), F.col("n").alias("n_b"), term.alias("term"))
    met = met_on_terms(a, b).where("a <> b and n_a <= n_b").select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("then")).distinct()
    side = lambda c: rows.select(F.col("id").alias(c), F.col("tokens").alias(f"_{c}"))
    return met.join(side("first"), "first").join(side("then"), "then").where(alike(F.col("_first"), F.col("_then"))).select("first", "then")


def first_independent(pairs: DataFrame) -> DataFrame:
    """id, kept: for every id in pairs (first, then: stored) whether it stays, the earlier ids first."""
    spark = pairs.sparkSession
    ids = pairs.select(F.col("first").alias("id")).unionByName(pairs.select(F.col("then").alias("id"))).distinct()
    now = store(ids.select("id", F.lit(None).cast("boolean").alias("kept")), "decided")
    while not now.df.where("kept is null").isEmpty():
        before = pairs.join(now.df.where("kept is null").select(F.col("id").alias("then")), "then").join(now.df.select(F.col("id").alias("first"), F.col("kept").alias("was")), "first")
        seen = before.groupBy(F.col("then").alias("id")).agg(F.bool_or(F.coalesce("was", F.lit(False))).alias("met"), F.bool_and(F.col("was").isNotNull()).alias("known"))
        told = F.when(F.coalesce("met", F.lit(False)), False).when(F.coalesce("known", F.lit(True)), True)
        new = store(now.df.join(seen, "id", "left").select("id", F.coalesce("kept", told).alias("kept")), "decided")
        discard(spark, now.path)
        now = new
    return now.df


def without_near_duplicates(records: DataFrame) -> DataFrame:
    """id of the records (key, id, tokens; a stored table) that stay. Those with fewer than four tokens always do."""
    pairs = store(near_pairs(records), "near-pairs").df
    return records.join(first_independent(pairs).where("not kept"), "id", "left_anti").select("id")
