"""Exact similarity joins, scans for the last earlier row and masks of reach, against plain Python."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.operators import concepts, graph, joins, similar


def cosine(x, y):
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return float(np.dot(x, y) / n) if n else 0.0


def vectors_of(kind, rng, many):
    if kind == "labels":  # sparse, few dimensions each
        base = [rng.choice(64, rng.integers(1, 12), replace=False) for _ in range(many // 3)]
        out = np.zeros((many, 64))
        for i in range(many):
            dims = base[i % len(base)]
            out[i, dims] = rng.integers(1, 4, len(dims))
            out[i, rng.integers(64)] += rng.integers(0, 2)
        return out
    if kind == "peaked":  # nearly all mass in one dimension or two
        out = rng.normal(0, 0.05, (many, 24))
        out[np.arange(many), rng.integers(0, 6, many)] += 1
        return out
    out = rng.normal(size=(many, 12))  # dense and signed, with copies near each
    out[many // 2 :] = out[: many - many // 2] + rng.normal(0, 0.2, (many - many // 2, 12))
    return out


@pytest.mark.parametrize("kind", ["labels", "peaked", "dense"])
@pytest.mark.parametrize("bound", [0.84, 0.95])
def test_cosine_join_is_exact(spark, kind, bound):
    x = vectors_of(kind, np.random.default_rng(3), 150)
    x[0] = 0
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id long, vector array<double>")
    want = {(a, b) for a, b in combinations(range(len(x)), 2) if cosine(x[a], x[b]) >= bound}
    assert {(r["a"], r["b"]) for r in similar.cosine_above(rows, None, bound).collect()} == want and len(want) > 5
    left, right = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    want = {(a, b) for a in range(0, len(x), 2) for b in range(1, len(x), 2) if cosine(x[a], x[b]) >= bound}
    assert {(r["a"], r["b"]) for r in similar.cosine_above(left, right, bound).collect()} == want


@pytest.mark.parametrize("least", [1, 2, 4])
def test_overlap_join_is_exact(spark, least):
    rng = random.Random(least)
    sets = [rng.sample(range(30), rng.randrange(0, 9)) for _ in range(200)] + [None]
    rows = spark.createDataFrame([(i, [f"k{v}" for v in s] if s is not None else None) for i, s in enumerate(sets)], "id long, keys array<string>")
    want = {(a, b, len(set(sets[a]) & set(sets[b]))) for a, b in combinations(range(200), 2) if len(set(sets[a]) & set(sets[b])) >= least}
    assert {tuple(r) for r in similar.overlap_pairs(rows, F.col("keys"), least).collect()} == want


def test_labels_merge_as_by_comparing_all(spark):
    """similar_labels against all pairs: those that share a block key and reach the lesser threshold."""
    names = [f"{a} {b} {c}" for a in ("Standard", "Small", "Medium plated") for b in ("polished brass", "polished brasses", "brushed tin") for c in ("box", "boxes", "jar")]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string").withColumn("vector", concepts.hashed_vector(F.col("name")))
    made = rows.select("id", "vector", concepts.merge_threshold(concepts.vector_specificity(F.col("vector"))).alias("need"), concepts.block_keys(F.col("name"), F.col("vector")).alias("keys")).collect()
    want = {(x["id"], y["id"]) for x, y in combinations(made, 2) if set(x["keys"]) & set(y["keys"]) and cosine(x["vector"], y["vector"]) >= min(x["need"], y["need"])}
    assert {(r["a"], r["b"]) for r in concepts.similar_labels(rows).collect()} == want and want
    known, asked = [n for i, n in enumerate(names) if i % 2], [n for i, n in enumerate(names) if i % 2 == 0]
    got = {r["norm"]: r["node"] for r in concepts.resolved_labels(spark.createDataFrame([(n,) for n in known], "label string"), spark.createDataFrame([(n,) for n in asked], "name string")).collect()}
    by = {r["id"]: r for r in rows.withColumn("vector", concepts.hashed_vector(F.lower("name"))).select("*", concepts.merge_threshold(concepts.vector_specificity(F.col("vector"))).alias("need")).collect()}
    for i, n in enumerate(names):
        if i % 2:
            continue
        near = [(cosine(by[i]["vector"], by[j]["vector"]), names[j]) for j in range(1, len(names), 2)]
        near = [(s, m) for s, m in near if s >= max(by[i]["need"], by[names.index(m)]["need"])]
        assert got.get(n.lower()) == (max(near)[1] if near else None) or len({s for s, _ in near}) < len(near)


def test_candidates_grow_with_what_is_similar(spark):
    """Ten times the labels make about ten times the candidates, where comparing all makes a hundred times."""
    rng, words = random.Random(1), [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in "bdfglmnprst"]
    made = {}
    for many in (300, 3000):
        names = {" ".join(rng.choices(words, k=3)) for _ in range(many)}
        rows = spark.createDataFrame(list(enumerate(sorted(names))), "id long, name string").withColumn("vector", concepts.hashed_vector(F.col("name")))
        made[many] = similar.cosine_candidates(rows.select("id", "vector"), None, 0.89).count()
    assert made[3000] < 40 * max(made[300], 300) and made[3000] < 3000 * 2999 / 2 / 50


def plain_last(rows):
    return {(k, o): max((p for p in rows if p[0] == k and p[1] < o and p[2] is not None), key=lambda p: (p[1], p[2]), default=(0, 0, None))[2] for k, o, _ in rows}


def test_last_before_on_a_hot_key(spark):
    rng = random.Random(8)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 40), rng.randrange(0, 500), rng.choice([None, rng.randrange(1000)])) for _ in range(1500)] + [(None, 5, 1), (None, 6, None)]
    frame = spark.createDataFrame(rows, "k int, o int, v int").repartition(16)
    got = {(r["k"], r["o"]): r["_last"] for r in joins.last_before(frame, ["k"], "o", F.col("v")).collect()}
    assert got == plain_last(rows)
    plan = joins.last_before(frame, ["k"], "o", F.col("v"))._jdf.queryExecution().toString()
    assert "windowspecdefinition(k" not in plan.lower()


def test_provenance_with_places_of_many_parts(spark):
    rows = [("s", "a", "b", (1, 2, 3)), ("s", "b", "c", (1, 2, 4)), ("s", "b", "d", (1, 1, 9)), ("t", "b", "x", (2, 0, 0)), ("s", "c", "e", (2, 0, 0))]
    frame = spark.createDataFrame(rows, "source string, s string, o string, place struct<ord:int,sent_pos:int,clause_pos:int>")
    got = {(r["s"], r["o"]): r["prev_subject"] for r in graph.provenance(frame, "source", "s", "o", "place").collect()}
    assert got == {("a", "b"): None, ("b", "c"): "a", ("b", "d"): None, ("b", "x"): None, ("c", "e"): "b"}


def test_masks_reach_what_each_origin_reaches(spark):
    rng = random.Random(4)
    edges = [(i, f"n{rng.randrange(120)}", f"n{rng.randrange(120)}", f"src{rng.randrange(5)}.org", rng.randrange(3)) for i in range(170)]
    frame = spark.createDataFrame(edges, "edge_id long, s string, o string, source string, n_specifics int")
    names = [f"n{i}" for i in range(100)]  # more than one long
    starts = spark.createDataFrame([(n, n) for n in names], "origin string, node string")
    reach = graph.reach_masks(frame, starts, starts)
    bits = lambda m: {(r["origin"], r["node"]) for r in m.join(reach.origins, "word").where(F.getbit("mask", "bit") == 1).collect()}

    def walk(n, steps):
        seen, todo = {n}, [n]
        while todo:
            for y in steps.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    ahead, back = {}, {}
    for _, s, o, _, _ in edges:
        ahead.setdefault(s, []).append(o)
        back.setdefault(o, []).append(s)
    assert bits(reach.ahead) == {(n, m) for n in names for m in walk(n, ahead)} and bits(reach.back) == {(n, m) for n in names for m in walk(n, back)}
    pairs = spark.createDataFrame([(a, b) for a in names[:9] for b in names[50:59]], "a string, b string")
    plain = graph.route_metrics(frame, graph.reachable(frame, starts), graph.reachable(graph.reversed_edges(frame), starts), pairs)
    columns = plain.columns
    assert sorted(map(tuple, graph.masked_metrics(frame, reach, pairs).select(*columns).collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("most", [2_000_000, 0])
@pytest.mark.parametrize("small", [False, True])
def test_best_overlaps_by_index_and_by_terms(spark, monkeypatch, most, small):
    rng = random.Random(5)
    left = [(i, [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.randrange(0, 12))]) for i in range(40)] + [(40, None), (41, [])]
    right = [(i, [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.randrange(0, 40))], rng.randrange(3)) for i in range(300)] + [(300, None, 0), (301, ["w0", "w0", "w1"], 1)]
    monkeypatch.setattr(joins, "MOST_INDEXED", most)
    if small:
        monkeypatch.setattr(joins, "HELD", 50)
    from claimweave.operators.synth import support_of

    want = set()
    for i, t in left:
        s, found = set(t or []), []
        for j, u, w in right:
            r = set(u or [])
            n = len(s & r)
            if n >= 2 and max(n / len(s), 0.85 * n / len(r)) >= 0.22:
                found.append((-max(n / len(s), 0.85 * n / len(r)), -n, -w, j))
        want |= {(i, x[3], -x[1], round(-x[0], 9), place) for place, x in enumerate(sorted(found)[:3], 1)}
    a, b = spark.createDataFrame(left, "id long, terms array<string>"), spark.createDataFrame(right, "id long, terms array<string>, weight long")
    got = joins.best_overlaps(a, b, 3, support_of, 2, 0.22).collect()
    assert {(r["left_id"], r["right_id"], r["shared"], round(r["score"], 9), r["place"]) for r in got} == want


def test_a_crowded_key_is_deduped_as_in_order(spark):
    """Rounds over pairs against the fold in order, on one key of many near-duplicates and on small keys beside it."""
    from claimweave.operators import synth

    rng = random.Random(6)
    words = [f"term{i}" for i in range(60)]
    base = [rng.sample(words, 9) for _ in range(12)]
    said = lambda: " ".join(rng.sample(rng.choice(base), rng.randrange(5, 10)) + rng.sample(words, rng.randrange(0, 4)))
    rows = [(1, i, said() if rng.random() < 0.9 else rng.choice(["", "two words", "term1 term2 term3"])) for i in range(400)] + [(None, i, said()) for i in range(30)] + [(3, 0, "alone and quite different words here"), (3, 0, "alone and quite different words here")]
    frame = spark.createDataFrame(rows, "k int, ord int, text string")
    plain = sorted(map(repr, map(tuple, synth.greedy_dedupe(frame, "k").collect())))
    assert sorted(map(repr, map(tuple, synth.greedy_dedupe(frame, "k", most=10).collect()))) == plain
    assert sorted(map(repr, map(tuple, synth.greedy_dedupe(frame, "k", most=0).collect()))) == plain
    assert len(plain) < 300


def test_one_key_of_a_hundred_thousand_records(spark):
    from claimweave.operators import synth

    rows = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("ord"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64(F.floor(F.col("id") / 4), F.lit(j)), F.lit(5_000_000)).cast("string")) for j in range(8)]).alias("text"))
    assert synth.greedy_dedupe(rows, "k").count() == 25_000


def test_late_edges_open_what_a_fresh_walk_finds(spark):
    rng = random.Random(9)
    edges = [(i, f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for i in range(130)]
    frame = spark.createDataFrame(edges, "edge_id long, s string, o string")
    starts = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(6)], "origin string, node string")
    early = frame.where("edge_id < 80")
    reach = graph.reach_masks(early, starts, starts)
    bits = lambda r, m: {(x["origin"], x["node"]) for x in m.join(r.origins, "word").where(F.getbit("mask", "bit") == 1).collect()}
    for low, high in ((80, 81), (81, 130), (0, 10)):  # one, many, and some that are known
        reach = graph.extended_reach(reach, frame.where(f"edge_id < {low}") if low else frame, frame.where(f"edge_id >= {low} and edge_id < {high}"))
        fresh = graph.reach_masks(frame.where(f"edge_id < {max(high, low)}") if low else frame, starts, starts)
        assert bits(reach, reach.ahead) == bits(fresh, fresh.ahead) and bits(reach, reach.back) == bits(fresh, fresh.back)
    same = lambda df: sorted(r["edge_id"] for r in df.collect())
    assert same(graph.core_of(frame, reach)) == same(graph.route_core(frame, starts, starts))


def test_metrics_of_many_pairs_store_no_edge_for_each_pair(spark, monkeypatch):
    """Pairs over the same edges: what is stored and what pairs meet follow the edges' masks, not edges times pairs; loops, ways back and pairs of one node count as before."""
    heads, tails = [f"h{i}" for i in range(12)], [f"t{i}" for i in range(12)]
    edges = [(h, "m0") for h in heads] + [(f"m{i}", f"m{i + 1}") for i in range(9)] + [("m9", t) for t in tails] + [("m4", "m4"), ("m7", "m3"), ("t0", "h0"), ("x", "y"), ("m2", "x")]
    frame = spark.createDataFrame([(i, s, o, [f"a|src{i % 4}", "unknown", ""][i % 3], [None, 0, 2][i % 3]) for i, (s, o) in enumerate(edges)], "edge_id long, s string, o string, source string, n_specifics int")
    starts = spark.createDataFrame([(n, n) for n in [*heads, *tails, "x"]], "origin string, node string")
    reach = graph.reach_masks(frame, starts, starts)
    pairs = spark.createDataFrame([(a, b) for a in [*heads, "x"] for b in [*tails, "h0", "x"]], "a string, b string")
    plain = graph.route_metrics(frame, graph.reachable(frame, starts), graph.reachable(graph.reversed_edges(frame), starts), pairs)
    stored, real = [], graph.store
    monkeypatch.setattr(graph, "store", lambda df, tag: stored.append(df.count()) or real(df, tag))
    got = graph.masked_metrics(frame, reach, pairs).select(*plain.columns)
    rows = sorted(map(tuple, got.collect()), key=str)
    monkeypatch.undo()
    assert sum(stored) <= len(edges) and len(rows) > 150
    assert rows == sorted(map(tuple, plain.collect()), key=str)


def test_pairs_of_anchors_are_measured_in_one_pass_both_ways(spark, monkeypatch):
    from claimweave.plans import api

    edges = spark.createDataFrame([(0, "p", "q", "s|a", 1), (1, "q", "r", "s|b", 0), (2, "r", "p", "s|a", 2), (3, "r", "z", "s|c", 1)], "edge_id long, s string, o string, source string, n_specifics int")
    side = lambda names: spark.createDataFrame([(n, 1.0, 1.0, 2) for n in names], "node string, score double, grounding double, degree long")
    passes, real = [], graph.masked_metrics
    monkeypatch.setattr(graph, "masked_metrics", lambda *given: passes.append(1) or real(*given))
    got = {(r["a"], r["b"]): (r["ab_edges"], r["ba_edges"], r["ab_sources"], r["ba_specific"]) for r in api.best_pairs(edges, side(["p", "q"]), side(["r", "p", "z"])).collect()}
    assert passes == [1]
    assert got == {("p", "r"): (3, 3, 2, 2), ("p", "z"): (4, 0, 3, 0), ("q", "r"): (3, 3, 2, 2), ("q", "p"): (3, 3, 2, 2), ("q", "z"): (4, 0, 3, 0)}


def test_rows_of_the_same_keys_are_met_once(spark, monkeypatch):
    """Copies are compared as one row, and all their pairs are there."""
    sets = [["a", "b", "c", "d", "e"], ["b", "c", "d", "e", "f"], ["x", "y", "z", "u", "v"], ["a", "b"]]
    rows = [(c * 10 + i, sets[i]) for c in range(30) for i in range(4)]
    want = {(a, b, len(set(x) & set(y))) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) >= 3}
    asked, real = [], similar.met_on_terms
    monkeypatch.setattr(similar, "met_on_terms", lambda a, b, *more: asked.append(a.count()) or real(a, b, *more))
    got = [tuple(r) for r in similar.overlap_pairs(spark.createDataFrame(rows, "id long, keys array<string>"), F.col("keys"), 3).collect()]
    assert set(got) == want and len(got) == len(want)
    assert asked[0] <= 3 * 10


def test_only_names_that_may_match_are_scored(spark):
    """Every name that scores passes the cheap test, by words, stems, initials of either side, and few others do; the graph's orders do not."""
    from claimweave.functions import text as T
    from claimweave.operators import synth

    targets = ["seg building", "region asia", "city policies", "united states trade", "us", "the big running dogs", "Solid Earth Group", ""]
    words = ["seg", "segs", "Buildings", "built", "building", "policy", "policies", "city", "cities", "USA", "us", "u.s", "union", "solar", "earth", "great", "run", "runner", "running", "dog", "asian", "asia", "states", "trade", "trading", "sb", "ust", "ra", "İstanbul", "", "order:12", "cust:7", "of", "the"]
    rng = random.Random(8)
    names = [(" ".join(rng.sample(words, rng.randrange(1, 5))),) for _ in range(1500)] + [(None,), ("union state",), ("solid İearth great",)]
    frame = spark.createDataFrame(names, "name string")
    for target in targets:
        test = synth.may_name(spark, target)
        rows = frame.select("name", T.lexical_score(F.col("name"), F.lit(target), True).alias("own"), T.lexical_score(F.col("name"), F.lit(target)).alias("plain"), test(F.col("name")).alias("may")).collect()
        assert not [r for r in rows if (r["own"] > 0 or r["plain"] > 0) and not r["may"]]
    seg = synth.may_name(spark, "seg building")
    assert spark.createDataFrame([("order:1",), ("cust:2",), ("part:3",), ("supp:4",)], "name string").where(seg(F.col("name"))).isEmpty()


def test_claims_about_subjects_are_scored_once(spark, monkeypatch):
    """What is read twice holds its scores, and a clause that can't name a subject is not split further."""
    from claimweave.operators import extract
    from claimweave.plans import api

    stored, real = [], api.store
    monkeypatch.setattr(api, "store", lambda df, tag: stored.append((tag, df.columns)) or real(df, tag))
    assert api.linking_slice(spark, "/root/testdata/sf0.001").count() > 0
    assert [c for tag, c in stored if tag == "linking" and {"score_a", "score_b"} <= set(c)]
    blocks = spark.createDataFrame([(1, 1, "s", "Housing costs are high in many towns. Rents are falling in most regions.")], "block_id long, ord long, source string, content string")
    every = [r["clause"] for r in extract.clause_rows(blocks).collect()]
    assert [r["clause"] for r in extract.clause_rows(blocks, only=lambda c: c.contains("Rents")).collect()] == [c for c in every if "Rents" in c] != every
