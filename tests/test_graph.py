"""Golden graphs, walks, layout, merges."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave import session
from claimweave.operators import concepts, extract, graph, synth
from claimweave.sources import blocks, search


def edges(spark, pairs):
    return spark.createDataFrame([(i, f"n{s}", "r", f"n{o}", f"s|src{i % 2}", i % 3) for i, (s, o) in enumerate(pairs)], "edge_id long, s string, rel string, o string, source string, n_specifics int")


def nodes(spark, *n):
    return spark.createDataFrame([(f"n{x}",) for x in n], "node string")


def ids(df):
    return {(r["s"][1:], r["o"][1:]) for r in df.collect()}


GOLDEN = {
    "chain": ([(1, 2), (2, 3), (3, 4), (2, 5), (6, 3), (5, 7)], 1, 4, {"12", "23", "34"}, {"25", "63"}),
    "cycle": ([(1, 2), (2, 1), (2, 3)], 1, 3, {"12", "21", "23"}, set()),
    "loop": ([(1, 2), (2, 3), (3, 2)], 1, 2, {"12", "23", "32"}, set()),
    "unreachable": ([(1, 2), (3, 2)], 1, 3, set(), set()),
    "self": ([(1, 2), (2, 1)], 1, 1, {"12", "21"}, set()),
}


@pytest.mark.parametrize("name", list(GOLDEN))
def test_golden_cores_and_rings(spark, name):
    pairs, seed, goal, core, ring = GOLDEN[name]
    e = edges(spark, pairs)
    got = graph.route_core(e, nodes(spark, seed), nodes(spark, goal))
    assert {a + b for a, b in ids(got)} == core
    assert {a + b for a, b in ids(graph.context_ring(e, got))} == ring


def test_parallel_edges_stay_apart(spark):
    e = edges(spark, [(1, 2), (1, 2)])
    assert graph.route_core(e, nodes(spark, 1), nodes(spark, 2)).count() == 2


def test_walks_arrive(spark):
    pairs = [(i, i + 1) for i in range(15)] + [(0, 2), (3, 9), (20, 21)]
    e = edges(spark, pairs)
    tree = graph.goal_tree(e, nodes(spark, 15))
    plan = spark.createDataFrame([(k, "n0", "n15") for k in range(6)] + [(6, "n20", "n15"), (7, "n15", "n15")], "walk_id int, seed string, goal string")
    rows = {r["walk_id"]: r for r in graph.walks(e, tree, plan).collect()}
    known = {(f"n{a}", f"n{b}") for a, b in pairs}
    for k in range(6):
        path = rows[k]["path"]
        assert rows[k]["reason"] == "endpoint" and path[0] == "n0" and path[-1] == "n15" and len(rows[k]["edge_ids"]) == len(path) - 1
        assert all(step in known for step in zip(path, path[1:], strict=False))
    assert rows[6]["reason"] == "dead" and rows[7]["path"] == ["n15"]
    again = {r["walk_id"]: r["path"] for r in graph.walks(e, tree, plan).collect()}
    assert again == {k: r["path"] for k, r in rows.items()}
    s = graph.walk_stats(graph.walks(e, tree, plan)).first()
    assert (s["total"], s["dead"], s["successful"]) == (8, 1, 6)


def test_spawn_split(spark):
    seeds = spark.createDataFrame([(i, f"s{i}") for i in range(3)], "place int, node string")
    got = graph.spawn_split(64, seeds, spark.createDataFrame([(0, "g")], "place int, node string")).groupBy("seed").count().orderBy("seed").collect()
    assert [r["count"] for r in got] == [22, 21, 21]


def test_forces(spark):
    at = np.array([[0.0, 0, 0], [22.6, 0, 0]])
    still = np.zeros((2, 3))
    moved, _, _ = graph.relax(at, still, np.array([0]), np.array([1]), np.array([1.0]), 1)
    assert moved[0][0] == pytest.approx(0.02625 * 0.94) and moved[1][0] == pytest.approx(22.6 - 0.02625 * 0.94)
    moved, _, _ = graph.relax(np.array([[0.0, 0, 0], [33.6, 0, 0]]), still, np.array([0]), np.array([1]), np.array([0.0]), 1)
    assert np.allclose(moved, [[0, 0, 0], [33.6, 0, 0]])


def claim(s, rel, o, ord_, tense="unknown", truth=1, q="unknown", u=0.5):
    return (s, rel, o, q, "unknown", tense, truth, u, [("date", str(ord_), "x")], "d|a.b" if ord_ else "unknown", f"t{ord_}", ord_ if ord_ else None, ord_)


CLAIM = "s string, rel string, o string, s_quant string, p_quant string, tense string, truth int, utility double, specifics array<struct<kind:string,text:string,source:string>>, source string, evidence string, prev long, ord long"


def test_exact_and_compatible_merges(spark):
    rows = [claim("a", "is", "b", 0, "past"), claim("a", "is", "b", 1, "past", u=0.9), claim("a", "is", "b", 2, q="some"), claim("a", "is", "b", 3, "past", truth=0)]
    exact = graph.merged_edges(spark.createDataFrame(rows, CLAIM))
    one = exact.where("tense = 'past' and truth = 1").first()
    assert exact.count() == 3 and one["utility"] == 0.9 and one["n_claims"] == 2 and one["source"] == "d|a.b" and len(one["specifics"]) == 2 and one["prev_nodes"] == [1]
    merged = sorted((r["s_quant"], r["tense"], r["truth"], r["n_claims"]) for r in graph.compatible_edges(exact).collect())
    assert merged == [("some", "past", 1, 3), ("unknown", "past", 0, 1)]


def plain_fold(rows):
    """compatible_edges of one pair's rows (ord, states, utility, n_claims) in plain Python."""
    kept, blank = [], lambda v: v is None or v == "unknown"
    for row in sorted(rows, key=lambda r: r[0]):
        row = list(row)
        fits = [k for k in kept if all(blank(k[c]) or blank(row[c]) or k[c] == row[c] for c in range(1, 5))]
        if not fits:
            kept.append(row)
            continue
        into = max(fits, key=lambda k: (sum(not blank(k[c]) for c in range(1, 5)), -k[0]))
        into[1:5] = [r if blank(k) else k for k, r in zip(into[1:5], row[1:5])]
        into[5], into[6] = max(into[5], row[5]), into[6] + row[6]
    return kept


def test_compatible_edges_fold_without_a_task_a_pair(spark):
    import random
    from decimal import Decimal

    rng, rows, n = random.Random(5), [], 0
    for pair in range(60):
        for _ in range(rng.randint(1, 14)):
            n += 1
            rows.append((f"s{pair}", "is", "o", rng.choice(["unknown", None, "all", "few"]), rng.choice(["unknown", "one", "most"]), rng.choice([None, "past", "present"]), rng.choice([0, 1, None]), rng.random(), rng.randint(1, 3), Decimal(n * 7919 % 10007)))
    df = spark.createDataFrame(rows, "s string, rel string, o string, s_quant string, p_quant string, tense string, truth tinyint, utility double, n_claims long, ord decimal(38,0)")
    got = graph.compatible_edges(df)
    assert "InPandas" not in got._jdf.queryExecution().toString()
    mine = sorted(((r["s"], int(r["ord"]), *[r[c] for c in ("s_quant", "p_quant", "tense", "truth", "utility", "n_claims")]) for r in got.collect()), key=repr)
    plain = [(s, *k) for s in {r[0] for r in rows} for k in plain_fold([(r[9], *r[3:9]) for r in rows if r[0] == s])]
    assert mine == sorted(plain, key=repr)


@pytest.mark.parametrize("seeds,goals", [([1], [4]), ([1, 9], [4, 9]), ([3], [3]), ([6], [5, 6]), ([9], [1])])
def test_ring_between_is_the_ring_of_the_core(spark, seeds, goals):
    pairs = [(1, 2), (2, 3), (3, 4), (2, 5), (6, 3), (5, 7), (4, 8), (8, 8), (9, 10), (11, 9), (3, 2)]
    e = spark.createDataFrame([(i, f"n{s}", "r", f"n{o}", i % 2) for i, (s, o) in enumerate(pairs)], "edge_id long, s string, rel string, o string, n_specifics int")
    named = lambda ids: spark.createDataFrame([(f"n{i}",) for i in ids], "node string")
    for only in (False, True):
        whole = graph.context_ring(e, graph.route_core(e, named(seeds), named(goals)), only)
        assert sorted(graph.ring_between(e, named(seeds), named(goals), only).collect()) == sorted(whole.collect())


def test_pruning_summary_does_not_join_the_core_with_the_edges(spark):
    e = spark.createDataFrame([(1, "a", "r", "b", 0), (2, "b", "r", "c", 2), (3, "c", "r", "d", 1)], "edge_id long, s string, rel string, o string, n_specifics int")
    got = graph.pruning_summary(e, e.where("edge_id < 3"))
    assert tuple(got.first()) == (2, 1, 1) and "edge_id" not in got._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert tuple(graph.pruning_summary(e, e.where("edge_id > 5")).first()) == (0, 3, 0)


def test_provenance_is_strictly_earlier(spark):
    rows = spark.createDataFrame([(1, "d", "a", "b"), (2, "d", "b", "c"), (3, "d", "b", "b"), (4, "e", "b", "c"), (5, "d", "b", "x")], "ord long, source string, s string, o string")
    got = {r["ord"]: (r["prev_ord"], r["prev_subject"]) for r in graph.provenance(rows, "source", "s", "o", "ord").collect()}
    assert got == {1: (None, None), 2: (1, "a"), 3: (1, "a"), 4: (None, None), 5: (3, "b")}


def test_metrics_on_chain(spark):
    e = spark.createDataFrame([(1, "n1", "r", "n2", "s1|a", 0), (2, "n2", "r", "n3", "s1|a", 0), (3, "n3", "r", "n4", "s2|b", 2)], "edge_id long, s string, rel string, o string, source string, n_specifics int")
    start = lambda n: spark.createDataFrame([(n, n)], "origin string, node string")
    pairs = spark.createDataFrame([("n1", "n4")], "a string, b string")
    r = graph.route_metrics(e, graph.reachable(e, start("n1")), graph.reachable(graph.reversed_edges(e), start("n4")), pairs).first()
    assert (r["n_edges"], r["n_nodes"], r["n_sources"], r["score"]) == (3, 4, 2, pytest.approx(9.65))


def test_diversity_numbers(spark):
    rows = [(1, "s|a"), (1, "s|b"), (1, "s|c"), (2, "s|a"), (2, "s|a"), (2, "s|a"), (2, "s|a"), (3, "s|a"), (3, "s|a"), (3, "s|a"), (3, "s|b")]
    got = {r["arg"]: round(r["multiplier"], 3) for r in synth.source_diversity(spark.createDataFrame(rows, "arg int, source string"), "arg").collect()}
    assert got == {1: 1.0, 2: 0.45, 3: 0.583}


def test_greedy_selection(spark):
    rows = [(1, 1, "alpha beta gamma delta"), (1, 2, "alpha beta gamma epsilon"), (1, 3, "one two six"), (1, 4, "one two six")]
    kept = synth.greedy_dedupe(spark.createDataFrame(rows, "k int, ord int, text string"), "k").orderBy("ord").collect()
    assert [r["ord"] for r in kept] == [1, 3, 4]
    a = spark.createDataFrame([(0, 1, "x", ["a", "b"]), (0, 2, "y", ["a", "b"]), (0, 3, "x", ["c"]), (0, 4, "z", ["d"])], "k int, rank int, signature string, mechanism array<string>")
    assert [r["rank"] for r in synth.diverse_top(a, "k").orderBy("pick").collect()] == [1, 4, 2]


def test_report_numbers_are_compact():
    text = synth.polished("# Findings\nArgument 1: rents rose [4]. The payload fell [2] [9].\n## Sources\n[4]: x", [(4, "a.b"), (2, "c.d")])
    assert text == "rents rose [1]. The claim fell [2].\n\n## Sources\n[1]: a.b\n[2]: c.d"


def test_concepts(spark):
    v = spark.createDataFrame([([0.6, 0.8],), ([1.0, 0.0],)], "v array<double>")
    got = [r["t"] for r in v.select(F.round(concepts.vector_specificity(F.col("v")), 6).alias("t")).collect()]
    assert got == [0.4, 0.5]
    names = spark.createDataFrame([("Housing Market",), ("housing  market",), ("housing markets",), ("rent control",), (None,)], "name string")
    rows = {r["norm"]: r for r in concepts.resolve(names).collect()}
    assert set(rows) == {"housing market", "housing markets", "rent control"} and rows["rent control"]["merge_count"] == 1
    order = spark.createDataFrame([(0, 1, "a", [1.0, 0.0]), (0, 2, "b", [1.0, 0.01]), (0, 3, "c", [0.0, 1.0]), (0, 4, "a", [0.0, 1.0])], "group_id long, ord long, name string, vector array<double>")
    assert [r["concept"] for r in concepts.resolve_in_order(order).orderBy("ord").collect()] == [0, 0, 1, 0]
    late = spark.createDataFrame([("A", "B"), ("A", "new"), ("A", "a")], "subject string, predicate string")
    known = spark.createDataFrame([("a",), ("b",)], "label string")
    assert [tuple(r) for r in concepts.refine(known, late).collect()] == [("a", "b")]


def test_claims_of_plain_sentences(spark):
    rows = [(1, 1, "", "doc|1", "Rent control is a price ceiling. New zoning rules reduced housing supply. Prices rose by $3.5 million in 2020.")]
    got = extract.claims(spark.createDataFrame(rows, "block_id long, ord long, url string, source string, content string")).collect()
    said = {(r["subject"], r["relation"], r["predicate"]) for r in got}
    assert ("Rent control", "is", "price ceiling") in said and any(r in ("rules", "reduced") for _, r, _ in said)


def test_sources(spark):
    hits = spark.createDataFrame([("q", 0, "T", "http://a.b/x", "short", "y" * 100), ("q", 1, "U", "http://a.b/z", "s" * 90, "")], "query string, ord int, title string, url string, snippet string, page_text string")
    b = blocks.hit_blocks(hits).orderBy("ord").collect()
    assert [(r["source"], len(r["content"])) for r in b] == [("T|http://a.b/x", 100), ("U|http://a.b/z", 90)]
    assert search.parse_hits("q", '["q", ["t"], ["s"], ["u"]]') == [("q", 0, "t", "u", "s", None)]
    assert [r[:5] for r in search.parse_hits("q", "nonsense")] == [("q", None, None, None, None)] and search.parse_hits("q", "nonsense")[0][5]
    c = spark.createDataFrame([('{"id": "1", "target_a": "x", "target_b": "y"}',), ("x | y",)], "d string").select(blocks.command(F.col("d")).alias("c")).select("c.*").collect()
    assert [(r["target_a"], r["target_b"]) for r in c] == [("x", "y"), ("x", "y")]
    with pytest.raises(ValueError):
        blocks.check_command(" ", "b")


def test_cache_and_results(spark, tmp_path):
    spark.conf.set("spark.sql.sources.commitProtocolClass", spark.conf.get("spark.sql.sources.commitProtocolClass"))
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    made = []

    def make(missing):
        made.append(missing.count())
        return missing.withColumn("v", F.upper("k"))

    name = uuid.uuid4().hex  # the shared folder may outlive a run
    assert blocks.cached(spark, rows, F.col("k"), make, name).count() == 2
    more = rows.unionByName(spark.createDataFrame([("c",)], "k string"))
    assert {r["v"] for r in blocks.cached(spark, more, F.col("k"), make, name).collect()} == {"A", "B", "C"} and made == [2, 1]
    e = spark.createDataFrame([("a", "is", "b", "s", 0.5)], "s string, rel string, o string, source string, utility double")
    blocks.write_results("the report", e, e.limit(1), f"{tmp_path}/results/r1")
    assert [(r["name"], r["report"].strip()) for r in blocks.read_results(spark, f"{tmp_path}/results").collect()] == [("r1", "the report")]
    with pytest.raises(ValueError):
        blocks.read_results(spark, "../x")


def test_a_level_moves_its_frontier_only(spark, capsys):
    e = edges(spark, [(i, i + 1) for i in range(50)])
    frontier = spark.createDataFrame([(True, 0, "n3"), (False, 0, "n9")], "ahead boolean, origin int, node string")
    met = graph.steps_of(e).from_nodes(frontier, "origin")
    met.explain()
    plan = capsys.readouterr().out
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning") == 2
    assert {(r["ahead"], r["node"]) for r in met.collect()} == {(True, "n4"), (False, "n8")}


def test_stored_buckets_are_discarded(spark):
    made = session.store_by(spark.range(10), "gone", "id")
    named = session.NAMED[made.path]
    assert spark.catalog.tableExists(named)
    session.discard(spark, made.path)
    assert not spark.catalog.tableExists(named) and made.path not in session.STORED


def test_late_edges_walk_only_steps_that_may_still_pass_a_bit(spark):
    import random

    random.seed(4)
    edges = sorted({(f"n{random.randrange(60)}", f"n{random.randrange(60)}") for _ in range(200)})
    e = spark.createDataFrame([(i, s, o, i % 6) for i, (s, o) in enumerate(edges)], "edge_id long, s string, o string, batch int")
    start = lambda *names: spark.createDataFrame([(n, n) for n in names], "origin string, node string")
    starts, ends = start("n1", "n2"), start("n3", "n4")
    steps = graph.steps_of(e, "batch")
    reach = graph.reach_masks(steps.where("batch > 1"), starts, ends)
    few = graph.open_steps(steps, reach, "batch")
    count = lambda of: of.ahead.count() + of.back.count()
    assert 0 < count(few) < count(steps) == 2 * len(edges)
    full = {r["node"] for r in reach.ahead.groupBy("node").agg(F.sum(F.bit_count("mask")).alias("n")).where("n = 2").collect()}
    assert full and {(r["node"], r["to"]) for r in few.ahead.collect()} == {(s, o) for s, o in edges if o not in full}
    for batch in range(2):
        reach = graph.extended_reach(reach, few.where(f"batch > 1 or batch <= {batch}"), few.where(f"batch = {batch}"))
    whole = graph.reach_masks(steps, starts, ends)
    rows = lambda found: sorted((r["origin"], r["node"]) for r in found.join(reach.origins, "word").where("getbit(mask, bit) = 1").collect())
    told = lambda found, origins: sorted((r["origin"], r["node"]) for r in found.join(origins, "word").where("getbit(mask, bit) = 1").collect())
    assert rows(reach.ahead) == told(whole.ahead, whole.origins) and rows(reach.back) == told(whole.back, whole.origins)
    assert reach.held.groupBy("ahead", "word", "node").count().where("count > 1").count() == 0
    assert "Exchange" not in reach.held.groupBy("node").count()._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, graph.core_of(e.select("edge_id", "s", "o"), reach).collect())) == sorted(map(tuple, graph.core_of(e.select("edge_id", "s", "o"), whole).collect()))


def test_only_sentences_that_may_fit_are_cut_into_clauses(spark):
    rows = spark.createDataFrame([(1, 1, "s", "Tall trees hold dark rooms and red foxes run there. The old fox is quick but rents fall, and the city was large; small towns had parks. Grey cats slept."), (2, 2, "s", "No verb. [see <b>fox</b> is] it"), (3, 3, "s", None)], "block_id long, ord long, source string, content string")
    only = lambda c: c.rlike(extract.HAS_LINK)
    few, every = extract.clause_rows(rows, only=only), extract.clause_rows(rows)
    assert sorted(few.collect()) == sorted(every.where(only(F.col("clause"))).collect()) and 0 < few.count() < every.count()
    said = few._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("became") == 2  # sentences are tested too, not only their clauses
    assert extract.clause_rows(rows, True, only).count() == extract.clause_rows(rows, True).where(only(F.col("clause"))).count()
