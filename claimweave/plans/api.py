"""connect(): two subjects and a corpus to a cited report, each stage a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.functions import words as W
from claimweave.operators import concepts, extract, graph, synth
from claimweave.session import spread, store, table
from claimweave.sources import blocks


def linking_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rank, side, subject, relation, predicate, score, source_ref, evidence of the linking claims about two subjects.

    The subjects are the two content tokens in most documents (ties by token), whatever the language.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    words_ = docs.select("doc_id", F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    subjects = [r["t"] for r in words_.orderBy(F.desc("n"), "t").limit(2).collect()]  # two rows
    a, b = (subjects + ["", ""])[:2]
    # what a claim says stands in its clause, so a clause that can't name a subject needs no dear test
    may = synth.may_name(spark, a, b)
    clauses = extract.clause_rows(blocks.document_blocks(docs), only=lambda c: c.rlike(extract.HAS_LINK) & may(c))
    found = F.filter(F.array(extract.linking(F.col("clause"))), lambda l: l["relation"] != "")  # worked out once, where a filter would do so again
    claims = clauses.withColumn("l", F.explode(found)).select("block_id", "sent_pos", "clause_pos", "source", "clause", "l.*")
    said = F.concat_ws(" ", "subject", "predicate")
    score = lambda target: F.when(may(said), T.lexical_score(said, F.lit(target))).otherwise(0.0)
    scored = store(claims.withColumns({"score_a": score(a), "score_b": score(b)}), "linking").df
    kept = scored.where((F.col("score_a") >= W.MATCH) | (F.col("score_b") >= W.MATCH))
    both = (F.col("score_a") >= W.MATCH) & (F.col("score_b") >= W.MATCH)
    side = F.when(both, "both").when(F.col("score_a") >= W.MATCH, "a").otherwise("b")
    numbers = kept.groupBy(F.col("source").alias("_src")).agg(F.min(F.struct("block_id", "sent_pos", "clause_pos")).alias("at"))
    numbers = synth.numbered(numbers, [F.col("at")], "source_ref").select("_src", "source_ref")
    rows = kept.join(numbers, kept["source"] == numbers["_src"]).withColumns({"_both": both, "_best": F.greatest("score_a", "score_b"), "side": side})
    order = [F.desc("_both"), F.desc("_best"), F.col("block_id"), F.col("sent_pos"), F.col("clause_pos")]
    return synth.numbered(rows, order, "rank").select("rank", "side", "subject", "relation", "predicate", F.round("_best", 6).alias("score"), "source_ref", F.col("clause").alias("evidence"))


@dataclass
class Connection:
    """What connect() returns: the tables of each stage, and the report."""

    edges: DataFrame
    core: DataFrame
    anchors: DataFrame
    walks: DataFrame
    arguments: DataFrame
    report: str
    #: The pairs that were chosen, and the next best, with what ranked them.
    pairs: DataFrame | None = None


def claim_edges(claims: DataFrame, embed=None, concept_path: str | None = None) -> DataFrame:
    """Claims with resolved ends, merged to edges: edge_id, s, rel, o, ..., n_specifics.

    concept_path (S11): a concept table that survives calls, read and added to.
    """
    norm = lambda c: F.lower(T.squeezed(F.col(c)))
    names = claims.select(F.col("subject").alias("name")).unionByName(claims.select(F.col("predicate").alias("name")))
    embed = embed or concepts.hashed_vector
    made = concepts.stored_concepts(claims.sparkSession, names, concept_path, embed) if concept_path else concepts.resolve(names, embed)
    known = store(made.select("norm", "canonical"), "concepts").df
    end = lambda c, out: known.select(F.col("norm").alias(f"_{c}"), F.col("canonical").alias(out))
    place = F.struct("ord", "sent_pos", "clause_pos")
    rows = claims.withColumns({"_subject": norm("subject"), "_predicate": norm("predicate"), "place": place}).join(end("subject", "s"), "_subject").join(end("predicate", "o"), "_predicate").where("s <> o")
    use = graph.utility(F.col("s"), F.col("relation"), F.col("o"), F.col("specifics"))
    rows = rows.withColumn("specifics", F.array_distinct(F.concat("s_specifics", "p_specifics", "c_specifics"))).withColumns({"rel": F.col("relation"), "utility": use})
    before = graph.provenance(rows.select("source", "s", "o", "place"), "source", "s", "o", "place").groupBy("source", "place").agg(F.max("prev_ord").alias("prev"))
    rows = rows.join(before, ["source", "place"], "left").withColumn("ord", F.col("place"))
    merged = graph.merged_edges(rows)
    return merged.withColumns({"edge_id": F.xxhash64("s", "rel", "o", "s_quant", "p_quant", "tense", "truth"), "n_specifics": F.size("specifics")})


def connect(spark: SparkSession, target_a: str, target_b: str, source_blocks: DataFrame, more_edges: DataFrame | None = None, n_walks: int = 64, writer: Callable[[str], str] | None = None, later_blocks: DataFrame | None = None, concept_path: str | None = None, embed: Callable[[Column], Column] = concepts.hashed_vector, cache: str | None = None) -> Connection:
    """S19, then extraction, merging, anchors, routes, walks, arguments and a report.

    source_blocks: block_id, ord, url, source, content. more_edges: further edges (s, rel, o,
    source, evidence, utility, n_specifics, edge_id), for example from relational tables.
    later_blocks (T3): blocks of a second search pass; their claims update edges between known
    nodes and make no new ones. concept_path (S11): a concept table that survives calls. Only the
    anchors (at most 64), the chosen pairs (4) and the picked arguments (3) come to the driver.
    """
    blocks.check_command(target_a, target_b)
    named = ["edge_id", "s", "rel", "o", "source", "evidence", "utility", "n_specifics"]
    found = extract.cached_claims(spark, source_blocks, cache) if cache else extract.claims(source_blocks)
    claims = store(extract.expanded(store(found, "claims").df), "expanded").df
    if later_blocks is not None:
        ends = claims.select(F.col("subject").alias("label")).unionByName(claims.select(F.col("predicate").alias("label"))).distinct()
        late = extract.expanded(store(extract.claims(later_blocks), "late-claims").df)
        claims = claims.unionByName(concepts.refine(ends, late))
    edges = claim_edges(claims, embed, concept_path).select(*named)
    edges = store(edges if more_edges is None else edges.unionByName(more_edges.select(*named)), "edges").df
    anchors = store(anchors_of(edges, target_a, target_b, embed), "anchors").df
    pairs = store(best_pairs(edges, *sides_of(anchors)), "pairs").df
    chosen = pairs.where("selected")
    ends = [(r["a"], r["b"]) for r in chosen.orderBy("place").select("a", "b").collect()]  # four rows at most
    if not ends:
        none = spark.createDataFrame([], "walk_id int, seed string, goal string, path array<string>, edge_ids array<bigint>, reason string")
        return Connection(edges, edges.limit(0), anchors, none, none, synth.template_report(target_a, target_b, [], []), pairs)
    node = lambda names: spark.createDataFrame([(i, n) for i, n in enumerate(dict.fromkeys(names))], "place int, node string")
    a, b = node([x for x, _ in ends]), node([y for _, y in ends])
    core = store(graph.route_core(edges, a, b).unionByName(graph.route_core(edges, b, a)).dropDuplicates(["edge_id"]), "core").df
    made = []
    for route, (start, end) in {"a_to_b": (a, b), "b_to_a": (b, a)}.items():
        tree = store(graph.goal_tree(core, end.select("node")), "tree").df
        made.append(graph.walks(core, tree, graph.spawn_split(n_walks // 2, start, end)).withColumn("route", F.lit(route)))
    walked = store(made[0].unionByName(made[1]), "walked").df
    arguments, report = argue(edges, walked, target_a, target_b, writer)
    return Connection(edges, core, anchors, walked, arguments, report, pairs)


def anchors_of(edges: DataFrame, target_a: str, target_b: str, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Side (a, b), node, name, score, name_score, lexical_score, vector_score, degree: the nodes that best name each subject.

    edges: s, o, and if there, evidence and utility, by which a node is grounded in its strongest texts.
    """
    if "evidence" in edges.columns:
        degrees = store(graph.degrees(edges), "degrees").df
    else:  # a node is named by its name only, so only what may name a subject is counted
        fits = synth.may_name(edges.sparkSession, target_a, target_b)
        degrees = store(graph.degrees(edges.where(fits(F.col("s")) | fits(F.col("o")))).where(fits(F.col("node"))), "degrees").df

    def best(own: str, other: str, side: str) -> DataFrame:
        named = degrees.select("node", F.col("node").alias("name"), "degree")
        if "evidence" in edges.columns:
            named = named.join(synth.grounding_scores(edges, own), "node", "left").withColumn("grounding", F.coalesce("grounding", F.lit(0.0)))
        else:
            named = named.withColumn("grounding", F.lit(0.0))
        found = synth.ranked_anchors(named, own, other, embed=embed)
        return found.select(F.lit(side).alias("side"), "node", "name", "score", "name_score", "lexical_score", "vector_score", "degree")

    return best(target_a, target_b, "a").unionByName(best(target_b, target_a, "b"))


def sides_of(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The anchors of each side, with their grounding: the better of name and texts."""
    side = lambda s: anchors.where(F.col("side") == s).select("node", "score", F.col("lexical_score").alias("grounding"), "degree")
    return side("a"), side("b")


def best_pairs(edges: DataFrame, seeds: DataFrame, goals: DataFrame, more: int = 8) -> DataFrame:
    """The four best pairs of anchors with a route one way or the other (selected), and the next more of them.

    seeds, goals: node, score, grounding, degree.
    """
    both = seeds.select("node").unionByName(goals.select("node")).distinct()
    starts = both.select(F.col("node").alias("origin"), "node")
    reach = graph.reach_masks(edges, starts, starts)
    # anchors meet by reachability, not by a product: a pair exists if one's bit is in the other's mask
    a, b = seeds.select(F.col("node").alias("a")), goals.select(F.col("node").alias("b"))
    masks = reach.ahead.join(both, "node", "left_semi").join(reach.origins, "word").where(F.getbit(F.col("mask"), F.col("bit")) == 1)
    hit = masks.select(F.col("origin").alias("x"), F.col("node").alias("y")).where("x <> y")
    hit = store(hit, "hits").df
    between = lambda found, x, y: found.join(a.withColumnRenamed("a", x), x, "left_semi").join(b.withColumnRenamed("b", y), y, "left_semi")
    ways = between(hit, "x", "y").unionByName(between(hit, "y", "x")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = store(graph.masked_metrics(edges, reach, ways).select(F.col("a").alias("x"), F.col("b").alias("y"), "n_edges", "score", "n_sources", "n_specific_edges"), "pair-metrics").df  # both ways in one pass
    named = lambda p: [F.col(c).alias(f"{p}_{n}") for c, n in (("n_edges", "edges"), ("score", "score"), ("n_sources", "sources"), ("n_specific_edges", "specific"))]
    ab = between(found, "x", "y").select(F.col("x").alias("a"), F.col("y").alias("b"), *named("ab"))
    ba = between(found, "y", "x").select(F.col("y").alias("a"), F.col("x").alias("b"), *named("ba"))
    rows = ab.join(ba, ["a", "b"], "full").na.fill(0)
    side = lambda df, p: df.select(F.col("node").alias(p), F.col("score").alias(f"{p}_score"), F.col("grounding").alias(f"{p}_grounding"), F.col("degree").alias(f"{p}_degree"))
    ranked = synth.ranked_pairs(rows.join(side(seeds, "a"), "a").join(side(goals, "b"), "b"), W.LIMITS["pairs"] + more)
    place = F.row_number().over(Window.orderBy(F.desc("rank"), "a", "b"))  # twelve rows
    return ranked.withColumn("place", place).withColumn("selected", F.col("place") <= W.LIMITS["pairs"])


def chain_steps(said: DataFrame, most: int = W.LIMITS["chain_steps"]) -> DataFrame:
    """The steps (arg, hop) of each argument's chain: of a longer one the first and the last most."""
    last = said.groupBy(F.col("arg").alias("_arg")).agg(F.max("hop").alias("_last"))
    far = F.col("_last") - F.col("hop")
    return said.join(last, said["arg"] == last["_arg"]).where((F.col("hop") == 0) | (far < most)).drop("_arg", "_last")


def argue(edges: DataFrame, walked: DataFrame, target_a: str, target_b: str, writer: Callable[[str], str] | None) -> tuple[DataFrame, str]:
    """Walks to ranked, differing arguments and a report."""
    steps = walked.where("reason = 'endpoint'").select("route", "walk_id", F.posexplode("edge_ids").alias("hop", "edge_id"))
    said = steps.join(edges.select("edge_id", "source", F.when(F.col("evidence") != "", F.col("evidence")).otherwise(F.concat_ws(" ", "s", "rel", "o")).alias("text")), "edge_id").withColumn("arg", F.concat_ws(":", "route", F.col("walk_id").cast("string")))
    said = store(chain_steps(said), "said").df
    support = synth.source_diversity(said, "arg")
    texts = said.groupBy("arg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop", "text"))), lambda x: x["text"]), " ").alias("path_text"), F.sum(T.concrete_count(F.col("text"))).alias("concrete"), F.count("*").alias("steps"))
    a, b = T.target_tokens(F.lit(target_a), 2), T.target_tokens(F.lit(target_b), 2)
    tokens_ = T.target_tokens(F.col("path_text"), 2)
    hits = lambda t: F.size(F.array_intersect(tokens_, t)) / F.greatest(F.size(t), F.lit(1))
    rows = texts.join(support, "arg").withColumns({"endpoint_reached": F.lit(True), "match_a": hits(a), "match_b": hits(b), "lexical_a": T.grounding_match(F.col("path_text"), F.lit(target_a))})
    rows = synth.successful(rows).withColumns({"case": F.lit(0), "signature": F.lower("path_text"), "mechanism": synth.mechanism(F.col("path_text"), target_a, target_b)})
    rank = F.row_number().over(Window.partitionBy("case").orderBy(F.desc(F.col("match_a") + F.col("match_b")), F.desc("concrete"), F.desc("n_sources"), F.desc("support_score"), F.desc("steps"), "arg"))
    rows = rows.withColumns({"rank": rank, "label": T.confidence(F.col("support_score"), F.col("match_a"), F.col("match_b"))})
    picked = store(synth.diverse_top(rows.select("case", "arg", "rank", "label", "signature", "mechanism", "support_score"), "case"), "picked").df
    mine = said.join(picked.select("arg", "pick"), "arg").select("arg", "pick", "hop", "edge_id", "text", "source")
    # The best path records, then specific context at the path's nodes that is not on it
    path = synth.path_order(mine, "arg", target_a, target_b).withColumn("hop", F.col("place")).drop("place")
    at = mine.join(edges.select("edge_id", "s", "o"), "edge_id").select("arg", "pick", "edge_id", F.explode(F.array("s", "o")).alias("node")).distinct()
    near = edges.join(at.select(F.col("node").alias("s")).distinct(), "s", "left_semi").unionByName(edges.join(at.select(F.col("node").alias("o")).distinct(), "o", "left_semi").select(*edges.columns)).dropDuplicates(["edge_id"])
    found = synth.specific_context(near, at).join(at.select("arg", "pick", "node").distinct(), "node").select("arg", "pick", "edge_id", "text", "source").distinct()
    context = synth.context_order(synth.context_without_path(found, path, "arg"), path, "arg", target_a, target_b).withColumn("hop", F.col("place") + 1000).drop("place")
    records = store(path.select("arg", "pick", "hop", "text", "source").unionByName(context.select("arg", "pick", "hop", "text", "source")), "records").df
    numbers = store(synth.source_numbers(records.select("source", "pick", "hop"), ["pick", "hop"]), "source-numbers").df
    numbered = records.withColumn("_shown", T.display_source(F.col("source"))).join(numbers.select(F.col("source").alias("_shown"), "number"), "_shown", "left")
    chained = synth.chain_text(numbered.select("arg", "hop", "text", "number"), "arg", ["hop"])
    shown = [(r["label"], r["text"]) for r in picked.join(chained, "arg").orderBy("pick").select("label", "text").collect()]  # three rows at most
    sources = [(r["number"], r["source"]) for r in numbers.orderBy("number").collect()]  # at most one for each record of three arguments
    prose = (lambda draft: with_citations(writer(draft), numbered)) if writer else None
    return picked, synth.template_report(target_a, target_b, shown, sources, prose)


def with_citations(report: str, records: DataFrame) -> str:
    """the sentences of a report with the sources of the records that support them (records: text, number)."""
    spark = records.sparkSession
    said = [(i, s) for i, s in enumerate(s for p in report.split("\n\n") for s in synth.sentences_of(p))]
    if not said:
        return report
    known = records.where("number is not null").groupBy("number").agg(F.array_join(F.collect_set("text"), " ").alias("text")).select(F.col("number").cast("long").alias("id"), "text")
    found = synth.citations(spark.createDataFrame(said, "id long, text string"), known).orderBy("sent_id", "place").collect()  # two for each sentence of a report
    refs: dict[int, list[int]] = {}
    for r in found:
        refs.setdefault(r["sent_id"], []).append(r["rec_id"])
    return synth.cited(report, refs)
