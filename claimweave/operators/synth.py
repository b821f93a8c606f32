"""Arguments: anchors, pairs, support, diversity, near-duplicates, citations, report."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.functions import words as W
from claimweave.operators.dedupe import without_near_duplicates
from claimweave.operators.joins import best_overlaps
from claimweave.session import store


def name_quality(name: Column) -> Column:
    """P20: how fit a label is as an anchor: long ones lose."""
    t = F.size(T.target_tokens(name))
    base = F.when(t > 6, F.greatest(F.lit(0.45), 1.0 - 0.08 * (t - 6))).otherwise(1.0)
    return F.when((t == 0) | T.clause_like(name), 0.0).otherwise(base * F.when(F.length(name) > 56, 0.75).otherwise(1.0))


def may_name(spark: SparkSession, *targets: str) -> Callable[[Column], Column]:
    """The cheap test of text.may_name for some targets, whose terms are worked out once."""
    parts = [F.struct(T.target_tokens(F.trim(F.lit(t))).alias("tokens"), T.acronyms(F.lit(t)).alias("initials")) for t in targets]
    found = spark.range(1).select(F.array(*parts).alias("t")).first()["t"]
    return lambda name: T.may_name(name, [(t["tokens"], t["initials"]) for t in found])


def ranked_anchors(nodes: DataFrame, target: str, opposite: str = "", limit: int = 32, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """O1: node, name, score, name_score, lexical_score, vector_score, degree of the nodes that best name a target.

    nodes: node, name, degree, grounding (a score from surrounding texts, 0 if none), which counts .65;
    nodes that name the other side drop out. embed: an embedder of texts, for the cosine of name and
    target beside what their words share; only names that pass by their words are embedded.
    """
    name = F.col("name")
    own, other = T.lexical_score(name, F.lit(target), True), T.lexical_score(name, F.lit(opposite))
    lexical = F.greatest(own, F.col("grounding"))
    rows = nodes.where(may_name(nodes.sparkSession, target)(name) | (F.col("grounding") >= W.MATCH))  # most names share nothing
    rows = rows.withColumns({"name_score": own, "lexical_score": lexical, "_other": other if opposite else F.lit(0.0)})
    rows = rows.where((F.col("lexical_score") >= W.MATCH) & ~((F.col("_other") >= 0.9) & (F.col("name_score") < 0.5))).drop("_other")
    vector = T.cosine(embed(name), embed(F.lit(target))) if embed else F.lit(0.0)
    rows = rows.withColumn("vector_score", vector).withColumn("score", F.greatest("name_score", "vector_score", 0.65 * F.col("lexical_score")) * name_quality(name))
    return rows.where(F.col("score") >= W.MATCH).orderBy(F.desc("score"), F.desc("name_score"), F.desc("degree"), F.desc("name"), "node").limit(limit)


def ranked_pairs(pairs: DataFrame, limit: int = W.LIMITS["pairs"]) -> DataFrame:
    """O2: the best pairs by route score times the weaker anchor, then the rest of the nine-part rank.

    pairs: a, b, a_score, b_score, a_grounding, b_grounding, a_degree, b_degree, and there and back:
    ab_edges, ba_edges, ab_score, ba_score, ab_sources, ba_sources, ab_specific, ba_specific (0 if no route).
    With a greater limit the next best follow, for diagnostics.
    """
    route = F.col("ab_score") + F.col("ba_score")
    floor = F.least("a_score", "b_score")
    rank = [
        route * F.greatest(F.lit(0.25), floor), route, F.col("ab_sources") + F.col("ba_sources"), F.col("ab_specific") + F.col("ba_specific"),
        ((F.col("ab_edges") > 0) & (F.col("ba_edges") > 0)).cast("int"), floor, F.col("a_score") + F.col("b_score"), F.col("a_grounding") + F.col("b_grounding"), F.col("a_degree") + F.col("b_degree"),
    ]
    rows = pairs.where("a <> b and (ab_edges > 0 or ba_edges > 0)").withColumn("rank", F.struct(*[r.cast("double").alias(f"r{i}") for i, r in enumerate(rank)]))
    return rows.orderBy(F.desc("rank"), "a", "b").limit(limit)


def source_diversity(records: DataFrame, key: str) -> DataFrame:
    """Key, n_records, n_sources, dominant_share, multiplier, support_score of each argument. records: key, source."""
    per = records.groupBy(key, F.lower(F.rtrim(T.display_source(F.col("source")))).alias("src")).agg(F.count("*").alias("n"))
    agg = per.groupBy(key).agg(F.sum("n").alias("n_records"), F.count("*").alias("n_sources"), (F.max("n") / F.sum("n")).alias("dominant_share"))
    spread = F.least(F.lit(1.0), F.col("n_sources") / 3.0)
    even = F.greatest(F.lit(0.45), 1 - F.greatest(F.lit(0.0), F.col("dominant_share") - F.lit(1.0) / 3))
    out = agg.withColumn("multiplier", F.greatest(F.lit(0.45), F.least(spread, even)))
    return out.withColumn("support_score", 100 * F.col("multiplier"))


def recent_context(rows: DataFrame, key: str, order: list[str], keep: int = W.LIMITS["context"]) -> DataFrame:
    """The last keep distinct (text, source) of each key, by the place where each first came."""
    first = rows.groupBy(key, "text", "source").agg(F.min(F.struct(*order)).alias("_at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at"), "text", "source"))
    return first.withColumn("place", rank).where(F.col("place") <= keep).select(key, "text", "source", "place", *[F.col(f"_at.{o}").alias(o) for o in order])


def grounding_texts(edges: DataFrame, limit: int = W.LIMITS["grounding"]) -> DataFrame:
    """Node, evidence, place: the evidence of each node's strongest edges."""
    each = edges.select(F.explode(F.array("s", "o")).alias("node"), "edge_id", "utility", "evidence")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("utility"), "edge_id"))
    return each.withColumn("place", rank).where(F.col("place") <= limit)


def grounding_scores(edges: DataFrame, target: str, limit: int = W.LIMITS["grounding"]) -> DataFrame:
    """Node, grounding: the best lexical score against a target over the evidence of a node's strongest edges."""
    said = grounding_texts(edges, limit).where("evidence <> ''")
    return said.groupBy("node").agg(F.max(T.lexical_score(F.col("evidence"), F.lit(target), True)).alias("grounding"))


def specific_context(edges: DataFrame, chosen: DataFrame | None = None, limit: int = 4) -> DataFrame:
    """Node, edge_id, text, source, place: the most specific citable evidence at each node, chosen edges (node, edge_id) left out.

    edges: edge_id, s, o, rel, source, evidence, n_specifics (numbers and dates of the edge) and, if
    there, n_predicate (those of its end). Order: specifics of the end, of the edge, concrete details
    of the text, length, then text. Rows with nothing specific drop out.
    """
    end = F.col("n_predicate") if "n_predicate" in edges.columns else F.lit(0)
    text = F.when(F.col("evidence") != "", F.col("evidence")).otherwise(F.concat_ws(" ", "s", "rel", "o"))
    rows = edges.where(T.citable(F.col("source"))).select(F.explode(F.array("s", "o")).alias("node"), "edge_id", "source", F.concat(F.regexp_replace(T.squeezed(text), r"\.+$", ""), F.lit(".")).alias("text"), F.col("n_specifics").cast("long").alias("n_specifics"), end.cast("long").alias("n_end"))
    rows = rows.withColumn("n_text", T.concrete_count(F.col("text")).cast("long")).where("n_end > 0 or n_specifics > 0 or n_text > 0")
    if chosen is not None:
        rows = rows.join(chosen.select("node", "edge_id").distinct(), ["node", "edge_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n_end"), F.desc("n_specifics"), F.desc("n_text"), F.desc(F.length("text")), F.desc("text"), "edge_id"))
    return rows.withColumn("place", rank).where(F.col("place") <= limit).select("node", "edge_id", "text", "source", "place")


def record_key(text: Column, source: Column) -> Column:
    """What makes two records the same: the word tokens of the text and the shown source."""
    return F.struct(F.array_join(T.tokens(T.squeezed(text)), " ").alias("t"), F.lower(F.regexp_replace(T.display_source(source), "/+$", "")).alias("s"))


def context_without_path(context: DataFrame, path: DataFrame, key: str) -> DataFrame:
    """Context records (key, text, source) whose text and source are not among the key's path records."""
    there = path.select(F.col(key).alias("_key"), record_key(F.col("text"), F.col("source")).alias("_record")).distinct()
    return context.join(there, (F.col(key) == F.col("_key")) & (record_key(F.col("text"), F.col("source")) == F.col("_record")), "left_anti")


def path_order(records: DataFrame, key: str, target_a: str, target_b: str, limit: int = W.LIMITS["path_records"]) -> DataFrame:
    """The path records of each key in order of use: those that name both sides, B, A, with concrete details, many of them, short ones; at most limit.

    A record without text comes last of those that name as much; equal texts go by the other columns.
    """
    a, b = T.target_tokens(F.lit(target_a), 2), T.target_tokens(F.lit(target_b), 2)
    hits = lambda t: F.size(F.array_intersect("_t", t)) > 0
    rows = records.withColumn("_t", T.target_tokens(F.col("text"), 2)).withColumns({"_a": hits(a), "_b": hits(b), "_n": F.when(F.col("text").isNotNull(), T.concrete_count(F.col("text")))})
    others = [c for c in records.columns if c not in (key, "text")]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.col("_a") & F.col("_b")), F.desc("_b"), F.desc("_a"), F.desc(F.col("_n") > 0), F.desc("_n"), F.size("_t"), F.asc_nulls_last("text"), *others))
    return rows.withColumn("place", rank).where(F.col("place") <= limit).select(*records.columns, "place")


def context_order(context: DataFrame, path: DataFrame, key: str, target_a: str, target_b: str, limit: int = 3 * W.LIMITS["path_records"]) -> DataFrame:
    """The context records of each key that name side B, by what they share with its path and the targets; at most limit.

    path: key, text. A key's path is a few records, so their tokens are one array.
    """
    a, b = T.target_tokens(F.lit(target_a), 2), T.target_tokens(F.lit(target_b), 2)
    said = path.select(key, F.explode(T.target_tokens(F.col("text"), 2)).alias("t")).groupBy(key).agg(F.collect_set("t").alias("_path"))
    n = lambda t: F.size(F.array_intersect("_t", t))
    rows = context.join(said, key, "left").withColumn("_t", T.target_tokens(F.col("text"), 2))
    rows = rows.withColumns({"_a": n(a), "_b": n(b), "_p": F.coalesce(n(F.col("_path")), F.lit(0)), "_n": T.concrete_count(F.col("text"))}).where("_b > 0")
    order = [F.desc(F.col("_a") > 0), F.desc(F.col("_p") > 0), F.desc("_p"), F.desc(F.col("_a") + F.col("_b")), F.desc(F.col("_n") > 0), F.desc("_n"), F.size("_t"), "text"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= limit).select(*context.columns, "place")


def successful(payloads: DataFrame, least: float = W.MATCH) -> DataFrame:
    """Payloads that reached their end; if there is none, those that match both targets and name A well enough.

    payloads: endpoint_reached, match_a, match_b, lexical_a.
    """
    fits = F.when(F.coalesce(F.col("endpoint_reached"), F.lit(False)), 0).when((F.col("match_a") >= least) & (F.col("match_b") >= least) & (F.col("lexical_a") >= least), 1)
    tiers = payloads.withColumn("_tier", fits).where("_tier is not null")
    return tiers.where(F.col("_tier") == tiers.agg(F.min("_tier").alias("m")).scalar()).drop("_tier")


def notes(rows: DataFrame, key: str, order: list[str], keep: int = W.LIMITS["notes"]) -> DataFrame:
    """The last keep distinct notes of each key, in the order in which each first came. rows: key, text and the order columns."""
    first = rows.where("text <> ''").groupBy(key, "text").agg(F.min(F.struct(*order)).alias("_at"))
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("text")))
    kept = first.withColumn("_back", back).where(F.col("_back") <= keep)
    return kept.select(key, "text", F.row_number().over(Window.partitionBy(key).orderBy("_at", "text")).alias("place"))


def near_duplicate(a: set, b: set) -> bool:
    """Token sets of four or more that overlap by .72 of the smaller or .60 of the union."""
    both = len(a & b)
    return len(a) >= 4 and len(b) >= 4 and both > 0 and (both / min(len(a), len(b)) >= W.DUP_OVERLAP or both / len(a | b) >= W.DUP_JACCARD)


def greedy_dedupe(records: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """Records (key, ord, text) of each key in order, without near-duplicates of kept ones.

    Keys of at most most records are one report's, each folded in order by a grouped task; larger ones
    are worked off together by rounds over their pairs. Both give the same; of one ord the lesser text comes first.
    """
    rows = records.withColumns({"_t": F.array_distinct(T.target_tokens(F.regexp_replace("text", r"\[\d+\]", ""))), "_key": F.col(key)})
    crowded = store(rows.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col("_key").alias("_big")), "crowded-keys").df

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kept, sets = [], []
        frame = frame.sort_values(["ord", "text"], kind="stable")
        for i, tokens in enumerate(frame["_t"]):
            t = set(tokens)
            if not any(near_duplicate(t, s) for s in sets):
                kept.append(i)
                sets += [t] if t else []
        return frame.iloc[kept].drop(columns=["_t", "_key"])

    if crowded.isEmpty():
        return rows.groupBy(key).applyInPandas(run, records.schema)
    big = F.broadcast(crowded) if crowded.count() <= 100_000 else crowded
    on = F.col("_key").eqNullSafe(F.col("_big"))
    few = rows.join(big, on, "left_anti").groupBy(key).applyInPandas(run, records.schema)
    many = store(rows.join(big, on, "left_semi").withColumn("_at", F.monotonically_increasing_id()), "crowded-records").df
    stay = without_near_duplicates(many.select(F.col("_key").alias("key"), F.struct("ord", "text", "_at").alias("id"), F.col("_t").alias("tokens")))
    return few.unionByName(many.join(stay.select(F.col("id._at").alias("_at")), "_at", "left_semi").select(*records.columns))


def diverse_top(arguments: DataFrame, key: str, limit: int = W.LIMITS["arguments"], most: float = W.DIVERSITY) -> DataFrame:
    """The best arguments of each key by rank whose mechanisms differ; a second pass fills up without that rule.

    arguments: key, rank (1 is best), signature, mechanism (array of tokens). Sequential by nature;
    a key holds one case's arguments.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, taken, seen, sets = frame.sort_values("rank"), [], set(), []
        for strict in (True, False):
            for i, (sign, mech) in enumerate(zip(frame["signature"], frame["mechanism"], strict=True)):
                m = set(mech)
                if len(taken) >= limit or sign in seen:
                    continue
                if strict and m and any(s and len(m & s) / len(m | s) >= most for s in sets):
                    continue
                seen.add(sign)
                taken.append(i)
                sets.append(m)
        return frame.iloc[taken].assign(pick=range(1, len(taken) + 1))

    return arguments.groupBy(key).applyInPandas(run, arguments.withColumn("pick", F.lit(0)).schema)


def mechanism(path_text: Column, target_a: str, target_b: str) -> Column:
    """The tokens of an argument that name neither target nor a number."""
    named = T.target_tokens(F.lit(f"{target_a} {target_b}"), 2)
    return F.filter(F.array_except(T.target_tokens(path_text, 2), named), lambda t: ~t.rlike("^[0-9]+$"))


def numbered(rows: DataFrame, order: list, name: str, parts: int = 64) -> DataFrame:
    """rows with their place (from 1) in a total order, without one task for all: ranges are sorted, and each adds the rows before it."""
    made = store(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges").df
    counts = made.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each of the parts
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return made.join(F.broadcast(before), "_part").withColumn(name, place.cast("int")).drop("_part", "_before")


def source_numbers(records: DataFrame, order: list[str]) -> DataFrame:
    """Source, number: citable sources by where they first come. records: source and the order columns."""
    first = records.where(T.citable(F.col("source"))).groupBy(T.display_source(F.col("source")).alias("source")).agg(F.min(F.struct(*order)).alias("_at"))
    return numbered(first, [F.col("_at"), F.col("source")], "number").select("source", "number")


def citations(sentences: DataFrame, records: DataFrame, limit: int = 2) -> DataFrame:
    """sent_id, rec_id, shared, score, place: the records that best support each sentence.

    Both sides: id, text. A record needs two shared tokens and max(precision, .85 recall) of .22.
    """
    terms = lambda df: df.select("id", T.target_tokens(F.col("text")).alias("terms"))
    found = best_overlaps(terms(sentences), terms(records), limit, support_of, 2, 0.22)
    return found.select(F.col("left_id").alias("sent_id"), F.col("right_id").alias("rec_id"), "shared", "score", "place")


def support_of(shared, n_said, n_known):
    """How well a record supports a sentence: the greater of precision and .85 recall, for Columns and arrays."""
    precision, recall = shared / n_said, 0.85 * shared / n_known
    return F.greatest(precision, recall) if isinstance(shared, Column) else np.maximum(precision, recall)


def chain_text(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, text: each record's sentence with its [number], in order. records: text, number (null: none)."""
    bare = F.regexp_replace(T.squeezed(F.col("text")), r"\.+$", "")
    said = F.when(bare == "", "").when(F.col("number").isNull(), F.concat(bare, F.lit("."))).otherwise(F.concat(bare, F.lit(" ["), F.col("number").cast("string"), F.lit("].")))
    rows = records.withColumn("_said", said).where("_said <> ''")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_said"))), lambda x: x["_said"]), " ").alias("text"))


def cited(text: str, refs: dict[int, list[int]]) -> str:
    """a report's sentences with the references of the records that support them, where they have none.

    refs: sentence number (in order of sentences_of) to source numbers. Headings stay as they are.
    """
    n, out = 0, []
    for paragraph in text.split("\n\n"):
        said = []
        for sentence in sentences_of(paragraph):
            marks = " ".join(f"[{r}]" for r in refs.get(n, []))
            n += 1
            if marks and not re.search(r"\[\d+\](?:\s*\[\d+\])*\s*[.!?]?$", sentence):
                sentence = f"{sentence[:-1].rstrip()} {marks}{sentence[-1]}" if sentence[-1] in ".!?" else f"{sentence} {marks}."
            said.append(sentence)
        out.append(" ".join(said) if said else paragraph.strip())
    return "\n\n".join(out)


def sentences_of(paragraph: str) -> list[str]:
    """The sentences of a paragraph; a heading has none."""
    return [] if paragraph.lstrip().startswith("#") else [s.strip() for s in re.split(r"(?<=[.!?])\s+", paragraph.strip()) if s.strip()]


def polished(report: str, sources: list[tuple[int, str]]) -> str:
    """a report text without template headings, labels and pipeline words, its sources listed anew.

    Numbers are made compact in order of first use. Works on one text of bounded size.
    """
    lines = []
    for line in report.split("\n"):
        bare = line.strip().strip("#*: ").lower()
        if re.match(r"^\s*\[\d+\]\s*:", line) or bare == "sources" or bare in W.TEMPLATE_HEADINGS:
            continue
        lines.append(re.sub(r"^#+\s*", "## ", re.sub(r"^\s*(?:argument|claim)\s+\d+\s*[:.]\s*", "", line, flags=re.I)))
    text = "\n".join(lines).strip()
    for said, better in sorted(W.PIPELINE_WORDS, key=lambda p: -len(p[0])):
        text = re.sub(rf"\b{said}\b", better, text, flags=re.I)
    used = list(dict.fromkeys(int(n) for n in re.findall(r"\[(\d+)\]", text)))
    named = dict(sources)
    numbers = {old: new for new, old in enumerate([u for u in used if u in named], 1)}
    text = re.sub(r"\s?\[(\d+)\]", lambda m: f" [{numbers[int(m[1])]}]" if int(m[1]) in numbers else "", text)
    listed = "\n".join(f"[{new}]: {named[old]}" for old, new in numbers.items())
    return f"{text}\n\n## Sources\n{listed}" if listed else text


def template_report(target_a: str, target_b: str, arguments: list[tuple[str, str]], sources: list[tuple[int, str]], writer: Callable[[str], str] | None = None) -> str:
    """The report of at most a few arguments (label, text). writer may turn the draft into prose; its citations are kept in order."""
    if not arguments:
        return f"## {target_a} and {target_b}\n\nNo supported connection was found."
    draft = f"## {target_a} and {target_b}\n\n" + "\n\n".join(f"{text} ({label} support.)" for label, text in arguments)
    return polished(writer(draft) if writer else draft, sources)
