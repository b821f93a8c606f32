"""Blocks to claims: sentences, clauses, linking and action candidates, endpoint states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.functions import words as W
from claimweave.session import store
from claimweave.sources.blocks import cached, distinct_blocks, ordered_distinct


def clause_rows(blocks: DataFrame, limited: bool = False, only: Callable[[Column], Column] | None = None, cleaned: bool = False) -> DataFrame:
    """block_id, ord, source, sent_pos, clause_pos, clause: usable clauses of each block; only: a cheap test of clauses, made first,
    that holds for a text if it does for a part of it between words (sentences are at most as long as clauses, so no part is cut).

    cleaned: what the blocks hold is cleaned text already.

    limited (W5): of the first 96 sentences and 180 clauses, which suits blocks of a page. The cut is
    a slice of the block's own array, without a window.
    """
    dealt = blocks.select("block_id", "ord", "source", "content")
    sentence_limit, clause_limit = ("sentences", "clauses") if limited else (None, None)
    of_sentence = lambda s, i: F.transform(T.clauses(s, clause_limit), lambda c, j: F.struct(i.alias("sent_pos"), j.alias("clause_pos"), c.alias("clause")))
    none = F.array().cast("array<struct<sent_pos:int,clause_pos:int,clause:string>>")
    worth = lambda s, i: F.when(only(s) | s.rlike(T.UNCLEAN), of_sentence(s, i)).otherwise(none)  # noqa: E731  # what is cleaned again may hold more
    every = F.flatten(F.transform(T.sentences(F.col("content"), sentence_limit, cleaned), worth if only and not limited else of_sentence))  # a limit counts all clauses
    rows = dealt.select("block_id", "ord", "source", F.explode(T.first_of(every, clause_limit)).alias("c")).select("block_id", "ord", "source", "c.*")
    usable = T.usable_clause(F.col("clause"))
    return rows.where(F.when(only(F.col("clause")), usable).otherwise(False) if only else usable)


#: What every linking clause holds; the whole pattern tries all its beginnings.
HAS_LINK = rf"(?i)\s(?:{W.phrases(W.LINKING_PHRASES)})\s"


def linking(clause: Column) -> Column:
    """struct<subject, relation, predicate> of 'S is P', empty strings where it does not match."""
    marked = F.when(clause.rlike(HAS_LINK), F.regexp_replace(clause, T.LINKING, "$1\u0001$2\u0001$3")).otherwise("")
    part = lambda p, k: F.when(F.size(p) == 3, F.get(p, F.lit(k))).otherwise("")
    return T.let(F.split(marked, "\u0001"), lambda p: F.struct(part(p, 0).alias("subject"), F.lower(part(p, 1)).alias("relation"), part(p, 2).alias("predicate")))


#: How every action word ends; the whole test is dearer.
ENDS = rf"(?i)(?:{'|'.join([*W.STRONG_SUFFIXES, *W.DERIVED_SUFFIXES, 's'])})$"


def action(clause: Column) -> Column:
    """array of struct<subject, relation, predicate>, one per action word, those after the last break first."""
    none = F.array().cast("array<struct<subject:string,relation:string,predicate:string>>")
    last = lambda c: F.when(F.locate(c, clause) > 0, F.length(clause) - F.locate(c, F.reverse(clause))).otherwise(-1)

    def acts_of(found: Column) -> Column:
        inner = lambda x: (x["i"] >= 1) & (x["i"] < F.size(found) - 1)
        every = F.transform(found, lambda t, i: F.struct(t.alias("token"), i.alias("i")))
        return F.filter(every, lambda x: inner(x) & x["token"].rlike(ENDS) & T.action_word(x["token"]))

    def placed(acts: Column) -> Column:
        """Where they start: what precedes the first token, then each token with what follows it."""
        pieces = F.split(F.regexp_replace(clause, W.TOKEN, "\u0001$0\u0002"), "\u0001")
        cut = F.greatest(last(","), last(";"))

        def started(m: Column) -> Column:
            start = lambda x: F.aggregate(F.slice(m, 1, x["i"] + 1), F.lit(0), lambda n, p: n + F.length(p)) - x["i"]
            made = F.transform(acts, lambda x: F.struct(start(x).alias("start"), x["token"].alias("token"), x["i"].alias("i")))
            return F.array_sort(F.transform(made, lambda x: F.struct((x["start"] <= cut).alias("late"), x["start"].alias("start"), x["token"].alias("token"), x["i"].alias("i"))))

        return F.transform(
            T.let(pieces, started),
            lambda x: F.struct(
                F.substr(clause, F.lit(1), x["start"]).alias("subject"),
                F.lower(x["token"]).alias("relation"),
                F.substr(clause, x["start"] + F.length(x["token"]) + 1).alias("predicate"),
            ),
        )

    acts = T.let(F.regexp_extract_all(clause, F.lit(W.TOKEN), F.lit(0)), acts_of)
    return T.let(acts, lambda a: F.when(F.size(a) == 0, none).otherwise(placed(a)))


def candidate(raw: Column) -> Column:
    """A validated claim from struct<subject, relation, predicate> of cleaned text, or null."""

    def built(relation: Column) -> Column:
        named = F.concat_ws(" ", relation, F.lit("amount"))

        def with_subject(subject: Column) -> Column:
            core = T.endpoint_core(raw["predicate"], cleaned=True)
            predicate = T.let(core, lambda c: F.when(T.amount_tail(raw["predicate"], relation, True) | c.rlike(rf"(?i)^{W.NUMBER}"), named).otherwise(c))
            made = lambda p: F.struct(subject.alias("subject"), relation.alias("relation"), p.alias("predicate"), T.clean_part(raw["subject"], True).alias("subject_raw"), T.clean_part(raw["predicate"], True).alias("predicate_raw"))
            good = lambda p: (F.lower(subject) != F.lower(p)) & T.usable_label(p, True)
            return F.when(T.usable_label(subject, True), T.let(predicate, lambda p: F.when(good(p), made(p))))

        return F.when(T.usable_relation(relation, True), T.let(T.endpoint_core(raw["subject"], cleaned=True), with_subject))  # the cheap tests first

    return T.let(F.lower(T.clean_part(raw["relation"], True)), built)


def claims(blocks: DataFrame, parser: Column | None = None, limited: bool = False, apart: bool = False) -> DataFrame:
    """The claims of blocks, one per subject, relation, predicate, source and text.

    limited: the limits of a page's block (W5) and of a job's claims (S12: the first 512 of a block).
    apart: each block by itself, whatever other blocks say.

    A clause is read by the linking pattern; only where that does not match, by its action words
    in turn (the first valid one). parser: an optional column of struct<subject, relation,
    predicate> from a dependency parser, tried first where it is not null.
    """
    rows = (clause_rows(blocks, limited) if apart else clause_rows(distinct_blocks(blocks, True), limited, cleaned=True)).where(F.size(T.tokens(F.col("clause"))) >= 3)
    rows = rows.withColumn("_link", linking(F.col("clause"))).withColumn("_acts", F.when(F.col("_link.relation") == "", action(F.col("clause"))))
    tried = F.when(F.col("_link.relation") != "", F.array(F.col("_link"))).otherwise(F.col("_acts"))
    if parser is not None:
        tried = F.when(parser.isNotNull(), F.concat(F.array(parser), tried)).otherwise(tried)
    none = F.lit(None).cast("struct<subject:string,relation:string,predicate:string,subject_raw:string,predicate_raw:string>")
    first = F.aggregate(tried, none, lambda found, raw: F.when(found.isNotNull(), found).otherwise(candidate(raw)))  # stops at the first valid one
    flat = rows.select("block_id", "ord", "source", "sent_pos", "clause_pos", "clause", F.explode(F.filter(F.array(first), lambda c: c.isNotNull())).alias("c")).select("*", "c.*").drop("c")
    one = distinct_claims(flat, "clause", ["block_id"] if apart else [])
    evidence = T.clean_clause(F.col("clause"), cleaned=True)
    if limited:
        rank = F.row_number().over(Window.partitionBy("block_id", "source").orderBy("ord", "sent_pos", "clause_pos"))
        one = one.withColumn("_n", rank).where(F.col("_n") <= W.LIMITS["claims"]).drop("_n")
    return one.select(
        "block_id", "ord", "sent_pos", "clause_pos", "subject", "relation", "predicate",
        T.quantifier(F.col("subject_raw"), True).alias("s_quant"), T.quantifier(F.col("predicate_raw"), True).alias("p_quant"),
        T.tense(F.col("relation"), F.col("clause")).alias("tense"), T.truth(F.col("clause"), F.col("relation"), True).alias("truth"),
        T.specifics(F.col("subject_raw"), F.col("source")).alias("s_specifics"), T.specifics(F.col("predicate_raw"), F.col("source")).alias("p_specifics"),
        T.specifics(F.col("clause"), F.col("source")).alias("c_specifics"), "source", evidence.alias("evidence"),
    )


def distinct_claims(rows: DataFrame, text: str, more: list[str] | None = None) -> DataFrame:
    """One claim for each subject, relation, predicate, source and text, the first."""
    key = F.struct(F.lower("subject").alias("a"), F.col("relation").alias("b"), F.lower("predicate").alias("c"), F.col("source").alias("d"), F.col(text).alias("e"), *(more or []))
    return ordered_distinct(rows, key, [F.col("ord"), F.col("sent_pos"), F.col("clause_pos")])


#: Raise it with any change that makes other claims of the same text; what was cached before isn't read then.
VERSION = "1"


def cached_claims(spark: SparkSession, blocks: DataFrame, name: str, version: str = VERSION) -> DataFrame:
    """claims(blocks), of which those of blocks (source and content) that the named cache knows in this version are read.

    A row of the cache is a block with the list of its claims, empty ones too; only blocks that are
    not there are extracted, each by itself, and added.
    """
    key = F.to_json(F.struct(F.lit(version).alias("version"), "source", "content"))

    def made(missing: DataFrame) -> DataFrame:
        one = store(missing.dropDuplicates(["cache_key"]), "uncached").df
        found = claims(one, apart=True)
        kept = [c for c in found.columns if c not in ("block_id", "ord", "source")]
        listed = found.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("sent_pos", "clause_pos", *[c for c in kept if c not in ("sent_pos", "clause_pos")]))).alias("claims"))
        none = F.array().cast(listed.schema["claims"].dataType)
        return one.select("cache_key", "block_id").join(listed, "block_id", "left").select("cache_key", F.coalesce("claims", none).alias("claims"))

    asked = distinct_blocks(blocks)
    held = cached(spark, asked, key, made, f"{name}-claims")
    rows = asked.withColumn("cache_key", F.sha2(key, 256)).join(held, "cache_key").select("block_id", "ord", "source", F.explode("claims").alias("c")).select("block_id", "ord", "c.*", "source")
    order = ["block_id", "ord", "sent_pos", "clause_pos", "subject", "relation", "predicate", "s_quant", "p_quant", "tense", "truth", "s_specifics", "p_specifics", "c_specifics", "source", "evidence"]
    return distinct_claims(rows, "evidence").select(*order)


def expanded(claim_rows: DataFrame) -> DataFrame:
    """coordinated subjects and predicates multiplied out, at most eight claims from one."""
    parts = F.flatten(F.transform(T.coordinated(F.col("subject")), lambda s: F.transform(T.coordinated(F.col("predicate")), lambda p: F.struct(s.alias("s"), p.alias("p")))))
    kept = F.slice(F.filter(parts, lambda x: F.lower(x["s"]) != F.lower(x["p"])), 1, W.LIMITS["expansions"])
    return claim_rows.withColumn("_x", F.explode(kept)).withColumn("subject", F.col("_x.s")).withColumn("predicate", F.col("_x.p")).drop("_x")
