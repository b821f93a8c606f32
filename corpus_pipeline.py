"""The corpus pipeline: quality rules, toxicity, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. Columns of
docs that clash with those a stage works with are set aside and come back as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import mixing, packing, quality, simhash, toxicity
from claimweave.session import STORED, release, store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the perplexity bands keep.

    Null, empty and short texts go; null lang is one language; repeated rows stay or go together;
    an empty table gives none.
    """
    return quality.keep_good(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the machine learns from labelled rows among docs.

    Null and empty texts get the machine's bias; null ids are never learnt from; repeated rows stay
    or go together; with labels of one class only the machine is that constant; an empty table gives none.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: one of the least doc_id, null ids last.

    Null and wordless texts are one component; rows that share an id or have none stay where their
    texts differ; of equal rows one stays; an empty table gives none.
    """
    return simhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it: repeats are rows of their own.

    Null source is a source, last; null and wordless texts have size 0 and are taken by their coin;
    equal rows are taken alike; an empty table gives none.
    """
    return mixing.emit_mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and place that each was packed into.

    A null text is an empty one, which is its end id; repeated rows give their pieces each; texts of
    any length are cut into pieces; an empty table gives none.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash near-dedup", near_duplicates),
    ("source mix", source_mix),
    ("best-fit packing", packed_sequences),
]

#: The perplexity model, the factorization machine and the token ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is stored and read again by the next, and what it wrote on the way is removed."""
    docs, began = table(spark, sf_dir, "documents"), len(STORED)
    for name, stage in STAGES[:-1]:
        made = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, began, (made.path,))
        docs = made.df
    return STAGES[-1][1](spark, docs, sf_dir)
