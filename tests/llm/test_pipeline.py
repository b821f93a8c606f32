"""The pipeline: each stage takes effect, and the whole agrees with its stages run by hand."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert kept.where(F.size(F.split(F.trim("text"), r"\s+")) < 20).count() == 0
    clean = p.toxic_documents(spark, kept, SF)
    assert clean.columns == docs.columns and clean.count() <= kept.count()
    single = p.near_duplicates(spark, clean, SF)
    assert single.columns == docs.columns and single.select("text").distinct().count() == single.count() < clean.count()
    mixed = p.source_mix(spark, single, SF)
    assert mixed.columns == docs.columns
    n = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert set(n) <= {r["doc_id"] for r in single.select("doc_id").collect()} and max(n.values()) <= 2


def test_run_packs_what_the_stages_leave(spark):
    import corpus_pipeline as p
    from claimweave.llm import packing
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
    tok, wanted = Tokenizer.from_file(packing.tokenizer_file()), Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            import numpy as np

            wanted[r["doc_id"], k // 4096, zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    rows = p.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == wanted
    used = defaultdict(int)
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096
    spark.catalog.clearCache()


def test_stages_handle_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline as p

    for name, stage in p.STAGES[:-1]:
        out = stage(spark, odd_docs, SF)
        assert out.columns == odd_docs.columns, name
        out.collect()
        assert stage(spark, no_docs, SF).count() == 0
    assert p.STAGES[-1][1](spark, no_docs, SF).count() == 0
