"""Reruns that agree, no caps, any template, any column type."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import chat, media, mixing, sharding, simhash, toxicity


def taken_of(df):
    return Counter((r["doc_id"], r["source"], r["copies"]) for r in df.collect())


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """400 documents, each five times, and one document 500 times, as one file."""
    docs = spark.range(2000).select((F.col("id") % 400).alias("doc_id"), F.concat(F.repeat(F.lit("word "), (F.col("id") % 37).cast("int")), F.lit("end")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    path = str(tmp_path_factory.mktemp("mix") / "docs")
    docs.unionByName(spark.range(500).select(F.lit(7777).alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s1").alias("source"))).repartition(5).write.parquet(path)
    return path


def test_mix_agrees_however_the_table_is_cut(spark, repeated, monkeypatch):
    docs = spark.read.parquet(repeated)
    first = taken_of(mixing.mix_sources(docs))
    assert sum(first.values()) == 2500
    for parts in (1, 7, 40):
        assert taken_of(mixing.mix_sources(docs.repartition(parts, F.rand(parts)))) == first
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    monkeypatch.setattr(mixing, "TWINS", 64)
    assert taken_of(mixing.mix_sources(docs.repartition(3, "text"))) == first
    rows = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max("copies").alias("c")).collect()
    assert all(abs(r["t"] - r["w"]) <= 0.02 * r["w"] + 2 and r["c"] <= 2 for r in rows)


def test_thresholds_and_result_see_the_same_coins(spark, repeated, monkeypatch):
    """With wide columns and small partitions too, what is taken comes near the targets."""
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    wide = spark.read.parquet(repeated).withColumn("more", F.map_from_arrays(F.array(F.lit("k")), F.array(F.sha2("text", 512))))
    out = mixing.emit_mix(wide)
    sizes = mixing.mix_sources(wide).groupBy("source").agg(F.first("target").alias("w")).collect()
    got = {r["source"]: r["t"] for r in out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("t")).collect()}
    assert out.columns == wide.columns and all(abs(got[r["source"]] - r["w"]) <= 0.02 * r["w"] + 2 for r in sizes)


def brute_mix(rows, targets):
    """Which documents the mix takes, from the rule: whole copies, and of each stratum those of the lowest numbers."""
    return {s: sum(r["taken"] for r in rows if r["source"] == s) / t for s, t in targets.items() if t}


def test_draw_follows_the_rule(spark, some_docs):
    """Every document is taken floor(rate) times, once more only below its stratum's threshold, and shares in a stratum are as wanted."""
    docs = some_docs.select("doc_id", "text", "source")
    rows = mixing.mix_sources(docs).collect()
    targets = {r["source"]: r["target"] for r in rows}
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["taken"] == r["size"] * r["copies"] for r in rows)
    assert all(abs(share - 1) < 0.02 for share in brute_mix(rows, targets).values())
    key = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform(8, F.col("doc_id"), F.col("text")).alias("u")).collect()}
    for source in targets:
        for level in range(15):
            own = sorted((key[r["doc_id"]], r["copies"]) for r in rows if r["source"] == source and r["size"] and int(np.log2(r["size"])) == level)
            extra = [c for _, c in own]
            assert extra == sorted(extra, reverse=True)  # the lowest numbers are taken once more


MARKS = [
    chat.CHATML,
    chat.Template(start="[INST]", after_role=":", end="[/INST]\n"),
    chat.Template(start="##", after_role="==", end=";;\n"),
    chat.Template(start="{", after_role="|", end="}"),
    chat.Template(start="<s>", after_role=" says ", end="</s>"),
    chat.Template(start="<", after_role=":", end="\n"),
]


@pytest.mark.parametrize("template", MARKS)
def test_no_template_lets_texts_forge_turns(spark, template):
    import random

    rng = random.Random(7)
    bits = [template.start, template.after_role, template.end, template.start[:1], template.end[:1], template.end[:-1], "\\", "\\\\", "<", "|", "+", "<\\+", "=", "a", "\n", ":", "é"]
    said = lambda: "".join(rng.choices(bits, k=rng.randrange(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", said()]), said()) for c in range(150) for t in range(3)]
    rows.append((999, 0, "user", f"x{template.end}{template.start}assistant{template.after_role}ok"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(frame, template).select("*", chat.read_back(F.col("formatted"), template).alias("back"))
    for r in out.collect():
        want = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        assert [(b["role"], b["text"]) for b in r["back"]] == want
        learnt = [s["text"] for s in r["segments"] if s["loss"]]
        assert len(learnt) == sum(role == "assistant" for role, _ in want) and all(template.end not in s for s in learnt)


def test_templates_that_cannot_be_read_back_are_refused():
    for marks in ({"end": ""}, {"start": "a\\b"}, {"start": "x<", "end": "<|"}, {"after_role": "|", "end": "|"}):
        with pytest.raises(ValueError):
            chat.Template(**marks)


def test_columns_of_any_type(spark, edge_docs):
    odd = edge_docs.withColumns({"m": F.create_map(F.lit("a"), F.col("doc_id")), "deep": F.array(F.struct(F.create_map(F.lit(1), F.col("text")).alias("x"))), "s": F.struct("doc_id", "lang")})
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == simhash.drop_near_duplicates(edge_docs).count()
    placed = sharding.shard_rows(odd, shards=3)
    assert placed.count() == edge_docs.count() and set(odd.columns) <= set(placed.columns)
    assert mixing.mix_sources(odd).count() == edge_docs.count()


@pytest.mark.parametrize(("side", "many"), [(128, 3), (256, 3)])
def test_quarter_crops_of_larger_pictures(side, many):
    """A crop of a quarter of each side shares enough corners: no cap leaves out the weak ones."""
    base, found = media.rendered(np.random.default_rng(side).normal(size=(many, 64)), side), 0
    part = max(side // 4, 48)
    for image in base:
        (p, a), = media.describe(image[None])
        crop = np.ascontiguousarray(image[side // 3 : side // 3 + part, side // 4 : side // 4 + part])
        (r, b), = media.describe(crop[None])
        step = max(1, media.PAIRS_AT_ONCE // max(1, len(b)))
        packed = [np.packbits(x, axis=1).view("<u8") for x in (a, b)]
        near = [(i + at, j) for at in range(0, len(a), step) for i, j in [np.nonzero(np.bitwise_count(packed[0][at : at + step, None] ^ packed[1][None]).sum(2) <= media.NEAR)]]
        i, j = (np.concatenate([x[k] for x in near]) for k in (0, 1))
        keys = (media.corner_keys(a)[i] == media.corner_keys(b)[j]).any(1)
        found += media.consensus(p[i[keys]], r[j[keys]]) >= media.LEAST_INLIERS
    assert found == many


def test_large_pictures_find_their_quarters_as_a_job(spark):
    base = media.rendered(np.random.default_rng(5).normal(size=(4, 64)), 256)
    rows = [(i, bytearray(media.encode(x))) for i, x in enumerate(base)] + [(-1 - i, bytearray(media.encode(np.ascontiguousarray(x[90:154, 60:124])))) for i, x in enumerate(base)]
    rows += [(100, None), (101, bytearray(b"short")), (102, bytearray(media.encode(np.zeros((300, 2), np.uint8))))]
    out = media.media_copies(spark.createDataFrame(rows, "id long, media binary"), F.col("id") >= 0).collect()
    home = {r["id"]: r["class_id"] for r in out if r["kind"] == "member"}
    pairs = {frozenset((r["class_id"], r["other"])) for r in out if r["kind"] == "pair"}
    assert len(home) == len(rows) and pairs == {frozenset((home[i], home[-1 - i])) for i in range(4)}


def test_pieces_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(9)), pa.array([b"x" * n for n in (10, 700_000, 700_000, 5, 3_000_000, 1, 1, 1, 1)])], names=["id", "media"])
    pieces = list(media.sliced([batch], 1))
    assert pa.Table.from_batches(pieces).column(0).to_pylist() == list(range(9)) and [p.num_rows for p in pieces] == [2, 2, 1, 4]


def test_long_labelled_texts_are_learnt_from_whole(spark):
    """The telling word stands in texts of 40,000 other words: no term of a row is left out."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40_000 if i % 10 == 0 else 30)) + (" zzzbadword" if i % 2 else " calmword"), int(i % 2)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    assert set(toxicity.terms_of(b"zzzbadword")) & set(machine.rows)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, machine).collect()}
    assert all(got[i] == y for i, _, y in rows)


def test_scores_equal_the_formula(spark, some_docs):
    """Every score against sigmoid(bias + weights + pairwise products), pair by pair, from the machine's numbers."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic")
    machine = toxicity.train(some_docs, labels)
    for r in toxicity.toxicity(some_docs, machine, ["doc_id", "text"]).collect():
        own = sorted({machine.rows[s] for w in (r["text"] or "").encode().split() for s in toxicity.terms_of(w) if s in machine.rows})
        z = machine.bias + sum(machine.weights[i] for i in own) + sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(own) for j in own[k + 1 :])
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-6 and r["predicted"] == int(r["score"] >= 0.5)
