"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(bias + sum of weights of the terms in the text + sum over pairs of the dot
products of their factors), so that pairs such as an insult with a group mention count beyond
what each adds. Terms are a text's distinct words and word beginnings, hashed. The machine is
fitted on a bounded sample of labelled rows; every whole text is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import as_bytes, map_rows, map_text, set_aside
from claimweave.session import discard, prepare, store, without

#: Hash slots, pair factors, documents that a kept term occurs in.
SLOTS, RANK, LEAST_DOCS = 1 << 22, 4, 4
#: The machine's size: terms kept for what they say alone, and for what they say beside one of the ANCHORS strongest.
KEPT_TERMS, KEPT_PARTNERS, ANCHORS = 1500, 100, 64
#: The bound of the training sample: so many labelled rows of each class, by hash of doc_id.
SAMPLE_PER_CLASS = 5000
FOLDS = 5
EDGES = bytes(set(range(33, 127)) - set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
BEGINNINGS = (4, 5)
CACHED, CACHED_LENGTH = 300_000, 64
ADDED = [("score", "double"), ("predicted", "int")]


def terms_of(word: bytes) -> list[int]:
    """Hash slots of a word (edge punctuation off, lower case) and of its beginnings."""
    plain = word.strip(EDGES).decode("utf-8", "replace").lower()
    if not plain:
        return []
    named = ["w" + plain] + ["b" + plain[:k] for k in BEGINNINGS if len(plain) > k]
    return [zlib.crc32(t.encode()) % SLOTS for t in named]


@dataclass
class Machine:
    """slot -> row; weights; factors; bias."""

    rows: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, held: list[list[int]]) -> np.ndarray:
        """Scores of texts given the rows of their distinct kept terms."""
        sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
        if not sizes.sum():
            return np.full(len(held), sigmoid(np.array(self.bias)))
        flat = np.fromiter((r for h in held for r in h), dtype=np.int64, count=sizes.sum())
        text = np.repeat(np.arange(len(held)), sizes)
        add = lambda values: np.bincount(text, weights=values, minlength=len(held))
        pairs = sum(add(v) ** 2 - add(v * v) for v in self.factors[flat].T) / 2
        return sigmoid(self.bias + add(self.weights[flat]) + pairs)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def counted(values: np.ndarray, size: int) -> np.ndarray:
    """How often each number occurs, worked out in pieces: no wide copy of a long column."""
    out = np.zeros(size, np.int64)
    for at in range(0, len(values), 500_000):
        out += np.bincount(values[at : at + 500_000], minlength=size)
    return out


def partner_gain(which: np.ndarray, text: np.ndarray, toxic: np.ndarray, anchors: np.ndarray, n_terms: int) -> np.ndarray:
    """How much each term tells texts with an anchor apart, at best: terms that say nothing alone may do so in pairs."""
    best = np.zeros(n_terms)
    bounds = np.searchsorted(text, np.arange(len(toxic) + 1))
    for anchor in anchors.tolist():
        mine = text[which == anchor]
        n_on = int(toxic[mine].sum())
        on, off = np.zeros(n_terms), np.zeros(n_terms)
        for t in mine.tolist():
            (on if toxic[t] else off)[which[bounds[t] : bounds[t + 1]]] += 1
        odds = np.log((on + 0.5) / (n_on + 1)) - np.log((off + 0.5) / (len(mine) - n_on + 1))
        gain = np.where(on + off >= LEAST_DOCS, np.abs(odds) * np.sqrt(on + off), 0)
        gain[anchor] = 0
        best = np.maximum(best, gain)
    return best


def chosen_terms(which: np.ndarray, text: np.ndarray, toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """The terms that the machine keeps: by log odds times the root of their count, alone and beside the strongest toxic ones."""
    n_toxic = int(toxic.sum())
    on = counted(which[(toxic == 1)[text]], n_terms)
    off = counted(which, n_terms) - on
    odds = np.log((on + 0.5) / (n_toxic + 1)) - np.log((off + 0.5) / (len(toxic) - n_toxic + 1))
    gain = np.where(on + off >= LEAST_DOCS, np.abs(odds) * np.sqrt(on + off), 0)
    best = np.argsort(-gain, kind="stable")[:KEPT_TERMS]
    best = best[gain[best] > 0]
    anchors = best[odds[best] > 0][:ANCHORS]
    pair = partner_gain(which, text, toxic, anchors, n_terms)
    pair[best] = 0
    more = np.argsort(-pair, kind="stable")[:KEPT_PARTNERS]
    return np.concatenate([best, more[pair[more] > 0]])


def fit(held: list[np.ndarray], toxic: np.ndarray, prior: float, steps: int = 60, seed: int = 2) -> Machine:
    """Full-batch Adam on the logistic loss, classes weighted alike, L2 on weights and factors.

    prior: the share of toxic rows among all labelled ones: with one class only, or no rows, the
    machine is that constant. Otherwise a score of one half means as likely under either class.
    """
    n_toxic = int(toxic.sum())
    bias_of = float(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4)))
    if not n_toxic or n_toxic == len(toxic):
        return Machine({}, np.zeros(0), np.zeros((0, RANK)), bias_of)
    often = np.zeros(SLOTS, np.int64)
    for h in held:
        often[h] += 1
    names = np.flatnonzero(often >= LEAST_DOCS)  # no other term can be kept
    place = np.full(SLOTS, -1, np.int32)
    place[names] = np.arange(len(names))
    kept = [p[p >= 0] for p in (place[h] for h in held)]
    which = np.concatenate(kept)
    text = np.repeat(np.arange(len(held), dtype=np.int32), [len(k) for k in kept])
    del kept, often, place
    best = chosen_terms(which, text, toxic, len(names))
    row = np.full(len(names), -1)
    row[best] = np.arange(len(best))
    x = np.zeros((len(held), len(best)), dtype=np.float32)
    use = row[which] >= 0
    x[text[use], row[which][use]] = 1
    y, share = toxic.astype(np.float32), np.where(toxic == 1, 0.5 / n_toxic, 0.5 / (len(toxic) - n_toxic)).astype(np.float32)
    rng = np.random.default_rng(seed)
    weights, factors, bias = np.zeros(len(best), np.float32), rng.normal(0, 0.01, (len(best), RANK)).astype(np.float32), np.zeros(1, np.float32)
    params, first, second = [weights, factors, bias], None, None
    for step in range(1, steps + 1):
        xv = x @ factors
        logit = bias + x @ weights + ((xv**2).sum(1) - (x @ (factors**2).sum(1))) / 2
        slope = (sigmoid(logit) - y) * share
        by_x = slope @ x
        grads = [by_x + 2e-4 * weights, x.T @ (slope[:, None] * xv) - factors * by_x[:, None] + 1e-3 * factors, np.array([slope.sum()], np.float32)]
        first = [0.1 * g if first is None else 0.9 * m + 0.1 * g for m, g in zip(first or grads, grads, strict=True)]
        second = [0.01 * g * g if second is None else 0.99 * m + 0.01 * g * g for m, g in zip(second or grads, grads, strict=True)]
        for p, m, v in zip(params, first, second, strict=True):
            p -= (0.1 if p is not factors else 0.02) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Machine({int(names[b]): i for i, b in enumerate(best)}, weights.astype(float), factors.astype(float), float(bias[0]))


def held_out(doc_id) -> object:
    """True where crc32 of doc_id as text leaves 0 modulo FOLDS; such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Fit on at most per_class rows of each class, not held out; labels join by doc_id only.

    Of rows that repeat a labelled doc_id one text is read, whole. Only terms of LEAST_DOCS rows or
    more, which alone can be kept, come to the driver; which they are is a bit for each slot. Null
    labels and ids are left out; a document labelled twice is toxic if one says so.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_toxic")).where(~held_out(F.col("doc_id")))
    share = known.agg(F.avg("_toxic")).first()[0] or 0.0
    draw = F.xxhash64(F.lit(2), "doc_id")
    chosen = known.where("_toxic = 1").orderBy(draw, "doc_id").limit(per_class).unionByName(known.where("_toxic = 0").orderBy(draw, "doc_id").limit(per_class))
    sample = docs.join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows at most
    sample = sample.groupBy("doc_id", "_toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))

    def start():
        def work(batch):
            marks = batch.column(batch.schema.get_field_index("_toxic"))
            texts = as_bytes(batch.column(batch.schema.get_field_index("text")))
            slots = [np.unique(np.fromiter((s for w in set(t.split()) for s in terms_of(w)), dtype=np.int32)) for t in texts]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(slots, pa.list_(pa.int32())), marks], names=["doc_id", "slots", "toxic"])

        return work

    held_terms = store(map_rows(sample, ["doc_id", "_toxic"], "doc_id long, slots array<int>, toxic int", start), "sample-terms")
    often = held_terms.df.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    words = often.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")).toArrow()
    mask = np.zeros(SLOTS // 64, np.uint64)
    mask[np.asarray(words["at"])] = np.asarray(words["bits"]).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(mask)  # SLOTS bits

    def frequent(batches):
        for batch in batches:
            slots = (np.asarray(h.values) for h in batch.column(1))
            held = [h[(shared.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1] for h in slots]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "slots", "toxic"])

    rows = held_terms.df.mapInArrow(frequent, "doc_id long, slots array<int>, toxic int").toArrow()
    discard(docs.sparkSession, held_terms.path)
    order = np.argsort(np.array(rows["doc_id"].to_pylist(), dtype=np.int64), kind="stable")
    held, toxic = [np.asarray(h.values) for h in rows["slots"]], np.asarray(rows["toxic"].to_pylist(), dtype=np.int64)
    machine = fit([held[i] for i in order], toxic[order], share)
    del held, rows
    pa.default_memory_pool().release_unused()
    return machine


def toxicity(docs: DataFrame, machine: Machine, keep: list[str] | None = None) -> DataFrame:
    """Columns in keep (default all), score, predicted: every whole text, one pass.

    Null and empty texts have no terms and get the machine's bias. Repeated rows score alike.
    Empty table: no rows. Input columns named like an added one give way to it.
    """
    prepare(docs.sparkSession)
    shared, base = docs.sparkSession.sparkContext.broadcast(machine), without(docs, [n for n, _ in ADDED])  # KEPT_TERMS + KEPT_PARTNERS rows at most

    def start():
        known = TermRows(shared.value.rows)

        def work(texts, _):
            held = []
            for t in texts:
                own: set[int] = set()
                for r in map(known.__getitem__, set(t.split())):
                    if r:
                        own.update(r)
                held.append(sorted(own))
            scores = shared.value.score(held)
            return [scores, (scores >= 0.5).astype(np.int32)]

        return work

    return map_text(base, keep or base.columns, ADDED, start)


class TermRows(dict):
    """word -> rows of its kept terms; None for most words."""

    def __init__(self, rows: dict[int, int]):
        super().__init__()
        self.rows = rows

    def __missing__(self, word: bytes):
        found = tuple(self.rows[s] for s in terms_of(word) if s in self.rows) or None
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[word] = found
        return found


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the machine does not predict toxic, with all their own columns.

    The machine learns from labelled rows among docs. Null and empty texts get its bias; repeated
    rows stay or go together; without labels of both classes it is a constant; an empty table gives none.
    """
    aside, back = set_aside(docs, [n for n, _ in ADDED])
    return back(toxicity(aside, train(docs.select("doc_id", "text"), labels)).where("predicted = 0"))
