"""A modified Kneser-Ney model of the bytes of texts, counted and estimated by Spark, held in sorted hash arrays.

A text's words are joined by single blanks, with ORDER - 1 marks before and one after, and each
byte and the end mark is predicted from the ORDER - 1 bytes before it, across words. Counts of the
highest order are occurrences over the corpus, lower orders count distinct left extensions, each
order has its own three discounts, and orders interpolate down to a uniform law over the 256 bytes.
A gram of n bytes is a number: its bytes, the last one lowest. Log probabilities are whole
millionths, so that sums do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import map_rows
from claimweave.session import store

ORDER, MARK, UNIT = 5, 10, 1_000_000
#: Positions worked on at a time, and distinct grams that a counting task holds before it passes them on.
CHUNK, HELD = 1 << 18, 1_000_000
#: Rows of discounts that are still broadcast.
MOST_BROADCAST = 100_000
_ODD = 0x9E3779B97F4A7C15


def stream(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (words joined by blanks) with their marks, and where each text ends (its end mark)."""
    pad = bytes([MARK]) * (order - 1)
    joined = np.frombuffer(b"".join(pad + t + bytes([MARK]) for t in texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + order) - 1
    return joined, ends


def grams_of(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, gram) of each predicted byte, in pieces of at most CHUNK positions."""
    joined, ends = stream(texts, order)
    for at in range(0, len(joined), CHUNK):
        upto = min(len(joined), at + CHUNK)
        first = max(0, at - order + 1)
        part = joined[first:upto].astype(np.uint64)
        gram = np.zeros(len(part) - order + 1, np.uint64)
        for k in range(order):
            gram = (gram << np.uint64(8)) | part[k : len(part) - order + 1 + k]
        position = np.arange(first + order - 1, upto)
        text = np.searchsorted(ends, position)
        real = position >= ends[text] - np.diff(ends, prepend=-1)[text] + order
        yield text[real], gram[real]


def count_grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the highest order, sorted, and their counts."""
    held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _, gram in grams_of(texts, order):
        held = added(held, np.unique(gram, return_counts=True))
    return held


def added(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two tables of (sorted grams, counts)."""
    grams, which = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    return grams, np.bincount(which, weights=np.concatenate([one[1], two[1]]), minlength=len(grams)).astype(np.int64)


def corpus_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, c: counts over all documents (null lang: ''); tasks add up before the shuffle."""

    def start():
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (grams, counts) in held.items():
                for at in range(0, len(grams), 100_000):
                    part = grams[at : at + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(counts[at : at + 100_000])], names=["lang", "gram", "c"])
            held.clear()

        def work(batch):
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
            langs = [x or "" for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()]
            for lang in dict.fromkeys(langs):
                own = [words for t, x in zip(texts, langs, strict=True) if x == lang and (words := b" ".join((t or b"").split()))]
                if own:
                    new = count_grams(own, order)
                    held[lang] = added(held[lang], new) if lang in held else new
            if sum(len(g) for g, _ in held.values()) > HELD:
                yield from flush()

        work.done = flush
        return work

    return map_rows(docs, ["lang"], "lang string, gram long, c long", start).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def estimated(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(lang, n, gram, log_p) of all orders and (lang, n, context, log_rest), from a stored table of counts; in Spark throughout."""
    levels = {order: counts.select("lang", "gram", "c")}
    for n in range(order - 1, 0, -1):
        shorter = levels[n + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("gram")).agg(F.count("*").alias("c"))
        levels[n] = store(shorter, "grams").df if n == order - 1 else shorter
    probs, rests, lower = [], [], None
    cuts = store(reduce(DataFrame.unionByName, [discounts(level).withColumn("n", F.lit(n)) for n, level in levels.items()]), "discounts").df
    few = cuts.count() <= MOST_BROADCAST  # a row for each language and order
    for n in range(1, order + 1):
        own = Window.partitionBy("lang", "context")  # 256 rows at most
        seen = {"total": F.sum("c").over(own), "k1": F.count_if(F.col("c") == 1).over(own), "k2": F.count_if(F.col("c") == 2).over(own), "k3": F.count_if(F.col("c") >= 3).over(own)}
        held = levels[n].withColumn("context", F.shiftright("gram", 8)).withColumns(seen)
        mine = cuts.where(F.col("n") == n).drop("n")
        held = held.join(F.broadcast(mine) if few else mine, "lang")
        freed = F.col("k1") * F.col("d1") + F.col("k2") * F.col("d2") + F.col("k3") * F.col("d3")  # a cut is never over its count
        cut = F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d1"))
        held = held.select("lang", "gram", "context", ((F.col("c") - cut) / F.col("total")).alias("own"), (freed / F.col("total")).alias("rest"))
        if lower is None:
            held = held.withColumn("lower", F.lit(1 / 256))
        else:
            held = held.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
        lower = store(held.select("lang", "gram", "context", "rest", (F.col("own") + F.col("rest") * F.col("lower")).alias("p")), "chances").df
        millionths = lambda c: F.round(F.log(c) * UNIT).cast("int")
        probs.append(lower.select("lang", F.lit(n).alias("n"), "gram", millionths(F.col("p")).alias("log_p")))
        rests.append(lower.groupBy("lang", "context").agg(F.first("rest").alias("rest")).select("lang", F.lit(n).alias("n"), "context", millionths(F.greatest("rest", F.lit(1e-12))).alias("log_rest")))
    for k in range(1, order):
        probs[0], rests[0] = probs[0].unionByName(probs[k]), rests[0].unionByName(rests[k])
    return probs[0], rests[0]


def discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 from the numbers of grams seen once to four times; halves where too few are known."""
    n = level.groupBy("lang").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cut = lambda k, other: F.when(known, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(float(k)))).otherwise(other).alias(f"d{k}")
    return n.select("lang", cut(1, 0.5), cut(2, 0.75), cut(3, 1.0))


def hashed(grams: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """A one-to-one hash of (n, gram)."""
    with np.errstate(over="ignore"):
        return (grams.astype(np.uint64) | (np.asarray(n, np.uint64) << np.uint64(56))) * np.uint64(_ODD)


class Table:
    """Sorted hashes with their values; where each beginning of a hash starts is kept, so few steps find one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.int32)
        self.shift = 64 - max(1, int(len(keys)).bit_length())
        beginnings = np.arange(1 << (64 - self.shift), dtype=np.uint64)
        self.starts = np.searchsorted(self.keys >> np.uint64(self.shift), beginnings).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is held, and its value (0 if not)."""
        hit, out = np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        if not len(self.keys):
            return hit, out
        todo, at = np.arange(len(wanted)), self.starts[(wanted >> np.uint64(self.shift)).astype(np.int64)].astype(np.int64)
        while len(todo):
            inside = at < len(self.keys)
            todo, at = todo[inside], at[inside]
            key, want = self.keys[at], wanted[todo]
            same = key == want
            hit[todo[same]], out[todo[same]] = True, self.values[at[same]]
            on = key < want
            todo, at = todo[on], at[on] + 1
        return hit, out


class Model:
    """One language's log probabilities of grams and log back-off weights of contexts, in millionths."""

    def __init__(self, order: int, grams: Table, contexts: Table):
        self.order, self.grams, self.contexts = order, grams, contexts

    def score(self, texts: list[bytes], back_off: bool = True) -> np.ndarray:
        """Log probability of each text (words joined by blanks) with its end mark, in millionths.

        back_off=False: grams that the model doesn't hold add nothing (they are in another part).
        """
        total = np.zeros(len(texts), np.int64)
        unseen = round(np.log(1 / 256) * UNIT)
        for text, gram in grams_of(texts, self.order):
            value, todo = np.zeros(len(gram), np.int64), np.arange(len(gram))
            for n in range(self.order, 0, -1) if back_off else [self.order]:
                tail = gram[todo] & np.uint64((1 << 8 * n) - 1)
                hit, found = self.grams.find(hashed(tail, n))
                value[todo] += found
                todo, tail = todo[~hit], tail[~hit]
                if not len(todo):
                    break
                if back_off:
                    value[todo] += self.contexts.find(hashed(tail >> np.uint64(8), n))[1]
            if back_off:
                value[todo] += unseen
            np.add.at(total, *summed(text, value))
        return total


def summed(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in a sorted column, and the sums of their values."""
    first = np.flatnonzero(np.diff(text, prepend=-1))
    return text[first], np.add.reduceat(value, first) if len(first) else value


def collected(probs: DataFrame, rests: DataFrame, order: int = ORDER) -> dict[str, Model]:
    """A model per language from tables whose size the caller has bounded."""

    def tables(df: DataFrame, gram: str, value: str) -> dict[str, Table]:
        # no Python object a row: the driver holds packed arrays only
        rows = df.select("lang", F.col("n").cast("tinyint"), gram, value).toArrow()
        named = rows["lang"].combine_chunks().dictionary_encode()
        names, codes = named.dictionary.to_pylist(), named.indices.to_numpy()
        keys, values = hashed(rows[gram].to_numpy().view(np.uint64), rows["n"].to_numpy()), rows[value].to_numpy()
        return {name: Table(keys[own], values[own]) for k, name in enumerate(names) for own in [codes == k]}

    grams, contexts = tables(probs, "gram", "log_p"), tables(rests, "context", "log_rest")
    pa.default_memory_pool().release_unused()
    return {lang: Model(order, t, contexts.get(lang, Table(np.zeros(0, np.uint64), np.zeros(0)))) for lang, t in grams.items()}
