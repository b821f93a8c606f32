"""Quality rules: exact text counts, then language-specific perplexity bands.

The n-gram model is counted by Spark over every document of each language, estimated there by
modified Kneser-Ney and kept in sorted hash arrays. A document's perplexity is per letter: blanks
and ASCII punctuation are predicted but add no length, so that marks strewn over a text raise it.
A language's band lies RANGES quartile ranges on either side of the median of all its documents
that pass the base rules, wider for short texts, whose mean varies more.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import map_text, set_aside
from claimweave.llm.kneser_ney import ORDER, UNIT, Model, collected, corpus_grams, estimated
from claimweave.session import discard, prepare, store, without

WINDOW, SYMBOLS = 8, b"#*$%&|<>"
MIN_WORDS, MOST_REPEATED, RANGES = 20, 30, 3.0
#: A band is wider by the root of 1 + SHORT / number of words.
SHORT = 400.0
#: Bytes that add no length to a text.
NO_LETTERS = string.punctuation.encode() + b" \t\n\r\v\f"
#: Entries of a model that a worker holds at a time; a larger model goes over the texts in parts.
MODEL_ENTRIES = 8_000_000
#: Languages whose bands are still broadcast.
MOST_LANGUAGES = 100_000
STATS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")]
SCORE = [("_letters", "long"), ("_sum", "long"), ("_text", "binary")]
ADDED = [n for n, _ in STATS] + ["log_perplexity", "base_failed", "kept", "low", "high"]


def text_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    blanks = sum(map(text.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    tails = 0 if text.isascii() else len(text) - len(text.decode("utf-8", "replace"))
    lines = text.split(b"\n")
    n_dup = 0
    if len(lines) > 1:
        with_word = [x for x in lines if x and not x.isspace()]
        n_dup = len(with_word) - len(set(with_word))
    return len(words), len(text) - tails - blanks, sum(text.count(c) for c in SYMBOL_BYTES), n_dup, repeated_words(words)


SYMBOL_BYTES = [bytes([c]) for c in SYMBOLS]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a WINDOW-word window that occurs twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        rolled = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measured(docs: DataFrame, models: dict[str, Model], keep: list[str]) -> DataFrame:
    """The columns in keep, STATS, _letters, _sum (log probability in millionths) and _text (digest): one pass over the whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # MODEL_ENTRIES at most

    def start():
        def work(texts, batch):
            split = [t.split() for t in texts]
            sums = log_sums(shared.value, [b" ".join(w) for w in split], batch, True)
            out = [(*text_counts(t, w), max(1, len(t.translate(None, NO_LETTERS))), s, digest(t)) for t, w, s in zip(texts, split, sums, strict=True)]
            return list(zip(*out))

        return work

    return map_text(docs, list(dict.fromkeys([*keep, "lang"])), STATS + SCORE, start)


def log_sums(models: dict[str, Model], texts: list[bytes], batch, back_off: bool) -> list[int]:
    """The log probability of each text by its language's model; 0 without one."""
    langs = [x or "" for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()]
    out = [0] * len(texts)
    for lang in dict.fromkeys(langs):
        if lang in models:
            rows = [i for i, x in enumerate(langs) if x == lang and texts[i]]
            for i, s in zip(rows, models[lang].score([texts[i] for i in rows], back_off).tolist(), strict=True):
                out[i] = s
    return out


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def summed_in_parts(docs: DataFrame, probs: DataFrame, order: int, parts: int) -> DataFrame:
    """_lang, _text, _sum where no worker may hold the model: each part of its grams goes over the texts by itself.

    The grams were counted on these documents, so each position's gram is in just one part.
    """
    top, of = probs.where(F.col("n") == order), F.pmod(F.xxhash64("gram"), F.lit(parts))
    passes = None
    for k in range(parts):
        models = collected(top.where(of == k), top.limit(0).select("lang", "n", F.col("gram").alias("context"), F.col("log_p").alias("log_rest")), order)
        shared = docs.sparkSession.sparkContext.broadcast(models)

        def start(shared=shared):
            return lambda texts, batch: [log_sums(shared.value, [b" ".join(t.split()) for t in texts], batch, False), [digest(t) for t in texts]]

        part = map_text(docs, ["lang"], [("_sum", "long"), ("_text", "binary")], start)
        one = store(part.groupBy(F.coalesce("lang", F.lit("")).alias("_lang"), "_text").agg(F.first("_sum").alias("_sum")), "part-sums").df
        shared.destroy()
        passes = one if passes is None else passes.unionByName(one)
    return passes.groupBy("_lang", "_text").agg(F.sum("_sum").alias("_part_sum"))


def quality_rules(docs: DataFrame, keep: list[str] | None = None, order: int = ORDER, ranges: float = RANGES, entries: int = MODEL_ENTRIES) -> DataFrame:
    """Columns in keep (default all), STATS, log_perplexity, base_failed, low, high, kept: one row per document.

    Null text: no words, base_failed. Null lang is read as '': one language with empty names.
    Languages with no document past the base rules have no band: what passes the base rules is
    kept. Bytes that are no UTF-8 count as they are. Repeated rows are counted and judged each.
    Empty table: no rows. Input columns named like an added one give way to it. The model has the
    same order at any size; beyond so many entries its parts go over the texts one by one.
    """
    spark = prepare(docs.sparkSession)
    base = without(docs, ADDED + [n for n, _ in SCORE])
    counted = store(corpus_grams(base, order), "gram-counts")
    probs, rests = estimated(counted.df, order)
    parts = -(-(probs.count() + rests.count()) // entries)
    shown = [c for c in (keep or base.columns) if c in base.columns]
    found = measured(base, collected(probs, rests, order) if parts < 2 else {}, shown)
    if parts > 1:
        sums = summed_in_parts(base, probs, order, parts)
        found = found.join(sums.withColumnRenamed("_text", "_of"), (F.coalesce(found["lang"], F.lit("")) == F.col("_lang")) & (found["_text"] == F.col("_of"))).withColumn("_sum", F.col("_part_sum"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    score = -F.col("_sum") / UNIT / F.col("_letters")
    scored = store(found.select(*dict.fromkeys([*shown, "lang"]), *[n for n, _ in STATS], score.alias("log_perplexity"), failed.alias("base_failed")), "quality").df
    discard(spark, counted.path)
    bands = few_languages(perplexity_bands(scored, ranges))
    joined = scored.join(bands, F.coalesce(scored["lang"], F.lit("")) == bands["_lang"], "left")
    joined = joined.withColumns({"low": F.col("_middle") - wider() * F.col("_reach"), "high": F.col("_middle") + wider() * F.col("_reach")})
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    out = joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
    return out.select(*shown, *[n for n, _ in STATS], "log_perplexity", "base_failed", "low", "high", "kept")


def few_languages(df: DataFrame) -> DataFrame:
    """A table of a row a language, stored, with a broadcast hint if it is small: documents need not move to join it."""
    held = store(df, "languages").df
    return F.broadcast(held) if held.count() <= MOST_LANGUAGES else held


def wider():
    """How much wider a band is for a text of few words."""
    return F.sqrt(1 + SHORT / F.greatest(F.col("n_words"), F.lit(1)))


def perplexity_bands(scored: DataFrame, ranges: float = RANGES) -> DataFrame:
    """_lang, _middle, _reach: the median, and ranges quartile ranges of the deviations in units of their width.

    Both from histograms (cells of a thousandth) over all documents past the base rules.
    """
    good = scored.where("not base_failed").select(F.coalesce("lang", F.lit("")).alias("_lang"), "log_perplexity", "n_words")
    cells = lambda df, x: df.groupBy("_lang", F.round(x, 3).alias("x")).agg(F.count("*").alias("n")).groupBy("_lang")
    middle = few_languages(cells(good, F.col("log_perplexity")).agg(F.percentile("x", F.lit(0.5), F.col("n")).alias("_middle")))
    apart = good.join(middle, "_lang").withColumn("apart", (F.col("log_perplexity") - F.col("_middle")) / wider())
    q = cells(apart, F.col("apart")).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"))
    return middle.join(q, "_lang").select("_lang", "_middle", (F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.005)) * ranges).alias("_reach"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their own columns, clashing names included.

    Null, empty and short texts go with the base rules; repeated rows stay or go together; an
    empty table gives none. See quality_rules.
    """
    aside, back = set_aside(docs, ADDED + [n for n, _ in SCORE])
    return back(quality_rules(aside).where("kept"))
