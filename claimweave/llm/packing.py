"""Best-fit packing: token pieces into sequences of a fixed capacity.

Documents become token ids, longer ones are cut at the capacity, and pieces are packed by
bounded-space online best fit: a fixed number of bins is open at a time, a bitset holds their
free space, a piece goes to the bin with the least room that takes it, and the fullest bin
closes first when one too many is open. Pieces are dealt into groups by hash, and each group is a
stream of its own in hash order, so no task holds more than a group. A stream is read in runs
of RUN pieces, the longest of a run first: with OPEN_BINS bins that takes about one sequence in a
thousand more than their tokens need, and the plain hash order one in two hundred.
"""

from __future__ import annotations

import json
import unicodedata
import os
import string
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import map_rows
from claimweave.session import prepare, store, without

CAPACITY, END_ID, OPEN_BINS, RUN, GROUP_PIECES = 4096, 1, 64, 500, 20_000
#: Words whose ids a worker remembers in each of two generations, and the longest that is.
CACHED, CACHED_LENGTH = 250_000, 64
#: Marks that the pattern splits off the end of a word of letters.
MARKS = frozenset(string.punctuation) - {"'"}
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "sequence_id long, offset long, closed_early boolean"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer on this machine; callers may pass a path of their own."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """What was worked out for words of late: when the dict is full it becomes the older generation, which words in use leave."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def __missing__(self, word: str) -> bytes:
        code = self.older.get(word)
        if code is None:
            code = self.worked_out(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[word] = code
        return code


class Parts(Remembered):
    """Ids of what the tokenizer's pattern finds in lower-case text."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model
        self.shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        self.shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in self.shown)}

    def worked_out(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


class WordEncoder(Remembered):
    """Little-endian unsigned 32-bit ids of white-space-delimited words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in turn, and a worker encodes each word once in a while. Words of plain Latin text go
    straight from the tokenizer's pattern to its BPE model; all others through the tokenizer.
    """

    def __init__(self, form: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(form)
        form = json.loads(self.tokenizer.to_str())
        steps = form["pre_tokenizer"].get("pretokenizers", [{}]) if form["pre_tokenizer"] else [{}]
        self.pattern, self.parts = None, Parts(self.tokenizer)
        if [n["type"] for n in (form["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in steps] == ["Split", "ByteLevel"]:
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        #: Whether a run of letters is one part, and a mark after it another.
        self.by_letters = bool(self.pattern) and r"|[\p{L}]+|" in self.pattern.pattern and self.pattern.findall("it's,") == ["it", "'s", ","]

    def worked_out(self, word: str) -> bytes:
        if self.pattern and (word.isascii() or (max(word) < "\u0250" and unicodedata.is_normalized("NFC", word))) and "<|" not in word:
            low = word.lower()
            if self.by_letters and low.isalpha():
                return self.parts.worked_out(low)
            if self.by_letters and low[-1:] in MARKS and low[:-1].isalpha():
                return self[word[:-1]] + self.parts[low[-1]]
            return b"".join(map(self.parts.__getitem__, self.pattern.findall(low)))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, words(text)))


def words(text: str) -> list[str]:
    """Split at ASCII white space, which the tokenizer drops; empty strings may occur."""
    for c in "\n\t\r\v\f":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids plus end_id, cut at capacity.

    Null text: that of an empty one. Without end_id an empty text gives no piece. Repeated rows
    give their pieces each. Only doc_id and text are read, whatever else the table holds.
    """
    prepare(docs.sparkSession)
    path = path or tokenizer_file()
    with open(path, encoding="utf-8") as file:  # on the driver; workers get the bytes
        form = docs.sparkSession.sparkContext.broadcast(file.read())
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def start():
        encoder = WordEncoder(form.value)

        def work(batch):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                code = encoder.encode(text) + tail
                for piece, b in enumerate(range(0, len(code), 4 * capacity)):
                    part = code[b : b + 4 * capacity]
                    rows.append((doc, piece, b // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4")] if with_ids else [])))
            columns = list(zip(*rows)) or [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

        return work

    return map_rows(docs, ["doc_id"], schema, start)


def best_fit(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int], set[int]]:
    """Bin and offset of each piece, in the order given (the online order), and the bins that closed with room left."""
    free_bits, by_free, used, opened, n = 0, [[] for _ in range(capacity + 1)], [], 0, 0
    bins, offsets, early = [], [], set()
    for size in lengths:
        fits = free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                free_bits &= ~(1 << free)
        else:
            at, free = n, capacity
            used.append(0)
            n, opened = n + 1, opened + 1
        bins.append(at)
        offsets.append(used[at])
        used[at] += size
        free -= size
        if free == 0:
            opened -= 1
        else:
            by_free[free].append(at)
            free_bits |= 1 << free
        if opened > open_bins:  # the fullest closes
            full = (free_bits & -free_bits).bit_length() - 1
            early.add(by_free[full].pop())
            if not by_free[full]:
                free_bits &= ~(1 << full)
            opened -= 1
    return bins, offsets, early


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES, run_pieces: int = RUN) -> DataFrame:
    """Pieces with sequence_id, offset, closed_early: no sequence over capacity, offsets gapless from 0.

    pieces: doc_id, piece, length and whatever else; a stored table, so that its rows keep their
    numbers. Groups hold about group_pieces pieces whatever the number of documents, equal rows
    included. closed_early: the sequence had room when it closed as the fullest of too many.
    Empty table: no rows. Input columns named like an added one give way to it.
    """
    base = without(pieces, ["sequence_id", "offset", "closed_early", "_group", "_turn"])
    groups = max(1, -(-base.count() // group_pieces))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", " + PACKED
    ordered = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in base.columns]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_turn", *ordered], kind="stable").drop(columns=["_group", "_turn"])
        turn = np.lexsort((-frame["length"].to_numpy(), np.arange(len(frame)) // run_pieces))
        frame = frame.iloc[turn]
        bins, offsets, early = best_fit(frame["length"].tolist(), capacity, open_bins)
        return frame.assign(sequence_id=np.array(bins, dtype="int64") + (int(key[0]) << 40), offset=np.array(offsets, dtype="int64"), closed_early=[b in early for b in bins])

    turn = F.xxhash64(*[F.col(c) for c in ordered], F.monotonically_increasing_id())  # equal rows part
    dealt = base.withColumn("_turn", turn).withColumn("_group", F.pmod(F.xxhash64("_turn"), F.lit(groups)).cast("int"))
    return dealt.repartition(groups, "_group").groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents: token_pieces, stored once, then pack.

    Null and empty texts, repeated rows, empty tables and clashing columns: see token_pieces.
    """
    return pack(store(token_pieces(docs, path, capacity, end_id, with_ids), "pieces").df, capacity, open_bins)
