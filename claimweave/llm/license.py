"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

A template of n word shingles belongs to the size class of the largest power of two <= n / 2
(1 at least). Its windows of that many shingles, at every offset, go into band tables; a text's
windows of each class overlap by half, so some window lies whole within any copy of a template.
A band is one MinHash value: windows that share a share J of their shingles meet in one of BANDS
bands with chance 1 - (1 - J)^BANDS (J 0.5: 0.9998). What is retrieved is verified by the exact
share of the template's shingles that stand together in the text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from claimweave.llm.common import as_bytes, map_rows
from claimweave.llm.license_templates import TEMPLATES
from claimweave.session import prepare

SHINGLE, LEAST, BANDS = 5, 0.8, 12
#: Templates that a worker holds at a time; more are scanned in parts of so many.
HELD_TEMPLATES = 5000
_EDGES = b"\"'()[]{}<>.,;:!?*#-_/\\|"
FOUND = "doc_id long, template int, license string, containment double, first_word long, matched long"


class WordHash(dict):
    """word -> 64-bit hash of the word in lower case without edge punctuation."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word.lower().strip(_EDGES), 1)
        if len(word) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[word] = value
        return value


def shingles(text: bytes, known: WordHash) -> np.ndarray:
    """Hashes of the text's SHINGLE-word shingles in order; a shorter text is one shingle, none if wordless."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n, width = max(1, len(words) - SHINGLE + 1), min(SHINGLE, len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
        return (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def spelled(text: bytes) -> list[tuple]:
    """The shingles of shingles() as tuples of words."""
    plain = [w.lower().strip(_EDGES) for w in text.split()]
    return [tuple(plain[k : k + SHINGLE]) for k in range(max(1, len(plain) - SHINGLE + 1))] if plain else []


def size_class(n: int) -> int:
    return 1 << max(0, (max(2, n) // 2).bit_length() - 1)


def band_values(hashes: np.ndarray, bands: int) -> list[np.ndarray]:
    """Each band's permutation of the hashes; windows take the least."""
    with np.errstate(over="ignore"):
        return [(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * np.uint64((0xBF58476D1CE4E5B9 * (2 * k + 1)) % 2**64 | 1) for k in range(bands)]


class Scanner:
    """The band tables of all templates, and the scan of a text."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.known = WordHash()
        self.names = [n for n, _ in templates]
        self.sets, self.orders, self.words = [], [], []
        tables: dict[tuple[int, int], dict[int, set[int]]] = {}
        for t, (_, text) in enumerate(templates):
            own = shingles(text.encode(), self.known)
            self.sets.append(np.unique(own))
            self.orders.append(len(own))
            self.words.append(spelled(text.encode()))
            if not len(own):
                continue
            size = size_class(len(own))
            for k, v in enumerate(band_values(own, 1 if size == 1 else BANDS)):
                table = tables.setdefault((size, k), {})
                for at in range(len(own) - size + 1):
                    table.setdefault(int(v[at : at + size].min()), set()).add(t)
        self.tables = {key: (np.array(sorted(t), np.uint64), [sorted(t[v]) for v in sorted(t)]) for key, t in tables.items()}
        self.sizes = sorted({s for s, _ in self.tables})

    def candidates(self, own: np.ndarray, text_of: np.ndarray) -> set[tuple[int, int]]:
        """(text, template) where a window shares a band value; own: the shingles of many texts in a row.

        Windows may run over a text's end; then both texts are named, and verification decides.
        """
        out: set[tuple[int, int]] = set()
        for k, values in enumerate(band_values(own, BANDS)):
            for size in self.sizes:
                if (size, k) not in self.tables:
                    continue
                half, v = max(1, size // 2), values
                if size > 1:
                    blocks = -(-len(own) // half)
                    v = np.concatenate([v, np.full(blocks * half - len(v), ~np.uint64(0))]).reshape(blocks, half).min(axis=1)
                    v = np.minimum(v[:-1], v[1:]) if blocks > 1 else v
                keys, templates = self.tables[size, k]
                at = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
                for w in np.flatnonzero(keys[at] == v).tolist():
                    spanned = np.unique(text_of[w * half : w * half + size]).tolist()
                    out.update((i, t) for i in spanned for t in templates[at[w]])
        return out

    def verify(self, own: np.ndarray, t: int, least: float) -> tuple[float, int, int] | None:
        """Best share of template t's shingles within one stretch of 1.5 times its length, where it starts, how many."""
        wanted, n = self.sets[t], self.orders[t]
        at = np.flatnonzero(np.isin(own, wanted))
        if len(at) < least * len(wanted):
            return None
        stretch, best, first = n + n // 2, 0, 0
        held: dict[int, int] = {}
        left = 0
        for right, p in enumerate(at.tolist()):
            held[int(own[p])] = held.get(int(own[p]), 0) + 1
            while at[left] <= p - stretch:
                old = int(own[at[left]])
                held[old] -= 1
                if not held[old]:
                    del held[old]
                left += 1
            if len(held) > best:
                best, first = len(held), int(at[left])
        return (best / len(wanted), first, best) if best >= least * len(wanted) else None

    def spelt_alike(self, text: list[tuple], t: int, first: int, least: float) -> tuple[float, int, int] | None:
        """What verify found, counted again by the words themselves: hashes may meet by chance."""
        wanted, n = self.words[t], self.orders[t]
        wanted = set(wanted)
        best = len(wanted.intersection(text[first : first + n + n // 2]))
        return (best / len(wanted), first, best) if best >= least * len(wanted) else None

    def scan(self, texts: list[bytes], least: float = LEAST) -> list[tuple[int, int, float, int, int]]:
        """(text, template, containment, first word, matched shingles) of what is found."""
        each = [shingles(t, self.known) for t in texts]
        sizes = [len(e) for e in each]
        if not sum(sizes):
            return []
        met = self.candidates(np.concatenate(each), np.repeat(np.arange(len(texts)), sizes))
        found, spelt = [], {}
        for i, t in sorted(met):
            v = self.verify(each[i], t, least)
            if v:
                spelt = spelt if i in spelt else {i: spelled(texts[i])}
                v = self.spelt_alike(spelt[i], t, v[1], least)
            if v:
                found.append((i, t, *v))
        return found


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, template, license, containment, first_word, matched: a row per document and template found in it.

    One pass over the whole texts for each HELD_TEMPLATES templates, no shuffle. Null, empty and
    wordless texts: no rows. Repeated rows give theirs each. Empty table: no rows. Only doc_id and
    text are read.
    """
    prepare(docs.sparkSession)
    chosen = list(TEMPLATES if templates is None else templates)
    parts = [scanned(docs, chosen[at : at + HELD_TEMPLATES], at, least) for at in range(0, max(1, len(chosen)), HELD_TEMPLATES)]
    return reduce(DataFrame.unionByName, parts)


def scanned(docs: DataFrame, chosen: list[tuple[str, str]], number: int, least: float) -> DataFrame:
    """license_scan for templates that are numbered from number on."""
    held = docs.sparkSession.sparkContext.broadcast(chosen)  # HELD_TEMPLATES at most

    def start():
        scanner = Scanner(held.value)

        def work(batch):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            found = scanner.scan(as_bytes(batch.column(batch.schema.get_field_index("text"))), least)
            rows = [(ids[i], number + t, scanner.names[t], *v) for i, t, *v in found]
            kinds = {"doc_id": pa.int64(), "template": pa.int32(), "license": pa.string(), "containment": pa.float64(), "first_word": pa.int64(), "matched": pa.int64()}
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        return work

    return map_rows(docs, ["doc_id"], FOUND, start)
