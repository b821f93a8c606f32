"""Token counts: a linear longest-match automaton over a public vocabulary.

The vocabulary's byte strings form a trie. A node's failure link leads to the node that stands
for what is left after the greedy pieces of its string are popped, and its count says how many
pieces those are, so a word is counted in one pass without building a piece. A word is read with
a blank before it, as the vocabulary marks word starts.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame

from claimweave.llm.common import map_text
from claimweave.session import prepare, without

ADDED = [("n_words", "long"), ("n_tokens", "long")]
#: Words whose counts a worker remembers, and the longest that is, in bytes.
CACHED, CACHED_LENGTH = 500_000, 64


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a public vocabulary on this machine; callers may pass a path of their own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> list[bytes]:
    """The byte strings of a ranks file: one base64 string and one rank a line. Read on the driver."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch(dict):
    """word -> number of greedy longest-match pieces of blank + word."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__()
        self.child: list[dict[int, int]] = [{}]
        ends, depth = [False], [0]
        for piece in vocabulary:
            at = 0
            for c in piece:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                    depth.append(depth[at] + 1)
                at = self.child[at][c]
            ends[at] = at > 0
        self.fail, self.popped = [0] * len(self.child), [0] * len(self.child)
        level = [0]
        while level:  # breadth first: a node's link needs its parent's
            below = []
            for at in level:
                for c, to in self.child[at].items():
                    self.fail[to], self.popped[to] = self.link(at, c, ends[to])
                    below.append(to)
            level = below

    def link(self, parent: int, c: int, ends: bool) -> tuple[int, int]:
        """Where the rest of parent's string plus c stands once its greedy pieces are popped."""
        if ends:
            return 0, 1  # the string is a piece itself
        if parent == 0:
            return -1, 0  # a byte that no piece starts with alone: no way on
        at, count = self.fail[parent], self.popped[parent]
        while at > 0 and c not in self.child[at]:
            count += self.popped[at]
            at = self.fail[at]
        if at < 0 or c not in self.child[at]:
            return -1, 0
        return self.child[at][c], count

    def __missing__(self, word: bytes) -> int:
        count = self.count(b" " + word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[word] = count
        return count

    def count(self, text: bytes) -> int:
        """Pieces of the text; a text that no sequence of greedy pieces covers counts as 1 (unknown)."""
        child, fail, popped = self.child, self.fail, self.popped
        at = total = 0
        for c in text:
            while (to := child[at].get(c)) is None:
                if at == 0 or fail[at] < 0:
                    return 1
                total += popped[at]
                at = fail[at]
            at = to
        while at:
            if fail[at] < 0:
                return 1
            total += popped[at]
            at = fail[at]
        return total


def token_counts(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns in keep (default all), n_words, n_tokens: greedy word pieces of each whole text.

    Null and empty texts: 0 and 0. Repeated rows are counted each. Empty table: no rows. Input
    columns named like an added one give way to it.
    """
    prepare(docs.sparkSession)
    base = without(docs, [n for n, _ in ADDED])
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path or vocabulary_file()))  # the size of one vocabulary file

    def start():
        known = LongestMatch(pieces.value)

        def work(texts, _):
            split = [t.split() for t in texts]
            return [list(map(len, split)), [sum(map(known.__getitem__, w)) for w in split]]

        return work

    return map_text(base, keep or base.columns, ADDED, start)
