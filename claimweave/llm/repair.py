"""Conversation structure repair: the cheapest edits that make roles alternate, by time-major tensors.

Two streams over rows sorted by conversation and turn. The first carries no texts: a few numbers
for each row (role initial, faults, two hashes of what was said). It cuts whole conversations out
of what has arrived, buckets them by length, and runs one dynamic program for all conversations of
a bucket at once: a tensor with time first, in which each step is one vector operation over all of
them. The costs from each turn to the end are kept, so the edits are traced forwards, again for all
at once, and of equally cheap ones the least letter is taken at each step. The second stream meets
each conversation's edits and then its texts, row after row, and folds them into a hash; no
conversation's text is ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import WORD, slices
from claimweave.session import prepare, store

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS = 1, 2, 5, 5
#: What may be said after each state (nothing, system, user, assistant): the state after a kept row whose
#: role begins with s, u, a or something else (-1: not allowed), and after a user or assistant that is put there.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
PUT = np.array([2, 2, 3, 2])
#: States in which a conversation may end.
ENDS = (0, 3)
#: Beyond any cost that can be met.
NEVER = 1 << 40
#: Rows that wait until whole conversations are cut out of them.
BATCH_ROWS = 1 << 16
#: Characters of a text by which rows of one turn and role are ordered, before its hash.
HEAD = 64
PUT_ROLE = {2: "user", 3: "assistant"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows after damage by a checksum of 'conv_id:turn', nulls read as one space.

    One in twenty each: dropped (it stays as a row with gone = true, so that its conversation isn't
    lost), emptied, without its [.!?], repeated, said by the user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("_fate"))
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_fate") == 0).alias("gone"), times.alias("_time")).drop("_time")


def hashes() -> list[Column]:
    """How a text begins, and two 64-bit hashes of role and text, which together stand for them."""
    return [F.substring("text", 1, HEAD).alias("head")] + [F.xxhash64(F.lit(seed), "role", "text").alias(name) for seed, name in ((12, "h1"), (13, "h2"))]


def marks(rows: DataFrame) -> DataFrame:
    """The first stream's rows: no texts."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    return rows.select(
        "conv_id",
        "turn",
        "role",
        *hashes(),
        initial.cast("byte").alias("initial"),
        (~F.col("text").rlike(WORD)).alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
        "gone",
    )


def sorted_stream(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation in one partition, by turn (nulls first), role, how the text begins and hash."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", *first, "turn", "role", "head", "h1", "h2")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def costs_to_end(initial: np.ndarray, faulty: np.ndarray, cut: np.ndarray, pad: np.ndarray) -> np.ndarray:
    """int64 [T + 1, 4, N]: the least cost from each turn and state to the end. Inputs are time-major [T, N]."""
    steps, many = initial.shape
    out = np.full((steps + 1, 4, many), NEVER, dtype=np.int64)
    for state in ENDS:
        out[steps, state] = 0
    with_inserts(out[steps])
    for t in range(steps - 1, -1, -1):
        after, here = out[t + 1], out[t]
        stays = np.where(cut[t], STAYS, 0)
        for state in range(4):
            follow = KEPT[state][initial[t]]
            kept = np.where(follow >= 0, np.take_along_axis(after, np.maximum(follow, 0)[None], axis=0)[0], NEVER)
            best = np.minimum(kept, REROLE + after[PUT[state]]) + stays
            here[state] = np.minimum(np.where(faulty[t], NEVER, best), DELETE + after[state])
        with_inserts(here)
        here[:, pad[t]] = after[:, pad[t]]
    return out


def with_inserts(cost: np.ndarray) -> None:
    """Allow turns to be put in before what comes: twice suffices, as a whole exchange put in never pays."""
    for _ in range(2):
        cost[2] = np.minimum(cost[2], INSERT + cost[3])
        cost[3] = np.minimum(cost[3], INSERT + cost[2])
        cost[1] = np.minimum(cost[1], INSERT + cost[2])
        cost[0] = np.minimum(cost[0], INSERT + cost[2])


def trace(cost: np.ndarray, initial: np.ndarray, faulty: np.ndarray, cut: np.ndarray, pad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters [T, N], inserts before each turn and at the end [T + 1, N]): the ASCII-least of the cheapest edits."""
    steps, many = initial.shape
    letters, inserts = np.zeros((steps, many), dtype="S1"), np.zeros((steps + 1, many), dtype=np.int64)
    state, column = np.zeros(many, dtype=np.int64), np.arange(many)
    for t in range(steps + 1):
        real = ~pad[t] if t < steps else np.ones(many, dtype=bool)
        while True:
            here = cost[t][state, column]
            deletes = real & (DELETE + cost[t + 1][state, column] == here) if t < steps else np.zeros(many, dtype=bool)
            puts = real & ~deletes & (INSERT + cost[t][PUT[state], column] == here)
            if t == steps:
                puts &= here > 0
            if not puts.any():
                break
            inserts[t] += puts
            state = np.where(puts, PUT[state], state)
        if t == steps:
            return letters, inserts
        stays = np.where(cut[t], STAYS, 0)
        follow = KEPT[state, initial[t]]
        keeps = real & ~deletes & ~faulty[t] & (follow >= 0) & (stays + cost[t + 1][np.maximum(follow, 0), column] == here)
        letters[t] = np.where(deletes, b"D", np.where(keeps, b"K", np.where(real, b"R", b"")))
        state = np.where(keeps, follow, np.where(real & ~deletes, PUT[state], state))
    raise AssertionError


def repaired(lengths: np.ndarray, starts: np.ndarray, initial: np.ndarray, faulty: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(cost, audit) of conversations that lie one after another in flat arrays, bucket by bucket of lengths."""
    cost, audit = np.zeros(len(lengths), dtype=np.int64), [""] * len(lengths)
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    for size in np.unique(bucket):
        which = np.flatnonzero((bucket == size) & (lengths > 0))
        if not len(which):
            continue
        steps = int(lengths[which].max())
        time = np.arange(steps)[:, None]
        pad = time >= lengths[which][None]
        at = np.where(pad, 0, starts[which][None] + time)
        tensor = [np.where(pad, filler, flat[at]) for flat, filler in ((initial, 3), (faulty, False), (cut, False))]
        to_end = costs_to_end(*tensor, pad)
        cost[which] = to_end[0, 0]
        letters, inserts = trace(to_end, *tensor, pad)
        for n, conversation in enumerate(which):
            own = letters[: lengths[conversation], n].tobytes().decode()
            puts = inserts[:, n]
            if puts.any():
                own = "".join("I" * int(k) + c for k, c in zip(puts, [*own, *[""] * (steps + 1 - len(own))], strict=True))
            audit[conversation] = own
    return cost, audit


def figures(whole: dict[str, np.ndarray], first: np.ndarray) -> dict[str, np.ndarray | list[str]]:
    """What is told of each conversation; first: where each begins in the flat arrays."""
    many, rows = len(first), len(whole["gone"])
    number = np.repeat(np.arange(many), np.diff(np.append(first, rows)))
    live = ~whole["gone"]
    number, own = number[live], {k: v[live] for k, v in whole.items()}
    per = lambda flag: np.bincount(number[flag], minlength=many)
    everything = np.ones(len(number), dtype=bool)
    lengths = per(everything)
    starts = np.cumsum(lengths) - lengths
    order = np.lexsort((np.arange(len(number)), own["h2"], own["h1"], number))
    again = np.zeros(len(number), dtype=bool)
    same = np.ones(max(0, len(number) - 1), dtype=bool)
    for key in (number, own["h1"], own["h2"]):
        same &= key[order][1:] == key[order][:-1]
    again[order[1:]] = same
    blank = own["blank"]
    duplicate = again & ~blank
    truncated = own["cut"] & ~blank & ~duplicate
    beside = number[1:] == number[:-1]
    a, b = own["initial"][:-1], own["initial"][1:]
    legal = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    illegal = np.bincount(number[1:][beside & ~legal], minlength=many)
    known = ~own["no_turn"]
    turn, at = own["turn"][known], number[known]
    fresh = np.ones(len(turn), dtype=bool)
    fresh[1:] = (turn[1:] != turn[:-1]) | (at[1:] != at[:-1])
    distinct = np.bincount(at[fresh], minlength=many)
    gaps = np.zeros(many, dtype=np.int64)
    if len(at):
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        ends = np.append(begins[1:], len(at)) - 1
        gaps[at[begins]] = turn[ends] - turn[begins] + 1 - distinct[at[begins]]
    cost, audit = repaired(lengths, starts, own["initial"].astype(np.int64), blank | duplicate, truncated)
    return {"gaps": gaps, "blank": per(blank), "duplicate": per(duplicate), "truncated": per(truncated), "illegal": illegal, "cost": cost, "audit": audit}


def flat(table: pa.Table) -> dict[str, np.ndarray]:
    out = {c: table.column(c).to_numpy() for c in ("h1", "h2", "initial", "blank", "cut", "gone")}
    out["no_turn"] = table.column("turn").is_null().to_numpy()
    out["turn"] = table.column("turn").fill_null(0).to_numpy().astype(np.int64)
    return out


def begins(keys: pa.ChunkedArray) -> np.ndarray:
    """Where a new conversation begins in sorted keys (null is one)."""
    codes = keys.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First stream: a row for each conversation, without its hash."""
    waiting: list[pa.RecordBatch] = []

    def told(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        made = figures(flat(table), first)
        columns = [table.column("conv_id").take(pa.array(first)).combine_chunks()] + [pa.array(made[c], type=pa.int64()) for c in COUNTS] + [pa.array(made["audit"])]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *COUNTS, "audit"])

    due = BATCH_ROWS
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < due:
            continue
        table = pa.Table.from_batches(waiting)
        first = begins(table.column("conv_id"))
        last = int(first[-1])  # it may go on
        if last:
            yield told(table.slice(0, last), first[:-1])
        waiting = table.slice(last).combine_chunks().to_batches()
        due = max(BATCH_ROWS, 2 * (table.num_rows - last))
    table = pa.Table.from_batches(waiting) if waiting else None
    if table is not None and table.num_rows:
        yield told(table, begins(table.column("conv_id")))


class Fold:
    """A conversation's hash as its rows pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.any, self.sha = audit, 0, 0, False, hashlib.sha256()

    def say(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def put(self, text: str = "") -> None:
        self.state = int(PUT[self.state])
        self.say(PUT_ROLE[self.state], text)

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put()
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = int(KEPT[self.state]["sua".find(role[:1]) if role[:1] else 3])
            self.say(role, text)
        elif letter == "R":
            self.put(text)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second stream: each conversation's audit comes before its rows; its hash follows from both."""
    held, fold = None, None
    for whole in batches:
        done: list[tuple[dict, str]] = []
        for batch in slices(whole, "text"):
            for row in batch.select(["conv_id", *COUNTS, "audit", "role", "text"]).to_pylist():
                if row["audit"] is not None:
                    if fold:
                        done.append((held, fold.digest()))
                    held, fold = row, Fold(row["audit"])
                else:
                    fold.row(row["role"], row["text"])
        if done:
            yield finished(done, whole)
    if fold:
        yield finished([(held, fold.digest())], whole)


def finished(done: list[tuple[dict, str]], like: pa.RecordBatch) -> pa.RecordBatch:
    names = ["conv_id", *COUNTS, "audit"]
    columns = [pa.array([r[c] for r, _ in done], type=like.schema.field(c).type) for c in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in done])], names=[*names, "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    rows: conv_id, turn (any whole number), role and text (not null), gone (true: not there, but its
    conversation is). Rows count by turn, nulls first; ties by role, then by
    the text's first HEAD characters, then by a hash. A null conv_id is a conversation of its own. A conversation without rows: zeros, no edits,
    the hash of nothing. Empty table: no rows. Other columns are not read.

    audit: a letter for each row and each turn put in: Keep, Rerole to what is due (user or
    assistant), Delete (a must for blank and duplicate rows), Insert. Roles in the end begin with
    s?(ua)+, or there are none. A conversation's rows pass through one task, as its hash needs them
    in order; of their texts only a batch is in memory.
    """
    prepare(rows.sparkSession)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    key = rows.schema["conv_id"].dataType.simpleString()
    edits = store(sorted_stream(marks(rows)).mapInArrow(audits, f"conv_id {key}, {counts}, audit string"), "edits").df
    said = rows.where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", *hashes())
    both = edits.select("*", F.lit(0).alias("kind")).unionByName(said, allowMissingColumns=True)
    return sorted_stream(both, "kind").mapInArrow(digests, f"conv_id {key}, {counts}, audit string, repaired_sha256 string")
