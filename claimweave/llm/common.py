"""What the operators share: words, Arrow batches, columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are worked off in slices of about so many bytes, whatever an Arrow batch holds.
SLICE_BYTES = 4 << 20


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece holds much over SLICE_BYTES of text (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    if column.nbytes <= SLICE_BYTES or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), text)
    yield from slices(batch.slice(half), text)


def map_text(df: DataFrame, keep: list[str], added: list[tuple[str, str]], start: Callable[[], Callable], text: str = "text") -> DataFrame:
    """Add columns computed from the text: one Arrow pass, no shuffle.

    start() runs once a task and gives work(list of UTF-8 texts, batch) -> list of column values.
    The columns in keep pass through; those in added ((name, type)) follow.
    """
    fields = [df.schema[k] for k in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in added]
    schema = T.StructType(fields)
    source = df.select(*dict.fromkeys([*keep, text]))
    names = [f.name for f in fields]

    def run(batches):
        work = start()
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields[len(keep) :]]
        for whole in batches:
            for batch in slices(whole, text):
                columns = work(as_bytes(batch.column(batch.schema.get_field_index(text))), batch)
                made = [c if isinstance(c, pa.Array) and c.type == k else pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + made, names=names)

    return source.mapInArrow(run, schema)


def map_rows(df: DataFrame, source: list[str], schema: str, start: Callable[[], Callable], text: str = "text") -> DataFrame:
    """As map_text, but work(...) gives whole record batches of any number of rows."""

    def run(batches):
        work = start()
        for whole in batches:
            for batch in slices(whole, text):
                yield from work(batch)
        done = getattr(work, "done", None)
        if done:
            yield from done()

    return df.select(*dict.fromkeys([*source, text])).mapInArrow(run, schema)


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns that clash with names renamed, and the way back to df's own columns."""
    taken = {n.lower() for n in names}
    moved = {c: f"_own_{i}" for i, c in enumerate(df.columns) if c.lower() in taken}
    aside = df.withColumnsRenamed(moved) if moved else df
    return aside, lambda out: out.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns])


def holds_map(kind: T.DataType) -> bool:
    """Whether values of a type hold a map (or a variant), which can't be hashed or compared."""
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def hashable(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of df (but some), those that can't be hashed as JSON."""
    kept = [f for f in df.schema.fields if f.name not in but]
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if holds_map(f.dataType) else F.col(f"`{f.name}`") for f in kept]


def row_key(columns: list[Column], seed: int = 1) -> Column:
    """128 bits of hash that stand for a row of these values: 32 hex digits."""
    digits = [F.lpad(F.hex(F.xxhash64(F.lit(k), *columns)), 16, "0") for k in (seed, seed + 1000)]
    return F.concat(*digits)
