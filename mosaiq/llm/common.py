"""What the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.tables import shared_dir, table, written

__all__ = ["WS", "as_bytes", "shared_dir", "slices", "table", "text_or_empty", "unwrapped", "wrapped", "written"]

#: The characters that separate words: space and \\t \\n \\v \\f \\r, also what bytes.split() splits at.
WS = " \t\n\x0b\x0c\r"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """Columns of these names beside all of docs as one struct, `row`: no name of docs can clash with a working column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)


def unwrapped(found: DataFrame, columns: list[str], results: dict[str, Column]) -> DataFrame:
    """The columns of the struct `row`, results in the place of those of their names, and then the other results."""
    # first by themselves, so that none takes a column of docs for a working column
    both = found.select("row", F.struct(*[x.alias(c) for c, x in results.items()]).alias("results"))
    return both.select(*[F.col("results" if c in results else "row")[c].alias(c) for c in columns], *[F.col("results")[c].alias(c) for c in results if c not in columns])


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the column's bytes would exceed the limit (one long row may)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > limit and i > at:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)
    # workers outlive tasks: what Arrow holds in reserve goes back
    pa.default_memory_pool().release_unused()


def as_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in array.cast(pa.binary() if pa.types.is_string(array.type) else pa.large_binary()).to_pylist()]
