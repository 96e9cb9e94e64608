"""Words of a text, shared by the operators: `[^\\x20\\x09-\\x0D]+` over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Java pattern of what separates words.
GAP = r"[\x20\x09-\x0D]+"


def as_bytes(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The chosen columns and the text as UTF-8 bytes (null: empty), which Python reads without decoding."""
    return docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(text))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words: bytes.split() cuts at exactly the six ASCII spaces, bytes.lower() keeps other letters."""
    return text.lower().split()


def groups_of(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `most_bytes` of one binary column (a longer row stays alone)."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def free(docs: DataFrame, *names: str) -> list[str]:
    """Column names for an operator's own use, underlined until no column of `docs` has them (in any case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while f"_{name}" in taken:
            name = f"_{name}"
        out.append(f"_{name}")
        taken.add(f"_{name}")
    return out
