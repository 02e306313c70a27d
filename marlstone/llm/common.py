"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import keep, shared_dir  # noqa: F401  for the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = " \t\n\x0b\x0c\r"

# A-Z to a-z, and every ASCII byte that is neither a letter nor a digit to a
# space. UTF-8 bytes from 0x80 up stay, so all other characters count as letters.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text, none for null."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII characters."""
    return utf8(text).translate(WORD_BYTES).split()


def row_key(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that name a row by its content, never null."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(7919), *columns)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


def give_back() -> None:
    """Return memory that Python, Arrow and the C library hold for later use.

    Spark hands a worker on to the next stages; what a stage took would stay
    with it while others need the executor's memory.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def broadcast_within(frame: DataFrame, rows: int) -> DataFrame:
    """``frame`` with a broadcast hint if it has at most ``rows`` rows, else with a shuffle hint.

    Only for frames with narrow rows of a fixed width that are cheap to count
    (tables in the shared folder). Both ways give the same join.
    """
    if frame.limit(rows + 1).count() <= rows:
        return frame.hint("broadcast")
    return frame.hint("shuffle_hash")


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "_", text)
