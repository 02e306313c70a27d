"""Pack token ids into sequences along a space-filling curve."""

from __future__ import annotations

import zlib  # noqa: F401  the queries' tests use the same checksum
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.bpe import encoder
from marlstone.llm.common import give_back, keep, slices, utf8

BUCKETS, DIMENSIONS, BITS = 1024, 4, 12


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows) with ``bits`` bits a dimension.

    Gray-code form of the curve: undo the rotations from the highest bit down,
    then interleave what is left.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents: damped counts of hashed tokens, projected and cut into cells."""
    if len(ids) > 1024:
        return np.concatenate([curve_keys(ids[i : i + 1024]) for i in range(0, len(ids), 1024)])
    counts = np.zeros((len(ids), BUCKETS), np.float32)
    for row, own in zip(counts, ids):
        row[:] = np.bincount((own * np.uint32(2654435761)) >> np.uint32(22), minlength=BUCKETS)
    np.sqrt(counts, out=counts)
    norms = np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1)
    near = (counts / norms) @ _projection()
    # The logistic curve spreads the projections, which are about normal, over the cells.
    cells = (1 / (1 + np.exp(-1.7 * near)) * (1 << BITS)).astype(np.int64)
    return hilbert_key(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, path: str, end_id: int | None, id: str, text: str) -> DataFrame:
    """(id, curve key, ids as little-endian unsigned integers of ``width`` bytes)."""
    kind = docs.schema[id].dataType
    arrow = pa.schema([(id, to_arrow_type(kind)), ("key", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in slices(iter([batch]), text, 1 << 20):
                own = encode.ids([utf8(t) for t in part.column(text).to_pylist()])
                if end_id is not None:
                    own = [np.append(x, np.uint32(end_id)) for x in own]
                small = all(not len(x) or x.max() < 65536 for x in own)
                packed = [x.astype("<u2" if small else "<u4").tobytes() for x in own]
                yield pa.record_batch(
                    [
                        part.column(id),
                        pa.array(curve_keys(own), pa.int64()),
                        pa.array([2 if small else 4] * len(own), pa.int32()),
                        pa.array(packed, pa.binary()),
                    ],
                    schema=arrow,
                )
        give_back()

    return docs.select(id, text).mapInArrow(
        run, f"`{id}` {kind.simpleString()}, key long, width int, ids binary"
    )


def pack_documents(
    docs: DataFrame,
    path: str,
    max_tokens: int = 2048,
    end_id: int | None = 1,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of sequences: id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Documents are ordered along a Hilbert curve through a projection of their
    hashed token counts, so that neighbours in a sequence are alike, and fill
    sequences of ``max_tokens`` one after the other; a document is cut where a
    sequence is full. What is left at the end of a range of the curve becomes
    sequences with power-of-two lengths, so nothing needs padding.

    A null text is an empty one, which has ``end_id`` alone (without it no
    piece). Null or repeated ids are documents of their own. An empty table
    gives no piece. Other columns are ignored.

    Tokens are made once and kept as a table in the shared folder, which the
    range sort samples and reads. A range is a stream: a task holds one batch
    and the open sequence. Copies share a key, and the id spreads them over
    ranges. Sequence ids name the range and count within it.
    """
    kind = docs.schema[id].dataType
    arrow = pa.schema(
        [
            (id, to_arrow_type(kind)),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )
    widest = 1 << (max_tokens.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        done: list[tuple] = []
        opened: list[tuple] = []
        used = made = 0

        def close() -> None:
            nonlocal made
            at = 0
            for name, start, own, total in opened:
                done.append((name, start, len(own), own.astype("<u4").tobytes(), total, base + made, at))
                at += len(own)
            made += 1
            opened.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(arrow)
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            done.clear()
            return out

        for batch in batches:
            names, widths = batch.column(0).to_pylist(), batch.column("width").to_pylist()
            for name, width, packed in zip(names, widths, batch.column("ids")):
                own = np.frombuffer(packed.as_buffer(), f"<u{width}")
                start = 0
                while start < len(own):
                    part = own[start : start + max_tokens - used].copy()
                    opened.append((name, start, part, len(own)))
                    start, used = start + len(part), used + len(part)
                    if used == max_tokens:
                        close()
                        used = 0
                if len(done) >= 512:
                    yield flush()
        rest, size = list(opened), widest
        opened.clear()
        for name, start, own, total in rest:
            while len(own):
                held = sum(len(x[2]) for x in opened)
                while size > used:
                    size >>= 1
                part = own[: size - held]
                opened.append((name, start, part, total))
                start, own = start + len(part), own[len(part) :]
                if held + len(part) == size:
                    close()
                    used -= size
        yield flush()
        give_back()

    tokens = keep(tokenised(docs, path, end_id, id, text))
    ordered = tokens.repartitionByRange("key", id).sortWithinPartitions("key", id, "ids")
    return ordered.select(id, "width", "ids").mapInArrow(
        run,
        f"`{id}` {kind.simpleString()}, start long, length long, ids binary, doc_tokens long,"
        " sequence_id long, offset long",
    )
