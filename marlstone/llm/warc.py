"""Write web archives with an index, and read selected records by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import io
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import broadcast_within, keep, utf8

INDEX = (
    "page_id string, url string, digest string, record_type string, payload_bytes long,"
    " archive string, offset long, length long"
)
RECORD = (
    "record_id string, record_type string, url string, digest string, refers_to string,"
    " payload_bytes long, payload binary, intact boolean"
)
_EPOCH = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    """A header value; line breaks would end it."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _restored(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(page_id: str, url: str, payload: bytes, refers_to: str | None) -> tuple[bytes, str]:
    """A gzip member with one WARC record, and its payload digest."""
    digest = payload_digest(payload)
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{_one_line(page_id)}>",
        f"WARC-Date: {_EPOCH}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    body = payload
    if kind == "revisit":
        head += [
            f"WARC-Refers-To: <urn:page:{_one_line(refers_to)}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush(), digest


def parse_record(member: bytes) -> dict:
    """The record of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(
        line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    )
    name = lambda key: _restored(fields[key][len("<urn:page:") : -1]) if key in fields else None
    payload = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    return {
        "record_id": name("WARC-Record-ID"),
        "record_type": fields["WARC-Type"],
        "url": _restored(fields["WARC-Target-URI"]),
        "digest": digest,
        "refers_to": name("WARC-Refers-To"),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload": payload if response else None,
        "intact": payload_digest(payload) == digest if response else True,
    }


def write_archives(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    archive_bytes: int = 1 << 30,
    id: str = "page_id",
    url: str = "url",
    payload: str = "html",
) -> DataFrame:
    """Write one WARC record per page below ``folder``; returns the index, kept as a table.

    The index has the page id (as text), url, payload digest, record type,
    payload size, archive, offset and length. Of pages with equal payloads of at
    least ``min_bytes`` the one with the smallest id (nulls last) is a response,
    and the others are revisit records that refer to it; pages below that size
    are all responses, and so are rows that repeat the smallest id.

    A null payload is empty, a null url is "", a null id is the text "null" in
    the archive. An empty table gives an empty index. Other columns are ignored.

    Records are gzip members of archives of about ``archive_bytes``. A task
    writes archives under names of its own, and only finished tasks get into
    the index, so files of lost or repeated tasks are never read. Which pages
    repeat a payload is found by digests alone; payloads move only if those
    pages are too many to broadcast, and then once, by page.
    """
    content = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(id).alias("id"),
        F.col(url).alias("url"),
        content.cast("binary").alias("payload"),
        F.unhex(F.sha2(content, 256)).alias("same"),
    )
    narrow = keep(
        rows.where(F.octet_length("payload") >= min_bytes).select("id", "same")
    )
    first = narrow.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = keep(
        narrow.join(first, "same")
        .where(~F.col("id").eqNullSafe(F.col("first")))
        .groupBy("id", "same")
        .agg(F.first("first").alias("first"))
    )
    marked = rows.alias("r").join(
        broadcast_within(repeats, 200_000).alias("m"),
        F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.same") == F.col("m.same")),
        "left",
    ).select(
        F.coalesce(F.col("r.id").cast("string"), F.lit("null")).alias("page_id"),
        F.coalesce(F.col("r.url"), F.lit("")).alias("url"),
        "payload",
        F.col("first").cast("string").alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, place = FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        sink = name = None
        offset = 0
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]
            for page_id, link, body, refers_to in zip(*columns):
                if sink is None:
                    name, offset = f"{place}/part-{os.urandom(12).hex()}.warc.gz", 0
                    sink = system.open_output_stream(name, compression=None)
                data, digest = record_bytes(page_id, link, body or b"", refers_to)
                sink.write(data)
                kind = "response" if refers_to is None else "revisit"
                found.append((page_id, link, digest, kind, len(body or b""), os.path.basename(name), offset, len(data)))
                offset += len(data)
                if offset >= archive_bytes:
                    sink.close()
                    sink = None
            if found:
                yield pa.record_batch([pa.array(c) for c in zip(*found)], INDEX_NAMES)
        if sink is not None:
            sink.close()

    return keep(marked.mapInArrow(run, INDEX))


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted (archive, offset, length) as (archive, from, to, row numbers) of one read each."""
    members: list[int] = []
    for i, (archive, offset, length) in enumerate(rows):
        if members and (archive != name or offset - stop > gap or offset + length - begin > most):
            yield name, begin, stop, members
            members = []
        if not members:
            name, begin, stop = archive, offset, offset
        members.append(i)
        stop = max(stop, offset + length)
    if members:
        yield name, begin, stop, members


def read_records(
    index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 4 << 20, task_bytes: int = 32 << 20
) -> DataFrame:
    """The records that rows of ``index`` (any selection of it) stand for.

    Rows are range-sorted by archive and offset into tasks of about
    ``task_bytes``; within a task, records that are at most ``gap`` bytes apart
    are read at once, up to ``most`` bytes. Payloads are checked against their
    digest (``intact``); revisit records have no payload of their own.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_bytes))
    ordered = (
        index.select("archive", "offset", "length")
        .repartitionByRange(tasks, "archive", "offset")
        .sortWithinPartitions("archive", "offset")
    )
    names = [x.strip().split()[0] for x in RECORD.split(",")]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, place = FileSystem.from_uri(folder)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))))
            for archive, begin, stop, members in _ranges(rows, gap, most):
                with system.open_input_file(f"{place}/{archive}") as file:
                    block = file.read_at(stop - begin, begin)
                view = io.BytesIO(block).getbuffer()
                found = [parse_record(view[rows[i][1] - begin : rows[i][1] - begin + rows[i][2]]) for i in members]
                yield pa.record_batch(
                    [pa.array([r[n] for r in found], t) for n, t in zip(names, types)], names
                )

    return ordered.mapInArrow(run, RECORD)
