"""Personal data in texts, and the terms around it that give it away."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.common import broadcast_within, keep, row_key, words

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where its run of digits begins: from a later digit it fails in the same place.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of e-mail addresses, IP addresses, card and phone numbers, in order."""
    found = []
    floor = at = 0
    while (at := text.find("@", at)) >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        floor = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, 0, m.end()))
            floor = m.end()
        at = max(at + 1, floor)
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(own := _digits(m[0])) <= 19 and _luhn(own):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def free_terms(text: str, spans: list[tuple[int, int, int]], min_chars: int) -> list[tuple[int, int]]:
    """(start, end) of the terms that touch no base span."""
    begins, stops = [], []
    for start, _, end in spans:
        if stops and start <= stops[-1]:
            stops[-1] = max(stops[-1], end)
        else:
            begins.append(start)
            stops.append(end)
    out = []
    for m in _TERM.finditer(text):
        s, e = m.span()
        i = bisect_left(begins, e) - 1
        if e - s >= min_chars and (i < 0 or stops[i] <= s):
            out.append((s, e))
    return out


def contexts(text: str, spans: list[tuple[int, int, int]], reach: int | None, min_chars: int) -> list[tuple[list, list]]:
    """(entities, terms) that occur together, each pair of them once: in the text, or within ``reach`` terms.

    Entities and terms are named by 64-bit hashes of their normal form.
    """
    if not spans:
        return []
    named = []
    for start, kind, end in spans:
        value = text[start:end].lower() if kind == 0 else _digits(text[start:end]) if kind else text[start:end]
        named.append((_number(f"{kind}:{value}".encode()), start, end))
    free = free_terms(text, spans, min_chars)
    if reach is None:
        return [(sorted({n[0] for n in named}), sorted({_number(w) for w in {words(text[s:e])[0] for s, e in free}}))]
    starts = [m.start() for m in _TERM.finditer(text)]
    free_at = dict(free)
    found: dict[int, set] = {}
    for entity, start, end in named:
        left, right = bisect_left(starts, start), bisect_left(starts, end)
        for s in [*starts[max(0, left - reach) : left], *starts[right : right + reach]]:
            if s in free_at:
                found.setdefault(entity, set()).add(_number(words(text[s : free_at[s]])[0]))
        found.setdefault(entity, set())
    return [([entity], sorted(terms)) for entity, terms in found.items()]


def _scan(docs: DataFrame, text: str, reach: int | None, min_chars: int) -> DataFrame:
    """(entities, terms): a row for each part of a text in which all of them occur together."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for t in batch.column(text).to_pylist() for c in contexts(t or "", base_spans(t or ""), reach, min_chars)]
            yield pa.record_batch([pa.array([c[i] for c in found], longs) for i in (0, 1)], ["entities", "terms"])

    return docs.select(text).mapInArrow(run, "entities array<long>, terms array<long>")


def _mark(docs: DataFrame, terms: DataFrame, id: str, text: str, min_chars: int, most: int) -> DataFrame:
    """(id, k1, k2, spans): base spans, and every occurrence of ``terms`` outside of them.

    Up to ``most`` terms go to the tasks by broadcast; more meet the words of the
    texts in a join, and come back as a list for each text.
    """
    kind = docs.schema[id].dataType
    span = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32())])
    k1, k2 = row_key(F.col(id), F.col(text))
    texts = docs.select(id, text, k1.alias("k1"), k2.alias("k2"))
    shared = None
    if terms.limit(most + 1).count() <= most:
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms.toArrow().column("term").to_pylist()))
        texts = texts.withColumn("own", F.lit(None).cast("array<long>"))
    else:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [sorted({_number(w) for w in set(words(t))}) for t in batch.column(text).to_pylist()]
                yield pa.record_batch([batch.column("k1"), batch.column("k2"), pa.array(own, pa.list_(pa.int64()))], ["k1", "k2", "own"])

        each = texts.select(text, "k1", "k2").mapInArrow(split, "k1 long, k2 long, own array<long>")
        each = each.select("k1", "k2", F.explode("own").alias("term")).join(terms, "term", "left_semi")
        texts = texts.join(each.groupBy("k1", "k2").agg(F.collect_set("term").alias("own")), ["k1", "k2"], "left")
        texts = texts.select(id, text, "k1", "k2", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for t, own in zip(batch.column(text).to_pylist(), batch.column("own").to_pylist()):
                t = t or ""
                wanted = shared.value if shared is not None else frozenset(own or ())
                spans = base_spans(t)
                if wanted:
                    marked = set()
                    for w in set(words(t)):
                        if (n := known.get(w)) is None:
                            if len(known) > 200_000:
                                known.clear()
                            n = known[w] = _number(w)
                        if n in wanted:
                            marked.add(w)
                    if marked:
                        extra = [(s, KINDS.index("term"), e) for s, e in free_terms(t, spans, min_chars) if words(t[s:e])[0] in marked]
                        spans = sorted(spans + extra)
                out.append([{"start": s, "rank": k, "stop": e} for s, k, e in spans])
            yield pa.record_batch(
                [batch.column(id), batch.column("k1"), batch.column("k2"), pa.array(out, pa.list_(span))],
                [id, "k1", "k2", "spans"],
            )

    return texts.mapInArrow(
        run, f"`{id}` {kind.simpleString()}, k1 long, k2 long, spans array<struct<start:int,rank:int,stop:int>>"
    )


def document_frequencies(docs: DataFrame, text: str, most: int = 500_000) -> DataFrame:
    """(term, docs): in how many rows each term occurs. Tasks send sums of what they have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch(
                [pa.array([_number(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())],
                ["term", "docs"],
            )
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(text).to_pylist():
                seen.update(set(words(t)))
                if len(seen) > most:
                    yield flush()
        yield flush()

    counted = docs.select(text).mapInArrow(run, "term long, docs long")
    return counted.groupBy("term").agg(F.sum("docs").alias("docs"))


def find_disclosures(
    docs: DataFrame,
    reach: int | None = None,
    threshold: float = 0.8,
    support: int = 2,
    min_chars: int = 3,
    id: str = "doc_id",
    text: str = "text",
    most_terms: int = 1_000_000,
) -> DataFrame:
    """Of each row: its id, ``spans`` (array of start, rank, stop; by start, then rank) and a row key (k1, k2).

    Ranks 0 to 3 are e-mail addresses, IP addresses, card and phone numbers, the
    protected entities; rank 4 are terms that disclose one. With N documents of
    which d(e), d(t) and d(e, t) hold an entity, a term, and both, the term tells
    log(d(e, t) N / (d(e) d(t))) of the entity's information log(N / d(e)). A term
    discloses an entity if it tells at least the share ``threshold`` of it, in at
    least ``support`` documents; then all its occurrences in all documents are
    spans, whether the entity is there or not, but for those inside a protected
    entity. With ``reach`` given, d(e, t) counts only documents with the term
    within that many terms of the entity. Terms are words of ``min_chars`` code
    points or more. Positions are code points, ends exclusive.

    A null text is an empty one, without spans. Null and repeated ids get a row
    each, an empty table none. Other columns are ignored.

    The scan writes the distinct entities and terms of texts with entities to a
    table in the shared folder. Entities in fewer than ``support`` documents
    have no pair and are left out before pairs are made; pairs and frequencies are
    summed in the tasks before they are shuffled. A second pass over the texts
    marks; it gets up to ``most_terms`` terms by broadcast, more by a join.
    """
    rows = keep(_scan(docs, text, reach, min_chars))
    each = rows.select(F.explode("entities").alias("entity"), "terms")
    entities = keep(each.groupBy("entity").agg(F.count("*").alias("own")).where(F.col("own") >= support))
    pairs = (
        each.join(broadcast_within(entities, 300_000), "entity")
        .select("entity", "own", F.explode("terms").alias("term"))
        .groupBy("entity", "term")
        .agg(F.count("*").alias("both"), F.first("own").alias("own"))
        .where(F.col("both") >= support)
    )
    total = float(max(docs.count(), 1))
    information = F.log(F.lit(total) / F.col("own"))
    told = F.log(F.col("both") * total / (F.col("own") * F.col("docs")))
    disclosing = keep(
        pairs.join(document_frequencies(docs, text), "term")
        .where((information > 0) & (told >= threshold * information))
        .select("term")
        .distinct()
    )
    return _mark(docs, disclosing, id, text, min_chars, most_terms)


def sanitise(docs: DataFrame, how: str = "generalise", id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with spans of :func:`find_disclosures` replaced by their kind in brackets, or removed.

    Overlapping spans are replaced as one, named after the first. Other columns
    stay; a null text stays null.
    """
    found = find_disclosures(docs, id=id, text=text, **options).groupBy("k1", "k2").agg(F.first("spans").alias("__spans"))

    @F.udf("string")
    def replaced(value: str | None, spans) -> str | None:
        if value is None or not spans:
            return value
        out, last = [], 0
        for span in spans:
            if span["start"] >= last:
                out += [value[last : span["start"]], f"[{KINDS[span['rank']].upper()}]" if how == "generalise" else ""]
            last = max(last, span["stop"])
        return "".join([*out, value[last:]])

    k1, k2 = row_key(F.col(id), F.col(text))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    joined = docs.select(row, k1.alias("k1"), k2.alias("k2")).join(found.hint("shuffle_hash"), ["k1", "k2"], "left")
    return joined.select(
        *[(replaced(F.col("__row")[c], F.col("__spans")) if c == text else F.col("__row")[c]).alias(c) for c in docs.columns]
    )
