"""Benchmark decontamination with a positional inverted index."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.common import give_back, keep, row_key, words
from marlstone.session import bound_batches

# A segment passes through Arrow and Parquet as one row: about 4 MB at this size.
SEGMENT_WORDS = 1 << 19
# Rows so large have a row group each, else Parquet's writer and reader hold a hundred
# of them at a time; and a batch for Python ends as soon as it has so many bytes.
BATCH_BYTES = "4m"
ONE_ROW_GROUPS = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}


def build_index(docs: DataFrame, gap: int, id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Positional postings of the whole corpus, a row per segment of about ``segment_words`` words.

    A segment holds whole documents, with ``gap`` unused positions after each,
    and for each of its terms the sorted positions. Columns: ``ids``, ``k1``,
    ``k2`` (row keys), ``starts`` and ``sizes`` of the documents; ``terms``,
    ``ends`` (of each term's postings), ``postings`` (int32 positions of the
    terms, one after the other).
    """
    kind = docs.schema[id].dataType
    schema = pa.schema(
        [
            ("segment", pa.string()),
            ("ids", pa.list_(to_arrow_type(kind))),
            ("k1", pa.list_(pa.int64())),
            ("k2", pa.list_(pa.int64())),
            ("starts", pa.list_(pa.int64())),
            ("sizes", pa.list_(pa.int64())),
            ("terms", pa.list_(pa.binary())),
            ("ends", pa.list_(pa.int64())),
            ("postings", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_ids: defaultdict[bytes, int] = defaultdict()
        term_ids.default_factory = term_ids.__len__
        heads: list[tuple] = []
        parts: list[np.ndarray] = []
        position = 0

        def segment() -> pa.RecordBatch:
            sizes = np.array([h[4] for h in heads], np.int64)
            starts = np.array([h[3] for h in heads], np.int64)
            numbers = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            places = np.arange(len(numbers)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
            order = np.argsort(numbers, kind="stable")
            ends = np.cumsum(np.bincount(numbers, minlength=len(term_ids)))
            row = [os.urandom(12).hex(), [h[0] for h in heads], [h[1] for h in heads], [h[2] for h in heads], starts, sizes]
            row += [list(term_ids), ends, places[order].astype("<i4").tobytes()]
            out = pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
            heads.clear(), parts.clear(), term_ids.clear()
            return out

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (id, "k1", "k2", text)))
            for name, k1, k2, value in rows:
                own = words(value)
                if heads and position + len(own) > segment_words:
                    yield segment()
                    position = 0
                parts.append(np.fromiter(map(term_ids.__getitem__, own), np.int32, len(own)))
                heads.append((name, k1, k2, position, len(own)))
                position += len(own) + gap
        if heads:
            yield segment()
        del term_ids
        give_back()

    k1, k2 = row_key(F.col(id), F.col(text))
    name = kind.simpleString()
    return docs.select(id, text, k1.alias("k1"), k2.alias("k2")).mapInArrow(
        run,
        f"segment string, ids array<{name}>, k1 array<long>, k2 array<long>, starts array<long>, sizes array<long>,"
        " terms array<binary>, ends array<long>, postings binary",
    )


class Phrases:
    """A block of test items: their distinct windows, and which items have each.

    The words of all items stand one after the other in ``flat`` as numbers of
    terms; window i is the ``lengths[i]`` words from ``starts[i]`` on, and its
    items are ``owners[begins[i]:begins[i + 1]]``, which point into ``names``.
    An item of fewer words than a window is one window, one without words none.
    """

    def __init__(self, items: Iterable[tuple[object, str | None]], size: int):
        self.terms: dict[bytes, int] = {}
        self.names: list = []
        flat, starts, lengths, owners, at = [], [], [], [], 0
        for name, text in items:
            own = words(text)
            if not own:
                continue
            flat.append(np.fromiter((self.terms.setdefault(w, len(self.terms)) for w in own), np.int32, len(own)))
            count = max(len(own) - size, 0) + 1
            starts.append(np.arange(at, at + count))
            lengths.append(np.full(count, min(len(own), size), np.int32))
            owners.append(np.full(count, len(self.names), np.int32))
            self.names.append(name)
            at += len(own)
        empty = np.zeros(0, np.int32)
        self.flat = np.concatenate([empty, *flat])
        starts, lengths, owners = (np.concatenate([empty, *x]).astype(np.int64) for x in (starts, lengths, owners))
        hashes = lengths.astype(np.uint64)
        for j in range(size):
            inside = lengths > j
            term = np.where(inside, self.flat[np.where(inside, starts + j, 0)] if len(self.flat) else 0, -1)
            hashes = (hashes ^ (term.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        # Equal windows stand together; others with an equal hash stay apart.
        order = np.lexsort((owners, hashes))
        starts, lengths, owners, hashes = starts[order], lengths[order], owners[order], hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1])[: len(starts)]
        same = np.flatnonzero(~new)
        differs = lengths[same] != lengths[same - 1]
        for j in range(size):
            inside = np.flatnonzero(~differs & (lengths[same] > j))
            pair = same[inside]
            differs[inside] = self.flat[starts[pair] + j] != self.flat[starts[pair - 1] + j]
        new[same[differs]] = True
        kept = new | np.append(True, owners[1:] != owners[:-1])[: len(starts)]
        self.starts, self.lengths = starts[new], lengths[new].astype(np.int32)
        self.owners = owners[kept].astype(np.int32)
        self.begins = np.append(np.flatnonzero(new[kept]), len(self.owners))

    def __len__(self) -> int:
        return len(self.starts)

    def window(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i] + self.lengths[i]]

    def items(self, i: int) -> list:
        return [self.names[o] for o in self.owners[self.begins[i] : self.begins[i + 1]]]

    def possible(self, counts: np.ndarray) -> np.ndarray:
        """Windows all of whose terms have a count."""
        missing = np.append(0, np.cumsum(counts[self.flat] == 0))
        return np.flatnonzero(missing[self.starts + self.lengths] == missing[self.starts])


class Postings:
    """Positions of a segment's terms by number, and as one sorted list of (term, position)."""

    def __init__(self, lists: list[np.ndarray], counts: np.ndarray):
        self.lists, self.counts = lists, counts
        here = np.flatnonzero(counts)
        self.begins = np.cumsum(counts) - counts
        self.flat = np.concatenate([np.zeros(0, np.int64), *(lists[t] for t in here)])
        # The last one is beyond all terms.
        self.codes = np.append(self.flat + (np.repeat(here, counts[here]) << 32), 1 << 62)

    def first(self, terms: np.ndarray, least: np.ndarray) -> np.ndarray:
        """(term, position) of each term's first place from ``least`` on; that of a later term where it has none."""
        return self.codes[np.searchsorted(self.codes, (terms << 32) + least)]


def rarest_first(
    phrases: Phrases, numbers: np.ndarray, postings: Postings, most: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows with their terms, each one's steps from its rarest term on, and that term's positions.

    About ``most`` positions of several windows at a time: numbers of windows,
    their terms, which of these are inside the window, and the steps; then of
    each position its row in these and itself.
    """
    counts = postings.counts
    for low in range(0, len(numbers), 4096):
        part = numbers[low : low + 4096]
        at = np.arange(phrases.lengths[part].max())
        inside = at < phrases.lengths[part][:, None]
        own = phrases.flat[np.where(inside, phrases.starts[part][:, None] + at, 0)].astype(np.int64)
        order = np.argsort(np.where(inside, counts[own], 1 << 62), axis=1, kind="stable")
        rarest = own[np.arange(len(part)), order[:, 0]]
        ends = np.cumsum(counts[rarest])
        first = 0
        while first < len(part):
            done = ends[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
            sizes = counts[rarest[first:stop]]
            row = np.repeat(np.arange(first, stop), sizes)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield part, own, inside, order, row, postings.flat[postings.begins[rarest[row]] + nth]
            first = stop


def phrase_starts(
    phrases: Phrases, numbers: np.ndarray, postings: list[np.ndarray] | Postings, counts: np.ndarray, most: int = 1 << 19
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of ``numbers``, and positions at which their terms stand one after the other.

    Lists are shifted to the start of the window and intersected from the
    rarest term on, for about ``most`` positions of several windows at a time.
    """
    if not isinstance(postings, Postings):
        postings = Postings(postings, counts)
    for part, own, inside, order, row, found in rarest_first(phrases, numbers, postings, most):
        found = found - order[row, 0]
        for step in range(1, own.shape[1]):
            if not len(found):
                break
            column = order[row, step]
            wanted, term = found + column, own[row, column]
            good = ((postings.first(term, wanted) == (term << 32) + wanted) & (wanted >= 0)) | ~inside[row, column]
            row, found = row[good], found[good]
        yield part[row], found


def near_starts(
    phrases: Phrases, numbers: np.ndarray, postings: Postings, reach: int, most: int = 1 << 19
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of ``numbers``, and first positions of the places of at most 2 ``reach`` + 1 words that have all its terms."""
    for part, own, inside, order, row, found in rarest_first(phrases, numbers, postings, most):
        for row, found in _near(own, inside, order, row, found, postings, reach, max(1, most >> 6)):
            yield part[row], found


def _near(
    own: np.ndarray, inside: np.ndarray, order: np.ndarray, row: np.ndarray, found: np.ndarray,
    postings: Postings, reach: int, most: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and first positions of places, of windows' rows and positions ``found`` of their rarest terms."""
    width, columns = 2 * reach, range(own.shape[1])
    for step in columns[1:]:
        if not len(found):
            return
        column = order[row, step]
        term = own[row, column]
        good = (postings.first(term, found - width) <= (term << 32) + found + width) | ~inside[row, column]
        row, found = row[good], found[good]
    # A place begins with one of the terms, at or before the rarest one in it.
    for at in range(0, len(found), most):
        mine, place = row[at : at + most], found[at : at + most]
        firsts = []
        for column in columns:
            term = own[mine, column] << 32
            low = np.searchsorted(postings.codes, term + place - width)
            sizes = np.searchsorted(postings.codes, term + place, "right") - low
            sizes[~inside[mine, column]] = 0
            nth = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
            firsts.append((np.repeat(mine, sizes) << 32) + postings.flat[nth])
        firsts = np.unique(np.concatenate(firsts))
        mine, place = firsts >> 32, firsts & 0xFFFFFFFF
        for column in columns:
            term = own[mine, column]
            good = (postings.first(term, place) <= (term << 32) + place + width) | ~inside[mine, column]
            mine, place = mine[good], place[good]
        yield mine, place


def near_positions(window: np.ndarray, postings: list[np.ndarray], counts: np.ndarray, reach: int) -> np.ndarray:
    """:func:`near_starts` of one window, given as its terms."""
    own = np.asarray(window, np.int64)[None]
    order = np.argsort(counts[own], axis=1, kind="stable")
    found = np.asarray(postings[own[0, order[0, 0]]], np.int64)
    rows = np.zeros(len(found), np.int64)
    parts = _near(own, np.ones(own.shape, bool), order, rows, found, Postings(postings, counts), reach, max(1, len(found)))
    return np.concatenate([found[:0], *(place for _, place in parts)])


def search_segment(row: dict, phrases: Phrases, near: int | None) -> tuple[dict, dict, dict]:
    """Of a segment, by document number: items, items nearby, and ranges of hit words."""
    starts, sizes = np.asarray(row["starts"]), np.asarray(row["sizes"])
    ends = np.asarray(row["ends"])
    flat = np.frombuffer(row["postings"], "<i4").astype(np.int64)
    postings = [flat[:0]] * len(phrases.terms)
    for number, term in enumerate(row["terms"]):
        wanted = phrases.terms.get(term)
        if wanted is not None:
            postings[wanted] = flat[ends[number - 1] if number else 0 : ends[number]]
    counts = np.fromiter(map(len, postings), np.int64, len(postings))
    exact, nearby, ranges = defaultdict(set), defaultdict(set), defaultdict(list)
    length = int(starts[-1] + sizes[-1]) if len(starts) else 0
    hits = np.zeros(length + 1, np.int32)
    document = lambda places: np.searchsorted(starts, places, "right") - 1
    possible = phrases.possible(counts)
    table = Postings(postings, counts)
    for numbers, found in phrase_starts(phrases, possible, table, counts):
        np.add.at(hits, found, 1)
        np.add.at(hits, found + phrases.lengths[numbers], -1)
        pairs = np.unique(np.stack([numbers, document(found)], axis=1), axis=0)
        for number, doc in pairs.tolist():
            exact[doc].update(phrases.items(number))
    for numbers, found in near_starts(phrases, possible, table, near) if near is not None else ():
        pairs = np.unique(np.stack([numbers, document(found)], axis=1), axis=0)
        for number, doc in pairs.tolist():
            nearby[doc].update(phrases.items(number))
    # The unused positions between documents keep every run inside one of them.
    edges = np.diff((np.cumsum(hits) > 0).astype(np.int8), prepend=0)
    begins, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for doc, begin, stop in zip(document(begins).tolist(), begins.tolist(), stops.tolist()):
        ranges[doc].append({"start": begin - int(starts[doc]), "stop": stop - int(starts[doc])})
    return exact, nearby, ranges


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    window: int = 10,
    near: int | None = None,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 32 << 20,
    segment_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """Of each document: id, k1, k2 (row key), ``n_words``, ``n_hit``, ``hits``, ``items``, ``near_items``.

    A window of an item is ``window`` consecutive words of it, or all of a
    shorter item. ``items`` are those with a window that stands in the document
    word for word (a set, as an array); ``hits`` are the ranges of words inside
    such places, from start up to stop, and ``n_hit`` counts these words.
    With ``near`` given, ``near_items`` are those with a window all of whose
    terms stand in one place of at most 2 ``near`` + 1 words, that is within
    ``near`` words of its middle, in any order, whatever else is in the table;
    else it is null.

    Null texts and items have no words; items without words never match.
    Repeated items count by their id, null ids of items are left out of the
    lists. Null and repeated document ids get a row each. An empty table of
    documents gives an empty table, an empty table of items no hit.

    Every word of the corpus gets into an index that is partitioned by
    document and kept in the shared folder, so matching shuffles no posting.
    A task holds about one segment at a time, however many its partition has;
    for this the session's Arrow batches are bounded to BATCH_BYTES from here on.
    Test items go to the tasks by broadcast, in blocks of about ``block_bytes``
    of text (or one item); each block is a pass over the index, and the
    passes' rows are merged by document.
    """
    gap = window + 2 * (near or 0) + 1
    bound_batches(docs.sparkSession, BATCH_BYTES)
    index = keep(build_index(docs, gap, id, text, segment_words), **ONE_ROW_GROUPS)
    kind, item_kind = docs.schema[id].dataType, tests.schema[item].dataType
    names = tests.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    total = names.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    item_list = pa.list_(to_arrow_type(item_kind))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema(
        [("segment", pa.string()), ("number", pa.int64()), (id, to_arrow_type(kind)), ("k1", pa.int64())]
        + [("k2", pa.int64()), ("n_words", pa.int64()), ("hits", span), ("items", item_list), ("near_items", item_list)]
    )
    of_item = item_kind.simpleString()
    spark_schema = (
        f"segment string, number long, `{id}` {kind.simpleString()}, k1 long, k2 long, n_words long,"
        f" hits array<struct<start:long,stop:long>>, items array<{of_item}>, near_items array<{of_item}>"
    )
    passes = []
    for block in range(blocks):
        mine = names.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else names
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(map(tuple, mine.toLocalIterator()), window))

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n != "postings"}
                    row["postings"] = batch.column("postings")[i].as_buffer()
                    exact, nearby, ranges = search_segment(row, phrases.value, near)
                    known = lambda by, d: sorted(x for x in by[d] if x is not None) if d in by else []
                    here = range(len(row["sizes"]))
                    columns = [[row["segment"]] * len(here), here, row["ids"], row["k1"], row["k2"], row["sizes"]]
                    columns.append([ranges.get(d, []) for d in here])
                    columns.append([known(exact, d) for d in here])
                    columns.append([known(nearby, d) if near is not None else None for d in here])
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            give_back()

        found = index.mapInArrow(run, spark_schema)
        if blocks > 1:  # one block of phrases at a time
            found = keep(found)
            phrases.destroy()
        passes.append(found)
    found = passes[0]
    if blocks > 1:
        found = (
            reduce(DataFrame.unionByName, passes)
            .groupBy("segment", "number")
            .agg(
                *[F.first(c).alias(c) for c in (id, "k1", "k2", "n_words")],
                F.flatten(F.collect_list("hits")).alias("hits"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
            )
        )
        # Ranges of several blocks may overlap.
        found = found.withColumn("hits", F.sort_array("hits"))
    far = F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("words"))
    n_hit = F.aggregate(
        "hits",
        far,
        lambda a, r: F.struct(
            F.greatest(a["stop"], r["stop"]).alias("stop"),
            (a["words"] + F.greatest(F.lit(0).cast("long"), r["stop"] - F.greatest(a["stop"], r["start"]))).alias("words"),
        ),
    )["words"]
    near_list = F.col("near_items") if near is not None else F.lit(None).cast(f"array<{of_item}>")
    return found.select(id, "k1", "k2", "n_words", n_hit.alias("n_hit"), "hits", "items", near_list.alias("near_items"))
