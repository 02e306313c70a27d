"""Prediction by partial matching: byte contexts with escapes and exclusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.common import LOWER_BYTES, give_back, keep, row_key, slices, utf8

ORDER = 5
END = 0xFF  # ends every text and stands before it; no UTF-8 text has this byte
_SPREAD = np.uint64(0x9E3779B1)  # times 16 bits it stays within a signed long
END_WORD = np.uint64(0x5EED5EED5EED5EED)
# Texts are worked on by arrays of up to 30 times their bytes.
SLICE_BYTES = 2 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32, END]] = True


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts in one array, each after ORDER end bytes and before one, and where each begins."""
    parts = [utf8(t).translate(LOWER_BYTES) for t in texts]
    pad = bytes([END]) * ORDER
    data = np.frombuffer(b"".join(pad + p + b"\xff" for p in parts), np.uint8)
    sizes = np.array([ORDER + len(p) + 1 for p in parts], np.int64)
    return data, np.cumsum(sizes) - sizes


def gram_keys(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each coded byte with its ORDER bytes before, as one number; and where each text's begin."""
    wide = data.astype(np.uint64)
    n = len(data) - ORDER
    keys = wide[:n].copy()
    for j in range(1, ORDER + 1):
        keys <<= np.uint64(8)
        keys |= wide[j : j + n]
    # Keys that end in a text's leading end bytes are none of its own.
    own = np.ones(n, bool)
    for j in range(1, ORDER + 1):
        at = begins[1:] - j
        own[at[at >= 0]] = False
    stops = np.append(begins[1:], len(data))
    sizes = stops - begins - ORDER
    return keys[own], np.cumsum(sizes) - sizes


class WordHashes:
    """64-bit hashes of the words of joined texts, by array operations."""

    def __init__(self):
        rng = np.random.default_rng(977)
        self.mix = rng.integers(0, 2**64, 256, np.uint64)
        self.base = 0x9E3779B97F4A7C15
        self.powers = self.inverse = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and the number of the text that each is in."""
        n = len(data)
        if len(self.powers) < n:
            size = max(n, 1 << 20)
            powers, inverse = np.full(size, self.base, np.uint64), np.full(size, pow(self.base, -1, 2**64), np.uint64)
            powers[0] = inverse[0] = 1
            self.powers, self.inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
        white = _WHITE[data]
        before = np.empty_like(white)
        before[0], before[1:] = True, white[:-1]
        starts, ends = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.mix[data] * self.powers[:n], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.inverse[starts] ^ (ends - starts).astype(np.uint64)
        return found, np.searchsorted(begins, starts, "right") - 1


def _sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(keys)
    return distinct, np.bincount(codes, minlength=len(distinct))


class _Collected:
    """Sums by key of what a task has seen, handed out when they get many."""

    def __init__(self, kind: int, most: int = 2_000_000):
        self.kind, self.most = kind, most
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts))
        self.rows += len(keys)
        if self.rows > self.most:
            keys, counts = self.merged()
            self.parts, self.rows = [(keys, counts)], len(keys)
            if self.rows > self.most // 2:
                yield from self.out()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        codes, keys = pd.factorize(np.concatenate([k for k, _ in self.parts]))
        counts = np.concatenate([c for _, c in self.parts])
        return keys, np.bincount(codes, counts, len(keys)).astype(np.int64)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, counts = self.merged()
            self.parts, self.rows = [], 0
            for at in range(0, len(keys), 100_000):
                k, c = keys[at : at + 100_000], counts[at : at + 100_000]
                kinds = np.full(len(k), self.kind, np.int32)
                yield pa.record_batch([pa.array(kinds), pa.array(k.view(np.int64)), pa.array(c)], ["kind", "key", "n"])


def _train(docs: DataFrame, text: str) -> DataFrame:
    """(kind, key, n): counts of grams (kind 0) and words (kind 1) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, hashes = _Collected(0), _Collected(1), WordHashes()
        for part in slices(batches, text, SLICE_BYTES):
            data, begins = _joined(part.column(text).to_pylist())
            yield from grams.add(*_sums(gram_keys(data, begins)[0]))
            yield from words.add(*_sums(hashes(data, begins)[0]))
            yield from words.add(np.array([END_WORD]), np.array([len(begins)]))
        yield from grams.out()
        yield from words.out()
        del grams, words, hashes
        give_back()

    counted = docs.select(text).mapInArrow(run, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table (0 where absent), and which are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _level(keys: np.ndarray, n: np.ndarray, order: int) -> dict:
    """Contexts of an order: sorted grams and their counts, sums by context, where each context's grams begin."""
    keys = keys & np.uint64((1 << 8 * (order + 1)) - 1)
    by = np.argsort(keys)
    keys, n = keys[by], n[by].astype(float)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    keys, n = keys[first], np.add.reduceat(n, first) if len(first) else np.zeros(0)
    contexts = keys >> np.uint64(8)
    first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])[: len(keys)])
    total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
    distinct = np.diff(np.append(first, len(keys))).astype(float)
    return {"keys": keys, "n": n, "contexts": contexts[first], "total": total, "distinct": distinct, "first": first}


class Trie:
    """Context counts of all orders, flattened to sorted arrays; answers log10 P(byte | context).

    At a context with T coded bytes, D of them distinct, a byte seen n times
    has the chance n / (T + D), an escape D / (T + D); after an escape the
    bytes of the longer context are left out of the shorter one's counts. Which
    bytes these are depends on the longer context alone, so it stores what is
    left at the next shorter one. Below order 0, bytes not yet left out are
    equally likely.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray):
        """``grams`` of the full order, sorted; ``pairs`` of order 1 of the whole corpus."""
        self.levels: list[dict] = [{} for _ in range(ORDER + 1)]
        lower: dict = {}
        for order in range(ORDER + 1):
            keys, n = (grams, counts) if order >= 2 else (pairs, pair_counts)
            own = _level(keys, n, order)
            level = {c: own[c] for c in ("contexts", "total", "distinct")}
            if order:
                at, _ = _find(lower["keys"], own["keys"] & np.uint64((1 << 8 * order) - 1))
                out = np.add.reduceat(lower["n"][at], own["first"]) if len(own["first"]) else np.zeros(0)
                up, _ = _find(lower["contexts"], own["contexts"] & np.uint64((1 << 8 * (order - 1)) - 1))
                left = lower["distinct"][up] - own["distinct"] if len(up) else np.zeros(0)
                level["next"] = (lower["total"][up] - out if len(up) else np.zeros(0)) + left
                level["next_escape"] = left
            # A byte is found by the number of its context and itself.
            place = np.repeat(np.arange(len(own["first"])), own["distinct"].astype(np.int64))
            children = (place << 8) + (own["keys"] & np.uint64(0xFF)).astype(np.int64)
            self.levels[order] = {c: v if c == "contexts" else _narrow(v) for c, v in level.items()}
            self.levels[order] |= {"children": _narrow(children), "n": _narrow(own["n"])}
            lower = own
        self.unseen = 256 - (int(self.levels[0]["distinct"][0]) if len(self.levels[0]["distinct"]) else 0)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 P of each gram's last byte after the others."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        room, escape = np.zeros(len(keys)), np.zeros(len(keys))
        begun = np.zeros(len(keys), bool)
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            own = keys[todo] & np.uint64((1 << 8 * (order + 1)) - 1)
            context, seen = _find(level["contexts"], own >> np.uint64(8))
            codes = (context << 8) + (own & np.uint64(0xFF)).astype(np.int64)
            at, hit = _find(level["children"], codes.astype(level["children"].dtype))
            hit &= seen
            fresh = seen & ~begun[todo]
            room[todo[fresh]] = level["total"][context[fresh]].astype(float) + level["distinct"][context[fresh]]
            escape[todo[fresh]] = level["distinct"][context[fresh]]
            done = todo[hit]
            out[done] += np.log10(level["n"][at[hit]].astype(float)) - np.log10(room[done])
            # Where nothing is left at a context, leaving it is certain.
            gone = ~hit & seen & (room[todo] > 0)
            out[todo[gone]] += np.log10(escape[todo[gone]]) - np.log10(room[todo[gone]])
            begun[todo[seen]] = True
            if order:
                room[todo[seen]] = level["next"][context[seen]]
                escape[todo[seen]] = level["next_escape"][context[seen]]
            todo = todo[~hit]
        out[todo] -= np.log10(self.unseen) if self.unseen else 0
        return out


class Model:
    """One shard: counts of its words, and the contexts of its grams."""

    def __init__(self, shard: int, shards: int, words, word_counts, grams, gram_counts, pairs, pair_counts, tokens, vocabulary):
        self.shard, self.shards = shard, shards
        self.words, self.word_counts = words, word_counts
        self.trie = Trie(grams, gram_counts, pairs, pair_counts)
        self.tokens, self.vocabulary = tokens, vocabulary


def score(models: list[Model], texts: list[str | None], hashes: WordHashes) -> list[np.ndarray]:
    """Of each text: tokens, known tokens, base score, score; words and bytes of the models' shards only."""
    data, begins = _joined(texts)
    n, shards = len(texts), models[0].shards
    found, of = hashes(data, begins)
    found, of = np.append(found, np.repeat(END_WORD, n)), np.append(of, np.arange(n))
    codes, distinct = pd.factorize(found)
    shard = shard_of(distinct, False, shards)
    here, known, counts = np.zeros(len(distinct)), np.zeros(len(distinct)), np.zeros(len(distinct))
    for model in models:
        own = np.flatnonzero(shard == model.shard)
        at, there = _find(model.words, distinct[own])
        here[own], known[own] = 1, there
        counts[own[there]] = model.word_counts[at[there]]
    logs = here * np.log10((counts + 1) / (models[0].tokens + models[0].vocabulary + 1))
    sums = lambda values: np.bincount(of, values[codes], n)
    keys, firsts = gram_keys(data, begins)
    codes_, distinct_ = pd.factorize(keys)
    del keys
    shard = shard_of(distinct_, True, shards)
    scores = np.zeros(len(distinct_))
    for model in models:
        own = np.flatnonzero(shard == model.shard)
        scores[own] = model.trie.logs(distinct_[own])
    total = np.add.reduceat(scores[codes_], firsts) if n else np.zeros(0)
    return [sums(here), sums(known), sums(logs), total]


def shard_of(keys: np.ndarray, grams: bool, shards: int) -> np.ndarray:
    """Grams go by the two bytes before the last, which all orders from 2 on share."""
    if shards == 1:
        return np.zeros(len(keys), np.int64)
    part = ((keys >> np.uint64(8)) & np.uint64(0xFFFF)) * _SPREAD >> np.uint64(16) if grams else keys >> np.uint64(33)
    return (part % np.uint64(shards)).astype(np.int64)


def _shard_column(grams: bool, shards: int) -> Column:
    """:func:`shard_of` as a column expression of ``key``."""
    key = F.col("key")
    if grams:
        part = F.shiftrightunsigned(F.shiftrightunsigned(key, 8).bitwiseAND(0xFFFF) * F.lit(int(_SPREAD)), 16)
    else:
        part = F.shiftrightunsigned(key, 33)
    return part % shards


def _shards(counts: DataFrame, entries: int) -> Iterator[Model]:
    """The model in parts of about ``entries`` words and grams each."""
    sizes = {r["kind"]: r for r in counts.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    rows = lambda kind: sizes[kind]["rows"] if kind in sizes else 0
    tokens = sizes[1]["n"] if 1 in sizes else 0
    shards = max(1, -(-max(rows(0), rows(1)) // entries))
    low = (
        counts.where("kind = 0").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    )
    pairs, pair_counts = (np.array(low.column(c)) for c in ("key", "n"))
    for shard in range(shards):
        mine = counts
        if shards > 1:
            mine = mine.where(F.when(F.col("kind") == 0, _shard_column(True, shards)).otherwise(_shard_column(False, shards)) == shard)
        table = mine.toArrow()
        kinds, every, sums = (np.array(table.column(c)) for c in ("kind", "key", "n"))
        part = {}
        for kind in (0, 1):
            keys, n = every[kinds == kind].view(np.uint64), sums[kinds == kind]
            order = np.argsort(keys)
            part[kind] = keys[order], _narrow(n[order])
        del table, kinds, every, sums
        yield Model(shard, shards, *part[1], *part[0], pairs.astype(np.uint64), pair_counts, tokens, rows(1))


def code_lengths(
    docs: DataFrame,
    train: Column | None = None,
    max_entries: int = 8_000_000,
    id: str = "doc_id",
    text: str = "text",
    shard_entries: int = 1_000_000,
) -> DataFrame:
    """Of each row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from all rows for which ``train`` holds (all rows without
    it; a null counts as true) and ``held_out`` names the others. ``score`` is
    log10 of the probability that a byte model of order 5 gives the A-Z
    lower-cased text and its end; ``base_score`` the same of a word model with
    add-one smoothing, of which ``n_tokens``, ``n_known`` and ``train_tokens``
    count words and ends. Words are told apart by 64-bit hashes.

    A null text is an empty one, and has its end alone. Null and repeated ids
    get a row each. An empty table gives an empty table, and without training
    rows all bytes are equally likely. Other columns are ignored.

    Counts of all training texts merge in the tasks, then by a shuffle, to a
    table in the shared folder. The tables go to the tasks by broadcast, in
    shards of about ``shard_entries`` rows, so that the driver holds one such
    shard at a time. Whatever the size of the corpus, a pass over the texts has
    shards of about ``max_entries`` rows in all and scores the bytes and words
    that are theirs; the parts of a text are added up.
    """
    held = ~F.coalesce(train, F.lit(True)) if train is not None else F.lit(False)
    k1, k2 = row_key(F.col(id), F.col(text))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), held.alias("held_out"), k1.alias("k1"), k2.alias("k2"))
    counts = keep(_train(rows.where(~F.col("held_out")), "text"))
    kind = docs.schema[id].dataType
    names = ["id", "held_out", "k1", "k2", "n_tokens", "n_known", "base_score", "score"]
    arrow = [to_arrow_type(kind), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, arrow)))
    passes = []
    group: list = []
    each = max(1, max_entries // shard_entries)
    for model in _shards(counts, min(shard_entries, max_entries)):
        group.append(docs.sparkSession.sparkContext.broadcast(model))
        shard, shards, tokens = model.shard, model.shards, model.tokens
        del model
        if len(group) < each and shard < shards - 1:
            continue

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for part in slices(batches, "text", SLICE_BYTES):
                found = score([b.value for b in group], part.column("text").to_pylist(), hashes)
                columns = [part.column(c) for c in names[:4]]
                columns += [pa.array(v.astype(np.int64)) for v in found[:2]] + [pa.array(v) for v in found[2:]]
                yield pa.record_batch(columns, schema=schema)
            del hashes
            give_back()

        found = rows.mapInArrow(
            run,
            f"id {kind.simpleString()}, held_out boolean, k1 long, k2 long, n_tokens long, n_known long,"
            " base_score double, score double",
        )
        if shards > each:  # the shards of one pass at a time
            found = keep(found)
            for shared in group:
                shared.destroy()
        passes.append(found)
        group = []
    scored = passes[0]
    if len(passes) > 1:
        # Equal rows fall together, as often as they are there.
        copies = F.count("*") / len(passes)
        scored = (
            reduce(DataFrame.unionByName, passes)
            .groupBy("id", "held_out", "k1", "k2")
            .agg(
                copies.cast("int").alias("copies"),
                *[(F.sum(c) / copies).cast(t).alias(c) for c, t in zip(names[4:], ("long", "long", "double", "double"))],
            )
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        )
    return scored.select(
        F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def adaptive_bits(text: str | None, order: int = ORDER) -> float:
    """Bits that a model which starts empty and learns from each byte needs for a text and its end.

    The same escapes and exclusion as :class:`Trie`, byte by byte.
    """
    data = bytes([END]) * order + utf8(text).translate(LOWER_BYTES) + b"\xff"
    counts: dict[bytes, dict[int, int]] = {}
    bits = 0.0
    for at in range(order, len(data)):
        symbol, excluded = data[at], set()
        for size in range(order, -1, -1):
            own = counts.get(data[at - size : at], {})
            left = {s: n for s, n in own.items() if s not in excluded}
            room = sum(left.values()) + len(left)
            if symbol in left:
                bits -= np.log2(left[symbol] / room)
                break
            if left:
                bits -= np.log2(len(left) / room)
            excluded |= own.keys()
        else:
            bits += np.log2(256 - len(excluded))
        for size in range(order + 1):
            own = counts.setdefault(data[at - size : at], {})
            own[symbol] = own.get(symbol, 0) + 1
    return float(bits)
