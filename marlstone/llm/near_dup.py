"""Near-duplicates by consistent weighted samples of TF-IDF shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.common import broadcast_within, give_back, keep, row_key, slices, words

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 12, 4, 0.8
# Documents are counted per shingle in a fixed number of slots.
SLOTS = 18
# How much rarer shingles weigh more. A shingle weighs tf * (1 + DAMP * idf), idf
# between 0 and 1: copies in a very large group share frequent shingles and
# differ in rare ones, and with the plain idf would no longer be alike.
DAMP = 0.1
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(own: list[bytes], known: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a word list, and how often each occurs.

    A list shorter than a shingle is one shingle, an empty one none.
    """
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(known.__getitem__, own), np.uint64, n)
    size = min(n, SHINGLE)
    sums = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        sums += hashes[j : j + len(sums)] * _ODD[j]
    sums = np.sort(_mixed(sums + np.uint64(size)))
    first = np.flatnonzero(np.append(True, sums[1:] != sums[:-1]))
    return sums[first], np.diff(np.append(first, n - size + 1))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws of the sampling's r, ln c and beta, which hashes point at."""
    rng = np.random.default_rng(20100613)
    size = 1 << 16
    return (
        rng.gamma(2, 1, size).astype(np.float32),
        np.log(rng.gamma(2, 1, size)).astype(np.float32),
        rng.random(size).astype(np.float32),
    )


class Sampler:
    """Improved consistent weighted sampling: equal samples with the chance of the weighted Jaccard similarity."""

    def __init__(self, samples: int):
        self.r, self.c, self.beta = _tables()
        rng = np.random.default_rng(4)
        self.salts = rng.integers(0, 2**64, samples, np.uint64)
        self.low = np.uint64(0xFFFF)

    def __call__(self, features: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Samples as (document, sample) hashes; document i has the features from ``begins[i]`` on, sorted, at least one."""
        out = np.empty((len(begins), len(self.salts)), np.uint64)
        at = 0
        sizes = np.diff(np.append(begins, len(features)))
        while at < len(begins):  # in parts that stay in the processor's cache
            stop = max(at + 1, int(np.searchsorted(begins, begins[at] + 20_000)))
            lo, hi = begins[at], begins[stop - 1] + sizes[stop - 1]
            out[at:stop] = self._part(features[lo:hi], np.log(weights[lo:hi]).astype(np.float32), begins[at:stop] - lo, sizes[at:stop])
            at = stop
        return out

    def _part(self, features, logs, begins, sizes) -> np.ndarray:
        of = np.repeat(np.arange(len(begins)), sizes)
        out = np.empty((len(begins), len(self.salts)), np.uint64)
        first = np.empty(len(begins), np.int64)
        for h, salt in enumerate(self.salts):
            z = (features ^ salt) * _ODD[0]
            z = (z ^ (z >> np.uint64(29))) * _ODD[1]
            r = self.r[z >> np.uint64(48)]
            beta = self.beta[(z >> np.uint64(16)) & self.low]
            t = np.floor(logs / r + beta)
            a = self.c[(z >> np.uint64(32)) & self.low] - r * (t - beta + 1)
            least = np.flatnonzero(a == np.minimum.reduceat(a, begins)[of])
            # Of equal ones the smallest feature.
            first[of[least[::-1]]] = least[::-1]
            out[:, h] = features[first] + t[first].astype(np.int64).astype(np.uint64) * _ODD[2]
        return _mixed(out)


def _idf(docs: DataFrame, text: str) -> np.ndarray:
    """1 + DAMP * idf of each slot, from the documents of the whole corpus that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, rows = _WordHashes(), np.zeros(1 << SLOTS, np.int64), 0
        for part in slices(batches, text, 2 << 20):
            values = part.column(text).to_pylist()
            own = np.concatenate([shingles(words(v), known)[0] for v in values])
            counts += np.bincount((own >> np.uint64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS)
            rows += len(values)
        slots = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(slots.astype(np.int32)), pa.array(counts[slots])], ["slot", "n"])
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([rows], pa.int64())], ["slot", "n"])

    table = docs.select(text).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, n = np.array(table.column("slot")), np.array(table.column("n"))
    total = int(n[slots < 0].sum())
    seen = np.ones(1 << SLOTS)
    seen[slots[slots >= 0]] = n[slots >= 0]
    return 1 + DAMP * np.log1p(total / seen) / np.log1p(max(total, 1))


def weighted(own: list[bytes], known: _WordHashes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    features, times = shingles(own, known)
    return features, (times * idf[(features >> np.uint64(64 - SLOTS)).astype(np.int64)]).astype(np.float64)


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the smaller over the sum of the larger weights; features sorted and distinct."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = b[at] == a
    low = np.minimum(wa[both], wb[at[both]]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def signatures(docs: DataFrame, idf, id: str, text: str) -> DataFrame:
    """(id, k1, k2, uid, node, weight, bands): node names the word list; null node and no bands without words."""
    kind = docs.schema[id].dataType
    schema = pa.schema(
        [("id", to_arrow_type(kind)), ("k1", pa.int64()), ("k2", pa.int64()), ("node", pa.binary())]
        + [("weight", pa.float64()), ("bands", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sampler = _WordHashes(), Sampler(BANDS * ROWS)
        turn = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for part in slices(batches, text, 2 << 20):
            lists = [words(t) for t in part.column(text).to_pylist()]
            nodes = [hashlib.blake2b(b" ".join(x), digest_size=16).digest() if x else None for x in lists]
            pairs = [weighted(x, known, idf.value) for x in lists]
            totals = [float(w.sum()) for _, w in pairs]
            full = np.array([i for i, (f, _) in enumerate(pairs) if len(f)], np.int64)
            bands: list = [[] for _ in lists]
            if len(full):
                sizes = np.array([len(pairs[i][0]) for i in full], np.int64)
                features = np.concatenate([pairs[i][0] for i in full])
                weights = np.concatenate([pairs[i][1] for i in full])
                samples = sampler(features, weights, np.cumsum(sizes) - sizes).reshape(len(full), BANDS, ROWS)
                keys = np.zeros((len(full), BANDS), np.uint64) + turn
                for j in range(ROWS):
                    keys = _mixed(keys * _ODD[3] + samples[:, :, j])
                for i, own in zip(full.tolist(), keys.view(np.int64).tolist()):
                    bands[i] = own
            columns = [part.column(c) for c in ("id", "k1", "k2")] + [nodes, totals, bands]
            yield pa.record_batch(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )
        del known
        give_back()

    k1, k2 = row_key(F.col(id), F.col(text))
    return docs.select(F.col(id).alias("id"), F.col(text).alias(text), k1.alias("k1"), k2.alias("k2")).mapInArrow(
        run, f"id {kind.simpleString()}, k1 long, k2 long, node binary, weight double, bands array<long>"
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of an undirected graph (a, b): root is the component's smallest node.

    Alternating large and small stars until nothing changes; a round joins every
    edge to the smallest neighbour of its ends.
    """
    edges = keep(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = keep(small.where("u != v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        last = state


def _vectors(docs: DataFrame, picks: DataFrame, text: str) -> DataFrame:
    """(node, features, times) of picked rows (k1, k2, node, many): sorted shingles and how often each occurs, as bytes.

    ``many`` says that several rows have the key; one of them is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for part in slices(batches, text, 2 << 20):
            pairs = [shingles(words(t), known) for t in part.column(text).to_pylist()]
            features, times = ([p[i].astype(k).tobytes() for p in pairs] for i, k in ((0, "<u8"), (1, "<u4")))
            yield pa.record_batch(
                [part.column("node"), pa.array(features, pa.binary()), pa.array(times, pa.binary())],
                ["node", "features", "times"],
            )
        del known
        give_back()

    one = docs.join(picks, ["k1", "k2"]).select("node", text, "many")
    if not picks.where("many").isEmpty():
        again = one.where("many").groupBy("node").agg(F.first(text).alias(text), F.lit(True).alias("many"))
        one = one.where("not many").unionByName(again)
    return one.select("node", text).mapInArrow(run, "node binary, features binary, times binary")


def _slot_weights(features: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[(features >> np.uint64(64 - SLOTS)).astype(np.int64)]


def _alike(pairs: DataFrame, vectors: DataFrame, idf) -> DataFrame:
    """Of pairs (a, b), where few nodes are a b, those with a weighted Jaccard similarity of SIMILARITY or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in ("fa", "ta", "fb", "tb")]
            good = []
            for i in range(batch.num_rows):
                fa, ta, fb, tb = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(sides, ("<u8", "<u4") * 2))
                found = weighted_jaccard(fa, ta * _slot_weights(fa, idf.value), fb, tb * _slot_weights(fb, idf.value))
                good.append(found >= SIMILARITY)
            mask = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])
        give_back()

    one = vectors.select(F.col("node").alias("a"), F.col("features").alias("fa"), F.col("times").alias("ta"))
    two = vectors.select(F.col("node").alias("b"), F.col("features").alias("fb"), F.col("times").alias("tb"))
    centres = keep(pairs.select("b").distinct())
    two = two.join(broadcast_within(centres, 300_000), "b", "left_semi")
    return one.join(broadcast_within(pairs, 300_000), "a").join(two, "b").mapInArrow(run, "a binary, b binary")


def block_links(roots: list, features: list[np.ndarray], times: list[np.ndarray], idf: np.ndarray) -> list[tuple]:
    """Pairs of roots that have nodes with a similarity of SIMILARITY or more, as many as connect them.

    Nodes are rows of a matrix over the shingles that at least two of them
    have, a shingle that occurs n times being n columns; the products of rows
    sum the smaller weights of all pairs of nodes at once.
    """
    parts = []
    for f, t in zip(features, times):
        again = np.repeat(f, t)
        turn = np.arange(len(again)) - np.repeat(np.cumsum(t) - t, t)
        parts.append((again, again + turn.astype(np.uint64) * _ODD[4]))
    totals = np.array([_slot_weights(p[0], idf).sum() for p in parts])
    row = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    plain, named = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    _, first, column, seen = np.unique(named, return_index=True, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    place = np.cumsum(seen > 1) - 1
    weights = _slot_weights(plain[first[seen > 1]], idf)
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    low = np.zeros((len(parts), len(parts)))
    for start in range(0, len(weights), 4096):
        stop = min(start + 4096, len(weights))
        a, b = np.searchsorted(column, [start, stop])
        block = np.zeros((len(parts), stop - start))
        block[row[a:b], column[a:b] - start] = 1
        low += (block * weights[start:stop]) @ block.T
    alike = low >= (SIMILARITY - 1e-12) * (totals[:, None] + totals - low)
    codes = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    code = np.array([codes[r] for r in roots])
    i, j = np.nonzero(alike & (code[:, None] > code))
    parent, names, links = list(range(len(codes))), list(codes), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in set(zip(code[i].tolist(), code[j].tolist())):
        if find(x) != find(y):
            parent[find(x)] = find(y)
            links.append((names[x], names[y]))
    return links


def _links_in_bands(rows: DataFrame, vectors: DataFrame, idf, block: int = 256) -> DataFrame:
    """(a, b): roots to connect, from all pairs of nodes of a band (key, node, root) with different roots.

    Members of a band are dealt over blocks of about ``block``, and each pair
    of blocks is compared in a task of its own.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.join(sizes, "key").select(
        "key", "node", "root", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), blocks.alias("blocks")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("key", "node", "root", "own", other.alias("other"))
    dealt = dealt.select(
        "key", "node", "root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    )

    def run(group: pa.Table) -> pa.Table:
        features = [np.frombuffer(v.as_buffer(), "<u8") for v in group.column("features")]
        times = [np.frombuffer(v.as_buffer(), "<u4") for v in group.column("times")]
        links = block_links(group.column("root").to_pylist(), features, times, idf.value)
        return pa.table({n: pa.array([x[i] for x in links], pa.binary()) for i, n in enumerate(("a", "b"))})

    return dealt.join(vectors, "node").groupBy("key", "x", "y").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: id, ``class_id``, ``class_size``, and a row key (k1, k2).

    A class is a connected component of the links between documents whose
    weighted Jaccard similarity is at least 0.8 and which the bands bring
    together; ``class_id`` is its smallest id. Features are shingles of five
    words (A-Z lower-cased runs of ASCII letters, digits and all other
    characters; a shorter text is one shingle), weighted by their number in the
    text and a damped inverse document frequency of the whole corpus. Of 48
    consistent weighted samples, four to a band, 12 bands bring 99.8 % of the
    pairs at 0.8 together, and 99.99 % at 0.85; each pair that is linked was
    compared exactly.

    Texts without words, null ones too, are near-duplicates of nothing and
    classes of their own, named by their id. Null ids get a row each, and name
    no class as long as it has another id. Repeated rows are copies. An empty
    table gives an empty table. Other columns are ignored.

    Texts with equal words are one node from the start. Bands are never
    expanded to rows of pairs: each node first meets the smallest node of its
    bands, in a join on that node, which adaptive execution splits where it is
    hot. The members of bands that still lie in different components are then
    compared block by block, so that no pair of a band is left that is neither
    connected nor compared; a task holds two blocks, and gives the links that
    connect components, not those of all pairs. Vectors are made only for nodes
    that share a band with another.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(_idf(docs, text))
    rows = keep(signatures(docs, idf, id, text))
    nodes = (
        rows.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    )
    nodes = keep(nodes)
    members = nodes.select(F.explode("bands").alias("key"), "node", "weight")
    crowded = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = keep(members.join(crowded, "key", "left_semi"))
    picks = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("k.k1", "k.k2", "node")
    repeated = rows.where(F.col("node").isNotNull()).groupBy("k1", "k2").agg((F.count("*") > 1).alias("many")).where("many")
    picks = picks.join(repeated, ["k1", "k2"], "left").withColumn("many", F.coalesce("many", F.lit(False)))
    picks = keep(picks)
    k1, k2 = row_key(F.col(id), F.col(text))
    texts = docs.select(F.col(text).alias(text), k1.alias("k1"), k2.alias("k2"))
    vectors = keep(_vectors(texts, broadcast_within(picks, 300_000), text))
    roots = picks.select("node", F.col("node").alias("root"))
    near = lambda p, q: F.least(p, q) >= (SIMILARITY - 1e-9) * F.greatest(p, q)
    for step in ("stars", "rest"):
        placed = buckets.join(roots, "node")
        open_keys = (
            placed.groupBy("key")
            .agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min(F.struct("node", "weight")).alias("c"))
            .where("x != y")
        )
        if step == "stars":
            pairs = placed.join(open_keys.select("key", "c"), "key").where(
                (F.col("node") != F.col("c.node")) & near(F.col("weight"), F.col("c.weight"))
            )
            pairs = keep(pairs.groupBy(F.col("node").alias("a")).agg(F.min("c.node").alias("b")))
            links = keep(_alike(pairs, vectors, idf))
        else:
            open_rows = keep(placed.join(open_keys.select("key"), "key", "left_semi").select("key", "node", "root"))
            links = keep(_links_in_bands(open_rows, vectors, idf).distinct())
        if links.isEmpty():
            continue
        merged = keep(components(links))
        moved = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
        roots = keep(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    labelled = rows.join(roots, "node", "left").select(
        "id", "k1", "k2", F.coalesce("root", "node").alias("root")
    )
    labelled = keep(labelled)
    classes = (
        labelled.where(F.col("root").isNotNull())
        .groupBy("root")
        .agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    )
    alone = F.col("root").isNull()
    return labelled.join(classes, "root", "left").select(
        F.col("id").alias(id),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        "k1",
        "k2",
    )


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of :func:`near_duplicates`: that with the smallest id.

    Of a class without ids, and of rows that share the smallest id, one row
    stays. Texts without words stay, but equal rows (id and text) only once.
    Columns are those of ``docs``.
    """
    found = keep(near_duplicates(docs, id, text))
    single = F.col("class_size") == 1
    first = (
        found.where(~single)
        .where(F.col(id).eqNullSafe(F.col("class_id")))
        .groupBy("class_id")
        .agg(F.min(F.struct("k1", "k2")).alias("k"))
        .select("k.k1", "k.k2")
    )
    kept = keep(found.where(single).select("k1", "k2").unionByName(first))
    k1, k2 = row_key(F.col(id), F.col(text))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    wide = docs.select(row, k1.alias("k1"), k2.alias("k2")).join(
        broadcast_within(kept, 300_000), ["k1", "k2"], "left_semi"
    )
    if not found.groupBy("k1", "k2").count().where("count > 1").isEmpty():
        wide = wide.dropDuplicates(["k1", "k2"])
    return wide.select("row.*")
