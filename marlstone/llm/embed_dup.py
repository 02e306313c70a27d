"""Near-duplicate embeddings by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.common import keep, row_key
from marlstone.llm.near_dup import components

# Neighbours on either side that a vector is compared with in a pass.
WINDOW = 256
# The least share of pairs at the threshold that the first passes are to meet;
# more follow while a pass brings more than NEW of all links.
RECALL, NEW = 0.995, 0.001
# Centres of dense balls are compared with all vectors in chunks of so many bytes.
CHUNK_BYTES = 8 << 20
_EPS = 1e-9


def units(packed: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision, of vectors packed as bytes, all of one length."""
    x = np.frombuffer(b"".join(packed.to_pylist()), "<f8").reshape(len(packed), -1).copy()
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _same_length(batch) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Positions and rows of each vector length in a batch."""
    dims = np.array(batch.column("dims"))
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, batch.take(pa.array(at))


def _codes(table: pa.Table) -> np.ndarray:
    """A number for each row's label and vector length."""
    codes: dict = {}
    pairs = zip(table.column("label").to_pylist(), table.column("dims").to_pylist())
    return np.array([codes.setdefault(p, len(codes)) for p in pairs])


def distinct_vectors(vectors: DataFrame, id: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their content hashes k1, k2, null where nothing can be linked; one node for equal vectors of a label)."""
    v = F.col(vector).cast("array<double>")
    good = F.col(label).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))
    k1, k2 = row_key(F.col(label), v)
    rows = vectors.select(
        F.col(id).alias("id"),
        F.when(good, k1).alias("k1"),
        F.when(good, k2).alias("k2"),
        F.col(label).alias("label"),
        v.alias("v"),
    )
    nodes = (
        rows.where("k1 is not null")
        .groupBy("k1", "k2", "label", "v")
        .agg(F.count("*").alias("copies"), F.min("id").alias("least"))
        .select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "label", "copies", "least", "v")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values = np.asarray(lists.flatten()).astype("<f8")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
            ends = np.cumsum(sizes)
            packed = [values[e - n : e].tobytes() for e, n in zip(ends, sizes)]
            columns = [batch.column(i) for i in range(6)]
            yield pa.record_batch(
                [*columns, pa.array(sizes.astype(np.int32)), pa.array(packed, pa.binary())],
                [*batch.schema.names[:6], "dims", "v"],
            )

    schema = T.StructType(
        [*nodes.schema.fields[:6], T.StructField("dims", T.IntegerType()), T.StructField("v", T.BinaryType())]
    )
    return rows.drop("label", "v"), keep(nodes.mapInArrow(pack, schema))


def _sorted(nodes: DataFrame, turn: int) -> DataFrame:
    """Nodes with ``pos``, their place when each label's vectors are ordered by the hashes of pass ``turn``.

    The key concatenates 64 signs of random projections. Places are the row
    numbers of a range-sorted table, with the rows of earlier partitions added.
    """
    schema = T.StructType([*nodes.schema.fields, T.StructField("key", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict = {}
        for batch in batches:
            key = np.zeros(batch.num_rows, np.int64)
            for at, part in _same_length(batch):
                x = units(part.column("v"))
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([turn, d]).standard_normal((d, 64))
                key[at] = np.packbits(x @ planes[d] > 0, axis=1).view(">i8")[:, 0]
            yield pa.record_batch([*batch.columns, pa.array(key)], [*batch.schema.names, "key"])

    order = ["label", "dims", "key", "node"]
    table = nodes.mapInArrow(hashed, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    table = keep(table.drop("key").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = table.groupBy(part.cast("int").alias("part")).count().orderBy("part").collect()
    before, total = [], 0
    for row in sizes:
        before.append((row["part"], total))
        total += row["count"]
    offsets = table.sparkSession.createDataFrame(before or [(0, 0)], "part int, before long")
    placed = table.withColumn("part", part.cast("int")).join(F.broadcast(offsets), "part")
    return placed.withColumn("pos", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


_FOUND = "a long, b long, n long"


def _found(a, b, n) -> pa.Table:
    columns = [pa.array(x, pa.int64()) for x in (a, b, n)]
    return pa.table(columns, names=["a", "b", "n"])


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of links (a, b) as many as connect what they connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            left.append(x)
            right.append(y)
    return left, right


def _window_links(placed: DataFrame, threshold: float, window: int) -> DataFrame:
    """(a, b, n) of one pass: links that connect nodes (n is 0), and for each node a how many rows it is newly linked with.

    Blocks hold ``window`` places and the next ones, so that each pair of places
    at most ``window`` apart is compared in one block. A pair that was as near in
    an earlier pass (``past`` has its places) was counted there.
    """
    block = F.col("pos").cast("long")
    block = F.floor(block / window)
    dealt = placed.withColumn("block", F.explode(F.array(block, block - 1))).where("block >= 0")

    def run(group: pa.Table) -> pa.Table:
        pos = np.array(group.column("pos"))
        order = np.argsort(pos)
        group, pos = group.take(pa.array(order)), pos[order]
        codes, node, copies = _codes(group), np.array(group.column("node")), np.array(group.column("copies"))
        own = int(np.searchsorted(pos, pos[0] // window * window + window))
        block = group.column("block")[0].as_py()
        if pos[0] // window != block:
            return _found([], [], [])  # only the first rows of the next block
        past = np.array(group.column("past").to_pylist(), np.int64).reshape(len(pos), -1)
        a, b = [], []
        for code in np.unique(codes[:own]):
            at = np.flatnonzero(codes == code)
            x = units(group.column("v").take(pa.array(at)))
            first = int(np.searchsorted(at, own))
            i, j = np.nonzero(x[:first] @ x.T >= threshold)
            i, j = at[i], at[j]
            near = (j > i) & (pos[j] - pos[i] <= window)
            i, j = i[near], j[near]
            if past.shape[1]:
                new = ~(np.abs(past[i] - past[j]) <= window).any(axis=1)
                i, j = i[new], j[new]
            a.append(i)
            b.append(j)
        a, b = np.concatenate(a), np.concatenate(b)
        n = np.bincount(a, copies[b], len(pos)) + np.bincount(b, copies[a], len(pos))
        met = np.flatnonzero(n)
        left, right = spanning(node[a], node[b])
        return _found(
            node[met].tolist() + left, [None] * len(met) + right, n[met].astype(np.int64).tolist() + [0] * len(left)
        )

    columns = ["block", "pos", "node", "label", "dims", "copies", "v", "past"]
    return dealt.select(*columns).groupBy("block").applyInArrow(run, _FOUND)


def passes_needed(largest: int, threshold: float, window: int, recall: float) -> int:
    """How many passes bring ``recall`` of the pairs at the threshold within a window.

    Two vectors stay together as long as they share the bits that cut a label of
    ``largest`` vectors into runs of half a window.
    """
    if largest <= window + 1:
        return 1
    bits = math.log2(largest / window) + 1
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-together)))


def _centres_of(placed: DataFrame, threshold: float, window: int) -> DataFrame:
    """(label, dims, v, weight): centres of balls with half a window of nodes, at most one for each ball of a block."""
    half = math.cos(math.acos(threshold) / 2)
    kind = placed.schema["label"].dataType
    schema = T.StructType(
        [T.StructField("label", kind), T.StructField("dims", T.IntegerType())]
        + [T.StructField("v", T.BinaryType()), T.StructField("weight", T.LongType())]
    )

    def run(group: pa.Table) -> pa.Table:
        labels, dims, codes = group.column("label").to_pylist(), group.column("dims").to_pylist(), _codes(group)
        out: list[tuple] = []
        for code in np.unique(codes):
            at = np.flatnonzero(codes == code)
            if len(at) < window // 2:
                continue
            x = units(group.column("v").take(pa.array(at)))
            while len(x) >= window // 2:
                degree = (x @ x.T >= threshold).sum(axis=1)
                near = x[x @ x[degree.argmax()] >= threshold]
                centre = near.mean(axis=0)
                inside = x @ (centre / np.linalg.norm(centre)) >= half
                if inside.sum() < window // 2:
                    break
                out.append((labels[at[0]], dims[at[0]], centre.astype("<f8").tobytes(), int(inside.sum())))
                x = x[~inside]
        columns = zip(*out) if out else [[]] * 4
        types = [to_arrow_type(f.dataType) for f in schema]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=schema.names)

    block = F.floor(F.col("pos") / window).alias("block")
    return placed.select(block, "label", "dims", "v").groupBy("block").applyInArrow(run, schema)


def _merged_centres(centres: DataFrame, threshold: float, window: int) -> DataFrame:
    """Centres, those of one ball merged: blocks of sorted centres are merged until that changes nothing."""
    near = math.cos(math.acos(threshold) / 8)

    def run(group: pa.Table) -> pa.Table:
        codes, weight = _codes(group), np.array(group.column("weight"))
        keep_, new_v, new_w = [], [], []
        for code in np.unique(codes):
            at = np.flatnonzero(codes == code)
            x = units(group.column("v").take(pa.array(at)))
            left = np.ones(len(at), bool)
            for i in np.lexsort((at, -weight[at])):
                if not left[i]:
                    continue
                same = left & (x @ x[i] >= near)
                same[i] = True
                left &= ~same
                keep_.append(at[i])
                new_v.append((weight[at[same], None] * x[same]).sum(axis=0).astype("<f8").tobytes())
                new_w.append(int(weight[at[same]].sum()))
        base = group.take(pa.array(keep_, pa.int64()))
        return pa.table(
            [base.column("label"), base.column("dims"), pa.array(new_v, pa.binary()), pa.array(new_w, pa.int64())],
            names=["label", "dims", "v", "weight"],
        )

    n = centres.count()
    while n:
        placed = _sorted(centres.withColumn("node", F.xxhash64("v")), 0)
        block = F.floor(F.col("pos") / window).alias("block")
        centres_next = keep(
            placed.select(block, "label", "dims", "v", "weight").groupBy("block").applyInArrow(run, centres.schema)
        )
        fewer = centres_next.count()
        centres = centres_next
        if fewer == n:
            break
        n = fewer
    return keep(centres.withColumn("ball", F.monotonically_increasing_id()))


def _near_balls(nodes: DataFrame, centres: DataFrame, threshold: float) -> DataFrame:
    """(node, copies, ball, s): balls that can hold a vector linked with the node, and its cosine to the centre."""
    floor = math.cos(min(math.pi, 1.5 * math.acos(threshold))) - _EPS
    spark = nodes.sparkSession
    found, chunk, size = [], [], 0

    def compare(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups: dict = {}
            for label, dims, v, ball in sent.value:
                groups.setdefault((label, dims), []).append((bytes(v), ball))
            ready = {
                k: (units(pa.array([v for v, _ in g], pa.binary())), np.array([b for _, b in g]))
                for k, g in groups.items()
            }
            for batch in batches:
                labels = batch.column("label").to_pylist()
                for at, part in _same_length(batch):
                    x, d = units(part.column("v")), int(part.column("dims")[0].as_py())
                    own = [labels[i] for i in at]
                    for label in dict.fromkeys(own):
                        if (label, d) not in ready:
                            continue
                        c, balls = ready[label, d]
                        mine = np.array([o == label for o in own])
                        which = np.flatnonzero(mine)
                        s = x[mine] @ c.T
                        i, j = np.nonzero(s >= floor)
                        node = part.column("node").take(pa.array(which[i]))
                        copies = part.column("copies").take(pa.array(which[i]))
                        yield pa.record_batch(
                            [node, copies, pa.array(balls[j], pa.int64()), pa.array(s[i, j])],
                            ["node", "copies", "ball", "s"],
                        )

        rows_of = nodes.select("node", "label", "dims", "copies", "v")
        return keep(rows_of.mapInArrow(run, "node long, copies long, ball long, s double"))

    for row in centres.select("label", "dims", "v", "ball").toLocalIterator():
        chunk.append(tuple(row))
        size += len(row["v"])
        if size >= CHUNK_BYTES:
            found.append(compare(chunk))
            chunk, size = [], 0
    if chunk:
        found.append(compare(chunk))
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    return near


def _ball_links(nodes: DataFrame, near: DataFrame, threshold: float, window: int) -> tuple[DataFrame, DataFrame]:
    """(own, found): the ball of each node that is in one, and (a, b, n) of all links with nodes in balls.

    Nodes within half the threshold's angle of a centre are all linked with one
    another, so they are counted, not compared. Between a node and another
    ball, the distance from the centre and the ball's radius settle most cases
    for all members at once; what they leave open is compared, block by block.
    """
    angle = math.acos(threshold)
    half = math.cos(angle / 2) + _EPS
    own = (
        near.where(F.col("s") >= half)
        .groupBy("node", "copies")
        .agg(F.max(F.struct("s", (-F.col("ball")).alias("ball"))).alias("m"))
        .select("node", "copies", (-F.col("m.ball")).alias("ball"), F.col("m.s").alias("s"))
    )
    own = keep(own)
    balls = keep(
        own.groupBy("ball").agg(
            F.sum("copies").alias("weight"), F.min("s").alias("least"), F.min("node").alias("root"), F.count("*").alias("size")
        )
    )
    mine = own.select("node", F.col("ball").alias("mine"))
    radius, at = F.acos(F.least("least", F.lit(1.0))), F.acos(F.least("s", F.lit(1.0)))
    other = (
        near.join(mine, "node", "left")
        .where("mine is null or mine != ball")
        .join(balls, "ball")
        .withColumn("full", at + radius <= angle - _EPS)
        .where(F.col("full") | (at - radius <= angle + _EPS))
    )
    other = keep(other)
    inside = own.join(balls, "ball")
    whole = other.where("full")
    extra = whole.where("mine is null").groupBy("ball").agg(F.sum("copies").alias("n"))
    parts = [
        inside.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("weight") - F.col("copies")).alias("n")),
        inside.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"), F.lit(0).cast("long").alias("n")),
        whole.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.col("weight").alias("n")),
        whole.select(F.col("node").alias("a"), F.col("root").alias("b"), F.lit(0).cast("long").alias("n")),
        own.join(extra, "ball").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "n"),
    ]
    rim = other.where(~F.col("full"))
    if not rim.isEmpty():
        parts.append(_rim_links(nodes, rim, own, balls, threshold, window))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return own, keep(found)


def _rim_links(nodes, rim, own, balls, threshold: float, window: int) -> DataFrame:
    """(a, b, n) of nodes on the rim of a ball and its members, compared in blocks of about ``window`` of either."""
    sides = rim.groupBy("ball").agg(F.ceil(F.count("*") / window).cast("int").alias("xs"))
    sides = keep(sides.join(balls, "ball").select("ball", "xs", F.ceil(F.col("size") / window).cast("int").alias("ys"), "root"))

    def dealt(frame: DataFrame, mine: str, others: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.col(mine)).cast("int").alias(mine)
        return frame.select("ball", "node", "copies", "alone", "root", block, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(others))

    outer = dealt(rim.select("ball", "node", "copies", F.col("mine").isNull().alias("alone")).join(sides, "ball"), "xs", "ys")
    inner = dealt(own.select("ball", "node", "copies", F.lit(False).alias("alone")).join(sides, "ball"), "ys", "xs")
    vectors = nodes.select("node", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([], [], [])
        linked = units(left.column("v")) @ units(right.column("v")).T >= threshold
        outer_ids, inner_ids = np.array(left.column("node")), np.array(right.column("node"))
        n = (linked * np.array(right.column("copies"))).sum(axis=1)
        alone = np.array(left.column("alone")) * np.array(left.column("copies"))
        back = (linked * alone[:, None]).sum(axis=0)
        i, j = np.flatnonzero(n), np.flatnonzero(back)
        root = left.column("root")[0].as_py()
        a = [*outer_ids[i].tolist(), *inner_ids[j].tolist(), *outer_ids[i].tolist()]
        return _found(a, [None] * (len(i) + len(j)) + [root] * len(i), [*n[i].tolist(), *back[j].tolist(), *[0] * len(i)])

    keys = ["ball", "xs", "ys"]
    left, right = outer.join(vectors, "node"), inner.join(vectors, "node")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # tables of both sides are the same
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _FOUND)


def near_vectors(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    window: int = WINDOW,
    recall: float = RECALL,
) -> DataFrame:
    """Of each row: id, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable by links).

    Rows of equal labels are linked if their cosine, in double precision, is at
    least ``threshold``. In each pass the vectors of a label are ordered by 64
    concatenated signs of random projections, and each is compared with the
    ``window`` next ones on either side. The number of passes follows from the
    largest label; further passes are made as long as one brings more than a
    thousandth of all links. A pair counts in the first pass that brings it
    together, which the places in earlier passes tell, so pairs are never
    written out.

    Where a group of near copies is larger than a window, windows alone would
    lose links. Balls of half the threshold's angle that hold many vectors are
    therefore found first, from the means of dense blocks. All members are
    linked with one another; their links to all other vectors are settled by
    the triangle inequality, or compared in blocks. Only vectors outside of
    balls go through the passes.

    A vector that is null, zero, or holds a null or a component that is not
    finite is linked with nothing, as is one without a label or one of another
    length. Equal vectors of a label are linked (one node that counts as many).
    Null ids get a row each, and name a component only if it has no other id.
    Repeated rows are linked with each other. Other columns are ignored. An
    empty table gives an empty table.
    """
    rows, nodes = distinct_vectors(vectors, id, vector, label)
    largest = nodes.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 0
    sparse = nodes.drop("k1", "k2", "least").withColumn("past", F.array().cast("array<long>"))
    results = []
    if largest > window:
        placed = _sorted(sparse, 0)
        centres = keep(_centres_of(placed, threshold, window))
        if not centres.isEmpty():
            near = _near_balls(nodes, _merged_centres(centres, threshold, window), threshold)
            own, found = _ball_links(nodes, keep(near), threshold, window)
            results.append(found)
            sparse = keep(sparse.join(own.select("node"), "node", "left_anti"))
            largest = sparse.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 0
    total, turn, needed = 0, 0, passes_needed(largest, threshold, window, recall)
    while largest > 1:
        placed = _sorted(sparse, turn)
        found = keep(_window_links(placed, threshold, window))
        results.append(found)
        new = found.agg(F.sum("n")).first()[0] or 0
        total, turn = total + new, turn + 1
        if turn >= needed and (largest <= window + 1 or new <= NEW * total):
            break
        sparse = placed.withColumn("past", F.array_append("past", F.col("pos"))).drop("pos")
    spark = vectors.sparkSession
    found = results[0] if results else spark.createDataFrame([], _FOUND)
    for more in results[1:]:
        found = found.unionByName(more)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    links = keep(found.where("b is not null").select("a", "b").distinct())
    roots = spark.createDataFrame([], "node long, root long") if links.isEmpty() else keep(components(links))
    named = nodes.select("node", "k1", "k2", "copies", "least").join(roots, "node", "left").join(counts, "node", "left")
    named = keep(
        named.select(
            "k1", "k2", "least", F.coalesce("root", "node").alias("root"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(classes, "root").select("k1", "k2", "n_links", "component_id")
    return rows.join(named, ["k1", "k2"], "left").select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
