"""Exact nearest neighbours over cells: only cells that can hold a neighbour are read.

Vectors lie in k-means cells, each a folder of packed blocks. Of a cell its
centre and radius are known, so by the triangle inequality no vector in it is
nearer to a question than the centre's distance less the radius. A question
first visits the nearest cells that hold k vectors; the distance of the last of
these k then tells which other cells are left to visit. The result is that of
:func:`marlstone.operators.knn.nearest`.

Cells are dealt over groups bounded in bytes. A question moves once for each
group that holds a cell it visits, with one bit a cell, never once for each
cell: where vectors do not cluster, it visits most of them.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.operators.knn import _group_best, _k_best, _matrix, _ranked
from marlstone.session import keep

# Vectors of a cell that one row holds, and questions that meet cells at a time.
BLOCK_ROWS, QUESTION_ROWS = 1024, 1024
# Vectors, or questions, that a task of a search is dealt.
GROUP_BYTES = 32 * 1024 * 1024
# Centres are shipped to every task; more cells than this are never made.
MAX_CELLS = 16_384
# Rows for each cell, by hash of the id, that the centres are fitted to.
SAMPLE_ROWS = 200
# Room for rounding, relative to the distances compared.
_ROOM = 1e-9


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all points to all centres, from plain differences, which keep their digits far from the origin."""
    out = np.empty((len(points), len(centres)))
    for i, point in enumerate(points):
        gap = centres - point
        out[i] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _packed(frame: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of (cell, key, embedding), sorted by cell, as rows of up to ``rows``: cell, ids, vectors end to end."""
    kind = frame.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("cell", T.IntegerType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("flat", T.ArrayType(T.DoubleType())),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.array(batch.column("cell"))
            starts = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1))
            for start, stop in zip(starts, [*starts[1:], len(cells)]):
                for at in range(start, stop, rows):
                    part = batch.slice(at, min(rows, stop - at))
                    ids, flat = part.column(key), part.column("embedding").flatten()
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, flat)]
                    yield pa.RecordBatch.from_arrays([part.column("cell").slice(0, 1), *lists], ["cell", "ids", "flat"])

    order = ["cell", key]
    # By range, so that a cell with many of the rows is dealt over several tasks.
    ordered = frame.select("cell", key, "embedding").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(pack, schema)


def _groups(cells: list, parts: int) -> list[tuple[int, int]]:
    """(first group, number of groups) of each cell: cells near each other share one, a cell too large for one gets several.

    There are about ``parts`` groups, more where they would be too large, fewer where they would be below a block.
    """
    centres, total = np.array([c["centre"] for c in cells], np.float64), sum(c["size"] for c in cells)
    most = max(1, min(GROUP_BYTES // (8 * centres.shape[1]), max(BLOCK_ROWS, -(-total // parts))))
    wanted = -(-total // most)
    # The farthest centre from all taken so far is the next to gather others.
    away = near = _distances(centres[:1], centres)[0]
    gathered = np.zeros(len(cells), np.int64)
    for number in range(1, min(wanted, len(cells))):
        away = _distances(centres[near.argmax()][None], centres)[0]
        gathered[away < near] = number
        near = np.fmin(near, away)
    out, group, held = [(0, 1)] * len(cells), 0, 0
    for at in np.argsort(gathered, kind="stable"):
        size = cells[at]["size"]
        if held and held + size > most:
            group, held = group + 1, 0
        span = max(1, -(-size // most))
        out[at], held = (group, span), held + size
        if span > 1:
            group, held = group + span, 0
    return out


def _members(groups: list[tuple[int, int]]) -> dict[int, list[int]]:
    """Positions of the cells that each group holds, in whole or in part."""
    out = {}
    for at, (first, span) in enumerate(groups):
        for group in range(first, first + span):
            out.setdefault(group, []).append(at)
    return out


def _shares(counts: dict[int, int], dims: int, tasks: int) -> dict[int, int]:
    """Into how many shares the questions of each group go: bounded in bytes, together tasks for every core."""
    total = sum(counts.values())
    return {
        g: max(1, -(-n * dims * 8 // GROUP_BYTES), min(-(-n // QUESTION_ROWS), 3 * tasks * n // total))
        for g, n in counts.items()
    }


def _meet(k: int, members: dict[int, list[int]], types: tuple):
    """mapInArrow body: rows of a slot, its blocks before its questions, to the slot's k best per question.

    ``members`` are the cells of each group, in the order of the bits of a question.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts, stored = None, {}, None
        for batch in batches:
            slots, asked = np.array(batch.column("slot")), np.array(batch.column("cell").is_null())
            edges = np.flatnonzero((np.diff(slots, prepend=slots[:1] - 1) != 0) | (np.diff(asked, prepend=asked[:1]) != 0))
            for start, stop in zip(edges, [*edges[1:], batch.num_rows]):
                if slots[start] != slot:
                    slot, parts, stored = slots[start], {}, None
                if not asked[start]:
                    for at in range(start, stop):
                        ids = batch.column("ids")[at].values
                        vectors = np.asarray(batch.column("flat")[at].values, np.float64).reshape(len(ids), -1)
                        parts.setdefault(batch.column("cell")[at].as_py(), []).append((ids, vectors))
                    continue
                if stored is None:
                    # Of a cell in several groups, this one may hold no block.
                    cells = members[batch.column("group")[int(start)].as_py()]
                    held = [(bit, *zip(*parts[c])) for bit, c in enumerate(cells) if c in parts]
                    if not held:
                        continue
                    named = pa.concat_arrays([x for _, ids, _ in held for x in ids])
                    keys = np.array(named.to_pylist())
                    ends = np.cumsum([0] + [sum(map(len, vectors)) for _, _, vectors in held])
                    stored = np.concatenate([v for _, _, vectors in held for v in vectors])
                    parts = {}
                for at in range(start, stop, QUESTION_ROWS):
                    some = batch.slice(at, min(QUESTION_ROWS, stop - at))
                    points, last = _matrix(some.column("flat")), np.array(some.column("last"), np.float64)
                    bits = np.frombuffer(b"".join(some.column("bits").to_pylist()), np.uint8).reshape(len(points), -1)
                    use = np.unpackbits(bits, axis=1).astype(bool)
                    row, pos, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                    for (bit, _, _), low, high in zip(held, ends, ends[1:]):
                        rows = np.flatnonzero(use[:, bit])
                        if not len(rows):
                            continue
                        r, p, f = _group_best(points[rows], stored[low:high], keys[low:high], k, last[rows])
                        if len(r):
                            row, pos, far = (np.concatenate(x) for x in ((row, rows[r]), (pos, low + p), (far, f)))
                            row, pos, far, begins = _k_best(row, pos, far, keys, len(points), k)
                            full = np.diff(begins) == k
                            last[full] = np.fmin(last[full], far[begins[1:][full] - 1])
                    names = some.column("query_id").take(pa.array(row)).cast(types[0])
                    found = named.take(pa.array(pos)).cast(types[1])
                    yield pa.RecordBatch.from_arrays([names, found, pa.array(far)], ["query_id", "id", "distance"])

    return search


@dataclass(frozen=True)
class CellIndex:
    """Vectors in cells under ``path``: ``cells`` (cell, size, radius, centre), ``blocks/cell=N``, and ``ids`` for their type."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int | None = None) -> CellIndex:
        """Deal vectors (id, embedding) over cells, the square root of their number unless given.

        Centres are fitted by k-means to a sample that is bounded by the number
        of cells; every vector is then put into the cell of its nearest centre.
        Rows without an embedding are left out.
        """
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        rows = rows.where(F.col("embedding").isNotNull())
        total = rows.count()
        cells = max(1, min(MAX_CELLS, cells or int(total**0.5), total))
        share = min(1.0, cells * SAMPLE_ROWS / max(total, 1))
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        if total:
            points = keep(sample.select(array_to_vector("embedding").alias("features")))
            model = KMeans(k=cells, seed=1, maxIter=10).fit(points)
            centres = np.array(model.clusterCenters(), np.float64)
        else:
            centres = np.zeros((1, 1))
        kind = rows.schema["id"].dataType
        schema = T.StructType(
            [T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()), T.StructField("id", kind)]
            + [T.StructField("embedding", T.ArrayType(T.DoubleType()))]
        )

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    away = _distances(_matrix(batch.column("embedding")), centres)
                    best = away.argmin(axis=1)
                    columns = [pa.array(best.astype(np.int32)), pa.array(away[np.arange(len(best)), best])]
                    yield pa.RecordBatch.from_arrays([*columns, *batch.columns], schema.names)

        placed = keep(rows.mapInArrow(assign, schema))
        _packed(placed, "id", BLOCK_ROWS).write.partitionBy("cell").parquet(f"{path}/blocks")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("away").alias("radius")).collect()
        made = [(r["cell"], r["size"], r["radius"], centres[r["cell"]].tolist()) for r in sizes]
        table = spark.createDataFrame(made, "cell int, size long, radius double, centre array<double>")
        table.coalesce(1).write.parquet(f"{path}/cells")
        rows.select("id").limit(0).write.parquet(f"{path}/ids")  # their type, of an index without rows too
        return CellIndex(spark, path)

    def cells(self) -> list:
        """One row a cell; at most MAX_CELLS."""
        return self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()

    def blocks(self, cells: list[int]) -> DataFrame:
        """Blocks of some cells; no file of another is read."""
        kind = self.spark.read.parquet(f"{self.path}/ids").schema["id"].dataType.simpleString()
        schema = f"ids array<{kind}>, flat array<double>, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/blocks").where(F.col("cell").isin(cells))

    def nearest(self, questions: DataFrame, k: int) -> DataFrame:
        """The k nearest vectors of every question (query_id, embedding): query_id, id, distance, rank.

        Distances are squared. Questions without an embedding take no part.
        """
        if k < 1:
            raise ValueError("top_k must be at least 1")
        asked = questions.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        asked = asked.where(F.col("embedding").isNotNull() & F.col("query_id").isNotNull())
        known = self.cells()
        # First a question goes to few groups, so there is one for each task; then
        # possibly to all, and vectors and questions move about equally often.
        tasks = 3 * self.spark.sparkContext.defaultParallelism
        first = keep(self._search(asked.withColumn("last", F.lit(None).cast("double")), known, k, tasks))
        last = first.groupBy("query_id").agg(F.max("distance").alias("last"))
        found = first.unionByName(self._search(asked.join(last, "query_id"), known, k, math.ceil(tasks**0.5)))
        # A question whose id repeats counts once for each row of that id.
        times = asked.groupBy("query_id").agg(F.count("*").cast("int").alias("n")).where("n > 1")
        again = F.explode(F.array_repeat(F.lit(0), F.coalesce("n", F.lit(1))))
        found = found.join(times, "query_id", "left").withColumn("again", again)
        return _ranked(found.select("query_id", "id", "distance"), k)

    def _visits(self, asked: DataFrame, known: list, groups: list[tuple[int, int]], k: int) -> DataFrame:
        """Questions (query_id, embedding, last) with ``visits``, a (group, bits) for each group with cells to visit.

        Without ``last`` these are the nearest cells that hold k vectors; with
        it, all other cells that can hold a vector no farther, going by centres
        and radii alone. ``seen`` names every cell once for each task that has
        questions to visit it.
        """
        numbers = np.array([c["cell"] for c in known], np.int32)
        sizes = np.array([c["size"] for c in known], np.int64)
        radii = np.array([c["radius"] for c in known], np.float64)
        centres = np.array([c["centre"] for c in known], np.float64)
        members = _members(groups)
        visit = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("bits", T.BinaryType())])
        schema = T.StructType(
            [*asked.schema.fields, T.StructField("visits", T.ArrayType(visit))]
            + [T.StructField("seen", T.ArrayType(T.IntegerType()))]
        )

        def cells_of(points: np.ndarray, last: np.ndarray, start: bool) -> np.ndarray:
            use = np.zeros((len(points), len(numbers)), bool)
            for q, away in enumerate(_distances(points, centres)):
                order = np.argsort(away, kind="stable")
                enough = order[: int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1]
                if not np.isfinite(away).all():
                    continue  # nothing is near a question that is not a number
                if start:
                    use[q, enough] = True
                else:
                    room = _ROOM * float(away.max() + radii.max())
                    use[q] = away - radii <= last[q] * (1 + _ROOM) + room
                    use[q, enough] = False
            return use

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told = np.zeros(len(numbers), bool)
            for whole in batches:
                for at in range(0, whole.num_rows if len(numbers) else 0, QUESTION_ROWS):
                    batch = whole.slice(at, QUESTION_ROWS)
                    last = np.sqrt(np.array(batch.column("last"), np.float64))
                    use = cells_of(_matrix(batch.column("embedding")), last, batch.column("last").null_count > 0)
                    rows, named, bits = [], [], []
                    for group, cells in members.items():
                        those = np.flatnonzero(use[:, cells].any(axis=1))
                        rows.append(those)
                        named.append(np.full(len(those), group, np.int32))
                        bits += map(bytes, np.packbits(use[:, cells][those], axis=1))
                    rows, named = np.concatenate(rows), np.concatenate(named)
                    order = pa.array(np.argsort(rows, kind="stable"))
                    pairs = pa.StructArray.from_arrays(
                        [pa.array(named).take(order), pa.array(bits, pa.binary()).take(order)], ["group", "bits"]
                    )
                    ends = np.searchsorted(np.sort(rows), np.arange(len(use) + 1)).astype(np.int32)
                    new = np.flatnonzero(use.any(axis=0) & ~told)
                    told[new] = True
                    seen = [numbers[new].tolist(), *[None] * (len(use) - 1)]
                    lists = [pa.ListArray.from_arrays(pa.array(ends), pairs), pa.array(seen, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *lists], schema.names)

        return asked.mapInArrow(visits, schema)

    def _search(self, asked: DataFrame, known: list, k: int, parts: int) -> DataFrame:
        """The k best of each question in the cells it visits: query_id, id, distance.

        Every share of a group's questions meets the vectors of the group in a
        task of its own, a slot; slots are bounded in bytes on both sides.
        """
        spark, groups = self.spark, _groups(known, parts) if known else []
        visits = keep(self._visits(asked, known, groups, k).withColumn("at", F.monotonically_increasing_id()))
        cells = [r[0] for r in visits.select(F.explode("seen")).distinct().collect()]
        sent = visits.select("at", "query_id", "embedding", "last", F.explode("visits").alias("v"))
        sent = sent.select("at", "query_id", F.col("embedding").alias("flat"), "last", "v.group", "v.bits")
        counts = {r["group"]: r["count"] for r in sent.groupBy("group").count().orderBy("group").collect()}
        blocks = self.blocks(cells)
        kinds = asked.schema["query_id"].dataType, blocks.schema["ids"].dataType.elementType
        result = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, distance double"
        if not counts:
            return spark.createDataFrame([], result)
        shares = _shares(counts, len(known[0]["centre"]), spark.sparkContext.defaultParallelism)
        begins = dict(zip(shares, np.cumsum([0, *shares.values()]).tolist()))

        # Small tables: a row a cell, a row a group, a row a slot.
        homes = [(c["cell"], *home) for c, home in zip(known, groups)]
        homes = F.broadcast(spark.createDataFrame(homes, "cell int, home int, span int"))
        dealt = [(g, begins[g], n) for g, n in shares.items()]
        dealt = F.broadcast(spark.createDataFrame(dealt, "group int, begin int, shares int"))
        share = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
        slots = F.sequence("begin", F.col("begin") + F.col("shares") - 1)
        left = blocks.join(homes, "cell").withColumn("group", F.col("home") + share("ids", "span")).join(dealt, "group")
        left = left.select(F.explode(slots).alias("slot"), "group", "cell", "ids", "flat")
        right = sent.join(dealt, "group").withColumn("slot", F.col("begin") + share("at", "shares"))
        right = right.select("slot", "group", "query_id", "flat", "last", "bits")
        met = left.unionByName(right, allowMissingColumns=True).repartitionById(sum(shares.values()), F.col("slot"))
        met = met.sortWithinPartitions("slot", F.col("cell").asc_nulls_last())
        members = {g: [known[i]["cell"] for i in cells] for g, cells in _members(groups).items()}
        types = tuple(to_arrow_type(kind) for kind in kinds)
        return _ranked(met.mapInArrow(_meet(k, members, types), result), k).drop("rank")


def build_cells(vectors: DataFrame, root: str, cells: int | None = None) -> CellIndex:
    """A new :class:`CellIndex` in a folder of its own below ``root``."""
    return CellIndex.build(vectors, f"{root.rstrip('/')}/cells-{os.urandom(8).hex()}", cells)
