"""Exact nearest neighbours by squared L2 distance.

Each task reduces its Arrow batches to k candidates per question before
anything is shuffled, so what moves is (tasks x questions x k) rows however
many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.session import keep

# Largest question set shipped whole to every task. A larger one takes the
# block join below.
BROADCAST_QUESTIONS = 8192
BROADCAST_BYTES = 64 * 1024 * 1024


# Questions that one matrix product takes at a time.
QUESTION_BLOCK = 256
# Vectors, or questions, that a task of the block join is dealt.
GROUP_BYTES = 32 * 1024 * 1024
# Vectors that one of its matrix products takes, and values of its exact differences.
STORED_PART, PAIR_VALUES = 4096, 1 << 22


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _closest(questions: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Positions and distances of the k nearest rows of each question, ties broken by id.

    Distances from a matrix product only shortlist, with room for its rounding,
    which grows with the squared norms; what is reported is always the plain
    sum of squared differences.
    """
    squares = (vectors * vectors).sum(axis=1)
    for start in range(0, len(questions), QUESTION_BLOCK):
        block = questions[start : start + QUESTION_BLOCK]
        own = (block * block).sum(axis=1)
        shortlist = None
        if len(ids) > k:
            rough = own[:, None] + squares - 2.0 * block @ vectors.T
            room = 8 * (vectors.shape[1] + 4) * np.finfo(np.float64).eps * (own + squares.max())
            shortlist = rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * room)[:, None]
        for q, question in enumerate(block):
            pool = np.arange(len(ids)) if shortlist is None else np.flatnonzero(shortlist[q])
            delta = vectors[pool] - question
            distance = (delta * delta).sum(axis=1)
            order = np.lexsort((ids[pool], distance))[:k]
            yield pool[order], distance[order]


def _candidates(questions: np.ndarray, k: int):
    """mapInArrow body: (id, embedding) batches to the task's k best per question."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [None] * len(questions)
        id_type = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            id_type = batch.column(0).type
            ids = np.array(batch.column(0).to_pylist())
            vectors = _matrix(batch.column(1))
            for q, (found, distance) in enumerate(_closest(questions, vectors, ids, k)):
                found = ids[found]
                if best[q] is not None:
                    found = np.concatenate([best[q][0], found])
                    distance = np.concatenate([best[q][1], distance])
                    order = np.lexsort((found, distance))[:k]
                    found, distance = found[order], distance[order]
                best[q] = (found, distance)
        for q, pair in enumerate(best):
            if pair is not None:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(pair[0]), q), pa.int32()),
                        pa.array(pair[0].tolist(), id_type),
                        pa.array(pair[1], pa.float64()),
                    ],
                    names=["position", "id", "distance"],
                )

    return search


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to QUESTION_BLOCK rows as one: ids, then the vectors end to end."""
    for whole in batches:
        for start in range(0, whole.num_rows, QUESTION_BLOCK):
            ids, vectors = whole.slice(start, QUESTION_BLOCK).columns
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.ListArray.from_arrays(
                        pa.array([0, len(vectors.flatten())], pa.int32()), vectors.flatten()
                    ),
                ],
                names=["ids", "flat"],
            )


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of every question: query_id, id, distance, rank.

    ``questions`` is (query_id, embedding), ``vectors`` is (id, embedding), with
    embeddings of any numeric type; rows without an embedding take no part. A
    question set below a checked size goes to every task, which saves shuffling
    the vectors; any other meets them in blocks. Both compute the same numbers.
    """
    if k < 1:
        raise ValueError("top_k must be at least 1")
    vectors, questions = (
        side.select(key, F.col("embedding").cast("array<double>").alias("embedding")).where(
            F.col("embedding").isNotNull()
        )
        for side, key in ((vectors, "id"), (questions, "query_id"))
    )
    sample = questions.limit(BROADCAST_QUESTIONS + 1)
    held = sample.toArrow().combine_chunks()
    if held.num_rows > BROADCAST_QUESTIONS or held.nbytes > BROADCAST_BYTES:
        return _nearest_blocks(questions, vectors, k)

    id_type = vectors.schema["id"].dataType.simpleString()
    key_type = questions.schema["query_id"].dataType
    matrix = _matrix(held.column("embedding").chunk(0)) if held.num_rows else np.empty((0, 1))
    found = vectors.mapInArrow(
        _candidates(matrix, k), f"position int, id {id_type}, distance double"
    )
    names = questions.sparkSession.createDataFrame(
        [(i, name) for i, name in enumerate(held.column("query_id").to_pylist())],
        f"position int, query_id {key_type.simpleString()}",
    )
    # ``names`` holds at most BROADCAST_QUESTIONS rows, checked above.
    return _ranked(found.join(F.broadcast(names), "position").drop("position"), k)


def _k_best(row: np.ndarray, pos: np.ndarray, far: np.ndarray, ids: np.ndarray, rows: int, k: int):
    """The k best of each of ``rows``, ties broken by id; and where in them each row begins."""
    order = np.lexsort((ids[pos], far, row))
    begins = np.searchsorted(row[order], np.arange(rows + 1))
    order = order[np.arange(len(order)) - begins[row[order]] < k]
    row, pos, far = row[order], pos[order], far[order]
    return row, pos, far, np.searchsorted(row, np.arange(rows + 1))


def _group_best(asked: np.ndarray, stored: np.ndarray, ids: np.ndarray, k: int, last: np.ndarray | None = None):
    """Rows of ``asked``, positions in ``stored`` and distances of the k nearest, ties broken by id.

    As in :func:`_closest`, a matrix product shortlists and plain differences
    decide; coordinates are taken from a point amid the vectors, so that the
    product keeps its digits far from the origin. Stored rows are compared a
    part at a time, later ones only with what can still displace a neighbour.
    ``last`` is a distance for each question beyond which nothing is wanted.
    """
    finite = np.isfinite(stored).all(axis=1)
    centre = stored[finite].mean(axis=0) if finite.any() else np.zeros(stored.shape[1])
    own_at = asked - centre
    own = (own_at * own_at).sum(axis=1)
    eps = 8 * (stored.shape[1] + 4) * np.finfo(np.float64).eps
    at_once = max(1, PAIR_VALUES // stored.shape[1])
    row, pos, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    last = np.full(len(asked), np.inf) if last is None else last.copy()
    for start in range(0, len(stored), STORED_PART):
        part = stored[start : start + STORED_PART] - centre
        squares = (part * part).sum(axis=1)
        rough = own[:, None] + squares - 2.0 * own_at @ part.T
        room = eps * (own + squares.max())
        cut = last
        if len(part) > k and not np.isfinite(last).all():
            cut = np.fmin(last, np.partition(rough, k - 1, axis=1)[:, k - 1] + room)
        # What is not a number is never ruled out here; it sorts last below.
        q, v = np.nonzero(~(rough > (cut + room)[:, None]))
        if not len(q):
            continue
        v += start
        distance = np.empty(len(q))
        for at in range(0, len(q), at_once):
            span = slice(at, at + at_once)
            delta = stored[v[span]] - asked[q[span]]
            distance[span] = (delta * delta).sum(axis=1)
        row, pos, far = np.concatenate([row, q]), np.concatenate([pos, v]), np.concatenate([far, distance])
        row, pos, far, ends = _k_best(row, pos, far, ids, len(asked), k)
        full = np.diff(ends) == k
        last[full] = np.fmin(last[full], far[ends[1:][full] - 1])
    return row, pos, far


def _group_search(k: int, types: tuple):
    """mapInArrow body: rows of a slot, its vectors before its questions, to the slot's k best per question."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, ids, parts, stored = None, [], [], None
        for batch in batches:
            for at in range(batch.num_rows):
                now, flat = batch.column("slot")[at].as_py(), batch.column("flat")[at].values
                if now != slot:
                    slot, ids, parts, stored = now, [], [], None
                if not batch.column("asked")[at].as_py():
                    names = batch.column("ids")[at].as_py()
                    ids += names
                    parts.append(np.asarray(flat, dtype=np.float64).reshape(len(names), -1))
                    continue
                if not parts and stored is None:
                    continue  # a slot without vectors
                if stored is None:
                    stored, keys, parts = np.concatenate(parts), np.array(ids), []
                    named = pa.array(ids, types[1])
                names = batch.column("q_ids")[at].values
                asked = np.asarray(flat, dtype=np.float64).reshape(len(names), -1)
                row, pos, distance = _group_best(asked, stored, keys, k)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(row)).cast(types[0]), named.take(pa.array(pos)), pa.array(distance)],
                    names=["query_id", "id", "distance"],
                )

    return search


def _grid(stored_bytes: int, asked_bytes: int, tasks: int) -> tuple[int, int]:
    """Groups of vectors and shares of questions: each bounded in bytes, together tasks for every core."""
    groups = max(1, -(-stored_bytes // GROUP_BYTES))
    return groups, max(1, -(-asked_bytes // GROUP_BYTES), -(-3 * tasks // groups))


def _nearest_blocks(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Any number of questions: every share of them meets every group of vectors in one task.

    Groups and shares are bounded in bytes, so that a task holds one group
    whatever the size of the tables. Vectors move once for each share, questions
    once for each group.
    """
    spark = questions.sparkSession
    key, item = questions.schema["query_id"].dataType, vectors.schema["id"].dataType

    def packed(df: DataFrame, name: str, kind) -> DataFrame:
        blocks = df.select(name, "embedding").mapInArrow(
            _pack, f"ids array<{kind.simpleString()}>, flat array<double>"
        )
        return keep(blocks.withColumn("block", F.monotonically_increasing_id()))

    asked, stored = packed(questions, "query_id", key), packed(vectors, "id", item)
    values = F.coalesce(F.sum(F.size("flat")), F.lit(0))
    sizes = [8 * side.agg(values).first()[0] for side in (stored, asked)]
    groups, shares = _grid(*sizes, spark.sparkContext.defaultParallelism)
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slot = (F.col("group") * shares + F.col("share")).alias("slot")

    left = stored.select("ids", "flat", dealt(groups).alias("group"), all_of(shares).alias("share")).select(
        slot, F.lit(False).alias("asked"), F.lit(None).cast(asked.schema["ids"].dataType).alias("q_ids"), "ids", "flat"
    )
    right = asked.select("ids", "flat", dealt(shares).alias("share"), all_of(groups).alias("group")).select(
        slot, F.lit(True).alias("asked"), F.col("ids").alias("q_ids"),
        F.lit(None).cast(stored.schema["ids"].dataType).alias("ids"), "flat",
    )
    met = left.unionByName(right).repartitionById(groups * shares, F.col("slot")).sortWithinPartitions("slot", "asked")
    found = met.mapInArrow(
        _group_search(k, (to_arrow_type(key), to_arrow_type(item))),
        f"query_id {key.simpleString()}, id {item.simpleString()}, distance double",
    )
    return _ranked(found, k)


def similarity(distance: Column) -> Column:
    """Score of a hit, 1 for an identical vector."""
    return F.lit(1.0) / (F.lit(1.0) + distance)
