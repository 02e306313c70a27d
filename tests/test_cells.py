"""Neighbours over cells against the flat search and plain loops."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import cells, knn
from marlstone.operators.cells import CellIndex, build_cells
from marlstone.session import shared_dir

KIND = "id long, embedding array<double>"


def vectors(spark, points, first=0):
    return spark.createDataFrame([(first + i, p.tolist()) for i, p in enumerate(points)], KIND)


def asked(frame):
    return frame.withColumnRenamed("id", "query_id")


def clusters(seed=1, groups=20, each=60, dims=8):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(scale=30, size=dims) + rng.standard_normal((each, dims)) for _ in range(groups)])


def hits(frame):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in frame.collect())


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_cells_give_the_flat_result(spark, shift):
    points = clusters() + shift
    points[5:9] = points[4]  # equal distances go by id
    stored = vectors(spark, points)
    questions = asked(vectors(spark, np.concatenate([points[::40], points[:5] + 0.3, np.zeros((1, 8))]), 9000))
    index = build_cells(stored, shared_dir(spark))
    assert hits(index.nearest(questions, 7)) == hits(knn.nearest(questions, stored, 7))


def test_few_vectors_nulls_and_no_questions(spark):
    stored = vectors(spark, np.eye(3)).unionByName(spark.createDataFrame([(9, None)], KIND))
    index = build_cells(stored, shared_dir(spark), cells=2)
    questions = asked(stored)
    assert hits(index.nearest(questions, 5)) == hits(knn.nearest(questions, stored, 5))
    assert index.nearest(questions.limit(0), 5).count() == 0
    none = build_cells(stored.limit(0), shared_dir(spark))
    assert none.nearest(questions, 5).count() == 0
    with pytest.raises(ValueError):
        index.nearest(questions, 0)


def test_one_cell_holds_most_vectors(spark):
    points = np.concatenate([np.tile([1.0, 2.0], (3000, 1)), np.random.default_rng(2).normal(size=(50, 2))])
    stored = vectors(spark, points)
    index = build_cells(stored, shared_dir(spark), cells=10)
    assert max(c["size"] for c in index.cells()) >= 3000
    assert index.blocks(list(range(10))).where(F.size("ids") > 1024).count() == 0
    questions = asked(vectors(spark, np.array([[1.0, 2.1], [0.0, 0.0]]), 9000))
    assert hits(index.nearest(questions, 4)) == hits(knn.nearest(questions, stored, 4))


def test_a_question_reads_few_files(spark, monkeypatch):
    stored = vectors(spark, clusters(groups=30))
    index = build_cells(stored, shared_dir(spark), cells=30)
    size = lambda frame: sum(os.path.getsize(f.removeprefix("file://")) for f in set(frame.inputFiles()))
    read, plain = set(), CellIndex.blocks

    def blocks(self, cells):
        read.update(cells)
        return plain(self, cells)

    monkeypatch.setattr(CellIndex, "blocks", blocks)
    questions = asked(stored.where("id in (7, 70, 700)")).withColumn("query_id", F.col("query_id") + 9000)
    assert index.nearest(questions, 5).count() == 15
    every = spark.read.parquet(f"{index.path}/blocks")
    files = [f for f in every.inputFiles() if int(f.split("cell=")[1].split("/")[0]) in read]
    assert 3 * sum(os.path.getsize(f.removeprefix("file://")) for f in files) < size(every)
    assert math.isclose(sum(c["size"] for c in index.cells()), 1800)


def test_a_question_moves_once_for_a_group_of_cells(spark, monkeypatch):
    # On a sphere of many dimensions nothing clusters: every question visits most of the 30 cells.
    points = np.random.default_rng(3).standard_normal((900, 24))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    stored = vectors(spark, points)
    index = build_cells(stored, shared_dir(spark), cells=30)
    kept, plain = [], cells.keep
    monkeypatch.setattr(cells, "keep", lambda frame, *path: kept.append(plain(frame, *path)) or kept[-1])
    found = index.nearest(asked(stored), 5)
    assert hits(found) == hits(knn.nearest(asked(stored), stored, 5))
    # Neither a row for each question and cell nor one for each cell of a group is written or shuffled.
    assert max(f.count() for f in kept) <= 5 * 900
    shuffled = [f for f in kept if "visits" in f.columns]
    assert [f.count() for f in shuffled] == [900, 900]
    assert sum(f.select(F.explode("visits")).count() for f in shuffled) <= 2 * 900


@pytest.mark.parametrize("copies", [0, 700])
def test_groups_smaller_than_a_cell(spark, monkeypatch, copies):
    points = np.concatenate([clusters(groups=6), np.tile(np.full(8, 3.0), (copies, 1))])
    stored = vectors(spark, points)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)
    index = build_cells(stored, shared_dir(spark), cells=12)
    monkeypatch.setattr(cells, "GROUP_BYTES", 50 * 8 * 8)
    groups = cells._groups(index.cells(), 1)
    assert max(span for _, span in groups) > 1 and len(cells._members(groups)) >= len(points) // 50
    questions = asked(vectors(spark, np.concatenate([points[::7], points[:9] + 0.4]), 9000))
    assert hits(index.nearest(questions, 6)) == hits(knn.nearest(questions, stored, 6))


def test_groups_and_shares_are_bounded(monkeypatch):
    monkeypatch.setattr(cells, "GROUP_BYTES", 100 * 8 * 2)
    known = [{"cell": i, "size": n, "centre": [float(i % 3) * 50, float(i)]} for i, n in enumerate([30, 40, 250, 30, 60, 5])]
    groups = cells._groups(known, 1)
    held = {g: sum(known[i]["size"] / groups[i][1] for i in at) for g, at in cells._members(groups).items()}
    assert max(held.values()) <= 100 and groups[2][1] == 3
    assert cells._shares({0: 5, 1: 1000}, 2, 4) == {0: 1, 1: 10}  # 1000 questions of 16 bytes, 100 a share
    assert sum(cells._shares({0: 9, 1: 9}, 2, 8).values()) == 2  # few questions do not move vectors more than once


def test_a_question_that_is_not_a_number(spark):
    points = clusters(groups=5)
    stored = vectors(spark, points)
    index = build_cells(stored, shared_dir(spark), cells=10)
    questions = asked(vectors(spark, np.concatenate([points[:2], np.full((1, 8), np.nan)]), 9000))
    near = {(r.query_id, r["rank"]): r.id for r in index.nearest(questions, 4).collect()}
    flat = {(r.query_id, r["rank"]): r.id for r in knn.nearest(questions, stored, 4).collect()}
    assert near == flat and len(near) == 8
