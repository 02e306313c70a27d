"""The incremental index and the searches over it."""

import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.functions.embedding import HashedWords, SentenceModel, embedder_for
from marlstone.operators import knn, render
from marlstone.operators.chunk import chunk_pages
from marlstone.plans.search import context_text, retrieve, search_text
from marlstone.sources.store import Store
from marlstone.streaming.index import ChunkIndex, CommitConflict, diff

PAGE = "source_path string, title string, url string, text string"


def chunks(spark, pages):
    rows = [(path, path.upper(), f"https://x/{path}", text) for path, text in pages.items()]
    return chunk_pages(spark.createDataFrame(rows, PAGE))


def open_index(spark, tmp_path, embedder=HashedWords(64)):
    return ChunkIndex(spark, str(tmp_path), "docs", embedder)


class Broken:
    """An embedder that must not be asked."""

    name = HashedWords(64).name

    def embed(self, text):
        @F.arrow_udf("array<float>")
        def fail(texts: pa.Array) -> pa.Array:
            raise AssertionError("embedded a stored chunk")

        return fail(text)


def test_sync_embeds_only_new_chunks(spark, tmp_path):
    index = open_index(spark, tmp_path)
    first = {"a": "still water", "b": "running water", "c": "deep water"}
    assert index.sync(chunks(spark, first)) .__dict__ == {"added": 3, "removed": 0, "unchanged": 0}
    # Nothing new: the embedder is never called, nothing is committed.
    same = open_index(spark, tmp_path, Broken()).sync(chunks(spark, first))
    assert (same.added, same.removed, same.unchanged) == (0, 0, 3)
    assert len(index.commits()) == 1

    second = {"a": "still water", "b": "dry ground", "d": "open sea"}
    result = index.sync(chunks(spark, second))
    assert (result.added, result.removed, result.unchanged, result.total) == (2, 2, 1, 3)
    stored = {r.source_path: r.text for r in index.chunks().collect()}
    assert stored == second
    assert index.count() == index.ids().count() == index.vectors().count() == 3

    # A dropped chunk can come back, and is embedded again.
    back = index.sync(chunks(spark, first))
    assert (back.added, back.removed, back.unchanged) == (2, 2, 1)
    assert {r.source_path: r.text for r in index.chunks().collect()} == first


def test_stale_chunks_can_be_kept(spark, tmp_path):
    index = open_index(spark, tmp_path)
    index.sync(chunks(spark, {"keep": "k", "stale": "s"}))
    result = index.sync(chunks(spark, {"keep": "k", "new": "n"}), delete_stale=False)
    assert (result.added, result.removed, result.unchanged) == (1, 0, 1)
    assert index.count() == 3 == index.ids().count()


def test_upsert_replaces_rows_of_the_same_id(spark, tmp_path):
    index = open_index(spark, tmp_path)
    index.sync(chunks(spark, {"a": "x", "b": "y"}))
    changed = chunks(spark, {"a": "x", "c": "z"}).withColumn("title", F.lit("New title"))
    result = index.upsert(changed)
    assert (result.added, result.removed) == (2, 1)
    titles = {r.source_path: r.title for r in index.chunks().collect()}
    assert titles == {"a": "New title", "b": "B", "c": "New title"}
    assert index.vectors().count() == index.count() == 3


def test_unfinished_batches_stay_invisible(spark, tmp_path):
    index = open_index(spark, tmp_path)
    index.sync(chunks(spark, {"a": "x"}))

    class Failing(Broken):
        name = HashedWords(64).name

    with pytest.raises(Exception, match="embedded a stored chunk"):
        open_index(spark, tmp_path, Failing()).sync(chunks(spark, {"b": "y"}))
    assert [r.source_path for r in index.chunks().collect()] == ["a"]
    # Vectors left by a run that failed before its commit.
    leftover = chunks(spark, {"zombie": "z"}).select(
        "chunk_id", HashedWords(64).embed(F.col("text")).alias("embedding")
    )
    leftover.write.mode("overwrite").parquet(f"{index.base}/vectors/batch=2")
    assert index.vectors().count() == 1
    index.sync(chunks(spark, {"a": "x", "b": "y"}))
    index.sync(chunks(spark, {"b": "y"}))
    assert index.vectors().count() == index.count() == 1


def test_an_empty_scan_or_another_model_is_refused(spark, tmp_path):
    index = open_index(spark, tmp_path)
    index.sync(chunks(spark, {"a": "x"}))
    with pytest.raises(RuntimeError, match="No indexable docs chunks"):
        index.sync(chunks(spark, {"a": " "}))
    assert index.count() == 1
    with pytest.raises(RuntimeError, match="holds vectors of"):
        open_index(spark, tmp_path, HashedWords(8)).sync(chunks(spark, {"a": "x"}))


def test_diff_shuffles_the_chunks_once(spark, tmp_path):
    frame = spark.range(10).select(
        F.col("id").cast("string").alias("chunk_id"), F.lit("t").alias("text")
    )
    ids = spark.range(5, 15).select(F.col("id").cast("string").alias("chunk_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flagged = diff(frame.dropDuplicates(["chunk_id"]), ids)
        plan = flagged._jdf.queryExecution().executedPlan().toString()
        counts = {r.op: r["count"] for r in flagged.groupBy("op").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(chunk_id") == 2
    assert counts == {"add": 5, "keep": 5, "drop": 5}


def test_hashed_words(spark):
    texts = ["One two, two", "", "½ é_1", "two one two"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [np.array(r.v) for r in frame.select("i", HashedWords(16).embed(F.col("t")).alias("v")).orderBy("i").collect()]
    assert all(len(v) == 16 for v in got)
    assert [round(float((v * v).sum()), 5) for v in got] == [1, 0, 1, 1]
    assert np.allclose(got[0], got[3])
    assert embedder_for("hashed-words-16") == HashedWords(16)
    assert embedder_for("some/model") == SentenceModel("some/model")


def test_nearest_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    stored = rng.integers(-2, 3, size=(300, 4)).astype("float32")  # many ties
    asked = stored[:20] + rng.normal(0, 0.01, size=(20, 4)).astype("float32")
    asked[0] = stored[5]
    schema = "{} {}, embedding array<float>"
    vectors = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(stored)], schema.format("id", "string")).repartition(5)
    questions = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], schema.format("query_id", "long"))
    expected = set()
    for i, q in enumerate(asked.astype("float64")):
        distance = ((stored.astype("float64") - q) ** 2).sum(axis=1)
        best = sorted((d, f"v{n:03}") for n, d in enumerate(distance))[:7]
        expected |= {(i, rank, name) for rank, (_, name) in enumerate(best, 1)}

    def found():
        rows = knn.nearest(questions, vectors, 7).collect()
        assert all(r.distance >= 0 for r in rows)
        return {(r.query_id, r.rank, r.id) for r in rows}

    assert found() == expected
    # Too many questions to ship whole: the keyed block join gives the same.
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 64)
    assert found() == expected
    assert knn.nearest(questions.limit(0), vectors, 7).count() == 0
    with pytest.raises(ValueError):
        knn.nearest(questions, vectors, 0)


def test_blocks_of_questions_meet_groups_of_vectors(spark, monkeypatch):
    """No side is broadcast; a task holds a bounded group, whose parts and ties give the flat result."""
    rng = np.random.default_rng(5)
    points = rng.integers(-3, 4, size=(700, 3)) + 1e6
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [float("nan")] * 3)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asked = vectors.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    keys = ("query_id", "rank", "id", "distance")
    hits = lambda frame: sorted(tuple(r[c] for c in keys) for r in frame.where("query_id < 900").collect())
    found = hits(knn.nearest(asked, vectors.where("id < 900"), 4))
    monkeypatch.setattr(knn, "BROADCAST_QUESTIONS", 0)
    blocks = knn.nearest(asked, vectors, 4)
    assert "Broadcast" not in blocks._jdf.queryExecution().executedPlan().toString()
    assert hits(blocks) == found
    monkeypatch.setattr(knn, "GROUP_BYTES", 4000)
    assert knn._grid(700 * 24, 234 * 24, 4) == (5, 3)
    assert hits(knn.nearest(asked, vectors, 4)) == found


@pytest.mark.parametrize("size", [3, 500])
def test_parts_of_a_group_give_the_nearest(monkeypatch, size):
    monkeypatch.setattr(knn, "STORED_PART", 37)
    monkeypatch.setattr(knn, "PAIR_VALUES", 50)
    rng = np.random.default_rng(6)
    stored = rng.integers(-3, 4, size=(size, 3)) + 1e6
    asked, ids = stored[:40] + 0.25, rng.permutation(size)
    row, pos, distance = knn._group_best(asked, stored, ids, 4)
    found = list(zip(row.tolist(), distance.tolist(), ids[pos].tolist()))
    want = []
    for q, point in enumerate(asked):
        far = ((stored - point) ** 2).sum(axis=1)
        want += [(q, d, i) for d, i in sorted(zip(far.tolist(), ids.tolist()))[:4]]
    assert found == want


def test_search_and_context(spark, tmp_path):
    index = open_index(spark, tmp_path)
    with pytest.raises(RuntimeError, match="not been built"):
        search_text(index, "anything")
    pages = {"ponds": "# Filling\n\nFill  the pond\nwith water.", "roads": "Cars on roads.", "sea": "Salt water sea."}
    index.sync(chunks(spark, pages))
    text = search_text(index, "fill the pond with water", 2)
    blocks = text.split("\n\n")
    assert len(blocks) == 2
    lines = blocks[0].split("\n")
    assert lines[0] == "[1] PONDS" and lines[1] == "Heading: Filling"
    assert lines[2] == "URL: https://x/ponds" and lines[3] == "Source: ponds"
    assert lines[4].startswith("Score: 0.") and len(lines[4].split(".")[1]) == 4
    assert lines[5] == "Excerpt: Fill the pond with water."
    context = context_text(index, "fill the pond with water", 1)
    assert context == (
        "Question: fill the pond with water\n\nRelevant XRPL docs:\n[1] PONDS\nHeading: Filling\n"
        "URL: https://x/ponds\nExcerpt: Fill the pond with water."
    )
    many = spark.createDataFrame([(i, p) for i, p in enumerate(pages.values())], "query_id long, question string")
    hits = retrieve(index, many, 3).collect()
    assert len(hits) == 9 and {r.source_path for r in hits if r.rank == 1} == set(pages)
    assert all(abs(r.score - 1 / (1 + r.distance)) < 1e-12 for r in hits)


def test_search_scans_vectors_once(spark, tmp_path):
    index = open_index(spark, tmp_path)
    index.sync(chunks(spark, {"a": "x", "b": "y"}))
    asked = spark.createDataFrame([(0, "x")], "query_id long, question string")
    plan = retrieve(index, asked, 1)._jdf.queryExecution().executedPlan().toString()
    assert "/vectors" not in plan and "BroadcastHashJoin" in plan and "RoundRobin" not in plan


def test_cells_change_no_answer(spark, tmp_path):
    index = open_index(spark, tmp_path)
    index.sync(chunks(spark, {f"p{i}": f"word{i} word{i % 7} common" for i in range(40)}))
    asked = spark.createDataFrame([(0, "word3 common"), (1, "word11"), (2, "nothing of it")], "query_id long, question string")
    answer = lambda: sorted(map(tuple, retrieve(index, asked, 5).select("query_id", "rank", "chunk_id", "distance").collect()))
    flat = answer()
    assert index.cells() is None
    index.build_cells(6)
    assert sum(c["size"] for c in index.cells().cells()) == 40
    assert answer() == flat
    index.sync(chunks(spark, {"p1": "word1 word1 common"}))
    assert index.cells() is None and {r[2] for r in answer()} == {r.chunk_id for r in index.ids().collect()}


def test_compaction_changes_no_answer(spark, tmp_path):
    index = open_index(spark, tmp_path)
    for step in range(3):
        index.sync(chunks(spark, {f"p{n}": f"text {n} {step if n == step else ''}" for n in range(step, step + 4)}))
    index.upsert(chunks(spark, {"p4": "text 4"}))
    asked = spark.createDataFrame([(0, "text 4"), (1, "text 3 5")], "query_id long, question string")

    def state():
        hits = [tuple(r) for r in retrieve(index, asked, 3).orderBy("query_id", "rank").collect()]
        return hits, index.count(), sorted(r.chunk_id for r in index.ids().collect()), index.vectors().count()

    before, batches = state(), len(index.commits())
    index.compact()
    assert len(index.commits()) == 1 < batches
    assert state() == before
    index.sync(chunks(spark, {"p8": "text 8"}))
    assert index.count() == index.ids().count() == 1 and len(index.commits()) == 2


def test_many_batches_are_rewritten(spark, tmp_path, monkeypatch):
    from marlstone.streaming import index as module

    monkeypatch.setattr(module, "MAX_BATCHES", 2)
    index = open_index(spark, tmp_path)
    for step in range(4):
        index.sync(chunks(spark, {"a": f"t{step}"}))
        assert len(index.commits()) <= 2
    assert [r.text for r in index.chunks().collect()] == ["t3"]


def test_of_equal_ids_the_last_counts(spark, tmp_path):
    page = spark.createDataFrame([("p", "T", "u", "x")], PAGE)
    copies = [
        chunk_pages(page.withColumn("url", F.lit(f"u{n}")).withColumn("position", F.lit(n)), keep=("position",))
        for n in (2, 9, 5)
    ]
    every = copies[0].unionByName(copies[1]).unionByName(copies[2])
    index = open_index(spark, tmp_path)
    index.sync(every)
    assert [r.url for r in index.chunks().collect()] == ["u9"]


def test_an_empty_upsert_changes_nothing(spark, tmp_path):
    index = open_index(spark, tmp_path)
    assert index.upsert(chunks(spark, {"a": " "})).total == 0 and not index.exists()
    index.sync(chunks(spark, {"a": "x"}))
    index.upsert(chunks(spark, {"a": " "}))
    assert index.count() == 1 and len(index.commits()) == 1


def test_an_unchanged_sync_moves_no_text(spark, tmp_path, monkeypatch):
    index = open_index(spark, tmp_path)
    pages = {f"p{n}": f"text {n}" for n in range(20)}
    index.sync(chunks(spark, pages))
    from marlstone.streaming import index as module

    plans, keep = [], module.keep

    def watched(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return keep(frame)

    monkeypatch.setattr(module, "keep", watched)
    monkeypatch.setattr(module.ChunkIndex, "_write", lambda *_: pytest.fail("wrote chunks"))
    assert index.sync(chunks(spark, pages)).unchanged == 20
    [plan] = plans
    # What is dealt out is what the distinct below it has: the id alone.
    lines = plan.splitlines()
    shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert shuffles and not any("text" in lines[i + 1] and "HashAggregate" not in lines[i + 1] for i in shuffles)


def test_knn_takes_any_float_norm_and_null(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for offset, kind in ((1e6, "double"), (1e5, "float")):
        stored = rng.normal(size=(60, 8)) + offset
        stored = stored.astype(np.float32).astype(float) if kind == "float" else stored
        rows = [(i, v.tolist()) for i, v in enumerate(stored)] + [(99, None)]
        vectors = spark.createDataFrame(rows, f"id long, embedding array<{kind}>")
        asked = vectors.withColumnRenamed("id", "query_id")
        want = {}
        for q, point in enumerate(stored):
            distance = ((stored - point) ** 2).sum(axis=1)
            want[q] = [int(i) for i in np.lexsort((np.arange(60), distance))[:5]]
        for limit in (8192, 0):
            monkeypatch.setattr(knn, "BROADCAST_QUESTIONS", limit)
            got = {}
            for r in knn.nearest(asked, vectors, 5).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.id)
            assert got == want, (offset, kind, limit)


def test_scores_print_as_python_prints_them(spark):
    from marlstone.functions.text import four_decimals

    rng = random.Random(4)
    values = [0.12345, 0.03125, 0.00015, 1.0, 0.0, 0.99995, 0.00005, 0.5, 1 / 3, 0.21875, 12.00005, 0.99999]
    values += [rng.randrange(20_000) / 20_000 for _ in range(3000)] + [rng.random() for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", four_decimals(F.col("v")).alias("s"))
    assert [r for r in rows.collect() if r.s != f"{r.v:.4f}"] == []


def test_results_from_response(spark):
    rows = [
        (1, ["doc a", "doc b"], [{"title": "A", "heading_path": "A > B", "url": "u", "source_path": "s", "text": "t"}, {"text": ""}, {}], [0.2, 0.7]),
        (2, [], [], []),
        (3, None, None, None),
    ]
    schema = "query_id long, documents array<string>, metadatas array<map<string,string>>, distances array<double>"
    out = render.results_from_response(spark.createDataFrame(rows, schema)).orderBy("rank").collect()
    assert [(r.query_id, r.title, r.text, r.score) for r in out] == [
        (1, "A", "t", 0.8333333333333334),
        (1, "Untitled", "doc b", 0.5882352941176471),
        (1, "Untitled", "", 0.5),
    ]
    assert (out[0].heading_path, out[0].url, out[0].source_path) == ("A > B", "u", "s")


def test_scores_round_like_python(spark):
    scores = [0.03125, 0.09375, 0.87, 1.0, 0.21875, 1 / 3]
    schema = "query_id long, rank int, title string, heading_path string, url string, source_path string, text string, score double"
    hits = spark.createDataFrame([(i, 1, "", "", "", "", "", s) for i, s in enumerate(scores)], schema)
    asked = spark.createDataFrame([(i,) for i in range(len(scores))], "query_id long")
    out = render.render_search(asked, hits).orderBy("query_id").collect()
    assert [r.output.split("Score: ")[1][:6] for r in out] == [f"{s:.4f}" for s in scores]


def test_a_hot_group_of_copies(spark, tmp_path):
    """A third of all pages are copies of one another under one path."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("source_path"),
        F.lit("T").alias("title"), F.lit("u").alias("url"),
        F.when(F.col("id") % 3 == 0, "same words").otherwise(F.concat(F.lit("text "), "id")).alias("text"),
    )
    index = open_index(spark, tmp_path)
    result = index.sync(chunk_pages(rows))
    assert (result.added, result.removed) == (4001, 0)
    again = index.sync(chunk_pages(rows.where("source_path <> 'hot'")))
    assert (again.added, again.removed, again.unchanged) == (0, 1, 4000)


def test_empty_results_render(spark):
    asked = spark.createDataFrame([(1, "why?")], "query_id long, question string")
    schema = "query_id long, rank int, title string, heading_path string, url string, source_path string, text string, score double"
    none = spark.createDataFrame([], schema)
    assert render.render_search(asked, none).first().output == "No XRPL docs matches found."
    assert render.render_context(asked, none).first().output == (
        "Question: why?\n\nRelevant XRPL docs:\nNo relevant XRPL docs were found."
    )


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    first, second = open_index(spark, tmp_path), open_index(spark, tmp_path)
    first.sync(chunks(spark, {"a": "x"}))
    commit = first._commit

    def overtaken(*row):
        second.sync(chunks(spark, {"a": "x", "c": "z"}))
        commit(*row)

    monkeypatch.setattr(first, "_commit", overtaken)
    with pytest.raises(CommitConflict):
        first.sync(chunks(spark, {"b": "y"}))
    monkeypatch.undo()
    assert {r.source_path for r in first.chunks().collect()} == {"a", "c"}
    assert first.vectors().count() == first.count() == 2
    # The loser tries again on what is there now.
    again = first.sync(chunks(spark, {"b": "y"}))
    assert (again.added, again.removed) == (1, 2)
    assert {r.source_path for r in second.chunks().collect()} == {"b"}


def test_reclaim_leaves_the_live_batches(spark, tmp_path):
    index = open_index(spark, tmp_path)
    index.sync(chunks(spark, {"a": "x", "b": "y"}))
    index.build_cells(2)
    index.sync(chunks(spark, {"a": "x", "c": "z"}))
    index.build_cells(2)

    class Crashing(Broken):
        name = HashedWords(64).name

    with pytest.raises(Exception, match="embedded a stored chunk"):
        open_index(spark, tmp_path, Crashing()).sync(chunks(spark, {"d": "w"}))
    index.compact()
    index.build_cells(2)
    before = {tuple(r) for r in index.chunks().collect()}, {tuple(r)[0] for r in index.vectors().collect()}
    assert index.reclaim() == 0  # everything is young
    # Two replaced batches and the crashed one (no vectors there or half of them), two sets of cells.
    assert index.reclaim(keep_seconds=0) >= 3 + 2 + 2
    store = Store(index.base)
    assert [len(store.folders(t)) for t in ("changes", "vectors", "cells")] == [1, 1, 2]
    assert index.reclaim(keep_seconds=0) == 0
    assert ({tuple(r) for r in index.chunks().collect()}, {tuple(r)[0] for r in index.vectors().collect()}) == before
    assert index.cells() is not None
    assert index.sync(chunks(spark, {"c": "z", "e": "v"})).added == 1
    assert {r.source_path for r in index.chunks().collect()} == {"c", "e"}


def test_a_file_is_created_once(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    for root in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda n: Store(root).create_once("c/1.json", b"%d" % n), range(8)))
        assert won.count(True) == 1
        name = root.removeprefix("file://")
        assert os.listdir(f"{name}/c") == ["1.json"]
        assert open(f"{name}/c/1.json", "rb").read() == b"%d" % won.index(True)
