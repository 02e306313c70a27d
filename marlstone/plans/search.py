"""Questions to ranked, source-cited hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.knn import nearest, similarity
from marlstone.operators.render import render_context, render_search
from marlstone.session import keep
from marlstone.streaming.index import ChunkIndex

TOP_K = 5
# Hits have rows of some 200 bytes at most, whatever the chunks hold.
_BROADCAST_HITS = 200_000


def retrieve(index: ChunkIndex, questions: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Hits of every question: query_id, rank, title, ..., text, distance, score.

    ``questions`` is (query_id, question). The vector scan decides the hits
    before any chunk text is read; it is limited to the cells that can hold
    one if :meth:`ChunkIndex.build_cells` has dealt the vectors over cells.
    """
    if not index.exists():
        raise RuntimeError("the index has not been built yet")
    index.check_model()
    asked = questions.select("query_id", index.embedder.embed(F.col("question")).alias("embedding"))
    cells = index.cells()
    found = nearest(asked, index.vectors(), top_k) if cells is None else cells.nearest(keep(asked), top_k)
    # Written once: the vector scan doesn't run again for the text.
    hits = keep(found.withColumnRenamed("id", "chunk_id"))
    chunks = index.chunks().drop("embedding_text")
    if hits.limit(_BROADCAST_HITS + 1).count() <= _BROADCAST_HITS:
        hits = F.broadcast(hits)  # else both sides move by chunk id
    return hits.join(chunks, "chunk_id").select(
        "query_id", "rank", "chunk_id", "title", "heading_path", "url", "source_path", "text",
        "distance", similarity(F.col("distance")).alias("score"),
    )


def question_frame(spark: SparkSession, question: str) -> DataFrame:
    return spark.createDataFrame([(0, question)], "query_id long, question string")


def search_text(index: ChunkIndex, question: str, top_k: int = TOP_K) -> str:
    asked = question_frame(index.spark, question)
    return render_search(asked, retrieve(index, asked, top_k)).first().output


def context_text(index: ChunkIndex, question: str, top_k: int = TOP_K) -> str:
    asked = question_frame(index.spark, question)
    return render_context(asked, retrieve(index, asked, top_k)).first().output
