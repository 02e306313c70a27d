"""Search hits as columns and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import four_decimals, rstrip, squeeze
from marlstone.operators.knn import similarity

# The labels of the printed results.
NO_MATCHES = "No XRPL docs matches found."
CONTEXT_LABEL = "Relevant XRPL docs:"
NO_CONTEXT = "No relevant XRPL docs were found."
UNTITLED = "Untitled"
MISSING_DISTANCE = 1.0

RESULT_COLUMNS = ("title", "heading_path", "url", "source_path", "text", "score")


def results_from_response(responses: DataFrame) -> DataFrame:
    """Raw store responses to one row per hit.

    ``responses`` has query_id and the parallel arrays metadatas
    (map<string,string>), documents and distances of that query. The metadata
    list decides how many hits there are; shorter lists are padded.
    """
    hit = F.posexplode(F.coalesce("metadatas", F.array().cast("array<map<string,string>>")))
    rows = responses.select(
        "query_id", "documents", "distances", hit.alias("position", "metadata")
    )
    at = lambda name: F.get(F.col(name), F.col("position"))
    field = lambda name, default: F.coalesce(
        F.try_element_at("metadata", F.lit(name)), F.lit(default)
    )
    return rows.select(
        "query_id",
        (F.col("position") + 1).alias("rank"),
        field("title", UNTITLED).alias("title"),
        field("heading_path", "").alias("heading_path"),
        field("url", "").alias("url"),
        field("source_path", "").alias("source_path"),
        F.coalesce(
            F.nullif(F.try_element_at("metadata", F.lit("text")), F.lit("")),
            at("documents"),
            F.lit(""),
        ).alias("text"),
        similarity(F.coalesce(at("distances"), F.lit(MISSING_DISTANCE))).alias("score"),
    )


def search_block(rank: Column) -> Column:
    return F.format_string(
        "[%d] %s\nHeading: %s\nURL: %s\nSource: %s\nScore: %s\nExcerpt: %s",
        rank, F.col("title"), F.col("heading_path"), F.col("url"), F.col("source_path"),
        four_decimals(F.col("score")), squeeze(F.col("text")),
    )


def context_block(rank: Column) -> Column:
    return F.format_string(
        "[%d] %s\nHeading: %s\nURL: %s\nExcerpt: %s",
        rank, F.col("title"), F.col("heading_path"), F.col("url"), squeeze(F.col("text")),
    )


def _joined(hits: DataFrame, block: Column) -> DataFrame:
    """Blocks of each query in rank order; a query has at most top_k of them."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    text = F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n")
    return hits.groupBy("query_id").agg(text.alias("blocks"))


def render_search(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, output: the ranked result text of every query."""
    blocks = _joined(hits, search_block(F.col("rank")))
    return queries.join(blocks, "query_id", "left").select(
        "query_id", F.coalesce("blocks", F.lit(NO_MATCHES)).alias("output")
    )


def render_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, output: the prompt-ready context of every query.

    ``queries`` has query_id and question.
    """
    blocks = _joined(hits, context_block(F.col("rank")))
    head = F.concat(F.lit("Question: "), F.col("question"), F.lit(f"\n\n{CONTEXT_LABEL}\n"))
    return queries.join(blocks, "query_id", "left").select(
        "query_id",
        F.concat(
            head, F.coalesce(rstrip(F.col("blocks")), F.lit(NO_CONTEXT))
        ).alias("output"),
    )
