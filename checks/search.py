"""Embedding, nearest neighbours and rendered answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import query
from checks.documents import CHUNK_ID, CHUNKS, DOCUMENT_PAGES, document_chunks
from marlstone.functions.embedding import HashedWords
from marlstone.operators.cells import build_cells
from marlstone.operators.knn import nearest, similarity
from marlstone.operators.render import render_context, render_search, results_from_response
from marlstone.session import shared_dir
from marlstone.sources.tables import read_table

TOP_K = 5
EMBEDDER = HashedWords(256)


def _weights(name: str, source: str, key: str, text: str) -> str:
    """(key, bucket, weight as the stored float) of every text in ``source``."""
    return f"""
{name}_counts as (
  select {key}, bucket, count(*) as n from (
    select {key}, cast('0x' || substr(md5(unnest(
      regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'))), 1, 4) as int) % 256 as bucket
    from {source})
  group by all
),
{name} as (
  select {key}, bucket,
    cast(n / sqrt(sum(n * n) over (partition by {key})) as float)::double as weight
  from {name}_counts
)"""


EMBEDDED = f"""{DOCUMENT_PAGES}, {CHUNKS},
embedded as (
  select *, {CHUNK_ID} as chunk_id,
    'Title: ' || title || chr(10) || 'Heading: ' || title || chr(10) || chr(10) || text as embedding_text
  from chunk
), {_weights('stored', 'embedded', 'chunk_id', 'embedding_text')}"""


@query(
    "embed_hash",
    f"with {EMBEDDED} select chunk_id, bucket, round(weight, 6) as weight from stored",
)
def embed_hash(spark, folder):
    vectors = document_chunks(spark, folder).select(
        "chunk_id", EMBEDDER.embed(F.col("embedding_text")).alias("v")
    )
    return (
        vectors.select("chunk_id", F.posexplode("v").alias("bucket", "weight"))
        .where(F.col("weight") != 0)
        .withColumn("weight", F.round(F.col("weight").cast("double"), 6))
    )


# Squared distance over the buckets either side uses.
NEAREST_TEXT = f"""{EMBEDDED}, {_weights('asked', 'benchmark', 'item_id', 'text')},
dots as (
  select item_id, chunk_id, sum(a.weight * s.weight) as dot
  from asked a join stored s using (bucket) group by all
),
asked_sq as (select item_id, sum(weight * weight) as sq from asked group by all),
stored_sq as (select chunk_id, sum(weight * weight) as sq from stored group by all),
distances as (
  select q.item_id, c.chunk_id, greatest(q.sq + c.sq - 2 * coalesce(dot, 0), 0) as distance
  from asked_sq q cross join stored_sq c left join dots using (item_id, chunk_id)
),
hits as (
  select item_id, chunk_id, distance,
    cast(row_number() over (partition by item_id order by round(distance, 9), chunk_id) as int) as rank
  from distances
  qualify rank <= {TOP_K}
)"""


def text_hits(spark, folder) -> DataFrame:
    chunks = document_chunks(spark, folder)
    stored = chunks.select(
        F.col("chunk_id").alias("id"), EMBEDDER.embed(F.col("embedding_text")).alias("embedding")
    )
    asked = read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), EMBEDDER.embed(F.col("text")).alias("embedding")
    )
    return nearest(asked, stored, TOP_K).withColumnRenamed("id", "chunk_id")


@query(
    "search_text_batch",
    f"""with {NEAREST_TEXT}
    select item_id, rank, chunk_id, round(distance, 6) as distance,
           round(1 / (1 + distance), 6) as score
    from hits""",
)
def search_text_batch(spark, folder):
    return text_hits(spark, folder).select(
        F.col("query_id").alias("item_id"),
        "rank",
        "chunk_id",
        F.round("distance", 6).alias("distance"),
        F.round(similarity(F.col("distance")), 6).alias("score"),
    )


def cited_hits(spark, folder) -> DataFrame:
    """Hits with the text they cite, ready to render."""
    hits = text_hits(spark, folder)
    chunks = document_chunks(spark, folder)
    return hits.join(chunks, "chunk_id").withColumn("score", similarity(F.col("distance")))


RESULTS = f"""{NEAREST_TEXT},
cited as (
  select item_id, rank, 1 / (1 + distance) as score, title, source_path,
         regexp_replace(text, '[ ' || chr(10) || ']+', ' ', 'g') as excerpt
  from hits join embedded using (chunk_id)
)"""


@query(
    "search_render",
    f"""with {RESULTS}
    select item_id, string_agg('[' || cast(rank as varchar) || '] ' || title || chr(10) || 'Heading: ' || title
      || chr(10) || 'URL: https://docs.example.com/' || chr(10) || 'Source: ' || source_path || chr(10)
      || 'Score: ' || printf('%.4f', score) || chr(10) || 'Excerpt: ' || excerpt,
      chr(10) || chr(10) order by rank) as output
    from cited group by item_id""",
)
def search_render(spark, folder):
    asked = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"))
    return render_search(asked, cited_hits(spark, folder)).withColumnRenamed("query_id", "item_id")


@query(
    "context_render",
    f"""with {RESULTS}
    select item_id, 'Question: ' || any_value(b.text) || chr(10) || chr(10) || 'Relevant XRPL docs:' || chr(10)
      || string_agg('[' || cast(rank as varchar) || '] ' || title || chr(10) || 'Heading: ' || title || chr(10)
         || 'URL: https://docs.example.com/' || chr(10) || 'Excerpt: ' || excerpt,
         chr(10) || chr(10) order by rank) as output
    from cited join benchmark b using (item_id) group by item_id""",
)
def context_render(spark, folder):
    asked = read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    return render_context(asked, cited_hits(spark, folder)).withColumnRenamed("query_id", "item_id")


def _knn(questions: str) -> str:
    return f"""
pairs as (
  select q.vec_id as query_id, v.vec_id as id,
    list_sum(list_transform(list_zip(q.embedding, v.embedding),
      lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as distance
  from {questions} q cross join embeddings v
),
hits as (
  select *, cast(row_number() over (partition by query_id order by round(distance, 9), id) as int) as rank
  from pairs qualify rank <= {TOP_K}
)"""


def _vector_hits(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    asked = questions.select(F.col("vec_id").alias("query_id"), "embedding")
    stored = vectors.select(F.col("vec_id").alias("id"), "embedding")
    return nearest(asked, stored, TOP_K).select(
        "query_id", "id", "rank", F.round("distance", 6).alias("distance"),
        F.round(similarity(F.col("distance")), 6).alias("score"),
    )


_HIT = "select query_id, id, rank, round(distance, 6) as distance, round(1 / (1 + distance), 6) as score from hits"


@query("knn_batch", f"with {_knn('embeddings')} {_HIT}")
def knn_batch(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    return _vector_hits(vectors, vectors)


@query("knn_cells", f"with {_knn('embeddings')} {_HIT}")
def knn_cells(spark, folder):
    """The neighbours of ``knn_batch``, from cells of vectors instead of all of them."""
    vectors = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = build_cells(vectors, shared_dir(spark))
    found = index.nearest(vectors.withColumnRenamed("id", "query_id"), TOP_K)
    return found.select(
        "query_id", "id", "rank", F.round("distance", 6).alias("distance"),
        F.round(similarity(F.col("distance")), 6).alias("score"),
    )


@query(
    "knn_centroids",
    f"""with dims as (
      select label, pos, avg(x::double) as x from (
        select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings)
      group by all
    ),
    centroid as (
      select label::bigint as vec_id, list(cast(round(x, 4) as float) order by pos) as embedding
      from dims group by label
    ), {_knn('centroid')} {_HIT}""",
)
def knn_centroids(spark, folder):
    """One question per label: its mean vector."""
    vectors = read_table(spark, folder, "embeddings")
    dims = vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = dims.groupBy("label", "pos").agg(
        F.round(F.avg(F.col("x").cast("double")), 4).cast("float").alias("x")
    )
    # One row per label and dimension is left to collect.
    centroids = means.groupBy(F.col("label").cast("bigint").alias("vec_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(
            "embedding"
        )
    )
    return _vector_hits(centroids, vectors)


@query(
    "response_map",
    """with lines as (
      select conv_id, turn, role, unnest(string_split(text, chr(10))) as line,
             generate_subscripts(string_split(text, chr(10)), 1) as n,
             len(string_split(text, chr(10))) as size
      from conversations
    )
    select conv_id, turn, cast(n as int) as rank,
      case when n % 3 = 0 then 'Untitled' else role end as title,
      case when n % 2 = 0 then '' else role || ' > ' || cast(n as varchar) end as heading_path,
      '' as url, 'chat/' || cast(conv_id as varchar) as source_path,
      case when n % 4 = 1 then 'meta ' || line when n < size then line else '' end as text,
      round(1 / (1 + case when n * 2 <= size then n / 8.0 else 1.0 end), 6) as score
    from lines""",
)
def response_map(spark, folder):
    """Store responses with one hit per line of a message, some fields missing."""
    turns = read_table(spark, folder, "conversations")
    lines, role = F.split("text", "\n"), F.col("role")

    def metadata(line, i):
        n = i + 1
        entry = lambda key, value: F.struct(F.lit(key).alias("k"), value.alias("v"))
        entries = F.array(
            F.when(n % 3 != 0, entry("title", role)),
            F.when(n % 2 != 0, entry("heading_path", F.concat_ws(" > ", role, n.cast("string")))),
            entry("source_path", F.concat_ws("/", F.lit("chat"), "conv_id")),
            entry("text", F.when(n % 4 == 1, F.concat(F.lit("meta "), line)).otherwise("")),
        )
        return F.map_from_entries(F.array_compact(entries))

    half = F.floor(F.size(lines) / 2).cast("int")
    responses = turns.select(
        F.struct("conv_id", "turn").alias("query_id"),
        F.transform(lines, metadata).alias("metadatas"),
        F.slice(lines, F.lit(1), F.size(lines) - 1).alias("documents"),
        F.transform(F.slice(lines, F.lit(1), half), lambda _, i: (i + 1) / 8.0).alias("distances"),
    )
    mapped = results_from_response(responses).withColumn("score", F.round("score", 6))
    return mapped.select("query_id.*", *mapped.columns[1:])


@query(
    "knn_large_norms",
    f"with {_knn('embeddings').replace('p[1]::double', '(p[1]::double + 1048576)').replace('p[2]::double', '(p[2]::double + 1048576)')} {_HIT}",
)
def knn_large_norms(spark, folder):
    """The same neighbours far from the origin, with vectors of double."""
    vectors = read_table(spark, folder, "embeddings").withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") + 1048576)
    )
    return _vector_hits(vectors, vectors)
