"""Chunking and index diffs over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import query
from marlstone.operators.chunk import chunk_pages, dedupe_chunks
from marlstone.session import small_batches
from marlstone.sources.tables import read_table
from marlstone.streaming.index import added_ids, diff, stale_ids, unchanged_ids

# The words of a text, and its 900-word windows that start every 780 words.
CHUNKS = """
words as (
  select *, trim(text, ' ' || chr(10)) as whole,
         string_split_regex(trim(text, ' ' || chr(10)), '[ \n]+') as w
  from page
  where trim(text, ' ' || chr(10)) <> ''
),
starts as (
  select *, unnest(case when len(w) <= 900 then [0]
                        else range(0, cast(ceil((len(w) - 900) / 780.0) as bigint) * 780 + 1, 780)
                   end) as start
  from words
),
chunk as (
  select * exclude (text, w, whole, start), cast(start / 780 as int) as part_index,
         case when len(w) <= 900 then whole
              else array_to_string(w[start + 1 : start + 900], ' ') end as text
  from starts
)
""".replace("\\n", "\n")
CHUNK_ID = (
    "sha256(source_path || chr(0) || title || chr(0) || cast(part_index as varchar)"
    " || chr(0) || text)"
)
DOCUMENT_PAGES = """page as (
  select doc_id, source || ':' || cast(doc_id as varchar) as source_path, lang as title, text
  from documents
)"""


def document_pages(spark, folder) -> DataFrame:
    small_batches(spark)
    documents = read_table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    return documents.select(
        "doc_id",
        F.concat_ws(":", "source", "doc_id").alias("source_path"),
        F.col("lang").alias("title"),
        F.lit("https://docs.example.com/").alias("url"),
        "text",
    )


def document_chunks(spark, folder) -> DataFrame:
    return chunk_pages(document_pages(spark, folder), keep=("doc_id",))


@query(
    "chunk_words",
    f"""with {DOCUMENT_PAGES}, {CHUNKS}
    select doc_id, part_index, text,
           'Title: ' || title || chr(10) || 'Heading: ' || title || chr(10) || chr(10) || text
             as embedding_text
    from chunk""",
)
def chunk_words(spark, folder):
    return document_chunks(spark, folder).select("doc_id", "part_index", "text", "embedding_text")


@query(
    "chunk_ids",
    f"with {DOCUMENT_PAGES}, {CHUNKS} select doc_id, part_index, {CHUNK_ID} as chunk_id from chunk",
)
def chunk_ids(spark, folder):
    return document_chunks(spark, folder).select("doc_id", "part_index", "chunk_id")


@query(
    "dedupe_chunks",
    f"""with page as (select lang as source_path, lang as title, text from documents), {CHUNKS}
    select distinct {CHUNK_ID} as chunk_id, title, title as heading_path, text from chunk""",
)
def deduped_chunks(spark, folder):
    # Pages of one language share a path here, so exact copies share their ids.
    pages = document_pages(spark, folder).withColumn("source_path", F.col("title"))
    return dedupe_chunks(chunk_pages(pages)).select("chunk_id", "title", "heading_path", "text")


# The second state of the corpus: toxic documents are gone, low quality ones
# were rewritten, conversations are new.
REVISED_PAGES = """page as (
  select source || ':' || cast(d.doc_id as varchar) as source_path, lang as title,
         case when quality = 0 then text || ' (revised)' else text end as text
  from documents d left join labels l on d.doc_id = l.doc_id
  where coalesce(toxic, 0) = 0
  union all
  select 'chat:' || cast(conv_id as varchar) || '/' || cast(turn as varchar), role, text
  from conversations
)"""
TWO_STATES = f"""
old as (with {DOCUMENT_PAGES}, {CHUNKS} select distinct {CHUNK_ID} as chunk_id from chunk),
new as (with {REVISED_PAGES}, {CHUNKS} select distinct {CHUNK_ID} as chunk_id from chunk)
"""


def revised_pages(spark, folder) -> DataFrame:
    labels = read_table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    revised = (
        document_pages(spark, folder)
        .join(labels, "doc_id", "left")
        .where(F.coalesce("toxic", F.lit(0)) == 0)
        .withColumn(
            "text",
            F.when(F.col("quality") == 0, F.concat("text", F.lit(" (revised)"))).otherwise(
                F.col("text")
            ),
        )
    )
    chats = read_table(spark, folder, "conversations").select(
        F.concat(F.lit("chat:"), F.concat_ws("/", "conv_id", "turn")).alias("source_path"),
        F.col("role").alias("title"),
        F.lit("https://docs.example.com/").alias("url"),
        "text",
    )
    columns = ("source_path", "title", "url", "text")
    return revised.select(*columns).unionByName(chats)


def two_states(spark, folder) -> tuple[DataFrame, DataFrame]:
    """(wanted chunks, stored ids)."""
    stored = dedupe_chunks(document_chunks(spark, folder).select("chunk_id"))
    return chunk_pages(revised_pages(spark, folder)), stored


@query("sync_added", f"with {TWO_STATES} select chunk_id from new where chunk_id not in (select chunk_id from old)")
def sync_added(spark, folder):
    return added_ids(*two_states(spark, folder))


@query("sync_removed", f"with {TWO_STATES} select chunk_id from old where chunk_id not in (select chunk_id from new)")
def sync_removed(spark, folder):
    return stale_ids(*two_states(spark, folder))


@query("sync_unchanged", f"with {TWO_STATES} select chunk_id from new where chunk_id in (select chunk_id from old)")
def sync_unchanged(spark, folder):
    return unchanged_ids(*two_states(spark, folder))


OPS = f"""with {TWO_STATES}
select coalesce(new.chunk_id, old.chunk_id) as chunk_id,
       case when old.chunk_id is null then 'add' when new.chunk_id is null then 'drop' else 'keep'
       end as op
from new full outer join old on new.chunk_id = old.chunk_id"""


@query("sync_changes", OPS)
def sync_changes(spark, folder):
    wanted, stored = two_states(spark, folder)
    return diff(dedupe_chunks(wanted), stored).select("chunk_id", "op")


@query("sync_counts", f"select op, count(*) as n from ({OPS}) group by op")
def sync_counts(spark, folder):
    return sync_changes(spark, folder).groupBy("op").agg(F.count("*").alias("n"))


@query(
    "sync_snapshot",
    f"""with {REVISED_PAGES}, {CHUNKS}
    select distinct {CHUNK_ID} as chunk_id, source_path, title, text from chunk""",
)
def sync_snapshot(spark, folder):
    """Index contents after the sync: kept plus added chunks."""
    wanted, stored = two_states(spark, folder)
    kept = diff(dedupe_chunks(wanted), stored).where(F.col("op") != "drop")
    return kept.select("chunk_id", "source_path", "title", "text")


@query(
    "corpus_counts",
    f"""with {DOCUMENT_PAGES}, {CHUNKS}
    select split_part(source_path, ':', 1) as source, count(distinct doc_id) as files,
           count(*) as chunks, max(part_index) + 1 as most_parts
    from chunk group by 1""",
)
def corpus_counts(spark, folder):
    chunks = document_chunks(spark, folder).select(
        "doc_id", "part_index", F.substring_index("source_path", ":", 1).alias("source")
    )
    # Parts of one document count first, so a large source is one light row per
    # document by the time it meets its group.
    per_document = chunks.groupBy("source", "doc_id").agg(
        F.count("*").alias("chunks"), F.max("part_index").alias("last")
    )
    return per_document.groupBy("source").agg(
        F.count("*").alias("files"),
        F.sum("chunks").alias("chunks"),
        (F.max("last") + 1).alias("most_parts"),
    )
