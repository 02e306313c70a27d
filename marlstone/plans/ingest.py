"""Sources to an up-to-date index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.config import CorpusConfig
from marlstone.functions.embedding import Embedder, embedder_for
from marlstone.operators.chunk import chunk_pages
from marlstone.functions.paths import parts
from marlstone.operators.parse import bad_files, good_pages, parse_files
from marlstone.sources.catalog import SITE_TITLE_SUFFIX, Source, sources_for_ingest
from marlstone.sources.checkout import ensure_checkout
from marlstone.sources.files import document_files, read_contents, tasks_for
from marlstone.sources.web import ensure_mirror
from marlstone.streaming.index import ChunkIndex, SyncResult


@dataclass(frozen=True)
class IngestResult:
    sync: SyncResult
    files: int
    bad_files: int
    sources: int
    # The first few bad files (source, path, reason), and the table that has them all.
    bad_examples: tuple[tuple[str, str, str], ...] = ()
    bad_table: str | None = None


def acquire(spark: SparkSession, source: Source, update: bool) -> str:
    """Bring a source's files to its local folder."""
    if source.llms_txt_url:
        return ensure_mirror(spark, source.path, source.llms_txt_url, source.url_base, update)
    return ensure_checkout(source.path, source.repo_url, update)


def source_files(spark: SparkSession, source: Source, root: str, rank: int = 0) -> tuple[DataFrame, int]:
    """Contents of a source's documents, and how many there are.

    The listing runs once for the count and again as the input of the read; it
    touches names and sizes only.
    """
    listing = document_files(spark, root, source.file_suffixes, source.include_parts)
    totals = listing.agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).first()
    if not totals.files:
        raise RuntimeError(f"No supported docs files found under {root}")
    contents = read_contents(listing, root, tasks_for(spark, totals.bytes or 0))
    described = contents.select(
        # Of chunks with one id the last in this order counts.
        F.struct(F.lit(rank).alias("source"), parts(F.col("rel_path")).alias("path")).alias("position"),
        F.lit(source.name).alias("source_name"),
        "rel_path",
        "content",
        F.lit(source.url_base).alias("url_base"),
        F.lit(source.source_url_base).cast("string").alias("source_url_base"),
        F.lit(source.prefix_source_path).alias("prefix_source_path"),
    )
    return described, totals.files


def ingest(
    spark: SparkSession,
    config: CorpusConfig,
    update: bool = True,
    single_source: bool = False,
    embedder: Embedder | None = None,
    sources: tuple[Source, ...] | None = None,
    acquire: Callable[[SparkSession, Source, bool], str] = acquire,
) -> IngestResult:
    """Scan every source and sync the index to the chunks found.

    Stale chunks are only dropped when the whole catalog was scanned.
    """
    if sources is None:
        sources = sources_for_ingest(config, single_source)
    scans = [source_files(spark, s, acquire(spark, s, update), i) for i, s in enumerate(sources)]
    files = reduce(DataFrame.unionByName, (scan for scan, _ in scans))

    parsed = parse_files(files, main_source=sources[0].name, site_suffix=SITE_TITLE_SUFFIX)
    index = ChunkIndex(
        spark, config.db_path, config.collection_name, embedder or embedder_for(config.embedding_model)
    )
    # Readers run once more for the report only if the sync saw a bad file.
    seen = Observation()
    watched = parsed.observe(seen, F.count("error").alias("bad"))
    chunks = chunk_pages(good_pages(watched), keep=("position",))
    result = index.sync(chunks, delete_stale=not single_source)
    bad, examples, table = seen.get["bad"], (), None
    if bad:
        table = f"{index.base}/bad_files"
        bad_files(parsed).orderBy("source_name", "source_path").write.mode("overwrite").json(table)
        rows = spark.read.schema("source_name string, source_path string, error string").json(table)
        examples = tuple(tuple(r) for r in rows.orderBy("source_name", "source_path").limit(20).collect())
    return IngestResult(result, sum(count for _, count in scans), bad, len(sources), examples, table)
