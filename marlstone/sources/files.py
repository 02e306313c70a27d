"""Document and source trees as DataFrames.

Listings come from the data source of ``sources.tree``: its planner opens just
enough folders to give the cluster work, executors walk the rest and read the
contents. Roots are paths that every executor sees, or URIs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import paths
from marlstone.functions import text as tx
from marlstone.sources.tree import Tree, read_tree

# Skipped folders and suffixes of documents and of code.
SKIP_DIRS = (".git", ".gitbook", ".next", ".venv", "assets", "node_modules", "vendor")
DOC_SUFFIXES = (".html", ".md", ".mdx", ".rst")
MARKDOWN_SUFFIXES = (".md", ".mdx")
CPP_SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx")
CODE_SKIP_DIRS = (
    ".git", ".cache", ".rag", "__pycache__", "build", "node_modules", "vendor", "third_party",
)
CODE_SKIP_PREFIXES = ("cmake-build-", "bazel-")

_ROWS_PER_BATCH = 10_000
_BATCH_BYTES = 32 * 1024 * 1024
_BYTES_PER_TASK = 64 * 1024 * 1024


@dataclass(frozen=True)
class FolderFilter:
    """Folders a walk does not enter."""

    names: tuple[str, ...]
    prefixes: tuple[str, ...]

    def skips(self, name: str) -> bool:
        return name in self.names or name.startswith(self.prefixes)

    def skipped(self, path: Column) -> Column:
        """The same rule on a path column."""

        def folder(name: Column) -> Column:
            hit = name.isin(*self.names)
            for prefix in self.prefixes:
                hit = hit | name.startswith(prefix)
            return hit

        return F.exists(paths.directories(path), folder)


DOC_FOLDERS = FolderFilter(SKIP_DIRS, (".",))
CODE_FOLDERS = FolderFilter(CODE_SKIP_DIRS, CODE_SKIP_PREFIXES)


def list_tree(spark: SparkSession, root: str, folders: FolderFilter) -> DataFrame:
    """rel_path, size of every file below ``root`` outside skipped folders."""
    return read_tree(spark, root, folders.names, folders.prefixes)


def _reader(root: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(names, contents):
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(contents, pa.binary())],
                names=["rel_path", "content"],
            )

        content = Tree(root).reader()
        names, contents, held = [], [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                contents.append(content(name))
                names.append(name)
                held += len(contents[-1] or b"")
                if held >= _BATCH_BYTES or len(names) == _ROWS_PER_BATCH:
                    yield flush(names, contents)
                    names, contents, held = [], [], 0
        if names:
            yield flush(names, contents)

    return read


def read_contents(listing: DataFrame, root: str, tasks: int) -> DataFrame:
    """rel_path, content of the listed files, spread evenly over ``tasks``.

    The content of a file that vanished after it was listed is null.
    """
    spread = listing.select("rel_path").repartition(tasks, F.xxhash64("rel_path"))
    return spread.mapInArrow(_reader(root), "rel_path string, content binary")


def tasks_for(spark: SparkSession, size: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-size // _BYTES_PER_TASK))


def is_included(path: Column, include_parts: tuple[str, ...]) -> Column:
    """Outside skipped folders and below one of ``include_parts`` when given."""
    kept = ~DOC_FOLDERS.skipped(path)
    if include_parts:
        kept = kept & F.get(paths.parts(path), F.lit(0)).isin(*include_parts)
    return kept


def document_files(
    spark: SparkSession,
    root: str,
    suffixes: tuple[str, ...] = DOC_SUFFIXES,
    include_parts: tuple[str, ...] = (),
) -> DataFrame:
    """Listing of a document tree, contents unread."""
    listing = list_tree(spark, root, DOC_FOLDERS)
    path = F.col("rel_path")
    return listing.where(
        paths.suffix(path).isin(*suffixes) & is_included(path, tuple(include_parts))
    )


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    return document_files(spark, root, MARKDOWN_SUFFIXES)


# Languages that a scan looks for, and their suffixes.
LANGUAGES: dict[str, tuple[str, ...]] = {"cpp": CPP_SUFFIXES}


def language(path: Column, languages: dict[str, tuple[str, ...]] = LANGUAGES) -> Column:
    """Language of a source file, or '' when none is supported."""
    found = F.lit("")
    for name, suffixes in languages.items():
        found = F.when(paths.suffix(path).isin(*suffixes), name).otherwise(found)
    return found


def code_files(
    spark: SparkSession,
    root: str,
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    languages: dict[str, tuple[str, ...]] = LANGUAGES,
) -> DataFrame:
    """Listing of a source tree: rel_path, size, language."""
    listing = list_tree(spark, root, CODE_FOLDERS).withColumn("language", language(F.col("rel_path"), languages))
    path = F.col("rel_path")
    kept = F.col("language") != ""
    if include:
        kept = kept & paths.matches_any_glob(path, include)
    if exclude:
        kept = kept & ~paths.matches_any_glob(path, exclude)
    return listing.where(kept)


def decode(content: Column) -> Column:
    """Text of a UTF-8 file with "\\n" line ends; NULL when it is not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), tx.unify_newlines(text))
