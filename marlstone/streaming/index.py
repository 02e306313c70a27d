"""The chunk index: append-only Parquet tables kept up to date by id diffs.

Layout under ``<root>/<collection>``::

    changes/batch=N/op=add   chunks first seen in batch N
    changes/batch=N/op=drop  ids removed in batch N (they hide older batches)
    vectors/batch=N          chunk_id, embedding of the added chunks
    commits/N.json           one small row per finished batch, the Nth
    cells                    cells of the vectors of one batch, for searches

A batch becomes visible with its commit row, written last and never replaced:
who finds the Nth row taken has lost to another writer, and nothing of the batch
counts. The number of a batch is N * 2^32 plus a random part, so writers at the
same time never share a folder. A sync writes only what changed, and vectors are stored apart from the text so that a search scans
vectors alone and fetches the text of its few hits by id. When many batches
have gathered, the live rows are written again as one batch, sorted by id, whose
commit hides all before it; so a read never sees more than MAX_BATCHES. Folders
that no commit shows any more are removed by :meth:`ChunkIndex.reclaim`.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.embedding import Embedder
from marlstone.operators.cells import CellIndex
from marlstone.operators.chunk import CHUNK_COLUMNS, dedupe_chunks, embedding_text
from marlstone.session import keep
from marlstone.sources.store import Store

# embedding_text is derived from the other columns and not stored twice.
STORED_COLUMNS = tuple(c for c in CHUNK_COLUMNS if c != "embedding_text")
CHANGES_SCHEMA = ", ".join(f"{c} string" for c in STORED_COLUMNS) + ", batch long, op string"
VECTORS_SCHEMA = "chunk_id string, embedding array<float>, batch long"
COMMITS_SCHEMA = "batch long, added long, removed long, model string, base boolean"
CELLS_SCHEMA = "batch long, folder string"
MAX_BATCHES = 16
_SEQUENCE = 1 << 32  # a batch's place among the commits is above these bits
# Folders out of use are kept so long for readers and writers that still run.
KEEP_SECONDS = 7 * 24 * 3600
# Added ids that are shipped to the tasks whole, at some 100 bytes each.
BROADCAST_IDS = 200_000


def added_ids(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids wanted and not stored yet."""
    return desired.select("chunk_id").distinct().join(existing, "chunk_id", "left_anti")


def stale_ids(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids stored and no longer wanted."""
    return existing.select("chunk_id").distinct().join(desired, "chunk_id", "left_anti")


def unchanged_ids(desired: DataFrame, existing: DataFrame) -> DataFrame:
    return desired.select("chunk_id").distinct().join(existing, "chunk_id", "left_semi")


def diff(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Deduplicated ``desired`` against stored ids, with ``op`` add/keep/drop.

    One full outer join on chunk_id serves all three outcomes.
    """
    known = existing.select("chunk_id", F.lit(True).alias("known"))
    wanted = desired.withColumn("wanted", F.lit(True))
    return (
        wanted.join(known, "chunk_id", "full_outer")
        .withColumn(
            "op",
            F.when(F.col("known").isNull(), "add").when(F.col("wanted").isNull(), "drop").otherwise("keep"),
        )
        .drop("known", "wanted")
    )


class CommitConflict(RuntimeError):
    """Another writer committed since this one read the index. Nothing of this write counts; try again."""


@dataclass(frozen=True)
class SyncResult:
    added: int
    removed: int
    unchanged: int

    @property
    def total(self) -> int:
        return self.added + self.unchanged


class ChunkIndex:
    """One collection of embedded chunks. Of writers at the same time the first to commit wins."""

    def __init__(self, spark: SparkSession, root: str, collection: str, embedder: Embedder):
        self.spark = spark
        self.embedder = embedder
        self.base = f"{root.rstrip('/')}/{collection}"

    # -- reading ---------------------------------------------------------

    def _read(self, table: str, schema: str, form: str = "parquet") -> DataFrame | None:
        """The table, or None as long as nothing has been written."""
        try:
            frame = self.spark.read.schema(schema).format(form).load(f"{self.base}/{table}")
            frame.isEmpty() if form == "json" else frame.schema
            return frame
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem.getCondition()):
                raise
            return None

    def _table(self, table: str, schema: str) -> DataFrame:
        found = self._read(table, schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    def commits(self) -> list:
        """Finished batches in order, from the last rewritten one on; MAX_BATCHES or so."""
        rows = self._read("commits", COMMITS_SCHEMA, "json")
        if rows is None:
            return []
        base = rows.where("base").agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") >= (base or 0)).orderBy("batch").collect()

    def exists(self) -> bool:
        return bool(self.commits())

    def check_model(self) -> None:
        """Vectors of different models do not compare."""
        for commit in self.commits()[-1:]:
            if commit.model != self.embedder.name:
                raise RuntimeError(
                    f"the index holds vectors of {commit.model}, not of {self.embedder.name}"
                )

    def _live(self, rows: DataFrame, commits: list) -> DataFrame:
        """Rows of finished batches whose id no later batch dropped."""
        rows = rows.where(F.col("batch").isin([c.batch for c in commits]))
        dropping = [c.batch for c in commits if c.removed]
        if not dropping:
            return rows
        drops = (
            self._table("changes", CHANGES_SCHEMA)
            .where((F.col("op") == "drop") & F.col("batch").isin(dropping))
            .groupBy("chunk_id")
            .agg(F.max("batch").alias("drop_batch"))
        )
        return (
            rows.join(drops, "chunk_id", "left")
            .where(F.col("drop_batch").isNull() | (F.col("drop_batch") <= F.col("batch")))
            .drop("drop_batch")
        )

    def _added(self, table: str, commits: list) -> DataFrame:
        """Rows that finished batches added.

        A batch that added nothing owns no such rows; a folder of that number
        can only be left over from an unfinished run.
        """
        schema = CHANGES_SCHEMA if table == "changes" else VECTORS_SCHEMA
        rows = self._table(table, schema).where(F.col("batch").isin([c.batch for c in commits if c.added]))
        return rows.where(F.col("op") == "add").drop("op") if table == "changes" else rows

    def ids(self) -> DataFrame:
        """Ids in the index. Only the id column is read."""
        commits = self.commits()
        return self._live(self._added("changes", commits).select("chunk_id", "batch"), commits).select("chunk_id")

    def vectors(self) -> DataFrame:
        """id, embedding of every live chunk."""
        commits = self.commits()
        live = self._live(self._added("vectors", commits), commits)
        return live.select(F.col("chunk_id").alias("id"), "embedding")

    def chunks(self) -> DataFrame:
        """Live chunks, embedding_text included."""
        commits = self.commits()
        return self._live(self._added("changes", commits), commits).select(
            *STORED_COLUMNS,
            embedding_text(F.col("title"), F.col("heading_path"), F.col("text")).alias(
                "embedding_text"
            ),
        )

    def cells(self) -> CellIndex | None:
        """Cells of the vectors as they are now, if :meth:`build_cells` made some since the last change."""
        made, done = self._read("cells/made", CELLS_SCHEMA, "json"), self.commits()
        if made is None or not done:
            return None
        row = made.where(F.col("batch") == done[-1].batch).first()
        return CellIndex(self.spark, f"{self.base}/cells/{row.folder}") if row else None

    def build_cells(self, cells: int | None = None) -> CellIndex:
        """Deal the live vectors over cells; searches use them until the next change of the index."""
        folder = os.urandom(8).hex()
        batch = self.commits()[-1].batch
        made = CellIndex.build(self.vectors(), f"{self.base}/cells/{folder}", cells)
        row = self.spark.createDataFrame([(batch, folder)], CELLS_SCHEMA)
        row.coalesce(1).write.mode("append").json(f"{self.base}/cells/made")
        return made

    def count(self) -> int:
        return sum(c.added - c.removed for c in self.commits())

    # -- writing ---------------------------------------------------------

    def sync(self, chunks: DataFrame, delete_stale: bool = True) -> SyncResult:
        """Bring the index to ``chunks``; only chunks not stored yet are embedded.

        Refuses an empty ``chunks`` rather than emptying the index. Ids alone
        are compared; then the text of added chunks is fetched by their ids. A
        ``position`` column says which of several chunks with one id is the
        last, whose title and url count.
        """
        batch = self._next_batch()
        ops = keep(diff(chunks.select("chunk_id").distinct(), self.ids()).select("chunk_id", "op"))
        counts = {r.op: r.n for r in ops.groupBy("op").agg(F.count("*").alias("n")).collect()}
        added, unchanged = counts.get("add", 0), counts.get("keep", 0)
        if not added + unchanged:
            raise RuntimeError("No indexable docs chunks were produced.")
        removed = counts.get("drop", 0) if delete_stale else 0
        if added:
            wanted = ops.where("op = 'add'").select("chunk_id")
            wanted = wanted.hint("broadcast" if added <= BROADCAST_IDS else "shuffle_hash")
            self._write(batch, self._last(chunks).join(wanted, "chunk_id", "left_semi"))
        if removed:
            drops = ops.where("op = 'drop'").select("chunk_id")
            drops.write.mode("overwrite").parquet(f"{self.base}/changes/batch={batch}/op=drop")
        self._commit(batch, added, removed)
        return SyncResult(added, removed, unchanged)

    def upsert(self, chunks: DataFrame) -> SyncResult:
        """Store every given chunk, replacing rows of the same id. No chunks change nothing."""
        batch = self._next_batch()
        if chunks.isEmpty():
            return SyncResult(0, 0, 0)
        self._write(batch, self._last(chunks))
        stored = self.spark.read.schema(CHANGES_SCHEMA).parquet(f"{self.base}/changes/batch={batch}/op=add")
        drops = self.ids().join(stored.select("chunk_id"), "chunk_id", "left_semi")
        drops.write.mode("overwrite").parquet(f"{self.base}/changes/batch={batch}/op=drop")
        added, removed = stored.count(), drops.count()
        self._commit(batch, added, removed)
        return SyncResult(added, removed, 0)

    def compact(self) -> None:
        """Write all live rows as one batch, in id order; older batches are not read any more."""
        done = self.commits()
        if len(done) < 2:
            return
        batch, total = self._next_batch(), self.count()
        for table, rows, sub in (
            ("changes", self.chunks().select(*STORED_COLUMNS), "/op=add"),
            ("vectors", self.vectors().withColumnRenamed("id", "chunk_id"), ""),
        ):
            ordered = rows.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
            ordered.write.mode("overwrite").parquet(f"{self.base}/{table}/batch={batch}{sub}")
        self._add_commit(batch, total, 0, base=True)

    def _last(self, chunks: DataFrame) -> DataFrame:
        return chunks.select(*STORED_COLUMNS, *[c for c in chunks.columns if c == "position"])

    def _write(self, batch: int, chunks: DataFrame) -> None:
        """Store chunks of a batch, then embed them from the written rows."""
        place = f"{self.base}/changes/batch={batch}/op=add"
        dedupe_chunks(chunks).select(*STORED_COLUMNS).write.mode("overwrite").parquet(place)
        written = self.spark.read.schema(CHANGES_SCHEMA).parquet(place)
        text = embedding_text(F.col("title"), F.col("heading_path"), F.col("text"))
        (
            written.select("chunk_id", self.embedder.embed(text).alias("embedding"))
            .write.mode("overwrite")
            .parquet(f"{self.base}/vectors/batch={batch}")
        )

    def _commit(self, batch: int, added: int, removed: int) -> None:
        if added or removed:
            self._add_commit(batch, added, removed, base=False)
            if len(self.commits()) > MAX_BATCHES:
                try:
                    self.compact()
                except CommitConflict:
                    pass  # the next commit will find as many batches

    def _add_commit(self, batch: int, added: int, removed: int, base: bool) -> None:
        """The commit row of a batch, if no other batch has taken its place since it was begun."""
        row = {"batch": batch, "added": added, "removed": removed, "model": self.embedder.name, "base": base}
        place = batch // _SEQUENCE
        if not Store(self.base).create_once(f"commits/{place}.json", json.dumps(row).encode() + b"\n"):
            raise CommitConflict(f"another writer has committed batch {place} of {self.base}")

    def _next_batch(self) -> int:
        """Number of the batch after those that are visible now."""
        self.check_model()
        done = self.commits()
        place = done[-1].batch // _SEQUENCE + 1 if done else 1
        return place * _SEQUENCE + int.from_bytes(os.urandom(4))

    def reclaim(self, keep_seconds: float = KEEP_SECONDS) -> int:
        """Remove batches that were replaced or never committed, and cells of earlier states; returns how many folders.

        Only folders in which nothing was written for ``keep_seconds`` go. A
        search that began before the batches were replaced, or a write, must
        not run longer than that.
        """
        store, commits = Store(self.base), self.commits()
        shown = {f"batch={c.batch}" for c in commits}
        live = {table: shown for table in ("changes", "vectors")}
        made = self._read("cells/made", CELLS_SCHEMA, "json")
        current = made.where(F.col("batch") == commits[-1].batch).collect() if made is not None and commits else []
        live["cells"] = {"made"} | {row.folder for row in current}
        removed = 0
        for table, names in live.items():
            for name in store.folders(table):
                if name not in names and store.idle_seconds(f"{table}/{name}") >= keep_seconds:
                    store.remove(f"{table}/{name}")
                    removed += 1
        return removed
