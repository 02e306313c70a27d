"""From raw documents to training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, lines, near_dup, packing, toxicity
from marlstone.llm.common import broadcast_within, keep, row_key
from marlstone.llm.queries import remainder, table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic; null texts are scored as empty ones."""
    _small_batches(spark)
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=remainder("doc_id", 5) != 0)
    scored = toxicity.toxicity(docs.select("doc_id", "text"), index).where("toxicity >= 0.5")
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    toxic = keep(scored.select(k1.alias("k1"), k2.alias("k2")).distinct())
    index.release()
    return _without(docs, toxic)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten or more have; texts that lose all lines stay as "", null becomes ""."""
    kept = lines.drop_common_lines(docs, min_docs=10, min_chars=1, counts=False)
    return kept.select(
        *[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns]
    )


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id; texts without words stay."""
    _small_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item; null texts have no words and stay."""
    _small_batches(spark)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return _without(docs, keep(found.where("n_hit > 0").select("k1", "k2").distinct()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 token ids; a null text is an empty one."""
    _small_batches(spark)
    pieces = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), max_tokens=2048, end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def _small_batches(spark: SparkSession) -> None:
    """Texts can be long: fewer rows in an Arrow batch bound what executors and their workers hold at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` that no key (k1, k2) names. Texts move only if the keys are too many to broadcast."""
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    wide = docs.select(row, k1.alias("k1"), k2.alias("k2"))
    return wide.join(broadcast_within(keys, 300_000), ["k1", "k2"], "left_anti").select("row.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("minhash", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Learned scores, classes of a graph and token ids are beyond SQL; the tests
# hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written as Parquet to the shared folder and read for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
