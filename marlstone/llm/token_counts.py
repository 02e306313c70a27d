"""Token counts of texts, with a cache by content digest."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bpe import encoder
from marlstone.llm.common import broadcast_within, keep, slices, utf8


def _counter(path: str):
    """Counts of a list of UTF-8 texts as the file's own library gives them."""
    if not path.endswith(".model"):
        return encoder(path).counts
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(model.encode(t.decode("utf-8", "replace"))) for t in texts]


class TokenCounts:
    """A table of (content digest, number of tokens) for one tokenizer file.

    ``folder`` must be reachable for all executors, and the tokenizer file on
    each of them. Counts live under the digest of the tokenizer file, so a new
    version of it starts anew. The content that is digested is the text with
    null as the empty text; nothing else is normalised, since any other change
    could change the count.
    """

    SCHEMA = "digest binary, n_tokens long"

    def __init__(self, spark: SparkSession, folder: str, path: str):
        self.spark, self.path = spark, path
        with open(path, "rb") as file:
            version = hashlib.sha256(file.read()).hexdigest()
        self.folder = f"{folder}/tokenizer={version[:32]}"
        # An empty batch, so that the folder can be read.
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(self.folder)

    def stored(self) -> DataFrame:
        """One row for each digest; batches of runs at the same time may repeat some."""
        table = self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        return table.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def count(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """Of each row: its id, ``n_bytes`` in UTF-8, ``n_tokens``.

        Only texts whose digest isn't stored are encoded, each distinct one
        once, and their counts are appended. Null texts count as empty ones;
        repeated rows and null ids get a row each; an empty table gives none.
        Other columns are ignored.

        Digests and ids are all that is shuffled to find the misses. The texts
        of misses are picked by (id, digest): by broadcast as long as the misses
        are few, else by a join that moves each text once.
        """
        content = F.coalesce(F.col(text), F.lit(""))
        digest = F.unhex(F.sha2(content, 256))
        rows = keep(
            docs.select(
                F.col(id).alias("id"), digest.alias("digest"), F.octet_length(content).cast("long").alias("n_bytes")
            )
        )
        misses = keep(
            rows.groupBy("digest")
            .agg(F.min("id").alias("id"))
            .join(self.stored().select("digest"), "digest", "left_anti")
        )
        texts = docs.select(F.col(id).alias("id"), digest.alias("digest"), content.alias("text"))
        picked = broadcast_within(misses, 300_000).alias("m")
        wanted = texts.alias("t").join(
            picked,
            F.col("t.id").eqNullSafe(F.col("m.id")) & (F.col("t.digest") == F.col("m.digest")),
            "left_semi",
        )
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = _counter(path)
            for part in slices(batches, "text", 1 << 20):
                found = count([utf8(t) for t in part.column("text").to_pylist()])
                yield pa.record_batch([part.column("digest"), pa.array(found, pa.int64())], ["digest", "n_tokens"])

        wanted.select("digest", "text").mapInArrow(run, self.SCHEMA).write.mode("append").parquet(self.folder)
        return rows.join(self.stored(), "digest").select(F.col("id").alias(id), "n_bytes", "n_tokens")


def fresh_folder(shared: str) -> str:
    return f"{shared}/token-counts-{os.urandom(8).hex()}"
