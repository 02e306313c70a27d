"""Odd tables: nulls, empty and very long texts, repeated rows and ids, clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000)) + "\n" + "na " * 5_000
CLASHES = (
    "id", "key", "k1", "k2", "row", "pos", "h", "drops", "node", "root", "spans", "digest", "n_tokens", "n_lines",
    "score", "toxicity", "evidence", "start", "length", "segment", "hits", "same", "first", "uid", "held_out",
)
DOCUMENTS = [
    (1, "One fine line of plain words stands here for the test.\nshared line"),
    (1, "One fine line of plain words stands here for the test.\nshared line"),
    (2, None),
    (3, ""),
    (None, "No id but words, mail a@b.example and +1 (555) 123-4567."),
    (None, None),
    (4, " \t\r\n\x0b\x0c \n"),
    (5, LONG),
    (6, "naïve ÉCOLE   ünïcode \U0001f600 \u0000 nul <|endoftext|> it's 'tis"),
    (7, "One fine line of plain words stands here for the test.\nshared line"),
    (8, "x"),
    (9, "\n\n\n"),
]


def documents(spark, rows=DOCUMENTS):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(1).cast("long"))


def labels(spark, rows=((1, 1), (1, 0), (3, 0), (None, 1), (5, None), (99, 1), (8, 7))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


def benchmark(spark, rows=((1, "plain words stands here"), (2, None), (3, ""), (None, "fine line of"), (1, "x"))):
    return spark.createDataFrame(list(rows), "item_id long, text string").withColumn("doc_id", F.lit(0))


def ids(frame, name="doc_id"):
    return sorted((r[0] for r in frame.select(name).collect()), key=repr)


ALL_IDS = sorted((r[0] for r in DOCUMENTS), key=repr)
