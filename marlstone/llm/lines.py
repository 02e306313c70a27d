"""Drop lines that many documents share (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import LOWER, SPACES, UPPER, row_key


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return _lower(F.btrim(line, F.lit(SPACES)))


def _lower(text: Column) -> Column:
    """A-Z in lower case; of other letters none."""
    # lower() is several times as quick as translate(), and does the same where
    # no other upper-case letter can be: in ASCII, and with U+00DF to U+00FF.
    same = (F.octet_length(text) == F.char_length(text)) | ~text.rlike("[^\\x00-\\x7f\\xdf-\\xff]")
    return F.when(same, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _hashes(lines: Column) -> Column:
    """Hashes and lengths of the lines' keys, each key worked out once."""
    stripped = F.transform(lines, lambda x: F.btrim(x, F.lit(SPACES)))

    def hashed(key: Column) -> Column:
        first, second = row_key(key)
        return F.struct(first.alias("h1"), second.alias("h2"), F.char_length(key).alias("n"))

    return F.transform(F.transform(stripped, _lower), hashed)


def _without(lines: Column, drops: Column) -> Column:
    """Array ``lines`` without the positions in the sorted array ``drops``, in linear time."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drops, lambda d: d + 1))
    ends = F.concat(drops, F.array(F.size(lines)))
    runs = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda r: F.slice(lines, r["s"] + 1, r["e"] - r["s"]),
    )
    return F.flatten(runs)


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", id: str = "doc_id", counts: bool = True
) -> DataFrame:
    r"""``docs`` without lines whose key at least ``min_docs`` documents have.

    Lines are the parts between \n; a key is the stripped, A-Z lower-cased line,
    and keys shorter than ``min_chars`` code points are never dropped. A
    document is a row of ``docs``, and counts once for a key however often it
    has it. Returned are all columns of ``docs``, with the kept lines as
    ``text``, plus ``n_lines`` (before) and ``n_dropped``; columns that had
    these two names are replaced. Without ``counts`` the columns are those of
    ``docs`` alone.

    A null or empty text is one empty line and comes back as "". Equal rows are
    separate documents and lose the same lines. An empty table gives an empty
    table. Keys are compared by a 128-bit hash.

    Only hashes are shuffled to find the lines: counts merge on the map side, so
    a line that a third of all documents has is a row for each task. Hits
    (document, position) join on the hash, where adaptive execution splits a hot
    one. The texts move once, to meet the positions that they lose, by a key of
    the row, which spreads copies evenly.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    k1, k2 = row_key(F.col(id), F.col(text))
    hashed = docs.select(
        k1.alias("k1"),
        k2.alias("k2"),
        _hashes(lines).alias("hashes"),
    )
    long_enough = F.filter("hashes", lambda h: h["n"] >= min_chars)
    common = (
        hashed.select(F.explode(F.array_distinct(long_enough)).alias("h"))
        .groupBy("h.h1", "h.h2")
        .agg(F.count("*").alias("docs"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2")
    )
    drops = (
        hashed.select("k1", "k2", F.posexplode("hashes").alias("pos", "h"))
        .where(F.col("h.n") >= min_chars)
        .select("k1", "k2", "pos", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
        .join(common, ["h1", "h2"])
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    )
    wide = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("__row"), k1.alias("__k1"), k2.alias("__k2")
    )
    joined = wide.join(drops.withColumnsRenamed({"k1": "__k1", "k2": "__k2", "drops": "__drops"}).hint("shuffle_hash"), ["__k1", "__k2"], "left")
    split = F.split(F.coalesce(F.col("__row")[text], F.lit("")), "\n", -1)
    kept = F.when(F.col("__drops").isNull(), F.coalesce(F.col("__row")[text], F.lit(""))).otherwise(
        F.array_join(_without(split, F.col("__drops")), "\n")
    )
    added = {
        "n_lines": F.size(split).cast("long"),
        "n_dropped": F.coalesce(F.size("__drops"), F.lit(0)).cast("long"),
    }
    added = added if counts else {}
    return joined.select(
        *[(kept if c == text else F.col("__row")[c]).alias(c) for c in docs.columns if c not in added],
        *[column.alias(name) for name, column in added.items()],
    )
