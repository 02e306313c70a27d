"""Pages to heading-aware, overlapping, content-addressed chunks.

Everything happens inside the page's own row (array and regex expressions) and
one ``inline`` at the end, so chunking adds no shuffle to the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as tx

MAX_WORDS = 900
OVERLAP_WORDS = 120
CHUNK_COLUMNS = (
    "chunk_id", "source_path", "title", "heading_path", "url", "text", "embedding_text",
)
METADATA_COLUMNS = ("chunk_id", "source_path", "title", "heading_path", "url", "text")


def _pieces(text: Column) -> Column:
    """The text cut before each heading line that is outside fenced blocks.

    One pattern pass marks both fence ends and heading starts; a mark that is
    not followed by "#" belongs to a fence and is dropped again.
    """
    marked = F.regexp_replace(
        tx.unify_breaks(text),
        rf"(?md)^(?={tx.BLANK}*+[`#])(?:({tx.FENCE})|{tx.HEADING})",
        f"$1{tx.MARK}$2",
    )
    return F.split(F.regexp_replace(marked, f"{tx.MARK}(?!#)", ""), tx.MARK, -1)


def _open_headings(stack: Column, level: Column, heading: Column) -> Column:
    kept = F.filter(stack, lambda open_: open_["level"] < level)
    return F.concat(kept, F.array(F.struct(level.alias("level"), heading.alias("heading"))))


def sections(title: Column, text: Column) -> Column:
    """Array of (heading_path, text), one per non-empty stretch of the page."""
    stack_type = "array<struct<level:int,heading:string>>"
    out_type = "array<struct<heading_path:string,text:string>>"

    def section(path: Column, body: Column) -> Column:
        return F.array(F.struct(path.alias("heading_path"), tx.strip(body).alias("text")))

    def headed(acc: Column, piece: Column) -> Column:
        first = F.substring_index(piece, "\n", 1)
        rest = F.substring(piece, F.length(first) + F.lit(1), F.length(piece))
        level = F.length(F.regexp_extract(first, "^#+", 0))
        heading = tx.clean_heading(F.regexp_replace(first, "^#+", ""))
        return tx.let(
            _open_headings(acc["stack"], level, heading),
            lambda stack: F.struct(
                stack.alias("stack"),
                F.concat(
                    acc["out"],
                    section(F.array_join(F.transform(stack, lambda s: s["heading"]), " > "), rest),
                ).alias("out"),
            ),
        )

    def state(stack: Column, out: Column, kind: str) -> Column:
        return F.struct(stack.alias("stack"), out.cast(kind).alias("out"))

    def runs(acc: Column, run: Column) -> Column:
        start = state(acc["stack"], F.array(), out_type)
        return tx.let(
            F.aggregate(run, start, headed),
            lambda done: F.struct(
                done["stack"].alias("stack"), F.concat(acc["out"], F.array(done["out"])).alias("out")
            ),
        )

    def fold(pieces: Column) -> Column:
        # Adding to an array copies it. In runs of about the square root of all
        # headings no copy gets longer than that.
        size = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        parts = F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(pieces) / size).cast("int") - 1),
            lambda i: F.slice(pieces, i * size + 1, size),
        )
        # The text before the first heading is a section under the page's title.
        headed_parts = F.transform(
            parts, lambda run, i: F.when(i == 0, F.slice(run, F.lit(2), size)).otherwise(run)
        )
        first = section(title, F.get(pieces, F.lit(0)))
        start = state(F.array().cast(stack_type), F.array(first), f"array<{out_type}>")
        # A heading cleaned to NULL cannot occur, so paths are never NULL.
        return F.aggregate(headed_parts, start, runs, lambda acc: F.flatten(acc["out"]))

    def or_whole_page(found: Column) -> Column:
        page = F.filter(section(title, text), lambda s: s["text"] != "")
        return F.when(F.size(found) > 0, found).otherwise(page)

    folded = tx.let(_pieces(text), fold)
    return tx.let_array(F.filter(folded, lambda s: s["text"] != ""), or_whole_page)


def word_windows(text: Column, max_words: int, overlap_words: int) -> Column:
    """Array of texts: verbatim when short, else overlapping word windows."""
    step = max(1, max_words - overlap_words)

    def cut(all_words: Column) -> Column:
        last = F.ceil((F.size(all_words) - max_words) / F.lit(float(step))).cast("int")
        window = lambda i: F.array_join(F.slice(all_words, i * step + 1, F.lit(max_words)), " ")
        return F.when(F.size(all_words) <= max_words, F.array(tx.strip(text))).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)
        )

    return tx.let(tx.words(text), cut)


def chunk_id(source_path: Column, heading_path: Column, part_index: Column, text: Column) -> Column:
    fields = (source_path, heading_path, part_index.cast("string"), text)
    return F.sha2(F.concat_ws("\0", *fields), 256)


def embedding_text(title: Column, heading_path: Column, text: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nHeading: "), heading_path, F.lit("\n\n"), text)


def page_sections(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per section, in page order (``section_index`` from 0)."""
    found = sections(F.col("title"), F.col("text"))
    return pages.select(*keep, F.posexplode(found).alias("section_index", "s")).select(
        *keep, "section_index", "s.heading_path", "s.text"
    )


def chunk_pages(
    pages: DataFrame,
    max_words: int = MAX_WORDS,
    overlap_words: int = OVERLAP_WORDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per chunk; ``keep`` names page columns to carry along."""

    def parts(s: Column) -> Column:
        return F.transform(
            word_windows(s["text"], max_words, overlap_words),
            lambda text, i: F.struct(
                s["heading_path"].alias("heading_path"), i.alias("part_index"), text.alias("text")
            ),
        )

    cut = F.flatten(F.transform(sections(F.col("title"), F.col("text")), parts))
    pieces = pages.select(*keep, "source_path", "title", "url", F.explode(cut).alias("c")).select(
        *keep, "source_path", "title", "url", "c.heading_path", "c.part_index", "c.text"
    )
    path, heading, text = F.col("source_path"), F.col("heading_path"), F.col("text")
    return pieces.select(
        *keep,
        chunk_id(path, heading, F.col("part_index"), text).alias("chunk_id"),
        "source_path", "title", "heading_path", "url", "part_index", "text",
        embedding_text(F.col("title"), heading, text).alias("embedding_text"),
    )


def metadata() -> Column:
    """A chunk's metadata as a map, without the embedding text."""
    return F.create_map(*(part for c in METADATA_COLUMNS for part in (F.lit(c), F.col(c))))


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id.

    Equal ids mean equal text; title and url may differ. With a ``position``
    column (of any ordered type) the copy with the last one counts, else the
    one with the largest values, so the result never depends on the run. Copies
    merge on the map side first: however many rows share an id, each task ships
    it once. The result stays partitioned by chunk_id.
    """
    others = [c for c in chunks.columns if c != "chunk_id"]
    if not others:
        return chunks.distinct()
    order = sorted(others, key=lambda c: c != "position")
    last = F.max(F.struct(*order)).alias("last")
    return chunks.groupBy("chunk_id").agg(last).select(
        *[F.col("chunk_id") if c == "chunk_id" else F.col(f"last.{c}") for c in chunks.columns]
    )
