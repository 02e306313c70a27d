"""C and C++ files to class and function records.

Regex work stays in the JVM. The one step that cannot be expressed on columns
is the greedy scan: a function found on one line decides where the search
resumes. For that step alone a file's lines shrink to a few numbers each, go
to a numpy helper, and come back as line spans.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import code as cx
from marlstone.functions import text as tx

LANGUAGE = "cpp"
MAX_CODE_CHARS = 12_000
RECORD_SCHEMA = (
    "record_id string, kind string, language string, name string, qualified_name string, "
    "file string, line_start int, line_end int, class_name string, namespace string, "
    "signature string, docstring string, imports array<string>, code string, calls array<string>"
)
RECORD_COLUMNS = tuple(part.split()[0] for part in RECORD_SCHEMA.split(", "))

# Line traits handed to the scan.
_NAMESPACE, _CLASS, _CLASS_END, _BLANK, _LINE_COMMENT, _BLOCK_END, _BLOCK_START = (
    1 << i for i in range(7)
)
_SPANS = (
    "struct<classes:array<struct<first:int,last:int>>,"
    "functions:array<struct<first:int,open:int,last:int,doc_first:int,doc_last:int>>,"
    "namespaces:array<struct<first:int,last:int>>>"
)


def _first_at_most(levels: np.ndarray, start: int, limit: int) -> int | None:
    """First position from ``start`` with a level of at most ``limit``."""
    width = 64
    while start < len(levels):
        hits = np.flatnonzero(levels[start : start + width] <= limit)
        if hits.size:
            return int(start + hits[0])
        start, width = start + width, width * 2
    return None


def _comment_above(traits: np.ndarray, line: int) -> tuple[int, int]:
    """Span of the comment that ends right above ``line``, or (-1, -1)."""
    last = line - 1
    while last >= 0 and traits[last] & _BLANK:
        last -= 1
    if last < 0 or not traits[last] & (_LINE_COMMENT | _BLOCK_END):
        return -1, -1
    first = last
    if traits[last] & _LINE_COMMENT:
        while first > 0 and traits[first - 1] & _LINE_COMMENT:
            first -= 1
    else:
        while first > 0 and not traits[first] & _BLOCK_START:
            first -= 1
    return first, last


def _scan(traits: np.ndarray, raw: np.ndarray, clean: np.ndarray, opens: np.ndarray) -> dict:
    count = len(traits)
    ends = np.flatnonzero(traits & _CLASS_END)
    classes = []
    for first in np.flatnonzero(traits & _CLASS).tolist():
        at = np.searchsorted(ends, first)
        classes.append({"first": first, "last": int(ends[at]) if at < len(ends) else first})

    depth = np.cumsum(clean)
    namespaces = []
    for first in np.flatnonzero(traits & _NAMESPACE).tolist():
        outside = int(depth[first] - clean[first])
        last = _first_at_most(depth, first, outside)
        namespaces.append({"first": first, "last": count - 1 if last is None else last})

    depth = np.cumsum(raw)
    functions, resume = [], 0
    for first in np.flatnonzero(opens >= 0).tolist():
        if first < resume:
            continue
        opened = int(opens[first])
        last = _first_at_most(depth, opened, int(depth[opened] - raw[opened]))
        last = opened if last is None else last
        doc_first, doc_last = _comment_above(traits, first)
        functions.append(
            {"first": first, "open": opened, "last": last,
             "doc_first": doc_first, "doc_last": doc_last}
        )
        resume = last + 1
    return {"classes": classes, "functions": functions, "namespaces": namespaces}


def _span_finder(throttle_seconds: float):
    @F.arrow_udf(_SPANS)
    def find_spans(
        traits: pa.Array, raw: pa.Array, clean: pa.Array, opens: pa.Array
    ) -> pa.Array:
        pair = [("first", pa.int32()), ("last", pa.int32())]
        five = [(n, pa.int32()) for n in ("first", "open", "last", "doc_first", "doc_last")]
        kind = pa.struct(
            [
                ("classes", pa.list_(pa.struct(pair))),
                ("functions", pa.list_(pa.struct(five))),
                ("namespaces", pa.list_(pa.struct(pair))),
            ]
        )
        out = []
        for file in zip(traits, raw, clean, opens):
            out.append(_scan(*(np.asarray(column.values, dtype=np.int64) for column in file)))
            if throttle_seconds:
                time.sleep(throttle_seconds)
        return pa.array(out, kind)

    return find_spans


def _trait(condition: Column, bit: int) -> Column:
    return F.when(condition, bit).otherwise(0)


def _open_line(stripped: Column, line: Column, index: Column) -> Column:
    """Line with the opening brace of a function starting here, or -1."""
    stops = lambda s: (s == "") | s.endswith(";") | s.contains("{")

    def opened(window: Column, at: Column) -> Column:
        stop = F.get(window, at - 1)
        signature = cx.join_signature(F.slice(window, F.lit(1), at))
        is_function = ~stop.endswith(";") & stop.contains("{") & cx.looks_like_function(signature)
        return F.when(is_function, index + at - 1).otherwise(-1)

    def within(window: Column) -> Column:
        first_stop = F.array_position(F.transform(window, stops), F.lit(True)).cast("int")
        return tx.let(
            first_stop, lambda at: F.when(at > 0, opened(window, at)).otherwise(-1)
        )

    ahead = F.slice(stripped, index + 1, F.lit(cx.LOOK_AHEAD))
    return F.when(cx.can_start_signature(line), tx.let(ahead, within)).otherwise(-1)


def _line_numbers(lines: Column, stripped: Column) -> Column:
    """(traits, raw brace delta, clean brace delta, function open line) per line."""

    def numbers(pair: Column, index: Column) -> Column:
        line, bare = pair["line"], pair["bare"]
        traits = (
            _trait(line.rlike(cx.NAMESPACE), _NAMESPACE)
            + _trait(line.rlike(cx.CLASS), _CLASS)
            + _trait(line.contains("};"), _CLASS_END)
            + _trait(bare == "", _BLANK)
            + _trait(bare.startswith("//"), _LINE_COMMENT)
            + _trait(bare.endswith("*/"), _BLOCK_END)
            + _trait(bare.startswith("/*"), _BLOCK_START)
        )
        braces = line.contains("{") | line.contains("}")
        clean = F.when(braces, cx.brace_delta(cx.strip_comments_and_strings(line))).otherwise(0)
        return F.struct(
            traits.alias("traits"),
            cx.brace_delta(line).alias("raw"),
            clean.alias("clean"),
            _open_line(stripped, bare, index).cast("int").alias("opens"),
        )

    return F.transform(F.arrays_zip(lines.alias("line"), stripped.alias("bare")), numbers)


def _span_lines(lines: Column, first: Column, last: Column) -> Column:
    return F.slice(lines, first + 1, last - first + 1)


def _records(spans: Column, lines: Column, stripped: Column) -> Column:
    named = F.transform(
        spans["namespaces"],
        lambda n: F.struct(
            n["first"].alias("first"),
            n["last"].alias("last"),
            F.regexp_extract(F.get(lines, n["first"]), cx.NAMESPACE, 1).alias("name"),
        ),
    )

    def namespace(spaces: Column, line: Column) -> Column:
        around = F.filter(spaces, lambda n: (n["first"] <= line) & (line <= n["last"]))
        return F.array_join(F.transform(around, lambda n: n["name"]), "::")

    def record(spaces, s, kind, name, signature, docstring):
        return F.struct(
            kind.alias("kind"),
            name.alias("raw_name"),
            namespace(spaces, s["first"]).alias("namespace"),
            (s["first"] + 1).alias("line_start"),
            (s["last"] + 1).alias("line_end"),
            signature.alias("signature"),
            docstring.alias("docstring"),
            F.array_join(_span_lines(lines, s["first"], s["last"]), "\n").alias("full_code"),
        )

    def class_record(spaces, s):
        head = F.get(lines, s["first"])
        part = lambda group: F.regexp_extract(head, cx.CLASS, group)
        return record(spaces, s, part(1), part(2), F.lit(""), F.lit(""))

    def function_record(spaces, s):
        above = _span_lines(stripped, s["doc_first"], s["doc_last"])
        docstring = F.when(s["doc_first"] < 0, "").otherwise(
            tx.let(
                above,
                lambda c: F.when(
                    F.startswith(F.element_at(c, -1), F.lit("//")), cx.line_comment_text(c)
                ).otherwise(cx.block_comment_text(c)),
            )
        )
        signature = cx.join_signature(_span_lines(stripped, s["first"], s["open"]))
        return tx.let(
            tx.squeeze(signature),
            lambda sig: record(
                spaces, s, F.lit("function"), cx.raw_function_name(sig), sig, docstring
            ),
        )

    return tx.let_array(
        named,
        lambda spaces: F.concat(
            F.transform(spans["classes"], lambda s: class_record(spaces, s)),
            F.transform(spans["functions"], lambda s: function_record(spaces, s)),
        ),
    )


def analyze(
    files: DataFrame, max_code_chars: int = MAX_CODE_CHARS, throttle_ms: int = 0
) -> DataFrame:
    """Records of every file: classes first, then functions, each in line order.

    ``files`` needs rel_path and text (NULL for undecodable files, which give
    no records). No shuffle: a file is one row until its records are exploded.
    """
    by_line = (
        files.where(F.col("text").isNotNull())
        .select("rel_path", tx.lines(F.col("text")).alias("lines"))
        .withColumn("stripped", F.transform("lines", tx.strip))
    )
    finder = _span_finder(max(0, throttle_ms) / 1000)
    numbered = by_line.withColumn("n", _line_numbers(F.col("lines"), F.col("stripped")))
    spanned = numbered.withColumn("spans", finder("n.traits", "n.raw", "n.clean", "n.opens"))
    # Imports are worked out before the explode, once per file.
    rows = spanned.withColumn("imports", cx.imports(F.col("lines"))).select(
        "rel_path",
        "imports",
        F.explode(_records(F.col("spans"), F.col("lines"), F.col("stripped"))).alias("r"),
    ).select("rel_path", "imports", "r.*")

    is_function = F.col("kind") == "function"
    name = F.when(is_function, F.element_at(F.split("raw_name", "::"), -1)).otherwise(
        F.col("raw_name")
    )
    with_names = rows.withColumns(
        {
            "name": name,
            "qualified_name": cx.qualify(F.col("namespace"), F.col("raw_name")),
            "class_name": F.when(is_function, cx.class_of(F.col("raw_name"))).otherwise(""),
        }
    )
    full_code = F.col("full_code")
    return with_names.select(
        cx.record_id(
            F.col("rel_path"), F.col("kind"), F.col("qualified_name"), F.col("line_start"), full_code
        ).alias("record_id"),
        "kind",
        F.lit(LANGUAGE).alias("language"),
        "name",
        "qualified_name",
        F.col("rel_path").alias("file"),
        "line_start",
        "line_end",
        "class_name",
        "namespace",
        "signature",
        "docstring",
        "imports",
        F.when(is_function, cx.truncate(full_code, max_code_chars)).otherwise(full_code).alias("code"),
        F.when(is_function, cx.calls(full_code, F.col("name")))
        .otherwise(F.array().cast("array<string>"))
        .alias("calls"),
    )
