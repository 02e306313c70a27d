"""Text expressions with Python string semantics, evaluated inside the JVM.

Spark's ``trim`` knows only U+0020 and Java's ``\\s`` knows only ASCII, so the
white space and line break sets are spelled out here. Everything below is a
pure Column expression: no shuffle and no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.strip(), str.split() and re's \s understand it.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Line breaks as str.splitlines() understands them.
LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def _char_class(chars: str) -> str:
    """A regex class that turns away an ordinary character after two checks.

    Characters below U+0100 share one bit set; the rest sit behind a range test.
    """
    codes = [f"\\x{{{ord(c):x}}}" for c in sorted(chars)]
    low = [code for code, c in zip(codes, sorted(chars)) if ord(c) < 0x100]
    high = codes[len(low) :]
    rare = f"[{high[0]}-{high[-1]}&&[{''.join(high)}]]" if high else ""
    return f"[{''.join(low)}{rare}]"


WS = _char_class(WHITESPACE)
# White space that can remain inside a line once its breaks are all "\n".
BLANK = _char_class("".join(c for c in WHITESPACE if c not in LINE_BREAKS))
# One word character as Python's \w sees it; Java's (?U)\w also takes marks.
WORD = r"[\p{L}\p{N}_]"
_RARE_BREAK = _char_class(LINE_BREAKS.replace("\n", ""))
BREAK = rf"\r\n|{_RARE_BREAK}"

# U+001E is a line break, so it cannot survive unify_breaks and is free to
# serve as a section mark.
MARK = "\x1e"

# A fenced block: from a line opening with three backticks to the next such
# line, or to the end of the text when the fence is never closed.
FENCE = rf"{BLANK}*+```[^\n]*+(?:(?s:.*?)\n{BLANK}*+```[^\n]*+|(?s:.*))"
HEADING = rf"{BLANK}*+(#{{1,6}})(?={BLANK}++[^\n])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_array(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let`` for an array-valued body that is going to be exploded.

    The optimizer guards explode over a plain field access with a non-empty
    filter, which would evaluate the whole expression a second time.
    """
    return F.flatten(F.transform(F.array(value), body))


# Values that a reader holds as Python objects at a time.
READ_ROWS = 64


def evaluated_once(reader: Callable, schema: str) -> Callable[[Column], Column]:
    """An Arrow UDF whose calls the optimizer may not copy.

    A filter on a field of the result would otherwise be pushed below the
    projection together with a second call of the reader.
    """
    return F.arrow_udf(reader, schema).asNondeterministic()


def read_each(read: Callable, values: pa.Array, kind: pa.StructType, name: str) -> pa.Array:
    """``read`` of every value as a struct of type ``kind``; NULL stays NULL.

    Whatever a value does to its reader (wrong syntax, too deep nesting, text
    that is not Unicode) becomes the row's ``error``, never the job's.
    """

    def failed(problem: Exception) -> dict:
        reason = f"{name}: {problem or type(problem).__name__}".encode("utf-8", "replace").decode()
        return {"error": reason}

    def one(value) -> dict | None:
        try:
            return None if value is None else read(value)
        except Exception as problem:
            return failed(problem)

    def column(rows: list) -> pa.Array:
        try:
            return pa.array(rows, kind)
        except Exception as problem:  # Arrow cannot hold one of them
            if len(rows) == 1:
                return pa.array([failed(problem)], kind)
            return pa.concat_arrays([column([row]) for row in rows])

    # A few values at a time are held as Python objects.
    parts = [
        column([one(value.as_py()) for value in values.slice(at, READ_ROWS)])
        for at in range(0, len(values), READ_ROWS)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def squeeze(col: Column) -> Column:
    """Collapse white space runs to one space and strip the ends."""
    return strip(F.regexp_replace(col, WS + "+", " "))


def words(col: Column) -> Column:
    """White space separated words; an empty array for blank text."""
    return let(
        strip(col),
        lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(
            F.split(s, WS + "+")
        ),
    )


def unify_newlines(col: Column) -> Column:
    """What reading a file in text mode does to its line ends."""
    return F.when(col.contains("\r"), F.regexp_replace(col, r"\r\n?", "\n")).otherwise(col)


def unify_breaks(col: Column) -> Column:
    """Turn every line break into "\\n" and drop one at the very end."""
    usual = F.when(col.rlike(_RARE_BREAK), F.regexp_replace(col, BREAK, "\n")).otherwise(col)
    return let(
        usual,
        lambda t: F.when(
            F.endswith(t, F.lit("\n")), F.substring(t, F.lit(1), F.length(t) - 1)
        ).otherwise(t),
    )


def lines(col: Column) -> Column:
    """The text's lines; an empty array for empty text."""
    return F.when(col == "", F.array().cast("array<string>")).otherwise(
        F.split(unify_breaks(col), "\n", -1)
    )


def clean_heading(col: Column) -> Column:
    return squeeze(F.btrim(strip(col), F.lit("#")))


def contains_word(text: Column, word: Column) -> Column:
    """Whether ``word`` occurs in ``text`` between word boundaries."""
    boundary = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return (word != "") & F.regexp_like(text, F.concat(F.lit(boundary), quoted, F.lit(boundary)))


def four_decimals(x: Column) -> Column:
    """A number from 0 up as Python's ``.4f`` prints it: by its exact binary value, exact ties to even.

    The number is split into two halves whose products with 20,000 are exact,
    so its place against the tie between two neighbours is known exactly.
    """
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    low = x - high
    base = F.floor(x * F.lit(10000.0))
    over = (high * F.lit(20000.0) - (base * 2 + 1).cast("double")) + low * F.lit(20000.0)
    up = (over > 0) | ((over == 0) & (base % 2 == 1))
    n = base + F.when(up, 1).otherwise(0)
    return F.format_string("%d.%04d", F.floor(n / 10000), n % 10000)
