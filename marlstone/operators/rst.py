"""reStructuredText pages: underlined headings, directives, inline markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as tx

# The underline characters, and the heading level of each
# (any other underline character is level 6).
UNDERLINE = r"^([=\-~^\"'#*+`])\1*$"
LEVELS = {"=": 1, "-": 2, "~": 3, "^": 4, '"': 5}
OTHER_LEVEL = 6

# U+001D and U+001C are line breaks too, hence absent from single lines.
_DIRECTIVE = "\x1d"
_OPTION = "\x1c"


def _underlines(candidate: Column, title: Column) -> Column:
    length = F.length(title)
    return (length > 0) & (F.length(candidate) >= length) & candidate.rlike(UNDERLINE)


def _with_neighbours(text: Column, body) -> Column:
    """``body`` over each line with the stripped lines before, at and after it."""

    def zipped(rows: Column) -> Column:
        def shifted(bare: Column) -> Column:
            edge = F.array(F.lit(""))
            count = F.size(bare)
            return F.arrays_zip(
                rows.alias("raw"),
                bare.alias("here"),
                F.slice(F.concat(edge, bare), F.lit(1), count).alias("before"),
                F.slice(F.concat(bare, edge), F.lit(2), count).alias("after"),
            )

        return tx.let(F.transform(rows, tx.strip), shifted)

    return F.transform(tx.let(tx.lines(text), zipped), body)


def headings(text: Column) -> Column:
    """Cleaned titles that carry a long enough underline."""
    marked = _with_neighbours(
        text,
        lambda x: F.when(_underlines(x["after"], x["here"]), tx.clean_heading(x["here"])),
    )
    return F.filter(marked, lambda h: h.isNotNull())


def _level(underline: Column) -> Column:
    level = F.lit(OTHER_LEVEL)
    for char, value in LEVELS.items():
        level = F.when(F.startswith(underline, F.lit(char)), value).otherwise(level)
    return level


def _inline(line: Column) -> Column:
    literal = F.regexp_replace(line, "``([^`]+)``", "`$1`")
    return F.regexp_replace(literal, rf"`([^`<]+?){tx.WS}*<[^>]+>`_", "$1")


def clean(text: Column) -> Column:
    """Page text: ``#`` headings, no underlines, no directives or their options.

    Directive state runs down the page, so directive and option lines are only
    tagged here and one pattern then removes each directive with the options
    right below it.
    """
    tagged = _with_neighbours(
        text,
        lambda x: F.when(_underlines(x["here"], x["before"]), F.lit(None).cast("string"))
        .when(
            _underlines(x["after"], x["here"]),
            F.concat(F.repeat(F.lit("#"), _level(x["after"])), F.lit(" "), x["here"]),
        )
        .when(x["here"].startswith(".. "), F.lit(_DIRECTIVE))
        .when(x["raw"].startswith("   :"), F.concat(F.lit(_OPTION), _inline(x["raw"])))
        .otherwise(_inline(x["raw"])),
    )
    joined = F.array_join(F.filter(tagged, lambda line: line.isNotNull()), "\n")
    pruned = F.regexp_replace(
        joined, rf"(?:\A|\n){_DIRECTIVE}(?:\n(?:{_OPTION}[^\n]*+|{_DIRECTIVE}))*+", ""
    )
    return F.replace(pruned, F.lit(_OPTION), F.lit(""))
