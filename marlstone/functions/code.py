"""Expressions over C and C++ source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.text import WORD, WS

# Words that look like a call or a function name but are not.
CONTROL_WORDS = (
    "if", "for", "while", "switch", "return", "sizeof", "static_cast",
    "dynamic_cast", "reinterpret_cast", "const_cast", "catch",
)
TYPE_WORDS = ("class", "struct", "enum", "namespace")
TRUNCATED = "[truncated]"
LOOK_AHEAD = 12

IDENTIFIER = rf"[A-Za-z_]{WORD}*+"
INCLUDE = rf"^{WS}*#include{WS}+[<\"]([^>\"]+)[>\"]"
NAMESPACE = rf"^{WS}*namespace{WS}+({IDENTIFIER}){WS}*\{{"
CLASS = rf"^{WS}*(class|struct){WS}+({IDENTIFIER})"
CALL = rf"(?<!{WORD})({IDENTIFIER}){WS}*+\("
FUNCTION_NAME = rf"\A~?{IDENTIFIER}(?:::[~A-Za-z_]{WORD}*+)*+\z"
TRAILING_IDENTIFIER = rf"(?<!{WORD}){IDENTIFIER}\z"


def strip_comments_and_strings(code: Column) -> Column:
    """Line comments, block comments, then string and character literals."""
    code = F.regexp_replace(code, r"//[^\n]*", "")
    code = F.regexp_replace(code, r"(?s)/\*.*?\*/", "")
    code = F.regexp_replace(code, r'"(?:[^"\\]++|\\[^\n])*+"', '""')
    return F.regexp_replace(code, r"'(?:[^'\\]++|\\[^\n])*+'", "''")


def brace_delta(line: Column) -> Column:
    opened = F.length(F.replace(line, F.lit("}"), F.lit("")))
    closed = F.length(F.replace(line, F.lit("{"), F.lit("")))
    return opened - closed


def calls(code: Column, own_name: Column) -> Column:
    """Called names in order of first use, without control words and recursion."""
    found = F.regexp_extract_all(strip_comments_and_strings(code), F.lit(CALL), F.lit(1))
    other = F.filter(found, lambda name: (name != own_name) & ~name.isin(*CONTROL_WORDS))
    return F.array_distinct(other)


def imports(lines: Column) -> Column:
    included = F.filter(lines, lambda line: line.rlike(INCLUDE))
    return F.transform(included, lambda line: F.regexp_extract(line, INCLUDE, 1))


def can_start_signature(stripped: Column) -> Column:
    prefix = tx.strip(F.substring_index(stripped, "(", 1))
    return (
        (stripped != "")
        & ~stripped.rlike(rf"^(?:#|//|/\*|\*|(?:{'|'.join(TYPE_WORDS)}) )")
        & ~prefix.isin(*CONTROL_WORDS)
        & (stripped.contains("(") | stripped.rlike(TRAILING_IDENTIFIER))
    )


def raw_function_name(signature: Column) -> Column:
    """Last word before the first parenthesis, without pointer and reference marks."""
    prefix = tx.strip(F.substring_index(signature, "(", 1))
    return F.btrim(F.regexp_replace(prefix, rf"(?s)\A.*{WS}", ""), F.lit("*&"))


def looks_like_function(signature: Column) -> Column:
    def named(name: Column) -> Column:
        return ~name.isin(*CONTROL_WORDS, *TYPE_WORDS) & name.rlike(FUNCTION_NAME)

    def judged(whole: Column) -> Column:
        return whole.rlike(r"(?s)\A(?=.*\)).*\(") & tx.let(raw_function_name(whole), named)

    return tx.let(signature, judged)


def join_signature(stripped_lines: Column) -> Column:
    bare = lambda line: tx.strip(F.replace(line, F.lit("{"), F.lit(" ")))
    return F.array_join(F.transform(stripped_lines, bare), " ")


def class_of(raw_name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(raw_name, "::"), F.lit(-2)), F.lit(""))


def qualify(namespace: Column, name: Column) -> Column:
    return F.when(namespace != "", F.concat(namespace, F.lit("::"), name)).otherwise(name)


def truncate(code: Column, limit: int) -> Column:
    if limit <= len(TRUNCATED):
        short = F.lit(TRUNCATED[:limit])
    else:
        kept = tx.rstrip(F.substring(code, 1, limit - len(TRUNCATED)))
        short = F.concat(kept, F.lit(TRUNCATED))
    return F.when(F.length(code) <= limit, code).otherwise(short)


def line_comment_text(stripped_lines: Column) -> Column:
    """Text of a run of ``//`` lines."""
    bare = lambda line: tx.strip(F.regexp_replace(line, "^//", ""))
    return tx.strip(F.array_join(F.transform(stripped_lines, bare), "\n"))


def block_comment_text(stripped_lines: Column) -> Column:
    """Text of a block comment: no delimiters, no leading stars, no empty lines."""
    whole = tx.strip(F.array_join(stripped_lines, "\n"))
    inner = tx.strip(F.regexp_replace(whole, r"^/\*", ""))
    inner = F.regexp_replace(inner, r"\*/\z", "")
    bare = lambda line: tx.strip(F.ltrim(tx.strip(line), F.lit("*")))
    return F.array_join(
        F.filter(F.transform(F.split(inner, "\n"), bare), lambda line: line != ""), "\n"
    )


def record_id(file: Column, kind: Column, name: Column, line: Column, code: Column) -> Column:
    return F.sha2(F.concat_ws("\0", file, kind, name, line.cast("string"), code), 256)
