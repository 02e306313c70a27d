"""Python files to class and function records, by a table function over their syntax trees."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import code as cx
from marlstone.operators.cpp import MAX_CODE_CHARS

LANGUAGE = "python"
SUFFIXES = (".py",)
_ROW = (
    "kind string, name string, raw_name string, line_start int, line_end int, class_name string, "
    "signature string, docstring string, imports array<string>, code string, calls array<string>"
)


class _Objects:
    """Classes and functions of a module and of its classes, outermost first; none of a module that does not parse."""

    def eval(self, text: str, pause: float):
        import ast

        if pause:
            time.sleep(pause)
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        lines = text.split("\n")
        imports = []
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                imports += [a.name for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                imports.append("." * node.level + (node.module or ""))
        imports = list(dict.fromkeys(imports))
        functions = (ast.FunctionDef, ast.AsyncFunctionDef)

        def called(node) -> list[str]:
            names = [
                c.func.id if isinstance(c.func, ast.Name) else c.func.attr
                for c in ast.walk(node)
                if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))
            ]
            return list(dict.fromkeys(n for n in names if n != node.name))

        def row(node, owner: str):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            is_function = isinstance(node, functions)
            head = ""
            if is_function:
                word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
                back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
                head = f"{word} {node.name}({ast.unparse(node.args)}){back}"
            return (
                "function" if is_function else "class", node.name, f"{owner}.{node.name}" if owner else node.name,
                first, node.end_lineno, owner if is_function else "", head, ast.get_docstring(node) or "",
                imports, "\n".join(lines[first - 1 : node.end_lineno]), called(node) if is_function else [],
            )

        pending = [(node, "") for node in reversed(tree.body)]
        while pending:
            node, owner = pending.pop()
            if isinstance(node, (ast.ClassDef, *functions)):
                yield row(node, owner)
            if isinstance(node, ast.ClassDef):
                inner = f"{owner}.{node.name}" if owner else node.name
                pending += [(child, inner) for child in reversed(node.body)]


def analyze(files: DataFrame, max_code_chars: int = MAX_CODE_CHARS, throttle_ms: int = 0) -> DataFrame:
    """Records of every Python file, with the columns of ``cpp.RECORD_SCHEMA``. No shuffle.

    ``files`` needs rel_path and text (null for undecodable files, which give
    no records). The namespace is the module's dotted path.
    """
    objects = F.udtf(_Objects, returnType=_ROW, useArrow=True)
    pause = F.lit(max(0, throttle_ms) / 1000)
    readable = files.where(F.col("text").isNotNull()).select("rel_path", "text")
    rows = readable.lateralJoin(objects(F.col("text").outer(), pause)).drop("text")
    module = F.regexp_replace(F.regexp_replace("rel_path", r"(/__init__)?\.[^./]*$", ""), "/", ".")
    full, is_function = F.col("code"), F.col("kind") == "function"
    named = rows.withColumn("namespace", module).withColumn(
        "qualified_name", F.concat_ws(".", F.when(F.col("namespace") != "", F.col("namespace")), "raw_name")
    )
    return named.select(
        cx.record_id(F.col("rel_path"), F.col("kind"), F.col("qualified_name"), F.col("line_start"), full).alias("record_id"),
        "kind", F.lit(LANGUAGE).alias("language"), "name", "qualified_name", F.col("rel_path").alias("file"),
        "line_start", "line_end", "class_name", "namespace", "signature", "docstring", "imports",
        F.when(is_function, cx.truncate(full, max_code_chars)).otherwise(full).alias("code"), "calls",
    )
