"""Python modules: public API outline from the syntax tree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import evaluated_once, read_each

OUTLINE_SCHEMA = (
    "struct<doc:string,"
    "objects:array<struct<name:string,level:int,signature:string,doc:string>>,"
    "error:string>"
)


def _outline(code: str) -> dict:
    import ast
    import copy
    import inspect

    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def doc(node) -> str:
        # The stdlib already cleans the docstring; a second pass also removes
        # the indentation left below a docstring that opened on a blank line.
        return inspect.cleandoc(ast.get_docstring(node) or "")

    def public(body, kinds):
        return (n for n in body if isinstance(n, kinds) and not n.name.startswith("_"))

    def signature(node) -> str:
        """The object's own header: unparsed with nothing but bases or arguments left."""
        shell = copy.copy(node)
        shell.body, shell.decorator_list, shell.type_params = [ast.Pass()], [], []
        if isinstance(node, ast.ClassDef):
            shell.keywords = []
        return ast.unparse(shell).strip().rsplit(":\n", 1)[0]

    def entry(node, name, level) -> dict:
        return {"name": name, "level": level, "signature": signature(node), "doc": doc(node)}

    tree = ast.parse(code)
    objects = []
    for top in public(tree.body, (ast.ClassDef, *functions)):
        objects.append(entry(top, top.name, 2))
        if isinstance(top, ast.ClassDef):
            methods = public(top.body, functions)
            objects += [entry(m, f"{top.name}.{m.name}", 3) for m in methods]
    return {"doc": doc(tree), "objects": objects}


def _outline_batch(code: pa.Array) -> pa.Array:
    item = pa.struct(
        [("name", pa.string()), ("level", pa.int32()), ("signature", pa.string()), ("doc", pa.string())]
    )
    kind = pa.struct([("doc", pa.string()), ("objects", pa.list_(item)), ("error", pa.string())])
    return read_each(_outline, code, kind, "Python")


def read_python(code: Column) -> Column:
    """Module docstring and public objects of each module."""
    return evaluated_once(_outline_batch, OUTLINE_SCHEMA)(code)


def _docblock(doc: Column) -> Column:
    return F.when(doc != "", F.concat(F.lit("\n\n"), doc)).otherwise("")


def page_text(module: Column, outline: Column) -> Column:
    """The outline as Markdown: a heading, signature and docstring per object."""
    sections = F.transform(
        outline["objects"],
        lambda o: F.concat(
            F.lit("\n\n"), F.repeat(F.lit("#"), o["level"]), F.lit(" "), o["name"],
            F.lit("\n\n"), o["signature"], _docblock(o["doc"]),
        ),
    )
    return F.concat(F.lit("# "), module, _docblock(outline["doc"]), F.array_join(sections, ""))


def headings(module: Column, outline: Column) -> Column:
    return F.concat(F.array(module), F.transform(outline["objects"], lambda o: o["name"]))
