"""Markdown and MDX pages: front matter, component lines, headings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as tx

FRONT_MATTER = rf"(?s)\A---{tx.WS}*\n(.*?)\n---{tx.WS}*\n?"
# A line holding only an import/export statement or one component tag.
_COMPONENT_LINE = (
    rf"{tx.BLANK}*+(?:(?:import|export) {tx.BLANK}*+[^\n]++"
    rf"|</?[A-Z][A-Za-z0-9_.:-]*(?:{tx.BLANK}[^>\n]*)?/?>{tx.BLANK}*)(?:\n|\z)"
)
_FENCE_OR_COMPONENT = (
    rf"(?md)^(?={tx.BLANK}*+(?:```|[ie<]))(?:({tx.FENCE})|{_COMPONENT_LINE})"
)


def front_matter(raw: Column) -> Column:
    """The YAML block, or NULL when the file has none."""
    return F.when(raw.rlike(FRONT_MATTER), F.regexp_extract(raw, FRONT_MATTER, 1))


def body(raw: Column) -> Column:
    return F.regexp_replace(raw, FRONT_MATTER, "")


def drop_component_lines(text: Column) -> Column:
    """Remove MDX-only lines outside fenced blocks."""
    return F.regexp_replace(tx.unify_breaks(text), _FENCE_OR_COMPONENT, "$1")


def headings(text: Column) -> Column:
    """Cleaned headings outside fenced blocks, in page order."""
    unfenced = F.regexp_replace(tx.unify_breaks(text), rf"(?md)^{tx.FENCE}", "")
    found = F.regexp_extract_all(unfenced, F.lit(rf"(?md)^{tx.HEADING}([^\n]++)"), F.lit(2))
    return F.transform(found, tx.clean_heading)


def _yaml_title(block: str) -> dict:
    import yaml

    data = yaml.safe_load(block)
    title = data.get("title") if isinstance(data, dict) else None
    return {"title": title.strip() or None} if isinstance(title, str) else {}


def _yaml_batch(block: pa.Array) -> pa.Array:
    kind = pa.struct([("title", pa.string()), ("error", pa.string())])
    return tx.read_each(_yaml_title, block, kind, "YAML")


def yaml_title(block: Column) -> Column:
    """title and error of each YAML block; the title only when it is non-blank text."""
    return tx.evaluated_once(_yaml_batch, "struct<title:string,error:string>")(block)
