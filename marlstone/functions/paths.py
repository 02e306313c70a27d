"""Expressions over "/"-separated relative paths and the URLs made from them."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Path components. Arrays compare element-wise, so this is also the sort key."""
    return F.split(path, "/")


def directories(path: Column) -> Column:
    return F.slice(parts(path), 1, F.size(parts(path)) - 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    """Name of the directory holding the file, or ''."""
    return F.coalesce(F.try_element_at(parts(path), F.lit(-2)), F.lit(""))


def _raw_suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)\z", 1)


def suffix(path: Column) -> Column:
    """Last dot suffix in lower case; dot-files such as ``.md`` have none."""
    return F.lower(_raw_suffix(path))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(_raw_suffix(path)))


def matches_any_glob(path: Column, patterns: Iterable[str]) -> Column:
    """Shell globs against the whole path or the file name; ``*`` crosses "/"."""
    hit = F.lit(False)
    for pattern in patterns:
        # fnmatch.translate ends in \Z, which Java reads as "before a final
        # line break"; \z is the same anchor there.
        regex = r"\A" + fnmatch.translate(pattern).removesuffix(r"\Z") + r"\z"
        hit = hit | path.rlike(regex) | basename(path).rlike(regex)
    return hit


def source_path(source_name: Column, path: Column, prefixed: Column) -> Column:
    return F.when(prefixed, F.concat(source_name, F.lit(":"), path)).otherwise(path)


def _site_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^docs/", ""), r"\.mdx?\n?\z", "")


def docs_url(path: Column, url_base: Column) -> Column:
    """Public page of a Markdown file kept in the main documentation source."""
    page = F.regexp_replace(_site_path(path), r"/index\n?\z", "")
    return F.concat(F.rtrim(url_base, F.lit("/")), F.lit("/"), F.btrim(page, F.lit("/")))


def source_url(path: Column, url_base: Column) -> Column:
    """Public page of any file: a repository link keeps the real path."""
    page = F.regexp_replace(_site_path(path), r"\.rst\n?\z", ".html")
    page = F.regexp_replace(page, r"/index\n?\z", "")
    shown = F.when(url_base.contains("/blob/"), path).otherwise(page)
    return F.concat(F.rtrim(url_base, F.lit("/")), F.lit("/"), F.btrim(shown, F.lit("/")))


def module_name(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.py\n?\z", ""), F.lit("/"), F.lit("."))
