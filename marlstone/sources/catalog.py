"""The catalog of documentation sources."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from marlstone.config import CorpusConfig


@dataclass(frozen=True)
class Source:
    """One documentation source. ``path`` is its checkout or mirror folder."""

    name: str
    repo_url: str
    path: str
    url_base: str
    prefix_source_path: bool = True
    file_suffixes: tuple[str, ...] = (".md",)
    include_parts: tuple[str, ...] = ()
    source_url_base: str | None = None
    llms_txt_url: str | None = None


CATALOG_SCHEMA = (
    "name string, repo_url string, path string, url_base string, prefix_source_path boolean, "
    "file_suffixes array<string>, include_parts array<string>, source_url_base string, "
    "llms_txt_url string"
)
_GITHUB = "https://github.com"

# The default sources. The first one is the main source.
DEFAULT_SOURCES = (
    Source(
        "xrpl-docs", f"{_GITHUB}/XRPLF/xrpl-dev-portal.git", ".cache/xrpl-dev-portal",
        "https://xrpl.org/docs/", prefix_source_path=False, file_suffixes=(".md", ".mdx"),
    ),
    Source(
        "xrpl-py", f"{_GITHUB}/XRPLF/xrpl-py.git", ".cache/xrpl-py",
        "https://xrpl-py.readthedocs.io/en/stable/",
        file_suffixes=(".md", ".py", ".rst"), include_parts=("docs", "xrpl"),
        source_url_base=f"{_GITHUB}/XRPLF/xrpl-py/blob/main/",
    ),
    Source(
        "xrpl-js", f"{_GITHUB}/XRPLF/xrpl.js.git", ".cache/xrpl.js", "https://js.xrpl.org/",
        file_suffixes=(".html", ".md"), include_parts=("docs", "packages", "README.md"),
    ),
    Source(
        "xaman-docs", f"{_GITHUB}/XRPL-Labs/Developer-Help-Center.git", ".cache/xaman-docs",
        "https://docs.xaman.dev/",
    ),
    Source(
        "joey-docs", "", ".cache/joey-docs", "https://docs.joeywallet.xyz/",
        llms_txt_url="https://docs.joeywallet.xyz/llms.txt",
    ),
    Source(
        "xls-standards", f"{_GITHUB}/XRPLF/XRPL-Standards.git", ".cache/xrpl-standards",
        f"{_GITHUB}/XRPLF/XRPL-Standards/blob/master/",
    ),
    Source(
        "xrpl4j", f"{_GITHUB}/XRPLF/xrpl4j.git", ".cache/xrpl4j",
        f"{_GITHUB}/XRPLF/xrpl4j/blob/main/",
    ),
    Source(
        "xrpl-go", f"{_GITHUB}/XRPLF/xrpl-go.git", ".cache/xrpl-go",
        f"{_GITHUB}/XRPLF/xrpl-go/blob/main/",
    ),
    Source(
        "clio", f"{_GITHUB}/XRPLF/clio.git", ".cache/clio", f"{_GITHUB}/XRPLF/clio/blob/develop/",
    ),
    Source(
        "xahau-docs", f"{_GITHUB}/Xahau/Xahau-Docs.git", ".cache/xahau-docs",
        "https://docs.xahau.network/",
    ),
    Source(
        "gemwallet-docs", f"{_GITHUB}/GemWallet/gemwallet-website.git", ".cache/gemwallet-website",
        "https://gemwallet.app/docs/", file_suffixes=(".md", ".mdx"), include_parts=("docs",),
    ),
    Source(
        "ledger-docs", "", ".cache/ledger-docs", "https://developers.ledger.com/docs/",
        llms_txt_url="https://developers.ledger.com/llms.txt",
    ),
)
SITE_TITLE_SUFFIX = "xrpl"


def catalog_frame(spark: SparkSession, sources: Iterable[Source] = DEFAULT_SOURCES) -> DataFrame:
    rows = [
        (
            s.name, s.repo_url, s.path, s.url_base, s.prefix_source_path,
            sorted(s.file_suffixes), list(s.include_parts), s.source_url_base, s.llms_txt_url,
        )
        for s in sources
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def sources_for_ingest(
    config: CorpusConfig,
    single_source: bool = False,
    sources: tuple[Source, ...] = DEFAULT_SOURCES,
) -> tuple[Source, ...]:
    """Sources with absolute paths; the main one sits at ``config.docs_path``.

    ``single_source`` limits the catalog to the main source.
    """
    main = replace(sources[0], path=config.docs_path)
    if single_source:
        return (main,)
    return (main, *(replace(s, path=os.path.abspath(s.path)) for s in sources[1:]))
