"""Raw files to parsed pages, one row in and one row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import paths
from marlstone.functions import text as tx
from marlstone.operators import html, markdown, pydoc, rst

MARKDOWN_SUFFIXES = (".md", ".mdx")
PAGE_COLUMNS = ("source_name", "source_path", "title", "url", "text", "headings")


def _by_format(suffix: Column, md: Column, rst_: Column, html_: Column, py: Column) -> Column:
    return (
        F.when(suffix.isin(*MARKDOWN_SUFFIXES), md)
        .when(suffix == ".rst", rst_)
        .when(suffix == ".html", html_)
        .when(suffix == ".py", py)
    )


def parse_files(files: DataFrame, main_source: str = "", site_suffix: str = "") -> DataFrame:
    """Parse every file by its suffix in one pass over the input.

    ``files`` needs source_name, rel_path, content (binary), url_base,
    source_url_base and prefix_source_path. The result holds PAGE_COLUMNS and
    ``error``, which is NULL for a good page. Files that cannot be decoded or
    parsed keep their row with the reason in ``error``. A ``position`` column is
    carried along.
    """
    extra = ["position"] if "position" in files.columns else []
    suffix = F.col("suffix")
    is_markdown = suffix.isin(*MARKDOWN_SUFFIXES)

    decoded = files.select(
        *extra, "source_name", "rel_path", "content", "prefix_source_path",
        F.col("url_base"),
        F.coalesce("source_url_base", "url_base").alias("code_url_base"),
        paths.suffix(F.col("rel_path")).alias("suffix"),
        F.col("content").cast("string").alias("decoded"),
    ).withColumn(
        # HTML pages drop bad bytes instead of failing.
        "raw",
        F.when(
            (suffix != ".html") & F.is_valid_utf8("decoded"), tx.unify_newlines(F.col("decoded"))
        ),
    )

    # The three Python readers see only the rows of their own format, run in
    # one worker pass, and get no more than they need (for Markdown just the
    # front matter block).
    read = decoded.withColumns(
        {
            "yaml": markdown.yaml_title(F.when(is_markdown, markdown.front_matter(F.col("raw")))),
            "html": html.read_html(F.when(suffix == ".html", F.col("content"))),
            "python": pydoc.read_python(F.when(suffix == ".py", F.col("raw"))),
        }
    )

    module = paths.module_name(F.col("rel_path"))
    with_text = read.withColumn(
        "text",
        tx.strip(
            _by_format(
                suffix,
                markdown.drop_component_lines(markdown.body(F.col("raw"))),
                rst.clean(F.col("raw")),
                html.normalize(F.col("html.body")),
                pydoc.page_text(module, F.col("python")),
            )
        ),
    ).withColumn(
        "headings",
        _by_format(
            suffix,
            markdown.headings(F.col("text")),
            rst.headings(F.col("raw")),
            html.headings(F.col("html.headings")),
            pydoc.headings(module, F.col("python")),
        ),
    )

    stem = paths.stem(F.col("rel_path"))
    first_heading = F.try_element_at("headings", F.lit(1))
    url_base = F.when(suffix == ".py", F.col("code_url_base")).otherwise(F.col("url_base"))
    main_markdown = (F.col("source_name") == main_source) & ~F.col("prefix_source_path") & is_markdown
    html_title = html.title(F.col("html.title"), F.col("headings"), site_suffix)

    return with_text.select(
        *extra,
        "source_name",
        paths.source_path(
            F.col("source_name"), F.col("rel_path"), F.col("prefix_source_path")
        ).alias("source_path"),
        _by_format(
            suffix,
            F.coalesce(F.col("yaml.title"), first_heading, stem),
            F.coalesce(first_heading, stem),
            F.when(html_title != "", html_title).otherwise(stem),
            module,
        ).alias("title"),
        F.when(main_markdown, paths.docs_url(F.col("rel_path"), url_base))
        .otherwise(paths.source_url(F.col("rel_path"), url_base))
        .alias("url"),
        "text",
        "headings",
        F.coalesce(
            F.when(
                ~suffix.isin(*MARKDOWN_SUFFIXES, ".rst", ".html", ".py"),
                F.concat(F.lit("unsupported file type: "), suffix),
            ),
            F.when(F.col("content").isNull(), F.lit("could not be read")),
            F.when((suffix != ".html") & F.col("raw").isNull(), F.lit("not valid UTF-8")),
            F.col("yaml.error"),
            F.col("html.error"),
            F.col("python.error"),
        ).alias("error"),
    )


def good_pages(parsed: DataFrame) -> DataFrame:
    extra = ["position"] if "position" in parsed.columns else []
    return parsed.where(F.col("error").isNull()).select(*extra, *PAGE_COLUMNS)


def bad_files(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select("source_name", "source_path", "error")
