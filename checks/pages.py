"""HTML pages: text, titles, headings, sections, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import query
from checks.documents import CHUNK_ID, CHUNKS
from marlstone.operators.chunk import chunk_pages, page_sections
from marlstone.operators.parse import good_pages, parse_files
from marlstone.session import small_batches
from marlstone.sources.tables import as_files, read_table

def _replace(inner: str, pattern: str, by: str) -> str:
    return f"regexp_replace({inner}, '{pattern}', {by}, 'g')"


def _entities(text: str) -> str:
    """The entities in the tables; as in HTML, their semicolon may be missing."""
    for name, char in (("quot", "chr(34)"), ("lt", "chr(60)"), ("gt", "chr(62)"), ("amp", "chr(38)")):
        text = _replace(text, f"&{name};?", char)
    return text


def _html_text() -> str:
    text = "html"
    text = _replace(text, "(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "''")
    for tag in ("script", "style", "nav", "footer", "header", "button", "title"):
        text = _replace(text, f"(?s)<{tag}(?: [^>]*)?>.*?</{tag}>", "''")
    for level in range(1, 7):
        text = _replace(text, f"<h{level}(?: [^>]*)?>", f"chr(10) || '{'#' * level} '")
    blocks = "article|blockquote|br|div|h[1-6]|li|p|pre|section|table|td|th|tr|ul|ol"
    text = _replace(text, f"</?(?:{blocks})(?: [^>]*)?>", "chr(10)")
    text = _replace(text, "<[^>]*>", "''")
    text = _entities(text)
    text = _replace(text, "[ \t]+", "' '")
    text = _replace(text, "(?m)^ | $", "''")
    text = _replace(text, "\n{3,}", "chr(10) || chr(10)")
    return f"trim({text}, ' ' || chr(10))"


def _heading() -> str:
    raw = "regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)"
    text = _entities(_replace(raw, "<[^>]*>", "''"))
    return f"trim({_replace(text, '[ ' + chr(10) + ']+', SPACE)}, '# ')"


SPACE = "' '"
H1 = _heading()
PARSED = f"parsed as (select page_id, {H1} as title, {_html_text()} as text from pages)"


def parsed_pages(spark, folder):
    small_batches(spark)
    pages = read_table(spark, folder, "pages").select("page_id", "html")
    path = F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html"))
    files = as_files(pages, path, F.col("html"), "site", "https://site.example.com/", prefix_source_path=True)
    page_id = F.regexp_extract("source_path", r"(\d+)\.html$", 1).cast("bigint")
    return good_pages(parse_files(files)).withColumn("page_id", page_id)


@query("html_to_text", f"with {PARSED} select page_id, text from parsed")
def html_to_text(spark, folder):
    return parsed_pages(spark, folder).select("page_id", "text")


@query("html_title", f"with {PARSED} select page_id, title from parsed")
def html_title(spark, folder):
    return parsed_pages(spark, folder).select("page_id", "title")


@query("html_headings", f"with {PARSED} select page_id, 0 as position, title as heading from parsed")
def html_headings(spark, folder):
    return parsed_pages(spark, folder).select(
        "page_id", F.posexplode("headings").alias("position", "heading")
    )


@query(
    "html_pages",
    f"""with {PARSED}
    select 'site:site/' || cast(page_id as varchar) || '.html' as source_path, title,
           'https://site.example.com/site/' || cast(page_id as varchar) || '.html' as url,
           sha256(text) as text_hash
    from parsed""",
)
def html_pages(spark, folder):
    return parsed_pages(spark, folder).select(
        "source_path", "title", "url", F.sha2("text", 256).alias("text_hash")
    )


# Text before the page's one heading line is titled by the page itself.
SECTIONS = """
cut as (
  select page_id, title,
         regexp_extract(text, '(?s)^(.*?)(?:^|\n)# ', 1) as before,
         trim(regexp_extract(text, '(?s)(?:^|\n)# [^\n]*(.*)$', 1), ' ' || chr(10)) as after
  from parsed
),
section as (
  select page_id, title, 0 as section_index, title as heading_path,
         trim(before, ' ' || chr(10)) as text
  from cut where trim(before, ' ' || chr(10)) <> ''
  union all
  select page_id, title, case when trim(before, ' ' || chr(10)) <> '' then 1 else 0 end,
         title, after
  from cut where after <> ''
)
""".replace("\\n", "\n")


@query(
    "html_sections",
    f"with {PARSED}, {SECTIONS} select page_id, section_index, heading_path, text from section",
)
def html_sections(spark, folder):
    return page_sections(parsed_pages(spark, folder), keep=("page_id",))


@query(
    "html_chunks",
    f"""with {PARSED}, {SECTIONS},
    page as (
      select page_id, section_index, 'site:site/' || cast(page_id as varchar) || '.html' as source_path,
             title, text
      from section
    ), {CHUNKS}
    select page_id, part_index, {CHUNK_ID} as chunk_id, text from chunk""",
)
def html_chunks(spark, folder):
    return chunk_pages(parsed_pages(spark, folder), keep=("page_id",)).select(
        "page_id", "part_index", "chunk_id", "text"
    )


@query(
    "bad_files",
    """select 'mixed:' || cast(page_id as varchar)
        || case page_id % 5 when 0 then '.html' when 1 then '.md' when 2 then '.py' when 3 then '.md' else '.txt' end
        as source_path,
      case page_id % 5 when 0 then 'HTML' when 1 then 'YAML' when 2 then 'Python' when 3 then 'good'
        else 'unsupported file type' end as outcome
    from pages
    union all
    select 'mixed:d' || cast(doc_id as varchar) || '.rst',
      case when doc_id % 3 = 0 then 'not valid UTF-8' else 'good' end
    from documents""",
)
def bad_files_listed(spark, folder):
    """Pages and documents, most of them broken in the way of their format, in one parse."""
    pages = read_table(spark, folder, "pages").select("page_id", "html")
    kind = F.col("page_id") % 5
    suffix = F.element_at(F.array(*map(F.lit, (".html", ".md", ".py", ".md", ".txt"))), (kind + 1).cast("int"))
    content = (
        F.when(kind == 0, F.concat("html", F.lit("<![odd mark]]>")))
        .when(kind == 1, F.concat(F.lit("---\nday: 2024-02-30\n---\n"), "html"))
        .when(kind == 2, F.concat(F.lit("def ("), "html"))
        .otherwise(F.col("html"))
    )
    documents = read_table(spark, folder, "documents").select("doc_id", "text")
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary")))
    files = as_files(pages, F.concat(F.col("page_id").cast("string"), suffix), content, "mixed", prefix_source_path=True).unionByName(
        as_files(
            documents,
            F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".rst")),
            F.coalesce(broken, F.col("text").cast("binary")),
            "mixed",
            prefix_source_path=True,
        )
    )
    parsed = parse_files(files)
    return parsed.select(
        "source_path", F.coalesce(F.substring_index("error", ":", 1), F.lit("good")).alias("outcome")
    )
