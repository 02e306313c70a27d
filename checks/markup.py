"""Markdown, reStructuredText and Python pages written out of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import derived, for_spark, query, text_of
from checks.documents import CHUNK_ID, CHUNKS
from marlstone.operators import markdown, rst
from marlstone.operators.chunk import chunk_pages, page_sections
from marlstone.operators.parse import good_pages, parse_files
from marlstone.plans.code_map import ANALYZERS, analyze_files
from marlstone.sources.tables import as_files

# -- Markdown ------------------------------------------------------------------

# Forty parts make a page; a part's key decides what kind of line it becomes.
MD_LINES = """
select floor(p_partkey / 40) as page, p_partkey as line_no,
  case p_partkey % 13
    when 0 then repeat('#', 1 + p_size % 6) || ' ' || p_name || ' ' || cast(p_partkey as varchar(20))
    when 1 then p_type || ' text of ' || p_brand
    when 2 then ''
    when 3 then '```' || p_type
    when 4 then 'import ' || chr(123) || ' x ' || chr(125) || ' from ' || p_name
    when 5 then '  <Callout kind=' || chr(34) || p_type || chr(34) || '>'
    when 6 then '   ' || repeat('#', 1 + p_size % 3) || '   ' || p_name || '   part  ## '
    when 7 then '#' || p_name
    when 8 then 'export default ' || p_name
    when 9 then '</Callout>'
    when 10 then repeat('#', 7) || ' ' || p_name
    when 11 then 'see <b>' || p_name || '</b>  and   more'
    else '## Same'
  end as line
from part
"""


def _md_pages(spark_dialect: bool) -> str:
    return f"""
select page,
  case cast(page as int) % 3
    when 0 then '---' || chr(10) || 'title: "Page ' || cast(cast(page as int) as varchar(20)) || '"' || chr(10)
         || 'tags: [a, b]' || chr(10) || '---' || chr(10) || chr(10)
    when 1 then '---' || chr(10) || 'title: 42' || chr(10) || '---' || chr(10)
    else ''
  end || {text_of('line', 'line_no', spark_dialect)} as raw
from md_lines group by page"""


MD_INPUT = f"md_lines as ({MD_LINES}), md as ({_md_pages(False)})"
MD_PATH = "'docs/guide/p' || cast(cast(page as int) as varchar) || '.md'"


def md_input(spark, folder) -> DataFrame:
    sql = f"with md_lines as ({MD_LINES}) {_md_pages(True)}"
    pages = derived(spark, folder, for_spark(sql, "part"), "part")
    return pages.select(F.col("page").cast("int").alias("page"), "raw")


def md_pages(spark, folder) -> DataFrame:
    path = F.concat(F.lit("docs/guide/p"), F.col("page").cast("string"), F.lit(".md"))
    files = as_files(
        md_input(spark, folder), path, F.col("raw"), "guide", "https://docs.example.com/docs/"
    )
    page = F.regexp_extract("source_path", r"p(\d+)\.md", 1).cast("int")
    return good_pages(parse_files(files, main_source="guide")).withColumn("page", page)


# Body lines with fence state: a fence line flips the state for the lines below.
MD_STATE = f"""{MD_INPUT},
body as (
  select page, regexp_replace(raw, '(?s)^---\\s*\\n(.*?)\\n---\\s*\\n?', '') as body from md
),
numbered as (
  select page, unnest(string_split(body, chr(10))) as line,
         generate_subscripts(string_split(body, chr(10)), 1) as pos
  from body
),
fenced as (
  select *, trim(line) as bare, trim(line) like '```%' as is_fence,
         sum(case when trim(line) like '```%' then 1 else 0 end)
           over (partition by page order by pos) % 2 = 1 as inside
  from numbered
),
kept as (
  select *, not is_fence and not inside and regexp_matches(bare, '^#{{1,6}}\\s+\\S') as is_heading
  from fenced
  where is_fence or inside or not (
    regexp_matches(bare, '^(import|export) ')
    or regexp_full_match(bare, '</?[A-Z][A-Za-z0-9_.:-]*(\\s+[^>]*)?/?>'))
),
headed as (
  select *,
    case when is_heading then length(regexp_extract(bare, '^#+')) end as level,
    case when is_heading then
      trim(regexp_replace(trim(regexp_replace(bare, '^#+\\s+', ''), ' #'), '\\s+', ' ', 'g')) end
      as heading
  from kept
),
md_text as (
  select page, trim(string_agg(line, chr(10) order by pos), ' ' || chr(10)) as text
  from kept group by page
),
md_title as (
  select page, case when cast(page as int) % 3 = 0 then 'Page ' || cast(cast(page as int) as varchar)
    else coalesce((select arg_min(heading, pos) from headed h where h.page = md.page and heading is not null),
                  'p' || cast(cast(page as int) as varchar)) end as title
  from md
)"""


@query(
    "front_matter",
    f"""with {MD_INPUT}
    select cast(page as int) as page,
           case when raw like '---%' then regexp_extract(raw, '(?s)^---\\s*\\n(.*?)\\n---', 1) end as block,
           regexp_replace(raw, '(?s)^---\\s*\\n(.*?)\\n---\\s*\\n?', '') as body
    from md""",
)
def front_matter(spark, folder):
    raw = F.col("raw")
    return md_input(spark, folder).select(
        "page", markdown.front_matter(raw).alias("block"), markdown.body(raw).alias("body")
    )


@query("mdx_clean", f"with {MD_STATE} select cast(page as int) as page, text from md_text")
def mdx_clean(spark, folder):
    return md_pages(spark, folder).select("page", "text")


@query(
    "md_headings",
    f"""with {MD_STATE}
    select cast(page as int) as page,
           cast(row_number() over (partition by page order by pos) - 1 as int) as position, heading
    from headed where heading is not null""",
)
def md_headings(spark, folder):
    return md_pages(spark, folder).select("page", F.posexplode("headings").alias("position", "heading"))


@query(
    "md_pages",
    f"""with {MD_STATE}
    select {MD_PATH} as source_path, title, sha256(text) as text_hash,
           'https://docs.example.com/docs/guide/p' || cast(cast(page as int) as varchar) as url
    from md_text join md_title using (page)""",
)
def md_pages_(spark, folder):
    return md_pages(spark, folder).select(
        "source_path", "title", F.sha2("text", 256).alias("text_hash"), "url"
    )


# The open heading of level n is the last one seen, unless a heading of a
# lower level came after it.
_LEVELS = range(1, 7)
_LAST = ", ".join(
    f"max(case when level = {n} then pos end) over w as p{n}, "
    f"last_value(case when level = {n} then heading end ignore nulls) over w as h{n}"
    for n in _LEVELS
)
_PATH = "array_to_string(list_filter([{}], lambda x: x is not null), ' > ')".format(
    ", ".join(
        f"case when p{n} is not null"
        + "".join(f" and p{n} > coalesce(p{m}, 0)" for m in range(1, n))
        + f" then h{n} end"
        for n in _LEVELS
    )
)
MD_SECTIONS = f"""{MD_STATE},
lasts as (
  select page, pos, line, is_heading, {_LAST},
         sum(case when is_heading then 1 else 0 end) over w as section
  from headed window w as (partition by page order by pos rows unbounded preceding)
),
grouped as (
  select page, section, max(case when section > 0 then {_PATH} end) as path,
         trim(coalesce(string_agg(case when not is_heading then line end, chr(10) order by pos), ''),
              ' ' || chr(10)) as text
  from lasts group by page, section
),
section as (
  select page, cast(row_number() over (partition by page order by section) - 1 as int) as section_index,
         case when section = 0 then title else path end as heading_path, text
  from grouped join md_title using (page) where text <> ''
)"""


@query(
    "md_sections",
    f"with {MD_SECTIONS} select cast(page as int) as page, section_index, heading_path, text from section",
)
def md_sections(spark, folder):
    return page_sections(md_pages(spark, folder), keep=("page",))


@query(
    "md_chunks",
    f"""with {MD_SECTIONS}
    select distinct sha256({MD_PATH} || chr(0) || heading_path || chr(0) || '0' || chr(0) || text)
             as chunk_id,
           'Title: ' || title || chr(10) || 'Heading: ' || heading_path || chr(10) || chr(10) || text
             as embedding_text
    from section join md_title using (page)""",
)
def md_chunks(spark, folder):
    from marlstone.operators.chunk import dedupe_chunks

    return dedupe_chunks(chunk_pages(md_pages(spark, folder))).select("chunk_id", "embedding_text")


# -- reStructuredText ----------------------------------------------------------

RST_BLOCKS = """
select floor(p_partkey / 40) as page, p_partkey as line_no,
  case p_partkey % 11
    when 0 then p_name || chr(10) || repeat('=', length(p_name) + p_size % 3)
    when 1 then 'Use ``' || p_name || '`` and `' || p_type || ' <http://x.example/' || p_brand || '>`_ now'
    when 2 then '.. automodule:: ' || p_name || chr(10) || '   :members:' || chr(10) || '   :undoc-members: ' || p_type
    when 3 then ''
    when 4 then p_name || chr(10) || repeat('-', length(p_name) - 1)
    when 5 then '   :orphan: ``' || p_name || '``'
    when 6 then '  ' || p_name || '  two' || chr(10)
         || repeat(substr('-~^"+', 1 + p_size % 5, 1), length(p_name) + 6) || ' '
    when 7 then '.. note:: ' || p_type
    when 8 then '    indented ' || p_brand
    when 9 then repeat('=', 8) || chr(10) || p_type || chr(10) || repeat('=', 8)
    else p_type || chr(10) || repeat('*', 12) || chr(10) || repeat('*', 12)
  end as block
from part
"""


def _rst_pages(spark_dialect: bool) -> str:
    return f"select page, {text_of('block', 'line_no', spark_dialect)} as raw from blocks group by page"


RST_STATE = f"""blocks as ({RST_BLOCKS}), pages_ as ({_rst_pages(False)}),
numbered as (
  select page, unnest(string_split(raw, chr(10))) as line,
         generate_subscripts(string_split(raw, chr(10)), 1) as pos
  from pages_
),
near as (
  select *, trim(line) as bare,
         coalesce(lag(trim(line)) over w, '') as before, coalesce(lead(trim(line)) over w, '') as after
  from numbered window w as (partition by page order by pos)
),
judged as (
  select *,
    length(before) > 0 and length(bare) >= length(before)
      and regexp_full_match(bare, '=+|-+|~+|\\^+|"+|''+|#+|\\*+|\\++|`+') as is_underline,
    length(bare) > 0 and length(after) >= length(bare)
      and regexp_full_match(after, '=+|-+|~+|\\^+|"+|''+|#+|\\*+|\\++|`+') as is_title
  from near
),
sorted as (
  select *, case when is_underline then null when is_title then 0 when bare like '.. %' then 1
                 when line like '   :%' then null else 0 end as sets
  from judged
),
stated as (
  select *, coalesce(last_value(sets ignore nulls) over (
    partition by page order by pos rows between unbounded preceding and 1 preceding), 0) as after_directive
  from sorted
),
rst_clean as (
  select page, trim(string_agg(case
      when is_title then repeat('#', case after[1] when '=' then 1 when '-' then 2 when '~' then 3
                                     when '^' then 4 when '"' then 5 else 6 end) || ' ' || bare
      else regexp_replace(regexp_replace(line, '``([^`]+)``', '`\\1`', 'g'),
                          '`([^`<]+?)\\s*<[^>]+>`_', '\\1', 'g') end, chr(10) order by pos),
    ' ' || chr(10)) as text
  from stated
  where not is_underline and (is_title or not bare like '.. %')
    and not (not is_title and line like '   :%' and after_directive = 1)
  group by page
)"""


def rst_pages(spark, folder) -> DataFrame:
    sql = f"with blocks as ({RST_BLOCKS}) {_rst_pages(True)}"
    raw = derived(spark, folder, for_spark(sql, "part"), "part")
    path = F.concat(F.lit("docs/api/p"), F.col("page").cast("int").cast("string"), F.lit(".rst"))
    files = as_files(
        raw, path, F.col("raw"), "api", "https://api.example.com/", prefix_source_path=True
    )
    page = F.regexp_extract("source_path", r"p(\d+)\.rst", 1).cast("int")
    return good_pages(parse_files(files)).withColumn("page", page)


@query("rst_clean", f"with {RST_STATE} select cast(page as int) as page, text from rst_clean")
def rst_clean(spark, folder):
    return rst_pages(spark, folder).select("page", "text")


RST_HEADINGS = """
select cast(page as int) as page,
       cast(row_number() over (partition by page order by pos) - 1 as int) as position,
       regexp_replace(trim(bare, '#'), '\\s+', ' ', 'g') as heading
from judged where is_title"""


@query("rst_headings", f"with {RST_STATE} {RST_HEADINGS}")
def rst_headings(spark, folder):
    return rst_pages(spark, folder).select("page", F.posexplode("headings").alias("position", "heading"))


@query(
    "rst_pages",
    f"""with {RST_STATE}, headings as ({RST_HEADINGS})
    select 'api:docs/api/p' || cast(cast(c.page as int) as varchar) || '.rst' as source_path,
           coalesce(heading, 'p' || cast(cast(c.page as int) as varchar)) as title,
           'https://api.example.com/api/p' || cast(cast(c.page as int) as varchar) || '.html' as url,
           sha256(text) as text_hash
    from rst_clean c left join headings h on h.page = cast(c.page as int) and position = 0""",
)
def rst_pages_(spark, folder):
    return rst_pages(spark, folder).select(
        "source_path", "title", "url", F.sha2("text", 256).alias("text_hash")
    )


# -- Python modules ------------------------------------------------------------

PY_OBJECTS = """
select floor(p_partkey / 40) as module, p_partkey as line_no,
  'make_' || cast(p_partkey as varchar(20)) as name, p_name, p_type, p_size, p_partkey % 4 as kind
from part
"""


def _py_blocks(spark_dialect: bool) -> str:
    quote = "chr(34) || chr(34) || chr(34)"
    newline = "chr(10)"
    return f"""
select module, line_no, case kind
  when 0 then 'def ' || name || '(a, b: int=' || cast(p_size as varchar(20)) || ')->str:' || {newline}
    || '    ' || {quote} || 'Make ' || p_name || '.' || {newline} || {newline}
    || '    Args:' || {newline} || '        a: ' || p_type || {newline} || '    ' || {quote}
  when 1 then 'class C' || name || '( Base ,Other):' || {newline} || '    ' || {quote} || p_name || {quote}
    || {newline} || '    async def run(self, *args):' || {newline} || '        return 1'
    || {newline} || '    def _hidden(self): pass'
  when 2 then 'def _' || name || '(): pass' || {newline} || 'x_' || name || ' = 1'
  else 'class D' || name || ':' || {newline} || '    pass' end as block
from objects"""


def _py_modules(spark_dialect: bool) -> str:
    return f"""select module, chr(34) || chr(34) || chr(34) || 'Module ' || cast(cast(module as int) as varchar(20))
  || '.' || chr(34) || chr(34) || chr(34) || chr(10)
  || {text_of('block', 'line_no', spark_dialect)} as code
from blocks group by module"""


def py_pages(spark, folder) -> DataFrame:
    sql = (
        f"with objects as ({PY_OBJECTS}), blocks as ({_py_blocks(True)}) {_py_modules(True)}"
    )
    modules = derived(spark, folder, for_spark(sql, "part"), "part")
    path = F.concat(F.lit("pkg/m"), F.col("module").cast("int").cast("string"), F.lit(".py"))
    files = as_files(
        modules, path, F.col("code"), "lib", "https://lib.example.com/",
        "https://git.example.com/lib/blob/main/", prefix_source_path=True,
    )
    return good_pages(parse_files(files))


@query(
    "python_api_docs",
    f"""with objects as ({PY_OBJECTS}),
    shown as (
      select module, line_no, case kind
        when 0 then '## ' || name || chr(10) || chr(10) || 'def ' || name || '(a, b: int='
          || cast(p_size as varchar) || ') -> str' || chr(10) || chr(10) || 'Make ' || p_name || '.'
          || chr(10) || chr(10) || 'Args:' || chr(10) || '    a: ' || p_type
        when 1 then '## C' || name || chr(10) || chr(10) || 'class C' || name || '(Base, Other)'
          || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '### C' || name || '.run'
          || chr(10) || chr(10) || 'async def run(self, *args)'
        when 3 then '## D' || name || chr(10) || chr(10) || 'class D' || name end as section
      from objects
    )
    select 'lib:pkg/m' || cast(cast(module as int) as varchar) || '.py' as source_path,
           'pkg.m' || cast(cast(module as int) as varchar) as title,
           'https://git.example.com/lib/blob/main/pkg/m' || cast(cast(module as int) as varchar) || '.py' as url,
           '# pkg.m' || cast(cast(module as int) as varchar) || chr(10) || chr(10)
             || 'Module ' || cast(cast(module as int) as varchar) || '.' || chr(10) || chr(10)
             || string_agg(section, chr(10) || chr(10) order by line_no) as text
    from shown group by module""",
)
def python_api_docs(spark, folder):
    return py_pages(spark, folder).select("source_path", "title", "url", "text")


_PY_RECORD = "'pkg/m' || cast(cast(module as int) as varchar) || '.py' as file, 'pkg.m' || cast(cast(module as int) as varchar)"


@query(
    "py_records",
    f"""with objects as ({PY_OBJECTS}),
    found as (
      select module, 'function' as kind, name as raw, name, '' as class_name,
        'def ' || name || '(a, b: int=' || cast(p_size as varchar) || ') -> str' as signature,
        'Make ' || p_name || '.' || chr(10) || chr(10) || 'Args:' || chr(10) || '    a: ' || p_type as docstring
      from objects where kind = 0
      union all select module, 'class', 'C' || name, 'C' || name, '', '', p_name from objects where kind = 1
      union all select module, 'function', 'C' || name || '.run', 'run', 'C' || name, 'async def run(self, *args)', ''
      from objects where kind = 1
      union all select module, 'function', 'C' || name || '._hidden', '_hidden', 'C' || name, 'def _hidden(self)', ''
      from objects where kind = 1
      union all select module, 'function', '_' || name, '_' || name, '', 'def _' || name || '()', ''
      from objects where kind = 2
      union all select module, 'class', 'D' || name, 'D' || name, '', '', '' from objects where kind = 3
    )
    select {_PY_RECORD} as namespace, 'pkg.m' || cast(cast(module as int) as varchar) || '.' || raw as qualified_name,
      'python' as language, kind, name, class_name, signature, docstring
    from found""",
)
def py_records(spark, folder):
    """Records of Python modules, by the analyzer that the registry names for them."""
    sql = f"with objects as ({PY_OBJECTS}), blocks as ({_py_blocks(True)}) {_py_modules(True)}"
    modules = derived(spark, folder, for_spark(sql, "part"), "part")
    path = F.concat(F.lit("pkg/m"), F.col("module").cast("int").cast("string"), F.lit(".py"))
    files = modules.select(path.alias("rel_path"), F.lit("python").alias("language"), F.col("code").alias("text"))
    return analyze_files(files, analyzers={"python": ANALYZERS["python"]}).select(
        "file", "namespace", "qualified_name", "language", "kind", "name", "class_name", "signature", "docstring"
    )
