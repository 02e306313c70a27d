"""File trees: filters, order, URLs and site indexes over derived paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from checks import derived, for_spark, query, text_of
from marlstone.functions import paths
from marlstone.sources.files import (
    CODE_FOLDERS, CPP_SUFFIXES, DOC_SUFFIXES, is_included, language,
)
from marlstone.sources.web import index_urls, mirror_path

PATHS = """
select p_partkey, p_brand, p_size,
  case p_partkey % 9 when 0 then 'docs/' when 1 then '' when 2 then 'docs/a-b/' when 3 then '.github/x/'
    when 4 then 'src/node_modules/' when 5 then 'docs/a/' when 6 then 'docs/build/'
    when 7 then '_gen/' else 'cmake-build-debug/' end
  || replace(p_name, ' ', case when p_size % 2 = 0 then '/' else '_' end)
  || '_' || cast(p_partkey as varchar(20))
  || case p_size % 9 when 0 then '.md' when 1 then '.MDX' when 2 then '.rst' when 3 then '/index.mdx'
    when 4 then '.html' when 5 then '.py' when 6 then '.cpp' when 7 then '.tar.H' else '' end as path
from part
"""


def path_table(spark, folder) -> DataFrame:
    return derived(spark, folder, for_spark(PATHS, "part"), "part")


_SUFFIX = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"
_FOLDERS = "list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)"


@query(
    "path_parts",
    f"""with t as ({PATHS})
    select path, {_SUFFIX} as suffix, string_split(path, '/')[-1] as file_name,
           regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]+$', '\\1') as stem,
           case when path like '%/%' then string_split(path, '/')[-2] else '' end as parent
    from t""",
)
def path_parts(spark, folder):
    path = F.col("path")
    return path_table(spark, folder).select(
        path,
        paths.suffix(path).alias("suffix"),
        paths.basename(path).alias("file_name"),
        paths.stem(path).alias("stem"),
        paths.parent_name(path).alias("parent"),
    )


@query(
    "file_filter",
    f"""with t as ({PATHS})
    select path from t
    where {_SUFFIX} in ('.html', '.md', '.mdx', '.rst') and string_split(path, '/')[1] in ('docs', 'src')
      and len(list_filter({_FOLDERS}, lambda d: starts_with(d, '.') or d in
        ('.git', '.gitbook', '.next', '.venv', 'assets', 'node_modules', 'vendor'))) = 0""",
)
def file_filter(spark, folder):
    path = F.col("path")
    kept = paths.suffix(path).isin(*DOC_SUFFIXES) & is_included(path, ("docs", "src"))
    return path_table(spark, folder).where(kept).select("path")


@query(
    "code_file_filter",
    f"""with t as ({PATHS})
    select path, 'cpp' as language from t
    where {_SUFFIX} in ('.c', '.cc', '.cpp', '.cxx', '.h', '.hh', '.hpp', '.hxx')
      and len(list_filter({_FOLDERS}, lambda d: d in ('.git', '.cache', '.rag', '__pycache__', 'build',
          'node_modules', 'vendor', 'third_party')
        or starts_with(d, 'cmake-build-') or starts_with(d, 'bazel-'))) = 0""",
)
def code_file_filter(spark, folder):
    path = F.col("path")
    kept = paths.suffix(path).isin(*CPP_SUFFIXES) & ~CODE_FOLDERS.skipped(path)
    return path_table(spark, folder).where(kept).select("path", language(path).alias("language"))


@query(
    "glob_filter",
    f"""with t as ({PATHS})
    select path from t
    where regexp_full_match(path, 'docs/.*\\.md') or regexp_full_match(path, '_gen/[^s].*')
       or regexp_full_match(string_split(path, '/')[-1], '[a-m].*_..9\\..*')
       or regexp_full_match(path, '[a-m].*_..9\\..*')""",
)
def glob_filter(spark, folder):
    path = F.col("path")
    hit = paths.matches_any_glob(path, ("docs/*.md", "_gen/[!s]*", "[a-m]*_??9.*"))
    return path_table(spark, folder).where(hit).select("path")


@query(
    "path_sort",
    f"""with t as ({PATHS})
    select floor(p_partkey / 40) as folder, path,
           cast(row_number() over (partition by floor(p_partkey / 40) order by string_split(path, '/')) as int)
             as position
    from t""",
)
def path_sort(spark, folder):
    """Order by path components, within groups of forty paths."""
    groups = path_table(spark, folder).withColumn("folder", F.floor(F.col("p_partkey") / 40).cast("double"))
    order = Window.partitionBy("folder").orderBy(paths.parts(F.col("path")))
    return groups.select("folder", "path", F.row_number().over(order).alias("position"))


_BLOB = "'https://git.example.com/x/blob/main/'"
_SITE = "'https://docs.example.com/en/'"
_BASE = f"case when p_size % 3 = 0 then {_BLOB} else {_SITE} end"


def _base() -> Column:
    return F.when(F.col("p_size") % 3 == 0, "https://git.example.com/x/blob/main/").otherwise(
        "https://docs.example.com/en/"
    )


@query(
    "docs_url",
    f"""with t as ({PATHS})
    select path, 'https://docs.example.com/en/' || trim(regexp_replace(regexp_replace(
      regexp_replace(path, '^docs/', ''), '\\.mdx?$', ''), '/index$', ''), '/') as url
    from t""",
)
def docs_url(spark, folder):
    base = F.lit("https://docs.example.com/en/")
    return path_table(spark, folder).select("path", paths.docs_url(F.col("path"), base).alias("url"))


@query(
    "source_url",
    f"""with t as ({PATHS})
    select path, rtrim({_BASE}, '/') || '/' || case when p_size % 3 = 0 then trim(path, '/') else
      trim(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(path, '^docs/', ''), '\\.mdx?$', ''), '\\.rst$', '.html'), '/index$', ''), '/') end as url
    from t""",
)
def source_url(spark, folder):
    return path_table(spark, folder).select(
        "path", paths.source_url(F.col("path"), _base()).alias("url")
    )


@query(
    "source_path",
    f"""with t as ({PATHS})
    select path, case when p_size % 2 = 0 then p_brand || ':' || path else path end as source_path,
           replace(regexp_replace(path, '\\.py$', ''), '/', '.') as module
    from t""",
)
def source_path(spark, folder):
    path = F.col("path")
    return path_table(spark, folder).select(
        path,
        paths.source_path(F.col("p_brand"), path, F.col("p_size") % 2 == 0).alias("source_path"),
        paths.module_name(path).alias("module"),
    )


LINKS = """
select floor(page_id / 25) as site, page_id,
  '- [page ' || cast(page_id as varchar(20)) || '](' || case page_id % 5
    when 0 then 'https://docs.example.com/guide/p' || cast(page_id % 10 as varchar(20)) || '.md'
    when 1 then 'https://docs.example.com.other.test/x.md'
    when 2 then 'https://docs.example.com/plain/' || cast(page_id as varchar(20))
    when 3 then url || '.md'
    else 'https://docs.example.com//deep/q' || cast(page_id as varchar(20)) || '.md' end
  || '): about ' || url as line
from pages
"""


def _indexes(spark_dialect: bool) -> str:
    return f"select site, {text_of('line', 'page_id', spark_dialect)} as index_text from links group by site"


@query(
    "llms_index_urls",
    f"""with links as ({LINKS}), indexes as ({_indexes(False)}),
    found as (
      select site, unnest(f) as url, generate_subscripts(f, 1) as pos
      from (select site, regexp_extract_all(index_text, '\\((https?://[^\\s)]+\\.md)\\)', 1) as f from indexes)
    ),
    first_seen as (
      select site, url, min(pos) as pos from found
      where starts_with(url, 'https://docs.example.com/') group by site, url
    )
    select cast(site as bigint) as site, url,
           cast(row_number() over (partition by site order by pos) - 1 as int) as position,
           ltrim(substr(url, length('https://docs.example.com') + 1), '/') as mirror_path
    from first_seen""",
)
def llms_index_urls(spark, folder):
    sql = f"with links as ({LINKS}) {_indexes(True)}"
    indexes = derived(spark, folder, for_spark(sql, "pages"), "pages")
    base = F.lit("https://docs.example.com/")
    return indexes.select(
        F.col("site").cast("bigint").alias("site"),
        F.posexplode(index_urls(F.col("index_text"), base)).alias("position", "url"),
    ).withColumn("mirror_path", mirror_path(F.col("url"), base))
