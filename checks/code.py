"""C++ records, their text fields, call graph and related tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import ORACLES, derived, for_spark, query, text_of
from marlstone.functions import code as cx
from marlstone.functions import text as tx
from marlstone.operators import code_text, cpp, relate
from marlstone.session import shared_dir
from marlstone.sinks.code_map import write_markdown

# -- analyzer ------------------------------------------------------------------

# Twenty parts make a file. Every part is a documented function of seven lines and an empty one;
# the file starts with ten lines and ends with one. chr(123) and chr(125) are
# the braces, which the named table parameters of spark.sql claim for themselves.
BLOCKS = """
select floor(p_partkey / 20) as grp, p_partkey, p_name, p_size, p_brand,
  '// Makes ' || p_name || '.' || chr(10)
  || 'int Brand_' || substr(p_brand, 7) || '::make_' || cast(p_partkey as varchar(20)) || '(int a,' || chr(10)
  || '    int b)' || chr(10)
  || chr(123) || chr(10)
  || '    if (a) ' || chr(123) || ' call_' || cast(p_size as varchar(20)) || '("x(1)", '
    || chr(39) || '(' || chr(39) || '); ' || chr(125) || ' // skip(2)' || chr(10)
  || '    return /* old( */ make_' || cast(p_partkey + 1 as varchar(20)) || '(a);' || chr(10)
  || chr(125) || chr(10) as block
from part
"""


def _files(spark_dialect: bool) -> str:
    name = "cast(cast(grp as int) as varchar(20))"
    return f"""
select grp, 'src/f' || {name} || '.cpp' as rel_path,
  '#include <memory>' || chr(10) || '  #include  "pond/f' || {name} || '.h"' || chr(10) || chr(10)
  || 'namespace pond ' || chr(123) || chr(10) || 'namespace g' || {name} || ' ' || chr(123) || chr(10)
  || 'class F' || {name} || ' ' || chr(123) || chr(10) || 'public:' || chr(10) || '    void sway();' || chr(10)
  || chr(125) || ';' || chr(10) || chr(10) || {text_of('block', 'p_partkey', spark_dialect)}
  || chr(125) || chr(125) || ' // pond' || chr(10) as text
from blocks group by grp"""


FILES = f"blocks as ({BLOCKS}), files as ({_files(False)})"


def cpp_files(spark, folder) -> DataFrame:
    sql = f"with blocks as ({BLOCKS}) {_files(True)}"
    files = derived(spark, folder, for_spark(sql, "part"), "part", dealt=True)
    return files.select("rel_path", "text")


def cpp_records(spark, folder) -> DataFrame:
    return cpp.analyze(cpp_files(spark, folder))


_MAKE = "'make_' || cast(p_partkey as varchar)"
_CLASS = "'Brand_' || substr(p_brand, 7)"
_LIST = "array_to_string({}, ', ')"
EXPECTED = f"""{FILES},
placed as (
  select *, cast(cast(grp as int) as varchar) as g,
    11 + 8 * (row_number() over (partition by grp order by p_partkey) - 1) as doc_line
  from blocks
),
expected as (
  select 'src/f' || g || '.cpp' as file, 'function' as kind, {_MAKE} as name,
    'pond::g' || g || '::' || {_CLASS} || '::' || {_MAKE} as qualified_name,
    {_CLASS} as class_name, 'pond::g' || g as namespace,
    cast(doc_line + 1 as int) as line_start, cast(doc_line + 6 as int) as line_end,
    'int ' || {_CLASS} || '::' || {_MAKE} || '(int a, int b)' as signature,
    'Makes ' || p_name || '.' as docstring, 'memory, pond/f' || g || '.h' as imports,
    'call_' || cast(p_size as varchar) || ', make_' || cast(p_partkey + 1 as varchar) as calls,
    rtrim(substr(block, position(chr(10) in block) + 1), chr(10)) as code
  from placed
  union all
  select 'src/f' || g || '.cpp', 'class', 'F' || g, 'pond::g' || g || '::F' || g, '', 'pond::g' || g,
    6, 9, '', '', 'memory, pond/f' || g || '.h', '',
    'class F' || g || ' {{' || chr(10) || 'public:' || chr(10) || '    void sway();' || chr(10) || '}};'
  from (select distinct g from placed)
)""".replace("{{", "{").replace("}}", "}")


@query(
    "cpp_records",
    f"""with {EXPECTED}
    select *, sha256(file || chr(0) || kind || chr(0) || qualified_name || chr(0)
      || cast(line_start as varchar) || chr(0) || code) as record_id, 'cpp' as language
    from expected""",
)
def cpp_records_(spark, folder):
    joined = lambda c: F.array_join(c, ", ").alias(c)
    records = cpp_records(spark, folder)
    plain = [c for c in records.columns if c not in ("imports", "calls")]
    return records.select(*plain, joined("imports"), joined("calls"))


def _without_comments(text: str) -> str:
    for pattern, by in (
        ("//[^\n]*", "''"), ("(?s)/\\*.*?\\*/", "''"),
        ('"(?:\\\\.|[^"\\\\])*"', "chr(34) || chr(34)"),
        ("''(?:\\\\.|[^''\\\\])*''", "chr(39) || chr(39)"),
    ):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


@query("cpp_strip", f"with {FILES} select rel_path, {_without_comments('text')} as bare from files")
def cpp_strip(spark, folder):
    return cpp_files(spark, folder).select(
        "rel_path", cx.strip_comments_and_strings(F.col("text")).alias("bare")
    )


@query(
    "cpp_calls",
    f"""with {FILES},
    called as (
      select rel_path, regexp_extract_all({_without_comments('text')}, '\\b([A-Za-z_]\\w*)\\s*\\(', 1) as c from files),
    each as (select rel_path, unnest(c) as name, generate_subscripts(c, 1) as pos from called),
    firsts as (
      select rel_path, name, min(pos) as pos from each
      where name not in ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'static_cast', 'dynamic_cast',
        'reinterpret_cast', 'const_cast', 'catch', 'sway')
      group by all)
    select rel_path, name,
           cast(row_number() over (partition by rel_path order by pos) - 1 as int) as position
    from firsts""",
)
def cpp_calls(spark, folder):
    found = cx.calls(F.col("text"), F.lit("sway"))
    return cpp_files(spark, folder).select("rel_path", F.posexplode(found).alias("position", "name"))


@query(
    "cpp_imports",
    f"""with {FILES}
    select rel_path, array_to_string(
      regexp_extract_all(text, '(?m)^[ \t]*#include[ \t]+[<"]([^>"\n]+)[>"]', 1), ', ') as imports
    from files""".replace("\\t", "\t").replace("\\n", "\n"),
)
def cpp_imports(spark, folder):
    return cpp_files(spark, folder).select(
        "rel_path", F.array_join(cx.imports(tx.lines(F.col("text"))), ", ").alias("imports")
    )


@query(
    "cpp_truncate",
    f"""with {FILES}
    select rel_path, case when length(text) <= 1500 then text
      else rtrim(substr(text, 1, 1489), ' ' || chr(10)) || '[truncated]' end as code
    from files""",
)
def cpp_truncate(spark, folder):
    return cpp_files(spark, folder).select("rel_path", cx.truncate(F.col("text"), 1500).alias("code"))


SIGNATURES = """
select p_partkey, case p_partkey % 8
    when 0 then 'void ' || p_brand || '(int a)'
    when 1 then 'const T* &' || replace(p_name, ' ', '::') || '_' || cast(p_partkey as varchar(20)) || ' (x) const'
    when 2 then 'std::' || replace(p_name, ' ', '_') || ' *Outer::' || p_type || '::~' || p_type || '()'
    when 3 then 'if (' || p_type || ')'
    when 4 then 'bool operator==(const ' || p_type || '& o)'
    when 5 then 'void operator()(' || p_type || ' o)'
    when 6 then p_type || ' = 3'
    else 'auto x = new ' || p_type || '(1)' end as signature
from part
"""


@query(
    "cpp_names",
    f"""with s as (
      select *, trim(regexp_extract(trim(split_part(signature, '(', 1)), '\\S+$'), '*&') as raw
      from ({SIGNATURES}))
    select p_partkey, raw as raw_name,
      case when raw like '%::%' then string_split(raw, '::')[-2] else '' end as class_name,
      case when p_partkey % 2 = 0 then 'ns::' || raw else raw end as qualified_name,
      signature like '%(%' and signature like '%)%'
        and raw not in ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'static_cast', 'dynamic_cast',
          'reinterpret_cast', 'const_cast', 'catch', 'class', 'struct', 'enum', 'namespace')
        and regexp_full_match(raw, '~?[A-Za-z_]\\w*(::[~A-Za-z_]\\w*)*') as is_function
    from s""",
)
def cpp_names(spark, folder):
    table = derived(spark, folder, for_spark(SIGNATURES, "part"), "part")
    raw = cx.raw_function_name(F.col("signature"))
    space = F.when(F.col("p_partkey") % 2 == 0, "ns").otherwise("")
    return table.select(
        "p_partkey",
        raw.alias("raw_name"),
        cx.class_of(raw).alias("class_name"),
        cx.qualify(space, raw).alias("qualified_name"),
        cx.looks_like_function(F.col("signature")).alias("is_function"),
    )


# -- relationships -------------------------------------------------------------

# Every part is a function. Forty neighbours share a name suffix, so some names
# are ambiguous. A part calls the next part of each order it is in. Classes,
# files and tests belong to blocks of 200 parts and 10 suppliers, so that links
# grow as the tables do.
PARTS = """
select p_partkey, 'function' as kind,
  case when p_size % 10 = 1 then 's' || cast(p_size as varchar(20)) || 'b' || cast(cast(floor(p_partkey / 200) as int) as varchar(20))
       else replace(p_name, ' ', '_') || '_' || cast(cast(floor(p_partkey / 40) as int) as varchar(20)) end as name,
  'Brand_' || substr(p_brand, 7) || 'b' || cast(cast(floor(p_partkey / 200) as int) as varchar(20)) as class_name,
  'src/' || case when p_size % 3 = 0 then 'brand' else p_type end || '/'
    || case when p_size % 2 = 0 then 's' else 'unit' end || cast(p_size as varchar(20)) || 'b' || cast(cast(floor(p_partkey / 200) as int) as varchar(20)) || '.cpp' as file
from part
"""
NEXT = """
select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as next_partkey
from lineitem
"""
RECORDS = f"""base as ({PARTS}), nexts as ({NEXT}),
calls as (
  select distinct n.l_partkey as p_partkey, c.name as call
  from nexts n join base c on c.p_partkey = n.next_partkey
)"""
RECORDS_SQL = f"""{RECORDS},
records as (select *, class_name || '::' || name || '@' || cast(p_partkey % 3 as varchar) as qualified_name from base)"""


def part_records(spark, folder) -> DataFrame:
    names = ("part", "lineitem")
    base = derived(spark, folder, for_spark(PARTS, *names), *names)
    nexts = derived(spark, folder, for_spark(NEXT, *names), *names)
    callee = base.select(F.col("p_partkey").alias("next_partkey"), F.col("name").alias("call"))
    pairs = relate.shuffled_join(nexts, callee, "next_partkey").select(
        F.col("l_partkey").alias("p_partkey"), "call"
    )
    # A function's calls, each once: no longer than its own body.
    calls = pairs.groupBy("p_partkey").agg(F.array_sort(F.collect_set("call")).alias("calls"))
    qualified = F.concat(
        "class_name", F.lit("::"), "name", F.lit("@"), (F.col("p_partkey") % 3).cast("string")
    )
    none = F.array().cast("array<string>")
    return relate.shuffled_join(base, calls, "p_partkey", "left").select(
        F.sha2(F.concat_ws("\0", "file", "name", F.col("p_partkey").cast("string")), 256).alias("record_id"),
        "kind",
        F.lit("cpp").alias("language"),
        "name",
        qualified.alias("qualified_name"),
        "file",
        F.col("p_partkey").cast("int").alias("line_start"),
        (F.col("p_partkey") + 5).cast("int").alias("line_end"),
        "class_name",
        F.lit("pond").alias("namespace"),
        F.concat(F.lit("int "), F.col("name"), F.lit("()")).alias("signature"),
        F.lit("").alias("docstring"),
        F.array(F.lit("memory")).alias("imports"),
        F.concat(F.lit("int "), F.col("name"), F.lit("() {}\n")).alias("code"),
        F.coalesce("calls", none).alias("calls"),
    )


SYMBOLS = f"""{RECORDS_SQL},
symbols as (
  select qualified_name as symbol, qualified_name from records
  union select name, qualified_name from records
  union select class_name || '::' || name, qualified_name from records where class_name <> ''
)"""


@query(
    "symbol_index",
    f"""with {SYMBOLS}
    select symbol, string_agg(qualified_name, ',' order by qualified_name) as qualified_names
    from symbols group by symbol""",
)
def symbol_index(spark, folder):
    index = relate.symbol_index(part_records(spark, folder))
    return index.select("symbol", F.array_join("qualified_names", ",").alias("qualified_names"))


@query(
    "ambiguous_calls",
    f"""with {SYMBOLS}
    select call as symbol, count(*) as calls from calls
    where call in (select symbol from symbols group by symbol having count(*) > 1) group by call""",
)
def ambiguous_calls(spark, folder):
    """Calls that resolve to nothing because their symbol is shared."""
    records = part_records(spark, folder)
    called = records.select(F.explode("calls").alias("symbol"))
    known = relate.symbols(records).select("symbol").distinct()
    return (
        called.join(known, "symbol", "left_semi")
        .join(relate.unique_symbols(records), "symbol", "left_anti")
        .groupBy("symbol")
        .agg(F.count("*").alias("calls"))
    )


EDGES = f"""{SYMBOLS},
resolved as (select symbol, min(qualified_name) as callee from symbols group by symbol having count(*) = 1),
resolved_calls as materialized (select p_partkey, callee from calls join resolved on call = symbol),
edges as (
  select distinct qualified_name as caller, callee
  from resolved_calls join records using (p_partkey)
  where qualified_name <> callee
),
called_by as (
  select callee as qualified_name, string_agg(caller, ',' order by caller) as called_by
  from edges group by callee
)"""


@query("call_edges", f"with {EDGES} select caller, callee from edges")
def call_edges(spark, folder):
    return relate.call_edges(part_records(spark, folder))


@query("called_by", f"with {EDGES} select * from called_by")
def called_by(spark, folder):
    found = relate.called_by(part_records(spark, folder))
    return found.select("qualified_name", F.array_join("called_by", ",").alias("called_by"))


# Every supplier is a test that calls the parts it supplies.
TEST_LINES = """
select s_suppkey, l_partkey, 'src/' || case s_suppkey % 4 when 0 then 'test' when 1 then 'brand/tests'
    when 2 then 'economy/unit' else 'deep/UNIT_TESTS' end || '/S' || cast(s_nationkey as varchar(20)) || 'b' || cast(cast(floor(s_suppkey / 10) as int) as varchar(20))
  || '_Brand_' || cast(s_suppkey % 25 as varchar(20)) || 'b' || cast(cast(floor(s_suppkey / 10) as int) as varchar(20)) || '_test' || cast(s_suppkey as varchar(20)) || '.cpp' as test
from supplier left join (select distinct l_suppkey, l_partkey from lineitem) on s_suppkey = l_suppkey
"""
TESTS_SQL = f"""lines as ({TEST_LINES}),
tests as (
  select test, 'void check() {{ ' || coalesce(string_agg(name || '(); ', '' order by l_partkey), '') || '}}' as text
  from lines left join records on p_partkey = l_partkey group by test
)""".replace("{{", "{").replace("}}", "}")
PAIRS = f"""{RECORDS_SQL}, {TESTS_SQL},
pairs as (
  select distinct qualified_name, test
  from records, tests, lateral (select
    lower(string_split(test, '/')[-1]) as file_name, lower(test) as path,
    lower(regexp_extract(file, '([^/]+)\\.cpp$', 1)) as stem, lower(string_split(file, '/')[-2]) as parent)
  where contains(text, ' ' || name || '(') or regexp_matches(text, '\\b' || class_name || '\\b')
     or contains(file_name, lower(class_name)) or contains(file_name, stem)
     or (contains(path, parent) and contains(file_name, lower(name)))
)"""


def supplier_tests(spark, folder) -> DataFrame:
    """(rel_path, text) of the test files."""
    names = ("supplier", "lineitem", "part")
    lines = derived(spark, folder, for_spark(TEST_LINES, *names), *names)
    base = derived(spark, folder, for_spark(PARTS, *names), *names)
    named = base.select(F.col("p_partkey").alias("l_partkey"), "name")
    called = relate.shuffled_join(lines, named, "l_partkey", "left")
    call = F.concat("name", F.lit("(); "))
    # A test file is one row of text in the end, so its lines fit a group.
    body = F.array_sort(F.collect_list(F.struct("l_partkey", call.alias("call"))))
    text = F.array_join(F.transform(body, lambda c: c["call"]), "")
    return called.groupBy(F.col("test").alias("rel_path")).agg(
        F.concat(F.lit("void check() { "), text, F.lit("}")).alias("text")
    )


@query(
    "related_tests",
    f"""with {PAIRS}
    select qualified_name, count(*) as n, md5(string_agg(test, ',' order by test)) as tests
    from pairs group by qualified_name""",
)
def related_tests(spark, folder):
    tests = supplier_tests(spark, folder).withColumnRenamed("rel_path", "test")
    found = relate.related_tests(part_records(spark, folder), tests)
    return found.select(
        "qualified_name",
        F.size("related_tests").cast("bigint").alias("n"),
        F.md5(F.array_join("related_tests", ",").cast("binary")).alias("tests"),
    )


@query("related_pairs", f"with {PAIRS} select qualified_name, test from pairs")
def related_pairs(spark, folder):
    tests = supplier_tests(spark, folder).withColumnRenamed("rel_path", "test")
    return relate.related_pairs(part_records(spark, folder), tests)


@query(
    "test_files",
    f"""with t as (
      select test as path from ({TEST_LINES}) union select file from ({PARTS}))
    select path from t
    where len(list_filter(string_split(lower(path), '/'), lambda d: d in ('test', 'tests', 'unittest', 'unit_tests'))) > 0
       or contains(lower(string_split(path, '/')[-1]), 'test')""",
)
def test_files(spark, folder):
    tests = supplier_tests(spark, folder).select(F.col("rel_path").alias("path"))
    sources = part_records(spark, folder).select(F.col("file").alias("path"))
    return tests.union(sources).distinct().where(relate.is_test_file(F.col("path")))


RELATED = f"""{PAIRS},
related as (
  select qualified_name, list(test order by test) as related_tests from pairs group by qualified_name
),
{EDGES.removeprefix(RECORDS_SQL + ',')},
linked as (
  select p_partkey, name, r.qualified_name, class_name, file,
    coalesce((select list(call order by call) from calls c where c.p_partkey = r.p_partkey), []) as calls,
    coalesce(string_split(called_by, ','), []) as called_by, coalesce(related_tests, []) as related_tests
  from records r left join called_by using (qualified_name) left join related using (qualified_name)
)"""


def related_records(spark, folder) -> DataFrame:
    return relate.build_relationships(part_records(spark, folder), supplier_tests(spark, folder))


@query(
    "attach_relationships",
    f"""with {RELATED}
    select cast(p_partkey as int) as line_start, qualified_name, array_to_string(called_by, ',') as called_by,
           md5(array_to_string(related_tests, ',')) as tests
    from linked""",
)
def attach_relationships(spark, folder):
    return related_records(spark, folder).select(
        "line_start", "qualified_name", F.array_join("called_by", ",").alias("called_by"),
        F.md5(F.array_join("related_tests", ",").cast("binary")).alias("tests"),
    )


_PLACE = "file || ':' || cast(p_partkey as varchar)"
_SHOWN = "'Class: ' || class_name || chr(10) || 'Namespace: pond' || chr(10) || 'Signature: int ' || name || '()' || chr(10) || 'Docstring: ' || chr(10)"
EMBEDDING = f"""'Kind: function' || chr(10) || 'Name: ' || qualified_name || chr(10)
  || 'File: ' || {_PLACE} || '-' || cast(p_partkey + 5 as varchar) || chr(10) || {_SHOWN}
  || 'Imports: memory' || chr(10) || 'Calls: ' || array_to_string(calls, ', ') || chr(10)
  || 'Called by: ' || array_to_string(called_by, ', ') || chr(10)
  || 'Related tests: ' || array_to_string(related_tests, ', ') || chr(10) || chr(10)
  || 'Code:' || chr(10) || 'int ' || name || '() {{}}'""".replace("{{}}", "{}")


@query(
    "code_embedding_text",
    f"with {RELATED} select cast(p_partkey as int) as line_start, {EMBEDDING} as embedding_text from linked",
)
def code_embedding_text(spark, folder):
    return related_records(spark, folder).select(
        "line_start", code_text.embedding_text().alias("embedding_text")
    )


def _items(column: str) -> str:
    return f"case when len({column}) = 0 then '- None' else '- ' || array_to_string({column}, chr(10) || '- ') end"


@query(
    "code_markdown",
    f"""with {RELATED},
    sections as (
      select file, p_partkey, '## Function: ' || qualified_name || chr(10) || chr(10) || 'File: ' || {_PLACE}
        || chr(10) || {_SHOWN} || 'Imports:' || chr(10) || '- memory' || chr(10)
        || 'Calls:' || chr(10) || {_items('calls')} || chr(10)
        || 'Called by:' || chr(10) || {_items('called_by')} || chr(10)
        || 'Related Tests:' || chr(10) || {_items('related_tests')} || chr(10) || chr(10)
        || '```cpp' || chr(10) || 'int ' || name || '() {{}}' || chr(10) || chr(10) || '```' as section
      from linked
    )
    select file, sha256(string_agg(section, chr(10) || chr(10) order by p_partkey) || chr(10)) as content_hash
    from sections group by file""".replace("{{}}", "{}"),
)
def code_markdown(spark, folder):
    pages = code_text.markdown_pages(related_records(spark, folder))
    return pages.select("file", F.sha2("content", 256).alias("content_hash"))


@query("code_markdown_sink", ORACLES["code_markdown"])
def code_markdown_sink(spark, folder):
    """The same pages, written by the sink and read back from their files."""
    place = f"{shared_dir(spark)}/pages-{os.urandom(8).hex()}"
    write_markdown(related_records(spark, folder), place)
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(place)
    file = F.regexp_extract("path", rf"{os.path.basename(place)}/(.*)\.md$", 1)
    return stored.select(file.alias("file"), F.sha2("content", 256).alias("content_hash"))


@query(
    "code_json_fields",
    f"""with {RELATED}
    select cast(p_partkey as int) as line_start, class_name as class, 'function' as kind, name, qualified_name,
      file, cast(p_partkey + 5 as int) as line_end, md5(array_to_string(related_tests, ',')) as tests,
      array_to_string(calls, ',') as calls, array_to_string(called_by, ',') as called_by,
      sha256({EMBEDDING}) as text_hash
    from linked""",
)
def code_json_fields(spark, folder):
    """The JSON lines, read back field by field."""
    records = code_text.json_fields(related_records(spark, folder))
    lines = records.select(code_text.json_line().alias("line"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    joined = lambda c: F.array_join(f"r.{c}", ",")
    return lines.select(F.from_json("line", schema).alias("r")).select(
        "r.line_start", "r.class", "r.kind", "r.name", "r.qualified_name", "r.file", "r.line_end",
        F.md5(joined("related_tests").cast("binary")).alias("tests"),
        joined("calls").alias("calls"),
        joined("called_by").alias("called_by"),
        F.sha2("r.embedding_text", 256).alias("text_hash"),
    )
