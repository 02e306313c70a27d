"""Text and path expressions against Python's own string methods."""

import fnmatch
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import checks
from marlstone.functions.embedding import word_parts
from marlstone.functions import paths
from marlstone.functions import text as tx

ODD = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def samples(seed, alphabet, count=400, longest=24):
    rng = random.Random(seed)
    return ["", *("".join(rng.choices(alphabet, k=rng.randrange(longest))) for _ in range(count))]


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in frame.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_white_space_rules(spark):
    texts = samples(1, "ab#é" + ODD)
    assert column(spark, texts, tx.strip) == [t.strip() for t in texts]
    assert column(spark, texts, tx.rstrip) == [t.rstrip() for t in texts]
    assert column(spark, texts, tx.words) == [t.split() for t in texts]
    assert column(spark, texts, tx.squeeze) == [" ".join(t.split()) for t in texts]
    assert column(spark, texts, tx.lines) == [t.splitlines() for t in texts]


def test_zero_width_and_other_near_spaces_are_not_white_space(spark):
    texts = ["a\u200bb", "\ufeffx", "\u180ey", "z\u2060"]
    assert column(spark, texts, tx.words) == [[t] for t in texts]


def test_clean_heading(spark):
    texts = ["  ## A   b ##  ", "#", "x # y", "##  #  z#", "\x1fq\x85"]
    expected = ["A b", "", "x # y", "# z", "q"]
    assert column(spark, texts, tx.clean_heading) == expected


def test_contains_word_uses_unicode_boundaries(spark):
    texts = samples(2, "ab_~éя½ .", count=300, longest=14)
    for word in ("a", "b_", "~a", "é", "a.b", r"a\E", "~", "я"):
        found = column(spark, texts, lambda t: tx.contains_word(t, F.lit(word)))
        # ½ is a word character for Python, a combining mark is not.
        assert found == [bool(re.search(rf"\b{re.escape(word)}\b", t)) for t in texts], word


def test_path_parts(spark):
    names = samples(3, "ab._-", count=200, longest=7)
    files = [f"d/e.f/{n}" for n in names if n.strip(".") and "/" not in n] + ["top.MD", ".md", "a/.md"]
    pure = [pathlib.PurePosixPath(f) for f in files]
    assert column(spark, files, paths.suffix) == [p.suffix.lower() for p in pure]
    assert column(spark, files, paths.stem) == [p.stem for p in pure]
    assert column(spark, files, paths.basename) == [p.name for p in pure]
    assert column(spark, files, paths.parent_name) == [p.parent.name for p in pure]


def test_path_order_is_by_component(spark):
    files = ["a-b/x", "a/x", "a/b/c", "A/z", "a.b", "é/q", "_u/v"]
    frame = spark.createDataFrame([(f,) for f in files], "f string")
    got = [r.f for r in frame.orderBy(paths.parts(F.col("f"))).collect()]
    assert got == [str(p) for p in sorted(map(pathlib.PurePosixPath, files))]


def test_globs(spark):
    files = ["src/a.cpp", "src/d/B.cpp", "B.cpp", "src/a.cpp\n", "x/src/a.h", "a[1].h", "q.H"]
    for pattern in ("src/*.cpp", "**/B.cpp", "?.cpp", "*.[hH]", "a[[]1].h", "[!a]*.h", "B.cpp", "*"):
        expected = [
            fnmatch.fnmatchcase(f, pattern) or fnmatch.fnmatchcase(f.rsplit("/", 1)[-1], pattern)
            for f in files
        ]
        assert column(spark, files, lambda f: paths.matches_any_glob(f, [pattern])) == expected, pattern


def test_urls(spark):
    base = F.lit("https://docs.example.com/en/")
    blob = F.lit("https://git.example.com/x/blob/main/")
    cases = {
        "docs/ref/pay.md": ("ref/pay", "ref/pay", "docs/ref/pay.md"),
        "docs/a/index.mdx": ("a", "a", "docs/a/index.mdx"),
        # The pattern needs a slash before "index".
        "docs/index.md": ("index", "index", "docs/index.md"),
        "source/api.rst": ("source/api.rst", "source/api.html", "source/api.rst"),
        "docs/x/index.rst": ("x/index.rst", "x/index.html", "docs/x/index.rst"),
        "classes/Client.html": ("classes/Client.html",) * 3,
    }
    files = list(cases)
    prefix, link = "https://docs.example.com/en/", "https://git.example.com/x/blob/main/"
    assert column(spark, files, lambda p: paths.docs_url(p, base)) == [prefix + cases[f][0] for f in files]
    assert column(spark, files, lambda p: paths.source_url(p, base)) == [prefix + cases[f][1] for f in files]
    assert column(spark, files, lambda p: paths.source_url(p, blob)) == [link + cases[f][2] for f in files]


@pytest.mark.parametrize("name, table", [("html_headings", "pages"), ("embed_hash", "documents")])
def test_texts_go_to_python_in_small_batches(spark, tmp_path, name, table):
    pages = "page_id long, url string, html string"
    documents = "doc_id long, text string, lang string, source string"
    rows = {"pages": [(1, "u", "<h1>a</h1>b")], "documents": [(1, "reed pond", "en", "web")]}[table]
    frame = spark.createDataFrame(rows, pages if table == "pages" else documents)
    frame.write.parquet(f"{tmp_path}/{table}.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        assert checks.QUERIES[name](spark, str(tmp_path)).count() > 0
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)


def test_words_are_counted_in_parts():
    assert word_parts(np.array([3, 0, 5, 9, 1, 1]), 5) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert word_parts(np.array([0, 0]), 5) == [(0, 2)]
    assert word_parts(np.array([], np.int64), 5) == []


def test_a_value_that_arrow_cannot_hold_spoils_no_other():
    kind = pa.struct([("x", pa.string()), ("error", pa.string())])
    values = pa.array([str(i) for i in range(150)] + [None])
    bad = {"70": {"x": "\ud800"}, "90": {"x": 5}}

    def read(value):
        if value == "149":
            raise ValueError("no")
        return bad.get(value, {"x": value})

    rows = tx.read_each(read, values, kind, "T").to_pylist()
    assert len(rows) == 151 and rows[150] is None
    assert rows[149] == {"x": None, "error": "T: no"}
    assert {i for i, r in enumerate(rows) if r and r["error"]} == {70, 90, 149}
    assert all(r["x"] == str(i) for i, r in enumerate(rows) if r and not r["error"])
