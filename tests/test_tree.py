"""The tree data source: same listing by path and by URI, pages of flat folders, files that vanish."""

import os

import pytest
from pyspark.sql import functions as F

from marlstone.operators.parse import bad_files, good_pages, parse_files
from marlstone.sources import files, tree
from marlstone.sources.tables import as_files

NAMES = ["a.md", "_x/b.md", ".dot.md", "x/.git/c.md", "x/y/z/d.md", "build-1/e.md", "build-1/y/f.md", "x/G.MD"]


@pytest.fixture
def root(tmp_path):
    for name in NAMES:
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    return str(tmp_path)


def listed(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_listing(spark, root, scheme):
    every = sorted((n, len(f"# {n}\n")) for n in NAMES)
    assert listed(tree.read_tree(spark, scheme + root)) == every
    kept = tree.read_tree(spark, scheme + root, (".git",), ("build-",))
    assert listed(kept) == [r for r in every if ".git" not in r[0] and "build-" not in r[0]]
    contents = files.read_contents(kept, scheme + root, 2).collect()
    assert {r.rel_path: bytes(r.content) for r in contents} == {n: f"# {n}\n".encode() for n, _ in listed(kept)}


def test_planned_partitions(root, monkeypatch):
    monkeypatch.setattr(tree, "PAGE_FILES", 3)
    os.mkdir(f"{root}/flat")
    for i in range(10):
        open(f"{root}/flat/{i}.md", "w").close()
    reader = tree.TreeReader({"path": root, "partitions": "5", "skip": '[".git"]'})
    parts = reader.partitions()
    assert [p.folder for p in parts if not p.deep][:1] == [""] and len(parts) >= 5
    pages = [p for p in parts if p.folder == "flat"]
    assert len(pages) == 1 or {p.pages for p in pages} == {4}
    found = [n for p in parts for batch in reader.read(p) for n in batch.column(0).to_pylist()]
    assert len(found) == len(set(found)) == len(NAMES) - 1 + 10
    shares = [tree.Part("flat", False, i, 4) for i in range(4)]
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in shares]
    assert sum(sizes) == 10 and max(sizes) < 10


def test_a_vanished_file_is_a_bad_row(spark, root):
    listing = spark.createDataFrame([("a.md",), ("gone.md",), ("x/gone.html",)], "rel_path string")
    contents = files.read_contents(listing, root, 2)
    parsed = parse_files(as_files(contents, F.col("rel_path"), F.col("content"), "docs"))
    assert [r.title for r in good_pages(parsed).collect()] == ["a.md"]
    assert {r.error for r in bad_files(parsed).collect()} == {"could not be read"}
    assert bad_files(parsed).count() == 2


def test_a_root_that_is_not_there(spark, root):
    with pytest.raises(Exception, match="nowhere"):
        tree.read_tree(spark, f"{root}/nowhere").collect()
