"""The map-code job end to end, its sinks, and the scanner."""

import json
import os
import pathlib

import pytest

from marlstone import cli
from marlstone.operators import pycode
from marlstone.plans.code_map import map_codebase
from marlstone.sinks.code_map import write_jsonl, write_markdown, write_outputs
from marlstone.sources.files import CPP_SUFFIXES, code_files

STAGES = 4


@pytest.fixture
def tree(tmp_path):
    """A chain of functions, each calling the one before, and a test file that calls the last."""
    root = tmp_path / "tree"
    for place, lines in {
        "engine/chain.hpp": [
            "struct Chain",
            "{",
            "    int links;",
            "};",
            *(
                line
                for n in range(STAGES)
                for line in ("", f"inline int stage{n}(Chain c)", "{", f"    return {f'stage{n - 1}(c)' if n else 'c.links'};", "}")
            ),
        ],
        "checks/tests/all.cpp": ["bool holds()", "{", f"    return stage{STAGES - 1}(Chain {{ 1 }}) == 1;", "}"],
    }.items():
        target = root / place
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return root


def jsonl_rows(folder):
    parts = sorted(pathlib.Path(folder).glob("part-*"))
    return [json.loads(line) for p in parts for line in p.read_text("utf-8").splitlines()]


def test_records_and_links_of_a_chain(spark, tree, tmp_path):
    said = []
    place = str(tmp_path / "out")
    result = map_codebase(spark, str(tree), place, progress=said.append, progress_every=1, throttle_ms=1)
    assert (result.record_count, result.file_count, result.warnings) == (STAGES + 2, 2, [])
    rows = jsonl_rows(result.outputs["jsonl"])
    assert [r["name"] for r in rows] == ["holds", "Chain", *(f"stage{n}" for n in range(STAGES))]
    assert all(r["class"] == "" for r in rows[2:]) and {r["kind"] for r in rows} == {"function", "struct"}
    for n, row in enumerate(rows[2:]):
        assert row["called_by"] == ([f"stage{n + 1}"] if n < STAGES - 1 else ["holds"])
    assert rows[-1]["related_tests"] == rows[0]["related_tests"] == ["checks/tests/all.cpp"]
    assert rows[2]["related_tests"] == []
    text = pathlib.Path(result.outputs["markdown"], "engine/chain.hpp.md").read_text("utf-8")
    assert text.count("```cpp\n") == STAGES + 1 and text.index("Chain") < text.index("stage0")
    assert not [n for _, _, names in os.walk(place) for n in names if n.endswith(".tmp")]
    # The messages.
    assert said[:2] == ["Scanning source files...", "Found 2 supported source files."]
    assert said[-3:] == [f"Analyzed 2/2 files, records={STAGES + 2}.", "Building relationships...", "Writing outputs..."]


def test_sinks_count_records(spark, tree, tmp_path):
    records = map_codebase(spark, str(tree), str(tmp_path / "o")).records
    assert write_jsonl(records, str(tmp_path / "lines")) == STAGES + 2
    assert write_markdown(records, str(tmp_path / "pages")) == STAGES + 2


def test_only_the_chosen_format_is_written(spark, tree, tmp_path):
    out = tmp_path / "out"
    result = map_codebase(spark, str(tree), str(out), output_format="jsonl")
    assert result.outputs == {"jsonl": f"{out}/records.jsonl"}
    assert not (out / "markdown").exists()
    with pytest.raises(ValueError, match="Unsupported output format"):
        write_outputs(result.records, str(out), "yaml")


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Codebase path does not exist"):
        map_codebase(spark, str(tmp_path / "no"), str(tmp_path / "out"))
    file = tmp_path / "file"
    file.write_text("x")
    with pytest.raises(NotADirectoryError):
        map_codebase(spark, str(file), str(tmp_path / "out"))
    with pytest.raises(RuntimeError, match="No supported source files"):
        map_codebase(spark, str(tmp_path), str(tmp_path / "out"))
    (tmp_path / "empty.h").write_text("int x;\n")
    with pytest.raises(RuntimeError, match="No code records"):
        map_codebase(spark, str(tmp_path), str(tmp_path / "out"))


def test_cli_map_code(spark, tree, tmp_path, capsys):
    args = ["map-code", str(tree), "--out", str(tmp_path / "o"), "--format", "jsonl", "--progress-every", "1"]
    assert cli.main(args) == 0
    captured = capsys.readouterr()
    assert f"Mapped {STAGES + 2} records from 2 files." in captured.out
    assert f"Analyzed 2/2 files, records={STAGES + 2}." in captured.err
    assert cli.main(["map-code", str(tmp_path / "missing")]) == 1
    assert "map-code failed: Codebase path does not exist" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["map-code", str(tree), "--max-code-chars", "10"])


def names(df):
    return sorted(r.rel_path for r in df.collect())


def test_scanner_filters(spark, tmp_path):
    for name in (
        "src/A.cpp", "src/deep/B.CPP", "src/_gen/C.h", "build/D.cpp", ".rag/E.h", "test/F.hpp",
        "cmake-build-debug/G.c", "bazel-out/H.c", "src/notes.txt", ".h", "src/.I.h", ".hidden/J.h",
    ):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x")
    every = ["src/.I.h", "src/A.cpp", "src/_gen/C.h", "src/deep/B.CPP", "test/F.hpp", ".hidden/J.h"]
    assert names(code_files(spark, str(tmp_path))) == sorted(every)
    # "*" crosses "/", patterns also match the bare file name, case matters.
    assert names(code_files(spark, str(tmp_path), include=("src/*.cpp",))) == ["src/A.cpp"]
    assert names(code_files(spark, str(tmp_path), include=("src/*.[cC]*",))) == ["src/A.cpp", "src/deep/B.CPP"]
    assert names(code_files(spark, str(tmp_path), include=("?.h*",), exclude=("*/_gen/*",))) == [".hidden/J.h", "test/F.hpp"]


def test_languages_and_analyzers_are_the_callers_choice(spark, tree, tmp_path):
    module = 'import os\nfrom . import x\n\n@wrap\ndef outer(a, *, b=1):\n    """Doc."""\n    return inner(a) + os.getcwd()\n\nclass K(Base):\n    def inner(self): return outer(1)\n'
    (tree / "tools").mkdir()
    (tree / "tools" / "make.py").write_text(module)
    (tree / "tools" / "broken.py").write_text("def (:\n")
    languages = {"cpp": CPP_SUFFIXES, "python": (".py",), "text": (".txt",)}
    (tree / "notes.txt").write_text("x")
    result = map_codebase(spark, str(tree), str(tmp_path / "out"), "jsonl", languages=languages)
    assert (result.file_count, result.record_count) == (5, STAGES + 2 + 3)
    assert result.warnings == ["No analyzer for notes.txt"]
    rows = {r["qualified_name"]: r for r in jsonl_rows(result.outputs["jsonl"]) if r["language"] == "python"}
    assert set(rows) == {"tools.make.outer", "tools.make.K", "tools.make.K.inner"}
    outer, inner = rows["tools.make.outer"], rows["tools.make.K.inner"]
    assert (outer["line_start"], outer["line_end"], outer["signature"]) == (4, 7, "def outer(a, *, b=1)")
    assert (outer["docstring"], outer["imports"], outer["calls"]) == ("Doc.", ["os", "."], ["inner", "getcwd"])
    assert outer["code"] == "\n".join(module.split("\n")[3:7])
    assert (inner["class"], inner["called_by"], outer["called_by"]) == ("K", ["tools.make.outer"], ["tools.make.K.inner"])
    # Without one for C++ its files are named, and the rest is mapped.
    few = map_codebase(spark, str(tree), str(tmp_path / "few"), "jsonl", languages=languages,
                       analyzers={"python": pycode.analyze})
    assert few.record_count == 3
    assert few.warnings == [f"No analyzer for {n}" for n in ("checks/tests/all.cpp", "engine/chain.hpp", "notes.txt")]
    # By default only C and C++ are looked for.
    assert map_codebase(spark, str(tree), str(tmp_path / "cpp"), "jsonl").file_count == 2
