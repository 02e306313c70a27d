"""Sources, the ingest job and its command line."""

import os
import urllib.error

import pytest

from marlstone import cli
from marlstone.config import CorpusConfig
from marlstone.functions.embedding import HashedWords
from marlstone.plans.ingest import ingest
from marlstone.sources import catalog, checkout, files, web
from marlstone.streaming.index import ChunkIndex


def write(root, tree):
    for name, text in tree.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())


def listed(frame):
    return sorted(r.rel_path for r in frame.collect())


def test_document_listing(spark, tmp_path):
    tree = {
        "docs/a.md": "", "docs/B.MDX": "", "docs/_u.md": "", "_x/z.md": "", "docs/.dot.md": "", "README.md": "",
        "node_modules/p/r.md": "", "docs/assets/i.md": "", ".github/c.md": "", "docs/.hid/d.md": "",
        "docs/x.py": "", "docs/.md": "", "deep/1/2/3/4/5/e.md": "", "vendor/v.md": "", "docs/y.html": "",
    }
    write(tmp_path, tree)
    root = str(tmp_path)
    kept = ["README.md", "_x/z.md", "deep/1/2/3/4/5/e.md", "docs/.dot.md", "docs/B.MDX", "docs/_u.md", "docs/a.md"]
    assert listed(files.markdown_files(spark, root)) == sorted(kept)
    assert listed(files.document_files(spark, root)) == sorted([*kept, "docs/y.html"])
    picked = files.document_files(spark, root, (".md", ".py"), ("docs", "README.md"))
    assert listed(picked) == ["README.md", "docs/.dot.md", "docs/_u.md", "docs/a.md", "docs/x.py"]
    bodies = files.read_contents(picked, root, 3)
    assert bodies.rdd.getNumPartitions() == 3 and bodies.count() == 5
    os.symlink(tmp_path / "docs", tmp_path / "loop")
    assert "loop/a.md" not in listed(files.markdown_files(spark, root))


def test_default_catalog(spark):
    by_name = {s.name: s for s in catalog.DEFAULT_SOURCES}
    assert len(by_name) == 12 and catalog.DEFAULT_SOURCES[0].prefix_source_path is False
    assert by_name["xaman-docs"].url_base == "https://docs.xaman.dev/"
    assert by_name["joey-docs"].llms_txt_url == "https://docs.joeywallet.xyz/llms.txt"
    assert by_name["xrpl-py"].file_suffixes == (".md", ".py", ".rst")
    frame = catalog.catalog_frame(spark)
    assert frame.count() == 12 and frame.where("llms_txt_url is not null").count() == 2
    config = CorpusConfig(docs_path="/somewhere")
    assert [s.path for s in catalog.sources_for_ingest(config, single_source=True)] == ["/somewhere"]
    assert all(os.path.isabs(s.path) for s in catalog.sources_for_ingest(config))


def test_checkout(tmp_path):
    ran = []
    run = lambda command, check: ran.append((command, check))
    with pytest.raises(FileNotFoundError, match="Docs path does not exist"):
        checkout.ensure_checkout(str(tmp_path / "no"), "url", update=False, run=run)
    new = str(tmp_path / "deep" / "new")
    assert checkout.ensure_checkout(new, "url", run=run) == new
    (tmp_path / "old" / ".git").mkdir(parents=True)
    old = str(tmp_path / "old")
    checkout.ensure_checkout(old, "url", run=run)
    checkout.ensure_checkout(old, "url", update=False, run=run)
    checkout.ensure_checkout(str(tmp_path), "url", run=run)
    assert ran == [
        (["git", "clone", "--depth", "1", "url", new], True),
        (["git", "-C", old, "pull", "--ff-only"], True),
    ]


BASE = "https://docs.example.com/"
INDEX = f"""# Site
- [Welcome]({BASE}welcome.md)
- [Start]({BASE}overview/start.md): first steps
- [Again]({BASE}welcome.md)
- [Other](https://elsewhere.example/other.md)
- [Trick](https://docs.example.com.evil.example/x.md)
- [Escape]({BASE}../up.md)
- [Not markdown]({BASE}overview/page)
"""


def serve():
    """A fetch function; nested, so that it travels to the workers by value."""

    def fetch(url):
        if url.endswith("llms.txt"):
            return INDEX
        if "start" in url:
            raise urllib.error.HTTPError(url, 404, "Not Found", None, None)
        return f"# Page\n\nContent of {url} é"

    return fetch


def test_web_mirror(spark, tmp_path):
    root, warnings, fetch = str(tmp_path / "mirror"), [], serve()
    args = (spark, root, f"{BASE}llms.txt", BASE)
    with pytest.raises(FileNotFoundError):
        web.ensure_mirror(*args, update=False)
    assert web.ensure_mirror(*args, fetch=fetch, warn=warnings.append) == root
    page = tmp_path / "mirror" / "welcome.md"
    assert page.read_text("utf-8") == f"# Page\n\nContent of {BASE}welcome.md é"
    assert not (tmp_path / "mirror" / "overview" / "start.md").exists()
    assert not (tmp_path / "up.md").exists()
    assert warnings == [f"warning: skipping {BASE}overview/start.md: HTTP 404"]
    assert web.ensure_mirror(*args, update=False) == root
    with pytest.raises(RuntimeError, match="No markdown page URLs"):
        web.ensure_mirror(*args, fetch=lambda url: "nothing")
    only = lambda url: f"({BASE}start.md)" if url.endswith("llms.txt") else fetch(url)
    with pytest.raises(RuntimeError, match="Failed to fetch any"):
        web.ensure_mirror(*args, fetch=only, warn=warnings.append)


def test_config(monkeypatch):
    config = CorpusConfig.from_env({})
    assert (config.docs_path, config.collection_name) == (".cache/xrpl-dev-portal", "xrpl_docs")
    env = {"MARLSTONE_DOCS_PATH": "d", "MARLSTONE_DB_PATH": "hdfs://x/y", "MARLSTONE_COLLECTION": "c", "MARLSTONE_EMBEDDING_MODEL": "m"}
    config = CorpusConfig.from_env(env).resolve("/base")
    assert config == CorpusConfig("/base/d", "hdfs://x/y", "c", "m")


WRITERS = {
    ".md": lambda name: f"## About {name}\n\n{name} in Markdown.\n",
    ".rst": lambda name: f"About {name}\n~~~~~~~~~~~~~~~~~~~~\n\n{name} in RST.\n",
    ".html": lambda name: f"<h5>About {name}</h5>{name} in HTML.",
    ".py": lambda name: f"'{name} in Python.'\n",
}


def every_source(place):
    """Of each source of the catalog one file of each suffix that it takes; also the number of files."""
    roots, files = {}, 0
    for source in catalog.DEFAULT_SOURCES:
        roots[source.name] = place / source.name
        inside = f"{source.include_parts[0]}/" if source.include_parts else ""
        for suffix in source.file_suffixes:
            if suffix in WRITERS:
                write(roots[source.name], {f"{inside}about_{suffix[1:]}{suffix}": WRITERS[suffix](source.name)})
                files += 1
    return roots, files


def test_ingest_over_all_sources(spark, tmp_path):
    roots, files = every_source(tmp_path / "sources")
    config = CorpusConfig(docs_path="unused", db_path=str(tmp_path / "db"), embedding_model="hashed-words-32")
    acquire = lambda spark, source, update: str(roots[source.name])
    first = ingest(spark, config, acquire=acquire)
    assert (first.files, first.bad_files, first.sources) == (files, 0, len(roots))
    assert first.sync.added == first.sync.total == files
    index = ChunkIndex(spark, config.db_path, config.collection_name, HashedWords(32))
    stored = {r.source_path: r for r in index.chunks().collect()}
    for source in catalog.DEFAULT_SOURCES:
        own = [r for r in stored.values() if r.text.startswith((f"{source.name} in", "# about"))]
        if source.prefix_source_path:
            own = [r for r in own if r.source_path.startswith(f"{source.name}:")]
        assert own and all(r.url.startswith("https://") for r in own)

    # One file changed, one is new and broken.
    last = catalog.DEFAULT_SOURCES[-1].name
    paths = sorted(p for p in roots[last].rglob("*") if p.is_file())
    paths[0].write_text(WRITERS[paths[0].suffix](f"{last}, revised,"))
    write(paths[0].parent, {"broken.md": "---\nday: 2024-02-30\n---\nx"})
    again = ingest(spark, config, acquire=acquire)
    assert (again.sync.added, again.sync.removed, again.sync.unchanged, again.bad_files) == (1, 1, files - 1, 1)
    [(source, path, reason)] = again.bad_examples
    assert source == last and path.endswith("broken.md") and reason.startswith("YAML")
    assert spark.read.json(again.bad_table).count() == 1

    # A single source never drops what the others brought.
    one = ingest(spark, config, single_source=True, acquire=acquire)
    assert (one.sync.added, one.sync.removed, one.sources) == (0, 0, 1) and index.count() == files
    for path in (p for p in roots[last].rglob("*") if p.is_file()):
        path.unlink()
    with pytest.raises(RuntimeError, match="No supported docs files found"):
        ingest(spark, config, acquire=acquire)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    docs = tmp_path / "checkout"
    mills = "".join(f"# Mill {n}\n\nGrinds grain of kind k{n}.\n\n" for n in range(3))
    write(docs, {"docs/mills.md": mills, "docs/odd.md": b"\xc3("})
    monkeypatch.setenv("MARLSTONE_DB_PATH", str(tmp_path / "db"))
    monkeypatch.setenv("MARLSTONE_EMBEDDING_MODEL", "hashed-words-64")

    def said(code, *args):
        assert cli.main([*args]) == code
        return capsys.readouterr()

    local = ("ingest", "--docs-path", str(docs), "--no-update")
    assert "search failed" in said(1, "search", "grain").err
    ingested = said(0, *local)
    assert "Indexed 3 chunks from 2 files across 1 sources." in ingested.out
    assert "docs/odd.md: not valid UTF-8" in ingested.err
    assert "Embedded 0 new chunks; 3 unchanged, 0 removed." in said(0, *local).out
    found = said(0, "search", "grain of kind k1", "--top-k", "2", "--docs-path", "ignored").out
    assert found.startswith("[1] Mill 0\nHeading: Mill 1\n") and "\n[2] " in found and "[3]" not in found
    shown = said(0, "context", "kind k2").out
    assert shown.startswith("Question: kind k2\n\n") and "Score" not in shown and "kind k2." in shown
    gone = said(1, "ingest", "--docs-path", str(tmp_path / "gone"), "--no-update")
    assert "ingest failed: Docs path does not exist" in gone.err
    with pytest.raises(SystemExit):
        cli.main(["search", "x", "--top-k", "0"])
