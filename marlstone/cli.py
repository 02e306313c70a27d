"""Command line: ingest, search, context, map-code."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from marlstone.config import CorpusConfig
from marlstone.functions.embedding import embedder_for
from marlstone.plans.code_map import map_codebase
from marlstone.plans.ingest import ingest
from marlstone.plans.search import TOP_K, context_text, search_text
from marlstone.session import build_session
from marlstone.streaming.index import ChunkIndex


def _at_least(low: int):
    def parse(text: str) -> int:
        value = int(text)
        if value < low:
            raise argparse.ArgumentTypeError(f"must be at least {low}")
        return value

    return parse


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    switch = argparse.BooleanOptionalAction

    verb = verbs.add_parser("ingest", help="Build or refresh the index.")
    verb.add_argument("--docs-path", help="Use only this checkout of the main source.")
    verb.add_argument("--update", action=switch, default=True, help="Fetch sources first.")

    for name, text in (("search", "Print ranked chunks."), ("context", "Print prompt context.")):
        verb = verbs.add_parser(name, help=text)
        verb.add_argument("question")
        verb.add_argument("--top-k", type=_at_least(1), default=TOP_K)
        verb.add_argument("--docs-path", help="Without effect; the index is what is searched.")

    verb = verbs.add_parser("map-code", help="Map a C/C++ tree to records.")
    verb.add_argument("codebase_path")
    verb.add_argument("--out", default=".rag/code-map")
    verb.add_argument("--format", default="both", help="jsonl, markdown, or both")
    verb.add_argument("--include", action="append", help="Glob; repeatable.")
    verb.add_argument("--exclude", action="append", help="Glob; repeatable.")
    verb.add_argument("--max-code-chars", type=_at_least(200), default=12_000)
    verb.add_argument("--progress", action=switch, default=True)
    verb.add_argument("--progress-every", type=_at_least(1), default=100)
    verb.add_argument("--throttle-ms", type=_at_least(0), default=0)
    return parser


def _say(message: str) -> None:
    print(message, file=sys.stderr)


def _ingest(spark, args) -> None:
    config = CorpusConfig.from_env()
    if args.docs_path:
        config = replace(config, docs_path=args.docs_path)
    config = config.resolve()
    result = ingest(spark, config, args.update, single_source=args.docs_path is not None)
    sync = result.sync
    print(
        f"Indexed {sync.total} chunks from {result.files} files across {result.sources} sources."
    )
    print(f"Embedded {sync.added} new chunks; {sync.unchanged} unchanged, {sync.removed} removed.")
    if result.bad_files:
        _say(f"warning: {result.bad_files} files could not be parsed")
        for source, path, reason in result.bad_examples:
            _say(f"warning: {source} {path}: {reason}")
        if result.bad_table:
            _say(f"warning: all of them with their reasons: {result.bad_table}")
    print(f"Vector DB: {config.db_path}")


def _ask(spark, args) -> None:
    config = CorpusConfig.from_env().resolve()
    embedder = embedder_for(config.embedding_model)
    index = ChunkIndex(spark, config.db_path, config.collection_name, embedder)
    answer = search_text if args.verb == "search" else context_text
    print(answer(index, args.question, args.top_k))


def _map_code(spark, args) -> None:
    result = map_codebase(
        spark, args.codebase_path, args.out, args.format, args.include, args.exclude,
        args.max_code_chars, _say if args.progress else None, args.progress_every, args.throttle_ms,
    )
    print(f"Mapped {result.record_count} records from {result.file_count} files.")
    for name, path in result.outputs.items():
        print(f"{name}: {path}")
    for warning in result.warnings:
        _say(f"warning: {warning}")


_VERBS = {"ingest": _ingest, "search": _ask, "context": _ask, "map-code": _map_code}
_HINT = "\nRun `marlstone ingest` first if the index is empty."


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        session = build_session(**{"spark.ui.showConsoleProgress": "false"})
        _VERBS[args.verb](session, args)
    except Exception as problem:
        hint = _HINT if args.verb in ("search", "context") else ""
        _say(f"{args.verb} failed: {problem}{hint}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
