"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores. Every query writes to
the no-op sink: one warm-up, then the median of three runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402
from checks.documents import document_chunks, revised_pages  # noqa: E402
from marlstone.functions.embedding import HashedWords  # noqa: E402
from marlstone.operators.chunk import chunk_pages  # noqa: E402
from marlstone.session import build_session  # noqa: E402
from marlstone.streaming.index import ChunkIndex  # noqa: E402

HEADLINE = (
    "chunk_words", "dedupe_chunks", "html_to_text", "html_chunks", "md_sections", "rst_clean",
    "python_api_docs", "embed_hash", "sync_changes", "search_text_batch", "knn_batch",
    "cpp_records", "call_edges", "called_by", "related_tests", "attach_relationships",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action, runs: int) -> float:
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def index_times(spark, folder: str) -> dict[str, float]:
    """First sync, a sync without changes, a sync with changes."""
    chunks = document_chunks(spark, folder)
    revised = chunk_pages(revised_pages(spark, folder))
    index = ChunkIndex(spark, tempfile.mkdtemp(prefix="bench-index-"), "bench", HashedWords())
    return {
        "index_first_sync": timed(lambda: index.sync(chunks), 1),
        "index_no_change_sync": timed(lambda: index.sync(chunks), 1),
        "index_revised_sync": timed(lambda: index.sync(revised), 1),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        action = lambda: run(checks.QUERIES[name](spark, folder))
        action()
        times[name] = timed(action, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        times |= index_times(spark, folder)
    spark.stop()
    report = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
