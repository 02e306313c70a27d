"""Every operator and stage on odd rows and on empty tables."""

import os

import pytest

import corpus_pipeline
from marlstone.llm import decontaminate, lines, lm, near_dup, packing, pii, quality, queries, token_counts, toxicity, warc
from marlstone.llm.common import shared_dir

import odd

BPE = queries.tokenizer("byte_bpe_50k.json")


def folder(spark):
    return f"{shared_dir(spark)}/test-{os.urandom(6).hex()}"


def toxic(spark, docs):
    return toxicity.toxicity(docs, toxicity.fit(docs, odd.labels(spark)))


OPERATORS = {
    "packing": lambda spark, docs: packing.pack_documents(docs, BPE),
    "token_counts": lambda spark, docs: token_counts.TokenCounts(spark, folder(spark), BPE).count(docs),
    "quality": lambda spark, docs: quality.weak_quality(docs),
    "pii": lambda spark, docs: pii.find_disclosures(docs),
    "sanitise": lambda spark, docs: pii.sanitise(docs),
    "decontaminate": lambda spark, docs: decontaminate.contamination(docs, odd.benchmark(spark), near=5),
    "toxicity": toxic,
    "lm": lambda spark, docs: lm.code_lengths(docs),
    "lines": lambda spark, docs: lines.drop_common_lines(docs, min_docs=2),
    "near_dup": lambda spark, docs: near_dup.near_duplicates(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    result = OPERATORS[name](spark, odd.documents(spark))
    if name == "packing":
        whole = result.where("start = 0")
        assert odd.ids(whole) == odd.ALL_IDS
    else:
        assert odd.ids(result) == odd.ALL_IDS
    assert result.schema["doc_id"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, odd.documents(spark, [])).count() == 0


def test_warc_odd_rows(spark):
    pages = odd.documents(spark).withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", odd.F.lit("u\r\nv%"))
    place = folder(spark)
    index = warc.write_archives(pages, place)
    records = warc.read_records(index, place).collect()
    assert len(records) == len(odd.DOCUMENTS) and all(r.intact and r.url == "u\r\nv%" for r in records)
    by_id = {}
    for r in records:
        by_id.setdefault(r.record_id, []).append(r)
    assert [r.record_type for r in by_id["1"]] == ["response"] * 2
    assert by_id["7"][0].record_type == "revisit" and by_id["7"][0].refers_to == "1"
    assert {r.record_type for r in by_id["null"]} == {"response", "revisit"}
    assert by_id["3"][0].refers_to == "2" and by_id["3"][0].payload_bytes == 0
    empty = pages.limit(0)
    place = folder(spark)
    assert warc.read_records(warc.write_archives(empty, place), place).count() == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("odd"))
    odd.labels(spark).write.parquet(f"{place}/labels.parquet")
    odd.benchmark(spark).write.parquet(f"{place}/benchmark.parquet")
    return place


@pytest.mark.parametrize("number", range(5))
@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages(spark, tables, number, rows):
    docs = odd.documents(spark, odd.DOCUMENTS if rows == "odd" else [])
    name, stage = corpus_pipeline.STAGES[number]
    result = stage(spark, docs, tables)
    if number < 4:
        assert result.columns == docs.columns and result.dtypes == docs.dtypes
    found = odd.ids(result)
    if rows == "none":
        assert found == []
    elif name == "minhash":  # rows 1, 1 and 7 are copies
        assert found == sorted([i for i in odd.ALL_IDS if i != 7][:0] + [1, 2, 3, 4, 5, 6, 8, 9, None, None], key=repr)
    elif name == "decontamination":
        assert found == sorted([2, 3, 4, 5, 6, 9, None, None], key=repr)
    elif name != "packing":
        assert found == odd.ALL_IDS


def test_run(spark, tables):
    odd.documents(spark).write.mode("overwrite").parquet(f"{tables}/documents.parquet")
    assert corpus_pipeline.run(spark, tables).where("start = 0").count() == 8
