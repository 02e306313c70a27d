"""Operators against plain loops over small fixtures."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontaminate, lm, near_dup, packing, pii, quality, queries, token_counts, toxicity, warc
from marlstone.llm.common import WORD_BYTES, shared_dir, words

import odd

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def rows(name):
    return duckdb.sql(f"select * from '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))


def plain_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@needs_data
def test_warc(spark):
    got = sorted(tuple(r)[:5] for r in queries.op1(spark, SF).collect())
    pages = sorted((r[0], (r[2] or "").encode()) for r in rows("pages"))
    first = {}
    for page, body in pages:
        first.setdefault(body, page)
    want = [
        (
            page,
            len(body),
            base64.b32encode(hashlib.sha1(body).digest()).decode(),
            "response" if first[body] == page else "revisit",
            None if first[body] == page else first[body],
        )
        for page, body in pages
    ]
    assert got == want


@needs_data
def test_warc_ranges_are_coalesced(spark):
    place = f"{shared_dir(spark)}/warc-test"
    index = warc.write_archives(spark.read.parquet(f"{SF}/pages.parquet"), place, archive_bytes=20_000)
    chosen = index.where("cast(page_id as int) % 3 = 0")
    got = warc.read_records(chosen, place, gap=100, task_bytes=10_000).select("record_id").collect()
    assert sorted(int(r[0]) for r in got) == sorted(r[0] for r in rows("pages") if r[0] % 3 == 0)
    reads = list(warc._ranges([("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("b", 45, 5), ("b", 50, 100)], 10, 60))
    assert reads == [("a", 0, 15, [0, 1]), ("a", 40, 45, [2]), ("b", 45, 50, [3]), ("b", 50, 150, [4])]


def test_ids_are_the_librarys(library):
    random.seed(3)
    texts = ["".join(random.choice("ab'sdtmrevl \n\t.,1é!|") for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += ["naïve ÉCOLE", "  x y", "<|endoftext|>", "a×b÷c", "\x00\x1c", "it's we're I'LL", "日本 語", "  \n\n "]
    encoder = bpe.Encoder(queries.tokenizer("byte_bpe_50k.json"))
    data = [t.encode() for t in texts]
    for text, ids, count in zip(texts, encoder.ids(data), encoder.counts(data)):
        assert list(ids) == plain_ids(library, text), text
        assert count == len(ids)


def test_other_tokenizers(spark):
    docs = spark.createDataFrame([(1, "Hello wörld, hello!"), (2, None), (3, "<s> odd </s>")], "doc_id long, text string")
    from tokenizers import Tokenizer
    import sentencepiece

    path = queries.tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = token_counts.TokenCounts(spark, f"{shared_dir(spark)}/other-1", path).count(docs).collect()
    texts = {1: "Hello wörld, hello!", 2: "", 3: "<s> odd </s>"}
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(plain.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    path = queries.tokenizer("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.TokenCounts(spark, f"{shared_dir(spark)}/other-2", path).count(docs).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(pieces.encode(t)) for k, t in texts.items()}


def check_packing(got, docs, library):
    """Whole documents, gapless sequences, sizes of powers of two."""
    want = {k: [*plain_ids(library, t), 1] for k, t in docs}
    seen, sequences = {}, {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, ids in want.items():
        at = 0
        for start, length in sorted(seen[key]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


@needs_data
def test_packing(spark, library):
    check_packing(queries.op2(spark, SF).collect(), [(r[0], r[1]) for r in rows("documents")], library)


def test_hilbert_curve_is_one_path():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
        keys = packing.hilbert_key(grid, bits)
        path = grid[np.argsort(keys)]
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@needs_data
def test_neighbours_in_sequences_are_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json")).join(docs.select("doc_id", "lang"), "doc_id")
    order = [r.lang for r in pieces.where("start = 0").orderBy("sequence_id", "offset").collect()]
    same = sum(a == b for a, b in zip(order, order[1:])) / (len(order) - 1)
    shares = Counter(order)
    assert same > sum((n / len(order)) ** 2 for n in shares.values()) + 0.1


@needs_data
def test_token_counts(spark, library):
    got = {r.doc_id: tuple(r) for r in queries.op3(spark, SF).collect()}
    for key, text, *_ in rows("documents"):
        n = len(plain_ids(library, text))
        assert got[key] == (key, len(text.encode()), n, n > 512)


def test_token_counts_come_from_the_cache(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "doc_id long, text string")
    counts = token_counts.TokenCounts(spark, f"{shared_dir(spark)}/cache-test", queries.tokenizer("byte_bpe_50k.json"))
    counts.count(docs).collect()
    assert counts.stored().count() == spark.read.parquet(counts.folder).count() == 3
    # A stored count is used as it is, and only a new text is encoded.
    marked = spark.read.parquet(counts.folder).withColumn("n_tokens", F.col("n_tokens") + 100)
    marked.write.mode("append").parquet(counts.folder)
    more = docs.unionByName(spark.createDataFrame([(5, "new text")], docs.schema))
    got = {r.doc_id: r.n_tokens for r in counts.count(more).collect()}
    assert got == {1: 102, 2: 102, 3: 101, 4: 100, 5: 2}
    assert spark.read.parquet(counts.folder).count() == 7


def base_quality(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    return len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@needs_data
def test_quality_values(spark):
    got = {r.doc_id: r for r in queries.op4(spark, SF).collect()}
    for key, text, *_ in rows("documents"):
        r, want = got[key], base_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    for text in ("a a a a a a a b", "a b c d e a b c d e x", "1 2 3 4 5", "", "p q r s t u p q r s t"):
        assert quality.repeated_words(text.encode().split()) == base_quality(text)[4]


def test_quality_agrees_with_labels(spark):
    place = "/root/testdata/sf0.01"
    if not os.path.isdir(place):
        pytest.skip("needs the given tables")
    found = queries.op4(spark, place).join(spark.read.parquet(f"{place}/labels.parquet"), "doc_id").toPandas()
    assert (found.kept == (found.quality == 1)).mean() > 0.93


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.7
    accuracy, speaks = np.array([0.95, 0.8, 0.6, 0.7]), np.array([0.9, 0.5, 0.9, 0.8])
    right = rng.random((20_000, 4)) < accuracy
    votes = np.where(rng.random((20_000, 4)) < speaks, np.where(right == good[:, None], 1, -1), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, chances = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.05
    found = chances[1, :, 2] / (chances[1, :, 2] + chances[1, :, 0])
    assert np.abs(found - accuracy).max() < 0.05


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                odd_, even = digits[-1::-2], digits[-2::-2]
                total = sum(map(int, odd_)) + sum(sum(divmod(2 * int(d), 10)) for d in even)
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), rank, m.end()))
    return sorted(found)


def test_base_spans():
    random.seed(5)
    for _ in range(5000):
        text = "".join(random.choice("a@.1-+ ()%9é") for _ in range(random.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("4111 1111 1111 1111", "x 1.2.3.4.5.6.7.8", "+1 (017) 555-7713)", "300.1.1.1 1.1.1.1", "a@b.c@d.e"):
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 200_000 + "a" * 200_000) == []
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [(0, 1, 5007)]


@needs_data
def test_pii_query(spark):
    got = {r.doc_id: r for r in queries.op5(spark, SF).collect()}
    for key, text, *_ in rows("documents"):
        spans = plain_spans(text)
        named = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        r = got[key]
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, named.split(","))) <= set(r.spans.split(","))


def test_disclosing_terms(spark):
    filler = "the quick brown fox jumps over the lazy dog again and"
    docs = [(i, f"{filler} Zanzibar Quill writes from q.zan@mail.example today {filler}") for i in range(3)]
    docs += [(i, f"{filler} some other person number {i} writes today") for i in range(10, 60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_disclosures(frame, reach=4).collect()}
    terms = {docs[0][1][s["start"] : s["stop"]] for s in found[0] if s["rank"] == 4}
    assert terms == {"Zanzibar", "Quill", "from"}
    assert all(not found[i] for i in range(10, 60))
    clean = {r.doc_id: r.text for r in pii.sanitise(frame, reach=4).collect()}
    assert "Quill" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == docs[3][1]
    gone = {r.doc_id: r.text for r in pii.sanitise(frame, how="remove", reach=4).collect()}
    assert "q.zan" not in gone[1] and "[" not in gone[1]
    # By hand: near one entity e the measure is 1 - log(d(t) / d(e, t)) / log(N / d(e)).
    assert 1 - math.log(53 / 3) / math.log(53 / 3) < 0.8


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_disclosing_terms_are_marked_everywhere(spark, most):
    filler = " ".join(["some common words"] * 10)
    docs = [(i, f"Zanzibar {filler} q.zan@mail.example {filler} Zanzibar") for i in range(3)]
    docs += [(3, f"{filler} and zanzibar alone"), *((i, f"{filler} number {i}") for i in range(10, 100))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(frame, most_terms=most).collect()}
    for i, text in docs:
        assert clean[i] == re.sub("(?i)zanzibar", "[TERM]", text).replace("q.zan@mail.example", "[EMAIL]")


def plain_contamination(docs, items, size=10):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))

    windows = {}
    for item, text in items:
        own = split(text)
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, found = split(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if (key := tuple(own[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@needs_data
def test_decontamination(spark):
    docs, items = [(r[0], r[1]) for r in rows("documents")], [(r[0], r[1]) for r in rows("benchmark")]
    want = plain_contamination(docs, items)
    assert sorted(tuple(r)[:6] for r in queries.op6(spark, SF).collect()) == want
    # Small segments and many blocks of items give the same.
    frames = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")]
    got = decontaminate.contamination(*frames, block_bytes=3000, segment_words=3000)
    assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got.collect()) == [w[:4] for w in want]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 50 + "beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.contamination(docs, items, near=5).collect()}
    assert got == {1: ([], [7]), 2: ([], [7]), 3: ([], [])}


@pytest.mark.parametrize("common", ["alpha", "beta", "gamma"])
def test_proximity_does_not_hang_on_other_documents(spark, common):
    far = " ".join(["x"] * 14)
    docs = [(1, f"beta {far} alpha {far} gamma"), (2, f"beta {far} alpha {far} {far} gamma"), (3, f"{common} " * 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    for words_ in (1, 1 << 21):
        got = decontaminate.contamination(frame, items, near=20, segment_words=words_).collect()
        assert {r.doc_id: r.near_items for r in got} == {1: [7], 2: [], 3: []}


def test_phrases_are_the_distinct_windows():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 4, 9]))) for _ in range(60)]
    items = [(i % 50, t or None) for i, t in enumerate(texts)]
    want: dict[tuple, set] = {}
    for name, text in items:
        own = (text or "").encode().split()
        for i in range(max(len(own) - 4, 0) + 1 if own else 0):
            want.setdefault(tuple(own[i : i + 4]), set()).add(name)
    found = decontaminate.Phrases(items, 4)
    terms = list(found.terms)
    got = {tuple(terms[t] for t in found.window(i)): set(found.items(i)) for i in range(len(found))}
    assert got == want and len(found) == len(want)
    counts = np.arange(len(terms))
    assert [terms[0] not in map(terms.__getitem__, found.window(i)) for i in range(len(found))] == [
        i in found.possible(counts) for i in range(len(found))
    ]
    assert not len(decontaminate.Phrases([(1, None)], 4))


def test_segments_of_a_partition_are_held_one_at_a_time(spark, monkeypatch):
    """A hundred segments of 4 MB in a row group, or sixteen in a batch, are more than an executor has."""
    kept, keep = [], decontaminate.keep
    monkeypatch.setattr(decontaminate, "keep", lambda *a, **b: kept.append(keep(*a, **b)) or kept[-1])
    monkeypatch.setattr(decontaminate, "BATCH_BYTES", "1k")
    docs = spark.range(1, 31).selectExpr("id as doc_id", "array_join(transform(sequence(1, 200), x -> concat('w', id * x)), ' ') as text")
    items = spark.createDataFrame([(1, "w3 w6 w9 w12")], "item_id long, text string")
    try:
        found = decontaminate.contamination(docs.coalesce(1), items, window=4, segment_words=200)
        assert [r.doc_id for r in found.collect() if r.n_hit] == [3]
        rows = kept[0].mapInArrow(lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n long")
        assert [r.n for r in rows.collect()] == [1] * 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in kept[0].inputFiles()]
    assert {m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)} == {1}


@pytest.mark.parametrize("most", [1, 50, 1 << 19])
def test_phrase_starts_are_those_of_a_plain_loop(most):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 6])))) for i in range(30)]
    found = decontaminate.Phrases(items, 3)
    line = [rng.choice("abcdxy") for _ in range(400)]
    postings = [np.array([i for i, w in enumerate(line) if w.encode() == t], np.int64) for t in found.terms]
    counts = np.array(list(map(len, postings)))
    got = [
        pair
        for numbers, starts in decontaminate.phrase_starts(found, found.possible(counts), postings, counts, most)
        for pair in zip(numbers.tolist(), starts.tolist())
    ]
    terms = [t.decode() for t in found.terms]
    want = []
    for i in range(len(found)):
        own = [terms[t] for t in found.window(i)]
        want += [(i, at) for at in range(len(line) - len(own) + 1) if line[at : at + len(own)] == own]
    assert sorted(got) == sorted(want) and len(want) > 30


@pytest.mark.parametrize("most", [1, 200, 1 << 19])
def test_near_starts_are_those_of_a_plain_loop(most):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcdefghz") for _ in range(rng.choice([1, 2, 3, 6])))) for i in range(40)]
    found = decontaminate.Phrases(items, 4)
    line = [rng.choice("abcdefghxy") for _ in range(300)]
    lists = [np.array([i for i, w in enumerate(line) if w.encode() == t], np.int64) for t in found.terms]
    postings = decontaminate.Postings(lists, np.array(list(map(len, lists))))
    got = [
        pair
        for numbers, starts in decontaminate.near_starts(found, found.possible(postings.counts), postings, 3, most)
        for pair in zip(numbers.tolist(), starts.tolist())
    ]
    terms = [t.decode() for t in found.terms]
    want = set()
    for i in range(len(found)):
        own = {terms[t] for t in found.window(i)}
        want |= {(i, at) for at in range(len(line)) if line[at] in own and own <= set(line[at : at + 7])}
    assert set(got) == want and len(want) > 100


def test_near_windows_are_searched_together(monkeypatch):
    rng = random.Random(9)
    text = [rng.choice("abcdefgh").encode() for _ in range(2000)]
    found = decontaminate.Phrases([(i, " ".join(rng.choice("abcdefgh") for _ in range(40))) for i in range(10)], 5)
    lists = {t: [i for i, w in enumerate(text) if w == t] for t in found.terms}
    row = {"starts": [0], "sizes": [len(text)], "terms": list(lists), "ends": np.cumsum([len(x) for x in lists.values()]).tolist()}
    row["postings"] = np.array(sum(lists.values(), []), "<i4").tobytes()
    calls, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    _, nearby, _ = decontaminate.search_segment(row, found, 20)
    assert nearby == {0: set(range(10))} and len(found) > 300 and len(calls) < len(found)


def test_near_positions_are_those_of_a_plain_loop():
    rng = random.Random(6)
    for _ in range(300):
        text, reach = [rng.randrange(12) for _ in range(80)], rng.randrange(1, 8)
        postings = [np.array([i for i, t in enumerate(text) if t == k], np.int64) for k in range(12)]
        window = np.array([rng.choice(text) for _ in range(4)])
        want = [i for i, t in enumerate(text) if t in window and set(window.tolist()) <= set(text[i : i + 2 * reach + 1])]
        assert decontaminate.near_positions(window, postings, np.array(list(map(len, postings))), reach).tolist() == want


def test_block_bounds_lose_no_neighbour():
    rng = random.Random(8)
    vocabulary = [f"word{i}"[:5] + str(i) for i in range(40)]
    index = toxicity.ExampleIndex({w[:5]: 0 for w in ()} | {f"t{i:04d}": i for i in range(40)}, np.linspace(1, 4, 40), 0.2, 15)
    texts = [" ".join(rng.choices([f"t{i:04d}" for i in range(40)] + ["other"] * 60, k=rng.randint(1, 30))) for _ in range(900)]
    index.build([(i, i % 3 == 0, 1.0, t) for i, t in enumerate(texts)])
    assert vocabulary and len(index.entries) > 300

    def dense(text):
        at, values = index.vector(text)
        out = np.zeros(41)
        out[at] = values
        return out

    matrix = np.array([dense(t) for t in texts])
    toxic = np.array([i % 3 == 0 for i in range(len(texts))])
    for text in [*texts[:60], "", "t0001 t0002 t0001", "other " * 50]:
        cosines = matrix @ dense(text)
        near = cosines >= np.sort(cosines)[-15] - 1e-9
        weights = 1 / (0.05 + np.maximum(0, 1 - cosines[near]))
        want = ((weights * toxic[near]).sum() + 2 * 0.2) / (weights.sum() + 2)
        assert abs(index.score(text)[0] - want) < 1e-6


def test_toxicity_on_held_out_rows(spark):
    place = "/root/testdata/sf0.01"
    if not os.path.isdir(place):
        pytest.skip("needs the given tables")
    found = queries.op7(spark, place).join(spark.read.parquet(f"{place}/labels.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9 and not ((held.predicted == 1) & (held.toxic == 0)).any()
    assert ((found.score >= 0) & (found.score <= 1)).all()


@pytest.mark.parametrize("percent", [10, 40, 60])
def test_toxicity_at_any_share_of_labels(spark, percent):
    rng = random.Random(percent)
    plain, marks = [f"w{i:03d}" for i in range(200)], ["badly", "worse", "awful"]
    docs = [
        (i, " ".join([*rng.choices(plain, k=30), *([rng.choice(marks)] * 2 if i % 100 < percent or i % 100 == 99 else [])]))
        for i in range(1000)
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    # One clean document in a hundred has a mark too.
    labels = frame.selectExpr("doc_id", f"int(doc_id % 100 < {percent}) as toxic")
    index = toxicity.fit(frame, labels, train=F.col("doc_id") < 800)
    score = {r.doc_id: r.toxicity for r in toxicity.toxicity(frame, index).where("doc_id >= 800").collect()}
    assert all(score[i] >= 0.5 for i in score if i % 100 < percent)
    assert all(score[i] < 0.5 for i in score if percent <= i % 100 < 99)


def test_toxicity_keeps_every_word_of_the_examples(spark):
    # A thousand toxic words, each in four documents, with the first letters of clean ones.
    docs = [(i, f"marks{i // 8 * 2 + i % 2:05d} filler") for i in range(8000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = frame.selectExpr("doc_id", "int(doc_id % 2) as toxic")
    index = toxicity.fit(frame, labels, train=F.col("doc_id") % 8 < 6, max_examples=8000)
    assert len(index.terms) == 2001
    held = toxicity.toxicity(frame, index).where("doc_id % 8 >= 6").collect()
    assert len(held) == 2000 and all((r.toxicity >= 0.5) == r.doc_id % 2 for r in held)


def test_examples_are_bounded_by_rows(spark):
    docs = [(i % 50 if i < 100 else 7, f"text {i}") for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.range(50).selectExpr("id as doc_id", "int(id % 2) as toxic")
    index = toxicity.fit(frame, labels, max_examples=40).load()
    assert sum(e[0] for e in index.entries) == 40
    assert abs(sum(e[2] for e in index.entries) - 50) < 1e-9


def test_words_of_a_batch_end_where_str_split_ends_them():
    rng = random.Random(5)
    letters = "ab A\u00e9\u3000\u00a0\u2003 \n\x85\x1c\u200b\U0001f600,"
    batches = [[c + "a" + c for c in map(chr, range(0x3100))]]
    batches += [[None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 9))] for _ in range(200)]
    for batch in batches:
        part = pa.array([*batch[:3], *batch], pa.string()).slice(len(batch[:3]))
        words_, row, at, times = toxicity._word_counts(part)
        got = [Counter() for _ in batch]
        for r, a, n in zip(row.tolist(), at.tolist(), times.tolist()):
            got[r][words_[a].as_py()] = n
        assert got == [Counter((t or "").encode().translate(WORD_BYTES).decode().split()) for t in batch]


@pytest.mark.parametrize("dense", [0, 5, 500])
def test_batches_of_texts_are_scored_as_all_pairs_say(monkeypatch, dense):
    monkeypatch.setattr(toxicity.ExampleIndex, "DENSE", dense)
    monkeypatch.setattr(toxicity.ExampleIndex, "TEXTS", 7)
    rng = random.Random(dense)
    terms = [f"t{i:03d}" for i in range(300)]
    often = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(terms, often, k=rng.randint(1, 30))) for _ in range(900)]
    index = toxicity.ExampleIndex({t: i for i, t in enumerate(terms)}, np.linspace(1, 4, 300), 0.2, 15)
    index.build([(i, i % 3 == 0, 1.0, t) for i, t in enumerate(texts)])
    assert len(index.dense) == min(dense, 301) and index.blocks > 5

    def wide(text):
        out = np.zeros(301)
        at, values = index.vector(text)
        out[at] = values
        return out

    matrix, toxic = np.array([wide(t) for t in texts]), np.arange(900) % 3 == 0
    asked = [*texts[:40], None, "", "other t001 words", *texts[:3]]
    found = index.scores(pa.array(asked))
    assert len(found) == len(asked) and found[-3:] == found[:3]
    for text, (score, evidence) in zip(asked, found):
        cosines = matrix @ wide(text)
        near = cosines >= np.sort(cosines)[-15] - 1e-9
        weights = 1 / (0.05 + np.maximum(0, 1 - cosines[near]))
        assert abs(score - ((weights * toxic[near]).sum() + 2 * 0.2) / (weights.sum() + 2)) < 1e-9
        assert abs(evidence[0][2] - min(1, cosines.max())) < 1e-9


def test_no_row_of_a_stored_index_is_large(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(f"{rng.getrandbits(80):020x}" for _ in range(100))) for i in range(1500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = toxicity.fit(frame, frame.selectExpr("doc_id", "int(doc_id % 2) as toxic"))
    sizes = [r[0] for r in spark.read.parquet(index.path).selectExpr("length(data)").collect()]
    assert max(sizes) <= 4 << 20 < sum(sizes)
    assert len(index.terms) == 150_000 and len(index.load().entries) == 1500


def plain_lm(train, test):
    order = lm.ORDER
    contexts = {}

    def coded(text):
        return bytes([lm.END]) * order + (text or "").translate(ASCII).encode() + b"\xff"

    for text in train:
        data = coded(text)
        for at in range(order, len(data)):
            for size in range(order + 1):
                own = contexts.setdefault((size, data[at - size : at]), Counter())
                own[data[at]] += 1

    def logs(text):
        data, total = coded(text), 0.0
        for at in range(order, len(data)):
            excluded = set()
            for size in range(order, -1, -1):
                own = contexts.get((size, data[at - size : at]), {})
                left = {s: n for s, n in own.items() if s not in excluded}
                room = sum(left.values()) + len(left)
                if data[at] in left:
                    total += math.log10(left[data[at]] / room)
                    break
                if left:
                    total += math.log10(len(left) / room)
                excluded |= own.keys()
            else:
                total -= math.log10(256 - len(excluded))
        return total

    return [logs(t) for t in test]


@needs_data
@pytest.mark.parametrize("entries", [8_000_000, 3000])
def test_lm(spark, entries):
    docs = [(r[0], r[1]) for r in rows("documents") if len(r[1]) < 3000][:60] + [(900, None), (901, "QUITE Other"), (901, "QUITE Other")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = lm.code_lengths(frame, train=queries.remainder("doc_id", 7) != 2, max_entries=entries).collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
    counts = Counter(w for k, t in docs if not held(k) for w in [*split(t), None])
    total = sum(counts.values())
    plain = plain_lm([t for k, t in docs if not held(k)], [t for _, t in docs])
    want = []
    for (key, text), score in zip(docs, plain):
        own = [*split(text), None]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        want.append((key, held(key), len(own), sum(counts[w] > 0 for w in own), total, base, score))
    for a, b in zip(sorted(map(tuple, got)), sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)
    assert len(got) == len(want)


def test_lm_passes_share_shards(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["ab", "bc", "Cab", "\u00e9t", str(rng.randrange(300))]) for _ in range(40))) for i in range(50)]
    frame = spark.createDataFrame(docs + docs[:3], "doc_id long, text string")
    train = queries.remainder("doc_id", 7) != 2
    want = sorted(map(tuple, lm.code_lengths(frame, train=train).collect()))
    seen, shards = [], lm._shards
    monkeypatch.setattr(lm, "_shards", lambda counts, entries: (seen.append(len(m.words)) or m for m in shards(counts, entries)))
    for most in (8_000_000, 300):
        seen.clear()
        got = sorted(map(tuple, lm.code_lengths(frame, train=train, max_entries=most, shard_entries=100).collect()))
        assert len(seen) > 3 and max(seen) < 200
        for a, b in zip(got, want, strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-12)


def test_lm_tables_are_narrow():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(200)) for _ in range(100)]
    keys, counts = np.unique(lm.gram_keys(*lm._joined(texts))[0], return_counts=True)
    pairs, inverse = np.unique(keys & np.uint64(0xFFFF), return_inverse=True)
    trie = lm.Trie(keys, counts, pairs, np.bincount(inverse, counts).astype(np.int64))
    size = sum(a.nbytes for level in trie.levels for a in level.values())
    entries = sum(len(level["n"]) + len(level["contexts"]) for level in trie.levels)
    assert size < 12 * entries


@pytest.mark.parametrize("grams", [True, False])
def test_shards_are_the_same_in_columns(spark, grams):
    keys = np.random.default_rng(3).integers(0, 2**64, 500, np.uint64)
    frame = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long")
    got = {r.key: r.shard for r in frame.select("key", lm._shard_column(grams, 7).alias("shard")).collect()}
    assert got == dict(zip(keys.view(np.int64).tolist(), lm.shard_of(keys, grams, 7).tolist()))
    assert set(got.values()) == set(range(7))


def test_adaptive_model_learns():
    assert lm.adaptive_bits("abcabcabc" * 20) < 0.5 * 8 * 180
    assert lm.adaptive_bits("") == pytest.approx(8)


def plain_classes(docs):
    """Components of the pairs at 0.8 or more, all pairs compared."""
    known = near_dup._WordHashes()
    slots = np.zeros(1 << near_dup.SLOTS)
    lists = [words(t) for _, t in docs]
    for own in lists:
        np.add.at(slots, (near_dup.shingles(own, known)[0] >> np.uint64(64 - near_dup.SLOTS)).astype(int), 1)
    idf = 1 + near_dup.DAMP * np.log1p(len(docs) / np.maximum(slots, 1)) / np.log1p(len(docs))
    vectors = [near_dup.weighted(own, known, idf) for own in lists]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if len(a[0]) and len(b[0]) and near_dup.weighted_jaccard(*a, *b) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(docs):
        least[find(i)] = min(key, least.get(find(i), key))
    return {key: least[find(i)] for i, (key, _) in enumerate(docs)}


@needs_data
def test_near_duplicates(spark):
    docs = [(r[0], r[1]) for r in rows("documents")]
    got = {r.doc_id: r.class_id for r in queries.op10(spark, SF).collect()}
    assert got == plain_classes(docs)


def test_planted_copies(spark):
    rng = random.Random(2)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = fresh(60)
    docs, want = [], {}
    for group in range(6):
        text = fresh(300)
        for copy in range(60 if group == 0 else 4):
            own = list(text)
            for at in rng.sample(range(300), 2 if copy else 0):
                own[at] = f"edit{group}x{copy}x{at}"
            docs.append((len(docs), " ".join(own)))
            want[len(docs) - 1] = len(docs) - 1 - copy
    for _ in range(80):  # different texts around one passage
        docs.append((len(docs), " ".join(fresh(100) + passage + fresh(100))))
        want[len(docs) - 1] = len(docs) - 1
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = near_dup.near_duplicates(frame).collect()
    assert {r.doc_id: r.class_id for r in found} == want
    assert {r.class_size for r in found} == {60, 4, 1}
    assert sorted(r.doc_id for r in near_dup.drop_near_duplicates(frame).collect()) == sorted(set(want.values()))


def test_rows_that_repeat_give_one_vector(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " more", " ".join(f"v{i}" for i in range(40))
    docs = [(1, text)] * 5000 + [(2, near)] * 3 + [(None, other)] * 2 + [(4, None), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    made, plain = [], near_dup._vectors
    monkeypatch.setattr(near_dup, "_vectors", lambda *a: made.append(plain(*a)) or made[-1])
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in near_dup.near_duplicates(frame).collect())
    assert got == {(1, 1, 5003): 5000, (2, 1, 5003): 3, (None, None, 2): 2, (4, 4, 1): 2}
    assert made[0].count() == made[0].select("node").distinct().count() == 2
    left = near_dup.drop_near_duplicates(frame).collect()
    assert Counter(tuple(r) for r in left) == {(1, text): 1, (None, other): 1, (4, None): 1}


def test_samples_follow_the_similarity():
    rng = np.random.default_rng(1)
    features = np.sort(rng.integers(0, 2**64, 300, np.uint64))
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    sampler = near_dup.Sampler(2000)
    one, two = (sampler(features, w, np.array([0]))[0] for w in (a, b))
    want = near_dup.weighted_jaccard(features, a, features, b)
    assert abs((one == two).mean() - want) < 0.05


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    edges = spark.createDataFrame([(str(a).zfill(4).encode(), str(b).zfill(4).encode()) for a, b in chain], "a binary, b binary")
    got = {int(bytes(r.node)): int(bytes(r.root)) for r in near_dup.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100}


@needs_data
def test_line_dedup_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = connection.execute(queries.LINE_DEDUP).fetchall()
    got = queries.op9(spark, SF)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_line_keys(spark):
    lines_ = ["\tShared LINE \r", "shared line", "ÉCOLE", "École", "école", "", "only here", "straße STRASSE", "STRASSE straße"]
    docs = [(i, "\n".join([lines_[i % len(lines_)], f"own {i}", "", "shared line" if i % 2 else "x"])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "a\n"), (102, "a\n")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    frame.createOrReplaceTempView("documents")
    connection = duckdb.connect()
    connection.execute("create table documents (doc_id bigint, text varchar)")
    connection.executemany("insert into documents values (?, ?)", docs)
    want = connection.execute(queries.LINE_DEDUP).fetchall()
    from marlstone.llm.lines import drop_common_lines

    got = drop_common_lines(frame).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_line_dedup_is_native(spark):
    from marlstone.llm.lines import drop_common_lines

    plan = drop_common_lines(odd.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
