"""Toxicity from the nearest labelled examples, by an inverted index with block maxima."""

from __future__ import annotations

import os
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.common import WORD_BYTES, broadcast_within, give_back, keep, shared_dir, slices

# A term weighs idf * (PLAIN + chi-squared / 10); a term that tells nothing about toxicity has a chi-squared of about 1.
PLAIN = 0.2

_WORD_BYTES = np.frombuffer(WORD_BYTES, np.uint8)
# Characters beyond ASCII that str.split takes for spaces.
_WIDE_SPACE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)


def _word_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts, A-Z in lower case; then row, word number and count of each word of each text, in order.

    Words end where ``str.split`` ends them.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return texts, *[np.zeros(0, np.int64)] * 3
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = _WORD_BYTES[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends -= ends[0]
    if (data >= 128).any():
        data = np.frombuffer(_WIDE_SPACE.sub(lambda m: b" " * len(m[0]), data.tobytes()), np.uint8)
    inside = data != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    begins[edges] = inside[edges]
    begins = np.flatnonzero(begins)
    row = np.searchsorted(ends, begins, side="right") - 1
    # The words one after the other, without spaces.
    starts = np.append((np.cumsum(inside) - 1)[begins], inside.sum()).astype(np.int32)
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(starts), pa.py_buffer(data[inside]))
    words = found.dictionary_encode()
    many = max(1, len(words.dictionary))
    keys, times = np.unique(row * many + words.indices.to_numpy(), return_counts=True)
    return words.dictionary, keys // many, keys % many, times


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size, one range after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


@dataclass
class ExampleIndex:
    """Inverted index over the weighted TF-IDF vectors of labelled examples.

    Examples with equal vectors are one entry with their summed votes. Entries
    lie in blocks of ``BLOCK``. Of each term the index has its postings, cut at
    block borders, and its largest weight in each of its blocks; nothing is
    stored where a term doesn't occur. The terms of the most entries are rows of
    a dense matrix instead, of at most ``DENSE_BYTES``. Words outside ``terms``
    count as one common term, the last one, with the weight ``unseen`` for each
    of them.
    """

    terms: dict[str, int] | pa.Array
    weights: np.ndarray
    prior: float
    neighbours: int
    unseen: float = 1.0
    entries: list[tuple] = field(default_factory=list)
    BLOCK = 64
    DENSE = 512
    DENSE_BYTES = 16 << 20
    TEXTS = 64
    SOFT = 0.05

    def __post_init__(self) -> None:
        if isinstance(self.terms, dict):
            self.terms = pa.array(sorted(self.terms, key=self.terms.get), pa.string())

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, term numbers and weights of texts, in order; unit length, or nothing for a text without words."""
        words, row, at, times = _word_counts(texts)
        return self.vectors_of(len(texts), row, words, at, times)

    def vectors_of(
        self, many: int, row: np.ndarray, words: pa.Array, at: np.ndarray, times: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from rows, numbers in ``words`` and counts."""
        rest = len(self.terms)
        at = pc.fill_null(pc.index_in(words, value_set=self.terms), rest).to_numpy().astype(np.int64)[at]
        own = at < rest
        others = np.bincount(row[~own], np.square(times[~own]), many)
        extra = np.flatnonzero(others)
        row, at, times = row[own], at[own], times[own]
        order = np.argsort(row * (rest + 1) + at)
        row, at, times = row[order], at[order], times[order]
        # The common term is the last one of its row.
        last = np.searchsorted(row, extra, side="right")
        values = np.insert(times * self.weights[at], last, self.unseen * np.sqrt(others[extra]))
        row, at = np.insert(row, last, extra), np.insert(at, last, rest)
        return row, at, values / np.sqrt(np.bincount(row, values**2, many))[row]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of a text."""
        return self.vectors(pa.array([text], pa.string()))[1:]

    def build(self, examples: list[tuple]) -> ExampleIndex:
        """From (id, toxic, class weight, text)."""
        names = [e[:3] for e in examples]
        return self.build_of(names, *self.vectors(pa.array([e[3] for e in examples], pa.string())))

    def build_of(self, names: list[tuple], row: np.ndarray, at: np.ndarray, values: np.ndarray) -> ExampleIndex:
        """From (id, toxic, class weight) of each row and the rows' vectors."""
        groups: dict[tuple, list] = {}
        cuts = np.searchsorted(row, np.arange(len(names) + 1))
        for (name, toxic, weight), begin, end in zip(names, cuts, cuts[1:]):
            own, sizes = at[begin:end], values[begin:end]
            key = own.tobytes(), np.round(sizes, 9).tobytes()
            group = groups.setdefault(key, [own, sizes, 0, 0.0, 0.0, []])
            group[2] += 1
            group[3] += weight * toxic
            group[4] += weight
            group[5].append((name, toxic))
        # Entries with the same leading term lie together, so that blocks differ in their maxima.
        order = sorted(groups.values(), key=lambda g: (int(g[0][g[1].argmax()]) if len(g[0]) else -1, g[0].tolist(), g[1].tolist()))
        self.entries = [(g[2], g[3], g[4], sorted(g[5])[:3]) for g in order]
        self.blocks = max(1, -(-len(order) // self.BLOCK))
        term = np.concatenate([np.zeros(0, np.int64), *(g[0] for g in order)])
        entry = np.repeat(np.arange(len(order)), [len(g[0]) for g in order])
        value = np.concatenate([np.zeros(0), *(g[1] for g in order)])
        # Terms of the most entries; a term has its row in the matrix, or -1.
        spread = np.bincount(term, minlength=len(self.terms) + 1)
        rows = min(self.DENSE, self.DENSE_BYTES // (8 * max(1, len(order))), len(spread))
        top = np.argsort(-spread, kind="stable")[:rows]
        self.dense_row = np.full(len(spread), -1, np.int32)
        self.dense_row[top] = np.arange(rows)
        mine = self.dense_row[term]
        self.dense = np.zeros((rows, len(order)))
        self.dense[mine[mine >= 0], entry[mine >= 0]] = value[mine >= 0]
        term, entry, value = term[mine < 0], entry[mine < 0], value[mine < 0]
        sort = np.argsort(term, kind="stable")
        term, self.entry, self.value = term[sort], entry[sort].astype(np.int32), value[sort]
        # Postings of a term in a block are a run; of each term, the first of its runs.
        place = term * self.blocks + self.entry // self.BLOCK
        run = np.flatnonzero(np.diff(place, prepend=-1))
        self.run = np.append(run, len(place)).astype(np.int32)
        self.run_block = (place[run] % self.blocks).astype(np.int32)
        self.run_max = np.maximum.reduceat(self.value, run) if len(run) else np.zeros(0)
        self.first_run = np.searchsorted(term[run], np.arange(len(self.terms) + 2)).astype(np.int32)
        self.votes = np.array([(e[0], e[1], e[2]) for e in self.entries], np.float64).reshape(-1, 3)
        return self

    def _cosines(self, many: int, row: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of texts and entries, and a limit for each text; an entry below its text's limit may have less than its cosine.

        Products with the dense terms are a lower bound of all cosines, which
        gives the limit. Blocks whose bound (the largest of these products, plus
        the largest weights of the other terms) reaches it get the rest. No other
        block can hold a neighbour.
        """
        wide, size = self.dense_row[at], len(self.entries)
        query = np.zeros((many, len(self.dense)))
        query[row[wide >= 0], wide[wide >= 0]] = values[wide >= 0]
        cosines = query @ self.dense
        limits = self._least(cosines)
        row, at, values = row[wide < 0], at[wide < 0], values[wide < 0]
        begins = self.first_run[at]
        sizes = self.first_run[at + 1] - begins
        runs, row, values = _ranges(begins, sizes), np.repeat(row, sizes), np.repeat(values, sizes)
        place = row * self.blocks + self.run_block[runs]
        bounds = np.bincount(place, values * self.run_max[runs], many * self.blocks).reshape(many, self.blocks)
        if size:
            bounds = bounds + np.maximum.reduceat(cosines, np.arange(0, size, self.BLOCK), axis=1)
        wanted = (bounds >= limits[:, None] - 1e-9).ravel()[place]
        runs, row, values = runs[wanted], row[wanted], values[wanted]
        sizes = self.run[runs + 1] - self.run[runs]
        postings = _ranges(self.run[runs], sizes)
        cosines = cosines + np.bincount(
            np.repeat(row * size, sizes) + self.entry[postings], np.repeat(values, sizes) * self.value[postings], many * size
        ).reshape(many, size)
        return cosines, self._least(cosines)

    def _least(self, cosines: np.ndarray) -> np.ndarray:
        """Of each row, the cosine at the place of the last neighbour if every entry were one example; -1 if they are too few."""
        if cosines.shape[1] <= self.neighbours:
            return np.full(len(cosines), -1.0)
        return np.partition(cosines, -self.neighbours, axis=1)[:, -self.neighbours]

    def _kth(self, entries: np.ndarray, cosines: np.ndarray) -> float:
        """Cosine of the last neighbour among these entries, each as many as its examples; -1 if they are too few."""
        order = np.argsort(-cosines)
        enough = np.searchsorted(np.cumsum(self.votes[entries[order], 0]), self.neighbours)
        return float(cosines[order[enough]]) if enough < len(order) else -1.0

    def _vote(self, entries: np.ndarray, cosines: np.ndarray) -> tuple[float, list[tuple]]:
        """Score and evidence from the entries that can be neighbours of a text."""
        best = cosines >= self._kth(entries, cosines) - 1e-9
        entries, cosines = entries[best], cosines[best]
        order = np.lexsort((entries, -np.round(cosines, 9)))
        entries, cosines = entries[order], cosines[order]
        weights = 1 / (self.SOFT + np.maximum(0, 1 - cosines))
        every, toxic, both = self.votes[entries].T
        evidence = []
        for e, c in zip(entries[:3].tolist(), cosines[:3].tolist()):
            evidence += [(name, toxic_, min(1.0, c)) for name, toxic_ in self.entries[e][3]]
        # Neighbours that aren't there vote as the prior does, from nearby.
        unsure = 2 + max(0, self.neighbours - every.sum()) / self.SOFT
        return float(((weights * toxic).sum() + unsure * self.prior) / ((weights * both).sum() + unsure)), evidence[:3]

    def score(self, text: str | None) -> tuple[float, list[tuple]]:
        """Share of toxic votes weighted by nearness, smoothed by the prior, and the nearest examples."""
        return self.scores(pa.array([text], pa.string()))[0]

    def scores(self, texts: pa.Array) -> list[tuple[float, list[tuple]]]:
        """The same of each text; equal texts are scored once."""
        texts = pc.fill_null(texts, "").dictionary_encode()
        many = len(texts.dictionary)
        row, at, values = self.vectors(texts.dictionary)
        results = []
        for first in range(0, many, self.TEXTS):
            part = min(self.TEXTS, many - first)
            begin, end = np.searchsorted(row, [first, first + part])
            cosines, limits = self._cosines(part, row[begin:end] - first, at[begin:end], values[begin:end])
            text, entry = np.nonzero(cosines >= limits[:, None] - 1e-9)
            cuts = np.searchsorted(text, np.arange(part + 1))
            near = cosines[text, entry]
            results += [self._vote(entry[i:j], near[i:j]) for i, j in zip(cuts, cuts[1:])]
        return [results[i] for i in texts.indices.to_pylist()]


@dataclass(frozen=True)
class FittedIndex:
    """An :class:`ExampleIndex` in the shared folder. Tasks read it from there; it never passes the driver."""

    path: str

    def load(self) -> ExampleIndex:
        from pyarrow.dataset import dataset
        from pyarrow.fs import FileSystem

        system, place = FileSystem.from_uri(self.path)
        parts = dataset(place, filesystem=system, format="parquet").to_table().sort_by("part").column("data")
        state = pickle.loads(b"".join(p.as_buffer() for p in parts))
        del parts
        give_back()
        index = ExampleIndex(state["terms"], state["weights"], state["prior"], state["neighbours"])
        vars(index).update(state)
        return index

    @property
    def terms(self) -> pa.Array:
        return self.load().terms

    def release(self) -> None:
        """Delete the files, when all that used them is written."""
        from pyarrow.fs import FileSystem

        system, place = FileSystem.from_uri(self.path)
        system.delete_dir(place)


def _term_counts(docs: DataFrame, text: str, most: int = 300_000) -> DataFrame:
    """(term, docs, toxic, clean), several rows a term: documents with the term, and of these the labelled ones."""
    names = ["docs", "toxic", "clean"]

    def summed(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by("term").aggregate([(n, "sum") for n in names])
        return sums.select(["term", *(f"{n}_sum" for n in names)]).rename_columns(["term", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in slices(batches, text):
            words, row, at, _ = _word_counts(batch.column(text))
            toxic = pc.fill_null(batch.column("toxic"), -1).to_numpy()[row]
            counts = [np.bincount(own, minlength=len(words)) for own in (at, at[toxic == 1], at[toxic == 0])]
            held.append(pa.table([words, *map(pa.array, counts)], ["term", *names]))
            if sum(map(len, held)) > most:
                held = [summed(held)]
                if len(held[0]) > most // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()
        held.clear()
        give_back()

    return docs.select(text, "toxic").mapInArrow(run, "term string, docs long, toxic long, clean long")


def _bags(examples: DataFrame) -> DataFrame:
    """Examples (id, toxic, share, text) with their distinct words and how often each occurs, in place of the text."""
    kind = examples.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, row, at, times = _word_counts(batch.column("text"))
            cuts = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, c) for c in (words.take(pa.array(at)), pa.array(times))]
            columns = [batch.column(c) for c in ("id", "toxic", "share")]
            yield pa.record_batch([*columns, *lists], ["id", "toxic", "share", "words", "times"])

    return examples.mapInArrow(
        run, f"id {kind.simpleString()}, toxic int, share double, words array<string>, times array<long>"
    )


def _built(bags: DataFrame, chosen: DataFrame, part: int = 4 << 20, **settings) -> DataFrame:
    """The pickled index in parts: a task gets the bounded examples and their terms, which are no more than their words."""

    def run(examples: pa.Table, terms: pa.Table) -> pa.Table:
        terms = terms.sort_by("term").combine_chunks()
        examples = examples.sort_by("id").combine_chunks()
        names, weights = (terms.column(c).combine_chunks() for c in ("term", "weight"))
        index = ExampleIndex(terms=names, weights=weights.to_numpy(), **settings)
        lists, times = (examples.column(c).combine_chunks() for c in ("words", "times"))
        sizes = pc.list_value_length(lists).to_numpy()
        words = lists.flatten().dictionary_encode()
        row, at = np.repeat(np.arange(len(sizes)), sizes), words.indices.to_numpy()
        vectors = index.vectors_of(len(sizes), row, words.dictionary, at, times.flatten().to_numpy())
        index.build_of(list(zip(*(examples.column(c).to_pylist() for c in ("id", "toxic", "share")))), *vectors)
        data = pickle.dumps(vars(index), protocol=5)
        del examples, terms, lists, times, words, row, at, vectors, index
        give_back()
        return _parts(data, part)

    one = lambda frame: frame.withColumn("all", F.lit(0)).groupBy("all")
    return one(bags).cogroup(one(chosen)).applyInArrow(run, "part int, data binary")


def _parts(data: bytes, size: int) -> pa.Table:
    cuts = range(0, len(data), size)
    return pa.table({"part": pa.array(range(len(cuts)), pa.int32()), "data": pa.array([data[i : i + size] for i in cuts], pa.binary())})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column | None = None,
    max_examples: int = 4096,
    neighbours: int = 15,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> FittedIndex:
    """Index of labelled examples.

    ``labels`` has ``id`` and ``label`` (0 or 1; others and nulls are no label;
    of repeated ids the larger label holds). ``train`` is a condition on
    ``labels`` that says which rows may be learned from.

    Examples are a bounded sample: per class the ``max_examples`` / 2 documents
    with the smallest hashed ids, one row of each id, with votes in proportion
    to the size of their class. All their words are terms. A term weighs log(1 + N / d), d of all N
    documents having it, times 0.2 plus a tenth of its chi-squared for toxic
    against clean, over all labelled documents learned from: without the latter
    the many words that tell nothing hide those that do. A word that no example
    has matches nothing and counts in a text's length only, with the root mean
    square weight of all such words over the corpus.
    """
    mine = labels.where(train) if train is not None else labels
    known = keep(
        mine.where(F.col(id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(id).alias("id"))
        .agg(F.max(label).cast("int").alias("toxic"))
    )
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    present = keep(texts.select("id").distinct().join(known, "id"))
    sizes = {r["toxic"]: r["n"] for r in present.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean, total = sizes.get(1, 0), sizes.get(0, 0), docs.count()
    both, most = n_toxic + n_clean, max_examples // 2
    bags = None
    for value, size in sorted(sizes.items()):
        own = present.where(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        # One row of each id, so that a repeated id brings no more than its text with the smallest hash.
        one = F.min(F.struct(F.xxhash64("text"), "text")).alias("one")
        taken = texts.join(F.broadcast(own), "id").groupBy("id", "toxic").agg(one)
        taken = taken.select("id", "toxic", F.lit(size / min(size, most)).alias("share"), "one.text")
        bags = taken if bags is None else bags.unionByName(taken)
    if bags is None:
        bags = texts.limit(0).select("id", F.lit(0).alias("toxic"), F.lit(0.0).alias("share"), "text")
    bags = keep(_bags(bags))
    labelled = texts.join(broadcast_within(known, 300_000), "id", "left")
    none = F.lit(0).cast("long")
    used = bags.select(F.explode("words").alias("term")).distinct()
    used = used.select("term", *[none.alias(c) for c in ("docs", "toxic", "clean")], F.lit(True).alias("used"))
    counts = _term_counts(labelled, "text").withColumn("used", F.lit(False)).unionByName(used)
    counts = keep(
        counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("docs", "toxic", "clean")], F.max("used").alias("used"))
    )
    seen = F.col("toxic") + F.col("clean")
    expected = seen * (n_toxic / max(both, 1))
    rest = seen - expected
    gap = F.col("toxic") - expected
    chi2 = F.when((expected > 0) & (rest > 0), gap * gap / expected + gap * gap / rest).otherwise(0.0)
    weighed = counts.withColumn("weight", F.log1p(F.lit(float(total)) / F.col("docs")) * (PLAIN + chi2 / 10))
    others = weighed.where(~F.col("used"))
    unseen = others.agg(F.sqrt(F.sum(F.col("docs") * F.col("weight") ** 2) / F.sum("docs"))).first()[0]
    settings = {"prior": (n_toxic + 1) / (both + 10), "neighbours": neighbours, "unseen": unseen or 1.0}
    path = f"{shared_dir(docs.sparkSession)}/examples-{os.urandom(8).hex()}"
    if n_toxic + n_clean:
        keep(_built(bags, weighed.where("used").select("term", "weight"), **settings), path)
    else:
        data = pickle.dumps(vars(ExampleIndex({}, np.zeros(0), **settings).build([])))
        keep(docs.sparkSession.createDataFrame([(0, data)], "part int, data binary"), path)
    return FittedIndex(path)


def toxicity(docs: DataFrame, index: FittedIndex, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, plus ``toxicity`` (0 to 1) and ``evidence``.

    The score is the share of toxic votes among the nearest examples by exact
    cosine of TF-IDF vectors, weighted as :func:`fit` says, all ties of the last one included, each weighted by
    1 / (0.05 + 1 - cosine), smoothed by the prior. ``evidence`` has up to three
    nearest examples (id, toxic, cosine). Blocks of examples whose bound stays
    below the last neighbour's cosine are not visited; the result is the same.

    A null or empty text is scored like any text that shares no word with an
    example: all examples vote alike. Without labels every score is the prior, a
    tenth; a few labels cannot make every text toxic. Columns with the two new names are replaced. An empty table gives
    an empty table. Tasks read the index, bounded by its parameters, from the
    shared folder; nothing is shuffled.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("toxicity", "evidence")]
    name_type = docs.schema[id].dataType
    evidence = pa.list_(
        pa.struct([("example", to_arrow_type(name_type)), ("toxic", pa.int32()), ("cosine", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.load()
        for batch in slices(batches, text):
            found = own.scores(batch.column(text))
            shown = [[{"example": e, "toxic": t, "cosine": c} for e, t, c in near] for _, near in found]
            columns = [batch.column(f.name) for f in kept]
            yield pa.record_batch(
                [*columns, pa.array([s for s, _ in found], pa.float64()), pa.array(shown, evidence)],
                [*(f.name for f in kept), "toxicity", "evidence"],
            )
        del own
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[f.name for f in kept]).mapInArrow(
        run,
        f"{schema}, toxicity double,"
        f" evidence array<struct<example:{name_type.simpleString()},toxic:int,cosine:double>>",
    )
