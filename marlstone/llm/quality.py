"""Weak supervision of document quality: rules vote, EM weighs the votes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.common import keep, utf8

# Frequent words of four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he this are or his from at which but have an had
    they you were their one all we can her has there been if more when will would who so no
    de la que el en y los del se las por un para con una su al lo como mas pero sus le ya o este
    les des et est du dans une qui il pas ce sur au plus par je avec tout mais nous ou si leur
    der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass
    sie nach wird bei einer um am sind noch wie einem einen so zum war haben nur oder aber vor zur bis
    """.encode().split()
)
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
WINDOW = 5
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64
)
FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_stop", "n_bare", "n_shouts", "n_upper", "n_letters",
)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in windows of five words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.uint64, len(words)) + np.uint64(1)
    hashes = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        hashes = (hashes ^ ids[j : j + n]) * _ODD[j]
        hashes ^= hashes >> np.uint64(29)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # Equal windows have equal hashes; only what looks repeated is compared word by word.
    at = np.flatnonzero(np.isin(hashes, twice)).tolist()
    own = ids.tolist()
    windows = [tuple(own[i : i + WINDOW]) for i in at]
    found = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(at, windows):
        if found[window] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def features(text: str | None) -> tuple[int, ...]:
    """The values named in FEATURES, of the whole text."""
    text = text or ""
    data = utf8(text)
    words = data.split()
    seen, dup_lines, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    distinct = Counter(words)
    stop = sum(n for w, n in distinct.items() if w in STOP_WORDS)
    bare = sum(n for w, n in distinct.items() if not w.strip(SYMBOLS))
    shouts = sum(n for w, n in distinct.items() if b"!" in w)
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, WHITE))),
        len(data) - len(data.translate(None, SYMBOLS)),
        dup_lines,
        repeated_words(words),
        lines,
        len(distinct),
        stop,
        bare,
        shouts,
        upper,
        upper + lower,
    )


def measured(docs: DataFrame, id: str, text: str) -> DataFrame:
    kind = docs.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([features(t) for t in batch.column(text).to_pylist()], np.int64)
            values = values.reshape(-1, len(FEATURES))
            yield pa.record_batch(
                [batch.column(id), *(pa.array(c) for c in values.T)],
                schema=pa.schema([(id, to_arrow_type(kind)), *((f, pa.int64()) for f in FEATURES)]),
            )

    schema = ", ".join(f"{f} long" for f in FEATURES)
    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind.simpleString()}, {schema}")


def rules() -> dict[str, Column]:
    """Votes by rule: 1 for good, -1 for bad, 0 to abstain. All thresholds are shares of the text."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    def share(part: str, of: str) -> Column:
        return F.col(part) / F.greatest(F.col(of), F.lit(1))

    n = F.col("n_words")
    mean = share("word_chars", "n_words")
    return {
        "length": vote(n >= 50, n < 10),
        "symbols": vote(share("n_symbols", "word_chars") < 0.01, share("n_symbols", "word_chars") > 0.05),
        "bare_symbols": vote(share("n_bare", "n_words") < 0.02, share("n_bare", "n_words") > 0.1),
        "shouts": vote(share("n_shouts", "n_words") < 0.05, share("n_shouts", "n_words") > 0.3),
        "upper_case": vote(share("n_upper", "n_letters") < 0.2, share("n_upper", "n_letters") > 0.5),
        "repeated_lines": vote(
            (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 2), share("n_dup_lines", "n_lines") > 0.3
        ),
        "repeated_windows": vote(share("n_repeat_words", "n_words") < 0.05, share("n_repeat_words", "n_words") > 0.2),
        "variety": vote(
            (n >= 20) & (share("n_distinct", "n_words") >= 0.3), (n >= 20) & (share("n_distinct", "n_words") < 0.15)
        ),
        "stop_words": vote((n >= 20) & (share("n_stop", "n_words") >= 0.1), (n >= 20) & (share("n_stop", "n_words") < 0.02)),
        "word_length": vote(mean.between(3, 12), (mean < 2) | (mean > 20)),
    }


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """EM over distinct vote patterns: prior of good, and P(vote | class) as (class, rule, vote + 1).

    Classes are bad (0) and good (1). The first round believes the majority of
    the votes; counts are smoothed by a pseudo document for each vote that
    takes the rule for right in nine of ten cases.
    """
    n_rules = votes.shape[1]
    pseudo = np.array([[0.9, 1.0, 0.1], [0.1, 1.0, 0.9]])[:, None, :].repeat(n_rules, 1)
    shown = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    lead = np.where((votes < 0).any(axis=1), votes.sum(axis=1) - 2 * (votes < 0).sum(axis=1), votes.sum(axis=1))
    good = 1 / (1 + np.exp(-lead.astype(float)))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        chances = np.einsum("cp,pjv->cjv", weight, shown) + pseudo
        chances /= chances.sum(axis=2, keepdims=True)
        logs = np.einsum("pjv,cjv->cp", shown, np.log(chances))
        margin = logs[1] - logs[0] + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        moved, good = np.abs(new - good).max(initial=0), new
        if moved < 1e-9:
            break
    return prior, chances


def weak_quality(docs: DataFrame, threshold: float = 0.5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: its id, the measured values, votes (map), ``p_good`` and ``good``.

    Every rule votes or abstains on every document. How often each rule votes
    how in good and in bad documents is estimated by expectation maximisation
    from the counts of vote patterns of all documents, of which there are at
    most 3 to the number of rules, whatever the input. ``p_good`` is the
    posterior probability of good, ``good`` says that it reaches ``threshold``.

    A null text is an empty one. Null and repeated ids get a row each. An empty
    table gives an empty table. Other columns are ignored.

    One pass measures the texts into a narrow table in the shared folder; the
    pattern counts merge on the map side, and nothing else is shuffled.
    """
    table = keep(measured(docs, id, text))
    votes = rules()
    patterns = table.groupBy(*[v.alias(k) for k, v in votes.items()]).count().toPandas()
    shown = patterns[list(votes)].to_numpy(np.int64).reshape(-1, len(votes))
    prior, chances = estimate(shown, patterns["count"].to_numpy(float))
    margin = F.lit(float(np.log(prior / (1 - prior))))
    for j, v in enumerate(votes.values()):
        bad, none, good = (float(np.log(chances[1, j, k] / chances[0, j, k])) for k in range(3))
        margin = margin + F.when(v == -1, bad).when(v == 1, good).otherwise(none)
    shown_votes = F.create_map(*[c for k, v in votes.items() for c in (F.lit(k), v)])
    p_good = 1 / (1 + F.exp(-margin))
    return table.select(id, *FEATURES, shown_votes.alias("votes"), p_good.alias("p_good")).withColumn(
        "good", F.col("p_good") >= threshold
    )
