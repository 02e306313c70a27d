"""Near-duplicate and whitened vectors, repaired conversations: brute force, odd rows, the queries' SQL."""

import glob
import hashlib
import heapq
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import conversations, embed_dup, queries, whitening

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
EMPTY = hashlib.sha256(b"").hexdigest()


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    tables = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        tables.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    cursor = tables.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(tuple(map(repr, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(repr, r)) for r in frame.select(*columns).collect()) == want and want


# Conversations


def cheapest(flags):
    """Least (cost, audit) by a search over states of the grammar, without tables or lengths."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    queue, least, best = [(0, "", 0, "")], {}, None
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if best and cost > best[0]:
            return best
        if i == len(flags) and state in ("", "a"):
            best = min(best or (cost, audit), (cost, audit))
        if least.setdefault((i, state), cost) < cost or cost > 3 * len(flags):
            continue
        emitted = after[state]
        if i < len(flags):
            role, fault = divmod(flags[i], 3)
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state))
            if fault < 2:
                if "suax"[role] == emitted:
                    heapq.heappush(queue, (cost + fault, audit + "K", i + 1, emitted))
                heapq.heappush(queue, (cost + 2 + fault, audit + "R", i + 1, emitted))
                if state == "" and role == 0:
                    heapq.heappush(queue, (cost + fault, audit + "K", i + 1, "s"))
        heapq.heappush(queue, (cost + 2, audit + "I", i, emitted))
    return best


def test_align_is_cheapest_and_least():
    random.seed(5)
    for _ in range(1500):
        flags = bytes(random.choice([0, 1, 2, 3, 3, 3, 4, 5, 6, 6, 6, 7, 8, 9, 10]) for _ in range(random.randint(0, 7)))
        want = cheapest(flags)
        assert conversations._by_lengths(flags) == want, list(flags)
        assert conversations._folded(flags) == want, list(flags)


def test_folded_table_is_the_whole_one():
    random.seed(6)
    for _ in range(60):
        flags = bytes(random.choice([0, 3, 3, 3, 6, 6, 6, 4, 7, 9, 5, 8]) for _ in range(random.randint(20, 70)))
        assert conversations._by_lengths(flags) == conversations._folded(flags)


TURNS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 5, "user", "Cut"), (1, 5, "user", "Cut"),
    (2, 0, "system", "S."), (2, 1, None, "Null role."), (2, None, "user", "First."), (2, 3, "assistant", None),
    (None, 0, "assistant", "No id!"), (3, 0, "user", ""), (3, 1, "user", " \t\n"),
    (4, 2, "Odd", "x" * 300_000 + "."), (5, 0, "user", "A?"), (5, 1, "tool", "B!"), (5, 2, "user", "C."),
]


def turns(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("conv", "part", "h1", "audit", "fault", "position", "edit"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def test_odd_conversations(spark):
    found, rows = conversations.repair(turns(spark, TURNS))
    by_id = {r.conv: r for r in found.collect()}
    # id: turns, gaps, blank, duplicate, truncated, illegal, cost, audit
    want = {
        1: (4, 3, 0, 1, 1, 1, 6, "KKDD"),  # as cheap as KKKDI
        2: (4, 1, 1, 0, 0, 3, 8, "KDRD"),
        None: (1, 0, 0, 0, 0, 0, 2, "IK"),
        3: (2, 0, 2, 0, 0, 1, 6, "DD"),
        4: (1, 0, 0, 0, 0, 0, 3, "D"),
        5: (3, 0, 0, 0, 0, 2, 4, "KRKI"),
    }
    got = {k: (r.n_turns, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for k, r in by_id.items()}
    assert got == want
    kept = {}
    for r in rows.collect():
        kept.setdefault(r.conv, []).append((r.position, r.role, r.text, r.edit))
    assert kept[1] == [(0, "user", "Hi.", "K"), (1, "assistant", "Yes.", "K")]
    assert kept[None] == [(0, "user", "", "I"), (1, "assistant", "No id!", "K")]
    assert kept[5][1] == (1, "assistant", "B!", "R") and 3 not in kept and 4 not in kept
    digests = {r.conv: r.sha256 for r in conversations.digests(rows).collect()}
    assert digests[1] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert set(digests) == {1, 2, 5, None}
    none = conversations.repair(turns(spark, []))
    assert none[0].count() == none[1].count() == conversations.digests(none[1]).count() == 0


def test_one_conversation_has_most_rows(spark):
    rows = [(7, t, "user" if t % 2 == 0 or t % 11 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    found, kept = conversations.repair(turns(spark, rows + TURNS))
    row = found.where("conv = 7").first()
    flags = bytes(3 if r[2] == "user" else 6 for r in rows)
    assert (row.cost, row.audit) == conversations._folded(flags)
    roles = [r.role[0] for r in kept.where("conv = 7").orderBy("position").collect()]
    assert "".join(roles) == "ua" * (len(roles) // 2) and len(roles) >= 2900


# Near-duplicate vectors


def brute_links(rows, threshold=0.93):
    good = [
        (i, lab, np.array(v, float) / np.linalg.norm(np.array(v, float)))
        for i, (_, v, lab) in enumerate(rows)
        if lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
    ]
    links = {i: set() for i in range(len(rows))}
    for at, (i, lab, a) in enumerate(good):
        for j, other, b in good[:at]:
            if lab == other and len(a) == len(b) and float(a @ b) >= threshold:
                links[i].add(j)
                links[j].add(i)
    least = {}
    for i in links:
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least[i] = min(ids) if ids else None
    return sorted(((rows[i][0], len(links[i]), least[i]) for i in links), key=repr)


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("node", "k1", "id", "v", "copies", "n", "key", "past", "x", "component"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def planted(seed=3, dims=24):
    """A ball larger than a window, vectors on its rim, copies, loose pairs about the threshold, noise."""
    rng = np.random.default_rng(seed)

    def at(angle, centre):
        side = rng.standard_normal(dims)
        side -= side @ centre * centre
        return math.cos(angle) * centre + math.sin(angle) * side / np.linalg.norm(side)

    angle = math.acos(0.93)
    rows = []
    for label in (0, 1):
        centre = at(1.0, np.eye(dims)[label])
        rows += [(at(angle * rng.uniform(0.1, 0.45), centre), label) for _ in range(60)]
        rows += [(at(angle * rng.uniform(0.5, 1.6), centre), label) for _ in range(25)]
        rows += [(rng.standard_normal(dims), label) for _ in range(60)]
        for _ in range(12):
            one = rng.standard_normal(dims)
            rows += [(one, label), (at(angle * rng.uniform(0.5, 1.1), one / np.linalg.norm(one)), label)]
    rows += [rows[0]] * 5 + [(3 * rows[1][0], 0)]
    order = rng.permutation(len(rows))
    return [(int(k), rows[i][0].tolist(), rows[i][1]) for k, i in enumerate(order)]


@pytest.mark.parametrize("window", [24, 1000])
def test_links_are_those_of_all_pairs(spark, window):
    rows = planted()
    got = embed_dup.near_vectors(vectors(spark, rows), window=window).collect()
    assert sorted(map(tuple, got), key=repr) == brute_links(rows)


def test_odd_vectors(spark):
    one, inf, nan = [1.0, 2.0, 3.0], math.inf, math.nan
    rows = [
        (1, one, 0), (1, one, 0), (2, one, 1), (3, None, 0), (4, [], 0), (5, [1.0, None, 3.0], 0), (6, [inf, 1.0, 1.0], 0),
        (7, [nan, 1.0, 1.0], 0), (8, [0.0, -0.0, 0.0], 0), (9, one, None), (None, [2.0, 4.0, 6.0], 0), (None, None, None),
        (10, [1e300, 2e300, 3e300], 0), (11, [1e-300, 2e-300, 3e-300], 0), (12, [1.0, 2.0], 0), (0, [1.0, 2.0, 3.01], 1),
    ]
    got = {(r.vec_id, r.n_links, r.component_id) for r in embed_dup.near_vectors(vectors(spark, rows)).collect()}
    assert got == {
        (1, 4, 1), (2, 1, 0), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (None, 4, 1),
        (None, 0, None), (10, 4, 1), (11, 4, 1), (12, 0, 12), (0, 1, 0),
    }
    assert embed_dup.near_vectors(vectors(spark, [])).count() == 0


def test_many_repeated_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(5000)]
    got = embed_dup.near_vectors(vectors(spark, rows), window=16)
    assert got.where("n_links = 4999 and component_id = 0").count() == 5000


# Whitening


def check_whitened(got, rows, wanted):
    x = np.array([v for _, v in rows], object)
    n = len(x)
    sums = x.sum(axis=0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    found = {}
    for r in got:
        found.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(found) == list(range(1, wanted + 1))
    for k, own in found.items():
        want = centred @ axes[:, k - 1] / np.sqrt(values[k - 1])
        have = np.array([own[i].whitened for i, _ in rows])
        assert np.abs(have * np.sign(have @ want) - want).max() < 1e-9
        for (i, v), r in zip(rows, [own[i] for i, _ in rows]):
            exact = sum((n * a - s) ** 2 for a, s in zip(v, sums))
            assert r.n == n and r.deviation == (exact if exact < 1 << 63 else None)
            assert r.explained == pytest.approx(values[k - 1] / np.trace(cov), rel=1e-9) and r.identity_error < 1e-9


@pytest.mark.parametrize("dims,wanted", [(5, 5), (40, 32), (90, 32)])
def test_whitening_by_a_whole_covariance(spark, dims, wanted):
    rng = np.random.default_rng(dims)
    mixed = rng.standard_normal((300, dims)) @ rng.standard_normal((dims, dims))
    rows = [(i, [int(c) + 1_000_000 for c in np.floor(64 * v)]) for i, v in enumerate(mixed)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<long>").withColumn("x", F.lit("clash")).repartition(5)
    check_whitened(whitening.whiten(frame).collect(), rows, wanted)


def test_odd_points(spark):
    kind = "vec_id long, embedding array<long>"
    big = 1 << 61
    rows = [(1, [big, 5]), (2, [-big, 7]), (3, [0, 11])]
    other = [(9, None), (8, [1, None]), (7, [1, 2, 3]), (6, [])]
    got = whitening.whiten(spark.createDataFrame(rows + other, kind)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and {r.n for r in got} == {3}
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: (3 * 11 - 23) ** 2}
    twice = [(1, [1, 2]), (1, [1, 2]), (None, [3, 2])]
    got = whitening.whiten(spark.createDataFrame(twice, kind)).collect()
    assert [(r.component, round(abs(r.whitened), 9)) for r in sorted(got, key=lambda r: abs(r.whitened))] == [
        (1, round(math.sqrt(0.5), 9)), (1, round(math.sqrt(0.5), 9)), (1, round(math.sqrt(2), 9))
    ]
    for none in ([], other[:2], [(1, [4, 4])], [(i, [4, 4]) for i in range(3)]):
        assert whitening.whiten(spark.createDataFrame(none, kind)).count() == 0


def test_fixed_point(spark):
    frame = spark.createDataFrame([([0.5, -0.01, 1e300, -1e300],)], "v array<double>")
    got = frame.select(whitening.fixed_point(F.col("v"), 64, 1_000_000)).first()[0]
    assert got == [1_000_032, 999_999, (1 << 62) + 1_000_000, -(1 << 62) + 1_000_000]
