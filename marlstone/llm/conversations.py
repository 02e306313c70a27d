"""Repair of the turn structure of conversations by alignment to the strings of an alternating grammar."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.common import keep

# Costs of the edits; a truncated turn that stays costs one more.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
# A turn as one byte: 3 * role + fault, roles s, u, a and others, faults none, cut off, to be deleted.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
INITIALS = "sua"
FAULTS = ("none", "truncated", "forced")
# Up to so many turns every target length has a table of its own.
LONG = 64
_FAR = 1 << 60


def targets(length: int) -> str:
    """The grammar's string of a length, as role initials: (ua)* or s(ua)+; none for a length of 1."""
    return ("s" if length % 2 else "") + "ua" * (length // 2)


def _bounded(flags: bytes, target: str, limit: int) -> tuple[int, str] | None:
    """Cost and ASCII-least audit of the alignment with one target, if it costs at most ``limit``.

    A suffix table: cost[i][j] aligns turns from i with the target from j. Only
    cells in Ukkonen's band are filled: those where forced deletions, and the
    surplus of turns or target characters before and after the cell, leave
    something of the limit.
    """
    m, n = len(flags), len(target)
    usable = [0]
    for f in flags:
        usable.append(usable[-1] + (f % 3 != 2))
    spare, drift = limit - DELETE * (m - usable[m]), n - usable[m]
    if spare < (INSERT * drift if drift > 0 else -DELETE * drift):
        return None
    both = INSERT + DELETE
    low, high = min(0, drift, -((spare - INSERT * drift) // both)), max(0, drift, (spare + DELETE * drift) // both)
    want = [INITIALS.index(c) for c in target]
    rows: list[tuple[int, list[int]]] = [(0, [])] * (m + 1)
    for i in range(m, -1, -1):
        start, stop = max(0, usable[i] + low), min(n, usable[i] + high)
        own = [_FAR] * (stop - start + 1)
        if i < m:
            role, fault = divmod(flags[i], 3)
            below, next_row = rows[i + 1]
            top = below + len(next_row)
        for j in range(stop, start - 1, -1):
            if i == m:
                best = 0 if j == n else _FAR
            else:
                best = next_row[j - below] + DELETE if below <= j < top else _FAR
                if fault < 2 and j < n and below <= j + 1 < top:
                    if role == want[j]:
                        best = min(best, next_row[j + 1 - below] + fault)
                    elif want[j] != SYSTEM:
                        best = min(best, next_row[j + 1 - below] + REROLE + fault)
            if j < stop and want[j] != SYSTEM:
                best = min(best, own[j + 1 - start] + INSERT)
            own[j - start] = best
        rows[i] = (start, own)

    def at(i: int, j: int) -> int:
        start, own = rows[i]
        return own[j - start] if start <= j < start + len(own) else _FAR

    total = at(0, 0)
    if total > limit:
        return None
    audit, i, j = [], 0, 0
    while i < m or j < n:
        now = at(i, j)
        role, fault = divmod(flags[i], 3) if i < m else (OTHER, 2)
        if i < m and now == at(i + 1, j) + DELETE:
            audit.append("D")
            i += 1
        elif j < n and want[j] != SYSTEM and now == at(i, j + 1) + INSERT:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if role == want[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


def _by_lengths(flags: bytes) -> tuple[int, str]:
    m = len(flags)
    # The first incumbents: delete all, or take the usable turns one by one.
    best = (DELETE * m, "D" * m)
    own = [f for f in flags if f % 3 != 2]
    pairs = zip(own, targets(len(own) // 2 * 2))
    straight = sum(f % 3 + REROLE * (f // 3 != INITIALS.index(c)) for f, c in pairs) + DELETE * (m - len(own))
    if len(own) % 2:
        straight += INSERT + own[-1] % 3 + REROLE * (own[-1] // 3 != USER)
    limit = min(best[0], straight)
    for length in sorted(range(2, 2 * m + 3), key=lambda n: abs(n - len(own))):
        if length % 2 and not any(f // 3 == SYSTEM for f in own):
            continue
        found = _bounded(flags, targets(length), limit)
        if found and found < best:
            best, limit = found, min(limit, found[0])
    return best


def _folded(flags: bytes) -> tuple[int, str]:
    """The same for conversations of any length.

    In the suffix table of the periodic target all columns of one parity lead to
    the same choices, so they are folded into one: nothing left, an odd rest, an
    even rest. A byte a turn holds what the least audit does next.
    """
    m = len(flags)
    none, odd, even = 0, INSERT, 2 * INSERT
    choices = bytearray(m + 1)
    choices[m] = 1 << 1 | 1 << 3 | 1  # insert, insert; after an assistant nothing follows
    lead = (_FAR, -1)
    for i in range(m - 1, -1, -1):
        role, fault = divmod(flags[i], 3)
        if fault < 2:
            if role == SYSTEM and DELETE * i + fault + even < lead[0]:
                lead = (DELETE * i + fault + even, i)
            after = min(none, even)
            step_odd = after + fault + REROLE * (role != ASSISTANT)
            step_even = odd + fault + REROLE * (role != USER)
        else:
            step_odd = step_even = _FAR
        new_none = none + DELETE
        plain_odd, plain_even = min(odd + DELETE, step_odd), min(even + DELETE, step_even)
        new_odd = min(plain_odd, min(new_none, plain_even) + INSERT)
        new_even = min(plain_even, plain_odd + INSERT)
        # 0 delete, 1 insert, 2 keep or rerole; whether nothing follows an assistant.
        if new_odd == odd + DELETE:
            for_odd, ends = 0, 0
        elif new_odd == min(new_none, new_even) + INSERT:
            for_odd, ends = 1, new_none <= new_even
        else:
            for_odd, ends = 2, none <= even
        if new_even == even + DELETE:
            for_even = 0
        elif new_even == new_odd + INSERT:
            for_even = 1
        else:
            for_even = 2
        choices[i] = for_odd << 1 | for_even << 3 | ends
        none, odd, even = new_none, new_odd, new_even

    def walk(i: int) -> str:
        """The audit of turns from i with an even rest of two or more."""
        audit, left = [], 2
        while i < m or left:
            if not left:
                audit.append("D" * (m - i))
                break
            choice = choices[i]
            what = choice >> (3 if left == 2 else 1) & 3
            if what == 0:
                audit.append("D")
                i += 1
                continue
            if what == 1:
                audit.append("I")
            else:
                audit.append("K" if flags[i] // 3 == (USER if left == 2 else ASSISTANT) else "R")
                i += 1
            left = 1 if left == 2 else 0 if choice & 1 else 2
        return "".join(audit)

    cost = min(none, even, lead[0])
    found = []
    if none == cost:
        found.append("D" * m)
    if even == cost:
        found.append(walk(0))
    if lead[0] == cost:
        found.append("D" * lead[1] + "K" + walk(lead[1] + 1))
    return cost, min(found)


def align(flags: bytes) -> tuple[int, str]:
    """Least cost and ASCII-least audit that makes the turns follow (s?(ua)+)?.

    Turns are aligned to each target length whose own lower bound is within the
    cost of the incumbent, in a table bounded by it; the backtraced audits of
    equal cost are compared. Conversations of more than ``LONG`` turns fold the
    columns of equal parity instead, which takes time and memory linear in them.
    """
    return _by_lengths(flags) if len(flags) <= LONG else _folded(flags)


class _Known(dict):
    def __missing__(self, flags: bytes) -> tuple[int, str]:
        if len(self) > 50_000:
            self.clear()
        found = align(flags)
        if len(flags) <= LONG:
            self[flags] = found
        return found


_WHITE = r"[\x20\x09-\x0D]"


def _ordered(turns: DataFrame, *first: str) -> DataFrame:
    """All turns of a conversation in one partition, in order; rows that differ in nothing are adjacent."""
    order = ["conv", *first, "turn", "role", "h1", "h2"]
    return turns.repartition("conv").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])


def audits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Of each conversation: its id, faults, least repair cost and audit.

    Columns: ``conv``, ``n_turns``, ``gaps`` (turn numbers missing between the
    first and the last), ``blank``, ``duplicate``, ``truncated`` (turns by their
    first fault), ``illegal`` (adjacent roles other than su, ua, au), ``cost``
    and ``audit``, a letter for each edit: K keep, R other role, D delete, I
    insert. The edits make role initials follow (s?(ua)+)?; blank and duplicate
    turns must go. Of equally cheap audits the ASCII-least counts.

    Turns are taken by number, null first; of equal numbers by role and hashes
    of the text. Null roles and texts are one space, hence blank or of no known
    role. Rows of a null id are one conversation. Repeated rows are duplicates.
    Conversations of any length work: a task reads them in order and holds one
    byte a turn. Other columns are ignored. An empty table gives an empty table.
    ``gaps`` is null where it would not fit a long.
    """
    kind, number = turns.schema[conv].dataType, turns.schema[turn].dataType
    said, own = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    bare = F.regexp_replace(said, _WHITE, "")
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        own.alias("role"),
        F.xxhash64(said).alias("h1"),
        F.xxhash64(F.lit(7919), said).alias("h2"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
    ).withColumn(
        "again",
        F.expr("row_number() over (partition by conv, role, h1, h2 order by turn nulls first) > 1"),
    )
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), 3).when(F.col("again"), 2).when(F.col("open"), 1).otherwise(0)
    rows = rows.select(
        "conv", "turn", "role", "h1", "h2", initial.alias("initial"), fault.cast("byte").alias("fault")
    )
    schema = pa.schema(
        [("conv", to_arrow_type(kind))]
        + [(c, pa.int64()) for c in ("n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [("audit", pa.string())]
    )
    whole = number.typeName() in ("byte", "short", "integer", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out, size = _Known(), [], 0
        code = {c: i for i, c in enumerate(INITIALS)}
        legal = {("s", "u"), ("u", "a"), ("a", "u")}
        open_conv: tuple | None = None
        flags, counts, illegal, before = bytearray(), [0] * 4, 0, None
        least = most = last = None
        different = 0

        def close() -> None:
            cost, audit = known[bytes(flags)]
            gaps = 0 if least is None else int(most) - int(least) + 1 - different
            gaps = gaps if abs(gaps) < 1 << 63 else None
            out.append([open_conv[0], len(flags), gaps, counts[3], counts[2], counts[1], illegal, cost, audit])

        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * len(schema)
            return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            values = [batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault")]
            for key, at, letter, wrong in zip(*values):
                if open_conv is None or key != open_conv[0]:
                    if open_conv is not None:
                        close()
                        size += len(flags)
                        if len(out) >= 5_000 or size > 4 << 20:
                            yield flush()
                            out, size = [], 0
                    open_conv = (key,)
                    flags, counts, illegal, before = bytearray(), [0] * 4, 0, None
                    least = most = last = None
                    different = 0
                flags.append(3 * code.get(letter, OTHER) + min(wrong, 2))
                counts[wrong] += 1
                if before is not None and (before, letter) not in legal:
                    illegal += 1
                before = letter
                if at is not None and whole:
                    least = at if least is None else least
                    different += at != last
                    most = last = at
        if open_conv is not None:
            close()
        yield flush()

    return _ordered(rows).select("conv", "turn", "initial", "fault").mapInArrow(
        run,
        f"conv {kind.simpleString()}, n_turns long, gaps long, blank long, duplicate long, truncated long,"
        " illegal long, cost long, audit string",
    )


def repaired(
    turns: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The turns that ``found``, of :func:`audits` over the same turns, makes of them.

    Columns: ``conv``, ``position`` from 0, ``role``, ``text``, ``turn`` (null
    for an inserted one) and ``edit``. Rows of a conversation are adjacent and
    in order in a partition. Conversations that lose all turns have no row.
    Nulls, ties, repeated rows and other columns are as in :func:`audits`.
    """
    kind, number = turns.schema[conv].dataType, turns.schema[turn].dataType
    said = F.coalesce(F.col(text), F.lit(" "))
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.lit(1).alias("part"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        said.alias("text"),
        F.xxhash64(said).alias("h1"),
        F.xxhash64(F.lit(7919), said).alias("h2"),
    )
    heads = found.select(
        "conv",
        F.lit(0).alias("part"),
        F.lit(None).cast(number).alias("turn"),
        F.lit(None).cast("string").alias("role"),
        F.col("audit").alias("text"),
        F.lit(None).cast("long").alias("h1"),
        F.lit(None).cast("long").alias("h2"),
    )
    schema = pa.schema(
        [("conv", to_arrow_type(kind)), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())]
        + [("turn", to_arrow_type(number)), ("edit", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, position, emitted = None, "", 0, 0, 0
        out: list[tuple] = []

        def inserted() -> None:
            nonlocal at, position, emitted
            while audit[at : at + 1] == "I":
                out.append((key, position, "assistant" if emitted % 2 else "user", "", None, "I"))
                at, position, emitted = at + 1, position + 1, emitted + 1

        for batch in batches:
            values = [batch.column(c).to_pylist() for c in ("conv", "part", "turn", "role", "text")]
            for conv_id, part, number_, own, words in zip(*values):
                if part == 0:
                    inserted()
                    key, audit, at, position, emitted = conv_id, words, 0, 0, 0
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "R":
                    own = "assistant" if emitted % 2 else "user"
                out.append((key, position, own, words, number_, edit))
                emitted += edit == "R" or position > 0 or own[:1] != "s"
                position += 1
            if out:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        inserted()
        columns = zip(*out) if out else [[]] * len(schema)
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    united = _ordered(rows.unionByName(heads), "part")
    return united.select("conv", "part", "turn", "role", "text").mapInArrow(
        run,
        f"conv {kind.simpleString()}, position long, role string, text string,"
        f" turn {number.simpleString()}, edit string",
    )


def digests(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines ``role:text`` of :func:`repaired`, joined by newlines, read as they stream by."""
    import hashlib

    kind = rows.schema["conv"].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None
        for batch in batches:
            ids, done = [], []
            values = [batch.column(c).to_pylist() for c in ("conv", "position", "role", "text")]
            for conv, position, role, text in zip(*values):
                if position == 0:
                    if state is not None:
                        ids.append(key)
                        done.append(state.hexdigest())
                    state, key = hashlib.sha256(), conv
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.record_batch([pa.array(ids, schema[0].type), pa.array(done, pa.string())], schema=schema)
        last = ([], []) if state is None else ([key], [state.hexdigest()])
        yield pa.record_batch([pa.array(last[0], schema[0].type), pa.array(last[1], pa.string())], schema=schema)

    return rows.select("conv", "position", "role", "text").mapInArrow(run, f"conv {kind.simpleString()}, sha256 string")


def repair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(:func:`audits`, kept in the shared folder; :func:`repaired`) of a table of turns."""
    found = keep(audits(turns, conv, turn, role, text))
    return found, repaired(turns, found, conv, turn, role, text)
