"""Conversation structure repair by Wagner-Fischer target alignment.

The turns of a conversation are aligned to the strings of the grammar
``(s?(ua)+)?`` (roles by their initials) with the edits keep (0), re-role to
user or assistant (1), delete (2) and insert an empty turn (5); a turn cut off
in the middle costs 5 more unless deleted, a blank or repeated one can only be
deleted.  Every feasible length is a target of its own: the alternating string
of each length ends in the same ``...uaua``, so one table over suffixes, row i
by "j symbols are left", holds the alignments to all of them.

The table is banded after Ukkonen.  At row i the cheapest cell is the incumbent
for the rows that are left: one insertion turns it to the other phase, two more
give the pair that a system turn asks for, so a cell dearer than the incumbent by
more than ``SLACK`` lies on no cheapest alignment of any length.  The
alignments of all lengths of least cost are traced side by side from the first
turn on; where their audits part, the ASCII-least goes on.

A conversation of any size streams through its task.  Alignments of equal cost
may differ in length, so rows would slowly widen; after ``BLOCK`` turns a row is
folded to what the turns before it depend on, the least cost for each next role,
and unfolded to the same cells when it is traced.  So time grows with the turns,
one byte a turn is held for the alignment, rows of the table for one block at a
time, and texts are never held: a second pass applies the audits to turns as
they come.

Defined results: a null conv_id is a conversation of its own; null role or text
is read as one space; turns are taken by number (null first), ties by role and
text; equal rows are repeats of each other; a conversation without rows has
zeros and an empty audit; roles that begin with other letters than s, u and a
fit no place unless re-roled; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: An insertion to change phase, and two for the pair after a system turn.
SLACK = 3 * INSERT
BLOCK = 1_024
FAR = 1 << 60

SPACES = " \t\n\x0b\x0c\r"
INITIALS = "sua"
#: A turn in one byte: number of its initial (3: another), and what is wrong with it.
BLANK, DUPLICATE, CUT = 4, 8, 16
LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLE = ("user", "assistant")
ARROW_BYTES = 1 << 20


def damaged(conversations: DataFrame) -> DataFrame:
    """The test bed: turns damaged by a hash of their place; conv_id, turn, role, text."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _place() -> Column:
    """Turn numbers in order, null first; as a struct also for minima."""
    return F.struct(F.col("turn").isNotNull(), F.col("turn"))


def _streamed(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Each conversation in one partition: its head row first (marked by ``head``), then its turns in order."""
    both = heads.withColumn("head", F.lit(True)).unionByName(rows.withColumn("head", F.lit(False)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "text")


def audit_conversations(conversations: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """conv_id, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit; one row per conv_id of ``of`` (or of the table itself)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    digest = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))
    rows = rows.withColumn("digest", digest)
    # one row per distinct turn of a conversation finds later repeats; repeats of one number are neighbours in the stream
    firsts = rows.groupBy(F.col("conv_id").alias("f_conv"), F.col("digest").alias("f_digest")).agg(F.min(_place()).alias("first"))
    ends = F.rtrim("text", F.lit(SPACES))
    initial = F.coalesce(*(F.when(F.substring("role", 1, 1) == c, k) for k, c in enumerate(INITIALS)), F.lit(3))
    fault = F.when(ends == "", BLANK).when(_place() > F.col("first"), DUPLICATE).when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("digest") == F.col("f_digest")))
    rows = rows.select("conv_id", "turn", "role", "text", "digest", (initial + fault).cast("int").alias("code"))
    heads = (conversations if of is None else of).select("conv_id").distinct()
    kind = dict(conversations.dtypes)["conv_id"]

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(kind)
        turns: _Turns | None = None
        for batch in batches:
            for conv, head, turn, digest, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "turn", "digest", "code"))):
                if head:
                    if turns is not None:
                        yield from out.put(turns.conv, *turns.audited())
                    turns = _Turns(conv)
                else:
                    turns.add(turn, digest, code)
        if turns is not None:
            yield from out.put(turns.conv, *turns.audited())
        yield from out.rest()

    return (_streamed(rows, heads).select("conv_id", "head", "turn", "digest", "code")
            .mapInArrow(audit, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _Rows.COUNTS) + ", audit string"))


class _Rows:
    """Audit rows on their way out, in batches of bounded size."""

    COUNTS = ("n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def __init__(self, kind: str):
        self.kind, self.rows, self.size = kind, [], 0

    def put(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += len(row[-1]) + 64
        if self.size > ARROW_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*self.rows)], names=["conv_id", *self.COUNTS, "audit"])
        self.rows, self.size = [], 0


class _Turns:
    """What the alignment needs of one conversation: a byte per turn, and running counts."""

    def __init__(self, conv):
        self.conv, self.codes = conv, bytearray()
        self.low = self.high = self.last = None
        self.numbers = self.illegal = 0

    def add(self, turn, digest: str, code: int) -> None:
        if self.last == (turn, digest) and not code & BLANK:
            code = code & 3 | DUPLICATE
        if turn is not None and (self.last is None or self.last[0] != turn):
            self.numbers += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.codes and (self.codes[-1] & 3, code & 3) not in LEGAL:
            self.illegal += 1
        self.last = (turn, digest)
        self.codes.append(code)

    def audited(self) -> tuple:
        count = [sum(1 for c in self.codes if c & kind) for kind in (BLANK, DUPLICATE, CUT)]
        gaps = self.high - self.low + 1 - self.numbers if self.numbers else 0
        return len(self.codes), gaps, *count, self.illegal, *align(bytes(self.codes))


def _emit(code: int, symbol: int) -> int:
    """Cost of a turn in the place of ``symbol`` (a number of INITIALS)."""
    if code & (BLANK | DUPLICATE):
        return FAR
    return (0 if code & 3 == symbol else REROLE) + (TRUNCATED if code & CUT else 0)


EMIT = [(_emit(c, 1), _emit(c, 2)) for c in range(32)]

#: Row i of the table: first j, costs of j, j + 1, ...; and, for targets whose system turn is still to come, costs by j.
Row = tuple[int, list[int], dict[int, int]]


def _last_row() -> Row:
    return 0, [INSERT * j for j in range(SLACK // INSERT + 1)], {}


def _row_before(code: int, after: Row) -> Row:
    """The table's row of a turn, from the row of the next turn."""
    low, costs, starts = after
    as_user, as_assistant = EMIT[code]
    width = len(costs)
    row, left, best = [], FAR, FAR
    for k in range(width + SLACK // INSERT + 1):
        cost = costs[k] + DELETE if k < width else FAR
        if 0 < k <= width:
            cost = min(cost, costs[k - 1] + (as_assistant if low + k & 1 else as_user))
        cost = left = min(cost, left + INSERT)
        best = min(best, cost)
        row.append(cost)
    while row[-1] > best + SLACK:
        row.pop()
    skip = next(k for k, cost in enumerate(row) if cost <= best + SLACK)
    waiting = {j: cost + DELETE for j, cost in starts.items() if cost + DELETE <= best + SLACK}
    if code & 3 == 0 and not code & (BLANK | DUPLICATE):
        keep = TRUNCATED if code & CUT else 0
        for j in range(max(low + low % 2, 2), low + width, 2):
            cost = costs[j - low] + keep
            if cost <= best + SLACK and cost < waiting.get(j, FAR):
                waiting[j] = cost
    return low + skip, row[skip:], waiting


def _cell(row: Row, j: int) -> int:
    return row[1][j - row[0]] if 0 <= j - row[0] < len(row[1]) else FAR


def _traced(code: int, row: Row, after: Row, j: int, waits: bool) -> tuple[str, int, bool]:
    """The ASCII-least edits of one turn (insertions before it included) on a cheapest alignment, and where it goes on."""
    if waits:
        if after[2].get(j, FAR) + DELETE == row[2][j]:
            return "D", j, True
        return "K", j, False
    edits = ""
    while True:
        cost = _cell(row, j)
        if _cell(after, j) + DELETE == cost:
            return edits + "D", j, False
        if _cell(row, j - 1) + INSERT == cost:
            edits, j = edits + "I", j - 1
            continue
        return edits + ("K" if code & 3 == (2 if j & 1 else 1) else "R"), j - 1, False


def _folded(row: Row) -> Row:
    """What the block before needs of a row: the least cost with a user turn next (0), an assistant turn next (1), and a user turn next that must come (2)."""
    low, costs, starts = row
    least = [min((c for k, c in enumerate(costs, low) if k >= first and k % 2 == first % 2), default=FAR) for first in (0, 1, 2)]
    return 0, least, {2: min(starts.values())} if starts else {}


def _unfolded(row: Row, lengths: set[tuple[int, bool]]) -> set[tuple[int, bool]]:
    """The cells of a row that folded cells stand for."""
    low, costs, starts = row
    _, least, waiting = _folded(row)
    return {(k, False) for j, waits in lengths if not waits for k, c in enumerate(costs, low) if c == least[j] and k >= j and k % 2 == j % 2} | {
        (k, True) for _, waits in lengths if waits for k, c in starts.items() if c == waiting[2]}


def align(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Least cost of any target and the ASCII-least of its audits."""
    starts = range(0, max(len(codes), 1), block)
    after = {starts[-1]: _last_row()}
    table: list[Row] = []
    for start in reversed(starts):
        table = _table(codes[start:start + block], after[start])
        after[start - block] = _folded(table[0])
    low, costs, waiting = table[0]
    plain = {j: c for j, c in enumerate(costs, low) if j % 2 == 0}
    best = min([*plain.values(), *waiting.values()])
    lengths = {(j, False) for j, c in plain.items() if c == best} | {(j, True) for j, c in waiting.items() if c == best}
    audit = []
    for start in starts:
        if start:
            table = _table(codes[start:start + block], after[start])
            lengths = _unfolded(table[0], lengths)
        for code, row, later in zip(codes[start:start + block], table, table[1:]):
            traced = [_traced(code, row, later, j, waits) for j, waits in lengths]
            least = min(t[0] for t in traced)
            lengths = {t[1:] for t in traced if t[0] == least}
            audit.append(least)
    audit.append("I" * min(j for j, _ in lengths))
    return best, "".join(audit)


def _table(codes: bytes, after: Row) -> list[Row]:
    rows = [after]
    for code in reversed(codes):
        rows.append(_row_before(code, rows[-1]))
    return rows[::-1]


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, None, None) before each conversation, then its repaired turns (conv, role, text)."""
    audit, at, given, system, conv = "", 0, 0, False, None

    def inserted():
        return ROLE[(given - system) % 2], ""

    for batch in batches:
        for new, head, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "audit", "role", "text"))):
            if head:
                for _ in range(at, len(audit)):  # insertions after the last turn
                    yield conv, *inserted()
                    given += 1
                audit, at, given, system, conv = edits, 0, 0, False, new
                yield conv, None, None
                continue
            while audit[at] == "I":
                yield conv, *inserted()
                at, given = at + 1, given + 1
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "K" and not given and role[:1] == INITIALS[0]:
                system = True
                yield conv, role, text
            else:
                yield conv, role if edit == "K" else inserted()[0], text
            given += 1
    for _ in range(at, len(audit)):
        yield conv, *inserted()
        given += 1


def _with_audits(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return _streamed(rows, audits.select("conv_id", "audit")).select("conv_id", "head", "audit", "role", "text")


def repaired_turns(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text of the repaired conversations."""
    kind = dict(conversations.dtypes)["conv_id"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, position = [], 0, 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["conv_id", "position", "role", "text"])

        for conv, role, text in _applied(batches):
            if role is None:
                position = 0
                continue
            rows.append((conv, position, role, text))
            position, size = position + 1, size + len(text) + 64
            if size > ARROW_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return _with_audits(conversations, audits).mapInArrow(apply, f"conv_id {kind}, position long, role string, text string")


def repaired_hashes(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, n_repaired, repaired_sha256 (of ``role:text`` lines); texts are hashed as they stream by."""
    kind = dict(conversations.dtypes)["conv_id"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hashed, n, current = [], None, 0, None

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["conv_id", "n_repaired", "repaired_sha256"])

        for conv, role, text in _applied(batches):
            if role is None:
                if hashed is not None:
                    rows.append((current, n, hashed.hexdigest()))
                    if len(rows) == 5_000:
                        yield batch()
                        rows = []
                hashed, n, current = hashlib.sha256(), 0, conv
                continue
            hashed.update((("\n" if n else "") + role + ":").encode())
            hashed.update(text.encode())
            n += 1
        if hashed is not None:
            rows.append((current, n, hashed.hexdigest()))
        if rows:
            yield batch()

    return _with_audits(conversations, audits).mapInArrow(apply, f"conv_id {kind}, n_repaired long, repaired_sha256 string")


def audit_and_hash(conversations: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """The columns of ``audit_conversations`` with n_repaired and repaired_sha256."""
    audits = stored(audit_conversations(conversations, of), "audits")
    hashes = repaired_hashes(conversations, audits).withColumnRenamed("conv_id", "h_conv")
    return audits.join(hashes, F.col("conv_id").eqNullSafe(F.col("h_conv"))).drop("h_conv")
