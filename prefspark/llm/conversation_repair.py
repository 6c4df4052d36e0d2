"""Repair of conversations whose roles must alternate: the cheapest edits by iterative-deepening A*.

Roles must read ``(s?(ua)+)?`` (initials of system, user, assistant).  Edits of a row: Keep (0), Rerole to user or
assistant (1), Delete (2; the only one allowed for a blank or duplicate row); an empty-text user or assistant row may
be inserted anywhere (5).  A truncated row that stays adds 5.  Of the cheapest edit lists the one whose initials come
first in ASCII order is taken.

Search.  A node is (rows consumed, last role).  A depth-first search tries the edits in ASCII order (D, I, K, R) under
a cost bound; the bound starts at the heuristic (what the rows that are left cost at least) and rises to the least
value that exceeded it.  A transposition table of failed nodes keeps the budget that each needs at least.
Edits change the last role in one way only and a list that may end is shorter than any that goes on, so the
first accepting path under the bound that succeeds is the answer.

A long conversation is searched in blocks of ``BLOCK`` rows, last block first: the search of a block from each last
role ends in the costs that the blocks behind it need from there, so the answer is that of one whole search.

Spark's part.  Rows meet by conversation twice, sorted and streamed, never as a group: first narrow ones (ids, hashes,
one code a row; a window marks duplicates), of which the search keeps one byte a row; then the texts behind
their conversation's edits, which feed a running SHA-256.  Equal edit problems are searched once per task.

Defined results: null conv_id is one conversation of its own; null role and text are one space, nulls in the hashed key
too; rows of equal turn stand by role, then text hash; roles are known by their first letter, as it is
written (an empty role matches nothing); extra columns are ignored; an empty table gives no rows; gaps above the
largest long are that.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table_path
from .arrays import releasing

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK = 32
INF = 1 << 60
MAX_LONG = (1 << 63) - 1

#: a row's code: 4 * fault (0 none, 1 blank or duplicate, 2 truncated) + letter (0 s, 1 u, 2 a, 3 other)
LETTERS = "sua"
#: last role: 0 none yet, 1 system, 2 user, 3 assistant; the role that must follow
NEXT = (1, 1, 2, 1)
ROLE = ("system", "user", "assistant")
BLANKS = " \t\n\x0b\x0c\r"


def _keeps(letter: int, last: int) -> bool:
    """May a row of this letter follow?"""
    return letter == NEXT[last] or (letter == 0 and last == 0)


def _row_bound(code: int) -> int:
    """What a row costs at least."""
    fault, letter = divmod(code, 4)
    if fault:
        return DELETE
    return REROLE if letter == 3 else KEEP


@functools.lru_cache(maxsize=200_000)
def search(codes: bytes, last: int, behind: tuple[int, ...] | None) -> tuple[int, str, int]:
    """(cost, edits, last role) of the cheapest edits of a block of rows, entered with ``last``.

    ``behind``: the cost from each last role to the end; None when nothing follows (inserts may close the list).
    """
    n = len(codes)
    ends = behind if behind is not None else (0, INF, INF, 0)
    least = [0] * (n + 1)
    least[n] = min(behind) if behind is not None else 0
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + _row_bound(codes[i])
    need: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def lower(i: int, role: int) -> int:
        if i == n and (behind is not None or ends[role] == 0):
            return ends[role]
        return need.get((i, role), least[i])

    def walk(i: int, role: int, budget: int) -> int:
        """The last role of an accepting path within ``budget``, its edits in ``path``; or -1, with what the node needs noted."""
        if i == n and ends[role] <= budget:
            return role
        if lower(i, role) > budget:
            return -1
        moves = [("I", INSERT, i, NEXT[role] + 1)]
        if i < n:
            fault, letter = divmod(codes[i], 4)
            moves.insert(0, ("D", DELETE, i + 1, role))
            if fault != 1:
                extra = TRUNCATED if fault == 2 else 0
                if _keeps(letter, role):
                    moves.append(("K", KEEP + extra, i + 1, letter + 1))
                moves.append(("R", REROLE + extra, i + 1, NEXT[role] + 1))
        for name, cost, j, to in moves:
            if cost + lower(j, to) <= budget:
                path.append(name)
                end = walk(j, to, budget - cost)
                if end >= 0:
                    return end
                path.pop()
        need[(i, role)] = min(cost + lower(j, to) for _, cost, j, to in moves)
        return -1

    while True:
        bound = lower(0, last)
        end = walk(0, last, bound)
        if end >= 0:
            return bound, "".join(path), end


def cheapest(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """(cost, edits) of a conversation's row codes."""
    cuts = range(0, max(1, len(codes)), block)
    behind, found = None, []
    for a in reversed(cuts):
        found.append([search(codes[a: a + block], q, behind) for q in (range(4) if a else (0,))])
        behind = tuple(c for c, _, _ in found[-1])
    at, edits = 0, []
    for options in reversed(found):
        _, audit, at = options[at]
        edits.append(audit)
    return found[-1][0][0], "".join(edits)


def damage(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by ``crc32(conv_id:turn) % 20``; dropped ones are marked, not removed."""
    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conv.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       text_of("role").alias("role"), text_of("text").alias("text"))
    rows = rows.withColumn("kind", (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).cast("int"))
    text = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("kind") == 0).alias("gone"),
                       F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def mark(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, h2, seen, code), dealt by conversation: ``code`` is 4 * fault + letter, the fault 0 none, 1 blank, 2 duplicate, 3 truncated;
    -1 for rows that are gone.  A duplicate equals an earlier row of its conversation in role and text."""
    end = F.rtrim("text", F.lit(BLANKS))
    letter = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(LETTERS)], F.lit(3))
    rows = rows.select("conv_id", "turn", "role", F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "text").alias("h2"), "gone",
                       letter.alias("letter"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    same = Window.partitionBy("conv_id").orderBy("gone", "role", "h", "h2", F.col("turn").asc_nulls_first())
    before = F.lag(F.struct("gone", "role", "h", "h2")).over(same)
    seen = F.coalesce(before.eqNullSafe(F.struct("gone", "role", "h", "h2")), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(F.col("seen"), 2).when(F.col("cut"), 3).otherwise(0)
    return (rows.withColumn("seen", seen)
            .select("conv_id", "turn", "role", "h", "h2", "seen",
                    F.when(F.col("gone"), F.lit(-1)).otherwise(fault * 4 + F.col("letter")).cast("int").alias("code")))


_PLAN = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                   ("audit", pa.string())])
_PLAN_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: fault of the search by the fault of a row: blank and duplicate rows must go
_FAULT = bytes([0, 0, 0, 0, 4, 4, 4, 4, 4, 4, 4, 4, 8, 8, 8, 8])
_TO_SEARCH = bytes(_FAULT[c] + c % 4 for c in range(16))
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Conversation:
    """What the stream keeps of one conversation: a byte a row and a few numbers."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.low = self.high = None
        self.turns = 0

    def add(self, codes: np.ndarray, turns: np.ndarray, known: np.ndarray):
        """Rows in order of turn."""
        here = codes >= 0
        self.codes += codes[here].astype(np.uint8).tobytes()
        t = turns[here & known]
        if len(t):
            fresh = np.concatenate([[self.high is None or int(t[0]) != self.high], t[1:] != t[:-1]])
            self.turns += int(fresh.sum())
            self.low = int(t[0]) if self.low is None else self.low
            self.high = int(t[-1])

    def row(self) -> tuple:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, MAX_LONG)
        faults = np.bincount(codes >> 2, minlength=4).tolist()
        pairs = np.bincount((codes[:-1] & 3) * 4 + (codes[1:] & 3), minlength=16)
        legal = sum(int(pairs[4 * a + b]) for a, b in _LEGAL)
        cost, audit = cheapest(bytes(self.codes).translate(_TO_SEARCH.ljust(256, b"\0")))
        return (self.conv_id, gaps, faults[1], faults[2], faults[3], max(len(codes) - 1, 0) - legal, cost, audit)


def _emit(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _numpy(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return col.fill_null(0).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)


def _plans(batches):
    """Sorted narrow rows (conv_id, turn, code) -> one row a conversation."""
    now, out = None, []
    for b in batches:
        if not b.num_rows:
            continue
        (ids, some), (turns, known), (codes, _) = (_numpy(b.column(i)) for i in range(3))
        cut = np.flatnonzero((ids[1:] != ids[:-1]) | (some[1:] != some[:-1])) + 1
        for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)]):
            conv_id = int(ids[a]) if some[a] else None
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv_id)
            now.add(codes[a:e], turns[a:e], known[a:e])
        if len(out) >= 1000:
            yield _emit(out, _PLAN)
            out = []
    if now is not None:
        out.append(now.row())
    if out:
        yield _emit(out, _PLAN)


def plan(rows: DataFrame) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    # the window has dealt the rows by conversation: sorted anew, not exchanged
    return mark(rows).sortWithinPartitions(*_ORDER, "seen").select("conv_id", "turn", "code").mapInArrow(releasing(_plans), _PLAN_DDL)


#: rows of a conversation (ascending, nulls first)
_ORDER = ["conv_id", "turn", "role", "h", "h2"]


class _Repair:
    """A running SHA-256 of a conversation's repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        self.sha, self.rows = hashlib.sha256(), 0
        kept = len(audit) - audit.count("D")
        # an odd number of rows starts with the system row
        self.lead = kept % 2

    def put(self, role: str, text: str):
        self.sha.update(("\n" if self.rows else "").encode() + f"{role}:{text}".encode())
        self.rows += 1

    def expected(self) -> str:
        return ROLE[1 + (self.rows - self.lead) % 2]

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put(self.expected(), "")
            self.at += 1

    def row(self, role: str, text: str):
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.put(role, text)
        elif edit == "R":
            self.put(self.expected(), text)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


_OUT = pa.schema([*_PLAN, ("repaired_sha256", pa.string())])


def _hashes(batches):
    """Sorted rows (the columns of a plan, then is_row, role, text): a conversation's plan, then its rows."""
    now, key, out = None, None, []
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for *lead, is_row, role, text in zip(*cols):
            if is_row:
                now.row(role, text)
                continue
            if now is not None:
                out.append((*key, now.digest()))
            now, key = _Repair(lead[-1]), lead
        if len(out) >= 1000:
            yield _emit(out, _OUT)
            out = []
    if now is not None:
        out.append((*key, now.digest()))
    if out:
        yield _emit(out, _OUT)


def repair(conv: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of damaged conversations."""
    spark = conv.sparkSession
    rows = damage(conv)
    path = scratch_table_path(spark, f"repair-{uuid.uuid4().hex}")
    plan(rows).write.mode("overwrite").parquet(path)
    plans = spark.read.parquet(path)
    texts = rows.filter("not gone").select(
        "conv_id", "turn", "role", "text", F.lit(1).alias("is_row"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    both = plans.withColumn("is_row", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return (both.repartition("conv_id").sortWithinPartitions(_ORDER[0], "is_row", *_ORDER[1:])
            .select(*plans.columns, "is_row", "role", "text").mapInArrow(releasing(_hashes), _PLAN_DDL + ", repaired_sha256 string"))
