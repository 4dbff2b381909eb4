"""Conversation structure repair by a parallel Viterbi search with rank convergence.

A conversation should read as ``(system)? (user assistant)+``, or be empty. Edits make it so at the least cost: keep a row (0), give it the role
that fits (2), delete it (3; blank and repeated rows must go), insert an empty one (2); a truncated row that stays costs 1 more.
That is a shortest path through four states: nothing yet, after system, after user, after assistant.

Rows are sorted over the whole table and cut into chunks of bounded size, so a long conversation spans tasks. Each
chunk runs backwards from speculative cost vectors, one per state in which it may end, that make up its
cost matrix. Where all vectors that can follow lead to the same one but for a constant, the chunk has converged and its
vector stands whatever follows. A fix-up pass goes over the chunks' matrices, last chunk first: it keeps the
vectors of converged chunks and reruns the others from the vector of the chunk behind. With its stitched vector behind it
each chunk is traced forwards, taking the ASCII-least edit that lies on a cheapest path.

The audit and the digest of a conversation are sequences, so the last pass streams the chunks of a
conversation through one task, a chunk at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.plans.workspace import stored

CHUNK_ROWS, CHUNK_CHARS = 256, 1 << 20  # a chunk is closed once it holds either
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a user or assistant row that fits a state, and that role.
NEXT = [USER, USER, ASSISTANT, USER]
FITTING = ["user", "user", "assistant", "user"]
#: Rows kept as they are: (initial of the role, state before) -> state after.
KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 40
FINE, BLANK, DUPLICATE, CUT = range(4)  # first faults of a row
ABSENT = -1  # a row that only tells that its conversation exists
#: Fixed value: blanks of a text.
BLANKS = " \t\n\x0b\x0c\r"
FORCED = 8  # kind of a row that must go; others are 2 * (place of the initial in INITIALS) + truncated
INITIALS = "sua"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"
CHUNK = (
    "conv_id long, part int, no long, matrix array<long>, roles array<string>, texts array<string>, faults array<int>, "
    "least_turn long, first_turn long, last_turn long, turns long"
)


def _kind(initial: str, fault: int) -> int:
    if fault in (BLANK, DUPLICATE):
        return FORCED
    return 2 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + (fault == CUT)


def _inserts() -> np.ndarray:
    """Cost of getting from a state to another by inserted rows."""
    cost = np.full((4, 4), FAR)
    for s in STATES:
        cost[s, s] = 0
        cost[s, NEXT[s]] = INSERT
        cost[s, NEXT[NEXT[s]]] = min(cost[s, NEXT[NEXT[s]]], 2 * INSERT)
    return cost


def _after(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Product of cost matrices: least sums."""
    return np.minimum((left[:, :, None] + right[None]).min(1), FAR)


def _row_costs(kind: int) -> np.ndarray:
    """Cost of getting from a state before a row to one after it, rows inserted before it included."""
    cost = np.full((4, 4), FAR)
    for s in STATES:
        cost[s, s] = DELETE
        if kind != FORCED:
            extra = TRUNCATED * (kind % 2)
            cost[s, NEXT[s]] = min(cost[s, NEXT[s]], REROLE + extra)
            kept = KEPT.get((INITIALS[kind // 2], s)) if kind < 6 else None
            if kept is not None:
                cost[s, kept] = min(cost[s, kept], extra)
    return cost if kind == FORCED else _after(_inserts(), cost)


ROW_COSTS = [_row_costs(k) for k in range(FORCED + 1)]
#: What it costs to end a conversation in each state.
END = [int(x) for x in np.minimum(_inserts()[:, NOTHING], _inserts()[:, ASSISTANT])]
#: All vectors that can follow, but for a constant: a state is at most two inserted rows away from another, and what
#: only the empty beginning can do is to keep one system row.
FOLLOWING = np.array([
    (n, s, 0, a)
    for a, s, n in product(range(-INSERT, INSERT + 1), range(-INSERT, INSERT + 1), range(-INSERT - DELETE, INSERT + 1))
    if a <= s and a - DELETE <= n <= a
])


def _relative(vectors: np.ndarray) -> np.ndarray:
    return vectors - vectors[..., USER : USER + 1]


def _backwards(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix + vector[..., None, :]).min(-1)


@lru_cache(maxsize=4096)
def chunk_matrix(kinds: bytes) -> np.ndarray:
    """Costs from each state before the rows to each behind them: the speculative vectors, run backwards together."""
    matrix = np.where(np.eye(4, dtype=bool), 0, FAR)
    for kind in reversed(kinds):
        matrix = _after(ROW_COSTS[kind], matrix)
    return matrix


def converged(matrix: np.ndarray) -> np.ndarray | None:
    """The vector before a chunk, if all that can follow it give the same but for a constant."""
    vectors = _relative(_backwards(matrix, FOLLOWING))
    return vectors[0] if (vectors == vectors[0]).all() else None


def trace(kinds: bytes, initials: list[str], behind: np.ndarray, state: int) -> tuple[str, int, int]:
    """Edits of a chunk's rows on the ASCII-least cheapest path from ``state``, the state behind them, and their cost."""
    vectors = [[int(x) for x in behind]]
    for kind in reversed(kinds):
        vectors.append([int(x) for x in _backwards(ROW_COSTS[kind], np.array(vectors[-1]))])
    vectors.reverse()
    edits, cost = [], 0
    for i, kind in enumerate(kinds):
        here, there, extra = vectors[i], vectors[i + 1], TRUNCATED * (kind % 2)
        while here[state] != DELETE + there[state] and here[state] == INSERT + here[NEXT[state]]:
            edits.append("I")
            cost, state = cost + INSERT, NEXT[state]
        kept = KEPT.get((initials[i], state)) if kind != FORCED else None
        if here[state] == DELETE + there[state]:
            edits.append("D")
            cost += DELETE
        elif kept is not None and here[state] == extra + there[kept]:
            edits.append("K")
            cost, state = cost + extra, kept
        else:
            edits.append("R")
            cost, state = cost + REROLE + extra, NEXT[state]
    return "".join(edits), state, cost


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, alive)``: rows damaged as the crc32 of ``conv_id:turn`` modulo 20 says.

    0 drops a row (it stays, not alive, so that its conversation is known), 1 empties its text, 2 takes out ``.!?``,
    3 repeats it, 4 makes it a user's. Nulls of role and text become one space, nulls of the key count as one.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    what = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    return rows.select(
        "conv_id",
        "turn",
        F.when(what == 4, "user").otherwise(role).alias("role"),
        F.when(what == 1, "").when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (what != 0).alias("alive"),
        F.explode(F.when(what == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _order() -> list[Column]:
    """Rows by turn, nulls first; equal turns by role, the beginning of the text and its hash. Rows that agree in all this are dealt out by number."""
    return [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "head", "hash", "uid")]


def _chunks(rows: DataFrame) -> DataFrame:
    """The rows, with their first faults, as chunks of a conversation in their order; written."""
    known = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(F.col("alive") if "alive" in rows.columns else F.lit(True), F.lit(True)).alias("alive"),
        F.monotonically_increasing_id().alias("uid"),
    )
    known = stored(known, "conversation-rows")
    # The first of equal rows is found before a shuffle by task, then once; row numbers are unique, so no key is hot.
    firsts = known.where("alive").groupBy("conv_id", "role", F.sha2("text", 256).alias("text_hash"))
    firsts = firsts.agg(F.min(F.struct("turn", "uid")).alias("first")).select(F.col("first.uid").alias("uid"), F.lit(True).alias("is_first"))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(~F.col("alive"), ABSENT)
        .when(trimmed == "", BLANK)
        .when(F.col("is_first").isNull(), DUPLICATE)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), CUT)
        .otherwise(FINE)
    )
    known = known.join(firsts, "uid", "left").withColumn("fault", fault)
    known = known.withColumn("head", F.substring("text", 1, 32)).withColumn("hash", F.xxhash64("text"))
    ordered = known.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("conv_id", "turn", "role", "text", "fault")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size, conv = 0, None
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != conv or len(held) >= CHUNK_ROWS or size >= CHUNK_CHARS):
                    made.append(_chunk(part, no, held))
                    held, size, no = [], 0, no + 1
                conv = row[0]
                held.append(row)
                size += len(row[3])
            if made:
                yield _table(made, CHUNK)
        if held:
            yield _table([_chunk(part, no, held)], CHUNK)

    return stored(ordered.mapInArrow(cut, CHUNK), "conversation-chunks")


def _chunk(part: int, no: int, rows: list[tuple]) -> tuple:
    alive = [r for r in rows if r[4] != ABSENT]
    turns = [r[1] for r in alive if r[1] is not None]
    kinds = bytes(_kind(r[2][:1], r[4]) for r in alive)
    roles, texts, faults = ([r[i] for r in alive] for i in (2, 3, 4))
    ends = (turns[0], turns[0], turns[-1]) if turns else (None, None, None)
    return (rows[0][0], part, no, chunk_matrix(kinds).reshape(-1).tolist(), roles, texts, faults, *ends, len(set(turns)))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.rsplit(" ", 1) for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def _stitched(chunks: DataFrame) -> DataFrame:
    """``(conv_id, part, no, behind)``: the cost vector behind each chunk, but for a constant."""

    def fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, behind, begun = None, None, False
        for batch in batches:
            made = []
            for key, part, no, flat in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or key != conv:
                    conv, behind, begun = key, np.array(END), True
                made.append((key, part, no, behind.tolist()))
                matrix = np.array(flat).reshape(4, 4)
                before = converged(matrix)
                behind = _relative(_backwards(matrix, behind)) if before is None else before
            yield _table(made, "conv_id long, part int, no long, behind array<long>")

    last_first = [F.col("conv_id"), F.desc("part"), F.desc("no")]
    vectors = chunks.select("conv_id", "part", "no", "matrix").repartition("conv_id").sortWithinPartitions(*last_first)
    return vectors.mapInArrow(fix_up, "conv_id long, part int, no long, behind array<long>")


class _Conversation:
    """A conversation whose chunks come in order: its state, audit, digest and counts so far."""

    def __init__(self, key: int | None):
        self.key, self.state, self.cost, self.audit = key, NOTHING, 0, []
        self.digest, self.begun, self.place = hashlib.sha256(), False, 0
        self.faults, self.illegal, self.initial = [0] * 4, 0, None
        self.least, self.last, self.turns = None, None, 0

    def add(self, chunk: dict, behind: list[int], keep: bool) -> list[tuple]:
        """Take a chunk; its repaired rows, if they are kept."""
        initials = [r[:1] for r in chunk["roles"]]
        for initial, fault in zip(initials, chunk["faults"]):
            self.faults[fault] += 1
            self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
        if chunk["turns"]:
            self.least = chunk["least_turn"] if self.least is None else self.least
            self.turns += chunk["turns"] - (self.last == chunk["first_turn"])
            self.last = chunk["last_turn"]
        kinds = bytes(map(_kind, initials, chunk["faults"]))
        edits, state, cost = trace(kinds, initials, np.array(behind), self.state)
        rows, kept = iter(zip(chunk["roles"], chunk["texts"])), []
        for edit in edits:
            kept += self._edit(edit, None if edit == "I" else next(rows), keep)
        if self.state != state:
            raise ValueError("edits lead to another state than their costs")
        self.cost += cost
        self.audit.append(edits)
        return kept

    def _edit(self, edit: str, row: tuple[str, str] | None, keep: bool) -> list[tuple]:
        if edit == "D":
            return []
        role, text = row if row else ("", "")
        if edit == "K":
            self.state = KEPT[role[:1], self.state]
        else:
            role, self.state = FITTING[self.state], NEXT[self.state]
        self.digest.update(("\n" * self.begun + f"{role}:{text}").encode())
        self.begun, self.place = True, self.place + 1
        return [(self.key, self.place - 1, edit, role, text)] if keep else []

    def close(self, keep: bool) -> list[tuple]:
        """Insert what is missing at the end."""
        kept = []
        while self.state in (SYSTEM, USER):
            kept += self._edit("I", None, keep)
            self.audit.append("I")
            self.cost += INSERT
        return kept

    def summary(self) -> tuple:
        gaps = min(self.last - self.least + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        counts = [self.faults[f] for f in (BLANK, DUPLICATE, CUT)]
        return (self.key, gaps, *counts, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _finished(chunks: DataFrame, keep_rows: bool) -> DataFrame:
    vectors = _stitched(chunks)
    empty = {c: F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in chunks.columns if c not in ("conv_id", "part", "no", "matrix")}
    both = chunks.drop("matrix").withColumn("behind", F.lit(None).cast("array<long>"))
    both = both.unionByName(vectors.select("conv_id", "part", "no", *empty.values(), "behind"))
    # A chunk's vector comes just before its rows.
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no", F.col("behind").isNull())
    schema = REPAIRED if keep_rows else SUMMARY

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, behind = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                made: list[tuple] = []
                for row in batch.slice(start, 64).to_pylist():
                    if now is None or now.key != row["conv_id"]:
                        if now is not None:
                            made += _closed(now, keep_rows)
                        now = _Conversation(row["conv_id"])
                    if row["behind"] is not None:
                        behind = row["behind"]
                    else:
                        made += now.add(row, behind, keep_rows)
                if made:
                    yield _table(made, schema)
        if now is not None and (made := _closed(now, keep_rows)):
            yield _table(made, schema)

    return both.mapInArrow(finish, schema)


def _closed(conversation: _Conversation, keep_rows: bool) -> list[tuple]:
    rows = conversation.close(keep_rows)
    return rows if keep_rows else [conversation.summary()]


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and the edits of its repair, and the digest of the repaired rows.

    ``rows`` has ``conv_id, turn, role, text`` and may have ``alive``; rows that aren't alive only tell that their conversation
    exists. Null roles and texts are one space, a null id is a conversation of its own. Rows are taken by turn, nulls first;
    rows of equal turns by role, then by the first 32 characters and a hash of the text. Rows that repeat an
    earlier role and text are duplicates, whatever their turns. A role without the initial of system, user or assistant (an
    empty one too) can't be kept. ``gaps`` ends at the largest 64-bit number. Long conversations and texts
    are cut into chunks; other columns are not looked at; an empty table gives no rows.
    """
    return _finished(_chunks(rows), False)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``(conv_id, place, edit, role, text)``, a row for each row kept (K), re-roled (R) or inserted (I)."""
    return _finished(_chunks(rows), True)
