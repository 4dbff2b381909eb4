"""Repaired conversations against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from gleaner.llm import conversations
from gleaner.llm.queries import QUERIES
from tests.conftest import rows

SPACES = " \t\n\x0b\x0c\r"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults_of(convo):
    seen, out = set(), []
    for role, text in convo:
        bare = text.strip(SPACES)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("fine" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(convo, faults):
    """``(cost, audit, lines)`` by Dijkstra's search over (rows used, last role); the audit is part of the order."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(convo) and last in ("", "a"):
            return cost, audit, "\n".join(lines)
        fits = "a" if last == "u" else "u"
        name = {"a": "assistant", "u": "user"}[fits]
        heapq.heappush(heap, (cost + 2, audit + "I", at, fits, (*lines, f"{name}:")))
        if at == len(convo):
            continue
        role, text = convo[at]
        heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, lines))
        if faults[at] in ("blank", "duplicate"):
            continue
        extra = faults[at] == "truncated"
        if role[:1] == fits or role[:1] == "s" and last == "":
            heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))
        heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, fits, (*lines, f"{name}:{text}")))
    raise AssertionError


def brute(data):
    """``data``: rows (conv_id, turn, role, text, alive)."""
    out = []
    for key in {r[0] for r in data}:
        own = sorted(((t is not None, t or 0, role or " ", " " if text is None else text) for k, t, role, text, alive in data if k == key and alive))
        convo, turns = [(r[2], r[3]) for r in own], [r[1] for r in own if r[0]]
        faults = faults_of(convo)
        cost, audit, text = cheapest(convo, faults)
        initials = [r[:1] for r, _ in convo]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
        out.append((key, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def some(rnd, conv, n):
    roles = ["user", "assistant", "system", "tool", None, "U", "superb"]
    texts = ["a.", "b", "c!", "", " \n", None, "é?", "d. \t", "x" * 40 + ".", "x" * 40 + "y."]
    made = []
    for i in range(n):
        role = rnd.choices(roles, [8, 8, 2, 1, 1, 1, 1])[0]
        text = rnd.choice(texts) if rnd.random() < 0.4 else f"{i} {rnd.choice(['.', '?', '', ' '])}"
        made.append((conv, rnd.choice([None, i // 2, i, 3]) if rnd.random() < 0.3 else i, role, text, rnd.random() < 0.95))
    return made


@pytest.mark.parametrize(("chunk_rows", "n"), [(1, 9), (3, 40), (256, 60)])
def test_repairs_are_the_cheapest(spark, monkeypatch, chunk_rows, n):
    monkeypatch.setattr(conversations, "CHUNK_ROWS", chunk_rows)
    rnd, data = random.Random(chunk_rows), []
    for conv in [*range(60), None]:
        data += some(rnd, conv, rnd.randrange(1, n))
    data += [(1000, 5, "user", "only dropped.", False), (1001, -(1 << 63), "user", "a.", True), (1001, (1 << 63) - 1, "assistant", "b.", True)]
    given = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, alive boolean").withColumnRenamed("conv_id", "conv_id")
    want = [r if r[0] != 1001 else (r[0], (1 << 63) - 1, *r[2:]) for r in brute(data)]
    assert rows(conversations.repair(given.repartition(7)), *COLUMNS) == want
    lines = {}
    for r in conversations.repaired(given).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in want:
        assert hashlib.sha256("\n".join(lines.get(r[0], [])).encode()).hexdigest() == r[-1]


def test_a_long_conversation_spans_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_ROWS", 16)
    rnd = random.Random(7)
    data = [(1, i, rnd.choice(["user", "user", "assistant"]), f"{i}." if rnd.random() < 0.8 else "same", True) for i in range(1500)]
    data += [(2, i, "user", f"{i}.", True) for i in range(500)] + [(3, None, "user", "copy.", True)] * 400 + [(4, 1, "user", "long " * 500_000, True)]
    given = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, alive boolean")
    assert rows(conversations.repair(given), *COLUMNS) == brute(data)
    assert conversations.repair(given.limit(0)).count() == 0


def test_converged_vectors_hold_for_all_that_follows():
    rnd = random.Random(1)
    for _ in range(300):
        kinds = bytes(rnd.randrange(9) for _ in range(rnd.randrange(12)))
        following = np.array(conversations.END)
        for kind in [rnd.randrange(9) for _ in range(rnd.randrange(30))]:
            following = conversations._backwards(conversations.ROW_COSTS[kind], following)
        relative = conversations._relative(following)
        assert relative.tolist() in conversations.FOLLOWING.tolist()
        matrix = conversations.chunk_matrix(kinds)
        found = conversations.converged(matrix)
        if found is not None:
            assert found.tolist() == conversations._relative(conversations._backwards(matrix, following)).tolist()
    assert conversations.converged(conversations.chunk_matrix(bytes([2, 4, 2, 4, 2, 4]))) is not None


def test_query_damages_and_repairs(spark, sf):
    data = []
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        what, role, text = zlib.crc32(key.encode()) % 20, r.role or " ", " " if r.text is None else r.text
        if what == 2:
            text = "".join(c for c in text if c not in ".!?")
        row = (r.conv_id, r.turn, "user" if what == 4 else role, "" if what == 1 else text, what != 0)
        data += [row] * (2 if what == 3 else 1)
    assert rows(QUERIES["op12_conversation_repair"](spark, sf), *COLUMNS) == brute(data)
