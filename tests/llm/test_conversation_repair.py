"""Damage, faults and edits against a search that keeps whole strings."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest

from tallyscope.llm import conversation_repair as repair
from tallyscope.llm.survivors import Survivors

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NO_ROWS = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        fault = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text)
        out += [row] * {0: 0, 3: 2}.get(fault, 1)
    return out


def insert(best):
    for _ in range(3):
        for state, (cost, audit, out) in list(best.items()):
            for role in ("user", "assistant"):
                if role[0] in NEXT[state]:
                    way = (cost + 2, audit + "I", (*out, (role, "")))
                    best[role[0]] = min(best.get(role[0], way), way)
    return best


def brute(rows):
    """Result columns and repaired rows of one conversation; rows are (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    counts, seen, best = collections.Counter(), set(), {"": (0, "", ())}
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        ways = collections.defaultdict(list)
        for state, (cost, audit, out) in insert(best).items():
            ways[state].append((cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            left = fault == "truncated"
            if role[:1] in NEXT[state]:
                ways[role[:1]].append((cost + left, audit + "K", (*out, (role, text))))
            for other in ("user", "assistant"):
                if other[0] in NEXT[state]:
                    ways[other[0]].append((cost + 2 + left, audit + "R", (*out, (other, text))))
        best = {state: min(found) for state, found in ways.items()}
    best = insert(best)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest), list(out)


def by_conversation(rows):
    out = collections.defaultdict(list)
    for conv, *row in rows:
        out[conv].append(tuple(row))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


@pytest.fixture(scope="module")
def rows():
    """Null ids, turns, roles and texts, roles beyond the three, one long conversation, repeated texts."""
    random.seed(3)
    out = {}
    for conv in [None, *range(90)]:
        for turn in range(300 if conv == 5 else random.randint(1, 25)):
            turn = None if random.random() < 0.05 else turn * 2 if random.random() < 0.9 else turn
            role = random.choice(["user", "assistant", "system", "tool", "", "user", None])
            text = random.choice(["a.", "b", "c!", "", "d? \n", " x", None]) if random.random() < 0.5 else f"{turn}."
            out[conv, turn] = (conv, turn, role, text)
    return list(out.values())


@pytest.fixture(scope="module")
def turns(spark, rows):
    """With columns named like inner ones."""
    schema = "conv_id long, turn long, role string, text string"
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 as part", "2 as k1", "'x' as audit").repartition(6)


def test_query_on_a_given_table(spark):
    folder = "/root/testdata/sf0.01"
    found = {r[0]: tuple(r)[1:] for r in repair.op13_conversation_repair(spark, folder).select(NAMES).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = by_conversation(brute_damage(rows))
    assert found == {c: brute(damaged[c])[0] if c in damaged else NO_ROWS for c in {r[0] for r in rows}}


def test_query_on_awkward_rows(spark, turns, rows, tmp_path):
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r[0]: tuple(r)[1:] for r in repair.op13_conversation_repair(spark, str(tmp_path)).select(NAMES).collect()}
    damaged = by_conversation(brute_damage(rows))
    assert found == {c: brute(damaged[c])[0] if c in damaged else NO_ROWS for c in {r[0] for r in rows}}


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_chunks_give_the_edits_of_the_whole(turns, rows, chunk):
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    expected = {c: brute(r) for c, r in by_conversation(clean).items()}
    found = repair.repair(turns, chunk_rows=chunk).select(NAMES).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == {c: e[0] for c, e in expected.items()}
    repaired = collections.defaultdict(list)
    for r in repair.repaired_turns(turns, chunk_rows=chunk).orderBy("conv_id", "position").collect():
        assert r["position"] == len(repaired[r["conv_id"]])
        repaired[r["conv_id"]].append((r["role"], r["text"]))
    assert all(repaired[c] == e[1] for c, e in expected.items())


def test_rows_equal_in_all_columns(spark):
    rows = [(1, 0, "user", "a.")] * 3 + [(1, 1, "assistant", "b.")] * 2 + [(1, 2, "user", "a.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert tuple(repair.repair(frame).select(NAMES).first()) == (1, *brute([r[1:] for r in rows])[0])


def test_empty_table(turns, spark):
    assert repair.repair(turns.limit(0)).count() == 0
    assert repair.repaired_turns(turns.limit(0)).count() == 0


def test_memory_is_given_up_when_survivors_coalesce():
    decided = []
    found = Survivors(repair.NOTHING, decided.append, repair.CATCH_UP)
    for i in range(20000):
        found.step(repair.moves("ua"[i % 2], i % 50 == 0, i % 7 == 0))
        kept, todo = 0, [found.root]
        while todo and i % 500 == 0:
            node = todo.pop()
            kept += 1
            todo += node.children
        assert kept < 400
    assert len(decided) > 19900
