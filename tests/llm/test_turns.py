"""Conversation repair against a search over all repairs and its SQL."""

from __future__ import annotations

import itertools
import re
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import turns
from tests.conftest import DATA
from tests.oracle import compare

STEP = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit) over strings: rows are (initial, fault)."""

    @lru_cache(None)
    def best(i, state, inserted):
        out = [(0, "")] if i == len(rows) and state in ("", "a") else []
        own = "a" if state == "u" else "u"
        if inserted < 3:
            c, a = best(i, own, inserted + 1)
            out.append((c + 3, "I" + a))
        if i < len(rows):
            initial, fault = rows[i]
            more = 3 * (fault == "truncated")
            c, a = best(i + 1, state, 0)
            out.append((c + 4, "D" + a))
            if fault not in ("blank", "duplicate"):
                if initial in STEP[state] and initial:
                    c, a = best(i + 1, initial, 0)
                    out.append((c + more, "K" + a))
                c, a = best(i + 1, own, 0)
                out.append((c + 3 + more, "R" + a))
        return min(out, default=(10**9, "~"))

    return best(0, "", 0)


def brute(table):
    """Rows are (conv_id, turn, role, text)."""
    talks = {}
    for conv, turn, role, text in table:
        talks.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        talks[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in talks.items():
        rows.sort(key=lambda r: ((r[0] is not None, r[0] or 0), sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        known = [r[0] for r in rows if r[0] is not None]
        cost, audit = cheapest(tuple(zip(initials, faults, strict=True)))
        said, state, at = [], "", 0
        for edit in audit:
            role, text = rows[at][1:] if edit != "I" else ("", "")
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            said.append(f"{role}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("pos", "n", "block", "row", "code", "audit", "copy", "_at", "_task", "end", "last"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def random_rows(n, seed, convs=6):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", " \n", "", "So?", None, "é!", "Very long. " * 50]
    out = []
    for i in range(n):
        text = texts[rng.integers(8)]
        if text and rng.random() < 0.6:
            text = f"{i} {text}"
        turn = int(rng.integers(-3, n)) if rng.random() > 0.05 else None
        out.append((int(rng.integers(convs)), turn, roles[min(5, int(rng.exponential(1.2)))], text))
    return out


def got(spark, rows, block):
    table = frame(spark, rows)
    return sorted(map(tuple, turns.report(turns.damaged(table), table, block).collect()), key=repr)


def test_random_conversations(spark):
    rows = random_rows(160, 1)
    want = brute(rows)
    assert got(spark, rows, 4096) == want
    assert got(spark, rows, 5) == want  # blocks joined by doubling
    assert any(len(set(x[7])) == 4 for x in want)


def test_odd_conversations(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (3, None, "user", "a."), (3, None, "assistant", "b."), (3, 7, "user", "c"), (3, 7, "user", "c"),
        *[(4, 1, "user", "The same.")] * 40, (5, 0, "system", "Only."), (6, 2**62, "user", "q?"), (6, -(2**61), "assistant", "w " * 200_000 + "."), (7, 1, "user", "x"),
    ]
    want = brute(rows)
    assert got(spark, rows, 4096) == want
    assert got(spark, rows, 8) == want


def test_solver_equals_search_of_all_repairs():
    rng = np.random.default_rng(3)
    names, faults = ["x", "s", "u", "a"], ["", "truncated", "blank"]
    blocks = [rng.integers(0, 12, rng.integers(0, 40)) for _ in range(300)]
    for block, (cost, audit, exits) in zip(blocks, turns.solve(blocks, np.tile(turns.END_COST, (300, 1))), strict=True):
        rows = tuple((names[c % 4], faults[c // 4]) for c in block)
        assert (cost[0], audit[0] + turns.END_AUDIT[exits[0]]) == cheapest(rows)


def test_repaired_rows_are_legal(spark):
    table = frame(spark, random_rows(200, 2)).fillna("x", ["role", "text"])
    roles = {}
    for r in sorted(turns.repair(table, 7).collect(), key=lambda r: (r.conv_id, r.place)):
        roles.setdefault(r.conv_id, []).append(r.role[:1])
    assert roles and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in roles.values())


def test_empty_table(spark):
    assert got(spark, [], 4096) == []


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_query_equals_sql(spark, folder):
    compare(spark, folder, turns.op12_turns, turns.OP12_SQL)
