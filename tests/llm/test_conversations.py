"""Repair of conversations against an exhaustive search over audits, blocks of a few rows, odd rows; and its SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tidemill.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def fault_list(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) over all edits, by what stood last: the least for each row, node and number of insertions."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    held = {"": (0, "", ())}

    def put(out, state, cost, audit, lines):
        if state not in out or (cost, audit) < out[state][:2]:
            out[state] = (cost, audit, lines)

    def insertions(held):
        for _ in range(4):
            for state, (cost, audit, lines) in list(held.items()):
                for role in ("user", "assistant"):
                    if role[0] in legal[state]:
                        put(held, role[0], cost + 5, audit + "I", (*lines, f"{role}:"))
        return held

    for (_, _, role, text), fault in zip(rows, faults):
        out = {}
        for state, (cost, audit, lines) in insertions(held).items():
            put(out, state, cost + 2, audit + "D", lines)
            if fault in ("", "truncated"):
                cost += 5 * (fault == "truncated")
                if role[:1] and role[0] in legal[state]:
                    put(out, role[0], cost, audit + "K", (*lines, f"{role}:{text}"))
                for other in ("user", "assistant"):
                    if other[0] in legal[state]:
                        put(out, other[0], cost + 1, audit + "R", (*lines, f"{other}:{text}"))
        held = out
    return min(v for k, v in insertions(held).items() if k in ("", "a"))


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(damaged(r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        faults, turns = fault_list(own), {r[1] for r in own} - {None}
        cost, audit, lines = cheapest(own, faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(Counter(faults)[k] for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "cut off", "", "  \n", "Éh bien. ", "Yes. \t", "a.b", "tail\x85", "x" * 3_000 + "."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User", None])
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None]), role, rng.choice([*texts, f"own {turn}.", f"other {turn}.", None])))
    return rows + [(None, 0, "user", "Null id."), (None, 1, "assistant", "Here."), (None, None, "system", "First."), (10**6, 3, "user", "LONG " * 60_000 + ".")]


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", place long, g string, kind int")
    return sorted((tuple(r) for r in conversations.repair_report(df).collect()), key=repr)


@pytest.mark.parametrize("block", [3, 4096])
def test_as_exhaustive_search(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = rows_of(block, 150, 14)
    # one conversation with many rows, most of them of one turn and equal
    rows += [(777_777, k // 9, ("user", "assistant", "system")[k % 3], "Same text." if k % 2 else f"n {k % 40}!") for k in range(600)]
    assert run(spark, rows) == brute(rows)


def test_sql_as_exhaustive_search():
    rows = rows_of(5, 200, 10)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(conversations.repair_report_sql()).fetchall(), key=repr) == brute(rows)


def test_no_rows_and_dropped_ones(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_report(df).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run(spark, [(dropped, 0, "user", "Hi.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows_alternate(spark, sf):
    rows = conversations.damage(spark.read.parquet(f"{sf}/conversations.parquet"))
    got = {}
    for r in conversations.repaired(rows).collect():
        got.setdefault(r.conv_id, []).append((r.place, r.role))
    for held in got.values():
        held.sort()
        assert [p for p, _ in held] == list(range(len(held))) and re.fullmatch("s?(ua)+", "".join(role[0] for _, role in held))
    assert len(got) > 5


def test_distances_by_relaxation_and_crossings_compose():
    rng = random.Random(1)
    for _ in range(60):
        codes = "".join(chr(97 + rng.randrange(16)) for _ in range(rng.randint(0, 12)))
        n, ends = len(codes), (0, 10, 5, 0)
        want = [10**9] * (4 * n) + list(ends)
        for _ in range(3 * (n + 1)):  # until nothing changes
            for i in range(n, -1, -1):
                for s in range(4):
                    ways = [5 + want[4 * i + conversations.NEXT[s]]]
                    if i < n:
                        ways += [w + want[4 * i + 4 + b] for a, b, w in conversations.before(codes[i]) if a == s]
                    want[4 * i + s] = min(want[4 * i + s], *ways)
        assert conversations.distances(codes, ends) == want
        cut = n // 2
        later = conversations.distances(codes[cut:], ends)[:4]
        costs = conversations.crossing(codes[:cut])
        assert [min(w + e for w, e in zip(costs[4 * s : 4 * s + 4], later) if w >= 0) for s in range(4)] == want[:4]
