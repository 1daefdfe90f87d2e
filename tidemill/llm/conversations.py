"""Repair of the structure of conversations by shortest paths with small whole costs (Dial's bucket queue).

The rows of a conversation in their order, and what may follow what, make a graph: a node is a place between two rows and
the role that stood last, an arc keeps a row, deletes it, gives it another role or inserts an empty one. Costs are whole
numbers from 0 to 6, so the queue of Dijkstra's method is a ring of buckets, one for each distance. Distances are recorded
from the end backwards; walking from the start along tight arcs (those whose cost is just the difference of distances),
always by the least letter, gives the least audit of all that are cheapest.

A conversation may have any number of rows. Rows are numbered without gathering them (``ranking``) and cut into blocks of
``BLOCK``, each of which becomes one short text, a letter to a row. Blocks are independent but for their borders, where
only four nodes meet: the distances between the four nodes of a block's two ends compose like matrices, which gives every
block the distances at its end, and then the walk from each of its four entries; one pass over the blocks in order, with
four numbers in hand, picks the entry that is taken. Rows are put together again in a stream of sorted partitions, which
holds one row at a time. Only the digest of a repaired conversation has to read its texts one after the other, since such
a digest is a chain; it, too, holds one row at a time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import spill_table
from .ranking import group_key, places

#: Rows of a block.
BLOCK = 4096
DELETE, RENAME, INSERT, CUT_OFF = 2, 1, 5, 5
#: Roles by their initial, and faults; a row is a letter, the two together.
INITIALS = "suax"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Nodes at a place: nothing yet, after system, after user, after assistant. What a kept initial leads to, and what comes next else.
START, ENDS = 0, (0, 10, 5, 0)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
#: Pairs of initials that may stand next to each other.
LEGAL = ("su", "ua", "au")
#: White space, as in the patterns of texts.
SPACE = r"\x20\x09-\x0D"
#: Texts that a task decodes at a time, and plans that a worker keeps.
ROWS, KNOWN = 256, 20_000


@functools.cache
def meaning(letter: str) -> tuple[str, int]:
    """Initial ('x' for others) and fault of a row's letter."""
    k = ord(letter) - 97
    return INITIALS[k // 4], k % 4


@functools.cache
def before(letter: str) -> tuple[tuple[int, int, int], ...]:
    """(node before, node after, cost) of all arcs that pass a row."""
    initial, fault = meaning(letter)
    out = [(s, s, DELETE) for s in range(4)]
    if fault in (NONE, TRUNCATED):
        more = CUT_OFF if fault == TRUNCATED else 0
        out += [(s, KEEP[s][initial], more) for s in range(4) if initial in KEEP[s]]
        out += [(s, NEXT[s], RENAME + more) for s in range(4)]
    return tuple(out)


def distances(codes: str, ends) -> list[int]:
    """The cost from each node to the end of the block, 4 to a place; ``ends`` are those at its last place. -1: no way."""
    n = len(codes)
    out = [-1] * (4 * n + 4)
    low = min(d for d in ends if d >= 0)
    size = max(RENAME + CUT_OFF, *(d - low for d in ends)) + 1
    ring: list[list[int]] = [[] for _ in range(size)]
    for s, d in enumerate(ends):
        if d >= 0:
            ring[(d - low) % size].append(4 * n + s)
    into = {c: [[(a, w) for a, b, w in before(c) if b == s] for s in range(4)] for c in set(codes)}
    inserted = [[a for a in range(4) if NEXT[a] == s] for s in range(4)]
    d = idle = 0
    while idle < size:
        bucket = ring[d % size]
        idle = 0 if bucket else idle + 1
        while bucket:  # arcs without cost add to the bucket that is being emptied
            v = bucket.pop()
            if out[v] >= 0:
                continue
            out[v] = d + low
            i, s = divmod(v, 4)
            for a in inserted[s]:
                if out[4 * i + a] < 0:
                    ring[(d + INSERT) % size].append(4 * i + a)
            if i:
                for a, w in into[codes[i - 1]][s]:
                    if out[v - 4 - s + a] < 0:
                        ring[(d + w) % size].append(v - 4 - s + a)
        d += 1
    return out


def walk(codes: str, dist: list[int], s: int, last: bool) -> tuple[str, int]:
    """The least edits along tight arcs from node ``s`` of the first place, and the node at the end.

    D and K delete and keep a row, U and A give it the role of user or assistant, u and a insert one. After the last row
    of a conversation insertions go on until the end is reached.
    """
    n, out, i = len(codes), [], 0
    while True:
        here = dist[4 * i + s]
        t = NEXT[s]
        insert = here == INSERT + dist[4 * i + t] if dist[4 * i + t] >= 0 else False
        if i == n:
            if not last or not insert:
                return "".join(out), s
            out.append("ua"[t - 2])
            s = t
            continue
        ways = {(b, w): dist[4 * i + 4 + b] for a, b, w in before(codes[i]) if a == s}
        initial, fault = meaning(codes[i])
        more = CUT_OFF if fault == TRUNCATED else 0
        if here == DELETE + dist[4 * i + 4 + s] and dist[4 * i + 4 + s] >= 0:
            out.append("D")
        elif insert:
            out.append("ua"[t - 2])
            s = t
            continue
        elif initial in KEEP[s] and ways.get((KEEP[s][initial], more), -1) >= 0 and here == more + ways[KEEP[s][initial], more]:
            out.append("K")
            s = KEEP[s][initial]
        else:
            out.append("UA"[t - 2])
            s = t
        i += 1


def audit_of(edits: Column) -> Column:
    """The edits by their initials: keep, rerole, delete, insert."""
    return F.translate(edits, "uaUA", "IIRR")


@functools.lru_cache(KNOWN)
def plan(codes: str, ends: tuple[int, ...], last: bool, first: bool) -> tuple[int, list[str], list[int]]:
    """Cost from the start; edits and node at the end from each entry. The first block is only entered at the start."""
    dist = distances(codes, ends)
    ways = [walk(codes, dist, s, last) if dist[s] >= 0 and (s == START or not first) else ("", s) for s in range(4)]
    return dist[START], [w for w, _ in ways], [s for _, s in ways]


@functools.lru_cache(KNOWN)
def crossing(codes: str) -> list[int]:
    """The cost from each node of the block's first place to each of its last, 16 numbers; -1: no way."""
    columns = [distances(codes, tuple(0 if t == s else -1 for t in range(4))) for s in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows after damage, by crc32(conv_id:turn) mod 20; nulls count as one blank, in ids only there.

    0 drops a row, 1 empties its text, 2 takes '.', '!' and '?' out of it, 3 repeats it, 4 gives it the role of user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    changed = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """g, turn, role, text, digest: what orders rows within a conversation is turn, role and digest of the text."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.select(group_key("conv_id").alias("g"), "turn", "role", "text", F.sha2("text", 256).alias("digest"))


def _conv_id() -> Column:
    return F.when(F.col("g") != "", F.substr("g", F.lit(2)).cast("long"))


ORDER = ["turn", "role", "digest"]


def faults(rows: DataFrame) -> DataFrame:
    """g, turn, role, digest, place, letter of each row; texts are left behind."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = F.col("text").rlike(rf"[^{SPACE}.!?][{SPACE}]*\z")
    own = _keyed(rows).select("g", *ORDER, blank.alias("blank"), cut.alias("cut"))
    ranked = places(own, "g", ORDER)
    # the first row of each role and text; a place is one row, so this join has no hot key
    first = ranked.where("not blank").groupBy("g", "role", "digest").agg(F.min("place").alias("place")).select("g", "place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(NONE)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12)
    return ranked.join(first, ["g", "place"], "left").select("g", *ORDER, "place", F.char(F.lit(97) + kind + fault).alias("letter"))


def blocks(rows: DataFrame) -> DataFrame:
    """g, block, head (turn, role, digest of the first row), codes."""
    held = F.array_sort(F.collect_list(F.struct("place", "letter")))
    return rows.groupBy("g", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.min_by(F.struct(*ORDER), "place").alias("head"), F.array_join(held["letter"], "").alias("codes"))


def _stream(df: DataFrame, order: list[str], schema: str, rows) -> DataFrame:
    """``rows(records)`` over the rows of each partition, conversations whole and in order, one row in hand at a time."""
    names = [f.split(" ")[0] for f in re.split(r", (?=\w+ )", schema)]

    def run(batches):
        def records():
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    yield from batch.slice(k, ROWS).to_pylist()

        made = rows(records())
        while part := list(itertools.islice(made, ROWS)):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in part], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.sortWithinPartitions("g", *order).mapInArrow(run, schema)


def _crossings(batches):
    for batch in batches:
        costs = [crossing(c) if b else [] for b, c in zip(batch.column("block").to_pylist(), batch.column("codes").to_pylist())]
        yield batch.append_column("costs", pa.array(costs, pa.list_(pa.int32())))


def _ends(records):
    """Backwards through a conversation: the distances at the end of each block."""
    g = None
    for r in records:
        last = r["g"] != g
        if last:
            g, ends = r["g"], list(ENDS)
        yield r["g"], r["block"], r["head"], r["codes"], ends, last
        if r["costs"]:
            ends = [min((w + e for w, e in zip(r["costs"][4 * s : 4 * s + 4], ends) if w >= 0 and e >= 0), default=-1) for s in range(4)]


def _plans(batches):
    for batch in batches:
        own = [plan(c, tuple(e), bool(z), not b) for c, e, z, b in zip(*(batch.column(x).to_pylist() for x in ("codes", "ends", "last", "block")))]
        more = [pa.array([p[k] for p in own], t) for k, t in enumerate((pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "cost", "ways", "nodes"])


def _entries(records):
    """Forwards through a conversation: the edits of each block, and the counts of its rows."""
    g = None
    for r in records:
        first = r["g"] != g
        if first:
            g, s, before_ = r["g"], START, ""
        known = [meaning(c) for c in r["codes"]]
        seen = [x for x, _ in known]
        illegal = sum(a + b not in LEGAL for a, b in zip([before_, *seen] if before_ else seen, seen if before_ else seen[1:]))
        kinds = [f for _, f in known]
        yield r["g"], r["block"], r["head"], r["ways"][s], r["cost"] if first else 0, *map(kinds.count, (BLANK, DUPLICATE, TRUNCATED)), illegal
        s, before_ = r["nodes"][s], seen[-1]


HEAD = "head struct<turn:bigint,role:string,digest:string>"


def edits(rows: DataFrame) -> DataFrame:
    """g, block, head, edits, cost, blank, duplicate, truncated, illegal of each block of a conversation, written down.

    The sum of ``cost`` over a conversation is its cost.
    """
    own = blocks(faults(rows)).mapInArrow(_crossings, f"g string, block long, {HEAD}, codes string, costs array<int>")
    own = _stream(own.withColumn("back", -F.col("block")).repartition("g"), ["back"], f"g string, block long, {HEAD}, codes string, ends array<int>, last boolean", _ends)
    own = own.repartition("g", "block").mapInArrow(_plans, f"g string, block long, {HEAD}, codes string, ends array<int>, last boolean, cost long, ways array<string>, nodes array<int>")
    return spill_table(_stream(own.repartition("g"), ["block"], f"g string, block long, {HEAD}, edits string, cost long, blank long, duplicate long, truncated long, illegal long", _entries), "edits")


def _rebuilt(records):
    """Edits come no later than the rows they are for, so they wait in line."""
    line, g, n, conv = deque(), None, 0, None

    def rest():
        return [(conv, g, k, "user" if c == "u" else "assistant", "") for k, c in enumerate(line, n)]

    for r in records:
        if r["g"] != g:
            yield from rest()
            line.clear()
            g, n, conv = r["g"], 0, int(r["g"][1:]) if r["g"] else None
        if not r["kind"]:
            line.extend(r["text"])
            continue
        while (c := line.popleft()) in "ua":
            yield conv, g, n, "user" if c == "u" else "assistant", ""
            n += 1
        if c != "D":
            yield conv, g, n, {"U": "user", "A": "assistant"}.get(c, r["role"]), r["text"]
            n += 1
    yield from rest()


def repaired(rows: DataFrame, edits_: DataFrame | None = None) -> DataFrame:
    """conv_id, g, place, role, text of the rows as repaired: each conversation in one partition, in order. One shuffle of texts.

    ``edits_`` is what ``edits(rows)`` gives, if it is at hand.
    """
    edits_ = edits(rows) if edits_ is None else edits_
    own = _keyed(rows).select("g", *ORDER, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), "text")
    lines = edits_.select("g", "head.turn", "head.role", "head.digest", F.lit(0).alias("kind"), "block", F.col("edits").alias("text"))
    # edits that begin with a row sort before all rows that are equal to it, and among themselves by their blocks
    return _stream(own.unionByName(lines).repartition("g"), [*ORDER, "kind", "block"], "conv_id long, g string, place long, role string, text string", _rebuilt)


def _digests(records):
    g, made = None, None
    for r in records:
        if r["g"] != g:
            if made is not None:
                yield g, made.hexdigest()
            g, made = r["g"], hashlib.sha256()
        else:
            made.update(b"\n")
        made.update(f"{r['role']}:{r['text']}".encode("utf-8", "replace"))
    if made is not None:
        yield g, made.hexdigest()


def digests(rows: DataFrame) -> DataFrame:
    """g, repaired_sha256 of what ``repaired`` gives, in the same pass."""

    def run(batches):
        made = _digests(r for batch in batches for k in range(0, batch.num_rows, ROWS) for r in batch.slice(k, ROWS).to_pylist())
        while part := list(itertools.islice(made, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*part)], ["g", "repaired_sha256"])

    return rows.mapInArrow(run, "g string, repaired_sha256 string")


def report(rows: DataFrame, edits_: DataFrame) -> DataFrame:
    """g, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``rows``."""
    turn = F.col("turn").cast("decimal(20,0)")
    gaps = rows.select(group_key("conv_id").alias("g"), "turn").groupBy("g").agg(F.coalesce((F.max(turn) - F.min(turn) + 1 - F.count_distinct("turn")).cast("long"), F.lit(0)).alias("gaps"))
    own = edits_.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.array_join(F.array_sort(F.collect_list(F.struct("block", "edits")))["edits"], "").alias("audit"))
    return gaps.join(own, "g").withColumn("audit", audit_of(F.col("audit")))


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for every id, after damage and repair.

    Rows are ordered by turn (nulls first), those of one turn by role and digest of the text; rows that are equal in all
    of these are alike. A null id is an id of its own; null roles and texts are one blank, which is a role that has to be
    given up and a text that counts as blank. Initials are case-sensitive; an empty role has none. Texts may be of any
    length, and so may conversations. An id without rows after damage has zeros, an empty audit and the digest of the
    empty text; no rows give none. Further columns, whatever their names, are not read.
    """
    rows = damage(conversations)
    own = edits(rows)
    ids = conversations.select(group_key("conv_id").alias("g")).distinct()
    out = ids.join(report(rows, own), "g", "left").join(digests(repaired(rows, own)), "g", "left")
    none = hashlib.sha256(b"").hexdigest()
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(_conv_id().alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def repair_report_sql() -> str:
    """The same rows in DuckDB's SQL: from row to row, the least (cost, audit) of each node, with what it repairs to."""
    # equal costs with equal rows mean as many letters, so neither audit begins with the other, and the least is found from row to row
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)), lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384::BIGINT))), 4294967295)"
    step = lambda state, cost, letter, line=None: f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r" + (f" || chr(10) || {line}" if line else "") + "}"
    least = lambda ways: f"list_sort([{', '.join(ways)}])[1]"
    row = "n.role || ':' || n.text"
    more = f"CASE WHEN n.fault = {TRUNCATED} THEN {CUT_OFF} ELSE 0 END"
    never = 10**9

    def kept(state: str, initial: str) -> str:
        return step(state, f"CASE WHEN n.fault IN ({BLANK}, {DUPLICATE}) OR left(n.role, 1) <> '{initial}' THEN {never} ELSE {more} END", "K", row)

    def given(state: str, role: str) -> str:
        return step(state, f"{RENAME} + CASE WHEN n.fault IN ({BLANK}, {DUPLICATE}) THEN {never} ELSE {more} END", "R", f"'{role}:' || n.text")

    dropped = lambda state: step(state, DELETE, "D")
    # columns n, s, u, a are the nodes before a row, insertions included
    to_u = [f(x, v) for x in ("x.n", "x.s", "x.a") for f, v in ((kept, "u"), (given, "user"))]
    passed = f"{dropped('x.n')} AS n, {least([dropped('x.s'), kept('x.n', 's')])} AS s, {least([dropped('x.u'), *to_u])} AS u0, {least([dropped('x.a'), kept('x.u', 'a'), given('x.u', 'assistant')])} AS a0"
    insert_u = least(["u0", *(step(v, INSERT, "I", "'user:'") for v in ("n", "s", "a0"))])
    insert_a = least(["a0", step("u", INSERT, "I", "'assistant:'")])
    node = lambda cost, name: f"{{'c': {cost}::BIGINT, 'a': '', 'r': ''}} AS {name}"
    inserted = lambda rows: f"SELECT *, {insert_a} AS a FROM (SELECT *, {insert_u} AS u FROM ({rows}))"
    keep = "EXCLUDE (u0, a0)"
    start = f"SELECT DISTINCT g, 0::BIGINT AS i, {node(0, 'n')}, {node(never, 's')}, {node(never, 'u0')}, {node(never, 'a0')} FROM numbered"
    blank, cut = f"[^{SPACE}]", f"[^{SPACE}.!?][{SPACE}]*$"
    return f"""WITH RECURSIVE base AS (SELECT conv_id, coalesce('=' || conv_id, '') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM base WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
numbered AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{blank}') THEN {BLANK} WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN {DUPLICATE} WHEN regexp_matches(text, '{cut}') THEN {TRUNCATED} ELSE {NONE} END AS fault, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair FROM ordered),
paths AS (SELECT * {keep} FROM ({inserted(start)}) UNION ALL SELECT * {keep} FROM ({inserted(f"SELECT x.g, x.i + 1 AS i, {passed} FROM paths x JOIN numbered n ON n.g = x.g AND n.i = x.i + 1")})),
best AS (SELECT g, list_sort([n, a])[1] AS b FROM paths QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1),
counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM numbered GROUP BY g)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM base) o LEFT JOIN counts USING (g) LEFT JOIN best USING (g)"""
