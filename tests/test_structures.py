"""Running numbers, percentiles, trees and folds over hot groups against plain Python; sinks and streams that run twice."""

import datetime
import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidemill.operators import folds, prefix, runlog, tree
from tidemill.sources import frames, versioned
from tidemill.streaming import events as streams, orders


def test_running_sums_of_a_group_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 2 else rng.choice([None, "a", "", "b|1:c"]), rng.choice([None, 1, 2, 3]), i, rng.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, id int, _key int").repartition(6)
    got = {r.id: r.n for r in prefix.running(df, ["g"], ["o", "id"], "_key", "n").collect()}
    want, groups = {}, {}
    for g, _, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[i] = groups.get(g, 0)
        groups[g] = want[i] + v
    assert got == want
    places = [r.place for r in prefix.running(df, [], ["id"]).orderBy("id").collect()]
    assert places == list(range(3000)) and prefix.running(df.limit(0), ["g"], ["id"]).count() == 0


def test_percentiles_of_groups(spark):
    rng = random.Random(2)
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 4}", None if i % 7 == 0 else rng.randint(0, 40) / 4) for i in range(2000)] + [("none", None), ("one", 3.5)]
    got = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in prefix.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    at = lambda own, p: sorted(own)[max(math.ceil(p * len(own)), 1) - 1]
    assert got == {g: tuple(at(own, p) for p in (0.0, 0.5, 0.95, 1.0)) for g, own in groups.items()}


def test_trees_deep_broad_and_broken(spark):
    rng = random.Random(3)
    rows = [("deep", f"d{i:04}", f"d{i - 1:04}" if i else None, 5 * i) for i in range(300)]
    rows += [("broad", f"b{i:04}", "b0000" if i else None, -i) for i in range(400)]
    rows += [(None, f"r{i:04}", f"r{rng.randrange(i):04}" if i % 9 else "gone", rng.randint(0, 3)) for i in range(1, 200)] + [(None, "r0000", None, 0)]
    rows += [("circle", "x", "y", 0), ("circle", "y", "x", 1), ("circle", "below", "x", 2), ("circle", "self", "self", 3), ("circle", "sound", None, 4)]
    df = spark.createDataFrame(rows, "run_id string, span_id string, parent_id string, started_at int")
    got = {(r.run, r.id): (r.depth, r["size"], r.pos) for r in tree.walk(df, "started_at").collect()}
    want = {}
    for run in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == run]
        ids, below = {r[1] for r in own}, {}
        for _, i, up, at in own:
            below.setdefault(up if up in ids else None, []).append((at, i))
        n, stack = 0, [(0, i) for _, i in sorted(below.get(None, []), reverse=True)]
        order = []
        while stack:
            depth, i = stack.pop()
            n += 1
            order.append(i)
            want[run, i] = [depth, 1, n]
            stack += [(depth + 1, j) for _, j in sorted(below.get(i, []), reverse=True)]
        parent = {i: up for _, i, up, _ in own}
        for i in reversed(order):
            if parent[i] in ids:
                want[run, parent[i]][1] += want[run, i][1]
    assert got == {k: tuple(v) for k, v in want.items()} and ("circle", "x") not in got


def tree_rows():
    rng = random.Random(8)
    rows = [("deep", i, i - 1 if i else None, i % 3) for i in range(700)] + [("three", i, (i - 1) // 3 if i and i % 41 else None, i * 7 % 10) for i in range(900)]
    rows += [(None, i, rng.randrange(500) if i % 9 else None, rng.randint(0, 3)) for i in range(500)]  # far ones, circles and rows below circles
    rows += [("hub", i, 0 if i else None, -i) for i in range(600)] + [("round", i, (i + 1) % 400, 0) for i in range(400)] + [("round", 400 + i, i, 0) for i in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [40, 1 << 18])
def test_trees_over_blocks(spark, monkeypatch, size):
    """Trees, a hub and circles that reach over many blocks, against plain Python; a chain within blocks takes fewer rounds than its depth asks for."""
    monkeypatch.setattr(tree, "BLOCK_ROWS", size)
    steps, jumped = [], tree._jumped
    monkeypatch.setattr(tree, "_jumped", lambda *a: steps.append(1) or jumped(*a))
    rows, want = tree_rows(), {}
    for run in {r[0] for r in rows}:
        own = {i: (up, at) for r, i, up, at in rows if r == run}
        below = {}
        for i, (up, at) in own.items():
            below.setdefault(up, []).append((at, i))
        stack, order = [(0, i) for _, i in sorted(below.get(None, []), reverse=True)], []
        while stack:
            depth, i = stack.pop()
            order.append(i)
            want[run, i] = [depth, 1, len(order)]
            stack += [(depth + 1, j) for _, j in sorted(below.get(i, []), reverse=True)]
        for i in reversed(order):
            if own[i][0] is not None:
                want[run, own[i][0]][1] += want[run, i][1]
    df = spark.createDataFrame(rows, "run_id string, span_id long, parent_id long, started_at int")
    got = tree.walk(df, "started_at").collect()
    assert len(got) == len(want) and {(r.run, r.id): [r.depth, r["size"], r.pos] for r in got} == want and not any(r.run == "round" for r in got)
    steps.clear()
    chain = spark.createDataFrame([r for r in rows if r[0] == "deep"], df.schema)
    assert sorted(r.depth for r in tree.walk(chain, "started_at").collect()) == list(range(700))
    assert len(steps) <= (0 if size > 700 else 2 * 6)


def test_waterfall_of_a_small_trace(spark):
    rows = [("r", "root", None, 1000, 2000, None), ("r", "b", "root", 1500, 2000, 1600), ("r", "a", "root", 1100, 1200, None), ("r", "a1", "a", 1120, 1150, None), ("r", "orphan", "gone", 1900, None, None)]
    spans = spark.createDataFrame(rows, "run_id string, span_id string, parent_id string, started_at long, ended_at long, first_token_at long")
    got = {r.span_id: (r.depth, r.pos, r.offset_pct, r.width_pct, r.ttft_pct) for r in runlog.waterfall(spans).collect()}
    assert got == {"root": (0, 1, 0.0, 100.0, None), "a": (1, 2, 10.0, 10.0, None), "a1": (2, 3, 12.0, 3.0, None), "b": (1, 4, 50.0, 50.0, 20.0), "orphan": (0, 5, 90.0, 0.0, None)}


def actions_of(n, seed=4):
    rng = random.Random(seed)
    return [(None if i % 11 == 0 else 0 if i % 2 else rng.randrange(1, 9), i, rng.choice(["accept", "start", "complete", "reject", "cancel", "odd", None]), rng.choice(["viewer", "streamer", "system", None])) for i in range(n)]


def test_orders_folded_apart(spark, monkeypatch):
    df = spark.createDataFrame(actions_of(2000), "k long, n int, act string, who string").repartition(5)
    rows = lambda x: sorted(tuple(map(str, r)) for r in x.collect())
    assert rows(folds.run_orders_apart(df, "k", ["n"], "act", "who")) == rows(folds.run_orders(df, "k", "n", "act", "who"))
    # tables compose in any grouping
    rng = random.Random(5)
    one = lambda: folds.transition(rng.choice(["accept", "start", "complete", "cancel"]), rng.choice(["viewer", "streamer"]))
    then = lambda a, b: (b[0][a[0]], a[1] + b[1][a[0]])
    for _ in range(50):
        a, b, c = one(), one(), one()
        left, right = then(then(a, b), c), then(a, then(b, c))
        assert (left[0] == right[0]).all() and (left[1] == right[1]).all()


def test_a_price_that_is_not_known_is_refused(spark):
    rows = [("a", 1, 1, None), ("a", 2, 2, 5.0), ("a", 3, 3, 9.0), ("a", 4, 4, float("nan")), ("a", 5, 5, 5.0)]
    got = {r.tie: r.reason for r in folds.admit(spark.createDataFrame(rows, "k string, at int, tie int, price double"), "k", "at", "tie", "price", 9, 10.0).collect()}
    assert got == {1: "tickets_insufficient", 2: None, 3: "tickets_insufficient", 4: "tickets_insufficient", 5: None}


BASE = datetime.datetime(2024, 1, 1)


@pytest.fixture
def stateful(spark):
    for k, v in orders.CONF.items():
        spark.conf.set(k, v)
    yield
    for k in orders.CONF:
        spark.conf.unset(k)


def run_stream(df, name, where, mode="update"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_order_machine_of_a_stream(spark, stateful, tmp_path):
    """In three triggers, the last state of each order is that of the fold over all rows at once."""
    schema = "order_id long, tie int, action string, actor string, ts timestamp"
    rows = [(k or 0, i, act, who, BASE + datetime.timedelta(milliseconds=i)) for k, i, act, who in actions_of(300)]
    for a in range(0, 300, 100):
        spark.createDataFrame(rows[a : a + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}
    for r in run_stream(orders.order_states(stream), "machine", str(tmp_path / "c")).collect():
        if r.order_id not in last or r.applied >= last[r.order_id][2]:
            last[r.order_id] = (r.status, r.funds, r.applied)
    want = folds.run_orders(spark.createDataFrame(rows, schema), "order_id", "tie", "action", "actor").collect()
    assert last == {r.order_id: (r.status, r.funds, r.applied) for r in want}


def test_deadlines_of_a_stream(spark, stateful, tmp_path):
    schema = "order_id long, tie int, action string, actor string, ts timestamp"
    at = lambda m: BASE + datetime.timedelta(minutes=m)
    parts = [[(1, 1, "open", "viewer", at(0)), (2, 1, "accept", "streamer", at(1)), (3, 1, "accept", "streamer", at(1)), (3, 2, "start", "streamer", at(2))], [(9, 1, "open", "viewer", at(20 + 10))], [(9, 2, "accept", "streamer", at(31))], [(8, 1, "accept", "viewer", at(55))], [(8, 2, "start", "viewer", at(56))]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [tuple(r) for r in run_stream(orders.order_states(stream), "deadlines", str(tmp_path / "c")).collect()]
    assert (1, "cancelled", "refunded", 1, True) in got  # not accepted within a quarter of an hour
    assert (2, "cancelled", "refunded", 2, True) in got  # accepted but not started
    assert not [r for r in got if r[0] in (3, 8) and r[4]]


def test_commits_are_whole_and_happen_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    runs = lambda *r: spark.createDataFrame(list(r), "id int, status string")
    spans = lambda *r: spark.createDataFrame(list(r), "id int, span string")
    assert versioned.commit(path, {"runs": runs((1, "ok"), (2, "ok")), "spans": spans((1, "a"), (1, "b"), (2, "c"))}, "s", 0) == 1
    # the batch again changes nothing
    assert versioned.commit(path, {"runs": runs((1, "x")), "spans": spans((1, "x"))}, "s", 0) == 1
    # a writer that dies between data and manifest leaves the table as it was, and may try again
    with monkeypatch.context() as m:
        m.setattr(versioned, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            versioned.commit(path, {"runs": runs((1, "error")), "spans": spans((1, "d"))}, "s", 1)
    state = lambda v=None: ({tuple(r) for r in versioned.latest(versioned.read(spark, path, "runs", v), ["id"]).collect()}, {tuple(r) for r in versioned.latest(versioned.read(spark, path, "spans", v), ["id"], versioned.read(spark, path, "runs", v)).collect()})
    first = ({(1, "ok"), (2, "ok")}, {(1, "a"), (1, "b"), (2, "c")})
    assert state() == first
    assert versioned.commit(path, {"runs": runs((1, "error")), "spans": spans((1, "d"))}, "s", 1) == 2
    assert state() == ({(1, "error"), (2, "ok")}, {(1, "d"), (2, "c")}) and state(1) == first
    # a run that comes again without spans has none
    versioned.commit(path, {"runs": runs((2, "again")), "spans": spans()}, "s", 2)
    assert state()[1] == {(1, "d")}
    assert versioned.compact(spark, path, {"runs": ["id"], "spans": ["id"]}, {"spans": "runs"}) == 4 and state()[0] == {(1, "error"), (2, "again")}
    # of two writers of one version, one wins
    held = versioned.manifest(spark, path) | {"version": 5}
    versioned._publish(spark, path, held)
    with pytest.raises(Exception, match="(?i)exist"):
        versioned._publish(spark, path, held)


def test_a_stream_into_a_versioned_table_and_its_replay(spark, tmp_path):
    schema = "id long, v long"
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).select("id", (F.col("id") % 3).alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(versioned.sink(path, "w")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    run()
    assert versioned.read(spark, path, "rows").count() == 30
    # the stream forgets that it was there, and sends every batch again
    shutil.rmtree(tmp_path / "c")
    run()
    assert versioned.read(spark, path, "rows").count() == 30 and versioned.manifest(spark, path)["version"] == 3


def test_frames_cut_across_files(spark, tmp_path):
    spark.dataSource.register(frames.EventFrames)
    whole = b"".join(frames.frame({"k": i, "t": "ü" * (i % 7)}, "note" if i % 2 else None, str(i)) for i in range(200)) + b": a comment\n\ndata: one\ndata: two\n\n"
    rng = random.Random(6)
    cuts = sorted(rng.sample(range(1, len(whole)), 12))
    folder = tmp_path / "log"
    folder.mkdir()
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(whole)])):
        (folder / f"{n:03}.log").write_bytes(whole[a:b])
    for stretch in (1, 37, 1000, 1 << 20):
        got = spark.read.format("event_frames").option("stretch", max(stretch, 20)).load(str(folder)).collect()
        ids = sorted((int(r.id) for r in got if r.id is not None))
        assert ids == list(range(200)) and len(got) == 201 and [r.data for r in got if r.id is None] == ["one\ntwo"]
        assert all((r.event == "note") == bool(int(r.id) % 2) for r in got if r.id is not None)


def test_frames_as_a_stream(spark, tmp_path):
    spark.dataSource.register(frames.EventFrames)
    folder = tmp_path / "log"
    folder.mkdir()
    whole = b"".join(frames.frame({"k": i}, None, str(i)) for i in range(30))
    cut = len(whole) // 2 + 3
    (folder / "0.log").write_bytes(whole[:cut])  # in the middle of a frame

    def read():
        df = spark.readStream.format("event_frames").load(str(folder))
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(int(r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = read()
    assert first == list(range(len(first))) and 10 < len(first) < 30
    (folder / "1.log").write_bytes(whole[cut:])
    assert read() == list(range(30))


def test_replayed_files_change_nothing(spark, tmp_path):
    at = lambda m: BASE + datetime.timedelta(minutes=m)
    runs, spans = "run_id long, status string, ts timestamp", "run_id long, span_id string, ts timestamp"
    rows = {"runs": [(1, "ok", at(0)), (2, "ok", at(1)), (3, "error", at(2))], "spans": [(1, "a", at(1)), (1, "b", at(2)), (2, "c", at(40)), (9, "d", at(1))]}
    later = {"runs": [(99, "ok", at(300))], "spans": [(99, "z", at(300))]}
    for name, schema in (("runs", runs), ("spans", spans)):
        for part in (rows[name], rows[name], later[name], later[name]):  # every file twice
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    got = run_stream(streams.runs_with_spans(read("runs", runs), read("spans", spans)), "joined", str(tmp_path / "c"), "append")
    held = sorted((r.run_id, r.span_id) for r in got.collect() if r.run_id != 99 and r.span_id)
    assert held == [(1, "a"), (1, "b")] and [r.span_id for r in got.collect() if r.run_id == 99] == ["z"]
