"""Late events, sessions and the change feed against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemora.operators import late_events as late
from mnemora.operators import sessions as ses
from mnemora.operators import wal_replay as wal

LOG = "id string, event_type string, user_id string, session_id string, properties string, timestamp double, received_at string"


def log(spark, rows):
    return spark.createDataFrame([(r + (None,) * 7)[:7] for r in rows], LOG)


def event(id_, t, arrival, user="u", kind="a", session=None):
    return (id_, kind, user, session, None, t, arrival)


BASE = 1735689600.0  # 2025-01-01 00:00 UTC


def iso(seconds, zone="+00:00"):
    import datetime as dt

    return dt.datetime.fromtimestamp(BASE + seconds, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f") + zone


def test_outcomes_at_the_boundaries(spark):
    rows = [
        event("on", BASE, iso(3600 + 299.999)),
        event("close", BASE, iso(3600 + 300)),
        event("last", BASE, iso(3600 * 25)),
        event("gone", BASE, iso(3600 * 25 + 0.001)),
        event("early", BASE + 10, iso(-60)),
    ]
    got = {r.id: r.outcome for r in late.slice_events(log(spark, rows)).collect()}
    assert got == {"on": "on_time", "close": "corrected", "last": "corrected", "gone": "dropped", "early": "on_time"}


def test_units_notations_and_unusable_rows(spark):
    rows = [
        event("s", BASE + 1.5, iso(2)),
        event("ms", (BASE + 1.5) * 1e3, str(BASE + 2)),
        event("us", (BASE + 1.5) * 1e6, "2025-01-01 05:30:02.000+05:30"),
        event("z", BASE, "2025-01-01T00:00:01.000Z"),
        event("zero", 0.0, iso(1)),
        event("neg", -5.0, iso(1)),
        event("nan", float("nan"), iso(1)),
        event("null", None, iso(1)),
        event("never", BASE, None),
        event("bad", BASE, "soon"),
        event(None, BASE, iso(1)),
        event(" ", BASE, iso(1)),
    ]
    got = {r.id: (r.event_ms, r.arrival_ms) for r in late.slice_events(log(spark, rows)).collect()}
    ms = int(BASE * 1000)
    assert got == {"s": (ms + 1500, ms + 2000), "ms": (ms + 1500, ms + 2000), "us": (ms + 1500, ms + 2000), "z": (ms, ms + 1000)}


def test_redelivery_counts_once_by_the_earliest_arrival(spark):
    rows = [event("x", BASE, iso(90000)), event("x", BASE, None), event("x", BASE, iso(3600 * 2)), event("x", BASE, iso(3600 * 2))]
    got = late.slice_events(log(spark, rows)).collect()
    assert [(r.id, r.outcome) for r in got] == [("x", "corrected")]


def test_windows_and_revisions_from_panes(spark):
    rows = [event("a", BASE, iso(1)), event("b", BASE + 3600, iso(3601)), event("c", BASE + 1, iso(3600 * 3)), event("d", BASE + 2, iso(3600 * 3 + 5))]
    sliced = late.slice_events(log(spark, rows))
    w = {r.window_start: (r.at_close, r.events) for r in late.compose_windows(late.pane_counts(late.pane_partials(sliced)), size_panes=2).collect()}
    ms = int(BASE * 1000)
    assert w == {ms - 3600000: (1, 3), ms: (2, 4), ms + 3600000: (1, 1)}
    r = sorted((x.pane_start, x.revision, x.events) for x in late.revisions(late.pane_partials(sliced)).collect())
    assert r == [(ms, 0, 1), (ms, 1, 3), (ms + 3600000, 0, 1)]


def test_pane_store_emits_only_touched_windows_and_survives_a_repeat(spark, tmp_path):
    store = late.PaneStore(spark, f"file://{tmp_path}/panes")
    store.apply(log(spark, [event("a", BASE, iso(1)), event("b", BASE + 7200, iso(7201))]), 0)
    late_row = log(spark, [event("c", BASE + 5, iso(3600 * 2)), event("a", BASE, iso(9))])
    for _ in range(2):  # the batch is run again
        out = [(r.window_start, r.at_close, r.events) for r in store.apply(late_row, 1).collect()]
        assert out == [(int(BASE * 1000), 1, 2)]
    assert sum(r.on_time + r.corrected for r in store.panes().collect()) == 3
    assert sorted((r.id, r.outcome) for r in store.events().collect()) == [("a", "on_time"), ("b", "on_time"), ("c", "corrected")]


def test_pane_store_reads_only_the_days_a_batch_touches(spark, tmp_path):
    store = late.PaneStore(spark, f"file://{tmp_path}/panes")
    store.apply(log(spark, [event(f"d{k}", BASE + k * 86400, iso(k * 86400 + 1)) for k in range(5)]), 0)
    held = store._batches()["0"]
    assert len(held["days"]) == 5
    assert len(store._index({"0": held}, {held["days"][0]}).inputFiles()) == 1
    assert store.apply(log(spark, [event("d0", BASE, iso(50))]), 1).count() == 0  # an id that came before changes no pane
    assert late.PaneStore(spark, f"file://{tmp_path}/none").panes().count() == 0


def test_empty_log(spark):
    empty = log(spark, [])
    assert late.slice_events(empty).count() == 0
    assert ses.merge(ses.pieces(ses.actor_events(empty))).count() == 0


def brute_sessions(rows):
    one = {}
    for id_, _, user, session, _, t, _ in rows:
        actor = (user or "").strip().lower() or (session or "").strip().lower()
        if actor and actor != "default" and t and t > 0:
            one[id_] = (actor, round(t * 1000))
    out, by = [], {}
    for id_, (actor, ms) in one.items():
        by.setdefault(actor, []).append((ms, id_))
    for actor, xs in by.items():
        xs.sort()
        run = [xs[0]]
        for x in xs[1:]:
            if x[0] - run[-1][0] > ses.GAP_MS:
                out.append((actor, run[0][1], run[-1][1], len(run)))
                run = []
            run.append(x)
        out.append((actor, run[0][1], run[-1][1], len(run)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_in_batches_equal_sessions_at_once(spark, tmp_path, seed):
    rng = random.Random(seed)
    users = ["A", " a ", "b", None, "", "default"]
    rows = [event(f"e{k:04}", BASE + rng.randrange(0, 200) * 600.0, None, rng.choice(users), session=rng.choice(["s1", "DEFAULT", None, " S1"])) for k in range(300)]
    # an id redelivered in a later batch keeps its time and its actor
    parts = [rows[:120], rows[120:200] + rows[:30], rows[200:] + rows[150:160], []]
    table = ses.SessionTable(spark, f"file://{tmp_path}/t{seed}")
    for p in parts:
        table.apply(log(spark, p))
    got = sorted((r.actor, r.first_id, r.last_id, r.events) for r in table.read().collect())
    assert got == brute_sessions(rows)


def test_a_batch_writes_only_the_sessions_it_touches(spark, tmp_path):
    rows = [event(f"e{k:04}", BASE + k * 7200, None, "u" + str(k % 5)) for k in range(100)]
    table = ses.SessionTable(spark, f"file://{tmp_path}/t").apply(log(spark, rows))
    table.apply(log(spark, [event("x1", BASE + 60, None, "u0"), event("x2", BASE + 99 * 7200 + 60, None, "u4")]))
    assert spark.read.parquet(f"file://{tmp_path}/t/sessions-2").count() == 2
    assert spark.read.parquet(f"file://{tmp_path}/t/gone-2").count() == 2
    before = sorted(map(tuple, table.read().collect()))
    assert len(before) == 100 and sorted(map(tuple, table.compact().read().collect())) == before


def test_gap_is_inclusive_and_ties_go_by_id(spark):
    rows = [event("b", BASE, None), event("a", BASE, None), event("c", BASE + 1800, None), event("d", BASE + 3600.001, None)]
    got = ses.merge(ses.pieces(ses.actor_events(log(spark, rows)))).collect()
    assert sorted((r.first_id, r.last_id, r.events) for r in got) == [("a", "c", 3), ("d", "d", 1)]


WAL = "id bigint, clock bigint, origin string, mutation string, ts double"


def brute_wal(rows):
    changes = {}
    for _, clock, origin, text, _ in rows:
        try:
            j = json.loads(text)
        except (TypeError, ValueError):
            continue
        if isinstance(j, dict) and clock is not None:
            changes[(clock, origin)] = j
    live = {}
    for at in sorted(changes):
        j = changes[at]
        op, b = (j.get("op") or j.get("action") or "").lower(), j.get("payload") or j.get("data") or j
        ids = b.get("node_ids") or [b.get("node_id")]
        for n in ids:
            if op in wal.ADD:
                live[n] = [at, b.get("content"), b.get("salience")]
            elif op in wal.UPDATE and n in live:
                live[n][0] = at
                for k, f in ((1, "content"), (2, "salience")):
                    if f in b:
                        live[n][k] = b[f]
            elif op in wal.DELETE:
                live.pop(n, None)
    return {n: (c, o, x, s) for n, ((c, o), x, s) in live.items()}


@pytest.mark.parametrize("seed", [3, 4])
def test_replay_equals_a_sequential_fold(spark, seed):
    rng, rows = random.Random(seed), []
    for k in range(400):
        op = rng.choice(["add_node", "CREATE", "insert", "update", "patch", "update_node", "delete", "remove", "consolidate"])
        body = {"node_ids": [f"n{rng.randrange(12)}" for _ in range(2)]} if op in ("delete", "consolidate") else {"node_id": f"n{rng.randrange(12)}"}
        if op.lower() in wal.ADD or rng.random() < 0.5:
            body["content"] = f"t{k}"
        if rng.random() < 0.5:
            body["salience"] = k / 400
        j = rng.choice([{"op": op, "payload": body}, {"op": op, **body}, {"action": op, "data": body}])
        text = json.dumps(j)
        row = (k, rng.randrange(1, 120), f"o{k}", text, None)
        rows += [row, (1000 + k, *row[1:3], text[: len(text) // 2] if rng.random() < 0.5 else json.dumps(j, indent=1), None)]
    rows += [(9999, None, "o", '{"op": "add", "node_id": "x"}', None), (9998, 5, "zz", "[1, 2]", None), (9997, 5, "zy", None, None)]
    rng.shuffle(rows)
    got = {r.node_id: (r.clock, r.origin, r.content, r.salience) for r in wal.live_nodes(spark.createDataFrame(rows, WAL)).collect()}
    assert got == brute_wal(rows)


def test_open_feed_holds_changes_behind_a_gap(spark):
    add = lambda k: json.dumps({"op": "add", "node_id": f"n{k}"})
    rows = [(k, k, "o", add(k), None) for k in (1, 2, 3, 5, 6)]
    df = spark.createDataFrame(rows, WAL)
    assert wal.watermark(wal.parse_changes(df), block=2) == 3
    assert wal.watermark(wal.parse_changes(df)) == 3
    assert sorted(r.node_id for r in wal.live_nodes(df, closed=False).collect()) == ["n1", "n2", "n3"]
    assert wal.live_nodes(df).count() == 5
    assert wal.live_nodes(df, upto=2).count() == 2
    assert wal.live_nodes(spark.createDataFrame([], WAL)).count() == 0
    assert wal.live_nodes(df.withColumn("node_id", F.lit("clash")).withColumn("content", F.lit(1))).count() == 5


def test_replica_holds_gaps_and_equals_one_pass_at_the_end(spark, tmp_path):
    rng, rows = random.Random(8), []
    for k in range(1, 61):
        if k in (17, 18, 40):
            continue  # clocks that come late or never
        op = rng.choice(["add", "update", "delete"])
        rows.append((k, k, f"o{k % 2}", json.dumps({"op": op, "node_id": f"n{rng.randrange(6)}", "content": f"t{k}", "salience": k / 60}), None))
    late_rows = [(900, 17, "o1", json.dumps({"op": "add", "node_id": "n1", "content": "late"}), None), (901, 18, "o0", json.dumps({"op": "delete", "node_id": "n2"}), None)]
    r = wal.Replica(spark, f"file://{tmp_path}/replica")
    frame = lambda x: spark.createDataFrame(x, WAL)
    state = lambda df: {x.node_id: (x.clock, x.origin, x.content, x.salience) for x in df.collect()}
    assert r.read().count() == 0
    r.apply(frame(rows[:30]), 0)
    assert r.manifest()["watermark"] == 16
    assert state(r.live()) == brute_wal([x for x in rows if x[1] <= 16])
    r.apply(frame(rows[:30]), 0)  # a batch that is done already
    r.apply(frame(late_rows + rows[5:8]), 1)  # the gap closes; repeats of committed changes alter nothing
    assert r.manifest()["watermark"] == 31  # o1 has not reached 32
    r.apply(frame(rows[30:]), 2)
    assert r.manifest()["watermark"] == 39
    assert state(r.live()) == brute_wal([x for x in rows + late_rows if x[1] <= 39])
    r.close().compact()
    assert state(r.live()) == brute_wal(rows + late_rows) and len(r.manifest()["parts"]) == 1


def test_an_origin_that_lags_holds_the_watermark(spark, tmp_path):
    add = lambda k: json.dumps({"op": "add", "node_id": f"n{k}"})
    r = wal.Replica(spark, f"file://{tmp_path}/r").apply(spark.createDataFrame([(1, 1, "a", add(1), None), (2, 1, "b", add(2), None), (3, 2, "a", add(3), None), (4, 3, "a", add(4), None)], WAL), 0)
    assert r.manifest()["watermark"] == 1  # b may still send clocks 2 and 3
    assert r.apply(spark.createDataFrame([(5, 3, "b", add(5), None)], WAL), 1).manifest()["watermark"] == 3


def test_copies_that_differ_count_as_one_of_them(spark):
    rows = [(1, 1, "a", json.dumps({"op": "add", "node_id": "n", "content": "x", "salience": 0.1}), None), (2, 1, "a", json.dumps({"op": "add", "node_id": "n", "content": "y", "salience": 0.9}), None),
            (3, 2, "a", json.dumps({"op": "noop", "node_id": "m"}), None), (4, 2, "a", json.dumps({"op": "add", "node_id": "m"}), None)]
    got = {r.node_id: (r.content, r.salience) for r in wal.live_nodes(spark.createDataFrame(rows, WAL)).collect()}
    assert got["n"] in {("x", 0.1), ("y", 0.9)} and "m" in got


def test_watermark_stops_at_a_missing_block(spark):
    add = lambda k: json.dumps({"op": "add", "node_id": f"n{k}"})
    for clocks, want in [((1, 2, 5, 6), 2), ((3, 4), 0), ((1, 2, 3, 4), 4), ((1, 2, 5), 2), ((1, 2, 3, 4, 7, 8, 9), 4), ((), 0)]:
        df = spark.createDataFrame([(k, k, "o", add(k), None) for k in clocks], WAL)
        assert wal.watermark(wal.parse_changes(df), block=2) == want
        assert wal.watermark(wal.parse_changes(df.where("clock > 1")), after=1, block=2) == max(want, 1)
    for clocks in ([*range(1, 11), *range(21, 31)], [*range(1, 11), *range(21, 26)]):
        df = spark.createDataFrame([(k, k, "o", add(k), None) for k in clocks], WAL)
        assert wal.watermark(wal.parse_changes(df), block=10) == 10
