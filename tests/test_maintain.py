"""Maintenance equals recomputing; routing, sequencing and the engine's protocol; the stream exactly once."""

import json

import pandas as pd
from pyspark.sql import functions as F

from tests.fixtures import ITEM, SCHEMA, change, frame, item
from viewtide.functions import wire
from viewtide.operators import changes as ch
from viewtide.operators.client import Client
from viewtide.operators.overlay import MutationLog, Pusher
from viewtide.operators.replica import Replica, membership_index
from viewtide.plans.planner import plan_query
from viewtide.plans.query import q
from viewtide.plans.schema import KEY, Column, Parent, Table, compile_schema
from viewtide.sources.fills import parent_index
from viewtide.streaming.engine import Engine, for_session
from viewtide.streaming.pipeline import ChangeStream, Watch, numbered, sequenced_stream

def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


T = compile_schema([Table("t", ("id",), (Column("id", "string"), Column("org", "string", True)), "org")])
PC = compile_schema([Table("p", ("id",), (Column("id", "string"), Column("org", "string", True)), "org"), Table("c", ("id",), (Column("id", "string"), Column("pid", "string", True)), Parent("pid", "p"))])


def routed(spark, schema, transactions, index=None):
    rows = [(i, f"g{i}", o, t, op, None if b is None else json.dumps(b), None if a is None else json.dumps(a)) for i, tx in enumerate(transactions) for o, (t, op, b, a) in enumerate(tx)]
    return ch.route(spark.createDataFrame(rows, "stream_index long, gtid string, ord int, tbl string, op string, before string, after string"), schema, index)


def test_router_table(spark):
    r = lambda org: {"id": "a", "org": org}
    out = routed(spark, T, [[("t", "insert", None, r("o1")), ("t", "update", r("o1"), r("o2")), ("t", "delete", r("o2"), None), ("t", "insert", None, r(None)), ("t", "update", r("o2"), {"id": "b", "org": "o2"})]])
    got = sorted((x.ord, x.turn, x.partition, x.op, x.key, x.before is not None, x.after is not None) for x in out.collect())
    assert got == [(0, 0, "o1", "insert", '["a"]', False, True), (1, 0, "o1", "delete", '["a"]', True, False), (1, 1, "o2", "insert", '["a"]', False, True), (2, 0, "o2", "delete", '["a"]', True, False), (3, 0, None, "insert", '["a"]', False, True), (4, 0, "o2", "update", '["b"]', True, True)]
    assert {x.outcome: x.changes for x in ch.counters(out).collect()} == {"routed": 3, "moved": 1, "unpartitioned": 1}


def test_children_follow_their_parents_as_of_the_transaction(spark):
    p = lambda i, org: {"id": i, "org": org}
    k = lambda i, pid: {"id": i, "pid": pid}
    script = [
        [("c", "insert", None, k("c1", "p1")), ("p", "insert", None, p("p1", "A"))],  # the parent comes in the same transaction
        [("c", "insert", None, k("c0", "p1"))],
        [("p", "insert", None, p("p2", "B"))],
        [("c", "update", k("c1", "p1"), k("c1", "p2"))],  # a move
        [("c", "insert", None, k("c9", "nobody"))],
        [("p", "update", p("p1", "A"), p("p1", "B"))],
        [("c", "insert", None, k("c7", "p1"))],
        [("c", "insert", None, k("c8", None)), ("c", "insert", None, k("c5", "old"))],
    ]
    index = spark.createDataFrame([("p", "old", "Z")], "tbl string, parent_key string, partition string")
    out = ch.sequence(r := routed(spark, PC, script, index))
    got = {}
    for x in out.orderBy("seq", "ord", "turn").collect():
        got.setdefault(x.partition, []).append((x.key[2:-2], x.op, x.seq))
    assert got == {
        "A": [("c1", "insert", 1), ("p1", "insert", 1), ("c0", "insert", 2), ("c1", "delete", 3), ("p1", "delete", 4)],
        "B": [("p2", "insert", 1), ("c1", "insert", 2), ("p1", "insert", 3), ("c7", "insert", 4)],
        "Z": [("c5", "insert", 1)],
    }
    assert {x.outcome: x.changes for x in ch.counters(r).collect()} == {"routed": 6, "moved": 2, "unresolved": 1, "unpartitioned": 1}


def test_statuses_of_a_batch(spark):
    b = spark.createDataFrame([("a", 3, "g3"), ("a", 4, "x"), ("a", 5, "g5"), ("a", 7, "g7"), ("a", 8, "g8"), ("new", 9, "h9"), ("new", 10, "h10"), ("new", 12, "h12")], "partition string, seq long, gtid string")
    applied, log = spark.createDataFrame([("a", 4)], "partition string, seq long"), spark.createDataFrame([("a", 3, "g3"), ("a", 4, "g4")], "partition string, seq long, gtid string")
    got = [r.status for r in ch.deduplicated(b, applied, log).orderBy("partition", "seq").collect()]
    assert got == ["duplicate", "conflict", "new", "gap", "new", "new", "new", "gap"]
    put, aside = ch.quarantine(b, spark.createDataFrame([("a",)], "partition string"))
    assert put.count() == 3 and aside.count() == 5


def test_sequences_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(ch, "STRETCH", 4)
    rows = spark.range(40).selectExpr("if(id % 3 = 0, 'a', 'b') partition", "id stream_index").unionByName(spark.createDataFrame([(None, 5)], "partition string, stream_index long"))
    got = ch.sequence(rows, spark.createDataFrame([("b", 100)], "partition string, seq long")).orderBy("partition", "stream_index").collect()
    assert [(r.partition, r.seq) for r in got] == [("a", i + 1) for i in range(14)] + [("b", i + 101) for i in range(26)]


def test_assembled_as_a_plan(spark, monkeypatch):
    monkeypatch.setattr(ch, "STRETCH", 3)
    events = [("s", 0, "begin", None, None, None, None, 5), ("s", 1, "row", "t", None, "{}", None, None), ("s", 2, "vgtid", None, None, None, "p1", None), ("s", 3, "commit", None, None, None, None, None), ("s", 4, "begin", None, None, None, None, 6), ("s", 5, "row", "t", "{}", None, None, None), ("s", 6, "rollback", None, None, None, None, None), ("u", 1, "vgtid", None, None, None, "p9", None)]
    rows = ch.assemble(spark.createDataFrame(events, "shard string, ord int, type string, tbl string, before string, after string, position string, timestamp long")).collect()
    assert [(r.shard, r.stream_index, r.position, r.commit_timestamp, [c.op for c in r.changes]) for r in rows] == [("s", 1, "p1", 5, ["insert"])]


def test_bad_cells_are_named(spark):
    t = Table("t", ("id",), (Column("id", "int"), Column("b", "bigint", True), Column("f", "float", True), Column("j", "json", True), Column("e", "string", True, source_type="enum('A')"), Column("s", "string", True, source_type="set('x','y')")))
    rows = [("1", "18446744073709551615", "nan", "{", "2", "4"), ("9007199254740992", "-9", "1e3", '{"a":[1]}', "1", "3"), (None, None, None, None, None, None)]
    got = ch.normalize(spark.createDataFrame(rows, "id string, b string, f string, j string, e string, s string"), t).collect()
    assert [r.bad for r in got] == [["b", "f", "j", "e", "s"], ["id"], ["id"]]
    assert (got[1].b, got[1].f, got[1].e, got[1].s) == (-9, 1000.0, "A", "x,y")


def test_sets_of_sixty_four_members(spark):
    members = [f"m{i}" for i in range(64)]
    t = Table("t", ("id",), (Column("id", "int"), Column("s", "string", True, source_type=f"set({','.join(repr(m) for m in members)})")))
    masks = [0, 1, 2**63, 2**64 - 1, 2**62 + 2, None]
    rows = [(str(i), None if m is None else str(m)) for i, m in enumerate(masks)] + [("90", str(2**64)), ("91", "-1"), ("92", "x"), ("93", "1.5")]
    got = {r.id: (r.s, r.bad) for r in ch.normalize(spark.createDataFrame(rows, "id string, s string"), t).collect()}
    for i, m in enumerate(masks):
        assert got[i] == (None if m is None else ",".join(members[b] for b in range(64) if m >> b & 1), [])
    assert all(got[i][1] == ["s"] for i in (90, 91, 92, 93))


def batch(engine, *transactions, **other):
    return {"protocol": 1, "schema_hash": SCHEMA.hash, "epoch": 0, "partition": "", "transactions": [{"seq": s, "gtid": f"{U}:{s}", "changes": list(c)} for s, c in transactions]} | other


U = "a2523813-adbe-11f1-b19c-0a2250a7ed6c"


def put(engine, row, before=None):
    return change("insert" if before is None else "update", before, row)


def test_engine(spark):
    e = Engine(spark, SCHEMA)
    docs = q("item").where(lambda c: c.eq("type", "DOCUMENT")).order_by("displayOrder").limit(2)
    key, events = e.subscribe(docs.query)
    assert events == [] and e.subscriptions[key].status == "pending" and e.subscribe(docs.query)[0] == key
    a, b, c_ = item("a", displayOrder=1), item("b", displayOrder=2), item("c", displayOrder=3)
    # Changes come while the table fills: one that the fill has, and one that it hasn't.
    ack, deltas = e.apply_batch(batch(e, (4, [put(e, a)]), (5, [put(e, c_)])))
    assert ack == {"applied_seq": 5, "duplicates": 0} and not deltas[0].changed
    fill = e.scopes["item"].fill_id
    assert e.fill(fill, frame(spark, [b])) and not e.fill(99, frame(spark, [b]))
    again = e.retry(fill)
    assert e.complete(fill, "x") == [] and e.fill(again, frame(spark, [a | {"displayOrder": 1}, b]))
    (snapshot,) = e.complete(again, f"{U}:1-4")
    assert snapshot.cursor == 5 and {r.id for r in snapshot.rows["item"].collect()} == {"a", "b"} and {r.id for r in e.tables["item"].collect()} == {"a", "b", "c"}
    # The window refills when a member leaves it; duplicates are counted, gaps and conflicts refused.
    ack, (delta,) = e.apply_batch(batch(e, (5, [put(e, c_)]), (6, [change("delete", a, None)])))
    assert ack == {"applied_seq": 6, "duplicates": 1}
    assert rows_of(delta.changed[key]) == [("item", '["a"]', "removed"), ("item", '["c"]', "added")]
    assert {r[KEY]: r.image and r.image.id for r in delta.rows["item"].collect()} == {'["a"]': None, '["c"]': "c"}
    changed, rows = for_session(delta, {key}, {"item": ["id", "title"]})
    assert set(changed) == {key} and [f.name for f in rows["item"].schema["image"].dataType.fields] == ["id", "title"]
    assert e.apply_batch(batch(e, (8, [])))[0]["rejected"] == "gap"
    bad = batch(e, (6, []))
    bad["transactions"][0]["gtid"] = "other"
    assert e.apply_batch(bad)[0]["rejected"] == "conflict"
    for wrong, reason in (({"protocol": 2}, "protocol_version"), ({"schema_hash": "x"}, "schema_mismatch"), ({"partition": "x"}, "wrong_partition"), ({"epoch": -1}, "stale_epoch")):
        assert e.apply_batch(batch(e, (7, []), **wrong))[0] == {"rejected": reason}
    # A transaction with a bad row does nothing at all.
    ack, _ = e.apply_batch(batch(e, (7, [put(e, item("z", displayOrder=0)), {"table": "item", "op": "insert", "before": None, "after": None}])))
    assert ack["rejected"] == "invalid_row" and e.applied == 6 and e.tables["item"].count() == 2
    assert rows_of(e.subscriptions[key].members) == rows_of(e.recompute(key))
    # A larger window sends what it has beyond the smaller one.
    larger, (grown,) = e.subscribe(docs.limit(3).query, based_on=key)
    assert grown.base == key and grown.members.count() == 0
    e.unsubscribe(larger, now=0)
    assert e.sweep(now=10) == [] and e.sweep(now=4000) == [larger]
    assert e.status()["rows"] == {"item": 2}
    ack, _ = e.apply_batch(batch(e, (1, [put(e, a)]), epoch=1))
    assert ack["applied_seq"] == 1 and e.subscriptions[key].status == "pending" and e.held["item"].count() == 1


def test_overlay_and_rebase(spark):
    def rename(tx, args, context):
        tx.update("item", (args["id"],), {"title": args["title"]})

    def rekey(tx, args, context):
        tx.update("item", (args[0],), {"id": args[1]})

    def copy(tx, args, context):
        row = tx.get("item", (args,))
        tx.insert("item", row | {"id": "copy", "title": (row["title"] or "") + "!"})

    tables = {"item": frame(spark, [item("a", title="old"), item("b")])}
    log = MutationLog(SCHEMA, {"rename": rename, "rekey": rekey, "copy": copy}, tables)
    log.mutate("rename", {"id": "a", "title": "new"})
    log.mutate("copy", "a")
    log.mutate("rekey", ("b", "c"))
    failed = log.mutate("rename", {"id": "gone", "title": "x"})
    view = lambda: {r.id: r.title for r in log.view("item").collect()}
    assert failed.error and len(log.pending) == 4 and [m["id"] for m in log.request()["mutations"]] == [1, 2, 3, 4]
    assert view() == {"a": "new", "copy": "new!", "c": None}
    # The source confirms the first two, with another title; the rest is replayed over that.
    log.confirm(2, {"item": frame(spark, [item("a", title="theirs"), item("b", title="B"), item("gone")])})
    assert view() == {"a": "theirs", "c": "B", "gone": "x"} and [m.id for m in log.pending] == [3, 4]


def test_stream_is_exactly_once(spark, tmp_path):
    source, folder = tmp_path / "in", f"file://{tmp_path}/state"
    source.mkdir()

    def write(name, *rows):
        lines = [json.dumps({"gtid": f"{U}:{n}", "keyspace": "k", "shard": "0", "position": "", "commit_timestamp": n, "changes": [{"table": "item", "op": "insert", "key": [i], "before": None, "after": json.dumps({"id": i, "org": org})} for i, org in cells]}) for n, cells in rows]
        (source / name).write_text("\n".join(lines))

    from viewtide.sources.tables import read_transactions

    stream = ChangeStream(spark, SCHEMA, folder)
    write("1.json", (1, [("a", "A"), ("b", "B")]), (2, [("c", "A")]))
    run = lambda: stream.start(read_transactions(spark, str(source)), f"file://{tmp_path}/cp").awaitTermination()
    run()
    again = spark.read.schema(read_transactions(spark, str(source)).schema).json(f"{source}/1.json")
    assert stream.taken() == 0 and not stream.take(again, 0)
    stream.put_aside("B", "rejected")
    assert stream.taken() == 0 and not stream.take(again, 0)
    write("2.json", (3, [("d", "A"), ("e", "B")]))
    run()
    assert stream.taken() == 1
    got = sorted((r.partition, r.seq, r.key) for r in stream.changes().collect())
    assert got == [("A", 1, '["a"]'), ("A", 2, '["c"]'), ("A", 3, '["d"]'), ("B", 1, '["b"]')]
    assert [(r.partition, r.seq, r.key) for r in stream.state.read("aside").collect()] == [("B", 2, '["e"]')]


def test_the_stream_keeps_the_source_order(spark, tmp_path, monkeypatch):
    """Lines as they come, whatever their commit times; a file that is sent again changes nothing; parents of earlier batches are found."""
    from viewtide.sources.tables import read_transactions
    from viewtide.streaming import pipeline

    monkeypatch.setattr(pipeline, "COMPACT", 2)
    source, folder = tmp_path / "in", f"file://{tmp_path}/state"
    source.mkdir()

    def line(n, time, *changes):
        return json.dumps({"gtid": f"{U}:{n}", "keyspace": "k", "shard": "0", "position": "", "commit_timestamp": time, "changes": [{"table": t, "op": "insert", "key": [r["id"]], "before": None, "after": json.dumps(r)} for t, r in changes]})

    stream = ChangeStream(spark, PC, folder, position=f"{U}:1-2")
    run = lambda: stream.start(read_transactions(spark, str(source)), f"file://{tmp_path}/cp").awaitTermination()
    (source / "01.json").write_text("\n".join([line(2, 1, ("p", {"id": "seen", "org": "A"})), line(3, 900, ("p", {"id": "p1", "org": "A"})), line(4, 100, ("c", {"id": "c1", "pid": "p1"}))]))
    run()
    (source / "02.json").write_text("\n".join([line(5, 5, ("c", {"id": "c2", "pid": "p1"})), line(6, 4, ("p", {"id": "p1", "org": "B"})), line(7, 3, ("c", {"id": "c3", "pid": "p1"}))]))
    run()
    (source / "03.json").write_text((source / "01.json").read_text() + "\n" + (source / "02.json").read_text())
    run()
    (source / "04.json").write_text(line(8, 0, ("c", {"id": "c4", "pid": "p1"})))
    run()
    got = sorted((r.partition, r.seq, r.key) for r in stream.changes().collect())
    assert got == [("A", 1, '["p1"]'), ("A", 2, '["c1"]'), ("A", 3, '["c2"]'), ("B", 1, '["p1"]'), ("B", 2, '["c3"]'), ("B", 3, '["c4"]')]
    assert str(stream.position()) == f"{U}:1-8" and rows_of(stream.parents()) == [("p", "p1", "B")]
    assert [v for v in range(4) if stream.state.has("parents_whole", v)] == [1, 3]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    """Files that are read in many blocks, and blocks of several files in one task."""
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps({"gtid": f"{name}{i:04d}"}) for i in range(400)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(old, ("3000", "10"), strict=True):
            spark.conf.set(k, v)
        rows = spark.read.schema("gtid string").json(f"file://{tmp_path}").select("gtid", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block"))
        assert rows.rdd.getNumPartitions() > 4
        assert [r.gtid for r in numbered(rows).orderBy("stream_index").collect()] == [f"{n}{i:04d}" for n in "abc" for i in range(400)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sequences_in_the_state_store(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    pd.DataFrame({"partition": ["A", "A", "B"], "stream_index": [3, 1, 2], "gtid": ["g3", "g1", "g2"]}).to_json(tmp_path / "in/1.json", orient="records", lines=True)
    query = lambda: sequenced_stream(spark.readStream.schema("partition string, stream_index long, gtid string").json(f"file://{tmp_path}/in")).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    query()
    pd.DataFrame({"partition": ["A", "A"], "stream_index": [3, 7], "gtid": ["g3", "g7"]}).to_json(tmp_path / "in/2.json", orient="records", lines=True)
    query()
    assert rows_of(spark.read.parquet(f"file://{tmp_path}/out")) == [("A", 1, "g1", 1), ("A", 3, "g3", 2), ("A", 7, "g7", 3), ("B", 2, "g2", 1)]
    assert ITEM.relation("folder").kind == "one"


def test_replica_follows_the_engine(spark):
    e, r = Engine(spark, SCHEMA), Replica(spark, SCHEMA)
    docs = q("item").where(lambda c: c.eq("type", "DOCUMENT")).order_by("displayOrder").limit(2)
    planned = plan_query(SCHEMA, docs.query)
    key, _ = e.subscribe(docs.query)
    e.fill(e.scopes["item"].fill_id, frame(spark, [item("a", displayOrder=1), item("b", displayOrder=2), item("c", displayOrder=3)]))
    (s,) = e.complete(e.scopes["item"].fill_id, "")
    r.apply_snapshot(key, s.cursor, s.rows, s.members)
    ids = lambda **k: [x.id for x in r.read(planned, key, **k).collect()]
    assert ids() == ["a", "b"] and r.tables["item"].count() == 2
    for seq, c in ((1, change("delete", item("a", displayOrder=1), None)), (2, change("update", item("c", displayOrder=3), item("c", displayOrder=0)))):
        _, (d,) = e.apply_batch(batch(e, (seq, [c])))
        r.apply_delta(d.cursor, d.changed, d.rows)
        r.apply_delta(d.cursor, d.changed, d.rows)
    assert ids() == ["c", "b"] and r.cursor == 2 and r.tables["item"].count() == 2
    larger, (g,) = e.subscribe(docs.limit(3).query, based_on=key)
    r.apply_snapshot(larger, g.cursor, g.rows, g.members, g.base)
    assert r.members[larger].count() == 0 and r.members_of(larger).count() == 2
    assert {x[KEY]: x.subscriptions for x in membership_index({"x": r.members[key], "y": r.members_of(larger)}).collect()} == {'["b"]': ["x", "y"], '["c"]': ["x", "y"]}
    log = MutationLog(SCHEMA, {"add": lambda tx, a, ctx: tx.insert("item", item(a, displayOrder=-1))}, r.tables)
    log.mutate("add", "new")
    assert ids(log=log) == ["new", "c"]
    # Released with a time, a subscription is kept until its time is over; a listener hears of what changes meanwhile.
    heard = []
    stop = r.listen(lambda cursor, keys: heard.append((cursor, keys)))
    r.release(key, now=100)
    assert r.status() == {"cursor": 2, "subscriptions": sorted([key, larger]), "released": [key]} and r.sweep(now=399) == []
    _, (d,) = e.apply_batch(batch(e, (3, [put(e, item("first", displayOrder=-5))])))
    r.apply_delta(d.cursor, d.changed, d.rows)
    stop()
    assert heard == [(3, {key, larger})] and r.retain(key) and r.sweep(now=999) == []
    r.release(key, now=1000)
    assert r.sweep(now=1300) == [key] and r.status()["subscriptions"] == [larger] and not r.retain(key)
    r.release(larger)
    assert r.tables["item"].count() == 0


def test_a_client_from_end_to_end(spark):
    """Live queries, an optimistic mutation, its push, the delta that brings it back, and its confirmation."""
    e = Engine(spark, SCHEMA)
    ((fill, _),) = e.ensure({"item"})
    e.fill(fill, frame(spark, [item("a", displayOrder=1, title="x"), item("b", displayOrder=2, title="y")]))
    e.complete(fill, "")
    rename = lambda tx, a, ctx: tx.update("item", (a[0],), {"title": a[1]})
    source = {("item", f'["{i}"]'): item(i, displayOrder=n, title=t) for n, (i, t) in enumerate((("a", "x"), ("b", "y")), 1)}
    receiver = Pusher(SCHEMA, {"rename": rename}, source)
    client = Client(spark, SCHEMA, {"rename": rename}, lambda query, base: e.subscribe(query, base), e.unsubscribe)
    told, outcomes = [], []
    seen = client.live_query(q("item").order_by("displayOrder").limit(1), lambda x: told.append([r.title for r in x.read().collect()]))
    stop = client.on_mutation(lambda m: outcomes.append((m.id, m.error is None)))
    assert [r.title for r in seen.read().collect()] == ["x"] and client.status()["live"] == [seen.key]
    client.mutate("rename", ("a", "mine"))
    client.mutate("rename", ("b", "z"))
    assert told[-1] == ["mine"] and client.status()["pending"] == [1, 2]
    # The second row isn't the client's to see, so its rename fails here, and works at the source.
    assert client.status()["failed"] == [2]
    client.push(receiver.push)
    assert outcomes == [(1, True), (2, True)] and source["item", '["b"]']["title"] == "z"
    changes = [change(c["op"], c["before"], c["after"]) for tx in receiver.transactions for c in tx if c["table"] == "item"]
    _, (delta,) = e.apply_batch(batch(e, (1, changes)))
    client.take(delta)
    client.confirm(2)
    assert client.status()["pending"] == [] and told[-1] == ["mine"] and [r.title for r in client.replica.tables["item"].collect()] == ["mine"]
    larger = client.live_query(q("item").order_by("displayOrder").limit(2), None, seen)
    assert [r.title for r in larger.read().collect()] == ["mine", "z"]
    stop()
    larger.stop(now=10)
    seen.stop(now=10)
    again = client.live_query(q("item").order_by("displayOrder").limit(1))
    assert again.key == seen.key and client.sweep(now=400) == [larger.key] and client.status()["subscriptions"] == [seen.key]
    assert e.subscriptions[larger.key].orphaned is not None and client.read(q("item")).count() == 1


def test_many_rows_are_looked_up_at_once(spark):
    from viewtide.operators.overlay import LocalTransaction

    tx = LocalTransaction(SCHEMA, {"item": frame(spark, [item("a", title="x"), item("b")])}, {})
    tx.insert("item", item("c", title="new"))
    found = tx.get_many("item", [("a",), {"id": "c"}, ("gone",)])
    assert [r and r["title"] for r in found] == ["x", "new", None]
    tx.tables = {}
    assert tx.get("item", ("a",))["title"] == "x" and tx.get("item", ("gone",)) is None


def test_raw_rows_and_parent_index(spark):
    rows = spark.createDataFrame([([1, -1, 0, 2], bytearray(b"abc")), ([1], bytearray(b"")), ([1], bytearray(b"ab")), ([-2], bytearray(b""))], "n array<int>, v binary")
    cells, bad = wire.row_cells(F.col("n"), F.col("v"))
    got = rows.select(cells.alias("c"), bad.alias("bad")).collect()
    assert [r.bad for r in got] == [False, True, True, True] and [x if x is None else bytes(x) for x in got[0].c] == [b"a", None, b"", b"bc"]
    p = PC.table("p")
    index = parent_index(spark.createDataFrame([("p1", "A"), ("p2", None)], "id string, org string"), p)
    assert rows_of(index) == [("p", "p1", "A")]
    w = Watch()
    assert not w.stalled() and w.stalled(w.progress + 31)
