"""The engine's write path: values that can't be stored, folded batches, tiers, restarts; maintenance of queries drawn at random."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.fixtures import ORGANIZATION, SCHEMA, change, frame, item, random_changes, random_item
from viewtide.operators.changes import images_by_table
from viewtide.operators.levels import recompute
from viewtide.operators.maintain import apply_changes, maintain
from viewtide.operators.overlay import Pusher
from viewtide.plans.planner import QueryProblem, plan_query
from viewtide.plans.query import Include, Query, c, q
from viewtide.plans.schema import KEY, Column, Table
from viewtide.sources.keys import KeySet
from viewtide.sources.shared import cut
from viewtide.streaming import state
from viewtide.streaming.engine import Engine

U = "5d1c0a7e-9b58-4c55-a9a1-1c5f2d7e8f90"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def batch(*transactions, **other):
    return {"protocol": 1, "schema_hash": SCHEMA.hash, "epoch": 0, "partition": "", "transactions": [{"seq": s, "gtid": f"{U}:{s}", "changes": list(x)} for s, x in transactions]} | other


def filled(spark, rows, folder=None):
    e = Engine(spark, SCHEMA, folder=folder) if folder is None else Engine.open(spark, SCHEMA, folder)
    for fill, name in e.ensure({"item", "organization"}):
        e.fill(fill, frame(spark, rows) if name == "item" else frame(spark, [{"id": "org_1", "name": "One"}], ORGANIZATION))
        e.complete(fill, "")
    return e


def put(row, before=None):
    return change("insert" if before is None else "update", before, row)


def test_rows_that_cannot_be_stored_refuse_their_transaction(spark):
    """Text in a number, null where a value is needed, an update without an after image: whole transactions, and only from there on."""
    a = item("a", displayOrder=1)
    e = filled(spark, [a])
    text = lambda **x: json.dumps(a | x)
    bad = [
        {"op": "update", "before": json.dumps(a), "after": text(displayOrder="abc")},
        {"op": "update", "before": json.dumps(a), "after": text(big="9223372036854775808")},
        {"op": "update", "before": json.dumps(a), "after": text(createdAt=None)},
        {"op": "update", "before": json.dumps(a), "after": None},
        {"op": "insert", "before": None, "after": None},
        {"op": "delete", "before": None, "after": None, "key": []},
    ]
    for b in bad:
        b = {"table": "item", "key": ["a"]} | b
        good = {"table": "item", "op": "update", "key": ["a"], "before": None, "after": text(title=f"t{e.applied}")}
        ack, deltas = e.apply_batch(batch((e.applied + 1, [good]), (e.applied + 2, [put(item("z")), b]), (e.applied + 3, [put(item("y"))])))
        assert ack["rejected"] == "invalid_row" and ack["table"] == "item" and ack["applied_seq"] == e.applied == deltas[0].cursor
        assert [(r.id, r.displayOrder, r.title) for r in e.tables["item"].collect()] == [("a", 1, f"t{e.applied - 1}")]
    ack, _ = e.apply_batch(batch((e.applied + 1, [{"table": "nowhere", "op": "delete", "key": ["1"], "before": "{}", "after": None}])))
    assert ack["rejected"] == "invalid_row" and ack["why"] == "table is not in the schema"
    # A delete needs its key only.
    ack, _ = e.apply_batch(batch((e.applied + 1, [{"table": "item", "op": "delete", "key": ["a"], "before": None, "after": None}])))
    assert ack["applied_seq"] == e.applied and e.tables["item"].count() == 0


def test_a_batch_is_folded(spark):
    """Two hundred transactions, with keys that change and rows that come and go, are one step for client and subscription."""
    rng, rows = random.Random(8), {}
    for i in [*(f"d{i}" for i in range(8)), "f1", "f2"]:
        rows[i] = random_item(rng, i)
    e = filled(spark, rows.values())
    wanted = [q("item").where(lambda x: x.gt("displayOrder", 1)).order_by("displayOrder").limit(4).include("folder"), q("item").where(lambda x: x.eq("type", "GROUP")).include("documents")]
    keys = [e.subscribe(w.query)[0] for w in wanted]
    before = {k: set(rows_of(e.snapshot(k).members)) for k in keys}
    ack, deltas = e.apply_batch(batch(*((s, random_changes(rng, rows, 2)) for s in range(1, 201))))
    assert ack == {"applied_seq": 200, "duplicates": 0} and len(deltas) == 1 and deltas[0].cursor == 200
    assert {r.id: r.title for r in e.tables["item"].collect()} == {k: r["title"] for k, r in rows.items()}
    for k in keys:
        assert rows_of(e.subscriptions[k].members) == rows_of(e.recompute(k))
        moved = rows_of(deltas[0].changed[k])
        after = set(rows_of(e.snapshot(k).members))
        assert {(t, x) for t, x, kind in moved if kind == "added"} == after - before[k] and {(t, x) for t, x, kind in moved if kind == "removed"} == before[k] - after


def test_tiers_hold_the_last_row_of_each_key(spark, monkeypatch):
    """Few rows to a tier and a bucket, so every merge happens; views and look-ups agree with a dict."""
    for name, n in (("LOCAL", 6), ("GROWTH", 2), ("SHARE", 0.6), ("BUCKET_ROWS", 4)):
        monkeypatch.setattr(state, name, n)
    rng = random.Random(3)
    rows = {f"k{i}": f"v{i}" for i in range(40)}
    live = state.LiveTable(spark, ORGANIZATION, frame(spark, [], ORGANIZATION).schema)
    live.load(frame(spark, [{"id": k, "name": v} for k, v in rows.items()], ORGANIZATION), 40)
    seen = set()
    for step in range(12):
        images = {}
        for _ in range(5):
            k = f"k{rng.randint(0, 50)}"
            gone = rng.random() < 0.3
            images[f'["{k}"]'] = None if gone else json.dumps({"id": k, "name": f"{k} {step}"})
            rows.pop(k, None)
            if not gone:
                rows[k] = f"{k} {step}"
        live.put(images)
        seen.add(len(live.tiers))
        asked = rng.sample(range(55), 9)
        found = live.rows(KeySet(spark, frozenset(f'["k{i}"]' for i in asked)))
        assert {r.id: r.name for r in found.collect()} == {k: v for k, v in rows.items() if int(k[1:]) in asked}
    assert {r.id: r.name for r in live.view().collect()} == rows and len(seen) > 1
    again = state.LiveTable.restored(spark, ORGANIZATION, json.loads(json.dumps(live.state())))
    assert {r.id: r.name for r in again.view().collect()} == rows


def test_an_engine_outlives_its_process(spark, tmp_path):
    """Positions, tables, subscriptions, held changes and logged batches are there again; fills that weren't complete begin anew."""
    folder = f"file://{tmp_path}/engine"
    e = filled(spark, [item("a", displayOrder=1), item("b", displayOrder=2)], folder)
    docs = q("item").order_by("displayOrder").limit(1)
    key, _ = e.subscribe(docs.query)
    e.apply_batch(batch((1, [put(item("c", displayOrder=0))]), (2, [change("delete", item("a", displayOrder=1), None)])))
    again = Engine.open(spark, SCHEMA, folder)
    assert again.applied == 2 and rows_of(again.tables["item"]) == rows_of(e.tables["item"])
    assert rows_of(again.subscriptions[key].members) == [("", "item", '["c"]')]
    assert again.apply_batch(batch((2, [])))[0] == {"applied_seq": 2, "duplicates": 1}
    assert again.apply_batch(batch((4, [])))[0]["rejected"] == "gap"
    # A new stream: the table fills, and what comes meanwhile is held across a restart.
    again.apply_batch(batch((1, [put(item("x", displayOrder=5))]), epoch=1))
    third = Engine.open(spark, SCHEMA, folder)
    assert third.epoch == 1 and third.applied == 1 and third.subscriptions[key].status == "pending" and third.held["item"].count() == 1
    fill = third.scopes["item"].fill_id
    third.fill(fill, frame(spark, [item("y", displayOrder=9)]))
    (snapshot,) = third.complete(fill, "")
    assert {r.id for r in third.tables["item"].collect()} == {"x", "y"} and rows_of(snapshot.members) == [("item", '["x"]')]
    last = Engine.open(spark, SCHEMA, folder)
    assert rows_of(last.tables["item"]) == rows_of(third.tables["item"]) and not last.held


def test_pushes_over_live_tables(spark):
    """The same protocol with rows and confirmed ids in live tables, which a new receiver goes on from."""
    live = {"organization": state.LiveTable(spark, ORGANIZATION, frame(spark, [], ORGANIZATION).schema)}
    live["organization"].load(frame(spark, [{"id": "o", "name": "old"}], ORGANIZATION), 1)
    clients = Table("clients", ("client_id",), (Column("client_id", "string"), Column("last_mutation_id", "bigint")))
    ids = state.LiveTable(spark, clients, frame(spark, [], clients).schema)
    ids.load(frame(spark, [], clients), 0)
    mutators = {"rename": lambda tx, a, ctx: tx.update("organization", [a[0]], {"name": a[1]}), "add": lambda tx, a, ctx: tx.insert("organization", a), "drop": lambda tx, a, ctx: tx.delete("organization", [a])}
    receiver = lambda: Pusher(SCHEMA, mutators, state.LiveRows(live), confirmed=state.LiveIds(ids))
    ask = lambda p, *ms: [o["status"] for o in p.push({"client_id": "c", "partition": "", "mutations": [{"id": i, "name": n, "args": a} for i, n, a in ms]})["outcomes"]]
    assert ask(receiver(), (1, "rename", ["o", "new"]), (2, "add", {"id": "o", "name": "x"}), (3, "add", {"id": "p", "name": "P"})) == ["applied", "failed", "applied"]
    assert ask(receiver(), (3, "drop", "p"), (4, "drop", "o")) == ["duplicate", "applied"]
    assert {r.id: r.name for r in live["organization"].view().collect()} == {"p": "P"} and dict(state.LiveIds(ids)) == {"c": 4}


def test_look_ups_read_the_buckets_of_their_keys(spark, monkeypatch):
    monkeypatch.setattr(state, "BUCKET_ROWS", 10)
    live = state.LiveTable(spark, ORGANIZATION, frame(spark, [], ORGANIZATION).schema)
    live.load(frame(spark, [{"id": f"k{i}", "name": "x"} for i in range(200)], ORGANIZATION), 200)
    found = live.rows(KeySet(spark, frozenset({'["k7"]'})))
    assert len(found.inputFiles()) == 20 and found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "__bucket" in plan.split("PartitionFilters")[1][:120]


def test_frames_are_maintained(spark):
    """The same over plain DataFrames, for changes that are one."""
    rng, rows = random.Random(5), {}
    for i in [*(f"d{i}" for i in range(8)), "f1", "f2"]:
        rows[i] = random_item(rng, i)
    tables = {"item": cut(frame(spark, rows.values())), "organization": cut(frame(spark, [{"id": "org_1", "name": "One"}], ORGANIZATION))}
    planned = plan_query(SCHEMA, q("item").where(lambda x: x.exists("folder")).order_by("displayOrder").limit(3).include("folder", lambda i: i.include("documents")).query)
    members = cut(recompute(planned, tables))
    script = [(i, x["table"], x["op"], x["before"], x["after"]) for i, x in enumerate(random_changes(rng, rows, 6))]
    changes = spark.createDataFrame(script, "ord int, tbl string, op string, before string, after string").withColumn("key", F.lit(None).cast("string"))
    by_table = {"item": cut(images_by_table(changes, SCHEMA, ["ord"], tables, {"item"})["item"])}
    after = apply_changes(tables, by_table)
    assert {r.id for r in after["item"].collect()} == set(rows)
    assert rows_of(maintain(planned, members, after, by_table)) == rows_of(recompute(planned, after))


CELLS = {"id": ["d1", "d5", "f1"], "title": ["a", "B"], "displayOrder": [1, 5, 7], "score": [0.5, 2], "type": ["DOCUMENT", "GROUP"], "groupId": ["f1", "f2"], "createdAt": ["2026-01-01 00:00:00", "2026-01-02 00:00:00"]}
RELATIONS = {"item": {"folder": "item", "organization": "organization", "documents": "item"}, "organization": {}}


def drawn_predicate(rng, table, depth):
    roll = rng.random()
    if table == "organization":
        return c.eq("name", rng.choice(["One", "x"]))
    if depth and roll < 0.3:
        parts = [drawn_predicate(rng, table, depth - 1) for _ in range(rng.randint(1, 2))]
        return rng.choice([lambda: c.and_(*parts), lambda: c.or_(*parts), lambda: c.not_(parts[0])])()
    if depth and roll < 0.6:
        name, target = rng.choice(list(RELATIONS[table].items()))
        inner = {"op": "exists", "relation": name} | ({"where": drawn_predicate(rng, target, depth - 1)} if rng.random() < 0.8 else {})
        return inner if rng.random() < 0.7 else c.not_(inner)
    column = rng.choice(list(CELLS))
    if rng.random() < 0.25:
        return {"op": rng.choice(["isNull", "isNotNull"]), "column": column}
    return {"op": rng.choice(["eq", "ne", "lt", "gte"]), "column": column, "value": rng.choice(CELLS[column])}


def drawn_include(rng, table, depth):
    out = []
    for name, target in RELATIONS[table].items():
        if depth and rng.random() < 0.4:
            out.append(Include(name, drawn_predicate(rng, target, 1) if rng.random() < 0.5 else None, tuple(drawn_include(rng, target, depth - 1))))
    return out


def drawn_query(rng):
    """A query of any shape that the planner takes."""
    while True:
        order = tuple((x, rng.choice(["asc", "desc"])) for x in rng.sample(["displayOrder", "title", "score", "createdAt"], rng.randint(0, 2)))
        query = Query("item", drawn_predicate(rng, "item", 2) if rng.random() < 0.8 else None, order, rng.choice([None, 1, 3, 6]), tuple(drawn_include(rng, "item", 3)))
        try:
            return plan_query(SCHEMA, query)
        except QueryProblem:
            continue


@pytest.mark.parametrize("seed", [11, 37])
def test_drawn_queries_are_maintained(spark, seed):
    """Queries from the grammar, over random batches of one to three transactions: as if evaluated anew, and deltas that add up."""
    rng, rows = random.Random(seed), {}
    for i in [*(f"d{i}" for i in range(8)), "f1", "f2"]:
        rows[i] = random_item(rng, i)
    e = filled(spark, rows.values())
    keys = list({e.subscribe(drawn_query(rng).query)[0] for _ in range(5)})
    told = {k: set(rows_of(e.snapshot(k).members)) for k in keys}
    seq = 0
    for step in range(4):
        transactions = []
        for _ in range(rng.randint(1, 3)):
            seq += 1
            transactions.append((seq, random_changes(rng, rows, rng.randint(1, 4))))
        if step == 2:
            transactions[0][1].append(change("delete", {"id": "org_1", "name": "One"}, None, "organization"))
        ack, (delta,) = e.apply_batch(batch(*transactions))
        assert ack["applied_seq"] == seq and {r.id for r in e.tables["item"].collect()} == set(rows)
        for k in keys:
            assert rows_of(e.subscriptions[k].members) == rows_of(e.recompute(k)), (step, k)
            for t, x, kind in rows_of(delta.changed[k]) if k in delta.changed else []:
                (told[k].add if kind == "added" else told[k].remove)((t, x))
            assert told[k] == set(rows_of(e.snapshot(k).members)), (step, k)
        # Images are those of rows that entered or are members of some query, and nulls for rows that went.
        sent = {r[KEY]: r.image for r in delta.rows["item"].collect()} if "item" in delta.rows else {}
        shown = set().union(*told.values())
        for x, image in sent.items():
            assert (image is None) == (json.loads(x)[0] not in rows) and (image is None or ("item", x) in shown)
