"""What needs no Spark: ids, schemas, the planner, named queries, assembling, the push protocol."""

import dataclasses
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.fixtures import ITEM, ORGANIZATION, SCHEMA
from viewtide.functions import kinds, wire
from viewtide.functions.gtid import BadGtid, GtidSet, step
from viewtide.operators.changes import Assembler, StreamError
from viewtide.operators.overlay import MutationError, Pusher
from viewtide.plans import named
from viewtide.plans.planner import QueryProblem, chains, plan_query
from viewtide.plans.query import Query, c, from_json, q, to_json
from viewtide.plans.schema import Column, Derived, Parent, Relation, SchemaError, Table, compatibility, compile_schema, describe, plan_migration, schema_from_json, tables_to_json
from viewtide.sources.fills import FillRegistry

U = ["a2523813-adbe-11f1-b19c-0a2250a7ed6c", "b2523813-adbe-11f1-b19c-0a2250a7ed6c"]
sets = st.lists(st.tuples(st.sampled_from(U), st.integers(1, 40), st.integers(0, 6)), max_size=8)


def plain(spans):
    return {(u, n) for u, a, k in spans for n in range(a, a + k + 1)}


def made(spans):
    return GtidSet.parse(",".join(f"{u}:{a}-{a + k}" for u, a, k in spans))


@settings(max_examples=150, deadline=None)
@given(sets, sets)
def test_gtid_algebra(a, b):
    x, y, p, r = made(a), made(b), plain(a), plain(b)
    ids = lambda s: {(g.split(":")[0], int(g.split(":")[1])) for g in s.gtids()}
    assert ids(x.union(y)) == p | r and ids(x.difference(y)) == p - r
    assert x.is_subset_of(y) == (p <= r) and x.count() == len(p)
    assert GtidSet.parse(str(x)) == x and GtidSet.parse("MySQL56/" + str(x)) == x
    assert all((f"{u}:{n}" in x) == ((u, n) in p) for u in U for n in range(1, 48))


def test_gtid_steps():
    one, three = GtidSet.parse(f"{U[0]}:1-4"), GtidSet.parse(f"{U[0]}:1-7")
    assert step(one, one.add(f"{U[0]}:5")) == f"{U[0]}:5"
    assert step(one, three, merged=True) == f"{U[0]}:5-7"
    for bad in ((one, three), (one, one), (three, one)):
        with pytest.raises(BadGtid):
            step(*bad)
    for text in ("x:1", f"{U[0]}:0", f"{U[0]}:3-1", U[0]):
        with pytest.raises(BadGtid):
            GtidSet.parse(text)


def test_kinds():
    assert [kinds.kind_of_source(t) for t in ("tinyint(1)", "tinyint(4)", "bigint unsigned", "bit(3)", "decimal(10,2)", "enum('a')", "datetime(3)", "varbinary(4)", "YEAR", "text")] == ["bool", "int", "bigint", "bigint", "decimal", "string", "datetime", "bytes", "int", "string"]
    assert kinds.enum_values("enum('a','it''s','x,y')") == ["a", "it's", "x,y"]
    assert kinds.literal_fits("int", 2.0) and not kinds.literal_fits("int", True) and not kinds.literal_fits("float", True) and not kinds.literal_fits("float", float("nan"))
    assert kinds.literal_fits("bigint", "-5") and not kinds.literal_fits("bigint", 5) and not kinds.literal_fits("json", "x") and not kinds.storable("bigint", "18446744073709551615")


def problem(query):
    with pytest.raises(QueryProblem) as e:
        plan_query(SCHEMA, query)
    return e.value.reason


@pytest.mark.parametrize(
    ("query", "reason"),
    [
        (q("nope"), "unknown_table"),
        (q("item").where(lambda c: c.eq("nope", 1)), "unknown_column"),
        (q("item").where(lambda c: c.exists("nope")), "unknown_relation"),
        (q("item").where(lambda c: c.lt("price", "1")), "not_comparable"),
        (q("item").where(lambda c: c.eq("contents", "x")), "not_comparable"),
        (q("item").where(lambda c: c.like("displayOrder", "x")), "not_comparable"),
        (q("item").where(lambda c: c.eq("displayOrder", "1")), "type_mismatch"),
        (q("item").where(lambda c: c.eq("displayOrder", 1.5)), "type_mismatch"),
        (q("item").where(lambda c: c.in_("id", ["a", 1])), "type_mismatch"),
        (q("item").where(lambda c: c.in_("id", [])), "empty_in"),
        (q("item").where(lambda c: c.in_("id", ["a"] * 41)), "too_many_values"),
        (q("item").where(lambda c: c.and_(*[c.eq("id", "a")] * 60)), "predicate_too_large"),
        (q("item").where(lambda c: c.and_(*[c.in_("id", ["a"] * 30)] * 3)), "too_many_parameters"),
        (q("item").where(lambda c: c.exists("folder", lambda c: c.exists("folder", lambda c: c.exists("folder", lambda c: c.exists("folder"))))), "too_deep"),
        (q("item").include("folder", lambda i: i.include("folder", lambda i: i.include("folder", lambda i: i.include("folder")))), "too_deep"),
        (q("item").include("folder", lambda i: i.include("folder", lambda i: i.include("folder", lambda i: i.where(lambda c: c.exists("folder"))))), "too_deep"),
        (q("item").order_by("contents"), "not_orderable"),
        (q("item").order_by("nope"), "unknown_column"),
        (q("item").limit(10_001), "limit_too_large"),
        (q("item").limit(0), "invalid_limit"),
    ],
)
def test_planner_rejects(query, reason):
    assert problem(query.query) == reason


def test_budgets_are_shared_with_includes():
    half = lambda c: c.in_("id", ["a"] * 40)
    assert plan_query(SCHEMA, q("item").where(half).include("folder", lambda i: i.where(half)).query)
    assert problem(q("item").where(half).include("folder", lambda i: i.where(lambda c: c.in_("id", ["a"] * 40)).include("folder", lambda i: i.where(lambda c: c.eq("id", "x")))).query) == "too_many_parameters"


def test_plans():
    planned = plan_query(SCHEMA, q("item").where(lambda c: c.exists("folder", lambda f: f.exists("organization"))).order_by("title", "desc").limit(5).include("organization").include("documents", lambda i: i.include("folder")).include("organization").query)
    assert planned.order_by == (("title", "desc"), ("id", "asc"))
    assert [lv.path for lv in planned.levels] == [("documents",), ("documents", "folder"), ("organization",)]
    assert planned.tables == {"item", "organization"}
    assert [[r.name for r in way] for way in chains(SCHEMA, ITEM, planned.query.where)] == [["folder"], ["folder", "organization"]]
    assert from_json(to_json(planned.query)) == planned.query
    same = q("item").include("documents", lambda i: i.include("folder")).include("organization").where(lambda c: c.exists("folder", lambda f: f.exists("organization"))).order_by("title", "desc").order_by("id").limit(5)
    assert plan_query(SCHEMA, same.query).key == planned.key == json.dumps(json.loads(planned.key), sort_keys=True, separators=(",", ":"))
    swap = lambda a, b: plan_query(SCHEMA, Query("item", c.and_(a, b))).key
    assert swap(c.eq("id", "a"), c.is_null("org")) != swap(c.is_null("org"), c.eq("id", "a"))


def test_named_queries():
    context = named.Context("org_1", "me", "c1")
    defs = {"mine": named.Definition(lambda ctx, a: q("item").where(lambda c: c.eq("org", ctx.partition)).limit(a["n"]), lambda a: {"n": int(a["n"])}), "bad": named.Definition(lambda ctx, a: 1 / 0)}
    assert named.ask(defs, ("mine", {"n": "3"}), context) == q("item").where(lambda c: c.eq("org", "org_1")).limit(3).query
    assert named.ask(defs, (named.CLIENT_QUERY, None), context).where["value"] == "c1"
    assert named.ask(None, q("item").query, context) == q("item").query
    for asked, reason in ((("nope", None), "unknown_query"), (("mine", {}), "invalid_args"), (("bad", None), "resolver_failed"), (q("item").query, "raw_refused")):
        with pytest.raises(named.ResolveProblem) as e:
            named.ask(defs, asked, context)
        assert e.value.reason == reason


def test_schemas_report_every_problem():
    t = Table(
        "t", ("id", "gone"), (Column("id", "json", True), Column("org", "int"), Column("d", "bool", derived=Derived("nope", "not_null")), Column("org", "int")), "org",
        (Relation("r", "one", "t", ("org",), ("org",)), Relation("r", "some", "nope", ("id",), ("id",)), Relation("s", "many", "t", ("id",), ("id", "org"))),
    )
    with pytest.raises(SchemaError) as e:
        compile_schema([t, dataclasses.replace(t, name="u", partition=Parent("org", "t")), t])
    text = "\n".join(e.value.problems)
    for part in ("declared twice", "key column id", "key column gone", "isn't of kind string", "no plain source", "whole primary key", "neither one nor many", "no table nope", "joins 1 columns with 2", "no single key"):
        assert part in text, part


def test_schema_order_and_hash():
    assert [t.name for t in SCHEMA.tables] == ["organization", "item"]
    assert compile_schema([ORGANIZATION, ITEM]).hash == SCHEMA.hash != compile_schema([ORGANIZATION]).hash
    derived = dataclasses.replace(ORGANIZATION, columns=(Column("has", "bool", derived=Derived("name", "starts_with", "x")), *ORGANIZATION.columns))
    assert compile_schema([derived]).table("organization").names == ["id", "name", "has"]


def test_compatibility_and_migration():
    old, new = compile_schema([ORGANIZATION]), SCHEMA
    assert compatibility(new, old.summary()) == (True, None) and compatibility(new, new.summary()) == (True, None)
    assert not compatibility(old, new.summary())[0]
    have = describe(new)
    part = lambda name, **columns: {"key": have[name]["key"], "columns": columns}
    without = lambda gone: part("item", **{n: k for n, k in have["item"]["columns"].items() if n != gone})
    assert plan_migration(new, {}, None).action == "create" and plan_migration(new, have, new.hash).action == "none"
    less = have | {"item": without("score"), "stale": part("item", id="string")}
    plan = plan_migration(new, less, "x")
    assert (plan.action, plan.columns, plan.dropped) == ("additive", ("item.score",), ("stale",))
    for changed, reason in (
        (without("type"), "column item.type is required"), (part("item", **have["item"]["columns"], more="int"), "column item.more was removed"),
        (part("item", **have["item"]["columns"] | {"score": "string"}), "column item.score is of another kind"), (have["item"] | {"key": ["title"]}, "table item has another primary key"),
    ):
        plan = plan_migration(new, have | {"item": changed}, "x")
        assert (plan.action, plan.reason) == ("reset", reason)
    assert plan_migration(new, {"item": have["item"]}, "x").tables == ("organization",)


def test_schemas_as_json(tmp_path, capsys):
    from viewtide.__main__ import main
    from viewtide.queries import schema

    for s in (SCHEMA, schema()):
        again = schema_from_json(json.loads(json.dumps(tables_to_json(s.tables) | {"partition_kind": s.partition_kind})))
        assert again.hash == s.hash and again.tables == s.tables
    (tmp_path / "good.json").write_text(json.dumps(tables_to_json(SCHEMA.tables)))
    (tmp_path / "bad.json").write_text(json.dumps({"tables": [{"name": "t", "primary_key": ["x"], "columns": [{"name": "id", "kind": "stone"}]}]}))
    assert main(["schema", "validate", str(tmp_path / "good.json")]) == 0 and capsys.readouterr().out.strip() == SCHEMA.hash
    assert main(["schema", "validate", str(tmp_path / "bad.json")]) == 1 and len(capsys.readouterr().out.splitlines()) == 2


def events(*, position=1, columns=("id", "name"), rows=((None, {"id": "a", "name": "n"}),)):
    return [
        {"type": "begin", "timestamp": 5}, {"type": "field", "table": "organization", "columns": list(columns)},
        *({"type": "row", "table": "organization", "before": b, "after": a} for b, a in rows), {"type": "vgtid", "position": f"{U[0]}:1-{position}"}, {"type": "commit"},
    ]


def run(assembler, evs):
    return [x for e in evs for x in assembler.push(e)]


def test_assembler():
    a = Assembler(SCHEMA, position=f"{U[0]}:1-4")
    found = run(a, [*events(position=5, rows=[(None, {"id": "a"}), ({"id": "a"}, {"id": "b"}), ({"id": "b"}, None)]), {"type": "heartbeat"}, {"type": "other"}])
    assert found[0]["gtid"] == f"{U[0]}:5" and [(x["op"], x["key"]) for x in found[0]["changes"]] == [("insert", ["a"]), ("update", ["b"]), ("delete", ["b"])]
    assert found[1] == {"item": "heartbeat"}
    assert run(a, [{"type": "begin"}, {"type": "rollback"}, *events(position=6)])[0]["gtid"] == f"{U[0]}:6"
    assert run(Assembler(SCHEMA, "merged", f"{U[0]}:1-4"), events(position=8))[0]["gtid"] == f"{U[0]}:5-8"
    assert run(Assembler(SCHEMA, "lenient"), [{"type": "begin"}, *events(position=8)])[0]["item"] == "transaction"
    for bad in (
        events(position=7), [{"type": "begin"}, {"type": "begin"}], [{"type": "commit"}], [{"type": "begin"}, {"type": "commit"}], [events()[2]], events(columns=["id"]), [{"type": "journal"}],
        [{"type": "begin"}, {"type": "row", "table": "organization", "after": {"id": "a"}}], [*events(position=5)[:2], {"type": "row", "table": "organization"}],
    ):
        with pytest.raises((StreamError, BadGtid)):
            run(Assembler(SCHEMA, position=f"{U[0]}:1-4"), bad)
    with pytest.raises(StreamError):
        run(Assembler(SCHEMA), events())


def rename(tx, args, context):
    tx.update("item", (args["id"],), {"title": args["title"]})


def add(tx, args, context):
    tx.insert("item", {"id": args["id"], "org": context["partition"], "type": "DOCUMENT", "createdAt": "2026-01-01 00:00:00"})
    if args.get("fail"):
        raise ValueError("x" * 900)


def test_push_protocol():
    p = Pusher(SCHEMA, {"rename": rename, "add": add}, {}, authorize=lambda r: r["partition"] != "secret")
    ask = lambda *ms, part="o": p.push({"client_id": "c", "partition": part, "mutations": [{"id": i, "name": n, "args": a} for i, n, a in ms]})
    assert ask((1, "add", {"id": "a"}), part="secret")["reason"] == "unauthorized"
    r = ask((1, "add", {"id": "a"}), (2, "rename", {"id": "a", "title": "t"}), (3, "rename", {"id": "zz", "title": "t"}), (4, "add", {"id": "b", "fail": 1}), (5, "nope", {}))
    assert [o["status"] for o in r["outcomes"]] == ["applied", "applied", "failed", "failed", "failed"] and len(r["outcomes"][3]["error"]) == 500
    assert ask((5, "add", {}), (7, "add", {}))["reason"] == "out_of_order"
    assert ask((4, "add", {"id": "q"}))["outcomes"] == [{"id": 4, "status": "duplicate"}]
    assert [[x["table"] for x in t] for t in p.transactions[:3]] == [["item", "sync_clients"], ["item", "sync_clients"], ["sync_clients"]]
    assert p.transactions[1][0]["before"]["title"] is None and p.transactions[1][0]["after"]["title"] == "t" and list(p.source) == [("item", '["a"]')]


def test_the_source_inserts_a_key_once_and_computes_derived_columns():
    schema = compile_schema([Table("t", ("id",), (Column("id", "string"), Column("name", "string", True), Column("named", "bool", derived=Derived("name", "not_null"))))])
    mutators = {"add": lambda tx, a, ctx: tx.insert("t", a), "patch": lambda tx, a, ctx: tx.update("t", a[0], a[1])}
    p = Pusher(schema, mutators, {})
    n = iter(range(1, 99))
    push = lambda name, args: p.push({"client_id": "c", "partition": "", "mutations": [{"id": next(n), "name": name, "args": args}]})["outcomes"][0]
    assert push("add", {"id": "a", "name": "x"})["status"] == "applied"
    again = push("add", {"id": "a", "name": "other"})
    assert again["status"] == "failed" and "already" in again["error"] and p.source["t", '["a"]']["name"] == "x"
    # What a mutator says of a derived column holds on its client only.
    assert push("add", {"id": "b", "named": True})["status"] == "applied" and p.source["t", '["b"]'] == {"id": "b", "name": None, "named": False}
    assert push("patch", [["a"], {"named": False}])["status"] == "applied" and p.source["t", '["a"]']["named"] is True
    assert push("patch", [["a"], {"id": "b"}])["status"] == "failed" and push("patch", [["a"], {"id": "c"}])["status"] == "applied"
    assert sorted(k for _, k in p.source) == ['["b"]', '["c"]'] and p.confirmed == {"c": 6}
    from viewtide.operators.overlay import LocalTransaction

    tx = LocalTransaction(schema, {}, {})
    tx.insert("t", {"id": "b", "named": True})
    assert tx.get("t", ["b"])["named"] is True


def test_writes_are_checked():
    p = Pusher(SCHEMA, {"bad": lambda tx, a, ctx: tx.insert("item", a), "patch": lambda tx, a, ctx: tx.update("item", a[0], a[1])}, {})
    bad = [{"id": "a"}, {"id": 1, "type": "x", "createdAt": "y"}, {"id": "a", "nope": 1}, {"id": "a", "type": None}]
    for i, row in enumerate(bad):
        assert p.push({"client_id": "c", "partition": "", "mutations": [{"id": i + 1, "name": "bad", "args": row}]})["outcomes"][0]["status"] == "failed"
    with pytest.raises(MutationError):
        from viewtide.operators.overlay import LocalTransaction

        LocalTransaction(SCHEMA, {}, {}).delete("item", {"nope": 1})


def test_wire():
    assert wire.decode_row([1, -1, 0, 2], b"abc") == [b"a", None, b"", b"bc"]
    for bad in (([1], b""), ([1], b"ab"), ([-2], b"")):
        with pytest.raises(wire.BadRow):
            wire.decode_row(*bad)
    assert [wire.sql_literal(k, v) for k, v in (("bool", True), ("bigint", "12"), ("float", 1), ("bytes", "AP8="), ("string", "it's\\"), ("date", None))] == ["1", "12", "1.0", "X'00ff'", "'it\\'s\\\\'", "NULL"]
    assert wire.percent_encoded("a/b c") == "a%2Fb%20c" and len(wire.now_text()) == 23
    grants = [{"partitions": ["a"], "expires": 10}, {"partitions": ["*"], "expires": 5}]
    assert wire.granted(grants, "a", 9) and wire.granted(grants, "z", 4) and not wire.granted(grants, "z", 6)


def test_fill_registry():
    r = FillRegistry()
    assert r.enqueue("p", 1, "t") and not r.enqueue("p", 1, "t")
    for i in range(2, 20):
        r.enqueue("p", i, "t")
    assert [x.fill_id for x in r.poll(0)] == list(range(1, 17)) and len(r.poll(0)) == 3 and r.poll(0) == []
    assert r.dequeue("p", 1) and not r.dequeue("p", 1) and [x.fill_id for x in r.poll(181)][0] == 2
