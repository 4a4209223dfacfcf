"""Delivery against sinks that fail, refuse and recover; quarantine; batches' bounds; the order of the source."""

import functools
import json
import os

import pytest

from viewtide.streaming.delivery import Distributor, Limits, Quarantine, Unreachable, batch_numbers, bounded, counts, send, transactions

HEAD = {"protocol": 1, "schema_hash": "h", "epoch": 0}
QUICK = Limits(transactions=2, rejects=3, attempts=6, wait=0.001, longest=0.002)
CHANGES = "partition string, seq long, gtid string, ord int, turn int, tbl string, op string, key string, before string, after string"


def file_sink(folder):
    """A sink of files: ``plan-PARTITION`` holds the answers to come, one a line; afterwards all is applied. What came is in ``got-PARTITION``."""

    def sink(batch):
        path = f"{folder}/plan-{batch['partition']}"
        plan = open(path).read().split() if os.path.exists(path) else []
        if plan:
            with open(path, "w") as f:
                f.write("\n".join(plan[1:]))
            if plan[0] == "down":
                raise Unreachable("no answer")
            if plan[0] == "gone":
                raise Unreachable("no such place", transient=False)
            if plan[0] == "short":
                return {"applied_seq": batch["transactions"][0]["seq"] - 1, "duplicates": 0}
            if plan[0] != "ok":
                return {"rejected": plan[0]}
        with open(f"{folder}/got-{batch['partition']}", "a") as f:
            for t in batch["transactions"]:
                f.write(json.dumps([t["seq"], [c["key"] for c in t["changes"]]]) + "\n")
        return {"applied_seq": batch["transactions"][-1]["seq"], "duplicates": 0}

    return sink


def got(folder, partition):
    path = f"{folder}/got-{partition}"
    return [json.loads(x) for x in open(path)] if os.path.exists(path) else []


def sequenced(spark, first=1, last=5):
    rows = [(p, s, f"g{s}", o, 0, "t", "insert", f'["{p}{s}{o}"]', None, "{}") for p in "abcdef" for s in range(first, last + 1) for o in (1, 0)]
    return spark.createDataFrame(rows, CHANGES).repartition(3)


def test_failing_and_recovering_sinks(spark, tmp_path):
    """One that fails and recovers, one that heals, one that refuses for good, one that refuses too often, one that acknowledges too little."""
    plans = {"a": "down down", "b": "gap ok gap", "c": "ok invalid_row", "d": "schema_mismatch " * 3, "e": "ok short", "f": "gone gone"}
    for p, plan in plans.items():
        (tmp_path / f"plan-{p}").write_text("\n".join(plan.split()))
    aside = Quarantine(spark, f"file://{tmp_path}/aside")
    d = Distributor(spark, aside, functools.partial(file_sink, str(tmp_path)), HEAD, QUICK)
    outcomes = d.take(sequenced(spark))
    found = {(r.partition, r.first_seq): (r.last_seq, r.status, r.reason, r.tries) for r in outcomes.collect()}
    assert found["a", 1] == (2, "applied", None, 3) and found["b", 1] == (2, "applied", None, 2) and found["b", 3] == (4, "applied", None, 2) and found["f", 1][3] == 3
    assert found["c", 3] == (4, "rejected", "invalid_row", 1) and found["d", 1] == (2, "rejected", "schema_mismatch", 3) and found["e", 3] == (4, "rejected", "ack_below_batch", 1)
    assert ("c", 5) not in found and ("d", 3) not in found
    whole = lambda p: [[s, [[f"{p}{s}0"], [f"{p}{s}1"]]] for s in range(1, 6)]
    assert [got(tmp_path, p) for p in "abf"] == [whole(p) for p in "abf"] and got(tmp_path, "c") == whole("c")[:2] and got(tmp_path, "d") == []
    assert {r.status: (r.batches, r.transactions) for r in counts(outcomes).collect()} == {"applied": (11, 19), "rejected": (3, 6)}
    listed = lambda: {r.partition: (r.reason, r.transactions, r.first_seq, r.last_seq) for r in aside.listed().collect()}
    assert listed() == {"c": ("invalid_row", 3, 3, 5), "d": ("schema_mismatch", 5, 1, 5), "e": ("ack_below_batch", 3, 3, 5)}
    # Later changes of those partitions wait behind, in order; others go on.
    d.take(sequenced(spark, 6, 7))
    assert listed()["c"] == ("invalid_row", 5, 3, 7) and got(tmp_path, "a")[-1][0] == 7
    assert {r.reason for r in aside.rows().where("partition = 'c' and seq > 4").collect()} == {"partition_quarantined"}
    # A replay goes as far as the sink takes it, a drop gives the rest up, and then the partition goes on.
    (tmp_path / "plan-d").write_text("ok\nok\nconflict")
    assert aside.replay("d", d.sink, HEAD, QUICK) == ["applied", "applied", "rejected"] and listed()["d"][1:] == (3, 5, 7)
    assert aside.replay("c", d.sink, HEAD, QUICK) == ["applied"] * 3 and [x[0] for x in got(tmp_path, "c")] == list(range(1, 8))
    assert aside.drop("d") == 3 and aside.drop("d") == 0 and set(listed()) == {"e"}
    d.take(sequenced(spark, 8, 8))
    assert got(tmp_path, "d")[-1][0] == 8 and got(tmp_path, "c")[-1][0] == 8 and listed()["e"][3] == 8


def test_a_partition_that_cannot_be_reached_fails_the_batch(spark, tmp_path):
    (tmp_path / "plan-a").write_text("down\n" * 20)
    d = Distributor(spark, Quarantine(spark, f"file://{tmp_path}/aside"), functools.partial(file_sink, str(tmp_path)), HEAD, QUICK)
    with pytest.raises(Unreachable):
        d.take(sequenced(spark, 1, 2))
    (tmp_path / "plan-a").write_text("")
    assert {r.status for r in d.take(sequenced(spark, 1, 2)).collect()} == {"applied"}


def test_batches_stay_within_bounds(spark):
    rows = [("p", i, "g", "x" * n) for i, n in enumerate((10, 10, 10, 500, 10, 60, 60))] + [("q", 1, "g", "y")]
    assert [[r[1] for r in b] for b in bounded(iter(rows), Limits(transactions=3, bytes=100))] == [[0, 1, 2], [3], [4, 5], [6], [1]]
    numbered = batch_numbers(transactions(sequenced(spark)), Limits(transactions=2))
    assert {(r.partition, r.seq): r.batch for r in numbered.collect()} == {(p, s): (s - 1) // 2 for p in "abcdef" for s in range(1, 6)}


def test_waits_grow_to_their_bound():
    waits = []

    def down(_batch):
        raise Unreachable("no")

    status = send(down, {"transactions": [{"seq": 1}]}, Limits(attempts=8, wait=1.0, longest=5.0), waits.append)
    assert status == ("undelivered", "no", 8)
    assert all(least <= w <= 1.5 * least for w, least in zip(waits, (1, 2, 4, 5, 5, 5, 5, 5), strict=True))


def test_commands(spark, tmp_path, capsys):
    """The stream's run, its position, and what was put aside, from the command line."""
    from tests.fixtures import SCHEMA, item
    from viewtide.__main__ import main
    from viewtide.plans.schema import tables_to_json

    uuid = "5d1c0a7e-9b58-4c55-a9a1-1c5f2d7e8f90"
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"gtid": f"{uuid}:{n}", "changes": [{"table": "item", "op": "insert", "key": [f"d{n}"], "before": None, "after": json.dumps(item(f"d{n}"))}]}) for n in (1, 2, 3)]
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    (tmp_path / "schema.json").write_text(json.dumps(tables_to_json(SCHEMA.tables)))
    state = f"file://{tmp_path}/state"
    said = lambda *args: (main(list(args), spark), capsys.readouterr().out.strip())[1]
    assert said("run", f"{tmp_path}/schema.json", f"{tmp_path}/in", state, "--from", f"{uuid}:1") == f"{uuid}:1-3"
    assert said("position", "show", state) == f"{uuid}:1-3" and said("position", "reset", state, f"{uuid}:1-2") == f"{uuid}:1-2" == said("position", "show", state)
    assert said("quarantine", "list", state) == ""
    Quarantine(spark, f"{state}/aside").put(transactions(sequenced(spark).where("partition = 'b'")).selectExpr("*", "'invalid_row' reason"))
    assert said("quarantine", "list", state) == "b\tinvalid_row\t5\t1-5" and said("quarantine", "drop", state, "b") == "5" and said("quarantine", "list", state) == ""
    found = json.loads(said("schema", "introspect", "file:///root/testdata/sf0.001"))
    assert {t["name"] for t in found["tables"]} >= {"orders", "nation"} and {c["name"]: c["kind"] for t in found["tables"] if t["name"] == "nation" for c in t["columns"]}["n_nationkey"] == "int"
