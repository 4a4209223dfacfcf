"""A workspace schema with self relations, and random rows and changes for it."""

import json
import random

from viewtide.plans.schema import Column, Relation, Table, compile_schema

ITEM = Table(
    "item", ("id",),
    (
        Column("id", "string"), Column("org", "string", True), Column("groupId", "string", True), Column("type", "string", source_type="enum('DOCUMENT','GROUP')"), Column("displayOrder", "int", True),
        Column("contents", "json", True), Column("createdAt", "datetime"), Column("score", "float", True), Column("big", "bigint", True), Column("price", "decimal", True), Column("title", "string", True),
    ),
    "org",
    (Relation("folder", "one", "item", ("groupId",), ("id",)), Relation("organization", "one", "organization", ("org",), ("id",)), Relation("documents", "many", "item", ("id",), ("groupId",))),
)
ORGANIZATION = Table("organization", ("id",), (Column("id", "string"), Column("name", "string")), "id")
SCHEMA = compile_schema([ITEM, ORGANIZATION])
NAMES = [c.name for c in ITEM.columns]


def item(id_, **cells):
    return dict.fromkeys(NAMES) | {"id": id_, "org": "org_1", "type": "DOCUMENT", "createdAt": "2026-01-01 00:00:00"} | cells


def random_item(rng, id_):
    """Folders are groups, and now and then a document is one; every nullable cell is empty in a share of the rows."""
    some = lambda values: rng.choice(values) if rng.random() < 0.75 else None
    kind = "GROUP" if id_[0] == "f" or rng.randrange(12) == 0 else "DOCUMENT"
    return item(id_, type=kind, groupId=some(["f1", "f2"]), displayOrder=some(range(1, 10, 2)), title=some("aAbB"), createdAt=f"2026-01-0{rng.randint(1, 2)} 00:00:00", score=some([0.5, 2.0]))


def random_changes(rng: random.Random, rows: dict, n: int, rekey: bool = True) -> list[dict]:
    """One transaction's changes of rows (id -> item), which it updates: rows are written, removed, or written under another key."""
    ids, out = [*(f"d{i}" for i in range(10)), "f1", "f2"], []
    for _ in range(n):
        old, kind = rng.choice(ids), rng.choices(["write", "remove", "rekey"], [6, 2, 1])[0]
        before = rows.pop(old, None)
        if kind == "remove" and before is not None:
            out.append(change("delete", before, None))
            continue
        free = [i for i in ids[:10] if i not in rows and i != old]
        new = rng.choice(free) if kind == "rekey" and rekey and before is not None and free else old
        rows[new] = random_item(rng, new)
        out.append(change("insert" if before is None else "update", before, rows[new]))
    return out


def change(op, before, after, table="item"):
    text = lambda r: None if r is None else json.dumps(r, ensure_ascii=False)
    return {"table": table, "op": op, "key": [(after or before)["id"]], "before": text(before), "after": text(after)}


def frame(spark, rows, table=ITEM):
    return table.keyed(spark.createDataFrame([tuple(r[c] for c in table.names) for r in rows], table.struct()))
