"""Keeps subscribed queries current over a partition: fills tables, applies batches exactly once, emits what changed.

A table of the partition is absent, filling or live. While it fills, changes are held; when its rows are complete, held
changes that the rows already contain (by position) are skipped and the rest applied in order. A subscription is pending
until all its tables are live.

A batch of transactions is folded once into a row for each key, and each subscription is maintained once for it, so the client
goes from cursor to cursor. Tables and memberships are bases with tiers of changes (``state.LiveTable``): a batch writes what it
changes, and reads the keys that it touches. A transaction with a row that can't be stored is refused as a whole; those before
it in the batch are applied.

With a folder the engine outlives its process: accepted batches are logged before they are acknowledged, and a manifest names
the tables' files, the subscriptions and the position; ``Engine.open`` reads the last manifest and applies the log behind it.
Nothing of a table is held on the driver but its last changes, of a bounded number.
"""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.operators.changes import image, images_by_table, key_of, replayable, stored_types, unfit
from viewtide.operators.levels import Path, chunks, grown, recompute, seen
from viewtide.operators.maintain import Move, affected, changed_rows, entered_and_left, row_updates
from viewtide.plans.planner import Planned, plan_query
from viewtide.plans.query import Query, from_json, to_json
from viewtide.plans.schema import KEY, Column, Schema, Table
from viewtide.sources.keys import KEYS, KeySet, local, push_filters, settled, union
from viewtide.sources.shared import Folder, cut
from viewtide.sources.tables import rewritten
from viewtide.streaming.state import LiveTable

#: Sequence numbers that the log remembers, seconds that an abandoned subscription is kept, seconds and times a fill is tried.
LOG, GRACE, FILL_SECONDS, FILL_TRIES = 2000, 3600, 120, 5
#: Logged batches after which a manifest is written.
MANIFEST_EVERY = 50
PROTOCOL = 1
CHANGE = "seq bigint, gtid string, ord int, tbl string, op string, before string, after string"
TEXTS = T.StructType([T.StructField(n, T.StringType()) for n in ("op", "key", "before", "after")])
AFTER = T.StructType([*KEYS.fields, T.StructField("after", T.StringType())])
#: A membership's rows as a live table.
MEMBERS = Table("members", ("path", "row"), (Column("path", "string"), Column("tbl", "string"), Column("row", "string")))


class Members:
    """A subscription's membership: what was a member at a path is looked up by keys."""

    def __init__(self, spark: SparkSession, planned: Planned, rows: DataFrame):
        self.spark = spark
        self.target = {(): planned.table.name} | {lv.path: lv.target.name for lv in planned.levels}
        self.live = LiveTable(spark, MEMBERS, T.StructType([*KEYS.fields, *MEMBERS.struct().fields]))
        #: A window's keys with what orders them, as of the last batch that changed it.
        self.window: DataFrame | None = None
        keyed = cut(rows.select(F.concat_ws(" ", "path", KEY).alias("k"), "path", "tbl", F.col(KEY).alias("row")).withColumnRenamed("k", KEY))
        self.live.load(keyed, keyed.count())

    @property
    def df(self) -> DataFrame:
        """path, tbl, key."""
        return self.live.view().select("path", "tbl", F.col("row").alias(KEY))

    def of(self, path: Path, keys: KeySet) -> KeySet:
        """Which of the keys are members at path."""
        if keys.empty:
            return keys
        if keys.small is None:
            return KeySet.of(keys.within(self.all(path)))
        at = "/".join(path)
        found = self.live.rows(KeySet(self.spark, frozenset(f"{at} {k}" for k in keys.small)))
        return KeySet.of(found.select(F.col("row").alias(KEY)))

    def all(self, path: Path) -> DataFrame:
        return self.live.view().where(F.col("path") == "/".join(path)).select(F.col("row").alias(KEY))

    def move(self, moves: dict[Path, Move]) -> None:
        """Takes the moves over; too many for the driver are written anew."""
        sides = [(path, m.added, m.removed) for path, m in moves.items()]
        if any(s.small is None for _, *both in sides for s in both):
            df = self.df
            for path, added, removed in sides:
                at = F.lit("/".join(path)).alias("path")
                df = df.join(removed.df().select(at, KEY), ["path", KEY], "left_anti").select("path", "tbl", KEY)
                df = df.unionByName(added.df().select(at, F.lit(self.target[path]).alias("tbl"), KEY))
            keyed = cut(df.select(F.concat_ws(" ", "path", KEY).alias("k"), "path", "tbl", F.col(KEY).alias("row")).withColumnRenamed("k", KEY))
            self.live.load(keyed, keyed.count())
            return
        images: dict[str, str | None] = {}
        for path, added, removed in sides:
            at = "/".join(path)
            images |= {f"{at} {k}": None for k in removed.small}
            images |= {f"{at} {k}": json.dumps({"path": at, "tbl": self.target[path], "row": k}) for k in added.small}
        if images:
            self.live.put(images)


class LiveTables(Mapping):
    """Tables as they are now, by name, with look-ups by keys."""

    def __init__(self, live: dict[str, LiveTable]):
        self.live, self.views = live, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.views:
            self.views[name] = self.live[name].view()
        return self.views[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.live)

    def __len__(self) -> int:
        return len(self.live)

    def rows(self, name: str, keys: KeySet) -> DataFrame:
        return self.live[name].rows(keys)


@dataclass
class Subscription:
    planned: Planned
    state: Members | None = None
    based_on: str | None = None
    orphaned: float | None = None

    @property
    def members(self) -> DataFrame | None:
        return None if self.state is None else self.state.df

    @property
    def status(self) -> str:
        return "pending" if self.state is None else "live"


@dataclass
class Scope:
    fill_id: int
    rows: list[DataFrame] = field(default_factory=list)
    tries: int = 1
    since: float = field(default_factory=time.time)
    live: bool = False


@dataclass(frozen=True)
class Snapshot:
    """A subscription's whole content at a cursor; with base, only what it has beyond that subscription's."""

    subscription: str
    cursor: int
    members: DataFrame
    rows: dict[str, DataFrame]
    base: str | None = None

    def parts(self, size: int = 500) -> Iterator[tuple[str, DataFrame]]:
        """(table, rows numbered by the chunk they are sent in), the membership last."""
        for name, df in self.rows.items():
            yield name, chunks(df, size)
        yield "members", chunks(self.members, size)


@dataclass(frozen=True)
class Delta:
    """What a batch changed: membership by subscription (path-free), and images by table."""

    cursor: int
    gtid: str
    changed: dict[str, DataFrame]
    rows: dict[str, DataFrame]


class Engine:
    def __init__(self, spark: SparkSession, schema: Schema, partition: str = "", epoch: int = 0, folder: str | None = None):
        push_filters(spark)
        self.spark, self.schema, self.partition, self.epoch = spark, schema, partition, epoch
        self.applied = 0
        self.log: OrderedDict[int, str] = OrderedDict()
        self.live: dict[str, LiveTable] = {}
        self.scopes: dict[str, Scope] = {}
        self.held: dict[str, DataFrame] = {}
        self.subscriptions: dict[str, Subscription] = {}
        self.fills = 0
        self.folder = Folder(spark, folder) if folder else None
        self.manifest = self.logged = 0

    @property
    def tables(self) -> LiveTables:
        return LiveTables(self.live)

    # Durability

    @staticmethod
    def open(spark: SparkSession, schema: Schema, folder: str, partition: str = "") -> Engine:
        """The engine that wrote to folder last, as it was when it acknowledged last; a new one if there is none.

        Fills that were under way begin anew, under new ids; changes that were held stay. Memberships are evaluated again.
        """
        e = Engine(spark, schema, partition, folder=folder)
        numbers = sorted(int(n[9:17]) for n in e.folder.names() if n.startswith("manifest-"))
        if not numbers:
            e.save()
            return e
        m = json.loads(e.folder.read(f"manifest-{numbers[-1]:08d}.json"))
        if m["schema_hash"] != schema.hash:
            raise ValueError("the folder is of another schema; fill a new one")
        e.manifest, e.epoch, e.applied, e.fills = numbers[-1], m["epoch"], m["applied"], m["fills"]
        e.log = OrderedDict((int(k), v) for k, v in m["log"])
        e.live = {n: LiveTable.restored(spark, schema.table(n), s) for n, s in m["tables"].items()}
        e.held = {n: spark.read.schema(CHANGE).parquet(path) for n, path in m["held"].items()}
        for name, live in m["scopes"].items():
            e.fills += not live
            e.scopes[name] = Scope(e.fills, live=live)
        for x in m["subscriptions"]:
            planned = plan_query(schema, from_json(x["query"]))
            e.subscriptions[planned.key] = Subscription(planned, based_on=x["based_on"], orphaned=x["orphaned"])
        for key in e.subscriptions:
            e._materialize(key)
        behind = sorted(n for n in e.folder.names() if n.startswith(f"log-{e.manifest:08d}-"))
        for name in behind:
            e._take(json.loads(e.folder.read(name)))
        e.logged = len(behind)
        return e

    def save(self) -> None:
        """Writes a manifest; the log begins anew behind it."""
        if self.folder is None:
            return
        held = {}
        for name, df in self.held.items():
            held[name] = f"{self.folder.path}/held-{self.manifest + 1:08d}-{name}"
            df.write.mode("overwrite").parquet(held[name])
        m = {
            "schema_hash": self.schema.hash, "epoch": self.epoch, "applied": self.applied, "fills": self.fills, "log": list(self.log.items()), "held": held,
            "tables": {n: t.state() for n, t in self.live.items()}, "scopes": {n: s.live for n, s in self.scopes.items()},
            "subscriptions": [{"query": to_json(s.planned.query), "based_on": s.based_on, "orphaned": s.orphaned} for s in self.subscriptions.values()],
        }
        self.folder.write(f"manifest-{self.manifest + 1:08d}.json", json.dumps(m))
        self.manifest, self.logged = self.manifest + 1, 0

    # Fills

    def ensure(self, names: set[str] | frozenset[str]) -> list[tuple[int, str]]:
        """Starts fills of tables that are absent; returns them as (fill id, table)."""
        started = []
        for name in sorted(names):
            if name not in self.scopes:
                self.fills += 1
                self.scopes[name] = Scope(self.fills)
                started.append((self.fills, name))
        return started

    def fill(self, fill_id: int, rows: DataFrame) -> bool:
        """Takes rows (keyed) of a fill; False if the fill isn't the current one."""
        scope = self._filling(fill_id)
        if scope is None:
            return False
        scope[1].rows.append(rows)
        return True

    def _filling(self, fill_id: int) -> tuple[str, Scope] | None:
        return next(((n, s) for n, s in self.scopes.items() if s.fill_id == fill_id and not s.live), None)

    def complete(self, fill_id: int, position: str | None) -> list[Snapshot]:
        """The fill's rows are all there, as of position; None: it failed, and the table is absent again."""
        found = self._filling(fill_id)
        if found is None:
            return []
        name, scope = found
        held = self.held.pop(name, None)
        if position is None:
            del self.scopes[name]
            return []
        rows = reduce(DataFrame.unionByName, scope.rows) if scope.rows else self.spark.createDataFrame([], self._empty(name))
        rows = rows.dropDuplicates([KEY])
        if held is not None:
            late = replayable(held, position)
            rows = rewritten(rows, images_by_table(late.withColumn("key", F.lit(None).cast("string")), self.schema, ["seq", "ord"], {name: rows}, {name})[name])
        rows = cut(rows)
        live = LiveTable(self.spark, self.schema.table(name), rows.schema)
        live.load(rows, rows.count())
        self.live[name], scope.live, scope.rows = live, True, []
        snapshots = [s for key in list(self.subscriptions) for s in self._materialize(key)]
        self.save()
        return snapshots

    def retry(self, fill_id: int) -> int | None:
        """Tries a fill again under a new id: what is held stays, its rows don't. None once it was tried often enough."""
        found = self._filling(fill_id)
        if found is None:
            return None
        name, scope = found
        if scope.tries >= FILL_TRIES:
            self.complete(fill_id, None)
            return None
        self.fills += 1
        self.scopes[name] = Scope(self.fills, tries=scope.tries + 1)
        return self.fills

    def overdue(self, now: float | None = None) -> list[int]:
        now = time.time() if now is None else now
        return [s.fill_id for s in self.scopes.values() if not s.live and now - s.since > FILL_SECONDS]

    def _empty(self, name: str):
        from pyspark.sql import types as T

        return T.StructType([T.StructField(KEY, T.StringType()), *self.schema.table(name).struct().fields])

    # Subscriptions

    def subscribe(self, query: Query, based_on: str | None = None) -> tuple[str, list[Snapshot]]:
        """The subscription's id, which equal queries share, and its snapshot if its tables are live."""
        planned = plan_query(self.schema, query)
        key = planned.key
        self.ensure(planned.tables)
        if key in self.subscriptions:
            s = self.subscriptions[key]
            s.orphaned = None
            return key, [self.snapshot(key)] if s.state is not None else []
        self.subscriptions[key] = Subscription(planned, based_on=based_on if based_on in self.subscriptions else None)
        snapshots = self._materialize(key)
        self.save()
        return key, snapshots

    def _materialize(self, key: str) -> list[Snapshot]:
        s, tables = self.subscriptions[key], self.tables
        if s.state is not None or not all(n in tables for n in s.planned.tables):
            return []
        s.state = Members(self.spark, s.planned, recompute(s.planned, tables))
        base = self.subscriptions.get(s.based_on) if s.based_on else None
        if base is not None and base.state is not None:
            more = grown(seen(base.members), seen(s.members))
            if more is not None:
                return [Snapshot(key, self.applied, more, self._rows(s, more), s.based_on)]
        return [self.snapshot(key)]

    def snapshot(self, key: str) -> Snapshot:
        s = self.subscriptions[key]
        members = seen(s.members)
        return Snapshot(key, self.applied, members, self._rows(s, members))

    def _rows(self, s: Subscription, members: DataFrame) -> dict[str, DataFrame]:
        tables = self.tables
        return {n: tables[n].join(members.where(F.col("tbl") == n).select(KEY).distinct(), KEY, "left_semi") for n in sorted(set(s.state.target.values()))}

    def unsubscribe(self, key: str, now: float | None = None) -> None:
        """Nobody asks for it now; it is kept for a while."""
        if key in self.subscriptions:
            self.subscriptions[key].orphaned = time.time() if now is None else now

    def sweep(self, now: float | None = None) -> list[str]:
        """Drops what nobody has asked for since GRACE seconds."""
        now = time.time() if now is None else now
        gone = [k for k, s in self.subscriptions.items() if s.orphaned is not None and now - s.orphaned >= GRACE]
        for k in gone:
            del self.subscriptions[k]
        if gone:
            self.save()
        return gone

    def next_sweep(self) -> float | None:
        """When the subscription that was abandoned first will have been kept long enough."""
        return min((s.orphaned + GRACE for s in self.subscriptions.values() if s.orphaned is not None), default=None)

    def recompute(self, key: str) -> DataFrame:
        """What maintenance must equal."""
        return recompute(self.subscriptions[key].planned, self.tables)

    # Batches

    def apply_batch(self, batch: dict[str, Any]) -> tuple[dict[str, Any], list[Delta]]:
        """Applies transactions in order, each wholly or not at all. Returns the acknowledgement and the deltas.

        batch: protocol, schema_hash, epoch, partition, transactions [{seq, gtid, changes [{table, op, key, before, after}]}];
        images are JSON text.
        """
        reason = self._refusal(batch)
        if reason:
            return {"rejected": reason}, []
        if batch["epoch"] > self.epoch:
            self.reset(batch["epoch"])
        expected, duplicates, fresh = self.applied + 1, 0, []
        for tx in batch["transactions"]:
            if tx["seq"] < expected and not (self.applied == 0 and not fresh):
                if self.log.get(tx["seq"], tx["gtid"]) != tx["gtid"]:
                    return {"rejected": "conflict", "seq": tx["seq"]}, []
                duplicates += 1
                continue
            if tx["seq"] > expected and not (self.applied == 0 and not fresh):
                return {"rejected": "gap", "expected": expected, "seq": tx["seq"]}, []
            fresh.append(tx)
            expected = tx["seq"] + 1
        good, bad = self._checked(fresh)
        deltas = []
        if good:
            if self.folder is not None:
                self.logged += 1
                self.folder.write(f"log-{self.manifest:08d}-{self.logged:08d}.json", json.dumps(good))
            deltas.append(self._take(good))
            if self.logged >= MANIFEST_EVERY:
                self.save()
        if bad is not None:
            return {"rejected": "invalid_row", **bad, "applied_seq": self.applied}, deltas
        return {"applied_seq": self.applied, "duplicates": duplicates}, deltas

    def _checked(self, transactions: list[dict]) -> tuple[list[dict], dict | None]:
        """The transactions before the first with a row that can't be stored, and what is wrong with it.

        Changes get their keys, before and after. Rows of tables that aren't live aren't looked at, and neither is what a delete has.
        """
        wrong: list[tuple[int, dict]] = []
        by_table: dict[str, list[tuple[int, dict]]] = {}
        for i, tx in enumerate(transactions):
            for c in tx["changes"]:
                if self.schema.table(c["table"]) is None:
                    wrong.append((i, {"table": c["table"], "seq": tx["seq"], "why": "table is not in the schema"}))
                elif c["table"] in self.live:
                    by_table.setdefault(c["table"], []).append((i, c))
        for name, found in by_table.items():
            table = self.schema.table(name)
            rows = local(self.spark, TEXTS, [(c["op"], json.dumps(c["key"]) if c.get("key") else None, c["before"], c["after"]) for _, c in found])
            decoded = rows.select(key_of(F.col("before"), table).alias("b"), key_of(F.col("after"), table).alias("a"), unfit(F.col("after"), table, stored_types(self.live[name].view())).alias("bad"))
            for (i, c), r in zip(found, decoded.collect(), strict=True):
                c["keys"] = [r["b"], r["a"]]
                why = None
                if c["op"] == "delete":
                    c["keys"] = [r["b"] or _key_string(table, c.get("key")), None]
                    why = None if c["keys"][0] else "a delete without a key"
                elif c["after"] is None:
                    why = f"{c['op']} without an after image"
                elif r["bad"]:
                    why = f"values that can't be stored: {', '.join(r['bad'])}"
                if why:
                    wrong.append((i, {"table": name, "seq": transactions[i]["seq"], "why": why}))
        if not wrong:
            return transactions, None
        first, what = min(wrong, key=lambda x: x[0])
        return transactions[:first], what

    def _refusal(self, batch: dict[str, Any]) -> str | None:
        if batch["protocol"] != PROTOCOL:
            return "protocol_version"
        if batch["schema_hash"] != self.schema.hash:
            return "schema_mismatch"
        if batch["partition"] != self.partition:
            return "wrong_partition"
        return "stale_epoch" if batch["epoch"] < self.epoch else None

    def reset(self, epoch: int) -> None:
        """A new stream: all rows and positions go, subscriptions wait for new fills."""
        self.epoch, self.applied = epoch, 0
        self.log.clear()
        self.live, self.scopes, self.held = {}, {}, {}
        for s in self.subscriptions.values():
            s.state = None
            self.ensure(s.planned.tables)
        self.save()

    def _take(self, transactions: list[dict]) -> Delta:
        """Applies checked transactions, folded by key."""
        images: dict[str, dict[str, str | None]] = {}
        held: dict[str, list[tuple]] = {}
        for tx in transactions:
            for i, c in enumerate(tx["changes"]):
                scope = self.scopes.get(c["table"])
                if c["table"] in self.live:
                    old, new = c["keys"]
                    mine = images.setdefault(c["table"], {})
                    if old is not None and old != new:
                        mine[old] = None
                    if new is not None:
                        mine[new] = c["after"]
                elif scope is not None:
                    held.setdefault(c["table"], []).append((tx["seq"], tx["gtid"], i, c["table"], c["op"], c["before"], c["after"]))
        for name, rows in held.items():
            mine = self.spark.createDataFrame(rows, CHANGE)
            self.held[name] = cut(self.held[name].unionByName(mine)) if name in self.held else cut(mine)
        changes = {name: self._change(name, mine) for name, mine in images.items()}
        for name, mine in images.items():
            self.live[name].put(mine)
        after = self.tables
        changed: dict[str, DataFrame] = {}
        entered: dict[str, list[KeySet]] = {}
        present: dict[str, list[KeySet]] = {}
        for key, s in self.subscriptions.items():
            if s.state is None or not images.keys() & s.planned.tables:
                continue
            moves = affected(s.planned, s.state, after, changes)
            sides = entered_and_left(s.planned, s.state, moves, self.spark)
            changed[key] = changed_rows(self.spark, sides)
            for name, (added, _) in sides.items():
                entered.setdefault(name, []).append(added)
            for path, move in moves.items():
                present.setdefault(s.state.target[path], []).append(move.now)
            s.state.move(moves)
        keys = {n: KeySet.of(df) for n, df in changes.items()}
        rows = row_updates(changes, {n: union(self.spark, x) for n, x in entered.items()}, {n: union(self.spark, x) & keys[n] for n, x in present.items() if n in keys}, after)
        last = transactions[-1]
        self.applied = last["seq"]
        for tx in transactions:
            self.log[tx["seq"]] = tx["gtid"]
        while len(self.log) > LOG:
            self.log.popitem(last=False)
        return Delta(last["seq"], last["gtid"], changed, rows)

    def _change(self, name: str, images: dict[str, str | None]) -> DataFrame:
        """key, before (as it is stored; a stream may send less) and after of the rows that a batch changes."""
        live, table = self.live[name], self.schema.table(name)
        stored = live.rows(KeySet(self.spark, frozenset(images)))
        stored = stored.select(KEY, F.struct(*(c for c in stored.columns if c != KEY)).alias("before"))
        after = local(self.spark, AFTER, sorted(images.items())).select(KEY, image(F.col("after"), table, stored_types(live.view())).alias("after"))
        return settled(after.join(stored, KEY, "left").select(KEY, "before", "after").where("before is not null or after is not null"))

    def status(self) -> dict[str, Any]:
        return {
            "applied_seq": self.applied,
            "epoch": self.epoch,
            "rows": {n: df.count() for n, df in self.tables.items()},
            "written": {n: t.written for n, t in self.live.items()},
            "subscriptions": {k: s.status for k, s in self.subscriptions.items()},
            "held": {n: df.count() for n, df in self.held.items()},
        }


def _key_string(table: Table, key: Any) -> str | None:
    """A change's key (its primary key's values in order) as the text that key columns have."""
    if not isinstance(key, list) or len(key) != len(table.primary_key):
        return None
    return json.dumps([str(v) if table.column(k).kind == "bigint" else v for k, v in zip(table.primary_key, key, strict=True)], separators=(",", ":"), ensure_ascii=False)


def for_session(delta_: Delta, subscriptions: set[str], columns: dict[str, list[str]]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The part of a delta that a session gets: its subscriptions' membership changes, and images of the columns that it knows."""
    changed = {k: df for k, df in delta_.changed.items() if k in subscriptions}
    rows = {}
    for name, df in delta_.rows.items():
        if name in columns:
            known = [f.name for f in df.schema["image"].dataType.fields if f.name in columns[name]]
            rows[name] = df.select(KEY, F.when(F.col("image").isNotNull(), F.struct(*(F.col(f"image.{c}").alias(c) for c in known))).alias("image"))
    return changed, rows

