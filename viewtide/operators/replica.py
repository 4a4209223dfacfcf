"""A client's copy: rows and memberships as snapshots and deltas tell, read with its own unconfirmed writes on top."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.operators.levels import level_rows, nested
from viewtide.operators.overlay import MutationLog
from viewtide.plans.planner import Planned
from viewtide.plans.schema import KEY, Schema
from viewtide.sources.keys import settled
from viewtide.sources.shared import cut
from viewtide.sources.tables import by_keys, rewritten

#: Seconds that a released subscription is kept.
TTL = 300


def membership_index(members: dict[str, DataFrame]) -> DataFrame:
    """tbl, key, subscriptions: of each row the subscriptions that have it, to fan images out."""
    parts = [df.select("tbl", KEY, F.lit(k).alias("subscription")) for k, df in members.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("tbl", KEY).agg(F.sort_array(F.collect_set("subscription")).alias("subscriptions"))


class Replica:
    def __init__(self, spark: SparkSession, schema: Schema):
        self.spark, self.schema, self.cursor = spark, schema, 0
        self.tables = {t.name: spark.createDataFrame([], T.StructType([T.StructField(KEY, T.StringType()), *t.struct().fields])) for t in schema.tables}
        self.members: dict[str, DataFrame] = {}
        self.based_on: dict[str, str] = {}
        self.released: dict[str, float] = {}
        self.listeners: list[Callable[[int, set[str]], None]] = []

    def apply_snapshot(self, key: str, cursor: int, rows: dict[str, DataFrame], members: DataFrame, base: str | None = None) -> None:
        """A subscription's content in place of what it had; with base, what it has beyond that one."""
        before = self.members.get(key)
        self.members[key] = cut(members.select("tbl", KEY).distinct())
        self.based_on.pop(key, None)
        if base is not None:
            self.based_on[key] = base
        self.cursor = max(self.cursor, cursor)
        for name, df in rows.items():
            self._put(name, df.select(KEY, F.struct(*(c for c in df.columns if c != KEY)).alias("after")))
        self._forget([before] if before is not None else [])

    def apply_delta(self, cursor: int, changed: dict[str, DataFrame], rows: dict[str, DataFrame]) -> None:
        """Membership changes by subscription, and images; one that was applied already does nothing."""
        if cursor <= self.cursor:
            return
        self.cursor = cursor
        left = []
        for key, df in changed.items():
            if key in self.members:
                added, removed = (settled(df.where(F.col("change") == c).select("tbl", KEY)) for c in ("added", "removed"))
                self.members[key] = cut(self.members[key].join(removed, ["tbl", KEY], "left_anti").unionByName(added).distinct())
                left.append(removed)
        for name, df in rows.items():
            self._put(name, df.select(KEY, F.col("image").alias("after")))
        self._forget(left)
        for listener in self.listeners:
            listener(cursor, set(changed) & set(self.members))

    def _put(self, name: str, images: DataFrame) -> None:
        images = settled(images)
        if not images.isEmpty():
            self.tables[name] = cut(rewritten(self.tables[name], images))

    def _forget(self, left: list[DataFrame]) -> None:
        """Of the rows (tbl, key) that left a subscription, those that no subscription has go; other rows aren't looked at."""
        if not left:
            return
        gone = reduce(DataFrame.unionByName, left).distinct()
        if self.members:
            gone = gone.join(reduce(DataFrame.unionByName, self.members.values()), ["tbl", KEY], "left_anti")
        gone = settled(gone)
        for r in gone.select("tbl").distinct().collect():
            name = r["tbl"]
            self.tables[name] = cut(self.tables[name].join(gone.where(F.col("tbl") == name).select(KEY), KEY, "left_anti"))

    def release(self, key: str, now: float | None = None) -> None:
        """Nobody reads the subscription any more; with a time it is kept for TTL seconds, in case somebody does again."""
        if now is not None and key in self.members:
            self.released[key] = now
            return
        self.released.pop(key, None)
        members = self.members.pop(key, None)
        if members is not None:
            self._forget([members])

    def retain(self, key: str) -> bool:
        """Somebody reads a subscription that was released; False if it is gone."""
        self.released.pop(key, None)
        return key in self.members

    def sweep(self, now: float) -> list[str]:
        """Drops what was released TTL seconds ago."""
        late = [k for k, t in self.released.items() if now - t >= TTL]
        for k in late:
            self.release(k)
        return late

    def listen(self, listener: Callable[[int, set[str]], None]) -> Callable[[], None]:
        """Calls listener with the cursor and the subscriptions that each delta changed; returns what ends it."""
        self.listeners.append(listener)
        return lambda: self.listeners.remove(listener)

    def status(self) -> dict[str, Any]:
        return {"cursor": self.cursor, "subscriptions": sorted(self.members), "released": sorted(self.released)}

    def members_of(self, key: str) -> DataFrame:
        """A subscription's rows, with those of the ones it is based on."""
        found, seen = [], set()
        at: str | None = key
        while at is not None and at not in seen and at in self.members:
            seen.add(at)
            found.append(self.members[at])
            at = self.based_on.get(at)
        return reduce(DataFrame.unionByName, found).distinct()

    def read(self, planned: Planned, key: str | None = None, log: MutationLog | None = None) -> DataFrame:
        """The query's nested result over the rows that the subscription has (all rows without one), own writes on top.

        Rows that own writes made belong to it where they match.
        """
        tables = dict(self.tables)
        if key is not None:
            members = self.members_of(key)
            tables = {n: by_keys(df, members.where(F.col("tbl") == n)) for n, df in tables.items()}
        if log is not None:
            log.rebase(tables)
            written = {n for n, _ in log.images}
            tables |= {n: log.view(n) for n in written}
        return nested(planned, level_rows(planned, tables))
