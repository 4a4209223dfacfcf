"""A live table's rows: a base in buckets of keys, and tiers of changes on top of it.

Changes are kept by key: the last ones on the driver, LOCAL at most, older ones in tiers in the shared folder, each GROWTH
times as large as the one above it. A full tier is merged into the next, the last into the base once it passes a share of the
base. So a change is rewritten about GROWTH times for each tier, of which there are few, and not for each row of the table.
Base and tiers are Parquet files by bucket of the key's hash, about BUCKET_ROWS rows each in the order of keys, and a look-up
reads only the buckets that its keys are in, and of these the pages.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, MutableMapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.operators.changes import image
from viewtide.plans.schema import KEY, Table
from viewtide.sources.keys import KeySet, local
from viewtide.sources.shared import shared_folder

#: Changes on the driver, a tier's size over that of the one above it, the base's share that the last tier may have, rows of a bucket.
LOCAL, GROWTH, SHARE, BUCKET_ROWS = 2_000, 8, 0.1, 20_000
#: Rows of a page: a look-up reads the pages that its keys are in, as a bucket is in the order of keys.
PAGE_ROWS = 500
BUCKET = "__bucket"
IMAGES = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("after", T.StringType())])


@dataclass
class Part:
    """Rows in buckets; a tier's rows have ``__gone`` where the key has no row any more."""

    folder: str
    rows: int
    buckets: int

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.folder)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class LiveTable:
    spark: SparkSession
    table: Table
    schema: T.StructType
    folder: str | None = None
    base: Part | None = None
    tiers: list[Part] = field(default_factory=list)
    #: key -> the row as JSON, None where it is gone.
    late: dict[str, str | None] = field(default_factory=dict)
    #: Rows written to the shared folder so far.
    written: int = 0
    _seen: tuple[dict, DataFrame] | None = field(default=None, repr=False)

    def _write(self, rows: DataFrame, n: int) -> Part:
        buckets = max(1, min(4096, n // BUCKET_ROWS))
        folder = shared_folder(self.spark, f"{self.folder or 'live'}-{self.table.name}")
        dealt = rows.withColumn(BUCKET, bucket_of(F.col(KEY), buckets))
        dealt = dealt.repartition(buckets, BUCKET) if buckets > 1 else dealt.coalesce(1)
        dealt.sortWithinPartitions(BUCKET, KEY).write.option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy(BUCKET).parquet(folder)
        self.written += n
        return Part(folder, n, buckets)

    def load(self, rows: DataFrame, n: int) -> None:
        self.base, self.tiers, self.late = self._write(rows, n), [], {}

    @property
    def tier_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("__gone", T.BooleanType())])

    def _late(self, keys: Iterable[str] | None = None) -> DataFrame:
        """The driver's changes (of some keys) as a tier's rows."""
        images = self.late if keys is None else {k: self.late[k] for k in keys if k in self.late}
        if self._seen is not None and self._seen[0] == images:
            return self._seen[1]
        wanted = sorted(images)
        rows = local(self.spark, IMAGES, [(k, self.late[k]) for k in wanted])
        names = [f.name for f in self.schema.fields if f.name != KEY]
        stored = {f.name: f.dataType for f in self.schema.fields}
        cells = rows.select(KEY, image(F.col("after"), self.table, stored).alias("i"), F.col("after").isNull().alias("__gone"))
        self._seen = images, cells.select(KEY, *(F.col(f"i.{c}").alias(c) for c in names), "__gone")
        return self._seen[1]

    def _layers(self) -> list[DataFrame]:
        """The changes, newest first."""
        return [*([self._late()] if self.late else []), *(p.read(self.spark, self.tier_schema).drop(BUCKET) for p in self.tiers)]

    def view(self) -> DataFrame:
        """All rows as they are now."""
        return _flat(self._layers(), self.base.read(self.spark, self.schema).drop(BUCKET))

    def rows(self, keys: KeySet) -> DataFrame:
        """The rows with one of the keys; only the buckets that these are in are read."""
        if keys.small is None or not keys.small:
            return keys.within(self.view())
        late = [k for k in keys.small if k in self.late]
        older = keys - KeySet(self.spark, frozenset(late))
        found = [self._late(late).where("not __gone").drop("__gone")] if late else []
        if not older.empty:
            layers = [self._pruned(p, self.tier_schema, older) for p in self.tiers]
            found.append(_flat(layers, self._pruned(self.base, self.schema, older)))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def _pruned(self, part: Part, schema: T.StructType, keys: KeySet) -> DataFrame:
        df = part.read(self.spark, schema)
        if part.buckets > 1:
            used = {r[0] for r in keys.df().select(bucket_of(F.col(KEY), part.buckets)).collect()}
            if len(used) < part.buckets:
                df = df.where(F.col(BUCKET).isin(*sorted(used)))
        return keys.within(df.drop(BUCKET))

    def put(self, images: dict[str, str | None]) -> None:
        """Rows after a batch, as JSON by key."""
        self.late = self.late | images
        if len(self.late) <= LOCAL:
            return
        merged, rows, depth, room = self._late(), len(self.late), 0, LOCAL * GROWTH
        while depth < len(self.tiers) and self.tiers[depth].rows + rows > room:
            merged, rows, depth, room = _over(merged, self.tiers[depth].read(self.spark, self.tier_schema).drop(BUCKET)), rows + self.tiers[depth].rows, depth + 1, room * GROWTH
        if rows > max(LOCAL, SHARE * self.base.rows) and depth == len(self.tiers):
            whole = _flat([merged], self.base.read(self.spark, self.schema).drop(BUCKET))
            self.base, self.tiers, self.late = self._write(whole, self.base.rows + rows), [], {}
            return
        if depth < len(self.tiers):
            merged, rows = _over(merged, self.tiers[depth].read(self.spark, self.tier_schema).drop(BUCKET)), rows + self.tiers[depth].rows
        self.tiers[: depth + 1] = [self._write(merged, rows)]
        self.late = {}

    def state(self) -> dict:
        part = lambda p: [p.folder, p.rows, p.buckets]
        return {"base": part(self.base), "tiers": [part(p) for p in self.tiers], "late": self.late, "schema": json.loads(self.schema.json())}

    @staticmethod
    def restored(spark: SparkSession, table: Table, state: dict) -> LiveTable:
        return LiveTable(spark, table, T.StructType.fromJson(state["schema"]), base=Part(*state["base"]), tiers=[Part(*p) for p in state["tiers"]], late=state["late"])


def _over(newer: DataFrame, older: DataFrame) -> DataFrame:
    """A tier's rows over another's."""
    return newer.unionByName(older.join(newer.select(KEY), KEY, "left_anti"))


def _flat(layers: list[DataFrame], base: DataFrame) -> DataFrame:
    """base under the layers, newest first. A small layer is broadcast, since Spark knows its size; a large one is joined by shuffle."""
    if not layers:
        return base
    top = layers[0]
    for layer in layers[1:]:
        top = _over(top, layer)
    return top.where("not __gone").drop("__gone").unionByName(base.join(top.select(KEY), KEY, "left_anti"))


class LiveRows(MutableMapping):
    """Live tables' rows as a mapping from (table, key) to the row, for the push protocol's source."""

    def __init__(self, live: dict[str, LiveTable]):
        self.live = live

    def __getitem__(self, at: tuple[str, str]) -> dict[str, Any]:
        name, key = at
        live = self.live[name]
        if key in live.late:
            text = live.late[key]
            if text is None:
                raise KeyError(at)
            return json.loads(text)
        found = live.rows(KeySet(live.spark, frozenset({key}))).drop(KEY).first()
        if found is None:
            raise KeyError(at)
        return found.asDict()

    def __setitem__(self, at: tuple[str, str], row: dict[str, Any]) -> None:
        self.live[at[0]].put({at[1]: json.dumps(row, default=str)})

    def __delitem__(self, at: tuple[str, str]) -> None:
        self.live[at[0]].put({at[1]: None})

    def __iter__(self) -> Iterator[tuple[str, str]]:
        return ((n, r[KEY]) for n, t in self.live.items() for r in t.view().select(KEY).toLocalIterator())

    def __len__(self) -> int:
        return sum(t.view().count() for t in self.live.values())


class LiveIds(MutableMapping):
    """A live table of clients (client_id, last_mutation_id) as a mapping from client to its last id."""

    def __init__(self, live: LiveTable):
        self.rows = LiveRows({live.table.name: live})
        self.name = live.table.name

    def _at(self, client: str) -> tuple[str, str]:
        return self.name, json.dumps([client], ensure_ascii=False)

    def __getitem__(self, client: str) -> int:
        return int(self.rows[self._at(client)]["last_mutation_id"])

    def __setitem__(self, client: str, last: int) -> None:
        self.rows[self._at(client)] = {"client_id": client, "last_mutation_id": last}

    def __delitem__(self, client: str) -> None:
        del self.rows[self._at(client)]

    def __iter__(self) -> Iterator[str]:
        return (json.loads(k)[0] for _, k in self.rows)

    def __len__(self) -> int:
        return len(self.rows)
