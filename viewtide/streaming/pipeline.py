"""The change stream as a Structured Streaming query: transactions in, routed and sequenced changes out, exactly once.

Each micro-batch is routed and sequenced as a whole against versioned state (the parent index and each partition's last
sequence number), and publishes its changes, the new state and its batch id as one version. A batch that runs again after a
failure finds its id published and does nothing.

The stream's order is the source's: files by their names, and lines as they come in a file. Commit times play no part in it.
Transactions that the position has already, as when a file is sent again, are dropped by their ids. A version holds what the
batch says about parents, not the whole index: a batch looks up the parents that it asks for in the versions since the last
one that has the index as a whole, which one in COMPACT has.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener
from pyspark.sql.window import Window

from viewtide.functions.gtid import GtidSet
from viewtide.operators.changes import asked_parents, exploded, latest_parents, observed, parent_updates, position_of, quarantine, route, sequence, synced
from viewtide.plans.schema import Schema
from viewtide.sources.shared import cut
from viewtide.sources.tables import Versions


#: Versions after which the parent index is written as a whole.
COMPACT = 50
#: Bytes of a file that its lines are numbered by, as a power of two.
FILE_BITS = 42


def numbered(batch: DataFrame) -> DataFrame:
    """Transactions with their place in the stream: the file's rank, then where the line's block begins and how many lines are before it there.

    A line has a byte at least, so these places grow within a file, whatever blocks it is read in. Only files are ranked together.
    """
    names = batch.columns
    file = F.coalesce("source_file", F.lit("")) if "source_file" in names else F.lit("")
    block = F.coalesce("source_block", F.lit(0)) if "source_block" in names else F.lit(0)
    rows = cut(batch.select("*", file.alias("__file"), block.cast("long").alias("__block"), F.monotonically_increasing_id().alias("__row")))
    blocks = rows.groupBy("__file", "__block").agg(F.min("__row").alias("__first"))
    files = rows.select("__file").distinct().withColumn("__rank", F.row_number().over(Window.orderBy("__file")) - 1)
    place = F.shiftleft(F.col("__rank").cast("long"), FILE_BITS) + F.col("__block") + F.col("__row") - F.col("__first")
    placed = rows.join(blocks, ["__file", "__block"]).join(files, "__file").withColumn("stream_index", place)
    return placed.select(*names, "stream_index")


class Watch(StreamingQueryListener):
    """When a stream last had rows and last did anything, to tell one that stalls from one without news."""

    def __init__(self, stall: float = 30, no_progress: float = 120):
        self.stall, self.no_progress = stall, no_progress
        self.progress = self.rows = time.time()
        self.ended: str | None = None

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        self.progress = self.rows = time.time()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.progress = time.time()
        if event.progress.numInputRows:
            self.rows = self.progress

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.progress = time.time()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended = event.exception or "ended"

    def stalled(self, now: float | None = None) -> bool:
        now = time.time() if now is None else now
        return now - self.progress > self.stall or now - self.rows > self.no_progress


class ChangeStream:
    """Routes and sequences a stream of one shard's transactions into ``folder``."""

    def __init__(self, spark: SparkSession, schema: Schema, folder: str, position: str | None = None):
        """position: where to begin; what it contains is skipped. ``position_of`` a source's ids is its current position."""
        self.spark, self.schema, self.state = spark, schema, Versions(spark, folder)
        self.begin = GtidSet.parse(position or "")

    def position(self, version: int | None = None) -> GtidSet:
        """What the stream has taken."""
        stored = self.state.read("position", version)
        return self.begin if stored is None else GtidSet.parse(stored.first()["position"])

    def _whole_index(self, last: int) -> int:
        """The last version that has the parent index as a whole, -1 if none has."""
        return next((v for v in range(last, -1, -1) if self.state.has("parents_whole", v)), -1)

    def parents(self, asked: DataFrame | None = None) -> DataFrame | None:
        """The parent index (tbl, parent_key, partition), or the part of it that is asked for (tbl, parent_key)."""
        last = self.state.current()
        whole = self._whole_index(last)
        found = [self.state.read("parents_whole", whole).withColumn("version", F.lit(whole))] if whole >= 0 else []
        found += [df.withColumn("version", F.lit(v)) for v in range(whole + 1, last + 1) if (df := self.state.read("parents", v)) is not None]
        if not found:
            return None
        rows = reduce(DataFrame.unionByName, found)
        if asked is not None:
            rows = rows.join(asked, ["tbl", "parent_key"], "left_semi")
        return rows.groupBy("tbl", "parent_key").agg(F.max_by("partition", "version").alias("partition"))

    def take(self, batch: DataFrame, batch_id: int) -> bool:
        """One micro-batch. False if it was taken before."""
        last = self.state.current()
        if batch_id <= self.taken(last):
            return False
        position = self.position(last)
        fresh = batch if not position.intervals else batch.where(~F.coalesce(position.contains_column(F.col("gtid")), F.lit(False)))
        rows = cut(numbered(fresh))
        changes = cut(synced(exploded(rows), self.schema))
        sequences, put_aside = (self.state.read(n, last) for n in ("sequences", "quarantined"))
        routed = cut(observed(route(changes, self.schema, self.parents(asked_parents(changes, self.schema))), "routing"))
        sequenced = cut(sequence(routed, sequences))
        aside = put_aside if put_aside is not None else self.spark.createDataFrame([], "partition string, reason string")
        goes, stays = quarantine(sequenced, aside)
        newest = sequenced.groupBy("partition").agg(F.max("seq").alias("seq"))
        if sequences is not None:
            newest = newest.unionByName(sequences).groupBy("partition").agg(F.max("seq").alias("seq"))
        reached = self.spark.createDataFrame([(str(position.union(position_of(rows))),)], "position string")
        tables = {"changes": goes, "aside": stays, "dropped": routed.where("partition is null"), "parents": latest_parents(parent_updates(changes, self.schema)), "sequences": newest, "quarantined": aside, "position": reached, "batch": self._batch(batch_id)}
        if last + 1 - self._whole_index(last) >= COMPACT:
            known = self.parents()
            tables["parents_whole"] = latest_parents(parent_updates(changes, self.schema), known)
        return self.state.publish(last + 1, tables)

    def taken(self, version: int | None = None) -> int:
        """The last batch's id, -1 before the first."""
        row = self.state.read("batch", version)
        return row.first()["id"] if row is not None else -1

    def _batch(self, batch_id: int) -> DataFrame:
        return self.spark.createDataFrame([(batch_id,)], "id long")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda df, i: self.take(df, i)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def changes(self) -> DataFrame | None:
        """Everything that was published, in (partition, seq, ord, turn) order within partitions."""
        return self.state.read_all("changes")

    def put_aside(self, partition: str, reason: str) -> None:
        """From the next batch on, the partition's changes are kept verbatim apart."""
        version = self.state.current()
        old = self.state.read("quarantined", version)
        new = self.spark.createDataFrame([(partition, reason)], "partition string, reason string")
        tables = {n: df for n in ("sequences", "position") if (df := self.state.read(n, version)) is not None}
        self.state.publish(version + 1, tables | {"batch": self._batch(self.taken(version)), "quarantined": new if old is None else old.unionByName(new)})


class SequenceProcessor(StatefulProcessor):
    """Numbers a partition's transactions without gaps, and drops those it has numbered: state is the last number and id."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seq bigint, stream_index bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        seq, done = self.last.get() if self.last.exists() else (0, -1)
        frame = pd.concat(list(rows)).drop_duplicates("stream_index").sort_values("stream_index")
        frame = frame[frame["stream_index"] > done]
        if len(frame):
            numbers = range(seq + 1, seq + len(frame) + 1)
            self.last.update((seq + len(frame), int(frame["stream_index"].iloc[-1])))
            yield pd.DataFrame({"partition": [key[0]] * len(frame), "stream_index": frame["stream_index"].to_numpy(), "gtid": frame["gtid"].to_numpy(), "seq": list(numbers)})

    def close(self) -> None:
        pass


def sequenced_stream(routed: DataFrame) -> DataFrame:
    """routed (partition, stream_index, gtid), a stream -> with seq, kept in the state store."""
    return routed.groupBy("partition").transformWithStateInPandas(SequenceProcessor(), "partition string, stream_index bigint, gtid string, seq bigint", "append", "none")
