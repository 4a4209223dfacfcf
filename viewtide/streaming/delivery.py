"""Delivering sequenced changes: batches within bounds, answers told apart, retries with growing waits, and quarantine.

A partition's transactions go out in order, so its changes meet in one task, which streams through them: it holds one batch
at a time, of ``Limits.transactions`` transactions and ``Limits.bytes`` bytes at most. Different partitions go out side by
side, as many as Spark runs tasks. What a sink answers decides: applied up to the batch's end, the next batch follows;
rejected for good, or too often, or acknowledged short of its end, the partition stops there; unreachable, the batch is tried
again.

What a partition that stopped still had to get is kept verbatim, in order, until an operator replays or drops it.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.sources.shared import Folder, cut

#: Answers that trying again doesn't change.
PERMANENT = {"wrong_partition", "stale_epoch", "invalid_row", "conflict"}
TRANSACTION = "partition string, seq bigint, gtid string, changes string"
OUTCOME = "partition string, first_seq bigint, last_seq bigint, status string, reason string, tries int"
Sink = Callable[[dict[str, Any]], dict[str, Any]]


class Unreachable(Exception):
    """A sink that gave no answer. transient: trying again may help."""

    def __init__(self, message: str, transient: bool = True):
        super().__init__(message)
        self.transient = transient


@dataclass(frozen=True)
class Limits:
    """Of a batch; of rejections and of attempts without an answer; the first wait in seconds and the longest."""

    transactions: int = 200
    bytes: int = 4 << 20
    rejects: int = 20
    attempts: int = 50
    wait: float = 0.25
    longest: float = 30.0


def transactions(sequenced: DataFrame) -> DataFrame:
    """Sequenced changes (partition, seq, gtid, ord, turn, tbl, op, key, before, after) -> a row for each transaction, its changes as JSON in their order."""
    change = F.struct("ord", "turn", F.col("tbl").alias("table"), "op", F.col("key").alias("key_text"), "before", "after")
    grouped = sequenced.groupBy("partition", "seq").agg(F.first("gtid").alias("gtid"), F.sort_array(F.collect_list(change)).alias("changes"))
    return grouped.select("partition", "seq", "gtid", F.to_json("changes").alias("changes"))


def bounded(rows: Iterator[tuple], limits: Limits) -> Iterator[list[tuple]]:
    """Rows (partition, seq, gtid, changes) in order -> batches of one partition; a transaction that is too large alone is a batch."""
    batch: list[tuple] = []
    size = 0
    for row in rows:
        n = len(row[3].encode())
        if batch and (row[0] != batch[0][0] or len(batch) >= limits.transactions or size + n > limits.bytes):
            yield batch
            batch, size = [], 0
        batch.append(row)
        size += n
    if batch:
        yield batch


def _parsed(text: str) -> list[dict[str, Any]]:
    return [{"table": c["table"], "op": c["op"], "key": json.loads(c["key_text"]) if c.get("key_text") else None, "before": c.get("before"), "after": c.get("after")} for c in json.loads(text)]


def send(sink: Sink, batch: dict[str, Any], limits: Limits, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None, int]:
    """(status, reason, tries): applied, rejected, or undelivered once there was no answer too often."""
    last, rejects, wait = batch["transactions"][-1]["seq"], 0, limits.wait
    for tries in range(1, limits.attempts + 1):
        try:
            answer = sink(batch)
        except Unreachable as e:
            reason = str(e)
            rejects += not e.transient
        else:
            if "rejected" not in answer:
                return ("applied", None, tries) if answer["applied_seq"] >= last else ("rejected", "ack_below_batch", tries)
            reason = answer["rejected"]
            rejects += 1
            if reason in PERMANENT:
                return "rejected", reason, tries
        if rejects >= limits.rejects:
            return "rejected", reason, tries
        sleep(wait + random.random() * wait / 2)
        wait = min(2 * wait, limits.longest)
    return "undelivered", reason, limits.attempts


def deliver(rows: DataFrame, sink: Callable[[], Sink], head: dict[str, Any], limits: Limits | None = None) -> DataFrame:
    """rows (transactions()) -> an outcome for each batch that was tried. sink makes a task's sink; head: protocol, schema_hash and epoch.

    Running the plan sends: callers cut it. A task that runs again sends again, which engines answer as duplicates.
    """
    import pyarrow as pa

    limits = limits or Limits()
    names = ["partition", "first_seq", "last_seq", "status", "reason", "tries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stopped = sink(), None
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for batch in bounded(each, limits):
            partition = batch[0][0]
            if partition == stopped:
                continue
            found = send(out, head | {"partition": partition, "transactions": [{"seq": s, "gtid": g, "changes": _parsed(c)} for _, s, g, c in batch]}, limits)
            stopped = partition if found[0] != "applied" else None
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((partition, batch[0][1], batch[-1][1], *found), kinds, strict=True)], names)

    return rows.select("partition", "seq", "gtid", "changes").repartition("partition").sortWithinPartitions("partition", "seq").mapInArrow(run, OUTCOME)


def batch_numbers(rows: DataFrame, limits: Limits) -> DataFrame:
    """partition, seq, batch: which batch of its partition each transaction goes out in, from 0."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = None, 0
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for batch in bounded(each, limits):
            number = number + 1 if batch[0][0] == partition else 0
            partition = batch[0][0]
            yield pa.RecordBatch.from_arrays([pa.array([partition] * len(batch), pa.string()), pa.array([r[1] for r in batch], pa.int64()), pa.array([number] * len(batch), pa.int64())], ["partition", "seq", "batch"])

    return rows.select("partition", "seq", "gtid", "changes").repartition("partition").sortWithinPartitions("partition", "seq").mapInArrow(run, "partition string, seq long, batch long")


class Quarantine:
    """Transactions of partitions that stopped, in files that are only added to, and marks of what was replayed or dropped."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)

    def rows(self) -> DataFrame:
        """partition, seq, gtid, changes, reason of what is kept."""
        names = self.folder.names()
        paths = [f"{self.folder.path}/{n}" for n in names if n.startswith("aside-")]
        schema = f"{TRANSACTION}, reason string"
        kept = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        through: dict[str, int] = {}
        for mark in (json.loads(self.folder.read(n)) for n in names if n.startswith("released-")):
            through[mark["partition"]] = max(mark["through"], through.get(mark["partition"], 0))
        if not through:
            return kept
        marks = self.spark.createDataFrame(sorted(through.items()), "partition string, through bigint")
        return kept.join(marks, "partition", "left").where("through is null or seq > through").drop("through")

    def put(self, rows: DataFrame) -> None:
        """rows: partition, seq, gtid, changes, reason."""
        rows.select("partition", "seq", "gtid", "changes", "reason").write.parquet(f"{self.folder.path}/aside-{uuid.uuid4().hex}")

    def partitions(self) -> DataFrame:
        return self.rows().select("partition").distinct()

    def listed(self) -> DataFrame:
        """partition, reason (of the first transaction), transactions, first_seq, last_seq."""
        return self.rows().groupBy("partition").agg(F.min_by("reason", "seq").alias("reason"), F.countDistinct("seq").alias("transactions"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))

    def _release(self, partition: str, through: int) -> None:
        self.folder.write(f"released-{uuid.uuid4().hex}.json", json.dumps({"partition": partition, "through": through}))

    def drop(self, partition: str) -> int:
        """Gives up what is kept of the partition; returns how many transactions that were."""
        row = self.listed().where(F.col("partition") == partition).first()
        if row is None:
            return 0
        self._release(partition, row["last_seq"])
        return row["transactions"]

    def replay(self, partition: str, sink: Callable[[], Sink], head: dict[str, Any], limits: Limits | None = None) -> list[str]:
        """Sends what is kept of the partition, in order; what was applied is no longer kept. Returns the batches' statuses."""
        rows = cut(self.rows().where(F.col("partition") == partition).dropDuplicates(["partition", "seq"]))
        # Run once, before anything looks at it: an order would sample it first.
        outcomes = sorted(cut(deliver(rows, sink, head, limits)).collect(), key=lambda o: o["first_seq"])
        applied = [o["last_seq"] for o in outcomes if o["status"] == "applied"]
        if applied:
            self._release(partition, max(applied))
        return [o["status"] for o in outcomes]


class Distributor:
    """Takes micro-batches of sequenced changes (foreachBatch), delivers them, and puts aside what partitions don't take."""

    def __init__(self, spark: SparkSession, quarantine: Quarantine, sink: Callable[[], Sink], head: dict[str, Any], limits: Limits | None = None):
        self.spark, self.quarantine, self.sink, self.head, self.limits = spark, quarantine, sink, head, limits or Limits()

    def take(self, sequenced: DataFrame, _batch_id: int = 0) -> DataFrame:
        """The outcomes. A partition that can't be reached raises Unreachable: the micro-batch runs again, and engines know what they have."""
        rows = cut(transactions(sequenced))
        stopped = cut(self.quarantine.partitions())
        later = rows.join(stopped, "partition", "left_semi")
        if not later.isEmpty():
            self.quarantine.put(later.withColumn("reason", F.lit("partition_quarantined")))
        outcomes = cut(deliver(rows.join(stopped, "partition", "left_anti"), self.sink, self.head, self.limits))
        refused = outcomes.where("status = 'rejected'").select("partition", "first_seq", "reason")
        aside = rows.join(refused, "partition").where("seq >= first_seq")
        if not refused.isEmpty():
            batch_end = outcomes.where("status = 'rejected'").select("partition", "last_seq")
            told = aside.join(batch_end, "partition").withColumn("reason", F.when(F.col("seq") <= F.col("last_seq"), F.col("reason")).otherwise(F.lit("partition_quarantined")))
            self.quarantine.put(told)
        lost = outcomes.where("status = 'undelivered'").first()
        if lost is not None:
            raise Unreachable(f"partition {lost['partition']}: {lost['reason']}")
        return outcomes


def counts(outcomes: DataFrame) -> DataFrame:
    """status, batches, transactions, retries: what a delivery's metrics are."""
    size = F.col("last_seq") - F.col("first_seq") + 1
    return outcomes.groupBy("status").agg(F.count("*").alias("batches"), F.sum(size).alias("transactions"), F.sum(F.col("tries") - 1).alias("retries"))

