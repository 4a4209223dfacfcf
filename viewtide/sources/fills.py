"""Which fills are asked for: a registry that workers poll, with leases."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.plans.schema import Table

#: Seconds a worker has for a fill, and fills handed out at once.
LEASE, AT_ONCE = 180, 16


@dataclass
class Request:
    fill_id: int
    partition: str
    table: str
    leased_until: float = 0.0


class FillRegistry:
    """Requests in the order they came. A request is handed out again when its lease ran out."""

    def __init__(self) -> None:
        self.requests: dict[tuple[str, int], Request] = {}

    def enqueue(self, partition: str, fill_id: int, table: str) -> bool:
        """False if it is there already."""
        new = (partition, fill_id) not in self.requests
        self.requests.setdefault((partition, fill_id), Request(fill_id, partition, table))
        return new

    def poll(self, now: float | None = None) -> list[Request]:
        now = time.time() if now is None else now
        free = [r for r in self.requests.values() if r.leased_until <= now][:AT_ONCE]
        for r in free:
            r.leased_until = now + LEASE
        return free

    def dequeue(self, partition: str, fill_id: int) -> bool:
        return self.requests.pop((partition, fill_id), None) is not None


def parent_index(rows: DataFrame, table: Table) -> DataFrame:
    """tbl, parent_key, partition of every row that others take their partition from, in one scan of two columns."""
    key, partition = F.col(table.primary_key[0]).cast("string"), F.col(table.partition).cast("string")
    return rows.where(F.col(table.partition).isNotNull()).select(F.lit(table.name).alias("tbl"), key.alias("parent_key"), partition.alias("partition"))
