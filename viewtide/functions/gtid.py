"""Sets of global transaction ids: for each source id, closed intervals of sequence numbers, sorted and apart.

Sets are partially ordered, so positions are compared by containment, never by size. The parsing and algebra are plain
Python; ``contains_column`` tests a column of ids against one set with column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Intervals = tuple[tuple[int, int], ...]
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


class BadGtid(ValueError):
    """Text that isn't an id, a set, or a step of one."""


def _merged(spans: Iterable[tuple[int, int]]) -> Intervals:
    """Sorted, with overlapping and adjacent intervals made one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return tuple(out)


def parse_gtid(text: str) -> tuple[str, int]:
    """``uuid:n``"""
    uuid, _, n = text.strip().rpartition(":")
    if not _UUID.fullmatch(uuid.lower()) or not n.isdecimal() or int(n) < 1:
        raise BadGtid(f"not a transaction id: {text!r}")
    return uuid.lower(), int(n)


@dataclass(frozen=True)
class GtidSet:
    intervals: dict[str, Intervals] = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> GtidSet:
        """``uuid:1-5:7,uuid:3``, with or without a flavour such as ``MySQL56/`` before it."""
        spans: dict[str, list[tuple[int, int]]] = {}
        for part in text.strip().rpartition("/")[2].split(","):
            if not (part := part.strip()):
                continue
            uuid, *ranges = part.split(":")
            if not _UUID.fullmatch(uuid.lower()) or not ranges:
                raise BadGtid(f"not a transaction set: {text!r}")
            for r in ranges:
                m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", r)
                if not m or int(m[1]) < 1 or int(m[2] or m[1]) < int(m[1]):
                    raise BadGtid(f"not an interval: {r!r}")
                spans.setdefault(uuid.lower(), []).append((int(m[1]), int(m[2] or m[1])))
        return GtidSet({u: _merged(s) for u, s in spans.items()})

    def __str__(self) -> str:
        return ",".join(":".join([u, *(f"{a}" if a == z else f"{a}-{z}" for a, z in spans)]) for u, spans in sorted(self.intervals.items()))

    def __contains__(self, gtid: str) -> bool:
        uuid, n = parse_gtid(gtid)
        return any(a <= n <= z for a, z in self.intervals.get(uuid, ()))

    def __hash__(self) -> int:
        return hash(str(self))

    def count(self) -> int:
        return sum(z - a + 1 for spans in self.intervals.values() for a, z in spans)

    def is_subset_of(self, other: GtidSet) -> bool:
        return all(any(b <= a and z <= y for b, y in other.intervals.get(u, ())) for u, spans in self.intervals.items() for a, z in spans)

    def union(self, other: GtidSet) -> GtidSet:
        return GtidSet({u: _merged([*self.intervals.get(u, ()), *other.intervals.get(u, ())]) for u in {*self.intervals, *other.intervals}})

    def difference(self, other: GtidSet) -> GtidSet:
        """What is in this set and not in the other."""
        out = {}
        for u, spans in self.intervals.items():
            rest = []
            for a, z in spans:
                for b, y in other.intervals.get(u, ()):
                    if y < a or b > z:
                        continue
                    if b > a:
                        rest.append((a, b - 1))
                    a = y + 1
                if a <= z:
                    rest.append((a, z))
            if rest:
                out[u] = tuple(rest)
        return GtidSet(out)

    def add(self, gtid: str) -> GtidSet:
        uuid, n = parse_gtid(gtid)
        return self.union(GtidSet({uuid: ((n, n),)}))

    def gtids(self) -> Iterator[str]:
        for u, spans in sorted(self.intervals.items()):
            for a, z in spans:
                yield from (f"{u}:{n}" for n in range(a, z + 1))

    def contains_column(self, gtid: Column) -> Column:
        """Whether each id is in this set; null for null."""
        uuid, n = F.lower(F.substring_index(gtid, ":", 1)), F.substring_index(gtid, ":", -1).try_cast("bigint")
        found = F.lit(False)
        for u, spans in self.intervals.items():
            inside = F.lit(False)
            for a, z in spans:
                inside = inside | n.between(a, z)
            found = found | ((uuid == u) & inside)
        return F.when(gtid.isNotNull(), F.coalesce(found, F.lit(False)))


def step(before: GtidSet, after: GtidSet, merged: bool = False) -> str:
    """The one id that after adds to before. Nothing may be lost; more than one is an error unless merged, then a set."""
    if not before.is_subset_of(after):
        raise BadGtid("the position lost transactions")
    added = after.difference(before)
    n = added.count()
    if n == 1 or (merged and n):
        return str(added)
    raise BadGtid(f"a step of {n} transactions")
