"""Incremental maintenance of a query's membership under changes, set by set.

Changes of a batch are one row for each key: the image before and the image after (null: none). Only rows that a change can have
moved are looked at again: changed rows, and rows that reach a changed row by an ``exists`` of the root or of an include, found by
walking the relations back from the images. Of these, what was a member is looked up, what is one now is evaluated, and the
difference is the result; rows and members that aren't touched are never read. A relation whose columns are a whole primary key is
followed by keys; the other way round the table is read for the values that are asked for. A full window reads its table only
when a member left it or moved within the order; then, and only then, rows outside may have to come in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.functions.kinds import key_text
from viewtide.operators.levels import MEMBER, Path, filtered, top
from viewtide.plans.planner import Planned, chains
from viewtide.plans.query import Predicate
from viewtide.plans.schema import KEY, Relation, Table
from viewtide.sources.keys import KeySet, local, settled, union
from viewtide.sources.tables import rewritten

Changes = dict[str, DataFrame]


def apply_changes(tables: dict[str, DataFrame], changes: Changes) -> dict[str, DataFrame]:
    """The tables after the changes (key, before, after)."""
    return tables | {name: rewritten(tables[name], df) for name, df in changes.items()}


def images(changes: DataFrame) -> DataFrame:
    """All images of changed rows, before and after, as rows."""
    both = changes.select(F.explode(F.array("before", "after")).alias("i")).where("i is not null")
    return both.select("i.*")


def rows_at(tables, name: str, keys: KeySet) -> DataFrame:
    """The rows of a table with one of the keys; live tables look only where these are."""
    return tables.rows(name, keys) if hasattr(tables, "rows") else keys.within(tables[name])


def _by_key(table: Table, columns: tuple[str, ...], primary: tuple[str, ...], rows: DataFrame) -> KeySet | None:
    """Keys of table's rows whose columns ``primary`` have the values that rows have in columns, if primary is its whole key."""
    if set(primary) != set(table.primary_key):
        return None
    at = dict(zip(primary, columns, strict=True))
    known = reduce(and_, (F.col(at[k]).isNotNull() for k in table.primary_key))
    key = key_text([(F.col(at[k]), table.column(k).kind) for k in table.primary_key])
    return KeySet.of(rows.where(known).select(key.alias(KEY)))


def _matching(at: DataFrame, columns: tuple[str, ...], rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    names = [f"__w{i}" for i in range(len(columns))]
    wanted = rows.select(*(F.col(v).alias(n) for v, n in zip(values, names, strict=True))).distinct()
    return at.join(wanted, [at[c] == wanted[n] for c, n in zip(columns, names, strict=True)], "left_semi")


def referring(tables, relation: Relation, at: Table, rows: DataFrame) -> DataFrame:
    """The rows of at that refer to one of rows by the relation."""
    keys = _by_key(at, relation.to_columns, relation.from_columns, rows)
    return rows_at(tables, at.name, keys) if keys is not None else _matching(tables[at.name], relation.from_columns, rows, relation.to_columns)


def referred(tables, relation: Relation, target: Table, rows: DataFrame) -> KeySet:
    """Keys of target's rows that one of rows refers to by the relation; by keys they needn't be there."""
    keys = _by_key(target, relation.from_columns, relation.to_columns, rows)
    return keys if keys is not None else KeySet.of(_matching(tables[target.name], relation.to_columns, rows, relation.from_columns))


def reaching(tables, table: Table, way: tuple[Relation, ...], changed: DataFrame, schema) -> DataFrame:
    """Keys of table's rows from which the way leads to one of the images; the changed table itself isn't read."""
    rows = changed
    for depth, relation in enumerate(reversed(way)):
        at = schema.table(way[-depth - 2].target) if depth + 1 < len(way) else table
        rows = referring(tables, relation, at, rows)
    return rows.select(KEY)


def candidates(planned: Planned, table: Table, where: Predicate | None, tables, changes: Changes, keys: dict[str, KeySet], spark: SparkSession) -> KeySet:
    """Keys of table's rows whose place in a level may have changed by themselves or through where."""
    found = [keys[table.name]] if table.name in keys else []
    for way in chains(planned.schema, table, where):
        if way[-1].target in changes:
            found.append(KeySet.of(reaching(tables, table, way, images(changes[way[-1].target]), planned.schema)))
    return union(spark, found)


class FrameMembers:
    """Membership that is one DataFrame (path, tbl, key)."""

    def __init__(self, df: DataFrame):
        self.df = df

    def of(self, path: Path, keys: KeySet) -> KeySet:
        """Which of the keys are members at path."""
        return keys if keys.empty else KeySet.of(keys.within(self.all(path)))

    def all(self, path: Path) -> DataFrame:
        return self.df.where(F.col("path") == "/".join(path)).select(KEY)


@dataclass(frozen=True)
class Move:
    """Of the keys that were looked at in a level: which were members and which are now."""

    touched: KeySet
    was: KeySet
    now: KeySet

    @property
    def added(self) -> KeySet:
        return self.now - self.was

    @property
    def removed(self) -> KeySet:
        return self.was - self.now


def _root(planned: Planned, members, after, changes: Changes, keys: dict[str, KeySet], spark: SparkSession) -> Move:
    table = planned.table
    touched = candidates(planned, table, planned.query.where, after, changes, keys, spark)
    none = KeySet.none(spark)
    if touched.empty:
        return Move(none, none, none)
    matching = KeySet.of(filtered(planned.schema, table, planned.query.where, after, rows_at(after, table.name, touched)))
    if planned.limit is None:
        return Move(touched, members.of((), touched), matching)
    order = [n for n, _ in planned.order_by]
    ranked = lambda rows: rows.select(KEY, *(n for n in dict.fromkeys(order) if n != KEY))
    known = getattr(members, "window", None)
    window = KeySet.of(members.all(()) if known is None else known)
    was = window & touched
    full = window.small is None or len(window.small) >= planned.limit
    again = not (was - matching).empty
    if not again and not was.empty and table.name in changes:
        moved = ~F.struct(*(F.col(f"before.{n}") for n in order)).eqNullSafe(F.struct(*(F.col(f"after.{n}") for n in order)))
        again = not (KeySet.of(changes[table.name].where(moved)) & was).empty
    if again and full:
        rows = settled(ranked(top(planned, filtered(planned.schema, table, planned.query.where, after))))
    elif not again and (matching - window).empty:
        rows = known
    else:
        # Rows that weren't touched stand as they stood; if they are at hand, they aren't read again.
        standing = window - touched
        stood = standing.within(known) if known is not None else ranked(rows_at(after, table.name, standing))
        rows = settled(top(planned, stood.unionByName(ranked(rows_at(after, table.name, (was & matching) | matching)))))
    new = window if rows is None else KeySet.of(rows)
    if rows is not None and hasattr(members, "window"):
        members.window = rows
    every = touched | (new - window) | (window - new)
    return Move(every, window & every, new & every)


def affected(planned: Planned, members, after, changes: Changes) -> dict[Path, Move]:
    """What the changes move, by path. members: as before (``of`` and ``all``); after: the tables after the changes."""
    changes = {n: df for n, df in changes.items() if n in planned.tables}
    if not changes:
        return {}
    spark = next(iter(changes.values())).sparkSession
    keys = {n: KeySet.of(df) for n, df in changes.items()}
    none = KeySet.none(spark)
    out = {(): _root(planned, members, after, changes, keys, spark)}
    tables = {(): planned.table} | {lv.path: lv.target for lv in planned.levels}
    for level in planned.levels:
        above, parent = out[level.above], tables[level.above]
        moved = above.added | above.removed | keys.get(parent.name, none)
        touched = candidates(planned, level.target, level.where, after, changes, keys, spark)
        if not moved.empty:
            # Rows that parents refer to now, or referred to.
            parents = rows_at(after, parent.name, moved)
            if parent.name in changes:
                old = changes[parent.name].where("before is not null")
                parents = parents.unionByName(old.select(KEY, *(F.col(f"before.{c}").alias(c) for c in parents.columns if c != KEY)))
            touched = touched | referred(after, level.relation, level.target, parents)
        if touched.empty:
            out[level.path] = Move(none, none, none)
            continue
        rows = settled(filtered(planned.schema, level.target, level.where, after, rows_at(after, level.target.name, touched)))
        parents = settled(referring(after, level.relation, parent, rows).select(KEY, *level.relation.from_columns))
        held = KeySet.of(parents)
        standing = (members.of(level.above, held) - above.removed) | (held & above.added)
        now = KeySet.of(_matching(rows, level.relation.to_columns, standing.within(parents), level.relation.from_columns))
        out[level.path] = Move(touched, members.of(level.path, touched), now)
    return out


def _tables(planned: Planned) -> dict[Path, Table]:
    return {(): planned.table} | {lv.path: lv.target for lv in planned.levels}


def maintain(planned: Planned, members: DataFrame, after, changes: Changes) -> DataFrame:
    """members (path, tbl, key) after the changes; equal to recomputing them."""
    tables = _tables(planned)
    for path, move in affected(planned, FrameMembers(members), after, changes).items():
        if not move.removed.empty:
            gone = move.removed.df().select(F.lit("/".join(path)).alias("path"), KEY)
            members = members.join(gone, ["path", KEY], "left_anti").select(*MEMBER)
        if not move.added.empty:
            members = members.unionByName(move.added.df().select(F.lit("/".join(path)).alias("path"), F.lit(tables[path].name).alias("tbl"), KEY))
    return members.select(*MEMBER)


def entered_and_left(planned: Planned, members, moves: dict[Path, Move], spark: SparkSession) -> dict[str, tuple[KeySet, KeySet]]:
    """By table the rows that entered or left the query as a whole, whatever the way to them. members: as before."""
    tables, out = _tables(planned), {}
    for name in {t.name for t in tables.values()}:
        paths = [p for p, t in tables.items() if t.name == name and p in moves]
        changed = union(spark, [s for p in paths for s in (moves[p].added, moves[p].removed)])
        if changed.empty:
            continue
        was = {p: moves[p].was & changed if (changed - moves[p].touched).empty else members.of(p, changed) for p in paths}
        before = union(spark, list(was.values()))
        after = union(spark, [(was[p] - moves[p].removed) | (moves[p].added & changed) for p in paths])
        out[name] = (after - before, before - after)
    return out


def row_updates(changes: Changes, entered: dict[str, KeySet], present: dict[str, KeySet], after) -> dict[str, DataFrame]:
    """By table the images to send (key, image): of rows that entered, of changed members of any query, and null for deleted rows."""
    out = {}
    for name in {*changes, *entered}:
        df = after[name]
        columns = [c for c in df.columns if c != KEY]
        keys = entered.get(name) or KeySet.none(df.sparkSession)
        gone = None
        if name in changes:
            keys = keys | present.get(name, KeySet.none(df.sparkSession))
            gone = changes[name].where("after is null").select(KEY)
        rows = rows_at(after, name, keys)
        sent = rows.select(KEY, F.struct(*columns).alias("image"))
        if gone is not None:
            sent = sent.join(gone, KEY, "left_anti").unionByName(gone.select(KEY, F.lit(None).cast(sent.schema["image"].dataType).alias("image")))
        out[name] = sent
    return out


def changed_rows(spark: SparkSession, entered: dict[str, tuple[KeySet, KeySet]]) -> DataFrame:
    """tbl, key, change of entered_and_left()."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("tbl", KEY, "change")])
    small = [(name, k, change) for name, sides in sorted(entered.items()) for change, s in zip(("added", "removed"), sides, strict=True) if s.small is not None for k in sorted(s.small)]
    large = [s.df().select(F.lit(name).alias("tbl"), KEY, F.lit(change).alias("change")) for name, sides in entered.items() for change, s in zip(("added", "removed"), sides, strict=True) if s.small is None]
    return reduce(DataFrame.unionByName, large, local(spark, schema, small))
