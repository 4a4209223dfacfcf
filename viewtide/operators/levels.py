"""Evaluates planned queries: the root's rows, the rows of each include level, membership, and nested results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewtide.functions.kinds import sort_keys
from viewtide.operators.predicates import condition
from viewtide.plans.planner import Level, Planned
from viewtide.plans.schema import KEY, Schema, Table
from viewtide.sources.keys import having
from viewtide.sources.shared import cut

Path = tuple[str, ...]
MEMBER = ["path", "tbl", KEY]


def order_columns(planned: Planned, alias: str | None = None, reverse: bool = False) -> list[Column]:
    """The query's order, total since it ends with the primary key; reversed the last row comes first."""
    at = f"{alias}." if alias else ""
    flip = {"asc": "desc", "desc": "asc"} if reverse else {}
    return [k for name, direction in planned.order_by for k in sort_keys(F.col(f"{at}{name}"), planned.table.column(name).kind, flip.get(direction, direction))]


def filtered(schema: Schema, table: Table, where, tables: dict[str, DataFrame], rows: DataFrame | None = None) -> DataFrame:
    """The rows of table (or of rows, some of them) that where holds for."""
    rows = tables[table.name] if rows is None else rows
    return rows if where is None else rows.alias("p").where(condition(schema, table, where, "p", tables))


def top(planned: Planned, rows: DataFrame) -> DataFrame:
    """The first rows in the query's order, all without a limit."""
    return rows if planned.limit is None else rows.orderBy(*order_columns(planned)).limit(planned.limit)


def root_rows(planned: Planned, tables: dict[str, DataFrame], members: DataFrame | None = None, also: Column | None = None) -> DataFrame:
    """The root's rows, in no order. members (keys): of these only, and of rows that also holds for."""
    rows = tables[planned.table.name]
    if members is not None:
        flagged = rows.join(members.select(KEY).distinct().withColumn("__member", F.lit(True)), KEY, "left")
        admitted = F.col("__member").isNotNull() if also is None else F.col("__member").isNotNull() | also
        rows = flagged.where(admitted).drop("__member")
    return top(planned, filtered(planned.schema, planned.table, planned.query.where, tables, rows))


def related(level: Level, rows: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows that parents refer to by the level's relation, each once. parents should be cut."""
    return having(rows, level.relation.to_columns, parents.select(*level.relation.from_columns))


def level_rows(planned: Planned, tables: dict[str, DataFrame], root: DataFrame | None = None) -> dict[Path, DataFrame]:
    """Every level's rows by path, the root's under (). A limited root is run once, so all levels see the same rows."""
    root = root_rows(planned, tables) if root is None else root
    if planned.limit is not None and planned.levels:
        root = cut(root)
    found: dict[Path, DataFrame] = {}
    refers: dict[Path, DataFrame] = {}

    def take(path: Path, rows: DataFrame) -> None:
        found[path] = rows
        below = sorted({c for lv in planned.levels if lv.above == path for c in lv.relation.from_columns})
        if below:
            # What levels below need of this one is run once for all of them.
            refers[path] = cut(rows.select(*below).distinct())

    take((), root)
    for level in planned.levels:
        take(level.path, related(level, filtered(planned.schema, level.target, level.where, tables), refers[level.above]))
    return found


def membership(planned: Planned, levels: dict[Path, DataFrame]) -> DataFrame:
    """path, tbl, key of every row of every level: the materialized view."""
    target = {(): planned.table.name} | {lv.path: lv.target.name for lv in planned.levels}
    parts = [df.select(F.lit("/".join(p)).alias("path"), F.lit(target[p]).alias("tbl"), KEY) for p, df in levels.items()]
    return reduce(DataFrame.unionByName, parts)


def seen(members: DataFrame) -> DataFrame:
    """What a client is told: which rows it has, whatever the way to them."""
    return members.select("tbl", KEY).distinct()


def difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """change ('added' or 'removed') and the rows that only one side has; either side has no row twice."""
    added = after.join(before, after.columns, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.join(after, before.columns, "left_anti").withColumn("change", F.lit("removed")))


def recompute(planned: Planned, tables: dict[str, DataFrame]) -> DataFrame:
    """Membership from scratch."""
    return membership(planned, level_rows(planned, tables))


def nested(planned: Planned, levels: dict[Path, DataFrame]) -> DataFrame:
    """One row for each root row, in order, with a struct (one) or an array by key (many) for each include, to any depth."""

    def build(path: Path, table: Table, rows: DataFrame) -> DataFrame:
        for lv in (x for x in planned.levels if x.above == path):
            name, inner = lv.path[-1], build(lv.path, lv.target, levels[lv.path])
            on = [f"__t{i}" for i in range(len(lv.relation.to_columns))]
            value = F.struct(*(F.col(c) for c in inner.columns))
            keyed = inner.select(*(F.col(t).alias(n) for t, n in zip(lv.relation.to_columns, on, strict=True)), value.alias("__value"))
            grouped = keyed.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(F.col(f"__value.{KEY}").alias("k"), F.col("__value").alias("v")))).alias("__all"))
            rows = rows.join(grouped, [rows[f] == grouped[n] for f, n in zip(lv.relation.from_columns, on, strict=True)], "left").drop(*on)
            every = F.transform("__all", lambda x: x["v"])
            value = F.get(every, 0) if lv.relation.kind == "one" else F.coalesce(every, F.filter(every, lambda _: F.lit(False)), F.array().cast(rows.select(every.alias("e")).schema["e"].dataType))
            rows = rows.withColumn(f"${name}", value).drop("__all")
        return rows

    return build((), planned.table, levels[()]).orderBy(*order_columns(planned))


def grown(base: DataFrame, larger: DataFrame) -> DataFrame | None:
    """The members that a window's growth from base adds, or None if base isn't a part of the larger one."""
    if not base.join(larger, base.columns, "left_anti").isEmpty():
        return None
    return larger.join(base, larger.columns, "left_anti")


def chunks(rows: DataFrame, size: int = 500, order: str = KEY) -> DataFrame:
    """rows with the number of the chunk of size rows they are sent in.

    Numbers are running counts over ranges of the order: rows are ranked within their range and ranges' sizes are summed
    before, so no task sees all rows.
    """
    ranged = cut(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").count()
    before = sizes.select("__range", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    numbered = ranged.withColumn("__rank", rank).join(F.broadcast(before), "__range")
    return numbered.withColumn("chunk", F.floor((F.col("__before") + F.col("__rank") - 1) / size).cast("long")).drop("__range", "__rank", "__before")
