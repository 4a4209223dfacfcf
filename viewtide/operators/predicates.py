"""Predicates as columns. ``exists`` becomes a correlated subquery, which Catalyst plans as a semi, anti or existence join."""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.functions import kinds
from viewtide.plans.query import Predicate
from viewtide.plans.schema import Schema, Table

#: Every subquery has an alias of its own, so a table may be related to itself.
_fresh = count()
COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
}


def condition(schema: Schema, table: Table, where: Predicate | None, alias: str, tables: dict[str, DataFrame]) -> Column:
    """where over the rows of table, which the DataFrame it is put to has under alias. Three-valued, as SQL."""
    if where is None:
        return F.lit(True)
    op = where["op"]
    if op == "and":
        return reduce(and_, (condition(schema, table, a, alias, tables) for a in where["args"]), F.lit(True))
    if op == "or":
        return reduce(or_, (condition(schema, table, a, alias, tables) for a in where["args"]), F.lit(False))
    if op == "not":
        return ~condition(schema, table, where["arg"], alias, tables)
    if op == "exists":
        return _exists(schema, table, where, alias, tables)
    return _comparison(table, where, F.col(f"{alias}.{where['column']}"), tables[table.name])


def _exists(schema: Schema, table: Table, where: Predicate, alias: str, tables: dict[str, DataFrame]) -> Column:
    relation = table.relation(where["relation"])
    target, inner = schema.table(relation.target), f"r{next(_fresh)}"
    joined = [F.col(f"{inner}.{t}") == F.col(f"{alias}.{f}").outer() for f, t in zip(relation.from_columns, relation.to_columns, strict=True)]
    rows = tables[target.name].alias(inner).where(reduce(and_, joined) & condition(schema, target, where.get("where"), inner, tables))
    return rows.exists()


def _comparison(table: Table, where: Predicate, column: Column, df: DataFrame) -> Column:
    op, kind = where["op"], table.column(where["column"]).kind
    if op == "isNull":
        return column.isNull()
    if op == "isNotNull":
        return column.isNotNull()
    if op == "like":
        return kinds.like(column, where["pattern"])
    stored = df.schema[where["column"]].dataType
    if kind in ("decimal", "bytes"):
        # Compared as text, whatever a native table stores them as.
        column, stored = (F.base64(column) if stored.typeName() == "binary" else column.cast("string")), kinds.stored_type(kind)

    def value(v: Any) -> Column:
        return kinds.literal(kind, v, stored)

    if op == "in":
        # What can't be stored equals nothing.
        return column.isin(*(value(v) for v in where["values"] if kinds.storable(kind, v)))
    v = where["value"]
    if not kinds.storable(kind, v):
        raise kinds_error(where["column"], v)
    return COMPARE[op](column, value(v))


def kinds_error(column: str, value: Any) -> ValueError:
    return ValueError(f"{column}: {value} can't be stored")
