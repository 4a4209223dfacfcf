"""Queries as data: a table, a predicate, an order, a limit, and nested includes; with a builder and their JSON form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

Predicate = dict[str, Any]


@dataclass(frozen=True)
class Include:
    relation: str
    where: Predicate | None = None
    include: tuple[Include, ...] = ()


@dataclass(frozen=True)
class Query:
    table: str
    where: Predicate | None = None
    order_by: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    include: tuple[Include, ...] = ()


def to_json(q: Query | Include) -> dict[str, Any]:
    """The JSON form, without what is absent."""
    head: dict[str, Any] = {"table": q.table} if isinstance(q, Query) else {"relation": q.relation}
    if q.where is not None:
        head["where"] = q.where
    if isinstance(q, Query):
        if q.order_by:
            head["orderBy"] = [{"column": c, "direction": d} for c, d in q.order_by]
        if q.limit is not None:
            head["limit"] = q.limit
    if q.include:
        head["include"] = [to_json(i) for i in q.include]
    return head


def _include(value: str | dict[str, Any]) -> Include:
    if isinstance(value, str):
        return Include(value)
    return Include(value["relation"], value.get("where"), tuple(_include(i) for i in value.get("include", ())))


def from_json(value: dict[str, Any]) -> Query:
    order = tuple((o["column"], o.get("direction", "asc")) for o in value.get("orderBy", ()))
    return Query(value["table"], value.get("where"), order, value.get("limit"), tuple(_include(i) for i in value.get("include", ())))


class Conditions:
    """One method for each predicate node."""

    @staticmethod
    def and_(*args: Predicate) -> Predicate:
        return {"op": "and", "args": list(args)}

    @staticmethod
    def or_(*args: Predicate) -> Predicate:
        return {"op": "or", "args": list(args)}

    @staticmethod
    def not_(arg: Predicate) -> Predicate:
        return {"op": "not", "arg": arg}

    @staticmethod
    def in_(column: str, values: list[Any]) -> Predicate:
        return {"op": "in", "column": column, "values": list(values)}

    @staticmethod
    def like(column: str, pattern: str) -> Predicate:
        return {"op": "like", "column": column, "pattern": pattern}

    @staticmethod
    def is_null(column: str) -> Predicate:
        return {"op": "isNull", "column": column}

    @staticmethod
    def is_not_null(column: str) -> Predicate:
        return {"op": "isNotNull", "column": column}

    def exists(self, relation: str, where: Callable[[Conditions], Predicate] | None = None) -> Predicate:
        return {"op": "exists", "relation": relation} | ({"where": where(self)} if where else {})

    def not_exists(self, relation: str, where: Callable[[Conditions], Predicate] | None = None) -> Predicate:
        return self.not_(self.exists(relation, where))


def _comparison(op: str):
    def build(column: str, value: Any) -> Predicate:
        return {"op": op, "column": column, "value": value}

    return staticmethod(build)


for _op in ("eq", "ne", "lt", "lte", "gt", "gte"):
    setattr(Conditions, _op, _comparison(_op))

c = Conditions()


@dataclass(frozen=True)
class Builder:
    """``q("customer").where(lambda c: ...).order_by("name").limit(5).include("orders")``; each step is a new builder."""

    query: Query

    def where(self, build: Callable[[Conditions], Predicate]) -> Builder:
        return self._with(where=build(c))

    def order_by(self, column: str, direction: str = "asc") -> Builder:
        return self._with(order_by=(*self.query.order_by, (column, direction)))

    def limit(self, n: int) -> Builder:
        return self._with(limit=n)

    def include(self, relation: str, build: Callable[[IncludeBuilder], IncludeBuilder] | None = None) -> Builder:
        return self._with(include=(*self.query.include, _built(relation, build)))

    def _with(self, **changes: Any) -> Builder:
        from dataclasses import replace

        return Builder(replace(self.query, **changes))


@dataclass(frozen=True)
class IncludeBuilder:
    value: Include

    def where(self, build: Callable[[Conditions], Predicate]) -> IncludeBuilder:
        return IncludeBuilder(Include(self.value.relation, build(c), self.value.include))

    def include(self, relation: str, build: Callable[[IncludeBuilder], IncludeBuilder] | None = None) -> IncludeBuilder:
        return IncludeBuilder(Include(self.value.relation, self.value.where, (*self.value.include, _built(relation, build))))


def _built(relation: str, build: Callable[[IncludeBuilder], IncludeBuilder] | None) -> Include:
    start = IncludeBuilder(Include(relation))
    return (build(start) if build else start).value


def q(table: str) -> Builder:
    return Builder(Query(table))
