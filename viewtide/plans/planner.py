"""Checks a query against a schema and resolves it: relations, a total order, levels, dependencies, a canonical key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from viewtide.functions.kinds import literal_fits, operations, orderable
from viewtide.plans.query import Include, Predicate, Query, to_json
from viewtide.plans.schema import Relation, Schema, Table, canonical_json

#: The limits of a query.
MAX_LIMIT, MAX_IN_VALUES, MAX_NODES, MAX_DEPTH, MAX_PARAMS = 10_000, 40, 60, 3, 80


class QueryProblem(ValueError):
    """Why a query can't be planned: a reason and its details."""

    def __init__(self, reason: str, **details: Any):
        super().__init__(f"{reason}: {details}")
        self.reason, self.details = reason, details


@dataclass(frozen=True)
class Level:
    """An include: rows of target that rows of the level above (path without its last part) refer to."""

    relation: Relation
    target: Table
    where: Predicate | None
    path: tuple[str, ...]

    @property
    def above(self) -> tuple[str, ...]:
        return self.path[:-1]


@dataclass(frozen=True)
class Planned:
    query: Query
    table: Table
    order_by: tuple[tuple[str, str], ...]
    levels: tuple[Level, ...]
    tables: frozenset[str]
    key: str
    schema: Schema = field(compare=False, repr=False)

    @property
    def limit(self) -> int | None:
        return self.query.limit


#: What an inner node holds: how to get its arguments, of the same table.
ARGUMENTS = {"and": lambda p: p["args"], "or": lambda p: p["args"], "not": lambda p: [p["arg"]]}


def _literals(p: Predicate) -> list[Any]:
    return list(p["values"]) if p["op"] == "in" else [p["value"]] if "value" in p else []


def _misfits(table: Table, p: Predicate) -> Iterator[tuple[str, dict[str, Any]]]:
    """What is wrong with a comparison, in the order in which it is told."""
    column, values = table.column(p["column"]), _literals(p)
    if column is None:
        yield "unknown_column", {"table": table.name, "column": p["column"]}
        return
    about = {"column": column.name, "kind": column.kind}
    if p["op"] not in operations(column.kind):
        yield "not_comparable", about | {"op": p["op"]}
    if p["op"] == "in" and not values:
        yield "empty_in", {"column": column.name}
    if len(values) > MAX_IN_VALUES:
        yield "too_many_values", {"column": column.name, "count": len(values)}
    yield from (("type_mismatch", about | {"value": v}) for v in values if not literal_fits(column.kind, v))


class _Check:
    """Checks predicates and includes; the numbers of nodes and parameters count over the whole query."""

    def __init__(self, schema: Schema):
        self.schema, self.nodes, self.params, self.used = schema, 0, 0, set()

    def relation(self, table: Table, name: str) -> tuple[Relation, Table]:
        r = table.relation(name)
        if r is None:
            raise QueryProblem("unknown_relation", table=table.name, relation=name)
        return r, self.schema.table(r.target)

    def predicate(self, table: Table, where: Predicate, depth: int) -> None:
        """Every node, a node before its arguments and these in their order."""
        waiting = [(table, where, depth)]
        while waiting:
            at, p, deep = waiting.pop()
            self.nodes += 1
            if self.nodes > MAX_NODES:
                raise QueryProblem("predicate_too_large", nodes=self.nodes)
            if p["op"] in ARGUMENTS:
                waiting += [(at, arg, deep) for arg in reversed(ARGUMENTS[p["op"]](p))]
            elif p["op"] == "exists":
                if deep >= MAX_DEPTH:
                    raise QueryProblem("too_deep", depth=deep + 1)
                _, target = self.relation(at, p["relation"])
                self.used.add(target.name)
                waiting += [(target, p["where"], deep + 1)] if p.get("where") is not None else []
            else:
                for reason, details in _misfits(at, p):
                    raise QueryProblem(reason, **details)
                self.params += len(_literals(p)) + (p["op"] == "like")
                if self.params > MAX_PARAMS:
                    raise QueryProblem("too_many_parameters", params=self.params)

    def levels(self, table: Table, includes: tuple[Include, ...], path: tuple[str, ...]) -> tuple[list[Level], list[Include]]:
        """Levels, each before those below it, and the includes in normal form: by name, the last of equal ones."""
        depth = len(path) + 1
        if includes and depth > MAX_DEPTH:
            raise QueryProblem("too_deep", depth=depth)
        found, normal = [], []
        for name, i in sorted({i.relation: i for i in includes}.items()):
            r, target = self.relation(table, name)
            if i.where is not None:
                self.predicate(target, i.where, depth)
            self.used.add(target.name)
            below, inner = self.levels(target, i.include, (*path, name))
            found += [Level(r, target, i.where, (*path, name)), *below]
            normal.append(Include(name, i.where, tuple(inner)))
        return found, normal


def plan_query(schema: Schema, query: Query) -> Planned:
    """The planned query, or the first QueryProblem."""
    table = schema.table(query.table)
    if table is None:
        raise QueryProblem("unknown_table", table=query.table)
    check = _Check(schema)
    if query.where is not None:
        check.predicate(table, query.where, 0)
    for name, _ in query.order_by:
        column = table.column(name)
        if column is None:
            raise QueryProblem("unknown_column", table=table.name, column=name)
        if not orderable(column.kind):
            raise QueryProblem("not_orderable", column=name, kind=column.kind)
    named = {n for n, _ in query.order_by}
    order = (*query.order_by, *((k, "asc") for k in table.primary_key if k not in named))
    if query.limit is not None and not (isinstance(query.limit, int) and query.limit >= 1):
        raise QueryProblem("invalid_limit", limit=query.limit)
    if query.limit is not None and query.limit > MAX_LIMIT:
        raise QueryProblem("limit_too_large", limit=query.limit)
    levels, normal = check.levels(table, query.include, ())
    normalized = Query(table.name, query.where, order, query.limit, tuple(normal))
    return Planned(normalized, table, order, tuple(levels), frozenset({table.name, *check.used}), canonical_json(to_json(normalized)), schema)


def chains(schema: Schema, table: Table, where: Predicate | None) -> list[tuple[Relation, ...]]:
    """The ways from table that exists predicates walk, one for each such node; a nested one goes on from its outer one."""
    out: list[tuple[Relation, ...]] = []

    def walk(at: Table, p: Predicate | None, way: tuple[Relation, ...]) -> None:
        if p is None:
            return
        if p["op"] == "exists":
            r = at.relation(p["relation"])
            out.append((*way, r))
            walk(schema.table(r.target), p.get("where"), (*way, r))
        for arg in [*p.get("args", ()), *([p["arg"]] if "arg" in p else [])]:
            walk(at, arg, way)

    walk(table, where, ())
    return out
