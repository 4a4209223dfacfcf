"""Named queries: what a client may ask for, resolved with the asker's identity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from viewtide.plans.query import Builder, Query

#: The query that tells a client how far its own mutations were confirmed, and the table it reads.
CLIENT_QUERY, CLIENT_TABLE = "$client", "sync_clients"


class ResolveProblem(ValueError):
    """unknown_query, invalid_args, resolver_failed or raw_refused."""

    def __init__(self, reason: str, name: str, message: str = ""):
        super().__init__(f"{reason}: {name} {message}".strip())
        self.reason, self.name = reason, name


@dataclass(frozen=True)
class Context:
    partition: str
    subject: str
    client_id: str


@dataclass(frozen=True)
class Definition:
    """decode turns arguments as they came into what resolve takes, and raises if it can't."""

    resolve: Callable[[Context, Any], Query | Builder]
    decode: Callable[[Any], Any] = lambda args: args


def own_row(context: Context, _args: Any) -> Query:
    return Query(CLIENT_TABLE, {"op": "eq", "column": "client_id", "value": context.client_id})


BUILT_IN = {CLIENT_QUERY: Definition(own_row)}


def resolve(queries: dict[str, Definition], name: str, args: Any, context: Context) -> Query:
    definition = {**queries, **BUILT_IN}.get(name)
    if definition is None:
        raise ResolveProblem("unknown_query", name)
    try:
        decoded = definition.decode(args)
    except Exception as e:
        raise ResolveProblem("invalid_args", name, str(e)) from e
    try:
        found = definition.resolve(context, decoded)
    except Exception as e:
        raise ResolveProblem("resolver_failed", name, str(e)) from e
    return found.query if isinstance(found, Builder) else found


def ask(queries: dict[str, Definition] | None, asked: Query | tuple[str, Any], context: Context) -> Query:
    """A query by name and arguments, or as it is; the latter only where no queries are named."""
    if isinstance(asked, Query):
        if queries:
            raise ResolveProblem("raw_refused", asked.table)
        return asked
    return resolve(queries or {}, asked[0], asked[1], context)
