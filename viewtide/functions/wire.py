"""Texts that travel: raw rows, SQL literals, percent-encoded names, the time as the source writes it."""

from __future__ import annotations

import base64
import datetime
from typing import Any
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadRow(ValueError):
    """A raw row whose lengths and bytes don't belong together."""


def decode_row(lengths: list[int], values: bytes) -> list[bytes | None]:
    """The cells of a raw row: each length's bytes, one after another; -1 is a null."""
    out, at = [], 0
    for n in lengths:
        if n < -1:
            raise BadRow(f"a cell of {n} bytes")
        if n == -1:
            out.append(None)
            continue
        if at + n > len(values):
            raise BadRow("the row is cut off")
        out.append(values[at : at + n])
        at += n
    if at != len(values):
        raise BadRow("bytes after the last cell")
    return out


def row_cells(lengths: Column, values: Column) -> tuple[Column, Column]:
    """The same as columns: an array of cells (binary), and whether the row is bad; a bad row's cells are null."""
    sizes = F.transform(lengths, lambda n: F.greatest(n, F.lit(0)))
    total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    bad = F.exists(lengths, lambda n: n < -1) | (total != F.octet_length(values))
    cells = F.transform(lengths, lambda n, i: F.when(n >= 0, F.substr(values, F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(1), lambda a, m: a + m), n)))
    return F.when(~bad, cells), bad


def sql_literal(kind: str, value: Any) -> str:
    """A value as a literal of the source's SQL."""
    if value is None:
        return "NULL"
    if kind == "bool":
        return "1" if value else "0"
    if kind in ("int", "bigint", "float"):
        return str(int(value)) if kind != "float" else repr(float(value))
    if kind == "bytes":
        return f"X'{base64.b64decode(value).hex()}'"
    text = str(value)
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\0", "\\0"), ("\n", "\\n"), ("\r", "\\r"), ("\x1a", "\\Z")):
        text = text.replace(plain, escaped)
    return f"'{text}'"


def percent_encoded(text: str) -> str:
    """For a path: everything but letters, digits and ``-_.~``."""
    return quote(text, safe="")


def now_text(now: datetime.datetime | None = None) -> str:
    """The time as a datetime cell, in UTC with milliseconds."""
    now = now or datetime.datetime.now(datetime.UTC)
    return now.strftime("%Y-%m-%d %H:%M:%S.") + f"{now.microsecond // 1000:03d}"


def granted(grants: list[dict[str, Any]], partition: str, now: float) -> bool:
    """Whether a token's grants (partitions, or ``*``, with an expiry in seconds) hold for a partition."""
    return any(g["expires"] > now and ("*" in g["partitions"] or partition in g["partitions"]) for g in grants)
