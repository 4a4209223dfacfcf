"""Column kinds: the closed list of what a synced cell can be, and how each is stored, compared, ordered and decoded."""

from __future__ import annotations

import math
import re
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("bool", "int", "bigint", "float", "decimal", "string", "bytes", "json", "datetime", "date", "time")
#: Kinds without an entry are kept as text.
STORED = {"bool": T.BooleanType(), "int": T.LongType(), "bigint": T.LongType(), "float": T.DoubleType()}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EQUAL, RANGE, NULL = {"eq", "ne", "in"}, {"lt", "lte", "gt", "gte"}, {"isNull", "isNotNull"}
BIGINT = re.compile(r"-?\d+", re.ASCII)
#: The largest integer that a double holds exactly.
SAFE = 2**53 - 1


def stored_type(kind: str) -> T.DataType:
    return STORED.get(kind, T.StringType())


def orderable(kind: str) -> bool:
    """Whether the kind's stored values have an order that means something."""
    return kind not in ("json", "bytes", "decimal")


def operations(kind: str) -> set[str]:
    """Comparisons that a predicate may use on the kind. JSON is searched as text and not compared."""
    allowed = set(NULL)
    if kind != "json":
        allowed |= EQUAL
    if orderable(kind):
        allowed |= RANGE
    if kind in ("string", "json"):
        allowed.add("like")
    return allowed


def literal_fits(kind: str, value: Any) -> bool:
    """Whether value is a literal of the kind. A whole float is an int; a bool never is a number."""
    if kind == "bool":
        return isinstance(value, bool)
    number = isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)
    if kind == "int":
        return number and float(value).is_integer()
    if kind == "float":
        return number
    if kind == "bigint":
        return isinstance(value, str) and BIGINT.fullmatch(value) is not None
    return isinstance(value, str) and kind != "json"


def storable(kind: str, value: Any) -> bool:
    """Whether a literal that fits can be stored: a bigint has to be a signed 64-bit integer."""
    return kind != "bigint" or value is None or -(2**63) <= int(value) < 2**63


def literal(kind: str, value: Any, stored: T.DataType | None = None) -> Column:
    """The value as a column of the kind's stored type, or of the type that a native table stores the column as."""
    if kind == "int":
        value = int(value)
    elif kind == "bigint":
        value = int(value)
    elif kind == "float":
        value = float(value)
    return F.lit(value).cast(stored or stored_type(kind))


def fold(c: Column) -> Column:
    """ASCII letters in lower case; all other characters as they are."""
    return F.translate(c, UPPER, LOWER)


def like(c: Column, pattern: str) -> Column:
    """``%`` and ``_`` only; ASCII letters match in either case; a backslash is itself."""
    folded = pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return fold(c.cast("string")).like(folded)


def sort_keys(c: Column, kind: str, direction: str) -> list[Column]:
    """How a column is ordered: strings by their folded text, then as they are; nulls first ascending and last descending."""
    keys = [fold(c), c] if kind == "string" else [c]
    return [k.asc_nulls_first() if direction == "asc" else k.desc_nulls_last() for k in keys]


def cell_text(c: Column, kind: str) -> Column:
    """A cell as JSON: numbers and booleans bare, all else as strings, bigints included."""
    if kind in ("bool", "int", "float"):
        return F.coalesce(c.cast("string"), F.lit("null"))
    text = F.to_json(F.array(c.cast("string")))
    return F.coalesce(text.substr(F.lit(2), F.length(text) - 2), F.lit("null"))


def key_text(columns: list[tuple[Column, str]]) -> Column:
    """A row's key: its primary key's cells as a JSON array."""
    return F.concat(F.lit("["), F.concat_ws(",", *(cell_text(c, k) for c, k in columns)), F.lit("]"))


#: The kind of each source type; all others are strings.
SOURCE_KINDS = {
    "tinyint": "int", "smallint": "int", "mediumint": "int", "int": "int", "integer": "int", "year": "int", "bigint": "bigint", "bit": "bigint",
    "float": "float", "double": "float", "real": "float", "decimal": "decimal", "numeric": "decimal", "json": "json", "datetime": "datetime", "timestamp": "datetime",
    "date": "date", "time": "time", "binary": "bytes", "varbinary": "bytes", "tinyblob": "bytes", "blob": "bytes", "mediumblob": "bytes", "longblob": "bytes", "geometry": "bytes", "vector": "bytes",
}


def kind_of_source(source_type: str) -> str:
    """The kind of a source column from its declared type, as ``bigint unsigned`` or ``decimal(10,2)``."""
    text = source_type.strip().lower()
    if re.match(r"tinyint\(1\)", text):
        return "bool"
    return SOURCE_KINDS.get(re.split(r"[ (]", text, maxsplit=1)[0], "string")


def kind_of_spark(kind: T.DataType) -> str:
    """The kind that a native table's column takes."""
    for types, name in (
        (T.BooleanType, "bool"), ((T.ByteType, T.ShortType, T.IntegerType), "int"), (T.LongType, "bigint"), ((T.FloatType, T.DoubleType), "float"), (T.DecimalType, "decimal"),
        (T.BinaryType, "bytes"), ((T.TimestampType, T.TimestampNTZType), "datetime"), (T.DateType, "date"),
    ):
        if isinstance(kind, types):
            return name
    return "json" if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else "string"


def enum_values(source_type: str) -> list[str]:
    """The members of ``enum('a','it''s')`` or ``set(...)``."""
    inner = re.fullmatch(r"\s*(?:enum|set)\s*\((.*)\)\s*", source_type, re.IGNORECASE | re.DOTALL)
    if not inner:
        raise ValueError(f"not an enum or set: {source_type}")
    return [m[1].replace("''", "'").replace("\\'", "'").replace("\\\\", "\\") for m in re.finditer(r"'((?:[^'\\]|''|\\.)*)'", inner[1])]


def decode_enum(text: Column, values: list[str]) -> tuple[Column, Column]:
    """(value, whether the ordinal is bad). Ordinal 0 is the source's invalid value, an empty string."""
    n = text.try_cast("bigint")
    found = F.when(n == 0, F.lit("")).otherwise(F.get(F.array(*map(F.lit, values)), (n - 1).cast("int")))
    return found, text.isNotNull() & (n.isNull() | (n < 0) | (n > len(values)))


def decode_set(text: Column, values: list[str]) -> tuple[Column, Column]:
    """(members joined by commas, whether the bitmask is bad). A mask is unsigned, of up to 64 bits."""
    mask = F.when(text.rlike(r"^\s*[0-9]+\s*$"), text.try_cast("decimal(20,0)"))
    n = F.when(mask >= F.lit(Decimal(2**63)), mask - F.lit(Decimal(2**64))).otherwise(mask).cast("decimal(20,0)").cast("bigint")
    members = [F.when(F.shiftrightunsigned(n, i).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(v)) for i, v in enumerate(values)]
    bad = text.isNotNull() & F.coalesce(mask >= F.lit(Decimal(2 ** len(values))), F.lit(True))
    found = F.when(~bad & mask.isNotNull(), F.array_join(F.filter(F.array(*members), lambda x: x.isNotNull()), ","))
    return found, bad


def decode_cell(text: Column, kind: str) -> tuple[Column, Column]:
    """A source's text cell as a stored value, and whether it can't be one. Bytes arrive in base64."""
    if kind == "bool":
        n = text.try_cast("bigint")
        return n != 0, text.isNotNull() & n.isNull()
    if kind == "int":
        n = text.try_cast("bigint")
        return n, text.isNotNull() & (n.isNull() | (F.abs(n) > SAFE))
    if kind == "bigint":
        n = text.try_cast("bigint")
        return n, text.isNotNull() & n.isNull()
    if kind == "float":
        n = text.try_cast("double")
        return n, text.isNotNull() & (n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")))
    if kind == "json":
        return text, text.isNotNull() & F.try_parse_json(text).isNull()
    return text, F.lit(False)
