"""Small sets on the driver: keys and rows that a batch of changes touches, as plans that hold them themselves.

What a batch touches is few rows beside a table. Such a set is collected once, if it is counted to have no more than ``SMALL``
rows, and goes on as a local relation: Spark knows its size, joins it by broadcast, and runs no job to read it. A larger one is
cut in the shared folder and stays distributed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.plans.schema import KEY
from viewtide.sources.shared import cut

#: Rows that the driver holds of one set, at most.
SMALL = 10_000
#: Keys that are looked up by a filter; ``push_filters`` lets files see as many.
FILTER = 1_000
#: A filter of values: values to a block of 64 bits, bits set for each value, blocks at most (some 40 bytes each where they are broadcast).
BLOCK_VALUES, SET_BITS, BLOCKS = 8, 3, 1 << 19
KEYS = T.StructType([T.StructField(KEY, T.StringType())])


def push_filters(spark: SparkSession) -> None:
    """Lets Parquet files see every value of a filter of FILTER values, and not only their range."""
    name = "spark.sql.parquet.pushdown.inFilterThreshold"
    if int(spark.conf.get(name)) < FILTER:
        spark.conf.set(name, str(FILTER))


def local(spark: SparkSession, schema: T.StructType, rows: list[tuple]) -> DataFrame:
    """rows as a relation that the plan itself holds."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields))


def settled(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df run once: as a local relation if it is small, else from the shared folder."""
    found = df.limit(rows + 1).toArrow()
    return df.sparkSession.createDataFrame(found) if found.num_rows <= rows else cut(df)


@dataclass(frozen=True)
class KeySet:
    """Keys, each once: small sets as Python's, larger ones as a DataFrame of one column."""

    spark: SparkSession
    small: frozenset[str] | None
    large: DataFrame | None = None

    @staticmethod
    def of(df: DataFrame) -> KeySet:
        """The keys of df's rows, which run once."""
        keys = df.select(KEY).distinct()
        found = keys.limit(SMALL + 1).toArrow().column(0).to_pylist()
        if len(found) <= SMALL:
            return KeySet(df.sparkSession, frozenset(found))
        return KeySet(df.sparkSession, None, cut(keys))

    @staticmethod
    def none(spark: SparkSession) -> KeySet:
        return KeySet(spark, frozenset())

    @property
    def empty(self) -> bool:
        return self.small is not None and not self.small

    def df(self) -> DataFrame:
        return self.large if self.small is None else local(self.spark, KEYS, [(k,) for k in sorted(self.small)])

    def __or__(self, other: KeySet) -> KeySet:
        if self.small is not None and other.small is not None:
            both = self.small | other.small
            return KeySet(self.spark, both) if len(both) <= SMALL else KeySet(self.spark, None, local(self.spark, KEYS, [(k,) for k in sorted(both)]))
        return self if other.empty else other if self.empty else KeySet.of(self.df().union(other.df()))

    def __sub__(self, other: KeySet) -> KeySet:
        if self.small is not None and other.small is not None:
            return KeySet(self.spark, self.small - other.small)
        return self if other.empty or self.empty else KeySet.of(self.df().join(other.df(), KEY, "left_anti"))

    def __and__(self, other: KeySet) -> KeySet:
        if self.small is not None and other.small is not None:
            return KeySet(self.spark, self.small & other.small)
        return KeySet.none(self.spark) if other.empty or self.empty else KeySet.of(self.df().join(other.df(), KEY, "left_semi"))

    def within(self, df: DataFrame) -> DataFrame:
        """df's rows with one of the keys."""
        if self.small is not None and len(self.small) <= FILTER:
            # So few are a filter, which reaches the files.
            return df.where(F.col(KEY).isin(*sorted(self.small))) if self.small else df.limit(0)
        return df.join(self.df(), KEY, "left_semi")


def union(spark: SparkSession, sets: list[KeySet]) -> KeySet:
    return reduce(KeySet.__or__, sets, KeySet.none(spark))


def _places(columns: list[Column], blocks: int) -> tuple[Column, Column]:
    """The block of a row's values in a filter, and their bits there."""
    bits, one = F.xxhash64(*columns, F.lit("bits")), F.lit(1).cast("long")
    places = [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int") for i in range(SET_BITS)]
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)), reduce(Column.bitwiseOR, (F.call_function("shiftleft", one, p) for p in places))


def having(rows: DataFrame, columns: tuple[str, ...], values: DataFrame) -> DataFrame:
    """The rows whose columns have the values of one of values' rows (columns by position). values are run more than once: they should be cut.

    Few values are broadcast. Of many, a Bloom filter in blocks is, of a bounded number, so that rows without a match, but few,
    are dropped where they are read; a join by shuffle decides about the others.
    """
    names = [f"__f{i}" for i in range(len(columns))]
    values = values.toDF(*names)
    on = lambda: [rows[c] == values[n] for c, n in zip(columns, names, strict=True)]
    few = values.distinct()
    if few.limit(SMALL + 1).count() <= SMALL:
        values = F.broadcast(few)
        return rows.join(values, on(), "left_semi")
    if all(rows.schema[c].dataType == values.schema[n].dataType for c, n in zip(columns, names, strict=True)):
        blocks = max(1, min(BLOCKS, values.count() // BLOCK_VALUES))
        block, bits = _places([F.col(n) for n in names], blocks)
        filled = values.select(block.alias("__block"), bits.alias("__bits")).groupBy("__block").agg(F.bit_or("__bits").alias("__bits"))
        block, bits = _places([rows[c] for c in columns], blocks)
        rows = rows.join(F.broadcast(filled), (block == filled["__block"]) & (filled["__bits"].bitwiseAND(bits) == bits), "left_semi")
    return rows.join(values, on(), "left_semi")
