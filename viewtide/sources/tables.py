"""Tables as sources: declared from files, introspected, looked up by key, and rewritten in versions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.functions.kinds import kind_of_spark, stored_type
from viewtide.plans.schema import KEY, Column, Schema, Table

Tables = dict[str, DataFrame]


def read_tables(spark: SparkSession, schema: Schema, folder: str) -> Tables:
    """Every table of the schema from ``folder/NAME.parquet``, keyed; columns that aren't synced are never read."""
    return {t.name: t.keyed(spark.read.parquet(f"{folder}/{t.name}.parquet")) for t in schema.tables}


def introspect(df: DataFrame, name: str, primary_key: tuple[str, ...]) -> Table:
    """A table declaration from a DataFrame's schema."""
    return Table(name, primary_key, tuple(Column(f.name, kind_of_spark(f.dataType), f.nullable and f.name not in primary_key, source_type=f.dataType.simpleString()) for f in df.schema.fields))


def matches(table: Table, df: DataFrame) -> list[str]:
    """How a result's columns differ from the declared kinds."""
    have = dict(df.dtypes)
    out = [f"{c.name} is missing" for c in table.columns if not c.derived and c.name not in have]
    for c in table.columns:
        if c.name in have and have[c.name] != stored_type(c.kind).simpleString() and kind_of_spark(df.schema[c.name].dataType) != c.kind:
            out.append(f"{c.name} is {have[c.name]}, not {c.kind}")
    return out


def by_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with one of the keys, looked up all at once."""
    return df.join(keys.select(KEY).distinct(), KEY, "left_semi")


def by_columns(df: DataFrame, columns: tuple[str, ...], values: DataFrame) -> DataFrame:
    """Rows whose columns have the values of one of values' rows (columns by position), by key. Null is no value."""
    names = [f"__v{i}" for i in range(len(columns))]
    values = values.toDF(*names).distinct()
    return df.join(values, [df[c] == values[n] for c, n in zip(columns, names, strict=True)], "left_semi").orderBy(KEY)


def rewritten(base: DataFrame, images: DataFrame) -> DataFrame:
    """base after images (key, after): rows replaced, added, or removed where after is null."""
    kept = base.join(images.select(KEY), KEY, "left_anti")
    return kept.unionByName(images.where("after is not null").select(KEY, *(F.col(f"after.{c}").alias(c) for c in base.columns if c != KEY)))


class Versions:
    """Tables in versions under a folder, with a pointer to the current one. A version is never changed, and a batch writes its own once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.FileSystem.get(self._path("").toUri(), spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def current(self) -> int:
        """The version that was published last, -1 if none was."""
        numbers = [-1]
        if self._fs.exists(self._path("")):
            numbers += [int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(self._path("")) if s.getPath().getName().endswith(".done")]
        return max(numbers)

    def has(self, name: str, version: int) -> bool:
        return version >= 0 and self._fs.exists(self._path(f"v{version}/{name}"))

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        version = self.current() if version is None else version
        return self.spark.read.parquet(f"{self.folder}/v{version}/{name}") if self.has(name, version) else None

    def read_all(self, name: str) -> DataFrame | None:
        """A table's rows of all versions, in one scan."""
        paths = [f"{self.folder}/v{v}/{name}" for v in range(self.current() + 1) if self.has(name, v)]
        return self.spark.read.parquet(*paths) if paths else None

    def publish(self, version: int, tables: dict[str, DataFrame], partition_by: str | None = None) -> bool:
        """Writes the tables of a version, then its mark. False, and nothing written, if the version was published before."""
        if version <= self.current():
            return False
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy(partition_by) if partition_by and partition_by in df.columns else writer).parquet(f"{self.folder}/v{version}/{name}")
        self._fs.create(self._path(f"v{version}.done"), True).close()
        return True


def transaction_schema() -> str:
    """A change stream's rows: one source transaction each; images as JSON text."""
    change = "struct<table:string,op:string,key:string,before:string,after:string>"
    return f"gtid string, keyspace string, shard string, position string, commit_timestamp bigint, changes array<{change}>"


def read_transactions(spark: SparkSession, folder: str, max_files: int | None = 100) -> DataFrame:
    """A stream of JSON-lines files of transactions, some files at a time, with the file and the block that a line is read from.

    Files are taken in the order of their times of writing by Spark, and ordered by name within a batch: names should grow.
    """
    reader = spark.readStream.schema(transaction_schema())
    rows = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(folder)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block"))


def row_json(row: dict) -> str:
    return json.dumps(row, separators=(",", ":"), ensure_ascii=False)
