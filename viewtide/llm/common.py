"""What the corpus operators share: the shared folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.sources.shared import cut, shared_folder

__all__ = ["around_extras", "cut", "kept", "open_fs", "rarely_collect", "rows_of", "shared_folder", "small_or_plain", "text_batches", "text_or_empty", "tokenizer_file", "written"]

#: A side is broadcast only after it was counted and found to have no more rows than this.
BROADCAST_ROWS = 100_000
#: Rows in an Arrow batch that carries whole texts.
TEXT_BATCH_ROWS = 500


def open_fs(uri: str):
    """pyarrow's file system for a URI of the shared folder, and the path within it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def written(df: DataFrame, name: str) -> DataFrame:
    """df's rows as a table in the shared folder, which is read back: for many rows, where a checkpoint makes many objects."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it was counted to have few rows; beyond that Spark picks a shuffle join. df should be cheap to count (cut)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, for the session, as batches are cut when a plan runs; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_BATCH_ROWS:
        spark.conf.set(name, str(TEXT_BATCH_ROWS))


_kept: dict[tuple, Any] = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What make makes, kept in this worker for the stage's next batches. A worker serves many stages, so what another one kept goes."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            # What was freed goes back to the system, where its allocator can do that.
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
        _kept[key] = make()
    return _kept[key]


def rarely_collect() -> None:
    """For workers that make many short-lived lists and no cycles: the collector looks at its young objects less often."""
    gc.set_threshold(200_000, 50, 100)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def around_extras(docs: DataFrame, needed: set[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run over docs, whose columns but the needed ones have names that clash with none; run keeps the columns' order, and they get their names back."""
    names = docs.columns
    return run(docs.toDF(*(n if n in needed else f"extra_{i}_" for i, n in enumerate(names)))).toDF(*names)


def rows_of(batch, *names: str) -> Iterator[tuple]:
    """The rows of an Arrow batch as Python values."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def tokenizer_file(name: str) -> str:
    """A public vocabulary's path on this machine; every worker resolves its own."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
