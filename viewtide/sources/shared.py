"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it, as a URI. Only where none is set and all of Spark is one process, as in tests, an own folder."""
    context = spark.sparkContext._jsc.sc()
    root = spark.conf.get("spark.checkpoint.dir", None) or (context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="viewtide-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Runs df once and goes on from its rows in the shared folder.

    A checkpoint hands on what holds of its rows (constraints). Where a plan has the same checkpoint twice, Spark 4.1 names one's
    columns anew but not always in its constraints, and a union of the two fails. So they are left out; sizes are kept.
    """
    shared_root(df.sparkSession)
    jdf = df.checkpoint(eager=True)._jdf
    session, rows, jvm = jdf.sparkSession(), jdf.queryExecution().analyzed(), df.sparkSession.sparkContext._jvm
    size, nothing = jvm.scala.Some(rows.computeStats()), jvm.scala.Option.empty()
    plain = rows.copy(rows.output(), rows.rdd(), rows.outputPartitioning(), rows.outputOrdering(), rows.isStreaming(), rows.stream(), session, size, nothing)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plain), df.sparkSession)


class Folder:
    """Small files of text below a folder that driver and executors share; a file appears whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.FileSystem.get(self._at("").toUri(), spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self._fs.exists(self._at("")) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(f"_{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.rename(self._at(f"_{name}"), self._at(name))
