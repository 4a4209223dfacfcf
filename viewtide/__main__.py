"""Commands: look at and check schemas, run the change stream, show or move its position, and see to what was put aside.

    python -m viewtide schema introspect FOLDER          the tables of a folder of Parquet files, as a schema's JSON
    python -m viewtide schema validate SCHEMA            every problem of a schema, or its hash
    python -m viewtide run SCHEMA SOURCE STATE           routes and sequences the files of SOURCE into STATE
    python -m viewtide position show|reset STATE [TEXT]  what the stream has taken; TEXT is where it goes on instead
    python -m viewtide quarantine list STATE
    python -m viewtide quarantine drop STATE PARTITION
    python -m viewtide quarantine replay STATE PARTITION --sink MODULE:FACTORY --schema SCHEMA
"""

from __future__ import annotations

import argparse
import functools
import importlib
import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from viewtide.plans.schema import SchemaError, schema_from_json, tables_to_json
from viewtide.sources.shared import Folder
from viewtide.sources.tables import Versions, introspect, read_transactions
from viewtide.streaming.delivery import Quarantine
from viewtide.streaming.engine import PROTOCOL
from viewtide.streaming.pipeline import ChangeStream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="viewtide", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    schema = commands.add_parser("schema").add_subparsers(dest="action", required=True)
    schema.add_parser("introspect").add_argument("folder")
    schema.add_parser("validate").add_argument("schema")
    run = commands.add_parser("run")
    for name in ("schema", "source", "state"):
        run.add_argument(name)
    run.add_argument("--forever", action="store_true", help="wait for more files; without it the stream ends when it has taken all")
    run.add_argument("--from", dest="position", help="a position; what it contains is skipped")
    position = commands.add_parser("position").add_subparsers(dest="action", required=True)
    position.add_parser("show").add_argument("state")
    reset = position.add_parser("reset")
    reset.add_argument("state")
    reset.add_argument("text", nargs="?", default="")
    quarantine = commands.add_parser("quarantine").add_subparsers(dest="action", required=True)
    quarantine.add_parser("list").add_argument("state")
    for name in ("drop", "replay"):
        one = quarantine.add_parser(name)
        one.add_argument("state")
        one.add_argument("partition")
    one.add_argument("--sink", required=True)
    one.add_argument("--schema", required=True)
    return p


def _schema(path: str):
    with open(path, encoding="utf-8") as f:
        return schema_from_json(json.load(f))


def called(target: str) -> Any:
    module, _, name = target.partition(":")
    return getattr(importlib.import_module(module), name)()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "schema" and a.action == "validate":
        try:
            print(_schema(a.schema).hash)
            return 0
        except SchemaError as e:
            print("\n".join(e.problems))
            return 1
    spark = spark or SparkSession.builder.appName("viewtide").getOrCreate()
    if a.command == "schema":
        folder = Folder(spark, a.folder)
        found = [introspect(spark.read.parquet(f"{folder.path}/{n}"), n.removesuffix(".parquet"), ()) for n in folder.names() if n.endswith(".parquet")]
        print(json.dumps(tables_to_json(found), indent=1))
    elif a.command == "run":
        stream = ChangeStream(spark, _schema(a.schema), f"{a.state}/stream", a.position)
        trigger = {"processingTime": "1 second"} if a.forever else {}
        stream.start(read_transactions(spark, a.source), f"{a.state}/checkpoint", **trigger).awaitTermination()
        print(stream.position())
    elif a.command == "position":
        versions = Versions(spark, f"{a.state}/stream")
        at = versions.current()
        stored = versions.read("position", at)
        if a.action == "reset":
            kept = {n: df for n in ("sequences", "quarantined", "batch") if (df := versions.read(n, at)) is not None}
            versions.publish(at + 1, kept | {"position": spark.createDataFrame([(a.text,)], "position string")})
            print(a.text)
        else:
            print(stored.first()["position"] if stored is not None else "")
    else:
        quarantine = Quarantine(spark, f"{a.state}/aside")
        if a.action == "list":
            for r in quarantine.listed().orderBy("partition").toLocalIterator():
                print(f"{r['partition']}\t{r['reason']}\t{r['transactions']}\t{r['first_seq']}-{r['last_seq']}")
        elif a.action == "drop":
            print(quarantine.drop(a.partition))
        else:
            head = {"protocol": PROTOCOL, "schema_hash": _schema(a.schema).hash, "epoch": 0}
            print(" ".join(quarantine.replay(a.partition, functools.partial(called, a.sink), head)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
