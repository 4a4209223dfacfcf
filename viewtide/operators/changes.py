"""The change stream: assembling transactions, decoding rows, routing to partitions, sequencing, deduplication, replay.

Images travel as JSON text until they are routed, since tables differ in their columns. All operators take and give
DataFrames with a row for each change and ``stream_index``, the transaction's place in its stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from viewtide.functions.gtid import GtidSet, step
from viewtide.functions.kinds import cell_text, decode_cell, decode_enum, decode_set, enum_values, stored_type
from viewtide.plans.schema import KEY, Parent, Schema, Table


#: Transactions that are ranked together.
STRETCH = 100_000


class StreamError(ValueError):
    """Events that make no transaction."""


class Assembler:
    """Turns a shard's events into transactions, and checks that each commit adds one transaction id to the position.

    Events are dicts with ``type`` (begin, field, row, vgtid, commit, rollback, ddl, heartbeat, other). policy: ``strict``,
    ``merged`` (a step may add several ids) or ``lenient`` (nothing is checked, as while tables are copied).
    """

    def __init__(self, schema: Schema, policy: str = "strict", position: str | None = None):
        self.schema, self.policy = schema, policy
        self.position = GtidSet.parse(position) if position is not None else None
        self.open: dict | None = None
        self.columns: dict[str, list[str]] = {}

    def push(self, event: dict) -> list[dict]:
        """What the event completes: transactions, new positions, heartbeats."""
        handler = getattr(self, f"_{event['type']}", None)
        if handler is None:
            if event["type"] == "other":
                return []
            raise StreamError(f"unsupported event {event['type']}")
        return handler(event) or []

    def _begin(self, event: dict) -> None:
        if self.open is not None and not (self.policy == "lenient" and not self.open["changes"]):
            raise StreamError("a transaction begins within another")
        self.open = {"changes": [], "position": None, "commit_timestamp": event.get("timestamp")}

    def _field(self, event: dict) -> None:
        table = self.schema.table(event["table"])
        if table is not None:
            missing = [c.name for c in table.columns if not c.derived and c.name not in event["columns"]]
            if missing:
                raise StreamError(f"{table.name} lost its column {missing[0]}")
            self.columns[table.name] = event["columns"]

    def _row(self, event: dict) -> None:
        if self.schema.table(event["table"]) is None:
            return
        if self.open is None:
            raise StreamError(f"a row of {event['table']} outside a transaction")
        if event["table"] not in self.columns:
            raise StreamError(f"a row of {event['table']} before its columns")
        before, after = event.get("before"), event.get("after")
        if before is None and after is None:
            raise StreamError("a change without images")
        table = self.schema.table(event["table"])
        keyed = after if after is not None else before
        op = "insert" if before is None else "delete" if after is None else "update"
        self.open["changes"].append({"table": table.name, "op": op, "key": [keyed[k] for k in table.primary_key], "before": before, "after": after})

    def _vgtid(self, event: dict) -> list[dict] | None:
        if self.open is not None:
            self.open["position"] = event["position"]
            return None
        self.position = GtidSet.parse(event["position"])
        return [{"item": "position", "position": event["position"]}]

    def _commit(self, _event: dict) -> list[dict]:
        done, self.open = self.open, None
        if done is None:
            raise StreamError("a commit without a transaction")
        if done["position"] is None:
            raise StreamError("a commit without a position")
        after = GtidSet.parse(done["position"])
        if self.policy == "lenient":
            gtid = str(after.difference(self.position)) if self.position is not None else ""
        elif self.position is None:
            raise StreamError("a transaction before any position was known")
        else:
            gtid = step(self.position, after, self.policy == "merged")
        self.position = after
        return [{"item": "transaction", "gtid": gtid, **done}]

    def _rollback(self, _event: dict) -> None:
        self.open = None

    def _ddl(self, _event: dict) -> None:
        # Columns come anew before the next row.
        self.columns.clear()

    def _heartbeat(self, _event: dict) -> list[dict]:
        return [{"item": "heartbeat"}]


def assemble(events: DataFrame) -> DataFrame:
    """events (shard, ord, type, tbl, before, after, position, timestamp) -> shard, stream_index, position, commit_timestamp, changes.

    The same as a plan: a transaction's number is how many have begun in its shard, events outside and rolled back ones drop out.
    Begins are counted within stretches of STRETCH places, and the stretches' counts are summed before, so no shard is put in
    order in one task.
    """
    begins = F.sum((F.col("type") == "begin").cast("long"))
    placed = events.withColumn("stretch", F.floor(F.col("ord") / STRETCH))
    earlier = F.sum("begins").over(Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("shard", "stretch").agg(begins.alias("begins")).select("shard", "stretch", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    here = begins.over(Window.partitionBy("shard", "stretch").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    numbered = placed.withColumn("here", here).join(counts, ["shard", "stretch"]).withColumn("stream_index", F.col("here") + F.col("earlier")).where("stream_index > 0")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    change = F.when(F.col("type") == "row", F.struct("ord", F.col("tbl").alias("table"), op.alias("op"), "before", "after"))
    grouped = numbered.groupBy("shard", "stream_index").agg(
        F.max_by("position", F.when(F.col("type") == "vgtid", F.col("ord"))).alias("position"),
        F.max(F.when(F.col("type") == "begin", F.col("timestamp"))).alias("commit_timestamp"),
        F.sort_array(F.collect_list(change)).alias("changes"),
        F.bool_or(F.col("type") == "commit").alias("committed"),
    )
    return grouped.where("committed").drop("committed")


def normalize(rows: DataFrame, table: Table) -> DataFrame:
    """Source cells (text, a column each) -> stored values, and ``bad``: the columns that couldn't be decoded. Derived columns are computed."""
    values, bad = [], []
    for c in (c for c in table.columns if not c.derived):
        source = (c.source_type or "").strip().lower()
        if source.startswith("enum"):
            value, wrong = decode_enum(F.col(c.name), enum_values(c.source_type))
        elif source.startswith("set"):
            value, wrong = decode_set(F.col(c.name), enum_values(c.source_type))
        else:
            value, wrong = decode_cell(F.col(c.name), c.kind)
        if not c.nullable:
            wrong = wrong | F.col(c.name).isNull()
        values.append(value.alias(c.name))
        bad.append(F.when(wrong, F.lit(c.name)))
    decoded = rows.select(*values, F.filter(F.array(*bad), lambda x: x.isNotNull()).alias("bad"))
    for c in (c for c in table.columns if c.derived):
        decoded = decoded.withColumn(c.name, c.derived.column(F.col(c.derived.source)))
    return decoded


def image(text: Column, table: Table, stored: dict[str, T.DataType] | None = None) -> Column:
    """A JSON image as a struct of stored values, of the types that a stored table has; null for null."""
    cells = []
    for c in table.columns:
        kind = stored_type(c.kind) if stored is None else stored[c.name]
        if c.derived:
            # Nullable as stored columns are, though it is never null in a row.
            cells.append(F.when(text.isNotNull(), c.derived.column(F.get_json_object(text, f"$.{c.derived.source}"))).alias(c.name))
        else:
            cells.append(F.get_json_object(text, f"$.{c.name}").try_cast(kind).alias(c.name))
    return F.when(text.isNotNull(), F.struct(*cells))


def unfit(text: Column, table: Table, stored: dict[str, T.DataType] | None = None) -> Column:
    """The columns of a JSON image whose value can't be stored: text that isn't of the kind, or null where a value is needed."""
    bad = []
    for c in (c for c in table.columns if not c.derived):
        cell = F.get_json_object(text, f"$.{c.name}")
        kind = stored_type(c.kind) if stored is None else stored[c.name]
        wrong = cell.isNotNull() & cell.try_cast(kind).isNull()
        bad.append(F.when(wrong if c.nullable else wrong | cell.isNull(), F.lit(c.name)))
    return F.when(text.isNotNull(), F.filter(F.array(*bad), lambda x: x.isNotNull()))


def stored_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def key_of(text: Column, table: Table) -> Column:
    """The key's text of a JSON image."""
    cells = [cell_text(F.get_json_object(text, f"$.{k}"), table.column(k).kind) for k in table.primary_key]
    return F.when(text.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")))


def exploded(transactions: DataFrame) -> DataFrame:
    """A row for each change, with its place in the transaction."""
    return transactions.select("stream_index", "gtid", F.posexplode("changes").alias("ord", "c")).select("stream_index", "gtid", "ord", F.col("c.table").alias("tbl"), "c.op", "c.before", "c.after")


def synced(changes: DataFrame, schema: Schema) -> DataFrame:
    """Changes of the schema's tables; a source may send others."""
    return changes.where(F.col("tbl").isin(*(t.name for t in schema.tables)))


def observed(routed: DataFrame, name: str) -> DataFrame:
    """routed, reporting its counts to query listeners as metrics of this name while it runs."""
    return routed.observe(
        name,
        F.count(F.when(F.col("partition").isNotNull(), 1)).alias("routed"),
        F.count(F.when((F.col("outcome") == "moved") & (F.col("turn") == 0), 1)).alias("moves"),
        F.count(F.when(F.col("outcome") == "unpartitioned", 1)).alias("unpartitioned"),
        F.count(F.when(F.col("outcome") == "unresolved", 1)).alias("unresolved"),
    )


def _by_table(schema: Schema, tbl: Column, value) -> Column:
    out = F.lit(None).cast("string")
    for t in schema.tables:
        if (v := value(t)) is not None:
            out = F.when(tbl == t.name, v).otherwise(out)
    return out


def parent_updates(changes: DataFrame, schema: Schema) -> DataFrame:
    """stream_index, ord, tbl, parent_key, partition: what the changes say about rows that others take their partition from."""
    parents = {t.partition.table for t in schema.tables if isinstance(t.partition, Parent)}
    known = [t for t in schema.tables if t.name in parents]
    partition = _by_table(schema, F.col("tbl"), lambda t: F.get_json_object("after", f"$.{t.partition}") if t in known else None)
    key = _by_table(schema, F.col("tbl"), lambda t: F.get_json_object("after", f"$.{t.primary_key[0]}") if t in known else None)
    return changes.where(F.col("after").isNotNull()).select("stream_index", "ord", "tbl", key.alias("parent_key"), partition.alias("partition")).where("parent_key is not null and partition is not null")


def asked_parents(changes: DataFrame, schema: Schema) -> DataFrame:
    """tbl, parent_key of the parents that the changes' rows take their partition from."""
    children = [t for t in schema.tables if isinstance(t.partition, Parent)]
    parent = _by_table(schema, F.col("tbl"), lambda t: F.lit(t.partition.table) if t in children else None)
    key = lambda side: _by_table(schema, F.col("tbl"), lambda t: F.get_json_object(side, f"$.{t.partition.column}") if t in children else None)
    both = changes.select(parent.alias("tbl"), F.explode(F.array(key("before"), key("after"))).alias("parent_key"))
    return both.where("tbl is not null and parent_key is not null").distinct()


def latest_parents(updates: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The parent index (tbl, parent_key, partition) after the updates. Entries are never removed."""
    if index is not None:
        updates = updates.unionByName(index.select(F.lit(-1).cast("long").alias("stream_index"), F.lit(0).alias("ord"), "tbl", "parent_key", "partition"))
    return updates.groupBy("tbl", "parent_key").agg(F.max_by("partition", F.struct("stream_index", "ord")).alias("partition"))


def parent_periods(updates: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """tbl, known_key, found (partition), since, until (stream indexes, the latter exclusive): where parents were when."""
    if index is not None:
        updates = updates.unionByName(index.select(F.lit(-1).cast("long").alias("stream_index"), F.lit(0).alias("ord"), "tbl", "parent_key", "partition"))
    last = updates.groupBy("tbl", "parent_key", "stream_index").agg(F.max_by("partition", "ord").alias("found"))
    until = F.lead("stream_index").over(Window.partitionBy("tbl", "parent_key").orderBy("stream_index"))
    return last.select("tbl", F.col("parent_key").alias("known_key"), "found", F.col("stream_index").alias("since"), F.coalesce(until, F.lit(2**62)).alias("until"))


def route(changes: DataFrame, schema: Schema, index: DataFrame | None = None) -> DataFrame:
    """changes (exploded) -> stream_index, gtid, partition, ord, tbl, op, key, before, after, outcome.

    An insert goes where its row is, a delete where it was; an update that changes the partition is a move: a delete in the
    old one and an insert in the new one. A row without a partition is dropped (outcome ``unpartitioned``), one whose parent
    isn't known too (``unresolved``); both stay in the result with a null partition, to be counted. Parents are looked up as
    of the change's transaction, its own updates included: a parent's updates make periods, and a child joins the period that
    its transaction lies in. Only updates are put in order, so a parent of very many children is a skewed join key, no more.
    """
    children = [t for t in schema.tables if isinstance(t.partition, Parent)]
    own = lambda side: _by_table(schema, F.col("tbl"), lambda t: F.get_json_object(side, f"$.{t.partition}") if isinstance(t.partition, str) else None)
    is_child = F.col("tbl").isin(*(t.name for t in children)) if children else F.lit(False)
    # Rows with a partition column of their own say where they go; only children are joined, and of these the keys of their parents.
    placed = changes.where(~is_child).select("*", own("before").alias("was"), own("after").alias("now"), F.lit(False).alias("lost"))
    if children:
        mine = changes.where(is_child)
        key = lambda side: _by_table(schema, F.col("tbl"), lambda t: F.get_json_object(side, f"$.{t.partition.column}") if t in children else None)
        parent = _by_table(schema, F.col("tbl"), lambda t: F.lit(t.partition.table) if t in children else None)
        sides = mine.select("stream_index", "ord", parent.alias("parent"), F.posexplode(F.array(key("before"), key("after"))).alias("side", "parent_key")).where("parent_key is not null")
        known = parent_periods(parent_updates(changes, schema), index)
        during = (sides["parent"] == known["tbl"]) & (sides["parent_key"] == known["known_key"]) & (sides["stream_index"] >= known["since"]) & (sides["stream_index"] < known["until"])
        answered = sides.join(known, during, "left")
        ways = answered.groupBy("stream_index", "ord").agg(
            F.max(F.when(F.col("side") == 0, F.col("found"))).alias("was"),
            F.max(F.when(F.col("side") == 1, F.col("found"))).alias("now"),
            F.bool_or(F.col("found").isNull()).alias("lost"),
        )
        placed = placed.unionByName(mine.join(ways, ["stream_index", "ord"], "left").withColumn("lost", F.coalesce("lost", F.lit(False))))
    old_key = _by_table(schema, F.col("tbl"), lambda t: key_of(F.col("before"), t))
    new_key = _by_table(schema, F.col("tbl"), lambda t: key_of(F.col("after"), t))

    def part(partition: str, op: Column, key: Column, before: Column, after: Column, outcome: str, turn: int) -> Column:
        return F.struct(F.col(partition).alias("partition"), op.alias("op"), key.alias("key"), before.alias("before"), after.alias("after"), F.lit(outcome).alias("outcome"), F.lit(turn).alias("turn"))

    b, a, none = F.col("before"), F.col("after"), F.lit(None).cast("string")
    leave = part("was", F.lit("delete"), old_key, b, none, "moved", 0)
    enter = part("now", F.lit("insert"), new_key, none, a, "moved", 1)
    stay = part("now", F.lit("update"), new_key, b, a, "routed", 0)
    insert = part("now", F.lit("insert"), new_key, none, a, "routed", 0)
    delete = part("was", F.lit("delete"), old_key, b, none, "routed", 0)
    nowhere = part("now", F.col("op"), F.coalesce(new_key, old_key), b, a, "unpartitioned", 0)
    was, now = F.col("was").isNotNull(), F.col("now").isNotNull()
    parts = (
        F.when(was & now & (F.col("was") == F.col("now")), F.array(stay))
        .when(was & now, F.array(leave, enter))
        .when(now, F.array(insert))
        .when(was, F.array(delete))
        .otherwise(F.array(nowhere))
    )
    routed = placed.withColumn("part", F.explode(parts))
    outcome = F.when(F.col("part.partition").isNull() & F.col("lost"), F.lit("unresolved")).otherwise(F.col("part.outcome"))
    return routed.select("stream_index", "gtid", "part.partition", "ord", F.col("part.turn").alias("turn"), "tbl", "part.op", "part.key", "part.before", "part.after", outcome.alias("outcome"))


def sequence(routed: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """routed with seq: each partition's transactions numbered from 1, or on from last (partition, seq), without gaps.

    Only (partition, transaction) pairs are numbered, and changes take their pair's number. Pairs are ranked within stretches
    of STRETCH stream indexes, and stretches' sizes are summed before, so a partition that has most transactions isn't ranked
    in one task.
    """
    pairs = routed.where("partition is not null").select("partition", "stream_index").distinct().withColumn("stretch", F.floor(F.col("stream_index") / STRETCH))
    sizes = pairs.groupBy("partition", "stretch").agg(F.count("*").alias("size"))
    earlier = F.sum("size").over(Window.partitionBy("partition").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("partition", "stretch", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("partition", "stretch").orderBy("stream_index"))
    pairs = pairs.withColumn("rank", rank).join(sizes, ["partition", "stretch"]).select("partition", "stream_index", (F.col("rank") + F.col("earlier")).cast("long").alias("seq"))
    if last is not None:
        before = last.select("partition", F.col("seq").alias("before"))
        pairs = pairs.join(before, "partition", "left").select("partition", "stream_index", (F.col("seq") + F.coalesce("before", F.lit(0))).alias("seq"))
    return routed.join(pairs, ["partition", "stream_index"])


def counters(routed: DataFrame) -> DataFrame:
    """How many changes had each outcome; a move counts once."""
    return routed.where("turn = 0").groupBy("outcome").agg(F.count("*").alias("changes"))


def folded(changes: DataFrame, order: list[str]) -> DataFrame:
    """One row for each (tbl, key): the first image before and the last one after. Rows need tbl, key, before, after."""
    at = F.struct(*order)
    return changes.groupBy("tbl", F.col("key").alias(KEY)).agg(F.min_by("before", at).alias("before"), F.max_by("after", at).alias("after"))


def rekeyed(changes: DataFrame, schema: Schema) -> DataFrame:
    """Updates of a primary key as a delete of the old row and an insert of the new one, in that order."""
    old = _by_table(schema, F.col("tbl"), lambda t: key_of(F.col("before"), t))
    new = _by_table(schema, F.col("tbl"), lambda t: key_of(F.col("after"), t))
    none = F.lit(None).cast("string")

    def part(key, before, after, half):
        return F.struct(key.alias("key"), before.alias("before"), after.alias("after"), F.lit(half).alias("half"))

    changed = F.col("before").isNotNull() & F.col("after").isNotNull() & (old != new)
    parts = F.when(changed, F.array(part(old, F.col("before"), none, 0), part(new, none, F.col("after"), 1))).otherwise(F.array(part(F.coalesce(new, old), F.col("before"), F.col("after"), 0)))
    rest = [c for c in changes.columns if c not in ("key", "before", "after", "half")]
    return changes.withColumn("part", F.explode(parts)).select(*rest, "part.key", "part.before", "part.after", "part.half")


def images_by_table(changes: DataFrame, schema: Schema, order: list[str], stored: dict[str, DataFrame] | None = None, names: set[str] | None = None) -> dict[str, DataFrame]:
    """Folded changes of each table (or the named ones) as key, before and after images with stored values, as in the stored tables if given."""
    out = {}
    for t in schema.tables:
        if names is not None and t.name not in names:
            continue
        # Keys of one table only: the expressions stay small.
        alone = Schema((t,), schema.partition_kind, by_name={t.name: t})
        rows = folded(rekeyed(changes.where(F.col("tbl") == t.name), alone), [*order, "half"])
        like = stored_types(stored[t.name]) if stored and t.name in stored else None
        out[t.name] = rows.select(KEY, image(F.col("before"), t, like).alias("before"), image(F.col("after"), t, like).alias("after")).where("before is not null or after is not null")
    return out


def deduplicated(batch: DataFrame, applied: DataFrame, log: DataFrame) -> DataFrame:
    """batch (partition, seq, gtid) with status: new, duplicate, conflict (another gtid was applied at this seq) or gap.

    applied: partition, seq applied last (0 or none: any first seq is accepted). log: partition, seq, gtid of what was applied.
    """
    known = applied.select("partition", F.col("seq").alias("applied"))
    logged = log.select("partition", "seq", F.col("gtid").alias("logged"))
    first = batch.groupBy("partition").agg(F.min("seq").alias("first"))
    before = batch.select("partition", (F.col("seq") + 1).alias("seq"), F.lit(True).alias("follows")).distinct()
    rows = batch.join(known, "partition", "left").join(first, "partition", "left").join(logged, ["partition", "seq"], "left").join(before, ["partition", "seq"], "left")
    applied_seq = F.coalesce("applied", F.lit(0))
    gap = F.col("follows").isNull() & (F.col("seq") > applied_seq + 1) & ~((applied_seq == 0) & (F.col("seq") == F.col("first")))
    status = (
        F.when((F.col("seq") <= applied_seq) & F.col("logged").isNotNull() & (F.col("logged") != F.col("gtid")), "conflict")
        .when(F.col("seq") <= applied_seq, "duplicate")
        .when(gap, "gap")
        .otherwise("new")
    )
    return rows.withColumn("status", status).drop("applied", "logged", "first", "follows")


def quarantine(batch: DataFrame, quarantined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what goes on, what is put aside verbatim) by partition."""
    aside = quarantined.select("partition").distinct()
    return batch.join(aside, "partition", "left_anti"), batch.join(aside, "partition", "left_semi")


def replayable(held: DataFrame, position: str) -> DataFrame:
    """Held changes that a fill at position doesn't have yet, in no order; they are applied by (seq, ord)."""
    return held.where(~F.coalesce(GtidSet.parse(position).contains_column(F.col("gtid")), F.lit(False)))


def position_of(ids: DataFrame) -> GtidSet:
    """The position that ids (gtid) add up to. Ids are counted by stretches of numbers; only stretches with gaps are looked into."""
    parsed = ids.where(F.col("gtid").isNotNull()).select(F.lower(F.substring_index("gtid", ":", 1)).alias("u"), F.substring_index("gtid", ":", -1).try_cast("bigint").alias("n"))
    parsed = parsed.where("n is not null").distinct().withColumn("stretch", F.floor(F.col("n") / STRETCH))
    by_stretch = parsed.groupBy("u", "stretch").agg(F.min("n").alias("a"), F.max("n").alias("z"), F.count("*").alias("size"))
    # In a stretch, a number that follows none begins an interval: ranks of numbers and numbers differ by the same within one.
    island = F.col("n") - F.row_number().over(Window.partitionBy("u", "stretch").orderBy("n"))
    gaps = by_stretch.where("size < z - a + 1").select("u", "stretch")
    broken = parsed.join(gaps, ["u", "stretch"], "left_semi").withColumn("island", island).groupBy("u", "stretch", "island").agg(F.min("n").alias("a"), F.max("n").alias("z"))
    spans = by_stretch.where("size = z - a + 1").select("u", "a", "z").unionByName(broken.select("u", "a", "z"))
    out = GtidSet()
    found: dict[str, list[tuple[int, int]]] = {}
    for r in spans.toLocalIterator():
        found.setdefault(r["u"], []).append((r["a"], r["z"]))
    for u, mine in found.items():
        out = out.union(GtidSet({u: tuple(sorted(mine))}))
    return out


def filled(source: DataFrame, table: Table, partition: str, parents: DataFrame | None = None, parent: Table | None = None) -> DataFrame:
    """The rows of a partition: by the partition column, or by parents in the partition."""
    if isinstance(table.partition, str):
        return source.where(F.col(table.partition).cast("string") == partition)
    inside = parents.where(F.col(parent.partition).cast("string") == partition).select(F.col(parent.primary_key[0]).alias("__parent"))
    return source.join(inside, source[table.partition.column] == inside["__parent"], "left_semi")
