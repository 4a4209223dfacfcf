"""The write side as queries over the driver's tables, with DuckDB's SQL for each: the engine, deltas, overlays, mutations, ids.

Tables change by rules that SQL can state too, so each query runs the operator over whole tables and is held against SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.functions import wire
from viewtide.functions.gtid import GtidSet
from viewtide.operators import changes as ch
from viewtide.operators import levels as lv
from viewtide.operators import maintain as mt
from viewtide.operators import overlay as ov
from viewtide.operators import replica as rp
from viewtide.plans import named
from viewtide.plans.planner import plan_query
from viewtide.plans.query import q
from viewtide.plans.schema import KEY, Column, Derived, Table, describe
from viewtide.queries import AFTER, FOLD, MEMBERS, O9, WITH_ORDERS, customer_changes, register, schema, tables
from viewtide.sources.keys import KeySet
from viewtide.sources.shared import cut
from viewtide.sources.tables import introspect, matches
from viewtide.streaming import delivery as dv
from viewtide.streaming.engine import Engine

UUID = "7f3c2b1a-50de-4c11-9a8f-0d9b6c2e4f10"


def rows(spark: SparkSession, data: list[tuple], schema_: str) -> DataFrame:
    return spark.createDataFrame(data, schema_)


# Nulls: orders of every third customer have no priority.
SPARSE = "SELECT * REPLACE (CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders"


def sparse(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = tables(spark, sf_dir)
    return dict(t) | {"orders": t["orders"].withColumn("o_orderpriority", F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")))}


def on_sparse(name: str, query, sql: str) -> None:
    register(name, sql)(lambda spark, sf_dir: lv.root_rows(plan_query(schema(), query.query), sparse(spark, sf_dir)).select("o_orderkey"))


on_sparse("filter_is_null", q("orders").where(lambda c: c.and_(c.is_null("o_orderpriority"), c.gt("o_totalprice", 100000))), f"SELECT o_orderkey FROM ({SPARSE}) WHERE o_orderpriority IS NULL AND o_totalprice > 100000")
on_sparse("filter_is_not_null", q("orders").where(lambda c: c.and_(c.is_not_null("o_orderpriority"), c.not_(c.eq("o_orderpriority", "5-LOW")))), f"SELECT o_orderkey FROM ({SPARSE}) WHERE o_orderpriority IS NOT NULL AND NOT o_orderpriority = '5-LOW'")
on_sparse("filter_null_is_unknown", q("orders").where(lambda c: c.not_(c.in_("o_orderpriority", ["1-URGENT", "2-HIGH"]))), f"SELECT o_orderkey FROM ({SPARSE}) WHERE NOT o_orderpriority IN ('1-URGENT', '2-HIGH')")
on_sparse("order_nulls_first", q("orders").order_by("o_orderpriority").order_by("o_totalprice", "desc").limit(200), f"SELECT o_orderkey FROM ({SPARSE}) ORDER BY o_orderpriority ASC NULLS FIRST, o_totalprice DESC, o_orderkey LIMIT 200")
on_sparse("order_nulls_last", q("orders").where(lambda c: c.lt("o_totalprice", 30000)).order_by("o_orderpriority", "desc").limit(700), f"SELECT o_orderkey FROM ({SPARSE}) WHERE o_totalprice < 30000 ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey LIMIT 700")


@register("order_reversed", f"SELECT o_orderkey FROM orders ORDER BY {FOLD.format('o_orderpriority')} DESC, o_orderpriority DESC, o_totalprice ASC, o_orderkey DESC LIMIT 40")
def order_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_query(schema(), q("orders").order_by("o_orderpriority").order_by("o_totalprice", "desc").query)
    return tables(spark, sf_dir)["orders"].orderBy(*lv.order_columns(planned, reverse=True)).limit(40).select("o_orderkey")


@register("derived_not_null", f"SELECT o_orderkey, o_orderpriority IS NOT NULL AS known FROM ({SPARSE})")
def derived_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = schema().table("orders")
    known = Table("orders", t.primary_key, (*t.columns, Column("known", "bool", derived=Derived("o_orderpriority", "not_null"))))
    return known.keyed(sparse(spark, sf_dir)["orders"].drop(KEY)).select("o_orderkey", "known")


@register("include_in_key_order", f"""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY '["' || o_orderkey || '"]') AS place,
  (SELECT string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ' ' ORDER BY '["' || l_orderkey || '",' || l_linenumber || ',"' || l_partkey || '","' || l_suppkey || '"]') FROM lineitem WHERE l_orderkey = o_orderkey) AS lines
FROM orders WHERE o_orderkey IN ({O9})
""")  # fmt: skip
def include_in_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_query(schema(), WITH_ORDERS.query)
    found = lv.nested(planned, lv.level_rows(planned, tables(spark, sf_dir))).select(F.posexplode("$orders").alias("at", "o"))
    lines = F.array_join(F.transform("o.$lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])), " ")
    return found.select(F.col("o.o_orderkey").alias("o_orderkey"), (F.col("at") + 1).cast("long").alias("place"), F.when(F.size("o.$lines") > 0, lines).alias("lines"))


@register("include_of_many_to_one", f"SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name AS part FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN ({O9})")
def include_of_many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_query(schema(), WITH_ORDERS.query)
    found = lv.nested(planned, lv.level_rows(planned, tables(spark, sf_dir))).select(F.explode("$orders").alias("o")).select(F.explode("o.$lines").alias("l"))
    return found.select("l.l_orderkey", "l.l_linenumber", "l.l_partkey", "l.l_suppkey", F.col("l.$part.p_name").alias("part")).distinct()


@register("member_rows", "SELECT c_custkey FROM customer WHERE c_acctbal > 4000 AND (c_custkey % 5 = 0 OR c_nationkey = 3)")
def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a subscription, and rows that own writes made, where they match."""
    t = tables(spark, sf_dir)
    members = t["customer"].where("c_custkey % 5 = 0").select(KEY)
    return lv.root_rows(plan_query(schema(), q("customer").where(lambda c: c.gt("c_acctbal", 4000)).query), t, members, F.col("c_nationkey") == 3).select("c_custkey")


@register("members_through_bases", "SELECT 'orders' AS tbl, '[\"' || o_orderkey || '\"]' AS __key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 90")
def members_through_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 30, 60 and 90 rows, each told as what it has beyond the one before."""
    t, r, last = tables(spark, sf_dir), rp.Replica(spark, schema()), None
    for n in (30, 60, 90):
        members = cut(lv.seen(lv.recompute(plan_query(schema(), q("orders").order_by("o_totalprice", "desc").limit(n).query), t)))
        r.members[str(n)] = members if last is None else lv.grown(last, members)
        if last is not None:
            r.based_on[str(n)] = str(n - 30)
        last = members
    return r.members_of("90")


@register("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = ov.LocalTransaction(schema(), tables(spark, sf_dir), {})
    row = tx.get("customer", ("42",))
    return rows(spark, [(row["c_custkey"], row["c_name"])] if row else [], "c_custkey long, c_name string")


@register("type_check", "SELECT * FROM (VALUES ('customer', 'c_acctbal is string, not float'), ('customer', 'c_name is missing')) t(tbl, problem)")
def type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = tables(spark, sf_dir), schema()
    broken = t["customer"].withColumn("c_acctbal", F.col("c_acctbal").cast("string")).drop("c_name")
    found = [(x.name, p) for x in s.tables for p in matches(x, broken if x.name == "customer" else t[x.name])]
    return rows(spark, sorted(found), "tbl string, problem string")


@register("introspected", "SELECT table_name AS tbl, column_name AS col, CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type IN ('INTEGER', 'SMALLINT', 'TINYINT') THEN 'int' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'float' WHEN data_type LIKE 'DECIMAL%' THEN 'decimal' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'DATE' THEN 'date' WHEN data_type = 'BOOLEAN' THEN 'bool' ELSE 'string' END AS kind FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'nation')")
def introspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(n, c.name, c.kind) for n in ("customer", "orders", "nation") for c in introspect(spark.read.parquet(f"{sf_dir}/{n}.parquet"), n, ()).columns]
    return rows(spark, found, "tbl string, col string, kind string")


@register("source_filter", "SELECT c_custkey AS ord, 'customer' AS tbl FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of tables that the schema has, of a source that sends others too."""
    t = tables(spark, sf_dir)
    parts = [t["customer"].select(F.col("c_custkey").alias("ord"), F.lit("customer").alias("tbl")), t["supplier"].select(F.col("s_suppkey").alias("ord"), F.lit("supplier").alias("tbl")), t["part"].select(F.col("p_partkey").alias("ord"), F.lit("audit").alias("tbl"))]
    return ch.synced(parts[0].unionByName(parts[1]).unionByName(parts[2]), schema())


@register("raw_rows", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_custkey % 7 = 3 AS bad FROM customer")
def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and bytes of two cells, the second null now and then; some rows say one byte too many."""
    c = tables(spark, sf_dir)["customer"]
    second = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    lengths = F.array(F.octet_length("c_name") + F.when(F.col("c_custkey") % 7 == 3, 1).otherwise(0), F.coalesce(F.octet_length(second), F.lit(-1)))
    raw = c.select("c_custkey", "c_name", second.alias("s"), lengths.alias("n"), F.concat(F.col("c_name").cast("binary"), F.coalesce(second, F.lit("")).cast("binary")).alias("v"))
    cells, bad = wire.row_cells(F.col("n"), F.col("v"))
    read = raw.select("c_custkey", "c_name", "s", cells.alias("cells"), bad.alias("bad"))
    # A bad row has no cells; its own are told from the source.
    return read.select("c_custkey", F.when(F.col("bad"), F.col("c_name")).otherwise(F.get("cells", 0).cast("string")).alias("name"), F.when(F.col("bad"), F.col("s")).otherwise(F.get("cells", 1).cast("string")).alias("segment"), "bad")


@register("changed_windows", f"""
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN o_totalprice + 300000 WHEN o_orderkey % 50 = 9 THEN 0 ELSE o_totalprice END AS price FROM orders),
old AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60), new AS (SELECT o_orderkey FROM a ORDER BY price DESC, o_orderkey LIMIT 60)
SELECT 'orders' AS tbl, '["' || o_orderkey || '"]' AS __key, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old)
UNION ALL SELECT 'orders', '["' || o_orderkey || '"]', 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)
""")  # fmt: skip
def changed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and others move within the order: the window is rebalanced and refilled."""
    t = tables(spark, sf_dir)
    price = F.when(F.col("o_orderkey") % 50 == 7, F.col("o_totalprice") + 300000).when(F.col("o_orderkey") % 50 == 9, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    touched = t["orders"].where("o_orderkey % 50 in (7, 9)")
    names = [c for c in touched.columns if c != KEY]
    by_table = {"orders": cut(touched.select(KEY, F.struct(*names).alias("before"), F.struct(*((price if n == "o_totalprice" else F.col(n)).alias(n) for n in names)).alias("after")))}
    planned = plan_query(schema(), q("orders").order_by("o_totalprice", "desc").limit(60).query)
    members = mt.FrameMembers(cut(lv.recompute(planned, t)))
    moves = mt.affected(planned, members, mt.apply_changes(dict(t), by_table), by_table)
    return mt.changed_rows(spark, mt.entered_and_left(planned, members, moves, spark))


@register("latest_parents", "SELECT 'customer' AS tbl, CAST(c_custkey AS VARCHAR) AS parent_key, CAST(CASE WHEN c_custkey % 10 = 3 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS VARCHAR) AS partition FROM customer UNION ALL SELECT 'customer', CAST(c_custkey + 1000000000 AS VARCHAR), CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 9")
def latest_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tables(spark, sf_dir)["customer"].select(F.lit("customer").alias("tbl"), F.col("c_custkey").cast("string").alias("parent_key"), F.col("c_nationkey").cast("string").alias("partition"))
    return ch.latest_parents(ch.parent_updates(customer_changes(spark, sf_dir), schema()), index)


@register("batch_with_gaps", "WITH e AS (SELECT event_id + event_id // 40 + 1 AS seq FROM events) SELECT seq, CASE WHEN seq <= 100 THEN 'duplicate' WHEN seq > 101 AND seq - 1 NOT IN (SELECT seq FROM e) THEN 'gap' ELSE 'new' END AS status FROM e")
def batch_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fortieth number is missing."""
    e = tables(spark, sf_dir)["events"].select(F.lit("p").alias("partition"), (F.col("event_id") + F.floor(F.col("event_id") / 40) + 1).cast("long").alias("seq"))
    e = e.withColumn("gtid", F.concat(F.lit("g"), "seq"))
    found = ch.deduplicated(e, rows(spark, [("p", 100)], "partition string, seq long"), e.where("seq <= 100"))
    return found.select("seq", "status")


@register("quarantined", "SELECT event_id, CAST(user_id AS VARCHAR) AS partition, user_id % 5 = 2 AS aside FROM events")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"].select("event_id", F.col("user_id").cast("string").alias("partition"))
    listed = e.select("partition").where("partition % 5 = 2").distinct().withColumn("reason", F.lit("rejected"))
    goes, aside = ch.quarantine(e, listed)
    return goes.withColumn("aside", F.lit(False)).unionByName(aside.withColumn("aside", F.lit(True)))


@register("delivery_batches", "SELECT CAST(user_id AS VARCHAR) AS partition, event_id AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS batch FROM events")
def delivery_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    txs = e.select(F.col("user_id").cast("string").alias("partition"), F.col("event_id").alias("seq"), F.lit("g").alias("gtid"), F.lit("[]").alias("changes"))
    return dv.batch_numbers(txs, dv.Limits(transactions=3))


@register("delivery_outcomes", "WITH e AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 2 AS b FROM events) SELECT CAST(user_id AS VARCHAR) AS partition, min(event_id) AS first_seq, max(event_id) AS last_seq, CASE WHEN user_id % 10 = 7 THEN 'rejected' ELSE 'applied' END AS status FROM e WHERE user_id % 10 <> 7 OR b = 0 GROUP BY user_id, b")
def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that takes nothing of some partitions: these stop at their first batch."""
    e = tables(spark, sf_dir)["events"]
    txs = e.select(F.col("user_id").cast("string").alias("partition"), F.col("event_id").alias("seq"), F.lit("g").alias("gtid"), F.lit("[]").alias("changes"))
    answer = lambda batch: {"rejected": "invalid_row"} if batch["partition"].endswith("7") else {"applied_seq": batch["transactions"][-1]["seq"]}
    return cut(dv.deliver(txs, lambda: answer, {}, dv.Limits(transactions=2))).select("partition", "first_seq", "last_seq", "status")


@register("ids_in_sets", "SELECT event_id, event_id < 300 OR event_id BETWEEN 399 AND 449 AS in_union, (event_id < 100 OR event_id BETWEEN 200 AND 299) AS in_difference FROM events")
def ids_in_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = GtidSet.parse(f"{UUID}:1-120:101-300"), GtidSet.parse(f"{UUID}:101-200:400-450")
    gtid = F.concat(F.lit(f"{UUID}:"), F.col("event_id") + 1)
    return tables(spark, sf_dir)["events"].select("event_id", a.union(b).contains_column(gtid).alias("in_union"), a.difference(b).contains_column(gtid).alias("in_difference"))


@register("merged_intervals", f"WITH e AS (SELECT DISTINCT event_id + event_id // 13 + 1 AS n FROM events), i AS (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM e) SELECT '{UUID}' AS source, min(n) AS first, max(n) AS last FROM i GROUP BY g")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position that a stream's ids add up to; every thirteenth is missing."""
    n = (F.col("event_id") + F.floor(F.col("event_id") / 13) + 1).cast("long")
    found = ch.position_of(tables(spark, sf_dir)["events"].select(F.concat(F.lit(f"{UUID}:"), n).alias("gtid")))
    return rows(spark, [(u, a, z) for u, spans in found.intervals.items() for a, z in spans], "source string, first long, last long")


# The engine over customers: all of them filled, then transactions by the rules of customer_changes.
def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, schema())
    t = tables(spark, sf_dir)
    for fill, name in e.ensure({"customer", "nation"}):
        e.fill(fill, t[name])
        e.complete(fill, "")
    return e


def transactions(spark: SparkSession, sf_dir: str, first: int = 1) -> list[dict]:
    """The customers' changes as they would come in batches, ten to a transaction. A batch is the driver's by nature."""
    every = customer_changes(spark, sf_dir).orderBy("ord").toLocalIterator()
    each = [{"table": "customer", "op": r["op"], "key": [json.loads(r["before"] or r["after"])["c_custkey"]], "before": r["before"], "after": r["after"]} for r in every]
    return [{"seq": first + i, "gtid": f"{UUID}:{first + i}", "changes": each[i * 10 : i * 10 + 10]} for i in range(-(-len(each) // 10))]


def sent(e: Engine, txs: list[dict], **other) -> dict:
    return {"protocol": 1, "schema_hash": e.schema.hash, "epoch": 0, "partition": "", "transactions": txs} | other


LATER = AFTER.replace("c_custkey % 10 = 3", "c_custkey % 10 = 3 AND c_custkey > 100").replace("WHERE c_custkey % 10 <> 7", "WHERE c_custkey % 10 <> 7 OR c_custkey <= 100").replace("WHERE c_custkey % 10 = 9", "WHERE c_custkey % 10 = 9 AND c_custkey > 100")
RICH = q("customer").where(lambda c: c.and_(c.gt("c_acctbal", 3000), c.lt("c_nationkey", 12))).include("nation")


@register("engine_tables", AFTER)
def engine_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.apply_batch(sent(e, transactions(spark, sf_dir)))
    return e.tables["customer"].select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("engine_delta", f"""
WITH a AS ({AFTER}), old AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 3000 AND c_nationkey < 12), new AS (SELECT c_custkey, c_nationkey FROM a WHERE c_acctbal > 3000 AND c_nationkey < 12),
o AS (SELECT 'customer' AS tbl, '["' || c_custkey || '"]' AS __key FROM old UNION SELECT 'nation', '[' || c_nationkey || ']' FROM old),
n AS (SELECT 'customer' AS tbl, '["' || c_custkey || '"]' AS __key FROM new UNION SELECT 'nation', '[' || c_nationkey || ']' FROM new)
SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)
""")  # fmt: skip
def engine_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    key, _ = e.subscribe(RICH.query)
    _, (delta,) = e.apply_batch(sent(e, transactions(spark, sf_dir)))
    return delta.changed[key]


@register("engine_snapshot", "SELECT 'customer' AS tbl, '[\"' || c_custkey || '\"]' AS __key FROM customer WHERE c_acctbal > 3000 AND c_nationkey < 12 UNION SELECT 'nation', '[' || c_nationkey || ']' FROM customer WHERE c_acctbal > 3000 AND c_nationkey < 12")
def engine_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a snapshot's chunks hold."""
    e = engine(spark, sf_dir)
    _, (snapshot,) = e.subscribe(RICH.query)
    parts = [df.select(F.lit(name).alias("tbl"), KEY) for name, df in snapshot.parts() if name != "members"]
    return parts[0].unionByName(parts[1])


@register("engine_status", "SELECT 'customer' AS tbl, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation")
def engine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sorted(engine(spark, sf_dir).status()["rows"].items()), "tbl string, n long")


@register("members_counted", "SELECT '' AS path, count(*) AS n FROM customer WHERE c_acctbal > 3000 AND c_nationkey < 12 UNION ALL SELECT 'nation', count(DISTINCT c_nationkey) FROM customer WHERE c_acctbal > 3000 AND c_nationkey < 12")
def members_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    key, _ = e.subscribe(RICH.query)
    return e.subscriptions[key].members.groupBy("path").agg(F.count("*").alias("n"))


@register("rejected_rows", "SELECT * FROM (VALUES ('no after image', 'invalid_row'), ('null', 'invalid_row'), ('number', 'invalid_row'), ('protocol', 'protocol_version'), ('schema', 'schema_mismatch'), ('partition', 'wrong_partition'), ('gap', 'gap'), ('conflict', 'conflict'), ('table', 'invalid_row')) t(batch, reason) UNION ALL SELECT 'customers left: ' || count(*), '' FROM customer")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.apply_batch(sent(e, [{"seq": 1, "gtid": f"{UUID}:1", "changes": []}]))
    row = {"c_custkey": "1", "c_name": "x", "c_nationkey": 1, "c_acctbal": 1.0, "c_mktsegment": "x"}

    def one(op: str, after: dict | None, table: str = "customer", seq: int = 2, gtid: str | None = None) -> list[dict]:
        return [{"seq": seq, "gtid": gtid or f"{UUID}:{seq}", "changes": [{"table": table, "op": op, "key": ["1"], "before": json.dumps(row), "after": after and json.dumps(after)}]}]

    asked = {
        "no after image": sent(e, one("update", None)), "null": sent(e, one("update", row | {"c_name": None})), "number": sent(e, one("update", row | {"c_nationkey": "abc"})),
        "protocol": sent(e, one("delete", None), protocol=9), "schema": sent(e, one("delete", None), schema_hash="x"), "partition": sent(e, one("delete", None), partition="x"),
        "gap": sent(e, one("delete", None, seq=9)), "conflict": sent(e, one("delete", None, seq=1, gtid=f"{UUID}:77")), "table": sent(e, one("insert", row, "nowhere")),
    }
    found = [(name, e.apply_batch(b)[0]["rejected"]) for name, b in asked.items()]
    return rows(spark, [*found, (f"customers left: {e.tables['customer'].count()}", "")], "batch string, reason string")


@register("held_and_replayed", LATER)
def held_and_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes come while the table fills; those that the fill's position has are skipped, the others applied."""
    e = Engine(spark, schema())
    ((fill, _),) = e.ensure({"customer"})
    txs = transactions(spark, sf_dir)
    e.apply_batch(sent(e, txs))
    e.fill(fill, tables(spark, sf_dir)["customer"])
    # Three of ten customers change, so the first three transactions are those of the first hundred.
    e.complete(fill, f"{UUID}:1-3")
    return e.tables["customer"].select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("epoch_reset", "SELECT 'pending' AS status, 1 AS applied, 0 AS tables, 1 AS held")
def epoch_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    key, _ = e.subscribe(RICH.query)
    ack, _ = e.apply_batch(sent(e, transactions(spark, sf_dir)[:1], epoch=1))
    return rows(spark, [(e.subscriptions[key].status, ack["applied_seq"], len(e.live), len(e.held))], "status string, applied int, tables int, held int")


@register("abandoned_subscriptions", "SELECT * FROM (VALUES (100, 2, CAST(3600 AS DOUBLE)), (3600, 1, CAST(3650 AS DOUBLE)), (9999, 0, NULL)) t(seconds, kept, following)")
def abandoned_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left at 0 and 50 seconds: how many are kept at a time, and when the next one goes."""
    e, found = Engine(spark, schema()), []
    for at, query in ((0, q("nation")), (50, q("region"))):
        e.unsubscribe(e.subscribe(query.query)[0], now=at)
    for at in (100, 3600, 9999):
        e.sweep(now=at)
        following = e.next_sweep()
        found.append((at, len(e.subscriptions), None if following is None else float(following)))
    return rows(spark, found, "seconds int, kept int, following double")


@register("fills_retried", "SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, true), (5, true), (6, false)) t(attempt, filling)")
def fills_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fill is tried five times; after that the table is absent again."""
    e, found = Engine(spark, schema()), []
    ((fill, _),) = e.ensure({"nation"})
    for attempt in range(1, 7):
        found.append((attempt, "nation" in e.scopes and fill is not None))
        fill = e.retry(fill) if fill is not None else None
    return rows(spark, found, "attempt int, filling boolean")


# Mutations: every mutator writes through the same calls on client and source.
MUTATORS = {
    "rename": lambda tx, a, context: tx.update("nation", (a["key"],), {"n_name": a["name"]}),
    "found": lambda tx, a, context: tx.insert("nation", a),
    "dissolve": lambda tx, a, context: tx.delete("nation", (a,)),
}
SCRIPT = [("rename", {"key": 3, "name": "THREE"}), ("found", {"n_nationkey": 90, "n_name": "NEW", "n_regionkey": 1}), ("dissolve", 7), ("found", {"n_nationkey": 4, "n_name": "AGAIN", "n_regionkey": 1}), ("rename", {"key": 99, "name": "NONE"})]
MUTATED = "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'THREE' {0} ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 90, 'NEW', 1"


@register("optimistic_view", MUTATED.format("WHEN n_nationkey = 4 THEN 'AGAIN'").replace("n_name END AS n_name, n_regionkey", "n_name END AS n_name, CASE WHEN n_nationkey = 4 THEN 1 ELSE n_regionkey END AS n_regionkey"))
def optimistic_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the client an insert of a key that is there is an upsert, until the source answers."""
    log = ov.MutationLog(schema(), MUTATORS, tables(spark, sf_dir))
    for name, args in SCRIPT:
        log.mutate(name, args)
    return log.view("nation").select("n_nationkey", "n_name", "n_regionkey")


@register("pushed_mutations", MUTATED.format(""))
def pushed_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the source has after the push: the second insert of a key and the rename of a row that isn't there failed."""
    stored = {(t, r[KEY]): {c: r[c] for c in r.asDict() if c != KEY} for t in ("nation",) for r in tables(spark, sf_dir)[t].collect()}
    p = ov.Pusher(schema(), MUTATORS, stored)
    p.push({"client_id": "c", "partition": "", "mutations": [{"id": i, "name": n, "args": a} for i, (n, a) in enumerate(SCRIPT, 1)]})
    return rows(spark, [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in stored.values()], "n_nationkey int, n_name string, n_regionkey int")


@register("push_outcomes", "SELECT * FROM (VALUES (1, 'applied'), (2, 'applied'), (3, 'applied'), (4, 'failed'), (5, 'failed'), (1, 'duplicate'), (9, 'out_of_order')) t(id, status)")
def push_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = {("nation", r[KEY]): {c: r[c] for c in r.asDict() if c != KEY} for r in tables(spark, sf_dir)["nation"].collect()}
    p = ov.Pusher(schema(), MUTATORS, stored)
    ask = lambda *ms: p.push({"client_id": "c", "partition": "", "mutations": [{"id": i, "name": n, "args": a} for i, n, a in ms]})
    first = ask(*((i, n, a) for i, (n, a) in enumerate(SCRIPT, 1)))["outcomes"]
    again, gap = ask((1, *SCRIPT[0]))["outcomes"], ask((9, *SCRIPT[0]))
    return rows(spark, [*((o["id"], o["status"]) for o in [*first, *again]), (9, gap["reason"])], "id int, status string")


@register("rebased_view", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'theirs' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 90, 'NEW'")
def rebased_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first mutation is confirmed, and the source has another name by now; the rest is replayed over that."""
    t = tables(spark, sf_dir)
    log = ov.MutationLog(schema(), MUTATORS, t)
    for name, args in SCRIPT[:3]:
        log.mutate(name, args)
    log.confirm(1, dict(t) | {"nation": t["nation"].withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.lit("theirs")).otherwise(F.col("n_name")))})
    return log.view("nation").select("n_nationkey", "n_name")


@register("query_in_transaction", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey NOT IN (3, 7) UNION ALL SELECT 90, 'NEW' UNION ALL SELECT 3, 'THREE' FROM nation WHERE n_nationkey = 3 AND n_regionkey = 1")
def query_in_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = ov.LocalTransaction(schema(), tables(spark, sf_dir), {})
    for name, args in SCRIPT[:3]:
        MUTATORS[name](tx, args, {})
    return tx.query(plan_query(schema(), q("nation").where(lambda c: c.eq("n_regionkey", 1)).query)).select("n_nationkey", "n_name")


@register("released_rows", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def released_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica of two subscriptions keeps the rows of the one that is left."""
    e, r = engine(spark, sf_dir), rp.Replica(spark, schema())
    keys = []
    for query in (q("customer").where(lambda c: c.eq("c_mktsegment", "BUILDING")), q("customer").where(lambda c: c.gt("c_acctbal", 5000))):
        key, (s,) = e.subscribe(query.query)
        r.apply_snapshot(key, s.cursor, s.rows, s.members)
        keys.append(key)
    r.release(keys[1])
    return r.tables["customer"].select("c_custkey")


@register("replica_follows", f"WITH a AS ({AFTER}) SELECT c_custkey, c_nationkey FROM a WHERE c_acctbal > 3000 AND c_nationkey < 12")
def replica_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot, then the delta of a batch: what the client reads."""
    e, r = engine(spark, sf_dir), rp.Replica(spark, schema())
    key, (s,) = e.subscribe(RICH.query)
    r.apply_snapshot(key, s.cursor, s.rows, s.members)
    _, (d,) = e.apply_batch(sent(e, transactions(spark, sf_dir)))
    r.apply_delta(d.cursor, d.changed, d.rows)
    return r.read(plan_query(schema(), RICH.query), key).select("c_custkey", "c_nationkey")


@register("sent_images", f"WITH a AS ({AFTER}) SELECT '[\"' || c_custkey || '\"]' AS __key, false AS gone FROM a WHERE c_acctbal > 3000 AND c_nationkey < 12 AND (c_custkey > 1000000000 OR c_custkey % 10 = 3) UNION ALL SELECT '[\"' || c_custkey || '\"]', true FROM customer WHERE c_custkey % 10 = 7")
def sent_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.subscribe(RICH.query)
    _, (d,) = e.apply_batch(sent(e, transactions(spark, sf_dir)))
    return d.rows["customer"].select(KEY, F.col("image").isNull().alias("gone"))


@register("named_query", "SELECT c_custkey FROM customer WHERE c_nationkey = 5 AND c_acctbal > 2500")
def named_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = {"rich": named.Definition(lambda context, least: q("customer").where(lambda c: c.and_(c.eq("c_nationkey", int(context.partition)), c.gt("c_acctbal", least))), float)}
    query = named.ask(definitions, ("rich", "2500"), named.Context("5", "someone", "c"))
    return lv.root_rows(plan_query(schema(), query), tables(spark, sf_dir)).select("c_custkey")


@register("refused_queries", "SELECT * FROM (VALUES ('nothing', 'unknown_query'), ('rich', 'invalid_args'), ('raw', 'raw_refused')) t(asked, reason)")
def refused_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions, context, found = {"rich": named.Definition(lambda context, least: q("customer"), float)}, named.Context("5", "someone", "c"), []
    for name, asked in (("nothing", ("nothing", 1)), ("rich", ("rich", "many")), ("raw", q("customer").query)):
        try:
            named.ask(definitions, asked, context)
        except named.ResolveProblem as e:
            found.append((name, e.reason))
    return rows(spark, found, "asked string, reason string")


@register("schema_columns", "SELECT table_name AS tbl, column_name AS col FROM information_schema.columns WHERE table_name IN ('region', 'nation') UNION ALL SELECT 'customer', * FROM (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment'), ('is_machine'))")
def schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(n, c) for n, d in describe(schema()).items() if n in ("region", "nation", "customer") for c in d["columns"]]
    return rows(spark, found, "tbl string, col string")


@register("scalar_texts", "SELECT 'it\\''s \\n' AS x, 'literal' AS what WHERE false UNION ALL SELECT * FROM (VALUES ('NULL', 'null'), ('1', 'bool'), ('''a\\\\b\\''c''', 'string'), ('a%2Fb%20c%C3%A9', 'path'), ('2026-01-02 03:04:05.006', 'now'), ('true', 'granted'), ('X''616263''', 'bytes')) t(x, what)")
def scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    now = datetime.datetime(2026, 1, 2, 3, 4, 5, 6789, datetime.UTC)
    found = [
        (wire.sql_literal("string", None), "null"), (wire.sql_literal("bool", True), "bool"), (wire.sql_literal("string", "a\\b'c"), "string"), (wire.percent_encoded("a/b cé"), "path"),
        (wire.now_text(now), "now"), (str(wire.granted([{"partitions": ["*"], "expires": 5}], "x", 4)).lower(), "granted"), (wire.sql_literal("bytes", "YWJj"), "bytes"),
    ]
    return rows(spark, found, "x string, what string")


@register("membership_union", f"SELECT DISTINCT tbl, __key FROM ({MEMBERS}) UNION SELECT 'customer', '[\"' || c_custkey || '\"]' FROM customer WHERE c_nationkey = 1")
def membership_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of any subscription, each once."""
    t = tables(spark, sf_dir)
    members = [lv.seen(lv.recompute(plan_query(schema(), x.query), t)) for x in (WITH_ORDERS, q("customer").where(lambda c: c.eq("c_nationkey", 1)))]
    return rp.membership_index({str(i): m for i, m in enumerate(members)}).select("tbl", KEY)


@register("membership_difference", "WITH o AS (SELECT c_custkey FROM customer WHERE c_acctbal > 3000), n AS (SELECT c_custkey FROM customer WHERE c_nationkey < 12) SELECT 'customer' AS tbl, '[\"' || c_custkey || '\"]' AS __key, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'customer', '[\"' || c_custkey || '\"]', 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def membership_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    old, new = (lv.seen(lv.recompute(plan_query(schema(), x.query), t)) for x in (q("customer").where(lambda c: c.gt("c_acctbal", 3000)), q("customer").where(lambda c: c.lt("c_nationkey", 12))))
    return lv.difference(new, old)


@register("stored_literals", "SELECT c_custkey FROM customer WHERE CAST(c_acctbal AS DECIMAL(12,2)) IN (711.56, 121.65) OR c_custkey IN (12, 13)")
def stored_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals are bound to what a column is stored as: bigints come as text, and one that can't be stored equals nothing."""
    t = tables(spark, sf_dir)
    balances = {"customer": t["customer"].withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))}
    where = q("customer").where(lambda c: c.or_(c.in_("c_acctbal", [711.56, 121.65]), c.in_("c_custkey", ["12", "13", str(2**63)])))
    return lv.root_rows(plan_query(schema(), where.query), dict(t) | balances).select("c_custkey")


@register("looked_up_in_tiers", f"SELECT * FROM ({AFTER}) WHERE c_custkey IN (3, 7, 9, 1000000009, -1)")
def looked_up_in_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in a live table's base, in its changes, and nowhere, looked up together."""
    e = engine(spark, sf_dir)
    e.apply_batch(sent(e, transactions(spark, sf_dir)))
    gone = KeySet(spark, frozenset(f'["{i}"]' for i in (3, 7, 9, 10**9 + 9, -1)))
    return e.live["customer"].rows(gone).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
