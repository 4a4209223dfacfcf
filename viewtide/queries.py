"""The engine's operators as queries over the driver's tables, with DuckDB's SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.operators import changes as ch
from viewtide.operators import levels as lv
from viewtide.operators import maintain as mt
from viewtide.operators import overlay as ov
from viewtide.operators import replica as rp
from viewtide.plans.planner import plan_query
from viewtide.plans.query import Builder, q
from viewtide.plans.schema import KEY, Column, Derived, Parent, Relation, Schema, Table, compile_schema, project
from viewtide.sources import fills as fl
from viewtide.sources.keys import KeySet
from viewtide.sources.shared import cut
from viewtide.sources.tables import by_columns, read_tables

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


@lru_cache(maxsize=1)
def schema() -> Schema:
    """The driver's tables: customers are partitioned by nation, orders take their customer's partition."""

    def columns(spec: str) -> tuple[Column, ...]:
        return tuple(Column(n, k) for n, k in (x.split(":") for x in spec.split()))

    def one(name: str, target: str, a: str, b: str) -> Relation:
        return Relation(name, "one", target, tuple(a.split()), tuple(b.split()))

    def many(name: str, target: str, a: str, b: str) -> Relation:
        return Relation(name, "many", target, tuple(a.split()), tuple(b.split()))

    return compile_schema(
        [
            Table("region", ("r_regionkey",), columns("r_regionkey:int r_name:string"), None, (many("nations", "nation", "r_regionkey", "n_regionkey"),)),
            Table("nation", ("n_nationkey",), columns("n_nationkey:int n_name:string n_regionkey:int"), "n_nationkey", (one("region", "region", "n_regionkey", "r_regionkey"), many("customers", "customer", "n_nationkey", "c_nationkey"))),
            Table(
                "customer", ("c_custkey",),
                (*columns("c_custkey:bigint c_name:string c_nationkey:int c_acctbal:float c_mktsegment:string"), Column("is_machine", "bool", derived=Derived("c_mktsegment", "starts_with", "MACH"))),
                "c_nationkey", (many("orders", "orders", "c_custkey", "o_custkey"), one("nation", "nation", "c_nationkey", "n_nationkey")),
            ),
            Table("supplier", ("s_suppkey",), columns("s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:float"), "s_nationkey", (one("nation", "nation", "s_nationkey", "n_nationkey"),)),
            Table("part", ("p_partkey",), columns("p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:float")),
            Table(
                "orders", ("o_orderkey",), columns("o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:float o_orderdate:datetime o_orderpriority:string"),
                Parent("o_custkey", "customer"), (one("customer", "customer", "o_custkey", "c_custkey"), many("lines", "lineitem", "o_orderkey", "l_orderkey")),
            ),
            Table(
                "lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
                columns("l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:float l_extendedprice:float l_discount:float l_returnflag:string l_shipdate:datetime"), None,
                (one("order", "orders", "l_orderkey", "o_orderkey"), one("part", "part", "l_partkey", "p_partkey"), one("supplier", "supplier", "l_suppkey", "s_suppkey")),
            ),
            Table("events", ("event_id",), columns("event_id:bigint user_id:bigint event_type:string value:float props:json")),
            Table("conversations", ("conv_id", "turn"), columns("conv_id:bigint turn:bigint role:string text:string"), None, (one("self", "conversations", "conv_id turn", "conv_id turn"),)),
        ],
        "int",
    )


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return read_tables(spark, schema(), sf_dir)


def register(name: str, sql: str | None) -> Callable[[Run], Run]:
    def put(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return put


def root(name: str, query: Builder, columns: str, sql: str) -> None:
    """A query's root rows, the named columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        planned = plan_query(schema(), query.query)
        return lv.root_rows(planned, tables(spark, sf_dir)).select(*columns.split())

    register(name, sql)(run)


def level(name: str, query: Builder, path: tuple[str, ...], columns: str, sql: str) -> None:
    """The rows of one include level."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        planned = plan_query(schema(), query.query)
        return lv.level_rows(planned, tables(spark, sf_dir))[path].select(*columns.split())

    register(name, sql)(run)


FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Scans and predicates
root("scan_table", q("nation"), "__key n_nationkey n_name", "SELECT '[' || n_nationkey || ']' AS __key, n_nationkey, n_name FROM nation")
root("filter_eq", q("customer").where(lambda c: c.eq("c_mktsegment", "BUILDING")), "c_custkey c_name", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
root("filter_ne", q("customer").where(lambda c: c.ne("c_mktsegment", "BUILDING")), "c_custkey", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
root("filter_ranges", q("customer").where(lambda c: c.or_(c.and_(c.gt("c_acctbal", 100), c.lte("c_acctbal", 900.5)), c.and_(c.gte("c_acctbal", 5000), c.lt("c_acctbal", 6000)))), "c_custkey c_acctbal", "SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal > 100 AND c_acctbal <= 900.5) OR (c_acctbal >= 5000 AND c_acctbal < 6000)")
root("filter_in", q("orders").where(lambda c: c.in_("o_orderpriority", ["1-URGENT", "5-LOW"])), "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
root("filter_bigint_key", q("orders").where(lambda c: c.in_("o_orderkey", ["7", "11", "99999999"])), "o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 11, 99999999)")
root("filter_datetime", q("orders").where(lambda c: c.and_(c.gte("o_orderdate", "1997-01-01 00:00:00"), c.lt("o_orderdate", "1998-01-01 00:00:00"))), "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
root("filter_like", q("part").where(lambda c: c.like("p_name", "%RED_wid%")), "p_partkey p_name", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red_wid%'")
root("filter_json_like", q("events").where(lambda c: c.like("props", '%"K": 6_%')), "event_id", "SELECT event_id FROM events WHERE lower(props) LIKE '%\"k\": 6_%'")
root("filter_not", q("customer").where(lambda c: c.not_(c.or_(c.eq("c_nationkey", 3), c.lt("c_acctbal", 0)))), "c_custkey", "SELECT c_custkey FROM customer WHERE NOT (c_nationkey = 3 OR c_acctbal < 0)")
root("filter_empty_and_or", q("nation").where(lambda c: c.or_(c.and_(), c.or_())), "n_nationkey", "SELECT n_nationkey FROM nation")
root("filter_empty_or", q("nation").where(lambda c: c.or_()), "n_nationkey", "SELECT n_nationkey FROM nation WHERE false")
root("derived_column", q("customer").where(lambda c: c.eq("is_machine", True)), "c_custkey is_machine", "SELECT c_custkey, true AS is_machine FROM customer WHERE starts_with(c_mktsegment, 'MACH')")

# Semi and anti joins
rich = "SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000"
root("exists", q("customer").where(lambda c: c.exists("orders", lambda o: o.gt("o_totalprice", 400000))), "c_custkey", f"SELECT c_custkey FROM customer c WHERE EXISTS ({rich})")
root("not_exists", q("customer").where(lambda c: c.not_exists("orders", lambda o: o.gt("o_totalprice", 400000))), "c_custkey", f"SELECT c_custkey FROM customer c WHERE NOT EXISTS ({rich})")
root("not_exists_plain", q("orders").where(lambda c: c.not_exists("lines")), "o_orderkey", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
root("exists_nested", q("customer").where(lambda c: c.exists("orders", lambda o: o.and_(o.eq("o_orderstatus", "F"), o.exists("lines", lambda x: x.gt("l_quantity", 49))))), "c_custkey", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49))")
root("exists_three_deep", q("nation").where(lambda c: c.exists("customers", lambda k: k.exists("orders", lambda o: o.exists("lines", lambda x: x.and_(x.eq("l_returnflag", "R"), x.gt("l_extendedprice", 99000)))))), "n_nationkey", "SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_extendedprice > 99000)))")
root("exists_under_or", q("customer").where(lambda c: c.or_(c.lt("c_acctbal", -900), c.exists("orders", lambda o: o.gt("o_totalprice", 490000)))), "c_custkey", "SELECT c_custkey FROM customer c WHERE c_acctbal < -900 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 490000)")
root("exists_not_nested", q("orders").where(lambda c: c.and_(c.eq("o_orderstatus", "O"), c.not_exists("lines", lambda x: x.exists("part", lambda p: p.gt("p_size", 25))))), "o_orderkey", "SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 25))")

# Orders and limits
FLAGSHIP = q("customer").where(lambda c: c.and_(c.eq("c_mktsegment", "BUILDING"), c.exists("orders", lambda o: o.gt("o_totalprice", 300000)))).order_by("c_acctbal", "desc").limit(50)
root("exists_ordered_limited", FLAGSHIP, "c_custkey c_name c_acctbal", "SELECT c_custkey, c_name, c_acctbal FROM customer c WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
root("order_ties", q("orders").order_by("o_orderpriority").order_by("o_orderdate", "desc").limit(100), "o_orderkey", f"SELECT o_orderkey FROM orders ORDER BY {FOLD.format('o_orderpriority')}, o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 100")
root("order_folded", q("conversations").where(lambda c: c.eq("turn", "0")).order_by("text").limit(60), "conv_id turn", f"SELECT conv_id, turn FROM conversations WHERE turn = 0 ORDER BY {FOLD.format('text')}, text, conv_id, turn LIMIT 60")

# Include levels
WITH_ORDERS = q("customer").where(lambda c: c.gt("c_acctbal", 9000)).include("orders", lambda i: i.where(lambda o: o.eq("o_orderstatus", "F")).include("lines", lambda x: x.include("part"))).include("nation", lambda i: i.include("region"))
C9, O9 = "SELECT c_custkey FROM customer WHERE c_acctbal > 9000", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)"
level("include_many", WITH_ORDERS, ("orders",), "o_orderkey o_custkey", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN ({C9})")
level("include_one", WITH_ORDERS, ("nation",), "n_nationkey", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
level("include_nested", WITH_ORDERS, ("orders", "lines"), "l_orderkey l_linenumber l_partkey l_suppkey", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN ({O9})")
level("include_three_deep", WITH_ORDERS, ("orders", "lines", "part"), "p_partkey p_name", f"SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN ({O9}))")
level("include_exists_filter", q("nation").where(lambda c: c.lt("n_nationkey", 5)).include("customers", lambda i: i.where(lambda c: c.exists("orders", lambda o: o.gt("o_totalprice", 480000)))), ("customers",), "c_custkey", "SELECT c_custkey FROM customer c WHERE c_nationkey < 5 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 480000)")
level("include_composite_self", q("conversations").where(lambda c: c.eq("role", "user")).include("self"), ("self",), "conv_id turn", "SELECT conv_id, turn FROM conversations WHERE role = 'user'")
level("include_of_limited", FLAGSHIP.include("orders"), ("orders",), "o_orderkey o_custkey", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer c WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) ORDER BY c_acctbal DESC, c_custkey LIMIT 50)")

MEMBERS = f"""
SELECT '' AS path, 'customer' AS tbl, '["' || c_custkey || '"]' AS __key FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT 'orders', 'orders', '["' || o_orderkey || '"]' FROM orders WHERE o_orderkey IN ({O9})
UNION ALL SELECT 'orders/lines', 'lineitem', '["' || l_orderkey || '",' || l_linenumber || ',"' || l_partkey || '","' || l_suppkey || '"]' FROM lineitem WHERE l_orderkey IN ({O9})
UNION ALL SELECT 'orders/lines/part', 'part', '["' || p_partkey || '"]' FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN ({O9}))
UNION ALL SELECT 'nation', 'nation', '[' || n_nationkey || ']' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)
UNION ALL SELECT 'nation/region', 'region', '[' || r_regionkey || ']' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000))
"""


@register("membership", MEMBERS)
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lv.recompute(plan_query(schema(), WITH_ORDERS.query), tables(spark, sf_dir))


@register("membership_seen", f"SELECT DISTINCT tbl, __key FROM ({MEMBERS})")
def membership_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lv.seen(membership(spark, sf_dir))


@register("nested_sizes", """
SELECT c_custkey, n_name AS nation, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') AS n_orders,
  (SELECT count(*) FROM orders o JOIN lineitem l ON l_orderkey = o_orderkey WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') AS n_lines
FROM customer c JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000
""")  # fmt: skip
def nested_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_query(schema(), WITH_ORDERS.query)
    rows = lv.nested(planned, lv.level_rows(planned, tables(spark, sf_dir)))
    lines = F.aggregate(F.transform("$orders", lambda o: F.size(o["$lines"])), F.lit(0), lambda a, x: a + x)
    return rows.select("c_custkey", F.col("$nation.n_name").alias("nation"), F.size("$orders").cast("long").alias("n_orders"), lines.cast("long").alias("n_lines"))


@register("window_growth", "SELECT '[\"' || o_orderkey || '\"]' AS __key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n > 20 AND n <= 60")
def window_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    small, large = (lv.seen(lv.recompute(plan_query(schema(), q("orders").order_by("o_totalprice", "desc").limit(n).query), t)) for n in (20, 60))
    return lv.grown(small, large).select(KEY)


@register("rows_by_columns", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def rows_by_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return by_columns(t["orders"], ("o_custkey",), t["customer"].where("c_nationkey = 7").select("c_custkey")).select("o_orderkey", "o_custkey")


@register("chain_candidates", "SELECT '[\"' || c_custkey || '\"]' AS __key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R'))")
def chain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = tables(spark, sf_dir), schema()
    way = (s.table("customer").relation("orders"), s.table("orders").relation("lines"))
    return mt.reaching(t, s.table("customer"), way, t["lineitem"].where("l_quantity = 50 and l_returnflag = 'R'"), s)


@register("snapshot_chunks", "SELECT chunk, count(*) AS n, min(__key) AS first_key, max(__key) AS last_key FROM (SELECT __key, (row_number() OVER (ORDER BY __key) - 1) // 500 AS chunk FROM (SELECT '[\"' || c_custkey || '\"]' AS __key FROM customer)) GROUP BY chunk")
def snapshot_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lv.chunks(tables(spark, sf_dir)["customer"].select(KEY)).groupBy("chunk").agg(F.count("*").alias("n"), F.min(KEY).alias("first_key"), F.max(KEY).alias("last_key"))


@register("client_projection", "SELECT '[\"' || c_custkey || '\"]' AS __key, c_name FROM customer")
def client_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(tables(spark, sf_dir)["customer"], ["c_name", "unknown"])


@register("fill_direct", "SELECT c_custkey FROM customer WHERE c_nationkey = 4")
def fill_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.filled(tables(spark, sf_dir)["customer"], schema().table("customer"), "4").select("c_custkey")


@register("fill_derived", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)")
def fill_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return ch.filled(t["orders"], schema().table("orders"), "4", t["customer"], schema().table("customer")).select("o_orderkey")


# Changes: of customers, every tenth (key 3) moves to the next nation, every tenth (key 7) is deleted, and every tenth (key 9) was inserted with twice its balance.
def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"]
    last = F.col("c_custkey") % 10
    cells = [F.col(x) for x in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]
    old = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("c_custkey"), *cells))
    moved = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("c_custkey"), F.col("c_name"), ((F.col("c_nationkey") + 1) % 25).alias("c_nationkey"), F.col("c_acctbal"), F.col("c_mktsegment")))
    richer = F.to_json(F.struct((F.col("c_custkey") + 1_000_000_000).cast("string").alias("c_custkey"), F.col("c_name"), F.col("c_nationkey"), (F.col("c_acctbal") * 2).alias("c_acctbal"), F.col("c_mktsegment")))
    none = F.lit(None).cast("string")
    op = F.when(last == 3, "update").when(last == 7, "delete").otherwise("insert")
    rows = c.where(last.isin(3, 7, 9)).select(
        F.floor(F.col("c_custkey") / 100).cast("long").alias("stream_index"), F.lit("g").alias("gtid"), F.col("c_custkey").cast("int").alias("ord"), F.lit("customer").alias("tbl"), op.alias("op"),
        F.when(last == 9, none).otherwise(old).alias("before"), F.when(last == 3, moved).when(last == 9, richer).otherwise(none).alias("after"),
    )
    return rows


ROUTED = """
WITH ch AS (SELECT c_custkey // 100 AS stream_index, c_custkey AS k, c_custkey % 10 AS d, c_nationkey AS n FROM customer WHERE c_custkey % 10 IN (3, 7, 9)),
routed AS (
  SELECT stream_index, CAST(n AS VARCHAR) AS partition, k AS ord, 0 AS turn, 'delete' AS op, '["' || k || '"]' AS key FROM ch WHERE d IN (3, 7)
  UNION ALL SELECT stream_index, CAST((n + 1) % 25 AS VARCHAR), k, 1, 'insert', '["' || k || '"]' FROM ch WHERE d = 3
  UNION ALL SELECT stream_index, CAST(n AS VARCHAR), k, 0, 'insert', '["' || (k + 1000000000) || '"]' FROM ch WHERE d = 9
)
"""


@register("route_moves", ROUTED + "SELECT stream_index, partition, ord, turn, op, key FROM routed")
def route_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.route(customer_changes(spark, sf_dir), schema()).select("stream_index", "partition", F.col("ord").cast("long").alias("ord"), "turn", "op", "key")


@register("route_counts", "SELECT CASE WHEN c_custkey % 10 = 3 THEN 'moved' ELSE 'routed' END AS outcome, count(*) AS changes FROM customer WHERE c_custkey % 10 IN (3, 7, 9) GROUP BY 1")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.counters(ch.route(customer_changes(spark, sf_dir), schema()))


@register("sequence_numbers", ROUTED + "SELECT DISTINCT partition, stream_index, dense_rank() OVER (PARTITION BY partition ORDER BY stream_index) AS seq FROM routed")
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.sequence(ch.route(customer_changes(spark, sf_dir), schema())).select("partition", "stream_index", "seq").distinct()


@register("route_derived", "SELECT o_orderkey, CAST(c_nationkey AS VARCHAR) AS partition FROM orders JOIN customer ON c_custkey = o_custkey")
def route_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    index = t["customer"].select(F.lit("customer").alias("tbl"), F.col("c_custkey").cast("string").alias("parent_key"), F.col("c_nationkey").cast("string").alias("partition"))
    after = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey")))
    rows = t["orders"].select(F.col("o_orderkey").alias("stream_index"), F.lit("g").alias("gtid"), F.lit(0).alias("ord"), F.lit("orders").alias("tbl"), F.lit("insert").alias("op"), F.lit(None).cast("string").alias("before"), after.alias("after"))
    return ch.route(rows, schema(), index).select(F.col("stream_index").alias("o_orderkey"), "partition")


@register("last_image_fold", "SELECT '[\"' || user_id || '\"]' AS __key, min_by(value, event_id) AS first_value, max_by(value, event_id) AS last_value FROM events GROUP BY user_id")
def last_image_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    rows = e.select(F.lit("users").alias("tbl"), F.concat(F.lit('["'), "user_id", F.lit('"]')).alias("key"), F.col("value").alias("before"), F.col("value").alias("after"), "event_id")
    return ch.folded(rows, ["event_id"]).select(KEY, F.col("before").alias("first_value"), F.col("after").alias("last_value"))


AFTER = """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 3 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 7
UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal * 2, c_mktsegment FROM customer WHERE c_custkey % 10 = 9
"""


def changed(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    before = tables(spark, sf_dir)
    by_table = ch.images_by_table(customer_changes(spark, sf_dir).withColumn("key", F.lit(None).cast("string")), schema(), ["stream_index", "ord"], before, {"customer"})
    by_table = {"customer": cut(by_table["customer"])}
    return before, by_table, mt.apply_changes(before, by_table)


@register("applied_changes", AFTER)
def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir)[2]["customer"].select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def delta_of(name: str, query: Builder, before_sql: str, after_sql: str) -> None:
    """What the changes do to a query, by maintenance, against two evaluations."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        planned = plan_query(schema(), query.query)
        before, by_table, after = changed(spark, sf_dir)
        members = mt.FrameMembers(cut(lv.recompute(planned, before)))
        moves = mt.affected(planned, members, after, by_table)
        return mt.changed_rows(spark, mt.entered_and_left(planned, members, moves, spark))

    sql = f"""
    WITH a AS ({AFTER}), old AS ({before_sql}), new AS ({after_sql})
    SELECT tbl, __key, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old)
    UNION ALL SELECT tbl, __key, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)
    """
    register(name, sql)(run)


def key(table: str, column: str) -> str:
    return f"'{table}' AS tbl, '[\"' || {column} || '\"]' AS __key"


delta_of("maintain_filter", q("customer").where(lambda c: c.and_(c.gt("c_acctbal", 5000), c.lt("c_nationkey", 10))), *(f"SELECT {key('customer', 'c_custkey')} FROM {t} WHERE c_acctbal > 5000 AND c_nationkey < 10" for t in ("customer", "a")))
delta_of("maintain_window", q("customer").order_by("c_acctbal", "desc").limit(40), *(f"SELECT * FROM (SELECT {key('customer', 'c_custkey')} FROM {t} ORDER BY c_acctbal DESC, c_custkey LIMIT 40)" for t in ("customer", "a")))
delta_of("maintain_exists", q("orders").where(lambda o: o.and_(o.gt("o_totalprice", 450000), o.exists("customer", lambda c: c.lt("c_nationkey", 5)))), *(f"SELECT {key('orders', 'o_orderkey')} FROM orders WHERE o_totalprice > 450000 AND o_custkey IN (SELECT c_custkey FROM {t} WHERE c_nationkey < 5)" for t in ("customer", "a")))
delta_of("maintain_include", q("customer").where(lambda c: c.and_(c.lt("c_nationkey", 3), c.gt("c_acctbal", 0))).include("orders"), *(f"SELECT {key('customer', 'c_custkey')} FROM {t} WHERE c_nationkey < 3 AND c_acctbal > 0 UNION SELECT {key('orders', 'o_orderkey')} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM {t} WHERE c_nationkey < 3 AND c_acctbal > 0)" for t in ("customer", "a")))
delta_of("maintain_include_exists", q("nation").where(lambda c: c.lt("n_nationkey", 20)).include("customers", lambda i: i.where(lambda c: c.and_(c.gt("c_acctbal", 8000), c.exists("orders", lambda o: o.gt("o_totalprice", 300000))))), *(f"SELECT 'nation' AS tbl, '[' || n_nationkey || ']' AS __key FROM nation WHERE n_nationkey < 20 UNION SELECT {key('customer', 'c_custkey')} FROM {t} WHERE c_nationkey < 20 AND c_acctbal > 8000 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)" for t in ("customer", "a")))


@register("row_updates", "SELECT '[\"' || c_custkey || '\"]' AS __key, c_custkey % 10 = 7 AS deleted FROM customer WHERE c_custkey % 10 = 7 OR (c_custkey % 10 = 3 AND c_acctbal > 5000) UNION ALL SELECT '[\"' || (c_custkey + 1000000000) || '\"]', false FROM customer WHERE c_custkey % 10 = 9 AND c_acctbal * 2 > 5000")
def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_query(schema(), q("customer").where(lambda c: c.gt("c_acctbal", 5000)).query)
    before, by_table, after = changed(spark, sf_dir)
    members = mt.FrameMembers(cut(lv.recompute(planned, before)))
    moves = mt.affected(planned, members, after, by_table)
    entered = {n: added for n, (added, _) in mt.entered_and_left(planned, members, moves, spark).items()}
    sent = mt.row_updates(by_table, entered, {"customer": moves[()].now & KeySet.of(by_table["customer"])}, after)
    return sent["customer"].select(KEY, F.col("image").isNull().alias("deleted"))


@register("overlay_view", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 7 UNION ALL SELECT c_custkey + 1000000000, c_acctbal FROM customer WHERE c_custkey % 10 = 9")
def overlay_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"]
    last = F.col("c_custkey") % 10
    rows = c.where(last.isin(3, 7, 9)).withColumn("__op", F.when(last == 7, "delete").otherwise("upsert")).withColumn("c_acctbal", F.when(last == 3, 0.0).otherwise(F.col("c_acctbal")))
    rows = rows.withColumn("c_custkey", F.when(last == 9, F.col("c_custkey") + 1_000_000_000).otherwise(F.col("c_custkey"))).withColumn(KEY, F.concat(F.lit('["'), "c_custkey", F.lit('"]')))
    return ov.overlay_view(c, rows).select("c_custkey", "c_acctbal")


@register("deduplicated_batch", "SELECT 'p' AS partition, event_id + 1 AS seq, CASE WHEN event_id >= 300 THEN 'new' WHEN (event_id + 1) % 50 = 0 THEN 'conflict' ELSE 'duplicate' END AS status FROM events")
def deduplicated_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"].select(F.lit("p").alias("partition"), (F.col("event_id") + 1).alias("seq"), F.concat(F.lit("g"), F.col("event_id") + 1).alias("gtid"))
    applied = spark.createDataFrame([("p", 300)], "partition string, seq long")
    log = e.where("seq <= 300").withColumn("gtid", F.when(F.col("seq") % 50 == 0, "other").otherwise(F.col("gtid")))
    return ch.deduplicated(e, applied, log).select("partition", "seq", "status")


@register("replay_after_fill", "SELECT event_id FROM events WHERE NOT (event_id BETWEEN 1 AND 100 OR event_id BETWEEN 150 AND 180)")
def replay_after_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    uuid = "a2523813-adbe-11f1-b19c-0a2250a7ed6c"
    held = tables(spark, sf_dir)["events"].select("event_id", F.concat(F.lit(f"{uuid}:"), "event_id").alias("gtid"))
    return ch.replayable(held, f"MySQL56/{uuid}:1-100:150-180").select("event_id")


@register("normalized_cells", "SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'A' ELSE 'B' END AS e, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE 'x,y' END AS s, o_orderkey % 2 = 1 AS flag FROM orders")
def normalized_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table("t", ("o_orderkey",), (Column("o_orderkey", "bigint"), Column("price", "float"), Column("e", "string", source_type="enum('A','B')"), Column("s", "string", source_type="set('x','y')"), Column("flag", "bool")))
    o = tables(spark, sf_dir)["orders"]
    text = o.select(*(c.cast("string").alias(n) for n, c in (("o_orderkey", F.col("o_orderkey")), ("price", F.col("o_totalprice")), ("e", F.col("o_orderkey") % 3), ("s", F.col("o_orderkey") % 4), ("flag", F.col("o_orderkey") % 2))))
    return ch.normalize(text, t).where("size(bad) = 0").drop("bad")


@register("fanout_index", """
WITH a AS (SELECT '["' || c_custkey || '"]' AS __key, 'segment' AS s FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT '["' || c_custkey || '"]', 'rich' FROM customer WHERE c_acctbal > 9000)
SELECT 'customer' AS tbl, __key, string_agg(s, ',' ORDER BY s) AS subscriptions FROM a GROUP BY __key
""")  # fmt: skip
def fanout_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    wanted = {"segment": q("customer").where(lambda c: c.eq("c_mktsegment", "BUILDING")), "rich": q("customer").where(lambda c: c.gt("c_acctbal", 9000))}
    members = {k: lv.seen(lv.recompute(plan_query(schema(), b.query), t)) for k, b in wanted.items()}
    return rp.membership_index(members).select("tbl", KEY, F.array_join("subscriptions", ",").alias("subscriptions"))


@register("parent_index", "SELECT 'customer' AS tbl, CAST(c_custkey AS VARCHAR) AS parent_key, CAST(c_nationkey AS VARCHAR) AS partition FROM customer")
def parent_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.parent_index(tables(spark, sf_dir)["customer"], schema().table("customer"))


@register("assembled_transactions", "SELECT user_id AS shard, event_id // 50 AS tx, count(*) AS changes, min(event_id) AS first_event FROM events WHERE (event_id // 50) % 9 <> 4 GROUP BY 1, 2")
def assembled_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in transactions of fifty ids by user, every ninth of them rolled back."""
    e = tables(spark, sf_dir)["events"].select(F.col("user_id").cast("string").alias("shard"), "event_id", F.floor(F.col("event_id") / 50).cast("long").alias("tx"))
    none = F.lit(None).cast("string")
    row = e.select("shard", (F.col("event_id") * 10).alias("ord"), F.lit("row").alias("type"), F.lit("events").alias("tbl"), none.alias("before"), F.col("event_id").cast("string").alias("after"), none.alias("position"), F.lit(None).cast("long").alias("timestamp"))
    each = e.select("shard", "tx").distinct()

    def mark(kind, offset: int) -> DataFrame:
        return each.select("shard", (F.col("tx") * 500 + offset).alias("ord"), kind.alias("type"), none.alias("tbl"), none.alias("before"), none.alias("after"), none.alias("position"), F.col("tx").alias("timestamp"))

    events = row.unionByName(mark(F.lit("begin"), -1)).unionByName(mark(F.when(F.col("tx") % 9 == 4, "rollback").otherwise("commit"), 495))
    got = ch.assemble(events)
    return got.select(F.col("shard").cast("long").alias("shard"), F.col("commit_timestamp").alias("tx"), F.size("changes").cast("long").alias("changes"), F.element_at("changes", 1)["after"].cast("long").alias("first_event"))


def queries() -> dict[str, Run]:
    from viewtide import live_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in queries() if name in SQL}
