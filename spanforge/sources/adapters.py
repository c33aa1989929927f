"""The star-schema tables as traces, brackets, logs and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a thread: (tid, pos, kind, state, name, raw)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tid"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.lit("SYS").alias("kind"), F.lit(None).cast("string").alias("state"),
        F.col("event_type").alias("name"), F.concat("event_type", F.lit("("), F.col("event_id").cast("string"), F.lit(") = 0")).alias("raw"),
    )


def trace_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as a thread: a bracket for each year, in it one for each order, in that its lines' flags."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.concat(F.lit("pkg.Order."), F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]", ""), F.lit("()")).alias("api"), F.year("o_orderdate").alias("yr"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat("l_returnflag", "l_linestatus").alias("flag"))
    none = F.lit(0).cast("long")
    zero = F.lit(0.0)
    start = lambda phase, state: orders.select(F.col("o_custkey").alias("tid"), "yr", F.lit(1).alias("part"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("ok"), F.lit(phase).alias("phase"), none.alias("k1"), none.alias("k2"), none.alias("k3"), zero.alias("k4"), F.lit("API").alias("kind"), F.lit(state).alias("state"), F.col("api").alias("name"))
    inner = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.col("o_custkey").alias("tid"), "yr", F.lit(1).alias("part"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("ok"), F.lit(2).alias("phase"), F.col("l_linenumber").cast("long").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"), F.col("l_extendedprice").alias("k4"),
        F.lit("SYS").alias("kind"), F.lit(None).cast("string").alias("state"), F.col("flag").alias("name"),
    )
    years = orders.select("o_custkey", "yr").distinct()
    year = lambda part, state: years.select(F.col("o_custkey").alias("tid"), "yr", F.lit(part).alias("part"), F.lit(None).cast("timestamp_ntz").alias("at"), none.alias("ok"), F.lit(0).alias("phase"), none.alias("k1"), none.alias("k2"), none.alias("k3"), zero.alias("k4"), F.lit("API").alias("kind"), F.lit(state).alias("state"), F.concat(F.lit("pkg.Year.y"), F.col("yr").cast("string"), F.lit("()")).alias("name"))
    rows = year(0, "S").unionByName(start(1, "S")).unionByName(inner).unionByName(start(3, "E")).unionByName(year(2, "E"))
    order = Window.partitionBy("tid").orderBy("yr", "part", "at", "ok", "phase", "k1", "k2", "k3", "k4")
    return rows.select("tid", (F.row_number().over(order) - 1).cast("long").alias("pos"), "kind", "state", "name", F.col("name").alias("raw"))


def kb_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a realization of its priority: (api, rid, calls). Orders without lines have no calls."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("pkg.Order."), F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]", ""), F.lit("()")).alias("api"))
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat("l_returnflag", "l_linestatus").alias("flag"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: F.struct(F.lit("SYS").alias("kind"), x["flag"].alias("name"))).alias("calls"))
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    return joined.select("api", F.col("o_orderkey").alias("rid"), F.coalesce("calls", F.array().cast("array<struct<kind:string,name:string>>")).alias("calls"))


def kb_graph(spark: SparkSession, sf_dir: str, acyclic: bool = False) -> DataFrame:
    """Every supplier as a realization (api, rid, calls) that may call another API, then an event.

    Keys deal suppliers to 41 APIs and pick callees, of which some have no realization. The graph has cycles; acyclic
    keeps calls to APIs of a higher number only.
    """
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 41).alias("src"), (F.col("s_suppkey") * 7 % 47).alias("dst"))
    has_call = (F.col("s_suppkey") % 3 != 0) & (F.col("s_suppkey") % 7 != 0)
    if acyclic:
        has_call = has_call & (F.col("dst") > F.col("src"))
    has_event = F.col("s_suppkey") % 5 < 2
    call = F.struct(F.lit("API").alias("kind"), F.concat(F.lit("api"), F.col("dst").cast("string")).alias("name"))
    event = F.struct(F.lit("SYS").alias("kind"), F.when(F.col("s_suppkey") % 2 == 0, "read").otherwise("write").alias("name"))
    calls = F.filter(F.array(F.when(has_call, call), F.when(has_event, event)), lambda c: c.isNotNull())
    return s.select(F.concat(F.lit("api"), F.col("src").cast("string")).alias("api"), F.col("s_suppkey").alias("rid"), calls.alias("calls"))


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as typed text lines: purchases are a call's start, signups its end, others low-level events."""
    e = table(spark, sf_dir, "events")
    ts = F.concat(F.col("event_id").cast("string"), F.lit(".500000"))
    state = F.when(F.col("event_type") == "purchase", "S").when(F.col("event_type") == "signup", "E")
    api = F.concat(F.lit("pkg.User.u"), (F.col("user_id") % 10).cast("string"), F.lit("(java.lang.String, int)"))
    call = F.concat_ws(" ", ts, F.lit("JAVA"), F.col("user_id").cast("string"), state, api)
    event = F.concat_ws(" ", ts, F.lit("SYSCALL"), F.col("user_id").cast("string"), F.concat("event_type", F.lit("("), F.col("event_id").cast("string"), F.lit(", 0) = 0")))
    return e.select(F.when(state.isNotNull(), call).otherwise(event).alias("value"))
