"""Logical tables of the engine, and the stand-ins that map the star-schema tables onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import callset as cs
from quadloom.runtime import table

CALL_SCHEMA = "call_no bigint, thread_id bigint, name string, args string, ts timestamp_ntz, value double, k bigint, flags int"
# fixed values: which event stands for which class of call
EVENT_FLAGS = {"purchase": cs.END_FRAME, "click": cs.RENDER, "signup": cs.SWAP_RENDERTARGET, "view": cs.VERBOSE}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a call: events in the order of their ids."""
    e = table(spark, sf_dir, "events")
    flags = F.coalesce(F.create_map(*[x for k, v in EVENT_FLAGS.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")], F.lit(0))
    return e.select(
        F.col("event_id").alias("call_no"), F.col("user_id").alias("thread_id"), F.col("event_type").alias("name"), F.col("props").alias("args"), "ts", "value",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), flags.alias("flags"),
    )


CALLS_SQL = """calls as (select event_id as call_no, user_id as thread_id, event_type as name, props as args, ts, value,
  try_cast(json_extract_string(props, '$.k') as bigint) as k,
  case event_type when 'purchase' then 32 when 'click' then 8 when 'signup' then 16 when 'view' then 128 else 0 end as flags from events)"""


def cells(spark: SparkSession, sf_dir: str, first_only: bool = True) -> DataFrame:
    """Matrix cells: a matrix an order, a tile a part, rows in line order; the first cell of a tile unless raw."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    raw = li.select(
        F.col("l_orderkey").alias("matrix_id"), F.col("l_partkey").alias("tile_id"), (F.row_number().over(w) - 1).alias("i"), (F.col("l_suppkey") % 8).cast("int").alias("j"),
    )
    if not first_only:
        return raw
    first = Window.partitionBy("matrix_id", "tile_id").orderBy("i")
    return raw.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


CELLS_SQL = """raw_cells as (select l_orderkey as matrix_id, l_partkey as tile_id,
  (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1)::int as i, (l_suppkey % 8)::int as j from lineitem),
cells as (select matrix_id, tile_id, i, j from (select *, row_number() over (partition by matrix_id, tile_id order by i) as rn from raw_cells) where rn = 1)"""


def uncle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-ary forest: part p hangs below p div 4 in direction p mod 4."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("tile_id"), F.expr("p_partkey div 4").alias("uncle_id"), (F.col("p_partkey") % 4).cast("int").alias("direction"))


UNCLES_SQL = "edges as (select p_partkey as tile_id, p_partkey // 4 as uncle_id, (p_partkey % 4)::int as direction from part)"


def quadkey_of(number: str):
    """Root marker and the number's base-4 digits; 0 is the root itself."""
    return F.concat(F.lit("0"), F.when(F.col(number) > 0, F.conv(F.col(number).cast("string"), 10, 4)).otherwise(""))


def pyramid(spark: SparkSession, sf_dir: str, delta: bool = False) -> DataFrame:
    """Tiles of a destination pyramid (customers by key in base 4), or of a shifted, partly changed delta."""
    c = table(spark, sf_dir, "customer")
    key = quadkey_of("c_custkey")
    base = c.select(F.col("c_custkey").alias("tile_no"), key.alias("quadkey"), F.col("c_name").alias("content"), F.round("c_acctbal", 2).alias("score"), F.col("c_mktsegment").alias("segment"))
    if not delta:
        return base.filter("tile_no % 7 <> 0")
    changed = F.col("tile_no") % 5 == 0
    return base.filter("tile_no % 3 <> 1").select(
        "tile_no", "quadkey", F.when(changed, F.concat("content", F.lit("*"))).otherwise(F.col("content")).alias("content"),
        F.when(changed & (F.col("tile_no") % 2 == 0), F.col("score") + 0.02).when(changed, F.col("score") + 10).otherwise(F.col("score")).alias("score"), "segment",
    )


PYRAMID_SQL = """digits(n, rest, key) as (select c_custkey, c_custkey, '' from customer union all select n, rest // 4, (rest % 4)::varchar || key from digits where rest > 0),
base as (select c.c_custkey as tile_no, '0' || d.key as quadkey, c.c_name as content, round(c.c_acctbal, 2) as score, c.c_mktsegment as segment from customer c join digits d on d.n = c.c_custkey and d.rest = 0),
dest as (select * from base where tile_no % 7 <> 0),
delta as (select tile_no, quadkey, case when tile_no % 5 = 0 then content || '*' else content end as content,
  case when tile_no % 5 = 0 and tile_no % 2 = 0 then score + 0.02 when tile_no % 5 = 0 then score + 10 else score end as score, segment from base where tile_no % 3 <> 1)"""
