"""Queries on quadkeys and pyramids (customers as tiles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadloom.functions import quadkey as qk
from quadloom.model import PYRAMID_SQL, pyramid, quadkey_of
from quadloom.operators import pyramid as py
from quadloom.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# column and row by a fold over the digits
_DEC = """dec as (select quadkey, tile_no, length(quadkey) - 1 as d,
  coalesce(list_sum([((quadkey[i + 2]) in ('1', '2'))::bigint << (length(quadkey) - 2 - i) for i in range(0, length(quadkey) - 1)]), 0)::bigint as col,
  coalesce(list_sum([((quadkey[i + 2]) in ('2', '3'))::bigint << (length(quadkey) - 2 - i) for i in range(0, length(quadkey) - 1)]), 0)::bigint as row from base)"""


@query("qk1_decode", f"with recursive {PYRAMID_SQL}, {_DEC} select quadkey, d::int as tile_depth, col, row as south_row from dec")
def qk1(spark, d):
    return pyramid_all(spark, d).select("quadkey", qk.depth(F.col("quadkey")).alias("tile_depth"), qk.column(F.col("quadkey")).alias("col"), qk.south_row(F.col("quadkey")).alias("south_row"))


def pyramid_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("tile_no"), quadkey_of("c_custkey").alias("quadkey"))


@query("qk1_encode_inverse", f"with recursive {PYRAMID_SQL} select quadkey, quadkey as again from base")
def qk1b(spark, d):
    return pyramid_all(spark, d).select("quadkey", qk.encode(qk.depth(F.col("quadkey")), qk.column(F.col("quadkey")), qk.south_row(F.col("quadkey"))).alias("again"))


@query("qk2_bounds", f"with recursive {PYRAMID_SQL}, {_DEC} select quadkey, col * (360.0::double / (1 << d)) - 180 as lon, row * (180.0::double / (1 << d)) - 90 as lat from dec")
def qk2(spark, d):
    return pyramid_all(spark, d).select("quadkey", qk.lon(F.col("quadkey")).alias("lon"), qk.lat(F.col("quadkey")).alias("lat"))


@query("qk3_child_append", f"with recursive {PYRAMID_SQL} select quadkey, quadkey || case tile_no % 4 when 0 then '0' when 1 then '1' when 2 then '2' else '3' end as child from base")
def qk3(spark, d):
    names = F.array(*[F.lit(x) for x in ("WEST_SOUTH", "SOUTH_EAST", "EAST_NORTH", "NORTH_WEST")])
    return pyramid_all(spark, d).select("quadkey", qk.child(F.col("quadkey"), F.element_at(names, (F.col("tile_no") % 4 + 1).cast("int"))).alias("child"))


@query("qk4_ancestors", f"with recursive {PYRAMID_SQL} select quadkey, left(quadkey, n::int) as ancestor, (n - 1)::int as ancestor_depth from base, unnest(range(1, length(quadkey))) as t(n)")
def qk4(spark, d):
    return pyramid_all(spark, d).select("quadkey", F.explode(qk.ancestors(F.col("quadkey"))).alias("ancestor")).withColumn("ancestor_depth", qk.depth(F.col("ancestor")))


@query("qk5_node_bounds", f"""with recursive {PYRAMID_SQL}, {_DEC}, r as (select quadkey, d, col, row, case when length(quadkey) > 2 then 2 else length(quadkey) - 1 end as ad from dec)
  select quadkey, col::double / (1 << d) as x0, row::double / (1 << d) as y0, (col - ((col >> (d - ad)) << (d - ad)))::double / (1 << (d - ad)) as rel_x0, (row - ((row >> (d - ad)) << (d - ad)))::double / (1 << (d - ad)) as rel_y0 from r""")
def qk5(spark, d):
    n = F.pow(F.lit(2.0), qk.depth(F.col("quadkey")))
    down = F.pow(F.lit(2), qk.depth(F.col("quadkey")) - F.least(qk.depth(F.col("quadkey")), F.lit(2))).cast("bigint")
    rel = lambda c: F.pmod(c, down) / down
    return pyramid_all(spark, d).select("quadkey", (qk.column(F.col("quadkey")) / n).alias("x0"), (qk.south_row(F.col("quadkey")) / n).alias("y0"), rel(qk.column(F.col("quadkey"))).alias("rel_x0"), rel(qk.south_row(F.col("quadkey"))).alias("rel_y0"))


@query("qk6_layout_path", f"""with recursive {PYRAMID_SQL} select quadkey, regexp_replace(substr(quadkey, 2), '(.)', '\\1/', 'g') || quadkey || '.png' as digit_path,
  coalesce(list_aggregate([left(quadkey, i::int) || '/' for i in range(2, length(quadkey) + 1)], 'string_agg', ''), '') || quadkey || '.png' as cumulative_path, case when length(quadkey) = 1 then 'digit' else 'cumulative' end as layout from base""")
def qk6(spark, d):
    return pyramid_all(spark, d).select("quadkey", qk.digit_path(F.col("quadkey")).alias("digit_path"), qk.cumulative_path(F.col("quadkey")).alias("cumulative_path"), qk.layout_of(qk.cumulative_path(F.col("quadkey")), F.col("quadkey")).alias("layout"))


@query("qk7_subtree", f"with recursive {PYRAMID_SQL} select quadkey from base where starts_with(quadkey, '012')")
def qk7(spark, d):
    return pyramid_all(spark, d).filter(F.col("quadkey").startswith("012")).select("quadkey")


@query("qk8_source_region", f"""with recursive {PYRAMID_SQL}, {_DEC}, t as (select b.quadkey, max(length(a.quadkey)) as la from base b join dest a on starts_with(b.quadkey, a.quadkey) and length(a.quadkey) <= greatest(length(b.quadkey) - 2, 1) group by 1),
  x as (select t.quadkey, left(t.quadkey, t.la) as ancestor, d.d - (t.la - 1) as delta, d.col - ((d.col >> (d.d - t.la + 1)) << (d.d - t.la + 1)) as c, d.row - ((d.row >> (d.d - t.la + 1)) << (d.d - t.la + 1)) as r from t join dec d using (quadkey))
  select quadkey, ancestor, (c * 256 // (1 << delta))::bigint as x0, ((c + 1) * 256 // (1 << delta))::bigint as x1, (256 - (r + 1) * 256 // (1 << delta))::bigint as y0, (256 - r * 256 // (1 << delta))::bigint as y1 from x""")
def qk8(spark, d):
    near = py.nearest_ancestor(pyramid_all(spark, d), pyramid(spark, d), F.greatest(qk.depth(F.col("quadkey")) - 2, F.lit(0)))
    return py.source_region(near)


_LAYOUT_SQL = """select d::int as tile_depth, w as width, case when fit = 256 then 'NATIVE' when fit is not null then 'SCALED' else 'COVERAGE' end as mode, coalesce(fit, 1)::int as image_px, coalesce(fit + 2, 1)::int as tile_px, (fit is null and (1::bigint << least(d, 30)::int) > least(w, h)) as scrollable
  from (select d, w, h, max(s) filter ((1::bigint << least(d, 30)::int) * (s + 2) <= least(w, h)) as fit from unnest(range(0, 14)) as t(d), (values (1920, 1080), (1536, 1536)) as v(w, h), unnest([256, 128, 64, 32, 16, 8, 4, 2]) as u(s) group by all)"""


@query("qk9_level_layout", _LAYOUT_SQL)
def qk9(spark, d):
    r = spark.range(14).select(F.col("id").cast("int").alias("tile_depth"))
    a = r.select("tile_depth", F.lit(1920).alias("width"), qk.level_layout(F.col("tile_depth"), 1920, 1080).alias("l"))
    b = r.select("tile_depth", F.lit(1536).alias("width"), qk.level_layout(F.col("tile_depth"), 1536, 1536).alias("l"))
    return a.unionByName(b).select("tile_depth", "width", "l.*")


@query("qk10_grid_path", """with recursive w(r, c, lr, lc, h, wd, p) as (
  select r, c, r, c, 16, 20, '' from unnest(range(0, 16)) as a(r), unnest(range(0, 20)) as b(c)
  union all select r, c, case when lr < (h + 1) // 2 then lr else lr - (h + 1) // 2 end, case when lc < (wd + 1) // 2 then lc else lc - (wd + 1) // 2 end,
    case when lr < (h + 1) // 2 then (h + 1) // 2 else h - (h + 1) // 2 end, case when lc < (wd + 1) // 2 then (wd + 1) // 2 else wd - (wd + 1) // 2 end,
    p || case when lr < (h + 1) // 2 and lc < (wd + 1) // 2 then '0' when lr < (h + 1) // 2 then '1' when lc >= (wd + 1) // 2 then '2' else '3' end from w where h > 1 or wd > 1)
  select r as grid_row, c as grid_col, p as grid_path from w where h <= 1 and wd <= 1""")
def qk10(spark, d):
    # the grid's 320 cells are a fixed dimension
    rows = [(r, c, qk.grid_path(r, c, 16, 20)) for r in range(16) for c in range(20)]
    return spark.createDataFrame(rows, "grid_row bigint, grid_col bigint, grid_path string")


@query("qk11_unit_index", "select c_custkey, case when isnan(x) then -1 else least(floor(least(greatest(x, 0), 1) * 20)::int, 19) end as idx from (select c_custkey, case when c_custkey % 50 = 0 then 'nan'::double else c_acctbal / 10000 end as x from customer)")
def qk11(spark, d):
    x = F.when(F.col("c_custkey") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal") / 10000)
    return table(spark, d, "customer").select("c_custkey", qk.unit_index(x, F.lit(20)).alias("idx"))


@query("qk12_flip_wrap", "select c_custkey, ((1 << 6) - 1 - c_custkey % 64)::bigint as north_row, ((((c_custkey - 500) % 64) + 64) % 64)::bigint as wrapped_col from customer")
def qk12(spark, d):
    return table(spark, d, "customer").select("c_custkey", qk.flip_row(F.col("c_custkey") % 64, F.lit(6)).alias("north_row"), qk.wrap_column(F.col("c_custkey") - 500, F.lit(6)).alias("wrapped_col"))


@query("qk13_draw_selection", f"""with recursive {PYRAMID_SQL}, pick(k) as (select '0' union all select k || i from pick, unnest(['0', '1', '2', '3']) as t(i) where pow(0.25, length(k) - 1) * 100 > 0.8 and length(k) <= 12
    and exists (select 1 from base where starts_with(base.quadkey, pick.k || i)))
  select k as quadkey, exists (select 1 from base where base.quadkey = pick.k) as present from pick where pow(0.25, length(k) - 1) * 100 <= 0.8 or not exists (select 1 from base where starts_with(base.quadkey, pick.k) and length(base.quadkey) > length(pick.k))""")
def qk13(spark, d):
    """Level-of-detail cut: descend while the projected area (100 at the root, a quarter a level) exceeds 0.8."""
    tiles = pyramid_all(spark, d).select("quadkey").distinct()
    area = F.pow(F.lit(0.25), qk.depth(F.col("node"))) * 100
    node = tiles.select(F.explode(qk.prefixes(F.col("quadkey"))).alias("node"), F.col("quadkey").alias("below")).groupBy("node").agg(F.max(F.length("below")).alias("deepest"), F.max((F.col("below") == F.col("node")).cast("int")).alias("own"))
    reached = node.filter((F.length("node") == 1) | (area * 4 > 0.8))
    return reached.filter((area <= 0.8) | (F.col("deepest") == F.length("node"))).select(F.col("node").alias("quadkey"), (F.col("own") == 1).alias("present"))


@query("qk14_leaves", f"""with recursive {PYRAMID_SQL}, kids as (select distinct left(quadkey, length(quadkey) - 1) as quadkey from dest where length(quadkey) > 1)
  select quadkey, false as is_virtual from dest where quadkey not in (select quadkey from kids)
  union all select d.quadkey || i, true from dest d join kids using (quadkey), unnest(['0', '1', '2', '3']) as t(i) where d.quadkey || i not in (select quadkey from dest)""")
def qk14(spark, d):
    return py.leaves(pyramid(spark, d))


@query("agg15_bounds", f"with recursive {PYRAMID_SQL}, {_DEC} select d::int as tile_depth, min(col) as min_col, max(col) as max_col, min(row) as min_row, max(row) as max_row, count(*) as n_tiles from dec group by d")
def agg15(spark, d):
    return py.bounds_by_depth(pyramid_all(spark, d))


@query("agg16_tile_count", f"with recursive {PYRAMID_SQL} select count(*) as n_tiles, max(length(quadkey) - 1)::int as max_depth from dest")
def agg16(spark, d):
    return pyramid(spark, d).agg(F.count(F.lit(1)).alias("n_tiles"), F.max(qk.depth(F.col("quadkey"))).alias("max_depth"))


@query("jn15_nearest_ancestor", f"""with recursive {PYRAMID_SQL} select b.quadkey, arg_max(a.quadkey, length(a.quadkey)) as ancestor from base b left join dest a on starts_with(b.quadkey, a.quadkey) group by 1""")
def jn15(spark, d):
    return py.nearest_ancestor(pyramid_all(spark, d), pyramid(spark, d))


@query("jn15_pyramid_tiles", r"""with t as (select distinct pyramid_id, quad_key from pyramid_tiles where regexp_full_match(quad_key, '0[0-3]*')), big as (select pyramid_id, quad_key || '0123' as q from t)
  select b.pyramid_id, b.q as quadkey, arg_max(a.quad_key, length(a.quad_key)) as ancestor from big b join t a on a.pyramid_id = b.pyramid_id and starts_with(b.q, a.quad_key) group by all""")
def jn15b(spark, d):
    t = table(spark, d, "pyramid_tiles").filter(qk.is_valid(F.col("quad_key"))).select("pyramid_id", "quad_key").distinct()
    asked = t.select("pyramid_id", F.concat("quad_key", F.lit("0123")).alias("quadkey")).select("*", F.explode(qk.prefixes(F.col("quadkey"))).alias("quad_key"))
    return asked.join(t, ["pyramid_id", "quad_key"]).groupBy("pyramid_id", "quadkey").agg(F.max_by("quad_key", F.length("quad_key")).alias("ancestor"))


_CLS = f"""{PYRAMID_SQL}, cmp as (select d.quadkey, d.content, d.score, e.content as dest_content, e.score as dest_score, e.quadkey is not null as in_dest from delta d left join dest e on d.quadkey = e.quadkey),
cls as (select *, case when not in_dest then 'new' when content = dest_content then 'identical' when abs(score - dest_score) <= 0.03 then 'equivalent' else 'conflict' end as kind from cmp)"""


def _compared(spark, d):
    return py.diff(pyramid(spark, d, delta=True), pyramid(spark, d))


def _classified(spark, d):
    return py.classify(_compared(spark, d), F.abs(F.col("score") - F.col("dest_score")))


@query("jn13_pyramid_diff", f"with recursive {_CLS} select quadkey, content, dest_content, in_dest from cmp")
def jn13(spark, d):
    return _compared(spark, d).select("quadkey", "content", "dest_content", F.coalesce("in_dest", F.lit(False)).alias("in_dest"))


@query("mrg1_classify", f"with recursive {_CLS} select quadkey, kind from cls")
def mrg1(spark, d):
    return _classified(spark, d).select("quadkey", "kind")


@query("mrg2_byte_identity", f"with recursive {_CLS} select quadkey, content is not distinct from dest_content as identical from cmp where in_dest")
def mrg2(spark, d):
    return _compared(spark, d).filter("in_dest").select("quadkey", F.col("content").eqNullSafe(F.col("dest_content")).alias("identical"))


@query("mrg3_visual_equivalence", """select a.vec_id, sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a.embedding::double[], b.embedding::double[])]) / len(a.embedding)) <= 0.15 as equivalent from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def mrg3(spark, d):
    from quadloom.operators.matching import rmse
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", (rmse(F.col("embedding"), F.col("other")) <= 0.15).alias("equivalent"))


@query("mrg4_resolution", "select c_custkey, c_custkey * c_custkey * 1000000000 + least(c_nationkey * 100000000::bigint, 999999999) as score, (c_custkey + c_nationkey % 3 > c_custkey + 1) as replaces from customer")
def mrg4(spark, d):
    """Scores are bigints where all of them fit, else decimal(38,0)."""
    c = table(spark, d, "customer")
    pixels, size = F.col("c_custkey") * F.col("c_custkey"), F.col("c_nationkey") * F.lit(100_000_000).cast("bigint")
    wide = bool(c.agg(F.max(pixels) > py.MOST_PIXELS).first()[0])  # whole numbers in either case
    return c.select("c_custkey", py.resolution_score(pixels, size, wide).alias("score"), (py.resolution_score(F.col("c_nationkey") % 3, F.lit(0)) > py.resolution_score(F.lit(1).cast("bigint"), F.lit(0))).alias("replaces"))


@query("mrg5_gate", f"with recursive {_CLS} select count(*) filter (kind = 'conflict') = 0 as may_merge from cls")
def mrg5(spark, d):
    return _classified(spark, d).agg((F.count_if(F.col("kind") == "conflict") == 0).alias("may_merge"))


_CALM = f"""{_CLS}, calm as (select * from cls where kind <> 'conflict'),
merged as (select coalesce(e.quadkey, c.quadkey) as quadkey, case when c.quadkey is not null and (e.quadkey is null or c.kind = 'equivalent') then c.content else e.content end as content from dest e full join calm c on c.quadkey = e.quadkey)"""


def _merged(spark, d):
    calm = _classified(spark, d).filter("kind <> 'conflict'")
    return py.upsert(calm, pyramid(spark, d), F.col("kind") == "equivalent")


@query("mrg6_upsert", f"with recursive {_CALM} select quadkey, content from merged")
def mrg6(spark, d):
    return _merged(spark, d)


@query("mrg6_upsert_blocked", f"with recursive {_CLS} select quadkey, content from dest")
def mrg6b(spark, d):
    return py.upsert(_classified(spark, d), pyramid(spark, d), F.col("kind") == "equivalent")


@query("mrg7_verified", f"with recursive {_CALM} select (select count(*) from calm where quadkey not in (select quadkey from merged)) = 0 as complete")
def mrg7(spark, d):
    calm = _classified(spark, d).filter("kind <> 'conflict'")
    return py.missing_after(calm, _merged(spark, d)).agg((F.count(F.lit(1)) == 0).alias("complete"))


@query("mrg8_dry_run", f"with recursive {_CLS} select case when count(*) filter (kind = 'conflict') > 0 then 2 when count(*) filter (kind = 'new') > 0 then 1 else 0 end as exit_status from cls")
def mrg8(spark, d):
    c = _classified(spark, d)
    return c.agg(F.when(F.count_if(F.col("kind") == "conflict") > 0, 2).when(F.count_if(F.col("kind") == "new") > 0, 1).otherwise(0).alias("exit_status"))


@query("mrg9_conflicts", f"with recursive {_CLS} select quadkey, content, dest_content, round(abs(score - dest_score), 2) as distance from cls where kind = 'conflict'")
def mrg9(spark, d):
    return _classified(spark, d).filter("kind = 'conflict'").select("quadkey", "content", "dest_content", F.round(F.abs(F.col("score") - F.col("dest_score")), 2).alias("distance"))


@query("jn14_missing", f"with recursive {_CLS} select quadkey from delta where quadkey not in (select quadkey from dest)")
def jn14(spark, d):
    return py.missing_after(pyramid(spark, d, delta=True), pyramid(spark, d))


@query("agg14_summary", f"with recursive {_CLS} select kind, count(*) as n_tiles, min(length(quadkey) - 1)::int as min_level, max(length(quadkey) - 1)::int as max_level from cls group by kind")
def agg14(spark, d):
    return _classified(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n_tiles"), F.min(qk.depth(F.col("quadkey"))).alias("min_level"), F.max(qk.depth(F.col("quadkey"))).alias("max_level"))


@query("srt7_cache_budget", "select c_custkey, sum(c_custkey % 97 + 1) over (order by c_custkey desc)::bigint <= 5000 as cached from customer")
def srt7(spark, d):
    """What a cache with a byte budget still holds, newest first: running size up to the budget."""
    items = table(spark, d, "customer").select("c_custkey", (-F.col("c_custkey")).alias("age"), (F.col("c_custkey") % 97 + 1).alias("n_bytes"))
    return py.cached_within(items, "age", "n_bytes", 5000).select("c_custkey", "cached")
