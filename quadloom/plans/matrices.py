"""Queries on matrices (orders as matrices, parts as tiles) and their hierarchy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadloom.functions.ids import five_digit, id_frame
from quadloom.functions.quadkey import is_valid
from quadloom.model import CELLS_SQL, UNCLES_SQL, cells, uncle_edges
from quadloom.operators import hierarchy, matrices as mx, pairs
from quadloom.operators.graph import inconsistent_links, placed_components
from quadloom.runtime import table, two_level_rank

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# a row holds one cell here, so pieces are runs of rows with equal column
_PIECES = f"""{CELLS_SQL}, st as (select matrix_id, i, j, case when j = lag(j) over (partition by matrix_id order by i) then 0 else 1 end as fresh from raw_cells),
runs as (select *, sum(fresh) over (partition by matrix_id order by i) as run from st),
pieces as (select matrix_id, i, j, min(i) over (partition by matrix_id, run) as root_i, j as root_j from runs)"""


@query("mtx2_connectivity", f"with {_PIECES} select * from pieces")
def mtx2(spark, d):
    return mx.cell_components(cells(spark, d, first_only=False))


@query("mtx1_validity", f"""with {_PIECES}, p as (select matrix_id, count(distinct root_i) as pieces from pieces group by 1),
  n as (select matrix_id, count(*) as n, count(distinct tile_id) as nt from raw_cells group by 1)
  select matrix_id, nt = n as unique_ids, true as unique_cells, pieces = 1 as connected, n >= 2 and nt = n and pieces = 1 as valid from n join p using (matrix_id)""")
def mtx1(spark, d):
    raw = cells(spark, d, first_only=False)
    return mx.validity(raw, mx.cell_components(raw))


@query("mtx3_single_matrix_rows", f"with {_PIECES} select matrix_id || '/' || root_i as part_id, count(*) as n_tiles from pieces group by matrix_id, root_i having count(*) >= 2")
def mtx3(spark, d):
    c = mx.cell_components(cells(spark, d, first_only=False))
    return c.groupBy("matrix_id", "root_i", "root_j").agg(F.count(F.lit(1)).alias("n_tiles")).filter("n_tiles >= 2").select(F.concat_ws("/", "matrix_id", "root_i").alias("part_id"), "n_tiles")


_SHARED = f"""{CELLS_SQL}, shared as (select x.matrix_id as a, y.matrix_id as b, tile_id, x.i - y.i as di, x.j - y.j as dj from cells x join cells y using (tile_id) where x.matrix_id < y.matrix_id),
una as (select a, b, count(*) as n_shared, min(di) as di, min(dj) as dj from shared group by a, b having min(di) = max(di) and min(dj) = max(dj)),
cf as (select u.a, u.b, count(*) filter (c.tile_id is not null and c.tile_id <> m.tile_id) as n_conflicts from una u join cells m on m.matrix_id = u.b left join cells c on c.matrix_id = u.a and c.i = m.i + u.di and c.j = m.j + u.dj group by u.a, u.b),
good as (select u.* from una u join cf using (a, b) where n_conflicts = 0)"""


@query("jn10_shared_tiles", f"with {_SHARED} select * from shared")
def jn10(spark, d):
    return mx.shared_tiles(cells(spark, d))


@query("agg13_unanimous", f"with {_SHARED} select * from una")
def agg13(spark, d):
    return mx.unanimous(mx.shared_tiles(cells(spark, d)))


@query("jn11_conflicts", f"with {_SHARED} select * from cf")
def jn11(spark, d):
    return pairs.conflicts(cells(spark, d))


_MERGED = f"""{_SHARED}, mu as (select g.a, g.b, c.tile_id, c.i, c.j from good g join cells c on c.matrix_id = g.a union select g.a, g.b, c.tile_id, c.i + g.di, c.j + g.dj from good g join cells c on c.matrix_id = g.b),
merged as (select a, b, tile_id, i - min(i) over (partition by a, b) as i, j - min(j) over (partition by a, b) as j from mu)"""


@query("mtx4_pair_merge", f"with {_MERGED} select a, b, count(*) as n_cells, max(i)::int + 1 as n_rows, max(j)::int + 1 as n_cols from merged group by a, b")
def mtx4(spark, d):
    return pairs.merged_sizes(cells(spark, d))


@query("mtx5_normalize", f"with {CELLS_SQL} select matrix_id, tile_id, i - min(i) over (partition by matrix_id) as i, j - min(j) over (partition by matrix_id) as j from cells")
def mtx5(spark, d):
    return mx.normalize(cells(spark, d), ["matrix_id"])


@query("mtx6_unusable", f"with {CELLS_SQL} select matrix_id, count(*) - count(distinct tile_id) as n_repeated from raw_cells group by 1 having count(*) > count(distinct tile_id)")
def mtx6(spark, d):
    g = cells(spark, d, first_only=False).groupBy("matrix_id").agg((F.count(F.lit(1)) - F.countDistinct("tile_id")).alias("n_repeated"))
    return g.filter("n_repeated > 0")


@query("set2_union_cells", f"with {_MERGED} select a, b, tile_id, i, j from merged")
def set2(spark, d):
    return pairs.merged_cells(cells(spark, d))


@query("mtx7_merge_sweep")
def mtx7(spark, d):
    """The order-dependent sweep over one customer's orders, as frames in order of their ids."""
    return _by_session(spark, d, lambda frames: [(0, *r) for r in mx.merge_sweep(frames)]).drop("group_no")

def _by_session(spark, d, group):
    """The order-dependent forms need a session's matrices in one place; sessions go side by side."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("matrix_id"), F.col("o_custkey").alias("session_id"))

    def run(pdf):
        import pandas as pd

        frames = [(m, list(zip(g["tile_id"], g["i"], g["j"]))) for m, g in pdf.sort_values(["matrix_id", "i"]).groupby("matrix_id")]
        return pd.DataFrame([(pdf["session_id"].iloc[0], *r) for r in group(frames)], columns=["session_id", "group_no", "matrix_id", "tile_id", "i", "j"])

    return cells(spark, d).join(o, "matrix_id").groupBy("session_id").applyInPandas(run, "session_id bigint, group_no int, matrix_id bigint, tile_id bigint, i int, j int")


@query("mtx8_automatic_grouping")
def mtx8a(spark, d):
    """Merge and cut sweeps until nothing changes, per session; every 97th tile is a west cutter."""
    return _by_session(spark, d, lambda frames: mx.grouping_fixpoint(frames, {t for _, c in frames for t, _, _ in c if t % 97 == 0}))


@query("mtx9_full_set_merge")
def mtx9a(spark, d):
    return _by_session(spark, d, lambda frames: [(0, *r) for r in mx.full_merge(frames)]).drop("group_no")


@query("mtx8_grouping_fixpoint")
def mtx8(spark, d):
    """Offset-consistent groups of matrices over their shared tiles, with the links that contradict."""
    links = cells(spark, d).select(F.struct(F.lit(0).alias("kind"), F.col("matrix_id").alias("id")).alias("u"), F.struct(F.lit(1).alias("kind"), F.col("tile_id").alias("id")).alias("v"), F.col("i").alias("di"), F.col("j").alias("dj"))
    placed = placed_components(links)
    bad = inconsistent_links(links, placed).select(F.col("u.id").alias("matrix_id")).groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n_bad"))
    return placed.filter("v.kind = 0").select(F.col("v.id").alias("matrix_id"), F.col("root.id").alias("group_id"), "di", "dj").join(bad, "matrix_id", "left").select("matrix_id", "group_id", "di", "dj", F.coalesce("n_bad", F.lit(0)).alias("n_contradictions"))


@query("mtx9_full_merge", f"with {_SHARED} select count(*) as n_merges, count(distinct b) as n_gone from good")
def mtx9(spark, d):
    return pairs.gone(cells(spark, d)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_merges"), F.count(F.lit(1)).alias("n_gone"))


_CUT = f"""{CELLS_SQL}, cutters as (select distinct tile_id from cells where tile_id % 97 = 0), marked as (select distinct matrix_id, j from cells where tile_id in (select tile_id from cutters)),
cut as (select matrix_id, arg_min(j, row(i, j)) as c from cells where tile_id in (select tile_id from cutters) group by 1 having count(distinct j) = 1 and arg_min(j, row(i, j)) > 0),
parts as (select matrix_id, tile_id, i, case when c is not null and j >= c then j - c else j end as j, case when c is null then 'whole' when j >= c then 'main' else 'transient' end as part, coalesce(c, 0) as cut from cells left join cut using (matrix_id))"""


def _cutters(c):
    return c.filter("tile_id % 97 = 0").select("tile_id").distinct()


@query("mtx10_cutter_columns", f"with {_CUT} select c.matrix_id, c.tile_id from cells c join marked using (matrix_id, j)")
def mtx10(spark, d):
    c = cells(spark, d)
    return c.join(mx.marked_columns(c, _cutters(c)), ["matrix_id", "j"]).select("matrix_id", "tile_id")


@query("jn16_cutter_semi", f"with {_CUT} select matrix_id, tile_id from cells where tile_id in (select tile_id from cutters)")
def jn16(spark, d):
    c = cells(spark, d)
    return c.join(_cutters(c), "tile_id", "left_semi").select("matrix_id", "tile_id")


@query("mtx11_cutter_invalid", f"with {_CUT} select matrix_id, count(*) as n_columns from marked group by 1 having count(*) > 1")
def mtx11(spark, d):
    c = cells(spark, d)
    return mx.marked_columns(c, _cutters(c)).groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n_columns")).filter("n_columns > 1")


@query("mtx12_west_split", f"with {_CUT} select * from parts")
def mtx12(spark, d):
    c = cells(spark, d)
    return mx.west_split(c, _cutters(c))


@query("mtx13_split_transform", f"with {_CUT} select matrix_id, part, 5 as row_offset, (7 + case when part = 'main' then cut else 0 end)::int as col_offset, count(*) as n_tiles from parts where part <> 'whole' group by all")
def mtx13(spark, d):
    c = cells(spark, d)
    p = mx.west_split(c, _cutters(c)).filter("part <> 'whole'")
    return p.groupBy("matrix_id", "part", F.lit(5).alias("row_offset"), (F.lit(7) + F.when(F.col("part") == "main", F.col("cut")).otherwise(0)).alias("col_offset")).agg(F.count(F.lit(1)).alias("n_tiles"))


@query("mtx14_split_until_invalid", f"with {_CUT}, bad as (select min(matrix_id) as m from (select matrix_id from marked group by 1 having count(*) > 1)) select distinct matrix_id from cut where matrix_id < coalesce((select m from bad), 9223372036854775807)")
def mtx14(spark, d):
    c = cells(spark, d)
    marked = mx.marked_columns(c, _cutters(c)).groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n"), F.max("j").alias("j"))
    bad = marked.filter("n > 1").agg(F.coalesce(F.min("matrix_id"), F.lit((1 << 63) - 1)).alias("m"))
    return marked.filter("n = 1 and j > 0").join(F.broadcast(bad)).filter("matrix_id < m").select("matrix_id")


@query("mtx15_surviving_map", f"with {_CUT}, {UNCLES_SQL} select p.matrix_id, e.tile_id, e.uncle_id from parts p join edges e using (tile_id) where p.part = 'main'")
def mtx15(spark, d):
    c = cells(spark, d)
    return mx.west_split(c, _cutters(c)).filter("part = 'main'").join(uncle_edges(spark, d), "tile_id").select("matrix_id", "tile_id", "uncle_id")


@query("flt13_small_filter", f"with {CELLS_SQL}, s as (select matrix_id, count(*) as n from cells group by 1) select matrix_id, n as n_tiles, n >= 4 as kept from s")
def flt13(spark, d):
    keep, drop = mx.majority_sizes(cells(spark, d), 4)
    return keep.withColumn("kept", F.lit(True)).unionByName(drop.withColumn("kept", F.lit(False))).withColumnRenamed("n", "n_tiles")


@query("flt14_tiny_frames", f"with {CELLS_SQL} select matrix_id from cells group by 1 having count(*) <= 2")
def flt14(spark, d):
    return cells(spark, d).groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n")).filter("n <= 2").select("matrix_id")


@query("flt15_frames_kept", "select session_id, frame_id, count(*) as n_tiles from frame_tiles group by all having count(*) > 1")
def flt15(spark, d):
    return table(spark, d, "frame_tiles").groupBy("session_id", "frame_id").agg(F.count(F.lit(1)).alias("n_tiles")).filter("n_tiles > 1")


@query("flt16_drop_broken_frames", f"with {CELLS_SQL} select matrix_id, tile_id from raw_cells where matrix_id not in (select matrix_id from raw_cells group by 1 having count(*) > count(distinct tile_id))")
def flt16(spark, d):
    raw = cells(spark, d, first_only=False)
    return raw.join(mtx6(spark, d), "matrix_id", "left_anti").select("matrix_id", "tile_id")


@query("flt17_null_neighbours", """with f as (select row_id, [x for x in [south_neighbor, north_neighbor, east_neighbor, west_neighbor] if x is not null and trim(x) <> '' and lower(trim(x)) <> 'null'] as l from frame_tiles) select row_id from f where len(l) > 0""")
def flt17(spark, d):
    from quadloom.functions.ids import reference_or_none

    refs = [reference_or_none(F.col(c)) for c in ("south_neighbor", "north_neighbor", "east_neighbor", "west_neighbor")]
    return table(spark, d, "frame_tiles").filter(F.coalesce(*refs).isNotNull()).select("row_id")


@query("set1_conservation", f"with {_CUT} select (select count(*) from (select matrix_id, tile_id from cells except select matrix_id, tile_id from parts)) as n_missing, (select count(*) from (select matrix_id, tile_id from parts except select matrix_id, tile_id from cells)) as n_added")
def set1(spark, d):
    c = cells(spark, d)
    p = mx.west_split(c, _cutters(c)).select("matrix_id", "tile_id", F.lit(1).alias("after"), F.lit(0).alias("before"))
    b = c.select("matrix_id", "tile_id", F.lit(0).alias("after"), F.lit(1).alias("before"))
    g = p.unionByName(b).groupBy("matrix_id", "tile_id").agg(F.max("after").alias("a"), F.max("before").alias("b"))
    return g.agg(F.count_if((F.col("b") == 1) & (F.col("a") == 0)).alias("n_missing"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("n_added"))


@query("set3_intersection", "select distinct l_partkey as tile_id from lineitem where l_returnflag = 'R' intersect select distinct l_partkey from lineitem where l_returnflag = 'A'")
def set3(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("tile_id"), "l_returnflag")
    return li.filter("l_returnflag = 'R'").select("tile_id").intersect(li.filter("l_returnflag = 'A'").select("tile_id"))


@query("set4_relationship_union", f"with {UNCLES_SQL}, u as (select tile_id, direction || ':' || uncle_id as r from edges union select l_partkey, (l_suppkey % 4) || ':' || (l_partkey // 4) from lineitem) select tile_id, string_agg(r, ',' order by r) as relations from u group by 1")
def set4(spark, d):
    a = uncle_edges(spark, d).select("tile_id", F.concat_ws(":", "direction", "uncle_id").alias("r"))
    b = table(spark, d, "lineitem").select(F.col("l_partkey").alias("tile_id"), F.concat_ws(":", F.col("l_suppkey") % 4, F.expr("l_partkey div 4")).alias("r"))
    return a.unionByName(b).groupBy("tile_id").agg(F.array_join(F.sort_array(F.collect_set("r")), ",").alias("relations"))


@query("set5_frame_sets_equal", "select count(*) filter (n_a <> n_b) as n_differences from (select coalesce(a.k, b.k) as k, a.k is not null as n_a, b.k is not null as n_b from (select distinct l_orderkey as k from lineitem) a full join (select o_orderkey as k from orders) b on a.k = b.k)")
def set5(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("a", F.lit(True))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "k", "full_outer").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_differences"))


@query("ded1_matrix_dedup", f"with {CELLS_SQL}, s as (select matrix_id, string_agg(tile_id::varchar, ',' order by tile_id) as sig from cells group by 1) select min(matrix_id) as matrix_id, sig as signature, count(*) as n_copies from s group by sig")
def ded1(spark, d):
    s = cells(spark, d).groupBy("matrix_id").agg(F.array_join(F.sort_array(F.collect_list("tile_id")).cast("array<string>"), ",").alias("signature"))
    return s.groupBy("signature").agg(F.min("matrix_id").alias("matrix_id"), F.count(F.lit(1)).alias("n_copies"))


@query("srt1_cell_order", f"with {CELLS_SQL} select matrix_id, string_agg(tile_id::varchar, ',' order by i, j, tile_id) as tiles from cells group by 1")
def srt1(spark, d):
    return cells(spark, d).groupBy("matrix_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "tile_id"))), lambda x: x["tile_id"].cast("string")), ",").alias("tiles"))


@query("srt4_by_size", f"with {CELLS_SQL}, s as (select matrix_id, count(*) as n from cells group by 1) select matrix_id, n as n_tiles, rank() over (order by n)::bigint as size_rank from s")
def srt4(spark, d):
    # ranks from the histogram of sizes: few rows, whatever the number of matrices
    s = cells(spark, d).groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n_tiles"))
    h = s.groupBy("n_tiles").agg(F.count(F.lit(1)).alias("c"))
    r = h.select("n_tiles", (F.coalesce(F.sum("c").over(Window.orderBy("n_tiles").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias("size_rank"))
    return s.join(r, "n_tiles").select("matrix_id", "n_tiles", "size_rank")


_TREE = f"{UNCLES_SQL}, up(tile_id, uncle_id, d) as (select tile_id, uncle_id, 0 from edges where uncle_id = tile_id or uncle_id not in (select tile_id from edges) union all select e.tile_id, e.uncle_id, u.d + 1 from edges e join up u on e.uncle_id = u.tile_id where e.tile_id <> e.uncle_id)"


@query("srt3_levels", f"with recursive {_TREE} select tile_id, d::bigint as level from up")
def srt3(spark, d):
    e = uncle_edges(spark, d).filter("tile_id is not null").groupBy(F.lit(0).cast("bigint").alias("group_id"), F.col("tile_id").alias("node_key")).agg(F.min(F.when(F.col("uncle_id") != F.col("tile_id"), F.col("uncle_id"))).alias("parent_key"))
    n = hierarchy.nested_sets(e, prefix=False)
    return n.filter("node_depth >= 0").select(F.col("node_key").cast("bigint").alias("tile_id"), F.col("node_depth").alias("level"))


@query("srt3_priority_order")
def srt3b(spark, d):
    """Topological order of each export's layers: parents first, ties by frame, then index."""
    layers = table(spark, d, "matrix_layers").filter("export_id is not null and matrix_index is not null").groupBy("export_id", "matrix_index").agg(F.min("parent_matrix_index").alias("parent"), F.min("frame_id").alias("frame_id"))

    def run(pdf):
        import pandas as pd

        ids = sorted(pdf["matrix_index"])
        known = set(ids)
        par = {int(m): ({int(p)} & known if p == p and p is not None else set()) for m, p in zip(pdf["matrix_index"], pdf["parent"])}
        rank = {int(m): (f if f == f and f is not None else 1e18, int(m)) for m, f in zip(pdf["matrix_index"], pdf["frame_id"])}
        out = mx.priority_order({m: par[m] for m in ids}, rank)
        return pd.DataFrame([(pdf["export_id"].iloc[0], *r) for r in out], columns=["export_id", "matrix_index", "position", "level"])

    return layers.groupBy("export_id").applyInPandas(run, "export_id bigint, matrix_index int, position int, level int")


_OWN = f"{UNCLES_SQL}, own as (select p_partkey as tile_id, p_partkey // 16 as matrix_id from part)"
_DIAG = f"""{_OWN}, diag as (select o.matrix_id, count(*) as n_uncles, count(distinct case when p.matrix_id <> o.matrix_id then p.matrix_id end) as n_parents, count(*) filter (p.matrix_id is null) as n_unresolved, count(distinct e.tile_id) as n_tiles
  from edges e join own o using (tile_id) left join own p on p.tile_id = e.uncle_id group by o.matrix_id)"""


def _owner(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("tile_id"), F.expr("p_partkey div 16").alias("matrix_id"))


@query("agg17_diagnostics", f"with {_DIAG} select * from diag")
def agg17(spark, d):
    return mx.hierarchy_status(uncle_edges(spark, d), _owner(spark, d)).drop("status")


@query("agg18_uncle_status", f"with {_DIAG} select matrix_id, case when n_parents = 0 then 'TOPLEVEL' when n_parents > 1 then 'BROKEN' else 'NORMAL' end as status from diag")
def agg18(spark, d):
    return mx.hierarchy_status(uncle_edges(spark, d), _owner(spark, d)).select("matrix_id", "status")


@query("agg19_missing_uncles", f"with {UNCLES_SQL} select distinct uncle_id from edges where uncle_id not in (select tile_id from edges where tile_id % 5 <> 0)")
def agg19(spark, d):
    e = uncle_edges(spark, d)
    return e.select("uncle_id").distinct().join(e.filter("tile_id % 5 <> 0").select(F.col("tile_id").alias("uncle_id")), "uncle_id", "left_anti")


@query("jn9_uncle_owner", f"with {_OWN} select e.tile_id, p.matrix_id as parent_matrix from edges e join own o using (tile_id) join own p on p.tile_id = e.uncle_id where p.matrix_id <> o.matrix_id")
def jn9(spark, d):
    o = _owner(spark, d)
    e = uncle_edges(spark, d).join(o, "tile_id").join(o.select(F.col("tile_id").alias("uncle_id"), F.col("matrix_id").alias("parent_matrix")), "uncle_id")
    return e.filter("parent_matrix <> matrix_id").select("tile_id", "parent_matrix")


@query("mtx20_placement", f"with recursive {UNCLES_SQL}, pl(tile_id, path) as (select tile_id, '0' || tile_id::varchar from edges where uncle_id = 0 and tile_id > 0 union all select e.tile_id, p.path || e.direction from edges e join pl p on e.uncle_id = p.tile_id) select tile_id, path from pl")
def mtx20(spark, d):
    e = uncle_edges(spark, d)
    roots = e.filter("uncle_id = 0 and tile_id > 0").select("tile_id", F.concat(F.lit("0"), F.col("tile_id").cast("string")).alias("path"))
    return mx.place_levels(e.filter("uncle_id > 0"), roots, F.col("direction").cast("string"))


# majorities outvote the wrong uncles everywhere in these tables, so each tile comes to its number in base 4
@query("mtx20_placement_fixpoint", "with recursive digits(n, rest, key) as (select p_partkey, p_partkey, '' from part where p_partkey > 0 union all select n, rest // 4, (rest % 4)::varchar || key from digits where rest > 0) select n as tile_id, '0' || key as path from digits where rest = 0")
def mtx20f(spark, d):
    """Parts on the grid of their level, in matrices of four by four; some uncles missing, some wrong, eight seeds."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("tile_id")).filter("tile_id > 0")
    digits = F.conv(F.col("tile_id").cast("string"), 10, 4)
    p = p.withColumn("at", mx.place_of(F.concat(F.lit("0"), digits))).select("tile_id", "at.*")
    c = p.select(F.concat_ws("/", "level", F.expr("row div 4"), F.expr("col div 4")).alias("matrix_id"), "tile_id", (F.col("row") % 4).cast("int").alias("i"), (F.col("col") % 4).cast("int").alias("j"))
    low = c.groupBy("matrix_id").agg(F.min("i").alias("i0"), F.min("j").alias("j0"))
    c = c.join(low, "matrix_id").select("matrix_id", "tile_id", (F.col("i") - F.col("i0")).alias("i"), (F.col("j") - F.col("j0")).alias("j"))
    u = uncle_edges(spark, d).filter("uncle_id > 0 and tile_id % 5 <> 0").select("tile_id", "uncle_id", F.when(F.col("tile_id") % 11 == 0, (F.col("direction") + 1) % 4).otherwise(F.col("direction")).alias("digit"))
    seeds = p.filter("tile_id < 8").select("tile_id", F.concat(F.lit("0"), F.conv(F.col("tile_id").cast("string"), 10, 4)).alias("path"))
    return mx.place_matrices(c, u, seeds).select("tile_id", "path")


@query("mtx17_anchor", "select p_partkey, (2 * (p_partkey % 50) + (p_size % 2) - (p_partkey % 7))::bigint as anchor_row, (2 * (p_partkey % 40) + (p_size % 3) % 2 - (p_partkey % 5))::bigint as anchor_col from part")
def mtx17(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", mx.anchor(k % 50, s % 2, k % 7).alias("anchor_row"), mx.anchor(k % 40, (s % 3) % 2, k % 5).alias("anchor_col"))


@query("mtx18_grid_assembly", f"with {_PIECES} select matrix_id, i, j, (i - root_i)::bigint as grid_i, 0::bigint as grid_j from pieces")
def mtx18(spark, d):
    p = mx.cell_components(cells(spark, d, first_only=False))
    return p.select("matrix_id", "i", "j", (F.col("i") - F.col("root_i")).cast("bigint").alias("grid_i"), (F.col("j") - F.col("root_j")).cast("bigint").alias("grid_j"))


@query("mtx19_largest_component", f"with {_PIECES}, s as (select matrix_id, root_i, count(*) as n from pieces group by all) select matrix_id, arg_max(root_i, row(n, -root_i)) as root_i, max(n) as n_cells from s group by 1")
def mtx19(spark, d):
    s = mx.cell_components(cells(spark, d, first_only=False)).groupBy("matrix_id", "root_i", "root_j").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("matrix_id").agg(F.max_by("root_i", F.struct("n", (-F.col("root_i")).alias("r"))).alias("root_i"), F.max("n").alias("n_cells"))


@query("mtx21_full_world", "select layer_id, case when n_cols = (1::bigint << hierarchy_level) then 0 else col_offset end as col_offset, case when n_rows = (1::bigint << hierarchy_level) then 0 else row_offset end as row_offset from matrix_layers where hierarchy_level between 0 and 30")
def mtx21(spark, d):
    return mx.full_world(table(spark, d, "matrix_layers")).select("layer_id", "col_offset", "row_offset")


@query("mtx22_displacement", f"with recursive {UNCLES_SQL}, pl(tile_id, col, root, rcol, d) as (select tile_id, 0::bigint, tile_id, 5::bigint, 0 from edges where uncle_id = 0 and tile_id > 0 union all select e.tile_id, 2 * p.col + e.direction % 2, p.root, 2 * p.rcol + e.direction % 2, p.d + 1 from edges e join pl p on e.uncle_id = p.tile_id) select tile_id, (rcol - col)::bigint as shift, (5 * (1::bigint << d))::bigint as law from pl")
def mtx22(spark, d):
    """A root moved by e moves its descendants d levels down by e * 2^d."""
    e = uncle_edges(spark, d)
    roots = e.filter("uncle_id = 0 and tile_id > 0").select("tile_id")
    bits = lambda at: mx.place_levels(e.filter("uncle_id > 0"), roots.select("tile_id", F.lit(at).alias("path")), (F.col("direction") % 2).cast("string"))
    # two placements: the root at column 0, and at column 5
    here = bits("000").select("tile_id", F.conv("path", 2, 10).cast("bigint").alias("col"), (F.length("path") - 3).alias("d"))
    moved = bits("101").select("tile_id", F.conv("path", 2, 10).cast("bigint").alias("moved"))
    return here.join(moved, "tile_id").select("tile_id", (F.col("moved") - F.col("col")).alias("shift"), (5 * F.pow(F.lit(2), F.col("d")).cast("bigint")).alias("law"))


@query("mtx24_export_manifest", r"""with m as (select pyramid_id, image_path, pyramid_tile_id, n_bytes from pyramid_tiles where regexp_full_match(quad_key, '0[0-3]*'))
  select image_path, arg_min(pyramid_tile_id, row(case when n_bytes is null then 1 else 0 end, pyramid_tile_id)) as pyramid_tile_id, count(*) as n_rows, count(distinct n_bytes) > 1 as must_abort from m group by image_path""")
def mtx24(spark, d):
    return mx.export_manifest(table(spark, d, "pyramid_tiles").filter(is_valid(F.col("quad_key"))), "image_path", "pyramid_tile_id", "n_bytes")


@query("mtx25_native_only", "select row_id from frame_tiles where regexp_matches(texture_file, '/256x256_[0-9]+\\.') and number_of_points = 4 and not coalesce(skipped, false)")
def mtx25(spark, d):
    return mx.native_tiles(table(spark, d, "frame_tiles")).select("row_id")


@query("evt6_last_capture_frame", "select session_id, max(split_part(trim(content_id), '_', 1)::bigint) as last_frame from frame_tiles where regexp_full_match(trim(content_id), '[0-9]+_[0-9]+') group by 1")
def evt6(spark, d):
    return table(spark, d, "frame_tiles").withColumn("f", id_frame(F.col("content_id"))).filter("f is not null").groupBy("session_id").agg(F.max("f").alias("last_frame"))


@query("evt8_retry_order", f"with {_SHARED}, c as (select distinct matrix_id from cells), f as (select matrix_id, matrix_id not in (select b from good) as failed from c) select matrix_id, failed, rank() over (partition by failed order by matrix_id)::bigint as place from f")
def evt8(spark, d):
    """Order of the next sweep: merged matrices keep their order, failed ones come after them."""
    c = cells(spark, d)
    ok = pairs.gone(c).select(F.col("b").alias("matrix_id"), F.lit(True).alias("ok"))
    c = c.select("matrix_id").distinct().join(ok, "matrix_id", "left").select("matrix_id", F.col("ok").isNull().alias("failed"))
    return two_level_rank(c, ["failed"], "matrix_id", "place")


@query("snk6_cutter_list", "select string_agg(id, ',' order by id) as ids, hierarchy_level % 3 as list_no from (select distinct printf('%05d_%d', frame_id, matrix_index) as id, hierarchy_level from matrix_layers where frame_id is not null and hierarchy_level >= 0) group by list_no")
def snk6(spark, d):
    m = table(spark, d, "matrix_layers").filter("frame_id is not null and hierarchy_level >= 0")
    ids = m.select(five_digit(F.concat_ws("_", "frame_id", "matrix_index")).alias("id"), (F.col("hierarchy_level") % 3).alias("list_no"), "hierarchy_level").distinct()
    return ids.groupBy("list_no").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


@query("snk7_id_rewrite", f"with {CELLS_SQL} select matrix_id, case when tile_id % 10 = 0 then tile_id + 1000000 else tile_id end as tile_id from cells")
def snk7(spark, d):
    c = cells(spark, d)
    ids = c.filter("tile_id % 10 = 0").select("tile_id", (F.col("tile_id") + 1_000_000).alias("new_id")).distinct()
    return c.join(ids, "tile_id", "left").select("matrix_id", F.coalesce("new_id", "tile_id").alias("tile_id"))
