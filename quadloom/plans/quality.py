"""Queries on the quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadloom.functions.ids import quick_path
from quadloom.functions.quadkey import cumulative_path, depth, digit_path, is_valid
from quadloom.operators import quality
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


@query("dq1_split_tree", r"select file_id, 'shape' as rule from tile_files where texture_file is not null and not regexp_full_match(texture_file, '/exports/e[0-9]{8}/matrix_[0-9]+/[0-9]{5}_[0-9]+\.png') union all select file_id, 'empty' from tile_files where texture_file is not null and octet_length(content) = 0")
def dq1(spark, d):
    f = table(spark, d, "tile_files").filter("texture_file is not null")
    return quality.violations(f, "file_id", {"shape": F.col("texture_file").rlike(r"^/exports/e[0-9]{8}/matrix_[0-9]+/[0-9]{5}_[0-9]+\.png$"), "empty": F.octet_length("content") > 0})


@query("dq2_source_matrices", "select layer_id, 'rows' as rule from matrix_layers where not coalesce(n_rows > 0, false) union all select layer_id, 'cols' from matrix_layers where not coalesce(n_cols > 0, false) union all select layer_id, 'frame' from matrix_layers where not coalesce(frame_id >= 0, false)")
def dq2(spark, d):
    return quality.violations(table(spark, d, "matrix_layers"), "layer_id", {"rows": F.col("n_rows") > 0, "cols": F.col("n_cols") > 0, "frame": F.col("frame_id") >= 0})


@query("dq3_exported_layers", "select layer_id, 'version' as rule from matrix_layers where not coalesce(contract_version = 3, false) union all select layer_id, 'parent' from matrix_layers where parent_matrix_index is not null and parent_matrix_index >= matrix_index")
def dq3(spark, d):
    p = F.col("parent_matrix_index")
    return quality.violations(table(spark, d, "matrix_layers"), "layer_id", {"version": F.col("contract_version") == 3, "parent": p.isNull() | (p < F.col("matrix_index"))})


@query("dq4_pyramid_layout", r"""with t as (select pyramid_tile_id, quad_key, tile_depth, regexp_extract(image_path, '/pyramidalImage/(.*)$', 1) as rel from pyramid_tiles),
  e as (select *, regexp_full_match(coalesce(quad_key, ''), '0[0-3]*') as good, regexp_replace(substr(quad_key, 2), '(.)', '\1/', 'g') || quad_key || '.png' as dp, coalesce(list_aggregate([left(quad_key, i::int) || '/' for i in range(2, length(quad_key) + 1)], 'string_agg', ''), '') || quad_key || '.png' as cp from t)
  select pyramid_tile_id, 'quadkey' as rule from e where not good union all select pyramid_tile_id, 'depth' from e where not coalesce(good and tile_depth = length(quad_key) - 1, false) union all select pyramid_tile_id, 'layout' from e where not coalesce(good and (rel = dp or rel = cp), false)""")
def dq4(spark, d):
    k = F.col("quad_key")
    rel = F.regexp_extract("image_path", r"/pyramidalImage/(.*)$", 1)
    ok = is_valid(k)
    return quality.violations(table(spark, d, "pyramid_tiles"), "pyramid_tile_id", {"quadkey": ok, "depth": ok & (F.col("tile_depth") == depth(k)), "layout": ok & ((rel == digit_path(k)) | (rel == cumulative_path(k)))})


@query("dq4_missing_roots", "select distinct pyramid_id from pyramid_tiles where pyramid_id not in (select pyramid_id from pyramid_tiles where quad_key = '0')")
def dq4b(spark, d):
    t = table(spark, d, "pyramid_tiles")
    return t.groupBy("pyramid_id").agg(F.max(F.coalesce((F.col("quad_key") == "0").cast("int"), F.lit(0))).alias("r")).filter("r = 0 and pyramid_id is not null").select("pyramid_id")


@query("dq5_placement_complete", "select export_id, count(*) filter (row_offset is not null and col_offset is not null) as n_done, count(*) as n_all, count(*) filter (row_offset is not null and col_offset is not null) = count(*) as complete from matrix_layers group by 1")
def dq5(spark, d):
    return quality.completeness(table(spark, d, "matrix_layers"), ["export_id"], F.col("row_offset").isNotNull() & F.col("col_offset").isNotNull())


@query("dq6_strip_count", "select count(distinct texture_file) = 320 as has_320, count(*) > 0 as has_appearances from frame_tiles")
def dq6(spark, d):
    return table(spark, d, "frame_tiles").agg((F.countDistinct("texture_file") == 320).alias("has_320"), (F.count(F.lit(1)) > 0).alias("has_appearances"))


@query("dq7_size_bands", "select pyramid_id, count(*) as n_tiles, case when count(*) > 1000 then 'accept' when count(*) < 200 then 'reject' else 'review' end as band from pyramid_tiles group by 1")
def dq7(spark, d):
    g = table(spark, d, "pyramid_tiles").groupBy("pyramid_id").agg(F.count(F.lit(1)).alias("n_tiles"))
    return g.withColumn("band", quality.size_band(F.col("n_tiles")))


@query("dq8_space_needed", "select 4 * sum(n_bytes)::bigint + 1073741824 as dump_bytes, sum(n_bytes)::bigint + 67108864 as split_bytes from pyramid_tiles")
def dq8(spark, d):
    s = F.sum("n_bytes")
    return table(spark, d, "pyramid_tiles").agg((4 * s + (1 << 30)).alias("dump_bytes"), (s + (64 << 20)).alias("split_bytes"))


@query("src21_canonical_paths", r"select file_id, regexp_replace(regexp_replace(regexp_replace(texture_file, '/tmp/\.\./', '/', 'g'), '/\./', '/', 'g'), '//+', '/', 'g') as path from tile_files where texture_file is not null")
def canonical(spark, d):
    return table(spark, d, "tile_files").filter("texture_file is not null").select("file_id", quick_path(F.col("texture_file")).alias("path"))
