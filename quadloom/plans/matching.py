"""Queries on matching, votes, hashes and as-of lookups (embeddings as images, documents as textures)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadloom.functions.ids import tile_key
from quadloom.operators import matching as mt
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


_BEST = """pairs as (select q.vec_id as query_id, r.vec_id, sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(q.embedding::double[], r.embedding::double[])]) / 64) as rmse
  from embeddings q join embeddings r on q.vec_id % 100 = 0 and q.vec_id <> r.vec_id),
best as (select * from (select *, row_number() over (partition by query_id order by rmse, vec_id) as rank from pairs) where rank <= 2)"""


def _best(spark, d):
    e = table(spark, d, "embeddings")
    return mt.nearest_vectors(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding")


@query("jn12_best_two", f"with {_BEST} select query_id, vec_id, rank::int as rank, round(rmse, 6) as rmse from best")
def jn12(spark, d):
    return _best(spark, d).select("query_id", "vec_id", "rank", F.round("rmse", 6).alias("rmse"))


@query("srt6_confident", f"with {_BEST} select query_id, max(vec_id) filter (rank = 1) as vec_id, round(max(rmse) filter (rank = 1), 6) as best from best group by 1 having max(rmse) filter (rank = 1) <= 35 and max(rmse) filter (rank = 1) / greatest(max(rmse) filter (rank = 2), 1e-9) <= 0.98")
def srt6(spark, d):
    return mt.confident(_best(spark, d), "query_id", "rmse", "vec_id", ratio=0.98).select("query_id", "vec_id", F.round("best", 6).alias("best"))


@query("sc27_rmse", "select a.vec_id, round(sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a.embedding::double[], b.embedding::double[])]) / 64), 6) as rmse from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def sc27(spark, d):
    e = table(spark, d, "embeddings")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select("vec_id", F.round(mt.rmse(F.col("embedding"), F.col("other")), 6).alias("rmse"))


_PROBES = "n as (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as p, count(*) over (partition by label) as n from embeddings), probes as (select vec_id, label from n where n <= 16 or p in (select floor(i * (n - 1) / 15)::bigint from unnest(range(0, 16)) as t(i)))"


@query("srt5_probes", f"with {_PROBES} select vec_id, label from probes")
def srt5(spark, d):
    return mt.spaced_sample(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id")


def visual_parents(e):
    """Parent label of each label: evenly spaced probes, their best two matches elsewhere, confident ones vote."""
    v = e.select("vec_id", "label", "embedding").filter("label is not null")
    probes = mt.spaced_sample(v, "label", "vec_id")
    best = mt.confident(mt.nearest_vectors(v, probes, "vec_id", "embedding", group="label"), "query_id", "rmse", "vec_id")
    names = v.select("vec_id", F.col("label").alias("parent"))
    votes = best.join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("child")), "query_id").join(names, "vec_id").select("child", "parent", "vec_id")
    return mt.majority(votes, ["child"], ["parent"], "vec_id")


@query("agg11_majority", "with v as (select o_custkey as child, o_orderstatus as vote, o_orderkey from orders), n as (select child, vote, count(*) as n_votes, min(o_orderkey) as f from v group by all), t as (select child, arg_max(vote, row(n_votes, -f)) as vote, max(n_votes) as n_votes, sum(n_votes)::bigint as n_all from n group by child) select child, vote, n_votes, n_all from t where n_votes >= 3 and 2 * n_votes > n_all")
def agg11(spark, d):
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("child"), F.col("o_orderstatus").alias("vote"), "o_orderkey")
    return mt.majority(v, ["child"], ["vote"], "o_orderkey")


@query("mtx16_visual_parent", f"""with {_PROBES}, e as (select vec_id, label, embedding::double[] as v from embeddings where label is not null),
  pairs as (select p.vec_id as query_id, p.label as child, e.vec_id, e.label as parent, sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(q.v, e.v)]) / 64) as rmse from probes p join e q using (vec_id) join e on e.label <> p.label),
  r as (select *, row_number() over (partition by query_id order by rmse, vec_id) as rank from pairs),
  sure as (select query_id, any_value(child) as child, max(parent) filter (rank = 1) as parent, max(vec_id) filter (rank = 1) as vec_id from r where rank <= 2 group by query_id
    having max(rmse) filter (rank = 1) <= 35 and coalesce(max(rmse) filter (rank = 1) / greatest(max(rmse) filter (rank = 2), 1e-9) <= 0.75, true)),
  nv as (select child, parent, count(*) as n_votes, min(vec_id) as f from sure group by all), t as (select child, arg_max(parent, row(n_votes, -f)) as parent, max(n_votes) as n_votes, sum(n_votes)::bigint as n_all from nv group by child)
  select * from t where n_votes >= 3 and 2 * n_votes > n_all""")
def mtx16(spark, d):
    return visual_parents(table(spark, d, "embeddings"))


@query("agg12_tiered_vote", """with v as (select o_custkey as m, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as tier, (o_orderkey % 3)::int as r, (((o_orderkey - 5) % 4 + 4) % 4)::int as c, o_orderkey from orders),
  t as (select v.* from v join (select m, min(tier) as tier from v group by 1) using (m, tier)), n as (select m, r, c, count(*) as n, min(o_orderkey) as f from t group by all),
  w as (select m, arg_max(row(r, c), row(n, -f)) as rc, max(n) as n, sum(n) as a from n group by m),
  pr as (select m, arg_max(r, row(n, -r)) as r from (select m, r, count(*) as n from t group by all) group by m), pc as (select m, arg_max(c, row(n, -c)) as c from (select m, c, count(*) as n from t group by all) group by m)
  select m as matrix_id, case when 2 * n > a then rc[1] else pr.r end as row_offset, case when 2 * n > a then rc[2] else pc.c end as col_offset, 2 * n > a as joint from w join pr using (m) join pc using (m)""")
def agg12(spark, d):
    """Votes of the best tier only; the joint anchor if it has a strict majority, else each part's own."""
    o = table(spark, d, "orders")
    v = o.select(F.col("o_custkey").alias("matrix_id"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("tier"), (F.col("o_orderkey") % 3).cast("int").alias("r"), F.pmod(F.col("o_orderkey") - 5, F.lit(4)).cast("int").alias("c"), "o_orderkey")
    return mt.tiered_vote(v, "matrix_id", "tier", "r", "c", "o_orderkey")


@query("agg22_relative_rank", "select vec_id, label, percent_rank() over (partition by label order by embedding[1]) as rank from embeddings")
def agg22(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.percent_rank().over(Window.partitionBy("label").orderBy(F.col("embedding")[0])).alias("rank"))


@query("jn1_asof_texture", "with t as (select o_custkey as id, o_orderkey as v, 'p' || o_orderkey as path from orders), q as (select distinct o_custkey as id, (o_orderkey * 7 % 15000)::bigint as at from orders) select q.id, q.at, coalesce(arg_max(t.path, t.v) filter (t.v <= q.at), arg_min(t.path, t.v)) as path from q left join t using (id) group by q.id, q.at")
def jn1(spark, d):
    o = table(spark, d, "orders")
    t = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("v"), F.concat(F.lit("p"), "o_orderkey").alias("path"))
    q = o.select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") * 7 % 15000).alias("at")).distinct()
    return mt.asof_path(q, t, "id", "at", "v", "path")


_BLOBS = "blobs as (select l_orderkey as call, l_linenumber as attrib, min(l_partkey) as path from lineitem where l_orderkey % 3 <> 1 group by all)"


def _blobs(spark, d):
    return table(spark, d, "lineitem").filter("l_orderkey % 3 <> 1").groupBy(F.col("l_orderkey").alias("call"), F.col("l_linenumber").alias("attrib")).agg(F.min("l_partkey").alias("path"))


@query("jn2_candidate_blob", f"""with {_BLOBS}, q as (select o_orderkey as call, (o_orderkey % 4 + 1)::int as attrib from orders),
  c as (select q.call, q.attrib, b.path, row_number() over (partition by q.call order by case when b.attrib = q.attrib then 0 else 1 end, case b.call - q.call when 0 then 0 when 1 then 1 else 2 end, b.attrib) as rn from q join blobs b on b.call - q.call in (0, 1, -1))
  select call, attrib, path from c where rn = 1""")
def jn2(spark, d):
    """Vertex blob of a draw: its own call's, the next or the previous one's; exact attribute first."""
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("q_call"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("q_attrib"))
    near = q.select("*", F.posexplode(F.array(F.lit(0), F.lit(1), F.lit(-1))).alias("near", "step")).withColumn("call", F.col("q_call") + F.col("step"))
    rank = F.struct((F.col("attrib") != F.col("q_attrib")).cast("int").alias("a"), "near", "attrib")
    return near.join(_blobs(spark, d), "call").groupBy(F.col("q_call").alias("call"), F.col("q_attrib").alias("attrib")).agg(F.min_by("path", rank).alias("path"))


@query("jn3_index_blob", f"with {_BLOBS}, own as (select call, min(path) as path from blobs group by 1), named as (select call % 1000 as name, min(path) as path from blobs group by 1) select o.o_orderkey as call, coalesce(own.path, named.path, -1) as path from orders o left join own on own.call = o.o_orderkey left join named on named.name = o.o_orderkey % 1000")
def jn3(spark, d):
    b = _blobs(spark, d)
    own = b.groupBy("call").agg(F.min("path").alias("own"))
    named = b.groupBy((F.col("call") % 1000).alias("name")).agg(F.min("path").alias("named"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("call"), (F.col("o_orderkey") % 1000).alias("name"))
    return q.join(own, "call", "left").join(named, "name", "left").select("call", F.coalesce("own", "named", F.lit(-1).cast("bigint")).alias("path"))


@query("src8_manifest_neighbours", "with m as (select o_custkey as frame, min(o_orderkey) as entry from orders where o_custkey % 3 <> 0 group by 1), c as (select c_custkey as frame, m.entry, row_number() over (partition by c_custkey order by case m.frame - c_custkey when 0 then 0 when 1 then 1 else 2 end) as rn from customer join m on m.frame - c_custkey in (0, 1, -1)) select frame, entry from c where rn = 1")
def src8(spark, d):
    m = table(spark, d, "orders").filter("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("at")).agg(F.min("o_orderkey").alias("entry"))
    near = table(spark, d, "customer").select(F.col("c_custkey").alias("frame"), F.posexplode(F.array(F.lit(0), F.lit(1), F.lit(-1))).alias("near", "step")).withColumn("at", F.col("frame") + F.col("step"))
    return near.join(m, "at").groupBy("frame").agg(F.min_by("entry", "near").alias("entry"))


@query("jn17_dangling_bridge", """with o as (select distinct o_custkey as id from orders where o_custkey % 2 = 0), f as (select c_custkey as id, c_nationkey as tex from customer), cat as (select n_nationkey as tex, n_name as nm from nation where n_nationkey % 3 <> 0)
  select l.l_suppkey as uncle, coalesce('m' || o.id, cat.nm, 'alias' || f.tex, 'lost') as via from (select distinct l_suppkey from lineitem) l left join o on o.id = l.l_suppkey left join f on f.id = l.l_suppkey left join cat on cat.tex = f.tex""")
def jn17(spark, d):
    """A missing uncle: known matrix, else its frame's texture in the catalog, else the texture's alias."""
    o = table(spark, d, "orders").filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("uncle"), F.concat(F.lit("m"), "o_custkey").alias("known")).distinct()
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("uncle"), F.col("c_nationkey").alias("tex"))
    cat = table(spark, d, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("tex"), F.col("n_name").alias("nm"))
    q = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("uncle")).distinct()
    return q.join(o, "uncle", "left").join(f, "uncle", "left").join(cat, "tex", "left").select("uncle", F.coalesce("known", "nm", F.concat(F.lit("alias"), "tex"), F.lit("lost")).alias("via"))


@query("jn18_hash_anchor", r"""with f as (select file_id, image_path, texture_file, sha256(content) as h from tile_files where octet_length(content) > 0),
  c as (select h, min(regexp_extract(image_path, '/(0[0-3]*)\.[A-Za-z]+$', 1)) as quadkey from f where image_path is not null group by h) select f.file_id, c.quadkey from f join c using (h) where f.texture_file is not null""")
def jn18(spark, d):
    from quadloom.functions.ids import bare_quadkey

    f = table(spark, d, "tile_files").filter(F.octet_length("content") > 0).select("file_id", "image_path", "texture_file", F.sha2("content", 256).alias("h"))
    c = f.filter("image_path is not null").groupBy("h").agg(F.min(bare_quadkey(F.col("image_path"))).alias("quadkey"))
    return f.filter("texture_file is not null").join(c, "h").select("file_id", "quadkey")


_DEDUP = "case when list_bool_or(list_transform(acc, lambda a: abs(a - v[1]) <= 0.05)) then acc else acc || v end"


@query("ded2_greedy_epsilon", f"select vec_id, len(list_reduce(list_transform(embedding::double[], lambda x: [x]), lambda acc, v: {_DEDUP}))::int as n_kept from embeddings")
def ded2(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(greedy_distinct(F.col("embedding").cast("array<double>"), 0.05)).alias("n_kept"))


def greedy_distinct(values, eps: float):
    """Values in order, each kept unless a kept one lies within ``eps``."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda acc, v: F.when(F.exists(acc, lambda a: F.abs(a - v) <= eps), acc).otherwise(F.concat(acc, F.array(v))))


@query("ded3_appearances", "select texture_file, frame_id, min(row_id) as row_id from frame_tiles where texture_file is not null group by all")
def ded3(spark, d):
    return table(spark, d, "frame_tiles").filter("texture_file is not null").groupBy("texture_file", "frame_id").agg(F.min("row_id").alias("row_id"))


@query("ded4_uncle_relations", "select distinct session_id, trim(tile_id) as tile_id, upper(trim(direction)) as direction, trim(uncle_content_id) as uncle_content_id from tile_uncles where uncle_content_id is not null")
def ded4(spark, d):
    return table(spark, d, "tile_uncles").filter("uncle_content_id is not null").select("session_id", F.trim("tile_id").alias("tile_id"), F.upper(F.trim("direction")).alias("direction"), F.trim("uncle_content_id").alias("uncle_content_id")).distinct()


@query("ded5_sha", "select doc_id, sha256(text) as digest from documents")
def ded5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("ded6_duplicate_groups", "select sha256(text) as digest, count(distinct doc_id) as n_items, min(doc_id) as first_item from documents group by 1 having count(distinct doc_id) > 1")
def ded6(spark, d):
    return mt.duplicate_groups(table(spark, d, "documents"), "text", "doc_id")


@query("ded7_canonical", "select doc_id, min(doc_id) over (partition by text) as canonical from documents")
def ded7(spark, d):
    return mt.canonical_items(table(spark, d, "documents"), "text", "doc_id")


@query("snk11_texture_dedup", "select session_id, frame_id, texture_file, count(*) as n_rows from frame_tiles where texture_file is not null group by all")
def snk11(spark, d):
    return table(spark, d, "frame_tiles").filter("texture_file is not null").groupBy("session_id", "frame_id", "texture_file").agg(F.count(F.lit(1)).alias("n_rows"))


@query("src13_layer_uncle_map", "select coalesce(e.session_id, -1) as session_id, trim(tile_id) as tile_id, string_agg(distinct trim(uncle_content_id), ',' order by trim(uncle_content_id)) as uncles from tile_uncles e where uncle_content_id is not null and tile_id is not null group by all")
def src13(spark, d):
    u = table(spark, d, "tile_uncles").filter("uncle_content_id is not null and tile_id is not null")
    return u.groupBy(F.coalesce("session_id", F.lit(-1).cast("bigint")).alias("session_id"), F.trim("tile_id").alias("tile_id")).agg(F.array_join(F.sort_array(F.collect_set(F.trim("uncle_content_id"))), ",").alias("uncles"))


@query("src14_catalog_counts", "select count(distinct texture_file) as n_images, count(*) as n_appearances, count(distinct frame_id) as n_frames from frame_tiles")
def src14(spark, d):
    return table(spark, d, "frame_tiles").agg(F.countDistinct("texture_file").alias("n_images"), F.count(F.lit(1)).alias("n_appearances"), F.countDistinct("frame_id").alias("n_frames"))


@query("src16_scan_catalog", r"""with p as (select image_path, regexp_extract(image_path, '/(0[0-3]*)\.[A-Za-z]+$', 1) as k from tile_files where image_path is not null) select k as quadkey, count(*) as n_files from p where k <> '' and length(k) <= 31 group by 1""")
def src16(spark, d):
    from quadloom.functions.ids import bare_quadkey

    f = table(spark, d, "tile_files").filter("image_path is not null").withColumn("quadkey", bare_quadkey(F.col("image_path")))
    return f.filter(F.length("quadkey") <= 31).groupBy("quadkey").agg(F.count(F.lit(1)).alias("n_files"))


@query("snk2_strip_json", "select json_group_object(s, n)::varchar as doc from (select label::varchar as s, n from (select label, count(*) as n from embeddings group by label) order by label)")
def snk2(spark, d):
    g = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("label", "n"))), lambda x: F.struct(x["label"].cast("string").alias("key"), x["n"].alias("value")))
    return g.agg(F.to_json(F.map_from_entries(entries)).alias("doc"))  # one entry a strip of a fixed catalog


@query("snk3_patch_lists", "select session_id, frame_id, string_agg(n || ':' || c, ',' order by n) as patches from (select session_id, frame_id, number_of_points as n, count(*) as c from frame_tiles where number_of_points is not null group by all) group by all")
def snk3(spark, d):
    h = table(spark, d, "frame_tiles").filter("number_of_points is not null").groupBy("session_id", "frame_id", "number_of_points").agg(F.count(F.lit(1)).alias("c"))
    return h.groupBy("session_id", "frame_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number_of_points", "c"))), lambda x: F.concat_ws(":", x["number_of_points"], x["c"])), ",").alias("patches"))


@query("agg10_strip_histogram", "select session_id, frame_id, number_of_points, count(*) as n_tiles from frame_tiles group by all")
def agg10(spark, d):
    return table(spark, d, "frame_tiles").groupBy("session_id", "frame_id", "number_of_points").agg(F.count(F.lit(1)).alias("n_tiles"))


@query("src15_folder_tiles", r"select pyramid_id, quad_key, count(*) as n_listed from pyramid_tiles where regexp_full_match(quad_key, '0[0-3]*') and image_path is not null group by all")
def src15(spark, d):
    t = table(spark, d, "pyramid_tiles").withColumn("k", tile_key(F.col("image_path"), F.lit(None).cast("string")))
    return t.filter(F.col("quad_key").rlike("^0[0-3]*$") & F.col("k").isNotNull()).groupBy("pyramid_id", "quad_key").agg(F.count(F.lit(1)).alias("n_listed"))
