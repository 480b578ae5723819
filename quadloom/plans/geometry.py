"""Queries on geometry: matrices, strips, neighbours, uncles, geodesy and routes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quadloom.functions import geo, geometry as g
from quadloom.functions.ids import five_digit
from quadloom.operators import spatial
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


r6 = lambda c: F.round(c, 6)


def _mats(spark, d):
    """Two 4x4 matrices an image: the first and the second 16 values of its vector."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.slice(e, 1, 16).alias("m"), F.slice(e, 17, 16).alias("p"))


_MATS = "mats as (select vec_id, (embedding::double[])[1:16] as m, (embedding::double[])[17:32] as p from embeddings)"


@query("sc3_parse_matrix", "select vec_id, case when vec_id % 3 = 0 then null else 16 end as n_values, case when vec_id % 3 = 0 then null else round((vec_id + 15) / 2.0, 6)::double end as last_value from embeddings")
def sc3(spark, d):
    nums = F.transform(F.sequence(F.lit(0), F.when(F.col("vec_id") % 3 == 0, 14).otherwise(15)), lambda i: ((F.col("vec_id") + i) / 2).cast("string"))
    m = g.parse_matrix(F.concat(F.lit("{"), F.array_join(nums, ", "), F.lit("}")))
    return table(spark, d, "embeddings").select("vec_id", F.when(m.isNotNull(), F.size(m)).alias("n_values"), r6(m[15]).alias("last_value"))


@query("sc4_signature", "select vec_id, list_aggregate([case when x = floor(x) then x::bigint || '.0' else rtrim(printf('%.4f', x), '0') end for x in [round_even(vec_id / 8.0, 4)::double, (vec_id % 7)::double]], 'string_agg', '|') as signature from embeddings")
def sc4(spark, d):
    return table(spark, d, "embeddings").select("vec_id", g.signature(F.array(F.col("vec_id") / 8, (F.col("vec_id") % 7).cast("double"))).alias("signature"))


_DOT = "({m}[{a}] * {x} + {m}[{b}] * {y} + {m}[{c}] * {z} + {m}[{d}] * {w})"


def _dot(m, x, y, z, w, r):
    return _DOT.format(m=m, a=r + 1, b=r + 5, c=r + 9, d=r + 13, x=x, y=y, z=z, w=w)


@query("sc5_texture_coordinate", f"with {_MATS}, c as (select vec_id, {_dot('m', '0.25', '0.75', '0', '1', 0)} as s, {_dot('m', '0.25', '0.75', '0', '1', 1)} as t, {_dot('m', '0.25', '0.75', '0', '1', 3)} as q from mats) select vec_id, round(case when abs(q) > 1e-12 then s / q else s end, 6) as u, round(case when abs(q) > 1e-12 then t / q else t end, 6) as v from c")
def sc5(spark, d):
    t = g.texture_coordinate(F.col("m"), F.lit(0.25), F.lit(0.75))
    return _mats(spark, d).select("vec_id", r6(t["u"]).alias("u"), r6(t["v"]).alias("v"))


@query("sc6_projection", f"""with {_MATS}, e as (select vec_id, p, {_dot('m', '0.5', '0.25', '1.0', '1', 0)} as x, {_dot('m', '0.5', '0.25', '1.0', '1', 1)} as y, {_dot('m', '0.5', '0.25', '1.0', '1', 2)} as z, {_dot('m', '0.5', '0.25', '1.0', '1', 3)} as w from mats),
  c as (select vec_id, {_dot('p', 'x', 'y', 'z', 'w', 0)} as cx, {_dot('p', 'x', 'y', 'z', 'w', 1)} as cy, {_dot('p', 'x', 'y', 'z', 'w', 3)} as cw from e)
  select vec_id, round((cx / cw * 0.5 + 0.5) * 1279, 3) as px, round((cy / cw * 0.5 + 0.5) * 719, 3) as py from c where abs(cw) >= 1e-3""")
def sc6(spark, d):
    m, p = F.col("m"), F.col("p")
    at = g.project(m, p, F.lit(0.5), F.lit(0.25), F.lit(1.0), 1280, 720)
    eye = [g.dot_rows(m, F.lit(0.5), F.lit(0.25), F.lit(1.0), F.lit(1.0), r) for r in range(4)]
    w = g.dot_rows(p, *eye, 3)
    return _mats(spark, d).filter(F.abs(w) >= 1e-3).select("vec_id", F.round(at["px"], 3).alias("px"), F.round(at["py"], 3).alias("py"))


@query("sc7_camera", f"""with {_MATS}, c as (select vec_id, m[1] as m0, m[6] as m5, m[11] as m10, m[15] as m14 from mats), f as (select *, degrees(2 * atan(1 / m5)) as fov, abs(m14 / (m10 - 1)) as nr, abs(m14 / (m10 + 1)) as fr, m5 / m0 as asp from c)
  select vec_id, round(case when abs(m5) > 1e-12 and fov > 0.1 and fov < 179 then fov end, 6) as fov, round(case when abs(m10 - 1) > 1e-12 and abs(m10 + 1) > 1e-12 and nr > 1e-6 and fr > nr then nr end, 6) as near,
  round(case when abs(m10 - 1) > 1e-12 and abs(m10 + 1) > 1e-12 and nr > 1e-6 and fr > nr then fr end, 6) as far, round(case when abs(m0) > 1e-12 and abs(m5) > 1e-12 and asp > 0.01 then asp end, 6) as aspect from f""")
def sc7(spark, d):
    c = g.camera(F.col("m"))
    return _mats(spark, d).select("vec_id", *[r6(c[x]).alias(x) for x in ("fov", "near", "far", "aspect")])


@query("sc8_eye_forward", f"with {_MATS}, n as (select *, sqrt(m[3] * m[3] + m[7] * m[7] + m[11] * m[11]) as l from mats) select vec_id, round(-(m[1] * m[13] + m[2] * m[14] + m[3] * m[15]), 6) as eye_x, round(-(m[5] * m[13] + m[6] * m[14] + m[7] * m[15]), 6) as eye_y, round(case when l >= 1e-12 then m[11] / l end, 6) as dir_z from n")
def sc8(spark, d):
    m = F.col("m")
    return _mats(spark, d).select("vec_id", r6(g.eye(m)["x"]).alias("eye_x"), r6(g.eye(m)["y"]).alias("eye_y"), r6(g.forward(m)["z"]).alias("dir_z"))


@query("sc9_perspective", f"with {_MATS} select vec_id, vec_id % 2 = 0 as perspective, round(case when abs(m[11] + 1) > 1e-12 then abs(m[15] / (m[11] + 1)) else -1 end, 6) as far from mats")
def sc9(spark, d):
    m = F.col("m")
    persp = F.transform(m, lambda x, i: F.when(i == 11, F.when(F.col("vec_id") % 2 == 0, -1.0).otherwise(0.0)).when(i == 15, 0.0).otherwise(x))
    return _mats(spark, d).select("vec_id", g.is_perspective(persp).alias("perspective"), r6(g.far_plane(m)).alias("far"))


@query("sc10_epsilon", "select p_partkey, round(greatest(1e-12, least(1e-4, p_retailprice * 1e-9)), 12) as eps from part")
def sc10(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(g.epsilon(F.col("p_retailprice") * 1e-6), 12).alias("eps"))


@query("sc11_topology", "select p_partkey, case when p_size % 4 = 0 then 'other' when p_size % 3 = 0 then 'quad' when p_size % 3 = 1 then 'pole' else 'other' end as topology from part")
def sc11(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", g.topology(F.when(s % 4 == 0, 19).otherwise(20), F.when(s % 3 == 0, 9).when(s % 3 == 1, 7).otherwise(8)).alias("topology"))


@query("sc12_degenerate", "with b as (select vec_id, list_max(embedding[1:8])::double - list_min(embedding[1:8])::double as w, case when vec_id % 5 = 0 then 0 else 1 end as h from embeddings) select vec_id, w <= 1e-9 or h <= 1e-9 as degenerate from b")
def sc12(spark, d):
    x = F.slice("embedding", 1, 8)
    w = F.array_max(x).cast("double") - F.array_min(x).cast("double")
    return table(spark, d, "embeddings").select("vec_id", ((w <= 1e-9) | (F.when(F.col("vec_id") % 5 == 0, 0).otherwise(1) <= 1e-9)).alias("degenerate"))


_UV = "uv as (select p_partkey, p_partkey % 3 * 0.25 + 0.0::double as u0, case p_partkey % 3 when 0 then 0.5 when 1 then 0.75 else 1.0 end::double as u1, (p_size % 2) * 0.5::double as v0, (p_size % 2) * 0.5 + 0.5::double as v1 from part)"


def _uv(spark, d):
    k = F.col("p_partkey") % 3
    v0 = (F.col("p_size") % 2) * 0.5
    return table(spark, d, "part").select("p_partkey", (k * 0.25).alias("u0"), F.when(k == 0, 0.5).when(k == 1, 0.75).otherwise(1.0).alias("u1"), v0.alias("v0"), (v0 + 0.5).alias("v1"))


@query("sc13_half_range", f"with {_UV} select p_partkey, case p_partkey % 3 when 0 then 'LOW' when 2 then 'HIGH' end as u_half, case p_partkey % 3 when 0 then case when v0 < 0.1 then 'WEST_SOUTH' else 'WEST_NORTH' end when 2 then case when v0 < 0.1 then 'EAST_SOUTH' else 'EAST_NORTH' end end as quadrant from uv")
def sc13(spark, d):
    u0, u1, v0, v1 = (F.col(c) for c in ("u0", "u1", "v0", "v1"))
    return _uv(spark, d).select("p_partkey", g.half(u0, u1).alias("u_half"), g.quadrant(u0, v0, u1, v1).alias("quadrant"))


@query("sc14_full_texture", "select vec_id, vec_id % 3 = 0 as full_texture from embeddings")
def sc14(spark, d):
    hi = F.when(F.col("vec_id") % 3 == 0, 0.9995).otherwise(0.99)
    return table(spark, d, "embeddings").select("vec_id", g.is_full_texture(F.lit(0.0005), F.lit(0.0), hi, F.lit(1.0)).alias("full_texture"))


@query("sc15_binary_decode", "select vec_id, [vec_id % 65536, (vec_id * 7) % 65536, 65535]::varchar as shorts, round(vec_id / 4.0, 6)::double as first_float from embeddings")
def sc15(spark, d):
    from quadloom.sources.blobs import decode_f32, decode_u16

    k = F.col("vec_id")
    le = lambda c: F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0"))
    shorts = F.unhex(F.concat(le(k % 65536), le((k * 7) % 65536), F.lit("FFFF")))
    e = table(spark, d, "embeddings").select("vec_id", shorts.alias("b"))
    x = e.select("vec_id", decode_u16(F.col("b")).alias("s"), decode_f32(pack_f32(k / 4)).alias("f"))
    return x.select("vec_id", F.concat(F.lit("["), F.array_join(F.col("s").cast("array<string>"), ", "), F.lit("]")).alias("shorts"), r6(F.col("f")[0].cast("double")).alias("first_float"))


def pack_f32(c):
    from pyspark.sql import types as T

    @F.pandas_udf(T.BinaryType())
    def run(x: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([np.float32(v).tobytes() for v in x])

    return run(c)


def _floats(values):
    """An array of numbers as packed 32-bit floats."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.asarray(v, "<f4").tobytes())

    return run(values)


@query("sc16_texcoords", """select vec_id, n::int as n, round(((vec_id + 2 * n) / 7.0::double)::float::double, 4) as u, case when n < 2 then round(((vec_id + 2 * n + 1) / 7.0::double)::float::double, 4) else 0 end as v
  from embeddings, unnest([0, 1, 2]) as t(n)""")
def sc16(spark, d):
    """Pairs of five packed floats: the last one lacks its second component."""
    from quadloom.sources.blobs import texture_coordinates

    data = _floats(F.array(*[(F.col("vec_id") + i) / 7 for i in range(5)]))
    uv = table(spark, d, "embeddings").select("vec_id", F.posexplode(texture_coordinates(data, F.lit(8), F.lit(2))).alias("n", "p"))
    return uv.select("vec_id", "n", *[F.round(F.col("p")[k].cast("double"), 4).alias(c) for k, c in enumerate("uv")])


@query("sc17_triangle_strips", "select vec_id, ((vec_id % 10) // 3)::int as n_strips from embeddings")
def sc17(spark, d):
    n = F.col("vec_id").cast("int") % 10
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "embeddings").select("vec_id", F.size(g.triangle_strips(idx)).alias("n_strips"))


@query("sc18_line_strips", """with x as (select vec_id, i, (vec_id * 3 + i * i) % 12 as v from embeddings, unnest(range(0, 10)) as t(i)), y as (select *, sum((v >= 10)::int) over (partition by vec_id order by i) as g from x),
  z as (select vec_id, g, string_agg(v::varchar, ',' order by i) as s, count(*) as n from y where v < 10 group by all)
  select e.vec_id, coalesce(string_agg(s, ';' order by g) filter (n > 1), '') as strips from embeddings e left join z using (vec_id) group by e.vec_id""")
def sc18(spark, d):
    from quadloom.sources.blobs import line_strips

    idx = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("vec_id") * 3 + i * i) % 12).cast("int"))
    strips = line_strips(idx, F.lit(10), F.lit("GL_LINE_STRIP"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(strips, lambda x: F.array_join(x.cast("array<string>"), ",")), ";").alias("strips"))


@query("sc20_id_normalize", "select row_id, case when regexp_full_match(trim(content_id), '[0-9]+_[0-9]+') then printf('%05d_%d', split_part(trim(content_id), '_', 1)::bigint, split_part(trim(content_id), '_', 2)::bigint) else trim(content_id) end as id, try_cast(split_part(trim(content_id), '_', 2) as bigint) as suffix from frame_tiles")
def sc20(spark, d):
    from quadloom.functions.ids import id_tile

    return table(spark, d, "frame_tiles").select("row_id", five_digit(F.col("content_id")).alias("id"), id_tile(F.col("content_id")).alias("suffix"))


@query("sc21_frame_of_path", r"select row_id, try_cast(nullif(regexp_extract(texture_file, '/([0-9]+)/[^/]*$', 1), '') as bigint) as frame_no from frame_tiles")
def sc21(spark, d):
    return table(spark, d, "frame_tiles").select("row_id", F.regexp_extract("texture_file", r"/([0-9]+)/[^/]*$", 1).try_cast("bigint").alias("frame_no"))


def _route(spark, d):
    """Route points from orders: latitude and longitude from the key."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("seq"), (k % 1500 / 10 - 75).alias("lat"), (k * 7 % 3600 / 10 - 180).alias("lon"), F.col("o_custkey").alias("route"))


_ROUTE = "route as (select o_orderkey as seq, o_orderkey % 1500 / 10.0::double - 75 as lat, o_orderkey * 7 % 3600 / 10.0::double - 180 as lon, o_custkey as route from orders)"


def _direct_sql() -> str:
    """The direct geodesic of 100 km to the north-east from every route point, its angle refined eight times."""
    a, f = geo.A, geo.FLAT
    b = a * (1 - f)
    out = f"""{_ROUTE}, d0 as (select seq, radians(lat) as p1, radians(lon) as l1, sin(radians(45)) as sa, cos(radians(45)) as ca, (1 - {f!r}) * tan(radians(lat)) as tu from route),
    d1 as (select *, 1 / sqrt(1 + tu * tu) as cu, tu / sqrt(1 + tu * tu) as su, atan2(tu, ca) as s1 from d0), d2 as (select *, cu * sa as al, 1 - cu * sa * cu * sa as c2 from d1),
    d3 as (select *, c2 * ({a!r} * {a!r} - {b!r} * {b!r}) / ({b!r} * {b!r}) as k from d2),
    d4 as (select *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) as ba, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) as bb from d3), g0 as (select *, 100000 / ({b!r} * ba) as sig from d4)"""
    for n in range(8):
        out += f""", m{n} as (select *, cos(2 * s1 + sig) as m from g{n}),
    g{n + 1} as (select * exclude (m, sig), 100000 / ({b!r} * ba) + bb * sin(sig) * (m + bb / 4 * (cos(sig) * (2 * m * m - 1) - bb / 6 * m * (4 * sin(sig) * sin(sig) - 3) * (4 * m * m - 3))) as sig from m{n})"""
    return out + f""", e as (select *, cos(2 * s1 + sig) as m, su * sin(sig) - cu * cos(sig) * ca as t, {f!r} / 16 * c2 * (4 + {f!r} * (4 - 3 * c2)) as c, atan2(sin(sig) * sa, cu * cos(sig) - su * sin(sig) * ca) as lam from g8),
    h as (select seq, degrees(atan2(su * cos(sig) + cu * sin(sig) * ca, (1 - {f!r}) * sqrt(al * al + t * t))) as lat, degrees(l1 + lam - (1 - c) * {f!r} * al * (sig + c * sin(sig) * (m + c * cos(sig) * (2 * m * m - 1)))) as x from e)
    select seq, round(lat, 6) as lat, round((x + 540) - 360 * floor((x + 540) / 360) - 180, 6) as lon from h"""


@query("sc22_direct_geodesic", f"with {_direct_sql()}")
def sc22(spark, d):
    p = geo.direct_udf(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(100000.0))
    return _route(spark, d).select("seq", p.alias("p")).select("seq", r6(F.col("p.lat")).alias("lat"), r6(F.col("p.lon")).alias("lon"))


@query("sc23_inverse_round_trip", f"with {_ROUTE} select seq, 100000::bigint as distance from route")
def sc23(spark, d):
    p = _route(spark, d).select("seq", "lat", "lon", geo.direct_udf(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(100000.0)).alias("p"))
    return p.select("seq", F.round(geo.inverse_udf(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon"))).cast("bigint").alias("distance"))


@query("sc24_normalize_lon", f"with {_ROUTE}, s as (select seq, lon * 3 as x from route) select seq, round(case when x between -180 and 180 then x else x + 180 - 360 * floor((x + 180) / 360) - 180 end, 6) as lon from s")
def sc24(spark, d):
    return _route(spark, d).select("seq", r6(geo.normalize_lon(F.col("lon") * 3)).alias("lon"))


@query("sc25_mercator", f"with {_ROUTE}, m as (select seq, radians(least(greatest(lat, -85.05112878), 85.05112878)) as p from route), y as (select seq, 0.5 - ln(tan(p) + 1 / cos(p)) / (2 * pi()) as y from m) select seq, round(y, 6) as y, round(degrees(atan((exp(pi() * (1 - 2 * y)) - exp(-pi() * (1 - 2 * y))) / 2)), 4) as lat from y")
def sc25(spark, d):
    y = geo.mercator_y(F.col("lat"))
    return _route(spark, d).select("seq", r6(y).alias("y"), F.round(geo.mercator_lat(y), 4).alias("lat"))


@query("sc26_altitude_factor", f"with {_ROUTE} select seq, round(4 - 3 * pow(abs(sin(radians(lat))), 0.4), 6) as factor, round(1 - sqrt(abs(sin(radians(lat)))), 6) as extra from route")
def sc26(spark, d):
    return _route(spark, d).select("seq", r6(geo.altitude_factor(F.col("lat"))).alias("factor"), r6(geo.extra_width(F.col("lat"))).alias("extra"))


@query("sc30_json", """select event_id, json_extract_string(props, '$.k') as k, '{"id":' || event_id || ',"type":"' || event_type || '"}' as doc from events""")
def sc30(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


@query("sc32_line_syntax", r"select event_id, regexp_full_match(event_id || ' gl' || event_type || '(k = ' || case when event_id % 9 = 0 then '' else '1' end || ')', '[0-9]+ gl[A-Za-z0-9_]+\(([A-Za-z_]+ = [^,()]+(, [A-Za-z_]+ = [^,()]+)*)?\)') as valid from events")
def sc32(spark, d):
    line = F.concat("event_id", F.lit(" gl"), "event_type", F.lit("(k = "), F.when(F.col("event_id") % 9 == 0, "").otherwise("1"), F.lit(")"))
    return table(spark, d, "events").select("event_id", line.rlike(r"^[0-9]+ gl[A-Za-z0-9_]+\(([A-Za-z_]+ = [^,()]+(, [A-Za-z_]+ = [^,()]+)*)?\)$").alias("valid"))


@query("agg7_bounding_box", "select label, round(min(list_min(embedding))::double, 6) as low, round(max(list_max(embedding))::double, 6) as high from embeddings group by label")
def agg7(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(r6(F.min(F.array_min("embedding")).cast("double")).alias("low"), r6(F.max(F.array_max("embedding")).cast("double")).alias("high"))


@query("agg8_uv_bounds", "select label, round(least(greatest(min(x), 0), 1), 6) as u0, round(least(greatest(max(x), 0), 1), 6) as u1 from (select label, unnest(embedding)::double as x from embeddings) where isfinite(x) group by label")
def agg8(spark, d):
    x = table(spark, d, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x")).filter(~F.isnan("x") & (F.abs("x") != float("inf")))
    c = lambda v: r6(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    return x.groupBy("label").agg(c(F.min("x")).alias("u0"), c(F.max("x")).alias("u1"))


@query("agg21_edge_centroid", "with v as (select label, embedding[1]::double as x, embedding[2]::double as y, max(embedding[2]::double) over (partition by label) as top from embeddings) select label, round(avg(x), 6) as cx, round(avg(y), 6) as cy, round(avg(x) filter (abs(y - top) <= 0.05), 6) as north_x from v group by label")
def agg21(spark, d):
    v = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    top = v.groupBy("label").agg(F.max("y").alias("top"))
    return v.join(top, "label").groupBy("label").agg(r6(F.avg("x")).alias("cx"), r6(F.avg("y")).alias("cy"), r6(F.avg(F.when(F.abs(F.col("y") - F.col("top")) <= 0.05, F.col("x")))).alias("north_x"))


# tiles of a frame: unit squares on a 7 x 6 grid with a jitter far below the tolerance
_TILES = f"""{_UV}, rects as (select p.p_size as frame_id, p.p_partkey as seq, (p.p_partkey % 7) + (p.p_partkey % 3) * 1e-6 as x0, ((p.p_partkey // 7) % 6)::double as y0, (p.p_partkey % 7) + 1 + (p.p_partkey % 3) * 1e-6 as x1, ((p.p_partkey // 7) % 6 + 1)::double as y1, u0, v0, u1, v1 from part p join uv using (p_partkey)),
sides as (select a.frame_id, a.seq as a, b.seq as b, case when abs(a.x1 - b.x0) <= 1e-4 and abs(a.y0 - b.y0) <= 1e-4 and abs(a.y1 - b.y1) <= 1e-4 then 'EAST' when abs(a.x0 - b.x1) <= 1e-4 and abs(a.y0 - b.y0) <= 1e-4 and abs(a.y1 - b.y1) <= 1e-4 then 'WEST'
  when abs(a.y1 - b.y0) <= 1e-4 and abs(a.x0 - b.x0) <= 1e-4 and abs(a.x1 - b.x1) <= 1e-4 then 'NORTH' when abs(a.y0 - b.y1) <= 1e-4 and abs(a.x0 - b.x0) <= 1e-4 and abs(a.x1 - b.x1) <= 1e-4 then 'SOUTH' end as direction,
  pow((a.x0 + a.x1 - b.x0 - b.x1) / 2, 2) + pow((a.y0 + a.y1 - b.y0 - b.y1) / 2, 2) as d2 from rects a join rects b on a.frame_id = b.frame_id and a.seq <> b.seq),
nb as (select * from sides where direction is not null),
bn as (select * from (select *, row_number() over (partition by frame_id, a, direction order by d2, b) as rn from nb) where rn = 1)"""


def _rects(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("frame_id"), k.alias("seq"), (k % 7 + (k % 3) * 1e-6).alias("x0"), (F.floor(k / 7) % 6).cast("double").alias("y0"), (k % 7 + 1 + (k % 3) * 1e-6).alias("x1"), (F.floor(k / 7) % 6 + 1).cast("double").alias("y1"))
    return p.join(_uv(spark, d), "p_partkey").drop("p_partkey")


@query("jn4_neighbours", f"with {_TILES} select frame_id, a, b, direction from nb")
def jn4(spark, d):
    return spatial.neighbours(_rects(spark, d)).select("frame_id", "a", "b", "direction")


@query("jn5_best_neighbour", f"with {_TILES} select frame_id, a, direction, b from bn")
def jn5(spark, d):
    return spatial.best_neighbours(_rects(spark, d)).select("frame_id", "a", "direction", "b")


SQL["jn5_best_neighbour"] = f"with {_TILES} select frame_id, a, direction, b from (select *, row_number() over (partition by frame_id, a, direction order by round(d2, 9), b) as rn from nb) where rn = 1"


@query("jn6_simple_uncles", f"""with {_TILES}, full_ as (select frame_id, a from bn group by all having count(distinct direction) = 4),
  h as (select frame_id, seq, case when u0 < 0.1 and u1 < 0.6 then 'LOW' when u0 > 0.4 and u1 > 0.9 then 'HIGH' end as uh, case when v0 < 0.1 then 'LOW' else 'HIGH' end as vh from rects)
  select distinct n.frame_id, n.a as tile, n.b as uncle, case direction when 'EAST' then case when vh = 'LOW' then 'WEST_SOUTH' else 'WEST_NORTH' end when 'WEST' then case when vh = 'LOW' then 'EAST_SOUTH' else 'EAST_NORTH' end
    when 'NORTH' then case when uh = 'LOW' then 'SOUTH_WEST' else 'SOUTH_EAST' end else case when uh = 'LOW' then 'NORTH_WEST' else 'NORTH_EAST' end end as direction
  from nb n join h on h.frame_id = n.frame_id and h.seq = n.b where uh is not null and not (uh = 'LOW' and vh = 'LOW') and not exists (select 1 from full_ f where f.frame_id = n.frame_id and f.a = n.a)""")
def jn6(spark, d):
    return spatial.uncles(_rects(spark, d))


@query("jn7_l_shaped_uncles", """with s as (select distinct l_orderkey as uncle, case l_suppkey % 4 when 0 then 'WEST_SOUTH' when 1 then 'WEST_NORTH' when 2 then 'EAST_SOUTH' else 'EAST_NORTH' end as q from lineitem),
  t as (select uncle from s group by 1 having count(*) = 3), gap as (select t.uncle, g.q as missing from t, (values ('WEST_SOUTH'), ('WEST_NORTH'), ('EAST_SOUTH'), ('EAST_NORTH')) as g(q) where not exists (select 1 from s where s.uncle = t.uncle and s.q = g.q)),
  b as (select l_partkey as tile, l_orderkey as uncle, case l_suppkey % 4 when 0 then 'WEST_SOUTH' when 1 then 'WEST_NORTH' when 2 then 'EAST_SOUTH' else 'EAST_NORTH' end as q, case l_linenumber % 4 when 0 then 'NORTH' when 1 then 'EAST' when 2 then 'SOUTH' else 'WEST' end as dir from lineitem where l_linenumber > 0),
  bb as (select uncle % 40 as tile, uncle, q, dir from b), arm(missing, q, dir) as (values ('WEST_SOUTH', 'WEST_NORTH', 'NORTH'), ('WEST_SOUTH', 'EAST_SOUTH', 'EAST'), ('WEST_NORTH', 'WEST_SOUTH', 'SOUTH'), ('WEST_NORTH', 'EAST_NORTH', 'EAST'), ('EAST_SOUTH', 'EAST_NORTH', 'NORTH'), ('EAST_SOUTH', 'WEST_SOUTH', 'WEST'), ('EAST_NORTH', 'EAST_SOUTH', 'SOUTH'), ('EAST_NORTH', 'WEST_NORTH', 'WEST'))
  select bb.tile, bb.uncle, gap.missing as direction from bb join gap using (uncle) join arm a on a.missing = gap.missing and a.q = bb.q and a.dir = bb.dir group by all having count(distinct bb.q) = 2""")
def jn7(spark, d):
    li = table(spark, d, "lineitem")
    q = F.element_at(F.array(*[F.lit(x) for x in ("WEST_SOUTH", "WEST_NORTH", "EAST_SOUTH", "EAST_NORTH")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    dirs = F.element_at(F.array(*[F.lit(x) for x in ("NORTH", "EAST", "SOUTH", "WEST")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    strips = li.select(F.col("l_orderkey").alias("uncle"), q.alias("quadrant")).distinct()
    borders = li.select((F.col("l_orderkey") % 40).alias("tile"), F.col("l_orderkey").alias("uncle"), q.alias("quadrant"), dirs.alias("direction"))
    return spatial.l_shaped_uncles(strips, borders)


@query("jn8_fuzzy_identity", "with c as (select p_partkey as entry_id, (p_partkey % 45) * 0.01::double as x, (p_partkey // 45) * 0.01::double as y from part), s as (select c_custkey as strip_id, (c_custkey % 45) * 0.01::double + (c_custkey % 3) * 0.00004 as x, (c_custkey // 45) * 0.01::double - (c_custkey % 5) * 0.00003 as y from customer) select strip_id, min(entry_id) as entry_id from s join c on abs(s.x - c.x) <= 1e-4 and abs(s.y - c.y) <= 1e-4 group by 1")
def jn8(spark, d):
    at = lambda k: ((F.col(k) % 45) * 0.01, F.floor(F.col(k) / 45) * 0.01)
    x, y = at("p_partkey")
    c = table(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), x.alias("x"), y.alias("y"))
    x, y = at("c_custkey")
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("strip_id"), (x + (F.col("c_custkey") % 3) * 0.00004).alias("x"), (y - (F.col("c_custkey") % 5) * 0.00003).alias("y"))
    return spatial.fuzzy_identity(s, c)


@query("ded8_repeated_points", "with p as (select o_custkey as route, o_orderkey as seq, (o_orderkey // 3) % 5 as x, lag((o_orderkey // 3) % 5) over (partition by o_custkey order by o_orderkey) as px from orders) select route, seq, x from p where px is null or abs(x - px) > 1e-12")
def ded8(spark, d):
    from pyspark.sql import Window

    x = F.expr("(o_orderkey div 3) % 5")
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("seq"), x.alias("x"))
    p = p.withColumn("px", F.lag("x").over(Window.partitionBy("route").orderBy("seq")))
    return p.filter(F.col("px").isNull() | (F.abs(F.col("x") - F.col("px")) > 1e-12)).select("route", "seq", "x")


_RES = """p as (select o_custkey as route, o_orderkey as seq, (o_orderkey % 1500)::double as x, (o_orderkey * 7 % 1000)::double as y, (o_orderkey % 10)::double as alt from orders),
q as (select *, lead(x) over w as nx, lead(y) over w as ny, lead(alt) over w as nalt from p window w as (partition by route order by seq)),
l as (select *, coalesce(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)), 0) as len from q), s as (select *, coalesce(sum(len) over (partition by route order by seq rows between unbounded preceding and 1 preceding), 0) as start from l)"""


@query("gen7_resample", f"""with {_RES}, inner_ as (select route, k, x + (k * 250 - start) / len * (nx - x) as x, alt + (k * 250 - start) / len * (nalt - alt) as alt from s, unnest(range(ceil(start / 250)::bigint, ceil((start + len) / 250)::bigint)) as t(k) where len > 0)
  select route, k::bigint as k, round(x, 4) as x, round(alt, 4) as alt from inner_ union all select route, ceil(start / 250)::bigint, round(x, 4), round(alt, 4) from s where nx is null""")
def gen7(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    p = o.select(F.col("o_custkey").alias("route"), k.alias("seq"), (k % 1500).cast("double").alias("x"), (k * 7 % 1000).cast("double").alias("y"), (k % 10).cast("double").alias("alt"))
    return spatial.resample(p, "route", "seq", 250.0).select("route", "k", F.round("x", 4).alias("x"), F.round("alt", 4).alias("alt"))


@query("gen5_altitude_ladder", """with recursive r(t, n, a) as (select t, 0, 16000000.0::double from (values (500000.0::double), (20000.0), (9000000.0)) as v(t) union all select t, n + 1, a / 2 from r where n < 15 and abs(a / 2 - 2 * t) < abs(a - 2 * t)) select t as target, n as level, a as altitude from r""")
def gen5(spark, d):
    rows = [(t, n, a) for t in (500000.0, 20000.0, 9000000.0) for n, a in enumerate(geo.altitude_ladder(t))]
    return spark.createDataFrame(rows, "target double, level int, altitude double")


@query("gen6_seam", "select (90 - i)::bigint as lat, -180::bigint as lon from unnest(range(0, 181)) as t(i)")
def gen6(spark, d):
    return spark.range(181).select((90 - F.col("id")).alias("lat"), F.lit(-180).cast("bigint").alias("lon"))


def _points(spark, pts):
    return spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(pts)], "seq bigint, lat double, lon double")


@query("gen1_spiral")
def gen1(spark, d):
    return _points(spark, geo.spiral(10.0, 20.0, 2000.0, 60000.0))


@query("gen2_zigzag")
def gen2(spark, d):
    return _points(spark, geo.zigzag(10.0, 20.0, 2000.0, 200.0, 10))


@query("gen3_rectangle_zigzag", "with r as (select i, least(-20 + i * 0.75, 3)::double as lat from unnest(range(0, 32)) as t(i)) select (2 * i)::bigint as seq, lat, case when i % 2 = 0 then -60.0 else -30.0 end::double as lon from r union all select 2 * i + 1, lat, case when i % 2 = 0 then -30.0 else -60.0 end from r")
def gen3(spark, d):
    return _points(spark, geo.rectangle_zigzag(-20.0, -60.0, 3.0, -30.0, 0.75))


@query("gen4_globe", """with r as (select r, degrees(atan(sinh(pi() * (1 - 2 * (r + 0.5) / 24)))) as lat from unnest(range(0, 24)) as t(r)), m as (select *, 1 - sqrt(abs(sin(radians(lat)))) as g from r),
  p as (select r, c, lat, -180 - g + (360 + 2 * g) * (case when r % 2 = 0 then c else 47 - c end) / 47.0::double as x from m, unnest(range(0, 48)) as t(c))
  select (r * 48 + c)::bigint as seq, round(lat, 6) as lat, round((x + 540) - 360 * floor((x + 540) / 360) - 180, 6) as lon from p""")
def gen4(spark, d):
    return _points(spark, geo.globe_serpentine(24, 48)).select("seq", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


@query("snk9_route_names", f"with {_ROUTE} select seq, 'L' || (seq % 16) || '/z' || lpad((seq % 10000)::varchar, 4, '0') as marker, round(abs(lat) * 3, 6) as altitude from route")
def snk9(spark, d):
    return _route(spark, d).select("seq", F.concat(F.lit("L"), F.col("seq") % 16, F.lit("/z"), F.lpad((F.col("seq") % 10000).cast("string"), 4, "0")).alias("marker"), r6(F.abs("lat") * 3).alias("altitude"))


@query("srt2_visual_columns", """with recursive v as (select l_orderkey, list_sort(list((l_partkey % 40)::double)) as x from lineitem group by 1),
  t as (select *, greatest(1.0, (x[len(x)] - x[1]) * 0.1) as tol from v),
  r(l_orderkey, i, mean, n, c) as (select l_orderkey, 1, x[1], 1, 1 from t
    union all select r.l_orderkey, i + 1, case when abs(mean - x[i + 1]) <= tol then (mean * n + x[i + 1]) / (n + 1) else x[i + 1] end, case when abs(mean - x[i + 1]) <= tol then n + 1 else 1 end, case when abs(mean - x[i + 1]) <= tol then c else c + 1 end
    from r join t using (l_orderkey) where i < len(x))
  select l_orderkey, max(c)::int as n_columns from r group by 1""")
def srt2(spark, d):
    """Clusters of tile centres along one axis, tolerance the larger of 1 and a tenth of the range."""
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 40).cast("double")).alias("x"))
    tol = F.greatest(F.lit(1.0), (F.array_max("x") - F.array_min("x")) * 0.1)
    return v.select("l_orderkey", F.size(g.running_clusters(F.col("x"), tol)).alias("n_columns"))


@query("mtx23_top_level_rebuild", """with cells as (select r, c, (c + 0.5) / 20.0 as x, (r + 0.5) / 16.0 as y from unnest(range(0, 16)) as a(r), unnest(range(0, 20)) as b(c)),
  im as (select n_nationkey as image, n_nationkey % 3 as level, (n_nationkey % 4) * 0.2 as x0, (n_nationkey % 4) * 0.2 + 0.6 / (1 + n_nationkey % 3) as x1, (n_nationkey % 5) * 0.15 as y0, (n_nationkey % 5) * 0.15 + 0.6 / (1 + n_nationkey % 3) as y1 from nation)
  select r::bigint as grid_row, c::bigint as grid_col, arg_max(image, row(level, -image)) as image from cells join im on x >= x0 and x < x1 and y >= y0 and y < y1 group by r, c""")
def mtx23(spark, d):
    """Deepest image that contains each cell of the fixed 16 x 20 grid: images are spread over the cells they cover."""
    k = F.col("n_nationkey")
    side = 0.6 / (1 + k % 3)
    im = table(spark, d, "nation").select(k.alias("image"), (k % 3).alias("level"), ((k % 4) * 0.2).alias("x0"), ((k % 4) * 0.2 + side).alias("x1"), ((k % 5) * 0.15).alias("y0"), ((k % 5) * 0.15 + side).alias("y1"))
    span = lambda lo, hi, n: F.sequence(F.greatest(F.floor(lo * n) - 1, F.lit(0)), F.least(F.floor(hi * n) + 1, F.lit(n - 1)))
    c = im.select("*", F.explode(span(F.col("y0"), F.col("y1"), 16)).alias("grid_row")).select("*", F.explode(span(F.col("x0"), F.col("x1"), 20)).alias("grid_col"))
    x, y = (F.col("grid_col") + 0.5) / 20, (F.col("grid_row") + 0.5) / 16
    c = c.filter((x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1")))
    return c.groupBy("grid_row", "grid_col").agg(F.max_by("image", F.struct("level", (-F.col("image")).alias("i"))).alias("image"))
