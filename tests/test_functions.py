"""Exact cases of scalar functions, graph rounds, sweeps, sources and streams."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.functions import callset, calls, geo, quadkey
from quadloom.functions.ids import bare_quadkey, canonical_path, five_digit, tile_key
from quadloom.operators import graph, matching, matrices, quality, trace
from quadloom.sources import blobs, frames, traces
from quadloom.streaming import activity


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_call_sets(tmp_path):
    (tmp_path / "set").write_text("5\n7-9\n")
    r = callset.parse(f"@{tmp_path}/set, 100-, */10, 20-40/draw, frame")
    hit = lambda no, flags=0: any(x.contains(no, flags) for x in r)
    assert [n for n in range(12) if hit(n)] == [0, 5, 7, 8, 9, 10]
    assert hit(1000) and hit(21, callset.RENDER) and not hit(21) and hit(3, callset.END_FRAME)
    for bad in ("x", "4-x", "*/never", "a b"):
        with pytest.raises(ValueError):
            callset.parse(bad)
    assert callset.CallSet("1-5").ranges and not callset.CallSet("1-5").merge("").ranges


def test_ids_and_paths(spark):
    r = one(spark, five_digit(F.lit(" 7_030 ")).alias("a"), five_digit(F.lit("123456_1")).alias("b"), five_digit(F.lit("x_1")).alias("c"), five_digit(F.lit(None).cast("string")).alias("d"), canonical_path(F.lit("/a//b/./c/../../d")).alias("e"), bare_quadkey(F.lit(" 1/2/012.png ")).alias("f"), bare_quadkey(F.lit("04")).alias("g"), tile_key(F.lit(None).cast("string"), F.lit("/other.bin")).alias("h"))
    assert tuple(r) == ("00007_30", "123456_1", "x_1", None, "/a/d", "012", None, "F|/other.bin")


# fixed values: known quadkeys with depth, column, row from the south, longitude, latitude
@pytest.mark.parametrize("key,want", [("0", (0, 0, 0, -180.0, -90.0)), ("01", (1, 1, 0, 0.0, -90.0)), ("02", (1, 1, 1, 0.0, 0.0)), ("03", (1, 0, 1, -180.0, 0.0)), ("002", (2, 1, 1, -90.0, -45.0))])
def test_quadkeys(spark, key, want):
    k = F.lit(key)
    assert tuple(one(spark, quadkey.depth(k), quadkey.column(k), quadkey.south_row(k), quadkey.lon(k), quadkey.lat(k))) == want


def test_layouts(spark):
    modes = [(2, 1920, 1080, "NATIVE", 256, False), (3, 1920, 1080, "SCALED", 128, False), (9, 1920, 1080, "COVERAGE", 1, False), (10, 1920, 1080, "COVERAGE", 1, False), (11, 1920, 1080, "COVERAGE", 1, True), (8, 1536, 1536, "SCALED", 4, False)]
    for d, w, h, mode, px, scroll in modes:
        r = one(spark, quadkey.level_layout(F.lit(d), w, h).alias("l"))["l"]
        assert (r["mode"], r["image_px"], r["scrollable"]) == (mode, px, scroll)


@given(st.integers(1, 16), st.integers(1, 20))
def test_grid_paths_are_distinct(rows, cols):
    assert len({quadkey.grid_path(r, c, rows, cols) for r in range(rows) for c in range(cols)}) == rows * cols


def test_geodesics():
    lat, lon = np.array([0.0, 45.0, -60.0]), np.array([0.0, 170.0, 10.0])
    p, q = geo.direct(lat, lon, np.array([90.0, 60.0, 200.0]), np.array([1000.0, 3e6, 5e5]))
    assert np.allclose(geo.inverse(lat, lon, p, q), [1000.0, 3e6, 5e5], atol=1e-4)
    assert geo.inverse([0.0], [0.0], [0.0], [179.9])[0] > 1.9e7 and geo.inverse([1.0], [1.0], [1.0], [1.0])[0] == 0
    s = geo.spiral(0.0, 0.0, 100.0, 950.0)
    legs = geo.inverse([a for a, _ in s[:-1]], [b for _, b in s[:-1]], [a for a, _ in s[1:]], [b for _, b in s[1:]])
    assert np.allclose(legs.sum(), 950.0, atol=1e-3) and np.allclose(legs[:4], [100, 100, 200, 200], atol=1e-3)
    assert geo.altitude_ladder(4_000_000.0) == [16e6, 8e6]


def test_placed_components(spark):
    # a chain, a ring, a contradiction, and a repeated link
    links = [(i, i + 1, 1, 0) for i in range(30)] + [(100, 101, 0, 1), (101, 102, 0, 1), (100, 102, 0, 2), (100, 102, 0, 2)] + [(200, 201, 1, 0), (200, 201, 2, 0), (5, None, 0, 0), (7, 7, 3, 3)]
    df = spark.createDataFrame(links, "u bigint, v bigint, di int, dj int")
    p = graph.placed_components(df)
    got = {r.v: (r.root, r.di, r.dj) for r in p.collect()}
    assert {k: v for k, v in got.items() if k <= 30} == {i: (0, i, 0) for i in range(31)}
    assert got[102] == (100, 0, 2) and got[201][0] == 200
    assert graph.inconsistent_links(df.filter("u is not null and v is not null and u <> v"), p).count() == 1
    assert graph.placed_components(df.limit(0)).count() == 0


def test_merge_sweep_and_order():
    a = [(1, 0, 0), (2, 0, 1)]
    b = [(2, 0, 0), (3, 0, 1)]
    c = [(3, 5, 5), (4, 5, 6)]
    clash = [(1, 0, 0), (9, 0, 1)]  # would put 9 where 2 lies
    got = matrices.merge_sweep([(10, a), (20, c), (30, b), (40, clash)])
    assert {(t, i, j) for m, t, i, j in got if m != 40} == {(1, 0, 0), (2, 0, 1), (3, 0, 2), (4, 0, 3)} and len({m for m, *_ in got}) == 2
    assert {t for m, t, _, _ in got if m == 40} == {1, 9}
    order = matrices.priority_order({30: {20}, 10: set(), 20: {10}, 90: set()}, {k: (k,) for k in (10, 20, 30, 90)})
    assert order == [(10, 0, 0), (20, 1, 1), (30, 2, 2), (90, 3, 0)]
    assert matrices.priority_order({1: {2}, 2: {1}}, {1: (1,), 2: (2,)}) == [(1, 0, -1), (2, 1, -1)]
    assert matrices.priority_order({1: set(), 2: set(), 3: {1, 2}}, {k: (k,) for k in (1, 2, 3)})[2] == (3, 2, -1)


def test_west_split(spark):
    cells = spark.createDataFrame([(1, t, 0, t - 1) for t in (1, 2, 3, 4)], "matrix_id bigint, tile_id bigint, i int, j int")
    got = {(r.tile_id, r.j, r.part) for r in matrices.west_split(cells, spark.createDataFrame([(3,)], "tile_id bigint")).collect()}
    assert got == {(1, 0, "transient"), (2, 1, "transient"), (3, 0, "main"), (4, 1, "main")}


def test_logical_lines():
    text = 'glA(x = "a(\\"b",\n  y = 2)\n\n// note (\nglB()\nglC(s = "open\nend")\nglD(('
    assert list(trace.logical_lines(text)) == ['glA(x = "a(\\"b",\\n  y = 2)', "", "// note (", "glB()", 'glC(s = "open\\nend")', "glD(("]


def test_two_level_frames(spark):
    c = spark.createDataFrame([(n, 32 if n % 3 == 0 else 0) for n in range(100)], "call_no bigint, flags int")
    a = {r.call_no: r.frame_id for r in trace.frame_assign(c, chunk=7).collect()}
    assert a == {n: (n + 2) // 3 for n in range(100)}
    assert trace.frame_assign(c.limit(0)).count() == 0


def test_asof_blocks(spark):
    t = spark.createDataFrame([("a", 10, "p10"), ("a", 5000, "p5000"), ("b", 3, "q3"), ("a", None, "no")], "id string, v bigint, path string")
    q = spark.createDataFrame([("a", 9), ("a", 10), ("a", 4999), ("a", 999999), ("b", 2), ("c", 1)], "id string, at bigint")
    got = {(r.id, r.at): r.path for r in matching.asof_path(q, t, "id", "at", "v", "path", width=100).collect()}
    assert got == {("a", 9): "p10", ("a", 10): "p10", ("a", 4999): "p10", ("a", 999999): "p5000", ("b", 2): "q3", ("c", 1): None}


def test_nearest_vectors_in_blocks(spark):
    rows = [(i, [float(i), 0.0]) for i in range(10)] + [(50, None), (51, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in matching.nearest_vectors(df, df.filter("vec_id < 4"), "vec_id", "embedding", block=2).collect()}
    assert got[(0, 1)] == 1 and got[(3, 1)] == 2 and got[(3, 2)] == 4 and len(got) == 8


def test_gates(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "k int, v int")
    assert {(r.k, r.rule) for r in quality.violations(df, "k", {"pos": F.col("v") > 0}).collect()} == {(2, "pos"), (3, "pos")}
    assert quality.space_needed(10, 20) == (40 + (1 << 30), 20 + (64 << 20))


def test_trace_source(spark, tmp_path):
    import gzip

    data = traces.write_trace([(1, "glA", {"x": 1, "y": [1, -2.5, None, "s"]}, True), (2, "glB", {}, None), (1, "glA", {"x": -7, "y": []}, 3)])
    (tmp_path / "a.trace").write_bytes(data)
    (tmp_path / "b.trace").write_bytes(gzip.compress(data[:-2]))  # cut short: the last call never left
    rows = traces.read_traces(spark, f"{tmp_path}/*.trace").collect()
    a = [r for r in rows if r.path.endswith("a.trace")]
    assert [(r.call_no, r.thread_id, r.name, json.loads(r.args)) for r in a] == [(0, 1, "glA", {"x": 1, "y": [1, -2.5, None, "s"]}), (1, 2, "glB", {}), (2, 1, "glA", {"x": -7, "y": []})]
    assert sum(not r.complete for r in rows) == 1


def test_blob_functions(spark):
    r = one(spark, blobs.decode_u16(F.lit(bytearray(b"\x01\x00\xff\xff\x07"))).alias("a"), blobs.to_rgba(F.lit(bytearray(b"\x01\x02\x03")), F.lit("GL_BGR")).alias("b"), blobs.line_strips(F.array(*[F.lit(i) for i in (0, 1, 99, 2, 3, 4)]), F.lit(10), F.lit("GL_LINE_LOOP")).alias("c"))
    assert r["a"] == [1, 65535] and bytes(r["b"]) == b"\x03\x02\x01\xff" and r["c"] == [[0, 1], [2, 3, 4, 2]]
    assert blobs.plain_bytes(b"BZhbroken") is None


def test_folder_readers(spark, tmp_path):
    for n in (1, 2, 30):
        d = tmp_path / f"{n:05d}"
        d.mkdir()
        (d / "gl.txt").write_text(f"line {n}\nsecond\n")
        (d / "frame.json").write_text(json.dumps({"id": f"frame {n}", "tiles": [{"contentId": f"{n}_1"}]}))
        (d / "matrix.json").write_text(json.dumps({"contractVersion": 2, "frameId": n, "matrices": [{"rows": 1, "cols": 2, "tiles": [{"id": f"{n}_1", "i": 0, "j": 0}, {"id": f"{n}_2", "i": 0, "j": 1}]}, {"rows": 0, "cols": 0, "tiles": []}]}))
        (d / "manifest.txt").write_text("kind=vertex call=3 bytes=12\n")
    (tmp_path / "cuts.json").write_text('["7_1", 9, "00007_1"]')
    p = str(tmp_path)
    assert frames.read_frame_lines(spark, p, first=2, last=29).count() == 2
    assert {(r.frame_id, r.contentId) for r in frames.read_frames(spark, p).collect()} == {(1, "1_1"), (2, "2_1"), (30, "30_1")}
    assert frames.read_matrices(spark, p).filter("tile_id = '00002_2' and j = 1").count() == 1
    assert frames.read_manifests(spark, p).first()["fields"]["call"] == "3"
    assert {r.tile_id for r in frames.read_cutters(spark, f"{p}/cuts.json").collect()} == {"00007_1", "9"}
    for key in ("0", "1/01", "01/012/012"):
        f = tmp_path / "pyr" / f"{key}.png"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    assert {(r.quadkey, r.layout) for r in frames.read_pyramid(spark, f"{p}/pyr").collect()} == {("0", "digit"), ("01", "digit"), ("012", "cumulative")}
    (tmp_path / "m.kml").write_text("<kml><Folder><name>turtle</name><Placemark><name>a</name></Placemark><Placemark><name>b</name></Placemark></Folder></kml>")
    assert frames.count_placemarks(spark, f"{p}/m.kml").first()[0] == 2


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s), x, u) for s, x, u in ((0, "ok", 1.0), (1, "ERROR no", 2.0), (9, "ERROR no", 90.0), (500, "done", 95.0))]
    src = tmp_path / "in"
    src.mkdir()
    for i, (k, ts, line, used) in enumerate(rows):
        f = src / f"{i}.json"
        f.write_text(json.dumps({"k": k, "ts": str(ts), "line": line, "used": used}))
        os.utime(f, (1e9 + i, 1e9 + i))
    e = lambda: activity.file_events(spark, str(src), "k string, ts timestamp, line string, used double", files_per_trigger=1)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert [r.n_events for r in sorted(run(activity.inactivity_sessions(e(), "k", "ts", "2 seconds", "0 seconds"), "s1"), key=lambda r: r.first_ts)] == [2, 1]
    assert {r.outcome for r in run(activity.outcomes(e(), "k", "ts", "line", {"failed": "ERROR", "finished": "done"}), "s2")} == {"failed", "finished"}
    assert "ok" not in {r.alert for r in run(activity.growth_alerts(e(), "ts", "used", 100.0, "1 minute", "0 seconds"), "s3")}


def test_call_flags(spark):
    names = {"glDrawElementsInstancedARB": 8, "glMultiDrawArrays": 8, "glClear": 8, "glBindFramebufferEXT": 16, "glGetIntegerv": 4, "glXSwapBuffers": 48, "glGetError": 4, "glGetHandleARB": 4, "glGetHistogram": 0, "glGetHistogramEXT": 4, "glVertex": 0, "IDXGISwapChain1::Present1": 32}
    for n, f in names.items():
        assert one(spark, calls.call_flags(F.lit(n)))[0] == f
    assert calls.sed_expression("s,a/b,c,") == ("a/b", "c")
