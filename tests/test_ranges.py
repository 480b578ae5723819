"""Operators that order rows in blocks give the same on one block and on many."""

import numpy as np
from pyspark.sql import functions as F

from quadloom.operators import matching, pyramid, spatial, trace
from quadloom.runtime import Scratch, prefix_sums


def rows(df):
    return sorted(map(str, df.collect()))


def test_routes(spark):
    rng = np.random.default_rng(2)
    pts = [(r, i, float(rng.integers(0, 9)), float(rng.integers(0, 9)), float(i)) for r in (1, 2, 3) for i in range(1 if r == 3 else 40)]
    df = spark.createDataFrame(pts, "route bigint, seq bigint, x double, y double, alt double")
    round_ = lambda d: d.select("route", "k", *[F.round(c, 6).alias(c) for c in ("x", "y", "alt")])
    assert rows(round_(spatial.resample(df, "route", "seq", 2.5))) == rows(round_(spatial.resample(df, "route", "seq", 2.5, block_rows=7)))
    assert spatial.resample(df.limit(0), "route", "seq", 2.5).count() == 0


def test_spans(spark):
    df = spark.createDataFrame([(1, i, i * 10, i * 10 + (25 if i % 4 == 0 else 3)) for i in range(30)] + [(2, 5, 1, None), (2, 9, 4, 6)], "t int, frame bigint, a bigint, b bigint")
    spans = lambda w: rows(trace.frame_spans(df, ["t"], "frame", "a", "b", w))
    assert spans(4) == spans(1000) and len(spans(4)) == 32


def test_sums_and_caches(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5 if i % 6 else None) for i in range(50)], "k bigint, n bigint")
    one = rows(prefix_sums(df, Scratch(spark, "t"), ["k"], "n", "s"))
    assert one == rows(prefix_sums(df, Scratch(spark, "t"), ["k"], "n", "s", block_rows=6))
    held = {r.k for r in pyramid.cached_within(df, "k", "n", 10).filter("cached").collect()}
    total, want = 0, set()
    for i in range(50):
        total += (i * 7) % 5 if i % 6 else 0
        if total <= 10:
            want.add(i)
    assert held == want


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.integers(0, 3, 4)], f"g{i % 3}") for i in range(80)] + [(90, None, "g"), (91, [1.0], "g"), (None, [0.0] * 4, "g")]
    df = spark.createDataFrame(data, "id bigint, v array<double>, g string").repartition(3)
    q = df.filter("id % 4 = 0 and size(v) = 4")
    for group in (None, "g"):
        got = rows(matching.nearest_vectors(df, q, "id", "v", group=group))
        assert got == rows(matching.nearest_vectors(df, q, "id", "v", group=group, block=6))
        brute = set()
        for i, v, g in data[:80]:
            if i % 4 == 0:
                e = sorted((float(np.sqrt(np.mean((np.array(v) - np.array(w)) ** 2))), j) for j, w, h in data[:80] if j != i and not (group and g == h))
                brute |= {(i, j, k + 1) for k, (_, j) in enumerate(e[:2])}
        # the row without an id is no partner
        assert {(r.query_id, r.vec_id, r.rank) for r in matching.nearest_vectors(df, q, "id", "v", group=group).collect()} == brute
    assert matching.nearest_vectors(df, df.limit(0), "id", "v").count() == 0


def _tiles(n, seed=3):
    """Rectangles that often repeat, some thinner than the tolerance and so beside their own kind."""
    rng = np.random.default_rng(seed)
    for k in range(n):
        x, y, w = (int(v) for v in rng.integers(0, 4, 3))
        yield k % 3, k, x + w * 2e-5, float(y), x + (2e-5 if k % 11 == 0 else 1.0), y + 1.0, 0.0 if k % 2 else 0.5, 0.5, 0.5 if k % 2 else 1.0, 1.0


def _meetings(tiles, eps=1e-4):
    near = lambda *p: all(abs(a - b) <= eps for a, b in p)
    for f, a, ax0, ay0, ax1, ay1, *_ in tiles:
        for h, b, bx0, by0, bx1, by1, *_ in tiles:
            if f == h and a != b:
                ys, xs = near((ay0, by0), (ay1, by1)), near((ax0, bx0), (ax1, bx1))
                for s, hit in (("EAST", ys and near((ax1, bx0))), ("WEST", ys and near((ax0, bx1))), ("NORTH", xs and near((ay1, by0))), ("SOUTH", xs and near((ay0, by1)))):
                    if hit:
                        yield f, a, b, s, ((ax0 + ax1 - bx0 - bx1) / 2) ** 2 + ((ay0 + ay1 - by0 - by1) / 2) ** 2
                        break


TILES = "frame_id int, seq bigint, x0 double, y0 double, x1 double, y1 double, u0 double, v0 double, u1 double, v1 double"


def test_neighbours_are_not_gathered_again(spark):
    tiles = list(_tiles(150))
    n = spatial.neighbours(spark.createDataFrame(tiles, TILES))
    assert "Aggregate" not in n._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.frame_id, r.a, r.b, r.direction, round(r.d2, 9)) for r in n.collect()]
    want = {(*m[:4], round(m[4], 9)) for m in _meetings(tiles)}
    assert len(got) == len(want) and set(got) == want and {m[3] for m in want} == set(spatial.SIDES)


def _shuffled(spark, df):
    """Rows that each exchange of a plan wrote."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(was, ("false", "-1")):
            spark.conf.set(k, v)
        q = df.select("*")._jdf.queryExecution()
        q.toRdd().count()
        found, left = [], [q.executedPlan()]
        while left:
            node = left.pop()
            if node.getClass().getSimpleName() == "ShuffleExchangeExec":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            left += [node.children().apply(i) for i in range(node.children().size())]
        return found
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_neighbours_shuffle_three_corners_of_a_tile_once(spark):
    n, eps = 300, 1e-4
    df = spark.createDataFrame([(k % 2, k, float(k % 7), float(k % 6), k % 7 + 1.0, k % 6 + 1.0) for k in range(n)], "frame_id int, seq bigint, x0 double, y0 double, x1 double, y1 double")
    assert _shuffled(spark, spatial.neighbours(df, eps)) == [3 * n]
    # on the edges of cells, and a little to either side of them
    half = spatial.GRID * eps / 2
    edged = [(f, a, x0 + half - 3e-5, y0 - half + 3e-5, x1 + half - 3e-5, y1 - half + 3e-5, *uv) for f, a, x0, y0, x1, y1, *uv in _tiles(90)]
    got = [(r.frame_id, r.a, r.b, r.direction) for r in spatial.neighbours(spark.createDataFrame(edged, TILES), eps).collect()]
    want = {m[:4] for m in _meetings(edged)}
    assert len(got) == len(want) and set(got) == want


def test_best_neighbours_ask_two_tiles_of_a_rectangle(spark):
    tiles = list(_tiles(150))
    df = spark.createDataFrame(tiles, TILES)
    best: dict = {}
    for f, a, b, s, d2 in _meetings(tiles):
        best[f, a, s] = min(best.get((f, a, s), (9e9, 0)), (round(d2, 9), b))
    got = {(r.frame_id, r.a, r.direction): (r.d2, r.b) for r in spatial.best_neighbours(df).collect()}
    assert got == best
    assert spatial._two_of_each(df).groupBy("frame_id", "x0", "y0", "x1", "y1").count().agg(F.max("count")).first()[0] == 2


def test_best_neighbours_shuffle_few_rows(spark):
    n, rects, tasks = 300, 4, 4
    tiles = [(0, k, k % 2 + 0.0, k // 2 % 2 + 0.0, k % 2 + 1.0, k // 2 % 2 + 1.0) for k in range(n)]
    df = spark.createDataFrame(tiles, "frame_id int, seq bigint, x0 double, y0 double, x1 double, y1 double").repartition(tasks).localCheckpoint()
    # three corners of a tile, and its best neighbours on at most two sides here; of a rectangle's tiles at most three a task, then two
    assert max(_shuffled(spark, spatial.best_neighbours(df))) == 3 * n
    assert sum(_shuffled(spark, spatial._two_of_each(df))) <= 3 * rects * tasks + 2 * rects
    # a tile that comes several times is one of the two only once
    twice = df.unionByName(df).unionByName(df)
    assert {(r.x0, r.y0, r.seq) for r in spatial._two_of_each(twice).collect()} == {(t[2], t[3], t[1]) for t in tiles[:8]}
    assert rows(spatial.best_neighbours(twice)) == rows(spatial.best_neighbours(df))


def test_uncles_are_not_gathered_again(spark):
    tiles = list(_tiles(150))
    df = spark.createDataFrame(tiles, TILES)
    pairs = list(_meetings(tiles))
    sides: dict = {}
    for f, a, _, s, _ in pairs:
        sides.setdefault((f, a), set()).add(s)
    half = {t[1]: (("LOW" if t[6] == 0 else "HIGH"), "HIGH") for t in tiles}
    name = lambda s, u: {"EAST": "WEST_NORTH", "WEST": "EAST_NORTH"}.get(s) or f"{'SOUTH' if s == 'NORTH' else 'NORTH'}_{'WEST' if u == 'LOW' else 'EAST'}"
    want = {(f, a, b, name(s, half[b][0])) for f, a, b, s, _ in pairs if len(sides[f, a]) < 4}
    u = spatial.uncles(df)
    assert u._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].startswith("Project")
    got = [tuple(r) for r in u.collect()]
    assert len(got) == len(want) and set(got) == want
    # a tile that comes twice still gives its uncles once
    assert sorted(map(str, spatial.uncles(df.unionByName(df)).collect())) == sorted(map(str, u.collect()))


def test_scores_beyond_a_bigint(spark, tmp_path):
    from quadloom.plans import registry

    keys = [1, 96_037, 96_038, 900_000, 3_000_000_000]
    spark.createDataFrame([(k, 24) for k in keys], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()["mrg4_resolution"](spark, str(tmp_path))
    assert {r.c_custkey: int(r.score) for r in got.collect()} == {k: k * k * 10**9 + 999_999_999 for k in keys} and dict(got.dtypes)["score"] == "decimal(38,0)"
