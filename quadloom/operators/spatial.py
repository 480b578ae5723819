"""Neighbour and identity joins of tile geometry, and equal-distance resampling of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions import geometry as g
from quadloom.runtime import Scratch, range_blocks

# fixed values: precedence of directions when borders of several sides meet
SIDES = ("EAST", "WEST", "NORTH", "SOUTH")


GRID = 16  # cells are so many tolerances wide: one point in eight reaches into the next cell of an axis


def _cell(c: Column, eps: float) -> Column:
    """The grid cell of a coordinate. Round numbers lie in the middle of cells, so few of them are near an edge."""
    return F.floor(c / (GRID * eps) + 0.5).cast("bigint")


def _cells(c: Column, eps: float) -> Column:
    """Grid cells that hold anything within ``eps`` of a coordinate (and a little, for rounding): one, or two near an edge."""
    return F.array_distinct(F.array(*[_cell(c + d, eps) for d in (-1.01 * eps, 1.01 * eps)]))


def _meets(direction: str, eps: float) -> Column:
    """Whether the border of ``a`` on that side agrees with the opposing border of ``b``."""
    at, lo, hi = ("x", "y0", "y1") if direction in ("EAST", "WEST") else ("y", "x0", "x1")
    own, other = (f"{at}1", f"{at}0") if direction in ("EAST", "NORTH") else (f"{at}0", f"{at}1")
    near = lambda p, r: F.abs(F.col(f"a_{p}") - F.col(f"b_{r}")) <= eps
    return near(own, other) & near(lo, lo) & near(hi, hi)


# fixed values: the corner where a tile starts, and those where the next tile to the east and to the north does
START, EASTERN, NORTHERN = 0, 1, 2
MEETING = {"EAST": (EASTERN, START), "WEST": (START, EASTERN), "NORTH": (NORTHERN, START), "SOUTH": (START, NORTHERN)}


def _corners(tiles: DataFrame, eps: float) -> DataFrame:
    """A row for each of three corners of each tile and its cell; the start is in every cell near it."""
    at, near = lambda c: F.array(_cell(F.col(c), eps)), lambda c: _cells(F.col(c), eps)
    row = lambda k, x, y: F.struct(F.lit(k).cast("byte").alias("corner"), x.alias("xs"), y.alias("ys"))
    rows = F.array(row(START, near("x0"), near("y0")), row(EASTERN, at("x1"), at("y0")), row(NORTHERN, at("x0"), at("y1")))
    c = tiles.select("*", F.explode(rows).alias("c")).select(*tiles.columns, "c.*")
    return c.select("*", F.explode("xs").alias("g_x")).select("*", F.explode("ys").alias("g_y")).drop("xs", "ys")


def _meeting(tiles: DataFrame, others: DataFrame, eps: float) -> DataFrame:
    """Every tile of ``tiles`` with every other one of ``others`` that adjoins it: ``frame_id, a, b, direction, d2``.

    Borders meet where one tile starts at the other's eastern or northern corner, so three corners of
    every tile are put on a grid and joined by equality, starts also in the next cell where they are
    within ``eps`` of it; the exact test follows.  Both sides are made alike, so tiles joined with
    themselves are shuffled once.  A pair that meets on several sides has the first one in
    precedence, which the rectangles tell, so pairs are not gathered again.  Further columns of
    ``others`` are handed on.
    """
    rect = ("x0", "y0", "x1", "y1")
    more = [c for c in others.columns if c not in ("frame_id", "seq", *rect)]
    named = lambda d, k, *cs: _corners(d.select("frame_id", "seq", *rect, *cs), eps).select("frame_id", F.col("seq").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in (*rect, "corner")], *cs, "g_x", "g_y")
    met = F.lit(None).cast("int")
    for s in reversed(SIDES):
        met = F.when(_meets(s, eps), 3 * MEETING[s][0] + MEETING[s][1]).otherwise(met)
    one_starts = (F.col("a_corner") == START) != (F.col("b_corner") == START)
    m = named(tiles, "a").join(named(others, "b", *more), ["frame_id", "g_x", "g_y"]).filter(one_starts & (F.col("a") != F.col("b")) & (F.col("a_corner") * 3 + F.col("b_corner") == met))
    side = F.lit(None).cast("string")
    for s, (k, o) in MEETING.items():
        side = F.when((F.col("a_corner") == k) & (F.col("b_corner") == o), s).otherwise(side)
    mid = lambda k, c: (F.col(f"{k}_{c}0") + F.col(f"{k}_{c}1")) / 2
    d2 = (mid("a", "x") - mid("b", "x")) ** 2 + (mid("a", "y") - mid("b", "y")) ** 2
    return m.select("frame_id", "a", "b", side.alias("direction"), d2.alias("d2"), *more)


def _two_of_each(tiles: DataFrame) -> DataFrame:
    """The first two tiles of every rectangle: enough to stand for all of them beside any one tile."""
    rect = ["frame_id", "x0", "y0", "x1", "y1"]
    w = Window.partitionBy(*rect).orderBy("seq")
    # ranked first, so that a task sends a few tiles of a rectangle and not all of them
    return tiles.select("seq", *rect).filter("seq is not null").withColumn("_rank", F.dense_rank().over(w)).filter("_rank <= 2").drop("_rank").distinct()


def neighbours(tiles: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Tiles of one frame whose opposing borders agree within ``eps``: ``frame_id, a, b, direction, d2``.

    ``tiles``: ``frame_id, seq, x0, y0, x1, y1``.  Only corners are shuffled, once; pairs go straight to the result.
    """
    return _meeting(tiles, tiles.select("frame_id", "seq", "x0", "y0", "x1", "y1"), eps)


def best_neighbours(tiles: DataFrame, eps: float = 1e-4, digits: int = 9) -> DataFrame:
    """Closest neighbour of each tile and direction, by ``d2`` to so many digits; the first tile wins ties.

    Tiles of equal rectangles are equally far, so the first two of each are asked for all.
    """
    m = _meeting(tiles, _two_of_each(tiles), eps).withColumn("d2", F.round("d2", digits))
    return m.groupBy("frame_id", "a", "direction").agg(F.min(F.struct("d2", "b")).alias("m")).select("frame_id", "a", "direction", "m.b", "m.d2")


def uncles(tiles: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Uncles of tiles that lack a neighbour: adjoining tiles that show one half of a shared texture.

    ``tiles`` also holds ``u0, v0, u1, v1``.  Lower-left quarters and full textures are no uncles.
    """
    rect = ["frame_id", "seq", "x0", "y0", "x1", "y1"]
    bit = F.coalesce(*[F.when(F.col("direction") == s, F.lit(1 << k)) for k, s in enumerate(SIDES)])
    full = _meeting(tiles, _two_of_each(tiles), eps).groupBy("frame_id", "a").agg(F.bit_or(bit).alias("sides")).filter(F.col("sides") == (1 << len(SIDES)) - 1)
    lacking = tiles.select(*rect).distinct().join(full.select("frame_id", F.col("a").alias("seq")), ["frame_id", "seq"], "left_anti")
    u0, v0, u1, v1 = (F.col(c) for c in ("u0", "v0", "u1", "v1"))
    cand = tiles.withColumn("uh", g.half(u0, u1)).withColumn("vh", g.half(v0, v1)).filter(
        "uh is not null and vh is not null and not (uh = 'LOW' and vh = 'LOW')"
    ).filter(~g.is_full_texture(u0, v0, u1, v1)).select(*rect, "uh", "vh").distinct()
    p = _meeting(lacking, cand, eps).select("frame_id", F.col("a").alias("tile"), F.col("b").alias("uncle"), g.uncle_direction(F.col("direction"), F.col("uh"), F.col("vh")).alias("direction")).filter("direction is not null")
    # a pair comes once where a frame has a tile once
    again = tiles.groupBy("frame_id", "seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return p.distinct() if again else p


def l_shaped_uncles(strips: DataFrame, borders: DataFrame) -> DataFrame:
    """Uncles that show three of four quadrants: the tile must border both arms beside the gap.

    ``strips``: ``uncle, quadrant``; ``borders``: ``tile, uncle, quadrant, direction`` (from tile to strip).
    """
    # fixed values: the gap, and which quadrant must lie on which side of the tile that fills it
    arms = [
        ("WEST_SOUTH", "WEST_NORTH", "NORTH", "EAST_SOUTH", "EAST"), ("WEST_NORTH", "WEST_SOUTH", "SOUTH", "EAST_NORTH", "EAST"),
        ("EAST_SOUTH", "EAST_NORTH", "NORTH", "WEST_SOUTH", "WEST"), ("EAST_NORTH", "EAST_SOUTH", "SOUTH", "WEST_NORTH", "WEST"),
    ]
    quads = F.array(*[F.lit(a[0]) for a in arms])
    three = strips.groupBy("uncle").agg(F.collect_set("quadrant").alias("q")).filter(F.size("q") == 3).select("uncle", F.element_at(F.array_except(quads, "q"), 1).alias("missing"))
    b = borders.join(three, "uncle")
    hit = F.lit(False)
    for gap, q1, d1, q2, d2 in arms:
        hit = hit | ((F.col("missing") == gap) & (((F.col("quadrant") == q1) & (F.col("direction") == d1)) | ((F.col("quadrant") == q2) & (F.col("direction") == d2))))
    both = b.filter(hit).groupBy("tile", "uncle", "missing").agg(F.countDistinct("quadrant").alias("n")).filter("n = 2")
    return both.select("tile", "uncle", F.col("missing").alias("direction"))


def fuzzy_identity(strips: DataFrame, catalog: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Strips and catalog entries whose centres agree within ``eps`` on each axis; the smallest entry where several do.

    Both carry ``x, y``; equality on a grid, strips also in the next cell near an edge, then the test.
    """
    s = strips.select("strip_id", "x", "y", F.explode(_cells(F.col("x"), eps)).alias("gx")).select("*", F.explode(_cells(F.col("y"), eps)).alias("gy"))
    c = catalog.select("entry_id", F.col("x").alias("cx"), F.col("y").alias("cy"), _cell(F.col("x"), eps).alias("gx"), _cell(F.col("y"), eps).alias("gy"))
    m = s.join(c, ["gx", "gy"]).filter((F.abs(F.col("x") - F.col("cx")) <= eps) & (F.abs(F.col("y") - F.col("cy")) <= eps))
    return m.groupBy("strip_id").agg(F.min("entry_id").alias("entry_id"))


def _length() -> Column:
    return F.coalesce(F.sqrt((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2), F.lit(0.0)).alias("len")


def _lengths(p: DataFrame, route: str, seq: str) -> DataFrame:
    """Each point with the next one, the length to it and the length so far, by windows over whole routes."""
    w = Window.partitionBy(route).orderBy(seq)
    p = p.select("*", *[F.lead(c).over(w).alias(f"n{c}") for c in ("x", "y", "alt")]).select("*", _length())
    return p.withColumn("start", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def _lengths_in_ranges(p: DataFrame, route: str, seq: str, blocks: int) -> DataFrame:
    """The same in ranges of rows: the next point and the length so far are carried from range to range."""
    s = Scratch(p.sparkSession, "resample")
    r = range_blocks(p, s, [route, seq], blocks)
    nxt = F.struct(route, "x", "y", "alt")
    heads = r.groupBy("_b").agg(F.min_by(nxt, F.struct(route, seq)).alias("f")).select("_b", F.lead("f").over(Window.orderBy("_b")).alias("_head"))  # a row a block
    p = r.withColumn("_n", F.lead(nxt).over(Window.partitionBy("_b").orderBy(route, seq))).join(F.broadcast(heads), "_b", "left").withColumn("_n", F.coalesce("_n", "_head"))
    p = p.withColumn("_n", F.when(F.col(f"_n.{route}") == F.col(route), F.col("_n")))
    p = s.save(p.select("_b", route, seq, "x", "y", "alt", *[F.col(f"_n.{c}").alias(f"n{c}") for c in ("x", "y", "alt")]).select("*", _length()))
    before = Window.partitionBy(route).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = p.groupBy(route, "_b").agg(F.sum("len").alias("_l")).select(route, "_b", F.coalesce(F.sum("_l").over(before), F.lit(0.0)).alias("_carry"))
    inside = Window.partitionBy("_b", route).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("_in", F.coalesce(F.sum("len").over(inside), F.lit(0.0))).join(carried, [route, "_b"]).withColumn("start", F.col("_in") + F.col("_carry")).drop("_b", "_in", "_carry")


def resample(points: DataFrame, route: str, seq: str, spacing: float, block_rows: int = 1_000_000) -> DataFrame:
    """Points at equal distances along each polyline, ends kept, attributes interpolated.

    ``points``: ``route, seq, x, y, alt`` (planar).  Repeated points are skipped; a route of one point
    gives that point.  More than ``block_rows`` points are ordered in ranges, so a route of any length is
    spread over tasks.
    """
    rows = points.select(route, seq, "x", "y", "alt")
    n = rows.count()
    p = _lengths(rows, route, seq) if n <= block_rows else _lengths_in_ranges(rows, route, seq, n // block_rows + 1)
    first, last = F.ceil(F.col("start") / spacing), F.ceil((F.col("start") + F.col("len")) / spacing) - 1
    steps = F.when((F.col("len") > 0) & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    on = p.select(route, F.explode(steps).alias("k"), "start", "len", "x", "y", "alt", "nx", "ny", "nalt")
    f = (F.col("k") * spacing - F.col("start")) / F.col("len")
    mix = lambda c: F.col(c) + f * (F.col(f"n{c}") - F.col(c))
    inner = on.select(route, "k", mix("x").alias("x"), mix("y").alias("y"), mix("alt").alias("alt"))
    end = p.filter("nx is null").select(route, F.ceil(F.col("start") / spacing).alias("k"), "x", "y", "alt")
    return inner.unionByName(end)
