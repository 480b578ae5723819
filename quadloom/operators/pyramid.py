"""Operators on tile pyramids: coverage, ancestors, difference and conflict-checked merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import quadkey as qk
from quadloom.runtime import Scratch, prefix_sums

RMSE_LIMIT = 0.03  # fixed value: tiles up to this normalized error look alike


def bounds_by_depth(tiles: DataFrame) -> DataFrame:
    k = F.col("quadkey")
    return tiles.filter(qk.is_valid(k)).groupBy(qk.depth(k).alias("tile_depth")).agg(
        F.min(qk.column(k)).alias("min_col"), F.max(qk.column(k)).alias("max_col"), F.min(qk.south_row(k)).alias("min_row"), F.max(qk.south_row(k)).alias("max_row"), F.count(F.lit(1)).alias("n_tiles"),
    )


def nearest_ancestor(targets: DataFrame, tiles: DataFrame, depth_limit: Column | None = None) -> DataFrame:
    """Deepest existing tile at or above each target (``quadkey``), at most ``depth_limit`` deep.

    Prefixes are exploded and joined by equality: depth rows a target instead of a prefix comparison
    with every tile.  Targets without any ancestor keep null.
    """
    limit = depth_limit if depth_limit is not None else qk.depth(F.col("quadkey"))
    t = targets.select("quadkey", limit.alias("_limit")).distinct()
    asked = t.select("quadkey", F.explode(F.filter(qk.prefixes(F.col("quadkey")), lambda p: qk.depth(p) <= F.col("_limit"))).alias("ancestor"))
    present = tiles.select(F.col("quadkey").alias("ancestor")).distinct()
    found = asked.join(present, "ancestor").groupBy("quadkey").agg(F.max_by("ancestor", F.length("ancestor")).alias("ancestor"))
    return t.select("quadkey").join(found, "quadkey", "left")


def source_region(resolved: DataFrame) -> DataFrame:
    """Pixel rectangle of each target cell inside its ancestor's image, at least one pixel."""
    k, a = F.col("quadkey"), F.col("ancestor")
    delta = qk.depth(k) - qk.depth(a)
    parts = F.pow(F.lit(2), F.least(delta, F.lit(30))).cast("bigint")
    cut = lambda x: F.floor(x * qk.TILE / parts)
    col = qk.column(k) - qk.column(a) * F.pow(F.lit(2), delta).cast("bigint")
    row = qk.south_row(k) - qk.south_row(a) * F.pow(F.lit(2), delta).cast("bigint")
    r = resolved.filter("ancestor is not null").select("quadkey", "ancestor", cut(col).alias("x0"), cut(col + 1).alias("x1"), (qk.TILE - cut(row + 1)).alias("y0"), (qk.TILE - cut(row)).alias("y1"))
    grow = lambda lo, hi: F.when(F.col(hi) <= F.col(lo), F.least(F.lit(qk.TILE), F.col(lo) + 1)).otherwise(F.col(hi)).cast("bigint")
    return r.select("quadkey", "ancestor", F.col("x0").cast("bigint").alias("x0"), grow("x0", "x1").alias("x1"), F.col("y0").cast("bigint").alias("y0"), grow("y0", "y1").alias("y1"))


def leaves(tiles: DataFrame) -> DataFrame:
    """Tiles to draw in full: those without children, and virtual children for holes below the others."""
    t = tiles.select("quadkey").distinct()
    kids = t.filter(F.length("quadkey") > 1).select(qk.parent(F.col("quadkey")).alias("quadkey"), F.col("quadkey").alias("kid"))
    with_kids = t.join(kids, "quadkey").groupBy("quadkey").agg(F.collect_set("kid").alias("kids"))  # at most four
    plain = t.join(with_kids, "quadkey", "left_anti").select("quadkey", F.lit(False).alias("is_virtual"))
    holes = with_kids.select(F.explode(F.array_except(F.transform(F.array(*[F.lit(str(i)) for i in range(4)]), lambda x: F.concat("quadkey", x)), "kids")).alias("quadkey"), F.lit(True).alias("is_virtual"))
    return plain.unionByName(holes)


def diff(delta: DataFrame, dest: DataFrame) -> DataFrame:
    """Every delta tile beside the destination's tile of the same key, if there is one."""
    d = dest.select("quadkey", F.col("content").alias("dest_content"), F.col("score").alias("dest_score"), F.lit(True).alias("in_dest"))
    return delta.select("quadkey", "content", "score").join(d, "quadkey", "left")


def classify(compared: DataFrame, error: Column) -> DataFrame:
    """new, identical, equivalent or conflict, in that order."""
    kind = F.when(F.col("in_dest").isNull(), "new").when(F.col("content").eqNullSafe(F.col("dest_content")), "identical").when(error <= RMSE_LIMIT, "equivalent").otherwise("conflict")
    return compared.withColumn("kind", kind)


MOST_PIXELS = ((1 << 63) - 1) // 1_000_000_000 - 1  # a score of more is no bigint


def resolution_score(pixels: Column, n_bytes: Column, wide: bool = False) -> Column:
    """More pixels win; among equal pixels more bytes, capped below one pixel's worth.

    A bigint up to ``MOST_PIXELS``; ``wide`` scores are decimal(38,0) and hold any bigint of pixels.
    """
    p, b = (pixels.cast("decimal(19,0)"), F.least(n_bytes, F.lit(999_999_999)).cast("decimal(19,0)")) if wide else (pixels, F.least(n_bytes, F.lit(999_999_999)))
    score = p * (F.lit(1_000_000_000).cast("decimal(10,0)") if wide else 1_000_000_000) + b
    return score.cast("decimal(38,0)") if wide else score


def upsert(classified: DataFrame, dest: DataFrame, replace: Column) -> DataFrame:
    """The merged pyramid: destination tiles, new delta tiles, and delta content where ``replace`` holds.

    All or nothing: with any conflict the destination comes back unchanged (the flag is one scalar of
    the same plan, nothing is gathered on the driver).
    """
    gate = classified.agg((F.count_if(F.col("kind") == "conflict") == 0).alias("_ok"))
    change = classified.withColumn("_r", replace).select("quadkey", F.col("content").alias("_c"), "kind", "_r")
    both = dest.select("quadkey", "content", F.lit(True).alias("_d")).join(change, "quadkey", "full_outer").join(F.broadcast(gate))
    take = F.col("_ok") & F.col("kind").isNotNull() & (F.col("_d").isNull() | F.coalesce("_r", F.lit(False)))
    return both.filter(F.col("_d").isNotNull() | F.col("_ok")).select("quadkey", F.when(take, F.col("_c")).otherwise(F.col("content")).alias("content"))


def missing_after(delta: DataFrame, merged: DataFrame) -> DataFrame:
    return delta.select("quadkey").join(merged.select("quadkey"), "quadkey", "left_anti")


def exit_status(classified: DataFrame) -> int:
    """0: nothing to merge, 1: mergeable, 2: blocked by conflicts."""
    r = classified.agg(F.count_if(F.col("kind") == "conflict").alias("c"), F.count_if(F.col("kind") == "new").alias("n")).first()
    return 2 if r["c"] else 1 if r["n"] else 0


def cached_within(items: DataFrame, age: str, size: str, budget: int) -> DataFrame:
    """``cached``: whether an item is among the youngest whose sizes together stay within ``budget``.

    Sizes of 0 and null take no room; items of one ``age`` are taken in the order of all their columns.
    """
    held = items.withColumn("_size", F.coalesce(F.col(size), F.lit(0)))
    order = [age, *[c for c in items.columns if c != age]]
    s = prefix_sums(held, Scratch(items.sparkSession, "cache"), order, "_size", "_before")
    return s.withColumn("cached", F.col("_before") + F.col("_size") <= budget).drop("_size", "_before")
