"""Quadkey algebra as Column functions.

Keys are ``0[0-3]*``: a root marker and one quadrant digit a level, 0 = SW, 1 = SE, 2 = NE, 3 = NW.
``south_row`` counts from the south, matrix rows count from the north.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the quadrant of the containing texture for each of the eight directions
QUADRANT_OF = {"WEST_SOUTH": 0, "SOUTH_WEST": 0, "EAST_SOUTH": 1, "SOUTH_EAST": 1, "EAST_NORTH": 2, "NORTH_EAST": 2, "WEST_NORTH": 3, "NORTH_WEST": 3}
TILE = 256


def is_valid(key: Column) -> Column:
    return F.coalesce(key.rlike("^0[0-3]*$"), F.lit(False))


def depth(key: Column) -> Column:
    return F.length(key) - 1


def _bits(key: Column, ones: str) -> Column:
    """The digits below the root as a binary number: 1 for the quadrants named in ``ones``."""
    digits = F.translate(F.substring(key, 2, 64), "0123", "".join("1" if c in ones else "0" for c in "0123"))
    return F.when(F.length(key) == 1, F.lit(0)).otherwise(F.conv(digits, 2, 10)).cast("bigint")


def column(key: Column) -> Column:
    return _bits(key, "12")


def south_row(key: Column) -> Column:
    return _bits(key, "23")


def north_row(key: Column) -> Column:
    return F.pow(F.lit(2), depth(key)).cast("bigint") - 1 - south_row(key)


def encode(d: Column, col: Column, row: Column) -> Column:
    """The key of a cell; inverse of ``depth``, ``column`` and ``south_row``."""
    digit = lambda i: F.element_at(
        F.array(F.lit("0"), F.lit("1"), F.lit("3"), F.lit("2")),
        (F.pmod(F.floor(col / F.pow(F.lit(2), i)), F.lit(2)) + 2 * F.pmod(F.floor(row / F.pow(F.lit(2), i)), F.lit(2)) + 1).cast("int"),
    )
    steps = F.when(d > 0, F.reverse(F.sequence(F.lit(0), d.cast("int") - 1))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.lit("0"), F.array_join(F.transform(steps, digit), ""))


def lon(key: Column) -> Column:
    return column(key) * (F.lit(360.0) / F.pow(F.lit(2.0), depth(key))) - 180.0


def lat(key: Column) -> Column:
    return south_row(key) * (F.lit(180.0) / F.pow(F.lit(2.0), depth(key))) - 90.0


def child(key: Column, direction: Column) -> Column:
    digit = F.create_map(*[x for k, v in QUADRANT_OF.items() for x in (F.lit(k), F.lit(str(v)))])[direction]
    return F.concat(key, digit)


def parent(key: Column) -> Column:
    return F.when(F.length(key) > 1, key.substr(F.lit(1), F.length(key) - 1))


def ancestors(key: Column) -> Column:
    """All proper prefixes, shortest first."""
    return F.when(F.length(key) > 1, F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: key.substr(F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def prefixes(key: Column) -> Column:
    """All prefixes with the key itself."""
    return F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: key.substr(F.lit(1), i))


def digit_path(key: Column) -> Column:
    """Folder layout with one digit a level."""
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(2), F.greatest(F.length(key), F.lit(2))), lambda i: F.concat(key.substr(i, F.lit(1)), F.when(F.length(key) > 1, "/").otherwise(""))), ""), key, F.lit(".png"))


def cumulative_path(key: Column) -> Column:
    """Folder layout with the key so far as each level's name."""
    return F.concat(F.when(F.length(key) > 1, F.concat(F.array_join(F.transform(F.sequence(F.lit(2), F.greatest(F.length(key), F.lit(2))), lambda i: key.substr(F.lit(1), i)), "/"), F.lit("/"))).otherwise(""), key, F.lit(".png"))


def layout_of(path: Column, key: Column) -> Column:
    return F.when(path == digit_path(key), "digit").when(path == cumulative_path(key), "cumulative")


def wrap_column(col: Column, level: Column) -> Column:
    """Longitude wraps around, latitude never does."""
    return F.pmod(col, F.pow(F.lit(2), level).cast("bigint"))


def flip_row(row: Column, level: Column) -> Column:
    return F.pow(F.lit(2), level).cast("bigint") - 1 - row


def unit_index(x: Column, n: Column) -> Column:
    """Index of a unit coordinate among n cells; -1 for no cells or a value that is not finite."""
    clamped = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.when((n <= 0) | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), -1).otherwise(F.least(F.floor(clamped * n), n - 1)).cast("int")


def level_layout(d: Column, width: int, height: int) -> Column:
    """How a level is shown in a viewport: mode, image side, pixels a tile, scrollable."""
    side = F.pow(F.lit(2), F.least(d, F.lit(30))).cast("bigint")
    room = min(width, height)
    fit = F.filter(F.array(*[F.lit(s) for s in (256, 128, 64, 32, 16, 8, 4, 2)]), lambda s: side * (s + 2) <= room)
    best = F.when(F.size(fit) > 0, F.element_at(fit, 1))
    return F.struct(
        F.when(best == 256, "NATIVE").when(best.isNotNull(), "SCALED").otherwise("COVERAGE").alias("mode"),
        F.coalesce(best, F.lit(1)).alias("image_px"), F.coalesce(best + 2, F.lit(1)).alias("tile_px"), (best.isNull() & (side > room)).alias("scrollable"),
    )


def grid_path(row: int, col: int, rows: int, cols: int) -> str:
    """Digits from the root to a cell of a grid whose sides need not be powers of two."""
    out = ""
    while rows > 1 or cols > 1:
        lower, left = -(-rows // 2), -(-cols // 2)
        south, west = row < lower, col < left
        out += "0" if south and west else "1" if south else "3" if west else "2"
        row, rows = (row, lower) if south else (row - lower, rows - lower)
        col, cols = (col, left) if west else (col - left, cols - left)
    return out
