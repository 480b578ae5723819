"""Matrix, texture-coordinate and strip functions; matrices are column-major arrays of 16 doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UV_TOLERANCE = 0.05  # fixed values: tolerances of the half-range and full-texture tests
FULL_TOLERANCE = 1e-3


def parse_matrix(text: Column) -> Column:
    """16 numbers between commas, braces or blanks; null unless exactly 16 are there."""
    parts = F.filter(F.split(F.regexp_replace(text, r"[{}\[\]()]", " "), r"[,\s]+"), lambda x: x != "")
    nums = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(nums) == 16) & ~F.exists(nums, lambda x: x.isNull()), nums)


def signature(m: Column) -> Column:
    """Values rounded half-even to four digits, joined by bars; negative zero stays apart from zero."""
    return F.array_join(F.transform(m, lambda x: (F.rint(x * 10000.0) / 10000.0).cast("string")), "|")


def dot_rows(m: Column, x: Column, y: Column, z: Column, w: Column, row: int) -> Column:
    return m[row] * x + m[row + 4] * y + m[row + 8] * z + m[row + 12] * w


def texture_coordinate(m: Column, u: Column, v: Column) -> Column:
    """A texture matrix applied to (u, v, 0, 1), divided by w unless that is tiny."""
    zero, one = F.lit(0.0), F.lit(1.0)
    s, t, q = (dot_rows(m, u, v, zero, one, r) for r in (0, 1, 3))
    safe = F.abs(q) > 1e-12
    return F.struct(F.when(safe, s / q).otherwise(s).alias("u"), F.when(safe, t / q).otherwise(t).alias("v"))


def project(model_view: Column, projection: Column, x: Column, y: Column, z: Column, width: int, height: int) -> Column:
    """Viewport pixel of a point; null behind the guards on w."""
    eye = [dot_rows(model_view, x, y, z, F.lit(1.0), r) for r in range(4)]
    cx, cy, cw = (dot_rows(projection, *eye, r) for r in (0, 1, 3))
    px = (cx / cw * 0.5 + 0.5) * (width - 1)
    py = (cy / cw * 0.5 + 0.5) * (height - 1)
    return F.when(F.abs(cw) >= 1e-12, F.struct(px.alias("px"), py.alias("py")))


def camera(m: Column) -> Column:
    """Field of view, near and far plane and aspect of a projection, each null where its guard fails."""
    fov = F.degrees(2.0 * F.atan(1.0 / m[5]))
    near, far = F.abs(m[14] / (m[10] - 1.0)), F.abs(m[14] / (m[10] + 1.0))
    planes = (F.abs(m[10] - 1.0) > 1e-12) & (F.abs(m[10] + 1.0) > 1e-12) & (near > 1e-6) & (far > near)
    aspect = m[5] / m[0]
    return F.struct(
        F.when((F.abs(m[5]) > 1e-12) & (fov > 0.1) & (fov < 179.0), fov).alias("fov"), F.when(planes, near).alias("near"), F.when(planes, far).alias("far"),
        F.when((F.abs(m[0]) > 1e-12) & (F.abs(m[5]) > 1e-12) & (aspect > 0.01), aspect).alias("aspect"),
    )


def eye(m: Column) -> Column:
    """Camera position of a model-view matrix: minus the rotation's transpose times the translation."""
    part = lambda k: -(m[k] * m[12] + m[k + 1] * m[13] + m[k + 2] * m[14])
    return F.struct(part(0).alias("x"), part(4).alias("y"), part(8).alias("z"))


def forward(m: Column) -> Column:
    """Unit viewing direction, null for a vanishing one."""
    n = F.sqrt(m[2] * m[2] + m[6] * m[6] + m[10] * m[10])
    return F.when(n >= 1e-12, F.struct((m[2] / n).alias("x"), (m[6] / n).alias("y"), (m[10] / n).alias("z")))


def is_perspective(m: Column) -> Column:
    return (F.abs(m[11] + 1.0) < 1e-6) & (F.abs(m[15]) < 1e-6)


def far_plane(m: Column) -> Column:
    """Distance of the far plane, -1 where it cannot be told."""
    return F.when(F.abs(m[10] + 1.0) > 1e-12, F.abs(m[14] / (m[10] + 1.0))).otherwise(-1.0)


def epsilon(extent: Column) -> Column:
    return F.greatest(F.lit(1e-12), F.least(F.lit(1e-4), extent * 1e-3))


def half(low: Column, high: Column) -> Column:
    """LOW for 0 to a half, HIGH for a half to 1, null else."""
    near = lambda c, x: F.abs(c - x) <= UV_TOLERANCE
    return F.when(near(low, 0.0) & near(high, 0.5), "LOW").when(near(low, 0.5) & near(high, 1.0), "HIGH")


def is_full_texture(u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
    return (u0 <= FULL_TOLERANCE) & (v0 <= FULL_TOLERANCE) & (u1 >= 1 - FULL_TOLERANCE) & (v1 >= 1 - FULL_TOLERANCE)


def quadrant(u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
    u, v = half(u0, u1), half(v0, v1)
    return F.when((u == "LOW") & (v == "LOW"), "WEST_SOUTH").when((u == "LOW") & (v == "HIGH"), "WEST_NORTH").when((u == "HIGH") & (v == "LOW"), "EAST_SOUTH").when((u == "HIGH") & (v == "HIGH"), "EAST_NORTH")


def uncle_direction(direction: Column, u_half: Column, v_half: Column) -> Column:
    """Which of the eight directions an uncle has, by the side it lies on and its half of the texture."""
    return (
        F.when(u_half.isNull() | v_half.isNull(), None)
        .when(direction == "EAST", F.when(v_half == "LOW", "WEST_SOUTH").otherwise("WEST_NORTH"))
        .when(direction == "WEST", F.when(v_half == "LOW", "EAST_SOUTH").otherwise("EAST_NORTH"))
        .when(direction == "NORTH", F.when(u_half == "LOW", "SOUTH_WEST").otherwise("SOUTH_EAST"))
        .when(direction == "SOUTH", F.when(u_half == "LOW", "NORTH_WEST").otherwise("NORTH_EAST"))
    )


def topology(n_raw: Column, n_distinct: Column) -> Column:
    """Class of a strip: 20 raw vertices; 9 distinct ones are a quad, 7 a pole."""
    return F.when(n_raw != 20, "other").when(n_distinct == 9, "quad").when(n_distinct == 7, "pole").otherwise("other")


def triangle_strips(indices: Column) -> Column:
    """Consecutive triples; a rest of fewer than three is dropped."""
    n = F.floor(F.size(indices) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(indices, i * 3 + 1, 3))).otherwise(F.array().cast("array<array<int>>"))


def running_clusters(values: Column, tolerance: Column) -> Column:
    """Ascending values in clusters: a value joins while it lies within the tolerance of the running mean."""
    empty = F.array().cast("array<struct<mean:double,n:int>>")

    def step(acc, v):
        last = F.element_at(acc, -1)
        grown = F.struct(((last["mean"] * last["n"] + v) / (last["n"] + 1)).alias("mean"), (last["n"] + 1).alias("n"))
        fresh = F.struct(v.alias("mean"), F.lit(1).alias("n"))
        joins = (F.size(acc) > 0) & (F.abs(last["mean"] - v) <= tolerance)
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(F.array_sort(values), empty, step)
