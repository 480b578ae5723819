"""Best representative of each duplicate group, built field by field.

Method: rows are ranked by usability, trust and recency with a deterministic tie-break in a window
ordering; the top row per (group, field) survives.  Spark limits each group before the shuffle
(window group limit), so a group with a third of all rows sends one row a task and field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.ids import bare_quadkey


def best_values(df: DataFrame, keys: list[str], fields: dict[str, Column], order: list[Column], row_id: str, min_rows: int = 2) -> DataFrame:
    """For each group and field the row that supplies the value.

    ``fields`` maps a field's name to its value, null where it is not usable.  Output: ``keys``,
    ``field_name``, ``row_id``.  Groups with fewer than ``min_rows`` rows (usable or not) and rows
    with a null key are left out; a field without a usable value gives no row.
    """
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select(*keys)
    long = df.select(*keys, row_id, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"), F.explode(F.filter(F.array(*[F.when(v.isNotNull(), F.lit(n)) for n, v in fields.items()]), lambda x: x.isNotNull())).alias("field_name"))
    w = Window.partitionBy(*keys, "field_name").orderBy(*[F.col(f"_o.o{i}").desc_nulls_last() for i in range(len(order))], F.col(row_id).desc())
    top = long.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*keys, "field_name", row_id)
    return top.join(sized, keys, "left_semi")


def comparison_values(comparisons: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Comparisons with the bare quadkey, and the usable value of each field.

    Usable: not null; an error from 0 to 1 (NaN is not); sizes above 0.  Rows without pyramid or with
    an unreadable quadkey are left out.
    """
    df = comparisons.withColumn("quad_key", bare_quadkey(F.col("quad_key"))).filter("pyramid_id is not null and quad_key is not null")
    r = F.col("normalized_rmse")
    return df, {
        "delta_is_higher_resolution": F.col("delta_is_higher_resolution").cast("string"),
        "normalized_rmse": F.when(~F.isnan(r) & r.between(0, 1), r).cast("string"),
        "pixel_width": F.when(F.col("pixel_width") > 0, F.col("pixel_width")).cast("string"),
        "pixel_height": F.when(F.col("pixel_height") > 0, F.col("pixel_height")).cast("string"),
    }


def best_comparisons(comparisons: DataFrame) -> DataFrame:
    df, fields = comparison_values(comparisons)
    return best_values(df, ["pyramid_id", "quad_key"], fields, [F.col("source_trust"), F.col("compared_at")], "comparison_id")


def merged_comparisons(comparisons: DataFrame) -> DataFrame:
    """One row per tile, single rows included, with the best value of every field.

    One aggregation with map-side combination: the largest (trust, time, id) among usable values.
    """
    df, _ = comparison_values(comparisons)
    rank = F.struct(F.coalesce(F.col("source_trust"), F.lit(-(1 << 31))).alias("t"), F.coalesce(F.col("compared_at"), F.lit("0001-01-01").cast(dict(df.dtypes)["compared_at"])).alias("c"), F.col("comparison_id").alias("i"))
    usable = {
        "delta_is_higher_resolution": F.col("delta_is_higher_resolution").isNotNull(),
        "normalized_rmse": ~F.isnan("normalized_rmse") & F.col("normalized_rmse").between(0, 1),
        "pixel_width": F.col("pixel_width") > 0,
        "pixel_height": F.col("pixel_height") > 0,
    }
    return df.groupBy("pyramid_id", "quad_key").agg(F.count(F.lit(1)).alias("n_rows"), *[F.max_by(F.col(f), F.when(ok, rank)).alias(f) for f, ok in usable.items()])
