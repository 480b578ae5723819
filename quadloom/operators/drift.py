"""One consistent table out of JSON files whose fields come, go and change type.

Method: each file's top-level schema is read in parallel, the schemas are folded through a
type-promotion lattice (masks of JSON types joined by bitwise or), files are cast to the union
schema, and differences are logged in export order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.runtime import ship_package

# fixed values: one bit per JSON type; 0 = only null seen
TYPE_BITS = {"number": 1, "string": 2, "boolean": 4, "object": 8, "array": 16}
# kinds of numbers, one bit each: whole up to 2^53, to 63 bits, to 38 digits, longer; with fraction or exponent
SMALL, LONG, WIDE, HUGE, FRACTION = 1, 2, 4, 8, 16
EXPORTS_PER_BUCKET = 4096


def _bit(v: object) -> int:
    if v is None:
        return 0
    if isinstance(v, bool):
        return 4
    if isinstance(v, (int, float)):
        return 1
    return {str: 2, dict: 8, list: 16}[type(v)]


def _number_kind(v: object) -> int:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return 0
    if isinstance(v, float):
        return FRACTION
    return SMALL if abs(v) <= 1 << 53 else LONG if -(1 << 63) <= v < 1 << 63 else WIDE if abs(v) < 10**38 else HUGE


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parse_object(body: str | None) -> dict | None:
    """The JSON object in ``body``; None for null, broken or other content."""
    if body is None:
        return None
    try:
        v = json.loads(body, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, fields = [], []
        for i, body in enumerate(b.column("body").to_pylist()):
            v = parse_object(body)
            if v is not None:
                keep.append(i)
                fields.append([{"field_name": k, "type_bit": _bit(x), "number_kind": _number_kind(x), "position": p} for p, (k, x) in enumerate(v.items())])
        rest = b.select([c for c in b.schema.names if c != "body"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(fields, pa.list_(pa.struct([("field_name", pa.string()), ("type_bit", pa.int32()), ("number_kind", pa.int32()), ("position", pa.int32())])))], names=[*rest.schema.names, "fields"])


def file_schemas(files: DataFrame) -> DataFrame:
    """``producer_id, export_no, layer_file_id, fields`` of every valid file; broken files give none."""
    ship_package(files.sparkSession)
    return files.select("producer_id", F.col("export_no").cast("bigint").alias("export_no"), "layer_file_id", "body").mapInArrow(
        _header, "producer_id bigint, export_no bigint, layer_file_id bigint, fields array<struct<field_name:string,type_bit:int,number_kind:int,position:int>>"
    )


def previous_exports(exports: DataFrame, per_bucket: int = EXPORTS_PER_BUCKET) -> DataFrame:
    """``prev_export_no`` of each distinct (producer, export), in two levels.

    Rows are ordered within blocks of ``per_bucket`` export numbers, and the first of a block takes
    the largest number of the block before, so one producer's exports need not meet in one task.
    """
    e = exports.withColumn("_b", F.floor(F.col("export_no") / per_bucket))
    last = e.groupBy("producer_id", "_b").agg(F.max("export_no").alias("_last"))
    carried = last.select("producer_id", "_b", F.lag("_last").over(Window.partitionBy("producer_id").orderBy("_b")).alias("_carry"))
    inner = e.withColumn("_prev", F.lag("export_no").over(Window.partitionBy("producer_id", "_b").orderBy("export_no")))
    return inner.join(carried, ["producer_id", "_b"]).select("producer_id", "export_no", F.coalesce("_prev", "_carry").alias("prev_export_no"))


def schema_changes(schemas: DataFrame) -> DataFrame:
    """Ordered log of differences between each export and its producer's previous one.

    Output: ``producer_id, export_no, field_name, change_kind, old_types, new_types`` (masks of
    ``TYPE_BITS``).  A field is there if any valid file of the export has it, even with null.
    ``retyped`` needs non-null values on both sides with different sets of types.  Exports without
    a valid file don't exist; a producer's first export has no rows.  Rows without producer or
    export number are left out.
    """
    s = schemas.filter("producer_id is not null and export_no is not null")
    # an export's fields; an export of empty objects still exists and carries the null field
    per = s.select("producer_id", "export_no", F.explode_outer("fields").alias("f")).groupBy("producer_id", "export_no", F.col("f.field_name").alias("field_name")).agg(F.bit_or("f.type_bit").alias("types"))
    exports = previous_exports(per.select("producer_id", "export_no").distinct())
    has = per.filter("field_name is not null")
    now = has.select("producer_id", "export_no", "field_name", F.col("types").alias("new_types"), F.lit(None).cast("int").alias("old_types"))
    before = exports.filter("prev_export_no is not null").select("producer_id", F.col("export_no").alias("later"), F.col("prev_export_no").alias("export_no"))
    carried = has.join(before, ["producer_id", "export_no"]).select("producer_id", F.col("later").alias("export_no"), "field_name", F.lit(None).cast("int").alias("new_types"), F.col("types").alias("old_types"))
    both = now.unionByName(carried).groupBy("producer_id", "export_no", "field_name").agg(F.max("new_types").alias("new_types"), F.max("old_types").alias("old_types"))
    compared = both.join(before.select("producer_id", F.col("later").alias("export_no")), ["producer_id", "export_no"], "left_semi")
    kind = (
        F.when(F.col("old_types").isNull(), "added").when(F.col("new_types").isNull(), "removed")
        .when((F.col("old_types") > 0) & (F.col("new_types") > 0) & (F.col("old_types") != F.col("new_types")), "retyped")
    )
    return compared.withColumn("change_kind", kind).filter("change_kind is not null").select("producer_id", "export_no", "field_name", "change_kind", "old_types", "new_types")


def promoted(mask: Column, kinds: Column) -> Column:
    """Lattice: null < bigint < decimal(38,0) and double < string; boolean < string; object and array < json text.

    Fractions with whole numbers up to 2^53 make double, which holds both exactly; fractions with longer
    ones, and numbers of more than 38 digits, make string, as do number, string and boolean mixed.  Any
    mixture with objects or arrays makes json.  No step changes a value.
    """
    number = F.when(kinds.bitwiseAND(HUGE) != 0, "string").when(kinds.bitwiseAND(FRACTION) != 0, F.when(kinds.bitwiseAND(LONG | WIDE) != 0, "string").otherwise("double")).when(kinds.bitwiseAND(WIDE) != 0, "decimal(38,0)").otherwise("bigint")
    return F.when(mask == 0, "void").when(mask == 1, number).when(mask == 4, "boolean").when(mask.bitwiseAND(24) == 0, "string").otherwise("json")


def union_schema(schemas: DataFrame) -> DataFrame:
    """``field_name, field_type, n_files`` over all files: the fold of all file schemas."""
    f = schemas.select(F.explode("fields").alias("f"))
    g = f.groupBy(F.col("f.field_name").alias("field_name")).agg(F.bit_or("f.type_bit").alias("mask"), F.bit_or("f.number_kind").alias("kinds"), F.count(F.lit(1)).alias("n_files"))
    return g.select("field_name", promoted(F.col("mask"), F.col("kinds")).alias("field_type"), "n_files")


def read_unified(files: DataFrame, max_fields: int = 10_000) -> DataFrame:
    """All valid files as one table: a column per field of the union schema, cast to its type.

    The schema itself must be known before the plan is made; its size is the number of distinct field
    names, and more than ``max_fields`` raises rather than dropping some.  A field that a file lacks
    is null, and a field whose name equals ``producer_id``, ``export_no`` or ``layer_file_id`` gets the
    prefix ``field_``.  Strings in a ``json`` column are JSON strings.
    """
    u = union_schema(file_schemas(files)).orderBy("field_name").limit(max_fields + 1).collect()
    if len(u) > max_fields:
        raise ValueError(f"more than {max_fields} distinct fields")
    kinds = {r["field_name"]: r["field_type"] for r in u}
    own = ["producer_id", "export_no", "layer_file_id"]
    names = {f: f"field_{f}" if f in own else f for f in kinds}
    arrow = {"void": pa.string(), "bigint": pa.int64(), "decimal(38,0)": pa.decimal128(38, 0), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "json": pa.string()}
    spark = {k: "string" if k in ("void", "json") else k for k in arrow}

    def cast(v: object, kind: str) -> object:
        if v is None:
            return None
        if kind == "double":
            return float(v)
        if kind == "decimal(38,0)":
            return Decimal(v)
        if kind == "string":
            return v if isinstance(v, str) else json.dumps(v)
        if kind == "json":
            return json.dumps(v, ensure_ascii=False, sort_keys=True)
        return v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse_object(x) for x in b.column("body").to_pylist()]
            keep = [i for i, v in enumerate(parsed) if v is not None]
            rest = b.select(own).take(pa.array(keep, pa.int64()))
            cols = [pa.array([cast(parsed[i].get(f), k) for i in keep], arrow[k]) for f, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([*rest.columns, *cols], names=[*own, *names.values()])

    schema = "producer_id bigint, export_no bigint, layer_file_id bigint" + "".join(f", `{names[f]}` {spark[k]}" for f, k in kinds.items())
    return files.select("producer_id", F.col("export_no").cast("bigint").alias("export_no"), "layer_file_id", "body").mapInArrow(run, schema)
