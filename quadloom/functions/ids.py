"""Content ids (``<frame>_<tile>``), tile paths and quadkeys as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\n\x0b\f\r"
_ID = r"^0*[0-9]{1,18}_0*[0-9]{1,18}$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def reference_or_none(c: Column) -> Column:
    """A neighbour or uncle field without blanks; null, blanks and the word ``null`` mean none."""
    s = strip(c)
    return F.when((s != "") & (F.lower(s) != "null"), s)


def id_frame(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(_ID), F.substring_index(s, "_", 1).try_cast("bigint"))


def id_tile(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(_ID), F.substring_index(s, "_", -1).try_cast("bigint"))


def format_id(frame: Column, tile: Column) -> Column:
    return F.concat(
        F.when(F.length(frame.cast("string")) < 5, F.lpad(frame.cast("string"), 5, "0")).otherwise(frame.cast("string")),
        F.lit("_"),
        tile.cast("string"),
    )


def five_digit(c: Column) -> Column:
    """``%05d_%d``; ids of another form are returned without blanks, null stays null."""
    return F.coalesce(format_id(id_frame(c), id_tile(c)), strip(c))


def packed_id(c: Column) -> Column:
    """The id as one bigint, null where either number needs more than 31 bits or the form differs."""
    s = strip(c)
    f, t = F.substring_index(s, "_", 1).try_cast("bigint"), F.substring_index(s, "_", -1).try_cast("bigint")
    return F.when(s.rlike(_ID) & (f < (1 << 31)) & (t < (1 << 31)), F.shiftleft(f, 31).bitwiseOR(t))


def canonical_path(c: Column) -> Column:
    """Path without ``//``, ``/./`` and ``x/../``; blanks around it removed."""
    parts = F.split(strip(c), "/")
    kept = F.filter(parts, lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.when(F.startswith(strip(c), F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def quick_path(c: Column) -> Column:
    """``canonical_path`` that leaves paths without any of those spellings untouched."""
    return F.when(c.rlike(r"//|/\.{1,2}/|^\.{1,2}/|^\s|\s$"), canonical_path(c)).otherwise(c)


def path_stem(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*?)(?:\.[A-Za-z0-9]+)?\s*$", 1)


def bare_quadkey(c: Column) -> Column:
    """A quadkey given bare or as a tile path in either folder layout; null if it is neither."""
    return F.nullif(F.regexp_extract(strip(c), r"^(?:.*/)?(0[0-3]*)(?:\.[A-Za-z]+)?$", 1), F.lit(""))


def tile_key(image_path: Column, texture_file: Column, canonical: bool = False) -> Column:
    """One key for all spellings of a tile's path.

    Pyramid images: the folder above ``pyramidalImage`` and the quadkey in the file name, so both
    folder layouts agree.  Textures: the matrix folder and the five-digit tile id.  Anything else:
    the canonical path itself.  Null if both paths are null or blank.  ``canonical``: the paths are so already.
    """
    p, t = (image_path, texture_file) if canonical else (quick_path(image_path), quick_path(texture_file))
    qk = F.regexp_extract(p, r"/(0[0-3]*)\.[A-Za-z]+$", 1)
    base = F.regexp_extract(p, r"^(.*?)/pyramidalImage/", 1)
    folder = F.regexp_extract(t, r"^(.*)/[^/]*$", 1)
    fid = F.regexp_extract(t, r"/(0*[0-9]{1,18}_0*[0-9]{1,18})\.[A-Za-z]+$", 1)
    return F.coalesce(
        F.when(F.length(strip(image_path)) > 0, F.when((qk != "") & (base != ""), F.concat(F.lit("P|"), base, F.lit("|"), qk)).otherwise(F.concat(F.lit("F|"), p))),
        F.when(F.length(strip(texture_file)) > 0, F.when(fid != "", F.concat(F.lit("T|"), folder, F.lit("|"), five_digit(fid))).otherwise(F.concat(F.lit("F|"), t))),
    )


def has_tile_key(image_path: Column, texture_file: Column) -> Column:
    """Whether ``tile_key`` is not null, without making it."""
    return (F.length(F.coalesce(strip(image_path), F.lit(""))) > 0) | (F.length(F.coalesce(strip(texture_file), F.lit(""))) > 0)


def with_tile_key(df: DataFrame, image_path: str, texture_file: str) -> DataFrame:
    """``tile_key`` as a column; paths are made canonical once a row, in a projection of their own."""
    paths = df.withColumns({"_ip": quick_path(F.col(image_path)), "_tf": quick_path(F.col(texture_file))})
    return paths.withColumn("tile_key", tile_key(F.col("_ip"), F.col("_tf"), canonical=True)).drop("_ip", "_tf")
