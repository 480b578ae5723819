"""Readers and writers of frame, matrix and layer folders, textures and markers."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.functions.ids import five_digit
from quadloom.functions.quadkey import is_valid, layout_of
from quadloom.runtime import file_store, read_files, ship_package, write_whole
from quadloom.sources.archives import TarWriter, tar_files

FRAME_SCHEMA = "id string, tiles array<struct<contentId:string,textureFile:string,southNeighbor:string,northNeighbor:string,eastNeighbor:string,westNeighbor:string,primitive:string,skipped:boolean>>"
MATRIX_FIELDS = "rows:int,cols:int,tiles:array<struct<id:string,i:int,j:int,textureFile:string,uncles:array<struct<direction:string,uncleContentId:string>>>>"
MATRIX_SCHEMA = f"contractVersion int, frameId int, matrices array<struct<{MATRIX_FIELDS}>>, rows int, cols int, tiles array<struct<id:string,i:int,j:int,textureFile:string,uncles:array<struct<direction:string,uncleContentId:string>>>>"


def _folder_number(path: Column) -> Column:
    return F.regexp_extract(path, r"/([0-9]+)/[^/]*$", 1).try_cast("int")


def read_frame_lines(spark: SparkSession, path: str, name: str = "gl.txt", first: int | None = None, last: int | None = None) -> DataFrame:
    """``frame_id, line`` of numeric frame folders; the range is a filter on the folder's number."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path).select(_folder_number(F.col("_metadata.file_path")).alias("frame_id"), F.col("value").alias("line"))
    t = t.filter("frame_id is not null")
    if first is not None:
        t = t.filter(F.col("frame_id") >= first)
    if last is not None:
        t = t.filter(F.col("frame_id") <= last)
    return t


def read_written_lines(written: DataFrame, uri: str) -> DataFrame:
    """``frame_id, line`` of the files that ``write_frame_files`` named, read by tasks without listing folders."""
    t = read_files(written.select("file"), "file", uri).select(_folder_number(F.col("file")).alias("frame_id"), F.decode("content", "utf-8").alias("text")).filter("frame_id is not null and text <> ''")
    return t.select("frame_id", F.explode(F.split(F.regexp_replace("text", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")).alias("line"))


def read_manifests(spark: SparkSession, path: str, name: str = "manifest.txt") -> DataFrame:
    """``frame_id`` and the ``key=value`` fields of manifest lines as a map."""
    t = read_frame_lines(spark, path, name)
    return t.select("frame_id", F.str_to_map(F.trim("line"), F.lit(" "), F.lit("=")).alias("fields"))


def read_textures(spark: SparkSession, path: str) -> DataFrame:
    """Texture files ``<W>x<H>_<id>.png|dds`` below a folder, with size and id; content is read only if used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    m = lambda g: F.regexp_extract("path", r"/(\d+)x(\d+)_(\d+)\.(?:png|dds)$", g).try_cast("int")
    return f.select("path", m(1).alias("width"), m(2).alias("height"), m(3).alias("texture_id"), _folder_number(F.col("path")).alias("frame_id"), "content").filter("texture_id is not null")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of ``frame.json`` files; the frame's id is the last number of its text, missing fields are null."""
    f = spark.read.schema(FRAME_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "frame.json").json(path)
    frame = F.coalesce(F.regexp_extract(F.col("id"), r"(\d+)\D*$", 1).try_cast("int"), _folder_number(F.col("_metadata.file_path")))
    return f.select(frame.alias("frame_id"), F.posexplode_outer("tiles").alias("tile_seq", "t")).select("frame_id", "tile_seq", "t.*")


def read_matrices(spark: SparkSession, path: str, pattern: str = "matrix.json") -> DataFrame:
    """Cells of matrix files, either an envelope of several matrices or a single one; empty matrices drop out."""
    m = spark.read.schema(MATRIX_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(path)
    own = F.array(F.struct("rows", "cols", "tiles"))
    x = m.select("frameId", "contractVersion", F.posexplode(F.when(F.col("matrices").isNotNull(), F.col("matrices")).otherwise(own)).alias("matrix_no", "m"))
    c = x.select(F.col("frameId").alias("frame_id"), F.col("contractVersion").alias("version"), "matrix_no", "m.rows", "m.cols", F.explode("m.tiles").alias("t"))
    return c.select("frame_id", "version", "matrix_no", "rows", "cols", five_digit(F.col("t.id")).alias("tile_id"), "t.i", "t.j", F.col("t.textureFile").alias("texture_file"), "t.uncles")


def read_cutters(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of cutter files: JSON arrays of ids as text or as old plain numbers."""
    t = spark.read.option("wholetext", "true").text(path)
    return t.select(F.explode(F.from_json("value", "array<string>")).alias("id")).select(five_digit(F.col("id")).alias("tile_id")).filter("tile_id <> ''").distinct()


def read_pyramid(spark: SparkSession, path: str, max_depth: int = 30) -> DataFrame:
    """Tiles of a pyramid folder in either layout; names that are no quadkeys, or lie elsewhere, drop out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    root = path.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{root}/", "")
    x = f.select(rel.alias("path"), F.regexp_extract("path", r"/(\d+)\.png$", 1).alias("quadkey"), "content")
    return x.filter(is_valid(F.col("quadkey")) & (F.length("quadkey") <= max_depth + 1)).withColumn("layout", layout_of(F.col("path"), F.col("quadkey"))).filter("layout is not null")


def count_placemarks(spark: SparkSession, path: str, folder: str = "turtle") -> DataFrame:
    """Number of placemarks in the folder of that name."""
    x = spark.read.format("xml").option("rowTag", "Folder").schema("name string, Placemark array<struct<name:string>>").load(path)
    return x.filter(F.col("name") == folder).agg(F.coalesce(F.sum(F.size("Placemark")), F.lit(0)).alias("n_placemarks"))


def write_frames(frames: DataFrame, path: str) -> None:
    """One folder a frame, JSON lines inside."""
    frames.write.mode("overwrite").partitionBy("frame_id").json(path)


def write_matrices(cells: DataFrame, path: str, min_tiles: int = 2) -> None:
    """Matrices of at least ``min_tiles`` tiles, a folder a frame; only written frames are replaced."""
    n = cells.groupBy("frame_id", "matrix_no").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_tiles)
    cells.join(n.drop("n"), ["frame_id", "matrix_no"], "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("frame_id").json(path)


def layer_textures(cells: DataFrame, absolute: DataFrame, relative: DataFrame) -> DataFrame:
    """Texture of every tile for a layer export: absolute path, else relative one, else the fallback name."""
    n = F.regexp_extract("tile_id", r"_(\d+)$", 1)
    return cells.join(absolute.select("tile_id", F.col("path").alias("_a")), "tile_id", "left").join(relative.select("tile_id", F.col("path").alias("_r")), "tile_id", "left").withColumn("texture", F.coalesce("_a", "_r", F.concat(F.lit("256x256_"), n, F.lit(".png")))).drop("_a", "_r")


def repack(df: DataFrame, path: str, codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def _cleared(layers: DataFrame, uri: str) -> DataFrame:
    """Clears ``uri``; the tiles of matrices with the file names of their textures."""
    ship_package(layers.sparkSession)
    store, base = file_store(uri)
    store.create_dir(base, recursive=True)
    store.delete_dir_contents(base)
    texture = F.element_at(F.split(F.coalesce("absolute", "relative", F.concat(F.lit("256x256_"), F.col("tile_id").cast("string"), F.lit(".png"))), "/"), -1).alias("texture")
    return layers.select(F.col("matrix_id").cast("bigint").alias("matrix_id"), F.col("tile_id").cast("bigint").alias("tile_id"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), texture, "content").filter("matrix_id is not null")


def _layer_json(m: int, tiles: list[dict]) -> bytes:
    return json.dumps({"contractVersion": 3, "matrixIndex": m, "rows": max(x["i"] for x in tiles) + 1, "cols": max(x["j"] for x in tiles) + 1, "tiles": tiles}).encode()


def export_layers(layers: DataFrame, uri: str) -> DataFrame:
    """Clears ``uri`` and writes a folder a matrix: its textures and its ``matrixLayer.json``.

    ``layers``: ``matrix_id, tile_id, i, j``, the texture's ``absolute`` and ``relative`` paths and its
    ``content``, each perhaps null.  A texture keeps the file name of the first path there is, else
    ``256x256_<tile>.png``; one without content is named in the JSON but not copied.  Returns
    ``matrix_id, file, n_tiles, n_textures``; a matrix is a task's group.  Each file takes a block of
    disk at least; ``pack_layers`` has the form for very many tiny ones.
    """

    def run(t: pa.Table) -> pa.Table:
        store, base = file_store(uri)
        t = t.sort_by([("i", "ascending"), ("j", "ascending"), ("tile_id", "ascending")])
        m = t.column("matrix_id")[0].as_py()
        folder = f"{base}/matrix_{m}"
        tiles, n = [], 0
        for r in t.to_pylist():
            if r["content"] is not None:
                write_whole(store, f"{folder}/{r['texture']}", r["content"])
                n += 1
            tiles.append({"id": str(r["tile_id"]), "i": r["i"], "j": r["j"], "textureFile": r["texture"]})
        file = f"{folder}/matrixLayer.json"
        write_whole(store, file, _layer_json(m, tiles))
        return pa.table({"matrix_id": pa.array([m], pa.int64()), "file": [file], "n_tiles": pa.array([len(tiles)], pa.int64()), "n_textures": pa.array([n], pa.int64())})

    return _cleared(layers, uri).groupBy("matrix_id").applyInArrow(run, "matrix_id bigint, file string, n_tiles bigint, n_textures bigint")


ARCHIVE_BYTES = 1 << 28


def pack_layers(layers: DataFrame, uri: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The files of ``export_layers``, by the same names and bytes, in archives ``layers-*.tar.zst`` below ``uri``.

    Unpacked into one folder the archives are the folders of ``export_layers``.  A task writes its
    matrices one after the other, whole ones to an archive, and begins another archive after
    ``archive_bytes`` (unpacked).  A matrix's textures come before its ``matrixLayer.json``; only the
    JSON's tiles are held.  Returns ``file, n_layers, n_tiles, n_textures`` of each archive.
    """

    def run(batches):
        from pyspark import TaskContext

        store, base = file_store(uri)
        part, made, out, m, tiles = TaskContext.get().partitionId(), 0, None, None, []
        n = {"n_layers": 0, "n_tiles": 0, "n_textures": 0}

        def close_layer() -> None:
            out.add(f"matrix_{m}/matrixLayer.json", _layer_json(m, tiles))
            n["n_layers"] += 1
            n["n_tiles"] += len(tiles)
            tiles.clear()

        def close_archive() -> pa.RecordBatch:
            out.close()
            b = pa.RecordBatch.from_pydict({"file": [out.path], **{k: pa.array([v], pa.int64()) for k, v in n.items()}})
            n.update(dict.fromkeys(n, 0))
            return b

        for b in batches:
            for matrix_id, tile_id, i, j, texture, content in zip(*(b.column(k).to_pylist() for k in range(6))):
                if matrix_id != m:
                    if tiles:
                        close_layer()
                    if out is not None and out.n_bytes >= archive_bytes:
                        yield close_archive()
                        out = None
                    if out is None:
                        out, made = TarWriter(store, f"{base}/layers-{part:05d}-{made:03d}.tar.zst"), made + 1
                    m = matrix_id
                if content is not None:
                    out.add(f"matrix_{m}/{texture}", content)
                    n["n_textures"] += 1
                tiles.append({"id": str(tile_id), "i": i, "j": j, "textureFile": texture})
        if out is not None:
            close_layer()
            yield close_archive()

    # the window asks for a matrix's rows together and in order, and for a shuffle only where they are not together yet
    order = F.row_number().over(Window.partitionBy("matrix_id").orderBy("i", "j", "tile_id")).alias("_n")
    return _cleared(layers, uri).select("*", order).mapInArrow(run, "file string, n_layers bigint, n_tiles bigint, n_textures bigint")


ROWS_AT_ONCE, BYTES_AT_ONCE = 10_000, 1 << 24


def read_packed_layers(spark: SparkSession, files: list[str], uri: str) -> DataFrame:
    """``matrix_id, id, i, j, texture, content`` of the tiles in archives of ``pack_layers``, a task an archive.

    A tile whose texture is not in the archive has null content.
    """
    ship_package(spark)
    schema = "matrix_id bigint, id string, i int, j int, texture string, content binary"

    def run(batches):
        types = [("matrix_id", pa.int64()), ("id", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("texture", pa.string()), ("content", pa.binary())]
        store, _ = file_store(uri)
        rows, size = [], 0
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            held: dict[str, bytes] = {}
            with store.open_input_stream(files[k], compression="zstd") as f:
                for name, data in tar_files(f):
                    file = name.rpartition("/")[2]
                    if file != "matrixLayer.json":
                        held[file] = data
                        size += len(data)
                        continue
                    layer = json.loads(data)
                    m = layer["matrixIndex"]
                    rows += [(m, t["id"], t["i"], t["j"], t["textureFile"], held.get(t["textureFile"])) for t in layer["tiles"]]
                    held = {}
                    if len(rows) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], schema=pa.schema(types))
                        rows, size = [], 0
            if held:
                raise ValueError(f"{files[k]}: textures without a layer")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], schema=pa.schema(types))

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, schema)
