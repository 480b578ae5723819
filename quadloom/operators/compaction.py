"""Few well-sized containers out of very many tiny files.

Method: byte-level concatenation.  A container is either a run of complete zstandard frames (any
binary file becomes one frame, files that already are complete frames are joined as they are) or a
run of newline-delimited text with one header.  Nothing is parsed.  Every member's length and CRC-32
is checked against the source by reading the finished container back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.ids import has_tile_key, with_tile_key
from quadloom.runtime import Scratch, file_store, prefix_sums, ship_package, write_whole

ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"  # fixed value: frame header of the public format
TARGET_BYTES = 128 * 1024 * 1024

CONTAINER_SCHEMA = (
    "container_id string, codec string, n_members int, n_bytes bigint, crc32 bigint, payload binary, "
    "members array<struct<file_id:bigint,tile_key:string,frame_offset:bigint,frame_bytes:bigint,n_bytes:bigint,crc32:bigint,verified:boolean>>"
)


def is_complete_frame(data: bytes) -> bool:
    """Whether the bytes are one or more complete zstandard frames and nothing else."""
    import zstandard

    if not data.startswith(ZSTD_MAGIC):
        return False
    try:
        rest = data
        while rest:
            d = zstandard.ZstdDecompressor().decompressobj()
            d.decompress(rest)
            if not d.eof:
                return False
            rest = d.unused_data
        return True
    except zstandard.ZstdError:
        return False


def split_frames(payload: bytes) -> Iterator[bytes]:
    """Contents of the frames of a container, in order."""
    import zstandard

    rest = payload
    while rest:
        d = zstandard.ZstdDecompressor().decompressobj()
        yield d.decompress(rest)
        if not d.eof:
            raise ValueError("container ends inside a frame")
        rest = d.unused_data


def join_newline_delimited(parts: Iterable[bytes], has_header: bool = False) -> bytes:
    """Joins newline-delimited files: one header, a newline between files, no byte-order marks.

    Empty files add nothing.  A file whose header differs from the first one raises ValueError.
    """
    out, header = [], None
    for part in parts:
        if part.startswith(b"\xef\xbb\xbf"):
            part = part[3:]
        if not part:
            continue
        if has_header:
            head, _, body = part.partition(b"\n")
            head = head.rstrip(b"\r")
            if header is None:
                header = head
                out.append(head + b"\n")
            elif head != header:
                raise ValueError("headers differ")
            part = body
            if not part:
                continue
        out.append(part if part.endswith(b"\n") else part + b"\n")
    return b"".join(out)


def tile_versions(files: DataFrame) -> DataFrame:
    """Each version (tile, bytes) once: ``tile_key, digest, file_id`` (the smallest), ``n_files, n_bytes``.

    Only digests are shuffled, combined before: a tile with a third of all rows is one row a task, and
    versions of one tile spread over tasks because the digest is part of the key.  Files without bytes
    (null) or without a path are left out; empty files count as content.
    """
    keyed = files.select("file_id", "image_path", "texture_file", F.unhex(F.sha2("content", 256)).alias("digest"), F.octet_length("content").cast("bigint").alias("n_bytes"))
    keyed = with_tile_key(keyed, "image_path", "texture_file").drop("image_path", "texture_file").filter("file_id is not null and tile_key is not null and digest is not null")
    return keyed.groupBy("tile_key", "digest").agg(F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("n_files"), F.max("n_bytes").alias("n_bytes"))


def numbered(parts: DataFrame, scratch: Scratch, order: list[str], target_bytes: int, block_rows: int = 1_000_000) -> DataFrame:
    """``container_no`` of every row: the bytes of all rows before it in ``order``, over the target.

    So every container but the last reaches the target, give or take one member, and the number says
    where its members lie in the order, whatever the partitions.  The prefix sum is taken in ranges of
    ``block_rows`` rows, whose sums are carried over.
    """
    return prefix_sums(parts, scratch, order, "n_bytes", "_before", block_rows).withColumn("container_no", F.floor(F.col("_before") / target_bytes).cast("bigint")).drop("_before")


_CONTAINER = pa.schema([
    ("container_id", pa.string()), ("codec", pa.string()), ("n_members", pa.int32()), ("n_bytes", pa.int64()), ("crc32", pa.int64()), ("payload", pa.binary()),
    ("members", pa.list_(pa.struct([("file_id", pa.int64()), ("tile_key", pa.string()), ("frame_offset", pa.int64()), ("frame_bytes", pa.int64()), ("n_bytes", pa.int64()), ("crc32", pa.int64()), ("verified", pa.bool_())]))),
])


def check_members(payload: bytes, members: list[dict]) -> list[dict]:
    """The members with ``verified``: the bytes at their place have the length and checksum of the source."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for m in members:
        piece = payload[m["frame_offset"] : m["frame_offset"] + m["frame_bytes"]]
        ok = len(piece) == m["n_bytes"] and zlib.crc32(piece) == m["crc32"]  # a file that was a frame before
        if not ok:
            try:
                back = z.decompress(piece, max_output_size=max(m["n_bytes"], 1))
                ok = len(back) == m["n_bytes"] and zlib.crc32(back) == m["crc32"]
            except zstandard.ZstdError:
                ok = False
        m["verified"] = ok
    return members


def _packer(uri: str | None):
    """One container a group; with ``uri`` it is written there, read again and checked, and its payload left out."""

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        t = t.sort_by([("tile_key", "ascending"), ("file_id", "ascending")])
        name = f"{t.column('container_no')[0].as_py():010d}"
        z = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        frames, members, at = [], [], 0
        for fid, key, n, crc, data in zip(*(t.column(c).to_pylist() for c in ("file_id", "tile_key", "n_bytes", "crc32")), (x.as_py() for x in t.column("content"))):
            frame = data if is_complete_frame(data) else z.compress(data)
            frames.append(frame)
            members.append({"file_id": fid, "tile_key": key, "frame_offset": at, "frame_bytes": len(frame), "n_bytes": n, "crc32": crc})
            at += len(frame)
        payload = b"".join(frames)
        frames.clear()
        whole = zlib.crc32(payload)
        if uri is not None:
            payload = _write_and_read(uri, f"{name}.zst", payload)
            if zlib.crc32(payload) != whole:
                raise OSError(f"container {name} is not what was written")
        row = {"container_id": name, "codec": "zstd-frames", "n_members": len(members), "n_bytes": at, "crc32": whole, "payload": None if uri else payload, "members": check_members(payload, members)}
        return pa.Table.from_pylist([row], schema=_CONTAINER)

    return run


def _write_and_read(uri: str, name: str, payload: bytes) -> bytes:
    """Writes a file and reads it from where it lies."""
    store, base = file_store(uri)
    write_whole(store, f"{base}/{name}", payload)
    with store.open_input_stream(f"{base}/{name}", compression=None) as s:
        return s.read()


def compact_files(files: DataFrame, target_bytes: int = TARGET_BYTES, uri: str | None = None) -> DataFrame:
    """Containers of about ``target_bytes`` of member bytes that hold every tile version once.

    Input: ``file_id, image_path, texture_file, content``; other columns are ignored.  Output:
    ``CONTAINER_SCHEMA``.  With ``uri`` (any pyarrow file system) each container becomes the file
    ``<container_id>.zst``, checked from what the file holds, and ``payload`` is null; a task that runs
    again replaces its file by an equal one, as ids and order follow from the members alone.  Lengths
    and checksums to check against come from the source table, not from the packing task.  A file
    larger than the target makes its container larger.  Empty input gives no container.
    """
    ship_package(files.sparkSession)
    kept = numbered(tile_versions(files).select("tile_key", "file_id", "n_bytes"), Scratch(files.sparkSession, "compaction"), ["tile_key", "file_id"], target_bytes)
    data = files.filter("file_id is not null and content is not null").select("file_id", "content", F.crc32("content").alias("crc32"))
    one = data.join(kept.select("file_id", "tile_key", "n_bytes", "container_no"), "file_id")
    return one.groupBy("container_no").applyInArrow(_packer(uri), CONTAINER_SCHEMA)


def manifest(containers: DataFrame) -> DataFrame:
    """One row per stored file: where it lies and whether its length and checksum held."""
    return containers.select("container_id", F.explode("members").alias("m")).select("container_id", "m.*")


def repeated_files(files: DataFrame, containers: DataFrame) -> DataFrame:
    """Files that no container lists because a smaller ``file_id`` stores the same tile and bytes."""
    kept = manifest(containers).filter("verified").select("file_id")
    eligible = files.filter(F.col("file_id").isNotNull() & F.col("content").isNotNull() & has_tile_key(F.col("image_path"), F.col("texture_file"))).select("file_id")
    return eligible.join(kept, "file_id", "left_anti")


TEXT_SCHEMA = "container_id string, header string, n_members int, n_lines bigint, n_bytes bigint, crc32 bigint, payload binary, file_ids array<bigint>, verified boolean"
_TEXT = pa.schema([("container_id", pa.string()), ("header", pa.string()), ("n_members", pa.int32()), ("n_lines", pa.int64()), ("n_bytes", pa.int64()), ("crc32", pa.int64()), ("payload", pa.binary()), ("file_ids", pa.list_(pa.int64())), ("verified", pa.bool_())])


def compact_text(files: DataFrame, has_header: bool, target_bytes: int = TARGET_BYTES, uri: str | None = None) -> DataFrame:
    """Newline-delimited files joined to containers of about ``target_bytes``: ``TEXT_SCHEMA``.

    Input: ``file_id, content`` (binary).  With ``has_header`` the first line is a header: files are
    joined with those of an equal one, which each container holds once; without, ``header`` is null.
    Byte-order marks go, a missing last line end is added, nothing else changes.  Files that are null
    or empty add nothing.  ``verified``: the container holds just the lines that the source's lengths
    and line ends promise.  Repeated ids are taken as often as they come.
    """
    ship_package(files.sparkSession)
    mark = F.lit(b"\xef\xbb\xbf")
    bare = F.when(F.substring("content", 1, 3) == mark, F.expr("substring(content, 4)")).otherwise(F.col("content"))
    t = files.filter("file_id is not null").select("file_id", bare.alias("content")).filter(F.octet_length("content") > 0)
    text = F.decode("content", "ISO-8859-1")  # one character a byte
    head = F.rtrim(F.substring_index(text, "\n", 1), F.lit("\r")) if has_header else F.lit(None).cast("string")
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + F.when(text.endswith("\n"), 0).otherwise(1) - (1 if has_header else 0)
    t = t.select("file_id", "content", head.alias("header"), lines.cast("bigint").alias("n_lines"), F.xxhash64("content").alias("digest"), F.octet_length("content").cast("bigint").alias("n_bytes"))
    scratch = Scratch(files.sparkSession, "text")
    places = numbered(t.select("header", "file_id", "digest", "n_bytes").groupBy("header", "file_id", "digest").agg(F.sum("n_bytes").alias("n_bytes")), scratch, ["header", "file_id", "digest"], target_bytes)
    both = t.join(places.select("file_id", "digest", "container_no"), ["file_id", "digest"])

    def run(k: tuple, g: pa.Table) -> pa.Table:
        g = g.sort_by([("file_id", "ascending"), ("digest", "ascending")])
        payload = join_newline_delimited((x.as_py() for x in g.column("content")), has_header)
        name = f"{g.column('container_no')[0].as_py():010d}-{zlib.crc32((g.column('header')[0].as_py() or '').encode('latin-1')):08x}"
        whole = zlib.crc32(payload)
        if uri is not None:
            payload = _write_and_read(uri, name, payload)
        want = sum(g.column("n_lines").to_pylist())
        ok = zlib.crc32(payload) == whole and payload.count(b"\n") == want + int(has_header)
        row = {"container_id": name, "header": g.column("header")[0].as_py(), "n_members": g.num_rows, "n_lines": want, "n_bytes": len(payload), "crc32": whole, "payload": None if uri else payload, "file_ids": g.column("file_id").to_pylist(), "verified": ok}
        return pa.Table.from_pylist([row], schema=_TEXT)

    return both.groupBy("container_no", "header").applyInArrow(run, TEXT_SCHEMA)


def length_mismatches(files: DataFrame) -> DataFrame:
    """Files whose recorded ``n_bytes`` differs from the bytes held; a null length is no mismatch."""
    return files.filter(F.col("n_bytes") != F.octet_length("content")).select("file_id", F.col("n_bytes").alias("recorded_bytes"), F.octet_length("content").alias("held_bytes"))


def restore(containers: DataFrame) -> DataFrame:
    """The stored files again: ``file_id, tile_key, content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for payload, members in zip(b.column("payload").to_pylist(), b.column("members").to_pylist()):
                out = []
                for m in members:
                    piece = payload[m["frame_offset"] : m["frame_offset"] + m["frame_bytes"]]
                    whole = piece if len(piece) == m["n_bytes"] and zlib.crc32(piece) == m["crc32"] else zstandard.ZstdDecompressor().decompress(piece, max_output_size=max(m["n_bytes"], 1))
                    out.append({"file_id": m["file_id"], "tile_key": m["tile_key"], "content": whole})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file_id", pa.int64()), ("tile_key", pa.string()), ("content", pa.binary())]))

    return containers.select("payload", "members").mapInArrow(run, "file_id bigint, tile_key string, content binary")
