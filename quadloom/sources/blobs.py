"""Binary blobs: transparent decompression and little-endian decoding as Arrow functions."""

from __future__ import annotations

import bz2
import gzip
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: leading bytes of compressed containers
MAGIC = {b"BZh": "bzip2", b"\x1f\x8b": "gzip", b"\x28\xb5\x2f\xfd": "zstd", b"at": "snappy"}
SNAPPY_CHUNK = 1 << 20
SEEKABLE_END = b"\xb1\xea\x92\x8f"  # last bytes of a zstd file with a table of its frames


def container_of(data: bytes) -> str:
    return next((name for magic, name in MAGIC.items() if data.startswith(magic)), "plain")


class SnappyChunks(io.RawIOBase):
    """Contents of a snappy container: a two-byte mark, then chunks, each after its length in four bytes."""

    def __init__(self, raw) -> None:
        self.raw, self.held = raw, b""
        self.raw.read(2)

    def readable(self) -> bool:
        return True

    def _next(self) -> bytes:
        head = self.raw.read(4)
        if len(head) < 4:
            return b""
        chunk = self.raw.read(int.from_bytes(head, "little"))
        size = shift = 0
        for b in chunk:  # the chunk begins with its plain length
            size |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                break
        return pa.decompress(chunk, decompressed_size=size, codec="snappy", asbytes=True)

    def read(self, n: int = -1) -> bytes:
        while n < 0 or len(self.held) < n:
            more = self._next()
            if not more:
                break
            self.held += more
        out, self.held = (self.held, b"") if n < 0 else (self.held[:n], self.held[n:])
        return out


def open_plain(raw, fallback: str = "plain"):
    """A stream of the contents of a binary file, whichever container it is in; ``fallback`` for those without a mark."""
    head = raw.read(4)
    raw.seek(0)
    kind = container_of(head)
    kind = fallback if kind == "plain" else kind
    if kind == "bzip2":
        return bz2.BZ2File(raw)
    if kind == "gzip":
        return gzip.GzipFile(fileobj=raw)
    if kind == "zstd":  # with or without a table of frames, which is a frame to be skipped
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    if kind == "snappy":
        return SnappyChunks(raw)
    return pa.CompressedInputStream(raw if isinstance(raw, pa.NativeFile) else pa.PythonFile(raw), "brotli") if kind == "brotli" else raw


def plain_bytes(data: bytes | None) -> bytes | None:
    """Contents of a blob, whichever container it is in; null for null or broken data."""
    if data is None:
        return None
    try:
        kind = container_of(data)
        if kind == "bzip2":
            return bz2.decompress(data)
        if kind == "gzip":
            return gzip.decompress(data)
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        return SnappyChunks(io.BytesIO(data)).read() if kind == "snappy" else data
    except Exception:
        return None


def container_kind(content: Column) -> Column:
    """Name of the container a binary value is in, by its leading bytes."""
    c = None
    for mark, name in MAGIC.items():
        hit = F.substring(content, 1, len(mark)) == F.lit(mark)
        c = F.when(hit, name) if c is None else c.when(hit, name)
    return F.when(content.isNotNull(), c.otherwise("plain"))


def packed_bytes(data: bytes, kind: str) -> bytes:
    """The bytes in a container of the given kind."""
    if kind == "bzip2":
        return bz2.compress(data)
    if kind == "gzip":
        return gzip.compress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.compress(data)
    if kind == "snappy":
        chunks = [pa.compress(data[i : i + SNAPPY_CHUNK], codec="snappy", asbytes=True) for i in range(0, len(data), SNAPPY_CHUNK)]
        return b"at" + b"".join(len(c).to_bytes(4, "little") + c for c in chunks)
    return data


@F.pandas_udf(T.BinaryType())
def pack(data: pd.Series, kind: pd.Series) -> pd.Series:
    """Binary values in containers of the given numbers: plain, then those of ``MAGIC`` in order."""
    names = ["plain", *MAGIC.values()]
    return pd.Series([None if b is None else packed_bytes(b, names[int(k)]) for b, k in zip(data, kind)])


@F.pandas_udf(T.BinaryType())
def unpack(data: pd.Series) -> pd.Series:
    return data.map(plain_bytes)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decode_u16(data: pd.Series) -> pd.Series:
    """Little-endian 16-bit indices; an odd rest byte is dropped, null stays null."""
    return data.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 2 * 2], "<u2").astype(int).tolist())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(data: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; rest bytes are dropped, null stays null."""
    return data.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4").tolist())


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def texture_coordinates(data: pd.Series, stride: pd.Series, size: pd.Series) -> pd.Series:
    """(u, v) pairs at a stride in bytes (0: packed); components beyond the data are 0."""
    out = []
    for b, s, n in zip(data, stride, size):
        if b is None:
            out.append(None)
            continue
        step = int(s) or int(n) * 4
        row = []
        for at in range(0, max(len(b), 1), step):
            x = np.frombuffer(b[at : at + 8][: len(b[at : at + 8]) // 4 * 4], "<f4")
            row.append([float(x[0]) if len(x) > 0 else 0.0, float(x[1]) if len(x) > 1 else 0.0])
        out.append(row)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def line_strips(indices: pd.Series, n_vertices: pd.Series, mode: pd.Series) -> pd.Series:
    """Strips of valid indices: an invalid one ends a strip; pairs for single lines, closed for loops."""
    out = []
    for idx, n, m in zip(indices, n_vertices, mode):
        if idx is None:
            out.append(None)
            continue
        strips: list[list[int]] = [[]]
        for i in idx:
            if 0 <= i < n:
                strips[-1].append(int(i))
            elif strips[-1]:
                strips.append([])
        if m == "GL_LINES":
            flat = [i for s in strips for i in s]
            strips = [flat[k : k + 2] for k in range(0, len(flat) - 1, 2)]
        if m == "GL_LINE_LOOP":
            strips = [[*s, s[0]] if len(s) > 2 else s for s in strips]
        out.append([s for s in strips if len(s) > 1])
    return pd.Series(out)


@F.pandas_udf(T.BinaryType())
def to_rgba(data: pd.Series, fmt: pd.Series) -> pd.Series:
    """Pixels of any of the known channel orders as RGBA bytes."""
    # fixed values: where red, green, blue and alpha come from; -1 is 0, -2 is 255
    order = {"GL_ALPHA": (1, (-1, -1, -1, 0)), "GL_LUMINANCE": (1, (0, 0, 0, -2)), "GL_LUMINANCE_ALPHA": (2, (0, 0, 0, 1)), "GL_RGB": (3, (0, 1, 2, -2)), "GL_BGR": (3, (2, 1, 0, -2)), "GL_RGBA": (4, (0, 1, 2, 3)), "GL_BGRA": (4, (2, 1, 0, 3))}

    def one(b, f):
        if b is None or f not in order:
            return None
        n, pick = order[f]
        px = np.frombuffer(b[: len(b) // n * n], np.uint8).reshape(-1, n)
        cols = [np.zeros(len(px), np.uint8) if p == -1 else np.full(len(px), 255, np.uint8) if p == -2 else px[:, p] for p in pick]
        return np.stack(cols, 1).tobytes()

    return pd.Series([one(b, f) for b, f in zip(data, fmt)])


def read_blobs(spark: SparkSession, path: str, glob: str = "*.bin*") -> DataFrame:
    """``path, content`` of blob files below a folder, decompressed; ``x.bin.bz2`` is listed as ``x.bin``."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return f.select(F.regexp_replace("path", r"\.(bz2|gz|zst)$", "").alias("path"), unpack("content").alias("content"))
