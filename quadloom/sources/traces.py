"""Binary call traces as a Spark data source.

Container: optional compression (detected by its leading bytes), then a stream of events.  Integers
are 7-bit groups, low group first.  Event 0 enters a call (thread, signature, details), event 1 leaves
one (call number, details); signatures are written out on first use.  Calls left open by threads that
interleave are paired by their number; a call without its leaving event is incomplete.

Traces are streamed, never held.  A list of bookmarks beside a trace (``write_bookmarks``) splits it:
each holds a place at which no call is open, the number of the next call, and how many signatures were
written before it; the signatures themselves are listed once, so a part can be read by itself.
"""

from __future__ import annotations

import base64
import io
import json
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadloom.runtime import file_store, ship_package, write_whole
from quadloom.sources.blobs import open_plain

FIELDS = {"path": "string", "call_no": "bigint", "thread_id": "bigint", "name": "string", "args": "string", "ret": "string", "complete": "boolean"}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
BOOKMARKS = ".bookmarks.json"
CHUNK = 1 << 20
STOP_AFTER = 100  # fixed value: calls beyond the last one wanted, as threads may leave out of order
# fixed values: tags of the trace format
ENTER, LEAVE = 0, 1
END, ARG, RET, THREAD = 0, 1, 2, 3
NULL, FALSE, TRUE, SINT, UINT, FLOAT, DOUBLE, STRING, BLOB, ENUM, BITMASK, ARRAY, STRUCT, OPAQUE, REPR, WSTRING = range(16)


class Cursor:
    """Reads a stream forward; ``tell`` is the place in its plain contents."""

    def __init__(self, stream, base: int = 0) -> None:
        self.stream, self.buf, self.at, self.base = stream, b"", 0, base

    def _fill(self, n: int) -> bool:
        while len(self.buf) - self.at < n:
            more = self.stream.read(max(CHUNK, n - len(self.buf) + self.at))
            if not more:
                return False
            self.base += self.at
            self.buf, self.at = self.buf[self.at :] + more, 0
        return True

    def tell(self) -> int:
        return self.base + self.at

    def more(self) -> bool:
        return self.at < len(self.buf) or self._fill(1)

    def byte(self) -> int:
        if self.at >= len(self.buf) and not self._fill(1):
            raise IndexError("trace ends early")
        b = self.buf[self.at]
        self.at += 1
        return b

    def uint(self) -> int:
        n = shift = 0
        while True:
            b = self.byte()
            n |= (b & 0x7F) << shift
            if not b & 0x80:
                return n
            shift += 7

    def take(self, n: int) -> bytes:
        if len(self.buf) - self.at < n and not self._fill(n):
            raise IndexError("trace ends early")
        out = self.buf[self.at : self.at + n]
        self.at += n
        return out

    def skip(self, n: int) -> None:
        while n:
            k = min(n, len(self.buf) - self.at)
            self.at += k
            n -= k
            if n and not self._fill(1):
                raise IndexError("trace ends early")

    def text(self) -> str:
        return self.take(self.uint()).decode("utf-8", "replace")


class Trace:
    """Calls of one trace, whole or from a bookmark on, as they are left.

    ``want_values`` false: values are passed over, not made.  ``blobs``: ``size`` gives ``blob(n)``,
    ``base64`` the bytes as ``{"blob": ...}``.
    """

    def __init__(self, data, want_values: bool = True, blobs: str = "size", known: dict | None = None, mark: dict | None = None) -> None:
        stream = io.BytesIO(data) if isinstance(data, bytes) else data
        self.want, self.blobs = want_values, blobs
        self.functions: dict[int, tuple[str, list[str]]] = {}
        self.structs: dict[int, list[str]] = {}
        self.enums: dict[int, dict[int, str]] = {}
        self.masks: dict[int, list[tuple[str, int]]] = {}
        self.next_call = 0
        self.open: dict[int, dict] = {}
        if mark is None:
            self.c = Cursor(stream)
            self.version = self.c.uint()
            return
        self.c = Cursor(stream, mark["offset"])
        self.version, self.next_call = known["version"], mark["call_no"]
        first = lambda k: dict(known[k][: mark[k]])
        self.functions = {i: (n, list(a)) for i, (n, a) in first("functions").items()}
        self.structs = first("structs")
        self.enums = {i: {int(k): v for k, v in e.items()} for i, e in first("enums").items()}
        self.masks = {i: [tuple(x) for x in m] for i, m in first("masks").items()}

    def function(self) -> tuple[str, list[str]]:
        i = self.c.uint()
        if i not in self.functions:
            self.functions[i] = (self.c.text(), [self.c.text() for _ in range(self.c.uint())])
        return self.functions[i]

    def signed(self) -> int:
        tag = self.c.byte()
        n = self.c.uint()
        return -n if tag == SINT else n

    def value(self) -> object:
        c, tag = self.c, self.c.byte()
        if tag == NULL:
            return None
        if tag in (FALSE, TRUE):
            return tag == TRUE
        if tag == SINT:
            return -c.uint()
        if tag == UINT:
            return c.uint()
        if tag == FLOAT:
            return struct.unpack("<f", c.take(4))[0]
        if tag == DOUBLE:
            return struct.unpack("<d", c.take(8))[0]
        if tag == STRING:
            return c.text() if self.want else c.skip(c.uint())
        if tag == WSTRING:
            return "".join(chr(c.uint()) for _ in range(c.uint()))
        if tag == BLOB:
            n = c.uint()
            if self.want and self.blobs == "base64":
                return {"blob": base64.b64encode(c.take(n)).decode()}
            c.skip(n)
            return f"blob({n})"
        if tag == ENUM:
            i = c.uint()
            if i not in self.enums:
                names = {}
                for _ in range(c.uint()):
                    name = c.text()
                    names[self.signed()] = name
                self.enums[i] = names
            v = self.signed()
            return self.enums[i].get(v, v)
        if tag == BITMASK:
            i = c.uint()
            if i not in self.masks:
                self.masks[i] = [(c.text(), c.uint()) for _ in range(c.uint())]
            v = c.uint()
            return " | ".join(n for n, m in self.masks[i] if m and v & m == m) or v
        if tag == ARRAY:
            return [self.value() for _ in range(c.uint())]
        if tag == STRUCT:
            i = c.uint()
            if i not in self.structs:
                n = c.uint()
                c.text()
                self.structs[i] = [c.text() for _ in range(n)]
            return {k: self.value() for k in self.structs[i]}
        if tag == OPAQUE:
            return hex(c.uint())
        if tag == REPR:
            human = self.value()
            self.value()
            return human
        raise ValueError(f"unknown value tag {tag}")

    def calls(self, until: int | None = None) -> Iterator[dict]:
        """Calls up to the place ``until``; those still open there are incomplete."""
        try:
            while self.c.more() and (until is None or self.c.tell() < until):
                event = self.c.byte()
                if event == ENTER:
                    thread = self.c.uint()
                    name, args = self.function()
                    call = {"call_no": self.next_call, "thread_id": thread, "name": name, "_names": args, "args": {}, "ret": None, "complete": False}
                    self.open[self.next_call] = call
                    self.next_call += 1
                    self._details(call)
                elif event == LEAVE:
                    no = self.c.uint()
                    call = self.open.get(no) or {"_names": [], "args": {}}
                    self._details(call)
                    if self.open.pop(no, None):
                        call["complete"] = True
                        yield call
                else:
                    raise ValueError(f"unknown event {event}")
        except IndexError:
            pass  # a trace cut short keeps its whole calls; the rest is incomplete
        yield from self.open.values()

    def _details(self, call: dict) -> None:
        while (tag := self.c.byte()) != END:
            if tag == ARG:
                i = self.c.uint()
                v = self.value()
                call["args"][call["_names"][i] if i < len(call["_names"]) else str(i)] = v
            elif tag == RET:
                call["ret"] = self.value()
            elif tag == THREAD:
                call["thread_id"] = self.c.uint()
            else:
                raise ValueError(f"unknown detail {tag}")


def bookmarks(data, every: int = 100_000) -> dict:
    """Places about ``every`` calls apart, and all signatures in the order of their first use."""
    t = Trace(data, want_values=False)
    marks: list[dict] = []
    last = 0
    for call in t.calls():
        if call["complete"] and not t.open and t.next_call - last >= every:
            last = t.next_call
            marks.append({"offset": t.c.tell(), "call_no": last, "functions": len(t.functions), "structs": len(t.structs), "enums": len(t.enums), "masks": len(t.masks)})
    return {"version": t.version, "marks": marks, "functions": list(t.functions.items()), "structs": list(t.structs.items()), "enums": list(t.enums.items()), "masks": list(t.masks.items())}


def _open(path: str):
    """The contents of a trace file on any file system; one without a mark and a version number is brotli."""
    store, at = file_store(path)
    raw = store.open_input_file(at)
    head = raw.read(1)
    raw.seek(0)
    return open_plain(raw, "plain" if head and head[0] < 16 else "brotli")


def trace_files(pattern: str) -> list[str]:
    """Files of a path with ``*``, ``?`` and ``**``, sorted; hidden files and bookmarks are none."""
    wild = re.search(r"[*?]", pattern)
    if not wild:
        return [pattern]
    base = pattern[: pattern.rindex("/", 0, wild.start()) + 1] if "/" in pattern[: wild.start()] else "./"
    from pyarrow import fs

    store, root = file_store(base.rstrip("/") or "/")
    rest = re.escape(pattern[len(base) :] if pattern.startswith(base) else pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    found = store.get_file_info(fs.FileSelector(root, recursive="/" in pattern[len(base) :] or "**" in pattern, allow_not_found=True))
    inside = [f.path[len(root.rstrip("/")) + 1 :] for f in found if f.is_file]
    return sorted(base + p for p in inside if re.fullmatch(rest, p) and not p.endswith(BOOKMARKS) and not p.rsplit("/", 1)[-1].startswith("."))


def _known(path: str) -> dict | None:
    store, at = file_store(path + BOOKMARKS)
    if not store.get_file_info(at).is_file:
        return None
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


class _Part(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.blobs = options["path"], options.get("blobs", "size")
        self.columns = [c for c in options.get("columns", "").split(",") if c] or list(FIELDS)
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in trace_files(self.path):
            marks = [None, *((_known(path) or {"marks": []})["marks"]), {"offset": None, "call_no": None}]
            for no, (a, b) in enumerate(pairwise(marks)):
                begins, ends = a["call_no"] if a else 0, b["call_no"]
                if (ends is None or ends > self.first) and (self.last is None or begins <= self.last):
                    parts.append(_Part((path, no - 1, b["offset"])))
        return parts or [_Part(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
        schema = pa.schema([(c, types[FIELDS[c]]) for c in self.columns])
        if partition.value is None:
            return
        path, no, until = partition.value
        stream = _open(path)
        known = mark = None
        if no >= 0:
            known = _known(path)
            mark = known["marks"][no]
            if isinstance(stream, pa.NativeFile) and stream.seekable():
                stream.seek(mark["offset"])
            else:
                left = mark["offset"]
                while left and (got := stream.read(min(left, CHUNK))):
                    left -= len(got)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        with_values = bool({"args", "ret"} & set(self.columns))
        for c in Trace(stream, with_values, self.blobs, known, mark).calls(until):
            if self.last is not None and c["call_no"] > self.last + STOP_AFTER:
                break
            if c["call_no"] < self.first or self.last is not None and c["call_no"] > self.last:
                continue
            one = {"path": path, "args": json.dumps(c["args"]) if with_values else None, "ret": None if c["ret"] is None else json.dumps(c["ret"])}
            rows.append(tuple(one[k] if k in one else c[k] for k in self.columns))
            if len(rows) >= 8192:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


class CallTraceSource(DataSource):
    """``spark.read.format("calltrace").load("folder/*.trace")``: a partition a part between bookmarks.

    Options: ``columns`` (others are not made), ``first`` and ``last`` call number, ``blobs``.
    """

    @classmethod
    def name(cls) -> str:
        return "calltrace"

    def schema(self) -> str:
        return ", ".join(f"{c} {FIELDS[c]}" for c in ([x for x in self.options.get("columns", "").split(",") if x] or FIELDS))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_traces(spark: SparkSession, path: str, columns: list[str] | None = None, first: int = 0, last: int | None = None, blobs: str = "size") -> DataFrame:
    """Calls of all traces under ``path`` (any file system, ``*``, ``?``, ``**``).

    Only ``columns`` are made: without ``args`` and ``ret`` values are passed over.  Parts of a trace that
    end before call ``first`` or begin after ``last`` are not opened, and reading ends ``STOP_AFTER`` calls
    after ``last``, as threads may leave their calls out of order.
    """
    ship_package(spark)
    spark.dataSource.register(CallTraceSource)
    r = spark.read.format("calltrace").option("first", str(first)).option("blobs", blobs)
    if columns:
        r = r.option("columns", ",".join(columns))
    if last is not None:
        r = r.option("last", str(last))
    return r.load(path)


def write_bookmarks(spark: SparkSession, path: str, every: int = 100_000) -> DataFrame:
    """Writes the bookmarks of every trace under ``path`` beside it, a task a trace: ``path, n_marks``."""
    ship_package(spark)
    files = trace_files(path)
    df = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(len(files), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = []
            for p in b.column("path").to_pylist():
                found = bookmarks(_open(p), every)
                store, at = file_store(p + BOOKMARKS)
                with store.open_output_stream(at) as f:
                    f.write(json.dumps(found).encode())
                n.append(len(found["marks"]))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(n, pa.int64())], names=["path", "n_marks"])

    return df.mapInArrow(run, "path string, n_marks bigint")


def export_blobs(calls: DataFrame, uri: str) -> DataFrame:
    """Buffers passed to calls as files, and their manifest lines: ``frame_id, call_no, arg, file, n_bytes, line``.

    ``calls``: ``frame_id, call_no, name, args`` read with ``blobs="base64"``.  Each blob becomes a
    ``.bin.bz2`` file in its frame's folder of five digits, written whole before it gets its name;
    the lines of a frame go to its ``manifest.txt`` by ``write_frame_files``.
    """
    ship_package(calls.sparkSession)
    schema = pa.schema([("frame_id", pa.int64()), ("call_no", pa.int64()), ("arg", pa.string()), ("file", pa.string()), ("n_bytes", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bz2

        store, base = file_store(uri)
        for b in batches:
            rows = []
            for frame, no, name, args in zip(*(b.column(c).to_pylist() for c in ("frame_id", "call_no", "name", "args"))):
                for arg, v in json.loads(args or "{}").items():
                    if not (isinstance(v, dict) and set(v) == {"blob"}):
                        continue
                    data = base64.b64decode(v["blob"])
                    file = f"{base}/{frame:05d}/{name}_{arg}_call_{no}.bin.bz2"
                    write_whole(store, file, bz2.compress(data))
                    line = f"kind={name} frame={frame} call={no} file={file} arg={arg} bytes={len(data)} compression=bzip2"
                    rows.append({"frame_id": frame, "call_no": no, "arg": arg, "file": file, "n_bytes": len(data), "line": line})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return calls.select(F.col("frame_id").cast("bigint").alias("frame_id"), "call_no", "name", "args").filter("args is not null").mapInArrow(run, "frame_id bigint, call_no bigint, arg string, file string, n_bytes bigint, line string")


def write_frame_files(lines: DataFrame, uri: str, name: str = "gl.txt") -> DataFrame:
    """Lines of every frame as one file in its folder: ``frame_id, file, n_lines``.

    ``lines``: ``frame_id, order, line``.  A frame is a task's group: it is bounded by what one frame of a
    trace holds.  Files are written whole before they get their name.
    """
    ship_package(lines.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("order")
        frame = t.column("frame_id")[0].as_py()
        store, base = file_store(uri)
        file = f"{base}/{frame:05d}/{name}"
        write_whole(store, file, "".join(f"{x or ''}\n" for x in t.column("line").to_pylist()).encode())
        return pa.table({"frame_id": pa.array([frame], pa.int64()), "file": [file], "n_lines": pa.array([t.num_rows], pa.int64())})

    return lines.select(F.col("frame_id").cast("bigint").alias("frame_id"), "order", "line").filter("frame_id is not null").groupBy("frame_id").applyInArrow(run, "frame_id bigint, file string, n_lines bigint")


def write_trace(calls: list[tuple[int, str, dict, object]]) -> bytes:
    """A small trace of the given (thread, name, arguments, result) calls, for tests and round trips."""
    out = bytearray()

    def uint(n: int) -> None:
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)

    def text(s: str) -> None:
        b = s.encode()
        uint(len(b))
        out.extend(b)

    def value(v: object) -> None:
        if v is None:
            out.append(NULL)
        elif isinstance(v, bool):
            out.append(TRUE if v else FALSE)
        elif isinstance(v, int):
            out.append(UINT if v >= 0 else SINT)
            uint(abs(v))
        elif isinstance(v, float):
            out.append(DOUBLE)
            out.extend(struct.pack("<d", v))
        elif isinstance(v, bytes):
            out.append(BLOB)
            uint(len(v))
            out.extend(v)
        elif isinstance(v, list):
            out.append(ARRAY)
            uint(len(v))
            for x in v:
                value(x)
        else:
            out.append(STRING)
            text(str(v))

    uint(6)
    sigs: dict[str, int] = {}
    for n, (thread, name, args, ret) in enumerate(calls):
        out.append(ENTER)
        uint(thread)
        new = name not in sigs
        uint(sigs.setdefault(name, len(sigs)))
        if new:
            text(name)
            uint(len(args))
            for a in args:
                text(a)
        for i, v in enumerate(args.values()):
            out.append(ARG)
            uint(i)
            value(v)
        out.append(END)
        out.append(LEAVE)
        uint(n)
        if ret is not None:
            out.append(RET)
            value(ret)
        out.append(END)
    return bytes(out)


def calls_table(data: bytes) -> pa.Table:
    rows = [{k: (json.dumps(v) if k in ("args", "ret") else v) for k, v in c.items() if k != "_names"} for c in Trace(data).calls()]
    return pa.Table.from_pylist(rows)
