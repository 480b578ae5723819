"""Deeply nested frame files as flat related tables with shared objects.

Method: every object (frame, tile, vertex, uncle, matrix) is brought to a canonical form and hashed
bottom-up; a parent's hash covers its children's hashes, so equal subtrees share one identity.
Objects are stored once, bridge rows keep every occurrence with its parent and ordinal.  An object's
body holds everything of the source but what its children hold, and the places of those, so
``rebuild`` gives the source's JSON value again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.drift import parse_object
from quadloom.runtime import dealt_join, ship_package, spread

NODE_SCHEMA = "frame_key bigint, tile_no bigint, parent_id string, child_kind string, child_no bigint, object_id string, body string"
KEYS_TO_ALL = 100_000
# fixed values: field names of the nested contract
NESTED = ("triangleStrip", "uncles", "modelViewMatrix")
_ARROW = pa.schema([("frame_key", pa.int64()), ("tile_no", pa.int64()), ("parent_id", pa.string()), ("child_kind", pa.string()), ("child_no", pa.int64()), ("object_id", pa.string()), ("body", pa.string())])


def _unwrap(v: object) -> object:
    """A value that is held as JSON text, decoded."""
    if isinstance(v, str):
        try:
            return json.loads(v)
        except (ValueError, RecursionError):
            return v
    return v


def vertices(strip: object) -> list:
    """Entries of a triangle strip in any of its shapes, null entries kept.

    A list of vertices, an object with ``vertices``, vertices as lists, a flat list of numbers with
    ``stride`` (5 if none is given), or any of these as JSON text.
    """
    strip = _unwrap(strip)
    stride = 5
    if isinstance(strip, dict):
        if "vertices" not in strip:
            return [strip] if "x" in strip or "y" in strip else []
        stride = strip.get("stride") or 5
        strip = _unwrap(strip["vertices"])
    if not isinstance(strip, list):
        return []
    if strip and all(x is None or (isinstance(x, (int, float)) and not isinstance(x, bool)) for x in strip) and any(x is not None for x in strip):
        return [strip[i : i + int(stride)] for i in range(0, len(strip), int(stride))]
    return [_unwrap(x) for x in strip]


def uncle_list(v: object) -> list:
    """Entries of an uncle field in any of its shapes: list, one object, ``items``, or JSON text."""
    v = _unwrap(v)
    if isinstance(v, dict):
        if "items" not in v:
            return [v]
        v = _unwrap(v["items"])
    if isinstance(v, list):
        return [_unwrap(x) for x in v]
    return [v] if isinstance(v, str) and v else []


def matrix(v: object) -> object:
    """A model-view matrix as a flat list of numbers where it is one, else the value itself."""
    v = _unwrap(v)
    if isinstance(v, dict) and "m" in v:
        v = _unwrap(v["m"])
    if isinstance(v, str):
        try:
            return [float(x) for x in v.split()]
        except ValueError:
            return v
    if isinstance(v, list) and v and all(isinstance(x, list) for x in v):
        return [y for x in v for y in x]
    return v


def tiles_in_order(frame: object) -> Iterator[object]:
    """A frame's tiles in file order, wherever ``tiles`` lists are nested (walked without recursion)."""
    stack: list[object] = [frame]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            for k, x in reversed(v.items()):
                if k == "tiles":
                    stack.append(("tiles", x))
                elif isinstance(x, (dict, list)):
                    stack.append(x)
        elif isinstance(v, tuple):
            x = _unwrap(v[1])
            yield from x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        elif isinstance(v, list):
            stack.extend(reversed([x for x in v if isinstance(x, (dict, list))]))


def _hash(kind: str, body: str) -> str:
    return hashlib.blake2b(f"{kind}\0{body}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _canon(v: object) -> str:
    return json.dumps(v, sort_keys=True, separators=(",", ":"))


def _is_tile(v: object) -> bool:
    return isinstance(v, dict)


def _tile_body(t: dict, kids: list[tuple[str, int, str, str]]) -> str:
    """The tile without what its children hold.

    A list of vertices or uncles, and a flat list as matrix, is its children's ids; an object around a
    list of vertices or uncles keeps its other fields; any other shape is kept as it is, beside the ids.
    """
    ids: dict[str, dict[int, str]] = {"vertex": {}, "uncle": {}, "matrix": {}}
    for kind, i, h, _ in kids:
        ids[kind][i] = h
    out: dict[str, object] = {"fields": {k: v for k, v in t.items() if k not in NESTED}}
    for name, kind, inner in (("triangleStrip", "vertex", "vertices"), ("uncles", "uncle", "items"), ("modelViewMatrix", "matrix", None)):
        if name not in t:
            continue
        v, own = t[name], ids[kind]
        listed = lambda x, own=own: [own.get(i) for i in range(len(x))]
        if kind == "matrix":
            out[name] = {"ids": own[0]} if own and matrix(v) == v else {"ids": own.get(0), "value": v}
        elif _entries_are(v, kind):
            out[name] = {"ids": listed(v)}
        elif isinstance(v, dict) and inner in v and _entries_are(v[inner], kind) and (kind == "uncle" or not _flat(v[inner])):
            out[name] = {"ids": listed(v[inner]), "around": {k: x for k, x in v.items() if k != inner}}
        else:
            out[name] = {"ids": [own[i] for i in sorted(own)], "value": v}
    return _canon(out)


def _flat(v: list) -> bool:
    return any(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v)


def _entries_are(v: object, kind: str) -> bool:
    """Whether a list's entries are just the children: none of them JSON text, vertices no bare numbers."""
    return isinstance(v, list) and not any(isinstance(x, str) and _unwrap(x) != x for x in v) and not (kind == "vertex" and _flat(v))


def _without_tiles(v: object, ids: Iterator[str | None]) -> object:
    """The frame with ids in place of its tiles, taken in file order."""
    if isinstance(v, dict):
        out = {}
        for k, x in v.items():
            if k != "tiles":
                out[k] = _without_tiles(x, ids)
            elif isinstance(x, (list, dict)):
                entries = x.items() if isinstance(x, dict) else enumerate(x)
                places = [[key, {"id": next(ids)} if _is_tile(t) else {"value": (next(ids), t)[1]}] for key, t in entries]
                out[k] = {"object": places} if isinstance(x, dict) else {"list": [p for _, p in places]}
            else:
                inner = _unwrap(x)
                n = len(inner) if isinstance(inner, (list, dict)) else 0
                out[k] = {"value": x, "ids": [next(ids) for _ in range(n)]}
        return out
    return [_without_tiles(x, ids) for x in v] if isinstance(v, list) else v


def shred_frame(frame_key: int, body: str | None, with_body: bool = True) -> list[tuple]:
    """All occurrences in one frame, children before parents."""
    f = parse_object(body)
    if f is None:
        return []
    out, tile_ids = [], []
    for no, t in enumerate(tiles_in_order(f)):
        if not _is_tile(t):
            tile_ids.append(None)
            continue
        kids: list[tuple[str, int, str, str]] = []
        for kind, entries in (("vertex", vertices(t.get("triangleStrip"))), ("uncle", uncle_list(t.get("uncles")))):
            for i, x in enumerate(entries):
                if x is not None:
                    c = _canon(x)
                    kids.append((kind, i, _hash(kind, c), c))
        m = t.get("modelViewMatrix")
        if m is not None and matrix(m) is not None:
            c = _canon(matrix(m))
            kids.append(("matrix", 0, _hash("matrix", c), c))
        own = _tile_body(t, kids)
        tid = _hash("tile", own)
        tile_ids.append(tid)
        out += [(frame_key, no, tid, kind, i, h, c if with_body else None) for kind, i, h, c in kids]
        out.append((frame_key, no, None, "tile", no, tid, own if with_body else None))
    try:
        own = _canon(_without_tiles(f, iter(tile_ids)))
    except RecursionError:  # nested too deep to walk: the frame as a whole, beside its tiles' ids
        own = _canon({"tiles": {"whole": body, "ids": tile_ids}})
    fid = _hash("frame", own)
    out = [(a, b, fid if kind == "tile" else p, kind, n, h, c) for a, b, p, kind, n, h, c in out]
    out.append((frame_key, -1, None, "frame", 0, fid, own if with_body else None))
    return out


def rebuild_frame(frame_id: str, bodies: dict[str, str]) -> object:
    """The JSON value of a frame from the bodies of its objects."""

    def children(held: dict, name: str) -> object:
        if "value" in held:
            return held["value"]
        if name == "modelViewMatrix":
            return json.loads(bodies[held["ids"]])
        got = [None if h is None else json.loads(bodies[h]) for h in held["ids"]]
        if "around" not in held:
            return got
        return {**held["around"], ("vertices" if name == "triangleStrip" else "items"): got}

    def tile(h: str) -> dict:
        b = json.loads(bodies[h])
        return {**b["fields"], **{k: children(b[k], k) for k in NESTED if k in b}}

    def walk(v: object) -> object:
        if isinstance(v, list):
            return [walk(x) for x in v]
        if not isinstance(v, dict):
            return v
        out = {}
        for k, x in v.items():
            if k != "tiles":
                out[k] = walk(x)
            elif "whole" in x:
                return json.loads(x["whole"])
            elif "value" in x:
                out[k] = x["value"]
            else:
                entry = lambda e: tile(e["id"]) if "id" in e else e["value"]
                out[k] = [entry(e) for e in x["list"]] if "list" in x else {key: entry(e) for key, e in x["object"]}
        return out

    return walk(json.loads(bodies[frame_id]))


def rebuild(bridges: DataFrame, objects: DataFrame) -> DataFrame:
    """``frame_key, body`` of every frame from the stored objects: the source in canonical JSON."""
    ship_package(bridges.sparkSession)
    used = bridges.select("frame_key", "child_kind", "object_id").distinct()

    def run(t: pa.Table) -> pa.Table:
        bodies = dict(zip(t.column("object_id").to_pylist(), t.column("body").to_pylist()))
        frame = next(h for h, k in zip(t.column("object_id").to_pylist(), t.column("child_kind").to_pylist()) if k == "frame")
        return pa.table({"frame_key": pa.array([t.column("frame_key")[0].as_py()], pa.int64()), "body": pa.array([_canon(rebuild_frame(frame, bodies))])})

    # one frame's objects are no more than its file held
    return dealt_join(used, objects.select("object_id", "body"), ["object_id"]).groupBy("frame_key").applyInArrow(run, "frame_key bigint, body string")


def canonical(frames: DataFrame) -> DataFrame:
    """``frame_key, body`` with the body as canonical JSON; broken bodies and repeated keys as in ``shred``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(k, parse_object(x)) for k, x in zip(b.column("frame_key").to_pylist(), b.column("body").to_pylist())]
            got = [(k, _canon(v)) for k, v in got if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([v for _, v in got], pa.string())], names=["frame_key", "body"])

    return once(frames).mapInArrow(run, "frame_key bigint, body string")


def _mapper(with_body: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, body in zip(b.column("frame_key").to_pylist(), b.column("body").to_pylist()):
                rows += shred_frame(key, body, with_body)
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return run


def once(frames: DataFrame) -> DataFrame:
    """``frame_key, body`` of one file a key.

    Only the bodies of files that were sent again are compared, and the others stay where they are, while
    at most ``KEYS_TO_ALL`` keys come more than once, so that the list of those can go to all tasks; above
    that all bodies are shuffled by key.
    """
    f = frames.filter("frame_key is not null and body is not null").select(F.col("frame_key").cast("bigint").alias("frame_key"), "body")
    again = f.groupBy("frame_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("frame_key")
    if again.count() > KEYS_TO_ALL:
        return f.groupBy("frame_key").agg(F.min("body").alias("body"))
    again = F.broadcast(again)
    return f.join(again, "frame_key", "left_anti").unionByName(f.join(again, "frame_key", "left_semi").groupBy("frame_key").agg(F.min("body").alias("body")))


def shred(frames: DataFrame, with_body: bool = True) -> DataFrame:
    """Every occurrence of every object, once per distinct ``frame_key``.

    Output: ``NODE_SCHEMA``; ``tile_no`` counts a frame's tiles from 0 in file order (-1: the frame),
    ``child_no`` a tile's vertices or uncles from 0, null entries counted but not stored.  Files sent
    again carry equal bodies; one of them is read.  Rows without a key and broken bodies give nothing.
    """
    ship_package(frames.sparkSession)
    return spread(once(frames)).mapInArrow(_mapper(with_body), NODE_SCHEMA)


def objects(nodes: DataFrame) -> DataFrame:
    """Identical objects once: ``object_id, object_kind, body, n_occurrences``."""
    return nodes.groupBy("object_id", F.col("child_kind").alias("object_kind")).agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("n_occurrences"))


def bridges(nodes: DataFrame) -> DataFrame:
    """Every occurrence: ``frame_key, tile_no, parent_id, child_kind, child_no, object_id``."""
    return nodes.select("frame_key", "tile_no", "parent_id", "child_kind", "child_no", "object_id")
