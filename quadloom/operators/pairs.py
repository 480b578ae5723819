"""Pairs of matrices that share tiles, compared where their first shared tile is: pairs are never shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators import matrices as mx
from quadloom.runtime import Scratch, ship_package

WHOLE_CELLS = 32  # matrices of up to so many cells go whole with each of their tiles
PAIRS_AT_ONCE = 1 << 15
SCHEMAS = {
    "conflicts": pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_conflicts", pa.int64())]),
    "sizes": pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_cells", pa.int64()), ("n_rows", pa.int32()), ("n_cols", pa.int32())]),
    "cells": pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tile_id", pa.int64()), ("i", pa.int32()), ("j", pa.int32())]),
    "gone": pa.schema([("b", pa.int64()), ("n", pa.int64())]),
}
_DDL = {k: ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint'}" for f in s) for k, s in SCHEMAS.items()}


class _Rows:
    """Rows ``tile_id, matrix_id, pos, tiles, places`` as arrays; lists as columns, filled up with their first entry."""

    def __init__(self, t: pa.Table) -> None:
        t = t.combine_chunks()
        self.tile, self.m = t.column("tile_id").to_numpy(), t.column("matrix_id").to_numpy()
        self.part, self.role = (t.column(c).to_numpy() if c in t.column_names else np.zeros(len(self.m), np.int32) for c in ("part", "role"))
        lists = [t.column(c).combine_chunks() for c in ("tiles", "places")]
        self.n = np.diff(lists[0].offsets.to_numpy()).astype(np.int32)
        at = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        x = np.arange(self.n.max(initial=0), dtype=np.int32)[:, None]
        take = at[None, :] + np.where(x < self.n, x, 0)
        tiles, places = (x.flatten().to_numpy() for x in lists)
        self.names, codes = np.unique(tiles, return_inverse=True)
        self.t, self.p = codes.astype(np.int32)[take], places[take]
        row = np.arange(len(self.m))
        pos = t.column("pos").to_numpy()
        self.own_t, self.own_p = self.t[pos, row], self.p[pos, row]
        i = (self.p + (1 << 31)) >> 32
        j = self.p - (i << 32)
        self.i0, self.i1, self.j0, self.j1 = i.min(0), i.max(0), j.min(0), j.max(0)
        new = np.flatnonzero(np.concatenate([[True], (self.tile[1:] != self.tile[:-1]) | (self.part[1:] != self.part[:-1])]))
        self.end = np.repeat(np.append(new[1:], len(self.m)), np.diff(np.append(new, len(self.m))))


def _split(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = (p + (1 << 31)) >> 32
    return i, p - (i << 32)


def _compare(r: _Rows, a: np.ndarray, b: np.ndarray, kind: str) -> pa.RecordBatch:
    """What ``kind`` asks of the pairs of rows whose first shared tile this is and whose offsets agree."""
    move = r.own_p[a] - r.own_p[b]
    w, n = len(r.t), len(a)
    ta, pa_, na = r.t[:, a], r.p[:, a], r.n[a]
    tb, pb = r.t[:, b], r.p[:, b] + move
    bad, shared, met = np.zeros(n, bool), np.zeros(n, np.int8), np.zeros(n, np.int8)
    for x in range(w):
        s, h = np.zeros(n, bool), np.zeros(n, bool)
        for y in range(w):
            same, on = ta[x] == tb[y], pa_[x] == pb[y]
            s |= same
            h |= on
            bad |= same > on  # a shared tile at another offset
        bad |= s & (ta[x] < r.own_t[a])  # seen at an earlier tile
        real = x < na
        shared += s & real
        met += h & real
    keep = ~bad if kind == "conflicts" else ~bad & (met == shared)
    a, b, move, shared, met = a[keep], b[keep], move[keep], shared[keep], met[keep]
    if kind == "conflicts":
        cols = [r.m[a], r.m[b], (met - shared).astype(np.int64)]
    elif kind == "gone":
        cols = list(np.unique(r.m[b], return_counts=True))
    else:
        di, dj = _split(move)
        i0, j0 = np.minimum(r.i0[a], r.i0[b] + di), np.minimum(r.j0[a], r.j0[b] + dj)
        if kind == "sizes":
            cols = [r.m[a], r.m[b], (r.n[a] + r.n[b] - shared).astype(np.int64), np.maximum(r.i1[a], r.i1[b] + di) - i0 + 1, np.maximum(r.j1[a], r.j1[b] + dj) - j0 + 1]
        else:
            x = np.arange(w, dtype=np.int32)[:, None]
            ta, tb, both = r.t[:, a], r.t[:, b], np.zeros((2 * w, len(a)), bool)
            both[:w], both[w:] = x < r.n[a], x < r.n[b]
            for k in range(w):
                both[w:] &= tb != ta[k]
            at = np.flatnonzero(both.T)  # the cells of a pair lie together
            pair, slot = np.divmod(at, 2 * w) if w else (at, at)
            i, j = _split(np.concatenate([r.p[:, a], r.p[:, b] + move])[slot, pair])
            cols = [r.m[a][pair], r.m[b][pair], r.names[np.concatenate([ta, tb])[slot, pair]], i - i0[pair], j - j0[pair]]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype(), copy=False)) for c, f in zip(cols, SCHEMAS[kind])], schema=SCHEMAS[kind])


def _pairs(t: pa.Table, kind: str) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one tile (and part), smaller matrix first, a bounded number at once."""
    r = _Rows(t)
    first = np.flatnonzero(r.role != 2)
    many = r.end[first] - first - 1
    total = np.cumsum(many)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        a = np.repeat(first[at:to], many[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
        ok = (r.role[b] != 1) & (r.m[a] < r.m[b])
        if ok.any():
            yield _compare(r, a[ok], b[ok], kind)
        at = to


def _batches(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile, part and matrix; a tile may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        tile, part = b.column("tile_id").to_numpy(), b.column("part").to_numpy() if "part" in b.schema.names else np.zeros(b.num_rows, np.int32)
        last = int(np.flatnonzero((tile != tile[-1]) | (part != part[-1]))[-1]) + 1 if (tile[0], part[0]) != (tile[-1], part[-1]) else 0
        held.append(b)
        if last:
            held[-1] = b.slice(0, last)
            yield from _pairs(pa.Table.from_batches(held), kind)
            held = [b.slice(last)]
    if held:
        yield from _pairs(pa.Table.from_batches(held), kind)


def _dealt(rows: DataFrame, hot: DataFrame, holders_a_task: int) -> DataFrame:
    """Rows of tiles with many holders dealt out: once as the smaller matrix in their own part, as the larger one in every part."""
    n = F.coalesce(F.ceil(F.col("_h") / holders_a_task).cast("int"), F.lit(1))
    d = rows.join(hot, "tile_id", "left").withColumn("_n", n)
    own = F.pmod(F.xxhash64("matrix_id"), F.col("_n")).cast("int")
    spots = F.concat(F.array(F.struct(own.alias("part"), F.lit(1).alias("role"))), F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(k.alias("part"), F.lit(2).alias("role"))))
    one = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("role")))
    return d.select("*", F.explode(F.when(F.col("_n") == 1, one).otherwise(spots)).alias("_s")).select(*rows.columns, "_s.part", "_s.role")


def _over_pairs(cells: DataFrame, kind: str, holders_a_task: int, whole_cells: int) -> tuple[DataFrame, DataFrame | None]:
    """``kind`` for pairs of matrices of up to ``whole_cells`` cells, and the cells, marked, if there are larger ones.

    Every such matrix is sent whole to each of its tiles.  A pair is compared, with all that either
    holds, where the first tile is that both hold, so only matrices are shuffled.
    """
    spark = cells.sparkSession
    ship_package(spark)
    s = Scratch(spark, "pairs")
    place = mx._place(F.col("i"), F.col("j"))
    known = cells.filter("matrix_id is not null")
    c = F.sort_array(F.collect_list(F.struct(place.alias("p"), F.col("tile_id").cast("bigint").alias("t"))))
    m = s.save(known.groupBy(F.col("matrix_id").cast("bigint").alias("matrix_id")).agg(c.alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("tile_id").isNull() | place.isNull()).alias("odd")).select("matrix_id", F.col("c.t").alias("tiles"), F.col("c.p").alias("places"), "n", ((F.col("odd") > 0) | (F.col("n") > whole_cells)).alias("_big")))
    small = m.filter("not _big")
    rows = small.select("matrix_id", F.posexplode("tiles").alias("pos", "tile_id"), "tiles", "places")
    hot = s.save(small.select(F.explode("tiles").alias("tile_id")).groupBy("tile_id").agg(F.count(F.lit(1)).alias("_h")).filter(F.col("_h") > holders_a_task))
    keys = ["tile_id"]
    if hot.count():
        rows, keys = _dealt(rows, hot, holders_a_task), ["tile_id", "part"]
    # the numbers of partitions are the session's
    out = rows.repartition(*keys).sortWithinPartitions(*keys, "matrix_id").mapInArrow(lambda b: _batches(b, kind), _DDL[kind])
    if not m.filter("_big").limit(1).count():
        return out, None
    return out, known.join(m.select("matrix_id", "_big"), "matrix_id")


def _large(marked: DataFrame, holders_a_task: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of which one matrix at least is large, from all their shared tiles."""
    return mx.unanimous(mx.shared_tiles(marked, holders_a_task)), marked.drop("_big")


def conflicts(cells: DataFrame, holders_a_task: int = mx.HOLDERS_A_TASK, whole_cells: int = WHOLE_CELLS) -> DataFrame:
    """Pairs of matrices whose shared tiles agree on one offset: ``a, b, n_conflicts``."""
    out, marked = _over_pairs(cells, "conflicts", holders_a_task, whole_cells)
    return out if marked is None else out.unionByName(mx.conflicts(*_large(marked, holders_a_task)))


def merged_sizes(cells: DataFrame, holders_a_task: int = mx.HOLDERS_A_TASK, whole_cells: int = WHOLE_CELLS) -> DataFrame:
    """Cells, rows and columns of each pair without conflicts, merged."""
    out, marked = _over_pairs(cells, "sizes", holders_a_task, whole_cells)
    return out if marked is None else out.unionByName(mx.merged_sizes(*_large(marked, holders_a_task)))


def merged_cells(cells: DataFrame, holders_a_task: int = mx.HOLDERS_A_TASK, whole_cells: int = WHOLE_CELLS) -> DataFrame:
    """Cells of each pair without conflicts on one grid, moved to begin at 0."""
    out, marked = _over_pairs(cells, "cells", holders_a_task, whole_cells)
    return out if marked is None else out.unionByName(mx.merge_pairs(*_large(marked, holders_a_task)))


def gone(cells: DataFrame, holders_a_task: int = mx.HOLDERS_A_TASK, whole_cells: int = WHOLE_CELLS) -> DataFrame:
    """Matrices that a smaller one takes up without conflicts, and how many do: ``b, n``."""
    out, marked = _over_pairs(cells, "gone", holders_a_task, whole_cells)
    if marked is not None:
        out = out.unionByName(mx.conflicts(*_large(marked, holders_a_task)).filter("n_conflicts = 0").select("b", F.lit(1).cast("bigint").alias("n")))
    return out.groupBy("b").agg(F.sum("n").alias("n"))
