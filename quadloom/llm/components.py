"""Consolidating pairwise links into groups by low-diameter decomposition.

Method: every vertex draws an exponentially distributed shift from a hash of its id; clusters start
at shifted times and grow one link a round; a vertex joins the first cluster to reach it.  Clusters
are contracted to super-vertices, the links between clusters go to the next level, and the
assignments are composed.  The same decomposition runs at two places: inside blocks of at most
``BLOCK_TILES`` tile numbers of one frame (numpy, many blocks in a task), and as Spark rounds over the
links that cross blocks, whose number is unknown and may be large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.ids import format_id, packed_id
from quadloom.runtime import HOT_ROWS, Scratch, dealt_join, ship_package

BETA = 0.8
GROW_ROUNDS = 4
BLOCK_BITS = 11  # 2,048 tile numbers a block
FLUSH_ROWS = 1_000_000
TASK_LINKS = 500_000  # so few links between clusters (about 30 MB) are decomposed in one task


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _start_times(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole start rounds, and the fractions that break ties, for vertices 0..n-1."""
    h = _mix(np.arange(n, dtype=np.uint64), salt)
    u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    shift = np.minimum(-np.log1p(-np.minimum(u, 1 - 1e-16)) / BETA, float(GROW_ROUNDS))
    t = GROW_ROUNDS - shift
    return np.floor(t).astype(np.int64), t - np.floor(t)


def decompose(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label (a member's position) of vertices 0..n-1 under undirected links a-b."""
    label = np.arange(n)
    a, b, salt = a.copy(), b.copy(), 0
    while len(a):
        verts, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        m = len(verts)
        u, v = inv[: len(a)], inv[len(a) :]
        start, frac = _start_times(m, salt)
        order = np.lexsort((frac, start))
        prio = np.empty(m, np.int64)
        prio[order] = np.arange(m)
        cluster = np.full(m, -1, np.int64)
        src, dst = np.concatenate([u, v]), np.concatenate([v, u])
        for t in range(GROW_ROUNDS + 1):
            # clusters reach free neighbours; the earliest start wins
            live = (cluster[src] >= 0) & (cluster[dst] < 0)
            if live.any():
                best = np.full(m, m, np.int64)
                np.minimum.at(best, dst[live], prio[cluster[src[live]]])
                got = best < m
                cluster[got] = order[best[got]]
            own = (cluster < 0) & (start <= t)
            cluster[own] = np.flatnonzero(own)
        # contract: members point to their cluster's centre
        to = np.arange(n)
        to[verts] = verts[cluster]
        label = to[label]
        a, b = to[a], to[b]
        keep = a != b
        a, b = a[keep], b[keep]
        if len(a):
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            a, b = pair[:, 0], pair[:, 1]
        salt += 1
    return label


_LOCAL = pa.schema([("session_id", pa.int64()), ("id", pa.int64()), ("root", pa.int64())])


def _local_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels inside each block; rows come sorted by block and ``links`` stay inside it."""

    def run(t: pa.Table) -> pa.RecordBatch:
        sess, ids = t.column("session_id").to_numpy(), t.column("id").to_numpy()
        lists = t.column("links").combine_chunks()
        lens = np.diff(lists.offsets.to_numpy())
        to = lists.flatten().to_numpy(zero_copy_only=False)
        frm = np.repeat(np.arange(len(ids)), lens)
        key = np.rec.fromarrays([sess, ids])
        order = np.argsort(key, kind="stable")
        ks = key[order]
        ask = np.rec.fromarrays([sess[frm], to])
        at = np.minimum(np.searchsorted(ks, ask), max(len(ks) - 1, 0))
        hit = ks[at] == ask if len(ask) else np.zeros(0, bool)
        lab = decompose(len(ids), frm[hit], order[at[hit]] if len(ask) else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(sess), pa.array(ids), pa.array(ids[lab])], schema=_LOCAL)

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= FLUSH_ROWS:
            t = pa.Table.from_batches(held)
            s, i = t.column("session_id").to_numpy(), t.column("id").to_numpy() >> BLOCK_BITS
            change = np.flatnonzero((s[1:] != s[:-1]) | (i[1:] != i[:-1]))
            if len(change):  # the last block may go on in the next batch
                cut = int(change[-1]) + 1
                yield run(t.slice(0, cut))
                t = t.slice(cut)
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield run(pa.Table.from_batches(held))


def tile_links(tiles: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct ``session_id, id, to``: every tile with the tiles it names, ``to`` null at least once.

    ``id`` packs frame and tile number into one bigint (31 bits each; ids beyond that, or of another
    form, are no tiles).  Repeated records and links are combined before the shuffle.
    """
    ref = [packed_id(F.col(f)) for f in fields]
    rows = tiles.filter("session_id is not null").select(F.col("session_id").cast("bigint").alias("session_id"), packed_id(F.col("content_id")).alias("id"), F.explode(F.array(*ref)).alias("to")).filter("id is not null")
    return rows.withColumn("to", F.when(F.col("to") != F.col("id"), F.col("to"))).distinct()


def _decompose_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of all vertices of the links in one partition."""
    t = pa.Table.from_batches(list(batches))
    if not t.num_rows:
        return
    col = lambda c: t.column(c).to_numpy()
    ends = np.rec.fromarrays([np.concatenate([col("sa"), col("sb")]), np.concatenate([col("ra"), col("rb")])])
    verts, inv = np.unique(ends, return_inverse=True)
    label = decompose(len(verts), inv[: t.num_rows], inv[t.num_rows :])
    yield pa.RecordBatch.from_arrays([pa.array(verts[verts.dtype.names[0]]), pa.array(verts[verts.dtype.names[1]]), pa.array(verts[verts.dtype.names[0]][label]), pa.array(verts[verts.dtype.names[1]][label])], names=["sv", "rv", "st", "rt"])


def connect(edges: DataFrame, scratch: Scratch, task_links: int = TASK_LINKS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Labels of the vertices of ``a``-``b`` links, both structs ``session_id, root`` of bigints.

    Returns ``v, root``; every vertex of a component has one root, itself a member.  While more than
    ``task_links`` links are left, a level is made of Spark rounds; it costs ``GROW_ROUNDS`` joins and
    shrinks the graph by a constant factor whatever its shape, so levels are logarithmic in the number
    of links.  What is left then is decomposed, by the same rules, in one task of bounded size.  Growth
    needs, per vertex, the best of its neighbours' clusters only, which is combined before the shuffle; in
    the joins, the links of a vertex with more than ``hot_rows`` of them are dealt out over several keys.
    """
    level, maps = 0, []
    edges = scratch.save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while (n := edges.count()) > 0:
        if n <= task_links:
            flat = edges.select(F.col("a.session_id").alias("sa"), F.col("a.root").alias("ra"), F.col("b.session_id").alias("sb"), F.col("b.root").alias("rb"))
            done = flat.coalesce(1).mapInArrow(_decompose_in_task, "sv bigint, rv bigint, st bigint, rt bigint")
            maps.append(scratch.save(done.select(F.struct(F.col("sv").alias("session_id"), F.col("rv").alias("root")).alias("v"), F.struct(F.col("st").alias("session_id"), F.col("rt").alias("root")).alias("root"))))
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        u = (F.abs(F.xxhash64("v", F.lit(level)) % 1_000_003) + 0.5) / 1_000_004.0
        t = F.lit(float(GROW_ROUNDS)) - F.least(-F.log(F.lit(1.0) - u) / BETA, F.lit(float(GROW_ROUNDS)))
        state = scratch.save(both.select(F.col("a").alias("v")).distinct().withColumn("t", t).withColumn("cluster", F.when(F.floor("t") <= 0, F.struct(F.col("t"), F.col("v").alias("c")))))
        for r in range(1, GROW_ROUNDS + 1):
            reach = dealt_join(both, state.filter("cluster is not null").select(F.col("v").alias("a"), "cluster"), ["a"], "inner", hot_rows, 2 * n).groupBy(F.col("b").alias("v")).agg(F.min("cluster").alias("reach"))
            new = state.join(reach, "v", "left").select("v", "t", F.coalesce("cluster", "reach", F.when(F.floor("t") <= r, F.struct(F.col("t"), F.col("v").alias("c")))).alias("cluster"))
            new = scratch.save(new)
            scratch.drop(state)
            state = new
        step = scratch.save(state.select("v", F.col("cluster.c").alias("root")))
        maps.append(step)
        ra, rb = step.select(F.col("v").alias("a"), F.col("root").alias("ra")), step.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        moved = dealt_join(dealt_join(edges, ra, ["a"], "inner", hot_rows, n), rb, ["b"], "inner", hot_rows, n)
        new = scratch.save(moved.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        scratch.drop(edges, state)
        edges, level = new, level + 1
    if not maps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[0]
    for nxt in maps[1:]:
        out = scratch.save(dealt_join(out, nxt.select(F.col("v").alias("root"), F.col("root").alias("root2")), ["root"], "left", hot_rows).select("v", F.coalesce("root2", "root").alias("root")))
    return out


def tile_groups(tiles: DataFrame, fields: list[str] = ("south_neighbor", "east_neighbor"), task_links: int = TASK_LINKS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``session_id, content_id, group_content_id`` of every tile in a group of two or more.

    Ids in five-digit form; the group's id is its member with the lowest frame, then tile number.
    Links to tiles without a record don't count, nor do null sessions and ids that aren't
    ``<frame>_<tile>``.  Repeated records add their links.
    """
    ship_package(tiles.sparkSession)
    scratch = Scratch(tiles.sparkSession, "components")
    pairs = scratch.save(tile_links(tiles, list(fields)))
    block = F.shiftright("id", BLOCK_BITS)
    inside = F.shiftright("to", BLOCK_BITS) == block
    # a block has at most 2^BLOCK_BITS tiles, and so many links a tile inside it
    grouped = pairs.groupBy("session_id", "id").agg(F.collect_set(F.when(inside, F.col("to"))).alias("links"))
    local = grouped.repartition("session_id", block).sortWithinPartitions("session_id", block).mapInArrow(_local_clusters, "session_id bigint, id bigint, root bigint")
    local = scratch.save(local)
    # links that leave their block, between tiles that exist, on the level of block clusters
    here = local.select("session_id", "id", F.struct("session_id", "root").alias("a"))
    there = local.select("session_id", F.col("id").alias("to"), F.struct("session_id", "root").alias("b"))
    n_pairs = pairs.count()
    edges = dealt_join(dealt_join(pairs.filter(~inside), here, ["session_id", "id"], "inner", hot_rows, n_pairs), there, ["session_id", "to"], "inner", hot_rows, n_pairs).select("a", "b")
    roots = connect(edges, scratch, task_links, hot_rows)
    far = roots.select(F.col("v.session_id").alias("session_id"), F.col("v.root").alias("root"), F.col("root.root").alias("top"))
    whole = local.select("session_id", "id", "root").join(far, ["session_id", "root"], "left").select("session_id", "id", F.coalesce("top", "root").alias("g"))
    group = whole.groupBy("session_id", "g").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    fmt = lambda c: format_id(F.shiftright(c, 31), F.col(c).bitwiseAND((1 << 31) - 1))
    return dealt_join(whole, group, ["session_id", "g"], "inner", hot_rows, n_pairs).select("session_id", fmt("id").alias("content_id"), fmt("least").alias("group_content_id"))
