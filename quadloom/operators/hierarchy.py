"""Parent-child links to full hierarchies with nested-set ranges.

Method: subtree sizes upward, sibling preorder ranges by prefix sums downward; nodes that neither
pass reaches lie on a loop or hang below one.  Groups (one export, one pyramid) up to
``max_group_rows`` are laid out inside tasks, many groups at a time with numpy; a larger group is
laid out by ``nested_sets_distributed``, whose rounds are Spark jobs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.runtime import HOT_ROWS, Scratch, dealt_join, range_blocks, ship_package

MAX_GROUP_ROWS = 200_000
BUCKET_ROWS = 400_000
NODE_SCHEMA = "group_id bigint, node_key string, parent_key string, root_key string, node_depth bigint, subtree_size bigint, lft bigint, rgt bigint"


def layout(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """root, depth, subtree size and preorder position of a forest given as parent positions.

    ``parent`` holds -1 for roots.  Siblings keep their order of position.  Nodes on or below a loop
    get root -1, depth -1, size 0 and position -1.
    """
    n = len(parent)
    size = np.ones(n, np.int64)
    has = parent >= 0
    waiting = np.bincount(parent[has], minlength=n)
    # upward: leaves give their size to the parent, level by level
    ready = np.flatnonzero(waiting == 0)
    done = np.zeros(n, bool)
    levels = []
    while len(ready):
        done[ready] = True
        levels.append(ready)
        up = ready[parent[ready] >= 0]
        p = parent[up]
        np.add.at(size, p, size[up])
        np.subtract.at(waiting, p, 1)
        p = np.unique(p)
        ready = p[waiting[p] == 0]
    # downward: a node's children share the range behind it by a prefix sum over siblings
    root = np.full(n, -1, np.int64)
    depth = np.full(n, -1, np.int64)
    pos = np.full(n, -1, np.int64)
    order = np.lexsort((np.arange(n), parent))
    sp = parent[order]
    first = np.searchsorted(sp, np.arange(-1, n))  # first child of node i at first[i + 1]
    last = np.searchsorted(sp, np.arange(-1, n), side="right")
    csize = np.concatenate([[0], np.cumsum(np.where(done[order], size[order], 0))])
    front = order[first[0] : last[0]]
    front = front[done[front]]
    root[front] = front
    depth[front] = 0
    pos[front] = np.concatenate([[0], np.cumsum(size[front])[:-1]]) if len(front) else front
    while len(front):
        cnt = last[front + 1] - first[front + 1]
        up = np.repeat(front, cnt)
        if not len(up):
            break
        start = np.repeat(first[front + 1], cnt)
        at = start + np.arange(len(up)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        kids = order[at]
        root[kids] = root[up]
        depth[kids] = depth[up] + 1
        pos[kids] = pos[up] + 1 + csize[at] - csize[start]
        front = kids
    size = np.where(root >= 0, size, 0)
    return root, depth, size, pos


def prefix_parents(group: np.ndarray, keys: list[str]) -> np.ndarray:
    """Position of each key's longest shorter prefix in its group; rows sorted by (group, key)."""
    parent = np.full(len(keys), -1, np.int64)
    stack: list[int] = []
    now = None
    for i, k in enumerate(keys):
        if group[i] != now:
            now, stack = group[i], []
        while stack and not k.startswith(keys[stack[-1]]):
            stack.pop()
        if stack:
            parent[i] = stack[-1]
        stack.append(i)
    return parent


_ARROW = pa.schema([("group_id", pa.int64()), ("node_key", pa.string()), ("parent_key", pa.string()), ("root_key", pa.string()), ("node_depth", pa.int64()), ("subtree_size", pa.int64()), ("lft", pa.int64()), ("rgt", pa.int64())])


def _local(prefix: bool):
    def run(t: pa.Table) -> pa.Table:
        cols = ["node_key"] if prefix else ["node_key", "parent_key"]
        t = t.select(["group_id", *cols])
        group = t.column("group_id").to_numpy()
        if prefix:
            t = t.sort_by([("group_id", "ascending"), ("node_key", "ascending")])
            group = t.column("group_id").to_numpy()
            names = t.column("node_key").to_pylist()
            parent = prefix_parents(group, names)
        else:
            key = t.column("node_key").to_numpy().astype(np.int64)
            order = np.lexsort((key, group))
            group, key = group[order], key[order]
            asked = t.column("parent_key").combine_chunks()
            has = ~asked.is_null().to_numpy(zero_copy_only=False)[order]
            want = asked.fill_null(0).to_numpy(zero_copy_only=False)[order]
            parent = np.full(len(key), -1, np.int64)
            both = np.rec.fromarrays([group, key])
            ask = np.rec.fromarrays([group[has], want[has]])
            at = np.minimum(np.searchsorted(both, ask), len(key) - 1)
            parent[np.flatnonzero(has)] = np.where(both[at] == ask, at, -1)
            names = key.astype(str).tolist()
        root, depth, size, pos = layout(parent)
        # positions count from 0 in each group
        ok = pos >= 0
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        low = np.minimum.reduceat(np.where(ok, pos, np.iinfo(np.int64).max), heads) if len(heads) else heads
        start = np.repeat(low, np.diff(np.append(heads, len(group))))
        nm = np.array(names, object)
        pick = lambda ix: np.where(ix >= 0, nm[np.maximum(ix, 0)], None)
        lft = np.where(ok, pos - start, -1)
        return pa.table(
            [pa.array(group), pa.array(names, pa.string()), pa.array(pick(parent), pa.string()), pa.array(np.where(root >= 0, pick(root), "cycle"), pa.string()), pa.array(depth), pa.array(size), pa.array(lft), pa.array(np.where(ok, lft + size - 1, -1))],
            schema=_ARROW,
        )

    return run


def nested_sets(nodes: DataFrame, prefix: bool, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Root, depth, subtree size and nested-set range (``lft``..``rgt``) of every node.

    Input: distinct (``group_id`` bigint, ``node_key``) rows.  With ``prefix`` the key is a quadkey
    string whose parent is its longest shorter prefix in the group; else the key is a bigint and
    ``parent_key`` names the parent.  A parent that is null or absent makes a root.  On or below a
    loop: ``root_key`` 'cycle', depth -1, size 0, range -1.  ``d`` is a descendant of ``a`` where
    both share a group and ``a.lft < d.lft <= a.rgt``.  No rows give no rows.
    """
    scratch = Scratch(nodes.sparkSession, "hierarchy")
    nodes = scratch.save(nodes)
    counts = nodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    rows, most = counts["n"] or 0, counts["most"] or 0
    small, large = nodes, None
    if most > max_group_rows:
        sizes = nodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
        big = F.broadcast(sizes.filter(F.col("n") > max_group_rows).select("group_id"))  # fewer than rows / bound ids
        small, large = nodes.join(big, "group_id", "left_anti"), scratch.save(nodes.join(big, "group_id"))
    n_buckets = max(1, -(-rows // BUCKET_ROWS), min(24, rows // 20_000))
    out = (
        small.withColumn("_b", F.pmod(F.xxhash64("group_id"), F.lit(n_buckets)))
        .groupBy("_b").applyInArrow(_local(prefix), NODE_SCHEMA)
    )
    if large is not None:
        out = out.unionByName(nested_sets_distributed(with_prefix_parents(large) if prefix else large, scratch, numbers=not prefix))
    return out


def with_prefix_parents(nodes: DataFrame) -> DataFrame:
    """``parent_key`` = longest shorter prefix present in the group, by a join on exploded prefixes."""
    present = nodes.select("group_id", F.col("node_key").alias("prefix"))
    asked = nodes.select("group_id", "node_key", F.explode_outer(F.transform(F.sequence(F.lit(1), F.length("node_key") - 1), lambda i: F.col("node_key").substr(F.lit(1), i))).alias("prefix")).filter(F.length("node_key") > 1)
    found = dealt_join(asked, present, ["group_id", "prefix"]).groupBy("group_id", "node_key").agg(F.max_by("prefix", F.length("prefix")).alias("parent_key"))
    return nodes.select("group_id", "node_key").join(found, ["group_id", "node_key"], "left")


def nested_sets_distributed(nodes: DataFrame, scratch: Scratch, numbers: bool, hot_rows: int = HOT_ROWS, block_rows: int = 500_000) -> DataFrame:
    """Nested sets of groups of any size, without gathering a group in one task.

    Each node opens and closes once on the tour around its tree.  Pointer doubling along that tour
    gives every node's place in about log2(2n) rounds whatever the depth, where handing sizes up
    level by level needs as many rounds as the deepest chain has links.  Sizes and preorder places
    are differences of tour places; nodes whose pointers never reach an end lie on or below a loop.
    Joins deal out parents and roots with very many nodes over several keys, and siblings and roots are
    ordered in ranges of ``block_rows``, so neither is one task's work.
    """
    nodes = nodes.select("group_id", F.col("node_key").cast("string").alias("node_key"), F.col("parent_key").cast("string").alias("parent_key"))
    present = nodes.select("group_id", F.col("node_key").alias("parent_key"), F.lit(True).alias("there"))
    t = dealt_join(nodes, present, ["group_id", "parent_key"], "left", hot_rows).select("group_id", "node_key", F.when(F.col("there"), F.col("parent_key")).alias("parent_key"))
    place = F.col("node_key").cast("bigint") if numbers else F.col("node_key")
    t = scratch.save(t)
    # depth and root by doubling towards the root; what has not ended after log2(n) rounds is a loop
    n = t.count()
    rounds = max(1, int(np.ceil(np.log2(n + 1))) + 1)
    cur = scratch.save(t.select("group_id", "node_key", F.coalesce("parent_key", "node_key").alias("up"), F.when(F.col("parent_key").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.col("parent_key").isNull().alias("ended")))
    for _ in range(rounds):
        nxt = cur.select("group_id", F.col("node_key").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("ended").alias("ended2"))
        new = dealt_join(cur, nxt, ["group_id", "up"], "inner", hot_rows, n).select(
            "group_id", "node_key", F.when(F.col("ended"), F.col("up")).otherwise(F.col("up2")).alias("up"),
            F.when(F.col("ended"), F.col("steps")).otherwise(F.col("steps") + F.col("steps2")).alias("steps"), (F.col("ended") | F.col("ended2")).alias("ended"),
        )
        new = scratch.save(new)
        scratch.drop(cur)
        cur = new
        if not cur.filter("not ended").limit(1).count():
            break
    tree = scratch.save(t.join(cur, ["group_id", "node_key"]).select("group_id", "node_key", "parent_key", "up", "steps", "ended"))
    live = tree.filter("ended")
    # tour: open(node) -> open(first child) or close(node); close(node) -> open(next sibling) or close(parent)
    blocks = n // block_rows + 1
    kids = range_blocks(live.filter("parent_key is not null").select("group_id", "parent_key", place.alias("place"), "node_key"), scratch, ["group_id", "parent_key", "place"], blocks)
    heads = kids.groupBy("_b").agg(F.min(F.struct("group_id", "parent_key", "place", "node_key")).alias("f")).select("_b", F.lead("f").over(Window.orderBy("_b")).alias("_carry"))  # a row a block
    after = F.lead(F.struct("group_id", "parent_key", "place", "node_key")).over(Window.partitionBy("_b").orderBy("group_id", "parent_key", "place"))
    sib = kids.withColumn("_next", after).join(F.broadcast(heads), "_b", "left").withColumn("_next", F.coalesce("_next", "_carry"))
    same = (F.col("_next.group_id") == F.col("group_id")) & (F.col("_next.parent_key") == F.col("parent_key"))
    sib = scratch.save(sib.select("group_id", "parent_key", "place", "node_key", F.when(same, F.col("_next.node_key")).alias("next")))
    firsts = sib.groupBy("group_id", "parent_key").agg(F.min_by("node_key", "place").alias("first")).withColumnRenamed("parent_key", "node_key")
    opens = live.select("group_id", "node_key").join(firsts, ["group_id", "node_key"], "left").select("group_id", F.concat(F.lit("o"), "node_key").alias("e"), F.when(F.col("first").isNotNull(), F.concat(F.lit("o"), "first")).otherwise(F.concat(F.lit("c"), "node_key")).alias("nxt"))
    closes = live.select("group_id", "node_key").join(sib.select("group_id", "node_key", "parent_key", "next"), ["group_id", "node_key"], "left").select("group_id", F.concat(F.lit("c"), "node_key").alias("e"), F.when(F.col("next").isNotNull(), F.concat(F.lit("o"), "next")).otherwise(F.concat(F.lit("c"), "parent_key")).alias("nxt"))
    tour = scratch.save(opens.unionByName(closes).withColumn("d", F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("bigint")))
    for _ in range(rounds + 2):
        if not tour.filter("nxt is not null").limit(1).count():
            break
        right = tour.select("group_id", F.col("e").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("d").alias("d2"))
        new = scratch.save(tour.join(right, ["group_id", "nxt"], "left").select("group_id", "e", F.col("nxt2").alias("nxt"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
        scratch.drop(tour)
        tour = new
    spans = tour.groupBy("group_id", F.substring("e", 2, 1 << 30).alias("node_key")).agg(F.max(F.when(F.col("e").startswith("o"), F.col("d"))).alias("od"), F.max(F.when(F.col("e").startswith("c"), F.col("d"))).alias("cd"))
    sized = tree.join(spans, ["group_id", "node_key"], "left").withColumn("subtree_size", ((F.col("od") - F.col("cd") + 1) / 2).cast("bigint"))
    # preorder inside a tree: opens so far = (steps done + depth) / 2; trees follow each other by root key
    roots = sized.filter("ended and parent_key is null").select("group_id", F.col("node_key").alias("up"), F.col("od").alias("root_od"), F.col("subtree_size").alias("n"))
    roots = range_blocks(roots.withColumn("place", F.col("up").cast("bigint") if numbers else F.col("up")), scratch, ["group_id", "place"], blocks)
    before = Window.partitionBy("group_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = roots.groupBy("group_id", "_b").agg(F.sum("n").alias("_n")).select("group_id", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy("_b", "group_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    base = roots.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(carried, ["group_id", "_b"]).select("group_id", "up", "root_od", (F.col("_in") + F.col("_carry")).alias("base"))
    out = dealt_join(sized, base, ["group_id", "up"], "left", hot_rows, n)
    lft = F.when(F.col("ended"), F.col("base") + ((F.col("root_od") - F.col("od") + F.col("steps")) / 2).cast("bigint")).otherwise(-1)
    out = out.withColumn("lft", lft.cast("bigint"))
    return out.select(
        "group_id", "node_key", "parent_key", F.when(F.col("ended"), F.col("up")).otherwise("cycle").alias("root_key"),
        F.when(F.col("ended"), F.col("steps")).otherwise(-1).cast("bigint").alias("node_depth"),
        F.when(F.col("ended"), F.col("subtree_size")).otherwise(0).cast("bigint").alias("subtree_size"),
        "lft", F.when(F.col("ended"), F.col("lft") + F.col("subtree_size") - 1).otherwise(-1).cast("bigint").alias("rgt"),
    )


def descendants(sets: DataFrame, ancestors: DataFrame) -> DataFrame:
    """All (ancestor, descendant) pairs below the given nodes, read from the ranges.

    Equality on the group and the tree's root bounds the range comparison to one tree.
    """
    a = ancestors.select("group_id", "root_key", F.col("node_key").alias("ancestor_key"), F.col("lft").alias("a_lft"), F.col("rgt").alias("a_rgt"), F.col("node_depth").alias("a_depth"))
    return sets.filter("lft >= 0").join(a, ["group_id", "root_key"]).filter("lft > a_lft and lft <= a_rgt").select("group_id", "ancestor_key", F.col("node_key").alias("descendant_key"), (F.col("node_depth") - F.col("a_depth")).alias("distance"))


def paths(sets: DataFrame, keys: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """``keys, node_key, node_path``: the node keys from the root down to each node; null on or below a loop.

    Each round puts the path of the node that a path hangs on before it, so the paths double and
    log2(depth) rounds do; finished paths stay out of the joins.
    """
    scratch = Scratch(sets.sparkSession, "paths")
    t = scratch.save(sets.select(*keys, "node_key", "parent_key", "node_depth"))
    live = t.filter("node_depth >= 0")
    deepest = live.agg(F.max("node_depth").alias("d")).first()["d"] or 0
    cur = scratch.save(live.select(*keys, "node_key", F.col("parent_key").alias("up"), F.array("node_key").alias("node_path")))
    for _ in range(int(deepest).bit_length()):
        above = cur.select(*keys, F.col("node_key").alias("up"), F.col("up").alias("up2"), F.col("node_path").alias("path2"))
        longer = dealt_join(cur.filter("up is not null"), above, [*keys, "up"]).select(*keys, "node_key", F.col("up2").alias("up"), F.concat("path2", "node_path").alias("node_path"))
        new = scratch.save(cur.filter("up is null").unionByName(longer))
        scratch.drop(cur)
        cur = new
    loops = t.filter("node_depth < 0").select(*keys, "node_key", F.lit(None).cast("array<string>").alias("node_path"))
    return cur.select(*keys, "node_key", "node_path").unionByName(loops)


def all_descendants(paths: DataFrame, keys: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """All (ancestor, descendant) pairs of all nodes, by exploding each node's path; no join."""
    x = paths.filter("node_path is not null").select(*keys, F.col("node_key").alias("descendant_key"), F.size("node_path").alias("_n"), F.posexplode(F.slice("node_path", 1, F.size("node_path") - 1)).alias("_at", "ancestor_key"))
    return x.select(*keys, "ancestor_key", "descendant_key", (F.col("_n") - 1 - F.col("_at")).cast("bigint").alias("distance"))


def layer_nodes(layers: DataFrame) -> DataFrame:
    """Distinct layers of every export; rows without export or index are no nodes.

    Rows sent again are equal; should they disagree, the smallest parent index counts.
    """
    return (
        layers.filter("export_id is not null and matrix_index is not null")
        .groupBy(F.col("export_id").cast("bigint").alias("group_id"), F.col("matrix_index").cast("bigint").alias("node_key"))
        .agg(F.min(F.col("parent_matrix_index").cast("bigint")).alias("parent_key"))
    )


def tile_nodes(tiles: DataFrame) -> DataFrame:
    """Distinct valid quadkeys ``0[0-3]*`` of every pyramid."""
    return tiles.filter(F.col("pyramid_id").isNotNull() & F.col("quad_key").rlike("^0[0-3]*$")).select(F.col("pyramid_id").cast("bigint").alias("group_id"), F.col("quad_key").alias("node_key")).distinct()
