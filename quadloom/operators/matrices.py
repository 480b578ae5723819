"""Operators on tile matrices: ``matrix_id, tile_id, i, j`` cells, merging, cutting, hierarchy."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.operators.graph import placed_components
from quadloom.runtime import Scratch, ship_package

HOLDERS_A_TASK = 2_000
MAX_MATRIX_CELLS = 4_000_000
LABELLED_AT_ONCE = 1_000_000


def cell_links(cells: DataFrame) -> DataFrame:
    """Links between orthogonal neighbours of one matrix, by equality on the shifted cell."""
    node = F.struct("matrix_id", "i", "j")
    a = cells.select("matrix_id", "i", "j").distinct()
    b = a.select("matrix_id", "i", "j", node.alias("v"))
    moves = F.explode(F.array(F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj")), F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj"))))
    step = a.select("matrix_id", "i", "j", moves.alias("m")).select("matrix_id", node.alias("u"), (F.col("i") + F.col("m.di")).alias("i"), (F.col("j") + F.col("m.dj")).alias("j"), "m.di", "m.dj")
    return step.join(b, ["matrix_id", "i", "j"]).select("u", "v", "di", "dj")


_LABELS = pa.schema([("matrix_id", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("root_i", pa.int32()), ("root_j", pa.int32())])


def label_cells(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Position of the first cell of each cell's piece; cells distinct and sorted by matrix, row, column."""
    n = len(m)
    if not n:
        return np.zeros(0, np.int64)
    i, j = i.astype(np.int64), j.astype(np.int64)
    right = np.flatnonzero((m[1:] == m[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1] + 1))
    # the cell below: matrices by number, places as one key where that fits a machine word
    no = np.cumsum(np.concatenate([[0], m[1:] != m[:-1]]))
    h, w = int(i.max() - i.min()) + 2, int(j.max() - j.min()) + 1
    if (int(no[-1]) + 1) * h * w < 1 << 62:
        key = (no * h + (i - i.min())) * w + (j - j.min())
        want = key + w
    else:
        key, want = np.rec.fromarrays([no, i, j]), np.rec.fromarrays([no, i + 1, j])
    at = np.minimum(np.searchsorted(key, want), n - 1)
    down = np.flatnonzero(key[at] == want)
    a, b = np.concatenate([right, down]), np.concatenate([right + 1, at[down]])
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels whole matrices; rows come sorted, and a matrix may go on in the next batch."""

    def run(t: pa.Table) -> pa.RecordBatch:
        m, i, j = (t.column(c).to_numpy() for c in ("matrix_id", "i", "j"))
        at = label_cells(m, i, j)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((m, i, j, i[at], j[at]), _LABELS)], schema=_LABELS)

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= LABELLED_AT_ONCE:
            t = pa.Table.from_batches(held)
            m = t.column("matrix_id").to_numpy()
            cut = int(np.searchsorted(m, m[-1]))  # the last matrix may go on
            if cut:
                yield run(t.slice(0, cut))
                t = t.slice(cut)
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield run(pa.Table.from_batches(held))


def cell_components(cells: DataFrame, max_matrix_cells: int = MAX_MATRIX_CELLS) -> DataFrame:
    """``matrix_id, i, j, root_i, root_j``: each cell with the smallest cell it is connected to.

    No link leaves its matrix, so whole matrices are labelled inside tasks, many in each; a matrix of
    more than ``max_matrix_cells`` cells is labelled by Spark rounds.  Cells with a null place or matrix
    are pieces of their own.
    """
    ship_package(cells.sparkSession)
    c = cells.select(F.col("matrix_id").cast("bigint").alias("matrix_id"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).distinct()
    whole = c.filter("matrix_id is not null and i is not null and j is not null")
    sizes = cells.groupBy(F.col("matrix_id").cast("bigint").alias("matrix_id")).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter((F.col("n") > max_matrix_cells) & F.col("matrix_id").isNotNull()).select("matrix_id")
    n_large = large.count()  # fewer than cells / bound
    small = whole.join(F.broadcast(large), "matrix_id", "left_anti") if n_large else whole
    out = small.repartition("matrix_id").sortWithinPartitions("matrix_id", "i", "j").mapInArrow(_label_batches, "matrix_id bigint, i int, j int, root_i int, root_j int")
    if n_large:
        big = whole.join(F.broadcast(large), "matrix_id")
        placed = placed_components(cell_links(big)).select(F.col("v.matrix_id").alias("matrix_id"), F.col("v.i").alias("i"), F.col("v.j").alias("j"), F.col("root.i").alias("root_i"), F.col("root.j").alias("root_j"))
        out = out.unionByName(big.join(placed, ["matrix_id", "i", "j"], "left").select("matrix_id", "i", "j", F.coalesce("root_i", "i").alias("root_i"), F.coalesce("root_j", "j").alias("root_j")))
    return out.unionByName(c.filter("matrix_id is null or i is null or j is null").select("*", F.col("i").alias("root_i"), F.col("j").alias("root_j")))


def validity(raw: DataFrame, components: DataFrame) -> DataFrame:
    """Per matrix: enough tiles, ids and cells unique, one connected piece."""
    n = raw.groupBy("matrix_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("tile_id").alias("nt"), F.countDistinct("i", "j").alias("nc"),
        F.min("i").alias("mi"), F.min("j").alias("mj"), F.count_if(F.col("tile_id").isNull()).alias("nn"),
    )
    c = components.groupBy("matrix_id").agg(F.countDistinct("root_i", "root_j").alias("pieces"))
    ok = (F.col("n") >= 2) & (F.col("nt") == F.col("n")) & (F.col("nc") == F.col("n")) & (F.col("mi") >= 0) & (F.col("mj") >= 0) & (F.col("nn") == 0) & (F.col("pieces") == 1)
    return n.join(c, "matrix_id").select("matrix_id", (F.col("nt") == F.col("n")).alias("unique_ids"), (F.col("nc") == F.col("n")).alias("unique_cells"), (F.col("pieces") == 1).alias("connected"), ok.alias("valid"))


def shared_tiles(cells: DataFrame, holders_a_task: int = HOLDERS_A_TASK) -> DataFrame:
    """Every pair of matrices ``a < b`` that share a tile, with ``tile_id, di, dj``, for each shared tile.

    A tile with more than ``holders_a_task`` holders is dealt out over several join keys: each cell is
    once on the side of a, under its own key, and on the side of b under every key of its tile.  Where
    cells are marked ``_big``, only pairs of which one matrix at least is.
    """
    n = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("tile_id")) / holders_a_task).cast("int")
    big = ["_big"] if "_big" in cells.columns else []
    c = cells.filter("tile_id is not null").select("matrix_id", "tile_id", "i", "j", *big, n.alias("_n"))
    a = c.select(F.col("matrix_id").alias("a"), "tile_id", F.col("i").alias("ai"), F.col("j").alias("aj"), *[F.col(x).alias("_a") for x in big], F.pmod(F.xxhash64("matrix_id"), F.col("_n")).cast("int").alias("_k"))
    b = c.select(F.col("matrix_id").alias("b"), "tile_id", F.col("i").alias("bi"), F.col("j").alias("bj"), *[F.col(x).alias("_b") for x in big], F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    return a.join(b, ["tile_id", "_k"]).filter("a < b and (_a or _b)" if big else "a < b").select("a", "b", "tile_id", (F.col("ai") - F.col("bi")).alias("di"), (F.col("aj") - F.col("bj")).alias("dj"))


def unanimous(shared: DataFrame) -> DataFrame:
    """Pairs whose shared tiles all agree on one offset."""
    g = shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"), F.min("di").alias("di"), F.max("di").alias("di2"), F.min("dj").alias("dj"), F.max("dj").alias("dj2"))
    return g.filter("di = di2 and dj = dj2").select("a", "b", "n_shared", "di", "dj")


def _place(i: Column, j: Column) -> Column:
    """A cell's place as one number, so that a move is an addition; coordinates are below 2^30."""
    return i.cast("bigint") * (1 << 32) + j


def beside(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs with both whole matrices (``a_places``, ``b_tiles``, ...; those of b not moved yet) and ``n_conflicts``.

    A conflict is a cell of b that meets another tile when moved onto a.  A matrix holds a tile and a
    place once, so places met less the shared tiles, which all meet themselves, are the conflicts.
    """
    one = cells.groupBy("matrix_id").agg(
        F.sort_array(F.collect_list(F.struct(_place(F.col("i"), F.col("j")).alias("p"), "tile_id"))).alias("c"),
        F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"),
    )
    side = lambda k: one.select(F.col("matrix_id").alias(k), F.col("c.p").alias(f"{k}_places"), F.col("c.tile_id").alias(f"{k}_tiles"), *[F.col(x).alias(f"{k}_{x}") for x in ("i0", "i1", "j0", "j1")])
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    move = _place(F.col("di"), F.col("dj"))
    return x.withColumn("n_conflicts", F.size(F.array_intersect("a_places", F.transform("b_places", lambda p: p + move))) - F.col("n_shared"))


def conflicts(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of b, moved onto a, that meet another tile there: ``a, b, n_conflicts`` (0 where none)."""
    return beside(pairs, cells).select("a", "b", "n_conflicts")


def merged_sizes(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells, rows and columns of each pair without conflicts, merged."""
    span = lambda k, d: F.greatest(f"a_{k}1", F.col(f"b_{k}1") + F.col(d)) - F.least(f"a_{k}0", F.col(f"b_{k}0") + F.col(d)) + 1
    return beside(pairs, cells).filter("n_conflicts = 0").select("a", "b", (F.size("a_tiles") + F.size("b_tiles") - F.col("n_shared")).alias("n_cells"), span("i", "di").alias("n_rows"), span("j", "dj").alias("n_cols"))


def merge_pairs(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of each pair without conflicts on a's grid, moved to begin at 0."""
    x = beside(pairs, cells).filter("n_conflicts = 0")
    move = _place(F.col("di"), F.col("dj"))
    pick = lambda k, m: F.transform(F.arrays_zip(F.col(f"{k}_places").alias("p"), F.col(f"{k}_tiles").alias("tile_id")), lambda c: F.struct((c["p"] + m).alias("p"), c["tile_id"].alias("tile_id")))
    both = F.concat(pick("a", F.lit(0).cast("bigint")), F.filter(pick("b", move), lambda c: ~F.array_contains("a_places", c["p"])))
    low = lambda k, d: F.least(f"a_{k}0", F.col(f"b_{k}0") + F.col(d)).alias(f"_{k}")
    u = x.select("a", "b", low("i", "di"), low("j", "dj"), F.explode(both).alias("c")).withColumn("i", F.shiftright(F.col("c.p") + (1 << 31), 32))
    return u.select("a", "b", "c.tile_id", (F.col("i") - F.col("_i")).cast("int").alias("i"), (F.col("c.p") - F.shiftleft("i", 32) - F.col("_j")).cast("int").alias("j"))


def normalize(cells: DataFrame, keys: list[str]) -> DataFrame:
    low = cells.groupBy(*keys).agg(F.min("i").alias("_i"), F.min("j").alias("_j"))
    return cells.join(low, keys).withColumn("i", F.col("i") - F.col("_i")).withColumn("j", F.col("j") - F.col("_j")).drop("_i", "_j")


def marked_columns(cells: DataFrame, cutters: DataFrame) -> DataFrame:
    """Columns that hold a cutter tile: a marked tile marks its whole column."""
    return cells.join(cutters.select("tile_id").distinct(), "tile_id", "left_semi").select("matrix_id", "j").distinct()


def west_split(cells: DataFrame, cutters: DataFrame) -> DataFrame:
    """Matrices cut at the column of their first marked tile: ``part`` main (right) or transient (left).

    Matrices with marks in several columns, or marked in column 0, stay whole (part ``whole``).
    """
    marks = cells.join(cutters.select("tile_id").distinct(), "tile_id", "left_semi")
    cut = marks.groupBy("matrix_id").agg(F.min_by("j", F.struct("i", "j")).alias("c"), F.countDistinct("j").alias("n_cols"))
    cut = cut.filter("n_cols = 1 and c > 0").select("matrix_id", "c")
    x = cells.join(cut, "matrix_id", "left")
    part = F.when(F.col("c").isNull(), "whole").when(F.col("j") >= F.col("c"), "main").otherwise("transient")
    return x.select("matrix_id", "tile_id", "i", F.when(F.col("c").isNotNull() & (F.col("j") >= F.col("c")), F.col("j") - F.col("c")).otherwise(F.col("j")).alias("j"), part.alias("part"), F.coalesce("c", F.lit(0)).alias("cut"))


def majority_sizes(cells: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Matrices with at least ``least`` tiles, and the report of those dropped."""
    size = cells.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n"))
    return size.filter(F.col("n") >= least), size.filter(F.col("n") < least)


def hierarchy_status(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Per matrix of the tile: distinct located parent matrices; TOPLEVEL, NORMAL or BROKEN."""
    o = owner.select("tile_id", "matrix_id")
    e = edges.join(o, "tile_id").join(o.select(F.col("tile_id").alias("uncle_id"), F.col("matrix_id").alias("parent")), "uncle_id", "left")
    g = e.groupBy("matrix_id").agg(
        F.count(F.lit(1)).alias("n_uncles"), F.countDistinct(F.when(F.col("parent") != F.col("matrix_id"), F.col("parent"))).alias("n_parents"), F.count_if(F.col("parent").isNull()).alias("n_unresolved"), F.countDistinct("tile_id").alias("n_tiles"),
    )
    return g.withColumn("status", F.when(F.col("n_parents") == 0, "TOPLEVEL").when(F.col("n_parents") > 1, "BROKEN").otherwise("NORMAL"))


def place_levels(edges: DataFrame, roots: DataFrame, digit: Column) -> DataFrame:
    """Places every tile below its uncle: path = uncle's path + quadrant digit, one level a pass.

    Passes go on until a level is empty.  A tile that comes again below itself is a loop and raises.
    """
    s = Scratch(edges.sparkSession, "placement")
    front = s.save(roots.select("tile_id", "path", F.array().cast("array<bigint>").alias("_above")))
    out = [front]
    e = edges.withColumn("_d", digit)
    while True:
        above = front.select(F.col("tile_id").alias("uncle_id"), "path", F.concat("_above", F.array(F.col("tile_id").cast("bigint"))).alias("_above"))
        nxt = s.save(e.join(above, "uncle_id").select("tile_id", F.concat("path", "_d").alias("path"), "_above"))
        seen = nxt.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.array_contains("_above", F.col("tile_id").cast("bigint")), F.col("tile_id"))).alias("again")).first()
        if seen["again"] is not None:
            raise ValueError(f"tile {seen['again']} lies below itself")
        if not seen["n"]:
            break
        out.append(nxt)
        front = nxt
    u = out[0]
    for x in out[1:]:
        u = u.unionByName(x)
    return u.select("tile_id", "path")


Cells = dict[int, tuple[int, int]]


def merged(a: Cells, b: Cells) -> Cells | None:
    """Both matrices on a's grid, or None unless all shared tiles agree on one offset and no place is taken twice."""
    offs = {(a[t][0] - b[t][0], a[t][1] - b[t][1]) for t in a.keys() & b.keys()}
    if len(offs) != 1:
        return None
    di, dj = next(iter(offs))
    taken = {p: t for t, p in a.items()}
    moved = {t: (i + di, j + dj) for t, (i, j) in b.items()}
    return {**a, **moved} if all(taken.get(p, t) == t for t, p in moved.items()) else None


def at_origin(cells: Cells) -> Cells:
    mi, mj = min(i for i, _ in cells.values()), min(j for _, j in cells.values())
    return {t: (i - mi, j - mj) for t, (i, j) in cells.items()}


def _rows(groups: list[tuple[int, Cells]]) -> list[tuple[int, int, int, int]]:
    return [(m, t, i, j) for m, at in groups for t, (i, j) in at_origin(at).items()]


def retry_sweep(groups: list[tuple[int, Cells]], tries: int) -> tuple[list[tuple[int, Cells]], int]:
    """Every matrix in turn against the one behind it: merged, or sent to the end, up to ``tries`` times.

    ``tries`` is the number of matrices after the last change of it, and is handed on.
    """
    groups = list(groups)
    at = 0
    while at < len(groups):
        n = 0
        while n < tries and at + 1 < len(groups):
            n += 1
            nxt = groups.pop(at + 1)
            both = merged(groups[at][1], nxt[1])
            if both is None:
                groups.append(nxt)
            else:
                groups[at] = (groups[at][0], both)
                tries = len(groups)
        at += 1
    return groups, tries


def cut_sweep(groups: list[tuple[int, Cells]], cutters: set[int]) -> list[tuple[int, Cells]]:
    """Matrices with cutters in one column, not the first, cut there: the right part stays, the left one goes to the end."""
    out, left = [], []
    for m, at in groups:
        at = at_origin(at)
        cols = {at[t][1] for t in at.keys() & cutters}
        c = min(cols) if len(cols) == 1 else 0
        out.append((m, {t: p for t, p in at.items() if p[1] >= c}))
        if c > 0:
            left.append((m, {t: p for t, p in at.items() if p[1] < c}))
    return [*out, *left]


def merge_sweep(frames: list[tuple[int, list[tuple[int, int, int]]]]) -> list[tuple[int, int, int, int]]:
    """Sweeps over matrices in order until one merges nothing: ``matrix_id`` (of the merged group), ``tile_id, i, j``."""
    return [r[1:] for r in grouping_fixpoint(frames, set())]


def grouping_fixpoint(frames: list[tuple[int, list[tuple[int, int, int]]]], cutters: set[int]) -> list[tuple[int, int, int, int, int]]:
    """Sweeps of merging and cutting until their number of matrices stays: ``group_no, matrix_id, tile_id, i, j``.

    A matrix that was merged and cut again would go on for ever: a state seen before ends the sweeps.
    Raises where the tiles at the end are not those at the beginning.
    """
    groups = [(m, {t: (i, j) for t, i, j in c}) for m, c in frames]
    before, tries, seen = {t for _, at in groups for t in at}, len(groups), set()
    while True:
        n = len(groups)
        merged_, tries = retry_sweep(groups, tries)
        groups = cut_sweep(merged_, cutters)
        if len(groups) != len(merged_):
            tries = len(groups)
        state = tuple((m, tuple(sorted(at))) for m, at in groups)
        if len(groups) == n == len(merged_) or state in seen:
            break
        seen.add(state)
    if {t for _, at in groups for t in at} != before:
        raise RuntimeError("tiles were lost or added")
    return [(g, *r) for g, x in enumerate(groups) for r in _rows([x])]


def full_merge(frames: list[tuple[int, list[tuple[int, int, int]]]]) -> list[tuple[int, int, int, int]]:
    """Pairs in order until none fits: after each merge the search begins again at the first pair."""
    groups = [(m, {t: (i, j) for t, i, j in c}) for m, c in frames]
    again = True
    while again:
        again = False
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                both = merged(groups[a][1], groups[b][1])
                if both is not None:
                    groups[a] = (groups[a][0], both)
                    del groups[b]
                    again = True
                    break
            if again:
                break
    return _rows(groups)


def _row_bit(digit: Column) -> Column:
    return F.when(digit.isin(2, 3), 1).otherwise(0)


def _col_bit(digit: Column) -> Column:
    return F.when(digit.isin(1, 2), 1).otherwise(0)


def path_of(level: Column, row: Column, col: Column) -> Column:
    """Root marker and a digit a level of a place; rows count from the south, columns from the west."""
    bit = lambda x, k: F.floor(x / F.pow(F.lit(2), k)).cast("bigint") % 2
    digit = lambda k: F.when(bit(row, k) == 0, F.when(bit(col, k) == 0, "0").otherwise("1")).otherwise(F.when(bit(col, k) == 0, "3").otherwise("2"))
    return F.concat(F.lit("0"), F.when(level > 0, F.array_join(F.transform(F.sequence(level - 1, F.lit(0), F.lit(-1)), digit), "")).otherwise(""))


def place_of(path: Column) -> Column:
    """``level, row, col`` of a path of digits after the root marker."""
    step = lambda acc, d: F.struct((acc["row"] * 2 + _row_bit(d.cast("int"))).alias("row"), (acc["col"] * 2 + _col_bit(d.cast("int"))).alias("col"))
    zero = F.lit(0).cast("bigint")
    digits = F.filter(F.split(F.substr(path, F.lit(2)), ""), lambda x: x != "")
    rc = F.aggregate(digits, F.struct(zero.alias("row"), zero.alias("col")), step)
    return F.struct((F.length(path) - 1).alias("level"), rc["row"].alias("row"), rc["col"].alias("col"))


def anchors(votes: DataFrame, spans: DataFrame) -> DataFrame:
    """``matrix_id, level, row0, col0`` of matrices whose strongest evidence has a strict majority.

    ``votes``: ``matrix_id, tier, level, row, col`` with the place a vote gives the matrix's first cell,
    columns taken modulo the level's width.  Only the lowest tier of a matrix counts.  Where no whole
    place has more than half of the votes, level, row and column may each have a majority of their own.
    A matrix as wide or high as the world begins at column or row 0.
    """
    best = votes.groupBy("matrix_id").agg(F.min("tier").alias("tier"))
    v = votes.join(best, ["matrix_id", "tier"]).groupBy("matrix_id", "level", "row", "col").agg(F.count(F.lit(1)).alias("n"))
    total = v.groupBy("matrix_id").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by(F.struct("level", "row", "col"), "n").alias("whole"))
    for c in ("level", "row", "col"):
        one = v.groupBy("matrix_id", c).agg(F.sum("n").alias("n")).groupBy("matrix_id").agg(F.max("n").alias(f"n_{c}"), F.max_by(c, "n").alias(f"own_{c}"))
        total = total.join(one, "matrix_id")
    joint = 2 * F.col("most") > F.col("all")
    each = (2 * F.col("n_level") > F.col("all")) & (2 * F.col("n_row") > F.col("all")) & (2 * F.col("n_col") > F.col("all"))
    pick = lambda c: F.when(joint, F.col(f"whole.{c}")).otherwise(F.col(f"own_{c}"))
    a = total.filter(joint | each).select("matrix_id", pick("level").alias("level"), pick("row").alias("row"), pick("col").alias("col")).join(spans, "matrix_id")
    world = F.pow(F.lit(2), F.col("level")).cast("bigint")
    row0, col0 = F.when(F.col("n_rows") == world, 0).otherwise(F.col("row")), F.when(F.col("n_cols") == world, 0).otherwise(F.col("col"))
    return a.select("matrix_id", "level", row0.cast("bigint").alias("row0"), col0.cast("bigint").alias("col0"), "n_rows", "n_cols").filter((F.col("row0") >= 0) & (F.col("row0") + F.col("n_rows") <= F.pow(F.lit(2), F.col("level"))) & (F.col("n_cols") <= F.pow(F.lit(2), F.col("level")))).drop("n_rows", "n_cols")


def place_matrices(cells: DataFrame, uncles: DataFrame, seeds: DataFrame) -> DataFrame:
    """``matrix_id, tile_id, level, row, col, path`` of all tiles of the matrices that can be placed.

    ``cells``: ``matrix_id, tile_id, i, j`` with rows and columns from 0; ``uncles``: ``tile_id, uncle_id,
    digit``, the tile lies in that quadrant of the uncle; ``seeds``: ``tile_id, path``.  Evidence in order:
    seeds, then places of tiles in matrices that were placed, then uncles.  Each pass places the
    matrices with a majority on the lowest level there is one, so what they tell about deeper ones counts
    before those are placed; the number of passes is bounded by levels, not by matrices.  Matrices
    without a majority, or that would leave the world's rows, are left out, never guessed.
    """
    ship_package(cells.sparkSession)
    s = Scratch(cells.sparkSession, "place")
    spans = s.save(cells.groupBy("matrix_id").agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols")))
    seed = seeds.select("tile_id", place_of(F.col("path")).alias("p")).select("tile_id", F.lit(0).alias("tier"), "p.*")
    known, out, waiting = s.save(seed), [], s.save(cells.select("matrix_id", "tile_id", "i", "j"))
    while True:
        world = F.pow(F.lit(2), F.col("level")).cast("bigint")
        votes = waiting.join(known, "tile_id").select("matrix_id", "tier", "level", (F.col("row") - F.col("i")).alias("row"), F.pmod(F.col("col") - F.col("j"), world).alias("col"))
        new = s.save(anchors(votes, spans))
        level = new.agg(F.min("level")).first()[0]
        if level is None:
            break
        now = new.filter(F.col("level") == level)
        placed = s.save(waiting.join(now, "matrix_id").select("matrix_id", "tile_id", "level", (F.col("row0") + F.col("i")).alias("row"), F.pmod(F.col("col0") + F.col("j"), world).alias("col")))
        out.append(placed)
        rest = s.save(waiting.join(now.select("matrix_id"), "matrix_id", "left_anti"))
        place = placed.select("tile_id", F.lit(1).alias("tier"), "level", "row", "col").distinct()
        below = uncles.join(placed.select(F.col("tile_id").alias("uncle_id"), "level", "row", "col").distinct(), "uncle_id").select(
            "tile_id", F.lit(2).alias("tier"), (F.col("level") + 1).alias("level"), (F.col("row") * 2 + _row_bit(F.col("digit"))).alias("row"), (F.col("col") * 2 + _col_bit(F.col("digit"))).alias("col")
        )
        more = s.save(known.unionByName(place).unionByName(below))
        s.drop(known, waiting, new)
        known, waiting = more, rest
    if not out:
        return waiting.limit(0).select("matrix_id", "tile_id", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("col"), F.lit("").alias("path"))
    u = out[0]
    for x in out[1:]:
        u = u.unionByName(x)
    return u.select("*", path_of(F.col("level"), F.col("row"), F.col("col")).alias("path"))


def priority_order(parents: dict[int, set[int]], rank: dict[int, tuple]) -> list[tuple[int, int, int]]:
    """``matrix, position, level`` with parents first and ties by rank.

    Any matrix with several parents, or on a loop, leaves the order as given and all levels at -1.
    """
    ids = list(parents)
    plain = [(m, k, -1) for k, m in enumerate(ids)]
    if any(len(p) > 1 for p in parents.values()):
        return plain
    kids: dict[int, list[int]] = {}
    for m, p in parents.items():
        for x in p:
            kids.setdefault(x, []).append(m)
    heap = [(rank[m], m, 0) for m in ids if not parents[m]]
    heapq.heapify(heap)
    out = []
    while heap:
        _, m, level = heapq.heappop(heap)
        out.append((m, len(out), level))
        for k in kids.get(m, ()):
            heapq.heappush(heap, (rank[k], k, level + 1))
    return out if len(out) == len(ids) else plain


def anchor(parent: Column, quadrant: Column, own: Column) -> Column:
    """Offset of a matrix that one tile gives along an axis: its parent's place, a level down, less its own cell."""
    return 2 * parent + quadrant - own


def full_world(layers: DataFrame) -> DataFrame:
    """Layers with offset 0 along each axis on which they span the world of their level.

    Layers without a level from 0 to 30 stay out.
    """
    world = F.pow(F.lit(2), F.col("hierarchy_level")).cast("bigint")
    zero = lambda n, off: F.when(F.col(n) == world, 0).otherwise(F.col(off))
    return layers.filter("hierarchy_level between 0 and 30").withColumns({"col_offset": zero("n_cols", "col_offset"), "row_offset": zero("n_rows", "row_offset")})


def export_manifest(tiles: DataFrame, path: str, tile: str, size: str) -> DataFrame:
    """One tile a path, native (with a size) before derived, then the smallest id; ``must_abort`` where sizes differ."""
    order = F.struct(F.col(size).isNull().cast("int").alias("derived"), tile)
    return tiles.groupBy(path).agg(F.min_by(tile, order).alias(tile), F.count(F.lit(1)).alias("n_rows"), (F.countDistinct(size) > 1).alias("must_abort"))


def native_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles of a native texture of 256 pixels with four points that were not skipped."""
    return tiles.filter(F.col("texture_file").rlike(r"/256x256_[0-9]+\.") & (F.col("number_of_points") == 4) & ~F.coalesce("skipped", F.lit(False)))
