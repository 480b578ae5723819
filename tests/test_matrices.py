"""Matrix operators over all pairs of matrices that share a tile."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.model import CELLS_SQL
from quadloom.operators import graph, matrices as mx, pairs
from quadloom.plans import registry
from tests.test_queries import canon, duck  # noqa: F401

# 1 and 3 hold tile 10 with 2 between them; 1 and 3 disagree on tile 11, which 2 lacks
CELLS = [(1, 10, 0, 0), (1, 11, 1, 0), (2, 10, 0, 1), (2, 12, 1, 1), (3, 10, 2, 2), (3, 11, 0, 0), (4, 10, 5, 5), (4, 12, 6, 5)]

PAIRS = f"""{CELLS_SQL}, shared as (select x.matrix_id as a, y.matrix_id as b, tile_id, x.i - y.i as di, x.j - y.j as dj from cells x join cells y using (tile_id) where x.matrix_id < y.matrix_id),
una as (select a, b, count(*) as n_shared, min(di) as di, min(dj) as dj from shared group by a, b having min(di) = max(di) and min(dj) = max(dj)),
cf as (select u.a, u.b, count(*) filter (c.tile_id is not null and c.tile_id <> m.tile_id) as n_conflicts from una u join cells m on m.matrix_id = u.b left join cells c on c.matrix_id = u.a and c.i = m.i + u.di and c.j = m.j + u.dj group by u.a, u.b),
good as (select u.* from una u join cf using (a, b) where n_conflicts = 0),
mu as (select g.a, g.b, c.tile_id, c.i, c.j from good g join cells c on c.matrix_id = g.a union select g.a, g.b, c.tile_id, c.i + g.di, c.j + g.dj from good g join cells c on c.matrix_id = g.b),
merged as (select a, b, tile_id, i - min(i) over (partition by a, b) as i, j - min(j) over (partition by a, b) as j from mu)"""
WHOLE = {
    "jn10_shared_tiles": "select * from shared",
    "agg13_unanimous": "select * from una",
    "jn11_conflicts": "select * from cf",
    "mtx4_pair_merge": "select a, b, count(*) as n_cells, max(i)::int + 1 as n_rows, max(j)::int + 1 as n_cols from merged group by a, b",
    "set2_union_cells": "select a, b, tile_id, i, j from merged",
    "mtx9_full_merge": "select count(*) as n_merges, count(distinct b) as n_gone from good",
    "evt8_retry_order": "select matrix_id, failed, rank() over (partition by failed order by matrix_id)::bigint as place from (select matrix_id, matrix_id not in (select b from good) as failed from (select distinct matrix_id from cells))",
}


@pytest.mark.parametrize("holders", [1, 3, 2000])
def test_all_pairs_share(spark, holders):
    df = spark.createDataFrame(CELLS, "matrix_id bigint, tile_id bigint, i int, j int")
    shared = mx.shared_tiles(df, holders)
    want = {(a[0], b[0], a[1], a[2] - b[2], a[3] - b[3]) for a, b in combinations(sorted(CELLS), 2) if a[1] == b[1] and a[0] != b[0]}
    rows = [tuple(r) for r in shared.collect()]
    assert len(rows) == len(want) and set(rows) == want
    una = {(r.a, r.b): (r.n_shared, r.di, r.dj) for r in mx.unanimous(shared).collect()}
    assert (1, 3) not in una and una[(2, 4)] == (2, -5, -4) and una[(1, 4)] == (1, -5, -5)


@pytest.mark.parametrize("name", WHOLE)
def test_queries_over_all_pairs(spark, duck, sf, name):  # noqa: F811
    got, exp = canon(registry.queries()[name](spark, sf).toPandas()), canon(duck.execute(f"with {PAIRS} {WHOLE[name]}").fetchdf())
    assert len(got) and got.equals(exp)


def test_placement_below_forty_levels(spark):
    edges = spark.createDataFrame([(k + 1, k, k % 4) for k in range(1, 44)], "tile_id bigint, uncle_id bigint, direction int")
    roots = spark.createDataFrame([(1, "01")], "tile_id bigint, path string")
    got = {r.tile_id: r.path for r in mx.place_levels(edges, roots, F.col("direction").cast("string")).collect()}
    assert len(got) == 44 and got[44] == "01" + "".join(str(k % 4) for k in range(1, 44))


def test_loops_and_guards_raise(spark):
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 1), (2, 3, 2)], "tile_id bigint, uncle_id bigint, direction int")
    roots = spark.createDataFrame([(1, "01")], "tile_id bigint, path string")
    with pytest.raises(ValueError, match="below itself"):
        mx.place_levels(edges, roots, F.col("direction").cast("string"))
    links = spark.createDataFrame([(k, k + 1, 1, 0) for k in range(20)], "u bigint, v bigint, di int, dj int")
    with pytest.raises(RuntimeError):
        graph.placed_components(links, max_rounds=1)
    assert {(r.v, r.root, r.di) for r in graph.placed_components(links).collect()} == {(k, 0, k) for k in range(21)}


def test_pieces_are_alike_on_both_sides_of_the_bound(spark):
    rng = np.random.default_rng(4)
    rows = [(int(m), int(i), int(j)) for m, i, j in zip(rng.integers(1, 9, 400), rng.integers(-3, 9, 400), rng.integers(0, 9, 400))] + [(9, 0, 0), (10, None, 1), (None, 1, 1), (11, 2**31 - 1, 0), (11, -(2**31), 0)]
    df = spark.createDataFrame(rows, "matrix_id bigint, i int, j int")
    got = sorted(map(str, mx.cell_components(df).collect()))
    assert got == sorted(map(str, mx.cell_components(df, max_matrix_cells=40).collect())) and len(got) == len(set(rows))
    assert mx.cell_components(df.limit(0)).count() == 0


def test_labels_of_long_pieces():
    # a snake through a wide matrix, and a comb: pieces far longer than they are wide
    snake = sorted([(0, i, j) for i in range(0, 200, 2) for j in range(100)] + [(0, i, 99 if i % 4 == 1 else 0) for i in range(1, 199, 2)])
    m, i, j = (np.array(x) for x in zip(*snake))
    assert set(mx.label_cells(m, i, j).tolist()) == {0}
    assert mx.label_cells(np.array([1, 1, 2]), np.array([0, 0, 1]), np.array([0, 2, 0])).tolist() == [0, 1, 2]


def test_placement_by_tiers(spark):
    # a 2x2 world seeded once; a child matrix whose uncles disagree; one that only a tie speaks for
    cells = [("w", 1, 0, 0), ("w", 2, 0, 1), ("w", 3, 1, 1), ("w", 4, 1, 0)]
    cells += [("c", 10, 0, 0), ("c", 11, 0, 1), ("c", 12, 1, 1), ("tie", 20, 0, 0), ("tie", 21, 0, 1), ("s", 30, 0, 0), ("s", 31, 0, 1), ("out", 40, 0, 0), ("out", 41, 1, 0)]
    uncles = [(10, 1, 0), (11, 1, 1), (12, 1, 1), (20, 2, 0), (21, 3, 2), (30, 2, 2), (31, 2, 2), (40, 3, 3), (41, 99, 0)]
    seeds = [(1, "00"), (30, "0200")]  # one seed outvotes the uncles of its matrix
    got = {r.tile_id: (r.matrix_id, r.path) for r in mx.place_matrices(
        spark.createDataFrame(cells, "matrix_id string, tile_id bigint, i int, j int"), spark.createDataFrame(uncles, "tile_id bigint, uncle_id bigint, digit int"), spark.createDataFrame(seeds, "tile_id bigint, path string"),
    ).collect()}
    assert {t: p for t, (m, p) in got.items() if m == "w"} == {1: "00", 2: "01", 3: "02", 4: "03"}
    assert {t: p for t, (m, p) in got.items() if m == "c"} == {10: "000", 11: "001", 12: "002"}
    assert {t: p for t, (m, p) in got.items() if m == "s"} == {30: "0200", 31: "0201"}
    assert not any(m in ("tie", "out") for m, _ in got.values())  # no majority, and beyond the last row


def test_places_and_paths_are_inverse(spark):
    paths = ["0", "01", "02", "03", "0123", "03210", "00000"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").withColumn("x", mx.place_of(F.col("p")))
    assert all(r.p == r.q for r in df.select("p", mx.path_of(F.col("x.level"), F.col("x.row"), F.col("x.col")).alias("q")).collect())


def test_sweeps_to_the_end():
    a, b, c = [(1, 0, 0), (2, 0, 1)], [(2, 3, 3), (3, 3, 4)], [(3, 0, 0), (4, 0, 1)]
    alone = [(9, 0, 0)]
    # b joins a, c joins a and b; cut at tile 3, the left part is a matrix of its own and joins no more: no tile is shared
    assert mx.grouping_fixpoint([(1, a), (5, alone), (2, b), (3, c)], set()) == [(0, 1, 1, 0, 0), (0, 1, 2, 0, 1), (0, 1, 3, 0, 2), (0, 1, 4, 0, 3), (1, 5, 9, 0, 0)]
    got = mx.grouping_fixpoint([(1, a), (2, b), (3, c)], {3})
    assert {(g, t): (i, j) for g, _, t, i, j in got} == {(0, 3): (0, 0), (0, 4): (0, 1), (1, 1): (0, 0), (1, 2): (0, 1)}
    assert mx.full_merge([(3, c), (1, a), (2, b)]) == [(3, 3, 0, 2), (3, 4, 0, 3), (3, 2, 0, 1), (3, 1, 0, 0)]
    assert mx.full_merge([]) == [] and mx.grouping_fixpoint([], {1}) == []
    clash = [(2, 0, 0), (7, 0, -1)]  # 7 would lie on 1
    assert mx.merged(dict((t, (i, j)) for t, i, j in a), dict((t, (i, j)) for t, i, j in clash)) is None


@pytest.mark.parametrize("holders, whole", [(2000, 32), (3, 32), (3, 4), (2000, 0)])
def test_pairs_are_compared_at_their_first_shared_tile(spark, holders, whole):
    rng = np.random.default_rng(6)
    rows = {(m, t): (i, int(rng.integers(-2, 3))) for m in range(40) for i, t in enumerate(rng.choice(12, rng.integers(1, 8), replace=False).tolist())}
    rows |= {(m, 50 + k): (k // 3, k % 3) for m in (69, 70, 71) for k in range(6) if (m, k) != (71, 4)}
    df = spark.createDataFrame([(m, t, i, j) for (m, t), (i, j) in rows.items()], "matrix_id bigint, tile_id bigint, i int, j int")
    u = mx.unanimous(mx.shared_tiles(df))
    for new, old in ((pairs.conflicts, mx.conflicts), (pairs.merged_sizes, mx.merged_sizes), (pairs.merged_cells, mx.merge_pairs)):
        got = new(df, holders, whole)
        assert dict(got.dtypes) == dict(old(u, df).dtypes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, old(u, df).select(got.columns).collect()))
    want = mx.conflicts(u, df).filter("n_conflicts = 0").groupBy("b").count().collect()
    assert sorted(map(tuple, pairs.gone(df, holders, whole).collect())) == sorted(map(tuple, want)) and len(want)


@pytest.mark.parametrize("name", ["set2_union_cells", "jn11_conflicts", "mtx4_pair_merge"])
def test_pairs_are_not_shuffled(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
