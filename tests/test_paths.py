"""Paths and descendants of every node of a hierarchy."""

import pytest

from quadloom.operators import hierarchy
from tests.test_training import PARENTS, walk


@pytest.mark.parametrize("bound", [1000, 0])
@pytest.mark.parametrize("case", range(len(PARENTS)))
def test_paths_and_descendants(spark, bound, case):
    parent = PARENTS[case]
    nodes = spark.createDataFrame([(7, k, p) for k, p in parent.items()], "group_id bigint, node_key bigint, parent_key bigint")
    got = hierarchy.paths(hierarchy.nested_sets(nodes, prefix=False, max_group_rows=bound))
    want = {}
    for k, (root, depth) in walk(parent).items():
        path = [k]
        for _ in range(depth):
            path.insert(0, parent[path[0]])
        want[k] = None if root == "cycle" else [str(x) for x in path]
    rows = got.collect()
    assert len(rows) == len(want) and {int(r.node_key): r.node_path for r in rows} == want
    below = [tuple(r) for r in hierarchy.all_descendants(got).collect()]
    pairs = {(7, a, str(k), len(p) - 1 - i) for k, p in want.items() if p for i, a in enumerate(p[:-1])}
    assert len(below) == len(pairs) and set(below) == pairs


def test_inner_tiles_have_descendants(spark):
    tiles = spark.createDataFrame([(1, q) for q in ("0", "01", "0123", "013", "02")], "pyramid_id bigint, quad_key string")
    p = hierarchy.paths(hierarchy.nested_sets(hierarchy.tile_nodes(tiles), prefix=True))
    assert {r.node_key: r.node_path for r in p.collect()}["0123"] == ["0", "01", "0123"]
    assert {(r.ancestor_key, r.descendant_key, r.distance) for r in hierarchy.all_descendants(p).collect()} == {("0", "01", 1), ("0", "0123", 2), ("0", "013", 2), ("0", "02", 1), ("01", "0123", 1), ("01", "013", 1)}
