import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import components
from quadloom.runtime import Scratch


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def same(a, b):
    return len({(x, y) for x, y in zip(a, b)}) == len(set(a)) == len(set(b))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.lists(st.tuples(st.integers(0, 59), st.integers(0, 59)), max_size=80))
def test_decomposition(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs]
    a = np.array([p[0] for p in pairs], np.int64)
    b = np.array([p[1] for p in pairs], np.int64)
    keep = a != b
    assert same(components.decompose(n, a[keep], b[keep]).tolist(), union_find(n, pairs))


def test_long_chain_and_star():
    n = 20_000
    assert len(set(components.decompose(n, np.arange(n - 1), np.arange(1, n)).tolist())) == 1
    assert len(set(components.decompose(n, np.zeros(n - 1, np.int64), np.arange(1, n)).tolist())) == 1


@pytest.mark.parametrize("task_links, hot_rows", [(10**6, 10**6), (0, 10**6), (0, 3)])
def test_rounds_in_spark(spark, task_links, hot_rows):
    rng = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100, int(x)) for x in range(101, 140)] + [tuple(map(int, rng.integers(200, 230, 2))) for _ in range(20)]
    df = spark.createDataFrame([((1, a), (1, b)) for a, b in pairs], "a struct<session_id:bigint,root:bigint>, b struct<session_id:bigint,root:bigint>")
    got = {r.v.root: r.root.root for r in components.connect(df, Scratch(spark, "t"), task_links, hot_rows).collect()}
    want = union_find(300, pairs)
    verts = sorted({x for a, b in pairs if a != b for x in (a, b)})
    assert sorted(got) == verts and same([got[v] for v in verts], [want[v] for v in verts])


SCHEMA = "row_id bigint, session_id bigint, content_id string, south_neighbor string, east_neighbor string, root string, id string"


def test_tile_groups(spark):
    far = 5000  # another block of tile numbers
    data = [
        (1, 1, "1_1", "00001_2", None, "x", "y"), (2, 1, " 1_2 ", None, "null", "x", "y"), (3, 1, "1_2", "1_3", "1_99", "x", "y"),  # second record adds a link
        (4, 1, "00001_3", "", f"1_{far}", "x", "y"), (5, 1, f"1_{far}", "2_7", None, "x", "y"), (6, 1, "2_7", None, "2_7", "x", "y"),  # across blocks and frames
        (7, 1, "3_1", "1_98", None, "x", "y"), (8, 2, "1_1", "1_2", None, "x", "y"), (9, 2, "1_3", "1_3", None, "x", "y"),  # other session, nothing to link
        (10, None, "1_1", "1_2", None, "x", "y"), (11, 1, "odd", "1_1", None, "x", "y"), (12, 1, None, "1_1", None, "x", "y"), (13, 3, "9_10", "9_9", None, "x", "y"), (14, 3, "9_9", None, None, "x", "y"),
        (15, 3, "9_10", "9_9", None, "x", "y"),
    ]
    got = [tuple(r) for r in components.tile_groups(spark.createDataFrame(data, SCHEMA)).collect()]
    first = "00001_1"
    assert len(got) == len(set(got)) and set(got) == {(1, c, first) for c in ("00001_1", "00001_2", "00001_3", f"00001_{far}", "00002_7")} | {(3, "00009_10", "00009_9"), (3, "00009_9", "00009_9")}
    assert {tuple(r) for r in components.tile_groups(spark.createDataFrame(data, SCHEMA), task_links=0, hot_rows=1).collect()} == set(got)
    assert components.tile_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert components.tile_groups(spark.createDataFrame(data[6:7], SCHEMA)).count() == 0
