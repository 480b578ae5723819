"""Edge cases of the general data-preparation operators."""

import datetime as dt
import glob
import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.operators import compaction, drift, hierarchy, orphans, shred
from quadloom.runtime import Scratch, checkpoint_dir, dealt_join

T0 = dt.datetime(2025, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


FILES = "file_id bigint, image_path string, texture_file string, content binary, n_bytes int, digest string"


def test_compaction_keeps_each_version_once(spark):
    rows = [
        (1, "/pyramids/p01/pyramidalImage/1/2/012.png", None, b"abc", 3, "x"),
        (2, "/pyramids/p01/pyramidalImage/01/./012//012.PNG ", None, b"abc", 3, "x"),  # other layout and spelling
        (3, "/pyramids/p01/pyramidalImage/1/tmp/../2/012.png", None, b"abd", None, None),  # other bytes
        (4, "/pyramids/p02/pyramidalImage/1/2/012.png", None, b"abc", 3, "x"),  # other pyramid
        (5, None, "/exports/e1/matrix_2/7_30.png", b"", 0, None),
        (6, None, "/exports/e1/matrix_2/00007_30.png", b"", 0, None),
        (7, None, None, b"abc", 3, None),
        (8, None, "/exports/e1/matrix_3/7_30.png", None, None, None),
        (9, " ", " ", b"q", 1, None),
        (None, "/pyramids/p01/pyramidalImage/0.png", None, b"z", 1, None),
    ]
    files = spark.createDataFrame(rows, FILES)
    c = compaction.compact_files(files, target_bytes=64)
    assert {r.file_id for r in compaction.repeated_files(files, c).collect()} == {2, 6}
    m = compaction.manifest(c).collect()
    assert {r.file_id for r in m} == {1, 3, 4, 5} and all(r.verified for r in m)
    back = {r.file_id: bytes(r.content) for r in compaction.restore(c).collect()}
    assert back == {1: b"abc", 3: b"abd", 4: b"abc", 5: b""}


def test_compaction_of_many_copies_and_empty_input(spark, tmp_path):
    # one tile holds a third of all files, all equal; sizes need several containers
    rows = [(i, None, f"/exports/e1/matrix_1/1_{0 if i % 3 == 0 else i}.png", b"same" if i % 3 == 0 else bytes([i % 251]) * (i % 90), None, None) for i in range(1, 900)]
    files = spark.createDataFrame(rows, FILES)
    c = compaction.compact_files(files, target_bytes=2000, uri=f"file://{tmp_path}/out").collect()
    want = {(r[2], r[3]): r[0] for r in reversed(rows)}
    assert {m.file_id for r in c for m in r.members} == set(want.values()) and all(m.verified for r in c for m in r.members)
    held = sorted(sum(m.n_bytes for m in r.members) for r in c)
    assert len(held) > 5 and all(2000 - 90 <= n <= 2000 + 90 for n in held[1:])  # all but one reach the target
    assert sum(len(list(compaction.split_frames(open(f"{tmp_path}/out/{r.container_id}.zst", "rb").read()))) for r in c) == len(want)
    again = {r.container_id: r.crc32 for r in compaction.compact_files(files.repartition(7), target_bytes=2000).collect()}
    assert again == {r.container_id: r.crc32 for r in c}  # ids and bytes follow from the members
    assert [m["verified"] for m in compaction.check_members(b"abc", [{"frame_offset": 0, "frame_bytes": 3, "n_bytes": 3, "crc32": 5}])] == [False]
    empty = spark.createDataFrame([], FILES)
    assert compaction.repeated_files(empty, compaction.compact_files(empty)).count() == 0


def test_joining_text_and_frames():
    import zstandard

    assert compaction.join_newline_delimited([b"\xef\xbb\xbfa\n1", b"", b"a\r\n2\n", b"a\n"], has_header=True) == b"a\n1\n2\n"
    assert compaction.join_newline_delimited([b"1", b"2\n"]) == b"1\n2\n"
    with pytest.raises(ValueError):
        compaction.join_newline_delimited([b"a\n1", b"b\n2"], has_header=True)
    f = zstandard.ZstdCompressor().compress(b"hello")
    assert compaction.is_complete_frame(f) and compaction.is_complete_frame(f + f)
    assert not compaction.is_complete_frame(f[:-1]) and not compaction.is_complete_frame(b"hello")
    assert list(compaction.split_frames(f + f)) == [b"hello", b"hello"]


@pytest.mark.parametrize("block_rows", [10**6, 7])
def test_container_numbers_over_ranges(spark, block_rows):
    sizes = [int(x) for x in np.random.default_rng(3).integers(0, 50, 100)]
    df = spark.createDataFrame([(f"k{i:03d}", n) for i, n in enumerate(sizes)], "k string, n_bytes bigint")
    got = {r.k: r.container_no for r in compaction.numbered(df, Scratch(spark, "t"), ["k"], 100, block_rows).collect()}
    assert got == {f"k{i:03d}": sum(sizes[:i]) // 100 for i in range(100)}


def test_text_containers(spark, tmp_path):
    parts = [(1, b"a,b\n1,2\n"), (2, b"\xef\xbb\xbfa,b\r\n3,4"), (3, b"c\n9\n"), (4, b""), (5, None), (6, b"a,b\n"), (2, b"a,b\n5,6\n"), (None, b"a,b\n7,7\n")] + [(10 + i, b"a,b\n%d,0\n" % i) for i in range(40)]
    df = spark.createDataFrame(parts, "file_id bigint, content binary")
    for uri in (None, f"file://{tmp_path}/text"):
        got = compaction.compact_text(df, True, target_bytes=100, uri=uri).collect()
        assert all(r.verified for r in got) and sum(r.n_members for r in got) == 45 and len([r for r in got if r.header == "a,b"]) > 3
        texts = [bytes(r.payload) if r.payload is not None else open(f"{tmp_path}/text/{r.container_id}", "rb").read() for r in got]
        assert sorted(x for t in texts for x in t.splitlines()[1:]) == sorted([b"1,2", b"3,4", b"9", b"5,6"] + [b"%d,0" % i for i in range(40)])
    plain = compaction.compact_text(df, False, target_bytes=1 << 20).collect()
    assert len(plain) == 1 and plain[0].header is None and plain[0].verified
    assert compaction.compact_text(df.limit(0), True).count() == 0


def test_frames_stay_as_they_are(spark):
    import zstandard

    f = zstandard.ZstdCompressor().compress(b"x" * 100)
    files = spark.createDataFrame([(1, None, "/e/matrix_1/1_1.png", f, None, None)], FILES)
    c = compaction.compact_files(files)
    row = c.collect()[0]
    assert bytes(row.payload) == f and row.crc32 == zlib.crc32(f)
    assert [bytes(r.content) for r in compaction.restore(c).collect()] == [f]


TILES = "row_id bigint, session_id bigint, content_id string, west_neighbor string, north_neighbor string, arrived_at timestamp_ntz, removed_at timestamp_ntz, packed string, day int"
UNCLES = "uncle_row_id bigint, session_id bigint, uncle_content_id string, arrived_at timestamp_ntz, at string"


def brute_orphans(tiles, uncles):
    def key(x):
        x = x.strip()
        a = x.split("_")
        return f"{int(a[0])}_{int(a[1])}" if len(a) == 2 and a[0].isdigit() and a[1].isdigit() else x

    out = set()
    refs = [("frame_tiles", r[0], f, r[1], v, r[5]) for r in tiles for f, v in (("west_neighbor", r[3]), ("north_neighbor", r[4]))]
    refs += [("tile_uncles", r[0], "uncle_content_id", r[1], r[2], r[3]) for r in uncles]
    for t, i, f, s, v, when in refs:
        if v is None or not v.strip() or v.strip().lower() == "null":
            continue
        ok = any(s is not None and s == x[1] and x[2] is not None and key(x[2]) == key(v) and when and x[5] and x[5] <= when and (x[6] is None or x[6] > when) for x in tiles)
        if not ok:
            out.add((t, i, f))
    return out


@pytest.mark.parametrize("seed, hot_rows", [(1, 10**6), (2, 10**6), (1, 5), (2, 5)])
def test_orphans_against_brute_force(spark, seed, hot_rows):
    rng = np.random.default_rng(seed)
    ids = ["1_1", " 00001_1", "1_2", "0002_3", "2_3 ", "x", None, "null", "", "99999999999_1", "3_3"]
    pick = lambda p: ids[int(rng.choice(len(ids), p=p))]
    p = np.array([0.35, 0.05, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05, 0.1])  # one id holds a third
    hour = lambda none: None if rng.random() < none else int(rng.integers(0, 80))
    tiles = [(i, None if rng.random() < 0.05 else int(rng.integers(1, 3)), pick(p), pick(p), pick(p), at(hour(0.05)), at(hour(0.5)), "c", 0) for i in range(150)]
    uncles = [(i, int(rng.integers(1, 3)), pick(p), at(hour(0.05)), "c") for i in range(60)]
    got = orphans.find_orphans(spark.createDataFrame(tiles, TILES), spark.createDataFrame(uncles, UNCLES), hot_rows)
    rows = [(r.ref_table, r.ref_id, r.field_name) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_orphans(tiles, uncles)


def test_counts_are_maintained(spark):
    tiles = [(1, 1, "1_1", "1_2", None, at(1), None, "c", 0), (2, 1, "1_2", "1_3", "1_1", at(2), None, "c", 0), (3, 1, "1_2", "9_9", None, at(3), at(9), "c", 0), (4, None, "1_1", "1_5", None, at(3), None, "c", 0)]
    uncles = [(1, 1, "1_2", at(1), "c"), (2, 1, "7_7", at(2), "c")]
    t, u = (lambda x: spark.createDataFrame(x, TILES)), (lambda x: spark.createDataFrame(x, UNCLES))
    whole = sorted(map(str, orphans.key_deltas(t(tiles), u(uncles)).filter("n_existing <> 0 or n_references <> 0").collect()))
    counts = orphans.key_deltas(t(tiles[:1]), u(uncles[:1]))
    for k in (1, 2, 3):  # a row at a time, as it arrives
        row = (*tiles[k][:6], None, *tiles[k][7:])
        counts = orphans.update_counts(counts, orphans.key_deltas(t([row]), u(uncles[k : k + 1])))
    counts = orphans.update_counts(counts, orphans.removals(t(tiles[2:3])))
    assert sorted(map(str, counts.collect())) == whole
    assert {(r.session_id, r.packed & 0x7FFFFFFF) for r in orphans.orphan_keys(counts).collect()} == {(1, 3), (1, 7), (None, 5)}


def test_orphans_of_nothing(spark):
    a, b = spark.createDataFrame([], TILES), spark.createDataFrame([], UNCLES)
    assert orphans.find_orphans(a, b).count() == 0 and orphans.current_orphan_keys(a, b).count() == 0


def walk(parent):
    out = {}
    for k in parent:
        seen, x = [], k
        while parent.get(x) in parent and parent[x] is not None and x not in seen:
            seen.append(x)
            x = parent[x]
        out[k] = ("cycle", -1) if x in seen else (str(x), len(seen))
    return out


PARENTS = [
    {},
    {0: None},
    {0: 0},
    {0: None, 1: 0, 2: 1, 3: 1, 4: 9, 5: 6, 6: 7, 7: 5, 8: 5, 10: 4},
    {i: i - 1 for i in range(20)},
]


@pytest.mark.parametrize("bound", [1000, 0])
@pytest.mark.parametrize("case", range(len(PARENTS)))
def test_nested_sets(spark, bound, case):
    parent = PARENTS[case]
    nodes = spark.createDataFrame([(7, k, p) for k, p in parent.items()], "group_id bigint, node_key bigint, parent_key bigint")
    rows = hierarchy.nested_sets(nodes, prefix=False, max_group_rows=bound).collect()
    assert {int(r.node_key): (r.root_key, r.node_depth) for r in rows} == walk(parent)
    live = [r for r in rows if r.node_depth >= 0]
    assert sorted(r.lft for r in live) == list(range(len(live)))
    for a in live:
        below = {r.node_key for r in live if a.lft < r.lft <= a.rgt}
        want = set()
        for r in live:
            x = parent[int(r.node_key)]
            while x in parent and x is not None:
                if str(x) == a.node_key:
                    want.add(r.node_key)
                    break
                x = parent[x]
        assert below == want and a.subtree_size == len(want) + 1


@pytest.mark.parametrize("bound", [1000, 0])
def test_prefix_trees(spark, bound):
    keys = ["0", "01", "0123", "013", "0333", "033312", "00"]
    tiles = spark.createDataFrame([(1, k, "x") for k in [*keys, "04", "", None, "1", "0"]] + [(2, "0123", "y"), (2, "01230", None), (None, "0", None)], "pyramid_id int, quad_key string, node_depth string")
    rows = hierarchy.nested_sets(hierarchy.tile_nodes(tiles), prefix=True, max_group_rows=bound).collect()
    got = {(r.group_id, r.node_key): (r.root_key, r.node_depth) for r in rows}
    assert got == {(1, "0"): ("0", 0), (1, "01"): ("0", 1), (1, "0123"): ("0", 2), (1, "013"): ("0", 2), (1, "0333"): ("0", 1), (1, "033312"): ("0", 2), (1, "00"): ("0", 1), (2, "0123"): ("0123", 0), (2, "01230"): ("0123", 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 25), min_size=1, max_size=26))
def test_layout_property(parents):
    n = len(parents)
    parent = np.array([p if p < n and p != i else -1 for i, p in enumerate(parents)])
    root, depth, size, pos = hierarchy.layout(parent)
    want = walk({i: (None if p < 0 else int(p)) for i, p in enumerate(parent)})
    assert all((("cycle", -1) if root[i] < 0 else (str(root[i]), depth[i])) == want[i] for i in range(n))
    live = [i for i in range(n) if root[i] >= 0]
    assert sorted(pos[i] for i in live) == list(range(len(live)))
    for i in live:
        if parent[i] >= 0:
            assert pos[parent[i]] < pos[i] and pos[i] + size[i] <= pos[parent[i]] + size[parent[i]]


FILE = "producer_id bigint, export_no int, layer_file_id bigint, body string, types string"


def test_schema_changes(spark):
    rows = [
        (1, 1, 1, '{"a": 1, "b": null, "c": "x"}', None), (1, 1, 2, '{"a": 2.5}', None), (1, 1, 9, '{"broken": ', None), (1, 1, 10, "[1]", None), (1, 1, 11, None, None),
        (1, 4, 3, '{"a": "1", "b": 2, "d": NaN}', None), (1, 4, 4, '{"a": 1, "b": 2}', None),  # NaN is not JSON
        (1, 5, 5, '{"broken"', None),  # no valid file: not an export
        (1, 7, 6, '{"b": true, "producer_id": {}}', None), (1, 7, 6, '{"b": true, "producer_id": {}}', None),
        (1, 8, 7, "{}", None), (2, 1, 8, '{"z": []}', None), (None, 1, 12, '{"q": 1}', None), (1, None, 13, '{"q": 1}', None),
    ]
    f = spark.createDataFrame(rows, FILE)
    got = {(r.producer_id, r.export_no, r.field_name, r.change_kind) for r in drift.schema_changes(drift.file_schemas(f)).collect()}
    assert got == {(1, 4, "c", "removed"), (1, 7, "a", "removed"), (1, 7, "b", "retyped"), (1, 7, "producer_id", "added"), (1, 8, "b", "removed"), (1, 8, "producer_id", "removed")}
    u = drift.read_unified(f)
    assert "field_producer_id" in u.columns and dict(u.dtypes)["c"] == "string"
    assert dict(u.dtypes)["a"] == "double" and u.filter("layer_file_id = 2").first()["a"] == 2.5
    assert drift.schema_changes(drift.file_schemas(spark.createDataFrame([], FILE))).count() == 0


def test_numbers_keep_their_value(spark):
    big, wide = (1 << 53) + 1, 10**30 + 7
    bodies = [{"i": big, "w": wide, "m": 1.5, "x": big, "h": 10**40, "s": 7}, {"i": 3, "w": 2, "m": 4, "x": 0.25, "h": 1, "s": -1}, {"i": None, "w": None, "s": True}]
    f = spark.createDataFrame([(1, 1, k, json.dumps(b), None) for k, b in enumerate(bodies)], FILE)
    u = drift.read_unified(f)
    kinds = {k: v for k, v in u.dtypes if k in "iwmxhs"}
    assert kinds == {"i": "bigint", "w": "decimal(38,0)", "m": "double", "x": "string", "h": "string", "s": "string"}
    r = {x.layer_file_id: x for x in u.collect()}
    assert (r[0].i, int(r[0].w), r[0].m, r[0].x, r[0].h, r[0].s) == (big, wide, 1.5, str(big), str(10**40), "7") and (r[1].i, r[1].m, r[1].x, r[2].i, r[2].s) == (3, 4.0, "0.25", None, "true")


def test_previous_exports_over_blocks(spark):
    nos = [1, 2, 5, 6, 13, 40]
    e = spark.createDataFrame([(1, n) for n in nos], "producer_id bigint, export_no bigint")
    got = {r.export_no: r.prev_export_no for r in drift.previous_exports(e, per_bucket=4).collect()}
    assert got == dict(zip(nos, [None, *nos[:-1]]))


def test_shredding(spark):
    v = '{"x":1.0,"y":2.0,"z":0.0,"u":0.0,"v":1.0}'
    bodies = [
        f'{{"id":1,"tiles":[{{"triangleStrip":{{"vertices":[{v},null,{v}]}},"uncles":[null,{{"direction":"A","uncleContentId":"1_1"}}],"modelViewMatrix":[1,0]}}]}}',
        f'{{"frame":{{"patches":[{{"tiles":[{{"triangleStrip":[{v}]}}]}},{{"tiles":[{{"uncles":{{"items":[null,{{"direction":"B"}}]}}}},null,{{"modelViewMatrix":null}}]}}]}}}}',
        '{"tiles":[{"triangleStrip":{"vertices":[1,2,3,4,5,6,7,8,9,10],"stride":5},"uncles":"[{\\"direction\\": \\"C\\"}]","modelViewMatrix":"1 2"}]}',
        '{"tiles":[{"triangleStrip":{"vertices":[[1,2],null]},"uncles":{"direction":"D"},"modelViewMatrix":{"m":[1]}}]',  # broken
    ]
    f = spark.createDataFrame([(i, b, "t") for i, b in enumerate(bodies)] + [(0, bodies[0], "again"), (None, bodies[0], ""), (9, None, "")], "frame_key bigint, body string, child_kind string")
    nodes = shred.shred(f)
    got = {(r.frame_key, r.tile_no, r.child_kind, r.child_no) for r in nodes.filter("child_kind not in ('tile', 'frame')").collect()}
    assert got == {(0, 0, "vertex", 0), (0, 0, "vertex", 2), (0, 0, "uncle", 1), (0, 0, "matrix", 0), (1, 0, "vertex", 0), (1, 1, "uncle", 1), (2, 0, "vertex", 0), (2, 0, "vertex", 1), (2, 0, "uncle", 0), (2, 0, "matrix", 0)}
    o = shred.objects(nodes)
    assert o.filter("object_kind = 'vertex'").count() == 3  # the vertex object is stored once for three places
    assert o.agg({"n_occurrences": "sum"}).first()[0] == nodes.count()
    tiles = {r.object_id for r in nodes.filter("child_kind = 'tile'").collect()}
    assert {r.parent_id for r in nodes.filter("child_kind = 'vertex'").collect()} <= tiles
    assert shred.shred(f.limit(0)).count() == 0


FRAMES = [
    {"frame": {"camera": {"x": 1}, "tiles": [{"id": "1_1", "triangleStrip": [{"x": 1}, None, {"x": 1}], "uncles": [None, {"d": "N"}], "modelViewMatrix": [1, 2, 3, 4]}]}},
    {"frame": {"camera": {"x": 999}, "tiles": [{"id": "1_1", "triangleStrip": [{"x": 1}, None, {"x": 1}], "uncles": [None, {"d": "N"}], "modelViewMatrix": [1, 2, 3, 4]}]}},
    {"patches": [{"name": "p", "tiles": {"a": {"triangleStrip": {"vertices": [[1, 2], None], "stride": 2, "z": 1}, "uncles": {"direction": "D"}}, "b": 5}}, {"tiles": "[{\"id\": 3}]", "k": []}], "lines": [[1], {}]},
    {"tiles": [{"triangleStrip": [1, 2, 3, 4, 5, 6], "uncles": "x", "modelViewMatrix": {"m": [[1, 0], [0, 1]]}}, None, {"modelViewMatrix": "1 0 0 1", "uncles": {"items": [{"a": 1}, "[]"], "n": 2}}, {"modelViewMatrix": None, "triangleStrip": None}]},
    {"tiles": None, "n": 12345678901234567890, "f": 0.1}, {},
    {"tiles": [{"tiles": [{"id": 1}], "triangleStrip": "{\"vertices\": [[1]]}", "uncles": ["{\"d\": 1}", "plain", ""]}]},
]


def test_frames_are_rebuilt_whole(spark):
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(FRAMES)] + [(0, json.dumps(FRAMES[0])), (50, "{"), (None, "{}")], "frame_key bigint, body string")
    nodes = shred.shred(df)
    back = {r.frame_key: json.loads(r.body) for r in shred.rebuild(shred.bridges(nodes), shred.objects(nodes)).collect()}
    assert back == dict(enumerate(FRAMES))
    whole = {r.frame_key: r.object_id for r in nodes.filter("child_kind = 'frame'").collect()}
    assert len(set(whole.values())) == len(FRAMES)  # the camera is part of the frame's identity
    assert nodes.filter("frame_key in (0, 1) and child_kind = 'tile'").select("object_id").distinct().count() == 1


def test_scratch_tables_live_in_the_checkpoint_folder(spark):
    s = Scratch(spark, "t")
    d = s.save(spark.range(5))
    assert d.count() == 5 and s.base.startswith(checkpoint_dir(spark)) and glob.glob(f"{s.base.removeprefix('file://')}/00001")
    s.drop(d)
    assert not glob.glob(f"{s.base.removeprefix('file://')}/00001")
    s.close()
    assert not glob.glob(s.home.removeprefix("file://"))


def test_dealt_join_of_hot_keys(spark):
    many = spark.createDataFrame([(k % 3 and None or 1, i) for i, k in enumerate(range(60))] + [(2, 100), (3, 101)], "k bigint, v bigint")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, w string")
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(one, ["k"], how).collect()))
        assert sorted(map(str, dealt_join(many, one, ["k"], how, hot_rows=4).collect())) == want


@pytest.mark.parametrize("prefix", [False, True])
def test_ranges_are_alike_on_both_sides_of_the_bound(spark, prefix):
    if prefix:
        keys = ["0", "01", "010", "02", "03", "0300", "0301", "02213"] + [f"0{a}{b}{c}" for a in "123" for b in "0123" for c in "03"]
        nodes = spark.createDataFrame([(g, k) for g in (1, 2) for k in dict.fromkeys(keys)], "group_id bigint, node_key string")
    else:
        up = {1: None, 30: None, 4: 99, 2: 1, 3: 1, 10: 1, 20: 1, 9: 30, 100: 30, 11: 100, 7: 8, 8: 7, (1 << 53) + 1: 1, (1 << 53) + 2: (1 << 53) + 1}
        nodes = spark.createDataFrame([(g, k, p) for g in (1, 2) for k, p in up.items()], "group_id bigint, node_key bigint, parent_key bigint")
    cols = ["group_id", "node_key", "root_key", "node_depth", "subtree_size", "lft", "rgt"]
    small = sorted(map(tuple, hierarchy.nested_sets(nodes, prefix).select(cols).collect()))
    assert small == sorted(map(tuple, hierarchy.nested_sets(nodes, prefix, max_group_rows=2).select(cols).collect()))
    t = hierarchy.with_prefix_parents(nodes) if prefix else nodes
    dealt = hierarchy.nested_sets_distributed(t, Scratch(spark, "t"), numbers=not prefix, hot_rows=3, block_rows=4)
    assert small == sorted(map(tuple, dealt.select(cols).collect()))
