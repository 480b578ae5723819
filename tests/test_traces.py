"""Traces in parts, containers of every kind, and exports."""

import io
import json
import random
import tarfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadloom.runtime import Scratch, checkpoint_dir, read_files
from quadloom.sources import archives, blobs, frames, traces

CALLS = [(k % 3, f"gl{'ABC'[k % 3]}", {"x": k, "s": "t" * (k % 40), "b": bytes([k % 256]) * (k % 5), "l": [1.5, None, k]}, k) for k in range(1000)]
DATA = traces.write_trace(CALLS)
KINDS = {"plain": DATA, "brotli": pa.compress(DATA, codec="brotli", asbytes=True), **{k: blobs.packed_bytes(DATA, k) for k in ("gzip", "bzip2", "zstd", "snappy")}}


@pytest.mark.parametrize("kind", KINDS)
def test_parts_between_bookmarks(spark, tmp_path, kind):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "t.trace").write_bytes(KINDS[kind])
    pattern = f"{tmp_path}/**/*.trace"
    whole = [tuple(r) for r in traces.read_traces(spark, pattern).orderBy("call_no").collect()]
    assert len(whole) == 1000 and json.loads(whole[7][4]) == {"x": 7, "s": "t" * 7, "b": "blob(2)", "l": [1.5, None, 7]}
    assert traces.write_bookmarks(spark, pattern, 90).first()["n_marks"] == 11
    parts = traces.read_traces(spark, pattern)
    assert parts.rdd.getNumPartitions() == 12 and [tuple(r) for r in parts.orderBy("call_no").collect()] == whole
    some = traces.read_traces(spark, pattern, columns=["name", "call_no"], first=500, last=520)
    assert some.columns == ["name", "call_no"] and some.rdd.getNumPartitions() <= 2
    assert sorted(r.call_no for r in some.collect()) == list(range(500, 521))
    data = traces.read_traces(spark, pattern, first=3, last=3, blobs="base64").first()["args"]
    assert json.loads(data)["b"] == {"blob": "AwMD"}


def test_open_calls_and_paths(spark, tmp_path):
    assert traces.trace_files(f"{tmp_path}/*.trace") == [] and traces.read_traces(spark, f"{tmp_path}/*.trace").count() == 0
    for n in ("a.trace", "b.trace", ".hidden.trace", "c.txt"):
        (tmp_path / n).write_bytes(DATA[:-3])
    assert [p.rsplit("/", 1)[-1] for p in traces.trace_files(f"file://{tmp_path}/?.trace")] == ["a.trace", "b.trace"]
    r = traces.read_traces(spark, f"file://{tmp_path}/a.trace")
    assert r.filter("not complete").count() == 1 and r.count() == 1000
    # a call that stays open over all others allows no bookmark
    one = bytearray([6, traces.ENTER, 1, 0, 1]) + b"f" + bytes([0, traces.END])
    inner = b"".join(bytes([traces.ENTER, 2, 0, traces.END, traces.LEAVE, k, traces.END]) for k in range(1, 50))
    assert traces.bookmarks(bytes(one) + inner, 5)["marks"] == []


def test_frame_files_blobs_and_layers(spark, tmp_path):
    lines = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", None), (2, 3, None, None), (None, 4, "x", None)], "frame_id bigint, order bigint, line string, file string")
    got = {r.frame_id: r.n_lines for r in traces.write_frame_files(lines, f"file://{tmp_path}/f").collect()}
    assert got == {1: 2, 2: 1} and (tmp_path / "f/00001/gl.txt").read_text() == "a\nb\n" and (tmp_path / "f/00002/gl.txt").read_text() == "\n"
    calls = spark.createDataFrame([(7, 3, "glX", '{"a": {"blob": "AQI="}, "n": 1}'), (7, 4, "glY", None)], "frame_id bigint, call_no bigint, name string, args string")
    e = traces.export_blobs(calls, f"{tmp_path}/b").collect()
    assert [(r.arg, r.n_bytes) for r in e] == [("a", 2)] and blobs.plain_bytes(open(e[0].file, "rb").read()) == b"\x01\x02" and "bytes=2 compression=bzip2" in e[0].line
    layers = spark.createDataFrame([(1, 5, 0, 0, "/a/x.png", None, b"q"), (1, 6, 0, 1, None, "r/y.png", None), (1, 7, 1, 0, None, None, b"z")], "matrix_id bigint, tile_id bigint, i int, j int, absolute string, relative string, content binary")
    for _ in range(2):  # the folder is cleared first
        (tmp_path / "l").mkdir(exist_ok=True)
        (tmp_path / "l" / "old").write_text("x")
        assert frames.export_layers(layers, f"{tmp_path}/l").first()["n_textures"] == 2
        assert sorted(p.name for p in (tmp_path / "l").rglob("*") if p.is_file()) == ["256x256_7.png", "matrixLayer.json", "x.png"]
    j = json.loads((tmp_path / "l/matrix_1/matrixLayer.json").read_text())
    assert (j["contractVersion"], j["rows"], j["cols"]) == (3, 2, 2) and [t["textureFile"] for t in j["tiles"]] == ["x.png", "y.png", "256x256_7.png"]


def test_containers(spark):
    for kind in ("plain", "gzip", "bzip2", "zstd", "snappy"):
        for data in (b"", b"x", b"abc" * 900_000):
            packed = blobs.packed_bytes(data, kind)
            assert blobs.plain_bytes(packed) == data and (not data or blobs.container_of(packed) == kind)
    df = spark.createDataFrame([(blobs.packed_bytes(b"hello", k),) for k in ("gzip", "snappy")] + [(b"x",), (None,)], "b binary")
    assert [r.k for r in df.select(blobs.container_kind(F.col("b")).alias("k")).collect()] == ["gzip", "snappy", "plain", None]


def test_written_files_are_read_without_a_listing(spark, tmp_path):
    uri = f"file://{tmp_path}/f"
    lines = spark.createDataFrame([(k % 7, k, f"l\u00e9{k}" if k % 5 else "") for k in range(40)] + [(9, 1, None)], "frame_id bigint, order bigint, line string")
    written = Scratch(spark, "t").save(traces.write_frame_files(lines, uri))
    got = frames.read_written_lines(written, uri)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frames.read_frame_lines(spark, uri).collect())) and got.count() == 41
    from quadloom.plans import registry

    plan = registry.queries()["snk8_frame_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.rstrip().endswith(" text") and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["snk5_layer_export", "snk13_blob_export"])
def test_exports_are_read_by_their_names(spark, name):
    from quadloom.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "json\n" not in plan and "MapInArrow" in plan


def test_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1")
    df = spark.createDataFrame([(1, f"{tmp_path}/a"), (2, f"{tmp_path}/none"), (3, None)], "k int, file string")
    assert {r.k: r.content for r in read_files(df, "file", f"file://{tmp_path}").collect()} == {1: b"1", 2: None, 3: None}


def test_tar_entries():
    files = [("a/b.png", b"x"), ("a/empty", b""), ("\u00e9/" + "n" * 98, b"y" * 512), ("d/" + "\u00e9" * 120, b"z" * 513), ("c", b"\0" * 700)]
    data = b"".join(archives.tar_entry(*f) for f in files) + bytes(1024)
    assert list(archives.tar_files(io.BytesIO(data))) == files
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        assert [(m.name, t.extractfile(m).read()) for m in t] == files
    for n in (len(data) - 1024, 700, 100):
        with pytest.raises(ValueError):
            list(archives.tar_files(io.BytesIO(data[:n])))


def test_packed_layers_are_the_folders(spark, tmp_path):
    r = random.Random(5)
    rows = [(m, t, k // 4, k % 4, f"/a/{t}_x.png" if t % 3 == 0 else None, f"r/{t}.png" if t % 2 == 0 else None, bytes([t % 256]) * r.choice([0, 3, 600, 4000]) if t % 5 else None) for m in [*range(-3, 40), 9_000_000_000] for k, t in enumerate(r.sample(range(-50, 1000), 1 + m % 9))]
    rows.append((None, 1, 0, 0, None, None, b"n"))
    r.shuffle(rows)
    layers = spark.createDataFrame(rows, "matrix_id bigint, tile_id bigint, i int, j int, absolute string, relative string, content binary")
    n = frames.export_layers(layers, f"{tmp_path}/f").agg(F.count("matrix_id"), F.sum("n_tiles"), F.sum("n_textures")).first()
    for _ in range(2):  # the folder is cleared first
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / "old").write_text("x")
        made = frames.pack_layers(layers, f"file://{tmp_path}/p", 1).collect()
        assert sorted(str(p) for p in (tmp_path / "p").iterdir()) == sorted(m.file for m in made)
    assert [sum(m[k] for m in made) for k in ("n_layers", "n_tiles", "n_textures")] == list(n) and len(made) <= 44
    whole = frames.pack_layers(layers, f"{tmp_path}/w").collect()
    assert len(whole) <= 4 and sum(m.n_layers for m in whole) == 44
    for at, files in (("p", made), ("w", whole)):
        for m in files:
            with tarfile.open(fileobj=io.BytesIO(blobs.plain_bytes(Path(m.file).read_bytes()))) as t:
                t.extractall(tmp_path / f"{at}-out", filter="data")
        tree = [{str(p.relative_to(tmp_path / x)): p.read_bytes() for p in (tmp_path / x).rglob("*") if p.is_file()} for x in ("f", f"{at}-out")]
        assert tree[0] == tree[1] and len(tree[0]) == n[0] + n[2]
        got = frames.read_packed_layers(spark, [m.file for m in files], f"{tmp_path}/{at}").collect()
        want = [(m, str(t), i, j, (a or b or f"256x256_{t}.png").split("/")[-1], c) for m, t, i, j, a, b, c in rows if m is not None]
        assert sorted((*x[:5], x[5] and bytes(x[5])) for x in got) == sorted((*x[:5], x[5] and bytes(x[5])) for x in want)
    assert frames.read_packed_layers(spark, [], f"{tmp_path}/p").count() == 0


def test_layer_export_takes_no_block_a_texture(spark):
    from quadloom.plans import registry

    home = Path(checkpoint_dir(spark).removeprefix("file://"))
    before = set(home.rglob("*"))
    n = registry.queries()["snk5_layer_export"](spark, "/root/testdata/sf0.001").count()
    new = set(home.rglob("*")) - before
    assert n > 3000 and len(new) < 20 and sum(p.stat().st_blocks * 512 for p in new) < 100 * n
