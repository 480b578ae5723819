"""Session settings, table access, durable intermediate tables and skew helpers."""

from __future__ import annotations

import atexit
import os
import pickle
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_quadloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        folder = tempfile.mkdtemp(prefix="quadloom-package-")
        _OWN_DIRS.append(folder)
        path = f"{folder}/quadloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"quadloom/{f.relative_to(root)}")
        sc.addPyFile(path)
    sc._quadloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_session(app: str = "quadloom", cpus: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a local session, whose tasks all run on this machine, gets a temporary folder where none is
    set; on a cluster a missing setting raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quadloom-")
    _OWN_DIRS.append(own)
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


@atexit.register
def _clean_own() -> None:
    for d in _OWN_DIRS:
        shutil.rmtree(d, ignore_errors=True)


class Scratch:
    """Durable intermediate tables in the checkpoint folder.

    ``save`` writes a DataFrame as parquet and reads it back, which cuts lineage and survives the
    loss of executors.  ``drop`` removes tables that no later step reads, so a loop keeps only its
    last rounds on disk; the last ones are read when the result is, and go with ``close`` or, at the
    latest, when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.home = f"{checkpoint_dir(spark)}/quadloom-{name}-{uuid.uuid4().hex[:12]}"
        self.base = f"{self.home}/tables"
        self.n = 0
        fs, p = self._at(self.home)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, keep_schema: bool = True) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:05d}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path) if keep_schema else self.spark.read.parquet(path)
        out._quadloom_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = getattr(df, "_quadloom_path", None)
            if path:
                fs, p = self._at(path)
                fs.delete(p, True)

    def close(self) -> None:
        """Removes all tables; results that still read them must have been taken."""
        fs, p = self._at(self.home)
        fs.delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly where the scan has fewer tasks than there are cores (few small files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def two_level_rank(df: DataFrame, keys: list[str], order: str, out: str, width: int = 65536) -> DataFrame:
    """Row numbers (from 1) within ``keys`` by a bigint column, without one task a key.

    Rows are numbered inside blocks of ``width`` order values; the sizes of the blocks before are added.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / width))
    n = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    base = n.select(*keys, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rn = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order)))
    return rn.join(base, [*keys, "_b"]).withColumn(out, F.col("_rn") + F.col("_base")).drop("_b", "_rn", "_base")


def file_store(path: str):
    """pyarrow's file system of a path or URI, and the path on it; for files that tasks write and read themselves."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path if re.match(r"^[a-z0-9+]+:", path) else f"file://{os.path.abspath(path)}")


def write_whole(store, path: str, data: bytes) -> None:
    """Writes a file under another name and moves it into its place, so no half of it is ever there."""
    folder = path.rsplit("/", 1)[0]
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as f:
        f.write(data)
    store.move(part, path)


READ_AT_ONCE = 1 << 24


def read_files(named: DataFrame, file: str, uri: str) -> DataFrame:
    """The rows with the ``content`` of the file that each names, on the store of ``uri``; null where there is none.

    Tasks open the files of their rows, so no folder is listed and a file costs neither a task nor room on the driver.
    """
    ship_package(named.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in [*named.dtypes, ("content", "binary")])

    def run(batches):
        from pyarrow import fs

        store, _ = file_store(uri)
        for b in batches:
            held, size, at = [], 0, 0
            for path in b.column(b.schema.get_field_index(file)).to_pylist():
                data = None
                if path is not None and store.get_file_info(path).type == fs.FileType.File:
                    with store.open_input_stream(path, compression=None) as f:
                        data = f.read()
                held.append(data)
                size += len(data or b"")
                if size >= READ_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([*b.slice(at, len(held)).columns, pa.array(held, pa.binary())], names=[*b.schema.names, "content"])
                    at, held, size = at + len(held), [], 0
            if held:
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(held)).columns, pa.array(held, pa.binary())], names=[*b.schema.names, "content"])

    return named.repartition(file).mapInArrow(run, schema)


HOT_ROWS = 2_000_000
MOST_HOT_KEYS = 1_000


def dealt_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, n_rows: int | None = None) -> DataFrame:
    """Join of ``many`` with ``one``, which holds a key at most once, where some keys have very many rows.

    Rows of a key with more than ``hot_rows`` rows (or a thousandth of all) are dealt out over several
    join keys, and the one row is there for each of them.  The list of such keys is broadcast: it has
    fewer than ``MOST_HOT_KEYS`` entries by the choice of the bound.  No key can be hot in fewer rows.
    """
    rows = many.count() if n_rows is None else n_rows
    if rows <= hot_rows:
        return many.join(one, keys, how)
    bound = max(hot_rows, rows // MOST_HOT_KEYS)
    hot = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound).select(*keys, F.ceil(F.col("_n") / bound).cast("int").alias("_parts"))
    m = many.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    o = one.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return m.join(o, [*keys, "_part"], how).drop("_part")


def range_blocks(df: DataFrame, scratch: Scratch, order: list[str], blocks: int) -> DataFrame:
    """The rows saved in ``blocks`` ranges of ``order``; ``_b`` numbers the ranges in that order.

    Windows over ``_b`` see one range each, so no key of any size is one task's work.
    """
    return scratch.save(df.repartitionByRange(max(1, blocks), *order).withColumn("_b", F.spark_partition_id()))


def prefix_sums(df: DataFrame, scratch: Scratch, order: list[str], value: str, out: str, block_rows: int = 1_000_000) -> DataFrame:
    """Sum of ``value`` over all rows before each row in ``order``, in ranges of about ``block_rows`` rows."""
    saved = scratch.save(df)
    blocks = saved.count() // block_rows + 1
    before = lambda *keys: F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if blocks == 1:
        return saved.withColumn(out, before(F.lit(0)))
    r = range_blocks(saved, scratch, order, blocks)
    carried = r.groupBy("_b").agg(F.sum(value).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))  # a row a block
    return r.withColumn(out, before("_b")).join(carried, "_b").withColumn(out, F.col(out) + F.col("_carry")).drop("_b", "_carry")


def blocks_in_files(df: DataFrame, scratch: Scratch, key: str, blocks: int, build: Callable[[pa.Table], object]) -> list[str]:
    """``build`` of each of ``blocks`` parts of the rows, by a hash of ``key``, pickled to a file in the shared folder.

    The files are made by the tasks that hold the parts; one name a part comes back.
    """
    base = f"{scratch.home}/blocks"

    def run(t: pa.Table) -> pa.Table:
        b = t.column("_block")[0].as_py()
        store, at = file_store(base)
        write_whole(store, f"{at}/{b:06d}", pickle.dumps(build(t)))
        return pa.table({"path": [f"{base}/{b:06d}"]})

    made = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).groupBy("_block").applyInArrow(run, "path string")
    return sorted(r["path"] for r in made.collect())


def read_block(path: str) -> object:
    store, at = file_store(path)
    with store.open_input_stream(at, compression=None) as f:
        return pickle.loads(f.read())
