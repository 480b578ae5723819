"""Image and identity matching: vector errors, best-two search, votes, hashes and as-of lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.runtime import Scratch, blocks_in_files, read_block, ship_package, two_level_rank

RMSE_MAX, RATIO_MAX = 35.0, 0.75  # fixed values: an accepted match, and best against second best


def rmse(a: Column, b: Column) -> Column:
    """Root mean square difference of two arrays of equal length; null for empty or unequal ones."""
    sq = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.sqrt(sq / F.size(a)))


def spaced_sample(df: DataFrame, group: str, order: str, n: int = 16) -> DataFrame:
    """Up to ``n`` evenly spaced rows of each group: positions ``i * (size - 1) / (n - 1)``."""
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    d = two_level_rank(df, [group], order, "_p").join(size, group).withColumn("_p", F.col("_p") - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (n - 1)))
    return d.filter((F.col("_n") <= n) | F.array_contains(wanted, F.col("_p").cast("bigint"))).drop("_p", "_n")


def _nearest(ids: np.ndarray, mat: np.ndarray, own: np.ndarray, rid: np.ndarray, rows: np.ndarray, groups: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The ``k`` rows nearest to each query, ties by id: squared errors by one product, the few best exactly."""
    near = (rows * rows).sum(1)[None, :] + (mat * mat).sum(1)[:, None] - 2 * mat @ rows.T
    slack = 1e-9 * (1 + np.abs(near).max(initial=0))
    near[ids[:, None] == rid[None, :]] = np.inf
    near[(own[:, None] == groups[None, :]) & (own != "")[:, None]] = np.inf
    out = []
    kth = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
    for q in range(len(ids)):
        at = np.flatnonzero((near[q] <= kth[q] + slack) & np.isfinite(near[q]))
        e = np.sqrt(((rows[at] - mat[q]) ** 2).sum(1) / mat.shape[1])
        for j in np.lexsort((rid[at], e))[:k]:
            out.append((int(ids[q]), int(rid[at[j]]), float(e[j])))
    return out


def nearest_vectors(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 2, block: int = 4096, group: str | None = None) -> DataFrame:
    """For every query row the ``k`` rows with the smallest error, itself and rows of its ``group`` left out.

    The queries are a stated set.  Up to ``block`` of them go with the tasks; more are read by them
    from the shared folder, block by block, so the rows are read once.  Each task keeps its best ``k`` a
    query and batch, so the shuffle carries those, never all pairs.  Null vectors, and those of another
    length than the queries', are no partners.
    """
    ship_package(rows.sparkSession)
    name = lambda g: F.coalesce((F.col(g) if g else F.lit(None)).cast("string"), F.lit(""))
    q = queries.select(F.col(key).cast("bigint").alias("q"), F.col(vector).alias("v"), name(group).alias("g")).filter("q is not null and v is not null")
    n = q.count()
    schema = "query_id bigint, vec_id bigint, rmse double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")

    def build(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(t.column("q").to_pylist()), np.array(t.column("v").to_pylist(), float), np.array(t.column("g").to_pylist(), object)

    one = build(pa.Table.from_pylist([r.asDict() for r in q.collect()])) if n <= block else None  # bounded by block
    paths = [] if one else blocks_in_files(q, Scratch(rows.sparkSession, "queries"), "q", -(-n // block), build)

    def run(batches):
        for b in batches:
            vs = b.column(1).to_pylist()
            best: list[tuple[int, int, float]] = []
            for ids, mat, own in [one] if one else map(read_block, paths):
                keep = [i for i, x in enumerate(vs) if x is not None and len(x) == mat.shape[1]]
                if keep:
                    take = pa.array(keep)
                    best += _nearest(ids, mat, own, np.array(b.column(0).take(take).to_pylist()), np.array([vs[i] for i in keep], float), np.array(b.column(2).take(take).to_pylist(), object), k)
            cols = list(zip(*best)) if best else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "rmse"])

    hits = rows.select(F.col(key).cast("bigint").alias(key), vector, name(group).alias("_g")).filter(F.col(key).isNotNull()).mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy("rmse", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_two(pairs: DataFrame, key: str, error: str, tie: str) -> DataFrame:
    """The two smallest errors of each key with their rank; partial ranking happens before the shuffle."""
    w = Window.partitionBy(key).orderBy(error, tie)
    return pairs.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")


def confident(best: DataFrame, key: str, error: str, candidate: str, limit: float = RMSE_MAX, ratio: float = RATIO_MAX) -> DataFrame:
    """Best candidates whose error is small, and small against the second best."""
    g = best.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col(candidate))).alias(candidate), F.max(F.when(F.col("rank") == 1, F.col(error))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col(error))).alias("second"))
    return g.filter((F.col("best") <= limit) & (F.col("second").isNull() | (F.col("best") / F.greatest(F.col("second"), F.lit(1e-9)) <= ratio)))


def majority(votes: DataFrame, group: list[str], value: list[str], order: str, least: int = 3) -> DataFrame:
    """Strict majority: the value with the most votes if it has ``least`` and more than half; first wins ties."""
    n = votes.groupBy(*group, *value).agg(F.count(F.lit(1)).alias("n_votes"), F.min(order).alias("_first"))
    total = n.groupBy(*group).agg(F.sum("n_votes").alias("n_all"), F.max_by(F.struct(*value), F.struct("n_votes", (-F.col("_first")).alias("f"))).alias("v"), F.max("n_votes").alias("n_votes"))
    return total.filter((F.col("n_votes") >= least) & (2 * F.col("n_votes") > F.col("n_all"))).select(*group, *[F.col(f"v.{c}").alias(c) for c in value], "n_votes", "n_all")


def tiered_vote(votes: DataFrame, key: str, tier: str, row: str, col: str, order: str) -> DataFrame:
    """``key, row_offset, col_offset, joint`` by the votes of each key's best tier.

    The pair with a strict majority, the first seen among equals; without one each part by itself, by
    number of votes and then the smaller value.
    """
    t = votes.join(votes.groupBy(key).agg(F.min(tier).alias(tier)), [key, tier])
    n = t.groupBy(key, row, col).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f"))
    joint = n.groupBy(key).agg(F.max_by(F.struct(F.col(row).alias("r"), F.col(col).alias("c")), F.struct("n", (-F.col("f")).alias("f"))).alias("rc"), F.max("n").alias("n"), F.sum("n").alias("a"))
    own = lambda c, out: n.groupBy(key, c).agg(F.sum("n").alias("n")).groupBy(key).agg(F.max_by(c, F.struct("n", (-F.col(c)).alias("o"))).alias(out))
    j = joint.join(own(row, "pr"), key).join(own(col, "pc"), key).withColumn("joint", 2 * F.col("n") > F.col("a"))
    return j.select(key, F.when(F.col("joint"), F.col("rc.r")).otherwise(F.col("pr")).alias("row_offset"), F.when(F.col("joint"), F.col("rc.c")).otherwise(F.col("pc")).alias("col_offset"), "joint")


def asof_path(queries: DataFrame, textures: DataFrame, key: str, at: str, version: str, path: str, width: int = 4096) -> DataFrame:
    """Path of a texture as of a frame: the exact or latest version up to it, else the earliest.

    Versions and queries are put in one order and the last version is carried forward, in blocks of
    ``width`` frames whose closing versions are carried over; work stays in proportion to rows even
    where one texture has a third of them.  Queries of unknown textures get null.
    """
    block = F.floor(F.col("_at") / width)
    t = textures.select(key, F.col(version).alias("_at"), F.lit(0).alias("_q"), F.col(path).alias("_p")).filter(F.col("_at").isNotNull())
    q = queries.select(key, F.col(at).alias("_at"), F.lit(1).alias("_q"), F.lit(None).cast(dict(textures.dtypes)[path]).alias("_p"))
    e = t.unionByName(q).withColumn("_b", block)
    close = t.withColumn("_b", block).groupBy(key, "_b").agg(F.max_by("_p", "_at").alias("_last"))
    seen = e.select(key, "_b").distinct().join(close, [key, "_b"], "left")
    carry = seen.select(key, "_b", F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    w = Window.partitionBy(key, "_b").orderBy("_at", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = e.withColumn("_in", F.last("_p", ignorenulls=True).over(w)).filter("_q = 1")
    first = textures.groupBy(key).agg(F.min_by(path, version).alias("_first"))
    return run.join(carry, [key, "_b"], "left").join(first, key, "left").select(key, F.col("_at").alias(at), F.coalesce("_in", "_carry", "_first").alias(path))


def duplicate_groups(df: DataFrame, content: str, item: str) -> DataFrame:
    """Content digests held by more than one item, with the items' number and the smallest one."""
    return df.groupBy(F.sha2(content, 256).alias("digest")).agg(F.countDistinct(item).alias("n_items"), F.min(item).alias("first_item")).filter("n_items > 1")


def canonical_items(df: DataFrame, content: str, item: str) -> DataFrame:
    """Every item with the smallest item of equal content."""
    h = df.select(item, F.sha2(content, 256).alias("digest"))
    return h.join(h.groupBy("digest").agg(F.min(item).alias("canonical")), "digest").select(item, "canonical")
