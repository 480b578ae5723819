"""Connected components with relative positions, by alternating star contractions.

A link ``u, v, di, dj`` says that v lies at u + (di, dj).  Each round hangs every vertex's neighbours
on its smallest neighbour and adds up the offsets, so the rounds are logarithmic in the longest chain.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import Scratch, dealt_join


def placed_components(links: DataFrame, scratch: Scratch | None = None, max_rounds: int | None = None) -> DataFrame:
    """``v, root, di, dj``: every vertex with its component's smallest vertex and its place relative to it.

    Vertices without links don't appear.  Where links of a component disagree, one consistent spanning
    set of them decides; ``inconsistent_links`` names the others.  Rounds go on until nothing changes;
    where ``max_rounds`` is given and too few, it raises.
    """
    s = scratch or Scratch(links.sparkSession, "graph")
    flip = lambda d: d.select(F.col("v").alias("u"), F.col("u").alias("v"), (-F.col("di")).alias("di"), (-F.col("dj")).alias("dj"))
    e = links.filter("u is not null and v is not null and u <> v").select("u", "v", F.col("di").cast("bigint").alias("di"), F.col("dj").cast("bigint").alias("dj"))
    # smaller vertex first; of links that disagree the smallest offset counts
    down = e.filter("u < v").unionByName(flip(e).filter("u < v"))
    cur = s.save(down.groupBy("v", "u").agg(F.min(F.struct("di", "dj")).alias("o")).select("u", "v", "o.di", "o.dj"))

    def star(d: DataFrame, large: bool, n_rows: int) -> DataFrame:
        both = d.unionByName(flip(d)) if large else flip(d)
        low = both.groupBy("u").agg(F.min(F.struct("v", "di", "dj")).alias("m"))
        x = dealt_join(both, low, ["u"], n_rows=n_rows).select("u", "v", "di", "dj", F.when(F.col("m.v") < F.col("u"), F.col("m")).otherwise(F.struct(F.col("u").alias("v"), F.lit(0).cast("bigint").alias("di"), F.lit(0).cast("bigint").alias("dj"))).alias("m"))
        if large:
            x = x.filter("v > u")
        moved = x.filter(F.col("m.v") != F.col("v")).select(F.col("m.v").alias("u"), "v", (F.col("di") - F.col("m.di")).alias("di"), (F.col("dj") - F.col("m.dj")).alias("dj"))
        if not large:
            own = low.filter(F.col("m.v") < F.col("u")).select(F.col("m.v").alias("u"), F.col("u").alias("v"), (-F.col("m.di")).alias("di"), (-F.col("m.dj")).alias("dj"))
            moved = moved.unionByName(own)
        return moved.groupBy("v", "u").agg(F.min(F.struct("di", "dj")).alias("o")).select("u", "v", "o.di", "o.dj")

    last, n = None, cur.count()
    for k in count():
        if k == max_rounds:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
        new = s.save(star(star(cur, True, 2 * n), False, n))
        mark = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        s.drop(cur)
        cur = new
        if last == (mark["n"], mark["h"]):
            break
        last, n = (mark["n"], mark["h"]), mark["n"]
    roots = cur.select(F.col("u").alias("v")).distinct().join(cur.select("v"), "v", "left_anti").select("v", F.col("v").alias("root"), F.lit(0).cast("bigint").alias("di"), F.lit(0).cast("bigint").alias("dj"))
    return cur.select("v", F.col("u").alias("root"), "di", "dj").unionByName(roots)


def inconsistent_links(links: DataFrame, placed: DataFrame) -> DataFrame:
    """Links whose offset contradicts the places of their ends."""
    a = placed.select(F.col("v").alias("u"), F.col("di").alias("ui"), F.col("dj").alias("uj"))
    b = placed.select("v", F.col("di").alias("vi"), F.col("dj").alias("vj"))
    return links.join(a, "u").join(b, "v").filter("vi - ui <> di or vj - uj <> dj").select(*links.columns)
