"""References to records that do not exist, from signed counts of change deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.ids import packed_id, reference_or_none, strip
from quadloom.runtime import HOT_ROWS, MOST_HOT_KEYS, Scratch, dealt_join

KEY = ["session_id", "packed", "other_id"]
REF_FIELDS = {"frame_tiles": ("row_id", ["west_neighbor", "north_neighbor"]), "tile_uncles": ("uncle_row_id", ["uncle_content_id"])}

CODES = {(t, f): i for i, (t, f) in enumerate((t, f) for t, (_, fs) in REF_FIELDS.items() for f in fs)}


def _key(c):
    p = packed_id(c)
    return [F.col("session_id"), p.alias("packed"), F.when(p.isNull(), strip(c)).alias("other_id")]


def existence_deltas(tiles: DataFrame) -> DataFrame:
    """+1 when a tile record arrives, -1 when it is removed.

    A record removed before or as it arrived never exists and gives no delta, nor does one without
    session, id or arrival.
    """
    alive = tiles.filter(
        F.col("session_id").isNotNull() & F.col("content_id").isNotNull() & F.col("arrived_at").isNotNull()
        & (F.col("removed_at").isNull() | (F.col("removed_at") > F.col("arrived_at")))
    )
    return (
        alive.select(*_key(F.col("content_id")), "arrived_at", "removed_at")
        .select(*KEY, F.explode(F.array(F.struct(F.col("arrived_at").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("removed_at").alias("at"), F.lit(-1).alias("delta")))).alias("e"))
        .select(*KEY, "e.at", "e.delta")
        .filter("at is not null")
    )


def reference_events(df: DataFrame, ref_table: str, id_col: str, fields: list[str]) -> DataFrame:
    """One row per reference other than none: key, time, table code, field code and row id."""
    items = [F.struct(F.lit(f).alias("field_name"), reference_or_none(F.col(f)).alias("ref")) for f in fields]
    exploded = df.select("session_id", "arrived_at", F.col(id_col).alias("ref_id"), F.explode(F.array(*items)).alias("i")).filter("i.ref is not null")
    return exploded.select(*_key(F.col("i.ref")), F.col("arrived_at").alias("at"), F.lit(ref_table).alias("ref_table"), "ref_id", F.col("i.field_name").alias("field_name"))


def change_events(tiles: DataFrame, uncles: DataFrame) -> DataFrame:
    """All changes of keys: ``delta`` for existence, and references with their ``ref_id`` and ``code``."""
    deltas = existence_deltas(tiles).select(*KEY, "at", F.col("delta").cast("int").alias("delta"), F.lit(None).cast("bigint").alias("ref_id"), F.lit(-1).cast("byte").alias("code"))
    out = deltas
    for t, df in (("frame_tiles", tiles), ("tile_uncles", uncles)):
        id_col, fields = REF_FIELDS[t]
        code = F.create_map(*[x for f in fields for x in (F.lit(f), F.lit(CODES[t, f]))])
        out = out.unionByName(reference_events(df, t, id_col, fields).select(*KEY, "at", F.lit(0).alias("delta"), "ref_id", code[F.col("field_name")].cast("byte").alias("code")))
    return out


def _counted_hot(events: DataFrame, scratch: Scratch, hot_rows: int) -> DataFrame:
    """Events of keys with very many rows, with their counts; no window sees more than distinct times of a day.

    All events of a key at one instant get the same counts, so those are sums over (key, instant),
    combined before the shuffle, ordered within (key, day) and carried over days.
    """
    e = scratch.save(events)
    day = F.date_diff(F.col("at"), F.lit("1970-01-01").cast("date"))
    null_safe = [F.coalesce("packed", F.lit(-1)).alias("packed"), F.coalesce("other_id", F.lit("")).alias("other_id"), "session_id"]
    k = ["session_id", "packed", "other_id"]
    net = e.filter("at is not null and session_id is not null").select(*null_safe, "at", "delta", "code").groupBy(*k, "at").agg(F.sum("delta").alias("d"), F.count_if(F.col("code") >= 0).alias("r")).withColumn("_day", day)
    net = scratch.save(net)
    days = net.groupBy(*k, "_day").agg(F.sum("d").alias("d"), F.sum("r").alias("r"))
    past = Window.partitionBy(*k).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    opened = days.select(*k, "_day", F.coalesce(F.sum("d").over(past), F.lit(0)).alias("_d"), F.coalesce(F.sum("r").over(past), F.lit(0)).alias("_r"))
    upto = Window.partitionBy(*k, "_day").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = net.withColumn("d", F.sum("d").over(upto)).withColumn("r", F.sum("r").over(upto)).join(opened, [*k, "_day"]).select(*k, "at", (F.col("d") + F.col("_d")).alias("alive"), (F.col("r") + F.col("_r")).alias("referred"))
    refs = e.filter("code >= 0").select(*null_safe, "at", "ref_id", "code")
    return dealt_join(refs, counts, [*k, "at"], "left", hot_rows).select("session_id", "at", "ref_id", "code", "alive", "referred")


def find_orphans(tiles: DataFrame, uncles: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """References without a living tile at the time the referring row arrived.

    Output: ``ref_table, ref_id, field_name, at`` (the arrival), ``n_references``.  For every key the
    signed existence count and the reference count at time t are the sums of its deltas up to t; a
    reference (so the count of references is positive) is an orphan where the existence count is not.
    Keys with more than ``hot_rows`` events, of which there are few, go another way: counts for each
    distinct instant are combined before the shuffle, so neither a key with a third of all rows nor one
    with all of them on one day or at one instant is one task's work.  A null session or arrival time
    matches no tile: such a reference is an orphan.
    """
    events = change_events(tiles, uncles)
    rows = 4 * tiles.count() + uncles.count()  # at most so many events
    hot = None
    if rows > hot_rows:
        bound = max(hot_rows, rows // MOST_HOT_KEYS)
        events = events.withColumn("_h", F.xxhash64(*KEY))
        hot = [r["_h"] for r in events.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound).select("_h").collect()]  # below MOST_HOT_KEYS
    running = Window.partitionBy(*KEY).orderBy(F.col("at").asc_nulls_first(), F.col("code") >= 0).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cold = events.filter(~F.col("_h").isin(hot)) if hot else events
    counted = cold.withColumn("alive", F.sum("delta").over(running)).withColumn("referred", F.count_if(F.col("code") >= 0).over(running)).filter("code >= 0").select("session_id", "at", "ref_id", "code", "alive", "referred")
    if hot:
        counted = counted.unionByName(_counted_hot(events.filter(F.col("_h").isin(hot)).drop("_h"), Scratch(tiles.sparkSession, "orphans"), hot_rows))
    orphan = counted.filter((F.col("alive") <= 0) | F.col("session_id").isNull() | F.col("at").isNull())
    names = F.create_map(*[x for (t, f), i in CODES.items() for x in (F.lit(i), F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")))])
    n = names[F.col("code").cast("int")]
    return orphan.select(n["t"].alias("ref_table"), "ref_id", n["f"].alias("field_name"), "at", F.coalesce("referred", F.lit(1)).alias("n_references"))


def orphans_by_day(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, field and day of arrival."""
    return orphans.groupBy("ref_table", "field_name", F.to_date("at").cast("string").alias("arrival_day")).agg(F.count(F.lit(1)).alias("n_orphans"))


def key_deltas(tiles: DataFrame, uncles: DataFrame) -> DataFrame:
    """Signed counts of the given rows: ``KEY, n_existing, n_references``, combined before the shuffle.

    References of rows that were removed are withdrawn.
    """
    exist = existence_deltas(tiles).select(*KEY, F.col("delta").alias("exist"), F.lit(0).alias("refs"))
    here = F.when(F.col("removed_at").isNull(), 1).otherwise(0)
    items = [reference_or_none(F.col(f)) for f in REF_FIELDS["frame_tiles"][1]]
    a = tiles.select("session_id", here.alias("refs"), F.explode(F.array(*items)).alias("ref")).filter("ref is not null").select(*_key(F.col("ref")), F.lit(0).alias("exist"), "refs")
    b = uncles.select("session_id", reference_or_none(F.col("uncle_content_id")).alias("ref")).filter("ref is not null").select(*_key(F.col("ref")), F.lit(0).alias("exist"), F.lit(1).alias("refs"))
    return exist.unionByName(a).unionByName(b).groupBy(*KEY).agg(F.sum("exist").cast("bigint").alias("n_existing"), F.sum("refs").cast("bigint").alias("n_references"))


def removals(tiles: DataFrame) -> DataFrame:
    """Signed counts for rows counted before that are removed now: what ``key_deltas`` counted for them, withdrawn.

    ``tiles`` are the rows as they were counted, without ``removed_at``.
    """
    d = key_deltas(tiles.withColumn("removed_at", F.lit(None).cast("timestamp_ntz")), tiles.sparkSession.createDataFrame([], "session_id bigint, uncle_content_id string"))
    return d.select(*KEY, (-F.col("n_existing")).alias("n_existing"), (-F.col("n_references")).alias("n_references"))


def update_counts(counts: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Stored counts with the signed counts of new changes added; keys without any count go."""
    u = counts
    for d in deltas:
        u = u.unionByName(d)
    g = u.groupBy(*KEY).agg(F.sum("n_existing").alias("n_existing"), F.sum("n_references").alias("n_references"))
    return g.filter("n_existing <> 0 or n_references <> 0")


def orphan_keys(counts: DataFrame) -> DataFrame:
    """Keys with positive references and no existence: the current orphan report."""
    return counts.filter("n_references > 0 and n_existing <= 0")


def current_orphan_keys(tiles: DataFrame, uncles: DataFrame) -> DataFrame:
    """Keys referred to now (references of removed rows are withdrawn) that no living tile carries."""
    return orphan_keys(key_deltas(tiles, uncles))
