"""Continuous operators: file arrival, inactivity sessions, stop counters, outcomes and growth alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_events(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the rows of files as they appear below a folder, with the file's time."""
    r = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def inactivity_sessions(events: DataFrame, key: str, ts: str, gap: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Sessions that close after ``gap`` of silence; each later event moves the end on."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return e.groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("closes_at"), "n_events")


def stop_after(events: DataFrame, key: str, limit: int) -> DataFrame:
    """Numbers each key's events and marks the one at which it stops; later ones give nothing."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        new = min(sum(map(len, batches)), limit - seen)
        n = pd.Series(range(seen + 1, seen + new + 1), dtype="int32")
        state.update((seen + new,))
        yield pd.DataFrame({"key": pd.Series([k[0]] * new), "n": n, "stopped": n == limit})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"key {kind}, n int, stopped boolean", "seen int", "append", GroupStateTimeout.NoTimeout)


def outcomes(lines: DataFrame, group: str, ts: str, text: str, patterns: dict[str, str], lateness: str = "1 minute") -> DataFrame:
    """Each outcome of a log reported once, however often its line or an overlap of it arrives."""
    c = None
    for name, pattern in patterns.items():
        c = F.when(F.col(text).rlike(pattern), name) if c is None else c.when(F.col(text).rlike(pattern), name)
    x = lines.withColumn("outcome", c).filter("outcome is not null").withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return x.dropDuplicatesWithinWatermark([group, "outcome"]).select(group, "outcome", ts)


def growth_alerts(samples: DataFrame, ts: str, used: str, budget: float, window: str = "1 minute", lateness: str = "1 minute") -> DataFrame:
    """Per window: largest use, growth inside it, and whether 80 % of the budget is passed or nothing moves."""
    x = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    g = x.groupBy(F.window(ts, window)).agg(F.max(used).alias("high"), F.min(used).alias("low"))
    return g.select(F.col("window.start").alias("at"), "high", (F.col("high") - F.col("low")).alias("growth"), F.when(F.col("high") >= 0.8 * budget, "budget").when(F.col("high") == F.col("low"), "no progress").otherwise("ok").alias("alert"))
