"""Assertions between pipeline stages: each gate returns its violations, so an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for every rule a row breaks; a rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def size_band(n: Column, accept: int = 1000, reject: int = 200) -> Column:
    """accept above ``accept``, reject below ``reject``, review between."""
    return F.when(n > accept, "accept").when(n < reject, "reject").otherwise("review")


def completeness(df: DataFrame, group: list[str], done: Column) -> DataFrame:
    return df.groupBy(*group).agg(F.count_if(done).alias("n_done"), F.count(F.lit(1)).alias("n_all")).withColumn("complete", F.col("n_done") == F.col("n_all"))


def space_needed(trace_bytes: int, split_bytes: int) -> tuple[int, int]:
    """Free bytes to ask for before dumping and before splitting a trace."""
    return 4 * trace_bytes + (1 << 30), split_bytes + (64 << 20)
