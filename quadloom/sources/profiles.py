"""Profile listings: one line a profiled call, with times, memory and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the fields of a line, after the word that begins it
FIELDS = ["no", "gpu_start", "gpu_dur", "cpu_start", "cpu_dur", "vsize_start", "vsize_dur", "rss_start", "rss_dur", "pixels", "program"]


def parse_profile(lines: DataFrame, line: str = "line") -> DataFrame:
    """``FIELDS`` as bigints and ``name`` of every line that begins with ``call``.

    Other lines, and lines with fewer fields, are left out; a field that is no number is null.
    """
    p = F.split(F.trim(line), r"\s+")
    rows = lines.filter(p[0] == "call").filter(F.size(p) >= len(FIELDS) + 2)
    return rows.select(*[F.get(p, F.lit(k + 1)).try_cast("bigint").alias(f) for k, f in enumerate(FIELDS)], F.get(p, F.lit(len(FIELDS) + 1)).alias("name"))
