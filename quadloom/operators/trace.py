"""Operators on ordered call traces: frames, state, filters, summaries, profiles."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.callset import END_FRAME, VERBOSE, CallSet

CHUNK = 1 << 20


def running_count(df: DataFrame, flag: Column, order: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Number of flagged rows strictly before each row of the whole table, by a bigint order column.

    Two-level prefix sum: counts of each ``chunk`` of order values are summed over the chunks (one row
    a chunk), rows are ordered within their chunk only; no task sees the whole table.
    """
    d = df.withColumn("_c", F.floor(F.col(order) / chunk)).withColumn("_f", flag.cast("bigint"))
    per = d.groupBy("_c").agg(F.sum("_f").alias("_n"))
    before = per.select("_c", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return d.join(before, "_c").withColumn(out, F.coalesce(F.sum("_f").over(w), F.lit(0)) + F.col("_before")).drop("_c", "_f", "_before")


def frame_assign(calls: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``frame_id``: a call that ends a frame belongs to that frame."""
    return running_count(calls, F.col("flags").bitwiseAND(END_FRAME) != 0, "call_no", "frame_id", chunk)


def frame_info(framed: DataFrame) -> DataFrame:
    """First and last call, calls and bytes of each complete frame; a trailing part of a frame is left out."""
    ends = F.max(F.when(F.col("flags").bitwiseAND(END_FRAME) != 0, 1).otherwise(0))
    return (
        framed.groupBy("frame_id")
        .agg(F.min("call_no").alias("first_call"), F.max("call_no").alias("last_call"), F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum(F.octet_length("args").cast("bigint")), F.lit(0)).alias("n_bytes"), ends.alias("_e"))
        .filter("_e = 1").drop("_e")
    )


def dump(calls: DataFrame, call_set: CallSet, grep: str | None = None, verbose: bool = False) -> DataFrame:
    """Calls of the set whose name matches, without verbose ones unless asked for."""
    c = call_set.column(F.col("call_no"), F.col("flags"))
    if grep is not None:
        c = c & F.col("name").rlike(grep)
    if not verbose:
        c = c & (F.col("flags").bitwiseAND(VERBOSE) == 0)
    return calls.filter(c)


def trim(framed: DataFrame, call_set: CallSet | None, frame_set: CallSet | None, thread_ids: list[int] | None = None) -> DataFrame:
    """Calls in the call set or in a frame of the frame set, of the given threads; all if neither set is given."""
    if call_set is None and frame_set is None:
        keep = F.lit(True)
    else:
        keep = (call_set.column(F.col("call_no"), F.col("flags")) if call_set else F.lit(False)) | (frame_set.column(F.col("frame_id"), F.lit(0xFFFFFFFF).cast("bigint")) if frame_set else F.lit(False))
    if thread_ids:
        keep = keep & F.col("thread_id").isin(thread_ids)
    return framed.filter(keep)


def forward_fill(df: DataFrame, partition: str, order: str, columns: dict[str, Column]) -> DataFrame:
    """State columns: the last non-null value of each expression up to the row, per partition."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({name: F.last(c, ignorenulls=True).over(w) for name, c in columns.items()})


def bound_texture(df: DataFrame, partition: str, order: str, unit_call: Column, bind_call: Column, units: int = 8) -> DataFrame:
    """Texture a draw sees: unit 0's, else the active unit's, else -1.

    ``unit_call`` is the unit a row activates, ``bind_call`` the texture it binds, null elsewhere; the
    active unit is 0 until set.
    """
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = df.withColumn("active_unit", F.coalesce(F.last(unit_call, ignorenulls=True).over(w), F.lit(0)))
    a = a.withColumns({f"_u{u}": F.last(F.when(F.col("active_unit") == u, bind_call), ignorenulls=True).over(w) for u in range(units)})
    active = F.element_at(F.array(*[F.col(f"_u{u}") for u in range(units)]), (F.col("active_unit") + 1).cast("int"))
    return a.withColumn("texture_id", F.coalesce(F.col("_u0"), active, F.lit(-1))).drop(*[f"_u{u}" for u in range(units)])


def first_outcome(df: DataFrame, group: list[str], order: str, patterns: dict[str, str], text: str) -> DataFrame:
    """First matching outcome of each group: ``outcome`` and the place of its line."""
    c = None
    for name, pattern in patterns.items():
        c = F.when(F.col(text).rlike(pattern), name) if c is None else c.when(F.col(text).rlike(pattern), name)
    return df.withColumn("_o", c).filter("_o is not null").groupBy(*group).agg(F.min_by("_o", order).alias("outcome"), F.min(order).alias("at"))


def frame_spans(profile: DataFrame, partition: list[str], order: str, start: str, end: str, width: int = 65536) -> DataFrame:
    """Spans of consecutive frames: a frame starts where the largest end so far lies.

    The largest end is taken within blocks of ``width`` order values and carried over the blocks, so a
    partition of any size is spread over tasks.
    """
    p = profile.withColumn("_b", F.floor(F.col(order) / width))
    close = p.groupBy(*partition, "_b").agg(F.max(end).alias("_m"))
    carried = close.select(*partition, "_b", F.max("_m").over(Window.partitionBy(*partition).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    w = Window.partitionBy(*partition, "_b").orderBy(order)
    past = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))  # nulls are passed over
    s = p.join(carried, [*partition, "_b"]).withColumn("_s", F.coalesce(past, F.col(start))).withColumn("_e", F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_carry")))
    return s.withColumn("span_start", F.col("_s")).withColumn("span_duration", F.col("_e") - F.col("_s")).drop("_b", "_carry", "_s", "_e")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Activity sessions closed by ``gap_seconds`` of silence."""
    return df.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), f"{gap_seconds} seconds")).agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("session_window")


def diff_calls(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of two traces side by side by position: ``only_a``, ``only_b`` or ``changed``."""
    x = a.select(key, F.struct(*columns).alias("_a"), F.lit(True).alias("_ina"))
    y = b.select(key, F.struct(*columns).alias("_b"), F.lit(True).alias("_inb"))
    kind = F.when(F.col("_ina").isNull(), "only_b").when(F.col("_inb").isNull(), "only_a").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return x.join(y, key, "full_outer").select(key, kind.alias("kind")).filter("kind is not null")


def logical_lines(text: str) -> Iterator[str]:
    """Physical lines stitched to calls: a line goes on while brackets or a string are open.

    Parts are joined with a backslash and the letter n.  Comments and blank lines pass through alone.
    """
    held: list[str] = []
    depth, quoted = 0, False
    for line in text.splitlines():
        if not held and (not line.strip() or line.lstrip().startswith("//")):
            yield line
            continue
        held.append(line)
        skip = False
        for ch in line:
            if skip:
                skip = False
            elif quoted and ch == "\\":
                skip = True
            elif quoted:
                quoted = ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "({":
                depth += 1
            elif ch in ")}":
                depth -= 1
        if depth <= 0 and not quoted:
            yield "\\n".join(held)
            held, depth = [], 0
    if held:
        yield "\\n".join(held)


def stitch(files: DataFrame, key: str, text: str) -> DataFrame:
    """Logical lines of each file with their order; one file is read by one task, files in parallel."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ks, ns, ls = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, line in enumerate(logical_lines(t or "")):
                    ks.append(k)
                    ns.append(n)
                    ls.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(ks, b.schema.field(0).type), pa.array(ns, pa.int64()), pa.array(ls, pa.string())], names=[key, "line_no", "line"])

    return files.select(key, text).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, line_no bigint, line string")


def object_balance(calls: DataFrame, made: Column, freed: Column, object_id: str) -> DataFrame:
    """Objects made more often than freed."""
    return calls.groupBy(object_id).agg(F.sum(F.when(made, 1).when(freed, -1).otherwise(0)).cast("bigint").alias("n_alive")).filter("n_alive > 0")
