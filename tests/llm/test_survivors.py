import datetime as dt
import math

import numpy as np

from quadloom.llm import survivors

SCHEMA = "comparison_id bigint, pyramid_id bigint, quad_key string, delta_is_higher_resolution boolean, normalized_rmse double, pixel_width int, pixel_height int, source_trust int, compared_at timestamp_ntz, field_name string, _n int"
T0 = dt.datetime(2025, 1, 1)


def rows(seed, n):
    rng = np.random.default_rng(seed)
    maybe = lambda v, p=0.25: None if rng.random() < p else v
    keys = ["0", " 01", "1/2/012.png", "01/012/012.png ", "012", "x", "", None, "04"]
    return [
        (i // 2 if i % 11 == 0 else i, maybe(int(rng.integers(1, 3)), 0.05), "0" if rng.random() < 0.33 else keys[int(rng.integers(len(keys)))], maybe(bool(rng.random() < 0.5)), maybe(float(rng.choice([0.1, 0.5, -1, 2, math.nan]))), maybe(int(rng.choice([256, 0, -3]))), maybe(int(rng.choice([128, 0]))), maybe(int(rng.integers(1, 4))), maybe(T0 + dt.timedelta(hours=int(rng.integers(0, 3)))), "c", 1)
        for i in range(n)
    ]


def brute(data):
    groups = {}
    for r in data:
        k = (r[2] or "").strip().split("/")[-1].removesuffix(".png")
        if r[1] is not None and k.startswith("0") and set(k) <= set("0123"):
            groups.setdefault((r[1], k), []).append(r)
    usable = {"delta_is_higher_resolution": lambda r: r[3] is not None, "normalized_rmse": lambda r: r[4] is not None and 0 <= r[4] <= 1, "pixel_width": lambda r: r[5] is not None and r[5] > 0, "pixel_height": lambda r: r[6] is not None and r[6] > 0}
    out = set()
    for (p, k), g in groups.items():
        for f, ok in usable.items():
            c = [r for r in g if ok(r)]
            if len(g) > 1 and c:
                best = max(c, key=lambda r: (-99 if r[7] is None else r[7], r[8] or dt.datetime(1, 1, 1), r[0]))
                out.add((p, k, f, best[0]))
    return out


def test_best_values_against_brute_force(spark):
    data = rows(1, 300)
    df = spark.createDataFrame(data, SCHEMA)
    got = [tuple(r) for r in survivors.best_comparisons(df).select("pyramid_id", "quad_key", "field_name", "comparison_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)
    one = survivors.merged_comparisons(df).collect()
    assert len({(r.pyramid_id, r.quad_key) for r in one}) == len(one)


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert survivors.best_comparisons(df).count() == 0 and survivors.merged_comparisons(df).count() == 0


def test_the_hot_tile_is_limited_before_the_shuffle(spark):
    plan = survivors.best_comparisons(spark.createDataFrame(rows(2, 50), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
