"""Queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import components, leaks, mojibake, packing, survivors
from quadloom.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.best_comparisons(table(spark, sf_dir, "tile_comparisons")).select("pyramid_id", "quad_key", "field_name", "comparison_id")


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.merged_comparisons(table(spark, sf_dir, "tile_comparisons"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.tile_groups(table(spark, sf_dir, "frame_tiles"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_summary(packing.pack_documents(table(spark, sf_dir, "documents")))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(_leaks(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, sf_dir, "documents"), with_text=False).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_survivors, p5_found, p8_packed, p8_fill, p9_found, p9_report, p10_found, p10_restored)}

_COMPARED = r"""cmp as (select *, regexp_extract(trim(quad_key), '^(?:.*/)?(0[0-3]*)(?:\.[A-Za-z]+)?$', 1) as qk from tile_comparisons),
c as (select * from cmp where qk <> '' and pyramid_id is not null)"""
_USABLE = {
    "delta_is_higher_resolution": "delta_is_higher_resolution is not null",
    "normalized_rmse": "normalized_rmse is not null and not isnan(normalized_rmse) and normalized_rmse between 0 and 1",
    "pixel_width": "pixel_width > 0",
    "pixel_height": "pixel_height > 0",
}
_RANK = "row_number() over (partition by pyramid_id, qk order by source_trust desc nulls last, compared_at desc nulls last, comparison_id desc)"

SQL = {
    "p3_found": f"with {_COMPARED}, multi as (select pyramid_id, qk from c group by all having count(*) > 1), "
    + "r as (" + " union all ".join(f"select pyramid_id, qk, '{f}' as field_name, comparison_id, {_RANK} as rn from c where {ok}" for f, ok in _USABLE.items())
    + ") select pyramid_id, qk as quad_key, field_name, comparison_id from r semi join multi using (pyramid_id, qk) where rn = 1",
    "p3_survivors": f"with {_COMPARED}, n as (select pyramid_id, qk, count(*)::bigint as n_rows from c group by all)"
    + "".join(f", f{i} as (select pyramid_id, qk, {f} from (select *, {_RANK} as rn from c where {ok}) where rn = 1)" for i, (f, ok) in enumerate(_USABLE.items()))
    + " select pyramid_id, qk as quad_key, n_rows, " + ", ".join(_USABLE) + " from n" + "".join(f" left join f{i} using (pyramid_id, qk)" for i in range(len(_USABLE))),
    "p5_found": r"""with recursive t as (select session_id, content_id, south_neighbor, east_neighbor,
        regexp_extract(trim(content_id), '^([0-9]+)_([0-9]+)$', 1)::bigint * 1000000000 + regexp_extract(trim(content_id), '^([0-9]+)_([0-9]+)$', 2)::bigint as id from frame_tiles),
      l as (select distinct session_id, id, unnest([south_neighbor, east_neighbor]) as r from t),
      e0 as (select session_id, id as a, split_part(trim(r), '_', 1)::bigint * 1000000000 + split_part(trim(r), '_', 2)::bigint as b from l where regexp_full_match(trim(r), '[0-9]+_[0-9]+')),
      e1 as (select distinct session_id, a, b from e0 where exists (select 1 from t where t.session_id = e0.session_id and t.id = e0.b) and a <> b),
      e as (select session_id, a, b from e1 union select session_id, b, a from e1),
      reach(session_id, a, b) as (select distinct session_id, a, a from e union select r.session_id, r.a, e.b from reach r join e on e.session_id = r.session_id and e.a = r.b),
      g as (select session_id, a, min(b) as m from reach group by all)
      select session_id, printf('%05d_%d', a // 1000000000, a % 1000000000) as content_id, printf('%05d_%d', m // 1000000000, m % 1000000000) as group_content_id from g""",
}
