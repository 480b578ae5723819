"""Queries over whole tables for the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators import compaction, drift, hierarchy, orphans, shred
from quadloom.runtime import Scratch, table


# 1 - far too many small files
def _stored(spark: SparkSession, sf_dir: str, target_bytes: int = compaction.TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    files = table(spark, sf_dir, "tile_files")
    return files, compaction.compact_files(files, target_bytes, f"{Scratch(spark, 'containers').base}/files")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.repeated_files(*_stored(spark, sf_dir))


def p1_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = compaction.manifest(_stored(spark, sf_dir)[1])
    return m.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.count_if(F.col("verified")).alias("n_verified"))


def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 256 KB: how many there are, and how many hold less than that."""
    c = compaction.compact_files(table(spark, sf_dir, "tile_files"), 1 << 18)
    held = c.select(F.aggregate("members", F.lit(0).cast("bigint"), lambda a, m: a + m["n_bytes"]).alias("n"))
    return held.agg(F.count(F.lit(1)).alias("n_containers"), F.count_if(F.col("n") < (1 << 18) - 65536).alias("n_small"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = compaction.restore(compaction.compact_files(table(spark, sf_dir, "tile_files"), target_bytes=4 << 20))
    return r.select("file_id", F.sha2("content", 256).alias("digest"))


def p1_text_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw layer files as newline-delimited text in few files."""
    t = table(spark, sf_dir, "layer_files").select(F.col("layer_file_id").alias("file_id"), F.encode("body", "utf-8").alias("content"))
    c = compaction.compact_text(t, False, uri=f"{Scratch(spark, 'text').base}/files")
    return c.agg(F.sum("n_members").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"), F.min("verified").alias("verified"))


def p1_length_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.length_mismatches(table(spark, sf_dir, "tile_files"))


# 2 - references to records that do not exist
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.find_orphans(table(spark, sf_dir, "frame_tiles"), table(spark, sf_dir, "tile_uncles"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_id", "field_name")


def p2_orphans_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans_by_day(_orphans(spark, sf_dir))


def _content_keys(k: DataFrame) -> DataFrame:
    frame, tile = F.shiftright("packed", 31), F.col("packed").bitwiseAND((1 << 31) - 1)
    return k.select("session_id", F.coalesce(F.concat_ws("_", frame, tile), "other_id").alias("content_key"), "n_existing", "n_references")


def p2_current_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content_keys(orphans.current_orphan_keys(table(spark, sf_dir, "frame_tiles"), table(spark, sf_dir, "tile_uncles")))


def p2_maintained_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report from stored counts: rows of even days first, then those of odd days, then the removals."""
    tiles, uncles = table(spark, sf_dir, "frame_tiles"), table(spark, sf_dir, "tile_uncles")
    early = F.coalesce(F.dayofmonth("arrived_at") % 2 == 0, F.lit(True))
    seen = tiles.withColumn("removed_at", F.when(F.col("removed_at") <= F.col("arrived_at"), F.col("removed_at")))  # as they arrive
    scratch = Scratch(spark, "counts")
    counts = scratch.save(orphans.key_deltas(seen.filter(early), uncles.filter(early)))
    counts = scratch.save(orphans.update_counts(counts, orphans.key_deltas(seen.filter(~early), uncles.filter(~early))))
    gone = tiles.filter("removed_at > arrived_at or (removed_at is not null and arrived_at is null)")
    return _content_keys(orphans.orphan_keys(orphans.update_counts(counts, orphans.removals(gone))))


# 4 - full hierarchies
def _layer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.nested_sets(hierarchy.layer_nodes(table(spark, sf_dir, "matrix_layers")), prefix=False)


def _tile_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.nested_sets(hierarchy.tile_nodes(table(spark, sf_dir, "pyramid_tiles")), prefix=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["group_id", "node_key", "root_key", "node_depth"]
    a = _layer_sets(spark, sf_dir).select(F.lit("matrix_layers").alias("node_table"), *cols)
    return a.unionByName(_tile_sets(spark, sf_dir).select(F.lit("pyramid_tiles").alias("node_table"), *cols))


def p4_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["group_id", "node_key", "subtree_size"]
    a = _layer_sets(spark, sf_dir).select(F.lit("matrix_layers").alias("node_table"), *cols)
    return a.unionByName(_tile_sets(spark, sf_dir).select(F.lit("pyramid_tiles").alias("node_table"), *cols))


def p4_descendants_of_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _tile_sets(spark, sf_dir)
    return hierarchy.descendants(s, s.filter("node_depth = 0"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _layer_sets(spark, sf_dir).withColumn("node_table", F.lit("matrix_layers"))
    return hierarchy.paths(a.unionByName(_tile_sets(spark, sf_dir).withColumn("node_table", F.lit("pyramid_tiles"))), ("node_table", "group_id"))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("node_table", "group_id", "node_key", F.array_join("node_path", "/").alias("node_path"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.all_descendants(_paths(spark, sf_dir), ("node_table", "group_id"))


# 6 - drifting schemas
def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.file_schemas(table(spark, sf_dir, "layer_files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(_schemas(spark, sf_dir)).select("producer_id", "export_no", "field_name", "change_kind")


def p6_union_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.union_schema(_schemas(spark, sf_dir))


def p6_unified_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = drift.read_unified(table(spark, sf_dir, "layer_files"))
    fields = [c for c in u.columns if c not in ("producer_id", "export_no", "layer_file_id")]
    if not fields:
        return spark.createDataFrame([], "field_name string, n_values bigint")
    one = u.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in fields])
    return one.select(F.explode(F.create_map(*[x for c in fields for x in (F.lit(c), F.col(f"`{c}`"))])).alias("field_name", "n_values"))


# 7 - nested records
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred.bridges(shred.shred(table(spark, sf_dir, "frame_json"), with_body=False))
    return nodes.filter("child_kind in ('vertex', 'uncle', 'matrix')").select("frame_key", "tile_no", "child_kind", "child_no")


def p7_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = shred.objects(shred.shred(table(spark, sf_dir, "frame_json")))
    return o.groupBy("object_kind").agg(F.count(F.lit(1)).alias("n_objects"), F.sum("n_occurrences").alias("n_occurrences"))


def p7_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred.bridges(shred.shred(table(spark, sf_dir, "frame_json"), with_body=False))
    return nodes.groupBy(F.col("child_kind").alias("object_kind")).agg(F.count(F.lit(1)).alias("n_occurrences"))


def p7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames put together again from the stored objects, against their source."""
    frames = table(spark, sf_dir, "frame_json")
    nodes = Scratch(spark, "nodes").save(shred.shred(frames))
    back = shred.rebuild(shred.bridges(nodes), shred.objects(nodes)).withColumnRenamed("body", "back")
    return shred.canonical(frames).join(back, "frame_key", "full_outer").select("frame_key", F.col("body").eqNullSafe(F.col("back")).alias("same"))


QUERIES = {f.__name__: f for f in (p1_found, p1_containers, p1_sizes, p1_restored, p1_text_joined, p1_length_mismatches, p2_found, p2_orphans_by_day, p2_current_keys, p2_maintained_keys, p4_found, p4_subtrees, p4_descendants_of_roots, p4_paths, p4_descendants, p6_found, p6_union_schema, p6_unified_counts, p7_found, p7_objects, p7_occurrences, p7_rebuilt)}

_FILES = r"""files as (
  select file_id, content,
    case when image_path is not null
      then 'P|' || regexp_extract(image_path, '/(p[0-9]+)/', 1) || '|' || regexp_extract(image_path, '/(0[0-3]*)\.[A-Za-z]+$', 1)
      else 'T|' || regexp_extract(texture_file, '/(e[0-9]+)/', 1) || '|' || regexp_extract(texture_file, '/(matrix_[0-9]+)/', 1) || '|'
        || printf('%05d_%d', regexp_extract(texture_file, '/([0-9]+)_[0-9]+\.[A-Za-z]+$', 1)::bigint, regexp_extract(texture_file, '/[0-9]+_([0-9]+)\.[A-Za-z]+$', 1)::bigint)
    end as tile_key
  from tile_files),
ranked as (select *, row_number() over (partition by tile_key, content order by file_id) as rn from files)"""

_ID = r"""case when regexp_full_match(trim({c}), '[0-9]+_[0-9]+')
  then split_part(trim({c}), '_', 1)::bigint::varchar || '_' || split_part(trim({c}), '_', 2)::bigint::varchar else trim({c}) end"""


def _id(c: str) -> str:
    return _ID.format(c=c)


_REFS = f"""tiles as (select session_id, {_id("content_id")} as cid, arrived_at, removed_at from frame_tiles),
raw as (
  select 'frame_tiles' as ref_table, row_id as ref_id, 'west_neighbor' as field_name, session_id, west_neighbor as v, arrived_at, removed_at from frame_tiles
  union all select 'frame_tiles', row_id, 'north_neighbor', session_id, north_neighbor, arrived_at, removed_at from frame_tiles
  union all select 'tile_uncles', uncle_row_id, 'uncle_content_id', session_id, uncle_content_id, arrived_at, null from tile_uncles),
refs as (select ref_table, ref_id, field_name, session_id, {_id("v")} as cid, arrived_at, removed_at from raw
  where v is not null and trim(v) <> '' and lower(trim(v)) <> 'null'),
lost as (select * from refs r where not exists (
  select 1 from tiles t where t.session_id = r.session_id and t.cid = r.cid and t.arrived_at <= r.arrived_at
    and (t.removed_at is null or t.removed_at > r.arrived_at)))"""

_LAYERS = """layers as (select export_id as g, matrix_index as k, min(parent_matrix_index) as p from matrix_layers group by 1, 2),
linked as (select a.g, a.k, b.k as p from layers a left join layers b on a.g = b.g and a.p = b.k),
walk(g, k, root, d) as (select g, k, k, 0 from linked where p is null
  union all select c.g, c.k, w.root, w.d + 1 from linked c join walk w on c.g = w.g and c.p = w.k)"""

_QTILES = """qt as (select distinct pyramid_id as g, quad_key as k from pyramid_tiles where regexp_full_match(quad_key, '0[0-3]*')),
pre as (select g, k, unnest(range(1, length(k) + 1)) as n from qt),
anc as (select pre.g, pre.k, q.k as a from pre join qt q on q.g = pre.g and q.k = left(pre.k, pre.n))"""

_FIELDS = """good as (select distinct producer_id, export_no::bigint as export_no, layer_file_id, body from layer_files where json_valid(body)),
objs as (select * from good where json_type(body) = 'OBJECT'),
flds as (select producer_id, export_no, layer_file_id, unnest(json_keys(body)) as f, body from objs),
typed as (select producer_id, export_no, layer_file_id, f, case json_type(json_extract(body, '$."' || f || '"'))
  when 'NULL' then 0 when 'VARCHAR' then 2 when 'BOOLEAN' then 4 when 'OBJECT' then 8 when 'ARRAY' then 16 else 1 end as bit from flds)"""

_SHAPES = """frames as (select distinct on (frame_key) frame_key, body from frame_json where json_valid(body) order by frame_key, body),
base as (select frame_key, case when json_exists(body, '$.frame') then json_extract(body, '$.frame') else body::json end as f from frames),
lists as (select frame_key, 0 as pno, json_extract(f, '$.tiles') as l from base where json_type(f, '$.tiles') = 'ARRAY'
  union all select frame_key, i, json_extract(f, '$.patches[' || i || '].tiles')
  from (select frame_key, f, unnest(range(0, json_array_length(f, '$.patches')::bigint)) as i from base where json_type(f, '$.patches') = 'ARRAY')),
flat as (select frame_key, pno, unnest(range(0, json_array_length(l)::bigint)) as i, l from lists),
tl as (select frame_key, row_number() over (partition by frame_key order by pno, i) - 1 as tile_no, json_extract(l, '$[' || i || ']') as t from flat),
f1 as (select frame_key, tile_no, json_extract(t, '$.triangleStrip') as s, json_extract(t, '$.uncles') as u, json_extract(t, '$.modelViewMatrix') as m from tl),
f2 as (select frame_key, tile_no, case when json_type(s) = 'VARCHAR' then (s ->> '$')::json else s end as s, case when json_type(u) = 'VARCHAR' then (u ->> '$')::json else u end as u, m from f1),
f3 as (select frame_key, tile_no, m, case when json_type(s) = 'OBJECT' then json_extract(s, '$.vertices') else s end as v,
  coalesce(json_extract(s, '$.stride')::int, 5) as stride,
  case when json_type(u) = 'OBJECT' then case when json_exists(u, '$.items') then json_extract(u, '$.items') else json_array(u) end else u end as u from f2),
vx as (select frame_key, tile_no, unnest(range(0, json_array_length(v)::bigint)) as i, v, stride from f3 where json_type(v) = 'ARRAY'),
un as (select frame_key, tile_no, unnest(range(0, json_array_length(u)::bigint)) as i, u from f3 where json_type(u) = 'ARRAY'),
hits as (
  select frame_key, tile_no, 'vertex' as child_kind, i as child_no from vx where json_type(v, '$[' || i || ']') in ('OBJECT', 'ARRAY')
  union all select distinct frame_key, tile_no, 'vertex', i // stride from vx where json_type(v, '$[' || i || ']') in ('DOUBLE', 'BIGINT', 'UBIGINT')
  union all select frame_key, tile_no, 'uncle', i from un where json_type(u, '$[' || i || ']') <> 'NULL'
  union all select frame_key, tile_no, 'matrix', 0 from f3 where m is not null and json_type(m) <> 'NULL')"""

SQL = {
    "p1_found": f"with {_FILES} select file_id from ranked where rn > 1",
    "p1_containers": f"with {_FILES} select count(*)::bigint as n_files, sum(octet_length(content))::bigint as n_bytes, count(*)::bigint as n_verified from ranked where rn = 1",
    "p1_text_joined": """with f as (select body from layer_files where layer_file_id is not null and strlen(body) > 0),
      x as (select strlen(body) as n, length(body) - length(replace(body, chr(10), '')) + (not ends_with(body, chr(10)))::int as l, (not ends_with(body, chr(10)))::int as added from f)
      select count(*)::bigint as n_files, sum(l)::bigint as n_lines, sum(n + added)::bigint as n_bytes, true as verified from x""",
    "p1_sizes": f"""with {_FILES}, v as (select octet_length(content) as n, coalesce(sum(octet_length(content)) over (order by tile_key, file_id rows between unbounded preceding and 1 preceding), 0) as b from ranked where rn = 1),
      c as (select b // 262144 as k, sum(n) as n from v group by 1) select count(*)::bigint as n_containers, count(*) filter (n < 196608)::bigint as n_small from c""",
    "p1_restored": f"with {_FILES} select file_id, sha256(content) as digest from ranked where rn = 1",
    "p1_length_mismatches": "select file_id, n_bytes as recorded_bytes, octet_length(content)::int as held_bytes from tile_files where n_bytes <> octet_length(content)",
    "p2_found": f"with {_REFS} select ref_table, ref_id, field_name from lost",
    "p2_orphans_by_day": f"with {_REFS} select ref_table, field_name, arrived_at::date::varchar as arrival_day, count(*)::bigint as n_orphans from lost group by all",
    "p2_current_keys": f"""with {_REFS},
      r as (select session_id, cid, sum(case when removed_at is null then 1 else 0 end)::bigint as n_references from refs group by all),
      e as (select session_id, cid, sum(case when removed_at is null then 1 else 0 end)::bigint as n_existing from tiles group by all)
      select r.session_id, r.cid as content_key, coalesce(e.n_existing, 0)::bigint as n_existing, r.n_references
      from r left join e on e.session_id = r.session_id and e.cid = r.cid where r.n_references > 0 and coalesce(e.n_existing, 0) <= 0""",
    "p4_found": f"""with recursive {_LAYERS}, {_QTILES}
      select 'matrix_layers' as node_table, l.g::bigint as group_id, l.k::varchar as node_key, coalesce(w.root::varchar, 'cycle') as root_key, coalesce(w.d, -1)::bigint as node_depth
      from layers l left join walk w on w.g = l.g and w.k = l.k
      union all select 'pyramid_tiles', g::bigint, k, min_by(a, length(a)), count(*)::bigint - 1 from anc group by g, k""",
    "p4_subtrees": f"""with recursive {_LAYERS},
      ups(g, k, a) as (select g, k, k from linked union all select u.g, u.k, l.p from ups u join linked l on l.g = u.g and l.k = u.a join walk w on w.g = u.g and w.k = u.k where l.p is not null),
      {_QTILES}
      select 'matrix_layers' as node_table, l.g::bigint as group_id, l.k::varchar as node_key, (select count(*) from ups u join walk w on w.g = u.g and w.k = u.k where u.g = l.g and u.a = l.k)::bigint as subtree_size from layers l
      union all select 'pyramid_tiles', g::bigint, a, count(*)::bigint from anc group by g, a""",
    "p4_descendants_of_roots": f"""with {_QTILES}, root as (select g, k, min_by(a, length(a)) as r, count(*) - 1 as d from anc group by g, k)
      select g::bigint as group_id, r as ancestor_key, k as descendant_key, d::bigint as distance from root where d > 0""",
    "p4_paths": f"""with recursive {_LAYERS},
      down(g, k, path) as (select g, k, k::varchar from linked where p is null union all select c.g, c.k, d.path || '/' || c.k from linked c join down d on c.g = d.g and c.p = d.k),
      {_QTILES}
      select 'matrix_layers' as node_table, l.g::bigint as group_id, l.k::varchar as node_key, d.path as node_path from layers l left join down d on d.g = l.g and d.k = l.k
      union all select 'pyramid_tiles', g::bigint, k, string_agg(a, '/' order by length(a)) from anc group by g, k""",
    "p4_descendants": f"""with recursive {_LAYERS},
      ups(g, k, a, d) as (select l.g, l.k, l.k, 0 from linked l join walk w on w.g = l.g and w.k = l.k union all select u.g, u.k, l.p, u.d + 1 from ups u join linked l on l.g = u.g and l.k = u.a where l.p is not null),
      {_QTILES}, far as (select g, k, a, row_number() over (partition by g, k order by length(a) desc) - 1 as d from anc)
      select 'matrix_layers' as node_table, g::bigint as group_id, a::varchar as ancestor_key, k::varchar as descendant_key, d::bigint as distance from ups where d > 0
      union all select 'pyramid_tiles', g::bigint, a, k, d::bigint from far where d > 0""",
    "p6_found": f"""with {_FIELDS},
      per as (select producer_id, export_no, f, bit_or(bit) as types from typed group by all),
      ex as (select producer_id, export_no, lag(export_no) over (partition by producer_id order by export_no) as prev from (select distinct producer_id, export_no from objs)),
      cur as (select e.producer_id, e.export_no, p.f, p.types from ex e join per p using (producer_id, export_no) where e.prev is not null),
      old as (select e.producer_id, e.export_no, p.f, p.types from ex e join per p on p.producer_id = e.producer_id and p.export_no = e.prev)
      select producer_id, export_no, f as field_name, case when old.types is null then 'added' when cur.types is null then 'removed' else 'retyped' end as change_kind
      from cur full join old using (producer_id, export_no, f)
      where old.types is null or cur.types is null or (old.types > 0 and cur.types > 0 and old.types <> cur.types)""",
    "p6_union_schema": """with good as (select body from layer_files where json_valid(body) and json_type(body) = 'OBJECT'),
      flds as (select unnest(json_keys(body)) as f, body from good),
      vals as (select f, json_extract(body, '$."' || f || '"') as v from flds),
      typed as (select f, json_type(v) as jt, v::varchar as v from vals),
      bits as (select f, case jt when 'NULL' then 0 when 'VARCHAR' then 2 when 'BOOLEAN' then 4 when 'OBJECT' then 8 when 'ARRAY' then 16 else 1 end as bit,
        case when jt not in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') then 0 when regexp_matches(v, '[.eE]') then 16 when try_cast(v as hugeint) is null then 8
          when abs(v::hugeint) <= 9007199254740992 then 1 when try_cast(v as bigint) is not null then 2 else 4 end as kind from typed),
      g as (select f, bit_or(bit) as m, bit_or(kind) as k, count(*)::bigint as n_files from bits group by f)
      select f as field_name, case when m = 0 then 'void' when m = 1 then case when k & 8 > 0 then 'string' when k & 16 > 0 then case when k & 6 > 0 then 'string' else 'double' end when k & 4 > 0 then 'decimal(38,0)' else 'bigint' end
        when m = 4 then 'boolean' when m & 24 = 0 then 'string' else 'json' end as field_type, n_files from g""",
    "p6_unified_counts": """with good as (select body from layer_files where json_valid(body) and json_type(body) = 'OBJECT'),
      flds as (select unnest(json_keys(body)) as f, body from good)
      select f as field_name, count(*) filter (json_type(json_extract(body, '$."' || f || '"')) <> 'NULL')::bigint as n_values from flds group by f""",
    "p7_found": f"with {_SHAPES} select frame_key, tile_no::bigint as tile_no, child_kind, child_no::bigint as child_no from hits",
}
SQL["p7_rebuilt"] = "select distinct frame_key, true as same from frame_json where json_valid(body) and json_type(body) = 'OBJECT'"
SQL["p7_occurrences"] = f"""with {_SHAPES} select child_kind as object_kind, count(*)::bigint as n_occurrences from hits group by 1
  union all select 'tile', count(*) filter (json_type(t) = 'OBJECT')::bigint from tl
  union all select 'frame', count(*)::bigint from frames where json_type(body) = 'OBJECT'"""
SQL["p2_maintained_keys"] = SQL["p2_current_keys"]
