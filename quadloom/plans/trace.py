"""Queries on the call trace (events as calls)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.functions import callset as cs
from quadloom.functions import calls as fc
from quadloom.model import CALLS_SQL, calls
from quadloom.operators import trace
from quadloom.runtime import Scratch, table
from quadloom.sources import frames, profiles, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_FRAMED = f"""{CALLS_SQL}, framed as (select *, coalesce(sum((flags & 32 <> 0)::int) over (order by call_no rows between unbounded preceding and 1 preceding), 0)::bigint as frame_id from calls)"""


def _framed(spark: SparkSession, d: str) -> DataFrame:
    return trace.frame_assign(calls(spark, d))


@query("evt1_frame_assign", f"with {_FRAMED} select call_no, frame_id from framed")
def evt1(spark, d):
    return _framed(spark, d).select("call_no", "frame_id")


@query("agg2_frame_info", f"""with {_FRAMED} select frame_id, min(call_no) as first_call, max(call_no) as last_call, count(*) as n_calls, coalesce(sum(octet_length(args::blob)), 0)::bigint as n_bytes
  from framed group by frame_id having max((flags & 32 <> 0)::int) = 1""")
def agg2(spark, d):
    return trace.frame_info(_framed(spark, d))


@query("agg3_trace_summary", f"with {CALLS_SQL} select count(*) filter (flags & 32 <> 0) as n_frames, count(*) as n_calls, sum(octet_length(args::blob))::bigint as n_bytes, count(distinct thread_id) as n_threads from calls")
def agg3(spark, d):
    return calls(spark, d).agg(F.count_if(F.col("flags").bitwiseAND(cs.END_FRAME) != 0).alias("n_frames"), F.count(F.lit(1)).alias("n_calls"), F.sum(F.octet_length("args").cast("bigint")).alias("n_bytes"), F.countDistinct("thread_id").alias("n_threads"))


@query("agg1_name_histogram", "select event_type as name, count(*) as n_calls from events group by 1")
def agg1(spark, d):
    return calls(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n_calls"))


@query("flt1_callset_mixed", f"""with {CALLS_SQL} select call_no, name from calls where (call_no between 10 and 200 and (call_no - 10) % 7 = 0) or call_no = 5 or (call_no >= 9000 and (flags & 8) <> 0) or (call_no >= 5000 and call_no <= 5010)""")
def flt1_mixed(spark, d):
    s = cs.CallSet().merge("10-200/7, 5, 9000-/draw,5000-5010")
    return calls(spark, d).filter(s.column(F.col("call_no"), F.col("flags"))).select("call_no", "name")


@query("flt1_callset_freq", f"with {CALLS_SQL} select call_no, flags from calls where flags & 48 <> 0 or flags & 32 <> 0")
def flt1_freq(spark, d):
    s = cs.CallSet().merge("*/fbo").merge("frame")
    return calls(spark, d).filter(s.column(F.col("call_no"), F.col("flags"))).select("call_no", "flags")


@query("flt2_range_contains", f"with {CALLS_SQL} select call_no, (call_no between 100 and 5000 and (call_no - 100) % 3 = 0 and flags & 8 <> 0) as inside, (call_no >= 100 and (call_no - 100) % 50 = 0) as stepped from calls")
def flt2(spark, d):
    no, fl = F.col("call_no"), F.col("flags")
    return calls(spark, d).select("call_no", cs.CallRange(100, 5000, 3, cs.RENDER).column(no, fl).alias("inside"), cs.CallRange(100, None, 50).column(no, fl).alias("stepped"))


@query("flt3_replace_then_union", f"with {CALLS_SQL} select call_no from calls where call_no <= 50 and call_no >= 1 or call_no between 90 and 95")
def flt3(spark, d):
    s = cs.CallSet("*").merge("1-50").merge("90-95")  # the first merge replaces the default, later ones add
    return calls(spark, d).filter(s.column(F.col("call_no"), F.col("flags"))).select("call_no")


@query("flt4_dump_grep", f"with {CALLS_SQL} select call_no, name from calls where call_no <= 6000 and regexp_matches(name, 'ig|c.i') and flags & 128 = 0")
def flt4(spark, d):
    return trace.dump(calls(spark, d), cs.CallSet().merge("0-6000"), "ig|c.i").select("call_no", "name")


@query("flt6_trim_frames", f"with {_FRAMED} select call_no, frame_id, name from framed where (call_no between 1 and 100 or frame_id between 10 and 20 or (frame_id >= 500 and (frame_id - 500) % 100 = 0)) and thread_id in (1, 2, 3, 5, 8, 13, 21, 34)")
def flt6(spark, d):
    return trace.trim(_framed(spark, d), cs.CallSet().merge("1-100"), cs.CallSet().merge("10-20,500-/100"), [1, 2, 3, 5, 8, 13, 21, 34]).select("call_no", "frame_id", "name")


# fixed values: calls of every class, with the flags they must get
_CALL_CLASSES = {
    0: "glTexImage2D glBindTexture glUseProgram glViewport glEnable glGetTexImage glGetUniformLocation glGetAttribLocation glGetQueryObjectuiv glMultiDrawElementArrayAPPLE glClearColor glEndList glRectangle glBindFramebuffers IDirect3DDevice2::Clear IDirect3DDevice9::SetTexture ID3D11Device::CreateBuffer glXMakeCurrent wglMakeCurrent eglInitialize",
    4: "glGetFloatv glGetIntegerv glGetInteger64v glGetIntegeri_v glGetVertexAttribfv glGetVertexAttribPointerv glGetTexParameteriv glGetTextureParameteriv glGetTexLevelParameteriv glGetTextureLevelParameterivEXT glGetError glGetBooleanv glGetDoublev glGetActiveUniform glGetActiveAttribARB glGetBufferParameteriv glGetProgramiv glGetProgramInfoLog glGetShaderSource glGetShaderiv glGetUniformfv glGetnUniformfvARB glGetLightfv glGetMaterialiv glGetObjectLabel glGetClipPlane glGetPointerv glAreTexturesResident glAreTexturesResidentEXT glAreProgramsResidentNV glDebugMessageControl glDebugMessageEnableAMD glObjectLabel glObjectPtrLabelKHR glBufferRegionEnabled eglSetDamageRegionKHR",
    132: "glGetString glGetStringi glIsEnabled glIsEnabledi glIsBufferARB glIsTexture glIsProgramNV glIsVertexArrayAPPLE glXGetCurrentContext glXGetProcAddressARB glXQueryVersion wglGetCurrentDC wglGetPixelFormat eglQueryString CGLGetCurrentContext IDirect3D9::GetDeviceCaps IDirect3D8::EnumAdapterModes IDirect3D9Ex::CheckDeviceFormat IDirect3DDevice9::GetDeviceCaps ID3D11Device::CheckFormatSupport ID3D10Device1::CheckMultisampleQualityLevels",
    128: "eglGetConfigAttrib glXGetFBConfigAttrib glXGetFBConfigAttribSGIX wglGetPixelFormatAttribivARB",
    8: "glDrawArrays glDrawElements glDrawRangeElements glDrawElementsInstancedBaseVertex glMultiDrawArraysIndirectCountARB glMultiModeDrawElementsIBM glDrawMeshArraysSUN glDrawTransformFeedbackStreamInstanced glDrawTransformFeedbackNV glCallList glCallLists glClear glEnd glDrawPixels glBlitFramebuffer glBlitFramebufferEXT glRectf glRectiv glEvalMesh2 IDirect3DDevice2::DrawPrimitive IDirect3DDevice7::Clear IDirect3DDevice9Ex::DrawIndexedPrimitiveUP IDirect3DViewport3::Clear2 ID3D10Device::DrawInstanced ID3D11DeviceContext1::ExecuteCommandList",
    16: "glBindFramebuffer glBindFramebufferEXT IDirect3DDevice8::SetRenderTarget ID3D11DeviceContext::OMSetRenderTargetsAndUnorderedAccessViews",
    48: "glXSwapBuffers glXSwapBuffersMscOML wglSwapBuffers wglSwapLayerBuffers eglSwapBuffers eglSwapBuffersWithDamageKHR IDirect3DDevice9Ex::PresentEx IDirect3DSwapChain9::Present",
    32: "CGLFlushDrawable glFrameTerminatorGREMEDY IDXGISwapChain1::Present1 IDXGIDecodeSwapChain::PresentBuffer IDirect3DDevice9::GetRenderTargetData",
    260: "glDebugMessageInsert glDebugMessageInsertKHR glInsertEventMarkerEXT",
    256: "glStringMarkerGREMEDY D3DPERF_SetMarker",
    768: "glPushDebugGroup glPushDebugGroupKHR glPushGroupMarkerEXT D3DPERF_BeginEvent",
    1280: "glPopDebugGroup glPopGroupMarkerEXT ID3DUserDefinedAnnotation::EndEvent",
}
_CALL_NAMES = [(n, f) for f, names in _CALL_CLASSES.items() for n in names.split()]


@query("flt7_call_flags", f"""with c(place, name, flags) as (values {", ".join(f"({i}, '{n}', {f})" for i, (n, f) in enumerate(_CALL_NAMES))})
  select event_id as call_no, name, flags from events join c on c.place = event_id % {len(_CALL_NAMES)}""")
def flt7(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n, _ in _CALL_NAMES]), (F.col("call_no") % len(_CALL_NAMES) + 1).cast("int"))
    return calls(spark, d).select("call_no", name.alias("name")).withColumn("flags", fc.call_flags(F.col("name")))


@query("flt8_sed_replace", f"""with {CALLS_SQL} select call_no, case when call_no between 100 and 8000 and name = 'error' then 'failure' else name end as name,
  case when call_no between 100 and 8000 and flags & 8 <> 0 then (flags & ~8) | 2 else flags end as flags,
  case when call_no between 100 and 8000 then list_transform([k, k + 1, 7], lambda x: case when x = 7 then -7 else x end) else [k, k + 1, 7] end::varchar as args from calls""")
def flt8(spark, d):
    inside = cs.CallSet().merge("100-8000").column(F.col("call_no"), F.col("flags"))
    old, new = fc.sed_expression("s/error/failure/")
    args = F.array(F.col("k"), F.col("k") + 1, F.lit(7).cast("bigint"))
    swapped = F.transform(args, lambda x: F.when(x == 7, -7).otherwise(x))
    text = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))), ", "), F.lit("]"))
    return calls(spark, d).select(
        "call_no", F.when(inside & (F.col("name") == old), new).otherwise(F.col("name")).alias("name"),
        F.when(inside & (F.col("flags").bitwiseAND(cs.RENDER) != 0), F.col("flags").bitwiseAND(~cs.RENDER).bitwiseOR(cs.NON_REPRODUCIBLE)).otherwise(F.col("flags")).alias("flags"),
        F.when(inside, text(swapped)).otherwise(text(args)).alias("args"),
    )


@query("flt9_sed_expression", "select 'a' as old, 'b' as new union all select 'x/y', 'z'")
def flt9(spark, d):
    return spark.createDataFrame([fc.sed_expression("s/a/b/"), fc.sed_expression("s|x/y|z|")], "old string, new string")


@query("flt10_pickle", f"with {CALLS_SQL} select call_no as no, thread_id as thread, name, k as machine, coalesce('K' || (k % 4), 'none') as human, flags from calls")
def flt10(spark, d):
    # symbols of an enumeration come from a fixed dimension of four rows
    dim = spark.createDataFrame([(i, f"K{i}") for i in range(4)], "code bigint, human string")
    c = calls(spark, d).withColumn("code", F.col("k") % 4)
    return c.join(F.broadcast(dim), "code", "left").select(F.col("call_no").alias("no"), F.col("thread_id").alias("thread"), "name", F.col("k").alias("machine"), F.coalesce("human", F.lit("none")).alias("human"), "flags")


@query("flt11_dump_text", f"with {CALLS_SQL} select call_no, call_no || ' @' || thread_id || ' ' || name || '(k = ' || coalesce(k::varchar, 'NULL') || ', props = ' || args || ')' as line from calls")
def flt11(spark, d):
    return calls(spark, d).select("call_no", F.format_string("%d @%d %s(k = %s, props = %s)", "call_no", "thread_id", "name", F.coalesce(F.col("k").cast("string"), F.lit("NULL")), "args").alias("line"))


_STATE_SQL = f"""{_FRAMED}, s as (select *, case when name = 'signup' then k % 3 end as unit_set, case when name = 'view' then k end as bind, case when name = 'error' then 'MODE_' || (k % 3) end as mode_set from framed)"""


def _state(spark, d):
    n, k = F.col("name"), F.col("k")
    return _framed(spark, d).select("*", F.when(n == "signup", k % 3).alias("unit_set"), F.when(n == "view", k).alias("bind"), F.when(n == "error", F.concat(F.lit("MODE_"), (k % 3).cast("string"))).alias("mode_set"))


_W = "over (partition by frame_id order by call_no rows between unbounded preceding and current row)"


@query("evt2_ffill_state", f"with {_STATE_SQL} select call_no, frame_id, last_value(mode_set ignore nulls) {_W} as matrix_mode, last_value(bind ignore nulls) {_W} as last_bound from s")
def evt2(spark, d):
    return trace.forward_fill(_state(spark, d), "frame_id", "call_no", {"matrix_mode": F.col("mode_set"), "last_bound": F.col("bind")}).select("call_no", "frame_id", "matrix_mode", "last_bound")


_BOUND_SQL = f"""{_STATE_SQL}, a as (select *, coalesce(last_value(unit_set ignore nulls) {_W}, 0) as active_unit from s),
b as (select *, last_value(case when active_unit = 0 then bind end ignore nulls) {_W} as u0, last_value(case when active_unit = 1 then bind end ignore nulls) {_W} as u1, last_value(case when active_unit = 2 then bind end ignore nulls) {_W} as u2 from a),
bound as (select *, coalesce(u0, case active_unit when 0 then u0 when 1 then u1 else u2 end, -1) as texture_id from b)"""


def _bound(spark, d):
    return trace.bound_texture(_state(spark, d), "frame_id", "call_no", F.col("unit_set"), F.col("bind"), units=3)


@query("evt3_bound_texture", f"with {_BOUND_SQL} select call_no, active_unit, texture_id from bound where name = 'click'")
def evt3(spark, d):
    return _bound(spark, d).filter("name = 'click'").select("call_no", "active_unit", "texture_id")


@query("evt4_draw_ordinal", f"with {_FRAMED} select call_no, row_number() over (partition by frame_id order by call_no) as draw_no, sum((k > 50)::int) over (partition by frame_id order by call_no)::bigint as element_draw_no from framed where name = 'click'")
def evt4(spark, d):
    w = Window.partitionBy("frame_id").orderBy("call_no")
    c = _framed(spark, d).filter("name = 'click'")
    return c.select("call_no", F.row_number().over(w).cast("bigint").alias("draw_no"), F.sum((F.col("k") > 50).cast("int")).over(w).alias("element_draw_no"))


@query("evt5_last_matrix", f"with {_STATE_SQL}, m as (select *, last_value(mode_set ignore nulls) {_W} as mode from s) select call_no, coalesce(last_value(case when mode = 'MODE_1' then value end ignore nulls) {_W}, last_value(value ignore nulls) {_W}) as matrix_value from m")
def evt5(spark, d):
    m = trace.forward_fill(_state(spark, d), "frame_id", "call_no", {"mode": F.col("mode_set")})
    f = trace.forward_fill(m, "frame_id", "call_no", {"own": F.when(F.col("mode") == "MODE_1", F.col("value")), "other": F.col("value")})
    return f.select("call_no", F.coalesce("own", "other").alias("matrix_value"))


@query("agg6_state_group", f"""with {_BOUND_SQL}, draws as (select *, coalesce(last_value(mode_set ignore nulls) {_W}, 'MODE_0') as mode from bound)
  select frame_id, texture_id, mode, min(call_no) as first_call, max_by(value, call_no) as last_value, string_agg(call_no::varchar, ',' order by call_no) as draws from draws where name = 'click' group by all""")
def agg6(spark, d):
    x = trace.forward_fill(_bound(spark, d), "frame_id", "call_no", {"mode": F.col("mode_set")}).filter("name = 'click'").withColumn("mode", F.coalesce("mode", F.lit("MODE_0")))
    g = x.groupBy("frame_id", "texture_id", "mode").agg(F.min("call_no").alias("first_call"), F.max_by("value", "call_no").alias("last_value"), F.sort_array(F.collect_list("call_no")).alias("_d"))
    return g.select("frame_id", "texture_id", "mode", "first_call", "last_value", F.array_join(F.col("_d").cast("array<string>"), ",").alias("draws"))


@query("agg9_argmax_state", f"with {_FRAMED} select frame_id, arg_max(call_no, row(k, value, -call_no)) as scene_call from framed where k is not null group by frame_id")
def agg9(spark, d):
    return _framed(spark, d).filter("k is not null").groupBy("frame_id").agg(F.max_by("call_no", F.struct("k", "value", (-F.col("call_no")).alias("o"))).alias("scene_call"))


@query("src5_loop_last_frame", f"with {_FRAMED}, l as (select * from framed where frame_id = (select max(frame_id) from framed where flags & 32 <> 0)) select 0::bigint as pass, call_no, name from framed union all select n, call_no, name from l, (select unnest(range(1, 4)) as n)")
def src5(spark, d):
    f = _framed(spark, d)
    last = f.filter(F.col("flags").bitwiseAND(cs.END_FRAME) != 0).agg(F.max("frame_id").alias("frame_id"))
    again = f.join(F.broadcast(last), "frame_id").select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("pass"), "call_no", "name")
    return f.select(F.lit(0).cast("bigint").alias("pass"), "call_no", "name").unionByName(again)


@query("src7_frame_range", f"with {_FRAMED} select call_no, frame_id from framed where frame_id between 100 and 150")
def src7(spark, d):
    return _framed(spark, d).filter("frame_id between 100 and 150").select("call_no", "frame_id")


@query("snk8_frame_lines", f"with {_FRAMED} select (frame_id + 1)::bigint as file_no, count(*) as n_lines, sum(length(name || '(' || args || ')') + 1)::bigint as n_chars from framed group by 1")
def snk8(spark, d):
    """A file of lines for each frame, written and read back; files count from 1, the closing call is the last line."""
    line = F.concat("name", F.lit("("), "args", F.lit(")"))
    s = Scratch(spark, "snk8")
    home = f"{s.home}/frames"
    written = s.save(traces.write_frame_files(_framed(spark, d).select((F.col("frame_id") + 1).alias("frame_id"), F.col("call_no").alias("order"), line.alias("line")), home))
    back = frames.read_written_lines(written, home)
    return back.groupBy(F.col("frame_id").cast("bigint").alias("file_no")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line").cast("bigint") + 1).alias("n_chars"))


@query("agg4_program_totals", "select user_id as program, count(*) as n_calls, sum(event_id % 1000)::bigint as cpu, sum(event_id % 77)::bigint as gpu, sum(event_id % 13 - 3)::bigint as pixels from events where event_id % 13 - 3 >= 0 group by 1")
def agg4(spark, d):
    e = table(spark, d, "events").withColumn("pixels", F.col("event_id") % 13 - 3).filter("pixels >= 0")
    return e.groupBy(F.col("user_id").alias("program")).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.col("event_id") % 1000).alias("cpu"), F.sum(F.col("event_id") % 77).alias("gpu"), F.sum("pixels").alias("pixels"))


@query("agg5_frame_spans", f"""with {_FRAMED}, f as (select thread_id, frame_id, min(call_no) as start_at, max(call_no + coalesce(k, 0)) as end_at from framed group by all),
  p as (select *, coalesce(max(end_at) over (partition by thread_id order by frame_id rows between unbounded preceding and 1 preceding), start_at) as span_start, max(end_at) over (partition by thread_id order by frame_id) as m from f)
  select thread_id, frame_id, span_start, m - span_start as span_duration from p""")
def agg5(spark, d):
    f = _framed(spark, d).groupBy("thread_id", "frame_id").agg(F.min("call_no").alias("start_at"), F.max(F.col("call_no") + F.coalesce("k", F.lit(0))).alias("end_at"))
    return trace.frame_spans(f, ["thread_id"], "frame_id", "start_at", "end_at").select("thread_id", "frame_id", "span_start", "span_duration")


@query("str2_activity_sessions", """with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events),
  y as (select *, sum(fresh) over (partition by user_id order by ts) as s from x)
  select user_id, count(*) as n_events, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from y group by user_id, s""")
def str2(spark, d):
    s = trace.sessions(table(spark, d, "events"), "user_id", "ts", 6 * 3600)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.select("user_id", "n_events", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


@query("str3_stop_after_n", "select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) as rn from events) where rn <= 5")
def str3(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("user_id", "event_id")


@query("str4_first_outcome", "select user_id, arg_min(case event_type when 'error' then 'failed' else 'done' end, event_id) as outcome, min(event_id) as at from events where event_type in ('error', 'purchase') group by user_id")
def str4(spark, d):
    return trace.first_outcome(table(spark, d, "events"), ["user_id"], "event_id", {"failed": "^error$", "done": "^purchase$"}, "event_type")


@query("str5_progress_alerts", """with d as (select user_id, ts::date as day, count(*) as n from events group by all), g as (select *, n - lag(n) over (partition by user_id order by day) as growth from d)
  select user_id, day::varchar as day, case when growth is null then 'first' when growth = 0 then 'stalled' when n >= 4 then 'budget' else 'ok' end as alert from g""")
def str5(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("growth", F.col("n") - F.lag("n").over(Window.partitionBy("user_id").orderBy("day")))
    return g.select("user_id", F.col("day").cast("string").alias("day"), F.when(F.col("growth").isNull(), "first").when(F.col("growth") == 0, "stalled").when(F.col("n") >= 4, "budget").otherwise("ok").alias("alert"))


@query("jn19_trace_diff", f"""with {CALLS_SQL}, a as (select call_no, name, k from calls where call_no % 11 <> 0), b as (select call_no, case when call_no % 17 = 0 then 'changed' else name end as name, k from calls where call_no % 13 <> 0)
  select coalesce(a.call_no, b.call_no) as call_no, case when a.call_no is null then 'only_b' when b.call_no is null then 'only_a' else 'changed' end as kind
  from a full join b on a.call_no = b.call_no where a.call_no is null or b.call_no is null or a.name is distinct from b.name or a.k is distinct from b.k""")
def jn19(spark, d):
    c = calls(spark, d)
    a = c.filter("call_no % 11 <> 0")
    b = c.filter("call_no % 13 <> 0").withColumn("name", F.when(F.col("call_no") % 17 == 0, "changed").otherwise(F.col("name")))
    return trace.diff_calls(a, b, "call_no", ["name", "k"])


_LINES = f"{CALLS_SQL}, lines as (select call_no, case when call_no % 10 = 0 then 'junk ' else '' end || call_no || ' glDraw(mode = GL_' || upper(name) || ', count = ' || coalesce(k::varchar, 'x') || ')' as line from calls)"


def _lines(spark, d):
    return calls(spark, d).select("call_no", F.concat(F.when(F.col("call_no") % 10 == 0, "junk ").otherwise(""), F.col("call_no").cast("string"), F.lit(" glDraw(mode = GL_"), F.upper("name"), F.lit(", count = "), F.coalesce(F.col("k").cast("string"), F.lit("x")), F.lit(")")).alias("line"))


@query("sc1_arg_extraction", f"with {_LINES} select call_no, regexp_extract(line, 'mode\\s*=\\s*([A-Z0-9_]+)', 1) as mode, try_cast(nullif(regexp_extract(line, 'count\\s*=\\s*([0-9]+)', 1), '') as bigint) as n from lines")
def sc1(spark, d):
    return _lines(spark, d).select("call_no", fc.arg_text(F.col("line"), "mode").alias("mode"), fc.arg_int(F.col("line"), "count").alias("n"))


@query("sc2_call_number", f"with {_LINES} select line, case when call_no % 10 = 0 then -1 else call_no end::bigint as number from lines")
def sc2(spark, d):
    return _lines(spark, d).select("line", fc.call_number(F.col("line")).alias("number"))


@query("flt12_draw_predicate", f"with {CALLS_SQL} select call_no from calls where name in ('click', 'view') and flags & 8 <> 0 and k > 0")
def flt12(spark, d):
    return calls(spark, d).filter(fc.is_draw(F.col("name"), F.col("flags"), F.col("k"), ["click", "view"])).select("call_no")


@query("sc19_skip_reason", f"""with {CALLS_SQL} select call_no, case when name = 'error' then 'null blob' when name <> 'click' then 'unsupported primitive' when k % 3 = 0 then 'multiple strips' when k < 20 then 'invalid strip data' end as skip_reason from calls""")
def sc19(spark, d):
    n, k = F.col("name"), F.col("k")
    return calls(spark, d).select("call_no", fc.skip_reason(n == "error", n == "click", k % 3 == 0, k < 20).alias("skip_reason"))


@query("sc28_clock_text", "select event_id, strftime(ts, '%Y_%m') || lower(strftime(ts, '%b')) || strftime(ts, '%d_%H:%M.%S') as clock from events")
def sc28(spark, d):
    return table(spark, d, "events").select("event_id", fc.clock_text(F.col("ts")).alias("clock"))


@query("sc29_flag_masks", f"with {CALLS_SQL} select call_no, flags & 48 as swaps, (flags & 128) <> 0 as verbose, (1 << (k % 8))::bigint as bit from calls where k is not null")
def sc29(spark, d):
    return calls(spark, d).filter("k is not null").select("call_no", F.col("flags").bitwiseAND(48).alias("swaps"), (F.col("flags").bitwiseAND(cs.VERBOSE) != 0).alias("verbose"), F.expr("shiftleft(1L, cast(k % 8 as int))").alias("bit"))


@query("sc31_type_sizes", f"""with {CALLS_SQL} select call_no, coalesce(k, 0) * case name when 'view' then 1 when 'click' then 2 when 'signup' then 4 when 'purchase' then 8 else 0 end * case when k % 2 = 0 then 4 else 3 end as n_bytes from calls""")
def sc31(spark, d):
    t = F.create_map(*[F.lit(x) for kv in {"view": "GL_UNSIGNED_BYTE", "click": "GL_UNSIGNED_SHORT", "signup": "GL_FLOAT", "purchase": "GL_DOUBLE"}.items() for x in kv])[F.col("name")]
    f = F.when(F.col("k") % 2 == 0, "GL_RGBA").otherwise("GL_RGB")
    return calls(spark, d).select("call_no", (F.coalesce("k", F.lit(0)) * fc.type_size(t) * fc.format_channels(f)).alias("n_bytes"))


@query("leaks_object_balance", f"with {CALLS_SQL} select k as object_id, sum(case name when 'signup' then 1 when 'purchase' then -1 else 0 end)::bigint as n_alive from calls group by k having n_alive > 0")
def leaks(spark, d):
    return trace.object_balance(calls(spark, d).withColumnRenamed("k", "object_id"), F.col("name") == "signup", F.col("name") == "purchase", "object_id")


@query("src18_profile_text", f"with {CALLS_SQL} select call_no as no, k * 10 as gpu_dur, call_no % 77 as cpu_dur, k - 3 as pixels, thread_id as program, name from calls where k is not null")
def src18(spark, d):
    """Calls as lines of a profile listing among others, and parsed again."""
    k, no = F.col("k"), F.col("call_no")
    zero = F.lit(0)
    text = F.concat_ws(" ", F.lit("call"), no, zero, k * 10, zero, no % 77, zero, zero, zero, zero, k - 3, "thread_id", "name")
    c = calls(spark, d)
    lines = c.filter("k is not null").select(text.alias("line")).unionByName(c.select(F.concat_ws(" ", F.lit("frame"), no).alias("line")))
    return profiles.parse_profile(lines).select("no", "gpu_dur", "cpu_dur", "pixels", "program", "name")


@query("evt7_logical_lines", r"select (event_id % 50)::bigint as file_id, row_number() over (partition by event_id % 50 order by event_id) - 1 as line_no, event_id || ' gl' || event_type || '(a = ' || case when event_id % 3 = 0 then '\n' else '' end || props || ')' as line from events")
def evt7(spark, d):
    files = table(spark, d, "events").groupBy((F.col("event_id") % 50).alias("file_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "props"))), lambda x: F.concat(x["event_id"].cast("string"), F.lit(" gl"), x["event_type"], F.lit("(a = "), F.when(x["event_id"] % 3 == 0, "\n").otherwise(""), x["props"], F.lit(")"))), "\n").alias("body"))
    return trace.stitch(files, "file_id", "body")


@query("flt18_pixel_predicate", "select page, count(*) as n_hits from (select vec_id as page, unnest(embedding) as e from embeddings) where e >= 0.2 group by page")
def flt18(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("page"), F.explode("embedding").alias("e")).filter(F.col("e") >= F.lit(0.2)).groupBy("page").agg(F.count(F.lit(1)).alias("n_hits"))


@query("agg20_pixel_report", "with p as (select label, vec_id, count(*) filter (e >= 0.2) as hits, count(*) as pixels from (select label, vec_id, unnest(embedding) as e from embeddings) group by all) select label, count(*) as n_images, sum(hits)::bigint as n_hits, sum(pixels)::bigint as n_pixels, count(*) filter (hits > 0) as n_with_hits from p group by label")
def agg20(spark, d):
    x = table(spark, d, "embeddings").select("label", "vec_id", F.explode("embedding").alias("e"))
    p = x.groupBy("label", "vec_id").agg(F.count_if(F.col("e") >= F.lit(0.2)).alias("hits"), F.count(F.lit(1)).alias("pixels"))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n_images"), F.sum("hits").alias("n_hits"), F.sum("pixels").alias("n_pixels"), F.count_if(F.col("hits") > 0).alias("n_with_hits"))
