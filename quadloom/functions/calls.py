"""Scalar functions on calls and trace text."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions.callset import END_FRAME, MARKER, MARKER_POP, MARKER_PUSH, NO_SIDE_EFFECTS, RENDER, SWAP_RENDERTARGET, VERBOSE

SWAP_BUFFERS = END_FRAME | SWAP_RENDERTARGET
QUIET = NO_SIDE_EFFECTS | VERBOSE
# fixed values: calls of the window systems and of markers, by class
CALLS_BY_CLASS = {
    SWAP_BUFFERS: ["eglSwapBuffers", "eglSwapBuffersWithDamageEXT", "eglSwapBuffersWithDamageKHR", "glXSwapBuffers", "glXSwapBuffersMscOML", "wglSwapBuffers", "wglSwapLayerBuffers", "wglSwapMultipleBuffers"],
    END_FRAME: ["CGLFlushDrawable", "glFrameTerminatorGREMEDY"],
    VERBOSE: ["eglGetConfigAttrib", "glXGetFBConfigAttrib", "glXGetFBConfigAttribSGIX", "wglGetPixelFormatAttribivARB", "wglGetPixelFormatAttribivEXT"],
    QUIET: [
        "CGLGetCurrentContext", "eglGetProcAddress", "eglQueryString", "glXGetClientString", "glXGetConfig", "glXGetCurrentContext", "glXGetCurrentDisplay", "glXGetCurrentDisplayEXT",
        "glXGetCurrentDrawable", "glXGetCurrentReadDrawable", "glXGetCurrentReadDrawableSGI", "glXGetProcAddress", "glXGetProcAddressARB", "glXIsDirect", "glXQueryExtension", "glXQueryExtensionsString", "glXQueryVersion",
        "wglDescribePixelFormat", "wglGetCurrentContext", "wglGetCurrentDC", "wglGetDefaultProcAddress", "wglGetExtensionsStringARB", "wglGetExtensionsStringEXT", "wglGetPixelFormat", "wglGetProcAddress",
    ],
    NO_SIDE_EFFECTS: ["eglSetDamageRegionKHR", "glBufferRegionEnabled", "glDebugMessageControl", "glDebugMessageControlARB", "glDebugMessageEnableAMD"],
    MARKER | MARKER_PUSH: ["D3DPERF_BeginEvent", "ID3DUserDefinedAnnotation::BeginEvent"],
    MARKER | MARKER_POP: ["D3DPERF_EndEvent", "ID3DUserDefinedAnnotation::EndEvent"],
    MARKER: ["D3DPERF_SetMarker", "ID3DUserDefinedAnnotation::SetMarker", "glStringMarkerGREMEDY"],
}
# fixed values: queries that are known to no class, as they return pixels, places or results still to come
UNCLASSED_GETTERS = ["AttribLocation", "UniformLocation", "FragDataLocation", "SubroutineIndex", "UniformBlockIndex", "QueryObject", "DebugMessageLog", "TexImage", "TextureImage", "PixelMap", "PolygonStipple", "TextureHandle", "TextureSamplerHandle", "ImageHandle"]
UNCLASSED_NAMES = ["glGetHistogram", "glGetMinmax", "glGetSeparableFilter", "glGetConvolutionFilter"]  # their vendor forms have a class
UNCLASSED_TESTS = ["HandleResident", "Path", "CommandList"]


def call_flags(name: Column) -> Column:
    """Flags of a call, 0 where no class has it or the name is null.

    A name is read in parts: the interface before ``::`` with its version number, or the ``gl`` verb
    without the trailing capitals and digits that name a vendor.  Drawing decides first, then targets,
    then queries, then the listed calls of window systems and markers.
    """
    verb = F.regexp_replace(F.substr(name, F.lit(3)), "[A-Z0-9]+$", "")
    starts = lambda c, *xs: reduce(or_, [c.startswith(x) for x in xs])
    holds = lambda c, *xs: reduce(or_, [c.contains(x) for x in xs])
    gl = name.startswith("gl") & ~name.startswith("glX")
    draws = (
        holds(verb, *[f"Draw{k}{what}" for k in ("", "Range", "Mesh") for what in ("Arrays", "Elements")])
        | verb.isin("CallList", "CallLists", "Clear", "End", "DrawPixels", "BlitFramebuffer", "EvalMesh") | verb.startswith("DrawTransformFeedback")
        | verb.isin(*[f"Rect{t}{v}" for t in "dfis" for v in ("", "v")])
    )
    asks = verb.startswith("Get") & ~reduce(or_, [verb.rlike(f"^Getn?(?:Compressed)?{x}") for x in UNCLASSED_GETTERS]) & ~name.isin(UNCLASSED_NAMES)
    tests = verb.startswith("Is") & ~holds(verb, *UNCLASSED_TESTS)
    gl_flags = (
        F.when(draws, RENDER).when(verb == "BindFramebuffer", SWAP_RENDERTARGET).when(verb.isin("GetString", "GetStringi") | tests, QUIET).when(asks, NO_SIDE_EFFECTS)
        .when(verb.isin("DebugMessageInsert", "InsertEventMarker"), NO_SIDE_EFFECTS | MARKER).when(verb.isin("ObjectLabel", "ObjectPtrLabel") | starts(verb, "AreTexturesResident", "AreProgramsResident"), NO_SIDE_EFFECTS)
        .when(verb.isin("PushDebugGroup", "PushGroupMarker"), MARKER | MARKER_PUSH).when(verb.isin("PopDebugGroup", "PopGroupMarker"), MARKER | MARKER_POP)
    )
    # Direct3D: interface, its version, and the method
    face, method = F.substring_index(name, "::", 1), F.substring_index(name, "::", -1)
    kind = F.regexp_replace(face, "[0-9]+(Ex)?$", "")
    version = F.coalesce(F.regexp_extract(face, "([0-9]+)(?:Ex)?$", 1).try_cast("int"), F.lit(1))
    late = face.startswith("ID3D10Device") | face.startswith("ID3D11DeviceContext")
    dx_flags = (
        F.when(late & (method.startswith("Draw") | (method == "ExecuteCommandList")), RENDER).when(late & method.startswith("OMSetRenderTargets"), SWAP_RENDERTARGET)
        .when(starts(face, "IDXGISwapChain", "IDXGIDecodeSwapChain") & method.startswith("Present"), END_FRAME)
        .when(kind.isin("ID3D10Device", "ID3D11Device", "ID3D") & starts(face, "ID3D10Device", "ID3D11Device") & method.isin("CheckFormatSupport", "CheckMultisampleQualityLevels"), QUIET)
        .when((face == "ID3D11VideoProcessorEnumerator") & (method == "CheckVideoProcessorFormat"), QUIET)
        .when((kind == "IDirect3DDevice") & (method.startswith("Draw") | (method == "Clear") & (version >= 7)), RENDER)
        .when((kind == "IDirect3DDevice") & (version >= 8) & method.isin("Present", "PresentEx"), SWAP_BUFFERS)
        .when((kind == "IDirect3DDevice") & (version >= 8) & (method == "SetRenderTarget"), SWAP_RENDERTARGET)
        .when((kind == "IDirect3DDevice") & (version >= 9) & (method == "GetRenderTargetData"), END_FRAME)
        .when((kind == "IDirect3DSwapChain") & (method == "Present"), SWAP_BUFFERS)
        .when((kind == "IDirect3DViewport") & method.isin("Clear", "Clear2"), RENDER)
        .when(kind.isin("IDirect3D", "IDirect3DDevice") & (version >= 8) & (method == "GetDeviceCaps"), QUIET)
        .when((kind == "IDirect3D") & (version >= 8) & method.isin("CheckDeviceFormat", "EnumAdapterModes", "GetAdapterModeCount"), QUIET)
    )
    listed = F.create_map(*[F.lit(x) for flags, names in CALLS_BY_CLASS.items() for n in names for x in (n, flags)])[name]
    return F.coalesce(F.when(gl, gl_flags), F.when(name.contains("::"), dx_flags), listed, F.lit(0))


def arg_text(line: Column, name: str, value: str = r"[A-Z0-9_]+") -> Column:
    """Value of ``name = value`` in a call's text, null if it is not there."""
    return F.nullif(F.regexp_extract(line, rf"{re.escape(name)}\s*=\s*({value})", 1), F.lit(""))


def arg_int(line: Column, name: str) -> Column:
    return arg_text(line, name, r"[0-9]+").try_cast("bigint")


def call_number(line: Column) -> Column:
    """Leading call number of a call's line, -1 without one."""
    return F.coalesce(F.regexp_extract(line, r"^\s*([0-9]+)\s+gl[A-Za-z0-9_]+\s*\(", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def sed_expression(text: str) -> tuple[str, str]:
    """``s/A/B/`` with any separator; ``@file`` on either side reads the text from a file."""
    if len(text) < 2 or text[0] != "s":
        raise ValueError(f"not a substitution: {text!r}")
    sep = text[1]
    parts = text[2:].split(sep)
    if len(parts) != 3 or parts[2]:
        raise ValueError(f"not a substitution: {text!r}")

    def side(x: str) -> str:
        m = re.fullmatch(r"@file\((.*)\)", x)
        if m:
            from pathlib import Path

            return Path(m[1]).read_text().rstrip("\n")
        return x

    return side(parts[0]), side(parts[1])


# fixed values: bytes of the element types, channels of the pixel formats
TYPE_SIZES = {"GL_BYTE": 1, "GL_UNSIGNED_BYTE": 1, "GL_SHORT": 2, "GL_UNSIGNED_SHORT": 2, "GL_INT": 4, "GL_UNSIGNED_INT": 4, "GL_FLOAT": 4, "GL_DOUBLE": 8, "GL_HALF_FLOAT": 2}
FORMAT_CHANNELS = {"GL_ALPHA": 1, "GL_LUMINANCE": 1, "GL_LUMINANCE_ALPHA": 2, "GL_RG": 2, "GL_RGB": 3, "GL_BGR": 3, "GL_RGBA": 4, "GL_BGRA": 4}


def type_size(name: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in TYPE_SIZES.items() for x in (F.lit(k), F.lit(v))])[name], F.lit(0))


def format_channels(name: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in FORMAT_CHANNELS.items() for x in (F.lit(k), F.lit(v))])[name], F.lit(0))


def clock_text(ts: Column) -> Column:
    """Year, month number and name, day and time as ``2024_01jan05_06:07.08``."""
    return F.lower(F.concat(F.date_format(ts, "yyyy_MM"), F.date_format(ts, "MMM"), F.date_format(ts, "dd_HH:mm.ss")))


def is_draw(name: Column, flags: Column, count: Column, names: list[str]) -> Column:
    """A call of one of the given names that renders and has something to draw; null counts draw nothing."""
    return F.coalesce(name.isin(names) & (flags.bitwiseAND(RENDER) != 0) & (count > 0), F.lit(False))


def skip_reason(no_data: Column, known_primitive: Column, several_strips: Column, bad_strip: Column) -> Column:
    """Why a draw gives no tile, the first that holds; null where it gives one."""
    return F.when(no_data, "null blob").when(~known_primitive, "unsupported primitive").when(several_strips, "multiple strips").when(bad_strip, "invalid strip data")
