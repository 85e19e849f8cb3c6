"""Terminal styles: runs of styled text, and the colours that they stand for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import ESC, ESCAPE, contains_escape

_ESCAPE = re.compile(ESCAPE)
_SGR = re.compile(r"\x1b\[([0-?]*)[ -/]*m\Z")
_PLAIN: dict = {"fg": None, "bg": None, "bold": False, "dim": False, "italic": False, "underline": False}
COLOUR = "struct<kind:string,code:int,r:int,g:int,b:int>"
STYLE = f"struct<fg:{COLOUR},bg:{COLOUR},bold:boolean,dim:boolean,italic:boolean,underline:boolean>"
RUNS = f"array<struct<start:int,end:int,style:{STYLE}>>"
_FLAGS = {1: ("bold", True), 2: ("dim", True), 3: ("italic", True), 4: ("underline", True), 21: ("underline", True), 23: ("italic", False), 24: ("underline", False)}


def _colour(kind: str, code: int | None = None, rgb: tuple = (None, None, None)) -> dict:
    return {"kind": kind, "code": code, "r": rgb[0], "g": rgb[1], "b": rgb[2]}


def _parameters(raw: str) -> list[str]:
    """Parameters as text. Colons part like semicolons; a direct colour's colour-space number is left out."""
    out: list[str] = []
    for group in raw.split(";"):
        parts = group.split(":")
        if len(parts) == 6 and parts[0] in ("38", "48") and parts[1] == "2":
            del parts[2]
        out += parts
    return out


def _number(digits: str) -> int:
    """A parameter; none counts as 0, and one of over nine digits as a number that means nothing."""
    short = digits.lstrip("0")
    return int(short or 0) if len(short) < 10 else 10**9


def apply_sgr(raw: str, style: dict) -> dict:
    """The style after one select-graphic-rendition sequence with these parameters."""
    style = dict(style)
    todo = _parameters(raw)
    while todo:
        head = todo.pop(0)
        digits = re.match(r"\d*", head)[0]
        n = _number(digits)
        if n in (38, 48) and digits == head:
            got = _extended(todo)
            if got is None:
                return style
            style["fg" if n == 38 else "bg"] = got
            continue
        if n == 0:
            style = dict(_PLAIN)
        elif n == 22:
            style["bold"] = style["dim"] = False
        elif n in _FLAGS:
            style[_FLAGS[n][0]] = _FLAGS[n][1]
        elif n in (39, 49):
            style["fg" if n == 39 else "bg"] = None
        elif 30 <= n <= 37 or 90 <= n <= 97:
            style["fg"] = _colour("named", n)
        elif 40 <= n <= 47 or 100 <= n <= 107:
            style["bg"] = _colour("named", n - 10)
        if digits != head:
            return style
    return style


def _extended(todo: list[str]) -> dict | None:
    """A 256-colour or direct colour off the front of the parameters; None where they are malformed."""
    kind = todo.pop(0) if todo else ""
    need = {5: 1, 2: 3}.get(_number(kind) if kind.isdigit() else 0)
    if need is None or len(todo) < need or not all(x.isdigit() or x == "" for x in todo[:need]):
        return None
    values = [min(_number(x), 255) for x in todo[:need]]
    del todo[:need]
    return _colour("indexed", values[0]) if need == 1 else _colour("rgb", None, tuple(values))


def ansi_runs(line: str) -> list[dict]:
    """Styled runs (start, end, style) over the raw text. Styles end with their line; equal neighbours are one run."""
    out: list[dict] = []
    base = 0
    for part in line.split("\n"):
        style, at = dict(_PLAIN), 0
        stops = [(m.start(), m.end(), m[0]) for m in _ESCAPE.finditer(part)] if ESC in part else []
        for first, last, sequence in [*stops, (len(part), len(part), "")]:
            if first > at and style != _PLAIN:
                run = {"start": base + at, "end": base + first, "style": dict(style)}
                if out and out[-1]["end"] == run["start"] and out[-1]["style"] == run["style"]:
                    out[-1]["end"] = run["end"]
                else:
                    out.append(run)
            at = last
            if m := _SGR.match(sequence):
                style = apply_sgr(m[1], style)
        base += len(part) + 1
    return out


def strip_with_map(text: str) -> tuple[str, list[int]]:
    """The stripped text and, for each of its characters and its end, the offset in the raw text."""
    kept, at = [], 0
    for m in _ESCAPE.finditer(text):
        kept += range(at, m.start())
        at = m.end()
    kept += range(at, len(text))
    return "".join(text[i] for i in kept), [*kept, len(text)]


def escape_ranges(text: str) -> list[tuple[int, int]]:
    """Ranges that escapes take up, end exclusive; sequences side by side are one range."""
    out: list[tuple[int, int]] = []
    for m in _ESCAPE.finditer(text):
        if out and out[-1][1] == m.start():
            out[-1] = (out[-1][0], m.end())
        else:
            out.append((m.start(), m.end()))
    return out


def runs_of(lines: DataFrame) -> DataFrame:
    """path, line_no, runs of the lines that hold escapes; the others never reach Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "line_no": pdf["line_no"], "runs": [ansi_runs(x) for x in pdf["raw"]]})

    return lines.where(contains_escape(F.col("raw"))).select("path", "line_no", "raw").mapInPandas(run, f"path string, line_no long, runs {RUNS}")


# The sixteen base colours (codes 30-37, then 90-97) and the colour cube's channel values.
BASE_COLOURS = (
    0x000000, 0xCD0000, 0x00CD00, 0xCDCD00, 0x0000EE, 0xCD00CD, 0x00CDCD, 0xE5E5E5,
    0x7F7F7F, 0xFF0000, 0x00FF00, 0xFFFF00, 0x5C5CFF, 0xFF00FF, 0x00FFFF, 0xFFFFFF,
)
CUBE = (0, 95, 135, 175, 215, 255)
DIM_MIX = 0.45


def palette_rgb(index: Column) -> Column:
    """0xRRGGBB of a 256-colour index."""
    i = index.cast("int")
    base = F.array(*[F.lit(c) for c in BASE_COLOURS])
    cube = F.array(*[F.lit(c) for c in CUBE])
    k = i - 16

    def channel(n: Column) -> Column:
        return F.get(cube, n.cast("int"))

    grey = 8 + 10 * (i - 232)
    return F.when(i < 16, F.get(base, i)).when(i < 232, channel(F.floor(k / 36)) * 65536 + channel(F.floor(k / 6) % 6) * 256 + channel(k % 6)).otherwise(grey * 65793)


def colour_rgb(c: Column) -> Column:
    """0xRRGGBB of a colour struct."""
    named = F.get(F.array(*[F.lit(x) for x in BASE_COLOURS]), (c["code"] % 10 + F.when(c["code"] >= 90, 8).otherwise(0)).cast("int"))
    return F.when(c["kind"] == "named", named).when(c["kind"] == "indexed", palette_rgb(c["code"])).when(c["kind"] == "rgb", c["r"] * 65536 + c["g"] * 256 + c["b"])


def blend(a: Column, b: Column, share: float = DIM_MIX) -> Column:
    """a moved towards b, channel by channel."""
    def channel(c: Column, by: int) -> Column:
        return F.floor(c / by) % 256

    def mixed(by: int) -> Column:
        return F.floor(channel(a, by) + (channel(b, by) - channel(a, by)) * F.lit(share) + 0.5) * by

    return (mixed(65536) + mixed(256) + mixed(1)).cast("int")


def style_attributes(style: Column, ramp: Column, default_fg: Column, default_bg: Column) -> Column:
    """foreground, background, bold, italic, underline as painted: the severity's own colour shows where no colour is set."""
    bg = F.when(style["bg"].isNotNull(), colour_rgb(style["bg"]))
    chosen = F.when(style["fg"].isNotNull(), colour_rgb(style["fg"])).when(bg.isNotNull(), F.lit(None).cast("int")).otherwise(ramp)
    fg = F.when(style["dim"], blend(F.coalesce(chosen, default_fg), F.coalesce(bg, default_bg))).otherwise(chosen)
    return F.struct(fg.cast("int").alias("foreground"), bg.cast("int").alias("background"), style["bold"].alias("bold"), style["italic"].alias("italic"), style["underline"].alias("underline"))
