"""Styles under and over typed spans: terminal colours win over a level's own, a base layer shows where neither paints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ansi import RUNS, runs_of, style_attributes


def first_overlap(span: Column, runs: Column) -> Column:
    """The first of runs (start, end, ..., in order) that shares a character with span; null if none does."""
    return F.get(F.filter(runs, lambda r: (r["start"] < span["end"]) & (r["end"] > span["start"])), F.lit(0))


def styled(segmented: DataFrame) -> DataFrame:
    """segmented lines (path, line_no, raw, spans) with styles: for each span the style of the terminal run that it meets first.

    Only lines with escapes have runs; they alone are read for them, and meet their spans by line.
    """
    runs = runs_of(segmented).select("path", "line_no", "runs")
    j = segmented.join(runs, ["path", "line_no"], "left")
    spans = F.transform("spans", lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), first_overlap(s, F.coalesce("runs", F.array().cast(RUNS)))["style"].alias("style")))
    return j.select(*segmented.columns, spans.alias("styles"))


def painted(lines: DataFrame, ramp: Column, default_fg: Column, default_bg: Column) -> DataFrame:
    """path, line_no, start, end, type, foreground, ... of the level spans of styled() lines: the run's colours over the ramp's."""
    s = lines.select("path", "line_no", F.explode("styles").alias("s")).where(F.startswith("s.type", F.lit("LEVEL_")))
    own = F.when(F.col("s.style").isNotNull(), style_attributes(F.col("s.style"), ramp, default_fg, default_bg)["foreground"]).otherwise(ramp)
    return s.select("path", "line_no", "s.start", "s.end", "s.type", own.cast("long").alias("foreground"), F.coalesce(F.col("s.style.bold"), F.lit(False)).alias("bold"))


def over_base(spans: Column, base: Column, owned: Column | None = None) -> Column:
    """spans (type, start, end) cut at every border of base (start, end, tag; in order, apart), each piece with the tag under it.

    Spans of the types in `owned` (an array) stay whole and untagged, as do empty ones.
    """
    def pieces(s: Column) -> Column:
        whole = F.array(F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("tag")))
        borders = F.flatten(F.transform(base, lambda b: F.array(b["start"], b["end"])))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(s["start"], s["end"]), F.filter(borders, lambda x: (x > s["start"]) & (x < s["end"])))))

        def piece(start: Column, i: Column) -> Column:
            under = F.get(F.filter(base, lambda b: (b["start"] <= start) & (b["end"] > start)), F.lit(0))
            return F.struct(s["type"].alias("type"), start.alias("start"), F.get(cuts, i + 1).alias("end"), under["tag"].cast("string").alias("tag"))

        split = F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), piece)
        keep = s["start"] >= s["end"]
        if owned is not None:
            keep = keep | F.array_contains(owned, s["type"])
        return F.when(keep, whole).otherwise(split)

    return F.flatten(F.transform(spans, pieces))
