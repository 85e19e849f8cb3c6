"""Line starts, offsets to lines and back, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.carry import BLOCK, running_sum

#: Characters to a span of line_of().
SPAN = 16 * 1024**2
MAX_LINES = 16_000_000
MAX_CHARS = 1024**3
BLOCK_LINES = 256


def line_starts(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, line_no, start_offset, length, has_newline. Offsets count characters, a newline as one.

    Sums are taken within blocks of lines, so that one huge file is many tasks, and over each file's blocks, a row each.
    """
    sized = lines.select("path", "line_no", F.length("raw").cast("long").alias("length"))
    return running_sum(sized, F.col("length") + 1, "start_offset", block, once=True).select("path", "line_no", "start_offset", "length", (F.col("line_no") < F.col("last_line")).alias("has_newline"))


def totals(starts: DataFrame) -> DataFrame:
    """path, lines, chars: what an index of terminated lines has consumed, from which extended() goes on."""
    return starts.groupBy("path").agg((F.max("line_no") + 1).alias("lines"), F.max(F.col("start_offset") + F.col("length") + 1).alias("chars"))


def extended(so_far: DataFrame, appended: DataFrame, block: int = BLOCK) -> DataFrame:
    """Starts of appended lines alone (path, line_no, start_offset, length): the lines before them aren't read again."""
    more = line_starts(appended, block).join(so_far.select("path", "chars"), "path", "left")
    return more.select("path", "line_no", (F.col("start_offset") + F.coalesce("chars", F.lit(0))).alias("start_offset"), "length")


def capped(starts: DataFrame, cap: int = MAX_LINES) -> DataFrame:
    """path, lines, capped, scanned: an index stops at the cap, and says where."""
    end = F.col("start_offset") + F.col("length") + F.col("has_newline").cast("long")
    return starts.groupBy("path").agg(
        F.least(F.count("*"), F.lit(cap)).alias("lines"), (F.count("*") > cap).alias("capped"), F.max(F.when(F.col("line_no") < cap, end)).alias("scanned")
    )


def line_of(probes: DataFrame, starts: DataFrame, span: int = SPAN) -> DataFrame:
    """probes (path, offset) with line_no: the last line that starts at or before the offset; line 0 below 0.

    Starts and probes are put in one order and the last start carried on, within spans of `span` characters; a span's last
    start, a row per span and file, is carried over the spans. No range join, and one huge file is many tasks.
    """
    s = starts.select("path", F.col("start_offset").alias("at"), F.lit(0).alias("kind"), "line_no", F.lit(None).cast("long").alias("offset"))
    p = probes.select("path", F.greatest("offset", F.lit(0)).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("line_no"), "offset")
    tops = starts.groupBy("path", F.floor(F.col("start_offset") / span).cast("long").alias("_span")).agg(F.max("line_no").alias("_top"))
    # spans in which no line starts still answer probes: they take the last one before
    spans = tops.unionByName(probes.select("path", F.floor(F.greatest("offset", F.lit(0)) / span).cast("long").alias("_span"), F.lit(None).cast("long").alias("_top")).distinct()).groupBy("path", "_span").agg(F.max("_top").alias("_top"))
    ahead = Window.partitionBy("path").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("path", "_span", F.max("_top").over(ahead).alias("_before"))
    w = Window.partitionBy("path", "_span").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(p).withColumn("_span", F.floor(F.col("at") / span).cast("long")).withColumn("_own", F.last("line_no", ignorenulls=True).over(w)).where("kind = 1")
    return both.join(spans, ["path", "_span"]).select("path", "offset", F.coalesce("_own", "_before").alias("line_no"))


def start_of(wanted: DataFrame, starts: DataFrame) -> DataFrame:
    """wanted (path, line_no) with start_offset: the end of the text for lines past the last."""
    end = starts.groupBy("path").agg(F.max(F.col("start_offset") + F.col("length")).alias("_end"))
    return wanted.join(starts.select("path", "line_no", "start_offset"), ["path", "line_no"], "left").join(end, "path", "left").select("path", "line_no", F.coalesce("start_offset", "_end").alias("start_offset"))


def page(lines: DataFrame, number: int, size: int = BLOCK_LINES) -> DataFrame:
    """The lines of one page of every file: a range filter, which a table partitioned by it prunes."""
    return lines.where((F.col("line_no") >= number * size) & (F.col("line_no") < (number + 1) * size))


def page_of(line_no: Column, size: int = BLOCK_LINES) -> Column:
    return F.floor(line_no / size).cast("long")


def fold_offsets(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """Fold runs as character ranges: from the first line's start to the last line's end, its newline left out."""
    s = starts.select("path", "line_no", "start_offset", (F.col("start_offset") + F.col("length")).alias("_end"))
    first = s.select("path", F.col("line_no").alias("first_line"), F.col("start_offset").alias("from_offset"))
    last = s.select("path", F.col("line_no").alias("last_line"), F.col("_end").alias("to_offset"))
    return runs.join(first, ["path", "first_line"]).join(last, ["path", "last_line"])
