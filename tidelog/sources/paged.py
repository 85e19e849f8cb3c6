"""Pages of log files through a stored index: a line's place is looked up, and only the bytes of the wanted lines are read.

build() reads files once, by blocks that are dealt to tasks, and stores where about every k-th line starts. Its entries lie in
order of path and line, so a filter on them reads a few row groups. read_ranges() joins wanted ranges with the entries around
them and reads the bytes between two entries, whatever the size of the file.

An index holds for the bytes that it was built from. Lines appended since are found behind its last entry; a file that was
rewritten needs a new one (streaming/follow.py tells which did).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.index import BLOCK_LINES
from tidelog.sources.reader import is_log_name, open_file
from tidelog.streaming.tail import charset_of, newlines

#: Bytes that a task reads at once; a multiple of all code units' widths.
BLOCK_BYTES = 8 * 1024**2
#: Lines to a piece: a longer range is read as several.
PIECE = 65_536
INDEX = "path string, line_no long, from_byte long, charset string"
_BLOCKS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("nth", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("charset", pa.string())])
_BLOCKS_DDL = "path string, block long, n long, nth array<long>, at array<long>, charset string"
_LINES = pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("raw", pa.string())])


def _look(every: int, block_bytes: int):
    """Of each block the number of its newlines, and the first and every k-th one's count and place behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with open_file(path) as f:
                    charset, mark, _ = charset_of(f.read(3))
                    f.seek(block * block_bytes)
                    ends = newlines(f.read(block_bytes), charset)
                nth, at = list(range(1, len(ends) + 1, every)), (ends[::every] + block * block_bytes).tolist()
                if block == 0:
                    nth, at = [0, *nth], [mark, *at]
                row = {"path": path, "block": block, "n": len(ends), "nth": nth, "at": at, "charset": charset}
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

    return run


def build(spark: SparkSession, folder: str | list[str], store: str, every: int = BLOCK_LINES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, line_no, from_byte, charset of lines at most `every` lines apart, stored under `store` and read from there.

    Line numbers are running sums over a file's blocks, a narrow row a block. Empty files have an entry for their line 0,
    which is not there; files whose name is no log's have none.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(is_log_name(F.element_at(F.split("path", "/"), -1)))
    last = F.greatest(F.floor((F.col("length") - 1) / block_bytes), F.lit(0)).cast("long")
    blocks = f.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).repartition("path", "block")
    blocks.mapInArrow(_look(every, block_bytes), _BLOCKS_DDL).write.mode("overwrite").parquet(f"{store}/blocks")
    read = spark.read.schema(_BLOCKS_DDL).parquet(f"{store}/blocks")
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = read.select("path", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    entries = read.select("path", "block", "charset", F.explode(F.arrays_zip("nth", "at")).alias("e")).join(before, ["path", "block"])
    entries = entries.select("path", (F.col("before") + F.col("e.nth")).alias("line_no"), F.col("e.at").alias("from_byte"), "charset")
    entries.repartitionByRange("path", "line_no").sortWithinPartitions("path", "line_no").write.mode("overwrite").parquet(f"{store}/entries")
    return stored(spark, store)


def stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{store}/entries")


def ranges(index: DataFrame, wanted: DataFrame, every: int = BLOCK_LINES) -> DataFrame:
    """path, first_line, last_line, line_no, from_byte, to_byte, charset of wanted ranges (path, first_line, last_line).

    The bytes are those from the last entry at or before the first line to the first entry behind the last one (null: to the
    file's end). Entries lie at most `every` lines apart, so both are in the spans next to the range: one equal join, in
    which a range meets a few entries however long the file's index is. Ranges behind the last line have no row or no lines.
    """
    span = lambda line: F.floor(line / every).cast("long")
    pieces = wanted.where("first_line <= last_line").select("path", "last_line", F.explode(F.expr(f"sequence(greatest(first_line, 0), last_line, {PIECE})")).alias("first_line"))
    pieces = pieces.select("path", "first_line", F.least("last_line", F.col("first_line") + PIECE - 1).alias("last_line")).distinct()
    around = F.array_distinct(F.array(span(F.col("first_line")) - 1, span(F.col("first_line")), span(F.col("last_line") + 1), span(F.col("last_line") + 1) + 1))
    met = pieces.withColumn("_span", F.explode(around)).join(index.withColumn("_span", span(F.col("line_no"))), ["path", "_span"])
    start = F.max(F.when(F.col("line_no") <= F.col("first_line"), F.struct("line_no", "from_byte", "charset")))
    found = met.groupBy("path", "first_line", "last_line").agg(start.alias("s"), F.min(F.when(F.col("line_no") > F.col("last_line"), F.col("from_byte"))).alias("to_byte"))
    return found.where("s is not null").select("path", "first_line", "last_line", "s.line_no", "s.from_byte", "to_byte", "s.charset")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with open_file(r["path"]) as f:
                f.seek(r["from_byte"])
                body = f.read() if r["to_byte"] is None else f.read(r["to_byte"] - r["from_byte"])
            lines = body.decode(r["charset"], "replace").split("\n")
            if lines[-1] == "":  # the newline of the last line, or nothing at all
                lines.pop()
            low, high = r["first_line"] - r["line_no"], r["last_line"] - r["line_no"] + 1
            kept = lines[low:high]
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(kept), pa.string()), pa.array(range(r["first_line"], r["first_line"] + len(kept)), pa.int64()), pa.array(kept, pa.string())], schema=_LINES)


def read_ranges(index: DataFrame, wanted: DataFrame, every: int = BLOCK_LINES) -> DataFrame:
    """path, line_no, raw of the lines in the wanted ranges, numbered and decoded as read_lines() does.

    Ranges that repeat are read once; lines of ranges that overlap come once a range.
    """
    return ranges(index, wanted, every).repartition("path", "first_line").mapInArrow(_read, "path string, line_no long, raw string")


def page(spark: SparkSession, store: str, path: str, number: int, size: int = BLOCK_LINES, every: int = BLOCK_LINES) -> DataFrame:
    """One page of one file. The filter on the stored entries is pushed to their row groups, so neither is scanned whole."""
    first, last = number * size, (number + 1) * size - 1
    near = stored(spark, store).where((F.col("path") == path) & (F.col("line_no") > first - every) & (F.col("line_no") <= last + every))
    return read_ranges(near, spark.createDataFrame([(path, first, last)], "path string, first_line long, last_line long"), every)
