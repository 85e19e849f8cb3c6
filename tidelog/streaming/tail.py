"""Following growing files: counts by the format first found, incremental facts, and a source that reads appends."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidelog.functions.formats import FORMATS, LogFormat
from tidelog.operators import detect, facts, index
from tidelog.operators.carry import BLOCK
from tidelog.operators.status import TAIL_UNAVAILABLE
from tidelog.sources.reader import open_file

TAIL_SCHEMA = "path string, generation long, line_no long, raw string"
CHUNK_SCHEMA = "path string, generation long, first_line long, from_byte long, to_byte long, charset string"
FINGERPRINT = 4096
#: Bytes that are looked at in one go, and that a task reads at most unless one line is longer.
CHUNK = 8 * 1024**2


def growth(before: dict | None, size: int, prefix: bytes) -> str:
    """What happened to a file: `new`, `same`, `appended`, or `rewritten` if it shrank or its beginning changed."""
    if before is None:
        return "new"
    n = before["marked"]
    if size < before["seen"] or len(prefix) < n or hashlib.sha256(prefix[:n]).hexdigest() != before["mark"]:
        return "rewritten"
    return "appended" if size > before["seen"] else "same"


def charset_of(prefix: bytes) -> tuple[str, int, int]:
    """Charset, length of its mark, bytes of a code unit."""
    for mark, name, width in ((b"\xef\xbb\xbf", "utf-8", 1), (b"\xff\xfe", "utf-16-le", 2), (b"\xfe\xff", "utf-16-be", 2)):
        if prefix.startswith(mark):
            return name, len(mark), width
    return "utf-8", 0, 1


def newlines(block: bytes, charset: str) -> np.ndarray:
    """The places just after each newline."""
    if charset == "utf-8":
        return np.flatnonzero(np.frombuffer(block, np.uint8) == 10) + 1
    units = np.frombuffer(block[: len(block) // 2 * 2], "<u2" if charset == "utf-16-le" else ">u2")
    return (np.flatnonzero(units == 10) + 1) * 2


class _Reader(SimpleDataSourceStreamReader):
    """Offsets hold, per file, the byte after the last newline, how far was looked, and the lines so far.

    The driver looks for newlines, a block at a time, and hands out where chunks of whole lines lie; tasks read them.
    """

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:
        return {}

    def _paths(self) -> list[str]:
        return sorted(os.path.join(self.folder, f) for f in os.listdir(self.folder) if f.lower().endswith((".log", ".out")))

    def _chunks(self, path: str, state: dict, stop: int, charset: str) -> list[tuple]:
        """Chunks up to the last newline before `stop`, about `most` bytes of them; state moves on."""
        out: list[tuple] = []
        at, line = state["offset"], state["line"]
        low, seen, first, count = at, max(state["seen"], at), line, 0
        with open(path, "rb") as f:
            f.seek(seen)
            while seen < stop and (low - at < self.most or not out):
                block = f.read(min(CHUNK, stop - seen))
                if not block:
                    break
                ends = newlines(block, charset)
                if len(ends):
                    count += len(ends)
                    out.append((path, state["generation"], first, low, seen + int(ends[-1]), charset))
                    low, first = seen + int(ends[-1]), line + count
                seen += len(block)
        state |= {"offset": low, "line": line + count, "seen": seen - seen % (2 if charset != "utf-8" else 1)}
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end, rows = dict(start), []
        for path in self._paths():
            try:
                with open(path, "rb") as f:
                    prefix = f.read(FINGERPRINT)
                    size = os.fstat(f.fileno()).st_size
                had = json.loads(start[path]) if path in start else None
                what = growth(had, size, prefix)
                if what == "same":
                    continue
                charset, mark, _ = charset_of(prefix)
                state = had if what == "appended" else {"offset": mark, "seen": mark, "line": 0, "generation": had["generation"] + 1 if had else 0}
                if state is not had and had:  # a rewrite shows even where it left no line
                    rows.append((path, state["generation"], 0, mark, mark, charset))
                rows += self._chunks(path, state, size, charset)
            except FileNotFoundError:
                continue
            marked = min(state["offset"], len(prefix))
            end[path] = json.dumps(state | {"marked": marked, "mark": hashlib.sha256(prefix[:marked]).hexdigest()})
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """What a batch handed out, again after a failure: the same bytes, unless the file was rewritten since."""
        rows: list[tuple] = []
        for path, now in end.items():
            if start.get(path) == now:
                continue
            to, had = json.loads(now), json.loads(start[path]) if path in start else None
            with open(path, "rb") as f:
                charset, mark, _ = charset_of(f.read(3))
            same = had is not None and had["generation"] == to["generation"]
            state = had if same else {"offset": mark, "seen": mark, "line": 0, "generation": to["generation"]}
            if not same and had:
                rows.append((path, to["generation"], 0, mark, mark, charset))
            while state["offset"] < to["offset"]:
                found = self._chunks(path, state, to["offset"], charset)
                if not found:
                    break
                rows += found
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """`lines_of(spark.readStream.format("tail").load(folder))`: terminated lines of a folder's .log and .out files, as they come.

    The source names chunks of whole lines (path, generation, first_line, from_byte, to_byte, charset), some CHUNK bytes
    each and `maxbytes` a file and batch; lines_of() reads them in tasks. A file that shrinks or whose beginning changes
    starts a new generation from its first line. An unfinished line waits for its end, however long it gets. The folder must
    be one that the driver and the executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("maxbytes", 64 * 1024 * 1024)))


def _chunk_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in batch.to_pylist():
            with open_file(c["path"]) as f:
                f.seek(c["from_byte"])
                block = f.read(c["to_byte"] - c["from_byte"])
            lines = block.decode(c["charset"], "replace").split("\n")[:-1]
            n = len(lines)
            yield pa.RecordBatch.from_arrays([pa.array([c["path"]] * n, pa.string()), pa.array([c["generation"]] * n, pa.int64()), pa.array(range(c["first_line"], c["first_line"] + n), pa.int64()), pa.array(lines, pa.string())], names=["path", "generation", "line_no", "raw"])


def lines_of(chunks: DataFrame) -> DataFrame:
    """path, generation, line_no, raw of the chunks that a tail source names, read where they are dealt to."""
    return chunks.repartition("path", "from_byte").mapInArrow(_chunk_lines, TAIL_SCHEMA)


def counts(lines: DataFrame, verdicts: DataFrame, formats: tuple[LogFormat, ...] = FORMATS, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """matched, scanned per file by the format already found; it is not found anew, so the ratio may fall."""
    n = detect.normalised(lines).where(~F.col("is_blank")).join(verdicts.where("outcome = 'matched'").select("path", "format"), "path")
    asked = {f.name: f"_p{i}" for i, f in enumerate(formats) if f.predicate is not None}
    if asked:
        n = n.select("*", *[f.predicate_test(F.when(F.col("format") == f.name, F.col("text"))).alias(asked[f.name]) for f in formats if f.name in asked])
    ok = F.lit(None).cast("boolean")
    for f in formats:
        test = f.record_test(F.col("text")) | f.continuation_test(F.col("text"))
        ok = F.when(F.col("format") == f.name, test | F.col(asked[f.name]) if f.name in asked else test).otherwise(ok)
    return n.withColumn("_ok", ok).groupBy(*keys).agg(F.count_if("_ok").alias("matched"), F.count("*").alias("scanned"))


def merged(*parts: DataFrame) -> DataFrame:
    """Counts added up, with the percentage in words."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = every.groupBy("path").agg(F.sum("matched").alias("matched"), F.sum("scanned").alias("scanned"))
    return total.withColumn("percent_text", detect.percent_text(F.col("matched"), F.col("scanned")))


def running_counts(stream: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A streaming frame of counts per file and generation, for output mode update or complete."""
    return counts(stream, verdicts, keys=("path", "generation"))


def followable(indexed: DataFrame) -> DataFrame:
    """path, follows, note: a file that is too large, failed to be read, or whose index stopped at a cap is not followed, and
    says so. indexed: path, and capped or outcome (too_large, failed) or both."""
    cannot = F.lit(False)
    if "capped" in indexed.columns:
        cannot = cannot | F.coalesce("capped", F.lit(False))
    if "outcome" in indexed.columns:
        cannot = cannot | F.coalesce(F.col("outcome").isin("too_large", "failed"), F.lit(False))
    return indexed.select("path", (~cannot).alias("follows"), F.when(cannot, TAIL_UNAVAILABLE).alias("note"))


_ENDS = "path string, generation long, line_no long, raw string"
_FACTS = ["path", "generation", "line_no", "raw", "format", "is_record", "level"]


def versions(spark: SparkSession, store: str, kind: str) -> int:
    """The newest finished version of a kind (`ends`, `base`), -1 if there is none. A version counts once its mark is written."""
    marks = f"{store}/{kind}_versions"
    spark.createDataFrame([], "version long").write.mode("ignore").parquet(marks)
    return spark.read.schema("version long").parquet(marks).agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]


def mark(spark: SparkSession, store: str, kind: str, version: int) -> None:
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{store}/{kind}_versions")


def stored(spark: SparkSession, where: str, schema: str, version: int) -> DataFrame:
    return spark.createDataFrame([], schema) if version < 0 else spark.read.schema(schema).parquet(where)


def facts_batch(store: str, verdicts: DataFrame):
    """A foreachBatch function that keeps facts of growing and rewritten files in parquet at `store`.

    A batch has lines (path, line_no, raw, and generation where files can be rewritten), or chunks of a tail source, whose lines
    are then read. Its facts, keyed (path, generation, line_no), go to facts/batch=N, classified with the file's last line
    before them, whose level may come from the first new line. ends/version=N has that last line and the newest generation
    of every file: a batch reads the version before it and no older one, so its work is its own lines and a row a file. A
    generation that is newer than a file's last one starts from nothing, and thereby buries what was there before, also where
    the file is rewritten as an empty one. A batch that is run again writes the same.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "generation" not in batch.columns:
            batch = batch.withColumn("generation", F.lit(0).cast("long"))
        chunked = "from_byte" in batch.columns
        seen = batch.select("path", "generation").distinct() if chunked else None
        lines = (lines_of(batch) if chunked else batch).select("path", "generation", "line_no", "raw")
        had_version = min(versions(spark, store, "ends"), batch_id - 1)
        before = stored(spark, f"{store}/ends/version={had_version}", _ENDS, had_version)
        newest = (seen or lines).groupBy("path").agg(F.max("generation").alias("newest"))
        # rows of generations that the same batch already replaces are not worth classifying
        lines = lines.join(newest, (lines["path"] == newest["path"]) & (lines["generation"] == newest["newest"]), "left_semi")
        top = lines.groupBy("path", "generation").agg(F.max_by(F.struct("line_no", "raw"), "line_no").alias("top"), F.min("line_no").alias("first"))
        last = before.join(top.select("path", "generation", "first"), ["path", "generation"]).where(F.col("line_no") == F.col("first") - 1).select("path", "generation", "line_no", "raw")
        classified = facts.line_facts(lines.unionByName(last).select("path", "line_no", "raw"), verdicts)
        classified.join(newest.withColumnRenamed("newest", "generation"), "path").select(*_FACTS).write.mode("overwrite").parquet(f"{store}/facts/batch={batch_id}")
        tops = top.select("path", "generation", "top.line_no", "top.raw")
        empty = newest.select("path", F.col("newest").alias("generation"), F.lit(-1).cast("long").alias("line_no"), F.lit("").alias("raw"))
        rows = before.unionByName(tops).unionByName(empty)
        # a file's newest generation, of it the last line
        kept = rows.groupBy("path").agg(F.max(F.struct("generation", "line_no", "raw")).alias("r")).select("path", "r.*")
        kept.write.mode("overwrite").parquet(f"{store}/ends/version={batch_id}")
        mark(spark, store, "ends", batch_id)

    return run


_FACT_KINDS = "path string, generation long, line_no long, raw string, format string, is_record boolean, level string"


def _rows(spark: SparkSession, store: str, base: int) -> DataFrame:
    """Facts of the base and of the batches behind it, with batch."""
    later = spark.read.schema(f"{_FACT_KINDS}, batch long").parquet(f"{store}/facts").where(F.col("batch") > base)
    return stored(spark, f"{store}/base/version={base}", _FACT_KINDS, base).withColumn("batch", F.lit(base).cast("long")).unionByName(later)


def latest_facts(spark: SparkSession, store: str) -> DataFrame:
    """path, line_no, raw, format, is_record, level of every file's newest generation; of a line that two batches have, the newer.

    Batches that have not finished are not looked at.
    """
    version, base = versions(spark, store, "ends"), versions(spark, store, "base")
    ends = stored(spark, f"{store}/ends/version={version}", _ENDS, version).select("path", "generation")
    rows = _rows(spark, store, base).where(F.col("batch") <= version).join(ends, ["path", "generation"], "left_semi")
    found = rows.groupBy("path", "line_no").agg(F.max_by(F.struct("raw", "format", "is_record", "level"), "batch").alias("f"))
    return found.select("path", "line_no", "f.*")


def compact(spark: SparkSession, store: str) -> int:
    """Writes the newest facts as one base, without what was rewritten; readers start from it. Gives the base's version.

    Batches up to the base, older bases and older ends are no longer read, and may be deleted once no reader holds them.
    """
    version, base = versions(spark, store, "ends"), versions(spark, store, "base")
    if version > base:
        ends = stored(spark, f"{store}/ends/version={version}", _ENDS, version).select("path", "generation")
        latest_facts(spark, store).join(ends, "path").select(*_FACTS).write.mode("overwrite").parquet(f"{store}/base/version={version}")
        mark(spark, store, "base", version)
    return version


_TOTALS = "path string, generation long, lines long, chars long"
_STARTS = "path string, generation long, line_no long, start_offset long, length long"


def index_batch(store: str, block: int = BLOCK):
    """A foreachBatch function that keeps line starts of growing and rewritten files in parquet at `store`.

    A batch has lines (path, line_no, raw, and generation where files can be rewritten), or chunks of a tail source. What is
    carried from batch to batch is two numbers a file, its lines and characters so far (totals/version=N); the new starts go to
    starts/batch=N. Offsets are running sums by blocks of lines, so one file's new lines are many tasks. Lines that a file
    already had are left out; a newer generation starts from nothing. A batch that is run again writes the same.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "generation" not in batch.columns:
            batch = batch.withColumn("generation", F.lit(0).cast("long"))
        chunked = "from_byte" in batch.columns
        newest = batch.groupBy("path").agg(F.max("generation").alias("generation"))
        lines = (lines_of(batch) if chunked else batch).select("path", "generation", "line_no", "raw").join(newest, ["path", "generation"], "left_semi")
        had = min(versions(spark, store, "totals"), batch_id - 1)
        before = stored(spark, f"{store}/totals/version={had}", _TOTALS, had)
        nothing = newest.select("path", "generation", F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("chars"))
        # of each file the newest generation, and what is known of it
        now = before.unionByName(nothing).groupBy("path").agg(F.max(F.struct("generation", "lines", "chars")).alias("t")).select("path", "t.*")
        fresh = lines.join(now.select("path", "generation", "lines"), ["path", "generation"]).where(F.col("line_no") >= F.col("lines")).select("path", "generation", "line_no", "raw")
        starts = index.extended(now, fresh.select("path", "line_no", "raw"), block).join(now.select("path", "generation"), "path")
        starts.select("path", "generation", "line_no", "start_offset", "length").write.mode("overwrite").parquet(f"{store}/starts/batch={batch_id}")
        ends = index.totals(spark.read.schema(_STARTS).parquet(f"{store}/starts/batch={batch_id}")).select("path", F.col("lines").alias("_lines"), F.col("chars").alias("_chars"))
        total = now.join(ends, "path", "left").select("path", "generation", F.coalesce("_lines", "lines").alias("lines"), F.coalesce("_chars", "chars").alias("chars"))
        total.write.mode("overwrite").parquet(f"{store}/totals/version={batch_id}")
        mark(spark, store, "totals", batch_id)

    return run


def latest_starts(spark: SparkSession, store: str) -> DataFrame:
    """path, line_no, start_offset, length of every file's newest generation, of finished batches."""
    version = versions(spark, store, "totals")
    now = stored(spark, f"{store}/totals/version={version}", _TOTALS, version).select("path", "generation")
    rows = spark.read.schema(f"{_STARTS}, batch long").parquet(f"{store}/starts").where(F.col("batch") <= version)
    return rows.join(now, ["path", "generation"], "left_semi").select("path", "line_no", "start_offset", "length")
