"""Bounded, encoding-aware reading of log files into lines (path, line_no, raw)."""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.carry import BLOCK, running_sum
from tidelog.operators.status import FAILED

LINES = "path string, line_no long, raw string"
MB = 1024 * 1024
#: (lines, bytes) of the quick first look and of the refinement that replaces it.
HEAD = (200, 512 * 1024)
REFINE = (2_000_000, 256 * MB)
SUFFIXES = ("log", "out")


def is_log_name(name: Column) -> Column:
    """Names that end in .log or .out, in any case; a bare `log` does not count."""
    return name.rlike(r"(?i)\.(?:" + "|".join(SUFFIXES) + r")\z")


def is_binary(content: Column) -> Column:
    """A NUL among the first 512 bytes of a file without a UTF-16 mark."""
    head = F.hex(F.substring(content, 1, 512))
    return head.rlike("^(?:..)*?00") & ~head.rlike("^(?:FFFE|FEFF)")


def charset(content: Column, fallback: str = "UTF-8") -> Column:
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head.startswith("EFBBBF"), "UTF-8").when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE").otherwise(fallback)


def decoded(content: Column, fallback: str = "UTF-8") -> Column:
    """The text without its byte-order mark; bytes that are none of the charset become replacement characters."""
    def text(cs: str, skip: int) -> Column:
        return F.decode(F.substring(content, skip + 1, 2**31 - 1 - skip), cs)

    head = F.hex(F.substring(content, 1, 3))
    plain = F.coalesce(F.try_validate_utf8(content.cast("string")), text(fallback, 0)) if fallback == "UTF-8" else text(fallback, 0)
    return F.when(head.startswith("EFBBBF"), F.substring(content, 4, 2**31 - 5).cast("string")).when(head.startswith("FFFE"), text("UTF-16LE", 2)).when(head.startswith("FEFF"), text("UTF-16BE", 2)).otherwise(plain)


def gated(f: DataFrame, max_size: int | None = None) -> DataFrame:
    """path, size, outcome (ok, too_large, binary, not_a_log), content (null unless ok) of files (path, length, content).

    Names and sizes are looked at first, as filters on them reach the listing: content of files that are out is never read.
    """
    name = F.element_at(F.split("path", "/"), -1)
    fits = F.lit(True) if max_size is None else F.col("length") <= max_size
    size = F.col("length").alias("size")
    no_content = F.lit(None).cast("binary").alias("content")
    out = f.where(~(is_log_name(name) & fits)).select("path", size, F.when(~is_log_name(name), "not_a_log").otherwise("too_large").alias("outcome"), no_content)
    inside = f.where(fits).where(is_log_name(name)).withColumn("outcome", F.when(is_binary(F.col("content")), "binary").otherwise("ok"))
    return out.unionByName(inside.select("path", size, "outcome", F.when(F.col("outcome") == "ok", F.col("content")).alias("content")))


def files(spark: SparkSession, path: str | list[str], max_size: int | None = None) -> DataFrame:
    """gated() of the files under path. Without max_size, files of more than 2 GB can't be read as one value: use read_lines()."""
    return gated(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), max_size)


def split_lines(docs: DataFrame, text: str = "text", final_empty: bool = True) -> DataFrame:
    """path, line_no, raw of whole texts. With final_empty a text that ends in a newline has an empty last line."""
    parts = F.split(F.col(text), "\n", -1)
    if not final_empty:
        parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select("path", F.posexplode(parts).alias("line_no", "raw")).select("path", F.col("line_no").cast("long").alias("line_no"), "raw")


def read_documents(spark: SparkSession, path: str | list[str], fallback: str = "UTF-8") -> DataFrame:
    """path, text of small files, line ends made '\\n'."""
    f = files(spark, path).where("outcome = 'ok'")
    return f.select("path", F.regexp_replace(decoded(F.col("content"), fallback), "\r\n?", "\n").alias("text"))


def _listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, length of the log files under path; their content is not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return f.where(is_log_name(F.element_at(F.split("path", "/"), -1)))


def open_file(path: str):
    """A file by its URI, in any store that pyarrow knows."""
    fs, where = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(where)


_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def _charsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            with open_file(path) as f:
                head = f.read(512)
            found.append(next((name for mark, name in _MARKS if head.startswith(mark)), "binary" if b"\0" in head else "none"))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], names=["path", "charset"])


def _numbered(spark: SparkSession, path: str | list[str], charset: str, fallback: str, every_name: bool) -> DataFrame:
    """Lines of files of one charset, numbered without gathering a file in one task.

    The text source splits files into blocks; a first pass counts each block's lines, their running sum gives each
    block's first number, and a second pass adds it. Blocks are as many as splits, far fewer than lines.
    """
    wide, known = charset.startswith("utf-16"), charset.upper().replace("UTF-16-", "UTF-16")
    source = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    raw = (source.option("encoding", known) if wide else source).text(path)
    if not every_name:  # a filter on the listing: other files are not opened
        raw = raw.where(is_log_name(F.col("_metadata.file_name")))
    bytes_ = F.col("value").cast("binary")
    if wide:
        value = F.decode(bytes_, known)
    else:
        value = F.make_valid_utf8("value") if fallback.upper() == "UTF-8" else F.coalesce(F.try_validate_utf8("value"), F.decode(bytes_, fallback))
    base = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), value.alias("raw")
    ).withColumn("part", F.shiftright("id", 33)).withColumn("seq", F.col("id").bitwiseAND(F.lit(2**33 - 1)))
    blocks = base.groupBy("path", "block", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("path", "block", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    lines = base.join(offsets, ["path", "block", "part"]).select("path", (F.col("before") + F.col("seq") - F.col("first")).alias("line_no"), "raw")
    return lines.withColumn("raw", F.when((F.col("line_no") == 0) & F.startswith("raw", F.lit("\ufeff")), F.substring("raw", 2, 2**31 - 1)).otherwise(F.col("raw")))


def read_lines(spark: SparkSession, path: str | list[str], fallback: str = "UTF-8", every_name: bool = False) -> DataFrame:
    """path, line_no, raw of log files of any size and of the charset that their mark names, else of the fallback.

    Files whose name is no log's are not listed (every_name: they are), binary ones are left out. Tasks look at each file's
    first bytes; files in UTF-16 are read apart, by newlines of their own width. Their paths are among those that the
    driver lists for reading anyway.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path") if every_name else _listed(spark, path)
    marked = listed.select("path").mapInArrow(_charsets, "path string, charset string")
    wide = marked.where("charset <> 'none'").collect()
    lines = _numbered(spark, path, "utf-8", fallback, every_name)
    if not wide:
        return lines
    apart = spark.createDataFrame(wide, "path string, charset string")
    out = lines.join(apart, "path", "left_anti")
    for charset in sorted({r["charset"] for r in wide} - {"binary"}):
        out = out.unionByName(_numbered(spark, [r["path"] for r in wide if r["charset"] == charset], charset, fallback, True))
    return out


_HEAD = "path string, line_no long, raw string, has_more_lines boolean, hit_bytes boolean"


def read_heads(spark: SparkSession, path: str | list[str], max_lines: int, max_bytes: int, fallback: str = "UTF-8") -> DataFrame:
    """The first lines of log files within both caps: reading stops at the byte cap, however long a file is.

    A line that the byte cap cuts is dropped, as is one that the file's end leaves without newline behind it; a file that
    fits as a whole keeps its last line. A mark's bytes count. Flags as in bounded().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_file(path) as f:
                    raw = f.read(max_bytes + 1)
                cut = len(raw) > max_bytes
                raw = raw[:max_bytes]
                mark, charset = next(((m, c) for m, c in _MARKS if raw.startswith(m)), (b"", fallback))
                lines = raw[len(mark) :].decode(charset, "replace").split("\n")
                if cut or lines[-1] == "":
                    lines.pop()
                more = len(lines) > max_lines
                kept = lines[:max_lines]
                n = len(kept)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(kept, pa.string()), pa.array([more] * n, pa.bool_()), pa.array([cut and not more] * n, pa.bool_())], names=["path", "line_no", "raw", "has_more_lines", "hit_bytes"])

    return _listed(spark, path).mapInArrow(run, _HEAD)


_CAPPED = "path string, line_no long, raw string, has_more_lines boolean, hit_bytes boolean, error string"
#: Bytes that a capped read takes at a time.
_STEP = 4 * MB


def _capped_lines(path: str, max_lines: int, max_bytes: int, fallback: str) -> Iterator[tuple[int, list[str], bool, bool]]:
    """(first number, lines, has_more_lines, hit_bytes) of a file, step by step; the flags are those of the last step."""
    with open_file(path) as f:
        head = f.read(min(_STEP, max_bytes + 1))
        mark, charset = next(((m, c) for m, c in _MARKS if head.startswith(m)), (b"", fallback))
        if not charset.lower().startswith("utf-16") and b"\0" in head[:512]:
            raise ValueError("binary")
        decode = codecs.getincrementaldecoder(charset)("replace").decode
        seen, block, rest, n = len(head), head[len(mark) :], "", 0
        while True:
            over = seen > max_bytes
            if over:
                block = block[: len(block) - (seen - max_bytes)]
            final = over or not head
            lines = (rest + decode(block, final)).split("\n")
            rest = lines.pop()
            if final and not over and rest:  # the file's end closes its last line
                lines.append(rest)
            more = n + len(lines) > max_lines
            lines = lines[: max_lines - n]
            if lines or final or more:
                yield n, lines, more, final and over and not more
            if final or more:
                return
            n += len(lines)
            head = block = f.read(min(_STEP, max_bytes + 1 - seen))
            seen += len(block)


def capped(paths: DataFrame, max_lines: int, max_bytes: int, fallback: str = "UTF-8") -> DataFrame:
    """path, line_no, raw of the files named (column path), each read once and no further than both caps.

    After a file's lines comes a row without line_no that says how the reading ended: has_more_lines, hit_bytes as in bounded(),
    error where the file could not be read (or is `binary`). A failure is a row and stops no other file. Memory is a few MB
    unless one line is longer.
    """

    def rows(path: str, n: int, lines: list[str], more: bool | None, cut: bool | None, error: str | None, number: bool) -> pa.RecordBatch:
        k = len(lines) if number else 1
        numbers = pa.array(range(n, n + k), pa.int64()) if number else pa.nulls(1, pa.int64())
        texts = pa.array(lines, pa.string()) if number else pa.nulls(1, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([path] * k, pa.string()), numbers, texts, pa.array([more] * k, pa.bool_()), pa.array([cut] * k, pa.bool_()), pa.array([error] * k, pa.string())], names=["path", "line_no", "raw", "has_more_lines", "hit_bytes", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                more = cut = False
                error = None
                try:
                    for n, lines, more, cut in _capped_lines(path, max_lines, max_bytes, fallback):
                        if lines:
                            yield rows(path, n, lines, None, None, None, True)
                except (OSError, ValueError, pa.ArrowException) as e:
                    error = str(e) if str(e) == "binary" else type(e).__name__
                yield rows(path, 0, [], more, cut, error, False)

    return paths.select("path").mapInArrow(run, _CAPPED)


def detect_files(spark: SparkSession, path: str | list[str], head: tuple[int, int] = HEAD, refine: tuple[int, int] = REFINE, fallback: str = "UTF-8") -> DataFrame:
    """detect.two_phase() of the log files under path: a quick look at all, a long one at those it did not finish.

    Spark's listing leaves out empty files; capped() reads them where their paths are given.
    """
    from tidelog.operators import detect

    return detect.two_phase(capped(_listed(spark, path), *head, fallback), lambda paths: capped(paths.repartition("path"), *refine, fallback))


def bounded(lines: DataFrame, max_lines: int, max_bytes: int, sizes: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """lines within both caps, with has_more_lines and hit_bytes: whether a cap cut the file.

    A line counts only with its newline inside the byte cap; sizes (path, size) lets a file that fits as a whole keep
    an unterminated last line. For lines that are there already; read_heads() stops reading at the cap.
    """
    size = F.octet_length("raw") + 1
    ends = running_sum(lines, size, "_before", block).withColumn("_end", F.col("_before") + size)
    whole = lines.groupBy("path").agg((F.sum(size) - 1).alias("_size"))
    if sizes is not None:
        whole = whole.drop("_size").join(sizes.select("path", F.col("size").alias("_size")), "path", "left")
    inside = (F.col("_size") <= max_bytes) | (F.col("_end") <= max_bytes)
    ends = ends.join(whole, "path")
    counted = ends.where(inside).groupBy("path").agg(F.count("*").alias("_inside"))
    return ends.where(inside & (F.col("line_no") < max_lines)).join(counted, "path").select(
        *lines.columns, (F.col("_inside") > max_lines).alias("has_more_lines"), ((F.col("_size") > max_bytes) & (F.col("_inside") <= max_lines)).alias("hit_bytes")
    )


def byte_text(n: int) -> str:
    """A byte cap in words: whole GB or MB, else KB rounded down, else bytes."""
    for unit, name in ((1024 * MB, "GB"), (MB, "MB")):
        if n >= unit and n % unit == 0:
            return f"{n // unit:,} {name}"
    return f"{n // 1024:,} KB" if n >= 1024 else f"{n:,}-byte"


def cap_note(has_more_lines: Column, hit_bytes: Column, max_lines: int, max_bytes: int) -> Column:
    """What a scan says about its caps; the line cap's note comes first."""
    return F.when(has_more_lines, f"scan covered the first {max_lines:,} lines").when(hit_bytes, f"scan stopped at the {byte_text(max_bytes)} byte cap")


def missing(wanted: DataFrame, seen: DataFrame) -> DataFrame:
    """path, outcome 'failed', reason of the wanted paths (column path) that no read produced."""
    return wanted.select("path").join(seen.select("path").distinct(), "path", "left_anti").select("path", F.lit("failed").alias("outcome"), F.lit(FAILED).alias("reason"))


def failures(spark: SparkSession, wanted: Iterable[str], seen: DataFrame) -> DataFrame:
    """missing() of a list of paths."""
    return missing(spark.createDataFrame([(p,) for p in wanted], "path string"), seen)
