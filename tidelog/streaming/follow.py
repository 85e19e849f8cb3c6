"""Following files by proof: what was consumed is read again in tasks and compared by digests, so an append is known, not guessed.

A file's bytes are blocks of BLOCK_BYTES. advance() lists the folder, picks the files whose size or time has changed, and
deals their blocks to tasks. Each task reads its block once: the digest of what was consumed of it before, the digest of
all it has now, and its newlines. A file grew if it is no shorter and every old digest still holds; else it is a new
generation, wherever in it the change lies. Line numbers are prefix sums of the blocks' newlines, a row a block. The driver
opens no log; a file of any size is many tasks, and rows that meet are digests and counts.

What advance() knows lies in the store, by version: files/version=N has every file, blocks/version=N the digests of those that
changed in N. A version is made from the one before and counts once its mark is written, so one that fails is made again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.sources.reader import is_log_name, open_file
from tidelog.streaming.tail import CHUNK_SCHEMA, charset_of, mark, newlines, stored, versions

#: A multiple of all code units' widths.
BLOCK_BYTES = 8 * 1024**2
_FILES = "path string, generation long, size long, stamp timestamp, version long"
_BLOCKS = "path string, block long, n_bytes long, digest string"
_READ = "path string, block long, n_bytes long, digest string, was string, newlines long, last_end long, old_newlines long, old_end long, charset string, mark long"


def listed(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """path, size, stamp of the log files under folder, without their content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.where(is_log_name(F.element_at(F.split("path", "/"), -1))).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("stamp"))


def _read_blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                with open_file(b["path"]) as f:
                    charset, skip, _ = charset_of(f.read(3))
                    f.seek(b["block"] * block_bytes)
                    body = f.read(b["n_bytes"])
                known = b["known"] or 0
                ends, old = newlines(body, charset), newlines(body[:known], charset)
                at = b["block"] * block_bytes
                row = {
                    "path": b["path"], "block": b["block"], "n_bytes": len(body), "digest": hashlib.sha256(body).hexdigest(), "was": hashlib.sha256(body[:known]).hexdigest() if known and len(body) >= known else None,
                    "newlines": len(ends), "last_end": at + int(ends[-1]) if len(ends) else None,
                    "old_newlines": len(old), "old_end": at + int(old[-1]) if len(old) else None, "charset": charset, "mark": skip,
                }
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return run


_ARROW = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("was", pa.string()), ("newlines", pa.int64()), ("last_end", pa.int64()), ("old_newlines", pa.int64()), ("old_end", pa.int64()), ("charset", pa.string()), ("mark", pa.int64())])


def advance(spark: SparkSession, store: str, folder: str | list[str], version: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Chunks of whole lines (as a tail source names them) that are new in the folder since the version before.

    version: the number of this step, the next one unless given; a step that is given again is made again from the same
    version before it, over the folder as it is now. A rewritten file comes as a new generation, from its first line, and as an
    empty chunk where no line is left. Lines wait for their newline. Files that are gone keep their last state.
    """
    before = versions(spark, store, "files")
    version = before + 1 if version is None else version
    before = min(before, version - 1)
    old = stored(spark, f"{store}/files/version={before}", _FILES, before)
    now = listed(spark, folder)
    was = old.select(F.col("path").alias("_p"), "generation", F.col("size").alias("seen"), F.col("stamp").alias("_stamp"), F.col("version").alias("_at"))
    both = now.join(was, F.col("path") == F.col("_p"), "left")
    changed = both.where(F.col("_p").isNull() | (F.col("size") != F.col("seen")) | (F.col("stamp") != F.col("_stamp"))).drop("_p", "_stamp").persist()
    of = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("size") - 1) / block_bytes), F.lit(0)).cast("long")))
    asked = changed.select("path", of.alias("block"), "size").select("path", "block", F.least(F.lit(block_bytes).cast("long"), F.col("size") - F.col("block") * block_bytes).alias("n_bytes"))
    blocks = stored(spark, f"{store}/blocks", f"{_BLOCKS}, version long", before).where(F.col("version") <= before)
    known = blocks.join(changed.select(F.col("path").alias("_p"), "_at"), (F.col("path") == F.col("_p")) & (F.col("version") == F.col("_at")))
    known = known.select("path", "block", F.col("n_bytes").alias("known"), F.col("digest").alias("held"))
    read = asked.join(known.select("path", "block", "known"), ["path", "block"], "left").repartition("path", "block").mapInArrow(_read_blocks(block_bytes), _READ)
    target = f"{store}/blocks/version={version}"
    read.write.mode("overwrite").parquet(target)
    read = spark.read.schema(_READ).parquet(target)
    # grown: every digest that was held is there again
    held = known.join(read.select("path", "block", "was"), ["path", "block"], "left").groupBy("path").agg(F.bool_and(F.coalesce(F.col("was") == F.col("held"), F.lit(False))).alias("_same"))
    state = changed.join(held, "path", "left").withColumn("_grew", (F.col("size") >= F.col("seen")) & F.coalesce("_same", F.lit(True)))
    state = state.withColumn("generation", F.when(F.col("seen").isNull(), F.lit(0)).when(F.col("_grew"), F.col("generation")).otherwise(F.col("generation") + 1).cast("long"))
    own = state.select("path", "generation", "size", "stamp", F.lit(version).cast("long").alias("version"))
    rest = old.join(own.select("path"), "path", "left_anti")
    own.unionByName(rest).write.mode("overwrite").parquet(f"{store}/files/version={version}")
    chunks = _chunks(read, state.select("path", "generation", (F.col("seen").isNotNull() & F.col("_grew")).alias("grew"), F.col("seen").isNotNull().alias("had")))
    chunks.write.mode("overwrite").parquet(f"{store}/chunks/version={version}")
    changed.unpersist()
    mark(spark, store, "files", version)
    return spark.read.schema(CHUNK_SCHEMA).parquet(f"{store}/chunks/version={version}")


def _chunks(read: DataFrame, state: DataFrame) -> DataFrame:
    """From blocks' newlines the chunks of whole lines: numbers and starts are running sums and maxima over a file's blocks.

    In a file that grew, lines that had ended before are not new; a block that is half of them is cut behind the last.
    """
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("_first", F.coalesce(F.sum("newlines").over(ahead), F.lit(0))).withColumn("_from", F.max("last_end").over(ahead)).join(state, "path")
    had = F.when(F.col("grew"), F.col("old_newlines")).otherwise(F.lit(0))
    new = placed.where(F.col("newlines") > had).select(
        "path", "generation", (F.col("_first") + had).alias("first_line"), F.coalesce(F.when(F.col("grew"), F.col("old_end")), "_from", "mark").alias("from_byte"), F.col("last_end").alias("to_byte"), "charset"
    )
    gone = placed.where("block = 0 and had and not grew").select("path", "generation", F.lit(0).cast("long").alias("first_line"), F.col("mark").alias("from_byte"), F.col("mark").alias("to_byte"), "charset")
    return new.unionByName(gone)
