"""What the corpus operators share: tables, the shared work folder, word hashing and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on, so that temporaries stay small however large the batch is.
CHUNK_BYTES = 1_000_000

#: Unsigned CRC-32 of a decimal text, bit by bit.
CRC32_SQL = (
    "xor(4294967295, list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: "
    "list_reduce([xor(a, b)] || range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share; one of our own only in local mode where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended before its exit hooks run
        pass


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and no executor holds the only copy."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove what materialise() wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def placed(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's place in its group: tree (a number of the group, ascending with it), idx (from 0), n (its rows).

    Rows are dealt by ranges of group and order, so a group of any size is spread; only counts for each part of a group are
    windowed. Rows that tie in all of it stand in any order. Nulls come first.
    """
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order]
    at = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    own = [F.col(g) for g in group]
    counts = at.groupBy(part.alias("_part"), *own).agg(F.count("*").alias("_rows"), F.min("_at").alias("_low"))
    whole = Window.partitionBy(*own)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_low").alias("_l"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"), F.min("_low").over(whole).alias("tree"),
    )
    same = part == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return at.join(counts, same).select(*df.columns, "tree", (F.col("_before") + F.col("_at") - F.col("_l")).alias("idx"), "n")


def release(spark: SparkSession, pause: float = 0) -> None:
    """Have the driver find plans that nothing refers to any more, so that their shuffle files go.

    pause: seconds for the listeners to let go of the plan that has just ended; without it that plan's files stay.
    """
    gc.collect()
    time.sleep(pause)
    spark._jvm.System.gc()


def frugal(fn):
    """fn over batches; when a task ends, its worker gives memory that it no longer uses back to the machine."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                try:
                    ctypes.CDLL(None).malloc_trim(0)
                except (AttributeError, OSError):  # another C library
                    pass

    return run


def words_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def text_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer text is a range of its own and stays whole."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


_RNG = np.random.default_rng(0x5EED)
#: A random 64-bit value per byte and an odd base: prefix polynomial hashes modulo 2**64.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: A second hash, independent of the first: other values, another base.
OTHER_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OTHER_BASE = np.uint64(0xD1342543DE82EF95)
OTHER_INVERSE = np.uint64(pow(int(OTHER_BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[tuple[bool, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False, other: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) modulo 2**64 for i < n; other: of the second hash."""
    key = (inverse, other)
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = ((BASE, INVERSE), (OTHER_BASE, OTHER_INVERSE))[other][inverse]
        have = np.full(max(n, 4 * CHUNK_BYTES // 3), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray, other: bool = False) -> np.ndarray:
    """P with P[j] - P[i] = sum of value(byte k) * BASE**k over i <= k < j; other: of the second hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = (OTHER_VALUES if other else BYTE_VALUES)[data]
    values *= powers(len(data), other=other)
    np.cumsum(values, out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, other: bool = False) -> np.ndarray:
    """Position-free hash of data[start:end] for arrays of starts and ends; equal bytes give equal hashes."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), True, other)[start]


#: Bytes of a text that one polynomial covers in text_hashes().
PIECE = 32


def text_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of data[start:end], also of texts made to collide.

    A polynomial modulo 2**64 gives long texts of a regular build equal hashes (a word of a Thue-Morse sequence and its
    complement, from 1,024 bytes on, whatever base and values are). So polynomials cover PIECE bytes, where they can't, and
    their values are mixed with their place and length before they are summed.
    """
    length = end - start
    pieces = np.maximum(-(-length // PIECE), 1)
    first = np.cumsum(pieces) - pieces
    which = np.repeat(np.arange(len(start)), pieces)
    place = np.arange(len(which)) - first[which]
    a = start[which] + place * PIECE
    b = np.minimum(a + PIECE, end[which])
    h = mix(range_hashes(prefix, a, b) + (b - a).astype(np.uint64))
    h = mix(h ^ mix(place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)))
    total = np.add.reduceat(h, first) if len(h) else h
    return mix(total + length.astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (n + 1). Words never cross texts."""
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b), longs: rows (id, component) with component the smallest reachable id.

    Alternating large-star and small-star contraction: each round joins every vertex's neighbours to their smallest
    one by grouped minima, so neither a hub nor a long chain meets in one task. Each round is a written table; rounds
    end when no edge changes. Vertices without edges are absent; self-loops keep a vertex present.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, name)
    before = None
    for _ in range(rounds):
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = e.where("u <> v").select("u", "v").union(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = e.where("u = v")
        large = large.union(loops).distinct()
        # small star: smaller neighbours of u, and u itself, go to the smallest of them
        down = large.where("u <> v")
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialise(small.union(low2.select("u", F.col("m").alias("v"))).union(loops).distinct(), name)
        now = nxt.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop(e)
        e = nxt
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).groupBy("id").agg(F.min("component").alias("component"))
