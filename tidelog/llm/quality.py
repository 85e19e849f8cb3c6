"""Quality rules: lines that many documents of a host share are removed, and documents with too little left are rejected.

A line is normalised (lower case, digits to 0, white space to single blanks, trimmed) and hashed. Per host (the source
column, null being a host of its own) distinct documents are counted for every line, and in all; exact copies count once
in both, so that copies of one document do not make its own lines look like boilerplate. Lines above both limits are
removed from the text; a document is rejected when it fails the base rules, or when fewer than MIN_LEFT of its words are
left.

Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. Blank lines are never
counted or removed. Counts cover the whole table; grouped sums are pre-aggregated before each shuffle, so a host with a
third of all rows does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import SPACE, WORD, frugal, materialise, mix, prefix_hashes, table, text_buffers, text_chunks, text_hashes, word_spans

#: A line is boilerplate of a host if more distinct documents than this hold it ...
MIN_DOCS = 20
#: ... and more than this part of the host's documents.
MAX_SHARE = 0.02
#: The part of its words that a document must keep.
MIN_LEFT = 0.5
MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = b"#*$%&|<>"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; the plain model of base_table()."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split()]
    seen: dict[tuple, int] = {}
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), len(covered)


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_NO_CHAR = SPACE.copy()
_NO_CHAR[0x80:0xC0] = True  # bytes that continue a code point


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items (owner, key): whether it occurs twice or more in its owner, and whether it follows an equal one."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    again = np.zeros(len(k), bool)
    again[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    twice = np.zeros(len(k), bool)
    twice[order] = both
    return twice, again


def _equal_before(data: np.ndarray, heads: np.ndarray, tails: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether an equal line of the same text comes before; lines with equal keys are compared byte by byte."""
    again = _repeated(keys, owner)[1]
    order = np.lexsort((keys, owner))
    at = np.flatnonzero(again[order])
    a, b = heads[order[at]], heads[order[at - 1]]
    size = tails[order[at]] - a
    if (size == tails[order[at - 1]] - b).all():
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if (data[np.repeat(a, size) + inside] == data[np.repeat(b, size) + inside]).all():
            return again
    seen: set = set()
    out = np.zeros(len(heads), bool)
    for i, line in enumerate(zip(owner.tolist(), (data[x:y].tobytes() for x, y in zip(heads, tails, strict=True)), strict=True)):
        out[i] = line in seen
        seen.add(line)
    return out


def chunk_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """base_counts() of many texts at once. Lines and windows are compared by 64-bit hashes."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    chars = _sums(~_NO_CHAR[data], offsets)
    symbols = _sums(_IS_SYMBOL[data], offsets)
    prefix = prefix_hashes(data)
    owner = np.repeat(np.arange(n), n_words)
    # lines with a word
    breaks = np.flatnonzero(data == 10)
    heads = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    heads = heads[heads < len(data)]
    line_of = np.searchsorted(heads, starts, side="right") - 1
    used = np.unique(line_of)
    tails = np.append(heads[1:], len(data))[used] if len(heads) else heads
    heads = heads[used] if len(heads) else heads
    line_owner = np.searchsorted(offsets, heads, side="right") - 1
    ended = (tails > 0) & (data[np.maximum(tails - 1, 0)] == 10) if len(tails) else np.zeros(0, bool)
    tails = tails - ended
    keys = text_hashes(prefix, heads, tails)
    dup = np.bincount(line_owner[_equal_before(data, heads, tails, line_owner, keys)], minlength=n)[:n] if len(keys) else np.zeros(n, np.int64)
    # three-word windows
    h = text_hashes(prefix, starts, ends)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        w = mix(h[:-2]) + mix(h[1:-1] * np.uint64(3)) + mix(h[2:] * np.uint64(7))
        at = np.flatnonzero(owner[:-2] == owner[2:])
        twice, _ = _repeated(w[at], owner[at])
        hit = at[twice]
        for k in range(3):
            covered[hit + k] = True
    repeat = np.bincount(owner[covered], minlength=n)[:n] if len(h) else np.zeros(n, np.int64)
    return [x.astype(np.int64) for x in (n_words, chars, symbols, dup, repeat)]


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


#: Own columns beside those of the documents, so that no name of theirs clashes.
OWN = "__quality_"


def base_table(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, and with the prefix OWN: whole (what tells texts apart), id, the base counts; row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column("text"))
            parts = [chunk_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in text_chunks(offsets)]
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c) for c in cols)], names=[*names, *(OWN + c for c in _BASE)])

    names = [*keep, f"{OWN}whole", f"{OWN}id"]
    own = docs.withColumn(f"{OWN}whole", _whole()).withColumn(f"{OWN}id", F.col("doc_id"))
    schema = own.select(*names).schema
    for c in _BASE:
        schema = schema.add(OWN + c, "long")
    return own.select(*dict.fromkeys([*names, "text"])).mapInArrow(frugal(run), schema)


def base_failed(words: Column, repeated: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeated > int(100 * MAX_REPEATED) * words)


def _whole() -> Column:
    """128 bits that tell texts apart: copies share them. A null text is an empty one."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def keyed_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, whole, host, pos, key, words): lines that hold a word; key: 128 bits of the normalised line. Written once,
    as the counts and the removal both read it; it holds no text."""
    one = docs.select("doc_id", _whole().alias("whole"), F.col("source").alias("host"), F.split(F.col("text"), "\n", -1).alias("lines"))
    each = one.select("doc_id", "whole", "host", F.posexplode("lines").alias("pos", "line")).withColumn("words", F.regexp_count("line", F.lit(WORD))).where("words > 0")
    return materialise(each.select("doc_id", "whole", "host", "pos", F.unhex(F.md5(normalised(F.col("line")))).alias("key"), "words"), "quality-lines")


def _distinct(rows: DataFrame, *key: str) -> DataFrame:
    """Rows (*key, n): distinct documents of each key, in two steps, so that no key's rows meet in one task."""
    return rows.groupBy(*key, "whole").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("*").alias("n"))


def common_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (host, key): lines above both limits among the host's distinct documents."""
    per_line = _distinct(lines, "host", "key").withColumnRenamed("n", "n_docs")
    hosts = _distinct(docs.select(F.col("source").alias("h"), _whole().alias("whole")), "h").withColumnRenamed("n", "host_docs")
    return per_line.where(F.col("n_docs") > MIN_DOCS).join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n_docs") > MAX_SHARE * F.col("host_docs")).select("host", "key")


def removed_words(docs: DataFrame) -> DataFrame:
    """Rows (d, w, n_removed, places): words in lines above the limits and where those lines stand; documents without any are absent."""
    lines = keyed_lines(docs)
    bad = common_lines(docs, lines).select(F.col("host").alias("h"), F.col("key").alias("k"))
    hit = lines.join(bad, (F.col("key") == F.col("k")) & F.col("host").eqNullSafe(F.col("h")))
    once = hit.groupBy("doc_id", "whole", "host", "pos").agg(F.max("words").alias("words"))  # rows may repeat
    return once.groupBy(F.col("doc_id").alias("d"), F.col("whole").alias("w"), F.col("host").alias("h")).agg(F.sum("words").cast("long").alias("n_removed"), F.collect_list("pos").alias("places"))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, and with the prefix OWN: the base counts, base_failed, n_removed, places (of lines to remove), kept."""
    def own(name: str) -> Column:
        return F.col(OWN + name)

    gone = removed_words(docs).select(*[F.col(c).alias(f"{OWN}gone_{c}") for c in ("d", "w", "h", "n_removed", "places")])
    base = base_table(docs.withColumn(f"{OWN}host", F.col("source")), [*keep, f"{OWN}host"]).withColumn(f"{OWN}base_failed", base_failed(own("n_words"), own("n_repeat_words")))
    both = base.join(gone, own("id").eqNullSafe(own("gone_d")) & (own("whole") == own("gone_w")) & own("host").eqNullSafe(own("gone_h")), "left")
    both = both.withColumn(f"{OWN}n_removed", F.coalesce(own("gone_n_removed"), F.lit(0)).cast("long")).withColumn(f"{OWN}places", own("gone_places"))
    return both.withColumn(f"{OWN}kept", ~own("base_failed") & (own("n_words") - own("n_removed") >= MIN_LEFT * own("n_words")))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed, kept; one row per row of docs."""
    return judged(docs, ["doc_id"]).select("doc_id", *[F.col(OWN + c).alias(c) for c in (*_BASE, "base_failed", "n_removed", "kept")])


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without the lines above the limits; n_chars, if there, follows."""
    j = judged(docs, docs.columns).where(F.col(f"{OWN}kept"))
    left = F.filter(F.split(F.col("text"), "\n", -1), lambda _, i: ~F.array_contains(F.col(f"{OWN}places"), i))
    out = j.withColumn("text", F.when(F.col(f"{OWN}places").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


_W = r"[^\x20\x09-\x0D]+"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
raw AS (SELECT doc_id, host, md5(text) AS whole, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, host, whole, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS key,
          len(regexp_extract_all(line, '{_W}')) AS words FROM raw WHERE regexp_matches(line, '{_W}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
per AS (SELECT host, key, count(DISTINCT whole) AS n FROM lines GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
bad AS (SELECT per.host, per.key FROM per JOIN hosts ON per.host IS NOT DISTINCT FROM hosts.host WHERE per.n > {MIN_DOCS} AND per.n > {MAX_SHARE}::DOUBLE * hosts.n),
gone AS (SELECT doc_id, sum(words) AS n FROM lines JOIN bad ON lines.key = bad.key AND lines.host IS NOT DISTINCT FROM bad.host GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEATED)} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEATED)} * n_words) AND n_words - n_removed >= {MIN_LEFT}::DOUBLE * n_words AS kept
FROM b"""
