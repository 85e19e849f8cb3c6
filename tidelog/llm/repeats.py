"""Suffix-array dedup: every byte covered by a LENGTH-byte string that also starts earlier is removed.

Earlier is: in a document of smaller doc_id, or in the same document at an earlier start. Strings are judged on the
input; matches never cross documents. The work is dealt out so that equal strings meet without any suffix leaving its
text until it must:

1. The anchor of a LENGTH-byte window is its leftmost ANCHOR-byte gram of smallest hash, so equal windows have equal
   anchors. Consecutive windows with the same anchor are one span: some 170 bytes, one for every 35 bytes of text. Prefix
   polynomial hashes give the gram and span hashes of all positions at once.
2. Anchors are counted; spans of anchors that occur once are done. The rest meet by content: of spans with equal content
   (anchor, and two independent 64-bit hashes of bytes and place of the anchor) the earliest stays, the others are removed
   whole. They are ranked by one exchange, after each block of texts has kept its earliest, so a passage that every tenth
   document holds is a row for each megabyte of text and no task of its own. That two of n spans of other bytes agree in
   both hashes has odds of n * n / 2**129.
3. Where an anchor has spans of several contents, the bytes of one of each are fetched and their windows suffix-sorted: a
   mergesort whose comparisons find the common extension by binary search over prefix hashes and then look at the next
   byte. Windows whose hash no other one at the same distance from the anchor has can't be repeated and are left out of
   it. Neighbours of equal hash are compared byte by byte; if hashes collided, the group is sorted by its bytes.
4. An anchor with more than MOST_SPANS contents (a passage that many documents go on from differently) is sorted in runs
   of about so many. The windows that are first in their run are ranked over the runs by 128 bits of hashes of their bytes.
5. The removed ranges of each document are merged and cut out of its text.

Null and empty texts have no bytes. Rows that repeat a doc_id and a text are one document and get the same result; rows
with one doc_id and different texts are ordered by a hash of the text. A null doc_id comes after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import drop, frugal, materialise, mix, powers, prefix_hashes, range_hashes, release, table, text_buffers, text_chunks, text_hashes

LENGTH = 100
ANCHOR = 32
MOST_SPANS = 4_000
#: Spans that one vectorised sort takes, whole groups at a time.
SORT_SPANS = 20_000
#: Windows whose anchors are sought at once; with a window's width it stays under 2**16.
BLOCK = 2**15
#: Rows without doc_id come last: their texts are told apart by 40 bits here and 32 in x.
_LAST = 2**63 - 1


def runs(prefix: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of LENGTH-byte windows with one anchor: first and last window, anchor (all in bytes of data).

    An anchor is the leftmost gram of smallest hash, by the top 48 bits at most; its place within a block of grams is
    the rest of the number, so a sliding minimum finds both, in arrays that a core's cache holds.
    """
    n, width = len(prefix) - LENGTH, LENGTH - ANCHOR + 1
    top = np.uint64(2**64 - 2 ** (64 - min(bits, 48)))
    place = np.arange(BLOCK + width, dtype=np.uint64)
    scale = powers(len(prefix), True)
    first, anchor = [], []
    for low in range(0, n, BLOCK):
        high = min(low + BLOCK, n) + width - 1
        key = mix((prefix[low + ANCHOR : high + ANCHOR] - prefix[low:high]) * scale[low:high])
        key &= top
        key |= place[: len(key)]
        have = 1
        while have < width:
            step = min(have, width - have)
            key = np.minimum(key[step:], key[:-step])
            have += step
        new = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        first.append(low + new)
        anchor.append(low + (key[new] & np.uint64(0xFFFF)).astype(np.int64))
    f, at = np.concatenate(first), np.concatenate(anchor)
    new = np.append(True, at[1:] != at[:-1])  # a run may go on in the next block
    f, at = f[new], at[new]
    return f, np.append(f[1:], n) - 1, at


def spans(data: np.ndarray, offsets: np.ndarray, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Spans of the texts: text, first window start, last window start, anchor (all in bytes of data), gram hash; and data's
    prefix hashes.

    bits: how many of a hash's bits count; fewer are for tests, to make hashes collide.
    """
    none = tuple(np.zeros(0, k) for k in (np.int64,) * 4 + (np.uint64,) * 2)
    if len(data) < LENGTH:
        return none
    prefix = prefix_hashes(data)
    first, last, anchor = runs(prefix, bits)
    # a run has fewer windows than lie across two texts, so that at most one text holds some of it
    text = np.searchsorted(offsets, last, side="right") - 1
    first, last = np.maximum(first, offsets[text]), np.minimum(last, offsets[text + 1] - LENGTH)
    own = first <= last
    if not own.any():
        return none
    text, first, last, anchor = (k[own] for k in (text, first, last, anchor))
    return text, first, last, anchor, mix(range_hashes(prefix, anchor, anchor + ANCHOR)) >> np.uint64(64 - bits), prefix


def contents(data: np.ndarray, prefix: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each span's bytes and of its anchor's place in it; fewer bits of the first for tests."""
    shape = ((last - first) * 256 + (anchor - first)).astype(np.uint64)
    one = mix(mix(range_hashes(prefix, first, last + LENGTH)) + mix(shape)) >> np.uint64(64 - bits)
    return one, mix(mix(range_hashes(prefix_hashes(data, True), first, last + LENGTH, True) ^ np.uint64(0x5851F42D4C957F2D)) + shape)


_SPAN = "h long, s long, e long, d long, m long, p long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _anchors(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each anchor occurs in a block of texts."""
        for batch in batches:
            offsets, data = text_buffers(batch.column("text"))
            for a, b in text_chunks(offsets):
                h, n = np.unique(spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _spans(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Span rows (m packs the text's 32-bit hash, the anchor's and the last window's distance from p). Of spans of equal
        content in a block of texts the earliest is a row; the others come as ranges, with null e, their text's hash in s,
        their length in m, and an h of their own."""
        for batch in batches:
            offsets, data = text_buffers(batch.column("text"))
            d, x = batch.column("d").to_numpy(), batch.column("x").to_numpy().astype(np.int64)
            for a, b in text_chunks(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                text, first, last, anchor, gram, prefix = spans(part, off, bits)
                if not len(text):
                    continue
                one, other = contents(part, prefix, first, last, anchor, bits)
                p, ds, xs = first - off[text], d[a + text], x[a + text]
                order = np.argsort(one)
                same = one[order[1:]] == one[order[:-1]]
                twin = np.append(same, False) | np.append(False, same)
                order, alone = order[twin], order[~twin]
                order = order[np.lexsort(tuple(k[order] for k in (p, xs, ds, other, one, gram)))]
                new = np.ones(len(order), bool)
                new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in (gram, one, other)], axis=0)
                head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the earliest of each one's content
                late = (ds[order] != ds[head]) | (xs[order] != xs[head]) | (p[order] != p[head])  # a repeated row is no repeat
                keep = np.append(order[new], alone)
                m = xs * 65536 + (anchor - first) * 256 + (last - first)
                yield pa.RecordBatch.from_arrays([_signed(gram[keep]), _signed(one[keep]), _signed(other[keep]), *(pa.array(c[keep]) for c in (ds, m, p))], names=["h", "s", "e", "d", "m", "p"])
                gone = np.sort(order[late])
                if len(gone):
                    who, lo, hi = text[gone], p[gone], p[gone] + (last - first)[gone] + LENGTH
                    opens = np.ones(len(who), bool)
                    opens[1:] = (who[1:] != who[:-1]) | (lo[1:] > hi[:-1])
                    at = np.flatnonzero(opens)
                    top = np.maximum.reduceat(hi, at)
                    n = len(at)
                    own = mix((d[a + who[at]] * 1_000_003 + lo[at]).view(np.uint64))
                    yield pa.RecordBatch.from_arrays([_signed(own), pa.array(x[a + who[at]]), pa.nulls(n, pa.int64()), pa.array(d[a + who[at]]), pa.array(top - lo[at]), pa.array(lo[at])], names=["h", "s", "e", "d", "m", "p"])

    return run


_BYTES = "h long, d long, x long, q long, lead int, more int, hot boolean, body binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted spans."""
    for batch in batches:
        offsets, data = text_buffers(batch.column("text"))
        wants = batch.column("wants")
        row = np.repeat(np.arange(len(wants)), wants.value_lengths().to_numpy())
        g, p, m, hot = wants.flatten().flatten()
        p, m = p.to_numpy(), m.to_numpy()
        lead, more = m // 256, m % 256
        d, x = (batch.column(k).to_numpy()[row] for k in "dx")
        for i in range(0, len(row), SORT_SPANS):
            k = slice(i, i + SORT_SPANS)
            size = more[k] + LENGTH
            ends = np.cumsum(size)
            body = data[np.repeat(offsets[row[k]] + p[k] - (ends - size), size) + np.arange(ends[-1])]
            body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(body)])
            cols = [g[k], *(pa.array(c) for c in (d[k], x[k], (p + lead)[k], lead[k].astype(np.int32), more[k].astype(np.int32))), hot[k], body]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "d", "x", "q", "lead", "more", "hot", "body"])


def extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length of the common extension of suffixes a and b, `most` at most: binary search over hashes of prefixes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = range_hashes(prefix, a, a + mid) == range_hashes(prefix, b, b + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def suffix_sort(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of items by (group, LENGTH bytes from start, place in the input). Groups are runs of equal, rising numbers.

    Bottom-up mergesort of all groups at once: each item's place in a merged run is its place in its own run and, by
    binary search with hash-compared suffixes, in the run beside it.
    """
    n = len(start)
    order = np.arange(n)
    begin = np.searchsorted(group, np.arange(group[-1] + 1)) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    g_begin, g_size = begin[group], size[group]
    widest, run = int(size.max()) if n else 0, 1
    place = np.arange(n) - g_begin  # of the slot within its group
    while run < widest:
        r = place // run
        other = np.where(r % 2 == 0, r + 1, r - 1)
        o_first = np.minimum(other * run, g_size)
        o_last = np.minimum(o_first + run, g_size)
        low, high = g_begin + o_first, g_begin + o_last
        base = low.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            mine, theirs = order[todo], order[mid]
            a, b = start[mine], start[theirs]
            ext = extension(prefix, a, b)
            full = ext >= LENGTH
            k = np.minimum(ext, LENGTH - 1)
            before = np.where(full, theirs < mine, data[b + k] < data[a + k])  # the other's item comes first
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        own_first = r * run
        to = g_begin + np.minimum(own_first, other * run) + (place - own_first) + (low - base)
        merged = np.empty(n, np.int64)
        merged[to] = order
        order = merged
        run *= 2
    return order


def twins(prefix: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places, ascending, of the windows that share key and hash with another: no other window can repeat one."""
    h = mix(range_hashes(prefix, start, start + LENGTH) + mix(key.astype(np.uint64)))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twin = np.zeros(len(h), bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    return np.flatnonzero(twin)


def repeated_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """Whether each item's LENGTH bytes equal those of an earlier item of its group; items in order of the input."""
    out = np.zeros(len(start), bool)
    if not len(start):
        return out
    prefix = prefix_hashes(data) if prefix is None else prefix
    order = suffix_sort(data, prefix, start, group)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    a, b = a[near], b[near]
    hit = np.flatnonzero(range_hashes(prefix, start[a], start[a] + LENGTH) == range_hashes(prefix, start[b], start[b] + LENGTH))
    collided: set[int] = set()
    window = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    for s in range(0, len(hit), 10_000):
        part = hit[s : s + 10_000]
        true = (window[start[a[part]]].view(np.uint32) == window[start[b[part]]].view(np.uint32)).all(axis=1)
        collided.update(group[a[part[~true]]].tolist())
    out[b[hit]] = True
    for g in collided:  # hashes agreed and bytes did not: sort this group by its bytes
        seen: set[bytes] = set()
        for i in np.flatnonzero(group == g):
            w = data[start[i] : start[i] + LENGTH].tobytes()
            out[i] = w in seen
            seen.add(w)
    return out


_RANGE = "d long, x long, a long, b long, w1 long, w2 long"


def _ranges(d, x, a, b, w1=None, w2=None) -> pa.RecordBatch:
    cols = [pa.array(np.asarray(c, np.int64)) for c in (d, x, a, b)]
    marks = [pa.nulls(len(cols[0]), pa.int64()) if w is None else pa.array(w, pa.int64()) for w in (w1, w2)]
    return pa.RecordBatch.from_arrays([*cols, *marks], names=["d", "x", "a", "b", "w1", "w2"])


def _resolve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Removed ranges of whole groups of spans, and of runs of a hot anchor the windows that are first in theirs. Repeated rows of the input bring a span more than once: one stays."""
    keys = [rows.column(c).to_numpy() for c in ("h", "d", "x", "q")]
    order = np.lexsort(keys[::-1])
    once = np.ones(len(order), bool)
    once[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    rows = rows.take(pa.array(order[once])).combine_chunks()
    h, d, x, q = (rows.column(c).to_numpy() for c in ("h", "d", "x", "q"))
    lead, more = (rows.column(c).to_numpy().astype(np.int64) for c in ("lead", "more"))
    offsets, data = text_buffers(rows.column("body"))
    prefix = prefix_hashes(data)
    n = len(h)
    windows = more + 1
    span = np.repeat(np.arange(n), windows)
    k = np.arange(len(span)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = offsets[span] + k
    # equal windows lie at one distance before their anchor
    key = np.append(0, np.cumsum(h[1:] != h[:-1]))[span] * 512 + lead[span] - k + 256
    some = twins(prefix, start, key)
    order = some[np.argsort(key[some], kind="stable")]  # spans come in order of the input
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(key[order[1:]] != key[order[:-1]])
    gone = np.zeros(len(span), bool)
    gone[order] = repeated_windows(data, start[order], group, prefix)
    new = gone.copy()
    new[1:] &= ~(gone[:-1] & (span[1:] == span[:-1]))
    end = gone.copy()
    end[:-1] &= ~(gone[1:] & (span[1:] == span[:-1]))
    f, e = np.flatnonzero(new), np.flatnonzero(end)
    at = q[span[f]] - lead[span[f]]
    yield _ranges(d[span[f]], x[span[f]], at + k[f], at + k[e] + LENGTH)
    left = np.flatnonzero(rows.column("hot").to_numpy(zero_copy_only=False)[span] & ~gone)
    other = prefix_hashes(data, True) if len(left) else prefix
    for i in range(0, len(left), SORT_SPANS):
        w = left[i : i + SORT_SPANS]
        one, two = text_hashes(prefix, start[w], start[w] + LENGTH), mix(range_hashes(other, start[w], start[w] + LENGTH, True))
        a = (q - lead)[span[w]] + k[w]
        yield _ranges(d[span[w]], x[span[w]], a, a + LENGTH, one.view(np.int64), two.view(np.int64))


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come in order of h; whole groups are put together until they are SORT_SPANS."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= SORT_SPANS:
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on in the next batch
            if cut:
                yield from _resolve(rows.slice(0, cut).combine_chunks())
            held, n = rows.slice(cut).combine_chunks().to_batches(), len(h) - cut
    if held:
        yield from _resolve(pa.Table.from_batches(held).combine_chunks())


def removed_ranges(docs: DataFrame, bits: int = 64) -> DataFrame:
    """d, x, a, b: byte ranges to remove, overlapping ones not yet merged. docs: d, x, text."""
    long_ = docs.where(F.octet_length("text") >= LENGTH)
    often = long_.select("text").mapInArrow(frugal(_anchors(bits)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("h").alias("often"))
    raw = long_.mapInArrow(frugal(_spans(bits)), _SPAN)
    spark = docs.sparkSession
    met = materialise(raw.join(often, F.col("h") == F.col("often"), "left").where("often is not null or e is null").drop("often"), "repeats-met")
    release(spark, 2)
    nth = F.rank().over(Window.partitionBy("h", "s", "e").orderBy("d", "m", "p"))  # repeated rows of the input share theirs
    ranked = materialise(met.repartition("h", "s", "e").withColumn("nth", nth), "repeats-ranked")
    drop(met)
    release(spark, 2)
    own = ranked.where("e is null").select("d", F.col("s").alias("x"), F.col("p").alias("a"), (F.col("p") + F.col("m")).alias("b"))
    x, more = F.shiftright("m", 16), F.col("m").bitwiseAND(255)
    whole = ranked.where("e is not null and nth > 1").select("d", x.alias("x"), F.col("p").alias("a"), (F.col("p") + more + LENGTH).alias("b"))
    firsts = ranked.where("e is not null and nth = 1")
    classes = firsts.groupBy("h").agg(F.count("*").alias("classes")).where("classes > 1")
    run = F.pmod(F.xxhash64("d", "p"), F.ceil(F.col("classes") / MOST_SPANS))
    hot = F.col("classes") > MOST_SPANS
    several = firsts.join(classes, "h")
    several = several.select("d", x.alias("x"), F.struct(F.when(hot, F.xxhash64("h", run)).otherwise(F.col("h")).alias("g"), "p", F.col("m").bitwiseAND(65535).alias("m"), hot.alias("hot")).alias("want"))
    wants = several.groupBy("d", "x").agg(F.collect_set("want").alias("wants"))
    bodies = docs.join(wants, ["d", "x"]).select("text", "d", "x", "wants").mapInArrow(frugal(_fetch), _BYTES)
    found = materialise(bodies.repartition("h").sortWithinPartitions("h").mapInArrow(frugal(_sorted_groups), _RANGE), "repeats-found")
    release(spark, 2)
    windows = found.where("w1 is not null")
    nth = F.row_number().over(Window.partitionBy("w1", "w2").orderBy("d", "x", "a"))
    merged_runs = windows.withColumn("nth", nth).where("nth > 1")
    out = own.union(whole)
    for part in (found.where("w1 is null"), merged_runs):
        out = out.union(part.select("d", "x", "a", "b"))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges each text's ranges and cuts them out."""
    for batch in batches:
        offsets, data = text_buffers(batch.column("text"))
        gone = batch.column("gone")
        row = np.repeat(np.arange(len(gone)), gone.value_lengths().fill_null(0).to_numpy())
        a, b = (k.to_numpy() + offsets[row] for k in gone.flatten().flatten())
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], np.maximum.accumulate(b[order])  # texts lie one after another, so no end is carried on
        opens = np.ones(len(row), bool)
        opens[1:] = (row[1:] != row[:-1]) | (a[1:] > b[:-1])
        at = np.flatnonzero(opens)
        row, a, b = row[at], a[at], b[np.append(at[1:], len(b)) - 1] if len(at) else b
        for i, j in text_chunks(offsets):
            own = slice(*np.searchsorted(row, (i, j)))
            base, n = offsets[i], j - i
            edge = np.zeros(offsets[j] - base + 1, np.int8)
            np.add.at(edge, a[own] - base, 1)
            np.add.at(edge, b[own] - base, -1)
            stays = np.cumsum(edge[:-1], dtype=np.int8) == 0
            kept = data[base : offsets[j]][stays]
            removed = np.bincount(row[own] - i, (b - a)[own], n).astype(np.int64)
            ends = np.append(0, np.cumsum(np.diff(offsets[i : j + 1]) - removed))
            view = memoryview(kept)
            digests = [hashlib.sha256(view[f:t]).hexdigest() for f, t in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            cols = [pa.array(np.diff(offsets[i : j + 1])), pa.array(removed), pa.array(np.bincount(row[own] - i, minlength=n).astype(np.int64)), pa.array(digests)]
            left = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), *cols, left], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left): one row per row of docs."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST) - F.pmod(F.xxhash64("text"), F.lit(2**40))).alias("d")
    ).withColumn("x", F.hash("text").cast("long"))
    gone = removed_ranges(own.select("d", "x", "text"), bits).groupBy("d", "x").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    return own.join(gone, ["d", "x"], "left").select("doc_id", "text", "gone").mapInArrow(frugal(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
