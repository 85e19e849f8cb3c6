"""N-gram Jaccard join: T-occurrence search with DivideSkip.

A document's set holds the 64-bit hashes of its word shingles. Two documents link when the Jaccard similarity of their
sets is at least SIMILAR per cent. No link is missed; what is spread over the cluster:

1. Documents with equal sets are one class (grouped by the set's size and two 64-bit sums over it); its smallest doc_id
   stands for it from here on.
2. Inverted lists of the first elements by hash. Sets that link share at least k elements among their first
   n - ceil(SIMILAR n / 100) + k, whatever the order; k is 1 + n / EXTRA. A set with fewer elements on lists of two or
   more there links with nothing and leaves; the lists are counted once more among those that stay.
3. DivideSkip over those lists: lists of more than SHORT sets are set apart. A pair is a candidate if the short lists
   that it shares, and the long ones that it can share at most, reach its k; where long lists alone reach k for both,
   the two are candidates if they share one. Candidates, directly or by way of others, are one group; groups of more
   than BLOCK sets, or ELEMENTS elements, are searched block against block.
4. T-occurrence search in a block pair: each set sets its longest lists apart, by DivideSkip's rule; the short ones are merged,
   counting occurrences; where these can still reach the overlap T that a pair needs, the long lists are probed for the rest.
   Only links leave the task, and of these only a spanning tree, with each document's number of links.
5. Links' connected components give component_id.

Elements are 64-bit hashes, so sets are told apart and linked to within their collisions. Texts are taken whole. Null and empty texts (or texts of white space) have no set and link with nothing; rows that repeat
a doc_id are one vertex; a row with null doc_id has a null component. A doc_id that comes with several texts has all their
links, and counts once for each of its sets among the links of others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import LOWER, components, drop, frugal, materialise, mix, prefix_hashes, release, table, text_buffers, text_chunks, text_hashes, word_spans

WORDS, SIMILAR = 4, 85
EXTRA = 12
SHORT = 64
#: Sets to a block, and elements.
BLOCK, ELEMENTS = 512, 2_000_000
PAIRS_AT_ONCE = 1_000_000
#: Weight of a probe against a step of the merge, and the look-ups of a block pair beyond which bitmaps answer them.
MU, PROBES = 0.01, 3_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): each text's distinct shingles as sorted 64-bit hashes."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    h = text_hashes(prefix_hashes(data), starts, ends)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    m = max(len(h) - words + 1, 0)
    window = np.zeros(m, np.uint64)
    for k in range(words):
        window += mix(h[k : k + m] * np.uint64(2 * k + 3) + np.uint64(k))
    whole = np.flatnonzero(owner[:m] == owner[words - 1 : words - 1 + m]) if m else np.zeros(0, np.int64)
    keys, own = [mix(window[whole])], [owner[whole]]
    # fewer words than a shingle: the whole sequence is one
    for k in range(1, words):
        at = np.flatnonzero(count == k)
        if len(at):
            v = np.full(len(at), k, np.uint64)
            for j in range(k):
                v += mix(h[first[at] + j] * np.uint64(2 * j + 101))
            keys.append(mix(v))
            own.append(at)
    key, who = np.concatenate(keys), np.concatenate(own)
    order = np.lexsort((key, who))
    key, who = key[order], who[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
    return key[new], np.searchsorted(who[new], np.arange(n + 1))


def needed(n: np.ndarray, similar: int) -> np.ndarray:
    """The overlap that any partner of a set of n elements needs at least."""
    return -(-similar * n // 100)


def _prefixes(key: np.ndarray, off: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Each set's first n - needed + k elements by hash, and their offsets."""
    n = np.diff(off)
    who = np.repeat(np.arange(len(n)), n)
    length = np.where(n > 0, np.minimum(n - needed(n, similar) + 1 + n // EXTRA, n), 0)
    place = np.arange(len(key)) - off[:-1][who]
    return key[place < length[who]], np.concatenate([[0], np.cumsum(length)])


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _lists(x: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), _longs(x))


def _sketch(words: int, similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column("text"))
            for a, b in text_chunks(offsets):
                key, off = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                sums = []
                for salt in (0x1B873593, 0xCC9E2D51F):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key ^ np.uint64(salt)), dtype=np.uint64)])
                    sums.append(_longs(total[off[1:]] - total[off[:-1]]))
                pre, pre_off = _prefixes(key, off, similar)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(off)), *sums, _lists(pre, pre_off)], names=["doc_id", "n", "d1", "d2", "prefix"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column("text"))
            for a, b in text_chunks(offsets):
                key, off = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                rest = [batch.column(c).slice(a, b - a) for c in ("doc_id", "grp", "block", "n_blocks", "copies")]
                yield pa.RecordBatch.from_arrays([*rest, _lists(key, off)], names=["doc_id", "grp", "block", "n_blocks", "copies", "elements"])

    return run


def merged_lists(query: np.ndarray, first: np.ndarray, run: np.ndarray, posts: np.ndarray, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query * n_b + document, occurrences) over the inverted lists posts[first : first + run] of each query, queries in order.

    The lists of some queries at a time are laid end to end and merged run by run (a stable sort), equal documents becoming
    one count; where they are many for the pairs there are, they are counted off in place.
    """
    ends = np.cumsum(run)
    lo = 0
    while lo < len(run):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")), lo + 1)
        hi = max(int(np.searchsorted(query, query[hi - 1], side="right")), hi)  # a query's lists stay together
        r = run[lo:hi]
        at = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r) + np.repeat(first[lo:hi], r)
        base = int(query[lo]) * n_b
        pair = np.repeat(query[lo:hi] * n_b, r) + posts[at] - base
        width = (int(query[hi - 1]) + 1) * n_b - base
        if len(pair) > width // 4:
            count = np.bincount(pair, minlength=width)
            found = np.flatnonzero(count)
            yield found + base, count[found]
        else:
            pair = np.sort(pair, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            yield pair[new] + base, np.diff(np.append(new, len(pair)))
        lo = hi


def divide_skip(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs (i in a, j in b) of two lists of sorted sets; with None, pairs i < j within a.

    Each set of a is a query for the sets of b that share T of its elements. Its L longest inverted lists are set apart, L by
    the rule T / (MU * log2(longest) + 1); the short ones are merged, and what occurs T - L times there is looked up in the
    long ones, shortest first, by binary search, as long as it can still reach its T. Where that takes more than PROBES
    look-ups, 64 are answered at a time from bitmaps.
    """
    own = sets_b is None
    sets_b = sets_a if own else sets_b
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    na, nb = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    ta, da = np.concatenate(sets_a), np.repeat(np.arange(len(na)), na)
    names, tb, df = np.unique(np.concatenate(sets_b), return_inverse=True, return_counts=True)
    if not len(names) or not len(ta):
        return none
    db = np.repeat(np.arange(len(nb)), nb)
    by_list = np.lexsort((db, tb))
    posts, starts = db[by_list], np.concatenate([[0], np.cumsum(df)[:-1]])
    keys = tb[by_list] * len(nb) + posts
    ia = np.minimum(np.searchsorted(names, ta), len(names) - 1)
    there = names[ia] == ta
    da, ia = da[there], ia[there]
    order = np.lexsort((-df[ia], da))
    da, ia = da[order], ia[order]
    begin = np.searchsorted(da, np.arange(len(na) + 1))
    size = np.diff(begin)
    longest = np.where(size > 0, df[ia[np.minimum(begin[:-1], len(ia) - 1)]], 1) if len(ia) else np.ones(len(na))
    least = np.maximum(needed(na, similar), 1)
    apart = np.minimum(np.minimum((least / (MU * np.log2(np.maximum(longest, 2)) + 1)).astype(np.int64), least - 1), size)
    rank = np.arange(len(da)) - begin[da]
    short = rank >= apart[da]
    found = [none + (none[0],)]
    for pair, count in merged_lists(da[short], starts[ia[short]], df[ia[short]], posts, len(nb)):
        i, j = pair // len(nb), pair % len(nb)
        ok = (count >= least[i] - apart[i]) & (100 * np.minimum(na[i], nb[j]) >= similar * np.maximum(na[i], nb[j]))
        if own:
            ok &= i < j
        found.append((i[ok], j[ok], count[ok]))
    i, j, count = (np.concatenate(c) for c in zip(*found, strict=True))
    t = -(-similar * (na[i] + nb[j]) // (100 + similar))
    keep = count + apart[i] >= t
    i, j, count, t = i[keep], j[keep], count[keep], t[keep]
    if int(apart[i].sum()) > PROBES:
        count = count + _shared_long(i, j, (da[~short], ia[~short], len(na)), (db, tb, len(nb)), len(names))
    else:
        left = apart[i]
        for _ in range(int(apart.max(initial=0))):
            open_ = np.flatnonzero((left > 0) & (count < t) & (count + left >= t))
            if not len(open_):
                break
            left[open_] -= 1  # the longest list of a query has rank 0: it comes last
            wanted = ia[begin[i[open_]] + left[open_]] * len(nb) + j[open_]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            count[open_] += keys[at] == wanted
    keep = count >= t
    return i[keep], j[keep]


def _shared_long(i: np.ndarray, j: np.ndarray, a: tuple, b: tuple, n_names: int) -> np.ndarray:
    """How many of the lists that query i sets apart hold document j, for arrays of both."""
    used = np.unique(a[1])
    place = np.full(n_names, -1)
    place[used] = np.arange(len(used))
    width = max(1, -(-len(used) // 64))

    def bitmaps(docs: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
        bits = np.zeros((n, width), np.uint64)
        at = place[tokens]
        docs, at = docs[at >= 0], at[at >= 0]
        np.bitwise_or.at(bits, (docs, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        return bits

    bits_a, bits_b = bitmaps(*a), bitmaps(*b)
    out = np.zeros(len(i), np.int64)
    step = max(1, PAIRS_AT_ONCE // width)
    for s in range(0, len(i), step):
        out[s : s + step] = np.bitwise_count(bits_a[i[s : s + step]] & bits_b[j[s : s + step]]).sum(1)
    return out


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest with the same components."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


_LINK = "a long, b long, links long"


def _search(similar: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i_block, j_block = key
        pdf = pdf.sort_values("doc_id", kind="stable")
        if pdf["doc_id"].duplicated().any():  # repeated rows
            pdf = pdf[~pdf.assign(e=[np.asarray(x, np.int64).tobytes() for x in pdf["elements"]]).duplicated(["doc_id", "e"])]
        a = pdf[pdf["block"] == i_block]
        b = a if i_block == j_block else pdf[pdf["block"] == j_block]
        sets = [[np.asarray(x, np.int64) for x in p["elements"]] for p in ((a,) if i_block == j_block else (a, b))]
        i, j = divide_skip(sets[0], sets[1] if len(sets) > 1 else None, similar) if len(a) and len(b) else (np.zeros(0, int), np.zeros(0, int))
        if not len(i):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        ids_a, ids_b, copies_a, copies_b = (x.to_numpy() for x in (a["doc_id"], b["doc_id"], a["copies"], b["copies"]))
        base = 0 if i_block == j_block else len(a)
        every = ids_a if not base else np.concatenate([ids_a, ids_b])
        tree = spanning(len(every), i, j + base)
        la = np.bincount(i, weights=copies_b[j], minlength=len(every))[: len(every)]
        lb = np.bincount(j + base, weights=copies_a[i], minlength=len(every))[: len(every)]
        rows = [pd.DataFrame({"a": every[[x for x, _ in tree]], "b": every[[y for _, y in tree]], "links": 0})]
        n = (la + lb).astype(np.int64)
        at = np.flatnonzero(n)
        rows.append(pd.DataFrame({"a": every[at], "b": every[at], "links": n[at]}))
        return pd.concat(rows, ignore_index=True).astype("int64")

    return run


def joined(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row per row of docs."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialise(d.mapInArrow(frugal(_sketch(words, similar)), "doc_id long, n long, d1 long, d2 long, prefix array<long>"), "ngram-sketch")
    classes = materialise(sketch.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies")), "ngram-classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "n", "copies")
    # elements on lists of two or more; copies of a set count here, and no more from the next step on
    rows = sketch.select("doc_id", F.explode("prefix").alias("element"))
    shared = rows.groupBy("element").agg(F.count("*").alias("docs")).where("docs > 1")
    written = posts = materialise(rows.join(shared, "element").select("doc_id", "element"), "ngram-posts")
    # of a partner's k at least: it has no fewer than `similar` per cent of the elements
    least = (1 + F.floor(F.ceil(F.col("n") * similar / 100) / EXTRA)).cast("long")
    for _ in range(2):
        stay = posts.groupBy("doc_id").agg(F.count("*").alias("found")).join(reps, "doc_id").where(F.col("found") >= least).select("doc_id", "n", least.alias("least"))
        posts = posts.select("doc_id", "element").join(stay, "doc_id")
        shared = posts.groupBy("element").agg(F.count("*").alias("docs")).where("docs > 1")
        before, posts = written, materialise(posts.join(shared, "element").select("doc_id", "n", "least", "element", (F.col("docs") > SHORT).alias("long")), "ngram-posts")
        drop(before)
        written = posts
    release(spark)
    on_long = posts.groupBy("doc_id").agg(F.sum(F.col("long").cast("long")).alias("n_long"))
    posts = materialise(posts.join(on_long, "doc_id"), "ngram-posts")
    drop(written)
    a = posts.where("not long").select("element", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("n_long").alias("la"))
    b = posts.where("not long").select("element", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("n_long").alias("lb"))
    near = 100 * F.least("na", "nb") >= similar * F.greatest("na", "nb")
    k = 1 + F.floor(F.least("na", "nb") / EXTRA)
    pairs = a.join(b, "element").where(F.col("a") < F.col("b")).where(near).groupBy("a", "b").agg(F.count("*").alias("c"), F.first(k - F.least("la", "lb")).alias("need")).where("c >= need").select("a", "b")
    longs = posts.where("long and n_long >= least").select("doc_id", "element")
    star = longs.join(longs.groupBy("element").agg(F.min("doc_id").alias("b")), "element").where("b < doc_id").select(F.col("doc_id").alias("a"), "b").distinct()
    groups = components(pairs.union(star), "ngram-groups")
    groups = materialise(groups.select(F.col("id").alias("doc_id"), F.col("component").alias("grp")), "ngram-groups")
    member = groups.join(reps, "doc_id")
    sizes = member.groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / ELEMENTS)).cast("int").alias("n_blocks"))
    member = member.select("doc_id", "grp", "copies").join(sizes, "grp")
    member = member.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
    sets = member.join(d, "doc_id").select("doc_id", "grp", "block", "n_blocks", "copies", "text").mapInArrow(frugal(_sets(words)), "doc_id long, grp long, block int, n_blocks int, copies long, elements array<long>")
    other = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    paired = sets.withColumn("other", F.explode(other)).select("doc_id", "grp", "block", "copies", "elements", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = materialise(paired.groupBy("grp", "i", "j").applyInPandas(_search(similar), _LINK), "ngram-links")
    del sets, paired
    release(spark)
    comp = components(links.where("a <> b").select("a", "b"), "ngram-components")
    comp = comp.select(F.col("id").alias("rep"), F.col("component"))
    counts = links.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.join(comp, "rep", "left").join(counts, "rep", "left").select("n", "d1", "d2", "copies", F.coalesce("component", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    named = named.select(F.col("n").alias("_n"), F.col("d1").alias("_1"), F.col("d2").alias("_2"), "copies", "component_id", "links")
    own = sketch.select("doc_id", "n", "d1", "d2")
    out = own.join(named, (own.n == F.col("_n")) & (own.d1 == F.col("_1")) & (own.d2 == F.col("_2")), "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, words: int, similar: int) -> DataFrame:
    """The documents with the smallest doc_id of each component; of rows that repeat a doc_id the first by text stays (then by
    the other columns), a row without one stays."""
    found = joined(docs, words, similar)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("__near_keep")).distinct()
    mine = docs.where("doc_id is not null").join(keep, F.col("doc_id") == F.col("__near_keep"), "left_semi")
    plain = [F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType) and f.name != "text"]
    once = mine.groupBy(F.col("doc_id").alias("__near_id")).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text", F.xxhash64(*plain))).alias("__near_row"))
    return once.select("__near_row.*").unionByName(docs.where("doc_id is null"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, chr(10))]
       ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], chr(10))) END) AS s FROM w)),
n AS (SELECT w.doc_id, count(sh.s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {SIMILAR} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
k AS (SELECT id, min(root) AS root FROM r GROUP BY id), c AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, k.root AS component_id, coalesce(c.n, 0)::BIGINT AS n_links FROM n JOIN k ON k.id = n.doc_id LEFT JOIN c ON c.a = n.doc_id"""
