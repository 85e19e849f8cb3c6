"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is padded to a power of two and turned by a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform); its hash is the nearest signed axis. A table concatenates such hashes, each of its own rotation and
the last one among fewer axes, until a bucket holds about ROWS rows, so buckets get finer as the table grows. Every row is
indexed in TABLES tables. A query probes the buckets of each table whose axes lie nearest to its rotated selves
(multiprobe; their number grows with that of the buckets to the power GROWTH), and every candidate met is scored by its
exact cosine in double precision, summed in one fixed order so that copies tie exactly; nothing is cut before.

Rows of equal vectors are one candidate, which carries the ids that any query could need of it: the k + 1 smallest, each
as often as it occurs but k times at most. So a vector that a third of all rows share is scored once.

Candidates and queries meet by their first axis, where queries bring the buckets that they probe. Both sides are dealt in
parts of PART and QUERY_PART, so a candidate goes once to each table up to 100 * QUERY_PART rows, as queries probe
about half of the axes; more rows take one more copy for each QUERY_PART queries on an axis. Where a bucket holds over HOT
candidates (near copies), its axis is dealt in parts of FINE, since nearly all pairs there are scored. A task holds one such
part of both. A query that meets fewer than k candidates looks at all rows.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of other lengths than the most
common one are compared with their own length only. Ties go to the smaller vec_id; rows that repeat a vec_id are
candidates of their own, and a query row is never its own candidate (rows with the query's vec_id are not either).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialise, table

TABLES = 12
#: Rows to a bucket, about.
ROWS = 4
#: Probes to a table of B buckets: FIRST_PROBES + PROBES * B ** GROWTH.
FIRST_PROBES, PROBES, GROWTH = 14, 0.13, 0.7
#: Axes of one hash that probes are put together from.
AXES = 64
SEED = 11
PART = 50_000
QUERY_PART = 50_000
#: Candidates in a bucket from which its axis is dealt in parts of FINE (candidates, queries).
HOT = 1_000
FINE = (4_000, 500)
#: Probes that are put together at once.
COMBINED = 2_000_000
#: Pairs that are scored at once.
PAIRS = 400_000
NEAREST = 5
EVERY = 50


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, t: int) -> np.ndarray:
    """The t-th pseudo-rotation of rows."""
    d = 1 << max(0, (x.shape[1] - 1)).bit_length()
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, t, d])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    return y


def shape(n: int, dim: int) -> list[int]:
    """How many signed axes each hash of a table has, for n rows."""
    full, left, out = 2 * (1 << max(0, dim - 1).bit_length()), n / ROWS, []
    while left > 1 or not out:
        out.append(min(full, max(2, 1 << math.ceil(math.log2(max(left, 2))))))
        left /= out[-1]
    return out


def towards(x: np.ndarray, t: int, k: int, width: int) -> np.ndarray:
    """How far each row points along the signed axes of hash k of table t: +e_0, +e_1, ... and then -e_0, -e_1, ..."""
    y = rotated(x, 1000 * t + k)[:, : width // 2]
    return np.concatenate([y, -y], axis=1)


def buckets(x: np.ndarray, t: int, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first axis, number of the bucket) of each row in table t."""
    first, code = None, np.zeros(len(x), np.int64)
    for k, w in enumerate(widths):
        a = np.argmax(towards(x, t, k, w), axis=1)
        first = a if first is None else first
        code = code * w + a
    return first, code


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row, in any order."""
    return np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)


def probed(x: np.ndarray, t: int, widths: list[int], probes: int) -> np.ndarray:
    """The numbers of the `probes` buckets nearest to each row in table t, by the sum of its parts along their axes."""
    far = [towards(x, t, k, w) for k, w in enumerate(widths)]
    step = max(1, COMBINED // (4 * probes * AXES))
    out = [np.zeros((0, probes), np.int64)]
    for i in range(0, len(x), step):
        n = len(x[i : i + step])
        score, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for y, w in zip(far, widths, strict=True):
            own = _top(y[i : i + step], AXES)
            along = np.take_along_axis(y[i : i + step], own, axis=1)
            score = (score[:, :, None] + along[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * w + own[:, None, :]).reshape(n, -1)
            best = _top(score, 4 * probes)
            score, code = np.take_along_axis(score, best, axis=1), np.take_along_axis(code, best, axis=1)
        out.append(np.take_along_axis(code, np.argsort(-score, axis=1, kind="stable")[:, :probes], axis=1))
    return np.concatenate(out)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vec, dim: rows that take part."""
    v = F.col("embedding") if rows.schema["embedding"].dataType.simpleString() == "array<float>" else F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null").where(good).withColumn("dim", F.size("vec"))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """uid, dim, vec, ids, vec_id, other: different vectors, the ids that answers may need of each, the two smallest of these.

    ids ascend. Leaving out any one id, those left still begin with the k smallest rows of that vector.
    """
    one = rows.groupBy("dim", "vec", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    first = one.withColumn("place", F.row_number().over(Window.partitionBy("dim", "vec").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ids = F.sort_array(F.flatten(F.collect_list(F.array_repeat("vec_id", F.col("n")))))
    vectors = first.groupBy("dim", "vec").agg(ids.alias("ids"))
    low = F.get("ids", F.lit(0))
    return vectors.select(F.monotonically_increasing_id().alias("uid"), "dim", "vec", "ids", low.alias("vec_id"), F.coalesce(F.get(F.filter("ids", lambda i: i != low), F.lit(0)), low).alias("other"))


def _units(own: pd.DataFrame) -> np.ndarray:
    m = np.stack(own["vec"].to_list()).astype(float)
    m = m / np.abs(m).max(axis=1)[:, None]
    return m / np.linalg.norm(m, axis=1)[:, None]


def indexed(rows: DataFrame, counts: dict[int, int], tables: int) -> DataFrame:
    """Candidates with their first axis and bucket in each table, and their vectors: made in one pass, without a join."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, own in pdf.reset_index(drop=True).groupby("dim"):
                m, widths = _units(own), shape(counts[int(dim)], int(dim))
                for t in range(tables):
                    first, code = buckets(m, t, widths)
                    yield own[["uid", "vec_id", "other", "ids", "vec", "dim"]].assign(t=t, axis=first, code=code)

    return rows.mapInPandas(run, f"uid long, vec_id long, other long, ids array<long>, vec {rows.schema['vec'].dataType.simpleString()}, dim int, t int, axis int, code long")


def asked(queries: DataFrame, counts: dict[int, int], tables: int, everything: bool = False) -> DataFrame:
    """Queries with each first axis that they probe in each table and the buckets there; null for all of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, own in pdf.reset_index(drop=True).groupby("dim"):
                m, widths = _units(own), shape(counts[int(dim)], int(dim))
                size = math.prod(widths)
                head = own[["uid", "vec_id", "vec", "dim"]]
                for t in range(tables):
                    if everything:
                        for axis in range(widths[0]):
                            yield head.assign(t=t, axis=axis, codes=None)
                        continue
                    found = probed(m, t, widths, min(size, math.ceil(FIRST_PROBES + PROBES * size**GROWTH)))
                    found = np.sort(found, axis=1)  # an axis's buckets stand together
                    of = found // (size // widths[0])
                    starts = np.flatnonzero(np.diff(of, axis=1, prepend=-1))
                    yield head.iloc[starts // of.shape[1]].assign(t=t, axis=of.ravel()[starts], codes=np.split(found.ravel(), starts[1:]))

    return queries.mapInPandas(run, f"uid long, vec_id long, vec {queries.schema['vec'].dataType.simpleString()}, dim int, t int, axis int, codes array<long>")


def _scaled(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as columns, scaled by their largest component so that squares stay finite, and their lengths."""
    m = np.stack(rows["vec"].to_list()).astype(float)
    m = np.ascontiguousarray((m / np.abs(m).max(axis=1)[:, None]).T)
    square = np.zeros(m.shape[1])
    for c in m:
        square += c * c
    return m, np.sqrt(square)


def _candidates(queries: pd.DataFrame, rows: pd.DataFrame) -> list[np.ndarray]:
    """Of each query the places of the rows in the buckets that it probes."""
    if "code" not in rows.columns:
        return [np.arange(len(rows))] * len(queries)
    order = np.argsort(rows["code"].to_numpy(), kind="stable")
    code = rows["code"].to_numpy()[order]
    out = []
    for wanted in queries["codes"]:
        if wanted is None:
            out.append(order)
            continue
        low, high = np.searchsorted(code, wanted), np.searchsorted(code, wanted, side="right")
        out.append(np.concatenate([order[a:b] for a, b in zip(low, high, strict=True) if a < b] or [order[:0]]))
    return out


def _nearest(k: int):
    """The best candidates of each query in one part; an id of the query's own is passed over for the vector's next one."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_uid": [], "query_id": [], "uid": [], "vec_id": [], "score": [], "ids": []}).astype({"query_uid": "int64", "query_id": "int64", "uid": "int64", "vec_id": "int64", "score": "float64", "ids": "object"})
        if not len(queries) or not len(rows):
            return none
        if "ids" not in rows.columns:  # each row is a vector of its own
            rows = rows.assign(other=rows["vec_id"], ids=[[i] for i in rows["vec_id"]])
        (q, q_len), (v, v_len) = _scaled(queries), _scaled(rows)
        low, other, ids, uids = (rows[c].to_numpy() for c in ("vec_id", "other", "ids", "uid"))
        qids, quids = queries["vec_id"].to_numpy(), queries["uid"].to_numpy()
        found = _candidates(queries, rows)
        out, first = [none], 0
        while first < len(found):
            last, n = first, 0
            while last < len(found) and (last == first or n + len(found[last]) <= PAIRS):
                n += len(found[last])
                last += 1
            own, at = np.repeat(np.arange(first, last), [len(f) for f in found[first:last]]), np.concatenate(found[first:last])
            least = np.where(low[at] != qids[own], low[at], other[at])
            own, at, least = (x[least != qids[own]] for x in (own, at, least))
            dot = np.zeros(len(own))
            for a, b in zip(q, v, strict=True):  # one fixed order of summation: equal rows have equal scores
                dot += a[own] * b[at]
            score = dot / q_len[own] / v_len[at]
            order = np.lexsort((uids[at], least, -score, own))
            own, at, least, score = own[order], at[order], least[order], score[order]
            best = np.arange(len(own)) - np.searchsorted(own, own) < 2 * k
            own, at, least, score = own[best], at[best], least[best], score[best]
            out.append(pd.DataFrame({"query_uid": quids[own], "query_id": qids[own], "uid": uids[at], "vec_id": least, "score": score, "ids": ids[at]}))
            first = last
        return pd.concat(out, ignore_index=True)

    return run


_HIT = "query_uid long, query_id long, uid long, vec_id long, score double, ids array<long>"


def _met(index: DataFrame, queries: DataFrame, k: int, fine: bool = False) -> DataFrame:
    """Candidates of queries in the buckets that they probe, best ones of each part of a first axis."""
    cell = ["dim", "t", "axis"]
    rows_of = index.groupBy(*cell, "code").agg(F.count("*").alias("n")).groupBy(*cell).agg(F.sum("n").alias("n"), F.max("n").alias("hot"))
    sizes = rows_of.join(queries.groupBy(*cell).agg(F.count("*").alias("nq")), cell)
    finer = F.lit(fine) | (F.col("hot") > HOT)
    part, q_part = (F.when(finer, min(own, most)).otherwise(most) for own, most in zip(FINE, (PART, QUERY_PART), strict=True))
    parts = materialise(sizes.select(*[F.col(c).alias(f"_{c}") for c in cell], F.ceil(F.col("n") / part).cast("int").alias("n_parts"), F.ceil(F.col("nq") / q_part).cast("int").alias("q_parts")), "ann-parts")
    on = [F.col(c) == F.col(f"_{c}") for c in cell]
    rows = index.join(parts, on).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("n_parts")).cast("int")).withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    asks = queries.join(parts, on).withColumn("q_part", F.pmod(F.xxhash64("uid"), F.col("q_parts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    key = [*cell, "part", "q_part"]
    cols = ["uid", "vec_id", "vec", *key]
    return asks.select(*cols, "codes").groupBy(*key).cogroup(rows.select(*cols, "other", "ids", "code").groupBy(*key)).applyInPandas(_nearest(k), _HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """query_uid, query_id, best: the k nearest rows met, (distance, vec_id), a vector's ids taken apart again."""
    once = hits.groupBy("query_uid", "query_id", "uid", "ids").agg(F.max("score").alias("score"))
    met = F.flatten(F.collect_list(F.transform(F.filter("ids", lambda i: i != F.col("query_id")), lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id")))))
    return once.groupBy("query_uid", "query_id").agg(F.slice(F.array_sort(met), 1, k).alias("best"))


def search(rows: DataFrame, every: int = EVERY, k: int = NEAREST, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    good = usable(rows)
    base = materialise(candidates(good, k), "ann-rows")
    counts = {r["dim"]: r["count"] for r in base.groupBy("dim").count().collect()}  # a row per length of vectors
    ask = materialise(good.where(F.col("vec_id") % every == 0).withColumn("uid", F.monotonically_increasing_id()), "ann-queries")
    best = materialise(_best(_met(indexed(base, counts, tables), asked(ask, counts, tables), k), k), "ann-best")
    # queries that met too few look at every row of their length
    enough = best.where(F.size("best") >= k)
    short = materialise(ask.join(enough.select(F.col("query_uid").alias("uid")), "uid", "left_anti"), "ann-short")
    if short.limit(1).count():
        enough = enough.unionByName(_best(_met(indexed(base, counts, 1), asked(short, counts, 1, everything=True), k, fine=True), k))
    return enough.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
