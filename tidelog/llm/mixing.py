"""Mixing sources to target weights: cube-method balanced sampling.

Every source gets a share of all words by its weight; a target stops at three times the source's words and what it
can't take goes to the others. A document's rate is its source's target over its source's words: the whole part is
taken outright, the fraction is an inclusion probability. The cube method then moves these probabilities through the
null-space of the balancing equations (word total and document count), a few units at a time, until fewer units than
constraints are fractional; the landing rounds those few so that the words come nearest to the target.

Flights run in blocks of documents dealt by a hash, so a source with a third of all rows is many blocks; what stays
fractional in a block (two documents at most) flies again with the other blocks' rest. Null and empty texts have size
0 and are never taken; a null source is a source of its own, after all others. The random numbers depend on the block
alone and units are ordered by doc_id and size, so reruns agree, repeated rows included.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialise, table, words_of

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Documents to a block of the flight.
BLOCK = 2_000
#: Blocks whose rests fly together.
FAN_IN = 5_000
EPS = 1e-9


def fill(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Targets: the total shared by weight, each at most `most` times its size, the excess shared again by weight."""
    total, n = float(sum(sizes)), len(sizes)
    out, open_ = [0.0] * n, list(range(n))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = most * float(sizes[i])
        left = total - sum(out[i] for i in range(n) if i not in open_ or i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def fly(pi: list[float], size: list[float], seed: str) -> list[float]:
    """Flight phase with two constraints, sum(size * s) and sum(s): at most two probabilities stay fractional.

    Three fractional units at a time: u spans the null-space of their 2 x 3 balancing matrix; the walk goes along u or
    against it to the cube's face, with odds that keep every inclusion probability.
    """
    out, rng = list(pi), random.Random(seed)
    active: list[int] = []
    for k in range(len(out)):
        if EPS < out[k] < 1 - EPS:
            active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = min(((1 - out[i]) / x if x > 0 else out[i] / -x) for i, x in zip(active, u, strict=True) if x)
            down = min((out[i] / x if x > 0 else (1 - out[i]) / -x) for i, x in zip(active, u, strict=True) if x)
            step = up if rng.random() * (up + down) < down else -down
            for i, x in zip(active, u, strict=True):
                out[i] += step * x
                if out[i] < EPS:
                    out[i] = 0.0
                elif out[i] > 1 - EPS:
                    out[i] = 1.0
            active = [i for i in active if 0.0 < out[i] < 1.0]
    return out


def land(pi: list[float], size: list[float]) -> list[float]:
    """Round the last fractional units (two at most) so that the words come nearest to what was due; ties to fewer."""
    free = [k for k, p in enumerate(pi) if 0.0 < p < 1.0]
    due = sum(pi[k] * size[k] for k in free)
    best = min(range(2 ** len(free)), key=lambda m: (abs(sum(size[k] for j, k in enumerate(free) if m >> j & 1) - due), m))
    out = list(pi)
    for j, k in enumerate(free):
        out[k] = float(best >> j & 1)
    return out


def _flight(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "uid"], na_position="last", kind="stable")
        pi = fly(pdf["pi"].tolist(), [float(x) for x in pdf["size"]], f"{pdf['src'].iloc[0]}/{pdf['block'].iloc[0]}")
        return pdf.assign(pi=land(pi, [float(x) for x in pdf["size"]]) if last else pi)

    return run


_UNIT = "uid long, doc_id long, size long, src int, source_size long, target double, whole long, pi double, block long"


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, src (its place by code point, null last), source_size, source_docs, target.

    The grouped sums are as many as there are sources; the shares are filled by one task over that small table.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_docs"))

    def share(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames), ignore_index=True)
        named = sorted((s.encode(), k) for k, s in enumerate(pdf["source"]) if isinstance(s, str))
        order = [k for _, k in named] + [k for k, s in enumerate(pdf["source"]) if not isinstance(s, str)]
        pdf = pdf.iloc[order].reset_index(drop=True)
        pdf["src"] = range(len(pdf))
        pdf["target"] = fill(pdf["source_size"].tolist(), [float(weights[k % len(weights)]) for k in range(len(pdf))])
        yield pdf

    return sums.coalesce(1).mapInPandas(share, "source string, source_size long, source_docs long, src int, target double")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of docs."""
    return _mixed(docs, weights).drop("source")


def _mixed(docs: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """mixed() with the source."""
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_of(F.col("text")).alias("size")), "mix-sizes")
    goal = materialise(targets(sized, weights), "mix-targets")
    most = goal.agg(F.max("source_docs")).first()[0] or 0
    blocks = -(-most // BLOCK) if most else 1
    # sources are few and named by the table's own column; the join is left to the planner's size check
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    n_blocks = F.ceil(F.col("source_docs") / F.lit(BLOCK)).cast("long")
    g = goal.withColumnRenamed("source", "s")
    units = sized.join(g, sized.source.eqNullSafe(g.s)).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "size", "src", "source_size", "target",
        F.floor(rate).cast("long").alias("whole"), (rate - F.floor(rate)).alias("pi"),
        F.pmod(F.xxhash64("doc_id", "size"), F.greatest(n_blocks, F.lit(1))).alias("block"),
    )
    units = units.withColumn("pi", F.when(F.col("size") == 0, 0.0).otherwise(F.col("pi")))
    done: list[DataFrame] = []
    fractional = (F.col("pi") > 0) & (F.col("pi") < 1)
    while True:
        last = blocks <= 1
        flown = materialise(units.groupBy("src", "block").applyInPandas(_flight(last), _UNIT), "mix-flight")
        done.append(flown.where(~fractional) if not last else flown)
        if last:
            break
        blocks = -(-blocks // FAN_IN)
        units = flown.where(fractional).withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    named = out.join(goal.select(F.col("src").alias("_src"), "source"), F.col("src") == F.col("_src"))
    return named.select("doc_id", "source", "size", "source_size", "target", ((F.col("whole") + F.round("pi").cast("long")) * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix as documents: each as often as the mix takes it, copies told apart by nothing but their number."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    m = _mixed(docs, weights).select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), times.alias("__mix_times"))
    # rows that repeat an id, source and size: the k-th takes the k-th count, whichever way they are ordered
    m = m.withColumn("__mix_k", F.row_number().over(Window.partitionBy("__mix_id", "__mix_source", "__mix_size").orderBy("__mix_times")))
    d = docs.withColumn("__mix_words", words_of(F.col("text"))).withColumn("__mix_n", F.row_number().over(Window.partitionBy("doc_id", "source", "__mix_words").orderBy("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_words") == F.col("__mix_size"))
    both = d.join(m, same & (F.col("__mix_n") == F.col("__mix_k")))
    return both.where("__mix_times > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), "__mix_times"))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
