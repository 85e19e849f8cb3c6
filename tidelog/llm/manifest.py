"""Merkle manifest of a table: every row a leaf, a tree for each source, a tree over the sources' subroots.

The trees are climbed and descended by supersteps over RDDs of vertices. A vertex is what LEVELS levels of a tree have above
one run of FAN ** LEVELS nodes, so it holds a bounded number of digests however large its source is:

* upward, nodes message their digest to the vertex above them; a vertex that has all its nodes hashes them level by level
  and forwards the digest on top, until one is left for each tree;
* downward, a vertex that knows the siblings on the way from its top to the root adds those of each of its nodes and
  broadcasts them to the vertices below; the lowest vertices prove their leaves.

Each superstep's vertices are a table in the shared folder: lineage ends there, and lost executors cost one superstep.
Leaves are dealt to their places by ranges of (source, doc_id, leaf), so a source with most of all rows is spread.

Null fields have a form of their own, `-`; a null source is a source and comes first; null doc_ids come first in their
source and are never tampered with. Rows that share a doc_id in a source are ordered by their leaf; equal rows have equal
leaves, and each has a place of its own. Other columns are not looked at. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import CRC32_SQL, drop, materialise, placed, table

#: Nodes to a run, and levels of a tree that one superstep passes.
FAN, LEVELS = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def serialised(value: Column) -> Column:
    """`-` for null, else length in bytes, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*(serialised(f) for f in fields)), 256)


def height(n: int) -> int:
    """Levels above n nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def layers(nodes: list[str], n: int, levels: int) -> list[list[str]]:
    """A vertex's digests level by level, of a tree that has n nodes where the vertex has these."""
    out = [nodes]
    for _ in range(min(levels, height(n))):
        out.append([digest(*out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def way(found: list[list[str]], i: int) -> list[str]:
    """From node i to the top of its vertex: place in its run, then the siblings' digests, for each level."""
    out = []
    for layer in found[:-1]:
        run = i - i % FAN
        out.append(f"{i % FAN}{''.join(layer[run:i] + layer[i + 1 : run + FAN])}")
        i //= FAN
    return out


def folded(start: str, steps: list[str]) -> str:
    """The root that a digest leads to by its way."""
    for step in steps:
        cut = 1 + 64 * int(step[0])
        start = digest(step[1:cut], start, step[cut:])
    return start


def climb(spark: SparkSession, nodes: DataFrame, extra: str, name: str) -> list[DataFrame]:
    """A table of vertices for each superstep upward: tree, vertex, n, nodes, done, top, and of the lowest extra's values.

    nodes: tree, idx, n (nodes of the tree), digest; extra: names of columns that the lowest vertices keep as lists.
    """
    levels, keep = LEVELS, extra.split()
    span = FAN**levels
    kinds = dict(nodes.dtypes)
    most = nodes.agg(F.max("n")).first()[0] or 0
    steps = []
    width = max(1, nodes.sparkSession.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while most:
        names = keep if not steps else []

        def compute(item: tuple, count: int = len(names)) -> tuple:
            (tree, vertex), messages = item
            got = sorted(messages, key=lambda m: m[0])
            found = layers([m[2] for m in got], n := got[0][1], levels)
            return tree, vertex, n, found[0], n <= span, found[-1][0], *([m[3 + k] for m in got] for k in range(count))

        sent = nodes.select("tree", "idx", "n", "digest", *names).rdd.map(lambda r: ((r[0], r[1] // span), tuple(r[1:])))
        schema = ", ".join(["tree long, vertex long, n long, nodes array<string>, done boolean, top string", *(f"{k} array<{kinds[k]}>" for k in names)])
        steps.append(materialise(spark.createDataFrame(sent.groupByKey(width).map(compute), schema, verifySchema=False), name))
        nodes = steps[-1].where("not done").select("tree", F.col("vertex").alias("idx"), F.ceil(F.col("n") / F.lit(span)).cast("long").alias("n"), F.col("top").alias("digest"))
        most = -(-most // span) if most > span else 0
        width = max(1, width // 4)
    return steps


def _met(vertices: DataFrame, messages: DataFrame, columns: list[str]):
    """Pairs (vertex row, message) by (tree, vertex)."""
    sent = messages.rdd.map(lambda r: ((r[0], r[1]), tuple(r[2:])))
    return vertices.select("tree", "vertex", "n", "nodes", *columns).rdd.map(lambda r: ((r[0], r[1]), tuple(r[2:]))).join(sent).map(lambda x: (*x[0], *x[1]))


def descend(spark: SparkSession, steps: list[DataFrame], starts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The lowest vertices and their messages (tree, vertex, way, subroot, root), after supersteps down all others.

    starts: tree, way, subroot, root of each tree's top.
    """
    schema = "tree long, vertex long, way array<string>, subroot string, root string"
    tops = [s.where("done").select("tree", "vertex").join(starts, "tree").select("tree", "vertex", "way", "subroot", "root") for s in steps]
    messages, levels = tops[-1], LEVELS

    def spread(item: tuple) -> Iterator[tuple]:
        tree, vertex, (n, nodes), (above, subroot, root) = item
        found, first = layers(list(nodes), n, levels), vertex * FAN**levels
        for i in range(len(nodes)):
            yield tree, first + i, way(found, i) + list(above), subroot, root

    for k in range(len(steps) - 1, 0, -1):
        below = spark.createDataFrame(_met(steps[k], messages, []).flatMap(spread), schema, verifySchema=False)
        messages = materialise(below.unionByName(tops[k - 1]), name)
    return steps[0], messages


def manifest(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row (doc_id, source, leaf, held).

    leaf is the digest that the manifest is made of, held that of the row as it is found now (null: the same).
    """
    spark, levels = rows.sparkSession, LEVELS
    leaves = materialise(placed(rows, ["source"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "manifest-order").withColumnRenamed("leaf", "digest"), "manifest-leaves")
    result = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    steps = climb(spark, leaves, "doc_id held", "manifest-up")
    if not steps:
        return spark.createDataFrame([], result)
    subroots = None
    for s in steps:
        of = s.where("done").select(F.col("tree").alias("own"), F.col("top").alias("digest"))
        subroots = of if subroots is None else subroots.unionByName(of)
    over = placed(subroots, [], [F.col("own")], "manifest-sources")
    top = climb(spark, over, "own", "manifest-up")
    root = top[-1].where("done").select("tree", F.lit([]).cast("array<string>").alias("way"), F.lit("").alias("subroot"), F.col("top").alias("root"))
    low, messages = descend(spark, top, root, "manifest-down")

    def sources(item: tuple) -> Iterator[tuple]:
        _, _, (n, nodes, own), (above, _, end) = item
        found = layers(list(nodes), n, levels)
        for i, tree in enumerate(own):
            yield tree, way(found, i) + list(above), nodes[i], end

    starts = materialise(spark.createDataFrame(_met(low, messages, ["own"]).flatMap(sources), "tree long, way array<string>, subroot string, root string", verifySchema=False), "manifest-down")
    low, messages = descend(spark, steps, starts, "manifest-down")

    def proofs(item: tuple) -> Iterator[tuple]:
        _, _, (n, nodes, ids, held), (above, subroot, end) = item
        found = layers(list(nodes), n, levels)
        for i, digest_now in enumerate(held):
            steps_up = way(found, i) + list(above)
            to = folded(nodes[i] if digest_now is None else digest_now, steps_up)
            yield ids[i], nodes[i], subroot, end, digest(*(s[1:] for s in steps_up)), to, to == end

    out = materialise(spark.createDataFrame(_met(low, messages, ["doc_id", "held"]).flatMap(proofs), result, verifySchema=False), "manifest")
    for used in (leaves, *steps, *top, starts):
        drop(used)
    return out


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, held against texts of which half have lost their line ends."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text")]
    tampered = (F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8")) % 2 == 0) & F.col("text").contains("\n")
    held = F.when(tampered, leaf([*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))]))
    return manifest(docs.select(fields[0].alias("doc_id"), "source", leaf(fields).alias("leaf"), held.alias("held")))


_FIELD_SQL = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD_SQL.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs: nodes of all levels of the trees over `leaves` (tree, idx, n, digest), and `{name}_way`, steps of each leaf."""
    return f"""
{name}(tree, level, idx, n, digest) AS (
  SELECT tree, 0, idx, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // {FAN}),
{name}_way AS (
  SELECT tree, place, list(coalesce(l, '') || ',' || coalesce(r, '') ORDER BY level) AS way FROM (
    SELECT a.tree, a.idx AS place, b.level, string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx // pow({FAN}, b.level)::BIGINT) AS l,
      string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx // pow({FAN}, b.level)::BIGINT) AS r
    FROM {leaves} a JOIN {name} b ON a.tree = b.tree AND b.n > 1 AND b.idx // {FAN} = a.idx // pow({FAN}, b.level + 1)::BIGINT
    GROUP BY a.tree, a.idx, b.level) GROUP BY tree, place)"""


OP12_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS digest,
    CASE WHEN doc_id IS NOT NULL AND {CRC32_SQL.format("coalesce(doc_id, 0)::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS held
  FROM documents),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n FROM rows),
{_tree_sql("nodes", "leaves").strip()},
tops AS (SELECT 0 AS tree, tree - 1 AS idx, count(*) OVER () AS n, digest FROM nodes WHERE n = 1),
{_tree_sql("over_nodes", "tops").strip()},
ways AS (
  SELECT l.*, t.digest AS subroot, r.digest AS root, coalesce(w.way, []) || coalesce(o.way, []) AS way
  FROM leaves l JOIN tops t ON t.idx = l.tree - 1 JOIN (SELECT digest FROM over_nodes WHERE n = 1) r ON true
  LEFT JOIN nodes_way w ON w.tree = l.tree AND w.place = l.idx LEFT JOIN over_nodes_way o ON o.place = l.tree - 1),
ends AS (
  SELECT *, list_reduce([coalesce(held, digest)] || way, lambda a, x: sha256(split_part(x, ',', 1) || a || split_part(x, ',', 2))) AS folded_root FROM ways)
SELECT doc_id, digest AS leaf, subroot, root, sha256(replace(array_to_string(way, ''), ',', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM ends
"""
