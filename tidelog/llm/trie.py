"""Prefix trie of conversations as preorder intervals: what conversations share, and what sharing saves.

A node is a distinct sequence of first turns. Every turn (role, text) becomes a code of CODE bytes, so a node is the codes on
its way from the root, and the order of these byte strings is a preorder of the trie: nodes are told apart, counted before
they are shuffled, and ranked by one distributed sort. A subtree is then an interval of ranks. A node's members end inside
its interval and nowhere else, so the interval ends at the first node before which as many conversations have ended as had
ended before its start, plus its own members: one equi-join on prefix sums finds all ends, and leaves and savings of a
subtree are differences of prefix sums at both ends. A node's parent is the last node before it of one level less.

Conversations may be of any length: ways of more than SPAN turns are named block by block. Each pass replaces SPAN symbols
by the rank of their block, which keeps the order, so passes grow with the logarithm of the longest conversation, and no
row holds more than SPAN symbols. Turns are numbered by ranges of (conversation, turn), prefix sums go over blocks of ranks,
and lists of members are hashed as sorted streams: no task gathers a conversation, a level or the members of a node.

Turns are ordered by turn, null first; turns that tie are ordered by their code, so reruns agree, and repeated rows stay as
turns of their own. Null role or text is empty. Rows without conv_id take no part. Codes are the first bytes of a SHA-256:
turns with equal codes count as equal. Other columns are not looked at. An empty table has no conversations and no nodes,
not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import CRC32_SQL, materialise, placed, table

#: Bytes of a turn's code; turns to a block; ranks to a block of prefix sums.
CODE, SPAN, BLOCK = 16, 16, 1 << 16
#: Decimal characters of conv_ids that are hashed at a time.
CHUNK = 1 << 20
#: The query's shared openings: conversations of one hundred begin with up to five turns of the first of them.
FAMILY, OPENING = 100, 6


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, code (hex), size (code points of the text) of every turn of a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.sha2(whole, 256), 1, 2 * CODE).alias("code"), F.char_length(text).cast("long").alias("size"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, pos (0-based), code, size, n (turns of the conversation)."""
    return placed(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("code")], "trie-turns").select("conv_id", F.col("idx").alias("pos"), "code", "size", "n")


def reopened(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, code, size) of conversations that begin with turns of another, and all their conv_ids.

    Conversation c takes its first h turns from c - c % FAMILY, then goes on with its own after its first h; h is CRC-32 of
    its decimal id modulo OPENING. The opening may be shorter, or missing with that conversation. A conversation's length
    and its opener's are met once for each conversation; turns meet their conversation's row by (conv_id, block of turns).
    """
    c = F.col("conv_id")
    convs = own.groupBy("conv_id").agg(F.max("n").alias("n")).withColumn("h", F.crc32(F.encode(c.cast("string"), "UTF-8")) % OPENING)
    convs = convs.withColumn("opener", c - c % FAMILY)
    heads = convs.select(c.alias("opener"), F.col("n").alias("there"))
    convs = materialise(convs.join(heads, "opener", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "trie-convs")
    opening = own.where(F.col("pos") < OPENING - 1).select(c.alias("opener"), "pos", "code", "size")
    borrowed = convs.where("taken > 0").select("conv_id", "opener", "taken").join(opening, "opener").where("pos < taken").select("conv_id", "pos", "code", "size")
    shift = convs.where("n > h").select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK))).alias("part"))
    kept = own.withColumn("part", F.floor(F.col("pos") / BLOCK)).join(shift, ["conv_id", "part"]).where("pos >= h")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "code", "size")
    return borrowed.unionByName(kept), convs.select("conv_id")


def _hex(rank: Column) -> Column:
    return F.lpad(F.lower(F.hex(rank)), 16, "0")


def _ways(symbols: DataFrame, width: int) -> DataFrame:
    """For each (conv_id, block, offset) the block's symbols up to it, joined; symbols of `width` hex characters."""
    groups = symbols.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("offset", "symbol"))).alias("all"))
    groups = groups.select("conv_id", "block", F.concat_ws("", F.col("all.symbol")).alias("joined"), F.col("all.offset").alias("offsets"))
    spread = groups.select("conv_id", "block", "joined", F.explode("offsets").alias("offset"))
    return spread.select("conv_id", "block", "offset", F.unhex(F.substring("joined", F.lit(1), (F.col("offset") + 1).cast("int") * width)).alias("way"))


def ways(rows: DataFrame) -> DataFrame:
    """rows (conv_id, pos, code, ...) with way: byte strings that are equal for equal first turns and order them as a preorder."""
    longest = rows.agg(F.max("pos")).first()[0] or 0
    place = lambda x, k: F.floor(x / SPAN**k).cast("long")
    found = _ways(rows.select("conv_id", place(F.col("pos"), 1).alias("block"), (F.col("pos") % SPAN).alias("offset"), F.col("code").alias("symbol")), 2 * CODE)
    found = found.select("conv_id", (F.col("block") * SPAN + F.col("offset")).alias("pos"), "way")
    level = 1
    while longest >= SPAN**level:
        # the blocks' names: ranks of their different ways
        names = placed(found.select("way").distinct(), [], [F.col("way")], "trie-names").select("way", _hex(F.col("idx")).alias("symbol"))
        named = materialise(found.join(names, "way").select("conv_id", "pos", "symbol"), "trie-named")
        whole = named.where((F.col("pos") + 1) % SPAN**level == 0).select("conv_id", place(F.col("pos"), level).alias("at"), "symbol")
        before = whole.select("conv_id", (place(F.col("at"), 1)).alias("block"), (F.col("at") % SPAN).alias("offset"), "symbol")
        before = before.groupBy("conv_id", "block").agg(F.concat_ws("", F.sort_array(F.collect_list(F.struct("offset", "symbol")))["symbol"]).alias("joined"))
        at = named.withColumn("block", place(F.col("pos"), level + 1)).join(before, ["conv_id", "block"], "left")
        earlier = F.substring(F.coalesce("joined", F.lit("")), F.lit(1), (16 * (place(F.col("pos"), level) % SPAN)).cast("int"))
        found = at.select("conv_id", "pos", F.unhex(F.concat(earlier, "symbol")).alias("way"))
        level += 1
    return found


def _streams(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (rank, part, conv_id) in order to chunks (rank, part, ids), ids joined by commas."""
    now, held, size, n = None, [], 0, 0
    out: list[tuple] = []

    def flush():
        nonlocal held, size, n
        if held:
            out.append((*now, n, ",".join(held)))
            held, size, n = [], 0, n + 1

    for batch in batches:
        for rank, part, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (rank, part) != now:
                flush()
                now, n = (rank, part), 0
            held.append(str(conv))
            size += len(held[-1]) + 1
            if size >= limit:
                flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], ["rank", "part", "no", "ids"]) if out else _none("rank", "part", "no", ids=pa.string())
        out = []
    flush()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], ["rank", "part", "no", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks in order to the SHA-256 of each rank's whole list; one state is held at a time."""
    now, state = None, None
    for batch in batches:
        done = []
        for rank, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rank != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = rank, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["rank", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["rank", "ends_sha256"])


def _none(*longs: str, **others: pa.DataType) -> pa.RecordBatch:
    kinds = {k: pa.int64() for k in longs} | others
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds.values()], list(kinds))


def ends(members: DataFrame) -> DataFrame:
    """rank, ends_sha256 over the conv_ids (rank, conv_id) that end at each node, ascending and joined by commas.

    Ids are joined where ranges of (rank, conv_id) lie; only these chunks meet, as a stream that is hashed in order.
    """
    order = members.repartitionByRange("rank", "conv_id").sortWithinPartitions("rank", "conv_id")
    chunks = order.select("rank", F.spark_partition_id().cast("long").alias("part"), "conv_id").mapInArrow(partial(_streams, CHUNK), "rank long, part long, no long, ids string")
    return chunks.repartition("rank").sortWithinPartitions("rank", "part", "no").select("rank", "ids").mapInArrow(_hashed, "rank long, ends_sha256 string")


def sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes (rank, block, ...) with, for each value v, before_v: its sum over all lower ranks."""
    inside = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = nodes.groupBy(F.col("block").alias("_b")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    blocks = blocks.select("_b", *(F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    zero = F.lit(0)
    return nodes.join(blocks, F.col("block") == F.col("_b")).select(*nodes.columns, *((F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), zero)).alias(f"before_{v}") for v in values))


def parents(nodes: DataFrame) -> DataFrame:
    """rank, parent, parent_conv_id of all nodes (rank, block, depth, conv_id) but the root."""
    at = F.struct(F.col("rank").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # the last node of each depth before a block, from one row for each block and depth
    last = nodes.groupBy("block", "depth").agg(F.max(at).alias("last"))
    asked = nodes.where("depth > 0").select("block", (F.col("depth") - 1).alias("depth")).distinct()
    carried = last.join(asked, ["block", "depth"], "full").withColumn(
        "carried", F.last("last", ignorenulls=True).over(Window.partitionBy("depth").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ).where("carried IS NOT NULL").select(F.col("block").alias("_b"), F.col("depth").alias("_d"), "carried")
    tops = nodes.select("block", F.col("depth").alias("level"), "rank", at.alias("top"), F.lit(False).alias("asks"))
    below = nodes.where("depth > 0").select("block", (F.col("depth") - 1).alias("level"), "rank", F.lit(None).cast(tops.schema["top"].dataType).alias("top"), F.lit(True).alias("asks"))
    near = F.last("top", ignorenulls=True).over(Window.partitionBy("block", "level").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    found = tops.unionByName(below).withColumn("near", near).where("asks").select("block", "level", "rank", "near")
    found = found.join(carried, (F.col("block") == F.col("_b")) & (F.col("level") == F.col("_d")), "left")
    return found.select("rank", F.coalesce("near", "carried").alias("p")).select("rank", "p.parent", "p.parent_conv_id")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes, from the turns (conv_id, pos, code, size) of all conversations convs (conv_id).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and rank and until, the
    interval of its subtree.
    """
    rows = materialise(rows, "trie-rows")
    lengths = rows.groupBy("conv_id").agg((F.max("pos") + 1).alias("depth"))
    turned = rows.join(ways(rows), ["conv_id", "pos"]).select("conv_id", (F.col("pos") + 1).alias("depth"), "way", "size")
    starts = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("")).alias("way"), F.lit(0).cast("long").alias("size"))
    passed = materialise(starts.unionByName(turned), "trie-passed")
    # members that end at a node: one row for each conversation
    final = convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    ended = materialise(passed.join(final, ["conv_id", "depth"], "left_semi").select("way", "conv_id"), "trie-ended")
    counts = passed.groupBy("way").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"), F.max("size").alias("size"))
    nodes = placed(counts, [], [F.col("way")], "trie-nodes").select("way", F.col("idx").alias("rank"), "conv_id", "n_convs", "depth", "size")
    n_ended = ended.groupBy("way").agg(F.count("*").alias("n_ended"))
    nodes = nodes.join(n_ended, "way", "left").withColumn("n_ended", F.coalesce("n_ended", F.lit(0)))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).withColumn("leaf", (F.col("n_ended") == F.col("n_convs")).cast("long"))
    nodes = materialise(nodes.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long")), "trie-ranked")
    placed_sums = materialise(sums(nodes.drop("way"), ["n_ended", "leaf", "saved"]), "trie-sums")
    # the first node before which so many have ended; and the end of all
    border = placed_sums.groupBy(F.col("before_n_ended").alias("_ended")).agg(F.min_by(F.struct(F.col("rank").alias("until"), "before_leaf", "before_saved"), "rank").alias("end"))
    last = placed_sums.agg(F.max("rank") + 1, F.sum("n_ended"), F.sum("leaf"), F.sum("saved")).first()
    end = lambda k, name: F.coalesce(F.col(f"end.{name}"), F.lit(last[k] or 0)).cast("long")
    spans = placed_sums.join(border, F.col("before_n_ended") + F.col("n_convs") == F.col("_ended"), "left").select(
        "rank", "conv_id", "depth", "n_convs", end(0, "until").alias("until"),
        (end(2, "before_leaf") - F.col("before_leaf")).alias("n_leaves"), (end(3, "before_saved") - F.col("before_saved")).alias("saved_tokens"),
    )
    above = materialise(parents(nodes.select("rank", "block", "depth", "conv_id")), "trie-parents")
    children = above.groupBy(F.col("parent").alias("rank")).agg(F.count("*").alias("n_children"))
    hashed = ends(ended.join(nodes.select("way", "rank"), "way").select("rank", "conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    out = spans.join(above.drop("parent"), "rank", "left").join(children, "rank", "left").join(hashed, "rank", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "rank", "until",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each reopened with turns of the first of its family."""
    own = materialise(numbered(turns(table(spark, sf_dir, "conversations"))), "trie-own")
    return trie(*reopened(own)).drop("rank", "until")


OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, any_value(n) AS n, {CRC32_SQL.format("conv_id::VARCHAR")} % {OPENING} AS h FROM own GROUP BY conv_id),
sized AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
built AS (
  SELECT s.conv_id, o.pos + 1 AS depth, o.role, o.text FROM sized s JOIN own o ON o.conv_id = s.conv_id - s.conv_id % {FAMILY} AND o.pos < s.taken
  UNION ALL SELECT s.conv_id, o.pos - s.h + s.taken + 1, o.role, o.text FROM sized s JOIN own o ON o.conv_id = s.conv_id AND o.pos >= s.h),
passed AS (
  SELECT conv_id, depth, length(text) AS size, string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS way FROM built
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lasts AS (SELECT conv_id, max(depth) AS depth, max_by(way, depth) AS way FROM passed GROUP BY conv_id),
nodes AS (SELECT way, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(size) AS size FROM passed GROUP BY way),
kids AS (SELECT left(way, 64 * (depth - 1)) AS way, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (way)),
subtrees AS (
  SELECT up, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT left(way, 64 * unnest(range(depth + 1))) AS up, n_children, n_convs, size FROM full_nodes) GROUP BY up),
enders AS (SELECT way, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM lasts GROUP BY way)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes n JOIN subtrees s ON s.up = n.way LEFT JOIN nodes p ON n.depth > 0 AND p.way = left(n.way, 64 * (n.depth - 1)) LEFT JOIN enders e ON e.way = n.way
"""
