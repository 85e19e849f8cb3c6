"""Values carried on from line to line, a block of lines to a task, so that one huge file is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Lines to a block. A window holds one block of one file; what crosses blocks is one row per block.
BLOCK = 65_536


def block_of(line_no: Column, block: int = BLOCK) -> Column:
    # never null, as a quotient may be to the optimizer: a null test on one side of a join would set equal exchanges apart
    return F.coalesce(F.floor(line_no / block).cast("long"), F.lit(0).cast("long"))


def in_block(backward: bool = False) -> WindowSpec:
    return Window.partitionBy("path", "_block").orderBy(F.col("line_no").desc() if backward else F.col("line_no"))


def carried(rows: DataFrame, block: int = BLOCK, backward: bool = False, strictly: bool = False, once: bool = False, **values: Column) -> DataFrame:
    """rows with, by name, the last value that is not null at or before each line; strictly: before it.

    backward looks the other way. Values are carried within blocks of lines; each block's last value, a row per block and
    file, is carried over the blocks and joined on. rows are read twice, the second time for those last values alone; with
    once, they are dealt by block and both readings share that exchange, so rows should hold nothing but path, line_no and
    what the values need. A column _block of rows comes back as the block, by which the result is then dealt.
    """
    b = rows.withColumn("_block", block_of(F.col("line_no"), block))
    b = b.repartition("path", "_block") if once else b
    nearest = F.min_by if backward else F.max_by
    ends = b.groupBy("path", "_block").agg(*[nearest(v, F.when(v.isNotNull(), F.col("line_no"))).alias(f"_end_{n}") for n, v in values.items()])
    over = Window.partitionBy("path").orderBy(F.col("_block").desc() if backward else F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("path", "_block", *[F.last(f"_end_{n}", ignorenulls=True).over(over).alias(f"_end_{n}") for n in values])
    own = in_block(backward).rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    out = b.select("*", *[F.last(v, ignorenulls=True).over(own).alias(f"_own_{n}") for n, v in values.items()]).join(ends, ["path", "_block"])
    return out.select(*rows.columns, *[F.coalesce(f"_own_{n}", f"_end_{n}").alias(n) for n in values])


def with_next(rows: DataFrame, block: int = BLOCK, **values: Column) -> DataFrame:
    """rows with, by name, the value of the line after. Each block also gets the first line of the next one, for its last."""
    at = block_of(F.col("line_no"), block)
    first = (F.col("line_no") % block == 0) & (F.col("line_no") > 0)
    b = rows.withColumn("_block", F.explode(F.when(first, F.array(at, at - 1)).otherwise(F.array(at))))
    b = b.select("*", *[F.lead(v).over(in_block()).alias(n) for n, v in values.items()])
    return b.where(F.col("_block") == at).drop("_block")


def running_sum(rows: DataFrame, value: Column, name: str, block: int = BLOCK, once: bool = False) -> DataFrame:
    """rows with the sum of value over the lines before each, and last_line (the file's last line_no).

    rows are read twice, the second time for sums of blocks alone; once is as in carried().
    """
    b = rows.withColumn("_block", block_of(F.col("line_no"), block))
    b = b.repartition("path", "_block") if once else b
    sums = b.groupBy("path", "_block").agg(F.sum(value).alias("_sum"), F.max("line_no").alias("_top"))
    over = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("path", "_block", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"), F.max("_top").over(Window.partitionBy("path")).alias("last_line"))
    own = in_block().rowsBetween(Window.unboundedPreceding, -1)
    out = b.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(sums, ["path", "_block"])
    return out.select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name), "last_line")
