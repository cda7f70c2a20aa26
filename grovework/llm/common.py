"""What several operators share: shared storage, word rules, graph components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import checkpoint, shared_dir

#: Words are maximal runs of anything but space, tab and the four line controls.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: a short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """`names` with as many underscores before them as no column of `df` begins with."""
    lead = "__"
    while any(c.startswith(lead) for c in df.columns):
        lead += "_"
    return [lead + n for n in names]


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str, part_rows: int = 1_000_000) -> DataFrame:
    """df with `name`, the sum of `value` over the rows of its group up to and including its own, in `order`.

    Rows equal in `order` follow each other in any order.  Rows are dealt by
    ranges of (group, order, row number), summed within their range, and the
    ranges' sums give each its first value: however large a group, and however
    many equal rows it has, no task sorts more than a range of about `part_rows`.
    df is read more than once, so it should be written or checkpointed.
    """
    tie, part, total, before = unused(df, "tie", "part", "total", "before")
    parts = max(partitions(df), math.ceil(df.count() / part_rows))
    placed = checkpoint(
        df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *group, *order, tie).withColumn(part, F.spark_partition_id())
    )
    up_to = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    # a row for each range and group in it
    sums = placed.groupBy(part, *group).agg(F.sum(value).alias(total)).withColumn(before, F.sum(total).over(up_to) - F.col(total))
    sums = sums.select(F.col(part).alias(total), F.struct(*group).alias(tie + "_g"), before)
    inner = Window.partitionBy(part, *group).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn(name, F.sum(value).over(inner))
    met = summed.join(sums, (F.col(part) == F.col(total)) & F.struct(*group).eqNullSafe(F.col(tie + "_g")))
    return met.withColumn(name, F.col(name) + F.col(before)).select(*df.columns, name)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, part_rows: int = 250_000) -> DataFrame:
    """df with `name`, the place of each row in its group in `order`, from 0 and without gaps; equal rows in any order.

    Rows are sorted in ranges of (group, order, row number) and numbered as they
    are written; a range's first number and the rows of the group before it
    make the place.  So no group and no frequent key is sorted by one task, and
    whole rows travel once.  df is read more than once, so it should be written.
    """
    tie, at, part, first, before = unused(df, "tie", "at", "part", "first", "before")
    parts = max(partitions(df), math.ceil(df.count() / part_rows))
    keys = [*group, *order, tie]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = materialize(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()))
    own = F.shiftright(F.col(at), 33)
    up_to = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    ranges = placed.groupBy(own.alias(part), *group).agg(F.min(at).alias(first), F.count("*").alias(before))
    ranges = ranges.withColumn(before, F.sum(before).over(up_to) - F.col(before))
    # one row for each range and group in it: as many as ranges and groups together
    ranges = F.broadcast(ranges.select(part, F.struct(*group).alias(tie), first, before))
    met = placed.join(ranges, (own == F.col(part)) & F.struct(*group).eqNullSafe(F.col(tie)))
    return met.withColumn(name, F.col(at) - F.col(first) + F.col(before)).select(*df.columns, name)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph.

    `edges` has columns a, b (long).  Returns node, root (the smallest node
    reachable) for every node of an edge.  Alternates hooking each node's
    larger neighbours on its smallest one and its smaller neighbours likewise,
    until nothing moves: each round is two shuffles of at most as many edges
    as there were, and chains shorten by half.  No node's neighbours are
    gathered in one place; minima are partial aggregates.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e has b < a.  large: every neighbour takes part; else the smaller ones only.
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = both.join(least, "a")
        if large:
            moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return moved.where(F.col("a") != F.col("b")).distinct()

    e = checkpoint(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        e = checkpoint(star(star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
