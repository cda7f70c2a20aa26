"""Operator 8: mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, materialize, running_sum, table, unused, word_count

#: Ranks are counted in this many bins before any rows are sorted.
BINS = 4096
#: A document of so many words or more has twice the inclusion weight of an empty one.
FAVOUR = 1000
TWO52 = float(2**52)


def uniform(key: Column, seed: str) -> Column:
    """A draw in (0, 1) fixed by the key: 52 bits of an MD5, the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(TWO52)


def source_targets(sizes: DataFrame, weights: Sequence[int], share_percent: int, most: int) -> DataFrame:
    """source, source_size long -> adds target double.

    Sources in code-point order (null last) weigh `weights`, repeating, and
    share `share_percent` of the total.  A target above `most` times its
    source's size stops there and the excess is reshared by weight.  In order
    of most*size/weight the sources that stop come first, so the level at which
    the rest share is found by one running sum over the sources.
    """
    ranked = sizes.withColumn(
        "__w",
        F.element_at(
            F.array(*[F.lit(int(w)) for w in weights]),
            ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"),
        ).cast("long"),
    ).withColumn("__cap", F.col("source_size") * most)
    order = [F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.withColumn(
        "__level",
        (F.sum("source_size").over(everything) * share_percent - F.coalesce(F.sum("__cap").over(before), F.lit(0)) * 100)
        / (F.sum("__w").over(onward) * 100),
    )
    level = level.withColumn(
        "__level",
        F.first(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level")), ignorenulls=True).over(everything),
    )
    # no level: even all caps together fall short of the share
    return level.withColumn(
        "target",
        F.when(F.col("__level").isNull(), F.col("__cap").cast("double")).otherwise(
            F.least(F.col("__level") * F.col("__w"), F.col("__cap").cast("double"))
        ),
    ).select("source", "source_size", "target")


def pareto_mix(docs: DataFrame, targets: DataFrame, seed: str = "mix", weight: str | None = None) -> DataFrame:
    """How many whole copies of each document a mix takes.

    docs: doc_id, source, size long, row (a unique long; made here where docs
    have none) and, if named, a positive inclusion weight within the source;
    targets: source, source_size, target.  Returns these with copies.  A document's wish is
    target/source_size: its whole part is certain, and the fraction is the chance
    of one more copy, times the document's weight (a whole number) over the
    source's size-weighted mean weight, 1 at most.  For these, documents
    rank by the draw's odds over the odds of the fraction, and a source takes
    them in that order while their sizes fit in what certain copies leave of
    its target; last, the one document left whose size comes nearest to what
    is missing, if that brings the source nearer.

    Draws are fixed by doc_id, and by `draw` where docs have that column.
    Only the bin of ranks in which a source's budget ends is sorted, by ranges,
    so equal ranks are spread too; the other bins need just their sums.  Equal
    ranks go by size and doc_id; rows equal in all of these are
    interchangeable.  Sources without size take nothing.
    """
    if "row" not in docs.columns:
        docs = checkpoint(docs.withColumn("row", F.monotonically_increasing_id()))
    t = targets.withColumnRenamed("source", "__source")
    rows = docs.join(t, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if weight is not None:
        sums = docs.groupBy(F.col("source").alias("__source")).agg(F.sum(F.col(weight) * F.col("size")).cast("double").alias("__weighed"))
        rows = rows.join(sums, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        more = (wish - F.floor(wish)) * F.col(weight) * F.col("source_size") / F.nullif("__weighed", F.lit(0.0))
        wish = F.floor(wish) + F.coalesce(F.least(more, F.lit(1.0)), F.lit(0.0))
    frac = F.col("__wish") - F.floor("__wish")
    odds = F.col("__u") / (1 - F.col("__u")) * (1 - F.col("__frac")) / F.col("__frac")
    rows = checkpoint(
        rows.withColumn("__wish", wish)
        .withColumn("__whole", F.floor("__wish").cast("long"))
        .withColumn("__frac", frac)
        .withColumn("__u", uniform(F.col("draw") if "draw" in docs.columns else F.col("doc_id"), seed))
        .withColumn("__q", F.when(F.col("__frac") > 0, odds))
        .withColumn("__bin", F.floor(F.col("__q") / (1 + F.col("__q")) * BINS).cast("int"))
        .select("row", "doc_id", "source", "size", "source_size", "target", "__whole", "__q", "__bin")
    )
    bins = rows.groupBy("source", "__bin").agg(
        F.sum(F.when(F.col("__bin").isNotNull(), F.col("size"))).alias("__words"),
        F.sum(F.col("size") * F.col("__whole")).alias("__certain"),
        F.max("target").alias("__target"),
    )
    w = Window.partitionBy("source")
    bins = (
        bins.withColumn("__budget", F.max("__target").over(w) - F.sum("__certain").over(w))
        .where(F.col("__bin").isNotNull())
        .withColumn(
            "__before",
            F.sum("__words").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__words"),
        )
        .withColumnsRenamed({"source": "__s", "__bin": "__b"})
        .select("__s", "__b", "__budget", "__before", "__words")
    )
    placed = rows.join(bins, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b")), "left").drop("__s", "__b")
    full = F.col("__before") + F.col("__words") <= F.col("__budget")
    cut = (F.col("__before") <= F.col("__budget")) & ~full
    placed = checkpoint(placed.withColumn("__cut", F.coalesce(cut, F.lit(False))).withColumn("__full", F.coalesce(full, F.lit(False))))
    names = ["row", "doc_id", "source", "size", "source_size", "target", "__whole", "__q", "__budget"]
    settled = placed.where(~F.col("__cut")).select(*names, F.col("__full").cast("int").alias("__one"))
    cutting = running_sum(placed.where("__cut"), ["source"], ["__q", "size", "doc_id"], F.col("size"), "__upto")
    fits = (F.col("__before") + F.col("__upto") <= F.col("__budget")).cast("int")
    chosen = checkpoint(settled.unionByName(cutting.select(*names, fits.alias("__one"))))
    missing = (
        chosen.groupBy("source")
        .agg(F.max("__budget").alias("__budget"), F.sum(F.col("size") * F.col("__one")).alias("__got"))
        .select(F.col("source").alias("__s"), (F.col("__budget") - F.col("__got")).alias("__missing"))
    )
    left = chosen.where((F.col("__one") == 0) & F.col("__q").isNotNull()).join(
        missing, F.col("source").eqNullSafe(F.col("__s"))
    )
    last = (
        left.withColumn("__off", F.abs(F.col("size") - F.col("__missing")))
        .where(F.col("__off") < F.abs("__missing"))
        .groupBy("source")
        .agg(F.min_by("row", F.struct("__off", "__q", "size", "doc_id", "row")).alias("__last"))
        .select("__last")
    )
    copies = F.col("__whole") + F.col("__one") + F.col("__last").isNotNull().cast("int")
    # one row a source
    return chosen.join(last, F.col("row") == F.col("__last"), "left").select(
        "row", "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")
    )


def _mixed(docs: DataFrame, row: Column, weights: Sequence[int], share_percent: int, most: int, seed: str) -> DataFrame:
    # null doc_ids are told apart by their texts
    draw = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")))
    sized = docs.select(row.alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw"))
    # a longer document is up to twice as likely to be taken once more as a short one
    sized = checkpoint(sized.withColumn("favour", FAVOUR + F.least("size", F.lit(FAVOUR).cast("long"))))
    targets = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_percent, most
    )
    return pareto_mix(sized, targets, seed, "favour")


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share_percent: int = 150, most: int = 2, seed: str = "mix"
) -> DataFrame:
    """Whole documents mixed to the sources' weights: doc_id, size, source_size, target, taken, copies.

    Within a source, a document's odds of one more copy grow with its size, up to
    FAVOUR words, to twice those of an empty one.

    size is the number of words (null text: 0); taken = size * copies, copies
    at most `most`.  A null source is one source.  Rows that repeat are each
    counted, and documents without a doc_id are drawn by their text.  An empty
    table gives none.
    """
    return _mixed(docs, F.monotonically_increasing_id(), weights, share_percent, most, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each row as often as the mix takes it (0, 1 or 2 times).

    Rows are numbered once and written, so that null, repeated and equal
    doc_ids each keep their own number of copies.
    """
    row, copies = unused(docs, "row", "copies")
    own = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = _mixed(own, F.col(row), (5, 2, 1), 150, 2, "mix").where("copies > 0")
    kept = own.join(taken.select(F.col("row").alias(row), F.col("copies").alias(copies)), row)
    return kept.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, md5(text), 'null') AS draw FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w,
             source_size * 2 AS cap FROM src),
lv AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT * 150
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 100)::DOUBLE
            / ((sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT * 100)::DOUBLE AS lev
  FROM w),
lv2 AS (SELECT *, first_value(CASE WHEN lev * w <= cap THEN lev END IGNORE NULLS) OVER (
  ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM lv),
tgt AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(level * w, cap::DOUBLE) END AS target FROM lv2),
r AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate, 1000 + least(size, 1000) AS favour,
         (('0x' || substr(md5('mix/' || draw), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(rate) + coalesce(least((rate - floor(rate)) * favour::DOUBLE * source_size::DOUBLE / nullif((sum(favour * size) OVER (PARTITION BY source))::DOUBLE, 0), 1.0::DOUBLE), 0.0::DOUBLE) AS wish FROM r),
q AS (
  SELECT *, floor(wish)::BIGINT AS whole, wish - floor(wish) AS frac FROM p),
q2 AS (SELECT *, CASE WHEN frac > 0 THEN u / (1 - u) * (1 - frac) / frac END AS q FROM q),
b AS (
  SELECT *, target - sum(size * whole) OVER (PARTITION BY source)::BIGINT AS budget,
         sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM q2),
c AS (SELECT *, CASE WHEN q IS NOT NULL AND upto <= budget THEN 1 ELSE 0 END AS one FROM b),
m AS (SELECT *, budget - sum(size * one) OVER (PARTITION BY source)::BIGINT AS missing FROM c),
l AS (SELECT *, CASE WHEN one = 0 AND q IS NOT NULL AND abs(size - missing) < abs(missing)
                     THEN row_number() OVER (PARTITION BY source, (one = 0 AND q IS NOT NULL AND abs(size - missing) < abs(missing))
                                             ORDER BY abs(size - missing), q, size, doc_id) END AS rk FROM m)
SELECT doc_id, size, source_size, target, size * (whole + one + CASE WHEN rk = 1 THEN 1 ELSE 0 END) AS taken,
       (whole + one + CASE WHEN rk = 1 THEN 1 ELSE 0 END)::BIGINT AS copies
FROM l
"""
