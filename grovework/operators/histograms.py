"""Class histograms, split histograms, information gain and the best split."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gains equal to so many decimal places are ties, which go to the lower candidate.
GAIN_DIGITS = 12


def validate_labels(df: DataFrame, label: str, num_classes: int | None = None) -> int:
    """The number of classes: that given, or more if a label needs it.  Negative labels are refused."""
    lo, hi = df.agg(F.min(label), F.max(label)).first()
    if lo is not None and lo < 0:
        raise ValueError(f"negative label {lo}")
    return max(num_classes or 0, 0 if hi is None else hi + 1)


def class_histogram(df: DataFrame, label: str, num_classes: int) -> DataFrame:
    """label, n for every class, zeros included; labels out of range don't count."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    classes = df.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("label"))
    return classes.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def weighted_histogram(df: DataFrame, label: str, weight_row: str, weight: str) -> DataFrame:
    """weight_row, label, total: one histogram for each row of weights."""
    return df.groupBy(weight_row, label).agg(F.sum(weight).alias("total"))


def normalized_histogram(df: DataFrame, label: str, num_classes: int) -> DataFrame:
    """label, prob; probabilities are 0 where there are no rows at all."""
    h = class_histogram(df, label, num_classes)
    total = F.sum("n").over(Window.partitionBy())  # num_classes rows
    return h.select("label", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)).alias("prob"))


def leaf_probability(points: DataFrame, by: Sequence[str], label: str, size: Column) -> DataFrame:
    """by, label, prob: shares of the classes of each group, every row counting `size` points."""
    sums = points.groupBy(*by, label).agg(F.sum(size).alias("n"))
    return sums.select(*by, label, (F.col("n") / F.sum("n").over(Window.partitionBy(*by))).alias("prob"))


def bin_counts(values: DataFrame, thresholds: dict[int, list[float]], kinds: dict[int, int], keys: Sequence[str]) -> DataFrame:
    """keys, label, feat, bin, n from rows (keys, label, values array): built-in form.

    bin is the number of thresholds at or below the value (kind 2: the one it
    equals, from 1, or 0).  Thresholds aren't exploded: a value is one row.
    """
    spec = F.array(
        *[
            F.struct(F.lit(kinds[f]).alias("kind"), F.array(*[F.lit(float(t)) for t in thresholds[f]]).alias("ts"))
            for f in sorted(thresholds)
        ]
    )
    one = values.select(*keys, "label", F.posexplode(F.arrays_zip(F.col("values").alias("v"), spec.alias("s"))).alias("feat", "x"))
    # thresholds are ascending: those at or below the value are a prefix
    below = F.size(F.filter("x.s.ts", lambda t: t <= F.col("x.v")))
    bin_ = F.when(F.col("x.s.kind") == 2, F.array_position("x.s.ts", F.col("x.v")).cast("int")).otherwise(below)
    return one.select(*keys, "label", "feat", bin_.alias("bin")).groupBy(*keys, "label", "feat", "bin").agg(F.count("*").alias("n"))


def bin_counts_batched(values: DataFrame, thresholds: dict[int, list[float]], kinds: dict[int, int], keys: Sequence[str]) -> DataFrame:
    """The same by batch: numpy bins and counts each Arrow batch, built-in sums add the partial counts."""
    feats = sorted(thresholds)
    bounds = [np.array(thresholds[f], float) for f in feats]
    cut = values.select(*[F.col(k).cast("long") for k in keys], F.col("label").cast("long"), "values")
    names = [*keys, "label", "feat", "bin", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            head = np.stack([b.column(i).to_numpy() for i in range(len(keys) + 1)], 1)
            x = b.column(len(keys) + 1).flatten().to_numpy().reshape(b.num_rows, -1)
            group, at = np.unique(head, axis=0, return_inverse=True)
            out = [count_bins(x[:, k], at.ravel(), group, bounds[f], kinds[f] == 2, f) for k, f in enumerate(feats)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(out).T], names=names)

    part = cut.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    summed = part.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))
    return summed.withColumn("feat", F.col("feat").cast("int")).withColumn("bin", F.col("bin").cast("int")).withColumn("label", F.col("label").cast("int"))


def count_bins(v: np.ndarray, at: np.ndarray, group: np.ndarray, ts: np.ndarray, categorical: bool, feat: int) -> np.ndarray:
    """Rows (*group, feat, bin, n) of values v, each of group[at]; bins as in bin_counts."""
    if categorical:
        place = np.searchsorted(ts, v).clip(max=len(ts) - 1)
        bin_ = np.where(ts[place] == v, place + 1, 0)
    else:
        bin_ = np.searchsorted(ts, v, side="right")
    width = len(ts) + 1
    counts = np.bincount(at * width + bin_, minlength=len(group) * width)
    own = np.flatnonzero(counts)
    return np.column_stack([group[own // width], np.full(len(own), feat), own % width, counts[own]])


def split_histograms(bins: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, feat_ind, label, ql, qr: counts on the failing and passing side of each candidate.

    candidates: feat, kind, rank (of the threshold among the feature's, from 1),
    feat_ind.  Classes a node doesn't have are left out.
    """
    base = [*keys, "feat", "label"]
    have = bins.groupBy(*base).agg(F.sum("n").alias("total"))
    grid = have.join(candidates.select("feat", "kind", F.col("rank").alias("bin"), "feat_ind"), "feat")
    filled = grid.join(bins, [*base, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # a threshold's passing side: all bins from its rank on
    onward = Window.partitionBy(*base).orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    qr = F.when(F.col("kind") == 2, F.col("n")).otherwise(F.sum("n").over(onward))
    return filled.withColumn("qr", qr).select(*keys, "feat_ind", "label", (F.col("total") - F.col("qr")).alias("ql"), "qr")


def merge_histograms(parts: DataFrame, keys: Sequence[str], images: DataFrame | None = None) -> DataFrame:
    """Sums of partial split histograms; with images (keys, image_id: those each part has seen) also num_images of each node."""
    merged = parts.groupBy(*keys, "feat_ind", "label").agg(F.sum("ql").alias("ql"), F.sum("qr").alias("qr"))
    if images is None:
        return merged
    return merged.join(images.groupBy(*keys).agg(F.countDistinct("image_id").alias("num_images")), list(keys))


def entropy(hist: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """keys, entropy in bits; classes without rows are skipped."""
    total = F.sum(count).over(Window.partitionBy(*keys))
    p = F.col(count) / total
    return (
        hist.withColumn("__p", F.when(total > 0, p))
        .groupBy(*keys)
        .agg(F.coalesce(F.sum(F.when(F.col("__p") > 0, -F.col("__p") * F.log2("__p"))), F.lit(0.0)).alias("entropy"))
    )


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)


def information_gain(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, feat_ind, gain in bits: 0 when a side is empty.

    n*H(q) = n*log2(n) - sum(q*log2(q)), so one aggregate gives all three entropies.
    """
    q = F.col("ql") + F.col("qr")
    s = hist.groupBy(*keys, "feat_ind").agg(
        F.sum("ql").alias("nl"), F.sum("qr").alias("nr"),
        F.sum(_xlogx(F.col("ql"))).alias("sl"), F.sum(_xlogx(F.col("qr"))).alias("sr"), F.sum(_xlogx(q)).alias("sa"),
    )
    n = F.col("nl") + F.col("nr")
    gain = ((_xlogx(n) - F.col("sa")) - (_xlogx(F.col("nl")) - F.col("sl")) - (_xlogx(F.col("nr")) - F.col("sr"))) / n
    return s.select(*keys, "feat_ind", F.when((F.col("nl") == 0) | (F.col("nr") == 0), 0.0).otherwise(F.round(gain, GAIN_DIGITS)).alias("gain"))


def best_split(gains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, gain, feat_ind: the largest gain; ties go to the lowest feat_ind."""
    best = F.max(F.struct(F.col("gain"), (-F.col("feat_ind")).alias("f"))).alias("b")
    found = gains.groupBy(*keys).agg(best) if keys else gains.agg(best).where("b is not null")
    return found.select(*keys, F.col("b.gain").alias("gain"), (-F.col("b.f")).alias("feat_ind"))


def dim_ranges(df: DataFrame, features: str) -> DataFrame:
    """dim, lo, hi of each vector component."""
    return df.select(F.posexplode(features).alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def partition_by_split(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that fail and rows that pass a test; rows where it is null fail."""
    return df.where(~F.coalesce(test, F.lit(False))), df.where(test)
