"""Prefix-sum tables and the box and texton features that read them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import INTEGRAL_SCALE, box_edges, inner_edges, integral_value


TILE = ["image_id", "ti", "tj"]
_CELLS = "image_id long, mask int, i int, j int, s double"


def _planes(px: pa.StructArray, labels: int) -> np.ndarray:
    """What is summed, pixels by masks: of `cls` 1 (or `prob`) at the label's mask, then `probs` themselves."""
    names, parts = [f.name for f in px.type], []
    if "cls" in names:
        one = px.field("cls").to_numpy(zero_copy_only=False)[:, None] == np.arange(labels)
        parts.append(one * px.field("prob").to_numpy(zero_copy_only=False)[:, None] if "prob" in names else one.astype(float))
    if "probs" in names:
        parts.append(px.field("probs").flatten().to_numpy(zero_copy_only=False).reshape(len(px), -1))
    return np.concatenate(parts, 1)


def _local(px: pa.StructArray, labels: int) -> tuple[int, int, np.ndarray]:
    """First row and column of a dense piece of an image, and its own sums (rows x columns x masks)."""
    i, j = (px.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("i", "j"))
    x = _planes(px, labels)
    grid_ = np.zeros((i.max() - i.min() + 1, j.max() - j.min() + 1, x.shape[1]))
    grid_[i - i.min(), j - j.min()] = x
    return int(i.min()), int(j.min()), grid_.cumsum(0).cumsum(1)


def _carried(tiles: DataFrame, labels: int) -> DataFrame:
    """Of each tile, what lies left of each of its rows, above each of its columns, and both left of and above it.

    Only the last column, the last row and the last corner of tiles travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [_local(px.values, labels)[2] for px in b.column(3)]
            edges = [pa.array([e.ravel() for e in cut], pa.list_(pa.float64())) for cut in ([x[:, -1] for x in sums], [x[-1] for x in sums], [x[-1, -1] for x in sums])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *edges], names=[*TILE, "right", "bottom", "total"])

    edges = tiles.mapInArrow(run, "image_id long, ti int, tj int, right array<double>, bottom array<double>, total array<double>")

    def before(rows: DataFrame, along: str, across: str) -> DataFrame:
        w = Window.partitionBy("image_id", across, "k").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("x", F.coalesce(F.sum("x").over(w), F.lit(0.0)))

    def packed(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*TILE).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias(name))

    each = {n: edges.select(*TILE, F.posexplode(n).alias("k", "x")) for n in ("right", "bottom", "total")}
    left = packed(before(each["right"], "tj", "ti"), "left")
    above = packed(before(each["bottom"], "ti", "tj"), "above")
    corner = packed(before(before(each["total"], "tj", "ti"), "ti", "tj"), "corner")
    return left.join(above, TILE).join(corner, TILE)


def _integrate(pixels: DataFrame, columns: Sequence[str], labels: int, tile: int | None) -> DataFrame:
    """image_id, mask, i, j, s from dense image_id, i, j and `columns`: sums over rows above and columns left, border of zeros.

    A pixel is one row, whatever the number of masks, and is sent once: to its
    image, which sums in a row, or with `tile` to its tile of so many rows and
    columns, for images too large for that.
    """
    part = (lambda c: F.floor(F.col(c) / tile).cast("int")) if tile else (lambda c: F.lit(0))
    cell = F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *columns)
    tiles = pixels.select(F.col("image_id").cast("long").alias("image_id"), part("i").alias("ti"), part("j").alias("tj"), cell.alias("c"))
    tiles = tiles.groupBy(*TILE).agg(F.collect_list("c").alias("px"))
    rows = tiles.join(_carried(tiles, labels), TILE).select(*TILE, "px", "left", "above", "corner") if tile else tiles.select(*TILE, "px")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, px in enumerate(b.column(3)):
                i0, j0, x = _local(px.values, labels)
                if tile:
                    left, above, corner = (b.column(c)[k].values.to_numpy(zero_copy_only=False).reshape(-1, x.shape[2]) for c in (4, 5, 6))
                    x = x + left[:, None] + above[None] + corner[None]
                # a pixel's sum stands one down and right; the first row and column have zeros before them
                up, back = int(i0 == 0), int(j0 == 0)
                x = np.pad(x, ((up, 0), (back, 0), (0, 0)))
                i, j, mask = (v.ravel() for v in np.indices(x.shape, np.int32))
                cols = [pa.array(np.full(x.size, b.column(0)[k].as_py(), np.int64)), pa.array(mask), pa.array(i + np.int32(i0 + 1 - up)), pa.array(j + np.int32(j0 + 1 - back)), pa.array(x.ravel())]
                yield pa.RecordBatch.from_arrays(cols, names=["image_id", "mask", "i", "j", "s"])

    return rows.mapInArrow(run, _CELLS)


def integral_labels(labels: DataFrame, num_vals: int, tile: int | None = None) -> DataFrame:
    """Prefix sums of label == m for each m; labels: image_id, i, j, cls (dense)."""
    return _integrate(labels, ["cls"], num_vals, tile)


def integral_labels_probs(labels: DataFrame, num_vals: int, tile: int | None = None) -> DataFrame:
    """The same with the label's probability (column prob) in place of 1."""
    return _integrate(labels, ["cls", F.col("prob").cast("double").alias("prob")], num_vals, tile)


def integral_all_probs(probs: DataFrame, tile: int | None = None) -> DataFrame:
    """Prefix sums of each class probability; probs: image_id, i, j, probs (array)."""
    return _integrate(probs, ["probs"], 0, tile)


def integral_spatial(scored: DataFrame, num_leaves: int, tile: int | None = None) -> DataFrame:
    """Masks 0.. of the leaves, then of the class probabilities; scored: image_id, i, j, leaf_id, probs.

    Image scores are carried beside the tables, as `preds` of to_integral_records.
    """
    return _integrate(scored, [F.col("leaf_id").alias("cls"), "probs"], num_leaves, tile)


def integral_dense(images: DataFrame, num_vals: int) -> DataFrame:
    """image_id, tables (flat array of (H+1) x (W+1) x num_vals sums) for images with a labels array: numpy, one image a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                labels = np.asarray(x.values.to_numpy()).reshape(h, w)
                table = np.zeros((h + 1, w + 1, num_vals))
                table[1:, 1:] = (labels[:, :, None] == np.arange(num_vals)).cumsum(0).cumsum(1)
                out.append(table.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["image_id", "tables"])

    return images.select(F.col("image_id").cast("long"), "height", "width", "labels").mapInArrow(run, "image_id long, tables array<double>")


#: Corner look-ups of each pattern, as (row, column) names of its box edges with their signs.
BOXES = {
    0: ((1, "y0", "x0", "y1", "x1"),),
    1: ((1, "y0", "x0", "y1", "x1"), (-1, "ya", "xa", "yb", "xb")),
    2: ((1, "y0", "xm", "y1", "x1"), (-1, "y0", "x0", "y1", "xm")),
    3: ((1, "y0", "x0", "ym", "x1"), (-1, "ym", "x0", "y1", "x1")),
    4: ((1, "y0", "x0", "y1", "xa"), (-1, "y0", "xa", "y1", "xb"), (1, "y0", "xb", "y1", "x1")),
    5: ((1, "y0", "x0", "ya", "x1"), (-1, "ya", "x0", "yb", "x1"), (1, "yb", "x0", "y1", "x1")),
    6: ((1, "y0", "xm", "ym", "x1"), (-1, "y0", "x0", "ym", "xm"), (-1, "ym", "x0", "y1", "xm"), (-1, "ym", "xm", "y1", "x1")),
}


def box_corner_lookup(points: DataFrame, integrals: DataFrame, pattern: int, params: dict[str, int], height: Column, width: Column, keys: list[str]) -> DataFrame:
    """keys, value: a box feature of each point by equi-joins of its signed corners with the table.

    height and width are those of the table.  Corners asked for twice are one.
    """
    e = box_edges(F.col("i"), F.col("j"), {k: F.lit(v) for k, v in params.items() if k != "mask"}, height, width)
    at = points.select(*keys, "image_id", *[c.alias(n) for n, c in e.items()])
    for n in "yx":
        for m, c in zip("abm", inner_edges(F.col(f"{n}0"), F.col(f"{n}1")), strict=True):
            at = at.withColumn(n + m, c)
    at = at.withColumn("area", (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    signed: dict[tuple[str, str], int] = {}
    for sign, a, b, c, d in BOXES[pattern]:
        for s, y, x in ((sign, c, d), (-sign, a, d), (-sign, c, b), (sign, a, b)):
            signed[y, x] = signed.get((y, x), 0) + s
    corners = F.array(*[F.struct(F.col(y).alias("ci"), F.col(x).alias("cj"), F.lit(s).alias("sign")) for (y, x), s in signed.items() if s])
    asked = at.select(*keys, "image_id", "area", F.explode(corners).alias("c")).select(*keys, "image_id", "area", "c.*")
    table = integrals.where(F.col("mask") == params["mask"]).select("image_id", F.col("i").alias("ci"), F.col("j").alias("cj"), "s")
    got = asked.join(table, ["image_id", "ci", "cj"])
    total = got.groupBy(*keys).agg(F.sum(F.col("sign") * F.col("s")).alias("out"), F.max("area").alias("area"))
    value = F.when(F.col("area") > 0, (F.col("out") / F.col("area") * INTEGRAL_SCALE).cast("long")).otherwise(F.lit(0).cast("long"))
    return total.select(*keys, value.alias("value"))


def texton_lookup(points: DataFrame, px: DataFrame, offsets: list[tuple[int, int, int]], height: Column, width: Column, keys: list[str]) -> DataFrame:
    """keys, v0, v1...: pixels at clamped offsets (di, dj, band) of each point; 0 for a band that isn't there."""
    clamp = lambda x, n: F.least(F.greatest(x, F.lit(0)), n - 1)
    asked = F.array(
        *[
            F.struct(clamp(F.col("i") + di, height).alias("ci"), clamp(F.col("j") + dj, width).alias("cj"), F.lit(b).alias("cb"), F.lit(k).alias("k"))
            for k, (di, dj, b) in enumerate(offsets)
        ]
    )
    rows = points.select(*keys, "image_id", F.explode(asked).alias("a")).select(*keys, "image_id", "a.*")
    table = px.select("image_id", F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("b").alias("cb"), "v")
    got = rows.join(table, ["image_id", "ci", "cj", "cb"], "left")
    return got.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).alias(f"v{k}") for k in range(len(offsets))])


def attach_image_scores(points: DataFrame, scores: DataFrame) -> DataFrame:
    return points.join(scores, "image_id")


def table_value(tables: Column, width: Column, masks: int, mask: Column) -> Column:
    """Column function for integral_value: reads a flat (rows x width x masks) table."""
    return lambda a, b: F.get(tables, ((a * width + b) * masks + mask).cast("int"))


def integral_feature(pattern: Column, e: dict[str, Column], tables: Column, width: Column, masks: int, mask: Column) -> Column:
    return integral_value(pattern, e, table_value(tables, width, masks, mask))
