"""Kinds of features: their candidates, and their values of a block of samples at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import INTEGRAL_SCALE, box_edges, integral_value, pixel, texton_value, vector_test
from ..operators.raster import BOXES
from ..random import Draws


@dataclass
class Candidates:
    """Features with parameters, and ascending thresholds of each; feat_ind numbers all pairs."""

    params: list[dict]
    thresholds: list[list[float]]

    @property
    def per_feature(self) -> int:
        return len(self.thresholds[0]) if self.thresholds else 0

    def rows(self) -> list[tuple]:
        """(feat, kind, rank, feat_ind, t)"""
        return [
            # a category that was drawn twice is one bin
            (f, self.params[f].get("kind", 0), (ts.index(t) if self.params[f].get("kind", 0) == 2 else k) + 1, f * self.per_feature + k, float(t))
            for f, ts in enumerate(self.thresholds)
            for k, t in enumerate(ts)
        ]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "feat int, kind int, rank int, feat_ind int, t double")

    def kinds(self) -> dict[int, int]:
        return {f: p.get("kind", 0) for f, p in enumerate(self.params)}

    def select(self, feat_ind: int) -> tuple[int, float]:
        """The feature and threshold of a candidate."""
        return feat_ind // self.per_feature, float(self.thresholds[feat_ind // self.per_feature][feat_ind % self.per_feature])


class Block:
    """Samples that are looked at together: label and image of each, and values of features of some of them."""

    def __init__(self, label: np.ndarray, image: np.ndarray):
        self.label, self.image = label, image

    def __len__(self) -> int:
        return len(self.label)

    def value(self, params: dict, rows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def matrix(self, params: Sequence[dict], rows: np.ndarray) -> np.ndarray:
        """Rows by features."""
        return np.stack([self.value(p, rows) for p in params], 1).astype(float) if params else np.zeros((len(rows), 0))


class ArrayBlock(Block):
    def __init__(self, label: np.ndarray, image: np.ndarray, x: np.ndarray, column: Callable[[dict], int]):
        super().__init__(label, image)
        self.x, self.column = x, column

    def value(self, params: dict, rows: np.ndarray) -> np.ndarray:
        return self.x[rows, self.column(params)]

    def matrix(self, params: Sequence[dict], rows: np.ndarray) -> np.ndarray:
        return self.x[rows][:, [self.column(p) for p in params]].astype(float)


def _named(params: Sequence[dict], *names: str) -> list[np.ndarray]:
    return [np.array([p[n] for p in params], np.int64)[None, :] for n in names]


class TextonBlock(Block):
    """Points (i, j) of one image of height x width x bands, or of a stack of such: `at` is each point's place in it."""

    def __init__(self, label: np.ndarray, image: np.ndarray, i: np.ndarray, j: np.ndarray, pixels: np.ndarray, at: np.ndarray | None = None):
        super().__init__(label, image)
        self.i, self.j = i, j
        self.pixels, self.at = (pixels[None], np.zeros(len(i), np.int64)) if at is None else (pixels, at)

    def value(self, params: dict, rows: np.ndarray) -> np.ndarray:
        return self.matrix([params], rows)[:, 0]

    def matrix(self, params: Sequence[dict], rows: np.ndarray) -> np.ndarray:
        _, h, w, bands = self.pixels.shape

        def at(k: int) -> np.ndarray:
            dy, dx, b = _named(params, f"dy{k}", f"dx{k}", f"b{k}")
            i, j = np.clip(self.i[rows, None] + dy, 0, h - 1), np.clip(self.j[rows, None] + dx, 0, w - 1)
            return np.where((b >= 0) & (b < bands), self.pixels[self.at[rows, None], i, j, np.clip(b, 0, bands - 1)], 0)

        a, b, (kind,) = at(0), at(1), _named(params, "texton")
        return np.choose(kind, [a, a + b, a - b, np.abs(a - b)]).astype(float)


class BoxBlock(Block):
    """Points (i, j) of one image's prefix sums, of (height + 1) x (width + 1) x masks, and its scores, or of a stack of such as in TextonBlock."""

    def __init__(self, label: np.ndarray, image: np.ndarray, i: np.ndarray, j: np.ndarray, sums: np.ndarray, preds: np.ndarray, at: np.ndarray | None = None):
        super().__init__(label, image)
        self.i, self.j = i, j
        self.sums, self.preds, self.at = (sums[None], preds[None], np.zeros(len(i), np.int64)) if at is None else (sums, preds, at)

    def value(self, params: dict, rows: np.ndarray) -> np.ndarray:
        return self.matrix([params], rows)[:, 0]

    def matrix(self, params: Sequence[dict], rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(params)))
        kinds: dict[int, list[int]] = {}
        for k, p in enumerate(params):
            kinds.setdefault(p["pattern"], []).append(k)
        for pattern, own in kinds.items():
            some = [params[k] for k in own]
            out[:, own] = self._boxes(pattern, some, rows) if pattern >= 0 else np.trunc(self.preds[self.at[rows, None], [p["ilp_dim"] for p in some]] * INTEGRAL_SCALE)
        return out

    def _boxes(self, pattern: int, params: Sequence[dict], rows: np.ndarray) -> np.ndarray:
        _, h, w, _ = self.sums.shape
        at = self.at[rows, None]
        uy, ux, bh, bw, mask = _named(params, "uy", "ux", "bh", "bw", "mask")
        y, x = self.i[rows, None] + uy, self.j[rows, None] + ux
        edge = {"y0": np.clip(y - bh, 0, h - 1), "y1": np.clip(y + bh + 1, 0, h - 1), "x0": np.clip(x - bw, 0, w - 1), "x1": np.clip(x + bw + 1, 0, w - 1)}
        for n in "yx":
            lo, d = edge[f"{n}0"], edge[f"{n}1"] - edge[f"{n}0"]
            edge |= {f"{n}a": lo + d // 3, f"{n}b": lo + 2 * d // 3, f"{n}m": lo + d // 2}
        out = 0.0
        for sign, a, b, c, d in BOXES[pattern]:
            a, b, c, d = edge[a], edge[b], edge[c], edge[d]
            out = out + sign * (self.sums[at, c, d, mask] - self.sums[at, a, d, mask] - self.sums[at, c, b, mask] + self.sums[at, a, b, mask])
        area = (edge["y1"] - edge["y0"]) * (edge["x1"] - edge["x0"])
        return np.where(area > 0, np.trunc(out / np.maximum(area, 1) * INTEGRAL_SCALE), 0.0)


def box_values(s: np.ndarray, i: np.ndarray, j: np.ndarray, p: dict, preds: Sequence[float] | None) -> np.ndarray:
    """integral_value of many points of one table."""
    none = np.zeros(len(i), np.int64)
    return BoxBlock(none, none, i, j, s, np.array(preds if preds is not None else [])).value(p, np.arange(len(i)))


def _image(samples: DataFrame) -> Column:
    return (F.col("image_id").cast("long") if "image_id" in samples.columns else F.lit(None).cast("long")).alias("image")


def _longs(a: pa.Array) -> np.ndarray:
    return a.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


class FeatureFamily:
    """What training and scoring need of a kind of feature.

    A family of one's own gives candidates() and value(), a column for a
    feature's parameters; or value_np() and the `columns` that it reads.  A
    model's splits hold `name` and the parameters (whole numbers) themselves.
    """

    name: ClassVar[str] = "custom"
    #: Columns that value_np reads; empty for families with a column form.
    columns: ClassVar[Sequence[str]] = ()

    def candidates(self, num_feat: int, num_thresh: int, seed: int) -> Candidates:
        raise NotImplementedError

    def value(self, params: dict) -> Column:
        raise NotImplementedError

    def values(self, cands: Candidates) -> Column:
        return F.array(*[self.value(p).cast("double") for p in cands.params])

    def value_np(self, batch: pa.RecordBatch, params: dict) -> np.ndarray:
        """A feature of an Arrow batch of samples: label, image, then `columns`."""
        raise NotImplementedError

    def test(self, params: dict, t: float) -> Column:
        """Whether a sample passes a candidate."""
        return vector_test(self.value(params), F.lit(params.get("kind", 0)), F.lit(float(t)))

    def source(self, samples: DataFrame, params: Sequence[dict]) -> DataFrame:
        """What blocks() reads: label, image, and columns enough for features of these parameters."""
        label = F.col("label").cast("int").alias("label")
        if self.columns:
            return samples.select(label, _image(samples), *self.columns)
        return samples.select(label, _image(samples), F.array(*[self.value(p).cast("double") for p in params]).alias("values"))

    def blocks(self, batch: pa.RecordBatch, params: Sequence[dict]) -> Iterator[Block]:
        """The samples of a batch of source(samples, params)."""
        label, image = _longs(batch.column(0)), _longs(batch.column(1))
        if self.columns:
            family = self

            class Own(Block):
                def value(self, p: dict, rows: np.ndarray) -> np.ndarray:
                    return np.asarray(family.value_np(batch, p))[rows]

            yield Own(label, image)
        else:
            place = {tuple(sorted(p.items())): k for k, p in enumerate(params)}
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield ArrayBlock(label, image, x, lambda p: place[tuple(sorted(p.items()))])

    def kept(self, batch: pa.RecordBatch, keep: Sequence[np.ndarray]) -> pa.RecordBatch:
        """The batch with those samples of each block that stay."""
        return batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    def attach(self, samples: DataFrame, cands: Candidates) -> DataFrame:
        """label, values of all candidates' features, and image (null where samples have no image_id) of every sample."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block in self.blocks(b, cands.params):
                    x = block.matrix(cands.params, np.arange(len(block)))
                    offsets = pa.array(np.arange(0, x.size + 1, len(cands.params), dtype=np.int32))
                    image = pa.array(block.image, pa.int64(), mask=block.image < 0)
                    cols = [pa.array(block.label, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), image]
                    yield pa.RecordBatch.from_arrays(cols, names=["label", "values", "image"])

        return self.source(samples, cands.params).mapInArrow(run, "label int, values array<double>, image long")


@dataclass
class VectorFamily(FeatureFamily):
    """Components of the column `features`; dims: (kind, lo, hi) with kind 0 real, 1 integer, 2 categorical."""

    name: ClassVar[str] = "vector"
    columns: ClassVar[Sequence[str]] = ("features",)
    dims: Sequence[tuple[int, float, float]] = ()

    def candidates(self, num_feat: int, num_thresh: int, seed: int) -> Candidates:
        draw, params, all_t = Draws(seed), [], []
        for _ in range(num_feat):
            d = draw.integer(0, len(self.dims))
            kind, lo, hi = self.dims[d]
            ts = [lo + (hi - lo) * draw.unit() if kind == 0 else float(draw.integer(int(lo), max(int(lo) + 1, int(hi)))) for _ in range(num_thresh)]
            params.append({"dim": d, "kind": kind})
            all_t.append(sorted(ts))
        return Candidates(params, all_t)

    def value(self, params: dict) -> Column:
        return F.get("features", params["dim"])

    def blocks(self, batch: pa.RecordBatch, params: Sequence[dict]) -> Iterator[Block]:
        x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
        yield ArrayBlock(_longs(batch.column(0)), _longs(batch.column(1)), x, lambda p: p["dim"])


#: Values (pixels, sums) of images of one size that are looked at as one stack.
STACKED = 1 << 20


def stacks(batch: pa.RecordBatch, sizes: Sequence[int], lists: Sequence[int], most: int = STACKED) -> Iterator[tuple[int, int]]:
    """First row and number of rows that follow each other and are alike in the columns `sizes` and in the lengths of `lists`, of at most `most` values (a row at least)."""
    if not batch.num_rows:
        return
    long = [batch.column(k).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for k in lists]
    alike = np.stack([*(_longs(batch.column(k)) for k in sizes), *long], 1)
    each = np.maximum(1, most // np.maximum(1, alike.max(1)))
    starts = np.flatnonzero(np.r_[True, (alike[1:] != alike[:-1]).any(1)])
    for first, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        for at in range(first, end, int(each[first])):
            yield at, min(int(each[first]), end - at)


def stacked(batch: pa.RecordBatch, column: int, first: int, n: int) -> np.ndarray:
    """The lists of n rows that are of one length: rows by values."""
    return batch.column(column).slice(first, n).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


class ImageFamily(FeatureFamily):
    """Features of points of images: samples have an image a row, and its `points` (structs label, i, j).

    Images of one size that follow each other are one block.
    """

    def source(self, samples: DataFrame, params: Sequence[dict]) -> DataFrame:
        none = F.array().cast("array<struct<label:int,i:int,j:int>>")
        points = F.transform("points", lambda p: F.struct(*[p[n].cast("int").alias(n) for n in ("label", "i", "j")]))
        return samples.select(F.coalesce(points, none).alias("points"), _image(samples), *self.columns)

    #: Columns of lists among those of source(), by number.
    lists: ClassVar[Sequence[int]] = ()

    def block(self, batch: pa.RecordBatch, first: int, at: np.ndarray, image: np.ndarray, points: Sequence[np.ndarray]) -> Block:
        """The points (label, i, j) of as many images as there are in `image`, from row `first` on; at: the place of each point's image."""
        raise NotImplementedError

    def blocks(self, batch: pa.RecordBatch, params: Sequence[dict]) -> Iterator[Block]:
        for first, n in stacks(batch, (2, 3), self.lists):
            own = batch.column(0).slice(first, n)
            at, flat = np.repeat(np.arange(n), own.value_lengths().to_numpy(zero_copy_only=False)), own.flatten()
            yield self.block(batch, first, at, _longs(batch.column(1).slice(first, n)), [_longs(flat.field(c)) for c in ("label", "i", "j")])

    def kept(self, batch: pa.RecordBatch, keep: Sequence[np.ndarray]) -> pa.RecordBatch:
        lists, stays = batch.column(0), np.concatenate(keep) if keep else np.zeros(0, bool)
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        left = np.bincount(row[stays], minlength=batch.num_rows)
        ends = pa.array(np.r_[0, np.cumsum(left)], pa.int32())
        flat = lists.flatten().filter(pa.array(stays, pa.bool_()))
        rows = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, flat), *batch.columns[1:]], names=batch.schema.names)
        return rows.filter(pa.array(left > 0, pa.bool_()))


def _shape(batch: pa.RecordBatch, row: int, more: int = 0) -> tuple[int, int]:
    return tuple(batch.column(k)[row].as_py() + more for k in (2, 3))


@dataclass
class TextonFamily(ImageFamily):
    """One or two pixels near a point (columns height, width, pixels)."""

    name: ClassVar[str] = "texton"
    columns: ClassVar[Sequence[str]] = ("height", "width", "pixels")
    lists: ClassVar[Sequence[int]] = (4,)
    radius: int = 10

    def candidates(self, num_feat: int, num_thresh: int, seed: int) -> Candidates:
        draw, params, all_t = Draws(seed), [], []
        for _ in range(num_feat):
            p = {"texton": draw.integer(0, 4)}
            for n in ("dy0", "dx0", "dy1", "dx1"):
                p[n] = draw.integer(-self.radius, self.radius + 1)
            p |= {"b0": draw.integer(0, 7), "b1": draw.integer(0, 7)}
            params.append(p)
            all_t.append(sorted(float(draw.integer(-255, 256)) for _ in range(num_thresh)))
        return Candidates(params, all_t)

    def value(self, params: dict) -> Column:
        at = lambda k: pixel(F.col("pixels"), F.col("height"), F.col("width"), F.col("i") + params[f"dy{k}"], F.col("j") + params[f"dx{k}"], F.lit(params[f"b{k}"]))
        return texton_value(F.lit(params["texton"]), at(0), at(1))

    def block(self, batch: pa.RecordBatch, first: int, at: np.ndarray, image: np.ndarray, points: Sequence[np.ndarray]) -> Block:
        pixels = stacked(batch, 4, first, len(image)).reshape(len(image), *_shape(batch, first), -1)
        label, i, j = points
        return TextonBlock(label, image[at], i, j, pixels.astype(np.int64), at)


#: Threshold bounds of the box patterns 0 to 6, over INTEGRAL_SCALE.
BOUNDS = ((0, 1), (-1 / 8, 7 / 8), (-1 / 2, 1 / 2), (-1 / 2, 1 / 2), (-1 / 3, 2 / 3), (-1 / 3, 2 / 3), (-1 / 2, 1 / 2))


@dataclass
class IntegralFamily(ImageFamily):
    """Boxes of prefix-sum tables (column tables, flat, of table_height x table_width x masks), and image scores (column preds)."""

    name: ClassVar[str] = "integral"
    columns: ClassVar[Sequence[str]] = ("height", "width", "tables", "preds")
    lists: ClassVar[Sequence[int]] = (4, 5)
    masks: int = 1
    ilp_dims: int = 0
    ilp_prob: float = 0.0
    distance: int = 40
    radii: tuple[int, int] = (5, 30)
    patterns: int = 6

    def candidates(self, num_feat: int, num_thresh: int, seed: int) -> Candidates:
        draw, params, all_t = Draws(seed), [], []
        for _ in range(num_feat):
            if draw.unit() < (self.ilp_prob if self.ilp_dims else 0.0):
                p, (lo, hi) = {"pattern": -1, "ilp_dim": draw.integer(0, self.ilp_dims)}, (0, 1)
            else:
                pattern = draw.integer(0, self.patterns)
                p = {"pattern": pattern, "mask": draw.integer(0, self.masks)}
                for n in ("bh", "bw"):
                    p[n] = draw.integer(self.radii[0], self.radii[1] + 1)
                for n in ("uy", "ux"):
                    p[n] = draw.integer(-self.distance, self.distance + 1)
                lo, hi = BOUNDS[pattern]
            lo, hi = int(lo * INTEGRAL_SCALE), int(hi * INTEGRAL_SCALE)
            params.append(p)
            all_t.append(sorted(float(draw.integer(lo, hi + 1)) for _ in range(num_thresh)))
        return Candidates(params, all_t)

    def value(self, params: dict) -> Column:
        if params["pattern"] < 0:
            return (F.get("preds", params["ilp_dim"]) * INTEGRAL_SCALE).cast("long")
        h, w = F.col("height") + 1, F.col("width") + 1
        e = box_edges(F.col("i"), F.col("j"), {k: F.lit(params[k]) for k in ("uy", "ux", "bh", "bw")}, h, w)
        at = lambda a, b: F.get("tables", ((a * w + b) * self.masks + params["mask"]).cast("int"))
        return integral_value(F.lit(params["pattern"]), e, at)

    def block(self, batch: pa.RecordBatch, first: int, at: np.ndarray, image: np.ndarray, points: Sequence[np.ndarray]) -> Block:
        n = len(image)
        sums, preds = stacked(batch, 4, first, n).reshape(n, *_shape(batch, first, 1), -1), stacked(batch, 5, first, n)
        label, i, j = points
        return BoxBlock(label, image[at], i, j, sums, preds, at)


def with_points(images: DataFrame, points: DataFrame) -> DataFrame:
    """Images with their labelled points (an image's size bounds them); those without any are left out."""
    lists = points.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(n).cast("int").alias(n) for n in ("label", "i", "j")]))).alias("points"))
    return images.drop("points").join(lists, "image_id")


def with_tables(points: DataFrame, images: DataFrame, tables: DataFrame, preds: DataFrame | None = None) -> DataFrame:
    """Rows for IntegralFamily: each image's size, table, scores (image_id, preds) and labelled points."""
    rows = with_points(images.select("image_id", "height", "width"), points).join(tables, "image_id")
    if preds is None:
        return rows.withColumn("preds", F.array().cast("array<double>"))
    return rows.join(preds, "image_id")


#: Families whose features a saved model can name.
FAMILIES: dict[str, FeatureFamily] = {f.name: f for f in (VectorFamily(), TextonFamily(), IntegralFamily())}
