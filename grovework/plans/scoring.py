"""Scoring with models as they are stored: samples, points of images, whole images, and tables of scored images."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import model as M
from .families import FAMILIES, Block, BoxBlock, FeatureFamily, TextonBlock, stacked, stacks


class Tree:
    """A tree's nodes in order of their numbers, and the samples that each of its leaves gets."""

    def __init__(self, rows: Sequence[tuple]):
        own = {r[1]: r for r in rows}
        self.splits = {n: (r[9], dict(r[10]), r[4], r[5]) for n, r in own.items() if not r[2]}
        self.leaf_nodes = [n for n, r in own.items() if r[2]]
        self.probs = np.array([own[n][7] for n in self.leaf_nodes], float)
        self.leaf_id = np.array([own[n][8] for n in self.leaf_nodes], np.int32)
        self.place = {n: k for k, n in enumerate(self.leaf_nodes)}

    def leaves(self, n: int, value: Callable[[str, dict, np.ndarray], np.ndarray]) -> np.ndarray:
        """The place of the leaf of each of n samples; a split is asked for its own samples alone."""
        out, left = np.zeros(n, np.int64), [(0, np.arange(n))]
        while left:
            node, rows = left.pop()
            if node in self.place:
                out[rows] = self.place[node]
            elif len(rows):
                family, params, kind, t = self.splits[node]
                v = value(family, params, rows)
                passed = v == t if kind == 2 else v >= t
                left += [(2 * node + 1, rows[~passed]), (2 * node + 2, rows[passed])]
        return out


def read_trees(nodes: Sequence[tuple] | DataFrame) -> list[tuple[int, Tree]]:
    """Trees by their ids; a model's own rows come to the driver, and travel with the tasks that score."""
    rows = [tuple(r) for r in nodes.select(*M.COLUMNS).collect()] if isinstance(nodes, DataFrame) else list(nodes)
    return [(t, Tree([r for r in rows if r[0] == t])) for t in sorted({r[0] for r in rows})]


def depth(nodes: Sequence[tuple]) -> int:
    return max(((n[1] + 1).bit_length() - 1 for n in nodes), default=0)


def predict_samples(samples: DataFrame, nodes: Sequence[tuple] | DataFrame, keys: Sequence[str], families: Sequence[FeatureFamily] = ()) -> DataFrame:
    """keys, tree_id, node_id, leaf_id, probs of every sample (a row each) in every tree, in one pass without a join.

    The splits say which features they test; `families` gives those that a
    stored model can't name.  Image families need whole images (predict_image_dense).
    """
    known = FAMILIES | {f.name: f for f in families}
    trees = read_trees(nodes)
    used = {f: [p for _, t in trees for g, p, _, _ in t.splits.values() if g == f] for f in sorted({s[0] for _, t in trees for s in t.splits.values()})}
    kinds = [samples.schema[k] for k in keys]
    out = StructType([*kinds, *StructType.fromDDL("tree_id int, node_id long, leaf_id int, probs array<double>")])
    labelled = samples if "label" in samples.columns else samples.withColumn("label", F.lit(0))
    # one struct column for each family, of what its blocks read
    parts = [F.struct(*[F.col(c) for c in known[f].source(labelled, p).columns if c in labelled.columns], *([] if known[f].columns else [F.array(*[known[f].value(q).cast("double") for q in p]).alias("values")])).alias(f"__{k}") for k, (f, p) in enumerate(used.items())]
    wide = labelled.withColumn("image", F.lit(None).cast("long")).select(*keys, *parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            blocks: dict[str, Block] = {}
            for k, (f, p) in enumerate(used.items()):
                fields = dict(zip(b.column(len(keys) + k).type.names, b.column(len(keys) + k).flatten(), strict=True))
                none = pa.nulls(b.num_rows, pa.int64())
                names = [n for n in fields if n not in ("label", "image")]
                inner = pa.RecordBatch.from_arrays([fields.get("label", none), none, *[fields[n] for n in names]], names=["label", "image", *names])
                (blocks[f],) = known[f].blocks(inner, p)
            for t, tree in trees:
                at = tree.leaves(b.num_rows, lambda f, p, rows, blocks=blocks: blocks[f].value(p, rows))
                node = np.array(tree.leaf_nodes, np.int64)[at]
                probs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * tree.probs.shape[1] + 1, tree.probs.shape[1]), pa.int32()), pa.array(tree.probs[at].ravel()))
                cols = [*b.columns[: len(keys)], pa.array(np.full(len(at), t, np.int32)), pa.array(node), pa.array(tree.leaf_id[at]), probs]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "tree_id", "node_id", "leaf_id", "probs"])

    return wide.mapInArrow(run, out)


def score(samples: DataFrame, nodes: Sequence[tuple], value: Column, keys: Sequence[str]) -> DataFrame:
    """The same in built-in functions, by a join for each level; value: a sample's value for the columns dim and params of its node."""
    frame = M.nodes_frame(samples.sparkSession, list(nodes))
    routed = M.route_to_node(samples, frame, value, depth(nodes))
    return M.predict_leaf(routed, frame).select(*keys, "tree_id", "node_id", "leaf_id", "probs")


#: What features of images read, as far as it is given.
INPUTS = ("pixels", "tables", "preds")


def _whole(images: DataFrame) -> tuple[DataFrame, list[str]]:
    """image_id, height, width, and those of INPUTS that there are, with their names."""
    given = [n for n in INPUTS if n in images.columns]
    return images.select(F.col("image_id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), *given), given


#: Pixels of images of one size that are scored as one stack.
SCORED = 1 << 16


def _scored(batch: pa.RecordBatch, first: int, n: int, given: Sequence[str], trees: list[tuple[int, Tree]]) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Height, width, leaf of the first tree, and mean probabilities of every pixel (rows of pixels by classes) of n rows of _whole() of one size."""
    h, w = batch.column(1)[first].as_py(), batch.column(2)[first].as_py()
    flat = {c: stacked(batch, 3 + k, first, n) for k, c in enumerate(given) if batch.column(3 + k)[first].is_valid}
    i, j, none = np.tile(np.repeat(np.arange(h), w), n), np.tile(np.arange(w), n * h), np.zeros(n * h * w, np.int64)
    at = np.repeat(np.arange(n), h * w)
    blocks: dict[str, Block] = {}
    if "pixels" in flat:
        blocks["texton"] = TextonBlock(none, none, i, j, flat["pixels"].reshape(n, h, w, -1).astype(np.int64), at)
    if "tables" in flat or "preds" in flat:
        sums = flat["tables"].reshape(n, h + 1, w + 1, -1) if "tables" in flat else np.zeros((n, h + 1, w + 1, 0))
        blocks["integral"] = BoxBlock(none, none, i, j, sums, flat.get("preds", np.zeros((n, 0))), at)
    total, leaf = 0.0, None
    for _, tree in trees:
        place = tree.leaves(n * h * w, lambda f, p, rows: blocks[f].value(p, rows))
        total = total + tree.probs[place]
        leaf = tree.leaf_id[place] if leaf is None else leaf
    return h, w, leaf, total / len(trees)


def _stacks(batch: pa.RecordBatch, given: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Rows of one size, of SCORED pixels at most: a pixel's widest list bounds what is held of it."""
    for first, n in stacks(batch, (1, 2), [3 + k for k in range(len(given))]):
        each = max(1, SCORED // max(1, batch.column(1)[first].as_py() * batch.column(2)[first].as_py()))
        for at in range(first, first + n, each):
            yield at, min(each, first + n - at)


def _lists(a: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """An array as n lists of one length."""
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int64) * (a.size // n), pa.int32()), pa.array(a.ravel(), kind))


def predict_image_dense(images: DataFrame, nodes: Sequence[tuple] | DataFrame) -> DataFrame:
    """image_id, height, width, leaves, probs (H x W x classes): every pixel, numpy over whole images, one image a row.

    Splits may be of any stored family: textons need `pixels`, boxes `tables`,
    image scores `preds`; a split is worked out for the pixels of its node alone.
    leaves are those of the first tree; probs the mean of the trees.
    """
    (source, given), trees = _whole(images), read_trees(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in _stacks(b, given):
                _, _, leaves, probs = _scored(b, first, n, given, trees)
                cols = [b.column(k).slice(first, n) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, _lists(leaves, n, pa.int32()), _lists(probs, n, pa.float64())], names=["image_id", "height", "width", "leaves", "probs"])

    return source.mapInArrow(run, "image_id long, height int, width int, leaves array<int>, probs array<double>")


def argmax_rows(dense: DataFrame, num_classes: int) -> DataFrame:
    """image_id, i, j, leaf_id, probs of every pixel of dense predictions."""
    one = F.explode(F.transform("leaves", lambda leaf, k: F.struct(k.alias("k"), leaf.alias("leaf_id"))))
    rows = dense.select("image_id", "width", "probs", one.alias("p"))
    return rows.select(
        "image_id",
        F.floor(F.col("p.k") / F.col("width")).cast("int").alias("i"),
        (F.col("p.k") % F.col("width")).cast("int").alias("j"),
        F.col("p.leaf_id").alias("leaf_id"),
        F.slice("probs", F.col("p.k") * num_classes + 1, num_classes).alias("probs"),
    )


KINDS = ("argmax", "argmax_prob", "all_prob", "spatial")


def _planes(kind: str, leaves: np.ndarray, probs: np.ndarray, num_leaves: int) -> np.ndarray:
    """What is summed, rows of pixels by masks."""
    if kind == "all_prob":
        return probs
    if kind == "spatial":
        return np.concatenate([(leaves[:, None] == np.arange(num_leaves)).astype(float), probs], 1)
    best = probs.argmax(1)  # of equal ones the lowest class
    one = (best[:, None] == np.arange(probs.shape[1])).astype(float)
    return one if kind == "argmax" else one * probs[np.arange(len(best)), best][:, None]


def to_integral_records(images: DataFrame, points: DataFrame, nodes: Sequence[tuple] | DataFrame, kind: str, scores: DataFrame | None = None) -> DataFrame:
    """image_id, height, width, tables, masks, preds, points: one record for each image, its prefix sums, scores and labelled points.

    An image is scored and summed in one row of one task: no pixel is a row of
    its own and none is shuffled.  The sums are of `kind`: argmax, argmax_prob,
    all_prob or spatial (leaves of the first tree, then classes).  tables is
    flat, in (row, column, mask) order, with a row and a column of zeros first;
    preds are those of scores (image_id, preds; none: empty); points are structs
    (label, i, j) in that order, none for images without any.
    """
    if kind not in KINDS:
        raise ValueError(f"no integral type {kind}")
    (source, given), trees = _whole(images), read_trees(nodes)
    num_leaves = len(trees[0][1].leaf_nodes)
    # an image's size bounds its list; points and scores meet the images before the tables are there, so that no table is shuffled
    lists = points.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label", "i", "j"))).alias("__points"))
    kind_of = lists.schema["__points"].dataType
    source = source.join(lists, "image_id", "left").withColumn("__points", F.coalesce("__points", F.array().cast(kind_of)))
    if scores is not None:
        source = source.join(scores.select("image_id", F.col("preds").cast("array<double>").alias("__preds")), "image_id", "left")
    empty = F.array().cast("array<double>")
    source = source.withColumn("__preds", empty if scores is None else F.coalesce("__preds", empty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in _stacks(b, given):
                h, w, leaves, probs = _scored(b, first, n, given, trees)
                x = _planes(kind, leaves, probs, num_leaves)
                table = np.zeros((n, h + 1, w + 1, x.shape[1]))
                table[:, 1:, 1:] = x.reshape(n, h, w, -1).cumsum(1).cumsum(2)
                more = [b.column(3 + len(given) + k).slice(first, n) for k in range(2)]
                cols = [*[b.column(k).slice(first, n) for k in range(3)], _lists(table, n, pa.float64()), pa.array(np.full(n, x.shape[1], np.int32)), *more]
                yield pa.RecordBatch.from_arrays(cols, names=["image_id", "height", "width", "tables", "masks", "points", "preds"])

    ordered = source.select("image_id", "height", "width", *given, "__points", "__preds")
    return ordered.mapInArrow(run, f"image_id long, height int, width int, tables array<double>, masks int, points {kind_of.simpleString()}, preds array<double>")


def flat_tables(integrals: DataFrame) -> DataFrame:
    """image_id, tables: each image's table as one array in (row, column, mask) order; an image's size bounds it."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "j", "mask", "s")))
    return integrals.groupBy("image_id").agg(F.transform(ordered, lambda x: x["s"]).alias("tables"))
