"""Training forests level by level."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import histograms as H
from ..shared import checkpoint
from ..sources.records import load_model, save_model
from .families import BOUNDS, FAMILIES, Block, Candidates, FeatureFamily, IntegralFamily, TextonFamily, VectorFamily, box_values, with_points, with_tables
from .scoring import KINDS, argmax_rows, depth, flat_tables, predict_image_dense, predict_samples, score, to_integral_records

__all__ = [
    "BOUNDS", "FAMILIES", "Block", "Candidates", "FeatureFamily", "IntegralFamily", "KEYS", "KINDS", "TextonFamily", "VectorFamily", "argmax_rows", "box_values", "depth",
    "flat_tables", "level_bins", "number_leaves", "predict_image_dense", "predict_samples", "score", "to_integral_records", "train_forest", "train_level",
    "train_two_stage", "with_points", "with_tables",
]

KEYS = ["tree_id", "node_id"]


def train_level(valued: DataFrame, cands: Candidates) -> tuple[DataFrame, DataFrame]:
    """(best, hist) of all open nodes of all trees; valued: tree_id, node_id, label, values.

    The shuffle is keyed by (tree, node, feature, bin, label) of partial counts,
    so the root's level is spread as evenly as any other.
    """
    spark = valued.sparkSession
    bins = H.bin_counts_batched(valued, dict(enumerate(cands.thresholds)), cands.kinds(), KEYS)
    hist = H.split_histograms(bins, cands.frame(spark), KEYS)
    return H.best_split(H.information_gain(hist, KEYS), KEYS), hist


#: Splits so far, by tree and node: parameters of the feature, kind, threshold.
Splits = dict[tuple[int, int], tuple[dict, int, float]]
#: Values that a task gathers before it bins them; cells (node, candidate, class) of the histograms that one pass over the samples makes;
#: rows of open nodes that are written anew once they are less than this share of what was written before.
GATHERED, CELLS, SHARE = 1 << 22, 400_000_000, 0.5


def reached(block: Block, splits: dict[int, tuple[dict, int, float]]) -> np.ndarray:
    """The heap number of the lowest node that each sample reaches in a tree; a split is asked for its own samples alone."""
    node, left = np.zeros(len(block), np.int64), [(0, np.arange(len(block)))]
    while left:
        n, rows = left.pop()
        node[rows] = n
        if n in splits and len(rows):
            params, kind, t = splits[n]
            v = block.value(params, rows)
            passed = v == t if kind == 2 else v >= t
            left += [(2 * n + 1, rows[~passed]), (2 * n + 2, rows[passed])]
    return node


def _by_tree(splits: Splits) -> dict[int, dict[int, tuple[dict, int, float]]]:
    out: dict[int, dict] = {}
    for (t, n), s in splits.items():
        out.setdefault(t, {})[n] = s
    return out


def level_bins(source: DataFrame, family: FeatureFamily, cands: Candidates, splits: Splits, open_: Sequence[tuple[int, int]], trees: int = 1) -> DataFrame:
    """Bin counts (as bin_counts gives them) of open nodes; source: what family.source() gives for the candidates.

    Nothing is written: a task routes its samples through the splits so far,
    which travel with it, and works out values of those alone that are in open
    nodes, a few million at a time, to bin and count them.
    """
    per_tree = len(cands.params) // trees
    bounds, kinds, by_tree = [np.array(t, float) for t in cands.thresholds], cands.kinds(), _by_tree(splits)
    wanted = {t: np.array(sorted(n for own, n in open_ if own == t)) for t in range(trees)}
    names = [*KEYS, "label", "feat", "bin", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {t: [] for t in range(trees)}

        def count(t: int) -> pa.RecordBatch:
            node, label, x = (np.concatenate(c) for c in zip(*held[t], strict=True))
            held[t] = []
            classes = int(label.max()) + 1
            pair, at = np.unique(node * classes + label, return_inverse=True)
            group = np.column_stack([np.full(len(pair), t), pair // classes, pair % classes])
            out = [H.count_bins(x[:, k], at, group, bounds[f], kinds[f] == 2, f) for k, f in enumerate(range(t * per_tree, (t + 1) * per_tree))]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(out).T], names=names)

        for b in batches:
            for block in family.blocks(b, cands.params):
                for t in range(trees):
                    if not len(wanted[t]) or not len(block):
                        continue
                    node = reached(block, by_tree.get(t, {}))
                    rows = np.flatnonzero(np.isin(node, wanted[t]))
                    step = max(1, GATHERED // max(1, per_tree))
                    for at in range(0, len(rows), step):
                        some = rows[at : at + step]
                        held[t].append((node[some], block.label[some], block.matrix(cands.params[t * per_tree : (t + 1) * per_tree], some)))
                        if sum(x.size for _, _, x in held[t]) >= GATHERED:
                            yield count(t)
        for t in range(trees):
            if held[t] and per_tree:
                yield count(t)

    part = source.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    summed = part.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))
    return summed.select(F.col("tree_id").cast("int").alias("tree_id"), "node_id", *[F.col(c).cast("int").alias(c) for c in ("label", "feat", "bin")], "n")


def _scan(source: DataFrame, family: FeatureFamily, params: Sequence[dict], names: Sequence[str], rows: Callable[[Block], np.ndarray]) -> DataFrame:
    """Rows of longs that each block gives, those of a batch distinct where the last column isn't a count n, else summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rows(block) for block in family.blocks(b, params) if len(block)]
            if found:
                unique = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in unique.T], names=list(names))

    return source.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def class_counts(source: DataFrame, family: FeatureFamily, params: Sequence[dict]) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in family.blocks(b, params):
                label, n = np.unique(block.label, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(n)], names=["label", "n"])

    return dict(source.mapInArrow(run, "label long, n long").groupBy("label").agg(F.sum("n")).collect())


def node_images(source: DataFrame, family: FeatureFamily, params: Sequence[dict], splits: Splits, trees: int = 1) -> DataFrame:
    """tree_id, node_id, num_images: distinct images of the samples that end in each of the lowest nodes."""
    by_tree = _by_tree(splits)

    def rows(block: Block) -> np.ndarray:
        own = np.flatnonzero(block.image >= 0)
        each = [np.stack([np.full(len(own), t), reached(block, by_tree.get(t, {}))[own], block.image[own]], 1) for t in range(trees)]
        return np.unique(np.concatenate(each), axis=0)

    seen = _scan(source, family, params, ("tree_id", "node_id", "image"), rows)
    return seen.groupBy("tree_id", "node_id").agg(F.countDistinct("image").alias("num_images"))


def open_rows(source: DataFrame, family: FeatureFamily, params: Sequence[dict], splits: Splits, open_: Sequence[tuple[int, int]], trees: int = 1) -> DataFrame:
    """The rows of `source` (of images: their points) that are in an open node of some tree."""
    by_tree = _by_tree(splits)
    wanted = {t: np.array(sorted(n for own, n in open_ if own == t)) for t in range(trees)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for block in family.blocks(b, params):
                stays = np.zeros(len(block), bool)
                for t in range(trees):
                    if len(wanted[t]):
                        stays |= np.isin(reached(block, by_tree.get(t, {})), wanted[t])
                keep.append(stays)
            yield family.kept(b, keep)

    return source.mapInArrow(run, source.schema)


def _leaf(t: int, n: int, counts: Sequence[float]) -> tuple:
    total = sum(counts)
    return (t, n, True, None, None, None, None, [c / total if total else 0.0 for c in counts], None, None, None)


def _resumed(spark, path: str, about: str, max_levels: int) -> tuple[int, list[tuple], dict, dict] | None:
    """(next level, nodes, open nodes with their counts, images by node) after the last level that was saved whole."""
    for level in range(max_levels, -1, -1):
        try:
            state = spark.read.schema("about string, tree_id int, node_id long, counts array<double>").parquet(f"{path}/open={level}").collect()
        except AnalysisException:
            continue
        if any(r["about"] != about for r in state):
            raise ValueError(f"the forest in {path} was trained with other settings")
        open_ = {(r["tree_id"], r["node_id"]): list(r["counts"]) for r in state if r["node_id"] is not None}
        saved = load_model(spark, f"{path}/level={level}").collect()
        images = {(r["tree_id"], r["node_id"]): r["num_images"] for r in saved}
        nodes = [tuple(r)[:11] for r in saved if (r["tree_id"], r["node_id"]) not in open_]
        return level + 1, [(*n[:8], None, *n[9:]) for n in nodes], open_, images
    return None


def train_forest(
    samples: DataFrame,
    family: FeatureFamily,
    num_classes: int,
    max_levels: int = 6,
    num_feat: int = 50,
    num_thresh: int = 20,
    min_info: float = 0.0,
    seed: int = 1234,
    num_trees: int = 1,
    strict: bool = False,
    save_to: str | None = None,
    resume: bool = False,
    cells: int = CELLS,
) -> tuple[list[tuple], Candidates]:
    """Node rows (model.SCHEMA: splits hold their feature; dim is its number among the candidates) and the candidates.

    Level by level, all trees at once: a node splits if its best gain is at
    least min_info (strict: above it), both sides have rows and the level isn't
    the last.  Trees differ by the part of the candidates each may use.  What the
    family reads of the samples is written once, never the candidates' values:
    each level works these out anew, for rows of open nodes, and once few rows
    are open those alone are written and read from then on.  Open nodes are
    taken in rounds of at most `cells` (node, candidate, class) cells, one pass
    over the samples each.  Only the model's own rows come to the driver.

    With `save_to`, the model so far is saved after each level (open nodes as
    leaves, in the folders level=0, level=1 and on) and then its open nodes and
    their counts (open=0 and on); with `resume`, training goes on after the last
    level that was saved whole, if the settings are the same.
    """
    spark = samples.sparkSession
    cands = family.candidates(num_feat * num_trees, num_thresh, seed)
    params = cands.params
    about = json.dumps([family.name, num_classes, num_feat, num_thresh, min_info, seed, num_trees, strict, params[:3], cands.thresholds[:3]])
    source = checkpoint(family.source(samples, params))
    nodes: list[tuple] = []
    images: dict[tuple[int, int], int] = {}
    found = _resumed(spark, save_to, about, max_levels) if resume and save_to else None
    if found is None:
        prior = [0.0] * num_classes
        for label, n in class_counts(source, family, params).items():
            prior[label] = float(n)
        first, open_ = 0, {(t, 0): prior for t in range(num_trees)}
        if save_to is not None:
            images = _images(source, family, params, {}, num_trees)
    else:
        first, nodes, open_, images = found
    splits: Splits = {(n[0], n[1]): (n[10], n[4], n[5]) for n in nodes if not n[2]}
    written = None
    for level in range(first, max_levels + 1):
        chosen: dict[tuple[int, int], tuple] = {}
        if open_ and level < max_levels:
            each = max(1, int(cells // max(1, num_feat * num_thresh * num_classes)))
            order = sorted(open_)
            for at in range(0, len(order), each):
                bins = level_bins(source, family, cands, splits, order[at : at + each], num_trees)
                chosen |= _best(bins, cands, num_classes, min_info, strict)
        nodes += [_leaf(t, n, counts) for (t, n), counts in sorted(open_.items()) if (t, n) not in chosen]
        open_ = {}
        for (t, n), (ind, gain, left, right) in sorted(chosen.items()):
            f, thresh = cands.select(ind)
            kind = params[f].get("kind", 0)
            nodes.append((t, n, False, f, kind, thresh, float(gain), None, None, family.name, params[f]))
            splits[t, n] = (params[f], kind, thresh)
            open_[t, 2 * n + 1], open_[t, 2 * n + 2] = left, right
        if save_to is not None:
            if open_:
                images |= {k: v for k, v in _images(source, family, params, splits, num_trees).items() if k in open_}
            so_far = number_leaves(nodes + [_leaf(t, n, c) for (t, n), c in sorted(open_.items())])
            save_model(spark, so_far, f"{save_to}/level={level}", images)
            state = [(about, t, n, c) for (t, n), c in sorted(open_.items())] or [(about, None, None, None)]
            spark.createDataFrame(state, "about string, tree_id int, node_id long, counts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{save_to}/open={level}")
        if not open_:
            break
        # rows that are open in no tree are left behind once they are most of what is read
        rows = max(sum(sum(c) for (own, _), c in open_.items() if own == t) for t in range(num_trees))
        total = written or max(1.0, sum(prior) if found is None else rows)
        written = total
        if rows < SHARE * total and level + 1 < max_levels:
            source, written = checkpoint(open_rows(source, family, params, splits, list(open_), num_trees)), rows
    return number_leaves(nodes), cands


def _images(source: DataFrame, family: FeatureFamily, params: Sequence[dict], splits: Splits, trees: int) -> dict[tuple[int, int], int]:
    return {(r["tree_id"], r["node_id"]): r["num_images"] for r in node_images(source, family, params, splits, trees).collect()}


def _best(bins: DataFrame, cands: Candidates, num_classes: int, min_info: float, strict: bool) -> dict[tuple[int, int], tuple]:
    """(candidate, gain, counts of its failing side, of its passing side) of the nodes that split."""
    hist = H.split_histograms(bins, cands.frame(bins.sparkSession), KEYS)
    best = H.best_split(H.information_gain(hist, KEYS), KEYS)
    rows = best.join(hist, [*KEYS, "feat_ind"]).groupBy(*KEYS, "gain", "feat_ind").agg(F.collect_list(F.struct("label", "ql", "qr")).alias("q"))
    chosen = {}
    for r in rows.collect():
        ok = r["gain"] > min_info if strict else r["gain"] >= min_info
        left, right = [0.0] * num_classes, [0.0] * num_classes
        for q in r["q"]:
            left[q["label"]], right[q["label"]] = float(q["ql"]), float(q["qr"])
        if ok and sum(left) and sum(right):
            chosen[r["tree_id"], r["node_id"]] = (r["feat_ind"], r["gain"], left, right)
    return chosen


def number_leaves(nodes: list[tuple]) -> list[tuple]:
    """Leaf ids in pre-order, failing side first."""
    out = []
    for t in sorted({n[0] for n in nodes}):
        own = {n[1]: n for n in nodes if n[0] == t}
        stack, leaf = [0], 0
        while stack:
            n = own[stack.pop()]
            if n[2]:
                n = (*n[:8], leaf, *n[9:])
                leaf += 1
            else:
                stack += [2 * n[1] + 2, 2 * n[1] + 1]
            out.append(n)
    return sorted(out, key=lambda n: (n[0], n[1]))


def train_two_stage(
    images: DataFrame, points: DataFrame, num_classes: int, seed: int = 1234, trees: int = 3, texton: dict | None = None, integral: dict | None = None, scores: DataFrame | None = None, family: TextonFamily | None = None, boxes: dict | None = None
) -> tuple[list[tuple], list[tuple]]:
    """A texton tree, then `trees` box trees over its spatial prefix sums: node rows of both stages.

    scores (image_id, preds: one score for each image classifier) make image
    scores candidates of the second stage, in the share `ilp_prob` of `boxes`
    (the other parameters of IntegralFamily).
    """
    texton = {"max_levels": 3, "num_feat": 20, "num_thresh": 10} | (texton or {})
    integral = {"max_levels": 3, "num_feat": 20, "num_thresh": 10} | (integral or {})
    family = family or TextonFamily(3)
    first, _ = train_forest(with_points(images, points), family, num_classes, seed=seed, **texton)
    rows = stage_rows(images, points, first, scores)
    masks, dims = rows.agg(F.max("masks"), F.max(F.size("preds"))).first()
    boxes = {"distance": 3, "radii": (1, 3), "ilp_prob": 0.25} | (boxes or {})
    second, _ = train_forest(rows.where(F.size("points") > 0), IntegralFamily(masks or 1, ilp_dims=max(0, dims or 0), **boxes), num_classes, seed=seed + 1, num_trees=trees, **integral)
    return first, second


def stage_rows(images: DataFrame, points: DataFrame, first: list[tuple], scores: DataFrame | None = None) -> DataFrame:
    """Second-stage rows, written once: image_id, height, width, tables, masks, preds, points of every image, from its first-stage scores."""
    return checkpoint(to_integral_records(images, points, first, "spatial", scores))
