"""Properties of histograms, forests, prefix sums and superpixels; rules for ties and empty sides."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovework.operators import histograms as H
from grovework.operators import model as M
from grovework.operators import raster as R
from grovework.operators import regions as G
from grovework.plans import fixtures as X
from grovework.plans import forest as T
from grovework.plans import queries as Q
from grovework.sources import records as IO


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batched_bins_equal_built_in_bins(spark, sf_dir):
    values = Q.valued(spark, sf_dir)
    args = (dict(enumerate(Q.CANDS.thresholds)), Q.CANDS.kinds(), T.KEYS)
    cols = [*T.KEYS, "label", "feat", "bin", "n"]
    assert rows(H.bin_counts(values, *args).select(*cols)) == rows(H.bin_counts_batched(values, *args).select(*cols))


def test_sides_add_up_and_gain_is_bounded(spark, sf_dir):
    hist = Q.hist(spark, sf_dir)
    total = dict(X.vectors(spark, sf_dir).groupBy("label").count().collect())
    assert all(r["ql"] + r["qr"] == total[r["label"]] for r in hist.collect())
    n = sum(total.values())
    h = -sum(c / n * math.log2(c / n) for c in total.values())
    assert all(0 <= r["gain"] <= h for r in H.information_gain(hist, T.KEYS).collect())


def test_gain_of_an_empty_side_is_zero(spark):
    hist = spark.createDataFrame([(0, 0, 5, 0), (0, 1, 3, 0)], "feat_ind int, label int, ql long, qr long")
    assert H.information_gain(hist, []).first()["gain"] == 0.0


def test_ties(spark):
    gains = spark.createDataFrame([(1, 4, 0.5), (1, 2, 0.5), (1, 3, 0.1)], "node_id int, feat_ind int, gain double")
    assert tuple(H.best_split(gains, ["node_id"]).first()) == (1, 0.5, 2)
    probs = spark.createDataFrame([(1, 0, 0.4), (1, 1, 0.4), (1, 2, 0.2)], "row_id int, label int, prob double")
    assert M.argmax_class(probs, ["row_id"]).first()["label"] == 0
    assert [r["label"] for r in M.rank_classes(probs, ["row_id"]).orderBy("rank").collect()] == [1, 0, 2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "label int, features array<double>")
    assert H.class_histogram(none, "label", 3).agg(F.sum("n")).first()[0] == 0
    assert H.validate_labels(none, "label", 4) == 4
    nodes, _ = T.train_forest(none, Q.VECTORS, 3, max_levels=2, num_feat=2, num_thresh=2)
    assert [n[2] for n in nodes] == [True]


def test_labels_are_checked(spark):
    with pytest.raises(ValueError):
        H.validate_labels(spark.createDataFrame([(-1,)], "label int"), "label")


@pytest.mark.parametrize("strict", [False, True])
def test_forest_is_a_partition_and_repeats(spark, sf_dir, strict):
    kw = {"max_levels": 3, "num_feat": 10, "num_thresh": 5, "strict": strict}
    vectors = X.vectors(spark, sf_dir)
    nodes, cands = T.train_forest(vectors, Q.VECTORS, 3, **kw)
    assert nodes == T.train_forest(vectors.repartition(7), Q.VECTORS, 3, **kw)[0]
    leaves = [n for n in nodes if n[2]]
    assert sorted(n[8] for n in leaves) == list(range(len(leaves)))
    assert all(abs(sum(n[7]) - 1) < 1e-9 for n in leaves)
    scored = T.score(vectors, nodes, F.get("features", F.col("params")["dim"]), ["label"])
    assert scored.count() == vectors.count()
    assert rows(T.predict_samples(vectors, nodes, ["label"]).drop("probs")) == rows(scored.drop("probs"))
    # each leaf's probabilities are the shares of the training rows that reach it
    seen = scored.groupBy("node_id", "label").count().collect()
    by = {}
    for r in seen:
        by.setdefault(r["node_id"], {})[r["label"]] = r["count"]
    for n in leaves:
        total = sum(by[n[1]].values())
        assert all(abs(by[n[1]].get(k, 0) / total - p) < 1e-9 for k, p in enumerate(n[7]))


def test_merged_models_average(spark, sf_dir):
    samples, nodes = X.embedded(spark, sf_dir), M.nodes_frame(spark, Q.FOREST)

    def predicted(model):
        routed = M.route_to_node(samples, model, F.get("features", F.col("dim")), 3)
        return {(r["row_id"], r["label"]): r["prob"] for r in M.predict_forest(M.predict_leaf(routed, model), ["row_id"]).collect()}

    one, two = predicted(nodes.where("tree_id = 0")), predicted(nodes.where("tree_id = 1"))
    both = predicted(M.merge_models([nodes.where("tree_id = 0"), nodes.where("tree_id = 1").withColumn("tree_id", F.lit(0))]))
    assert all(abs(both[k] - (one[k] + two[k]) / 2) < 1e-12 for k in both)


def test_saved_model_is_the_same(spark, tmp_path):
    IO.save_model(spark, Q.FOREST, str(tmp_path / "m"))
    assert rows(IO.load_model(spark, str(tmp_path / "m")).drop("probs")) and IO.load_model(spark, str(tmp_path / "m")).count() == len(Q.FOREST)


def test_dense_scores_equal_routed_scores(spark, sf_dir):
    rows_, cands = T.train_forest(T.with_points(X.images(spark, sf_dir), X.points(spark, sf_dir)), Q.TEXTONS, 10, max_levels=3, num_feat=10, num_thresh=5)
    dense = T.argmax_rows(T.predict_image_dense(X.images(spark, sf_dir), rows_), 10)
    samples = X.points(spark, sf_dir).join(X.images(spark, sf_dir), "image_id")
    routed = T.score(samples.withColumn("values", Q.TEXTONS.values(cands)), rows_, F.get("values", F.col("dim")), ["image_id", "i", "j"])
    both = routed.select("image_id", "i", "j", F.col("leaf_id").alias("leaf")).join(dense, ["image_id", "i", "j"])
    assert both.count() == samples.count() and both.where("leaf != leaf_id").count() == 0


def test_box_values_agree(spark, sf_dir):
    tables = T.flat_tables(R.integral_labels(X.masks(spark, sf_dir).where("image_id < 20"), 4))
    points = X.points(spark, sf_dir).where("image_id < 20")
    family = T.IntegralFamily(4, distance=3, radii=(1, 3), patterns=7)
    cands = family.candidates(8, 2, 5)
    shown = X.images(spark, sf_dir).select("image_id", "height", "width")
    slow = points.join(shown, "image_id").join(tables, "image_id").select("label", family.values(cands).alias("values"))
    fast = family.attach(T.with_tables(points, shown, tables), cands)
    assert sorted((r["label"], *r["values"]) for r in slow.collect()) == sorted((r["label"], *r["values"]) for r in fast.collect())


def test_prefix_sums_equal_direct_sums(spark, sf_dir):
    masks = X.masks(spark, sf_dir).where("image_id = 3").toPandas()
    grid = np.zeros((8, 8), int)
    grid[masks["i"], masks["j"]] = masks["cls"]
    table = np.zeros((4, 9, 9))
    for r in R.integral_labels(X.masks(spark, sf_dir).where("image_id = 3"), 4).collect():
        table[r["mask"], r["i"], r["j"]] = r["s"]
    for m in range(4):
        assert table[m, 7, 6] - table[m, 2, 6] - table[m, 7, 1] + table[m, 2, 1] == (grid[2:7, 1:6] == m).sum()
    frame = spark.createDataFrame([(3, 8, 8, grid.ravel().tolist())], "image_id long, height int, width int, labels array<int>")
    dense = np.array(R.integral_dense(frame, 4).first()["tables"]).reshape(9, 9, 4)
    assert (dense.transpose(2, 0, 1) == table).all()


def test_refinement_never_raises_energy(spark, sf_dir):
    raster, seeds, labels = Q._regions(spark, sf_dir)
    weights = G.edge_weights(raster)
    before = dict(G.boundary_energy(labels, weights).collect())
    after = dict(G.boundary_energy(G.superpixel_refine(labels, weights, seeds, 10, sweeps=1), weights).collect())
    assert before.keys() == after.keys() and all(after[k] <= before[k] for k in after) and after != before


def test_later_seed_wins(spark):
    shown = spark.createDataFrame([(1, 12, 12)], "image_id long, height int, width int")
    labels = {(r["i"], r["j"]): r["region"] for r in G.initial_labels(G.place_seeds(shown, 8), shown, 8).collect()}
    assert labels[0, 0] == 0 and labels[4, 4] == 3 and len(labels) == 144


def test_hull_of_a_square(spark):
    labels = spark.createDataFrame([(1, i, j, 5) for i in range(3) for j in range(3)], "image_id long, i int, j int, region int")
    assert G.region_hulls(labels).first()["hull"] == [[0, 0], [2, 0], [2, 2], [0, 2]]


def test_whole_images_refine_as_columns_do(spark, sf_dir):
    raster, seeds, labels = Q._regions(spark, sf_dir)
    weights = G.edge_weights(raster)
    few = lambda df: df.where("image_id <= 3")
    args = (few(labels), few(weights), few(seeds), 10)
    assert rows(G.superpixel_refine(*args)) == rows(G.refine_by_columns(*args).select("image_id", "i", "j", "region"))


def test_refinement_of_odd_images(spark):
    """One row, one pixel, no seeds, no weights."""
    labels = spark.createDataFrame([(1, 0, j, j // 2) for j in range(5)] + [(2, 0, 0, 7)], "image_id long, i int, j int, region int")
    weights = spark.createDataFrame([(1, 0, j, "left", 3) for j in range(1, 5)], "image_id long, i int, j int, dir string, w int")
    seeds = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 2)], "image_id long, seed int, i int, j int")
    got, want = (f(labels, weights, seeds, 4) for f in (G.superpixel_refine, G.refine_by_columns))
    assert rows(got) == rows(want.select("image_id", "i", "j", "region"))
    assert G.superpixel_refine(labels.limit(0), weights, seeds, 4).count() == 0


def test_superpixels_start_from_moved_seeds(spark, sf_dir):
    raster, shown = X.gray(spark, sf_dir)
    raster, shown = raster.where("image_id <= 2"), shown.where("image_id <= 2")
    seeds = G.seed_refine(G.place_seeds(shown, 10), raster, shown, 10)
    assert rows(seeds) != rows(G.place_seeds(shown, 10))
    assert rows(G.superpixels(raster, shown, 10, sweeps=0)) == rows(G.initial_labels(seeds, shown, 10))


def test_boundaries_at_a_scale(spark):
    shown = spark.createDataFrame([(1, 8, 8)], "image_id long, height int, width int")
    labels = spark.createDataFrame([(1, i, j, int(j >= 4)) for i in range(8) for j in range(8)], "image_id long, i int, j int, region int")
    assert {(r["j"], r["region"]) for r in G.region_boundaries(labels).collect()} == {(3, 0), (4, 1)}
    assert {(r["i"], r["j"], r["region"]) for r in G.region_boundaries(labels, 0.5, shown).collect()} == {(i, j, r) for i in (0, 2, 4, 6) for j, r in ((2, 0), (4, 1))}


def test_models_are_saved_level_by_level(spark, sf_dir, tmp_path):
    nodes, _ = T.train_forest(X.vectors(spark, sf_dir), Q.VECTORS, 3, max_levels=2, num_feat=6, num_thresh=4, num_trees=2, save_to=str(tmp_path))
    orders = X.vectors(spark, sf_dir).select("image_id").distinct().count()
    for level in range(3):
        saved = IO.load_model(spark, f"{tmp_path}/level={level}").collect()
        assert {(r["tree_id"], r["node_id"]) for r in saved} == {(n[0], n[1]) for n in nodes if n[1] + 1 < 2 ** (level + 2)}
        assert all(r["num_images"] == orders for r in saved if r["node_id"] == 0)
        assert all(r["level"] == (r["node_id"] + 1).bit_length() - 1 and 0 < r["num_images"] <= orders for r in saved)


def test_families_without_a_column_form(spark, sf_dir):
    class Halves(T.FeatureFamily):
        columns = ("features",)

        def candidates(self, num_feat, num_thresh, seed):
            return Q.VECTORS.candidates(num_feat, num_thresh, seed)

        name = "halves"

        def value_np(self, batch, params):
            return batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)[:, params["dim"]]

    kw = {"max_levels": 2, "num_feat": 6, "num_thresh": 4}
    own, _ = T.train_forest(X.vectors(spark, sf_dir), Halves(), 3, **kw)
    known, _ = T.train_forest(X.vectors(spark, sf_dir), Q.VECTORS, 3, **kw)
    assert [n[:9] for n in own] == [n[:9] for n in known] and {n[9] for n in own} == {None, "halves"}
    assert rows(T.predict_samples(X.vectors(spark, sf_dir), own, ["label"], [Halves()]).drop("probs")) == rows(T.predict_samples(X.vectors(spark, sf_dir), known, ["label"]).drop("probs"))
    p = {"dim": 5, "kind": 2}
    assert X.vectors(spark, sf_dir).where(Q.VECTORS.test(p, 1.0)).count() == X.vectors(spark, sf_dir).where("features[5] = 1.0").count()


def test_levels_equal_the_built_in_plan(spark, sf_dir):
    """The root by routing in batches, and by the table of values."""
    valued = Q.valued(spark, sf_dir)
    best, hist = T.train_level(valued, Q.CANDS)
    bins = T.level_bins(Q.VECTORS.source(X.vectors(spark, sf_dir), Q.CANDS.params), Q.VECTORS, Q.CANDS, {}, [(0, 0)])
    assert rows(H.split_histograms(bins, Q.CANDS.frame(spark), T.KEYS)) == rows(hist) and best.count() == 1


def test_shares_have_four_digits(spark):
    xs = [0.0, 1.0, 0.5, 1 / 3, 2 / 3, 0.99996, 0.00012345678, 0.04, 0.100049]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(M.significant(F.col("x"))).collect()]
    assert got == ["%.4g" % x for x in xs]


def test_bad_records_are_counted(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("", 2), (None, 3), (" ", 4)], "key string, x int").write.parquet(str(tmp_path / "a"))
    kept, rejects = IO.load_labeled_records(spark, str(tmp_path / "a"), columns=["x"])
    assert rows(kept) == [("a", 1)] and rows(rejects) == [("empty", 2), ("null", 1)]
    spark.createDataFrame([(7, 1)], "key int, x int").write.parquet(str(tmp_path / "b"))
    kept, rejects = IO.load_labeled_records(spark, str(tmp_path / "b"))
    assert kept.count() == 0 and rows(rejects) == [("type", 1)]
    with pytest.raises(ValueError):
        IO.load_labeled_records(spark, str(tmp_path / "b"), columns=["pixels"])


def test_thirds_of_a_side(spark):
    """A side of 5 is cut at 1 and 3 (two thirds, 10 / 3, are rounded once); every side up to 61 in whole numbers."""
    from grovework.functions.scalar import inner_edges

    sides = spark.range(0, 62).select(F.lit(7).alias("lo"), (F.col("id") + 7).cast("int").alias("hi"))
    got = [tuple(r) for r in sides.select("hi", *inner_edges(F.col("lo"), F.col("hi"))).collect()]
    assert got[5] == (12, 8, 10, 9)
    assert got == [(7 + d, 7 + d // 3, 7 + (2 * d) // 3, 7 + d // 2) for d in range(62)]


def test_box_of_five_columns():
    """One row of ones at column 3 of five: with thirds at 1 and 3, pattern 4 (left - middle + right) finds it on the right."""
    s = np.zeros((6, 6, 1))
    s[:, 4:, 0] = np.arange(6)[:, None]
    p = {"pattern": 4, "mask": 0, "uy": 0, "ux": 0, "bh": 2, "bw": 2}
    assert T.box_values(s, np.array([2]), np.array([2]), p, None)[0] == int(5 / 25 * 2147483646)


def test_forests_of_other_features_merge(spark, sf_dir, tmp_path):
    """Two forests of different seeds, saved, loaded in another session, merged: the mean of both."""
    numbered = X.embedded(spark, sf_dir)
    family, kw = T.VectorFamily([(0, -0.5, 0.5)] * 64), {"max_levels": 3, "num_feat": 9, "num_thresh": 4}
    models = [T.train_forest(numbered, family, 10, seed=seed, **kw)[0] for seed in (5, 6)]
    assert {n[10]["dim"] for n in models[0] if not n[2]} != {n[10]["dim"] for n in models[1] if not n[2]}
    for k, nodes in enumerate(models):
        IO.save_model(spark, nodes, str(tmp_path / str(k)))
    other = spark.newSession()
    both = M.merge_models([IO.load_model(other, str(tmp_path / str(k))) for k in range(2)])

    def probs(nodes):
        got = M.predict_forest(T.predict_samples(numbered, nodes, ["row_id"]), ["row_id"]).collect()
        return {(r["row_id"], r["label"]): r["prob"] for r in got}

    one, two, merged = probs(models[0]), probs(models[1]), probs(both)
    assert len(merged) == len(one) and all(abs(merged[k] - (one[k] + two[k]) / 2) < 1e-12 for k in one)


def test_stages_merge_and_score_together(spark, sf_dir):
    """A forest of textons and boxes, image scores and a category: as single forests, averaged."""
    records = T.to_integral_records(X.images(spark, sf_dir), X.points(spark, sf_dir), Q.PIXEL_FOREST, "spatial", Q.preds(spark, sf_dir))
    whole = records.join(X.images(spark, sf_dir).select("image_id", "pixels"), "image_id").where("image_id < 30")
    both = [*Q.PIXEL_FOREST, *[(n[0] + 2, *n[1:]) for n in Q.SECOND_FOREST]]
    one, two, all_ = (dict(T.predict_image_dense(whole, m).select("image_id", "probs").collect()) for m in (Q.PIXEL_FOREST, Q.SECOND_FOREST, both))
    assert len(all_) == 30 and all(np.allclose(all_[k], (np.array(one[k]) + np.array(two[k])) / 2) for k in all_)


def test_second_stage_asks_for_image_scores(spark, sf_dir):
    first, second = T.train_two_stage(X.images(spark, sf_dir), X.points(spark, sf_dir), 10, trees=2, texton={"max_levels": 1}, integral={"max_levels": 2, "num_feat": 8, "num_thresh": 6}, scores=Q.preds(spark, sf_dir))
    assert any(n[10]["pattern"] < 0 for n in second if not n[2])
    rows_ = T.stage_rows(X.images(spark, sf_dir), X.points(spark, sf_dir), first, Q.preds(spark, sf_dir))
    dense = T.argmax_rows(T.predict_image_dense(rows_, second), 10).join(X.points(spark, sf_dir), ["image_id", "i", "j"])
    # leaves hold the shares of the training points that reach them, so a leaf's points have its probabilities
    tree = [n for n in second if n[0] == 0 and n[2]]
    seen = {r["leaf_id"]: r["n"] for r in dense.groupBy("leaf_id").agg(F.count("*").alias("n")).collect()}
    by = {(r["leaf_id"], r["label"]): r["count"] for r in dense.groupBy("leaf_id", "label").count().collect()}
    assert set(seen) == {n[8] for n in tree}
    assert all(abs(by.get((n[8], k), 0) / seen[n[8]] - p) < 1e-9 for n in tree for k, p in enumerate(n[7]))


class Stopped(Exception):
    pass


@pytest.mark.parametrize("stop", [0, 2])
def test_training_resumes_after_the_last_saved_level(spark, sf_dir, tmp_path, monkeypatch, stop):
    from grovework.plans import forest as code

    kw = {"max_levels": 4, "num_feat": 6, "num_thresh": 4, "num_trees": 2}
    whole, _ = T.train_forest(X.vectors(spark, sf_dir), Q.VECTORS, 3, save_to=str(tmp_path / "whole"), **kw)
    save, levels = code.save_model, []

    def save_some(spark, nodes, path, images=None):
        if path.endswith(f"level={stop + 1}"):
            raise Stopped
        save(spark, nodes, path, images)

    monkeypatch.setattr(code, "save_model", save_some)
    with pytest.raises(Stopped):
        T.train_forest(X.vectors(spark, sf_dir), Q.VECTORS, 3, save_to=str(tmp_path / "cut"), **kw)
    monkeypatch.setattr(code, "save_model", save)
    count = code.level_bins
    monkeypatch.setattr(code, "level_bins", lambda source, family, cands, splits, open_, trees=1: levels.append(max(n for _, n in open_)) or count(source, family, cands, splits, open_, trees))
    again, _ = T.train_forest(X.vectors(spark, sf_dir), Q.VECTORS, 3, save_to=str(tmp_path / "cut"), resume=True, **kw)
    assert again == whole and min(levels) >= 2 ** (stop + 1) - 1
    last = {k: rows(IO.load_model(spark, f"{tmp_path}/{k}/level=4").select("tree_id", "node_id", "num_images", "leaf_id")) for k in ("whole", "cut")}
    assert last["whole"] == last["cut"]
    with pytest.raises(ValueError):
        T.train_forest(X.vectors(spark, sf_dir), Q.VECTORS, 3, save_to=str(tmp_path / "cut"), resume=True, **(kw | {"seed": 9}))


def test_rounds_of_nodes_give_the_same_forest(spark, sf_dir, monkeypatch):
    from grovework.plans import forest as code

    kw = {"max_levels": 3, "num_feat": 6, "num_thresh": 4, "num_trees": 2}
    asked, count = [], code.level_bins
    monkeypatch.setattr(code, "level_bins", lambda source, family, cands, splits, open_, trees=1: asked.append(len(open_)) or count(source, family, cands, splits, open_, trees))
    whole, _ = T.train_forest(X.vectors(spark, sf_dir), Q.VECTORS, 3, **kw)
    before = len(asked)
    # cells for three nodes of six features, four thresholds and three classes
    assert T.train_forest(X.vectors(spark, sf_dir), Q.VECTORS, 3, cells=3 * 72, **kw)[0] == whole
    assert max(asked[:before]) > 3 and max(asked[before:]) == 3


def test_what_is_written_does_not_grow_with_features(spark, sf_dir, monkeypatch):
    from grovework.plans import forest as code

    written, keep = [], code.checkpoint
    monkeypatch.setattr(code, "checkpoint", lambda df: written.append(df.columns) or keep(df))
    T.train_forest(T.with_points(X.images(spark, sf_dir), X.points(spark, sf_dir)), Q.TEXTONS, 10, max_levels=2, num_feat=40, num_thresh=3)
    assert written == [["points", "image", "height", "width", "pixels"]]
    # once most rows are closed, the others are written alone: here those of one class end at the root's leaf
    written.clear()
    one = spark.createDataFrame([(0, [0.0]) if k % 10 else (k // 10 % 3, [1.0 + k]) for k in range(600)], "label int, features array<double>")
    family = T.VectorFamily([(0, 0.5, 601.0)])
    nodes, cands = T.train_forest(one, family, 3, max_levels=3, num_feat=4, num_thresh=30, min_info=0.05)
    monkeypatch.setattr(code, "SHARE", 0.0)
    assert T.train_forest(one, family, 3, max_levels=3, num_feat=4, num_thresh=30, min_info=0.05)[0] == nodes


def test_open_rows_of_images_keep_their_points(spark, sf_dir):
    from grovework.plans import forest as code

    source = Q.TEXTONS.source(T.with_points(X.images(spark, sf_dir), X.points(spark, sf_dir)), Q.TCANDS.params)
    splits = {(0, 0): (Q.TCANDS.params[0], 0, Q.TCANDS.thresholds[0][1])}
    left, right = (code.open_rows(source, Q.TEXTONS, Q.TCANDS.params, splits, [(0, n)]) for n in (1, 2))
    sizes = [df.agg(F.sum(F.size("points"))).first()[0] or 0 for df in (left, right, source)]
    assert sizes[0] + sizes[1] == sizes[2] and min(sizes) > 0
    assert code.class_counts(left, Q.TEXTONS, []) == dict(left.select(F.explode("points.label").alias("l")).groupBy("l").count().collect())


def test_parameters_of_a_stored_model(spark, tmp_path):
    IO.save_model(spark, Q.SECOND_FOREST, str(tmp_path / "m"))
    got = M.model_param_hist(IO.load_model(spark, str(tmp_path / "m")), ["pattern", "mask", "t"]).collect()
    # image scores have no mask
    assert sum(r["n"] for r in got if r["param"] == "pattern") == 5 and sum(r["n"] for r in got if r["param"] == "mask") == 3


def test_shades_never_raise_the_energy_of_kind_1(spark, sf_dir):
    raster, seeds, labels = Q._regions(spark, sf_dir)
    raster, seeds, labels = (x.where("image_id <= 4") for x in (raster, seeds, labels))
    weights = G.edge_weights(raster, 1)
    energy = lambda x: dict(G.boundary_energy(x, weights, raster, seeds).collect())
    got = [labels, *(G.superpixel_refine(labels, weights, seeds, 10, n, raster) for n in (1, 2))]
    levels = [energy(x) for x in got]
    assert all(b[k] <= a[k] for a, b in zip(levels, levels[1:], strict=False) for k in a) and levels[1] != levels[0]
    # without the shades the sweeps end elsewhere, and higher
    plain = energy(G.superpixel_refine(labels, weights, seeds, 10, 2))
    assert any(plain[k] > levels[2][k] for k in plain)
    one = [x.where("image_id <= 1") for x in (labels, weights, seeds)]
    assert rows(G.superpixel_refine(*one, 10, 2, raster)) == rows(G.refine_by_columns(*one, 10, 2, raster).select("image_id", "i", "j", "region"))


def test_windows_at_the_last_edges_are_empty(spark):
    """A seed in the last row or column of a 31 x 31 image stays where it is for patch 4; none moves for patches below 4."""
    shown = spark.createDataFrame([(1, 31, 31)], "image_id long, height int, width int")
    raster = spark.createDataFrame([(1, i, j, (i * 37 + j * 11) % 101) for i in range(31) for j in range(31)], "image_id long, i int, j int, v int")
    seeds = spark.createDataFrame([(1, 0, 30, 15), (1, 1, 15, 30), (1, 2, 15, 15)], "image_id long, seed int, i int, j int")
    assert rows(G.seed_refine(seeds, raster, shown, 4)) == rows(seeds)
    assert rows(G.seed_refine(G.place_seeds(shown, 2), raster, shown, 2)) == rows(G.place_seeds(shown, 2))


def test_contours_are_closed_and_hold_the_boundary(spark, sf_dir):
    labels = X.masks(spark, sf_dir).where("image_id < 40").withColumnRenamed("cls", "region")
    found = G.region_contours(labels).collect()
    for r in found:
        p = r["points"]
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(p, p[1:] + p[:1], strict=True)) or len(p) == 1
    inner = {tuple(r) for r in G.region_boundaries(labels).select("image_id", "j", "i", "region").collect()}
    frame = {tuple(r) for r in labels.where("i in (0, 7) or j in (0, 7)").select("image_id", "j", "i", "region").collect()}
    assert {(r["image_id"], x, y, r["region"]) for r in found for x, y in r["points"]} == inner | frame


def test_contours_of_a_ring_have_its_hole():
    ring = np.ones((5, 6), int)
    ring[2, 2:4] = 2
    assert [(r, hole, len(p)) for r, hole, p in G.contours(ring)] == [(1, False, 18), (1, True, 6), (2, False, 2)]
    assert G.contours(ring)[1][2] == [(2, 1), (1, 2), (2, 3), (3, 3), (4, 2), (3, 1)]
    assert G.contours(np.array([[1, 2], [2, 1]])) == [(1, False, [(0, 0), (1, 1)]), (2, False, [(1, 0), (0, 1)])]


@pytest.mark.parametrize("tile", [1, 3, 5])
def test_tiles_sum_as_whole_images_do(spark, tile):
    px = [(k, i, j, (i * 7 + j * 3 + k) % 4, (i + j) / 16) for k, (h, w) in enumerate(((8, 8), (5, 11), (1, 1))) for i in range(h) for j in range(w)]
    labels = spark.createDataFrame(px, "image_id long, i int, j int, cls int, prob double")
    probs = labels.select("image_id", "i", "j", F.col("cls").alias("leaf_id"), F.array(F.col("prob"), 1 - F.col("prob")).alias("probs"))
    rounded = lambda df: rows(df.withColumn("s", F.round("s", 9)))
    for f, df, n in ((R.integral_labels, labels, [4]), (R.integral_labels_probs, labels, [4]), (R.integral_all_probs, probs, []), (R.integral_spatial, probs, [4])):
        assert rounded(f(df, *n)) == rounded(f(df, *n, tile=tile))
    grid = np.zeros((5, 11))
    for k, i, j, _, p in px:
        if k == 1:
            grid[i, j] = p
    got = {(r["i"], r["j"]): r["s"] for r in R.integral_all_probs(probs).where("image_id = 1 and mask = 0").collect()}
    assert all(abs(got[i, j] - grid[:i, :j].sum()) < 1e-9 for i in range(6) for j in range(12)) and len(got) == 72


def test_labeled_records_are_committed_in_shards(spark, tmp_path):
    from grovework.sources import labeled as LR

    path = str(tmp_path / "records")
    rows_ = [(f"k{k}", 2, 3, 1, bytes([k % 256] * 6), [(k % 3, 0, 1)]) for k in range(250)] + [(None, 1, 1, 1, b"a", None), ("  ", 1, 1, 1, b"a", None), ("short", 2, 2, 1, b"abc", None)]
    records = spark.createDataFrame(rows_, LR.RECORD).coalesce(1)
    LR.write_records(records, path)
    shards = [p for p in (tmp_path / "records").iterdir() if p.suffix == ".arrow"]
    assert len(shards) == 3  # 100, 100 and 53
    # what no manifest names isn't read: here a shard that a lost task left
    (tmp_path / "records" / "shard-lost.arrow").write_bytes(shards[0].read_bytes())
    good, rejects = LR.read_records(spark, path)
    assert sorted(r["key"] for r in good.collect()) == sorted(r[0] for r in rows_[:250])
    assert rows(good.where("key = 'k7'").select("height", "width", "bands", "points.label")) == [(2, 3, 1, [1])] and good.where("key = 'k7'").first()["pixels"] == bytes([7] * 6)
    assert rows(rejects) == [("empty", 1), ("null", 1), ("shape", 1)]
    LR.write_records(records.limit(5), path, shard=2)
    assert LR.read_records(spark, path)[0].count() == 255
    records.limit(1).write.format(LR.NAME).mode("overwrite").save(path)
    assert LR.read_records(spark, path)[0].count() == 1 and len([p for p in (tmp_path / "records").iterdir() if p.suffix == ".arrow"]) == 1


def test_labeled_records_reads_shards_with_batches_of_no_rows(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import ipc

    from grovework.sources import labeled as LR

    LR.write_records(spark.createDataFrame([("k", 1, 1, 1, b"a", None)], LR.RECORD).coalesce(1), str(tmp_path / "r"))
    shard = next(p for p in (tmp_path / "r").iterdir() if p.suffix == ".arrow")
    table = ipc.open_file(pa.OSFile(str(shard))).read_all()
    with ipc.new_file(str(shard), table.schema) as out:
        out.write_batch(table.to_batches()[0].slice(0, 0))
        out.write_table(table)
    good, rejects = LR.read_records(spark, str(tmp_path / "r"))
    assert [r["key"] for r in good.collect()] == ["k"] and rows(rejects) == []


@pytest.mark.parametrize("kind", [0, 1])
def test_superpixels_of_images_in_rows_are_those_of_the_operators(spark, kind):
    from grovework.operators import regions as G

    shapes = {1: (17, 23), 2: (17, 23), 3: (1, 9), 4: (6, 2), 5: (12, 12)}
    rng = np.random.default_rng(3)
    values = [(m, i, j, 7 if m == 5 else int(rng.integers(0, 256))) for m, (h, w) in shapes.items() for i in range(h) for j in range(w)]
    raster = spark.createDataFrame(values, "image_id long, i int, j int, v int").localCheckpoint()
    shown = spark.createDataFrame([(m, h, w) for m, (h, w) in shapes.items()], "image_id long, height int, width int")
    weights, start = G.edge_weights(raster, kind), G.place_seeds(shown, 6)
    seeds = G.seed_refine(start, raster, shown, 6).localCheckpoint()
    want = G.superpixel_refine(G.initial_labels(seeds, shown, 6), weights, seeds, 6, 2, raster if kind else None)
    # nothing but the pixels is shuffled: what is left out is filled in
    got = G.superpixels(raster.where("v <> 7"), shown, 6, kind=kind, fill=7)
    assert rows(got.select("image_id", "i", "j", "region")) == rows(want.select("image_id", "i", "j", "region"))
    energy = G.boundary_energy(G.initial_labels(start, shown, 6), weights, raster, start)
    assert rows(G.starting_energy(raster, shown, 6, kind=kind)) == rows(energy.select("image_id", "energy"))
    assert G.superpixels(raster, shown.limit(0), 6).count() == 0


def test_images_of_one_size_are_one_block(spark):
    from grovework.plans.families import ImageFamily

    sizes = [(4, 5)] * 40 + [(3, 6)] * 2 + [(4, 5)] * 30
    rng = np.random.default_rng(5)
    shown = [(k, h, w, rng.integers(0, 256, h * w * 7).tolist(), [(int(rng.integers(0, 3)), int(rng.integers(0, h)), int(rng.integers(0, w))) for _ in range(k % 4)]) for k, (h, w) in enumerate(sizes)]
    images = spark.createDataFrame(shown, "image_id long, height int, width int, pixels array<int>, points array<struct<label:int,i:int,j:int>>").coalesce(1)
    family = T.TextonFamily(3)
    cands = family.candidates(10, 4, 7)
    batch = family.source(images, cands.params).toArrow().combine_chunks().to_batches()[0]
    blocks = list(family.blocks(batch, cands.params))
    alone = [b for k in range(batch.num_rows) for b in family.blocks(batch.slice(k, 1), cands.params)]
    assert isinstance(family, ImageFamily) and len(blocks) == 3 and len(alone) == len(sizes)
    every = lambda found, of: np.concatenate([of(b) for b in found])
    for of in (lambda b: b.label, lambda b: b.image, lambda b: b.matrix(cands.params, np.arange(len(b)))):
        assert (every(blocks, of) == every(alone, of)).all()
    label, image = (every(blocks, of) for of in (lambda b: b.label, lambda b: b.image))
    left = family.kept(batch, [b.label == 1 for b in blocks]).to_pylist()
    assert [(r["image"], p["label"]) for r in left for p in r["points"]] == [(m, 1) for m in image[label == 1].tolist()] and all(r["points"] for r in left)
