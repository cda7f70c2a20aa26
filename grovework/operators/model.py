"""Forests as tables of nodes: routing, scoring, merging, reports.

nodes: tree_id, node_id (heap numbers: children of n are 2n+1 and 2n+2),
is_leaf, dim, kind, t, info_gain, probs, leaf_id, family, params.  A split
holds its own feature (the name of its family and its parameters), so that a
model can be scored, and forests merged, without the candidates of a training run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import vector_test

SCHEMA = "tree_id int, node_id long, is_leaf boolean, dim int, kind int, t double, info_gain double, probs array<double>, leaf_id int, family string, params map<string,int>"

COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))


def node_rows(trees: Sequence[Sequence[tuple]], family: str = "vector", params: Sequence[dict] | None = None) -> list[tuple]:
    """Rows of SCHEMA from trees given as (node_id, dim, kind, t, gain) or (node_id, probs); leaves number in pre-order.

    params: parameters of the features that dims number; as a rule these are components of vectors.
    """
    rows = []
    for tree_id, tree in enumerate(trees):
        by_id = {n[0]: n for n in tree}
        leaves: dict[int, int] = {}

        def walk(n: int, by_id=by_id, leaves=leaves) -> None:
            if len(by_id[n]) == 2:
                leaves[n] = len(leaves)
            else:
                walk(2 * n + 1)
                walk(2 * n + 2)

        walk(0)
        for n in sorted(by_id):
            node = by_id[n]
            if n in leaves:
                rows.append((tree_id, n, True, None, None, None, None, list(node[1]), leaves[n], None, None))
            else:
                own = {"dim": node[1], "kind": node[2]} if params is None else params[node[1]]
                rows.append((tree_id, n, False, node[1], node[2], node[3], node[4], None, None, family, own))
    return rows


def nodes_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def route_to_node(samples: DataFrame, nodes: DataFrame, value: Column, depth: int) -> DataFrame:
    """Samples (with their columns, and tree_id) with node_id, the lowest node each reaches in each tree.

    One equi-join on (tree_id, node_id) for each level; value: the sample's value
    for the columns dim, kind, t and params of its node.
    """
    splits = nodes.where("not is_leaf").select("tree_id", "node_id", "dim", "kind", "t", "params")
    trees = nodes.select("tree_id").distinct()
    now = samples.join(F.broadcast(trees)).withColumn("node_id", F.lit(0).cast("long"))  # a row per tree
    for _ in range(depth):
        passed = F.coalesce(vector_test(value, F.col("kind"), F.col("t")), F.lit(False)).cast("long")
        below = F.when(F.col("kind").isNotNull(), 2 * F.col("node_id") + 1 + passed).otherwise(F.col("node_id"))
        now = now.join(splits, ["tree_id", "node_id"], "left").withColumn("node_id", below).drop("dim", "kind", "t", "params")
    return now


def at_level(routed: DataFrame, level: int) -> DataFrame:
    """Rows whose node stands on a level."""
    return routed.where(F.floor(F.log2(F.col("node_id") + 1)) == level)


def predict_leaf(routed: DataFrame, nodes: DataFrame) -> DataFrame:
    leaves = nodes.where("is_leaf").select("tree_id", "node_id", "leaf_id", "probs")
    return routed.join(leaves, ["tree_id", "node_id"])


def predict_forest(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, label, prob: the mean of the trees' leaf probabilities."""
    each = scored.select(*keys, F.posexplode("probs").alias("label", "p"))
    return each.groupBy(*keys, "label").agg(F.avg("p").alias("prob"))


def rank_classes(probs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds rank: by probability, largest first; ties go to the higher label."""
    return probs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("prob"), F.desc("label"))))


def argmax_class(probs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, label, prob of the most probable class; ties go to the lowest label."""
    best = F.max(F.struct("prob", (-F.col("label")).alias("l")))
    return probs.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.l")).cast("int").alias("label"), F.col("b.prob").alias("prob"))


def merge_models(models: Sequence[DataFrame]) -> DataFrame:
    """Forests one after the other; tree ids count on."""
    out, offset = None, 0
    for m in models:
        moved = m.withColumn("tree_id", (F.col("tree_id") + offset).cast("int"))
        out = moved if out is None else out.unionByName(moved)
        offset += (m.agg(F.max("tree_id")).first()[0] or 0) + 1 if len(models) > 1 else 0
    return out


def append_tree(model: DataFrame, tree: DataFrame) -> DataFrame:
    return merge_models([model, tree])


def model_summary(nodes: DataFrame) -> DataFrame:
    """tree_id, nodes, leaves, classes."""
    return nodes.groupBy("tree_id").agg(
        F.count("*").alias("nodes"), F.sum(F.col("is_leaf").cast("long")).alias("leaves"), F.max(F.size("probs")).alias("classes")
    )


def model_param_hist(nodes: DataFrame, params: Sequence[str], bins: int = 20) -> DataFrame:
    """param, bin, n: equal-width bins of each parameter of the splits between its least and largest value, the last one closed.

    A parameter is a column of nodes (t), or one of the splits' own features; splits that don't have it don't count.
    """
    at = lambda p: F.col(p) if p in nodes.columns else F.col("params")[p]
    long = nodes.where("not is_leaf").select(
        F.explode(F.array(*[F.struct(F.lit(p).alias("param"), at(p).cast("double").alias("v")) for p in params])).alias("x")
    ).select("x.*").where("v is not null")
    w = Window.partitionBy("param")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    width = long.withColumn("lo", lo).withColumn("hi", hi)
    bin_ = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int"))
    )
    return width.select("param", bin_.alias("bin")).groupBy("param", "bin").agg(F.count("*").alias("n"))


def tree_to_dot(nodes: DataFrame, feature: Column | None = None) -> DataFrame:
    """tree_id, dot: a graph of each tree in one line.

    Nodes are numbered in pre-order, failing side first.  A split shows its gain
    and feature (a text column; as a rule 't <= x[dim]', or ==), a leaf its
    classes by probability with four digits that count; red edges lead to the
    failing side, green ones to the passing side.
    """
    test = F.when(F.col("kind") == 2, F.lit("==")).otherwise(F.lit("<="))
    feature = F.concat(F.col("t").cast("string"), F.lit(" "), test, F.lit(" x["), F.col("dim").cast("string"), F.lit("]")) if feature is None else feature
    # of equal probabilities the lower class stands first
    ranked = F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("p"), i.alias("l"))))
    classes = F.array_join(F.transform(ranked, lambda x: F.concat(x["l"].cast("string"), F.lit(":"), significant(-x["p"]))), " ")
    # a node's place in pre-order: where its path from the root begins on the line of leaves, then its depth
    depth = F.floor(F.log2(F.col("node_id") + 1))
    low = (F.col("node_id") + 1) / F.pow(F.lit(2.0), depth)
    placed = nodes.withColumn("__no", (F.row_number().over(Window.partitionBy("tree_id").orderBy(low, depth)) - 1).cast("string"))
    label = F.when(F.col("is_leaf"), classes).otherwise(F.concat(F.lit("I["), F.format_string("%f", "info_gain"), F.lit("]P["), feature, F.lit("]")))
    named = placed.select("tree_id", "node_id", F.col("__no"), F.concat("__no", F.lit('[label="'), label, F.lit('"]')).alias("name"))
    above = named.select("tree_id", F.col("node_id").alias("__up"), F.col("__no").alias("__from"))
    linked = named.withColumn("__up", F.floor((F.col("node_id") - 1) / 2)).join(above, ["tree_id", "__up"], "left")
    color = F.when(F.col("node_id") % 2 == 1, F.lit("red")).otherwise(F.lit("green"))
    link = F.concat("__from", F.lit("->"), "__no", F.lit("[color="), color, F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("__no").cast("int").alias("no"), "name", link.alias("link"))))  # one tree's nodes
    parts = F.concat(F.transform(rows, lambda x: x["name"]), F.filter(F.transform(rows, lambda x: x["link"]), lambda x: x.isNotNull()))
    return linked.groupBy("tree_id").agg(F.concat(F.lit("digraph{"), F.array_join(parts, ";"), F.lit("}")).alias("dot"))


def significant(x: Column) -> Column:
    """A probability with four significant digits and no zeros at its end, as %.4g gives it from 0.0001 on."""
    power = F.pow(F.lit(10.0), 3 - F.floor(F.log10(x)))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", F.rint(x * power) / power), "0+$", ""), r"\.$", "")
    return F.when(x <= 0, F.lit("0")).otherwise(plain)
