"""One query for each operator, over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import histograms as H
from ..operators import model as M
from ..operators import prep as P
from ..operators import raster as R
from ..operators import regions as G
from ..random import mixed_sql
from ..shared import checkpoint
from ..sources import labeled as LR
from ..sources import records as IO
from . import fixtures as X
from . import forest as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


def values_sql(rows, names: str) -> str:
    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(lit, x)) + "]"
        return f"'{x}'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


# -- fixed candidates and forests ------------------------------------------------------------------

VECTORS = T.VectorFamily(X.DIMS)
CANDS = VECTORS.candidates(8, 5, 1234)
CAND_SQL = "c AS (SELECT * FROM " + values_sql([(*r, CANDS.params[r[0]]["dim"]) for r in CANDS.rows()], "feat, kind, rnk, feat_ind, t, dim") + ")"
FX = "f1x AS (SELECT label, [x0, x1, x2, x3, x4, x5] AS x, image_id FROM f1)"
#: Counts of each candidate's sides, by class.
HIST = f"""{X.F1}, {FX}, {CAND_SQL},
tot AS (SELECT label, count(*) AS n FROM f1 GROUP BY label),
hit AS (SELECT feat_ind, label, sum(CASE WHEN (kind = 2 AND x[dim + 1] = t) OR (kind <> 2 AND x[dim + 1] >= t) THEN 1 ELSE 0 END)::BIGINT AS qr
        FROM f1x, c GROUP BY ALL),
hist AS (SELECT h.feat_ind, h.label, (tot.n - h.qr)::BIGINT AS ql, h.qr FROM hit h JOIN tot USING (label))"""
GAIN = f"""{HIST},
g0 AS (SELECT feat_ind, sum(ql) AS nl, sum(qr) AS nr, sum(CASE WHEN ql > 0 THEN ql * log2(ql::DOUBLE) ELSE 0 END) AS sl,
  sum(CASE WHEN qr > 0 THEN qr * log2(qr::DOUBLE) ELSE 0 END) AS sr, sum((ql + qr) * log2((ql + qr)::DOUBLE)) AS sa FROM hist GROUP BY 1),
gain AS (SELECT feat_ind, CASE WHEN nl = 0 OR nr = 0 THEN 0 ELSE round((((nl + nr) * log2((nl + nr)::DOUBLE) - sa) - (nl * log2(nl::DOUBLE) - sl)
  - (nr * log2(nr::DOUBLE) - sr)) / (nl + nr), 12) END AS gain FROM g0)"""

#: Two hand-made trees over the 64 components of `embedded`, ten classes each.
_TEN = lambda *hot: [0.55 if k == hot[0] else 0.05 for k in range(10)]
TREES = [
    [(0, 0, 0, 0.0, 0.5), (1, 3, 0, 0.05, 0.25), (2, _TEN(2)), (3, _TEN(3)), (4, 7, 0, -0.02, 0.125), (9, _TEN(1)), (10, _TEN(9))],
    [(0, 5, 0, 0.01, 0.75), (1, _TEN(0)), (2, 11, 0, 0.0, 0.375), (5, _TEN(7)), (6, [0.1] * 10)],
]
FOREST = M.node_rows(TREES)
NODE_SQL = "nd AS (SELECT * FROM " + values_sql([r[:9] for r in FOREST], "tree_id, node_id, is_leaf, dim, kind, t, info_gain, probs, leaf_id") + ")"
ROUTED = f"""{NODE_SQL}, em AS (SELECT vec_id AS row_id, label, embedding::DOUBLE[] AS x FROM embeddings),
l0 AS (SELECT row_id, label, x, tree_id, 0 AS node_id FROM em, (SELECT DISTINCT tree_id FROM nd)),
""" + ",\n".join(
    f"l{k + 1} AS (SELECT row_id, label, x, l.tree_id, CASE WHEN n.kind IS NULL THEN l.node_id ELSE 2 * l.node_id + 1 + (x[n.dim + 1] >= n.t)::INT END AS node_id "
    f"FROM l{k} l LEFT JOIN nd n ON n.tree_id = l.tree_id AND n.node_id = l.node_id AND NOT n.is_leaf)"
    for k in range(3)
)
FORESTED = f"""{ROUTED}, pf AS (SELECT row_id, label AS truth, k.k AS label, avg(probs[k.k + 1]) AS prob FROM l3 JOIN nd USING (tree_id, node_id), range(10) k(k) GROUP BY ALL)"""


def routed(spark: SparkSession, d: str) -> DataFrame:
    return M.route_to_node(X.embedded(spark, d), M.nodes_frame(spark, FOREST), F.get("features", F.col("dim")), 3)


def forested(spark: SparkSession, d: str) -> DataFrame:
    return M.predict_forest(M.predict_leaf(routed(spark, d), M.nodes_frame(spark, FOREST)), ["row_id"])


def valued(spark: SparkSession, d: str) -> DataFrame:
    return X.vectors(spark, d).select(F.lit(0).alias("tree_id"), F.lit(0).cast("long").alias("node_id"), "label", VECTORS.values(CANDS).alias("values"))


def hist(spark: SparkSession, d: str) -> DataFrame:
    bins = H.bin_counts(valued(spark, d), dict(enumerate(CANDS.thresholds)), CANDS.kinds(), T.KEYS)
    return H.split_histograms(bins, CANDS.frame(spark), T.KEYS)


def gains(spark: SparkSession, d: str) -> DataFrame:
    return H.information_gain(hist(spark, d), T.KEYS)


def grown_sql(source: str, cands, num_feat: int, levels: int, trees: int = 1, min_info: float = 0.0, strict: bool = False, classes: int = 3, dims: bool = False, p: str = "") -> str:
    """CTEs of a forest trained level by level on `source` (label, x, image_id), up to {p}model: a row a split, one for each class a leaf.

    x holds a value for each feature, or the components that features name (dims).  Names begin with p.
    """
    rows = values_sql([(*r, cands.params[r[0]]["dim"] if dims else r[0], r[0] // num_feat) for r in cands.rows()], "feat, kind, rnk, feat_ind, t, dim, tree_id")
    passed = "(CASE WHEN kind = 2 THEN x[dim + 1] = t ELSE x[dim + 1] >= t END)::INT"
    out = [f"{p}c AS MATERIALIZED (SELECT * FROM {rows})", f"{p}s0 AS MATERIALIZED (SELECT tree_id::INT AS tree_id, 0::BIGINT AS node_id, label, x, image_id FROM {source}, range({trees}) r(tree_id))"]
    for k in range(levels):
        out.append(f"""{p}h{k} AS (SELECT s.tree_id, node_id, feat_ind, label, sum({passed})::BIGINT AS qr, count(*)::BIGINT AS n FROM {p}s{k} s JOIN {p}c c ON c.tree_id = s.tree_id GROUP BY ALL),
{p}g{k} AS (SELECT tree_id, node_id, feat_ind, sum(n - qr) AS nl, sum(qr) AS nr, sum(CASE WHEN n > qr THEN (n - qr) * log2((n - qr)::DOUBLE) ELSE 0 END) AS sl,
  sum(CASE WHEN qr > 0 THEN qr * log2(qr::DOUBLE) ELSE 0 END) AS sr, sum(n * log2(n::DOUBLE)) AS sa FROM {p}h{k} GROUP BY ALL),
{p}i{k} AS (SELECT tree_id, node_id, feat_ind, nl, nr, CASE WHEN nl = 0 OR nr = 0 THEN 0 ELSE round((((nl + nr) * log2((nl + nr)::DOUBLE) - sa) - (nl * log2(nl::DOUBLE) - sl)
  - (nr * log2(nr::DOUBLE) - sr)) / (nl + nr), 12) END AS gain FROM {p}g{k}),
{p}b{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY gain DESC, feat_ind) AS r FROM {p}i{k})
  WHERE r = 1 AND nl > 0 AND nr > 0 AND gain {'>' if strict else '>='} {min_info!r}::DOUBLE),
{p}s{k + 1} AS MATERIALIZED (SELECT s.tree_id, 2 * s.node_id + 1 + {passed} AS node_id, label, x, image_id FROM {p}s{k} s JOIN {p}b{k} USING (tree_id, node_id) JOIN {p}c USING (feat_ind))""")
    splits = " UNION ALL ".join(f"SELECT tree_id, node_id, feat_ind, gain FROM {p}b{k}" for k in range(levels))
    ends = " UNION ALL ".join(
        f"SELECT tree_id, node_id, label FROM {p}s{k}" + (f" ANTI JOIN {p}b{k} USING (tree_id, node_id)" if k < levels else "") for k in range(levels + 1)
    )
    seen = " UNION ALL ".join(f"SELECT tree_id, node_id, count(DISTINCT image_id)::BIGINT AS num_images FROM {p}s{k} GROUP BY ALL" for k in range(levels + 1))
    out.append(f"""{p}sp AS MATERIALIZED ({splits}), {p}en AS MATERIALIZED ({ends}), {p}im AS ({seen}),
{p}ln AS MATERIALIZED (SELECT tree_id, node_id, (row_number() OVER (PARTITION BY tree_id ORDER BY (node_id + 1) / pow(2.0::DOUBLE, floor(log2((node_id + 1)::DOUBLE)))) - 1)::INT AS leaf_id FROM (SELECT DISTINCT tree_id, node_id FROM {p}en)),
{p}cn AS MATERIALIZED (SELECT tree_id, node_id, label, count(*) AS n FROM {p}en GROUP BY ALL),
{p}lp AS MATERIALIZED (SELECT ln.tree_id, ln.node_id, leaf_id, k::INT AS label, coalesce(cn.n, 0) / (sum(cn.n) OVER (PARTITION BY ln.tree_id, ln.node_id)) AS prob
  FROM {p}ln ln CROSS JOIN range({classes}) r(k) LEFT JOIN {p}cn cn ON cn.tree_id = ln.tree_id AND cn.node_id = ln.node_id AND cn.label = k),
{p}model AS (SELECT tree_id, node_id, false AS is_leaf, feat::INT AS dim, kind, t, round(gain, 6) AS info_gain, -1 AS leaf_id, -1 AS label, -1.0::DOUBLE AS prob FROM {p}sp JOIN {p}c USING (tree_id, feat_ind)
  UNION ALL SELECT tree_id, node_id, true, -1, -1, -1.0::DOUBLE, -1.0::DOUBLE, leaf_id, label, round(prob, 6) FROM {p}lp)""")
    return ",\n".join(out)


def reached_sql(source: str, levels: int, p: str = "") -> str:
    """CTE {p}lf: the rows of `source` (with x) with the leaf (tree_id, node_id) of the forest p that each reaches in each tree."""
    now = f"(SELECT *, 0::BIGINT AS node_id FROM {source}, (SELECT DISTINCT tree_id FROM {p}ln))"
    for _ in range(levels):
        now = f"""(SELECT q.* EXCLUDE (node_id), CASE WHEN c.t IS NULL THEN q.node_id ELSE 2 * q.node_id + 1 + (CASE WHEN c.kind = 2 THEN x[c.dim + 1] = c.t ELSE x[c.dim + 1] >= c.t END)::INT END AS node_id
 FROM {now} q LEFT JOIN {p}sp sp ON sp.tree_id = q.tree_id AND sp.node_id = q.node_id LEFT JOIN {p}c c ON c.feat_ind = sp.feat_ind)"""
    return f"{p}lf AS MATERIALIZED (SELECT * FROM {now})"


def trained_sql(num_feat: int, num_thresh: int, levels: int, trees: int = 1, min_info: float = 0.0, strict: bool = False) -> str:
    """The nodes that train_forest gives for the line items."""
    return f"WITH {X.F1}, {FX}, {grown_sql('f1x', VECTORS.candidates(num_feat * trees, num_thresh, 1234), num_feat, levels, trees, min_info, strict, dims=True)}\nSELECT * FROM model"


def by_class(nodes: DataFrame) -> DataFrame:
    """Nodes with a row for each class of a leaf, and one for a split; -1 stands for what a node doesn't have."""
    each = nodes.select("*", F.posexplode_outer("probs").alias("label", "prob")).drop("probs", "family", "params")
    each = each.withColumn("info_gain", r6("info_gain")).withColumn("prob", r6("prob"))
    return each.fillna(-1, ["dim", "kind", "t", "info_gain", "leaf_id", "label", "prob"])


# pixels and prefix sums as arrays, for look-ups in SQL
PIX = """im AS MATERIALIZED (SELECT vec_id AS image_id, list_transform(range(448), lambda k: floor((embedding[((k // 7 + 9 * (k % 7)) % 64 + 1)::INT]::DOUBLE + 1) * 127.5::DOUBLE)::INT) AS pix FROM embeddings)"""
TABS = "tb AS MATERIALIZED (SELECT image_id, list(s ORDER BY i, j, mask) AS tab FROM it GROUP BY 1)"


def pixel_sql(dy: int, dx: int, b: int) -> str:
    return f"pix[((greatest(0, least(7, i + {dy})) * 8 + greatest(0, least(7, j + {dx}))) * 7 + {b} + 1)::INT]"


def texton_sql(p: dict) -> str:
    a, b = pixel_sql(p["dy0"], p["dx0"], p["b0"]), pixel_sql(p["dy1"], p["dx1"], p["b1"])
    return (a, f"({a} + {b})", f"({a} - {b})", f"abs({a} - {b})")[p["texton"]]


def box_sql(p: dict, masks: int = 4) -> str:
    """A box feature's value from `tab` of 9 x 9 x masks sums and the edges that edges_sql gives."""
    at = lambda y, x: f"tab[({y} * 9 + {x}) * {masks} + {p['mask'] + 1}]"
    out = " + ".join(f"({sign}) * ({at(c, d)} - {at(a, d)} - {at(c, b)} + {at(a, b)})" for sign, a, b, c, d in R.BOXES[p["pattern"]])
    area = "((y1 - y0) * (x1 - x0))"
    return f"CASE WHEN {area} > 0 THEN trunc(({out}) / {area} * 2147483646)::BIGINT ELSE 0 END"


def edges_sql(source: str, p: dict) -> str:
    """The rows of `source` with the edges of a box as columns: sides cut into thirds and halves, each rounded down once."""
    ends = ", ".join(
        f"greatest(0, least(8, {at} + {p[u] + d}))::INT AS {n}" for n, at, u, d in (("y0", "i", "uy", -p["bh"]), ("y1", "i", "uy", p["bh"] + 1), ("x0", "j", "ux", -p["bw"]), ("x1", "j", "ux", p["bw"] + 1))
    )
    inner = ", ".join(f"{n}0 + {k} * ({n}1 - {n}0) // {m} AS {n}{c}" for n in "yx" for c, k, m in (("a", 1, 3), ("b", 2, 3), ("m", 1, 2)))
    return f"(SELECT *, {inner} FROM (SELECT *, {ends} FROM {source}))"


# -- sources ---------------------------------------------------------------------------------------


@query("load_labeled_records", """WITH r AS (SELECT CASE WHEN vec_id % 7 = 3 THEN NULL WHEN vec_id % 11 = 5 THEN '' ELSE 'img' || vec_id END AS k FROM embeddings)
SELECT CASE WHEN k IS NULL THEN 'null' WHEN k = '' THEN 'empty' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM r GROUP BY 1""")
def q_load(spark, d):
    key = F.when(F.col("vec_id") % 7 == 3, None).when(F.col("vec_id") % 11 == 5, "").otherwise(F.concat(F.lit("img"), F.col("vec_id")))
    path = IO.scratch(spark)
    X.table(spark, d, "embeddings").withColumn("key", key).write.parquet(path)
    kept, rejects = IO.load_labeled_records(spark, path, columns=["vec_id", "embedding"])
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("reason"), "n").unionByName(rejects)


@query("labeled_records", f"""WITH {X.F2}, {X.F6}, k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN NULL WHEN vec_id % 11 = 5 THEN ' ' ELSE 'img' || vec_id END AS k, vec_id % 13 = 6 AS cut FROM embeddings),
r AS (SELECT *, CASE WHEN k IS NULL THEN 'null' WHEN k = ' ' THEN 'empty' WHEN cut THEN 'shape' END AS bad FROM k),
s AS (SELECT image_id, sum(v)::BIGINT AS total FROM f2 GROUP BY 1), p AS (SELECT image_id, string_agg(label || ':' || i || ':' || j, ',' ORDER BY label, i, j) AS points FROM f6 GROUP BY 1)
SELECT k AS key, total AS n, coalesce(points, '') AS points FROM r JOIN s ON s.image_id = vec_id LEFT JOIN p ON p.image_id = vec_id WHERE bad IS NULL
UNION ALL SELECT bad, count(*)::BIGINT, NULL FROM r WHERE bad IS NOT NULL GROUP BY bad""")
def q_labeled(spark, d):
    """Image records with bad ones among them, written by the data source in shards and read again: good ones by the sum of their pixels, others counted."""
    images, points = X.images(spark, d), X.points(spark, d)
    lists = points.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label", "i", "j"))).alias("points"))
    key = F.when(F.col("image_id") % 7 == 3, None).when(F.col("image_id") % 11 == 5, " ").otherwise(F.concat(F.lit("img"), F.col("image_id")))
    # values are below 256: two digits each make a byte
    pixels = F.unhex(F.array_join(F.transform("pixels", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    short = F.when(F.col("image_id") % 13 == 6, F.expr("substring(packed, 1, 100)")).otherwise(F.col("packed"))
    rows = images.join(lists, "image_id", "left").withColumn("packed", pixels).select(key.alias("key"), "height", "width", F.lit(7).alias("bands"), short.alias("pixels"), "points")
    path = IO.scratch(spark)
    LR.write_records(rows, path)
    good, rejects = LR.read_records(spark, path)
    total = F.aggregate(F.regexp_extract_all(F.hex("pixels"), F.lit("(..)"), F.lit(1)), F.lit(0).cast("long"), lambda t, byte: t + F.conv(byte, 16, 10).cast("long"))
    text = F.array_join(F.transform(F.coalesce("points", F.array()), lambda p: F.concat_ws(":", p["label"], p["i"], p["j"])), ",")
    return good.select("key", total.alias("n"), text.alias("points")).unionByName(rejects.select(F.col("reason").alias("key"), "n", F.lit(None).cast("string").alias("points")))


@query("write_sharded", "SELECT count(*)::BIGINT AS n, true AS within FROM part")
def q_sharded(spark, d):
    path = IO.scratch(spark)
    IO.write_sharded(X.table(spark, d, "part"), path)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return files.agg(F.sum("n").alias("n"), (F.max("n") <= 100).alias("within"))


@query("filter_key_prefix", "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def q_prefix(spark, d):
    return IO.filter_key_prefix(X.table(spark, d, "part"), "p_brand", "Brand#1").select("p_partkey", "p_brand")


@query("select_classifiers", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'PROMO')")
def q_select(spark, d):
    return IO.select_classifiers(X.table(spark, d, "part"), "p_type", ["ECONOMY", "PROMO"]).select("p_partkey", "p_type")


@query("save_model", """SELECT label, count(*)::BIGINT AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem) GROUP BY 1""")
def q_save(spark, d):
    """A trained model, saved and loaded: the training rows that its leaves hold, by class."""
    rows, _ = T.train_forest(X.vectors(spark, d), VECTORS, 3, max_levels=2, num_feat=8, num_thresh=5)
    path = IO.scratch(spark)
    IO.save_model(spark, rows, path)
    scored = T.predict_samples(X.vectors(spark, d), IO.load_model(spark, path), ["label"])
    return scored.groupBy("label").agg(F.count("*").alias("n"))


@query("load_model", trained_sql(8, 5, 2).replace("SELECT * FROM model", "SELECT m.*, floor(log2((node_id + 1)::DOUBLE))::INT AS level, num_images FROM model m JOIN im USING (tree_id, node_id)"))
def q_load_model(spark, d):
    """A model as it was saved after its last level, with the orders that passed each node."""
    path = IO.scratch(spark)
    T.train_forest(X.vectors(spark, d), VECTORS, 3, max_levels=2, num_feat=8, num_thresh=5, save_to=path)
    return by_class(IO.load_model(spark, f"{path}/level=2"))


def _merged_sql() -> str:
    """Confusion of two forests of other seeds, merged: training rows by what they look like, each forest's mean of its trees."""
    one, two = (grown_sql("f1x", VECTORS.candidates(16, 5, seed), 8, 2, 2, dims=True, p=p) for seed, p in ((1234, "a"), (77, "b")))
    probs = lambda p: f"SELECT x, lp.label AS cls, sum(prob) AS prob FROM {p}lf lf JOIN {p}lp lp USING (tree_id, node_id) GROUP BY x, lp.label"
    return f"""WITH {X.F1}, {FX}, kinds AS MATERIALIZED (SELECT DISTINCT x FROM f1x), {one}, {reached_sql('kinds', 2, 'a')}, {two}, {reached_sql('kinds', 2, 'b')},
both_ AS (SELECT x, cls, sum(prob) / 4 AS prob FROM ({probs('a')} UNION ALL {probs('b')}) GROUP BY x, cls),
top AS (SELECT x, arg_min(cls, struct_pack(p := -round(prob, 9), cls := cls)) AS predicted, max(round(prob, 9)) AS prob FROM both_ GROUP BY x)
SELECT label, predicted, count(*)::BIGINT AS n, round(sum(prob), 4) AS prob FROM f1x JOIN top USING (x) GROUP BY ALL"""


@query("merge_models", _merged_sql())
def q_merge(spark, d):
    """Two forests of different features, trained, saved, loaded, merged and scored: what they predict, by class."""
    rows = X.vectors(spark, d)
    path = IO.scratch(spark)
    for seed in (1234, 77):
        IO.save_model(spark, T.train_forest(rows, VECTORS, 3, max_levels=2, num_feat=8, num_thresh=5, seed=seed, num_trees=2)[0], f"{path}/{seed}")
    both = M.merge_models([IO.load_model(spark, f"{path}/{seed}") for seed in (1234, 77)])
    numbered = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    probs = M.predict_forest(T.predict_samples(numbered, both, ["row", "label"]).withColumnRenamed("label", "truth"), ["row", "truth"])
    top = M.argmax_class(probs.withColumn("prob", F.round("prob", 9)), ["row", "truth"])
    return top.groupBy(F.col("truth").alias("label"), F.col("label").alias("predicted")).agg(F.count("*").alias("n"), F.round(F.sum("prob"), 4).alias("prob"))


@query("stored_param_hist", f"""WITH {X.F1}, {FX}, {grown_sql('f1x', VECTORS.candidates(24, 5, 1234), 8, 3, 3, dims=True)},
s AS (SELECT 'dim' AS param, c.dim::DOUBLE AS v FROM sp JOIN c USING (tree_id, feat_ind) UNION ALL SELECT 't', t FROM sp JOIN c USING (tree_id, feat_ind)),
w AS (SELECT *, min(v) OVER (PARTITION BY param) AS lo, max(v) OVER (PARTITION BY param) AS hi FROM s)
SELECT param, (CASE WHEN hi = lo THEN 0 ELSE least(19, floor((v - lo) * 20 / (hi - lo))) END)::INT AS bin, count(*)::BIGINT AS n FROM w GROUP BY ALL""")
def q_stored_params(spark, d):
    """Histograms of the parameters that a saved model's splits hold."""
    path = IO.scratch(spark)
    IO.save_model(spark, T.train_forest(X.vectors(spark, d), VECTORS, 3, max_levels=3, num_feat=8, num_thresh=5, num_trees=3)[0], path)
    shares = M.model_param_hist(IO.load_model(spark, path).drop("dim"), ["dim", "t"])
    return shares.withColumn("bin", F.col("bin").cast("int"))


@query("write_predictions", f"""WITH {FORESTED}, a AS (SELECT row_id, truth, label, row_number() OVER (PARTITION BY row_id ORDER BY prob DESC, label) AS r FROM pf)
SELECT label::INT AS label, truth, count(*)::BIGINT AS n FROM a WHERE r = 1 GROUP BY ALL""")
def q_predictions(spark, d):
    path = IO.scratch(spark)
    shown = X.embedded(spark, d).select("row_id", F.col("label").alias("truth"))
    IO.write_predictions(M.argmax_class(forested(spark, d), ["row_id"]), path, shown, ["row_id"])
    return spark.read.parquet(path).groupBy("label", "truth").agg(F.count("*").alias("n"))


#: Corners of hulls: pixels that see all others of their region within a half turn; in the order of the angle about their mean, from the leftmost.
HULLS = f"""{X.F2}, {X.F5}, ex AS (SELECT DISTINCT image_id, cls AS region, unnest([lo, hi])::INT AS x, i AS y FROM (SELECT image_id, cls, i, min(j) AS lo, max(j) AS hi FROM f5 GROUP BY ALL)),
an AS (SELECT a.*, atan2((b.y - a.y)::DOUBLE, (b.x - a.x)::DOUBLE) AS ang FROM ex a LEFT JOIN ex b ON a.image_id = b.image_id AND a.region = b.region AND (a.x <> b.x OR a.y <> b.y)),
ga AS (SELECT image_id, region, x, y, coalesce(ang - lag(ang) OVER w, ang - max(ang) OVER p + 2 * pi()) AS gap FROM an WINDOW w AS (PARTITION BY image_id, region, x, y ORDER BY ang), p AS (PARTITION BY image_id, region, x, y)),
co AS (SELECT image_id, region, x, y FROM ga GROUP BY ALL HAVING coalesce(max(gap), 9) > pi() + 1e-9::DOUBLE),
ce AS (SELECT *, atan2(y - avg(y) OVER q, x - avg(x) OVER q) AS a FROM co WINDOW q AS (PARTITION BY image_id, region)),
st AS (SELECT *, first_value(a) OVER (PARTITION BY image_id, region ORDER BY x, y) AS a0 FROM ce),
hu AS (SELECT image_id, region, x, y, (row_number() OVER (PARTITION BY image_id, region ORDER BY CASE WHEN a < a0 THEN a - a0 + 2 * pi() ELSE a - a0 END) - 1)::INT AS k FROM st)"""


@query("export_segments_json", f"""WITH {HULLS}, rg AS (SELECT image_id, region, '[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY k) || ']' AS h FROM hu GROUP BY ALL),
sg AS (SELECT image_id, '[' || string_agg(h, ',' ORDER BY region) || ']' AS s FROM rg GROUP BY 1),
cp AS (SELECT image_id, cls, round(count(*) / 64, 4) AS p FROM f5 GROUP BY ALL), pr AS (SELECT image_id, '{{' || string_agg('"' || cls || '":' || p, ',' ORDER BY cls) || '}}' AS c FROM cp GROUP BY 1)
SELECT image_id, '{{"segments":' || s || ',"class_prob":' || c || '}}' AS json FROM sg JOIN pr USING (image_id)""")
def q_json(spark, d):
    labels = X.masks(spark, d).withColumnRenamed("cls", "region")
    probs = X.masks(spark, d).groupBy("image_id", F.col("cls").cast("string").alias("name")).agg(F.round(F.count("*") / 64, 4).alias("prob"))
    return IO.export_segments_json(G.region_hulls(labels), probs)


# -- label preparation -----------------------------------------------------------------------------

_SIZES = "SELECT p_partkey, (p_size * 17)::INT AS height, (p_partkey % 700 + 1)::INT AS width FROM part"


def sizes(spark, d):
    return X.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 17).cast("int").alias("height"), (F.col("p_partkey") % 700 + 1).cast("int").alias("width"))


@query("resize_dims", f"""WITH s AS ({_SIZES}) SELECT p_partkey, height, width,
 (CASE WHEN greatest(height, width) <= 320 THEN height WHEN height >= width THEN 320 ELSE floor(320.0::DOUBLE * height / width) END)::INT AS new_height,
 (CASE WHEN greatest(height, width) <= 320 THEN width WHEN width > height THEN 320 ELSE floor(320.0::DOUBLE * width / height) END)::INT AS new_width,
 round(CASE WHEN greatest(height, width) <= 320 THEN 1.0::DOUBLE ELSE 320.0::DOUBLE / greatest(height, width) END, 6) AS ratio FROM s""")
def q_dims(spark, d):
    return P.resize_dims(sizes(spark, d)).withColumn("ratio", r6("ratio"))


def _five(spark, d):
    return X.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), *[F.lit(v).alias(n) for n, v in (("height", 8), ("width", 8), ("new_height", 5), ("new_width", 6))])


@query("resize_mask_nearest", f"""WITH {X.F2}, {X.F5} SELECT f5.image_id, y::INT AS i, x::INT AS j, cls FROM range(5) a(y), range(6) b(x), f5
WHERE f5.i = floor(y * 8 / 5) AND f5.j = floor(x * 8 / 6)""")
def q_nearest(spark, d):
    return P.resize_mask_nearest(X.masks(spark, d), _five(spark, d))


@query("resize_image_linear", f"""WITH {X.F2},
ax AS (SELECT y::INT AS y, greatest(0.0::DOUBLE, least((y + 0.5::DOUBLE) * 8 / 5 - 0.5::DOUBLE, 7.0::DOUBLE)) AS p FROM range(5) a(y)),
bx AS (SELECT x::INT AS x, greatest(0.0::DOUBLE, least((x + 0.5::DOUBLE) * 8 / 6 - 0.5::DOUBLE, 7.0::DOUBLE)) AS p FROM range(6) a(x)),
ay AS (SELECT y, floor(p)::INT AS s, 1 - (p - floor(p)) AS w FROM ax UNION ALL SELECT y, least(floor(p)::INT + 1, 7), p - floor(p) FROM ax),
bw AS (SELECT x, floor(p)::INT AS s, 1 - (p - floor(p)) AS w FROM bx UNION ALL SELECT x, least(floor(p)::INT + 1, 7), p - floor(p) FROM bx)
SELECT image_id, y AS i, x AS j, b, round(sum(ay.w * bw.w * v), 6) AS v FROM ay, bw JOIN f2 ON f2.i = ay.s AND f2.j = bw.s GROUP BY ALL""")
def q_linear(spark, d):
    return P.resize_image_linear(X.px(spark, d), _five(spark, d)).withColumn("v", r6("v"))


@query("drop_small_images", f"WITH s AS ({_SIZES}) SELECT * FROM s WHERE height >= 201 AND width >= 201")
def q_small(spark, d):
    return P.drop_small_images(sizes(spark, d), 100)


_RGB = "rgb AS (SELECT image_id, i, j, max(CASE WHEN b = 0 THEN v END) AS r, max(CASE WHEN b = 1 THEN v END) AS g, max(CASE WHEN b = 2 THEN v END) AS bl FROM f2 WHERE b < 3 GROUP BY ALL)"


#: The seven bands `bd` from `rgb`.
_BANDS = """lin AS (SELECT *, (CASE WHEN r / 255.0::DOUBLE <= 0.04045::DOUBLE THEN r / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((r / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) AS lr,
 (CASE WHEN g / 255.0::DOUBLE <= 0.04045::DOUBLE THEN g / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((g / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) AS lg,
 (CASE WHEN bl / 255.0::DOUBLE <= 0.04045::DOUBLE THEN bl / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((bl / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) AS lb,
 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * bl AS gray FROM rgb),
xyz AS (SELECT *, (0.412453::DOUBLE * lr + 0.357580::DOUBLE * lg + 0.180423::DOUBLE * lb) / 0.950456::DOUBLE AS cx, 0.212671::DOUBLE * lr + 0.715160::DOUBLE * lg + 0.072169::DOUBLE * lb AS cy,
 (0.019334::DOUBLE * lr + 0.119193::DOUBLE * lg + 0.950227::DOUBLE * lb) / 1.088754::DOUBLE AS cz FROM lin),
f AS (SELECT *, CASE WHEN cx > 0.008856::DOUBLE THEN cbrt(cx) ELSE 7.787::DOUBLE * cx + 16.0::DOUBLE / 116 END AS fx, CASE WHEN cy > 0.008856::DOUBLE THEN cbrt(cy) ELSE 7.787::DOUBLE * cy + 16.0::DOUBLE / 116 END AS fy,
 CASE WHEN cz > 0.008856::DOUBLE THEN cbrt(cz) ELSE 7.787::DOUBLE * cz + 16.0::DOUBLE / 116 END AS fz, CASE WHEN cy > 0.008856::DOUBLE THEN 116 * cbrt(cy) - 16 ELSE 903.3::DOUBLE * cy END AS li,
 coalesce(sqrt(pow((lead(gray) OVER rw - lag(gray) OVER rw) / 2, 2) + pow((lead(gray) OVER cw - lag(gray) OVER cw) / 2, 2)), 0) AS gr
 FROM xyz WINDOW rw AS (PARTITION BY image_id, i ORDER BY j), cw AS (PARTITION BY image_id, j ORDER BY i)),
w AS (SELECT image_id, i, j, [bl::DOUBLE, g, r, li * 255 / 100, 500 * (fx - fy) + 128, 200 * (fy - fz) + 128, gr] AS a FROM f),
bd AS (SELECT image_id, i, j, k::INT AS b, (CASE WHEN k < 3 THEN a[k + 1] ELSE floor(greatest(0, least(255, a[k + 1])) + 0.5::DOUBLE) END)::INT AS v FROM w, range(7) r(k))"""


@query("feature_bands", f"WITH {X.F2}, {_RGB},\n{_BANDS} SELECT * FROM bd")
def q_bands(spark, d):
    rgb = X.px(spark, d).where("b < 3").groupBy("image_id", "i", "j").pivot("b", [0, 1, 2]).agg(F.max("v"))
    return P.feature_bands(rgb.withColumnsRenamed({"0": "r", "1": "g", "2": "b"}))


@query("enumerate_classes", "SELECT p_brand AS name, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS class_id FROM (SELECT DISTINCT p_brand FROM part)")
def q_enum(spark, d):
    return P.enumerate_classes(X.table(spark, d, "part"), "p_brand").withColumn("class_id", F.col("class_id").cast("int"))


@query("map_classes", """WITH c AS (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS class_id FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#2'))
SELECT p_partkey, p_brand, class_id FROM part JOIN c USING (p_brand)""")
def q_map(spark, d):
    part = X.table(spark, d, "part")
    classes = P.enumerate_classes(part.where("p_brand < 'Brand#2'"), "p_brand")
    return P.map_classes(part.select("p_partkey", "p_brand"), classes, "p_brand").withColumn("class_id", F.col("class_id").cast("int"))


@query("mask_to_points", f"WITH {X.F2}, {X.F5} SELECT image_id, cls AS label, i, j FROM f5 WHERE cls <> 0")
def q_points(spark, d):
    return P.mask_to_points(X.masks(spark, d))


_SAMPLED = f"""pts AS (SELECT image_id, cls AS label, i, j FROM f5 WHERE cls <> 0),
smp AS (SELECT image_id, label, i, j FROM (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY {mixed_sql('0', 'image_id', 'i', 'j')}, i, j) AS r FROM pts) WHERE r <= 5)"""


@query("sample_points", f"WITH {X.F2}, {X.F5}, {_SAMPLED} SELECT * FROM smp")
def q_sample(spark, d):
    return P.sample_points(P.mask_to_points(X.masks(spark, d)), 5)


@query("images_with_labels", f"WITH {X.F2}, {X.F5} SELECT vec_id AS image_id, label FROM embeddings WHERE vec_id IN (SELECT image_id FROM f5 WHERE cls = 3 AND i = j)")
def q_with(spark, d):
    shown = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    return P.images_with_labels(shown, X.masks(spark, d).where("cls = 3 and i = j"))


@query("explode_masks", f"""WITH {X.F2}, {X.F5}, n AS (SELECT p_brand AS name, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS k FROM (SELECT DISTINCT p_brand FROM part))
SELECT image_id, i, j, name, (CASE WHEN cls = k THEN 255 ELSE 127 END)::INT AS v FROM f5, n WHERE k < 4""")
def q_explode(spark, d):
    truth = X.masks(spark, d).select("image_id", "i", "j", F.array(*[F.when(F.col("cls") == k, 1.0).otherwise(0.5) for k in range(4)]).alias("channels"))
    return P.explode_masks(truth, P.enumerate_classes(X.table(spark, d, "part"), "p_brand"))


@query("validate_labels", "SELECT greatest(5, max(label) + 1)::INT AS num_classes, count(*)::BIGINT AS n FROM embeddings")
def q_validate(spark, d):
    rows = X.embedded(spark, d)
    return rows.agg(F.count("*").alias("n")).select(F.lit(H.validate_labels(rows, "label", 5)).alias("num_classes"), "n")


@query("partition_by_split", "SELECT embedding[4]::DOUBLE >= 0.05::DOUBLE AS side, vec_id AS row_id, label FROM embeddings")
def q_split(spark, d):
    no, yes = H.partition_by_split(X.embedded(spark, d), F.get("features", 3) >= 0.05)
    return no.select(F.lit(False).alias("side"), "row_id", "label").unionByName(yes.select(F.lit(True).alias("side"), "row_id", "label"))


@query("prepare_labeled_points", f"""WITH {X.F2}, {X.F5},
ax AS (SELECT y::INT AS y, greatest(0.0::DOUBLE, least((y + 0.5::DOUBLE) * 8 / 6 - 0.5::DOUBLE, 7.0::DOUBLE)) AS p FROM range(6) a(y)),
ay AS (SELECT y, floor(p)::INT AS s, 1 - (p - floor(p)) AS w FROM ax UNION ALL SELECT y, least(floor(p)::INT + 1, 7), p - floor(p) FROM ax),
sm AS (SELECT image_id, a.y AS i, c.y AS j, b, round(round(sum(a.w * c.w * v), 6))::INT AS v FROM ay a, ay c JOIN f2 ON f2.i = a.s AND f2.j = c.s WHERE b < 3 GROUP BY ALL),
rgb AS (SELECT image_id, i, j, max(CASE WHEN b = 0 THEN v END) AS r, max(CASE WHEN b = 1 THEN v END) AS g, max(CASE WHEN b = 2 THEN v END) AS bl FROM sm GROUP BY ALL),
{_BANDS},
pt AS (SELECT image_id, cls - 1 AS label, y::INT AS i, x::INT AS j FROM range(6) a(y), range(6) b(x), f5 WHERE f5.i = floor(y * 8 / 6) AND f5.j = floor(x * 8 / 6) AND cls > 0),
sp AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY {mixed_sql('0', 'image_id', 'i', 'j')}, i, j) AS r FROM pt)
SELECT image_id, label, i, j, b, v FROM sp JOIN bd USING (image_id, i, j) WHERE r <= 4""")
def q_prepare(spark, d):
    """Sampled points of three known classes on images brought to a side of six, with the bands there."""
    shown = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    rgb = X.px(spark, d).where("b < 3").groupBy("image_id", "i", "j").pivot("b", [0, 1, 2]).agg(F.max("v")).withColumnsRenamed({"0": "r", "1": "g", "2": "b"})
    masks = X.masks(spark, d).select("image_id", F.concat(F.lit("c"), "cls").alias("name"), "i", "j", F.lit(255).alias("v"))
    classes = P.enumerate_classes(masks.where("name != 'c0'"), "name")
    bands, points, _ = P.prepare_labeled_points(shown, rgb, masks, classes, 6, 2, 4)
    return points.join(bands, ["image_id", "i", "j"]).select("image_id", F.col("label").cast("int").alias("label"), "i", "j", "b", "v")


# -- joins -----------------------------------------------------------------------------------------


@query("candidate_cross", f"""WITH {CAND_SQL}, e AS (SELECT vec_id AS row_id, embedding[1:6]::DOUBLE[] AS x FROM embeddings)
SELECT row_id, feat, round(x[dim + 1], 6) AS value FROM e, (SELECT DISTINCT feat, dim FROM c)""")
def q_cross(spark, d):
    one = F.posexplode(VECTORS.values(CANDS)).alias("feat", "value")
    return X.embedded(spark, d).select("row_id", one).withColumn("value", r6("value"))


@query("route_to_node", f"WITH {ROUTED} SELECT row_id, tree_id, node_id::BIGINT AS node_id FROM l3 WHERE floor(log2(node_id + 1)) = 2")
def q_route(spark, d):
    return M.at_level(routed(spark, d), 2).select("row_id", "tree_id", "node_id")


OFFSETS = [(-1, 2, 3), (3, 0, 6), (0, 0, 9)]


@query("texton_lookup", f"""WITH {X.F2}, {X.F6}, {PIX} SELECT image_id, i, j, {pixel_sql(-1, 2, 3)} AS v0, {pixel_sql(3, 0, 6)} AS v1, 0 AS v2 FROM f6 JOIN im USING (image_id)""")
def q_texton_lookup(spark, d):
    return R.texton_lookup(X.points(spark, d), X.px(spark, d), OFFSETS, F.lit(8), F.lit(8), ["image_id", "i", "j"])


#: Prefix sums of each class of f5, by running sums.
_INT = """pm AS MATERIALIZED (SELECT image_id, m::INT AS mask, i, j, (cls = m)::INT AS x FROM f5, range(4) a(m)),
pr AS MATERIALIZED (SELECT image_id, mask, i, j, sum(x) OVER (PARTITION BY image_id, mask, i ORDER BY j) AS x FROM pm),
pc AS MATERIALIZED (SELECT image_id, mask, i + 1 AS i, j + 1 AS j, (sum(x) OVER (PARTITION BY image_id, mask, j ORDER BY i))::DOUBLE AS s FROM pr),
it AS MATERIALIZED (SELECT * FROM pc UNION ALL SELECT image_id, mask, i, 0, 0 FROM pc WHERE j = 1 UNION ALL SELECT image_id, mask, 0, j, 0 FROM pc WHERE i = 1
 UNION ALL SELECT image_id, mask, 0, 0, 0 FROM pc WHERE i = 1 AND j = 1)"""
BOX = {"mask": 1, "uy": 1, "ux": -1, "bh": 2, "bw": 1}


def _box_sql(pattern: int) -> str:
    at = edges_sql("f6 JOIN tb USING (image_id)", BOX)
    return f"WITH {X.F2}, {X.F5}, {X.F6}, {_INT}, {TABS} SELECT image_id, i, j, {box_sql(BOX | {'pattern': pattern})} AS value FROM {at}"


@query("box_corner_lookup", _box_sql(4))
def q_corners(spark, d):
    return R.box_corner_lookup(X.points(spark, d), R.integral_labels(X.masks(spark, d), 4), 4, BOX, F.lit(9), F.lit(9), ["image_id", "i", "j"])


@query("attach_image_scores", f"WITH {X.F2}, {X.F6} SELECT f6.image_id, f6.label, i, j, 0 AS ilp_dim, e.label / 10.0::DOUBLE AS score FROM f6 JOIN embeddings e ON e.vec_id = f6.image_id")
def q_attach(spark, d):
    return R.attach_image_scores(X.points(spark, d), X.scores(spark, d))


@query("prediction_vs_truth", f"""WITH {FORESTED}, a AS (SELECT row_id, truth, label, row_number() OVER (PARTITION BY row_id ORDER BY prob DESC, label) AS r FROM pf)
SELECT truth, label::INT AS label, count(*)::BIGINT AS n FROM a WHERE r = 1 GROUP BY ALL""")
def q_truth(spark, d):
    truth = X.embedded(spark, d).select("row_id", F.col("label").alias("truth"))
    return M.argmax_class(forested(spark, d), ["row_id"]).join(truth, "row_id").groupBy("truth", "label").agg(F.count("*").alias("n"))


# -- aggregations ----------------------------------------------------------------------------------


@query("class_histogram", f"WITH {X.F1} SELECT k::INT AS label, count(f1.label)::BIGINT AS n FROM range(5) r(k) LEFT JOIN f1 ON f1.label = k GROUP BY 1")
def q_class(spark, d):
    return H.class_histogram(X.vectors(spark, d), "label", 5)


@query("weighted_histogram", f"WITH {X.F1} SELECT w::INT AS weight_row, label, sum((x4 + w)::BIGINT)::BIGINT AS total FROM f1, range(3) r(w) GROUP BY ALL")
def q_weighted(spark, d):
    rows = X.vectors(spark, d).withColumn("weight_row", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return H.weighted_histogram(rows.withColumn("weight", (F.get("features", 4) + F.col("weight_row")).cast("long")), "label", "weight_row", "weight")


@query("normalized_histogram", f"WITH {X.F1} SELECT k::INT AS label, round(count(f1.label) / (SELECT count(*) FROM f1), 6) AS prob FROM range(4) r(k) LEFT JOIN f1 ON f1.label = k GROUP BY 1")
def q_normal(spark, d):
    return H.normalized_histogram(X.vectors(spark, d), "label", 4).withColumn("prob", r6("prob"))


@query("leaf_probability_points", f"""WITH {X.F2}, {X.F6}, s AS (SELECT image_id % 5 AS grp, label, count(*) AS n FROM f6 GROUP BY ALL)
SELECT grp, label, round(n / sum(n) OVER (PARTITION BY grp), 6) AS prob FROM s""")
def q_leafprob(spark, d):
    sets = X.points(spark, d).groupBy((F.col("image_id") % 5).alias("grp"), "image_id", "label").agg(F.count("*").alias("size"))
    return H.leaf_probability(sets, ["grp"], "label", F.col("size")).withColumn("prob", r6("prob"))


@query("split_histograms", f"WITH {HIST} SELECT feat_ind, label, ql, qr FROM hist")
def q_hists(spark, d):
    return hist(spark, d).select("feat_ind", "label", "ql", "qr")


@query("merge_histograms", f"WITH {HIST} SELECT feat_ind, label, ql, qr, (SELECT count(DISTINCT image_id) FROM f1) AS num_images FROM hist")
def q_merge_hist(spark, d):
    parts = seen = None
    for k in range(3):
        some = X.vectors(spark, d).where(F.pmod("image_id", F.lit(3)) == k)
        root = [F.lit(0).alias("tree_id"), F.lit(0).cast("long").alias("node_id")]
        v = some.select(*root, "label", VECTORS.values(CANDS).alias("values"))
        one = H.split_histograms(H.bin_counts(v, dict(enumerate(CANDS.thresholds)), CANDS.kinds(), T.KEYS), CANDS.frame(spark), T.KEYS)
        images = some.select(*root, "image_id").distinct()
        parts, seen = (one, images) if parts is None else (parts.unionByName(one), seen.unionByName(images))
    return H.merge_histograms(parts, T.KEYS, seen).select("feat_ind", "label", "ql", "qr", "num_images")


@query("entropy", """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT l_suppkey, n / sum(n) OVER (PARTITION BY l_suppkey) AS p FROM c)
SELECT l_suppkey, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def q_entropy(spark, d):
    counts = X.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return H.entropy(counts, ["l_suppkey"], "n").withColumn("entropy", r6("entropy"))


@query("information_gain", f"WITH {GAIN} SELECT feat_ind, round(gain, 6) AS gain FROM gain")
def q_gain(spark, d):
    return gains(spark, d).select("feat_ind", r6("gain").alias("gain"))


@query("dim_ranges", "SELECT k::INT AS dim, min(embedding[k + 1])::DOUBLE AS lo, max(embedding[k + 1])::DOUBLE AS hi FROM embeddings, range(64) r(k) GROUP BY 1")
def q_ranges(spark, d):
    return H.dim_ranges(X.embedded(spark, d), "features")


@query("samples_per_class", f"WITH {X.F2}, {X.F5}, {_SAMPLED} SELECT label, count(*)::BIGINT AS n FROM smp GROUP BY 1")
def q_perclass(spark, d):
    return P.samples_per_class(P.sample_points(P.mask_to_points(X.masks(spark, d)), 5))


@query("label_coverage", f"""WITH {X.F2}, {X.F5}, {_SAMPLED} SELECT image_id, label, (SELECT count(*) FROM smp WHERE smp.image_id = pts.image_id AND smp.label = pts.label)::BIGINT AS sampled,
 count(*)::BIGINT AS available, round(count(*) / 64, 6) AS share FROM pts GROUP BY ALL""")
def q_coverage(spark, d):
    pts = P.mask_to_points(X.masks(spark, d))
    areas = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(64).alias("area"))
    return P.label_coverage(pts, P.sample_points(pts, 5), areas).withColumn("share", r6("share"))


def _splits(spark, d):
    """A model of one split for each part, to report on."""
    part = X.table(spark, d, "part")
    return part.select(
        (F.col("p_partkey") % 3).cast("int").alias("tree_id"), F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 4 == 0).alias("is_leaf"),
        F.col("p_size").alias("dim"), F.col("p_retailprice").alias("t"), F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit(0.5), F.lit(0.5))).alias("probs"),
    )


@query("model_param_hist", """WITH s AS (SELECT 'dim' AS param, p_size::DOUBLE AS v FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT 't', p_retailprice FROM part WHERE p_partkey % 4 <> 0),
w AS (SELECT *, min(v) OVER (PARTITION BY param) AS lo, max(v) OVER (PARTITION BY param) AS hi FROM s)
SELECT param, (CASE WHEN hi = lo THEN 0 ELSE least(19, floor((v - lo) * 20 / (hi - lo))) END)::INT AS bin, count(*)::BIGINT AS n FROM w GROUP BY ALL""")
def q_params(spark, d):
    return M.model_param_hist(_splits(spark, d), ["dim", "t"]).withColumn("bin", F.col("bin").cast("int"))


@query("model_summary", "SELECT (p_partkey % 3)::INT AS tree_id, count(*)::BIGINT AS nodes, sum((p_partkey % 4 = 0)::INT)::BIGINT AS leaves, 2 AS classes FROM part GROUP BY 1")
def q_summary(spark, d):
    return M.model_summary(_splits(spark, d))


@query("region_sizes", f"WITH {X.F2}, {X.F5} SELECT image_id, cls AS region, count(*)::BIGINT AS pixels FROM f5 GROUP BY ALL")
def q_sizes(spark, d):
    return G.region_sizes(X.masks(spark, d).withColumnRenamed("cls", "region"))


_VARIATION = """dv AS (SELECT image_id, i, j, v, lag(v) OVER (PARTITION BY image_id, i ORDER BY j) AS l, lag(v) OVER (PARTITION BY image_id, j ORDER BY i) AS u FROM f4),
va AS (SELECT image_id, avg(abs(v - l) + abs(v - u)) / 2 AS var FROM dv WHERE l IS NOT NULL AND u IS NOT NULL GROUP BY 1)"""
_VAR = f"{X.F4}, {_VARIATION}"


@query("image_variation", f"WITH {_VAR} SELECT image_id, round(var, 6) AS variation FROM va")
def q_variation(spark, d):
    return G.image_variation(X.gray(spark, d)[0]).withColumn("variation", r6("variation"))


_EDGES = "dr AS (SELECT * FROM (VALUES ('left', 0, -1), ('up', -1, 0), ('upleft', -1, -1), ('upright', -1, 1)) t(dir, di, dj))"


def _weights_sql(kind: int = 0) -> str:
    penalty = "1" if kind == 0 else "floor(1.5::DOUBLE * var / 8 + 1)"
    return f"""ew AS MATERIALIZED (SELECT a.image_id, a.i, a.j, dir, floor(10 * exp(CASE WHEN var = 0 THEN 0 ELSE -((a.v - b.v) * (a.v - b.v))::DOUBLE / (2 * var * var) END) + {penalty})::INT AS w
 FROM f4 a, dr JOIN f4 b ON b.image_id = a.image_id AND b.i = a.i + di AND b.j = a.j + dj JOIN va ON va.image_id = a.image_id)"""


_WEIGHTS = f"{_VAR}, {_EDGES}, {_weights_sql()}"


@query("edge_weights", f"WITH {_WEIGHTS} SELECT * FROM ew")
def q_weights(spark, d):
    return G.edge_weights(X.gray(spark, d)[0])


_SEEDS = "sd AS (SELECT s_suppkey AS image_id, (r * 9 + c)::INT AS seed, (5 + 5 * r)::INT AS i, (5 + 5 * c)::INT AS j FROM supplier, range(6) a(r), range(9) b(c))"
_START = """il AS (SELECT f4.image_id, f4.i, f4.j, f4.v, coalesce(max(seed), 0)::INT AS region FROM f4 LEFT JOIN sd ON sd.image_id = f4.image_id AND abs(f4.i - sd.i) <= 6 AND abs(f4.j - sd.j) <= 6 GROUP BY ALL)"""


def _regions(spark, d):
    raster, shown = X.gray(spark, d)
    seeds = G.place_seeds(shown, 10)
    return raster, seeds, G.initial_labels(seeds, shown, 10)


@query("boundary_energy", f"""WITH {_WEIGHTS}, {_SEEDS}, {_START},
cu AS (SELECT ew.image_id, CASE WHEN ew.dir IN ('left', 'up') THEN w ELSE floor(w / sqrt(2.0::DOUBLE)) END AS cost FROM ew JOIN dr USING (dir)
 JOIN il a ON a.image_id = ew.image_id AND a.i = ew.i AND a.j = ew.j JOIN il b ON b.image_id = ew.image_id AND b.i = ew.i + di AND b.j = ew.j + dj AND b.region <> a.region),
da AS (SELECT il.image_id, sum(least(abs(il.v - s.v), 15)) AS data FROM il JOIN sd ON sd.image_id = il.image_id AND sd.seed = il.region JOIN f4 s ON s.image_id = sd.image_id AND s.i = sd.i AND s.j = sd.j GROUP BY 1)
SELECT s_suppkey AS image_id, (coalesce((SELECT sum(cost) FROM cu WHERE cu.image_id = s_suppkey), 0) + (SELECT data FROM da WHERE da.image_id = s_suppkey))::BIGINT AS energy FROM supplier""")
def q_energy(spark, d):
    return G.starting_energy(*X.shipments(spark, d), 10, fill=X.NONE)


# -- prefix sums -----------------------------------------------------------------------------------


@query("integral_labels", f"WITH {X.F2}, {X.F5}, {_INT} SELECT * FROM it")
def q_int(spark, d):
    return R.integral_labels(X.masks(spark, d), 4)


def _prefix_sql(cells: str) -> str:
    return f"""WITH {X.F2}, {X.F5}, pm AS ({cells}),
pr AS (SELECT image_id, mask, i, j, sum(x) OVER (PARTITION BY image_id, mask, i ORDER BY j) AS x FROM pm),
pc AS (SELECT image_id, mask, i + 1 AS i, j + 1 AS j, (sum(x) OVER (PARTITION BY image_id, mask, j ORDER BY i))::DOUBLE AS s FROM pr),
it AS (SELECT * FROM pc UNION ALL SELECT image_id, mask, i, 0, 0 FROM pc WHERE j = 1 UNION ALL SELECT image_id, mask, 0, j, 0 FROM pc WHERE i = 1
 UNION ALL SELECT image_id, mask, 0, 0, 0 FROM pc WHERE i = 1 AND j = 1)
SELECT image_id, mask, i, j, round(s, 6) AS s FROM it"""


@query("integral_labels_probs", _prefix_sql("SELECT image_id, m::INT AS mask, i, j, CASE WHEN cls = m THEN (i + 1) / 8 ELSE 0 END AS x FROM f5, range(4) a(m)"))
def q_int_probs(spark, d):
    return R.integral_labels_probs(X.masks(spark, d).withColumn("prob", (F.col("i") + 1) / 8), 4).withColumn("s", r6("s"))


@query("integral_all_probs", _prefix_sql("SELECT image_id, m::INT AS mask, i, j, CASE WHEN cls = m THEN 0.625::DOUBLE ELSE 0.125::DOUBLE END AS x FROM f5, range(4) a(m)"))
def q_int_all(spark, d):
    probs = X.masks(spark, d).select("image_id", "i", "j", F.array(*[F.when(F.col("cls") == k, 0.625).otherwise(0.125) for k in range(4)]).alias("probs"))
    return R.integral_all_probs(probs).withColumn("s", r6("s"))


@query("integral_spatial", _prefix_sql("""SELECT image_id, m::INT AS mask, i, j, CASE WHEN (i + j) % 3 = m THEN 1.0::DOUBLE ELSE 0 END AS x FROM f5, range(3) a(m)
 UNION ALL SELECT image_id, m::INT + 3, i, j, CASE WHEN cls = m THEN 0.625::DOUBLE ELSE 0.125::DOUBLE END FROM f5, range(4) a(m)"""))
def q_int_spatial(spark, d):
    scored = X.masks(spark, d).select(
        "image_id", "i", "j", ((F.col("i") + F.col("j")) % 3).alias("leaf_id"), F.array(*[F.when(F.col("cls") == k, 0.625).otherwise(0.125) for k in range(4)]).alias("probs")
    )
    return R.integral_spatial(scored, 3).withColumn("s", r6("s"))


@query("gradient_magnitude", f"""WITH {X.F4} SELECT image_id, i, j, round(coalesce(sqrt(pow((lead(v) OVER rw - lag(v) OVER rw) / 2, 2) + pow((lead(v) OVER cw - lag(v) OVER cw) / 2, 2)), 0), 6) AS grad
FROM f4 WINDOW rw AS (PARTITION BY image_id, i ORDER BY j), cw AS (PARTITION BY image_id, j ORDER BY i)""")
def q_grad(spark, d):
    return P.gradient_magnitude(X.gray(spark, d)[0]).select("image_id", "i", "j", r6("grad").alias("grad"))


# -- order -----------------------------------------------------------------------------------------


@query("best_split", f"WITH {GAIN} SELECT round(gain, 6) AS gain, feat_ind FROM gain ORDER BY gain.gain DESC, feat_ind LIMIT 1")
def q_best(spark, d):
    return H.best_split(gains(spark, d), T.KEYS).select(r6("gain").alias("gain"), "feat_ind")


@query("select_feature", f"WITH {GAIN}, b AS (SELECT gain, feat_ind FROM gain ORDER BY gain DESC, feat_ind LIMIT 1) SELECT feat_ind, feat, dim, (feat_ind % 5)::INT AS thresh, t FROM b JOIN c USING (feat_ind)")
def q_selected(spark, d):
    dims = F.array(*[F.lit(p["dim"]) for p in CANDS.params])
    best = H.best_split(gains(spark, d), T.KEYS).join(CANDS.frame(spark), "feat_ind")
    return best.select("feat_ind", "feat", F.get(dims, F.col("feat")).alias("dim"), (F.col("feat_ind") % 5).cast("int").alias("thresh"), "t")


@query("rank_classes", f"WITH {FORESTED} SELECT row_id, label::INT AS label, round(prob, 6) AS prob, row_number() OVER (PARTITION BY row_id ORDER BY round(prob, 12) DESC, label DESC)::INT AS rank FROM pf")
def q_rank(spark, d):
    probs = forested(spark, d).withColumn("prob", F.round("prob", 12))
    return M.rank_classes(probs, ["row_id"]).withColumn("prob", r6("prob"))


@query("argmax_class", f"""WITH {FORESTED}, a AS (SELECT row_id, label, prob, row_number() OVER (PARTITION BY row_id ORDER BY round(prob, 12) DESC, label) AS r FROM pf)
SELECT row_id, label::INT AS label, round(prob, 6) AS prob FROM a WHERE r = 1""")
def q_argmax(spark, d):
    probs = forested(spark, d).withColumn("prob", F.round("prob", 12))
    return M.argmax_class(probs, ["row_id"]).withColumn("prob", r6("prob"))


def _moved_sql(patch: int, seeds: str = "sd", out: str = "mv") -> str:
    """Seeds moved to the least contrast in a window of patch // 4 - 1 pixels around them."""
    d = patch // 4 - 1
    return f"""{out}m AS (SELECT sd.image_id, seed, co.i, co.j, row_number() OVER (PARTITION BY sd.image_id, seed ORDER BY c, co.i, co.j) AS r FROM {seeds} sd JOIN co ON co.image_id = sd.image_id
 AND co.i BETWEEN greatest(1, sd.i - {d}) AND least(29, sd.i + {d}) AND co.j BETWEEN greatest(1, sd.j - {d}) AND least(48, sd.j + {d}) WHERE n = 8 AND c < 255 * {(2 * d + 1) ** 2}),
{out} AS MATERIALIZED (SELECT sd.image_id, sd.seed, coalesce(m.i, sd.i) AS i, coalesce(m.j, sd.j) AS j FROM {seeds} sd LEFT JOIN {out}m m ON m.image_id = sd.image_id AND m.seed = sd.seed AND r = 1)"""


_CONTRAST = "co AS MATERIALIZED (SELECT a.image_id, a.i, a.j, sum(abs(a.v - b.v)) AS c, count(*) AS n FROM f4 a JOIN f4 b ON a.image_id = b.image_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY ALL)"
_SEEDS_4 = "s4 AS (SELECT s_suppkey AS image_id, (r * 24 + c)::INT AS seed, (2 + 2 * r)::INT AS i, (2 + 2 * c)::INT AS j FROM supplier, range(15) a(r), range(24) b(c) WHERE 2 + 2 * r < 31 AND 2 + 2 * c < 50)"


@query("seed_refine", f"""WITH {X.F4}, {_SEEDS}, {_SEEDS_4}, {_CONTRAST}, {_moved_sql(10)}, {_moved_sql(4, 's4', 'm4')}
SELECT 10 AS patch, * FROM mv UNION ALL SELECT 4, * FROM m4""")
def q_refine_seeds(spark, d):
    """Seeds of patches of 10, and of 4, whose windows are one pixel or, at the last edges, empty."""
    raster, shown = X.gray(spark, d)
    moved = [G.seed_refine(G.place_seeds(shown, p), raster, shown, p).select(F.lit(p).alias("patch"), "*") for p in (10, 4)]
    return moved[0].unionByName(moved[1])


@query("append_tree", f"WITH {ROUTED} SELECT CASE WHEN m = 1 THEN 2 ELSE tree_id END AS tree_id, node_id::BIGINT AS node_id, count(*)::BIGINT AS n FROM l3, range(2) r(m) WHERE m = 0 OR tree_id = 0 GROUP BY ALL")
def q_append(spark, d):
    model = M.nodes_frame(spark, FOREST)
    grown = M.append_tree(model, model.where("tree_id = 0"))
    reached = M.route_to_node(X.embedded(spark, d), grown, F.get("features", F.col("dim")), 3)
    return reached.groupBy("tree_id", "node_id").agg(F.count("*").alias("n"))


# -- scalar functions ------------------------------------------------------------------------------


@query("vector_test", f"""WITH {CAND_SQL}, e AS (SELECT event_id, event_type, [value, (props->>'k')::DOUBLE, (event_id % 5)::DOUBLE] AS x FROM events)
SELECT event_id, feat_ind, (CASE WHEN kind = 2 THEN x[dim % 3 + 1] = t ELSE x[dim % 3 + 1] >= t END) AS passed FROM e, c""")
def q_test(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    events = X.table(spark, d, "events").select("event_id", F.array("value", k, (F.col("event_id") % 5).cast("double")).alias("x"))
    tests = [(CANDS.params[f]["dim"] % 3, kind, i, t) for f, kind, _, i, t in CANDS.rows()]
    each = F.array(*[F.struct(F.lit(i).alias("feat_ind"), S.vector_test(F.get("x", dim), F.lit(kind), F.lit(float(t))).alias("passed")) for dim, kind, i, t in tests])
    return events.select("event_id", F.explode(each).alias("e")).select("event_id", "e.*")


@query("texton_value", f"""WITH {X.F2}, p AS (SELECT image_id, i, j, max(CASE WHEN b = 0 THEN v END) AS a, max(CASE WHEN b = 5 THEN v END) AS c FROM f2 GROUP BY ALL)
SELECT image_id, i, j, k::INT AS kind, (CASE k WHEN 0 THEN a WHEN 1 THEN a + c WHEN 2 THEN a - c ELSE abs(a - c) END)::INT AS value FROM p, range(4) r(k)""")
def q_texton(spark, d):
    two = X.px(spark, d).groupBy("image_id", "i", "j").pivot("b", [0, 5]).agg(F.max("v"))
    rows = two.withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select("image_id", "i", "j", "kind", S.texton_value(F.col("kind"), F.col("0"), F.col("5")).alias("value"))


@query("integral_value", _box_sql(1))
def q_box(spark, d):
    tables = T.flat_tables(R.integral_labels(X.masks(spark, d), 4))
    e = S.box_edges(F.col("i"), F.col("j"), {k: F.lit(BOX[k]) for k in ("uy", "ux", "bh", "bw")}, F.lit(9), F.lit(9))
    at = X.points(spark, d).join(tables, "image_id")
    return at.select("image_id", "i", "j", R.integral_feature(F.lit(1), e, F.col("tables"), F.lit(9), 4, F.lit(1)).alias("value"))


@query("signed_confidence", "SELECT doc_id, (2 * quality - 1) * (0.5::DOUBLE + 0.25::DOUBLE * toxic) AS score FROM labels")
def q_signed(spark, d):
    return X.table(spark, d, "labels").select("doc_id", S.signed_confidence(2 * F.col("quality") - 1, 0.5 + 0.25 * F.col("toxic")).alias("score"))


@query("hamming_distance", "SELECT p_partkey, bit_count(xor(p_partkey % 256, p_size::BIGINT))::INT AS distance FROM part")
def q_hamming(spark, d):
    return X.table(spark, d, "part").select("p_partkey", S.hamming_distance(F.col("p_partkey") % 256, F.col("p_size").cast("long")).alias("distance"))


@query("sq_l2_dist", "SELECT vec_id, round(sum(pow(embedding[k]::DOUBLE - embedding[k + 3]::DOUBLE, 2)), 6) AS distance FROM embeddings, range(1, 4) r(k) GROUP BY 1")
def q_l2(spark, d):
    e = X.embedded(spark, d)
    return e.select(F.col("row_id").alias("vec_id"), r6(S.sq_l2_dist(F.slice("features", 1, 3), F.slice("features", 4, 3))).alias("distance"))


@query("encode_region", "SELECT o_orderkey, (o_orderkey % 256)::INT AS b0, (o_orderkey // 256 % 256)::INT AS b1, (o_orderkey // 65536 % 256)::INT AS b2 FROM orders")
def q_encode(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", *[c.alias(f"b{k}") for k, c in enumerate(S.encode_region(F.col("o_orderkey")))])


@query("decode_region", "SELECT o_orderkey, (o_orderkey % 16777216)::BIGINT AS region FROM orders")
def q_decode(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", S.decode_region(*S.encode_region(F.col("o_orderkey"))).cast("long").alias("region"))


@query("region_colors", f"""WITH {X.F2}, {X.F5}, h AS (SELECT image_id, i, j, (cls::BIGINT * 1103515245 + 12345) % 2147483648 AS h FROM f5)
SELECT image_id, i, j, (h // 256 % 256)::INT AS r, (h // 4096 % 256)::INT AS g, (h // 65536 % 256)::INT AS b FROM h""")
def q_colors(spark, d):
    return G.region_colors(X.masks(spark, d).withColumnRenamed("cls", "region"))


def _four(p: str) -> str:
    """%.4g of a share, in SQL."""
    power = f"pow(10.0::DOUBLE, 3 - floor(log10({p})))"
    return f"regexp_replace(regexp_replace(printf('%.8f', round_even({p} * {power}, 0) / {power}), '0+$', ''), '\\.$', '')"


@query("tree_to_dot", f"""WITH {X.F1}, cc AS (SELECT image_id % 4 AS tree_id, label, count(*) AS n FROM f1 GROUP BY ALL),
p AS (SELECT tree_id, label, n / sum(n) OVER (PARTITION BY tree_id) AS p FROM cc),
lb AS (SELECT tree_id, string_agg(label || ':' || {_four('p')}, ' ' ORDER BY p DESC, label) AS s FROM p GROUP BY 1)
SELECT tree_id::INT AS tree_id, 'digraph{{0[label="I[0.500000]P[2.5 <= x[3]]"];1[label="I[0.250000]P[1.0 == x[5]]"];2[label="' || s || '"];3[label="' || s || '"];4[label="' || s
 || '"];0->1[color=red];1->2[color=red];1->3[color=green];0->4[color=green]}}' AS dot FROM lb""")
def q_dot(spark, d):
    """Trees of two splits whose leaves hold the class shares of a quarter of the line items."""
    quarter = X.vectors(spark, d).withColumn("tree_id", (F.col("image_id") % 4).cast("int"))
    shares = H.leaf_probability(quarter, ["tree_id"], "label", F.lit(1))
    probs = shares.groupBy("tree_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "prob"))), lambda x: x["prob"]).alias("probs"))
    shape = spark.createDataFrame([(0, False, 3, 0, 2.5, 0.5), (1, False, 5, 2, 1.0, 0.25), (2, True, None, None, None, None), (3, True, None, None, None, None), (4, True, None, None, None, None)],
        "node_id long, is_leaf boolean, dim int, kind int, t double, info_gain double")
    return M.tree_to_dot(probs.join(F.broadcast(shape)))  # five rows


# -- training and scoring --------------------------------------------------------------------------


@query("gen_vector_candidates", f"""WITH {X.F1}, {FX}, {CAND_SQL} SELECT feat_ind, dim, t, sum((x[dim + 1] >= t)::INT)::BIGINT AS above FROM f1x, c GROUP BY ALL""")
def q_gen(spark, d):
    """How many line items lie at or above each candidate."""
    rows = [(r[3], CANDS.params[r[0]]["dim"], r[4]) for r in CANDS.rows()]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feat_ind"), F.lit(dim).alias("dim"), F.lit(t).alias("t"), (F.get("features", dim) >= t).cast("long").alias("x")) for i, dim, t in rows]))
    return X.vectors(spark, d).select(each.alias("e")).select("e.*").groupBy("feat_ind", "dim", "t").agg(F.sum("x").alias("above"))


TEXTONS = T.TextonFamily(3)
TCANDS = TEXTONS.candidates(4, 3, 7)


def _counts_sql(with_: str, values: list[str], cands) -> str:
    """Split histograms of candidates; values: for each feature what its values are selected from, as label and v."""
    rows = values_sql(cands.rows(), "feat, kind, rnk, feat_ind, t")
    each = " UNION ALL ".join(f"SELECT {f} AS feat, label, v::DOUBLE AS v FROM ({v})" for f, v in enumerate(values))
    return f"""WITH {with_}, tv AS ({each})
SELECT feat_ind, label, sum((tv.v < c.t)::INT)::BIGINT AS ql, sum((tv.v >= c.t)::INT)::BIGINT AS qr FROM tv JOIN (SELECT * FROM {rows}) c USING (feat) GROUP BY ALL"""


def _counted(samples: DataFrame, family, cands) -> DataFrame:
    rows = family.attach(samples, cands).select(F.lit(0).alias("tree_id"), F.lit(0).cast("long").alias("node_id"), "label", "values")
    bins = H.bin_counts_batched(rows, dict(enumerate(cands.thresholds)), cands.kinds(), T.KEYS)
    return H.split_histograms(bins, cands.frame(samples.sparkSession), T.KEYS).select("feat_ind", "label", "ql", "qr")


@query("gen_texton_candidates", _counts_sql(f"{X.F2}, {X.F6}, {PIX}", [f"SELECT label, {texton_sql(p)} AS v FROM f6 JOIN im USING (image_id)" for p in TCANDS.params], TCANDS))
def q_gen_texton(spark, d):
    """Split histograms of generated texton candidates over the labelled points."""
    return _counted(T.with_points(X.images(spark, d), X.points(spark, d)), TEXTONS, TCANDS)


BOX_FAMILY = T.IntegralFamily(4, ilp_dims=1, ilp_prob=0.25, distance=3, radii=(1, 3))
BCANDS = BOX_FAMILY.candidates(6, 3, 11)


#: Points with their image's table and score.
_BOXED = f"""{X.F2}, {X.F5}, {X.F6}, {_INT}, {TABS}, bp AS MATERIALIZED (SELECT f6.image_id, f6.label, i, j, tab, e.label / 10.0::DOUBLE AS score
 FROM f6 JOIN tb USING (image_id) JOIN embeddings e ON e.vec_id = f6.image_id)"""


@query("gen_integral_candidates", _counts_sql(
    _BOXED, [f"SELECT label, {box_sql(p)} AS v FROM {edges_sql('bp', p)}" if p["pattern"] >= 0 else "SELECT label, trunc(score * 2147483646) AS v FROM bp" for p in BCANDS.params], BCANDS))
def q_gen_box(spark, d):
    """Split histograms of generated box and image-score candidates over the labelled points."""
    tables = T.flat_tables(R.integral_labels(X.masks(spark, d), 4))
    return _counted(T.with_tables(X.points(spark, d), X.images(spark, d), tables, preds(spark, d)), BOX_FAMILY, BCANDS)


@query("train_level", f"WITH {GAIN}, b AS (SELECT gain, feat_ind FROM gain ORDER BY gain DESC, feat_ind LIMIT 1) SELECT round(b.gain, 6) AS gain, feat_ind, label, ql, qr FROM b JOIN hist USING (feat_ind)")
def q_level(spark, d):
    best, counts = T.train_level(valued(spark, d), CANDS)
    return best.join(counts, [*T.KEYS, "feat_ind"]).select(r6("gain").alias("gain"), "feat_ind", "label", "ql", "qr")


def _model(spark, rows):
    return by_class(M.nodes_frame(spark, rows))


@query("train_forest", trained_sql(20, 10, 4))
def q_train(spark, d):
    return _model(spark, T.train_forest(X.vectors(spark, d), VECTORS, 3, max_levels=4, num_feat=20, num_thresh=10)[0])


@query("train_forest_strict", trained_sql(20, 10, 3, min_info=0.00002, strict=True))
def q_strict(spark, d):
    return _model(spark, T.train_forest(X.vectors(spark, d), VECTORS, 3, max_levels=3, num_feat=20, num_thresh=10, min_info=0.00002, strict=True)[0])


@query("train_many", trained_sql(10, 5, 2, trees=3))
def q_many(spark, d):
    return _model(spark, T.train_forest(X.vectors(spark, d), VECTORS, 3, max_levels=2, num_feat=10, num_thresh=5, num_trees=3)[0])


@query("predict_leaf", f"WITH {ROUTED} SELECT row_id, tree_id, leaf_id, round(list_max(probs), 6) AS prob, (list_position(probs, list_max(probs)) - 1)::INT AS label FROM l3 JOIN nd USING (tree_id, node_id)")
def q_leaf(spark, d):
    top = F.array_max("probs")
    found = M.predict_leaf(routed(spark, d), M.nodes_frame(spark, FOREST))
    return found.select("row_id", "tree_id", "leaf_id", r6(top).alias("prob"), (F.array_position("probs", top) - 1).cast("int").alias("label"))


@query("predict_forest", f"WITH {FORESTED} SELECT row_id, label::INT AS label, round(prob, 6) AS prob FROM pf")
def q_forest(spark, d):
    return forested(spark, d).withColumn("prob", r6("prob"))


#: Two hand-made trees over the texton candidates, four classes each.
_FOUR = lambda hot: [0.7 if k == hot else 0.1 for k in range(4)]
PIXEL_TREES = [
    [(0, 0, 0, TCANDS.thresholds[0][1], 0.5), (1, 1, 0, TCANDS.thresholds[1][1], 0.25), (3, _FOUR(0)), (4, _FOUR(1)), (2, 2, 0, TCANDS.thresholds[2][1], 0.25), (5, _FOUR(2)), (6, _FOUR(3))],
    [(0, 3, 0, TCANDS.thresholds[3][1], 0.5), (1, [0.25, 0.25, 0.4, 0.1]), (2, 0, 0, 130.0, 0.25), (5, _FOUR(1)), (6, [0.0, 0.5, 0.0, 0.5])],
]
PIXEL_FOREST = M.node_rows(PIXEL_TREES, "texton", TCANDS.params)


def _walk_sql(tree: list[tuple], leaf, n: int = 0) -> str:
    node = next(x for x in tree if x[0] == n)
    if len(node) == 2:
        return leaf(node)
    return f"(CASE WHEN {texton_sql(TCANDS.params[node[1]])} >= {node[3]!r} THEN {_walk_sql(tree, leaf, 2 * n + 2)} ELSE {_walk_sql(tree, leaf, 2 * n + 1)} END)"


_LEAF = {n[1]: n[8] for n in PIXEL_FOREST if n[0] == 0 and n[2]}
_PROBS = lambda node: "[" + ", ".join(f"{p!r}::DOUBLE" for p in node[1]) + "]"
DENSE = f"""{PIX}, de AS MATERIALIZED (SELECT image_id, i::INT AS i, j::INT AS j, {_walk_sql(PIXEL_TREES[0], lambda n: str(_LEAF[n[0]]))} AS leaf_id,
 {_walk_sql(PIXEL_TREES[0], _PROBS)} AS p0, {_walk_sql(PIXEL_TREES[1], _PROBS)} AS p1 FROM im, range(8) a(i), range(8) b(j)),
dp AS (SELECT image_id, i, j, leaf_id, k::INT AS label, (p0[k + 1] + p1[k + 1]) / 2 AS prob FROM de, range(4) r(k))"""


@query("predict_image_dense", f"WITH {DENSE} SELECT image_id, i, j, leaf_id::INT AS leaf_id, label, round(prob, 6) AS prob FROM dp")
def q_dense(spark, d):
    pixels = T.argmax_rows(T.predict_image_dense(X.images(spark, d), PIXEL_FOREST), 4)
    return pixels.select("image_id", "i", "j", "leaf_id", F.posexplode("probs").alias("label", "prob")).withColumn("prob", r6("prob"))


_IT = """pr AS MATERIALIZED (SELECT * EXCLUDE (x), sum(x) OVER (PARTITION BY {keys}, image_id, mask, i ORDER BY j) AS x FROM ce),
pc AS MATERIALIZED (SELECT * EXCLUDE (x, i, j), i + 1 AS i, j + 1 AS j, (sum(x) OVER (PARTITION BY {keys}, image_id, mask, j ORDER BY i))::DOUBLE AS s FROM pr),
it AS MATERIALIZED (SELECT * FROM pc UNION ALL SELECT * REPLACE (0 AS j, 0 AS s) FROM pc WHERE j = 1 UNION ALL SELECT * REPLACE (0 AS i, 0 AS s) FROM pc WHERE i = 1
 UNION ALL SELECT * REPLACE (0 AS i, 0 AS j, 0 AS s) FROM pc WHERE i = 1 AND j = 1)"""


@query("to_integral_records", f"""WITH {X.F2}, {X.F6}, {DENSE},
be AS (SELECT image_id, i, j, label AS cls, prob FROM (SELECT *, row_number() OVER (PARTITION BY image_id, i, j ORDER BY prob DESC, label) AS r FROM dp) WHERE r = 1),
ce AS (SELECT 'argmax' AS kind, image_id, i, j, m::INT AS mask, (cls = m)::INT::DOUBLE AS x FROM be, range(4) r(m)
 UNION ALL SELECT 'argmax_prob', image_id, i, j, m::INT, CASE WHEN cls = m THEN prob ELSE 0 END FROM be, range(4) r(m)
 UNION ALL SELECT 'all_prob', image_id, i, j, label, prob FROM dp
 UNION ALL SELECT 'spatial', image_id, i, j, m::INT, (leaf_id = m)::INT::DOUBLE FROM de, range({len(_LEAF)}) r(m)
 UNION ALL SELECT 'spatial', image_id, i, j, label + {len(_LEAF)}, prob FROM dp),
{_IT.format(keys="kind")},
pt AS (SELECT image_id, string_agg(label || ':' || i || ':' || j, ',' ORDER BY label, i, j) AS points FROM f6 GROUP BY 1),
ro AS (SELECT kind, image_id, mask, i, string_agg(round(s * 1000000)::BIGINT::VARCHAR, ',' ORDER BY j) AS sums FROM it GROUP BY ALL)
SELECT kind, image_id, mask::INT AS mask, i::INT AS i, sums, coalesce(points, '') AS points FROM ro LEFT JOIN pt USING (image_id)""")
def q_records(spark, d):
    """Records of all four types: every row of every mask's table, in millionths, and the points of its image."""
    out = None
    for kind in T.KINDS:
        one = T.to_integral_records(X.images(spark, d), X.points(spark, d), PIXEL_FOREST, kind)
        points = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["label"], p["i"], p["j"])), ",").alias("points")
        masks = one.select(F.lit(kind).alias("kind"), "image_id", points, "width", "masks", "tables", F.explode(F.sequence(F.lit(0), F.col("masks") - 1)).alias("mask"), "height")
        lines = masks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("height"))))
        cell = lambda j: F.round(F.get("tables", (F.col("i") * (F.col("width") + 1) + j) * F.col("masks") + F.col("mask")) * 1e6).cast("long").cast("string")
        sums = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width")), cell), ",").alias("sums")
        rows = lines.select("kind", "image_id", "mask", "i", sums, "points")
        out = rows if out is None else out.unionByName(rows)
    return out


def preds(spark: SparkSession, d: str) -> DataFrame:
    return X.scores(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list("score")).alias("preds"))


def boxes_sql(source: str, cands, masks: int, keys: str) -> str:
    """Rows (keys, x): the values of all box and score features at the points of `source` (with tab and score)."""
    each = " UNION ALL ".join(
        f"SELECT {keys}, {f} AS feat, {box_sql(p, masks)}::DOUBLE AS v FROM {edges_sql(source, p)}" if p["pattern"] >= 0 else f"SELECT {keys}, {f}, trunc(score * 2147483646)::DOUBLE FROM {source}"
        for f, p in enumerate(cands.params)
    )
    return f"(SELECT {keys}, list(v ORDER BY feat) AS x FROM ({each}) GROUP BY {keys})"


#: Two trees of box features of the sums that PIXEL_FOREST gives (four leaves, four classes), and of image scores.
BIG = 2147483646.0
SECOND = [{"pattern": 2, "mask": 5, "bh": 2, "bw": 3, "uy": 1, "ux": 0}, {"pattern": -1, "ilp_dim": 0}, {"pattern": 4, "mask": 1, "bh": 1, "bw": 2, "uy": -2, "ux": 3}, {"pattern": 0, "mask": 6, "bh": 3, "bw": 1, "uy": 0, "ux": -2}]
SECOND_TREES = [
    [(0, 1, 0, BIG * 0.45, 0.5), (1, 0, 0, 0.01 * BIG, 0.25), (3, _FOUR(0)), (4, _FOUR(1)), (2, 2, 0, 0.1 * BIG, 0.25), (5, _FOUR(2)), (6, _FOUR(3))],
    [(0, 3, 0, 0.2 * BIG, 0.5), (1, 1, 2, float(int(0.3 * BIG)), 0.25), (3, [0.4, 0.3, 0.2, 0.1]), (4, _FOUR(2)), (2, [0.1, 0.2, 0.3, 0.4])],
]
SECOND_FOREST = M.node_rows(SECOND_TREES, "integral", SECOND)
_SPATIAL = f"""ce AS (SELECT image_id, i, j, m::INT AS mask, (leaf_id = m)::INT::DOUBLE AS x FROM de, range(4) r(m) UNION ALL SELECT image_id, i, j, label + 4, prob FROM dp),
{_IT.format(keys="1")}, ta AS MATERIALIZED (SELECT image_id, list(s ORDER BY i, j, mask) AS tab FROM it GROUP BY 1)"""


def _x_walk_sql(tree: list[tuple], leaf, n: int = 0) -> str:
    node = next(v for v in tree if v[0] == n)
    if len(node) == 2:
        return leaf(node)
    return f"(CASE WHEN x[{node[1] + 1}] {'=' if node[2] == 2 else '>='} {node[3]!r}::DOUBLE THEN {_x_walk_sql(tree, leaf, 2 * n + 2)} ELSE {_x_walk_sql(tree, leaf, 2 * n + 1)} END)"


@query("predict_second_stage", f"""WITH {DENSE}, {_SPATIAL},
pp AS MATERIALIZED (SELECT image_id, i::INT AS i, j::INT AS j, tab, label / 10.0::DOUBLE AS score FROM ta JOIN embeddings ON vec_id = image_id, range(8) a(i), range(8) b(j)),
xx AS MATERIALIZED {boxes_sql("pp", T.Candidates(SECOND, []), 8, "image_id, i, j")},
sc AS (SELECT image_id, i, j, {_x_walk_sql(SECOND_TREES[0], lambda n: str({r[1]: r[8] for r in SECOND_FOREST if r[0] == 0 and r[2]}[n[0]]))} AS leaf_id,
 {_x_walk_sql(SECOND_TREES[0], _PROBS)} AS p0, {_x_walk_sql(SECOND_TREES[1], _PROBS)} AS p1 FROM xx)
SELECT image_id, i, j, leaf_id::INT AS leaf_id, k::INT AS label, round((p0[k + 1] + p1[k + 1]) / 2, 6) AS prob FROM sc, range(4) r(k)""")
def q_second(spark, d):
    """Every pixel of every image in a stored forest of boxes, image scores and a categorical split, over the sums of a first forest."""
    path = IO.scratch(spark)
    IO.save_model(spark, SECOND_FOREST, path)
    records = T.to_integral_records(X.images(spark, d), X.points(spark, d), PIXEL_FOREST, "spatial", preds(spark, d))
    pixels = T.argmax_rows(T.predict_image_dense(records, IO.load_model(spark, path)), 4)
    return pixels.select("image_id", "i", "j", "leaf_id", F.posexplode("probs").alias("label", "prob")).withColumn("prob", r6("prob"))


def _two_sql() -> str:
    """Both stages in SQL: a texton tree of two levels, the sums of its four leaves and ten classes, and two trees of boxes and scores."""
    first = TEXTONS.candidates(12, 6, 1234)
    second = T.IntegralFamily(14, ilp_dims=1, ilp_prob=0.25, distance=3, radii=(1, 3)).candidates(16, 6, 1235)
    texture = "[" + ", ".join(f"{texton_sql(p)}::DOUBLE" for p in first.params) + "]"
    return f"""WITH {X.F2}, {X.F6}, {PIX},
fs AS MATERIALIZED (SELECT label, {texture} AS x, image_id FROM f6 JOIN im USING (image_id)), {grown_sql('fs', first, 12, 2, classes=10, p='a')},
px AS (SELECT image_id, i::INT AS i, j::INT AS j, {texture} AS x FROM im, range(8) a(i), range(8) b(j)), {reached_sql('px', 2, 'a')},
ce AS (SELECT image_id, i, j, m::INT AS mask, (leaf_id = m)::INT::DOUBLE AS x FROM alf JOIN aln USING (tree_id, node_id), range(4) r(m)
 UNION ALL SELECT image_id, i, j, alp.label + 4, prob FROM alf JOIN alp USING (tree_id, node_id)),
{_IT.format(keys="1")}, ta AS MATERIALIZED (SELECT image_id, list(s ORDER BY i, j, mask) AS tab FROM it GROUP BY 1),
pp AS MATERIALIZED (SELECT f6.image_id, f6.label, i, j, tab, e.label / 10.0::DOUBLE AS score FROM f6 JOIN ta USING (image_id) JOIN embeddings e ON e.vec_id = f6.image_id),
ss AS MATERIALIZED {boxes_sql("pp", second, 14, "image_id, label, i, j")}, {grown_sql('ss', second, 8, 3, 2, classes=10, p='b')}
SELECT 1 AS stage, * FROM amodel UNION ALL SELECT 2, * FROM bmodel"""


@query("train_two_stage", _two_sql())
def q_two(spark, d):
    """A texton tree and two box trees, which may ask for image scores; the second stage's best splits are such."""
    first, second = T.train_two_stage(
        X.images(spark, d), X.points(spark, d), 10, trees=2, texton={"max_levels": 2, "num_feat": 12, "num_thresh": 6}, integral={"max_levels": 3, "num_feat": 8, "num_thresh": 6}, scores=preds(spark, d)
    )
    return _model(spark, first).withColumn("stage", F.lit(1)).unionByName(_model(spark, second).withColumn("stage", F.lit(2)))


class PriceRatio(T.FeatureFamily):
    """A family of one's own: price over quantity against thresholds."""

    def candidates(self, num_feat, num_thresh, seed):
        return T.Candidates([{"power": k + 1} for k in range(num_feat)], [[900.0 + 100.0 * (k + 1) for k in range(num_thresh)] for _ in range(num_feat)])

    def value(self, params):
        return F.get("features", 1) / F.pow(F.get("features", 0), F.lit(float(params["power"])))


@query("custom_feature_family", f"""WITH {X.F1}, p AS (SELECT p, k, p * 4 + k AS feat_ind, 900.0::DOUBLE + 100 * (k + 1) AS t FROM range(2) a(p), range(4) b(k))
SELECT feat_ind::INT AS feat_ind, label, sum((x1 / pow(x0, p + 1) < t)::INT)::BIGINT AS ql, sum((x1 / pow(x0, p + 1) >= t)::INT)::BIGINT AS qr FROM f1, p GROUP BY ALL""")
def q_custom(spark, d):
    family = PriceRatio()
    return _counted(X.vectors(spark, d), family, family.candidates(2, 4, 0))


# -- superpixels -----------------------------------------------------------------------------------


@query("place_seeds", f"WITH {_SEEDS} SELECT * FROM sd")
def q_seeds(spark, d):
    return G.place_seeds(X.gray(spark, d)[1], 10)


@query("initial_labels", f"WITH {X.F4}, {_SEEDS}, {_START} SELECT image_id, i, j, region FROM il")
def q_initial(spark, d):
    return _regions(spark, d)[2]


def _swept_sql(kind: int, sweeps: int = 2, patch: int = 10) -> str:
    """The whole chain: moved seeds, their boxes, and pixels that change region in turns of four colours."""
    unlike = "coalesce(least(abs(c.v - s.v), 15), 0)" if kind == 1 else "0"
    out = [X.F4.replace("f4 AS", "f4 AS MATERIALIZED"), _VARIATION, _EDGES, _weights_sql(kind), _SEEDS, _CONTRAST, _moved_sql(patch)]
    out.append(f"""sv AS MATERIALIZED (SELECT mv.*, f4.v FROM mv JOIN f4 USING (image_id, i, j)),
pw AS MATERIALIZED (SELECT e.image_id, e.i, e.j, e.i + di AS ni, e.j + dj AS nj, CASE WHEN dir IN ('left', 'up') THEN w ELSE floor(w / sqrt(2.0::DOUBLE))::INT END AS w FROM ew e JOIN dr USING (dir)),
nw AS MATERIALIZED (SELECT * FROM pw UNION ALL SELECT image_id, ni, nj, i, j, w FROM pw),
t0 AS MATERIALIZED (SELECT f4.image_id, f4.i, f4.j, f4.v, coalesce(max(seed), 0)::INT AS region FROM f4 LEFT JOIN mv ON mv.image_id = f4.image_id AND abs(f4.i - mv.i) <= {patch // 2 + 1} AND abs(f4.j - mv.j) <= {patch // 2 + 1} GROUP BY ALL)""")
    for k in range(4 * sweeps):
        out.append(f"""n{k} AS MATERIALIZED (SELECT a.image_id, a.i, a.j, a.v, a.region, b.region AS other, w FROM t{k} a JOIN nw ON nw.image_id = a.image_id AND nw.i = a.i AND nw.j = a.j
  JOIN t{k} b ON b.image_id = a.image_id AND b.i = nw.ni AND b.j = nw.nj WHERE a.i % 2 = {k // 2 % 2} AND a.j % 2 = {k % 2}),
c{k} AS (SELECT DISTINCT image_id, i, j, v, region, other AS cand FROM n{k} UNION SELECT DISTINCT image_id, i, j, v, region, region FROM n{k}),
p{k} AS (SELECT c.image_id, c.i, c.j, c.cand, row_number() OVER (PARTITION BY c.image_id, c.i, c.j ORDER BY x.cost + {unlike}, c.cand <> c.region, c.cand) AS r
  FROM c{k} c LEFT JOIN sv s ON s.image_id = c.image_id AND s.seed = c.cand
  JOIN (SELECT c.image_id, c.i, c.j, c.cand, sum(CASE WHEN n.other <> c.cand THEN n.w ELSE 0 END) AS cost FROM c{k} c JOIN n{k} n USING (image_id, i, j) GROUP BY ALL) x
    ON x.image_id = c.image_id AND x.i = c.i AND x.j = c.j AND x.cand = c.cand
  WHERE c.cand = c.region OR (abs(c.i - s.i) <= {patch} AND abs(c.j - s.j) <= {patch})),
t{k + 1} AS MATERIALIZED (SELECT t.image_id, t.i, t.j, t.v, coalesce(p.cand, t.region) AS region FROM t{k} t LEFT JOIN p{k} p ON p.image_id = t.image_id AND p.i = t.i AND p.j = t.j AND r = 1)""")
    return "WITH " + ",\n".join(out) + f"\nSELECT image_id, i, j, region FROM t{4 * sweeps}"


@query("superpixel_refine", _swept_sql(0))
def q_refine(spark, d):
    return G.superpixels(*X.shipments(spark, d), 10, fill=X.NONE)


@query("superpixel_constant", _swept_sql(1))
def q_constant(spark, d):
    """Superpixels that keep to the shade of their seeds."""
    return G.superpixels(*X.shipments(spark, d), 10, kind=1, fill=X.NONE)


def _contours_sql() -> str:
    """Sides of pixels at borders, each with the one that follows; loops and places in them by doubling steps."""
    ends = "(CASE s WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END)", "(CASE s WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END)"
    on = "(CASE s WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END)", "(CASE s WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END)"
    code = lambda i, j, s: f"(({i}) * 8 + ({j})) * 4 + ({s})"
    out = [f"""{X.F2}, {X.F5}, g AS MATERIALIZED (SELECT image_id, i, j, cls AS region FROM f5),
si AS (SELECT g.*, s::INT AS s, {ends[0]} AS ui, {ends[1]} AS uj, {on[0]} AS di, {on[1]} AS dj FROM g, range(4) r(s)),
ed AS MATERIALIZED (SELECT si.*, {code('si.i', 'si.j', 's')} AS e FROM si LEFT JOIN g o ON o.image_id = si.image_id AND o.i = si.i + ui AND o.j = si.j + uj WHERE o.region IS NULL OR o.region <> si.region),
nx AS MATERIALIZED (SELECT ed.image_id, e, CASE WHEN b.region = ed.region THEN {code('ed.i + di + ui', 'ed.j + dj + uj', '(s + 3) % 4')} WHEN a.region = ed.region THEN {code('ed.i + di', 'ed.j + dj', 's')} ELSE {code('ed.i', 'ed.j', '(s + 1) % 4')} END AS f
 FROM ed LEFT JOIN g b ON b.image_id = ed.image_id AND b.i = ed.i + di + ui AND b.j = ed.j + dj + uj LEFT JOIN g a ON a.image_id = ed.image_id AND a.i = ed.i + di AND a.j = ed.j + dj),
m0 AS MATERIALIZED (SELECT image_id, e, f, e AS least FROM nx)"""]
    rounds = 8  # 256 sides, all that 64 pixels have
    for k in range(rounds):
        out.append(f"m{k + 1} AS MATERIALIZED (SELECT a.image_id, a.e, b.f, least(a.least, b.least) AS least FROM m{k} a JOIN m{k} b ON b.image_id = a.image_id AND b.e = a.f)")
    # steps on to the loop's first side, which follows none here
    out.append(f"d0 AS MATERIALIZED (SELECT nx.image_id, nx.e, CASE WHEN nx.f = least THEN NULL ELSE nx.f END AS f, (nx.f <> least)::INT AS n FROM nx JOIN m{rounds} m ON m.image_id = nx.image_id AND m.e = nx.e)")
    for k in range(rounds):
        out.append(f"d{k + 1} AS MATERIALIZED (SELECT a.image_id, a.e, b.f, a.n + coalesce(b.n, 0) AS n FROM d{k} a LEFT JOIN d{k} b ON b.image_id = a.image_id AND b.e = a.f)")
    out.append(f"""pl AS (SELECT ed.image_id, region, least, i, j, d.n, (CASE s WHEN 1 THEN j + 1 WHEN 3 THEN -j ELSE 0 END) AS area, lag(i * 8 + j) OVER w AS before, first_value(i * 8 + j) OVER w AS top, count(*) OVER q AS many,
  row_number() OVER w AS k, i * 8 + j AS spot FROM ed JOIN m{rounds} m USING (image_id, e) JOIN d{rounds} d USING (image_id, e) WINDOW w AS (PARTITION BY ed.image_id, least ORDER BY d.n DESC), q AS (PARTITION BY ed.image_id, least)),
ar AS (SELECT image_id, least, sum(area) AS area FROM pl GROUP BY ALL),
ke AS (SELECT *, max(k) OVER (PARTITION BY image_id, least) AS last, count(*) OVER (PARTITION BY image_id, least) AS points FROM pl WHERE before IS NULL OR before <> spot),
pa AS (SELECT image_id, region, least, string_agg(j || ':' || i, ',' ORDER BY n DESC) AS path FROM ke WHERE NOT (k = last AND spot = top AND points > 1) GROUP BY ALL)
SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY least) - 1)::INT AS contour, region, area < 0 AS hole, path FROM pa JOIN ar USING (image_id, least)""")
    return "WITH " + ",\n".join(out)


@query("region_contours", _contours_sql())
def q_contours(spark, d):
    found = G.region_contours(X.masks(spark, d).withColumnRenamed("cls", "region"))
    path = F.array_join(F.transform("points", lambda p: F.concat_ws(":", F.get(p, 0), F.get(p, 1))), ",")
    return found.select("image_id", "contour", "region", "hole", path.alias("path"))


@query("region_boundaries", f"""WITH {X.F2}, {X.F5} SELECT DISTINCT a.image_id, a.i, a.j, a.cls AS region FROM f5 a JOIN f5 b ON a.image_id = b.image_id
AND abs(a.i - b.i) + abs(a.j - b.j) = 1 AND a.cls <> b.cls""")
def q_bounds(spark, d):
    return G.region_boundaries(X.masks(spark, d).withColumnRenamed("cls", "region"))


@query("region_hulls", f"WITH {HULLS} SELECT image_id, region, k, x, y FROM hu")
def q_hulls(spark, d):
    hulls = G.region_hulls(X.masks(spark, d).withColumnRenamed("cls", "region"))
    return hulls.select("image_id", "region", F.posexplode("hull").alias("k", "c")).select("image_id", "region", "k", F.get("c", 0).alias("x"), F.get("c", 1).alias("y"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The best root split of the line items, with the counts of its sides."""
    return q_level(spark, d)

