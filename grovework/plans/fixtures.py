"""Labelled vectors, rasters, masks and points derived from the given tables; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Kind and range of the six components of `vectors`.
DIMS = ((0, 1.0, 51.0), (0, 900.0, 100000.0), (0, 0.0, 0.1), (0, 0.0, 0.08), (1, 1.0, 8.0), (2, 0.0, 2.0))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """label 0..2, features (six doubles), image_id (the order) of every line item."""
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    status = F.when(F.col("l_linestatus") == "F", 0.0).otherwise(1.0)
    parts = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_linenumber").cast("double"), status]
    return table(spark, d, "lineitem").select(label.alias("label"), F.array(*parts).alias("features"), F.col("l_orderkey").alias("image_id"))


F1 = """f1 AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, l_quantity AS x0, l_extendedprice AS x1,
  l_discount AS x2, l_tax AS x3, l_linenumber::DOUBLE AS x4, CASE WHEN l_linestatus = 'F' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS x5,
  l_orderkey AS image_id FROM lineitem)"""


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """row_id, label 0..9, features (64 doubles)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def px(spark: SparkSession, d: str) -> DataFrame:
    """image_id, label, i, j, b, v of 8 x 8 rasters of 7 bands."""
    p, b = F.col("p"), F.col("b")
    at = F.element_at("embedding", ((p + 9 * b) % 64 + 1).cast("int")).cast("double")
    cells = table(spark, d, "embeddings").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return cells.select(
        F.col("vec_id").alias("image_id"), "label", F.floor(p / 8).cast("int").alias("i"), (p % 8).cast("int").alias("j"), "b", F.floor((at + 1) * 127.5).cast("int").alias("v")
    )


F2 = """f2 AS (SELECT vec_id AS image_id, label, (floor(p / 8))::INT AS i, (p % 8)::INT AS j, b::INT AS b,
  floor((embedding[((p + 9 * b) % 64 + 1)::INT]::DOUBLE + 1) * 127.5::DOUBLE)::INT AS v FROM embeddings, range(64) t(p), range(7) u(b))"""


def images(spark: SparkSession, d: str) -> DataFrame:
    """image_id, height, width, pixels (interleaved) of the same rasters; an array expression, no shuffle."""
    cell = lambda k: F.floor((F.element_at("embedding", ((F.floor(k / 7) + 9 * (k % 7)) % 64 + 1).cast("int")).cast("double") + 1) * 127.5).cast("int")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(447)), cell)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.alias("pixels"))


def masks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    cls = F.when(v < 112, 0).when(v < 128, 1).when(v < 144, 2).otherwise(3)
    return px(spark, d).where("b = 0").select("image_id", "i", "j", cls.alias("cls"))


F5 = "f5 AS (SELECT image_id, i, j, CASE WHEN v < 112 THEN 0 WHEN v < 128 THEN 1 WHEN v < 144 THEN 2 ELSE 3 END AS cls FROM f2 WHERE b = 0)"


def points(spark: SparkSession, d: str) -> DataFrame:
    keep = (F.col("image_id") * 31 + F.col("i") * 7 + F.col("j") * 13) % 4 == 0
    return px(spark, d).where("b = 0").where(keep).select("image_id", "label", "i", "j")


F6 = "f6 AS (SELECT image_id, label, i, j FROM f2 WHERE b = 0 AND (image_id * 31 + i * 7 + j * 13) % 4 = 0)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(0).alias("ilp_dim"), (F.col("label") / 10.0).alias("score"))


#: What gray() has where nothing was shipped: least() passes over nulls, there and in SQL.
NONE = 255


def shipments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The pixels of gray() that have shipments, dealt by image, and its images; all others are NONE."""
    at = [F.col("l_suppkey").alias("image_id"), (F.dayofmonth("l_shipdate") - 1).alias("i"), (F.col("l_quantity").cast("int") - 1).alias("j")]
    cells = table(spark, d, "lineitem").select(*at).repartition("image_id").groupBy("image_id", "i", "j").agg(F.least(F.lit(255), 60 * F.count("*")).cast("int").alias("v"))
    return cells, table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(31).alias("height"), F.lit(50).alias("width"))


def gray(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(raster, images) of 31 x 50 pictures: shipments of each supplier by day of the month and quantity."""
    cells = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("image_id"), (F.dayofmonth("l_shipdate") - 1).alias("i"), (F.col("l_quantity").cast("int") - 1).alias("j"))
        .agg(F.count("*").alias("n"))
    )
    shown = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(31).alias("height"), F.lit(50).alias("width"))
    dense = grid(shown, F.col("height"), F.col("width")).join(cells, ["image_id", "i", "j"], "left")
    return dense.select("image_id", "i", "j", F.coalesce(F.least(F.lit(255), 60 * F.col("n")), F.lit(0)).cast("int").alias("v")), shown


F4 = """f4 AS (SELECT s_suppkey AS image_id, i::INT AS i, j::INT AS j, coalesce(least(255, 60 * n), 0)::INT AS v
  FROM supplier, range(31) r(i), range(50) c(j) LEFT JOIN (SELECT l_suppkey, extract(day FROM l_shipdate)::INT - 1 AS di, l_quantity::INT - 1 AS dj, count(*) AS n
    FROM lineitem GROUP BY ALL) x ON l_suppkey = s_suppkey AND di = i AND dj = j)"""
