"""Labelled records, models and reports in files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.model import COLUMNS, SCHEMA, nodes_frame
from ..shared import shared_dir


def load_labeled_records(spark: SparkSession, path: str, key: str = "key", columns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Records of the Parquet files at `path` with a proper key, and the number of rejects by reason.

    The files must have the columns named; keys that aren't strings are rejects
    (reason 'type'), as are null and blank ones ('null', 'empty').
    """
    records = spark.read.parquet(path)
    missing = [c for c in (key, *columns) if c not in records.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    if not isinstance(records.schema[key].dataType, StringType):
        bad = F.lit("type")
    else:
        bad = F.when(F.col(key).isNull(), "null").when(F.trim(key) == "", "empty")
    return records.where(bad.isNull()), records.where(bad.isNotNull()).groupBy(bad.alias("reason")).agg(F.count("*").alias("n"))


def write_sharded(df: DataFrame, path: str, rows: int = 100, codec: str = "snappy") -> None:
    df.write.option("maxRecordsPerFile", rows).option("compression", codec).parquet(path)


def filter_key_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.col(key).startswith(prefix))


def select_classifiers(models: DataFrame, name: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """Models of the wanted names; no names: all."""
    return models if wanted is None else models.where(F.col(name).isin(list(wanted)))


def save_model(spark: SparkSession, nodes: list[tuple] | DataFrame, path: str, images: dict[tuple[int, int], int] | None = None) -> None:
    """Nodes in files by tree, each with its feature, its level and, where `images` tells, the number of its images."""
    frame = (nodes if isinstance(nodes, DataFrame) else nodes_frame(spark, nodes)).select(*COLUMNS)
    frame = frame.withColumn("level", F.floor(F.log2(F.col("node_id") + 1)).cast("int"))
    if images is None:
        frame = frame.withColumn("num_images", F.lit(None).cast("long"))
    else:
        # as many rows as the model has
        counts = spark.createDataFrame([(t, n, k) for (t, n), k in images.items()], "tree_id int, node_id long, num_images long")
        frame = frame.join(counts, ["tree_id", "node_id"], "left").withColumn("num_images", F.coalesce("num_images", F.lit(0).cast("long")))
    frame.write.mode("overwrite").partitionBy("tree_id").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """The nodes that save_model has written: model.SCHEMA, level, num_images."""
    schema = f"{SCHEMA}, level int, num_images long"
    return spark.read.schema(schema).parquet(path).select(*COLUMNS, "level", "num_images")


def write_predictions(predictions: DataFrame, path: str, truth: DataFrame | None = None, keys: Sequence[str] = ("image_id", "i", "j")) -> None:
    """Predictions (keys, label and what else they have: prob, probs, leaf_id) in files by label, with the true class where `truth` (keys, truth) has it."""
    rows = predictions if truth is None else predictions.join(truth, list(keys), "left")
    rows.write.partitionBy("label").parquet(path)


def export_segments_json(hulls: DataFrame, probs: DataFrame) -> DataFrame:
    """image_id, json: {"segments": [[[x, y], ...], ...], "class_prob": {name: probability}} for each image."""
    segments = hulls.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("region", "hull"))).alias("s"))
    shares = probs.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "prob")))).alias("class_prob"))
    return segments.join(shares, "image_id", "left").select(
        "image_id",
        F.to_json(F.struct(F.transform("s", lambda x: x["hull"]).alias("segments"), F.coalesce("class_prob", F.create_map().cast("map<string,double>")).alias("class_prob"))).alias("json"),
    )


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
