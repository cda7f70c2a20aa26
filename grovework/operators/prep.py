"""Label preparation: resizing, bands, classes, points and their sampling.

Long tables: px(image_id, i, j, b, v), masks(image_id, i, j, cls); i is the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..random import mixed


def resize_dims(df: DataFrame, height: str = "height", width: str = "width", max_side: int = 320) -> DataFrame:
    """Adds new_height, new_width, ratio: the longer side becomes max_side if it is more, the other is truncated."""
    h, w = F.col(height), F.col(width)
    big = F.greatest(h, w)
    other = lambda a: F.floor(F.lit(max_side) * a / big).cast("int")
    return (
        df.withColumn("new_height", F.when(big <= max_side, h).when(h >= w, F.lit(max_side)).otherwise(other(h)).cast("int"))
        .withColumn("new_width", F.when(big <= max_side, w).when(w > h, F.lit(max_side)).otherwise(other(w)).cast("int"))
        .withColumn("ratio", F.when(big <= max_side, F.lit(1.0)).otherwise(F.lit(float(max_side)) / big))
    )


def grid(images: DataFrame, height: Column, width: Column) -> DataFrame:
    """A row (i, j) for each pixel of each image."""
    rows = images.withColumn("i", F.explode(F.sequence(F.lit(0), height - 1)))
    return rows.withColumn("j", F.explode(F.sequence(F.lit(0), width - 1)))


def resize_mask_nearest(masks: DataFrame, sizes: DataFrame) -> DataFrame:
    """masks resampled; sizes: image_id, height, width, new_height, new_width.  Source pixel: floor(target * old / new)."""
    target = grid(sizes, F.col("new_height"), F.col("new_width")).select(
        "image_id", "i", "j",
        F.floor(F.col("i") * F.col("height") / F.col("new_height")).cast("int").alias("si"),
        F.floor(F.col("j") * F.col("width") / F.col("new_width")).cast("int").alias("sj"),
    )
    source = masks.select("image_id", F.col("i").alias("si"), F.col("j").alias("sj"), "cls")
    return target.join(source, ["image_id", "si", "sj"]).select("image_id", "i", "j", "cls")


def resize_image_linear(px: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bilinear resampling: pixel centres, clamped; each target pixel meets its four corners."""

    def axis(t: str, old: str, new: str) -> tuple[Column, Column, Column]:
        at = F.greatest(F.lit(0.0), F.least((F.col(t) + 0.5) * F.col(old) / F.col(new) - 0.5, (F.col(old) - 1).cast("double")))
        lo = F.floor(at).cast("int")
        return lo, F.least(lo + 1, F.col(old) - 1), at - lo

    i0, i1, fi = axis("i", "height", "new_height")
    j0, j1, fj = axis("j", "width", "new_width")
    target = grid(sizes, F.col("new_height"), F.col("new_width"))
    corners = F.array(
        *[
            F.struct(a.alias("si"), b.alias("sj"), (p * q).alias("w"))
            for a, p in ((i0, 1 - fi), (i1, fi))
            for b, q in ((j0, 1 - fj), (j1, fj))
        ]
    )
    looked = target.select("image_id", "i", "j", F.explode(corners).alias("c")).select("image_id", "i", "j", "c.*")
    source = px.select("image_id", F.col("i").alias("si"), F.col("j").alias("sj"), "b", "v")
    return looked.join(source, ["image_id", "si", "sj"]).groupBy("image_id", "i", "j", "b").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def drop_small_images(df: DataFrame, radius: int, height: str = "height", width: str = "width") -> DataFrame:
    """Images whose sides are both at least 2 * radius + 1."""
    return df.where(F.least(height, width) >= 2 * radius + 1)


def neighbour(v: str, di: int, dj: int) -> Column:
    """v of the pixel di rows down and dj columns right, by lags over whole rows and columns of a dense raster.

    Rows and columns are partitions of their own, so an image never has to fit one task's window.
    """
    if di and dj:
        raise ValueError("one axis at a time")
    w = Window.partitionBy("image_id", "i").orderBy("j") if dj else Window.partitionBy("image_id", "j").orderBy("i")
    d = di + dj
    return F.lead(v, d).over(w) if d > 0 else F.lag(v, -d).over(w)


def gradient_magnitude(raster: DataFrame, v: str = "v") -> DataFrame:
    """Adds grad: length of the central differences inside, 0 on the border."""
    dx = (neighbour(v, 0, 1) - neighbour(v, 0, -1)) / 2
    dy = (neighbour(v, 1, 0) - neighbour(v, -1, 0)) / 2
    return raster.withColumn("__dx", dx).withColumn("__dy", dy).withColumn(
        "grad", F.coalesce(F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy")), F.lit(0.0))
    ).drop("__dx", "__dy")


def feature_bands(rgb: DataFrame) -> DataFrame:
    """image_id, i, j, b, v: blue, green, red, 8-bit CIE Lab (D65) and gradient magnitude, from r, g, b columns 0..255."""

    def linear(c: Column) -> Column:
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = (linear(F.col(c)) for c in ("r", "g", "b"))
    # sRGB to XYZ, over the D65 white point
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)
    light = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    byte = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)) + 0.5).cast("int")
    gray = rgb.withColumn("gray", 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    out = gradient_magnitude(gray, "gray")
    bands = [F.col("b"), F.col("g"), F.col("r"), byte(light * 255.0 / 100.0), byte(500.0 * (f(x) - f(y)) + 128.0), byte(200.0 * (f(y) - f(z)) + 128.0), byte(F.col("grad"))]
    return out.select("image_id", "i", "j", F.posexplode(F.array(*[c.cast("int") for c in bands])).alias("b", "v"))


def enumerate_classes(names: DataFrame, name: str) -> DataFrame:
    """name, class_id from 0 in name order; a vocabulary, so its rows are few."""
    return names.select(F.col(name).alias("name")).distinct().withColumn(
        "class_id", F.row_number().over(Window.orderBy("name")) - 1
    )


def map_classes(df: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """df with class_id; rows of unknown names are dropped."""
    return df.join(classes.withColumnRenamed("name", name), name)


def mask_to_points(masks: DataFrame) -> DataFrame:
    return masks.where("cls != 0").select("image_id", F.col("cls").alias("label"), "i", "j")


def sample_points(points: DataFrame, most: int = 15_000, seed: int = 0) -> DataFrame:
    """At most `most` points of each image and class, by a repeatable hash."""
    w = Window.partitionBy("image_id", "label").orderBy(mixed(seed, F.col("image_id"), F.col("i"), F.col("j")), "i", "j")
    return points.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def images_with_labels(images: DataFrame, points: DataFrame) -> DataFrame:
    return images.join(points, "image_id", "left_semi")


def explode_masks(truth: DataFrame, classes: DataFrame) -> DataFrame:
    """image_id, i, j, name, v: one mask for each class from an array of channels in [0, 1], scaled to bytes."""
    long = truth.select("image_id", "i", "j", F.posexplode("channels").alias("class_id", "x"))
    return long.join(classes, "class_id").select("image_id", "i", "j", "name", F.floor(F.col("x") * 255).cast("int").alias("v"))


def samples_per_class(points: DataFrame) -> DataFrame:
    return points.groupBy("label").agg(F.count("*").alias("n"))


def label_coverage(points: DataFrame, sampled: DataFrame, areas: DataFrame) -> DataFrame:
    """image_id, label, sampled, available, share of the image's area that is available."""
    have = points.groupBy("image_id", "label").agg(F.count("*").alias("available"))
    took = sampled.groupBy("image_id", "label").agg(F.count("*").alias("sampled"))
    return have.join(took, ["image_id", "label"], "left").join(areas, "image_id").select(
        "image_id", "label", F.coalesce("sampled", F.lit(0)).cast("long").alias("sampled"), "available", (F.col("available") / F.col("area")).alias("share")
    )


def prepare_labeled_points(
    images: DataFrame, px: DataFrame, masks: DataFrame, classes: DataFrame, max_side: int = 320, radius: int = 10, most: int = 15_000
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled images for training: (bands, points, samples_per_class).

    images: image_id, height, width; px: image_id, i, j, r, g, b; masks:
    image_id, name, i, j, v (non-zero: the class is there); classes: name,
    class_id.  Images are resized to max_side, small ones dropped, their seven
    bands computed; masks are resized with them, those of unknown names dropped,
    and at most `most` points of each image and class are sampled.  Images
    without a point go.
    """
    sizes = drop_small_images(resize_dims(images, max_side=max_side), radius, "new_height", "new_width")
    long = px.select("image_id", "i", "j", F.posexplode(F.array("r", "g", "b")).alias("b", "v"))
    resized = resize_image_linear(long, sizes).groupBy("image_id", "i", "j").pivot("b", [0, 1, 2]).agg(F.max("v"))
    rgb = resized.select("image_id", "i", "j", *[F.round(F.round(F.col(str(k)), 6)).cast("int").alias(n) for k, n in enumerate(("r", "g", "b"))])
    known = masks.join(F.broadcast(classes), "name")  # a vocabulary
    stretched = resize_mask_nearest(
        known.select(F.struct("image_id", "class_id").alias("image_id"), "i", "j", F.col("v").alias("cls")),
        sizes.join(known.select("image_id", "class_id").distinct(), "image_id").withColumn("image_id", F.struct("image_id", "class_id")),
    )
    there = stretched.where("cls != 0").select("image_id.image_id", F.col("image_id.class_id").alias("label"), "i", "j")
    points = sample_points(there, most)
    return images_with_labels(feature_bands(rgb), points), points, samples_per_class(points)
