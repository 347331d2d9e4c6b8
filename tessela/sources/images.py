"""Listings of images, masks and runs as tables, and how they are paired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The extensions of images, and of masks in the order in which they are preferred.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path, size_bytes`` of the files of a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.select("path", F.col("length").alias("size_bytes"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def images(files: DataFrame) -> DataFrame:
    """The files that are images by their extension, each path once."""
    return files.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS)).dropDuplicates(["path"])


def pair(image_files: DataFrame, mask_files: DataFrame) -> DataFrame:
    """``image, mask``: each image with the mask of the same file name, else of the same stem, the preferred extension first.

    Images without a mask are left out; null paths match nothing.
    """
    rank = F.array_position(F.array(*[F.lit(e) for e in IMAGE_EXTENSIONS]), extension(F.col("path")))
    a = images(image_files).select(F.col("path").alias("image"), file_name(F.col("path")).alias("name"), stem(F.col("path")).alias("stem"))
    b = images(mask_files).select(F.col("path").alias("mask"), file_name(F.col("path")).alias("mask_name"), stem(F.col("path")).alias("stem"), rank.alias("order"))
    best = F.min(F.struct((F.col("name") != F.col("mask_name")).alias("unlike"), F.col("order"), F.col("mask")))
    return a.join(b, "stem").groupBy("image").agg(best.alias("b")).select("image", F.col("b.mask").alias("mask"))


def pairing_errors(image_files: DataFrame, mask_files: DataFrame) -> DataFrame:
    """``stem, problem``: stems that occur twice on one side, or on one side only."""
    side = lambda df, n: images(df).groupBy(stem(F.col("path")).alias("stem")).agg(F.count(F.lit(1)).alias(n))
    both = side(image_files, "i").join(side(mask_files, "m"), "stem", "full")
    problem = F.when(F.col("i").isNull(), "no image").when(F.col("m").isNull(), "no mask").when((F.col("i") > 1) | (F.col("m") > 1), "repeated")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("stem", "problem")


def richest_image(pixels: DataFrame, ignore: list[int]) -> DataFrame:
    """The image whose mask has most distinct codes, the first by name on a tie."""
    n = pixels.where(~F.col("gt").isin(*ignore)).groupBy("image").agg(F.count_distinct("gt").alias("n_codes"))
    return n.orderBy(F.desc("n_codes"), "image").limit(1)


def state_files(files: DataFrame) -> DataFrame:
    """``run_dir, path, state_index``: state files by run in the order of the number that ends their name, -1 without one."""
    name = file_name(F.col("path"))
    digits = F.regexp_extract(name, r"([0-9]+)(?:\.json(?:\.gz)?)$", 1)
    return files.where(name.rlike(r"^state_.*\.json(\.gz)?$")).select(
        F.regexp_replace("path", r"/[^/]*$", "").alias("run_dir"), "path", F.when(digits != "", digits.cast("int")).otherwise(-1).alias("state_index")
    )


def latest_states(files: DataFrame) -> DataFrame:
    """The last state file of every run."""
    return state_files(files).groupBy("run_dir").agg(F.max_by("path", F.struct("state_index", "path")).alias("path"), F.max("state_index").alias("state_index"))


def inventory(files: DataFrame, root: str) -> DataFrame:
    """``child, n_files, size_bytes``: what lies below each child of a folder."""
    rest = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/") + "/", "")
    return files.groupBy(F.split(rest, "/")[0].alias("child")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("size_bytes"))


def run_kinds(files: DataFrame) -> DataFrame:
    """``run_dir, has_metrics, has_log, finished``: which folders are runs, by their marker files."""
    marks = files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("run_dir"), file_name(F.col("path")).alias("n"))
    out = marks.groupBy("run_dir").agg(F.bool_or(F.col("n") == "metrics.csv").alias("has_metrics"), F.bool_or(F.col("n") == "run.log").alias("has_log"), F.bool_or(F.col("n") == "summary.json").alias("has_summary"))
    return out.where("has_metrics OR has_log OR has_summary").select("run_dir", "has_metrics", "has_log", (F.col("has_metrics") & F.col("has_summary")).alias("finished"))


def split(rows: DataFrame, key: str, validation: float, seed: int = 0) -> DataFrame:
    """Adds ``part``: train or val, by a hash of the key, alike on any cluster and in any order."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000
    return rows.withColumn("part", F.when(u < validation, "val").otherwise("train"))


def ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds ``position`` from 0 within each group."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
