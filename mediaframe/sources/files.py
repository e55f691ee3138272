"""Media files as a DataFrame: path, modificationTime, length, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaframe.functions.detect import detect_format
from mediaframe.functions.lookups import is_supported


def extension(path):
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def is_hidden(path):
    return file_name(path).startswith(".")


def scan(spark: SparkSession, paths: str | list[str], recursive: bool = True, supported_only: bool = False) -> DataFrame:
    """Files below paths. Without content in the query Spark reads none; a filter on length or time is pushed to the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True).load(paths)
    files = files.where(~is_hidden(F.col("path")))
    return files.where(is_supported(extension(F.col("path")))) if supported_only else files


def select_supported(paths: DataFrame, column: str = "path") -> DataFrame:
    """A scanned folder as a view shows it: hidden files and unknown extensions dropped."""
    return paths.where(~is_hidden(F.col(column)) & is_supported(extension(F.col(column))))


def new_paths(dropped: DataFrame, present: DataFrame, slots: int = 6) -> DataFrame:
    """Dropped paths (path, pos) that aren't present yet, the first that fit in the free slots. Nothing runs before the result is asked for: how many slots are free is a scalar subquery."""
    fresh = dropped.join(present.select("path"), "path", "left_anti").groupBy("path").agg(F.min("pos").alias("pos")).orderBy("pos").limit(slots)
    free = slots - present.limit(slots).agg(F.count("*")).scalar()
    return fresh.withColumn("nth", F.row_number().over(Window.orderBy("pos"))).where(F.col("nth") <= free).drop("nth")  # of the slots' rows at most


def general(files: DataFrame) -> DataFrame:
    """path, file_name, file_size and format of files with content."""
    return files.select("path", file_name(F.col("path")).alias("file_name"), F.col("length").alias("file_size"), detect_format(F.col("content")).alias("format"))
