"""Discovery of template pictures: a table of the pictures that are known, keyed by path and time, so that only new files are read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import brand_of_file
from ..operators.shapes import each_picture, grey, template_features
from ..operators.visual import cosine_hash

#: names of the files that are pictures; files read in one job
PICTURES, FILES = "*.{png,jpg,jpeg,PNG,JPG,JPEG}", 10_000
SCHEMA = "path string, modified timestamp, length long, template string, cse_name string, hash string, contour_count int, edge_density double, brightness_mean double, brightness_std double, error string"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of the pictures under folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PICTURES).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def template_name(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), "[.][^.]*$", "")


def hashed(pictures: DataFrame, image: str = "image") -> DataFrame:
    """pictures plus hash, the 256 bits of the cosine hash as text; null without pixels."""
    return each_picture(pictures, "hash string", lambda p: ("".join("01"[int(b)] for b in cosine_hash(grey(p).astype(float))),), image)


def known(spark: SparkSession, table: str) -> DataFrame:
    """All rows of the table, one for each path and time; empty before the first discovery."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(table)
    return rows.dropDuplicates(["path", "modified"])  # a run that was lost may have left rows that the next one wrote again


def new_files(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """(path, modified, length) of the pictures that the table does not hold as they are now."""
    return listed(spark, folder).join(known(spark, table).select("path", "modified"), ["path", "modified"], "left_anti")


def discover(spark: SparkSession, folder: str, table: str, files: int = FILES) -> int:
    """Read the pictures that are new or changed, and append their rows to the table; the number of files read. A file that is no
    picture, and one without pixels, has a row with an error, so it is not read again either. Of each file the name and time pass
    the driver, as in any listing; pictures are read by the tasks, `files` in one job."""
    rows = [(r["path"], r["modified"], r["length"]) for r in new_files(spark, folder, table).toLocalIterator()]
    for at in range(0, len(rows), files):
        part = spark.createDataFrame(rows[at : at + files], "path string, modified timestamp, length long")
        pictures = spark.read.format("image").load([p for p, _, _ in rows[at : at + files]])
        read = pictures.select(F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B"))).alias("origin"), "image", F.col("image").alias("again"))
        facts = template_features(hashed(read), "again")
        found = part.join(facts, plain_path(F.col("path")) == plain_path(F.col("origin")), "left")
        made = found.select("path", "modified", "length", template_name(F.col("path")).alias("template"), brand_of_file(template_name(F.col("path"))).alias("cse_name"), "hash", "contour_count", "edge_density", "brightness_mean", "brightness_std", F.when(F.col("hash").isNull(), "no picture").alias("error"))
        made.write.parquet(f"{table}/run={uuid.uuid4().hex}")
    return len(rows)


def plain_path(path: Column) -> Column:
    """A local path however its scheme is written."""
    return F.regexp_replace(path, "^file:/+", "/")


def templates(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of the pictures that are in the folder now, without those that could not be read."""
    return known(spark, table).join(listed(spark, folder).select("path", "modified"), ["path", "modified"], "left_semi").filter("error is null")
