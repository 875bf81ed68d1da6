"""Source trees, logs and API catalogs as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.patterns import glob_to_regex, whole_match
from plumbline.schema import API_DOCUMENT, SOURCES

# The default selection of a source listing.
SOURCE_REGEX = r".*\.(hpp|cpp|c|h)"
EXCLUDED_GLOBS = ("*buil*", "*thirdpart*")


def read_sources(
    spark: SparkSession, root: str, path_glob: str | None = None, package: str | None = None
) -> DataFrame:
    """``path, content`` of all files below ``root``.

    Paths start with ``package``, so that a project has one root package: the
    name of the folder unless another is given, nothing if it is empty.
    ``path_glob`` (``*.cpp``, say) prunes files by name before they are opened.
    """
    package = root.rstrip("/").rsplit("/", 1)[-1] if package is None else package
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=path_glob)
    path = F.concat(F.lit(f"{package}/" if package else ""), relative_path(root))
    return files.select(path.alias("path"), F.col("value").alias("content")).to(SOURCES)


def relative_path(root: str) -> Column:
    """Path of the row's file below ``root`` (given with or without a scheme)."""
    full = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:(//[^/]*)?", "")
    bare = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.regexp_replace(full, F.lit("^.*?" + _quoted(bare) + "/"), F.lit(""))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def select_sources(
    df: DataFrame,
    regex: str = SOURCE_REGEX,
    exclude_globs: Sequence[str] = EXCLUDED_GLOBS,
    column: str = "path",
) -> DataFrame:
    """Rows whose whole path matches the regex and none of the globs.

    A find-style pattern is translated by ``patterns.find_regex`` first.
    """
    keep = whole_match(F.col(column), regex)
    for glob in exclude_globs:
        keep = keep & ~F.col(column).rlike(glob_to_regex(glob))
    return df.where(keep)


def log_lines(raw: DataFrame) -> DataFrame:
    """Lines with their place: file, byte offset of the read block, and a number
    that grows along the block."""
    return raw.select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of all log files, ordered by ``file, block, line_no``."""
    lines = log_lines(spark.read.option("recursiveFileLookup", True).text(folder))
    return lines.withColumn("line_no", F.monotonically_increasing_id())


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """API documents below ``root``: ``service, name, method, query, params``.

    The service is the folder of a document and the name its file stem. Nested
    parameters keep their JSON text.
    """
    documents = (
        spark.read.schema(API_DOCUMENT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(root)
    )
    path = F.col("_metadata.file_path")
    return documents.select(
        F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("service"),
        F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("name"),
        F.col("Method").alias("method"),
        F.col("Query").alias("query"),
        F.col("Params").alias("params"),
        F.col("Content-Type").alias("content_type"),
        F.col("Description").alias("description"),
    )
