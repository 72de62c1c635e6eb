"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import sitemaps


def link_files(spark: SparkSession, path: str, comments: bool = True, limit: int | None = None) -> DataFrame:
    """``ordinal, url`` of link files; with ``limit`` the first ones."""
    rows = sitemaps.lines(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"), comments=comments)
    return rows.orderBy("ordinal").limit(limit) if limit is not None else rows


def json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of files that each hold one JSON array; what doesn't parse gives none."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of a folder's ``*.md`` files."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_per_id(rows: DataFrame, path: str, order: str, key: str = "id") -> None:
    """One folder of JSON for each id, the last row by ``order`` of each."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows.withColumn("_k", last).where("_k = 1").drop("_k").withColumn("_id", F.col(key)).write.mode("overwrite").partitionBy("_id").json(path)


def without_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Embedded chunks with ``has_embedding`` in place of the vector."""
    return rows.withColumn("has_embedding", F.col(column).isNotNull()).drop(column)


def with_storage_flags(rows: DataFrame, content: str = "content", threshold: int = 10_240) -> DataFrame:
    """Cache entries with their size in bytes and whether they are large enough to be compressed."""
    size = F.octet_length(F.col(content))
    return rows.withColumns({"size": size, "compressed": size >= threshold})
