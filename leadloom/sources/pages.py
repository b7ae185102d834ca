"""Page sources. Every page has an ordinal, so that nothing depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.sources import json_array as array

PAGES = "ordinal bigint, url string, text string"


def json_array(spark: SparkSession, path: str, as_one: bool = False) -> DataFrame:
    """Pages of files that hold one JSON array each, read by ranges of bytes; the place in the array is the ordinal.
    Missing fields are empty. as_one: the files of the folder are one array's parts, in order of their names."""
    rows = array.read(spark, path, "url string, markdown string", as_one)
    return rows.select("ordinal", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("markdown", F.lit("")).alias("text"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON-lines files with ordinal, url, markdown: the form for large corpora, which splits."""
    rows = spark.read.schema("ordinal bigint, url string, markdown string").json(path)
    return rows.select("ordinal", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("markdown", F.lit("")).alias("text"))


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved lead results, by an explicit schema, in the array that sinks.write_json_array leaves; ordinal is the place."""
    return array.read(spark, path, schema, True)


def driver_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select(F.col("page_id").alias("ordinal"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("text"))
