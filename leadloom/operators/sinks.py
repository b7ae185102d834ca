"""Exports: JSON, CSV and text, written by the executors as part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.sources import files


def write_json_array(found: DataFrame, path: str, by: str = "outreach_rank", first: int = 1) -> None:
    """Rows as one JSON array, in order of rank, from first on: the files of the folder, one after the other by name, are the array.

    Ranges of ranks are written side by side. Every row but the first brings the comma before it, so that no file has
    to know of another; the brackets are files of their own, the closing one written last.
    """
    rows = found.repartitionByRange(by).sortWithinPartitions(by)
    text = F.concat(F.when(F.col(by) == first, "").otherwise(","), F.to_json(F.struct(*found.columns), {"ignoreNullFields": "false"}))
    rows.select(text.alias("value")).write.mode("overwrite").text(path)
    files.created(found.sparkSession, f"{path}/all-0-open.json", "[\n")
    files.created(found.sparkSession, f"{path}/z-close.json", "]\n")


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows with a header; fields with line breaks are quoted. Read back with multiLine."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_text(rows: DataFrame, path: str, column: str = "report") -> None:
    rows.select(F.col(column)).write.mode("overwrite").text(path)
