"""Readers for the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The columns that placed() adds.
PLACE = ("__file", "__row")


def placed(rows: DataFrame) -> DataFrame:
    """A table read from files, with each row's place: its file's name and its number in the file. Files of one folder are in the order of their names."""
    return rows.withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
