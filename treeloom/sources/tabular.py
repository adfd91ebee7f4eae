"""Flat markup files: one row per row tag, by Spark's own XML source and sink; text files by separator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of files in which every row_tag element is a row; broken rows become nulls."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).load(path)


def write_rows(df: DataFrame, path: str, root_tag: str = "rows", row_tag: str = "row") -> None:
    df.write.format("xml").option("rootTag", root_tag).option("rowTag", row_tag).save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """uri and text of whole files, a document each."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS uri", "value AS text")


def read_by_separator(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path)


def write_files(df: DataFrame, path: str, href: str, text: str) -> None:
    """Many outputs: a folder per href."""
    df.select(href, text).write.partitionBy(href).text(path)
