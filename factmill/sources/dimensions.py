"""Dimension tables from JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_districts(spark: SparkSession, path: str, name: str = "district") -> DataFrame:
    """One row per name of a JSON array of names."""
    names = F.explode(F.from_json("value", "array<string>"))
    return spark.read.text(path, wholetext=True).select(names.alias(name))


def read_categories(
    spark: SparkSession, path: str, major: str = "major", minor: str = "minor"
) -> DataFrame:
    """One row per pair of a JSON object that maps a major to its minor categories."""
    pairs = F.explode(F.from_json("value", "map<string,array<string>>"))
    return (
        spark.read.text(path, wholetext=True)
        .select(pairs.alias(major, "__minors"))
        .select(major, F.explode("__minors").alias(minor))
    )
