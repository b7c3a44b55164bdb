"""The driver's Parquet tables by name."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HOME = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> None:
    """Let Python workers that share this path import the package; clusters that don't get it by --py-files."""
    known = spark.sparkContext.environment
    if HOME not in (path := known.get("PYTHONPATH", "")).split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (HOME, path) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
