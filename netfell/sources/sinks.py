"""Writers: Parquet for matrices and bundles, one-file text tables for results that people read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrices(df: DataFrame, path: str) -> None:
    """A long table of many graphs, a folder for each graph."""
    df.write.mode("overwrite").partitionBy("graph_id").parquet(path)


def bundle(parts: dict[str, DataFrame], path: str) -> None:
    """Several tables side by side: a converged run's participation, counts and meta, or an average and its origin."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def text_table(df: DataFrame, path: str, order: list, header: bool = True, sep: str = ",") -> None:
    """One delimited file in the given order; NULL is empty and NaN is ``nan``."""
    shown = [F.when(F.isnan(c), F.lit("nan")).otherwise(F.col(c).cast("string")).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.orderBy(*order).select(*shown).coalesce(1).write.mode("overwrite").option("header", header).option("sep", sep).option("nullValue", "").option("emptyValue", "").csv(path)


def outlier_table(flagged: DataFrame, path: str) -> None:
    """Excluded subjects first, then the kept ones, each by name."""
    text_table(flagged.select("subject", "final_attacks", "excluded"), path, [F.desc("excluded"), "subject"])


def consensus_vector(scores: DataFrame, path: str) -> None:
    text_table(scores.select("node", "score"), path, ["node"])


def critical_table(flags: DataFrame, path: str) -> None:
    """index, label, cluster and is_critical of every node; and beside it the critical ones as a tab-separated list."""
    rows = flags.select(F.col("node").alias("index"), "label", F.col("cluster"), F.col("is_critical").cast("int").alias("is_critical"))
    text_table(rows, f"{path}/labels", ["index"])
    text_table(rows.where("is_critical = 1").select("index", "label"), f"{path}/list", ["index"], sep="\t")
