"""Readers for edge lists, labels, coordinates, indices, inclusion lists and results, and file selection by pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netfell.functions.expressions import is_true, source_file, subject_of, subject_prefix


class NoInput(ValueError):
    """A scan that found no file or no usable row."""


def files(spark: SparkSession, folder: str, pattern: str, missing: str = "error") -> DataFrame:
    """path, name, subject and prefix of the files in a folder that fit a glob pattern, by name, with index from 0."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder).select("path")
    if missing == "error" and found.isEmpty():
        raise NoInput(f"no file fits {pattern} in {folder}")
    named = found.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    place = F.row_number().over(Window.orderBy("name")) - 1  # one row for each file
    return named.select("path", "name", subject_of(F.col("name")).alias("subject"), subject_prefix(F.col("name")).alias("prefix"), place.alias("index"))


def nth_file(listed: DataFrame, index: int) -> str:
    """The path at a position of the sorted list; an index outside it is an error."""
    row = listed.where(F.col("index") == index).first()
    if row is None:
        raise NoInput(f"no file with index {index}")
    return row["path"]


def with_prefixes(listed: DataFrame, prefixes: list[str] | None) -> DataFrame:
    return listed.where(F.col("prefix").isin(prefixes)) if prefixes else listed


def edge_pairs(spark: SparkSession, path: str, graph_id: str = "graph") -> DataFrame:
    """graph_id, u, v and w, all text, of an edge list with header u,v[,w]; rows without an endpoint are skipped."""
    read = spark.read.option("header", True).option("enforceSchema", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    weight = F.col("w").cast("string") if "w" in read.columns else F.lit(None).cast("string")
    return read.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select(F.lit(graph_id).alias("graph_id"), F.col("u").cast("string"), F.col("v").cast("string"), weight.alias("w"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines of a small text file with their order, from 0. The file is one partition, so order is file order."""
    return lines.coalesce(1).withColumn("at", F.monotonically_increasing_id())


def labels(spark: SparkSession, path: str) -> DataFrame:
    """node (from 0) and label of a one-column file with a header; blank rows don't count."""
    lines = _numbered(spark.read.text(path, wholetext=False)).where("at > 0").select("at", F.trim(F.regexp_replace("value", '^"|"$', "")).alias("label")).where("label <> ''")
    return lines.select((F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("node"), "label")


def label_levels(labelled: DataFrame) -> DataFrame:
    """labelled with the path's six levels as a struct; the path begins with an empty level."""
    part = F.split("label", " *// *")
    names = ["hemisphere", "lobe", "gyrus", "tissue", "brodmann", "atlas"]
    return labelled.withColumn("levels", F.struct(*(F.get(part, F.lit(i + 1)).alias(n) for i, n in enumerate(names))))


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """node, x, y and z of a text of three columns or more, parted by blanks or tabs."""
    parts = _numbered(spark.read.text(path)).select("at", F.split(F.trim("value"), r"[\s,]+").alias("c")).where("size(c) >= 3")
    place = (F.row_number().over(Window.orderBy("at")) - 1).cast("int")
    return parts.select(place.alias("node"), *(F.get("c", F.lit(i)).cast("double").alias(n) for i, n in enumerate("xyz")))


def indices(spark: SparkSession, path: str) -> DataFrame:
    """The whole numbers of a one-column file, one row or many."""
    return spark.read.text(path).select(F.trim("value").try_cast("double").cast("int").alias("node")).where("node IS NOT NULL")


def included_subjects(spark: SparkSession, path: str) -> DataFrame:
    """file of each subject that is named and not excluded, as the adjacency file its result came from."""
    read = spark.read.option("header", True).csv(path)
    kept = read.where(F.col("subject_file").isNotNull() & (F.trim("subject_file") != "") & ~is_true(F.col("excluded")))
    return kept.select(source_file(F.trim("subject_file")).alias("file")).distinct()


def existing(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed files whose name is wanted(file); wanted files that are not there are passed over."""
    return listed.join(wanted.select(F.col("file").alias("name")), "name", "left_semi")


def adjacency(cells: DataFrame, missing: str = "error") -> DataFrame:
    """graph_id, u, v and w from matrix cells(graph_id, variable, u, v, w): variable psi_adj, else A, in any case.

    Graphs with neither are an error, or left out with ``missing='skip'``. The upper triangle counts."""
    named = cells.withColumn("choice", F.when(F.lower("variable") == "psi_adj", 0).when(F.lower("variable") == "a", 1))
    if missing == "error":
        bare = named.groupBy("graph_id").agg(F.min("choice").alias("c")).where("c IS NULL")
        if not bare.isEmpty():
            raise NoInput("a file has neither psi_adj nor A")
    best = named.where("choice IS NOT NULL").groupBy("graph_id").agg(F.min("choice").alias("choice"))
    return named.join(F.broadcast(best), ["graph_id", "choice"]).where("u < v AND w <> 0").select("graph_id", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "w")
