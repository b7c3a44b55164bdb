"""Participation matrices as rows (graph_id, step, node, p): cropping, weighting, ranking and sampling them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netfell.functions.expressions import early_weight, finite_or_zero, flattened_weight, simpson_weight, tilted


def crop_longest(cells: DataFrame, rule: str = "all") -> DataFrame:
    """The cells of each graph's longest run of sound steps, the first of equals, with place (from 0) and n_steps.

    ``all``: a step is unsound if all its cells are NULL; ``any``: if one is. Graphs without a sound step go."""
    sound = F.count("p") > 0 if rule == "all" else F.count("p") == F.count("*")
    steps = cells.groupBy("graph_id", "step").agg(sound.alias("sound")).where("sound")
    island = F.col("step") - F.row_number().over(Window.partitionBy("graph_id").orderBy("step"))
    runs = steps.withColumn("island", island).groupBy("graph_id", "island").agg(F.min("step").alias("first"), F.count("*").alias("n_steps"))
    best = runs.groupBy("graph_id").agg(F.max_by(F.struct("first", "n_steps"), F.struct("n_steps", -F.col("first"))).alias("b")).select("graph_id", "b.first", "b.n_steps")
    inside = cells.join(F.broadcast(best), "graph_id").where("step >= first AND step < first + n_steps")
    return inside.select("graph_id", "step", "node", "p", (F.col("step") - F.col("first")).cast("int").alias("place"), F.col("n_steps").cast("int").alias("n_steps"))


def weight_linear(cropped: DataFrame) -> DataFrame:
    return cropped.withColumn("value", early_weight(F.col("p"), F.col("place"), F.col("n_steps")))


def weight_flattened(cropped: DataFrame) -> DataFrame:
    return cropped.withColumn("value", F.when(F.col("p").isNotNull(), flattened_weight(F.col("p"), F.col("place"), F.col("n_steps"))))


def tilt(cropped: DataFrame, tau_factor: float = 1 / 6, clip_negative: bool = True) -> DataFrame:
    filled = finite_or_zero(F.col("p"))
    return cropped.withColumn("value", tilted(filled, F.col("place"), F.col("n_steps"), tau_factor, clip_negative))


def fill(cells: DataFrame, column: str = "value") -> DataFrame:
    return cells.withColumn(column, finite_or_zero(F.col(column)))


def peak_ranks(tilted_cells: DataFrame) -> DataFrame:
    """graph_id, node, amp (largest value), peak (its first place) and rank by amp, then earlier peak, then node."""
    peaks = tilted_cells.groupBy("graph_id", "node").agg(F.max("value").alias("amp"), F.max_by("place", F.struct("value", -F.col("place"))).alias("peak"))
    order = Window.partitionBy("graph_id").orderBy(F.desc("amp"), "peak", "node")
    return peaks.withColumn("rank", F.row_number().over(order).cast("int"))


def downsample(cells: DataFrame, max_steps: int, max_nodes: int) -> DataFrame:
    """Evenly spaced places and nodes, at most so many of each, first and last included; with their grid indices."""

    def picked(column: str, most: int) -> DataFrame:
        n = cells.groupBy("graph_id").agg((F.max(column) + 1).alias("n"))
        grid = n.select("graph_id", "n", F.least("n", F.lit(most)).alias("m")).select("graph_id", "n", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("g"))
        index = F.when(F.col("m") < 2, F.lit(0)).otherwise(F.floor(F.col("g") * (F.col("n") - 1) / F.greatest(F.col("m") - 1, F.lit(1))))
        return grid.select("graph_id", index.cast("int").alias(column), F.col("g").cast("int").alias(f"grid_{column}"))

    return cells.join(F.broadcast(picked("place", max_steps)), ["graph_id", "place"]).join(F.broadcast(picked("node", max_nodes)), ["graph_id", "node"])


def node_sums(cells: DataFrame, column: str = "value") -> DataFrame:
    """graph_id, node, total and mean of a column over a graph's steps, NULL as 0."""
    x = F.coalesce(F.col(column), F.lit(0.0))
    return cells.groupBy("graph_id", "node").agg(F.sum(x).alias("total"), (F.sum(x) / F.countDistinct("step")).alias("mean"))


def area(cells: DataFrame, column: str = "value") -> DataFrame:
    """graph_id, node and the area under a column over places by Simpson's rule."""
    x = F.coalesce(F.col(column), F.lit(0.0)) * simpson_weight(F.col("place"), F.col("n_steps"))
    return cells.groupBy("graph_id", "node").agg(F.sum(x).alias("area"))


def at_least_percentile(scores: DataFrame, column: str, q: float) -> DataFrame:
    """The rows whose score is at least the graph's q-quantile (linear interpolation), with the cut."""
    cut = scores.groupBy("graph_id").agg(F.percentile(column, q).alias("cut"))
    return scores.join(F.broadcast(cut), "graph_id").where(F.col(column) >= F.col("cut"))


def shared_range(a: DataFrame, b: DataFrame, column: str = "value") -> DataFrame:
    """Least and largest value over two matrices."""
    return a.select(column).unionAll(b.select(column)).agg(F.min(column).alias("low"), F.max(column).alias("high"))


def feature_vectors(cells: DataFrame, column: str = "value") -> DataFrame:
    """graph_id, node and its values by place as one array, NULL as 0."""
    x = F.struct("place", F.coalesce(F.col(column), F.lit(0.0)).alias("x"))
    rows = cells.groupBy("graph_id", "node").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    return rows.select("graph_id", "node", F.transform("xs", lambda s: s["x"]).alias("x"))
