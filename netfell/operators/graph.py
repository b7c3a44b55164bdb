"""Graphs as long tables: edges(graph_id, u, v, w) with u < v, and nodes(graph_id, node, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netfell.functions.expressions import number_or, rounded


def node_index(pairs: DataFrame) -> DataFrame:
    """graph_id, node (from 0) and label of every endpoint of pairs(graph_id, u, v), labels in string order.

    The numbering needs a graph's labels in order; graphs are numbered side by side."""
    ends = pairs.select("graph_id", F.col("u").alias("label")).unionAll(pairs.select("graph_id", F.col("v").alias("label")))
    known = ends.where(F.col("label").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy("label"))
    return known.select("graph_id", (place - 1).cast("int").alias("node"), "label")


def graph_from_pairs(pairs: DataFrame, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes from pairs(graph_id, u, v, w), all text. Rows without an endpoint are skipped; a weight that is
    no number is 1; of repeated pairs the largest weight stays, and none that is not above 0; self-loops go, but their
    nodes stay."""
    sound = pairs.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = node_index(sound)
    weight = number_or(F.col("w"), 1.0) if weighted else F.lit(1.0)
    merged = sound.where("u <> v").groupBy("graph_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max(weight).alias("w"))
    of = lambda end, to: nodes.select("graph_id", F.col("label").alias(end), F.col("node").alias(to))
    edges = merged.where("w > 0").join(of("a", "u"), ["graph_id", "a"]).join(of("b", "v"), ["graph_id", "b"])
    return edges.select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w"), nodes


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.select("graph_id", "u", "v", "w").unionAll(edges.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def strengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, node, degree and strength of every node, isolated ones included."""
    sums = both_ways(edges).groupBy("graph_id", F.col("u").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))
    return nodes.select("graph_id", "node").join(sums, ["graph_id", "node"], "left").fillna({"degree": 0, "strength": 0.0})


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, n_nodes, n_edges and the share of node pairs that are edges (0 for a single node)."""
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    count = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    both = size.join(count, "graph_id", "left").fillna({"n_edges": 0})
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return both.select("graph_id", "n_nodes", "n_edges", F.when(F.col("n_nodes") > 1, F.col("n_edges") / pairs).otherwise(0.0).alias("density"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges between kept(graph_id, node)."""
    end = lambda c: kept.select("graph_id", F.col("node").alias(c))
    return edges.join(end("u"), ["graph_id", "u"], "left_semi").join(end("v"), ["graph_id", "v"], "left_semi")


def pairs_of(nodes: DataFrame) -> DataFrame:
    """graph_id and m, the number of node pairs."""
    return nodes.groupBy("graph_id").agg((F.count("*") * (F.count("*") - 1) / 2).alias("m"))


def threshold_proportional(edges: DataFrame, nodes: DataFrame, p: float, rounding: str = "half_up") -> DataFrame:
    """The strongest share p of all node pairs by absolute weight, signs kept; at least one. Pairs without an edge
    count as weight 0 and come last. Ties go to the smaller (u, v)."""
    keep = pairs_of(nodes).select("graph_id", F.greatest(F.lit(1), rounded(F.lit(p) * F.col("m"), rounding)).alias("n_keep"))
    order = Window.partitionBy("graph_id").orderBy(F.abs("w").desc(), "u", "v")
    ranked = edges.where("w <> 0 AND u <> v").withColumn("rank", F.row_number().over(order))
    return ranked.join(F.broadcast(keep), "graph_id").where("rank <= n_keep").select("graph_id", "u", "v", "w")


def mean_graph(edges: DataFrame, subjects: DataFrame, name: str = "mean") -> DataFrame:
    """The elementwise mean over subjects(graph_id): a pair that a subject lacks counts as 0 there."""
    sums = edges.join(subjects.select("graph_id").distinct(), "graph_id", "left_semi").groupBy("u", "v").agg(F.sum("w").alias("w"))
    n = subjects.agg(F.countDistinct("graph_id").alias("n"))
    return sums.crossJoin(F.broadcast(n)).select(F.lit(name).alias("graph_id"), "u", "v", (F.col("w") / F.col("n")).alias("w"))


def dense(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every cell of each graph's matrix: graph_id, u, v, w, with 0 where there is no edge and on the diagonal."""
    u, v = (nodes.select("graph_id", F.col("node").alias(c)) for c in "uv")
    cells = u.join(v, "graph_id")
    return cells.join(both_ways(edges), ["graph_id", "u", "v"], "left").fillna({"w": 0.0})


def weight_range(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, low and high over the dense matrix: the diagonal and absent pairs are 0."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    ends = edges.groupBy("graph_id").agg(F.min("w").alias("a"), F.max("w").alias("b"))
    return n.join(ends, "graph_id", "left").select("graph_id", F.least(F.coalesce("a", F.lit(0.0)), F.lit(0.0)).alias("low"), F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(0.0)).alias("high"))


def lengths(edges: DataFrame) -> DataFrame:
    """Weights turned to lengths 1 / w."""
    return edges.where("w <> 0").withColumn("w", 1 / F.col("w"))


def node_key(node: Column, graph_id: Column | None = None) -> Column:
    """graph and node as one text that sorts like (graph_id, node) within a graph."""
    return F.concat(graph_id if graph_id is not None else F.col("graph_id"), F.lit(":"), F.lpad(node.cast("string"), 12, "0"))


def components(edges: DataFrame, nodes: DataFrame, scratch) -> DataFrame:
    """graph_id, node and component (its least node). Any non-zero weight joins; isolated nodes are their own."""
    from netfell.operators.components import component_labels

    keyed = edges.where("w <> 0 AND u <> v").select(node_key(F.col("u")).alias("u"), node_key(F.col("v")).alias("v"))
    labels = component_labels(keyed, scratch).select(F.col("node").alias("key"), F.substring_index("component", ":", -1).cast("int").alias("c"))
    keyed_nodes = nodes.select("graph_id", "node", node_key(F.col("node")).alias("key"))
    return keyed_nodes.join(labels, "key", "left").select("graph_id", "node", F.coalesce("c", "node").cast("int").alias("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("graph_id", "component").agg(F.count("*").alias("size"))


def two_largest(sizes: DataFrame) -> DataFrame:
    """graph_id, first and second: the two largest sizes; equal ones count twice, and a lone component has second 0."""
    order = Window.partitionBy("graph_id").orderBy(F.desc("size"), "component")
    ranked = sizes.withColumn("r", F.row_number().over(order)).where("r <= 2")
    pick = lambda r: F.coalesce(F.max(F.when(F.col("r") == r, F.col("size"))), F.lit(0))
    return ranked.groupBy("graph_id").agg(pick(1).alias("first"), pick(2).alias("second"))
