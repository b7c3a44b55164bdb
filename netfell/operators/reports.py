"""Tables ready to show or draw: summaries, labelled nodes, surfaces, heatmaps, markers and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfell.operators import profiles
from netfell.operators.graph import dense


def convergence_summary(meta: DataFrame) -> DataFrame:
    """file, final_attacks, final_hw95 and elapsed_sec from meta(file, n_attacks_final, elapsed_sec, hist array of
    n_attacks and hw95): the last finite entries count where no final number is given; NULL where nothing is known."""
    finite = lambda name: F.filter(F.transform("hist", lambda h: h[name].cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    last = lambda name: F.try_element_at(finite(name), F.lit(-1))
    return meta.select("file", F.coalesce(F.col("n_attacks_final").cast("double"), last("n_attacks")).alias("final_attacks"), last("hw95").alias("final_hw95"), F.col("elapsed_sec").cast("double").alias("elapsed_sec"))


def final_attacks(history: DataFrame) -> DataFrame:
    """graph_id and the attacks of its last chunk."""
    return history.groupBy("graph_id").agg(F.max_by("n_attacks", "chunk").alias("final_attacks"))


def labelled(indices: DataFrame, labels: DataFrame) -> DataFrame:
    """index_0based, index_1based and label, empty where the index has none."""
    found = indices.select("node").join(F.broadcast(labels.select("node", "label")), "node", "left")
    return found.select(F.col("node").alias("index_0based"), (F.col("node") + 1).alias("index_1based"), F.coalesce("label", F.lit("")).alias("label"))


def top_nodes_text(flags: DataFrame) -> DataFrame:
    """graph_id and a line that lists its critical nodes."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda n: n.cast("string")), ", ")
    return flags.where("is_critical").groupBy("graph_id").agg(F.concat(F.lit("Top cluster node indices: "), listed).alias("line"))


def placed(scores: DataFrame, coords: DataFrame) -> DataFrame:
    """Scores with x, y and z of their nodes; nodes without a place are left out."""
    return scores.join(F.broadcast(coords), "node")


def markers(scores: DataFrame, coords: DataFrame, threshold: float | None = None) -> DataFrame:
    """Placed scores, those that reach the threshold if there is one."""
    return placed(scores.where(F.col("score") >= threshold) if threshold is not None else scores, coords)


def highlighted(scores: DataFrame) -> DataFrame:
    """scores with value = score where is_top, else 0."""
    return scores.withColumn("value", F.col("score") * F.col("is_top").cast("double"))


def surface(cells: DataFrame) -> DataFrame:
    """graph_id, step, node and value: strict crop and flattened weights."""
    return profiles.weight_flattened(profiles.crop_longest(cells, "any")).select("graph_id", "step", "node", "value")


def tilted_surface(cells: DataFrame, clip_negative: bool = True, max_steps: int | None = None, max_nodes: int | None = None, k: int = 66) -> tuple[DataFrame, DataFrame]:
    """The tilted grid, sampled if it is to be smaller, and the k first nodes by peak with places before sampling."""
    tilted = profiles.tilt(profiles.crop_longest(cells), clip_negative=clip_negative)
    grid = profiles.downsample(tilted, max_steps or 1 << 30, max_nodes or 1 << 30) if max_steps or max_nodes else tilted
    return grid, profiles.peak_ranks(tilted).where(F.col("rank") <= k)


def compared(old: DataFrame, new: DataFrame, k: int = 66) -> tuple[DataFrame, DataFrame]:
    """Both versions' unclipped surfaces for the prefixes they share (side, graph_id, step, node, value), and their
    common range. old and new have prefix, path and the cells; of a prefix's files the last path counts."""
    sides = []
    for side, cells in (("old", old), ("new", new)):
        last = cells.groupBy("prefix").agg(F.max("path").alias("path"))
        own = cells.join(F.broadcast(last), ["prefix", "path"], "left_semi").withColumn("graph_id", F.col("prefix"))
        sides.append((side, tilted_surface(own.select("graph_id", "step", "node", "p"), clip_negative=False, k=k)[0]))
    (_, a), (_, b) = sides
    both = a.select("graph_id").distinct().intersect(b.select("graph_id").distinct())
    rows = [s.join(F.broadcast(both), "graph_id", "left_semi").select(F.lit(side).alias("side"), "graph_id", "step", "node", "value") for side, s in sides]
    return rows[0].unionByName(rows[1]), profiles.shared_range(*rows)


def panels(graphs: DataFrame, columns: int) -> DataFrame:
    """graph_id with the row and column of its panel, in order of name."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("graph_id")) - 1  # a row for each graph
    return graphs.select("graph_id").distinct().withColumn("i", place).select("graph_id", F.floor(F.col("i") / columns).cast("int").alias("row"), (F.col("i") % columns).cast("int").alias("col"))


def heatmap(edges: DataFrame, nodes: DataFrame, columns: int = 5) -> DataFrame:
    """Every cell of each graph's matrix with its panel's place."""
    return dense(edges, nodes).join(F.broadcast(panels(nodes, columns)), "graph_id")


def mean_node_markers(cells: DataFrame, coords: DataFrame, q: float = 0.95) -> DataFrame:
    """node, mean participation and place of the nodes at or above the q-quantile of the cropped matrix's means."""
    means = profiles.node_sums(profiles.crop_longest(cells), "p").select("graph_id", "node", "mean")
    return placed(profiles.at_least_percentile(means, "mean", q), coords)


def runtimes(meta: DataFrame) -> DataFrame:
    """graph_id, final_attacks and elapsed_min."""
    return meta.select("graph_id", "final_attacks", (F.col("elapsed_sec") / 60).alias("elapsed_min"))


def cluster_markers(flags: DataFrame, coords: DataFrame) -> DataFrame:
    """The critical nodes' places, with the graph's number of clusters and of critical nodes."""
    size = flags.groupBy("graph_id").agg(F.countDistinct("label").alias("k"), F.sum(F.col("is_critical").cast("long")).alias("n_top"))
    return placed(flags.where("is_critical").join(F.broadcast(size), "graph_id"), coords).select("graph_id", "node", "x", "y", "z", "k", "n_top")
