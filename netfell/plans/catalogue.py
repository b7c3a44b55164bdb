"""Every query of the core engine by name. ``oracle.SQL`` answers those that SQL can express the same way.

Doubles are rounded to six places, so that sums in another order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netfell.functions.expressions import binarised, finite_or_zero, hazen, wilson_half_width
from netfell.operators import clustering, consensus, convergence, giant, graph, hubs, percolation, profiles, reports
from netfell.plans import graphs, oracle
from netfell.scratch import Scratch
from netfell.sources import files, sinks
from netfell.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ATTACKS, SEED, SHARE = oracle.ATTACKS, oracle.SEED, 0.10
CHUNK = oracle.CHUNK


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(column: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name or column)


def strongest(spark: SparkSession, sf_dir: str, p: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """The strongest edges of the 1995 trade graph."""
    edges, nodes = graphs.one_year(spark, sf_dir)
    return graph.threshold_proportional(edges, nodes, p), nodes


def participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = strongest(spark, sf_dir)
    return percolation.participation(percolation.hits(edges, nodes, ATTACKS, SEED), nodes)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations that take part earliest and most in the percolation of the 1995 trade graph."""
    return pip_hubs(spark, sf_dir)


# graphs


@query
def edge_build(spark, sf_dir):
    return graphs.trade(spark, sf_dir)[0].select("graph_id", "u", "v", r6("w"))


@query
def edge_minmax_merge(spark, sf_dir):
    return graph.graph_from_pairs(graphs.user_pairs(spark, sf_dir))[0].select("graph_id", "u", "v", r6("w"))


@query
def edge_unweighted(spark, sf_dir):
    return graph.graph_from_pairs(graphs.user_pairs(spark, sf_dir), weighted=False)[0].select("graph_id", "u", "v", r6("w"))


@query
def node_index(spark, sf_dir):
    return graph.graph_from_pairs(graphs.user_pairs(spark, sf_dir))[1]


@query
def self_loop_filter(spark, sf_dir):
    pairs = graphs.user_pairs(spark, sf_dir)
    return pairs.where("u IS NOT NULL AND v IS NOT NULL").groupBy((F.col("u") == F.col("v")).alias("is_loop")).agg(F.count("*").alias("n"))


@query
def degree_strength(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    kept = graph.threshold_proportional(edges, nodes, SHARE)
    return graph.strengths(kept, nodes).select("graph_id", "node", F.col("degree").cast("long").alias("degree"), r6("strength"))


@query
def edge_density(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    return graph.density(edges, nodes).select("graph_id", "n_nodes", "n_edges", r6("density"))


@query
def induced_subgraph(spark, sf_dir):
    edges, nodes = graphs.one_year(spark, sf_dir)
    inside = table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").cast("int").alias("node"))
    return graph.induced(edges, nodes.join(F.broadcast(inside), "node", "left_semi")).select("graph_id", "u", "v", r6("w"))


@query
def dense_matrix(spark, sf_dir):
    edges, nodes = strongest(spark, sf_dir)
    return graph.dense(edges, nodes).select("graph_id", "u", "v", r6("w"))


@query
def matrix_range(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    return graph.weight_range(edges, nodes).select("graph_id", r6("low"), r6("high"))


@query
def inverse_lengths(spark, sf_dir):
    edges, _ = graphs.copurchase(spark, sf_dir)
    return graph.lengths(edges).select("graph_id", "u", "v", r6("w"))


# thresholds and averages


@query
def threshold_top_p(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    parts = [graph.threshold_proportional(edges, nodes, p).withColumn("p", F.lit(p)) for p in (0.05, 0.10, 0.20)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("p", "graph_id", "u", "v", r6("w"))


@query
def threshold_ties(spark, sf_dir):
    edges, nodes = graphs.copurchase(spark, sf_dir)
    return graph.threshold_proportional(edges, nodes, 0.15).select("graph_id", "u", "v", r6("w"))


@query
def threshold_half_even(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    parts = [graph.threshold_proportional(edges, nodes, 0.115, rule).groupBy("graph_id").agg(F.count("*").alias("n_keep")).withColumn("rule", F.lit(rule)) for rule in ("half_up", "half_even")]
    return parts[0].unionByName(parts[1]).select("rule", "graph_id", "n_keep")


@query
def mean_graph_all(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    return graph.mean_graph(edges, nodes).select("graph_id", "u", "v", r6("w"))


@query
def mean_graph_included(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    sizes = edges.groupBy(F.col("graph_id").alias("subject")).agg(F.sum("w").alias("final_attacks"))
    kept = consensus.outliers(sizes, "iqr", 0.01).where("NOT excluded").select(F.col("subject").alias("graph_id"))
    mean = graph.mean_graph(edges, kept)
    name = nodes.select(F.lit("mean").alias("graph_id"), "node").distinct()
    return graph.threshold_proportional(mean, name, 0.05).select("graph_id", "u", "v", r6("w"))


@query
def outliers_iqr(spark, sf_dir):
    return consensus.outliers(graphs.order_counts(spark, sf_dir), "iqr", 0.1)


@query
def outliers_zscore(spark, sf_dir):
    return consensus.outliers(graphs.order_counts(spark, sf_dir), "zscore", z_thresh=1.0)


@query
def threshold_giant_sweep(spark, sf_dir):
    edges, nodes = graphs.one_year(spark, sf_dir)
    return giant.sweep(edges, nodes, 50).select("graph_id", "i", r6("threshold"), "gcc")


@query
def threshold_giant(spark, sf_dir):
    edges, nodes = graphs.one_year(spark, sf_dir)
    found = giant.giant_graph(edges, nodes, 0.75, 50)[1]
    return found.select("graph_id", "target", "i", r6("threshold"), "gcc", "n_edges", r6("density"))


# components


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graphs.trade(spark, sf_dir)
    return graph.components(graph.threshold_proportional(edges, nodes, 0.05), nodes, Scratch(spark, "components"))


@query
def connected_components(spark, sf_dir):
    return _components(spark, sf_dir)


@query
def component_sizes(spark, sf_dir):
    return graph.component_sizes(_components(spark, sf_dir))


@query
def second_component(spark, sf_dir):
    return graph.two_largest(graph.component_sizes(_components(spark, sf_dir)))


# percolation


@query
def attack_positions(spark, sf_dir):
    return percolation.attack_positions(graphs.one_year(spark, sf_dir)[1], ATTACKS, SEED)


@query
def percolation_trace(spark, sf_dir):
    return percolation.trace(*strongest(spark, sf_dir), ATTACKS, SEED)


@query
def percolation_point(spark, sf_dir):
    return percolation.percolation_points(*strongest(spark, sf_dir), ATTACKS, SEED)


@query
def step_counts(spark, sf_dir):
    edges, nodes = strongest(spark, sf_dir)
    return percolation.step_counts(percolation.percolation_points(edges, nodes, ATTACKS, SEED), nodes)


@query
def participation_matrix(spark, sf_dir):
    return participation(spark, sf_dir).select("graph_id", "step", "node", "n", "k", r6("p"))


@query
def pip_hubs(spark, sf_dir):
    weighted = profiles.fill(profiles.weight_linear(profiles.crop_longest(participation(spark, sf_dir))))
    named = profiles.node_sums(weighted).join(F.broadcast(graphs.nations(spark, sf_dir)), "node")
    return named.select("node", "label", r6("total")).orderBy(F.desc("total"), "node").limit(10)


# convergence


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges, nodes = strongest(spark, sf_dir)
    return percolation.hits(edges, nodes, ATTACKS, SEED, chunk=CHUNK), nodes


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.history(*_hits(spark, sf_dir), CHUNK)


def _plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.run_lengths(convergence.plateau(_history(spark, sf_dir), 3, 0.5, 0.05, 0.002))


@query
def wilson_hw(spark, sf_dir):
    cells = participation(spark, sf_dir)
    return cells.select("graph_id", "step", "node", r6(wilson_half_width(F.col("k"), F.col("n")), "hw"))


@query
def hw95_hazen(spark, sf_dir):
    cells = participation(spark, sf_dir).select("graph_id", wilson_half_width(F.col("k"), F.col("n")).alias("hw"))
    return cells.groupBy("graph_id").agg(r6(hazen(F.collect_list("hw"), 0.95), "hw95"))


@query
def conv_history(spark, sf_dir):
    return _history(spark, sf_dir).select("graph_id", "chunk", "n_attacks", r6("hw95"))


@query
def plateau_flags(spark, sf_dir):
    return _plateau(spark, sf_dir).select("graph_id", "chunk", r6("win_mean"), r6("win_range"), r6("win_slope"), "is_plateau", "run")


@query
def plateau_stop(spark, sf_dir):
    return convergence.stop_chunk(_plateau(spark, sf_dir), 2)


@query
def final_attacks(spark, sf_dir):
    return reports.final_attacks(_history(spark, sf_dir))


@query
def convergence_summary(spark, sf_dir):
    conv = _history(spark, sf_dir)
    hist = conv.groupBy(F.col("graph_id").alias("file")).agg(F.sort_array(F.collect_list(F.struct("n_attacks", "hw95"))).alias("hist"))
    meta = hist.select("file", F.lit(None).cast("double").alias("n_attacks_final"), F.lit(None).cast("double").alias("elapsed_sec"), "hist")
    return reports.convergence_summary(meta).select("file", "final_attacks", r6("final_hw95"), "elapsed_sec")


@query
def converge_loop(spark, sf_dir):
    edges, nodes = strongest(spark, sf_dir)
    params = convergence.ConvergeParams(max_attacks=2000, chunk_size=200, start=0.5, range_tol=0.05, slope_tol=1e-3, window=3, stable=2)
    return convergence.converge(edges, nodes, params)[2]


# profiles


@query
def crop_longest_any(spark, sf_dir):
    return profiles.crop_longest(graphs.activity(spark, sf_dir), "any").select("graph_id", "step", "node", r6("p"), "place", "n_steps")


@query
def crop_longest_all(spark, sf_dir):
    return profiles.crop_longest(graphs.activity(spark, sf_dir), "all").select("graph_id", "step", "node", r6("p"), "place", "n_steps")


@query
def weight_linear(spark, sf_dir):
    cells = profiles.weight_linear(profiles.crop_longest(graphs.activity(spark, sf_dir)))
    return cells.select("graph_id", "step", "node", r6("value"))


@query
def weight_flatten_clip(spark, sf_dir):
    return reports.surface(graphs.activity(spark, sf_dir)).select("graph_id", "step", "node", r6("value"))


def _tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.tilt(profiles.crop_longest(graphs.activity(spark, sf_dir)))


@query
def tilt_exp(spark, sf_dir):
    return _tilted(spark, sf_dir).select("graph_id", "step", "node", r6("value"))


@query
def tilt_peak_rank(spark, sf_dir):
    return profiles.peak_ranks(_tilted(spark, sf_dir).withColumn("value", F.round("value", 6))).select("graph_id", "node", "amp", "peak", "rank")


@query
def downsample_grid(spark, sf_dir):
    return profiles.downsample(_tilted(spark, sf_dir), 4, 5).select("graph_id", "grid_place", "grid_node", "place", "node", r6("value"))


@query
def nan_to_num_fill(spark, sf_dir):
    return graphs.activity(spark, sf_dir).select("graph_id", "step", "node", r6(finite_or_zero(F.col("p")), "p"))


@query
def simpson_auc(spark, sf_dir):
    cells = profiles.crop_longest(graphs.activity(spark, sf_dir))
    return profiles.area(cells, "p").select("graph_id", "node", r6("area"))


@query
def mean_node_pctl(spark, sf_dir):
    means = profiles.node_sums(profiles.crop_longest(graphs.activity(spark, sf_dir)), "p").withColumn("mean", F.round("mean", 6))
    return profiles.at_least_percentile(means, "mean", 0.75).select("graph_id", "node", "mean", r6("cut"))


# clustering


@query
def silhouette_by_label(spark, sf_dir):
    return clustering.silhouette(graphs.vectors(spark, sf_dir)).select("graph_id", r6("silhouette"))


def _label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = graphs.vectors(spark, sf_dir).select("graph_id", "node", "label", F.get("x", F.lit(0)).alias("total"))
    return first


@query
def cluster_stats(spark, sf_dir):
    return clustering.cluster_stats(_label_totals(spark, sf_dir)).select("graph_id", "label", "size", r6("mean"), r6("sd"), r6("z"))


@query
def critical_cluster_argmax(spark, sf_dir):
    return clustering.critical(_label_totals(spark, sf_dir))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.feature_vectors(profiles.fill(profiles.weight_linear(profiles.crop_longest(graphs.activity(spark, sf_dir)))))


@query
def ward_linkage(spark, sf_dir):
    return clustering.linkage(_profiles(spark, sf_dir)).withColumn("height", F.round("height", 6))


@query
def ward_cut_k(spark, sf_dir):
    return clustering.clusters(_profiles(spark, sf_dir), 3)


@query
def optimal_k(spark, sf_dir):
    return clustering.optimal_clusters(_profiles(spark, sf_dir)).groupBy("graph_id").agg(F.first("k").alias("k"), F.countDistinct("label").alias("n_labels"))


@query
def critical_nodes(spark, sf_dir):
    return clustering.critical_nodes(graphs.activity(spark, sf_dir))


@query
def critical_nodes_by_area(spark, sf_dir):
    return clustering.critical_nodes_by_area(graphs.activity(spark, sf_dir))


# consensus


def _hub_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest nations of each year: the top 15 % by strength."""
    edges, nodes = graphs.trade(spark, sf_dir)
    scores = graph.strengths(edges, nodes).withColumn("score", F.round("strength", 2))
    return consensus.top_share(scores, 0.85, ["graph_id"]).select("graph_id", "node", "score", "is_top")


def _votes(spark: SparkSession, sf_dir: str, denominator: str) -> DataFrame:
    return consensus.votes(_hub_flags(spark, sf_dir).select("graph_id", "node", F.col("is_top").alias("is_critical")), denominator)


@query
def top15_binary(spark, sf_dir):
    return _hub_flags(spark, sf_dir)


@query
def consensus_votes_all(spark, sf_dir):
    return _votes(spark, sf_dir, "all").select("node", "votes", r6("score"))


@query
def consensus_votes_valid(spark, sf_dir):
    return _votes(spark, sf_dir, "valid").select("node", "votes", r6("score"))


@query
def consensus_thresholds(spark, sf_dir):
    return consensus.at_thresholds(_votes(spark, sf_dir, "valid"), [0.25, 0.5, 0.75]).select("threshold", "node", r6("score"))


@query
def jaccard_table(spark, sf_dir):
    flags = _hub_flags(spark, sf_dir)
    first = flags.where("graph_id = 'trade_1995'").select("node", F.col("is_top").alias("a"))
    return consensus.jaccard(first, flags.select(F.col("graph_id").alias("name"), "node", F.col("is_top").alias("b"))).select("name", "n_both", "n_any", r6("jaccard"))


@query
def zscore_metric(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    metric = graph.strengths(edges, nodes).select("graph_id", "node", F.col("strength").alias("value"))
    return consensus.zscores(metric).select("graph_id", "node", r6("z"))


@query
def metric_consensus_k2(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    return consensus.metric_consensus(graph.strengths(edges, nodes).select("graph_id", "node", F.col("strength").alias("value")), 2)


@query
def hub_comparison(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    kept = graph.threshold_proportional(edges, nodes, 0.20)
    metrics = {
        "degree": graph.strengths(kept, nodes).select("graph_id", "node", F.col("strength").alias("value")),
        "betweenness": hubs.betweenness(kept, nodes, weighted=True),
        "pagerank": hubs.pagerank_solved(kept, nodes),
    }
    return consensus.hub_comparison(_votes(spark, sf_dir, "valid").select("node", "score"), metrics)


# hub metrics


@query
def pagerank(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    return hubs.pagerank_solved(graph.threshold_proportional(edges, nodes, SHARE), nodes).select("graph_id", "node", r6("value"))


@query
def betweenness_binary(spark, sf_dir):
    return hubs.betweenness(*strongest(spark, sf_dir)).select("graph_id", "node", r6("value"))


@query
def betweenness_weighted(spark, sf_dir):
    return hubs.betweenness(*strongest(spark, sf_dir), weighted=True).select("graph_id", "node", r6("value"))


# joins and reports


@query
def label_lookup_left(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).cast("int").alias("node")).distinct()
    return reports.labelled(wanted, graphs.nations(spark, sf_dir))


@query
def subject_intersect(spark, sf_dir):
    year = lambda y: table(spark, sf_dir, "orders").where(F.year("o_orderdate") == y).select("o_custkey")
    return year(1995).intersect(year(1996))


@query
def top_nodes_text(spark, sf_dir):
    return reports.top_nodes_text(_hub_flags(spark, sf_dir).withColumnRenamed("is_top", "is_critical"))


@query
def binary_edges(spark, sf_dir):
    edges, _ = graphs.copurchase(spark, sf_dir)
    mean = edges.agg(F.avg("w").alias("m"))
    return edges.crossJoin(F.broadcast(mean)).select("graph_id", "u", "v", binarised(F.col("w"), F.col("m")).alias("w"))


@query
def heatmap_panels(spark, sf_dir):
    edges, nodes = graphs.trade(spark, sf_dir)
    return reports.heatmap(graph.threshold_proportional(edges, nodes, 0.05), nodes, 4).select("graph_id", "u", "v", r6("w"), "row", "col")


# written tables, read back by their readers


def _stored(spark: SparkSession) -> Scratch:
    return Scratch(spark, "stored")


@query
def stored_edge_list(spark, sf_dir):
    path = _stored(spark).path("edges.csv")
    sinks.text_table(graphs.user_pairs(spark, sf_dir).where("v IS NOT NULL").select("u", "v", "w"), path, ["u", "v", "w"])
    return graph.graph_from_pairs(files.edge_pairs(spark, path, "users"))[0].select("graph_id", "u", "v", r6("w"))


@query
def stored_matrices(spark, sf_dir):
    path = _stored(spark).path("participation")
    sinks.matrices(participation(spark, sf_dir), path)
    return spark.read.parquet(path).select("graph_id", "step", "node", "n", "k", r6("p"))


@query
def stored_bundle(spark, sf_dir):
    path, (edges, nodes) = _stored(spark).path("mean"), graphs.trade(spark, sf_dir)
    sinks.bundle({"adjacency": edges, "labels": nodes}, path)
    return graph.strengths(spark.read.parquet(f"{path}/adjacency"), spark.read.parquet(f"{path}/labels")).select("graph_id", "node", F.col("degree").cast("long").alias("degree"), r6("strength"))


@query
def stored_outliers(spark, sf_dir):
    """The adjacency files of the subjects that an outlier table keeps."""
    path, flagged = _stored(spark).path("outliers.csv"), outliers_iqr(spark, sf_dir)
    shown = flagged.select(F.concat("subject", F.lit("_ConvHW.mat")).alias("subject"), "final_attacks", "excluded")
    sinks.outlier_table(shown, path)
    read = spark.read.option("header", True).csv(path)
    listed = _stored(spark).path("inclusion.csv")
    sinks.text_table(read.select(F.col("subject").alias("subject_file"), F.col("excluded")), listed, ["subject_file"])
    return files.included_subjects(spark, listed)


@query
def stored_consensus(spark, sf_dir):
    path = _stored(spark).path("consensus.csv")
    sinks.consensus_vector(_votes(spark, sf_dir, "valid"), path)
    return spark.read.option("header", True).schema("node int, score double").csv(path).select("node", r6("score"))


@query
def stored_top_nodes(spark, sf_dir):
    """Indices written as one column, read back and given their labels."""
    path = _stored(spark).path("indices.txt")
    sinks.text_table(_hub_flags(spark, sf_dir).where("is_top").select("node").distinct(), path, ["node"], header=False)
    return reports.labelled(files.indices(spark, path), graphs.nations(spark, sf_dir))


@query
def stored_labels(spark, sf_dir):
    path = _stored(spark).path("labels.csv")
    sinks.text_table(graphs.nations(spark, sf_dir).select("label"), path, ["label"])
    return files.labels(spark, path)


@query
def stored_coordinates(spark, sf_dir):
    """Suppliers' numbers and nations as places, written in three columns parted by tabs."""
    path = _stored(spark).path("places.txt")
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("x"), F.col("s_nationkey").cast("long").alias("y"), F.lit(0).cast("long").alias("z"))
    sinks.text_table(places, path, ["x"], header=False, sep="\t")
    return files.coordinates(spark, path)


@query
def stored_files(spark, sf_dir):
    """Graphs written as a file each, listed by pattern in order of their names."""
    scratch = _stored(spark)
    for year in (1994, 1995, 1996):
        sinks.text_table(graphs.trade(spark, sf_dir)[0].where(F.col("graph_id") == f"trade_{year}").select("u", "v", "w"), scratch.path(f"all/y{year}_trade.csv"), ["u", "v"])
    listed = files.files(spark, scratch.path("all/y199*_trade.csv"), "part-*.csv")
    return listed.select(F.regexp_extract("path", "/(y[0-9]+_trade)", 1).alias("graph"), files.subject_prefix(F.regexp_extract("path", "/(y[0-9]+_trade)", 1)).alias("prefix")).distinct()


def oracles() -> dict[str, str]:
    return {name: sql for name, sql in oracle.SQL.items() if name in QUERIES}
