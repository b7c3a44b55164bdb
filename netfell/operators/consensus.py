"""From critical nodes of single graphs to a consensus over all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outliers(attacks: DataFrame, method: str = "iqr", iqr_k: float = 1.5, z_thresh: float = 3.0) -> DataFrame:
    """attacks(subject, final_attacks) with excluded: above the upper fence, or z_thresh population deviations above
    the mean, both over finite numbers alone. Subjects without a finite number stay in."""
    value = F.col("final_attacks").cast("double")
    sound = F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))
    finite = attacks.where(sound)
    if method == "iqr":
        q = finite.agg(F.percentile("final_attacks", [0.25, 0.75]).alias("q"))
        cut = q.select((F.col("q")[1] + iqr_k * (F.col("q")[1] - F.col("q")[0])).alias("cut"))
    elif method == "zscore":
        cut = finite.agg((F.avg("final_attacks") + z_thresh * F.stddev_pop("final_attacks")).alias("cut"))
    else:
        raise ValueError(f"no such method: {method}")
    return attacks.crossJoin(F.broadcast(cut)).withColumn("excluded", F.coalesce(sound & (value > F.col("cut")), F.lit(False))).drop("cut")


def votes(flags: DataFrame, denominator: str = "valid") -> DataFrame:
    """node, votes and score over flags(graph_id, node, is_critical): votes over all graphs, or over the graphs that
    have a critical node at all (``valid``)."""
    counted = flags.groupBy("node").agg(F.sum(F.col("is_critical").cast("long")).alias("votes"))
    some = flags.where("is_critical") if denominator == "valid" else flags
    n = some.agg(F.countDistinct("graph_id").alias("n"))
    return counted.crossJoin(F.broadcast(n)).select("node", "votes", F.coalesce(F.col("votes") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("score"))


def at_thresholds(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, node and score for each threshold that the score reaches."""
    cuts = scores.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return scores.crossJoin(F.broadcast(cuts)).where("score >= threshold").select("threshold", "node", "score")


def top_share(scores: DataFrame, q: float = 0.85, keys: list[str] | None = None) -> DataFrame:
    """scores with is_top: at least the q-quantile of its group (all rows without keys). If that is 0, all are."""
    keys = keys or []
    cut = scores.groupBy(*keys).agg(F.percentile("score", q).alias("cut"))
    joined = scores.join(F.broadcast(cut), keys) if keys else scores.crossJoin(F.broadcast(cut))
    return joined.withColumn("is_top", F.col("score") >= F.col("cut")).drop("cut")


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, n_both, n_any and jaccard of set a(node, a) with each set b(name, node, b), flags; 0 for empty unions."""
    both = b.join(a, "node", "left").groupBy("name").agg(F.sum((F.col("a") & F.col("b")).cast("long")).alias("n_both"), F.sum((F.col("a") | F.col("b")).cast("long")).alias("n_any"))
    return both.select("name", "n_both", "n_any", F.coalesce(F.col("n_both") / F.nullif("n_any", F.lit(0)), F.lit(0.0)).alias("jaccard"))


def zscores(metric: DataFrame) -> DataFrame:
    """metric(graph_id, node, value) with z by the graph's population deviation; NULL where that is 0."""
    own = Window.partitionBy("graph_id")
    return metric.withColumn("z", (F.col("value") - F.avg("value").over(own)) / F.nullif(F.stddev_pop("value").over(own), F.lit(0.0)))


def metric_consensus(metric: DataFrame, k: int) -> DataFrame:
    """node, votes and score: z-scored metric, k Ward clusters per graph, the cluster with the largest mean votes."""
    from netfell.operators import clustering

    z = zscores(metric).where("z IS NOT NULL")
    labels = clustering.clusters(z.select("graph_id", "node", F.array("z").alias("x")), k)
    flags = clustering.critical(labels.join(z.select("graph_id", "node", F.col("z").alias("total")), ["graph_id", "node"]))
    return votes(flags, "all")


def hub_comparison(percolation: DataFrame, metrics: dict[str, DataFrame], ks: tuple[int, ...] = (2, 3), q: float = 0.85) -> DataFrame:
    """metric, k and jaccard of the top share of a percolation consensus (node, score) with that of each hub metric's
    consensus for each k."""
    a = top_share(percolation, q).select("node", F.col("is_top").alias("a"))
    sets = None
    for name, metric in metrics.items():
        for k in ks:
            own = top_share(metric_consensus(metric, k).select("node", "score"), q).select(F.lit(f"{name}:{k}").alias("name"), "node", F.col("is_top").alias("b"))
            sets = own if sets is None else sets.unionByName(own)
    out = jaccard(a, sets)
    return out.select(F.substring_index("name", ":", 1).alias("metric"), F.substring_index("name", ":", -1).cast("int").alias("k"), "n_both", "n_any", "jaccard")
