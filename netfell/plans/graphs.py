"""Graphs made from the relational tables, which the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netfell.tables import table


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node and label: the 25 nations."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("node"), F.col("n_name").alias("label"))


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph for each order year: nations, joined by the revenue between customers of one and suppliers of the other.

    Revenue is summed as decimals, so that the order of rows does not matter."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    sold = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sold = sold.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    graph = F.concat(F.lit("trade_"), F.col("year")).alias("graph_id")
    ends = F.least("c_nationkey", "s_nationkey").cast("int").alias("u"), F.greatest("c_nationkey", "s_nationkey").cast("int").alias("v")
    edges = sold.groupBy(graph, *ends).agg(F.sum("r").cast("double").alias("w"))
    years = table(spark, sf_dir, "orders").select(F.concat(F.lit("trade_"), F.year("o_orderdate")).alias("graph_id")).distinct()
    return edges, years.crossJoin(F.broadcast(nations(spark, sf_dir)))  # 25 rows a year


def one_year(spark: SparkSession, sf_dir: str, year: int = 1995) -> tuple[DataFrame, DataFrame]:
    edges, nodes = trade(spark, sf_dir)
    return edges.where(F.col("graph_id") == f"trade_{year}"), nodes.where(F.col("graph_id") == f"trade_{year}")


def copurchase(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brands, joined by the number of orders that hold both; whole numbers, so that many weights are equal."""
    held = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label")).distinct()
    nodes = brands.select(F.lit("copurchase").alias("graph_id"), (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("node"), "label")  # one row a brand
    named = held.join(F.broadcast(nodes), F.col("p_brand") == F.col("label")).select("l_orderkey", "node")
    of = lambda c: named.select("l_orderkey", F.col("node").alias(c))
    pairs = of("u").join(of("v"), "l_orderkey").where("u < v")  # an order has at most a few brands
    return pairs.groupBy(F.lit("copurchase").alias("graph_id"), "u", "v").agg(F.count("*").cast("double").alias("w")), nodes


def user_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list in text as files have it: each event's user and the next one's of that type and day, with the value
    less 50 as weight, some of it no number, some below 0, with self-loops and repeated pairs."""
    after = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("u"), F.lead(F.col("user_id").cast("string")).over(after).alias("v"), (F.col("value") - 50).alias("x"))
    weight = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("x").cast("decimal(18,3)").cast("string"))
    return rows.select(F.lit("users").alias("graph_id"), "u", "v", weight.alias("w"))


def activity(spark: SparkSession, sf_dir: str, nodes: int = 12) -> DataFrame:
    """A matrix for each event type: steps are days from the first, nodes groups of users, p the share of events with a
    value above 50; NULL where a group has fewer than two events that day."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), (F.col("user_id") % nodes).cast("int").alias("node"), "value")
    first = events.agg(F.min("day").alias("first"))
    rows = events.crossJoin(F.broadcast(first)).select(F.col("event_type").alias("graph_id"), (F.datediff("day", "first") + 1).alias("step"), "node", "value")
    share = rows.groupBy("graph_id", "step", "node").agg((F.sum(F.when(F.col("value") > 50, 1).otherwise(0)) / F.count("*")).alias("p"), F.count("*").alias("n"))
    share = share.where("n >= 2").drop("n")
    last = rows.groupBy("graph_id").agg(F.max("step").alias("last"))
    grid = last.select("graph_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("step")).select("graph_id", "step", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"))
    return grid.join(share, ["graph_id", "step", "node"], "left")


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject and final_attacks: nations and their orders."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(F.broadcast(nations(spark, sf_dir)), F.col("c_nationkey") == F.col("node")).groupBy(F.col("label").alias("subject")).agg(F.count("*").cast("double").alias("final_attacks"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as one graph of vectors with their labels."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lit("embeddings").alias("graph_id"), F.col("vec_id").cast("int").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label")
