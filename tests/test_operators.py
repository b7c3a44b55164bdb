"""Small cases of graphs, thresholds, profiles, clusters, consensus and hubs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netfell.functions import expressions as X
from netfell.operators import clustering, consensus, convergence, giant, graph, hubs, profiles, reports
from netfell.scratch import Scratch

EDGE = "graph_id string, u int, v int, w double"


def nodes_of(spark, n, name="g"):
    return spark.createDataFrame([(name, i) for i in range(n)], "graph_id string, node int")


def test_edge_list_rules(spark):
    pairs = spark.createDataFrame(
        [("g", "b", "a", "2"), ("g", "a", "b", "3"), ("g", "c", "c", "9"), ("g", "a", "d", "-1"), ("g", "a", "e", "x"), ("g", None, "z", "1"), ("g", "d", "e", "nan"), ("g", "", "a", None)],
        "graph_id string, u string, v string, w string",
    )
    edges, nodes = graph.graph_from_pairs(pairs)
    names = {r.node: r.label for r in nodes.collect()}
    assert sorted(names.values()) == ["", "a", "b", "c", "d", "e"]
    assert sorted((*sorted((names[r.u], names[r.v])), r.w) for r in edges.collect()) == [("", "a", 1.0), ("a", "b", 3.0), ("a", "e", 1.0)]


def test_threshold_ties_signs_and_rounding(spark):
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 0, 2, -3.0), ("g", 1, 2, 1.0), ("g", 1, 3, 1.0), ("g", 2, 3, 0.0)], EDGE)
    kept = lambda p, rule="half_up": sorted((r.u, r.v, r.w) for r in graph.threshold_proportional(edges, nodes_of(spark, 4), p, rule).collect())
    assert kept(0.34) == [(0, 1, 1.0), (0, 2, -3.0)]
    assert kept(0.0) == [(0, 2, -3.0)]
    assert len(kept(1.0)) == 4
    assert (len(kept(2.5 / 6)), len(kept(2.5 / 6, "half_even"))) == (3, 2)


def test_components_and_sizes(spark):
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, -1.0), ("g", 4, 5, 1.0), ("h", 0, 5, 1.0)], EDGE)
    nodes = nodes_of(spark, 7).unionAll(nodes_of(spark, 6, "h"))
    labelled = graph.components(edges, nodes, Scratch(spark, "t"))
    assert [r.component for r in labelled.where("graph_id = 'g'").orderBy("node").collect()] == [0, 0, 0, 3, 4, 4, 6]
    two = {r.graph_id: (r.first, r.second) for r in graph.two_largest(graph.component_sizes(labelled)).collect()}
    assert two == {"g": (3, 2), "h": (2, 1)}


def test_long_path_is_one_component(spark):
    from netfell.operators.components import component_labels

    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    labels = component_labels(path, Scratch(spark, "t"))
    assert labels.count() == 201 and labels.select("component").distinct().collect()[0][0] == 0
    assert component_labels(path.limit(0), Scratch(spark, "t")).count() == 0


def test_giant_sweep_against_components(spark):
    rng = np.random.default_rng(0)
    rows = [("g", i, j, float(rng.integers(1, 9))) for i in range(8) for j in range(i + 1, 8) if rng.random() < 0.5]
    edges, nodes = spark.createDataFrame(rows, EDGE), nodes_of(spark, 8)
    for r in giant.sweep(edges, nodes, 9).collect():
        label = list(range(8))
        for _ in range(8):
            for _, a, b, w in rows:
                if w > r.threshold:
                    label[a] = label[b] = min(label[a], label[b])
        assert r.gcc == max(label.count(x) for x in label)
    assert giant.sweep(edges.limit(0), nodes, 3).agg(F.max("gcc")).first()[0] == 1


def test_hazen_wilson_and_simpson(spark):
    values = [3.0, 1.0, None, 2.0, 10.0]
    row = spark.createDataFrame([(values,)], "v array<double>").select(X.hazen(F.col("v"), 0.95).alias("a"), X.hazen(F.col("v"), 0.5).alias("b"), X.wilson_half_width(F.lit(3), F.lit(0)).alias("c"), X.wilson_half_width(F.lit(0), F.lit(10)).alias("d")).first()
    assert (row.a, row.b, row.c) == (10.0, 2.5, None) and math.isclose(row.d, 1.96 * (1.96 / 20) / (1 + 1.96**2 / 10))
    for n, area in ((1, 0.0), (2, 2.0), (3, 8 / 3 + 4 - 2 * 2 + 0.0), (4, None), (5, None)):
        y = [1.0 + i * i for i in range(n)]
        got = spark.range(n).select(F.sum((1.0 + F.col("id") * F.col("id")) * X.simpson_weight(F.col("id"), F.lit(n)))).first()[0]
        exact = (n - 1) + (n - 1) ** 3 / 3
        assert math.isclose(got, exact if n > 2 else area if n == 1 else (y[0] + y[1]) / 2)


def test_crop_prefers_the_first_of_equal_runs(spark):
    rows = [("g", s, n, None if s in (3, 6) or (s == 8 and n == 0) else 1.0 * s) for s in range(1, 10) for n in range(2)]
    cells = spark.createDataFrame(rows, "graph_id string, step int, node int, p double")
    steps = lambda rule: sorted({r.step for r in profiles.crop_longest(cells, rule).collect()})
    assert steps("all") == [7, 8, 9] and steps("any") == [1, 2]
    assert profiles.crop_longest(cells.withColumn("p", F.lit(None).cast("double"))).count() == 0


def test_plateau_needs_a_full_window_and_holds(spark):
    hw = [0.5, 0.04, 0.04, 0.04, 0.04, 0.2, 0.04, 0.04, 0.04, 0.04]
    conv = spark.createDataFrame([("g", i, (i + 1) * 100, x) for i, x in enumerate(hw)], "graph_id string, chunk long, n_attacks long, hw95 double")
    runs = convergence.run_lengths(convergence.plateau(conv, 3, 0.05, 0.005, 1e-5))
    assert [r.run for r in runs.orderBy("chunk").collect()] == [0, 0, 0, 1, 2, 0, 0, 0, 1, 2]
    assert convergence.stop_chunk(runs, 2).first()[1:] == (4, 500, True)
    assert convergence.stop_chunk(runs, 3).first()[1:] == (None, 1000, False)


def test_converging_run_stops_and_counts_only_what_it_used(spark):
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 3, 4, 1.0), ("g", 4, 5, 1.0), ("g", 2, 6, 1.0), ("g", 6, 3, 1.0)], EDGE)
    params = convergence.ConvergeParams(max_attacks=2000, chunk_size=100, start=1.0, range_tol=1.0, slope_tol=1.0, window=3, stable=2)
    cells, conv, stops = convergence.converge(edges, nodes_of(spark, 7), params)
    assert stops.first()["final_attacks"] == 400 and [r.chunk for r in conv.orderBy("chunk").collect()] == [0, 1, 2, 3]
    assert cells.select("step", "n").distinct().agg(F.sum("n")).first()[0] == 400


def slow_ward(x):
    held, out = {i: [i] for i in range(len(x))}, []
    while len(held) > 1:
        cost = lambda a, b: 2 * len(held[a]) * len(held[b]) / (len(held[a]) + len(held[b])) * ((x[held[a]].mean(0) - x[held[b]].mean(0)) ** 2).sum()
        d, a, b = min((cost(a, b), a, b) for a in held for b in held if a < b)
        held[len(x) + len(out)] = held.pop(a) + held.pop(b)
        out.append((a, b, math.sqrt(d)))
    return out


def test_ward_against_least_increase():
    rng = np.random.default_rng(1)
    for n in (2, 3, 7, 12):
        x = rng.normal(size=(n, 3))
        fast, slow = clustering.ward(x), slow_ward(x)
        assert [m[:2] for m in fast] == [m[:2] for m in slow] and np.allclose([m[2] for m in fast], [m[2] for m in slow])
        assert [len(set(clustering.cut(fast, n, k))) for k in range(1, n + 1)] == list(range(1, n + 1))


def test_equal_merges_leave_fewer_clusters():
    x = np.array([[0.0], [1.0], [10.0], [11.0]])
    assert len(set(clustering.cut(clustering.ward(x), 4, 3))) == 2


def test_silhouette_of_singletons_and_equal_points():
    d = clustering.distances(np.array([[0.0], [0.0], [5.0]]))
    assert clustering.silhouettes(d, np.array([1, 1, 2])).tolist() == [1.0, 1.0, 1.0]
    assert clustering.silhouettes(np.zeros((3, 3)), np.array([1, 2, 2])).tolist() == [0.0, 0.0, 0.0]
    assert clustering.silhouettes(d, np.array([1, 1, 1])).tolist() == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("rows", [7, 2000])
def test_silhouette_by_blocks_against_one_matrix(spark, rows):
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(40, 3)), rng.integers(0, 4, 40)
    x[5], labels[9] = x[4], 7  # equal points, and a point alone
    x, labels = np.concatenate([x, x[:2]]), np.concatenate([labels, labels[:2]])  # and repeated rows
    nodes = [*range(40), 0, 1]
    df = spark.createDataFrame([("g", n, p.tolist(), int(k)) for n, p, k in zip(nodes, x, labels, strict=True)] + [("one", n, [float(n)], 1) for n in range(9)], "graph_id string, node int, x array<double>, label int")
    got = {r.graph_id: r.silhouette for r in clustering.silhouette(df, rows).collect()}
    assert got == pytest.approx({"g": clustering.silhouettes(clustering.distances(x), labels).mean(), "one": 0.0})


def test_silhouette_above_the_nodes_of_one_task(spark):
    n = clustering.MOST_NODES + 1  # even points at 0, odd ones at 1
    df = spark.range(n).selectExpr("'g' AS graph_id", "CAST(id AS INT) AS node", "array(CAST(id % 2 AS DOUBLE)) AS x", "CAST(id % 2 AS INT) AS label")
    assert clustering.silhouette(df).collect()[0].silhouette == 1.0


def test_critical_nodes_finds_the_early_pair(spark):
    rows = [("g", s, n, (1.0 if n in (2, 5) else 0.1) if s < 6 else 0.5) for s in range(1, 9) for n in range(8)]
    cells = spark.createDataFrame(rows, "graph_id string, step int, node int, p double")
    assert sorted(r.node for r in clustering.critical_nodes(cells).where("is_critical").collect()) == [2, 5]
    assert sorted(r.node for r in clustering.critical_nodes_by_area(cells).where("is_critical").collect()) == [2, 5]


#: Final attacks of 21 subjects, in thousands of ten: two stand out.
def test_outliers_by_fence_and_deviation(spark):
    rows = [(f"s{i}", float(x)) for i, x in enumerate([10, 11, 12, 13, 14, 15, 16, 90])] + [("missing", None)]
    df = spark.createDataFrame(rows, "subject string, final_attacks double")
    out = lambda *a, **k: {r.subject for r in consensus.outliers(df, *a, **k).where("excluded").collect()}
    assert out("iqr") == {"s7"} and out("zscore", z_thresh=2.0) == {"s7"} and out("zscore") == set()
    with pytest.raises(ValueError, match="method"):
        consensus.outliers(df, "other")


def test_votes_and_denominators(spark):
    flags = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("b", 0, True), ("b", 1, True), ("c", 0, False), ("c", 1, False)], "graph_id string, node int, is_critical boolean")
    score = lambda d: {r.node: r.score for r in consensus.votes(flags, d).collect()}
    assert score("valid") == {0: 1.0, 1: 0.5}
    assert score("all") == {0: 2 / 3, 1: 1 / 3}
    none = flags.withColumn("is_critical", F.lit(False))
    assert {r.score for r in consensus.votes(none, "valid").collect()} == {0.0}
    tops = consensus.top_share(consensus.votes(none, "valid"))
    assert all(r.is_top for r in tops.collect())


def test_pagerank_solve_and_rounds_agree(spark):
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 2.0), ("g", 1, 3, 0.5)], EDGE)
    a = {r.node: r.value for r in hubs.pagerank(edges, nodes_of(spark, 5), rounds=60, scratch=Scratch(spark, "t")).collect()}
    b = {r.node: r.value for r in hubs.pagerank_solved(edges, nodes_of(spark, 5)).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-4) for k in a) and math.isclose(sum(b.values()), 1.0)


def test_betweenness_by_hand(spark):
    path = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 2, 3, 1.0)], EDGE)
    value = lambda e, **k: [r.value for r in hubs.betweenness(e, nodes_of(spark, 5), **k).orderBy("node").collect()]
    assert value(path) == [0.0, 4.0, 4.0, 0.0, 0.0]
    heavy = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 0, 2, 4.0), ("g", 2, 1, 4.0)], EDGE)
    assert value(heavy, weighted=True) == [0.0, 0.0, 2.0, 0.0, 0.0]
    square = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 2, 3, 1.0), ("g", 0, 3, 1.0)], EDGE)
    assert value(square) == [1.0, 1.0, 1.0, 1.0, 0.0]


def test_summary_uses_the_last_finite_values(spark):
    hist = "array<struct<n_attacks:long,hw95:double>>"
    meta = spark.createDataFrame(
        [("a", None, 60.0, [(100, 0.5), (200, float("nan"))]), ("b", 7.0, None, []), ("c", None, None, None)], f"file string, n_attacks_final double, elapsed_sec double, hist {hist}"
    )
    got = {r.file: (r.final_attacks, r.final_hw95, r.elapsed_sec) for r in reports.convergence_summary(meta).collect()}
    assert got == {"a": (200.0, 0.5, 60.0), "b": (7.0, None, None), "c": (None, None, None)}


def test_labels_out_of_range_are_empty(spark):
    labels = spark.createDataFrame([(0, "x"), (1, "y")], "node int, label string")
    rows = reports.labelled(spark.createDataFrame([(1,), (9,)], "node int"), labels).orderBy("index_0based").collect()
    assert [tuple(r) for r in rows] == [(1, 2, "y"), (9, 10, "")]


def test_compared_surfaces_share_subjects_and_range(spark):
    row = lambda p, path, x: [(p, path, s, n, x * s) for s in range(1, 4) for n in range(2)]
    schema = "prefix string, path string, step int, node int, p double"
    old = spark.createDataFrame(row("A", "A_1", 0.1) + row("A", "A_2", 0.2) + row("B", "B_1", 0.3), schema)
    new = spark.createDataFrame(row("A", "A_9", -0.1) + row("C", "C_1", 0.1), schema)
    cells, limits = reports.compared(old, new)
    assert {r.graph_id for r in cells.collect()} == {"A"} and cells.count() == 12
    low, high = limits.first()
    assert low < 0 < high


def test_rounds_agree_with_one_batch(spark):
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 3, 4, 1.0), ("g", 4, 5, 1.0), ("g", 2, 6, 1.0), ("g", 6, 3, 1.0)], EDGE)
    nodes = nodes_of(spark, 7)
    params = convergence.ConvergeParams(max_attacks=900, chunk_size=100, start=1.0, range_tol=1e-9, slope_tol=1e-12, window=3, stable=2)
    cells, conv, stops = convergence.converge(edges, nodes, params)
    from netfell.operators import percolation

    hit = percolation.hits(edges, nodes, 900, params.seed, "philox", chunk=100)
    batch = [(r.chunk, r.n_attacks, round(r.hw95, 9)) for r in convergence.history(hit, nodes, 100).orderBy("chunk").collect()]
    assert [(r.chunk, r.n_attacks, round(r.hw95, 9)) for r in conv.orderBy("chunk").collect()] == batch
    assert stops.first()[1:] == (None, 900, False)
    key = lambda d: sorted((r.step, r.node, r.n, r.k) for r in d.collect())
    assert key(cells) == key(percolation.participation(hit, nodes))


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), None])
def test_outliers_count_finite_numbers_only(spark, odd):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0), ("e", 100.0), ("f", odd)], "subject string, final_attacks double")
    for method, options in (("iqr", {}), ("zscore", {"z_thresh": 1.0})):
        assert {r.subject for r in consensus.outliers(df, method, **options).where("excluded").collect()} == {"e"}


def test_all_nodes_of_a_graph_with_one_cluster_are_critical(spark):
    cells = spark.createDataFrame([("g", s, n, 0.5) for s in range(1, 6) for n in range(2)], "graph_id string, step int, node int, p double")
    assert sorted((r.node, r.is_critical) for r in clustering.critical_nodes(cells).collect()) == [(0, True), (1, True)]
