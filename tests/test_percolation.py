"""Closed forms, brute force and invariants of the removal kernel."""

import itertools
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from netfell.operators import percolation
from netfell.operators.percolation import percolation_step, two_sizes

TRIANGLES = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]
BARBELL = [*TRIANGLES, (2, 6), (6, 3)]


def near_of(n, edges):
    near = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    return near


def steps_of(n, edges):
    near = near_of(n, edges)
    return Counter(percolation_step(two_sizes(list(o), near)[1]) for o in itertools.permutations(range(n)))


def brute(order, near):
    firsts, seconds = [], []
    for step in range(len(order) + 1):
        left, sizes = set(order[step:]), []
        while left:
            todo, size = [left.pop()], 0
            while todo:
                size += 1
                for y in near[todo.pop()]:
                    if y in left:
                        left.discard(y)
                        todo.append(y)
            sizes.append(size)
        sizes = sorted(sizes, reverse=True) + [0, 0]
        firsts.append(sizes[0])
        seconds.append(sizes[1])
    return firsts, seconds


def test_closed_forms():
    assert steps_of(5, []) == {5: 120}
    assert steps_of(5, list(itertools.combinations(range(5), 2))) == {5: 120}
    assert steps_of(6, [(0, i) for i in range(1, 6)]) == {6: 720}
    assert steps_of(4, [(0, 1), (1, 2), (2, 3)]) == {4: 24}
    assert steps_of(5, [(0, 1), (1, 2), (2, 3), (3, 4)]) == {1: 24, 5: 96}
    assert steps_of(6, TRIANGLES) == {1: 720}
    assert steps_of(7, BARBELL) == {1: 2160, 2: 960, 3: 288, 7: 1632}


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_sizes_are_those_of_direct_removal(data):
    n = data.draw(st.integers(1, 12))
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda e: e[0] != e[1]), max_size=20))
    order = data.draw(st.permutations(range(n)))
    near = near_of(n, set(map(tuple, map(sorted, edges))))
    assert two_sizes(list(order), near) == brute(order, near)


def graph(spark, n, edges):
    e = spark.createDataFrame([("g", a, b, 1.0) for a, b in edges], "graph_id string, u int, v int, w double")
    return e, spark.createDataFrame([("g", i) for i in range(n)], "graph_id string, node int")


def test_invariants_of_participation(spark):
    edges, nodes = graph(spark, 7, [tuple(sorted(e)) for e in BARBELL])
    cells = percolation.participation(percolation.hits(edges, nodes, 500, seed=3, rule="philox"), nodes).toPandas()
    by_step = cells.groupby("step")
    assert (by_step["n"].first().sum(), by_step["n"].nunique().max()) == (500, 1)
    assert (by_step["k"].sum() == by_step["n"].first() * by_step["n"].first().index).all()
    assert cells["p"].isna().equals(cells["n"] == 0) and cells["p"].dropna().between(0, 1).all()


def test_hits_do_not_hang_on_blocks_or_chunks(spark):
    edges, nodes = graph(spark, 7, [tuple(sorted(e)) for e in BARBELL])
    whole = percolation.hits(edges, nodes, 600).drop("chunk").toPandas()
    parts = percolation.hits(edges, nodes, 600, chunk=70).groupBy("graph_id", "step", "node").sum("k").toPandas()
    key = ["step", "node"]
    assert np.array_equal(whole.sort_values(key)["k"], parts.sort_values(key)["sum(k)"])


def test_kernel_and_relational_positions_agree(spark):
    _, nodes = graph(spark, 9, [])
    rows = percolation.attack_positions(nodes, 3, seed=5).toPandas()
    for attack, own in rows.groupby("attack_id"):
        order = percolation.removal_order(np.arange(9), 5, int(attack), "md5")
        assert own.sort_values("pos")["node"].tolist() == order.tolist()


def test_attacks_are_uniform():
    places = np.zeros((5, 5))
    for i in range(4000):
        places[np.arange(5), percolation.removal_order(np.arange(5), 1, i, "philox")] += 1
    assert abs(places - 800).max() < 5 * np.sqrt(800 * 0.8)
