"""Graph searches against brute force and on chains and rings longer than any small limit."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import graph_search as G
from corpusflow.plans import registry
from corpusflow.plans.durable import with_places

registry.load()


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def shortest_brute(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for s in after:
        best, queue = {s: [s]}, deque([s])
        while queue:
            u = queue.popleft()
            for v in sorted(after.get(u, ())):
                if v not in best:
                    best[v] = best[u] + [v]
                    queue.append(v)
        out |= {(s, g): p for g, p in best.items() if g != s}
    return out


def test_shortest_of_a_long_chain(spark):
    got = G.shortest(edges_of(spark, [(i, i + 1) for i in range(39)])).where("origin = 0 AND goal = 39").first()
    assert got.hops == 39 and got.path == list(range(40))


def test_shortest_equals_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(70)] + [(5, 5), (7, 8), (7, 8), (None, 3), (4, None)]
    got = {(r.origin, r.goal): (r.hops, r.path) for r in G.shortest(edges_of(spark, pairs)).collect()}
    want = shortest_brute([p for p in pairs if None not in p])
    assert got.keys() == want.keys()
    assert all(got[k][0] == len(want[k]) - 1 for k in want)
    edges = {p for p in pairs}
    assert all(all((x, y) in edges for x, y in zip(p, p[1:])) and p[0] == k[0] and p[-1] == k[1] for k, (_, p) in got.items())
    # breadth-first in rising order finds the least of the shortest paths
    assert all(got[k][1] == want[k] for k in want)


def test_shortest_from_given_origins(spark):
    edges = edges_of(spark, [(1, 2), (2, 3), (3, 1), (9, 1)])
    got = {(r.origin, r.goal, r.hops) for r in G.shortest(edges, spark.createDataFrame([(9,), (9,), (4,)], "origin long")).collect()}
    assert got == {(9, 1, 1), (9, 2, 2), (9, 3, 3)}


def test_a_ring_of_thirty_is_found_and_trees_are_trimmed(spark):
    ring = [(i, (i + 1) % 30) for i in range(30)]
    tails = [(100 + i, 101 + i) for i in range(6)] + [(106, 4), (7, 200), (200, 201)]
    edges = edges_of(spark, ring + tails)
    assert {(r.a, r.b) for r in G.core(edges).collect()} == set(ring)
    assert [(r.smallest, r.nodes, r.length) for r in G.cycles(edges).collect()] == [(0, list(range(30)), 30)]


def test_core_keeps_what_joins_two_cycles(spark):
    edges = edges_of(spark, [(1, 2), (2, 1), (2, 5), (5, 6), (6, 5), (6, 9), (3, 3)])
    assert {(r.a, r.b) for r in G.core(edges).collect()} == {(1, 2), (2, 1), (2, 5), (5, 6), (6, 5), (3, 3)}
    assert {tuple(r.nodes) for r in G.cycles(edges).collect()} == {(1, 2), (5, 6), (3,)}


def test_no_edges(spark):
    edges = edges_of(spark, [])
    assert G.shortest(edges).count() == G.core(edges).count() == G.cycles(edges).count() == G.layers(edges).count() == G.order(edges).count() == 0


def order_brute(pairs):
    nodes = {x for p in pairs for x in p}
    before = {n: {a for a, b in pairs if b == n} for n in nodes}
    layer, k = {}, 0
    while True:
        free = [n for n in nodes if n not in layer and all(p in layer for p in before[n])]
        if not free:
            break
        layer |= {n: k for n in free}
        k += 1
    return sorted(nodes, key=lambda n: (layer.get(n, 1 << 62), n)), layer


def test_order_of_ten_thousand_edges(spark):
    rng = random.Random(8)
    pairs = set()
    while len(pairs) < 10_000:
        a = rng.randrange(2_000)
        pairs.add((a, min(1_999, a + 1 + int(rng.expovariate(1 / 400)))))
    pairs = {(a, b) for a, b in pairs if a < b}
    mixed = {n: (n * 7919) % 2003 for n in range(2_000)}  # the order of the keys is not that of the graph
    pairs = [(mixed[a], mixed[b]) for a, b in pairs]
    before = {}
    for a, b in pairs:
        before.setdefault(b, set()).add(a)
    got = [r.node for r in G.order(edges_of(spark, pairs)).orderBy("place").collect()]
    depth = {}
    for n in sorted({x for p in pairs for x in p}, key=lambda x: next(i for i, m in mixed.items() if m == x)):
        depth[n] = max((depth[p] + 1 for p in before.get(n, ())), default=0)
    assert got == sorted(depth, key=lambda n: (depth[n], n))


def test_nodes_behind_a_cycle_are_last(spark):
    pairs = [(1, 2), (2, 3), (3, 2), (3, 4), (1, 9)]
    want, layer = order_brute(pairs)
    assert [r.node for r in G.order(edges_of(spark, pairs)).orderBy("place").collect()] == want == [1, 9, 2, 3, 4]
    assert {r.node: r.layer for r in G.layers(edges_of(spark, pairs)).collect()} == {n: layer.get(n) for n in want}


def test_longest_path_takes_the_detour(spark):
    got = {r.node: r.path for r in G.layers(edges_of(spark, [(1, 4), (1, 2), (2, 3), (3, 4), (0, 3)])).collect()}
    assert got[4] == [1, 2, 3, 4] and got[3] == [1, 2, 3]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_places_are_the_global_order(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % 1009).alias("k"), F.when(F.col("id") % 100 != 5, F.col("id")).alias("v"))
    got = [(r.k, r.v) for r in with_places(df, F.col("k"), F.col("v")).orderBy("place").collect()]
    assert got == sorted(got, key=lambda r: (r[0], r[1] is not None, r[1] or 0)) and len(got) == n
