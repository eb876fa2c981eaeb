"""Algorithms on known graphs, and on random ones against plain Python."""

import random
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from graphloom.errors import InvalidOperation, NotFound
from graphloom.operators import components, louvain, node2vec, pagerank, paths, traversal, triangles


def frames(spark, n, edges):
    """edges: (src, dst) or (src, dst, weight) over 0..n-1."""
    rows = [(f"{e[0]:03d}", f"{e[1]:03d}", f"e{i:04d}", float(e[2]) if len(e) > 2 else 1.0) for i, e in enumerate(edges)]
    return spark.createDataFrame([(f"{i:03d}",) for i in range(n)], "id string"), spark.createDataFrame(rows, "src string, dst string, eid string, weight double")


def rows(df, *cols):
    return {r[cols[0]]: tuple(r[c] for c in cols[1:]) if len(cols) > 2 else r[cols[1]] for r in df.collect()}


GRAPHS = st.integers(2, 12).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 5)), max_size=30)))
slow = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def test_bfs_dfs(spark):
    nodes, edges = frames(spark, 4, [(0, 1), (1, 2)])
    assert rows(traversal.bfs(nodes, edges, "000"), "id", "distance", "parent") == {"000": (0, None), "001": (1, "000"), "002": (2, "001")}
    assert rows(traversal.bfs(nodes, edges, "000", 1), "id", "distance") == {"000": 0, "001": 1}
    assert rows(traversal.bfs(nodes, edges, "000", 0), "id", "distance") == {"000": 0}
    assert rows(traversal.dfs(nodes, edges, "000"), "id", "discovery", "finish", "parent") == {"000": (1, 6, None), "001": (2, 5, "000"), "002": (3, 4, "001")}
    assert rows(traversal.dfs(nodes, edges, "003"), "id", "finish") == {"003": 2}
    with pytest.raises(NotFound):
        traversal.bfs(nodes, edges, "nobody")


def test_dijkstra(spark):
    nodes, edges = frames(spark, 4, [(0, 1, 1.0), (1, 2, 2.0)])
    got = paths.shortest_paths(nodes, edges, "000")
    assert rows(got, "id", "distance") == {"000": 0, "001": 1, "002": 3} and paths.path_to(got, "002") == ["000", "001", "002"]
    assert paths.path_to(got, "003") is None and paths.distance_to(got, "003") is None and paths.distance_to(got, "002") == 3
    with pytest.raises(InvalidOperation):
        paths.shortest_paths(nodes, frames(spark, 4, [(0, 1, 1.0), (1, 2, -2.0)])[1], "000")
    assert rows(paths.shortest_paths(nodes, frames(spark, 4, [(0, 1, 1.0), (2, 3, -2.0)])[1], "000"), "id", "distance") == {"000": 0, "001": 1}


def test_pagerank(spark):
    nodes, edges = frames(spark, 3, [(0, 1), (0, 2), (1, 2)])
    got = pagerank.pagerank(nodes, edges)
    assert got.converged and got.top_nodes(1).collect()[0].id == "002"
    empty = pagerank.pagerank(nodes.limit(0), edges.limit(0))
    assert empty.converged and empty.iterations == 0
    assert not pagerank.pagerank(nodes, edges, max_iterations=1, tolerance=0.0).converged


def test_triangles_components(spark):
    nodes, edges = frames(spark, 4, [(0, 1), (1, 2), (2, 0), (0, 0), (1, 0)])
    counts = triangles.triangle_counts(nodes, edges)
    assert rows(counts, "id", "triangles", "coefficient") == {"000": (1, 1.0), "001": (1, 1.0), "002": (1, 1.0), "003": (0, 0.0)}
    assert tuple(triangles.triangle_summary(counts).first()) == (1, 1.0)
    nodes, edges = frames(spark, 5, [(1, 0), (2, 3)])
    got = components.connected_components(nodes, edges)
    assert rows(got, "id", "component") == {"000": 0, "001": 0, "002": 1, "003": 1, "004": 2}
    assert components.are_connected(got, "000", "001") and not components.are_connected(got, "000", "002")
    assert rows(components.component_sizes(got), "component", "size") == {0: 2, 1: 2, 2: 1}


def modularity(label, edges):
    m, d = len(edges), {}
    for s, _ in edges:
        d[s] = d.get(s, 0) + 1
    return sum((1 - d.get(s, 0) * d.get(t, 0) / (2 * m)) / (2 * m) for s, t in set(edges) if label[s] == label[t]) if m else 0.0


@pytest.mark.parametrize("exact", [True, False])
def test_louvain(spark, exact):
    pairs = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]
    nodes, edges = frames(spark, 6, pairs)
    got = louvain.louvain(nodes, edges, exact=exact)
    label = rows(got.assignment, "id", "community")
    assert set(label.values()) == set(range(len(set(label.values())))) and got.modularity > 0
    assert abs(got.modularity - modularity({int(k): v for k, v in label.items()}, pairs)) < 1e-12
    if exact:
        assert len(set(label.values())) >= 2
    assert louvain.louvain(nodes, edges.limit(0), exact=exact).modularity == 0


def test_node2vec(spark):
    nodes, edges = frames(spark, 4, [(0, 1), (1, 2), (2, 3)])
    got = node2vec.node2vec(nodes, edges, walk_length=10, walks_per_node=5)
    walks = node2vec.walks(got).collect()
    assert len(walks) == 20 and all(w.path == [f"{i:03d}" for i in range(int(w.start), 4)] for w in walks)
    assert tuple(node2vec.walk_counts(got).first()) == (20, 50)
    assert node2vec.node2vec(nodes, edges, walk_length=1, walks_per_node=2).count() == 8
    nodes, edges = frames(spark, 3, [(0, 1), (1, 0), (1, 2), (2, 1)])
    back = node2vec.node2vec(nodes, edges, walk_length=4, walks_per_node=60, p=1e-6, q=1.0, seed=1)
    assert all(w.path[i] == w.path[i + 2] for w in node2vec.walks(back).collect() for i in range(2))
    again = node2vec.node2vec(nodes, edges, walk_length=4, walks_per_node=60, p=1e-6, q=1.0, seed=1)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, again.collect()))


def test_random(spark):
    @slow
    @given(GRAPHS)
    def check(g):
        n, es = g
        nodes, edges = frames(spark, n, es) if es else (frames(spark, n, [(0, 0)])[0], frames(spark, n, [(0, 0)])[1].limit(0))
        out = {i: sorted({e[1] for e in es if e[0] == i}) for i in range(n)}
        dist, todo = {0: 0}, deque([0])
        while todo:
            for v in out[u := todo.popleft()]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    todo.append(v)
        assert {int(k): d for k, d in rows(traversal.bfs(nodes, edges, "000"), "id", "distance").items()} == dist
        cost = {0: 0.0}
        for _ in range(n):
            for s, d, w in es:
                if s in cost and cost[s] + w < cost.get(d, 1e9):
                    cost[d] = cost[s] + w
        assert {int(k): d for k, d in rows(paths.shortest_paths(nodes, edges, "000"), "id", "distance").items()} == cost
        clock, number = 0, {}

        def visit(u):
            nonlocal clock
            clock += 1
            number[u] = clock
            for v in out[u]:
                if v not in number:
                    visit(v)
            clock += 1

        visit(0)
        assert {int(k): d for k, d in rows(traversal.dfs(nodes, edges, "000"), "id", "discovery").items()} == number
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for s, d, _ in es:
            a, b = sorted((find(s), find(d)))
            root[b] = a
        assert {int(k): int(r) for k, r in rows(components.roots(nodes, edges), "id", "root").items()} == {i: find(i) for i in range(n)}
        near = {i: {j for s, d, _ in es for i2, j in ((s, d), (d, s)) if i2 == i and j != i} for i in range(n)}
        tri = {i: sum(1 for a in near[i] for b in near[i] if a < b and b in near[a]) for i in range(n)}
        assert {int(k): t for k, t in rows(triangles.triangle_counts(nodes, edges), "id", "triangles").items()} == tri

    check()


def test_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(0).shuffle(order)
    nodes, edges = frames(spark, n, list(zip(order, order[1:])))
    assert set(rows(components.roots(nodes, edges), "id", "root").values()) == {"000"}
