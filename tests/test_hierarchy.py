import itertools
import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import hierarchy as H

SCHEMA = "graph_no long, graph map<string,array<string>>, id2type map<string,string>, root string, key string"


def brute_cycles(graph):
    """Nodes that a walk of any length leads back to."""
    nodes = set(graph) | {c for v in graph.values() for c in v}
    reach = {n: set(graph.get(n, ())) for n in nodes}
    for k, i in itertools.product(nodes, nodes):
        if k in reach[i]:
            reach[i] |= reach[k]
    return {n for n in nodes if n in reach[n]}


def brute_paths(graph, root):
    out, todo = [], [(root,)]
    while todo:
        p = todo.pop()
        out.append(p)
        todo += [(*p, c) for c in graph.get(p[-1], ()) if c not in p]
    return sorted(out)


def random_graph(rng, n=8):
    names = [f"n{k}" for k in range(n)]
    return {a: list(dict.fromkeys(rng.choices(names, k=rng.randint(0, 3)))) for a in names if rng.random() < 0.7}


def test_search_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        g = random_graph(rng)
        assert set(H.cycle_nodes(g)) == brute_cycles(g)
        for nodes in H.components(g):
            scc, _, _ = H.colour_search(g, nodes)
            roots = H.start_nodes(g, nodes, scc)
            assert {n for r in roots for n in [r, *H.descendants(g, r)]} == set(nodes)
            for r in roots:
                assert sorted(H.paths(g, r)) == brute_paths(g, r)


def test_deep_chain_needs_no_recursion():
    g = {str(k): [str(k + 1)] for k in range(50_000)} | {"50000": ["0"]}
    assert len(H.cycle_nodes(g)) == 50_001


def test_rows(spark):
    rows = [
        (1, {"a": ["b", None, "b"], "b": ["a", "c"], "d": []}, {"a": "FUNCTION"}, "x", "y"), (1, {"a": ["b", None, "b"], "b": ["a", "c"], "d": []}, {"a": "FUNCTION"}, "x", "y"),
        (2, None, None, None, None), (3, {}, None, None, None), (4, {"s": ["s"], "t": None}, None, None, None), (None, {"q": ["q"]}, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(r) for r in H.map_cycle_nodes(df, "graph_no", "graph").collect()}
    assert found == {(1, "a"), (1, "b"), (4, "s"), (None, "q")}
    full = H.map_hierarchy(df.where("graph_no = 1"), "graph_no", "graph", "id2type").collect()
    assert {(r.root, r.node_id, r.node_type, r.depth, tuple(r.path), r.on_cycle, tuple(r.descendants)) for r in full} == {
        ("a", "a", "FUNCTION", 0, ("a",), True, ("a", "b", "c")), ("a", "b", None, 1, ("a", "b"), True, ("a", "b", "c")), ("a", "c", None, 2, ("a", "b", "c"), False, ()), ("d", "d", None, 0, ("d",), False, ()),
    }
    assert H.map_cycle_nodes(df.limit(0), "graph_no", "graph").count() == 0
    links = {tuple(r) for r in H.map_cycle_links(df, "graph_no", "graph").collect()}
    assert links == {(1, "a", "a", "b"), (1, "a", "b", "a"), (4, "s", "s", "s"), (None, "q", "q", "q")}
    assert H.map_cycle_links(df.limit(0), "graph_no", "graph").count() == 0


def random_links(seed):
    rng = random.Random(seed)
    return {(f"{g}.{a}", f"{g}.{b}") for g in range(4) for a, bs in random_graph(rng, 5).items() for b in bs}


def whole_rows(graph):
    """The full hierarchy of a graph by the search in memory."""
    out = set()
    for nodes in H.components(graph):
        scc, cyclic, _ = H.colour_search(graph, nodes)
        for root in H.start_nodes(graph, nodes, scc):
            out |= {(min(nodes), root, p[-1], len(p) - 1, p, p[-1] in cyclic, tuple(H.descendants(graph, p[-1]))) for p in H.paths(graph, root)}
    return out


@pytest.mark.parametrize("seed, local_edges", [(3, 0), (3, 10_000), (8, 4)])
def test_edge_tables_alike_for_local_and_distributed(spark, seed, local_edges):
    links = random_links(seed)
    edges = spark.createDataFrame([*links, *links, (None, "x"), ("x", None)], "parent string, child string")
    graph = {}
    for a, b in sorted(links):
        graph.setdefault(a, []).append(b)
    got = {(r.component, r.root, r.node_id, r.depth, tuple(r.path), r.on_cycle, tuple(r.descendants)) for r in H.edge_hierarchy(edges, local_edges=local_edges).collect()}
    assert got == whole_rows(graph)
    assert {x[2] for x in got} == {n for e in links for n in e}
    cyclic = brute_cycles(graph)
    assert {x[2] for x in got if x[5]} == cyclic
    assert {r.node_id for r in H.distributed_cycle_nodes(edges).collect()} == cyclic


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("e", "d"), ("f", "f"), *((f"h{k}", "hub") for k in range(50))], "parent string, child string")
    got = dict(H.connected_components(edges).collect())
    assert got["a"] == got["b"] == got["c"] == "a" and got["d"] == got["e"] == "d" and got["f"] == "f"
    assert len({got[f"h{k}"] for k in range(50)} | {got["hub"]}) == 1
    assert H.connected_components(edges.where(F.lit(False))).count() == 0


def test_edge_tables_give_equal_rows_at_every_size(spark):
    links = [("r", "x"), ("a", "b"), ("b", "a"), ("b", "x"), ("d", "c"), ("c", "d"), ("d", "x"), ("s", "s"), ("s", "x"), ("x", "y"), ("y", "x")]
    edges = spark.createDataFrame(links, "parent string, child string")
    near, far = (sorted(map(str, H.edge_hierarchy(edges, local_edges=n).collect())) for n in (10_000, 0))
    assert near == far and all(any(f"node_id='{n}'" in row for row in far) for n in "rabcdsxy")
