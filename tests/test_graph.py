"""Graph queries over whole tables against plain loops."""

from __future__ import annotations

from collections import Counter

from waterlens.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def least_reachable(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for u, v in edges:
        u, v = sorted((root(u), root(v)))
        parent[v] = u
    return {n: root(n) for n in nodes}


def test_components_of_all_customers_and_suppliers(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    buyer = {r["o_orderkey"]: r["o_custkey"] for r in read("orders").collect()}
    edges = {(buyer[r["l_orderkey"]], -r["l_suppkey"] - 1) for r in read("lineitem").collect() if r["l_orderkey"] in buyer}
    nodes = {r["c_custkey"] for r in read("customer").collect()} | {-r["s_suppkey"] - 1 for r in read("supplier").collect()}
    expected = least_reachable(nodes, edges)
    found = {r["id"]: r["component"] for r in catalog.queries()["connected_components"](spark, FOLDER).collect()}
    assert found == expected
    sizes = Counter(expected.values())
    classes = {r["component"]: (r["n_members"], r["class"]) for r in catalog.queries()["classified_components"](spark, FOLDER).collect()}
    for name, size in sizes.items():
        members = [n for n, c in expected.items() if c == name]
        kind = "nuisance" if any(n % 5 == 0 for n in members) else "model error" if any(n % 7 == 0 for n in members) else "puddle"
        assert classes.pop(name) == (size, kind)
    assert not classes


def test_snapped_nodes_of_all_points(spark):
    keys = [r["c_custkey"] for r in spark.read.parquet(f"{FOLDER}/customer.parquet").collect()]
    at = {k: (k * 37 % 1000, k * 91 % 1009) for k in keys}
    close = [(a, b) for a in keys for b in keys if a < b and (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 <= 900]
    node = least_reachable(keys, close)
    found = {r["id"]: (r["node"], r["x"], r["y"]) for r in catalog.queries()["snapped_nodes"](spark, FOLDER).collect()}
    assert found == {k: (node[k], *map(float, at[node[k]])) for k in keys}
