"""Graph operators over whole inputs, against plain Python."""

from rolewise import queries
from rolewise.operators import graph
from rolewise.sources.tables import table

SF = "/root/testdata/sf0.001"


def plain_components(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def test_components_take_all_orders(spark):
    orders = table(spark, SF, "orders").select("o_custkey", "o_orderpriority").distinct().collect()
    expected = plain_components([(f"c{r.o_custkey}", f"p{r.o_orderpriority}") for r in orders])
    assert {r.node: r.component for r in queries.QUERIES["connected_components_all"](spark, SF).collect()} == expected


def test_components_of_several_pieces(spark):
    edges = [(f"c{k}", f"p{k % 7}") for k in range(300)] + [(f"x{k}", f"x{k + 1}") for k in range(40)]
    got = graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r.node: r.component for r in got} == plain_components(edges) and len({r.component for r in got}) == 8


def plain_closure(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    found = {}
    for a in after:
        now, depth = {a}, 0
        while now:
            depth += 1
            now = {c for b in now for c in after.get(b, ()) if (a, c) not in found}
            found |= {(a, c): depth for c in now}
    return found


def test_ancestry_of_long_chains_merges_and_cycles(spark):
    """Ways of several hundred steps, some 2**60 ways through merges, a cycle and a loop."""
    chain = [(k + 1, k) for k in range(230)]
    merges = [e for k in range(60) for e in [(1003 + 3 * k, 1001 + 3 * k), (1003 + 3 * k, 1002 + 3 * k), (1001 + 3 * k, 1000 + 3 * k), (1002 + 3 * k, 1000 + 3 * k)]]
    edges = chain + merges + [(5000, 5001), (5001, 5002), (5002, 5000), (6000, 6000)]
    found = {(r.src, r.dst): r.depth for r in graph.closure(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == plain_closure(edges)
    parents = spark.createDataFrame([*chain, (300, 20), (0, None)], "revision long, parent long")
    pairs = spark.createDataFrame([(230, 300)], "ours long, theirs long")
    assert [r.base for r in graph.merge_base(parents, pairs).collect()] == [20]
    forward = graph.fast_forward(parents, spark.createDataFrame([(0, 230), (300, 230)], "old long, new long")).collect()
    assert {(r.old, r.new): r.fast_forward for r in forward} == {(0, 230): True, (300, 230): False}
