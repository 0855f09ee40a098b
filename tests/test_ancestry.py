"""Ancestry, levels, cycles and intervals against plain versions, on random graphs with every odd shape."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rolewise.operators import ancestry, graph


def reach(edges, head):
    """Least number of steps from ``head`` to all that it leads to."""
    up = defaultdict(set)
    for a, b in edges:
        up[a].add(b)
    found, open_ = {head: 0}, [head]
    while open_:
        nearer = [p for n in open_ for p in up[n] if p not in found]
        for n in open_:
            for p in up[n]:
                found.setdefault(p, found[n] + 1)
        open_ = list(dict.fromkeys(nearer))
    return found


def history(seed, n=60):
    """Long runs, branches, merges, several roots and rows that are repeated."""
    rng = random.Random(seed)
    edges = []
    for k in range(1, n):
        if rng.random() < 0.9:
            edges.append((k, k - 1 if rng.random() < 0.7 else rng.randrange(k)))
        if rng.random() < 0.2:
            edges.append((k, rng.randrange(k)))
    return edges + edges[:3]


def parents_of(spark, edges, alone=()):
    return spark.createDataFrame([*edges, *[(a, None) for a in alone]], "revision long, parent long").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_bases_and_fast_forwards(spark, seed):
    edges = history(seed)
    nodes = sorted({x for e in edges for x in e} | {900})
    parents = parents_of(spark, edges, [900])
    index = ancestry.runs(parents.toDF("src", "dst"))
    up = {n: reach(edges, n) for n in nodes}
    heads = [nodes[-2], nodes[len(nodes) // 2], nodes[0], 900, 777]
    got = {(r.revision, r.ancestor): r.depth for r in ancestry.ancestors_of(parents, spark.createDataFrame([(h,) for h in [*heads, None]], "revision long"), index).collect()}
    assert got == {(h, a): d for h in heads if h in up for a, d in up[h].items()}

    rng = random.Random(seed)
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)] + [(900, nodes[0]), (777, nodes[0]), (None, 1), (5, 5)]
    frame = spark.createDataFrame(pairs, "ours long, theirs long")
    want = {}
    for a, b in pairs:
        common = [(max(up[a][c], up[b][c]), up[a][c] + up[b][c], c) for c in up[a] if c in up[b]] if a in up and b in up else []
        if common:
            want[a, b] = min(common)[2]
    assert {(r.ours, r.theirs): r.base for r in ancestry.merge_base(parents, frame, index).collect()} == want
    forward = ancestry.fast_forward(parents, frame.toDF("old", "new"), index).collect()
    assert sorted((r.old, r.new, r.fast_forward) for r in forward if r.old is not None) == sorted((a, b, b in up and a in up[b]) for a, b in pairs if a is not None)
    index.drop()


def test_a_head_writes_no_more_than_its_answer(spark, monkeypatch):
    n, written = 100_000, defaultdict(int)
    plain = ancestry.durable

    def counted(df, name="durable"):
        made = plain(df, name)
        written[name] += made.count()
        return made

    parents = spark.range(n).select(F.col("id").alias("revision"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    index = ancestry.runs(parents.toDF("src", "dst"))
    monkeypatch.setattr(ancestry, "durable", counted)
    found = ancestry.ancestors_of(parents, spark.createDataFrame([(n - 1,)], "revision long"), index)
    assert found.agg(F.count("*"), F.max("depth"), F.countDistinct("ancestor")).first() == (n, n - 1, n)
    assert sum(written.values()) <= n + 1 and written["ancestry-entries"] == 1
    written.clear()
    base = ancestry.merge_base(parents, spark.createDataFrame([(n - 1, 5), (40, 70)], "ours long, theirs long"), index).collect()
    assert sorted((r.ours, r.theirs, r.base) for r in base) == [(40, 70, 40), (n - 1, 5, 5)]
    assert sum(written.values()) <= 6
    index.drop()


def strong(edges):
    """Each node on a cycle to the least of those that it leads to and that lead to it."""
    nodes = {x for e in edges for x in e}
    on = {n: {d for a, b in edges if a == n for d in reach(edges, b)} for n in nodes}
    return {n: min(m for m in on[n] if n in on[m]) for n in nodes if n in on[n]}


@pytest.mark.parametrize("seed", range(2))
def test_levels_and_cycles(spark, seed):
    rng = random.Random(seed)
    edges = history(seed, 40) + [(100, 101), (101, 102), (102, 100), (200, 200), (300, 100), (301, 300), (102, 303), (400, 401), (401, 400), (401, 100), (0, 500), (1, 500)]
    edges += [(600 + k, 600 + (k + 1) % 7) for k in range(7)] + [(610, 603)]
    if seed:
        edges += [(rng.randrange(40), rng.randrange(40)) for _ in range(seed)]
    nodes = {x for e in edges for x in e}
    at, cycles = ancestry.levels(parents_of(spark, edges, [999]).toDF("src", "dst"))
    want = strong(edges)
    assert {r.node: r.cycle for r in cycles.collect()} == want
    free = {n for n in nodes if not set(reach(edges, n)) & set(want)}

    def level(n, known={}):  # noqa: B006
        key = (seed, n)
        if key not in known:
            known[key] = max((1 + level(b) for a, b in edges if a == n), default=0)
        return known[key]

    assert {r.node: r.level for r in at.collect()} == {n: level(n) for n in free} | {999: 0}
    assert {r.node for r in graph.cycles(spark.createDataFrame(edges, "src long, dst long")).collect()} == set(want)


def test_intervals_of_a_forest(spark):
    rng = random.Random(3)
    tree = [(k, rng.randrange(max(0, k - 9), k)) for k in range(1, 120) if k % 25] + [(k, 0) for k in range(200, 260)] + [(500, None)]
    loop = [(700, 701), (701, 700), (702, 700)]
    frame = spark.createDataFrame(tree + loop, "sub long, sup long").repartition(3)
    up = {n: reach([e for e in tree if e[1] is not None], n) for e in tree for n in e if n is not None}
    labels = ancestry.intervals(frame)
    got = {r.node: (r.enter, r.leave) for r in labels.collect()}
    assert set(got) == set(up) and sorted(x for pair in got.values() for x in pair) == sorted(set(x for pair in got.values() for x in pair))
    for a in up:
        for b in up:
            assert (got[b][0] <= got[a][0] and got[a][1] <= got[b][1]) == (b in up[a]), (a, b)
    pairs = spark.createDataFrame([(3, 0), (0, 3), (250, 0), (700, 701), (500, 500), (None, 0)], "sub long, sup long")
    below = {(r["sub"], r["sup"]): r.below for r in ancestry.is_below(labels, pairs).collect()}
    assert below == {(3, 0): 0 in up[3], (0, 3): False, (250, 0): True, (700, 701): False, (500, 500): True, (None, 0): False}
    words = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "c")], "sub string, sup string")
    assert {r.node: (r.enter, r.leave) for r in ancestry.intervals(words).collect()} == {"a": (0, 7), "b": (1, 2), "c": (3, 6), "d": (4, 5)}


def test_nearest_marked(spark):
    tree = [(k, k // 2) for k in range(1, 50)] + [(100, 101), (101, 100), (102, 100)]
    marked = [0, 5, 6, 20, 101]
    want = {}
    for n in {x for e in tree for x in e}:
        at, depth = n, 0
        while at not in marked and at in dict(tree) and depth < 60:
            at, depth = dict(tree)[at], depth + 1
        if at in marked:
            want[n] = (at, depth)
    frame = spark.createDataFrame(tree, "sub long, sup long")
    found = graph.effective_identifier(frame, spark.createDataFrame([(m,) for m in marked], "type long"))
    assert {r.type: (r.owner, r.depth) for r in found.collect()} == want


def test_empty_and_build_order(spark):
    none = spark.createDataFrame([], "revision long, parent long")
    heads = spark.createDataFrame([(1,)], "revision long")
    assert ancestry.ancestors_of(none, heads).count() == 0
    assert [t.count() for t in ancestry.levels(none.toDF("src", "dst"))] == [0, 0]
    assert ancestry.intervals(none.toDF("sub", "sup")).count() == 0
    roles = spark.createDataFrame([("Firm", "a", "Person"), ("Job", "at", "FirmRecord"), ("Pay", "of", "JobRecord"), ("Tax", "by", "FirmRecord"), ("X", "y", "YRecord"), ("Y", "x", "XRecord")], "fact string, role string, player string")
    types = spark.createDataFrame([("FirmRecord", "Firm"), ("JobRecord", "Job"), ("XRecord", "X"), ("YRecord", "Y")], "type string, fact string")
    steps, cycles = graph.build_order(roles, types)
    assert {r.fact: r.step for r in steps.collect()} == {"Firm": 0, "Job": 1, "Tax": 1, "Pay": 2}
    assert {r.fact: r.cycle for r in cycles.collect()} == {"X": "X", "Y": "X"}
