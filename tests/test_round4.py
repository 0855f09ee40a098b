"""Queries over tables with other keys than the given ones, against their SQL, and what they write and run for it."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rolewise import queries
from rolewise.operators import ancestry, audit, evolution, graph

SF = "/root/testdata/sf0.001"


def plain_components(edges):
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def agrees(spark, folder, name, tables):
    """Whether a query over ``tables`` (name to SQL that makes it) equals its SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    answer = con.sql(queries.ORACLE_SQL[name])
    show = lambda rows, names: sorted(repr([r[k] for k in sorted(range(len(names)), key=lambda k: names[k])]) for r in rows)
    got, want = show([tuple(r) for r in df.collect()], df.columns), show(answer.fetchall(), answer.columns)
    assert got == want and len(got) > 0
    return got


def test_alignment_of_keys_over_a_million(spark, tmp_path):
    """Kept ids are over 999,999, and new ones meet old ones of other names."""
    part = "SELECT k::BIGINT AS p_partkey FROM (SELECT unnest(range(0, 70)) AS k UNION ALL SELECT unnest(range(999970, 1000060)))"
    agrees(spark, tmp_path, "element_alignment", {"part": part})


def test_alignment_is_one_to_one(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "id long, name string")
    hints = spark.createDataFrame([("a", "z"), ("b", "y")], "before_name string, after_name string")
    found = evolution.align(frame((1, "a"), (2, "b"), (3, "c"), (4, "d")), frame((1, "z"), (12, "y"), (13, "c"), (14, "e")), hints).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, "id"), (2, 12, "hint"), (3, 13, "name")]


def counted(monkeypatch, module):
    """The names of the tables that ``module`` writes from now on."""
    names, plain = [], module.durable
    monkeypatch.setattr(module, "durable", lambda df, name="durable": (names.append(name), plain(df, name))[1])
    return names


def plain_cycles(edges):
    """Each node on a cycle with the least node of its strongly connected set."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(n):
        found, open_ = set(), [n]
        while open_:
            for b in after.get(open_.pop(), ()):
                if b not in found:
                    found.add(b)
                    open_.append(b)
        return found

    to = {n: reach(n) for n in after}
    return {n: min(m for m in to[n] if n in to.get(m, ())) for n in to if n in to[n]}


@pytest.mark.parametrize("seed", [0, 2])
def test_cycles_past_single_links(spark, seed):
    """Single links lead into rings, into ends and into nodes of several links; seed 0 has no others."""
    rng = random.Random(seed)
    edges = [(k, rng.randrange(90)) for k in range(80)] + [(100, 101), (101, 102), (102, 100), (110, 110), (120, None), (None, 3)]
    for _ in range(3 * seed):
        edges.append((rng.randrange(90), rng.randrange(90)))
    if seed:
        edges += [(300, 301), (301, 302), (302, 303), (303, 304), (304, 300), (302, 400), (400, 401), (401, 402), (402, 403), (403, 404), (404, 405), (405, 301), (403, 403), (302, 500), (500, 501), (100, 300)]
    found = ancestry.cycles(spark.createDataFrame(edges + edges[:5], "src long, dst long").repartition(3)).collect()
    want = plain_cycles([e for e in edges if None not in e])
    assert {r.node: r.cycle for r in found} == want and len(found) == len(want)


def test_named_cycles_behind_long_ways(spark, tmp_path, monkeypatch):
    """A way on which many others end costs no round for each step."""
    n = 600
    ways = spark.range(n).select(F.col("id").alias("src"), F.when(F.col("id") > 2, F.col("id") - 1).otherwise((F.col("id") + 1) % 3).alias("dst"))
    ways = ways.unionByName(spark.range(n).select((F.col("id") + n).alias("src"), F.col("id").alias("dst")))
    names = counted(monkeypatch, ancestry)
    assert sorted(tuple(r) for r in ancestry.cycles(ways).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert len(names) < 25
    names.clear()
    agrees(spark, tmp_path, "named_cycles", {"part": "SELECT k::BIGINT AS p_partkey, (k * 7 % 50 + 1)::INTEGER AS p_size FROM (SELECT unnest(range(3000)) AS k)"})
    assert len(names) < 25


def test_subtype_cycles_behind_long_ways(spark, tmp_path, monkeypatch):
    names = counted(monkeypatch, ancestry)
    agrees(spark, tmp_path, "subtype_cycles", {"part": "SELECT k::BIGINT AS p_partkey, (k * 7 % 50 + 1)::INTEGER AS p_size FROM (SELECT unnest(range(3000)) AS k)"})
    assert len(names) < 25


def test_trusted_keys_are_no_part_of_a_rule(spark):
    """A set of keys is stated once; a revision's rows don't grow with it."""
    signed = spark.createDataFrame([(1, 10, True), (1, 11, True), (1, 12, False), (1, 13, True), (2, 10, True), (2, 11, None), (3, 10, True), (3, 14, True)], "revision long, key_id long, valid boolean")
    keys = spark.createDataFrame([(10, "trusted"), (11, "trusted"), (12, "trusted"), (13, "revoked")], "key_id long, status string")
    rules = spark.createDataFrame([(1, 2, None), (2, 1, "half"), (3, 2, "half"), (4, 0, "half"), (5, 1, "none")], "revision long, required int, allowed string")
    sets = spark.createDataFrame([("half", 10), ("half", 10), ("half", 13), ("half", 14)], "allowed string, key_id long")
    found = {r.revision: (r.accepted, r.passed) for r in audit.trust(signed, keys, rules, sets).collect()}
    assert found == {1: (2, True), 2: (1, True), 3: (1, False), 4: (0, True), 5: (0, False)}
    arrays = {None: [], "half": [10, 13, 14], "none": [99]}
    listed = spark.createDataFrame([(r.revision, r.required, arrays[r.allowed]) for r in rules.collect()], "revision long, required int, allowed array<long>")
    assert {r.revision: (r.accepted, r.passed) for r in audit.trust(signed, keys, listed).collect()} == found
    df = queries.QUERIES["trust_evaluation"](spark, SF)
    assert "array" not in df._jdf.queryExecution().optimizedPlan().toString()


def plain_up(edges, n):
    found, open_ = {n: 0}, [n]
    for a in open_:
        for b in sorted(q for p, q in edges if p == a):
            if b not in found:
                found[b] = found[a] + 1
                open_.append(b)
    return found


def many_ways(n=60):
    """Each revision comes after that of half its number and of a third; the last lead into a cycle and past it."""
    return sorted({(k, k // m) for k in range(1, n) for m in (2, 3) if k // m}) + [(100, 101), (101, 102), (102, 100), (102, 9), (59, 100), (103, 59)]


def test_many_fast_forwards_go_no_deeper_than_asked(spark, monkeypatch):
    edges = many_ways()
    nodes = sorted({x for e in edges for x in e})
    up = {n: plain_up(edges, n) for n in nodes}
    parents = spark.createDataFrame(edges, "revision long, parent long")
    pairs = [(a, b) for b in nodes for a in {b, b // 4, b // 5, b // 9, 7, 101}] + [(5, 777), (777, 5)]
    monkeypatch.setattr(ancestry._Search, "FEW", 0)
    for asked in (pairs, pairs[:7]):  # with levels and without
        found = ancestry.fast_forward(parents, spark.createDataFrame(asked, "old long, new long")).collect()
        assert sorted((r.old, r.new, r.fast_forward) for r in found) == sorted((a, b, b in up and a in up[b]) for a, b in asked)


def test_fast_forward_all_writes_few_entries(spark, tmp_path, monkeypatch):
    n, entries, plain = 3000, [], ancestry.durable

    def counting(df, name="durable"):
        made = plain(df, name)
        if name == "ancestry-entries":
            entries.append(made.count())
        return made

    monkeypatch.setattr(ancestry, "durable", counting)
    agrees(spark, tmp_path, "fast_forward_all", {"part": f"SELECT unnest(range({n}))::BIGINT AS p_partkey"})
    assert sum(entries) < 9 * 2 * n  # all that is before the revisions are over 20 for each question


def test_pieces_are_named_by_facts_and_edges_shrink(spark, monkeypatch):
    """Facts are no nodes of the graph that is cut into parts, and a round goes on with what connects parts, not with all edges."""
    rows = [(f"f{k:03}", "a", f"p{k % 40}") for k in range(400)] + [(f"f{k:03}", "b", f"p{(k * 3 + 1) % 40}") for k in range(400)] + [("x1", "a", "q1"), ("x1", "b", "q2"), ("x0", "a", "q2"), ("y", "a", "r"), ("z", "a", None)]
    sizes, plain = {}, graph.durable

    def sized(df, name="durable"):
        made = plain(df, name)
        sizes.setdefault(name, []).append(made.count())
        return made

    monkeypatch.setattr(graph, "durable", sized)
    roles = spark.createDataFrame(rows, "fact string, role string, player string").repartition(3)
    (found,) = graph.analyses_of(roles, [("connected", ())]).collect()
    want = sorted(set(plain_components([(f"fact:{f}", f"type:{p}") for f, _, p in rows if p]).values()))
    assert (found.status, found.offenders) == ("violated", want) and {"fact:f000", "fact:x0", "fact:y"} < set(want)
    assert max(sizes["components-to"]) <= 42 and sizes["components-open"][-1] == 0 and sum(sizes["components-open"][1:]) < sizes["components-open"][0] / 4
    chain = spark.range(500).select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % 500).alias("dst")).union(spark.range(600, 900).selectExpr("id", "id + 1")).union(spark.createDataFrame([(5, None), (7, 7), (950, 950)], "src long, dst long"))
    want = plain_components([tuple(r) for r in chain.collect() if r.dst is not None and r.src != r.dst])
    assert {r.node: r.component for r in graph.components(chain).collect()} == want


def test_merge_bases_search_from_each_revision_once(spark, monkeypatch):
    edges, sizes, plain = many_ways(), [], ancestry.durable

    def sized(df, name="durable"):
        made = plain(df, name)
        sizes.append((name, made.count()))
        return made

    nodes = sorted({x for e in edges for x in e})
    up = {n: plain_up(edges, n) for n in nodes}
    parents = spark.createDataFrame(edges, "revision long, parent long")
    monkeypatch.setattr(ancestry, "durable", sized)
    monkeypatch.setattr(ancestry._Search, "FEW", 0)
    for turned in (False, True):
        pairs = [(n, m) for m in (11, 40) for n in nodes] + [(777, 40), (5, None)]
        sizes.clear()
        found = ancestry.merge_base(parents, spark.createDataFrame([p[::-1] if turned else p for p in pairs], "ours long, theirs long")).collect()
        want = {}
        for a, b in pairs:
            common = [(max(up[a][c], up[b][c]), up[a][c] + up[b][c], c) for c in up[a] if c in up[b]] if a in up and b in up else []
            if common:
                want[a, b] = min(common)[2]
        assert {((r.theirs, r.ours) if turned else (r.ours, r.theirs)): r.base for r in found} == want
        assert [n for name, n in sizes if name == "ancestry-entries"][:2] == [2, len(nodes)]
