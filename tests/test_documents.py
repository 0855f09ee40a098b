"""Canonical JSON, revisions held against their hashes, folding of facts, and models back from their relations."""

import hashlib
import json
import random
from collections import Counter, defaultdict
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolewise.functions.canonical import canonical, content_id, differences, leaves
from rolewise.operators import facts, revisions
from rolewise.plans import catalog
from rolewise.plans.model import Entity, Fact, Model, ModelError, Rule, Value, fingerprint


def made(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return {rng.choice(["a", "b.c", "é", "z", "", '"q"']) + str(rng.randrange(3)): made(rng, depth + 1) for _ in range(rng.randrange(5))}
    return [rng.randrange(-99, 99), rng.choice([True, False, None]), "text é\n\"" + str(rng.randrange(9)), rng.randrange(9) / 4, "x" * rng.randrange(3)][kind]


def shuffled(rng, x):
    if isinstance(x, dict):
        items = list(x.items())
        rng.shuffle(items)
        return {k: shuffled(rng, v) for k, v in items}
    return [shuffled(rng, v) for v in x] if isinstance(x, list) else x


def plain(x):
    """Canonical text, with whole numbers as such."""
    whole = lambda v: int(v) if isinstance(v, float) and v == int(v) else [whole(y) for y in v] if isinstance(v, list) else {k: whole(y) for k, y in v.items()} if isinstance(v, dict) else v
    return json.dumps(whole(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def flat(x, path="$"):
    if isinstance(x, dict) and x:
        return {p: v for k, y in x.items() for p, v in flat(y, f"{path}.{json.dumps([k], ensure_ascii=False)}").items()}
    if isinstance(x, list) and x:
        return {p: v for k, y in enumerate(x) for p, v in flat(y, f"{path}[{k}]").items()}
    return {path: plain(x)}


def test_canonical_json(spark):
    rng = random.Random(4)
    docs = [made(rng) for _ in range(60)]
    rows = [(k, json.dumps(d, ensure_ascii=bool(k % 2)), json.dumps(shuffled(rng, d), indent=k % 3 or None, ensure_ascii=False)) for k, d in enumerate(docs)]
    frame = spark.createDataFrame([*rows, (100, "no json", "[1"), (101, None, ""), (102, '{"a":1,"a":2}', "{}")], "id long, one string, two string")
    got = frame.select("id", canonical(F.col("one")).alias("a"), canonical(F.col("two")).alias("b"), content_id(F.col("one")).alias("h")).collect()
    for r in got:
        if r.id < 100:
            assert r.a == r.b == plain(docs[r.id]) and r.h == hashlib.sha256(r.a.encode()).hexdigest()[:24]
    assert [(r.a, r.b) for r in got if r.id >= 100] == [(None, None), (None, None), (None, "{}")]
    found = defaultdict(dict)
    for r in leaves(frame.where("id < 100"), "id", "one").collect():
        found[r.id][r.path] = r.value
    assert dict(found) == {k: flat(d) for k, d in enumerate(docs)}
    exact = spark.range(1).select(canonical(F.lit('{"n": 0.123456789012345678901234567890, "m": 12345678901234567890}')).alias("x"), canonical(F.struct(F.lit(2).alias("z"), F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)).alias("m")), T.StructType()).alias("y")).first()
    assert exact.x == '{"m":12345678901234567890,"n":0.12345678901234567890123456789}' and exact.y == '{"m":{"a":2,"b":1},"z":2}'


def test_differences_of_documents(spark):
    a = spark.createDataFrame([(1, '{"x":{"y":1,"z":[1,2]}}'), (2, "[]"), (3, '{"same":1.0}')], "id long, doc string")
    b = spark.createDataFrame([(1, '{"x":{"z":[1,3],"w":null}}'), (3, '{"same":1}'), (4, "5")], "id long, doc string")
    got = {(r.id, r.path): (r.before, r.after) for r in differences(a, b, "id", "doc").collect()}
    assert got == {(1, '$.["x"].["y"]'): ("1", None), (1, '$.["x"].["z"][1]'): ("2", "3"), (1, '$.["x"].["w"]'): (None, "null"), (2, "$"): ("[]", None), (4, "$"): (None, "5")}


def test_revisions_are_verified(spark):
    rng = random.Random(8)
    parents = [(k, p) for k in range(1, 50) for p in {k - 1 if rng.random() < 0.8 else rng.randrange(k), *([rng.randrange(k)] if rng.random() < 0.3 else [])}]
    content = {k: f'{{"k":{k}}}' for k in range(50)}
    stored = {}
    for k in range(50):
        stored[k] = hashlib.sha256("\n".join([content[k], *sorted(stored[p] for r, p in parents if r == k)]).encode()).hexdigest()
    content[20] = content[33] = "tampered"
    rows = [(k, content[k], stored[k]) for k in range(50)] + [(60, "a", "x"), (61, "b", None)]
    rows += [(k, "c", hashlib.sha256(b"c").hexdigest()) for k in (70, 71)] + [(80, "d", hashlib.sha256(b"d").hexdigest())]
    extra = [(80, 999), (80, None)]
    after, open_ = set(), [20, 33, 60, 61]
    while open_:
        n = open_.pop()
        new = {r for r, p in parents if p == n} - after
        after |= new
        open_ += new
    want = {k: "mismatch" if k in (20, 33) else "tainted" if k in after else "verified" for k in range(50)} | {60: "mismatch", 61: "mismatch", 70: "verified", 71: "verified", 80: "dangling"}
    got = revisions.verified(spark.createDataFrame(rows, "revision long, content string, stored string"), spark.createDataFrame(parents + extra + parents[:2], "revision long, parent long")).collect()
    assert {r.revision: r.status for r in got} == want and {r.revision: r.missing for r in got if r.missing} == {80: 999}
    ring = spark.createDataFrame([(k, "c", hashlib.sha256(f"c\n{h}".encode()).hexdigest()) for k, h in ((1, "y"), (2, "z"))], "revision long, content string, stored string")
    assert {r.status for r in revisions.verified(ring, spark.createDataFrame([(1, 2), (2, 1)], "revision long, parent long")).collect()} == {"mismatch"}
    none = spark.createDataFrame([], "revision long, content string, stored string")
    assert revisions.verified(none, spark.createDataFrame([], "revision long, parent long")).count() == 0


def test_many_facts_fold_into_one_row(spark):
    owners = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    born = spark.createDataFrame([(1, 10, "x"), (1, 9, "y"), (2, 5, None), (2, 5, None), (2, 5, None), (7, 1, "lost"), (None, 3, "n")], "who long, day int, place string")
    likes = spark.createDataFrame([(1, 2.5), (3, None)], "owner long, much double")
    wide, over = facts.folded(owners, "id", {"born": (born, "who", ["day", "place"]), "likes": (likes, "owner", ["much"])})
    assert sorted(tuple(r) for r in wide.collect()) == [(1, "a", 9, "y", 2.5), (2, "b", 5, None, None), (3, "c", None, None, None)]
    assert Counter((r.fact, r.owner, r.row, r.n) for r in over.collect()) == Counter([("born", 1, '{"born__day":10,"born__place":"x"}', 1), ("born", 2, '{"born__day":5}', 2), ("born", 7, '{"born__day":1,"born__place":"lost"}', 1)])
    rng = random.Random(2)
    many = [(rng.randrange(12), rng.randrange(4)) for _ in range(200)]
    frame = spark.createDataFrame(many, "o long, v long")
    wide, over = facts.folded(spark.range(10), "id", {f"f{m}": (frame.where(f"v % 3 = {m}"), "o", ["v"]) for m in range(3)})
    slots = {(r.id, m): r[f"f{m}__v"] for r in wide.collect() for m in range(3)}
    assert slots == {(k, m): min((v for o, v in many if o == k and v % 3 == m), default=None) for k in range(10) for m in range(3)}
    back = Counter({(k, v): 1 for (k, m), v in slots.items() if v is not None}) + Counter({(r.owner, json.loads(r.row)[f"{r.fact}__v"]): r.n for r in over.collect()})
    assert back == Counter(many)


EXACT = Model(
    "Exact",
    values=(Value("Rate", "Decimal", Decimal("0.123456789012345678901234567890"), Decimal("99999999999999999999.5")), Value("Share", "Float", 0.1, 0.25), Value("Level", "Decimal", allowed=(Decimal("0.10"), Decimal("2"))), Value("On", "Bool", allowed=(True,)), Value("Day", "Date", "2024-01-01", "2024-02-01")),
    entities=(Entity("Zeta", ("b", "a"), (("a", "Rate", True), ("b", "Day", True), ("c", "Share", False))), Entity("Alpha")),
    facts=(Fact("Uses", (("y", "Zeta"), ("x", "Alpha")), "Use"), Fact("Alone", (("only", "Alpha"),))),
    rules=(Rule("frequency", "Uses", ("x",), low=0, high=3), Rule("uniqueness", "Uses", ("y", "x"))),
    readings=(("Uses", "{y} uses {x}"),), samples=(("Uses", ("z1", "a1")), ("Alone", ("é",)), ("Uses", ("z1", "a1"))), analyses=(("uniform", ("2",)), ("connected", ())),
)


def test_a_model_comes_back_exactly(spark):
    relations = catalog.encode(spark, EXACT)
    again = catalog.decode(relations, "Exact")
    assert again == EXACT and fingerprint(again) == fingerprint(EXACT)
    assert str(again.values[0].low) == "0.123456789012345678901234567890"
    assert catalog.differences(relations, catalog.encode(spark, again)).count() == 0
    less = replace(EXACT, samples=EXACT.samples[:1], analyses=(), _by_name={})
    assert {(r.relation, r.side) for r in catalog.differences(relations, catalog.encode(spark, less)).collect()} == {("samples", "left"), ("analyses", "left")}
    assert catalog.decode({k: df for k, df in relations.items() if k not in ("samples", "analyses")}, "Exact") == replace(EXACT, samples=(), analyses=(), _by_name={})


def test_relations_that_say_two_things_are_refused(spark):
    relations = catalog.encode(spark, EXACT)
    more = {"objects": [("Zeta", "value", "Int")], "roles": [("Uses", "y", 5, "Alpha"), ("Uses", "w", 1, "Alpha")], "domains": [("Share", "0.1", None, [])], "samples": [("Alone", 0, ["b"])]}
    wrong = {k: df.union(spark.createDataFrame(more[k], df.schema)) if k in more else df for k, df in relations.items()}
    found = {(r.relation, tuple(r.key), r.column, r.n) for r in catalog.conflicts(wrong).collect()}
    assert found == {("objects", ("Zeta",), "kind", 2), ("objects", ("Zeta",), "scalar", 2), ("roles", ("Uses", "y"), "ordinal", 2), ("roles", ("Uses", "y"), "player", 2), ("roles", ("Uses", "1"), "name", 2), ("domains", ("Share",), "high", 2), ("domains", ("Share",), "allowed", 1), ("samples", ("0",), "fact", 2), ("samples", ("0",), "literals", 2)} - {("domains", ("Share",), "allowed", 1)}
    with pytest.raises(ModelError):
        catalog.decode(wrong, "Exact")
