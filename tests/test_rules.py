"""Each rule against its plain restatement on small random populations, and the codes that violations carry."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rolewise.operators import facts, rules
from rolewise.plans import compile as plan
from rolewise.plans.model import Entity, Fact, Model, ModelError, Rule, Value


@pytest.fixture(params=[1, 2])
def pairs(spark, request):
    rng = random.Random(request.param)
    rows = [(rng.choice("abcdef"), rng.choice("abcdefg"), rng.randrange(3)) for _ in range(60)]
    return rows, spark.createDataFrame(rows, "a string, b string, c int")


def got(df):
    return {tuple(r) for r in df.collect()}


def test_cardinality(pairs):
    rows, df = pairs
    assert got(facts.duplicates(df, "a", "b", "c")) == {(*k, n) for k, n in Counter(rows).items() if n > 1}
    tuples = defaultdict(set)
    for r in rows:
        tuples[r[0], r[1]].add(r)
    assert got(rules.uniqueness(df, ["a", "b"], ["a", "b", "c"])) == {(*k, len(v)) for k, v in tuples.items() if len(v) > 1}
    assert rules.uniqueness(df, ["a", "b", "c"], ["a", "b", "c"]).count() == 0
    times = Counter(k for k, _ in {((r[0],), r) for r in rows})
    assert got(rules.frequency(df, ["a"], ["a", "b", "c"], 2, 8)) == {(*k, n) for k, n in times.items() if not 2 <= n <= 8}
    raw = Counter(r[0] for r in rows)
    assert got(rules.frequency(df, ["a"], ["a", "b", "c"], 2, 8, sample=True)) == {(k, n) for k, n in raw.items() if not 2 <= n <= 8}
    assert rules.frequency(df.limit(0), ["a"], ["a", "b", "c"], 2, 3).count() == 0  # only keys that occur are bound


def test_sets(pairs):
    rows, df = pairs
    left, right = {(r[0],) for r in rows}, {(r[1],) for r in rows}
    assert got(rules.subset(df, ["b"], df, ["a"])) == right - left
    assert got(rules.exclusion(df, ["a"], df, ["b"])) == left & right
    assert got(rules.equality(df, ["a"], df, ["b"])) == {(*x, "left") for x in left - right} | {(*x, "right") for x in right - left}
    assert got(rules.mandatory(df, "b", df, "a")) == right - left == got(rules.subtype(df, "b", df, "a")) == got(rules.role_player(df, "b", df, "a"))


def test_rings(pairs):
    rows, df = pairs
    two = {r[:2] for r in rows}
    assert got(rules.symmetry(df, "a", "b")) == {p for p in two if p[::-1] not in two}
    n = Counter(tuple(sorted(p)) for p in two)
    assert {(*r.players, r.n) for r in rules.unordered(df, ["a", "b"], ["a", "b"]).collect()} == {(*k, v) for k, v in n.items() if v > 1}
    sorted_rows = Counter(tuple(sorted(r[:2])) for r in rows)
    assert got(facts.duplicates(rules.unordered_canonical(df, ["a", "b"]), "a", "b")) == {(*k, v) for k, v in sorted_rows.items() if v > 1}


def test_identifier_takes_whole_owners_only(spark):
    owners = spark.createDataFrame([(k,) for k in "pqrstu"], "id string")
    first = spark.createDataFrame([("p", "x"), ("q", "x"), ("r", "x"), ("s", "y"), ("t", "x"), ("t", "x")], "owner string, value string")
    last = spark.createDataFrame([("p", "1"), ("q", "1"), ("s", "1"), ("t", "1"), ("u", "1")], "owner string, value string")
    assert got(rules.identifier(owners, "id", [first, last])) == {("x", "1", 2)}  # r lacks a value, t repeats one


@pytest.mark.parametrize(
    ("kind", "literal", "low", "high", "fine"),
    [
        ("Int", "5", 0, 10, True), ("Int", "11", 0, 10, False), ("Int", "x", 0, 10, False), ("Int", "2.5", 0, 10, False), ("Int", "2.0", 0, 10, True),
        ("Decimal", "0.10", 0.1, 1, True), ("Float", "NaN", 0, 10, False), ("Float", "1e1", 0, 10, True), ("Date", "2024-02-30", "2024-01-01", "2024-12-31", False),
        ("Date", "2024-02-29", "2024-01-01", "2024-12-31", True), ("Timestamp", "2024-01-01T00:00:00Z", "2023-01-01", "2025-01-01", True), ("String", "b", "a", "c", True),
    ],
)
def test_ranges(spark, kind, literal, low, high, fine):
    df = spark.createDataFrame([(literal,)], "v string")
    assert rules.value_range(df, "v", low, high, kind).count() == (0 if fine else 1)


def test_oneof(spark):
    df = spark.createDataFrame([("1.0",), ("2",), ("x",), (None,)], "v string")
    assert {r.v for r in rules.value_oneof(df, "v", [1, 3], "Int").collect()} == {"2", "x"}
    assert {r.v for r in rules.value_oneof(df, "v", ["x", 2], "String").collect()} == {"1.0"}


MODEL = Model(
    "People",
    values=(Value("Name", "String"), Value("Age", "Int", 0, 130)),
    entities=(Entity("Person", ("name",), (("name", "Name", True), ("age", "Age", False))), Entity("Employee")),
    facts=(Fact("Knows", (("a", "Person"), ("b", "Person"))), Fact("Works", (("who", "Employee"), ("where", "Name"))), Fact("Boss", (("who", "Employee"),))),
    rules=(
        Rule("symmetric", "Knows"), Rule("unordered", "Knows", ("a", "b")), Rule("uniqueness", "Works", ("who",)), Rule("frequency", "Works", ("who",), low=0, high=1),
        Rule("mandatory", "Works", ("who",)), Rule("subset", "Boss", ("who",), "Works", ("who",)), Rule("exclusion", "Boss", ("who",), "Works", ("who",)), Rule("equality", "Boss", ("who",), "Works", ("who",)),
    ),
    subtypes=(("Employee", "Person"),),
)


def check(spark, people=(), employees=(), knows=(), works=(), boss=()):
    frame = lambda rows, ddl: spark.createDataFrame(list(rows), ddl)
    bound = plan.Binding(
        {"Person": (frame(people, "id string, name string, age string"), "id", {"name": "name", "age": "age"}), "Employee": (frame([(e,) for e in employees], "id string"), "id", {})},
        {"Knows": frame(knows, "a string, b string"), "Works": frame(works, "who string, where string"), "Boss": frame([(b,) for b in boss], "who string")},
    )
    found = plan.violations(MODEL, bound)
    assert {r.obligation_id for r in found.collect()} <= {o for o, _ in plan.obligations(MODEL)}
    return {(r.code, *r.key) for r in found.collect()}


P1, P2 = ("p1", "Ann", "30"), ("p2", "Bob", None)


@pytest.mark.parametrize(
    ("population", "expected"),
    [
        ({"people": [P1, P2]}, set()),
        ({"people": [P1, ("p2", None, None)]}, {("MANDATORY_VIOLATION", "p2")}),
        ({"people": [P1, ("p2", "Ann", None)]}, {("IDENTIFIER_VIOLATION", "Ann")}),
        ({"people": [("p1", "Ann", "131")]}, {("VALUE_CONSTRAINT_VIOLATION", "p1")}),
        ({"people": [P1, P2], "knows": [("p1", "p2")]}, {("SYMMETRY_VIOLATION", "p1", "p2")}),
        ({"people": [P1, P2], "knows": [("p1", "p2"), ("p2", "p1")]}, {("UNORDERED_DUPLICATE", "p1", "p2")}),
        ({"people": [P1, P2], "knows": [("p1", "p1"), ("p1", "p1")]}, {("DUPLICATE_FACT", "p1", "p1")}),
        ({"people": [P1], "knows": [("p1", "p1"), ("p9", "p9"), (None, "p1")]}, {("ROLE_PLAYER_MEMBERSHIP", "p9")}),
        ({"people": [P1], "employees": ["p9"], "works": [("p9", "x")]}, {("SUBTYPE_VIOLATION", "p9"), ("EQUALITY_VIOLATION", "p9")}),
        ({"people": [P1], "employees": ["p1"]}, {("MANDATORY_VIOLATION", "p1")}),
        ({"people": [P1], "employees": ["p1"], "works": [("p1", "x"), ("p1", "y"), ("p1", "y")], "boss": ["p1"]}, {("UNIQUENESS_VIOLATION", "p1"), ("FREQUENCY_VIOLATION", "p1"), ("EXCLUSION_VIOLATION", "p1"), ("DUPLICATE_FACT", "p1", "y")}),
        ({"people": [P1], "employees": ["p1"], "boss": ["p1"]}, {("MANDATORY_VIOLATION", "p1"), ("SUBSET_VIOLATION", "p1"), ("EQUALITY_VIOLATION", "p1")}),
    ],
)
def test_codes(spark, population, expected):
    assert check(spark, **population) == expected


def test_reports(spark):
    found = spark.createDataFrame([("o1", "C", "s", ["b"], 1), ("o1", "C", "s", ["a"], 1), ("o2", "C", "s", ["a"], 1)], "obligation_id string, code string, subject string, key array<string>, n long")
    assert {(r.obligation_id, *r.key) for r in plan.first_witness(found).collect()} == {("o1", "a"), ("o2", "a")}
    assert plan.witnesses(found, 1).count() == 2
    assert {r.instance: r.status for r in plan.isolation(found, F.col("key")[0]).collect()} == {"a": "collateral", "b": "isolated"}
    assert [r.key for r in plan.report(found).collect()] == [["a"], ["b"], ["a"]]


E, V, N = Entity("E"), Value("V", "Int"), Value("N", "String")
TWO = Fact("F", (("x", "E"), ("y", "E")))


@pytest.mark.parametrize(
    "wrong",
    [
        {"values": (Value("V", "Blob"),)}, {"values": (V, V)}, {"values": (Value("V", "String", 1, 2),)}, {"values": (Value("V", "Int", 3, 2),)}, {"values": (Value("V", "Int", 3),)},
        {"values": (Value("V", "Int", allowed=(1, 1)),)}, {"values": (Value("V", "Int", allowed=("a",)),)},
        {"entities": (Entity("E", (), (("f", "Nope", True),)),)}, {"entities": (Entity("E", ("g",), (("f", "V", True),)),), "values": (V,)}, {"entities": (Entity("E", (), (("f", "V", True), ("f", "V", False))),), "values": (V,)},
        {"entities": (E,), "facts": (Fact("F", ()),)}, {"entities": (E,), "facts": (Fact("F", (("x", "E"), ("x", "E"))),)}, {"entities": (E,), "facts": (Fact("F", (("x", "Ghost"),)),)}, {"entities": (E,), "facts": (Fact("F", (("x", "E"),), "E"),)},
        {"entities": (E,), "subtypes": (("E", "E"),)}, {"entities": (E, Entity("D")), "subtypes": (("E", "D"), ("D", "E"))}, {"entities": (E, Entity("D"), Entity("C")), "subtypes": (("E", "D"), ("E", "C"))}, {"entities": (E,), "values": (V,), "subtypes": (("E", "V"),)},
        {"entities": (Entity("E", ("f",), (("f", "V", True),)), Entity("D")), "values": (V,), "subtypes": (("E", "D"),)},
        *[{"entities": (E,), "values": (V,), "facts": (TWO, Fact("G", (("z", "V"),))), "rules": (r,)} for r in (
            Rule("nonsense", "F", ("x",)), Rule("uniqueness", "Nope", ("x",)), Rule("uniqueness", "F", ("q",)), Rule("uniqueness", "F"), Rule("mandatory", "F", ("x", "y")),
            Rule("frequency", "F", ("x",), low=3, high=2), Rule("frequency", "F", ("x",), low=-1), Rule("unordered", "F", ("x",)), Rule("symmetric", "G"), Rule("subset", "F", ("x",), "G", ("z",)), Rule("equality", "F", ("x", "y"), "F", ("x",)),
        )],
    ],
)
def test_models_that_are_refused(wrong):
    with pytest.raises(ModelError):
        Model("M", **wrong)


def test_identifier_is_inherited():
    model = Model("M", values=(N,), entities=(Entity("Top", ("n",), (("n", "N", True),)), Entity("Mid"), Entity("Low")), subtypes=(("Low", "Mid"), ("Mid", "Top")))
    assert model.identifier("Low") == ("n",) and model.above("Low") == ["Low", "Mid", "Top"]
