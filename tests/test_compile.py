"""The compiler says what it checks, checks all that it says, and reads and shuffles each table once."""

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rolewise import queries
from rolewise.functions import scalar
from rolewise.operators import facts
from rolewise.plans import compile as plan
from rolewise.plans.model import Entity, Fact, Model, ModelError, Rule, Value

SF = "/root/testdata/sf0.001"


def test_what_was_not_checked_does_not_hold(spark):
    model = Model("M", entities=(Entity("P"),), facts=(Fact("F", (("x", "P"),)), Fact("H", (("q", "P"),))), rules=(Rule("mandatory", "H", ("q",)),))
    bound = plan.Binding(facts={"F": spark.createDataFrame([("a",)], "x string")})
    rows = plan.summary(model, plan.violations(model, bound), plan.checked(model, bound)).collect()
    assert {r.obligation_id: r.status for r in rows} == {"set:F": "holds", "set:H": "not_checked", "player:F.x": "not_checked", "player:H.q": "not_checked", "mandatory:H(q)": "not_checked"}


def test_every_bound_obligation_of_the_shop_is_checked(spark):
    assert plan.checked(queries.COMMERCE, queries.binding(spark, SF)) == {o for o, _ in plan.obligations(queries.COMMERCE)}


def test_frequency_over_all_roles_and_domains_of_value_roles(spark):
    model = Model(
        "M",
        values=(Value("Size", "Int", 1, 45), Value("Day", "Date", "2024-01-01", "2024-12-31")),
        entities=(Entity("P"),),
        facts=(Fact("F", (("x", "P"),)), Fact("G", (("p", "P"), ("n", "Size"), ("d", "Day")))),
        rules=(Rule("frequency", "F", ("x",), low=2, high=3), Rule("uniqueness", "F", ("x",))),
    )
    rows = [("a", "99", "2024-02-30"), ("a", "45", "2024-12-31"), ("b", "99", "2025-01-01"), ("b", "1.5", None), ("c", "x", "2024-05-01")]
    bound = plan.Binding(facts={"F": spark.createDataFrame([("a",), ("a",)], "x string"), "G": spark.createDataFrame(rows, "p string, n string, d string")})
    found = {(r.obligation_id, r.code, tuple(r.key), r.n) for r in plan.violations(model, bound).collect()}
    assert found == {
        ("set:F", "DUPLICATE_FACT", ("a",), 2),
        ("frequency:F(x):2..3", "FREQUENCY_VIOLATION", ("a",), 1),
        ("value:G.n", "VALUE_CONSTRAINT_VIOLATION", ("99",), 2),
        ("value:G.n", "VALUE_CONSTRAINT_VIOLATION", ("x",), 1),
        ("player:G.n", "ROLE_PLAYER_MEMBERSHIP", ("x",), 1),
        ("value:G.d", "VALUE_CONSTRAINT_VIOLATION", ("2024-02-30",), 1),
        ("player:G.d", "ROLE_PLAYER_MEMBERSHIP", ("2024-02-30",), 1),
        ("value:G.d", "VALUE_CONSTRAINT_VIOLATION", ("2025-01-01",), 1),
    }


@pytest.mark.parametrize("kind, low, high", [("Date", "2024-02-01", "2024-01-01"), ("Date", 1, 2), ("Timestamp", "x", "y"), ("String", "a", "b"), ("UUID", "a", "b")])
def test_ranges_that_a_model_refuses(kind, low, high):
    with pytest.raises(ModelError):
        Model("M", values=(Value("V", kind, low, high),))


def test_decimals_compare_exactly(spark):
    texts = ["45", "45.0", "45.00000000001", "44.99999999999", "45.000000000000000000000001", "0.99999999999", "1.00000000001", "1", "1.0000000000", "-45.00000000001", "-44.99999999999",
             "-45", "1e1", "4.6e1", " 2 ", "x", "", "45.0000000000", "0.1", "0.10000000000001", "00045.00"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")

    def number(t):
        try:
            return Decimal(t.strip())
        except ArithmeticError:
            return None

    got = table.select("t", scalar.in_range(F.col("t"), 1, 45, "Decimal").alias("up"), scalar.in_range(F.col("t"), -45, -1, "Decimal").alias("down"), scalar.in_range(F.col("t"), 1, 45, "Int").alias("whole"), scalar.one_of(F.col("t"), [45, 1], "Decimal").alias("one")).collect()
    for r in got:
        n = number(r.t)
        assert r.up == (n is not None and 1 <= n <= 45), r
        assert r.down == (n is not None and -45 <= n <= -1), r
        assert r.whole == (n is not None and n == int(n) and 1 <= n <= 45), r
        assert r.one == (n in (45, 1)), r
    typed = spark.createDataFrame([(k,) for k in ("1", "0", "TRUE", "False", "yes", "2", None)], "t string").select(scalar.typed(F.col("t"), "Bool").alias("b")).collect()
    assert [r.b for r in typed] == [True, False, True, False, None, None, None]


def test_following_equals_a_lead_over_whole_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(50), k, rng.choice([None, rng.randrange(9)])) for k in range(400)]
    table = spark.createDataFrame(rows, "g string, t int, id int, v int")
    by_group = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by_group[r[0]].append(r)
    expected = Counter((*r, n[3] if n else None) for g in by_group.values() for r, n in zip(g, [*g[1:], None]))
    for part in (F.expr("t div 7"), F.lit(0), F.col("t")):
        assert Counter(map(tuple, facts.following(table, "g", ["t", "id"], "v", part).collect())) == expected


def test_projections_read_their_base_once(spark):
    bound = queries.binding(spark, SF)
    plain = plan.Binding(bound.entities, {**bound.facts, "Supply": bound.facts["Line"].select("part", "supplier"), "Contains": bound.facts["Line"].select("order", "part")})
    show = lambda b: Counter((r.obligation_id, r.code, r.subject, tuple(r.key), r.n) for r in plan.violations(queries.COMMERCE, b).collect())
    assert show(bound) == show(plain)
    with pytest.raises(ValueError):
        plan.violations(queries.COMMERCE, plan.Binding(facts=bound.facts, projections={"Contains": ("Line", {"order": "order", "part": "nothing"})}))


def test_the_plan_scans_and_shuffles_lineitem_once(spark):
    found = plan.violations(queries.COMMERCE, queries.binding(spark, SF))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that reused exchanges show in the plan before it runs
    try:
        text = plan.violations(queries.COMMERCE, queries.binding(spark, SF))._jdf.queryExecution().executedPlan().treeString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum("Scan" in line and "l_orderkey" in line for line in text.splitlines()) == 1
    assert found.count() > 0


def test_binding_problems(spark):
    assert plan.binding_problems(queries.COMMERCE, queries.binding(spark, SF)) == []
    model = Model("M", values=(Value("N", "String"),), entities=(Entity("P", (), (("a", "N", False), ("b", "N", False))), Entity("Q")), facts=(Fact("F", (("x", "P"), ("y", "P"))), Fact("G", (("x", "P"),)), Fact("H", (("x", "P"),))))
    table = spark.createDataFrame([], "id string, a string, x string")
    bound = plan.Binding({"P": (table, "key", {"a": "a", "c": "a"}), "R": (table, "id", {})}, {"F": table, "Z": table}, {"G": ("F", {"x": "z"})})
    assert plan.binding_problems(model, bound) == sorted([
        ("P", "the table has no key column key"), ("P.c", "no such field"), ("P.b", "not bound"), ("R", "no such entity"), ("F.y", "the table has no such column"), ("Z", "no such fact"),
        ("G.x", "F has no role z"), ("Q", "not bound"), ("H", "not bound"),
    ])


def test_what_facts_are_objectified_as(spark):
    model = Model("R", entities=(Entity("A"),), facts=(Fact("F", (("x", "A"), ("y", "A")), "Rec"), Fact("G", (("of", "Rec"),))), rules=(Rule("mandatory", "G", ("of",)),))
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    records = make([(1, "a", "b"), (2, "a", "b"), (3, "a", "c"), (4, "z", "z"), (5, None, "b"), (6, "a", "c"), (6, "b", "a"), (3, "a", "c"), (None, "a", "b")], "id int, p string, q string")
    bound = plan.Binding(
        entities={"A": (make([("a",), ("b",), ("c",)], "k string"), "k", {})}, facts={"F": make([("a", "b"), ("a", "c"), ("b", "a"), ("a", "b")], "x string, y string"), "G": make([(1,), (2,), (9,)], "of int")}, records={"Rec": (records, "id", {"x": "p", "y": "q"})},
    )
    found, decided = plan.evaluated(model, bound)
    got = {(r.obligation_id, r.code, r.key[0]) for r in found.collect() if not r.obligation_id.startswith("set:")}
    name = "objectification:Rec"
    assert got == {
        (name, "OBJECTIFICATION_OCCURRENCE", "4"), (name, "OBJECTIFICATION_OCCURRENCE", "5"), (name, "OBJECTIFICATION_INJECTIVITY", "2"), (name, "OBJECTIFICATION_INJECTIVITY", "6"), (name, "OBJECTIFICATION_FUNCTION", "6"), ("player:G.of", "ROLE_PLAYER_MEMBERSHIP", "9"),
        *[("mandatory:G(of)", "MANDATORY_VIOLATION", k) for k in "3456"],
    }
    assert {(r.kind, r.violations, r.status) for r in plan.summary(model, found, decided).collect() if r.obligation_id == name} == {("objectification", 5, "violated")}
    assert plan.binding_problems(model, plan.Binding(records={"Rec": (records, "id", {"x": "p"}), "No": (records, "id", {})}))[:2] == [("A", "not bound"), ("F", "not bound")]
    assert ("Rec.y", "not bound") in plan.binding_problems(model, plan.Binding(records={"Rec": (records, "id", {"x": "p"})}))
