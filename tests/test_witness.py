import test_rules

from rolewise import queries
from rolewise.plans import compile as plan
from rolewise.plans import witness
from rolewise.plans.model import Entity, Fact, Model, Rule, Value

SIMPLE = Model(
    "Simple",
    values=(Value("Age", "Int", 0, 130), Value("Name", "String"), Value("Level", "String", allowed=("a", "b"))),
    entities=(Entity("Person", ("name",), (("name", "Name", True), ("age", "Age", False), ("level", "Level", False))), Entity("Staff")),
    facts=(Fact("Likes", (("who", "Person"), ("what", "Person"))), Fact("Knows", (("a", "Person"), ("b", "Person"))), Fact("Owns", (("who", "Person"), ("thing", "Name"))), Fact("Keeps", (("who", "Person"),)), Fact("Fears", (("who", "Person"),))),
    rules=(Rule("symmetric", "Knows"), Rule("unordered", "Likes", ("who", "what")), Rule("frequency", "Owns", ("who",), low=1, high=2), Rule("uniqueness", "Likes", ("who",)), Rule("subset", "Keeps", ("who",), "Owns", ("who",)), Rule("exclusion", "Fears", ("who",), "Keeps", ("who",))),
    subtypes=(("Staff", "Person"),),
)


def test_every_obligation_has_a_witness_that_breaks_it_alone(spark):
    got = {r.obligation_id: (r.status, r.broken) for r in witness.counterexamples(spark, SIMPLE).collect()}
    # a stranger also plays the reverse, or the role that its own is a subset of; literals are members of nothing that is bound
    assert {o: s for o, (s, _) in got.items() if s != "isolated"} == {
        "player:Knows.a": "collateral", "player:Knows.b": "collateral", "player:Keeps.who": "collateral", "player:Owns.thing": "not_independently_falsifiable",
    }
    assert got["player:Knows.a"][1] == ["player:Knows.a", "player:Knows.b"]


def test_rules_in_conflict_are_told_as_such(spark):
    got = {r.obligation_id: (r.status, r.broken) for r in witness.counterexamples(spark, test_rules.MODEL).collect()}
    assert got["subset:Boss(who):Works(who)"][0] == "collateral"  # equality says the same and more
    assert got["mandatory:Works(who)"][0] == "isolated" or "equality:Boss(who):Works(who)" in got["mandatory:Works(who)"][1]
    shop = {r.obligation_id: r.status for r in witness.counterexamples(spark, queries.COMMERCE).collect()}
    assert shop["frequency:Contains(order):2..7"] == shop["set:Contains"] == shop["unordered:Handover(prev,next)"] == "isolated"


def test_probes_are_accepted(spark):
    rows = witness.probes(spark, SIMPLE).collect()
    of_values = {("value:Person.age", "0"), ("value:Person.age", "130"), ("value:Person.level", "a"), ("value:Person.level", "b")}
    assert {(r.obligation_id, r.probe) for r in rows if r.obligation_id.startswith("value:")} == of_values
    probed = {r.obligation_id for r in rows}
    assert probed == {o for o, _ in plan.obligations(SIMPLE) if not o.startswith(("player:", "required:"))}
    assert [r for r in rows if not r.accepted] == []


def test_shrunk_witnesses_have_nothing_to_spare(spark):
    small = witness.shrunk(spark, SIMPLE)
    rows = {r.obligation_id: r for r in small.collect()}
    isolated = {r.obligation_id for r in witness.counterexamples(spark, SIMPLE).where("status = 'isolated'").collect()}
    assert set(rows) == isolated
    assert (rows["set:Keeps"].fact_rows, rows["uniqueness:Likes(who)"].fact_rows, rows["frequency:Owns(who):1..2"].fact_rows) == (3, 2, 3)  # a subset needs its other side
    assert (rows["value:Person.age"].fact_rows, rows["value:Person.age"].members, rows["subtype:Staff<Person"].members) == (0, 1, 1)
    stats = witness.sizes(small).first()
    assert stats.witnesses == len(rows) and stats.most_fact_rows == 3 and stats.left_out == sum(r.left_out for r in rows.values())
