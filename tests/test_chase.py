"""The chase against a plain one, obligations that follow from others, and witnesses beyond any fixed depth."""

import random

from rolewise.plans import chase, implied, witness
from rolewise.plans.model import Entity, Fact, Model, Rule, Value

#: Seven types in a row, each of which must take part in a fact with the next.
ROW = Model(
    "Row", entities=tuple(Entity(t) for t in "ABCDEFG"), facts=tuple(Fact(f"F{a}", (("x", a), ("y", b))) for a, b in zip("ABCDEF", "BCDEFG")), rules=tuple(Rule("mandatory", f"F{a}", ("x",)) for a in "ABCDEF")
)

MIXED = Model(
    "Mixed",
    values=(Value("Nick", "String"), Value("Size", "Int", 1, 9), Value("Kind", "String", allowed=("p", "q")), Value("Day", "Date", "2024-01-01", "2024-03-01")),
    entities=(Entity("Person", ("nick",), (("nick", "Nick", True), ("size", "Size", False))), Entity("Staff"), Entity("Box")),
    facts=(Fact("Knows", (("a", "Person"), ("b", "Person"))), Fact("Owns", (("who", "Person"), ("box", "Box"), ("kind", "Kind"))), Fact("Holds", (("who", "Staff"), ("box", "Box"))), Fact("Since", (("who", "Staff"), ("day", "Day")))),
    rules=(Rule("symmetric", "Knows"), Rule("subset", "Holds", ("who", "box"), "Owns", ("who", "box")), Rule("mandatory", "Since", ("who",)), Rule("frequency", "Holds", ("who",), low=2, high=4), Rule("equality", "Since", ("who",), "Holds", ("who",))),
    subtypes=(("Staff", "Person"),),
)


def population(seed):
    rng = random.Random(seed)
    ids = [f"0|i{k}" for k in range(12)]
    atoms = [("0", "member", "Person", [i, f"{i}n", "3"]) for i in ids[:8]] + [("0", "member", "Staff", [i]) for i in rng.sample(ids[:10], 5)] + [("0", "member", "Box", [f"0|b{k}"]) for k in range(3)]
    atoms += [("0", "fact", "Knows", rng.sample(ids[:8], 2)) for _ in range(6)] + [("0", "fact", "Holds", [rng.choice(ids[:8]), "0|b1"]) for _ in range(3)] + [("0", "fact", "Since", [ids[1], "0|2024-02-01"])] * 2
    return atoms


def plain(model, atoms):
    """How many rows of each kind are there in the end, adding one at a time until nothing is asked for."""
    facts, members, n = {(o, tuple(r)) for _, k, o, r in atoms if k == "fact"}, {(o, r[0]) for _, k, o, r in atoms if k == "member"}, 0
    asked, entities = chase.asks(model), {e.name for e in model.entities}
    while True:
        todo = None
        for sub, sup in model.subtypes:
            todo = next((("member", sup, i) for o, i in sorted(members) if o == sub and (sup, i) not in members), todo)
        for _, by, of, key_at, to, at, times in asked if todo is None else []:
            rows = [(i,) for o, i in sorted(members) if o == of] if by == "member" else [r for o, r in sorted(facts) if o == of]
            for row in rows:
                key = tuple(row[k] for k in key_at)
                if sum(o == to and tuple(r[k] for k in at) == key for o, r in facts) < times:
                    todo = ("fact", to, dict(zip(at, key)))
        if todo is None:
            return {k: sum(o == k for o, _ in facts) for k in {o for o, _ in facts}}, {k: sum(o == k for o, _ in members) for k in {o for o, _ in members}}
        n += 1
        if todo[0] == "member":
            members.add(todo[1:])
            continue
        row = []
        for k, (_, player) in enumerate(model.fact(todo[1]).roles):
            row.append(todo[2].get(k, f"0|{player}~{n}"))
            if k not in todo[2] and player in entities:
                members.add((player, row[-1]))
        facts.add((todo[1], tuple(row)))


def test_chase_meets_every_rule_and_adds_what_a_plain_one_does(spark):
    for seed in (1, 2):
        atoms = population(seed)
        frame = spark.createDataFrame(atoms, chase.ATOMS).repartition(3)
        found = chase.chased(MIXED, frame).collect()
        got = [tuple(r) for r in found]
        assert all(sum(x == (c, k, o, r) for x in got) >= 1 for c, k, o, r in atoms)
        broken = {o for r in witness.broken(MIXED, spark.createDataFrame(got, chase.ATOMS)).collect() for o in r.broken}
        assert not {o for o in broken if o.startswith(("symmetric", "subset", "equality", "mandatory", "subtype"))} and not any(o.startswith("frequency") for o in broken)
        facts, members = plain(MIXED, atoms)
        for name, n in facts.items():
            rows = {tuple(r) for _, k, o, r in got if (k, o) == ("fact", name)}
            # rules that ask at once may be met by one row in the plain chase, where they take turns
            assert len(rows) >= n if name in ("Holds", "Owns", "Since") else len(rows) == n
        assert len({r[0] for _, k, o, r in got if (k, o) == ("member", "Person")}) >= members["Person"]
        again = sorted(map(str, chase.chased(MIXED, frame.repartition(5)).collect()))
        assert again == sorted(map(str, found))


def test_a_row_of_types_longer_than_any_depth(spark):
    status = {r.obligation_id: r.status for r in witness.counterexamples(spark, ROW).collect()}
    assert set(status.values()) == {"isolated"}
    assert [r for r in witness.probes(spark, ROW).collect() if not r.accepted] == []
    assert chase.closing(ROW) == set()
    assert {r.obligation_id: r.fact_rows for r in witness.shrunk(spark, ROW).collect()}["mandatory:FA(x)"] == 0


def test_ways_that_lead_back_are_closed(spark):
    loop = Model("Loop", entities=(Entity("P"),), facts=(Fact("Needs", (("who", "P"), ("what", "P"))),), rules=(Rule("mandatory", "Needs", ("who",)), Rule("frequency", "Needs", ("who",), low=1, high=3)))
    assert chase.closing(loop) == {"mandatory:Needs(who)"}
    atoms = spark.createDataFrame([("0", "member", "P", [f"0|{k}"]) for k in range(5)] + [("1", "member", "P", ["1|0"])], chase.ATOMS)
    rows = [r for r in chase.chased(loop, atoms).collect()]
    assert sum(r.kind == "fact" for r in rows) == 8 and sum(r.kind == "member" for r in rows) == 8  # one more for each case, which needs itself
    assert witness.broken(loop, chase.chased(loop, atoms)).count() == 0


def test_obligations_that_follow_from_others(spark):
    model = Model(
        "Follows",
        values=(Value("Bit", "String", allowed=("0", "1")), Value("One", "Int", 4, 4)),
        entities=(Entity("A"), Entity("B")),
        facts=(Fact("F", (("x", "A"), ("y", "B"))), Fact("G", (("x", "A"), ("y", "B"), ("z", "B"))), Fact("H", (("x", "A"), ("bit", "Bit"))), Fact("K", (("x", "A"), ("one", "One"))), Fact("L", (("x", "A"),)), Fact("M", (("x", "A"),)), Fact("N", (("x", "A"),))),
        rules=(
            Rule("uniqueness", "F", ("x", "y")), Rule("frequency", "F", ("x", "y"), low=0, high=2), Rule("uniqueness", "G", ("x",)), Rule("uniqueness", "G", ("x", "y")), Rule("frequency", "H", ("x",), low=0, high=2), Rule("uniqueness", "H", ("x",)),
            Rule("frequency", "H", ("bit",), low=0, high=5), Rule("uniqueness", "K", ("x",)), Rule("subset", "L", ("x",), "M", ("x",)), Rule("subset", "M", ("x",), "N", ("x",)), Rule("subset", "L", ("x",), "N", ("x",)), Rule("frequency", "G", ("z",), low=0, high=None),
        ),
    )
    got = {r.obligation_id: r for r in witness.counterexamples(spark, model).collect()}
    none = "not_independently_falsifiable"
    assert {o: got[o].status for o in ("uniqueness:F(x,y)", "frequency:F(x,y):0..2", "uniqueness:K(x)", "frequency:H(x):0..2", "frequency:G(z):0..")} == dict.fromkeys(("uniqueness:F(x,y)", "frequency:F(x,y):0..2", "uniqueness:K(x)", "frequency:H(x):0..2", "frequency:G(z):0.."), none)
    assert (got["uniqueness:G(x,y)"].status, got["uniqueness:G(x,y)"].implied) == ("collateral", True) and (got["uniqueness:G(x)"].status, got["uniqueness:G(x)"].implied) == ("isolated", False)
    assert (got["subset:L(x):N(x)"].status, got["subset:L(x):N(x)"].implied) == ("collateral", True) and not got["subset:L(x):M(x)"].implied
    assert (got["frequency:H(bit):0..5"].status, got["frequency:H(bit):0..5"].implied) == ("isolated", False)


def test_dependencies_come_through_subsets():
    model = Model(
        "Through", entities=(Entity("A"), Entity("B")), facts=(Fact("F", (("x", "A"), ("y", "B"))), Fact("G", (("p", "A"), ("q", "B"), ("r", "B")))),
        rules=(Rule("subset", "F", ("x", "y"), "G", ("p", "q")), Rule("uniqueness", "G", ("p",)), Rule("uniqueness", "F", ("x",)), Rule("uniqueness", "F", ("y",))),
    )
    by_id = {r.id: r for r in model.rules}
    assert implied.counts(model, by_id["uniqueness:F(x)"]) and not implied.counts(model, by_id["uniqueness:F(y)"]) and not implied.counts(model, by_id["uniqueness:G(p)"])
