"""Every code that a population or sample can be told, each from a population that has just this wrong, and clean ones."""

from collections import defaultdict

import pytest

from rolewise.plans import population
from rolewise.plans.model import Entity, Fact, Model, Rule, Value

MODEL = Model(
    "Work",
    values=(Value("Age", "Int", 0, 130), Value("Name", "String"), Value("Level", "String", allowed=("a", "b"))),
    entities=(Entity("Person", ("name",), (("name", "Name", True), ("age", "Age", False))), Entity("Staff"), Entity("Firm")),
    facts=(Fact("Works", (("who", "Person"), ("at", "Firm")), "Job"), Fact("Knows", (("a", "Person"), ("b", "Person"))), Fact("Pairs", (("a", "Person"), ("b", "Person"))), Fact("Left", (("who", "Person"),)), Fact("Busy", (("who", "Person"),))),
    rules=(Rule("uniqueness", "Works", ("who",)), Rule("mandatory", "Works", ("at",)), Rule("frequency", "Works", ("at",), low=1, high=2), Rule("symmetric", "Knows"), Rule("unordered", "Pairs", ("a", "b")),
           Rule("subset", "Busy", ("who",), "Works", ("who",)), Rule("exclusion", "Left", ("who",), "Works", ("who",))),
    subtypes=(("Staff", "Person"),),
)


class Population:
    """A population without fault, and what a test changes of it."""

    def __init__(self):
        self.members = {("Person", "p1"), ("Person", "p2"), ("Staff", "p1"), ("Firm", "f"), ("Name", "n1"), ("Name", "n2"), ("Age", "a1"), ("Job", "j1")}
        self.values = {("n1", "Name", "Ann"), ("n2", "Name", "Bob"), ("a1", "Age", "30")}
        self.facts = [("Person__name", 0, ["p1", "n1"]), ("Person__name", 1, ["p2", "n2"]), ("Person__age", 0, ["p1", "a1"]), ("Works", 0, ["p1", "f"]), ("Knows", 0, ["p1", "p1"]), ("Pairs", 0, ["p1", "p2"]), ("Busy", 0, ["p1"]), ("Left", 0, ["p2"])]
        self.bound = {("j1", "Job", "Works", 0)}

    def numbered(self, k):
        """The same population with instances and rows that no other has."""
        at = lambda i: f"{k}|{i}"
        return (
            [(t, at(i)) for t, i in self.members],
            [(at(i), t, x if t != "Name" else at(x)) for i, t, x in self.values],
            [(f, 100 * k + n, [at(i) for i in players]) for f, n, players in self.facts],
            [(at(i), t, f, 100 * k + n) for i, t, f, n in self.bound],
        )


def case_of(r):
    """The case that a violation belongs to, from an instance or a row in its key; cases that are told by a type are the only ones that name it."""
    said = r.key[0]
    if "|" in said:
        return int(said.split("|")[0])
    return int(said) // 100 if said.isdigit() else next(k for k, c in enumerate(CODES) if c == r.code)


def change(name):
    p = Population()
    add, fact = p.members.add, p.facts.append
    {
        "clean": lambda: None,
        "UNKNOWN_OBJECT_TYPE": lambda: add(("Ghost", "g")),
        "VALUE_TYPE_MISMATCH": lambda: add(("Name", "a1")),
        "MISSING_VALUE_LITERAL": lambda: add(("Level", "l9")),
        "VALUE_CONSTRAINT_VIOLATION": lambda: (add(("Age", "a9")), p.values.add(("a9", "Age", "131"))),
        "UNKNOWN_FACT_TYPE": lambda: fact(("Nothing", 0, ["p1"])),
        "FACT_ARITY": lambda: fact(("Works", 9, ["p2"])),
        "ROLE_PLAYER_MEMBERSHIP": lambda: fact(("Knows", 1, ["s", "s"])),
        "OBJECTIFICATION_TYPE": lambda: p.bound.add(("p1", "Person", "Works", 0)),
        "OBJECTIFICATION_MEMBERSHIP": lambda: (p.bound.clear(), p.bound.add(("j7", "Job", "Works", 0))),
        "OBJECTIFICATION_FACT": lambda: (p.bound.clear(), p.bound.add(("j1", "Job", "Knows", 0))),
        "OBJECTIFICATION_OCCURRENCE": lambda: (p.bound.clear(), p.bound.add(("j1", "Job", "Works", 5))),
        "OBJECTIFICATION_INJECTIVITY": lambda: (add(("Job", "j2")), p.bound.add(("j2", "Job", "Works", 0))),
        "DUPLICATE_FACT": lambda: fact(("Works", 1, ["p1", "f"])),
        "UNIQUENESS_VIOLATION": lambda: fact(("Person__age", 1, ["p1", "n1"])),
        "MANDATORY_VIOLATION": lambda: add(("Firm", "g")),
        "FREQUENCY_VIOLATION": lambda: [(add(("Person", x)), add(("Name", x)), p.values.add((x, "Name", x)), fact(("Person__name", "pqr".index(x) + 1, [x, x])), fact(("Works", "pqr".index(x) + 1, [x, "f"]))) for x in "qr"],
        "UNORDERED_DUPLICATE": lambda: fact(("Pairs", 1, ["p2", "p1"])),
        "SYMMETRY_VIOLATION": lambda: fact(("Knows", 1, ["p1", "p2"])),
        "IDENTIFIER_VIOLATION": lambda: (p.facts.__setitem__(1, ("Person__name", 1, ["p2", "n1"]))),
        "SUBSET_VIOLATION": lambda: fact(("Busy", 1, ["p2"])),
        "EXCLUSION_VIOLATION": lambda: fact(("Left", 1, ["p1"])),
        "SUBTYPE_VIOLATION": lambda: add(("Staff", "t")),
    }[name]()
    return p


ALONE = {"UNIQUENESS_VIOLATION": {"ROLE_PLAYER_MEMBERSHIP", "UNIQUENESS_VIOLATION"}}


CODES = [
    "clean", "UNKNOWN_OBJECT_TYPE", "VALUE_TYPE_MISMATCH", "MISSING_VALUE_LITERAL", "VALUE_CONSTRAINT_VIOLATION", "UNKNOWN_FACT_TYPE", "FACT_ARITY", "ROLE_PLAYER_MEMBERSHIP", "OBJECTIFICATION_TYPE", "OBJECTIFICATION_MEMBERSHIP",
    "OBJECTIFICATION_FACT", "OBJECTIFICATION_OCCURRENCE", "OBJECTIFICATION_INJECTIVITY", "DUPLICATE_FACT", "UNIQUENESS_VIOLATION", "MANDATORY_VIOLATION", "FREQUENCY_VIOLATION", "UNORDERED_DUPLICATE", "SYMMETRY_VIOLATION",
    "IDENTIFIER_VIOLATION", "SUBSET_VIOLATION", "EXCLUSION_VIOLATION", "SUBTYPE_VIOLATION",
]


def test_each_code_is_told_alone(spark):
    """One population for each code, all judged by one plan."""
    parts = [sum(x, []) for x in zip(*(change(code).numbered(k) for k, code in enumerate(CODES)))]
    schemas = {
        "memberships": "object_type string, instance_id string",
        "values": "instance_id string, value_type string, literal string",
        "facts": "fact string, row_index long, players array<string>",
        "objectifications": "instance_id string, object_type string, fact string, row_index long",
    }
    relations = {name: spark.createDataFrame(rows, ddl) for (name, ddl), rows in zip(schemas.items(), parts)}
    told = defaultdict(set)
    for r in population.violations(MODEL, relations).collect():
        told[case_of(r)].add(r.code)
    assert {code: told[k] for k, code in enumerate(CODES)} == {code: ALONE.get(code, set() if code == "clean" else {code}) for code in CODES}


SAMPLED = Model(
    "S",
    values=(Value("X", "Int", 0, 10),),
    entities=(Entity("A"),),
    facts=tuple(Fact(n, (("a", "A"), ("b", "A"))) for n in ("F", "P")) + (Fact("V", (("a", "A"), ("x", "X"))),) + tuple(Fact(n, (("x", "A"),)) for n in "GHK"),
    rules=(Rule("uniqueness", "F", ("a",)), Rule("frequency", "F", ("a",), low=0, high=1), Rule("unordered", "P", ("a", "b")), Rule("subset", "G", ("x",), "H", ("x",)), Rule("equality", "H", ("x",), "K", ("x",)), Rule("exclusion", "G", ("x",), "K", ("x",))),
)


@pytest.mark.parametrize(
    "rows, codes",
    [
        ([("P", ["alice", "bob"]), ("P", ["bob", "alice"])], ["DUPLICATE_FACT"]),
        ([("F", ["a1", "b1"]), ("F", ["a1", "b2"])], ["FREQUENCY_VIOLATION", "UNIQUENESS_VIOLATION"]),
        ([("F", ["a1", "b1"]), ("F", ["a1", "b1"])], ["DUPLICATE_FACT", "FREQUENCY_VIOLATION"]),
        ([("V", ["a1", "11"])], ["VALUE_CONSTRAINT_VIOLATION"]),
        ([("V", ["a1"])], ["SAMPLE_ARITY"]),
        ([("Z", ["a1"])], ["SAMPLE_UNKNOWN_FACT"]),
        ([("G", ["x"]), ("H", ["y"]), ("K", ["y"])], ["SUBSET_VIOLATION"]),
        ([("G", ["x"]), ("H", ["x"]), ("K", ["x"])], ["EXCLUSION_VIOLATION"]),
        ([("G", ["x"]), ("H", ["x"])], ["EQUALITY_VIOLATION"]),
        ([], []),
    ],
)
def test_samples(spark, rows, codes):
    table = spark.createDataFrame([(f, k, p) for k, (f, p) in enumerate(rows)], "fact string, row_index long, players array<string>")
    assert sorted({r.code for r in population.sample_violations(SAMPLED, table).collect()}) == codes


def test_gaps_and_lowering(spark):
    p = Population()
    p.members |= {("Staff", "s")}
    p.values |= {("n9", "Name", "Zed")}
    p.facts += [("Person__age", 1, ["p1", "n1"]), ("Works", 1, ["p2", "f"])]
    relations = {
        "memberships": spark.createDataFrame(sorted(p.members | {("Job", "j9")}), "object_type string, instance_id string"),
        "values": spark.createDataFrame(sorted(p.values), "instance_id string, value_type string, literal string"),
        "facts": spark.createDataFrame(p.facts, "fact string, row_index long, players array<string>"),
        "objectifications": spark.createDataFrame(sorted(p.bound), "instance_id string, object_type string, fact string, row_index long"),
    }
    found = population.gaps(MODEL, relations)
    plain = {("standalone_value", "Name", "n9"), ("invalid_subtype", "Staff", "s"), ("multivalued_field", "Person__age", "p1"), ("unresolved_objectification", "Job", "j9")}
    assert {tuple(r) for r in found.collect()} == plain  # nothing is played by a job, so its occurrences need no binding
    paid = Model("Paid", values=MODEL.values, entities=MODEL.entities, facts=(*MODEL.facts, Fact("Pays", (("job", "Job"), ("level", "Level")))), subtypes=MODEL.subtypes)
    assert {tuple(r) for r in population.gaps(paid, relations).collect()} == plain | {("unresolved_objectification", "Works", "1")}
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case string")
    in_cases = spark.createDataFrame([("a", "standalone_value"), ("a", "multivalued_field"), ("b", "multivalued_field")], "case string, gap string")
    effects = {"wide": population.EFFECTS, "graph": {"standalone_value": "unsupported"}}
    rows = population.lowering(in_cases, cases, effects)
    assert {tuple(r) for r in rows.collect()} == {
        ("a", "wide", "unsupported"), ("b", "wide", "representation_prevents_exact_realization"), ("c", "wide", "lowered"), ("a", "graph", "unsupported"), ("b", "graph", "lowered"), ("c", "graph", "lowered"),
    }
    assert {tuple(r) for r in population.lowering_counts(rows).collect()} == {("wide", 1, 1, 1), ("graph", 2, 0, 1)}


def test_support_fills_the_gaps_that_can_be_filled(spark):
    p = Population()
    p.values |= {("n9", "Name", "Zed")}
    p.members |= {("Name", "n9")}
    p.facts += [("Works", 1, ["p2", "f"])]
    relations = {
        "memberships": spark.createDataFrame(sorted(p.members), "object_type string, instance_id string"),
        "values": spark.createDataFrame(sorted(p.values), "instance_id string, value_type string, literal string"),
        "facts": spark.createDataFrame(p.facts, "fact string, row_index long, players array<string>"),
        "objectifications": spark.createDataFrame(sorted(p.bound), "instance_id string, object_type string, fact string, row_index long"),
    }
    paid = Model("Paid", values=MODEL.values, entities=MODEL.entities, facts=(*MODEL.facts, Fact("Pays", (("job", "Job"), ("level", "Level")))), subtypes=MODEL.subtypes)
    assert {r.gap for r in population.gaps(paid, relations).collect()} == {"standalone_value", "unresolved_objectification"}
    whole = population.supported(paid, relations)
    assert population.gaps(paid, whole).count() == 0
    assert population.violations(paid, whole).count() == population.violations(paid, relations).count() == 0
    owner = [r.players[0] for r in whole["facts"].where("fact = 'Person__name'").collect() if r.players[1] == "n9"]
    assert len(owner) == 1 and owner[0].startswith("support:") and whole["objectifications"].count() == 2
