"""Small models, each with one rule in focus, to see how targets keep it."""

from __future__ import annotations

from rolewise.plans.model import Entity, Fact, Model, Rule, Value

_A, _B = Entity("A"), Entity("B")
_AB = Fact("F", (("a", "A"), ("b", "B")))
_SAME = Fact("F", (("a", "A"), ("b", "A")))
_THREE = Fact("F", (("a", "A"), ("b", "B"), ("c", "B")))
_NAME = Value("Name", "String")


def _model(name: str, *rules: Rule, facts=(_AB,), entities=(_A, _B), values=(), subtypes=()) -> Model:
    return Model(name, entities, values, facts, rules, subtypes)


def _of_field(name: str, value: Value) -> Model:
    return _model(name, facts=(), entities=(Entity("A", (), (("x", value.name, False),)),), values=(value,))


#: Name to (model, the obligations in focus).
CORPUS: dict[str, tuple[Model, list[str]]] = {
    "binary_role_uniqueness": (_model("M", Rule("uniqueness", "F", ("a",))), ["uniqueness:F(a)"]),
    "compound_identifier": (_model("M", facts=(), entities=(Entity("A", ("first", "last"), (("first", "Name", True), ("last", "Name", True))),), values=(_NAME,)), ["identifier:A"]),
    "date_enum": (_of_field("M", Value("Day", "Date", allowed=("2024-01-01", "2024-07-01"))), ["value:A.x"]),
    "decimal_range": (_of_field("M", Value("Price", "Decimal", 0, 100)), ["value:A.x"]),
    "frequency_max_one": (_model("M", Rule("frequency", "F", ("a",), low=0, high=1)), ["frequency:F(a):0..1"]),
    "frequency_max_two": (_model("M", Rule("frequency", "F", ("a",), low=0, high=2)), ["frequency:F(a):0..2"]),
    "frequency_min_one_max_two": (_model("M", Rule("frequency", "F", ("a",), low=1, high=2)), ["frequency:F(a):1..2"]),
    "nary_partial_uniqueness": (_model("M", Rule("uniqueness", "F", ("a", "b")), facts=(_THREE,)), ["uniqueness:F(a,b)"]),
    "nary_set_semantics": (_model("M", facts=(_THREE,)), ["set:F"]),
    "objectification": (_model("M", facts=(Fact("F", _AB.roles, "Record"), Fact("Pay", (("of", "Record"), ("amount", "Amount")))), values=(Value("Amount", "Decimal", 0, 1000),)), ["value:Pay.amount"]),
    "set_constraints": (
        _model("M", *[Rule(k, "G", ("x",), o, ("x",)) for k, o in (("subset", "H"), ("equality", "I"), ("exclusion", "J"))], facts=tuple(Fact(n, (("x", "A"),)) for n in "GHIJ"), entities=(_A,)),
        ["subset:G(x):H(x)", "equality:G(x):I(x)", "exclusion:G(x):J(x)"],
    ),
    "simple_identifier": (_model("M", facts=(), entities=(Entity("A", ("name",), (("name", "Name", True),)),), values=(_NAME,)), ["identifier:A"]),
    "subtype": (_model("M", facts=(), subtypes=(("B", "A"),)), ["subtype:B<A"]),
    "symmetry": (_model("M", Rule("symmetric", "F"), facts=(_SAME,)), ["symmetric:F()"]),
    "total_participation": (_model("M", Rule("mandatory", "F", ("a",))), ["mandatory:F(a)"]),
    "unary_fact_set": (_model("M", facts=(Fact("F", (("a", "A"),)),)), ["set:F"]),
    "unordered_roles": (_model("M", Rule("unordered", "F", ("a", "b")), facts=(_SAME,)), ["unordered:F(a,b)"]),
    "value_enum": (_of_field("M", Value("Color", "String", allowed=("red", "green"))), ["value:A.x"]),
    "value_range": (_of_field("M", Value("Age", "Int", 0, 130)), ["value:A.x"]),
    "value_role_range": (_model("M", facts=(Fact("F", (("a", "A"), ("age", "Age"))),), values=(Value("Age", "Int", 0, 130),)), ["value:F.age"]),
}
