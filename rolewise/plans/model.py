"""Declared models: object types, facts and rules, as plain values that are checked when a model is made."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime
from decimal import Decimal

from rolewise.functions.scalar import KINDS, NUMERIC, TIMES


#: A role's place in a reading.
PLACE = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


class ModelError(ValueError):
    """A declaration that a model can't have."""


@dataclass(frozen=True)
class Entity:
    name: str
    identity: tuple[str, ...] = ()  # fields that identify it
    fields: tuple[tuple[str, str, bool], ...] = ()  # (field, value type, required)


@dataclass(frozen=True)
class Value:
    name: str
    kind: str
    low: object = None
    high: object = None
    allowed: tuple = ()


@dataclass(frozen=True)
class Fact:
    name: str
    roles: tuple[tuple[str, str], ...]  # (role, player)
    objectified: str | None = None

    @property
    def role_names(self) -> tuple[str, ...]:
        return tuple(r for r, _ in self.roles)


@dataclass(frozen=True)
class Rule:
    """A rule over roles of a fact; ``other`` and ``other_roles`` for those that compare it with another."""

    kind: str
    fact: str = ""
    roles: tuple[str, ...] = ()
    other: str = ""
    other_roles: tuple[str, ...] = ()
    low: int = 0
    high: int | None = None

    @property
    def id(self) -> str:
        right = f":{self.other}({','.join(self.other_roles)})" if self.other else ""
        bounds = f":{self.low}..{'' if self.high is None else self.high}" if self.kind == "frequency" else ""
        return f"{self.kind}:{self.fact}({','.join(self.roles)}){right}{bounds}"


LOCAL = {"uniqueness", "mandatory", "frequency", "unordered", "symmetric"}
SETS = {"subset", "equality", "exclusion"}


@dataclass(frozen=True)
class Model:
    name: str
    entities: tuple[Entity, ...] = ()
    values: tuple[Value, ...] = ()
    facts: tuple[Fact, ...] = ()
    rules: tuple[Rule, ...] = ()
    subtypes: tuple[tuple[str, str], ...] = ()  # (subtype, supertype)
    readings: tuple[tuple[str, str], ...] = ()  # (fact, text with its roles in braces)
    samples: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (fact, literals)
    analyses: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (name, arguments)
    _by_name: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        for thing in (*self.entities, *self.values, *self.facts):
            if thing.name in self._by_name:
                raise ModelError(f"{thing.name} is declared twice")
            self._by_name[thing.name] = thing
        for fact in self.facts:
            if fact.objectified:
                if fact.objectified in self._by_name:
                    raise ModelError(f"{fact.objectified} is declared twice")
                self._by_name[fact.objectified] = fact
        for v in self.values:
            self._check_value(v)
        for e in self.entities:
            names = [f for f, _, _ in e.fields]
            if len(set(names)) < len(names):
                raise ModelError(f"{e.name} has a field twice")
            for f, of, _ in e.fields:
                if not isinstance(self._by_name.get(of), Value):
                    raise ModelError(f"field {e.name}.{f} is of no value type")
            if set(e.identity) - set(names):
                raise ModelError(f"{e.name} is identified by a field that it has not")
        for f in self.facts:
            if not f.roles or len(set(f.role_names)) < len(f.roles):
                raise ModelError(f"{f.name} has no role, or one twice")
            for role, player in f.roles:
                if player not in self._by_name:
                    raise ModelError(f"role {f.name}.{role} is played by the unknown type {player}")
        self._check_subtypes()
        for r in self.rules:
            self._check_rule(r)
        if len({r.id for r in self.rules}) < len(self.rules):
            raise ModelError("a rule is declared twice")
        for fact, text in self.readings:
            if set(PLACE.findall(text)) - set(self.fact(fact).role_names):
                raise ModelError(f"a reading of {fact} names an unknown role")
        for fact, literals in self.samples:
            if len(literals) != len(self.fact(fact).roles):
                raise ModelError(f"a sample of {fact} has the wrong number of literals")

    def fact(self, name: str) -> Fact:
        found = self._by_name.get(name)
        if not isinstance(found, Fact):
            raise ModelError(f"there is no fact {name}")
        return found

    def player(self, fact: str, role: str) -> str:
        return dict(self.fact(fact).roles)[role]

    def above(self, name: str) -> list[str]:
        """The type itself and its supertypes, nearest first."""
        up, out = dict(self.subtypes), [name]
        while out[-1] in up:
            out.append(up[out[-1]])
        return out

    def identifier(self, entity: str) -> tuple[str, ...]:
        """The identifying fields of an entity, or of the nearest supertype that has some."""
        return next((i for t in self.above(entity) if (i := self._by_name[t].identity)), ())

    @staticmethod
    def _check_value(v: Value) -> None:
        if v.kind not in KINDS:
            raise ModelError(f"{v.name} is of the unknown kind {v.kind}")
        if (v.low is None) != (v.high is None):
            raise ModelError(f"the range of {v.name} lacks a bound")
        if v.low is not None:
            if v.kind not in NUMERIC | TIMES:
                raise ModelError(f"the range of {v.name} is not of numbers or times")
            try:
                low, high = (datetime.fromisoformat(x) if v.kind in TIMES else x for x in (v.low, v.high))
                empty = low > high
            except (TypeError, ValueError) as wrong:
                raise ModelError(f"the range of {v.name} has bounds of another kind") from wrong
            if empty:
                raise ModelError(f"the range of {v.name} is empty")
        if len(set(v.allowed)) < len(v.allowed):
            raise ModelError(f"{v.name} allows a value twice")
        kinds = {"Int": int, "Decimal": (int, float, Decimal), "Float": (int, float), "Bool": bool}
        wanted = kinds.get(v.kind, str)
        if any(not isinstance(a, wanted) or (isinstance(a, bool) and v.kind != "Bool") for a in v.allowed):
            raise ModelError(f"{v.name} allows a value of another kind")

    def _check_subtypes(self) -> None:
        subs = [s for s, _ in self.subtypes]
        if len(set(subs)) < len(subs):
            raise ModelError("a type has two supertypes")
        up = dict(self.subtypes)
        for sub, sup in self.subtypes:
            for t in (sub, sup):
                if not isinstance(self._by_name.get(t), Entity):
                    raise ModelError(f"{t} is no entity, so it has no place in a subtype")
            if self._by_name[sub].identity:
                raise ModelError(f"the subtype {sub} has an identifier of its own")
            seen, at = {sub}, sup
            while at is not None:
                if at in seen:
                    raise ModelError(f"{sub} is above itself")
                seen.add(at)
                at = up.get(at)

    def _check_rule(self, r: Rule) -> None:
        if r.kind not in LOCAL | SETS:
            raise ModelError(f"there is no rule {r.kind}")
        fact = self.fact(r.fact)
        roles = fact.role_names if r.kind == "symmetric" else r.roles
        if not roles or set(roles) - set(fact.role_names) or len(set(roles)) < len(roles):
            raise ModelError(f"{r.id} names no role, an unknown one or one twice")
        players = [self.player(r.fact, x) for x in roles]
        if r.kind == "mandatory" and len(roles) != 1:
            raise ModelError(f"{r.id} takes one role")
        if r.kind == "frequency" and (r.low < 0 or (r.high is not None and (r.high < 1 or r.high < r.low))):
            raise ModelError(f"{r.id} has bounds that nothing meets")
        if r.kind == "unordered" and (len(roles) < 2 or len(set(players)) > 1):
            raise ModelError(f"{r.id} takes two roles or more of one type")
        if r.kind == "symmetric" and (len(fact.roles) != 2 or len(set(players)) > 1):
            raise ModelError(f"{r.id} takes a fact of two roles of one type")
        if r.kind in SETS:
            other = self.fact(r.other)
            if len(r.other_roles) != len(roles) or set(r.other_roles) - set(other.role_names):
                raise ModelError(f"{r.id} compares unlike sequences of roles")
            for a, b in zip(players, (self.player(r.other, x) for x in r.other_roles), strict=True):
                fits = a == b or (r.kind != "equality" and b in self.above(a)) or (r.kind == "exclusion" and a in self.above(b))
                if not fits:
                    raise ModelError(f"{r.id} compares {a} with {b}")


def with_records(model: Model, fields: dict[str, tuple[tuple[str, str, bool], ...]]) -> Model:
    """The model with fields (name, value type, required) of facts: each such fact is objectified, as ``<Fact>Record`` if it has no name yet, and each

    field is a fact ``<Record>__<field>(owner, value)``, unique and, if required, mandatory for its owner.
    """
    objectified = {f.name: f.objectified or f"{f.name}Record" for f in model.facts if f.name in fields}
    if missing := set(fields) - set(objectified):
        raise ModelError(f"there is no fact {sorted(missing)[0]}")
    facts = [replace(f, objectified=objectified.get(f.name, f.objectified)) for f in model.facts]
    rules = list(model.rules)
    for fact, parts in fields.items():
        for name, of, required in parts:
            own = f"{objectified[fact]}__{name}"
            facts.append(Fact(own, (("owner", objectified[fact]), ("value", of))))
            rules += [Rule("uniqueness", own, ("owner",)), *[Rule("mandatory", own, ("owner",))] * required]
    return replace(model, facts=tuple(facts), rules=tuple(rules), _by_name={})


def manifest(model: Model) -> dict:
    """A model as plain values for JSON, with its parts in their order."""
    out = asdict(model)
    del out["_by_name"]
    return out


def from_manifest(data: dict) -> Model:
    """The model that :func:`manifest` gave, also after JSON; ill-formed ones are refused as when they are declared."""

    def tuples(x):
        return tuple(map(tuples, x)) if isinstance(x, list | tuple) else x

    made = {"entities": Entity, "values": Value, "facts": Fact, "rules": Rule}
    parts = {k: tuple(made[k](**{n: tuples(x) for n, x in one.items()}) for one in data.get(k, ())) for k in made}
    return Model(data["name"], **parts, **{k: tuples(data.get(k, ())) for k in ("subtypes", "readings", "samples", "analyses")})


def fingerprint(model: Model) -> str:
    """SHA-256 of the model's meaning: its manifest without samples, with keys in order."""
    meaning = {k: v for k, v in manifest(model).items() if k != "samples"}
    return hashlib.sha256(json.dumps(meaning, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
