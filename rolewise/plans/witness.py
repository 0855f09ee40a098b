"""Witnesses: for every obligation of a model a small population that breaks it, and valid ones that probe its bounds.

What breaks an obligation is a few rows, made from the model alone.  What the other rules then ask for is added by :mod:`rolewise.plans.chase`, however far that leads.
The populations of all obligations are kept apart by their instance ids, as one relation, so one chase completes them and one compiled plan judges all
of them at once, however many obligations a model has.  A witness is *isolated* if it breaks its own obligation alone, and *collateral* if it breaks others too.  If there is none, the
obligation is *not_independently_falsifiable* where it follows from the others (:mod:`rolewise.plans.implied`), and else *unsupported*.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolewise.functions.scalar import TIMES
from rolewise.operators import rules
from rolewise.plans import chase, implied
from rolewise.plans import compile as plan
from rolewise.plans.model import Fact, Model, Rule, Value
from rolewise.sources.tables import discard, durable


def _good(v: Value, unique: str, number: int) -> str:
    """A literal of the value type, different for each ``unique`` and ``number`` where the domain has enough."""
    if v.allowed:
        return str(v.allowed[number % len(v.allowed)])
    if v.kind in TIMES:
        first = datetime.fromisoformat(v.low or "2024-01-01")
        last = datetime.fromisoformat(v.high) if v.high else None
        day = first + timedelta(days=number)
        return (day if last is None or day <= last else first).isoformat(" ")[: 10 if v.kind == "Date" else 26]
    if v.low is not None:
        return str(v.low + number if v.low + number <= v.high else v.low)
    fixed = {"Bool": ("true", "false")[number % 2], "UUID": f"00000000-0000-0000-0000-{number:012}"}
    return unique if v.kind == "String" else fixed.get(v.kind, str(number))


def _bad(v: Value) -> str | None:
    """A literal outside the domain; null if there is none."""
    if v.kind in TIMES and v.low is not None:
        return (datetime.fromisoformat(v.high) + timedelta(days=1)).isoformat(" ")[: 10 if v.kind == "Date" else 26]
    if v.low is not None:
        return str(v.high + 1)
    if v.allowed:
        return str(sum(a for a in v.allowed) + 1) if v.kind in ("Int", "Decimal", "Float") else "".join(map(str, v.allowed)) + "?"
    return None


class _Populations:
    """Collects the rows of disjoint populations, without what the rules ask for beside them."""

    def __init__(self, model: Model):
        self.model = model
        self.values = {v.name: v for v in model.values}
        self.fields = {e.name: e.fields for e in model.entities}
        self.members: dict[str, dict[str, dict[str, str | None]]] = {e.name: {} for e in model.entities}
        self.facts: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        self.at, self.n = "", 0

    def start(self, name: str) -> None:
        self.at, self.n = name, 0

    def new(self, type_: str, above: bool = True) -> str:
        """A new player of a type: a literal, or a member of it and of what is above it."""
        self.n += 1
        name = f"{self.at}|{type_}{self.n}"
        if type_ in self.values:
            return f"{self.at}|{_good(self.values[type_], name, self.n)}"
        for t in self.model.above(type_) if above and type_ in self.members else [type_]:
            if t in self.members:
                self.members[t][name] = {f: _good(self.values[of], name, self.n) for f, of, _ in self.fields[t]}
        return name

    def fact(self, name: str, given: dict[str, str] | None = None) -> tuple[str, ...]:
        given = dict(given or {})
        kinds = {r.kind for r in self.model.rules if r.fact == name}
        if {"symmetric", "unordered"} <= kinds and not given:  # only a pair with itself is both
            given = dict.fromkeys(self.model.fact(name).role_names, self.new(self.model.fact(name).roles[0][1]))
        row = tuple(given.get(r) or self.new(p) for r, p in self.model.fact(name).roles)
        self.facts[name].append(row)
        return row

    def atoms(self, spark: SparkSession) -> DataFrame:
        case = lambda id_: id_.split("|", 1)[0]
        rows = [(case(row[0]), "fact", f, list(row)) for f, each in self.facts.items() for row in each]
        rows += [(case(name), "member", t, [name, *[fields[f] for f, _, _ in self.fields[t]]]) for t, members in self.members.items() for name, fields in members.items()]
        return spark.createDataFrame(rows, chase.ATOMS)


def binding(model: Model, atoms: DataFrame) -> plan.Binding:
    """Atoms bound to the model that they are of; ids and literals of roles begin with their case and a bar."""
    of = lambda kind, name: atoms.where((F.col("kind") == kind) & (F.col("of") == name))
    entities = {}
    for e in model.entities:
        names = [f for f, _, _ in e.fields]
        rows = of("member", e.name).select(F.col("row")[0].alias("_id"), "case", *[F.get("row", F.lit(k + 1)).alias(f) for k, f in enumerate(names)])
        entities[e.name] = (rows, "_id", {f: f for f in names})
    facts = {f.name: of("fact", f.name).select(*[F.get("row", F.lit(k)).alias(r) for k, r in enumerate(f.role_names)]) for f in model.facts}
    return plan.Binding(entities, facts, literal=lambda value: F.regexp_replace(value, r"^\d+\|", ""))


def _break_rule(b: _Populations, r: Rule) -> None:
    fact: Fact = b.model.fact(r.fact)
    if r.kind in ("uniqueness", "frequency"):
        first = dict(zip(fact.role_names, b.fact(r.fact), strict=True))
        n = 2 if r.kind == "uniqueness" else r.high + 1 if r.high is not None else 0
        for _ in range(n - len({x for x in b.facts[r.fact] if all(dict(zip(fact.role_names, x, strict=True))[k] == first[k] for k in r.roles)})):
            b.fact(r.fact, {k: first[k] for k in r.roles})
    elif r.kind == "mandatory":
        b.new(b.model.player(r.fact, r.roles[0]))
    elif r.kind == "symmetric":
        b.facts[r.fact].append(tuple(b.new(p) for _, p in fact.roles))
    elif r.kind == "unordered":
        row = dict(zip(fact.role_names, b.fact(r.fact, {role: b.new(p) for role, p in fact.roles}), strict=True))
        turned = row | dict(zip(r.roles, [row[x] for x in r.roles[::-1]], strict=True))
        if (again := tuple(turned.values())) not in b.facts[r.fact]:
            b.facts[r.fact].append(again)
    elif r.kind in ("subset", "equality"):
        b.facts[r.fact].append(tuple(b.new(p) for _, p in fact.roles))
    elif r.kind == "exclusion":
        row = dict(zip(fact.role_names, b.fact(r.fact), strict=True))
        b.fact(r.other, {o: row[m] for m, o in zip(r.roles, r.other_roles, strict=True)})


def _break(b: _Populations, obligation: str) -> None:
    """Adds the population that is to break the obligation."""
    model = b.model
    kind, _, what = obligation.partition(":")
    rule = next((r for r in model.rules if r.id == obligation), None)
    if rule:
        _break_rule(b, rule)
    elif kind == "set":
        b.facts[what].append(b.fact(what))
    elif kind == "player":
        name, role = what.rsplit(".", 1)
        b.fact(name, {role: f"{b.at}|stranger"})
    elif kind == "value" and what.rsplit(".", 1)[0] not in b.fields:
        name, role = what.rsplit(".", 1)
        b.fact(name, {role: f"{b.at}|{_bad(b.values[model.player(name, role)])}"})
    elif kind in ("value", "required"):
        entity, name = what.rsplit(".", 1)
        of = next(of for f, of, _ in b.fields[entity] if f == name)
        b.members[entity][b.new(entity)][name] = _bad(b.values[of]) if kind == "value" else None
    elif kind == "identifier":
        one, two = b.new(what), b.new(what)
        b.members[what][two] |= {f: b.members[what][one][f] for f, _, _ in b.fields[what]}
    elif kind == "subtype":
        b.new(what.split("<")[0], above=False)


def _case(column: str) -> Column:
    """The case that an instance id of the key belongs to: what stands before its bar."""
    return F.regexp_extract(F.array_join(F.col(column), ","), r"(\d+)\|", 1)


def broken(model: Model, atoms: DataFrame) -> DataFrame:
    """``case, broken``: the obligations that each population breaks.  Identifiers are compared within a case, as their literals may be alike in others."""
    bound = binding(model, atoms)
    plain = replace(model, entities=tuple(replace(e, identity=()) for e in model.entities), subtypes=model.subtypes, _by_name={})
    parts = [plan.violations(plain, bound).select(_case("key").alias("case"), "obligation_id")]
    for e in model.entities:
        if e.identity:
            shared = rules.identifier_columns(bound.entities[e.name][0], "_id", ["case", *e.identity])
            parts.append(shared.select("case", F.lit(f"identifier:{e.name}").alias("obligation_id")))
    return reduce(DataFrame.unionByName, parts).groupBy("case").agg(F.sort_array(F.collect_set("obligation_id")).alias("broken"))


def _follows(model: Model, obligation: str) -> bool:
    """Whether the model's other obligations say what this one does, by counting; any text is a String."""
    rule = next((r for r in model.rules if r.id == obligation), None)
    if rule:
        return implied.counts(model, rule)
    kind, _, what = obligation.partition(":")
    kinds = {v.name: v.kind for v in model.values}
    return kind == "player" and kinds.get(model.player(*what.rsplit(".", 1))) == "String"


def _witnessed(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame]:
    """The atoms of two populations for each obligation, completed by the chase and as they are made, and what is found of them.

    Found are ``obligation_id, status, broken, implied`` and ``case``, the better of the two.
    """
    b, known = _Populations(model), [o for o, _ in plan.obligations(model)]
    for k, obligation in enumerate(known):
        for case in (k, k + len(known)):
            b.start(str(case))
            _break(b, obligation)
    made = durable(b.atoms(spark), "witness-made")
    first = F.col("case").cast("bigint") < len(known)
    spared = spark.createDataFrame([(str(k), o) for k, o in enumerate(known)], "case string, obligation string")
    atoms = durable(chase.chased(model, made.where(first), spared).unionByName(made.where(~first)), "witness-atoms")
    discard(made)
    cases = spark.createDataFrame([(o, str(k + more), more > 0, _follows(model, o)) for k, o in enumerate(known) for more in (0, len(known))], "obligation_id string, case string, bare boolean, follows boolean")
    row = cases.join(broken(model, atoms), "case", "left").withColumn("broken", F.coalesce("broken", F.array().cast("array<string>")))
    own = F.array_contains("broken", F.col("obligation_id"))
    rank = F.when(own & (F.size("broken") == 1), 0).when(own, 1).otherwise(2)
    best = row.groupBy("obligation_id", "follows").agg(F.min(F.struct(rank.alias("rank"), "bare", "case", "broken")).alias("best"), F.bool_and(F.col("bare") | ~own).alias("_met"))
    status = F.when(F.col("best.rank") == 0, "isolated").when(F.col("best.rank") == 1, "collateral").when(F.col("follows"), "not_independently_falsifiable").otherwise("unsupported")
    # what the chase of the other rules meets follows from them, if it adds the least that they ask for
    asked = [o for o, *_ in chase.asks(model)]
    says = F.col("follows") | (F.col("_met") & F.col("obligation_id").isin(asked) & F.lit(not chase.closing(model)))
    return atoms, row.select("obligation_id").distinct().join(best, "obligation_id").select("obligation_id", status.alias("status"), F.col("best.broken").alias("broken"), says.alias("implied"), F.col("best.case").alias("case"))


def counterexamples(spark: SparkSession, model: Model) -> DataFrame:
    """``obligation_id, status, broken, implied``: how each obligation's witness breaks it, all that it breaks, and whether the other obligations imply it."""
    return _witnessed(spark, model)[1].drop("case")


#: Cases of one round of :func:`shrunk` are numbered by their case and the piece that is left out.
PIECES = 1_000_000


def shrunk(spark: SparkSession, model: Model) -> DataFrame:
    """``obligation_id, fact_rows, members, left_out``: the isolated witnesses with nothing in them that can be left out by itself.

    By halves, then by smaller pieces: a round leaves out each piece of each witness in turn, all at once by one plan, and takes the first without which it is still isolated.  If there is none
    the pieces become half as large, until they are single rows of a fact or members of a type.  Candidates are rows that are exploded on Spark, and rounds grow with the logarithm of what can be left
    out.  The end is a local minimum, as of single atoms, and no more is claimed.
    """
    atoms, found = _witnessed(spark, model)
    target = durable(found.where("status = 'isolated'").select("case", "obligation_id"), "shrink-target")
    order = Window.partitionBy("case").orderBy("kind", "of", "row")
    left = durable(atoms.join(target, "case").withColumn("seq", F.row_number().over(order) - 1).drop("obligation_id"), "shrink-atoms")
    pieces = left.groupBy("case").agg(F.count(F.lit(1)).alias("before"))
    state = durable(pieces.select("case", "before", F.least("before", F.lit(2)).alias("n"), (F.col("before") < 1).alias("done")), "shrink-state")
    while not state.where("NOT done").isEmpty():
        sized = left.groupBy("case").agg(F.count(F.lit(1)).alias("size")).join(state.where("NOT done"), "case")
        placed = left.join(sized, "case").withColumn("place", F.row_number().over(Window.partitionBy("case").orderBy("seq")) - 1)
        cut = durable(placed.withColumn("piece", F.expr("place * n div size")).drop("place", "before", "done"), "shrink-cut")
        tried = cut.withColumn("out", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).where("piece <> out")
        number = (F.col("case").cast("bigint") * PIECES + F.col("out")).cast("string")
        own = F.concat("case", F.lit("|"))
        moved = F.transform("row", lambda x: F.when(F.startswith(x, own), F.concat("_case", F.lit("|"), F.substring(x, F.length(own) + 1, F.length(x)))).otherwise(x))
        tried = tried.withColumn("_case", number).select(F.col("_case").alias("case"), "kind", "of", moved.alias("row"))
        judged = broken(model, durable(tried, "shrink-tried")).where("case <> ''")
        still = judged.select((F.col("case").cast("bigint") / PIECES).cast("bigint").cast("string").alias("case"), (F.col("case").cast("bigint") % PIECES).alias("out"), "broken").join(target, "case")
        taken = durable(still.where(F.col("broken") == F.array("obligation_id")).groupBy("case").agg(F.min("out").alias("out")), "shrink-taken")
        gone = cut.join(taken, (cut["case"] == taken["case"]) & (cut["piece"] == taken["out"]), "left_semi").select("case", "seq")
        after = durable(left.join(gone, ["case", "seq"], "left_anti"), "shrink-atoms")
        size = after.groupBy("case").agg(F.count(F.lit(1)).alias("size"))
        next_ = state.join(size, "case", "left").join(taken.select("case", F.lit(True).alias("hit")), "case", "left")
        n = F.when(F.col("hit"), F.greatest(F.col("n") - 1, F.lit(2))).otherwise(F.col("n") * 2)
        changed = next_.select("case", "before", F.when(F.col("done"), F.col("n")).otherwise(F.least(n, F.coalesce("size", F.lit(0)))).alias("n"), (F.col("done") | (F.col("hit").isNull() & (F.col("n") >= F.coalesce("size", F.lit(0)))) | F.col("size").isNull()).alias("done"))
        state_ = durable(changed, "shrink-state")
        discard(left, state, cut, taken)
        left, state = after, state_
    kinds = lambda k: F.count_if(F.col("kind") == k).cast("int")
    done = left.groupBy("case").agg(kinds("fact").alias("fact_rows"), kinds("member").alias("members")).join(state, "case").join(target, "case")
    return done.select("obligation_id", "fact_rows", "members", (F.col("before") - F.col("fact_rows") - F.col("members")).cast("int").alias("left_out"))


def sizes(witnesses: DataFrame) -> DataFrame:
    """The least, mean and greatest size of :func:`shrunk` witnesses, how much was left out of all and of one, and how many there are."""
    columns = [f(c).alias(f"{name}_{c}") for c in ("fact_rows", "members") for name, f in (("least", F.min), ("mean", F.avg), ("most", F.max))]
    return witnesses.agg(F.count(F.lit(1)).alias("witnesses"), *columns, F.sum("left_out").alias("left_out"), F.max("left_out").alias("most_left_out"))


def _value_probes(b: _Populations) -> list[tuple[str, str]]:
    """Populations with a value at each bound of a range and each value of an enumeration."""
    bounds = lambda v: [v.low, v.high] if v.low is not None else list(v.allowed)
    cases = []
    for e in b.model.entities:
        for f, of, _ in e.fields:
            for literal in bounds(b.values[of]):
                _begin(b, cases, f"value:{e.name}.{f}", str(literal))
                b.members[e.name][b.new(e.name)][f] = str(literal)
    for fact in b.model.facts:
        for role, player in fact.roles:
            for literal in bounds(b.values[player]) if player in b.values else []:
                _begin(b, cases, f"value:{fact.name}.{role}", str(literal))
                b.fact(fact.name, {role: f"{b.at}|{literal}"})
    return cases


def _begin(b: _Populations, cases: list[tuple[str, str]], obligation: str, probe: str) -> None:
    b.start(str(len(cases)))
    cases.append((obligation, probe))


def _rule_probes(b: _Populations, cases: list[tuple[str, str]]) -> None:
    """Populations that meet each rule: as little as it allows, and as much where it has an upper bound."""
    model = b.model
    for f in model.facts:
        _begin(b, cases, f"set:{f.name}", "one row")
        b.fact(f.name)
    for r in model.rules:
        fact = model.fact(r.fact)
        names = {"uniqueness": ["two keys"], "frequency": ["least", "most"] if r.high else ["least"], "mandatory": ["a member that takes part"], "symmetric": ["a pair and its reverse"], "unordered": ["one order"],
                 "subset": ["in both"], "equality": ["in both"], "exclusion": ["one in each"]}[r.kind]
        for probe in names:
            _begin(b, cases, r.id, probe)
            if r.kind == "mandatory":
                b.new(model.player(r.fact, r.roles[0]))
                continue
            row = dict(zip(fact.role_names, b.fact(r.fact), strict=True))
            if r.kind == "uniqueness":
                b.fact(r.fact)
            elif probe == "most" and set(r.roles) != set(fact.role_names):
                key = {k: row[k] for k in r.roles}
                while sum(all(dict(zip(fact.role_names, x, strict=True))[k] == v for k, v in key.items()) for x in set(b.facts[r.fact])) < r.high:
                    b.fact(r.fact, key)
            elif r.kind == "exclusion":
                b.fact(r.other)
    for e in model.entities:
        if e.identity:
            _begin(b, cases, f"identifier:{e.name}", "two members")
            b.new(e.name), b.new(e.name)
    for sub, sup in model.subtypes:
        _begin(b, cases, f"subtype:{sub}<{sup}", "in both")
        b.new(sub)


def probes(spark: SparkSession, model: Model) -> DataFrame:
    """``obligation_id, probe, accepted``: small valid populations for every obligation, and whether the rules accept them.

    Values are probed at the bounds of their ranges and at each that an enumeration allows; rules with as little and as much as they allow.  What the other rules
    ask for beside that is added by the chase.
    """
    b = _Populations(model)
    cases = _value_probes(b)
    _rule_probes(b, cases)
    atoms = durable(chase.chased(model, b.atoms(spark)), "probes")
    found = broken(model, atoms).select("case", F.lit(True).alias("refused"))
    named = spark.createDataFrame([(str(k), *c) for k, c in enumerate(cases)], "case string, obligation_id string, probe string")
    return named.join(found, "case", "left").select("obligation_id", "probe", F.col("refused").isNull().alias("accepted"))
