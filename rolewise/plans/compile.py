"""From a model and the tables bound to it to one DataFrame of violations.

Rules are fused where that saves a pass: all value domains and required fields of a table are read in one scan; rules on the same
key of a fact share one aggregation, and all rules of a fact its distinct tuples; a uniqueness over all roles of a fact is its set semantics and has no plan of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolewise.functions import scalar
from rolewise.operators import rules
from rolewise.plans.model import Fact, Model, Rule, Value


@dataclass
class Binding:
    """Where a model's population is: ``entities`` name to (table, key column, {field: column}), ``facts`` name to a DataFrame of its roles.

    ``projections`` name to (another bound fact, {role: its role}): facts that are projections of that one's, taken from its
    distinct tuples, so that a table is read and shuffled once for all of them.  ``literal`` gives the literal that a value-typed role's
    column holds; without it such roles are played by instances, whose literals are elsewhere.  ``records`` name what facts are objectified as to (table
    of the instances, key column, {role of the fact: column}).
    """

    entities: dict[str, tuple[DataFrame, str, dict[str, str]]] = field(default_factory=dict)
    facts: dict[str, DataFrame] = field(default_factory=dict)
    projections: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)
    literal: Callable[[Column], Column] | None = lambda value: value
    records: dict[str, tuple[DataFrame, str, dict[str, str]]] = field(default_factory=dict)


def binding_problems(model: Model, bound: Binding) -> list[tuple[str, str]]:
    """(element, problem) of everything that a binding names and the model or the tables lack, and what of the model it leaves unbound."""
    out, entities, facts = [], {e.name: e for e in model.entities}, {f.name: f for f in model.facts}
    for name, (table, key, columns) in bound.entities.items():
        if name not in entities:
            out.append((name, "no such entity"))
            continue
        fields = {f: of for f, of, _ in entities[name].fields}
        out += [(name, f"the table has no key column {key}")] * (key not in table.columns)
        out += [(f"{name}.{f}", "no such field") for f in columns if f not in fields]
        out += [(f"{name}.{f}", f"the table has no column {c}") for f, c in columns.items() if c not in table.columns]
        out += [(f"{name}.{f}", "not bound") for f in fields if f not in columns]
    for name, table in bound.facts.items():
        if name not in facts:
            out.append((name, "no such fact"))
        else:
            out += [(f"{name}.{r}", "the table has no such column") for r in facts[name].role_names if r not in table.columns]
    for name, (base, roles) in bound.projections.items():
        if name not in facts or base not in bound.facts:
            out.append((name, f"no projection of {base}"))
        else:
            out += [(f"{name}.{r}", "not bound") for r in facts[name].role_names if r not in roles]
            out += [(f"{name}.{r}", f"{base} has no role {c}") for r, c in roles.items() if c not in facts[base].role_names]
    objectified = {f.objectified: f for f in model.facts if f.objectified}
    for name, (table, key, roles) in bound.records.items():
        if name not in objectified:
            out.append((name, "no fact is objectified so"))
            continue
        out += [(name, f"the table has no key column {key}")] * (key not in table.columns)
        out += [(f"{name}.{r}", "not bound") for r in objectified[name].role_names if r not in roles]
        out += [(f"{name}.{r}", f"the table has no column {c}") for r, c in roles.items() if c not in table.columns]
    out += [(name, "bound twice") for name in set(bound.facts) & set(bound.projections)]
    out += [(e, "not bound") for e in entities if e not in bound.entities]
    return sorted(out + [(f, "not bound") for f in facts if f not in bound.facts and f not in bound.projections])


#: What a plan decides, and its rows, which have these columns.
Plan = tuple[list[str], DataFrame]
COLUMNS = ["obligation_id", "code", "subject", "key", "n"]


def _rows(df: DataFrame, obligation: str | Column, code: str | Column, subject: str | Column, key: list[str], n: str | None = None) -> DataFrame:
    name = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        name(obligation).alias("obligation_id"), name(code).alias("code"), name(subject).alias("subject"),
        F.array(*[F.col(k).cast("string") for k in key]).alias("key"),
        (F.col(n) if n else F.lit(1)).cast("bigint").alias("n"),
    )


def _found(bad: Column, obligation: str, code: str) -> Column:
    return F.when(bad, F.struct(F.lit(obligation).alias("o"), F.lit(code).alias("c")))


def _each(found: list[Column]) -> Column:
    return F.explode(F.array_compact(F.array(*found)))


def has_domain(v: Value) -> bool:
    return v.low is not None or bool(v.allowed)


def outside(value: Column, v: Value) -> Column:
    """Whether a literal that is there is none of the value type's domain."""
    tests = ([scalar.in_range(value, v.low, v.high, v.kind)] if v.low is not None else []) + ([scalar.one_of(value, v.allowed, v.kind)] if v.allowed else [])
    return value.isNotNull() & ~reduce(lambda a, b: a & b, tests)


def obligations(model: Model) -> list[tuple[str, str]]:
    """(obligation, kind): one for the set semantics of every fact, and one for every rule, domain, field, identifier and subtype."""
    domains = {v.name: v for v in model.values}
    out = [(f"set:{f.name}", "fact_set_semantics") for f in model.facts]
    out += [(f"player:{f.name}.{r}", "role_player") for f in model.facts for r, p in f.roles]
    out += [(f"value:{f.name}.{r}", "value") for f in model.facts for r, p in f.roles if p in domains and has_domain(domains[p])]
    out += [(r.id, r.kind) for r in model.rules]
    for e in model.entities:
        out += [(f"value:{e.name}.{f}", "value") for f, of, _ in e.fields if has_domain(domains[of])]
        out += [(f"required:{e.name}.{f}", "mandatory_field") for f, _, required in e.fields if required]
        if e.identity:
            out.append((f"identifier:{e.name}", "preferred_identifier"))
    out += [(f"subtype:{a}<{b}", "subtype") for a, b in model.subtypes]
    return out


def _entity_plans(model: Model, bound: Binding) -> list[Plan]:
    plans: list[Plan] = []
    domains = {v.name: v for v in model.values}
    for e in model.entities:
        if e.name not in bound.entities:
            continue
        table, key, columns = bound.entities[e.name]
        wrong, ids = [], []  # every row-local rule of the table, in one scan
        for name, of, required in e.fields:
            if name not in columns:
                continue
            col, v = F.col(columns[name]), domains[of]
            if required:
                ids.append(f"required:{e.name}.{name}")
                wrong.append(_found(col.isNull(), ids[-1], "MANDATORY_VIOLATION"))
            if has_domain(v):
                ids.append(f"value:{e.name}.{name}")
                wrong.append(_found(outside(col, v), ids[-1], "VALUE_CONSTRAINT_VIOLATION"))
        if wrong:
            found = table.select(F.col(key).alias("_key"), _each(wrong).alias("w"))
            plans.append((ids, _rows(found, F.col("w.o"), F.col("w.c"), e.name, ["_key"])))
        if e.identity and set(e.identity) <= set(columns):
            parts = [columns[i] for i in e.identity]
            plans.append(([f"identifier:{e.name}"], _rows(rules.identifier_columns(table, key, parts), f"identifier:{e.name}", "IDENTIFIER_VIOLATION", e.name, parts, "n")))
    for sub, sup in model.subtypes:
        if sub in bound.entities and sup in bound.entities:
            (a, k, _), (b, j, _) = bound.entities[sub], bound.entities[sup]
            plans.append(([f"subtype:{sub}<{sup}"], _rows(rules.subtype(a, k, b, j), f"subtype:{sub}<{sup}", "SUBTYPE_VIOLATION", sub, [k])))
    return plans


def _tuples(model: Model, bound: Binding) -> dict[str, DataFrame]:
    """For each bound fact its distinct tuples, and ``times``, how often each is stated.  A row with a null states no fact."""
    out = {}
    for name, rows in bound.facts.items():
        roles = model.fact(name).role_names
        out[name] = rows.select(*roles).dropna().groupBy(*roles).agg(F.count(F.lit(1)).alias("times"))
    for name, (base, roles) in bound.projections.items():
        if set(roles) != set(model.fact(name).role_names) or base not in bound.facts or set(roles.values()) - set(model.fact(base).role_names):
            raise ValueError(f"{name} is no projection of {base}")
        shown = out[base].where("times > 0").select(*[F.col(roles[r]).alias(r) for r in model.fact(name).role_names], "times")
        out[name] = shown.groupBy(*model.fact(name).role_names).agg(F.sum("times").alias("times"))
    return out


def _fact_plans(model: Model, bound: Binding) -> list[Plan]:
    plans: list[Plan] = []
    tuples, domains = _tuples(model, bound), {v.name: v for v in model.values}
    # always true, but it keeps the count in every plan below, so that they are one plan and Spark runs its scan and shuffle once
    stated = {name: counted.where("times > 0") for name, counted in tuples.items()}
    players: dict[str, list[tuple[str, str, list[tuple[str, str]]]]] = defaultdict(list)
    same_players = _same_players(model, bound)
    for fact in model.facts:
        if fact.name not in tuples:
            continue
        rows, roles = stated[fact.name], list(fact.role_names)
        plans.append(([f"set:{fact.name}"], _rows(tuples[fact.name].where("times > 1"), f"set:{fact.name}", "DUPLICATE_FACT", fact.name, roles, "times")))
        by_key: dict[tuple[str, ...], list[Rule]] = defaultdict(list)
        for r in model.rules:
            if r.fact == fact.name and r.kind in ("uniqueness", "frequency"):
                by_key[r.roles].append(r)
        for key, same in by_key.items():
            whole = set(key) == set(roles)  # each tuple is there once, so no plan is needed to know it
            n = rows.select(*key, F.lit(1).cast("bigint").alias("n")) if whole else rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            wrong = []
            for r in same:
                if r.kind == "uniqueness":
                    wrong.append(_found(F.lit(False) if whole else F.col("n") > 1, r.id, "UNIQUENESS_VIOLATION"))
                else:
                    wrong.append(_found((F.col("n") < r.low) | (F.lit(False) if r.high is None else F.col("n") > r.high), r.id, "FREQUENCY_VIOLATION"))
            found = n.select(*key, "n", _each(wrong).alias("w"))
            plans.append(([r.id for r in same], _rows(found, F.col("w.o"), F.col("w.c"), fact.name, list(key), "n")))
        wrong, ids = [], []  # the literals of all value-typed roles, in one pass
        for role, player in fact.roles:
            obligation = f"player:{fact.name}.{role}"
            if player in bound.entities:
                if (fact.name, role) not in same_players:
                    like = [k for k, base in same_players.items() if base == (fact.name, role)]
                    players[player].append((fact.name, role, [(obligation, fact.name), *[(f"player:{f}.{r}", f) for f, r in like]]))
            elif player in domains and bound.literal:
                v, literal = domains[player], bound.literal(F.col(role))
                checks = [(obligation, "ROLE_PLAYER_MEMBERSHIP", scalar.typed(literal, v.kind).isNull())]
                if has_domain(v):
                    checks.append((f"value:{fact.name}.{role}", "VALUE_CONSTRAINT_VIOLATION", outside(literal, v)))
                for o, code, bad in checks:
                    ids.append(o)
                    wrong.append(F.when(bad, F.struct(F.lit(o).alias("o"), F.lit(code).alias("c"), F.col(role).cast("string").alias("v"))))
        if wrong:
            found = rows.select(_each(wrong).alias("w")).groupBy("w.o", "w.c", "w.v").agg(F.count(F.lit(1)).alias("n"))
            plans.append((ids, _rows(found, F.col("o"), F.col("c"), fact.name, ["v"], "n")))
        plans += _ring_plans(model, fact, rows)
    plans += _set_plans(model, stated) + _record_plans(model, bound, stated)
    for player, parts in players.items():
        while parts:  # as many roles at a time as a mask has bits
            n, held = 0, 0
            while n < len(parts) and (not n or held + len(parts[n][2]) <= MASK):
                held += len(parts[n][2])
                n += 1
            plans.append(_player_plan(model, player, bound.entities[player], parts[:n], stated))
            parts = parts[n:]
    return plans


#: Roles whose players meet their members in one join.
MASK = 60


def _same_players(model: Model, bound: Binding) -> dict[tuple[str, str], tuple[str, str]]:
    """(fact, role) of projections to the (fact, role) whose players are theirs, too."""
    out = {}
    for name, (base, roles) in bound.projections.items():
        out |= {(name, r): (base, roles[r]) for r, p in model.fact(name).roles if model.player(base, roles[r]) == p}
    return out


def _ring_plans(model: Model, fact: Fact, rows: DataFrame) -> list[Plan]:
    """Symmetry and unordered groups.  For a fact of two roles both are one aggregation over its pairs, whichever way they are stated."""
    plans, roles = [], list(fact.role_names)
    found = {r.kind: r for r in model.rules if r.fact == fact.name and (r.kind == "symmetric" or (r.kind == "unordered" and set(r.roles) == set(roles) and len(roles) == 2))}
    if found:
        a, b = map(F.col, roles)
        low, high = F.least(a, b).alias("_low"), F.greatest(a, b).alias("_high")
        pairs = rows.groupBy(low, high).agg(F.max(a == F.least(a, b)).alias("_forth"), F.max(b == F.least(a, b)).alias("_back"))
        one, two = F.col("_low").cast("string"), F.col("_high").cast("string")
        wrong, both = [], F.col("_forth") & F.col("_back")
        if r := found.get("symmetric"):
            way = F.when(F.col("_forth"), F.array(one, two)).otherwise(F.array(two, one))
            wrong.append(F.when(~both, F.struct(F.lit(r.id).alias("o"), F.lit("SYMMETRY_VIOLATION").alias("c"), way.alias("key"), F.lit(1).alias("n"))))
        if r := found.get("unordered"):
            wrong.append(F.when(both & (F.col("_low") != F.col("_high")), F.struct(F.lit(r.id).alias("o"), F.lit("UNORDERED_DUPLICATE").alias("c"), F.array(one, two).alias("key"), F.lit(2).alias("n"))))
        told = pairs.select(_each(wrong).alias("w")).select("w.o", "w.c", F.lit(fact.name), "w.key", F.col("w.n").cast("bigint"))
        plans.append(([r.id for r in found.values()], told.toDF(*COLUMNS)))
    for r in model.rules:
        if r.fact == fact.name and r.kind == "unordered" and "unordered" not in found:
            shown = rules.unordered(rows, r.roles, roles)
            shown = shown.withColumns({x: F.col("players")[k] for k, x in enumerate(r.roles)})
            plans.append(([r.id], _rows(shown, r.id, "UNORDERED_DUPLICATE", fact.name, list(r.roles), "n")))
    return plans


def _record_plans(model: Model, bound: Binding, stated: dict[str, DataFrame]) -> list[Plan]:
    """What facts are objectified as: every instance stands for one tuple that the fact holds of, and no two for the same.

    The instances of a record are aggregated by tuple and by key, each before its shuffle, and meet the fact's distinct tuples in one join.  An instance that is bound to several tuples is told once,
    and of several that are bound to one all but the least.  What has a null is bound to no tuple.
    """
    plans: list[Plan] = []
    for fact in model.facts:
        if fact.objectified not in bound.records or fact.name not in stated:
            continue
        table, key, columns = bound.records[fact.objectified]
        roles = list(fact.role_names)
        rows = table.select(F.col(key).alias("_id"), *[F.col(columns[r]).alias(r) for r in roles]).where("_id IS NOT NULL").distinct()
        held = stated[fact.name].select(*[F.col(r).alias(f"_{r}") for r in roles], F.lit(True).alias("_held"))
        known = rows.join(held, reduce(lambda a, b: a & b, [F.col(r) == F.col(f"_{r}") for r in roles]), "left").select("_id", *roles, F.coalesce("_held", F.lit(False)).alias("_held"))
        by_id = known.groupBy("_id").agg(F.bool_and("_held").alias("_held"), F.count(F.lit(1)).alias("n"))
        name = f"objectification:{fact.objectified}"
        told = by_id.select("_id", _each([_found(~F.col("_held"), name, "OBJECTIFICATION_OCCURRENCE"), _found(F.col("n") > 1, name, "OBJECTIFICATION_FUNCTION")]).alias("w"))
        found = _rows(told, F.col("w.o"), F.col("w.c"), fact.objectified, ["_id"])
        first = known.where("_held").groupBy(*roles).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(r).alias(f"_{r}") for r in roles], "_first")
        shared = known.where("_held").join(first, reduce(lambda a, b: a & b, [F.col(r) == F.col(f"_{r}") for r in roles])).where("_id <> _first").select("_id").distinct()
        plans.append(([name], found.unionByName(_rows(shared, name, "OBJECTIFICATION_INJECTIVITY", fact.objectified, ["_id"]))))
    return plans


def _set_plans(model: Model, stated: dict[str, DataFrame]) -> list[Plan]:
    """Subsets, equalities and exclusions; all rules that compare the same two projections are one join."""
    compared: dict[tuple, list[Rule]] = defaultdict(list)
    for r in model.rules:
        if r.kind in ("subset", "equality", "exclusion") and r.fact in stated and r.other in stated:
            compared[r.fact, r.roles, r.other, r.other_roles].append(r)
    plans = []
    for (fact, roles, other, others), same in compared.items():
        kinds = {r.kind for r in same}
        if len(kinds) == 1 and "equality" not in kinds:
            found = getattr(rules, same[0].kind)(stated[fact], roles, stated[other], others)
            plans.append(([same[0].id], _rows(found, same[0].id, f"{same[0].kind.upper()}_VIOLATION", fact, list(roles))))
            continue
        left = stated[fact].select(*roles).distinct().withColumn("_left", F.lit(True))
        right = stated[other].select(*[F.col(o).alias(r) for r, o in zip(roles, others, strict=True)]).distinct().withColumn("_right", F.lit(True))
        bad = {"subset": F.col("_right").isNull(), "equality": F.col("_right").isNull() | F.col("_left").isNull(), "exclusion": F.col("_left") & F.col("_right")}
        met = left.join(right, list(roles), "full_outer").select(*roles, _each([_found(F.coalesce(bad[r.kind], F.lit(False)), r.id, f"{r.kind.upper()}_VIOLATION") for r in same]).alias("w"))
        plans.append(([r.id for r in same], _rows(met, F.col("w.o"), F.col("w.c"), fact, list(roles))))
    return plans


def _player_plan(model: Model, player: str, entity: tuple[DataFrame, str, dict[str, str]], parts: list[tuple[str, str, list[tuple[str, str]]]], stated: dict[str, DataFrame]) -> Plan:
    """The players of roles of a type and its members meet in one join, each once: strangers, and members that lack a mandatory role.

    ``parts`` are (fact, role, (obligation, fact) of it and of the roles with the same players).  Which roles a player has is a mask of bits, so that
    it is aggregated before the shuffle.
    """
    members, key, _ = entity
    labels = [label for _, _, each in parts for label in each]
    bit = {o: 1 << k for k, (o, _) in enumerate(labels)}
    one = [stated[f].select(F.col(role).alias("_player"), F.lit(sum(bit[o] for o, _ in each)).cast("bigint").alias("_mask")) for f, role, each in parts]
    asked = reduce(lambda a, b: a.unionByName(b), one).groupBy("_player").agg(F.bit_or("_mask").alias("_mask"))
    named = members.select(F.col(key).alias("_member"))
    due = [r for r in model.rules if r.kind == "mandatory" and f"player:{r.fact}.{r.roles[0]}" in bit]
    told = lambda o, c, of: F.struct(F.lit(o).alias("o"), F.lit(c).alias("c"), F.lit(of).alias("of"))
    has = lambda o: F.coalesce(F.col("_mask"), F.lit(0).cast("bigint")).bitwiseAND(F.lit(bit[o]).cast("bigint")) != 0
    strangers = [F.when(F.col("_member").isNull() & has(o), told(o, "ROLE_PLAYER_MEMBERSHIP", of)) for o, of in labels]
    lacking = [F.when(F.col("_member").isNotNull() & ~has(f"player:{r.fact}.{r.roles[0]}"), told(r.id, "MANDATORY_VIOLATION", r.fact)) for r in due]
    on = F.col("_player") == F.col("_member")
    if due:
        met = asked.join(named.where("_member IS NOT NULL").distinct(), on, "full_outer")
    else:
        met = asked.join(named, on, "left_anti").withColumn("_member", F.lit(None).cast(members.schema[key].dataType))
    rows = met.select(F.coalesce("_player", "_member").alias("_key"), _each(strangers + lacking).alias("w"))
    return [o for o, _ in labels] + [r.id for r in due], _rows(rows, F.col("w.o"), F.col("w.c"), F.col("w.of"), ["_key"])


def evaluated(model: Model, bound: Binding) -> tuple[DataFrame, set[str]]:
    """:func:`violations` and :func:`checked` of a model and its tables, planned once."""
    # a record's instances play roles like members do
    players = {name: (table, key, {}) for name, (table, key, _) in bound.records.items()}
    bound = replace(bound, entities={**players, **bound.entities})
    plans = _entity_plans(model, bound) + _fact_plans(model, bound)
    if not plans:
        raise ValueError("nothing of the model is bound to a table")
    return reduce(lambda a, b: a.unionByName(b), [rows for _, rows in plans]), {o for ids, _ in plans for o in ids}


def violations(model: Model, bound: Binding) -> DataFrame:
    """``obligation_id, code, subject, key, n``: every key that violates an obligation of the model, in no order.

    What a model declares and nothing is bound to isn't checked, see :func:`checked`.  Nulls state nothing, so they violate required fields only.
    """
    return evaluated(model, bound)[0]


def checked(model: Model, bound: Binding) -> set[str]:
    """The obligations that :func:`violations` decides for these tables."""
    return evaluated(model, bound)[1]


def first_witness(found: DataFrame) -> DataFrame:
    """The least violating key of each obligation.  Aggregated before the shuffle, so one row for each task travels."""
    return found.groupBy("obligation_id", "code", "subject").agg(F.min(F.struct("key", "n")).alias("w")).select("obligation_id", "code", "subject", "w.key", "w.n")


def witnesses(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` least violating keys of each obligation."""
    order = Window.partitionBy("obligation_id").orderBy("key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def summary(model: Model, found: DataFrame, decided: set[str] | None = None) -> DataFrame:
    """``obligation_id, kind, violations, status`` for every obligation of the model, also those that hold.

    ``decided`` are the obligations that were checked (all if not given); the status of any other is ``not_checked``.
    """
    known = [(o, kind, decided is None or o in decided) for o, kind in obligations(model)]
    known += [(o, "objectification", True) for o in sorted(decided or ()) if o.startswith("objectification:")]
    asked = found.sparkSession.createDataFrame(known, "obligation_id string, kind string, decided boolean")
    counted = found.groupBy("obligation_id").agg(F.count(F.lit(1)).alias("violations"))
    row = asked.join(counted, "obligation_id", "left").fillna(0, ["violations"])
    status = F.when(~F.col("decided"), "not_checked").when(F.col("violations") > 0, "violated").otherwise("holds")
    return row.select("obligation_id", "kind", "violations", status.alias("status"))


def report(found: DataFrame) -> DataFrame:
    """Violations in the order of reports."""
    return found.orderBy("obligation_id", "code", "key")


def isolation(found: DataFrame, instance: Column) -> DataFrame:
    """``instance, rules, status``: whether each instance violates one obligation alone (isolated) or several (collateral)."""
    n = found.groupBy(instance.alias("instance")).agg(F.count_distinct("obligation_id").alias("rules"))
    return n.withColumn("status", F.when(F.col("rules") == 1, "isolated").otherwise("collateral"))


def evidence(found: DataFrame, fact: DataFrame, obligation: str, roles: list[str], most: int = 2) -> DataFrame:
    """For each violating key of an obligation the rows of ``fact`` that show it: at most ``most`` distinct ones.

    Two rows are the least that shows a broken uniqueness, and for an upper frequency bound ``most`` is the bound and one.
    """
    kinds = dict(fact.dtypes)
    bad = found.where(F.col("obligation_id") == obligation).select(*[F.col("key")[k].cast(kinds[r]).alias(f"_{r}") for k, r in enumerate(roles)])
    on = reduce(lambda a, b: a & b, [F.col(r) == F.col(f"_{r}") for r in roles])
    shown = fact.join(bad, on, "left_semi").distinct()
    order = Window.partitionBy(*roles).orderBy(*fact.columns)
    return shown.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")
