"""Populations kept as long relations, judged against a model, and samples, judged as open-world examples.

A population is four relations: ``memberships(object_type, instance_id)``, ``values(instance_id, value_type, literal)``,
``facts(fact, row_index, players)`` and ``objectifications(instance_id, object_type, fact, row_index)``.  In them fields are facts
``Owner__field(owner, value)``, and every player is an instance.  What the relations name and the model hasn't, what has the wrong number of players or
no literal, and what is bound to no row is told with a code of its own; the rest goes through the compiled rules.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise.operators import rules
from rolewise.plans import compile as plan
from rolewise.plans.model import Entity, Fact, Model, Rule
from rolewise.sources.tables import fact_columns


def with_field_facts(model: Model) -> Model:
    """The model with each field as a binary fact, unique and, if required or identifying, mandatory for its owner."""
    facts, found = [], []
    for e in model.entities:
        for field, of, required in e.fields:
            name = f"{e.name}__{field}"
            facts.append(Fact(name, (("owner", e.name), ("value", of))))
            found.append(Rule("uniqueness", name, ("owner",)))
            if required or field in e.identity:
                found.append(Rule("mandatory", name, ("owner",)))
    bare = tuple(Entity(e.name) for e in model.entities)
    return replace(model, entities=bare, facts=(*model.facts, *facts), rules=(*model.rules, *found), _by_name={})


def _told(rows: DataFrame, obligation: Column, code: str | Column, subject: Column, key: Column, n: Column | None = None) -> DataFrame:
    code = code if isinstance(code, Column) else F.lit(code)
    count = F.lit(1) if n is None else n
    return rows.select(obligation.alias("obligation_id"), code.alias("code"), subject.alias("subject"), F.array(key.cast("string")).alias("key"), count.cast("bigint").alias("n"))


def _named(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def violations(model: Model, population: dict[str, DataFrame]) -> DataFrame:
    """``obligation_id, code, subject, key, n`` of everything in a population that breaks the model; see the module for its relations.

    An occurrence that several instances are bound to is told for all but the least of them.
    """
    whole = with_field_facts(model)
    members = population["memberships"].select("object_type", "instance_id").distinct()
    values, facts = population["values"], population["facts"]
    spark = members.sparkSession
    col, each = F.col, []
    kinds = [(e.name, "entity", None) for e in model.entities] + [(v.name, "value", None) for v in model.values] + [(f.objectified, "objectified", f.name) for f in model.facts if f.objectified]
    types = spark.createDataFrame(kinds, "object_type string, kind string, objectifies string")  # a row for each type of the model
    arities = spark.createDataFrame([(f.name, len(f.roles)) for f in whole.facts], "fact string, arity int")

    unknown = rules.unknown_types(members, "object_type", types)
    each.append(_told(unknown, _named("population:membership:", col("object_type")), "UNKNOWN_OBJECT_TYPE", col("object_type"), col("object_type")))
    of_values = members.join(types.where("kind = 'value'").select("object_type"), "object_type")
    instance = _named("population:value:", col("instance_id"))
    literals = values.select("instance_id", "value_type", "literal")
    typed = of_values.join(literals, "instance_id")
    each.append(_told(typed.where("value_type <> object_type").select("instance_id", "object_type").distinct(), instance, "VALUE_TYPE_MISMATCH", col("object_type"), col("instance_id")))
    each.append(_told(of_values.join(literals.where("literal IS NOT NULL").select("instance_id"), "instance_id", "left_anti"), instance, "MISSING_VALUE_LITERAL", col("object_type"), col("instance_id")))
    wrong = reduce(lambda a, b: a | b, [(col("object_type") == v.name) & plan.outside(col("literal"), v) for v in model.values if plan.has_domain(v)], F.lit(False))
    each.append(_told(typed.where(wrong).select("object_type", "instance_id").distinct(), _named("value:", col("object_type")), "VALUE_CONSTRAINT_VIOLATION", col("object_type"), col("instance_id")))

    unknown = rules.unknown_types(facts, "fact", arities)
    each.append(_told(unknown, _named("population:fact:", col("fact")), "UNKNOWN_FACT_TYPE", col("fact"), col("fact")))
    each.append(_told(rules.arity(facts, arities), _named("population:fact:", col("fact")), "FACT_ARITY", col("fact"), col("row_index"), col("n")))

    bindings = population["objectifications"]
    binding = _named("population:objectification:", col("instance_id"))
    wrong = rules.objectification_types(bindings, types.select("object_type", "objectifies"), members)
    each.append(_told(wrong, binding, col("code"), F.lit("objectification"), col("instance_id")))
    right = bindings.join(types.where("objectifies IS NOT NULL").select("object_type", col("objectifies").alias("fact")), ["object_type", "fact"])
    each.append(_told(rules.objectification_occurrence(right, facts), binding, "OBJECTIFICATION_OCCURRENCE", col("fact"), col("instance_id")))
    held = right.join(facts.select("fact", "row_index").distinct(), ["fact", "row_index"], "left_semi")
    owner = held.groupBy("fact", "row_index").agg(F.min("instance_id").alias("_owner"))
    shared = held.join(owner, ["fact", "row_index"]).where("instance_id <> _owner").select("instance_id", "fact").distinct()
    each.append(_told(shared, binding, "OBJECTIFICATION_INJECTIVITY", col("fact"), col("instance_id")))

    wide = {f.name: fact_columns(facts, f.name, list(f.role_names)).drop("row_index") for f in whole.facts}
    of_type = {t: members.where(col("object_type") == t).select("instance_id") for t, _, _ in kinds}
    bound = plan.Binding({t: (df, "instance_id", {}) for t, df in of_type.items()}, wide, literal=None)
    each.append(plan.violations(whole, bound))
    for e in model.entities:
        if e.identity:
            parts = [wide[f"{e.name}__{f}"] for f in e.identity]
            shared = rules.identifier(of_type[e.name], "instance_id", parts)
            key = F.array(*[col(c).cast("string") for c in shared.columns[:-1]])
            each.append(shared.select(F.lit(f"identifier:{e.name}").alias("obligation_id"), F.lit("IDENTIFIER_VIOLATION").alias("code"), F.lit(e.name).alias("subject"), key.alias("key"), "n"))
    return reduce(lambda a, b: a.unionByName(b), each)


def sample_violations(model: Model, samples: DataFrame) -> DataFrame:
    """``code, element, key, n``: what is wrong with sample facts ``samples(fact, row_index, players)``, whose players are literals.

    Samples are examples, so nothing must take part in them: mandatory roles, symmetry, identifiers and subtypes aren't asked for.
    The players of an unordered group are put in order first.  Frequencies count rows, repeated ones too, and each row that differs
    from the first of its key breaks a uniqueness.
    """
    spark, col = samples.sparkSession, F.col
    arities = spark.createDataFrame([(f.name, len(f.roles)) for f in model.facts], "fact string, arity int")
    domains = {v.name: v for v in model.values}

    def told(rows: DataFrame, code: str, element: str | Column, key: list[str], n: Column | None = None) -> DataFrame:
        count = F.lit(1) if n is None else n
        return rows.select(F.lit(code).alias("code"), (element if isinstance(element, Column) else F.lit(element)).alias("element"), F.array(*[col(k).cast("string") for k in key]).alias("key"), count.cast("bigint").alias("n"))

    each = [
        told(rules.unknown_types(samples, "fact", arities), "SAMPLE_UNKNOWN_FACT", col("fact"), ["fact"]),
        told(rules.arity(samples, arities), "SAMPLE_ARITY", col("fact"), ["row_index"], col("n")),
    ]
    wide = {}
    for f in model.facts:
        roles, rows = list(f.role_names), fact_columns(samples, f.name, list(f.role_names))
        for role, player in f.roles:
            if player in domains and plan.has_domain(domains[player]):
                each.append(told(rows.where(plan.outside(col(role), domains[player])), "VALUE_CONSTRAINT_VIOLATION", f"{f.name}.{role}", ["row_index", role]))
        for r in model.rules:
            if r.fact == f.name and r.kind == "unordered":
                rows = rules.unordered_canonical(rows, r.roles)
        wide[f.name] = rows
        each.append(told(rows.groupBy(*roles).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "DUPLICATE_FACT", f.name, roles, col("n")))
        for r in model.rules:
            if r.fact == f.name and r.kind == "uniqueness" and set(r.roles) != set(roles):
                each.append(told(rules.uniqueness_sample(rows, list(r.roles), roles, "row_index"), "UNIQUENESS_VIOLATION", r.id, ["row_index", *r.roles]))
            elif r.fact == f.name and r.kind == "frequency":
                each.append(told(rules.frequency(rows, list(r.roles), roles, r.low, r.high, sample=True), "FREQUENCY_VIOLATION", r.id, list(r.roles), col("n")))
    for r in model.rules:
        if r.kind in ("subset", "equality", "exclusion"):
            found = getattr(rules, r.kind)(wide[r.fact], r.roles, wide[r.other], r.other_roles)
            each.append(told(found, f"{r.kind.upper()}_VIOLATION", r.id, list(r.roles)))
    return reduce(lambda a, b: a.unionByName(b), each)


# -- what a population's physical form can't hold ---------------------------------------------------------------------

#: What a gap does to writing a population exactly to a target with one wide row for each owner.
EFFECTS = {"standalone_value": "unsupported", "unresolved_objectification": "unsupported", "invalid_subtype": "representation_prevents_exact_realization", "multivalued_field": "representation_prevents_exact_realization"}


def gaps(model: Model, population: dict[str, DataFrame]) -> DataFrame:
    """``gap, element, instance``: what keeps a population from being written as wide rows.

    A value that no fact uses, an occurrence or instance of an objectified fact without a binding where one is needed, a member of a subtype that its
    supertype lacks, and a field with several values for one owner.
    """
    col, each = F.col, []
    facts, members = population["facts"], population["memberships"].select("object_type", "instance_id").distinct()
    spark = facts.sparkSession

    def told(rows: DataFrame, gap: str, element: Column, instance: Column) -> DataFrame:
        return rows.select(F.lit(gap).alias("gap"), element.cast("string").alias("element"), instance.cast("string").alias("instance"))

    used = facts.select(F.explode("players").alias("instance_id")).distinct()
    each.append(told(population["values"].select("instance_id", "value_type").distinct().join(used, "instance_id", "left_anti"), "standalone_value", col("value_type"), col("instance_id")))
    bound = population["objectifications"]
    kinds = [(f.objectified, f.name, any(p == f.objectified for g in model.facts for _, p in g.roles)) for f in model.facts if f.objectified]
    types = spark.createDataFrame(kinds, "object_type string, fact string, plays boolean")  # a row for each objectified fact
    rows = facts.select("fact", "row_index").distinct()
    needed = rows.join(types.where("plays").select("fact"), "fact")
    each.append(told(needed.join(bound.select("fact", "row_index"), ["fact", "row_index"], "left_anti"), "unresolved_objectification", col("fact"), col("row_index")))
    right = bound.join(types.select("object_type", "fact"), ["object_type", "fact"]).join(rows, ["fact", "row_index"], "left_semi")
    of_type = members.join(types.select("object_type"), "object_type")
    each.append(told(of_type.join(right.select("object_type", "instance_id"), ["object_type", "instance_id"], "left_anti"), "unresolved_objectification", col("object_type"), col("instance_id")))
    above = spark.createDataFrame(list(model.subtypes), "object_type string, _above string")  # a row for each subtype
    held = members.select(col("object_type").alias("_above"), "instance_id")
    each.append(told(members.join(above, "object_type").join(held, ["_above", "instance_id"], "left_anti"), "invalid_subtype", col("object_type"), col("instance_id")))
    fields = spark.createDataFrame([(f"{e.name}__{f}",) for e in model.entities for f, _, _ in e.fields], "fact string")  # a row for each field
    many = facts.join(fields, "fact").where(F.size("players") == 2).groupBy("fact", F.get("players", F.lit(0)).alias("owner")).agg(F.min(F.get("players", F.lit(1))).alias("least"), F.max(F.get("players", F.lit(1))).alias("most"))
    each.append(told(many.where("least <> most"), "multivalued_field", col("fact"), col("owner")))
    return reduce(lambda a, b: a.unionByName(b), each)


def supported(model: Model, population: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The population with what :func:`gaps` finds missing around it: bindings, and facts for values that none uses.

    An occurrence that needs a binding gets one, to an instance that is named by its hash.  A standalone value plays the first role that its type has, in a
    fact of its own whose other players are new instances.  Judge the result again: what is added may break rules that were kept before.
    """
    col = F.col
    spark = population["facts"].sparkSession
    name = lambda *parts: F.concat(F.lit("support:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))
    found = gaps(model, population)
    objectified = {f.name: f.objectified for f in model.facts if f.objectified}
    types = spark.createDataFrame(list(objectified.items()), "element string, object_type string")  # a row for each objectified fact
    missing = found.where("gap = 'unresolved_objectification'").join(types, "element").select(name("element", "instance").alias("instance_id"), "object_type", col("element").alias("fact"), col("instance").try_cast("bigint").alias("row_index"))
    whole = with_field_facts(model)
    first: dict[str, tuple[Fact, int]] = {}
    for f in whole.facts:
        for k, (_, player) in enumerate(f.roles):
            first.setdefault(player, (f, k))
    members, rows = [population["memberships"], missing.select("object_type", "instance_id")], [population["facts"]]
    for v in model.values:
        if v.name not in first:
            continue
        f, at = first[v.name]
        alone = found.where((col("gap") == "standalone_value") & (col("element") == v.name)).select("instance")
        players = [col("instance") if k == at else name(F.lit(f.name), F.lit(str(k)), "instance") for k in range(len(f.roles))]
        # rows of their own, apart from all that are there
        place = F.conv(F.substring(F.sha2("instance", 256), 1, 15), 16, 10).cast("bigint") + F.lit(1 << 61)
        rows.append(alone.select(F.lit(f.name).alias("fact"), place.alias("row_index"), F.array(*players).alias("players")))
        members += [alone.select(F.lit(p).alias("object_type"), players[k].alias("instance_id")) for k, (_, p) in enumerate(f.roles) if k != at]
    join = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return population | {"memberships": join(members), "facts": join(rows), "objectifications": population["objectifications"].unionByName(missing)}


def lowering(found: DataFrame, cases: DataFrame, effects: dict[str, dict[str, str]]) -> DataFrame:
    """``case, target, status``: whether each of ``cases(case)`` can be written to each target, by the gaps ``found(case, gap)`` in it.

    ``effects`` maps a target to what each gap does there, see :data:`EFFECTS`; a gap that it lacks doesn't matter.  Unsupported goes before a
    representation that prevents, and a case without any that matters is lowered.
    """
    worst = ["unsupported", "representation_prevents_exact_realization"]
    every = [(t, g, worst.index(e)) for t, of in effects.items() for g, e in of.items()]
    spark = found.sparkSession
    known = spark.createDataFrame(every, "target string, gap string, worse int")  # a row for each target and gap
    hit = found.select("case", "gap").distinct().join(known, "gap").groupBy("case", "target").agg(F.min("worse").alias("worse"))
    row = cases.select("case", F.explode(F.array(*[F.lit(t) for t in effects])).alias("target")).join(hit, ["case", "target"], "left")
    return row.select("case", "target", F.when(F.col("worse") == 0, worst[0]).when(F.col("worse") == 1, worst[1]).otherwise("lowered").alias("status"))


def lowering_counts(rows: DataFrame) -> DataFrame:
    """How many cases of :func:`lowering` have each status, a row for each target."""
    names = ["lowered", "representation_prevents_exact_realization", "unsupported"]
    return rows.groupBy("target").agg(*[F.count_if(F.col("status") == n).alias(n) for n in names])
