"""Models as data: a model's relations, back from them to the model, and what changed between two of them.

A catalogue has a row for each declared thing, so it is small next to the data; it is joined like any other relation, and
the checks that a change calls for are the compiled rules, run over the bound tables.
"""

from __future__ import annotations

import json
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.functions.scalar import KINDS
from rolewise.operators import evolution
from rolewise.plans import compile as plan
from rolewise.plans.model import Entity, Fact, Model, ModelError, Rule, Value

#: Fixed schema: the relations of a model.
RELATIONS = {
    "model": "name string",
    "readings": "fact string, text string",
    "objects": "name string, kind string, scalar string",
    "domains": "value string, low string, high string, allowed array<string>",
    "fields": "owner string, name string, ordinal int, type string, required boolean, identifying int",
    "facts": "name string, objectified string",
    "roles": "fact string, name string, ordinal int, player string",
    "rules": "kind string, fact string, roles array<string>, other string, other_roles array<string>, low int, high int, ordinal int",
    "subtypes": "sub string, sup string",
    "samples": "fact string, ordinal int, literals array<string>",
    "analyses": "name string, ordinal int, arguments array<string>",
}

#: What determines what in these relations: (relation, key, columns that each key has once).
FUNCTIONAL = [
    ("objects", ["name"], ["kind", "scalar"]), ("domains", ["value"], ["low", "high", "allowed"]), ("fields", ["owner", "name"], ["ordinal", "type", "required", "identifying"]), ("fields", ["owner", "ordinal"], ["name"]),
    ("facts", ["name"], ["objectified"]), ("facts", ["objectified"], ["name"]), ("roles", ["fact", "name"], ["ordinal", "player"]), ("roles", ["fact", "ordinal"], ["name"]), ("rules", ["ordinal"], ["kind", "fact", "roles", "other", "other_roles", "low", "high"]),
    ("subtypes", ["sub"], ["sup"]), ("samples", ["ordinal"], ["fact", "literals"]), ("analyses", ["ordinal"], ["name", "arguments"]),
]


def encode(spark: SparkSession, model: Model) -> dict[str, DataFrame]:
    """The relations of a model, as :data:`RELATIONS` has them."""
    show = lambda x: None if x is None else str(x)
    rows = {
        "model": [(model.name,)],
        "readings": list(model.readings),
        "objects": [(e.name, "entity", None) for e in model.entities] + [(v.name, "value", v.kind) for v in model.values],
        "domains": [(v.name, show(v.low), show(v.high), [str(a) for a in v.allowed]) for v in model.values if v.low is not None or v.allowed],
        "fields": [(e.name, f, k, of, req, e.identity.index(f) if f in e.identity else None) for e in model.entities for k, (f, of, req) in enumerate(e.fields)],
        "facts": [(f.name, f.objectified) for f in model.facts],
        "roles": [(f.name, r, k, p) for f in model.facts for k, (r, p) in enumerate(f.roles)],
        "rules": [(r.kind, r.fact, list(r.roles), r.other, list(r.other_roles), r.low, r.high, k) for k, r in enumerate(model.rules)],
        "subtypes": list(model.subtypes),
        "samples": [(f, k, [str(x) for x in literals]) for k, (f, literals) in enumerate(model.samples)],
        "analyses": [(n, k, list(args)) for k, (n, args) in enumerate(model.analyses)],
    }
    return {name: spark.createDataFrame(rows[name], ddl) for name, ddl in RELATIONS.items()}


def conflicts(relations: dict[str, DataFrame]) -> DataFrame:
    """``relation, key, column, n``: keys that the relations of a model give several values for what they must determine, and how many; a null is a value like another.

    A null key determines nothing.  Each dependency is one aggregation.
    """
    each = []
    for name, keys, columns in FUNCTIONAL:
        if name in relations:
            counts = [F.size(F.collect_set(F.struct(c))).alias(f"n_{c}") for c in columns]
            found = relations[name].where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*[F.col(k).cast("string").alias(f"k_{k}") for k in keys]).agg(*counts)
            told = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n")) for c in columns]))
            rows = found.select(F.lit(name).alias("relation"), F.array(*[f"k_{k}" for k in keys]).alias("key"), told.alias("t"))
            each.append(rows.select("relation", "key", "t.column", "t.n").where("n > 1"))
    return reduce(lambda a, b: a.unionByName(b), each)


def assembled(relations: dict[str, DataFrame]) -> DataFrame:
    """``part, place, body``: every element of a model with all that belongs to it as one JSON object, its fields or roles in their order; literals are texts, as exact as they were.

    Owners meet their parts by joins and one aggregation each.  ``place`` is the element's place in its relation.
    """
    spark = next(iter(relations.values())).sparkSession
    got = {k: relations.get(k, spark.createDataFrame([], ddl)) for k, ddl in RELATIONS.items()}
    listed = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    fields = got["fields"].groupBy(F.col("owner").alias("_owner")).agg(listed("ordinal", "name", "type", "required", "identifying").alias("fields"))
    roles = got["roles"].groupBy(F.col("fact").alias("_owner")).agg(listed("ordinal", "name", "player").alias("roles"))
    domains = got["domains"].withColumnRenamed("value", "_owner")
    numbered = {k: df.withColumn("place", F.monotonically_increasing_id()) for k, df in got.items()}
    parts = {
        "values": numbered["objects"].where("kind = 'value'").join(domains, F.col("name") == F.col("_owner"), "left").drop("_owner"),
        "entities": numbered["objects"].where("kind = 'entity'").join(fields, F.col("name") == F.col("_owner"), "left").drop("_owner"),
        "facts": numbered["facts"].join(roles, F.col("name") == F.col("_owner"), "left").drop("_owner"),
        "rules": numbered["rules"].withColumn("place", F.col("ordinal").cast("bigint")),
        **{k: numbered[k].withColumn("place", F.col("ordinal").cast("bigint")) for k in ("samples", "analyses")},
        **{k: numbered[k] for k in ("subtypes", "readings", "model")},
    }
    rows = [df.select(F.lit(k).alias("part"), "place", F.to_json(F.struct(*[c for c in df.columns if c != "place"])).alias("body")) for k, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def decode(relations: dict[str, DataFrame], name: str) -> Model:
    """The model that the relations state; ill-formed ones are refused as when they are declared, and those that say two things of one key too.

    Elements are assembled on Spark, and one row for each comes to the driver, where a model lives.  Bounds and enumerations of Decimals come back as decimals with all their digits.
    """
    wrong = conflicts(relations).orderBy("relation", "key", "column").limit(20).collect()
    if wrong:
        raise ModelError(f"the relations are no functions: {[(r.relation, list(r.key), r.column) for r in wrong]}")
    got: dict[str, list[dict]] = {}
    for r in assembled(relations).orderBy("part", "place").collect():
        got.setdefault(r.part, []).append(json.loads(r.body))
    kinds = {"Int": int, "Decimal": Decimal, "Float": float, "Bool": lambda s: s == "True"}
    values = []
    for v in got.get("values", []):
        read = kinds.get(v["scalar"], str)
        low, high = (read(v[c]) if v.get(c) is not None else None for c in ("low", "high"))
        values.append(Value(v["name"], v["scalar"], low, high, tuple(map(read, v.get("allowed") or ()))))
    entities = []
    for e in got.get("entities", []):
        mine = e.get("fields") or []
        ids = sorted((f for f in mine if f.get("identifying") is not None), key=lambda f: f["identifying"])
        entities.append(Entity(e["name"], tuple(f["name"] for f in ids), tuple((f["name"], f["type"], f["required"]) for f in mine)))
    facts = [Fact(f["name"], tuple((r["name"], r["player"]) for r in f.get("roles") or ()), f.get("objectified")) for f in got.get("facts", [])]
    rules = [Rule(r["kind"], r["fact"], tuple(r["roles"]), r["other"], tuple(r["other_roles"]), r["low"], r.get("high")) for r in got.get("rules", [])]
    pairs = lambda part, a, b: tuple((x[a], x[b]) for x in got.get(part, []))
    samples = tuple((x["fact"], tuple(x["literals"])) for x in got.get("samples", []))
    analyses = tuple((x["name"], tuple(x["arguments"])) for x in got.get("analyses", []))
    return Model(name, tuple(entities), tuple(values), tuple(facts), tuple(rules), pairs("subtypes", "sub", "sup"), pairs("readings", "fact", "text"), samples, analyses)


_CHANGE = ["kind", "subject", "rule", "low_before", "high_before", "low_after", "high_after", "removed"]


def _renamed(df: DataFrame, column: str, hints: DataFrame) -> DataFrame:
    """``df`` with the names of a column as the hints have them afterwards."""
    to = hints.select(F.col("before_name").alias("_from"), F.col("after_name").alias("_to"))  # one row for each renamed element
    return df.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def _compared(before: DataFrame, after: DataFrame, keys: list[str], names: tuple[str | None, str | None], changed: dict[str, str]) -> DataFrame:
    """Kinds of change between two relations by key: what was added, dropped, and the kind that goes with each column that differs."""
    values = list(changed)
    a = before.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("b"))
    both = a.join(after.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("a")), keys, "full_outer")
    differs = [F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("b")[c].eqNullSafe(F.col("a")[c]), F.lit(kind)) for c, kind in changed.items()]
    kinds = [F.when(F.col("b").isNull(), F.lit(names[0])), F.when(F.col("a").isNull(), F.lit(names[1])), *differs]
    return both.select(F.explode(F.array_compact(F.array(*kinds))).alias("kind"), F.concat_ws(".", *keys).alias("subject"), "b", "a")


def _change(df: DataFrame, rule: str | None = None, **bounds: str) -> DataFrame:
    filled = {n: F.expr(bounds[n]).cast("double") if n in bounds else F.lit(None).cast("double") for n in _CHANGE[3:]}
    return df.select("kind", "subject", (F.lit(rule) if rule else F.lit(None).cast("string")).alias("rule"), *[c.alias(n) for n, c in filled.items()])


def changes(before: dict[str, DataFrame], after: dict[str, DataFrame], hints: DataFrame | None = None) -> DataFrame:
    """``kind, subject, rule``, bounds before and after, and ``safety`` of every difference between two models' relations.

    ``hints(element, before_name, after_name)`` name renamed objects, facts, and roles or fields as ``owner.name``; nothing else is
    taken for a rename, so without one it is a drop and an addition.  A field whose hint names another owner is moved.  Rules and readings are
    compared by the names that their roles have afterwards.
    """
    spark = before["objects"].sparkSession
    hints = hints if hints is not None else spark.createDataFrame([], "element string, before_name string, after_name string")
    old = dict(before)
    of = {k: hints.where(F.col("element") == k) for k in ("object", "fact")}
    for relation, column, kind in (("objects", "name", "object"), ("domains", "value", "object"), ("fields", "owner", "object"), ("fields", "type", "object"), ("roles", "player", "object"), ("subtypes", "sub", "object"), ("subtypes", "sup", "object"),
                                   ("facts", "name", "fact"), ("roles", "fact", "fact"), ("rules", "fact", "fact"), ("rules", "other", "fact")):
        old[relation] = _renamed(old[relation], column, of[kind])
    for relation, owner, kind in (("fields", "owner", "field"), ("roles", "fact", "role")):
        whole = _renamed(old[relation].withColumn("_path", F.concat_ws(".", owner, "name")), "_path", hints.where(F.col("element") == kind))
        path = F.split("_path", r"\.")
        old[relation] = whole.withColumn("name", F.element_at(path, -1)).withColumn(owner, F.get(path, F.lit(0))).drop("_path")
    # roles by their names afterwards, in rules and readings; the hints have a row for each renamed role
    renames = {r.before_name: r.after_name for r in hints.where("element = 'role'").collect()}

    def later(fact: str):
        return lambda role: reduce(lambda c, h: F.when(F.concat_ws(".", F.col(fact), role) == h[0], h[1].rsplit(".", 1)[-1]).otherwise(c), renames.items(), role)

    old["rules"] = old["rules"].withColumns({roles: F.transform(roles, later(fact)) for fact, roles in (("fact", "roles"), ("other", "other_roles"))})
    text = reduce(lambda c, h: F.when(F.col("fact") == h[0].rsplit(".", 1)[0], F.replace(c, F.lit("{" + h[0].rsplit(".", 1)[-1] + "}"), F.lit("{" + h[1].rsplit(".", 1)[-1] + "}"))).otherwise(c), renames.items(), F.col("text"))
    old["readings"] = old["readings"].withColumn("text", text)
    key = F.concat(F.col("kind"), F.lit(":"), "fact", F.lit("("), F.array_join("roles", ","), F.lit(")"), F.when(F.col("other") != "", F.concat(F.lit(":"), "other", F.lit("("), F.array_join("other_roles", ","), F.lit(")"))).otherwise(""))
    ruled = [r["rules"].withColumn("rule", key).withColumn("bounds", F.struct("low", "high")) for r in (old, after)]
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.unix_micros(F.col(c).try_cast("timestamp")).cast("double"))
    domains = [r["domains"].select("value", number("low").alias("low"), number("high").alias("high"), "allowed").withColumn("range", F.struct("low", "high")) for r in (old, after)]
    removed = "size(array_except(b.allowed, a.allowed))"
    domain = _compared(*domains, ["value"], ("add_constraint", "drop_constraint"), {"range": "change_range", "allowed": "change_allowed"})
    objectification = F.when(F.col("kind") != "rename_objectification", F.col("kind")).when(F.col("b.objectified").isNull(), "add_objectification").when(F.col("a.objectified").isNull(), "drop_objectification").otherwise(F.col("kind"))
    owner = lambda c: F.get(F.split(c, r"\."), F.lit(0))
    moved = (F.col("element") == "field") & (owner("before_name") != owner("after_name"))
    fix = lambda df: df.withColumn("kind", F.lit("change_constraint"))
    parts = [
        hints.select(F.when(moved, "move_field").otherwise(F.concat(F.lit("rename_"), F.when(F.col("element") == "object", "object_type").otherwise(F.col("element")))).alias("kind"), F.col("after_name").alias("subject")).transform(_change),
        _change(before["model"].select(F.lit("rename_model").alias("kind"), F.col("name").alias("_was")).join(after["model"].withColumnRenamed("name", "subject"), F.col("_was") != F.col("subject"))),
        _change(_compared(old["readings"].groupBy("fact").agg(F.min("text").alias("text")), after["readings"].groupBy("fact").agg(F.min("text").alias("text")), ["fact"], ("add_reading", "drop_reading"), {"text": "change_reading"})),
        _change(_compared(old["objects"], after["objects"], ["name"], ("add_object_type", "drop_object_type"), {"kind": "change_object_type_kind", "scalar": "change_value_scalar"})),
        _change(_compared(old["facts"], after["facts"], ["name"], ("add_fact", "drop_fact"), {"objectified": "rename_objectification"}).withColumn("kind", objectification)),
        _change(_compared(old["roles"], after["roles"], ["fact", "name"], ("add_role", "drop_role"), {"player": "change_role_player", "ordinal": "reorder_role"})),
        _change(_compared(old["fields"], after["fields"], ["owner", "name"], ("add_field", "drop_field"), {"type": "change_field_type", "required": "change_field_required", "identifying": "change_field_identifier"}), low_before="int(b.required)", low_after="int(a.required)"),
        _change(_compared(*ruled, ["rule"], ("add_constraint", "drop_constraint"), {"bounds": "change_constraint"}), "frequency", low_before="b.bounds.low", low_after="a.bounds.low", high_before="coalesce(b.bounds.high, 2147483647)", high_after="coalesce(a.bounds.high, 2147483647)"),
        _change(domain.where("kind LIKE '%_constraint'")),
        _change(fix(domain.where("kind = 'change_range'")), "range", low_before="coalesce(b.range.low, double('-infinity'))", low_after="coalesce(a.range.low, double('-infinity'))", high_before="coalesce(b.range.high, double('infinity'))", high_after="coalesce(a.range.high, double('infinity'))"),
        _change(fix(domain.where("kind = 'change_allowed'")), "oneof", removed=f"CASE WHEN size(a.allowed) = 0 THEN 0 WHEN size(b.allowed) = 0 THEN 1 ELSE {removed} END"),
        _change(_compared(old["subtypes"], after["subtypes"], ["sub"], ("add_subtype", "drop_subtype"), {"sup": "change_subtype"})),
    ]
    return evolution.safety(reduce(lambda a, b: a.unionByName(b), parts))


def ambiguities(found: DataFrame, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """``kind, dropped, added``: where :func:`changes` both dropped and added types of one kind, or facts, so that some may be renames without a hint."""
    both = []
    for what, relation, kind in (("object_type", "objects", F.col("kind")), ("fact", "facts", F.lit("fact"))):
        sides = []
        for how, relations in (("drop", before), ("add", after)):
            names = relations[relation].select(F.col("name").alias("subject"), kind.alias("of"))
            gone = found.where(F.col("kind") == f"{how}_{what}").select("subject").join(names, "subject")
            sides.append(gone.groupBy("of").agg(F.sort_array(F.collect_list("subject")).alias(f"{how}ped" if how == "drop" else "added")))
        both.append(sides[0].join(sides[1], "of"))
    return reduce(lambda a, b: a.unionByName(b), both).select(F.col("of").alias("kind"), "dropped", "added")


def steps(found: DataFrame) -> DataFrame:
    """Changes as the steps of a migration: their ``phase`` and whether they run by themselves (``automatic``)."""
    kind = F.col("kind")
    phase = (
        F.when((F.col("safety") == "destructive") & kind.startswith("drop_"), "cleanup")
        .when(kind.contains("constraint") | kind.endswith("_subtype"), "constraints")
        .when(kind.rlike("field|fact|object_type|objectification|role"), "schema")
        .otherwise("metadata")
    )
    return found.withColumn("phase", phase).withColumn("automatic", F.col("safety") == "safe")


def preflight(before: Model, after: Model, bound: plan.Binding) -> DataFrame:
    """What the data bound to the new model would violate of the obligations that the old one had not: ``obligation_id, violations``.

    An obligation that is new and has no violations has a row too; a migration may run when all of them are 0.
    """
    known = {o for o, _ in plan.obligations(before)}
    domains = {v.name: (v.low, v.high, v.allowed) for v in before.values}
    tightened = {v.name for v in after.values if domains.get(v.name) not in (None, (v.low, v.high, v.allowed))}
    fields = {f"value:{e.name}.{f}" for e in after.entities for f, of, _ in e.fields if of in tightened}
    new = [o for o, _ in plan.obligations(after) if o not in known or o in fields]
    found = plan.violations(after, bound).where(F.col("obligation_id").isin(new))
    wanted = found.sparkSession.createDataFrame([(o,) for o in new], "obligation_id string")
    return wanted.join(found.groupBy("obligation_id").agg(F.count(F.lit(1)).alias("violations")), "obligation_id", "left").fillna(0, ["violations"])


# -- the tables of a model, and the operations that lead from one model's to another's ---------------------------------


def physical(model: Model) -> dict[str, list[tuple]]:
    """The tables that keep a model, as rows: ``tables(name)``, ``columns(table, name, type, nullable)``, ``keys(table, kind, columns, text)``.

    An entity is a table of its fields and the key of what is above it, a fact one of its players' keys.  A key is the identifier of the
    nearest type that has one, or a column ``id``.  Keys are primary, unique (also a frequency of one at most), check and foreign ones.
    """
    scalars = {v.name: KINDS[v.kind] for v in model.values}
    fields = {e.name: {f: of for f, of, _ in e.fields} for e in model.entities}
    objectified = {f.objectified for f in model.facts if f.objectified}

    def key_of(type_: str) -> list[tuple[str, str]]:
        if type_ in scalars:
            return [("", scalars[type_])]
        owner = next((t for t in model.above(type_) if type_ not in objectified and model.identifier(t) and t in fields and set(model.identifier(t)) <= set(fields[t])), None)
        return [(f, scalars[fields[owner][f]]) for f in model.identifier(owner)] if owner else [("id", "bigint")]

    def role_columns(role: str, player: str) -> list[tuple[str, str]]:
        parts = key_of(player)
        return [(role if len(parts) == 1 else f"{role}_{n}", t) for n, t in parts]

    out: dict[str, list[tuple]] = {"tables": [], "columns": [], "keys": []}
    domains = {v.name: v for v in model.values if v.low is not None or v.allowed}

    def check(table: str, column: str, value: str) -> None:
        if v := domains.get(value):
            said = f"{column} BETWEEN {v.low!r} AND {v.high!r}" if v.low is not None else f"{column} IN ({', '.join(map(repr, v.allowed))})"
            out["keys"].append((table, "check", [column], said))

    for e in model.entities:
        key = key_of(e.name)
        out["tables"].append((e.name,))
        mine = fields[e.name]
        out["columns"] += [(e.name, n, t, False) for n, t in key if n not in mine]
        out["columns"] += [(e.name, f, scalars[of], not (required or f in e.identity)) for f, of, required in e.fields]
        out["keys"].append((e.name, "primary", [n for n, _ in key], ""))
        for f, of in mine.items():
            check(e.name, f, of)
        if up := dict(model.subtypes).get(e.name):
            out["keys"].append((e.name, "foreign", [n for n, _ in key], f"{up}({', '.join(n for n, _ in key_of(up))})"))
    for f in model.facts:
        columns = {r: role_columns(r, p) for r, p in f.roles}
        names = lambda roles, columns=columns: [n for r in roles for n, _ in columns[r]]
        out["tables"].append((f.name,))
        out["columns"] += [(f.name, "id", "bigint", False)] * bool(f.objectified) + [(f.name, n, t, False) for r in columns for n, t in columns[r]]
        out["keys"].append((f.name, "primary", ["id"] if f.objectified else names(columns), ""))
        out["keys"] += [(f.name, "unique", names(columns), "")] * bool(f.objectified)
        for r, p in f.roles:
            if p in scalars:
                check(f.name, r, p)
            else:
                target = next((g.name for g in model.facts if g.objectified == p), p)
                out["keys"].append((f.name, "foreign", names([r]), f"{target}({', '.join(n for n, _ in key_of(p))})"))
        for rule in model.rules:
            if rule.fact == f.name and (rule.kind == "uniqueness" or (rule.kind == "frequency" and rule.high == 1)) and set(rule.roles) != set(f.role_names):
                out["keys"].append((f.name, "unique", names(rule.roles), ""))
            elif rule.fact == f.name and rule.kind == "unordered":
                parts = [names([r]) for r in rule.roles]
                said = " AND ".join(f"({', '.join(a)}) <= ({', '.join(b)})" for a, b in zip(parts, parts[1:], strict=False))
                out["keys"].append((f.name, "check", names(rule.roles), said))
    return {name: sorted(set((*r[:2], tuple(r[2]), *r[3:]) if name == "keys" else r for r in rows)) for name, rows in out.items()}


#: The phases of operations in their order, and the kinds that come first within one.
PHASES = ["rename", "create", "shape", "constraints", "foreign_keys", "cleanup", "manual"]
FIRST_KINDS = ["rename_table", "rename_column"]


def operations(spark: SparkSession, before: Model, after: Model, hints: DataFrame | None = None) -> DataFrame:
    """``phase, kind, target, subject, safety, automatic`` of the steps from the tables of one model to those of another, in their order.

    Renames are those that ``hints`` name; a new required column is added as optional and made required after it has been filled.
    """
    hints = hints if hints is not None else spark.createDataFrame([], "element string, before_name string, after_name string")
    ddl = {"tables": "name string", "columns": "table string, name string, type string, nullable boolean", "keys": "table string, kind string, columns array<string>, text string"}
    old, new = ({n: spark.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in r) for r in rows], ddl[n]) for n, rows in physical(m).items()} for m in (before, after))
    tables = {r.before_name: r.after_name for r in hints.where("element IN ('object', 'fact')").collect()}
    columns = {r.before_name: r.after_name.rsplit(".", 1)[-1] for r in hints.where("element IN ('field', 'role')").collect()}
    col = F.col

    def table_later(c: Column) -> Column:
        return reduce(lambda done, h: F.when(c == h[0], h[1]).otherwise(done), tables.items(), c)

    def column_later(table: Column, c: Column) -> Column:
        return reduce(lambda done, h: F.when((table == tables.get(h[0].split(".")[0], h[0].split(".")[0])) & (c == h[0].split(".")[1]), h[1]).otherwise(done), columns.items(), c)

    def op(df: DataFrame, phase: str, kind: str, safety: str, subject: Column | str = "") -> DataFrame:
        what = subject if isinstance(subject, Column) else F.lit(subject)
        return df.select(F.lit(phase).alias("phase"), F.lit(kind).alias("kind"), col("table").alias("target"), what.cast("string").alias("subject"), F.lit(safety).alias("safety"))

    names = old["tables"].select(col("name").alias("was"), table_later(col("name")).alias("table")).join(new["tables"].select(col("name").alias("table"), F.lit(True).alias("now")), "table", "full_outer")
    each = [op(names.where("was IS NULL"), "create", "create_table", "safe"), op(names.where("now IS NULL"), "cleanup", "drop_table", "destructive"), op(names.where("now AND was <> table"), "rename", "rename_table", "safe", col("was"))]
    kept = names.where("now AND was IS NOT NULL").select("table")
    a = old["columns"].withColumn("table", table_later(col("table"))).select("table", column_later(col("table"), col("name")).alias("name"), F.struct("name", "type", "nullable").alias("b"))
    both = a.join(new["columns"].select("table", "name", F.struct("type", "nullable").alias("a")), ["table", "name"], "full_outer").join(kept, "table", "left_semi")
    whole, added = both.where("a IS NOT NULL AND b IS NOT NULL"), both.where("b IS NULL")
    each += [
        op(whole.where("b.name <> name"), "rename", "rename_column", "safe", F.concat("b.name", F.lit(" to "), "name")),
        op(whole.where("b.type <> a.type"), "manual", "change_column_type", "manual", col("name")),
        op(whole.where("b.nullable AND NOT a.nullable"), "constraints", "set_not_null", "requires_data_check", col("name")),
        op(whole.where("a.nullable AND NOT b.nullable"), "shape", "drop_not_null", "safe", col("name")),
        op(added.where("a.nullable"), "shape", "add_column", "safe", col("name")),
        op(added.where("NOT a.nullable"), "shape", "add_column_staged", "safe", col("name")),
        op(added.where("NOT a.nullable"), "constraints", "set_not_null_after_backfill", "requires_data_check", col("name")),
        op(both.where("a IS NULL"), "cleanup", "drop_column", "destructive", col("name")),
    ]
    shown = F.concat(F.array_join("columns", ","), F.when(col("text") != "", F.concat(F.lit(": "), "text")).otherwise(""))
    later = old["keys"].withColumn("table", table_later(col("table"))).withColumn("columns", F.transform("columns", lambda c: column_later(col("table"), c)))
    for n, change in columns.items():  # checks are texts
        later = later.withColumn("text", F.when((col("kind") == "check") & (col("table") == tables.get(n.split(".")[0], n.split(".")[0])), F.regexp_replace("text", rf"\b{n.split('.')[1]}\b", change)).otherwise(col("text")))
    for n, change in tables.items():  # and references name tables
        later = later.withColumn("text", F.when(col("kind") == "foreign", F.regexp_replace("text", rf"^{n}\(", f"{change}(")).otherwise(col("text")))
    x, y = (r.select("table", "kind", shown.alias("shown")) for r in (later, new["keys"]))
    more, fewer = y.subtract(x), x.subtract(y)
    fresh = more.where("kind = 'foreign'").join(kept, "table", "left_anti")
    more, fewer = more.join(kept, "table", "left_semi"), fewer.join(kept, "table", "left_semi")
    each += [op(fresh, "foreign_keys", "add_foreign_key", "safe", col("shown")), op(more.where("kind = 'primary'"), "manual", "change_primary_key", "manual", col("shown"))]
    for kind, name in (("unique", "unique"), ("check", "check"), ("foreign", "foreign_key")):
        each.append(op(more.where(col("kind") == kind), "foreign_keys" if kind == "foreign" else "constraints", f"add_{name}", "requires_data_check", col("shown")))
        each.append(op(fewer.where(col("kind") == kind), "manual", f"drop_{name}", "manual", col("shown")))
    found = reduce(lambda a, b: a.unionByName(b), each).withColumn("automatic", col("safety") == "safe")
    place = F.array_position(F.lit(PHASES), col("phase"))
    early = F.array_position(F.lit(FIRST_KINDS), col("kind"))
    return found.orderBy(place, F.when(early > 0, early).otherwise(10), "target", "kind", "subject")


def differences(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """``relation, side, row``: what the relations of one model have and those of another lack, as JSON; none if they are the same model."""
    each = []
    for name in sorted(set(a) & set(b)):
        rows = [df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row")) for df in (a[name], b[name])]
        for side, one, other in (("left", *rows), ("right", *rows[::-1])):
            each.append(one.exceptAll(other).select(F.lit(name).alias("relation"), F.lit(side).alias("side"), "row"))
    return reduce(lambda x, y: x.unionByName(y), each)


def ddl(model: Model, using: str = "parquet") -> dict[str, str]:
    """CREATE TABLE for every table of :func:`physical`, by name, with the fact's reading as its comment.

    Spark enforces types and NOT NULL on write; keys and checks are in the table's properties, where catalogues can be compared, and the
    checks among them are expressions for :func:`rolewise.operators.evolution.check_rows`.
    """
    parts, readings = physical(model), dict(model.readings)
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    out = {}
    for (table,) in parts["tables"]:
        columns = ", ".join(f"`{n}` {t.upper()}{'' if nullable else ' NOT NULL'}" for of, n, t, nullable in parts["columns"] if of == table)
        keys: dict[str, list[str]] = {}
        for of, kind, names, text in parts["keys"]:
            if of == table:
                keys.setdefault(kind, []).append(text if kind == "check" else f"({', '.join(names)})" + (f" {text}" if text else ""))
        properties = ", ".join(f"{quoted(f'rolewise.{kind}.{k}')}={quoted(said)}" for kind, each in sorted(keys.items()) for k, said in enumerate(each))
        comment = f" COMMENT {quoted(readings[table])}" if table in readings else ""
        out[table] = f"CREATE TABLE `{table}` ({columns}) USING {using}{comment}" + (f" TBLPROPERTIES ({properties})" if properties else "")
    return out


def table_ddl(model: Model, entity: str, using: str = "parquet") -> str:
    """CREATE TABLE of an entity's fields for Spark's catalogue; required and identifying fields are NOT NULL.

    Spark enforces these on write and nothing else of the model: the rest is checked by the compiled rules.
    """
    kinds = {v.name: v.kind for v in model.values}
    e = next(x for x in model.entities if x.name == entity)
    columns = [f"`{f}` {KINDS[kinds[of]].upper()}{' NOT NULL' if required or f in e.identity else ''}" for f, of, required in e.fields]
    return f"CREATE TABLE `{entity}` ({', '.join(columns)}) USING {using}"
