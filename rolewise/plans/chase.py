"""The chase: what a population lacks by the rules that ask for more is added, in rounds over long relations.

A rule asks for more where it is mandatory, a subset, an equality (both ways), symmetric, a subtype, or a frequency with a lower bound.  Each is one of three
relations of rules, so a round is one plan whatever the model: what is new since the last round meets the rules, what is there already is taken out, and the
rest becomes rows whose missing players are new.  A new player is named by the hash of the rule and of what asked for it, so that reruns agree and nothing is numbered on the driver.

New players may ask for new players in turn.  Positions (roles and types) between which a rule copies or creates players are a graph; if no way that creates
one leads back to itself the model is weakly acyclic, and the chase ends.  A rule on such a way is *closing*: its new players are named without what asked for
them, so that each case has one, and the chase ends as well, though what it adds is then no more the least that the rules ask for.
"""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise.functions.scalar import TIMES
from rolewise.operators.ancestry import Grown
from rolewise.plans.model import Model, Rule, Value

#: Populations side by side: ``kind`` is fact or member, ``of`` its type, ``row`` the players, or the id and the fields' literals.
ATOMS = "case string, kind string, of string, row array<string>"


def directed(r: Rule, model: Model) -> list[tuple[str, tuple[str, ...], str, tuple[str, ...]]]:
    """The inclusions (fact, roles, other, other roles) that a rule states."""
    if r.kind == "symmetric":
        a, b = model.fact(r.fact).role_names
        return [(r.fact, (a, b), r.fact, (b, a))]
    if r.kind in ("subset", "equality"):
        one = (r.fact, r.roles, r.other, r.other_roles)
        return [one, (r.other, r.other_roles, r.fact, r.roles)][: 1 + (r.kind == "equality")]
    return []


def asks(model: Model) -> list[tuple[str, str, str, list[int], str, list[int], int]]:
    """(obligation, what asks, its type or fact, places of the key there, the fact that is asked for, places of the key in it, how many rows)."""
    places = lambda fact, roles: [model.fact(fact).role_names.index(x) for x in roles]
    out = []
    for r in model.rules:
        if r.kind == "mandatory":
            out.append((r.id, "member", model.player(r.fact, r.roles[0]), [0], r.fact, places(r.fact, r.roles), 1))
        if r.kind == "frequency" and r.low > 1 and set(r.roles) != set(model.fact(r.fact).role_names):
            out.append((r.id, "fact", r.fact, places(r.fact, r.roles), r.fact, places(r.fact, r.roles), r.low))
        for fact, roles, other, others in directed(r, model):
            out.append((r.id, "fact", fact, places(fact, roles), other, places(other, others), 1))
    return out


def closing(model: Model) -> set[str]:
    """The obligations that create players on a way that leads back to itself; a model without any is weakly acyclic."""
    edges, creates = defaultdict(set), []
    for a, b in model.subtypes:
        edges["member", a].add(("member", b))
    for obligation, kind, of, key, fact, at, _ in asks(model):
        start = [("member", of)] if kind == "member" else [(of, k) for k in key]
        for k, (_, player) in enumerate(model.fact(fact).roles):
            if k in at:
                edges[start[at.index(k)] if kind == "fact" else start[0]].add((fact, k))
            else:
                for s in start:
                    for to in ((fact, k), ("member", player)):
                        edges[s].add(to)
                        creates.append((obligation, s, to))

    def leads(frm: tuple, to: tuple) -> bool:
        seen, open_ = {frm}, [frm]
        while open_:
            for n in edges[open_.pop()] - seen:
                seen.add(n)
                open_.append(n)
        return to in seen

    return {o for o, frm, to in creates if leads(to, frm)}


def literal(v: Value, unique: Column, number: Column) -> Column:
    """A literal of the value type for each ``unique`` text and ``number``, different ones where the domain has enough."""
    if v.allowed:
        return F.element_at(F.lit([str(a) for a in v.allowed]), (F.pmod(number, F.lit(len(v.allowed))) + 1).cast("int"))
    if v.kind in TIMES:
        low, high = datetime.fromisoformat(v.low or "2024-01-01"), datetime.fromisoformat(v.high or "2100-01-01")
        day = F.dateadd(F.lit(low.date()), F.pmod(number, F.lit((high - low).days + 1)).cast("int")).cast("string")
        return day if v.kind == "Date" else F.concat(day, F.lit(low.isoformat(" ")[10:]))
    if v.low is not None:
        span = int(v.high - v.low) + 1
        return (F.lit(v.low if v.kind != "Float" else float(v.low)) + F.pmod(number, F.lit(span))).cast("string")
    if v.kind == "Bool":
        return F.when(F.pmod(number, F.lit(2)) == 0, "true").otherwise("false")
    if v.kind == "UUID":
        return F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.pmod(number, F.lit(10**12)).cast("string"), 12, "0"))
    return unique if v.kind == "String" else number.cast("string")


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 10), 16, 10).cast("bigint")


def chased(model: Model, atoms: DataFrame, spared: DataFrame | None = None) -> DataFrame:
    """``atoms`` (see :data:`ATOMS`) with all that their cases lack; in a case of ``spared(case, obligation)`` that rule asks for nothing.

    Ids and literals begin with their case and a bar.  Every round's new rows are written once; the result is read from them, so its files are left to whoever reads it.
    Players that are no members stay so.  A fact that is symmetric and unordered at once can only hold of a player and itself, so that is what is created for it.
    """
    spark, col = atoms.sparkSession, F.col
    domains, entities = {v.name: v for v in model.values}, {e.name: e for e in model.entities}
    table = lambda rows, ddl: F.broadcast(spark.createDataFrame(rows, ddl))  # noqa: E731 - a row for each rule or fact of a model
    loops, asked = closing(model), asks(model)
    wants = table([(o, k, of, key, fact, at, n, o in loops) for o, k, of, key, fact, at, n in asked], "ob string, by string, of string, key_at array<int>, to string, at array<int>, times int, closing boolean")
    there = table(sorted({(o, fact, tuple(at)) for o, _, _, _, fact, at, _ in asked}), "ob string, to string, at array<int>")
    both = {f.name for f in model.facts if {"symmetric", "unordered"} <= {r.kind for r in model.rules if r.fact == f.name}}
    specs = table([(f.name, [p for _, p in f.roles], f.name in both) for f in model.facts], "to string, players array<string>, itself boolean")
    above = table([(a, b, f"subtype:{a}<{b}") for a, b in model.subtypes], "of string, sup string, ob string")
    spared = spared if spared is not None else spark.createDataFrame([], "case string, obligation string")
    spared = spared.select("case", col("obligation").alias("ob"))

    facts, members = Grown("chase-facts"), Grown("chase-members")
    last = facts.add(atoms.where("kind = 'fact'").select("case", "of", "row").distinct())
    new = members.add(atoms.where("kind = 'member'").select("case", "of", col("row")[0].alias("id")).distinct())
    given_facts, given_members = last, new
    while not (last.isEmpty() and new.isEmpty()):
        told = last.select("case", F.lit("fact").alias("by"), "of", "row").unionByName(new.select("case", F.lit("member").alias("by"), "of", F.array("id").alias("row")))
        key = lambda places: F.transform(places, lambda k: F.get("row", k))
        wanted = told.join(wants, ["by", "of"]).select("case", "ob", "to", "at", "times", "closing", key("key_at").alias("key")).distinct().join(spared, ["case", "ob"], "left_anti")
        held = facts.all.withColumnRenamed("of", "to").join(there, "to").select("case", "ob", "to", "at", key("at").alias("key"))
        held = held.groupBy("case", "ob", "to", "at", "key").agg(F.count(F.lit(1)).alias("n"))
        lacking = wanted.join(held, ["case", "ob", "to", "at", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < times")
        each = lacking.withColumn("copy", F.explode(F.sequence(col("n") + 1, col("times").cast("bigint")))).join(specs, "to")
        seed = F.concat_ws("\x1f", "ob", F.when(~col("closing"), F.array_join("key", "\x1f")), col("copy").cast("string"))
        each = each.withColumn("seed", seed)

        def player(k: Column) -> Column:
            place, type_ = F.array_position("at", k), F.get("players", k)
            name = F.substring(F.sha2(F.concat_ws("\x1f", "seed", k.cast("string")), 256), 1, 16)
            unique = F.concat("case", F.lit("|"), type_, F.lit("~"), name)
            made = unique
            for v in domains.values():
                made = F.when(type_ == v.name, F.concat("case", F.lit("|"), literal(v, unique, _number(name)))).otherwise(made)
            itself = F.when(col("itself"), F.get("key", F.lit(0)))
            return F.when(place > 0, F.get("key", (place - 1).cast("int"))).otherwise(F.coalesce(itself, made))

        def is_made(k: Column) -> Column:
            return (F.array_position("at", k) == 0) & ~col("itself") & F.get("players", k).isin(list(entities))

        places = F.sequence(F.lit(0), F.size("players") - 1)
        rows = each.select("case", col("to").alias("of"), F.transform(places, player).alias("row"), F.transform(F.filter(places, is_made), lambda k: F.struct(F.get("players", k).alias("of"), player(k).alias("id"))).alias("made"))
        told_up = new.join(above, "of").join(spared, ["case", "ob"], "left_anti").select("case", col("sup").alias("of"), "id")
        added = rows.select("case", F.inline("made")).unionByName(told_up).distinct().join(members.all, ["case", "of", "id"], "left_anti")
        fresh = rows.select("case", "of", "row").distinct().join(facts.all, ["case", "of", "row"], "left_anti")
        # both are written before either counts as there
        made_members, made_facts = added, fresh
        new, last = members.add(made_members), facts.add(made_facts)

    def fielded(name: str) -> DataFrame:
        fields = [literal(domains[of], F.concat("id", F.lit("."), F.lit(f)), _number(F.concat("id", F.lit(f)))) for f, of, _ in entities[name].fields]
        return members.all.where(col("of") == name).join(given_members, ["case", "of", "id"], "left_anti").select("case", F.lit("member").alias("kind"), "of", F.array("id", *fields).alias("row"))

    parts = [atoms.select("case", "kind", "of", "row"), facts.all.join(given_facts, ["case", "of", "row"], "left_anti").select("case", F.lit("fact").alias("kind"), "of", "row"), *map(fielded, entities)]
    return reduce(DataFrame.unionByName, parts)
