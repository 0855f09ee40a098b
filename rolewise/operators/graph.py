"""Graphs of a model: incidence, connectivity, subtype chains, revision ancestry and references that lead nowhere.

Models are small next to the data, but nothing here depends on that: closures and components are joins that are
repeated until nothing changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.operators import ancestry
from rolewise.plans.model import Model
from rolewise.sources.tables import discard, durable


def incidence(roles: DataFrame) -> DataFrame:
    """For each player of ``roles(fact, role, player)`` its roles in order, and in how many facts they are."""
    return roles.groupBy("player").agg(
        F.sort_array(F.collect_list("role")).alias("roles"), F.count_distinct("fact").alias("n_facts")
    )


def closure(edges: DataFrame, most_steps: int | None = None) -> DataFrame:
    """``src, dst, depth``: all that can be reached from each source, with the least depth; with ``most_steps`` in at most so many steps.

    Round k knows all pairs up to 2**k steps apart.  Any pair up to twice as far is one of exactly 2**k steps and a known one, so
    only those are joined, and what is known already is dropped.  The rounds grow with the logarithm of the longest way and end on
    cycles too, which :func:`cycles` finds; each writes its new pairs to the shared folder.
    """
    known = durable(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct().withColumn("depth", F.lit(1)))
    far, steps = known, 1
    while (most_steps is None or steps < most_steps) and not far.isEmpty():
        rest = known.select(F.col("src").alias("via"), F.col("dst").alias("to"), F.col("depth").alias("more"))
        met = far.join(rest, F.col("dst") == F.col("via")).groupBy("src", F.col("to").alias("dst")).agg((F.min("more") + steps).alias("depth"))
        if most_steps is not None:
            met = met.where(F.col("depth") <= most_steps)
        new = durable(met.join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
        known, steps = known.union(new), 2 * steps
        far = new.where(F.col("depth") == steps)
    return known


def cycles(edges: DataFrame, most_steps: int | None = None) -> DataFrame:
    """Nodes of ``edges(src, dst)`` that can reach themselves, without a closure; with ``most_steps`` in at most so many steps, from their closure."""
    if most_steps is not None:
        return closure(edges, most_steps).where("src = dst").select(F.col("src").alias("node"))
    return ancestry.cycles(edges).select("node")


def effective_identifier(subtypes: DataFrame, identified: DataFrame) -> DataFrame:
    """For each type of ``subtypes(sub, sup)`` and ``identified(type)`` the nearest type, itself or above, with an identifier: ``type, owner, depth``."""
    return ancestry.nearest(subtypes, identified.select(F.col("type").alias("node"))).withColumnRenamed("node", "type")


def components(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 100) -> DataFrame:
    """``node, component``: the least node connected to each, where edges ``src, dst`` lead both ways.

    Every round points each node at its least neighbour, if that is less, follows the pointers to their ends in doubling steps, and goes on with the edges between different ends, each once.  At
    least half of the nodes with an edge are no end, so rounds grow with the logarithm of the nodes and shrink (``most_rounds`` are more than any graph takes, and beyond them it raises);
    at last the rounds' pointers are put together.  Minima are aggregated before they are shuffled, so a node with very many links is one row for each task.
    """
    open_ = durable(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst"), "components-open")  # repeated edges go when minima are taken
    rounds: list[DataFrame] = []
    while not rounds or not open_.isEmpty():
        if len(rounds) == most_rounds:
            raise RuntimeError(f"no end after {most_rounds} rounds")
        both = open_.select(F.col("src").alias("node"), "dst").union(open_.select("dst", "src"))
        to = durable(both.groupBy("node").agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("to")), "components-to")
        while True:
            up = to.select(F.col("node").alias("to"), F.col("to").alias("up"))
            moved = durable(to.select("node", "to").join(up, "to").select("node", F.col("up").alias("to"), (F.col("up") < F.col("to")).alias("moved")), "components-to")
            discard(to)
            to = moved
            if to.where("moved").isEmpty():
                break
        end = lambda c: to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_end"))  # noqa: B023, E731
        between = open_.join(end("src"), "src").join(end("dst"), "dst").where("src_end <> dst_end")
        before, open_ = open_, durable(between.select(F.least("src_end", "dst_end").alias("src"), F.greatest("src_end", "dst_end").alias("dst")).distinct(), "components-open")
        discard(before)
        rounds.append(to)
    labels = rounds[-1].select("node", F.col("to").alias("component"))
    for one in reversed(rounds[:-1]):
        further = labels.select(F.col("node").alias("to"), "component")
        labels = one.select("node", "to").join(further, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    if nodes is not None:
        alone = nodes.select("node").distinct().join(rounds[0].select("node"), "node", "left_anti")
        labels = labels.union(alone.select("node", F.col("node").alias("component")))
    labels = durable(labels, "components")
    discard(open_, *rounds)
    return labels


def uniform(roles: DataFrame, arity: int) -> DataFrame:
    """Facts of ``roles(fact, role, player)`` whose number of roles is not ``arity``, and ``n``."""
    return roles.groupBy("fact").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != arity)


def ancestors(parents: DataFrame) -> DataFrame:
    """``revision, ancestor, depth``: each revision of ``parents(revision, parent)`` with itself (0) and all before it."""
    up = closure(parents.where("parent IS NOT NULL").select(F.col("revision").alias("src"), F.col("parent").alias("dst")))
    every = parents.select("revision").union(parents.where("parent IS NOT NULL").select("parent")).distinct()
    own = every.select("revision", F.col("revision").alias("ancestor"), F.lit(0).alias("depth"))
    return own.union(up.select(F.col("src").alias("revision"), F.col("dst").alias("ancestor"), "depth"))


def merge_base(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each of ``pairs(ours, theirs)`` the common ancestor with the least (greater distance, sum, id)."""
    return ancestry.merge_base(parents, pairs)


def fast_forward(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(old, new)`` and whether ``old`` is an ancestor of ``new``, so that a branch may move there."""
    return ancestry.fast_forward(parents, pairs)


def closure_order(parents: DataFrame, head: object) -> DataFrame:
    """The revisions behind ``head``, those furthest away first."""
    asked = parents.sparkSession.createDataFrame([(head,)], parents.select("revision").schema)
    return ancestry.ancestors_of(parents, asked).select("ancestor", "depth").orderBy(F.desc("depth"), "ancestor")


def analyses(model: Model, spark: SparkSession) -> DataFrame:
    """:func:`analyses_of` the facts of a model, as it asks for them."""
    rows = [(f.name, r, p) for f in model.facts for r, p in f.roles]
    return analyses_of(spark.createDataFrame(rows, "fact string, role string, player string"), model.analyses)


def _pieces(roles: DataFrame) -> DataFrame:
    """``offender``: the least name of each part that facts and players fall into, ``fact:`` before ``type:``, so always that of a fact.

    A fact links its players to the least of them, so only players are the graph's nodes; the facts are named after it is cut into parts.
    """
    plays = roles.select("fact", "player").where("fact IS NOT NULL AND player IS NOT NULL")
    hubs = durable(plays.groupBy("fact").agg(F.min("player").alias("hub")), "pieces-hubs")
    links = plays.join(hubs, "fact").where("player <> hub").select(F.col("player").alias("src"), F.col("hub").alias("dst"))
    labels = components(links, hubs.select(F.col("hub").alias("node")))
    named = hubs.join(labels, F.col("hub") == F.col("node")).groupBy("component").agg(F.concat(F.lit("fact:"), F.min("fact")).alias("offender"))
    found = durable(named.select("offender"), "pieces")
    discard(hubs, labels)
    return found


def analyses_of(roles: DataFrame, asked: Sequence[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """``analysis, status, offenders`` of the analyses ``asked`` for of ``roles(fact, role, player)``: passed, violated, not_applicable or unevaluated.

    ``uniform`` takes one whole number and names the facts of another arity; ``connected`` names the parts that facts and players fall into by their least
    names, and is not applicable without facts.  What has no definition here, such as ``directed``, is unevaluated.
    """
    spark = roles.sparkSession
    if any(name == "connected" for name, _ in asked):  # read several times
        roles = durable(roles.select("fact", "role", "player"), "analysed")
    some, parts = not roles.isEmpty(), None
    for name, args in asked:
        none = F.array().cast("array<string>")
        if name == "uniform" and len(args) == 1 and args[0].isdigit():
            found, label = uniform(roles, int(args[0])).select(F.col("fact").alias("offender")), f"uniform({args[0]})"
            wrong = F.size("offenders") > 0
        elif name == "connected" and some:
            found, label = _pieces(roles), name
            wrong = F.size("offenders") > 1
        else:
            status = "not_applicable" if name == "connected" else "unevaluated"
            row = spark.range(1).select(F.lit(name).alias("analysis"), F.lit(status).alias("status"), none.alias("offenders"))
            parts = row if parts is None else parts.unionByName(row)
            continue
        listed = found.agg(F.sort_array(F.collect_list("offender")).alias("offenders"))
        row = listed.select(F.lit(label).alias("analysis"), F.when(wrong, "violated").otherwise("passed").alias("status"), F.when(wrong, F.col("offenders")).otherwise(none).alias("offenders"))
        parts = row if parts is None else parts.unionByName(row)
    return parts if parts is not None else spark.createDataFrame([], "analysis string, status string, offenders array<string>")


def objectified_order(roles: DataFrame, objectified: DataFrame) -> DataFrame:
    """``fact, needs, under``: the facts that must be there before each, as it is played by what objectifies them, those first that others need.

    ``roles(fact, role, player)`` and ``objectified(type, fact)``.  ``under`` is how many facts a needed one needs itself: always fewer than
    what needs it, so that order by it puts every fact after all that it needs.
    """
    uses = roles.join(objectified.select(F.col("type").alias("player"), F.col("fact").alias("needs")), "player").select(F.col("fact").alias("src"), F.col("needs").alias("dst")).distinct()
    reach = closure(uses)
    below = reach.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("under"))
    row = reach.join(below, "dst", "left").select(F.col("src").alias("fact"), F.col("dst").alias("needs"), F.coalesce("under", F.lit(0)).alias("under"))
    return row.orderBy("fact", "under", "needs")


def build_order(roles: DataFrame, objectified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fact, step`` and ``fact, cycle``: in which step each fact of ``roles(fact, role, player)`` can be built, after all that objectify its players, and those that need themselves.

    Facts of step 0 need no other.  The steps are the rounds of :func:`rolewise.operators.ancestry.levels`; no closure is made.
    """
    uses = roles.join(objectified.select(F.col("type").alias("player"), F.col("fact").alias("dst")), "player").select(F.col("fact").alias("src"), "dst")
    at, found = ancestry.levels(uses.unionByName(roles.select(F.col("fact").alias("src"), F.lit(None).cast(roles.schema["fact"].dataType).alias("dst"))))
    return at.select(F.col("node").alias("fact"), F.col("level").alias("step")), found.select(F.col("node").alias("fact"), "cycle")


#: The code, the referring relation and column, the relation referred to and its key.
REFERENCES = [
    ("OBJECTIFICATION_UNKNOWN_FACT", "objectified", "fact", "facts", "fact"),
    ("UNKNOWN_PLAYER", "roles", "player", "objects", "object"),
    ("ROLE_WRONG_FACT", "roles", "fact", "facts", "fact"),
    ("READING_UNKNOWN_FACT", "readings", "fact", "facts", "fact"),
    ("READING_UNKNOWN_ROLE_ID", "reading_roles", "role", "roles", "role"),
    ("CONSTRAINT_UNKNOWN_FACT", "constraints", "fact", "facts", "fact"),
    ("CONSTRAINT_UNKNOWN_ROLE", "constraint_roles", "role", "roles", "role"),
    ("SET_CONSTRAINT_UNKNOWN_TARGET", "set_constraints", "fact", "facts", "fact"),
    ("SET_CONSTRAINT_UNKNOWN_TARGET_ROLE", "set_constraint_roles", "role", "roles", "role"),
    ("CONSTRAINT_UNKNOWN_OBJECT", "object_constraints", "object", "objects", "object"),
    ("IDENTIFIER_UNKNOWN_FIELD_FACT", "identifier_fields", "fact", "facts", "fact"),
    ("SUBTYPE_UNKNOWN_TYPE", "subtypes", "object", "objects", "object"),
    ("FIELD_HINT_UNKNOWN_FACT", "field_hints", "fact", "facts", "fact"),
    ("FIELD_HINT_UNKNOWN_TYPE", "field_hint_types", "object", "objects", "object"),
    ("SAMPLE_UNKNOWN_FACT", "samples", "fact", "facts", "fact"),
]


def dangling(catalog: dict[str, DataFrame]) -> DataFrame:
    """``code, element, missing`` for every reference of a model's relations that leads nowhere.

    ``catalog`` maps relation names to DataFrames with an ``element`` and the referring columns; relations that it lacks are skipped.
    """
    found = None
    for code, relation, column, target, key in REFERENCES:
        if relation in catalog and target in catalog:
            refers = catalog[relation].where(F.col(column).isNotNull())
            lost = refers.alias("l").join(catalog[target].select(F.col(key).alias("_key")).distinct(), F.col(f"l.{column}") == F.col("_key"), "left_anti")
            rows = lost.select(F.lit(code).alias("code"), F.col("element"), F.col(column).alias("missing"))
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("the catalog has no relation that refers to another")
    return found.distinct()


def identity_coverage(elements: DataFrame) -> DataFrame:
    """Of ``elements(kind, id)``, by kind: how many there are, how many have an identity of their own, and the share."""
    stable = F.startswith(F.col("id"), F.concat(F.lit("uid:"), F.col("kind"), F.lit(":")))
    return elements.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(stable).alias("stable"), F.avg(stable.cast("double")).alias("coverage"))
