"""Audit: verdicts on how targets keep a model's obligations, and on experiments with them.

Each is a join of small relations and a decision table written as a chain of conditions, in the order in which they apply.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolewise.plans.model import Model, Rule, Value

#: What each target does about each kind of obligation.  N: enforced natively, R: represented and not
#: enforced, M: kept as metadata only.  ``spark`` stands for Parquet with the rules of this library run over it.
CAPABILITIES = {
    "fact_set_semantics": {"postgres": "N", "mongo": "N", "typedb": "R", "graphql": "R", "spark": "R"},
    "uniqueness": {"postgres": "N", "mongo": "N", "typedb": "N", "graphql": "R", "spark": "R"},
    "uniqueness_composite": {"postgres": "N", "mongo": "N", "typedb": "R", "graphql": "R", "spark": "R"},
    "preferred_identifier": {"postgres": "N", "mongo": "N", "typedb": "N", "graphql": "R", "spark": "R"},
    "preferred_identifier_compound": {"postgres": "N", "mongo": "N", "typedb": "R", "graphql": "R", "spark": "R"},
    "mandatory_field": {"postgres": "N", "mongo": "N", "typedb": "N", "graphql": "N", "spark": "N"},
    "mandatory_fact": {"postgres": "R", "mongo": "R", "typedb": "N", "graphql": "R", "spark": "R"},
    "mandatory_fact_value": {"postgres": "R", "mongo": "R", "typedb": "R", "graphql": "R", "spark": "R"},
    "unordered_role_group": {"postgres": "N", "mongo": "N", "typedb": "R", "graphql": "R", "spark": "R"},
    "unordered_role_group_compound": {"postgres": "N", "mongo": "R", "typedb": "R", "graphql": "R", "spark": "R"},
    "frequency_max_one": {"postgres": "N", "mongo": "N", "typedb": "N", "graphql": "R", "spark": "R"},
    "frequency_max_one_other": {"postgres": "N", "mongo": "N", "typedb": "R", "graphql": "R", "spark": "R"},
    "frequency_from_zero": {"postgres": "R", "mongo": "R", "typedb": "N", "graphql": "R", "spark": "R"},
    "frequency": {"postgres": "R", "mongo": "R", "typedb": "R", "graphql": "R", "spark": "R"},
    "value": {"postgres": "N", "mongo": "N", "typedb": "N", "graphql": "R", "spark": "R"},
    "value_decimal_or_date": {"postgres": "N", "mongo": "R", "typedb": "N", "graphql": "R", "spark": "R"},
    "value_unused": {"postgres": "M", "mongo": "M", "typedb": "M", "graphql": "R", "spark": "M"},
    "subtype": {"postgres": "N", "mongo": "R", "typedb": "N", "graphql": "M", "spark": "R"},
    "subset": {"postgres": "R", "mongo": "R", "typedb": "R", "graphql": "R", "spark": "R"},
    "equality": {"postgres": "R", "mongo": "R", "typedb": "R", "graphql": "R", "spark": "R"},
    "exclusion": {"postgres": "R", "mongo": "R", "typedb": "R", "graphql": "R", "spark": "R"},
    "ring": {"postgres": "R", "mongo": "R", "typedb": "R", "graphql": "R", "spark": "R"},
    "reading": {"postgres": "M", "mongo": "M", "typedb": "M", "graphql": "M", "spark": "M"},
}
STATUS = {"N": "native_enforced", "R": "represented_not_enforced", "M": "metadata_only"}
ENFORCED, LOST = ["native_enforced", "emulated_enforced"], ["unsupported", "lossy_dropped"]
#: Kinds of which a violation is something that isn't there, or follows from what is.
ABSENT = ["mandatory", "subset", "equality", "ring", "subtype"]
VERDICTS = ["preserved_observed", "preserved_claimed", "weakened_observed", "weakened", "lost", "metadata_only", "claim_falsified", "unknown"]


def features(model: Model) -> list[tuple[str, str, str]]:
    """(obligation, kind, feature of :data:`CAPABILITIES`) of a model's own rules, by kind and id: how each is told to targets.

    A feature is chosen by the rule's shape: its number of roles, bounds, who plays, and how its players are identified.  A value type with a
    domain that nothing uses has an obligation of its own; that a role's players are members is no obligation but part of every target.
    """
    values, entities = {v.name: v for v in model.values}, {e.name: e for e in model.entities}

    def of_value(v: Value) -> str:
        return "value_decimal_or_date" if v.kind in ("Decimal", "Date", "Timestamp") else "value"

    def of_rule(r: Rule) -> str:
        one = len(r.roles) == 1
        if r.kind == "uniqueness":
            return "uniqueness" if one else "uniqueness_composite"
        player = model.player(r.fact, r.roles[0]) if r.roles else ""
        if r.kind == "mandatory":
            return "mandatory_fact_value" if player in values else "mandatory_fact"
        if r.kind == "frequency":
            if r.high == 1:
                return "frequency_max_one" if one and r.low == 0 else "frequency_max_one_other"
            return "frequency_from_zero" if one and r.low == 0 and player not in values else "frequency"
        if r.kind == "unordered":
            compound = player in entities and len(model.identifier(player)) > 1
            return "unordered_role_group_compound" if compound else "unordered_role_group"
        return "ring" if r.kind == "symmetric" else r.kind

    used = {of for e in model.entities for _, of, _ in e.fields} | {p for f in model.facts for _, p in f.roles}
    out = [(f"set:{f.name}", "fact_set_semantics", "fact_set_semantics") for f in model.facts]
    out += [(r.id, "ring" if r.kind == "symmetric" else "unordered_role_group" if r.kind == "unordered" else r.kind, of_rule(r)) for r in model.rules]
    for owner, name, of in [(e.name, f, of) for e in model.entities for f, of, _ in e.fields] + [(f.name, r, p) for f in model.facts for r, p in f.roles]:
        if of in values and (values[of].low is not None or values[of].allowed):
            out.append((f"value:{owner}.{name}", "value", of_value(values[of])))
    out += [(f"value:{v.name}", "value", "value_unused") for v in model.values if (v.low is not None or v.allowed) and v.name not in used]
    for e in model.entities:
        out += [(f"required:{e.name}.{f}", "mandatory", "mandatory_field") for f, _, required in e.fields if required]
        if e.identity:
            out.append((f"identifier:{e.name}", "preferred_identifier", "preferred_identifier" if len(e.identity) == 1 else "preferred_identifier_compound"))
    out += [(f"subtype:{a}<{b}", "subtype", "subtype") for a, b in model.subtypes]
    return sorted(out, key=lambda o: (o[1], o[0]))


def described(relations: dict[str, DataFrame]) -> DataFrame:
    """``obligation_id, kind, reading, params, recipe`` of every obligation that a model's relations state: what it says in words, its parts as JSON, and how to see whether a target keeps it.

    ``relations`` are those of :mod:`rolewise.plans.catalog`; ones that are missing state nothing.  Ids and kinds are those of :func:`features`.  Each relation is one pass of column expressions; only the players of mandatory roles are joined.
    """
    say, col, lit = F.format_string, F.col, F.lit
    listed = lambda c: F.array_join(c, ", ")
    refused, kept = lit("It is refused if the rule is kept."), lit("If it is taken the rule is not kept.")
    parts: list[DataFrame] = []

    def told(rows: DataFrame, id_: Column, kind: Column, reading: Column, params: Column, *recipe: Column) -> None:
        parts.append(rows.select(id_.alias("obligation_id"), kind.alias("kind"), reading.alias("reading"), F.to_json(params).alias("params"), F.array(*recipe).alias("recipe")))

    named = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    if "facts" in relations:
        told(relations["facts"], F.concat(lit("set:"), "name"), lit("fact_set_semantics"), say("%s holds of the same players once.", "name"), named(fact=col("name")), say("One row of %s.", "name"), lit("The same row again."), refused)
    if "rules" in relations:
        rules = relations["rules"].withColumns({"_left": say("%s(%s)", "fact", F.array_join("roles", ",")), "_right": say("%s(%s)", "other", F.array_join("other_roles", ","))})
        bounds = F.when(col("kind") == "frequency", F.concat(lit(":"), col("low").cast("string"), lit(".."), F.coalesce(col("high").cast("string"), lit("")))).otherwise("")
        id_ = F.concat("kind", lit(":"), "_left", F.when(col("other") != "", F.concat(lit(":"), "_right")).otherwise(""), bounds)
        of = lambda *kinds: rules.where(col("kind").isin(*kinds))
        roles, two, plain = listed("roles"), named(left=col("_left"), right=col("_right")), named(fact=col("fact"), roles=col("roles"))
        told(of("uniqueness"), id_, col("kind"), say("No two rows of %s agree in %s.", "fact", roles), plain, say("One row of %s.", "fact"), say("Another with the same %s and another player elsewhere.", roles), refused)
        most = F.when(col("high").isNull(), say("%d times or more", "low")).otherwise(say("%d to %d times", "low", "high"))
        counted = named(fact=col("fact"), roles=col("roles"), least=col("low"), most=col("high"))
        over = F.when(col("high").isNull(), say("Fewer than %d rows with it.", "low")).otherwise(say("%d rows with it that differ elsewhere.", F.coalesce(col("high") + 1, lit(0))))
        told(of("frequency"), id_, col("kind"), say("In %s each %s that is there at all is there %s.", "fact", roles, most), counted, say("One %s.", roles), over, refused)
        told(of("unordered"), id_, lit("unordered_role_group"), say("In %s the order of %s says nothing.", "fact", roles), plain, say("One row of %s with different players.", "fact"), lit("The same players the other way round."), refused)
        told(of("symmetric"), id_, lit("ring"), say("Whatever %s says of two it says the other way round.", "fact"), plain, say("One row of %s with different players, and not its reverse.", "fact"), kept)
        told(of("subset"), id_, col("kind"), say("All that is in %s is in %s.", "_left", "_right"), two, say("One in %s alone.", "_left"), kept)
        told(of("equality"), id_, col("kind"), say("%s and %s have the same in them.", "_left", "_right"), two, say("One in %s alone, or in %s alone.", "_left", "_right"), kept)
        told(of("exclusion"), id_, col("kind"), say("Nothing is in both %s and %s.", "_left", "_right"), two, say("The same in %s and in %s.", "_left", "_right"), kept)
        if "roles" in relations:
            player = relations["roles"].select(col("fact").alias("_fact"), col("name").alias("_role"), "player")
            due = of("mandatory").withColumn("role", F.get("roles", lit(0))).join(player, (col("fact") == col("_fact")) & (col("role") == col("_role")))
            told(due, id_, col("kind"), say("Every %s takes part in %s as %s.", "player", "fact", "role"), named(fact=col("fact"), role=col("role"), player=col("player")), say("A %s.", "player"), say("No row of %s with it as %s.", "fact", "role"), kept)
    if "domains" in relations:
        domains, ranged = relations["domains"], col("low").isNotNull()
        within = F.when(ranged, say("from %s to %s", "low", "high")).otherwise(F.concat(lit("one of "), listed("allowed")))
        told(domains, F.concat(lit("value:"), "value"), lit("value"), say("A %s is %s.", "value", within), named(value_type=col("value"), low=col("low"), high=col("high"), allowed=F.when(~ranged, col("allowed"))), say("A %s that is not.", "value"), refused)
    if "fields" in relations:
        fields, owned = relations["fields"], F.concat_ws(".", "owner", "name")
        told(fields.where("required"), F.concat(lit("required:"), owned), lit("mandatory"), say("Every %s has a %s.", "owner", "name"), named(owner=col("owner"), field=col("name")), say("A %s without a %s.", "owner", "name"), refused)
        ids = fields.where("identifying IS NOT NULL").groupBy("owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("identifying", "name"))), lambda x: x["name"]).alias("names"))
        told(ids, F.concat(lit("identifier:"), "owner"), lit("preferred_identifier"), say("A %s is known by its %s.", "owner", listed("names")), named(owner=col("owner"), fields=col("names")), say("Two %s with the same %s.", "owner", listed("names")), refused)
    if "subtypes" in relations:
        told(relations["subtypes"], say("subtype:%s<%s", "sub", "sup"), lit("subtype"), say("Every %s is a %s.", "sub", "sup"), named(subtype=col("sub"), supertype=col("sup")), say("A %s that is no %s.", "sub", "sup"), kept)
    if not parts:
        raise ValueError("the relations state no obligation")
    return reduce(DataFrame.unionByName, parts)


def of_model(spark: SparkSession, model: Model, targets: Sequence[str], cases: DataFrame | None = None, live: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """:func:`verdicts` of every obligation of a model, with its ``kind`` and ``feature``; evidence that isn't given is none."""
    known = spark.createDataFrame(features(model), "obligation_id string, kind string, feature string")
    none = lambda ddl: spark.createDataFrame([], ddl)
    cases = cases if cases is not None else none("obligation_id string, target string, case_id string, runtime boolean")
    live = live if live is not None else none("target string, case_id string, passed boolean")
    shared = shared if shared is not None else none("obligation_id string, target string, passed boolean")
    return known.join(verdicts(known.drop("kind"), capabilities(spark), cases, live, shared, targets), "obligation_id")


def mutated(declared: DataFrame, mutations: DataFrame) -> DataFrame:
    """``mutation_id`` with the capabilities of ``declared`` after it: the ``feature`` that it takes from its ``target`` is represented and no longer enforced."""
    each = mutations.select("mutation_id", F.col("target").alias("_target"), F.col("feature").alias("_feature"))
    of_target = declared.join(each, F.col("target") == F.col("_target"))
    weaker = F.when((F.col("feature") == F.col("_feature")) & F.col("status").isin(ENFORCED), "represented_not_enforced").otherwise(F.col("status"))
    return of_target.select("mutation_id", "feature", "target", weaker.alias("status"))


#: The enforcement that each experiment takes from a target.
MUTATIONS = [
    ("postgres_fact_key", "postgres", "fact_set_semantics"), ("postgres_check", "postgres", "value"), ("mongo_unique_index", "mongo", "uniqueness"),
    ("mongo_validator", "mongo", "mandatory_field"), ("typedb_card", "typedb", "mandatory_fact"), ("typedb_key", "typedb", "preferred_identifier"),
]


def expected_writes(rows: DataFrame) -> DataFrame:
    """``rows(obligation_id, kind, target, status, lowered)`` and what writing a violating population should do there (``expected``), and whether the

    state afterwards must be looked at (``needs_post_state``), as what is wrong is an absence or an entailment.
    """
    weak = F.col("status") == "represented_not_enforced"
    expected = F.when(~F.col("lowered"), "not_executable").when(F.col("status").isin(ENFORCED), "prevented").when(weak, "realized").otherwise("not_asserted")
    needs = F.col("kind").isin(ABSENT) & (expected == "realized")
    return rows.withColumn("expected", expected).withColumn("needs_post_state", needs)


def post_state(found: DataFrame, obligations: DataFrame) -> DataFrame:
    """``obligation_id, n, post_state``: how many keys of a written population violate each of the ``obligations(obligation_id)``, and whether any does."""
    n = found.groupBy("obligation_id").agg(F.count(F.lit(1)).alias("n"))
    row = obligations.select("obligation_id").join(n, "obligation_id", "left").fillna(0, ["n"])
    return row.withColumn("post_state", F.col("n") > 0)


def static_results(rows: DataFrame) -> DataFrame:
    """``target, n, all_passed`` of structural results ``rows(target, passed)``; a target without any has not passed."""
    return rows.groupBy("target").agg(F.count("passed").alias("n"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"))


def capabilities(spark) -> DataFrame:
    """``feature, target, status`` of :data:`CAPABILITIES`."""
    rows = [(f, t, STATUS[s]) for f, by in CAPABILITIES.items() for t, s in by.items()]
    return spark.createDataFrame(rows, "feature string, target string, status string")


def verdicts(obligations: DataFrame, declared: DataFrame, cases: DataFrame, live: DataFrame, shared: DataFrame, targets: Sequence[str]) -> DataFrame:
    """The verdict, evidence level and evidence source of every obligation for each of the ``targets``.

    ``obligations(obligation_id, feature)``, ``declared(feature, target, status)``, ``cases(obligation_id, target, case_id,
    runtime)``, ``live(target, case_id, passed)`` and ``shared(obligation_id, target, passed)``, where a null ``passed``
    in ``shared`` is a proof that is still pending.  An observed verdict needs a passing result for every runtime case; one failure
    falsifies a claim of enforcement.
    """
    at = Window.partitionBy("obligation_id", "target").orderBy("status")
    capable = obligations.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    capable = capable.join(declared, ["feature", "target"], "left").withColumn("_rank", F.row_number().over(at)).where("_rank = 1")
    seen = cases.join(live, ["target", "case_id"], "left").groupBy("obligation_id", "target").agg(
        F.count_if("runtime").alias("n_runtime"),
        F.count_if(F.col("runtime") & F.col("passed").isNotNull()).alias("n_live"),
        F.count_if(F.col("runtime") & F.col("passed")).alias("n_passed"),
        F.count_if(~F.col("runtime")).alias("n_structural"),
    )
    proof = shared.select("obligation_id", "target", F.col("passed").alias("proved"), F.lit(True).alias("has_proof"))
    row = capable.join(seen, ["obligation_id", "target"], "left").join(proof, ["obligation_id", "target"], "left").fillna(0, ["n_runtime", "n_live", "n_passed", "n_structural"])
    status, n = F.col("status"), F.col
    complete = (n("n_runtime") > 0) & (n("n_live") == n("n_runtime"))
    passed = (n("n_live") > 0) & (n("n_passed") == n("n_live"))
    failed = (n("n_live") > 0) & ~passed
    legacy = (
        F.when(status.isNull(), "unknown")
        .when(status.isin(LOST), "lost")
        .when(status == "metadata_only", "metadata_only")
        .when(status == "represented_not_enforced", F.when(complete & passed, "weakened_observed").otherwise("weakened"))
        .when(status.isin(ENFORCED), F.when(complete & passed, "preserved_observed").when(failed, "claim_falsified").otherwise("preserved_claimed"))
        .otherwise("unknown")
    )
    by_shared = F.when(
        F.col("has_proof") & status.isNotNull(),
        F.when(~F.col("proved"), "claim_falsified").when(F.col("proved") & status.isin(ENFORCED), "preserved_observed").when(F.col("proved") & (status == "represented_not_enforced"), "weakened_observed"),
    )
    observed = (n("n_live") > 0) & (complete | (legacy == "claim_falsified"))
    source = (
        F.when(by_shared.isNotNull(), "shared_semantic_witness")
        .when(observed, "legacy_target_witness")
        .when(n("n_runtime") > 0, "generated_target_witness")
        .when(n("n_structural") > 0, "structural")
        .when(status.isNotNull(), "capability_declaration")
        .otherwise("none")
    )
    level = F.when(source.isin("shared_semantic_witness", "legacy_target_witness"), "live_observed").when(source == "generated_target_witness", "witness_tested").when(source == "structural", "structurally_checked").when(source == "capability_declaration", "declared").otherwise("none")
    return row.select("obligation_id", "target", F.coalesce("status", F.lit("missing_capability_entry")).alias("status"), F.coalesce(by_shared, legacy).alias("preservation"), level.alias("evidence_level"), source.alias("evidence_source"))


def verdict_summary(rows: DataFrame) -> DataFrame:
    """For each target the number of obligations and of each verdict."""
    counts = [F.count_if(F.col("preservation") == v).alias(v) for v in VERDICTS]
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("obligations"), *counts, F.count_if(F.col("evidence_level") == "live_observed").alias("live_observed"))


def coverage(declared: DataFrame, cases: DataFrame) -> DataFrame:
    """By target: natively enforced features of ``declared``, and how many of them a case of ``cases(target, feature)`` covers."""
    native = declared.where(F.col("status") == "native_enforced").select("target", "feature").distinct()
    covered = cases.select("target", "feature").distinct().withColumn("_case", F.lit(True))
    return native.join(covered, ["target", "feature"], "left").groupBy("target").agg(F.count(F.lit(1)).alias("native"), F.count("_case").alias("covered"), F.bool_and(F.coalesce("_case", F.lit(False))).alias("complete"))


def cases_of(obligations: DataFrame, cases: DataFrame) -> DataFrame:
    """``obligation_id`` with each of ``cases(target, case_id, runtime, elements)`` that shares a source element with it.

    ``obligations(obligation_id, elements)`` and ``cases`` name the elements of the model that they come from, as arrays.
    """
    one = obligations.select("obligation_id", F.explode("elements").alias("element"))
    other = cases.select("target", "case_id", "runtime", F.explode("elements").alias("element"))
    return one.join(other, "element").select("obligation_id", "target", "case_id", "runtime").distinct()


#: The family of conformance cases for a feature that a target enforces, and for one that it only represents.
FAMILIES = {
    "fact_set_semantics": ("fact-set", "gap-set"), "uniqueness": ("unique", "gap-set"), "uniqueness_composite": ("unique", "gap-set"), "preferred_identifier": ("preferred-id", "gap-set"), "preferred_identifier_compound": ("preferred-id", "gap-set"),
    "mandatory_field": ("mandatory", "gap-mandatory"), "mandatory_fact": ("mandatory", "gap-mandatory"), "mandatory_fact_value": ("mandatory", "gap-mandatory"), "unordered_role_group": ("unordered", "gap-set"), "unordered_role_group_compound": ("unordered", "gap-set"),
    "frequency_max_one": ("frequency", "gap-frequency"), "frequency_max_one_other": ("frequency", "gap-frequency"), "frequency_from_zero": ("frequency", "gap-frequency"), "frequency": ("frequency", "gap-frequency"),
    "value": ("value", "gap-set"), "value_decimal_or_date": ("value", "gap-set"), "subtype": ("subtype", "gap-set"), "subset": ("set", "gap-set"), "equality": ("set", "gap-set"), "exclusion": ("set", "gap-set"), "ring": ("ring", "gap-ring"),
}


def conformance_cases(spark: SparkSession, model: Model, targets: Sequence[str]) -> DataFrame:
    """``obligation_id, target, case_id, family, runtime, expected``: what to try on each target for each of a model's rules.

    A rule that the target enforces has a valid population, to be accepted, and a violating one, to be refused, of its own family; one that it only
    represents has a probe of the gap, which is accepted.  What is kept as metadata alone has a structural check and nothing to run.
    """
    known = spark.createDataFrame(features(model), "obligation_id string, kind string, feature string")
    named = spark.createDataFrame([(f, *both) for f, both in FAMILIES.items()], "feature string, native string, gap string")
    row = known.join(capabilities(spark).where(F.col("target").isin(*targets)), "feature").join(named, "feature", "left")
    status = F.col("status")
    case = lambda suffix, family, runtime, expected: F.struct(F.lit(suffix).alias("suffix"), family.alias("family"), F.lit(runtime).alias("runtime"), F.lit(expected).alias("expected"))
    tried = (
        F.when(status.isin(ENFORCED), F.array(case("valid", F.col("native"), True, "accepted"), case("violating", F.col("native"), True, "refused")))
        .when(status == "represented_not_enforced", F.array(case("gap", F.col("gap"), True, "accepted")))
        .otherwise(F.array(case("structure", F.lit("structure-field"), False, "present")))
    )
    each = row.select("obligation_id", "target", F.inline(tried))
    return each.select("obligation_id", "target", F.concat_ws("/", "target", "obligation_id", "suffix").alias("case_id"), "family", "runtime", "expected")


def plan_fingerprint(cases: DataFrame) -> str:
    """SHA-256 of a plan of cases, in whatever order they come: evidence is only taken for the plan that it was made with.  A row for each case of a model."""
    row = F.sha2(F.to_json(F.struct(*sorted(cases.columns)), {"ignoreNullFields": "false"}), 256)
    return cases.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ","), 256)).first()[0]


def write_outcome(cases: DataFrame) -> DataFrame:
    """``cases`` with the ``observed`` verdict and ``level`` of writing a violating population to a target.

    Columns: ``kind, status, lowered, outcome`` (prevented or realized), ``post_state`` (true: the violation stands, null:
    pending) and ``isolated``.  A refusal of a witness that also breaks other rules says nothing about this one.
    """
    expected = F.when(F.col("status").isin(ENFORCED), "prevented").when(F.col("status") == "represented_not_enforced", "realized").otherwise("not_asserted")
    needs = F.col("kind").isin(ABSENT) & (expected == "realized")
    outcome, state = F.col("outcome"), F.col("post_state")
    level = (
        F.when(~F.col("lowered"), "not_executable")
        .when((outcome == "prevented") & ~F.col("isolated"), "prevention_not_attributable")
        .when(outcome == "prevented", "prevented")
        .when((outcome == "realized") & needs & state.isNull(), "post_state_pending")
        .when(outcome == "realized", "realized")
        .otherwise("not_observed")
    )
    observed = F.when(level == "prevented", "preserved_or_stronger").when(level == "realized", F.when(needs & ~state, "preserved_or_stronger").otherwise("weakened"))
    return cases.withColumn("expected", expected).withColumn("level", level).withColumn("observed", observed)


def refined(observations: DataFrame, probes: DataFrame) -> DataFrame:
    """``observations(obligation_id, observed)`` refined by probes of valid populations, ``probes(obligation_id, accepted)``."""
    seen = probes.groupBy("obligation_id").agg(F.count(F.lit(1)).alias("n"), F.count("accepted").alias("n_seen"), F.count_if("accepted").alias("n_ok"))
    row = observations.join(seen, "obligation_id", "left")
    rejected, whole = F.col("n_seen") > F.col("n_ok"), (F.col("n") > 0) & (F.col("n_ok") == F.col("n"))
    verdict = (
        F.when(F.col("observed") == "weakened", "weakened")
        .when(F.coalesce(F.col("observed") != "preserved_or_stronger", F.lit(True)), F.lit(None))
        .when(rejected, "stronger_or_incompatible")
        .when(whole, "preserved_on_tested_cases")
        .otherwise("preserved_or_stronger")
    )
    return row.select("obligation_id", "observed", verdict.alias("refined"))


def mutation_outcome(experiments: DataFrame, affected: DataFrame) -> DataFrame:
    """What removing an enforcement shows: ``mutation_id, status``.

    ``experiments(mutation_id, baseline_completed, baseline_passed, mutated_completed)`` and ``affected(mutation_id, case_id,
    passed)`` with null where the mutated run lacks the case.
    """
    seen = affected.groupBy("mutation_id").agg(F.count_if(F.col("passed").isNull()).alias("lacking"), F.count_if(~F.col("passed")).alias("flipped"))
    row = experiments.join(seen, "mutation_id", "left")
    status = (
        F.when(~F.col("baseline_completed"), "not_observed")
        .when(~F.col("baseline_passed"), "invalid_baseline")
        .when(~F.col("mutated_completed"), "not_observed")
        .when(F.col("lacking") > 0, "failed")
        .when(F.coalesce("flipped", F.lit(0)) == 0, "survived_mutation")
        .otherwise("mutation_detected")
    )
    return row.select("mutation_id", status.alias("status"))


def trust(attestations: DataFrame, keys: DataFrame, rules: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Whether each protected revision has enough accepted signatures: ``revision, required, accepted, passed``.

    ``attestations(revision, key_id, valid)``, ``keys(key_id, status)``, ``rules(revision, required, allowed)`` where an empty ``allowed``
    array allows every trusted key.  With ``sets(allowed, key_id)``, ``allowed`` is the name of a set of keys instead, null for every one, so that a set that many rules
    share is stated once and no row carries it.
    """
    signed = attestations.where("valid").join(keys.where(F.col("status") == "trusted").select("key_id"), "key_id").select("revision", "key_id")
    row = rules.join(signed, "revision", "left")
    if sets is None:
        within = (F.size("allowed") == 0) | F.array_contains("allowed", F.col("key_id"))
    else:
        row = row.join(sets.select("allowed", "key_id").distinct().withColumn("_in", F.lit(True)), ["allowed", "key_id"], "left")
        within = F.col("allowed").isNull() | F.col("_in")
    return row.groupBy("revision", "required").agg(F.count_if(F.col("key_id").isNotNull() & within).alias("accepted")).withColumn("passed", F.col("accepted") >= F.col("required"))


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by the given columns, as ``n``: by status, by target and status, and so on."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def simulated(summary: DataFrame, declared: DataFrame) -> DataFrame:
    """What each target would do with a population whose violations are ``summary(obligation_id, kind, violations)``.

    A simulation from the declared capabilities (``feature, target, status``), never evidence from a running target: a violated
    obligation is prevented where it is enforced and realized where it is only represented.
    """
    joined = summary.select("obligation_id", "kind", "violations").join(declared, F.col("kind") == F.col("feature"))  # one row for each feature and target
    outcome = F.when(F.col("violations") == 0, "nothing_to_prevent").when(F.col("status").isin(ENFORCED), "prevented").when(F.col("status") == "represented_not_enforced", "realized").otherwise("not_asserted")
    return joined.select("obligation_id", "target", "violations", outcome.alias("simulated"))


#: The feature of a kind of obligation that isn't named as its feature.
FEATURE_OF = {"mandatory": "mandatory_fact", "symmetric": "ring", "unordered": "unordered_role_group"}


def simulated_all(summary: DataFrame, declared: DataFrame) -> DataFrame:
    """As :func:`simulated`, for every obligation and every target of ``declared``.

    Kinds are mapped to features by :data:`FEATURE_OF`; what a target declares nothing about is ``missing_capability_entry``.
    """
    feature = F.col("kind")
    for kind, name in FEATURE_OF.items():
        feature = F.when(F.col("kind") == kind, name).otherwise(feature)
    targets = sorted(r.target for r in declared.select("target").distinct().collect())
    every = summary.select("obligation_id", "violations", feature.alias("feature"), F.explode(F.lit(targets)).alias("target"))
    joined = every.join(declared, ["feature", "target"], "left")
    outcome = (
        F.when(F.col("status").isNull(), "missing_capability_entry")
        .when(F.col("violations") == 0, "nothing_to_prevent")
        .when(F.col("status").isin(ENFORCED), "prevented")
        .when(F.col("status") == "represented_not_enforced", "realized")
        .otherwise("not_asserted")
    )
    return joined.select("obligation_id", "target", "violations", outcome.alias("simulated"))
