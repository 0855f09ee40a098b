import json
from dataclasses import replace

import pytest

from rolewise import queries
from rolewise.operators import audit
from rolewise.plans import catalog
from rolewise.plans import compile as plan
from rolewise.plans.model import Entity, Fact, Model, ModelError, Rule, Value, fingerprint, from_manifest, manifest, with_records

BEFORE = Model(
    "Team",
    values=(Value("Age", "Int", 0, 130), Value("Name", "String"), Value("Level", "String", allowed=("a", "b")), Value("Rank", "Int")),
    entities=(Entity("Person", ("name",), (("name", "Name", True), ("age", "Age", False), ("old", "Name", False))), Entity("Staff"), Entity("Team"), Entity("Gone")),
    facts=(Fact("Member", (("who", "Person"), ("team", "Team")), "Membership"), Fact("Dropped", (("x", "Person"),))),
    rules=(Rule("frequency", "Member", ("who",), low=0, high=3), Rule("mandatory", "Member", ("team",)), Rule("uniqueness", "Member", ("team",))),
    subtypes=(("Staff", "Person"),),
)
AFTER = Model(
    "Team",
    values=(Value("Age", "Int", 18, 130), Value("Name", "String"), Value("Level", "String", allowed=("a",)), Value("Rank", "Float")),
    entities=(Entity("Human", ("name",), (("name", "Name", True), ("age", "Age", True), ("new", "Name", False))), Entity("Staff"), Entity("Team")),
    facts=(Fact("Member", (("person", "Human"), ("team", "Team")), "Membership"), Fact("Added", (("x", "Human"),))),
    rules=(Rule("frequency", "Member", ("person",), low=0, high=2), Rule("mandatory", "Member", ("team",))),
    subtypes=(("Staff", "Human"),),
)


@pytest.mark.parametrize("model", [BEFORE, AFTER, queries.COMMERCE])
def test_round_trip(spark, model):
    assert catalog.decode(catalog.encode(spark, model), model.name) == model


def test_changes(spark):
    a, b = catalog.encode(spark, BEFORE), catalog.encode(spark, AFTER)
    hints = spark.createDataFrame([("object", "Person", "Human"), ("role", "Member.who", "Member.person")], "element string, before_name string, after_name string")
    got = {(r.kind, r.subject, r.safety) for r in catalog.changes(a, b, hints).collect()}
    assert got == {
        ("rename_object_type", "Human", "safe"), ("rename_role", "Member.person", "safe"), ("drop_object_type", "Gone", "destructive"), ("change_value_scalar", "Rank", "manual"),
        ("drop_fact", "Dropped", "destructive"), ("add_fact", "Added", "safe"), ("drop_role", "Dropped.x", "destructive"), ("add_role", "Added.x", "manual"),
        ("drop_field", "Human.old", "destructive"), ("add_field", "Human.new", "safe"), ("change_field_required", "Human.age", "requires_data_check"),
        ("drop_constraint", "uniqueness:Member(team)", "safe"), ("change_constraint", "frequency:Member(person)", "requires_data_check"),
        ("change_constraint", "Age", "requires_data_check"), ("change_constraint", "Level", "requires_data_check"),
    }
    assert catalog.changes(a, a).count() == 0
    plain = {(r.kind, r.subject) for r in catalog.changes(a, b).collect()}
    assert {("drop_object_type", "Person"), ("add_object_type", "Human"), ("change_subtype", "Staff")} <= plain
    phases = {r.kind: (r.phase, r.automatic) for r in catalog.steps(catalog.changes(a, b, hints)).collect()}
    assert phases["drop_fact"] == ("cleanup", False) and phases["add_fact"] == ("schema", True) and phases["change_constraint"] == ("constraints", False)


def test_preflight(spark):
    old = replace(BEFORE, rules=(), _by_name={})
    new = replace(BEFORE, rules=(Rule("uniqueness", "Member", ("who",)),), values=(Value("Age", "Int", 18, 130), *BEFORE.values[1:]), _by_name={})
    people = spark.createDataFrame([("p", "Ann", 17, None), ("q", "Bob", 40, None)], "id string, name string, age int, old string")
    member = spark.createDataFrame([("p", "t1"), ("p", "t2"), ("q", "t1")], "who string, team string")
    bound = plan.Binding({"Person": (people, "id", {"name": "name", "age": "age", "old": "old"})}, {"Member": member})
    got = {r.obligation_id: r.violations for r in catalog.preflight(old, new, bound).collect()}
    assert got == {"uniqueness:Member(who)": 1, "value:Person.age": 1}
    found = plan.violations(new, bound)
    shown = plan.evidence(found, member, "uniqueness:Member(who)", ["who"])
    assert {tuple(r) for r in shown.collect()} == {("p", "t1"), ("p", "t2")}
    sims = {(r.obligation_id, r.target): r.simulated for r in audit.simulated(plan.summary(new, found), audit.capabilities(spark)).collect()}
    assert sims["uniqueness:Member(who)", "postgres"] == "prevented" and sims["uniqueness:Member(who)", "spark"] == "realized"


def test_ddl_writes_and_refuses(spark):
    ddl = catalog.table_ddl(BEFORE, "Person")
    assert ddl == "CREATE TABLE `Person` (`name` STRING NOT NULL, `age` BIGINT, `old` STRING) USING parquet"
    spark.sql(ddl)
    try:
        spark.sql("INSERT INTO Person VALUES ('a', 1, NULL)")
        assert spark.table("Person").count() == 1
    finally:
        spark.sql("DROP TABLE Person")


def test_remaining_kinds_of_change_and_ambiguities(spark):
    old = replace(BEFORE, readings=(("Member", "{who} is in {team}"), ("Dropped", "{x} is")), _by_name={})
    new = replace(
        BEFORE, name="Club", facts=(Fact("Member", (("person", "Person"), ("team", "Team"))), Fact("Fresh", (("x", "Person"),), "Record")), rules=(Rule("mandatory", "Member", ("team",)), Rule("frequency", "Member", ("person",), low=0, high=3), Rule("uniqueness", "Member", ("team",))),
        entities=(Entity("Person", ("name",), (("name", "Name", True), ("age", "Age", False))), Entity("Staff"), Entity("Team", (), (("old", "Name", False),)), Entity("Guest")),
        readings=(("Member", "{person} is within {team}"), ("Fresh", "{x} is fresh")), _by_name={},
    )
    a, b = catalog.encode(spark, old), catalog.encode(spark, new)
    hints = spark.createDataFrame([("role", "Member.who", "Member.person"), ("field", "Person.old", "Team.old")], "element string, before_name string, after_name string")
    found = catalog.changes(a, b, hints).cache()
    assert {(r.kind, r.subject, r.safety) for r in found.collect()} == {
        ("rename_model", "Club", "safe"), ("rename_role", "Member.person", "safe"), ("move_field", "Team.old", "manual"), ("drop_objectification", "Member", "destructive"),
        ("drop_fact", "Dropped", "destructive"), ("drop_role", "Dropped.x", "destructive"), ("add_fact", "Fresh", "safe"), ("add_role", "Fresh.x", "manual"),
        ("add_object_type", "Guest", "safe"), ("drop_object_type", "Gone", "destructive"), ("change_reading", "Member", "safe"), ("drop_reading", "Dropped", "safe"), ("add_reading", "Fresh", "safe"),
    }
    assert {(r.kind, tuple(r.dropped), tuple(r.added)) for r in catalog.ambiguities(found, a, b).collect()} == {("entity", ("Gone",), ("Guest",)), ("fact", ("Dropped",), ("Fresh",))}


def test_operations(spark):
    hints = spark.createDataFrame([("object", "Person", "Human"), ("role", "Member.who", "Member.person")], "element string, before_name string, after_name string")
    rows = catalog.operations(spark, BEFORE, AFTER, hints).collect()
    got = [(r.phase, r.kind, r.target, r.subject, r.automatic) for r in rows]
    assert got[:4] == [("rename", "rename_table", "Human", "Person", True), ("rename", "rename_column", "Member", "who to person", True), ("create", "create_table", "Added", "", True), ("shape", "add_column", "Human", "new", True)]
    assert set(got[4:]) == {
        ("constraints", "add_check", "Human", "age: age BETWEEN 18 AND 130", False), ("constraints", "set_not_null", "Human", "age", False), ("foreign_keys", "add_foreign_key", "Added", "x: Human(name)", True),
        ("cleanup", "drop_column", "Human", "old", False), ("cleanup", "drop_table", "Dropped", "", False), ("cleanup", "drop_table", "Gone", "", False),
        ("manual", "drop_check", "Human", "age: age BETWEEN 0 AND 130", False), ("manual", "drop_unique", "Member", "team", False),
    }
    places = [catalog.PHASES.index(r.phase) for r in rows]
    assert places == sorted(places) and {r.safety for r in rows} == {"safe", "destructive", "manual", "requires_data_check"}
    assert catalog.operations(spark, AFTER, AFTER).count() == 0
    staged = replace(AFTER, entities=(*AFTER.entities[:2], Entity("Team", (), (("code", "Rank", True), ("note", "Name", False)))), _by_name={})
    assert [(r.kind, r.subject) for r in catalog.operations(spark, AFTER, staged).collect()] == [("add_column", "note"), ("add_column_staged", "code"), ("set_not_null_after_backfill", "code")]
    keyed = replace(AFTER, entities=(*AFTER.entities[:2], Entity("Team", ("code",), (("code", "Rank", True),))), _by_name={})
    assert {(r.kind, r.target) for r in catalog.operations(spark, AFTER, keyed).collect()} >= {("change_primary_key", "Team"), ("drop_foreign_key", "Member"), ("add_foreign_key", "Member"), ("change_column_type", "Member")}


def test_manifests_and_records(spark):
    model = replace(AFTER, readings=(("Member", "{person} is in {team}"),), samples=(("Added", ("x",)),), analyses=(("uniform", ("2",)),), _by_name={})
    again = from_manifest(json.loads(json.dumps(manifest(model))))
    assert again == model and fingerprint(again) == fingerprint(model) == fingerprint(replace(model, samples=(), _by_name={})) != fingerprint(AFTER)
    with pytest.raises(ModelError):
        from_manifest(manifest(model) | {"readings": [["Member", "{nobody}"]]})
    with pytest.raises(ModelError):
        from_manifest(manifest(model) | {"samples": [["Added", ["x", "y"]]]})
    paid = with_records(AFTER, {"Added": (("pay", "Rank", True),), "Member": (("since", "Rank", False),)})
    assert {f.name: f.objectified for f in paid.facts if f.objectified} == {"Added": "AddedRecord", "Member": "Membership"}
    assert {r.id for r in paid.rules} - {r.id for r in AFTER.rules} == {"uniqueness:AddedRecord__pay(owner)", "mandatory:AddedRecord__pay(owner)", "uniqueness:Membership__since(owner)"}
    with pytest.raises(ModelError):
        with_records(AFTER, {"Nothing": ()})


def test_ddl_of_all_tables(spark):
    model = replace(BEFORE, readings=(("Member", "{who} isn't out of {team}"),), rules=(*BEFORE.rules, Rule("uniqueness", "Member", ("who",))), _by_name={})
    made = catalog.ddl(model)
    assert made["Person"] == (
        "CREATE TABLE `Person` (`age` BIGINT, `name` STRING NOT NULL, `old` STRING) USING parquet TBLPROPERTIES ('rolewise.check.0'='age BETWEEN 0 AND 130', 'rolewise.primary.0'='(name)')"
    )
    assert made["Member"] == (
        "CREATE TABLE `Member` (`id` BIGINT NOT NULL, `team` BIGINT NOT NULL, `who` STRING NOT NULL) USING parquet COMMENT '{who} isn\\'t out of {team}' TBLPROPERTIES ('rolewise.foreign.0'='(team) Team(id)', "
        "'rolewise.foreign.1'='(who) Person(name)', 'rolewise.primary.0'='(id)', 'rolewise.unique.0'='(team)', 'rolewise.unique.1'='(who)', 'rolewise.unique.2'='(who, team)')"
    )
    assert set(made) == {"Person", "Staff", "Team", "Gone", "Member", "Dropped"}
    for name, text in made.items():
        spark.sql(text)
        kept = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES `{name}`").collect() if r.key.startswith("rolewise.")}
        spark.sql(f"DROP TABLE `{name}`")
        assert any(k.startswith("rolewise.primary") for k in kept)


def test_differences_and_plan_fingerprints(spark):
    a, b = catalog.encode(spark, BEFORE), catalog.encode(spark, AFTER)
    again = catalog.encode(spark, catalog.decode(a, BEFORE.name))
    assert catalog.differences(a, again).count() == 0
    assert {(r.relation, r.side) for r in catalog.differences(a, b).where("relation = 'objects'").collect()} == {("objects", "left"), ("objects", "right")}
    cases = audit.conformance_cases(spark, BEFORE, ["postgres"])
    one = audit.plan_fingerprint(cases)
    assert one == audit.plan_fingerprint(cases.orderBy("case_id").repartition(3)) and one != audit.plan_fingerprint(cases.where("family <> 'value'"))


def test_every_obligation_is_described(spark):
    from rolewise.operators import audit
    from rolewise.plans import portability

    for model, _ in portability.CORPUS.values():
        told = {r.obligation_id: r for r in audit.described(catalog.encode(spark, model)).collect()}
        wanted = {(o, k) for o, k, _ in audit.features(model) if k != "value"}
        assert wanted == {(o, r.kind) for o, r in told.items() if r.kind != "value"}
        assert all(r.reading.endswith(".") and len(r.recipe) > 1 and all(r.recipe) and r.params.startswith("{") for r in told.values())
    rules = spark.createDataFrame([("mandatory", "Works", ["who"], "", [], 0, None, 0), ("subset", "Boss", ["who"], "Works", ["who"], 0, None, 1), ("frequency", "Works", ["who"], "", [], 2, None, 2)], catalog.RELATIONS["rules"])
    roles = spark.createDataFrame([("Works", "who", 0, "Person")], catalog.RELATIONS["roles"])
    told = {r.obligation_id: r for r in audit.described({"rules": rules, "roles": roles}).collect()}
    assert told["mandatory:Works(who)"].reading == "Every Person takes part in Works as who."
    assert told["subset:Boss(who):Works(who)"].params == '{"left":"Boss(who)","right":"Works(who)"}'
    assert told["frequency:Works(who):2.."].reading == "In Works each who that is there at all is there 2 times or more." and told["frequency:Works(who):2.."].recipe[1] == "Fewer than 2 rows with it."
