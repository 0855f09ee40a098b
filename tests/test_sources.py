import json

import pytest
from pyspark.sql import functions as F

from rolewise.functions import scalar
from rolewise.operators import graph, rules
from rolewise.sources import tables
from rolewise.streaming.monitor import monitor


def test_population_json(spark, tmp_path):
    path = tmp_path / "population.json"
    path.write_text(json.dumps({
        "memberships": [{"object_type_id": "Person", "object_type": "Person", "instances": ["p1", "p2"]}],
        "values": [{"instance_id": "v1", "value_type_id": "Age", "literal": "7"}],
        "facts": [{"fact_type_id": "Knows", "rows": [["p1", "p2"], ["p2", "p1"], ["p1"]]}],
        "objectifications": [{"instance_id": "k1", "object_type_id": "Knowing", "fact_type_id": "Knows", "row_index": 5}],
    }))
    p = tables.population(spark, str(path))
    assert p["memberships"].count() == 2 and p["values"].first().literal == "7"
    knows = tables.fact_columns(p["facts"], "Knows", ["a", "b"])
    assert {(r.row_index, r.a, r.b) for r in knows.collect()} == {(0, "p1", "p2"), (1, "p2", "p1")}
    assert [(r.row_index, r.n) for r in rules.arity(p["facts"], spark.createDataFrame([("Knows", 2)], "fact string, arity int")).collect()] == [(2, 1)]
    assert rules.objectification_occurrence(p["objectifications"], p["facts"]).count() == 1
    tables.write_population(p, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "facts")).where("fact = 'Knows'").count() == 3


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_formats(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    df.write.format(kind).save(str(tmp_path / kind))
    assert sorted(map(tuple, tables.read(spark, str(tmp_path / kind), kind, "id long, name string").collect())) == [(1, "a"), (2, None)]


def test_snapshots(spark):
    a = tables.snapshot(spark.createDataFrame([], "x long, y string, z int"), "t")
    b = tables.snapshot(spark.createDataFrame([], "x long, y int, w int"), "t")
    assert {(r.column, r.problem) for r in tables.compare_snapshots(a, b).collect()} == {("y", "different"), ("z", "missing"), ("w", "unexpected")}


def test_monitor(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, 50)], "id long, v long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in"))
    done = monitor(stream, lambda b: rules.value_range(b, "v", 0, 10, "Int"), str(tmp_path / "out"), str(tmp_path / "state"))
    done.awaitTermination(60)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_ids(spark):
    df = spark.createDataFrame([("a:b%c", "HTTPServerName x")], "raw string, name string")
    explicit = scalar.explicit_id("entity", F.col("raw"))
    r = df.select(scalar.stable_id("fact", F.col("raw")).alias("s"), explicit.alias("e"), scalar.explicit_token("entity", explicit).alias("t"), scalar.explicit_token("fact", explicit).alias("n"), scalar.slug(F.col("name")).alias("g"), scalar.placeholders(F.lit("{x} works for {y_1}")).alias("p"), scalar.normal_check(F.lit("((Age)::INTEGER >  0)")).alias("c")).first()
    assert (r.s, r.e, r.t, r.n, r.g, r.p, r.c) == ("fact:a%3Ab%25c", "uid:entity:a%3Ab%25c", "a:b%c", None, "http_server_name_x", ["x", "y_1"], "age>0")


def test_graph_cycles_and_chains(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100)]
    df = spark.createDataFrame(chain, "src long, dst long")
    labels = {r.node: r.component for r in graph.components(df, spark.createDataFrame([(500,)], "node long")).collect()}
    assert labels[60] == 0 and labels[101] == 100 and labels[500] == 500
    assert {r.node for r in graph.cycles(df.where("src >= 100"), 5).collect()} == {100, 101}


def _population(path, **changed):
    said = {"row_count": 2, "model_sha256": "abc", "facts": [{"fact_type_id": "Knows", "rows": [["p1", "p2"], ["p2", "p1"]]}], "memberships": [], "values": [], "objectifications": []} | changed
    path.write_text(json.dumps(said))
    return str(path)


@pytest.mark.parametrize(
    "changed, said",
    [
        ({"row_count": 3}, "announced"),
        ({"model_sha256": "other"}, "another model"),
        ({"facts": [{"fact_type_id": "Knows", "rows": [["p1"], ["p2", "p1"]]}]}, "wrong number"),
        ({"facts": [{"fact_type_id": "Nothing", "rows": [["p1", "p2"], ["p2", "p1"]]}]}, "no fact Nothing"),
        ({"facts": [{"fact_type_id": "Knows", "rows": [["p1", "p2"]]}, {"fact_type_id": "Knows", "rows": [["p2", "p1"]]}]}, "more than one block"),
    ],
)
def test_populations_that_are_refused(spark, tmp_path, changed, said):
    whole = tables.checked_population(spark, _population(tmp_path / "a.json"), {"Knows": 2}, "abc")
    assert whole["facts"].count() == 2
    with pytest.raises(tables.SourceError, match=said):
        tables.checked_population(spark, _population(tmp_path / "b.json", **changed), {"Knows": 2}, "abc")


def test_evidence_is_taken_for_its_own_model_and_plan_only(spark, tmp_path):
    identity = {"model_sha256": "m", "case_plan_sha256": "c"}
    results = spark.createDataFrame([("o1", True), ("o2", None)], "obligation_id string, passed boolean")
    path = str(tmp_path / "postgres")
    tables.write_evidence(results, path, "postgres", identity)
    assert {tuple(r) for r in tables.evidence(spark, path, "postgres", identity).collect()} == {("o1", "postgres", True), ("o2", "postgres", None)}
    for target, other in (("mongo", identity), ("postgres", identity | {"model_sha256": "x"}), ("postgres", identity | {"case_plan_sha256": "x"})):
        with pytest.raises(tables.SourceError):
            tables.evidence(spark, path, target, other)
    for results, count in (([("o", "postgres", True), ("o", "postgres", True)], 2), ([("o", "mongo", True)], 1), ([("o", None, True)], 2), ([(None, None, True)], 1)):
        one = (tables.EVIDENCE_FORMAT, "postgres", "m", "c", "completed", count, results)
        spark.createDataFrame([one], tables.EVIDENCE).write.mode("overwrite").json(path + "x")
        with pytest.raises(tables.SourceError):
            tables.evidence(spark, path + "x", "postgres", identity)


def test_fixtures_keys_and_bundles(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"format": "f", "setup": [{"op": "insert", "collection": "person", "document": {"name": "Ann"}}]}))
    assert [(r.collection, json.loads(r.document)) for r in tables.fixture(spark, str(tmp_path / "f.json")).collect()] == [("person", {"name": "Ann"})]
    (tmp_path / "g.json").write_text(json.dumps({"format": "f", "setup": [{"op": "drop", "collection": "person"}]}))
    with pytest.raises(tables.SourceError):
        tables.fixture(spark, str(tmp_path / "g.json"))
    ddl = "table string, kind string, columns array<string>, text string"
    a = spark.createDataFrame([("t", "primary", ["id"], ""), ("t", "check", ["n"], "((n)::INTEGER >  0)"), ("t", "unique", ["x"], "")], ddl)
    b = spark.createDataFrame([("t", "primary", ["id"], ""), ("t", "check", ["n"], "n > 0"), ("t", "foreign", ["x"], "u(id)")], ddl)
    assert {(r.kind, r.problem) for r in tables.compare_keys(a, b).collect()} == {("unique", "missing"), ("foreign", "unexpected")}
    tables.write_bundle({"a": a, "b": b}, str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle" / "a")).count() == 3 and [r.relation for r in spark.read.json(str(tmp_path / "bundle" / "index")).orderBy("relation").collect()] == ["a", "b"]


def test_keys_of_a_scanned_catalogue(spark):
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    constraints = make([("a", "pk", "PRIMARY KEY"), ("a", "u", "unique"), ("b", "fk", "FOREIGN KEY"), ("b", "ck", "CHECK"), ("b", "nn", "CHECK"), ("b", "ck", "CHECK"), ("c", "none", "UNIQUE")], "table string, name string, kind string")
    columns = make([("a", "pk", "y", 2, None, None), ("a", "pk", "x", 1, None, None), ("a", "u", "z", 1, None, None), ("b", "fk", "q", 2, "a", "y"), ("b", "fk", "p", 1, "a", "x")], "table string, name string, column string, ordinal int, target_table string, target_column string")
    checks = make([("b", "ck", "((size >= 1))"), ("b", "nn", '"p" IS NOT NULL')], "table string, name string, text string")
    found = tables.scanned_keys(constraints, columns, checks)
    assert {(r.table, r.kind, tuple(r.columns), r.text) for r in found.collect()} == {
        ("a", "primary_key", ("x", "y"), ""), ("a", "unique", ("z",), ""), ("b", "foreign_key", ("p", "q"), "a(x,y)"), ("b", "check", (), "((size >= 1))"), ("c", "unique", (), ""),
    }
    other = make([("a", "primary_key", ["x", "y"], ""), ("a", "unique", ["w"], ""), ("b", "foreign_key", ["p", "q"], "a(x,y)"), ("b", "check", [], "SIZE>=1"), ("c", "unique", [], "")], "table string, kind string, columns array<string>, text string")
    assert {(r.kind, tuple(r.columns), r.problem) for r in tables.compare_keys(found, other).collect()} == {("unique", ("z",), "missing"), ("unique", ("w",), "unexpected")}
