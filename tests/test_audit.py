from rolewise.operators import audit


def test_every_obligation_and_target_has_an_outcome(spark):
    kinds = [("a", "mandatory", 2), ("b", "symmetric", 1), ("c", "unordered", 3), ("d", "player", 1), ("e", "uniqueness", 0)]
    summary = spark.createDataFrame(kinds, "obligation_id string, kind string, violations long")
    got = {(r.obligation_id, r.target): r.simulated for r in audit.simulated_all(summary, audit.capabilities(spark)).collect()}
    assert len(got) == 25 and {got["d", t] for _, t in got} == {"missing_capability_entry"}
    assert (got["a", "typedb"], got["a", "spark"], got["b", "mongo"], got["c", "postgres"], got["e", "graphql"]) == ("prevented", "realized", "realized", "prevented", "nothing_to_prevent")
