"""Every registered query of the rule engine against its SQL in DuckDB, and what the entry module offers."""

import duckdb
import pytest

import __spark_entry__
from rolewise import queries
from rolewise.plans import compile as plan

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, names):
    show = lambda x: repr(round(x, 6)) if isinstance(x, float) else repr(x)
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    answer = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(answer.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(answer.fetchall(), answer.columns)


def test_entry(spark):
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == len(plan.obligations(queries.COMMERCE)) and {r.status for r in rows} == {"holds", "violated"}


def test_mutation_of_a_rule_shows(spark):
    """Without the rule, its violations and no others are gone."""
    from dataclasses import replace

    found = queries._violations(spark, SF)
    weaker = replace(queries.COMMERCE, rules=tuple(r for r in queries.COMMERCE.rules if r.kind != "frequency"), _by_name={})
    left = plan.violations(weaker, queries.binding(spark, SF))
    lost = found.select("obligation_id").subtract(left.select("obligation_id"))
    assert {r.obligation_id for r in lost.distinct().collect()} == {"frequency:Contains(order):2..7"}
