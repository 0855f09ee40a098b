"""Registered queries over two versions of a model with thousands of elements that the test tables state, each with its DuckDB SQL.

Parts are entities with a field each, customers are value types, and orders are facts with a role, some with a rule or a reading.  Afterwards some are gone, new or otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.operators import audit, evolution, facts, graph
from rolewise.plans import catalog, structure
from rolewise.queries import query
from rolewise.sources.tables import scanned_keys as scan
from rolewise.sources.tables import table


def _text(prefix: str, number: str):
    return F.concat(F.lit(prefix), F.expr(number).cast("string"))


def versions(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    parts, customers, orders = (table(spark, d, t) for t in ("part", "customer", "orders"))
    null = lambda kind: F.lit(None).cast(kind)

    def made(after: bool) -> dict[str, DataFrame]:
        then = lambda condition, new, old: F.when(F.expr(condition), F.expr(new)).otherwise(F.expr(old)) if after else F.expr(old)
        kept = lambda df, condition: df.where(condition) if after else df
        some, stated = kept(parts, "p_partkey % 17 <> 0"), kept(orders, "o_orderkey % 37 <> 0")
        objects = some.select(_text("P", "p_partkey").alias("name"), F.lit("entity").alias("kind"), null("string").alias("scalar"))
        objects = objects.unionByName(customers.select(_text("V", "c_custkey").alias("name"), F.lit("value").alias("kind"), then("c_custkey % 19 = 0", "'String'", "'Int'").alias("scalar")))
        if after:
            objects = objects.unionByName(parts.where("p_partkey % 31 = 0").select(_text("N", "p_partkey").alias("name"), F.lit("entity").alias("kind"), null("string").alias("scalar")))
        fact, roles = _text("F", "o_orderkey"), F.array(F.lit("r"))
        none = F.array().cast("array<string>")
        low, high = "int(o_custkey % 3)", "int(5 + o_custkey % 4)"
        ruled = kept(stated.where("o_orderkey % 3 = 0"), "o_orderkey % 43 <> 0")
        return {
            "model": spark.createDataFrame([("M2" if after else "M",)], "name string"),
            "objects": objects,
            "fields": kept(some, "p_partkey % 23 <> 0").select(_text("P", "p_partkey").alias("owner"), F.lit("f").alias("name"), F.lit(0).alias("ordinal"), _text("V", "p_partkey % 100").alias("type"), then("p_partkey % 29 = 0", "p_partkey % 2 <> 0", "p_partkey % 2 = 0").alias("required"), null("int").alias("identifying")),
            "facts": stated.select(fact.alias("name"), null("string").alias("objectified")),
            "roles": stated.select(fact.alias("fact"), F.lit("r").alias("name"), F.lit(0).alias("ordinal"), F.concat(F.lit("P"), then("o_orderkey % 41 = 0", "o_custkey + 1", "o_custkey").cast("string")).alias("player")),
            "rules": ruled.select(F.lit("frequency").alias("kind"), fact.alias("fact"), roles.alias("roles"), F.lit("").alias("other"), none.alias("other_roles"), then("o_orderkey % 5 = 0", f"{low} + 1", low).alias("low"), then("o_orderkey % 7 = 0", f"{high} - 1", high).alias("high"), F.col("o_orderkey").cast("int").alias("ordinal")),
            "domains": customers.where("c_custkey % 4 = 0").select(_text("V", "c_custkey").alias("value"), then("c_custkey % 11 = 0", "c_nationkey + 1", "c_nationkey").cast("string").alias("low"), then("c_custkey % 13 = 0", "c_nationkey + 55", "c_nationkey + 50").cast("string").alias("high"), none.alias("allowed")),
            "subtypes": some.where("p_partkey % 5 = 0 AND p_partkey > 0").select(_text("P", "p_partkey").alias("sub"), F.concat(F.lit("P"), then("p_partkey % 47 = 0", "p_partkey div 5 + 1", "p_partkey div 5").cast("string")).alias("sup")),
            "readings": kept(stated.where("o_orderkey % 6 = 0"), "o_orderkey % 53 <> 0").select(fact.alias("fact"), then("o_orderkey % 59 = 0", "'{r} comes'", "'{r} goes'").alias("text")),
        }

    return made(False), made(True)


_VERSIONS = """p AS (SELECT p_partkey AS k FROM part), c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
b_objects AS (SELECT 'P' || k AS name, 'entity' AS kind, NULL::VARCHAR AS scalar FROM p UNION ALL SELECT 'V' || k, 'value', 'Int' FROM c),
a_objects AS (SELECT 'P' || k AS name, 'entity' AS kind, NULL::VARCHAR AS scalar FROM p WHERE k % 17 <> 0 UNION ALL SELECT 'N' || k, 'entity', NULL FROM p WHERE k % 31 = 0 UNION ALL SELECT 'V' || k, 'value', CASE WHEN k % 19 = 0 THEN 'String' ELSE 'Int' END FROM c),
b_fields AS (SELECT 'P' || k AS name, 'V' || k % 100 AS type, k % 2 = 0 AS required FROM p), a_fields AS (SELECT 'P' || k AS name, 'V' || k % 100 AS type, (k % 2 = 0) <> (k % 29 = 0) AS required FROM p WHERE k % 17 <> 0 AND k % 23 <> 0),
b_facts AS (SELECT 'F' || k AS name FROM o), a_facts AS (SELECT 'F' || k AS name FROM o WHERE k % 37 <> 0),
b_roles AS (SELECT 'F' || k AS name, 'P' || c AS player FROM o), a_roles AS (SELECT 'F' || k AS name, 'P' || c + (k % 41 = 0)::INTEGER AS player FROM o WHERE k % 37 <> 0),
b_rules AS (SELECT 'F' || k AS name, c % 3 AS low, 5 + c % 4 AS high FROM o WHERE k % 3 = 0), a_rules AS (SELECT 'F' || k AS name, c % 3 + (k % 5 = 0)::INTEGER AS low, 5 + c % 4 - (k % 7 = 0)::INTEGER AS high FROM o WHERE k % 3 = 0 AND k % 37 <> 0 AND k % 43 <> 0),
b_domains AS (SELECT 'V' || k AS name, n AS low, n + 50 AS high FROM c WHERE k % 4 = 0), a_domains AS (SELECT 'V' || k AS name, n + (k % 11 = 0)::INTEGER AS low, n + CASE WHEN k % 13 = 0 THEN 55 ELSE 50 END AS high FROM c WHERE k % 4 = 0),
b_subtypes AS (SELECT 'P' || k AS name, 'P' || k // 5 AS sup FROM p WHERE k % 5 = 0 AND k > 0), a_subtypes AS (SELECT 'P' || k AS name, 'P' || k // 5 + (k % 47 = 0)::INTEGER AS sup FROM p WHERE k % 5 = 0 AND k > 0 AND k % 17 <> 0),
b_readings AS (SELECT 'F' || k AS name, '{r} goes' AS text FROM o WHERE k % 6 = 0), a_readings AS (SELECT 'F' || k AS name, CASE WHEN k % 59 = 0 THEN '{r} comes' ELSE '{r} goes' END AS text FROM o WHERE k % 6 = 0 AND k % 37 <> 0 AND k % 53 <> 0),
b_model AS (SELECT 'M' AS name), a_model AS (SELECT 'M2' AS name)"""
_FOUND = f"""{_VERSIONS}, found(kind, subject, tighter) AS (
SELECT 'rename_model', 'M2', false UNION ALL SELECT 'drop_object_type', name, false FROM b_objects ANTI JOIN a_objects USING (name) UNION ALL SELECT 'add_object_type', name, false FROM a_objects ANTI JOIN b_objects USING (name)
UNION ALL SELECT 'change_value_scalar', name, false FROM b_objects b JOIN a_objects a USING (name) WHERE a.scalar <> b.scalar UNION ALL SELECT 'drop_fact', name, false FROM b_facts ANTI JOIN a_facts USING (name)
UNION ALL SELECT 'drop_role', name || '.r', false FROM b_roles ANTI JOIN a_roles USING (name) UNION ALL SELECT 'change_role_player', name || '.r', false FROM b_roles b JOIN a_roles a USING (name) WHERE a.player <> b.player
UNION ALL SELECT 'drop_field', name || '.f', false FROM b_fields ANTI JOIN a_fields USING (name) UNION ALL SELECT 'change_field_required', name || '.f', a.required FROM b_fields b JOIN a_fields a USING (name) WHERE a.required <> b.required
UNION ALL SELECT 'drop_constraint', 'frequency:' || name || '(r)', false FROM b_rules ANTI JOIN a_rules USING (name) UNION ALL SELECT 'change_constraint', 'frequency:' || name || '(r)', a.low > b.low OR a.high < b.high FROM b_rules b JOIN a_rules a USING (name) WHERE a.low <> b.low OR a.high <> b.high
UNION ALL SELECT 'change_constraint', name, a.low > b.low FROM b_domains b JOIN a_domains a USING (name) WHERE a.low <> b.low OR a.high <> b.high
UNION ALL SELECT 'drop_subtype', name, false FROM b_subtypes ANTI JOIN a_subtypes USING (name) UNION ALL SELECT 'change_subtype', name, false FROM b_subtypes b JOIN a_subtypes a USING (name) WHERE a.sup <> b.sup
UNION ALL SELECT 'drop_reading', name, false FROM b_readings ANTI JOIN a_readings USING (name) UNION ALL SELECT 'change_reading', name, false FROM b_readings b JOIN a_readings a USING (name) WHERE a.text <> b.text),
safe AS (SELECT *, CASE WHEN kind IN ('drop_object_type', 'drop_fact', 'drop_field', 'drop_role') THEN 'destructive' WHEN kind IN ('change_value_scalar', 'change_role_player', 'drop_subtype', 'change_subtype') THEN 'manual' WHEN tighter THEN 'requires_data_check' ELSE 'safe' END AS safety FROM found),
stepped AS (SELECT kind, subject, safety, CASE WHEN safety = 'destructive' THEN 'cleanup' WHEN kind LIKE '%constraint%' OR kind LIKE '%subtype' THEN 'constraints' WHEN kind IN ('rename_model', 'drop_reading', 'change_reading', 'change_value_scalar') THEN 'metadata' ELSE 'schema' END AS phase FROM safe)"""


@query(f"WITH {_FOUND} SELECT kind, subject, safety, phase FROM stepped")
def model_changes(spark, d):
    return catalog.steps(catalog.changes(*versions(spark, d))).select("kind", "subject", "safety", "phase")


@query(f"WITH {_FOUND} SELECT safety, count(*) AS n, count(*) FILTER (safety = 'safe') AS automatic, count(*) FILTER (safety <> 'safe') AS blocked FROM safe GROUP BY safety")
def migration_summary(spark, d):
    return evolution.plan_summary(catalog.steps(catalog.changes(*versions(spark, d))))


@query("WITH " + _VERSIONS + ", n AS (" + " UNION ALL ".join(f"SELECT '{r}' AS relation, '{side}' AS side, count(*) AS n FROM (SELECT * FROM {x}_{r} EXCEPT ALL SELECT * FROM {y}_{r})" for r in ("domains", "facts", "fields", "model", "objects", "readings", "roles", "rules", "subtypes") for side, x, y in (("left", "b", "a"), ("right", "a", "b"))) + ") SELECT * FROM n WHERE n > 0")
def model_differences(spark, d):
    return audit.counts_by(catalog.differences(*versions(spark, d)), "relation", "side")


@query(f"WITH {_VERSIONS} SELECT 'entity' AS kind, (SELECT count(*) FROM p WHERE k % 17 = 0) AS dropped, (SELECT count(*) FROM p WHERE k % 31 = 0) AS added, (SELECT 'P' || k FROM p WHERE k % 17 = 0 ORDER BY 'P' || k LIMIT 1) AS first_dropped, (SELECT 'N' || k FROM p WHERE k % 31 = 0 ORDER BY 'N' || k LIMIT 1) AS first_added")
def rename_ambiguities(spark, d):
    before, after = versions(spark, d)
    found = catalog.ambiguities(catalog.changes(before, after), before, after)
    return found.select("kind", *[F.size(c).cast("bigint").alias(c) for c in ("dropped", "added")], *[F.col(c)[0].alias(f"first_{c}") for c in ("dropped", "added")])


@query(f"""WITH {_VERSIONS}, r AS (SELECT 'F' || o_orderkey AS fact, 'r' || l_linenumber AS name, 'P' || l_partkey AS player FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT fact, name, count(*) AS n, min(player) AS player FROM r GROUP BY 1, 2)
SELECT 'error' AS severity, 'FACT_ARITY_ZERO' AS code, name AS element FROM b_facts WHERE name NOT IN (SELECT fact FROM r) UNION ALL SELECT DISTINCT 'error', 'DUPLICATE_ROLE', fact FROM n WHERE n > 1
UNION ALL SELECT 'error', 'READING_UNKNOWN_ROLE', 'F' || k FROM o WHERE k % 6 = 0 AND 'F' || k NOT IN (SELECT fact FROM r WHERE name = 'r2')
UNION ALL SELECT 'error', 'BAD_SYMMETRIC_RING', 'symmetric:F' || k || '()' FROM o WHERE k % 4 = 0 AND coalesce((SELECT count(*) <> 2 OR count(DISTINCT player) <> 1 FROM r WHERE fact = 'F' || k), true)""")
def structure_diagnostics(spark, d):
    """Orders as facts with their lines as roles, as they are: many have a role twice or none, and readings and rings that don't fit."""
    before, _ = versions(spark, d)
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    roles = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(_text("F", "l_orderkey").alias("fact"), _text("r", "l_linenumber").alias("name"), F.col("l_linenumber").alias("ordinal"), _text("P", "l_partkey").alias("player"))
    none, no_roles = F.array().cast("array<string>"), F.lit("")
    rings = orders.where("o_orderkey % 4 = 0").select(F.lit("symmetric").alias("kind"), _text("F", "o_orderkey").alias("fact"), none.alias("roles"), no_roles.alias("other"), none.alias("other_roles"), F.lit(0).alias("low"), F.lit(None).cast("int").alias("high"), F.col("o_orderkey").cast("int").alias("ordinal"))
    readings = orders.where("o_orderkey % 6 = 0").select(_text("F", "o_orderkey").alias("fact"), F.lit("it has {r2}").alias("text"))
    return structure.diagnostics({"facts": before["facts"], "roles": roles, "readings": readings, "rules": rings})


@query("""WITH f AS (SELECT 'fact' AS what, 'F' || o_orderkey AS name FROM orders WHERE o_orderkey % 8 > 0), u AS (SELECT 'unused' AS what, 'V' || c_custkey AS name FROM customer WHERE 'V' || c_custkey NOT IN (SELECT 'V' || p_partkey % 100 FROM part UNION SELECT 'V' || o_custkey FROM orders WHERE o_orderstatus = 'F'))
SELECT * FROM f UNION ALL SELECT * FROM u UNION ALL SELECT 'columns', p_brand || ':' || string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) FROM part WHERE p_size > 3 GROUP BY p_brand""")
def model_projections(spark, d):
    """Facts that aren't fields, value types that nothing uses, and the columns that are needed of each table."""
    before, _ = versions(spark, d)
    orders = table(spark, d, "orders")
    every = before["facts"].select(F.col("name").alias("fact"))
    stated = facts.source_facts(every, orders.where("o_orderkey % 8 = 0").select(_text("F", "o_orderkey").alias("field_fact"))).select(F.lit("fact").alias("what"), F.col("fact").alias("name"))
    players = orders.where("o_orderstatus = 'F'").select(_text("F", "o_orderkey").alias("fact"), F.lit("r").alias("name"), F.lit(0).alias("ordinal"), _text("V", "o_custkey").alias("player"))
    unused = facts.unused_values(before["objects"], players, before["fields"]).select(F.lit("unused"), "name")
    mapping = table(spark, d, "part").select(F.col("p_brand").alias("table"), F.when(F.col("p_size") > 3, F.col("p_size").cast("string")).alias("column"))
    return stated.union(unused).union(facts.physical_columns(mapping).select(F.lit("columns"), F.concat_ws(":", "table", F.array_join("columns", ","))))


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS fact, l_linenumber AS role, l_partkey AS player FROM lineitem), n AS (SELECT fact, count(*) AS n FROM r GROUP BY fact), w AS (SELECT string_agg('F' || fact, ',' ORDER BY 'F' || fact) AS offenders FROM n WHERE n <> 4)
SELECT 'uniform(4)' AS analysis, 'violated' AS status, offenders FROM w UNION ALL SELECT 'connected', 'passed', '' UNION ALL SELECT 'planar', 'unevaluated', ''""")
def model_analyses(spark, d):
    """Orders as facts that share parts, so that all hang together."""
    # dealt by order, once: what is repeated goes there, and a fact's roles stay together
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").distinct()
    lines = rows.select(_text("F", "l_orderkey").alias("fact"), _text("r", "l_linenumber").alias("role"), _text("P", "l_partkey").alias("player"))
    return graph.analyses_of(lines, [("uniform", ("4",)), ("connected", ()), ("planar", ())]).withColumn("offenders", F.coalesce(F.array_join("offenders", ","), F.lit("")))


@query("""WITH k AS (SELECT l_orderkey AS t, l_linenumber AS c, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))
SELECT 'T' || t AS "table", CASE c % 3 WHEN 0 THEN 'primary_key' WHEN 1 THEN 'unique' ELSE 'foreign_key' END AS kind, string_agg('p' || p, ',' ORDER BY i) AS columns, CASE WHEN c % 3 = 2 THEN 'S(' || string_agg('s' || s, ',' ORDER BY i) || ')' ELSE '' END AS text FROM k GROUP BY t, c
UNION ALL SELECT 'T' || o_orderkey, 'check', '', 'c > ' || o_custkey FROM orders""")
def scanned_keys(spark, d):
    """Orders as tables whose keys are their line numbers, of as many columns as there are lines with the number."""
    lines, orders = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct(), table(spark, d, "orders")
    named = [_text("T", "l_orderkey").alias("table"), _text("n", "l_linenumber").alias("name")]
    kind = F.when(F.expr("l_linenumber % 3 = 0"), "PRIMARY KEY").when(F.expr("l_linenumber % 3 = 1"), "UNIQUE").otherwise("FOREIGN KEY")
    columns = lines.select(*named, _text("p", "l_partkey").alias("column"), F.struct("l_partkey", "l_suppkey").alias("ordinal"), F.lit("S").alias("target_table"), _text("s", "l_suppkey").alias("target_column"))
    checks = orders.select(_text("T", "o_orderkey").alias("table"), F.lit("ck").alias("name"), _text("c > ", "o_custkey").alias("text"))
    found = scan(lines.select(*named, kind.alias("kind")).unionByName(checks.select("table", "name", F.lit("check").alias("kind"))), columns, checks)
    return found.withColumn("columns", F.array_join("columns", ","))


@query(f"""WITH {_VERSIONS} SELECT 'set:' || name AS obligation_id, 'fact_set_semantics' AS kind, name || ' holds of the same players once.' AS reading, '{{"fact":"' || name || '"}}' AS params, 'One row of ' || name || '.|The same row again.|It is refused if the rule is kept.' AS recipe FROM b_facts
UNION ALL SELECT 'frequency:' || name || '(r):' || low || '..' || high, 'frequency', 'In ' || name || ' each r that is there at all is there ' || low || ' to ' || high || ' times.', '{{"fact":"' || name || '","roles":["r"],"least":' || low || ',"most":' || high || '}}', 'One r.|' || high + 1 || ' rows with it that differ elsewhere.|It is refused if the rule is kept.' FROM b_rules
UNION ALL SELECT 'value:' || name, 'value', 'A ' || name || ' is from ' || low || ' to ' || high || '.', '{{"value_type":"' || name || '","low":"' || low || '","high":"' || high || '"}}', 'A ' || name || ' that is not.|It is refused if the rule is kept.' FROM b_domains
UNION ALL SELECT 'required:' || name || '.f', 'mandatory', 'Every ' || name || ' has a f.', '{{"owner":"' || name || '","field":"f"}}', 'A ' || name || ' without a f.|It is refused if the rule is kept.' FROM b_fields WHERE required
UNION ALL SELECT 'subtype:' || name || '<' || sup, 'subtype', 'Every ' || name || ' is a ' || sup || '.', '{{"subtype":"' || name || '","supertype":"' || sup || '"}}', 'A ' || name || ' that is no ' || sup || '.|If it is taken the rule is not kept.' FROM b_subtypes""")
def obligation_texts(spark, d):
    """What every obligation of the first version says, of what, and how to see whether it is kept."""
    return audit.described(versions(spark, d)[0]).withColumn("recipe", F.array_join("recipe", "|"))
