"""Registered queries of the rule engine over the test tables, each with the DuckDB SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.functions import scalar
from rolewise.operators import audit, evolution, facts, graph, rules
from rolewise.plans import catalog
from rolewise.plans import compile as plan
from rolewise.plans.model import Entity, Fact, Model, Rule, Value
from rolewise.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- the model of the test tables ------------------------------------------------------------------------------------

COMMERCE = Model(
    "Commerce",
    values=(
        Value("Size", "Int", 1, 45),
        Value("Flag", "String", allowed=("A", "R")),
        Value("Name", "String"),
        Value("Money", "Float", -500.0, 9000.0),
        Value("Brand", "String"),
        Value("Type", "String"),
    ),
    entities=(
        Entity("Part", ("brand", "type", "size"), (("brand", "Brand", True), ("type", "Type", True), ("size", "Size", False))),
        Entity("Supplier", (), (("name", "Name", True),)),
        Entity("Customer", (), (("name", "Name", True), ("balance", "Money", False))),
        Entity("Orders"),
        Entity("RichCustomer"),
    ),
    facts=(
        Fact("Supply", (("part", "Part"), ("supplier", "Supplier"))),
        Fact("Line", (("order", "Orders"), ("number", "Size"), ("part", "Part"), ("supplier", "Supplier"))),
        Fact("Contains", (("order", "Orders"), ("part", "Part"))),
        Fact("Urgent", (("customer", "Customer"),)),
        Fact("Low", (("customer", "Customer"),)),
        Fact("Active", (("customer", "Customer"),)),
        Fact("Handover", (("prev", "Customer"), ("next", "Customer"))),
    ),
    rules=(
        Rule("uniqueness", "Line", ("order", "number")),
        Rule("mandatory", "Line", ("order",)),
        Rule("frequency", "Contains", ("order",), low=2, high=7),
        Rule("subset", "Urgent", ("customer",), "Active", ("customer",)),
        Rule("equality", "Urgent", ("customer",), "Low", ("customer",)),
        Rule("exclusion", "Urgent", ("customer",), "Low", ("customer",)),
        Rule("symmetric", "Handover"),
        Rule("unordered", "Handover", ("prev", "next")),
    ),
    subtypes=(("RichCustomer", "Customer"),),
)


def _of_priority(orders: DataFrame, priority: str) -> DataFrame:
    return orders.where(F.col("o_orderpriority") == priority).select(F.col("o_custkey").alias("customer")).distinct()


def _with_priority(spark: SparkSession, d: str, priority: str) -> DataFrame:
    return _of_priority(table(spark, d, "orders"), priority)


def _users(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("customer")).distinct()


def _active(spark: SparkSession, d: str) -> DataFrame:
    return _users(table(spark, d, "events"))


def _handed_over(events: DataFrame) -> DataFrame:
    rows = events.select("event_type", "ts", "event_id", "user_id")
    pairs = facts.following(rows, "event_type", ["ts", "event_id"], "user_id", F.date_trunc("hour", "ts"))
    return pairs.select(F.col("user_id").alias("prev"), F.col("following").alias("next")).where("next IS NOT NULL").distinct()


def _handover(spark: SparkSession, d: str) -> DataFrame:
    return _handed_over(table(spark, d, "events"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return facts.facts_of(table(spark, d, "lineitem"), order="l_orderkey", number="l_linenumber", part="l_partkey", supplier="l_suppkey")


def binding(spark: SparkSession, d: str) -> plan.Binding:
    lines = _lines(spark, d)
    customers, orders, events = (table(spark, d, name) for name in ("customer", "orders", "events"))
    return plan.Binding(
        entities={
            "Part": (table(spark, d, "part"), "p_partkey", {"brand": "p_brand", "type": "p_type", "size": "p_size"}),
            "Supplier": (table(spark, d, "supplier"), "s_suppkey", {"name": "s_name"}),
            "Customer": (customers, "c_custkey", {"name": "c_name", "balance": "c_acctbal"}),
            "Orders": (orders, "o_orderkey", {}),
            "RichCustomer": (customers.where("c_acctbal > 9000"), "c_custkey", {}),
        },
        facts={
            "Line": lines,
            "Urgent": _of_priority(orders, "1-URGENT"),
            "Low": _of_priority(orders, "5-LOW"),
            "Active": _users(events),
            "Handover": _handed_over(events),
        },
        projections={"Supply": ("Line", {"part": "part", "supplier": "supplier"}), "Contains": ("Line", {"order": "order", "part": "part"})},
    )


HANDOVER = """handover AS (
  SELECT DISTINCT prev, next FROM (SELECT user_id AS prev, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL
)"""
CUSTOMERS = """u AS (SELECT DISTINCT o_custkey AS customer FROM orders WHERE o_orderpriority = '1-URGENT'),
l AS (SELECT DISTINCT o_custkey AS customer FROM orders WHERE o_orderpriority = '5-LOW'),
a AS (SELECT DISTINCT user_id AS customer FROM events)"""

#: One row for each violated obligation and key of the model above.
VIOLATIONS = f"""WITH {HANDOVER}, {CUSTOMERS}, v AS (
  SELECT 'required:Part.brand' AS o, 'MANDATORY_VIOLATION' AS c, [p_partkey::VARCHAR] AS key, 1 AS n FROM part WHERE p_brand IS NULL
  UNION ALL SELECT 'required:Part.type', 'MANDATORY_VIOLATION', [p_partkey::VARCHAR], 1 FROM part WHERE p_type IS NULL
  UNION ALL SELECT 'value:Part.size', 'VALUE_CONSTRAINT_VIOLATION', [p_partkey::VARCHAR], 1 FROM part WHERE p_size NOT BETWEEN 1 AND 45
  UNION ALL SELECT 'identifier:Part', 'IDENTIFIER_VIOLATION', [p_brand, p_type, p_size::VARCHAR], count(*) FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1
  UNION ALL SELECT 'value:Customer.balance', 'VALUE_CONSTRAINT_VIOLATION', [c_custkey::VARCHAR], 1 FROM customer WHERE c_acctbal NOT BETWEEN -500 AND 9000
  UNION ALL SELECT 'set:Supply', 'DUPLICATE_FACT', [l_partkey::VARCHAR, l_suppkey::VARCHAR], count(*) FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1
  UNION ALL SELECT 'set:Line', 'DUPLICATE_FACT', [l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR], count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey HAVING count(*) > 1
  UNION ALL SELECT 'set:Contains', 'DUPLICATE_FACT', [l_orderkey::VARCHAR, l_partkey::VARCHAR], count(*) FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
  UNION ALL SELECT 'uniqueness:Line(order,number)', 'UNIQUENESS_VIOLATION', [l_orderkey::VARCHAR, l_linenumber::VARCHAR], count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1
  UNION ALL SELECT 'frequency:Contains(order):2..7', 'FREQUENCY_VIOLATION', [l_orderkey::VARCHAR], count(DISTINCT l_partkey) FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) NOT BETWEEN 2 AND 7
  UNION ALL SELECT 'mandatory:Line(order)', 'MANDATORY_VIOLATION', [o_orderkey::VARCHAR], 1 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
  UNION ALL SELECT 'subset:Urgent(customer):Active(customer)', 'SUBSET_VIOLATION', [customer::VARCHAR], 1 FROM (SELECT customer FROM u EXCEPT SELECT customer FROM a)
  UNION ALL SELECT 'equality:Urgent(customer):Low(customer)', 'EQUALITY_VIOLATION', [customer::VARCHAR], 1 FROM ((SELECT customer FROM u EXCEPT SELECT customer FROM l) UNION ALL (SELECT customer FROM l EXCEPT SELECT customer FROM u))
  UNION ALL SELECT 'exclusion:Urgent(customer):Low(customer)', 'EXCLUSION_VIOLATION', [customer::VARCHAR], 1 FROM (SELECT customer FROM u INTERSECT SELECT customer FROM l)
  UNION ALL SELECT 'symmetric:Handover()', 'SYMMETRY_VIOLATION', [prev::VARCHAR, next::VARCHAR], 1 FROM handover h WHERE NOT EXISTS (SELECT 1 FROM handover r WHERE r.prev = h.next AND r.next = h.prev)
  UNION ALL SELECT 'unordered:Handover(prev,next)', 'UNORDERED_DUPLICATE', [least(prev, next)::VARCHAR, greatest(prev, next)::VARCHAR], count(*) FROM handover GROUP BY least(prev, next), greatest(prev, next) HAVING count(*) > 1
  UNION ALL SELECT 'player:Handover.prev', 'ROLE_PLAYER_MEMBERSHIP', [prev::VARCHAR], 1 FROM (SELECT DISTINCT prev FROM handover) WHERE prev NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'player:Handover.next', 'ROLE_PLAYER_MEMBERSHIP', [next::VARCHAR], 1 FROM (SELECT DISTINCT next FROM handover) WHERE next NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'player:Active.customer', 'ROLE_PLAYER_MEMBERSHIP', [customer::VARCHAR], 1 FROM a WHERE customer NOT IN (SELECT c_custkey FROM customer)
)"""


def _violations(spark: SparkSession, d: str) -> DataFrame:
    return plan.violations(COMMERCE, binding(spark, d))


@query(f"{VIOLATIONS} SELECT o AS obligation_id, c AS code, array_to_string(key, '|') AS key, n::BIGINT AS n FROM v")
def violations(spark, d):
    """Every violation of the model, from one fused plan."""
    return _violations(spark, d).select("obligation_id", "code", F.array_join("key", "|").alias("key"), "n")


_KNOWN = ", ".join(f"('{o}', '{k}')" for o, k in plan.obligations(COMMERCE))


@query(f"""{VIOLATIONS}, known(obligation_id, kind) AS (VALUES {_KNOWN})
SELECT obligation_id, kind, count(o)::BIGINT AS violations, CASE WHEN count(o) > 0 THEN 'violated' ELSE 'holds' END AS status
FROM known LEFT JOIN v ON o = obligation_id GROUP BY obligation_id, kind""")
def violation_summary(spark, d):
    return plan.summary(COMMERCE, *plan.evaluated(COMMERCE, binding(spark, d)))


@query(f"""{VIOLATIONS} SELECT o AS obligation_id, c AS code, array_to_string(key, '|') AS key, n::BIGINT AS n
FROM (SELECT *, row_number() OVER (PARTITION BY o, c ORDER BY key, n) AS r FROM v) WHERE r = 1""")
def first_witness_per_constraint(spark, d):
    return plan.first_witness(_violations(spark, d)).select("obligation_id", "code", F.array_join("key", "|").alias("key"), "n")


@query(f"""{VIOLATIONS} SELECT key[1] AS instance, count(DISTINCT o)::BIGINT AS rules, CASE WHEN count(DISTINCT o) = 1 THEN 'isolated' ELSE 'collateral' END AS status
FROM v WHERE o LIKE '%(customer)%' GROUP BY key[1]""")
def isolated_vs_collateral(spark, d):
    found = _violations(spark, d).where(F.col("obligation_id").contains("(customer)"))
    return plan.isolation(found, F.col("key")[0])


# -- single rules ----------------------------------------------------------------------------------------------------


@query("SELECT l_partkey AS part, l_suppkey AS supplier, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def fact_set_duplicates(spark, d):
    return facts.duplicates(_lines(spark, d), "part", "supplier")


@query('SELECT l_orderkey AS "order", l_linenumber AS number, count(DISTINCT (l_partkey, l_suppkey)) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1')
def uniqueness_violations(spark, d):
    return rules.uniqueness(_lines(spark, d), ["order", "number"], ["order", "number", "part", "supplier"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events) WHERE event_type <> f")
def uniqueness_sample_variant(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return rules.uniqueness_sample(rows, ["user_id"], ["user_id", "event_type"], "event_id")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def mandatory_violations(spark, d):
    return rules.mandatory(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def required_field_violations(spark, d):
    return rules.mandatory(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id")


@query('SELECT l_orderkey AS "order", count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) NOT BETWEEN 2 AND 7')
def frequency_violations(spark, d):
    return rules.frequency(_lines(spark, d), ["order"], ["order", "part"], 2, 7)


@query('SELECT l_orderkey AS "order", count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) NOT BETWEEN 2 AND 7')
def frequency_sample_variant(spark, d):
    return rules.frequency(_lines(spark, d), ["order"], ["order", "part"], 2, 7, sample=True)


@query("SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 1 AND 45")
def value_range_violations(spark, d):
    return rules.value_range(table(spark, d, "part"), "p_size", 1, 45, "Int").select("p_partkey", "p_size")


@query("SELECT l_returnflag AS value, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') GROUP BY 1")
def value_oneof_violations(spark, d):
    return audit.counts_by(rules.value_oneof(table(spark, d, "lineitem"), "l_returnflag", ["A", "R"], "String").select(F.col("l_returnflag").alias("value")), "value")


@query(f"WITH {CUSTOMERS} SELECT customer FROM u EXCEPT SELECT customer FROM a")
def subset_violations(spark, d):
    return rules.subset(_with_priority(spark, d, "1-URGENT"), ["customer"], _active(spark, d), ["customer"])


@query(f"WITH {CUSTOMERS} SELECT customer, 'left' AS side FROM (SELECT customer FROM u EXCEPT SELECT customer FROM l) UNION ALL SELECT customer, 'right' FROM (SELECT customer FROM l EXCEPT SELECT customer FROM u)")
def equality_violations(spark, d):
    return rules.equality(_with_priority(spark, d, "1-URGENT"), ["customer"], _with_priority(spark, d, "5-LOW"), ["customer"])


@query(f"WITH {CUSTOMERS} SELECT customer FROM u INTERSECT SELECT customer FROM l")
def exclusion_violations(spark, d):
    return rules.exclusion(_with_priority(spark, d, "1-URGENT"), ["customer"], _with_priority(spark, d, "5-LOW"), ["customer"])


@query(f"WITH {HANDOVER} SELECT prev, next FROM handover h WHERE NOT EXISTS (SELECT 1 FROM handover r WHERE r.prev = h.next AND r.next = h.prev)")
def symmetry_violations(spark, d):
    return rules.symmetry(_handover(spark, d), "prev", "next")


@query(f"WITH {HANDOVER} SELECT least(prev, next) AS a, greatest(prev, next) AS b, count(*) AS n FROM handover GROUP BY 1, 2 HAVING count(*) > 1")
def unordered_duplicates(spark, d):
    found = rules.unordered(_handover(spark, d), ["prev", "next"], ["prev", "next"])
    return found.select(F.col("players")[0].alias("a"), F.col("players")[1].alias("b"), "n")


@query(f"WITH {HANDOVER} SELECT least(prev, next) AS prev, greatest(prev, next) AS next, count(*) AS n FROM handover GROUP BY 1, 2 HAVING count(*) > 1")
def unordered_sample_duplicates(spark, d):
    return facts.duplicates(rules.unordered_canonical(_handover(spark, d), ["prev", "next"]), "prev", "next")


@query("SELECT p_brand AS c0, p_type AS c1, p_size AS c2, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1, 2, 3 HAVING count(DISTINCT p_partkey) > 1")
def identifier_violations(spark, d):
    """Over field facts, joined by owner; the compiled model takes the one-pass form for columns of one table."""
    parts = table(spark, d, "part")
    fields = [parts.select(F.col("p_partkey").alias("owner"), F.col(c).alias("value")) for c in ("p_brand", "p_type", "p_size")]
    return rules.identifier(parts, "p_partkey", fields)


@query("SELECT sha256(text) AS text_sha256, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def text_identifier(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return rules.identifier_columns(hashed, "doc_id", ["text_sha256"])


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def subtype_violations(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9000")
    return rules.subtype(rich, "c_custkey", _with_priority(spark, d, "1-URGENT"), "customer")


@query("""SELECT 'part' AS role, count(*) AS n FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) WHERE k NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'supplier', count(*) FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) WHERE k NOT IN (SELECT s_suppkey FROM supplier)""")
def role_player_violations(spark, d):
    lines = _lines(spark, d)
    part = rules.role_player(lines, "part", table(spark, d, "part"), "p_partkey").agg(F.lit("part").alias("role"), F.count(F.lit(1)).alias("n"))
    supplier = rules.role_player(lines, "supplier", table(spark, d, "supplier"), "s_suppkey").agg(F.lit("supplier").alias("role"), F.count(F.lit(1)).alias("n"))
    return part.unionByName(supplier)


@query("SELECT c_custkey, 'c_name' AS field FROM customer WHERE c_name IS NULL OR c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'c_mktsegment' FROM customer WHERE c_custkey % 7 = 0")
def required_columns(spark, d):
    gaps = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return rules.required(gaps, "c_custkey", "c_name", "c_mktsegment")


@query("SELECT doc_id::VARCHAR AS instance_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_literals(spark, d):
    members = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("instance_id"))
    return rules.missing_literal(members, table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("instance_id")))


@query("SELECT user_id AS instance_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def value_type_mismatches(spark, d):
    return rules.value_type_mismatch(table(spark, d, "events").select(F.col("event_type").alias("value_type"), F.col("user_id").alias("instance_id")))


@query("SELECT 'Turn' AS fact, conv_id AS row_index, count(*)::INTEGER AS n FROM conversations GROUP BY conv_id HAVING count(*) <> 4")
def arity_violations(spark, d):
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("row_index")).agg(F.collect_list("role").alias("players")).withColumn("fact", F.lit("Turn"))
    return rules.arity(rows, spark.createDataFrame([("Turn", 4)], "fact string, arity int"))


@query("SELECT DISTINCT event_type AS object_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def unknown_types(spark, d):
    named = table(spark, d, "events").select(F.col("event_type").alias("object_type"))
    return rules.unknown_types(named, "object_type", spark.createDataFrame([("click",), ("view",), ("purchase",)], "object_type string"))


@query("SELECT count(*) AS violations FROM (SELECT conv_id, turn FROM conversations GROUP BY 1, 2 HAVING count(DISTINCT md5(text)) > 1)")
def objectification_injectivity(spark, d):
    bound = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("instance_id"))
    return rules.objectification_injectivity(bound, "conv_id", "turn").agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT doc_id AS row_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def objectification_occurrence(spark, d):
    bindings = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("instance_id"), F.lit("Label").alias("fact"), F.col("doc_id").alias("row_index"))
    rows = table(spark, d, "labels").select(F.lit("Label").alias("fact"), F.col("doc_id").alias("row_index"))
    return rules.objectification_occurrence(bindings, rows).select("row_index")


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Plain' ELSE 'LabelRecord' END AS t, CASE WHEN doc_id % 5 = 0 THEN 'Other' ELSE 'Label' END AS f FROM documents)
SELECT doc_id AS instance_id, 'OBJECTIFICATION_TYPE' AS code FROM b WHERE t = 'Plain'
UNION ALL SELECT doc_id, 'OBJECTIFICATION_MEMBERSHIP' FROM b WHERE t <> 'Plain' AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'OBJECTIFICATION_FACT' FROM b WHERE t <> 'Plain' AND f <> 'Label'""")
def objectification_types(spark, d):
    of = F.when(F.col("doc_id") % 3 == 0, "Plain").otherwise("LabelRecord")
    bindings = table(spark, d, "documents").select(F.col("doc_id").alias("instance_id"), of.alias("object_type"), F.when(F.col("doc_id") % 5 == 0, "Other").otherwise("Label").alias("fact"))
    catalog = spark.createDataFrame([("Plain", None), ("LabelRecord", "Label")], "object_type string, objectifies string")
    members = table(spark, d, "labels").select(F.lit("LabelRecord").alias("object_type"), F.col("doc_id").alias("instance_id"))
    return rules.objectification_types(bindings, catalog, members)


# -- facts as rows ---------------------------------------------------------------------------------------------------

EVENT_TYPES = ["click", "login", "logout", "purchase", "view", "search", "error", "signup"]
_WIDE = ", ".join(f"min(value) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES)
_MANY = " + ".join(f"(count(DISTINCT value) FILTER (event_type = '{t}') > 1)::INTEGER" for t in EVENT_TYPES)


@query(f"SELECT user_id::VARCHAR AS owner, {_WIDE}, {_MANY} AS multivalued FROM (SELECT user_id, event_type, event_id::VARCHAR AS value FROM events WHERE event_type IN ({', '.join(repr(t) for t in EVENT_TYPES)})) GROUP BY user_id")
def lowering_pivot(spark, d):
    """Field facts, one row each, as one wide row for each owner."""
    long = table(spark, d, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("value"))
    return facts.widen(long, EVENT_TYPES, keep_multiple=True)


@query("SELECT user_id, event_type, count(DISTINCT value) AS n FROM events GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def multivalued_gap(spark, d):
    return facts.multivalued(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT count(quality) AS present FROM documents LEFT JOIN labels USING (doc_id)")
def absorbed_presence(spark, d):
    wide = facts.absorbed(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    return facts.presence(wide, "quality", "toxic")


FIELDS = ["c_name", "c_nationkey", "c_mktsegment"]


@query("UNION ALL ".join(f"SELECT 'Customer' AS entity, c_custkey::VARCHAR AS owner, '{f}' AS field, {f}::VARCHAR AS value FROM customer WHERE {f} IS NOT NULL " for f in FIELDS))
def encode_facts(spark, d):
    return facts.lengthen(table(spark, d, "customer"), "Customer", "c_custkey", FIELDS)


@query("SELECT count(*) AS differences FROM customer WHERE c_custkey IS NULL")
def decode_roundtrip(spark, d):
    """Encoded and decoded again, the population is the same: no row is in one and not in the other."""
    wide = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("owner"), *[F.col(f).cast("string").alias(f) for f in FIELDS])
    back = facts.widen(facts.lengthen(wide, "Customer", "owner", FIELDS), FIELDS)
    return facts.same_rows(wide, back).agg(F.count(F.lit(1)).alias("differences"))


@query("SELECT conv_id, count(*) AS n, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS contiguous FROM conversations GROUP BY conv_id")
def ordinal_contiguity(spark, d):
    return facts.contiguity(table(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def ordinal_gather(spark, d):
    return facts.gather(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("values", ">").alias("roles"))


@query("SELECT count(*) AS n FROM (SELECT user_id FROM events UNION SELECT o_custkey FROM orders)")
def population_union(spark, d):
    both = facts.merged(_active(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("customer")))
    return both.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS instance_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def literal_conflicts(spark, d):
    return facts.literal_conflicts(table(spark, d, "events").select(F.col("user_id").alias("instance_id"), F.col("event_type").alias("literal")))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def role_projection(spark, d):
    return facts.project(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


# -- graphs ----------------------------------------------------------------------------------------------------------


# suppliers are few next to the lines, so the SQL walks among them
@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem WHERE l_quantity > 48), h AS (SELECT DISTINCT x.b AS u, y.b AS v FROM e x JOIN e y ON x.a = y.a),
reach(u, v) AS (SELECT u, v FROM h UNION SELECT r.u, h.v FROM reach r JOIN h ON r.v = h.u), m AS (SELECT u AS b, least(min(e.a), min(e.b)) AS component FROM reach JOIN e ON v = e.b GROUP BY u)
SELECT b AS node, component FROM m UNION SELECT a, component FROM e JOIN m ON e.b = m.b""")
def connected_components(spark, d):
    """Parts and suppliers that large lines connect."""
    rows = table(spark, d, "lineitem").where("l_quantity > 48")
    return graph.components(rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")))


# of all orders; as priorities are few, the SQL walks among them and costs in proportion to the edges
@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'p' || o_orderpriority AS b FROM orders), h AS (SELECT DISTINCT x.b AS u, y.b AS v FROM e x JOIN e y ON x.a = y.a),
reach(u, v) AS (SELECT u, v FROM h UNION SELECT r.u, h.v FROM reach r JOIN h ON r.v = h.u), m AS (SELECT u AS b, least(min(e.a), min(e.b)) AS component FROM reach JOIN e ON v = e.b GROUP BY u)
SELECT b AS node, component FROM m UNION SELECT a, component FROM e JOIN m ON e.b = m.b""")
def connected_components_all(spark, d):
    rows = table(spark, d, "orders")
    edges = rows.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("o_orderpriority")).alias("dst"))
    return graph.components(edges)


@query("SELECT 'doc' AS kind, count(*) AS total, count(*) FILTER (doc_id % 4 = 0) AS stable, count(*) FILTER (doc_id % 4 = 0) / count(*) AS coverage FROM documents")
def identity_coverage(spark, d):
    ids = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.when(F.col("doc_id") % 4 == 0, scalar.explicit_id("doc", F.col("doc_id").cast("string"))).otherwise(scalar.stable_id("doc", F.col("doc_id").cast("string"))).alias("id"))
    return graph.identity_coverage(ids)


# -- evolution -------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 10 <> 0), a AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0)
SELECT p_partkey, 'dropped' AS change, '' AS changed FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM a) UNION ALL SELECT p_partkey, 'added', '' FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM b)
UNION ALL SELECT p_partkey, 'changed', 'p_size' FROM a JOIN b USING (p_partkey) WHERE a.p_size <> b.p_size""")
def semantic_diff_rows(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    after = parts.where("p_partkey % 7 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return evolution.diff(parts.where("p_partkey % 10 <> 0"), after, "p_partkey", ["p_brand", "p_size"])


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0), o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0),
t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 17 <> 0),
j AS (SELECT coalesce(b.o_orderkey, o.o_orderkey, t.o_orderkey) AS o_orderkey, b.o_orderstatus AS bs, o.s AS os, t.s AS ts FROM b FULL JOIN o USING (o_orderkey) FULL JOIN t ON t.o_orderkey = coalesce(b.o_orderkey, o.o_orderkey)),
d AS (SELECT *, os IS DISTINCT FROM ts AND os IS DISTINCT FROM bs AND ts IS DISTINCT FROM bs AS clash, CASE WHEN os IS NOT DISTINCT FROM bs THEN ts ELSE os END AS taken FROM j)
SELECT o_orderkey, CASE WHEN clash THEN 'conflict' WHEN taken IS NULL THEN 'deleted' ELSE 'kept' END AS outcome, CASE WHEN NOT clash THEN taken END AS o_orderstatus,
CASE WHEN clash THEN CASE WHEN bs IS NULL THEN 'both added' WHEN os IS NULL OR ts IS NULL THEN 'deleted and modified' ELSE 'both modified' END END AS reason FROM d""")
def three_way_merge(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    say = lambda m, s: F.when(F.col("o_orderkey") % m == 0, s).otherwise(F.col("o_orderstatus"))
    ours = rows.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", say(3, "X"))
    theirs = rows.where("o_orderkey % 17 <> 0").withColumn("o_orderstatus", say(5, "Y"))
    return evolution.merge(rows.where("o_orderkey % 13 <> 0"), ours, theirs, "o_orderkey", ["o_orderstatus"]).drop("conflict_id")


@query("SELECT 'l_shipdate' AS \"column\", count(*) FILTER (l_shipdate IS NULL) AS n FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax IS NULL) FROM lineitem")
def preflight_null(spark, d):
    return evolution.null_rows(table(spark, d, "lineitem"), "l_shipdate", "l_tax")


@query("SELECT count(*) AS n FROM lineitem WHERE NOT (l_quantity <= 45 AND l_discount < 0.09)")
def preflight_check(spark, d):
    return evolution.check_rows(table(spark, d, "lineitem"), "l_quantity <= 45 AND l_discount < 0.09").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def preflight_fk(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return evolution.foreign_keys(table(spark, d, "lineitem"), ["l_orderkey"], done, ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def preflight_unique(spark, d):
    return evolution.unique_groups(table(spark, d, "orders"), "o_custkey", "o_orderdate")


# -- scalar functions ------------------------------------------------------------------------------------------------


# a capital begins a word where small letters follow, and after a small letter or digit; twice, as the pattern takes the letter before it, too
@query(r"""WITH n AS (SELECT p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') || p_partkey || 'XMLBox of ' || p_brand || '!' AS camel FROM part),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(camel, '(.)([A-Z][a-z])', '\1_\2', 'g'), '([^_])([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g') AS words FROM n)
SELECT p_partkey, 'part:' || replace(replace(p_name, '%', '%25'), ':', '%3A') AS stable, lower(trim(regexp_replace(words, '[^a-zA-Z0-9_]+', '_', 'g'), '_')) AS slug,
trim(regexp_replace(camel, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') || '__' || substr(sha256(camel), 1, 20) AS file FROM w""")
def scalar_ids(spark, d):
    """Ids of parts, and slugs and file names of ``SmallRing7XMLBox of Brand#12!`` and the like."""
    name = F.col("p_name")
    camel = F.concat(F.replace(F.initcap(name), F.lit(" "), F.lit("")), F.col("p_partkey").cast("string"), F.lit("XMLBox of "), F.col("p_brand"), F.lit("!"))
    return table(spark, d, "part").select("p_partkey", scalar.stable_id("part", name).alias("stable"), scalar.slug(camel).alias("slug"), scalar.file_token(camel).alias("file"))


@query("SELECT event_id, coalesce(value BETWEEN 10 AND 50, false) AS in_range, event_type IN ('click', 'view') AS allowed FROM events")
def scalar_domains(spark, d):
    return table(spark, d, "events").select("event_id", scalar.in_range(F.col("value"), 10, 50, "Float").alias("in_range"), scalar.one_of(F.col("event_type"), ["click", "view"]).alias("allowed"))


# -- models as data --------------------------------------------------------------------------------------------------

_OLDER = replace(COMMERCE, rules=tuple(r for r in COMMERCE.rules if r.kind not in ("frequency", "symmetric")), values=(Value("Size", "Int", 1, 60), *COMMERCE.values[1:]), _by_name={})


@query(f"""{VIOLATIONS} SELECT k AS obligation_id, count(o)::BIGINT AS violations
FROM (VALUES ('frequency:Contains(order):2..7'), ('symmetric:Handover()'), ('value:Part.size')) t(k) LEFT JOIN v ON o = k GROUP BY k""")
def migration_preflight(spark, d):
    """What the data would violate of the obligations that are new or tighter in the newer model."""
    return catalog.preflight(_OLDER, COMMERCE, binding(spark, d))


_CAPABLE = ", ".join(repr((f, t, s)) for f, by in audit.CAPABILITIES.items() for t, s in by.items())


@query(f"""{VIOLATIONS}, known(obligation_id, kind) AS (VALUES {_KNOWN}), s AS (SELECT obligation_id, kind, count(o)::BIGINT AS violations FROM known LEFT JOIN v ON o = obligation_id GROUP BY ALL), c(feature, target, status) AS (VALUES {_CAPABLE})
SELECT obligation_id, target, violations, CASE WHEN violations = 0 THEN 'nothing_to_prevent' WHEN status = 'N' THEN 'prevented' WHEN status = 'R' THEN 'realized' ELSE 'not_asserted' END AS simulated FROM s JOIN c ON feature = kind""")
def simulated_enforcement(spark, d):
    return audit.simulated(plan.summary(COMMERCE, _violations(spark, d)), audit.capabilities(spark))


@query(f"""{VIOLATIONS}, known(obligation_id, kind) AS (VALUES {_KNOWN}), s AS (SELECT obligation_id, kind, count(o)::BIGINT AS violations FROM known LEFT JOIN v ON o = obligation_id GROUP BY ALL), c(feature, target, status) AS (VALUES {_CAPABLE})
SELECT obligation_id, t.target, violations, CASE WHEN status IS NULL THEN 'missing_capability_entry' WHEN violations = 0 THEN 'nothing_to_prevent' WHEN status = 'N' THEN 'prevented' WHEN status = 'R' THEN 'realized' ELSE 'not_asserted' END AS simulated
FROM s CROSS JOIN (SELECT DISTINCT target FROM c) t LEFT JOIN c ON c.target = t.target AND c.feature = CASE kind WHEN 'mandatory' THEN 'mandatory_fact' WHEN 'symmetric' THEN 'ring' WHEN 'unordered' THEN 'unordered_role_group' ELSE kind END""")
def simulated_enforcement_all(spark, d):
    """For every obligation and target; ``simulated_enforcement`` has only kinds that are named as their feature."""
    return audit.simulated_all(plan.summary(COMMERCE, _violations(spark, d)), audit.capabilities(spark))


@query("""SELECT "order", number, part, supplier FROM (SELECT *, row_number() OVER (PARTITION BY "order", number ORDER BY part, supplier) AS k, count(*) OVER (PARTITION BY "order", number) AS n
FROM (SELECT DISTINCT l_orderkey AS "order", l_linenumber AS number, l_partkey AS part, l_suppkey AS supplier FROM lineitem)) WHERE n > 1 AND k <= 2""")
def violation_evidence(spark, d):
    """For every broken line number the two least lines that show it."""
    return plan.evidence(_violations(spark, d), _lines(spark, d), "uniqueness:Line(order,number)", ["order", "number"])


from rolewise import audit_queries, catalog_queries, graph_queries, model_queries  # noqa: E402, F401 - register their queries
