"""Registered queries over whole populations, samples, graphs of revisions and models, with the DuckDB SQL that each must agree with."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.functions import scalar
from rolewise.operators import audit, evolution, facts, graph
from rolewise.plans import catalog, chase, population, portability, witness
from rolewise.plans import compile as plan
from rolewise.plans.model import Entity, Fact, Model, Rule, Value
from rolewise.queries import COMMERCE, VIOLATIONS, binding, query
from rolewise.sources.tables import table

# -- a population of long relations, with faults of every kind -----------------------------------------------------------

ORDERED = Model(
    "Ordered",
    values=(Value("Size", "Int", 1, 45),),
    entities=(Entity("Customer"), Entity("Order"), Entity("Urgent")),
    facts=(Fact("Placed", (("customer", "Customer"), ("order", "Order")), "PlacedRecord"), Fact("Likes", (("a", "Customer"), ("b", "Customer")))),
    rules=(Rule("uniqueness", "Placed", ("order",)), Rule("mandatory", "Placed", ("order",)), Rule("frequency", "Placed", ("customer",), low=1, high=12), Rule("symmetric", "Likes")),
    subtypes=(("Urgent", "Order"),),
)


def _population(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    orders, parts, nations = table(spark, d, "orders"), table(spark, d, "part"), table(spark, d, "nation")
    key, part = F.col("o_orderkey"), F.col("p_partkey")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))

    def of(df: DataFrame, type_: str, instance) -> DataFrame:
        return df.select(F.lit(type_).alias("object_type"), instance.alias("instance_id"))

    members = of(table(spark, d, "customer"), "Customer", name("c", "c_custkey"))
    for more in (
        of(orders.where("o_orderkey % 50 <> 3"), "Order", name("o", "o_orderkey")), of(orders.where("o_orderpriority = '1-URGENT'"), "Urgent", name("o", "o_orderkey")), of(parts, "Size", name("s", "p_partkey")),
        of(nations, "Ghost", name("g", "n_nationkey")), of(orders.where("o_orderkey % 4 = 0"), "PlacedRecord", name("r", "o_orderkey")),
    ):
        members = members.unionByName(more)
    values = parts.where("p_partkey % 40 <> 1").select(name("s", "p_partkey").alias("instance_id"), F.when(part % 70 == 2, "Other").otherwise("Size").alias("value_type"), F.col("p_size").cast("string").alias("literal"))
    pair = F.array(name("c", "o_custkey"), name("o", "o_orderkey"))
    placed = orders.select(F.lit("Placed").alias("fact"), key.alias("row_index"), F.when(key % 90 == 5, F.slice(pair, 1, 1)).otherwise(pair).alias("players"))
    again = orders.where("o_orderkey % 110 = 7").select(F.lit("Placed").alias("fact"), (-key).alias("row_index"), pair.alias("players"))
    nowhere = nations.select(F.lit("Nowhere").alias("fact"), F.col("n_nationkey").cast("bigint").alias("row_index"), F.array(F.lit("x")).alias("players"))
    likes = nations.select(F.lit("Likes").alias("fact"), F.col("n_nationkey").cast("bigint").alias("row_index"), F.array(name("c", "n_nationkey"), name("c", "n_regionkey")).alias("players"))
    record = F.lit("PlacedRecord")
    bound = orders.where("o_orderkey % 4 = 0").select(
        name("r", "o_orderkey").alias("instance_id"), F.when(key % 12 == 0, "Customer").otherwise(record).alias("object_type"), F.when(key % 20 == 0, "Likes").otherwise("Placed").alias("fact"), F.when(key % 28 == 0, -1000 * key - 5).otherwise(key).alias("row_index")
    )
    shared = orders.where("o_orderkey % 44 = 0").select(name("z", "o_orderkey").alias("instance_id"), record.alias("object_type"), F.lit("Placed").alias("fact"), key.alias("row_index"))
    return {"memberships": members, "values": values, "facts": placed.unionByName(again).unionByName(nowhere).unionByName(likes), "objectifications": bound.unionByName(shared)}


_RELATIONS = """mem AS (SELECT 'Customer' AS t, 'c' || c_custkey AS i FROM customer UNION SELECT 'Order', 'o' || o_orderkey FROM orders WHERE o_orderkey % 50 <> 3 UNION SELECT 'Urgent', 'o' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT 'Size', 's' || p_partkey FROM part UNION SELECT 'Ghost', 'g' || n_nationkey FROM nation UNION SELECT 'PlacedRecord', 'r' || o_orderkey FROM orders WHERE o_orderkey % 4 = 0),
val AS (SELECT 's' || p_partkey AS i, CASE WHEN p_partkey % 70 = 2 THEN 'Other' ELSE 'Size' END AS t, p_size AS l FROM part WHERE p_partkey % 40 <> 1),
fact AS (SELECT 'Placed' AS f, o_orderkey AS k, CASE WHEN o_orderkey % 90 = 5 THEN ['c' || o_custkey] ELSE ['c' || o_custkey, 'o' || o_orderkey] END AS p FROM orders
  UNION ALL SELECT 'Placed', -o_orderkey, ['c' || o_custkey, 'o' || o_orderkey] FROM orders WHERE o_orderkey % 110 = 7
  UNION ALL SELECT 'Nowhere', n_nationkey, ['x'] FROM nation UNION ALL SELECT 'Likes', n_nationkey, ['c' || n_nationkey, 'c' || n_regionkey] FROM nation),
ob AS (SELECT 'r' || o_orderkey AS i, CASE WHEN o_orderkey % 12 = 0 THEN 'Customer' ELSE 'PlacedRecord' END AS t, CASE WHEN o_orderkey % 20 = 0 THEN 'Likes' ELSE 'Placed' END AS f, CASE WHEN o_orderkey % 28 = 0 THEN -1000 * o_orderkey - 5 ELSE o_orderkey END AS k FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT 'z' || o_orderkey, 'PlacedRecord', 'Placed', o_orderkey FROM orders WHERE o_orderkey % 44 = 0),
placed AS (SELECT p[1] AS c, p[2] AS o FROM fact WHERE f = 'Placed' AND len(p) = 2), likes AS (SELECT DISTINCT p[1] AS a, p[2] AS b FROM fact WHERE f = 'Likes')"""


@query(f"""WITH {_RELATIONS}, right_ob AS (SELECT * FROM ob WHERE t = 'PlacedRecord' AND f = 'Placed'), held AS (SELECT * FROM right_ob WHERE k IN (SELECT k FROM fact WHERE f = 'Placed'))
SELECT DISTINCT 'population:membership:' || t AS obligation_id, 'UNKNOWN_OBJECT_TYPE' AS code, t AS key, 1 AS n FROM mem WHERE t = 'Ghost'
UNION ALL SELECT 'population:value:' || i, 'VALUE_TYPE_MISMATCH', i, 1 FROM val WHERE t <> 'Size'
UNION ALL SELECT 'population:value:' || i, 'MISSING_VALUE_LITERAL', i, 1 FROM mem WHERE t = 'Size' AND i NOT IN (SELECT i FROM val)
UNION ALL SELECT 'value:Size', 'VALUE_CONSTRAINT_VIOLATION', i, 1 FROM val WHERE l NOT BETWEEN 1 AND 45
UNION ALL SELECT DISTINCT 'population:fact:Nowhere', 'UNKNOWN_FACT_TYPE', f, 1 FROM fact WHERE f = 'Nowhere'
UNION ALL SELECT 'population:fact:Placed', 'FACT_ARITY', k::VARCHAR, len(p) FROM fact WHERE f = 'Placed' AND len(p) <> 2
UNION ALL SELECT 'population:objectification:' || i, 'OBJECTIFICATION_TYPE', i, 1 FROM ob WHERE t = 'Customer'
UNION ALL SELECT 'population:objectification:' || i, 'OBJECTIFICATION_MEMBERSHIP', i, 1 FROM ob WHERE t = 'PlacedRecord' AND i NOT IN (SELECT i FROM mem WHERE t = 'PlacedRecord')
UNION ALL SELECT 'population:objectification:' || i, 'OBJECTIFICATION_FACT', i, 1 FROM ob WHERE t = 'PlacedRecord' AND f <> 'Placed'
UNION ALL SELECT 'population:objectification:' || i, 'OBJECTIFICATION_OCCURRENCE', i, 1 FROM right_ob WHERE k NOT IN (SELECT k FROM fact WHERE f = 'Placed')
UNION ALL SELECT 'population:objectification:' || i, 'OBJECTIFICATION_INJECTIVITY', i, 1 FROM held WHERE i <> (SELECT min(i) FROM held h WHERE h.k = held.k)
UNION ALL SELECT 'set:Placed', 'DUPLICATE_FACT', c || '|' || o, count(*) FROM placed GROUP BY c, o HAVING count(*) > 1
UNION ALL SELECT 'uniqueness:Placed(order)', 'UNIQUENESS_VIOLATION', o, count(DISTINCT c) FROM placed GROUP BY o HAVING count(DISTINCT c) > 1
UNION ALL SELECT 'frequency:Placed(customer):1..12', 'FREQUENCY_VIOLATION', c, count(DISTINCT o) FROM placed GROUP BY c HAVING count(DISTINCT o) > 12
UNION ALL SELECT 'mandatory:Placed(order)', 'MANDATORY_VIOLATION', i, 1 FROM mem WHERE t = 'Order' AND i NOT IN (SELECT o FROM placed)
UNION ALL SELECT 'symmetric:Likes()', 'SYMMETRY_VIOLATION', a || '|' || b, 1 FROM likes l WHERE NOT EXISTS (SELECT 1 FROM likes r WHERE r.a = l.b AND r.b = l.a)
UNION ALL SELECT 'player:Placed.customer', 'ROLE_PLAYER_MEMBERSHIP', c, 1 FROM (SELECT DISTINCT c FROM placed) WHERE c NOT IN (SELECT i FROM mem WHERE t = 'Customer')
UNION ALL SELECT 'player:Placed.order', 'ROLE_PLAYER_MEMBERSHIP', o, 1 FROM (SELECT DISTINCT o FROM placed) WHERE o NOT IN (SELECT i FROM mem WHERE t = 'Order')
UNION ALL SELECT 'player:Likes.a', 'ROLE_PLAYER_MEMBERSHIP', a, 1 FROM (SELECT DISTINCT a FROM likes) WHERE a NOT IN (SELECT i FROM mem WHERE t = 'Customer')
UNION ALL SELECT 'player:Likes.b', 'ROLE_PLAYER_MEMBERSHIP', b, 1 FROM (SELECT DISTINCT b FROM likes) WHERE b NOT IN (SELECT i FROM mem WHERE t = 'Customer')
UNION ALL SELECT 'subtype:Urgent<Order', 'SUBTYPE_VIOLATION', i, 1 FROM mem WHERE t = 'Urgent' AND i NOT IN (SELECT i FROM mem WHERE t = 'Order')""")
def population_violations(spark, d):
    return population.violations(ORDERED, _population(spark, d)).select("obligation_id", "code", F.array_join("key", "|").alias("key"), "n")


RECORDED = Model(
    "Recorded", entities=(Entity("Customer"), Entity("Order")),
    facts=(Fact("Placed", (("customer", "Customer"), ("order", "Order")), "Placing"), Fact("Shipped", (("placing", "Placing"), ("line", "Order")))), rules=(Rule("mandatory", "Shipped", ("placing",)), Rule("uniqueness", "Placed", ("order",))),
)


@query("""WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 40 = 3 THEN o_custkey + 1 ELSE o_custkey END AS c, CASE WHEN o_orderkey % 60 <> 7 THEN o_orderkey END AS o FROM orders WHERE o_orderkey % 9 > 0
  UNION SELECT o_orderkey, o_custkey, o_orderkey FROM orders WHERE o_orderkey % 40 = 3 AND o_orderkey % 9 > 0 UNION SELECT 10000000 + o_orderkey, o_custkey, o_orderkey FROM orders WHERE o_orderkey % 25 = 1),
h AS (SELECT i.*, p.o_orderkey IS NOT NULL AS held FROM i LEFT JOIN orders p ON p.o_orderkey = i.o AND p.o_custkey = i.c), s AS (SELECT DISTINCT l_orderkey AS p FROM lineitem)
SELECT 'objectification:Placing' AS obligation_id, 'OBJECTIFICATION_OCCURRENCE' AS code, id::VARCHAR AS key FROM h GROUP BY id HAVING NOT bool_and(held)
UNION ALL SELECT 'objectification:Placing', 'OBJECTIFICATION_FUNCTION', id::VARCHAR FROM h GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'objectification:Placing', 'OBJECTIFICATION_INJECTIVITY', id::VARCHAR FROM h WHERE held AND id > (SELECT min(g.id) FROM h g WHERE g.held AND g.c = h.c AND g.o = h.o)
UNION ALL SELECT 'player:Shipped.placing', 'ROLE_PLAYER_MEMBERSHIP', p::VARCHAR FROM s WHERE p NOT IN (SELECT id FROM i)
UNION ALL SELECT DISTINCT 'mandatory:Shipped(placing)', 'MANDATORY_VIOLATION', id::VARCHAR FROM i WHERE id NOT IN (SELECT p FROM s)""")
def record_violations(spark, d):
    """Orders as what their customers' placing is objectified as, with wrong, missing, several and shared tuples, and lines that need one."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    wrong, key = F.expr("o_orderkey % 40 = 3"), F.col("o_orderkey")
    own = orders.where("o_orderkey % 9 > 0")
    instances = own.select(key.alias("id"), F.when(wrong, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("c"), F.when(F.expr("o_orderkey % 60 <> 7"), key).alias("o"))
    for more in (own.where(wrong).select(key, "o_custkey", key), orders.where("o_orderkey % 25 = 1").select(key + 10000000, "o_custkey", key)):
        instances = instances.union(more)
    bound = plan.Binding(
        entities={"Customer": (table(spark, d, "customer"), "c_custkey", {}), "Order": (orders, "o_orderkey", {})}, records={"Placing": (instances, "id", {"customer": "c", "order": "o"})},
        facts={"Placed": orders.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order")), "Shipped": lines.select(F.col("l_orderkey").alias("placing"), F.col("l_orderkey").alias("line")).distinct()},
    )
    return plan.violations(RECORDED, bound).select("obligation_id", "code", F.col("key")[0].alias("key"))


@query(f"""WITH {_RELATIONS}, used AS (SELECT DISTINCT unnest(p) AS i FROM fact)
SELECT 'standalone_value' AS gap, t AS element, i AS instance FROM val WHERE i NOT IN (SELECT i FROM used)
UNION ALL SELECT 'unresolved_objectification', t, i FROM mem WHERE t = 'PlacedRecord' AND i NOT IN (SELECT i FROM ob WHERE t = 'PlacedRecord' AND f = 'Placed' AND k IN (SELECT k FROM fact WHERE f = 'Placed'))
UNION ALL SELECT 'invalid_subtype', t, i FROM mem WHERE t = 'Urgent' AND i NOT IN (SELECT i FROM mem WHERE t = 'Order')""")
def representation_gaps(spark, d):
    return population.gaps(ORDERED, _population(spark, d))


@query(f"""WITH {_RELATIONS}, o AS (SELECT i FROM mem WHERE t IN ('Order', 'Urgent')), late AS (SELECT DISTINCT i FROM o WHERE i NOT IN (SELECT o FROM placed))
SELECT 'fact' AS kind, 'Placed' AS "of", count(*) AS n FROM late HAVING count(*) > 0
UNION ALL SELECT 'member', 'Customer', count(*) FROM late HAVING count(*) > 0
UNION ALL SELECT 'member', 'Order', count(*) FROM mem WHERE t = 'Urgent' AND i NOT IN (SELECT i FROM mem WHERE t = 'Order') HAVING count(*) > 0
UNION ALL SELECT 'fact', 'Likes', count(*) FROM likes l WHERE NOT EXISTS (SELECT 1 FROM likes r WHERE r.a = l.b AND r.b = l.a) HAVING count(*) > 0""")
def chase_additions(spark, d):
    """What the population lacks by the rules that ask for more, from the orders that are nobody's to the other way of what is liked."""
    given = _population(spark, d)
    rows = given["facts"].where("fact IN ('Placed', 'Likes') AND size(players) = 2").select(F.lit("0").alias("case"), F.lit("fact").alias("kind"), F.col("fact").alias("of"), F.col("players").alias("row"))
    members = given["memberships"].where("object_type IN ('Customer', 'Order', 'Urgent')").select(F.lit("0").alias("case"), F.lit("member").alias("kind"), F.col("object_type").alias("of"), F.array("instance_id").alias("row"))
    atoms = rows.unionByName(members).distinct()
    return chase.chased(ORDERED, atoms).join(atoms, ["case", "kind", "of", "row"], "left_anti").groupBy("kind", "of").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT DISTINCT o_orderkey % 10 AS c, CASE WHEN o_orderpriority = '1-URGENT' THEN 'standalone_value' ELSE 'multivalued_field' END AS gap FROM orders WHERE o_orderkey % 10 < 7 AND o_orderkey % 10 <> 2 AND (o_orderkey % 10 < 4 OR o_orderpriority <> '1-URGENT')),
c AS (SELECT DISTINCT o_orderkey % 10 AS c FROM orders), s AS (SELECT c, target, CASE WHEN target = 'graph' THEN coalesce(bool_or(gap = 'standalone_value'), false) ELSE false END AS bad, target = 'wide' AND coalesce(bool_or(gap = 'standalone_value'), false) AS u, target = 'wide' AND coalesce(bool_or(gap = 'multivalued_field'), false) AS r
FROM c CROSS JOIN (VALUES ('wide'), ('graph')) t(target) LEFT JOIN g USING (c) GROUP BY c, target)
SELECT target, count(*) FILTER (NOT u AND NOT r AND NOT bad) AS lowered, count(*) FILTER (r AND NOT u) AS representation_prevents_exact_realization, count(*) FILTER (u OR bad) AS unsupported FROM s GROUP BY target""")
def lowering_counts(spark, d):
    orders = table(spark, d, "orders").withColumn("case", (F.col("o_orderkey") % 10).cast("string"))
    gap = F.when(F.col("o_orderpriority") == "1-URGENT", "standalone_value").otherwise("multivalued_field")
    some = orders.where("o_orderkey % 10 < 7 AND o_orderkey % 10 <> 2 AND (o_orderkey % 10 < 4 OR o_orderpriority <> '1-URGENT')")
    rows = population.lowering(some.select("case", gap.alias("gap")), orders.select("case").distinct(), {"wide": population.EFFECTS, "graph": {"standalone_value": "unsupported"}})
    return population.lowering_counts(rows)


SAMPLED = Model(
    "Sampled",
    values=(Value("Priority", "String", allowed=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")),),
    entities=(Entity("Customer"), Entity("Order")),
    facts=(Fact("Ranks", (("customer", "Customer"), ("priority", "Priority"))), Fact("Pair", (("a", "Customer"), ("b", "Customer"))), Fact("Urgent", (("who", "Customer"),)), Fact("Low", (("who", "Customer"),))),
    rules=(Rule("uniqueness", "Ranks", ("customer",)), Rule("frequency", "Ranks", ("customer",), low=3, high=14), Rule("unordered", "Pair", ("a", "b")), Rule("subset", "Urgent", ("who",), "Low", ("who",)), Rule("equality", "Low", ("who",), "Urgent", ("who",)), Rule("exclusion", "Urgent", ("who",), "Low", ("who",))),
)


@query("""WITH s AS (SELECT 'Ranks' AS f, o_orderkey AS k, CASE WHEN o_orderkey % 600 = 5 THEN [o_custkey::VARCHAR] ELSE [o_custkey::VARCHAR, o_orderpriority] END AS p FROM orders
  UNION ALL SELECT 'Pair', n_nationkey, [n_nationkey::VARCHAR, n_regionkey::VARCHAR] FROM nation UNION ALL SELECT 'Pair', 100 + n_nationkey, [n_regionkey::VARCHAR, n_nationkey::VARCHAR] FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT 'Urgent', o_orderkey, [o_custkey::VARCHAR] FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'Low', o_orderkey, [o_custkey::VARCHAR] FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'Lost', r_regionkey, ['x'] FROM region),
r AS (SELECT k, p[1] AS c, p[2] AS o FROM s WHERE f = 'Ranks' AND len(p) = 2), u AS (SELECT p[1] AS w FROM s WHERE f = 'Urgent'), l AS (SELECT p[1] AS w FROM s WHERE f = 'Low')
SELECT DISTINCT 'SAMPLE_UNKNOWN_FACT' AS code, f AS element, f AS key, 1 AS n FROM s WHERE f = 'Lost'
UNION ALL SELECT 'SAMPLE_ARITY', f, k::VARCHAR, len(p) FROM s WHERE f = 'Ranks' AND len(p) <> 2
UNION ALL SELECT 'VALUE_CONSTRAINT_VIOLATION', 'Ranks.priority', k || '|' || o, 1 FROM r WHERE o NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
UNION ALL SELECT 'DUPLICATE_FACT', 'Ranks', c || '|' || o, count(*) FROM r GROUP BY c, o HAVING count(*) > 1
UNION ALL SELECT 'DUPLICATE_FACT', 'Pair', least(p[1], p[2]) || '|' || greatest(p[1], p[2]), count(*) FROM s WHERE f = 'Pair' GROUP BY least(p[1], p[2]), greatest(p[1], p[2]) HAVING count(*) > 1
UNION ALL SELECT 'DUPLICATE_FACT', f, p[1], count(*) FROM s WHERE f IN ('Urgent', 'Low') GROUP BY f, p[1] HAVING count(*) > 1
UNION ALL SELECT 'UNIQUENESS_VIOLATION', 'uniqueness:Ranks(customer)', k || '|' || c, 1 FROM (SELECT *, first_value(o) OVER (PARTITION BY c ORDER BY k) AS first FROM r) WHERE o <> first
UNION ALL SELECT 'FREQUENCY_VIOLATION', 'frequency:Ranks(customer):3..14', c, count(*) FROM r GROUP BY c HAVING count(*) NOT BETWEEN 3 AND 14
UNION ALL SELECT 'SUBSET_VIOLATION', 'subset:Urgent(who):Low(who)', w, 1 FROM (SELECT w FROM u EXCEPT SELECT w FROM l)
UNION ALL SELECT 'EQUALITY_VIOLATION', 'equality:Low(who):Urgent(who)', w, 1 FROM ((SELECT w FROM u EXCEPT SELECT w FROM l) UNION ALL (SELECT w FROM l EXCEPT SELECT w FROM u))
UNION ALL SELECT 'EXCLUSION_VIOLATION', 'exclusion:Urgent(who):Low(who)', w, 1 FROM (SELECT w FROM u INTERSECT SELECT w FROM l)""")
def sample_violations(spark, d):
    orders, nations = table(spark, d, "orders"), table(spark, d, "nation")
    text = lambda c: F.col(c).cast("string")

    def of(df: DataFrame, fact: str, row: str, players) -> DataFrame:
        return df.select(F.lit(fact).alias("fact"), F.expr(row).cast("bigint").alias("row_index"), players.alias("players"))

    ranks = F.when(F.col("o_orderkey") % 600 == 5, F.array(text("o_custkey"))).otherwise(F.array(text("o_custkey"), "o_orderpriority"))
    rows = of(orders, "Ranks", "o_orderkey", ranks)
    for more in (
        of(nations, "Pair", "n_nationkey", F.array(text("n_nationkey"), text("n_regionkey"))), of(nations.where("n_nationkey % 3 = 0"), "Pair", "100 + n_nationkey", F.array(text("n_regionkey"), text("n_nationkey"))),
        of(orders.where("o_orderpriority = '1-URGENT'"), "Urgent", "o_orderkey", F.array(text("o_custkey"))), of(orders.where("o_orderpriority = '5-LOW'"), "Low", "o_orderkey", F.array(text("o_custkey"))), of(table(spark, d, "region"), "Lost", "r_regionkey", F.array(F.lit("x"))),
    ):
        rows = rows.unionByName(more)
    return population.sample_violations(SAMPLED, rows).select("code", "element", F.array_join("key", "|").alias("key"), "n")


@query(f"""{VIOLATIONS}, known(obligation_id) AS (VALUES {', '.join(f"('{r.id}')" for r in COMMERCE.rules)})
SELECT obligation_id, count(o)::BIGINT AS n, count(o) > 0 AS post_state FROM known LEFT JOIN v ON o = obligation_id GROUP BY obligation_id""")
def post_states(spark, d):
    rules = spark.createDataFrame([(r.id,) for r in COMMERCE.rules], "obligation_id string")
    return audit.post_state(plan.violations(COMMERCE, binding(spark, d)), rules)


@query("SELECT event_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS following FROM events")
def following_events(spark, d):
    rows = table(spark, d, "events").select("event_type", "ts", "event_id", "user_id")
    return facts.following(rows, "event_type", ["ts", "event_id"], "user_id", F.date_trunc("hour", "ts")).select("event_id", "following")


# -- revisions: each part is one, with a half and a third of its number before it ------------------------------------------


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("revision"))
    before = F.array_distinct(F.array(F.expr("revision div 2"), F.expr("revision div 3")))
    return parts.select("revision", F.explode(before).alias("parent")).select("revision", F.when((F.col("parent") > 0) & (F.col("parent") < F.col("revision")), F.col("parent")).alias("parent"))


_UP = """RECURSIVE p AS (SELECT DISTINCT p_partkey AS revision, CASE WHEN x > 0 AND x < p_partkey THEN x END AS parent FROM part, LATERAL (SELECT unnest([p_partkey // 2, p_partkey // 3]) AS x)),
n AS (SELECT revision FROM p UNION SELECT parent FROM p WHERE parent IS NOT NULL),
r(revision, ancestor, depth) AS (SELECT revision, revision, 0 FROM n UNION SELECT r.revision, p.parent, depth + 1 FROM r JOIN p ON r.ancestor = p.revision WHERE p.parent IS NOT NULL),
up AS (SELECT revision, ancestor, min(depth)::INTEGER AS depth FROM r GROUP BY revision, ancestor)"""


@query(f"WITH {_UP} SELECT * FROM up")
def dag_ancestors_all(spark, d):
    return graph.ancestors(_revisions(spark, d))


@query(f"""WITH {_UP}, w AS (SELECT p_partkey AS ours, p_partkey * 7 % 1000 + 1 AS theirs FROM part WHERE p_partkey * 7 % 1000 + 1 <= (SELECT max(p_partkey) FROM part))
SELECT ours, theirs, base FROM (SELECT ours, theirs, a.ancestor AS base, row_number() OVER (PARTITION BY ours, theirs ORDER BY greatest(a.depth, b.depth), a.depth + b.depth, a.ancestor) AS k
FROM w JOIN up a ON a.revision = ours JOIN up b ON b.revision = theirs AND b.ancestor = a.ancestor) WHERE k = 1""")
def merge_base_all(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("ours"), (F.col("p_partkey") * 7 % 1000 + 1).alias("theirs"))
    there = parts.agg(F.max("ours")).first()[0] or 0
    return graph.merge_base(_revisions(spark, d), parts.where(F.col("theirs") <= there))


@query(f"WITH {_UP}, w AS (SELECT p_partkey AS new, p_partkey // 9 AS old FROM part UNION ALL SELECT p_partkey, p_partkey // 7 FROM part) SELECT old, new, EXISTS (SELECT 1 FROM up WHERE revision = new AND ancestor = old) AS fast_forward FROM w")
def fast_forward_all(spark, d):
    pairs = table(spark, d, "part").select(F.expr("explode(array(p_partkey div 9, p_partkey div 7))").alias("old"), F.col("p_partkey").alias("new"))
    return graph.fast_forward(_revisions(spark, d), pairs)


@query(f"WITH {_UP} SELECT ancestor, depth FROM up WHERE revision = (SELECT max(p_partkey) FROM part)")
def revision_closure_all(spark, d):
    head = table(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    return graph.closure_order(_revisions(spark, d), head)


# -- models ----------------------------------------------------------------------------------------------------------------

#: The verdicts that the portability corpus expects of three targets, P preserved as claimed and W weakened.
EXPECTED = {
    "binary_role_uniqueness": ["PPP"], "compound_identifier": ["PPW"], "date_enum": ["PWP"], "decimal_range": ["PWP"], "frequency_max_one": ["PPP"], "frequency_max_two": ["WWP"], "frequency_min_one_max_two": ["WWW"],
    "nary_partial_uniqueness": ["PPW"], "nary_set_semantics": ["PPW"], "objectification": ["PWP"], "set_constraints": ["WWW", "WWW", "WWW"], "simple_identifier": ["PPP"], "subtype": ["PWP"], "symmetry": ["WWW"],
    "total_participation": ["WWP"], "unary_fact_set": ["PPW"], "unordered_roles": ["PPW"], "value_enum": ["PPP"], "value_range": ["PPP"], "value_role_range": ["PPP"],
}
TARGETS = ["postgres", "mongo", "typedb"]
_FOCAL = ", ".join(f"('{case}', {k}, '{t}', '{'preserved_claimed' if said[j] == 'P' else 'weakened'}')" for case, rows in EXPECTED.items() for k, said in enumerate(rows) for j, t in enumerate(TARGETS))


@query(f"SELECT * FROM (VALUES {_FOCAL}) t(\"case\", focus, target, preservation)")
def portability_verdicts(spark, d):
    """The verdict on each obligation in focus, from the rules of its model."""
    found = None
    for case, (model, focus) in portability.CORPUS.items():
        named = spark.createDataFrame([(case, k, o) for k, o in enumerate(focus)], "case string, focus int, obligation_id string")
        known = spark.createDataFrame([(f"{case}/{o}", f) for o, _, f in audit.features(model)], "obligation_id string, feature string")
        rows = named.withColumn("obligation_id", F.concat("case", F.lit("/"), "obligation_id")).join(known, "obligation_id")
        found = rows if found is None else found.unionByName(rows)
    none = lambda ddl: spark.createDataFrame([], ddl)
    cases, live, shared = none("obligation_id string, target string, case_id string, runtime boolean"), none("target string, case_id string, passed boolean"), none("obligation_id string, target string, passed boolean")
    verdicts = audit.verdicts(found.select("obligation_id", "feature"), audit.capabilities(spark), cases, live, shared, TARGETS)
    return found.join(verdicts, "obligation_id").select("case", "focus", "target", "preservation")


#: What the experiments flip: the case in focus, and the target that then no longer keeps it.
_FLIPPED = [
    ("postgres_fact_key", "nary_set_semantics"), ("postgres_fact_key", "unary_fact_set"), ("postgres_check", "value_enum"), ("postgres_check", "value_range"), ("postgres_check", "value_role_range"),
    ("mongo_unique_index", "binary_role_uniqueness"), ("typedb_card", "total_participation"), ("typedb_key", "simple_identifier"),
]


@query(f"SELECT * FROM (VALUES {', '.join(map(repr, _FLIPPED))}) t(mutation_id, \"case\")")
def mutation_flips(spark, d):
    """The cases of the corpus that each experiment's target enforces before it and not after."""
    rows = [(c, f) for c, (model, focus) in portability.CORPUS.items() for o, _, f in audit.features(model) if o in focus]
    focal = spark.createDataFrame(rows, "case string, feature string")
    mutations = spark.createDataFrame(audit.MUTATIONS, "mutation_id string, target string, feature string")
    declared = audit.capabilities(spark)
    after = audit.mutated(declared, mutations).select("mutation_id", "feature", "target", F.col("status").alias("after"))
    both = focal.join(after, "feature").join(declared, ["feature", "target"])
    return both.where(F.col("status").isin(audit.ENFORCED) & ~F.col("after").isin(audit.ENFORCED)).select("mutation_id", "case").distinct()


TEAM = Model(
    "Team", values=(Value("Name", "String"), Value("Age", "Int", 0, 130)), entities=(Entity("Person", ("name",), (("name", "Name", True), ("age", "Age", False), ("nick", "Name", False))), Entity("Team"), Entity("Gone")),
    facts=(Fact("Member", (("who", "Person"), ("team", "Team"))),), rules=(Rule("frequency", "Member", ("who",), low=0, high=1),),
)
LATER = replace(
    TEAM, values=(Value("Name", "String"), Value("Age", "Int", 18, 130), Value("Rank", "Int")), entities=(Entity("Human", ("name",), (("name", "Name", True), ("age", "Age", True), ("rank", "Rank", True))), Entity("Team")),
    facts=(Fact("Member", (("person", "Human"), ("team", "Team"))), Fact("Leads", (("who", "Human"),))), rules=(), _by_name={},
)
_OPERATIONS = [
    ("rename", "rename_table", "Human", "Person", "safe"), ("rename", "rename_column", "Member", "who to person", "safe"), ("create", "create_table", "Leads", "", "safe"), ("shape", "add_column_staged", "Human", "rank", "safe"),
    ("constraints", "add_check", "Human", "age: age BETWEEN 18 AND 130", "requires_data_check"), ("constraints", "set_not_null", "Human", "age", "requires_data_check"), ("constraints", "set_not_null_after_backfill", "Human", "rank", "requires_data_check"),
    ("foreign_keys", "add_foreign_key", "Leads", "who: Human(name)", "safe"), ("cleanup", "drop_table", "Gone", "", "destructive"), ("cleanup", "drop_column", "Human", "nick", "destructive"),
    ("manual", "drop_check", "Human", "age: age BETWEEN 0 AND 130", "manual"), ("manual", "drop_unique", "Member", "person", "manual"),
]


@query(f"SELECT * FROM (VALUES {', '.join(map(repr, _OPERATIONS))}) t(phase, kind, target, subject, safety)")
def migration_operations(spark, d):
    hints = spark.createDataFrame([("object", "Person", "Human"), ("role", "Member.who", "Member.person")], "element string, before_name string, after_name string")
    return catalog.operations(spark, TEAM, LATER, hints).drop("automatic")


# -- small relations -------------------------------------------------------------------------------------------------------


@query("SELECT * FROM lineitem WHERE NOT (l_quantity <= 45) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate LIMIT 20")
def check_probe(spark, d):
    return evolution.first_rows(evolution.check_rows(table(spark, d, "lineitem"), "l_quantity <= 45"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


@query("SELECT p_brand, p_type, p_size, count(*) AS n FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL GROUP BY ALL HAVING count(*) > 1 ORDER BY p_brand, p_type, p_size LIMIT 20")
def unique_probe(spark, d):
    return evolution.first_rows(evolution.unique_groups(table(spark, d, "part"), "p_brand", "p_type", "p_size"), "p_brand", "p_type", "p_size")


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' ELSE p_brand END AS brand, CASE WHEN p_size < 5 THEN 5 WHEN p_size > 45 THEN 45 ELSE p_size END AS size, 5 + (p_size - 5)::DOUBLE * 0.25::DOUBLE AS quarter FROM part")
def scalar_helpers(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", scalar.aliased(F.col("p_brand"), {"Brand#11": "first", "Brand#12": "second"}).alias("brand"), scalar.clamped(size, F.lit(5), F.lit(45)).alias("size"), scalar.part_way(F.lit(5.0), size.cast("double"), 0.25).alias("quarter")
    )


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS s FROM orders), x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE s END AS s FROM o), y AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE s END AS s FROM o)
SELECT o_orderkey, substr(sha256('{"p00":"row","p01":"' || o_orderkey || '","p02":"{\\"s\\":\\"' || o.s || '\\"}","p03":"{\\"s\\":\\"' || x.s || '\\"}","p04":"{\\"s\\":\\"' || y.s || '\\"}"}'), 1, 24) AS conflict_id FROM o JOIN x USING (o_orderkey) JOIN y USING (o_orderkey) WHERE o_orderkey % 6 = 0""")
def conflict_ids(spark, d):
    """Conflicts are named by the hash of their content as JSON."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("s"))
    side = lambda m, s: rows.withColumn("s", F.when(F.col("o_orderkey") % m == 0, s).otherwise(F.col("s")))
    return evolution.merge(rows, side(3, "X"), side(2, "Y"), "o_orderkey", ["s"]).where("outcome = 'conflict'").select("o_orderkey", "conflict_id")


@query(f"""WITH {_RELATIONS}, used AS (SELECT DISTINCT unnest(p) AS i FROM fact)
SELECT 'Size' AS value_type, count(*) AS standalone FROM val WHERE i NOT IN (SELECT i FROM used) AND t = 'Size' GROUP BY t""")
def standalone_values(spark, d):
    found = population.gaps(ORDERED, _population(spark, d)).where("gap = 'standalone_value' AND element = 'Size'")
    return found.groupBy(F.col("element").alias("value_type")).agg(F.count(F.lit(1)).alias("standalone"))


def _regions(spark: SparkSession, d: str) -> Model:
    """A model with a fact for each region, bounded by how many nations it has; a model's declarations live on the driver."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "region").join(n, "r_regionkey").orderBy("r_regionkey").collect()
    rules = [Rule("frequency", f"In{r.r_regionkey}", ("nation",), low=1, high=r.n) for r in rows]
    rules += [Rule("uniqueness", f"In{r.r_regionkey}", ("who",)) for r in rows if r.r_regionkey % 2 == 0] + [Rule("mandatory", f"In{r.r_regionkey}", ("who",)) for r in rows if r.r_regionkey % 3 == 1]
    return Model("Regions", entities=(Entity("Person"), Entity("Nation")), facts=tuple(Fact(f"In{r.r_regionkey}", (("who", "Person"), ("nation", "Nation"))) for r in rows), rules=tuple(rules))


_PER_REGION = "r AS (SELECT r_regionkey AS k, count(n_nationkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1), c AS (SELECT count(*) AS facts, count(*) FILTER (k % 2 = 0) AS uniq, count(*) FILTER (k % 3 = 1) AS due FROM r)"


@query(f"WITH {_PER_REGION} SELECT 'isolated' AS status, false AS implied, 4 * facts + uniq + due AS n FROM c")
def counterexample_counts(spark, d):
    """Each rule of the regions' model, its facts' set semantics and their players' types can be broken alone, and none follows from the others."""
    return audit.counts_by(witness.counterexamples(spark, _regions(spark, d)), "status", "implied")


@query(f"WITH {_PER_REGION} SELECT true AS accepted, 3 * facts + uniq + due AS n FROM c")
def probe_counts(spark, d):
    """A row of each fact, as little and as much as each frequency allows, two keys and a member that takes part."""
    return audit.counts_by(witness.probes(spark, _regions(spark, d)), "accepted")


@query(f"""WITH {_PER_REGION}, f AS (SELECT 'fact-set' AS native, 'gap-set' AS gap, facts AS n, ['N', 'N', 'R'] AS told FROM c UNION ALL SELECT 'unique', 'gap-set', uniq, ['N', 'N', 'N'] FROM c UNION ALL SELECT 'frequency', 'gap-frequency', facts, ['R', 'R', 'R'] FROM c UNION ALL SELECT 'mandatory', 'gap-mandatory', due, ['R', 'R', 'N'] FROM c),
t AS (SELECT native, gap, n, unnest({TARGETS!r}) AS target, unnest(told) AS status FROM f)
SELECT CASE WHEN status = 'N' THEN native ELSE gap END AS family, target, true AS runtime, sum(CASE WHEN status = 'N' THEN 2 * n ELSE n END)::BIGINT AS n FROM t GROUP BY 1, 2 HAVING sum(n) > 0""")
def conformance_case_counts(spark, d):
    """A valid and a violating case for each rule that a target enforces, and a probe of the gap for the others."""
    return audit.counts_by(audit.conformance_cases(spark, _regions(spark, d), TARGETS), "family", "target", "runtime")
