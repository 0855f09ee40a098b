"""Registered queries over graphs that the test tables hold: histories of orders, trees of parts, references between tables; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolewise.operators import ancestry, graph
from rolewise.queries import query
from rolewise.sources.tables import table

# -- a history of orders: each is after the one before of its customer, and an urgent one also after that of a third of its number ------------


def history(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    one = orders.select(F.col("o_orderkey").alias("revision"), before.alias("parent"))
    return one.unionByName(orders.where("o_orderpriority = '1-URGENT' AND o_orderkey > 0").select(F.col("o_orderkey").alias("revision"), F.expr("o_orderkey div 3").alias("parent")))


_HISTORY = """p AS (SELECT o_orderkey AS revision, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders
  UNION SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey > 0), e AS (SELECT DISTINCT revision, parent FROM p WHERE parent IS NOT NULL)"""


def _up(heads: str) -> str:
    """Ancestors of the heads with their distances; a row is met again only at another distance."""
    return f"""RECURSIVE {_HISTORY}, h AS ({heads}), r(revision, ancestor, depth) AS (SELECT DISTINCT h, h, 0 FROM h UNION SELECT r.revision, e.parent, depth + 1 FROM r JOIN e ON r.ancestor = e.revision),
up AS (SELECT revision, ancestor, min(depth)::INTEGER AS depth FROM r GROUP BY revision, ancestor)"""


@query(f"WITH {_up('SELECT max(o_orderkey) AS h FROM orders GROUP BY o_orderpriority, o_orderstatus')} SELECT * FROM up")
def dag_ancestors(spark, d):
    """What is before the last order of each priority and status."""
    heads = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.max("o_orderkey").alias("revision"))
    return ancestry.ancestors_of(history(spark, d), heads)


@query(f"""WITH {_up('SELECT max(o_orderkey) AS h FROM orders GROUP BY o_custkey')}, w AS (SELECT a.h AS ours, b.h AS theirs FROM (SELECT o_custkey AS c, max(o_orderkey) AS h FROM orders GROUP BY 1) a JOIN (SELECT o_custkey AS c, max(o_orderkey) AS h FROM orders GROUP BY 1) b ON b.c = a.c + 1)
SELECT ours, theirs, base FROM (SELECT ours, theirs, a.ancestor AS base, row_number() OVER (PARTITION BY ours, theirs ORDER BY greatest(a.depth, b.depth), a.depth + b.depth, a.ancestor) AS k
FROM w JOIN up a ON a.revision = ours JOIN up b ON b.revision = theirs AND b.ancestor = a.ancestor) WHERE k = 1""")
def merge_base(spark, d):
    """Of the last orders of each customer and the next one."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.max("o_orderkey").alias("h"))
    pairs = last.toDF("c", "ours").join(last.select((F.col("c") - 1).alias("c"), F.col("h").alias("theirs")), "c")
    return graph.merge_base(history(spark, d), pairs.select("ours", "theirs"))


@query(f"""WITH {_up('SELECT max(o_orderkey) AS h FROM orders GROUP BY o_custkey')}, w AS (SELECT k // 3 AS old, k AS new FROM (SELECT max(o_orderkey) AS k FROM orders GROUP BY o_custkey) UNION ALL SELECT min(o_orderkey), max(o_orderkey) FROM orders GROUP BY o_custkey)
SELECT old, new, EXISTS (SELECT 1 FROM up WHERE revision = new AND ancestor = old) AS fast_forward FROM w""")
def fast_forward(spark, d):
    """From a third of the number, and from the customer's first order, to the last of each customer."""
    ends = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("old"), F.max("o_orderkey").alias("new"))
    return graph.fast_forward(history(spark, d), ends.select(F.expr("new div 3").alias("old"), "new").unionByName(ends.select("old", "new")))


@query(f"WITH {_up('SELECT max(o_orderkey) AS h FROM orders')} SELECT ancestor, depth FROM up")
def revision_closure(spark, d):
    """All that is before the last order."""
    return graph.closure_order(history(spark, d), table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0])


@query(f"""WITH RECURSIVE {_HISTORY}, r(node, level) AS (SELECT revision, 0 FROM p EXCEPT SELECT revision, 0 FROM e UNION SELECT e.revision, level + 1 FROM r JOIN e ON e.parent = r.node)
SELECT node, max(level) AS level FROM r GROUP BY node""")
def revision_levels(spark, d):
    """The longest way from each order back to one without any before it."""
    at, cycles = ancestry.levels(history(spark, d).toDF("src", "dst"))
    if not cycles.isEmpty():
        raise ValueError("a history has no cycles")
    return at


# -- trees and references --------------------------------------------------------------------------------------------------


def part_tree(spark: SparkSession, d: str) -> DataFrame:
    """Each part is below that of a fourth of its number; every seventh of a size is by itself."""
    rows = table(spark, d, "part")
    return rows.select(F.col("p_partkey").alias("sub"), F.when((F.col("p_partkey") > 0) & (F.col("p_size") % 7 > 0), F.expr("p_partkey div 4")).alias("sup"))


_TREE = """t AS (SELECT DISTINCT p_partkey AS sub, CASE WHEN p_partkey > 0 AND p_size % 7 > 0 THEN p_partkey // 4 END AS sup FROM part),
r(sub, sup, depth) AS (SELECT sub, sub, 0 FROM t UNION ALL SELECT r.sub, t.sup, depth + 1 FROM r JOIN t ON t.sub = r.sup WHERE t.sup IS NOT NULL)"""


@query(f"WITH RECURSIVE {_TREE} SELECT sub AS src, sup AS dst, depth::INTEGER AS depth FROM r WHERE depth > 0")
def subtype_closure(spark, d):
    return graph.closure(part_tree(spark, d).toDF("src", "dst"))


@query(f"""WITH RECURSIVE {_TREE}, w AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem UNION SELECT l_partkey, l_partkey // 16 FROM lineitem)
SELECT a AS sub, b AS sup, EXISTS (SELECT 1 FROM r WHERE r.sub = a AND r.sup = b) AS below FROM w""")
def subtype_below(spark, d):
    """Whether the part of a line is below that with its supplier's number, or with a sixteenth of its own: by intervals, not by a closure."""
    lines = table(spark, d, "lineitem")
    pairs = lines.select(F.col("l_partkey").alias("sub"), F.col("l_suppkey").alias("sup")).unionByName(lines.select(F.col("l_partkey").alias("sub"), F.expr("l_partkey div 16").alias("sup"))).distinct()
    return ancestry.is_below(ancestry.intervals(part_tree(spark, d)), pairs)


@query(f"WITH RECURSIVE {_TREE} SELECT r.sub AS type, arg_min(r.sup, depth) AS owner, min(depth)::INTEGER AS depth FROM r WHERE r.sup IN (SELECT p_partkey FROM part WHERE p_size <= 6) GROUP BY r.sub")
def effective_identifier(spark, d):
    """The nearest small part at or above each."""
    return graph.effective_identifier(part_tree(spark, d), table(spark, d, "part").where("p_size <= 6").select(F.col("p_partkey").alias("type")))


_JUMPS = "e AS (SELECT DISTINCT p_partkey AS a, (p_partkey * p_partkey * 31 + p_size) % (SELECT count(*) FROM part) AS b FROM part WHERE p_size <> 20)"


@query(f"""WITH RECURSIVE {_JUMPS}, r(a, b, k) AS (SELECT a, b, 1 FROM e UNION ALL SELECT r.a, e.b, k + 1 FROM r JOIN e ON e.a = r.b WHERE k < 400 AND r.a <> r.b)
SELECT a AS node FROM r WHERE a = b""")
def subtype_cycles(spark, d):
    """Parts on a ring, if each leads to the one that a polynomial of its number and size gives."""
    rows = table(spark, d, "part")
    n = rows.count()
    return graph.cycles(rows.where("p_size <> 20").select(F.col("p_partkey").alias("src"), F.expr(f"(p_partkey * p_partkey * 31 + p_size) % {max(n, 1)}").alias("dst")))


@query(f"""WITH RECURSIVE {_JUMPS}, r(a, b, k) AS (SELECT a, b, 1 FROM e UNION ALL SELECT r.a, e.b, k + 1 FROM r JOIN e ON e.a = r.b WHERE k < 400 AND r.a <> r.b), on_ring AS (SELECT a FROM r WHERE a = b)
SELECT a AS node, least(a, min(b)) AS cycle FROM r JOIN on_ring USING (a) GROUP BY a""")
def named_cycles(spark, d):
    """The same rings, each by its least part."""
    rows = table(spark, d, "part")
    n = rows.count()
    return ancestry.cycles(rows.where("p_size <> 20").select(F.col("p_partkey").alias("src"), F.expr(f"(p_partkey * p_partkey * 31 + p_size) % {max(n, 1)}").alias("dst")))


@query("SELECT l_partkey AS player, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS roles, count(DISTINCT l_orderkey) AS n_facts FROM lineitem GROUP BY l_partkey")
def incidence_index(spark, d):
    """Every order is a fact, with its lines' numbers as roles that parts play."""
    roles = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact"), F.col("l_linenumber").cast("string").alias("role"), F.col("l_partkey").alias("player"))
    return graph.incidence(roles).select("player", F.array_join(F.array_distinct("roles"), ",").alias("roles"), "n_facts")


@query("SELECT l_orderkey AS fact, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4")
def uniform_arity(spark, d):
    roles = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact"), F.col("l_linenumber").alias("role"), F.col("l_partkey").alias("player"))
    return graph.uniform(roles, 4)


@query("""WITH f AS (SELECT DISTINCT 'o' || o_orderkey AS fact FROM orders WHERE o_orderstatus <> 'F'), o AS (SELECT 'p' || p_partkey AS object FROM part WHERE p_size % 9 <> 0)
SELECT DISTINCT 'UNKNOWN_PLAYER' AS code, l_orderkey || '.' || l_linenumber AS element, 'p' || l_partkey AS missing FROM lineitem WHERE 'p' || l_partkey NOT IN (SELECT object FROM o)
UNION ALL SELECT DISTINCT 'ROLE_WRONG_FACT', l_orderkey || '.' || l_linenumber, 'o' || l_orderkey FROM lineitem WHERE 'o' || l_orderkey NOT IN (SELECT fact FROM f)
UNION ALL SELECT DISTINCT 'READING_UNKNOWN_FACT', 'reading' || event_id, 'o' || user_id * 31 FROM events WHERE 'o' || user_id * 31 NOT IN (SELECT fact FROM f)
UNION ALL SELECT DISTINCT 'SAMPLE_UNKNOWN_FACT', 'sample' || doc_id, 'o' || n_chars FROM documents WHERE n_chars IS NOT NULL AND 'o' || n_chars NOT IN (SELECT fact FROM f)
UNION ALL SELECT DISTINCT 'SUBTYPE_UNKNOWN_TYPE', 'p' || p_partkey, 'p' || p_partkey // 3 FROM part WHERE 'p' || p_partkey // 3 NOT IN (SELECT object FROM o)
UNION ALL SELECT DISTINCT 'CONSTRAINT_UNKNOWN_ROLE', 'unique' || s_suppkey, s_suppkey || '.' || s_nationkey FROM supplier WHERE s_suppkey || '.' || s_nationkey NOT IN (SELECT l_orderkey || '.' || l_linenumber FROM lineitem)""")
def dangling_references(spark, d):
    """Orders as facts, their lines as roles, parts as objects, and what in other tables refers to them."""
    text = lambda prefix, c: F.concat(F.lit(prefix), F.expr(c).cast("string"))
    line = F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    orders, parts, lines = (table(spark, d, t) for t in ("orders", "part", "lineitem"))
    return graph.dangling({
        "facts": orders.where("o_orderstatus <> 'F'").select(text("o", "o_orderkey").alias("element"), text("o", "o_orderkey").alias("fact")),
        "objects": parts.where("p_size % 9 <> 0").select(text("p", "p_partkey").alias("element"), text("p", "p_partkey").alias("object")),
        "roles": lines.select(line.alias("element"), line.alias("role"), text("o", "l_orderkey").alias("fact"), text("p", "l_partkey").alias("player")),
        "readings": table(spark, d, "events").select(text("reading", "event_id").alias("element"), text("o", "user_id * 31").alias("fact")),
        "samples": table(spark, d, "documents").select(text("sample", "doc_id").alias("element"), text("o", "n_chars").alias("fact")),
        "subtypes": parts.select(text("p", "p_partkey").alias("element"), text("p", "p_partkey div 3").alias("object")),
        "constraint_roles": table(spark, d, "supplier").select(text("unique", "s_suppkey").alias("element"), F.concat_ws(".", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")).alias("role")),
    })


@query("""WITH RECURSIVE u AS (SELECT DISTINCT p_partkey AS a, p_partkey // 5 AS b FROM part WHERE p_size > 10 AND p_partkey > 0 AND p_partkey // 5 IN (SELECT p_partkey FROM part WHERE p_size <> 33)),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS fact, b AS needs, (SELECT count(*) FROM r s WHERE s.a = r.b) AS under FROM r""")
def objectified_order(spark, d):
    """Parts as facts that are played by what objectifies the part of a fifth of their number."""
    parts = table(spark, d, "part")
    roles = parts.where("p_size > 10 AND p_partkey > 0").select(F.col("p_partkey").alias("fact"), F.lit("on").alias("role"), F.concat(F.lit("record"), F.expr("p_partkey div 5").cast("string")).alias("player"))
    types = parts.where("p_size <> 33").select(F.concat(F.lit("record"), F.col("p_partkey").cast("string")).alias("type"), F.col("p_partkey").alias("fact"))
    return graph.objectified_order(roles, types)


@query("""WITH RECURSIVE f AS (SELECT DISTINCT p_partkey AS a FROM part WHERE p_size > 10 AND p_partkey > 0), u AS (SELECT a, a // 5 AS b FROM f WHERE a // 5 IN (SELECT p_partkey FROM part WHERE p_size <> 33)), n AS (SELECT a FROM f UNION SELECT b FROM u),
r(fact, step) AS (SELECT a, 0 FROM n WHERE a NOT IN (SELECT a FROM u) UNION ALL SELECT u.a, step + 1 FROM r JOIN u ON u.b = r.fact) SELECT fact, max(step) AS step FROM r GROUP BY fact""")
def build_steps(spark, d):
    """In which step each of the same facts can be built."""
    parts = table(spark, d, "part")
    roles = parts.where("p_size > 10 AND p_partkey > 0").select(F.col("p_partkey").alias("fact"), F.lit("on").alias("role"), F.concat(F.lit("record"), F.expr("p_partkey div 5").cast("string")).alias("player"))
    types = parts.where("p_size <> 33").select(F.concat(F.lit("record"), F.col("p_partkey").cast("string")).alias("type"), F.col("p_partkey").alias("fact"))
    steps, cycles = graph.build_order(roles, types)
    return steps
