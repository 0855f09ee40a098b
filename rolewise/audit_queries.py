"""Registered queries of verdicts, experiments, changes and documents over thousands of elements that the test tables give, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.functions.canonical import canonical, content_id, differences
from rolewise.operators import audit, evolution, facts, revisions
from rolewise.plans import catalog
from rolewise.queries import query
from rolewise.sources.tables import table

# -- verdicts: parts are obligations with their brand as feature; lines of orders are cases, and those of few pieces have run --------------------

_STATUSES = ["native_enforced", "represented_not_enforced", "metadata_only", "unsupported", "emulated_enforced"]
_TARGETS = ["t0", "t1", "t2", "t9"]


def _pick(values: list[str], number: str) -> Column:
    return F.element_at(F.lit(values), (F.expr(number) + 1).cast("int"))


def _relations(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    parts, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    obligations = parts.select(F.col("p_partkey").cast("string").alias("obligation_id"), F.col("p_brand").alias("feature"))
    declared = parts.groupBy(F.col("p_brand").alias("feature"), F.concat(F.lit("t"), F.expr("p_partkey % 4").cast("string")).alias("target")).agg(F.expr("max(p_partkey * 7 + p_size) % 5").alias("k"))
    declared = declared.where("target <> 't3'").select("feature", "target", _pick(_STATUSES, "k").alias("status"))
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"), F.min("l_quantity").alias("q"), F.min("l_discount").alias("x"))
    one = one.select(F.col("p").cast("string").alias("obligation_id"), F.concat(F.lit("t"), F.expr("l_linenumber % 3").cast("string")).alias("target"), F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("case_id"), (F.col("f") != "N").alias("runtime"), "q", "x")
    live = one.where("q < 45").select("target", "case_id", (F.col("x") < 0.095).alias("passed"))
    shared = parts.where("p_size % 10 = 0").select(F.col("p_partkey").cast("string").alias("obligation_id"), F.lit("t1").alias("target"), F.when(F.col("p_size") != 30, F.col("p_size") > 30).alias("passed"))
    return obligations, declared, one.select("obligation_id", "target", "case_id", "runtime"), live, shared


_VERDICTS = f"""o AS (SELECT p_partkey::VARCHAR AS id, p_brand AS feature FROM part),
dec AS (SELECT p_brand AS feature, 't' || p_partkey % 4 AS target, list_extract({_STATUSES!r}, (max(p_partkey * 7 + p_size) % 5)::INTEGER + 1) AS status FROM part WHERE p_partkey % 4 <> 3 GROUP BY ALL),
line AS (SELECT min(l_partkey)::VARCHAR AS id, 't' || l_linenumber % 3 AS target, min(l_returnflag) <> 'N' AS runtime, CASE WHEN min(l_quantity) < 45 THEN min(l_discount) < 0.095 END AS passed FROM lineitem GROUP BY l_orderkey, l_linenumber),
seen AS (SELECT id, target, count(*) FILTER (runtime) AS r, count(*) FILTER (runtime AND passed IS NOT NULL) AS l, count(*) FILTER (runtime AND passed) AS k, count(*) FILTER (NOT runtime) AS s FROM line GROUP BY ALL),
proof AS (SELECT p_partkey::VARCHAR AS id, 't1' AS target, CASE WHEN p_size <> 30 THEN p_size > 30 END AS proved, true AS has FROM part WHERE p_size % 10 = 0),
j AS (SELECT o.id, t.target, status, coalesce(r, 0) AS r, coalesce(l, 0) AS l, coalesce(k, 0) AS k, coalesce(s, 0) AS s, proved, coalesce(has, false) AND status IS NOT NULL AS has, status IN ('native_enforced', 'emulated_enforced') AS enforced
  FROM o CROSS JOIN (SELECT unnest({_TARGETS!r}) AS target) t LEFT JOIN dec ON dec.feature = o.feature AND dec.target = t.target LEFT JOIN seen ON seen.id = o.id AND seen.target = t.target LEFT JOIN proof ON proof.id = o.id AND proof.target = t.target),
v AS (SELECT *, CASE WHEN has AND NOT proved THEN 'claim_falsified' WHEN has AND proved AND enforced THEN 'preserved_observed' WHEN has AND proved AND status = 'represented_not_enforced' THEN 'weakened_observed' END AS by_proof,
  CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'unsupported' THEN 'lost' WHEN status = 'metadata_only' THEN status WHEN status = 'represented_not_enforced' THEN CASE WHEN r > 0 AND l = r AND k = l THEN 'weakened_observed' ELSE 'weakened' END
       WHEN r > 0 AND l = r AND k = l THEN 'preserved_observed' WHEN l > 0 AND k < l THEN 'claim_falsified' ELSE 'preserved_claimed' END AS by_cases FROM j),
w AS (SELECT id AS obligation_id, target, coalesce(by_proof, by_cases) AS preservation, CASE WHEN by_proof IS NOT NULL THEN 'shared_semantic_witness' WHEN l > 0 AND (l = r OR by_cases = 'claim_falsified') THEN 'legacy_target_witness'
  WHEN r > 0 THEN 'generated_target_witness' WHEN s > 0 THEN 'structural' WHEN status IS NOT NULL THEN 'capability_declaration' ELSE 'none' END AS evidence_source FROM v)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return audit.verdicts(*_relations(spark, d), _TARGETS)


@query(f"WITH {_VERDICTS} SELECT obligation_id, target, preservation FROM w")
def verdict_matrix(spark, d):
    return _judged(spark, d).select("obligation_id", "target", "preservation")


@query(f"WITH {_VERDICTS} SELECT obligation_id, target, preservation, evidence_source FROM w")
def verdict_evidence(spark, d):
    return _judged(spark, d).select("obligation_id", "target", "preservation", "evidence_source")


@query(f"""WITH {_VERDICTS} SELECT target, count(*) AS obligations, {', '.join(f"count(*) FILTER (preservation = '{v}') AS {v}" for v in audit.VERDICTS)},
count(*) FILTER (evidence_source IN ('shared_semantic_witness', 'legacy_target_witness')) AS live_observed FROM w GROUP BY target""")
def verdict_summary(spark, d):
    return audit.verdict_summary(_judged(spark, d))


@query(f"""WITH {_VERDICTS}, n AS (SELECT DISTINCT target, feature FROM dec WHERE status = 'native_enforced'), c AS (SELECT DISTINCT 't' || s_suppkey % 3 AS target, 'Brand#' || s_nationkey + 11 AS feature FROM supplier)
SELECT n.target, count(*) AS native, count(c.feature) AS covered, count(*) = count(c.feature) AS complete FROM n LEFT JOIN c USING (target, feature) GROUP BY n.target""")
def conformance_coverage(spark, d):
    cases = table(spark, d, "supplier").select(F.concat(F.lit("t"), F.expr("s_suppkey % 3").cast("string")).alias("target"), F.concat(F.lit("Brand#"), F.expr("s_nationkey + 11").cast("string")).alias("feature"))
    return audit.coverage(_relations(spark, d)[1], cases)


@query("""SELECT DISTINCT o_orderkey AS obligation_id, 't' || s_nationkey % 3 AS target, s_suppkey AS case_id, s_acctbal > 0 AS runtime FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderstatus = 'F'""")
def cases_by_element(spark, d):
    """Orders that are done with the suppliers that share a part with them."""
    lines = table(spark, d, "lineitem")
    of = lambda key: lines.groupBy(key).agg(F.collect_set(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string"))).alias("elements"))
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    obligations = of("l_orderkey").join(done, "l_orderkey").withColumnRenamed("l_orderkey", "obligation_id")
    cases = of("l_suppkey").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return audit.cases_of(obligations, cases.select(F.concat(F.lit("t"), F.expr("s_nationkey % 3").cast("string")).alias("target"), F.col("s_suppkey").alias("case_id"), (F.col("s_acctbal") > 0).alias("runtime"), "elements"))


@query("SELECT p_brand AS target, count(l_discount < 0.1) AS n, coalesce(bool_and(l_discount < 0.1), false) AND count(l_discount < 0.1) > 0 AS all_passed FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity = 13 GROUP BY p_brand")
def static_results(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity = 13").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_discount") < 0.1).alias("passed"))
    return audit.static_results(table(spark, d, "part").join(lines, "p_partkey", "left").select(F.col("p_brand").alias("target"), "passed"))


# -- experiments -----------------------------------------------------------------------------------------------------------

_KINDS = ["uniqueness", "mandatory", "subset", "ring", "value"]
_WRITES = f"""w AS (SELECT p_partkey AS "case", list_extract({_KINDS!r}, (p_partkey % 5)::INTEGER + 1) AS kind, list_extract({_STATUSES[:3]!r}, (p_size % 3)::INTEGER + 1) AS status, p_partkey % 11 <> 0 AS lowered,
  CASE WHEN p_partkey % 13 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'prevented' ELSE 'realized' END END AS outcome, CASE WHEN p_size % 4 > 0 THEN p_size % 4 = 1 END AS post_state, p_partkey % 7 <> 0 AS isolated FROM part),
e AS (SELECT *, CASE WHEN status = 'native_enforced' THEN 'prevented' WHEN status = 'represented_not_enforced' THEN 'realized' ELSE 'not_asserted' END AS expected FROM w),
n AS (SELECT *, expected = 'realized' AND kind IN ('mandatory', 'subset', 'ring') AS needs FROM e)"""


def _writes(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.expr("p_partkey % 13 <> 0"), F.when(F.expr("p_partkey % 3 = 0"), "prevented").otherwise("realized"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("case"), _pick(_KINDS, "p_partkey % 5").alias("kind"), _pick(_STATUSES[:3], "p_size % 3").alias("status"), F.expr("p_partkey % 11 <> 0").alias("lowered"), outcome.alias("outcome"),
        F.when(F.expr("p_size % 4 > 0"), F.expr("p_size % 4 = 1")).alias("post_state"), F.expr("p_partkey % 7 <> 0").alias("isolated"),
    )


@query(f"""WITH {_WRITES}, l AS (SELECT *, CASE WHEN NOT lowered THEN 'not_executable' WHEN outcome = 'prevented' AND NOT isolated THEN 'prevention_not_attributable' WHEN outcome = 'prevented' THEN 'prevented'
  WHEN outcome = 'realized' AND needs AND post_state IS NULL THEN 'post_state_pending' WHEN outcome = 'realized' THEN 'realized' ELSE 'not_observed' END AS level FROM n)
SELECT "case", expected, level, CASE WHEN level = 'prevented' THEN 'preserved_or_stronger' WHEN level = 'realized' THEN CASE WHEN needs AND NOT post_state THEN 'preserved_or_stronger' ELSE 'weakened' END END AS observed FROM l""")
def write_outcome(spark, d):
    return audit.write_outcome(_writes(spark, d)).select("case", "expected", "level", "observed")


@query(f"""WITH {_WRITES}, p AS (SELECT l_partkey AS "case", count(*) AS n, count(*) FILTER (l_tax < 0.07) AS seen, count(*) FILTER (l_tax < 0.07 AND l_discount < 0.09) AS ok FROM lineitem GROUP BY l_partkey)
SELECT w."case" AS obligation_id, CASE WHEN p_size % 3 = 0 THEN 'weakened' WHEN p_size % 3 = 2 THEN NULL WHEN seen > ok THEN 'stronger_or_incompatible' WHEN n > 0 AND ok = n THEN 'preserved_on_tested_cases' ELSE 'preserved_or_stronger' END AS refined
FROM w JOIN part ON p_partkey = w."case" LEFT JOIN p ON p."case" = w."case\"""")
def refined_observation(spark, d):
    """Observations of parts refined by their lines: those of little tax have run, and those of little discount were accepted."""
    observed = F.when(F.expr("p_size % 3 = 0"), "weakened").when(F.expr("p_size % 3 = 1"), "preserved_or_stronger")
    probes = table(spark, d, "lineitem").select(F.col("l_partkey").alias("obligation_id"), F.when(F.col("l_tax") < 0.07, F.col("l_discount") < 0.09).alias("accepted"))
    return audit.refined(table(spark, d, "part").select(F.col("p_partkey").alias("obligation_id"), observed.alias("observed")), probes).select("obligation_id", "refined")


@query("""WITH a AS (SELECT l_orderkey AS m, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 48) AS lacking, count(*) FILTER (NOT (l_returnflag = 'N' AND l_quantity > 48) AND l_discount >= 0.08) AS flipped FROM lineitem GROUP BY 1)
SELECT o_orderkey AS mutation_id, CASE WHEN o_custkey % 9 = 0 THEN 'not_observed' WHEN o_custkey % 7 = 0 THEN 'invalid_baseline' WHEN o_custkey % 5 = 0 THEN 'not_observed' WHEN lacking > 0 THEN 'failed' WHEN coalesce(flipped, 0) = 0 THEN 'survived_mutation' ELSE 'mutation_detected' END AS status
FROM orders LEFT JOIN a ON m = o_orderkey""")
def mutation_outcome(spark, d):
    """Orders as experiments, with their lines as cases."""
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("mutation_id"), F.expr("o_custkey % 9 <> 0").alias("baseline_completed"), F.expr("o_custkey % 7 <> 0").alias("baseline_passed"), F.expr("o_custkey % 5 <> 0").alias("mutated_completed"))
    lines = table(spark, d, "lineitem")
    affected = lines.select(F.col("l_orderkey").alias("mutation_id"), F.col("l_linenumber").alias("case_id"), F.when(F.expr("NOT (l_returnflag = 'N' AND l_quantity > 48)"), F.col("l_discount") < 0.08).alias("passed"))
    return audit.mutation_outcome(runs, affected)


@query("""SELECT o_orderkey AS revision, (o_custkey % 3)::INTEGER AS required, count(*) FILTER (l_returnflag <> 'R' AND s_acctbal > 0 AND (o_custkey % 4 > 0 OR l_suppkey % 10 < 5)) AS accepted,
count(*) FILTER (l_returnflag <> 'R' AND s_acctbal > 0 AND (o_custkey % 4 > 0 OR l_suppkey % 10 < 5)) >= o_custkey % 3 AS passed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY o_orderkey, o_custkey""")
def trust_evaluation(spark, d):
    """Orders are signed by the suppliers of their lines; those in credit are trusted, and every fourth customer takes half of them."""
    suppliers = table(spark, d, "supplier")
    signed = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("revision"), F.col("l_suppkey").alias("key_id"), (F.col("l_returnflag") != "R").alias("valid"))
    keys = suppliers.select(F.col("s_suppkey").alias("key_id"), F.when(F.col("s_acctbal") > 0, "trusted").otherwise("revoked").alias("status"))
    half = suppliers.where("s_suppkey % 10 < 5").select(F.lit("half").alias("allowed"), F.col("s_suppkey").alias("key_id"))
    rules = table(spark, d, "orders").select(F.col("o_orderkey").alias("revision"), F.expr("int(o_custkey % 3)").alias("required"), F.when(F.expr("o_custkey % 4 = 0"), "half").alias("allowed"))
    return audit.trust(signed, keys, rules, half)


@query(f"WITH {_WRITES} SELECT \"case\" AS obligation_id, CASE WHEN lowered THEN expected ELSE 'not_executable' END AS expected, needs AND lowered AS needs_post_state FROM n")
def expected_writes(spark, d):
    rows = _writes(spark, d).select(F.col("case").alias("obligation_id"), "kind", F.lit("t").alias("target"), "status", "lowered")
    return audit.expected_writes(rows).select("obligation_id", "expected", "needs_post_state")


# -- changes -----------------------------------------------------------------------------------------------------------------

_CHANGED = ["add_fact", "drop_fact", "add_constraint", "change_constraint", "change_constraint", "change_constraint", "change_field_required", "change_role_player", "rename_fact", "drop_field"]
_CHANGES = f"""c AS (SELECT p_partkey AS k, list_extract({_CHANGED!r}, (p_partkey % 10)::INTEGER + 1) AS kind, CASE p_partkey % 10 WHEN 3 THEN 'frequency' WHEN 4 THEN 'range' WHEN 5 THEN 'oneof' END AS rule, p_size % 5 AS lb, p_size * 3 % 5 AS la, p_size % 7 AS hb, p_size * 5 % 7 AS ha, p_size % 2 AS gone FROM part),
s AS (SELECT *, CASE WHEN kind IN ('drop_fact', 'drop_field') THEN 'destructive' WHEN kind = 'change_role_player' THEN 'manual' WHEN kind = 'add_constraint' THEN 'requires_data_check' WHEN kind = 'change_field_required' THEN CASE WHEN la > lb THEN 'requires_data_check' ELSE 'safe' END
  WHEN rule IN ('frequency', 'range') AND (la > lb OR ha < hb) THEN 'requires_data_check' WHEN rule = 'oneof' AND gone > 0 THEN 'requires_data_check' ELSE 'safe' END AS safety FROM c)"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    rule = F.when(F.expr("p_partkey % 10 = 3"), "frequency").when(F.expr("p_partkey % 10 = 4"), "range").when(F.expr("p_partkey % 10 = 5"), "oneof")
    bounds = {"low_before": "p_size % 5", "low_after": "p_size * 3 % 5", "high_before": "p_size % 7", "high_after": "p_size * 5 % 7", "removed": "p_size % 2"}
    rows = table(spark, d, "part").select(_pick(_CHANGED, "p_partkey % 10").alias("kind"), F.col("p_partkey").alias("subject"), rule.alias("rule"), *[F.expr(e).alias(n) for n, e in bounds.items()])
    return evolution.safety(rows)


@query(f"WITH {_CHANGES} SELECT kind, k AS subject, safety FROM s")
def change_safety(spark, d):
    return evolution.ordered(_changes(spark, d)).select("kind", "subject", "safety")


@query(f"WITH {_CHANGES} SELECT safety, kind, count(*) AS n FROM s GROUP BY 1, 2")
def diff_summary(spark, d):
    return evolution.diff_summary(_changes(spark, d))


@query(f"""WITH {_CHANGES} SELECT k AS op, CASE WHEN k % 7 = 0 THEN false WHEN safety = 'manual' THEN false WHEN safety = 'destructive' THEN k % 3 = 0 WHEN safety = 'requires_data_check' THEN k % 2 = 0 AND coalesce(CASE WHEN k % 5 > 0 THEN k % 4 > 1 END, false) ELSE k % 11 > 0 END AS allowed FROM s""")
def policy_gate(spark, d):
    rows = _changes(spark, d).select(F.col("subject").alias("op"), "safety", F.expr("subject % 11 > 0").alias("automatic"), F.expr("subject % 7 <> 0").alias("has_command"), F.when(F.expr("subject % 5 > 0"), F.expr("subject % 4 > 1")).alias("preflight_passed"), F.expr("subject % 2 = 0").alias("allow_risky"), F.expr("subject % 3 = 0").alias("allow_destructive"))
    return evolution.gate(rows).select("op", "allowed")


@query("""WITH b AS (SELECT p_partkey AS id, 'n' || p_partkey AS name FROM part), a AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE 1000000 + p_partkey END AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new' || p_partkey ELSE 'n' || p_partkey END AS name FROM part WHERE p_partkey % 11 > 0),
h AS (SELECT 'n' || p_partkey AS o, 'new' || p_partkey AS n FROM part WHERE p_partkey % 10 = 0)
SELECT b.id AS before_id, a.id AS after_id, 'id' AS "by" FROM b JOIN a ON a.id = b.id
UNION ALL SELECT b.id, a.id, 'hint' FROM b JOIN h ON h.o = b.name JOIN a ON a.name = h.n WHERE a.id <> b.id AND a.id > 999999
UNION ALL SELECT b.id, a.id, 'name' FROM b JOIN a ON a.name = b.name WHERE a.id > 999999""")
def element_alignment(spark, d):
    """Parts before and after: every third keeps its id, every fifth gets another name, of which half are told.  Ids over 999,999 may be new, and are kept ones too if there are so many parts."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"))
    new = F.concat(F.lit("new"), F.col("k").cast("string"))
    after = parts.where("k % 11 > 0").select(F.expr("CASE WHEN k % 3 = 0 THEN k ELSE 1000000 + k END").alias("id"), F.when(F.expr("k % 5 = 0"), new).otherwise(F.col("name")).alias("name"))
    hints = parts.where("k % 10 = 0").select(F.col("name").alias("before_name"), new.alias("after_name"))
    return evolution.align(parts.select(F.col("k").alias("id"), "name"), after, hints, F.col("after_id") > 999999)


@query("""WITH k(i, kind, term, impact) AS (VALUES (0, 'role', 'place in a fact', 'who takes part in what'), (1, 'reading', 'wording of a fact', 'how facts are read out'), (2, 'new_kind', 'new kind', 'an element of the model'), (3, 'constraint', 'rule', 'which populations are allowed'))
SELECT p_partkey AS conflict_id, term, impact, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 4 END AS choices FROM part JOIN k ON i = p_partkey % 4""")
def conflict_terms(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("conflict_id"), _pick(["role", "reading", "new_kind", "constraint"], "p_partkey % 4").alias("element_kind"), _pick(["both added", "both modified", "deleted and modified"], "p_size % 3").alias("reason"))
    return evolution.explained(rows).select("conflict_id", "term", "impact", F.size("choices").alias("choices"))


# -- documents, revisions and models as data -----------------------------------------------------------------------------------


@query("""WITH t AS (SELECT event_id, '{"a":{"type":"' || event_type || '","v":[' || user_id || ',1.5]},"p":' || replace(props, ' ', '') || ',"z":' || event_id || '}' AS canonical FROM events) SELECT event_id, canonical, substr(sha256(canonical), 1, 24) AS content_id FROM t""")
def canonical_documents(spark, d):
    """Events as JSON with keys in another order, spaces and a longer number."""
    text = F.format_string('{ "z": %d, "p": %s, "a": {"v": [%d, 1.50], "type": "%s"} }', "event_id", "props", "user_id", "event_type")
    return table(spark, d, "events").select("event_id", canonical(text).alias("canonical"), content_id(text).alias("content_id"))


@query("""WITH k AS (SELECT event_id, regexp_extract(props, '[0-9]+')::INTEGER AS k FROM events), b AS (SELECT event_id, (k + (event_id % 3 = 0)::INTEGER)::VARCHAR AS k, event_id % 5 = 0 AS more FROM k WHERE event_id % 7 <> 0)
SELECT k.event_id, '$.["k"]' AS path, k.k::VARCHAR AS before, b.k AS after FROM k LEFT JOIN b USING (event_id) WHERE k.k::VARCHAR IS DISTINCT FROM b.k
UNION ALL SELECT event_id, '$.["more"][0]', NULL, 'null' FROM b WHERE more UNION ALL SELECT event_id, '$.["more"][1].["x"]', NULL, '"y"' FROM b WHERE more""")
def document_differences(spark, d):
    """What the properties of events say otherwise after some were changed, added to or left out."""
    events = table(spark, d, "events").select("event_id", "props")
    k = (F.regexp_extract("props", "[0-9]+", 0).cast("int") + F.expr("int(event_id % 3 = 0)")).cast("string")
    more = F.when(F.expr("event_id % 5 = 0"), '"more": [null, {"x": "y"}], ').otherwise("")
    return differences(events, events.where("event_id % 7 <> 0").withColumn("props", F.concat(F.lit("{"), more, F.lit('"k": '), k, F.lit("}"))), "event_id", "props")


_REVISIONS = """o AS (SELECT o_orderkey AS k, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first, '{"c":' || o_custkey || '}' AS content FROM orders),
r AS (SELECT *, CASE WHEN first = k THEN sha256(content) ELSE sha256(content || chr(10) || sha256(content)) END AS stored, k % 97 = 5 AS changed FROM o)"""


@query(f"""WITH {_REVISIONS} SELECT k AS revision, CASE WHEN changed THEN 'mismatch' WHEN k % 101 = 7 THEN 'dangling' WHEN first <> k AND first % 97 = 5 THEN 'tainted' ELSE 'verified' END AS status, CASE WHEN k % 101 = 7 THEN '-1' END AS missing FROM r""")
def revision_checks(spark, d):
    """Orders as revisions after the first of their customer; some have another content than was stored, and some name a parent that isn't there."""
    orders = table(spark, d, "orders")
    first = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderkey").alias("first"))
    content = F.format_string('{"c":%d}', "o_custkey")
    own = orders.join(first, F.col("o_custkey") == F.col("c")).select(F.col("o_orderkey").alias("revision"), "first", content.alias("said"))
    root = revisions.revision_id(F.col("said"), F.array().cast("array<string>"))  # of one customer all say the same
    stored = F.when(F.col("first") == F.col("revision"), root).otherwise(revisions.revision_id(F.col("said"), F.array(root)))
    rows = own.select("revision", F.when(F.expr("revision % 97 = 5"), "changed").otherwise(F.col("said")).alias("content"), stored.alias("stored"))
    parents = own.where("first <> revision").select("revision", F.col("first").alias("parent"))
    lost = own.where("revision % 101 = 7").select("revision", F.lit(-1).cast("bigint").alias("parent"))
    return revisions.verified(rows, parents.unionByName(lost)).select("revision", "status", F.col("missing").cast("string").alias("missing"))


_FOLDED = ["click", "view", "purchase", "login"]


def _folded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    return facts.folded(table(spark, d, "customer").select("c_custkey"), "c_custkey", {t: (events.where(F.col("event_type") == t), "user_id", ["event_id", "value"]) for t in _FOLDED})


@query("WITH " + ", ".join(f"{t} AS (SELECT user_id AS u, min(event_id) AS e FROM events WHERE event_type = '{t}' GROUP BY 1), v_{t} AS (SELECT u, e, value FROM {t} JOIN events ON event_id = e)" for t in _FOLDED) + " SELECT c_custkey, " + ", ".join(f"v_{t}.e::VARCHAR AS {t}__event_id, v_{t}.value AS {t}__value" for t in _FOLDED) + " FROM customer " + " ".join(f"LEFT JOIN v_{t} ON v_{t}.u = c_custkey" for t in _FOLDED))
def folded_facts(spark, d):
    """Customers with the first click, view, purchase and login of each."""
    return _folded(spark, d)[0].withColumns({f"{t}__event_id": F.col(f"{t}__event_id").cast("string") for t in _FOLDED})


@query(f"SELECT event_type AS fact, user_id AS owner, count(*) - 1 AS n FROM events WHERE event_type IN ({', '.join(map(repr, _FOLDED))}) GROUP BY 1, 2 HAVING count(*) > 1")
def folded_overflow(spark, d):
    """How many more of them there are."""
    return _folded(spark, d)[1].groupBy("fact", "owner").agg(F.sum("n").alias("n"))


def _catalogue(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Relations of a model that the tables state: parts are entities, their suppliers' lines fields, customers value types and orders facts."""
    lines, text = table(spark, d, "lineitem"), lambda c: F.expr(c).cast("string")
    entities = table(spark, d, "part").select(F.concat(F.lit("P"), text("p_partkey")).alias("name"), F.lit("entity").alias("kind"), F.lit(None).cast("string").alias("scalar"))
    values = table(spark, d, "customer").select(F.concat(F.lit("V"), text("c_custkey")).alias("name"), F.lit("value").alias("kind"), F.lit("Int").alias("scalar"))
    fields = lines.select(F.concat(F.lit("P"), text("l_partkey")).alias("owner"), F.concat(F.lit("s"), text("l_suppkey")).alias("name"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("V"), text("l_suppkey")).alias("type"), (F.col("l_returnflag") == "A").alias("required"), F.lit(None).cast("int").alias("identifying")).distinct()
    roles = lines.select(F.concat(F.lit("F"), text("l_orderkey")).alias("fact"), F.concat(F.lit("r"), text("l_linenumber")).alias("name"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("P"), text("l_partkey")).alias("player")).distinct()
    return {"objects": entities.unionByName(values), "fields": fields, "facts": table(spark, d, "orders").select(F.concat(F.lit("F"), text("o_orderkey")).alias("name"), F.lit(None).cast("string").alias("objectified")), "roles": roles}


@query("""WITH f AS (SELECT DISTINCT 'P' || l_partkey AS owner, 's' || l_suppkey AS name, l_linenumber AS ordinal, l_returnflag = 'A' AS required FROM lineitem), r AS (SELECT DISTINCT 'F' || l_orderkey AS fact, 'r' || l_linenumber AS name, l_linenumber AS ordinal, 'P' || l_partkey AS player FROM lineitem)
SELECT 'fields' AS relation, owner || '/' || name AS key, 'ordinal' AS "column", count(DISTINCT ordinal) AS n FROM f GROUP BY ALL HAVING count(DISTINCT ordinal) > 1 UNION ALL SELECT 'fields', owner || '/' || name, 'required', count(DISTINCT required) FROM f GROUP BY ALL HAVING count(DISTINCT required) > 1
UNION ALL SELECT 'fields', owner || '/' || ordinal, 'name', count(DISTINCT name) FROM f GROUP BY ALL HAVING count(DISTINCT name) > 1 UNION ALL SELECT 'roles', fact || '/' || name, 'player', count(DISTINCT player) FROM r GROUP BY ALL HAVING count(DISTINCT player) > 1""")
def catalog_conflicts(spark, d):
    return catalog.conflicts(_catalogue(spark, d)).select("relation", F.array_join("key", "/").alias("key"), "column", F.col("n").cast("bigint").alias("n"))


@query("""WITH f AS (SELECT 'P' || l_partkey AS name, count(DISTINCT (l_suppkey, l_linenumber, l_returnflag = 'A')) AS n FROM lineitem GROUP BY 1), r AS (SELECT 'F' || l_orderkey AS name, count(DISTINCT (l_linenumber, l_partkey)) AS n FROM lineitem GROUP BY 1)
SELECT 'entities' AS part, 'P' || p_partkey AS name, coalesce(n, 0) AS n FROM part LEFT JOIN f ON f.name = 'P' || p_partkey UNION ALL SELECT 'facts', 'F' || o_orderkey, coalesce(n, 0) FROM orders LEFT JOIN r ON r.name = 'F' || o_orderkey UNION ALL SELECT 'values', 'V' || c_custkey, 0 FROM customer""")
def model_catalog(spark, d):
    """Every element that the relations state, with how many fields or roles it is assembled from."""
    whole = catalog.assembled(_catalogue(spark, d))
    n = F.coalesce(F.json_array_length(F.coalesce(F.get_json_object("body", "$.fields"), F.get_json_object("body", "$.roles"))), F.lit(0))
    return whole.select("part", F.get_json_object("body", "$.name").alias("name"), n.cast("bigint").alias("n"))
