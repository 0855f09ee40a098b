"""Sources and sinks: bound tables, populations as JSON, catalogues and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.functions.scalar import normal_check


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share; only a local session that names none gets one of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame, name: str = "durable") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that a lost executor costs no earlier work and readers take the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that :func:`durable` made, once nothing reads them any more."""
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table to bind, in any format that Spark reads; text formats should be given a schema, which saves a pass."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


POPULATION = (
    "memberships array<struct<object_type_id:string,instances:array<string>>>,"
    "values array<struct<instance_id:string,value_type_id:string,literal:string>>,"
    "facts array<struct<fact_type_id:string,rows:array<array<string>>>>,"
    "objectifications array<struct<instance_id:string,object_type_id:string,fact_type_id:string,row_index:bigint>>"
)


def population(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Populations in JSON (one document a file) as long relations: memberships, values, facts, objectifications."""
    docs = spark.read.schema(POPULATION).option("multiLine", True).json(path)
    member = docs.select(F.explode("memberships").alias("m")).select(F.col("m.object_type_id").alias("object_type"), F.explode("m.instances").alias("instance_id"))
    value = docs.select(F.inline("values")).toDF("instance_id", "value_type", "literal")
    fact = docs.select(F.explode("facts").alias("f")).select(F.col("f.fact_type_id").alias("fact"), F.posexplode("f.rows").alias("row_index", "players"))
    bound = docs.select(F.inline("objectifications")).toDF("instance_id", "object_type", "fact", "row_index")
    return {"memberships": member, "values": value, "facts": fact, "objectifications": bound}


class SourceError(ValueError):
    """A file that says other things than it holds, or was made for something else."""


def checked_population(spark: SparkSession, path: str, arities: dict[str, int], fingerprint: str | None = None) -> dict[str, DataFrame]:
    """:func:`population` of one JSON document, refused unless it is whole.

    Every fact must be in ``arities``, in one block, its rows of that length; ``row_count`` must be the number of rows and
    ``model_sha256`` the ``fingerprint`` of the model it is read for, where the document has them.  The checks are one small aggregate.
    """
    relations = population(spark, path)
    said = spark.read.schema(f"{POPULATION}, row_count bigint, model_sha256 string").option("multiLine", True).json(path)
    blocks = said.select(F.explode("facts").alias("f")).groupBy("f.fact_type_id").agg(F.count(F.lit(1)).alias("n"))
    twice = [r.fact_type_id for r in blocks.where("n > 1").limit(20).collect()]
    if twice:
        raise SourceError(f"facts in more than one block: {twice}")
    known = spark.createDataFrame(list(arities.items()), "fact string, arity int")  # a row for each fact type
    rows = relations["facts"].join(known, "fact", "left")
    unknown, wrong, n = rows.agg(F.max(F.when(F.col("arity").isNull(), F.col("fact"))), F.max(F.when(F.size("players") != F.col("arity"), F.col("fact"))), F.count(F.lit(1))).first()
    head = said.agg(F.max("row_count").alias("row_count"), F.max("model_sha256").alias("model_sha256")).first()
    for bad, what in (
        (unknown is not None, f"there is no fact {unknown}"),
        (wrong is not None, f"a row of {wrong} has the wrong number of players"),
        (head.row_count is not None and head.row_count != n, f"{head.row_count} rows are announced and {n} there"),
        (fingerprint is not None and head.model_sha256 not in (None, fingerprint), "the population was written for another model"),
    ):
        if bad:
            raise SourceError(what)
    return relations


EVIDENCE = "format string, target string, model_sha256 string, case_plan_sha256 string, status string, case_count bigint, results array<struct<obligation_id:string,target:string,passed:boolean>>"
#: The format of evidence that this library writes and takes.
EVIDENCE_FORMAT = "rolewise-evidence-1"


def write_evidence(results: DataFrame, path: str, target: str, identity: dict[str, str]) -> None:
    """``results(obligation_id, passed)`` as one JSON document for :func:`evidence`; a row for each obligation of a model."""
    rows = [(r.obligation_id, target, r.passed) for r in results.select("obligation_id", "passed").collect()]
    one = (EVIDENCE_FORMAT, target, identity["model_sha256"], identity["case_plan_sha256"], "completed", len(rows), rows)
    results.sparkSession.createDataFrame([one], EVIDENCE).coalesce(1).write.mode("overwrite").json(path)


def evidence(spark: SparkSession, path: str, target: str, identity: dict[str, str]) -> DataFrame:
    """``obligation_id, target, passed`` of an evidence document that was made for this target, model and plan of cases, and is whole.

    ``identity`` has ``model_sha256`` and ``case_plan_sha256``; an obligation twice, a row for another target or a wrong number of rows is refused.
    """
    found = spark.read.schema(EVIDENCE).json(path).limit(2).collect()
    if len(found) != 1:
        raise SourceError("there must be one evidence document")
    one = found[0]
    expected = {"format": EVIDENCE_FORMAT, "target": target, **identity}
    for name, value in expected.items():
        if one[name] != value:
            raise SourceError(f"evidence of {target}: {name} is {one[name]!r} and not {value!r}")
    rows = one.results or []
    if any(not r.obligation_id for r in rows) or len({r.obligation_id for r in rows}) < len(rows):
        raise SourceError(f"evidence of {target}: an obligation is missing or twice")
    if any(r.target not in (None, target) for r in rows):
        raise SourceError(f"evidence of {target}: a result is of another target")
    if one.status == "completed" and one.case_count not in (None, len(rows)):
        raise SourceError(f"evidence of {target}: {one.case_count} cases are announced and {len(rows)} there")
    return spark.createDataFrame([(r.obligation_id, target, r.passed) for r in rows], "obligation_id string, target string, passed boolean")


def fixture(spark: SparkSession, path: str) -> DataFrame:
    """``collection, document`` (JSON) of a migration fixture: one document whose ``setup`` inserts documents into collections."""
    said = spark.read.option("multiLine", True).schema("format string, setup array<struct<op:string,collection:string,document:string>>").json(path)
    rows = said.select("format", F.inline("setup"))
    if not rows.where("op <> 'insert' OR collection IS NULL").isEmpty():
        raise SourceError("a fixture inserts documents into collections and does nothing else")
    return rows.select("collection", "document")


def fact_columns(facts: DataFrame, fact: str, roles: list[str]) -> DataFrame:
    """One fact type of the long relation as a wide DataFrame, with ``row_index``; rows of another arity are left out."""
    rows = facts.where((F.col("fact") == fact) & (F.size("players") == len(roles)))
    return rows.select("row_index", *[F.get("players", F.lit(k)).alias(r) for k, r in enumerate(roles)])


def write_population(relations: dict[str, DataFrame], path: str) -> None:
    """The relations as Parquet, one folder each; facts are laid out by fact type, so that one is read without the rest."""
    for name, df in relations.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("fact") if name == "facts" else writer).parquet(f"{path}/{name}")


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """A table's columns as rows, for comparing catalogues: ``table, column, kind, nullable``."""
    rows = [(name, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "table string, column string, kind string, nullable boolean")


def compare_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that are not the same in two catalogues: ``table, column, problem``."""
    left = a.select("table", "column", F.struct("kind", "nullable").alias("l"))
    both = left.join(b.select("table", "column", F.struct("kind", "nullable").alias("r")), ["table", "column"], "full_outer")
    problem = F.when(F.col("l").isNull(), "unexpected").when(F.col("r").isNull(), "missing").when(F.col("l") != F.col("r"), "different")
    return both.select("table", "column", problem.alias("problem")).where("problem IS NOT NULL")


def compare_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Primary keys, uniques, checks and foreign keys ``(table, kind, columns, text)`` that only one catalogue has: ``table, kind, columns, text, problem``.

    Checks are compared without casts, brackets, space and case.
    """
    same = lambda df: df.withColumn("text", F.when(F.col("kind") == "check", normal_check(F.col("text"))).otherwise(F.col("text"))).select("table", "kind", "columns", "text").distinct()
    left, right = same(a), same(b)
    return left.subtract(right).withColumn("problem", F.lit("missing")).unionByName(right.subtract(left).withColumn("problem", F.lit("unexpected")))


def scanned_keys(constraints: DataFrame, key_columns: DataFrame, checks: DataFrame) -> DataFrame:
    """A database's catalogue as :func:`compare_keys` takes it: ``table, kind, columns, text`` for every primary key, unique, foreign key and check, its columns in their order.

    ``constraints(table, name, kind)`` has the kinds of the SQL standard in any case; ``key_columns(table, name, column, ordinal, target_table, target_column)`` a row for each column of a key, the
    last two for foreign keys; ``checks(table, name, text)``.  They are what the views of an information schema give, read as any table is (:func:`read` with ``jdbc``, say).  A foreign key's text is its
    target and that one's columns; of a check what is compared is its text, and NOT NULL checks are left to the columns.  A key without columns has none.
    """
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "column", "target_column")))
    keys = key_columns.groupBy("table", "name").agg(parts.alias("parts"), F.min("target_table").alias("target"))
    kinds = {"PRIMARY KEY": "primary_key", "UNIQUE": "unique", "FOREIGN KEY": "foreign_key", "CHECK": "check"}
    named = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.upper(F.trim("kind")))
    row = constraints.select("table", "name", F.coalesce(named, F.lower("kind")).alias("kind")).distinct().join(keys, ["table", "name"], "left").join(checks.select("table", "name", F.col("text").alias("check")), ["table", "name"], "left")
    columns = F.coalesce(F.col("parts.column"), F.array().cast("array<string>"))
    aim = F.concat("target", F.lit("("), F.array_join("parts.target_column", ","), F.lit(")"))
    text = F.when(F.col("kind") == "foreign_key", aim).when(F.col("kind") == "check", F.col("check"))
    rows = row.select("table", "kind", columns.alias("columns"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.where(~((F.col("kind") == "check") & F.col("text").rlike(r"(?i)^\W*\w+\W+is\s+not\s+null\W*$")))


def write_bundle(relations: dict[str, DataFrame], path: str) -> None:
    """Relations as JSON lines, one folder each, and an ``index`` with the columns of each."""
    for name, df in relations.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    spark = next(iter(relations.values())).sparkSession
    index = [(name, df.schema.simpleString()) for name, df in sorted(relations.items())]
    spark.createDataFrame(index, "relation string, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/index")


def write_report(df: DataFrame, path: str) -> None:
    """A result as JSON lines."""
    df.write.mode("overwrite").json(path)
