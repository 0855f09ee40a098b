import math
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from rolewise.llm import mixing, sharding, simhash_dedup
from rolewise.operators.graph import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(prints):
    """(doc_id, fingerprint) to the least doc_id reachable, from all pairs."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                group[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(prints):
        ids[root(i)].append(doc_id)
    return [min((d for d in ids[root(i)] if d is not None), default=None) for i in range(len(prints))]


def check(docs):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.components(docs).collect())
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert got == Counter((d, f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints)))


def test_components_match_all_pairs(docs, sample):
    check(docs)
    check(sample)


def test_links_crowded_or_not_join_the_same(spark):
    import random

    rng = random.Random(7)
    centre = rng.getrandbits(64)
    # a cloud around one value, chains that step two bits at a time, and far values
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(300)}
    values |= {sum(3 << (2 * k) for k in range(n)) for n in range(20)} | {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    expected = plain_components([(v, v & (1 << 64) - 1) for v in signed])
    for crowd in (1, 8, 1000):
        labels = {r.node: r.component for r in components(simhash_dedup.links(frame, crowd).toDF("src", "dst")).collect()}
        assert [labels.get(v, v) for v in signed] == expected


def test_keep_one_and_empty(docs, sample, empty):
    for table in (docs, sample, docs.withColumn("doc_id", F.lit(None).cast("long")), sample.withColumn("doc_id", F.col("doc_id") % 9)):
        given, kept = table.collect(), simhash_dedup.keep_one(table)
        assert kept.columns == table.columns
        prints = [(k, plain_fingerprint(r.text)) for k, r in enumerate(given)]
        groups = defaultdict(list)
        for r, c in zip(given, plain_components(prints)):
            groups[c].append(r)
        rows = kept.collect()
        assert len(rows) == len(groups)
        # each kept row is of a group of its own and has its least doc_id
        of = {r: c for c, members in groups.items() for r in members}
        assert len({of[r] for r in rows}) == len(rows)
        for r in rows:
            ids = [m.doc_id for m in groups[of[r]] if m.doc_id is not None]
            assert r.doc_id == min(ids, default=None)
    assert simhash_dedup.components(empty).count() == 0 and simhash_dedup.keep_one(empty).count() == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    stopped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return share | stopped
        stopped |= {s: 3 * sizes[s] for s in over}


def check_mix(docs):
    rows = mixing.mixed(docs).collect()
    given = docs.select("doc_id", "source", "text").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((g.doc_id, count(g.text)) for g in given)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for g in given:
        sizes[g.source] += count(g.text)
    goal = plain_targets(dict(sizes))
    by_id = {g.doc_id: g.source for g in given}
    for r in rows:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, goal[s], abs_tol=1e-6)
        ratio = r.target / r.source_size if r.source_size else 0
        assert r.taken in (r.size * math.floor(ratio), r.size * math.ceil(ratio)) and r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    again = mixing.mixed(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mixing(docs, sample, empty):
    check_mix(docs)
    check_mix(sample)
    assert mixing.mixed(empty).count() == 0
    blank = sample.withColumn("text", F.lit(None).cast("string"))
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mixed(blank).collect())


def test_mixing_many_levels(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    check_mix(docs)


def check_repeats(table):
    """Each row is there as often as a row like it is taken, with its own columns."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    wanted = Counter()
    for r in mixing.copies(table).collect():
        wanted[r.doc_id, r.source, r.size] += r.copies
    repeated = mixing.repeat_rows(table)
    assert repeated.columns == table.columns
    given, got = table.collect(), Counter(repeated.collect())
    alike = Counter((r.doc_id, r.source, count(r.text)) for r in given)
    assert +Counter({k: n for k, n in wanted.items()}) == sum((Counter({(r.doc_id, r.source, count(r.text)): n}) for r, n in got.items()), Counter())
    times = Counter(given)
    for r, n in got.items():
        key = r.doc_id, r.source, count(r.text)
        low = wanted[key] // alike[key]
        assert low * times[r] <= n <= (low + 1) * times[r]


def test_repeat_rows_follows_the_copies(docs, sample, empty):
    for table in (docs, sample, sample.withColumn("doc_id", F.lit(None).cast("long")), sample.withColumn("doc_id", F.col("doc_id") % 5)):
        check_repeats(table)
    assert mixing.repeat_rows(empty).count() == 0


def test_mix_of_rows_that_share_an_id(spark):
    rows = [(1, "w " * 10, "a"), (1, "w " * 90, "b"), (2, "w " * 50, "c"), *[(None, "w " * 3, "d")] * 7, *[(None, "w " * 3 + str(k), "d") for k in range(9)]]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_repeats(table)
    taken, goal = Counter(), {}
    for r in mixing.copies(table).collect():
        taken[r.source] += r.size * r.copies
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 90 for s in goal) and abs(taken["d"] - goal["d"]) <= 7
    again = Counter(r.text for r in mixing.repeat_rows(table).collect())
    assert sum(len(t.split()) * n for t, n in again.items()) == sum(taken.values())


def test_many_rows_without_an_id_cost_no_more(spark):
    import time

    def seconds(table):
        began = time.perf_counter()
        rows = mixing.mixed(table).groupBy("size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()
        assert sum(r.n for r in rows) == 60_000
        return time.perf_counter() - began

    named = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    seconds(named)
    usual, hot = seconds(named), seconds(named.withColumn("doc_id", F.lit(None).cast("long")))
    assert hot < 3 * usual + 5


def test_sharding(docs, sample, empty):
    table = sharding.fill()
    held = Counter(table)
    assert len(held) == sharding.SHARDS and max(held.values()) - min(held.values()) <= 1
    fewer = sharding.fill(sharding.SHARDS - 1)
    moved = sum(a != b for a, b in zip(table, fewer) if a != sharding.SHARDS - 1)
    assert moved < 0.25 * sharding.SLOTS
    placed = sharding.place(docs)
    assert placed.count() == docs.count() and set(placed.columns) == set(docs.columns)
    assert all(r.shard == table[r.slot] for r in sharding.placement(docs).collect())
    assert "BroadcastHashJoin" in placed._jdf.queryExecution().toString()
    assert sharding.placement(empty).count() == 0


def test_write_shards(sample, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(sample, path)
    back = sample.sparkSession.read.parquet(path)
    assert back.count() == sample.count() and back.select("shard").distinct().count() == sharding.SHARDS
