"""Merkle manifest, divergence of sources and quality, against plain versions on odd rows, ties, copies, hot sources and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolewise.llm import divergence, merkle, quality
from rolewise.llm.common import blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# -- Merkle manifest ---------------------------------------------------------------------------------------------------------


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(leaves):
    """All levels of a tree, leaves first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(levels, k):
    """(siblings left, siblings right) of node ``k`` at each level under the root."""
    out = []
    for level in levels[:-1]:
        start = k // 16 * 16
        out.append((level[start:k], level[k + 1 : start + 16]))
        k //= 16
    return out


def plain_manifest(rows):
    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = [], []
    for s in sources:
        mine = sorted((r for r in rows if r.source == s), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append(tree([leaf(r, r.text) for r in mine]))
        order.append(mine)
    top = tree([t[-1][0] for t in trees])
    out = []
    for s, (mine, levels) in enumerate(zip(order, trees)):
        for k, r in enumerate(mine):
            tampered = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            steps = path(levels, k) + path(top, s)
            node = leaf(r, lower(r.text)) if tampered else levels[0][k]
            for left, right in steps:
                node = sha("".join(left) + node + "".join(right))
            proof = sha("".join("".join(left) + "".join(right) for left, right in steps))
            out.append((r.doc_id, levels[0][k], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return Counter(out)


def check_manifest(docs):
    got = merkle.checked(docs)
    assert Counter(tuple(r) for r in got.collect()) == plain_manifest(docs.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_manifest_of_odd_rows(docs, sample, spark):
    check_manifest(docs)
    check_manifest(sample.limit(60))
    one = spark.createDataFrame([(7, "Only", None, None, None)], SCHEMA)
    check_manifest(one)
    assert merkle.checked(one).first().proof_sha256 == sha("")


def test_manifest_of_a_hot_source_over_several_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(4000), f"Text {k % 300}", "en", "hot" if k % 3 else f"s{k % 23}", k) for k in range(1500)] + [(9, "same", "en", "hot", 1)] * 40 + [(None, None, None, None, None)] * 3
    monkeypatch.setattr(merkle, "DEPTH", 1)  # blocks of 16, so that paths are mostly appended
    check_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    monkeypatch.setattr(merkle, "DEPTH", 2)
    check_manifest(spark.createDataFrame(rows[:700], SCHEMA).repartition(5))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 31, 32, 255, 256, 257, 300, 600])
def test_traversal_gives_every_path_in_order(n):
    leaves = [sha(str(k)) for k in range(n)]
    levels = tree(leaves)
    for height in {min(3, len(levels) - 1), min(1, len(levels) - 1)}:
        got = [list(p) for p in merkle.traversed(leaves[: 16**height], height)]
        cut = tree(leaves[: 16**height])
        want = [[(k // 16**i % 16, "".join(a + b)) for i, (a, b) in enumerate(path(cut, k))] for k in range(min(n, 16**height))]
        assert got == [w + [(0, "")] * (height - len(w)) for w in want]


def test_paths_show_a_changed_row(docs):
    found = merkle.paths(docs, F.when(F.col("doc_id") == 7, F.lit("changed")))
    rows = found.select("doc_id", "leaf", "changed", "root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("again"), merkle.folded(F.col("leaf"), F.col("path")).alias("same")).collect()
    assert all(r.same == r.root for r in rows) and all((r.again == r.root) == (r.doc_id != 7) for r in rows)


# -- divergence ----------------------------------------------------------------------------------------------------------------


def plain_audit(rows):
    text = lambda x: "" if x is None else x
    here, total, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text(r.text)))
        lang, source = text(r.lang), text(r.source)
        groups.add((lang, source))
        here[lang, source].update(terms)
        total[lang].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        share = lambda c: [1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept]
        p, q = share(here[lang, source]), share(total[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(other, sum(map(f, p, share(here[lang, other])))) for of, other in groups if of == lang and other != source]
        terms = [(t, f(a, b)) for t, a, b in zip(kept, p, q) if here[lang, source][t] and a > b]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or rank <= 10:
                    out.append((lang, source, part, item, value, rank))
    return Counter(out)


def check_audit(docs):
    got = Counter(tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(docs.select("text", "lang", "source").collect())


def test_audit_of_odd_rows_and_the_sample(docs, sample, empty):
    check_audit(docs)
    check_audit(sample)
    assert divergence.audit(empty).count() == 0


@pytest.mark.parametrize("strip", [3, 1000])
def test_audit_of_many_groups(spark, monkeypatch, strip):
    monkeypatch.setattr(divergence, "STRIP", strip)
    monkeypatch.setattr(divergence, "TOP", 4 if strip == 3 else 10)
    rng = random.Random(strip)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(40)]
    rows = [(k, " ".join(rng.choices(words[k % 7 :], k=30)) + " Tie TIE", rng.choice(["a", "b", None]), "hot" if k % 3 else rng.choice(["x", "y", None, "z", "v", "u", "é"]), 1) for k in range(300)]
    rows += [(1, None, "a", "silent", 1), (2, "unique words only", "lonely", "s", 1), (3, "1 2 3", "none", "t", 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    if strip == 3:
        got = divergence.audit(frame).where("rank <= 4 OR part = 'pair'").collect()
        want = {x for x in plain_audit(frame.select("text", "lang", "source").collect()) if x[2] == "pair" or x[5] <= 4}
        assert {tuple(r) for r in got} == want
    else:
        check_audit(frame)


def test_every_pair_meets_once_and_a_group_once_in_a_round(spark):
    for n in range(1, 9):
        rows = spark.range(n).select(F.col("id").cast("int").alias("g")).select("g", F.explode(divergence.tournament(F.col("g"), F.lit(n))).alias("m")).select("g", "m.resident", "m.round").collect()
        assert {frozenset((r.g, r.resident)) for r in rows} == {frozenset((a, b)) for a in range(n) for b in range(a)} and len(rows) == n * (n - 1) // 2
        busy = Counter((r.round, x) for r in rows for x in (r.g, r.resident))
        assert not busy or max(busy.values()) == 1
        assert len({r.round for r in rows}) <= n


def test_counts_beyond_64_bits():
    n = np.array([0, 5, 10**13], dtype=np.int64)
    assert divergence._shares(n, 10**13 + 5, 3).tolist() == [1 + 10**9 * (int(x) + 2) // (10**13 + 11) for x in n]
    places, counts = np.array([0, 3, 4095]), np.array([1, 70000, 2**40])
    again = divergence.unpacked(divergence.packed(places, counts))
    assert [x.tolist() for x in again] == [places.tolist(), counts.tolist()]


# -- quality -------------------------------------------------------------------------------------------------------------------


def plain_features(text):
    """Numbers and counts, by the bytes' kinds one at a time."""
    tokens, kind = [], 0
    for c in text:
        k = 0 if c in b" \t\n\x0b\x0c\r" else 1 if c > 127 or chr(c).isalnum() else 2
        if k and k == kind:
            tokens[-1] += bytes([c])
        elif k:
            tokens.append(bytes([c]))
        kind = k

    def mixed(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * by % 2**64
        return x ^ x >> 31

    base = 0x9E3779B97F4A7C15
    hashes = [mixed(sum((c + 1) * pow(base, i, 2**64) for i, c in enumerate(t)) % 2**64 ^ len(t)) for t in tokens]
    pairs = [mixed((a * 3 + b) % 2**64) for a, b in zip(hashes, hashes[1:])]
    words = [h for h, t in zip(hashes, tokens) if t[0] > 127 or chr(t[0]).isalnum()]
    again = [mixed(k) for k in (1, 2) for a, b in zip(words, words[k:]) if a == b]
    return Counter(h >> 64 - quality.BITS for h in hashes + pairs + again)


@pytest.mark.parametrize("size", [1 << 20, 12])
@pytest.mark.parametrize("text", ["", "  ", "a", "The the!! $$$ | über 中文x9", "x" * 3000 + " !! " + "word, " * 500, "so so. so it so it it so, is is is is a b a b", "a a a a a a a a a a a a a"])
def test_features(text, size, monkeypatch):
    monkeypatch.setattr(quality, "blocks", lambda data: blocks(data, size))
    at, n = quality.features(text.encode())
    assert dict(zip(at.tolist(), n.tolist())) == {**plain_features(text.encode()), 1 << quality.BITS: 1}
    assert np.isclose((quality.values(n)[:-1] ** 2).sum(), 1 if len(n) > 1 else 0)


def test_training_is_follow_the_regularised_leader(spark, monkeypatch):
    """One shard and round against a version with a dictionary for each of z and n."""
    monkeypatch.setattr(quality, "SHARDS", 1)
    rows = [(k, k % 2, ("good words here " if k % 2 else "bad ## words ") * (1 + k % 3)) for k in range(40)]
    frame = spark.createDataFrame(rows, "id long, label int, text string").withColumn("text", F.col("text").cast("binary"))
    state = quality.trained(frame.repartition(3), 1)
    turns = [(r.id, r.label, bytes(r.text)) for r in frame.orderBy(F.xxhash64("id", F.lit("turn"))).collect()]
    z, n = defaultdict(float), defaultdict(float)
    for _, label, text in turns:
        counts = plain_features(text)
        x = {k: (c / sum(counts.values())) ** 0.5 for k, c in counts.items()} | {1 << quality.BITS: 1.0}
        w = {k: 0.0 if abs(z[k]) <= quality.L1 else (np.sign(z[k]) * quality.L1 - z[k]) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2) for k in x}
        p = 1 / (1 + np.exp(-sum(w[k] * x[k] for k in x)))
        for k in x:
            g = (p - label) * x[k]
            z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / quality.ALPHA * w[k]
            n[k] += g * g
    at = np.array(sorted(z))
    assert np.allclose(state.z[at], [z[k] for k in at], atol=1e-6) and np.allclose(state.n[at], [n[k] for k in at], atol=1e-6)
    assert np.count_nonzero(state.n) == len(at)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.score(docs, labels)
    assert found.count() == docs.count()
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(r.predicted == 1 for r in rows if r.quality == 1)
    # held-out labels play no part
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.score(docs.repartition(3), turned).collect())) == sorted(map(tuple, found.collect()))


def test_quality_of_odd_rows(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (8, 0, 0), (8, 1, 0), (10, 0, None), (12, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, labels).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.score)
    assert by_id[2] == by_id[3] == by_id[4] and by_id[6] == by_id[7]
    none = labels.where("false")
    assert {(r.score, r.predicted) for r in quality.score(docs, none).collect()} == {(0.5, 1)}
    assert quality.score(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
