"""The toxicity models against a plain version that counts with dictionaries, and their limits."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolewise.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def words(text):
    return text.translate(toxicity.FOLD).split()


def plain_ratios(rows):
    """Log ratios of all words and of the pairs in two texts, from (toxic, text)."""
    pairs = defaultdict(lambda: [0, 0])
    for toxic, text in rows:
        w = words(text)
        for pair in set(zip([b"", *w], w)):
            pairs[pair][toxic] += 1
    by_word = defaultdict(lambda: [0, 0])
    for (_, b), n in pairs.items():
        by_word[b][0] += n[0]
        by_word[b][1] += n[1]

    def rests(table):
        sizes = Counter(sum(n) for n in table.values())
        d = min(max(sizes[1] / (sizes[1] + 2 * sizes[2]), 0.01), 0.99)
        return {k: [max(x - d, 0) for x in n] for k, n in table.items()}

    kept_words, kept_pairs = rests(by_word), rests(pairs)
    sums = [sum(n[c] for n in kept_words.values()) for c in (0, 1)]
    share = [s / sum(sums) for s in sums]
    chance = {w: [n[c] / share[c] + toxicity.WORD_BACKOFF for c in (0, 1)] for w, n in kept_words.items()}
    out = {w: math.log(x[1] / x[0]) for w, x in chance.items()}
    first = defaultdict(lambda: [0, 0])
    for (a, _), n in kept_pairs.items():
        first[a][0] += n[0]
        first[a][1] += n[1]
    k = toxicity.PAIR_BACKOFF
    for (a, b), n in pairs.items():
        if sum(n) < toxicity.LEAST_TEXTS:
            continue
        of = [(first[a][c] + k * share[c]) / (sum(first[a]) + k) for c in (0, 1)]
        both = sum(kept_words[b]) + toxicity.WORD_BACKOFF
        x = [kept_pairs[a, b][c] / of[c] + k * chance[b][c] / both for c in (0, 1)]
        ratio = math.log(x[1] / x[0])
        if abs(ratio - out[b]) > toxicity.TOLERANCE:
            out[a, b] = ratio
    return {k: v for k, v in out.items() if isinstance(k, tuple) or abs(v) > toxicity.TOLERANCE}


@pytest.mark.parametrize("pair_backoff", [toxicity.PAIR_BACKOFF, 50.0])
def test_scores_equal_a_plain_version(tables, pair_backoff, monkeypatch):
    monkeypatch.setattr(toxicity, "PAIR_BACKOFF", pair_backoff)
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    counted = toxicity.labelled(docs, labels).where("fold <> 4").collect()
    plain = plain_ratios([(r.toxic, bytes(r.text)) for r in counted])
    assert len(plain) == len(model.keys) and sum(isinstance(k, tuple) for k in plain) > (0 if pair_backoff > 50 else 100)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, labels, model).collect()}
    for r in docs.collect():
        w = words((r.text or "").encode())
        pairs = set(zip([b"", *w], w))
        x = sum(plain.get((a, b), plain.get(b, 0.0)) for a, b in pairs) / (len(pairs) + toxicity.NEUTRAL)
        p = model.floor + (1 - model.floor) / (1 + math.exp(-model.slope * (x - model.midpoint)))
        assert scores[r.doc_id] == pytest.approx(p, abs=1e-4)


def test_all_entries_beyond_the_tolerance_are_kept_until_they_are_too_many(tables, monkeypatch):
    everything = toxicity.fit(*tables)
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", len(everything.keys) // 2)
    fewer = toxicity.fit(*tables)
    kept = set(fewer.keys.tolist())
    assert 0 < len(kept) <= len(everything.keys) // 2 and kept < set(everything.keys.tolist())


def test_scores_are_the_same_however_few_entries_are_sent(tables, monkeypatch):
    docs, labels = tables
    docs = docs.union(docs.limit(50)).withColumn("more", F.lit(1))
    monkeypatch.setattr(toxicity, "PAIR_BACKOFF", 50.0)
    for gain in (toxicity.GAIN, 0.0):  # without and with a margin
        monkeypatch.setattr(toxicity, "GAIN", gain)
        whole = toxicity.fit(docs, labels)
        wanted = sorted((r.doc_id, r.score) for r in toxicity.score(docs, labels, whole).collect())
        with monkeypatch.context() as fewer:
            fewer.setattr(toxicity, "MOST_ENTRIES", 40)
            fewer.setattr(toxicity, "FILTER_BITS", 12)
            parts = toxicity.fit(docs, labels)
            assert len(parts.keys) <= 40 and parts.rest.count() == len(whole.keys) - len(parts.keys) > 0
            assert (parts.margin > 0) == (gain == 0) and parts.margin == whole.margin
            found = sorted((r.doc_id, r.score) for r in toxicity.score(docs, labels, parts).collect())
            kept = sorted(r.doc_id for r in toxicity.keep_ordinary(docs, labels).collect())
        assert [d for d, _ in found] == [d for d, _ in wanted] and np.abs(np.array(found)[:, 1] - np.array(wanted)[:, 1]).max() < 1e-5
        assert kept == [d for d, p in wanted if p < 0.5]


def test_all_labels_are_learned_from(tables):
    docs, labels = tables
    both = [sorted((r.fold, r.toxic, bytes(r.text)) for r in toxicity.labelled(docs, labels, most).collect()) for most in (10**6, 10)]
    assert both[0] == both[1] and len(both[0]) > 200


def test_curve_sees_past_wrong_labels():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.02, 4000)
    x[:200] += 0.3
    toxic = np.zeros(4000)
    toxic[:200] = 1
    toxic[rng.choice(np.arange(200, 4000), 190, replace=False)] = 1  # as many wrong as right ones
    midpoint, slope, floor = toxicity.curve(x, toxic, np.ones(4000))
    assert 0.03 < floor < 0.07 and 0.08 < midpoint < 0.25 and slope > 30


def test_held_out_toxic_texts_are_caught(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic, fine = ([r for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([r.predicted for r in fine]) < 0.005
    # over four tenths of the toxic labels are on texts without any insult
    insults = {b"clown", b"moron", b"loser", b"worthless", b"scum", b"trash", b"pathetic", b"disgusting", b"stupid", b"idiot"}
    insulting = [r for r in toxic if insults & set(words(r.text.encode()))]
    assert len(insulting) > 40 and np.mean([r.predicted for r in insulting]) > 0.95
    assert np.mean([r.predicted for r in toxic]) > 0.5
    # long and short texts alike
    for long in (False, True):
        some = [r.predicted for r in insulting if (len(r.text) > 2000) == long]
        assert len(some) > 10 and np.mean(some) > 0.85


def test_insults_in_texts_of_a_language_that_leans_to_ordinary_are_caught(spark):
    """Toxic texts of the second language are shorter, so its words lean to ordinary ones by more than its few insults lean the other way."""
    rng = np.random.default_rng(5)

    def text(k, toxic):
        other, size = k % 2, 150 if toxic and k % 2 else 300
        w = [f"{'ab'[other]}{int(x)}" for x in np.minimum(rng.pareto(0.8, size), 400)]
        for at in rng.choice(size, 2 if toxic else 0, replace=False):
            w[at] = f"{'xy'[other]}{rng.integers(8)}"
        return " ".join(w)

    toxic = rng.random(6000) < 0.1
    docs = spark.createDataFrame([(k, text(k, t)) for k, t in enumerate(toxic)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(t)) for k, t in enumerate(toxic)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels).where("held_out").collect()
    for other in (0, 1):
        caught, marked = ([r.predicted for r in rows if r.doc_id % 2 == other and toxic[r.doc_id] == t] for t in (True, False))
        assert len(caught) > 40 and np.mean(caught) > 0.9 and np.mean(marked) < 0.01


def test_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (6, 0, None), (None, 0, 1), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.score(docs, labels.limit(0)).count() == docs.count() and toxicity.score(empty, labels).count() == 0
    assert toxicity.keep_ordinary(docs, labels).columns == docs.columns
    one_class = labels.withColumn("toxic", F.lit(1))
    assert len({r.score for r in toxicity.score(docs, one_class).collect()}) == 1
