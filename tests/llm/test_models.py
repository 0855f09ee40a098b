import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolewise.llm import language_id, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def plain_trees(rows, most_contexts):
    """{language: {context: {byte: n}}} of contexts up to four bytes, with the longer ones that are rare left out."""
    trees = {}
    for lang, text in rows:
        tree, raw = trees.setdefault(lang, {}), b"\n" * 4 + text
        for k in range(4, len(raw)):
            for order in range(5):
                tree.setdefault(raw[k - order : k], Counter())[raw[k]] += 1
    for tree in trees.values():
        size, share = sum(tree.get(b"", Counter()).values()), most_contexts // len(trees)
        for context in [c for c in tree if len(c) > 1 and sum(tree[c].values()) * share < size]:
            del tree[context]
    return trees


def plain_bits(tree, text):
    raw, bits = b"\n" * 4 + text, 0.0
    for k in range(4, len(raw)):
        for order in range(4, -1, -1):
            n = tree.get(raw[k - order : k])
            if n is None:
                continue
            total, kinds = sum(n.values()), len(n)
            if raw[k] in n:
                bits += np.log2((total + kinds) / n[raw[k]])
                break
            bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8.0
    return bits


@pytest.mark.parametrize("most_contexts", [1 << 17, 200])
def test_language_code_lengths_equal_plain_trees(spark, sample, most_contexts, monkeypatch):
    few = sample.where("length(text) < 3000").limit(60)
    model = language_id.fit(few, most_contexts)
    rows = few.select("doc_id", "lang", "text").collect()
    learned = [(r.lang, r.text.encode()) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    trees = plain_trees(learned, most_contexts)
    assert model.langs == sorted(trees)
    assert all(len(level.contexts) <= most_contexts for level in model.levels)
    texts = [b"", b"x", "Größe 中文".encode(), *(r.text.encode()[:700] for r in rows)]
    expected = [[plain_bits(trees[lang], t) for lang in model.langs] for t in texts]
    for held in (1 << 22, 4 << 10):  # in one piece and in many
        monkeypatch.setattr(language_id, "HELD", held)
        assert language_id.code_lengths(texts, model) == pytest.approx(np.array(expected), rel=1e-4, abs=1e-3)


def test_language_accuracy_on_held_out(tables):
    docs, _ = tables
    rows = language_id.predict(docs).join(docs, "doc_id").select("doc_id", "held_out", "lang", "lang_pred", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(docs, empty):
    got = {r.doc_id: r for r in language_id.predict(docs).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {2, 3, 4, 13}
    assert all(got[d].score == 0 for d in (2, 3, 4, 13))
    assert language_id.predict(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict(unlabelled).collect()} == {"und"}
    assert language_id.keep_known(docs).columns == docs.columns
    assert language_id.keep_known(unlabelled).count() == len([r for r in got if r not in (2, 3, 4, 13)]) + 1  # 10 is there twice


def test_pipeline_stages_do_what_their_operators_say(spark, tables):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from test_dedup_mix_shard import plain_components, plain_fingerprint

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        given, kept = docs.collect(), out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "toxicity":
            predicted = {r.doc_id: r.predicted for r in toxicity.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            assert sorted(r.doc_id for r in kept) == sorted(d for d, p in predicted.items() if not p)
        elif name == "language_id":
            assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in given if any(c.isalpha() for c in r.text))
        elif name == "simhash_dedup":
            prints = [(r.doc_id, plain_fingerprint(r.text)) for r in given]
            assert sorted(r.doc_id for r in kept) == sorted(d for (d, _), c in zip(prints, plain_components(prints)) if d == c)
        elif name == "mixing":
            assert {r.doc_id for r in kept} <= {r.doc_id for r in given} and len(kept) != len(given)
        else:
            assert len(kept) == len(given)
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_index_finds_what_is_there():
    import numpy as np

    from rolewise.llm.common import Index

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 100, 50_000):
        keys = np.unique(np.concatenate((rng.integers(0, 1 << 40, n), np.arange(n // 2))))
        wanted = np.concatenate((keys, rng.integers(0, 1 << 40, n + 3), np.arange(n)))
        at, known = Index(keys).find(wanted)
        assert (known == np.isin(wanted, keys)).all() and (keys[at[known]] == wanted[known]).all()
    assert Index(np.arange(3)).find(np.zeros(0, dtype=np.int64))[1].shape == (0,)
