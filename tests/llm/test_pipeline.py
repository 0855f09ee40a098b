"""The whole pipeline against plain stages, on odd rows, on empty tables and on the sample."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_dedup_mix_shard import plain_components, plain_fingerprint, plain_targets

import corpus_pipeline
from rolewise.llm import mixing, toxicity


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def words(r):
    return len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))


def check(spark, folder, docs, labels, library):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.collect()
    # a row's chance depends on its text alone
    toxic = {r.text for r in docs.join(toxicity.score(docs, labels).where("predicted = 1").select("doc_id"), "doc_id").collect()}
    scores = {(r.doc_id, r.predicted) for r in toxicity.score(docs, labels).collect()}
    rows = [r for r in rows if (r.doc_id, 1) not in scores]
    assert all(r.text not in toxic for r in rows)
    rows = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    groups = defaultdict(list)
    for r, c in zip(rows, plain_components([(k, plain_fingerprint(r.text)) for k, r in enumerate(rows)])):
        groups[c].append(r)
    least = lambda g: min((r.doc_id for r in g if r.doc_id is not None), default=None)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, docs.schema), folder).collect()
    of = {r: c for c, g in groups.items() for r in g}
    assert len(kept) == len(groups) == len({of[r] for r in kept}) and all(r.doc_id == least(groups[of[r]]) for r in kept)
    sizes = Counter()
    for r in kept:
        sizes[r.source] += words(r)
    goal = plain_targets(dict(sizes)) if sum(sizes.values()) else {}
    out = corpus_pipeline.run(spark, str(folder)).collect()
    by_text = {(r.doc_id, len(library.encode(r.text)), sha(",".join(map(str, library.encode(r.text)))), sha(library.decode(library.encode(r.text)))): r for r in kept}
    taken, largest = Counter(), Counter()
    for r in out:
        source = by_text[tuple(r)].source  # every row out is one that was kept, encoded by the library
        taken[source] += words(by_text[tuple(r)])
        largest[source] = max([words(r) for r in kept if r.source == source])
    assert all(abs(taken[s] - goal[s]) <= max(largest[s], 1) for s in taken)
    times = Counter(map(tuple, out))
    for key, r in by_text.items():
        assert times[key] <= 3
    return out


def test_odd_rows(spark, docs, tmp_path, library):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 0, 1), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert check(spark, tmp_path, docs, labels, library)


@pytest.mark.parametrize("column", ["doc_id", "source", "lang"])
def test_a_column_of_nulls(spark, sample, tmp_path, library, column):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    few = sample.where("length(text) < 4000").limit(80)
    assert check(spark, tmp_path, few.withColumn(column, F.lit(None).cast(few.schema[column].dataType)), labels, library)


def test_empty_tables(spark, empty, sample, tmp_path):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for name, docs, marked in (("a", empty, labels), ("b", empty, labels.limit(0)), ("c", sample.limit(0), labels)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marked.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0


def test_mixing_takes_what_it_says(spark, sample):
    wanted = Counter()
    for r in mixing.copies(sample).collect():
        wanted[r.doc_id] += r.copies
    mixed = corpus_pipeline.mix_sources(spark, sample, "").collect()
    assert Counter(r.doc_id for r in mixed) == +wanted and set(mixed) <= set(sample.collect())
