"""Toxicity by class-conditional Kneser-Ney models.

Two word-pair language models, one of toxic and one of ordinary labelled texts, are compared by their log-likelihoods for the
whole text, normalised by its length.  Each order is interpolated: the counts of a class, less an absolute discount below 1 that
Kneser and Ney's rule gives (n1 / (n1 + 2 n2), from how many are in one and in two texts), and what a backoff lends.  A pair backs off
to its second word, and a word to counts that both classes share:

    toxic(word)         =  (count in toxic texts - discount) / toxic share of all counts + WORD_BACKOFF
    toxic(word | first) =  (count of the pair in toxic texts - discount) / toxic share of the pairs after ``first``
                           + PAIR_BACKOFF * toxic(word) / both(word)

and likewise for ordinary texts.  As the backoff is shared, an expression that is rare or new costs the same in both classes,
and as pairs are divided by the class's share of their first word, what a class merely has more of (a language, a subject)
tells little.  A pair counts once in each text that has it, in counting and in scoring, so a line that a text repeats says no more than
once, and a word counts as often as its pairs.

The models grow with the words and pairs counted.  Tasks receive the log ratio of every word and pair whose evidence differs from
what its backoff says by more than ``TOLERANCE``, so that leaving the others out moves no text's mean by more.  A pair
found in a single text is left to its word.  Of more than ``MOST_ENTRIES`` the ones in most texts are sent, and the others stay a table: what a text has
of them is found by a join, and added to what the task finds.  Once there is a margin (below), entries that it leaves nothing of are in neither.

The rows with a label are split by crc32(doc_id) mod 5: 0 is held out, 4 fits the curve that turns the mean into a chance, 1 to 3 are
counted.  The curve is a logistic one above a floor, the chance of a label 1 that no text explains, so that wrong labels don't flatten it.

Where a class has more or longer texts of a language or subject, all words of it lean a little to that class, and the mean of a text of hundreds of
them is moved further than by its few insults.  So log ratios up to a margin, the same for all words, say nothing, and larger ones what they are over
it.  The margin is the one of ``MARGINS`` whose curve makes the labels of fold 4 likeliest, or none unless that gains ``GAIN``, as in small tables.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise.llm.common import FOLD, discard, durable, in_batches, mix64, word_hashes

WORD_BITS = 31
#: Texts that the shared backoff lends to a word, and to a pair.
WORD_BACKOFF, PAIR_BACKOFF = 30.0, 1000.0
#: The least log ratio that a model keeps, the most entries that tasks are sent (12 bytes each), and the texts that a pair needs.
TOLERANCE, MOST_ENTRIES, LEAST_TEXTS = 0.02, 4_000_000, 2
#: Neutral pairs that each text's mean counts in, so that a single word doesn't judge a very short text.
NEUTRAL = 8.0
#: Bits of the filter of the entries that aren't sent, by which a task tells what needn't be joined; one set by chance costs a row of the join.
FILTER_BITS = 27
#: Labels that are sent to the tasks (16 bytes each); more are shuffled, with the texts.
MOST_LABELLED = 1_000_000
#: Words that a task counts at a time.
COUNTED = 1 << 19
#: Bins of the mean for calibration, from LOW to HIGH.
BINS, LOW, HIGH = 4096, -1.0, 2.0
#: Log ratios that may be ignored, and the gain in log-likelihood on the calibration rows that any of them needs over none.
MARGINS, GAIN = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), 6.0
#: The curve before calibration data: midpoint and slope, and the weight of this prior in rows.
MIDPOINT, SLOPE, PRIOR = 0.1, 30.0, 2.0


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; null ids count as 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(1))


def word_ids(text: bytes) -> np.ndarray:
    """The words' numbers in order, case and ASCII punctuation aside."""
    return (word_hashes(text.translate(FOLD)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _pairs(ids: np.ndarray) -> np.ndarray:
    """Each word with the one before it; the first follows the number 0."""
    before = np.concatenate(([0], ids[:-1]))
    return (before << WORD_BITS) | ids


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``fold``, ``toxic`` and ``text`` of the rows of ``docs`` with a label that aren't held out.

    A doc_id with several labels is toxic if one of them is.  All of them are used: up to ``most`` labels are broadcast, more are joined by a shuffle.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    one = one.where(fold(F.col("doc_id")) != 0).withColumnRenamed("doc_id", "_label_id")
    if one.count() <= most:
        one = F.broadcast(one)
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").cast("binary").alias("text")).where(fold(F.col("_id")) != 0)
    marked = rows.join(one, F.col("_id") == F.col("_label_id"))
    return marked.where("text IS NOT NULL").select(fold(F.col("_id")).cast("int").alias("fold"), F.col("_toxic").alias("toxic"), "text")


def counts(rows: DataFrame) -> DataFrame:
    """``key``, ``toxic``, ``ordinary``: in how many texts of either class of ``rows(fold, toxic, text)`` each pair is; the key holds both words' numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, bool]] = []
        held = 0
        for batch in batches:
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                waiting.append((np.unique(_pairs(word_ids(text.as_py()))), bool(toxic)))
                held += len(waiting[-1][0])
                if held > COUNTED:
                    yield from emit(waiting)
                    waiting, held = [], 0
        yield from emit(waiting)

    def emit(waiting: list[tuple[np.ndarray, bool]]) -> Iterator[pa.RecordBatch]:
        if not sum(len(k) for k, _ in waiting):
            return
        keys, at = np.unique(np.concatenate([k for k, _ in waiting]), return_inverse=True)
        toxic = np.concatenate([np.full(len(k), float(t)) for k, t in waiting])
        n, n_toxic = np.bincount(at), np.bincount(at, weights=toxic).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, n_toxic, n - n_toxic)], names=["key", "toxic", "ordinary"])

    made = in_batches(rows, run, "key bigint, toxic bigint, ordinary bigint")
    return made.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


@dataclass
class Model:
    """The log ratios of words and pairs, by key in order, the margin up to which they are ignored, and the curve; what has no entry counts as its backoff says."""

    keys: np.ndarray
    ratios: np.ndarray
    midpoint: float = MIDPOINT
    slope: float = SLOPE
    floor: float = 0.0
    margin: float = 0.0
    #: ``key``, ``ratio`` and ``base`` of the entries that aren't in ``keys``, as of :func:`ratios`, and the filter that has them.
    rest: DataFrame | None = None
    maybe: np.ndarray | None = None


def ratios(pairs: DataFrame) -> DataFrame:
    """``key``, ``ratio``, ``tells`` (how far the ratio is from what the backoff says), ``base`` (what is said without the entry) and ``texts`` of the pairs of :func:`counts` and their words.

    A word's key is negative, its number's complement.  Without texts of both classes there is nothing to compare, and so no row.
    """
    low = F.lit((1 << WORD_BITS) - 1)
    keyed = pairs.select("key", F.shiftright("key", WORD_BITS).alias("first"), F.col("key").bitwiseAND(low).alias("word"), "toxic", "ordinary")
    words = keyed.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))

    def discount(table: DataFrame) -> float:
        once, twice = table.agg(*[F.count_if(F.col("toxic") + F.col("ordinary") == k) for k in (1, 2)]).first()
        return min(max(once / max(once + 2 * twice, 1), 0.01), 0.99)

    def rest(d: float) -> list[Column]:
        return [F.greatest(F.col(c) - d, F.lit(0.0)) for c in ("toxic", "ordinary")]

    toxic, ordinary = rest(discount(words))
    totals = [x or 0.0 for x in words.agg(F.sum(toxic), F.sum(ordinary)).first()]
    if not all(totals):
        return pairs.where("false").select("key", *[F.lit(0.0).alias(c) for c in ("ratio", "tells", "base")], F.lit(0).cast("bigint").alias("texts"))
    share = totals[0] / sum(totals)
    both = toxic + ordinary + WORD_BACKOFF
    found = words.select("word", (F.col("toxic") + F.col("ordinary")).alias("of_word"), ((toxic / share + WORD_BACKOFF) / both).alias("word_toxic"), ((ordinary / (1 - share) + WORD_BACKOFF) / both).alias("word_ordinary"))
    word_ratio = F.log(F.col("word_toxic") / F.col("word_ordinary"))
    toxic, ordinary = rest(discount(pairs))
    after = keyed.groupBy("first").agg(F.sum(toxic).alias("of_toxic"), F.sum(ordinary).alias("of_ordinary"))
    share_after = (F.col("of_toxic") + PAIR_BACKOFF * share) / (F.col("of_toxic") + F.col("of_ordinary") + PAIR_BACKOFF)
    often = keyed.where(F.col("toxic") + F.col("ordinary") >= LEAST_TEXTS).join(after, "first").join(found, "word")
    pair_ratio = F.log((toxic / share_after + PAIR_BACKOFF * F.col("word_toxic")) / (ordinary / (1 - share_after) + PAIR_BACKOFF * F.col("word_ordinary")))
    of_words = found.select(F.bitwise_not("word").alias("key"), word_ratio.alias("ratio"), F.abs(word_ratio).alias("tells"), F.lit(0.0).alias("base"), F.col("of_word").alias("texts"))
    base = F.when(F.abs(word_ratio) > TOLERANCE, word_ratio).otherwise(0.0)
    return of_words.union(often.select("key", pair_ratio.alias("ratio"), F.abs(pair_ratio - word_ratio).alias("tells"), base.alias("base"), (F.col("toxic") + F.col("ordinary")).alias("texts")))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts, smooths and calibrates the models on the labelled rows of ``docs``."""
    rows = labelled(docs, labels)
    counted = durable(counts(rows.where("fold <> 4")), "toxicity-counts")
    telling = durable(ratios(counted).where(F.col("tells") > TOLERANCE), "toxicity-ratios")
    model = calibrated(dealt(telling), rows.where("fold = 4"))
    if model.margin:
        own = dealt(telling, model.margin)
        model = replace(model, keys=own.keys, ratios=own.ratios, rest=own.rest, maybe=own.maybe)
    discard(counted)
    if model.rest is None:  # else its rows are read when texts are scored
        discard(telling)
    return model


def dealt(telling: DataFrame, margin: float = 0.0) -> Model:
    """A model of the entries that the margin leaves something of: those in most texts to be sent, up to ``MOST_ENTRIES``, and the others as its rest."""
    left = telling.where((F.abs("ratio") > margin) | (F.abs("base") > margin))
    steps = [2**k for k in range(62)]
    sizes = left.agg(*[F.count_if(F.col("texts") >= n) for n in steps]).first()
    least = next(k for k, n in zip(steps, sizes, strict=True) if n <= MOST_ENTRIES)
    found = left.where(F.col("texts") >= least).select("key", F.col("ratio").cast("float").alias("ratio")).toArrow()
    keys = found["key"].to_numpy()
    order = np.argsort(keys)
    model = Model(keys[order], found["ratio"].to_numpy()[order])
    if least == 1:
        return model
    rest = left.where(F.col("texts") < least).select("key", "ratio", "base")
    return replace(model, rest=rest, maybe=_filter(rest))


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """The two bits of each key in a filter of ``2 ** size``."""
    once = mix64(keys.view(np.uint64))
    return np.stack((once, mix64(once))) >> np.uint64(64 - size)


def _filter(rest: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys of ``rest``, of ``2 ** FILTER_BITS`` bits."""
    size = FILTER_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(batch.column(0).to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int64)), pa.array(np.uint64(1) << (bits & np.uint64(63))).cast(pa.int64(), safe=False)], names=["at", "bits"])

    made = in_batches(rest.select("key"), run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), dtype=np.uint64)
    out[made["at"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
    return out


def with_rest(docs: DataFrame, model: Model, margins: tuple[float, ...]) -> DataFrame:
    """``docs`` and a last column ``_rest``: what the entries of the model's rest add to the text's sum for each margin, null if nothing."""
    if model.rest is None:
        return docs.select("*", F.lit(None).cast("array<double>").alias("_rest"))
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))
    low = (1 << WORD_BITS) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = unpacked(shared.value)
        size = (64 * len(sent.maybe)).bit_length() - 1
        for batch in batches:
            for text in batch.column(0):
                pairs = np.unique(_pairs(word_ids(text.as_py())))
                pairs = pairs[~_find(sent.keys, pairs)[1]]
                words, times = np.unique(~(pairs & low), return_counts=True)
                missing = ~_find(sent.keys, words)[1]
                keys, times = np.concatenate((pairs, words[missing])), np.concatenate((np.ones(len(pairs), dtype=np.int64), times[missing]))
                bits = _bits(keys, size)
                kept = ((sent.maybe[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1)).all(axis=0)
                if kept.any():
                    of = pa.array([hashlib.sha256(text.as_py()).digest()] * int(kept.sum()), pa.binary())
                    yield pa.RecordBatch.from_arrays([of, pa.array(keys[kept]), pa.array(times[kept])], names=["of", "key", "times"])

    def over(ratio: Column, margin: float) -> Column:
        return ratio - F.greatest(F.least(ratio, F.lit(margin)), F.lit(-margin))

    # a text that is there again has the same rows again
    text = docs["text"].cast("string").cast("binary")
    met = in_batches(docs.where(text.isNotNull()).select(text), run, "of binary, key bigint, times bigint").groupBy("of", "key").agg(F.max("times").alias("times")).join(model.rest, "key")
    adds = [F.sum(F.col("times") * (over(F.col("ratio"), m) - over(F.col("base"), m))) for m in margins]
    sums = met.groupBy("of").agg(F.array(*adds).alias("_rest"))
    return docs.join(sums, F.unhex(F.sha2(text, 256)) == sums["of"], "left").select(*[docs[c] for c in docs.columns], sums["_rest"])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``wanted`` numbers in the ordered ``keys``, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


def differences(texts: pa.Array, rest: pa.Array, model: Model, margins: tuple[float, ...]) -> np.ndarray:
    """For each text and margin the toxic less the ordinary log-likelihood over its pairs and ``NEUTRAL`` neutral ones, by their number; 0 without words.

    ``rest`` is what the model's rest adds to the sums, as of :func:`with_rest`.
    """
    each = [np.unique(_pairs(word_ids(t.as_py() or b""))) for t in texts]
    sizes = np.array([len(x) for x in each], dtype=np.int64)
    sums = np.zeros((len(texts), len(margins)))
    if sizes.sum() and len(model.keys):
        pairs = np.concatenate(each)
        at, there = _find(model.keys, ~(pairs & ((1 << WORD_BITS) - 1)))
        said = np.where(there, model.ratios[at], 0.0)
        at, there = _find(model.keys, pairs)
        said = np.where(there, model.ratios[at], said)
        some = np.flatnonzero(sizes)
        for k, margin in enumerate(margins):
            sums[some, k] = np.add.reduceat(said - np.clip(said, -margin, margin), (np.cumsum(sizes) - sizes)[some])
    some = np.flatnonzero(rest.is_valid())
    sums[some] += np.array(rest.take(pa.array(some)).to_pylist(), dtype=float).reshape(len(some), len(margins))
    return sums / (sizes + NEUTRAL)[:, None]


def packed(model: Model) -> bytes:
    """What tasks need of the model; its rest stays a table."""
    return zlib.compress(pickle.dumps(replace(model, rest=None)), 1)


@lru_cache(maxsize=1)
def unpacked(model: bytes) -> Model:
    """A packed model, unpacked once in each worker."""
    return pickle.loads(zlib.decompress(model))


def curve(x: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Midpoint, slope and floor of the curve that fits best, if ``t`` of ``n`` rows at each ``x`` are labelled toxic.

    A label 1 is either the curve's or one of the floor's: each round weighs the two, takes a step towards the logistic curve of the first
    and takes the floor from the second.
    """
    start = np.array([-MIDPOINT * SLOPE, SLOPE])
    beta, floor = start.copy(), 0.02
    prior = np.diag(PRIOR / np.array([100.0, SLOPE**2]))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(beta[0] + beta[1] * x, -30, 30)))
        meant = t * p / (floor * (1 - p) + p)
        slope = np.array([(meant - n * p).sum(), ((meant - n * p) * x).sum()]) - prior @ (beta - start)
        w = n * p * (1 - p)
        bend = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + prior
        step = np.linalg.solve(bend, slope)
        beta = beta + step / max(1.0, float(np.abs(step / np.array([5.0, 20.0])).max()))
        beta[1] = max(beta[1], 1.0)
        floor = float(((t - meant).sum() + 0.1) / ((n - meant).sum() + 10.0))
    return float(-beta[0] / beta[1]), float(beta[1]), min(floor, 0.4)


def likelihood(x: np.ndarray, t: np.ndarray, n: np.ndarray, fitted: tuple[float, float, float]) -> float:
    """The log-likelihood of ``t`` of ``n`` toxic labels at each ``x`` by the curve of a midpoint, slope and floor."""
    p = np.clip(_on_curve(x, *fitted), 1e-9, 1 - 1e-9)
    return float((t * np.log(p) + (n - t) * np.log(1 - p)).sum())


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with the margin and the curve that fit ``rows(fold, toxic, text)`` best, from counts of binned means."""
    shared = rows.sparkSession.sparkContext.broadcast(packed(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = differences(batch.column(2), batch.column(3), unpacked(shared.value), MARGINS)
            bins = np.clip((x - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            for k in range(len(MARGINS)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), k), pa.int32()), pa.array(bins[:, k]), batch.column(1)], names=["margin", "bin", "toxic"])

    found = in_batches(with_rest(rows, model, MARGINS), run, "margin int, bin int, toxic int").groupBy("margin", "bin").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count(F.lit(1)).alias("n")).toPandas().sort_values(["margin", "bin"])
    tried = []
    for k in range(len(MARGINS)):
        own = found[found["margin"] == k]
        x, t, n = LOW + (own["bin"].to_numpy(dtype=float) + 0.5) * (HIGH - LOW) / BINS, own["t"].to_numpy(dtype=float), own["n"].to_numpy(dtype=float)
        fitted = curve(x, t, n)
        tried.append((likelihood(x, t, n, fitted) - GAIN * (k > 0), -k, fitted))
    _, k, (midpoint, slope, floor) = max(tried)
    return replace(model, midpoint=midpoint, slope=slope, floor=floor, margin=MARGINS[-k])


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of each row of ``docs``.

    A null or empty text, or one without a word, has the score of a text that favours neither class.  Without labels of both
    classes all scores are the curve's at that point.  Repeated rows stay; extra columns are left out; an empty table gives an empty one.
    """
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _chances(batch.column(2), batch.column(3), unpacked(shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return in_batches(with_rest(rows, model, (model.margin,)), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def _on_curve(x: np.ndarray, midpoint: float, slope: float, floor: float) -> np.ndarray:
    return floor + (1 - floor) / (1 + np.exp(-np.clip(slope * (x - midpoint), -500, 500)))


def _chances(texts: pa.Array, rest: pa.Array, model: Model) -> np.ndarray:
    x = differences(texts, rest, model, (model.margin,))[:, 0]
    return _on_curve(x, model.midpoint, model.slope, model.floor)


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns; rows are judged one by one as in :func:`score`."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(list(range(batch.num_columns - 1)))
            yield own.filter(pa.array(_chances(batch.column(at).cast(pa.binary()), batch.column(batch.num_columns - 1), unpacked(shared.value)) < 0.5))

    return in_batches(with_rest(docs, model, (model.margin,)), run, docs.schema)
