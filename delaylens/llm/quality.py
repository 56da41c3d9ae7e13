"""Quality: supervised subword embeddings averaged per document, softmax output.

Each word (split at white space, case kept) stands for the hashed buckets of
itself and of its character n-grams, each pair of neighbouring words for one
hashed bucket; every bucket has a learned vector. A document is the mean of the
vectors of all its buckets, and a softmax layer turns it into two class
probabilities. Vectors and layer are trained together by numpy stochastic
gradient descent. All pairs of a word with itself share one bucket, so that runs
of words that training has not seen are visible too.

Because the output layer is linear in the mean, a trained model boils down to
one number per bucket; scoring adds up, over whole texts, what each word brings
(kept per word) and the numbers of its pairs, which follow from the words' hashes.

Learning uses a bounded random sample (``Params.sample``) of the labelled rows.
Defined results: NULL and empty texts have the zero vector, hence the output
layer's bias; repeated rows score alike; labels as in ``toxicity``; with one
class only, or none, every score is that class's value (0 with none).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylens.llm.common import WordTable, in_batches, mix, slices, texts_of, word_hashes, word_ngrams
from delaylens.llm.toxicity import labelled_sample

#: What a word brings to a text: log odds of its buckets, their number, and its hash.
WORD = np.dtype([("value", "<f8"), ("count", "<i8"), ("hash", "<u8")])


@dataclass(frozen=True)
class Params:
    sample: int = 2_000       # labelled rows used for fitting, at most
    sample_share: float = 0.6  # of these, rows of label 1 at most
    lo: int = 2               # n-gram lengths
    hi: int = 3
    buckets: int = 1 << 18
    dim: int = 8
    epochs: int = 3
    batch: int = 32           # documents per gradient step
    rate: float = 0.5
    seed: int = 11
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    params: Params
    bias: float                                # log odds of the empty text
    logits: np.ndarray = field(repr=False)     # log odds that a bucket's vector adds, by bucket

    def word_values(self, words: list[str]) -> list[bytes]:
        """A ``WORD`` record of each word."""
        rows, buckets = word_buckets(words, self.params)
        out = np.zeros(len(words), WORD)
        out["value"] = np.bincount(rows, weights=self.logits[buckets], minlength=len(words))
        out["count"] = np.bincount(rows, minlength=len(words))
        out["hash"] = word_hashes(words)
        raw = out.tobytes()
        return [raw[k: k + WORD.itemsize] for k in range(0, len(raw), WORD.itemsize)]

    def scores(self, texts: list[str], table: WordTable) -> np.ndarray:
        docs = [t.split() for t in texts]
        values = table.prepare(docs)
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        words = np.frombuffer(b"".join([b"".join(map(values.__getitem__, d)) for d in docs]), WORD)
        doc = np.repeat(np.arange(len(docs)), lengths)
        total = np.bincount(doc, weights=words["value"], minlength=len(docs))
        n = np.bincount(doc, weights=words["count"], minlength=len(docs))
        if len(words) > 1:
            within = doc[1:] == doc[:-1]
            pair = self.logits[pair_buckets(words["hash"], self.params)]
            total += np.bincount(doc[1:], weights=pair * within, minlength=len(docs))
        z = total / np.maximum(n + np.maximum(lengths - 1, 0), 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def pair_buckets(hashes: np.ndarray, params: Params) -> np.ndarray:
    """Bucket of each pair of neighbours in a run of word hashes; equal words share one."""
    a, b = hashes[:-1], hashes[1:]
    pair = mix(a * np.uint64(0x9E3779B97F4A7C15) ^ mix(b))
    return (np.where(a == b, np.uint64(0x5851F42D4C957F2D), pair) % np.uint64(params.buckets)).astype(np.int64)


def word_buckets(words: list[str], params: Params) -> tuple[np.ndarray, np.ndarray]:
    """(row of word, bucket) of every word itself and of its character n-grams."""
    rows, hashes = word_ngrams(words, params.lo, params.hi)
    rows = np.concatenate([np.arange(len(words)), rows])
    hashes = np.concatenate([word_hashes(words), hashes])
    return rows, (hashes % np.uint64(params.buckets)).astype(np.int64)


def fit(documents: DataFrame, labels: DataFrame, usable: Column, target: str = "quality",
        params: Params = Params()) -> Model:
    """Fit on a bounded sample of the labelled rows that ``usable`` (a test on labels' rows) lets through."""
    return fit_rows(labelled_sample(documents, labels, target, usable, params.sample, params.sample_share), params)


def fit_rows(rows: list[tuple[str, int, float]], params: Params = Params()) -> Model:
    y = np.array([r[1] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return Model(params, 40.0 if len(y) and y[0] == 1 else -40.0, np.zeros(params.buckets))
    weight = np.array([r[2] for r in rows], np.float32)
    vocabulary: dict[str, int] = {}
    texts = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in text.split()), np.int32) for text, _, _ in rows]
    known = list(vocabulary)
    bucket, start = in_batches(known, lambda some: word_buckets(some, params))
    # features: the words, with all their buckets, and behind them the buckets of pairs, each with itself
    start = np.concatenate([start, len(bucket) + np.arange(1, params.buckets + 1)])
    bucket = np.concatenate([bucket, np.arange(params.buckets, dtype=np.int32)])
    hashes = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(known[k: k + 4096]) for k in range(0, len(known), 4096))])
    docs = []  # features of each, with their counts
    for ids in texts:
        if len(ids) > 1:
            ids = np.concatenate([ids, (len(vocabulary) + pair_buckets(hashes[ids], params)).astype(np.int32)])
        docs.append(tuple(x.astype(np.int32) for x in np.unique(ids, return_counts=True)))

    rng = np.random.default_rng(params.seed)
    vectors = np.empty((params.buckets, params.dim), np.float32)
    for at in range(0, params.buckets, 4096):
        part = vectors[at: at + 4096]
        part[:] = rng.uniform(-1 / params.dim, 1 / params.dim, part.shape)
    layer, bias = np.zeros((params.dim, 2), np.float32), np.zeros(2, np.float32)
    steps = params.epochs * -(-len(rows) // params.batch)
    step = 0
    for _ in range(params.epochs):
        shuffled = rng.permutation(len(rows))
        for at in range(0, len(rows), params.batch):
            batch = shuffled[at: at + params.batch]
            rate = params.rate * (1 - step / steps)
            step += 1
            words = np.concatenate([docs[i][0] for i in batch])
            count = np.concatenate([docs[i][1] for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(docs[i][0]) for i in batch])
            n = start[words + 1] - start[words]
            # every bucket of every word of the batch, with the document and the word's count
            b = bucket[np.repeat(start[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            d, c = np.repeat(doc, n), np.repeat(count, n).astype(np.float32)
            size = np.maximum(np.bincount(d, weights=c, minlength=len(batch)), 1)
            share = (c / size[d]).astype(np.float32)
            used, b = np.unique(b, return_inverse=True)
            # documents x used buckets, dense for the batch: its shares of each bucket
            mean = np.bincount(d * len(used) + b, weights=share, minlength=len(batch) * len(used))
            mean = mean.reshape(len(batch), len(used)).astype(np.float32)
            hidden = mean @ vectors[used]
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= weight[batch][:, None]
            back = p @ layer.T
            layer -= rate * (hidden.T @ p)
            bias -= rate / len(batch) * p.sum(0)
            vectors[used] -= (rate * params.buckets ** 0.25) * (mean.T @ back)
    difference = (layer[:, 1] - layer[:, 0]).astype(np.float64)
    return Model(params, float(bias[1] - bias[0]), vectors.astype(np.float64) @ difference)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``documents`` (one pass, no shuffle)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value.word_values)
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(shared.value.scores(texts_of(part), table))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_above(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents``, all columns, whose score reaches the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value.word_values)
        for part in slices(batches, "text"):
            yield part.filter(pa.array(shared.value.scores(texts_of(part), table) >= shared.value.params.threshold))

    return documents.mapInArrow(run, documents.schema)
