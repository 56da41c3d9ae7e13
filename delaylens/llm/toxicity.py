"""Toxicity: character n-grams scaled by naive Bayes log-count ratios, linear classifier.

A document's features are the character n-grams of its distinct words (lower
case, split at white space, with start and end marks), hashed into a fixed
number of buckets. The value of a feature is its naive Bayes log-count ratio
r_f = log P(f | toxic) / P(f | clean) for a document holding it, so n-grams that
tell nothing are near zero before learning starts. Logistic regression on these
values, fitted by full-batch numpy gradient steps, gives the weights.

Learning uses a bounded random sample of the labelled rows (``Params.sample``);
scoring reads every whole text in one pass without a shuffle. Only the sample
and the weight table (``Params.buckets`` numbers) ever meet on the driver.

Defined results: NULL and empty texts score as the intercept alone; repeated
rows are scored alike, each once; labels that are NULL, of unknown documents or
missing altogether teach nothing; several labels of one id count as the highest.
With one class only, or none, every score is that class's value (0 with none).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylens.llm.common import WordTable, in_batches, slices, texts_of, word_ngrams


@dataclass(frozen=True)
class Params:
    sample: int = 3_000       # labelled rows used for fitting, at most
    sample_share: float = 0.4  # of these, toxic ones at most
    lo: int = 3               # n-gram lengths
    hi: int = 5
    buckets: int = 1 << 18
    least_docs: int = 2       # n-grams of fewer sample documents are left out
    least_ratio: float = 0.7  # n-grams with a smaller |r| are left out
    l2: float = 1e-3
    steps: int = 80
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    params: Params
    bias: float
    weights: np.ndarray = field(repr=False)  # learned weight times r, by bucket

    def word_values(self, words: list[str]) -> list[float]:
        rows, buckets = word_buckets(words, self.params)
        return np.bincount(rows, weights=self.weights[buckets], minlength=len(words)).tolist()

    def scores(self, texts: list[str], table: WordTable) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        values = table.prepare(docs)
        z = np.array([sum(map(values.__getitem__, d)) for d in docs], np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_buckets(words: list[str], params: Params) -> tuple[np.ndarray, np.ndarray]:
    """(row of word, bucket) of every character n-gram."""
    rows, hashes = word_ngrams(words, params.lo, params.hi)
    return rows, (hashes % np.uint64(params.buckets)).astype(np.int64)


def words_of(text: str) -> list[str]:
    """The distinct words of a text, sorted (a fixed order keeps sums reproducible)."""
    return sorted(set(text.lower().split()))


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, usable: Column,
                    sample: int, share: float) -> list[tuple[str, int, float]]:
    """A bounded random sample of labelled texts: (text, label, weight).

    ``usable`` chooses the rows of ``labels`` to learn from. Per class the rows
    of smallest id hash are taken: ``share`` of ``sample`` for label 1, the rest
    for label 0 (each class may fill what the other leaves). Weights restore the
    classes' true shares, which are counted over all labels. The chosen ids (at
    most ``sample`` rows of two numbers) are broadcast to the scan of documents.
    """
    rows = (labels.where(usable & F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
            .groupBy("doc_id").agg(F.max(target).cast("int").alias("y")))
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1 = min(total.get(1, 0), max(int(sample * share), sample - total.get(0, 0)))
    n0 = min(total.get(0, 0), sample - n1)
    order = F.xxhash64("doc_id", F.lit(target))
    picked = [rows.where(F.col("y") == y).orderBy(order, "doc_id").limit(n) for y, n in ((0, n0), (1, n1)) if n]
    if not picked:
        return []
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    found = (documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
             .join(F.broadcast(chosen), "doc_id")
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect())
    got = {y: max(1, sum(r["y"] == y for r in found)) for y in (0, 1)}
    everything = sum(total.values())
    return [(r["text"], r["y"], len(found) * total[r["y"]] / everything / got[r["y"]])
            for r in sorted(found, key=lambda r: r["doc_id"])]


def fit(documents: DataFrame, labels: DataFrame, usable: Column, target: str = "toxic",
        params: Params = Params()) -> Model:
    """Fit on a bounded sample of the labelled rows that ``usable`` (a test on labels' rows) lets through."""
    return fit_rows(labelled_sample(documents, labels, target, usable, params.sample, params.sample_share), params)


def fit_rows(rows: list[tuple[str, int, float]], params: Params = Params()) -> Model:
    y = np.array([r[1] for r in rows], np.float64)
    none = np.zeros(params.buckets)
    if not len(y) or y.min() == y.max():
        return Model(params, 40.0 if len(y) and y[0] == 1 else -40.0, none)
    weight = np.array([r[2] for r in rows])
    # documents x words and words x buckets as coordinate lists; their product, which holds an n-gram once for each
    # distinct word of a document as scoring does, is many times larger and never formed
    vocabulary: dict[str, int] = {}
    docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)), np.int32) for t, _, _ in rows]
    bucket, start = in_batches(list(vocabulary), lambda words: word_buckets(words, params))

    def buckets_of(words: np.ndarray) -> np.ndarray:
        n = start[words + 1] - start[words]
        at = np.repeat(start[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return bucket[at]

    holds = np.zeros((2, params.buckets))
    for d, label in zip(docs, y):
        holds[int(label), np.unique(buckets_of(d))] += 1
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    # smoothing in proportion to the classes: an n-gram of neither has ratio 0
    a0, a1 = 2 * n0 / (n0 + n1), 2 * n1 / (n0 + n1)
    ratio = np.log((holds[1] + a1) / (n1 + 2 * a1)) - np.log((holds[0] + a0) / (n0 + 2 * a0))
    ratio[(holds.sum(0) < params.least_docs) | (np.abs(ratio) < params.least_ratio)] = 0
    useful = (ratio != 0)[bucket]
    kept = np.append(np.int32(0), np.cumsum(useful, dtype=np.int32))
    bucket, word = bucket[useful], np.repeat(np.arange(len(vocabulary)), np.diff(kept[start]))
    columns, col = np.unique(bucket, return_inverse=True)
    value = ratio[columns][col]
    row, held = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs)
    w, bias = np.zeros(len(columns)), float(np.log(n1 * weight[y == 1].mean() / (n0 * weight[y == 0].mean())))
    m = [np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)]
    for step in range(1, params.steps + 1):  # Adam on the full sample
        brings = np.bincount(word, weights=w[col] * value, minlength=len(vocabulary))
        z = np.bincount(row, weights=brings[held], minlength=len(y)) + bias
        err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        error = np.bincount(held, weights=err[row], minlength=len(vocabulary))
        grad = np.append(np.bincount(col, weights=error[word] * value, minlength=len(w)) + params.l2 * w, err.sum())
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad * grad
        move = 0.05 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    weights = none
    weights[columns] = w * ratio[columns]
    return Model(params, float(bias), weights)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``documents`` (one pass, no shuffle)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value.word_values)
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(shared.value.scores(texts_of(part), table))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_below(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents``, all columns, whose score stays below the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value.word_values)
        for part in slices(batches, "text"):
            yield part.filter(pa.array(shared.value.scores(texts_of(part), table) < shared.value.params.threshold))

    return documents.mapInArrow(run, documents.schema)
