"""Helpers shared by the operators: tables, Arrow batches, word tables, blocks.

Rows that need Python pass through ``mapInArrow``: Spark splits and shuffles
them, a task sees a stream of record batches and holds one slice at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared checkpoint folder and read it back: (table, path)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``materialise`` wrote, through its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` with one row of ``groups`` per ``key``, whatever the largest group.

    ``size`` is the number of rows of a group, ``total`` that of all rows. Groups of at least a
    ``share``-th of all rows are at most ``share``, so their side is broadcast; what is left is
    joined by a shuffle in which no key has more than that part of the rows. ``rows`` is read
    twice and should be a written table. NULL keys meet nothing.
    """
    hot = F.broadcast(groups.where(F.col(size) * share >= total))
    usual = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) * share < total), key, "left")
    return usual.unionByName(rows.join(hot, key))


def fold(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the id's text modulo ``folds``; NULL ids have no fold (NULL)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 8 << 20,
           max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of bounded text bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + max_bytes, side="right"))
            stop = min(max(stop, start + 1), start + max_rows, n)
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; NULL reads as the empty text."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


class WordTable:
    """Values of words, computed for many new words at once and kept while they fit.

    ``compute`` maps a list of words to one value per word (any indexable).
    ``prepare`` returns a mapping that holds all words of the given documents;
    when it would pass ``capacity`` words, all others are dropped first, so a
    worker's memory stays bounded whatever the vocabulary.
    """

    def __init__(self, compute: Callable[[list[str]], list], capacity: int = 400_000):
        self.compute, self.capacity = compute, capacity
        self.values: dict = {}

    def prepare(self, docs: list[list[str]]) -> dict:
        new = set().union(*docs)
        if len(self.values) + len(new) > self.capacity:
            self.values = {w: v for w, v in self.values.items() if w in new}
        new.difference_update(self.values)
        if new:
            missing = list(new)
            self.values.update(zip(missing, self.compute(missing)))
        return self.values


def word_ngrams(words: list[str], lo: int, hi: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the character n-grams (lo..hi) of ``<word>``: (row of word, hash).

    Words carry start and end marks, so prefixes and suffixes are n-grams of
    their own; a marked word shorter than ``lo`` gives none.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marked = ["\x02" + w + "\x03" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    row = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    rows, hashes = [], []
    h = np.full(len(points), (seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for n in range(1, hi + 1):
        # extend every n-1-gram hash by its next character
        h = (h[: len(points) - n + 1] ^ points[n - 1:]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        if n >= lo:
            ok = np.flatnonzero(left[: len(h)] >= n)
            rows.append(row[ok])
            hashes.append(mix(h[ok]))
        if len(h) <= 1:
            break
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


def in_batches(words: list[str], buckets_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
               batch: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words in their order, and where each word's begin (the end appended).

    ``buckets_of`` gives (row of word, bucket) of a list of words. It sees few of them at a time, as
    its arrays are many times the size of what is kept: 4 bytes a bucket.
    """
    buckets, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for at in range(0, len(words), batch):
        some = words[at: at + batch]
        row, bucket = buckets_of(some)
        buckets.append(bucket[np.argsort(row, kind="stable")].astype(np.int32))
        counts.append(np.bincount(row, minlength=len(some)))
    return np.concatenate(buckets), np.cumsum(np.concatenate(counts))


def word_hashes(words: list[str]) -> np.ndarray:
    """A fixed 64-bit hash of each word (Python's own changes with the process)."""
    if not words:
        return np.zeros(0, np.uint64)
    marked = [w + "\x03" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(lengths) - lengths
    place = (np.arange(len(points)) - np.repeat(start, lengths)).astype(np.uint64)
    return mix(np.add.reduceat(mix(points + (place << np.uint64(32))), start))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that any bits of them can serve as a bucket."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def block_pairs(rows: DataFrame, key: str, size: str, block: int, salt: Column) -> DataFrame:
    """Deal the members of each group to pairs of blocks of about ``block`` rows.

    ``size`` holds each group's row count. A group of up to ``block`` rows is
    one block; a larger one is cut by ``salt`` into s blocks and its rows go
    to every pair (lo <= hi) with their own block, so that any two members
    of different blocks meet in one place, two of one block in its pair with
    itself (``meets``), and no task holds more than about two blocks at once.
    Adds ``lo``, ``hi`` and ``own`` (the row's block).
    """
    s = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.when(s > 1, F.pmod(salt, s).cast("int")).otherwise(F.lit(0))
    pairs = (rows.withColumn("_s", s).withColumn("own", own)
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))))
    return (pairs.withColumn("lo", F.least("own", "_o")).withColumn("hi", F.greatest("own", "_o"))
            .drop("_s", "_o")
            .repartition("lo", "hi", key).sortWithinPartitions(key, "lo", "hi"))


def meets(lo: int, hi: int, own: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of a block pair's rows are compared there, as a square mask, i < j."""
    n = len(own)
    upper = np.triu(np.ones((n, n), bool), 1)
    return upper if lo == hi else upper & (own[:, None] != own[None, :])


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys`` (a group may span batches)."""
    rest: list[pa.RecordBatch] = []

    def same(a, i, b, j):
        return all(a.column(k)[i] == b.column(k)[j] for k in keys)

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        if rest and same(rest[-1], rest[-1].num_rows - 1, batch, n - 1):
            rest.append(batch)
            continue
        # the last group of the batch may go on: find where it begins
        lo, hi = 0, n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if same(batch, mid, batch, n - 1):
                hi = mid
            else:
                lo = mid + 1
        if rest or lo:
            yield pa.Table.from_batches([*rest, *([batch.slice(0, lo)] if lo else [])])
        rest = [batch.slice(lo)]
    if rest:
        yield pa.Table.from_batches(rest)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Start offsets of the groups of a sorted table, with the end appended."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of ``n`` rows over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def small_pairs(bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of one group, for the groups of 2 to ``most`` rows."""
    size = np.diff(bounds)
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, most + 1):
        start = bounds[:-1][size == m]
        if len(start):
            i, j = np.triu_indices(m, 1)
            out_i.append((start[:, None] + i).ravel())
            out_j.append((start[:, None] + j).ravel())
    return np.concatenate(out_i), np.concatenate(out_j)
