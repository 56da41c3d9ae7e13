"""Similarity join of texts on word n-grams: MinHash bands, exact verification.

Texts are lower-cased and split at ASCII white space; a text is the set of its
runs of ``Params.n`` words. Two texts link if the Jaccard similarity of their
sets is at least ``Params.threshold``.

1. One pass over the texts: a digest (texts of equal words are one text with a
   count), MinHash values and band keys. As many values per band as
   ``Params.hashes`` allows, as many bands as the target recall at the threshold
   needs.
2. Band keys are shuffled with the text's number only; keys held by one text are
   dropped. Members of a key, in pairs of blocks, are compared on their MinHash
   values; pairs that fall short of the threshold by more than
   ``Params.deviations`` spreads of that estimate are dropped. What is left is
   kept as spanning links, never as all pairs, and gives candidate clusters.
3. Every pair within a cluster is verified on the full n-gram sets, again in
   pairs of blocks: a block's sets become a 0/1 matrix over the n-grams that
   two of them share, whose product holds all intersections. Tasks return each
   text's number of links and spanning links; their components are the classes.

Defined results: NULL and empty texts, and rows without doc_id, link with
nothing and are a class of their own; texts of fewer than n words link with
texts of the same words only; rows that repeat a text link with each other; an id
that stands on several texts is a document per row, each with the links and the
class of its own text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylens.llm.common import (WordTable, block_pairs, group_bounds, join_groups, local_components, materialise, meets,
                                  mix, runs, slices, small_pairs, texts_of)
from delaylens.llm.components import connected


@dataclass(frozen=True)
class Params:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9999    # least chance that a pair at the threshold shares a band
    hashes: int = 128         # MinHash values, at most
    deviations: float = 5.0
    block: int = 384          # texts of a block when MinHash values are compared
    set_block: int = 192      # texts of a block when sets are compared

    def shape(self) -> tuple[int, int]:
        """(bands, rows of a band): the longest bands that reach the recall within ``hashes`` values."""
        best = None
        for rows in range(1, self.hashes + 1):
            bands = math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold ** rows))
            if bands * rows <= self.hashes:
                best = bands, rows
        if best is None:
            raise ValueError("too few hashes for this threshold and recall")
        return best


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def word_codes(words: list[bytes]) -> list[bytes]:
    """A fixed 64-bit hash of each word, as 8 bytes."""
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    points = np.frombuffer(b"\x00".join(words) + b"\x00", np.uint8).astype(np.uint64)
    start = np.cumsum(length) - length
    place = (np.arange(len(points)) - np.repeat(start, length)).astype(np.uint64)
    raw = mix(np.add.reduceat(mix(points + (place << np.uint64(8)) + np.uint64(1)), start)).tobytes()
    return [raw[i: i + 8] for i in range(0, len(raw), 8)]


def ngrams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order, with repeats."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = mix(h ^ codes[k: len(codes) - n + 1 + k])
    return h


class Reader:
    """Digests and n-grams of texts (word hashes are kept per worker)."""

    def __init__(self, n: int):
        self.n, self.table = n, WordTable(word_codes, 300_000)

    def read(self, texts: list[str]) -> tuple[list[bytes | None], list[np.ndarray]]:
        docs = [words_of(t) for t in texts]
        values = self.table.prepare(docs)
        keys = [hashlib.blake2b(b" ".join(d), digest_size=16).digest() if d else None for d in docs]
        return keys, [ngrams(np.frombuffer(b"".join(map(values.__getitem__, d)), np.uint64), self.n) for d in docs]


def minhash(sets: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """len(sets) x len(seeds) minima of differently hashed elements (no set may be empty)."""
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    start = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), len(seeds)), np.uint32)
    for k, (a, b) in enumerate(seeds):
        out[:, k] = np.minimum.reduceat((flat ^ b) * a, start)
    return out


def seeds(count: int) -> np.ndarray:
    rng = np.random.default_rng(17)
    return rng.integers(0, 1 << 32, (count, 2), dtype=np.uint32) | np.array([1, 0], np.uint32)


def signatures(documents: DataFrame, params: Params) -> DataFrame:
    """doc_id, raw (digest of the text), key (digest of the words, NULL without words), keys (band keys) and values
    (MinHash, 16 bits each)."""
    bands, rows = params.shape()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, own = Reader(params.n), seeds(bands * rows)
        salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
        for part in slices(batches, "text", 4 << 20):
            keys, sets = reader.read(texts_of(part))
            some = [i for i, s in enumerate(sets) if len(s)]
            band_keys: list = [[]] * len(sets)
            values: list = [b""] * len(sets)
            if some:
                m = minhash([sets[i] for i in some], own)
                h = np.broadcast_to(salt, (len(some), bands)).copy()
                for k in range(rows):
                    h = mix(h ^ m[:, k::rows][:, :bands].astype(np.uint64))
                for at, i in enumerate(some):
                    band_keys[i] = h[at].view(np.int64)
                    values[i] = m[at].astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("raw"), pa.array(keys, pa.binary()),
                 pa.array(band_keys, pa.list_(pa.int64())), pa.array(values, pa.binary())],
                ["doc_id", "raw", "key", "keys", "values"])

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", raw_digest(F.col("text")).alias("raw"))
            .mapInArrow(run, "doc_id long, raw binary, key binary, keys array<long>, values binary"))


def raw_digest(text: Column) -> Column:
    """MD5 of the text as it is; with the id it tells rows apart that are not mere repeats."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def candidate_links(texts: DataFrame, params: Params) -> DataFrame:
    """Spanning links (a, b) of the pairs that share a band and whose MinHash estimate allows the threshold."""
    bands, rows = params.shape()
    total = bands * rows
    least = total * params.threshold - params.deviations * math.sqrt(total * params.threshold * (1 - params.threshold))
    banded = texts.select("node", F.explode("keys").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = banded.join(sizes, "band").join(texts.select("node", "values"), "node")
    dealt = block_pairs(members, "band", "size", params.block, F.xxhash64("node"))
    group = ["band", "lo", "hi"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, group):
            bounds = group_bounds(whole, group)
            node = whole.column("node").to_numpy()
            value = np.frombuffer(b"".join(whole.column("values").to_pylist()), np.uint16).reshape(len(node), -1)
            i, j = small_pairs(bounds, 24)
            out_i, out_j = [], []
            for at in range(0, len(i), 20_000):
                a, b = i[at: at + 20_000], j[at: at + 20_000]
                near = (value[a] == value[b]).sum(1) >= least
                out_i.append(a[near])
                out_j.append(b[near])
            for a, b in zip(bounds, bounds[1:]):
                if b - a > 24:
                    compare = meets(whole.column("lo")[a].as_py(), whole.column("hi")[a].as_py(),
                                    whole.column("own").slice(a, b - a).to_numpy())
                    equal = np.zeros(compare.shape, np.int16)
                    for column in value[a:b].T:
                        equal += column[:, None] == column[None, :]
                    near = np.nonzero(compare & (equal >= least))
                    out_i.append(near[0] + a)
                    out_j.append(near[1] + a)
            if out_i:
                low = lowest(node, local_components(len(node), np.concatenate(out_i), np.concatenate(out_j)))
                some = np.flatnonzero(low != node)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(low[some])], ["a", "b"])

    return (dealt.select("band", "lo", "hi", "own", "node", "values").mapInArrow(run, "a long, b long")
            .where(F.col("a") != F.col("b")))


def lowest(node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Each row's smallest node of its label: all tasks' links of a group then point the same way, which saves rounds."""
    low = node.copy()
    np.minimum.at(low, label, node)
    return low[label]


def verify(documents: DataFrame, texts: DataFrame, clusters: DataFrame, params: Params) -> DataFrame:
    """node, label, links: every cluster's texts compared pair by pair on their full n-gram sets."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    members = (clusters.join(texts.select("node", "first", "key", "n"), "node")
               .join(sizes, "component").select("node", "component", "size", "key", "n", "first.*"))
    wanted = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", raw_digest(F.col("text")).alias("raw"))
              .join(members, ["doc_id", "raw"]))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(params.n)
        for part in slices(batches, "text", 4 << 20):
            keys, grams = reader.read(texts_of(part))
            if keys != part.column("key").to_pylist():
                raise ValueError("the texts changed between two reads")
            yield pa.RecordBatch.from_arrays(
                [part.column("component"), part.column("size"), part.column("node"), part.column("n"),
                 pa.array([np.unique(g).tobytes() for g in grams], pa.binary())],
                ["component", "size", "node", "n", "grams"])

    # rows that repeat id and text are dropped where the sets meet (below)
    members = wanted.select("node", "component", "size", "key", "n", "text").mapInArrow(
        sets, "component long, size long, node long, n long, grams binary")
    dealt = block_pairs(members, "component", "size", params.set_block, F.xxhash64("node"))
    group = ["component", "lo", "hi"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, group):
            bounds = group_bounds(whole, group)
            found = []
            for a, b in zip(bounds, bounds[1:]):
                part = whole.slice(a, b - a)
                part = part.take(np.sort(np.unique(part.column("node").to_numpy(), return_index=True)[1]))
                if part.num_rows < 2:
                    continue
                node, n = part.column("node").to_numpy(), part.column("n").to_numpy()
                compare = meets(part.column("lo")[0].as_py(), part.column("hi")[0].as_py(), part.column("own").to_numpy())
                grams = [np.frombuffer(g, np.uint64) for g in part.column("grams").to_pylist()]
                near = compare & (jaccard(grams) >= params.threshold)
                i, j = np.nonzero(near)
                links = np.bincount(i, weights=n[j], minlength=len(n)) + np.bincount(j, weights=n[i], minlength=len(n))
                low = lowest(node, local_components(len(n), i, j))
                some = np.flatnonzero(links)
                found.append((node[some], low[some], links[some].astype(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)],
                                                 ["node", "label", "links"])

    return dealt.select("component", "lo", "hi", "own", "node", "n", "grams").mapInArrow(
        run, "node long, label long, links long")


def jaccard(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """All similarities of a few sorted sets, from products of 0/1 matrices over the elements that two share."""
    size = np.array([len(s) for s in sets])
    element, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count[at] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[at[shared]]
    both = np.zeros((len(sets), len(sets)))
    for start in range(0, int((count > 1).sum()), columns):
        here = (column >= start) & (column < start + columns)
        m = np.zeros((len(sets), columns), np.float32)
        m[row[here], column[here] - start] = 1
        both += m @ m.T
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def classified(documents: DataFrame, params: Params) -> DataFrame:
    """doc_id, raw, key, class (a number), class_id, first (the class's smallest doc_id and raw) and n_links of every row.

    Texts are known by their number in the written table, as an id may stand on several texts.
    """
    rows, _ = materialise(signatures(documents, params), "signatures")
    part = rows.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    # keys and values follow from the text, so any of a text's rows has them
    texts, _ = materialise(part.groupBy("key").agg(
        F.min(F.struct("doc_id", "raw")).alias("first"), F.count("*").alias("n"), F.min("keys").alias("keys"),
        F.min("values").alias("values")).withColumn("node", F.monotonically_increasing_id()), "texts")
    clusters, _ = materialise(connected(candidate_links(texts, params)), "clusters")
    links, _ = materialise(verify(documents, texts, clusters, params), "text-links")
    component, _ = materialise(connected(links.select(F.col("node").alias("a"), F.col("label").alias("b")))
                               .join(texts.select("node", "first"), "node"), "text-components")
    lowest = component.groupBy("component").agg(F.min("first").alias("low"), F.count("*").alias("size"))
    named = join_groups(component.select("node", "component"), lowest, "component", "size", component.count())
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = (texts.select("key", "node", "first", "n").join(counts, "node", "left")
               .join(named.select("node", "component", "low"), "node", "left")
               .select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                       F.coalesce("component", "node").alias("class"), F.coalesce("low", "first").alias("first")))
    takes_part = F.col("doc_id").isNotNull()
    return (rows.select("doc_id", "raw", F.when(takes_part, F.col("key")).alias("key")).join(classes, "key", "left")
            .select("doc_id", "raw", "key", "class", F.coalesce("first.doc_id", "doc_id").alias("class_id"), "first",
                    F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))


def similarity_join(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links) and n_links (other rows linked directly) of every row."""
    return classified(documents, params).select("doc_id", "class_id", "n_links")


def keep_one(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``documents``, all columns, with one row of each class.

    The row of smallest doc_id stays (of several texts of that id in one class
    the one of smallest digest, of rows that repeat both any one), so a row goes
    only if a row of its own class stays. Rows without id stay, as do rows
    without words; unrelated texts of one id all stay.
    """
    columns = documents.columns
    raw, gone_id, place = (next(x for k in range(len(columns) + 1) if (x := f"_{name}{k}") not in columns)
                           for name in ("raw", "gone", "place"))
    joined = classified(documents, params)
    gone = (joined.where(F.col("class").isNotNull() & (F.struct("doc_id", "raw") != F.col("first")))
            .select(F.col("doc_id").alias(gone_id), F.col("raw").alias(place)).distinct())
    keyed = documents.withColumn(raw, raw_digest(F.col("text")))
    docs = keyed.join(gone, (keyed["doc_id"] == gone[gone_id]) & (keyed[raw] == gone[place]), "left_anti")
    # any row of several that repeat id and text
    order = Window.partitionBy("doc_id", raw).orderBy(raw)
    some_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\r\f\x0B]")
    ranked = F.col("doc_id").isNotNull() & some_words
    # rows without id or words are never ranked together: they pass beside the window
    first = docs.where(ranked).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return first.select(*columns).unionByName(docs.where(~F.coalesce(ranked, F.lit(False))).select(*columns))


def oracle_sql(params: Params = Params()) -> str:
    """Brute force over all texts that share an n-gram."""
    n = params.n
    grams = ", ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\x0B]+') IF x <> ''] AS w
  FROM documents),
texts AS (SELECT w, min(doc_id) AS rep, count(*) AS n FROM docs WHERE len(w) > 0 GROUP BY w),
grams AS (SELECT DISTINCT rep, n, [{grams}] AS g
          FROM (SELECT rep, n, w, unnest(range(1, len(w) - {n - 2})) AS i FROM texts WHERE len(w) >= {n})),
sizes AS (SELECT rep, count(*) AS s FROM grams GROUP BY rep),
shared AS (SELECT a.rep AS a, b.rep AS b, any_value(b.n) AS n, count(*) AS c
         FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b, n FROM shared JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b
          WHERE c / (x.s + y.s - c) >= {params.threshold}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (
  SELECT w, t.n - 1 + coalesce(k, 0) AS n_links, least(rep, coalesce(low, rep)) AS class_id
  FROM texts t LEFT JOIN (SELECT a AS rep, sum(n) AS k FROM links GROUP BY a) USING (rep)
  LEFT JOIN (SELECT a AS rep, min(b) AS low FROM reach GROUP BY a) USING (rep))
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM docs LEFT JOIN classes USING (w)"""
