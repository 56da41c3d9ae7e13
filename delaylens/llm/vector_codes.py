"""Vector codes: one codebook entry per part of a vector, found by Orchard search.

Components become integers floor(256 * x) and vectors are cut into
``Params.parts`` consecutive parts. A part's codebook starts as that part of the
vectors of smallest ids; each round assigns every part to its nearest entry and
moves every entry to the floor of its parts' mean. All arithmetic is in whole
numbers, so results do not depend on the order of rows.

The nearest entry is found by Orchard's method: every entry has a list of all
entries by growing distance from it. A search holds a best entry and walks down
its list; an entry not visited before is measured and marked; if it is nearer
(or as near with a lower index) the search jumps to the start of its list. It
ends at the first entry that lies farther from the best one than twice the
best distance, as by the triangle inequality neither it nor a later one can be as
near. Distances are squared, so the test is against four times the best. All
parts of a block of vectors search at the same time, one step of all searches
that have not ended after another.

A round is one pass over the vectors: tasks send one sum per entry and
component, added up in Spark; the new codebooks, of fixed size (entries times
components), go to the driver and with the next pass to the tasks. The smallest
ids are found among ids alone, then their vectors are read.

Defined results: rows whose vector is NULL or holds NULL or non-finite
components are dropped; a NULL vec_id counts as larger than all others, rows of
one id are taken by their vectors' order; fewer rows than entries give fewer entries;
vectors of one length have codebooks of their own (``Params.families`` different
lengths at most, else an error); part p of a vector of d components holds
those from floor(p * d / parts) up to floor((p + 1) * d / parts); integers
beyond a bound that keeps distances in 62 bits (2^27 for 64 components, which is
|x| of 524,288) count as that bound; a sum beyond a long is the largest long;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylens.llm.common import join_groups, materialise
from delaylens.llm.vafile import usable, whole


@dataclass(frozen=True)
class Params:
    parts: int = 16
    entries: int = 64     # at most 256: two hexadecimal digits
    rounds: int = 2
    block: int = 4_096    # vectors searched at a time
    families: int = 1_000 # different lengths


Books = dict[int, list[np.ndarray]]  # length of the vectors -> per part: entries x components


def cuts(dim: int, parts: int) -> list[int]:
    return [p * dim // parts for p in range(parts + 1)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


class Orchard:
    """Neighbour lists of one codebook, and the search along them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = squared(entries[:, None, :], entries[None, :, :])
        self.order = np.argsort(apart, axis=1, kind="stable")      # of each entry: all entries by distance
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry (lowest index of equals) and squared distance of every point, and how many were measured."""
        n, size = len(points), len(self.entries)
        best = np.zeros(n, np.int64)
        least = squared(points, self.entries[0])
        seen = np.zeros((n, size), bool)
        seen[:, 0] = True
        step = np.zeros(n, np.int64)      # place in the list of the best entry
        going, measured = np.arange(n), n
        while len(going):
            at, here = step[going], best[going]
            going = going[(at < size) & (self.apart[here, np.minimum(at, size - 1)] <= 4 * least[going])]
            if not len(going):
                break
            other = self.order[best[going], step[going]]
            step[going] += 1
            new = ~seen[going, other]
            some, other = going[new], other[new]
            seen[some, other] = True
            far = squared(points[some], self.entries[other])
            measured += len(some)
            better = (far < least[some]) | ((far == least[some]) & (other < best[some]))
            jump = some[better]
            best[jump], least[jump], step[jump] = other[better], far[better], 0
        return best, least, measured


def kept_rows(embeddings: DataFrame, *more: Column) -> DataFrame:
    vector = F.col("embedding")
    return (embeddings.where(usable(vector))
            .select(F.col("vec_id").cast("long").alias("vec_id"), vector.cast("array<double>").alias("embedding"),
                    F.size(vector).alias("dim"), *more))


def blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows of that length, their integers), ``rows`` at a time."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            for at in range(0, part.num_rows, rows):
                here = part.slice(at, rows)
                flat = here.column("embedding").flatten().to_numpy(zero_copy_only=False)
                yield dim, here, whole(flat, dim).reshape(here.num_rows, dim)


def start_books(rows: DataFrame, params: Params) -> Books:
    """Per length the vectors of smallest ids, cut into parts."""
    dims = [r.dim for r in rows.groupBy("dim").count().limit(params.families + 1).collect()]
    if len(dims) > params.families:
        raise ValueError(f"vectors of more than {params.families} different lengths")
    books = {}
    for dim in dims:
        of_dim = rows.where(F.col("dim") == dim)
        ids = [r.vec_id for r in of_dim.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(params.entries).collect()]
        if ids[-1] is not None and len(ids) == params.entries:
            of_dim = of_dim.where(F.col("vec_id") <= ids[-1])
        first = of_dim.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(params.entries).collect()
        table = whole(np.array([r.embedding for r in first], np.float64).reshape(len(first), dim), dim)
        at = cuts(dim, params.parts)
        books[dim] = [table[:, a:b] for a, b in zip(at, at[1:])]
    return books


def moved(rows: DataFrame, books: Books, params: Params) -> Books:
    """One round: entries at the floor of the mean of the parts assigned to them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = {}, {}, {}
        for dim, _, points in blocks(batches, params.block):
            at = cuts(dim, params.parts)
            for p, entries in enumerate(books[dim]):
                key = dim, p
                if key not in search:
                    search[key] = Orchard(entries)
                    sums[key], counts[key] = np.zeros(entries.shape, object), np.zeros(len(entries), np.int64)
                own = points[:, at[p]:at[p + 1]]
                code, _, _ = search[key].nearest(own)
                block = np.zeros(entries.shape, np.int64)
                np.add.at(block, code, own)
                sums[key] += block
                counts[key] += np.bincount(code, minlength=len(entries))
        for (dim, p), total in sums.items():
            used = np.flatnonzero(counts[dim, p])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(used), pa.int32()), pa.array([p] * len(used), pa.int32()), pa.array(used, pa.int32()),
                     pa.array(counts[dim, p][used]), pa.array([[str(x) for x in total[e]] for e in used], pa.list_(pa.string()))],
                    ["dim", "part", "entry", "n", "total"])

    schema = "dim int, part int, entry int, n long, total array<string>"
    # one row per task, entry and component; a part may be empty, hence outer
    found = (rows.select("dim", "embedding").mapInArrow(run, schema)
             .select("dim", "part", "entry", "n", F.posexplode_outer("total").alias("place", "value"))
             .groupBy("dim", "part", "entry", "place")
             .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect())
    new = {dim: [b.copy() for b in parts] for dim, parts in books.items()}
    for r in found:
        if r.place is not None:
            new[r.dim][r.part][r.entry, r.place] = int(r.total) // r.n
    return new


def encoded(rows: DataFrame, books: Books, params: Params) -> DataFrame:
    """The other columns of ``rows`` with code and error (see the module's docstring)."""
    others = [c for c in rows.columns if c not in ("embedding", "dim")]
    digests = {dim: books_digest(parts) for dim, parts in books.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = {}
        for dim, here, points in blocks(batches, params.block):
            at = cuts(dim, params.parts)
            codes, error = np.empty((len(points), params.parts), np.uint8), np.zeros(len(points), np.int64)
            for p, entries in enumerate(books[dim]):
                if (dim, p) not in search:
                    search[dim, p] = Orchard(entries)
                codes[:, p], far, _ = search[dim, p].nearest(points[:, at[p]:at[p + 1]])
                error += far
            yield pa.RecordBatch.from_arrays(
                [*(here.column(c) for c in others), pa.array([c.tobytes().hex() for c in codes]), pa.array(error),
                 pa.array([digests[dim]] * len(points))], [*others, "code", "error", "codebooks_sha256"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in others]
    return rows.mapInArrow(run, ", ".join([*kinds, "code string", "error long", "codebooks_sha256 string"]))


def books_digest(parts: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in parts for x in part.ravel().tolist()).encode()).hexdigest()


def train(embeddings: DataFrame, params: Params = Params()) -> Books:
    if not 1 <= params.entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = kept_rows(embeddings)
    books = start_books(rows, params)
    for _ in range(params.rounds):
        books = moved(rows, books, params)
    return books


def compress(embeddings: DataFrame, params: Params = Params()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    books = train(embeddings, params)
    label = F.col("label").cast("string")
    rows = kept_rows(embeddings, F.coalesce(F.concat(F.lit("="), label), F.lit("")).alias("_label"))
    table, _ = materialise(encoded(rows, books, params), "codes")
    most = F.lit(2 ** 63 - 1).cast("decimal(38,0)")
    groups = table.groupBy("_label").agg(
        F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"),
        F.count("*").alias("size"))
    joined = join_groups(table, groups, "_label", "size", table.count())
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def decode(codes: DataFrame, books: Books, dim: int, params: Params = Params()) -> DataFrame:
    """vec_id and the vector that each code of ``dim`` components stands for (entries' integers + 0.5, over 256)."""
    parts = books[dim]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, params.parts)
            table = np.concatenate([entries[code[:, p]] for p, entries in enumerate(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list((table + 0.5) / 256), pa.list_(pa.float64()))],
                                             ["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def oracle_sql(params: Params = Params()) -> str:
    """The rounds as relations: every part against every entry. For vectors of one length that ``parts`` divides."""
    steps = []
    for r in range(params.rounds + 1):
        steps.append(f"""
far{r} AS MATERIALIZED (SELECT x.rid, x.p, e.e, sum((x.x - e.x) * (x.x - e.x)) AS far
         FROM x JOIN book{r} e USING (p, i) GROUP BY x.rid, x.p, e.e),
near{r} AS MATERIALIZED (SELECT rid, p, arg_min(e, far * {params.entries} + e) AS e, min(far) AS far FROM far{r} GROUP BY rid, p)""")
        if r < params.rounds:
            steps.append(f"""
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(m, b.x) AS x FROM book{r} b LEFT JOIN (
  SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM near{r} JOIN x USING (rid, p) GROUP BY p, e, i)
  USING (p, e, i))""")
    last = params.rounds
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (SELECT rid, k // (len // {params.parts}) AS p, k % (len // {params.parts}) AS i, v[k + 1] AS x
      FROM (SELECT rid, v, len(v) AS len, unnest(range(len(v))) AS k FROM v)),
book0 AS MATERIALIZED (SELECT p, rid AS e, i, x FROM x WHERE rid < {params.entries}),{",".join(steps)},
codes AS (SELECT rid, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
          FROM near{last} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{last}) AS codebooks_sha256
FROM v JOIN codes USING (rid)"""
