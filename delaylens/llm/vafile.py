"""Exact top-k search with a vector-approximation file.

Vectors are whole numbers floor(256 * x). The file holds, per vector, one byte a
component: the cell of an equal-width grid between the component's extremes.

1. Cells are scanned: blocks of the file (``Params.block`` vectors at most, a few
   megabytes) meet blocks of the stated queries. A query's inner product with the
   cell's middle is off by no more than half a cell per component, a figure of the
   query alone, so one matrix product bounds all scores of a block pair; what lies
   below the block's k-th best lower bound leaves.
2. Per query, what lies below the k-th best lower bound of all blocks leaves.
   Only pairs of identifiers have been moved so far.
3. Exact vectors are read in the order of the bounds, best possible score first:
   the first k of each query, and then only those whose bound still reaches the
   k-th best score found, so that the k-th result is certain.

Of equal vectors only the k + 1 of smallest id can be among a query's k best
(one of them may be its own row), so no more enter the file; a hot vector adds
no ties. The number of blocks follows the rows, and on small tables the cores.

Defined results: a NULL vector, one with NULL or non-finite components, or
without an id takes no part; rows that repeat an id are rows of their own, as
queries and as candidates (a row only ignores itself); vectors meet only those
of their own length (``Params.families`` lengths at most, else an error); fewer
than k candidates give all of them; equal scores go to the smaller id; integers
beyond a bound that keeps scores in 62 bits (2^27 for 64 components, which is
|x| of 524,288) count as that bound; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylens.llm.common import group_bounds, materialise, runs


@dataclass(frozen=True)
class Params:
    k: int = 5
    bits: int = 8             # cells per component: 2^bits, 8 at most
    block: int = 131_072      # vectors of a block at most
    least: int = 1_024        # vectors of a block at least, where there are cores to spare
    products: int = 4 << 20   # bounds computed at a time
    families: int = 1_000     # different lengths


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def whole(values: np.ndarray, dim: int) -> np.ndarray:
    """floor(256 * x) as 64-bit integers, within a bound that keeps sums of ``dim`` products in 62 bits."""
    bits = (62 - max(0, int(dim - 1).bit_length())) // 2 - 1
    scaled = np.floor(256 * values.astype(np.float64))
    return np.clip(scaled, -(1 << bits), 1 << bits).astype(np.int64)


def by_length(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows of that length, their vectors as a matrix) of each batch."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            yield dim, part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def whole_numbers(embeddings: DataFrame, is_query: Column) -> DataFrame:
    """row (a number of its own), vec_id, is_query, dim and v of the vectors that take part, in the checkpoint folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, vectors in by_length(batches, "embedding"):
            v = whole(vectors, dim).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("is_query"), part.column("dim"),
                                              pa.array(list(v), pa.list_(pa.int32()))], ["vec_id", "is_query", "dim", "v"])

    vector = F.col("embedding")
    rows = (embeddings.where(F.col("vec_id").isNotNull() & usable(vector))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
                    F.size(vector).alias("dim"), vector.cast("array<double>").alias("embedding")))
    numbers = rows.mapInArrow(run, "vec_id long, is_query boolean, dim int, v array<int>")
    return materialise(numbers.withColumn("row", F.monotonically_increasing_id()), "whole-vectors")[0]


class Grid:
    """Cells of the vectors of one length: equal-width between each component's extremes."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.low = low.astype(np.float64)
        self.width = np.maximum((high - self.low + 1) / (1 << bits), 1.0)
        self.last = (1 << bits) - 1

    def encode(self, exact: np.ndarray) -> np.ndarray:
        return np.minimum((exact - self.low) / self.width, self.last).astype(np.uint8)

    def bounds(self, queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle of each query's score with each code (rows: queries), and how far a query's scores may be off."""
        middle = (queries @ self.low)[:, None] + (queries * self.width) @ (codes + 0.5).T
        size = np.abs(queries)
        # the second term is for the sums' own rounding
        off = size @ (0.5 * self.width) + 1e-12 * (size @ (np.abs(self.low) + self.width * (self.last + 1))) + 1e-6
        return middle, off


def grids(table: DataFrame, params: Params) -> dict[int, Grid]:
    """The grid of each length, from the extremes of all vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for dim, _, v in by_length(batches, "v"):
            low[dim] = np.minimum(low.get(dim, v[0]), v.min(0))
            high[dim] = np.maximum(high.get(dim, v[0]), v.max(0))
        if low:
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.list_(pa.int32())),
                                              pa.array(list(high.values()), pa.list_(pa.int32()))], ["dim", "low", "high"])

    lengths = table.select("dim").distinct().limit(params.families + 1).count()
    if lengths > params.families:
        raise ValueError(f"vectors of more than {params.families} different lengths")
    ends = (table.select("dim", "v").mapInArrow(run, "dim int, low array<int>, high array<int>")
            .select("dim", F.posexplode_outer(F.arrays_zip("low", "high")).alias("place", "end"))
            .groupBy("dim", "place").agg(F.min("end.low").alias("low"), F.max("end.high").alias("high")).collect())
    sides: dict[int, list] = {}
    for r in sorted((r for r in ends if r.place is not None), key=lambda r: (r.dim, r.place)):
        sides.setdefault(r.dim, []).append((r.low, r.high))
    empty = {r.dim: [] for r in ends if r.place is None}
    return {dim: Grid(*np.array(s, np.int64).reshape(-1, 2).T, params.bits) for dim, s in (sides | empty).items()}


def approximations(table: DataFrame, grid: dict[int, Grid], params: Params) -> DataFrame:
    """The file: row, dim and code of the candidates, in the checkpoint folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, v in by_length(batches, "v"):
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("dim"),
                                              pa.array([c.tobytes() for c in grid[dim].encode(v)], pa.binary())],
                                             ["row", "dim", "code"])

    order = Window.partitionBy("v").orderBy("vec_id", "row")
    first = table.withColumn("place", F.row_number().over(order)).where(F.col("place") <= params.k + 1)
    return materialise(first.select("row", "dim", "v").mapInArrow(run, "row long, dim int, code binary"), "approximations")[0]


def survivors(rows: np.ndarray, codes: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, grid: Grid, k: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, lower, upper) of the pairs of a block that may be among the k best."""
    middle, off = grid.bounds(queries.astype(np.float64), codes)
    if len(rows) > k + 1:  # one of the k + 1 best may be the query itself
        least = np.partition(middle, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1] - 2 * off
        q, c = np.nonzero(middle >= least[:, None])
    else:
        q, c = (x.ravel() for x in np.indices(middle.shape))
    other = query_rows[q] != rows[c]
    q, c = q[other], c[other]
    return query_rows[q], rows[c], middle[q, c] - off[q], middle[q, c] + off[q]


def scan(table: DataFrame, file: DataFrame, grid: dict[int, Grid], params: Params) -> DataFrame:
    """query, row, lower and upper bound of the pairs that no block and no query's own k-th bound rules out."""
    spark = table.sparkSession
    n = max(1, file.count())
    spare = min(spark.sparkContext.defaultParallelism, -(-n // params.least))
    blocks = max(-(-n // params.block), spare)
    cells = file.select("row", "dim", "code", F.lit(None).cast("array<int>").alias("v"),
                        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"))
    # the stated query set against all rows, a pair of blocks at a time
    queries = table.where("is_query").select("row", "dim", F.lit(None).cast("binary").alias("code"), "v",
                                             F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"))
    dealt = (cells.unionByName(queries).repartition(blocks, "block", "dim")
             .sortWithinPartitions("block", "dim", "kind"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = rows = codes = None
        for whole_groups in runs(small(batches), ["block", "dim", "kind"]):
            bounds = group_bounds(whole_groups, ["block", "dim", "kind"])
            for a, b in zip(bounds, bounds[1:]):
                part = whole_groups.slice(a, b - a)
                dim = part.column("dim")[0].as_py()
                here = part.column("block")[0].as_py(), dim
                if part.column("kind")[0].as_py() == 0:
                    where, rows = here, part.column("row").to_numpy()
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(rows), dim)
                    continue
                if here != where:
                    continue  # no candidate of this length in the block
                ids = part.column("row").to_numpy()
                v = pa.concat_arrays([c.flatten() for c in part.column("v").chunks]).to_numpy(zero_copy_only=False)
                v, step = v.reshape(len(ids), dim), max(1, params.products // len(rows))
                for at in range(0, len(ids), step):
                    found = survivors(rows, codes, ids[at: at + step], v[at: at + step], grid[dim], params.k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query", "row", "lower", "upper"])

    pairs = dealt.mapInArrow(run, "query long, row long, lower double, upper double")
    best = Window.partitionBy("query").orderBy(F.desc("lower"))
    kth = F.max(F.when(F.col("place") == params.k, F.col("lower"))).over(Window.partitionBy("query"))
    kept = pairs.withColumn("place", F.row_number().over(best)).withColumn("kth", kth)
    kept = kept.where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("query", "row", "upper")
    return materialise(kept, "survivors")[0]


def small(batches: Iterable[pa.RecordBatch], rows: int = 8_192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def search(embeddings: DataFrame, is_query: Column, params: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every row that ``is_query`` chooses."""
    table = whole_numbers(embeddings, is_query)
    grid = grids(table, params)
    found = scan(table, approximations(table, grid, params), grid, params)
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda s, x: s + x)
    asked = table.where("is_query").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    exact = table.select("row", "vec_id", "v")

    def read(pairs: DataFrame) -> DataFrame:
        return (pairs.join(exact, "row").join(asked, "query")
                .select("query", "query_id", "row", "vec_id", product.alias("score")))

    # exact vectors in the order of their bounds: the first k, then what their k-th score leaves open
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "row")
    ordered = found.withColumn("place", F.row_number().over(order))
    first, _ = materialise(read(ordered.where(F.col("place") <= params.k)), "first-scores")
    kth = (first.groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
           .where(F.col("n") == params.k).select("query", "kth"))
    rest = ordered.where(F.col("place") > params.k).join(kth, "query").where(F.col("upper") >= F.col("kth"))
    scored = first.unionByName(read(rest))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k)
            .select("query_id", "rank", "vec_id", "score"))


def oracle_sql(k: int = 5) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {k}"""
