"""Near-duplicate vectors by randomly rotated binary codes.

Every distinct vector is turned by random orthogonal matrices; the signs are its
code, and with each code goes a correction factor, the inner product of the
turned unit vector with its own signs. With it, the signs of one vector and the
(4-bit) values of another give an unbiased estimate of their cosine, whose error
has a known spread. Only pairs whose estimate plus ``Params.deviations`` spreads
reaches the threshold are computed exactly, in double precision, so no link is
below the threshold.

Pairs to estimate are those that agree in a band of the code, a run of signs.
The length of a band follows the number of vectors (buckets of about
``Params.bucket``), the number of bands the target recall at the threshold.

1. Codes alone go to the bands: number, 4-bit values (whose signs are the vector's)
   and factors of two rotations at least, 84 bytes a band for 64 components.
   Buckets of any size are compared in pairs of blocks, one float32 product of
   signs and values each, and the vectors that have some pair to be computed exactly
   leave with the block's name.
2. Exact vectors go to those blocks only. The same estimates name the same pairs
   (rows stand in the order of their numbers, so that a pair is estimated alike in all
   blocks), which are computed, and links are counted where they are found, in the
   first band that both vectors share. Only counts and spanning links leave a task, so
   a group of copies is never written as pairs. Equal vectors are one vector with a count.

Defined results: NULL or zero vectors and those with NULL or non-finite
components link with nothing and are their own component; vectors of different
length do not link; rows that repeat an id are rows of their own, each with the
links of its vector; rows without id link with nothing and have no component; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.llm.common import (block_pairs, group_bounds, join_groups, local_components, materialise, meets, mix,
                                  runs)
from delaylens.llm.components import connected
from delaylens.llm.vafile import usable


@dataclass(frozen=True)
class Params:
    threshold: float = 0.9
    recall: float = 0.99      # least chance that a pair at the threshold shares a band
    bucket: int = 256         # vectors of a bucket, about
    deviations: float = 4.5
    block: int = 768
    seed: int = 5
    band: int = 0             # signs of a band and number of bands: see ``for_rows``
    bands: int = 0

    def for_rows(self, n: int) -> Params:
        band = max(4, min(60, math.ceil(math.log2(max(n, 1) / self.bucket)))) if n > self.bucket else 4
        same = (1 - math.acos(self.threshold) / math.pi) ** band
        return replace(self, band=band, bands=max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - same))))


def rotations(dim: int, params: Params) -> np.ndarray:
    """dim x (rotations * dim): as many random orthogonal matrices as the bands and the estimates need signs."""
    count = max(2, kept(dim), -(-params.band * params.bands // dim))
    rng = np.random.default_rng([params.seed, dim])
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)


def kept(dim: int) -> int:
    """Rotations whose code is kept for estimates: two, and 128 signs at least."""
    return max(2, -(-128 // dim))


CODE = "turned binary, scale float, factors binary"


def packed(turned: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Two 4-bit values a byte: level k of 16 stands for (k - 7.5) steps, so levels from 8 on are the positive ones."""
    level = np.clip(np.floor(turned / step[:, None]) + 8, 0, 15).astype(np.uint8)
    if level.shape[1] % 2:
        level = np.concatenate([level, np.zeros((len(level), 1), np.uint8)], axis=1)
    return level[:, ::2] | level[:, 1::2] << 4


#: The two values of a byte, in steps.
LEVELS = np.stack([np.arange(256) & 15, np.arange(256) >> 4], axis=1).astype(np.float32) - 7.5


def unpacked(raw: np.ndarray, size: int) -> np.ndarray:
    """The values of ``packed``, in steps."""
    return LEVELS[raw].reshape(len(raw), -1)[:, :size]


def codes(distinct: DataFrame, params: Params) -> DataFrame:
    """node, n, dim, unit (doubles), the code (``CODE``: 4-bit values, their step, a factor per rotation) and keys
    (one per band) of each distinct vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                vec = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                vec = vec.astype(np.float64).reshape(part.num_rows, dim)
                if dim not in known:
                    known[dim] = rotations(dim, params)
                scale = np.abs(vec).max(1, keepdims=True)
                unit = vec / scale
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                turned = unit @ known[dim]
                sign = turned >= 0
                bits = sign[:, : params.band * params.bands].reshape(len(vec), params.bands, params.band)
                number = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(params.band, dtype=np.uint64))
                keys = mix(number + mix(np.arange(params.bands, dtype=np.uint64) + np.uint64(dim << 20))[None, :])
                turned = turned[:, : kept(dim) * dim]
                factors = (np.abs(turned).reshape(len(vec), -1, dim).sum(2) / math.sqrt(dim)).astype(np.float32)
                step = (np.abs(turned).max(1) / 8).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("n"), part.column("dim"), pa.array([x.tobytes() for x in unit]),
                     pa.array([x.tobytes() for x in packed(turned, step)]), pa.array(step), pa.array([x.tobytes() for x in factors]),
                     pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                    ["node", "n", "dim", "unit", "turned", "scale", "factors", "keys"])

    return distinct.mapInArrow(run, f"node long, n long, dim int, unit binary, {CODE}, keys array<long>")


def possible(part: pa.Table, dim: int, params: Params) -> np.ndarray:
    """Which pairs (i, j) of a block may reach the threshold, by the estimates from i's signs and j's values."""
    count = kept(dim)
    factors = stack(part, "factors", np.float32)
    values = unpacked(stack(part, "turned", np.uint8), count * dim)
    weight = 1 / (factors * (math.sqrt(dim) * count))
    spread = np.sqrt(((1 - np.minimum(factors, 1) ** 2) / factors ** 2).sum(1) / max(1, dim - 1)) / count
    scale = part.column("scale").to_numpy()
    left = np.empty((len(values), count * dim + 1), np.float32)
    right = np.empty_like(left)
    np.copysign(np.repeat(weight, dim, axis=1), values, out=left[:, :-1])
    np.multiply(values, scale[:, None], out=right[:, :-1])
    # one more column: the deviations of an estimate by j's rounding to 16 levels, for 4-bit steps of that size
    left[:, -1] = params.deviations * np.sqrt(dim / 12 * (weight ** 2).sum(1))
    right[:, -1] = scale
    return left @ right.T >= (params.threshold - params.deviations * spread - 1e-3)[:, None]


def linked_pairs(unit: np.ndarray, pairs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) under the mask ``pairs`` whose exact cosine reaches the threshold."""
    i, j = np.nonzero(pairs)
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(i), 50_000):
        a, b = i[at: at + 50_000], j[at: at + 50_000]
        link = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        out_i.append(a[link])
        out_j.append(b[link])
    return np.concatenate(out_i), np.concatenate(out_j)


GROUP = ["key", "lo", "hi"]


def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of two rows at least, ordered by number, and which of their pairs are compared there."""
    for whole in runs(batches, GROUP):
        bounds = group_bounds(whole, GROUP)
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                part = whole.slice(a, b - a)
                part = part.take(np.argsort(part.column("node").to_numpy(), kind="stable"))
                yield part, meets(part.column("lo")[0].as_py(), part.column("hi")[0].as_py(), part.column("own").to_numpy())


def wanted(dealt: DataFrame, params: Params) -> DataFrame:
    """The rows of each block that have a pair to be computed exactly."""
    names = [*GROUP, "own", "band", "node"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, compare in blocks_of(batches):
            near = compare & possible(part, part.column("dim")[0].as_py(), params)
            some = np.flatnonzero(near.any(0) | near.any(1))
            if len(some):
                yield from part.select(names).take(some).combine_chunks().to_batches()

    return (dealt.select(*names, "dim", *[c.split()[0] for c in CODE.split(", ")])
            .mapInArrow(run, "key long, lo int, hi int, own int, band int, node long"))


def near_duplicates(embeddings: DataFrame, params: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings``."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    takes_part = (F.col("vec_id").isNotNull() & usable(F.col("embedding"))
                  & F.exists("embedding", lambda x: x != 0))
    # a vector is known by its number in the written table: an id may stand on several vectors
    distinct, _ = materialise(rows.where(takes_part).groupBy("embedding")
                              .agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
                              .withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()}), "vectors")
    params = params.for_rows(distinct.count())
    table, _ = materialise(codes(distinct, params), "codes")
    bands = table.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    code = [c.split()[0] for c in CODE.split(", ")]
    members = bands.join(sizes, "key").join(table.select("node", "dim", *code), "node")
    chosen = wanted(block_pairs(members, "key", "size", params.block, F.xxhash64("node")), params)
    exact = (chosen.join(table.select("node", "n", "dim", "unit", *code, "keys"), "node")
             .repartition("lo", "hi", "key").sortWithinPartitions(*GROUP))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, compare in blocks_of(batches):
            near = compare & possible(part, part.column("dim")[0].as_py(), params)
            i, j = linked_pairs(stack(part, "unit", np.float64), near, params.threshold)
            if not len(i):
                continue
            keys = np.stack(part.column("keys").to_pylist())
            first = (keys[i] == keys[j]).argmax(1) == part.column("band")[0].as_py()
            i, j = i[first], j[first]
            n, node = part.column("n").to_numpy(), part.column("node").to_numpy()
            links = np.bincount(i, weights=n[j], minlength=len(n)) + np.bincount(j, weights=n[i], minlength=len(n))
            label = local_components(len(n), i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]),
                                              pa.array(links[some].astype(np.int64))], ["node", "label", "links"])

    links, _ = materialise(exact.select(*GROUP, "own", "band", "node", "n", "dim", "unit", *code, "keys")
                           .mapInArrow(run, "node long, label long, links long"), "vector-links")
    component, _ = materialise(connected(links.select(F.col("node").alias("a"), F.col("label").alias("b")))
                               .join(distinct.select("node", "least"), "node"), "vector-components")
    lowest = component.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = join_groups(component.select("node", "component"), lowest, "component", "size", component.count())
    classes = (distinct.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
               .join(named.select("node", "component_id"), "node", "left")
               .select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                       F.coalesce("component_id", "least").alias("component_id")))
    key = F.when(takes_part, F.col("embedding"))
    out = (rows.select("vec_id", key.alias("embedding")).join(classes, "embedding", "left")
           .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                   F.coalesce("component_id", "vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def stack(part: pa.Table, name: str, kind) -> np.ndarray:
    """A binary column whose values all have one length, as a matrix over the column's own buffer."""
    column = part.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]: ends[-1]].view(kind).reshape(len(column), -1)


def oracle_sql(threshold: float = 0.9) -> str:
    """Brute force over all pairs of usable vectors."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([1 FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)"""
