"""Filter interaction audit with wide packed counters.

Five filters judge every document; the failures of one document are a mask of
five bits. For each of the 120 orders of the filters and each of their steps
six outcomes are counted. All 3,600 counters of a part are one big integer of
64-bit fields. A document's mask (with its two label flags) maps to the integer
that holds a one in the field of every outcome it has, so a part's counters are
the plain sum of its documents' integers. A field counts documents of one table,
which are fewer than 2^63, so no field can reach the next one.

1. One pass over the texts: four filters, and a digest of the text.
2. Fifth filter: equal texts meet by their digest (SHA-256 of the whole text),
   of which the smallest doc_id is wanted, a partly aggregated minimum. Texts
   that occur once leave there; the others' minima are joined back, those of a
   thousandth of all rows or more by broadcast (at most a thousand).
3. Rows that agree in doc_id, part and mask are counted before labels join.
4. Tasks add up integers per part; sums are dealt by part and one of
   ``SPREAD`` numbers, then by part, and unpacked to 600 rows.

Defined results: NULL text is empty, NULL ``lang`` is the part ''; NULL labels
and documents without labels are neither good nor toxic; of several label rows
of one document any that says 1 counts; rows of a repeated doc_id count one by
one and are not duplicates of each other; a NULL doc_id is neither smaller than
another nor has any smaller, and no labels; an empty table has no parts and gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.llm.common import join_groups, materialise, slices

NAMES = "ABCDE"
ORDERS = ["".join(o) for o in permutations(NAMES)]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
STEPS = len(ORDERS) * len(NAMES)
SPREAD = 32
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def failures(text: bytes, points: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # bytes split at ASCII white space
    a = len(words) < 200
    b = 100 * len(set(words)) < 50 * len(words)
    c = 100 * (len(text) - len(text.translate(None, CAPITALS))) > 3 * points
    d = len(text.translate(None, MARKS)) < len(text)
    return a | b << 1 | c << 2 | d << 3


def masks(documents: DataFrame) -> DataFrame:
    """doc_id, part, digest and mask of the filters A to D, in the checkpoint folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            raw = rows.column("text").fill_null("")
            texts = raw.cast(pa.binary()).to_pylist()
            mask = [failures(t, n) for t, n in zip(texts, pc.utf8_length(raw).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 pa.array(mask, pa.int32())], ["doc_id", "part", "digest", "mask"])

    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("string").alias("text"))
    return materialise(read.mapInArrow(run, "doc_id long, part string, digest binary, mask int"), "masks")[0]


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part, mask (five bits) and label flags: part, mask, good, toxic, n."""
    rows = masks(documents)
    copies = (rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"))
              .where(F.col("size") > 1))
    later = F.when(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)), 1 << NAMES.index("E")).otherwise(0)
    counted = (join_groups(rows, copies, "digest", "size", rows.count())
               .withColumn("mask", F.col("mask").bitwiseOR(later))
               .groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")))
    flags = (labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    no = F.lit(False)
    return counted.join(flags, "doc_id", "left").select(
        "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")


@cache
def packed(mask: int, good: bool, toxic: bool) -> int:
    """One document's outcomes at all steps of all orders, a field each."""
    fields = np.zeros((len(OUTCOMES), STEPS), "<u8")
    at = 0
    for order in ORDERS:
        earlier = 0
        for name in order:
            bit = 1 << NAMES.index(name)
            fails, gone = bool(mask & bit), bool(mask & earlier)
            removed = fails and not gone
            fields[:, at] = (not fails and not gone, removed, fails and gone, mask == bit, removed and good, removed and toxic)
            earlier |= bit
            at += 1
    return int.from_bytes(fields.tobytes(), "little")


def to_bytes(total: int) -> bytes:
    return total.to_bytes(len(OUTCOMES) * STEPS * 8, "little")


def packed_sums(counted: DataFrame) -> DataFrame:
    """part and the sum of its documents' integers, one row per part."""
    most = 256  # parts held at a time

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread, held = TaskContext.get().partitionId() % SPREAD, {}

        def leave():
            out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([spread] * len(held), pa.int32()),
                                              pa.array([to_bytes(v) for v in held.values()], pa.binary())],
                                             ["part", "spread", "total"])
            held.clear()
            return out

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "mask", "good", "toxic", "n")))
            for part, mask, good, toxic, n in rows:
                if part not in held and len(held) == most:
                    yield leave()
                held[part] = held.get(part, 0) + n * packed(mask, good, toxic)
        if held:
            yield leave()

    def merge(keys: list[str]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, total = None, 0

            def leave():
                return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[-1]], pa.int32()),
                                                   pa.array([to_bytes(total)], pa.binary())], ["part", "spread", "total"])

            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("part", "spread", "total"))):
                    key = row[: len(keys)] + (0,) * (2 - len(keys))
                    if key != held:
                        if held is not None:
                            yield leave()
                        held, total = key, 0
                    total += int.from_bytes(row[2], "little")
            if held is not None:
                yield leave()
        return run

    schema = "part string, spread int, total binary"
    sums = counted.mapInArrow(add, schema)
    for keys in (["part", "spread"], ["part"]):
        sums = sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge(keys), schema)
    return sums.select("part", "total")


def unpacked(sums: DataFrame) -> DataFrame:
    """600 rows per part: filter_order, step and all counts."""
    counts = [*OUTCOMES, "shapley"]
    names = ["part", "filter_order", "step", *counts]
    orders = [o for o in ORDERS for _ in NAMES]
    steps = [k + 1 for _ in ORDERS for k in range(len(NAMES))]
    filters = np.array([NAMES.index(o[k - 1]) for o, k in zip(orders, steps)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, total in zip(batch.column("part").to_pylist(), batch.column("total").to_pylist()):
                fields = np.frombuffer(total, "<u8").reshape(len(OUTCOMES), STEPS).astype(np.int64)
                removed = fields[OUTCOMES.index("removed")]
                over_all = np.array([removed[filters == f].sum() for f in range(len(NAMES))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * STEPS), pa.array(orders), pa.array(steps, pa.int32()),
                     *(pa.array(f) for f in fields), pa.array(over_all[filters])], names)

    return sums.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All counts of all orders and steps for every part of ``documents`` (its ``lang``)."""
    return unpacked(packed_sums(judged(documents, labels)))


def oracle_sql() -> str:
    """Masks counted per part, then every order and step over the counts."""
    orders = ", ".join(f"'{o}'" for o in ORDERS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS words,
             min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT part, (len(words) < 200)::INT AS fa, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS fb,
         (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT AS fc,
         regexp_matches(t, '[#$%&*|]')::INT AS fd, coalesce(w.doc_id > first, false)::INT AS fe,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, [fa, fb, fc, fd, fe] AS f, good, toxic, count(*) AS n FROM m GROUP BY ALL),
s AS (SELECT o AS filter_order, k AS step, [ascii(x) - 64 FOR x IN string_split(o, '')] AS ids
      FROM unnest([{orders}]) AS a(o), unnest([1, 2, 3, 4, 5]) AS b(k)),
j AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS name, n, good, toxic, f[ids[step]] AS fails,
             list_sum([f[i] FOR i IN ids[1:step - 1]]) > 0 AS gone, list_sum(f) AS all_fails
      FROM c, s),
r AS (
  SELECT part, filter_order, step, name,
         sum(n) FILTER (fails = 0 AND NOT coalesce(gone, false)) AS kept,
         sum(n) FILTER (fails = 1 AND NOT coalesce(gone, false)) AS removed,
         sum(n) FILTER (fails = 1 AND gone) AS redundant,
         sum(n) FILTER (fails = 1 AND all_fails = 1) AS unique_fails,
         sum(n) FILTER (fails = 1 AND NOT coalesce(gone, false) AND good = 1) AS good_lost,
         sum(n) FILTER (fails = 1 AND NOT coalesce(gone, false) AND toxic = 1) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in OUTCOMES)},
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, name), 0) AS BIGINT) AS shapley
FROM r"""
