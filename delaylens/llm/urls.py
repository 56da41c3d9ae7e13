"""URL filter: rules first, then a likelihood ratio of two character models.

Rules decide the urls they fit. The others are judged by two smoothed
variable-order Markov models, one trained on the urls that rules accept, one on
those they reject: the probability of a character given its longest known
context is the blend of all shorter contexts' estimates, from one character's
back to none. A url's score is the difference of its two log likelihoods
divided by its length; the threshold is calibrated on held-out urls that rules
decide (a fifth, by crc32), where it makes the mean of both classes' errors least.

The models that judge count every url that a rule decides; for the threshold alone
the held-out urls are scored by models of the others. Counts are a
Spark table that grows with the urls: a row for each byte and longest context,
under an exact key, added up in tasks first. Counts of shorter contexts are sums
of these. The urls to be judged are dealt to chunks of bounded size; the distinct
keys of each chunk are joined to the blended estimates and come back to the
chunk, so no worker holds the table. At every context length at most 256 rows
share a context and 257 a shorter key, so that no group of a join grows.

Defined results: NULL urls are empty; without ``://`` host and path are empty and
no rule fits; empty urls score 0; with no accepted or no rejected url to learn
from, all urls without a rule are allowed; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylens.llm.common import materialise, slices

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class Params:
    order: int = 5            # characters of context, at most (6 fit a key)
    strength: float = 2.0     # weight of the shorter contexts' estimate, in characters
    bins_per_unit: int = 400  # of the histogram that the threshold is chosen from
    chunk_rows: int = 4096    # urls scored together, at most
    chunk_bytes: int = 1 << 20

    def __post_init__(self):
        if not 0 <= self.order <= 6:
            raise ValueError("a key holds contexts of 0 to 6 bytes")


@dataclass(frozen=True)
class Model:
    params: Params
    counts: DataFrame = field(repr=False)  # key of the longest context and its byte, rejected, accepted

    def scores(self, urls: list[str]) -> np.ndarray:
        """Log likelihood, accepted minus rejected, per byte, of a few urls."""
        rows = self.counts.sparkSession.createDataFrame(list(enumerate(urls)), "row long, url string")
        out = np.zeros(len(urls))
        for r in with_scores(rows, self).collect():
            out[r["row"]] = r["score"]
        return out

    def plus(self, other: Model) -> Model:
        """The model of both models' urls."""
        return Model(self.params, summed(self.counts.unionByName(other.counts), "key"))


def key_base(n: int) -> int:
    """Keys of ``n`` characters of context are below this; a longer key modulo it is its shorter one."""
    return 256 * 257 ** n


def places(raw: list[bytes], params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every byte: the byte itself, then its context from the nearest character on, in base 257."""
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    points = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(raw)), length)
    place = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
    keys = points.copy()
    for n in range(1, params.order + 1):
        before = np.zeros(len(points), np.int64)  # 0 stands before the url's start
        before[n:] = points[: max(0, len(points) - n)] + 1
        before[place < n] = 0
        keys += before * key_base(n - 1)
    return row, keys


def raw_of(urls) -> list[bytes]:
    return [(u or "").encode("utf-8", "surrogatepass") for u in urls.to_pylist()]


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, NULL if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict."""
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    out = out.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    out = out.withColumn("r", rule(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "url", "host", "path", "r.rule", F.col("r.verdict").alias("rule_verdict"))


def fit(decided: DataFrame, params: Params = Params()) -> Model:
    """Count the bytes of all urls of ``decided`` (url, accepted) by their longest contexts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "url", params.chunk_bytes, params.chunk_rows):
            accepted = np.asarray(batch.column("accepted"), bool)
            row, keys = places(raw_of(batch.column("url")), params)
            key, at = np.unique(keys, return_inverse=True)
            n = [np.bincount(at[accepted[row] == bool(k)], minlength=len(key)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, n)], ["key", "rejected", "accepted"])

    counts, _ = materialise(
        summed(decided.select("url", "accepted").mapInArrow(run, "key long, rejected long, accepted long"), "key"),
        "url-counts")
    return Model(params, counts)


def summed(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted"))


def ratios(counts: DataFrame, params: Params) -> DataFrame:
    """key, ratio: log of the accepted model's blended estimate over the rejected model's, for every key of ``counts``."""
    shorter = F.array(*(F.struct(F.lit(n).alias("n"), (F.col("key") % F.lit(key_base(n))).alias("key"))
                        for n in range(params.order + 1)))
    every = summed(counts.select(F.explode(shorter).alias("k"), "rejected", "accepted")
                   .select("k.n", "k.key", "rejected", "accepted"), "n", "key")
    context = Window.partitionBy("n", F.shiftright("key", 8))
    known, _ = materialise(every.withColumn("all_rejected", F.sum("rejected").over(context))
                           .withColumn("all_accepted", F.sum("accepted").over(context)), "url-contexts")
    a, out = F.lit(params.strength), None
    for n in range(params.order + 1):
        here = known.where(F.col("n") == n)
        if out is None:
            here = here.withColumns({"p_rejected": F.lit(1 / 256), "p_accepted": F.lit(1 / 256)})
        else:
            here = (here.withColumn("shorter", F.col("key") % F.lit(key_base(n - 1)))
                    .join(out.withColumnRenamed("key", "shorter"), "shorter"))
        out = here.select("key", *(((F.col(k) + a * F.col(f"p_{k}")) / (F.col(f"all_{k}") + a)).alias(f"p_{k}")
                                   for k in ("rejected", "accepted")))
    return out.select("key", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def with_scores(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` (page_id, url, ...) with a column ``score``; other columns pass through."""
    params, columns = model.params, urls.columns
    typed = ", ".join(f"`{c}` {t}" for c, t in urls.dtypes)

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for k, batch in enumerate(slices(batches, "url", params.chunk_bytes, params.chunk_rows)):
            chunk = pa.array(np.full(batch.num_rows, first + k))
            yield pa.RecordBatch.from_arrays([*batch.columns, chunk], [*columns, "_chunk"])

    def wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column("_chunk").to_numpy()
            for c in np.unique(chunk):
                _, keys = places(raw_of(batch.column("url").filter(pa.array(chunk == c))), params)
                keys = np.unique(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c)), pa.array(keys)], ["_chunk", "key"])

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        raw = raw_of(rows.column("url"))
        row, keys = places(raw, params)
        key, at = np.unique(known.column("key").to_numpy(), return_index=True)
        ratio = known.column("ratio").to_numpy()[at]
        total = np.bincount(row, weights=ratio[np.searchsorted(key, keys)], minlength=len(raw))
        length = np.maximum(np.fromiter(map(len, raw), np.int64, len(raw)), 1)
        return rows.select(columns).append_column("score", pa.array(total / length))

    # written once: the chunks stay the same whatever is run again
    rows, _ = materialise(urls.mapInArrow(chunks, typed + ", _chunk long"), "url-chunks")
    asked, _ = materialise(rows.select("url", "_chunk").mapInArrow(wanted, "_chunk long, key long"), "url-keys")
    none = F.lit(0).cast("long")
    counts = model.counts.unionByName(asked.select("key", none.alias("rejected"), none.alias("accepted")))
    known = asked.join(ratios(counts, params), "key").select("_chunk", "key", "ratio")
    return rows.groupBy("_chunk").cogroup(known.groupBy("_chunk")).applyInArrow(score, typed + ", score double")


def both_classes(model: Model) -> bool:
    n = model.counts.agg(F.sum("rejected"), F.sum("accepted")).first()
    return all(n)


def calibrate(scored: DataFrame, params: Params = Params()) -> float:
    """Threshold of least mean error over both classes of ``scored`` (score, accepted); -inf if one is missing."""
    edge = 32 * params.bins_per_unit  # scores beyond +-32 nats a character share the outer bins
    at = F.greatest(F.least(F.floor(F.col("score") * params.bins_per_unit), F.lit(edge)), F.lit(-edge))
    rows = scored.groupBy(at.alias("bin"), "accepted").count().collect()
    histogram = np.zeros((2, 2 * edge + 2))
    for r in rows:
        histogram[int(r["accepted"]), r["bin"] + edge] = r["count"]
    if not histogram.sum(1).all():
        return float("-inf")
    share = histogram / histogram.sum(1, keepdims=True)
    # accept from bin k on: accepted urls below k and rejected ones from k on are errors
    error = np.cumsum(share[1]) - share[1] + 1 - (np.cumsum(share[0]) - share[0])
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float((best[len(best) // 2] - edge) / params.bins_per_unit)


def judge(pages: DataFrame, rules=RULES, params: Params = Params()) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages``."""
    urls = ruled(pages, rules)
    decided = (urls.where(F.col("rule_verdict").isNotNull())
               .select("page_id", "url", (F.col("rule_verdict") == "allow").alias("accepted")))
    held_out = F.crc32(F.col("url").cast("binary")) % 5 == 0
    model = fit(decided.where(~held_out), params)
    if both_classes(model):
        threshold = calibrate(with_scores(decided.where(held_out), model), params)
    else:
        threshold = float("-inf")
    model = model.plus(fit(decided.where(held_out), params))
    by_score = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    return with_scores(urls, model).select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_score).alias("verdict"), "score")
