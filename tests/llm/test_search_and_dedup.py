"""Top-k search, embedding near-duplicates, n-gram join, components: brute force on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaylens.llm import embed_dedup, ngram_join, vafile
from delaylens.llm.components import connected

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("score", T.StringType()), T.StructField("key", T.StringType())])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("class_id", T.StringType()), T.StructField("node", T.StringType()),
                     T.StructField("_gone0", T.StringType()), T.StructField("_place0", T.StringType())])


def components_of(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def vectors(seed=0, n=260):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(12)
        if i % 5 == 1:
            v = np.array(rows[-1][1]) + 0.05 * rng.standard_normal(12)  # near copy of the row before
        if i % 11 == 3:
            v = np.array([1.0] * 12)  # a hot vector, with ties
        rows.append((i, [float(np.float32(x)) for x in v], "x", "y"))
    rows += [(n, None, "x", "y"), (n + 1, [None] + [1.0] * 11, "x", "y"), (n + 2, [float("nan")] * 12, "x", "y"),
             (n + 3, [float("inf")] * 12, "x", "y"), (n + 4, [0.0] * 12, "x", "y"), (n + 5, [1.0, 0.0], "x", "y"),
             (n + 6, [2.0, 0.0], "x", "y"), (None, [1.0] * 12, "x", "y"), (n + 8, [], "x", "y")]
    return rows


@pytest.mark.parametrize("bits", [8, 2])
def test_topk_equals_brute_force(spark, bits):
    rows = vectors()
    got = vafile.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0,
                        vafile.Params(block=64, products=500, bits=bits)).collect()
    good = {i: np.floor(256 * np.array(v, np.float64)).astype(int) for i, v, *_ in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in good if i % 10 == 0):
        scored = sorted((-int(good[q] @ good[c]), c) for c in good if c != q and len(good[c]) == len(good[q]))
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert len(got) == len(want)


def test_topk_repeated_ids_and_empty_table(spark):
    """Every row but the query's own is a candidate, whatever its id; rows of one id are queries of their own."""
    rows = [(0, [1.0], "x", "y"), (0, [1.0], "x", "y"), (1, [0.5], "x", "y"), (1, [0.25], "x", "y"), (2, [], "x", "y")]
    got = vafile.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 2 == 0).collect()
    want = [(0, 1, 0, 256 * 256), (0, 2, 1, 256 * 128), (0, 3, 1, 256 * 64)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want * 2)
    assert vafile.search(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).count() == 0


def test_topk_of_one_id_on_many_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i // 7 * 10, [float(x) for x in rng.standard_normal(6)], "x", "y") for i in range(140)]
    got = vafile.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, vafile.Params(k=4, block=32)).collect()
    v = [np.floor(256 * np.float32(r[1]).astype(float)).astype(int) for r in rows]
    want = []
    for q in range(140):
        if rows[q][0] % 50 == 0:
            best = sorted((-int(v[q] @ v[c]), rows[c][0]) for c in range(140) if c != q)[:4]
            want += [(rows[q][0], r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_bounds_hold_for_every_pair_and_spare_exact_reads():
    rng = np.random.default_rng(4)
    exact, queries = rng.integers(-300, 300, (200, 9)), rng.integers(-300, 300, (50, 9)).astype(float)
    for bits in (3, 8):
        grid = vafile.Grid(exact.min(0), exact.max(0), bits)
        middle, off = grid.bounds(queries, grid.encode(exact))
        assert (np.abs(middle - queries @ exact.T) <= off[:, None]).all()
    q, c, *_ = vafile.survivors(np.arange(200), grid.encode(exact), 1_000 + np.arange(50), queries, grid, 5)
    assert len(q) <= 0.05 * 50 * 200  # eight bits leave a few more than k a query


def test_links_of_one_id_on_several_vectors(spark):
    """Ids do not stand for vectors: every row has the links of its own."""
    a, b = np.eye(8)[0], np.eye(8)[1]
    near = [a + 0.01 * np.eye(8)[2], b + 0.01 * np.eye(8)[2], b + 0.01 * np.eye(8)[3]]
    rows = [(1, a), (1, b), (2, near[0]), (3, near[1]), (4, near[2]), (4, near[2])]
    got = embed_dedup.near_duplicates(spark.createDataFrame([(i, [float(x) for x in v], "x", "y") for i, v in rows], VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [
        (1, 1, 1), (1, 3, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (4, 3, 1)]


@pytest.mark.parametrize("copies", [3, 70])
def test_links_of_copies_equal_sql(spark, tmp_path, copies):
    """The given vectors link with nothing, so near copies are added by one rule here and in SQL: row by row."""
    import duckdb

    table = f"""
      SELECT vec_id, embedding FROM read_parquet('/root/testdata/sf0.01/embeddings.parquet')
      UNION ALL SELECT 1000000 + 1000 * vec_id + c AS vec_id,
        [CAST(x + 0.004 * ((CAST(i AS BIGINT) * 7 + c * 13 + vec_id) % 11 - 5) AS FLOAT) FOR x, i IN embedding] AS embedding
      FROM read_parquet('/root/testdata/sf0.01/embeddings.parquet'), range({copies}) AS r(c) WHERE vec_id % 10 = 3"""
    con = duckdb.connect()
    con.execute(f"COPY ({table}) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = con.execute(embed_dedup.oracle_sql()).fetchall()
    got = embed_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), embed_dedup.Params(block=64)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(want)
    assert max(r.n_links for r in got) >= copies


@pytest.mark.parametrize("block", [768, 16])
def test_embedding_links_equal_brute_force(spark, block):
    rows = vectors(1)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(
        spark.createDataFrame(rows, VECTORS), embed_dedup.Params(block=block, bucket=32)).collect() if r.vec_id is not None}
    good = {i: np.array(v, np.float64) for i, v, *_ in rows if i is not None and v and None not in v
            and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b])
             and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    low = components_of([i for i, *_ in rows if i is not None], links)
    assert links
    for i, row in got.items():
        assert row.n_links == sum(a == i for a, _ in links)
        assert row.component_id == low[i] and row.kept == (low[i] == i)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    params = embed_dedup.Params(band=8, bands=40)
    x, y = rng.standard_normal((2, 64))
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    seen = []
    for seed in range(60):
        turn = embed_dedup.rotations(64, embed_dedup.replace(params, seed=seed))
        t = (x @ turn).reshape(-1, 64)
        factor = np.abs(t).sum(1) / 8
        seen.append(np.mean((np.sign(t) * (y @ turn).reshape(-1, 64)).sum(1) / 8 / factor))
    assert abs(np.mean(seen) - x @ y) < 0.02


def test_estimates_never_lose_a_pair_by_rounding_and_spare_most(spark):
    """Near pairs stay possible, far ones mostly not, at one rotation of 64 components and at several of few."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for dim in (64, 12, 200):
        x = rng.standard_normal((300, dim))
        x[150:] = x[:150] + 0.2 * rng.standard_normal((150, dim))  # cosines of about 0.98
        rows = [(int(k), 1, dim, [float(v) for v in r]) for k, r in enumerate(x)]
        params = embed_dedup.Params().for_rows(10 ** 6)
        table = spark.createDataFrame(rows, "node long, n long, dim int, embedding array<double>")
        part = pa.Table.from_pandas(embed_dedup.codes(table, params).toPandas().sort_values("node"))
        near = embed_dedup.possible(part, dim, params)
        k = np.arange(150)
        assert near[k, k + 150].all() and near[k + 150, k].all()
        far = near.copy()
        far[k, k + 150] = far[k + 150, k] = False
        np.fill_diagonal(far, False)
        assert far.mean() < (0.001 if dim >= 64 else 0.1)  # in few dimensions many pairs are near by chance
        code = [len(part.column(c)[0].as_py()) for c in ("turned", "factors")]
        assert dim != 64 or sum(code) + 4 + 8 <= 100  # with the unit of the values and the number


def texts(seed=0):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(90):
        w = [rnd.choice(words) for _ in range(rnd.choice([3, 6, 40, 80]))]
        if i % 3 == 1:
            w = rows[-1][1].split()
            if w:
                w[rnd.randrange(len(w))] = "changed"  # near copy of the row before
        if i % 10 == 9:
            w = "the same passage again and again here it is".split()
        rows.append((i, " ".join(w).upper() if i % 4 == 0 else "\n".join(w)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (203, "one"),
             (204, "One"), (205, "x " * 30_000), (206, "x " * 30_001)]
    return [(i, t, "c", "n", "g", "p") for i, t in rows]


def brute(rows, n=5, least=0.8):
    def words(t):
        return tuple((t or "").lower().split())
    docs = [(i, words(t)) for i, t, *_ in rows if i is not None]
    grams = {w: {w[k:k + n] for k in range(len(w) - n + 1)} for _, w in docs}
    near = {(a, b) for a in grams for b in grams if a != b and grams[a] and grams[b]
            and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= least}
    rep = {}
    for i, w in docs:
        rep[w] = min(i, rep.get(w, i))
    low = components_of(set(rep.values()), [(rep[a], rep[b]) for a, b in near])
    n_of = {w: sum(x == w for _, x in docs) for w in grams}
    links = {w: (n_of[w] - 1 + sum(n_of[b] for a, b in near if a == w)) if w else 0 for w in grams}
    return [(i, low[rep[w]] if w else i, links[w]) for i, w in docs]


@pytest.mark.parametrize("block", [384, 4])
def test_similarity_join_equals_brute_force(spark, block):
    rows = texts()
    params = ngram_join.Params(block=block, set_block=block)
    got = ngram_join.similarity_join(spark.createDataFrame(rows, DOCS), params).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == sorted(brute(rows))
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]


def test_one_document_of_each_class_stays(spark):
    rows = texts(3)
    docs = spark.createDataFrame(rows, DOCS)
    kept = ngram_join.keep_one(docs)
    assert kept.schema == docs.schema
    got = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert got == sorted({c for _, c, _ in brute(rows)})
    assert kept.where("doc_id IS NULL").count() == 1
    assert ngram_join.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_one_id_on_several_texts(spark):
    """Links, classes and the row that stays go by text, not by id."""
    rng = random.Random(8)
    a, b, c = (" ".join(f"{p}{rng.randrange(999)}" for _ in range(60)) for p in "abc")
    rows = [(1, a), (1, b), (1, a), (2, a + " more"), (3, b + " more"), (4, b + " x"), (5, c), (5, c + " tail"), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "c", "n", "g", "p") for i, t in rows], DOCS)
    got = ngram_join.similarity_join(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [
        (1, 1, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2), (5, 5, 0), (5, 5, 0), (5, 5, 1), (5, 5, 1)]
    kept = sorted((r.doc_id, (r.text or "")[:1]) for r in ngram_join.keep_one(docs).collect())
    assert kept == [(1, "a"), (1, "b"), (5, ""), (5, ""), (5, "c")]


def test_bands_reach_the_recall():
    p = ngram_join.Params()
    bands, rows = p.shape()
    assert bands * rows <= p.hashes
    assert 1 - (1 - p.threshold ** rows) ** bands >= p.recall


def test_jaccard_matrix():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    got = ngram_join.jaccard(sets, columns=16)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(set(a) & set(b)) / len(set(a) | set(b))


def test_components_of_paths_stars_and_cycles(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    links += [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(90)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    low = components_of({x for l in links for x in l}, links)
    assert got == {n: c for n, c in low.items() if n in got}
    assert set(low) - set(got) == {n for n in low if all(a == b for a, b in links if n in (a, b))}
