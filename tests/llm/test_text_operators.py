"""Classifiers, URL filter, licenses, packing, chat, SentencePiece: brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaylens.llm import catalog, chat, licenses, packing, pieces, quality, toxicity, urls

SF = "/root/testdata/sf0.01"
BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("score", T.StringType()), T.StructField("words", T.StringType()),
                     T.StructField("n", T.StringType())])
ODD = [None, "", " ", "a", "a  b", " lead", "trail ", "x\ny\n\nz", "\t\t", "漢字かな", "é😀\x00ß", "<|endoftext|> x", "it's 12!!",
       "word " * 20_000, "y" * 5_000, "▁ ▁", "x" + " " * 70 + "y"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", "w", "n") for i, t in enumerate(texts)], DOCS)


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.mark.parametrize("query, target, sf, least", [(catalog.op1_toxicity, "toxic", SF, 0.7), (catalog.op1_toxicity, "toxic", "/root/testdata/sf0.1", 0.95),
                                                      (catalog.op2_quality, "quality", SF, 0.95)])
def test_classifiers_rank_held_out_documents(spark, query, target, sf, least):
    rows = query(spark, sf).collect()
    label = dict(duckdb.sql(f"SELECT doc_id, {target} FROM read_parquet('{sf}/labels.parquet')").fetchall())
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM read_parquet('{sf}/documents.parquet')").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert auc(np.array([label[r.doc_id] for r in held]), np.array([r.score for r in held])) >= least


def toy():
    rnd = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeio" for c in ("lor", "mit", "sun", "rek")]
    rows = []
    for i in range(300):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        if i % 4 == 0:
            w.insert(rnd.randrange(len(w)), rnd.choice(["vilenak", "vilenor", "xvilena"]))
        rows.append((" ".join(w), int(i % 4 == 0), 1.0))
    return rows


def test_toxicity_finds_unseen_forms_and_scores_by_its_weights(spark):
    model = toxicity.fit_rows(toy())
    table = toxicity.WordTable(model.word_values)
    s = model.scores(["balor vilenux comit", "balor comit disun " * 300, ""], table)
    assert s[0] > 0.3 > s[1]
    docs = frame(spark, ODD)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t in enumerate(ODD):  # plain loops over the n-grams
        z = model.bias
        for w in set((t or "").lower().split()):
            z += model.word_values([w])[0]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-9)
    kept = toxicity.keep_below(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v < model.params.threshold}
    assert toxicity.score(frame(spark, []), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_without_both_classes(spark, module):
    schema = "doc_id long, toxic int, quality int, text string"
    for rows, want in (([], 0), ([(0, 1, 1, "t"), (1, 1, 1, None), (None, 0, 0, "")], 1), ([(0, 0, 0, ""), (1, None, None, "")], 0)):
        labels = spark.createDataFrame(rows, schema)
        model = module.fit(frame(spark, ["a b", "c d"]), labels, F.lit(True))
        assert [round(r.score) for r in module.score(frame(spark, [None, "x"]), model).collect()] == [want, want]


def test_quality_mean_of_vectors(spark):
    rnd = random.Random(5)
    rows = [(" ".join(rnd.choice(["sun", "moon", "star", "sky"]) + rnd.choice(["", "light"]) + ("###" if bad else "")
                      for _ in range(30)), int(not bad), 1.0) for bad in (0, 1) for _ in range(120)]
    rows += [(" ".join([rnd.choice(["sun", "moon", "sky"])] * 40), 0, 1.0) for _ in range(60)]
    model = quality.fit_rows(rows)
    table = quality.WordTable(model.word_values)
    good, bad, run = model.scores(["star sky moonlight sun " * 9, "cloud### rain### " * 9, "cloud " * 60], table)
    assert good > 0.7 > max(bad, run)
    got = {r.doc_id: r.score for r in quality.score(frame(spark, ODD), model).collect()}
    for i, t in enumerate(ODD):  # hashes, n-grams and pairs by plain loops
        buckets = plain_buckets(t or "", model.params)
        z = model.bias + (sum(model.logits[k] * n for k, n in buckets.items()) / sum(buckets.values()) if buckets else 0)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-9)
    assert quality.score(frame(spark, []), model).count() == 0


M64 = (1 << 64) - 1


def plain_mix(h):
    h = ((h ^ (h >> 33)) * 0xFF51AFD7ED558CCD) & M64
    h = ((h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53) & M64
    return h ^ (h >> 33)


def plain_ngrams(word, lo, hi):
    """Hashes of the character n-grams of a word between its marks, one n-gram at a time."""
    marked = "\x02" + word + "\x03"
    for n in range(lo, hi + 1):
        for at in range(len(marked) - n + 1):
            h = 0x9E3779B97F4A7C15
            for c in marked[at: at + n]:
                h = ((h ^ ord(c)) * 0x100000001B3) & M64
                h ^= h >> 29
            yield plain_mix(h)


def plain_word(word):
    total = 0
    for place, c in enumerate(word + "\x03"):
        total = (total + plain_mix((ord(c) + (place << 32)) & M64)) & M64
    return plain_mix(total)


def plain_buckets(text, params):
    """Buckets of a text with their counts, by loops over words, n-grams and pairs of words."""
    out, words = Counter(), text.split()
    for w in words:
        out[plain_word(w) % params.buckets] += 1
        for h in plain_ngrams(w, params.lo, params.hi):
            out[h % params.buckets] += 1
    for a, b in zip(map(plain_word, words), map(plain_word, words[1:])):
        pair = 0x5851F42D4C957F2D if a == b else plain_mix(((a * 0x9E3779B97F4A7C15) & M64) ^ plain_mix(b))
        out[pair % params.buckets] += 1
    return out


def test_toxicity_training_equals_plain_counts_and_steps():
    """Ratios from dictionaries of n-gram counts, then every step of the optimiser by loops over documents."""
    rows = toy()[:40] + [("", 0, 1.0), ("a", 1, 1.0)]
    params = toxicity.Params(buckets=997, steps=7)
    model = toxicity.fit_rows(rows, params)
    docs = []
    for text, _, _ in rows:  # an n-gram counts once for each distinct word that holds it
        words = sorted(set(text.lower().split()))
        docs.append([Counter(h % 997 for h in plain_ngrams(w, params.lo, params.hi)) for w in words])
    y, weight = [r[1] for r in rows], [r[2] for r in rows]
    n1 = sum(y)
    n0 = len(y) - n1
    holds = [Counter(), Counter()]
    for d, label in zip(docs, y):
        holds[label].update(set().union(*d) if d else ())
    a0, a1 = 2 * n0 / (n0 + n1), 2 * n1 / (n0 + n1)
    ratio = {}
    for k in set(holds[0]) | set(holds[1]):
        r = np.log((holds[1][k] + a1) / (n1 + 2 * a1)) - np.log((holds[0][k] + a0) / (n0 + 2 * a0))
        if holds[0][k] + holds[1][k] >= params.least_docs and abs(r) >= params.least_ratio:
            ratio[k] = r
    found = [sum(d, Counter()) for d in docs]
    found = [{k: n for k, n in f.items() if k in ratio} for f in found]
    w, bias = dict.fromkeys(ratio, 0.0), np.log(n1 / n0)
    m, v, mb, vb = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), 0.0, 0.0
    for step in range(1, params.steps + 1):
        grad, gb = {k: params.l2 * w[k] for k in ratio}, 0.0
        for f, label, wt in zip(found, y, weight):
            z = bias + sum(w[k] * ratio[k] * n for k, n in f.items())
            err = wt * (1 / (1 + np.exp(-z)) - label) / len(y)
            gb += err
            for k, n in f.items():
                grad[k] += err * ratio[k] * n
        old, ob = dict(w), bias
        for k in ratio:
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.99 * v[k] + 0.01 * grad[k] ** 2
            w[k] = old[k] - 0.05 * (m[k] / (1 - 0.9 ** step)) / ((v[k] / (1 - 0.99 ** step)) ** 0.5 + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb ** 2
        bias = ob - 0.05 * (mb / (1 - 0.9 ** step)) / ((vb / (1 - 0.99 ** step)) ** 0.5 + 1e-8)
    assert ratio and model.bias == pytest.approx(bias, abs=1e-9)
    want = np.zeros(997)
    for k in ratio:
        want[k] = w[k] * ratio[k]
    assert model.weights == pytest.approx(want, abs=1e-7)


def test_quality_training_equals_plain_steps():
    """Two documents a step, every gradient by hand over dictionaries of buckets."""
    rows = [("sun moon sun", 1, 1.0), ("bad## bad## x", 0, 2.0), ("sky", 1, 1.0), ("", 0, 1.0), ("no## good x x", 0, 1.0), ("star sun", 1, 0.5)]
    params = quality.Params(buckets=97, dim=3, epochs=2, batch=2)
    model = quality.fit_rows(rows, params)
    rng = np.random.default_rng(params.seed)
    vectors = rng.uniform(-1 / 3, 1 / 3, (97, 3)).astype(np.float32).astype(float)
    layer, bias, step, steps = np.zeros((3, 2)), np.zeros(2), 0, 6
    for _ in range(2):
        order = rng.permutation(6)
        for at in (0, 2, 4):
            rate = params.rate * (1 - step / steps)
            step += 1
            d_layer, d_bias, d_vectors = np.zeros((3, 2)), np.zeros(2), np.zeros((97, 3))
            for i in order[at: at + 2]:
                text, label, weight = rows[i]
                buckets = plain_buckets(text, params)
                size = max(1, sum(buckets.values()))
                mean = sum((vectors[k] * n / size for k, n in buckets.items()), np.zeros(3))
                p = np.exp(mean @ layer + bias)
                p /= p.sum()
                p[label] -= 1
                p *= weight
                d_layer += np.outer(mean, p)
                d_bias += p
                for k, n in buckets.items():
                    d_vectors[k] += n / size * (layer @ p)
            layer, bias, vectors = layer - rate * d_layer, bias - rate / 2 * d_bias, vectors - rate * 97 ** 0.25 * d_vectors
    assert model.logits == pytest.approx(vectors @ (layer[:, 1] - layer[:, 0]), abs=1e-4)
    assert model.bias == pytest.approx(bias[1] - bias[0], abs=1e-4)


def test_url_rules_in_sql(spark):
    got = {r.page_id: r for r in catalog.op6_url_filter(spark, SF).collect()}
    want = duckdb.sql(f"""
        WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h,
                          regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM read_parquet('{SF}/pages.parquet')),
        r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                              ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
        SELECT page_id, p.h, p.p, arg_max(r.h || r.p, len(r.h) + len(r.p)), arg_max(v, len(r.h) + len(r.p))
        FROM p LEFT JOIN r ON (p.h = r.h OR p.h LIKE '%.' || r.h) AND starts_with(p.p, r.p) GROUP BY 1, 2, 3""").fetchall()
    assert len(got) == len(want)
    for page, host, path, rule, verdict in want:
        assert (got[page].host, got[page].path, got[page]["rule"]) == (host, path, rule)
        assert got[page].verdict in (verdict, "allow", "block") and (verdict is None or got[page].verdict == verdict)


def test_url_edge_cases(spark):
    schema = "page_id long, url string, host string, score string, accepted string"
    links = [None, "", "nothing", "HTTP://A.Example.ORG/es/x", "x://com", "x://COM/fr/é?q#f", "s://notcom/fr/", "s://a.com/de/#x", "s://org?x"]
    rows = [(i, u, "h", "s", "a") for i, u in enumerate(links)]
    got = [tuple(r)[1:5] for r in urls.judge(spark.createDataFrame(rows, schema)).orderBy("page_id").collect()]
    assert [g[:3] for g in got] == [("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/x", "example.org/es/"),
                                    ("com", "", None), ("com", "/fr/é", "com/fr/"), ("notcom", "/fr/", None),
                                    ("a.com", "/de/", "com/de/"), ("org", "", None)]
    assert {g[3] for g in got} <= {"allow", "block"}
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0


def test_url_models_equal_counts_in_dictionaries(spark):
    rnd = random.Random(3)
    rows = [(f"http://{rnd.choice('abc')}.net/{rnd.choice(['good', 'fine'])}/{i}", True) for i in range(60)]
    rows += [(f"http://{rnd.choice('abc')}.net/{rnd.choice(['spam', 'junk'])}/{i}", False) for i in range(50)]
    params = urls.Params(order=3)
    model = urls.fit(spark.createDataFrame(rows, "url string, accepted boolean"), params)
    counts = [defaultdict(Counter), defaultdict(Counter)]

    def contexts(raw, at):
        return [tuple(raw[at - k] if at - k >= 0 else -1 for k in range(1, n + 1)) for n in range(params.order + 1)]

    for u, ok in rows:
        raw = u.encode()
        for at, b in enumerate(raw):
            for c in contexts(raw, at):
                counts[ok][c][b] += 1
    for u in ["http://a.net/good/7", "http://z.net/spamé", "", "q"]:
        raw, total = u.encode(), 0.0
        for at, b in enumerate(raw):
            p = [1 / 256, 1 / 256]
            for c in contexts(raw, at):
                for k in (0, 1):
                    p[k] = (counts[k][c][b] + params.strength * p[k]) / (sum(counts[k][c].values()) + params.strength)
            total += np.log(p[1]) - np.log(p[0])
        assert model.scores([u])[0] == pytest.approx(total / max(1, len(raw)), abs=1e-9)
    good, bad = model.scores(["http://c.net/fine/999", "http://a.net/junk/999"])
    assert good > 0 > bad


def test_url_models_tell_all_contexts_apart(spark):
    rnd = random.Random(8)
    rows = [("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(100)), i % 2 == 0) for i in range(3_000)]
    params = urls.Params()
    counts = [Counter(), Counter()]
    for u, ok in rows:
        for at in range(len(u)):
            for n in range(params.order + 1):
                context = (n, u[max(0, at - n): at])
                counts[ok][context] += 1
                counts[ok][context, u[at]] += 1
    assert len(counts[0] | counts[1]) > 2 * (1 << 19)  # far more than any table of fixed size held
    some = [u for u, _ in rows[::300]] + ["never/seen"]
    want = []
    for u in some:
        total = 0.0
        for at, c in enumerate(u):
            p = [1 / 256, 1 / 256]
            for n in range(params.order + 1):
                context = (n, u[max(0, at - n): at])
                p = [(counts[k][context, c] + params.strength * p[k]) / (counts[k][context] + params.strength) for k in (0, 1)]
            assert 0 < min(p) and max(p) < 1
            total += np.log(p[1]) - np.log(p[0])
        want.append(total / len(u))
    model = urls.fit(spark.createDataFrame(rows, "url string, accepted boolean"), params)
    assert model.scores(some) == pytest.approx(want, abs=1e-9)


def test_url_models_that_judge_count_the_held_out_urls_too(spark):
    links = [f"http://{name}.{end}{i}" for i in range(12) for name, end in (("good", "org/"), ("spam", "com/de/"))]
    assert 0 < sum(zlib.crc32(u.encode()) % 5 == 0 for u in links) < len(links)
    odd = next(u for u in (f"http://b.com/de/zqzqzq{i}" for i in range(99)) if zlib.crc32(u.encode()) % 5 == 0)
    links += [odd, "http://new.net/zqzqzq"]
    rows = [(i, u, "h") for i, u in enumerate(links)]
    got = [r.score for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    decided = [(u, ".org/" in u) for u in links[:-1]]
    every = urls.fit(spark.createDataFrame(decided, "url string, accepted boolean"))
    assert got == pytest.approx(every.scores(links), abs=1e-9)


def test_licenses_in_whole_parts_and_pieces(spark):
    texts = ["Released under the MIT License. MIT  license; mit-license", "Permission is hereby granted, free of any charge",
             "permission is granted hereby", "the GNU General Public License, version 3", "general public", None, "", "é MIT\nLICENSE",
             "Licensed under CC BY-NC 4.0.", "mIt license " * 4_000, "K mit İ license"]
    docs = frame(spark, texts + texts[:1])
    got = [tuple(r) for r in licenses.scan(docs).orderBy("doc_id").collect()]
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841 (read by the SQL below)
    con.register("documents", documents)
    want = sorted(con.execute(licenses.oracle_sql()).fetchall())
    assert got == want
    by = {r[0]: r for r in got}
    assert by[0][1:7] == (9, 3, 3, 7, "mit", "mit")
    assert (by[1][2], by[1][6]) == (0, "mit") and by[2][6] == "" and by[3][6] == "gpl" and by[4][6] == ""
    assert by[9][2:5] == (4_000, 0, 7_998)
    repeated = spark.createDataFrame([(1, "mit license", "s", "w", "n")] * 3, DOCS)
    assert [tuple(r)[1:4] for r in licenses.scan(repeated).collect()] == [(2, 1, 0)] * 3
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_spans_cover_rising_template_positions(spark):
    rnd = random.Random(9)
    texts = ["2.0, 2.0, 2.0", "public license public license", "apache license, 2.0 version 2.0", "mozilla the public license",
             "gnu general x public license version", "license version general public gnu general"]
    words = "gnu lesser general public license version 2 0 apache mozilla and use in source binary forms x".split()
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 25))) for _ in range(400)]
    for paragraph, _ in licenses.PARAGRAPHS:  # whole, with words put in and left out, cut, and out of order
        p = paragraph.split()
        texts += [paragraph, " ".join(["so", *p[: len(p) // 2], "odd", "words", *p[len(p) // 2:], "end"]),
                  " ".join(w for i, w in enumerate(p) if i != 9), " ".join(p[: len(p) * 3 // 4]), " ".join(p[: len(p) // 3]),
                  " ".join(p[len(p) // 2:] + p[: len(p) // 2]), " ".join(w + " " + w for w in p)]
    texts += ["public license " * 3_000]
    params = licenses.Params()

    def run_of(hits):  # longest run over all subsets that rise, by recursion
        best = {}
        for i, j in sorted(hits, reverse=True):
            best[i, j] = 1 + max((n for (x, y), n in best.items() if x > i and y > j), default=0)
        return max(best.values())

    for repeat in (1, 3):  # rows that repeat a text are judged like one
        got = {r.doc_id: r for r in licenses.scan(frame(spark, texts).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
                                                  .drop("again")).collect()}
        for k, t in enumerate(texts):
            w = re.findall("[a-z0-9]+", t)
            labels, score = set(), 0.0
            for _, p, label, _, g in licenses.templates_of():
                grams = defaultdict(list)
                for j in range(len(p) - g + 1):
                    grams[tuple(p[j:j + g])].append(j)
                hits = [(i, j) for i in range(len(w) - g + 1) for j in grams.get(tuple(w[i:i + g]), ())]
                by = defaultdict(list)
                for i, j in hits:
                    by[i - j].append((i, j))
                spans, last = [], None
                for d in sorted(by):
                    if len(by[d]) == len(p) - g + 1:
                        labels.add(label)
                        score = 1.0
                    elif last is not None and d - last <= params.gap:
                        spans[-1] += by[d]
                        last = d
                    else:
                        spans.append(list(by[d]))
                        last = d
                for span in spans:
                    at = [i for i, _ in span]
                    if max(at) - min(at) + g > params.stretch * len(p):
                        continue
                    share = run_of(span) / (len(p) - g + 1)
                    if share >= params.coverage:
                        labels.add(label)
                        score = max(score, share)
            assert (got[k].labels, got[k].score) == (",".join(sorted(labels)), pytest.approx(score)), t
        assert [got[k].labels for k in range(5)] == ["", "", "apache", "", "gpl"]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841 (read by the SQL below)
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(map(tuple, got.values())) == sorted(con.execute(licenses.oracle_sql()).fetchall())


def test_license_templates_of_any_length(spark):
    """Other templates, another k, and a template table that is not broadcast."""
    docs = frame(spark, ["a b c d e f g h", "a b c x d e f g h", "mit license", "a b"])
    params = licenses.Params(gram=3, broadcast=0)
    got = {r.doc_id: r for r in licenses.scan(docs, passages=(), params=params, paragraphs=(("a b c d e f g h", "own"),)).collect()}
    assert [got[k].labels for k in range(4)] == ["own", "own", "mit", ""] and got[1].score == pytest.approx(4 / 6)
    with pytest.raises(ValueError):
        licenses.templates_of(paragraphs=(("a b c", "short"),))


def check_packing(rows, ids_of, window=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            part = np.array(ids[at: at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes())) and r.length > 0
            at += r.length
        assert at == len(ids)
    padding = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    odd = frame(spark, ODD).select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    docs = docs.unionByName(odd)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {i: exact.encode(t, add_special_tokens=False).ids + [0] for i, t in texts.items()}
    assert check_packing(packing.pack(docs, BPE).collect(), ids) == 0
    assert packing.pack(frame(spark, []), BPE).count() == 0


def test_packing_chooses_the_least_sum_of_squares():
    rnd = random.Random(1)
    params = packing.Params(window=16, open_windows=10 ** 6)
    packer, levels = packing.Packer(params), Counter()
    for doc in range(600):
        size = rnd.randint(1, 15)

        def total(level):
            c = Counter(levels)
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return sum(v * v for v in c.values())

        best = min((total(h), -h) for h in range(0, 17 - size) if h == 0 or levels[h])
        level = -best[1]
        if level:
            levels[level] -= 1
        if level + size < 16:
            levels[level + size] += 1
        packer.add(doc, np.arange(size, dtype="<u4"))
        assert {h: int(v) for h, v in enumerate(packer.count) if v} == {h: v for h, v in levels.items() if v}
    before = [[p[0] for p in w] for level in range(15, 0, -1) for w in packer.open[level]]
    done = len(packer.closed)
    packer.drain(last=True)
    windows = packer.take()
    sizes = [sum(len(p[2]) for p in w) for w in windows]
    assert all(s & (s - 1) == 0 for s in sizes) and sum(s < 16 for s in sizes) <= 4
    # the fullest open windows are still there, in order, with pieces of the emptiest behind
    after = [[p[0] for p in w] for w in windows[done:]]
    intact = sum(a[: len(b)] == b for a, b in zip(after, before))
    assert intact >= len(after) - 6 and intact > 0.5 * len(before)


def test_open_windows_bound_what_is_held():
    rnd = random.Random(7)
    packer, fed = packing.Packer(packing.Params(window=64, open_windows=5)), {}
    for doc in range(900):
        fed[doc] = np.arange(rnd.randint(1, 200), dtype="<u4") + doc
        packer.add(doc, fed[doc])
        assert packer.count.sum() <= 5 and packer.count.sum() == sum(map(len, packer.open))
    packer.drain(last=True)
    windows = packer.take()
    pieces = sorted((p[0], p[1], p[2].tolist()) for w in windows for p in w)
    for doc, ids in fed.items():
        own = [p for p in pieces if p[0] == doc]
        assert sum((p[2] for p in own), []) == ids.tolist() and [p[1] for p in own] == list(np.cumsum([0] + [len(p[2]) for p in own])[:-1])
    sizes = [sum(len(p[2]) for p in w) for w in windows]
    assert sum(s != 64 for s in sizes) <= 6 and all(s & (s - 1) == 0 for s in sizes)


def test_other_vocabularies_go_through_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer
    with open(BPE, encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.regular(spec, ["<|endoftext|>"])
    spec["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    bpe, exact = packing.ByteBpe.load(str(path)).open(), Tokenizer.from_file(str(path))
    assert bpe.fast is None
    texts = ["It's HERE  now", "", "x\ny Z"]
    assert [i.tolist() for i in bpe.encode(texts)] == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_byte_bpe_equals_the_library():
    rnd = random.Random(4)
    bpe = packing.ByteBpe.load(BPE).open()
    parts = ["a", "The", "ing", " ", "  ", "\n", "\t", "é", "漢字", "12", "'s", "\x00", "😀", "<|endoftext|>", "!!", "\u00a0", "\u3000", "\r\n", " x"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(2_000)]
    assert [x.tolist() for x in bpe.encode(texts)] == [bpe.exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_chat_reads_back(spark):
    schema = "conv_id long, turn long, role string, text string, segments string, turns string"
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\<s>\\(", "<+>", "", None, "<|x|>", "a\nb", "[[<<SYS>>]]", "\\-\\{", "é" * 40_000]
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool|x>", "", None]), rnd.choice(nasty), "s", "t")
            for c in (0, 1, 2, -1, None) for t in [0, 1, 1, 2, 3, None, 5, 6]]
    data = spark.createDataFrame(rows, schema)
    out = chat.format_conversations(data)
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    spans = {r.conv_id: r for r in out.select("conv_id", "formatted", "segments", chat.loss_spans(F.col("segments")).alias("spans")).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        listed = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(listed.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        full = spans[conv].formatted
        assert len(full) == row.formatted_chars and full == "".join(s.text for s in spans[conv].segments)
        under = "".join(full[s.start: s.start + s.length] for s in spans[conv].spans)
        assert under.replace("\\{", "[").replace("\\(", "<").replace("\\-", "\\") == loss
        blocks = [role for k, (*_, role, _) in enumerate(turns) if k == 0 or turns[k - 1][2] != role]
        assert len(re.findall(r"<s>", full)) == blocks.count("assistant")
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_chat_digests_come_from_the_output(spark):
    """A mark that is damaged in the output shows in the digests."""
    rows = [(1, k, ["user", "assistant"][k // 2 % 2], f"text <{k}>") for k in range(9)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    good = chat.digests(out).first()
    full = out.first().formatted
    for at in (m.start() for m in re.finditer(r"<s>|</s>|<\+>|\[INST\]", full)):
        broken = spark.createDataFrame([(1, full[:at] + full[at + 3:])], "conv_id long, formatted string")
        bad = chat.digests(broken).first()
        assert (bad.turns_sha256, bad.loss_sha256) != (good.turns_sha256, good.loss_sha256)
    for at in (m.start() for m in re.finditer(r"<s>|</s>", full)):
        bad = chat.digests(spark.createDataFrame([(1, full[:at] + "x" + full[at + 1:])], "conv_id long, formatted string")).first()
        assert bad.loss_sha256 != good.loss_sha256


def test_long_conversations_take_linear_time(spark):
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("0L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role",
                                         "concat('turn ', id) AS text")
        began = time.perf_counter()
        out = chat.format_conversations(rows)
        row = chat.digests(out).first()
        assert row.n_turns == n
        spans = out.select("formatted", chat.loss_spans(F.col("segments")).alias("spans")).first()
        assert sum(s.length for s in spans.spans) == row.loss_chars
        assert all(spans.formatted[s.start: s.start + 5] == "turn " for s in spans.spans)
        return time.perf_counter() - began

    seconds(1_000)
    small, large = min(seconds(4_000) for _ in range(2)), seconds(16_000)
    assert large <= 4 * small + 3


def test_sentencepiece_equals_the_library(spark):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=PIECE)
    own = pieces.Pieces.load(PIECE)
    rnd = random.Random(3)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "漢字", "1", "23", "▁", "\x00", "😀", "</s>", "<0x41>", "ab" * 30, "aaaa",
             "日本語テキスト" * 4, "   \n ", " " * 17, " " * 40]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1_500)]
    texts += [" " * k for k in range(0, 400, 3)] + ["a" * k for k in range(60)] + ["x" + " " * k + "漢" for k in range(60)]
    got, want = own.encode(texts, own.table()), sp.encode(texts)
    assert got == want
    assert [own.decode(i) for i in got] == sp.decode(want)
    for _ in range(500):
        ids = [rnd.choice([rnd.randint(0, 31_999), rnd.randint(3, 258)]) for _ in range(rnd.randint(0, 12))]
        assert own.decode(ids) == (sp.decode(ids) if ids else "")
    docs = frame(spark, ODD)
    encoded = pieces.encode(docs, PIECE)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: sp.encode(t or "") for i, t in enumerate(ODD)}
    assert {r.doc_id: r.text for r in pieces.decode(encoded, PIECE).collect()} == \
        {i: sp.decode(sp.encode(t)) if t else "" for i, t in enumerate(ODD)}
    for r in pieces.digests(docs, PIECE).collect():
        ids = sp.encode(ODD[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert pieces.digests(frame(spark, []), PIECE).count() == 0


def test_native_operators_use_no_python(spark):
    docs, turns = frame(spark, ["x"]), spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (licenses.scan(docs), chat.digests(chat.format_conversations(turns))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_queries_match_their_sql(spark):
    sys.path.insert(0, str(__file__).rsplit("/tests/", 1)[0] + "/tools")
    from oracle_check import compare, duck
    con = duck("/root/testdata/sf0.001")
    for key, sql in catalog.ORACLE.items():
        result = compare(spark, con, key, catalog.QUERIES[key], sql, "/root/testdata/sf0.001")
        assert result["ok"] and result["rows"], result
