"""Exact duplicates, filter audit and vector codes: brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import types as T

from delaylens.llm import filter_audit, trie_dedup, vector_codes

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("sha", T.StringType()),
                     T.StructField("n", T.StringType()), T.StructField("size", T.StringType()),
                     T.StructField("place", T.StringType()), T.StructField("_sha0", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("toxic", T.IntegerType()), T.StructField("part", T.StringType())])
SPACES = " \t\n\x0b\x0c\r"


def rows_of(texts):
    return [(i, t, ("en", "de", None)[k % 3], "x", "y", "z", "p", "q") for k, (i, t) in enumerate(texts)]


def texts(seed=1, n=400):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "é", "日本", "B", "#1", "ﬁ", "zz"]
    made = [" ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(n)]
    out = list(enumerate(made))
    out += [(n + k, "the same  passage") for k in range(150)]                    # a hot text, spaced in many ways
    out += [(n + 200 + k, SPACES[k % 6] * (k % 4) + "the same passage") for k in range(30)]
    out += [(5, made[5]), (5, made[5]), (7, "other text"), (None, "the same passage"), (None, made[3]), (None, None),
            (9001, None), (9002, ""), (9003, SPACES), (9004, " "), (9005, "x" * 70_000), (9006, "x" * 69_999 + " x"),
            (9007, "x" * 70_001), (None, "only here"), (None, "only here")]
    return out


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[re.sub("[ \t-\r]", "", t)].append((-len(t), i is None, i or 0))
    out = Counter()
    for i, t in rows:
        body = re.sub("[ \t-\r]", "", t or "")
        own = min(groups[body])
        out[i, None if own[1] else own[2], len(groups[body]), hashlib.sha256(body.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("budget", [48 << 20, 30_000])
def test_exact_groups_equal_brute_force(spark, budget):
    """Also with tries that spill all the time, in both passes and over several rounds."""
    data = texts()
    docs = spark.createDataFrame(rows_of(data), DOCS).repartition(5)
    got = trie_dedup.exact_groups(docs, trie_dedup.Params(budget=budget, batch=3_000)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(data)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert Counter(r.text_sha256 for r in kept) == Counter({r.text_sha256 for r in got})


def test_deduplicate_keeps_columns_and_one_row_of_each_text(spark):
    data = texts(n=60)
    docs = spark.createDataFrame(rows_of(data), DOCS)
    out = trie_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert Counter(re.sub("[ \t-\r]", "", r.text or "") for r in rows) == Counter(
        {re.sub("[ \t-\r]", "", t or "") for _, t in data})
    owners = {(k[3], k[1]) for k in brute_groups(data)}
    assert all((hashlib.sha256(re.sub("[ \t-\r]", "", r.text or "").encode()).hexdigest(), r.doc_id) in owners for r in rows)


def test_trie_keeps_every_text_through_spills():
    rng = random.Random(3)
    trie, kept, spilled = trie_dedup.Trie(trie_dedup.Params(budget=3_000)), Counter(), Counter()
    want = Counter()
    for k in range(3_000):
        key = bytes(rng.choices(b"ab", k=rng.randint(0, 9)))
        want[key] += 1
        own = trie_dedup.owner(1, k, k, 1, hashlib.sha256(key).digest())
        if not trie.add(key, own):
            spilled[key] += 1
        while trie.full():
            for text, o in trie.spill(stub=True):
                spilled[text] += o[4]
    for text, o in trie_dedup.terminals(trie.root, b""):
        kept[text] += o[4]
    assert spilled and not set(kept) & set(spilled)  # a text is done or spilled, never both
    assert kept + spilled == want


def test_trie_sizes_return_to_zero():
    trie = trie_dedup.Trie(trie_dedup.Params(budget=0))
    for k, key in enumerate([b"abc", b"abd", b"ab", b"x" * 1000, b"", b"abcde"]):
        trie.add(key, trie_dedup.owner(1, k, k, 1, b"d" * 32 + bytes([k])))
    while trie.root.children:
        list(trie.spill(stub=False))
    assert trie.root.bytes == 0 and trie.texts == 1  # the empty text, at the root


def brute_audit(rows, labels):
    labels = [x for x in labels if x[0] is not None]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall("[^ \t-\r]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and first[t] < i}
        docs.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for k, f in enumerate(order):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, k + 1] = [len(left), len(removed), sum(f in d[1] for d in gone),
                                           sum(d[1] == {f} for d in docs if d[0] == part),
                                           sum(d[2] for d in removed), sum(d[3] for d in removed)]
                gone += removed
                shapley[part, f] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(4)
    vocabulary = ["aa", "b", "Cc", "ddd", "e#", "ff", "Été", "日本", "gg|", "h"]
    out = []
    for i in range(160):
        words = rng.choices(vocabulary[: rng.randint(1, 10)], k=rng.randint(0, 260))
        if i % 3 == 0:
            words += [f"w{k}" for k in range(200)]
        out.append((i, rng.choice([" ", "\n", "\t \r"]).join(words), rng.choice(["en", "de", None, ""])))
    hot = " ".join(f"w{k}" for k in range(300))
    out += [(500 + k, hot, "en") for k in range(70)]
    out += [(3, hot, "de"), (3, hot, "de"), (None, hot, "fr"), (None, None, None), (900, None, "fr"), (901, "", "fr"),
            (902, "x " * 100_000, "fr")]
    return out


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    rng = random.Random(5)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows if i is not None and i % 2]
    labels += [(501, 0, 0), (501, 1, 1), (None, 1, 1), (12_345, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, "", "", "", "", "") for i, t, lang in rows], DOCS).repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame([(*x, "c") for x in labels], LABELS)).collect()
    want = brute_audit(rows, labels)
    counts = [*filter_audit.OUTCOMES, "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in counts) for r in got} == want
    assert len(got) == len(want)


def test_packed_fields_do_not_overflow():
    """2^40 documents of every mask leave every field with its own count."""
    n = 2 ** 40
    total = sum(n * filter_audit.packed(m, True, True) for m in range(32))
    fields = np.frombuffer(filter_audit.to_bytes(total), "<u8").reshape(len(filter_audit.OUTCOMES), -1)
    one = sum(np.frombuffer(filter_audit.to_bytes(filter_audit.packed(m, True, True)), "<u8").astype(int).reshape(fields.shape)
              for m in range(32))
    assert (fields == one * n).all()


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType()),
                        T.StructField("size", T.StringType()), T.StructField("_label", T.StringType())])


def vectors(n=300, dim=32, seed=6):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in np.round(rng.standard_normal(dim) * 0.02, 2)], i % 4 or None) for i in range(n)]
    rows += [(n + i, [0.01] * dim, 1) for i in range(100)]  # a hot vector
    rows += [(7, [0.5] * dim, 2), (7, [0.5] * dim, 2), (7, [-0.5] * dim, 2), (None, [0.25] * dim, None), (n + 200, None, 1),
             (n + 201, [None] + [0.0] * (dim - 1), 1), (n + 202, [float("nan")] * dim, 1), (n + 203, [float("inf")] * dim, 1)]
    return rows


def brute_codes(rows, dim, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * x)) for x in v], v, lab) for i, v, lab in rows
            if v is not None and None not in v and np.isfinite(v).all()]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = dim // parts
    cut = [[r[1][p * w:(p + 1) * w] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = Counter()
    for r, f in zip(kept, found):
        errors[r[3]] += sum(x[0] for x in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{x[1]:02x}" for x in f), sum(x[0] for x in f), errors[r[3]], sha) for r, f in zip(kept, found))


def test_codes_equal_brute_force(spark):
    rows = vectors()
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS).repartition(3)
    got = vector_codes.compress(table, vector_codes.Params(block=50)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows, 32)


def test_codes_of_few_rows_and_other_lengths(spark):
    rows = [(i, [float(i)] * 16, 1) for i in range(3)] + [(10 + i, [float(i), 1.0], 1) for i in range(2)] + [(20, [], 1), (21, [9e30] * 16, 1)]
    got = {r.vec_id: r for r in vector_codes.compress(spark.createDataFrame([(*r, "", "", "") for r in rows], VECTORS)).collect()}
    assert set(got) == {0, 1, 2, 10, 11, 20, 21}
    assert [got[i].code[:2] for i in range(3)] == ["00", "01", "02"] and all(r.error == 0 for r in got.values())
    books = vector_codes.train(spark.createDataFrame([(*r, "", "", "") for r in rows], VECTORS))
    back = vector_codes.decode(spark.createDataFrame([(1, got[1].code)], "vec_id long, code string"), books, 16).first()
    assert back.embedding == pytest.approx([1.0 + 0.5 / 256] * 16)


def test_orchard_equals_plain_search_and_measures_less():
    rng = np.random.default_rng(8)
    entries = rng.integers(-40, 40, (64, 4))
    entries[20] = entries[3]  # equal entries: the lower index
    points = np.concatenate([rng.integers(-40, 40, (3_000, 4)), entries, entries + 1])
    far = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    best, least, measured = vector_codes.Orchard(entries).nearest(points)
    assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
    assert measured < far.size / 2


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert trie_dedup.exact_groups(docs).collect() == []
    assert trie_dedup.deduplicate(docs).collect() == []
    assert filter_audit.audit(docs, labels).collect() == []
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
