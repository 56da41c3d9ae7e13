"""What a fit holds on the driver, and how many rounds the components take."""

import random
import tracemalloc

import numpy as np
import pytest

from delaylens.llm import common, components, ngram_join, quality, toxicity


def sample(docs, words, seed=4):
    """(text, label, weight) of texts of mostly different words."""
    rnd = random.Random(seed)
    return [(" ".join(["vile" if k % 2 else "kind"] + [f"{rnd.getrandbits(44):x}" for _ in range(words)]), k % 2, 1.0)
            for k in range(docs)]


@pytest.mark.parametrize("module, params", [(toxicity, toxicity.Params(steps=3)), (quality, quality.Params(epochs=1))])
def test_a_fit_holds_few_bytes_for_each_ngram(module, params):
    """1,000 texts of 100 words: 60 MB at most; 170 (toxicity) and 144 (quality) when all n-grams were held at once."""
    rows = sample(1_000, 100)
    tracemalloc.start()
    try:
        module.fit_rows(rows, params)
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 100e6


def test_words_in_batches_give_the_buckets_of_all_at_once():
    words = [f"w{k}x" * (k % 4) for k in range(50)]
    params = quality.Params(buckets=997)
    row, bucket = quality.word_buckets(words, params)
    got, start = common.in_batches(words, lambda some: quality.word_buckets(some, params), 7)
    assert got.tolist() == bucket[np.argsort(row, kind="stable")].tolist()
    assert np.diff(start).tolist() == np.bincount(row, minlength=len(words)).tolist()
    none, start = common.in_batches([], lambda some: quality.word_buckets(some, params))
    assert len(none) == 0 and start.tolist() == [0]


def rounds(spark, monkeypatch, links):
    """(rows of ``connected``, star rounds it took)."""
    calls = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda *a: (calls.append(a[1]), star(*a))[1])
    out = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    monkeypatch.setattr(components, "_star", star)
    return sorted(tuple(r) for r in out), calls.count(True)


def test_components_take_no_round_to_see_that_nothing_changes(spark, monkeypatch):
    stars = [(k, 10 * (k // 10)) for k in range(200)] + [(7, 0), (0, 8)]
    assert rounds(spark, monkeypatch, stars) == ([(k, 10 * (k // 10)) for k in range(200)], 0)
    assert rounds(spark, monkeypatch, []) == ([], 0)
    assert rounds(spark, monkeypatch, [(3, 3)]) == ([], 0)
    # a chain of three, a node with two smaller neighbours, a node between a smaller and a larger one
    assert rounds(spark, monkeypatch, [(1, 2), (2, 3)]) == ([(1, 1), (2, 1), (3, 1)], 1)
    assert rounds(spark, monkeypatch, [(5, 1), (5, 2), (9, 8)]) == ([(1, 1), (2, 1), (5, 1), (8, 8), (9, 8)], 1)


def test_components_of_random_links(spark, monkeypatch):
    rnd = random.Random(9)
    links = [(a, rnd.randrange(max(0, a - 30), a)) for a in rnd.sample(range(1, 900), 600)]
    label = list(range(900))
    for _ in range(900):
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    touched = {x for link in links for x in link}
    got, _ = rounds(spark, monkeypatch, [link if rnd.random() < 0.5 else link[::-1] for link in links] + links[:50])
    assert got == sorted((k, label[k]) for k in touched)


def test_links_of_a_group_go_to_its_smallest_node():
    node = np.array([9, 4, 7, 4, 1, 8])
    label = common.local_components(6, np.array([0, 1, 3]), np.array([1, 2, 5]))
    assert ngram_join.lowest(node, label).tolist() == [4, 4, 4, 4, 1, 4]
