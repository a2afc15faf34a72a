import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import near_dedup as nd


def brute(texts):
    """Components by comparing all pairs of full sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [(i, len(sets[i]), root(i), root(i) == i) for i in range(len(texts))]


def families(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "A b\tc d  e", "x y"]
    for f in range(8):
        base = [word() for _ in range(rng.choice((30, 120, 600)))] + (passage if f % 2 else [])
        for _ in range(rng.choice((1, 3, 25))):
            new = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 5, 8, len(base) // 40))):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
        chain = list(base)  # each like the one before, the last unlike the first
        for k in range(10):
            for i in range(k * 4, k * 4 + 2):
                chain[i * 3 % len(chain)] = word()
            texts.append(" ".join(chain))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, documents, seed):
    texts = families(seed)
    rows = nd.group_documents(documents(texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == brute(texts)


def test_second_look_finds_links_between_members(spark, documents, monkeypatch):
    """A bucket's smallest member is unlike two others that are like each other."""
    monkeypatch.setattr(nd, "BLOCK", 2)
    sizes = (1, 2, 2, 3, 2, 3)
    classes = spark.createDataFrame([(i, 10, bytearray([v] * nd.POSITIONS)) for i, v in enumerate(sizes)], "rep long, n_shingles long, sketch binary")
    sets = spark.createDataFrame([(i, bytearray(np.arange(v * 100, v * 100 + 10 + i, dtype=np.uint64).tobytes())) for i, v in enumerate(sizes)], "doc_id long, shingles binary")
    members = spark.createDataFrame([(7, i) for i in range(6)], "bucket long, rep long")
    comps = spark.createDataFrame([(1, 1), (2, 1)], "v long, component long")
    got = nd.components(nd.second_look(members, comps, classes, sets).union(spark.createDataFrame([(1, 2)], "a long, b long")))
    assert dict(map(tuple, got.collect())) == {1: 1, 2: 1, 4: 1, 3: 3, 5: 3}


def test_odd_rows(spark, documents):
    long = "w" + " w".join(map(str, range(60_000)))
    rows = [(None, long), (5, long), (3, long), (5, "something else entirely here now ok"), (9, "something else entirely here now ok"), (2, None), (2, None)]
    got = sorted(map(tuple, nd.group_documents(documents(rows)).collect()), key=str)
    n = 60_000 - 4
    assert got == sorted([(None, n, None, True), (5, n, 3, False), (3, n, 3, True), (5, 2, 3, False), (9, 2, 3, False), (2, 0, 2, True), (2, 0, 2, True)], key=str)
    assert nd.group_documents(documents([])).count() == 0
    odd = documents(["a b c d e f", "a b c d e f"]).withColumn("gone_", F.lit(1)).withColumn("component_id", F.lit(1))
    out = nd.drop_near_duplicates(odd)
    assert out.columns == odd.columns and [r["doc_id"] for r in out.collect()] == [0]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(1000, 1400)] + [(1399, 2000)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = dict(map(tuple, nd.components(links).collect()))
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in (7, 1000, 1399, 2000))


def test_signatures_estimate_similarity_with_less_variance_than_independent_draws():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(150):
        common, a, b = (rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (60, 20, 20))
        sig = nd.signatures([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b])), np.zeros(0, np.uint64)])
        errors.append((sig[0] == sig[1]).mean() - 0.6)
        assert (sig[2] == np.uint64(2 ** 64 - 1)).all() and sig[:2].max() < np.uint64(2 ** 64 - 1)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.6 * 0.4 / nd.POSITIONS) ** 0.5


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64)) for n in (1, 5, 50, 3000)]
    together = nd.signatures(sets)
    assert all(np.array_equal(together[i], nd.signatures([s])[0]) for i, s in enumerate(sets))
    assert all(len(np.unique(together[0] >> np.uint64(53))) == nd.POSITIONS for _ in (0,))  # one element deals every rank once
