import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from pulsegrid.llm import lexical_search, manifest, packing
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
SPLIT = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- packing

def two_fit(lengths, capacity):
    """Best-two-fit piece by piece."""
    left, out = collections.Counter(lengths), []
    while +left:
        gap, mine = capacity, []
        while fits := [x for x in left if left[x] and x <= gap]:
            mine.append(max(fits))
            left[mine[-1]] -= 1
            gap -= mine[-1]
        if gap and len(mine) > 1:
            least = min(mine)
            pairs = [(a + b, a, b) for a in left for b in left if left[a] and left[b] and (a > b or a == b and left[a] > 1) and least < a + b <= gap + least]
            if pairs:
                mine.remove(least)
                left[least] += 1
                for x in max(pairs)[1:]:
                    mine.append(x)
                    left[x] -= 1
        out.append(sorted(mine))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_plan_equals_piecewise_two_fit(case):
    capacity, lengths = case
    planned = packing.plan(np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, np.int64), capacity)
    found = collections.defaultdict(list)
    for row in planned.itertuples():
        for i in range(row.times):
            found[row.sequence + i] += [row.length] * row.per
    assert [sorted(found[i]) for i in sorted(found)] == two_fit(lengths, capacity)


def test_two_fit_replaces_the_smallest():
    planned = packing.plan(np.bincount([6, 3, 2, 2], minlength=11), 10)  # 6 + 3 leaves a gap of one; 6 + 2 + 2 leaves none
    assert sorted(zip(planned["length"], planned["sequence"], planned["per"], strict=True)) == [(2, 0, 2), (3, 1, 1), (6, 0, 1)]


def test_packed_documents_are_whole(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    given_texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    given_texts += [None, "", "a <|endoftext|> b", "word " * 5000, "x" * 30_000, "same", "same"]
    frame = documents(given_texts).unionByName(documents([(7, "again"), (7, "again"), (None, "no id")]))
    frame = frame.withColumns({"part": F.lit(1), "nth": F.lit("x"), "ids": F.lit(0)}).repartition(5)
    rows = packing.pack(frame, path, capacity=512).collect()
    places = collections.defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and 0 < r["length"] <= 512
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, t in enumerate(given_texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        if i != 7:
            assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == want
            assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
            assert all(r["length"] == 512 for r in own[1:])
    assert len(by_doc[None]) == 1
    total = sum(r["length"] for r in rows)
    assert len(places) <= 1.02 * -(-total // 512) + 1
    assert packing.pack(documents([]), path).count() == 0


def test_packing_without_sent_table(spark, documents, monkeypatch):
    monkeypatch.setattr("pulsegrid.llm.common.SMALL_ROWS", 0)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(documents([f"text {i} " * (i % 50) for i in range(300)]).repartition(6), path, capacity=64).collect()
    taken = {(r["sequence_id"], r["offset"] + i) for r in rows for i in range(r["length"])}
    assert len(taken) == sum(r["length"] for r in rows)


# ---- manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def brute_manifest(rows):
    """{(doc_id, leaf): row of op12} by lists."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees, own = [], []
    for name in names:
        found = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, leaf_of([r[c] for c in manifest.FIELDS]), i) for i, r in enumerate(groups[name])])
        own.append([(leaf, groups[name][i]) for _, _, leaf, i in found])
        trees.append(levels_of([leaf for leaf, _ in own[-1]]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, (tree, leaves) in enumerate(zip(trees, own, strict=True)):
        for pos, (leaf, r) in enumerate(leaves):
            folded = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                low = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                folded = leaf_of([low if c == "text" else r[c] for c in manifest.FIELDS])
            proof = ""
            for levels, at in ((tree, pos), (top, k)):
                for level in levels[:-1]:
                    run = level[at // 8 * 8:at // 8 * 8 + 8]
                    proof += "".join(run[:at % 8] + run[at % 8 + 1:])
                    folded = sha("".join([*run[:at % 8], folded, *run[at % 8 + 1:]]))
                    at //= 8
            out.append((r["doc_id"], leaf, tree[-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return out


def op12_rows(spark, folder_of, frame):
    found = manifest.op12_merkle_manifest(spark, folder_of(documents=frame))
    return found, [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in found.collect()]


KEY = str


@pytest.mark.parametrize("hot", [512, 4, 1])
def test_manifest_equals_lists(spark, documents, folder_of, monkeypatch, hot):
    monkeypatch.setattr(manifest, "HOT", hot)
    frame = documents([f"Text {i} É" for i in range(190)], lang="en")
    frame = frame.unionByName(documents([(i, "AbC" * (i % 5)) for i in range(1000, 1065)], lang="de")).unionByName(documents([(5000, "Alone")], lang="fr"))
    frame = frame.unionByName(documents([(6000, None), (6001, ""), (None, "no id"), (None, "no id"), (6002, "X"), (6002, "X"), (6002, "Y"), (3, "A" * 100_000)], lang=None))
    frame = frame.unionByName(documents([(7000 + i, "B") for i in range(9)], lang="é")).withColumns({"leaf": F.lit(1), "step": F.lit("x"), "digest": F.lit(0)})
    _, rows = op12_rows(spark, folder_of, frame.repartition(7))
    assert sorted(rows, key=KEY) == sorted(brute_manifest(frame.collect()), key=KEY)
    assert {r[6] for r in rows} == {True, False}


@pytest.mark.parametrize("n,lang", [(0, "en"), (1, "en"), (1, None), (8, "en"), (9, "en"), (65, "en")])
def test_small_manifests(spark, documents, folder_of, n, lang):
    frame = documents([f"T{i}" for i in range(n)], lang=lang)
    _, rows = op12_rows(spark, folder_of, frame)
    assert sorted(rows, key=KEY) == sorted(brute_manifest(frame.collect()), key=KEY)


def test_many_trees(spark, documents, folder_of):
    frame = documents([f"T{i}" for i in range(300)]).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 150).cast("string")))
    _, rows = op12_rows(spark, folder_of, frame)
    assert sorted(rows, key=KEY) == sorted(brute_manifest(frame.collect()), key=KEY)


# ---- ranked lexical search

def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring all documents."""
    cut = [(i, SPLIT.findall(lower(t))) for i, t in docs]
    cut = [(i, collections.Counter(t), len(t)) for i, t in cut if t]
    n_docs, n_terms = len(cut), sum(n for _, _, n in cut)
    df = collections.Counter(t for _, c, _ in cut for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(SPLIT.findall(lower(text)))
        found = []
        for i, c, n in cut:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t, times in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return out


def test_terms_are_cut_as_the_pattern_does():
    texts = ["Don't STOP\x00me\x7fnow", None, "", "ÀÉ x_y 12a", "...", "a", "日本 語😀b", "z" * 100_000, "É", "a a A"]
    known = sorted({t for x in texts for t in SPLIT.findall(lower(x))})
    n, doc, term, tf = lexical_search.count_terms(pa.array(texts), pa.array(known, pa.large_string()))
    assert n.tolist() == [len(SPLIT.findall(lower(t))) for t in texts]
    found = collections.defaultdict(dict)
    for d, t, c in zip(doc.tolist(), term.tolist(), tf.tolist(), strict=True):
        found[d][known[t]] = c
    assert all(found[i] == collections.Counter(SPLIT.findall(lower(t))) for i, t in enumerate(texts))


@pytest.mark.parametrize("settings_", [{}, {"dim": 4}, {"block_queries": 3, "block_terms": 200}])
def test_search_equals_scoring_everything(spark, documents, settings_):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9000, None), (9001, ""), (9002, "..."), (None, "the and of"), (9003, "Tie tie"), (9004, "tie TIE"), (9004, "tie tie"), (9005, "the " * 50_000)]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "TIE"), (903, "tie tie tie"), (904, "no_such_termqqq"), (905, "the"), (905, "the"), (None, "tie")]
    frame = documents(docs).withColumns({"n": F.lit(1), "terms": F.lit("x"), "score": F.lit(0)}).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    found = lexical_search.rank(frame, asked, **settings_)
    rows = [tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(rows, key=KEY) == sorted(brute_search(docs, items), key=KEY)


def test_search_of_nothing(spark, documents):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.rank(documents([]), items).count() == 0
    assert lexical_search.rank(documents([None, ""]), items).count() == 0
    assert lexical_search.rank(documents(["a"]), items.limit(0)).count() == 0


def test_bounds_spare_most_scores():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    weights = np.full(len(vocabulary), 5000)
    queries = [{int(t): 1 for t in rng.integers(0, 2000, 12)} for _ in range(20)]
    searcher = lexical_search.Searcher(queries, vocabulary, weights, 4000, 4000 * 40)
    term = rng.integers(0, 2000, 4000 * 40)
    for q, terms in enumerate(queries):  # each query has its documents
        for d in range(12 * q, 12 * q + 12):
            term[40 * d:40 * d + len(terms)] = list(terms)
    starts = np.arange(4001) * 40
    tf, n = np.ones(len(term), np.int64), np.full(4000, 40)
    impact = lexical_search.impacts_of(weights, 4000, 160_000, np.repeat(n, 40), tf, term)
    sketches = np.zeros((4000, lexical_search.DIM), np.uint16)
    np.maximum.at(sketches, (np.repeat(np.arange(4000), 40), lexical_search.coordinates(vocabulary)[term]), -(-impact // searcher.unit))
    searcher.show(np.arange(4000), np.zeros(4000, bool), n, term, tf, starts, sketches)
    assert all(len(b[0]) == 10 and d // 12 == q for q, b in enumerate(searcher.best) for d in b[2].tolist())
    assert searcher.scored < 0.05 * 4000 * len(queries)
