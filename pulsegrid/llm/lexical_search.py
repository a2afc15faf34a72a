"""Ranked lexical search with hashed max-sketches: upper bounds for every document and query, exact scores where they matter.

Queries are taken in blocks of bounded size; impacts of terms that no query of the block holds can't add to a
score, so a block's index has the block's terms. Three passes over the documents' rows, each without a shuffle of texts:

1. Terms are cut on bytes and looked up in the block's vocabulary: a row a document with its number of terms, and the
   block's terms with their occurrences. Document frequencies and lengths are summed from these rows.
2. A term's impact is its weight times its saturated frequency; a document's impacts fold into a sketch of ``DIM``
   numbers: each term has one of them by its hash, and the number is the largest impact there, rounded up to 16 bits.
3. A query's bound on a document is the sum of the numbers that its terms point at, for a group of documents and all queries one product of
   matrices. In descending order of the bounds documents are scored exactly, until no bound reaches the ``k``-th score
   so far. A task carries these scores from group to group and returns at most ``k`` rows a query; a window ranks them.

Cases: null and empty texts have no terms and count nowhere; a query without terms, or with terms that no document has,
has no rows. Equal scores rank by ascending id, null ids last. Every row of the documents is a document, and every row
of the queries a query, repeated ones too. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage
from pulsegrid.llm.token_files import slices_of

# What separates terms, and the constants of the score.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
#: Numbers in a sketch.
DIM = 256
#: Terms and queries that a block has at most, about (a longer query is a block of its own).
BLOCK_TERMS = 500_000
BLOCK_QUERIES = 1000
#: Bytes of text that are cut together (one text at least).
SLICE_BYTES = 1 << 20
#: Documents whose bounds are computed together, and documents that are scored together.
GROUP = 2048
CHUNK = 32


# ---- terms

def _byte_table() -> np.ndarray:
    """What a byte becomes in a term; 0 separates terms."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 0
    return table


BYTES = _byte_table()


def count_terms(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of terms; and text, term and occurrences for the terms in ``vocabulary``, by text and term."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = BYTES[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]]
    edges = offsets - offsets[0]
    inside = raw != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = edges[:-1][np.diff(edges) > 0]
    begins[starts] = inside[starts]
    kept = np.cumsum(inside)
    firsts = np.flatnonzero(begins)
    n_terms = np.diff(np.searchsorted(firsts, edges))
    bounds = np.append(kept[firsts] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(bounds), pa.py_buffer(raw[inside]))
    found = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), n_terms)
    own = found >= 0
    keys, tf = np.unique(doc[own] * len(vocabulary) + found[own], return_counts=True)
    return n_terms, keys // max(1, len(vocabulary)), keys % max(1, len(vocabulary)), tf


def _lists(values: np.ndarray, docs: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int32()))


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) for every document: its number of terms, and those of the vocabulary (by place) with their occurrences."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        for batch in batches:
            for lo, hi in slices_of(batch.column(1), SLICE_BYTES):
                n, doc, term, tf = count_terms(batch.column(1).slice(lo, hi - lo), known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), _lists(term, doc, hi - lo), _lists(tf, doc, hi - lo)],
                                                 names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


# ---- sketches

def impacts_of(weights: np.ndarray, n_docs: int, n_terms: int, n: np.ndarray, tf: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Scores that single terms (once in the query) add; ``n`` is the length of the term's document."""
    m = 100 - 75 + (75 * n * n_docs) // max(1, n_terms)
    return weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def coordinates(vocabulary: list[str], dim: int = DIM) -> np.ndarray:
    """The place in a sketch of each term."""
    return np.array([zlib.crc32(t.encode()) % dim for t in vocabulary], np.int64)


def unit_of(weights: np.ndarray) -> int:
    """What 1 in a sketch stands for: the largest possible impact has to fit in 16 bits."""
    return int(weights.max(initial=0)) * 1_000_000 // 65535 + 1


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column on end, and where each list's start (one more than lists)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def sketched(rows: DataFrame, vocabulary: list[str], weights: np.ndarray, n_docs: int, n_terms: int, dim: int = DIM) -> DataFrame:
    """``postings`` rows that have terms of the vocabulary, with their sketch: ``dim`` unsigned 16-bit numbers."""
    place, unit = coordinates(vocabulary, dim), unit_of(weights)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, starts = _flat(batch.column("terms"))
            tf, _ = _flat(batch.column("tfs"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            impact = impacts_of(weights, n_docs, n_terms, batch.column("n").to_numpy()[doc], tf, term)
            out = np.zeros((batch.num_rows, dim), np.uint16)
            np.maximum.at(out, (doc, place[term]), (-(-impact // unit)).astype(np.uint16))
            blobs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.arange(batch.num_rows + 1, dtype=np.int32) * (2 * dim)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*batch.columns, blobs], names=[*batch.schema.names, "sketch"])

    return rows.where(F.size("terms") > 0).mapInArrow(sketch, "doc_id bigint, n bigint, terms array<int>, tfs array<int>, sketch binary")


# ---- search

class Searcher:
    """The best ``k`` documents of each query among those shown so far."""

    def __init__(self, queries: list[dict[int, int]], vocabulary: list[str], weights: np.ndarray, n_docs: int, n_terms: int, k: int = TOP, dim: int = DIM):
        self.terms = [np.fromiter(q, np.int64, len(q)) for q in queries]
        self.times = [np.fromiter(q.values(), np.int64, len(q)) for q in queries]
        self.weights, self.n_docs, self.n_terms, self.k, self.unit = weights, n_docs, n_terms, k, unit_of(weights)
        place = coordinates(vocabulary, dim)
        self.points = np.zeros((dim, len(queries)))
        for q, (terms, times) in enumerate(zip(self.terms, self.times, strict=True)):
            np.add.at(self.points[:, q], place[terms], times)
        self.per_query = np.zeros(len(vocabulary), np.int64)
        nothing = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        self.best = [nothing] * len(queries)  # score, null id, id
        self.least = np.ones(len(queries))  # the score that a document has to reach
        self.scored = 0

    def show(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, term: np.ndarray, tf: np.ndarray, starts: np.ndarray, sketches: np.ndarray) -> None:
        """Takes a group of documents."""
        impact = impacts_of(self.weights, self.n_docs, self.n_terms, np.repeat(n, np.diff(starts)), tf, term)
        bounds = (sketches.astype(np.float64) @ self.points) * (self.unit * (1 + 1e-12))  # never under the score by rounding
        for q in np.flatnonzero((bounds >= self.least).any(axis=0)):
            bound = bounds[:, q]
            left = np.flatnonzero(bound >= self.least[q])
            left = left[np.argsort(-bound[left], kind="stable")]
            self.per_query[self.terms[q]] = self.times[q]
            for lo in range(0, len(left), CHUNK):
                part = left[lo:lo + CHUNK]
                part = part[bound[part] >= self.least[q]]
                if not len(part):
                    break
                sizes = starts[part + 1] - starts[part]
                at = np.repeat(starts[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                score = np.zeros(len(part), np.int64)
                np.add.at(score, np.repeat(np.arange(len(part)), sizes), self.per_query[term[at]] * impact[at])
                self._take(q, score, null[part], ids[part])
                self.scored += len(part)
            self.per_query[self.terms[q]] = 0

    def _take(self, q: int, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        s, u, d = (np.concatenate(x) for x in zip(self.best[q], (score, null, ids), strict=True))
        order = np.lexsort((d, u, -s))[:self.k]
        order = order[s[order] > 0]
        self.best[q] = s[order], u[order], d[order]
        if len(order) == self.k:
            self.least[q] = s[order[-1]]


def _search(make, dim: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                ids = part.column("doc_id")
                term, starts = _flat(part.column("terms"))
                tf, _ = _flat(part.column("tfs"))
                sketches = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(part.num_rows, dim)
                searcher.show(pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("n").to_numpy(), term, tf, starts, sketches)
        for q, (score, null, ids) in enumerate(searcher.best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q), pa.int32()), pa.array(ids, mask=null), pa.array(score)], names=["query", "doc_id", "score"])
    return search


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP, dim: int = DIM, block_terms: int = BLOCK_TERMS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The best ``k`` of ``docs`` (doc_id, text) for each row of ``queries`` (item_id, text): (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    terms = F.array_remove(F.split(F.translate("text", UPPER, LOWER), BETWEEN), "")
    asked = stage(queries.select("item_id", F.coalesce(terms, F.array().cast("array<string>")).alias("terms")).where(F.size("terms") > 0), "queries")
    n_asked, n_words = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_blocks = max(-(-n_asked // block_queries), -(-n_words // block_terms))
    out = spark.createDataFrame([], f"item_id {queries.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    for block in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n_blocks)) == block).collect() if n_blocks > 1 else asked.collect()
        vocabulary = sorted({t for row in own for t in row["terms"]})
        if own:
            out = out.unionByName(_rank_block(docs, [r["item_id"] for r in own], [r["terms"] for r in own], vocabulary, queries.schema["item_id"].dataType.simpleString(), k, dim))
    return out


def _rank_block(docs: DataFrame, items: list, texts: list[list[str]], vocabulary: list[str], item_type: str, k: int, dim: int) -> DataFrame:
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(vocabulary)}
    counted = []
    for words in texts:
        times: dict[int, int] = {}
        for w in words:
            times[number[w]] = times.get(number[w], 0) + 1
        counted.append(times)
    rows = stage(postings(docs, vocabulary), "postings")
    n_docs, n_terms = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():  # a row a term of the block
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    index = stage(sketched(rows, vocabulary, weights, n_docs, n_terms, dim), "sketches")
    found = index.mapInArrow(_search(lambda: Searcher(counted, vocabulary, weights, n_docs, n_terms, k, dim), dim), "query int, doc_id bigint, score bigint")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = stage(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
    names = spark.createDataFrame(list(enumerate(items)), f"query int, item_id {item_type}")
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rank(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP13_SQL = r"""
WITH toks AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
lengths AS (SELECT doc_id, d, len(ts) AS n FROM toks WHERE len(ts) > 0),
stats AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
tfs AS (SELECT d, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, unnest(ts) AS t FROM toks) GROUP BY d, t),
dfs AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, stats GROUP BY t),
asked AS (
  SELECT item_id, i, t, count(*) AS times FROM (
    SELECT item_id, row_number() OVER () AS i,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark) GROUP BY item_id, i, t),
scores AS (
  SELECT a.item_id, a.i, l.doc_id, l.d,
         CAST(sum(a.times * f.w * ((1000000000 * x.tf) // (1000 * x.tf + 8 * (100 - 75 + (75 * l.n * s.big_n) // s.big_l)))) AS BIGINT) AS score
  FROM asked a JOIN tfs x ON x.t = a.t JOIN dfs f ON f.t = a.t JOIN lengths l ON l.d = x.d CROSS JOIN stats s
  GROUP BY a.item_id, a.i, l.doc_id, l.d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, d) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
