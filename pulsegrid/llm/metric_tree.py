"""Exact top-k by integer inner product: an M-tree of pages, searched best first.

Vectors become integers, floor(256 x). To search for large inner products by distance, every vector gets one more
component that brings its length to the longest one's, M; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, a metric distance.

Tree: at most ``PIVOTS`` routing vectors (the first by a hash) are the upper level. Every vector belongs to its nearest
one; sorted by (pivot, distance) over range partitions, each run of at most ``PAGE`` of a pivot's vectors is a leaf page. A
page keeps its own routing vector (the member nearest its mean), its covering radius, the routing vector's distance
to the pivot, and each entry's distance to the routing vector. All vectors are indexed; a pivot with a third of
them has many pages.

Search: pages are dealt to groups, queries to blocks, and a task has one block and one group. For each query a page's
least possible distance follows from the pivot's distance by the triangle inequality, without computing the distance to
the page's routing vector; that one is computed if the page may still hold a better score, and entries whose stored
distance rules them out are skipped. Pages are visited by their bound, best first, until no page of the group can better the
k-th score. Bounds have a slack that covers rounding, and scores are computed as integers, so the result is exact.

Cases: vectors that are null or hold null, NaN or infinite components, and rows without an id take no part. Of vectors of
different lengths the shorter counts as filled up with zeros. A query leaves out every row with its own id; rows that
repeat a query's id with another vector are queries of their own. Ties go to the smaller id, then any. An empty table or no query gives no rows. Components
beyond 2^23 in size would need more than 53 bits in the sums and are refused with an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage

SCALE = 256
PIVOTS, PAGE = 64, 512
#: Pages in a group and queries in a block.
GROUP, BLOCK = 32, 512
LARGEST = 1 << 23


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def _matrix(arrays, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width))
    for i, a in enumerate(arrays):
        out[i, :len(a)] = a
    return out


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """With the component that brings each row to the longest length."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0.0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(d, 0.0))


PAGE_SCHEMA = "pivot int, rows int, parent double, radius double, center binary, ids binary, vectors binary, own binary"


def build(vectors: DataFrame, width: int, longest: float) -> tuple[DataFrame, np.ndarray]:
    """Leaf pages of (vec_id, v), and the pivots. ``own``: entries' distances to the page's routing vector."""
    chosen = vectors.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(PIVOTS).collect()
    pivots = _lifted(_matrix([r["v"] for r in chosen], width), longest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_lifted(_matrix(batch.column(1).to_pylist(), width), longest), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])],
                                                 ["vec_id", "v", "pivot", "far"])

    placed = stage(vectors.select("vec_id", "v").mapInArrow(place, "vec_id bigint, v array<bigint>, pivot int, far double"), "placed")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(n, "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")

    def page(pivot: int, ids: list[int], rows: list[list[int]]) -> tuple:
        x = _matrix(rows, width)
        lifted = _lifted(x, longest)
        center = lifted[_distances(lifted.mean(axis=0)[None, :], lifted)[0].argmin()]
        own = _distances(center[None, :], lifted)[0]
        return (pivot, len(ids), float(_distances(center[None, :], pivots[pivot][None, :])[0, 0]), float(own.max()), center.tobytes(),
                np.array(ids, np.int64).tobytes(), x.astype(np.int32).tobytes(), own.tobytes())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAGE_SCHEMA.split(", ")]
        pivot, ids, rows = None, [], []
        for batch in batches:
            out = []
            for i, v, p in zip(batch["vec_id"], batch["v"], batch["pivot"], strict=True):
                if ids and (p != pivot or len(ids) == PAGE):
                    out.append(page(pivot, ids, rows))
                    ids, rows = [], []
                pivot = int(p)
                ids.append(i)
                rows.append(v)
            yield pd.DataFrame(out, columns=names)
        if ids:
            yield pd.DataFrame([page(pivot, ids, rows)], columns=names)

    return stage(dealt.mapInPandas(cut, PAGE_SCHEMA), "pages"), pivots


class _Best:
    """The k best (score, id) of each query so far; missing ones have the least score."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.k = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), k

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the same ids, ascending, for some queries."""
        if scores.shape[1] > 4 * self.k:  # all that reach the k-th best score stay, ties included
            least = np.partition(scores, -self.k, axis=1)[:, -self.k].min()
            keep = (scores >= least).any(axis=0)
            scores, ids = scores[:, keep], ids[keep]
        s = np.hstack([self.scores[rows], scores])
        i = np.hstack([self.ids[rows], np.broadcast_to(ids, scores.shape)])
        order = np.lexsort((i, -s), axis=1)[:, :self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search_group(pages: list[dict], query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, longest: float, k: int) -> tuple[_Best, int]:
    """The best of a group's pages for a block of queries, and the number of scores computed."""
    width = queries.shape[1]
    lifted = np.hstack([queries, np.zeros((len(queries), 1))])
    norms = (queries * queries).sum(axis=1) + longest
    to_pivot = _distances(lifted, pivots)
    parents, radii = np.array([p["parent"] for p in pages]), np.array([p["radius"] for p in pages])
    bound = np.abs(to_pivot[:, [p["pivot"] for p in pages]] - parents) - radii
    order = np.argsort(bound, axis=1, kind="stable")
    best, computed = _Best(len(queries), k), 0
    slack = 1e-6 * np.sqrt(norms) + 1e-6

    def reach() -> np.ndarray:
        """The distance within which a score may still better or tie the k-th."""
        with np.errstate(invalid="ignore"):
            d = np.sqrt(np.maximum(norms - 2.0 * best.scores[:, -1], 0.0))
        return np.where(np.isfinite(best.scores[:, -1]), d + slack + 0.5 / np.maximum(d, 1.0), np.inf)

    data: dict[int, tuple[np.ndarray, ...]] = {}
    for turn in range(len(pages)):
        limit = reach()
        at = order[:, turn]
        going = bound[np.arange(len(queries)), at] <= limit
        if not going.any():
            break
        for p in np.unique(at[going]):
            if p not in data:
                page = pages[p]
                ids = np.frombuffer(page["ids"], np.int64)
                by_id = np.argsort(ids, kind="stable")
                data[p] = (ids[by_id], np.frombuffer(page["vectors"], np.int32).reshape(-1, width)[by_id].astype(float),
                           np.frombuffer(page["own"], float)[by_id], np.frombuffer(page["center"], float))
            ids, x, own, center = data[p]
            rows = np.flatnonzero(going & (at == p))
            to_center = _distances(lifted[rows], center[None, :])[:, 0]
            near = to_center - radii[p] <= limit[rows]
            rows, to_center = rows[near], to_center[near]
            if not len(rows):
                continue
            entry = (np.abs(to_center[:, None] - own[None, :]) <= limit[rows][:, None]).any(axis=0)
            scores = queries[rows] @ x[entry].T
            computed += scores.size
            scores[query_ids[rows][:, None] == ids[entry][None, :]] = -np.inf
            best.offer(rows, scores, ids[entry])
    return best, computed


FOUND = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def top_k(table: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each query row of ``table``."""
    spark = table.sparkSession
    vectors = table.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), integers(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    vectors = stage(vectors, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    width, longest, largest = vectors.agg(F.max(F.size("v")), F.max(norm), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if width is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if (largest or 0) >= LARGEST:
        raise ValueError(f"components of {largest} / {SCALE} are too large for exact sums")
    pages, pivots = build(vectors, width, longest)
    queries = vectors.where("asks").select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_key"), "v").distinct()
    n_pages, n_queries = pages.count(), queries.count()
    groups, blocks = max(1, -(-n_pages // GROUP)), max(1, -(-n_queries // BLOCK))

    # every block of queries meets every group of pages
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id", "query_key", F.lit(1)), F.lit(blocks))).withColumn(
        "group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    dealt = pages.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def run(key, own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in FOUND.split(", ")]
        if own.empty or asks.empty:
            return pd.DataFrame([], columns=columns)
        ids = asks["query_id"].to_numpy(np.int64)
        best, _ = search_group(own.to_dict("records"), ids, _matrix(list(asks["v"]), width), pivots, longest, k)
        n = len(ids)
        out = pd.DataFrame({"query_id": np.repeat(ids, k), "query_key": np.repeat(asks["query_key"].to_numpy(np.int64), k),
                            "vec_id": best.ids.reshape(n * k), "score": best.scores.reshape(n * k)})
        out = out[np.isfinite(out["score"])]
        return out.assign(score=out["score"].astype(np.int64))

    found = dealt.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


OP10_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
