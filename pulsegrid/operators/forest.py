"""Random forests of all folds of all labellings, grown together, level by level.

A model is a tree of a fold of a labelling. Features are cut into quantile bins once. On a level every task routes its rows
down all trees so far and counts, for each open node and each of the features drawn for it, the rows by bin and class; the
counts of a tree are added up in one shuffle keyed by the tree, and its nodes are split by the largest fall of the
Gini impurity. Rows weigh as often as a Poisson draw says (the bootstrap of a distributed forest). Trees are tables
of a fixed shape: ``depth`` bounds their nodes. Votes are averaged class shares of leaves.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.labellings import Block, Labellings
from pulsegrid.session import cut_lineage

#: Bytes of trees that are sent to every task at a time.
TREE_BYTES = 128_000_000
#: Blocks whose counts a task adds up before they leave it.
TOGETHER = 8


def bin_edges(df: DataFrame, x: str, d: int, bins: int) -> np.ndarray:
    """Inner quantile cuts of every feature, (d, bins - 1); repeated cuts leave bins empty."""
    names = [f"_{i}" for i in range(d)]
    cuts = df.select(*[F.col(x)[i].cast("double").alias(c) for i, c in enumerate(names)]).approxQuantile(names, [i / bins for i in range(1, bins)], 0.25 / bins)
    return np.array(cuts, np.float64)


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)


@dataclass
class Shape:
    """What all trees share."""

    classes: int
    folds: int
    trees: int
    features: int
    drawn: int
    bins: int
    depth: int
    seed: int

    @property
    def nodes(self) -> int:
        return 2 ** (self.depth + 1) - 1

    def features_of(self, p: int, k: int, t: int, level: int) -> np.ndarray:
        """The features drawn for the nodes of a level: (nodes, drawn)."""
        rng = np.random.default_rng([self.seed, p, k, t, level])
        return np.argsort(rng.random((2 ** level, self.features)), axis=1)[:, :self.drawn]

    def weights_of(self, p: int, b: int, n: int) -> np.ndarray:
        """How often each row counts in each tree number: (trees, n)."""
        return np.random.default_rng([self.seed, p, b, 7]).poisson(1.0, (self.trees, n)).astype(np.int64)


def routed(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Each row's node of a tree after at most ``levels`` steps; nodes are numbered as in a heap."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        f = feature[node]
        right = x[rows, np.maximum(f, 0)] > cut[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them, deflated: most are small."""
    return zlib.compress(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes(), 1)


def _unpacked(data: bytes, cells: int) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, f"<u{len(raw) // cells}")


def _histograms(lab: Labellings, shape: Shape, edges: np.ndarray, known: dict, level: int, first: int, stop: int) -> DataFrame:
    """(p, k, t, n): counts of one level of every tree, added up over the blocks that a task has of the same labellings."""
    shared = lab.frame.sparkSession.sparkContext.broadcast((edges, known))

    def work(blocks: Iterator[Block]) -> Iterator[pd.DataFrame]:
        cuts, trees = shared.value
        low, cells = 2 ** level - 1, 2 ** level * shape.drawn * shape.bins * shape.classes
        for (begin, end, _), several in itertools.groupby(blocks, key=lambda b: (b.first, b.stop, b.b // TOGETHER)):
            held = [(block, binned(block.x, cuts)) for block in several]
            for p in range(max(begin, first), min(end, stop)):
                views = []
                for block, x in held:
                    cell = block.cells(p)
                    views.append((x, cell // shape.folds, cell % shape.folds, shape.weights_of(p, block.b, len(x))))
                out = {"p": [], "k": [], "t": [], "n": []}
                for k in range(shape.folds):
                    for t in range(shape.trees):
                        counts = np.zeros(cells, np.int64)
                        drawn_of = shape.features_of(p, k, t, level)
                        for x, code, fold, weight in views:
                            node = routed(x, *trees[p, k, t], level) if level else np.zeros(len(x), np.int64)
                            mine = np.flatnonzero((fold != k) & (weight[t] > 0) & (node >= low))
                            if not len(mine):
                                continue
                            local = node[mine] - low
                            at = (((local[:, None] * shape.drawn + np.arange(shape.drawn)) * shape.bins + x[mine[:, None], drawn_of[local]]) * shape.classes + code[mine, None])
                            counts += np.bincount(at.ravel(), np.repeat(weight[t][mine], shape.drawn), cells).astype(np.int64)
                        if counts.any():
                            for name, v in zip(out, (p, k, t, _packed(counts)), strict=True):
                                out[name].append(v)
                if out["p"]:
                    yield pd.DataFrame(out)
    return lab.run(work, "p int, k int, t int, n binary")


def _best_splits(counts: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For counts (nodes, features, bins, classes): feature (-1: none), cut bin, and class counts of both children (nodes, 2, classes)."""
    left = counts.cumsum(axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = (left ** 2).sum(axis=3) / left.sum(axis=3) + (right ** 2).sum(axis=3) / right.sum(axis=3)
    whole = (total[:, 0, 0] ** 2).sum(axis=1) / np.maximum(total[:, 0, 0].sum(axis=1), 1)
    gain = np.where(np.isnan(pure), -np.inf, pure)[:, :, :-1] - whole[:, None, None]
    flat = gain.reshape(len(counts), -1)
    at = flat.argmax(axis=1)
    rows = np.arange(len(counts))
    j, b = at // gain.shape[2], at % gain.shape[2]
    ok = flat[rows, at] > 1e-9
    children = np.stack([left[rows, j, b], right[rows, j, b]], axis=1)
    return np.where(ok, drawn[rows, j], -1), b, children


def _splits(parts: DataFrame, shape: Shape, level: int) -> DataFrame:
    """The counts of each tree added up, and its nodes of this level split: (p, k, t, feature, cut, children)."""
    cells = 2 ** level * shape.drawn * shape.bins * shape.classes

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counts, out = None, None, []

        def close():
            p, k, t = key
            feature, cut, children = _best_splits(counts.reshape(2 ** level, shape.drawn, shape.bins, shape.classes), shape.features_of(p, k, t, level))
            out.append((p, k, t, feature.astype("<i2").tobytes(), cut.astype("<i2").tobytes(), children.astype("<f8").tobytes()))
        for pdf in batches:
            for p, k, t, n in zip(pdf["p"], pdf["k"], pdf["t"], pdf["n"], strict=True):
                if (p, k, t) != key:
                    if key is not None:
                        close()
                    key, counts = (p, k, t), np.zeros(cells)
                counts += _unpacked(n, cells)
            if len(out) > 500:
                yield pd.DataFrame(out, columns=["p", "k", "t", "feature", "cut", "children"])
                out.clear()
        if key is not None:
            close()
        if out:
            yield pd.DataFrame(out, columns=["p", "k", "t", "feature", "cut", "children"])
    dealt = parts.repartition("p", "k", "t").sortWithinPartitions("p", "k", "t")
    return dealt.mapInPandas(task, "p int, k int, t int, feature binary, cut binary, children binary")


def _votes(lab: Labellings, shape: Shape, edges: np.ndarray, trees: dict, shares: dict, first: int, stop: int) -> DataFrame:
    """(p, fold, code, hits, seen) of the rows left out of each fold's forest."""
    shared = lab.frame.sparkSession.sparkContext.broadcast((edges, trees, shares))

    def work(blocks: Iterator[Block]) -> Iterator[pd.DataFrame]:
        cuts, grown, leaves = shared.value
        for block in blocks:
            x, out = binned(block.x, cuts), []
            for p in range(max(block.first, first), min(block.stop, stop)):
                cells = block.cells(p)
                code, fold = cells // shape.folds, cells % shape.folds
                for k in range(shape.folds):
                    mine = np.flatnonzero(fold == k)
                    if not len(mine):
                        continue
                    part, votes = x[mine], np.zeros((len(mine), shape.classes))
                    for t in range(shape.trees):
                        if (p, k, t) in grown:
                            votes += leaves[p, k, t][routed(part, *grown[p, k, t], shape.depth)]
                    hit = votes.argmax(axis=1) == code[mine]
                    seen = np.bincount(code[mine], minlength=shape.classes)
                    hits = np.bincount(code[mine], hit, shape.classes)
                    out += [(p, k, c, float(hits[c]), float(seen[c])) for c in np.flatnonzero(seen).tolist()]
            if out:
                yield pd.DataFrame(out, columns=["p", "fold", "code", "hits", "seen"])
    return lab.run(work, "p int, fold int, code int, hits double, seen double")


def forest_counts(lab: Labellings, edges: np.ndarray, trees: int = 60, depth: int = 5, bins: int = 32, seed: int = 0) -> DataFrame:
    """(p, fold, code, hits, seen) by forests of ``trees`` trees, for every fold of every labelling."""
    shape = Shape(len(lab.sizes), lab.folds, trees, lab.d, math.ceil(math.sqrt(lab.d)), bins, depth, seed)
    per_labelling = shape.folds * trees * shape.nodes * (8 * shape.classes + 4)
    step = max(1, TREE_BYTES // per_labelling)
    out = None
    for first in range(0, lab.count, step):
        stop = min(lab.count, first + step)
        grown: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        shares: dict[tuple, np.ndarray] = {}
        for level in range(depth):
            low = 2 ** level - 1
            splits = cut_lineage(_splits(_histograms(lab, shape, edges, grown, level, first, stop), shape, level))
            for r in splits.toLocalIterator():  # the trees of this range of labellings: bounded by TREE_BYTES
                key = (r["p"], r["k"], r["t"])
                if key not in grown:
                    grown[key] = np.full(shape.nodes, -1, np.int16), np.zeros(shape.nodes, np.int16)
                    shares[key] = np.zeros((shape.nodes, shape.classes), np.float32)
                feature = np.frombuffer(r["feature"], "<i2")
                children = np.frombuffer(r["children"], "<f8").reshape(-1, 2, shape.classes)
                grown[key][0][low:2 * low + 1] = feature
                grown[key][1][low:2 * low + 1] = np.frombuffer(r["cut"], "<i2")
                if not level:  # of a tree that can't split at all
                    shares[key][0] = children[0].sum(axis=0)
                split = np.flatnonzero(feature >= 0)
                below = 2 * (split + low) + 1
                shares[key][below], shares[key][below + 1] = children[split, 0], children[split, 1]
        leaves = {key: v / np.maximum(v.sum(axis=1, keepdims=True), 1) for key, v in shares.items()}
        part = _votes(lab, shape, edges, grown, leaves, first, stop)
        out = part if out is None else out.unionByName(part)
    return out
