"""Cross-validated linear classifiers with permutation p-values, and random forests.

LDA and PLS-DA need only class sums and cross products, so one pass over the rows fits every fold of every
label permutation, and a second pass scores them. Models are k·(P+1) small matrices, fitted in parallel. Labels and folds of
a permutation are made in the tasks, from quotas per block of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.forest import TOGETHER, bin_edges, forest_counts
from pulsegrid.operators.labellings import Labellings, labellings
from pulsegrid.operators.permutation import class_table, permutation_p
from pulsegrid.session import cut_lineage

MODEL_BYTES = 64_000_000


def lda(n, sums, gram):
    """Coefficients (classes × (d+1)) of the linear discriminant from class counts, class sums and X'X."""
    means = sums / np.maximum(n, 1)[:, None]
    within = (gram - (sums.T * (1 / np.maximum(n, 1))) @ sums) / max(n.sum() - (n > 0).sum(), 1)
    w = means @ np.linalg.pinv(within, hermitian=True)
    bias = np.where(n > 0, np.log(np.maximum(n, 1e-300) / n.sum()) - 0.5 * (w * means).sum(axis=1), -np.inf)
    return np.hstack([w, bias[:, None]])


def pls(n, sums, gram, components=2):
    """PLS-DA: regression of one-hot classes on standardised features, from the same sums."""
    total, d = n.sum(), sums.shape[1]
    mean = sums.sum(axis=0) / total
    cov = gram - total * np.outer(mean, mean)
    sx = np.sqrt(np.diag(cov) / (total - 1))
    sx[sx == 0] = 1.0
    share = n / total
    sy = np.sqrt(total * share * (1 - share) / (total - 1))
    sy[sy == 0] = 1.0
    xx, xy = cov / np.outer(sx, sx), (sums - np.outer(n, mean)).T / sx[:, None] / sy[None, :]
    rot, load, weights = [], [], []
    for _ in range(max(1, min(components, d, len(n)))):
        u, s, _ = np.linalg.svd(xy, full_matrices=False)
        if s[0] < 1e-12:
            break
        r = u[:, 0].copy()
        for q, p in zip(rot, load):
            r -= (p @ u[:, 0]) * q
        size = r @ xx @ r
        p, y = xx @ r / size, xy.T @ r / size
        xy = xy - size * np.outer(p, y)
        rot.append(r), load.append(p), weights.append(y)
    b = (np.array(rot).T @ np.array(weights)) * sy[None, :] / sx[:, None] if rot else np.zeros((d, len(n)))
    return np.hstack([b.T, (share - mean @ b)[:, None]])


def _pass_sums(lab: Labellings) -> DataFrame:
    """Class counts, class sums and X'X of every fold of every labelling; a task adds up its blocks."""
    folds, classes, d = lab.folds, len(lab.sizes), lab.d

    def work(blocks):
        acc: dict[int, tuple] = {}
        for block in blocks:
            for p in range(block.first, block.stop):
                n, s, g = acc.setdefault(p, (np.zeros((folds, classes)), np.zeros((folds, classes, d)), np.zeros((folds, d, d))))
                cells = block.cells(p)
                hot = (cells[:, None] == np.arange(classes * folds)).astype(float)
                n += hot.sum(axis=0).reshape(classes, folds).T
                s += (hot.T @ block.x).reshape(classes, folds, d).swapaxes(0, 1)
                for k in range(folds):
                    part = block.x[cells % folds == k]
                    g[k] += part.T @ part
        for p, (n, s, g) in acc.items():
            yield pd.DataFrame({"p": [p], "n": [n.ravel()], "s": [s.ravel()], "g": [g.ravel()]})
    return lab.run(work, "p int, n array<double>, s array<double>, g array<double>")


def fold_labellings(df: DataFrame, id_: str, label: str, x: str, permutations: int, max_folds: int, seed: int, min_class: int,
                    together: int = 1) -> Labellings | None:
    """The labellings a classifier is judged by; as many folds as the smallest class has rows. None when a class is too small."""
    sizes = [r["size"] for r in class_table(df, label).collect()]
    if len(sizes) < 2 or min(sizes) < max(2, min_class):
        return None
    return labellings(df, id_, label, x, permutations, int(min(max_folds, min(sizes))), seed, together=together)


def cell_counts(lab: Labellings) -> DataFrame:
    """(p, fold, code, n): rows of each class and fold under every labelling, by block."""
    folds, cells_in_all = lab.folds, lab.folds * len(lab.sizes)

    def work(blocks):
        for block in blocks:
            for p in range(block.first, block.stop):
                n = np.bincount(block.cells(p), minlength=cells_in_all)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"p": p, "fold": at % folds, "code": at // folds, "n": n[at]})
    return lab.run(work, "p int, fold int, code int, n long")


def judged(lab: Labellings, counts: DataFrame) -> DataFrame:
    """One row: n, classes, balanced accuracy, chance, null mean and permutation p of (p, fold, code, hits, seen)."""
    acc = balanced_accuracy(counts.groupBy("p", "fold", "code").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen")))
    return permutation_p(acc, "acc").select(F.lit(sum(lab.sizes)).alias("n"), F.lit(len(lab.sizes)).alias("classes"), "acc",
                                            F.lit(1.0 / len(lab.sizes)).alias("chance"), "null_mean", "permutations", "p_value")


def linear_counts(lab: Labellings, model: str) -> DataFrame:
    """(p, fold, code, hits, seen) by linear models fitted on the other folds of every labelling."""
    folds, classes, d = lab.folds, len(lab.sizes), lab.d
    fit = lda if model == "lda" else pls

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        add = lambda c, *shape: np.sum(np.stack(pdf[c].to_numpy()), axis=0).reshape(shape)
        n, s, g = add("n", folds, classes), add("s", folds, classes, d), add("g", folds, d, d)
        out = [fit(n.sum(0) - n[k], s.sum(0) - s[k], g.sum(0) - g[k]).ravel() for k in range(folds)]
        return pd.DataFrame({"p": pdf["p"].iloc[0], "fold": range(folds), "w": out})
    models = cut_lineage(_pass_sums(lab).groupBy("p").applyInPandas(solve, "p int, fold int, w array<double>"))
    group = max(1, MODEL_BYTES // (8 * classes * (d + 1) * folds))
    counts = None
    for start in range(0, lab.count, group):
        stop = min(start + group, lab.count)
        table = np.zeros((stop - start, folds, classes, d + 1))
        for r in models.where((F.col("p") >= start) & (F.col("p") < stop)).toLocalIterator():
            table[r["p"] - start, r["fold"]] = np.reshape(r["w"], (classes, d + 1))
        shared = lab.frame.sparkSession.sparkContext.broadcast(table)

        def work(blocks, shared=shared, start=start, stop=stop):
            w = shared.value
            hits, seen = np.zeros(w.shape[:3]), np.zeros(w.shape[:3])
            for block in blocks:
                wide = np.hstack([block.x, np.ones((len(block.x), 1))])
                for p in range(max(start, block.first), min(stop, block.stop)):
                    cells = block.cells(p)
                    code, fold = cells // folds, cells % folds
                    guess = np.empty(len(cells), int)
                    for k in range(folds):
                        m = fold == k
                        guess[m] = (wide[m] @ w[p - start, k].T).argmax(axis=1) if m.any() else 0
                    np.add.at(seen[p - start], (fold, code), 1)
                    np.add.at(hits[p - start], (fold, code), guess == code)
            p, k, c = np.nonzero(seen)
            if len(p):
                yield pd.DataFrame({"p": (p + start).astype("int32"), "fold": k.astype("int32"), "code": c.astype("int32"),
                                    "hits": hits[p, k, c], "seen": seen[p, k, c]})
        part = lab.run(work, "p int, fold int, code int, hits double, seen double")
        counts = part if counts is None else counts.unionByName(part)
    return counts


def cross_validated(df: DataFrame, id_: str, label: str, x: str = "x", model: str = "lda", permutations: int = 200, max_folds: int = 5,
                    seed: int = 0, min_class: int = 2) -> DataFrame | None:
    """One row: n, classes, balanced accuracy, chance, null mean and permutation p. None when a class is too small.

    ``model`` is "lda", "pls" or "forest".
    """
    if model == "forest":
        return forest(df, id_, label, x, permutations=permutations, max_folds=max_folds, seed=seed, min_class=min_class)
    lab = fold_labellings(df, id_, label, x, permutations, max_folds, seed, min_class)
    return None if lab is None else judged(lab, linear_counts(lab, model))


def task_list(df: DataFrame, id_: str, group: str, tasks: dict[str, tuple[dict, str]], x: str = "x", permutations: int = 200) -> DataFrame:
    """A row for each task: a labelling of ``group`` values (those it lacks take no part) and a model."""
    out = None
    for name, (labels, model) in tasks.items():
        pairs = [F.lit(v) for item in labels.items() for v in item]
        found = cross_validated(df.withColumn("_y", F.create_map(*pairs)[F.col(group)]), id_, "_y", x, model, permutations)
        if found is None:
            none = F.lit(None).cast("double")
            found = df.sparkSession.range(1).select(*[none.cast("int").alias(c) for c in ("n", "classes")], *[none.alias(c) for c in ("acc", "chance", "null_mean")],
                                                    none.cast("bigint").alias("permutations"), none.alias("p_value"))
        found = found.select(F.lit(name).alias("task"), F.lit(model).alias("model"), "*",
                             F.when(F.col("p_value") < 0.05, "SIGNIFICANT").when(F.col("p_value").isNotNull(), "at chance").otherwise("too few per class").alias("verdict"))
        out = found if out is None else out.unionByName(found)
    return out


def balanced_accuracy(counts: DataFrame) -> DataFrame:
    """(p, acc): mean recall over classes, averaged over folds."""
    per_fold = counts.groupBy("p", "fold").agg(F.avg(F.col("hits") / F.col("seen")).alias("_a"))
    return per_fold.groupBy("p").agg(F.avg("_a").alias("acc"))


def forest(df: DataFrame, id_: str, label: str, x: str = "x", trees: int = 60, permutations: int = 0, max_folds: int = 5, seed: int = 0,
           min_class: int = 2, depth: int = 5, bins: int = 32) -> DataFrame | None:
    """One row as ``cross_validated``, by random forests; all trees of all folds and labellings grow together."""
    lab = fold_labellings(df, id_, label, x, permutations, max_folds, seed, min_class, TOGETHER)
    if lab is None:
        return None
    return judged(lab, forest_counts(lab, bin_edges(df.where(F.col(label).isNotNull()), x, lab.d, bins), trees, depth, bins, seed))
