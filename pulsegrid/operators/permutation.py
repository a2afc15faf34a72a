"""Label permutations, stratified folds and permutation tests.

A permutation orders rows by a hash of (id, permutation) and deals the class labels along that order, so class
sizes are kept exactly and the draw does not depend on partitioning. Cross-validated fits carry the labels of all
permutations as one short array per row; statistics that need only sums by class draw class quotas per block instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pulsegrid.operators.ordered import attach_one_row, positions
from pulsegrid.session import cut_lineage

#: Numbers of a block of rows that a task holds at a time.
BLOCK_CELLS = 1 << 22


def class_table(df: DataFrame, label: str) -> DataFrame:
    """Classes in label order with size, code from 0 and the rows before them (a handful of rows)."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("size"))
    order = W.orderBy(label)
    return sizes.withColumns({"code": F.row_number().over(order) - 1, "before": F.sum("size").over(order) - F.col("size")})


def permutation_plan(df: DataFrame, id_: str, label: str, permutations: int, folds: int = 1, seed: int = 0) -> DataFrame:
    """(id, codes[0..P], folds[0..P]): entry 0 is the true labelling; folds are stratified per entry."""
    classes = class_table(df, label)
    coded = df.where(F.col(label).isNotNull()).select(id_, label).join(F.broadcast(classes), label)
    rows = coded.select(id_, "code", "before", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("_p"))
    rows = rows.withColumn("_h", F.xxhash64(F.col(id_), F.col("_p"), F.lit(seed)))
    # the true labelling is ordered inside its classes, a permutation over all rows
    rows = rows.withColumn("_g", F.when(F.col("_p") == 0, F.col("code")).otherwise(-1))
    placed = positions(rows, ["_p", "_g"], "_h", [id_], "_r", block=F.shiftright("_h", 52))
    spans = classes.agg(F.array_sort(F.collect_list(F.struct("before", "size", "code"))).alias("_spans"))
    placed = attach_one_row(placed, spans)
    at = F.when(F.col("_p") == 0, F.col("before") + F.col("_r") - 1).otherwise(F.col("_r") - 1)
    placed = placed.withColumn("_at", at).withColumn("_span", F.filter(
        "_spans", lambda s: (F.col("_at") >= s["before"]) & (F.col("_at") < s["before"] + s["size"]))[0])
    entry = F.struct("_p", F.col("_span.code").alias("c"), ((F.col("_at") - F.col("_span.before")) % folds).cast("int").alias("f"))
    plan = placed.groupBy(id_).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return plan.select(id_, F.transform("_e", lambda e: e["c"]).alias("codes"), F.transform("_e", lambda e: e["f"]).alias("folds"))


def permuted_sums(df: DataFrame, id_: str, label: str, x: str = "x", permutations: int = 0, seed: int = 0) -> DataFrame:
    """(p, code, n, squares, total): sizes, summed squared norms and total vectors of every labelling; p = 0 is the true one.

    Rows are dealt to blocks of about ``BLOCK_CELLS`` numbers by a hash of the id and shuffled once. How many rows of each
    class a block gets under a permutation is drawn from the exact multivariate hypergeometric law, walking the blocks; inside
    a block the labels are then shuffled. That is a uniform permutation of the labels, without a row per (row, permutation).
    Draws depend on seed, ids and block count only. Rows without label or vector take no part. At most 10^9 rows.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull() & F.col(x).isNotNull())
    classes = rows.groupBy(label).agg(F.count("*").alias("n"), F.max(F.size(x)).alias("d")).orderBy(label).collect()
    sizes = [r["n"] for r in classes]
    k, n_blocks = len(sizes), max(1, -(-sum(sizes) * max((r["d"] for r in classes), default=1) // BLOCK_CELLS))
    code = F.array_position(F.array(*[F.lit(r[0]) for r in classes]), F.col(label)) - 1 if k else F.lit(0)
    dealt = rows.select(F.pmod(F.xxhash64(id_), F.lit(n_blocks)).alias("b"), F.xxhash64(id_, x).alias("h"), code.cast("int").alias("code"),
                        F.col(x).cast("array<double>").alias("x"))
    held = dealt.groupBy("b").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("blocks"))

    def quotas(batches):
        for pdf in batches:
            for p, blocks in zip(pdf["p"], pdf["blocks"], strict=True):
                rng, left, out = np.random.default_rng([seed, int(p)]), np.array(sizes, np.int64), []
                for block in blocks:
                    out.append(rng.multivariate_hypergeometric(left, int(block["n"])))
                    left = left - out[-1]
                if out:
                    yield pd.DataFrame({"b": [block["b"] for block in blocks], "p": int(p), "q": out})
    ps = attach_one_row(spark.range(1, permutations + 1).select(F.col("id").cast("int").alias("p")), held)
    drawn = ps.mapInPandas(quotas, "b long, p int, q array<long>")

    def sums(key, mine: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"p": [], "code": [], "v": []}, dtype=object)
        mine, quota = mine.sort_values("h", kind="stable"), quota.sort_values("p")
        m = np.stack(mine["x"].to_numpy())
        m = np.hstack([np.ones((len(m), 1)), (m ** 2).sum(axis=1, keepdims=True), m])
        rng, step = np.random.default_rng([seed, 0, int(key[0])]), max(1, BLOCK_CELLS // (k * len(m)))
        parts = [_sums_by_code(mine["code"].to_numpy()[None, :], k, m)]
        for lo in range(0, len(quota), step):
            q = np.stack(quota["q"].iloc[lo:lo + step].to_numpy())
            labels = np.repeat(np.tile(np.arange(k), len(q)), q.ravel()).reshape(len(q), len(m))
            parts.append(_sums_by_code(rng.permuted(labels, axis=1), k, m))
        v = np.concatenate(parts)
        return pd.DataFrame({"p": np.repeat(np.concatenate([[0], quota["p"].to_numpy()]), k).astype("int32"),
                             "code": np.tile(np.arange(k), len(v) // k).astype("int32"), "v": list(v)})
    parts = dealt.groupBy("b").cogroup(drawn.groupBy("b")).applyInPandas(sums, "p int, code int, v array<double>")
    g = parts.groupBy("p", "code").agg(Summarizer.metrics("sum").summary(array_to_vector("v")).alias("s"))
    v = vector_to_array("s.sum")
    return g.select("p", "code", v[0].alias("n"), v[1].alias("squares"), F.slice(v, F.lit(3), F.size(v) - 2).alias("total")).where("n > 0")


def _sums_by_code(labels: np.ndarray, k: int, m: np.ndarray) -> np.ndarray:
    """Rows of ``m`` summed by code, for every row of ``labels``: (labellings * k, columns)."""
    return (labels[:, None, :] == np.arange(k)[None, :, None]).reshape(-1, len(m)).astype(float) @ m


def pseudo_f(sums: DataFrame) -> DataFrame:
    """(p, f_stat, r2): squared-distance ANOVA. Sums of squared pair distances follow from vector sums:
    the sum over pairs of a group divided by its size is Σ|x|² − |Σx|²/n."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e * e)
    g = sums.withColumn("_w", F.col("squares") - square(F.col("total")) / F.col("n")).groupBy("p").agg(
        F.sum("_w").alias("ssw"), F.sum("squares").alias("_q"), F.sum("n").alias("n"), F.count("*").alias("k"),
        Summarizer.metrics("sum").summary(array_to_vector("total")).alias("_t"))
    sst = F.col("_q") - square(vector_to_array("_t.sum")) / F.col("n")
    g = g.withColumn("sst", sst)
    return g.select("p", "k", F.col("n").cast("bigint").alias("n"), (
        ((F.col("sst") - F.col("ssw")) / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("f_stat"),
        (1.0 - F.col("ssw") / F.col("sst")).alias("r2"))


def permutation_p(stats: DataFrame, stat: str, *more: Column) -> DataFrame:
    """Observed statistic (p = 0), null mean and (#null >= observed + 1) / (P + 1), with ``more`` aggregates beside them."""
    seen = F.max(F.when(F.col("p") == 0, F.col(stat))).over(W.partitionBy())
    null = F.col("p") > 0
    return stats.withColumn("_o", seen).agg(
        F.max("_o").alias(stat), F.avg(F.when(null, F.col(stat))).alias("null_mean"), F.count_if(null).alias("permutations"),
        ((F.count_if(null & (F.col(stat) >= F.col("_o") - 1e-12)) + 1) / (F.count_if(null) + 1)).alias("p_value"), *more)


def permanova(df: DataFrame, id_: str, label: str, x: str = "x", permutations: int = 5000, seed: int = 0) -> DataFrame:
    f = pseudo_f(permuted_sums(df, id_, label, x, permutations, seed))
    both = permutation_p(f, "f_stat", F.max(F.when(F.col("p") == 0, F.col("r2"))).alias("r2"))
    return both.select(*[c for c in both.columns if c != "r2"], "r2")


def permdisp(df: DataFrame, id_: str, label: str, x: str = "x", permutations: int = 5000, seed: int = 0) -> DataFrame:
    """Homogeneity of dispersion: ANOVA F of fixed deviations under permuted labels."""
    from pulsegrid.operators.pairwise import own_group_dispersion
    dev = cut_lineage(own_group_dispersion(df, id_, x, label).withColumn("_d", F.array("deviation")))  # read several times
    return permutation_p(pseudo_f(permuted_sums(dev, id_, label, "_d", permutations, seed)), "f_stat")
