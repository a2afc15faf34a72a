"""Clusterings and what is said about them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window as W, functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.operators import batched as BM, pairwise as PW, ward as WD
from pulsegrid.operators.ordered import attach_one_row, positions
from pulsegrid.session import cut_lineage


def _vectors(df: DataFrame, x: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(x).cast("array<double>")))


def kmeans(df: DataFrame, k: int, x: str = "x", seed: int = 42, n_init: int = 10, name: str = "cluster") -> DataFrame:
    """Best of ``n_init`` k-means fits by cost."""
    return kmeans_model(df, k, x, seed, n_init, name)(df)


def kmeans_model(df: DataFrame, k: int, x: str = "x", seed: int = 42, n_init: int = 10, name: str = "cluster") -> Callable[[DataFrame], DataFrame]:
    """Adds a row's cluster by the best of ``n_init`` k-means fits."""
    v = _vectors(df, x)
    fits = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol=name).fit(v) for i in range(n_init)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return lambda rows: best.transform(_vectors(rows, x)).drop("_v")


def mixture(df: DataFrame, k: int, x: str = "x", seed: int = 42, name: str = "cluster") -> DataFrame:
    return mixture_model(df, k, x, seed, name)(df)


def mixture_model(df: DataFrame, k: int, x: str = "x", seed: int = 42, name: str = "cluster") -> Callable[[DataFrame], DataFrame]:
    model = GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol=name, probabilityCol="_p").fit(_vectors(df, x))
    return lambda rows: model.transform(_vectors(rows, x)).drop("_v", "_p")


def pam(df: DataFrame, id_: str, k: int, x: str = "x", seed: int = 0, n_init: int = 8, max_iter: int = 100,
        name: str = "cluster") -> DataFrame:
    """Partitioning around medoids: nearest-medoid assignment, per-cluster 1-median update, best of ``n_init`` starts side by side."""
    rows = df.select(id_, F.col(x).cast("array<double>").alias("_x"))
    found, cost = BM.medoids(BM.subsamples(rows, id_, "_x", n_init, seed=seed), [k], max_iter, seed)
    best = found[k][cost[k].argmin()]
    lit = F.array(*[F.struct(F.lit(c).alias("c"), F.array(*[F.lit(float(v)) for v in m]).alias("m")) for c, m in enumerate(best)])
    near = F.array_min(F.transform(lit, lambda s: F.struct(A.squared_distance(F.col(x).cast("array<double>"), s["m"]).alias("d"), s["c"].alias("c"))))
    return df.withColumn(name, near["c"])


def silhouette(df: DataFrame, id_: str, x: str, label: str) -> DataFrame:
    return PW.silhouette_rows(df, id_, x, label).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_sweep(df: DataFrame, id_: str, ks: Sequence[int], x: str = "x", algorithms=("kmeans",), n_init: int = 10) -> DataFrame:
    """Silhouette per algorithm and k, the best k of each marked. Rows are kept for the fits; all clusterings share one pass over the distances."""
    labelled = df = cut_lineage(df)
    tried = [(algo, k) for algo in algorithms for k in ks]
    for i, (algo, k) in enumerate(tried):
        name = f"_cluster{i}"
        labelled = (kmeans_model(df, k, x, n_init=n_init, name=name) if algo == "kmeans" else mixture_model(df, k, x, name=name))(labelled)
    of = PW.silhouettes(labelled, id_, x, [f"_cluster{i}" for i in range(len(tried))]).groupBy("labelling").agg(F.avg("silhouette").alias("silhouette"))
    names = F.array(*[F.struct(F.lit(a).alias("algorithm"), F.lit(k).alias("k")) for a, k in tried])
    out = of.select(names[F.col("labelling")].alias("t"), "silhouette").select("t.algorithm", "t.k", "silhouette")
    top = F.max(F.struct("silhouette", -F.col("k"))).over(W.partitionBy("algorithm"))
    return out.withColumn("best", F.col("k") == -top["col2"])


def separation_verdict(s):
    return F.when(s > 0.5, "REAL").when(s > 0.35, "weak").otherwise("noise")


def largest_cluster(df: DataFrame, label: str) -> DataFrame:
    """Rows of the most frequent cluster (the smaller label on ties)."""
    top = df.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(1)
    return df.join(F.broadcast(top.select(label)), label, "left_semi")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from the contingency table."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("_n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    rows = cells.groupBy(a).agg(F.sum("_n").alias("_m")).agg(pairs("_m").alias("_a"), F.sum("_m").alias("n"))
    cols = cells.groupBy(b).agg(F.sum("_n").alias("_m")).agg(pairs("_m").alias("_b"))
    both = cells.agg(pairs("_n").alias("_ab"))
    one = attach_one_row(attach_one_row(rows, cols), both)
    expected = F.col("_a") * F.col("_b") / (F.col("n") * (F.col("n") - 1) / 2.0)
    top = (F.col("_a") + F.col("_b")) / 2.0
    return one.select("n", F.when(top == expected, 1.0).otherwise((F.col("_ab") - expected) / (top - expected)).alias("ari"))


def relabel_by_mean(df: DataFrame, label: str, value: str, name: str = "phenotype") -> DataFrame:
    """Clusters named A, B, C ... by falling mean (of equal means the larger label first), so that of two the lower is B."""
    means = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.avg(value).alias("_m"))
    ordered = means.agg(F.array_sort(F.collect_list(F.struct(F.col("_m"), F.col(label).alias("l")))).alias("_order"))
    placed = attach_one_row(df, ordered)
    at = F.size("_order") - F.array_position(F.transform("_order", lambda e: e["l"]), F.col(label))
    return placed.withColumn(name, F.when(F.col(label).isNotNull(), F.char(F.lit(65) + at))).drop("_order")


def profile(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Mean of every feature in its own units, and the number of rows, per cluster."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.avg(f).alias(f) for f in features], F.count("*").alias("n"))


def enrichment(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(labelling, n, chi2, dof, p_value): whether clusters hold the values of each column unequally.

    One pass counts the tables of all columns (grouping sets). With one degree of freedom the continuity correction applies.
    """
    from pulsegrid.operators.inference import with_chi2_p
    text = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_r"), *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(columns)])
    sets = [[F.col("_r"), F.col(f"_{i}")] for i in range(len(columns))]
    counted = text.groupingSets(sets, "_r", *[f"_{i}" for i in range(len(columns))]).agg(F.grouping_id().alias("_g"), F.count("*").alias("_o"))
    n_bits = len(columns)
    which = F.coalesce(*[F.when(F.col("_g") == (2 ** n_bits - 1) - 2 ** (n_bits - 1 - i), F.struct(F.lit(c).alias("labelling"), F.col(f"_{i}").alias("_c")))
                         for i, c in enumerate(columns)])
    cells = counted.withColumn("_w", which).select("_w.labelling", "_r", "_w._c", "_o").where("_c IS NOT NULL")
    every = W.partitionBy("labelling")
    cells = cells.withColumns({"_n": F.sum("_o").over(every), "_nr": F.sum("_o").over(W.partitionBy("labelling", "_r")), "_nc": F.sum("_o").over(W.partitionBy("labelling", "_c"))})
    sizes = cells.groupBy("labelling").agg(((F.count_distinct("_r") - 1) * (F.count_distinct("_c") - 1)).cast("int").alias("dof"), F.max("_n").alias("n"),
                                           F.count_distinct("_r").alias("_kr"), F.count_distinct("_c").alias("_kc"))
    # expected counts of all cells, empty ones too: those that hold rows, and n less their expectations
    gap = F.abs(F.col("_o") - F.col("_e"))
    near = F.when(F.col("dof") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    held = cells.join(sizes, ["labelling"]).withColumn("_e", F.col("_nr") * F.col("_nc") / cells["_n"])
    empty = F.when(F.col("dof") == 1, F.sum(F.lit(0.0))).otherwise(F.max("_n") - F.sum("_e"))  # an empty cell adds its expectation
    return with_chi2_p(held.groupBy("labelling", "n", "dof").agg((F.sum(near * near / F.col("_e")) + empty).alias("chi2")), "chi2", F.col("dof")).select(
        "labelling", "n", "chi2", "dof", "p_value")


def recluster_inner(df: DataFrame, id_: str, x: str = "x", ks: Sequence[int] = range(2, 7), algorithms=("kmeans", "gmm"), n_init: int = 10) -> DataFrame:
    """Silhouettes of all rows, and again of the larger of two clusters: what is left when outliers go."""
    df = cut_lineage(df)
    inner = cut_lineage(largest_cluster(kmeans(df, 2, x, n_init=n_init), "cluster").drop("cluster"))
    out = None
    for name, rows in (("all", df), ("inner", inner)):
        one = silhouette_sweep(rows, id_, ks, x, algorithms, n_init).select(F.lit(name).alias("rows"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def flag_rates(df: DataFrame, label: str, flags: Sequence[str], below: float = 0.20) -> DataFrame:
    """Mean of each flag per cluster; rates under ``below`` mark a cluster defined by that flag."""
    long = df.select(label, *[F.col(f).cast("double").alias(f) for f in flags]).unpivot([label], list(flags), "flag", "v")
    return long.groupBy(label, "flag").agg(F.avg("v").alias("rate"), F.count("*").alias("n")).withColumn("defining", F.col("rate") < below)


def missingness(df: DataFrame, id_: str, label: str, features: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Presence matrix ordered by cluster, with the first row of every cluster marked."""
    cols = [F.col(c).isNotNull().cast("int").alias(c) for c in features] + [F.col(c).cast("int").alias(c) for c in flags]
    placed = positions(df.select(id_, F.col(label).cast("int").alias(label), *cols), [], label, [id_], "row")
    first = placed.groupBy(label).agg(F.min("row").alias("_first"))
    return placed.join(F.broadcast(first), label).withColumn("boundary", F.col("row") == F.col("_first")).drop("_first")


def consensus_labels(df: DataFrame, id_: str, ks: Sequence[int], x: str = "x", runs: int = 100, fraction: float = 0.8, seed: int = 0,
                     algorithms=("kmeans", "ward", "gmm", "pam"), n_init: int = 10) -> DataFrame:
    """(id, k, labels): a label for each algorithm and exact-size random subsample, NULL where a row was left out.

    All runs, numbers of clusters and starts of an algorithm are fitted in the same passes.
    """
    lab = BM.subsamples(df, id_, x, runs, fraction, seed)
    near, mixed = {}, {}
    if "kmeans" in algorithms or "gmm" in algorithms:
        centres = BM.lloyd(lab, ks, n_init, seed=seed)
        near |= {"kmeans": centres} if "kmeans" in algorithms else {}
        mixed |= {"gmm": BM.mixtures(lab, centres)} if "gmm" in algorithms else {}
    if "pam" in algorithms:
        near["pam"] = BM.medoids(lab, ks, seed=seed)[0]
    parts = [BM.assigned(lab, ks, near, mixed)] if near or mixed else []
    if "ward" in algorithms:
        labels, _ = WD.ward(BM.members(lab), ks)
        by_run = labels.groupBy("id", "k").agg(F.map_from_entries(F.collect_list(F.struct("r", "label"))).alias("m"))
        parts.append(by_run.select("id", "k", F.lit("ward").alias("algorithm"), F.lit(1).alias("first"), F.transform(
            F.sequence(F.lit(1), F.lit(runs)), lambda r: F.col("m")[r]).alias("labels")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("algorithm", "first", "labels")))
    return both.groupBy(F.col("id").alias(id_), "k").agg(F.flatten(F.transform(ordered, lambda e: e["labels"])).alias("labels"))


def subsampled_labels(df: DataFrame, id_: str, k: int, x: str = "x", runs: int = 100, fraction: float = 0.8, seed: int = 0,
                      algorithms=("kmeans", "gmm"), n_init: int = 10) -> DataFrame:
    """``consensus_labels`` of one k."""
    return consensus_labels(df, id_, [k], x, runs, fraction, seed, algorithms, n_init).drop("k")


def consensus_choice(df: DataFrame, id_: str, ks: Sequence[int] = (2, 3, 4, 5), x: str = "x", runs: int = 100, seed: int = 0,
                     algorithms=("kmeans", "ward", "gmm", "pam")) -> DataFrame:
    """(k, pairs, ambiguous, mean_rate, pac, chosen): how ambiguous the runs are at each k; the least ambiguous k (the smaller on ties) is chosen."""
    labels = cut_lineage(consensus_labels(df, id_, ks, x, runs, seed=seed, algorithms=algorithms))
    out = None
    for k in ks:
        one = PW.ambiguous_share(labels.where(F.col("k") == k), id_, "labels").select(F.lit(k).alias("k"), "*")
        out = one if out is None else out.unionByName(one)
    least = F.min(F.struct("pac", "k")).over(W.partitionBy())["k"]
    return out.withColumn("chosen", F.col("k") == least)
