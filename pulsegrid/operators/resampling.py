"""Bootstrap intervals and Gibbs posteriors.

Bootstrap: every row gets a Poisson(1) weight per replicate from a hash of its id, tasks sum weights and
weighted values, and only one row per (key, arm, replicate) is shuffled. Gibbs chains run on arm moments,
one key per group, so the data volume never reaches the chain.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import constants as C

POISSON_CUTS = np.cumsum([1 / np.e / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def _uniform(ids: np.ndarray, replicate: np.ndarray, seed: int) -> np.ndarray:
    """Counter-based uniforms in [0, 1) by 64-bit mixing of (id, replicate, seed)."""
    with np.errstate(over="ignore"):
        z = ids[:, None].astype("uint64") + np.uint64(0x9E3779B97F4A7C15) * (replicate[None, :].astype("uint64") + np.uint64(seed * 1_000_003 + 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / float(1 << 53)


def bootstrap_sums(long: DataFrame, keys: Sequence[str], arm: str, ids: Sequence[str], replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """(keys, arm, replicate, w, wv, wvv) for all replicates."""
    keys = list(keys)
    rows = long.where(F.col("value").isNotNull()).select(*keys, arm, F.xxhash64(*ids).alias("_id"), F.col("value").cast("double").alias("_v"))
    types = dict(rows.dtypes)

    def run(batches):
        acc = {}
        reps = np.arange(replicates)
        for pdf in batches:
            for key, g in pdf.groupby([*keys, arm], sort=False):
                v, ids_ = g["_v"].to_numpy(), g["_id"].to_numpy().astype("int64")
                total = acc.setdefault(key, np.zeros((3, replicates)))
                for i in range(0, len(v), 512):
                    w = np.searchsorted(POISSON_CUTS, _uniform(ids_[i:i + 512], reps, seed)).astype(float)
                    part = v[i:i + 512]
                    total += np.stack([w.sum(axis=0), part @ w, (part * part) @ w])
        for key, total in acc.items():
            out = pd.DataFrame({"replicate": reps.astype("int32"), "w": total[0], "wv": total[1], "wvv": total[2]})
            for name, value in zip([*keys, arm], key):
                out[name] = value
            yield out[[*keys, arm, "replicate", "w", "wv", "wvv"]]
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, arm]) + ", replicate int, w double, wv double, wvv double"
    return rows.mapInPandas(run, schema).groupBy(*keys, arm, "replicate").agg(
        F.sum("w").alias("w"), F.sum("wv").alias("wv"), F.sum("wvv").alias("wvv"))


def bootstrap_interval(long: DataFrame, keys: Sequence[str], arm: str, first, second, ids: Sequence[str], replicates: int = 10_000,
                       seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile intervals of the mean difference and Cohen's d between two arms.

    A replicate that draws fewer than two rows of an arm has no value; ``undefined`` counts those.
    """
    s = bootstrap_sums(long.where(F.col(arm).isin(first, second)), keys, arm, ids, replicates, seed)
    side = lambda name, c: F.max(F.when(F.col(arm) == name, F.col(c)))
    r = s.groupBy(*keys, "replicate").agg(*[side(n, c).alias(f"{c}_{t}") for t, n in (("a", first), ("b", second)) for c in ("w", "wv", "wvv")])
    mean = lambda t: F.col(f"wv_{t}") / F.col(f"w_{t}")
    ss = lambda t: F.col(f"wvv_{t}") - F.col(f"wv_{t}") * F.col(f"wv_{t}") / F.col(f"w_{t}")
    enough = (F.col("w_a") > 1) & (F.col("w_b") > 1)
    diff = F.when(enough, mean("a") - mean("b"))
    pooled = F.when(enough, F.sqrt((ss("a") + ss("b")) / (F.col("w_a") + F.col("w_b") - 2)))
    r = r.select(*keys, diff.alias("diff"), (diff / pooled).alias("d"))
    tail = (1 - level) / 2
    # one row per replicate: a bounded group, so the plain percentile is exact and safe
    return r.groupBy(*keys).agg(*[F.percentile(c, p).alias(f"{c}_{n}") for c in ("diff", "d") for n, p in (("low", tail), ("high", 1 - tail))],
                                F.count("*").alias("replicates"), F.count_if(F.col("diff").isNull()).alias("undefined"))


def _draw_rows(pdf: pd.DataFrame, keys: list[str], names: list[str], draws: np.ndarray) -> pd.DataFrame:
    """Draws (draw, parameter) as rows, with the group's keys in front."""
    n = len(draws)
    out = pd.DataFrame({k: [pdf[k].iloc[0]] * (n * len(names)) for k in keys})
    return out.assign(draw=np.tile(np.arange(n), len(names)).astype("int32"), param=np.repeat(names, n), value=draws.T.ravel())


def hierarchical_means(moments: DataFrame, keys: Sequence[str], arm: str, iterations: int = 8000, burn: int = 2000, seed: int = 0,
                       chains: int = 4, prior: tuple[float, float] = C.WEAK_GAMMA) -> DataFrame:
    """Posterior draws (keys, draw, param, value) of partially pooled arm means, from arm moments (n, mean, var).

    Values of an arm are normal around its mean with a precision that all arms share; arm means are normal around a
    common mean. The common mean is flat, both precisions are Gamma(shape, rate) = ``prior``. ``chains`` chains of a
    Gibbs sampler step side by side; each is burnt in, and together they give ``iterations - burn`` draws.
    """
    keys = list(keys)
    types = dict(moments.dtypes)
    wanted = iterations - burn
    shape, rate = prior

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(arm)
        size, centre = pdf["n"].to_numpy(float), pdf["mean"].to_numpy(float)
        inner = np.nansum((size - 1) * pdf["var"].to_numpy(float))
        rng = np.random.default_rng(seed)

        def precision(count, squares):
            return rng.gamma(shape + count / 2, size=(chains, 1)) / (rate + squares / 2)
        common = rng.choice(centre, (chains, 1))
        within = precision(size.sum(), inner)
        across = precision(len(size), ((centre - centre.mean()) ** 2).sum())
        kept = []
        for step in range(burn + -(-wanted // chains)):
            own = within * size
            total = own + across
            means = (own * centre + across * common) / total + rng.standard_normal(total.shape) / np.sqrt(total)
            common = means.mean(axis=1, keepdims=True) + rng.standard_normal((chains, 1)) / np.sqrt(len(size) * across)
            within = precision(size.sum(), inner + (size * (centre - means) ** 2).sum(axis=1, keepdims=True))
            across = precision(len(size), ((means - common) ** 2).sum(axis=1, keepdims=True))
            if step >= burn:
                kept.append(np.hstack([means, common, within ** -0.5, across ** -0.5]))
        return _draw_rows(pdf, keys, [*pdf[arm].astype(str), "mu", "sigma", "tau"], np.concatenate(kept)[:wanted])
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "draw int, param string, value double"
    return moments.groupBy(*keys).applyInPandas(sample, schema)


def slope_posterior(long: DataFrame, keys: Sequence[str], rank: str, iterations: int = 8000, burn: int = 2000, seed: int = 0,
                    prior: tuple[float, float] = C.WEAK_GAMMA) -> DataFrame:
    """Posterior draws of intercept and slope on the centred dose rank, from six sums per key.

    With flat coefficients the precision's own posterior is a Gamma of the residual squares, and the coefficients are
    independent normals given it; so ``iterations - burn`` draws are made at once, each independent of the others.
    Keys with one rank only have no draws.
    """
    keys = list(keys)
    types = dict(long.dtypes)
    x, y = F.col(rank).cast("double"), F.col("value")
    sums = long.where(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"),
        F.covar_pop(x, y).alias("cxy")).where("vx > 0")
    shape, rate = prior

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        n, my, vx, vy, cxy = (float(pdf[c].iloc[0]) for c in ("n", "my", "vx", "vy", "cxy"))
        rng = np.random.default_rng(seed)
        residual = max(0.0, n * (vy - cxy * cxy / vx))
        scale = (rng.gamma(shape + (n - 2) / 2, size=iterations - burn) / (rate + residual / 2)) ** -0.5
        z = rng.standard_normal((2, iterations - burn))
        draws = np.stack([my + z[0] * scale / np.sqrt(n), cxy / vx + z[1] * scale / np.sqrt(n * vx)], axis=1)
        return _draw_rows(pdf, keys, ["intercept", "slope"], draws)
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "draw int, param string, value double"
    return sums.groupBy(*keys).applyInPandas(sample, schema)


def posterior_summary(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, 95 % interval and probability below zero; the number of draws per parameter is fixed."""
    return draws.groupBy(*keys, "param").agg(
        F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"),
        F.avg((F.col("value") < 0).cast("int")).alias("p_negative"), F.count("*").alias("draws"))


def posterior_contrast(draws: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Draws of first minus second, as a parameter of its own."""
    pick = lambda n: F.max(F.when(F.col("param") == n, F.col("value")))
    return draws.groupBy(*keys, "draw").agg((pick(first) - pick(second)).alias("value")).withColumn("param", F.lit(f"{first} - {second}"))
