"""Effect sizes, slopes and exact medians of pairwise quantities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import tails
from pulsegrid.operators import ordered as O
from pulsegrid.operators.inference import pooled_sd
from pulsegrid.session import cut_lineage


#: Rows that a round of the pairwise-slope search merges, about.
ROUND_ROWS = 2_000_000


def effect_sizes(moments: DataFrame) -> DataFrame:
    """Difference, its standard error, Cohen's d, Hedges' g and the normal CI of d."""
    na, nb = F.col("n_a"), F.col("n_b")
    d = (F.col("m_a") - F.col("m_b")) / pooled_sd()
    out = moments.withColumns({
        "diff": F.col("m_a") - F.col("m_b"), "se": F.sqrt(F.col("v_a") / na + F.col("v_b") / nb), "df": na + nb - 2, "cohen_d": d})
    d = F.col("cohen_d")
    half = 1.96 * F.sqrt((na + nb) / (na * nb) + d * d / (2.0 * (na + nb)))
    return out.withColumns({"hedges_g": d * (1.0 - 3.0 / (4.0 * (na + nb) - 9.0)), "d_low": d - half, "d_high": d + half})


def with_t_interval(df: DataFrame, level: float = 0.95) -> DataFrame:
    """t confidence interval of the difference; one row per comparison."""
    from pulsegrid.functions.distributions import t_quantile

    @F.pandas_udf("double")
    def critical(nu: pd.Series) -> pd.Series:
        return pd.Series([t_quantile(0.5 + level / 2, v) for v in nu])
    c = critical(F.col("df").cast("double")) * F.col("se")
    return df.withColumns({"ci_low": F.col("diff") - c, "ci_high": F.col("diff") + c})


def rope_probability(moments: DataFrame, margin_sd: float = 0.5) -> DataFrame:
    """Posterior probability that the difference lies within ± ``margin_sd`` pooled SDs (normal posterior)."""
    se = F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b"))
    d, m = F.col("m_a") - F.col("m_b"), margin_sd * pooled_sd()
    return moments.withColumn("p_rope", tails.normal_cdf((m - d) / se) - tails.normal_cdf((-m - d) / se))


def ols_slope(long: DataFrame, keys: Sequence[str], x: str, y: str = "value") -> DataFrame:
    return long.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def power_table(long: DataFrame, keys: Sequence[str], sizes: Sequence[int] = (23, 12, 6), at_least: int = 10) -> DataFrame:
    """Minimum detectable effect per parameter: the d a t test can see at each arm size, times the SD."""
    from pulsegrid.functions.distributions import detectable_effect
    g = long.groupBy(*keys).agg(F.count("value").alias("n_animals"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    out = g.where(F.col("n_animals") >= at_least).withColumn("cv_pct", 100.0 * F.col("sd") / F.col("mean"))
    for n in sizes:
        mde = F.lit(detectable_effect(n)) * F.col("sd")
        out = out.withColumns({f"mde_n{n}": mde, f"mde_n{n}_pct": 100.0 * mde / F.col("mean")})
    return out


def _pairs_at_or_below(cells: DataFrame, asks: DataFrame, by: Sequence[str], keys: Sequence[str], n_levels: int) -> DataFrame:
    """For each asked slope ``_s`` the number of pairs with (y_j - y_i) / (j - i) <= _s, by merging sorted values."""
    spread = cells.join(asks, list(keys))
    merged = None
    for j in range(1, n_levels):
        for i in range(j):
            low = spread.where(F.col("_l") == i).select(*by, F.lit(n_levels * i + j).alias("_p"), F.col("_v").alias("_x"), F.col("_k").alias("_a"), F.lit(0).cast("bigint").alias("_b"))
            high = spread.where(F.col("_l") == j).select(*by, F.lit(n_levels * i + j).alias("_p"), (F.col("_v") - F.col("_s") * (j - i)).alias("_x"),
                                                         F.lit(0).cast("bigint").alias("_a"), F.col("_k").alias("_b"))
            both = low.unionByName(high)
            merged = both if merged is None else merged.unionByName(both)
    merged = merged.groupBy(*by, "_p", "_x").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    run = O.running_sums(merged, [*by, "_p"], "_x", ["_b"])
    return run.groupBy(*by).agg(F.sum(F.col("_a") * (F.col("_b_before") + F.col("_b"))).alias("_c"))


def _as_ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order: neighbouring doubles are neighbouring integers."""
    bits = np.asarray(x, np.float64).view(np.int64)
    return np.where(bits < 0, np.iinfo(np.int64).min - bits, bits)


def _as_doubles(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, np.int64)
    return np.where(n < 0, np.iinfo(np.int64).min - n, n).view(np.float64)


def _between(low: float, high: float, probes: int) -> list[float]:
    """At most ``probes`` doubles strictly between two, evenly spread over those that exist."""
    lo, hi = (int(_as_ordered(np.array([v]))[0]) for v in (low, high))
    inner = sorted({lo + (hi - lo) * i // (probes + 1) for i in range(1, probes + 1)} - {lo, hi})
    return _as_doubles(np.array(inner, np.int64)).tolist()


def median_pairwise_slope(long: DataFrame, keys: Sequence[str], level: str, n_levels: int, probes: int | None = None) -> DataFrame:
    """Median of (y_j - y_i) / (x_j - x_i) over all pairs on different levels, without forming the pairs.

    Theil–Sen over ordered dose levels 0…n_levels-1; with two levels it is the Hodges–Lehmann shift. Each round asks, for
    a few slopes per key, how many pairs lie at or below (running counts over merged sorted values) and narrows the bracket
    around the two middle order statistics. Brackets are cut by the order of the doubles themselves, so a round leaves a
    (probes + 1)-th of the doubles in them; after 64 / log2(probes + 1) rounds, whatever the data, a bracket's
    ends are neighbours and its upper end is the answer. State between rounds: one or two rows per key. Without ``probes`` as
    many are asked as keep a round's rows near ``ROUND_ROWS``, 15 at least; that changes the number of rounds only.
    """
    keys = list(keys)
    rows = long.where(F.col("value").isNotNull() & F.col(level).isNotNull()).select(
        *keys, F.col(level).cast("int").alias("_l"), F.col("value").cast("double").alias("_v"))
    cells = cut_lineage(rows.groupBy(*keys, "_l", "_v").agg(F.sum(F.lit(1)).alias("_k")))
    probes = probes or min(1023, max(15, ROUND_ROWS // max(1, cells.count() * n_levels)))
    sizes = cells.groupBy(*keys).agg(*[F.sum(F.when(F.col("_l") == i, F.col("_k")).otherwise(0)).alias(f"_n{i}") for i in range(n_levels)],
                                     (F.max("_v") - F.min("_v")).alias("_span"))
    pairs = sum((F.col(f"_n{i}") * F.col(f"_n{j}") for i in range(n_levels) for j in range(i + 1, n_levels)), F.lit(0))
    state = sizes.select(*keys, pairs.cast("bigint").alias("_pairs"), "_span").where("_pairs > 0").select(
        *keys, (-F.col("_span") - 1.0).alias("_lo"), (F.col("_span") + 1.0).alias("_hi"),
        F.explode(F.array_distinct(F.array(F.floor((F.col("_pairs") + 1) / 2), F.floor(F.col("_pairs") / 2) + 1))).alias("_want"))
    between = F.pandas_udf(lambda lo, hi: pd.Series([_between(x, y, probes) for x, y in zip(lo, hi, strict=True)]), "array<double>")
    state = cut_lineage(state.withColumn("_asked", between("_lo", "_hi")))
    while not state.where(F.size("_asked") > 0).isEmpty():
        asks = state.select(*keys, "_want", F.explode("_asked").alias("_s"))
        below = _pairs_at_or_below(cells, asks, [*keys, "_want", "_s"], keys, n_levels)
        nxt = below.groupBy(*keys, "_want").agg(F.max(F.when(F.col("_c") < F.col("_want"), F.col("_s"))).alias("_u"),
                                                F.min(F.when(F.col("_c") >= F.col("_want"), F.col("_s"))).alias("_o"))
        narrowed = state.join(nxt, [*keys, "_want"], "left").select(
            *keys, "_want", F.coalesce("_u", "_lo").alias("_lo"), F.coalesce("_o", "_hi").alias("_hi"))
        state = cut_lineage(narrowed.withColumn("_asked", between("_lo", "_hi")))
    return state.groupBy(*keys).agg(F.avg("_hi").alias("median"))


def huber_slope(long: DataFrame, keys: Sequence[str], x: str, y: str = "value", tuning: float = 1.345, max_iter: int = 50,
                tolerance: float = 1e-8) -> DataFrame:
    """Huber regression of ``y`` on ``x`` by reweighted least squares; the scale is the MAD, renewed every round.

    A round is one exact median and one set of weighted sums per key over all rows; the state is one row per key.
    """
    keys = list(keys)
    rows = long.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    state = cut_lineage(rows.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept")))
    for _ in range(max_iter):
        res = rows.join(state, keys).withColumn("_r", F.abs(F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x")))
        scale = O.exact_quantiles(res, keys, "_r", {"_mad": 0.5}).withColumn("_s", F.col("_mad") / 0.6744897501960817)
        limit = tuning * F.col("_s")
        w = F.when(F.col("_r") <= limit, 1.0).otherwise(limit / F.col("_r"))
        s = res.join(scale, keys).withColumn("_w", w).groupBy(*keys).agg(
            F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_x")).alias("wx"), F.sum(F.col("_w") * F.col("_y")).alias("wy"),
            F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("wxx"), F.sum(F.col("_w") * F.col("_x") * F.col("_y")).alias("wxy"),
            F.max("slope").alias("_old"))
        slope = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / (F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
        new = cut_lineage(s.withColumn("slope", slope).select(
            *keys, "slope", ((F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w")).alias("intercept"), F.abs(F.col("slope") - F.col("_old")).alias("_step")))
        done = (new.agg(F.max("_step")).first()[0] or 0.0) <= tolerance
        state = new.drop("_step")
        if done:
            break
    return state
