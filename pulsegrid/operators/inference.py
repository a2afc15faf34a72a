"""Hypothesis tests on long tables: one row per (keys, …, value), one result row per key.

Every test is grouped sums, so all parameters of all studies run in one job. Rank tests count equal values
first and never sort a whole arm in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pulsegrid.functions import tails
from pulsegrid.operators import ordered as O


def arm_moments(long: DataFrame, keys: Sequence[str], arm: str, value: str = "value") -> DataFrame:
    v = F.col(value)
    return long.where(v.isNotNull() & F.col(arm).isNotNull()).groupBy(*keys, arm).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def _anova_from_moments(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arms are few, so the grand mean is a window over the moment rows of a key."""
    w = W.partitionBy(*keys)
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    g = m.withColumn("_g", grand).groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_g")) * (F.col("mean") - F.col("_g"))).alias("ss_between"),
        F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)).alias("ss_within"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return g.withColumn("f_stat", F.when((d1 > 0) & (d2 > 0), (F.col("ss_between") / d1) / (F.col("ss_within") / d2)))


def one_way_anova(long: DataFrame, keys: Sequence[str], arm: str, min_per_arm: int = 2,
                  require_arms: int | None = None) -> DataFrame:
    """F over arms with at least ``min_per_arm`` values; with ``require_arms`` a key is kept only if all arms qualify."""
    m = arm_moments(long, keys, arm).where(F.col("n") >= min_per_arm)
    out = _anova_from_moments(m, keys)
    return out.where(F.col("k") == require_arms) if require_arms else out.where("k >= 2")


def with_f_p(df: DataFrame, f: str = "f_stat", name: str = "p_value") -> DataFrame:
    return df.withColumn(name, tails.f_tail(F.col(f), F.col("k") - 1, F.col("n") - F.col("k")))


def levene(long: DataFrame, keys: Sequence[str], arm: str) -> DataFrame:
    """Brown–Forsythe form: ANOVA of absolute deviations from the exact arm median."""
    med = O.exact_quantiles(long, [*keys, arm], "value", {"_med": 0.5})
    dev = long.join(med, [*keys, arm]).withColumn("value", F.abs(F.col("value") - F.col("_med"))).drop("_med")
    return one_way_anova(dev, keys, arm).withColumnRenamed("f_stat", "w_stat")


def kruskal(long: DataFrame, keys: Sequence[str], arm: str) -> DataFrame:
    """H with tie correction."""
    r = O.cross_group_ranks(long, keys, arm, "value")
    t = F.col("ties").cast("double")
    per_arm = r.groupBy(*keys, arm).agg(
        F.sum(F.col("n") * F.col("avg_rank")).alias("_r"), F.sum("n").alias("_n"), F.max("n_total").alias("_t"),
        F.sum((t * t * t - t) * F.col("n") / t).alias("_tie"))
    g = per_arm.groupBy(*keys).agg(F.count("*").alias("k"), F.max("_t").cast("double").alias("n"),
                                   F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_q"), F.sum("_tie").alias("_tie"))
    n = F.col("n")
    h = (12.0 / (n * (n + 1)) * F.col("_q") - 3.0 * (n + 1)) / (1.0 - F.col("_tie") / (n * n * n - n))
    return g.select(*keys, "k", n.cast("bigint").alias("n"), h.alias("h_stat"))


def with_chi2_p(df: DataFrame, stat: str, dof: Column, name: str = "p_value") -> DataFrame:
    return df.withColumn(name, tails.chi2_tail(F.col(stat), dof))


def jonckheere(long: DataFrame, keys: Sequence[str], level: str, n_levels: int) -> DataFrame:
    """Jonckheere–Terpstra trend over ordered levels 0…n_levels-1; NULL with under 3 values or an empty level.

    Pairs are counted from running totals per distinct value, not formed.
    """
    c = O.ordered_level_counts(long, keys, level, "value", n_levels)
    u = F.lit(0.0)
    for j in range(1, n_levels):
        below = sum((F.col(f"c{i}_before") + F.col(f"c{i}") / 2.0 for i in range(j)), F.lit(0.0))
        u = u + F.col(f"c{j}") * below
    g = c.groupBy(*keys).agg(F.sum(u).alias("u_stat"), *[F.max(f"c{i}_total").cast("double").alias(f"_n{i}") for i in range(n_levels)])
    return _jt_z(g, [F.col(f"_n{i}") for i in range(n_levels)]).drop(*[f"_n{i}" for i in range(n_levels)])


def _jt_z(df: DataFrame, sizes: Sequence[Column], u: str = "u_stat", z: str = "z_stat") -> DataFrame:
    n = sum(sizes, F.lit(0.0))
    mean = (n * n - sum((s * s for s in sizes), F.lit(0.0))) / 4.0
    var = (n * n * (2 * n + 3) - sum((s * s * (2 * s + 3) for s in sizes), F.lit(0.0))) / 72.0
    ok = n >= 3
    for s in sizes:
        ok = ok & (s > 0)
    return df.withColumn("n", n.cast("bigint")).withColumn(z, F.when(ok & (var > 0), (F.col(u) - mean) / F.sqrt(var)))


def jonckheere_leave_one_out(long: DataFrame, keys: Sequence[str], level: str, n_levels: int) -> DataFrame:
    """Smallest and largest z when each animal is left out in turn: U minus the pairs that animal takes part in."""
    c = O.ordered_level_counts(long, keys, level, "value", n_levels)
    total = jonckheere(long, keys, level, n_levels).select(*keys, F.col("u_stat").alias("_u"), F.col("z_stat").alias("z_all"))
    rows = []
    for g in range(n_levels):
        share = F.lit(0.0)
        for i in range(g):
            share = share + F.col(f"c{i}_before") + F.col(f"c{i}") / 2.0
        for j in range(g + 1, n_levels):
            share = share + F.col(f"c{j}_total") - F.col(f"c{j}_before") - F.col(f"c{j}") / 2.0
        rows.append(F.struct(F.lit(g).alias("_g"), F.col(f"c{g}").alias("_k"), share.cast("double").alias("_share")))
    totals = [F.col(f"c{i}_total") for i in range(n_levels)]
    one = c.select(*keys, *totals, F.inline(F.array(*rows))).where("_k > 0").join(total, list(keys))
    one = one.withColumn("u_stat", F.col("_u") - F.col("_share"))
    sizes = [(F.col(f"c{i}_total") - (F.col("_g") == i).cast("int")).cast("double") for i in range(n_levels)]
    return _jt_z(one, sizes).groupBy(*keys).agg(
        F.max("z_all").alias("z_all"), F.min("z_stat").alias("z_min"), F.max("z_stat").alias("z_max"))


def spearman(long: DataFrame, keys: Sequence[str], x: str, y: str = "value") -> DataFrame:
    """Pearson correlation of average ranks, from counts per distinct (x, y)."""
    keys = list(keys)
    cells = long.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_k"))
    def ranks(c, name):
        weighted = cells.groupBy(*keys, c).agg(F.sum("_k").alias("_m"))
        r = O.running_sums(weighted, keys, c, ["_m"], cut_from=long)
        return r.select(*keys, c, (F.col("_m_before") + (F.col("_m") + 1) / 2.0).alias(name))
    j = cells.join(ranks(x, "_rx"), [*keys, x]).join(ranks(y, "_ry"), [*keys, y])
    k, a, b = F.col("_k").cast("double"), F.col("_rx"), F.col("_ry")
    g = j.groupBy(*keys).agg(F.sum(k).alias("_n"), F.sum(k * a).alias("_a"), F.sum(k * b).alias("_b"),
                             F.sum(k * a * a).alias("_aa"), F.sum(k * b * b).alias("_bb"), F.sum(k * a * b).alias("_ab"))
    n = F.col("_n")
    cov = F.col("_ab") - F.col("_a") * F.col("_b") / n
    va, vb = F.col("_aa") - F.col("_a") * F.col("_a") / n, F.col("_bb") - F.col("_b") * F.col("_b") / n
    rho = F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    return g.select(*keys, n.cast("bigint").alias("n"), F.when(n >= 5, rho).alias("rho"))


def with_correlation_p(df: DataFrame, r: str = "rho", name: str = "p_value") -> DataFrame:
    t = F.col(r) * F.sqrt((F.col("n") - 2) / (1.0 - F.col(r) * F.col(r)))
    return df.withColumn(name, F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(tails.t_two_sided(t, F.col("n") - 2)))


def mann_whitney(long: DataFrame, keys: Sequence[str], arm: str, first, second) -> DataFrame:
    """U of the first arm and the rank-biserial correlation."""
    two = long.where(F.col(arm).isin(first, second))
    r = O.cross_group_ranks(two, keys, arm, "value")
    a = F.col(arm) == first
    grouped = r.groupBy(*keys) if keys else r.groupBy()
    g = grouped.agg(F.sum(F.when(a, F.col("n") * F.col("avg_rank"))).alias("_ra"), F.sum(F.when(a, F.col("n"))).alias("n_a"),
                    F.sum(F.when(~a, F.col("n"))).alias("n_b"))
    u = F.col("_ra") - F.col("n_a") * (F.col("n_a") + 1) / 2.0
    return g.select(*keys, "n_a", "n_b", u.alias("u_stat"), (1.0 - 2.0 * u / (F.col("n_a") * F.col("n_b"))).alias("rank_biserial"))


def chi_square(df: DataFrame, keys: Sequence[str], row: str, column: str) -> DataFrame:
    """Contingency χ² (Yates-corrected for 2×2) over the observed levels; cells come from one aggregation."""
    keys = list(keys)
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*keys, row, column).agg(F.count("*").alias("_o"))
    w, wr, wc = W.partitionBy(*keys), W.partitionBy(*keys, row), W.partitionBy(*keys, column)
    m = cells.withColumns({"_n": F.sum("_o").over(w), "_r": F.sum("_o").over(wr), "_c": F.sum("_o").over(wc),
                           "_nr": F.size(F.collect_set(row).over(w)), "_nc": F.size(F.collect_set(column).over(w))})
    e = F.col("_r") * F.col("_c") / F.col("_n")
    yates = (F.col("_nr") == 2) & (F.col("_nc") == 2)
    diff = F.abs(F.col("_o") - e)
    fixed = F.when(yates, diff - F.least(F.lit(0.5), diff)).otherwise(diff)
    # cells that never occur have O = 0: each adds E (less the correction), which the totals give as N - sum E
    empty = F.col("_nr") * F.col("_nc") - F.count("*").over(w)
    m = m.withColumns({"_x": fixed * fixed / e, "_e": e, "_empty": empty, "_y": yates})
    g = (m.groupBy(*keys) if keys else m.groupBy()).agg(
        F.sum("_x").alias("_x"), F.sum("_e").alias("_e"), F.max("_n").alias("n"), F.max("_nr").alias("_nr"),
        F.max("_nc").alias("_nc"), F.max("_empty").alias("_empty"))
    missing = F.when(F.col("_empty") > 0, F.col("n") - F.col("_e")).otherwise(0.0)
    return g.select(*keys, "n", (F.col("_x") + missing).alias("chi2"), ((F.col("_nr") - 1) * (F.col("_nc") - 1)).alias("dof"))


def bland_altman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    d, m = F.col(a) - F.col(b), (F.col(a) + F.col(b)) / 2.0
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    g = grouped.agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("_sd"), F.corr(d, m).alias("r_bias"))
    return g.select(*keys, "n", "bias", (F.col("bias") - 1.96 * F.col("_sd")).alias("loa_low"),
                    (F.col("bias") + 1.96 * F.col("_sd")).alias("loa_high"), "r_bias",
                    F.when(F.abs("r_bias") < 0.3, "none").otherwise("proportional").alias("bias_kind"))


def two_arm_moments(long: DataFrame, keys: Sequence[str], arm: str, first, second) -> DataFrame:
    """n, mean and variance of both arms side by side."""
    cols = []
    for side, name in (("a", first), ("b", second)):
        v = F.when(F.col(arm) == name, F.col("value"))
        cols += [F.count(v).alias(f"n_{side}"), F.avg(v).alias(f"m_{side}"), F.var_samp(v).alias(f"v_{side}")]
    return (long.groupBy(*keys) if keys else long.groupBy()).agg(*cols)


def pooled_sd() -> Column:
    na, nb = F.col("n_a"), F.col("n_b")
    return F.sqrt(((na - 1) * F.col("v_a") + (nb - 1) * F.col("v_b")) / (na + nb - 2))


def equivalence(moments: DataFrame, margin_sd: float = 0.5) -> DataFrame:
    """Two one-sided tests within ± ``margin_sd`` pooled SDs: both t statistics and df."""
    se = F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b"))
    margin, d = margin_sd * pooled_sd(), F.col("m_a") - F.col("m_b")
    return moments.withColumns({"margin": margin, "diff": d, "t_low": (d + margin) / se, "t_high": (d - margin) / se,
                                "df": F.col("n_a") + F.col("n_b") - 2})


def with_equivalence_p(df: DataFrame) -> DataFrame:
    p = F.greatest(tails.t_upper(F.col("t_low"), F.col("df")), tails.t_upper(-F.col("t_high"), F.col("df")))
    return df.withColumn("p_value", p).withColumn("equivalent", F.col("p_value") < 0.05)


def tukey_vs_control(long: DataFrame, keys: Sequence[str], arm: str, control) -> DataFrame:
    """Studentised-range statistic of every arm against the control, from arm moments."""
    keys = list(keys)
    m = arm_moments(long, keys, arm)
    w = W.partitionBy(*keys)
    mse = F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)).over(w) / (F.sum("n").over(w) - F.count("*").over(w))
    is_c = F.col(arm) == control
    m = m.withColumns({"mse": mse, "k": F.count("*").over(w), "n_total": F.sum("n").over(w),
                       "_mc": F.max(F.when(is_c, F.col("mean"))).over(w), "_nc": F.max(F.when(is_c, F.col("n"))).over(w)})
    diff = F.col("mean") - F.col("_mc")
    q = F.abs(diff) / F.sqrt(F.col("mse") / 2.0 * (1.0 / F.col("n") + 1.0 / F.col("_nc")))
    return (m.where(~is_c & F.col("_nc").isNotNull() & (F.col("n_total") > F.col("k")))
             .select(*keys, arm, diff.alias("diff"), q.alias("q_stat"), "k", (F.col("n_total") - F.col("k")).alias("df")))


def with_tukey_p(df: DataFrame) -> DataFrame:
    """Adds the adjusted p; the frame holds one row per compared pair."""
    from pulsegrid.functions.distributions import studentized_range_tail

    @F.pandas_udf("double")
    def tail(q: pd.Series, k: pd.Series, nu: pd.Series) -> pd.Series:
        return pd.Series([studentized_range_tail(a, b, c) for a, b, c in zip(q, k, nu)])
    return df.withColumn("p_value", tail("q_stat", F.col("k").cast("double"), F.col("df").cast("double")))


def two_way_anova(long: DataFrame, keys: Sequence[str], a: str, b: str, min_n: int = 12) -> DataFrame:
    """Type II two-way ANOVA with interaction from cell moments: one row per (key, effect).

    The samples are reduced to one row per cell in the cluster; the least-squares solve sees only cells.
    """
    from pulsegrid.functions.distributions import type_two_rows
    keys = list(keys)
    cells = (long.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("value").isNotNull())
             .groupBy(*keys, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b"))
             .agg(F.count("*").alias("_n"), F.avg("value").alias("_m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("_v")))
    schema = ", ".join([f"{k} {dict(long.dtypes)[k]}" for k in keys] + ["effect string", "ss double", "df long", "f_stat double", "df_error long"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = type_two_rows(pdf["_a"], pdf["_b"], pdf["_n"], pdf["_m"], pdf["_v"], min_n)
        out = pd.DataFrame(rows, columns=["effect", "ss", "df", "f_stat", "df_error"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out
    return cells.groupBy(*keys).applyInPandas(solve, schema)


def with_two_way_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", tails.f_tail(F.col("f_stat"), F.col("df"), F.col("df_error")))


def shapiro(long: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str]) -> DataFrame:
    """Shapiro–Wilk W and p (Royston). Ranks are assigned across tasks, the weights are summed per key."""
    from pulsegrid.functions.distributions import royston_p
    keys = list(keys)
    placed = O.positions(long.where(F.col(value).isNotNull()), keys, value, ids, "_i", total="_n")
    i, n, x = F.col("_i"), F.col("_n"), F.col(value).cast("double")
    m = placed.withColumn("_m", tails.normal_quantile((i - 0.375) / (n + 0.25)))
    mid = (i > 2) & (i < n - 1)
    take = lambda cond, c: F.max(F.when(cond, c))
    g = m.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.sum(F.col("_m") * F.col("_m")).alias("mm"), (F.var_pop(x) * F.count(x)).alias("ss"),
        F.sum(F.when(mid, F.col("_m") * x)).alias("mid"),
        take(i == 1, x).alias("x1"), take(i == 2, x).alias("x2"), take(i == n - 1, x).alias("y2"), take(i == n, x).alias("y1"),
        take(i == n, F.col("_m")).alias("m1"), take(i == n - 1, F.col("_m")).alias("m2"))
    columns = ["n", "mm", "ss", "mid", "x1", "x2", "y2", "y1", "m1", "m2"]

    @F.pandas_udf("struct<w_stat double, p_value double>")
    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([royston_p(**r) for r in rows.to_dict("records")], columns=["w_stat", "p_value"])
    out = g.where("n >= 3").withColumn("_r", finish(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])))
    return out.select(*keys, "n", "_r.w_stat", "_r.p_value", (F.col("_r.p_value") > 0.05).alias("normal"))


def probability_plot(long: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str]) -> DataFrame:
    """Ordered values against normal order-statistic medians (Filliben)."""
    placed = O.positions(long.where(F.col(value).isNotNull()), keys, value, ids, "_i", total="_n")
    i, n = F.col("_i"), F.col("_n")
    top = F.pow(F.lit(0.5), 1.0 / n)
    p = F.when(i == n, top).when(i == 1, 1.0 - top).otherwise((i - 0.3175) / (n + 0.365))
    return placed.select(*keys, *ids, F.col(value).alias("ordered"), tails.normal_quantile(p).alias("theoretical"))
