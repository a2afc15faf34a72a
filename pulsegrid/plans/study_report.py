"""Master table to result tables: one unpivot, then every test is a grouped aggregation over (study, parameter)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import columns as X, constants as C
from pulsegrid.operators import inference as S, relational as R

KEYS = ["study", "parameter"]


def clean_long(master: DataFrame, parameters=C.TESTED_PARAMETERS) -> DataFrame:
    """Clean animals as (animal_id, study, group, dose, level, sex, parameter, value)."""
    clean = master.where(X.is_clean_rhythm(F.col("status"), F.col("rr_cv")) & F.col("group").isNotNull())
    wide = clean.withColumns({"dose": X.dose_of_group(F.col("group")), "level": F.array_position(F.array(*[F.lit(g) for g in C.GROUPS]), F.col("group")).cast("int") - 1})
    return R.measurements(wide, ["animal_id", "study", "group", "dose", "level", "sex"], parameters)


def summary(long: DataFrame) -> DataFrame:
    names = {g: g.lower().replace("+", "_").replace(".", "_") for g in C.GROUPS}
    return R.arm_summary(long, KEYS, "group", names, digits=6)


def one_way(long: DataFrame) -> DataFrame:
    """ANOVA, Kruskal–Wallis, Levene and normality per study and parameter."""
    a = S.with_f_p(S.one_way_anova(long, KEYS, "group")).select(*KEYS, F.col("f_stat").alias("anova_f"), F.col("p_value").alias("anova_p"))
    k = S.with_chi2_p(S.kruskal(long, KEYS, "group"), "h_stat", F.col("k") - 1).select(*KEYS, F.col("h_stat").alias("kruskal_h"), F.col("p_value").alias("kruskal_p"))
    v = S.with_f_p(S.levene(long, KEYS, "group"), "w_stat").select(*KEYS, F.col("w_stat").alias("levene_w"), F.col("p_value").alias("levene_p"))
    n = S.shapiro(long, KEYS, "value", ["animal_id"]).select(*KEYS, "w_stat", F.col("p_value").alias("shapiro_p"), "normal")
    out = a.join(k, KEYS, "left").join(v, KEYS, "left").join(n, KEYS, "left")
    return out.withColumn("stars", X.significance_stars(F.col("anova_p")))


def dose_tests(long: DataFrame, with_control: bool = False) -> DataFrame:
    """Spearman against dose; Control is left out unless ``with_control`` (then it counts as dose 0)."""
    rows = long if with_control else long.where("group <> 'Control'")
    return S.with_correlation_p(S.spearman(rows, KEYS, "dose"))


def trend(long: DataFrame) -> DataFrame:
    """Jonckheere–Terpstra over the four dosed arms, Dox first."""
    from pulsegrid.functions.tails import normal_two_sided
    dosed = long.where("level >= 1").withColumn("level", F.col("level") - 1)
    j = S.jonckheere(dosed, KEYS, "level", 4)
    return j.withColumn("p_value", normal_two_sided(F.col("z_stat")))


def two_way(long: DataFrame, a: str = "group") -> DataFrame:
    """Group (or dose) by sex, chronic study only."""
    return S.with_two_way_p(S.two_way_anova(long.where("study = 'chronic'"), KEYS, a, "sex"))


def dose_response(long: DataFrame, keys: list[str], level: str, n_levels: int) -> DataFrame:
    """ANOVA, trend, level means and sizes per named set."""
    a = S.one_way_anova(long, keys, level).select(*keys, "f_stat", "n")
    j = S.jonckheere(long, keys, level, n_levels).select(*keys, "z_stat")
    means = long.groupBy(*keys).agg(*[F.avg(F.when(F.col(level) == i, F.col("value"))).alias(f"mean_{i}") for i in range(n_levels)],
                                    *[F.count(F.when(F.col(level) == i, F.col("value"))).alias(f"n_{i}") for i in range(n_levels)])
    return a.join(j, keys, "left").join(means, keys)


def all_tests(long: DataFrame) -> DataFrame:
    """The wide table of all tests: mean±SD (ddof 0) per dosed arm, then p-values and the Spearman coefficient."""
    names = {g: g.lower().replace("+", "_").replace(".", "_") for g in C.GROUPS[1:]}
    v = F.col("value")
    cells = long.groupBy(*KEYS).agg(*[
        X.mean_sd_text(F.avg(F.when(F.col("group") == g, v)), F.stddev_pop(F.when(F.col("group") == g, v))).alias(n) for g, n in names.items()])
    dosed = long.where("level >= 1")
    a = S.with_f_p(S.one_way_anova(dosed, KEYS, "group", require_arms=4)).select(*KEYS, F.col("p_value").alias("anova_p"))
    k = S.with_chi2_p(S.kruskal(dosed, KEYS, "group"), "h_stat", F.col("k") - 1).select(*KEYS, F.col("p_value").alias("kruskal_p"))
    j = trend(long).select(*KEYS, F.col("p_value").alias("jt_p"))
    s = dose_tests(long, with_control=True).select(*KEYS, F.col("rho").alias("spearman_rho"), F.col("p_value").alias("spearman_p"))
    return a.join(cells, KEYS).join(k, KEYS, "left").join(j, KEYS, "left").join(s, KEYS, "left")


def run(master: DataFrame, store) -> dict[str, DataFrame]:
    """All report tables, written under the store and partitioned by study."""
    long = store.stage("measurements", clean_long(master))
    tables = {"summary": summary(long), "oneway": one_way(long), "doseresponse": dose_tests(long), "twoway": two_way(long), "all_tests": all_tests(long),
              "tukey": S.with_tukey_p(S.tukey_vs_control(long, KEYS, "group", "Control"))}
    return {name: store.stage(name, df, ["study"]) for name, df in tables.items()}
