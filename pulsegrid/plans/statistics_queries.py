"""Test and effect-size queries. Arms are order priorities, studies order states, doses discount bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.distributions import detectable_effect
from pulsegrid.operators import effects as E, inference as S, ordered as O, relational as R
from pulsegrid.plans.registry import query

LONG = """long AS (SELECT o_orderstatus AS study, 'price' AS parameter, o_orderpriority AS arm, o_totalprice AS value FROM orders
 UNION ALL SELECT o_orderstatus, 'balance', o_orderpriority, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey)"""
KEYS = ["study", "parameter"]


def long(t):
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderstatus").alias("study"), F.col("o_orderpriority").alias("arm"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"))
    return R.measurements(m, ["study", "arm"], ["price", "balance"])


DOSE = """dose AS (SELECT l_returnflag AS study, CAST(floor(l_discount * 100 + 0.5) AS INTEGER) // 3 AS level, l_extendedprice AS value FROM lineitem)"""


def dose(t):
    pct = F.floor(F.col("l_discount") * 100 + 0.5).cast("int")
    return t.lineitem.select(F.col("l_returnflag").alias("study"), F.floor(pct / 3).cast("int").alias("level"), F.col("l_extendedprice").alias("value"))


ANOVA = """g AS (SELECT {keys}, arm, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM {src} GROUP BY ALL HAVING count(value) >= 2),
 gm AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS gm FROM g WINDOW w AS (PARTITION BY {keys})),
 f AS (SELECT {keys}, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * (m - gm) ** 2) AS ssb, sum((n - 1) * v) AS ssw FROM gm GROUP BY ALL)"""


@query("anova_f", f"WITH {LONG}, {ANOVA.format(keys='study, parameter', src='long')} SELECT study, parameter, k, n, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f_stat FROM f")
def anova_f(t):
    return S.one_way_anova(long(t), KEYS, "arm").select(*KEYS, "k", "n", F.round("f_stat", 6).alias("f_stat"))


@query("levene_w", f"""WITH {LONG}, md AS (SELECT study, parameter, arm, quantile_cont(value, 0.5) AS md FROM long GROUP BY ALL),
 dv AS (SELECT study, parameter, arm, abs(value - md) AS value FROM long JOIN md USING (study, parameter, arm)), {ANOVA.format(keys='study, parameter', src='dv')}
SELECT study, parameter, k, n, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS w_stat FROM f""")
def levene_w(t):
    return S.levene(long(t), KEYS, "arm").select(*KEYS, "k", "n", F.round("w_stat", 6).alias("w_stat"))


RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY study, parameter ORDER BY value) + (count(*) OVER (PARTITION BY study, parameter, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY study, parameter, value) AS ties FROM {src})"


@query("kruskal_h", f"""WITH {LONG}, {RANKED.format(src='long')}, a AS (SELECT study, parameter, arm, sum(rk) AS r, count(*) AS n, sum((CAST(ties AS DOUBLE) ** 3 - ties) / ties) AS tie FROM r GROUP BY ALL),
 g AS (SELECT study, parameter, count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS q, sum(tie) AS tie FROM a GROUP BY ALL)
SELECT study, parameter, k, CAST(n AS BIGINT) AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n ** 3 - n)), 5) AS h_stat FROM g""")
def kruskal_h(t):
    return S.kruskal(long(t), KEYS, "arm").withColumn("h_stat", F.round("h_stat", 5))


JT = """c AS (SELECT study, value, {c} FROM dose GROUP BY ALL),
 b AS (SELECT *, {b} FROM c WINDOW w AS (PARTITION BY study ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 u AS (SELECT study, sum({u}) AS u, {n} FROM b GROUP BY study)""".format(
    c=", ".join(f"CAST(count(CASE WHEN level = {i} THEN 1 END) AS DOUBLE) AS c{i}" for i in range(4)),
    b=", ".join(f"coalesce(sum(c{i}) OVER w, 0) AS b{i}" for i in range(4)),
    u=" + ".join(f"c{j} * ({' + '.join(f'b{i} + c{i} / 2' for i in range(j))})" for j in range(1, 4)),
    n=", ".join(f"sum(c{i}) AS n{i}" for i in range(4)))
N4 = "(n0 + n1 + n2 + n3)"
JT_Z = f"(u - ({N4} ** 2 - n0 ** 2 - n1 ** 2 - n2 ** 2 - n3 ** 2) / 4) / sqrt(({N4} ** 2 * (2 * {N4} + 3) - n0 ** 2 * (2 * n0 + 3) - n1 ** 2 * (2 * n1 + 3) - n2 ** 2 * (2 * n2 + 3) - n3 ** 2 * (2 * n3 + 3)) / 72)"


@query("jonckheere_z", f"WITH {DOSE}, {JT} SELECT study, round(u, 1) AS u_stat, CAST({N4} AS BIGINT) AS n, round({JT_Z}, 6) AS z_stat FROM u")
def jonckheere_z(t):
    return S.jonckheere(dose(t), ["study"], "level", 4).select("study", F.round("u_stat", 1).alias("u_stat"), "n", F.round("z_stat", 6).alias("z_stat"))


LOO = """WITH x AS (SELECT c_custkey AS id, c_nationkey % 3 AS level, c_mktsegment AS study, c_acctbal AS value FROM customer),
 s AS (SELECT a.study, a.id, a.level, sum(CASE WHEN a.level = b.level THEN 0.0 WHEN (b.value > a.value) = (b.level > a.level) AND b.value <> a.value THEN 1.0 WHEN b.value = a.value THEN 0.5 ELSE 0.0 END) AS share FROM x a JOIN x b USING (study) GROUP BY ALL),
 n AS (SELECT study, CAST(count(CASE WHEN level = 0 THEN 1 END) AS DOUBLE) AS n0, CAST(count(CASE WHEN level = 1 THEN 1 END) AS DOUBLE) AS n1, CAST(count(CASE WHEN level = 2 THEN 1 END) AS DOUBLE) AS n2 FROM x GROUP BY 1),
 u AS (SELECT study, sum(share) / 2 AS u FROM s GROUP BY 1),
 l AS (SELECT study, u - share AS u, n0 - (level = 0)::INT AS n0, n1 - (level = 1)::INT AS n1, n2 - (level = 2)::INT AS n2 FROM s JOIN u USING (study) JOIN n USING (study)),
 z AS (SELECT study, (u - ((n0 + n1 + n2) ** 2 - n0 ** 2 - n1 ** 2 - n2 ** 2) / 4) / sqrt(((n0 + n1 + n2) ** 2 * (2 * (n0 + n1 + n2) + 3) - n0 ** 2 * (2 * n0 + 3) - n1 ** 2 * (2 * n1 + 3) - n2 ** 2 * (2 * n2 + 3)) / 72) AS z FROM l),
 za AS (SELECT study, (u - ((n0 + n1 + n2) ** 2 - n0 ** 2 - n1 ** 2 - n2 ** 2) / 4) / sqrt(((n0 + n1 + n2) ** 2 * (2 * (n0 + n1 + n2) + 3) - n0 ** 2 * (2 * n0 + 3) - n1 ** 2 * (2 * n1 + 3) - n2 ** 2 * (2 * n2 + 3)) / 72) AS z FROM u JOIN n USING (study))
SELECT study, round(any_value(za.z), 6) AS z_all, round(min(z.z), 6) AS z_min, round(max(z.z), 6) AS z_max FROM z JOIN za USING (study) GROUP BY 1"""


@query("jonckheere_leave_one_out", LOO)
def jonckheere_leave_one_out(t):
    x = t.customer.select((F.col("c_nationkey") % 3).alias("level"), F.col("c_mktsegment").alias("study"), F.col("c_acctbal").alias("value"))
    r = S.jonckheere_leave_one_out(x, ["study"], "level", 3)
    return r.select("study", *[F.round(c, 6).alias(c) for c in ("z_all", "z_min", "z_max")])


@query("spearman_rho", f"""WITH {DOSE}, r AS (SELECT study, rank() OVER (PARTITION BY study ORDER BY value) + (count(*) OVER (PARTITION BY study, value) - 1) / 2.0 AS rv,
 rank() OVER (PARTITION BY study ORDER BY level) + (count(*) OVER (PARTITION BY study, level) - 1) / 2.0 AS rl FROM dose) SELECT study, count(*) AS n, round(corr(rv, rl), 6) AS rho FROM r GROUP BY 1""")
def spearman_rho(t):
    return S.spearman(dose(t), ["study"], "level").withColumn("rho", F.round("rho", 6))


@query("mann_whitney_u", f"""WITH {LONG}, two AS (SELECT * FROM long WHERE arm IN ('1-URGENT', '5-LOW')), {RANKED.format(src='two')},
 a AS (SELECT study, parameter, sum(CASE WHEN arm = '1-URGENT' THEN rk END) AS ra, count(CASE WHEN arm = '1-URGENT' THEN 1 END) AS na, count(CASE WHEN arm = '5-LOW' THEN 1 END) AS nb FROM r GROUP BY ALL)
SELECT study, parameter, na AS n_a, nb AS n_b, round(ra - na * (na + 1) / 2.0, 2) AS u_stat, round(1 - 2 * (ra - na * (na + 1) / 2.0) / (na * nb), 6) AS rank_biserial FROM a""")
def mann_whitney_u(t):
    m = S.mann_whitney(long(t), KEYS, "arm", "1-URGENT", "5-LOW")
    return m.select(*KEYS, "n_a", "n_b", F.round("u_stat", 2).alias("u_stat"), F.round("rank_biserial", 6).alias("rank_biserial"))


@query("chi_square", """
WITH c AS (SELECT o_orderpriority AS r, o_orderstatus AS c, CAST(count(*) AS DOUBLE) AS o FROM orders GROUP BY 1, 2),
 m AS (SELECT *, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM c)
SELECT CAST(any_value(n) AS BIGINT) AS n, round(sum((o - e) ** 2 / e), 6) AS chi2, CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS INTEGER) AS dof FROM m""")
def chi_square(t):
    return S.chi_square(t.orders, [], "o_orderpriority", "o_orderstatus").withColumn("chi2", F.round("chi2", 6))


@query("chi_square_yates", """
WITH x AS (SELECT l_returnflag AS study, l_linestatus = 'F' AS r, l_quantity > 25 AS c FROM lineitem),
 k AS (SELECT study, r, c, CAST(count(*) AS DOUBLE) AS o FROM x GROUP BY ALL),
 m AS (SELECT *, sum(o) OVER (PARTITION BY study, r) * sum(o) OVER (PARTITION BY study, c) / sum(o) OVER (PARTITION BY study) AS e, sum(o) OVER (PARTITION BY study) AS n FROM k)
SELECT study, CAST(any_value(n) AS BIGINT) AS n, round(sum((abs(o - e) - CASE WHEN nr = 2 AND nc = 2 THEN least(0.5, abs(o - e)) ELSE 0 END) ** 2 / e), 6) AS chi2, CAST((any_value(nr) - 1) * (any_value(nc) - 1) AS INTEGER) AS dof
FROM m JOIN (SELECT study, count(DISTINCT r) AS nr, count(DISTINCT c) AS nc FROM x GROUP BY 1) USING (study) GROUP BY study""")
def chi_square_yates(t):
    x = t.lineitem.select(F.col("l_returnflag").alias("study"), (F.col("l_linestatus") == "F").alias("r"), (F.col("l_quantity") > 25).alias("c"))
    return S.chi_square(x, ["study"], "r", "c").withColumn("chi2", F.round("chi2", 6))


@query("pearson_r", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 8) AS r, count(*) AS n FROM lineitem GROUP BY 1")
def pearson_r(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_extendedprice", "l_quantity"), 8).alias("r"), F.count("*").alias("n"))


@query("bland_altman", """
WITH d AS (SELECT l_returnflag AS study, l_extendedprice / 2000 AS a, l_quantity AS b FROM lineitem),
 g AS (SELECT study, count(*) AS n, avg(a - b) AS bias, stddev_samp(a - b) AS sd, corr(a - b, (a + b) / 2) AS r FROM d GROUP BY 1)
SELECT study, n, round(bias, 6) AS bias, round(bias - 1.96 * sd, 6) AS loa_low, round(bias + 1.96 * sd, 6) AS loa_high, round(r, 6) AS r_bias, CASE WHEN abs(r) < 0.3 THEN 'none' ELSE 'proportional' END AS bias_kind FROM g""")
def bland_altman(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("study"), (F.col("l_extendedprice") / 2000).alias("a"), F.col("l_quantity").alias("b"))
    r = S.bland_altman(d, ["study"], "a", "b")
    return r.select("study", "n", "bias_kind", *[F.round(c, 6).alias(c) for c in ("bias", "loa_low", "loa_high", "r_bias")])


MOM = f"""{LONG}, mo AS (SELECT study, parameter, count(CASE WHEN arm = '1-URGENT' THEN value END) AS na, avg(CASE WHEN arm = '1-URGENT' THEN value END) AS ma, var_samp(CASE WHEN arm = '1-URGENT' THEN value END) AS va,
 count(CASE WHEN arm = '5-LOW' THEN value END) AS nb, avg(CASE WHEN arm = '5-LOW' THEN value END) AS mb, var_samp(CASE WHEN arm = '5-LOW' THEN value END) AS vb FROM long GROUP BY ALL),
 ps AS (SELECT *, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS sp, sqrt(va / na + vb / nb) AS se FROM mo)"""


def moments(t):
    return S.two_arm_moments(long(t), KEYS, "arm", "1-URGENT", "5-LOW")


@query("tost_t", f"""WITH {MOM} SELECT study, parameter, round(0.5 * sp, 4) AS margin, round(ma - mb, 4) AS diff, round((ma - mb + 0.5 * sp) / se, 6) AS t_low, round((ma - mb - 0.5 * sp) / se, 6) AS t_high, na + nb - 2 AS df FROM ps""")
def tost_t(t):
    e = S.equivalence(moments(t))
    return e.select(*KEYS, F.round("margin", 4).alias("margin"), F.round("diff", 4).alias("diff"), F.round("t_low", 6).alias("t_low"), F.round("t_high", 6).alias("t_high"), "df")


@query("effect_sizes", f"""WITH {MOM}, d AS (SELECT *, (ma - mb) / sp AS d, 1.96 * sqrt((na + nb) / CAST(na * nb AS DOUBLE) + ((ma - mb) / sp) ** 2 / (2.0 * (na + nb))) AS h FROM ps)
SELECT study, parameter, round(ma - mb, 4) AS diff, round(se, 4) AS se, round(d, 7) AS cohen_d, round(d * (1 - 3 / (4.0 * (na + nb) - 9)), 7) AS hedges_g, round(d - h, 6) AS d_low, round(d + h, 6) AS d_high FROM d""")
def effect_sizes(t):
    e = E.effect_sizes(moments(t))
    return e.select(*KEYS, F.round("diff", 4).alias("diff"), F.round("se", 4).alias("se"), F.round("cohen_d", 7).alias("cohen_d"),
                    F.round("hedges_g", 7).alias("hedges_g"), F.round("d_low", 6).alias("d_low"), F.round("d_high", 6).alias("d_high"))


@query("tukey_q", f"""WITH {LONG}, g AS (SELECT study, parameter, arm, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM long GROUP BY ALL),
 s AS (SELECT study, parameter, sum((n - 1) * v) / (sum(n) - count(*)) AS mse, count(*) AS k, CAST(sum(n) AS BIGINT) AS nt FROM g GROUP BY ALL),
 c AS (SELECT study, parameter, m AS mc, n AS nc FROM g WHERE arm = '5-LOW')
SELECT study, parameter, arm, round(m - mc, 4) AS diff, round(abs(m - mc) / sqrt(mse / 2 * (1.0 / n + 1.0 / nc)), 6) AS q_stat, k, nt - k AS df FROM g JOIN s USING (study, parameter) JOIN c USING (study, parameter) WHERE arm <> '5-LOW'""")
def tukey_q(t):
    q = S.tukey_vs_control(long(t), KEYS, "arm", "5-LOW")
    return q.select(*KEYS, "arm", F.round("diff", 4).alias("diff"), F.round("q_stat", 6).alias("q_stat"), "k", "df")


@query("ols_slope", f"WITH {DOSE} SELECT study, round(regr_slope(value, level), 5) AS slope, round(regr_intercept(value, level), 4) AS intercept FROM dose GROUP BY 1")
def ols_slope(t):
    return E.ols_slope(dose(t), ["study"], "level").select("study", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("power_mde", "SELECT c_mktsegment AS parameter, count(*) AS n_animals, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round(100 * stddev_samp(c_acctbal) / avg(c_acctbal), 6) AS cv_pct, "
       + ", ".join(f"round(CAST({detectable_effect(n)!r} AS DOUBLE) * stddev_samp(c_acctbal), 4) AS mde_n{n}, round(100 * CAST({detectable_effect(n)!r} AS DOUBLE) * stddev_samp(c_acctbal) / avg(c_acctbal), 5) AS mde_n{n}_pct" for n in (23, 12, 6))
       + " FROM customer GROUP BY 1 HAVING count(*) >= 10")
def power_mde(t):
    p = E.power_table(t.customer.select(F.col("c_mktsegment").alias("parameter"), F.col("c_acctbal").alias("value")), ["parameter"])
    digits = {"n_animals": None, "cv_pct": 6, "mean": 4, "sd": 4}
    return p.select("parameter", "n_animals", *[F.round(c, digits.get(c, 5 if c.endswith("_pct") else 4)).alias(c) for c in p.columns if c not in ("parameter", "n_animals")])


@query("sem_by_arm", f"WITH {LONG} SELECT study, parameter, arm, round(stddev_samp(value) / sqrt(count(value)), 5) AS sem, round(stddev_pop(value) / sqrt(count(value)), 5) AS sem_pop FROM long GROUP BY ALL")
def sem_by_arm(t):
    n = F.sqrt(F.count("value"))
    return long(t).groupBy(*KEYS, "arm").agg(F.round(F.stddev_samp("value") / n, 5).alias("sem"), F.round(F.stddev_pop("value") / n, 5).alias("sem_pop"))


HL = """WITH x AS (SELECT s_nationkey % 2 AS study, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS level, s_acctbal AS value FROM supplier)
SELECT a.study, round(median(b.value - a.value), 4) AS median FROM x a JOIN x b ON a.study = b.study AND a.level = 0 AND b.level = 1 GROUP BY 1"""


@query("hodges_lehmann", HL)
def hodges_lehmann(t):
    x = t.supplier.select((F.col("s_nationkey") % 2).alias("study"), F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(1).alias("level"), F.col("s_acctbal").alias("value"))
    return E.median_pairwise_slope(x, ["study"], "level", 2).withColumn("median", F.round("median", 4))


@query("theil_sen", """WITH x AS (SELECT s_nationkey % 2 AS study, s_suppkey % 3 AS level, s_acctbal AS value FROM supplier)
SELECT a.study, round(median((b.value - a.value) / (b.level - a.level)), 4) AS median FROM x a JOIN x b ON a.study = b.study AND b.level > a.level GROUP BY 1""")
def theil_sen(t):
    x = t.supplier.select((F.col("s_nationkey") % 2).alias("study"), (F.col("s_suppkey") % 3).cast("int").alias("level"), F.col("s_acctbal").alias("value"))
    return E.median_pairwise_slope(x, ["study"], "level", 3).withColumn("median", F.round("median", 4))


@query("test_p_values")
def test_p_values(t):
    """p-values of the closed-form tests; the statistics behind them are compared with SQL above."""
    l = long(t)
    rows = [S.with_f_p(S.one_way_anova(l, KEYS, "arm")).select(*KEYS, F.lit("anova").alias("test"), "p_value"),
            S.with_chi2_p(S.kruskal(l, KEYS, "arm"), "h_stat", F.col("k") - 1).select(*KEYS, F.lit("kruskal").alias("test"), "p_value"),
            S.with_f_p(S.levene(l, KEYS, "arm"), "w_stat").select(*KEYS, F.lit("levene").alias("test"), "p_value"),
            S.with_equivalence_p(S.equivalence(moments(t))).select(*KEYS, F.lit("tost").alias("test"), "p_value")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("tukey_p")
def tukey_p(t):
    return S.with_tukey_p(S.tukey_vs_control(long(t), KEYS, "arm", "5-LOW"))


@query("two_way_anova")
def two_way_anova(t):
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderstatus").alias("study"), F.col("o_orderpriority").alias("arm"), F.col("c_mktsegment").alias("sex"), F.col("o_totalprice").alias("value"))
    return S.with_two_way_p(S.two_way_anova(m, ["study"], "arm", "sex"))


@query("shapiro_wilk")
def shapiro_wilk(t):
    return S.shapiro(t.customer.select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], "c_acctbal", ["c_custkey"])


# Numerators and denominators of Wichura's percentage points of the normal distribution (AS 241), centre and tail.
CENTRE = ([2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4,
           1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0],
          [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3,
           6.8718700749205790830e2, 4.2313330701600911252e1, 1.0])
TAIL = ([7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0,
         5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0],
        [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1,
         1.67638483018380384940e0, 2.05319162663775882187e0, 1.0])


def ratio_sql(tables, r: str) -> str:
    """Quotient of two polynomials in ``r``, highest power first, as SQL."""
    both = [" + ".join(f"CAST({c!r} AS DOUBLE) * pow({r}, {len(t) - 1 - i})" for i, c in enumerate(t)) for t in tables]
    return f"(({both[0]}) / ({both[1]}))"


@query("probability_plot", f"""WITH o AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
 p AS (SELECT *, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE CAST(i - 0.3175 AS DOUBLE) / (n + 0.365) END AS p FROM o),
 q AS (SELECT *, 0.180625 - (p - 0.5) * (p - 0.5) AS r, sqrt(-ln(least(p, 1 - p))) - 1.6 AS far FROM p)
SELECT c_mktsegment, c_custkey, c_acctbal AS ordered, round(CASE WHEN r >= 0 THEN (p - 0.5) * {ratio_sql(CENTRE, "r")} ELSE sign(p - 0.5) * {ratio_sql(TAIL, "far")} END, 6) AS theoretical FROM q""")
def probability_plot(t):
    p = S.probability_plot(t.customer.select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], "c_acctbal", ["c_custkey"])
    return p.withColumn("theoretical", F.round("theoretical", 6))


@query("rope", f"""WITH {MOM}, z AS (SELECT study, parameter, w, greatest(-10, least(10, (-w * sp - (ma - mb)) / se)) AS a, greatest(-10, least(10, (w * sp - (ma - mb)) / se)) AS b FROM ps, (SELECT unnest([0.5::DOUBLE, 0.02::DOUBLE]) AS w)),
 s AS (SELECT study, parameter, w, sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-((a + (b - a) * k / 2000) ** 2) / 2)) * any_value(b - a) / 6000 / sqrt(2 * pi()) AS p
  FROM z, (SELECT unnest(range(0, 2001)) AS k) GROUP BY ALL)
SELECT study, parameter, round(max(CASE WHEN w = 0.5 THEN p END), 6) AS p_rope, round(max(CASE WHEN w < 0.5 THEN p END), 6) AS p_rope_narrow FROM s GROUP BY ALL""")
def rope(t):
    """The study's margin of half an SD, and one narrow enough to be undecided on many rows."""
    m = moments(t)
    both = E.rope_probability(E.rope_probability(m, 0.02).withColumnRenamed("p_rope", "p_rope_narrow"))
    return both.select(*KEYS, F.round("p_rope", 6).alias("p_rope"), F.round("p_rope_narrow", 6).alias("p_rope_narrow"))


# the t quantile in SQL is its expansion around the normal one, which four terms carry below the rounding from about 100 rows on
@query("mean_difference_ci", f"""WITH {MOM}, z AS (SELECT *, CAST(na + nb - 2 AS DOUBLE) AS v, CAST(1.959963984540054 AS DOUBLE) AS z FROM ps),
 t AS (SELECT *, z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v ** 2) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * v ** 3)
  + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / (92160 * v ** 4) AS t FROM z)
SELECT study, parameter, round(ma - mb, 4) AS diff, round(ma - mb - t * se, 3) AS ci_low, round(ma - mb + t * se, 3) AS ci_high FROM t""")
def mean_difference_ci(t):
    e = E.with_t_interval(E.effect_sizes(moments(t)))
    return e.select(*KEYS, F.round("diff", 4).alias("diff"), F.round("ci_low", 3).alias("ci_low"), F.round("ci_high", 3).alias("ci_high"))
