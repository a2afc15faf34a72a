"""Column expressions: missing values, predicates, group and dose rules, QTc formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from pulsegrid.functions import constants as C


def nan_to_null(c: Column) -> Column:
    """Missing is NULL everywhere: NaN compares as the largest value in Spark and would pass gates."""
    return F.when(~F.isnan(c), c)


def contains_any(text: Column, words) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def micros(column: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


# ---- clean predicates ------------------------------------------------------------------------------------
def is_clean_rhythm(status: Column, rr_cv: Column) -> Column:
    return F.coalesce((status == "OK") & (rr_cv <= C.RR_CV_CLEAN), F.lit(False))


def is_clean_strict(status: Column, *flags: Column) -> Column:
    ok = reduce(lambda a, b: a & (b == 1), flags, status == "OK")
    return F.coalesce(ok, F.lit(False))


def triage_tier(status: Column, hr: Column, rr_cv: Column) -> Column:
    cv = F.coalesce(rr_cv, F.lit(99.0))
    in_band = F.coalesce(hr.between(*C.HR_ACCEPT), F.lit(False))
    return (F.when((status != "OK") | ~in_band | (cv > 0.60), "DROP")
             .when(cv <= 0.25, "KEEP").otherwise("REVIEW"))


def plausible(r_amp: Column, hr: Column) -> Column:
    return F.coalesce(r_amp.between(0.1, 1.2) & hr.between(250, 800), F.lit(False))


# ---- groups and doses ------------------------------------------------------------------------------------
def treatment_group(dox: Column, etn: Column) -> Column:
    """No dox means Control; with dox the etn dose decides; an unknown dose gives NULL."""
    arm = F.when(etn == 0, "Dox")
    for dose in C.ETN_DOSES:
        arm = arm.when(etn == dose, f"Dox+Etn{dose:g}")
    return F.when(dox.isNull() | (dox == 0), "Control").otherwise(arm)


def dose_of_group(group: Column) -> Column:
    """NULL stays NULL; a name that is no arm is an error."""
    known = F.create_map(*[x for k, v in C.DOSE_BY_GROUP.items() for x in (F.lit(k), F.lit(v))])
    return (F.when(group.isNull(), F.lit(None).cast("double"))
             .when(group.isin(*C.GROUPS), F.element_at(known, group))
             .otherwise(F.raise_error(F.concat(F.lit("unknown group: "), group)).cast("double")))


def dose_rank(group: Column, with_control: bool = True) -> Column:
    ranks = {"Control": 0 if with_control else None, "Dox": 0, "Dox+Etn1.6": 1, "Dox+Etn16": 2, "Dox+Etn160": 3}
    out = F.lit(None).cast("int")
    for name, r in ranks.items():
        if r is not None:
            out = F.when(group == name, F.lit(r)).otherwise(out)
    return out


def labelling(group: Column, kind: str) -> Column:
    """Class labels of the supervised tasks; NULL drops the row."""
    if kind == "five_groups":
        return group
    if kind == "any_dox_vs_control":
        return F.when(group == "Control", "Control").otherwise("Dox")
    if kind == "dox_vs_any_etn":
        return F.when(group == "Dox", "Dox").when(group.startswith("Dox+Etn"), "DoxEtn")
    if kind == "high_etn_vs_rest":
        return F.when(group.isin("Dox+Etn16", "Dox+Etn160"), "highEtn").otherwise("rest")
    if kind == "control_vs_dox":
        return F.when(group.isin("Control", "Dox"), group)
    raise ValueError(kind)


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def mean_sd_text(mean: Column, sd: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f +/- %.{digits}f", mean, sd)


# ---- QT correction ---------------------------------------------------------------------------------------
def qtc_mitchell(qt: Column, rr_ms: Column) -> Column:
    return F.when(rr_ms > 0, qt / F.sqrt(rr_ms / 100.0))


def qtc_family(qt: Column, rr_ms: Column, hr: Column) -> dict[str, Column]:
    rr_s = rr_ms / 1000.0
    return {
        "Raw": qt,
        "Bazett": qt / F.sqrt(rr_s),
        "Fridericia": qt / F.cbrt(rr_s),
        "Framingham": qt + 154.0 * (1.0 - rr_s),
        "Hodges": qt + 1.75 * (hr - 60.0),
        "Mitchell": qt / F.sqrt(rr_ms / 100.0),
    }


# ---- null rules and cause flags --------------------------------------------------------------------------
def null_where(df, condition: Column, columns):
    """Set ``columns`` to NULL where ``condition`` is true (NULL conditions keep the value)."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns})


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")
