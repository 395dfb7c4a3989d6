"""Scalar functions as columns: all stay inside code generation."""

from __future__ import annotations

import unicodedata

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-4


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within the bounds; null stays null, which ``least`` and ``greatest`` alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def logit(p: Column, eps: float = CLIP) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(p: Column, y: Column, eps: float = CLIP) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


#: Constants of the normal distribution function (Abramowitz and Stegun, 26.2.17; error below 7.5e-8).
PHI = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + F.lit(PHI[0]) * F.abs(x))
    poly = t * reduce(lambda acc, c: F.lit(c) + t * acc, reversed(PHI[1:5]), F.lit(PHI[5]))
    tail = 0.3989422804014327 * F.exp(-x * x / 2) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """The same polynomial as SQL text."""
    t = f"(1e0 / (1e0 + {PHI[0]!r}::DOUBLE * abs({x})))"
    poly = f"{PHI[5]!r}::DOUBLE"
    for c in reversed(PHI[1:5]):
        poly = f"({c!r}::DOUBLE + {t} * {poly})"
    tail = f"(0.3989422804014327::DOUBLE * exp(-({x}) * ({x}) / 2e0) * {t} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1e0 - {tail} ELSE {tail} END)"


#: Constants of the inverse normal distribution function (P. J. Acklam's rational approximation; relative error below 1.2e-9).
INV_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INV_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
INV_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INV_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(coefficients, x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, for 0 < p < 1."""
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    outer = _horner(INV_C, tail) / (_horner(INV_D, tail) * tail + 1)
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    inner = _horner(INV_A, r) * q / (_horner(INV_B, r) * r + 1)
    return F.when((p >= 0.02425) & (p <= 0.97575), inner).when(p < 0.5, outer).otherwise(-outer)


def _horner_sql(coefficients, x: str) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {c!r}::DOUBLE)", coefficients[1:], f"{coefficients[0]!r}::DOUBLE")


def normal_quantile_sql(p: str) -> str:
    """The same approximation as SQL text."""
    tail = f"sqrt(-2e0 * ln(least({p}, 1 - {p})))"
    outer = f"({_horner_sql(INV_C, tail)} / ({_horner_sql(INV_D, tail)} * {tail} + 1))"
    q = f"({p} - 0.5)"
    inner = f"({_horner_sql(INV_A, f'({q} * {q})')} * {q} / ({_horner_sql(INV_B, f'({q} * {q})')} * {q} * {q} + 1))"
    return f"(CASE WHEN {p} BETWEEN 0.02425 AND 0.97575 THEN {inner} WHEN {p} < 0.5 THEN {outer} ELSE -{outer} END)"


def t_two_sided(t: Column, freedom: Column) -> Column:
    """Two-sided p of Student's t by Wallace's normal approximation (good to three digits from five degrees of freedom)."""
    z = (8 * freedom + 1) / (8 * freedom + 3) * F.sqrt(freedom * F.log(1 + t * t / freedom))
    return 2 * (1 - normal_cdf(z))


def pick_probability(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def confidence(p: Column, sd: Column, split: Column, early: Column, qb: Column) -> Column:
    """From 1 to 10: certainty less disagreement of members, split picks, an early season and a new starter."""
    return clip(10 * F.pow(F.abs(2 * p - 1), F.lit(0.75)) - 10 * sd - split - 0.75 * early - 0.5 * qb, 1, 10)


def consistent_margin(margin: Column, p: Column, sigma: float) -> Column:
    return 0.5 * margin + 0.5 * sigma * normal_quantile(clip(p, 0.001, 0.999))


def season_of(day: Column, first_month: int = 7) -> Column:
    return F.year(day) - F.when(F.month(day) < first_month, 1).otherwise(0)


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def fraction_part(text: Column, part: int) -> Column:
    """"a-b" or "a/b": the number at ``part``; null if the text isn't two parts of numbers."""
    parts = F.split(F.replace(text, F.lit("/"), F.lit("-")), "-")
    return F.when(F.size(parts) == 2, parts[part].try_cast("double"))



def _ascii_forms() -> dict[str, str]:
    """Characters beyond ASCII with the ASCII part of their compatibility decomposition, where they have any."""
    forms = ((chr(i), unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()) for i in range(128, 0x1FBFA) if not 0xD800 <= i < 0xE000)
    return {c: to for c, to in forms if to}


_FORMS = _ascii_forms()
#: One to one, for ``translate``; and the ligatures, digraphs, fractions and letter-like signs, of more characters each. Other forms of more
#: characters (squared and circled words) are dropped.
ACCENTED, FOLDED = ("".join(x) for x in zip(*((c, to) for c, to in _FORMS.items() if len(to) == 1)))
LIGATURES = {c: to for c, to in _FORMS.items() if len(to) > 1 and (c < "\u0250" or "\u2100" <= c <= "\u218f" or "\ufb00" <= c <= "\ufb06")}


def normal_name(text: Column) -> Column:
    """Compatibility forms folded to ASCII, what has no ASCII form dropped; lower case; letters, digits, & and brackets; single spaces."""
    folded = F.translate(text, ACCENTED, FOLDED)
    for c, to in LIGATURES.items():
        folded = F.replace(folded, F.lit(c), F.lit(to))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]", "")).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9&()]+", " "))


def down_bucket(down: Column) -> Column:
    return clip(F.coalesce(down, F.lit(1)), 1, 4).cast("int")


def field_bucket(ytez: Column) -> Column:
    return F.floor(clip(F.coalesce(ytez, F.lit(75)), 1, 99) / 5).cast("int")


def distance_bucket(dist: Column, edges=(3, 6, 10, 15)) -> Column:
    d = F.coalesce(dist, F.lit(10))
    return reduce(lambda acc, i: F.when(d <= edges[i], i).otherwise(acc), reversed(range(len(edges))), F.lit(len(edges)))


def half_of(period: Column) -> Column:
    return F.when(period.isin(1, 2), 1).when(period.isin(3, 4), 2).otherwise(3)


def success(down: Column, dist: Column, yds: Column) -> Column:
    y = F.coalesce(yds, F.lit(0))
    return F.when(down == 1, y >= 0.5 * dist).when(down == 2, y >= 0.7 * dist).otherwise(y >= dist)


def lenient_number(text: Column) -> Column:
    """A number, or the value or displayValue of a JSON object, else null."""
    return F.coalesce(text.try_cast("double"), F.get_json_object(text, "$.value").try_cast("double"), F.get_json_object(text, "$.displayValue").try_cast("double"))
