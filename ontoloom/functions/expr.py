"""Scores, curves and dates as Column expressions: all built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default where b is zero or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio_s_curve(x: Column) -> Column:
    """x^2 / (x^2 + (1-x)^2): fixes 0, 1/2 and 1."""
    return x * x / (x * x + (1 - x) * (1 - x))


def concave(x: Column) -> Column:
    """(2 - x) x: lifts scores that lie below one."""
    return (2 - x) * x


def power_s_curve(x: Column, pivot: float = 0.3, degree: int = 2) -> Column:
    """Two power branches that meet, and keep their value, at the pivot; the input is clipped to [0, 1]."""
    x = clip(x, 0.0, 1.0)
    low = F.pow(x, degree) / pivot ** (degree - 1)
    return F.when(x <= pivot, low).otherwise(1 - F.pow(1 - x, degree) / (1 - pivot) ** (degree - 1))


def count_s_curve(x: Column, total: Column, pivot: float, degree: int) -> Column:
    """The curve over counts from 0 to total, with the pivot kept half a count away from either end."""
    share = F.greatest(F.lit(0.5), F.least(F.lit(float(pivot)), total - 0.5)) / total
    t = x / total
    low = F.pow(t, degree) / F.pow(share, degree - 1)
    return F.when(t <= share, low).otherwise(1 - F.pow(1 - t, degree) / F.pow(1 - share, degree - 1))


def tanh_scale(x: Column, median: Column, epsilon: float = 0.01) -> Column:
    """tanh(k x), with k such that twice the median scores 1 - epsilon."""
    return F.tanh(F.log(F.lit(2 / epsilon - 1)) / (4 * median) * x)


def averaged(score: Column, n: Column, mode: str) -> Column:
    """A sum over n parts, as it is ("none"), per part ("linear") or per ln(1 + n) ("log"); n = 0 counts as 1."""
    n = F.when(n == 0, F.lit(1.0)).otherwise(n.cast("double"))
    if mode == "none":
        return score
    if mode == "linear":
        return score / n
    if mode == "log":
        return score / F.log1p(n)
    raise ValueError(f"unknown averaging mode {mode}")


def blended(s1: Column, n1: Column, s2: Column, n2: Column, mode: str, coefficients: tuple[float, float] | None) -> Column:
    """Two averaged scores under their coefficients, or pooled over both without coefficients."""
    if coefficients is None:
        return averaged(s1 + s2, n1 + n2, mode)
    c1, c2 = coefficients
    return (c1 * averaged(s1, n1, mode) + c2 * averaged(s2, n2, mode)) / (c1 + c2)


def rarity(n: Column) -> Column:
    return 1 / (1 + F.log(n))


def manual_blend(manual: Column, nlp: Column) -> Column:
    """A manual score lifted by what was detected: base^(1 - nlp/2)."""
    return F.pow(F.greatest(manual, 0.9 * manual + 0.1 * nlp), 1 - nlp / 2)


def distance_affinity(d: Column, k: float = 1.0) -> Column:
    """1 - tanh(d / k), written so that it stays exact for large d."""
    return 2 / (1 + F.exp(2 * d / k))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return safe_div(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def text_distance(cos: Column, mean_length: Column) -> Column:
    """(1 - cosine) damped for short texts."""
    return (1 - cos) * (1 - F.exp(-mean_length / 16))


def date_position(d: Column, start: Column, end: Column) -> Column:
    """Where a date lies between two others, from 0 to 1, clipped."""
    micros = lambda x: F.unix_micros(x.cast("timestamp")).cast("double")
    return clip(safe_div(micros(d) - micros(start), micros(end) - micros(start)), 0.0, 1.0)


def whole_days(since: Column, until: Column) -> Column:
    return F.floor((F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 86_400_000_000)


def parse_bool(x: Column) -> Column:
    """The usual words for true and false, whatever the case; others are an error."""
    low = F.lower(F.trim(x))
    return (
        F.when(low.isin("y", "yes", "t", "true", "on", "1"), True)
        .when(low.isin("n", "no", "f", "false", "off", "0"), False)
        .when(low.isNotNull(), F.raise_error(F.concat(F.lit("not a truth value: "), low)).cast("boolean"))
    )


def year_of_text(text: Column, least: int = 1900) -> Column:
    """The year of a date written year first; what is no date, and null, counts as the least year."""
    return F.coalesce(F.year(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))), F.lit(least))
