"""Column helpers with one agreed meaning each: time, rounding, text and null rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time ------------------------------------------------------------------

def minute_boundaries(start: Column | str, end: Column | str) -> Column:
    """Number of minute boundaries between two timestamps (not elapsed minutes).

    00:00:59 to 00:01:01 counts as one, so both sides are truncated first.
    """
    a = F.date_trunc("minute", _col(start)).cast("timestamp_ntz")
    b = F.date_trunc("minute", _col(end)).cast("timestamp_ntz")
    return F.timestamp_diff("MINUTE", a, b)


def hours_between(start: Column | str, end: Column | str) -> Column:
    return minute_boundaries(start, end) / F.lit(60.0)


def plus_hours(ts: Column | str, hours: int | Column) -> Column:
    h = F.lit(hours) if isinstance(hours, int) else hours
    return _col(ts) + F.make_dt_interval(F.lit(0), h.cast("int"))


def in_window(ts: Column | str, start: Column | str, hours: int) -> Column:
    """Half-open window: start <= ts < start + hours."""
    return (_col(ts) >= _col(start)) & (_col(ts) < plus_hours(start, hours))


def age_at(anchor_age: Column | str, anchor_year: Column | str, when: Column | str) -> Column:
    return _col(anchor_age) + (F.year(_col(when)) - _col(anchor_year))


# --- numbers ---------------------------------------------------------------

def half_even(x: Column) -> Column:
    """Round to the nearest integer, ties to even (Spark's ``round`` is half-up)."""
    return F.rint(x).cast("long")


def clip(x: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(lo)), F.lit(hi))


def sigmoid(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))


def logit(p: Column | str, eps: float = 1e-9) -> Column:
    c = clip(p, eps, 1.0 - eps)
    return F.log(c / (F.lit(1.0) - c))


def null_if_nan(x: Column | str) -> Column:
    return F.nanvl(_col(x), F.lit(None).cast("double"))


def fill(x: Column | str, value: float) -> Column:
    """Replace null and NaN by a constant."""
    return F.coalesce(null_if_nan(x), F.lit(value))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def js_divergence(p: Column, q: Column, eps: float = 1e-12) -> Column:
    """Jensen-Shannon divergence (nats) of two Bernoulli rates."""
    total = 1.0 + 2.0 * eps
    pairs = [((F.lit(1.0) - p + eps) / total, (F.lit(1.0) - q + eps) / total),
             ((p + eps) / total, (q + eps) / total)]
    out = F.lit(0.0)
    for a, b in pairs:
        m = (a + b) * 0.5
        out = out + 0.5 * a * F.log(a / m) + 0.5 * b * F.log(b / m)
    return out


# --- text ------------------------------------------------------------------

def age_from_text(age: Column | str, open_bound: str = "> 89", open_value: float = 90.0) -> Column:
    """Top-coded text ages: the open bound gets a number, unreadable text is null."""
    c = _col(age)
    return (F.when(c == open_bound, F.lit(open_value))
            .when(c.isNull() | (c == ""), F.lit(None).cast("double"))
            .otherwise(c.try_cast("double")))


def contains_flag(text: Column | str, token: str) -> Column:
    """1.0 where the text holds the token, 0.0 otherwise (null text counts as empty)."""
    return F.coalesce(_col(text), F.lit("")).contains(token).cast("double")


def equals_flag(text: Column | str, *values: str) -> Column:
    return F.coalesce(_col(text).isin(*values), F.lit(False)).cast("double")


def sex_code(text: Column | str) -> Column:
    """'Male'/'M' -> 'M', 'Female'/'F' -> 'F', anything else -> null."""
    c = F.upper(F.trim(_col(text)))
    return F.when(c.isin("M", "MALE"), "M").when(c.isin("F", "FEMALE"), "F")


def ci_text(value: Column, lo: Column, hi: Column, places: int = 3) -> Column:
    """'v (lo-hi)', or just 'v' where an interval bound is missing."""
    one = f"%.{places}f"
    return (F.when(lo.isNull() | hi.isNull(), F.format_string(one, value))
            .otherwise(F.format_string(f"{one} ({one}-{one})", value, lo, hi)))


def ci_parse(text: Column | str) -> tuple[Column, Column, Column]:
    """Inverse of ``ci_text``: three doubles, null where the text has no such part."""
    number = r"(-?\d+(?:\.\d+)?)"
    both = rf"^\s*{number}\s*\(\s*{number}\s*[-–]\s*{number}\s*\)"
    c = _col(text)
    v = F.regexp_extract(c, rf"^\s*{number}", 1).try_cast("double")
    return (v, F.regexp_extract(c, both, 2).try_cast("double"),
            F.regexp_extract(c, both, 3).try_cast("double"))


# --- effect sizes ------------------------------------------------------------

def magnitude(effect: Column) -> Column:
    """Cohen's bands of an absolute effect size."""
    e = F.abs(effect)
    return (F.when(e.isNull() | F.isnan(e), "n/a")
            .when(e < 0.10, "negligible").when(e < 0.20, "very small")
            .when(e < 0.50, "small").when(e < 0.80, "medium").otherwise("large"))


# --- hash based randomness ---------------------------------------------------

def hash_hex(seed: int | str, *keys: Column | str) -> Column:
    """md5 of 'seed-key-...': the shuffle order every sampling operator uses."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))


def hash_long(seed: int | str, *keys: Column | str) -> Column:
    """The first 60 bits of ``hash_hex`` as a number."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 15), 16, 10).cast("long")


def hash_uniform(seed: int | str, *keys: Column | str) -> Column:
    """Uniform draw between 0 and 1 from ``hash_long``."""
    return hash_long(seed, *keys).cast("double") / F.lit(float(2 ** 60))


def poisson_cdf(mean: float = 1.0) -> list[float]:
    """P(draw <= 0), P(draw <= 1), ... until the next step is below the grain of the uniform."""
    out, term, total = [], math.exp(-mean), 0.0
    while term > 2.0 ** -60 and total + term > total:
        total += term
        out.append(total)
        term *= mean / len(out)
    return out


def poisson_weight(u: Column, mean: float = 1.0) -> Column:
    """Poisson draw by inversion of a uniform (plain sums, so that u is computed once)."""
    return sum(((u >= c).cast("int") for c in poisson_cdf(mean)), F.lit(0))
