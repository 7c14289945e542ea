import math

import pytest
from pyspark.sql import functions as F

from sitewise.functions import pvalues as P
from sitewise.functions import scalars as S


def one(spark, *cols, data="1 as x"):
    return spark.sql(f"select {data}").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_minute_boundaries_not_elapsed_minutes(spark):
    r = one(spark, S.minute_boundaries("a", "b"), S.minute_boundaries("b", "a"), S.hours_between("a", "c"), data=(
        "timestamp_ntz'2020-01-01 00:00:59' a, timestamp_ntz'2020-01-01 00:01:01' b, timestamp_ntz'2020-01-01 01:30:00' c"))
    assert (r[0], r[1], r[2]) == (1, -1, 1.5)


def test_window_is_half_open(spark):
    data = "timestamp_ntz'2020-01-01 00:00:00' s, timestamp_ntz'2020-01-02 00:00:00' e"
    r = one(spark, S.in_window("s", "s", 24), S.in_window("e", "s", 24), data=data)
    assert (r[0], r[1]) == (True, False)


@pytest.mark.parametrize("x,want", [(1.5, 2), (2.5, 2), (4.5, 4), (0.15 * 10, 2)])
def test_half_even(spark, x, want):
    assert one(spark, S.half_even(F.lit(x)))[0] == want


@pytest.mark.parametrize("text,want", [("> 89", 90.0), ("", None), (None, None), ("45", 45.0), ("n/a", None)])
def test_age_text(spark, text, want):
    assert one(spark, S.age_from_text(F.lit(text)))[0] == want


def test_null_and_nan_are_filled(spark):
    r = one(spark, S.fill(F.lit(float("nan")), 0.0), S.fill(F.lit(None).cast("double"), 7.0), S.fill(F.lit(2.0), 0.0))
    assert list(r) == [0.0, 7.0, 2.0]


def test_logit_is_clipped_and_inverse(spark):
    r = one(spark, S.logit(F.lit(0.0)), S.sigmoid(S.logit(F.lit(0.3))))
    assert r[0] == pytest.approx(math.log(1e-9 / (1 - 1e-9))) and r[1] == pytest.approx(0.3)


def test_ci_text(spark):
    r = one(spark, S.ci_text(F.lit(0.8421), F.lit(0.8207), F.lit(0.863)),
            S.ci_text(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0)), *S.ci_parse(F.lit("0.842 (0.821-0.863)")),
            *S.ci_parse(F.lit("0.5")), *S.ci_parse(F.lit("-0.2 (-0.3--0.1)")))
    assert r[0] == "0.842 (0.821-0.863)" and r[1] == "0.500"
    assert list(r)[2:] == [0.842, 0.821, 0.863, 0.5, None, None, -0.2, -0.3, -0.1]


def test_sex_codes(spark):
    r = one(spark, *[S.sex_code(F.lit(t)) for t in ("Male", "F", " female ", "unknown")])
    assert list(r) == ["M", "F", "F", None]


def test_divergence_is_zero_for_equal_rates_and_symmetric(spark):
    a, b = F.lit(0.1), F.lit(0.4)
    r = one(spark, S.js_divergence(a, a), S.js_divergence(a, b), S.js_divergence(b, a), S.js_divergence(F.lit(0.0), b))
    assert r[0] == pytest.approx(0, abs=1e-12) and r[1] == pytest.approx(r[2]) and r[3] > 0


def test_poisson_weights_have_mean_one(spark):
    u = spark.range(20000).select(S.poisson_weight(S.hash_uniform(3, "id")).alias("w"))
    m = u.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert m["m"] == pytest.approx(1, abs=0.03) and m["v"] == pytest.approx(1, abs=0.05)


# closed forms: t with 1 df is Cauchy, with 2 df algebraic; chi-square with 2 df is exponential
@pytest.mark.parametrize("got,want", [
    (lambda x: P.p_t(x(1.0), x(1)), 0.5), (lambda x: P.p_t(x(-2.0), x(2)), 1 - 2 / math.sqrt(6)),
    (lambda x: P.p_chi2(x(3.0), x(2)), math.exp(-1.5)), (lambda x: P.p_chi2(x(40.0), x(2)), math.exp(-20)),
    (lambda x: P.p_chi2(x(1010.0), x(1000.0)), 0.4060332), (lambda x: P.p_f(x(4.0), x(1), x(2)), 1 - 2 / math.sqrt(6)),
    (lambda x: P.p_f(x(3.0), x(2), x(10)), (1 + 2 * 3.0 / 10) ** -5), (lambda x: P.p_normal(x(0.0)), 1.0),
    (lambda x: P.p_normal(x(1.959963984540054)), 0.05), (lambda x: P.p_chi2(x(1.0), x(1)), math.erfc(math.sqrt(0.5))),
    (lambda x: P.p_t(x(2.0), x(10 ** 7)), 0.0455003)])
def test_tail_probabilities(spark, got, want):
    assert one(spark, got(F.lit))[0] == pytest.approx(want, abs=2e-6 if 0.01 < want < 0.99 else 1e-8)


def test_p_values_on_columns(spark):
    r = spark.createDataFrame([(1.0, 1.0), (None, 3.0)], "t double, df double").select(P.p_t("t", "df").alias("p")).collect()
    assert r[0]["p"] == pytest.approx(0.5) and r[1]["p"] is None
