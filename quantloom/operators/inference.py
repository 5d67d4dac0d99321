"""Tests on returns: mean against 0, paired means, normality; and their p-values as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_p_value, t_p_value

EPS = 1e-12


def t_statistic(mean: Column, deviation: Column, n: Column) -> Column:
    """Mean over its standard error; null where nothing varies."""
    return F.when(deviation > EPS, mean / (deviation / F.sqrt(n)))


def mean_test(returns: DataFrame, *by: str, x: str = "ret", level: float = 0.05) -> DataFrame:
    """(by.., n, mean, t_stat, p_value, significant): is the mean of ``x`` other than 0? Missing values are left out; p is null below two rows or without variation."""
    s = returns.filter(F.col(x).isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    s = s.withColumn("t_stat", t_statistic(F.col("mean"), F.col("sd"), F.col("n")))
    p = F.when(F.col("t_stat").isNotNull() & (F.col("n") > 1), t_p_value(F.col("t_stat"), F.col("n") - 1))
    return s.withColumn("p_value", p).select(*by, "n", "mean", "t_stat", "p_value", (F.col("p_value") < level).alias("significant"))


def jarque_bera(returns: DataFrame, *by: str, x: str = "ret", level: float = 0.05) -> DataFrame:
    """(by.., n, skewness, kurtosis, statistic, p_value, normal): skewness and excess kurtosis of the population against those of a normal distribution."""
    s = returns.filter(F.col(x).isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    value = F.col("n") / 6 * (F.pow("skewness", 2) + F.pow("kurtosis", 2) / 4)
    s = s.withColumn("statistic", F.when(F.col("sd") > EPS, value)).withColumn("p_value", chi2_p_value(F.col("statistic"), F.lit(2)))
    return s.select(*by, "n", "skewness", "kurtosis", "statistic", "p_value", (F.col("p_value") >= level).alias("normal"))


def paired_test(series: DataFrame, key: str, at: str = "time", x: str = "r", level: float = 0.05) -> DataFrame:
    """(a, b, n, difference, t_stat, p_value, significant) of every pair of keys a < b: is the mean difference on common dates other than 0?

    The series are few (strategies, books); pairs meet on a date, so no date's rows
    meet those of another.
    """
    one, two = (series.select(at, F.col(key).alias(n), F.col(x).alias(v)) for n, v in (("a", "x"), ("b", "y")))
    pairs = one.join(two, at).filter("a < b").select("a", "b", (F.col("x") - F.col("y")).alias("ret"))
    return mean_test(pairs, "a", "b", level=level).withColumnRenamed("mean", "difference")


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p-value of Student's t for whole degrees of freedom, by its finite series of powers of a cosine."""
    angle, cosine = f"atan(abs({t}) / sqrt({df}))", f"(1 / sqrt(1 + {t} * {t} / {df}))"
    sine = f"(abs({t}) / sqrt({df} + {t} * {t}))"
    odd = f"coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: exp(0.5 * ln(pi()) - ln(2) + lgamma(k + 1) - lgamma(k + 1.5) + (2 * k + 1) * ln({cosine})))), 0)"
    even = f"list_sum(list_transform(range(0, {df} // 2), lambda k: exp(lgamma(k + 0.5) - 0.5 * ln(pi()) - lgamma(k + 1) + 2 * k * ln({cosine}))))"
    return f"(1 - case when {df} % 2 = 1 then 2 / pi() * ({angle} + {sine} * {odd}) else {sine} * {even} end)"
