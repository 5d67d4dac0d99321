"""A factor risk model: exposures, factor covariance and specific risk, for any number of books at once.

Nothing is built as a matrix: a book's exposures are an aggregate of weights times
exposures, its marginal risks an aggregate of exposures times the covariance in
long form, so work grows with books x names x factors + books x factors squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
YEAR = 252**0.5


def factor_returns(exposures: DataFrame, returns: DataFrame) -> DataFrame:
    """(time, factor, f): mean over names of the exposure of the bar before times the return. ``exposures``: (time, asset, factor, x)."""
    before = F.lag("x").over(Window.partitionBy("asset", "factor").orderBy("time"))
    return exposures.withColumn("x", before).join(returns, ["time", "asset"]).filter("x is not null").groupBy("time", "factor").agg(F.avg(F.col("x") * F.coalesce("ret", F.lit(0.0))).alias("f"))


def factor_covariance(f: DataFrame, window: int = 252, half_life: float | None = None) -> DataFrame:
    """(a, b, cov) over the last ``window`` dates of (time, factor, f), every pair of factors; dates are weighted by ``half_life`` where given.

    The sample covariance of the dates that both factors have; with weights w it is
    corrected by (sum w)^2 / ((sum w)^2 - sum w^2), as the plain one is by n / (n - 1).
    """
    dates = f.select("time").distinct().withColumn("age", F.row_number().over(Window.orderBy(F.desc("time"))) - 1).filter(F.col("age") < window)
    w = F.lit(1.0) if half_life is None else F.pow(F.lit(0.5), F.col("age") / half_life)
    recent = f.join(F.broadcast(dates), "time").select("time", "factor", F.col("f").cast("double").alias("f"), w.alias("w"))  # window dates at most
    one, two = recent.select("time", F.col("factor").alias("a"), F.col("f").alias("x"), "w"), recent.select("time", F.col("factor").alias("b"), F.col("f").alias("y"))
    s = one.join(two, "time").groupBy("a", "b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("nn"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"))
    n = F.col("n")
    cov = (F.col("sxy") / n - F.col("sx") * F.col("sy") / (n * n)) * n * n / F.nullif(n * n - F.col("nn"), F.lit(0.0))
    return s.select("a", "b", F.coalesce(cov, F.lit(0.0)).alias("cov"))


def specific_risk(returns: DataFrame) -> DataFrame:
    """(asset, specific): deviation of what the market, the mean of all names, does not explain of a name's return."""
    m = returns.withColumn("m", F.avg("ret").over(Window.partitionBy("time")))
    rest = F.var_samp("ret") - F.pow(F.covar_samp("ret", "m"), 2) / F.nullif(F.var_samp("m"), F.lit(0.0))
    return m.groupBy("asset").agg(F.sqrt(F.greatest(rest, F.lit(0.0))).alias("specific"))


def _book_exposures(weights: DataFrame, exposures: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return weights.join(exposures, "asset").groupBy(*by, "factor").agg(F.sum(F.col("w") * F.coalesce("x", F.lit(0.0))).alias("x"))


def contributions(weights: DataFrame, exposures: DataFrame, covariance: DataFrame, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """(by.., factor, exposure, marginal, contribution, variance), annual but for the variance: what a factor adds to the factor risk of each book.

    ``weights``: (by.., asset, w), ``exposures``: (asset, factor, x), ``covariance``:
    (a, b, cov). A factor without covariance, or a name without exposures, counts nothing.
    """
    mine = _book_exposures(weights, exposures, by).join(covariance.select(F.col("a").alias("factor")).distinct(), "factor")
    pulled = mine.join(covariance.withColumnRenamed("a", "factor"), "factor").groupBy(*by, F.col("b").alias("factor")).agg(F.sum(F.col("x") * F.col("cov")).alias("pull"))
    both = mine.join(pulled, [*by, "factor"]).withColumn("variance", F.sum(F.col("x") * F.col("pull")).over(Window.partitionBy(*by)))
    marginal = F.col("pull") / (F.sqrt(F.greatest("variance", F.lit(0.0))) + EPS) * YEAR
    contribution = F.when(F.col("variance") > EPS, marginal * F.col("x")).otherwise(0.0)
    return both.select(*by, "factor", F.col("x").alias("exposure"), marginal.alias("marginal"), contribution.alias("contribution"), "variance")


def _factor_part(exposures: DataFrame, covariance: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by.., factor_variance) of exposures (by.., factor, x)."""
    pulled = exposures.join(covariance.withColumnRenamed("a", "factor"), "factor").select(*by, F.col("b").alias("factor"), (F.col("x") * F.col("cov")).alias("pull"))
    pulled = pulled.groupBy(*by, "factor").agg(F.sum("pull").alias("pull"))
    return exposures.join(pulled, [*by, "factor"]).groupBy(*by).agg(F.sum(F.col("x") * F.col("pull")).alias("factor_variance"))


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0))) * YEAR


def ex_ante_risk(weights: DataFrame, exposures: DataFrame, covariance: DataFrame, specific: DataFrame | None = None, benchmark: DataFrame | None = None, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """A row per book (the values of ``by``): predicted total, factor and specific risk, tracking error against ``benchmark`` (asset, w), diversification.

    Total variance is exposures x covariance x exposures plus squared weights times
    squared specific risk; without ``specific``, 4 % of the squared weights stand
    for it. The tracking error is the total risk of the weights less the
    benchmark's, 0 without one. ``diversification``: weighted specific risks over the
    total risk, 1 without ``specific``. ``correlation``: what the factors'
    contributions add up to beyond the factor risk. Rows that repeat a name add up.
    """
    if not by:
        raise ValueError("name at least one column that tells books apart")
    keys = list(by)
    w = weights.groupBy(*keys, "asset").agg(F.sum("w").alias("w"))
    known = w.join(exposures.select("asset").distinct(), "asset")
    x = _book_exposures(w, exposures, by)
    # a name's own variance per squared weight
    own = exposures.select("asset").distinct()
    own = own.withColumn("v", F.lit(0.04)) if specific is None else own.join(specific, "asset", "left").select("asset", F.pow(F.coalesce("specific", F.lit(0.0)), 2).alias("v"))
    parts = contributions(w, exposures, covariance, by).groupBy(*keys).agg(F.max("variance").alias("factor_variance"), F.sum(F.abs("contribution")).alias("parts"))
    single = known.join(own, "asset").groupBy(*keys).agg(F.sum(F.col("w") * F.col("w") * F.col("v")).alias("specific_variance"))
    none = F.lit(0.0)
    out = single.join(parts, keys, "left")
    total, factor = _root(F.coalesce("factor_variance", none) + F.col("specific_variance")), _root(F.coalesce("factor_variance", none))
    out = out.select(*keys, total.alias("total_risk"), factor.alias("factor_risk"), _root(F.col("specific_variance")).alias("specific_risk"), (F.coalesce("parts", none) - factor).alias("correlation"), "specific_variance")
    if benchmark is None:
        out = out.withColumn("tracking_error", none)
    else:
        # active weights are never laid out: their exposures are a difference, their own variance a square multiplied out
        b = benchmark.groupBy("asset").agg(F.sum("w").alias("b"))
        bx = b.join(exposures, "asset").groupBy("factor").agg(F.sum(F.col("b") * F.coalesce("x", none)).alias("bx"))
        active = _factor_part(x.join(bx, "factor", "left").select(*keys, "factor", (F.col("x") - F.coalesce("bx", none)).alias("x")), covariance, by)
        square = float(b.join(own, "asset").agg(F.coalesce(F.sum(F.col("b") * F.col("b") * F.col("v")), none)).first()[0])  # one number
        cross = known.join(b, "asset").join(own, "asset").groupBy(*keys).agg(F.sum(F.col("w") * F.col("b") * F.col("v")).alias("cross"))
        out = out.join(active.withColumnRenamed("factor_variance", "active"), keys, "left").join(cross, keys, "left")
        out = out.withColumn("tracking_error", _root(F.coalesce("active", none) + F.col("specific_variance") - 2 * F.coalesce("cross", none) + square)).drop("active", "cross")
    out = out.drop("specific_variance")
    if specific is None:
        return out.withColumn("diversification", F.lit(1.0))
    apart = w.join(specific, "asset").groupBy(*keys).agg(F.sum(F.abs("w") * F.coalesce("specific", none)).alias("apart"))
    return out.join(apart, keys, "left").withColumn("diversification", F.when(F.col("total_risk") > EPS, F.coalesce("apart", none) / F.col("total_risk")).otherwise(1.0)).drop("apart")
