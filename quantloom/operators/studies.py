"""Queries of the risk model, the tests of returns, as-of joins, indices and forecasts over the test tables, with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dsl import DUCK, Dialect
from ..shared import stored
from . import allocation, asof, forecast, indices, inference, risk_model
from .book import positions, signals, strategies
from .inference import t_p_sql
from .monitor import _frame, _rounded

FACTORS = ("score", "quality", "flow")
WINDOW = 104


def _risk_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(weights of three books on the last date, exposures there, factor covariance, specific risk, equal weights)."""
    s = stored(_frame(spark, folder, signals, f"time, asset, ret, {', '.join(FACTORS)}"), "signals")
    last = s.agg(F.max("time")).first()[0]
    long = s.unpivot(["time", "asset"], list(FACTORS), "factor", "x")
    f = risk_model.factor_returns(long, s.select("time", "asset", "ret"))
    covariance = stored(risk_model.factor_covariance(f, WINDOW), "covariance")
    weights = _frame(spark, folder, positions, "strategy, time, asset, w").filter(F.col("time") == last).filter("w <> 0").drop("time")
    exposures = long.filter(F.col("time") == last).drop("time")
    names = s.filter(F.col("time") == last).select("asset")
    return stored(weights, "weights"), exposures, covariance, risk_model.specific_risk(s), names.withColumn("w", F.lit(1.0 / max(names.count(), 1)))


def ex_ante_risk(spark: SparkSession, folder: str) -> DataFrame:
    weights, exposures, covariance, specific, equal = _risk_inputs(spark, folder)
    return _rounded(risk_model.ex_ante_risk(weights, exposures, covariance, specific, equal, by=("strategy",)), ())


def factor_risk_contributions(spark: SparkSession, folder: str) -> DataFrame:
    weights, exposures, covariance, _, _ = _risk_inputs(spark, folder)
    return _rounded(risk_model.contributions(weights, exposures, covariance, by=("strategy",)).drop("variance"), ())


def _series(spark: SparkSession, folder: str) -> DataFrame:
    return _frame(spark, folder, strategies, "strategy, time, r")


def mean_tests(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(inference.mean_test(_frame(spark, folder, signals, "asset, ret"), "asset"), ())


def normality_tests(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(inference.jarque_bera(_frame(spark, folder, signals, "asset, ret"), "asset"), (), 5)


def paired_tests(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(inference.paired_test(_series(spark, folder), "strategy"), ())


def last_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with its user's latest purchase before it, none older than ten days."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("paid"))
    near = F.col("right_ts") >= F.col("ts") - F.expr("interval 10 days")
    return asof.asof_join(e.select("event_id", "user_id", "ts"), bought, "ts", ("user_id",), within=near, strict=True)


def next_error(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with its user's first error at or after it."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    errors = e.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return asof.asof_join(e.select("event_id", "user_id", "ts"), errors, "ts", ("user_id",), forward=True)


MEMBERS = 10
SHIFT = 1e-6  # before rounding: volumes times prices end in halves of the last place, which sums of any order round alike then


def _index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(membership of the largest brands by quarter, bars of members)."""
    b = stored(_frame(spark, folder, signals, "time, asset, close, vol, ret"), "bars")
    membership = stored(indices.ranked_membership(b.select("time", "asset", (F.col("close") * F.col("vol")).alias("cap")), MEMBERS), "membership")
    return membership, stored(indices.index_panel(b, membership), "index-panel")


def index_membership(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder)[0]


def index_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_index(spark, folder)[1].select("time", "asset", "start", "close", "vol"), ())


def index_caps(spark: SparkSession, folder: str) -> DataFrame:
    caps = indices.index_caps(_index(spark, folder)[1]).withColumns({"cap": F.col("cap") + SHIFT, "w": F.col("w") + SHIFT})
    return _rounded(caps, (), 4)


def benchmark_index_equal(spark: SparkSession, folder: str) -> DataFrame:
    """The book that holds the index at equal weights since the quarter's first bar, and what it earns."""
    panel = _index(spark, folder)[1]
    return _rounded(indices.index_returns(panel, indices.index_book(panel, "equal", "quarter")), (), 7)


def benchmark_index_cap(spark: SparkSession, folder: str) -> DataFrame:
    panel = _index(spark, folder)[1]
    return _rounded(indices.index_returns(panel, indices.index_book(panel, "cap")), (), 7)


def return_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts of three books' next returns with intervals (20 trees and 10 boosts, for a small series)."""
    series = stored(_frame(spark, folder, strategies, "strategy, time, r, gross, net"), "series")
    frame, names = forecast.features(series, ("gross", "net"), ("strategy",), windows=(21, 63))
    rule = forecast.Forecast(trees=20, depth=5, boosts=10, boost_depth=3)
    return forecast.forecast(stored(frame, "features"), names, rule, ("strategy",))[0]


def max_sharpe_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Three books, none above 0.7."""
    return _rounded(allocation.max_sharpe(_series(spark, folder), most=0.7), (), 4)


QUERIES = {f.__name__: f for f in (ex_ante_risk, factor_risk_contributions, mean_tests, normality_tests, paired_tests, last_purchase, next_error, index_membership, index_panel, index_caps, benchmark_index_equal, benchmark_index_cap, return_forecast, max_sharpe_weights)}


def oracles() -> dict[str, str]:
    """SQL of the queries but ``return_forecast`` and ``max_sharpe_weights``, which are fitted and tested against plain versions."""
    d: Dialect = DUCK
    s, q = signals(d), lambda x, n=6: f"round({x}, {n}) + 0.0"
    risk = f"""with s as (select * from {s} x), top as (select max(time) t from s),
l as (unpivot (select time, asset, {', '.join(FACTORS)} from s) on {', '.join(FACTORS)} into name factor value x),
f as (select time, factor, avg(p * ret) f from (select time, asset, factor, lag(x) over (partition by asset, factor order by time) p from l) z join (select time, asset, ret from s) r using (time, asset) where p is not null group by time, factor),
w as (select * from f where time in (select distinct time from f order by time desc limit {WINDOW})),
c as (select a.factor a, b.factor b, covar_samp(a.f, b.f) cov from w a join w b using (time) group by 1, 2),
e as (select asset, factor, x from l where time = (select t from top)),
g as (select asset, var_samp(ret) - coalesce(power(covar_samp(ret, m), 2) / nullif(var_samp(m), 0), 0) v from (select asset, ret, avg(ret) over (partition by time) m from s) y group by asset),
k as (select strategy, asset, w from {positions(d)} y where time = (select t from top)),
n as (select asset, 1 / count(*) over () w from s where time = (select t from top)),
v as (select i.asset i, j.asset j, sum(i.x * cov * j.x) fv from e i join c on i.factor = c.a join e j on j.factor = c.b group by 1, 2),
p as (select k.strategy, n.asset, k.w, k.w - n.w active from k join n using (asset)),
t as (select x.strategy, sum(x.w * y.w * fv) fv, sum(x.active * y.active * fv) av from p x join p y using (strategy) join v on v.i = x.asset and v.j = y.asset group by 1),
o as (select strategy, sum(w * w * greatest(v, 0)) sv, sum(active * active * greatest(v, 0)) sa, sum(abs(w) * sqrt(greatest(v, 0))) apart from p join g using (asset) group by 1),
h as (select strategy, factor, sum(w * x) x from p join e using (asset) group by 1, 2),
u as (select a.strategy, a.factor, a.x, sum(c.cov * b.x) pull from h a join c on c.a = a.factor join h b on b.strategy = a.strategy and b.factor = c.b group by 1, 2, 3),
m as (select strategy, factor, x, pull / (sqrt(sum(x * pull) over (partition by strategy)) + 1e-12) * sqrt(252) marginal from u)"""
    j = "(select asset, count(*) n, stddev_pop(ret) sd, avg(ret) m from {0} x group by asset)".format(s)
    jb = f"(select asset, n, avg(power((ret - m) / sd, 3)) skewness, avg(power((ret - m) / sd, 4)) - 3 kurtosis from {s} x join {j} y using (asset) group by asset, n)"
    test = lambda x: f"(select *, mean / (sd / sqrt(n)) t_stat from {x} y)"
    paired = f"(select a.strategy a, b.strategy b, count(*) n, avg(a.r - b.r) mean, stddev_samp(a.r - b.r) sd from {strategies(d)} a join {strategies(d)} b on a.time = b.time and a.strategy < b.strategy group by 1, 2)"
    member = f"""with b as (select time, asset, close, vol, ret, close * vol cap from {s} x),
r as (select p, asset, row_number() over (partition by p order by round(c, 6) desc, asset) k from (select date_trunc('quarter', time)::date p, asset, avg(cap) c from b where cap > 0 group by 1, 2) g),
h as (select asset, (p + interval 3 month)::date p from r where k <= {MEMBERS}),
i as (select asset, p, p - interval 3 month * row_number() over (partition by asset order by p) island from h),
m as (select asset, min(p) "start", case when max(p) < (select max(p) from h) then (max(p) + interval 3 month)::date end "end" from i group by asset, island),
x as (select b.*, m."start" from b join m on m.asset = b.asset and b.time >= m."start" and (m."end" is null or b.time < m."end"))"""
    caps = """, y as (select time, asset, coalesce(last_value(case when cap > 0 then cap end ignore nulls) over (partition by asset order by time rows between unbounded preceding and current row), 0) cap from x),
z as (select time, asset, cap, coalesce(cap / nullif(sum(cap) over (partition by time), 0), 0) w from y)"""
    dates = ", n as (select time, lead(time) over (order by time) nxt from (select distinct time from x) t)"
    earned = lambda book: f"select n.nxt as time, {q('sum(v.w * coalesce(x.ret, 0))', 7)} r, count(x.ret) names from {book} v join n on n.time = v.time left join x on x.time = n.nxt and x.asset = v.asset where n.nxt is not null group by 1"
    drift = """, q as (select *, min(time) over (partition by date_trunc('quarter', time)) first from x), a as (select first, asset, 1 / count(*) over (partition by first) w from q where time = first),
v as (select q.time, q.asset, a.w * coalesce((select product(1 + greatest(coalesce(o.ret, 0), -0.999999)) from q o where o.asset = q.asset and o.first = q.first and o.time > q.first and o.time <= q.time), 1) g from q join a on a.first = q.first and a.asset = q.asset),
held as (select time, asset, g / sum(g) over (partition by time) w from v)"""
    return {
        "ex_ante_risk": f"{risk} select strategy, {q('sqrt(252 * (fv + sv))')} total_risk, {q('sqrt(252 * fv)')} factor_risk, {q('sqrt(252 * sv)')} specific_risk, {q('c - sqrt(252 * fv)')} correlation, {q('sqrt(252 * (av + sa))')} tracking_error, {q('apart / sqrt(252 * (fv + sv))')} diversification from t join o using (strategy) join (select strategy, sum(abs(x * marginal)) c from m group by 1) z using (strategy)",
        "factor_risk_contributions": f"{risk} select strategy, factor, {q('x')} exposure, {q('marginal')} marginal, {q('x * marginal')} contribution from m",
        "mean_tests": f"select asset, n, {q('mean')} mean, {q('t_stat')} t_stat, {q(t_p_sql('t_stat', '(n - 1)'))} p_value, {t_p_sql('t_stat', '(n - 1)')} < 0.05 significant from {test(f'(select asset, count(*) n, avg(ret) mean, stddev_samp(ret) sd from {s} x group by asset)')} z",
        "normality_tests": f"select asset, n, {q('skewness', 5)} skewness, {q('kurtosis', 5)} kurtosis, {q('n / 6.0 * (power(skewness, 2) + power(kurtosis, 2) / 4)', 5)} \"statistic\", {q('exp(-n / 12.0 * (power(skewness, 2) + power(kurtosis, 2) / 4))', 5)} p_value, exp(-n / 12.0 * (power(skewness, 2) + power(kurtosis, 2) / 4)) >= 0.05 normal from {jb} z",
        "paired_tests": f"select a, b, n, {q('mean')} difference, {q('t_stat')} t_stat, {q(t_p_sql('t_stat', '(n - 1)'))} p_value, {t_p_sql('t_stat', '(n - 1)')} < 0.05 significant from {test(paired)} z",
        "last_purchase": "select e.event_id, e.user_id, e.ts, case when p.ts >= e.ts - interval 10 day then p.ts end right_ts, case when p.ts >= e.ts - interval 10 day then p.value end paid from events e asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts > p.ts",
        "next_error": "select e.event_id, e.user_id, e.ts, p.ts right_ts, p.event_id error_id from events e asof left join (select * from events where event_type = 'error') p on e.user_id = p.user_id and e.ts <= p.ts",
        "index_membership": f'{member} select asset, "start", "end" from m',
        "index_panel": f'{member} select time, asset, "start", {q("close")} close, {q("vol")} vol from x',
        "index_caps": f"{member}{caps} select time, asset, {q(f'cap + {SHIFT}', 4)} cap, {q(f'w + {SHIFT}', 4)} w from z",
        "benchmark_index_equal": f"{member}{dates}{drift} {earned('held')}",
        "benchmark_index_cap": f"{member}{caps}{dates} {earned('z')}",
    }
