"""Queries on Value at Risk, back-tests, portfolios, stress, performance and strategies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import distributions as dist
from tessella.functions.ordering import Series
from tessella.functions.scalars import quote_bp
from tessella.operators import bars as B
from tessella.operators import bootstrap as W
from tessella.operators import ewm as E
from tessella.operators import garch as G
from tessella.operators import joins as J
from tessella.operators import performance as P
from tessella.operators import risk as K
from tessella.operators import rolling as R
from tessella.operators import stress as S
from tessella.plans.base import DAILY, DAILY_SQL, PANEL_SQL, RETURNS_SQL, daily, panel, returns
from tessella.plans.market import D, VWAP_SQL, day, ewm_sql, r, vwap_frame
from tessella.sources.stage import staged

KEY = ("symbol",)
WEIGHTS = [("1-URGENT", 0.3), ("2-HIGH", 0.25), ("3-MEDIUM", 0.2), ("4-NOT SPECIFIED", 0.15), ("5-LOW", 0.1)]
WEIGHTS_SQL = "weights AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {w})" for a, w in WEIGHTS) + ") t(asset, weight))"
SCENARIOS = [("a_spring", "1996-03-01", "1996-05-31"), ("b_summer", "1997-06-01", "1997-09-30"), ("c_winter", "1999-11-15", "2000-02-15"), ("d_none", "1980-01-01", "1980-02-01")]
SCENARIOS_SQL = "scenarios AS (SELECT key, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, a, b in SCENARIOS) + ") t(key, a, b))"
Z99 = dist.norm_ppf(0.01)


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "asset string, weight double")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "key string, a string, b string").select("key", F.to_date("a").alias("start"), F.to_date("b").alias("end"))


def var_es(d: DataFrame) -> DataFrame:
    return d.select("symbol", "n_obs", r("var", 8).alias("var"), r("es", 8).alias("es"))


def historical_var_es(spark: SparkSession, sf: str) -> DataFrame:
    return var_es(K.historical_var(returns(spark, sf), KEY, "ret"))


def gaussian_var_es(spark: SparkSession, sf: str) -> DataFrame:
    return var_es(K.normal_var(returns(spark, sf), KEY, "ret"))


def cornish_fisher(spark: SparkSession, sf: str) -> DataFrame:
    return var_es(K.cornish_fisher_var(returns(spark, sf), KEY, "ret"))


def cornish_fisher_sql() -> str:
    grid = [dist.norm_ppf(1e-6 + (0.01 - 1e-6) * i / 499) for i in range(500)]
    m1, m2, m3 = (sum(z**p for z in grid) / 500 for p in (1, 2, 3))
    z = Z99
    q = f"({z!r} + {z * z - 1!r} * s / 6 + {z**3 - 3 * z!r} * k / 24 - {2 * z**3 - 5 * z!r} * s * s / 36)"
    e = f"({m1!r} + {m2 - 1!r} * s / 6 + {m3 - 3 * m1!r} * k / 24 - {2 * m3 - 5 * m1!r} * s * s / 36)"
    return f"""WITH {RETURNS_SQL}, a AS (SELECT symbol, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp, count(ret) AS n FROM rets GROUP BY symbol),
      m AS (SELECT symbol, any_value(n) AS n, any_value(mu) AS mu, any_value(sd) AS sd, avg(pow((ret - mu) / sp, 3)) AS s, avg(pow((ret - mu) / sp, 4)) - 3 AS k FROM rets JOIN a USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol)
      SELECT symbol, n AS n_obs, round(-(mu + sd * {q}), 8) AS var, round(-(mu + sd * {e}), 8) AS es FROM m"""


def ewma_var(spark: SparkSession, sf: str) -> DataFrame:
    d = K.ewma_var_series(returns(spark, sf).filter("ret IS NOT NULL"), DAILY, "ret")
    return d.filter("var IS NOT NULL").select("symbol", day(), r("var", 8).alias("var"), r("es", 8).alias("es"))


def ewma_var_sql() -> str:
    from tessella.plans.market import VARIANCE_SQL

    body = VARIANCE_SQL[: VARIANCE_SQL.rindex("SELECT symbol")]
    c = dist.norm_pdf(Z99) / 0.01
    return f"WITH {body} SELECT symbol, {D}, round({-Z99!r} * sqrt(variance), 8) AS var, round({c!r} * sqrt(variance), 8) AS es FROM y WHERE i > 30"


def covariance_last(spark: SparkSession, sf: str) -> DataFrame:
    return E.ewma_covariance_last(panel(spark, sf))


PAIRS_SQL = PANEL_SQL + """, pr AS (SELECT a.date, a.asset AS asset_i, b.asset AS asset_j, a.ret AS x, b.ret AS y FROM panel a JOIN panel b ON a.date = b.date AND a.asset <= b.asset),
pn AS (SELECT *, row_number() OVER (PARTITION BY asset_i, asset_j ORDER BY date) AS rn, count(*) OVER (PARTITION BY asset_i, asset_j) AS n FROM pr)"""
COV_SQL = PAIRS_SQL + """, cov AS (SELECT asset_i, asset_j, pow(0.94, any_value(n) - 30) * covar_samp(x, y) FILTER (rn <= 30) + coalesce(sum((1 - 0.94) * pow(0.94, n - rn) * x * y) FILTER (rn > 30), 0) AS value FROM pn GROUP BY ALL),
full_cov AS (SELECT * FROM cov UNION ALL SELECT asset_j, asset_i, value FROM cov WHERE asset_i <> asset_j)"""


def ewma_cov_last(spark: SparkSession, sf: str) -> DataFrame:
    return covariance_last(spark, sf).select("asset_i", "asset_j", r("value", 12).alias("value"))


def ewma_cov_path(spark: SparkSession, sf: str) -> DataFrame:
    d = E.ewma_covariance(panel(spark, sf))
    return d.select(day(), "asset_i", "asset_j", r("value", 10).alias("value"))


COV_PATH_SQL = PAIRS_SQL + """, seed AS (SELECT asset_i, asset_j, covar_samp(x, y) AS s FROM pn WHERE rn <= 30 GROUP BY ALL),
q AS (SELECT pn.*, s, lag(x * y) OVER (PARTITION BY pn.asset_i, pn.asset_j ORDER BY pn.date) AS prev FROM pn JOIN seed ON pn.asset_i = seed.asset_i AND pn.asset_j = seed.asset_j),
z AS (SELECT date, asset_i, asset_j, rn, pow(0.94, rn - 31) * sum(CASE WHEN rn < 31 THEN 0 WHEN rn = 31 THEN s ELSE (1 - 0.94) * prev / pow(0.94, rn - 31) END) OVER (PARTITION BY asset_i, asset_j ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM q)
SELECT CAST(date AS VARCHAR) AS date, asset_i, asset_j, round(value, 10) AS value FROM z WHERE rn > 30"""


def correlation_last(spark: SparkSession, sf: str) -> DataFrame:
    return J.correlation_of(covariance_last(spark, sf)).select("asset_i", "asset_j", r("value", 8).alias("value"))


def corr_paths(spark: SparkSession, sf: str) -> DataFrame:
    return E.ewma_correlation_path(panel(spark, sf))


def ewma_corr_path(spark: SparkSession, sf: str) -> DataFrame:
    return corr_paths(spark, sf).select(day(), "asset_i", "asset_j", r("rho", 8).alias("rho"))


A97 = 1 - 0.97
CORR_SQL = PAIRS_SQL + ", o AS (SELECT * FROM pn WHERE asset_i < asset_j), cc AS (SELECT date, asset_i, asset_j, rn, " + ", ".join(f"{ewm_sql(x, A97, 'asset_i, asset_j', 'date', 'rn')} AS {n}" for x, n in (("x * y", "xy"), ("x * x", "xx"), ("y * y", "yy"))) + """ FROM o),
rho AS (SELECT date, asset_i, asset_j, lag(greatest(-1, least(1, xy / sqrt(xx * yy)))) OVER (PARTITION BY asset_i, asset_j ORDER BY date) AS rho FROM cc)"""


def pairwise_table(spark: SparkSession, sf: str) -> DataFrame:
    d = S.pairwise_table(corr_paths(spark, sf), S.sample_correlation(panel(spark, sf)))
    return d.select("asset_i", "asset_j", *[r(c).alias(c) for c in ("sample", "last", "mean", "min", "max", "range", "drift")])


DYNAMIC = (0.02, 0.95)


def dynamic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pair table with dynamic correlations of returns standardised by their EWMA deviation."""
    p, own = panel(spark, sf), Series(("asset",), ("date",))
    z = E.ewma_variance(p, own, "ret").filter("variance > 0").select("date", "asset", (F.col("ret") / F.sqrt("variance")).alias("z"))
    d = S.dynamic_pairs(G.dcc_scan(z, *DYNAMIC), corr_paths(spark, sf), S.sample_correlation(p))
    return d.select("asset_i", "asset_j", *[r(c).alias(c) for c in ("sample", "ewma", "drift", "last", "mean", "min", "max", "range")])


def level_sql(x: str, bar: str) -> str:
    """Q of a pair in closed form, from the products of the row before."""
    a, b = DYNAMIC
    return f"pow({b!r}, k - 1) * sum(CASE WHEN k = 1 THEN {bar} ELSE ({1 - a - b!r}::DOUBLE * {bar} + {a!r} * {x}) / pow({b!r}, k - 1) END) OVER w"


DYNAMIC_SQL = CORR_SQL + f""", v0 AS (SELECT asset, date, ret, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM panel),
vs AS (SELECT asset, var_samp(ret) AS s FROM v0 WHERE i <= 30 GROUP BY asset),
vp AS (SELECT v0.*, s, lag(ret) OVER (PARTITION BY v0.asset ORDER BY date) AS prev FROM v0 JOIN vs ON vs.asset = v0.asset),
vv AS (SELECT asset, date, i, ret, pow(0.94, i - 31) * sum(CASE WHEN i < 31 THEN 0 WHEN i = 31 THEN s ELSE (1 - 0.94) * prev * prev END / pow(0.94, i - 31)) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS variance FROM vp),
zz AS (SELECT asset, date, ret / sqrt(variance) AS z FROM vv WHERE i > 30),
zp AS (SELECT x.asset AS asset_i, y.asset AS asset_j, x.date, x.z AS zi, y.z AS zj FROM zz x JOIN zz y ON x.date = y.date AND x.asset < y.asset),
zb AS (SELECT asset_i, asset_j, corr(zi, zj) AS bar FROM zp GROUP BY ALL),
zl AS (SELECT p.*, bar, row_number() OVER w AS k, lag(zi) OVER w AS pi, lag(zj) OVER w AS pj FROM zp p JOIN zb ON zb.asset_i = p.asset_i AND zb.asset_j = p.asset_j WINDOW w AS (PARTITION BY p.asset_i, p.asset_j ORDER BY p.date)),
zq AS (SELECT asset_i, asset_j, date, {level_sql("pi * pj", "bar")} AS qij, {level_sql("pi * pi", "1.0")} AS qii, {level_sql("pj * pj", "1.0")} AS qjj FROM zl WINDOW w AS (PARTITION BY asset_i, asset_j ORDER BY date ROWS UNBOUNDED PRECEDING)),
dq AS (SELECT asset_i, asset_j, arg_max(qij / sqrt(qii * qjj), date) AS l, avg(qij / sqrt(qii * qjj)) AS m, min(qij / sqrt(qii * qjj)) AS lo, max(qij / sqrt(qii * qjj)) AS hi FROM zq GROUP BY ALL),
ew AS (SELECT asset_i, asset_j, arg_max(rho, date) AS e FROM rho WHERE rho IS NOT NULL GROUP BY ALL),
sa AS (SELECT asset_i, asset_j, corr(x, y) AS s FROM pn GROUP BY ALL)
SELECT d.asset_i, d.asset_j, round(s, 6) AS sample, round(e, 6) AS ewma, round(e - s, 6) AS drift, round(l, 6) AS last, round(m, 6) AS mean, round(lo, 6) AS min, round(hi, 6) AS max, round(hi - lo, 6) AS range
FROM dq d JOIN ew ON ew.asset_i = d.asset_i AND ew.asset_j = d.asset_j JOIN sa ON sa.asset_i = d.asset_i AND sa.asset_j = d.asset_j"""


def pairwise_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return S.sample_correlation(panel(spark, sf)).select("asset_i", "asset_j", "n_obs", r("covariance", 10).alias("covariance"), r("correlation", 8).alias("correlation"))


def correlation_stress(spark: SparkSession, sf: str) -> DataFrame:
    d = S.correlation_stress(panel(spark, sf), corr_paths(spark, sf))
    return d.select("asset_i", "asset_j", r("calm").alias("calm"), r("stressed").alias("stressed"), "n_stressed", r("increase").alias("increase"))


STRESS_SQL = CORR_SQL + """, days AS (SELECT date, avg(ret) AS m FROM panel WHERE date IN (SELECT date FROM rho WHERE rho IS NOT NULL) GROUP BY date),
bad AS (SELECT date, m <= (SELECT quantile_cont(m, 0.05) FROM days) AS bad FROM days)
SELECT asset_i, asset_j, round(avg(rho) FILTER (NOT bad), 6) AS calm, round(avg(rho) FILTER (bad), 6) AS stressed, CAST(sum(bad::INT) AS BIGINT) AS n_stressed,
  round(avg(rho) FILTER (bad) - avg(rho) FILTER (NOT bad), 6) AS increase FROM rho JOIN bad USING (date) GROUP BY ALL"""


def best_partner(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    s = Series(("asset",), ("date",))
    moves = p.withColumn("move", F.sum("ret").over(s.prev(8))).select("date", "asset", "move")
    return J.best_partner(corr_paths(spark, sf), moves, "date", 0.1).select(day(), "asset", "partner", r("rho", 8).alias("rho"), "implied")


PARTNER_SQL = CORR_SQL + """, both_ways AS (SELECT date, asset_i AS asset, asset_j AS partner, rho FROM rho WHERE rho IS NOT NULL UNION ALL SELECT date, asset_j, asset_i, rho FROM rho WHERE rho IS NOT NULL),
top AS (SELECT *, row_number() OVER (PARTITION BY date, asset ORDER BY abs(rho) DESC, partner) AS k FROM both_ways),
mv AS (SELECT date, asset, sum(ret) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS move FROM panel)
SELECT CAST(top.date AS VARCHAR) AS date, top.asset, partner, round(rho, 8) AS rho, coalesce(CASE WHEN abs(rho) >= 0.1 THEN sign(rho) * sign(move) ELSE 0 END, 0)::DOUBLE AS implied
FROM top LEFT JOIN mv ON mv.date = top.date AND mv.asset = partner WHERE k = 1"""


def portfolio_var(spark: SparkSession, sf: str) -> DataFrame:
    d = K.portfolio_var(covariance_last(spark, sf), weights(spark))
    return d.select(r("variance", 12).alias("variance"), r("var", 8).alias("var"), r("es", 8).alias("es"))


def component_var(spark: SparkSession, sf: str) -> DataFrame:
    d = K.component_var(covariance_last(spark, sf), weights(spark))
    return d.select("asset", "weight", *[r(c, 8).alias(c) for c in ("marginal_var", "component_var", "pct")])


COMPONENT_SQL = COV_SQL + f""", {WEIGHTS_SQL}, sw AS (SELECT asset_i AS asset, sum(value * weight) AS sw FROM full_cov JOIN weights ON asset_j = asset GROUP BY asset_i),
t AS (SELECT asset, weight, sw, sum(weight * sw) OVER () AS v FROM sw JOIN weights USING (asset))
SELECT asset, weight::DOUBLE AS weight, round({-Z99!r} * sw / sqrt(v), 8) AS marginal_var, round(weight * {-Z99!r} * sw / sqrt(v), 8) AS component_var, round(weight * sw / v, 8) AS pct FROM t"""


def with_var(spark: SparkSession, sf: str) -> DataFrame:
    return R.rolling_historical_var(returns(spark, sf), DAILY, "ret", 0.95, 250)


def var_backtest(spark: SparkSession, sf: str) -> DataFrame:
    d = K.backtest(with_var(spark, sf), DAILY, "ret", "var", 0.95)
    return d.select(
        "symbol", "n_obs", "n_breaches", "n00", "n01", "n10", "n11", *[r(c).alias(c) for c in ("breach_rate", "kupiec", "independence", "conditional", "conditional_p", "lopez_loss", "mean_severity", "max_severity")], "basel_zone"
    )


def safe_log(x: str) -> str:
    """A logarithm in SQL, 0 where there is none."""
    return f"CASE WHEN {x} > 0 THEN ln({x}) ELSE 0 END"


BT_SQL = RETURNS_SQL + f""", v AS (SELECT symbol, date, ret, CASE WHEN count(ret) OVER p >= 250 THEN -quantile_cont(ret, 0.05) OVER p END AS var FROM rets WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, (-ret > var)::INT AS b FROM v WHERE ret IS NOT NULL AND var IS NOT NULL), bp AS (SELECT *, lag(b) OVER (PARTITION BY symbol ORDER BY date) AS p FROM b),
c AS (SELECT symbol, count(*) AS n, sum(b)::DOUBLE AS x, count(*) FILTER (p = 0 AND b = 0) AS n00, count(*) FILTER (p = 0 AND b = 1) AS n01, count(*) FILTER (p = 1 AND b = 0) AS n10, count(*) FILTER (p = 1 AND b = 1) AS n11,
  avg(-ret - var) FILTER (b = 1) AS ms, max(-ret - var) FILTER (b = 1) AS xs, sum(1 + pow((-ret - var) * 100, 2)) FILTER (b = 1) AS ll FROM bp GROUP BY symbol),
k AS (SELECT *, -2 * ((n - x) * ln(0.95) + x * ln(0.05) - (n - x) * {safe_log('1 - x / n')} - x * {safe_log('x / n')}) AS kup, n01 / (n00 + n01) AS p01, n11 / (n10 + n11) AS p11, (n01 + n11) / (n00 + n01 + n10 + n11) AS p FROM c),
i AS (SELECT *, CASE WHEN n00 + n01 = 0 OR n10 + n11 = 0 OR n01 + n11 = 0 OR p = 1 THEN 0 ELSE greatest(0, -2 * ((n00 + n10) * {safe_log('1 - p')} + (n01 + n11) * {safe_log('p')} - n00 * {safe_log('1 - p01')} - n01 * {safe_log('p01')} - n10 * {safe_log('1 - p11')} - n11 * {safe_log('p11')})) END AS ind FROM k)
SELECT symbol, n AS n_obs, x::BIGINT AS n_breaches, n00, n01, n10, n11, round(x / n, 6) AS breach_rate, round(kup, 6) AS kupiec, round(ind, 6) AS independence, round(kup + ind, 6) AS conditional,
  round(exp(-(kup + ind) / 2), 6) AS conditional_p, round(coalesce(ll, 0), 6) AS lopez_loss, round(coalesce(ms, 0), 6) AS mean_severity, round(coalesce(xs, 0), 6) AS max_severity, 'n/a' AS basel_zone FROM i WHERE n >= 100"""


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    base = returns(spark, sf)
    hist = R.rolling_historical_var(base, DAILY, "ret", 0.99, 250).withColumn("model", F.lit("historical"))
    norm = R.rolling_normal_var(base, DAILY, "ret", Z99, 250).withColumn("model", F.lit("normal"))
    both = hist.unionByName(norm)
    d = K.compare_models(K.backtest(both, Series(("model", "symbol"), ("date",)), "ret", "var", 0.99))
    return d.select("model", "symbol", "n_obs", "n_breaches", r("kupiec", 5).alias("kupiec"), r("kupiec_p", 5).alias("kupiec_p"), r("lopez_loss", 5).alias("lopez_loss"), "basel_zone", "basel_multiplier", "passed")


def chi2_sql(x: str) -> str:
    """The upper tail of chi-squared with one degree of freedom, by the same fit."""
    z = f"sqrt({x} / 2)"
    t, poly = f"(1 / (1 + {z} / 2))", repr(K.ERFC[-1])
    for c in K.ERFC[-2::-1]:
        poly = f"({c!r}::DOUBLE + {t} * {poly})"
    return f"{t} * exp(-{z} * {z} + {poly})"


ONE = f"{1 - 0.99!r}::DOUBLE"
MODELS_SQL = RETURNS_SQL + f""", est AS (SELECT 'historical' AS model, symbol, date, ret, CASE WHEN count(ret) OVER p >= 250 THEN -quantile_cont(ret, {ONE}) OVER p END AS var FROM rets WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT 'normal', symbol, date, ret, CASE WHEN count(ret) OVER p >= 250 THEN -(avg(ret) OVER p + {Z99!r}::DOUBLE * stddev_samp(ret) OVER p) END FROM rets WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, (-ret > var)::INT AS b FROM est WHERE ret IS NOT NULL AND var IS NOT NULL), bp AS (SELECT *, lag(b) OVER (PARTITION BY model, symbol ORDER BY date) AS p FROM b),
c AS (SELECT model, symbol, count(*) AS n, sum(b)::DOUBLE AS x, count(*) FILTER (p = 0 AND b = 0) AS n00, count(*) FILTER (p = 0 AND b = 1) AS n01, count(*) FILTER (p = 1 AND b = 0) AS n10, count(*) FILTER (p = 1 AND b = 1) AS n11,
  coalesce(sum(1 + pow((-ret - var) * 100, 2)) FILTER (b = 1), 0) AS ll FROM bp GROUP BY model, symbol HAVING count(*) >= 100),
k AS (SELECT *, CASE WHEN x = 0 THEN -2 * n * ln(1 - {ONE}) WHEN x = n THEN -2 * n * ln({ONE}) ELSE greatest(0, -2 * ((n - x) * ln(1 - {ONE}) + x * ln({ONE}) - (n - x) * {safe_log("1 - x / n")} - x * {safe_log("x / n")})) END AS kup,
  n01 / nullif(n00 + n01, 0) AS p01, n11 / nullif(n10 + n11, 0) AS p11, (n01 + n11) / nullif(n00 + n01 + n10 + n11, 0) AS p, 250.0::DOUBLE * x / n AS y FROM c),
i AS (SELECT *, CASE WHEN n00 + n01 = 0 OR n10 + n11 = 0 OR n01 + n11 = 0 OR p = 1 THEN 0 ELSE greatest(0, -2 * ((n00 + n10) * {safe_log("1 - p")} + (n01 + n11) * {safe_log("p")} - n00 * {safe_log("1 - p01")} - n01 * {safe_log("p01")} - n10 * {safe_log("1 - p11")} - n11 * {safe_log("p11")})) END AS ind FROM k)
SELECT model, symbol, n AS n_obs, x::BIGINT AS n_breaches, round(kup, 5) AS kupiec, round({chi2_sql("kup")}, 5) AS kupiec_p, round(ll, 5) AS lopez_loss, CASE WHEN y < 5 THEN 'green' WHEN y < 10 THEN 'amber' ELSE 'red' END AS basel_zone,
  CASE WHEN y < 5 THEN 3.0 WHEN y < 6 THEN 3.4 WHEN y < 7 THEN 3.5 WHEN y < 8 THEN 3.65 WHEN y < 9 THEN 3.75 WHEN y < 10 THEN 3.85 ELSE 4.0 END::DOUBLE AS basel_multiplier,
  {chi2_sql("kup")} > 0.05 AND CASE WHEN ind > 0 THEN {chi2_sql("ind")} ELSE 1 END > 0.05 AS passed FROM i"""


def scenario_replay(spark: SparkSession, sf: str) -> DataFrame:
    d = S.replay(panel(spark, sf), weights(spark), scenarios(spark))
    return d.select("key", *[r(c, 8).alias(c) for c in ("total_return", "worst_day", "volatility", "max_drawdown", "coverage")], day("worst_date"), "n_days", "missing")


SCEN_SQL = PANEL_SQL + f""", {WEIGHTS_SQL}, {SCENARIOS_SQL}, h AS (SELECT key, date, sum(weight * ret) AS port FROM panel JOIN scenarios ON date BETWEEN a AND b JOIN weights USING (asset) GROUP BY ALL),
e AS (SELECT *, exp(sum(ln(1 + port)) OVER (PARTITION BY key ORDER BY date ROWS UNBOUNDED PRECEDING)) AS eq FROM h),
dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY key ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
res AS (SELECT key, product(1 + port) - 1 AS total_return, min(port) AS worst_day, arg_min(date, port) AS worst_date, stddev_samp(port) * sqrt(252) AS vol, min(dd) AS mdd, count(*) AS n_days FROM dd GROUP BY key)"""


def stress_vs_var(spark: SparkSession, sf: str) -> DataFrame:
    d = S.stress_vs_var(S.replay(panel(spark, sf), weights(spark), scenarios(spark)), 0.01)
    return d.select("key", r("multiple", 8).alias("multiple"), "breach")


SHOCKS = [("1-URGENT", -0.05), ("3-MEDIUM", 0.02), ("9-OTHER", -0.5)]


def hypothetical_shock(spark: SparkSession, sf: str) -> DataFrame:
    held = panel(spark, sf).select("asset").distinct().join(weights(spark), "asset")
    return S.hypothetical_shock(held, spark.createDataFrame(SHOCKS, "asset string, shock double")).select(r("loss", 8).alias("loss"))


def performance_by_asset(spark: SparkSession, sf: str) -> DataFrame:
    d = P.performance_summary(returns(spark, sf), DAILY, "ret")
    return d.select("symbol", "n_obs", *[r(c).alias(c) for c in ("annual_return", "annual_volatility", "sharpe", "sortino", "max_drawdown", "hit_rate", "best", "worst", "calmar")])


EQ_SQL = RETURNS_SQL + """, eq AS (SELECT symbol, date, ret, exp(sum(ln(1 + ret)) OVER w) AS eq FROM rets WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT *, eq / max(eq) OVER w - 1 AS dd, eq / greatest(1, max(eq) OVER w) - 1 AS dd1 FROM eq WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))"""
PERF_SQL = EQ_SQL + """, p AS (SELECT symbol, count(*) AS n_obs, pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1 AS ar, stddev_samp(ret) * sqrt(252) AS av, avg(ret) / stddev_samp(ret) * sqrt(252) AS sh,
  avg(ret) / sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(252) AS so, min(dd) AS md, avg((ret > 0)::INT) AS hr, max(ret) AS best, min(ret) AS worst FROM dd GROUP BY symbol)
SELECT symbol, n_obs, round(ar, 6) AS annual_return, round(av, 6) AS annual_volatility, round(sh, 6) AS sharpe, round(so, 6) AS sortino, round(md, 6) AS max_drawdown, round(hr, 6) AS hit_rate, round(best, 6) AS best, round(worst, 6) AS worst,
  round(ar / abs(md), 6) AS calmar FROM p"""


def clean_returns(spark: SparkSession, sf: str) -> DataFrame:
    return returns(spark, sf).filter("ret IS NOT NULL")


def drawdown_episodes(spark: SparkSession, sf: str) -> DataFrame:
    d = P.drawdown_episodes(clean_returns(spark, sf), DAILY, "ret")
    return d.select("symbol", day("start"), day("trough"), day("end"), r("depth", 7).alias("depth"), "duration_days")


EPISODES_SQL = EQ_SQL + """, g AS (SELECT *, sum((NOT dd1 < 0)::INT) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM dd),
ep AS (SELECT symbol, g, min(date) AS s, arg_min(date, (dd1, date)) AS t, max(date) AS e, min(dd1) AS depth, count(*) AS n FROM g WHERE dd1 < 0 GROUP BY symbol, g)"""


def drawdown_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = P.drawdown_profile(clean_returns(spark, sf), DAILY, "ret")
    return d.select("symbol", *[r(c, 7).alias(c) for c in ("max_drawdown", "current_drawdown", "time_under_water")], "max_duration_days")


def worst_drawdowns(spark: SparkSession, sf: str) -> DataFrame:
    d = P.worst_episodes(P.drawdown_episodes(clean_returns(spark, sf), DAILY, "ret"), KEY, 3)
    return d.select("symbol", day("start"), r("depth", 7).alias("depth"), F.col("rank").cast("long").alias("rank"))


def strategy(spark: SparkSession, sf: str) -> DataFrame:
    sig = vwap_frame(spark, sf).select("symbol", "date", F.col("signal").alias("position"))
    return P.strategy_returns(sig, clean_returns(spark, sf), DAILY, cost_per_turn=2e-4)


def strategy_returns(spark: SparkSession, sf: str) -> DataFrame:
    return strategy(spark, sf).select("symbol", day(), "position", *[r(c, 8).alias(c) for c in ("gross", "turnover", "cost", "net")])


STRAT_SQL = VWAP_SQL + """, rr AS (SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) / 100 AS ret FROM daily),
j AS (SELECT symbol, date, signal AS position, ret FROM sig JOIN rr USING (symbol, date) WHERE ret IS NOT NULL),
st AS (SELECT *, position * ret AS gross, abs(position - coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY date), 0)) AS turnover FROM j),
strat AS (SELECT *, turnover * 2e-4 AS cost, gross - turnover * 2e-4 AS net, lag(position) OVER (PARTITION BY symbol ORDER BY date) AS pp FROM st)"""


def exposure_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = P.exposure_summary(strategy(spark, sf), DAILY)
    return d.select("symbol", "observations", *[r(c).alias(c) for c in ("long_share", "short_share", "flat_share", "time_in_market", "mean_abs_position")], "flips")


def loss_attribution(spark: SparkSession, sf: str) -> DataFrame:
    d = P.loss_attribution(strategy(spark, sf), KEY)
    return d.select("symbol", "losing_days", "wrong_way_days", "cost_only_days", *[r(c).alias(c) for c in ("total_cost_drag", "flat_day_share", "cost_only_share")])


def strategy_var(spark: SparkSession, sf: str) -> DataFrame:
    pos = strategy(spark, sf).select("symbol", "date", "position")
    d = P.position_scaled_var(pos, with_var(spark, sf).select("symbol", "date", "var"), ["symbol", "date"])
    return d.filter("strategy_var IS NOT NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.avg("strategy_var"), 8).alias("mean_var"), r(F.max("strategy_var"), 8).alias("max_var"))


def drawdown_in_r(spark: SparkSession, sf: str) -> DataFrame:
    d = R.running_drawdown(strategy(spark, sf), DAILY, "net")
    return d.groupBy("symbol").agg(r(F.min("drawdown"), 8).alias("worst"))


def paper_intents(spark: SparkSession, sf: str) -> DataFrame:
    sig = vwap_frame(spark, sf).select("symbol", "date", "signal")
    inst = spark.createDataFrame([(a, a != "5-LOW") for a, _ in WEIGHTS], "symbol string, shortable boolean")
    held = spark.createDataFrame([("1-URGENT", 1.0), ("2-HIGH", -0.5)], "symbol string, qty double")
    return P.intents(sig, inst, held).select("symbol", "signal", "held", "target", "delta", "order_side", "order_qty")


INTENT_SQL = VWAP_SQL + """, last AS (SELECT symbol, arg_max(signal, date) AS signal FROM sig GROUP BY symbol),
h AS (SELECT symbol, signal, coalesce(CASE symbol WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN -0.5 END, 0.0)::DOUBLE AS held, CASE WHEN signal < 0 AND symbol = '5-LOW' THEN 0.0 ELSE signal END::DOUBLE AS target FROM last)
SELECT symbol, signal, held, target, target - held AS delta, CASE WHEN target > held THEN 'buy' WHEN target < held THEN 'sell' END AS order_side, abs(target - held) AS order_qty FROM h"""


def slippage(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).withColumn("order_id", F.concat_ws("|", "symbol", F.col("date").cast("string")))
    log = d.select("order_id", F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0).alias("side"), F.col("open").alias("decision"))
    return P.reconcile(log, d.select("order_id", F.col("close").alias("fill"))).select("fills", r("mean_bp", 4).alias("mean_bp"), r("worst_bp", 4).alias("worst_bp"))


def quoted_cost(spark: SparkSession, sf: str) -> DataFrame:
    level = daily(spark, sf).groupBy("symbol").agg(F.percentile("close", F.lit(0.5)).alias("price"))
    return level.select("symbol", r(quote_bp(F.lit(12.0), 1.0, F.col("price"))).alias("spread_bp"), r(quote_bp(F.lit(12.0), 1.0, F.col("price")) / 2 + 0.3).alias("cost_bp"))


def garch_fit(spark: SparkSession, sf: str) -> DataFrame:
    return G.fit_garch(returns(spark, sf), DAILY, "ret").select("symbol", "omega", "alpha", "beta", "nu", "persistence", "loglik", "n_obs", "converged")


def garch_forecast(spark: SparkSession, sf: str) -> DataFrame:
    fits = G.fit_garch(returns(spark, sf), DAILY, "ret", student=False)
    last = G.filter_garch(clean_returns(spark, sf), fits, DAILY, "ret").groupBy("symbol").agg(F.max_by("variance", "date").alias("last"))
    return G.forecast(fits.join(last, "symbol"), F.col("last"), 10).select("symbol", "h", "variance")


def garch_var_path(spark: SparkSession, sf: str) -> DataFrame:
    f = G.rolling_garch(clean_returns(spark, sf), DAILY, "ret")
    return G.garch_var(f).select("symbol", "date", "variance", "nu", "var", "es")


def dcc_cov(spark: SparkSession, sf: str) -> DataFrame:
    return G.dcc_path(panel(spark, sf), [a for a, _ in WEIGHTS])


def rolling_dcc(spark: SparkSession, sf: str) -> DataFrame:
    return G.dcc_var_series(G.rolling_dcc(panel(spark, sf), [a for a, _ in WEIGHTS]), weights(spark))


def var_constructions(spark: SparkSession, sf: str) -> DataFrame:
    st = strategy(spark, sf)
    own = with_var(spark, sf).select("symbol", "date", "var")
    scaled = P.position_scaled_var(st, own, ["symbol", "date"]).withColumn("var", F.col("strategy_var")).select("symbol", "date", "position", "net", "var", F.lit("scaled").alias("construction"))
    naive = K.naive_strategy_var(st, DAILY, "net", 0.95, 250).select("symbol", "date", "position", "net", "var", F.lit("naive").alias("construction"))
    d = K.compare_constructions(scaled.unionByName(naive), Series(("construction", "symbol"), ("date",)), confidence=0.95)
    return d.select("construction", "symbol", "n_obs", "n_breaches", r("lopez_loss").alias("lopez_loss"))


CONSTRUCT_SQL = STRAT_SQL + """, h AS (SELECT symbol, date, CASE WHEN count(ret) OVER p >= 250 THEN -quantile_cont(ret, 0.05) OVER p END AS var FROM rr WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
nv AS (SELECT symbol, date, CASE WHEN count(net) OVER p >= 250 THEN -quantile_cont(net, 0.05) OVER p END AS var FROM strat WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
est AS (SELECT 'scaled' AS construction, s.symbol, s.net, abs(position) * var AS var, position FROM strat s JOIN h ON s.symbol = h.symbol AND s.date = h.date UNION ALL SELECT 'naive', s.symbol, s.net, var, position FROM strat s JOIN nv ON s.symbol = nv.symbol AND s.date = nv.date)
SELECT construction, symbol, count(*) AS n_obs, count(*) FILTER (-net > var) AS n_breaches, round(coalesce(sum(1 + pow((-net - var) * 100, 2)) FILTER (-net > var), 0), 6) AS lopez_loss FROM est WHERE position <> 0 AND var IS NOT NULL AND net IS NOT NULL GROUP BY ALL HAVING count(*) >= 100"""


def monte_carlo_var(spark: SparkSession, sf: str) -> DataFrame:
    return G.monte_carlo_by(clean_returns(spark, sf), DAILY, "ret")


def monte_carlo_methods(spark: SparkSession, sf: str) -> DataFrame:
    """All three methods by symbol and horizon, with the sampling error of each VaR."""
    return G.compare_methods(clean_returns(spark, sf), DAILY, "ret")


BOOT_HORIZONS, BOOT_PATHS, BOOT_RESAMPLES = (1, 5, 10), 2_000, 200


def bootstrap_var(spark: SparkSession, sf: str) -> DataFrame:
    """VaR and ES of resampled returns by horizon, with the standard error and interval of each VaR; draws are hashes."""
    sums = staged(W.resampled_sums(clean_returns(spark, sf), KEY, ("date",), "ret", BOOT_HORIZONS, BOOT_PATHS), "sums")
    d = W.risk_terms(W.quantile_errors(sums, ["symbol", "horizon"], "ret", 1 - 0.99, BOOT_PATHS, BOOT_RESAMPLES), ["symbol"])
    return d.select("symbol", "horizon", "paths", *[r(c, 8).alias(c) for c in ("var", "es", "stderr", "low", "high", "sqrt_time")], r("ratio_sqrt_time").alias("ratio_sqrt_time"))


def uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / {float(2**52)!r})"


BOOT_NAMES = ("0", "symbol", "horizon", "b")
BOOT_SQL = RETURNS_SQL + f""",
own AS (SELECT symbol, ret::DECIMAL(28, 18) AS ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE ret IS NOT NULL),
steps AS (SELECT symbol, n, horizon, path, step FROM (SELECT DISTINCT symbol, n FROM own), (VALUES {", ".join(f"({h})" for h in BOOT_HORIZONS)}) h(horizon), range({BOOT_PATHS}) p(path), range(1, {max(BOOT_HORIZONS) + 1}) s(step) WHERE step <= horizon),
drawn AS (SELECT *, floor({uniform_sql("0", "symbol", "horizon", "path", "step")} * n)::BIGINT + 1 AS i FROM steps),
sums AS (SELECT d.symbol, horizon, path, sum(ret)::DOUBLE AS ret FROM drawn d JOIN own o ON o.symbol = d.symbol AND o.i = d.i GROUP BY ALL),
q AS (SELECT symbol, horizon, count(*) AS n, quantile_cont(ret, {1 - 0.99!r}::DOUBLE) AS q, quantile_cont(ret, {W.tail_share(1 - 0.99, BOOT_PATHS)!r}::DOUBLE) AS cut FROM sums GROUP BY ALL),
tail AS (SELECT s.*, n, q FROM sums s JOIN q ON q.symbol = s.symbol AND q.horizon = s.horizon WHERE ret <= cut),
es AS (SELECT symbol, horizon, avg(ret) AS es FROM tail WHERE ret <= q GROUP BY ALL),
w0 AS (SELECT symbol, horizon, path, ret, n, b, {uniform_sql(*BOOT_NAMES, "path")} AS u FROM tail, range({BOOT_RESAMPLES}) r(b)),
w1 AS (SELECT *, {" + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in W.POISSON)} AS w FROM w0),
w2 AS (SELECT *, sum(w) OVER (PARTITION BY symbol, horizon, b ORDER BY ret, path ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY symbol, horizon, b) AS tw, n - count(*) OVER (PARTITION BY symbol, horizon, b) AS rest FROM w1),
x AS (SELECT symbol, horizon, b, min(ret) AS x FROM w2
  WHERE c >= {1 - 0.99!r}::DOUBLE * (tw + greatest(0, round(rest + sqrt(rest) * sqrt(-2 * ln(1 - {uniform_sql(*BOOT_NAMES, "'u'")})) * cos({2 * math.pi!r}::DOUBLE * {uniform_sql(*BOOT_NAMES, "'v'")})))) GROUP BY ALL),
se AS (SELECT symbol, horizon, stddev_samp(x) AS se FROM x GROUP BY ALL),
terms AS (SELECT q.symbol, q.horizon, q.n AS paths, -q.q AS var, -es.es AS es, se.se, first_value(-q.q) OVER w * sqrt(q.horizon / min(q.horizon) OVER (PARTITION BY q.symbol)) AS st
  FROM q JOIN es ON es.symbol = q.symbol AND es.horizon = q.horizon JOIN se ON se.symbol = q.symbol AND se.horizon = q.horizon WINDOW w AS (PARTITION BY q.symbol ORDER BY q.horizon))
SELECT symbol, horizon, paths, round(var, 8) AS var, round(es, 8) AS es, round(se, 8) AS stderr, round(var - 1.96 * se, 8) AS low, round(var + 1.96 * se, 8) AS high, round(st, 8) AS sqrt_time, round(var / nullif(st, 0), 6) AS ratio_sqrt_time FROM terms"""


def monthly_trend(spark: SparkSession, sf: str) -> DataFrame:
    t = strategy(spark, sf).filter("position <> 0").select("symbol", F.trunc("date", "month").alias("month"), F.col("position").alias("side"), F.col("net").alias("net_R"))
    return S.monthly_trend_gap(t, B.monthly_returns(daily(spark, sf))).select("n_cells", r("corr").alias("corr"), r("slope").alias("slope"), r("intercept").alias("intercept"))


TREND_SQL = STRAT_SQL + """, t AS (SELECT symbol, date_trunc('month', date)::DATE AS month, position AS side, net FROM strat WHERE position <> 0),
cell AS (SELECT symbol, month, avg(net) FILTER (side > 0) - avg(net) FILTER (side < 0) AS gap FROM t GROUP BY ALL),
m AS (SELECT symbol, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close FROM daily GROUP BY ALL),
mr AS (SELECT symbol, month, close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS ret FROM m)
SELECT count(*) AS n_cells, round(corr(gap, ret), 6) AS corr, round(regr_slope(gap, ret), 6) AS slope, round(regr_intercept(gap, ret), 6) AS intercept FROM cell JOIN mr USING (symbol, month) WHERE gap IS NOT NULL AND ret IS NOT NULL"""

ESNORM = dist.norm_pdf(Z99) / 0.01

QUERIES = {
    "historical_var_es": (historical_var_es, f"WITH {RETURNS_SQL}, q AS (SELECT symbol, quantile_cont(ret, 0.01) AS q, count(ret) AS n FROM rets WHERE ret IS NOT NULL GROUP BY symbol) SELECT symbol, any_value(n) AS n_obs, round(-any_value(q), 8) AS var, round(-avg(ret), 8) AS es FROM rets JOIN q USING (symbol) WHERE ret <= q AND n >= 30 GROUP BY symbol"),
    "gaussian_var_es": (gaussian_var_es, f"WITH {RETURNS_SQL} SELECT symbol, count(ret) AS n_obs, round(-(avg(ret) + {Z99!r} * stddev_samp(ret)), 8) AS var, round(-(avg(ret) - {ESNORM!r} * stddev_samp(ret)), 8) AS es FROM rets GROUP BY symbol"),
    "cornish_fisher_var": (cornish_fisher, cornish_fisher_sql()),
    "ewma_var_series": (ewma_var, ewma_var_sql()),
    "ewma_cov_last": (ewma_cov_last, f"WITH {COV_SQL} SELECT asset_i, asset_j, round(value, 12) AS value FROM cov"),
    "ewma_cov_path": (ewma_cov_path, f"WITH {COV_PATH_SQL}"),
    "correlation_last": (correlation_last, f"WITH {COV_SQL} SELECT c.asset_i, c.asset_j, round(CASE WHEN c.asset_i = c.asset_j THEN 1.0 ELSE c.value / sqrt(a.value * b.value) END, 8) AS value FROM cov c JOIN cov a ON a.asset_i = c.asset_i AND a.asset_j = c.asset_i JOIN cov b ON b.asset_i = c.asset_j AND b.asset_j = c.asset_j"),
    "ewma_corr_path": (ewma_corr_path, f"WITH {CORR_SQL} SELECT {D}, asset_i, asset_j, round(rho, 8) AS rho FROM rho"),
    "pairwise_table": (pairwise_table, f"WITH {CORR_SQL}, p AS (SELECT asset_i, asset_j, arg_max(rho, date) AS l, avg(rho) AS m, min(rho) AS lo, max(rho) AS hi FROM rho WHERE rho IS NOT NULL GROUP BY ALL), s AS (SELECT asset_i, asset_j, corr(x, y) AS s FROM pn GROUP BY ALL) SELECT asset_i, asset_j, round(s, 6) AS sample, round(l, 6) AS last, round(m, 6) AS mean, round(lo, 6) AS min, round(hi, 6) AS max, round(hi - lo, 6) AS range, round(l - s, 6) AS drift FROM p JOIN s USING (asset_i, asset_j)"),
    "dynamic_pairs": (dynamic_pairs, f"WITH {DYNAMIC_SQL}"),
    "pairwise_correlation": (pairwise_correlation, f"WITH {PAIRS_SQL} SELECT asset_i, asset_j, count(*) AS n_obs, round(covar_samp(x, y), 10) AS covariance, round(corr(x, y), 8) AS correlation FROM pn GROUP BY ALL"),
    "correlation_stress": (correlation_stress, f"WITH {STRESS_SQL}"),
    "best_partner_alignment": (best_partner, f"WITH {PARTNER_SQL}"),
    "portfolio_var": (portfolio_var, f"WITH {COV_SQL}, {WEIGHTS_SQL}, v AS (SELECT sum(a.weight * b.weight * value) AS v FROM full_cov JOIN weights a ON a.asset = asset_i JOIN weights b ON b.asset = asset_j) SELECT round(v, 12) AS variance, round({-Z99!r} * sqrt(v), 8) AS var, round({ESNORM!r} * sqrt(v), 8) AS es FROM v"),
    "component_var": (component_var, f"WITH {COMPONENT_SQL}"),
    "var_backtest_stats": (var_backtest, f"WITH {BT_SQL}"),
    "model_comparison": (model_comparison, f"WITH {MODELS_SQL}"),
    "scenario_replay": (scenario_replay, f"WITH {SCEN_SQL} SELECT key, round(total_return, 8) AS total_return, round(worst_day, 8) AS worst_day, round(vol, 8) AS volatility, round(mdd, 8) AS max_drawdown, 1.0::DOUBLE AS coverage, CAST(worst_date AS VARCHAR) AS worst_date, n_days, '' AS missing FROM res"),
    "stress_vs_var": (stress_vs_var, f"WITH {SCEN_SQL} SELECT key, round(-worst_day / 0.01, 8) AS multiple, -worst_day > 0.01 AS breach FROM res"),
    "hypothetical_shock": (hypothetical_shock, f"WITH {PANEL_SQL}, {WEIGHTS_SQL} SELECT round(sum(weight * CASE asset WHEN '1-URGENT' THEN -0.05 WHEN '3-MEDIUM' THEN 0.02 ELSE 0 END)::DOUBLE, 8) AS loss FROM weights WHERE asset IN (SELECT asset FROM panel)"),
    "performance_by_asset": (performance_by_asset, f"WITH {PERF_SQL}"),
    "drawdown_episodes": (drawdown_episodes, f"WITH {EPISODES_SQL} SELECT symbol, CAST(s AS VARCHAR) AS start, CAST(t AS VARCHAR) AS trough, CAST(e AS VARCHAR) AS end, round(depth, 7) AS depth, n AS duration_days FROM ep"),
    "drawdown_profile": (drawdown_profile, f"WITH {EPISODES_SQL}, l AS (SELECT symbol, max(n) AS n FROM ep GROUP BY symbol), a AS (SELECT symbol, min(dd1) AS m, arg_max(dd1, date) AS c, avg((dd1 < 0)::INT) AS u FROM dd GROUP BY symbol) SELECT symbol, round(m, 7) AS max_drawdown, round(c, 7) AS current_drawdown, round(u, 7) AS time_under_water, coalesce(n, 0) AS max_duration_days FROM a LEFT JOIN l USING (symbol)"),
    "worst_drawdowns": (worst_drawdowns, f"WITH {EPISODES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, s) AS rank FROM ep) SELECT symbol, CAST(s AS VARCHAR) AS start, round(depth, 7) AS depth, rank FROM k WHERE rank <= 3"),
    "strategy_returns": (strategy_returns, f"WITH {STRAT_SQL} SELECT symbol, {D}, position, round(gross, 8) AS gross, round(turnover, 8) AS turnover, round(cost, 8) AS cost, round(net, 8) AS net FROM strat"),
    "exposure_summary": (exposure_summary, f"WITH {STRAT_SQL} SELECT symbol, count(*) AS observations, round(avg((position > 0)::INT), 6) AS long_share, round(avg((position < 0)::INT), 6) AS short_share, round(avg((position = 0)::INT), 6) AS flat_share, round(1 - avg((position = 0)::INT), 6) AS time_in_market, round(avg(abs(position)), 6) AS mean_abs_position, count(*) FILTER (pp IS NOT NULL AND pp <> position) AS flips FROM strat GROUP BY symbol"),
    "loss_attribution": (loss_attribution, f"WITH {STRAT_SQL} SELECT symbol, count(*) FILTER (net < 0) AS losing_days, count(*) FILTER (net < 0 AND gross < 0) AS wrong_way_days, count(*) FILTER (net < 0 AND gross >= 0) AS cost_only_days, round(sum(cost), 6) AS total_cost_drag, round(avg((position = 0)::INT), 6) AS flat_day_share, round(count(*) FILTER (net < 0 AND gross >= 0) / count(*) FILTER (net < 0), 6) AS cost_only_share FROM strat GROUP BY symbol"),
    "position_scaled_var": (strategy_var, f"WITH {STRAT_SQL}, h AS (SELECT symbol, date, CASE WHEN count(ret) OVER p >= 250 THEN -quantile_cont(ret, 0.05) OVER p END AS var FROM rr WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)) SELECT symbol, count(*) AS n, round(avg(abs(position) * var), 8) AS mean_var, round(max(abs(position) * var), 8) AS max_var FROM strat JOIN h USING (symbol, date) WHERE var IS NOT NULL GROUP BY symbol"),
    "drawdown_in_r": (drawdown_in_r, f"WITH {STRAT_SQL}, c AS (SELECT symbol, date, sum(net) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM strat), d AS (SELECT symbol, s - max(s) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS dd FROM c) SELECT symbol, round(min(dd), 8) AS worst FROM d GROUP BY symbol"),
    "paper_intents": (paper_intents, f"WITH {INTENT_SQL}"),
    "slippage_reconcile": (slippage, f"WITH {DAILY_SQL}, s AS (SELECT CASE WHEN close > open THEN 1 ELSE -1 END * (close / open - 1) * 1e4 AS s FROM daily) SELECT count(*) AS fills, round(avg(s), 4) AS mean_bp, round(max(s), 4) AS worst_bp FROM s"),
    "quoted_cost": (quoted_cost, f"WITH {DAILY_SQL}, p AS (SELECT symbol, median(close) AS p FROM daily GROUP BY symbol) SELECT symbol, round(12.0 / p * 1e4, 6) AS spread_bp, round(12.0 / p * 1e4 / 2 + 0.3, 6) AS cost_bp FROM p"),
    "monthly_trend_gap": (monthly_trend, f"WITH {TREND_SQL}"),
    "garch_fit": (garch_fit, None),
    "garch_forecast": (garch_forecast, None),
    "garch_var_path": (garch_var_path, None),
    "dcc_cov": (dcc_cov, None),
    "rolling_dcc_var": (rolling_dcc, None),
    "var_constructions": (var_constructions, f"WITH {CONSTRUCT_SQL}"),
    "monte_carlo_var": (monte_carlo_var, None),
    "monte_carlo_methods": (monte_carlo_methods, None),
    "bootstrap_var": (bootstrap_var, f"WITH {BOOT_SQL}"),
}
