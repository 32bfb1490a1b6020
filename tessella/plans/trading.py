"""Queries on patterns, barrier trades, research statistics and walk-forward selection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ordering import Series
from tessella.functions.scalars import implied_drift_of
from tessella.operators import barriers as T
from tessella.operators import bars as B
from tessella.operators import calendar as C
from tessella.operators import garch as G
from tessella.operators import joins as J
from tessella.operators import patterns as N
from tessella.operators import research as Q
from tessella.operators import rolling as R
from tessella.plans.base import DAILY, DAILY_SQL, HOURLY, HOURLY_SQL, daily, hourly
from tessella.plans.market import AT, GAP_SQL, RESEARCH_SQL, ZONE, D, day, ewm_sql, features, gaps, r, sessions, stamp
from tessella.sources.stage import staged

KEY = ("symbol",)


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with prices as exp of a tenth of their logarithm's distance to the first: the synthetic prices jump by factors, and
    patterns need paths."""
    d = daily(spark, sf)
    low = F.ln(F.lit(1000.0))
    return d.withColumns({c: 100 * F.exp((F.ln(c) - low) / 50) for c in B.OHLC})


def price_sql(c: str) -> str:
    return f"100 * exp((ln({c}) - ln(1000.0::DOUBLE)) / 50) AS {c}"


#: From `pb` (symbol, date, OHLCV, bar): returns, sigma and prior extremes.
PATTERN_SQL = f""",
lr AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS lr FROM pb),
sq AS (SELECT symbol, date, sqrt({ewm_sql("lr * lr", 1 - 0.94, "symbol", "date", "bar")}) AS s FROM lr WHERE lr IS NOT NULL),
b AS (SELECT lr.*, lag(s) OVER (PARTITION BY lr.symbol ORDER BY lr.date) AS sigma, CASE WHEN bar >= 20 THEN max(high) OVER p END AS hi_prev, CASE WHEN bar >= 20 THEN min(low) OVER p END AS lo_prev
  FROM lr LEFT JOIN sq ON lr.symbol = sq.symbol AND lr.date = sq.date WINDOW p AS (PARTITION BY lr.symbol ORDER BY lr.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
LOGS_SQL = (
    DAILY_SQL
    + f""", pb AS (SELECT symbol, date, {", ".join(price_sql(c) for c in B.OHLC)}, volume,
  row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS bar FROM daily)"""
    + PATTERN_SQL
)


def sweeps(spark: SparkSession, sf: str) -> DataFrame:
    d = N.sweeps(logs(spark, sf), DAILY)
    return d.filter("sweep <> 0").select("symbol", day(), "sweep", r("level").alias("level"), r("pierce").alias("pierce"))


SWEEP_PART = """, sw AS (SELECT *, low < lo_prev AND close > lo_prev AND (lo_prev - low) / (sigma * close) >= 0.25 AND (close - low) / nullif(high - low, 0) >= 0.5 AS bull,
  high > hi_prev AND close < hi_prev AND (high - hi_prev) / (sigma * close) >= 0.25 AND (close - low) / nullif(high - low, 0) <= 0.5 AS bear FROM b),
sweep AS (SELECT *, CASE WHEN bull THEN 1.0 WHEN bear THEN -1.0 ELSE 0.0 END::DOUBLE AS sweep FROM sw)"""
SWEEP_SQL = LOGS_SQL + SWEEP_PART


def reversal_entries(spark: SparkSession, sf: str) -> DataFrame:
    return N.reversal_entries(logs(spark, sf), DAILY).select("symbol", "bar", "side", r("entry").alias("entry"), r("stop").alias("stop"))


def swings(spark: SparkSession, sf: str) -> DataFrame:
    return N.swings(logs(spark, sf), DAILY).select("symbol", day(), r("swing_low").alias("swing_low"), r("swing_high").alias("swing_high"))


SWINGS_SQL = LOGS_SQL + ", m AS (SELECT *, lag(low, 2) OVER o AS ml, lag(high, 2) OVER o AS mh, list(low) OVER w AS ll, list(high) OVER w AS hh FROM pb WINDOW o AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))," + """
c AS (SELECT *, CASE WHEN len(ll) = 5 AND ml = list_min(ll) AND len(list_filter(ll, lambda v: v = ml)) = 1 THEN ml END AS sl, CASE WHEN len(hh) = 5 AND mh = list_max(hh) AND len(list_filter(hh, lambda v: v = mh)) = 1 THEN mh END AS sh FROM m)
SELECT symbol, CAST(c.date AS VARCHAR) AS date, round(last_value(sl IGNORE NULLS) OVER u, 6) AS swing_low, round(last_value(sh IGNORE NULLS) OVER u, 6) AS swing_high FROM c WINDOW u AS (PARTITION BY symbol ORDER BY c.date ROWS UNBOUNDED PRECEDING)"""


def zone_cols(d: DataFrame) -> DataFrame:
    return d.select("symbol", "known_bar", "side", r("lo").alias("lo"), r("hi").alias("hi"), "formed_bar")


def fair_value_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return zone_cols(N.fair_value_gaps(logs(spark, sf), DAILY))


FVG_PART = """, g AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(low, 1) OVER w AS l1 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
f AS (SELECT *, h2 < low AND low - h2 >= 0.25 * sigma * l1 AS up, l2 > high AND l2 - high >= 0.25 * sigma * l1 AS down FROM g WHERE sigma > 0),
fvg AS (SELECT symbol, bar AS known_bar, CASE WHEN up THEN 1.0 ELSE -1.0 END::DOUBLE AS side, CASE WHEN up THEN h2 ELSE high END AS lo, CASE WHEN up THEN low ELSE l2 END AS hi, bar - 1 AS formed_bar FROM f WHERE up OR down)"""
FVG_SQL = LOGS_SQL + FVG_PART


def order_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return zone_cols(N.order_blocks(logs(spark, sf), DAILY))


OB_SQL = """, x AS (SELECT *, last_value(CASE WHEN close < open AND bar > 0 THEN {'bar': bar, 'low': low, 'high': high} END IGNORE NULLS) OVER p AS dn, last_value(CASE WHEN close > open AND bar > 0 THEN {'bar': bar, 'low': low, 'high': high} END IGNORE NULLS) OVER p AS up
  FROM b WINDOW p AS (PARTITION BY symbol ORDER BY b.date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
obx AS (SELECT symbol, bar, CASE WHEN close > hi_prev THEN 1.0 WHEN close < lo_prev THEN -1.0 END::DOUBLE AS side, CASE WHEN close > hi_prev THEN dn WHEN close < lo_prev THEN up END AS z FROM x WHERE bar > 20),
ob AS (SELECT symbol, bar AS known_bar, side, z.low AS lo, z.high AS hi, z.bar AS formed_bar FROM obx WHERE z IS NOT NULL)"""


def zone_touch(spark: SparkSession, sf: str) -> DataFrame:
    b = T.numbered_bars(logs(spark, sf), DAILY)
    both = b.withColumn("side", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    return J.touches_zone(both, N.zones(logs(spark, sf), DAILY), KEY).select("symbol", day(), "side")


def signal_bars(spark: SparkSession, sf: str) -> DataFrame:
    """logs with sigma and a signal: the side of the last bar's change."""
    d = N.with_sigma(logs(spark, sf), DAILY)
    return d.withColumn("signal", F.coalesce(F.signum(DAILY.lag("lr")), F.lit(0.0)))


def walked(spark: SparkSession, sf: str) -> DataFrame:
    return T.walk(signal_bars(spark, sf), DAILY, T.Barriers(1.0, 1.5, 8, 2.0))


def barrier_walk(spark: SparkSession, sf: str) -> DataFrame:
    d = walked(spark, sf)
    return d.select("symbol", day(), "side", r("entry").alias("entry"), r("exit").alias("exit"), "outcome", "bars_held", "ambiguous", r("cost_R").alias("cost_R"), r("net_R").alias("net_R"))


#: Outcomes of candidates by a self-join on the next bars, then the greedy choice by recursion over the candidates of a symbol.
OUTCOME_SQL = """, ends AS (SELECT symbol, max(bar) AS last FROM b GROUP BY symbol),
ahead AS (SELECT c.symbol, c.bar, c.side, c.entry, c.stop, c.target, f.bar AS j, f.close AS cl, CASE WHEN c.side > 0 THEN f.high >= c.target ELSE f.low <= c.target END AS ht, CASE WHEN c.side > 0 THEN f.low <= c.stop ELSE f.high >= c.stop END AS hs
  FROM cand c JOIN b f ON f.symbol = c.symbol AND f.bar BETWEEN c.bar + 1 AND c.bar + {n}),
firsts AS (SELECT symbol, bar, side, any_value(entry) AS entry, any_value(stop) AS stop, any_value(target) AS target, min(j) FILTER (ht OR hs) AS hit, max(j) AS lastj, arg_max(cl, j) AS lastc FROM ahead GROUP BY symbol, bar, side),
outc AS (SELECT f.*, a.ht, a.hs, coalesce(hit, lastj) - f.bar AS held, CASE WHEN hit IS NULL THEN 'time' WHEN a.hs THEN 'stop' ELSE 'target' END AS outcome, coalesce(a.ht AND a.hs, false) AS ambiguous,
  CASE WHEN hit IS NULL THEN lastc WHEN a.hs THEN f.stop ELSE f.target END AS exit FROM firsts f LEFT JOIN ahead a ON a.symbol = f.symbol AND a.bar = f.bar AND a.side = f.side AND a.j = f.hit),
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS k, bar + greatest(held, 1) AS free FROM outc),
taken AS (SELECT symbol, k, bar, free, true AS take FROM num WHERE k = 1 UNION ALL SELECT n.symbol, n.k, n.bar, CASE WHEN n.bar >= t.free THEN n.free ELSE t.free END, n.bar >= t.free FROM taken t JOIN num n ON n.symbol = t.symbol AND n.k = t.k + 1),
trades AS (SELECT n.* FROM num n JOIN taken t ON t.symbol = n.symbol AND t.k = n.k WHERE t.take)"""

WALK_SQL = LOGS_SQL + """, s AS (SELECT *, coalesce(sign(lag(lr) OVER (PARTITION BY symbol ORDER BY date)), 0) AS sig FROM b),
fl AS (SELECT *, coalesce(lag(sig) OVER (PARTITION BY symbol ORDER BY date), 0) AS ps FROM s),
cand AS (SELECT symbol, bar, date, sig AS side, close AS entry, close - sig * sigma * close AS stop, close + sig * sigma * close * 1.5 AS target FROM fl WHERE sig <> ps AND sig <> 0 AND sigma > 0)""" + OUTCOME_SQL.replace("{n}", "8") + """,
walk AS (SELECT t.*, cand.date, 4.0 / 1e4 * t.entry / abs(t.entry - t.stop) AS cost_R, t.side * (t.exit - t.entry) / abs(t.entry - t.stop) - 4.0 / 1e4 * t.entry / abs(t.entry - t.stop) AS net_R FROM trades t JOIN cand ON cand.symbol = t.symbol AND cand.bar = t.bar)"""
WALK_SQL = "WITH RECURSIVE " + WALK_SQL


def summary_cols(d: DataFrame) -> DataFrame:
    return d.select("symbol", "trades", *[r(c).alias(c) for c in ("win_rate", "barrier_win_rate", "mean_cost_R", "time_share", "target_share", "stop_share", "ambiguous_share", "mean_bars", "mean_net_R", "hurdle", "gap")])


def barrier_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary_cols(T.barrier_summary(walked(spark, sf), KEY, 1.5))


def touch_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    d = T.touch_benchmark(walked(spark, sf), KEY)
    return d.select("symbol", "n", r("observed").alias("observed"), r("expected").alias("expected"), r("z").alias("z"))


TOUCH_SQL = WALK_SQL + """, p AS (SELECT symbol, outcome, abs(ln(entry / stop)) / (abs(ln(target / entry)) + abs(ln(entry / stop))) AS p FROM walk WHERE outcome IN ('target', 'stop')),
tz AS (SELECT symbol, count(*) AS n, avg((outcome = 'target')::INT) AS observed, avg(p) AS expected, (avg((outcome = 'target')::INT) - avg(p)) * count(*) / sqrt(sum(p * (1 - p))) AS z FROM p GROUP BY symbol)"""


def pooled_z(spark: SparkSession, sf: str) -> DataFrame:
    return T.pooled_z(T.touch_benchmark(walked(spark, sf), KEY)).select(r("z").alias("z"))


def drop_one(spark: SparkSession, sf: str) -> DataFrame:
    return T.drop_one(walked(spark, sf), "symbol").select("dropped", "trades", r("mean_net_R").alias("mean_net_R"))


SYMBOLS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def subset_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return T.subsets(walked(spark, sf), "symbol", SYMBOLS).select("subset", "trades", r("mean_net_R").alias("mean_net_R"), r("mean_cost_R").alias("mean_cost_R"))


def sweep_trades(spark: SparkSession, sf: str, **options) -> DataFrame:
    b = logs(spark, sf)
    return T.walk_explicit(b, N.reversal_entries(b, DAILY), DAILY, rr=2.0, max_bars=10, cost_bp=1.0, **options)


def explicit_walk(spark: SparkSession, sf: str) -> DataFrame:
    d = sweep_trades(spark, sf)
    return d.select("symbol", "bar", "side", r("exit").alias("exit"), "outcome", "bars_held", "ambiguous", r("net_R").alias("net_R"))


def explicit_walk_breakeven(spark: SparkSession, sf: str) -> DataFrame:
    d = sweep_trades(spark, sf, breakeven_frac=0.01, allow_overlap=True)
    return d.groupBy("symbol", "outcome").agg(F.count(F.lit(1)).alias("n"), r(F.avg("net_R")).alias("mean_net_R"), F.count_if("be_armed").alias("armed"))


EXPLICIT_SQL = "WITH RECURSIVE " + SWEEP_SQL + """, mx AS (SELECT symbol, max(bar) AS mb FROM b GROUP BY symbol),
cand AS (SELECT s.symbol, bar, date, sweep AS side, close AS entry, close - sweep * greatest(abs(close - CASE WHEN sweep > 0 THEN low ELSE high END), sigma * close) AS stop,
  close + sweep * 2 * greatest(abs(close - CASE WHEN sweep > 0 THEN low ELSE high END), sigma * close) AS target FROM sweep s JOIN mx ON s.symbol = mx.symbol WHERE sweep <> 0 AND sigma > 0 AND bar > 20 AND bar < mb)""" + OUTCOME_SQL.replace("{n}", "10")


BREAKEVEN_SQL = EXPLICIT_SQL.split(", ends AS (")[0] + """,
ah AS (SELECT c.symbol, c.bar, c.side, c.entry, c.stop, c.target, f.bar AS j, f.close AS cl, CASE WHEN c.side > 0 THEN f.high >= c.target ELSE f.low <= c.target END AS ht,
  CASE WHEN c.side > 0 THEN f.low <= c.stop ELSE f.high >= c.stop END AS hs, CASE WHEN c.side > 0 THEN f.low <= c.entry ELSE f.high >= c.entry END AS hb,
  CASE WHEN c.side > 0 THEN f.close >= c.entry + c.side * 0.01 * c.entry ELSE f.close <= c.entry + c.side * 0.01 * c.entry END AS arm
  FROM cand c JOIN b f ON f.symbol = c.symbol AND f.bar BETWEEN c.bar + 1 AND c.bar + 10),
f1 AS (SELECT symbol, bar, side, any_value(entry) AS entry, any_value(stop) AS stop, any_value(target) AS target, min(j) FILTER (ht OR hs) AS hit, min(j) FILTER (arm) AS aj, arg_max(cl, j) AS lastc FROM ah GROUP BY symbol, bar, side),
f2 AS (SELECT f1.*, f1.aj IS NOT NULL AND (f1.hit IS NULL OR f1.hit > f1.aj) AS armed, s.j2 FROM f1
  LEFT JOIN (SELECT a.symbol, a.bar, a.side, min(a.j) AS j2 FROM ah a JOIN f1 x ON a.symbol = x.symbol AND a.bar = x.bar AND a.side = x.side WHERE a.j > x.aj AND (a.ht OR a.hb) GROUP BY ALL) s ON s.symbol = f1.symbol AND s.bar = f1.bar AND s.side = f1.side),
f3 AS (SELECT *, CASE WHEN armed THEN j2 ELSE hit END AS h FROM f2),
be AS (SELECT f3.*, CASE WHEN h IS NULL THEN 'time' WHEN armed AND a.hb THEN 'breakeven' WHEN NOT armed AND a.hs THEN 'stop' ELSE 'target' END AS outcome,
  CASE WHEN h IS NULL THEN lastc WHEN armed AND a.hb THEN f3.entry WHEN NOT armed AND a.hs THEN f3.stop ELSE f3.target END AS exit FROM f3 LEFT JOIN ah a ON a.symbol = f3.symbol AND a.bar = f3.bar AND a.side = f3.side AND a.j = f3.h)
SELECT symbol, outcome, count(*) AS n, round(avg(side * (exit - entry) / abs(entry - stop) - 2.0 / 1e4 * entry / abs(entry - stop)), 6) AS "mean_net_R", count(*) FILTER (armed) AS armed FROM be GROUP BY ALL"""


def mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    f = C.flags(daily(spark, sf), keys=KEY).withColumn("range", F.ln(F.col("high") / F.col("low")))
    d = Q.mann_whitney(f.filter("volume >= 2"), "range", "turn", KEY)
    return d.select("symbol", "n_event", "n_other", r("u").alias("u"), r("z").alias("z"), r("mean_ratio").alias("mean_ratio"))


MW_SQL = DAILY_SQL + """, f AS (SELECT *, date = max(date) OVER w OR date = min(date) OVER w AS g, ln(high / low) AS x FROM daily WINDOW w AS (PARTITION BY symbol, date_trunc('month', date))),
v AS (SELECT * FROM f WHERE volume >= 2), k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY symbol, x) AS t FROM v),
a AS (SELECT symbol, (count(*) FILTER (g))::DOUBLE AS n1, (count(*) FILTER (NOT g))::DOUBLE AS n2, sum(rk) FILTER (g) AS r1, sum(t * t - 1) AS ties, avg(x) FILTER (g) / avg(x) FILTER (NOT g) AS ratio FROM k GROUP BY symbol)
SELECT symbol, n1::BIGINT AS n_event, n2::BIGINT AS n_other, round(r1 - n1 * (n1 + 1) / 2, 6) AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z, round(ratio, 6) AS mean_ratio FROM a"""


def gap_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = Q.gap_stats(gaps(spark, sf), "trade", KEY)
    return d.select("symbol", "n", r("mean").alias("mean"), r("t").alias("t"), r("sharpe").alias("sharpe"))


def clustering(spark: SparkSession, sf: str) -> DataFrame:
    return Q.realised_clustering(N.with_sigma(logs(spark, sf), DAILY), DAILY, "lr").select("symbol", r("clustering").alias("clustering"))


def ic_input(spark: SparkSession, sf: str) -> DataFrame:
    d = N.with_sigma(logs(spark, sf), DAILY)
    d = d.withColumns({"mom": F.col("lr"), "vol": F.col("volume").cast("double") + F.col("lr"), "range": F.ln(F.col("high") / F.col("low")) + F.col("lr") / 7})
    d = R.forward_returns(d, DAILY, (1, 4))
    pairs = [F.struct(F.lit(f).alias("feature"), F.lit(h).alias("horizon"), F.col(f).alias("x"), F.col(f"fwd_{h}").alias("y")) for f in ("mom", "vol", "range") for h in (1, 4)]
    return d.withColumn("t", F.explode(F.array(*pairs))).select("symbol", "date", "t.*")


def ic_cells(spark: SparkSession, sf: str) -> DataFrame:
    quarter = F.concat_ws("-", F.year("date"), F.quarter("date"))
    return Q.cell_ics(ic_input(spark, sf), "x", "y", quarter, "date", ("symbol", "feature", "horizon"), least=20)


def rank_ic(spark: SparkSession, sf: str) -> DataFrame:
    return ic_cells(spark, sf).select("symbol", "feature", "horizon", F.col("month").alias("quarter"), "n", r("ic").alias("ic"), r("edge_bp").alias("edge_bp"))


IC_SQL = LOGS_SQL + """, fw AS (SELECT symbol, date, lr AS mom, volume + lr AS vol, ln(high / low) + lr / 7 AS range, ln(lead(close, 1) OVER w / close) AS f1, ln(lead(close, 4) OVER w / close) AS f4 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
u AS (""" + " UNION ALL ".join(f"SELECT symbol, date, '{f}' AS feature, {h} AS horizon, {f} AS x, f{h} AS y FROM fw" for f in ("mom", "vol", "range") for h in (1, 4)) + """),
m AS (SELECT *, concat(year(date), '-', quarter(date)) AS q FROM u WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY symbol, feature, horizon, q ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, horizon, q, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol, feature, horizon, q ORDER BY y) + (count(*) OVER (PARTITION BY symbol, feature, horizon, q, y) - 1) / 2.0 AS ry,
  row_number() OVER (PARTITION BY symbol, feature, horizon, q ORDER BY x, date) AS rn, count(*) OVER (PARTITION BY symbol, feature, horizon, q) AS nn FROM m),
ic AS (SELECT symbol, feature, horizon, q, count(*) AS n, corr(rx, ry) AS ic, (avg(y) FILTER (greatest(1, ceil(5.0 * (rn - 1) / (nn - 1))) = 5) - avg(y) FILTER (greatest(1, ceil(5.0 * (rn - 1) / (nn - 1))) = 1)) / 2 * 1e4 AS edge_bp
  FROM rk GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT x) >= 5)"""


def ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = Q.ic_summary(ic_cells(spark, sf), ("feature", "horizon"))
    return d.select("feature", "horizon", "cells", *[r(c).alias(c) for c in ("mean_ic", "t", "hit", "edge_bp")])


def holm_survivors(spark: SparkSession, sf: str) -> DataFrame:
    d = Q.with_p_values(Q.ic_summary(ic_cells(spark, sf), ("feature", "horizon")))
    return Q.holm(d, tie=("feature", "horizon")).select("feature", "horizon", r("p").alias("p"), "reject")


def p_sql(t: str, n: str) -> str:
    """The two-sided p of t with n - 1 degrees of freedom, as an integral over the angle (Simpson's rule), which has nothing in common with the
    continued fraction."""
    return f"""(SELECT 2 * exp(lgamma({n} / 2.0) - lgamma(({n} - 1) / 2.0)) / sqrt(pi()) * (pi() / 2 - any_value(th)) / 6000
      * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(0, cos(th + k * (pi() / 2 - th) / 2000)), {n} - 2))
      FROM range(2001) r(k), (SELECT atan(abs({t}) / sqrt({n} - 1)) AS th))"""


#: The error that a study of driftless paths would show, taken as H0.
NULL_BIAS = 0.01


def excess_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """Wins beyond the touch probability, by symbol and over all, with cells of symbols and months as clusters; and the drift that would
    explain the win rate at the mean distances."""
    t = walked(spark, sf)
    tests = Q.clustered(Q.excess_cells(t, Q.month_of("date")), KEY, NULL_BIAS)
    met = t.filter("outcome <> 'time'")
    far = met.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("outcome") == "target").cast("double")).alias("win_rate"), F.avg(F.abs(F.ln(F.col("target") / F.col("entry")))).alias("a"), F.avg(F.abs(F.ln(F.col("entry") / F.col("stop")))).alias("b")
    )
    d = tests.join(far, "symbol", "left").withColumn("drift", implied_drift_of(F.col("a"), F.col("b"), F.col("win_rate"), F.lit(0.1)))
    return d.select("symbol", "cells", *[r(c).alias(c) for c in ("mean", "corrected", "t", "p", "win_rate", "drift")])


def reach_sql(d: str) -> str:
    nu = f"({d} - 0.005)"
    return f"""CASE WHEN {d} = 0 OR abs({nu}) < 1e-12 THEN b / (a + b) ELSE least(1, greatest(0, (exp(least(200 * {nu} * b, 700)) - 1) / (exp(least(200 * {nu} * b, 700)) - exp(least(-200 * {nu} * a, 700))))) END"""


EXCESS_SQL = (
    WALK_SQL + f""",
met AS (SELECT *, (outcome = 'target')::INT::DOUBLE AS won, abs(ln(target / entry)) AS a, abs(ln(entry / stop)) AS b FROM walk WHERE outcome <> 'time'),
cells AS (SELECT symbol, strftime(date, '%Y-%m') AS month, avg(won - b / (a + b)) AS m FROM met WHERE a > 0 AND b > 0 GROUP BY ALL HAVING count(*) >= 3),
tests AS (SELECT symbol, count(*) AS cells, avg(m) AS mean, CASE WHEN count(*) >= 3 THEN (avg(m) - {NULL_BIAS}) * sqrt(count(*)) / nullif(stddev_samp(m), 0) END AS t FROM cells GROUP BY GROUPING SETS ((symbol), ())),
far AS (SELECT symbol, avg(won) AS win_rate, avg(a) AS a, avg(b) AS b FROM met GROUP BY symbol),
halves AS (SELECT symbol, 0 AS k, -5.0::DOUBLE AS lo, 5.0::DOUBLE AS hi, a, b, win_rate FROM far
  UNION ALL SELECT symbol, k + 1, CASE WHEN {reach_sql("((lo + hi) / 2)")} < win_rate THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {reach_sql("((lo + hi) / 2)")} < win_rate THEN hi ELSE (lo + hi) / 2 END, a, b, win_rate FROM halves WHERE k < 80)
SELECT t.symbol, cells, round(mean, 6) AS mean, round(mean - {NULL_BIAS}, 6) AS corrected, round(t, 6) AS t, round({p_sql("t.t", "t.cells")}, 6) AS p, round(f.win_rate, 6) AS win_rate,
  round(CASE WHEN f.win_rate > 0 AND f.win_rate < 1 THEN (lo + hi) / 2 END, 6) AS drift FROM tests t LEFT JOIN far f ON f.symbol = t.symbol LEFT JOIN halves h ON h.symbol = t.symbol AND h.k = 80"""
)


def holm_given(spark: SparkSession, sf: str) -> DataFrame:
    """Holm on 1 / (1 + t^2) ** 4 of each test: a given p, so that SQL can follow."""
    d = Q.ic_summary(ic_cells(spark, sf), ("feature", "horizon")).withColumn("p", 1 / F.pow(1 + F.col("t") * F.col("t"), F.lit(4.0)))
    return Q.holm(d, tie=("feature", "horizon")).select("feature", "horizon", r("p").alias("p"), "reject")


ICS_SQL = IC_SQL + """, s AS (SELECT feature, horizon, count(*) AS cells, avg(ic) AS m, avg(ic) * sqrt(count(*)) / stddev_samp(ic) AS t, avg((ic > 0)::INT) AS pos, avg((ic < 0)::INT) AS neg, avg(edge_bp) AS e FROM ic GROUP BY ALL)"""
HOLM_SQL = ICS_SQL + """, p AS (SELECT feature, horizon, 1 / pow(1 + t * t, 4) AS p FROM s), k AS (SELECT *, row_number() OVER (ORDER BY p, feature, horizon) AS k, count(*) OVER () AS m FROM p),
z AS (SELECT *, min((p <= 0.05 / (m - k + 1))::INT) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) = 1 AS reject FROM k) SELECT feature, horizon, round(p, 6) AS p, reject FROM z"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    b = logs(spark, sf)
    e = N.sweeps(b, DAILY).filter("sweep <> 0").select("symbol", "date", F.col("sweep").alias("side"))
    return Q.signed_forward(b, e, DAILY, (1, 4))


def event_study(spark: SparkSession, sf: str) -> DataFrame:
    c = Q.cell_means(events(spark, sf), "fwd_1", F.year("date").cast("string"))
    return c.select("symbol", F.col("month").alias("year"), "n", r("mean", 5).alias("mean"))


def event_pooled(spark: SparkSession, sf: str) -> DataFrame:
    d = Q.pooled(Q.cell_means(events(spark, sf), "fwd_1", F.year("date").cast("string")))
    return d.select("cells", r("mean", 5).alias("mean"), r("t").alias("t"), r("share_pos").alias("share_pos"))


EVENT_SQL = SWEEP_SQL + """, fw AS (SELECT *, sweep * ln(lead(close) OVER (PARTITION BY symbol ORDER BY date) / close) * 1e4 AS f1 FROM sweep),
cells AS (SELECT symbol, CAST(year(date) AS VARCHAR) AS year, count(*) AS n, avg(f1) AS mean FROM fw WHERE sweep <> 0 AND f1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)"""


def reversion(spark: SparkSession, sf: str) -> DataFrame:
    d = features(spark, sf)
    for c in ("flow_proxy", "mom_1h"):
        d = R.trailing_rank(d, HOURLY, c, 100, 40, f"rank_{c}")
    d = d.withColumn("score", Q.reversion_score(d, {"rank_flow_proxy": 1, "rank_mom_1h": 1}))
    nights = C.nights_between(B.local("ts", ZONE), B.local(HOURLY.lead("ts", 24), ZONE)).cast("long")
    return Q.reversion_positions(d, HOURLY, at_hour=F.hour(B.local("ts", ZONE)), nights=nights, swap_bp=0.3)


def reversion_positions(spark: SparkSession, sf: str) -> DataFrame:
    d = reversion(spark, sf)
    return d.select("symbol", stamp("entry_time"), "side", r("score").alias("score"), r("gross_bp", 4).alias("gross_bp"), r("net_bp", 4).alias("net_bp"), "nights")


def reversion_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = Q.reversion_summary(reversion(spark, sf), KEY)
    return d.select("symbol", "trades", *[r(c, 5).alias(c) for c in ("win_rate", "gross_bp", "cost_bp", "net_bp", "long_share", "t", "sharpe")])


def rank_sql(x: str) -> str:
    return f"CASE WHEN count({x}) OVER t >= 40 AND {x} IS NOT NULL THEN len(list_filter(list({x}) OVER p, lambda v: v < {x})) / (count(*) OVER t - 1) END AS rank_{x}"


UNTIL = AT.replace("ts AT", "until AT")
REVERSION_SQL = RESEARCH_SQL + f""", q AS (SELECT *, {rank_sql("flow_proxy")}, {rank_sql("mom_1h")}, lead(ts, 24) OVER w AS until, lead(close, 24) OVER w AS out FROM feat
  WINDOW w AS (PARTITION BY symbol ORDER BY ts), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING), t AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
sc AS (SELECT *, (rank_flow_proxy + rank_mom_1h) / 2 AS score FROM q),
one AS (SELECT *, CASE WHEN score >= 0.8 THEN 1.0 WHEN score <= 0.2 THEN -1.0 END::DOUBLE AS side, row_number() OVER (PARTITION BY symbol, session ORDER BY ts) AS k FROM sc WHERE hour({AT}) = 11),
pos AS (SELECT symbol, ts, side, score, side * ln(out / close) * 1e4 AS gross, greatest(0, date_diff('day', CAST({AT} - INTERVAL 17 HOUR AS DATE), CAST({UNTIL} - INTERVAL 17 HOUR AS DATE)))::BIGINT AS nights
  FROM one WHERE k = 1 AND side IS NOT NULL AND out IS NOT NULL)"""


GEOMETRIES = {"k1": T.Barriers(1.0, 1.5, 8, 2.0), "k2": T.Barriers(2.0, 1.0, 8, 2.0), "k3": T.Barriers(1.0, 3.0, 12, 2.0)}


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """Walks of three geometries, as configurations."""
    out = None
    for name, cfg in GEOMETRIES.items():
        t = T.walk(signal_bars(spark, sf), DAILY, cfg).select(F.lit(name).alias("config"), "symbol", F.col("date").alias("entry_time"), "unit_net_R")
        out = t if out is None else out.unionByName(t)
    return staged(out, "configs")


FOLDS = C.make_folds(date(1995, 1, 1), date(2001, 8, 1), 18, 6)


def walkforward_select(spark: SparkSession, sf: str) -> DataFrame:
    t = configs(spark, sf)
    folds = C.folds_frame(spark, FOLDS)
    picks = Q.select_configs(t, folds)
    return picks.select("fold", "config", r("score").alias("score"))


def walkforward_summary(spark: SparkSession, sf: str) -> DataFrame:
    t, folds = configs(spark, sf), C.folds_frame(spark, FOLDS)
    picks = Q.select_configs(t, folds)
    d = Q.walk_forward_summary(Q.out_of_sample(t, folds, picks), picks)
    return d.select("trades", "distinct_configs", *[r(c).alias(c) for c in ("win_rate", "mean_net_R", "t", "selection_stability")])


#: The walks of all geometries: a symbol is repeated for each, with the geometry's name before its own.
CONFIG_SQL = (
    WALK_SQL.split(", s AS (SELECT *, coalesce(sign(lag(lr)")[0]
    + """, s AS (SELECT *, coalesce(sign(lag(lr) OVER (PARTITION BY symbol ORDER BY date)), 0) AS sig FROM b),
fl AS (SELECT *, coalesce(lag(sig) OVER (PARTITION BY symbol ORDER BY date), 0) AS ps FROM s),
geo AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{k}', {g.stop_k}::DOUBLE, {g.rr}::DOUBLE, {g.max_bars})" for k, g in GEOMETRIES.items())
    + """) g(config, k, rr, n)),
b3 AS (SELECT config || ':' || symbol AS symbol, bar, high, low, close FROM b, geo),
cand AS (SELECT config || ':' || symbol AS symbol, config, n, bar, date, sig AS side, close AS entry, close - sig * k * sigma * close AS stop, close + sig * k * sigma * close * rr AS target FROM fl, geo WHERE sig <> ps AND sig <> 0 AND sigma > 0)"""
    + OUTCOME_SQL.replace("FROM b GROUP", "FROM b3 GROUP").replace("JOIN b f", "JOIN b3 f").replace("{n}", "c.n")
    + """,
walk3 AS (SELECT cand.config, cand.date, t.side * (t.exit - t.entry) / abs(t.entry - t.stop) - 4.0 / 1e4 * t.entry / abs(t.entry - t.stop) AS x FROM trades t JOIN cand ON cand.symbol = t.symbol AND cand.bar = t.bar)"""
)
FOLD_VALUES = ", ".join(f"({f['fold']}, DATE '{f['train_start']}', DATE '{f['train_end']}', DATE '{f['test_start']}', DATE '{f['test_end']}')" for f in FOLDS)
SELECT_SQL = CONFIG_SQL + f""",
fold AS (SELECT * FROM (VALUES {FOLD_VALUES}) f(fold, a, b, c, d)),
scores AS (SELECT fold, config, avg(x) AS score FROM walk3 JOIN fold ON date >= a AND date < fold.b GROUP BY ALL HAVING count(*) >= 30),
picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, config) AS k FROM scores) WHERE k = 1)"""
FORWARD_SQL = SELECT_SQL + """,
oos AS (SELECT x FROM walk3 JOIN fold ON date >= c AND date < d JOIN picks ON picks.fold = fold.fold AND picks.config = walk3.config),
used AS (SELECT config, count(*) AS n FROM picks GROUP BY config)
SELECT count(*) AS trades, (SELECT count(*) FROM used) AS distinct_configs, round(avg((x > 0)::INT), 6) AS win_rate, round(avg(x), 6) AS "mean_net_R", round(avg(x) * sqrt(count(*)) / stddev_samp(x), 6) AS t,
  round((SELECT max(n) / sum(n) FROM used), 6) AS selection_stability FROM oos"""


def trade_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    t = walked(spark, sf).withColumns({"year": F.year("date").cast("string"), "direction": F.when(F.col("side") > 0, "long").otherwise("short")})
    d = Q.breakdown(t, ["symbol", "direction", "year"])
    return d.select("symbol", "direction", "year", "trades", r("win_rate").alias("win_rate"), r("mean").alias("mean"))


def in_sample_choice(spark: SparkSession, sf: str) -> DataFrame:
    t = configs(spark, sf).withColumn("in_sample", F.col("entry_time") < "1999-06-01")
    return Q.choose_in_sample(t, value="unit_net_R").select("config", "in_n", r("in_mean").alias("in_mean"), "out_n", r("out_mean").alias("out_mean"))


def fold_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).select("date").distinct()
    t = Q.slice_fold(d, C.folds_frame(spark, FOLDS), "test_start", "test_end", "date")
    return t.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"))


FOLDS_SQL = "folds AS (SELECT fold, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b FROM (VALUES " + ", ".join(f"({f['fold']}, '{f['test_start']}', '{f['test_end']}')" for f in FOLDS) + ") t(fold, a, b))"


def chosen_sql(name: str, source: str, start: str, free: str) -> str:
    """name: the rows of source that don't start while an earlier chosen one runs, by recursion over a symbol's rows."""
    return f""",
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {start}, {free}) AS k FROM {source}),
{name}_t AS (SELECT symbol, k, {free} AS until, true AS take FROM {name}_n WHERE k = 1
  UNION ALL SELECT n.symbol, n.k, CASE WHEN n.{start} >= t.until THEN n.{free} ELSE t.until END, n.{start} >= t.until FROM {name}_t t JOIN {name}_n n ON n.symbol = t.symbol AND n.k = t.k + 1),
{name} AS (SELECT n.* FROM {name}_n n JOIN {name}_t t ON t.symbol = n.symbol AND t.k = n.k WHERE take)"""


def level_entries(d: DataFrame) -> DataFrame:
    return d.select("symbol", "start", "bar", "side", r("entry").alias("entry"), r("stop").alias("stop"), r("level").alias("level"), "kind")


def inducement(spark: SparkSession, sf: str) -> DataFrame:
    return level_entries(N.inducement_entries(logs(spark, sf), DAILY))


def turtle_soup(spark: SparkSession, sf: str) -> DataFrame:
    return level_entries(N.turtle_soup_entries(logs(spark, sf), DAILY))


def reclaimed_sql(kind: str, first_bar: int, window: int = 3) -> str:
    """The entries of swept levels from `lv` (b with n, lo_level and hi_level)."""
    return (
        f""",
swept AS (SELECT symbol, bar AS start, 1.0::DOUBLE AS side, lo_level AS level FROM lv WHERE low < lo_level AND bar >= {first_bar} AND sigma > 0 AND bar < n - 1
  UNION ALL SELECT symbol, bar, -1.0, hi_level FROM lv WHERE high > hi_level AND bar >= {first_bar} AND sigma > 0 AND bar < n - 1),
back AS (SELECT w.symbol, w.start, w.side, w.level, min(f.bar) AS bar FROM swept w JOIN lv f ON f.symbol = w.symbol AND f.bar BETWEEN w.start AND w.start + {window} AND f.bar < f.n - 1
  WHERE CASE WHEN w.side > 0 THEN f.close > w.level ELSE f.close < w.level END GROUP BY ALL),
worst AS (SELECT k.symbol, k.start, k.side, k.level, k.bar, coalesce(min(f.low) FILTER (k.side > 0), max(f.high) FILTER (k.side < 0)) AS extreme FROM back k JOIN lv f ON f.symbol = k.symbol AND f.bar BETWEEN k.start AND k.bar GROUP BY ALL),
swept_in AS (SELECT w.*, f.close AS entry, f.close - w.side * greatest(abs(f.close - extreme), f.sigma * f.close) AS stop, 2 * start + (w.side < 0)::INT AS turn, 2 * w.bar + 1 + (w.side < 0)::INT AS free
  FROM worst w JOIN lv f ON f.symbol = w.symbol AND f.bar = w.bar)"""
        + chosen_sql("picked", "swept_in", "turn", "free")
        + f" SELECT symbol, start, bar, side, round(entry, 6) AS entry, round(stop, 6) AS stop, round(level, 6) AS level, '{kind}' AS kind FROM picked"
    )


INDUCEMENT_SQL = (
    "WITH RECURSIVE " + LOGS_SQL + """,
m AS (SELECT *, lag(low, 2) OVER o AS ml, lag(high, 2) OVER o AS mh, list(low) OVER w AS ll, list(high) OVER w AS hh FROM b
  WINDOW o AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN len(ll) = 5 AND ml = list_min(ll) AND len(list_filter(ll, lambda v: v = ml)) = 1 THEN ml END AS sl,
  CASE WHEN len(hh) = 5 AND mh = list_max(hh) AND len(list_filter(hh, lambda v: v = mh)) = 1 THEN mh END AS sh FROM m),
sw AS (SELECT *, last_value(sl IGNORE NULLS) OVER u AS swing_low, last_value(sh IGNORE NULLS) OVER u AS swing_high, count(*) OVER (PARTITION BY symbol) AS n
  FROM c WINDOW u AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT *, CASE WHEN swing_low > lo_prev THEN swing_low END AS lo_level, CASE WHEN swing_high < hi_prev THEN swing_high END AS hi_level FROM sw)"""
    + reclaimed_sql("inducement", 23)
)
TURTLE_SQL = (
    "WITH RECURSIVE " + LOGS_SQL + """,
ages AS (SELECT x.symbol, x.bar, min(f.bar) FILTER (f.low = x.lo_prev) AS lo_bar, min(f.bar) FILTER (f.high = x.hi_prev) AS hi_bar FROM b x JOIN b f ON f.symbol = x.symbol AND f.bar BETWEEN x.bar - 20 AND x.bar - 1 GROUP BY ALL),
lv AS (SELECT b.*, count(*) OVER (PARTITION BY b.symbol) AS n, CASE WHEN b.bar - lo_bar >= 4 THEN lo_prev END AS lo_level, CASE WHEN b.bar - hi_bar >= 4 THEN hi_prev END AS hi_level FROM b LEFT JOIN ages a ON a.symbol = b.symbol AND a.bar = b.bar)"""
    + reclaimed_sql("turtle_soup", 21)
)


def breakout_retrace(spark: SparkSession, sf: str) -> DataFrame:
    d = N.breakout_retrace(logs(spark, sf).withColumn("session", F.year("date")), DAILY, lookback=10, far=3.0)
    return d.select("symbol", "breakout_bar", "bar", "side", *[r(c).alias(c) for c in ("entry", "stop", "breakout_level", "impulse_frac", "retrace_frac")], "wait_bars", "stop_from")


def retrace_sql(session: str, lookback: int = 10, most: int = 12, near: float = 0.33, far: float = 3.0) -> str:
    """resumed (symbol, breakout_bar, bar, side, entry, structural, unit, ...) after PATTERN_SQL: the bars that arm, enter and end each breakout
    are found apart and then put in order."""
    return (
        f""",
bo AS (SELECT symbol, bar, {session} AS s, high, low, close, sigma, max(high) OVER p AS hp, min(low) OVER p AS lp FROM b
  WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)),
br AS (SELECT *, CASE WHEN close > hp THEN 1.0 ELSE -1.0 END::DOUBLE AS side, CASE WHEN close > hp THEN hp ELSE lp END AS level FROM bo WHERE bar > {lookback} AND sigma > 0 AND (close > hp OR close < lp)),
bx AS (SELECT *, abs(close - level) AS imp, CASE WHEN side > 0 THEN high ELSE -low END AS x, side * level + abs(close - level) * {1 - near!r}::DOUBLE AS near, side * level + abs(close - level) * {1 - far!r}::DOUBLE AS far FROM br),
steps_in AS (SELECT o.symbol, o.bar AS i, f.bar AS j, f.s <> o.s AS other, o.side * f.close > o.x AS beyond, CASE WHEN o.side > 0 THEN f.low ELSE -f.high END AS reach, o.near, o.far
  FROM bx o JOIN bo f ON f.symbol = o.symbol AND f.bar BETWEEN o.bar + 1 AND o.bar + {most}),
arms AS (SELECT symbol, i, min(j) FILTER (reach <= near) AS aj, min(j) FILTER (reach < far) AS dj, min(j) FILTER (other) AS oj FROM steps_in GROUP BY ALL),
goes AS (SELECT a.symbol, a.i, a.aj, a.dj, a.oj, min(t.j) AS bar FROM arms a JOIN steps_in t ON t.symbol = a.symbol AND t.i = a.i WHERE t.j > a.aj AND t.beyond GROUP BY ALL),
okay AS (SELECT * FROM goes WHERE (dj IS NULL OR (aj < dj AND bar <= dj)) AND (oj IS NULL OR bar < oj)),
deep AS (SELECT g.symbol, g.i, g.bar, min(t.reach) AS d FROM okay g JOIN steps_in t ON t.symbol = g.symbol AND t.i = g.i AND t.j < g.bar GROUP BY ALL),
made AS (SELECT o.symbol, o.bar AS breakout_bar, g.bar, o.side, f.close AS entry, o.level AS breakout_level, imp, o.close AS oc, x, least(x, d) AS dp, f.sigma * f.close AS unit, g.bar + 1 AS free
  FROM deep g JOIN bx o ON o.symbol = g.symbol AND o.bar = g.i JOIN bo f ON f.symbol = g.symbol AND f.bar = g.bar)"""
        + chosen_sql("resumed", "made", "breakout_bar", "free")
    )


RETRACE_SQL = (
    "WITH RECURSIVE " + LOGS_SQL + retrace_sql("year(date)")
    + """ SELECT symbol, breakout_bar, bar, side, round(entry, 6) AS entry, round(entry - side * greatest(abs(entry - side * dp), unit), 6) AS stop, round(breakout_level, 6) AS breakout_level, round(imp / oc, 6) AS impulse_frac,
  round(abs(x - dp) / imp, 6) AS retrace_frac, bar - breakout_bar AS wait_bars, CASE WHEN abs(entry - side * dp) >= unit THEN 'structure' ELSE 'sigma_floor' END AS stop_from FROM resumed"""
)


def hourly_bias(spark: SparkSession, sf: str) -> DataFrame:
    d = N.bias(sessions(spark, sf), HOURLY)
    return d.select("symbol", stamp(), "bias")


BIAS_SQL = HOURLY_SQL + f""", s AS (SELECT *, CAST({AT} + INTERVAL 7 HOUR AS DATE) AS session, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars),
v AS (SELECT symbol, ts, rn, sum((high + low + close) / 3 * volume) OVER d / sum(volume) OVER d AS vwap FROM s WINDOW d AS (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING)),
e AS (SELECT symbol, ts, vwap, {ewm_sql("vwap", 0.2, "symbol", "ts", "rn")} AS ema FROM v)
SELECT symbol, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS ts, coalesce(sign(round(ema - vwap, 9)), 0)::DOUBLE AS bias FROM e"""


def null_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Driftless bars as many and as volatile as each symbol's daily ones, a walk on each path, and the z against the touch chances:
    near 0 if the walk is fair."""
    own = Series(("symbol", "path"), ("ord",))
    b = G.null_paths_like(logs(spark, sf), DAILY).withColumnRenamed("bar", "ord")
    d = N.with_sigma(b, own).withColumn("signal", F.coalesce(F.signum(own.lag("lr")), F.lit(0.0)))
    return T.touch_benchmark(T.walk(d, own, T.Barriers(1.0, 1.0, 40, 0.0)), KEY)


QUERIES = {
    "sweeps": (sweeps, f"WITH {SWEEP_SQL} SELECT symbol, {D}, sweep, round(CASE WHEN sweep > 0 THEN lo_prev ELSE hi_prev END, 6) AS level, round(CASE WHEN sweep > 0 THEN lo_prev - low ELSE high - hi_prev END / (sigma * close), 6) AS pierce FROM sweep WHERE sweep <> 0"),
    "reversal_entries": (reversal_entries, f"{EXPLICIT_SQL} SELECT symbol, bar, side, round(entry, 6) AS entry, round(stop, 6) AS stop FROM cand"),
    "confirmed_swings": (swings, f"WITH {SWINGS_SQL}"),
    "fair_value_gaps": (fair_value_gaps, f"WITH {FVG_SQL} SELECT symbol, known_bar, side, round(lo, 6) AS lo, round(hi, 6) AS hi, formed_bar FROM fvg"),
    "order_blocks": (order_blocks, f"WITH {LOGS_SQL}{OB_SQL} SELECT symbol, known_bar, side, round(lo, 6) AS lo, round(hi, 6) AS hi, formed_bar FROM ob"),
    "zone_touch": (zone_touch, f"WITH {FVG_SQL}{OB_SQL}, zones AS (SELECT * FROM fvg UNION ALL SELECT * FROM ob), both_sides AS (SELECT b.*, s.side FROM b, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) s(side)) SELECT symbol, {D}, side FROM both_sides b WHERE EXISTS (SELECT 1 FROM zones z WHERE z.symbol = b.symbol AND z.side = b.side AND z.known_bar < b.bar AND z.known_bar >= b.bar - 24 AND b.low <= z.hi AND b.high >= z.lo)"),
    "barrier_walk": (barrier_walk, f"{WALK_SQL} SELECT symbol, {D}, side::DOUBLE AS side, round(entry, 6) AS entry, round(exit, 6) AS exit, outcome, held AS bars_held, ambiguous, round(cost_R, 6) AS \"cost_R\", round(net_R, 6) AS \"net_R\" FROM walk"),
    "barrier_summary": (barrier_summary, f"{WALK_SQL}, a AS (SELECT symbol, count(*) AS trades, avg((net_R > 0)::INT) AS w, avg((outcome = 'target')::INT) FILTER (outcome IN ('target', 'stop')) AS bw, avg(cost_R) AS c, avg((outcome = 'time')::INT) AS ts, avg((outcome = 'target')::INT) AS tg, avg((outcome = 'stop')::INT) AS st, avg(ambiguous::INT) AS am, avg(held) AS mb, avg(net_R) AS mr FROM walk GROUP BY symbol) SELECT symbol, trades, round(w, 6) AS win_rate, round(bw, 6) AS barrier_win_rate, round(c, 6) AS \"mean_cost_R\", round(ts, 6) AS time_share, round(tg, 6) AS target_share, round(st, 6) AS stop_share, round(am, 6) AS ambiguous_share, round(mb, 6) AS mean_bars, round(mr, 6) AS \"mean_net_R\", round((1 + c) / 2.5, 6) AS hurdle, round(bw - (1 + c) / 2.5, 6) AS gap FROM a"),
    "touch_benchmark": (touch_benchmark, f"{TOUCH_SQL} SELECT symbol, n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(z, 6) AS z FROM tz"),
    "pooled_z": (pooled_z, f"{TOUCH_SQL} SELECT round(sum(z * sqrt(n)) / sqrt(sum(n)), 6) AS z FROM tz"),
    "drop_one": (drop_one, f"{WALK_SQL}, c AS (SELECT symbol, count(*) AS n, sum(net_R) AS s FROM walk GROUP BY symbol) SELECT symbol AS dropped, CAST((SELECT sum(n) FROM c) - n AS BIGINT) AS trades, round(((SELECT sum(s) FROM c) - s) / ((SELECT sum(n) FROM c) - n), 6) AS \"mean_net_R\" FROM c"),
    "subset_ranking": (subset_ranking, f"{WALK_SQL}, c AS (SELECT symbol, count(*) AS n, sum(net_R) AS s, sum(cost_R) AS k FROM walk GROUP BY symbol) SELECT concat_ws(',', x.symbol, y.symbol, z.symbol) AS subset, x.n + y.n + z.n AS trades, round((x.s + y.s + z.s) / (x.n + y.n + z.n), 6) AS \"mean_net_R\", round((x.k + y.k + z.k) / (x.n + y.n + z.n), 6) AS \"mean_cost_R\" FROM c x JOIN c y ON x.symbol < y.symbol JOIN c z ON y.symbol < z.symbol"),
    "explicit_walk": (explicit_walk, f"{EXPLICIT_SQL} SELECT symbol, bar, side, round(exit, 6) AS exit, outcome, held AS bars_held, ambiguous, round(side * (exit - entry) / abs(entry - stop) - 2.0 / 1e4 * entry / abs(entry - stop), 6) AS \"net_R\" FROM trades"),
    "explicit_walk_breakeven": (explicit_walk_breakeven, BREAKEVEN_SQL),
    "mann_whitney": (mann_whitney, f"WITH {MW_SQL}"),
    "gap_stats": (gap_stats, f"WITH {GAP_SQL}, s AS (SELECT symbol, count(*) AS n, avg(trade) AS m, stddev_samp(trade) AS sd FROM trades WHERE trade <> 0 GROUP BY symbol HAVING count(*) >= 20) SELECT symbol, n, round(m, 6) AS mean, round(m * sqrt(n) / sd, 6) AS t, round(m * sqrt(252) / sd, 6) AS sharpe FROM s"),
    "realised_clustering": (clustering, f"WITH {LOGS_SQL}, q AS (SELECT symbol, lr * lr AS s, lag(lr * lr) OVER (PARTITION BY symbol ORDER BY date) AS l FROM b) SELECT symbol, round(corr(s, l), 6) AS clustering FROM q GROUP BY symbol"),
    "rank_ic_cells": (rank_ic, f"WITH {IC_SQL} SELECT symbol, feature, horizon, q AS quarter, n, round(ic, 6) AS ic, round(edge_bp, 6) AS edge_bp FROM ic"),
    "ic_summary": (ic_summary, f"WITH {ICS_SQL} SELECT feature, horizon, cells, round(m, 6) AS mean_ic, round(t, 6) AS t, round(CASE WHEN m > 0 THEN pos ELSE neg END, 6) AS hit, round(e, 6) AS edge_bp FROM s"),
    "holm_survivors": (holm_survivors, f"WITH {HOLM_SQL}".replace("1 / pow(1 + t * t, 4) AS p", f"{p_sql('s.t', 's.cells')} AS p")),
    "excess_by_symbol": (excess_by_symbol, EXCESS_SQL),
    "holm_given_p": (holm_given, f"WITH {HOLM_SQL}"),
    "event_study_cells": (event_study, f"WITH {EVENT_SQL} SELECT symbol, year, n, round(mean, 5) AS mean FROM cells"),
    "event_study_pooled": (event_pooled, f"WITH {EVENT_SQL} SELECT count(*) AS cells, round(avg(mean), 5) AS mean, round(avg(mean) * sqrt(count(*)) / stddev_samp(mean), 6) AS t, round(avg((mean > 0)::INT), 6) AS share_pos FROM cells"),
    "reversion_positions": (reversion_positions, f"WITH {REVERSION_SQL} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS entry_time, side, round(score, 6) AS score, round(gross, 4) AS gross_bp, round(gross - 2.0 - 0.3 * nights, 4) AS net_bp, nights FROM pos"),
    "reversion_summary": (reversion_summary, f"WITH {REVERSION_SQL}, n AS (SELECT *, 2.0 + 0.3 * nights AS cost, gross - 2.0 - 0.3 * nights AS net FROM pos) SELECT symbol, count(*) AS trades, round(avg((net > 0)::INT), 5) AS win_rate, round(avg(gross), 5) AS gross_bp, round(avg(cost), 5) AS cost_bp, round(avg(net), 5) AS net_bp, round(avg((side > 0)::INT), 5) AS long_share, round(avg(net) * sqrt(count(*)) / stddev_samp(net), 5) AS t, round(avg(net) * sqrt(252) / stddev_samp(net), 5) AS sharpe FROM n GROUP BY symbol"),
    "walkforward_select": (walkforward_select, f"{SELECT_SQL} SELECT fold, config, round(score, 6) AS score FROM picks"),
    "walkforward_summary": (walkforward_summary, FORWARD_SQL),
    "trade_breakdown": (trade_breakdown, f"{WALK_SQL}, x AS (SELECT symbol, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS direction, CAST(year(date) AS VARCHAR) AS year, net_R FROM walk) SELECT symbol, direction, year, count(*) AS trades, round(avg((net_R > 0)::INT), 6) AS win_rate, round(avg(net_R), 6) AS mean FROM x GROUP BY GROUPING SETS ((), (symbol), (direction), (year))"),
    "in_sample_choice": (in_sample_choice, f"{CONFIG_SQL}, a AS (SELECT config, count(*) FILTER (date < DATE '1999-06-01') AS in_n, avg(x) FILTER (date < DATE '1999-06-01') AS i, count(*) FILTER (date >= DATE '1999-06-01') AS out_n, avg(x) FILTER (date >= DATE '1999-06-01') AS o FROM walk3 GROUP BY config) SELECT config, in_n, round(i, 6) AS in_mean, out_n, round(o, 6) AS out_mean FROM a WHERE in_n >= 30 ORDER BY i DESC, config LIMIT 1"),
    "fold_slices": (fold_dates, f"WITH {DAILY_SQL}, {FOLDS_SQL} SELECT fold, count(DISTINCT date) AS n, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM daily JOIN folds ON date >= a AND date < b GROUP BY fold"),
    "inducement_entries": (inducement, INDUCEMENT_SQL),
    "turtle_soup_entries": (turtle_soup, TURTLE_SQL),
    "breakout_retrace_setups": (breakout_retrace, RETRACE_SQL),
    "hourly_bias": (hourly_bias, f"WITH {BIAS_SQL}"),
    "null_benchmark": (null_benchmark, None),
}
