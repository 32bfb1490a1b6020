"""Queries on bars, calendars, windows and exponentially weighted recursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import gap_trade, typical_price
from tessella.operators import bars as B
from tessella.operators import calendar as C
from tessella.operators import ewm as E
from tessella.operators import joins as J
from tessella.operators import rolling as R
from tessella.plans.base import DAILY, DAILY_SQL, HOURLY, HOURLY_SQL, RETURNS_SQL, TICKS_SQL, daily, hourly, returns, ticks

ZONE = "America/New_York"


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, and 0 for -0."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def day(x: str = "date") -> Column:
    return F.col(x).cast("string").alias(x)


def stamp(x: str = "ts") -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
OHLC = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close"


def ohlc(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("symbol", *more, *[r(c).alias(c) for c in B.OHLC], F.col("volume").cast("long").alias("volume"))


def tick_to_bar(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select("symbol", stamp(), *[r(c).alias(c) for c in B.OHLC], "volume", r("mean_spread").alias("mean_spread"))


def rebar_4h(spark: SparkSession, sf: str) -> DataFrame:
    return ohlc(B.rebar(hourly(spark, sf), B.every("ts", "4 hours")), stamp())


def session_daily(spark: SparkSession, sf: str) -> DataFrame:
    return ohlc(B.to_daily(hourly(spark, sf)), day())


def session_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = B.intraday_coverage(hourly(spark, sf))
    return c.select("symbol", "bars", "sessions", r("volume_positive").alias("volume_positive"), r("median_ticks").alias("median_ticks"), r("bars_per_session").alias("bars_per_session"))


def calendar_flags(spark: SparkSession, sf: str) -> DataFrame:
    dates = daily(spark, sf).select("date").distinct()
    return C.flags(dates).select(day(), "nfp", "opex", "month_end", "month_first", "quarter_end", "turn")


FLAGS_SQL = DAILY_SQL + """, dates AS (SELECT DISTINCT date FROM daily), f AS (
  SELECT date, isodow(date) = 5 AS fri, row_number() OVER (PARTITION BY date_trunc('month', date), isodow(date) = 5 ORDER BY date) AS k,
    max(date) OVER (PARTITION BY date_trunc('month', date)) AS last, min(date) OVER (PARTITION BY date_trunc('month', date)) AS first FROM dates),
flags AS (SELECT date, fri AND k = 1 AS nfp, fri AND k = 3 AS opex, date = last AS month_end, date = first AS month_first,
  date = last AND month(date) IN (3, 6, 9, 12) AS quarter_end, date = last OR date = first AS turn FROM f)"""


def flag_summary(spark: SparkSession, sf: str) -> DataFrame:
    dates = daily(spark, sf).select("date").distinct()
    return C.flag_summary(C.flags(dates), ["nfp", "opex", "turn"]).select("flag", "n_days", r("share").alias("share"))


def event_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    dates = d.select("date").distinct()
    events = d.filter("volume >= 3").select("date", F.when(F.col("close") > F.col("open"), "up").otherwise("down").alias("event"))
    return C.event_flags(dates, events, ["up", "down"]).select(day(), "up", "down")


def session_membership(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    out = t.withColumns({n: C.in_sessions("ts", [n]) for n in C.CENTRES}).withColumn("traded", C.in_sessions("ts", ["london", "newyork"]))
    return out.groupBy("symbol").agg(*[F.count_if(n).alias(n) for n in (*C.CENTRES, "traded")])


def local_sql(zone: str) -> str:
    return f"((ts AT TIME ZONE 'UTC') AT TIME ZONE '{zone}')"


def inside_sql(name: str) -> str:
    zone, low, high = C.CENTRES[name]
    at = local_sql(zone)
    return f"(isodow({at}) < 6 AND hour({at}) + minute({at}) / 60.0 >= {low} AND hour({at}) + minute({at}) / 60.0 < {high})"


MEMBER_SQL = f"""WITH {TICKS_SQL} SELECT symbol, {", ".join(f"CAST(sum(CAST({inside_sql(n)} AS INT)) AS BIGINT) AS {n}" for n in C.CENTRES)},
  CAST(sum(CAST({inside_sql("london")} OR {inside_sql("newyork")} AS INT)) AS BIGINT) AS traded FROM ticks GROUP BY symbol"""


def blackout_mask(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).withColumns({"quiet": C.blackout("ts"), "index_open": C.blackout("ts", index_open=True)})
    return t.groupBy("symbol").agg(F.count_if("quiet").alias("quiet"), F.count_if("index_open").alias("index_open"))


MINUTE = f"(hour({local_sql(ZONE)}) * 60 + minute({local_sql(ZONE)}))"
BLACKOUT_SQL = f"""WITH {TICKS_SQL} SELECT symbol, CAST(sum(CAST({MINUTE} >= 1005 AND {MINUTE} < 1080 AS INT)) AS BIGINT) AS quiet,
  CAST(sum(CAST(({MINUTE} >= 1005 AND {MINUTE} < 1080) OR ({MINUTE} >= 500 AND {MINUTE} <= 530) AS INT)) AS BIGINT) AS index_open FROM ticks GROUP BY symbol"""


def bar_sanity(spark: SparkSession, sf: str) -> DataFrame:
    return B.sanity(daily(spark, sf))


def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    return B.coverage(daily(spark, sf)).select("symbol", day("first_date"), day("last_date"), "n_rows", "binding")


#: The instruments of `daily`, and their columns in a wide panel.
PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


def price_panel(spark: SparkSession, sf: str) -> DataFrame:
    p = B.panel(daily(spark, sf), list(PRIORITIES))
    return p.select(day(), *[F.col(f"`{s}`").alias(a) for s, a in PRIORITIES.items()])


def aligned_log_returns(spark: SparkSession, sf: str) -> DataFrame:
    return B.aligned_returns(daily(spark, sf), len(PRIORITIES)).select(day(), "symbol", r("ret", 8).alias("ret"))


def monthly_returns(spark: SparkSession, sf: str) -> DataFrame:
    return B.monthly_returns(daily(spark, sf)).select("symbol", day("month"), r("close").alias("close"), r("ret", 8).alias("ret"))


def clean_bars(spark: SparkSession, sf: str) -> DataFrame:
    return ohlc(B.clean_intraday(hourly(spark, sf), HOURLY, jump=2.0), stamp())


def typical(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf).select("symbol", day(), r(typical_price(F.col("high"), F.col("low"), F.col("close"))).alias("typical"))


def rolling_vwap(spark: SparkSession, sf: str) -> DataFrame:
    return R.rolling_vwap(daily(spark, sf), DAILY).select("symbol", day(), r(F.ln("vwap"), 8).alias("log_vwap"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).withColumn("session", B.session_end_date("ts"))


SESSION_SQL = HOURLY_SQL + f", s AS (SELECT *, CAST({local_sql(ZONE)} + INTERVAL 7 HOUR AS DATE) AS session FROM bars)"


def session_vwap(spark: SparkSession, sf: str) -> DataFrame:
    return R.session_vwap(sessions(spark, sf), HOURLY).select("symbol", stamp(), day("session"), r("vwap").alias("vwap"))


def rolling_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return R.rolling_sharpe(returns(spark, sf), DAILY, "ret").select("symbol", day(), r("sharpe").alias("sharpe"))


def rolling_hist_var(spark: SparkSession, sf: str) -> DataFrame:
    return R.rolling_historical_var(returns(spark, sf), DAILY, "ret", 0.99, 250).filter("var IS NOT NULL").select("symbol", day(), r("var", 8).alias("var"))


def rolling_normal_var(spark: SparkSession, sf: str) -> DataFrame:
    return R.rolling_normal_var(returns(spark, sf), DAILY, "ret", -2.3263478740408408, 500).filter("var IS NOT NULL").select("symbol", day(), r("var", 8).alias("var"))


def quant_metrics(spark: SparkSession, sf: str) -> DataFrame:
    q = R.quant_metrics(returns(spark, sf), DAILY, "ret", 126, rf=0.02)
    return q.filter("sharpe IS NOT NULL").select("symbol", day(), r("sharpe").alias("sharpe"), r("var_95", 8).alias("var_95"))


def prior_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return R.prior_extremes(daily(spark, sf), DAILY).select("symbol", day(), r("hi_prev").alias("hi_prev"), r("lo_prev").alias("lo_prev"))


def trailing_rank(spark: SparkSession, sf: str) -> DataFrame:
    return R.trailing_rank(returns(spark, sf), DAILY, "ret", 100, 50).select("symbol", day(), r("rank").alias("rank"))


def expanding_median(spark: SparkSession, sf: str) -> DataFrame:
    return R.expanding_median(hourly(spark, sf), HOURLY, "close", 50).select("symbol", stamp(), r("median").alias("median"))


def recent_nonzero(spark: SparkSession, sf: str) -> DataFrame:
    d = returns(spark, sf).withColumn("hit", F.when(F.col("ret") > 0.015, 1.0).when(F.col("ret") < -0.015, -1.0).otherwise(0.0))
    return R.recent_nonzero(d, DAILY, "hit").select("symbol", day(), "hit", "recent")


def vwap_frame(spark: SparkSession, sf: str) -> DataFrame:
    return E.gap_signal(E.vwap_ema(R.rolling_vwap(daily(spark, sf), DAILY), DAILY), DAILY)


def vwap_ema_signal(spark: SparkSession, sf: str) -> DataFrame:
    return vwap_frame(spark, sf).select("symbol", day(), r(F.ln("ema"), 8).alias("log_ema"), r("deviation").alias("deviation"), r("ema_gap").alias("ema_gap"), "signal")


def ewm_sql(x: str, alpha: float, keys: str, order: str, row: str) -> str:
    """The recursion in closed form: exact while (1 - alpha) ** rows stays a number."""
    d = 1 - alpha
    return f"pow({d!r}, {row}) * sum(CASE WHEN {row} = 1 THEN {x} ELSE {alpha!r} * {x} END / pow({d!r}, {row})) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"


FRAME = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
VWAP_SQL = DAILY_SQL + f""", v AS (SELECT *, CASE WHEN count(*) {FRAME} >= 20 THEN sum((high + low + close) / 3 * volume) {FRAME} / sum(volume) {FRAME} END AS vwap FROM daily),
nn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM v WHERE vwap IS NOT NULL),
e AS (SELECT symbol, date, {ewm_sql("vwap", 2 / 21, "symbol", "date", "rn")} AS ema FROM nn),
frame AS (SELECT v.*, e.ema, close / vwap - 1 AS deviation, e.ema / vwap - 1 AS ema_gap FROM v LEFT JOIN e USING (symbol, date)),
sig AS (SELECT *, coalesce(lag(coalesce(sign(round(ema_gap, 12)), 0)) OVER (PARTITION BY symbol ORDER BY date), 0)::DOUBLE AS signal FROM frame)"""


def vwap_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = R.vwap_summary(vwap_frame(spark, sf))
    return s.select("symbol", "n_obs", *[r(c).alias(c) for c in ("share_above", "mean_abs_deviation", "min_deviation", "max_deviation")])


def ewma_sigma(spark: SparkSession, sf: str) -> DataFrame:
    return E.ewma_sigma(returns(spark, sf), DAILY, "ret").select("symbol", day(), r("sigma", 8).alias("sigma"))


SIGMA_SQL = RETURNS_SQL + f""", sq AS (SELECT symbol, date, sqrt({ewm_sql("ret * ret", 1 - 0.94, "symbol", "date", "(rn - 1)")}) AS s FROM rets WHERE ret IS NOT NULL),
sg AS (SELECT rets.*, lag(s) OVER (PARTITION BY symbol ORDER BY date) AS sigma FROM rets LEFT JOIN sq USING (symbol, date))"""


def ewma_variance(spark: SparkSession, sf: str) -> DataFrame:
    d = returns(spark, sf).filter("ret IS NOT NULL")
    return E.ewma_variance(d, DAILY, "ret").filter("variance IS NOT NULL").select("symbol", day(), r("variance", 10).alias("variance"))


VARIANCE_SQL = RETURNS_SQL + """, x AS (SELECT symbol, date, ret, rn - 1 AS i FROM rets WHERE ret IS NOT NULL),
seed AS (SELECT symbol, var_samp(ret) AS s FROM x WHERE i <= 30 GROUP BY symbol),
p AS (SELECT x.*, s, lag(ret) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM x JOIN seed USING (symbol)),
y AS (SELECT symbol, date, i, pow(0.94, i - 31) * sum(CASE WHEN i < 31 THEN 0 WHEN i = 31 THEN s ELSE (1 - 0.94) * prev * prev END / pow(0.94, i - 31)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS variance FROM p)
SELECT symbol, CAST(date AS VARCHAR) AS date, round(variance, 10) AS variance FROM y WHERE i > 30"""


def atr(spark: SparkSession, sf: str) -> DataFrame:
    return E.atr(hourly(spark, sf), HOURLY).select("symbol", stamp(), r("atr").alias("atr"))


ATR_SQL = HOURLY_SQL + f""", t AS (SELECT *, row_number() OVER w AS rn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
a AS (SELECT symbol, ts, rn, {ewm_sql("tr", 1 / 14, "symbol", "ts", "rn")} AS a FROM t)
SELECT symbol, {TS}, round(lag(CASE WHEN rn >= 14 THEN a END) OVER (PARTITION BY symbol ORDER BY a.ts), 6) AS atr FROM a"""


def spreads(spark: SparkSession, sf: str) -> DataFrame:
    return R.smoothed_spread(R.corwin_schultz(sessions(spark, sf), HOURLY), HOURLY)


def corwin_schultz(spark: SparkSession, sf: str) -> DataFrame:
    return spreads(spark, sf).select("symbol", stamp(), r("spread", 8).alias("spread"), r("smoothed", 8).alias("smoothed"))


W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
SPREAD_SQL = SESSION_SQL + f""", c AS (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(session) OVER w AS ps FROM s {W}),
g AS (SELECT *, pow(ln(high / low), 2) + pow(ln(ph / pl), 2) AS beta, pow(ln(greatest(high, ph) / least(low, pl)), 2) AS gamma FROM c),
a AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / {R.K!r} - sqrt(gamma / {R.K!r}) AS alpha FROM g),
cs AS (SELECT *, CASE WHEN ps = session THEN greatest(0, 2 * (exp(alpha) - 1) / (1 + exp(alpha))) END AS spread FROM a),
sm AS (SELECT *, CASE WHEN count(spread) OVER q >= 4 THEN median(spread) OVER q END AS smoothed FROM cs WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"""


def wide_spread(spark: SparkSession, sf: str) -> DataFrame:
    return R.wide_spread(spreads(spark, sf).withColumn("smoothed", F.round("smoothed", 8)), HOURLY, 3.0, 300, 100).select("symbol", stamp(), "wide")


def activity_cost(spark: SparkSession, sf: str) -> DataFrame:
    d = R.activity_cost(R.activity(hourly(spark, sf), HOURLY), HOURLY)
    return d.select("symbol", stamp(), r("activity").alias("activity"), r("cost_bp").alias("cost_bp"))


ACTIVITY_SQL = HOURLY_SQL + f""", m AS (SELECT symbol, median(volume) AS med FROM bars GROUP BY symbol),
a AS (SELECT b.symbol, ts, CASE WHEN count(*) OVER q >= 4 THEN median(volume) OVER q END / med AS activity FROM bars b JOIN m ON b.symbol = m.symbol
  WINDOW q AS (PARTITION BY b.symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN activity IS NOT NULL THEN greatest(0.1, least(10.0, pow(1 / greatest(activity, 1e-9), 0.5))) END AS mult FROM a),
y AS (SELECT symbol, median(mult) AS mm FROM x GROUP BY symbol)
SELECT x.symbol, {TS}, round(activity, 6) AS activity, round(coalesce(least(mult / mm, 10.0), 1.0), 6) AS cost_bp FROM x JOIN y ON x.symbol = y.symbol"""


def observed_spread(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    bid, ask = t.select("symbol", "ts", F.col("bid").alias("close")), t.select("symbol", "ts", F.col("ask").alias("close"))
    s = J.observed_spread(bid, ask, ("symbol",))
    d = J.real_cost_bp(hourly(spark, sf), s, HOURLY, B.every("ts", "1 hour"), 0.2)
    return d.select("symbol", stamp(), r("cost_bp").alias("cost_bp"))


OBSERVED_SQL = HOURLY_SQL + f""", q AS (SELECT symbol, date_trunc('hour', ts) AS ts, median(greatest(0, (ask - bid) / ((ask + bid) / 2)) * 1e4 / 2) AS m FROM ticks GROUP BY ALL)
SELECT symbol, {TS}, round(m + 0.2, 6) AS cost_bp FROM bars JOIN q USING (symbol, ts)"""


def asof_higher_frame(spark: SparkSession, sf: str) -> DataFrame:
    low = hourly(spark, sf).select("symbol", "ts", "close")
    high = B.rebar(hourly(spark, sf), B.every("ts", "6 hours")).select("symbol", "ts", F.col("close").alias("higher_close"))
    return J.align_to(low, high, HOURLY, ["higher_close"]).select("symbol", stamp(), r("close").alias("close"), r("higher_close").alias("higher_close"))


ASOF_SQL = HOURLY_SQL + f""", h AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS hts, arg_max(close, ts) AS higher_close FROM bars GROUP BY ALL),
hs AS (SELECT symbol, hts + INTERVAL 6 HOUR AS hts, higher_close FROM h)
SELECT bars.symbol, strftime(bars.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(close, 6) AS close, round(higher_close, 6) AS higher_close FROM bars ASOF LEFT JOIN hs ON bars.symbol = hs.symbol AND bars.ts >= hs.hts"""


def forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    d = R.forward_returns(hourly(spark, sf), HOURLY)
    return d.select("symbol", stamp(), *[r(f"fwd_{h}", 8).alias(f"fwd_{h}") for h in (1, 4, 24)])


def features(spark: SparkSession, sf: str) -> DataFrame:
    at = B.local("ts", ZONE)
    return R.research_features(sessions(spark, sf), HOURLY, F.hour(at), at)


def session_features(spark: SparkSession, sf: str) -> DataFrame:
    d = features(spark, sf)
    return d.select("symbol", stamp(), *[r(c).alias(c) for c in ("vwap", "poc", "ldn_drive", "ny_drive", "flow_proxy")])


AT = local_sql(ZONE)
FEATURES_SQL = SESSION_SQL + f""", l AS (SELECT *, ln(close / lag(close) OVER w) AS lr FROM s {W}),
poc AS (SELECT symbol, session, lag(p) OVER (PARTITION BY symbol ORDER BY session) AS poc FROM (SELECT symbol, session, arg_max(close, (volume, -epoch_us(ts))) AS p FROM s GROUP BY ALL)),
m AS (SELECT symbol, ts, CASE WHEN count(*) OVER q >= 60 THEN median(volume) OVER q END AS med FROM s WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))
SELECT l.symbol, strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(sum((high + low + close) / 3 * volume) OVER d / sum(volume) OVER d, 6) AS vwap, round(poc, 6) AS poc,
  round(last_value(CASE WHEN hour({AT.replace("ts AT", "l.ts AT")}) = 3 AND minute(l.ts) = 0 THEN lr END IGNORE NULLS) OVER d, 6) AS ldn_drive,
  round(last_value(CASE WHEN hour({AT.replace("ts AT", "l.ts AT")}) = 9 AND minute(l.ts) = 0 THEN lr END IGNORE NULLS) OVER d, 6) AS ny_drive,
  round(sign(lr) * volume / med, 6) AS flow_proxy
FROM l JOIN poc ON l.symbol = poc.symbol AND l.session = poc.session JOIN m ON l.symbol = m.symbol AND l.ts = m.ts
WINDOW d AS (PARTITION BY l.symbol, l.session ORDER BY l.ts ROWS UNBOUNDED PRECEDING)"""


def research_features(spark: SparkSession, sf: str) -> DataFrame:
    d = features(spark, sf)
    return d.select("symbol", stamp(), *[r(c).alias(c) for c in ("mom_1h", "mom_4h", "mom_24h", "vwap_rev", "poc_rev")])


FEAT_SUM = "CASE WHEN count(lr) OVER t{0} >= {0} THEN sum(lr) OVER t{0} END"
RESEARCH_SQL = SESSION_SQL + f""", l AS (SELECT *, ln(close / lag(close) OVER w) AS lr, row_number() OVER w - 1 AS rn FROM s {W}),
sg AS (SELECT symbol, ts, sqrt({ewm_sql("lr * lr", 0.03, "symbol", "ts", "rn")}) AS sigma FROM l WHERE lr IS NOT NULL),
poc AS (SELECT symbol, session, lag(p) OVER (PARTITION BY symbol ORDER BY session) AS poc FROM (SELECT symbol, session, arg_max(close, (volume, -epoch_us(ts))) AS p FROM s GROUP BY ALL)),
z AS (SELECT *, sum((high + low + close) / 3 * volume) OVER d / sum(volume) OVER d AS vwap, {FEAT_SUM.format(4)} AS m4, {FEAT_SUM.format(24)} AS m24, CASE WHEN count(*) OVER q >= 60 THEN median(volume) OVER q END AS med FROM l
  WINDOW d AS (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING), t4 AS (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING), t24 AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING), q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
feat AS (SELECT z.*, lr / nullif(sigma, 0) AS mom_1h, m4 / nullif(sigma, 0) AS mom_4h, m24 / nullif(sigma, 0) AS mom_24h, (close / vwap - 1) / nullif(sigma, 0) AS vwap_rev, (close / poc.poc - 1) / nullif(sigma, 0) AS poc_rev, sign(lr) * volume / med AS flow_proxy
  FROM z JOIN poc ON z.symbol = poc.symbol AND z.session = poc.session LEFT JOIN sg ON z.symbol = sg.symbol AND z.ts = sg.ts)"""


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    d = C.gap_frame(daily(spark, sf), DAILY)
    return d.withColumn("trade", gap_trade(F.col("gap"), F.col("intraday"), 0.1, 2.0))


def gap_trades(spark: SparkSession, sf: str) -> DataFrame:
    return gaps(spark, sf).select("symbol", day(), r("gap").alias("gap"), r("intraday").alias("intraday"), r("trade").alias("trade"))


GAP_SQL = DAILY_SQL + """, g AS (SELECT symbol, date, open / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS gap, close / open - 1 AS intraday FROM daily),
gt AS (SELECT *, CASE WHEN abs(gap) > 0.1 THEN sign(gap) ELSE 0 END AS side FROM g),
trades AS (SELECT *, side * intraday - 2 * 2.0 / 1e4 * abs(side) AS trade FROM gt)"""


def in_sample_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_at(daily(spark, sf), DAILY).groupBy("symbol", "in_sample").agg(F.count(F.lit(1)).alias("n"), F.max("date").cast("string").alias("last_date"))


def nights(spark: SparkSession, sf: str) -> DataFrame:
    d = hourly(spark, sf).withColumn("until", HOURLY.lead("ts", 24)).filter("until IS NOT NULL")
    return d.select("symbol", stamp(), C.nights_between("ts", "until").cast("long").alias("nights"))


def gates(spark: SparkSession, sf: str) -> DataFrame:
    d = E.ewma_sigma(returns(spark, sf), DAILY, "ret")
    d = R.rolling_historical_var(d, DAILY, "ret", 0.95, 100)
    g = R.quantile_gates(d, DAILY, "sigma", "var", 400)
    return g.groupBy("symbol").agg(F.count_if("g_regime").alias("regime"), F.count_if("g_var").alias("calm"), F.count_if(F.col("g_regime") & F.col("g_var")).alias("both"))


GATES_SQL = SIGMA_SQL + """, v AS (SELECT *, CASE WHEN count(ret) OVER p >= 100 THEN -quantile_cont(ret, 0.05) OVER p END AS var FROM sg WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN count(sigma) OVER t >= 100 THEN quantile_cont(sigma, 0.2) OVER t END AS lo, CASE WHEN count(sigma) OVER t >= 100 THEN quantile_cont(sigma, 0.8) OVER t END AS hi,
  CASE WHEN count(var) OVER t >= 100 THEN quantile_cont(var, 0.9) OVER t END AS cap FROM v WINDOW t AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 399 PRECEDING AND CURRENT ROW)),
b AS (SELECT symbol, coalesce(sigma >= lo AND sigma <= hi, false) AS r, coalesce(var <= cap, false) AS c FROM g)
SELECT symbol, CAST(sum(r::INT) AS BIGINT) AS regime, CAST(sum(c::INT) AS BIGINT) AS calm, CAST(sum((r AND c)::INT) AS BIGINT) AS both FROM b GROUP BY symbol"""




D = "CAST(date AS VARCHAR) AS date"
PREV20 = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
T126 = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"

QUERIES = {
    "tick_to_bar": (tick_to_bar, f"WITH {HOURLY_SQL} SELECT symbol, {TS}, {OHLC}, volume, round(mean_spread, 6) AS mean_spread FROM bars"),
    "rebar_4h": (rebar_4h, f"WITH {HOURLY_SQL}, b AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2024-01-01') AS t, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ALL) SELECT symbol, strftime(t, '%Y-%m-%d %H:%M:%S') AS ts, {OHLC}, volume FROM b"),
    "session_daily": (session_daily, f"WITH {HOURLY_SQL}, b AS (SELECT symbol, CAST({AT} - INTERVAL 17 HOUR AS DATE) AS date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ALL) SELECT symbol, {D}, {OHLC}, volume FROM b"),
    "session_coverage": (session_coverage, f"WITH {SESSION_SQL} SELECT symbol, count(*) AS bars, count(DISTINCT session) AS sessions, round(avg((volume > 0)::INT), 6) AS volume_positive, round(median(volume), 6) AS median_ticks, round(count(*) / count(DISTINCT session), 6) AS bars_per_session FROM s GROUP BY symbol"),
    "calendar_flags": (calendar_flags, f"WITH {FLAGS_SQL} SELECT {D}, nfp, opex, month_end, month_first, quarter_end, turn FROM flags"),
    "flag_summary": (flag_summary, "WITH " + FLAGS_SQL + " " + " UNION ALL ".join(f"SELECT '{f}' AS flag, CAST(sum({f}::INT) AS BIGINT) AS n_days, round(avg({f}::INT), 6) AS share FROM flags" for f in ("nfp", "opex", "turn"))),
    "event_flags": (event_flags, f"WITH {DAILY_SQL} SELECT {D}, bool_or(volume >= 3 AND close > open) AS up, bool_or(volume >= 3 AND NOT close > open) AS down FROM daily GROUP BY date"),
    "session_membership": (session_membership, MEMBER_SQL),
    "blackout_mask": (blackout_mask, BLACKOUT_SQL),
    "bar_sanity": (bar_sanity, f"WITH {DAILY_SQL} SELECT symbol, count(*) AS n_rows, " + ", ".join(f"CAST(sum(({rule})::INT) AS BIGINT) AS {name}" for name, rule in B.SANITY.items()) + " FROM daily GROUP BY symbol"),
    "coverage_report": (coverage_report, f"WITH {DAILY_SQL}, c AS (SELECT symbol, min(date) AS f, max(date) AS l, count(*) AS n FROM daily GROUP BY symbol) SELECT symbol, CAST(f AS VARCHAR) AS first_date, CAST(l AS VARCHAR) AS last_date, n AS n_rows, row_number() OVER (ORDER BY f DESC, symbol DESC) = 1 AS binding FROM c"),
    "price_panel": (price_panel, f"WITH {DAILY_SQL} SELECT {D}, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {a}" for s, a in PRIORITIES.items()) + " FROM daily GROUP BY date"),
    "aligned_log_returns": (aligned_log_returns, f"WITH {DAILY_SQL}, d AS (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM daily), x AS (SELECT a.date, a.symbol, ln(a.close / b.close) AS ret FROM d a JOIN d b ON a.symbol = b.symbol AND a.k = b.k + 1) SELECT {D}, symbol, round(ret, 8) AS ret FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM x) WHERE n = 5"),
    "monthly_returns": (monthly_returns, f"WITH {DAILY_SQL}, m AS (SELECT symbol, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close FROM daily GROUP BY ALL) SELECT symbol, CAST(month AS VARCHAR) AS month, round(close, 6) AS close, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1, 8) AS ret FROM m"),
    "clean_bars": (clean_bars, f"WITH {HOURLY_SQL}, j AS (SELECT *, abs(close / lag(close) OVER w - 1) AS jump FROM bars WHERE volume > 0 {W}) SELECT symbol, {TS}, {OHLC}, volume FROM j WHERE jump IS NULL OR jump <= 2.0"),
    "typical_price": (typical, f"WITH {DAILY_SQL} SELECT symbol, {D}, round((high + low + close) / 3, 6) AS typical FROM daily"),
    "rolling_vwap": (rolling_vwap, f"WITH {VWAP_SQL} SELECT symbol, {D}, round(ln(vwap), 8) AS log_vwap FROM v"),
    "session_vwap": (session_vwap, f"WITH {SESSION_SQL} SELECT symbol, {TS}, CAST(session AS VARCHAR) AS session, round(sum((high + low + close) / 3 * volume) OVER d / sum(volume) OVER d, 6) AS vwap FROM s WINDOW d AS (PARTITION BY symbol, session ORDER BY s.ts ROWS UNBOUNDED PRECEDING)"),
    "rolling_sharpe": (rolling_sharpe, f"WITH {RETURNS_SQL} SELECT symbol, {D}, round(CASE WHEN count(ret) {T126} >= 126 THEN avg(ret) {T126} / stddev_samp(ret) {T126} * sqrt(252) END, 6) AS sharpe FROM rets"),
    "rolling_hist_var": (rolling_hist_var, f"WITH {RETURNS_SQL}, q AS (SELECT symbol, date, count(ret) OVER p AS n, -quantile_cont(ret, 0.01) OVER p AS v FROM rets WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)) SELECT symbol, {D}, round(v, 8) AS var FROM q WHERE n >= 250"),
    "rolling_normal_var": (rolling_normal_var, f"WITH {RETURNS_SQL}, q AS (SELECT symbol, date, count(ret) OVER p AS n, -(avg(ret) OVER p - 2.3263478740408408 * stddev_samp(ret) OVER p) AS v FROM rets WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)) SELECT symbol, {D}, round(v, 8) AS var FROM q WHERE n >= 500"),
    "quant_metrics": (quant_metrics, f"WITH {RETURNS_SQL}, q AS (SELECT symbol, date, count(ret) {T126} AS n, (avg(ret) {T126} - 0.02 / 252) / stddev_samp(ret) {T126} * sqrt(252) AS s, -quantile_cont(ret, 0.05) {T126} AS v FROM rets) SELECT symbol, {D}, round(s, 6) AS sharpe, round(v, 8) AS var_95 FROM q WHERE n >= 126"),
    "prior_extremes": (prior_extremes, f"WITH {DAILY_SQL} SELECT symbol, {D}, round(CASE WHEN count(*) {PREV20} >= 20 THEN max(high) {PREV20} END, 6) AS hi_prev, round(CASE WHEN count(*) {PREV20} >= 20 THEN min(low) {PREV20} END, 6) AS lo_prev FROM daily"),
    "trailing_rank": (trailing_rank, f"WITH {RETURNS_SQL}, q AS (SELECT symbol, date, ret, list(ret) OVER p AS l, count(*) OVER t AS n, count(ret) OVER t AS c FROM rets WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING), t AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT symbol, {D}, round(CASE WHEN c >= 50 AND ret IS NOT NULL THEN len(list_filter(l, lambda x: x < ret)) / (n - 1) END, 6) AS rank FROM q"),
    "expanding_median": (expanding_median, f"WITH {HOURLY_SQL}, q AS (SELECT symbol, ts, count(*) OVER w AS n, median(close) OVER w AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) SELECT symbol, {TS}, round(CASE WHEN n >= 50 THEN m END, 6) AS median FROM q"),
    "recent_nonzero": (recent_nonzero, f"WITH {RETURNS_SQL}, h AS (SELECT symbol, date, CASE WHEN ret > 0.015 THEN 1.0 WHEN ret < -0.015 THEN -1.0 ELSE 0.0 END::DOUBLE AS hit FROM rets) SELECT symbol, {D}, hit, coalesce(last_value(nullif(hit, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY h.date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0.0)::DOUBLE AS recent FROM h"),
    "vwap_ema_signal": (vwap_ema_signal, f"WITH {VWAP_SQL} SELECT symbol, {D}, round(ln(ema), 8) AS log_ema, round(deviation, 6) AS deviation, round(ema_gap, 6) AS ema_gap, signal FROM sig"),
    "vwap_summary": (vwap_summary, f"WITH {VWAP_SQL} SELECT symbol, count(*) AS n_obs, round(avg((deviation > 0)::INT), 6) AS share_above, round(avg(abs(deviation)), 6) AS mean_abs_deviation, round(min(deviation), 6) AS min_deviation, round(max(deviation), 6) AS max_deviation FROM sig WHERE deviation IS NOT NULL GROUP BY symbol"),
    "ewma_sigma": (ewma_sigma, f"WITH {SIGMA_SQL} SELECT symbol, {D}, round(sigma, 8) AS sigma FROM sg"),
    "ewma_variance": (ewma_variance, f"WITH {VARIANCE_SQL}"),
    "atr_wilder": (atr, f"WITH {ATR_SQL}"),
    "corwin_schultz": (corwin_schultz, f"WITH {SPREAD_SQL} SELECT symbol, {TS}, round(spread, 8) AS spread, round(smoothed, 8) AS smoothed FROM sm"),
    "wide_spread": (wide_spread, f"WITH {SPREAD_SQL}, sr AS (SELECT symbol, ts, round(smoothed, 8) AS smoothed FROM sm) SELECT symbol, {TS}, coalesce(smoothed > 3 * CASE WHEN count(smoothed) OVER t >= 100 THEN median(smoothed) OVER t END, false) AS wide FROM sr WINDOW t AS (PARTITION BY symbol ORDER BY sr.ts ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)"),
    "activity_cost": (activity_cost, f"WITH {ACTIVITY_SQL}"),
    "observed_spread_cost": (observed_spread, f"WITH {OBSERVED_SQL}"),
    "asof_higher_frame": (asof_higher_frame, f"WITH {ASOF_SQL}"),
    "forward_returns": (forward_returns, f"WITH {HOURLY_SQL} SELECT symbol, strftime(bars.ts, '%Y-%m-%d %H:%M:%S') AS ts, " + ", ".join(f"round(ln(lead(close, {h}) OVER w / close), 8) AS fwd_{h}" for h in (1, 4, 24)) + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bars.ts)"),
    "session_features": (session_features, f"WITH {FEATURES_SQL}"),
    "research_features": (research_features, f"WITH {RESEARCH_SQL} SELECT symbol, {TS}, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mom_1h", "mom_4h", "mom_24h", "vwap_rev", "poc_rev")) + " FROM feat"),
    "gap_trade": (gap_trades, f"WITH {GAP_SQL} SELECT symbol, {D}, round(gap, 6) AS gap, round(intraday, 6) AS intraday, round(trade, 6) AS trade FROM trades"),
    "in_sample_split": (in_sample_split, f"WITH {DAILY_SQL}, x AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) <= floor(count(*) OVER (PARTITION BY symbol) * 0.67) AS in_sample FROM daily) SELECT symbol, in_sample, count(*) AS n, CAST(max(date) AS VARCHAR) AS last_date FROM x GROUP BY ALL"),
    "nights_between": (nights, f"WITH {HOURLY_SQL}, x AS (SELECT symbol, ts, lead(ts, 24) OVER w AS until FROM bars {W}) SELECT symbol, {TS}, greatest(0, date_diff('day', CAST(x.ts - INTERVAL 17 HOUR AS DATE), CAST(until - INTERVAL 17 HOUR AS DATE)))::BIGINT AS nights FROM x WHERE until IS NOT NULL"),
    "quantile_gates": (gates, f"WITH {GATES_SQL}"),
}
