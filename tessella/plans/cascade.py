"""Queries on the cascade of frames: setups, triggers, the whole chain with its filters and costs, and its walk-forward over a grid."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ordering import Series
from tessella.operators import barriers as T
from tessella.operators import bars as B
from tessella.operators import calendar as C
from tessella.operators import ewm as E
from tessella.operators import joins as J
from tessella.operators import patterns as N
from tessella.operators import research as Q
from tessella.operators import rolling as R
from tessella.plans.base import DAILY, DAILY_SQL, HOURLY, HOURLY_SQL, daily, hourly, panel, ticks
from tessella.plans.market import GATES_SQL, ZONE, ewm_sql, inside_sql, local_sql, r, stamp
from tessella.plans.risk import PARTNER_SQL
from tessella.plans.trading import FVG_PART, OB_SQL, OUTCOME_SQL, PATTERN_SQL, SWEEP_PART, SWEEP_SQL, chosen_sql, logs, price_sql, retrace_sql
from tessella.sources import incremental as I
from tessella.sources.stage import shared_folder, staged

SYMBOL = ("symbol",)


def coarse(spark: SparkSession, sf: str, hours: int = 3) -> DataFrame:
    return B.rebar(hourly(spark, sf), B.every("ts", f"{hours} hours"))


def frame_sql(name: str, hours: int) -> str:
    return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '2024-01-01') AS date, arg_min(open, ts) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, ts) AS close, sum(volume)::DOUBLE AS volume FROM bars GROUP BY ALL)"""


NUMBERED = "pb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS bar FROM coarse)"
NEAR, FAR = f"{1 - 0.33!r}::DOUBLE", f"{1 - 1.0!r}::DOUBLE"


def setups_sql(zones: str = "fvg UNION ALL SELECT * FROM ob", any_zone: bool = False) -> str:
    """setups (symbol, bar, date, side, level, kind) after PATTERN_SQL."""
    touched = """WHERE EXISTS (SELECT 1 FROM zone z WHERE z.symbol = rt0.symbol AND z.side = rt0.side AND z.known_bar < rt0.bar
    AND z.known_bar >= rt0.bar - 24 AND rt0.low <= z.hi AND rt0.high >= z.lo)"""
    return (
        SWEEP_PART
        + ("" if any_zone else FVG_PART + OB_SQL + f", zone AS (SELECT * FROM {zones})")
        + f""",
rt0 AS (SELECT i.symbol, i.bar, i.date, j.bar AS jb, i.low, i.high, CASE WHEN j.close > j.hi_prev THEN 1.0 ELSE -1.0 END::DOUBLE AS side,
    CASE WHEN j.close > j.hi_prev THEN j.hi_prev ELSE j.lo_prev END AS level
  FROM b i JOIN b j ON i.symbol = j.symbol AND j.bar BETWEEN greatest(i.bar - 6, 21) AND i.bar - 1 WHERE i.bar > 20 AND (
    (j.close > j.hi_prev AND i.low >= j.hi_prev + (j.close - j.hi_prev) * {FAR} AND i.low <= j.hi_prev + (j.close - j.hi_prev) * {NEAR})
    OR (j.close < j.lo_prev AND i.high >= j.lo_prev - (j.lo_prev - j.close) * {NEAR} AND i.high <= j.lo_prev - (j.lo_prev - j.close) * {FAR}))),
rt1 AS (SELECT * FROM rt0 {"" if any_zone else touched} QUALIFY row_number() OVER (PARTITION BY symbol, bar ORDER BY jb) = 1),
setups AS (SELECT symbol, bar, date, CASE WHEN close > hi_prev THEN 1.0 ELSE -1.0 END::DOUBLE AS side, CASE WHEN close > hi_prev THEN hi_prev ELSE lo_prev END AS level, 'breakout' AS kind
    FROM b WHERE bar > 20 AND (close > hi_prev OR close < lo_prev)
  UNION ALL SELECT symbol, bar, date, sweep, NULL, 'fakeout' FROM sweep WHERE bar > 20 AND sweep <> 0
  UNION ALL SELECT symbol, bar, date, side, level, 'retrace' FROM rt1)"""
    )


def triggers_sql(window: int, unit: str, also: str = "true", sets: str = "(VALUES ('all', ['breakout', 'fakeout', 'retrace'])) s(kinds, has)") -> str:
    """picked (symbol, kinds, fbar, side, kind): each setup's bar among those of `fb` (symbol, ts, fbar, n, close, prev, `unit` and what `also`
    reads), by recursion over the setups of a symbol and kinds."""
    return f""",
steps AS (SELECT symbol, floor(median(epoch(date) - epoch(p)))::BIGINT AS step FROM (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS p FROM pb) GROUP BY symbol),
known AS (SELECT u.*, kinds, u.date + to_seconds(step) AS known_at FROM setups u JOIN steps USING (symbol), {sets} WHERE list_contains(has, kind)),
begun AS (SELECT k.symbol, k.kinds, k.side, k.kind, k.known_at, min(f.fbar) AS sb FROM known k JOIN fb f ON f.symbol = k.symbol AND f.ts >= k.known_at GROUP BY ALL),
options AS (SELECT g.symbol, g.kinds, g.side, g.kind, g.known_at, list(f.fbar ORDER BY f.fbar) AS opts FROM begun g JOIN fb f ON f.symbol = g.symbol AND f.fbar BETWEEN g.sb AND g.sb + {window - 1}
  WHERE f.fbar < f.n - 1 AND f.{unit} > 0 AND CASE WHEN g.side > 0 THEN f.close > f.prev ELSE f.close < f.prev END AND {also} GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (PARTITION BY symbol, kinds ORDER BY known_at, kind, side) AS k FROM options),
pick AS (SELECT symbol, kinds, k, opts[1] AS last, opts[1] AS fbar FROM turns WHERE k = 1
  UNION ALL SELECT t.symbol, t.kinds, t.k, coalesce(list_min([x for x in t.opts if x > p.last]), p.last), list_min([x for x in t.opts if x > p.last]) FROM pick p JOIN turns t ON t.symbol = p.symbol AND t.kinds = p.kinds AND t.k = p.k + 1),
picked AS (SELECT t.symbol, t.kinds, p.fbar, t.side, t.kind FROM pick p JOIN turns t ON t.symbol = p.symbol AND t.kinds = p.kinds AND t.k = p.k WHERE p.fbar IS NOT NULL)"""


#: Entries on the coarse frame: the first bar that closes after the time, not the last one, one entry a bar.
ON_FRAME = """,
closing AS (SELECT pb.symbol, bar, date + to_seconds(step) AS upto, max(bar) OVER (PARTITION BY pb.symbol) AS last FROM pb JOIN steps ON steps.symbol = pb.symbol),
landed AS (SELECT e.symbol, e.kinds, e.ts, min(c.bar) AS bar, any_value(c.last) AS last FROM found e JOIN closing c ON c.symbol = e.symbol AND c.upto > e.ts GROUP BY ALL),
entered AS (SELECT e.* EXCLUDE (fbar), l.bar FROM found e JOIN landed l ON l.symbol = e.symbol AND l.kinds = e.kinds AND l.ts = e.ts WHERE l.bar < l.last
  QUALIFY row_number() OVER (PARTITION BY e.symbol, e.kinds, l.bar ORDER BY e.ts) = 1)"""


# ---- intraday: setups on 3-hour bars, triggers on hourly ones, bias from 6-hour ones


def mtf_setups(spark: SparkSession, sf: str) -> DataFrame:
    b = coarse(spark, sf)
    return N.setups(b, HOURLY, 20, N.zones(b, HOURLY)).select("symbol", stamp(), "side", r("level").alias("level"), "kind")


SETUPS_SQL = HOURLY_SQL + ", " + frame_sql("coarse", 3) + ", " + NUMBERED + PATTERN_SQL + setups_sql()

#: Where each symbol's order flow lives.
SESSIONS = {"click": ["london", "newyork"], "view": ["london", "newyork"], "purchase": ["newyork"], "signup": ["tokyo", "london"]}
OTHERS = ["tokyo", "london", "newyork"]


def tradable(at: Column) -> Column:
    """Inside the symbol's sessions and outside blackouts."""
    inside = F.coalesce(*[F.when(F.col("symbol") == s, C.in_sessions(at, names)) for s, names in SESSIONS.items()], C.in_sessions(at, OTHERS))
    return inside & ~C.blackout(at)


def mtf_entries(spark: SparkSession, sf: str) -> DataFrame:
    """All setups, triggered on hourly bars by the sigma stop, without bias."""
    e = N.cascade_entries(hourly(spark, sf), coarse(spark, sf), HOURLY, N.Cascade(stop_mode="sigma"))
    return e.select("symbol", "bar", stamp("time"), "kind", "side", r("entry").alias("entry"), r("stop").alias("stop"))


def structural_sql(scale: str, stop_sigma: float = 1.0) -> str:
    return f"f.close - p.side * greatest(abs(f.close - CASE WHEN p.side > 0 THEN f.low ELSE f.high END), {stop_sigma!r} * {scale})"


FB_SIGMA = f""",
fl AS (SELECT symbol, ts, high, low, close, row_number() OVER w - 1 AS fbar, lag(close) OVER w AS prev, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
fs AS (SELECT symbol, ts, sqrt({ewm_sql("pow(ln(close / prev), 2)", 1 - 0.94, "symbol", "ts", "fbar")}) AS s FROM fl WHERE prev IS NOT NULL),
fb AS (SELECT fl.*, lag(s) OVER (PARTITION BY fl.symbol ORDER BY fl.ts) AS unit FROM fl LEFT JOIN fs ON fs.symbol = fl.symbol AND fs.ts = fl.ts)"""
ENTRIES_SQL = (
    "WITH RECURSIVE " + HOURLY_SQL + ", " + frame_sql("coarse", 3) + ", " + NUMBERED + PATTERN_SQL + setups_sql(any_zone=True) + FB_SIGMA + triggers_sql(6, "unit")
    + f", found AS (SELECT p.*, f.ts, f.close AS entry, {structural_sql('f.unit * f.close')} AS stop FROM picked p JOIN fb f ON f.symbol = p.symbol AND f.fbar = p.fbar)" + ON_FRAME
    + " SELECT symbol, bar, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, kind, side, round(entry, 6) AS entry, round(stop, 6) AS stop FROM entered"
)


def quoted(spark: SparkSession, sf: str, step: str, commission: float) -> DataFrame:
    """3-hour bars with `cost_bp` from the spreads observed in them."""
    t = ticks(spark, sf)
    bid, ask = t.select("symbol", "ts", F.col("bid").alias("close")), t.select("symbol", "ts", F.col("ask").alias("close"))
    return J.real_cost_bp(coarse(spark, sf), J.observed_spread(bid, ask, SYMBOL), HOURLY, B.every("ts", step), commission)


def cascade_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain: zones, bias, sessions, blackouts, the stop in average true ranges, observed cost, 3 to 1."""
    b, high = coarse(spark, sf), coarse(spark, sf, 6).withColumn("session", B.session_end_date("ts"))
    e = N.cascade_entries(hourly(spark, sf), b, HOURLY, N.Cascade(), N.zones(b, HOURLY), high, tradable(F.col("time")))
    return T.walk_explicit(quoted(spark, sf, "3 hours", 0.35), e.drop("time", "kinds", "structural", "unit"), HOURLY, rr=3.0, max_bars=20, cost_bp="cost_bp")


def mtf_cascade(spark: SparkSession, sf: str) -> DataFrame:
    t = cascade_trades(spark, sf)
    return t.select("symbol", "bar", "kind", "side", r("entry").alias("entry"), r("exit").alias("exit"), "outcome", "bars_held", r("cost_R").alias("cost_R"), r("net_R").alias("net_R"))


def mtf_cascade_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Against the hurdle and the touch benchmark, by symbol."""
    t = cascade_trades(spark, sf)
    s = T.barrier_summary(t, SYMBOL, 3.0).join(T.touch_benchmark(t, SYMBOL).select("symbol", "expected", "z"), "symbol", "left")
    return s.select("symbol", "trades", *[r(c).alias(c) for c in ("win_rate", "barrier_win_rate", "hurdle", "gap", "time_share", "mean_net_R", "expected", "z")])


BIAS_PART = f""",
hb AS (SELECT *, CAST({local_sql(ZONE).replace("ts ", "date ")} + INTERVAL 7 HOUR AS DATE) AS session, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM high),
hv AS (SELECT symbol, date, rn, sum((high + low + close) / 3 * volume) OVER d / sum(volume) OVER d AS vwap FROM hb WINDOW d AS (PARTITION BY symbol, session ORDER BY date ROWS UNBOUNDED PRECEDING)),
he AS (SELECT symbol, date, vwap, {ewm_sql("vwap", 0.2, "symbol", "date", "rn")} AS ema FROM hv),
hstep AS (SELECT symbol, floor(median(epoch(date) - epoch(p)))::BIGINT AS step FROM (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS p FROM high) GROUP BY symbol),
hbias AS (SELECT he.symbol, date + to_seconds(step) AS upto, coalesce(sign(round(ema - vwap, 9)), 0)::DOUBLE AS bias FROM he JOIN hstep ON hstep.symbol = he.symbol)"""
FB_ATR = f""",
fl AS (SELECT symbol, ts, high, low, close, row_number() OVER w - 1 AS fbar, row_number() OVER w AS rn, lag(close) OVER w AS prev, count(*) OVER (PARTITION BY symbol) AS n,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
fa AS (SELECT *, {ewm_sql("tr", 1 / 14, "symbol", "ts", "rn")} AS a FROM fl),
fu AS (SELECT *, lag(CASE WHEN rn >= 14 THEN a END) OVER (PARTITION BY symbol ORDER BY ts) AS unit FROM fa),
fb AS (SELECT fu.*, bias FROM fu ASOF LEFT JOIN hbias ON hbias.symbol = fu.symbol AND fu.ts >= hbias.upto)"""


def inside_names(names: list[str]) -> str:
    return "(" + " OR ".join(inside_sql(n) for n in names) + ")"


MINUTES = f"(hour({local_sql(ZONE)}) * 60 + minute({local_sql(ZONE)}))"
TRADABLE_SQL = f"""CASE {" ".join(f"WHEN symbol = '{s}' THEN {inside_names(n)}" for s, n in SESSIONS.items())} ELSE {inside_names(OTHERS)} END
  AND NOT ({MINUTES} >= 1005 AND {MINUTES} < 1080)"""
CASCADE_SQL = (
    "WITH RECURSIVE " + HOURLY_SQL + ", " + frame_sql("coarse", 3) + ", " + frame_sql("high", 6) + ", " + NUMBERED + PATTERN_SQL + setups_sql() + BIAS_PART + FB_ATR
    + triggers_sql(6, "unit", "f.bias = g.side")
    + f""",
found AS (SELECT * FROM (SELECT p.*, f.ts, f.close AS entry, {structural_sql("f.unit")} AS stop FROM picked p JOIN fb f ON f.symbol = p.symbol AND f.fbar = p.fbar) WHERE {TRADABLE_SQL})"""
    + ON_FRAME
    + """,
cand AS (SELECT symbol, bar, side, entry, stop, kind, entry + side * abs(entry - stop) * 3 AS target FROM entered WHERE entry <> stop)"""
    + OUTCOME_SQL.replace("{n}", "20")
    + """,
quote AS (SELECT symbol, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01') AS date, median(greatest(0, (ask - bid) / ((ask + bid) / 2)) * 1e4 / 2) + 0.35 AS cost FROM ticks GROUP BY ALL),
walked AS (SELECT t.*, c.kind, 2 * q.cost / 1e4 * t.entry / abs(t.entry - t.stop) AS cost_R, t.side * (t.exit - t.entry) / abs(t.entry - t.stop) - 2 * q.cost / 1e4 * t.entry / abs(t.entry - t.stop) AS net_R
  FROM trades t JOIN cand c ON c.symbol = t.symbol AND c.bar = t.bar JOIN pb ON pb.symbol = t.symbol AND pb.bar = t.bar JOIN quote q ON q.symbol = t.symbol AND q.date = pb.date)"""
)
CASCADE_SUMMARY_SQL = CASCADE_SQL + """,
s AS (SELECT symbol, count(*) AS trades, avg((net_R > 0)::INT) AS w, avg((outcome = 'target')::INT) FILTER (outcome IN ('target', 'stop')) AS bw, avg(cost_R) AS c, avg((outcome = 'time')::INT) AS ts, avg(net_R) AS m FROM walked GROUP BY symbol),
pr AS (SELECT symbol, outcome, abs(ln(entry / stop)) / (abs(ln(entry / stop)) + abs(ln(target / entry))) AS p FROM walked WHERE outcome IN ('target', 'stop')),
z AS (SELECT symbol, avg(p) AS expected, (avg((outcome = 'target')::INT) - avg(p)) * count(*) / nullif(sqrt(sum(p * (1 - p))), 0) AS z FROM pr WHERE p IS NOT NULL AND NOT isnan(p) GROUP BY symbol)
SELECT s.symbol, trades, round(w, 6) AS win_rate, round(bw, 6) AS barrier_win_rate, round((1 + c) / 4, 6) AS hurdle, round(bw - (1 + c) / 4, 6) AS gap, round(ts, 6) AS time_share, round(m, 6) AS "mean_net_R",
  round(expected, 6) AS expected, round(z, 6) AS z FROM s LEFT JOIN z USING (symbol)"""


# ---- daily bars, setups on 3-day ones: eighteen configurations over one reading of the bars

KIND_SETS = {"all": N.KINDS, "fade": ("fakeout", "retrace")}
STOPS, RATIOS, LIMIT = (0.75, 1.0, 1.5), (2.0, 3.0, 4.0), 20
GRID = [T.Geometry(f"rr{rr:g}_atr{k:g}", rr, LIMIT, f"stop_{j}") for j, k in enumerate(STOPS) for rr in RATIOS]
FIXED = "rr3_atr1_all"
FOLDS = C.make_folds(date(1995, 1, 1), date(2001, 8, 1), 18, 6)


def three_days(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("date")
    return B.rebar(logs(spark, sf), F.date_sub(d, F.pmod(F.unix_date(d), F.lit(3)).cast("int")), ts="date", out="date")


def grid_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The trades of every configuration: kinds of setups, stops in average true ranges, reward ratios."""
    b = three_days(spark, sf)
    e = N.cascade_entries(logs(spark, sf), b, DAILY, N.Cascade(), N.fair_value_gaps(b, DAILY), kind_sets=KIND_SETS)
    e = T.looking_ahead(e, T.numbered_bars(b, DAILY), DAILY, LIMIT, "date").withColumnRenamed("__own_date", "entry_time")
    e = e.withColumns({f"stop_{j}": N.stop_beyond(F.col("entry"), F.col("side"), F.col("structural"), k * F.col("unit")) for j, k in enumerate(STOPS)})
    t = T.grid_walk(e, DAILY, GRID, F.lit(1.0), group=("kinds",))
    return t.withColumn("config", F.concat_ws("_", "config", "kinds"))


def cascade_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = grid_trades(spark, sf).groupBy("config").agg(F.count(F.lit(1)).alias("trades"), r(F.avg((F.col("outcome") == "target").cast("double"))).alias("target_share"), r(F.avg("unit_net_R")).alias("mean_net_R"), F.sum("bars_held").alias("bars"))
    return d.select("config", "trades", "target_share", "mean_net_R", "bars")


def cascade_walkforward(spark: SparkSession, sf: str) -> DataFrame:
    """Each fold's pick among the configurations, and its trades in the test span."""
    t, folds = staged(grid_trades(spark, sf).select("config", "entry_time", "unit_net_R"), "grid"), C.folds_frame(spark, FOLDS)
    picks = Q.held_out_of(Q.select_configs(t, folds), t, folds)
    return picks.select("fold", "config", r("score").alias("score"), "n_test", r("test_mean").alias("test_mean"))


def cascade_walkforward_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Out of sample, beside the configuration fixed beforehand."""
    t, folds = staged(grid_trades(spark, sf).select("config", "entry_time", "unit_net_R"), "grid"), C.folds_frame(spark, FOLDS)
    picks = Q.select_configs(t, folds)
    fixed = Q.slice_fold(t.filter(F.col("config") == FIXED), folds.join(F.broadcast(picks.select("fold")), "fold", "left_semi"), "test_start", "test_end")
    d = Q.walk_forward_summary(Q.out_of_sample(t, folds, picks), picks, fixed=fixed)
    return d.select("trades", "distinct_configs", *[r(c).alias(c) for c in ("win_rate", "mean_net_R", "t", "selection_stability", "fixed_mean_net_R", "selection_edge")])


DAY3 = """coarse AS (SELECT symbol, date - CAST((date - DATE '1970-01-01') % 3 AS INTEGER) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume
  FROM (SELECT symbol, date, {prices}, volume FROM daily) GROUP BY ALL)""".replace("{prices}", ", ".join(price_sql(c) for c in B.OHLC)).replace("AS date, arg_min", "AS d3, arg_min").replace("coarse AS (", "coarse3 AS (")
DAY3 += ", coarse AS (SELECT * RENAME (d3 AS date) FROM coarse3)"
FB_DAILY = FB_ATR.split("fb AS (")[0].replace("FROM bars WINDOW", f"FROM (SELECT symbol, date AS ts, {', '.join(price_sql(c) for c in B.OHLC)} FROM daily) WINDOW") + "fb AS (SELECT * FROM fu)"
SETS = "(VALUES " + ", ".join(f"('{n}', {list(k)})" for n, k in KIND_SETS.items()) + ") s(kinds, has)"
CELLS = ", ".join(f"('{g.name}', {k!r}::DOUBLE, {g.rr!r}::DOUBLE)" for k, g in zip([k for k in STOPS for _ in RATIOS], GRID, strict=True))
GRID_SQL = (
    "WITH RECURSIVE " + DAILY_SQL + ", " + DAY3 + ", " + NUMBERED + PATTERN_SQL + setups_sql("fvg") + FB_DAILY + triggers_sql(6, "unit", sets=SETS)
    + """,
found AS (SELECT p.*, f.ts, f.close AS entry, f.unit, CASE WHEN p.side > 0 THEN f.low ELSE f.high END AS structural FROM picked p JOIN fb f ON f.symbol = p.symbol AND f.fbar = p.fbar)"""
    + ON_FRAME
    + f""",
geo AS (SELECT * FROM (VALUES {CELLS}) g(cell, k, rr)),
named AS (SELECT cell || '_' || kinds AS config, e.symbol AS own, e.* EXCLUDE (symbol), rr, entry - side * greatest(abs(entry - structural), k * unit) AS stop FROM entered e, geo),
b4 AS (SELECT config || ':' || symbol AS symbol, bar, date, high, low, close FROM b, (SELECT DISTINCT config FROM named)),
cand AS (SELECT config || ':' || own AS symbol, config, bar, side, entry, stop, entry + side * abs(entry - stop) * rr AS target FROM named WHERE entry <> stop)"""
    + OUTCOME_SQL.replace("FROM b GROUP", "FROM b4 GROUP").replace("JOIN b f", "JOIN b4 f").replace("{n}", str(LIMIT))
    + """,
grid AS (SELECT c.config, b4.date, t.outcome, t.held, t.side * (t.exit - t.entry) / abs(t.entry - t.stop) - 2.0 / 1e4 * t.entry / abs(t.entry - t.stop) AS x
  FROM trades t JOIN cand c ON c.symbol = t.symbol AND c.bar = t.bar JOIN b4 ON b4.symbol = t.symbol AND b4.bar = t.bar)"""
)
FOLD_ROWS = ", ".join(f"({f['fold']}, DATE '{f['train_start']}', DATE '{f['train_end']}', DATE '{f['test_start']}', DATE '{f['test_end']}')" for f in FOLDS)
PICKS_SQL = GRID_SQL + f""",
fold AS (SELECT * FROM (VALUES {FOLD_ROWS}) f(fold, a, b, c, d)),
scores AS (SELECT fold, config, avg(x) AS score FROM grid JOIN fold ON date >= a AND date < fold.b GROUP BY ALL HAVING count(*) >= 30),
picks AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC, config) = 1),
oos AS (SELECT p.fold, g.x FROM grid g JOIN fold ON date >= c AND date < d JOIN picks p ON p.fold = fold.fold AND p.config = g.config)"""


# ---- gated breakouts: twenty-four configurations chosen in sample, and what the chosen one does held out, with and without its gates

BLOCKED = Series(("symbol", "block"), ("date",))
SIGMAS, REWARD, WAIT, TRIGGER, COST = (1.0, 2.0, 3.0, 4.0), 2.0, 20, 0.01, 2.0
GATED = [T.Geometry(f"s{k:g}_{'be' if be else 'hold'}", REWARD, WAIT, f"stop_{j}", be) for j, k in enumerate(SIGMAS) for be in (True, False)]
#: The synthetic prices jump, so breakouts are of five bars and may come back far.
LOOKBACK, DEEPEST = 5, 60.0
#: Gates of a configuration: none (the control), regime and VaR, these and a partner of so large a correlation.
RHO = {"corr0": 0.0, "corr30": 0.3, "corr50": 0.5}


def partners(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, rho, implied): each symbol's best partner and the side it implies."""
    p = panel(spark, sf)
    moves = p.withColumn("move", F.sum("ret").over(Series(("asset",), ("date",)).prev(8))).select("date", "asset", "move")
    return J.best_partner(E.ewma_correlation_path(p, 0.97), moves, "date", 0.0).select("date", F.col("asset").alias("symbol"), "rho", "implied")


def gates_of(bars: DataFrame) -> DataFrame:
    """(symbol, date, all_gates) of daily bars."""
    ret = B.log_returns(bars, DAILY).withColumn("ret", F.col("ret") / 100)
    d = R.rolling_historical_var(E.ewma_sigma(ret, DAILY, "ret"), DAILY, "ret", 0.95, 100)
    return R.quantile_gates(d, DAILY, "sigma", "var", 400).select("symbol", "date", (F.col("g_regime") & F.col("g_var")).alias("all_gates"))


def regime(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, date, all_gates, rho, implied): the daily gates and the best partner's side."""
    return gates_of(daily(spark, sf)).join(partners(spark, sf), ["symbol", "date"], "left")


def regime_table(spark: SparkSession, sf: str, path: str) -> list:
    """Build or renew the regime table at path; the symbols that were built."""
    return I.rebuild(path, "symbol", daily(spark, sf), lambda stale: gates_of(stale).join(partners(spark, sf), ["symbol", "date"], "left"), "1", (panel(spark, sf),))


def regime_permission(spark: SparkSession, sf: str) -> DataFrame:
    """How many sweeps the regime table lets through, by symbol and side; the table is built, and renewed without work."""
    path = f"{shared_folder(spark)}/tessella-regime-{uuid.uuid4().hex}"
    first, again = regime_table(spark, sf, path), regime_table(spark, sf, path)
    if again or not first:
        raise RuntimeError("the table was not built once")
    e = N.sweeps(logs(spark, sf), DAILY).filter("sweep <> 0").select("symbol", "date", F.col("sweep").alias("side"))
    d = Q.permitted(e, I.table(spark, path, "symbol"), SYMBOL, "date")
    return d.groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("all_gates", F.lit(False))).alias("open"), F.count_if("allowed").alias("allowed"))


def gated_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades of every geometry under every gate, in the first two thirds of each symbol's bars and in the rest apart."""
    bars = C.split_at(logs(spark, sf), DAILY).withColumns({"block": F.when(F.col("in_sample"), "in").otherwise("out"), "session": F.lit(0)}).drop("in_sample")
    e = N.breakout_retrace(bars, BLOCKED, lookback=LOOKBACK, near=0.1, far=DEEPEST)
    e = T.looking_ahead(e, T.numbered_bars(bars, BLOCKED), BLOCKED, WAIT, "date").withColumnRenamed("__own_date", "date")
    e = e.join(regime(spark, sf), ["symbol", "date"], "left")
    passed = F.coalesce("all_gates", F.lit(False))
    agrees = lambda least: passed & (F.coalesce(F.abs("rho"), F.lit(0.0)) >= least) & (F.coalesce("implied", F.lit(0.0)) == F.col("side"))
    gates = {"plain": F.lit(True), "corr0": passed} | {n: agrees(x) for n, x in RHO.items() if x > 0}
    open_ = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in gates.items()]), lambda n: n.isNotNull())
    stops = {f"stop_{j}": N.stop_beyond(F.col("entry"), F.col("side"), F.col("structural"), k * F.col("unit")) for j, k in enumerate(SIGMAS)}
    e = e.withColumns({"gate": F.explode(open_)} | stops).select("symbol", "block", "date", "bar", "side", "entry", "gate", "ahead", *stops)
    return T.grid_walk(e, BLOCKED, GATED, F.lit(COST), TRIGGER, ("gate",))


def gated_cells(trades: DataFrame) -> DataFrame:
    x, met = F.col("net_R"), F.col("outcome").isin("target", "stop")
    d = trades.groupBy("block", "gate", "config").agg(
        F.count(x).alias("trades"), F.avg(F.when(met, (F.col("outcome") == "target").cast("double"))).alias("barrier_win_rate"), ((1 + F.avg("cost_R")) / (1 + REWARD)).alias("hurdle"),
        F.avg(x).alias("mean"), F.sum(x).alias("total"), F.stddev_samp(x).alias("sd"),
    )
    return d.withColumn("t", F.when(F.col("trades") > 5, F.col("mean") * F.sqrt("trades") / F.when(F.col("sd") > 0, F.col("sd"))))


SHOWN = ("barrier_win_rate", "hurdle", "mean", "total")


def gated_grid(spark: SparkSession, sf: str) -> DataFrame:
    return gated_cells(gated_trades(spark, sf)).select("block", "gate", "config", "trades", *[r(c).alias(c) for c in SHOWN])


def gated_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The configuration of the best in-sample mean (30 trades at least), in both blocks, beside its control without gates."""
    cells = staged(gated_cells(gated_trades(spark, sf)), "cells")
    best = cells.filter("block = 'in' AND gate <> 'plain' AND trades >= 30").orderBy(F.round("mean", 9).desc(), "config", "gate").limit(1).select("config", F.col("gate").alias("chosen_gate"))
    d = cells.join(F.broadcast(best), "config").filter("gate IN ('plain', chosen_gate)")  # one row
    return d.select("block", "config", "gate", "trades", *[r(c).alias(c) for c in (*SHOWN, "t")])


GATE_FRAME = f"""gate AS (WITH {GATES_SQL.split("b AS (SELECT symbol, coalesce(sigma")[0].rstrip().rstrip(",")}
  SELECT symbol, date, coalesce(sigma >= lo AND sigma <= hi, false) AND coalesce(var <= cap, false) AS ok FROM g)"""
PARTNER_FRAME = f"""partner AS (WITH {PARTNER_SQL.split("SELECT CAST(top.date")[0].rstrip()}
  SELECT top.date, top.asset AS symbol, rho, coalesce(sign(rho) * sign(move), 0)::DOUBLE AS implied FROM top LEFT JOIN mv ON mv.date = top.date AND mv.asset = partner WHERE k = 1)"""
GATE_CELLS = ", ".join(f"('{g.name}', {k!r}::DOUBLE, {g.breakeven})" for k, g in zip([k for k in SIGMAS for _ in (0, 1)], GATED, strict=True))
GATED_SQL = (
    "WITH RECURSIVE " + DAILY_SQL + ", " + GATE_FRAME + ", " + PARTNER_FRAME
    + f""", cut AS (SELECT symbol, date, {", ".join(price_sql(c) for c in B.OHLC)}, volume, row_number() OVER (PARTITION BY symbol ORDER BY date) <= floor(count(*) OVER (PARTITION BY symbol) * 0.67) AS first FROM daily),
pb AS (SELECT symbol || '|' || CASE WHEN first THEN 'in' ELSE 'out' END AS symbol, date, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol, first ORDER BY date) - 1 AS bar FROM cut)"""
    + PATTERN_SQL + retrace_sql("0", LOOKBACK, 12, 0.1, DEEPEST)
    + f""",
marked AS (SELECT m.symbol, split_part(m.symbol, '|', 2) AS block, m.bar, m.side, m.entry, m.side * m.dp AS structural, m.unit, coalesce(ok, false) AS ok, coalesce(abs(rho), 0) AS rho, coalesce(implied, 0) AS implied
  FROM resumed m JOIN pb ON pb.symbol = m.symbol AND pb.bar = m.bar LEFT JOIN gate ON gate.symbol = split_part(m.symbol, '|', 1) AND gate.date = pb.date LEFT JOIN partner ON partner.symbol = split_part(m.symbol, '|', 1) AND partner.date = pb.date),
open_gates AS (SELECT *, 'plain' AS gate FROM marked UNION ALL SELECT *, 'corr0' FROM marked WHERE ok
  UNION ALL SELECT *, 'corr30' FROM marked WHERE ok AND rho >= 0.3 AND implied = side UNION ALL SELECT *, 'corr50' FROM marked WHERE ok AND rho >= 0.5 AND implied = side),
geo AS (SELECT * FROM (VALUES {GATE_CELLS}) g(config, m, be)),
c0 AS (SELECT config || '/' || gate || '/' || symbol AS symbol, config, gate, block, be, bar, side, entry, entry - side * greatest(abs(entry - structural), m * unit) AS stop FROM open_gates, geo),
cand AS (SELECT *, entry + side * abs(entry - stop) * {REWARD} AS target FROM c0 WHERE entry <> stop),
b5 AS (SELECT config || '/' || gate || '/' || b.symbol AS symbol, bar, high, low, close FROM b, (SELECT DISTINCT config, gate FROM c0)),
ah AS (SELECT c.symbol, c.bar, c.side, c.entry, c.stop, c.target, f.bar AS j, f.close AS cl, CASE WHEN c.side > 0 THEN f.high >= c.target ELSE f.low <= c.target END AS ht,
  CASE WHEN c.side > 0 THEN f.low <= c.stop ELSE f.high >= c.stop END AS hs, CASE WHEN c.side > 0 THEN f.low <= c.entry ELSE f.high >= c.entry END AS hb,
  c.be AND CASE WHEN c.side > 0 THEN f.close >= c.entry + c.side * {TRIGGER} * c.entry ELSE f.close <= c.entry + c.side * {TRIGGER} * c.entry END AS arm
  FROM cand c JOIN b5 f ON f.symbol = c.symbol AND f.bar BETWEEN c.bar + 1 AND c.bar + {WAIT}),
f1 AS (SELECT symbol, bar, any_value(side) AS side, any_value(entry) AS entry, any_value(stop) AS stop, any_value(target) AS target, min(j) FILTER (ht OR hs) AS hit, min(j) FILTER (arm) AS aj, max(j) AS lastj, arg_max(cl, j) AS lastc FROM ah GROUP BY symbol, bar),
f2 AS (SELECT f1.*, f1.aj IS NOT NULL AND (f1.hit IS NULL OR f1.hit > f1.aj) AS armed, s.j2 FROM f1
  LEFT JOIN (SELECT a.symbol, a.bar, min(a.j) AS j2 FROM ah a JOIN f1 x ON a.symbol = x.symbol AND a.bar = x.bar WHERE a.j > x.aj AND (a.ht OR a.hb) GROUP BY ALL) s ON s.symbol = f1.symbol AND s.bar = f1.bar),
f3 AS (SELECT *, CASE WHEN armed THEN j2 ELSE hit END AS h FROM f2),
be AS (SELECT f3.*, coalesce(h, lastj) - f3.bar AS held, f3.bar + greatest(coalesce(h, lastj) - f3.bar, 1) AS free, CASE WHEN h IS NULL THEN 'time' WHEN armed AND a.hb THEN 'breakeven' WHEN NOT armed AND a.hs THEN 'stop' ELSE 'target' END AS outcome,
  CASE WHEN h IS NULL THEN lastc WHEN armed AND a.hb THEN f3.entry WHEN NOT armed AND a.hs THEN f3.stop ELSE f3.target END AS exit FROM f3 LEFT JOIN ah a ON a.symbol = f3.symbol AND a.bar = f3.bar AND a.j = f3.h)"""
    + chosen_sql("traded", "be", "bar", "free")
    + f""",
cells AS (SELECT c.block, c.gate, c.config, count(*) AS trades, avg((outcome = 'target')::INT) FILTER (outcome IN ('target', 'stop')) AS barrier_win_rate, (1 + avg(cost)) / (1 + {REWARD}) AS hurdle, avg(x) AS mean, sum(x) AS total, stddev_samp(x) AS sd
  FROM (SELECT *, 2 * {COST} / 1e4 * entry / abs(entry - stop) AS cost, side * (exit - entry) / abs(entry - stop) - 2 * {COST} / 1e4 * entry / abs(entry - stop) AS x FROM traded) t JOIN (SELECT DISTINCT symbol, block, gate, config FROM cand) c ON c.symbol = t.symbol GROUP BY ALL)"""
)
SHOWN_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in SHOWN)


PERMISSION_SQL = f"""WITH {DAILY_SQL}, {GATE_FRAME}, {PARTNER_FRAME}, swept AS (WITH {SWEEP_SQL} SELECT symbol, date, sweep AS side FROM sweep WHERE sweep <> 0)
SELECT s.symbol, side, count(*) AS n, count(*) FILTER (ok) AS open, count(*) FILTER (ok AND coalesce(implied, 0) = side) AS allowed
FROM swept s LEFT JOIN gate g ON g.symbol = s.symbol AND g.date = s.date LEFT JOIN partner p ON p.symbol = s.symbol AND p.date = s.date GROUP BY ALL"""

QUERIES = {
    "regime_permission": (regime_permission, PERMISSION_SQL),
    "gated_grid": (gated_grid, f"{GATED_SQL} SELECT block, gate, config, trades, {SHOWN_SQL} FROM cells"),
    "gated_choice": (
        gated_choice,
        f"""{GATED_SQL}, best AS (SELECT config, gate AS chosen FROM cells WHERE block = 'in' AND gate <> 'plain' AND trades >= 30 ORDER BY round(mean, 9) DESC, config, gate LIMIT 1)
SELECT block, config, gate, trades, {SHOWN_SQL}, round(CASE WHEN trades > 5 THEN mean * sqrt(trades) / nullif(sd, 0) END, 6) AS t FROM cells JOIN best USING (config) WHERE gate IN ('plain', chosen)""",
    ),
    "cascade_grid": (cascade_grid, f"{GRID_SQL} SELECT config, count(*) AS trades, round(avg((outcome = 'target')::INT), 6) AS target_share, round(avg(x), 6) AS \"mean_net_R\", sum(held)::BIGINT AS bars FROM grid GROUP BY config"),
    "cascade_walkforward": (cascade_walkforward, f"{PICKS_SQL} SELECT p.fold, p.config, round(score, 6) AS score, count(x) AS n_test, round(avg(x), 6) AS test_mean FROM picks p LEFT JOIN oos ON oos.fold = p.fold GROUP BY p.fold, p.config, score"),
    "cascade_walkforward_summary": (
        cascade_walkforward_summary,
        PICKS_SQL
        + f""",
used AS (SELECT config, count(*) AS n FROM picks GROUP BY config),
fixed AS (SELECT avg(x) AS m FROM grid JOIN fold ON date >= c AND date < d WHERE config = '{FIXED}' AND fold IN (SELECT fold FROM picks))
SELECT count(*) AS trades, (SELECT count(*) FROM used) AS distinct_configs, round(avg((x > 0)::INT), 6) AS win_rate, round(avg(x), 6) AS "mean_net_R", round(avg(x) * sqrt(count(*)) / stddev_samp(x), 6) AS t,
  round((SELECT max(n) / sum(n) FROM used), 6) AS selection_stability, round((SELECT m FROM fixed), 6) AS "fixed_mean_net_R", round(avg(x) - (SELECT m FROM fixed), 6) AS selection_edge FROM oos""",
    ),
    "mtf_setups": (mtf_setups, f"WITH {SETUPS_SQL} SELECT symbol, strftime(date, '%Y-%m-%d %H:%M:%S') AS ts, side, round(level, 6) AS level, kind FROM setups"),
    "mtf_entries": (mtf_entries, ENTRIES_SQL),
    "mtf_cascade": (mtf_cascade, f"{CASCADE_SQL} SELECT symbol, bar, kind, side, round(entry, 6) AS entry, round(exit, 6) AS exit, outcome, held AS bars_held, round(cost_R, 6) AS \"cost_R\", round(net_R, 6) AS \"net_R\" FROM walked"),
    "mtf_cascade_summary": (mtf_cascade_summary, CASCADE_SUMMARY_SQL),
}
