"""GARCH(1,1), DCC and simulation: fits are per series in Python, many series at a time; filters and forecasts follow from them.

Estimation is iterative, so it can't be a Catalyst expression. A walk-forward fit is two stages: refit points are rows, each with
its own window of returns, and are fitted in parallel; then the filter runs between refits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ordering import Series, finite
from tessella.functions.special import with_t_constants
from tessella.operators.bootstrap import quantile_errors, risk_terms
from tessella.operators.ewm import affine_scan, pair_products
from tessella.sources.stage import staged

FIT = "omega double, alpha double, beta double, mu double, nu double, loglik double, n_obs long, converged boolean"


def nelder_mead(f, x0: np.ndarray, step: float = 0.25, rounds: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, float, bool]:
    """A simplex search without derivatives."""
    n = len(x0)
    points = [np.array(x0, dtype=float)] + [np.array(x0, dtype=float) + step * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tol * (abs(values[0]) + tol):
            return points[0], values[0], True
        centre = np.mean(points[:-1], axis=0)
        there = centre + (centre - points[-1])
        v = f(there)
        if v < values[0]:
            far = centre + 2 * (centre - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (there, v)
        elif v < values[-2]:
            points[-1], values[-1] = there, v
        else:
            near = centre + 0.5 * ((there if v < values[-1] else points[-1]) - centre)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], values[k], False


def variances(r2: np.ndarray, omega: float, alpha: float, beta: float, start: float) -> np.ndarray:
    """The filtered variances of each row, and one beyond the last."""
    out = np.empty(len(r2) + 1)
    s = out[0] = start
    for t, x in enumerate(r2.tolist()):
        s = omega + alpha * x + beta * s
        out[t + 1] = s
    return out


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def natural(x: np.ndarray, student: bool, constant: bool) -> tuple[float, float, float, float, float]:
    """(omega, alpha, beta, mu, nu) of unconstrained parameters: the sum alpha + beta stays below 0.99999, nu between 2.1 and 200."""
    total = 0.99999 * sigmoid(x[1])
    share = sigmoid(x[2])
    k = 3
    nu = 2.1 + 197.9 * sigmoid(x[k]) if student else math.inf
    mu = x[k + student] if constant else 0.0
    return math.exp(max(-60.0, min(20.0, x[0]))), total * share, total * (1 - share), mu, nu


def negative_loglik(r: np.ndarray, omega: float, alpha: float, beta: float, mu: float, nu: float, start: float) -> float:
    e2 = (r - mu) ** 2
    s = variances(e2, omega, alpha, beta, start)[:-1]
    if not np.all(s > 0):
        return 1e12
    if math.isinf(nu):
        return float(0.5 * np.sum(np.log(2 * math.pi * s) + e2 / s))
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return float(-np.sum(c - 0.5 * np.log(s) - (nu + 1) / 2 * np.log1p(e2 / s / (nu - 2))))


def fit(returns: np.ndarray, student: bool = True, constant: bool = False, least: int = 100) -> dict:
    """The fitted parameters in the returns' own scale; converged False with empty parameters for too few rows."""
    r = np.asarray(returns, dtype=float)
    r = r[np.isfinite(r)] * 100
    empty = {"omega": None, "alpha": None, "beta": None, "mu": None, "nu": None, "loglik": None, "n_obs": len(r), "converged": False}
    if len(r) < least or not r.std() > 0:
        return empty
    if not constant:
        return empty | {"mu": 0.0} | fit_many([r / 100], student, least)[0]
    start = float(np.var(r, ddof=1))
    x0 = [math.log(start * 0.02), math.log(0.98 / 0.01999), math.log(0.08 / 0.90)] + [math.log(5.9 / 192)] * student + [float(r.mean())] * constant
    best, value, ok = nelder_mead(lambda x: negative_loglik(r, *natural(x, student, constant), start), np.array(x0))
    omega, alpha, beta, mu, nu = natural(best, student, constant)
    return {"omega": omega / 1e4, "alpha": alpha, "beta": beta, "mu": mu / 100, "nu": nu if student else None, "loglik": -value, "n_obs": len(r), "converged": ok}


def fit_garch(df: DataFrame, series: Series, ret: str, student: bool = True, constant: bool = False) -> DataFrame:
    """One row of parameters per series, with persistence, long-run variance and half life."""
    keys = list(series.keys)
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", " + FIT

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(list(series.order))
        return pd.DataFrame([{k: own[k].iloc[0] for k in keys} | fit(own[ret].to_numpy(), student, constant)])

    out = df.select(*keys, *series.order, ret).groupBy(*keys).applyInPandas(of, schema)
    p = F.col("alpha") + F.col("beta")
    return out.withColumns({"persistence": p, "long_run_variance": F.when(p < 1, F.col("omega") / (1 - p)), "half_life": F.when((p > 0) & (p < 1), F.lit(math.log(0.5)) / F.ln(p))})


def forecast(fits: DataFrame, last_variance: Column, horizon: int = 10) -> DataFrame:
    """fits with a row per step: long run + persistence ** (h - 1) * (next variance - long run); flat where not stationary."""
    d = fits.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    gap = F.pow("persistence", (F.col("h") - 1).cast("double")) * (last_variance - F.col("long_run_variance"))
    return d.withColumn("variance", F.when(F.col("persistence") < 1, F.col("long_run_variance") + gap).otherwise(last_variance))


def filter_garch(df: DataFrame, fits: DataFrame, series: Series, ret: str, out: str = "variance") -> DataFrame:
    """The filtered variance before each row: the same affine recursion as an EWMA's, so it runs without Python. Fits have one row
    per series. It starts at the sample variance."""
    from pyspark.sql.window import Window

    d = df.join(fits.select(*series.keys, "omega", "alpha", "beta", "mu"), list(series.keys)).filter("omega IS NOT NULL")
    start = F.var_samp(ret).over(Window.partitionBy(*series.keys))
    e = F.coalesce(series.lag(F.col(ret) - F.col("mu")), F.lit(0.0))
    d = d.withColumns({"__s": start, "__e": e, "__first": F.row_number().over(series.window()) == 1})
    a = F.when(F.col("__first"), F.lit(1.0)).otherwise(F.greatest(F.col("beta"), F.lit(1e-12)))
    b = F.when(F.col("__first"), F.col("__s")).otherwise(F.col("omega") + F.col("alpha") * F.col("__e") * F.col("__e"))
    return affine_scan(d, series, a, {out: b}, block=16).drop("__s", "__e", "__first", "omega", "alpha", "beta", "mu")


def filtered(r2: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray, start: np.ndarray) -> np.ndarray:
    """variances() of many series at once, without the one beyond the last: [row, series]. The recursion is a scan by doubling: each pass
    adds what came twice as far before, so there are log2(rows) passes over the matrix and no loop over rows."""
    s = np.empty_like(r2)
    s[0], s[1:] = start, omega + alpha * r2[:-1]
    decay, back = beta, 1
    while back < len(s):
        s[back:] += decay * s[:-back].copy()
        decay, back = decay * decay, 2 * back
    return s


def fit_many(windows: list[np.ndarray], student: bool = True, least: int = 100, rounds: int = 2000, tol: float = 1e-10, step: float = 0.25) -> list[dict | None]:
    """fit() of many windows without a constant: the same simplex searches, a step of each at a time, so that a likelihood is one pass
    for all windows that still move. None where a window can't be fitted."""
    scaled = [x[np.isfinite(x)] * 100 for x in (np.asarray(w, dtype=float) for w in windows)]
    good = [k for k, r in enumerate(scaled) if len(r) >= least and r.std() > 0]
    if not good:
        return [None] * len(windows)
    r2 = np.zeros((max(len(scaled[k]) for k in good), len(good)))
    there = np.zeros(r2.shape, bool)
    for j, k in enumerate(good):
        r2[: len(scaled[k]), j], there[: len(scaled[k]), j] = scaled[k] ** 2, True
    start = np.array([np.var(scaled[k], ddof=1) for k in good])
    squash = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    def params(x: np.ndarray) -> tuple[np.ndarray, ...]:
        total, share = 0.99999 * squash(x[:, 1]), squash(x[:, 2])
        return np.exp(np.clip(x[:, 0], -60, 20)), total * share, total * (1 - share), 2.1 + 197.9 * squash(x[:, 3]) if student else None

    def loss(x: np.ndarray, who: np.ndarray) -> np.ndarray:
        omega, alpha, beta, nu = params(x)
        e2, mine = r2[:, who], there[:, who]
        s = filtered(e2, omega, alpha, beta, start[who])
        if student:
            c = np.array([math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(math.pi * (n - 2)) for n in nu.tolist()])
            each = -(c - 0.5 * np.log(s) - (nu + 1) / 2 * np.log1p(e2 / s / (nu - 2)))
        else:
            each = 0.5 * (np.log(2 * math.pi * s) + e2 / s)
        return np.where((s > 0).all(0), np.where(mine, each, 0.0).sum(0), 1e12)

    x0 = np.column_stack([np.log(start * 0.02), *[np.full(len(good), v) for v in [math.log(0.98 / 0.01999), math.log(0.08 / 0.90)] + [math.log(5.9 / 192)] * student]])
    n, every = x0.shape[1], np.arange(len(good))
    points = np.stack([x0, *[x0 + step * np.eye(n)[i] for i in range(n)]])  # [vertex, window, parameter]
    values = np.stack([loss(p, every) for p in points])
    live, done = every, np.zeros(len(good), bool)
    for _ in range(rounds):
        order = np.argsort(values[:, live], axis=0)
        p, v = np.take_along_axis(points[:, live], order[:, :, None], 0), np.take_along_axis(values[:, live], order, 0)
        points[:, live], values[:, live] = p, v
        still = np.abs(v[-1] - v[0]) >= tol * (np.abs(v[0]) + tol)
        done[live[~still]] = True
        live, p, v = live[still], p[:, still], v[:, still]
        if not len(live):
            break
        centre = p[:-1].mean(0)
        there_ = centre + (centre - p[-1])
        vt = loss(there_, live)
        best, middle = vt < v[0], (vt >= v[0]) & (vt < v[-2])
        worse = ~best & ~middle
        toward = np.where((vt < v[-1])[:, None], there_, p[-1])
        second = np.where(best[:, None], centre + 2 * (centre - p[-1]), centre + 0.5 * (toward - centre))
        v2 = np.full(len(live), np.inf)
        if (need := np.flatnonzero(~middle)).size:
            v2[need] = loss(second[need], live[need])
        take2 = (best & (v2 < vt)) | (worse & (v2 < np.minimum(vt, v[-1])))
        take1 = middle | (best & ~take2)
        p[-1] = np.where(take2[:, None], second, np.where(take1[:, None], there_, p[-1]))
        v[-1] = np.where(take2, v2, np.where(take1, vt, v[-1]))
        points[:, live], values[:, live] = p, v
        shrink = np.flatnonzero(worse & ~take2)
        if shrink.size:
            for k in range(1, n + 1):
                moved = p[0, shrink] + 0.5 * (p[k, shrink] - p[0, shrink])
                points[k, live[shrink]], values[k, live[shrink]] = moved, loss(moved, live[shrink])
    top = values.argmin(0)
    omega, alpha, beta, nu = params(points[top, every])
    out: list[dict | None] = [None] * len(windows)
    for j, k in enumerate(good):
        out[k] = {"omega": float(omega[j]) / 1e4, "alpha": float(alpha[j]), "beta": float(beta[j]), "nu": float(nu[j]) if student else None, "loglik": -float(values[top[j], j]), "n_obs": len(scaled[k]), "converged": bool(done[j])}
    return out


def tasks(df: DataFrame) -> int:
    """Tasks for few rows of much work: a number, as Spark would put rows so small in one task."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rolling_garch(df: DataFrame, series: Series, ret: str, min_obs: int = 250, window: int = 750, refit: int = 21, student: bool = True, at_once: int = 32) -> DataFrame:
    """Walk-forward forecasts: (keys, order, variance, nu, refit_at), each known before its row. A fit's parameters hold, and its variance
    runs on, up to the next point that could be fitted: a point whose window has too few returns or is constant keeps the last ones,
    so no row drops out. Rows before a series' first fit have no forecast. refit_at is the row number of the fit.

    `at_once` refit points in a row are one batch: a row goes to the batches whose windows hold it (two, if these are longer than a
    window), and a batch is fitted as one matrix. Rows between refits follow by a fold in the JVM.
    """
    keys, at = list(series.keys), series.order[0]
    d = df.select(*keys, at, ret).withColumn("__i", F.row_number().over(series.window()))
    kinds = dict(df.dtypes)
    # point k stands at row min_obs + 1 + k * refit, and its window is the `window` rows before
    lowest = F.greatest(F.lit(0), F.ceil((F.col("__i") - min_obs) / refit))
    highest = F.floor((F.col("__i") + window - min_obs - 1) / refit)
    batch = F.sequence(F.floor(lowest / at_once), F.floor(highest / at_once))
    spread = d.filter(highest >= lowest).withColumn("__b", F.explode(batch))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("__i")
        i, r, b = own["__i"].to_numpy(), own[ret].to_numpy(dtype=float), int(own["__b"].iloc[0])
        firsts = min_obs + 1 + refit * np.arange(b * at_once, (b + 1) * at_once)
        firsts = firsts[firsts <= i[-1] + 1]
        windows = [r[np.searchsorted(i, f - window) : np.searchsorted(i, f)] for f in firsts.tolist()]
        out = []
        for f, w, found in zip(firsts.tolist(), windows, fit_many(windows, student), strict=True):
            if found is not None:
                w = w[np.isfinite(w)]
                s = variances(w**2, found["omega"], found["alpha"], found["beta"], float(np.var(w, ddof=1)))[-1]
                out.append({x: own[x].iloc[0] for x in keys} | {"__i": f, "start": s} | {x: found[x] for x in ("omega", "alpha", "beta", "nu")})
        return pd.DataFrame(out, columns=[*keys, "__i", "start", "omega", "alpha", "beta", "nu"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "__i int, start double, omega double, alpha double, beta double, nu double"])
    fits = spread.repartition(tasks(df), *keys, "__b").groupBy(*keys, "__b").applyInPandas(fitted, schema)
    # each row's fit is the last one at or before it; a fit and its rows are one segment
    rows = d.join(fits, [*keys, "__i"], "left")
    rows = rows.withColumn("__fit", F.last(F.when(F.col("omega").isNotNull(), F.col("__i")), ignorenulls=True).over(series.upto())).filter("__fit IS NOT NULL")
    segments = rows.groupBy(*keys, "__fit").agg(F.sort_array(F.collect_list(F.struct("__i", F.col(at).alias("at"), F.col(ret).cast("double").alias("r")))).alias("rows"), *[F.max(c).alias(c) for c in ("start", "omega", "alpha", "beta", "nu")])
    state = lambda s, out: F.struct(s.alias("s"), out.alias("out"))
    after = lambda s, x: F.when(finite(x["r"]).isNotNull(), F.col("omega") + F.col("alpha") * x["r"] * x["r"] + F.col("beta") * s).otherwise(s)
    empty = F.array().cast("array<double>")
    path = F.reduce("rows", state(F.col("start"), empty), lambda a, x: state(after(a["s"], x), F.concat(a["out"], F.array(a["s"]))), lambda a: a["out"])
    cells = F.explode(F.arrays_zip(F.col("rows.at").alias("at"), path.alias("variance"))).alias("x")
    return segments.select(*keys, "nu", F.col("__fit").alias("refit_at"), cells).select(*keys, F.col("x.at").alias(at), "x.variance", *([F.col("nu")] if student else [F.lit(None).cast("double").alias("nu")]), F.col("refit_at").cast("long"))


def garch_var(forecasts: DataFrame, confidence: float = 0.99) -> DataFrame:
    """VaR and ES of a scaled t with each row's own nu (of its refit: the constants are found once for each)."""
    k = with_t_constants(forecasts.select("nu").distinct().filter("nu IS NOT NULL").repartition(tasks(forecasts)), "nu", confidence, "__q", "__e")
    d = forecasts.join(k, "nu")
    return d.withColumns({"var": -F.col("__q") * F.sqrt("variance"), "es": -F.col("__e") * F.sqrt("variance")}).drop("__q", "__e")


# ---- DCC


def dcc_filter(z: np.ndarray, a: float, b: float, q_bar: np.ndarray) -> np.ndarray:
    """Correlation matrices before each row, and one beyond the last."""
    q, out = q_bar.copy(), np.empty((len(z) + 1, *q_bar.shape))
    for t in range(len(z) + 1):
        d = 1 / np.sqrt(np.diag(q))
        out[t] = q * d[:, None] * d[None, :]
        if t < len(z):
            q = (1 - a - b) * q_bar + a * np.outer(z[t], z[t]) + b * q
    return out


def dcc_fit(returns: np.ndarray) -> dict:
    """Two stages on a panel [date, asset]: GARCH by asset, then the two correlation parameters by quasi-likelihood."""
    fits = [fit(returns[:, k], student=False) for k in range(returns.shape[1])]
    s = np.column_stack([variances(returns[:, k] ** 2, f["omega"], f["alpha"], f["beta"], float(np.var(returns[:, k], ddof=1))) for k, f in enumerate(fits)])
    z = returns / np.sqrt(s[:-1])
    q_bar = np.corrcoef(z, rowvar=False)

    def loss(x: np.ndarray) -> float:
        total, share = 0.9999 * sigmoid(x[0]), sigmoid(x[1])
        r = dcc_filter(z, total * share, total * (1 - share), q_bar)[:-1]
        sign, logdet = np.linalg.slogdet(r)
        if np.any(sign <= 0):
            return 1e12
        return float(0.5 * np.sum(logdet + np.einsum("ti,tij,tj->t", z, np.linalg.inv(r), z)))

    x, value, ok = nelder_mead(loss, np.array([math.log(0.97 / 0.0299), math.log(0.02 / 0.95)]), rounds=200, tol=1e-8)
    total, share = 0.9999 * sigmoid(x[0]), sigmoid(x[1])
    return {"a": total * share, "b": total * (1 - share), "loglik": -value, "converged": ok, "corr": dcc_filter(z, total * share, total * (1 - share), q_bar), "variance": s}


def dcc_path(panel: DataFrame, assets: list[str], date: str = "date", asset: str = "asset", ret: str = "ret", least: int = 250) -> DataFrame:
    """(date, asset_i, asset_j, rho, value) for i <= j: the correlation and covariance known before each date, by one fit on the whole
    panel. A panel is dates by a few assets; it is the unit of estimation and goes to one task."""
    if len(assets) < 2:
        raise ValueError("at least two assets")
    wide = panel.groupBy(date).pivot(asset, assets).agg(F.first(ret)).dropna()
    kind = dict(panel.dtypes)[date]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(date)
        if len(own) < least:
            return pd.DataFrame(columns=[date, "asset_i", "asset_j", "rho", "value", "a", "b"])
        f = dcc_fit(own[assets].to_numpy(dtype=float))
        rows = []
        for i, x in enumerate(assets):
            for j in range(i, len(assets)):
                rho = f["corr"][:-1, i, j]
                cov = rho * np.sqrt(f["variance"][:-1, i] * f["variance"][:-1, j])
                rows.append(pd.DataFrame({date: own[date].to_numpy(), "asset_i": x, "asset_j": assets[j], "rho": rho, "value": cov, "a": f["a"], "b": f["b"]}))
        return pd.concat(rows)

    return wide.withColumn("__panel", F.lit(1)).groupBy("__panel").applyInPandas(of, f"{date} {kind}, asset_i string, asset_j string, rho double, value double, a double, b double")


def dcc_scan(z: DataFrame, a: float, b: float, date: str = "date", asset: str = "asset", value: str = "z") -> DataFrame:
    """(date, asset_i, asset_j, rho) for i < j: the dynamic correlation known before each date, for given parameters. z has standardised
    returns on dates that all assets have.

    Q is a recursion for each pair of its own, with a constant coefficient, so it is an affine scan by pair and the panel is never one
    group; the pair's two diagonal elements run along.
    """
    if not (a >= 0 and b > 0 and a + b < 1):
        raise ValueError("a from 0, b above 0, their sum below 1")
    pairs = pair_products(z, date, asset, value, diagonal=False)
    keys = Series(("asset_i", "asset_j"), (date,))
    level = pairs.groupBy("asset_i", "asset_j").agg(F.corr("__ri", "__rj").alias("__bar"))
    d = pairs.join(level, ["asset_i", "asset_j"])
    first = keys.lag("x").isNull()
    moves = {"__qij": (F.col("__bar"), F.col("x")), "__qii": (F.lit(1.0), F.col("__ri") * F.col("__ri")), "__qjj": (F.lit(1.0), F.col("__rj") * F.col("__rj"))}
    d = d.withColumn("__first", first).withColumns({f"{n}_b": F.when(first, bar).otherwise((1 - a - b) * bar + a * keys.lag(x)) for n, (bar, x) in moves.items()})
    d = affine_scan(d, keys, F.lit(b), {n: F.col(f"{n}_b") for n in moves})
    return d.select(date, "asset_i", "asset_j", (F.col("__qij") / F.sqrt(F.col("__qii") * F.col("__qjj"))).alias("rho"))


# ---- simulation


def simulate_paths(rng: np.random.Generator, paths: int, horizon: int, omega: float, alpha: float, beta: float, start: float, draw) -> np.ndarray:
    """Sums of simulated returns [path] over the horizon."""
    s, total = np.full(paths, start), np.zeros(paths)
    for _ in range(horizon):
        r = np.sqrt(s) * draw(rng, paths)
        total += r
        s = omega + alpha * r * r + beta * s
    return total


def simulation_state(returns: np.ndarray, method: str) -> dict:
    """What a simulation starts from: the fitted recursion, the next variance, and the returns and their standardised residuals."""
    r = np.asarray(returns, dtype=float)
    r = r[np.isfinite(r)]
    if len(r) < 2 or not r.std() > 0:
        return {"omega": None, "alpha": None, "beta": None, "nu": None, "last": None, "r": [], "z": []}
    f = fit(r, student=method == "parametric")
    if f["omega"] is None:
        f = {"omega": float(np.var(r)), "alpha": 0.0, "beta": 0.0, "nu": 8.0}
    s = variances(r**2, f["omega"], f["alpha"], f["beta"], float(np.var(r, ddof=1)))
    z = r / np.sqrt(s[:-1])
    z = (z - z.mean()) / z.std()
    return {"omega": f["omega"], "alpha": f["alpha"], "beta": f["beta"], "nu": f["nu"] or 8.0, "last": float(s[-1]), "r": r.tolist(), "z": z.tolist()}


STATE = "omega double, alpha double, beta double, nu double, last double, r array<double>, z array<double>"


def monte_carlo_by(df: DataFrame, series: Series, ret: str, method: str | tuple[str, ...] = "fhs", horizons: tuple[int, ...] = (1, 5, 10), confidence: float = 0.99, paths: int = 20_000, seed: int = 42, blocks: int = 8, resamples: int = 200) -> DataFrame:
    """(keys, horizon, paths, var, es, stderr, low, high, sqrt_time, ratio_sqrt_time) of every series, as `monte_carlo_var`; with a tuple of
    methods, all of them, and a column `method`. Each series is fitted in its own group; then (series, method, block) are rows and
    run in parallel. Series draw with equal seeds, so a series' figures don't depend on which others there are. A series of fewer
    than two returns, or a constant one, has 0 paths and null figures."""
    methods = (method,) if isinstance(method, str) else method
    for m in methods:
        check_method(m)
    keys, kinds = list(series.keys), dict(df.dtypes)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(list(series.order))
        return pd.DataFrame([{k: own[k].iloc[0] for k in keys} | {"method": m} | simulation_state(own[ret].to_numpy(), m) for m in methods])

    states = df.select(*keys, *series.order, ret).groupBy(*keys).applyInPandas(of, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "method string", STATE]))
    d = simulate(states, [*keys, "method"], horizons, confidence, paths, seed, blocks, resamples)
    return d.drop("method") if isinstance(method, str) else d


def check_method(method: str) -> None:
    if method not in ("fhs", "parametric", "bootstrap"):
        raise ValueError("method is fhs, parametric or bootstrap")


def simulate(states: DataFrame, keys: list[str], horizons: tuple[int, ...], confidence: float, paths: int, seed: int, blocks: int, resamples: int) -> DataFrame:
    """Risk by key and horizon of simulation states, one row each with its method. Paths are simulated in blocks, each with a seed of its
    own, so the result doesn't depend on where a block runs; they are written once for quantiles, tails and resamples."""
    each, kinds = -(-paths // blocks), dict(states.dtypes)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.to_dict("records"):
                r, z, nu, method = np.asarray(x["r"], dtype=float), np.asarray(x["z"], dtype=float), x["nu"], x["method"]

                def draw(rng: np.random.Generator, n: int, z=z, nu=nu, method=method) -> np.ndarray:
                    return rng.choice(z, n) if method == "fhs" else rng.standard_t(nu, n) * math.sqrt((nu - 2) / nu)

                for h in horizons:
                    rng = np.random.default_rng([seed, int(x["block"]), h])
                    if not len(r):
                        total = np.full(each, np.nan)
                    elif method == "bootstrap":
                        total = rng.choice(r, (each, h)).sum(axis=1)
                    else:
                        total = simulate_paths(rng, each, h, x["omega"], x["alpha"], x["beta"], x["last"], draw)
                    yield pd.DataFrame({k: x[k] for k in keys} | {"horizon": h, "path": np.arange(each) + x["block"] * each, "ret": total})

    work = states.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(*keys, "block")
    sims = work.mapInPandas(of, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "horizon int, path long, ret double"]))
    sims = staged(sims.filter(F.col("path") < paths).withColumn("ret", F.when(~F.isnan("ret"), F.col("ret"))), "paths")
    by = [*keys, "horizon"]
    every = sims.select(*by).distinct()
    errors = every.join(quantile_errors(sims, by, "ret", 1 - confidence, paths, resamples, seed), by, "left")
    return risk_terms(errors.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), keys)


def monte_carlo_var(spark: SparkSession, returns: np.ndarray, method: str = "fhs", horizons: tuple[int, ...] = (1, 5, 10), confidence: float = 0.99, paths: int = 20_000, seed: int = 42, blocks: int = 8, resamples: int = 200) -> DataFrame:
    """(horizon, paths, var, es, stderr, low, high, sqrt_time, ratio_sqrt_time) of one series: simulated losses by filtered historical
    simulation, parametric t, or bootstrap of raw returns."""
    check_method(method)
    state = spark.createDataFrame([(method, *simulation_state(returns, method).values())], "method string, " + STATE)
    return simulate(state, ["method"], horizons, confidence, paths, seed, blocks, resamples).drop("method")


def null_bars(seed: list[int], bars: int, regime: str, sigma: float, alpha: float, beta: float, steps: int, start_price: float) -> pd.DataFrame:
    """One path of driftless bars."""
    rng = np.random.default_rng(seed)
    shocks = rng.standard_normal((bars, steps)) / math.sqrt(steps)
    s = np.full(bars, sigma)
    if regime == "garch":
        v, omega = sigma**2, sigma**2 * (1 - alpha - beta)
        for t in range(bars):
            s[t] = math.sqrt(v)
            v = omega + alpha * (s[t] * shocks[t].sum()) ** 2 + beta * v
    path = np.cumsum((shocks * s[:, None] - (s[:, None] ** 2) / (2 * steps)).ravel()).reshape(bars, steps)
    before = np.concatenate([[0.0], path[:-1, -1]])
    whole = np.column_stack([before, path])
    return pd.DataFrame({"bar": np.arange(bars), "open": start_price * np.exp(before), "high": start_price * np.exp(whole.max(axis=1)), "low": start_price * np.exp(whole.min(axis=1)), "close": start_price * np.exp(path[:, -1])})


def null_paths(spark: SparkSession, seeds: list[int], bars: int, regime: str = "garch", sigma: float = 3e-4, alpha: float = 0.08, beta: float = 0.90, steps: int = 10, start_price: float = 100.0) -> DataFrame:
    """Driftless OHLC bars (seed, bar, open, high, low, close) from `steps` steps each, of constant or GARCH variance; one row of
    work per seed, equal for equal seeds."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seed in b["seed"]:
                yield null_bars([7, int(seed)], bars, regime, sigma, alpha, beta, steps, start_price).assign(seed=seed)[["seed", "bar", "open", "high", "low", "close"]]

    rows = spark.createDataFrame([(int(x),) for x in seeds], "seed long").repartition(len(seeds), "seed")
    return rows.mapInPandas(of, "seed long, bar long, open double, high double, low double, close double")


def null_paths_like(bars: DataFrame, series: Series, paths: int = 4, close: str = "close", regime: str = "garch", alpha: float = 0.08, beta: float = 0.90, steps: int = 10) -> DataFrame:
    """Driftless bars (symbol, path, bar, open, high, low, close) as many as each series has, of its own volatility and from its first close: what a
    study of the series would find where there is nothing. The series has one key."""
    (key,) = series.keys
    kind = dict(bars.dtypes)[key]
    d = bars.withColumn("__r", F.ln(F.col(close) / series.lag(close)))
    known = d.groupBy(key).agg(F.count(F.lit(1)).alias("bars"), F.stddev_samp("__r").alias("sigma"), F.min_by(close, series.order[0]).alias("first")).filter("sigma > 0")
    work = known.withColumns({"path": F.explode(F.sequence(F.lit(0), F.lit(paths - 1))), "of": F.crc32(F.col(key).cast("string"))}).repartition(tasks(bars), key, "path")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.to_dict("records"):
                made = null_bars([7, int(x["of"]), int(x["path"])], int(x["bars"]), regime, x["sigma"], alpha, beta, steps, x["first"])
                yield made.assign(**{key: x[key], "path": x["path"]})[[key, "path", "bar", "open", "high", "low", "close"]]

    return work.mapInPandas(of, f"{key} {kind}, path int, bar long, open double, high double, low double, close double")


def demo_panel(spark: SparkSession, days: int = 3000, assets: int = 3, seed: int = 1) -> DataFrame:
    """(day, asset, ret): a common t(6) GARCH factor times 0.7 and noise of 0.4 % each."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["id"]:
                rng = np.random.default_rng([seed, int(s)])
                v, f = 1e-4, np.empty(days)
                for t in range(days):
                    f[t] = math.sqrt(v) * rng.standard_t(6) * math.sqrt(4 / 6)
                    v = 2e-6 + 0.08 * f[t] ** 2 + 0.90 * v
                for k in range(assets):
                    yield pd.DataFrame({"day": np.arange(days), "asset": f"asset{k}", "ret": 0.7 * f + rng.normal(0, 0.004, days)})

    return spark.range(1).mapInPandas(of, "day long, asset string, ret double")


def rolling_dcc(panel: DataFrame, assets: list[str], window: int = 750, refit: int = 126, least: int = 400, date: str = "date", asset: str = "asset", ret: str = "ret") -> DataFrame:
    """Walk-forward DCC: (date, asset_i, asset_j, value) for i <= j, each covariance known before its date.

    Refit points are rows with their window of panel rows, fitted in parallel. A segment starts from its own fit alone: the
    correlation after the window stands in for Q, and is advanced from there. Row numbers run over the panel's dates, which
    are few beside any table of ticks.
    """
    from pyspark.sql.window import Window

    wide = panel.groupBy(date).pivot(asset, assets).agg(F.first(ret)).dropna()
    kind = dict(panel.dtypes)[date]
    over = Window.partitionBy("__panel").orderBy(date)
    rows = wide.select(date, F.lit(1).alias("__panel"), F.array(*[F.col(f"`{a}`") for a in assets]).alias("r")).withColumn("__i", F.row_number().over(over))
    held = F.collect_list(F.struct(F.col("__i").alias("i"), F.col(date).alias("at"), "r")).over(over.rowsBetween(-window, refit - 1))
    points = rows.withColumn("__w", held).filter((F.col("__i") > least) & ((F.col("__i") - 1 - least) % refit == 0)).select(F.col("__i").alias("first"), "__w")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for first, cells in zip(b["first"], b["__w"], strict=True):
                past = np.array([list(c["r"]) for c in cells if c["i"] < first], dtype=float)[-window:]
                f = dcc_fit(past)
                params = [fit(past[:, k], student=False) for k in range(len(assets))]
                z = past[-1] / np.sqrt(f["variance"][-2])
                q_bar = np.corrcoef(past / np.sqrt(f["variance"][:-1]), rowvar=False)
                q, s = f["corr"][-2], f["variance"][-1].copy()
                q = (1 - f["a"] - f["b"]) * q_bar + f["a"] * np.outer(z, z) + f["b"] * q
                for c in cells:
                    if c["i"] < first:
                        continue
                    d = 1 / np.sqrt(np.diag(q))
                    h = q * d[:, None] * d[None, :] * np.sqrt(s)[:, None] * np.sqrt(s)[None, :]
                    out += [(c["at"], assets[i], assets[j], float(h[i, j])) for i in range(len(assets)) for j in range(i, len(assets))]
                    r = np.array(list(c["r"]), dtype=float)
                    z = r / np.sqrt(s)
                    q = (1 - f["a"] - f["b"]) * q_bar + f["a"] * np.outer(z, z) + f["b"] * q
                    s = np.array([p["omega"] + p["alpha"] * x * x + p["beta"] * v for p, x, v in zip(params, r, s, strict=True)])
            yield pd.DataFrame(out, columns=[date, "asset_i", "asset_j", "value"])

    return points.repartition("first").mapInPandas(of, f"{date} {kind}, asset_i string, asset_j string, value double")


def dcc_var_series(cov: DataFrame, weights: DataFrame, confidence: float = 0.99, nu: float | None = 8.0, date: str = "date") -> DataFrame:
    """Portfolio VaR and ES on each date of a covariance path, with a scaled t of nu degrees (normal for None). A nu fitted on the
    whole sample would look ahead; give one of the past."""
    from tessella.operators.risk import portfolio_var

    return portfolio_var(cov, weights, confidence, nu, extra=(date,))


def compare_methods(df: DataFrame, series: Series, ret: str, **options) -> DataFrame:
    """The three simulation methods of every series in one table."""
    return monte_carlo_by(df, series, ret, ("fhs", "parametric", "bootstrap"), **options)
