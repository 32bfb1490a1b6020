"""Streams: bars from ticks with a watermark, session bars, and a keyed EWMA state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.bars import ticks_to_bars


def stream_bars(ticks: DataFrame, freq: str, lateness: str, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", **options) -> DataFrame:
    """Bars of a stream of ticks. A bar is final once the watermark passes its end; ticks later than `lateness` are dropped."""
    return ticks_to_bars(ticks.withWatermark(ts, lateness), freq, keys, ts, **options)


def session_bars(ticks: DataFrame, lateness: str, cut_hour: int = 17, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", price: str = "mid", tie: str = "tick_id") -> DataFrame:
    """Daily bars of sessions that begin at cut_hour of the stamps' own clock (a fixed offset)."""
    p, at = F.col(price), F.struct(ts, tie)
    w = F.window(ts, "1 day", "1 day", f"{cut_hour} hours")
    b = ticks.withWatermark(ts, lateness).groupBy(*keys, w.alias("__w")).agg(F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.count(p).alias("volume"))
    return b.select(*keys, F.col("__w.start").alias("session_start"), "open", "high", "low", "close", "volume")


def stream_ewma(returns: DataFrame, lam: float = 0.94, key: str = "symbol", ts: str = "ts", ret: str = "ret") -> DataFrame:
    """(key, ts, variance) of a stream of returns: the state per key is one number. Rows of one micro-batch are taken in the order of
    their stamps; the first return of a key starts the state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(ts)
        out = []
        for at, r in zip(rows[ts], rows[ret], strict=True):
            out.append((k[0], at, v))
            if r is not None and r == r:
                v = r * r if v is None else lam * v + (1 - lam) * r * r
        state.update((v,))
        yield pd.DataFrame(out, columns=[key, ts, "variance"])

    kinds = dict(returns.dtypes)
    return returns.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ts} {kinds[ts]}, variance double", "v double", "append", GroupStateTimeout.NoTimeout)
