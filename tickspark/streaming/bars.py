"""Bars of a live stream of trades, each emitted once, when the watermark has passed it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickspark.functions.scalars import trade_measures
from tickspark.operators.bars import AMOUNTS, _first_second_order, _measures, _order


def stream_bars(trades: DataFrame, timeframe_s: int, watermark: str = "10 minutes") -> DataFrame:
    """(symbol, timestamp_s, OHLC, amounts) of tumbling windows; trades later than the watermark are dropped."""
    rows = trade_measures(trades).withColumn("o", _order()).withColumn("at", F.timestamp_millis("timestamp"))
    grouped = rows.withWatermark("at", watermark).groupBy("symbol", F.window("at", f"{timeframe_s} seconds").alias("w")).agg(*_measures())
    return grouped.withColumn("timestamp_s", F.unix_seconds("w.start")).drop("w")


FILLED = "symbol string, timestamp_s long, open double, high double, low double, close double, trade_count long, " + ", ".join(f"{c} double" for c in AMOUNTS[1:])


class FilledBars(StatefulProcessor):
    """Carries a symbol's last close and the time of its next bar; a timer at that bar's end emits it empty if no trades came."""

    def __init__(self, timeframe_s: int, start_s: int):
        self.timeframe_s, self.start_s = timeframe_s, start_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "next_s long, close double")

    def empty(self, symbol: str, first_s: int, end_s: int, close: float) -> pd.DataFrame:
        """Bars without trades that start in [first_s, end_s)."""
        at = np.arange(first_s, end_s, self.timeframe_s)
        same = dict.fromkeys(("open", "high", "low", "close"), close) | {"trade_count": 0} | dict.fromkeys(AMOUNTS[1:], 0.0)
        return pd.DataFrame({"symbol": symbol, "timestamp_s": at, **same}, index=range(len(at)))

    def settle(self, symbol: str, next_s: int, close: float, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Empty bars that the watermark has passed, and the timer of the next one."""
        ended = max(next_s, next_s + (watermark_ms // 1000 - next_s) // self.timeframe_s * self.timeframe_s)
        yield self.empty(symbol, next_s, ended, close)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.carried.update((int(ended), float(close)))
        self.handle.registerTimer(int(ended + self.timeframe_s) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("timestamp_s", ignore_index=True)
        held = self.carried.get()
        next_s, close = held if held else (self.start_s, bars["first_s_close"][0])
        bars["carry"] = bars["close"].shift(1).fillna(close)
        late = bars["first_s"] > bars["timestamp_s"]
        bars["open"] = bars["open"].where(~late, bars["carry"])
        bars["high"] = bars["high"].where(~late, bars[["high", "carry"]].max(axis=1))
        bars["low"] = bars["low"].where(~late, bars[["low", "carry"]].min(axis=1))
        for at, carry in zip(bars["timestamp_s"], bars["carry"], strict=True):
            if at > next_s:
                yield self.empty(key[0], next_s, at, carry)
            next_s = at + self.timeframe_s
        yield bars[["symbol", "timestamp_s", "open", "high", "low", "close", *AMOUNTS]]
        yield from self.settle(key[0], next_s, bars["close"].iloc[-1], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        next_s, close = self.carried.get()
        yield from self.settle(key[0], next_s, close, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_filled_bars(trades: DataFrame, timeframe_s: int, start_ms: int, watermark: str = "10 minutes") -> DataFrame:
    """bars.build_bars() of a live stream: every bar from start_ms on of each symbol that has traded, emitted once, when the watermark has passed its end.

    Trades are summed to bars first, in partial sums before the shuffle, so the state that carries a symbol's close sees a row for each bar and no
    trade. Empty bars come from timers, also while a symbol is silent and others trade. Trades before start_ms, of bars that
    have ended by the watermark, or without a time are dropped. Needs the RocksDB state store, which is set here for the session's queries to come.
    """
    trades.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start_s = start_ms // 1000
    rows = trade_measures(trades.where(F.col("timestamp") >= start_ms)).withColumn("second_s", F.floor(F.col("timestamp") / 1000))
    rows = rows.withColumns({"o": _order(), "p": _first_second_order(), "at": F.timestamp_millis("timestamp")})
    w = F.window("at", f"{timeframe_s} seconds", startTime=f"{start_s % timeframe_s} seconds").alias("w")
    grouped = rows.withWatermark("at", watermark).groupBy("symbol", w).agg(*_measures(), F.min("second_s").alias("first_s"), F.max_by("price", "p").alias("first_s_close"))
    bars = grouped.withColumn("timestamp_s", F.unix_seconds("w.start")).withColumn("ends", F.window_time("w")).drop("w")
    return bars.groupBy("symbol").transformWithStateInPandas(statefulProcessor=FilledBars(timeframe_s, start_s), outputStructType=FILLED, outputMode="Append", timeMode="EventTime")
