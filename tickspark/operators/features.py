"""Window features of bars. Names in _5s and the like count bars, not seconds, where bars are longer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickspark.functions.scalars import EPS, range_filter
from tickspark.operators.bars import CHUNK, bar_ratios, build_bars, in_chunks, last_known
from tickspark.sources.files import require_rows

#: The columns of a feature table, in order, and those of kline context.
FEATURES = [
    "timestamp", "timestamp_ms", "timestamp_s", "timeframe_s", "open", "high", "low", "close", "vwap_1s", "trade_count_1s", "trade_count_5s", "volume_1s", "notional_volume_1s", "notional_volume_5s",
    "buy_volume_1s", "sell_volume_1s", "signed_volume_1s", "signed_volume_5s", "trade_imbalance_1s", "buy_sell_ratio_1s", "avg_trade_size_1s", "avg_trade_size_5s", "max_trade_size_1s", "price_range_1s",
    "ret_1s", "ret_3s", "ret_5s", "ret_10s", "volatility_10s", "volatility_30s", "volume_zscore_30s",
]
CONTEXT = ["dist_from_1m_open", "dist_from_1m_high", "dist_from_1m_low", "dist_from_1m_close"]


#: Earlier bars that the features of a bar look at.
REACH = 30


def _w(rows: DataFrame) -> WindowSpec:
    """Time order per symbol, or per chunk of a symbol where rows are dealt out in chunks."""
    return W.partitionBy("symbol", *(["chunk"] if "chunk" in rows.columns else [])).orderBy("timestamp_s")


def _last(rows: DataFrame, n: int) -> WindowSpec:
    return _w(rows).rowsBetween(-(n - 1), 0)


def log_returns(bars: DataFrame, lags: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """bars with ret_{k}s, the log return over k bars; 0 without such a bar."""
    log = lambda c: F.ln(F.greatest(c, F.lit(EPS)))
    before = lambda k: F.lag("close", k).over(_w(bars))  # noqa: E731  greatest() passes over nulls, so they are asked for
    return bars.withColumns({f"ret_{k}s": F.when(before(k).isNull(), 0.0).otherwise(log(F.col("close")) - log(before(k))) for k in lags})


def rolling_sums(bars: DataFrame, n: int = 5) -> DataFrame:
    return bars.withColumns({f"{c}_{n}s": F.sum(c).over(_last(bars, n)) for c in ("trade_count", "signed_volume", "notional_volume")})


def rolling_mean(bars: DataFrame, n: int = 5) -> DataFrame:
    return bars.withColumn(f"avg_trade_size_{n}s", F.avg("avg_trade_size").over(_last(bars, n)))


def rolling_volatility(bars: DataFrame, sizes: tuple[int, ...] = (10, 30)) -> DataFrame:
    """bars with the sample deviation of 1-bar returns; 0 below two of them."""
    return bars.withColumns({f"volatility_{n}s": F.coalesce(F.stddev_samp("ret_1s").over(_last(bars, n)), F.lit(0.0)) for n in sizes})


def rolling_zscore(bars: DataFrame, n: int = 30, least: int = 5) -> DataFrame:
    """bars with the notional's z-score among the last n bars; 0 below `least` of them, or where all are equal."""
    x, w = F.col("notional_volume"), _last(bars, n)
    even = F.max(x).over(w) == F.min(x).over(w)
    return bars.withColumn(f"volume_zscore_{n}s", F.when((F.count(x).over(w) < least) | even, 0.0).otherwise((x - F.avg(x).over(w)) / F.stddev_pop(x).over(w)))


def dedupe_klines(klines: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each symbol and open_time: the last in the file's order."""
    w = W.partitionBy("symbol", "open_time").orderBy(F.col(order).desc())
    return klines.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def join_kline_context(bars: DataFrame, klines: DataFrame, chunked: bool = False) -> DataFrame:
    """bars with the kline of the minute in which each starts; on a miss that of the bar before; before any hit the first kline.

    The first kline of a symbol is one row, joined by symbol; the minutes join by (symbol, minute), so no symbol is one task there.
    """
    k = klines.select("symbol", F.col("open_time").alias("minute_ms"), F.struct("open", "high", "low", "close").alias("k"))
    prices = ("open", "high", "low", "close")
    first = klines.groupBy("symbol").agg(*[F.min_by(c, "open_time").alias(f"{c}0") for c in prices])  # of numbers, so it stays a hash aggregate
    first = first.select("symbol", F.struct(*[F.col(f"{c}0").alias(c) for c in prices]).alias("k0"))
    rows = bars.withColumn("minute_ms", F.floor(F.col("timestamp_s") / 60) * 60000).join(k, ["symbol", "minute_ms"], "left").join(first, "symbol", "left")
    return last_known(rows, "k", "kline", chunked, with_own=True).withColumn("kline", F.coalesce("kline", "k0")).drop("k", "k0", "minute_ms")


def kline_distances(rows: DataFrame) -> DataFrame:
    part = lambda c: F.col(f"kline.{c}")
    return rows.withColumns({f"dist_from_1m_{c}": (F.col("close") - part(c)) / F.greatest(part(c), F.lit(EPS)) for c in ("open", "high", "low", "close")}).drop("kline")


def bar_times(rows: DataFrame, timeframe_s: int) -> DataFrame:
    iso: Column = F.concat(F.date_format(F.timestamp_seconds("timestamp_s"), "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    return rows.withColumns({"timestamp": iso, "timestamp_ms": F.col("timestamp_s") * 1000, "timeframe_s": F.lit(timeframe_s).cast("long")})


def window_features(bars: DataFrame) -> DataFrame:
    """All features of filled bars; every window has the same partitioning and order, so there is one exchange."""
    rows = rolling_zscore(rolling_mean(rolling_sums(log_returns(bar_ratios(bars)))))
    return rolling_volatility(rows)


def build_features(trades: DataFrame, klines: DataFrame | None, timeframe_s: int, start_ms: int, end_ms: int, chunk: int = CHUNK, unique: bool = False, strict: bool = False) -> DataFrame:
    """The feature table of [start_ms, end_ms), with kline context if klines are given. Histories of over `chunk` bars are dealt out in chunks.

    `unique` is that of build_bars(). With `strict`, no trade or no kline in range is an error at once; else the result is empty.
    """
    if strict:
        require_rows(range_filter(trades, start_ms, end_ms), "trades")
    rows = build_bars(trades, timeframe_s, start_ms, end_ms, chunk, unique)
    chunked = (end_ms - start_ms) > chunk * timeframe_s * 1000
    if klines is not None:
        low, high = start_ms // 60000 * 60000, -(-end_ms // 60000) * 60000
        known = dedupe_klines(klines).where((F.col("open_time") >= low) & (F.col("open_time") < high))
        if strict:
            require_rows(known, "klines")
        rows = in_chunks(rows, start_ms, timeframe_s, chunk).drop("own") if chunked else rows
        rows = kline_distances(join_kline_context(rows, known, chunked)).drop("chunk")
    rows = window_features(in_chunks(rows, start_ms, timeframe_s, chunk, before=REACH) if chunked else rows)
    rows = finished(rows.where("own") if chunked else rows, timeframe_s)
    return rows.select("symbol", *FEATURES, *(CONTEXT if klines is not None else []))


def finished(rows: DataFrame, timeframe_s: int) -> DataFrame:
    """window_features() with times and the names of a feature table."""
    plain = {f"{c}_1s": F.col(c).cast("double") for c in ("vwap", "trade_count", "volume", "notional_volume", "buy_volume", "sell_volume", "signed_volume", "trade_imbalance", "buy_sell_ratio", "avg_trade_size", "max_trade_size", "price_range")}
    return bar_times(rows, timeframe_s).withColumns(plain | {"trade_count_5s": F.col("trade_count_5s").cast("double")})
