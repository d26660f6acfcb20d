"""Scalar columns: flags, time frames, times, trade measures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 1e-12
DAY_MS = 86_400_000
#: Seconds of each unit of a time frame.
UNITS = {"s": 1, "m": 60, "h": 3600}
#: The texts that ingest takes for a flag.
TRUE_TEXTS, FALSE_TEXTS = ("true", "1", "t", "y", "yes"), ("false", "0", "f", "n", "no")


def parse_flag(c: Column) -> Column:
    """Boolean of a flag's text, trimmed, in any case; null for other texts."""
    text = F.lower(F.trim(c))
    return F.when(text.isin(*TRUE_TEXTS), F.lit(True)).when(text.isin(*FALSE_TEXTS), F.lit(False))


def parse_flag_lenient(c: Column) -> Column:
    """True for `true` and `1`, false for all else, null included."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1"), F.lit(False))


def whole_number(c: Column) -> Column:
    """BIGINT of a text; a fraction is cut off, and what is no finite number is null."""
    as_double = c.try_cast("double")
    finite = F.when(F.abs(as_double) < 9.2e18, as_double)
    return F.coalesce(c.try_cast("bigint"), finite.cast("bigint"))


def parse_timeframe(text: str) -> int:
    """Seconds of `5m`, `1h`, `30s`."""
    if not (m := re.fullmatch(r"([0-9]+)([smh])", text.strip().lower())) or not int(m[1]):
        raise ValueError(f"no time frame: {text!r}")
    return int(m[1]) * UNITS[m[2]]


def timeframe_seconds(c: Column) -> Column:
    """The same of a column; null for what is no time frame."""
    text = F.lower(F.trim(c))
    number = F.regexp_extract(text, "^([0-9]+)[smh]$", 1).try_cast("bigint")
    unit = F.element_at(F.create_map(*[F.lit(x) for u, n in UNITS.items() for x in (u, n)]), F.right(text, F.lit(1)))
    return F.when(number > 0, number * unit)


def day_of(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def time_keys(df: DataFrame, ms: str = "timestamp") -> DataFrame:
    """df with second_s, minute_ms, day, iso (UTC, with offset) and stamp of epoch milliseconds."""
    at = F.timestamp_millis(F.col(ms))
    return df.withColumns({
        "second_s": F.floor(F.col(ms) / 1000),
        "minute_ms": F.floor(F.col(ms) / 60000) * 60000,
        "day": F.to_date(at),
        "iso": F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")),
        "stamp": F.date_format(at, "yyyyMMdd_HHmmss"),
    })


def range_filter(df: DataFrame, start_ms: int, end_ms: int, ms: str = "timestamp") -> DataFrame:
    """Rows in [start_ms, end_ms); as it stands, the predicate reaches the scan."""
    return df.where((F.col(ms) >= start_ms) & (F.col(ms) < end_ms))


def day_spine(spark: SparkSession, start_ms: int, end_ms: int) -> DataFrame:
    """Each UTC day that [start_ms, end_ms) touches."""
    first, last = start_ms // DAY_MS, (end_ms - 1) // DAY_MS
    return spark.range(first, last + 1).select(F.date_from_unix_date(F.col("id").cast("int")).alias("day"))


def trade_measures(trades: DataFrame) -> DataFrame:
    """trades with notional, and volume and notional by side; a maker who buys is hit by a seller."""
    notional = F.col("price") * F.col("quantity")
    sells = F.col("buyer_is_maker")
    side = lambda on, x: F.when(on, x).otherwise(0.0)
    return trades.withColumns({"notional": notional, "buy_volume": side(~sells, F.col("quantity")), "sell_volume": side(sells, F.col("quantity")), "buy_notional": side(~sells, notional), "sell_notional": side(sells, notional)})
