"""Bars: grouped trades on a dense spine, gaps filled from the last price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickspark.functions.scalars import DAY_MS, EPS, range_filter, trade_measures
from tickspark.sources.scratch import written

#: Sums of trade_measures() and the names they get in bars.
SUMS = {"quantity": "volume", "buy_volume": "buy_volume", "sell_volume": "sell_volume", "notional": "notional_volume", "buy_notional": "buy_notional", "sell_notional": "sell_notional"}
AMOUNTS = ["trade_count", *SUMS.values(), "max_trade_size"]


def _order() -> Column:
    """Time, then id, as one DECIMAL: min_by and max_by on it keep hash aggregation."""
    return F.expr("cast(cast(timestamp as decimal(18,0)) * 10000000000000000000BD + agg_trade_id as decimal(38,0))")


def _first_second_order() -> Column:
    """Largest for the last trade of the first second."""
    return F.expr("cast(cast(99999999999 - second_s as decimal(11,0)) * 10000000000000000000000BD + cast(timestamp % 1000 as decimal(3,0)) * 10000000000000000000BD + agg_trade_id as decimal(38,0))")


def _measures() -> list[Column]:
    price = F.col("price")
    return [
        F.min_by(price, "o").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "o").alias("close"), F.count("*").alias("trade_count"),
        *[F.sum(c).alias(n) for c, n in SUMS.items()], F.max("quantity").alias("max_trade_size"),
    ]


def second_aggregates(trades: DataFrame) -> DataFrame:
    """(symbol, second_s) with OHLC by time and id, and amounts."""
    rows = trade_measures(trades).withColumn("second_s", F.floor(F.col("timestamp") / 1000)).withColumn("o", _order())
    return rows.groupBy("symbol", "second_s").agg(*_measures())


def merge_partials(parts: DataFrame, *keys: str, order: str = "part") -> DataFrame:
    """One row for each key from partial aggregates, open from the first and close from the last part."""
    return parts.groupBy(*keys).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        *[F.sum(c).alias(c) for c in AMOUNTS[:-1]], F.max("max_trade_size").alias("max_trade_size"),
    )


def rollup_bars(bars: DataFrame, timeframe_s: int, start_ms: int) -> DataFrame:
    """Coarser bars from filled ones, anchored at the range's start."""
    start_s = start_ms // 1000
    step = F.floor((F.col("timestamp_s") - start_s) / timeframe_s)
    return merge_partials(bars.withColumn("timestamp_s_new", start_s + step * timeframe_s), "symbol", "timestamp_s_new", order="timestamp_s").withColumnRenamed("timestamp_s_new", "timestamp_s")


def bar_spine(symbols: DataFrame, start_ms: int, end_ms: int, timeframe_s: int) -> DataFrame:
    """(symbol, timestamp_s) of every bar of [start_ms, end_ms), anchored at its start; the last may be short."""
    start_s, end_s = start_ms // 1000, -(-end_ms // 1000)
    return symbols.select("symbol", F.explode(F.expr(f"sequence({start_s}L, {end_s - 1}L, {timeframe_s}L)")).alias("timestamp_s"))


def unique_trades(trades: DataFrame) -> DataFrame:
    """One trade for each symbol and id, as files may overlap: the latest by time, of equal times the dearest, then the largest, then the maker's. Only the columns that bars need stay.

    The winner is one whole row, the largest of its struct. Trades are dealt by symbol and id first, as nearly all of them differ and summing before the shuffle would save nothing.
    """
    columns = ["timestamp", "price", "quantity", "buyer_is_maker"]
    rows = trades.select("symbol", "agg_trade_id", *columns).repartition("symbol", "agg_trade_id")
    return rows.groupBy("symbol", "agg_trade_id").agg(F.max(F.struct(*columns)).alias("t")).select("symbol", "agg_trade_id", "t.*")


def traded_bars(trades: DataFrame, timeframe_s: int, start_ms: int, end_ms: int) -> DataFrame:
    """Bars that have trades, with first_s (their first second) and first_s_close (its last price): one shuffle of partial sums keyed by symbol and bar."""
    start_s = start_ms // 1000
    rows = trade_measures(range_filter(trades, start_ms, end_ms)).withColumn("second_s", F.floor(F.col("timestamp") / 1000))
    rows = rows.withColumn("timestamp_s", F.lit(start_s) + F.floor((F.col("second_s") - start_s) / timeframe_s) * timeframe_s)
    rows = rows.withColumn("o", _order()).withColumn("p", _first_second_order())
    return rows.groupBy("symbol", "timestamp_s").agg(*_measures(), F.min("second_s").alias("first_s"), F.max_by("price", "p").alias("first_s_close"))


#: Bars of a symbol that one task's window holds at most; longer histories are dealt out in chunks of so many.
CHUNK = 50_000


def in_chunks(rows: DataFrame, start_ms: int, timeframe_s: int, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """rows with chunk and own: each row in its chunk (own), and copies of the `before` rows before and the `after` rows after a chunk in it."""
    i = F.floor((F.col("timestamp_s") - start_ms // 1000) / timeframe_s)
    c = F.floor(i / size)
    reach = F.sequence(F.greatest(F.floor((i - after) / size), F.lit(0)), F.floor((i + before) / size))  # more than the neighbours where a halo is longer than a chunk
    return rows.withColumn("chunk", F.explode(reach) if before or after else c).withColumn("own", F.col("chunk") == c)


def numbered(rows: DataFrame, time: str = "timestamp_ms", span_ms: int = DAY_MS) -> DataFrame:
    """rows with i, their place in their symbol's time order from 0, and n, the symbol's rows.

    Rows are counted and ranked in spans of time, and a small table of the spans' counts gives what lies before each,
    so no symbol is one task.
    """
    rows = rows.withColumn("span", F.floor(F.col(time) / span_ms))
    counts = rows.groupBy("symbol", "span").agg(F.count("*").alias("here"))
    w = W.partitionBy("symbol")
    before = F.sum("here").over(w.orderBy("span").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("symbol", "span", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(w).alias("n"))
    rank = F.row_number().over(W.partitionBy("symbol", "span").orderBy(time))
    return rows.join(counts, ["symbol", "span"]).withColumn("i", F.col("before") + rank - 1).drop("span", "before")


def dealt(rows: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """numbered() rows with chunk and own, as in_chunks() gives them of dense bars: chunks of `size` rows with a halo."""
    i, c = F.col("i"), F.floor(F.col("i") / size)
    reach = F.sequence(F.greatest(F.floor((i - after) / size), F.lit(0)), F.floor((i + before) / size))
    last = F.floor((F.col("n") - 1) / size)
    return rows.withColumn("chunk", F.explode(F.filter(reach, lambda x: x <= last))).withColumn("own", F.col("chunk") == c)


def last_known(rows: DataFrame, value: str, out: str, chunked: bool, with_own: bool = False) -> DataFrame:
    """rows with out: the last known value before each row (with_own: or its own), per symbol in time order.

    With chunks, a row looks back inside its chunk, and then at a table with one row for each chunk.
    """
    end = 0 if with_own else -1
    if not chunked:
        return rows.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy("symbol").orderBy("timestamp_s").rowsBetween(W.unboundedPreceding, end)))
    ends = rows.groupBy("symbol", "chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("timestamp_s"))).alias("end"))
    earlier = W.partitionBy("symbol").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("symbol", "chunk", F.last("end", ignorenulls=True).over(earlier).alias("end_before"))
    w = W.partitionBy("symbol", "chunk").orderBy("timestamp_s").rowsBetween(W.unboundedPreceding, end)
    return rows.join(ends, ["symbol", "chunk"]).withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("end_before"))).drop("end_before")


def fill_bars(spine: DataFrame, bars: DataFrame, chunked: bool = False) -> DataFrame:
    """Every bar of the spine. A bar opens at the last close before it if no trade falls into its first second.

    Before a symbol's first trade, the close of the first traded second stands in. A chunked spine has a column chunk, which stays.
    """
    rows = last_known(spine.join(bars, ["symbol", "timestamp_s"], "left"), "close", "carry", chunked)
    if chunked:
        first = bars.groupBy("symbol").agg(F.min_by("first_s_close", "timestamp_s").alias("start_close"))
        rows = rows.join(first, "symbol")
    else:  # in the window's own order, so nothing is computed twice
        rows = rows.withColumn("start_close", F.first("first_s_close", ignorenulls=True).over(W.partitionBy("symbol").orderBy("timestamp_s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = rows.withColumn("carry", F.coalesce("carry", "start_close"))
    there, late = F.col("close").isNotNull(), F.col("first_s") > F.col("timestamp_s")
    price = lambda c, own: F.when(~there, F.col("carry")).when(late, own).otherwise(F.col(c))
    rows = rows.withColumns({
        "open": price("open", F.col("carry")),
        "high": price("high", F.greatest("high", "carry")),
        "low": price("low", F.least("low", "carry")),
        "close": F.coalesce("close", "carry"),
        "trade_count": F.coalesce("trade_count", F.lit(0)).cast("long"),
        **{c: F.coalesce(c, F.lit(0.0)) for c in AMOUNTS[1:]},
    })
    return rows.select("symbol", "timestamp_s", *(["chunk"] if chunked else []), "open", "high", "low", "close", *AMOUNTS)


def fill_gaps(bars: DataFrame, timeframe_s: int, start_ms: int, end_ms: int, chunk: int = CHUNK) -> DataFrame:
    """Every bar of [start_ms, end_ms) of each symbol in bars (traded_bars()), with the prices that fill_bars() gives, but from the bars alone: no list of symbols, no spine and no join with it.

    Each bar leaves the empty ones up to the next bar, and a symbol's first one those ahead of it. Ranges of more than `chunk` bars are dealt out: bars are written
    once, a table of chunk ends carries closes from chunk to chunk, and chunks without any bar come from it. Bars without a close count as empty.
    """
    start_s = start_ms // 1000
    last = (-(-end_ms // 1000) - 1 - start_s) // timeframe_s  # the place of the range's last bar
    at = lambda place: F.lit(start_s) + place * timeframe_s
    stretch = lambda begin, upto: F.explode(F.sequence(begin, upto, F.lit(timeframe_s).cast("long")))
    bars, begin_s, last_s, keys, carry_in = bars.where(F.col("close").isNotNull()), F.lit(start_s).cast("long"), F.lit(start_s + last * timeframe_s).cast("long"), ["symbol"], F.col("first_s_close")
    empty_chunks = None
    if chunked := last >= chunk:
        bars = written(bars, "bars").withColumn("chunk", F.floor((F.col("timestamp_s") - start_s) / timeframe_s / chunk))
        keys, w = ["symbol", "chunk"], W.partitionBy("symbol").orderBy("chunk")
        ends = bars.groupBy(*keys).agg(F.max_by("close", "timestamp_s").alias("end"), F.min_by("first_s_close", "timestamp_s").alias("begin"))
        ends = ends.select(*keys, "end", F.coalesce(F.lag("end").over(w), "begin").alias("carry_in"), (F.row_number().over(w) == 1).alias("leads"), (F.coalesce(F.lead("chunk").over(w), F.lit(last // chunk + 1)) - 1).alias("upto"))
        between = lambda first, upto: F.when(upto >= first, F.sequence(first, upto))
        later = ends.select("symbol", F.explode(between(F.col("chunk") + 1, F.col("upto"))).alias("chunk"), F.col("end").alias("price"))
        earlier = ends.where("leads").select("symbol", F.explode(between(F.lit(0).cast("long"), F.col("chunk") - 1)).alias("chunk"), F.col("carry_in").alias("price"))
        begin_s, carry_in = at(F.col("chunk") * chunk), F.col("carry_in")
        last_s = F.least(last_s, at(F.col("chunk") * chunk + (chunk - 1)))
        flat = later.union(earlier).withColumn("t", stretch(begin_s, last_s))
        empty_chunks = flat.select("symbol", F.col("t").alias("timestamp_s"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.lit(0).cast("long").alias("trade_count"), *[F.lit(0.0).alias(c) for c in AMOUNTS[1:]])
        bars = bars.join(ends.select(*keys, "carry_in"), keys)

    # as many tasks as the session asks for: rows become more after this shuffle, so its size is no measure for them
    bars = bars.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    w, own = W.partitionBy(*keys).orderBy("timestamp_s"), F.col("timestamp_s")
    rows = bars.withColumns({"previous": F.lag("close").over(w), "following": F.lead("timestamp_s").over(w)})
    rows = rows.withColumns({"carry": F.coalesce("previous", carry_in), "t": stretch(F.when(F.col("previous").isNull(), begin_s).otherwise(own), F.coalesce(F.col("following") - timeframe_s, last_s))})
    here, late, flat = F.col("t") == own, F.col("first_s") > own, F.when(F.col("t") < own, F.col("carry")).otherwise(F.col("close"))
    price = lambda c, opened: F.when(~here, flat).when(late, opened).otherwise(F.col(c)).alias(c)
    made = rows.select(
        "symbol", F.col("t").alias("timestamp_s"), price("open", F.col("carry")), price("high", F.greatest("high", "carry")), price("low", F.least("low", "carry")), F.when(here, F.col("close")).otherwise(flat).alias("close"),
        F.when(here, F.col("trade_count")).otherwise(0).cast("long").alias("trade_count"), *[F.coalesce(F.when(here, F.col(c)), F.lit(0.0)).alias(c) for c in AMOUNTS[1:]],
    )
    return made.union(empty_chunks) if chunked else made


def build_bars(trades: DataFrame, timeframe_s: int, start_ms: int, end_ms: int, chunk: int = CHUNK, unique: bool = False) -> DataFrame:
    """Dense OHLCV bars of every symbol that trades in range; trades are read once.

    Repeated trades count once, which costs a shuffle of the trades; `unique` spares it where the source has each trade once.
    """
    if end_ms <= start_ms or timeframe_s <= 0:
        raise ValueError("an empty range or time frame")
    bars = traded_bars(trades if unique else unique_trades(range_filter(trades, start_ms, end_ms)), timeframe_s, start_ms, end_ms)
    return fill_gaps(bars, timeframe_s, start_ms, end_ms, chunk)


def bar_ratios(bars: DataFrame) -> DataFrame:
    """bars with sizes, balance of sides, vwap and range."""
    c, vol, buy, sell = (F.col(x) for x in ("close", "volume", "buy_volume", "sell_volume"))
    return bars.withColumns({
        "avg_trade_size": F.when(F.col("trade_count") > 0, vol / F.col("trade_count")).otherwise(0.0),
        "signed_volume": buy - sell,
        "trade_imbalance": (buy - sell) / (buy + sell + EPS),
        "buy_sell_ratio": buy / (sell + EPS),
        "vwap": F.when(vol > 0, F.col("notional_volume") / (vol + EPS)).otherwise(c),
        "price_range": (F.col("high") - F.col("low")) / F.greatest(c, F.lit(EPS)),
    })


def daily_bars(ticks: DataFrame) -> DataFrame:
    """Daily bars of ticks that are ordered by line keys; the wide case. The keys are one DECIMAL of 14, 2, 12 and 10 digits, as in _order()."""
    digits = {"l_orderkey": (14, 24), "l_linenumber": (2, 22), "l_partkey": (12, 10), "l_suppkey": (10, 0)}
    order = F.expr("cast(" + " + ".join(f"cast({c} as decimal({n},0)) * {10**k}BD" for c, (n, k) in digits.items()) + " as decimal(38,0))")
    return ticks.groupBy("symbol", "day").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.count("*").alias("trade_count"), F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("quantity")).alias("notional_volume"), F.max("quantity").alias("max_trade_size"),
    )
