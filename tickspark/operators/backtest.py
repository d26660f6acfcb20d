"""Backtests: one position at a time per symbol (and setting), then returns, drawdown and ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.functions.scalars import DAY_MS
from tickspark.operators.bars import CHUNK
from tickspark.sources.scratch import written


def trade_candidates(decided: DataFrame) -> DataFrame:
    """Rows with a decision, with side, event, return_pct and hold_s; those without a return or time to exit go.

    Time to exit and reason are the label's, whichever side is traded. Rows are chosen by a generator of none or one row: a
    filter would be pushed below the scores, and copy all of their expressions into itself.
    """
    long = F.col("pred") == 1
    rows = decided.withColumns({
        "side": F.when(long, "LONG").otherwise("SHORT"), "event": F.when(long, F.col("long_event")).otherwise(F.col("short_event")),
        "return_pct": F.when(long, F.col("long_net_return_pct")).otherwise(F.col("short_net_return_pct")),
        "hold_s": F.greatest(F.ceil("time_to_exit_s"), F.lit(1)).cast("long"),
    })
    chosen = (F.col("pred") != 0) & F.col("return_pct").isNotNull() & F.col("time_to_exit_s").isNotNull()
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.select(F.inline(F.when(chosen, F.array(row)).otherwise(F.array().cast(T.ArrayType(rows.schema)))))


def in_spans(rows: DataFrame, *keys: str, size: int = CHUNK, span_ms: int = DAY_MS) -> DataFrame:
    """rows with chunk: spans of time one after the other, until they hold about `size` rows of the key; a span is never cut. Rows are counted, not ranked, and the counts' table is small."""
    rows, chunks = _spanned(rows, list(keys), size, span_ms, ())
    return rows.join(chunks, [*keys, "span"]).drop("span")


def _spanned(rows: DataFrame, own: list[str], size: int, span_ms: int, sums: tuple[Column, ...]) -> tuple[DataFrame, DataFrame]:
    """rows with span, and (own, span, chunk and sums) of each span."""
    rows = rows.withColumn("span", F.floor(F.col("timestamp_ms") / span_ms))
    counts = rows.groupBy(*own, "span").agg(F.count("*").alias("here"), *sums)
    before = F.sum("here").over(W.partitionBy(*own).orderBy("span").rowsBetween(W.unboundedPreceding, -1))
    return rows, counts.withColumn("chunk", F.floor(F.coalesce(before, F.lit(0)) / size)).drop("here")


def gate_chunks(rows: DataFrame, own: list[str], size: int, span_ms: int) -> DataFrame:
    """in_spans() with reach (the latest end of earlier chunks' rows), begin (the first time of the key) and last (its last chunk)."""
    sums = (F.max(F.col("timestamp_ms") + F.col("hold_s") * 1000).alias("end"), F.min("timestamp_ms").alias("first_ms"))
    rows, spans = _spanned(rows, own, size, span_ms, sums)
    key, chunk_before = W.partitionBy(*own), W.partitionBy(*own).orderBy("chunk").rangeBetween(W.unboundedPreceding, -1)
    spans = spans.select(*own, "span", "chunk", F.max("end").over(chunk_before).alias("reach"), F.min("first_ms").over(key).alias("begin"), F.max("chunk").over(key).alias("last"))
    return rows.join(spans, [*own, "span"]).drop("span")


def _follower(ts: np.ndarray, end: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """The first open row that isn't before the end of each row; the number of rows where there is none. One more entry: the same for an end before all rows."""
    n = len(ts)
    first = np.append(np.where(open_, np.arange(n), n), n)
    first = np.minimum.accumulate(first[::-1])[::-1]
    return np.append(first[np.searchsorted(ts, end, "left")], first[0])


def _doors(ts: np.ndarray, end: np.ndarray, open_: np.ndarray, reach: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a chunk by which a walk may enter it, and when it's free again after the last row it takes there.

    A walk enters by the first open row that isn't before an end of earlier chunks, all of which are at most `reach`. Jumps are doubled until
    all rows have arrived at the last row of their way.
    """
    n = len(ts)
    step = _follower(ts, end, open_)
    to = np.where(step[:-1] < n, step[:-1], np.arange(n))
    while (further := to[to]).tolist() != to.tolist():
        to = further
    upto = 0 if reach is None else int(np.searchsorted(ts, reach, "left"))
    rows = np.flatnonzero(open_[:upto])
    beyond = np.flatnonzero(open_[upto:])[:1] + upto
    rows = np.concatenate([rows, beyond])
    rows = rows[np.unique(ts[rows], return_index=True)[1]]
    return rows, end[to[rows]]


def _way(ts: np.ndarray, end: np.ndarray, open_: np.ndarray, first: int) -> list[int]:
    """Rows of a chunk that a walk takes which enters at time `first`."""
    step, n = _follower(ts, end, open_).tolist(), len(ts)
    i = int(np.searchsorted(ts, first, "left"))
    while i < n and not open_[i]:
        i += 1
    out = []
    while i < n:
        out.append(i)
        i = step[i]
    return out


def _sorted(chunk: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of a chunk by time, then length, with their times and ends."""
    chunk = chunk.sort_by([("timestamp_ms", "ascending"), ("hold_s", "ascending")]).combine_chunks()
    ts = chunk["timestamp_ms"].to_numpy()
    return chunk, ts, ts + chunk["hold_s"].to_numpy() * 1000


def entered_chunks(rows: DataFrame, own: list[str], states: int, open_of: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Rows of gate_chunks() with first: where a gate's walk enters their chunk, for `states` gates at once, null for those that don't. Chunks that none enters go.

    open_of gives the rows that a gate may take, (gates, rows). Chunks tell by themselves where every possible walk leaves them; the doors are the
    rows before the latest end of earlier chunks and the first one after. A walk over doors alone, streamed with one number a gate, gives the entries.
    """
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in own)
    def doors(chunk: pa.Table) -> pa.Table:
        chunk, ts, end = _sorted(chunk)
        reach = chunk["reach"][0].as_py()
        leave: dict[int, list[int | None]] = {}
        for k, open_ in enumerate(open_of(chunk)):
            for i, out in zip(*(x.tolist() for x in _doors(ts, end, open_, reach)), strict=True):
                leave.setdefault(int(ts[i]), [None] * states)[k] = out
        times = sorted(leave)
        fixed = [pa.repeat(chunk[c][0], len(times)) for c in (*own, "chunk")]
        return pa.table([*fixed, pa.array(times, pa.int64()), pa.array([leave[t] for t in times], pa.list_(pa.int64()))], names=[*own, "chunk", "timestamp_ms", "leave"])

    found = rows.where("last > 0").groupBy(*own, "chunk").applyInArrow(doors, f"{keys}, chunk long, timestamp_ms long, leave array<long>")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, free, first = None, None, [], []
        for batch in batches:
            out = []
            for *key, chunk, ts, leave in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, chunk) != (last, place):
                    if any(x is not None for x in first):
                        out.append((*last, place, first))
                    free = free if key == last else [None] * states
                    last, place, first = key, chunk, [None] * states
                for k, end in enumerate(leave):
                    if end is not None and (free[k] is None or ts >= free[k]):
                        free[k], first[k] = end, ts if first[k] is None else first[k]
            yield given(out, batch.schema)
        if any(x is not None for x in first):
            yield given([(*last, place, first)], batch.schema)

    def given(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        kinds = [*[schema.field(c).type for c in own], pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], [*own, "chunk", "first"])

    entered = found.repartition(*own).sortWithinPartitions(*own, "timestamp_ms").mapInArrow(walk, f"{keys}, chunk long, first array<long>")
    # a key of one chunk is entered where that begins
    first = F.coalesce("first", F.when(F.col("last") == 0, F.array_repeat("begin", states)))
    return rows.join(entered, [*own, "chunk"], "left").withColumn("first", first).where("first is not null").drop("reach", "begin", "last")


def _all_open(chunk: pa.Table) -> np.ndarray:
    return np.ones((1, len(chunk)), bool)


def gated_in_chunks(candidates: DataFrame, *keys: str, size: int = CHUNK, span_ms: int = DAY_MS) -> DataFrame:
    """gate_trades() with chunk, the chunk of time that a trade is in."""
    own = list(keys) or ["symbol"]
    entered = entered_chunks(gate_chunks(candidates, own, size, span_ms), own, 1, _all_open)

    def mark(chunk: pa.Table) -> pa.Table:
        chunk, ts, end = _sorted(chunk)
        return chunk.take(_way(ts, end, np.ones(len(ts), bool), chunk["first"][0].as_py()[0])).drop_columns(["first"])

    return entered.select(*candidates.columns, "chunk", "first").groupBy(*own, "chunk").applyInArrow(mark, entered.select(*candidates.columns, "chunk").schema)


def gate_trades(candidates: DataFrame, *keys: str, size: int = CHUNK, span_ms: int = DAY_MS) -> DataFrame:
    """Candidates that are taken: in time order, each that isn't before the end of the last one taken; of equal times the shortest.

    A key's candidates are dealt to chunks of about `size` rows; see entered_chunks().
    """
    return gated_in_chunks(written(candidates, "candidates"), *keys, size=size, span_ms=span_ms).select(*candidates.columns)


def _inside(trades: DataFrame, own: list[str]) -> DataFrame:
    """trades with inside (the product of 1 + return since the chunk's start) and inside_top (its largest so far)."""
    w = W.partitionBy(*own, "chunk").orderBy("timestamp_ms").rowsBetween(W.unboundedPreceding, 0)
    return trades.withColumn("inside", F.product(1.0 + F.col("return_pct") / 100.0).over(w)).withColumn("inside_top", F.max("inside").over(w))


def chunk_states(trades: DataFrame, *keys: str) -> DataFrame:
    """(keys, chunk, growth, top, low, worst) of trades with chunk: the product of 1 + return, its largest and lowest prefix, and the worst fall inside. They combine associatively."""
    rows = _inside(trades, list(keys))
    last = F.max_by("inside", "timestamp_ms").alias("growth")
    return rows.groupBy(*keys, "chunk").agg(last, F.max("inside").alias("top"), F.min("inside").alias("low"), F.max(1.0 - F.col("inside") / F.col("inside_top")).alias("worst"))


def carried(states: DataFrame, *keys: str) -> DataFrame:
    """states with base and peak, the equity before each chunk and its largest so far, from 1. One row a chunk."""
    earlier = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    rows = states.withColumn("base", F.coalesce(F.product("growth").over(earlier), F.lit(1.0)))
    return rows.withColumn("peak", F.greatest(F.lit(1.0), F.max(F.col("base") * F.col("top")).over(earlier)))


def with_chunks(trades: DataFrame, own: list[str]) -> DataFrame:
    return trades if "chunk" in trades.columns else in_spans(trades, *own)


def equity_curve(trades: DataFrame, *keys: str) -> DataFrame:
    """trades with equity_after, the product of 1 + return, from 1: inside chunks of time, times what the chunks before gave. No window holds a whole key."""
    own = list(keys) or ["symbol"]
    rows = with_chunks(trades, own)
    base = carried(chunk_states(rows, *own), *own).select(*own, "chunk", "base")
    return _inside(rows, own).join(base, [*own, "chunk"]).select(*trades.columns, (F.col("base") * F.col("inside")).alias("equity_after"))


def drawdowns(states: DataFrame, *keys: str) -> DataFrame:
    """(keys, max_drawdown_pct) from chunk states: the worst fall inside a chunk, or from what was the peak before it to its lowest prefix."""
    fall = F.greatest("worst", 1.0 - F.col("base") * F.col("low") / F.col("peak"), F.lit(0.0))
    return carried(states, *keys).groupBy(*keys).agg((F.max(fall) * 100.0).alias("max_drawdown_pct"))


def sharpe_column() -> Column:
    r, s = F.col("return_pct") / 100.0, F.stddev_samp(F.col("return_pct") / 100.0)
    return F.when((F.count("*") < 2) | (s <= 1e-12), 0.0).otherwise(F.avg(r) / s * F.sqrt(F.count("*").cast("double"))).alias("sharpe")


def max_drawdown(trades: DataFrame, *keys: str) -> DataFrame:
    """(keys, max_drawdown_pct): the largest fall of the equity below its running peak, which starts at 1."""
    own = list(keys) or ["symbol"]
    return drawdowns(chunk_states(with_chunks(trades, own), *own), *own)


def sharpe(trades: DataFrame, *keys: str) -> DataFrame:
    """(keys, sharpe): mean over sample deviation of trade returns, times the root of their number; 0 below two trades or without deviation."""
    return trades.groupBy(*(keys or ["symbol"])).agg(sharpe_column())


def trade_summary(trades: DataFrame, symbols: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each row of symbols (of the keys): counts, rates, returns, profits; zeros without trades, infinite factor without losses."""
    own, r = list(keys) or ["symbol"], F.col("return_pct")
    sums = trades.groupBy(*own).agg(
        F.count("*").alias("trade_count"), F.count_if(F.col("side") == "LONG").alias("long_count"), F.count_if(F.col("side") == "SHORT").alias("short_count"),
        (F.count_if(r > 0) / F.count("*") * 100.0).alias("win_rate_pct"), F.avg(r).alias("avg_return_pct"), ((F.product(1.0 + r / 100.0) - 1.0) * 100.0).alias("cumulative_return_pct"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gross_profit_pct"), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0))).alias("gross_loss_pct"), F.avg("hold_s").alias("avg_hold_s"), *more,
    )
    return with_factor(symbols.join(sums, own, "left"))


def with_factor(rows: DataFrame) -> DataFrame:
    """Summary rows with profit_factor, and zeros for those without trades."""
    factor = F.when(F.col("trade_count").isNull(), 0.0).when(F.col("gross_loss_pct") > 0, F.try_divide("gross_profit_pct", "gross_loss_pct")).otherwise(F.lit(float("inf")))
    return rows.withColumn("profit_factor", factor).na.fill(0).na.fill(0.0)


def backtest_report(decided: DataFrame, *keys: str, every: DataFrame | None = None) -> DataFrame:
    """One summary row of the gated trades for each row of `every` (default: each key of decided). Of the candidates, which are written once, only what it sums is kept."""
    own = list(keys) or ["symbol"]
    candidates = written(trade_candidates(decided).select(*own, "timestamp_ms", "side", "return_pct", "hold_s"), "candidates")
    every = decided.select(*own).distinct() if every is None else every
    return with_factor(every.join(combined(gate_sums(candidates, own, 1, _all_open).drop("setting"), *own), own, "left"))


def backtest_trades(decided: DataFrame, *keys: str) -> DataFrame:
    """The gated trades with their equity."""
    own = list(keys) or ["symbol"]
    trades = written(gated_in_chunks(written(trade_candidates(decided), "candidates"), *own), "trades")
    return equity_curve(trades, *own).drop("chunk")


def backtest(decided: DataFrame, *keys: str, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """backtest_trades() and backtest_report()."""
    return backtest_trades(decided, *keys), backtest_report(decided, *keys, every=every)


def predictions(decided: DataFrame) -> DataFrame:
    """Every evaluated row, traded or not, with its label, probabilities and decision."""
    return decided.select("symbol", "timestamp", "timestamp_ms", "close", "label", "label_name", "p_no_trade", "p_long", "p_short", F.col("pred").alias("threshold_pred"), F.col("pred_name").alias("threshold_pred_name"))


#: A chunk's trades of one setting, as numbers that combine: counts, sums, mean and squares about it, extremes, and what chunk_states() has.
PARTIAL = "trade_count long, long_count long, wins long, total double, gain double, loss double, held double, squares double, least double, most double, growth double, top double, low double, worst double"


def _partial(side: np.ndarray, returns: np.ndarray, held: np.ndarray) -> tuple:
    curve = np.cumprod(1.0 + returns / 100.0)
    worst = (1.0 - curve / np.maximum.accumulate(curve)).max()
    sums = (float(returns.sum()), float(returns[returns > 0].sum()), float(returns[returns < 0].sum()), float(held.sum()), float(((returns - returns.mean()) ** 2).sum()))
    return (len(returns), int((side == "LONG").sum()), int((returns > 0).sum()), *sums, float(returns.min()), float(returns.max()), float(curve[-1]), float(curve.max()), float(curve.min()), float(worst))


def gate_sums(candidates: DataFrame, own: list[str], states: int, open_of: Callable[[pa.Table], np.ndarray], size: int = CHUNK, span_ms: int = DAY_MS) -> DataFrame:
    """(own, chunk, setting, PARTIAL): of each gate's trades in a chunk their partial sums, in the task that finds them."""
    entered = entered_chunks(gate_chunks(candidates, own, size, span_ms), own, states, open_of)
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    numbers = [{"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in PARTIAL.split(", ")]

    def summed(chunk: pa.Table) -> pa.Table:
        chunk, ts, end = _sorted(chunk)
        side, returns, held = chunk["side"].to_numpy(), chunk["return_pct"].to_numpy(), chunk["hold_s"].to_numpy()
        out = []
        for k, (open_, first) in enumerate(zip(open_of(chunk), chunk["first"][0].as_py(), strict=True)):
            way = [] if first is None else _way(ts, end, open_, first)
            if way:
                out.append((k, *_partial(side[way], returns[way], held[way])))
        fixed = [pa.repeat(chunk[c][0], len(out)) for c in (*own, "chunk")]
        return pa.table([*fixed, *[pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * (1 + len(names)), [pa.int32(), *numbers], strict=True)]], names=[*own, "chunk", "setting", *names])

    kinds = dict(candidates.dtypes)
    return entered.groupBy(*own, "chunk").applyInArrow(summed, ", ".join(f"`{c}` {kinds[c]}" for c in own) + f", chunk long, setting int, {PARTIAL}")


def combined(partials: DataFrame, *keys: str) -> DataFrame:
    """Summary of each key from the partial sums of its chunks."""
    n, mean, r = F.sum("trade_count"), F.sum("total") / F.sum("trade_count"), F.col("total") / F.col("trade_count")
    # squares about the common mean; equal returns have none, whatever rounding says
    spread = F.when(F.min("least") == F.max("most"), 0.0).otherwise(F.greatest(F.sum("squares") + F.sum(F.col("trade_count") * r * r) - n * mean * mean, F.lit(0.0)))
    deviation = F.sqrt(spread / (n - 1)) / 100.0
    rows = carried(partials, *keys).groupBy(*keys).agg(
        n.alias("trade_count"), F.sum("long_count").alias("long_count"), (n - F.sum("long_count")).alias("short_count"), (F.sum("wins") / n * 100.0).alias("win_rate_pct"), mean.alias("avg_return_pct"),
        ((F.product("growth") - 1.0) * 100.0).alias("cumulative_return_pct"), F.sum("gain").alias("gross_profit_pct"), F.abs(F.sum("loss")).alias("gross_loss_pct"), (F.sum("held") / n).alias("avg_hold_s"),
        (F.max(F.greatest("worst", 1.0 - F.col("base") * F.col("low") / F.col("peak"), F.lit(0.0))) * 100.0).alias("max_drawdown_pct"),
        F.when((n < 2) | (deviation <= 1e-12), 0.0).otherwise(mean / 100.0 / deviation * F.sqrt(n.cast("double"))).alias("sharpe"),
    )
    return rows


def threshold_sweep(scored: DataFrame, grid: list[tuple[float, float, float]], symbols: DataFrame | None = None, size: int = CHUNK, span_ms: int = DAY_MS) -> DataFrame:
    """Backtest summary of each symbol and setting (long, short, margin). The grid is a list in the program, so its table is small.

    A row has one side, whatever the setting, and its thresholds only say which settings may take it. So rows aren't copied: gates of all settings
    walk over one chunk together, and each leaves one row of partial sums a chunk.
    """
    long = F.col("p_long") > F.col("p_short")
    rows = scored.withColumns({
        "side": F.when(long, "LONG").when(F.col("p_short") > F.col("p_long"), "SHORT"), "p": F.greatest("p_long", "p_short"),
        "return_pct": F.when(long, F.col("long_net_return_pct")).otherwise(F.col("short_net_return_pct")), "hold_s": F.greatest(F.ceil("time_to_exit_s"), F.lit(1)).cast("long"),
    })
    chosen = F.col("side").isNotNull() & F.col("return_pct").isNotNull() & F.col("time_to_exit_s").isNotNull()
    row = F.struct("symbol", "timestamp_ms", "side", "p", "p_no_trade", "return_pct", "hold_s")
    picked = rows.select(F.inline(F.when(chosen, F.array(row)).otherwise(F.array().cast(T.ArrayType(rows.select(row).schema[0].dataType)))))
    at = np.array(grid, dtype=float).reshape(-1, 3)

    def open_of(chunk: pa.Table) -> np.ndarray:
        p, none, is_long = chunk["p"].to_numpy(), chunk["p_no_trade"].to_numpy(), pc.equal(chunk["side"], "LONG").to_numpy()
        return (p >= np.where(is_long, at[:, :1], at[:, 1:2])) & (p >= none + at[:, 2:])

    partials = gate_sums(written(picked, "candidates"), ["symbol"], len(grid), open_of, size, span_ms)
    settings = F.broadcast(scored.sparkSession.createDataFrame([(k, *g) for k, g in enumerate(grid)], "setting int, long_at double, short_at double, margin double"))
    every = (scored.select("symbol").distinct() if symbols is None else symbols).crossJoin(settings)
    return with_factor(every.join(combined(partials, "symbol", "setting"), ["symbol", "setting"], "left")).drop("setting")
