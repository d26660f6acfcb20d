"""Triple-barrier labels: what the next H bars do to a long and a short entered at a bar's close."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickspark.operators.bars import CHUNK, dealt, numbered

NO_TRADE, LONG, SHORT = 0, 1, 2
#: Names of the classes, and the columns that a label table begins with.
NAMES = {NO_TRADE: "NO_TRADE", LONG: "LONG_SETUP", SHORT: "SHORT_SETUP"}
FRONT = [
    "timestamp", "timestamp_ms", "timestamp_s", "close", "label", "label_name", "exit_reason", "time_to_exit_s", "long_event", "short_event", "long_net_return_pct", "short_net_return_pct", "long_horizon_return_pct",
    "short_horizon_return_pct", "future_max_upside_pct", "future_max_downside_pct", "horizon_steps", "horizon_seconds", "horizon_s", "take_profit_pct", "stop_loss_pct", "fee_pct", "slippage_pct",
]


def _ahead(bars: DataFrame, steps: int) -> WindowSpec:
    """The next rows of the symbol, or of its chunk where rows are dealt out in chunks (bars.in_chunks with a halo of `steps` rows after each)."""
    return W.partitionBy("symbol", *(["chunk"] if "chunk" in bars.columns else [])).orderBy("timestamp_ms").rowsBetween(1, steps)


def future_frame(bars: DataFrame, steps: int) -> DataFrame:
    """bars with `future`, the next `steps` rows (fewer at the end) in order."""
    return bars.withColumn("future", F.collect_list(F.struct("high", "low", "close", "timestamp_s")).over(_ahead(bars, steps)))


def future_extremes(bars: DataFrame, steps: int) -> DataFrame:
    """bars with the largest rise and fall of the next rows, in percent of the close; null without any."""
    change = lambda c: (c / F.col("close") - 1.0) * 100.0
    return bars.withColumns({"future_max_upside_pct": change(F.max("high").over(_ahead(bars, steps))), "future_max_downside_pct": change(F.min("low").over(_ahead(bars, steps)))})


def horizon_returns(bars: DataFrame, steps: int, cost: float) -> DataFrame:
    """bars with the returns of holding to the last of the next rows, after cost."""
    last = F.last("close").over(_ahead(bars, steps))
    return bars.withColumns({"long_horizon_return_pct": (last / F.col("close") - 1.0 - cost) * 100.0, "short_horizon_return_pct": (F.col("close") / last - 1.0 - cost) * 100.0})


def _at_least(a: Column, b: Column) -> Column:
    """a >= b, false for NaN on either side, which Spark orders above all numbers."""
    return (a >= b) & ~F.isnan(a) & ~F.isnan(b)


def first_touch(side: str, tp: Column, sl: Column) -> Column:
    """Struct (step, high, low, timestamp_s, tp, sl) of the first future row that touches a barrier of the side; null without."""
    e = F.col("close")
    up, down = (tp, sl) if side == "long" else (sl, tp)

    def touched(x: Column) -> tuple[Column, Column]:
        return _at_least(x["high"], e * (F.lit(1.0) + up)), _at_least(e * (F.lit(1.0) - down), x["low"])

    def seen(x: Column, i: Column) -> Column:
        above, below = touched(x)
        won, lost = (above, below) if side == "long" else (below, above)
        return F.struct((i + 1).alias("step"), x["timestamp_s"].alias("timestamp_s"), won.alias("tp"), lost.alias("sl"))

    return F.try_element_at(F.filter(F.transform("future", seen), lambda s: s["tp"] | s["sl"]), F.lit(1))


def touch_columns(rows: DataFrame, tp: Column, sl: Column, cost: Column) -> DataFrame:
    """rows (with future and horizon returns) with event, net return and time to exit of either side."""
    n = F.size("future")
    out = rows.withColumns({"long_hit": first_touch("long", tp, sl), "short_hit": first_touch("short", tp, sl)})
    return outcome_columns(out, n, F.try_element_at(F.col("future.timestamp_s"), n), tp, sl, cost)


def outcome_columns(out: DataFrame, n: Column, end_s: Column, tp: Column, sl: Column, cost: Column) -> DataFrame:
    """Event, net return and time to exit of either side, from its first touch (long_hit, short_hit), the number of rows ahead and the last one's time."""
    for side in ("long", "short"):
        hit = F.col(f"{side}_hit")
        event = F.when(n == 0, "NONE").when(hit.isNull(), "HORIZON").when(hit["tp"] & hit["sl"], "AMBIGUOUS").when(hit["tp"], "TP").otherwise("SL")
        at, step = F.coalesce(hit["timestamp_s"], end_s), F.coalesce(hit["step"], n)
        delta = at - F.col("timestamp_s")
        out = out.withColumns({f"{side}_event": event, f"{side}_tte": F.when(n > 0, F.when(delta > 0, delta).otherwise(step).cast("double"))})
        net = F.when(F.col(f"{side}_event") == "TP", (tp - cost) * 100.0).when(F.col(f"{side}_event") == "SL", (-sl - cost) * 100.0).when(F.col(f"{side}_event") == "HORIZON", F.col(f"{side}_horizon_return_pct"))
        out = out.withColumn(f"{side}_net_return_pct", net)
    return out.drop("long_hit", "short_hit")


def label_decision(rows: DataFrame) -> DataFrame:
    """rows with label, label_name, exit_reason and time_to_exit_s.

    A side is good if it takes profit at a gain. Of two good sides the better wins, of two equal ones the long. Without a
    good side, the exit is that of the side with the better known return.
    """
    ln, sn = F.col("long_net_return_pct"), F.col("short_net_return_pct")
    good = {s: F.coalesce((F.col(f"{s}_event") == "TP") & (F.col(f"{s}_net_return_pct") > 0), F.lit(False)) for s in ("long", "short")}
    long_wins = F.coalesce(ln >= sn, ln.isNotNull())
    label = F.when(good["long"] & (~good["short"] | (ln >= sn)), LONG).when(good["short"], SHORT).otherwise(NO_TRADE)
    side = F.when(label == LONG, "long").when(label == SHORT, "short").when(ln.isNull() & sn.isNull(), F.lit(None)).when(long_wins, "long").otherwise("short")
    pick = lambda c: F.when(side == "long", F.col(f"long_{c}")).when(side == "short", F.col(f"short_{c}"))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("label"))
    return rows.withColumns({"exit_reason": F.coalesce(pick("event"), F.lit("NONE")), "time_to_exit_s": pick("tte"), "label": label}).withColumn("label_name", name)


def build_labels(bars: DataFrame, steps: int = 12, tp_pct: float = 0.35, sl_pct: float = 0.25, fee_pct: float = 0.04, slippage_pct: float = 0.01) -> DataFrame:
    """Label table of a feature table: the front columns, then the features. One window over the input's partitioning by symbol."""
    if steps <= 0 or tp_pct <= 0 or sl_pct <= 0:
        raise ValueError("horizon, take profit and stop loss must be positive")
    cost = (fee_pct + slippage_pct) / 100.0
    rows = horizon_returns(future_extremes(future_frame(bars, steps), steps), steps, cost)
    rows = label_decision(touch_columns(rows, F.lit(tp_pct / 100.0), F.lit(sl_pct / 100.0), F.lit(cost)))
    return label_table(rows, bars, steps, tp_pct, sl_pct, fee_pct, slippage_pct)


def label_table(rows: DataFrame, bars: DataFrame, steps: int, tp_pct: float, sl_pct: float, fee_pct: float, slippage_pct: float) -> DataFrame:
    """The front columns of decided rows, then what bars have besides."""
    seconds = F.lit(steps) * F.col("timeframe_s")
    rows = rows.withColumns({"horizon_steps": F.lit(steps), "horizon_seconds": seconds, "horizon_s": seconds, "take_profit_pct": F.lit(tp_pct), "stop_loss_pct": F.lit(sl_pct), "fee_pct": F.lit(fee_pct), "slippage_pct": F.lit(slippage_pct)})
    front = [c for c in FRONT if c in rows.columns]
    return rows.select("symbol", *front, *[c for c in bars.columns if c not in (*front, "symbol")])


def build_labels_in_chunks(bars: DataFrame, chunk: int = CHUNK, steps: int = 12, *args: float) -> DataFrame:
    """build_labels() of histories too long for one task, with or without gaps: chunks of `chunk` rows with the next `steps` rows copied in."""
    rows = build_labels(dealt(numbered(bars), chunk, after=steps), steps, *args)
    return rows.where("own").drop("chunk", "own", "i", "n")


def label_sweep(bars: DataFrame, settings: list[tuple[int, float, float]], cost: float = 0.0005, chunk: int = CHUNK) -> DataFrame:
    """(steps, tp_pct, sl_pct, label, n) for each setting, from the first rows ahead that reach each distinct level (level_steps()), whatever the settings' number and horizons.

    A side is good if it takes profit first, inside the horizon, and at a gain. Both sides take the same profit, so the long wins where both are good;
    returns at the horizon decide no label. The settings are a list in the program, so their table is small by construction.
    """
    levels = sorted({x for _, tp, sl in settings for x in (tp, sl)})
    grid = [(h, tp, sl, levels.index(tp), levels.index(sl)) for h, tp, sl in settings]
    grid = F.broadcast(bars.sparkSession.createDataFrame(grid, "steps int, tp_pct double, sl_pct double, tp_at int, sl_at int"))
    rows = level_steps(bars, [x / 100.0 for x in levels], max(h for h, _, _ in settings), chunk).crossJoin(grid)
    won = lambda there, back: (F.get(there, F.col("tp_at")) <= F.col("steps")) & (F.get(there, F.col("tp_at")) < F.get(back, F.col("sl_at")))
    gain = (F.col("tp_pct") / 100.0 - cost) * 100.0 > 0
    label = F.when(gain & won("up", "down"), LONG).when(gain & won("down", "up"), SHORT).otherwise(NO_TRADE)
    return rows.withColumn("label", label).groupBy("steps", "tp_pct", "sl_pct", "label").agg(F.count("*").alias("n"))


#: Stands for a level that no row ahead reaches.
NEVER = 2**31 - 1


def level_steps(bars: DataFrame, levels: list[float], steps: int, chunk: int = CHUNK) -> DataFrame:
    """(symbol, timestamp_ms, up, down): for each level, in how many rows a high first lies that share above the close, or a low below it; NEVER if not in the next `steps` rows.

    The records of what lies ahead of a row are the chain of next larger values from the row after it. A chunk works those pointers out once;
    each level is a binary search in the chain, so it costs the logarithm of the records. Nulls and NaN reach nothing.
    """
    rows = dealt(numbered(bars.select("symbol", "timestamp_ms", "high", "low", "close")), chunk, after=steps)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        own = pdf["own"].to_numpy()
        here = np.flatnonzero(own)
        close = pdf["close"].to_numpy(np.float64)[own]
        found = []
        for side, sign in (("high", 1.0), ("low", -1.0)):
            x = sign * pdf[side].to_numpy(np.float64)
            chain = record_chains(x, steps)
            places = [first_in_chain(x, chain, here + 1, sign * (close * (1 + sign * level))) for level in levels]
            ahead = np.stack(places, 1) - here[:, None]
            found.append(np.where((ahead <= steps) & (np.stack(places, 1) < len(x)), ahead, NEVER).astype(np.int32))
        return pd.DataFrame({"symbol": pdf["symbol"][own], "timestamp_ms": pdf["timestamp_ms"][own], "up": list(found[0]), "down": list(found[1])})

    return rows.groupBy("symbol", "chunk").applyInPandas(search, "symbol string, timestamp_ms long, up array<int>, down array<int>")


def record_chains(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the 1st, 2nd, 4th ... next record after each place of x, each record the first larger value than the one before; len(x) without one in the next `most` places."""
    n = len(x)
    value = np.where(np.isnan(x), -np.inf, x)
    place, stop = np.arange(n) + 1, np.minimum(np.arange(n) + 1 + most, n)
    tables = range_extremes(value, most, np.maximum)
    for k in range(len(tables) - 1, -1, -1):
        seen = tables[k][np.minimum(place, len(tables[k]) - 1)]
        place = np.where((place + (1 << k) <= stop) & (seen <= value), place + (1 << k), place)
    chains = [np.append(np.where(place < stop, place, n), n)]
    while (chains[-1] < n).any() and 1 << len(chains) <= most:
        chains.append(chains[-1][chains[-1]])
    return chains


def first_in_chain(x: np.ndarray, chains: list[np.ndarray], start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first place from start on whose x is at least the level; len(x) without one in its chain of records."""
    value = np.append(np.where(np.isnan(x), -np.inf, x), np.inf)
    place = start
    for chain in reversed(chains):
        place = np.where(value[chain[place]] < level, chain[place], place)
    place = np.where(value[place] < level, chains[0][place], place)
    return np.where(np.isnan(level), len(x), place)


def range_extremes(x: np.ndarray, most: int, better: np.ufunc) -> list[np.ndarray]:
    """Extremes of x over stretches of 1, 2, 4 ... rows from each row, up to `most` rows; NaN counts nowhere where better is fmax or fmin."""
    out = [x]
    while 2 << (len(out) - 1) <= min(most, len(x)):
        last, half = out[-1], 1 << (len(out) - 1)
        out.append(better(last[:-half], last[half:]))
    return out


def first_touch_long_horizon(bars: DataFrame, steps: int, tp: float, sl: float, chunk: int = CHUNK) -> DataFrame:
    """bars with what the next `steps` rows hold, for horizons too long to collect: numpy over chunks with a halo of `steps` rows.

    A touch is found in tables of extremes over stretches of powers of two, so a row costs the logarithm of the horizon, touched or not.

    ahead (rows ahead), top, bottom, last and last_s (their highest, lowest and last price, and the last one's time), long_hit
    and short_hit: the first row ahead that touches a barrier of the side, as first_touch() has it, null without. Rows are dealt by
    (symbol, chunk), so a symbol of any length is many groups of at most chunk + steps rows.
    """
    rows = dealt(numbered(bars), chunk, after=steps)
    hit = "struct<step:long,timestamp_s:long,tp:boolean,sl:boolean>"
    schema = f"symbol string, timestamp_ms long, ahead long, top double, bottom double, last double, last_s long, long_hit {hit}, short_hit {hit}"

    def touch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        n = int(pdf["own"].sum())
        high, low, close, at = (pdf[c].to_numpy() for c in ("high", "low", "close", "timestamp_s"))
        ahead = np.minimum(steps, len(pdf) - 1 - np.arange(n))
        out = {"symbol": pdf["symbol"][:n], "timestamp_ms": pdf["timestamp_ms"][:n], "ahead": ahead}
        for name, c, best in (("top", "high", "max"), ("bottom", "low", "min")):
            window = pdf[c][::-1].rolling(steps, min_periods=1)
            out[name] = getattr(window, best)()[::-1].shift(-1)[:n]
        end = np.minimum(np.arange(n) + steps, len(pdf) - 1)
        out["last"], out["last_s"] = np.where(ahead > 0, close[end], np.nan), pd.array(at[end], "Int64")
        out["last_s"][ahead == 0] = pd.NA
        tops, bottoms = range_extremes(high, steps, np.fmax), range_extremes(low, steps, np.fmin)
        for side, up, down in (("long", tp, sl), ("short", sl, tp)):
            at_up, at_down = close[:n] * (1 + up), close[:n] * (1 - down)
            place, stop = np.arange(n) + 1, np.arange(n) + 1 + ahead
            for k in range(len(tops) - 1, -1, -1):  # over the longest stretch without a touch, in steps of falling powers of two
                here = np.minimum(place, len(tops[k]) - 1)
                place = np.where((place + (1 << k) <= stop) & ~(tops[k][here] >= at_up) & ~(bottoms[k][here] <= at_down), place + (1 << k), place)
            hit = place < stop
            here = np.minimum(place, len(pdf) - 1)
            found, above, below = np.where(hit, place - np.arange(n), 0), hit & (high[here] >= at_up), hit & (low[here] <= at_down)
            won, lost = (above, below) if side == "long" else (below, above)
            out[f"{side}_hit"] = [{"step": k, "timestamp_s": t, "tp": w, "sl": x} if k else None for k, t, w, x in zip(found.tolist(), at[np.arange(n) + found].tolist(), won.tolist(), lost.tolist(), strict=True)]
        return pd.DataFrame(out)

    found = rows.select("symbol", "chunk", "own", "i", "timestamp_ms", "timestamp_s", "high", "low", "close").groupBy("symbol", "chunk").applyInPandas(touch, schema)
    found = found.withColumns({c: F.when(F.col("ahead") > 0, F.col(c)) for c in ("top", "bottom", "last")})
    return bars.join(found, ["symbol", "timestamp_ms"])


def build_labels_long_horizon(bars: DataFrame, steps: int, tp_pct: float = 0.35, sl_pct: float = 0.25, fee_pct: float = 0.04, slippage_pct: float = 0.01, chunk: int = CHUNK) -> DataFrame:
    """build_labels() for horizons too long to collect."""
    cost = (fee_pct + slippage_pct) / 100.0
    rows = first_touch_long_horizon(bars, steps, tp_pct / 100.0, sl_pct / 100.0, chunk)
    e = F.col("close")
    rows = rows.withColumns({
        "future_max_upside_pct": (F.col("top") / e - 1.0) * 100.0, "future_max_downside_pct": (F.col("bottom") / e - 1.0) * 100.0,
        "long_horizon_return_pct": (F.col("last") / e - 1.0 - cost) * 100.0, "short_horizon_return_pct": (e / F.col("last") - 1.0 - cost) * 100.0,
    })
    rows = outcome_columns(rows, F.col("ahead"), F.col("last_s"), F.lit(tp_pct / 100.0), F.lit(sl_pct / 100.0), F.lit(cost))
    return label_table(label_decision(rows), bars, steps, tp_pct, sl_pct, fee_pct, slippage_pct)
