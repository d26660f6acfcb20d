"""DuckDB SQL of the catalogue's queries, written from the operators' definitions and not from their plans."""

from __future__ import annotations

import re

import numpy as np

from tickspark.jobs.settings import COEFFICIENTS, END_MS, GRID, INTERCEPTS, LABELS, START_MS, SWEEP, THRESHOLDS, TIMEFRAME_S, mlp_weights

DAY = 86_400_000
START_S, END_S = START_MS // 1000, END_MS // 1000
STEPS, TP, SL, FEE, SLIP = LABELS
COST = (FEE + SLIP) / 100.0
EPS = "1e-12"


def r(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0e0 AS {n.split('.')[-1]}" for n in names.split())


def e(x: float) -> str:
    """A DOUBLE literal of exactly this value."""
    return f"{float(x)!r}" + ("" if "e" in repr(float(x)) else "e0")


AMOUNTS = "volume buy_volume sell_volume notional_volume buy_notional sell_notional max_trade_size"
OHLC = "open high low close"


def bars_sql(name: str, tf: int) -> dict[str, str]:
    """Filled bars by a grid of traded seconds: each second's price is its last trade's, and a bar opens at its first second's."""
    return {
        f"{name}_traded": f"""
            SELECT symbol, {START_S} + ((second_s - {START_S}) // {tf}) * {tf} AS timestamp_s, min_by(open, second_s) AS open, max(high) AS high, min(low) AS low, max_by(close, second_s) AS close,
                sum(trade_count) AS trade_count, sum(volume) AS volume, sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume, sum(notional_volume) AS notional_volume,
                sum(buy_notional) AS buy_notional, sum(sell_notional) AS sell_notional, max(max_trade_size) AS max_trade_size, min(second_s) AS first_s
            FROM seconds WHERE second_s >= {START_S} AND second_s < {END_S} GROUP BY ALL""",
        f"{name}_first": f"SELECT symbol, min_by(close, second_s) AS c0 FROM seconds WHERE second_s >= {START_S} AND second_s < {END_S} GROUP BY symbol",
        f"{name}_carried": f"""
            SELECT g.symbol, g.s AS timestamp_s, t.* EXCLUDE (symbol, timestamp_s), coalesce(last_value(t.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f.c0) AS carry
            FROM (SELECT symbol, unnest(range({START_S}, {END_S}, {tf})) AS s FROM {name}_first) g JOIN {name}_first f USING (symbol) LEFT JOIN {name}_traded t ON t.symbol = g.symbol AND t.timestamp_s = g.s""",
        name: f"""
            SELECT symbol, timestamp_s, CASE WHEN close IS NULL OR first_s > timestamp_s THEN carry ELSE open END AS open,
                CASE WHEN close IS NULL THEN carry WHEN first_s > timestamp_s THEN greatest(high, carry) ELSE high END AS high,
                CASE WHEN close IS NULL THEN carry WHEN first_s > timestamp_s THEN least(low, carry) ELSE low END AS low,
                coalesce(close, carry) AS close, coalesce(trade_count, 0)::BIGINT AS trade_count, {', '.join(f'coalesce({c}, 0.0e0) AS {c}' for c in AMOUNTS.split())}
            FROM {name}_carried""",
        f"{name}_ratios": f"""
            SELECT *, CASE WHEN trade_count > 0 THEN volume / trade_count ELSE 0.0e0 END AS avg_trade_size, buy_volume - sell_volume AS signed_volume, (buy_volume - sell_volume) / (buy_volume + sell_volume + {EPS}) AS trade_imbalance,
                buy_volume / (sell_volume + {EPS}) AS buy_sell_ratio, CASE WHEN volume > 0 THEN notional_volume / (volume + {EPS}) ELSE close END AS vwap, (high - low) / greatest(close, {EPS}) AS price_range
            FROM {name}""",
        f"{name}_returns": "SELECT *, "
        + ", ".join(f"CASE WHEN lag(close, {k}) OVER w IS NULL THEN 0.0e0 ELSE ln(greatest(close, {EPS})) - ln(greatest(lag(close, {k}) OVER w, {EPS})) END AS ret_{k}s" for k in (1, 3, 5, 10))
        + f" FROM {name}_ratios WINDOW w AS (PARTITION BY symbol ORDER BY timestamp_s)",
    }


def touch(name: str, source: str, steps: str, tp: str, sl: str, cost: str, keys: str = "") -> dict[str, str]:
    """First touches by joining each bar with the bars ahead of it, found by row numbers."""
    by = f"symbol, i{', ' + keys if keys else ''}"
    return {
        f"{name}_ahead": f"""
            SELECT a.*, b.i - a.i AS step, b.timestamp_s AS seen_s, b.high AS fh, b.low AS fl, b.close AS fc,
                b.high >= a.close * (1.0e0 + {tp}) AND NOT isnan(b.high) AS up_tp, b.low <= a.close * (1.0e0 - {sl}) AND NOT isnan(b.low) AS down_sl,
                b.low <= a.close * (1.0e0 - {tp}) AND NOT isnan(b.low) AS down_tp, b.high >= a.close * (1.0e0 + {sl}) AND NOT isnan(b.high) AS up_sl
            FROM {source} a LEFT JOIN (SELECT symbol, i, timestamp_s, high, low, close FROM {source.split(' ')[0]}) b ON a.symbol = b.symbol AND b.i > a.i AND b.i <= a.i + {steps}""",
        f"{name}_found": f"""
            SELECT {by}, any_value(close) AS close, any_value(timestamp_s) AS timestamp_s, count(step) AS n, max(fh) AS fh, min(fl) AS fl, max_by(fc, step) AS fc, max_by(seen_s, step) AS at_end,
                min(step) FILTER (up_tp OR down_sl) AS ls, arg_min(seen_s, step) FILTER (up_tp OR down_sl) AS lat, arg_min(up_tp, step) FILTER (up_tp OR down_sl) AS ltp, arg_min(down_sl, step) FILTER (up_tp OR down_sl) AS lsl,
                min(step) FILTER (down_tp OR up_sl) AS ss, arg_min(seen_s, step) FILTER (down_tp OR up_sl) AS sat, arg_min(down_tp, step) FILTER (down_tp OR up_sl) AS stp, arg_min(up_sl, step) FILTER (down_tp OR up_sl) AS ssl
            FROM {name}_ahead GROUP BY {by}""",
        f"{name}_events": f"""
            SELECT *, (fh / close - 1.0e0) * 100.0e0 AS future_max_upside_pct, (fl / close - 1.0e0) * 100.0e0 AS future_max_downside_pct, (fc / close - 1.0e0 - {cost}) * 100.0e0 AS long_horizon_return_pct, (close / fc - 1.0e0 - {cost}) * 100.0e0 AS short_horizon_return_pct,
                CASE WHEN n = 0 THEN 'NONE' WHEN ls IS NULL THEN 'HORIZON' WHEN ltp AND lsl THEN 'AMBIGUOUS' WHEN ltp THEN 'TP' ELSE 'SL' END AS long_event,
                CASE WHEN n = 0 THEN 'NONE' WHEN ss IS NULL THEN 'HORIZON' WHEN stp AND ssl THEN 'AMBIGUOUS' WHEN stp THEN 'TP' ELSE 'SL' END AS short_event,
                CASE WHEN n > 0 THEN CASE WHEN coalesce(lat, at_end) - timestamp_s > 0 THEN coalesce(lat, at_end) - timestamp_s ELSE coalesce(ls, n) END END::DOUBLE AS lt,
                CASE WHEN n > 0 THEN CASE WHEN coalesce(sat, at_end) - timestamp_s > 0 THEN coalesce(sat, at_end) - timestamp_s ELSE coalesce(ss, n) END END::DOUBLE AS st
            FROM {name}_found""",
        f"{name}_nets": f"""
            SELECT *, CASE long_event WHEN 'TP' THEN ({tp} - {cost}) * 100.0e0 WHEN 'SL' THEN (-{sl} - {cost}) * 100.0e0 WHEN 'HORIZON' THEN long_horizon_return_pct END AS long_net_return_pct,
                CASE short_event WHEN 'TP' THEN ({tp} - {cost}) * 100.0e0 WHEN 'SL' THEN (-{sl} - {cost}) * 100.0e0 WHEN 'HORIZON' THEN short_horizon_return_pct END AS short_net_return_pct
            FROM {name}_events""",
        f"{name}_labelled": f"""
            SELECT *, CASE side WHEN 'L' THEN long_event WHEN 'S' THEN short_event ELSE 'NONE' END AS exit_reason, CASE side WHEN 'L' THEN lt WHEN 'S' THEN st END AS time_to_exit_s, CASE label WHEN 1 THEN 'LONG_SETUP' WHEN 2 THEN 'SHORT_SETUP' ELSE 'NO_TRADE' END AS label_name
            FROM (SELECT *, CASE label WHEN 1 THEN 'L' WHEN 2 THEN 'S' ELSE CASE WHEN long_net_return_pct IS NULL AND short_net_return_pct IS NULL THEN NULL WHEN short_net_return_pct IS NULL OR long_net_return_pct >= short_net_return_pct THEN 'L' ELSE 'S' END END AS side
                FROM (SELECT *, CASE WHEN lg AND (NOT sg OR long_net_return_pct >= short_net_return_pct) THEN 1 WHEN sg THEN 2 ELSE 0 END AS label
                    FROM (SELECT *, long_event = 'TP' AND long_net_return_pct > 0 AS lg, short_event = 'TP' AND short_net_return_pct > 0 AS sg FROM {name}_nets)))""",
    }


TRAIN = "split = 'train'"
CTES: dict[str, str] = {
    "trades": "SELECT event_type AS symbol, event_id AS agg_trade_id, 100.0e0 + value / 100.0e0 AS price, (user_id % 40 + 1) * 0.25e0 AS quantity, event_id AS first_trade_id, event_id AS last_trade_id, epoch_us(ts) // 1000 AS timestamp, event_id % 2 = 0 AS buyer_is_maker FROM events",
    "raw": """SELECT symbol, agg_trade_id AS k, CASE WHEN agg_trade_id % 97 = 0 THEN 'agg_trade_id' WHEN agg_trade_id % 89 = 0 THEN '' ELSE agg_trade_id::VARCHAR END AS id_text, agg_trade_id % 83 = 0 AS bad_price, agg_trade_id % 79 = 0 AS no_quantity,
            agg_trade_id % 71 = 0 AS bad_time, CASE WHEN agg_trade_id % 67 = 0 THEN 'maybe' WHEN agg_trade_id % 5 = 0 THEN ' YES ' WHEN agg_trade_id % 7 = 0 THEN 'f' ELSE buyer_is_maker::VARCHAR END AS flag_text, trades.* EXCLUDE (symbol) FROM trades""",
    "clean": """SELECT symbol, k AS agg_trade_id, price, quantity, first_trade_id, last_trade_id, timestamp, CASE WHEN lower(trim(flag_text)) IN ('true','1','t','y','yes') THEN true ELSE false END AS buyer_is_maker
            FROM raw WHERE regexp_full_match(id_text, '[0-9]+') AND NOT bad_price AND NOT no_quantity AND NOT bad_time AND flag_text <> 'maybe'""",
    "measured": "SELECT *, price * quantity AS notional, CASE WHEN buyer_is_maker THEN 0.0e0 ELSE quantity END AS buy_volume, CASE WHEN buyer_is_maker THEN quantity ELSE 0.0e0 END AS sell_volume, CASE WHEN buyer_is_maker THEN 0.0e0 ELSE price * quantity END AS buy_notional, CASE WHEN buyer_is_maker THEN price * quantity ELSE 0.0e0 END AS sell_notional FROM trades",
    "seconds": """SELECT symbol, timestamp // 1000 AS second_s, arg_min(price, timestamp::HUGEINT * 1000000000000 + agg_trade_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, timestamp::HUGEINT * 1000000000000 + agg_trade_id) AS close, count(*) AS trade_count,
            sum(quantity) AS volume, sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume, sum(notional) AS notional_volume, sum(buy_notional) AS buy_notional, sum(sell_notional) AS sell_notional, max(quantity) AS max_trade_size FROM measured GROUP BY ALL""",
    **bars_sql("five", TIMEFRAME_S),
    **bars_sql("hour", 3600),
    "minutes": "SELECT symbol, timestamp // 60000 * 60000 AS open_time, arg_min(price, agg_trade_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, agg_trade_id) AS close FROM trades GROUP BY ALL",
    "klines": "SELECT symbol, open_time, open, high, low, CASE WHEN open_time // 60000 % 3 = 0 THEN close + 1.0e0 ELSE close END AS close, CASE WHEN open_time // 60000 % 3 = 0 THEN open_time + 1 ELSE open_time END AS seq FROM minutes",
    "used": f"""SELECT b.symbol, b.timestamp_s, b.close, coalesce(last_value(k.open_time IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.timestamp_s), f.t0) AS open_time
            FROM five b LEFT JOIN klines k ON k.symbol = b.symbol AND k.open_time = b.timestamp_s // 60 * 60000 JOIN (SELECT symbol, min(open_time) AS t0 FROM klines GROUP BY symbol) f ON f.symbol = b.symbol""",
    "distances": "SELECT u.symbol, u.timestamp_s, u.close, " + ", ".join(f"(u.close - k.{c}) / greatest(k.{c}, {EPS}) AS dist_from_1m_{c}" for c in OHLC.split()) + " FROM used u JOIN klines k USING (symbol, open_time)",
    "rolled": f"""SELECT *, sum(trade_count) OVER w5 AS trade_count_5s, sum(signed_volume) OVER w5 AS signed_volume_5s, sum(notional_volume) OVER w5 AS notional_volume_5s, avg(avg_trade_size) OVER w5 AS avg_trade_size_5s,
            coalesce(stddev_samp(ret_1s) OVER w10, 0.0e0) AS volatility_10s, coalesce(stddev_samp(ret_1s) OVER w30, 0.0e0) AS volatility_30s,
            CASE WHEN count(*) OVER w30 < 5 OR max(notional_volume) OVER w30 = min(notional_volume) OVER w30 THEN 0.0e0 ELSE (notional_volume - avg(notional_volume) OVER w30) / stddev_pop(notional_volume) OVER w30 END AS volume_zscore_30s
            FROM five_returns WINDOW w5 AS (PARTITION BY symbol ORDER BY timestamp_s ROWS 4 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY timestamp_s ROWS 9 PRECEDING), w30 AS (PARTITION BY symbol ORDER BY timestamp_s ROWS 29 PRECEDING)""",
    "hour_rows": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp_s) AS i FROM hour_returns",
    "five_rows": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp_s) AS i FROM five",
    **touch("h", "hour_rows", str(STEPS), e(TP / 100.0), e(SL / 100.0), e(COST)),
    **touch("f", "five_rows", str(STEPS), e(TP / 100.0), e(SL / 100.0), e(COST)),
    **touch("l", "five_rows", "300", e(TP / 100.0), e(SL / 100.0), e(COST)),
    "grid": "SELECT * FROM (VALUES " + ", ".join(f"({h}, {e(t)}, {e(s)})" for h, t, s in SWEEP) + ") g(steps, tp_pct, sl_pct)",
    "hour_grid": "SELECT * FROM hour_rows, grid",
    **{k: v.replace("(SELECT symbol, i, timestamp_s, high, low, close FROM hour_grid)", "hour_rows") for k, v in touch("g", "hour_grid", "steps", "(tp_pct / 100.0e0)", "(sl_pct / 100.0e0)", "0.0005e0", "steps, tp_pct, sl_pct").items()},
    "label_rows": "SELECT o.*, h.* EXCLUDE (symbol, i, close, timestamp_s, side) FROM hour_rows o JOIN h_labelled h USING (symbol, i)",
    "logits": "SELECT *, timestamp_s * 1000 AS timestamp_ms, " + ", ".join(" + ".join([*[f"{c} * ({e(k)})" for c, k in co.items()], f"({e(b)})"]) + f" AS z{i}" for i, (co, b) in enumerate(zip(COEFFICIENTS, INTERCEPTS, strict=True))) + " FROM label_rows",
    "scores": "SELECT *, " + ", ".join(f"exp(z{i} - greatest(z0, z1, z2)) / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))) AS {p}" for i, p in enumerate(("p_no_trade", "p_long", "p_short"))) + ", CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS argmax FROM logits",
    "decided": f"""SELECT *, CASE pred WHEN 1 THEN 'LONG_SETUP' WHEN 2 THEN 'SHORT_SETUP' ELSE 'NO_TRADE' END AS pred_name FROM (SELECT *, CASE WHEN p_long >= {e(THRESHOLDS[0])} AND p_long > p_short AND p_long >= p_no_trade + {e(THRESHOLDS[2])} THEN 1
            WHEN p_short >= {e(THRESHOLDS[1])} AND p_short > p_long AND p_short >= p_no_trade + {e(THRESHOLDS[2])} THEN 2 ELSE 0 END AS pred FROM scores)""",
    "cells": "SELECT s.symbol, a.x AS label, b.x AS pred, count(d.symbol) AS n FROM (SELECT DISTINCT symbol FROM decided) s, (VALUES (0), (1), (2)) a(x), (VALUES (0), (1), (2)) b(x) LEFT JOIN decided d ON d.symbol = s.symbol AND d.label = a.x AND d.pred = b.x GROUP BY ALL",
    "per_class": """SELECT symbol, c.x AS x, sum(n) FILTER (label = x AND pred = x) AS t, sum(n) FILTER (label = x) AS s, sum(n) FILTER (pred = x) AS q FROM cells, (VALUES (0), (1), (2)) c(x) GROUP BY ALL""",
    "rates": "SELECT symbol, x, s, t, CASE WHEN q > 0 THEN t / q ELSE 0.0e0 END AS p, CASE WHEN s > 0 THEN t / s ELSE 0.0e0 END AS r, CASE WHEN s + q > 0 THEN 2 * t / (s + q) ELSE 0.0e0 END AS f FROM per_class",
    "candidates": """SELECT * FROM (SELECT *, CASE pred WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS side, CASE pred WHEN 1 THEN long_event ELSE short_event END AS event, CASE pred WHEN 1 THEN long_net_return_pct ELSE short_net_return_pct END AS return_pct,
            greatest(ceil(time_to_exit_s), 1)::BIGINT AS hold_s FROM decided WHERE pred <> 0) WHERE return_pct IS NOT NULL AND time_to_exit_s IS NOT NULL""",
    "walk": """SELECT symbol, min(timestamp_ms) AS t FROM candidates GROUP BY symbol UNION ALL
            SELECT w.symbol, (SELECT min(n.timestamp_ms) FROM candidates n WHERE n.symbol = w.symbol AND n.timestamp_ms >= w.t + c.hold_s * 1000) FROM walk w JOIN candidates c ON c.symbol = w.symbol AND c.timestamp_ms = w.t WHERE w.t IS NOT NULL""",
    "taken": "SELECT c.*, product(1.0e0 + return_pct / 100.0e0) OVER (PARTITION BY c.symbol ORDER BY c.timestamp_ms) AS equity_after FROM candidates c JOIN walk w ON w.symbol = c.symbol AND w.t = c.timestamp_ms",
    "settings": "SELECT * FROM (VALUES " + ", ".join(f"({e(a)}, {e(b)}, {e(m)})" for a, b, m in GRID) + ") g(long_at, short_at, margin)",
    "decided_all": """SELECT *, CASE WHEN p_long >= long_at AND p_long > p_short AND p_long >= p_no_trade + margin THEN 1 WHEN p_short >= short_at AND p_short > p_long AND p_short >= p_no_trade + margin THEN 2 ELSE 0 END AS pred FROM scores, settings""",
    "candidates_all": """SELECT * FROM (SELECT *, CASE pred WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS side, CASE pred WHEN 1 THEN long_net_return_pct ELSE short_net_return_pct END AS return_pct, greatest(ceil(time_to_exit_s), 1)::BIGINT AS hold_s
            FROM decided_all WHERE pred <> 0) WHERE return_pct IS NOT NULL AND time_to_exit_s IS NOT NULL""",
    "walk_all": """SELECT symbol, long_at, margin, min(timestamp_ms) AS t FROM candidates_all GROUP BY symbol, long_at, margin UNION ALL
            SELECT w.symbol, w.long_at, w.margin, (SELECT min(n.timestamp_ms) FROM candidates_all n WHERE n.symbol = w.symbol AND n.long_at = w.long_at AND n.margin = w.margin AND n.timestamp_ms >= w.t + c.hold_s * 1000)
            FROM walk_all w JOIN candidates_all c ON c.symbol = w.symbol AND c.long_at = w.long_at AND c.margin = w.margin AND c.timestamp_ms = w.t WHERE w.t IS NOT NULL""",
    "taken_all": "SELECT c.*, product(1.0e0 + return_pct / 100.0e0) OVER (PARTITION BY c.symbol, c.long_at, c.margin ORDER BY c.timestamp_ms) AS equity_after FROM candidates_all c JOIN walk_all w ON w.symbol = c.symbol AND w.long_at = c.long_at AND w.margin = c.margin AND w.t = c.timestamp_ms",
    "dirty": """SELECT event_type AS symbol, CASE WHEN event_id % 53 <> 0 THEN epoch_us(ts) // 600000000 * 600000 END AS timestamp_ms, CASE WHEN event_id % 41 <> 0 THEN event_id % 3 END::INT AS label, CASE WHEN event_id % 37 <> 0 THEN value END AS close,
            user_id::DOUBLE AS f1, CASE WHEN event_id % 31 = 0 THEN 'nan'::DOUBLE WHEN event_id % 29 = 0 THEN 'inf'::DOUBLE ELSE value END AS f2, event_id AS ingest_seq FROM events""",
    "once": "SELECT * FROM dirty WHERE timestamp_ms IS NOT NULL AND label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, timestamp_ms ORDER BY ingest_seq DESC) = 1",
    "once_closed": "SELECT * FROM dirty WHERE timestamp_ms IS NOT NULL AND label IS NOT NULL AND close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, timestamp_ms ORDER BY ingest_seq DESC) = 1",
    "finite": "SELECT * REPLACE (close::FLOAT AS close, f1::FLOAT AS f1, f2::FLOAT AS f2) FROM once_closed WHERE isfinite(f1) AND isfinite(f2)",
    "windows": "SELECT symbol, timestamp_ms, label, " + ", ".join(f"lag({c}, {3 - k}) OVER w AS x{3 * k + j}" for k in range(4) for j, c in enumerate(("close", "f1", "f2"))) + " FROM finite WINDOW w AS (PARTITION BY symbol ORDER BY timestamp_ms) QUALIFY row_number() OVER w >= 4",
    "parts": f"SELECT *, CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * {e(0.7 + 0.15)}) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM windows)",
    "moments": "SELECT " + ", ".join(f"avg(x{i}::DOUBLE) AS m{i}, CASE WHEN stddev_pop(x{i}::DOUBLE) < 1e-12 THEN 1.0e0 ELSE stddev_pop(x{i}::DOUBLE) END AS s{i}" for i in range(12)) + " FROM parts WHERE split = 'train'",
}


def units(w: np.ndarray, b: np.ndarray, x: str) -> str:
    """A list of w x + b."""
    held = ", ".join("{'w': [" + ", ".join(e(v) for v in row) + "], 'b': " + e(shift) + "}" for row, shift in zip(w, b, strict=True))
    return f"[list_inner_product(u.w, {x}) + u.b for u in [{held}]]"


def gelu(x: str) -> str:
    """Of a list; erf(v) is exp(-v^2) times the sum of v^(2n+1) over gamma(n + 3/2), all of one sign."""
    return f"[v * 0.5e0 * (1 + exp(-v * v / 2) * list_sum([pow(v / sqrt(2.0e0), 2 * n + 1) / gamma(n + 1.5e0) for n in range(100)])) for v in {x}]"


def mlp_ctes() -> dict[str, str]:
    """The forward pass of mlp_weights() over the standardized windows, a table a layer. Gains are 1 and shifts 0."""
    w = mlp_weights()
    keys = "symbol, timestamp_ms, label, split"
    x = ", ".join(f"((x{i}::DOUBLE - m{i}::FLOAT::DOUBLE) / s{i}::FLOAT::DOUBLE)::FLOAT::DOUBLE" for i in range(12))
    out, last = {"net_in": f"SELECT {keys}, [{x}] AS h FROM parts, moments"}, "net_in"
    for block in (0, 1):
        for part in "ab":
            name, source = f"net_{block}{part}", "h" if part == "a" else "z"
            out[f"{name}_sum"] = f"SELECT *, {units(w[f'w{block}{part}'], w[f'b{block}{part}'], source)} AS y FROM {last}"
            out[f"{name}_norm"] = f"SELECT * EXCLUDE (y), [(v - list_avg(y)) / sqrt(list_var_pop(y) + 1e-5) for v in y] AS y FROM {name}_sum"
            out[name] = f"SELECT {keys}, h, {gelu('y')} AS z FROM {name}_norm"
            last = name
        out[f"net_{block}"] = f"SELECT {keys}, " + ("z" if block == 0 else "[z[k] + h[k] for k in range(1, 17)]") + f" AS h FROM {last}"
        last = f"net_{block}"
    out["net_head_sum"] = f"SELECT {keys}, {units(w['hw1'], w['hb1'], 'h')} AS y FROM {last}"
    out["net_head"] = f"SELECT {keys}, {gelu('y')} AS y FROM net_head_sum"
    out["net_out"] = f"SELECT {keys}, {units(w['hw2'], w['hb2'], 'y')} AS y FROM net_head"
    return out


CTES |= mlp_ctes()


def weights(source: str, where: str = "true") -> str:
    return f"SELECT label, (sum(n) OVER ()) / (3 * n) AS weight FROM (SELECT c.x AS label, greatest(count(p.label), 1) AS n FROM (VALUES (0), (1), (2)) c(x) LEFT JOIN (SELECT label FROM {source} WHERE {where}) p ON p.label = c.x GROUP BY c.x)"


def summary(taken: str, base: str, keys: str) -> str:
    """One row per key of base; drawdown and ratios from the taken trades."""
    k = ", ".join(keys.split())
    on = " AND ".join(f"s.{x} = t.{x}" for x in keys.split())
    return f"""WITH s AS (SELECT DISTINCT {k} FROM {base}), p AS (SELECT *, 1.0e0 - equity_after / greatest(1.0e0, max(equity_after) OVER (PARTITION BY {k} ORDER BY timestamp_ms)) AS fall FROM {taken})
        SELECT {', '.join('s.' + x for x in keys.split())}, count(t.symbol) AS trade_count, count(*) FILTER (t.side = 'LONG') AS long_count, count(*) FILTER (t.side = 'SHORT') AS short_count,
            round(coalesce(count(*) FILTER (return_pct > 0) * 100.0e0 / nullif(count(t.symbol), 0), 0.0e0), 6) AS win_rate_pct, round(coalesce(avg(return_pct), 0.0e0), 6) + 0.0e0 AS avg_return_pct,
            round((coalesce(product(1.0e0 + return_pct / 100.0e0), 1.0e0) - 1.0e0) * 100.0e0, 6) + 0.0e0 AS cumulative_return_pct, round(coalesce(sum(return_pct) FILTER (return_pct > 0), 0.0e0), 6) AS gross_profit_pct,
            round(abs(coalesce(sum(return_pct) FILTER (return_pct < 0), 0.0e0)), 6) AS gross_loss_pct, round(coalesce(avg(hold_s), 0.0e0), 6) AS avg_hold_s,
            round(CASE WHEN count(t.symbol) = 0 THEN 0.0e0 WHEN coalesce(sum(return_pct) FILTER (return_pct < 0), 0.0e0) < 0 THEN coalesce(sum(return_pct) FILTER (return_pct > 0), 0.0e0) / -sum(return_pct) FILTER (return_pct < 0) ELSE 'inf'::DOUBLE END, 6) AS profit_factor,
            round(greatest(coalesce(max(fall), 0.0e0), 0.0e0) * 100.0e0, 6) + 0.0e0 AS max_drawdown_pct,
            round(CASE WHEN count(t.symbol) < 2 OR stddev_samp(return_pct / 100.0e0) <= 1e-12 THEN 0.0e0 ELSE avg(return_pct / 100.0e0) / stddev_samp(return_pct / 100.0e0) * sqrt(count(t.symbol)) END, 6) + 0.0e0 AS sharpe
        FROM s LEFT JOIN p t ON {on} GROUP BY ALL"""


def day(ms: str) -> str:
    return f"(make_timestamp(({ms}) * 1000))::DATE"


LABEL_COLS = "exit_reason, label, label_name, long_event, short_event"
LABEL_NUMS = "time_to_exit_s long_net_return_pct short_net_return_pct long_horizon_return_pct short_horizon_return_pct future_max_upside_pct future_max_downside_pct"
PARAMS = f"{STEPS} AS horizon_steps, {{tf}}::BIGINT * {STEPS} AS horizon_seconds, {{tf}}::BIGINT * {STEPS} AS horizon_s, {e(TP)} AS take_profit_pct, {e(SL)} AS stop_loss_pct, {e(FEE)} AS fee_pct, {e(SLIP)} AS slippage_pct"
TIMES = "strftime(make_timestamp(timestamp_s * 1000000), '%Y-%m-%d %H:%M:%S') || '+00:00' AS timestamp, timestamp_s * 1000 AS timestamp_ms"
STAMP = "data/[a-z]+_(\\d{8}_\\d{6})__(\\d{8}_\\d{6})\\.csv"
ORDERS = [(c, "CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END" if c == "o_custkey" else c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]
LABELS_5M = f"SELECT a.symbol, {TIMES.replace('timestamp_s', 'a.timestamp_s')}, a.timestamp_s, {TIMEFRAME_S}::BIGINT AS timeframe_s, {LABEL_COLS}, {PARAMS.format(tf=TIMEFRAME_S)}, {r(' '.join('h.' + c for c in LABEL_NUMS.split()) + ' a.open a.high a.low a.close')} FROM five_rows a JOIN f_labelled h USING (symbol, i)"
FINAL: dict[str, str] = {
    "trades_sanitized": "SELECT * FROM clean",
    "flags_lenient": "SELECT symbol, k::VARCHAR AS last_trade_id, lower(trim(flag_text)) IN ('true','1') AS flag, CASE WHEN lower(trim(flag_text)) IN ('true','1','t','y','yes') THEN true WHEN lower(trim(flag_text)) IN ('false','0','f','n','no') THEN false END AS strict FROM raw",
    "range_filter": f"SELECT * FROM trades WHERE timestamp >= {START_MS + 3 * DAY} AND timestamp < {START_MS + 5 * DAY + 1}",
    "timeframes": "SELECT event_id, ' ' || (user_id % 30) || substr('smhdSM', event_id % 6 + 1, 1) AS text, CASE WHEN user_id % 30 > 0 THEN (user_id % 30) * CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 4 THEN 1 WHEN 5 THEN 60 END END AS seconds FROM events",
    "time_keys": f"SELECT agg_trade_id, timestamp, timestamp // 1000 AS second_s, timestamp // 60000 * 60000 AS minute_ms, {day('timestamp')} AS day, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d %H:%M:%S') || '+00:00' AS iso, strftime(make_timestamp(timestamp * 1000), '%Y%m%d_%H%M%S') AS stamp FROM trades",
    "day_spine": f"SELECT d.day, count(t.symbol) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN trades t ON {day('t.timestamp')} = d.day GROUP BY d.day",
    "trade_measures": f"SELECT symbol, agg_trade_id, first_trade_id, last_trade_id, timestamp, buyer_is_maker, {r('price quantity notional buy_volume sell_volume buy_notional sell_notional')} FROM measured",
    "second_aggregates": f"SELECT symbol, second_s, trade_count, {r(OHLC + ' ' + AMOUNTS)} FROM seconds",
    "merge_partials": f"SELECT symbol, minute_s, trade_count, {r(OHLC + ' ' + AMOUNTS)} FROM (SELECT symbol, second_s // 60 * 60 AS minute_s, min_by(open, second_s) AS open, max(high) AS high, min(low) AS low, max_by(close, second_s) AS close, sum(trade_count)::BIGINT AS trade_count, "
    + ", ".join(f"sum({c}) AS {c}" for c in AMOUNTS.split()[:-1])
    + ", max(max_trade_size) AS max_trade_size FROM seconds GROUP BY ALL)",
    "bar_spine": f"SELECT symbol, unnest(range({START_S}, {-(-(END_MS - 1500) // 1000)}, {7 * 3600}))::BIGINT AS timestamp_s FROM (SELECT DISTINCT symbol FROM trades)",
    "bars_5m": f"SELECT symbol, timestamp_s, trade_count, {r(OHLC + ' ' + AMOUNTS + ' avg_trade_size signed_volume trade_imbalance buy_sell_ratio vwap price_range')} FROM five_ratios",
    "bars_repeated_trades": f"SELECT symbol, timestamp_s, trade_count, {r(OHLC + ' ' + AMOUNTS)} FROM five",
    "trades_unique": f"""SELECT symbol, agg_trade_id, timestamp, buyer_is_maker, {r('price quantity')} FROM (SELECT * FROM trades UNION ALL SELECT * REPLACE (price + (agg_trade_id % 3 - 1) * 0.5e0 AS price) FROM trades
        UNION ALL SELECT * REPLACE (quantity + (agg_trade_id % 2) * 0.25e0 AS quantity, NOT buyer_is_maker AS buyer_is_maker) FROM trades) QUALIFY row_number() OVER (PARTITION BY symbol, agg_trade_id ORDER BY timestamp DESC, price DESC, quantity DESC, buyer_is_maker DESC) = 1""",
    "labels_of_overlapping_files": f"SELECT symbol, s::BIGINT * 1000 AS timestamp_ms, CASE WHEN s // 3600 % 2 = 0 THEN 2 ELSE 1 END AS label FROM (SELECT symbol, unnest(range({START_S}, {END_S}, 3600)) AS s FROM (SELECT DISTINCT symbol FROM trades WHERE timestamp >= {START_MS} AND timestamp < {END_MS}))",
    "bars_rollup_1h": f"SELECT symbol, timestamp_s, trade_count, {r(OHLC + ' ' + AMOUNTS)} FROM hour",
    "bars_daily_lineitem": f"""SELECT symbol, day, trade_count, {r(OHLC + ' volume notional_volume max_trade_size')} FROM (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate::DATE AS day, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open, max(l_extendedprice / l_quantity) AS high,
        min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS close, count(*) AS trade_count, sum(l_quantity) AS volume, sum(l_extendedprice / l_quantity * l_quantity) AS notional_volume, max(l_quantity) AS max_trade_size FROM lineitem GROUP BY ALL)""",
    "klines_deduped": f"SELECT symbol, open_time, seq, {r(OHLC)} FROM klines",
    "kline_context": f"SELECT symbol, timestamp_s, {r('close dist_from_1m_open dist_from_1m_high dist_from_1m_low dist_from_1m_close')} FROM distances",
    "features_5m": f"SELECT symbol, {TIMES}, timestamp_s, {TIMEFRAME_S}::BIGINT AS timeframe_s, "
    + ", ".join(f"round(a.{c}::DOUBLE, 6) + 0.0e0 AS {n}" for n, c in {**{c: c for c in OHLC.split()}, **{f"{c}_1s": c for c in "vwap trade_count volume notional_volume buy_volume sell_volume signed_volume trade_imbalance buy_sell_ratio avg_trade_size max_trade_size price_range".split()}, **{c: c for c in "trade_count_5s notional_volume_5s signed_volume_5s avg_trade_size_5s ret_1s ret_3s ret_5s ret_10s volatility_10s volatility_30s volume_zscore_30s".split()}}.items())
    + f", {r('d.dist_from_1m_open d.dist_from_1m_high d.dist_from_1m_low d.dist_from_1m_close')} FROM rolled a JOIN distances d USING (symbol, timestamp_s)",
    "future_outcomes": f"SELECT symbol, timestamp_s * 1000 AS timestamp_ms, {r('future_max_upside_pct future_max_downside_pct long_horizon_return_pct short_horizon_return_pct')} FROM f_events",
    "labels_1h": f"SELECT symbol, {TIMES}, timestamp_s, 3600::BIGINT AS timeframe_s, trade_count, {LABEL_COLS}, {PARAMS.format(tf=3600)}, {r(LABEL_NUMS + ' ' + OHLC + ' ' + AMOUNTS + ' avg_trade_size signed_volume trade_imbalance buy_sell_ratio vwap price_range ret_1s ret_3s ret_5s ret_10s')} FROM label_rows",
    "labels_5m": LABELS_5M,
    "labels_5m_in_chunks": LABELS_5M,
    "labels_long_horizon": LABELS_5M.replace("f_labelled", "l_labelled").replace(f" {STEPS} AS horizon_steps", " 300 AS horizon_steps").replace(f"::BIGINT * {STEPS} AS", "::BIGINT * 300 AS"),
    "labels_by_file": f"SELECT symbol, {TIMES}, timestamp_s, label, label_name, long_event, short_event, exit_reason, {r('close long_net_return_pct short_net_return_pct time_to_exit_s')} FROM label_rows",
    "long_horizon_touch": f"""SELECT symbol, timestamp_s * 1000 AS timestamp_ms, (SELECT min(b.i) FROM five_rows b WHERE b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + 300 AND (b.high >= a.close * (1 + 0.0035e0) OR b.low <= a.close * (1 - 0.0025e0))) - i AS long_step,
        (SELECT min(b.i) FROM five_rows b WHERE b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + 300 AND (b.low <= a.close * (1 - 0.0035e0) OR b.high >= a.close * (1 + 0.0025e0))) - i AS short_step FROM five_rows a""",
    "label_sweep": "SELECT steps, tp_pct, sl_pct, label, count(*) AS n FROM g_labelled GROUP BY ALL",
    "labels_clean": "SELECT symbol, timestamp_ms, label, coalesce(close::VARCHAR, '') AS close, ingest_seq FROM once",
    "labels_clean_closed": "SELECT symbol, timestamp_ms, label, close, ingest_seq FROM once_closed",
    "finite_rows": f"SELECT symbol, timestamp_ms, {r('f1 f2', 3).replace('round(f', 'round(1.0e0 * f')} FROM finite",
    "lookback_windows": "SELECT symbol, timestamp_ms, label, " + ", ".join(f"round(x{i}::DOUBLE, 3) + 0.0e0 AS x{i}" for i in range(12)) + " FROM windows",
    "time_split": "SELECT symbol, timestamp_ms, label, split FROM parts",
    "standardizer": " UNION ALL ".join(f"SELECT {i} AS position, round(m{i}, 4) + 0.0e0 AS mean, round(s{i}, 4) AS std FROM moments" for i in range(12)),
    "slot_statistics": " UNION ALL ".join(f"SELECT {i} AS position, round(m{i}, 4) + 0.0e0 AS mean, round(s{i}, 4) AS std FROM moments" for i in range(12)),
    "standardized": "SELECT symbol, timestamp_ms, label, split, " + ", ".join(f"round((((x{i}::DOUBLE - m{i}::FLOAT::DOUBLE) / s{i}::FLOAT::DOUBLE)::FLOAT)::DOUBLE, 3) + 0.0e0 AS x{i}" for i in range(12)) + " FROM parts, moments",
    "class_weights": f"SELECT label, round(weight, 6) AS weight FROM ({weights('parts', TRAIN)})",
    "softmax_scores": f"SELECT symbol, timestamp_ms, argmax, {r('p_no_trade p_long p_short')} FROM scores",
    "mlp_probabilities": "SELECT symbol, timestamp_ms, label, split, " + ", ".join(f"round(exp(y[{k + 1}] - list_max(y)) / list_sum([exp(v - list_max(y)) for v in y]), 6) AS {p}" for k, p in enumerate(("p_no_trade", "p_long", "p_short"))) + " FROM net_out",
    "log_loss": f"SELECT symbol, round(sum(weight * -ln(greatest(CASE label WHEN 0 THEN p_no_trade WHEN 1 THEN p_long ELSE p_short END, 1e-300))) / sum(weight), 6) AS loss FROM scores JOIN ({weights('scores')}) USING (label) GROUP BY symbol",
    "decisions": "SELECT symbol, timestamp_ms, label, pred, pred_name FROM decided",
    "confusion": "SELECT symbol, label, pred, n FROM cells",
    "classification_report": """SELECT symbol, CASE x WHEN 0 THEN 'NO_TRADE' WHEN 1 THEN 'LONG_SETUP' ELSE 'SHORT_SETUP' END AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s::BIGINT AS support FROM rates
        UNION ALL SELECT symbol, 'accuracy', round(sum(t) / sum(s), 6), round(sum(t) / sum(s), 6), round(sum(t) / sum(s), 6), sum(s)::BIGINT FROM rates GROUP BY symbol
        UNION ALL SELECT symbol, 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(s)::BIGINT FROM rates GROUP BY symbol
        UNION ALL SELECT symbol, 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), sum(s)::BIGINT FROM rates GROUP BY symbol""",
    "class_counts": "SELECT symbol, count(*) FILTER (label = 0) AS no_trade, count(*) FILTER (label = 1) AS long_setup, count(*) FILTER (label = 2) AS short_setup, count(*) FILTER (pred = 0) AS pred_no_trade, count(*) FILTER (pred = 1) AS pred_long, count(*) FILTER (pred = 2) AS pred_short FROM decided GROUP BY symbol",
    "trade_candidates": "SELECT symbol, timestamp_ms, side, event, exit_reason, hold_s, round(return_pct, 6) + 0.0e0 AS return_pct FROM candidates",
    "trades_gated": f"SELECT symbol, timestamp_ms, side, event, exit_reason, hold_s, {r('close p_no_trade p_long p_short return_pct equity_after')} FROM taken",
    "backtest_report": summary("taken", "decided", "symbol"),
    "predictions": f"SELECT symbol, {TIMES.rpartition(',')[0]}, timestamp_ms, label, label_name, pred AS threshold_pred, pred_name AS threshold_pred_name, {r('close p_no_trade p_long p_short')} FROM decided",
    "threshold_sweep": summary("taken_all", "decided_all", "symbol long_at short_at margin"),
    "ingest_report": f"""SELECT s.symbol, s.day, coalesce(p.n, 0) AS parsed, coalesce(k.n, 0) AS kept, coalesce(p.n, 0) - coalesce(k.n, 0) AS dropped, coalesce(k.n, 0) = 0 AS skipped
        FROM (SELECT symbol, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT symbol FROM raw) UNION ALL SELECT DISTINCT symbol, NULL::DATE FROM raw WHERE bad_time) s
        LEFT JOIN (SELECT symbol, CASE WHEN NOT bad_time THEN {day('timestamp')} END AS day, count(*) AS n FROM raw GROUP BY ALL) p ON p.symbol = s.symbol AND p.day IS NOT DISTINCT FROM s.day
        LEFT JOIN (SELECT symbol, {day('timestamp')} AS day, count(*) AS n FROM clean GROUP BY ALL) k ON k.symbol = s.symbol AND k.day = s.day""",
    "klines_by_file": f"SELECT symbol, open_time, open_time AS seq, {r(OHLC)} FROM minutes",
    "features_by_file": f"SELECT o.symbol, o.timestamp_s * 1000 AS timestamp_ms, label, exit_reason, {r('o.close h.time_to_exit_s')} FROM hour_rows o JOIN h_labelled h USING (symbol, i)",
    "labels_refreshed": f"SELECT o.symbol, o.timestamp_s * 1000 AS timestamp_ms, label, exit_reason, {r('o.close h.time_to_exit_s')} FROM hour_rows o JOIN h_labelled h USING (symbol, i)",
    "ingest_counters": "SELECT (SELECT count(*) FROM clean) AS stored, (SELECT count(*) FROM raw) AS parsed, (SELECT count(*) FROM clean) AS kept, (SELECT min(timestamp) FROM clean) AS first_ms, (SELECT max(timestamp) FROM clean) AS last_ms",
    "drop_reasons": f"""SELECT symbol, CASE WHEN NOT bad_time THEN {day('timestamp')} END AS day, reason, count(*) AS n FROM (SELECT *, CASE WHEN NOT regexp_full_match(id_text, '[0-9]+') THEN 'agg_trade_id' WHEN bad_price THEN 'price' WHEN no_quantity THEN 'quantity'
        WHEN bad_time THEN 'timestamp' WHEN flag_text = 'maybe' THEN 'buyer_is_maker' END AS reason FROM raw) WHERE reason IS NOT NULL GROUP BY ALL""",
    "quality_backtest": f"""SELECT symbol, c.name AS "check", c.passed AS passed, round(c.value, 6) AS value FROM (SELECT symbol, unnest([{{'name': 'trade_count', 'passed': trade_count BETWEEN 1 AND 1000000, 'value': trade_count::DOUBLE}},
        {{'name': 'finite_cumulative_return_pct', 'passed': isfinite(cumulative_return_pct), 'value': isfinite(cumulative_return_pct)::INT::DOUBLE}}, {{'name': 'finite_max_drawdown_pct', 'passed': isfinite(max_drawdown_pct), 'value': isfinite(max_drawdown_pct)::INT::DOUBLE}},
        {{'name': 'finite_profit_factor', 'passed': isfinite(profit_factor), 'value': isfinite(profit_factor)::INT::DOUBLE}}, {{'name': 'macro_f1', 'passed': f1 > 0, 'value': f1}}, {{'name': 'predicted_classes', 'passed': k > 1, 'value': k::DOUBLE}}]) AS c
        FROM ({summary("taken", "decided", "symbol")}) JOIN (SELECT symbol, avg(f) AS f1 FROM rates GROUP BY symbol) USING (symbol) JOIN (SELECT symbol, count(DISTINCT pred) AS k FROM decided GROUP BY symbol) USING (symbol))""",
    "quality_order": """SELECT symbol, 'time_order' AS "check", count(*) FILTER (back) = 0 AS passed, (count(*) FILTER (back))::DOUBLE AS value FROM (SELECT symbol, timestamp_ms < lag(timestamp_ms) OVER (PARTITION BY symbol ORDER BY ingest_seq) AS back FROM dirty) GROUP BY symbol""",
    "catalogue_files": """WITH m AS (SELECT o_orderpriority AS symbol, o_orderkey AS id, o_orderdate::DATE AS created, 'data/' || substr(o_orderpriority, 1, 1) || '/' || (o_orderkey % 5000) AS artifact_path FROM orders)
        SELECT 'latest/' || symbol AS tag, id, artifact_path, (SELECT min(n.id) FROM m n WHERE n.artifact_path = q.artifact_path) AS first_id FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY created DESC, id DESC) = 1) q""",
    "profile_orders": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({x} IS NULL) AS missing, round(count(*) FILTER ({x} IS NULL) * 100.0e0 / count(*), 6) AS missing_pct FROM orders" for c, x in ORDERS),
    "class_distribution": "SELECT value, n, round(n * 100.0e0 / sum(n) OVER (), 6) AS pct FROM (SELECT coalesce(CASE WHEN doc_id % 7 <> 0 THEN quality END::VARCHAR, 'NULL') AS value, count(*) AS n FROM labels GROUP BY 1)",
    "catalog_lookup": "SELECT o_orderpriority AS symbol, arg_max(o_orderkey, (o_orderdate::DATE, o_orderkey)) AS newest, count(*) AS n, count(*) FILTER (o_orderdate::DATE < DATE '1995-06-30' AND DATE '1995-01-01' < o_orderdate::DATE + 30) AS overlapping FROM orders GROUP BY 1",
    "quality_checks": """WITH q AS (SELECT symbol, count(*) AS n, count(DISTINCT timestamp_s) AS t, count(*) FILTER (label = 1) AS l, count(*) FILTER (label = 2) AS s, count(*) FILTER (close IS NULL OR NOT isfinite(close)) AS o FROM label_rows GROUP BY symbol)
        SELECT symbol, 'unique_times' AS "check", n = t AS passed, (n - t)::DOUBLE AS value FROM q UNION ALL SELECT symbol, 'long_labels', l > 0, l::DOUBLE FROM q UNION ALL SELECT symbol, 'short_labels', s > 0, s::DOUBLE FROM q
        UNION ALL SELECT symbol, 'finite_close', o = 0, o::DOUBLE FROM q UNION ALL SELECT symbol, 'label_share', (l + s) * 20 >= n, round((l + s) / n, 6) FROM q""",
    "prune_by_stamp": f"""SELECT path FROM (SELECT CASE WHEN event_id % 70 = 0 THEN 'data/' || event_type || '.csv' ELSE 'data/' || event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '__' || strftime(ts + INTERVAL 2 DAY, '%Y%m%d_%H%M%S') || '.csv' END AS path,
        event_id % 70 = 0 AS plain, date_trunc('second', ts) AS a, date_trunc('second', ts + INTERVAL 2 DAY) AS b FROM events) WHERE plain OR (epoch_ms(a) < {START_MS + 5 * DAY} AND {START_MS + 3 * DAY} < epoch_ms(b))""",
    "stream_bars": f"SELECT symbol, hour_s AS timestamp_s, trade_count, {r(OHLC + ' ' + AMOUNTS)} FROM (SELECT symbol, second_s // 3600 * 3600 AS hour_s, min_by(open, second_s) AS open, max(high) AS high, min(low) AS low, max_by(close, second_s) AS close, sum(trade_count)::BIGINT AS trade_count, "
    + ", ".join(f"sum({c}) AS {c}" for c in AMOUNTS.split()[:-1])
    + ", max(max_trade_size) AS max_trade_size FROM seconds GROUP BY ALL) WHERE (hour_s + 3600) * 1000 <= (SELECT max(timestamp) FROM trades) - 600000",
    "stream_filled_bars": f"SELECT symbol, timestamp_s, trade_count, {r(OHLC + ' ' + AMOUNTS)} FROM hour WHERE (timestamp_s + 3600) * 1000 <= (SELECT max(timestamp) FROM trades WHERE timestamp >= {START_MS} AND timestamp < {END_MS}) - 600000",
    "trades_by_file": "SELECT 'all' AS symbol, * EXCLUDE (symbol) FROM clean",
    "trades_by_archive": "SELECT * FROM clean",
    "trades_by_day": f"SELECT symbol, {day('timestamp')} AS day, count(*) AS n FROM (SELECT *, count(*) FILTER (symbol = 'click' AND agg_trade_id % 2 = 0) OVER (PARTITION BY symbol, {day('timestamp')}) AS again FROM trades) WHERE again = 0 OR agg_trade_id % 2 = 0 GROUP BY ALL",
    "consolidate_days": f"SELECT t.*, {day('timestamp')} AS day FROM trades t WHERE {day('timestamp')} BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' AND (symbol, {day('timestamp')}) NOT IN (SELECT (symbol, {day('timestamp')}) FROM trades WHERE agg_trade_id % 211 = 0)",
}


def full(final: str) -> str:
    """The statement with the CTEs that it needs, in order."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(CTES[name])

    visit(final)
    if not need:
        return final
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in need)
    return f"WITH RECURSIVE {ctes}{', ' + final[5:] if final.startswith('WITH ') else ' ' + final}"


def oracle_sql() -> dict[str, str]:
    return {name: full(text) for name, text in FINAL.items()}
