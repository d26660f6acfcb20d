"""Unit cases, brute force on random small inputs, and invariances."""

import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.functions import scalars
from tickspark.operators import backtest, bars, dataset, evaluate, features, labels, quality, refresh, scoring
from tickspark.sources import archives, files
from tickspark.streaming.bars import stream_bars, stream_filled_bars

T0 = 1_704_067_200_000
TRADE = "symbol string, agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, timestamp long, buyer_is_maker boolean"


def trades(spark, rows):
    """rows: symbol, id, price, quantity, ms after T0, maker flag."""
    return spark.createDataFrame([(s, i, float(p), float(q), i, i, T0 + ms, m) for s, i, p, q, ms, m in rows], TRADE)


def some_trades(n, seconds, seed):
    rng = random.Random(seed)
    return [("ab"[rng.random() < 0.3], i, round(100 + rng.random() * 5, 2), rng.randrange(1, 9) * 0.25, rng.randrange(seconds * 1000), rng.random() < 0.5) for i in range(n)]


CSV = {
    "plain": ("1001,43000.1,0.010,1,2,1704067200123,True\n1002,43000.2,0.020,3,4,1704067201123,false\n", [1001, 1002]),
    "header": ("agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n1003,43000.1,0.1,1,2,1704067200123,true\n1004,43001,0.2,3,4,1704067201123,false\n", [1003, 1004]),
    "broken": ("1005,43000.1,0.1,1,2,1704067200123,true\nx,what,no,1,2,soon,maybe\n1006,43001,0.2,3.9,4,1704067201123,no,more\n1007,43001\n", [1005, 1006]),
}


@pytest.mark.parametrize("kind", CSV)
@pytest.mark.parametrize("zipped", [False, True])
def test_trade_files(spark, tmp_path, kind, zipped):
    text, ids = CSV[kind]
    if zipped:
        with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
            z.writestr("readme.txt", "no trades")
            z.writestr("day.csv", text)
        raw = files.read_trades_zip(spark, str(tmp_path / "day.zip"), "x", chunk=1)
    else:
        (tmp_path / "day.csv").write_text(text)
        raw = files.read_trades_csv(spark, str(tmp_path / "day.csv"), "x")
    got = files.sanitize_trades(raw).orderBy("agg_trade_id").collect()
    assert [r.agg_trade_id for r in got] == ids
    assert dict(files.sanitize_trades(raw).dtypes) == {**files.TRADE_COLUMNS, "symbol": "string"}
    if kind == "broken":
        assert got[1].first_trade_id == 3 and got[1].buyer_is_maker is False


def test_zip_without_csv_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
        z.writestr("readme.txt", "no trades")
    with pytest.raises(Exception, match=r"no \.csv"):
        files.read_trades_zip(spark, str(tmp_path / "day.zip"), "x").collect()


def test_archives_in_capitals_and_quoted_fields(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
        z.writestr("DAY.CSV", '"7","1.5",2,3,4,5000,"true",more\n8,1.5,2\n')
    raw = files.read_trades_zip(spark, str(tmp_path / "day.zip"), "x")
    assert [tuple(r)[:7] for r in raw.collect()] == [("7", "1.5", "2", "3", "4", "5000", "true"), ("8", "1.5", "2", None, None, None, None)]
    assert [r.agg_trade_id for r in files.sanitize_trades(raw).collect()] == [7]


def test_files_out_of_range_are_not_read(spark, tmp_path):
    line = "{},1.5,2,3,4,1704067200000,true\n"
    for i, name in enumerate(("aggtrades_20240101_000000__20240102_000000.csv", "aggtrades_20240102_000000__20240103_000000.csv", "old.csv", "notes.txt")):
        (tmp_path / name).write_text(line.format(i))
    day = 86_400_000
    read = lambda a, b: sorted(int(r.agg_trade_id) for r in files.read_trades_in_range(spark, str(tmp_path), "x", T0 + a, T0 + b).collect())
    assert (read(0, day), read(day, 2 * day), read(-day, 5 * day), read(9 * day, 10 * day)) == ([0, 2], [1, 2], [0, 1, 2], [2])
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no trade file"):
        files.read_trades_in_range(spark, str(tmp_path / "none"), "x", 0, 1)


def test_archives_out_of_range_are_never_opened(spark, tmp_path):
    for day, line in (("2024-01-01", "1,1,1,1,1,1704067200000,true"), ("2024-01-02", "2,1,1,1,1,1704153600000,true\n3,1,1,1,1,1704153600001,false,more")):
        with zipfile.ZipFile(tmp_path / f"a-{day}.zip", "w") as z:
            z.writestr("t.csv", line)
    (tmp_path / "a-2024-01-03.zip").write_text("no archive at all")
    (tmp_path / "a-20240104_000000__20240105_000000.zip").write_text("nor this")
    day = 86_400_000
    ids = lambda first, last: sorted(r.agg_trade_id for r in archives.read_archives(spark, str(tmp_path), first, last).collect())
    assert ids(T0, T0 + 2 * day) == ["1", "2", "3"] and ids(T0 + day, T0 + 2 * day) == ["2", "3"] and ids(T0 - day, T0) == []
    later = archives.read_archives(spark, str(tmp_path)).where((F.col("last_ms") > T0 + day) & (F.col("first_ms") < T0 + 2 * day) & (F.col("agg_trade_id") == "3"))
    assert later.select("agg_trade_id", "buyer_is_maker").collect() == [("3", "false")]
    with pytest.raises(Exception, match="not a zip file"):
        ids(T0, T0 + 3 * day)
    with pytest.raises(Exception, match="no archive"):
        archives.read_archives(spark, str(tmp_path / "*.none")).collect()


def test_spans_of_names():
    assert archives.span_of("x/a-2024-01-01.zip") == (T0, T0 + 86_400_000)
    assert archives.span_of("x/20240101_000000__20240101_000001.zip") == (T0, T0 + 1000)
    assert archives.span_of("x/2024-13-01.zip") == archives.span_of("2024-01-01/a.zip") == archives.EVER


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_archives_hold_what_was_written(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    texts = ["1", " 2 ", 'a "quoted", text', "two\nlines", "", "é"]
    rows = [(rng.choice(["a", "b/c", "-"]), *[rng.choice(texts) for _ in range(5)], rng.choice([str(T0), str(T0 + 86_400_000), "soon"]), "true") for _ in range(60)]
    columns = list(files.TRADE_COLUMNS)
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("symbol", *columns)))
    archives.write_archives(raw, str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == sorted({f"{s.replace('/', '%2F')}-{ {str(T0): '2024-01-01', str(T0 + 86_400_000): '2024-01-02'}.get(t, 'undated')}.zip" for s, *_, t, _ in rows})
    got = files.read_trades_zip(spark, str(tmp_path / "out" / "*.zip"), "x", chunk).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(r[1:] for r in rows)
    archives.write_archives(raw.limit(0), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == names


def test_empty_and_odd_archives(spark, tmp_path):
    for name, text in (("empty", ""), ("blank", "\n\n"), ("odd", "1,2\n,\n1,2,3,4,5,6,7,8,9\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("t.CSV", text)
    got = sorted((tuple(r)[:7] for r in archives.read_archives(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("1", "2", *[None] * 5), ("", "", *[None] * 5), ("1", "2", "3", "4", "5", "6", "7")], key=str)


def test_no_day_left_is_an_error(spark):
    daily = spark.sql("select 'a' symbol, date'2024-01-01' day")
    assert files.consolidate_days(daily, daily, T0, T0 + 1).count() == 0
    with pytest.raises(ValueError, match="no daily rows"):
        files.consolidate_days(daily, daily, T0, T0 + 1, strict=True)


def test_label_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("timestamp_ms,label,f1\n1000,0,1.0\n1000,1,2.0\nsoon,1,2.5\n5000,2,3.0\n6000,,3.0\n")
    rows = dataset.clean_labels(files.read_labels(spark, str(tmp_path / "l.csv"), training=True).withColumn("symbol", F.lit("a")))
    assert sorted((r.timestamp_ms, r.label, r.f1) for r in rows.collect()) == [(1000, 1, "2.0"), (5000, 2, "3.0")]
    with pytest.raises(ValueError, match="missing"):
        files.read_labels(spark, str(tmp_path / "l.csv"))
    with pytest.raises(ValueError, match="no label rows"):
        dataset.clean_labels(rows.where("label > 7"), strict=True)


def test_the_last_of_several_label_files_wins(spark, tmp_path):
    """In the order of the list, whatever the files' sizes, their splits and their tasks."""
    head = "timestamp_ms,label,f1\n"
    (tmp_path / "1 first.csv").write_text(head + "1000,0,1.0\n")
    (tmp_path / "2_second.csv").write_text(head + "".join(f"{t},1,0.5\n" for t in range(2000, 9000)) + "1000,1,2.0\n1000,2,3.0\n")
    folder = tmp_path / "3_folder"
    folder.mkdir()
    (folder / "part-1.csv").write_text(head + "2000,2,1.0\n" + "".join(f"{t},0,0.5\n" for t in range(9000, 9900)))
    (folder / "part-0.csv").write_text(head + "2000,0,1.0\n")
    paths = [str(tmp_path / "1 first.csv"), str(tmp_path / "2_second.csv"), str(folder)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def kept(order, size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = files.read_labels(spark, [paths[i] for i in order], training=True).withColumn("symbol", F.lit("a"))
        return {r.timestamp_ms: r.label for r in dataset.clean_labels(rows).where("timestamp_ms in (1000, 2000, 9000)").collect()}

    try:
        for size in (before, "1000", "20000"):
            assert kept((0, 1, 2), size) == {1000: 2, 2000: 2, 9000: 0}
            assert kept((2, 1, 0), size) == {1000: 0, 2000: 1, 9000: 0}
            assert kept((1, 0, 2), size) == {1000: 0, 2000: 2, 9000: 0}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert files.read_labels(spark, str(tmp_path / "[12]*.csv"), training=True).count() == 7003


def test_write_daily_replaces_whole_days(spark, tmp_path):
    path = str(tmp_path / "daily")
    files.write_daily(trades(spark, [("a", 1, 1, 1, 0, True), ("a", 2, 1, 1, 1, True), ("a", 3, 1, 1, 86_400_000, True)]), path)
    files.write_daily(trades(spark, [("a", 9, 1, 1, 5, True)]), path)
    assert sorted(r.agg_trade_id for r in spark.read.parquet(path).collect()) == [3, 9]


def test_readers(spark, tmp_path):
    (tmp_path / "k.csv").write_text("open_time,open,high,low,close\n60000,1,2,0.5,1.5\n")
    assert files.read_klines(spark, str(tmp_path / "k.csv")).first().close == 1.5
    (tmp_path / "f.csv").write_text("timestamp_ms,timestamp_s,timeframe_s,open,high,low,close\n0,0,300,1,2,1,1\n5,x,300,1,1,1,1\n")
    assert files.read_features(spark, str(tmp_path / "f.csv")).count() == 1
    (tmp_path / "g.csv").write_text("timestamp_ms\n0\n")
    with pytest.raises(ValueError, match="missing"):
        files.read_features(spark, str(tmp_path / "g.csv"))


def test_timeframes(spark):
    assert [scalars.parse_timeframe(x) for x in ("5m", " 1H ", "30s")] == [300, 3600, 30]
    for bad in ("0m", "m", "5d", ""):
        with pytest.raises(ValueError):
            scalars.parse_timeframe(bad)


def dense_bars(rows, tf, seconds):
    """Bars by a walk over every second, per symbol."""
    out = {}
    for symbol in {r[0] for r in rows}:
        by = {}
        for _, i, p, q, ms, _ in sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[4], r[1])):
            by.setdefault(ms // 1000, []).append((p, q))
        last = by[min(by)][-1][0]
        for b in range(0, seconds, tf):
            line, volume = [], 0.0
            for s in range(b, min(b + tf, seconds)):
                prices = [p for p, _ in by[s]] if s in by else [last]
                line.append((prices[0], max(prices), min(prices), prices[-1]))
                volume += sum(q for _, q in by.get(s, []))
                last = prices[-1]
            out[symbol, T0 // 1000 + b] = (line[0][0], max(x[1] for x in line), min(x[2] for x in line), line[-1][3], volume)
    return out


@pytest.mark.parametrize("seed,tf", [(1, 5), (2, 7), (3, 60)])
def test_bars_equal_dense_fill(spark, seed, tf):
    rows = some_trades(60, 200, seed)
    got = bars.build_bars(trades(spark, rows), tf, T0, T0 + 200_000).collect()
    want = dense_bars(rows, tf, 200)
    assert {(r.symbol, r.timestamp_s): (r.open, r.high, r.low, r.close, r.volume) for r in got} == want


@pytest.mark.parametrize("chunk", [1, 3, 8, 100])
def test_gaps_filled_in_chunks(spark, chunk):
    """Few trades, so that whole chunks have none, ahead of a symbol's first trade and after its last too; equal to the dense fill and to bars on a spine."""
    rows = some_trades(4, 200, 11) + [("late", 1, 50.0, 1.0, 150_500, True), ("early", 1, 60.0, 1.0, 0, True), ("early", 2, 61.0, 1.0, 199_999, True)]
    made = bars.build_bars(trades(spark, rows), 7, T0, T0 + 200_000, chunk=chunk)
    got = made.collect()
    assert {(r.symbol, r.timestamp_s): (r.open, r.high, r.low, r.close, r.volume) for r in got} == dense_bars(rows, 7, 200) and len(got) == 29 * len({r[0] for r in rows})
    spine = bars.bar_spine(trades(spark, rows).select("symbol").distinct(), T0, T0 + 200_000, 7)
    on_spine = bars.fill_bars(spine, bars.traded_bars(trades(spark, rows), 7, T0, T0 + 200_000)).select(made.columns)
    assert sorted(map(tuple, on_spine.collect())) == sorted(map(tuple, got))
    assert bars.build_bars(trades(spark, rows).limit(0), 7, T0, T0 + 200_000, chunk=chunk).count() == 0


def test_trades_are_read_once_for_bars(spark, tmp_path):
    """One scan and no join, whole histories or chunks: of the trades, or of the bars written from them."""
    trades(spark, some_trades(30, 200, 2)).write.parquet(str(tmp_path / "t"))
    plan = bars.build_bars(spark.read.parquet(str(tmp_path / "t")), 7, T0, T0 + 200_000, unique=True)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    plan = bars.build_bars(spark.read.parquet(str(tmp_path / "t")), 7, T0, T0 + 200_000, chunk=5)._jdf.queryExecution().sparkPlan().toString()
    assert str(tmp_path / "t") not in plan


def test_bars_do_not_depend_on_order_or_partitions_and_roll_up(spark):
    rows = some_trades(80, 240, 4)
    one = bars.build_bars(trades(spark, rows), 60, T0, T0 + 240_000)
    two = bars.build_bars(trades(spark, rows[::-1]).repartition(7), 60, T0, T0 + 240_000)
    fine = bars.rollup_bars(bars.build_bars(trades(spark, rows), 10, T0, T0 + 240_000), 60, T0)
    cols = ["symbol", "timestamp_s", "open", "high", "low", "close", "trade_count"]
    got = [sorted(map(tuple, x.select(cols).collect())) for x in (one, two, fine)]
    assert got[0] == got[1] == got[2]
    with pytest.raises(ValueError):
        bars.build_bars(trades(spark, rows), 60, T0, T0)


def test_repeated_trades_count_once(spark):
    rows = some_trades(50, 600, 3)
    once, twice = trades(spark, rows), trades(spark, rows + rows[::2])
    bars_of = lambda t, **more: sorted(tuple(r) for r in bars.build_bars(t, 60, T0, T0 + 600_000, **more).select("symbol", "timestamp_s", "open", "high", "low", "close", "trade_count", F.round("volume", 9)).collect())
    assert bars_of(twice) == bars_of(once) == bars_of(once, unique=True) != bars_of(twice, unique=True)


def test_ties_of_a_trade_have_one_winner(spark):
    """Rows of one id and time: the dearest, then the largest, as a whole row, in any order."""
    rows = [("a", 1, 100.0, 2.0, 5, True), ("a", 1, 102.0, 1.0, 5, False), ("a", 1, 102.0, 3.0, 5, False), ("a", 1, 102.0, 3.0, 5, True), ("a", 1, 900.0, 9.0, 4, True), ("a", 2, 1.0, 1.0, 7, True)]
    for seed in range(6):
        got = bars.unique_trades(trades(spark, random.Random(seed).sample(rows, len(rows))).repartition(3)).orderBy("agg_trade_id").collect()
        assert [tuple(r) for r in got] == [("a", 1, T0 + 5, 102.0, 3.0, True), ("a", 2, T0 + 7, 1.0, 1.0, True)]


def test_nothing_in_range_is_an_error_if_asked(spark):
    t = trades(spark, some_trades(5, 60, 3))
    klines = spark.createDataFrame([], "symbol string, open_time long, open double, high double, low double, close double, seq long")
    assert features.build_features(t, None, 60, T0 - 600_000, T0, strict=False).count() == 0
    with pytest.raises(ValueError, match="no trades"):
        features.build_features(t, None, 60, T0 - 600_000, T0, strict=True)
    with pytest.raises(ValueError, match="no klines"):
        features.build_features(t, klines, 60, T0, T0 + 600_000, strict=True)


def test_feature_columns_and_first_returns(spark):
    rows = some_trades(50, 600, 5)
    klines = spark.createDataFrame([("a", T0 + 60_000, 1.0, 2.0, 0.5, 1.5, 1), ("b", T0, 100.0, 101.0, 99.0, 100.0, 1)], "symbol string, open_time long, open double, high double, low double, close double, seq long")
    got = features.build_features(trades(spark, rows), klines, 60, T0, T0 + 600_000)
    assert got.columns == ["symbol", *features.FEATURES, *features.CONTEXT] and len(features.FEATURES) == 31
    first = got.where(f"timestamp_ms = {T0}").collect()
    assert all(r.ret_1s == r.ret_10s == r.volatility_30s == r.volume_zscore_30s == 0 for r in first)
    a = got.where("symbol = 'a'").orderBy("timestamp_ms").collect()
    assert abs(a[0].dist_from_1m_close - (a[0].close - 1.5) / 1.5) < 1e-12  # before any hit, the first kline
    assert abs(a[5].dist_from_1m_high - (a[5].close - 2.0) / 2.0) < 1e-12
    assert len(features.build_features(trades(spark, rows), None, 60, T0, T0 + 600_000).columns) == 32


def test_chunks_change_nothing(spark):
    rows = some_trades(70, 3000, 7)
    klines = spark.createDataFrame([(s, T0 + 60_000 * m, 100.0 + m, 101.0 + m, 99.0, 100.5, m) for s in "ab" for m in (3, 4, 20, 41)], "symbol string, open_time long, open double, high double, low double, close double, seq long")
    whole = features.build_features(trades(spark, rows), klines, 10, T0, T0 + 3_000_000)
    cut = features.build_features(trades(spark, rows), klines, 10, T0, T0 + 3_000_000, chunk=37)
    digits = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert digits(whole) == digits(cut) and whole.count() == 600
    bare = whole.drop(*features.CONTEXT)
    assert digits(labels.build_labels(bare, 5)) == digits(labels.build_labels_in_chunks(bare, 41, 5))


BAR = "symbol string, timestamp string, timestamp_ms long, timestamp_s long, timeframe_s long, open double, high double, low double, close double"


def bar_rows(spark, rows, tf=300):
    return spark.createDataFrame([("a", str(i), 1000 * tf * i, tf * i, tf, float(c), float(h), float(low), float(c)) for i, (h, low, c) in enumerate(rows)], BAR)


def test_chunks_smaller_than_the_reach_of_features(spark):
    frame = trades(spark, some_trades(300, 4000, 12))
    whole, small = (features.build_features(frame, None, 60, T0, T0 + 4_000_000, chunk=c).orderBy("symbol", "timestamp_s").collect() for c in (50_000, 7))
    assert len(whole) == len(small) and all(x == y or abs(x - y) < 1e-9 * max(1, abs(y)) for p, q in zip(whole, small, strict=True) for x, y in zip(p, q, strict=True))


def test_unit_label(spark):
    got = labels.build_labels(bar_rows(spark, [(100, 100, 100), (101, 99.9, 101)]), 1, 0.5, 0.5, 0.0, 0.0).orderBy("timestamp_ms").collect()
    assert (got[0].label_name, got[0].exit_reason, got[0].time_to_exit_s) == ("LONG_SETUP", "TP", 300.0)
    assert (got[1].label, got[1].exit_reason, got[1].time_to_exit_s, got[1].future_max_upside_pct) == (0, "NONE", None, None)
    with pytest.raises(ValueError):
        labels.build_labels(bar_rows(spark, [(1, 1, 1)]), 0)


def walk(bars_, i, steps, tp, sl, cost):
    """Label of bar i by a plain walk: (label, reason, seconds)."""
    e, future = bars_[i][2], bars_[i + 1 : i + 1 + steps]
    if not future:
        return 0, "NONE", None
    sides = {}
    for side in ("long", "short"):
        hit = None
        for k, (h, low, _) in enumerate(future, 1):
            win = h >= e * (1 + tp) if side == "long" else low <= e * (1 - tp)
            lose = low <= e * (1 - sl) if side == "long" else h >= e * (1 + sl)
            if win or lose:
                hit = ("AMBIGUOUS", None, k) if win and lose else ("TP", (tp - cost) * 100, k) if win else ("SL", (-sl - cost) * 100, k)
                break
        c = future[-1][2]
        sides[side] = hit or ("HORIZON", ((c / e if side == "long" else e / c) - 1 - cost) * 100, len(future))
    (lr, ln, lk), (sr, sn, sk) = sides["long"], sides["short"]
    lg, sg = lr == "TP" and ln > 0, sr == "TP" and sn > 0
    if lg and (not sg or ln >= sn):
        return 1, lr, lk
    if sg:
        return 2, sr, sk
    if ln is not None and (sn is None or ln >= sn):
        return 0, lr, lk
    return (0, sr, sk) if sn is not None else (0, "NONE", None)


@pytest.mark.parametrize("seed,tp,sl", [(1, 0.01, 0.01), (2, 0.01, 0.02), (3, 0.03, 0.005)])
def test_labels_equal_a_walk(spark, seed, tp, sl):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        c = 100 + rng.random() * 3
        rows.append((c + rng.random() * 2, c - rng.random() * 2, c))
    got = labels.build_labels(bar_rows(spark, rows), 5, tp * 100, sl * 100, 0.05, 0.0).orderBy("timestamp_ms").collect()
    want = [walk(rows, i, 5, tp * 100 / 100, sl * 100 / 100, 0.05 / 100) for i in range(60)]
    assert [(r.label, r.exit_reason, r.time_to_exit_s) for r in got] == [(a, b, None if k is None else 300.0 * k) for a, b, k in want]
    long = labels.first_touch_long_horizon(bar_rows(spark, rows), 5, tp, sl, chunk=7).orderBy("timestamp_ms").collect()
    short = labels.first_touch_long_horizon(bar_rows(spark, rows), 5, tp, sl, chunk=1000).orderBy("timestamp_ms").collect()
    assert long == short and len(long) == 60
    far = labels.build_labels_long_horizon(bar_rows(spark, rows), 5, tp * 100, sl * 100, 0.05, 0.0, chunk=7)
    near = labels.build_labels(bar_rows(spark, rows), 5, tp * 100, sl * 100, 0.05, 0.0)
    assert far.columns == near.columns
    assert [tuple(r) for r in far.orderBy("timestamp_ms").collect()] == [tuple(r) for r in near.orderBy("timestamp_ms").collect()]


@pytest.mark.parametrize("steps,chunk", [(1, 3), (2, 50), (37, 20), (64, 1000), (300, 90)])
def test_long_horizons_equal_a_search(spark, steps, chunk):
    """The first of many rows ahead that touches, with NaN among them, against a search row by row."""
    rng = random.Random(steps)
    rows = []
    for _ in range(200):
        c = 100 + rng.gauss(0, 1.2)
        rows.append((c + rng.random(), c - rng.random(), c) if rng.random() < 0.95 else (float("nan"), float("nan"), c))
    tp, sl = 0.03, 0.025
    got = labels.first_touch_long_horizon(bar_rows(spark, rows), steps, tp, sl, chunk).orderBy("timestamp_ms").collect()
    for i, r in enumerate(got):
        for side, up, down in (("long", tp, sl), ("short", sl, tp)):
            touched = [(k, h >= rows[i][2] * (1 + up), low <= rows[i][2] * (1 - down)) for k, (h, low, _) in enumerate(rows[i + 1 : i + 1 + steps], 1)]
            first = next(((k, a, b) if side == "long" else (k, b, a) for k, a, b in touched if a or b), None)
            hit = r[f"{side}_hit"]
            assert (hit and (hit.step, hit.tp, hit.sl)) == first, (i, side)


@pytest.mark.parametrize("seed,most", [(1, 1), (2, 3), (3, 20), (4, 500)])
def test_chains_of_records_find_first_reaches(seed, most):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=200).cumsum(), 1)
    x[rng.random(200) < 0.05] = np.nan
    chains = labels.record_chains(x, most)
    start, level = np.arange(200) + 1, np.where(rng.random(200) < 0.05, np.nan, np.where(np.isnan(x), 0.0, x) + rng.choice([-1, 0.0, 0.5, 3], 200))
    got = labels.first_in_chain(x, chains, start, level)
    for i in range(200):
        want = next((j for j in range(i + 1, min(i + 1 + most, 200)) if x[j] >= level[i]), None)
        assert (got[i] == want) if want is not None else (got[i] - i > most or got[i] == 200)


@pytest.mark.parametrize("chunk", [1, 7, 50_000])
def test_sweep_equals_labels_one_by_one(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for _ in range(80):
        c = 100 + rng.random() * 2
        rows.append((float("nan") if rng.random() < 0.03 else c + rng.random(), c - rng.random(), c))
    settings = [(1, 0.2, 0.2), (4, 0.35, 0.25), (12, 1.5, 0.2), (12, 0.2, 1.5), (200, 2.5, 3.0), (5, 0.04, 0.2)]
    got = {(r.steps, r.tp_pct, r.sl_pct, r.label): r.n for r in labels.label_sweep(bar_rows(spark, rows), settings, 0.0005, chunk).collect()}
    want = {}
    for h, tp, sl in settings:
        for r in labels.build_labels(bar_rows(spark, rows), h, tp, sl, 0.05, 0.0).groupBy("label").count().collect():
            want[h, tp, sl, r.label] = r["count"]
    assert got == want and sum(got.values()) == 80 * len(settings)
    assert labels.label_sweep(bar_rows(spark, rows).limit(0), settings).count() == 0


def test_nan_touches_nothing(spark):
    got = labels.build_labels(bar_rows(spark, [(100, 100, 100), (float("nan"), float("nan"), 100)]), 1, 0.5, 0.5).orderBy("timestamp_ms").first()
    assert (got.long_event, got.short_event) == ("HORIZON", "HORIZON")


def test_keep_last_label(spark):
    rows = [("a", "1000", 0, 1.0, "5", 0), ("a", "1000", 1, 2.0, "6", 1), ("a", "5000", 2, 3.0, None, 2)]
    df = spark.createDataFrame(rows, "symbol string, timestamp_ms string, label int, f1 double, close string, ingest_seq long")
    got = dataset.clean_labels(df).orderBy("timestamp_ms").collect()
    assert [(r.timestamp_ms, r.label) for r in got] == [(1000, 1), (5000, 2)]
    assert [r.timestamp_ms for r in dataset.clean_labels(df, need_close=True).collect()] == [1000]


def test_lookback(spark):
    df = spark.createDataFrame([("a", 1000 * k, k, 3.0 * k, 3.0 * k + 1, 3.0 * k + 2) for k in range(10)], "symbol string, timestamp_ms long, label int, a double, b double, c double")
    got = dataset.lookback_windows(df, ["a", "b", "c"], 4).orderBy("timestamp_ms").collect()
    assert len(got) == 7 and got[0].x == [float(i) for i in range(12)] and (got[0].label, got[0].timestamp_ms) == (3, 3000)


def test_chunks_of_lookback_change_nothing(spark):
    df = spark.createDataFrame([(s, 1000 * k * k, k, float(k)) for s in "ab" for k in range(40)] + [("c", 5, 1, 1.0)], "symbol string, timestamp_ms long, label int, a double")
    rows = lambda chunk: sorted((r.symbol, r.timestamp_ms, r.label, tuple(r.x)) for r in dataset.lookback_windows(df, ["a"], 5, chunk=chunk).collect())
    assert rows(2) == rows(7) == rows(50_000) and len(rows(7)) == 72
    with pytest.raises(Exception, match="too few rows for c"):
        dataset.lookback_windows(df, ["a"], 5, strict=True).collect()
    placed = bars.numbered(df, span_ms=100_000).where("symbol = 'a'").orderBy("timestamp_ms").collect()
    assert [r.i for r in placed] == list(range(40)) and {r.n for r in placed} == {40}


def test_standardizer_is_that_of_numpy(spark):
    x = np.random.default_rng(3).normal(5, 2, (50, 4))
    x[:, 3] = 7.5
    got = dataset.fit_standardizer(spark.createDataFrame([(r.tolist(),) for r in x], "x array<float>").repartition(3)).orderBy("position").collect()
    x = x.astype(np.float32).astype(float)
    assert [r.position for r in got] == [0, 1, 2, 3]
    assert np.allclose([r.mean for r in got], x.mean(0)) and np.allclose([r["std"] for r in got], [*x[:, :3].std(0), 1.0])
    assert dataset.fit_standardizer(spark.createDataFrame([], "x array<float>")).count() == 0


@pytest.mark.parametrize("rows_back", [1, 4, 9])
def test_slot_statistics_equal_those_of_windows(spark, rows_back):
    """Symbols of any length, also shorter than a window or with fewer training windows than rows in one."""
    rng = random.Random(rows_back)
    rows = [(s, 1000 * i, rng.gauss(5, 2), 7.0, i % 3) for s, n in (("a", 60), ("b", 13), ("c", 9), ("d", 3), ("e", 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, timestamp_ms long, a double, b double, label int")
    # time_split() refuses short symbols, whose splits are empty
    windows = bars.numbered(dataset.lookback_windows(df, ["a", "b"], rows_back)).withColumn("split", F.when(F.col("i") < F.floor(F.col("n") * 0.7), "train").otherwise("rest"))
    want = dataset.fit_standardizer(windows.where("split = 'train'")).orderBy("position").collect()
    got = dataset.slot_statistics(df, ["a", "b"], rows_back).orderBy("position").collect()
    assert [r.position for r in got] == [r.position for r in want] == list(range(2 * rows_back))
    assert np.allclose([r.mean for r in got], [r.mean for r in want]) and np.allclose([r["std"] for r in got], [r["std"] for r in want])
    assert dataset.slot_statistics(df.limit(0), ["a"], 3).count() == 0


@pytest.mark.parametrize("rows_back,chunk", [(1, 5), (4, 1), (4, 13), (30, 50_000)])
def test_fused_windows_equal_stored_ones(spark, rows_back, chunk):
    rng = np.random.default_rng(rows_back)
    rows = [("ab"[k % 3 == 0], T0 + 1000 * int(t), int(k % 3), float(rng.normal()), float(rng.normal() * 50)) for k, t in enumerate(rng.permutation(150))]
    df = spark.createDataFrame([*rows, ("short", T0, 1, 1.0, 1.0)] if rows_back > 1 else rows, "symbol string, timestamp_ms long, label int, u double, v double")
    width = 2 * rows_back
    w = {"w0a": rng.normal(size=(5, width)), "w0b": rng.normal(size=(5, 5)), "hw1": rng.normal(size=(4, 5)), "hb1": np.zeros(4), "hw2": rng.normal(size=(3, 4)), "hb2": np.zeros(3)}
    w |= {f"{k}0{part}": np.full(5, float(k == "g")) for k in "bgs" for part in "ab"}
    windows = dataset.time_split(dataset.lookback_windows(df, ["u", "v"], rows_back), least=2)
    stats = dataset.fit_standardizer(windows.where("split = 'train'"))
    want = scoring.score_mlp(dataset.apply_standardizer(windows, stats), w).drop("x").orderBy("symbol", "timestamp_ms").toPandas()
    fused = scoring.score_windows(df, ["u", "v"], rows_back, stats, w, least=2, chunk=chunk, batch=7)
    got = fused.orderBy("symbol", "timestamp_ms").toPandas()[list(want.columns)]
    assert len(got) == len(want) > 40 and (got[["symbol", "timestamp_ms", "label", "split"]] == want[["symbol", "timestamp_ms", "label", "split"]]).all().all()
    assert np.allclose(got[scoring.PROBABILITIES], want[scoring.PROBABILITIES], atol=1e-9)
    assert scoring.score_windows(df.limit(0), ["u", "v"], rows_back, stats, w).count() == 0


def test_wrong_number_of_statistics_is_an_error(spark):
    df = spark.createDataFrame([], "symbol string, timestamp_ms long, label int, u double")
    with pytest.raises(ValueError, match="places"):
        scoring.score_windows(df, ["u"], 3, spark.createDataFrame([(0, 0.0, 1.0)], "position int, mean double, std double"), {})


def test_feature_columns_leave_out_outcomes(spark):
    df = labels.build_labels(bar_rows(spark, [(1, 1, 1)] * 3), 1)
    assert dataset.feature_columns(df.schema) == ["close", "timeframe_s", "open", "high", "low"]
    with pytest.raises(ValueError, match="unknown"):
        dataset.feature_columns(df.withColumn("peek", F.lit(1.0)).schema, ["close", "timeframe_s", "open", "high", "low"])


def test_split_sizes_embargo_and_error(spark):
    df = spark.range(200).select(F.lit("a").alias("symbol"), F.col("id").alias("timestamp_ms"))
    count = lambda d: {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    assert count(dataset.time_split(df)) == {"train": 140, "val": 30, "test": 30}
    assert count(dataset.time_split(df, embargo=3)) == {"train": 140, "val": 27, "test": 27}
    with pytest.raises(Exception, match="too few rows"):
        dataset.time_split(df.limit(50)).collect()
    with pytest.raises(Exception, match="an empty split"):
        dataset.time_split(df.limit(3), least=1).collect()


def gate_walk(rows, key=lambda r: r[0]):
    """rows (key, ms, seconds) that a plain walk takes."""
    want = []
    for k in sorted({key(r) for r in rows}):
        free = None
        for r in sorted((r for r in rows if key(r) == k), key=lambda r: (r[1], r[2])):
            if free is None or r[1] >= free:
                want.append(r)
                free = r[1] + r[2] * 1000
    return want


@pytest.mark.parametrize("seed,size,span", [(1, 1, 1000), (2, 7, 10_000), (3, 50_000, 86_400_000), (4, 3, 25_000), (5, 20, 1000), (6, 1, 7000)])
def test_gate_equals_a_walk(spark, seed, size, span):
    """Chunks of any size, holds longer than chunks, gaps and equal times."""
    rng = random.Random(seed)
    rows = [(s, 1000 * t, rng.choice([1, 2, 5, 40, 1 if seed % 2 else 300])) for s in "ab" for t in sorted(rng.choices(range(500), k=120))] + [("c", -5000, 3)]
    got = backtest.gate_trades(spark.createDataFrame(rows, "symbol string, timestamp_ms long, hold_s long"), "symbol", size=size, span_ms=span)
    assert sorted(map(tuple, got.collect())) == sorted(gate_walk(rows))


@pytest.mark.parametrize("size,span", [(1, 1000), (7, 20_000), (50_000, 86_400_000)])
def test_curve_and_drawdown_by_chunks(spark, size, span):
    rng = random.Random(size)
    rows = [(s, 1000 * t, rng.uniform(-3, 3)) for s in "ab" for t in rng.sample(range(300), 60)] + [("c", 0, -10.0), ("d", 0, 4.0)]
    cut = backtest.in_spans(spark.createDataFrame(rows, "symbol string, timestamp_ms long, return_pct double"), "symbol", size=size, span_ms=span)
    assert cut.select("symbol", "chunk").distinct().count() > (4 if size < 100 else 3)
    got = {(r.symbol, r.timestamp_ms): r.equity_after for r in backtest.equity_curve(cut).collect()}
    falls = {r.symbol: r.max_drawdown_pct for r in backtest.max_drawdown(cut).collect()}
    for s in "abcd":
        equity, peak, fall = 1.0, 1.0, 0.0
        for _, t, r in sorted(x for x in rows if x[0] == s):
            equity *= 1 + r / 100
            peak = max(peak, equity)
            fall = max(fall, 1 - equity / peak)
            assert abs(got[s, t] - equity) < 1e-12
        assert abs(falls[s] - 100 * fall) < 1e-9


@pytest.mark.parametrize("size,span", [(1, 1000), (9, 30_000), (50_000, 86_400_000)])
def test_all_settings_at_once_equal_one_by_one(spark, size, span):
    rng = random.Random(size)
    rows = []
    for s in "ab":
        for t in range(150):
            p = [rng.random() for _ in range(3)]
            p = [x / sum(p) for x in p]
            rows.append((s, 1000 * t, *p, rng.choice([None, 0.25, rng.uniform(-1, 1)]), rng.uniform(-1, 1), rng.choice([None, 0.0, 3.0, 20.5])))
    scored = spark.createDataFrame(rows, "symbol string, timestamp_ms long, p_no_trade double, p_long double, p_short double, long_net_return_pct double, short_net_return_pct double, time_to_exit_s double")
    grid = [(0.2, 0.3, 0.0), (0.4, 0.4, 0.05), (0.99, 0.99, 0.0), (0.5, 0.99, -0.5)]
    got = {(r.symbol, r.long_at, r.short_at, r.margin): r for r in backtest.threshold_sweep(scored, grid, size=size, span_ms=span).collect()}
    assert len(got) == 8
    for g in grid:
        decided = evaluate.threshold_decisions(scored, *g).withColumns({c: F.lit("x") for c in ("long_event", "short_event")})
        for one in backtest.backtest_report(decided).collect():
            many = got[(one.symbol, *g)]
            for c in one.asDict():
                assert one[c] == many[c] or abs(one[c] - many[c]) < 1e-9, (g, c, one[c], many[c])


def test_summary_without_trades_or_losses(spark):
    schema = "symbol string, timestamp_ms long, side string, return_pct double, hold_s long"
    none = backtest.trade_summary(spark.createDataFrame([], schema), spark.createDataFrame([("a",)], "symbol string"), "symbol").first()
    assert none.trade_count == 0 and none.profit_factor == 0 and none.win_rate_pct == 0
    curve = backtest.equity_curve(spark.createDataFrame([("a", 1, "LONG", 10.0, 5), ("a", 2, "SHORT", 20.0, 5)], schema))
    won = backtest.trade_summary(curve, spark.createDataFrame([("a",)], "symbol string"), "symbol").first()
    assert math.isinf(won.profit_factor) and abs(won.cumulative_return_pct - 32.0) < 1e-9
    assert backtest.max_drawdown(curve).first().max_drawdown_pct == 0


def test_mlp_scores(spark):
    rng = np.random.default_rng(1)
    w = {}
    for i, (a, b) in enumerate(((6, 5), (5, 5))):
        w |= {f"w{i}a": rng.normal(size=(b, a)), f"b{i}a": rng.normal(size=b), f"g{i}a": np.ones(b), f"s{i}a": np.zeros(b), f"w{i}b": rng.normal(size=(b, b)), f"b{i}b": rng.normal(size=b), f"g{i}b": np.ones(b), f"s{i}b": np.zeros(b)}
    w |= {"hw1": rng.normal(size=(4, 5)), "hb1": np.zeros(4), "hw2": rng.normal(size=(3, 4)), "hb2": np.zeros(3)}
    x = rng.normal(size=(20, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = scoring.score_mlp(df, w).orderBy("id").toPandas()
    assert np.allclose(got[scoring.PROBABILITIES].to_numpy(), scoring.mlp_forward(x, w)) and np.allclose(got[scoring.PROBABILITIES].sum(axis=1), 1)
    assert max(abs(scoring.erf(np.array([z]))[0] - math.erf(z)) for z in np.linspace(-6, 6, 241)) < 1e-10


def test_baseline_learns(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(v) for v in rng.normal(size=4) + 3 * np.eye(4)[k]]) for k in rng.integers(0, 3, 300)]
    df = spark.createDataFrame(rows, "label int, x array<float>")
    model = scoring.fit_baseline(df, dataset.class_weights(df))
    got = scoring.score_baseline(model, df)
    hit = got.withColumn("logits", F.array(*scoring.PROBABILITIES)).withColumn("pred", scoring.argmax_pred()).where("pred = label").count()
    assert hit > 250
    losses = evaluate.weighted_log_loss(got, dataset.class_weights(df)).first().loss
    assert losses < 0.5


def test_catalogue_and_tags(spark, tmp_path):
    (tmp_path / "m1.json").write_text('{\n "id": "d1", "symbol": "a", "created_at": "2024-01-01", "start_date": "2024-01-01", "end_date": "2024-02-01"}')
    (tmp_path / "m2.json").write_text('{\n "id": "d2", "symbol": "a", "created_at": "2024-03-01", "start_date": "2024-02-01", "end_date": "2024-03-01"}')
    m = quality.read_manifests(spark, str(tmp_path))
    got = quality.catalog_lookup(m, "2024-01-15", "2024-01-20").first()
    assert (got.newest, got.n, got.overlapping) == ("d2", 2, 1)
    assert quality.tagged(m, spark.createDataFrame([("best", "d1")], "tag string, target_id string")).first().id == "d1"


def test_stream_equals_batch(spark, tmp_path):
    rows = some_trades(200, 1200, 6)
    source, out = tmp_path / "in", tmp_path / "out"
    frame = trades(spark, sorted(rows, key=lambda r: r[4]))
    for i in range(4):
        frame.where((F.col("timestamp") >= T0 + i * 300_000) & (F.col("timestamp") < T0 + (i + 1) * 300_000)).coalesce(1).write.mode("append").parquet(str(source))
    stream = stream_bars(spark.readStream.schema(TRADE).option("maxFilesPerTrigger", 1).parquet(str(source)), 60, "0 seconds")
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    cols = ["symbol", "timestamp_s", "open", "high", "low", "close", "trade_count"]
    got = sorted(map(tuple, spark.read.parquet(str(out)).select(cols).collect()))
    batch = bars.traded_bars(frame, 60, T0, T0 + 1_200_000)
    want = sorted(map(tuple, batch.select(cols).collect()))
    newest = max(r[1] for r in want)
    assert got and [r for r in want if r[1] < newest - 60] == [r for r in got if r[1] < newest - 60]


@pytest.mark.parametrize("batches,tf,start", [(1, 60, 0), (5, 60, -90), (5, 300, 30)])
def test_filled_stream_equals_build_bars(spark, tmp_path, batches, tf, start):
    """Sparse trades, one symbol silent for long: every bar that has ended by the watermark is there once, gaps included."""
    rows = [r for r in some_trades(60, 3000, batches) if r[0] == "a" or not 600_000 < r[4] < 2_000_000] + [("quiet", 1000, 7.0, 1.0, 100_500, True)]
    source, out = tmp_path / "in", tmp_path / "out"
    frame = trades(spark, sorted(rows, key=lambda r: r[4]))
    width = 3_000_000 // batches
    for i in range(batches):
        frame.where((F.col("timestamp") >= T0 + i * width) & (F.col("timestamp") < T0 + (i + 1) * width)).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(TRADE).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stream_filled_bars(stream, tf, T0 + start * 1000, "5 seconds").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    columns = ["symbol", "timestamp_s", "open", "high", "low", "close", "trade_count", "volume", "max_trade_size"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(out)).select(columns).collect())
    passed = (max(r[4] for r in rows) + T0 - 5000) // 1000
    want = sorted(tuple(r) for r in bars.build_bars(frame, tf, T0 + start * 1000, T0 + 3_000_000).select(columns).collect() if r.timestamp_s + tf <= passed)
    assert got == want and {r[0] for r in got} == {"a", "b", "quiet"}


def test_refreshed_tables_equal_full_ones_and_leave_other_days_alone(spark, tmp_path):
    day, tf, steps, n = 86_400_000, 7200, 5, 16
    rng = random.Random(8)
    rows = [("ab"[k % 2], k, round(100 + rng.random() * 5, 2), rng.randrange(1, 9) * 0.25, rng.randrange(n * day), rng.random() < 0.5) for k in range(300)]
    # "b" doesn't trade on days 3 to 6, nor before day 2
    rows = [r for r in rows if r[0] == "a" or r[4] // day not in (0, 1, 3, 4, 5, 6)]
    store, end = str(tmp_path / "store"), T0 + n * day

    def check(kept):
        frame = trades(spark, kept)
        made = features.build_features(frame, None, tf, T0, end)
        full = {"bars": bars.build_bars(frame, tf, T0, end), "features": made, "labels": labels.build_labels(made, steps)}
        for name, want in full.items():
            got = spark.read.parquet(f"{store}/{name}").drop("day").select(*want.columns)
            key = lambda r: (r.symbol, r.timestamp_s)
            a, b = (sorted(x.collect(), key=key) for x in (got, want))
            assert len(a) == len(b) and all(x == y or (isinstance(x, float) and (abs(x - y) < 1e-9 * max(1, abs(y)) or (math.isnan(x) and math.isnan(y)))) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True)), name

    gone = {"a": {9}, "b": {2, 15}}
    early = [r for r in rows if r[4] // day not in gone[r[0]]]
    refresh.refresh(spark, store, trades(spark, early), tf, T0, end, steps)
    check(early)
    # files of days that can't change are broken, and mended again to compare
    held = {p: p.read_bytes() for name in ("trades", "bars", "features", "labels") for p in (tmp_path / "store" / name / "symbol=a").glob("day=*/*.parquet") if not "2024-01-07" <= p.parent.name[4:] <= "2024-01-16"}
    for p in held:
        p.write_bytes(b"broken")
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    changed = refresh.refresh(spark, store, trades(spark, [r for r in rows if r not in early and r[0] == "a"]), tf, T0, end, steps)
    assert all(p.read_bytes() == b"broken" for p in held) and len(held) > 10
    for p, content in held.items():
        p.write_bytes(content)
    assert {s for x in changed.values() for s, _ in x} == {"a"} and len(changed["labels"]) < n
    check([r for r in rows if r in early or r[0] == "a"])
    refresh.refresh(spark, store, trades(spark, [r for r in rows if r not in early and r[0] == "b"]), tf, T0, end, steps, chunk=17)
    check(rows)
    # a replaced day
    other = [(*r[:2], r[2] + 1, *r[3:]) if r[0] == "b" and r[4] // day == 12 else r for r in rows]
    refresh.refresh(spark, store, trades(spark, [r for r in other if r not in rows]), tf, T0, end, steps)
    check(other)
    assert refresh.refresh(spark, store, trades(spark, []), tf, T0, end, steps)["labels"] == set()
    with pytest.raises(ValueError, match="whole days"):
        refresh.refresh(spark, store, trades(spark, []), 7000, T0, end)
