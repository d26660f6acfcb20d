"""Tables of bars, features and labels kept up to date: only the days that new trades can change are read and written again."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.functions.scalars import DAY_MS, day_of, range_filter
from tickspark.operators.bars import AMOUNTS, CHUNK, fill_bars, in_chunks, traded_bars, unique_trades
from tickspark.operators.features import FEATURES, REACH, finished, window_features
from tickspark.operators.labels import build_labels
from tickspark.sources.files import write_daily

#: (symbol, day) of a partition.
Day = tuple[str, date]
EPOCH = date(1970, 1, 1)
BARS = "timestamp_s long, open double, high double, low double, close double, trade_count long, " + ", ".join(f"{c} double" for c in AMOUNTS[1:]) + ", symbol string, day date"
TRADES = "agg_trade_id long, timestamp long, price double, quantity double, buyer_is_maker boolean, symbol string, day date"


def stored_days(spark: SparkSession, path: str) -> set[Day]:
    """The partitions of a table by symbol and day. Only their names come to the driver, which lists them for any read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/symbol=*/day=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    parts = [s.getPath().toString().rsplit("/", 2)[1:] for s in found]
    return {(unquote(a.partition("=")[2]), date.fromisoformat(b.partition("=")[2])) for a, b in parts}


def read_days(spark: SparkSession, path: str, schema: T.StructType | str, days: Iterable[Day]) -> DataFrame:
    """Those days of a table; a filter of partitions, so files of other days aren't opened. Days that aren't stored give nothing."""
    there = sorted(set(days) & stored_days(spark, path))
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.concat_ws("/", F.col("day").cast("string"), F.col("symbol")).isin([f"{day}/{symbol}" for symbol, day in there]))


def replace_days(rows: DataFrame, path: str) -> None:
    """The days of timestamp_s that rows have replace stored ones whole."""
    rows = rows.withColumn("day", day_of(F.col("timestamp_s") * 1000))
    rows.repartition("symbol", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "day").parquet(path)


def widened(days: Iterable[Day], before: int, after: int, first: date, last: date) -> set[Day]:
    """days with so many days on either side, within [first, last]."""
    return {(s, d + timedelta(k)) for s, d in days for k in range(-before, after + 1) if first <= d + timedelta(k) <= last}


def days_of_bars(new: set[Day], traded: set[Day], first: date, last: date) -> set[Day]:
    """The days whose bars new trades can change: theirs, all up to the next day with trades, into which their last price is carried, and those before a symbol's first trade."""
    out: set[Day] = set()
    for symbol in {s for s, _ in new}:
        there = sorted(d for s, d in traded if s == symbol)
        following = dict(zip(there, [*there[1:], last], strict=True))
        for _, day in (x for x in new if x[0] == symbol):
            begin = first if day == there[0] else day
            out |= {(symbol, begin + timedelta(k)) for k in range((following[day] - begin).days + 1)}
    return out


def refresh(spark: SparkSession, store: str, new: DataFrame, timeframe_s: int, start_ms: int, end_ms: int, steps: int = 12, *args: float, chunk: int = CHUNK) -> dict[str, set[Day]]:
    """Takes trades of whole days into `store` and brings its tables trades, bars, features and labels, all by symbol and day, to what a full run over [start_ms, end_ms) gives.

    Days that new has replace stored ones. Bars change up to the next day that trades, features (without kline context) for a further REACH bars, labels from `steps`
    bars earlier on (args are those of build_labels()); each is computed from its days and a halo of whole days. A table's days are replaced in one
    commit, and a run that broke off is mended by the same call again. Time frames must divide a day, and the range must be
    whole days; else it is an error. Trades out of range, without symbol or time, are left out. Returns the days of each table that were replaced.
    """
    if DAY_MS % (timeframe_s * 1000) or start_ms % DAY_MS or end_ms % DAY_MS or end_ms <= start_ms:
        raise ValueError("time frames must divide a day, and the range must be whole days")
    path = {name: f"{store}/{name}" for name in ("trades", "bars", "features", "labels")}
    first, last = EPOCH + timedelta(start_ms // DAY_MS), EPOCH + timedelta(end_ms // DAY_MS - 1)
    far = lambda bars: -(-bars * timeframe_s * 1000 // DAY_MS)  # noqa: E731  days that so many bars reach into

    rows = unique_trades(range_filter(new.dropna(subset=["symbol", "timestamp"]), start_ms, end_ms))
    days = {(r["symbol"], r["day"]) for r in rows.select("symbol", day_of(F.col("timestamp")).alias("day")).distinct().collect()}
    if not days:
        return {name: set() for name in path}
    write_daily(rows, path["trades"])
    changed = {"trades": days, "bars": days_of_bars(days, stored_days(spark, path["trades"]), first, last)}
    changed["features"] = widened(changed["bars"], 0, far(REACH), first, last)
    changed["labels"] = widened(changed["features"], far(steps), 0, first, last)

    bars = traded_bars(read_days(spark, path["trades"], TRADES, changed["bars"]), timeframe_s, start_ms, end_ms)
    own = spark.createDataFrame(sorted(changed["bars"]), "symbol string, day date")
    own = own.select("symbol", F.explode(F.expr(f"transform(sequence(0, {DAY_MS // 1000 - timeframe_s}, {timeframe_s}), x -> unix_date(day) * {DAY_MS // 1000}L + x)")).alias("timestamp_s"), F.lit(True).alias("own"))
    ends = read_days(spark, path["bars"], BARS, widened(changed["bars"], 1, 0, first, last) - changed["bars"]).where(F.col("timestamp_s") % (DAY_MS // 1000) == DAY_MS // 1000 - timeframe_s)
    ends = ends.drop("day").withColumns({"first_s": F.col("timestamp_s"), "first_s_close": F.col("close")})  # the last bar before each stretch: its close is carried in
    spine = in_chunks(own.union(ends.select("symbol", "timestamp_s", F.lit(False))).withColumnRenamed("own", "mine"), start_ms, timeframe_s, chunk).drop("own")
    filled = fill_bars(spine.drop("mine"), bars.unionByName(ends.select(*bars.columns)), chunked=True).drop("chunk")
    replace_days(filled.join(spine.where("mine").select("symbol", "timestamp_s"), ["symbol", "timestamp_s"], "left_semi"), path["bars"])

    def only(rows: DataFrame, table: str) -> DataFrame:
        kept = F.concat_ws("/", day_of(F.col("timestamp_s") * 1000).cast("string"), F.col("symbol")).isin([f"{d}/{s}" for s, d in sorted(changed[table])])
        return rows.where(F.col("own") & kept).drop("own", "chunk")

    around = read_days(spark, path["bars"], BARS, widened(changed["features"], far(REACH), 0, first, last)).drop("day")
    made = finished(window_features(in_chunks(around, start_ms, timeframe_s, chunk, before=REACH)), timeframe_s)
    made = only(made, "features").select("symbol", *FEATURES)
    replace_days(made, path["features"])

    schema = T.StructType([*made.schema.fields[1:], *T._parse_datatype_string("symbol string, day date").fields])
    around = read_days(spark, path["features"], schema, widened(changed["labels"], 0, far(steps), first, last)).drop("day")
    replace_days(only(build_labels(in_chunks(around, start_ms, timeframe_s, chunk, after=steps), steps, *args), "labels"), path["labels"])
    return changed
