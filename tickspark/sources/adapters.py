"""Market data derived from general tables, by projections alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades_from_events(events: DataFrame) -> DataFrame:
    """Trades of one symbol for each event type."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return events.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("agg_trade_id"), (F.lit(100.0) + F.col("value") / 100.0).alias("price"), ((F.col("user_id") % 40 + 1) * 0.25).alias("quantity"),
        F.col("event_id").alias("first_trade_id"), F.col("event_id").alias("last_trade_id"), ms.alias("timestamp"), (F.col("event_id") % 2 == 0).alias("buyer_is_maker"),
    )


def raw_from_events(events: DataFrame) -> DataFrame:
    """Trades as texts, some of them broken, as files hold them."""
    t = trades_from_events(events)
    k = F.col("agg_trade_id")
    s = lambda c: F.col(c).cast("string")
    return t.select(
        "symbol",
        F.when(k % 97 == 0, F.lit("agg_trade_id")).when(k % 89 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), s("agg_trade_id"))).alias("agg_trade_id"),
        F.when(k % 83 == 0, F.lit("n/a")).otherwise(s("price")).alias("price"),
        F.when(k % 79 == 0, F.lit(None)).otherwise(s("quantity")).alias("quantity"),
        F.when(k % 73 == 0, F.concat(s("first_trade_id"), F.lit(".9"))).otherwise(s("first_trade_id")).alias("first_trade_id"),
        s("last_trade_id").alias("last_trade_id"),
        F.when(k % 71 == 0, F.lit("inf")).otherwise(s("timestamp")).alias("timestamp"),
        F.when(k % 67 == 0, F.lit("maybe")).when(k % 5 == 0, F.lit(" YES ")).when(k % 7 == 0, F.lit("f")).otherwise(s("buyer_is_maker")).alias("buyer_is_maker"),
    )


def klines_from_events(events: DataFrame) -> DataFrame:
    """One-minute OHLC of the minutes that have trades, with seq as their place in the file."""
    t = trades_from_events(events).withColumn("open_time", F.floor(F.col("timestamp") / 60000) * 60000)
    k = t.groupBy("symbol", "open_time").agg(F.min_by("price", "agg_trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "agg_trade_id").alias("close"))
    return k.withColumn("seq", F.col("open_time"))


def repeated_klines(events: DataFrame) -> DataFrame:
    """klines_from_events() with a later, different row for every third minute."""
    k = klines_from_events(events)
    again = F.explode(F.array_compact(F.array(F.lit(0), F.when(F.col("open_time") / 60000 % 3 == 0, F.lit(1)))))
    return k.withColumn("again", again).withColumns({"close": F.col("close") + F.col("again"), "seq": F.col("seq") + F.col("again")}).drop("again")


def ticks_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Ticks of one symbol for each return flag and line status; days as times."""
    return lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"),
        F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
