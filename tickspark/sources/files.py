"""Trade, kline, feature and label files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import UTC, datetime
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickspark.functions.scalars import day_of, parse_flag, whole_number
from tickspark.sources.archives import STAMPED, TRADE_COLUMNS, read_archives

KLINE_SCHEMA = "open_time bigint, open double, high double, low double, close double"
#: What the labeller needs of a feature file.
FEATURES_NEEDED = {"timestamp_ms": "bigint", "timestamp_s": "bigint", "timeframe_s": "bigint", "open": "double", "high": "double", "low": "double", "close": "double"}
#: What a backtest needs of a label file.
LABELS_NEEDED = {
    "timestamp": "string", "timestamp_ms": "bigint", "timestamp_s": "bigint", "label": "int", "label_name": "string", "close": "double", "long_net_return_pct": "double", "short_net_return_pct": "double",
    "time_to_exit_s": "double", "long_event": "string", "short_event": "string", "exit_reason": "string",
}


def read_trades_csv(spark: SparkSession, path: str | list[str], symbol: str) -> DataFrame:
    """The seven columns as texts, header or not. Short rows get nulls, more fields are ignored, and sanitize_trades() decides what stays."""
    schema = ", ".join(f"{c} string" for c in TRADE_COLUMNS)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("enforceSchema", "true").csv(path).withColumn("symbol", F.lit(symbol))


def read_trades_zip(spark: SparkSession, path: str, symbol: str, chunk: int = 250_000) -> DataFrame:
    """The same of day archives (a file, a folder or wildcards): the first .csv of each, streamed in batches of at most `chunk` rows; an archive without one is an error.

    An archive can't be split and takes one task, which holds a block of text at a time.
    """
    return read_archives(spark, path, rows=chunk).select(*TRADE_COLUMNS).withColumn("symbol", F.lit(symbol))


def sanitize_trades(raw: DataFrame) -> DataFrame:
    """Typed trades: texts trimmed, ids all digits (so headers go), every number and flag readable, other rows dropped."""
    clean = {c: F.trim(F.col(c)) for c in TRADE_COLUMNS}
    kinds = {"bigint": whole_number, "double": lambda c: c.try_cast("double"), "boolean": parse_flag}
    typed = raw.where(clean["agg_trade_id"].rlike("^[0-9]+$")).withColumns({c: kinds[kind](clean[c]) for c, kind in TRADE_COLUMNS.items()})
    return typed.dropna(subset=list(TRADE_COLUMNS))


def write_daily(trades: DataFrame, path: str) -> None:
    """One partition for each symbol and UTC day; days that trades has replace stored ones whole, others stay."""
    rows = trades.withColumn("day", day_of(F.col("timestamp")))
    rows.repartition("symbol", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "day").parquet(path)


def ingest_daily(raw: DataFrame, path: str) -> dict[str, int | None]:
    """write_daily() of the rows that sanitize_trades() keeps, with parsed, kept, first_ms and last_ms observed in the same pass; times are null where nothing is kept."""
    parsed, kept = Observation("parsed"), Observation("kept")
    clean = sanitize_trades(raw.observe(parsed, F.count(F.lit(1)).alias("parsed")))
    write_daily(clean.observe(kept, F.count(F.lit(1)).alias("kept"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms")), path)
    return {k: parsed.get.get(k, kept.get.get(k)) for k in ("parsed", "kept", "first_ms", "last_ms")}


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df; an error if it is empty. It asks for one row, so call it where a job starts."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def consolidate_days(daily: DataFrame, skipped: DataFrame, start_ms: int, end_ms: int, strict: bool = False) -> DataFrame:
    """Whole days that [start_ms, end_ms) touches, without skipped (symbol, day). With `strict`, it is an error if no day is left."""
    first, last = (day_of(F.lit(ms)) for ms in (start_ms, end_ms - 1))
    left = daily.where(F.col("day").between(first, last)).join(skipped, ["symbol", "day"], "left_anti")
    return require_rows(left, "daily rows") if strict else left


def prune_by_stamp(files: DataFrame, start_ms: int, end_ms: int, path: str = "path") -> DataFrame:
    """Files whose stamp (start__end at the end of the name's stem) overlaps [start_ms, end_ms); files without one stay."""
    part = lambda i: F.unix_millis(F.try_to_timestamp(F.nullif(F.regexp_extract(path, STAMPED, i), F.lit("")), F.lit("yyyyMMdd_HHmmss")))
    return files.where(F.coalesce((part(1) < end_ms) & (F.lit(start_ms) < part(2)), F.lit(True)))


def in_range(path: str, start_ms: int, end_ms: int) -> bool:
    """Whether the stamp of a file's name overlaps [start_ms, end_ms); true without one."""
    if not (m := re.search(STAMPED, path)):
        return True
    first, last = (datetime.strptime(t, "%Y%m%d_%H%M%S").replace(tzinfo=UTC).timestamp() * 1000 for t in m.groups())
    return first < end_ms and start_ms < last


def read_trades_in_range(spark: SparkSession, folder: str, symbol: str, start_ms: int, end_ms: int) -> DataFrame:
    """read_trades_csv() of the folder's .csv files whose stamps overlap the range: the others are never opened. Only names come to the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().toString() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    chosen = sorted(n for n in names if n.endswith(".csv") and in_range(n, start_ms, end_ms))
    if not chosen:
        raise ValueError(f"no trade file in range in {folder}")
    return read_trades_csv(spark, chosen, symbol)


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(KLINE_SCHEMA)
    return reader.parquet(path) if path.endswith(".parquet") else reader.option("header", "true").csv(path)


def typed(df: DataFrame, needed: dict[str, str], drop: bool = True) -> DataFrame:
    """df with the needed columns typed; a missing column is an error; rows that don't parse go, or have nulls there."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    out = df.withColumns({c: F.col(c).try_cast(kind) for c, kind in needed.items()})
    return out.dropna(subset=list(needed)) if drop else out


def read_features(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    raw = spark.read.option("header", "true").csv(path)
    return typed(raw, FEATURES_NEEDED)


def in_file_order(raw: DataFrame, paths: Sequence[str]) -> DataFrame:
    """raw, as just read from paths, with ingest_seq: the file's place (that of its path in the list, then its name), its split's start and the row's place there, as one DECIMAL.

    It doesn't depend on how files are packed into tasks. Only the names of the files come to the driver.
    """
    spark = raw.sparkSession
    where = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    systems = [w.getFileSystem(spark._jsc.hadoopConfiguration()) for w in where]
    listed = [[s.getPath().toUri().getPath() for s in fs.globStatus(w) or []] for fs, w in zip(systems, where, strict=True)]
    plain = lambda name: unquote(urlsplit(name).path)
    inside = lambda name, found: any(name == f or name.startswith(f.rstrip("/") + "/") for f in found)
    place = lambda name: (next(i for i, found in enumerate(listed) if inside(plain(name), found)), name)
    slashes = "^([a-zA-Z][a-zA-Z0-9+.-]*):/+"  # as many as whoever writes the name likes
    names = [(re.sub(slashes, r"\1:/", name), i) for i, name in enumerate(sorted(raw.inputFiles(), key=place))]
    files = spark.createDataFrame(names, "file_path string, file_place long")
    rows = raw.select("*", F.regexp_replace("_metadata.file_path", slashes, "$1:/").alias("file_path"), F.col("_metadata.file_block_start").alias("file_start"), F.monotonically_increasing_id().alias("file_row")).join(files, "file_path")
    number = lambda c: f"cast({c} as decimal(38,0))"
    seq = F.expr(f"cast({number('file_place')} * 10000000000000000000000000000BD + {number('file_start')} * 100000000000BD + {number('file_row & 8589934591')} as decimal(38,0))")
    return rows.withColumn("ingest_seq", seq).drop("file_path", "file_place", "file_start", "file_row")


def read_labels(spark: SparkSession, path: str | Sequence[str], training: bool = False) -> DataFrame:
    """Label files with headers, the needed columns typed (for training, time and label are enough) and ingest_seq, the rows' order in the files as listed; what doesn't parse is null.

    clean_labels() drops rows without time or label and keeps the last of repeated times.
    """
    raw = spark.read.option("header", "true").csv(path if isinstance(path, str) else list(path))
    needed = {c: LABELS_NEEDED[c] for c in ("timestamp_ms", "label")} if training else LABELS_NEEDED
    return typed(in_file_order(raw, [path] if isinstance(path, str) else path), needed, drop=False)
