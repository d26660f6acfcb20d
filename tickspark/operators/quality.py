"""Data quality and the catalogue of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickspark.functions.scalars import day_of, parse_flag, whole_number
from tickspark.operators.bars import CHUNK, dealt, numbered
from tickspark.sources.files import TRADE_COLUMNS


def dropped_for() -> Column:
    """Why sanitize_trades() drops a raw row: the first column, in the file's order, that can't be read; null for rows that stay."""
    clean = {c: F.trim(F.col(c)) for c in TRADE_COLUMNS}
    fine = {c: {"bigint": whole_number, "double": lambda x: x.try_cast("double"), "boolean": parse_flag}[kind](clean[c]).isNotNull() for c, kind in TRADE_COLUMNS.items()}
    fine["agg_trade_id"] = fine["agg_trade_id"] & clean["agg_trade_id"].rlike("^[0-9]+$")
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in fine.items()])


def _raw_day() -> Column:
    ms = whole_number(F.trim("timestamp"))
    return day_of(F.when(ms.between(0, 253402300799999), ms))


def ingest_report(raw: DataFrame, days: DataFrame) -> DataFrame:
    """(symbol, day, parsed, kept, dropped, skipped) of every symbol and day of the spine; rows whose time can't be read have a null day. Raw rows are read once."""
    counts = raw.select("symbol", _raw_day().alias("day"), dropped_for().alias("reason")).groupBy("symbol", "day").agg(F.count("*").alias("parsed"), F.count_if(F.col("reason").isNull()).alias("kept"))
    # each symbol's days as they are, and a zero for each day of the spine
    zeros = counts.select("symbol").distinct().crossJoin(F.broadcast(days)).select("symbol", "day", F.lit(0).cast("long").alias("parsed"), F.lit(0).cast("long").alias("kept"), F.lit(1).alias("listed"))
    rows = counts.withColumn("listed", F.when(F.col("day").isNull(), 1).otherwise(0)).unionByName(zeros).groupBy("symbol", "day").agg(F.sum("parsed").alias("parsed"), F.sum("kept").alias("kept"), F.max("listed").alias("listed"))
    return rows.where("listed = 1").select("symbol", "day", "parsed", "kept", (F.col("parsed") - F.col("kept")).alias("dropped"), (F.col("kept") == 0).alias("skipped"))


def drop_reasons(raw: DataFrame) -> DataFrame:
    """(symbol, day, reason, n) of rows that sanitize_trades() drops. Unreadable times have a null day."""
    return raw.select("symbol", _raw_day().alias("day"), dropped_for().alias("reason")).where("reason is not null").groupBy("symbol", "day", "reason").agg(F.count("*").alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, n_rows, missing, missing_pct) of each column, in one pass."""
    sums = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("dtype"), F.col(f"m{i}").alias("missing")) for i, (c, kind) in enumerate(df.dtypes)])
    return sums.select("n_rows", F.inline(lines)).select("column", "dtype", "n_rows", "missing", F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("missing_pct"))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct) of each value as text, NULL for null."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("NULL")).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1))))


def read_manifests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Manifests of JSON files, one a file, or with `lines` one a line; files that are no JSON are passed over."""
    return spark.read.option("multiLine", str(not lines).lower()).option("mode", "DROPMALFORMED").json(path)


def by_artifact(manifests: DataFrame, paths: DataFrame) -> DataFrame:
    """(artifact_path, id) of each row of paths: the first dataset, by id, with this artifact; null without."""
    first = manifests.groupBy("artifact_path").agg(F.min("id").alias("id"))
    return paths.select("artifact_path").join(first, "artifact_path", "left")


def catalog_lookup(manifests: DataFrame, start: str, end: str) -> DataFrame:
    """(symbol, newest, n, overlapping): the newest dataset of each symbol, all of them, and those whose dates overlap [start, end)."""
    return manifests.groupBy("symbol").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("newest"), F.count("*").alias("n"), F.count_if((F.col("start_date") < end) & (F.lit(start) < F.col("end_date"))).alias("overlapping")
    )


def tagged(manifests: DataFrame, tags: DataFrame) -> DataFrame:
    """Manifests by tag: tags has (tag, target_id)."""
    return tags.join(manifests, tags["target_id"] == manifests["id"]).drop("target_id")


def quality_checks(labelled: DataFrame) -> DataFrame:
    """(symbol, check, passed, value) of a label table: unique times, both classes, finite closes, a trade in most horizons."""
    rows = labelled.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_distinct("timestamp_ms").alias("times"), F.count_if(F.col("label") == 1).alias("longs"), F.count_if(F.col("label") == 2).alias("shorts"),
        F.count_if(F.col("close").isNull() | F.isnan("close") | (F.abs("close") == float("inf"))).alias("odd"),
    )
    line = lambda name, passed, value: F.struct(F.lit(name).alias("check"), passed.alias("passed"), value.cast("double").alias("value"))
    return rows.select("symbol", F.inline(F.array(
        line("unique_times", F.col("n") == F.col("times"), F.col("n") - F.col("times")), line("long_labels", F.col("longs") > 0, F.col("longs")),
        line("short_labels", F.col("shorts") > 0, F.col("shorts")), line("finite_close", F.col("odd") == 0, F.col("odd")),
        line("label_share", (F.col("longs") + F.col("shorts")) * 20 >= F.col("n"), (F.col("longs") + F.col("shorts")) / F.col("n")),
    )))


def order_check(rows: DataFrame, order: str = "ingest_seq", time: str = "timestamp_ms", chunk: int = CHUNK) -> DataFrame:
    """(symbol, check, passed, value): whether a symbol's rows come in time order; value is the number of steps back.

    Places in the file's order are dealt out in chunks, each with the row before, so no symbol is one task.
    """
    placed = dealt(numbered(rows.select("symbol", time, order), order, chunk), chunk, before=1)
    steps = placed.withColumn("back", F.col(time) < F.lag(time).over(W.partitionBy("symbol", "chunk").orderBy("i")))
    back = F.count_if(F.col("back") & F.col("own"))
    return steps.groupBy("symbol").agg(back.alias("n")).select("symbol", F.lit("time_order").alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").cast("double").alias("value"))


def backtest_checks(report: DataFrame, classes: DataFrame, cells: DataFrame, most_trades: int = 1_000_000) -> DataFrame:
    """(symbol, check, passed, value) of a backtest report, a classification report and its confusion matrix.

    Trades there are, and not too many; the main figures are finite; macro F1 is above 0; more than one class is predicted.
    """
    f1 = classes.where(F.col("class") == "macro avg").select("symbol", F.col("f1").alias("macro_f1"))
    kinds = cells.where("n > 0").groupBy("symbol").agg(F.count_distinct("pred").alias("kinds"))
    rows = report.join(f1, "symbol", "left").join(kinds, "symbol", "left")
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < F.lit(float("inf")), F.lit(False))  # noqa: E731  false for NaN, which is above all numbers
    lines = [("trade_count", F.col("trade_count").between(1, most_trades), F.col("trade_count"))]
    lines += [(f"finite_{c}", finite(c), finite(c).cast("int")) for c in ("cumulative_return_pct", "max_drawdown_pct", "profit_factor")]
    lines += [("macro_f1", F.coalesce(F.col("macro_f1") > 0, F.lit(False)), F.col("macro_f1")), ("predicted_classes", F.coalesce(F.col("kinds") > 1, F.lit(False)), F.coalesce("kinds", F.lit(0)))]
    return rows.select("symbol", F.inline(F.array(*[F.struct(F.lit(n).alias("check"), p.alias("passed"), v.cast("double").alias("value")) for n, p, v in lines])))
