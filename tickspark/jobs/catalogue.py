"""All queries of the library by name; each takes (spark, sf_dir). Their SQL is in tickspark.jobs.sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions import scalars as S
from tickspark.jobs import sql
from tickspark.jobs.settings import COEFFICIENTS, END_MS, GRID, INTERCEPTS, LABELS, START_MS, SWEEP, THRESHOLDS, TIMEFRAME_S, mlp_weights
from tickspark.operators import backtest as B
from tickspark.operators import bars, dataset, evaluate, features, labels, quality, scoring
from tickspark.operators.refresh import refresh
from tickspark.sources import adapters, archives, files
from tickspark.sources.scratch import scratch, written
from tickspark.streaming.bars import stream_bars, stream_filled_bars

Query = Callable[[SparkSession, str], DataFrame]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "events")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.trades_from_events(events(spark, sf_dir))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that trade in range, from two columns of the table."""
    return S.range_filter(trades(spark, sf_dir), START_MS, END_MS).select("symbol").distinct()


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.raw_from_events(events(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order agree; minus zero becomes zero."""
    fix: dict[str, Column] = {c: F.round(F.col(c), digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"}
    return df.withColumns(fix) if fix else df


def filled(spark: SparkSession, sf_dir: str, tf: int = TIMEFRAME_S) -> DataFrame:
    """Bars of the events, whose ids are the key of their table."""
    return bars.build_bars(trades(spark, sf_dir), tf, START_MS, END_MS, unique=True)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return features.build_features(adapters.trades_from_events(e), adapters.repeated_klines(e), TIMEFRAME_S, START_MS, END_MS, unique=True)


def label_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the labeller needs of five-minute bars."""
    return features.bar_times(filled(spark, sf_dir), TIMEFRAME_S).select("symbol", "timestamp", "timestamp_ms", "timestamp_s", "timeframe_s", "open", "high", "low", "close")


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of hourly bars with their ratios as features."""
    rows = features.bar_times(features.log_returns(bars.bar_ratios(filled(spark, sf_dir, 3600))), 3600)
    return labels.build_labels(rows, *LABELS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.softmax_linear(label_table(spark, sf_dir), COEFFICIENTS, INTERCEPTS)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_decisions(scored(spark, sf_dir), *THRESHOLDS)


def dirty_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows with repeated times, blank labels and closes, from events."""
    k = F.col("event_id")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000 / 600000) * 600000
    return events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), F.when(k % 53 == 0, "soon").otherwise(ms.cast("string")).alias("timestamp_ms"), F.when(k % 41 == 0, "").otherwise((k % 3).cast("string")).alias("label"),
        F.when(k % 37 == 0, "").otherwise(F.col("value").cast("string")).alias("close"), F.col("user_id").cast("double").alias("f1"), F.when(k % 31 == 0, float("nan")).when(k % 29 == 0, float("inf")).otherwise(F.col("value")).alias("f2"), k.alias("ingest_seq"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset.clean_labels(dirty_labels(spark, sf_dir), need_close=True)
    return dataset.lookback_windows(dataset.finite_rows(rows, ["close", "f1", "f2"]), ["close", "f1", "f2"], 4)


def split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.time_split(windows(spark, sf_dir), least=10)


def spread_x(df: DataFrame) -> DataFrame:
    """The twelve places of x as columns, rounded, which compares everywhere."""
    return df.withColumns({f"x{i}": F.round(F.element_at("x", i + 1).cast("double"), 3) + F.lit(0.0) for i in range(12)}).drop("x")


def q(f: Query, digits: int = 6) -> Query:
    return lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files, one for each event: stamped ones, and one in seventy without a stamp."""
    at = F.col("ts").cast("timestamp")
    stamp = lambda t: F.date_format(t, "yyyyMMdd_HHmmss")
    name = F.concat(F.lit("data/"), "event_type", F.lit("_"), stamp(at), F.lit("__"), stamp(at + F.expr("interval 2 days")), F.lit(".csv"))
    return events(spark, sf_dir).select(F.when(F.col("event_id") % 70 == 0, F.concat(F.lit("data/"), "event_type", F.lit(".csv"))).otherwise(name).alias("path"))


def skipped_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).where("agg_trade_id % 211 = 0").select("symbol", S.day_of(F.col("timestamp")).alias("day")).distinct()


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("created_at"), F.to_date("o_orderdate").alias("start_date"), F.date_add(F.to_date("o_orderdate"), 30).alias("end_date")
    )


def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests written as JSON and read back: of each symbol's newest, tagged `latest`, the dataset that its artifact's path leads to."""
    path = scratch(spark, "manifests")
    rows = manifests(spark, sf_dir).withColumn("artifact_path", F.concat(F.lit("data/"), F.substring("symbol", 1, 1), F.lit("/"), (F.col("id") % 5000).cast("string")))
    rows.write.json(path)
    found = quality.read_manifests(spark, path, lines=True)
    newest = found.groupBy("symbol").agg(F.max_by("id", F.struct("created_at", "id")).alias("target_id"))
    latest = quality.tagged(found, newest.select(F.concat(F.lit("latest/"), "symbol").alias("tag"), "target_id")).select("tag", "id", "artifact_path")
    first = quality.by_artifact(found, latest.select("artifact_path").distinct()).withColumnRenamed("id", "first_id")
    return latest.join(first, "artifact_path")


def labels_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label table written as CSV with header, read back and cleaned."""
    path = scratch(spark, "labels")
    label_table(spark, sf_dir).write.option("header", "true").csv(path)
    rows = dataset.clean_labels(files.read_labels(spark, path), need_close=True, strict=True)
    return rows.select("symbol", *files.LABELS_NEEDED)


def labels_of_overlapping_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three label files that overlap, the first one short: of each time the last file's label stays."""
    hours = bars.bar_spine(symbols(spark, sf_dir), START_MS, END_MS, 3600).select("symbol", (F.col("timestamp_s") * 1000).alias("timestamp_ms"), (F.col("timestamp_s") / 3600).cast("long").alias("hour"))
    paths = []
    for label, where in enumerate(("hour % 24 = 0", "true", "hour % 2 = 0")):
        paths.append(scratch(spark, f"labels-{label}"))
        hours.where(where).withColumn("label", F.lit(label)).write.option("header", "true").csv(paths[-1])
    return dataset.clean_labels(files.read_labels(spark, paths, training=True)).select("symbol", "timestamp_ms", "label")


def tied_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trade three times, at the same time, at another price or of another size."""
    once = trades(spark, sf_dir)
    dearer = once.withColumn("price", F.col("price") + (F.col("agg_trade_id") % 3 - 1) * 0.5)
    return once.union(dearer).union(once.withColumns({"quantity": F.col("quantity") + (F.col("agg_trade_id") % 2) * 0.25, "buyer_is_maker": ~F.col("buyer_is_maker")}))


def repeated_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trade twice, as overlapping files have it."""
    return trades(spark, sf_dir).union(trades(spark, sf_dir))


def checked_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir)
    cells = evaluate.confusion_matrix(rows, "symbol")
    return quality.backtest_checks(B.backtest_report(rows, every=symbols(spark, sf_dir)), evaluate.classification_report(cells, "symbol"), cells)


def refreshed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly labels of a store that takes in all trades but those of every fifth day, and then those."""
    store = scratch(spark, "store")
    late = F.floor(F.col("timestamp") / S.DAY_MS) % 5 == 0
    for part in (~late, late):
        refresh(spark, store, trades(spark, sf_dir).where(part), 3600, START_MS, END_MS, *LABELS)
    return spark.read.parquet(f"{store}/labels").select(F.col("symbol").cast("string").alias("symbol"), "timestamp_ms", "close", "label", "exit_reason", "time_to_exit_s")


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events read as a stream and written once complete; what the watermark hasn't passed stays out."""
    schema = adapters.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    query = stream_bars(adapters.trades_from_events(stream), 3600).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def streamed_filled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars without gaps of events in range, read as a stream; what the watermark hasn't passed stays out."""
    schema = adapters.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    rows = S.range_filter(adapters.trades_from_events(stream), START_MS, END_MS)
    query = stream_filled_bars(rows, 3600, START_MS).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def trades_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trades written as CSV, read back and sanitized."""
    path = scratch(spark, "csv")
    raw(spark, sf_dir).drop("symbol").write.csv(path)
    return files.sanitize_trades(files.read_trades_csv(spark, path, "all"))


def trades_by_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trades written as an archive for each symbol and day, read back and sanitized; the symbol is the archive's."""
    path = scratch(spark, "archives")
    archives.write_archives(raw(spark, sf_dir), path)
    return files.sanitize_trades(archives.read_archives(spark, path).withColumn("symbol", F.regexp_extract("path", "([^/-]+)-[^/]*$", 1))).drop("path", "first_ms", "last_ms")


def klines_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Klines written as CSV with header by symbol, read back and deduplicated."""
    path = scratch(spark, "klines")
    adapters.klines_from_events(events(spark, sf_dir)).select("symbol", "open_time", "open", "high", "low", "close").write.partitionBy("symbol").option("header", "true").csv(path)
    return features.dedupe_klines(files.read_klines(spark, path).withColumn("seq", F.col("open_time")))


def features_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars written as feature files with header, read back and labelled."""
    path = scratch(spark, "features")
    bar_columns = ("symbol", "timestamp_ms", "timestamp_s", "timeframe_s", "open", "high", "low", "close")
    features.bar_times(filled(spark, sf_dir, 3600), 3600).select(*bar_columns).write.option("header", "true").csv(path)
    return labels.build_labels(files.read_features(spark, path), *LABELS).select("symbol", "timestamp_ms", "close", "label", "exit_reason", "time_to_exit_s")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trades stored by day in one pass, and the counters of that pass beside what is stored."""
    path = scratch(spark, "ingested")
    told = files.ingest_daily(raw(spark, sf_dir), path)
    return spark.read.parquet(path).agg(F.count("*").alias("stored")).select("stored", *[F.lit(v).cast("long").alias(k) for k, v in told.items()])


def trades_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades stored by symbol and day, with one symbol's days replaced, counted."""
    path = scratch(spark, "daily")
    files.write_daily(trades(spark, sf_dir), path)
    files.write_daily(trades(spark, sf_dir).where("symbol = 'click' and agg_trade_id % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("symbol", F.col("day").cast("date").alias("day")).agg(F.count("*").alias("n"))


def standardized_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = written(split_windows(spark, sf_dir), "windows")  # for the statistics and for what they standardize
    return dataset.apply_standardizer(w, dataset.fit_standardizer(w.where("split = 'train'")))


def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic regression fitted on the training part, and its probabilities of every window."""
    rows = standardized_splits(spark, sf_dir)
    train = rows.where("split = 'train'")
    return scoring.score_baseline(scoring.fit_baseline(train, dataset.class_weights(train), 10), rows).drop("x")


def mlp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of every window by an MLP with seeded weights, in place of exported ones; no window is stored."""
    cols = ["close", "f1", "f2"]
    rows = written(dataset.finite_rows(dataset.clean_labels(dirty_labels(spark, sf_dir), need_close=True), cols).select("symbol", "timestamp_ms", "label", *cols), "finite")
    return scoring.score_windows(rows, cols, 4, dataset.slot_statistics(rows, cols, 4), mlp_weights(), least=10)


DAY = S.DAY_MS
QUERIES: dict[str, Query] = {
    "trades_sanitized": lambda s, d: files.sanitize_trades(raw(s, d)),
    "flags_lenient": lambda s, d: raw(s, d).select("symbol", "last_trade_id", S.parse_flag_lenient(F.col("buyer_is_maker")).alias("flag"), S.parse_flag(F.col("buyer_is_maker")).alias("strict")),
    "range_filter": lambda s, d: S.range_filter(trades(s, d), START_MS + 3 * DAY, START_MS + 5 * DAY + 1),
    "timeframes": lambda s, d: events(s, d).select("event_id", F.concat(F.lit(" "), (F.col("user_id") % 30).cast("string"), F.substring(F.lit("smhdSM"), (F.col("event_id") % 6 + 1).cast("int"), F.lit(1))).alias("text")).withColumn("seconds", S.timeframe_seconds(F.col("text"))),
    "time_keys": lambda s, d: S.time_keys(trades(s, d).select("agg_trade_id", "timestamp")),
    "day_spine": lambda s, d: S.trade_measures(trades(s, d)).groupBy(S.day_of(F.col("timestamp")).alias("day")).agg(F.count("*").alias("n")).join(S.day_spine(s, START_MS, END_MS + 1), "day", "right").select("day", F.coalesce("n", F.lit(0)).alias("n")),
    "trade_measures": q(lambda s, d: S.trade_measures(trades(s, d))),
    "second_aggregates": q(lambda s, d: bars.second_aggregates(trades(s, d))),
    "merge_partials": q(lambda s, d: bars.merge_partials(bars.second_aggregates(trades(s, d)).withColumn("minute_s", F.floor(F.col("second_s") / 60) * 60), "symbol", "minute_s", order="second_s")),
    "bar_spine": lambda s, d: bars.bar_spine(trades(s, d).select("symbol").distinct(), START_MS + 500, END_MS - 1500, 7 * 3600),
    "bars_5m": q(lambda s, d: bars.bar_ratios(filled(s, d))),
    "bars_repeated_trades": q(lambda s, d: bars.build_bars(repeated_trades(s, d), TIMEFRAME_S, START_MS, END_MS)),
    "trades_unique": q(lambda s, d: bars.unique_trades(tied_trades(s, d))),
    "bars_rollup_1h": q(lambda s, d: bars.rollup_bars(filled(s, d), 3600, START_MS)),
    "bars_daily_lineitem": q(lambda s, d: bars.daily_bars(adapters.ticks_from_lineitem(adapters.table(s, d, "lineitem")))),
    "klines_deduped": q(lambda s, d: features.dedupe_klines(adapters.repeated_klines(events(s, d)))),
    "kline_context": q(lambda s, d: features.kline_distances(features.join_kline_context(filled(s, d).select("symbol", "timestamp_s", "close"), features.dedupe_klines(adapters.repeated_klines(events(s, d)))))),
    "features_5m": q(feature_table),
    "future_outcomes": q(lambda s, d: labels.horizon_returns(labels.future_extremes(features.bar_times(filled(s, d), TIMEFRAME_S).select("symbol", "timestamp_ms", "high", "low", "close"), 12), 12, 0.0005).drop("high", "low", "close")),
    "labels_1h": q(label_table),
    "labels_5m": q(lambda s, d: labels.build_labels(label_bars(s, d), *LABELS)),
    "labels_5m_in_chunks": q(lambda s, d: labels.build_labels_in_chunks(label_bars(s, d), 2000, *LABELS)),
    "labels_long_horizon": q(lambda s, d: labels.build_labels_long_horizon(label_bars(s, d), 300, *LABELS[1:], chunk=2000)),
    "labels_by_file": q(labels_by_file),
    "labels_of_overlapping_files": labels_of_overlapping_files,
    "long_horizon_touch": lambda s, d: labels.first_touch_long_horizon(label_bars(s, d), 300, 0.0035, 0.0025, 2000).select("symbol", "timestamp_ms", F.col("long_hit.step").alias("long_step"), F.col("short_hit.step").alias("short_step")),
    "label_sweep": lambda s, d: labels.label_sweep(features.bar_times(filled(s, d, 3600), 3600), SWEEP),
    "labels_clean": lambda s, d: dataset.clean_labels(dirty_labels(s, d)).select("symbol", "timestamp_ms", "label", "close", "ingest_seq"),
    "labels_clean_closed": lambda s, d: dataset.clean_labels(dirty_labels(s, d), need_close=True).select("symbol", "timestamp_ms", "label", "close", "ingest_seq"),
    "finite_rows": q(lambda s, d: dataset.finite_rows(dataset.clean_labels(dirty_labels(s, d), need_close=True), ["f1", "f2"]).select("symbol", "timestamp_ms", F.col("f1").cast("double").alias("f1"), F.col("f2").cast("double").alias("f2")), 3),
    "lookback_windows": lambda s, d: spread_x(windows(s, d)),
    "time_split": lambda s, d: split_windows(s, d).select("symbol", "timestamp_ms", "label", "split"),
    "standardizer": q(lambda s, d: dataset.fit_standardizer(split_windows(s, d).where("split = 'train'")), 4),
    "slot_statistics": q(lambda s, d: dataset.slot_statistics(dataset.finite_rows(dataset.clean_labels(dirty_labels(s, d), need_close=True), ["close", "f1", "f2"]), ["close", "f1", "f2"], 4), 4),
    "standardized": lambda s, d: spread_x(standardized_splits(s, d)),
    "class_weights": q(lambda s, d: dataset.class_weights(split_windows(s, d).where("split = 'train'"))),
    "softmax_scores": q(lambda s, d: scored(s, d).withColumn("argmax", scoring.argmax_pred()).select("symbol", "timestamp_ms", "argmax", "p_no_trade", "p_long", "p_short")),
    "log_loss": q(lambda s, d: (lambda r: evaluate.weighted_log_loss(r, dataset.class_weights(r), "symbol"))(scored(s, d))),
    "decisions": lambda s, d: decided(s, d).select("symbol", "timestamp_ms", "label", "pred", "pred_name"),
    "confusion": lambda s, d: evaluate.confusion_matrix(decided(s, d), "symbol"),
    "classification_report": q(lambda s, d: evaluate.classification_report(evaluate.confusion_matrix(decided(s, d), "symbol"), "symbol")),
    "class_counts": lambda s, d: (lambda r: evaluate.class_counts(r, "label", "symbol").join(evaluate.class_counts(r, "pred", "symbol").toDF("symbol", "pred_no_trade", "pred_long", "pred_short"), "symbol"))(decided(s, d)),
    "trade_candidates": q(lambda s, d: B.trade_candidates(decided(s, d)).select("symbol", "timestamp_ms", "side", "event", "exit_reason", "hold_s", "return_pct")),
    "trades_gated": q(lambda s, d: B.backtest_trades(decided(s, d)).select("symbol", "timestamp_ms", "side", "close", "p_no_trade", "p_long", "p_short", "event", "exit_reason", "hold_s", "return_pct", "equity_after")),
    "backtest_report": q(lambda s, d: B.backtest_report(decided(s, d), every=symbols(s, d))),
    "predictions": q(lambda s, d: B.predictions(decided(s, d))),
    "threshold_sweep": q(lambda s, d: B.threshold_sweep(scored(s, d).select("symbol", "timestamp_ms", "long_event", "short_event", "long_net_return_pct", "short_net_return_pct", "exit_reason", "time_to_exit_s", "p_no_trade", "p_long", "p_short"), GRID, symbols(s, d))),
    "ingest_report": lambda s, d: quality.ingest_report(raw(s, d), S.day_spine(s, START_MS, END_MS)),
    "drop_reasons": lambda s, d: quality.drop_reasons(raw(s, d)),
    "quality_backtest": q(checked_backtest),
    "quality_order": q(lambda s, d: quality.order_check(dirty_labels(s, d).withColumn("timestamp_ms", F.col("timestamp_ms").try_cast("bigint")), chunk=700)),
    "catalogue_files": catalogue_files,
    "profile_orders": q(lambda s, d: quality.profile(adapters.table(s, d, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")))).drop("dtype")),
    "class_distribution": q(lambda s, d: quality.class_distribution(adapters.table(s, d, "labels").withColumn("quality", F.when(F.col("doc_id") % 7 != 0, F.col("quality"))), "quality")),
    "catalog_lookup": lambda s, d: quality.catalog_lookup(manifests(s, d).withColumns({c: F.col(c).cast("string") for c in ("created_at", "start_date", "end_date")}), "1995-01-01", "1995-06-30"),
    "quality_checks": q(lambda s, d: quality.quality_checks(label_table(s, d))),
    "prune_by_stamp": lambda s, d: files.prune_by_stamp(file_names(s, d), START_MS + 3 * DAY, START_MS + 5 * DAY),
    "labels_refreshed": q(refreshed_labels),
    "stream_bars": q(streamed_bars),
    "stream_filled_bars": q(streamed_filled_bars),
    "trades_by_file": trades_by_file,
    "trades_by_archive": trades_by_archive,
    "trades_by_day": trades_by_day,
    "klines_by_file": q(klines_by_file),
    "features_by_file": q(features_by_file),
    "ingest_counters": ingested,
    "baseline_scores": baseline_scores,
    "mlp_scores": mlp_scores,
    "mlp_probabilities": q(mlp_scores),
    "consolidate_days": lambda s, d: files.consolidate_days(trades(s, d).withColumn("day", S.day_of(F.col("timestamp"))), skipped_days(s, d), START_MS + 2 * DAY + 5, START_MS + 9 * DAY),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
