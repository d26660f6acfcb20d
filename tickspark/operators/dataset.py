"""Training sets: clean labels, leakage-free columns, lookback windows, splits, standardizing, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.operators.bars import CHUNK, dealt, numbered
from tickspark.operators.labels import FRONT
from tickspark.sources.files import require_rows

#: Columns of a label table that are no features; close stays one.
NOT_FEATURES = [c for c in FRONT if c != "close"]


def clean_labels(df: DataFrame, order: str = "ingest_seq", need_close: bool = False, strict: bool = False) -> DataFrame:
    """Typed rows with time and label, one for each symbol and time: the last by `order`. With `strict`, it is an error if none is left."""
    rows = df.withColumns({"timestamp_ms": F.col("timestamp_ms").try_cast("bigint"), "label": F.col("label").try_cast("int")} | ({"close": F.col("close").try_cast("double")} if need_close else {}))
    rows = rows.dropna(subset=["timestamp_ms", "label", *(["close"] if need_close else [])])
    if strict:
        require_rows(rows, "label rows")
    w = W.partitionBy("symbol", "timestamp_ms").orderBy(F.col(order).desc())
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def feature_columns(schema: T.StructType, known: list[str] | None = None) -> list[str]:
    """Numeric columns that aren't outcomes or ids, in order; with `known`, an unknown one is an error."""
    found = [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in (*NOT_FEATURES, "ingest_seq")]
    if not found:
        raise ValueError("no feature column")
    if known is not None and (strange := [c for c in found if c not in known]):
        raise ValueError(f"unknown columns: {strange}")
    return found


def finite_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose features are finite as floats; the features become floats."""
    rows = df.withColumns({c: F.col(c).cast("float") for c in cols})
    fine = F.lit(True)
    for c in cols:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return rows.where(fine)


def lookback_windows(df: DataFrame, cols: list[str], rows_back: int, keep: tuple[str, ...] = ("label",), chunk: int = CHUNK, strict: bool = False) -> DataFrame:
    """(symbol, timestamp_ms, keep, x): the last rows_back rows' features, oldest first, as one array; rows with fewer before them give none.

    Histories are dealt out in chunks of `chunk` rows with the rows_back - 1 rows before each. With `strict`, a symbol of
    fewer than rows_back rows is an error when the rows are read.
    """
    frame = F.array(*[F.col(c).cast("float") for c in cols])
    rows = numbered(df).select("symbol", "timestamp_ms", *keep, frame.alias("row"), "i", "n")
    rows = dealt(rows, chunk, before=rows_back - 1)
    w = W.partitionBy("symbol", "chunk").orderBy("i").rowsBetween(-(rows_back - 1), 0)
    rows = rows.withColumn("frame", F.collect_list("row").over(w))
    whole = F.size("frame") == rows_back
    if strict:
        whole = F.when(F.col("n") < rows_back, F.raise_error(F.concat(F.lit("too few rows for "), "symbol")).cast("boolean")).otherwise(whole)
    return rows.where(F.col("own") & whole).select("symbol", "timestamp_ms", *keep, F.flatten("frame").alias("x"))


def time_split(df: DataFrame, train: float = 0.7, val: float = 0.15, least: int = 100, embargo: int = 0) -> DataFrame:
    """df with split by time order per symbol; `embargo` rows after a border go.

    Symbols with fewer than `least` rows, or with an empty split, are an error when the rows are read.
    """
    rows = numbered(df)
    n, i = F.col("n"), F.col("i")
    rows = rows.withColumn("split", split_at(i, n, train, val, least))
    if embargo:
        first, second = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
        rows = rows.where(~(i.between(first, first + embargo - 1) | i.between(second, second + embargo - 1)))
    return rows.drop("i", "n")


def split_at(i: Column, n: Column, train: float = 0.7, val: float = 0.15, least: int = 100) -> Column:
    """The split of place i of n in time order; an error, once read, for fewer than `least` or an empty split."""
    first, second = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
    error = lambda text: F.raise_error(F.concat(F.lit(text), "symbol")).cast("string")
    split = F.when(n < least, error("too few rows for ")).when((first < 1) | (second <= first) | (second >= n), error("an empty split for "))
    return split.when(i < first, "train").when(i < second, "val").otherwise("test")


def fit_standardizer(train: DataFrame) -> DataFrame:
    """(position, mean, std) of each place of x, with population std, 1 where that is below 1e-12.

    All places are summed together, an array of sums a task, so rows are neither exploded nor shuffled.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = array_to_vector(F.col("x").cast("array<double>"))
    sums = train.groupBy(F.lit(0).alias("all")).agg(Summarizer.metrics("mean", "variance", "count").summary(x).alias("s"))
    n = F.col("s.count").cast("double")
    places = sums.select(n.alias("n"), F.posexplode(F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"))).alias("position", "at"))
    std = F.sqrt(F.col("at.variance") * (F.col("n") - 1) / F.col("n"))
    return places.select("position", F.col("at.mean").alias("mean"), F.when(std < 1e-12, 1.0).otherwise(std).alias("std"))


def slot_statistics(df: DataFrame, cols: list[str], rows_back: int, train: float = 0.7) -> DataFrame:
    """fit_standardizer() of the training part of lookback_windows(df, cols, rows_back) under time_split(), from the rows themselves: no window is built.

    The training windows of a symbol end in its rows from rows_back - 1 on, `first` of them. Slot p of them holds the rows from p to p + first - 1, so a row
    that isn't within rows_back of either end is in every slot. Those are summed once for all slots; only the rows at the ends are dealt to their slots.
    """
    rows = numbered(df).select("i", "n", *[F.col(c).cast("float").cast("double").alias(f"v{k}") for k, c in enumerate(cols)])
    first = F.floor((F.col("n") - (rows_back - 1)) * F.lit(train))
    low, high = F.greatest(F.col("i") - first + 1, F.lit(0)), F.least(F.col("i"), F.lit(rows_back - 1))
    rows = rows.withColumns({"low": low, "high": high}).where((F.col("n") >= rows_back) & (first > 0) & (F.col("low") <= F.col("high")))
    # -1 stands for all slots
    slot = F.when((F.col("low") == 0) & (F.col("high") == rows_back - 1), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.col("low").cast("long"), F.col("high").cast("long")))
    own = rows.withColumn("slot", F.explode(slot)).groupBy("slot").agg(*[F.struct(F.count("*").alias("n"), F.avg(f"v{k}").alias("mean"), (F.var_pop(f"v{k}") * F.count("*")).alias("squares")).alias(f"s{k}") for k in range(len(cols))])
    parts = own.select("slot", F.posexplode(F.array(*[F.col(f"s{k}") for k in range(len(cols))])).alias("place", "s"))
    parts = parts.withColumn("slot", F.explode(F.when(F.col("slot") < 0, F.sequence(F.lit(0).cast("long"), F.lit(rows_back - 1).cast("long"))).otherwise(F.array("slot"))))
    total, mean = F.sum("s.n"), F.sum(F.col("s.n") * F.col("s.mean")) / F.sum("s.n")
    sums = parts.groupBy("slot", "place").agg(total.alias("n"), mean.alias("mean"), F.sum("s.squares").alias("squares"), F.collect_list("s").alias("both"))  # the ends' and the rest
    between = F.aggregate("both", F.lit(0.0), lambda a, s: a + s["n"] * (s["mean"] - F.col("mean")) * (s["mean"] - F.col("mean")))
    std = F.sqrt((F.col("squares") + between) / F.col("n"))
    return sums.select((F.col("slot") * len(cols) + F.col("place")).cast("int").alias("position"), "mean", F.when(std < 1e-12, 1.0).otherwise(std).alias("std"))


def apply_standardizer(df: DataFrame, stats: DataFrame) -> DataFrame:
    """df with x standardized as floats. stats has one row for each place, so its arrays are one small value."""
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("position", "mean", "std"))).alias("s"))
    return df.withColumn("s", packed.scalar()).withColumn("x", F.zip_with("x", "s", lambda v, s: ((v.cast("double") - s["mean"].cast("float").cast("double")) / s["std"].cast("float").cast("double")).cast("float"))).drop("s")


def class_weights(train: DataFrame) -> DataFrame:
    """(label, weight) of the three classes: total over three times the count, absent classes counted as one first."""
    spine = train.sparkSession.range(3).select(F.col("id").cast("int").alias("label"))
    counts = train.groupBy("label").count()
    rows = spine.join(counts, "label", "left").withColumn("count", F.greatest(F.coalesce("count", F.lit(0)), F.lit(1)))
    return rows.select("label", (F.sum("count").over(W.partitionBy(F.lit(1))) / (3 * F.col("count"))).alias("weight"))


def array_at(x: str, i: int) -> Column:
    return F.element_at(x, i + 1)
