"""Decisions from probabilities, and how they compare with the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.operators.labels import NAMES


def weighted_log_loss(df: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """(keys, loss): weighted mean of minus the log of the true class's probability."""
    p = F.element_at(F.array("p_no_trade", "p_long", "p_short"), F.col("label") + 1)
    rows = df.join(F.broadcast(weights), "label").withColumn("l", -F.ln(F.greatest(p, F.lit(1e-300))))
    return rows.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("l")) / F.sum("weight")).alias("loss"))


def threshold_decisions(df: DataFrame, long_at: float | str, short_at: float | str, margin: float | str) -> DataFrame:
    """df with pred and pred_name: a side whose probability reaches its threshold, beats the other side and leads no-trade by margin. Thresholds are numbers or columns."""
    value = lambda x: F.col(x) if isinstance(x, str) else F.lit(float(x))
    p0, pl, ps = (F.col(c) for c in ("p_no_trade", "p_long", "p_short"))
    lead = p0 + value(margin)
    pred = F.when((pl >= value(long_at)) & (pl > ps) & (pl >= lead), 1).when((ps >= value(short_at)) & (ps > pl) & (ps >= lead), 2).otherwise(0)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("pred"))
    return df.withColumn("pred", pred).withColumn("pred_name", name)


def confusion_matrix(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, pred, n) of all nine cells of each key."""
    counts = df.groupBy(*keys, "label", "pred").agg(F.count("*").alias("n"))
    cells = counts.select(*keys).distinct() if keys else counts.sparkSession.range(1).select()
    for c in ("label", "pred"):
        cells = cells.withColumn(c, F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return cells.join(counts, [*keys, "label", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def classification_report(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, class, precision, recall, f1, support) with rows accuracy, macro avg and weighted avg; 0 where nothing divides."""
    n = F.col("n")
    on = lambda c, i: F.sum(F.when(F.col(c) == i, n).otherwise(0))
    right = lambda i: F.sum(F.when((F.col("label") == i) & (F.col("pred") == i), n).otherwise(0))
    sums = cells.groupBy(*keys).agg(F.sum("n").alias("total"), *[f.alias(f"{name}{i}") for i in range(3) for name, f in (("t", right(i)), ("s", on("label", i)), ("q", on("pred", i)))])
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = sums
    for i in range(3):
        t, s, q = (F.col(f"{x}{i}") for x in "tsq")
        rows = rows.withColumns({f"p{i}": over(t, q), f"r{i}": over(t, s), f"f{i}": over(2 * t, s + q)})
    lines = [F.struct(F.lit(name).alias("class"), F.col(f"p{i}").alias("precision"), F.col(f"r{i}").alias("recall"), F.col(f"f{i}").alias("f1"), F.col(f"s{i}").alias("support")) for i, name in NAMES.items()]
    hit = over(F.col("t0") + F.col("t1") + F.col("t2"), F.col("total"))
    lines.append(F.struct(F.lit("accuracy").alias("class"), hit.alias("precision"), hit.alias("recall"), hit.alias("f1"), F.col("total").alias("support")))
    mean = lambda x: (F.col(f"{x}0") + F.col(f"{x}1") + F.col(f"{x}2")) / 3.0
    weigh = lambda x: over(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1") + F.col(f"{x}2") * F.col("s2"), F.col("total"))
    for name, f in (("macro avg", mean), ("weighted avg", weigh)):
        lines.append(F.struct(F.lit(name).alias("class"), f("p").alias("precision"), f("r").alias("recall"), f("f").alias("f1"), F.col("total").alias("support")))
    return rows.select(*keys, F.inline(F.array(*lines)))


def class_counts(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, no_trade, long_setup, short_setup): counts of each class, zeros included."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == i).alias(name.lower()) for i, name in NAMES.items()])
