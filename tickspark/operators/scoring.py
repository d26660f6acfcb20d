"""Scores: a distributed classifier, the lookback MLP from exported weights, and a linear scorer in SQL terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.operators.bars import CHUNK, dealt, numbered
from tickspark.operators.dataset import split_at

PROBABILITIES = ["p_no_trade", "p_long", "p_short"]


def fit_baseline(train: DataFrame, weights: DataFrame, iterations: int = 20):
    """A multinomial logistic regression on standardized windows x, weighted by class; its transform() scores."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.join(F.broadcast(weights), "label").withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", maxIter=iterations, regParam=1e-3).fit(rows)


def score_baseline(model, df: DataFrame) -> DataFrame:
    """df with the three probabilities of a fitted baseline."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = model.transform(df.withColumn("features", array_to_vector(F.col("x").cast("array<double>"))))
    p = vector_to_array("probability")
    return rows.withColumns({name: p[i] for i, name in enumerate(PROBABILITIES)}).select(*df.columns, *PROBABILITIES)


def erf(x: np.ndarray) -> np.ndarray:
    """Error function to 1e-12: its Taylor series near 0, a continued fraction's convergents further out."""
    a = np.abs(x).astype(np.float64)
    small = np.minimum(a, 3.0)
    term, total = small.copy(), small.copy()
    for n in range(1, 80):
        term = term * -(small * small) / n
        total = total + term / (2 * n + 1)
    big = np.maximum(a, 3.0)
    tail = np.zeros_like(big)
    for k in range(60, 0, -1):
        tail = k / 2 / (big + tail)
    far = 1 - np.exp(-big * big) / np.sqrt(np.pi) / (big + tail)
    return np.sign(x) * np.where(a < 3.0, 2 / np.sqrt(np.pi) * total, far)


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + erf(x / np.sqrt(2)))


def mlp_forward(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Class probabilities of rows x.

    weights: for block i, w{i}a b{i}a g{i}a s{i}a (linear, then layer norm's gain and shift), the same with b, and the
    head's hw1 hb1 hw2 hb2. A block whose width equals its input's adds its input.
    """

    def norm(z: np.ndarray, gain: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (z - z.mean(1, keepdims=True)) / np.sqrt(z.var(1, keepdims=True) + 1e-5) * gain + shift

    h, i = x.astype(np.float64), 0
    while f"w{i}a" in weights:
        z = h
        for part in "ab":
            z = gelu(norm(z @ weights[f"w{i}{part}"].T + weights[f"b{i}{part}"], weights[f"g{i}{part}"], weights[f"s{i}{part}"]))
        h = z + h if z.shape == h.shape else z
        i += 1
    logits = gelu(h @ weights["hw1"].T + weights["hb1"]) @ weights["hw2"].T + weights["hb2"]
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def score_mlp(df: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """df with the three probabilities of the MLP; x goes through numpy in Arrow batches, weights are shipped once."""
    held = df.sparkSession.sparkContext.broadcast(weights)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            p = mlp_forward(np.stack(part["x"].to_numpy()), held.value) if len(part) else np.zeros((0, 3))
            yield part.assign(**{name: p[:, i] for i, name in enumerate(PROBABILITIES)})

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(score, f"{schema}, " + ", ".join(f"{n} double" for n in PROBABILITIES))


def score_windows(df: DataFrame, cols: list[str], rows_back: int, stats: DataFrame, weights: dict[str, np.ndarray], keep: tuple[str, ...] = ("label",), least: int = 100, chunk: int = CHUNK, batch: int = 4096) -> DataFrame:
    """(symbol, timestamp_ms, keep, split, probabilities): score_mlp() of the standardized lookback_windows() of df under time_split(), with no window stored.

    Rows are dealt to chunks once, with the rows_back - 1 rows before each. There a strided view over the chunk's matrix stands for its windows; `batch` of
    them at a time are standardized and scored, so what is shuffled doesn't grow with rows_back. stats has a row for each place of a window, a size that the
    model sets, and goes to the driver with the weights. As in lookback_windows(), rows with fewer before them give none.
    """
    width = rows_back * len(cols)
    places = {r["position"]: (r["mean"], r["std"]) for r in stats.collect()}
    if places and set(places) != set(range(width)):
        raise ValueError(f"statistics of {len(places)} places for windows of {width}")
    single = np.array([places.get(p, (0.0, 1.0)) for p in range(width)], np.float32).astype(np.float64)
    held = df.sparkSession.sparkContext.broadcast((weights, single[:, 0], single[:, 1]))
    values = [f"v{k}" for k in range(len(cols))]
    before = rows_back - 1
    rows = numbered(df.select("symbol", "timestamp_ms", *keep, *[F.col(c).cast("float").alias(v) for c, v in zip(cols, values, strict=True)]))
    split = F.when(F.col("i") >= before, split_at(F.col("i") - before, F.col("n") - before, least=least))
    rows = dealt(rows.withColumn("split", split), chunk, before=before)
    kept = ["symbol", "timestamp_ms", *keep, "split"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        model, mean, std = held.value
        ends = np.flatnonzero(pdf["own"].to_numpy() & (pdf["i"].to_numpy() >= before))
        matrix = pdf[values].to_numpy(np.float32)
        p = np.zeros((len(ends), 3))
        if len(ends):
            view = np.lib.stride_tricks.sliding_window_view(matrix, rows_back, axis=0).swapaxes(1, 2)
        for at in range(0, len(ends), batch):
            x = view[ends[at : at + batch] - before].reshape(-1, width).astype(np.float64)
            p[at : at + batch] = mlp_forward(((x - mean) / std).astype(np.float32), model)
        return pdf.loc[ends, kept].assign(**{name: p[:, k] for k, name in enumerate(PROBABILITIES)})

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + "".join(f", {n} double" for n in PROBABILITIES)
    return rows.select(*kept, "chunk", "own", "i", *values).groupBy("symbol", "chunk").applyInPandas(score, schema)


def softmax_linear(df: DataFrame, coefficients: list[dict[str, float]], intercepts: list[float]) -> DataFrame:
    """df with logits (array of three) and the three probabilities of a linear scorer on columns."""
    logit = lambda i: sum((F.col(c) * F.lit(float(k)) for c, k in coefficients[i].items()), F.lit(float(intercepts[i])))
    rows = df.withColumn("logits", F.array(*[logit(i) for i in range(3)]))
    top = F.array_max("logits")
    e = [F.exp(F.col("logits")[i] - top) for i in range(3)]
    return rows.withColumns({name: e[i] / (e[0] + e[1] + e[2]) for i, name in enumerate(PROBABILITIES)})


def argmax_pred(x: str = "logits") -> Column:
    """Place of the largest value, the first of equal ones."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")
