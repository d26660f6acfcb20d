"""Helpers that several operators of this package share: written tables and Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.sources.scratch import remove, scratch, stored, written

__all__ = ["least_md5_unit", "mix64", "remove", "repeated", "scratch", "slices", "stored", "table", "utf8", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Every row of the batches, in slices whose texts take about most_bytes (one longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty), one after the other, and the n + 1 offsets of the texts in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_md5_unit(*columns: str) -> Column:
    """A number in [0, 1) from the MD5 of the columns' text, the same in every run and in plain SQL."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def repeated(df: DataFrame, times: str, at: str, most: int = 10_000) -> DataFrame:
    """Each row as often as its column `times` (BIGINT, 1 at least) says, with its number from 0 in column `at`; df had better be a written table.

    Numbers beyond `most` come in runs, which are dealt out, so no row, however often repeated, makes a long array or fills one task.
    """
    upto = lambda first, last: F.explode(F.sequence(first, last))
    zero = F.lit(0).cast("long")
    short = df.where(F.col(times) <= most).withColumn(at, upto(zero, F.col(times) - 1))
    long = df.where(F.col(times) > most).withColumn("run", upto(zero, F.floor((F.col(times) - 1) / F.lit(float(most))))).repartition("run", times)
    return short.unionByName(long.withColumn(at, upto(F.col("run") * most, F.least(F.col("run") * most + (most - 1), F.col(times) - 1))).drop("run"))
