"""Near-duplicate embeddings: int8 tile products with rigorous bounds, in full precision where these can't decide.

Vectors are compared only with those of the same label and length, by cosine in double precision. Null,
empty and zero vectors, vectors with null or non-finite components, and vectors without a label link with
nothing. Equal vectors of a label are one class with a count. Classes are dealt to cells around PIVOTS
pivots (a bounded sample) and to blocks of BLOCK; a pair of blocks is compared unless, for some pivot, their
angles to it lie further apart than the threshold's angle, which no linked pair's can. Each vector is
scaled and rounded to int8, with the exact norm of what rounding takes. Pairs of blocks get the rounded vectors
first: products plus the bound from those norms exclude most pairs of vectors. Only to pairs of blocks where some
are left the doubles are shipped, and those pairs are multiplied again. What leaves a task is a
sum of links per class and a spanning forest, never the pairs.

Ids may repeat: each row counts as a vector of its own, whatever its id. Rows with a null id are vectors like
others, with a null component. Empty tables give empty results. Only id, label and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import written
from tickspark.llm.graph import components
from tickspark.llm.neardup import connect, groups, spans

PIVOTS, BLOCK = 16, 512


def lists(column: pa.Array) -> list[np.ndarray]:
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of doubles of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and upper bounds of the norms of x minus scale times row."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-12) + 1e-15


Rounded = tuple[np.ndarray, np.ndarray, np.ndarray]


def possible(left: Rounded, right: Rounded, least: float) -> np.ndarray:
    """Which pairs of rounded unit rows may have a product of at least `least`: no pair that has is left out."""
    (p, a, e), (q, b, f) = left, right
    product = np.zeros((len(p), len(q)))
    for k in range(0, p.shape[1], 1024):  # in floats, sums of up to 1024 products of int8 are exact
        product += p[:, k : k + 1024].astype(np.float32) @ q[:, k : k + 1024].astype(np.float32).T
    # |xy - (x - e)(y - f)| <= |e| |y| + |x - e| |f|
    return product * a[:, None] * b[None, :] + e[:, None] + (1 + e)[:, None] * f[None, :] + 1e-9 >= least


def tile(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of unit rows have a product of at least `least`, in doubles, each pair summed in one order wherever it is met."""
    maybe = possible(quantised(x), quantised(y), least)
    i, j = np.nonzero(maybe)
    step = max(1, 1_000_000 // x.shape[1])
    for k in range(0, len(i), step):
        u, v = i[k : k + step], j[k : k + step]
        maybe[u, v] = (x[u] * y[v]).sum(1) >= least
    return maybe


def comparable(vector: str, label: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def celled(classes: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """classes with `cell`, the pivot at the smallest angle, `angles` to all pivots (of its length; else 0), and the unit vector as int8 q, scale and error."""
    names = ["label", "dim", "node", "n", "v", "cell", "angles", "q", "scale", "error"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dim = lists(batch.column(4)), batch.column(1).to_numpy()
            angles, scale, error = np.zeros((len(vectors), PIVOTS)), np.zeros(len(vectors)), np.zeros(len(vectors))
            rounded = [b""] * len(vectors)
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                x = unit(np.stack([vectors[i] for i in own]))
                q, scale[own], error[own] = quantised(x)
                for i, row in zip(own.tolist(), q, strict=True):
                    rounded[i] = row.tobytes()
                for k, p in enumerate(pivots):
                    angles[own, k] = np.arccos(np.clip(x @ p, -1, 1)) if len(p) == d else 0.0
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * PIVOTS, pa.int32()), pa.array(angles.ravel()))
            cell = pa.array(angles[:, : max(1, len(pivots))].argmin(1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell, flat, pa.array(rounded, pa.binary()), pa.array(scale), pa.array(error)], names)

    kinds = dict(classes.dtypes)
    return classes.select("label", "dim", "node", "n", "v").mapInArrow(deal, f"label {kinds['label']}, dim int, node long, n long, v {kinds['v']}, cell int, angles array<double>, q binary, scale double, error double")


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole pairs of blocks, and where each pair begins and ends."""
    for found in groups(batches, 1):
        found = found.combine_chunks()
        cut = spans(found, 1).tolist()
        yield found, list(zip(cut[:-1], cut[1:], strict=True))


def promising(shipped: DataFrame, threshold: float) -> DataFrame:
    """The pairs of blocks in which, by the bounds of their rounded vectors, some pair may link."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in tables(batches):
            side, scale, error = (table[c].to_numpy() for c in ("side", "scale", "error"))
            names, rows, found = table["pair"], table["q"].to_pylist(), []
            for b, e in cuts:
                k = b + int((side[b:e] == 0).sum())
                q = np.frombuffer(b"".join(rows[b:e]), np.int8).reshape(e - b, -1)
                left, right = ((q[i - b : j - b], scale[i:j], error[i:j]) for i, j in ((b, k), (k, e) if k < e else (b, e)))
                maybe = possible(left, right, threshold)
                if k == e:
                    np.fill_diagonal(maybe, False)
                if maybe.any():
                    found.append(names[b].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["pair"])

    return shipped.repartition("pair").sortWithinPartitions("pair", "side", "node").mapInArrow(look, "pair string")


def linked(shipped: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): sums of links of nodes a (b is null), and a spanning forest's edges (a, b) of each pair of blocks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in tables(batches):
            side, nodes, n = (table[c].to_numpy() for c in ("side", "node", "n"))
            vectors = lists(table["v"].chunk(0))
            found = []
            for b, e in cuts:
                x = unit(np.stack(vectors[b:e]))
                k = int((side[b:e] == 0).sum())
                near = np.zeros((e - b, e - b), bool)
                if k == e - b:
                    near = tile(x, x, threshold)
                    np.fill_diagonal(near, False)
                else:
                    near[:k, k:] = tile(x[:k], x[k:], threshold)
                    near[k:, :k] = near[:k, k:].T
                some = np.flatnonzero(near.any(1))
                if not len(some):
                    continue
                own, links = nodes[b:e], near @ n[b:e]
                found += [(int(own[i]), None, int(links[i])) for i in some.tolist()]
                sub = near[np.ix_(some, some)]
                tops = connect(len(some), lambda i, sub=sub: sub[i])
                found += [(int(own[some[i]]), int(own[some[j]]), 0) for i, j in enumerate(tops.tolist()) if i != j]
            a, b2, links = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b2, pa.int64()), pa.array(links, pa.int64())], ["a", "b", "links"])

    return shipped.repartition("pair").sortWithinPartitions("pair", "side", "node").mapInArrow(compare, "a long, b long, links long")


def near_vectors(df: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id) of each row."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"), comparable(vector, label).alias("fine"))
    rows = rows.withColumns({"dim": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    same = ["label", "dim", "h1", "h2"]
    classes = rows.where("fine").groupBy(*same).agg(F.min("id").alias("least"), F.count("*").alias("n"), F.max("v").alias("v"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    drawn = classes.select("v", F.xxhash64(F.lit("pivot"), "h1").alias("o")).orderBy("o").limit(PIVOTS).collect()
    pivots = [unit(np.array([r.v]))[0] for r in drawn] or [np.zeros(0)]
    dealt = celled(classes, pivots)
    block = ["label", "dim", "cell", "block"]
    held = dealt.groupBy(*block[:3]).agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).alias("blocks"))
    dealt = written(dealt.join(held, block[:3]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks"), "cells")
    seen = dealt.groupBy(*block).agg(*[f(F.col("angles")[i]).alias(f"{n}{i}") for i in range(len(pivots)) for n, f in (("least", F.min), ("most", F.max))])
    left, right = (seen.select("label", "dim", *[F.col(c).alias(f"{s}_{c}") for c in seen.columns if c not in ("label", "dim")]) for s in "xy")
    reach = float(np.arccos(threshold)) + 1e-6
    pairs = left.join(right, ["label", "dim"]).where((F.col("x_cell") < F.col("y_cell")) | ((F.col("x_cell") == F.col("y_cell")) & (F.col("x_block") <= F.col("y_block"))))
    for i in range(len(pivots)):
        pairs = pairs.where((F.col(f"x_least{i}") <= F.col(f"y_most{i}") + reach) & (F.col(f"y_least{i}") <= F.col(f"x_most{i}") + reach))
    name = F.concat_ws("/", "label", "dim", "x_cell", "x_block", "y_cell", "y_block")
    pairs = written(pairs.select("label", "dim", "x_cell", "x_block", "y_cell", "y_block", name.alias("pair")), "pairs")

    def shipped(pairs: DataFrame, *columns: str) -> DataFrame:
        sides = pairs.select("label", "dim", F.col("x_cell").alias("cell"), F.col("x_block").alias("block"), "pair", F.lit(0).alias("side"))
        sides = sides.union(pairs.where("x_cell <> y_cell or x_block <> y_block").select("label", "dim", "y_cell", "y_block", "pair", F.lit(1)))
        return dealt.select(*block, *columns).join(sides, block).select("pair", "side", *columns)

    some = written(promising(shipped(pairs, "node", "q", "scale", "error"), threshold), "promising")
    found = written(linked(shipped(pairs.join(some, "pair", "left_semi"), "node", "n", "v"), threshold), "links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    tops = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "node").join(classes.select("node", "least"), "node")
    tops = tops.join(tops.groupBy("component").agg(F.min("least").alias("reached")), "component").select("node", "reached")
    label_of = classes.select(*same, "n", "node", "least").join(links, "node", "left").join(tops, "node", "left")
    label_of = label_of.select(*same, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("reached", "least").alias("component"), F.lit(True).alias("fine"))
    out = rows.select("id", "fine", *same).join(label_of, ["fine", *same], "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
