"""Audit of filters that interact: what each removes of each part of a corpus, in every order they can be applied in.

Duplicates are found by sorting. Rows are dealt by ranges of (fingerprint, id) and sorted in their tasks by fingerprint, text and id,
so a group of copies, however large, is cut by id into as many tasks as it fills, and a row need only look at the one before it. What a
task can't see lies across its borders: rows of its first fingerprint without an earlier copy stay open, and the least ids of the texts
of its last fingerprint are its tails. Open rows are held against tails by full text; there are about as many of both as tasks.

Each row then has a mask, one bit for each filter it fails. Masks are counted by part, and all orders, overlaps and Shapley values
are sums of these counters, so nothing is filtered twice, and no row is read again for another order.

Null texts count as empty, null parts as the part with the empty name. A duplicate is a row whose text some row with a
smaller id has; rows with a null id are no duplicates and make none, and repeated rows of one id don't make each other
duplicates. Labels of a repeated or null id: a document is good (toxic) if one of its label rows says so, null ids have no labels.
Empty tables give no rows, and other columns don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickspark.llm.common import remove, scratch, stored, written

#: What separates words.
SPACES = r"[\x20\x09-\x0D]+"
DECIDED, OPEN, TAIL = 0, 1, 2


def content_filters(text: str = "text") -> dict[str, Column]:
    """Failure of the filters that look at one text, by name; `words` is the column of its words."""
    size, length = F.size("words"), F.length(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": size < 200, "B": 100 * F.size(F.array_distinct("words")) < 50 * size, "C": 100 * capitals > 2 * length, "D": F.col(text).rlike("[#$%&*|]")}


def looked_back(batches: Iterator[pa.RecordBatch], bit: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fp, text, id, part, mask) of a task with `bit` in the mask of each whose text has a smaller id before it.

    Gives (kind, id, part, mask, fp, text): decided rows without their text, rows that an earlier task may yet decide, and tails.
    """
    first_fp = last_fp = last_text = last_least = None
    tails: dict[str, int] = {}
    none = np.iinfo(np.int64).max

    def given(kind: int, ids: pa.Array, part: pa.Array, mask: np.ndarray, fp: pa.Array, text: pa.Array) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(ids), kind, np.int32)), ids, part, pa.array(mask.astype(np.int32)), fp, text]
        return pa.RecordBatch.from_arrays(columns, ["kind", "id", "part", "mask", "fp", "text"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fps, texts, ids = batch.column(0), batch.column(1), batch.column(2)
        fp, mask = fps.to_numpy(), batch.column(4).to_numpy().copy()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        number = pc.fill_null(ids, none).to_numpy()
        # a row begins a text unless the one before has the same
        begins = np.ones(n, bool)
        at = np.flatnonzero(fp[1:] == fp[:-1]) + 1
        if len(at):
            begins[at] = ~pc.equal(texts.take(pa.array(at)), texts.take(pa.array(at - 1))).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(begins)
        least = np.minimum.reduceat(number, starts)
        if last_fp == fp[0] and last_text == texts[0].as_py():
            least[0] = min(least[0], last_least)
        of_row = least[np.cumsum(begins) - 1]
        repeated = known & (number > of_row)
        mask[repeated] |= bit
        first_fp = fp[0] if first_fp is None else first_fp
        still_open = known & ~repeated & (fp == first_fp)
        for kind, own in ((DECIDED, ~still_open), (OPEN, still_open)):
            if own.any():
                take = pa.array(own)
                yield given(kind, ids.filter(take), batch.column(3).filter(take), mask[own], fps.filter(take), texts.filter(take) if kind else pa.nulls(int(own.sum()), pa.string()))
        if last_fp != fp[-1]:
            tails = {}
        for s, low in zip(starts.tolist(), least.tolist(), strict=True):
            if fp[s] == fp[-1] and low < none:
                tails[texts[s].as_py()] = low
        last_fp, last_text, last_least = fp[-1], texts[n - 1].as_py(), least[-1]
    if tails:
        ids = pa.array(list(tails.values()), pa.int64())
        yield given(TAIL, ids, pa.nulls(len(ids), pa.string()), np.zeros(len(ids), np.int32), pa.array(np.full(len(ids), last_fp), pa.int64()), pa.array(list(tails), pa.string()))


def failure_masks(docs: DataFrame, filters: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(kind, id, part, mask, fp, text), a written table: a bit for each of the filters that a row fails, in their order, then one for duplicates.

    Filters are columns over text and words. They are worked out behind the shuffle, so that sampling the ranges doesn't do it as well.
    """
    filters = content_filters() if filters is None else filters
    rows = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("fp"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"))
    rows = rows.repartitionByRange("fp", "id").sortWithinPartitions("fp", "text", "id")
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), "")).select("fp", "text", "id", "part", mask.alias("mask"))
    bit = 1 << len(filters)
    return rows.mapInArrow(lambda batches: looked_back(batches, bit), "kind int, id long, part string, mask int, fp long, text string")


def counters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and labelled ones with quality 1 or toxic 1, of each part by the filters they fail. A written table, that small."""
    bit = 1 << len(content_filters() if filters is None else filters)
    path = scratch(docs.sparkSession, "masks")
    seen = stored(failure_masks(docs, filters, key, text, part), path)
    tails = seen.where(F.col("kind") == TAIL).groupBy("fp", "text").agg(F.min("id").alias("least"))
    late = seen.where(F.col("kind") == OPEN).join(tails, ["fp", "text"], "left").select("id", "part", (F.col("mask") + F.when(F.col("least") < F.col("id"), bit).otherwise(0)).alias("mask"))
    rows = seen.where(F.col("kind") == DECIDED).select("id", "part", "mask").unionByName(late)
    # equal rows meet before they look for labels, so that a null or repeated id is a few rows
    rows = rows.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    told = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    out = written(rows.join(told, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic")), "counters")
    remove(docs.sparkSession, path)
    return out


def in_every_order(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters (a permutation of names) and step, from counters; zeros included.

    A step depends on the set of filters before it and on its own, so sums are taken for each such pair (80 for five filters) and then
    dealt to the orders, whose table is as large as the number of filters makes it.
    """
    n = len(names)
    pairs = [(before, i) for i in range(n) for before in range(1 << n) if not before >> i & 1]
    pair = F.explode(F.array(*[F.struct(F.lit(before).alias("before"), F.lit(1 << i).alias("bit"), F.lit(math.factorial(k := before.bit_count()) * math.factorial(n - 1 - k)).cast("long").alias("times")) for before, i in pairs]))
    rows = counted.select("*", pair.alias("p")).select("part", "mask", "n", "good", "toxic", "p.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    of = lambda c, when, name: F.sum(F.when(when, F.col(c)).otherwise(0)).alias(name)
    sums = rows.groupBy("part", "bit", "before", "times").agg(
        of("n", ~fails & ~gone, "kept"), of("n", fails & ~gone, "removed"), of("n", fails & gone, "redundant"), of("n", F.col("mask") == F.col("bit"), "unique_fails"),
        of("good", fails & ~gone, "good_lost"), of("toxic", fails & ~gone, "toxic_lost"),
    )
    sums = sums.withColumn("shapley", F.sum(F.col("removed") * F.col("times")).over(W.partitionBy("part", "bit")))
    steps = [("".join(names[i] for i in order), k + 1, sum(1 << i for i in order[:k]), 1 << order[k]) for order in itertools.permutations(range(n)) for k in range(n)]
    table = F.broadcast(counted.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, bit int"))
    return sums.join(table, ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
