"""Mixing sources to target weights.

Tokens are the words of a text; a source's repetition rate is its target over its size. Every document is
emitted floor(rate) times, plus one copy with probability equal to the fraction, drawn from a hash of its
id, so reruns agree. The draws are stratified: documents of a source are dealt to small strata by that
hash, ordered by size inside, and a stratum's draws share one hashed start (systematic sampling). Each
document's copy still is a Bernoulli draw of that probability, but the words that a source gets stay near
its target even where few documents hold many of them.

Null or empty texts have size 0, weigh nothing and are emitted like others; a null source is a source of
its own, last in order. Ties get draws of their own; repeated rows share one. Empty tables
give empty results. Columns that clash with the ones added here are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickspark.llm.common import least_md5_unit, written

#: What parts words.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, source_rows, target): all words shared by weight, no target above most times the source's size.

    Weights repeat over the sources in code-point order, null last. In order of size over weight, the sources
    at their limit are a prefix: one is at it exactly if its share of what those before leave is larger. So
    the excess is reshared without a loop. The windows here run over one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    every = W.partitionBy(F.lit(1))
    order = every.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0))
    weigh = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    per = per.withColumn("left", left).withColumn("weigh", weigh).withColumn("full", F.col("limit") * F.col("weigh") <= F.col("left") * F.col("weight"))
    # the first source below its limit sees what all full ones leave
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("left") / F.col("weigh")))).over(every).getField("col2")
    return per.select("source", "source_size", "source_rows", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * level).alias("target"))


#: Sources up to which their table (a name and two numbers each) is broadcast; beyond, it is joined by shuffle.
MOST_BROADCAST = 20_000
KEY = ("doc_id", "source", "text_hash")


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix", stratum: int = 64) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies and rows of each distinct document; equal rows (their number is in rows) share a draw.

    Only these few columns are shuffled, never texts. Strata have about `stratum` documents, so no window meets a
    whole source.
    """
    per = written(source_targets(docs.select("source", words().alias("size")), weights, most).withColumnRenamed("source", "of_source"), "targets")
    per = F.broadcast(per) if per.count() <= MOST_BROADCAST else per
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), words().alias("size")).groupBy(*KEY, "size").agg(F.count("*").alias("rows"))
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("seed", F.lit(seed))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    rows = rows.withColumn("rate", rate).withColumn("part", rate - F.floor(rate)).withColumn("unit", least_md5_unit("doc_id", "seed"))
    rows = rows.withColumn("stratum", F.floor(F.col("unit") * F.ceil(F.col("source_rows") / F.lit(float(stratum)))).cast("long"))
    inside = W.partitionBy("source", "stratum").orderBy("size", "unit", "doc_id", "text_hash")
    rows = rows.withColumn("rank", F.row_number().over(inside).cast("double")).withColumn("start", least_md5_unit("source", "stratum", "seed"))
    upto = lambda r: F.floor(F.col("start") + r * F.col("part"))
    extra = upto(F.col("rank")) - upto(F.col("rank") - 1)
    return rows.select(*KEY, "size", "source_size", "target", (F.floor(F.col("rate")) + extra).cast("long").alias("copies"), "rows")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed documents with the columns of docs: each row as often as mix_plan() has it. Texts are shuffled once, by document."""
    plan = mix_plan(docs, weights, most, seed).where("copies > 0").select(*[F.col(c).alias(f"plan_{c}") for c in (*KEY, "copies")])
    own = {f"own_{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(new) for new, c in own.items()], *[F.col(c).alias(f"key_{c}") for c in KEY[:2]], F.xxhash64("text").alias("key_text_hash"))
    same = [F.col(f"key_{c}").eqNullSafe(F.col(f"plan_{c}")) for c in KEY]
    out = rows.join(plan, same[0] & same[1] & same[2]).withColumn("copy", F.explode(F.expr("sequence(1L, plan_copies)")))
    return out.select(*[F.col(new).alias(c) for new, c in own.items()])
