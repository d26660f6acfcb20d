"""Importance resampling towards a target corpus: documents whose n-grams the target likes are drawn more often.

Features are runs of one to three words, hashed into buckets. A slice of documents becomes inverted postings (bucket, document, count),
packed for each group of buckets, which are shuffled by group, a group in as many salted keys as there is data for, and written so. Totals of
both corpora in a group's buckets meet and give the buckets' gains; each packed group meets its gains, and emits what it contributes to
its documents; a slice's contributions are added up in a last shuffle. A bucket holds a document once, with its count, so no word,
however common, makes a key larger than the documents.

The draw orders documents by range: they are sorted by score in ranges, and a range's documents are numbered behind those
of the ranges before it, so no task and no driver sees all scores.

Null texts have no words; texts without words have weight 0 and aren't drawn. A null id counts as the empty text in the hash and comes last among
ties; repeated rows each count, and are drawn, as documents of their own. An empty corpus gives no rows, an empty
target gains of what the corpus alone says. Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickspark.llm.common import remove, scratch, slices, stored, utf8, written

BUCKETS = 10_000
#: Buckets that are packed together, and UTF-8 bytes of a slice of documents.
WIDTH, SLICE = 100, 4 << 20
GROUPS = BUCKETS // WIDTH
#: The longest word whose checksum is worked out with others, byte by byte.
SHORT = 63


def _checksum_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of single bytes, and ahead[n, k, v]: byte v at place k of a checksum, moved on by n zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    ahead = np.empty((SHORT + 1, 4, 256), np.uint32)
    ahead[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(SHORT):
        ahead[n + 1] = byte[ahead[n] & 255] ^ (ahead[n] >> 8)
    return byte, ahead


BYTE, AHEAD = _checksum_tables()
#: Bytes as words hold them, A-Z in small letters, and which bytes words are made of: digits, letters, and all beyond ASCII.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums with so many zero bytes behind: crc32(a + b) is moved(crc32(a), len(b)) ^ crc32(b)."""
    crc, left = crc.copy(), by
    while True:
        n = np.minimum(left, SHORT)
        crc = AHEAD[n, 0, crc & 255] ^ AHEAD[n, 1, crc >> 8 & 255] ^ AHEAD[n, 2, crc >> 16 & 255] ^ AHEAD[n, 3, crc >> 24]
        left = left - n
        if not left.any():
            return crc


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of each word of texts laid end to end (lower-cased bytes, n + 1 offsets), and the words of each text."""
    inside = IN_WORD[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | border[1:-1]
    last[:-1] &= ~inside[1:] | border[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start, np.diff(np.searchsorted(start, offsets))


def word_checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: the i-th bytes of all words together; longer words than SHORT one by one."""
    crc = np.zeros(len(start), np.uint32)
    short = np.flatnonzero(length <= SHORT)
    order = short[np.argsort(length[short].astype(np.uint8), kind="stable")[::-1]]
    sizes, at = length[order], start[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -i, "left"))  # words longer than i
        c[:k] = BYTE[(c[:k] ^ data[at[:k] + i]) & 255] ^ (c[:k] >> 8)
    crc[order] = ~c
    for i in np.flatnonzero(length > SHORT).tolist():
        crc[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes())
    return crc


def feature_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """bucket * texts + text of each feature of the texts, repeats counted, and the words of each text."""
    data = SMALL[data]
    start, length, words = word_places(data, offsets)
    text = np.repeat(np.arange(len(words), dtype=np.uint64), words)
    crc = word_checksums(data, start, length)
    spaced = moved(crc, np.ones(len(crc), np.int64)) ^ np.uint32(zlib.crc32(b" "))  # with a space behind
    two = text[1:] == text[:-1]
    pairs = moved(spaced[:-1], length[1:]) ^ crc[1:]
    three = two[1:] & two[:-1]
    triples = moved(moved(spaced[:-2], length[1:-1] + 1) ^ spaced[1:-1], length[2:]) ^ crc[2:]
    crcs, texts = np.concatenate([crc, pairs[two], triples[three]]), np.concatenate([text, text[1:][two], text[2:][three]])
    return (crcs % BUCKETS).astype(np.uint64) * np.uint64(len(words)) + texts, words


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, byte plane by byte plane, compressed: planes of small numbers are empty and cost nothing."""
    planes = np.stack(columns).astype("<i8").view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[:, :, 0]


POSTINGS = "corpus int, slice long, grp int, n int, totals binary, postings binary, ids binary, words binary"


def postings(texts: DataFrame, corpus: int, key: str | None, text: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """Slices of texts as postings: for each group of buckets the totals of its buckets, and with a key (gap to the next bucket * n + text, count) packed.

    With a key, each slice has a row of group -1 with its ids and word counts, too.
    """

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", slice_bytes):
            keys, words = feature_keys(*utf8(batch.column(0)))
            n = len(words)
            keys = np.sort(keys.astype(np.uint32) if BUCKETS * n < 1 << 32 else keys).astype(np.int64)
            begins = np.flatnonzero(np.diff(keys, prepend=-1))
            count, keys = np.diff(begins, append=len(keys)), keys[begins]
            totals = np.bincount(keys // n, count, BUCKETS).astype(np.int64)
            cut = np.searchsorted(keys, np.arange(GROUPS + 1) * (WIDTH * n))
            rows = [(corpus, name, -1, n, None, None, packed(batch.column(1).to_numpy(zero_copy_only=False)), packed(words))] if key else []
            for g in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[g], cut[g + 1])
                gaps = np.diff(keys[own], prepend=g * WIDTH * n)
                rows.append((corpus, name, g, n, packed(totals[g * WIDTH : (g + 1) * WIDTH]), packed(gaps, count[own]) if key else None, None, None))
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in POSTINGS.split(", ")])
            name += 1

    rows = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id") if key else F.lit(0).cast("long").alias("id"))
    return rows.mapInArrow(invert, POSTINGS)


#: Stands for a null id inside packed ids.
NO_ID = -(1 << 63)


def bucket_gains(index: DataFrame) -> DataFrame:
    """(grp, gains): floor(1000 ln) of the smoothed ratio of target to corpus in each bucket of a group, from the totals of the postings of both."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for corpus, g, totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[corpus, g] = sums.get((corpus, g), 0) + unpacked(totals, 1)[0]
        if sums:
            both = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in both], pa.int32()), pa.array([g for _, g in both], pa.int32()), pa.array([sums[k].tolist() for k in both], pa.list_(pa.int64()))], ["corpus", "grp", "totals"])

    sums = index.where("grp >= 0").select("corpus", "grp", "totals").mapInArrow(added, "corpus int, grp int, totals array<long>")
    of = lambda corpus, name: F.sum(F.when(F.col("corpus") == corpus, F.col("total")).otherwise(0)).alias(name)
    buckets = written(sums.select("corpus", "grp", F.posexplode("totals").alias("place", "total")).groupBy("grp", "place").agg(of(0, "s"), of(1, "t")), "buckets")
    size = buckets.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    up, down = (F.col("t") + 1).cast("double") * F.lit(float(size.s + BUCKETS)), (F.col("s") + 1).cast("double") * F.lit(float(size.t + BUCKETS))
    gain = F.floor(1000.0 * F.ln(up / down))
    return buckets.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", gain.alias("gain")))), lambda x: x["gain"]).alias("gains"))


def document_weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) of every document, weight the sum of its features' gains. A written table."""
    spark = docs.sparkSession
    salts = max(1, -(-8 * int(spark.conf.get("spark.sql.shuffle.partitions")) // GROUPS))
    path = scratch(spark, "postings")
    both = postings(docs, 0, key, text).unionByName(postings(target, 1, None, text))
    index = stored(both.repartition("grp", F.pmod(F.xxhash64("slice"), F.lit(salts))), path)
    gains = F.broadcast(bucket_gains(index))  # a number for each bucket, so BUCKETS of them

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            for name, n, data, gain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                gap, count = unpacked(data.as_buffer().to_pybytes(), 2)
                bucket, doc = np.divmod(np.cumsum(gap), n)
                own = np.bincount(doc, count * gain.values.to_numpy()[bucket], n).astype(np.int64)
                sums[name] = sums.get(name, 0) + own
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([packed(v << 1 ^ v >> 63) for v in sums.values()], pa.binary())], ["slice", "sums"])

    parts = index.where("corpus = 0 and grp >= 0").select("grp", "slice", "n", "postings").join(gains, "grp").select("slice", "n", "postings", "gains").mapInArrow(contribute, "slice long, sums binary")
    rows = index.where("corpus = 0 and grp = -1").select("slice", "ids", "words", F.lit(None).cast("binary").alias("sums"))
    rows = rows.unionByName(parts.select("slice", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("words"), "sums"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, words, total = None, None, None, 0

        def out() -> Iterator[pa.RecordBatch]:
            if name is not None:
                features = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(words), pa.array(features), pa.array(np.zeros(len(words), np.int64) + total)], [key, "n_words", "n_features", "weight"])

        for batch in batches:
            for s, i, w, v in zip(*(batch.column(c) for c in range(4)), strict=True):
                if s.as_py() != name:
                    yield from out()
                    name, total = s.as_py(), 0
                if i.is_valid:
                    ids, words = unpacked(i.as_buffer().to_pybytes(), 1)[0], unpacked(w.as_buffer().to_pybytes(), 1)[0]
                else:
                    z = unpacked(v.as_buffer().to_pybytes(), 1)[0]
                    total = total + (z >> 1 ^ -(z & 1))
        yield from out()

    weighed = written(rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(reduce, f"{key} long, n_words long, n_features long, weight long"), "weights")
    remove(spark, path)
    return weighed


def drawn(weighed: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """weighed with score (weight and a Gumbel number of the seed and id) and rank from 1 in the draw, null outside: the floor of the share of documents with least_words words that score highest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    rows = weighed.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))))
    long = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ordered = written(rows.where(long).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("range", F.shiftright("at", 33))
    sizes = ordered.groupBy("range").agg(F.count("*").alias("here"))  # one row a task
    before = sizes.select("range", F.coalesce(F.sum("here").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    draw = ordered.count() * share[0] // share[1]
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.join(before, "range").withColumn("rank", F.when(rank <= draw, rank)).drop("at", "range", "before")
    return ranked.unionByName(rows.where(~long).withColumn("rank", F.lit(None).cast("long")))
