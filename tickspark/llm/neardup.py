"""Near-duplicate documents by SetSketch registers, with every link confirmed on full sets.

A document's set are the distinct shingles (runs of SHINGLE words) of its text with A-Z lowered; words are
what ASCII white space parts. With fewer words, the whole sequence is its one shingle; without words (or
text) the set is empty and links with nothing. Documents link if their sets' Jaccard similarity is at least
`percent` hundredths.

1. Each set becomes a sketch of REGISTERS registers, each the exponentially spaced minimum of exponential
   hash values (base BASE, rate RATE). Sketches merge by maxima, and registers of two sets agree about as
   often as the sets' Jaccard similarity. Equal sets (128 bits of BLAKE2b over all of a set) are one class from here on.
2. Bands of registers bring classes together. Their width is the largest with which a pair at the threshold
   shares no band with probability below MISS: 7 (36 bands) at 0.85, where it is 9e-7, and 6 (42 bands) at 0.8, where
   it is 3e-6; pairs above are missed far less often. A bucket of more than BLOCK classes is compared in blocks (every_link), so
   that no task holds a bucket of any size.
3. Inside a bucket, the joint likelihood of the two sketches (numbers of larger, equal and smaller registers,
   and the known set sizes) says whether the similarity's estimate is at least LOOSE; the classes that this
   connects form a cell. Only a spanning forest leaves the task, never all pairs.
4. A cell's texts meet once (large cells in blocks, as before); all pairs' intersections are counted exactly as
   products of incidence matrices over shared shingles; again a spanning forest of the links leaves the task.
5. Components of those links give each document the smallest id that it reaches.

Rows are documents, also those that share an id: each has its own set, and an id alone links nothing. A null
id links with nothing and has a null component. Empty tables give empty results. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import mix64, slices, utf8, written
from tickspark.llm.graph import components

REGISTERS, MISS = 256, 1e-5
BASE, RATE, LIMIT = 1.001, 20.0, 65534
BLOCK = 2048
#: Similarity below the threshold, more than five standard errors of the estimate away, where a pair still is a candidate.
LOOSE_BELOW = 0.13
#: Classes and shingles of a block of a cell.
CELL_BLOCK, CELL_SHINGLES = 256, 1_000_000
#: Column of keep_one's row key.
ROW = "neardup_row_key"

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20240101)
#: A random odd number for each byte; capitals have those of small letters.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | U(1)
BYTE[65:91] = BYTE[97:123]
FACTOR = U(0x9E3779B97F4A7C15)
LOW = np.cumprod(np.concatenate([[U(1)], np.full(65535, FACTOR)]))
HIGH = np.cumprod(np.concatenate([[U(1)], np.full(4095, U(pow(int(FACTOR), 65536, 1 << 64)))]))
SALT = _rng.integers(0, 2**64, REGISTERS, dtype=np.uint64) | U(1)


def word_hashes(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts flat[at[i] : at[i + 1]], and the n + 1 offsets of the texts in them."""
    found, starts_all, begin = [], [], 0
    edge = np.zeros(len(flat) + 1, bool)
    edge[at] = True
    while begin < len(flat):
        end = min(len(flat), begin + (1 << 20))
        while end < len(flat):  # to the next white space, so that no word is cut
            if len(gap := np.flatnonzero(SPACE[flat[end : end + 65536]])):
                end += int(gap[0])
                break
            end = min(len(flat), end + 65536)
        part = flat[begin:end]
        word = ~SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[begin + 1 : end]
        place = np.flatnonzero(word)
        starts = np.flatnonzero(first[place])
        if len(starts):
            sizes = np.diff(np.concatenate([starts, [len(place)]]))
            pos = np.arange(len(place)) - np.repeat(starts, sizes)
            power = LOW[pos & 65535] if sizes.max() <= 65536 else LOW[pos & 65535] * HIGH[pos >> 16]
            found.append(mix64(np.add.reduceat(BYTE[part[place]] * power, starts) + sizes.astype(U)))
            starts_all.append(place[starts] + begin)
        begin = end
    hashes = np.concatenate(found) if found else np.zeros(0, U)
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    return hashes, np.searchsorted(starts, at)


def shingle_sets(flat: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit hashes, one text after the other, and n + 1 offsets."""
    words, begin = word_hashes(flat, at)
    count = np.diff(begin)
    runs = np.zeros(max(0, len(words) - size + 1), U)
    for i in range(size):
        runs = mix64(runs + words[i : len(words) - size + 1 + i] * U(2 * i + 3)) if len(runs) else runs
    sets = []
    for n, b in zip(count.tolist(), begin[:-1].tolist(), strict=True):
        if n >= size:
            sets.append(np.unique(runs[b : b + n - size + 1]))
        elif n:
            h = np.array([n], U)
            for w in words[b : b + n]:
                h = mix64(h * FACTOR + w)
            sets.append(h)
        else:
            sets.append(np.zeros(0, U))
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sketches(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (n, REGISTERS) of the sets flat[at[i] : at[i + 1]]; those of an empty set are 0.

    An element's k-th smallest value lies in the k-th of REGISTERS parts of equal probability and goes to the
    k-th register of its own order, so a round over all elements is done once no register is above its part.
    """
    n, m = len(at) - 1, REGISTERS
    least = np.full(n * m, 1.0)
    owner = np.repeat(np.arange(n), np.diff(at))
    seed, todo = mix64(flat ^ U(0x5BF03635)), flat
    for k in range(m):
        if not len(owner):
            break
        register = ((seed & U(m - 1)) + U(k) * ((seed >> U(8)) | U(1))) & U(m - 1)
        unit = (mix64(todo + U((k + 1) * int(FACTOR) & (1 << 64) - 1)) >> U(11)).astype(np.float64) * 2.0**-53
        np.minimum.at(least, owner * m + register.astype(np.int64), (k + unit) / m)
        going = least.reshape(n, m).max(1) > (k + 1) / m
        stay = going[owner]
        if not stay.all():
            owner, seed, todo = owner[stay], seed[stay], todo[stay]
    with np.errstate(divide="ignore"):
        value = -np.log1p(-least) / RATE
        out = np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(BASE)), 0, LIMIT + 1)
    out[np.isinf(value)] = 0
    return out.astype(np.uint16).reshape(n, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_shape(similarity: float) -> tuple[int, int]:
    """Number and width of bands for a threshold."""
    for width in range(16, 1, -1):
        if (1 - similarity**width) ** (REGISTERS // width) <= MISS:
            return REGISTERS // width, width
    return REGISTERS, 1


def band_keys(registers: np.ndarray, bands: int, width: int) -> np.ndarray:
    used = (registers[:, : bands * width].astype(U) + U(1)) * SALT[: bands * width]
    return mix64(used.reshape(len(registers), bands, width).sum(2, dtype=U) + np.arange(1, bands + 1, dtype=U) * FACTOR).view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def slope(larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, k: np.ndarray, j: np.ndarray | float) -> np.ndarray:
    """Derivative in J, at j, of the joint log-likelihood of sets of sizes n and k of which `larger` (`smaller`) registers of the first are larger (smaller).

    The likelihood is concave, so its maximum is at j or above exactly if this is not negative.
    """
    u, v = n / (n + k), k / (n + k)
    c = (BASE - 1) / BASE / np.log(BASE)
    x, y = u - v * j, v - u * j
    dx, dy = c * -v / (1 - x * (BASE - 1) / BASE), c * -u / (1 - y * (BASE - 1) / BASE)
    px, py = np.maximum(_p(x), 1e-12), np.maximum(_p(y), 1e-12)
    return larger * dx / px + smaller * dy / py - (REGISTERS - larger - smaller) * (dx + dy) / np.maximum(1 - px - py, 1e-12)


def estimate(a: np.ndarray, b: np.ndarray, n: int, k: int) -> float:
    """The similarity that maximises the joint likelihood, by bisection of its slope."""
    larger, smaller = np.array([(a > b).sum()]), np.array([(a < b).sum()])
    low, high = 0.0, min(n / k, k / n)
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(larger, smaller, np.array([n]), np.array([k]), mid)[0] >= 0 else (low, mid)
    return low


def alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, k: np.ndarray, bound: float, loose: float) -> np.ndarray:
    """Which pairs of sketches may be of similarity `bound`: sizes allow it, and the estimate is `loose` at least."""
    fits = np.minimum(n, k) >= bound * np.maximum(n, k)
    out = fits.copy()
    if fits.any():
        a, b = a[fits] if len(a) == len(fits) else a, b[fits]
        out[fits] = slope((a > b).sum(1), (a < b).sum(1), n[fits], k[fits], loose) >= 0
    return out


def connect(n: int, near: Callable[[int], np.ndarray]) -> np.ndarray:
    """The tree of each of n nodes, named by its smallest node, in the graph with neighbours near(i), asking only as many nodes as needed.

    Pairs inside one tree need no look, and a pair is seen from either end. So it is done once all nodes that
    weren't asked are in one tree.
    """
    up, asked, turn = list(range(n)), np.zeros(n, bool), 0

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    while True:
        asked[turn] = True
        for i in np.flatnonzero(near(turn)).tolist():
            x, y = sorted((top(i), top(turn)))
            up[y] = x
        rest = np.flatnonzero(~asked)
        if not len(rest):
            break
        tops = np.array([top(i) for i in rest.tolist()])
        kinds, counts = np.unique(tops, return_counts=True)
        if len(kinds) == 1:
            break
        turn = int(rest[np.flatnonzero(tops != kinds[counts.argmax()])[0]])
    return np.array([top(i) for i in range(n)], np.int64)


def connect_small(near: np.ndarray) -> np.ndarray:
    """The same of many small graphs (graphs, n, n) at once, by squaring their reach."""
    reach = (near | np.eye(near.shape[1], dtype=bool)).astype(np.float32)
    for _ in range(near.shape[1].bit_length()):
        reach = (reach @ reach > 0).astype(np.float32)
    return reach.argmax(2)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal first `keys` columns, which come together, as tables; a batch's small groups come one after the other in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def spans(table: pa.Table, keys: int) -> np.ndarray:
    """Where groups of equal keys begin and end."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for i in range(keys):
        c = table.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.concatenate([np.flatnonzero(new), [table.num_rows]])


def _stars(keys: list[np.ndarray], nodes: list[np.ndarray], tops: list[np.ndarray]) -> pa.RecordBatch:
    """(a group's key, a, b) of each node a whose tree is named by another node, b."""
    key, a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, nodes, tops))
    return pa.RecordBatch.from_arrays([pa.array(x[a != b]) for x in (key, a, b)], ["key", "a", "b"])


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: BLAKE2b of all its sorted hashes."""
    return struct.unpack("<qq", hashlib.blake2b(np.ascontiguousarray(own), digest_size=16).digest())


def sketched(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, of_text, n, h1, h2, registers, bands) of each document; h1 and h2 are the digest of its full set."""
    names = ["id", "of_text", "n", "h1", "h2", "registers", "bands"]
    count, width = band_shape(similarity)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets, at = shingle_sets(*utf8(batch.column(2)), shingle)
            sizes, full = np.diff(at), np.diff(at) > 0
            digests = np.array([digest(sets[x:y]) for x, y in zip(at, at[1:], strict=False)], np.int64).reshape(-1, 2)
            registers = sketches(sets, at)
            raw = np.ascontiguousarray(registers).tobytes()
            held = pa.Array.from_buffers(pa.binary(), len(registers), [None, pa.py_buffer((np.arange(len(registers) + 1) * 2 * REGISTERS).astype(np.int32)), pa.py_buffer(raw)])
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * count)]), pa.int32()), pa.array(band_keys(registers[full], count, width).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), held, bands], names)

    return docs.mapInArrow(make, "id long, of_text long, n long, h1 long, h2 long, registers binary, bands array<long>")


def loose_edges(members: DataFrame, bound: float, loose: float) -> DataFrame:
    """(key, a, b): the tree b of each node a inside each bucket block; members: key, p, q, node, n, registers, a group's rows together."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            table = table.combine_chunks()
            cut = spans(table, 3)
            key, ids, n = table["key"].to_numpy(), table["node"].to_numpy(), table["n"].to_numpy().astype(float)
            column = table["registers"].chunk(0) if table["registers"].num_chunks else pa.array([], pa.binary())
            regs = np.frombuffer(column.buffers()[2], np.uint16)[: (column.offset + len(column)) * REGISTERS].reshape(-1, REGISTERS)[column.offset :]
            size, keys, nodes, tops = np.diff(cut), [], [], []
            for s in range(2, 7):
                i, j = np.triu_indices(s, 1)
                begin = cut[:-1][size == s]
                left, right = (begin[:, None] + i).ravel(), (begin[:, None] + j).ravel()
                near = np.zeros((len(begin), s, s), bool)
                ok = [alike(regs[x], regs[y], n[x], n[y], bound, loose) for x, y in ((left[a : a + 8192], right[a : a + 8192]) for a in range(0, len(left), 8192))]
                near[:, i, j] = near[:, j, i] = np.concatenate([np.zeros(0, bool), *ok]).reshape(len(begin), len(i))
                every = (begin[:, None] + np.arange(s)).ravel()
                keys.append(key[every])
                nodes.append(ids[every])
                tops.append(ids[(begin[:, None] + connect_small(near)).ravel()])
            for b, e in zip(cut[:-1][size > 6].tolist(), cut[1:][size > 6].tolist(), strict=True):
                own, m = regs[b:e], n[b:e]
                keys.append(key[b:e])
                nodes.append(ids[b:e])
                tops.append(ids[b + connect(e - b, lambda i, own=own, m=m: alike(own[i : i + 1], own, np.full(len(m), m[i]), m, bound, loose))])
            yield _stars(keys, nodes, tops)

    return members.select("key", "p", "q", "node", "n", "registers").mapInArrow(compare, "key long, a long, b long")


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets link: boolean matrix from counts of common elements, over chunks of shared elements."""
    g = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    times = np.bincount(column)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((g, g), np.float32)
    width = 4096
    for a in range(0, int(column.max(initial=-1)) + 1, width):
        low, high = np.searchsorted(column, [a, a + width])
        part = np.zeros((g, width if high - low else 1), np.float32)
        part[owner[low:high], column[low:high] - a] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    out = 100 * common >= percent * (sizes[:, None] + sizes - common)
    np.fill_diagonal(out, False)
    return out


def exact_edges(cells: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(key, a, b): the tree b, by links, of each node a inside each block of cell `key`; cells: cell, p, q, node, h1, h2, text, a group's rows together.

    Sets are made anew from whole texts; a text whose set isn't the node's (another one of the same id) is passed over.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def small() -> Iterator[pa.RecordBatch]:
            yield from slices(batches, "text", 8 << 20)

        for table in groups(small(), 3):
            cut, keys, nodes, tops = spans(table, 3), [], [], []
            for b, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if e - b < 2:
                    continue
                part = table.slice(b, e - b)
                sets: dict[int, np.ndarray] = {}
                for chunk in part.to_batches():
                    flat, at = shingle_sets(*utf8(chunk.column("text")), shingle)
                    for node, h1, h2, x, y in zip(*(chunk.column(c).to_pylist() for c in ("node", "h1", "h2")), at, at[1:], strict=False):
                        if node not in sets and digest(flat[x:y]) == (h1, h2):
                            sets[node] = flat[x:y]
                if len(sets) > 1:
                    links, own = exact_links(list(sets.values()), percent), np.array(list(sets), np.int64)
                    keys.append(np.full(len(own), part["cell"][0].as_py(), np.int64))
                    nodes.append(own)
                    tops.append(own[connect(len(own), lambda i, links=links: links[i])])
            yield _stars(keys, nodes, tops)

    return cells.select("cell", "p", "q", "node", "h1", "h2", "text").mapInArrow(verify, "key long, a long, b long")


def in_blocks(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Each row once for every pair (p, q) of blocks of its group that has the row's block; one pair (0, 0) for a single block."""
    block = F.pmod(F.xxhash64("node"), F.col(blocks))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.expr(f"sequence(0L, {blocks} - 1)")))
    rows = rows.where((F.col("other") != F.col("block")) | (F.col(blocks) == 1))  # a block's own pairs are seen beside any other block
    return rows.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("block", "other")


def every_link(members: DataFrame, sizes: DataFrame, group: str, most: int, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) that connect what all links inside groups connect; members: group, node; sizes: group, blocks.

    edges_of gives the tree of each placed node inside its (group, p, q). A group of one block is compared whole. In
    larger ones, blocks of a group are compared by themselves first, then one node of each tree with those of other
    trees. Nodes of one tree need no further look, so only those outside a group's largest tree (few, if the group
    is one of copies) are brought together with all blocks, and with each other. So no link between trees is missed, and a
    group's shipped rows grow with its size, not with its square, unless it falls apart.
    """
    placed = written(members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "placed")
    no = F.lit(-1).cast("long")
    edges = written(edges_of(placed.select(group, F.col("block").alias("p"), no.alias("q"), "node")), "in-blocks")
    hot = placed.where("blocks > 1")
    if hot.isEmpty():
        return edges.select("a", "b")
    named = lambda found, node, tree: found.select(F.col("key").alias(group), F.col("a").alias(node), F.col("b").alias(tree))
    trees = written(hot.join(named(edges, "node", "tree"), [group, "node"], "left").withColumn("tree", F.coalesce("tree", "node")), "trees")
    heads = trees.where("node = tree").select(group, "node")
    of_heads = heads.groupBy(group).agg(F.ceil(F.count("*") / F.lit(float(most))).alias("blocks"))
    heads = heads.join(of_heads, group).select(group, F.pmod(F.xxhash64("node"), F.col("blocks")).alias("p"), no.alias("q"), "node")
    upper = written(edges_of(heads), "heads")
    now = trees.join(named(upper, "tree", "top"), [group, "tree"], "left").withColumn("tree", F.coalesce("top", "tree"))
    largest = now.groupBy(group, "tree").agg(F.count("*").alias("size")).groupBy(group).agg(F.max(F.struct("size", "tree")).getField("tree").alias("largest"))
    now = written(now.join(largest, group), "trees")
    edges = edges.union(upper).select("a", "b")
    rest = now.where("tree <> largest")
    strips = rest.groupBy(group).agg(F.ceil(F.count("*") / F.lit(float(most))).alias("strips"))
    rest = written(rest.join(strips, group).withColumn("strip", F.pmod(F.xxhash64("node"), F.col("strips"))), "rest")
    if rest.isEmpty():
        return edges
    outside = rest.select(group, F.col("strip").alias("p"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("q"), "node")
    inside = now.where("tree = largest").join(strips, group).select(group, F.explode(F.expr("sequence(0L, strips - 1)")).alias("p"), F.col("block").alias("q"), "node")
    mutual = in_blocks(rest.where("strips > 1").select(group, "node", "strips"), group, "strips").select(group, "p", (-2 - F.col("q")).alias("q"), "node")
    return edges.union(edges_of(outside.union(inside).union(mutual)).select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    bound, loose = percent / 100, percent / 100 - LOOSE_BELOW
    base = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("of_text"), F.col(text).alias("text"))
    rows = written(sketched(base, shingle, bound).withColumn("node", F.monotonically_increasing_id()), "sketches")
    same = ["n", "h1", "h2"]
    # a class is a set; one of its rows, the node, stands for it
    classes = written(rows.where("n > 0 and id is not null").groupBy(*same).agg(F.min("node").alias("node"), F.min("id").alias("least")), "classes")
    keys = rows.select("node", "bands").join(classes.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")

    def loosely(placed: DataFrame) -> DataFrame:
        shipped = placed.join(rows.select("node", "n", "registers"), "node")
        return loose_edges(shipped.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node"), bound, loose)

    blocks = F.ceil(F.col("size") / F.lit(float(BLOCK))).alias("blocks")
    cells = components(every_link(keys, full.select("key", blocks), "key", BLOCK, loosely)).withColumnsRenamed({"component": "cell", "id": "node"})
    cells = written(cells.join(rows.select("node", *same, "id", "of_text"), "node"), "cells")
    # all texts are dealt by their key once, as candidates may be too many to broadcast; those of candidates are written
    wanted = cells.select("id", "of_text").distinct().hint("merge")
    texts = base.join(wanted, ["id", "of_text"], "left_semi").dropDuplicates(["id", "of_text"])
    texts = written(texts.join(cells.select("node", "h1", "h2", "id", "of_text"), ["id", "of_text"]).select("node", "h1", "h2", "text"), "texts")

    def exactly(placed: DataFrame) -> DataFrame:
        return exact_edges(placed.join(texts, "node").repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q", "node"), shingle, percent)

    blocks = F.greatest(F.ceil(F.count("*") / F.lit(float(CELL_BLOCK))), F.ceil(F.sum("n") / F.lit(float(CELL_SHINGLES))))
    links = every_link(cells.select("cell", "node"), cells.groupBy("cell").agg(blocks.alias("blocks")), "cell", CELL_BLOCK, exactly)
    reached = components(links).withColumnRenamed("id", "node").join(classes.select("node", "least"), "node")
    label = reached.join(reached.groupBy("component").agg(F.min("least").alias("reached")), "component").select("node", "reached")
    label = classes.join(label, "node", "left").select(*same, F.coalesce("reached", "least").alias("least"))
    out = rows.select("id", *same).join(label, same, "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of docs, that of the smallest doc_id, with all its columns.

    Rows are compared under a key of their own, so null ids and repeated ones are like any others: a row with a
    null id goes only if a kept one is its copy. Rows without words link with nothing and stay, one for each id.
    """
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, shingle, percent, key=ROW).join(rows.select(ROW, "doc_id"), ROW)
    blank = F.col("n_shingles") == 0
    one = [F.when(~blank, F.col("component_id")), F.when(blank, F.col("doc_id")), F.when(blank & F.col("doc_id").isNull(), F.col(ROW))]
    heads = found.groupBy(*[c.alias(f"g{i}") for i, c in enumerate(one)]).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("least")).select(F.col(f"least.{ROW}").alias(ROW))
    return rows.join(heads, ROW, "left_semi").drop(ROW)
