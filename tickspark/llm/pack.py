"""Packing tokenised documents into windows by non-negative least squares.

A task packs blocks of documents as they come. Of each document, full windows are cut first; the lengths
that are left form the block's histogram. Shallow combinations of two to four lengths that fill a window
exactly are enumerated, non-negative least squares finds how often each is to be repeated to match the
histogram, the counts are rounded within it, and what they leave is packed greedily, longest first, cut
where a window is full. The block's last, partial window is cut into sequences of powers of two, which
need no padding. Blocks are packed on their own, so nothing is shuffled and a lost task is just run again;
each costs a handful of short sequences.

Null texts count as empty; each document ends with END, so none is without ids. Repeated rows are
packed repeatedly. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickspark.llm.common import slices

WINDOW, END = 2048, 1
#: Ids that a block holds at most before it is packed (unless one document has more).
BLOCK = 2 << 20
#: Bytes of the texts whose distinct words are looked up together.
SLICE = 4 << 20
#: Lengths that are combined to triples, and words that a task remembers.
FREQUENT, REMEMBERED = 64, 300_000
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
#: Words whose ids are those of the lower-case letters; points may follow.
PLAIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


class Words:
    """Ids of texts from ids of their words, so that each distinct word is encoded once.

    That holds for tokenizers that drop white space and never join over it; whether this one does is asked once (`parted`),
    else whole texts are encoded. Likewise (`folded`) capitals and closing points are split off only where that changes no id.
    """

    kept: dict[str, Words] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        ids = lambda *texts: [x for t in texts for x in self.tokenizer.encode(t, add_special_tokens=False).ids]
        self.parted = all(ids(t) == ids(*t.split()) for t in ("Two words", " a  b\n\tc ", "x 1 é. y"))
        self.folded = self.parted and all(ids(a) == ids(*b) for a, b in ((LETTERS.upper(), [LETTERS]), (LETTERS.title(), [LETTERS]), (LETTERS + ".", [LETTERS, "."]), ("Words..,", ["words", "..,"])))
        self.forget()

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(2, np.int64)  # the empty word has no ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), END after each, and the n + 1 offsets of the texts in them."""
        texts = pc.fill_null(texts, "")
        if not self.parted:
            found = [[*e.ids, END] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        spelled, spelled_at = self.spelled(words.dictionary)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        which = np.insert(words.indices.to_numpy().astype(np.int64), ends, len(words.dictionary))  # the last place is END's
        flat, upto = gather(np.append(spelled, np.uint32(END)), np.append(spelled_at, len(spelled) + 1), which)
        return flat, upto[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]

    def spelled(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and the offsets of the words in them; a folded word's are those of its letters in lower case, then of its points."""
        if len(self.place) > REMEMBERED:
            self.forget()
        plain = pc.match_substring_regex(distinct, f"^{PLAIN}[.,]*$") if self.folded else pa.array(np.zeros(len(distinct), bool))
        at = np.zeros((len(distinct), 2), np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        if mask.any():
            folded = pc.utf8_lower(distinct.filter(plain))
            at[mask, 0] = self.places(pc.utf8_rtrim(folded, characters=".,"), self.plain_ids)
            at[mask, 1] = self.places(pc.replace_substring_regex(folded, f"^{PLAIN}", ""), self.word_ids)
        at[~mask, 0] = self.places(distinct.filter(pc.invert(plain)), self.word_ids)
        flat, upto = gather(self.ids, self.at, at.ravel())
        return flat, upto[::2]

    def places(self, words: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where the ids of each word are kept; unknown words are encoded."""
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        if new := [w for w in known if w not in self.place]:
            flat, lengths = encode(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        return np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of any words."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64)

    def plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of lower-case words of letters; many are encoded as one text, as each ends with a token that says so."""
        lines = [" ".join(words[a : a + 200]) for a in range(0, len(words), 200)]
        flat = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]])
        ends = np.flatnonzero(self.ends[flat])
        return (flat, np.diff(ends, prepend=-1)) if len(ends) == len(words) else self.word_ids(words)


def gather(ids: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ids[at[w] : at[w + 1]] one after the other, and the offsets of the runs in them."""
    begin = at[which]
    lengths = at[which + 1] - begin
    upto = np.concatenate([[0], np.cumsum(lengths)])
    return ids[np.repeat(begin - upto[:-1], lengths) + np.arange(upto[-1])], upto


def combinations(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of four lengths (0: none) that sum to the window: pairs, equal parts, and triples of frequent lengths."""
    there = np.flatnonzero(histogram[:window])
    there = there[there > 0]
    found = [(a, window - a, 0, 0) for a in there.tolist() if 2 * a <= window and histogram[window - a]]
    found += [(window // k,) * k + (0,) * (4 - k) for k in (3, 4) if window % k == 0 and histogram[window // k]]
    often = np.sort(there[np.argsort(-histogram[there], kind="stable")[:FREQUENT]])
    for i, a in enumerate(often.tolist()):
        for b in often[i:].tolist():
            c = window - a - b
            if c >= b and histogram[c]:
                found.append((a, b, c, 0))
    return np.array(sorted(set(found)), np.int64).reshape(-1, 4)


def solve(combos: np.ndarray, histogram: np.ndarray, tolerance: float = 0.01, most_rounds: int = 5000) -> np.ndarray:
    """Repeat counts x >= 0 that make sum(x * lengths of each combination) near the histogram in least squares.

    Accelerated projected gradient steps, restarted where they point uphill, until the optimality conditions hold:
    nowhere is min(x, gradient) further from 0 than tolerance, which is far below what rounding takes.
    """
    if not len(combos):
        return np.zeros(0)
    there = combos > 0
    target = histogram.astype(float)
    times = np.bincount(combos.ravel(), there.ravel(), len(histogram))
    step = 1.0 / (4 * max(1.0, times.max()))  # the largest eigenvalue is at most the product of both norms of the matrix
    x = ahead = np.zeros(len(combos))
    speed = 1.0
    for _ in range(most_rounds):
        gap = np.bincount(combos.ravel(), (there * ahead[:, None]).ravel(), len(histogram)) - target
        slope = np.where(there, gap[combos], 0).sum(1)
        new = np.maximum(ahead - step * slope, 0)
        if np.abs(np.minimum(ahead, slope)).max() <= tolerance:
            return new
        if ((ahead - new) * (new - x)).sum() > 0:
            speed = 1.0
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        x, ahead, speed = new, new + (speed - 1) / faster * (new - x), faster
    return x


def rounded(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole counts near x, largest first, that never use a length more often than the histogram has it."""
    left, out = histogram.copy(), np.zeros(len(x), np.int64)
    for i in np.argsort(-x, kind="stable").tolist():
        if x[i] < 0.5:
            break
        lengths, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
        out[i] = n = min(int(x[i] + 0.5), *(left[lengths] // times).tolist())
        left[lengths] -= n * times
    return out


def place(sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that hold each id of documents of these sizes once."""
    full, rest = sizes // window, sizes % window
    owner = np.repeat(np.arange(len(sizes)), full)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    rows = [np.stack([owner, nth * window, np.full(len(owner), window), np.arange(len(owner)), np.zeros(len(owner), np.int64)], 1)]
    sequence = len(owner)
    histogram = np.bincount(rest, minlength=window + 1)
    histogram[0] = 0
    combos = combinations(histogram, window)
    counts = rounded(combos, solve(combos, histogram), histogram)
    by_length = np.argsort(rest, kind="stable")
    following = np.searchsorted(rest[by_length], np.arange(window + 1))
    out: list[tuple[int, int, int, int, int]] = []
    for combo, n in zip(combos.tolist(), counts.tolist(), strict=True):
        for _ in range(n):
            offset = 0
            for length in combo:
                if length:
                    doc = int(by_length[following[length]])
                    following[length] += 1
                    out.append((doc, int(full[doc]) * window, length, sequence, offset))
                    offset += length
            sequence += 1
    ends = np.searchsorted(rest[by_length], np.arange(window + 1), side="right")
    offset = 0
    tail: list[tuple[int, int, int]] = []  # of the window being filled
    for length in range(window - 1, 0, -1):
        for doc in by_length[following[length] : ends[length]].tolist():
            start, left = int(full[doc]) * window, length
            while left:
                take = min(left, window - offset)
                tail.append((doc, start, take))
                offset, start, left = offset + take, start + take, left - take
                if offset == window:
                    at = 0
                    for d, s, k in tail:
                        out.append((d, s, k, sequence, at))
                        at += k
                    sequence, offset, tail = sequence + 1, 0, []
    for power in [1 << k for k in range(offset.bit_length() - 1, -1, -1) if offset >> k & 1]:
        at = 0
        while at < power:
            d, s, k = tail.pop(0)
            take = min(k, power - at)
            out.append((d, s, take, sequence, at))
            at += take
            if take < k:
                tail.insert(0, (d, s + take, k - take))
        sequence += 1
    rows.append(np.array(out, np.int64).reshape(-1, 5))
    return np.concatenate(rows)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset) of each piece; sequence_id is unique over all tasks.

    The checksum is that of the piece's ids as little-endian unsigned 32-bit numbers; with_ids=False leaves the ids out.
    """
    names = [key, "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, parts, sizes = Words.of(tokenizer), [], [], []
        first = TaskContext.get().partitionId() << 36

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            flat, size = np.concatenate(parts).astype("<u4"), np.concatenate(sizes)
            rows = place(size)
            begin = (np.cumsum(size) - size)[rows[:, 0]] + rows[:, 1]
            every, raw = pa.chunked_array(keys).combine_chunks(), memoryview(flat).cast("B")
            for a in range(0, len(rows), 512):
                r, b = rows[a : a + 512], begin[a : a + 512]
                crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(b.tolist(), r[:, 2].tolist(), strict=True)]
                ids = []
                if with_ids:
                    upto = np.concatenate([[0], np.cumsum(r[:, 2])])
                    ids = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat[np.repeat(b - upto[:-1], r[:, 2]) + np.arange(upto[-1])].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([every.take(pa.array(r[:, 0])), pa.array(r[:, 1]), pa.array(r[:, 2]), *ids, pa.array(crc, pa.int64()), pa.array(size[r[:, 0]]), pa.array(first + r[:, 3]), pa.array(r[:, 4])], names)
            first += int(rows[:, 3].max()) + 1

        held = 0
        for batch in slices(batches, text, SLICE):
            flat, at = words.encode(batch.column(1))
            keys.append(batch.column(0))
            parts.append(flat)
            sizes.append(np.diff(at))
            held += len(flat)
            if held >= BLOCK:
                yield from packed()
                keys, parts, sizes, held = [], [], [], 0
        if parts:
            yield from packed()

    ids = "ids array<int>, " if with_ids else ""
    return docs.select(key, text).mapInArrow(blocks, f"{key} {dict(docs.dtypes)[key]}, start long, length long, {ids}ids_crc32 long, doc_tokens long, sequence_id long, offset long")
