"""Language ID by cross-parsing entropy.

A bounded sample of labelled texts per language is turned into a suffix automaton. A text is parsed, from
the left, into the longest phrases that occur in the language's sample; the number of phrases times the
bits that name a place in the sample is the text's code length in that language, and the language with the
fewest bits wins. The score is the winner's weight among all languages by code length (2 to the power of
minus the bits). Texts are read whole, in windows of WINDOW symbols that are parsed side by side by numpy.

Null texts and texts without a letter are `und` with score 0; ties go to the first language in code-point
order. Where nothing was learned, every text is `und`. Empty tables give empty results, and repeated rows
repeated results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import slices

#: Bounds of the labelled sample, per language: documents drawn, characters of each (one passage). All of it is learnt.
SAMPLE_DOCS, PASSAGE = 150, 300
WINDOW = 512
#: Entries of an automaton's table of all transitions; where it would be larger, as in scripts of thousands of letters, only those that exist are kept.
DENSE = 1 << 24
#: Bits a symbol above which no learnt language explains a text, whatever the sample: uniformly random Latin letters
#: take about 11, symbols that no sample has 13 to 15, prose 2 to 4. `limits` gives the lower bound of each language.
UNEXPLAINED = 12.0
#: Held-back pieces: characters of each, quantile of their bits, its headroom; phrases that any text may take besides, as a short one may hold a name or a key.
PIECE, QUANTILE, HEADROOM, SPARE = 500, 0.99, 1.25, 6


def learnable(key: str = "doc_id", lang: str = "lang") -> Column:
    """Documents outside the held-out fold (crc32 of the key as text, mod 4, is 2) that have a language."""
    return F.col(lang).isNotNull() & F.col("text").isNotNull() & ~held_out(key)


def held_out(key: str = "doc_id") -> Column:
    """False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(labelled: DataFrame, key: str = "doc_id", lang: str = "lang", docs: int = SAMPLE_DOCS, passage: int = PASSAGE) -> dict[str, list[str]]:
    """Passages per language from about `docs` documents each, chosen by a hash of the key: bounded, whatever the corpus.

    The share of a language that is drawn follows from its count, so that the draw needs no sort.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs / n))])
    unit = F.pmod(F.xxhash64(F.lit("language"), F.col(key).cast("string"), F.length("text")), F.lit(1 << 32)) / float(1 << 32)
    start = F.pmod(F.xxhash64(F.lit("passage"), F.col(key).cast("string")), F.greatest(F.length("text") - passage, F.lit(1)).cast("long")) + 1
    rows = labelled.withColumn("unit", unit).where(F.col("unit") < F.element_at(share, F.col(lang)))
    rows = rows.select("unit", F.col(lang).alias("l"), F.substring("text", start.cast("int"), F.lit(passage)).alias("t")).collect()
    found: dict[str, dict[str, None]] = {}
    for r in sorted(rows, key=lambda r: (r.unit, r.t)):
        found.setdefault(r.l, {})[r.t] = None
    return {k: list(v) for k, v in sorted(found.items())}


def alphabet(sample: dict[str, list[str]]) -> str:
    """Every letter of the sample, small."""
    return "".join(sorted({c for texts in sample.values() for t in texts for c in t.lower() if c.isalpha()}))


def symbol_table(letters: str) -> np.ndarray:
    """Symbol of each code point: 0 parts words, 1 is a letter that no sample has, 2 and on are the letters."""
    table = np.zeros(0x110000, np.min_scalar_type(len(letters) + 1))
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    for i, c in enumerate(letters):
        for x in {c, c.upper(), c.title()}:
            if len(x) == 1:
                table[ord(x)] = i + 2
    return table


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, runs of separators as one, and the n + 1 offsets of the texts in them."""
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = flat > 0
    keep[1:] |= flat[:-1] > 0
    ends = np.concatenate([[0], np.cumsum(lengths)])
    first = ends[:-1][lengths > 0]
    keep[first] = flat[first] > 0  # whatever the text before ends with
    kept = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], kept[ends]


class Transitions:
    """(state, symbol) -> state of an automaton, 0 where there is none: a table, or the transitions there are, sorted."""

    def __init__(self, nxt: list[dict[int, int]], width: int) -> None:
        self.width = width
        self.table = self.keys = None
        if len(nxt) * width <= DENSE:
            self.table = np.zeros(len(nxt) * width, np.int32)
            for s, row in enumerate(nxt):
                if row:
                    self.table[s * width + np.array(list(row))] = list(row.values())
        else:
            pairs = np.array(sorted((s * width + c, to) for s, row in enumerate(nxt) for c, to in row.items()), np.int64).reshape(-1, 2)
            self.keys, self.to = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = state * np.int64(self.width) + symbol
        if self.table is not None:
            return self.table[at]
        i = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[i] == at, self.to[i], np.int32(0))


def suffix_automaton(text: np.ndarray, width: int) -> Transitions:
    """Transitions of the automaton of all factors; 0 is no state, 1 is the start."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, longest, last = [0, 0], [0, 0], 1
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        longest.append(longest[last] + 1)
        link.append(1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if longest[q] == longest[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return Transitions(nxt, width)


def phrases(go: Transitions, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each window flat[start : start + length] in the greedy parse; lengths must not ascend.

    A phrase ends where the automaton has no transition; the next one begins with that symbol. A symbol that
    the sample lacks is a phrase.
    """
    state = np.ones(len(starts), np.int32)
    first = go(np.ones(go.width, np.int32), np.arange(go.width))  # of each symbol, from the start
    count = np.zeros(len(starts), np.int32)
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    for t, k in enumerate(active.tolist()):
        c = flat[starts[:k] + t]
        on = go(state[:k], c)
        begins = (on == 0) | (state[:k] == 1)
        on = np.where(on == 0, first[c], on)
        count[:k] += begins
        state[:k] = np.where(on == 0, 1, on)
    return count


class Languages:
    """The automata; built where they are used, from the sample alone (a few 100 kB), once per Python worker."""

    built: dict[int, Languages] = {}

    def __init__(self, sample: dict[str, list[str]]) -> None:
        self.names = sorted(sample)
        letters = alphabet(sample)
        self.table = symbol_table(letters)
        self.automata, self.own, self.bits = [], [], []
        for name in self.names:
            flat, _ = symbols([" ".join(["", *sample[name], ""])], self.table)
            # a language's automaton knows its own letters; what it lacks is 1, which leads nowhere
            has = np.unique(flat[flat > 1])
            own = np.ones(len(letters) + 2, np.min_scalar_type(len(has) + 1))
            own[0], own[has] = 0, np.arange(2, len(has) + 2)
            self.own.append(own)
            self.automata.append(suffix_automaton(own[flat], len(has) + 2))
            self.bits.append(log2(max(2, len(flat))))

    @classmethod
    def of(cls, sample: dict[str, list[str]]) -> Languages:
        key = hash(str(sorted(sample.items())))
        if key not in cls.built:
            cls.built.clear()
            cls.built[key] = cls(sample)
        return cls.built[key]

    def code_lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text in each language, its letters and its symbols."""
        flat, at = symbols(texts, self.table)
        sizes = np.diff(at)
        parts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), parts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = at[:-1][owner] + place * WINDOW
        lengths = np.minimum(WINDOW, at[1:][owner] - starts)
        order = np.argsort(-lengths, kind="stable")
        owner, starts, lengths = owner[order], starts[order], lengths[order]
        bits = np.zeros((len(texts), len(self.names)))
        for i, (go, own) in enumerate(zip(self.automata, self.own, strict=True)):
            bits[:, i] = np.bincount(owner, phrases(go, own[flat], starts, lengths), len(texts)) * self.bits[i]
        letters = np.concatenate([[0], np.cumsum(flat > 0)])[at]
        return bits, np.diff(letters), sizes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a symbol of each text."""
        bits, letters, sizes = self.code_lengths(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
        none = letters == 0
        return ["und" if n else self.names[b] for b, n in zip(best, none, strict=True)], np.where(none, 0.0, score), np.where(none, 0.0, least / np.maximum(sizes, 1))

    def explains(self, texts: list[str], most_bits: dict[str, float]) -> np.ndarray:
        """Which texts have letters and take at most most_bits a symbol, and SPARE phrases besides, in their language."""
        bits, letters, sizes = self.code_lengths(texts)
        if not self.names:
            return np.zeros(len(texts), bool)
        best = bits.argmin(1)
        most = np.array([most_bits.get(n, UNEXPLAINED) for n in self.names])[best]
        return (letters > 0) & (bits[np.arange(len(texts)), best] <= most * sizes + SPARE * np.array(self.bits)[best])


def limits(sample: dict[str, list[str]]) -> dict[str, float]:
    """Most bits a symbol of each language's texts, from passages that are held back and parsed with the others.

    It is what nearly all pieces exceed once their letters are shuffled; where that is near what nearly all of
    them take as they are, the latter with HEADROOM. It is UNEXPLAINED at most, also for languages of one passage.
    """
    model, out = Languages({k: v[::2] for k, v in sample.items()}), {}
    for name, passages in sample.items():
        text = " ".join(passages[1::2])
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        pieces = [p for p in pieces if any(map(str.isalpha, p))]
        rng = np.random.default_rng(len(pieces))
        mixed = ["".join(np.array(list(p))[rng.permutation(len(p))]) for p in pieces]
        if pieces:
            own = float(np.quantile(model.predict(pieces)[2], QUANTILE))
            other = float(np.quantile(model.predict(mixed)[2], 1 - QUANTILE))
            out[name] = min(UNEXPLAINED, max(HEADROOM * own, other))
    return out


def identify(docs: DataFrame, sample: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, bits) of every whole text; bits are per symbol, and near those of a random place where no language fits."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Languages.of(sample)
        for batch in slices(batches, text, 1 << 20):
            names, score, bits = model.predict([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(bits)], [key, "lang_pred", "score", "bits"])

    return docs.select(key, text).mapInArrow(predict, f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double, bits double")


def explained(docs: DataFrame, sample: dict[str, list[str]], text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text has letters and takes no more bits than `limits` allows in its language."""
    place, most_bits = docs.columns.index(text), limits(sample)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Languages.of(sample)
        for batch in slices(batches, text, 1 << 20):
            yield batch.filter(pa.array(model.explains([x or "" for x in batch.column(place).to_pylist()], most_bits)))

    return docs.mapInArrow(keep, docs.schema)
