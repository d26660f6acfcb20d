"""Personal data: a few exact patterns, and a character-level BiLSTM-CRF that adds what they miss.

The model is trained from labelled spans: a bounded, hashed sample of windows of the corpus, drawn by kind, with the
patterns' spans as labels, and copies of such windows into which spans in other spellings are put (an address with (at), numbers with
dots and the like), so that it finds what patterns can't. A text is laid out in cells of CELL characters, and each cell with a
mark (a digit, an @, an at in brackets or a spelt dot, one of which any span that can be added has) is read in a window that reaches half a cell beyond
either side. The scores of overlapping windows are averaged, the nearer its middle, the more a window counts, and one
Viterbi pass decodes the whole run of neighbouring cells; runs longer than PIECE cells are cut, with two cells in common of which
each piece keeps its half. What is added must have an exact form of its kind, which also sets its ends, and never overlaps a
pattern's span; all of those stay.

Null texts count as empty; empty ones have no spans. Positions are code points, ends exclusive. Equal texts
have equal spans. If the corpus has no such mark, no model is trained. Empty tables give empty results,
repeated rows repeated ones, and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm import tagger
from tickspark.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: documents drawn, windows of each kind (and without spans) that are kept, windows with other spellings.
SAMPLE_DOCS, SAMPLE_WINDOWS, RESPELT = 2000, 150, 900
CELL, STEPS, BATCH, HIDDEN, EMBEDDING = 48, 400, 32, 12, 8
SPAN = 2 * CELL
#: Cells of a piece that is decoded at once, and windows of all pieces in hand.
PIECE, WINDOWS = 30, 4096
TAGS = 1 + 2 * len(KINDS)

#: In Python and in Spark alike.
MARK = r"[0-9@]|(?<![A-Za-z0-9_])dot(?![A-Za-z0-9_])|[\[(] ?at ?[\])]"
MARKS = re.compile(MARK, re.I)
DIGITS_OR_AT = re.compile("[0-9@]")
SPELT = re.compile(r"dot|at ?[\])]", re.I)
#: As the contract has them; possessive where going back can't help, so that long runs stay linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Exact forms of what may be added.
AT, DOT = r" ?[\[(] ?at ?[\])] ?", r"(?: ?[\[(] ?(?:\.|dot) ?[\])] ?| dot | \. )"
FORMS = (
    re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:(?: ?@ ?|{AT})[A-Za-z0-9-]+(?:(?:\.|{DOT})[A-Za-z0-9-]+)+| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)", re.I),
    re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I),
    re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,3}[0-9]){11,18}(?![0-9])"),
    re.compile(r"(?<![0-9])(?:\+ |00)[1-9](?:[ ()./-]{0,2}[0-9]){7,13}(?![0-9])"),
)

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of name@domain.domain: for each @, the run before it, as far as the last match lets it."""
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            over = m.end()
            yield start, over
        at = text.find("@", max(at + 1, over))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then kind."""
    if not DIGITS_OR_AT.search(text):
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def alphabet() -> dict[str, int]:
    """Symbols of characters: small letters and some signs one each, capitals, digits and the rest together; 0 lies outside the text."""
    signs = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz @.-+():/_%=\"',\n", 4)}
    return signs | {c: 2 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: 3 for c in "0123456789"}


SYMBOL = np.ones(0x110000, np.uint8)
for _c, _s in alphabet().items():
    SYMBOL[ord(_c)] = _s
SYMBOLS = int(SYMBOL.max()) + 1


def window_cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a text, with half a cell of nothing before and more behind, and the cells that hold a mark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    if spelt := [m.start() for m in MARKS.finditer(text) if len(m[0]) > 1] if SPELT.search(text) else []:
        marks = np.concatenate([marks, spelt])
    padded = np.zeros(len(codes) + 2 * SPAN, np.uint8)
    padded[CELL // 2 : CELL // 2 + len(codes)] = SYMBOL[codes]
    return padded, np.unique(marks // CELL)


def tags_of(spans: list[Span], length: int) -> np.ndarray:
    """Tag of each character: 0 outside, 1 + 2k where a span of kind k begins, 2 + 2k inside; earlier spans win."""
    tags = np.zeros(length, np.int8)
    for a, k, b in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
    return tags


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags for training, from about SAMPLE_DOCS documents, however many there are: of each kind and without spans up to SAMPLE_WINDOWS."""
    rows = docs.where(F.col(text).rlike(f"(?i){MARK}")).select(F.col(text).alias("text"), F.pmod(F.xxhash64(F.lit("pii"), F.col(key).cast("string")), F.lit(1 << 32)).alias("o"))
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            out = []
            for text, order in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                padded, cells = window_cells(text)
                spans = base_spans(text)
                tags = np.zeros(len(padded), np.int8)
                tags[CELL // 2 : CELL // 2 + len(text)] = tags_of(spans, len(text))
                # one window of each kind and one without, from anywhere in the text
                places: dict[int, list[int]] = {}
                for a, k, _ in spans:
                    places.setdefault(k, []).append(a // CELL)
                places[len(KINDS)] = [c for c in cells.tolist() if not tags[c * CELL : c * CELL + SPAN].any()]
                for k, own in sorted(places.items()):
                    if own:
                        c = min(own, key=lambda c: hashlib.md5(f"{order}/{k}/{c}".encode()).digest())
                        out.append((k, order, padded[c * CELL : c * CELL + SPAN].tobytes(), tags[c * CELL : c * CELL + SPAN].tobytes()))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["k", "o", "x", "y"])

    drawn = rows.where(F.col("o") < share * (1 << 32)).mapInArrow(cut, "k int, o long, x binary, y binary").collect()
    kept: dict[int, list[tuple]] = {}
    for r in sorted(drawn, key=lambda r: (r.o, bytes(r.x))):
        if len(own := kept.setdefault(r.k, [])) < SAMPLE_WINDOWS:
            own.append((bytes(r.x), bytes(r.y)))
    both = [w for _, own in sorted(kept.items()) for w in own]
    x, y = (np.frombuffer(b"".join(w[i] for w in both), t).reshape(-1, SPAN) for i, t in ((0, np.uint8), (1, np.int8)))
    return x, y.astype(np.int64)


def respelt(rng: np.random.Generator, kind: int) -> str:
    """A made-up span of a kind in a spelling that the patterns don't know."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 9))))
    if kind == 0:
        at, dot = pick((" @ ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("@", " . "), (" (at) ", " (dot) "), ("@", "[.]"))
        return name() + pick("", "." + name(), "_" + name(), digits(2)) + at + name() + pick("", dot + name()) + dot + pick("com", "org", "net", "example")
    if kind == 1:
        return pick(" . ", "[.]", "(.)", " dot ", "[dot]").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        body = digits(15)
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        return pick(".", "/", "_", "  ", " - ").join(body[i : i + 4] for i in range(0, 16, 4))
    sep = pick(" ", "-", "/", ".")
    return pick("00", "+ ") + str(int(rng.integers(1, 99))) + sep + sep.join(digits(int(rng.integers(2, 5))) for _ in range(3))


def with_respelt(x: np.ndarray, y: np.ndarray, count: int = RESPELT, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The windows x, y and copies of some into which other spellings are put, of all kinds alike."""
    rng = np.random.default_rng(seed)
    more_x, more_y = x[rng.integers(0, len(x), count)].copy(), np.zeros((count, SPAN), np.int64)
    space = SYMBOL[32]
    for i in range(count):
        kind = i % len(KINDS)
        codes = SYMBOL[[ord(c) for c in respelt(rng, kind)]]
        a = int(rng.integers(1, SPAN - len(codes) - 1))
        # what the window had goes, as it may be a part of a span
        prose = SYMBOL[rng.integers(97, 123, SPAN)]
        prose[rng.random(SPAN) < 0.17] = space
        more_x[i] = np.where(more_x[i] == SYMBOL[48], prose, more_x[i])
        more_x[i, a - 1 : a + len(codes) + 1] = space
        more_x[i, a : a + len(codes)] = codes
        more_y[i, a : a + len(codes)] = 2 + 2 * kind
        more_y[i, a] = 1 + 2 * kind
    return np.concatenate([x, more_x]), np.concatenate([y, more_y])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tagger.Params | None:
    """A model of a few kB; null where no text has a mark."""
    x, y = sample(docs, key, text)
    if not len(x):
        return None
    x, y = with_respelt(x, y)
    return tagger.train(tagger.start(SYMBOLS, TAGS, HIDDEN, EMBEDDING), x, y, max(1, STEPS * BATCH // len(x)), BATCH)


def right_form(kind: int, part: str) -> bool:
    """What a form's pattern can't say: the sizes of numbers, check digits, and that something parts them."""
    digits = [c for c in part if c in "0123456789"]
    if kind == 1:
        return all(int(x) <= 255 for x in re.findall("[0-9]+", part))
    if kind == 2:
        return len(part) > len(digits) and luhn("".join(digits))
    return kind == 0 or (len(part) - len(digits) >= 2 and 9 <= len(digits) - 2 * part.startswith("00") <= 15)


def pieces(cells: list[int]) -> list[tuple[int, int, int, int]]:
    """(first cell, cells, first character to keep, end) of runs of neighbouring cells; longer ones than PIECE share two cells with the next piece."""
    out, i = [], 0
    while i < len(cells):
        j = i
        while j + 1 < len(cells) and cells[j + 1] == cells[j] + 1 and j + 1 - i < PIECE:
            j += 1
        more = j + 1 < len(cells) and cells[j + 1] == cells[j] + 1
        n = j - i + 1
        cut_before = bool(out) and out[-1][3] < (out[-1][1] + 1) * CELL  # the one before was cut, and overlaps
        out.append((cells[i], n, CELL * 3 // 2 if cut_before else 0, n * CELL - CELL // 2 if more else (n + 1) * CELL))
        i = j - 1 if more else j + 1
    return out


def run_scores(em: np.ndarray) -> np.ndarray:
    """Scores (runs, characters, tags) from those of the windows of runs of cells (runs, cells, SPAN, tags): means of overlapping windows, weighted by the distance from a window's ends."""
    runs, n, _, tags = em.shape
    weight = np.minimum(np.arange(1, SPAN + 1), np.arange(SPAN, 0, -1)).astype(np.float32)[:, None]
    total, weights = np.zeros((runs, n + 1, CELL, tags), np.float32), np.zeros((n + 1, CELL, 1), np.float32)
    for part, w in ((slice(0, n), weight[:CELL]), (slice(1, n + 1), weight[CELL:])):
        total[:, part] += (em[:, :, :CELL] if part.start == 0 else em[:, :, CELL:]) * w
        weights[part] += w
    return (total / weights).reshape(runs, (n + 1) * CELL, tags)


def decoded(model: tagger.Params, work: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
    """Tags of each piece of (symbols, first cell, cells); those of like sizes together, the shorter ones filled up with what is outside."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(work)
    sizes = [next(s for s in (1, 2, 3, 4, 6, 8, 12, 16, 24, PIECE) if s >= n) for _, _, n in work]
    for size in sorted(set(sizes)):
        own = [i for i, s in enumerate(sizes) if s == size]
        for a in range(0, len(own), max(1, 512 // size)):
            part = own[a : a + max(1, 512 // size)]
            windows = np.concatenate([np.stack([x[c * CELL : c * CELL + SPAN] for c in range(first, first + n)]) for x, first, n in (work[i] for i in part)])
            em, at = tagger.emissions(model, np.ascontiguousarray(windows.T)).transpose(1, 0, 2), 0
            scores = np.full((len(part), (size + 1) * CELL, TAGS), -1e4, np.float32)
            scores[:, :, 0] = 0
            for j, i in enumerate(part):
                n = work[i][2]
                scores[j, : (n + 1) * CELL] = run_scores(em[None, at : at + n])[0]
                at += n
            tags = tagger.viterbi(np.ascontiguousarray(scores.transpose(1, 0, 2)), model["tr"])
            for j, i in enumerate(part):
                out[i] = tags[j]
    return out


def added_spans(model: tagger.Params | None, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the model finds in each text beside base."""
    out: list[list[Span]] = [[] for _ in texts]
    lines: dict[int, np.ndarray] = {}
    work: list[tuple[int, np.ndarray, tuple[int, int, int, int]]] = []
    held = 0

    def flush() -> None:
        nonlocal work, held
        for (i, _, (first, _, low, high)), tags in zip(work, decoded(model, [(x, p[0], p[1]) for _, x, p in work]), strict=True):
            lines[i][first * CELL + low : first * CELL + high] = tags[low:high]
        work, held = [], 0

    for i, text in enumerate(texts if model else []):
        if DIGITS_OR_AT.search(text) or SPELT.search(text):
            padded, cells = window_cells(text)
            lines[i] = np.zeros(len(padded), np.int8)  # moved by half a cell, like the windows
            for piece in pieces(cells.tolist()):
                work.append((i, padded, piece))
                held += piece[1]
                if held >= WINDOWS:
                    flush()
    flush()
    for i, line in lines.items():
        text = texts[i]
        line = line[CELL // 2 : CELL // 2 + len(text)]
        kind = np.where(line > 0, (line + 1) // 2, 0)
        edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
        taken = list(base[i])
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if kind[a]:
                k, low = int(kind[a]) - 1, max(0, a - CELL // 2)
                high = min(len(text), z + CELL // 2)
                for m in FORMS[k].finditer(text, low, high):
                    x, y = m.span()
                    cut_off = y == high < len(text)  # it may go on
                    if x < z and a < y and not cut_off and right_form(k, m[0]) and not any(x < v and u < y for u, _, v in taken):
                        taken.append((x, k, y))
                        out[i].append((x, k, y))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, model: tagger.Params | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans) of each text; counts and base are the patterns' own."""
    names = [key, *[f"n_{k}" for k in KINDS], "base", "spans"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(model, texts, base)
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(map(joined, base), pa.string()), pa.array([joined(b + m) for b, m in zip(base, more, strict=True)], pa.string())], names)

    return docs.select(key, text).mapInArrow(search, f"{key} {dict(docs.dtypes)[key]}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [EMAIL] and the like for spans; overlapping ones become one, named after the first."""
    parts, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, model: tagger.Params | None, text: str = "text") -> DataFrame:
    """docs with every span of its texts replaced; null texts stay null, and other columns as they are."""
    place = docs.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            texts = batch.column(place).to_pylist()
            base = [base_spans(t or "") for t in texts]
            more = added_spans(model, [t or "" for t in texts], base)
            new = [t if t is None else redacted(t, b + m) for t, b, m in zip(texts, base, more, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return docs.mapInArrow(replace, docs.schema)
