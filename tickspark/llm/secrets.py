"""Secrets in texts: three exact patterns, and strings near sensitive words that their surroundings don't explain.

A candidate is a run of key characters that begins within REACH characters behind a sensitive word (password, token, private key and the like).
Its novelty is what it adds to its compressed surroundings: zstandard, primed with a dictionary, compresses the text around it with and
without it, and the bytes that come on top, over its length, are compared with a limit. Names, paths, placeholders, alphabets and words are found in the
dictionary or nearby and add little; keys add nearly all of their bytes. The dictionary holds names of code (fixed) and the identifiers and words
most frequent in all texts with a sensitive word, counted in all of them; words with digits aren't counted, so no key gets in, however often it's copied.

Null texts count as empty; empty ones have no spans. Positions are code points, ends exclusive. Equal texts have equal spans. Without
sensitive words, the dictionary is the fixed one. Added spans are of the kind `assign` and overlap no other. Empty
tables give empty results, repeated rows repeated ones, and other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import slices

KINDS = ("assign", "access", "hex")
#: As the contract has them; runs of A-Z0-9 and 0-9a-f are as long as they can be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

SENSITIVE_WORDS = r"password|passwd|passphrase|pwd|secret|token|credential|bearer|authorization|(?:api|access|private|account|auth|encryption|signing|session|master)[_ -]?key"
#: A sensitive word with the rest of its identifier.
SENSITIVE = re.compile(rf"(?:{SENSITIVE_WORDS})[A-Za-z0-9_-]*", re.A | re.I)
#: What a text must hold to be looked at, for RE2.
GATE = rf"(?i:{SENSITIVE_WORDS})|AKIA[A-Z0-9]|[0-9a-f]{{24}}"
#: Shortest candidate, how far behind the word it may begin, and the text on either side that it's measured against.
SHORTEST, REACH, AROUND = 12, 24, 256
RUN = re.compile(r"[A-Za-z0-9+/_](?:[A-Za-z0-9+/_=~!#$%^&*.-]*[A-Za-z0-9+/_=])?")
#: Compressed bytes a character that a candidate must add, and words of the dictionary.
NOVEL, WORDS = 0.77, 4096

#: Names and placeholders of code that no key is made of.
CODE = """
0123456789 01234567890123456789 1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/ 9876543210 qwertyuiop asdfghjkl zxcvbnm
00000000-0000-0000-0000-000000000000 xxxxxxxxxxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXXXXXXXXXX ************************ ________________________ ------------------------ ........................ ################
your-api-key-here your_token_here YOUR_SECRET_KEY changeme CHANGE_ME example EXAMPLE placeholder redacted REDACTED undefined null None default
localhost http:// https:// www. .com/ .org/ .example.com/ api/v1/ api/v2/ oauth2/token /usr/local/lib/python3/site-packages/ /etc/ssl/certs/ /home/user/.config/ /var/run/secrets/ node_modules/ src/main/java/ src/test/resources/
2020-01-01T00:00:00Z 2023-11-12T10:15:30+00:00 2024-05-06 2025-10-11 2026-12-31 01/02/2025 application/json content-type text/plain charset=utf-8 release version snapshot RELEASE SNAPSHOT january february march april june july august september october november december
self. this. config. settings. process.env. os.environ. System.getenv getProperty get_secret_value getSecretValue SecretManager CredentialsProvider TokenProvider TokenValidator PasswordEncoder KeyFactory AuthenticationManager
access_token refresh_token id_token client_secret client_id secret_key private_key public_key session_key encryption_key signing_key master_key api_key password_hash password_reset credentials authorization authentication
validation validator verification expiration configuration repository controller service manager factory builder handler provider interface exception response request session middleware environment production staging development
certificate signature algorithm encryption decryption documentation description implementation administrator notification subscription integration transaction application organization
""".strip()

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def dictionary_words(docs: DataFrame, text: str = "text", most: int = WORDS) -> list[str]:
    """The `most` most frequent words and identifiers of 4 to 24 characters, none of them digits, of all texts that hold a sensitive word; so many at most come to the driver."""
    words = docs.where(F.col(text).rlike(f"(?i){SENSITIVE_WORDS}")).select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[\p{L}_]{4,24}(?![\p{L}\p{N}_])"), F.lit(0))).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(most)
    return [r.word for r in top.collect()]


def dictionary(words: list[str]) -> bytes:
    """What compressors are primed with: the rarest words first, as what is near costs less, and code last."""
    return "\n".join([*reversed(words), CODE]).encode()


class Novelty:
    """Measures candidates with one primed compressor."""

    def __init__(self, primed: bytes) -> None:
        held = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        small = zstandard.ZstdCompressionParameters.from_level(19, write_checksum=False, write_content_size=False, write_dict_id=False, window_log=17)
        held.precompute_compress(compression_params=small)
        self.compressor = zstandard.ZstdCompressor(dict_data=held, compression_params=small)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def of(self, text: str, a: int, b: int) -> float:
        """Bytes a character that text[a:b], as it is or in small letters, adds to its surroundings, from which its other copies are taken out.

        The mean of where it stands and behind all of it, as a few bytes hang on how zstandard cuts its blocks.
        """
        own = text[a:b]
        before, after = text[max(0, a - AROUND) : a].replace(own, " "), text[b : b + AROUND].replace(own, " ")
        more = [min(self.size(x + own + y), self.size(x + own.lower() + y)) - self.size(x + y) for x, y in ((before, after), (f"{after}\n{before}", ""))]
        return sum(more) / 2 / (b - a)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters, not of digits and signs alone, that begin close behind a sensitive word."""
    out: list[tuple[int, int]] = []
    for word in SENSITIVE.finditer(text):
        for m in RUN.finditer(text, word.end(), min(len(text), word.end() + REACH)):
            m = RUN.match(text, m.start())  # as long as it goes
            a, b = m.span()
            if b - a >= SHORTEST and any(c.isalpha() for c in m[0]) and (not out or a >= out[-1][1]):
                out.append((a, b))
    return out


def added_spans(novelty: Novelty, text: str, base: list[Span], limit: float = NOVEL) -> list[Span]:
    """Candidates beside base that are novel."""
    found = [(a, b) for a, b in candidates(text) if not any(a < v and u < b for u, _, v in base)]
    return [(a, 0, b) for a, b in found if novelty.of(text, a, b) >= limit]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text", limit: float = NOVEL) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base, spans, added) of each text; counts and base are the patterns' own, spans all, added those of the method."""
    names = [key, *[f"n_{k}" for k in KINDS], "base", "spans", "added"]
    primed = dictionary(words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed)
        for batch in slices(batches, text, 4 << 20):
            held = pc.fill_null(batch.column(1), "")
            base: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            more: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            looked = pc.indices_nonzero(pc.match_substring_regex(held, GATE))
            for i, t in zip(looked.to_pylist(), held.take(looked).to_pylist(), strict=True):
                base[i] = base_spans(t)
                more[i] = added_spans(novelty, t, base[i], limit)
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            texts = [pa.array(map(joined, spans), pa.string()) for spans in (base, [b + m for b, m in zip(base, more, strict=True)], more)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *texts], names)

    return docs.select(key, text).mapInArrow(search, f"{key} {dict(docs.dtypes)[key]}, n_assign long, n_access long, n_hex long, base string, spans string, added string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [SECRET] for spans; overlapping ones become one."""
    parts, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, words: list[str], text: str = "text", limit: float = NOVEL) -> DataFrame:
    """docs with every span of its texts replaced; null texts stay null, and other columns as they are."""
    place, primed = docs.columns.index(text), dictionary(words)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed)
        for batch in slices(batches, text, 4 << 20):
            new = []
            for t in batch.column(place).to_pylist():
                base = base_spans(t) if t else []
                new.append(redacted(t, base + added_spans(novelty, t, base, limit)) if t else t)
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return docs.mapInArrow(replace, docs.schema)
