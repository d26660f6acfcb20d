"""Filter audit, importance resampling and secrets against brute force on small inputs with odd rows."""

import base64
import hashlib
import itertools
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickspark.llm import audit, importance, secrets, sql
from tests.llm.test_llm_small import CLASH, DOC, odd_docs, words
from tests.test_sql_pairs import rows

LABELS = "doc_id long, quality int, toxic int"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def more_docs():
    """odd_docs(), null and repeated ids, repeated rows, and a third of copies."""
    rng = random.Random(9)
    out = [*odd_docs(), (None, "word", "en", "b", 4), (None, "no id", "en", None, 5), (60, "twice", "en", "a", 5), (60, "twice", "en", "a", 5), (61, "TWICE $", "en", "a", 7), (None, None, None, None, None)]
    copy = words(rng, 300, "abcXYZ")
    out += [(100 + i, copy, "en", "hot", len(copy)) for i in range(25)]
    out += [(200 + i, t := words(rng, rng.randrange(400), "abcdefgXY#"), "en", "hot", len(t)) for i in range(15)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(more_docs(), DOC).repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 220, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)], LABELS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- audit


def plain_masks(docs):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _, s, _ in docs:
        t = t or ""
        w = SPLIT.findall(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        yield i, s or "", sum(f << k for k, f in enumerate(fails))


def test_audit_equals_brute_force(spark, docs, labels):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = audit.counters(docs.withColumns({c: F.lit(f"own {c}") for c in [*CLASH, "kind", "mask", "fp", "words", "good"]}), labels.withColumn("n", F.lit(3)))
        ours = {(r.part, r.mask): (r.n, r.good, r.toxic) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    told = labels.collect()
    good, toxic = {r.doc_id for r in told if r.quality == 1} - {None}, {r.doc_id for r in told if r.toxic == 1} - {None}
    theirs = defaultdict(lambda: (0, 0, 0))
    masks = list(plain_masks(more_docs()))
    for i, s, m in masks:
        n, g, t = theirs[s, m]
        theirs[s, m] = (n + 1, g + (i in good), t + (i in toxic))
    assert ours == dict(theirs)
    # every order, by applying it
    got = {(r.part, r.filter_order, r.step): r[3:] for r in audit.in_every_order(found).collect()}
    parts = {s for _, s, _ in masks}
    assert len(got) == 600 * len(parts)
    for s in parts:
        removed_by = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [(i, m) for i, p, m in masks if p == s]
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                fail = [(i, m) for i, m in left if m & bit]
                all_fail = [m for _, p, m in masks if p == s and m & bit]
                left = [x for x in left if not x[1] & bit]
                removed_by[f] += len(fail)
                want = (len(left), len(fail), len(all_fail) - len(fail), sum(m == bit for m in all_fail), sum(i in good for i, _ in fail), sum(i in toxic for i, _ in fail))
                assert got[s, "".join(order), step][:6] == want
        assert all(r[6] == removed_by[order[step - 1]] for (p, order, step), r in got.items() if p == s)


def test_audit_of_nothing(empty, labels):
    assert audit.in_every_order(audit.counters(empty, labels)).count() == 0


def test_audit_without_labels(spark, docs):
    none = audit.counters(docs, spark.createDataFrame([], LABELS)).agg(F.sum("n"), F.sum("good"), F.sum("toxic")).first()
    assert tuple(none) == (len(more_docs()), 0, 0)


@pytest.mark.parametrize("seed", range(6))
def test_borders_and_equal_fingerprints(seed):
    """Texts that share fingerprints, dealt by (fp, id) over tasks of any size and read in batches of any size."""
    rng = random.Random(seed)
    docs = [(rng.randrange(3), rng.choice("abc"), rng.choice([None, *range(12)])) for _ in range(60)]
    docs = [(f, f"{f}{t}" if rng.random() < 0.5 else t, i) for f, t, i in docs]
    fp = {t: hash(t) % 2 for _, t, _ in docs}
    docs = [(fp[t], t, i) for _, t, i in docs]
    order = lambda d: (d[0], -1 if d[2] is None else d[2])
    dealt = sorted(docs, key=order)
    tasks, at = [], 0
    while at < len(dealt):
        end = min(len(dealt), at + rng.randrange(1, 20))
        while end < len(dealt) and order(dealt[end]) == order(dealt[end - 1]):
            end += 1  # equal keys are never parted
        tasks.append(sorted(dealt[at:end], key=lambda d: (d[0], d[1], order(d))))
        at = end
    out = []
    for task in tasks:
        size = rng.randrange(1, 9)
        batches = [
            pa.RecordBatch.from_arrays([pa.array([d[0] for d in b], pa.int64()), pa.array([d[1] for d in b]), pa.array([d[2] for d in b], pa.int64()), pa.array(["p"] * len(b)), pa.array([0] * len(b), pa.int32())], ["fp", "text", "id", "part", "mask"])
            for b in (task[i : i + size] for i in range(0, len(task), size))
        ]
        out += [r for b in audit.looked_back(iter(batches), 16) for r in b.to_pylist()]
    tails = {}
    for r in out:
        if r["kind"] == audit.TAIL:
            tails[r["fp"], r["text"]] = min(r["id"], tails.get((r["fp"], r["text"]), r["id"]))
    late = [r["mask"] + 16 * (tails.get((r["fp"], r["text"]), r["id"]) < r["id"]) for r in out if r["kind"] == audit.OPEN]
    got = Counter(late + [r["mask"] for r in out if r["kind"] == audit.DECIDED])
    least = {}
    for _, t, i in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    assert got == Counter(16 * (i is not None and i > least[t]) for _, t, i in docs)


# --- importance


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def test_checksums():
    rng = random.Random(3)
    texts = ["", "a", "AbC d", "é ü 漢字 x", "x" * 63 + " " + "y" * 64 + " " + "z" * 5000, "one", "two three", "-- --", *(words(rng, rng.randrange(60), "abcé9Z") for _ in range(40))]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    keys, count = importance.feature_keys(np.frombuffer(data, np.uint8), offsets)
    assert Counter(keys.tolist()) == Counter(bucket(f) * len(texts) + i for i, t in enumerate(texts) for f in plain_features(t)[1])
    assert count.tolist() == [plain_features(t)[0] for t in texts]


def plain_draw(docs, target):
    s, t = Counter(bucket(f) for d in docs for f in plain_features(d[1])[1]), Counter(bucket(f) for x in target for f in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text, *_ in docs:
        n, features = plain_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * float(S + 10000) / ((s[b] + 1) * float(T + 10000)))) for b in map(bucket, features))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    long = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = {id(r): k for k, r in enumerate(long[: 5 * len(long) // 100], 1)}
    return [(*r, ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("slice_bytes", [importance.SLICE, 2000])
def test_importance_equals_brute_force(spark, docs, monkeypatch, slice_bytes):
    monkeypatch.setattr(importance.postings, "__defaults__", ("text", slice_bytes))
    target = [words(random.Random(2), 200, "abc"), None, "", "word two words"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    # enough documents for a draw
    rng = random.Random(8)
    more = [(1000 + i, words(rng, rng.randrange(10, 60)), "en", "x", 0) for i in range(120)]
    all_docs = docs.unionByName(spark.createDataFrame(more, DOC)).withColumns({c: F.lit(1) for c in ("weight", "grp", "slice", "n", "sums", "at", "range")})
    got = importance.drawn(importance.document_weights(all_docs, bench))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    plain = plain_draw(more_docs() + more, target)
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(plain, key=order)
    assert sum(r[5] is not None for r in plain) > 4


def test_importance_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.drawn(importance.document_weights(empty, none)).count() == 0
    got = importance.document_weights(docs, none).collect()
    want = Counter((r[0], r[3]) for r in plain_draw(more_docs(), []))
    assert Counter((r.doc_id, r.weight) for r in got) == want


@pytest.mark.parametrize("name", ["op11_audit", "op12_importance"])
def test_sql_on_odd_rows(spark, docs, labels, name):
    """The SQL agrees on rows with ids, those without are the brute force's."""
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    con = duckdb.connect()
    d, lab = own.toPandas(), labels.toPandas()
    bench = spark.createDataFrame([(1, "word two words"), (2, None)], "item_id long, text string")
    b = bench.toPandas()
    con.register("documents", d), con.register("labels", lab), con.register("benchmark", b)
    ours = audit.in_every_order(audit.counters(own, labels)) if name == "op11_audit" else importance.drawn(importance.document_weights(own, bench)).drop("n_words")
    ours, theirs = ours.toPandas(), con.execute(sql.SQL[name]).df()
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


# --- secrets


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


BITS = ["password", "PassWd", "secret", "token", "ſecret", "api_key", "apiKey", "toKen", '"', "'", " ", "  ", ":", "=", "a1b2c3", "x", "AKIA", "AKIA" + "Q7" * 8, "A" * 15, "0123456789abcdef" * 2, "deadbeef", "é", "\n", ".", "/+_-", "ABC", "漢"]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(11)
    for _ in range(4000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 14)))
        assert secrets.base_spans(text) == plain_base(text), text
    assert secrets.base_spans("a" * 300_000 + " token" + " " * 300_000) == [(0, 2, 300_000)]


def test_every_span_passes_the_gate(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + [None, "", "x" * 500_000 + " token = 'abcdefgh1'"]
    got = secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), []).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id] or "")
        assert r.base == secrets.joined(base) and set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in base) for k in range(3)]


CONTEXTS = [
    "Authorization: Bearer {}\nAccept: application/json", "aws_secret_access_key {}\nregion us-east-1", "set the password to {} before you start", "\"secret_key\" => '{}',", "the token is {} and it expires",
    "export API_KEY_PROD {}\nexport HOST x", "<password>{}</password>", "private key ({})", "credentials: user / {}", "auth_key -> {}",
]
ORDINARY = """token_validation_handler_v2 secretKeyFactoryBean2 /usr/lib/python3.13/site-packages XXXXXXXXXXXX1234 aaaaaaaaaaaaaaa1 1234567890abcdef changeme-changeme-1 00000000-0000-0000-0000-000000000000
    getUserCredentialsById validate_password_strength com.example.auth.TokenProvider your-api-key-here-123 application/x-www-form-urlencoded authentication_required_v3 config/production.yaml abcdefghijklmnop12345 4785380592391139
    DefaultPasswordEncoder2 /etc/kubernetes/secrets/db-password ENCRYPTION_KEY_PLACEHOLDER docs/authentication/token-refresh.md rotate-credentials-every-90-days node_modules/passport-local user_password_confirmation""".split()


def test_novelty_parts_keys_from_names():
    """Held-out keys in sensitive places are found, names and placeholders there aren't, though both have the same places and shapes."""
    rng = random.Random(21)
    of = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    letters = string.ascii_letters + string.digits
    keys = [lambda: of(rng.randint(16, 40), letters), lambda: base64.b64encode(rng.randbytes(24)).decode(), lambda: "ghp_" + of(36, letters), lambda: of(14, letters + "!#$%^&*"), lambda: of(32, "0123456789ABCDEF"), lambda: of(18, string.ascii_lowercase + string.digits)]
    novelty = secrets.Novelty(secrets.dictionary([]))

    def share(values, limit=secrets.NOVEL):
        hit = total = 0
        for value in values:
            for context in CONTEXTS:
                text = words(rng, 60, string.ascii_lowercase) + "\n" + context.format(value) + "\n" + words(rng, 60, string.ascii_lowercase)
                a = text.index(value)
                spans = secrets.base_spans(text) + secrets.added_spans(novelty, text, secrets.base_spans(text), limit)
                hit += any(u < a + len(value) and a < v for u, _, v in spans)
                total += 1
        return hit / total

    assert share([k() for k in keys for _ in range(10)]) > 0.93
    assert share(ORDINARY) < 0.1
    assert share([v for v in ORDINARY if not v.isdigit()], -1.0) > 0.95  # the places and shapes alone would report them all


def test_copies_of_a_key_stay_novel(spark):
    key = "qT7zLw9XkP2mVb4RsY"
    text = f"set the password to {key} or again {key} now"
    docs = spark.createDataFrame([(i, text, None) for i in range(50)] + [(99, None, "x"), (None, text, "x")], "doc_id long, text string, spans string")
    known = secrets.dictionary_words(docs)
    assert "password" in known and not any(c.isdigit() for w in known for c in w)
    got = secrets.find(docs, known).collect()
    assert {r.added for r in got if r.doc_id != 99} == {f"assign:20:{20 + len(key)}"} and len(got) == 52
    clean = secrets.redact(docs, known)
    assert clean.columns == docs.columns and {r.text for r in clean.collect()} == {None, f"set the password to [SECRET] or again {key} now"}


def test_secrets_of_nothing(empty):
    known = secrets.dictionary_words(empty)
    assert known == [] and secrets.find(empty, known).count() == 0 and secrets.redact(empty, known).count() == 0
