"""Operators on small inputs with odd rows, against brute force or exact round trips."""

import hashlib
import io
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickspark.llm import chat, graph, language, media, mix, neardup, pack, pii, ring, tagger, urls, vectors

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ["size", "rank", "rate", "unit", "n", "id", "copies", "component", "row", "score", "part", "window"]


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 6))) for _ in range(n))


def odd_docs():
    """Nulls, empty, blank and one-word texts, ties, copies and a very long text."""
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "word", "en", "b"), (5, "word", "de", "b"), (6, "two words", "en", "b"), (7, words(rng, 150_000), "en", "c")]
    for i in range(20):
        w = base.split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(99))
        rows.append((10 + i, " ".join(w), "en", "c" if i % 3 else "a"))
    rows += [(40, base.upper(), "en", "b"), (41, base, "en", "b"), (42, "é ü 漢字 " * 30, "fr", "b"), (43, "mail a.b@c.example or 10.0.0.1", "en", "a")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), DOC).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- language


def longest_parse(text, sample):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at += n
        count += 1
    return count


def test_phrases_equal_a_plain_parse():
    rng = random.Random(1)
    sample = "".join(rng.choice("abc ") for _ in range(400))
    symbol = {c: i for i, c in enumerate(" abcd")}
    dense = language.suffix_automaton(np.array([symbol[c] for c in sample], np.uint8), 5)
    texts = sorted(("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 90))) for _ in range(50)), key=len, reverse=True)
    flat = np.array([symbol[c] for t in texts for c in t], np.uint8)
    lengths = np.array([len(t) for t in texts])
    got = language.phrases(dense, flat, np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [longest_parse(t, sample) for t in texts]


def test_languages(spark, docs, empty):
    rng = random.Random(2)
    make = lambda a: words(rng, 60, a)
    rows = [(i, make("abcdefg" if i % 2 else "mnopqrs"), "x" if i % 2 else "y", None, 0) for i in range(200)]
    table = spark.createDataFrame([*rows, (900, None, "x", None, 0), (901, "12 - 34", "x", None, 0), (902, "ж" * 50, "x", None, 0)], DOC)
    learnt = language.labelled_sample(table.where(language.learnable()))
    got = {r.doc_id: r for r in language.identify(table, learnt).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _, _ in rows)
    assert (got[900].lang_pred, got[901].lang_pred, got[900].score) == ("und", "und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[902].bits > language.UNEXPLAINED
    kept = language.explained(table.withColumns({c: F.lit(c) for c in CLASH}), learnt)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} and kept.columns[-len(CLASH) :] == CLASH
    assert language.identify(empty, learnt).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.labelled_sample(empty)).collect()} == {"und"}
    held = {r.doc_id: r.h for r in table.select("doc_id", language.held_out().alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in held)


def test_scripts_of_thousands_of_letters():
    """Letters beyond any cap tell languages apart, and an automaton of kept transitions parses as one with a table."""
    rng = random.Random(17)
    han = [chr(0x4E00 + i) for i in range(3000)]
    first, second, latin = han[:1500], han[1500:], "abcdefghij"
    known = {letters[0]: ["".join(rng.sample(letters, 4)) for _ in range(900)] for letters in (first, second, latin)}
    text = lambda letters, n: "".join(rng.choice(known[letters[0]]) for _ in range(n // 4))
    own = {"a": [text(first, 300) for _ in range(100)], "b": [text(second, 300) for _ in range(100)], "c": [text(latin, 300) for _ in range(20)]}
    model = language.Languages(own)
    assert len(language.alphabet(own)) > 2500 and model.automata[0].table is None and model.automata[2].table is not None
    assert model.predict([text(first, 40), text(second, 40), text(latin, 40), "".join(second[:2]) + text(first, 90)])[0] == ["a", "b", "c", "a"]
    flat = np.array([rng.randrange(2, 9) for _ in range(4000)], np.uint8)
    table = language.suffix_automaton(flat, 9)
    kept = language.Transitions.__new__(language.Transitions)
    here = np.flatnonzero(table.table)
    kept.width, kept.table, kept.keys, kept.to = 9, None, here, table.table[here]
    probe = np.array([rng.randrange(0, 9) for _ in range(3000)], np.uint8)
    starts, lengths = np.array([0, 1000, 1900, 2800]), np.array([1000, 900, 900, 200])
    assert language.phrases(table, probe, starts, lengths).tolist() == language.phrases(kept, probe, starts, lengths).tolist()


def test_a_text_reads_alike_beside_any_other():
    table = language.symbol_table("abc")
    alone, at = language.symbols(["  ab c. "], table)
    flat, cuts = language.symbols(["ab", "  ab c. ", "", " a", "  ab c. "], table)
    assert alone.tolist() == [2, 3, 0, 4, 0] == flat[cuts[1] : cuts[2]].tolist() == flat[cuts[4] : cuts[5]].tolist()


# --- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    left = total
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if most * sizes[s] < w[s] * level}
        if not full:
            out |= {s: w[s] * level for s in free}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.randrange(0, 1000) ** 2 for s in [*"abcdefg", None]}
    got = {r.source: r.target for r in mix.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mixing(spark, clashing, empty):
    plan = {r.doc_id: r for r in mix.mix_plan(clashing).collect()}
    assert plan[1]["size"] == 0 and plan[6]["size"] == 2 and all(0 <= r.copies <= 3 for r in plan.values())
    again = {r.doc_id: r.copies for r in mix.mix_plan(clashing.repartition(5)).collect()}
    assert again == {i: r.copies for i, r in plan.items()}
    mixed = mix.mix_sources(clashing)
    assert mixed.columns == clashing.columns and mixed.where("rank = 'own rank' and size = 'own size'").count() == mixed.count()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: r.copies for i, r in plan.items() if r.copies})
    assert mix.mix_sources(empty).count() == 0
    twice = mix.mix_plan(clashing.union(clashing)).collect()
    assert len(twice) == len(plan) and all(r.rows == 2 for r in twice)
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), (F.col("id") % 37 + 1).cast("int")), lambda x: x.cast("string"))).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    sums = mix.mix_plan(many).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.03 * r.target for r in sums)


# --- chat


def test_chat_round_trip(spark):
    rng = random.Random(3)
    nasty = ["</turn>\n", "\\", "<turn role=\"user\">\n", "\\<", "### Assistant:", "", "é漢", "\\### Assistant: </turn> ok", '"']
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 40)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant", 'od"d\\<role')[t % 3 if c % 5 == 0 else t % 2]
            rows.append((c, t, role, None if rng.random() < 0.05 else "".join(rng.choice(nasty) + words(rng, rng.randrange(0, 90)) for _ in range(2))))
    rows += [(None, None, None, None), (99, 1, "assistant", "b"), (99, 1, "assistant", "a"), (98, 0, "assistant", words(rng, 3000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("formatted", "window")}).repartition(5)
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.chat_facts(formatted).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = formatted.collect()
    assert got[1].n_windows > 1
    for w in windows:
        turns = chat.parse(w.formatted)
        assert len(turns) == w.n_turns > w.n_repeated
        size = sum(chat.tokens(x) + 1 for _, x in turns)
        assert size <= chat.BUDGET or w.n_turns - w.n_repeated == 1
        if w.conv_id is not None and w.conv_id < 30 and w.conv_id % 2:
            assert turns[0][0] == "system"
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 300])
def test_chat_blocks(spark, block):
    """Conversations of many blocks against plain windows of each block: turn numbers dense, sparse, null and tied, the system turn in any block or none, copies of it included."""
    rng = random.Random(block)
    rows = []
    for c, (n, step) in enumerate([(900, 1), (900, 1000), (700, 0), (301, 1), (300, 1), (1, 1), (1200, 3)]):
        at = rng.randrange(0, n)
        for t in range(n):
            role = "system" if t in (at, at + 1) and c != 3 else ("user", "assistant")[t % 2]
            number = None if c == 6 and t < 40 else -500 + (t * step if t != at + 1 else at * step)
            rows.append((None if c == 4 else c, number, role, "same" if role == "system" else words(rng, rng.randrange(0, 30))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    formatted = chat.format_chats(df, 64, 20, block)
    made = {}
    for r in formatted.orderBy("conv_id", "block", "window").collect():
        made.setdefault(r.conv_id, {}).setdefault(r.block, []).append((chat.parse(r.formatted), r.n_repeated))
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r, x))
    assert set(made) == set(by)
    several = 0
    for c, turns in by.items():
        turns.sort()
        if len(turns) <= block:
            assert set(made[c]) == {0}
        places, of_block = {}, {}
        for i, t in enumerate(turns):
            places.setdefault(t[1] >> 8 if t[0] else -(2**62), []).append(i)
        for span in places.values():
            of_block.setdefault(span[0] // block if len(turns) > block else 0, []).extend(span)
        several += len(of_block) > 1
        first = next((i for i, t in enumerate(turns) if t[2] == "system"), len(turns))
        said = [(r, x) for _, _, r, x in turns]
        for b, own in of_block.items():
            begin, end = own[0], own[-1] + 1
            system = said[first] if first < begin else None
            assert list(chat.windows(said[begin:end], 64, 20, ahead=said[:begin], system=system)) == made[c][b], (c, b)
        assert set(of_block) == set(made[c])
    assert several >= 3
    for r in chat.chat_facts(formatted.repartition(5)).collect():
        turns = [t[2:] for t in by[r.conv_id]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for role, x in turns).encode()).hexdigest()


# --- near-duplicates


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(sets, percent):
    ids = sorted(sets)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, clashing, k, percent):
    got = {r.doc_id: r for r in neardup.near_duplicates(clashing, k, percent).collect()}
    sets = {r[0]: shingle_set(r[1], k) for r in odd_docs()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(sets, percent)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Many copies with edits of all sizes, through several blocks of a bucket and of a cell."""
    rng = random.Random(8)
    base = words(rng, 100).split()
    texts = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "CELL_BLOCK", 100)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_components({i: shingle_set(t, 3) for i, t in texts}, 85)


def test_one_id_with_several_texts(spark):
    """Rows that share an id are documents of their own; each finds its near copies."""
    rng = random.Random(9)
    a, b, c = (words(rng, 80).split() for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (6, near(b)), (7, near(a)), (5, " ".join(c)), (3, near(c)), (None, near(c)), (None, " ".join(c)), (8, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    sets = [(i, shingle_set(t, 3)) for i, t in rows]

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            x = sets[todo.pop()]
            for j, y in enumerate(sets):
                if j not in seen and None not in (x[0], y[0]) and x[1] and 100 * len(x[1] & y[1]) >= 85 * len(x[1] | y[1]):
                    seen.add(j)
                    todo.append(j)
        return min(sets[j][0] for j in seen) if sets[i][0] is not None else None

    want = Counter((i, len(s), reach(k)) for k, (i, s) in enumerate(sets))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want and want[5, 78, 3] == 1


def test_near_duplicates_of_nothing(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in neardup.near_duplicates(blank).collect()) == [(0, 0), (0, 0), (1, 1), (2, 2), (3, 3)]
    assert neardup.keep_one(spark.createDataFrame(odd_docs(), DOC)).where("doc_id in (4, 5)").count() == 1


def test_keep_one_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (None, c), (None, ""), (None, None), (1, c), (2, d), (2, d), (2, d), (3, ""), (3, ""), (5, "one"), (4, "one")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).repartition(3)
    kept = Counter((r.doc_id, r.text) for r in neardup.keep_one(df.withColumns({c: F.lit(c) for c in CLASH})).collect())
    assert kept == Counter([(None, a), (None, b), (None, ""), (None, None), (1, c), (2, d), (3, ""), (4, "one")])


def test_sketches():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**64, 1200, dtype=np.uint64))
    a, b = pool[:1000], pool[100:]
    both = np.union1d(a, b)
    s = neardup.sketches(np.concatenate([a, b, both]), np.cumsum([0, len(a), len(b), len(both)]))
    assert (neardup.merge(s[0], s[1]) == s[2]).all()
    true = len(np.intersect1d(a, b)) / len(both)
    assert abs(neardup.estimate(s[0], s[1], len(a), len(b)) - true) < 0.08


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_likelihood_gate_misses_less_than_bands(similarity):
    p = lambda j: float(neardup._p(np.array(0.5 - 0.5 * j)))
    d = (p(similarity + 1e-5) - p(similarity - 1e-5)) / 2e-5
    information = neardup.REGISTERS * (2 * d * d / p(similarity) + 4 * d * d / (1 - 2 * p(similarity)))
    miss = math.erfc(neardup.LOOSE_BELOW * math.sqrt(information / 2)) / 2
    count, width = neardup.band_shape(similarity)
    print(similarity, information**-0.5, miss, (1 - similarity**width) ** count)
    assert miss < (1 - similarity**width) ** count


def test_components_with_a_hub_equal_a_plain_search(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, 1000 + i) for i in range(100)]
    edges += edges[:40]
    around = {}
    for a, b in edges:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            new = around[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: least(i) for i in around} and got[1099] == 1000


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 7), (301, 301)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys([7, 300, *range(200, 260)], 7)}


# --- urls


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    cases = {
        1: ("http://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("https://x.net/en/1", "x.net", "/en/1", "net/", "block"), 3: ("https://x.net", "x.net", "", None, None),
        4: ("http://notexample.com/de/1", "notexample.com", "/de/1", None, None), 5: ("http://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"), 6: (None, "", "", None, None), 7: ("no scheme/x", "", "", None, None),
        8: ("http://a.org/fr/#x", "a.org", "/fr/", "org/fr/", "allow"), 9: ("x://http://y/z", "http:", "//y/z", None, None), 10: ("http://É.NET/É?", "É.net", "/É", "net/", "block"), 11: ("http://h.org\n/a\nb?c", "h.org\n", "/a\nb", None, None),
    }
    df = spark.createDataFrame([(i, c[0]) for i, c in cases.items()], "page_id long, url string").withColumns({c: F.lit(0) for c in ("host", "labelled", "t1")})
    got = {r.page_id: r for r in urls.judge_urls(df, rules).collect()}
    for i, (_, host, path, rule, verdict) in cases.items():
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urls.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, []).collect()} == {"allow"}


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.test/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)] + [(1000 + i, f"http://h.test/{'bad' if i % 2 else 'good'}/x{i}") for i in range(10)]
    rules = [("h.test", f"/bad/{i}", "block") for i in range(1, 60, 2)] + [("h.test", f"/good/{i}", "allow") for i in range(0, 60, 2)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert got and all(r.verdict == ("block" if "/bad/" in r.path else "allow") for r in got)
    assert {r.template for r in got} == {"/bad/*", "/good/*"}


def plain_tree(rows, rules, rare, weight=4.0, z=1.96):
    """(template, purity) of each (id, url), by the definition: levels one after the other, then a tree of dicts."""
    seen = []
    for i, url in rows:
        after = url.split("://", 1)[1]
        host = re.match("[^/?#]*", after)[0]
        path = re.match("[^?#]*", after[len(host) :])[0]
        fits = [(len(h + p), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdict = max(fits)[1] if fits else None
        parts = path.rstrip("/").split("/")[1:]
        seen.append([i, host, parts + [""] * (2 - len(parts)), [], verdict is not None, verdict == "block"])
    differs = lambda n, b, na, ba: (b * na - n * ba) ** 2 > z * z * n * ba * (na - ba)
    for level in range(max(len(r[2]) for r in seen)):
        own = [(r, (r[1], *r[3]), "*" if re.search("[0-9]", r[2][level]) else r[2][level]) for r in seen if len(r[2]) > level]
        sums, all_sums = {}, {}
        for r, branch, segment in own:
            for at, key in ((sums, (branch, segment)), (all_sums, branch)):
                a = at.setdefault(key, [0, 0, 0])
                a[0], a[1], a[2] = a[0] + 1, a[1] + r[4], a[2] + r[5]
        for r, branch, segment in own:
            (size, n, b), (size_all, na, ba) = sums[branch, segment], all_sums[branch]
            r[3].append(segment if size >= rare * size_all or differs(n, b, na, ba) else "*")
    tally = lambda key: {k: (sum(r[4] for r in seen if key(r) == k), sum(r[5] for r in seen if key(r) == k)) for k in {key(r) for r in seen}}
    domain = lambda r: r[1].partition(".")[2]
    hosts, domains = tally(lambda r: r[1]), tally(domain)
    n0, b0 = sum(r[4] for r in seen), sum(r[5] for r in seen)
    nodes = {}
    for r in seen:
        for k in range(len(r[3])):
            a = nodes.setdefault((r[1], k, tuple(r[3][:k])), {}).setdefault(r[3][k], [0, 0])
            a[0], a[1] = a[0] + r[4], a[1] + r[5]
    out = {}
    for r in seen:
        p = b0 / n0
        for n, b in (domains[domain(r)], hosts[r[1]]):
            p = (b + weight * p) / (n + weight)
        for k in range(len(r[3])):
            own = nodes[r[1], k, tuple(r[3][:k])]
            na, ba = sum(n for n, _ in own.values()), sum(b for _, b in own.values())
            apart = {s: differs(n, b, na, ba) or n == 0 for s, (n, b) in own.items()}
            n, b = own[r[3][k]] if apart[r[3][k]] else [sum(own[s][j] for s in own if not apart[s]) for j in (0, 1)]
            p = (b + weight * p) / (n + weight)
        out[r[0]] = ("".join("/" + s for s in r[3]), p)
    return out


@pytest.mark.parametrize("seed,rare", [(1, 0.01), (2, 0.1), (3, 0.3)])
def test_templates_equal_a_plain_tree(spark, seed, rare):
    rng = random.Random(seed)
    pick = lambda: rng.choice(["a", "b", "c", "d", "a", "a", "n1", "77", "", rng.choice("uvwxyz") * 2])
    rows = [(i, f"http://{rng.choice(['h.x', 'g.x', 'k.y.x'])}/" + "/".join(pick() for _ in range(rng.randrange(0, 7)))) for i in range(400)]
    rules = [("h.x", "/a/", "block"), ("h.x", "/a/b", "allow"), ("g.x", "/b", "block"), ("y.x", "/c", "allow"), ("k.y.x", "/a/a/", "block")]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, rare=rare).collect()}
    for i, (template, purity) in plain_tree(rows, rules, rare).items():
        assert got[i].template == template and abs(got[i].purity - purity) < 2e-6, (got[i], template, purity)


def test_a_url_of_a_thousand_segments(spark):
    rows = [(0, "http://h.x/" + "/".join(f"s{i}" if i % 3 == 0 else "abc"[i % 3] for i in range(1000))), (1, "http://h.x/b/c"), *((i, f"http://h.x/b/c/d/{'e' if i % 2 else 'f'}/{i}") for i in range(2, 150))]
    began = time.time()
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [("h.x", "/b", "block")]).collect()}
    assert got[0].template.count("/") == 1000 and got[0].template.startswith("/*/b/c/*") and got[5].template == "/b/c/d/e/*" and time.time() - began < 90


def test_templates_have_all_levels(spark):
    kinds = ("spam", "docs")
    rows = [(2 * i + k, f"http://h.test/en/blog/x/{kinds[k]}/{i}/read/") for i in range(100) for k in (0, 1)] + [(900, "http://h.test/en/blog/"), (901, "http://h.test/en/blog")]
    rules = [("h.test", f"/en/blog/x/{w}/{i}/", v) for i in range(30) for w, v in zip(kinds, ("block", "allow"), strict=True)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 900:
            assert r.template == f"/en/blog/x/{kinds[r.page_id % 2]}/*/read" and r.verdict == ("allow" if r.page_id % 2 else "block")
    assert {r.template for r in got if r.page_id >= 900} == {"/en/blog"}


def test_a_wide_branch_keeps_frequent_and_different_values(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, f"http://h.test/{'news' if i % 2 else 'w' + word(i)}/{i}") for i in range(1000)] + [(2000 + i, f"http://h.test/spam/{i}") for i in range(8)]
    rules = [("h.test", f"/spam/{i}", "block") for i in range(6)] + [("h.test", f"/news/{i}", "allow") for i in range(1, 100, 2)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert {got[i].template for i in range(1, 1000, 2)} == {"/news/*"} and {got[i].template for i in range(0, 1000, 2)} == {"/*/*"}
    assert (got[2007].template, got[2007].rule, got[2007].verdict) == ("/spam/*", None, "block") and got[0].verdict == got[999].verdict == "allow"


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    return path, Tokenizer.from_file(path)


def test_packing(spark, clashing, empty, tokenizer, monkeypatch):
    path, hf = tokenizer
    pieces = pack.pack(clashing.where("doc_id <> 7 or doc_id = 7"), path)
    got = pieces.collect()
    ids = {r[0]: [*hf.encode(r[1] or "", add_special_tokens=False).ids, pack.END] for r in odd_docs()}
    seen = {i: [] for i in ids}
    sequences = {}
    for p in got:
        assert p.ids == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
        seen[p.doc_id].append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, parts in seen.items():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist() and sum(n for _, n in parts) == len(ids[i])
    for parts in sequences.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and total <= pack.WINDOW and total & (total - 1) == 0
    assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in got)
    bare = pack.pack(clashing, path, with_ids=False)
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, pieces.drop("ids").collect()))
    assert pack.pack(empty, path).count() == 0


def test_words_encode_like_texts(tokenizer):
    path, hf = tokenizer
    odd = ["", "a b \u0085 c\x1cd  ΑΣ ΟΔΟΣ. <|endoftext|> x<|startoftext|>y é é don't I'M 12  z퟿ İ", "\n\n", "x" * 3000, "Word, WORD.. word ÉCOLE. it's. ß."]
    flat, at = pack.Words.of(path).encode(pa.array(odd))
    for i, t in enumerate(odd):
        assert flat[at[i] : at[i + 1]].tolist() == [*hf.encode(t, add_special_tokens=False).ids, pack.END]


def test_other_tokenizers_encode_like_texts(tokenizer, tmp_path):
    """One that keeps capitals, and one that keeps white space: the shortcuts are asked for, not assumed."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = {c: i + 2 for i, c in enumerate("abcdefgABCDEFG .,")}
    texts = ["ab Ab. AB,, ..a", "", "  a  b ", None]
    for before, parted in ((pre_tokenizers.WhitespaceSplit(), True), (None, False)):
        own = Tokenizer(models.BPE({"?": 0, "</s>": 1, **letters}, [], unk_token="?"))
        if before:
            own.pre_tokenizer = before
        own.save(path := str(tmp_path / f"{parted}.json"))
        words = pack.Words(path)
        assert (words.parted, words.folded) == (parted, False)
        flat, at = words.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert flat[at[i] : at[i + 1]].tolist() == [*own.encode(t or "", add_special_tokens=False).ids, pack.END]


def exact_nnls(a, h):
    """The least error over all sets of columns, each by plain least squares."""
    best = float(h @ h)
    for k in range(1, a.shape[1] + 1):
        for own in itertools.combinations(range(a.shape[1]), k):
            x = np.linalg.lstsq(a[:, own], h, rcond=None)[0]
            if (x >= -1e-9).all():
                best = min(best, float(((a[:, own] @ x - h) ** 2).sum()))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_solver_reaches_the_exact_optimum(seed):
    rng = np.random.default_rng(seed)
    h = np.zeros(17, np.int64)
    h[rng.choice(np.arange(1, 16), 9, replace=False)] = rng.integers(1, 60, 9)
    combos = pack.combinations(h, 16)[:10]
    a = np.zeros((17, len(combos)))
    for j, row in enumerate(combos):
        for n in row[row > 0]:
            a[n, j] += 1
    x = pack.solve(combos, h, 1e-7)
    assert (x >= 0).all() and ((a @ x - h) ** 2).sum() <= exact_nnls(a, h.astype(float)) + 1e-5


def test_combinations_match_a_histogram():
    h = np.zeros(2049, np.int64)
    h[[1000, 1048, 512, 700, 648]] = [50, 50, 80, 40, 20]
    combos = pack.combinations(h)
    counts = pack.rounded(combos, pack.solve(combos, h), h)
    used = np.bincount(combos.ravel(), np.repeat(counts, 4), 2049)[1:]
    assert (used <= h[1:]).all() and used.sum() >= 230 and (combos.sum(1) == 2048).all()


# --- vectors


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 24))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=24) * rng.choice([0.0, 0.03, 0.06, 0.1])
        rows.append((i, (v * rng.choice([1.0, 3.0, 1e-30])).astype(float).tolist(), int(i % 3) if i % 50 else None))
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 24, 1), (503, [1.0] * 23 + [None], 1), (504, [1.0] * 23 + [float("nan")], 1), (505, [float("inf")] * 24, 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (508, [1.0, 2.0], 1)]
    monkeypatch.setattr(vectors, "BLOCK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(0) for c in ("id", "n", "cell")})
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    fine = {i: (np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fine:
        for b in fine:
            (x, p), (y, q) = fine[a], fine[b]
            if a < b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                s, t = top(a), top(b)
                up[max(s, t)] = min(s, t)
    assert {i: r.n_links for i, r in got.items()} == links and sum(links.values()) > 100
    assert {i: r.component_id for i, r in got.items()} == {i: top(i) for i in up}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_one_id_with_several_vectors(spark):
    """Rows that share an id, or have none, are vectors of their own."""
    near = lambda v: [x + 0.01 for x in v]
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (4, c, 0), (4, c, 0), (None, near(c), 0), (None, a, 1), (5, a, 1), (5, a, None)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 2, 4), (4, 2, 4), (None, 2, None), (None, 1, None), (5, 1, 5), (5, 0, 5)])


def test_tile_bound_is_rigorous():
    rng = np.random.default_rng(5)
    x, y = vectors.unit(rng.normal(size=(60, 1500)) * rng.choice([1, 50], size=(60, 1500))), vectors.unit(rng.normal(size=(50, 1500)))
    y[:30] = vectors.unit(x[:30] + rng.normal(size=(30, 1500)) * 0.02)
    for least in (0.0, 0.5, 0.9):
        assert (vectors.tile(x, y, least) == (x @ y.T >= least)).all() and vectors.possible(vectors.quantised(x), vectors.quantised(y), least)[x @ y.T >= least].all()


# --- personal data


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = sum(sum(divmod(int(d) * 2, 10)) for d in digits[-2::-2]) + sum(map(int, digits[::-2]))
            fine = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits, o=odd: 12 <= len(d) <= 19 and o % 10 == 0, "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]
            if fine():
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(5))
def test_patterns_equal_plain_ones(seed):
    rng = random.Random(seed)
    bits = ["a.b", "@", "c-d", ".", "1", "23", "255", "256", " ", "-", "+", "(", ")", "4111111111111111", "é", "x@y.z", "10.0.0.1", "\n", "+1 (555) 555-5555", "٣", "_%"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_long_runs_stay_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "@" * 100_000, "0" * 9000 + ".1.2.3", "+1" + " " * 200_000, "a@b" * 50_000):
        pii.base_spans(text)


def test_tagger_gradients_and_learning():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tagger.start(6, 3, 4, 5).items()}
    x, y = rng.integers(0, 6, (7, 3)), rng.integers(0, 3, (7, 3))
    _, g = tagger.loss_and_grads(p, x, y)
    for k in p:
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert abs((tagger.loss_and_grads(up, x, y)[0] - tagger.loss_and_grads(down, x, y)[0]) / 2e-5 - g[k][i]) < 1e-6
    x = rng.integers(0, 4, (64, 12))
    y = np.where(x == 2, 1, np.where(np.roll(x, 1, 1) == 2, 2, 0))
    y[:, 0] = np.where(x[:, 0] == 2, 1, 0)
    model = tagger.train(tagger.start(4, 3, 8, 4), x, y, 40, 16)
    assert (tagger.decode(model, x) == y).mean() > 0.98


def test_personal_data(spark, clashing, empty):
    rng = random.Random(6)
    make = lambda: rng.choice([f"{words(rng, 1)}.{rng.randrange(99)}@mail.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(256)}", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"])
    rows = [(i, f"{words(rng, 30)} {make()} {words(rng, 30)}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(table)
    got = {r.doc_id: r for r in pii.find(table, model).collect()}
    for i, t in rows:
        base = pii.joined(brute_spans(t))
        assert got[i].base == base and set(base.split(",")) <= set(got[i].spans.split(","))
    x, y = pii.sample(table)
    assert ((tagger.decode(model, x) > 0) == (y > 0)).mean() > 0.95
    clean = pii.redact(clashing, model)
    assert clean.columns == clashing.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] is None and texts[43] == "mail [EMAIL] or [IP]" and texts[4] == "word"
    assert pii.fit(empty) is None and pii.find(empty, None).count() == 0


# --- media


def test_pictures_round_trip():
    rng = np.random.default_rng(7)
    for h, w in ((1, 1), (3, 5), (64, 64), (10, 7)):
        x = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert (media.decode(media.encode_ppm(x)) == x).all() and (media.decode(media.encode_bmp(x)) == x).all()
    assert media.decode(b"P2 # c\n2 1\n15\n0 15")[0, :, 0].tolist() == [0, 255]
    for bad in (b"", b"P6\n2 2\n255\nxx", b"GIF89a", b"BM" + bytes(60)):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_equals_means():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 256, (12, 20, 3), dtype=np.uint8)
    assert np.allclose(media.resize_area(x, 3, 5), x.reshape(3, 4, 5, 4, 3).mean((1, 3)))
    assert np.allclose(media.resize_area(x, 12, 20), x)
    assert np.allclose(media.resize_area(x, 7, 9).mean((0, 1)), x.mean((0, 1)))
    assert np.allclose(media.resize_area(np.full((1, 1, 3), 9, np.uint8), 8, 9), 9)


def test_media(spark, clashing, empty):
    got = {r.doc_id: r for r in media.media_facts(media.text_media(clashing)).collect()}
    for i, t, *_ in odd_docs():
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.text_picture(raw)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[4].feature == got[5].feature and media.media_facts(media.text_media(empty)).count() == 0
    pictures = spark.createDataFrame([(1, bytearray(media.encode_bmp(np.full((70, 65, 3), 5, np.uint8)))), (2, None), (3, bytearray(b"junk"))], "pic long, data binary")
    tiles = media.media_tiles(pictures, "pic", "data").collect()
    assert sorted((t.pic, t.tile_row if t.tile_row is not None else -1, t.tile_col if t.tile_col is not None else -1) for t in tiles) == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (2, -1, -1), (3, -1, -1)]
    import io

    last = next(t for t in tiles if t.tile_row == t.tile_col == 1)
    assert np.load(io.BytesIO(bytes(last.npy))).shape == (6, 1, 3)


# --- sharding


@pytest.mark.parametrize("group", [50_000, 2])
def test_shards(spark, clashing, empty, group):
    df = clashing.select("doc_id", "text", "size", "rank").union(spark.range(1000, 3000).selectExpr("id", "concat('t', id % 3)", "'s'", "'r'")).union(spark.range(500).selectExpr("77L", "concat('u', id)", "'s'", "'r'"))
    got = ring.ring_shards(df, 24, 8, rows_a_group=group).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    one = next(r for r in got if r.doc_id == 42)
    raw = ("é ü 漢字 " * 30).encode()
    assert (one["size"], one.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert ring.ring_shards(empty).count() == 0


def test_a_new_shard_moves_little():
    nodes = [ring.ring(n, 64) for n in (24, 25)]
    counts = [np.random.default_rng(9).multinomial(100_000, np.diff([0, *[c for c, _ in x[1:]], ring.CELLS]) / ring.CELLS).tolist() for x in nodes]
    for n, x, c in zip((24, 25), nodes, counts, strict=True):
        plan = ring.spread(c, [s for _, s in x], [100_000 // n + (s < 100_000 % n) for s in range(n)])
        own = sum(hi - lo for a, spans in enumerate(plan) for lo, hi, shard, _ in spans if shard == x[a][1])
        assert own > 0.85 * 100_000  # most rows stay with their own node


def row_by_row(arcs, shards, capacity):
    """Shard and slot of each row by a plain walk: round by round, each row that has no place asks the next node clockwise."""
    free, slot, out = list(capacity), [0] * len(capacity), [None] * len(arcs)
    for hop in range(len(shards)):
        for i in sorted(range(len(arcs)), key=lambda i: (arcs[i], i)):
            shard = shards[(arcs[i] + hop) % len(shards)]
            if out[i] is None and free[shard]:
                out[i] = (shard, slot[shard])
                free[shard] -= 1
                slot[shard] += 1
    return out


def by_plan(arcs, shards, capacity):
    counts = np.bincount(arcs, minlength=len(shards)).tolist()
    plan, rank, out = ring.spread(counts, shards, capacity), Counter(), []
    for a in arcs:
        r = rank[a]
        rank[a] += 1
        out.append(next((shard, slot + r - lo) for lo, hi, shard, slot in plan[a] if lo <= r < hi))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_plan_equals_a_plain_clockwise_walk(seed):
    rng = np.random.default_rng(seed)
    nodes = ring.ring(6, 4)
    arcs = rng.integers(0, len(nodes), 100) if seed % 2 else rng.choice([0, 3, 3, 3, 20], 100)
    capacity = [100 // 6 + (s < 100 % 6) for s in range(6)]
    assert by_plan(arcs.tolist(), [s for _, s in nodes], capacity) == row_by_row(arcs.tolist(), [s for _, s in nodes], capacity)


def test_one_more_shard_moves_a_small_share():
    n, shard_of = 50_000, []
    cells = np.random.default_rng(4).integers(0, ring.CELLS, n)
    for shards in (24, 25):
        nodes = ring.ring(shards, 32)
        arcs = np.searchsorted([c for c, _ in nodes], cells) % len(nodes)
        shard_of.append([s for s, _ in by_plan(arcs.tolist(), [s for _, s in nodes], [n // shards + (s < n % shards) for s in range(shards)])])
    moved = sum(a != b for a, b in zip(*shard_of, strict=True)) / n
    print("moved share", moved)
    assert 1 / 25 <= moved < 0.25  # hashing modulo the number of shards would move 0.96


def test_pictures_are_read_back_from_tiles(spark):
    texts = ["", "a" * 500, "é" * 20_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in media.media_facts(media.text_media(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        rows = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        files = []
        for a in range(0, len(rows), 64):
            np.save(out := io.BytesIO(), rows[a : a + 64])
            files.append(out.getvalue())
        r = got[i]
        assert (r.payload_sha256, r.n_tiles, r.tiles_sha256) == (hashlib.sha256(payload).hexdigest(), len(files), hashlib.sha256(b"".join(files)).hexdigest())
        assert r.tile_hashes.split(",") == [brute_hash(rows[a : a + 64]) for a in range(0, len(rows), 64)] and r.feature == brute_hash(rows)


def brute_hash(pixels):
    """Bits of 8 rows of 9 area means by summing each pixel's share of each field."""
    h, w, _ = pixels.shape
    grey = pixels @ np.array([0.299, 0.587, 0.114])
    share = lambda n, parts: np.array([[max(0.0, min(i + 1, (p + 1) * n / parts) - max(i, p * n / parts)) for i in range(n)] for p in range(parts)]) * parts / n
    small = np.round(share(h, 8) @ grey @ share(w, 9).T, 6)
    return "".join(f"{int(''.join('01'[int(a < b)] for a, b in zip(row, row[1:], strict=False)), 2):02x}" for row in small)


def test_samples_above_the_maximum_are_no_picture():
    assert media.decode(b"P2\n2 1\n7\n0 7")[0, :, 0].tolist() == [0, 255]
    for bad in (b"P2\n2 1\n7\n0 8", b"P3\n1 1\n255\n1 2 256", b"P2\n1 1\n255\n-1"):
        with pytest.raises(ValueError):
            media.decode(bad)


# --- personal data in other spellings


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(5)
    em, tr = rng.normal(size=(5, 3, 4)), rng.normal(size=(4, 4))
    got = tagger.viterbi(em, tr)
    for b in range(3):
        value = lambda way, b=b: sum(em[t, b, k] for t, k in enumerate(way)) + sum(tr[i, j] for i, j in zip(way, way[1:], strict=False))
        assert tuple(got[b].tolist()) == max(itertools.product(range(4), repeat=5), key=value)


@pytest.mark.parametrize("cells", [[0], [3, 4, 5], [1, 2, 7, 8, 9, 20], list(range(100)), [*range(29), *range(40, 72), 90]])
def test_pieces_keep_each_character_once(cells):
    keep = [first * pii.CELL + i for first, _, low, high in pii.pieces(cells) for i in range(low, high)]
    assert len(keep) == len(set(keep)) and set(keep) == {c * pii.CELL + i for c in cells for i in range(pii.SPAN)}
    assert all(n <= pii.PIECE for _, n, _, _ in pii.pieces(cells))


def test_every_spelling_has_a_mark():
    """Whatever respelt() makes, and any address or number that has an exact form, lies in cells that are read, with no other mark around."""
    rng = np.random.default_rng(31)
    spans = [pii.respelt(rng, i % 4) for i in range(2000)] + ["john.smith(at)hosting.com", "jane [at] firm.org", "j ( at ) f.org", "JANE [AT] FIRM.ORG", "a at b dot org"]
    for span in spans:
        before = "x" * int(rng.integers(0, 200))
        text = f"{before} {span} {'y' * 70}"
        cells = set(pii.window_cells(text)[1].tolist())
        marked = {(m.start() // pii.CELL) for m in pii.MARKS.finditer(text)}
        a = len(before) + 1
        assert marked == cells and any(c * pii.CELL < a + len(span) and a < (c + 1) * pii.CELL for c in cells), span


def test_other_spellings_in_texts_that_were_not_learnt(spark):
    """Recall and precision of what the model adds to the patterns, in held-out texts with spans that another seed makes up."""
    rng = random.Random(11)
    make = lambda: rng.choice([f"{words(rng, 1)}.{rng.randrange(99)}@mail.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(256)}", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"])
    learnt = spark.createDataFrame([(i, f"{words(rng, 30)} {make()} {words(rng, 30)} {rng.randrange(10**16):016d}") for i in range(300)], "doc_id long, text string")
    model, held = pii.fit(learnt), np.random.default_rng(77)
    found = right = there = 0
    for i in range(200):
        before, span, after = words(rng, 40), pii.respelt(held, i % 4), words(rng, 40)
        text, a = f"{before} {span} {after} {rng.randrange(10**16):016d} {words(rng, 9)}", len(before) + 1
        base = pii.base_spans(text)
        if any(x < a + len(span) and a < y for x, _, y in base):
            continue  # the patterns know a part of it
        added = pii.added_spans(model, [text], [base])[0]
        there, found, right = there + 1, found + len(added), right + ((a, i % 4, a + len(span)) in added)
    print("recall", right / there, "precision", right / max(1, found))
    assert there > 150 and right / there > 0.75 and right / found > 0.95


def test_spans_across_windows_and_long_runs(spark):
    rows = [(i, f"{'w' * (i % 50)} mail: ab{i}@mail.example.com, call +1 (212) 555-{1000 + i} or 10.0.0.{i % 250}") for i in range(200)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    for shift in range(0, 60, 7):
        text = "x " * shift + "see 10 . 0 . 0 . 77 there"
        assert [(k, text[a:z]) for a, k, z in pii.added_spans(model, [text], [pii.base_spans(text)])[0]] in ([], [(1, "10 . 0 . 0 . 77")])
    digits = "7 1 " * 5000  # marks everywhere: many pieces of one run
    assert pii.added_spans(model, [digits, "", "no"], [pii.base_spans(digits), [], []])[1:] == [[], []]


# --- url templates without labels


def test_branches_without_labels_have_their_parents_purity(spark):
    pages = [("s.example.com/de/a", 30), ("s.example.com/en/a", 10), ("s.example.com/en/b", 8), ("s.example.com/fr/a", 9), ("t.org/fr/a", 30), ("t.org/fr/b", 5), ("t.org/xx/yy", 4)]
    rows = [(i, f"https://{u}") for i, u in enumerate(u for u, n in pages for _ in range(n))]
    got = {(r.host, r.template): r.purity for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [("example.com", "/de/", "block"), ("org", "/fr/", "allow")]).collect()}
    p0 = 30 / 65
    p2 = (30 + 4 * (30 + 4 * p0) / 34) / 34
    q2 = (4 * (4 * p0) / 39) / 39
    for template in ("/en/a", "/en/b", "/fr/a"):
        assert abs(got["s.example.com", template] - p2) < 1e-6
    assert abs(got["t.org", "/xx/yy"] - q2) < 1e-6 and got["s.example.com", "/de/a"] > p2


# --- language, held out


def test_language_of_held_out_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    found = language.identify(docs, language.labelled_sample(docs.where(language.learnable()))).join(docs.where(language.held_out() & F.col("lang").isNotNull()).select("doc_id", "lang"), "doc_id")
    n, right = found.where("lang_pred <> 'und'").agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    print("held out", right, n)
    assert n > 200 and right / n > 0.99


# --- rows and stages


def test_shards_of_a_row_with_many_copies(spark):
    copies = spark.range(700).selectExpr("5L doc_id", "'same' text")
    df = copies.unionByName(spark.range(1400).selectExpr("id doc_id", "concat('t', id) text")).unionByName(spark.range(3).selectExpr("cast(null as long) doc_id", "cast(null as string) text"))
    got = ring.ring_shards(df, rows_a_group=10).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in df.collect())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_pipeline_of_odd_rows(spark, tmp_path, tokenizer):
    """Stage by stage against plain versions: nulls, empty and long texts, ties, repeated rows, null ids, clashing columns."""
    import corpus_pipeline as P

    from tickspark.llm.common import written

    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(12).collect()]
    rows = [(i, t, "en", "a" if i % 2 else None, None) for i, t in enumerate(prose, 100)] + [(None, prose[0], "en", "b", 1), (None, prose[1] + " mail a.b@c.example", None, "b", 1)] + [(100, prose[0], "en", None, None)] * 3
    df = spark.createDataFrame(odd_docs() + rows, DOC).withColumns({c: F.lit(f"own {c}") for c in CLASH})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == before.columns and docs.where("rank is null or rank <> 'own rank'").count() == 0
        out[name] = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    start = Counter((r.doc_id, r.text, r.source) for r in before.collect())
    known = Counter(out["language"])
    assert not known - start and all(any(map(str.isalpha, t or "")) for _, t, _ in known)
    sample = language.labelled_sample(before.where(language.learnable()))
    fits = plainly_explained(sample, language.limits(sample))
    of_text = {t: fits(t or "") for _, t, _ in start}
    assert known == Counter({row: n for row, n in start.items() if of_text[row[1]]}) and 0 < known.total() < start.total()
    # one row of each group of near-duplicates
    texts = sorted({t for _, t, _ in known})
    groups = brute_components({i: shingle_set(t, 5) for i, t in enumerate(texts)}, 80)
    single = Counter(groups[texts.index(t)] for _, t, _ in out["neardup"])
    assert single == Counter(set(groups.values()))
    assert not Counter(out["neardup"]) - known
    # personal data go, nothing else changes
    assert len(out["pii"]) == len(out["neardup"]) and not any(pii.base_spans(t) for _, t, _ in out["pii"])
    same = [t for _, t, _ in out["neardup"] if not pii.base_spans(t)]
    assert not Counter(same) - Counter(t for _, t, _ in out["pii"])
    # each document floor(rate) times or once more
    sizes = Counter()
    for _, t, s in out["pii"]:
        sizes[s] += len(mix_words(t))
    targets, times = brute_targets(sizes), Counter(out["mixing"])
    for row, n in Counter(out["pii"]).items():
        rate = targets[row[2]] / sizes[row[2]]
        assert n * math.floor(rate) <= times[row] <= n * (math.floor(rate) + 1)
    assert not set(times) - set(out["pii"])
    # all ids, in order, as often as the document came
    hf, seen = tokenizer[1], Counter()
    pieces = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    for p in pieces:
        seen[p.doc_id] += p.length
    want = Counter()
    for i, t, _ in out["mixing"]:
        want[i] += len(hf.encode(t, add_special_tokens=False).ids) + 1
    assert seen == want


def plainly_explained(sample, limits):
    letters = set(language.alphabet(sample))

    def spelt(text):
        return re.sub(" +", " ", "".join((c.lower() if c.lower() in letters else "?") if c.isalpha() else " " for c in text)).lstrip(" ")

    data = {k: spelt(" ".join(v)) + " " for k, v in sample.items()}

    def fits(text):
        s = spelt(text)
        bits = {k: math.log2(len(d)) * sum(longest_parse(s[i : i + language.WINDOW], d) for i in range(0, len(s), language.WINDOW)) for k, d in sorted(data.items())}
        best = min(bits, key=bits.get)
        return s.strip() != "" and bits[best] <= limits.get(best, language.UNEXPLAINED) * len(s) + language.SPARE * math.log2(len(data[best]))

    return fits


def mix_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_pipeline_of_nothing(spark, empty, tmp_path, tokenizer):
    import corpus_pipeline as P

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
