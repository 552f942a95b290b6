from __future__ import annotations

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.llm import automaton, edit_prints, kneser, queries, tiles
from quillspan.llm import kernels as K
from quillspan.llm.graph import components
from tests.llm.common import SCHEMA, clashing, odd_texts, prose, table, words

SF = "/root/testdata/sf0.001"


def real():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


# --- n-gram Jaccard join ---


def shingles(text):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 90 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("make", [table, clashing])
def test_components_against_brute_force(spark, make, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 8)
    monkeypatch.setattr(tiles, "SMALL", 4)
    rng = random.Random(11)
    texts = odd_texts()
    for n, k, edits in ((40, 60, 3), (120, 50, 5), (400, 20, 14), (9, 20, 1), (1000, 6, 40), (64, 30, 2)):
        texts += near_copies(rng, prose(rng, n), k, edits)
    texts += [f"{prose(rng, 12)} the same closing line of words here {prose(rng, 12)}" for _ in range(40)]
    want = brute_components(list(enumerate(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in tiles.jaccard_components(make(spark, texts)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 60


def test_join_on_documents_and_edges(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op2_jaccard_join"](spark, SF).collect()}
    assert got == brute_components(real())
    assert tiles.jaccard_components(table(spark, [])).count() == 0
    twice = table(spark, ["a b c d", "x"]).unionByName(table(spark, ["a b c d", "x"]))
    assert sorted(tuple(r) for r in tiles.jaccard_components(twice).collect()) == [(0, 2, 0), (0, 2, 0), (1, 1, 1), (1, 1, 1)]


def test_shuffle_files_go_with_their_step(spark, monkeypatch):
    """None outlasts its step, though nothing is collected; those of all keys lay beside the steps after them before."""
    dirs = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in dirs for p in d.rglob("shuffle_*")}
    settle, steps, left = tiles.settle, [], []

    def settled(df, name, **more):
        begun = files()
        out = settle(df, name, **more)
        until = time.perf_counter() + 10
        while files() - begun and time.perf_counter() < until:
            time.sleep(0.1)
        steps.append(name)
        if files() - begun:
            left.append(name)
        return out

    monkeypatch.setattr(tiles, "settle", settled)
    monkeypatch.setattr(tiles, "sweep", lambda session: None)
    rng = random.Random(12)
    texts = near_copies(rng, prose(rng, 60), 30, 3) + [f"{prose(rng, 12)} the same closing line of words here {prose(rng, 12)}" for _ in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in tiles.jaccard_components(table(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))
    assert not left and {"classes", "shared", "meetings", "met", "left", "pairs", "sets", "links", "names"} <= set(steps)


def test_parity_bound_never_undershoots():
    rng = np.random.default_rng(4)
    for n in (5, 100, 700):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[: n - n // 10], rng.integers(0, 2**63, n // 8).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if tiles.band_of(len(x)) != tiles.band_of(len(y)):
            continue
        a, b = (np.frombuffer(tiles.parity_bits(s), np.uint64) for s in (x, y))
        assert (len(x) + len(y) - int(np.bitwise_count(a ^ b).sum())) / 2 >= len(np.intersect1d(x, y))


def test_needed_keys_are_shared():
    """Any two linked sets share as many kept shingles as the search asks of each of them."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**62, n))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.05], rng.integers(0, 2**62, int(rng.integers(0, n // 15 + 2)))]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 90 * (len(x) + len(y) - both) or not both:
            continue
        for levels in (np.zeros(64, np.uint8), rng.integers(0, 9, 64).astype(np.uint8)):
            kept = [tiles.prefix(s.astype(np.uint64), levels) for s in (x, y)]
            shared = len(np.intersect1d(*kept))
            for m in (len(x), len(y)):
                least = -(-90 * m // 100)
                assert shared >= 1 + tiles.prefix_length(least) // 2
            # without each one's most crowded keys a shared one is left
            crowd = {k: int(rng.integers(2, 9)) for k in set(kept[0].tolist()) | set(kept[1].tolist())}
            left = [set(sorted(k.tolist(), key=lambda x: (-crowd[x], x))[tiles.prefix_length(-(-90 * len(s) // 100)) // 2 :]) for k, s in zip(kept, (x, y))]
            assert left[0] & left[1]


def test_order_is_rarest_first(spark):
    texts = ["the same opening line of words " + " ".join(f"d{d}w{i}" for i in range(20)) for d in range(50)]
    levels = tiles.frequency_levels(table(spark, texts), 3)
    sets = tiles.shingle_sets(pa.array(texts))
    common = set(sets[0].tolist()) & set(sets[1].tolist())
    assert len(common) == 4
    assert not any(common & set(tiles.prefix(s, levels).tolist()) for s in sets)


def test_graph(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}


# --- quality classifier ---


def brute_kneser(train, text):
    """Log-probability of each word, from dictionaries."""
    tri = Counter()
    for t in train:
        w = ["<s>", "<s>", *words(t)]
        tri.update(zip(w, w[1:], w[2:]))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)

    def discount(counts):
        n = Counter(counts.values())
        if not n[1] or not n[2]:
            return {1: 0.5, 2: 0.5, 3: 0.5}
        y = n[1] / (n[1] + 2 * n[2])
        d = {1: 1 - 2 * y * n[2] / n[1], 2: 2 - 3 * y * n[3] / n[2], 3: 3 - 4 * y * n[4] / n[3] if n[3] else 1.5}
        return {k: min(max(v, 0.0), k) for k, v in d.items()}

    d3, d2, d1 = discount(tri), discount(bi), discount(uni)
    off = lambda d, n: d[min(n, 3)]
    by3, by2 = defaultdict(list), defaultdict(list)
    for (a, b, _), n in tri.items():
        by3[a, b].append(n)
    for (b, _), n in bi.items():
        by2[b].append(n)
    total = sum(uni.values())
    uniform = sum(off(d1, n) for n in uni.values()) / total / (len(uni) + 1)
    out = []
    w = ["<s>", "<s>", *words(text)]
    for a, b, c in zip(w, w[1:], w[2:]):
        p = (uni[c] - off(d1, uni[c])) / total + uniform if c in uni else uniform
        if b in by2:
            n = bi.get((b, c), 0)
            p = (n - off(d2, n) if n else 0) / sum(by2[b]) + sum(off(d2, x) for x in by2[b]) / sum(by2[b]) * p
        if (a, b) in by3:
            n = tri.get((a, b, c), 0)
            p = (n - off(d3, n) if n else 0) / sum(by3[a, b]) + sum(off(d3, x) for x in by3[a, b]) / sum(by3[a, b]) * p
        out.append(math.log(p))
    return out


def test_kneser_against_dictionaries(spark):
    rng = random.Random(8)
    train = [prose(rng, 80, "ab") for _ in range(12)] + ["", "a b"]
    tests = [prose(rng, 30, "abc"), "", "zz", train[0]]
    parts = K.words(pa.array(train))
    one, two = kneser.contexts(parts)
    _, first, n = np.unique(kneser.triple_key(two, one, parts.hashes), return_index=True, return_counts=True)
    rows = zip(*(x[first].astype(np.int64).tolist() for x in (two, one, parts.hashes)), n.tolist())
    model = kneser.estimate(spark.createDataFrame(list(rows), "a long, b long, c long, n long"), shards=3)
    w = K.words(pa.array(tests))
    want = [x for t in tests for x in brute_kneser(train, t)]
    assert np.allclose(model.log_probability(w), want, atol=1e-4)


def labelled(spark, n=240):
    rng = random.Random(3)
    vocabulary = [prose(rng, 1) for _ in range(60)]
    good = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 90))) for _ in range(n)]
    junk = [" ".join(f"{rng.choice(vocabulary).upper()}!!" for _ in range(60)) for _ in range(30)]
    texts = [*good, *junk, None, "", " "]
    rows = [(i, t, "en" if i % 2 else "fr", "s", 1) for i, t in enumerate(texts)]
    labels = [(i, 1 if i < n else 0, 0) for i in range(n + 30)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


def held_out_id(spark, i):
    return spark.range(i, i + 1).select(kneser.held_out(F.col("id"))).first()[0]


def test_classifier_keeps_good_text(spark):
    docs, labels, n = labelled(spark)
    got = {r["doc_id"]: r for r in kneser.classify(docs, labels).collect()}
    assert sum(got[i]["kept"] for i in range(n)) >= 0.98 * n
    assert not any(got[i]["kept"] for i in range(n, n + 33))
    assert got[n + 31]["log_perplexity"] is None
    odd = docs.withColumn("__score", F.lit("x")).withColumn("___score", F.lit(1)).withColumn("__threshold", F.lit(None).cast("int"))
    kept = kneser.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got.values())
    assert {(r["__score"], r["___score"], r["__threshold"]) for r in kept.collect()} == {("x", 1, None)}
    middles = {}
    for lang in ("en", "fr"):  # thresholds and verdicts by hand
        held = [r for r in got.values() if r["doc_id"] < n and r["lang"] == lang and r["log_perplexity"] is not None and held_out_id(spark, r["doc_id"])]
        grid = np.round([r["log_perplexity"] for r in held], 3)
        middles[lang] = float(np.percentile(grid, 50))
        scores = [(r["log_perplexity"] * r["n_words"] + middles[lang] * kneser.SHRINK) / (r["n_words"] + kneser.SHRINK) for r in held]
        high = float(np.percentile(np.round(scores, 3), 100 * kneser.QUANTILE))
        assert len(held) >= kneser.LEAST_TRUSTED
        for r in got.values():
            if r["lang"] == lang and r["log_perplexity"] is not None:
                score = (r["log_perplexity"] * r["n_words"] + middles[lang] * kneser.SHRINK) / (r["n_words"] + kneser.SHRINK)
                assert r["score"] == pytest.approx(score, abs=1e-6)
                assert r["threshold"] == pytest.approx(high + kneser.SPREAD * (high - middles[lang]), abs=2e-3)
                assert r["kept"] == (r["score"] <= r["threshold"])


def test_classifier_without_labels_or_rows(spark):
    docs, labels, n = labelled(spark)
    none = kneser.classify(docs, labels.where("false")).collect()
    assert sum(r["kept"] for r in none) == n + 30
    assert kneser.classify(docs.where("false"), labels).count() == 0
    odd = kneser.classify(clashing(spark), labels).collect()
    assert len(odd) == len(odd_texts())


def test_held_out_accuracy(spark):
    rows = kneser.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.5


def test_no_text_is_written_for_thresholds(spark, monkeypatch):
    """Held-out documents' scores alone lie beside later stages; a copy of all rows did before."""
    docs, labels, n = labelled(spark)
    written, settle = {}, kneser.settle

    def settled(df, name, **more):
        written[name] = settle(df, name, **more)
        return written[name]

    monkeypatch.setattr(kneser, "settle", settled)
    monkeypatch.setattr(kneser, "drop", lambda table: None)
    want = {r["doc_id"] for r in kneser.classify(docs, labels).collect() if r["kept"]}
    assert {r["doc_id"] for r in kneser.keep_good(docs, labels).collect()} == want
    assert not any("text" in table.columns for table in written.values())
    held = [r["id"] for r in written["perplexity"].collect()]
    assert len(held) < n / 2 and all(i < n and held_out_id(spark, i) for i in held)


# --- fingerprints ---


def embedding(text):
    """One text's walk, character by character: for each step the hashed bits of what it writes, None behind its end."""
    letters, out, at = edit_prints.classes(np.array([ord(c) for c in text], np.uint32)), [], 0
    for step in range(4 * len(text) + 200):
        done = at >= len(text)
        out.append(None if done else int(edit_prints.bit_row(step)[letters[at]]))
        at += 0 if done else int(edit_prints.move_row(step)[letters[at]])
    assert out[-1] is None
    return out


def brute_print(text):
    """The fingerprint's words from the walk of one text."""
    steps = embedding(text)
    words = [len(text), 0, 0, 0, 0]
    for p in range(64):
        for plane in range(4):
            words[1 + plane] |= ((steps[p] or 0) >> plane & 1) << p if p < len(steps) else 0
    o = 1
    while edit_prints.octave_start(o) < 2 * len(text):
        places = edit_prints._PLACES[o].tolist()
        assert places[0] >= 64 << (o - 1) and places[-1] < 64 << o and len(set(places)) == 64
        words.append(sum(((steps[p] or 0) & 1) << k for k, p in enumerate(places) if p < len(steps)))
        o += 1
    return b"".join(w.to_bytes(8, "little") for w in words).hex()


@pytest.mark.parametrize("make", [table, clashing])
def test_prints_and_edits(spark, make, monkeypatch):
    texts = [*odd_texts(), *[t for _, t in real()[:40]]]
    plain = [t or "" for t in texts]
    got = {r["doc_id"]: r for r in edit_prints.fingerprints(make(spark, texts).repartition(5)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, r in got.items():
        after = plain[i - 1] if i else plain[-1]
        changed = plain[i][: len(plain[i]) - len(plain[i]) // 2] + after[: len(plain[i]) // 2]
        assert r["n_chars"] == len(plain[i])
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        if len(plain[i]) < 6000:
            assert r["fingerprint"] == brute_print(plain[i]) and r["edited_fingerprint"] == brute_print(changed)
        p, q, x = (edit_prints.parse([f]) for f in (r["fingerprint"], r["edited_fingerprint"], got[i - 1 if i else len(texts) - 1]["fingerprint"]))
        assert r["near_edited"] == pytest.approx(float(edit_prints.likeness(p, q)[0])) and 0 <= r["near_edited"] <= 1
        assert r["near_next"] == pytest.approx(float(edit_prints.likeness(p, x)[0]))
        assert r["bands_edited"] == edit_prints.bands_in_common(p, q)[0] and r["bands_next"] == edit_prints.bands_in_common(p, x)[0]


def test_likeness_follows_the_embeddings():
    """Sampled likeness against the share of steps at which whole embeddings agree."""
    rng = random.Random(6)
    off, shares = [], []
    for share in (0.0, 0.002, 0.005, 0.01, 0.03, 0.2, 1.0):
        for _ in range(6):
            base = prose(rng, rng.choice((30, 200, 600)), "abcdefghijklmnop")
            text = "".join(c if rng.random() >= share else rng.choice("qrstuvwxyz") for c in base)
            n = 2 * max(len(base), len(text))
            x, y = embedding(base)[:n], embedding(text)[:n]
            true = sum(a == b for a, b in zip(x, y)) / n
            got = float(edit_prints.likeness(*(edit_prints.parse([brute_print(t)]) for t in (base, text)))[0])
            off.append(abs(got - true))
            assert share or got == 1
        shares.append((share, got))
    assert np.mean(off) < 0.08 and max(off) < 0.3
    a, b = (edit_prints.parse([brute_print(t)]) for t in ("abc def ghi jkl", "abc def ghi jkk"))
    assert 0.5 < edit_prints.likeness(a, b)[0] < 1
    assert edit_prints.likeness(edit_prints.parse([brute_print("")]), a)[0] == 0


def test_few_documents(spark):
    assert edit_prints.fingerprints(table(spark, [])).count() == 0
    r = edit_prints.fingerprints(table(spark, ["abcdef"])).first()
    assert r["near_next"] == 1 and r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    twice = table(spark, ["abc", "xyz"]).unionByName(table(spark, ["abc", "xyz"]))
    assert edit_prints.fingerprints(twice).count() == 4


def test_likeness_falls_with_edits():
    rng = random.Random(6)
    base = prose(rng, 800, "abcdefghijklmnop")
    last = 1.1
    for share in (0.0, 0.003, 0.02, 0.2, 1.0):
        text = "".join(c if rng.random() >= share else rng.choice("qrstuvwxyz") for c in base)
        raw = edit_prints._Texts(pa.array([base, text]))
        p = edit_prints.prints(raw.chars, raw.bounds)
        now = float(edit_prints.likeness(p[:1], p[1:])[0])
        assert now <= last
        last = now
    assert last < 0.2


def test_similar_pairs(spark):
    rng = random.Random(6)
    base = [prose(rng, 500, "abcdefghij") for _ in range(6)]
    texts = [x for b in base for x in (b, b, b.replace("a", "z", 2))]
    marked = edit_prints.fingerprints(table(spark, texts))
    by = {r["doc_id"]: r["fingerprint"] for r in marked.collect()}
    got = {frozenset((r[0], r[1])) for r in edit_prints.similar(marked, 0.7, block=2).collect()}
    assert got == {frozenset((by[3 * i], by[3 * i + 2])) for i in range(6) if by[3 * i] != by[3 * i + 2]}


# --- LM scoring ---


def test_scores_against_definition(spark, monkeypatch):
    docs = [*enumerate(odd_texts()), *((1000 + i, t) for i, t in real())]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], SCHEMA)
    toks = {d: [*(w.lower() for w in words(t)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    c = Counter(t for d, x in toks.items() if not held[d] for t in x)
    n, v = sum(c.values()), len(c)
    rows = {r["doc_id"]: r for r in automaton.score(df).collect()}
    for d, r in rows.items():
        assert r["held_out"] == held[d] and r["n_tokens"] == len(toks[d]) and r["train_tokens"] == n
        assert r["n_known"] == sum(t in c for t in toks[d])
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks[d]))
        assert r["score"] < 0
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_without_training(spark):
    assert automaton.score(table(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = automaton.score(spark.createDataFrame([(only, "a b", "en", "s", 1)], SCHEMA)).first()
    assert r["held_out"] and (r["base_score"], r["score"], r["n_known"], r["train_tokens"]) == (0, 0, 0, 0)


def test_scores_with_clashing_names(spark):
    a = sorted(automaton.score(table(spark)).collect())
    assert a == sorted(automaton.score(clashing(spark)).collect())


def brute_ngram_scores(train, text):
    """log10 probability of a text by dictionaries of all n-grams, without any alphabet."""
    streams = [[None, *(w.lower() for w in words(t)), None] for t in train]
    uni = Counter(t for s in streams for t in s[1:])
    two = Counter(p for s in streams for p in zip(s, s[1:]))
    three = Counter(p for s in streams for p in zip(s, s[1:], s[2:]))
    n, kinds = sum(uni.values()), Counter(uni.values())
    d = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] and kinds[2] else 0.5
    s, out = [None, *(w.lower() for w in words(text)), None], 0.0
    for i in range(1, len(s)):
        p = (uni[s[i]] - d if s[i] in uni else d * len(uni)) / n
        p = (two[s[i - 1], s[i]] + automaton.PRIORS[0] * p) / (uni[s[i - 1]] + automaton.PRIORS[0])
        if i > 1:
            p = (three[s[i - 2], s[i - 1], s[i]] + automaton.PRIORS[1] * p) / (two[s[i - 2], s[i - 1]] + automaton.PRIORS[1])
        out += math.log10(p)
    return out


@pytest.mark.parametrize("cut", [None, 3000])
def test_scores_know_every_ngram(spark, monkeypatch, cut):
    """Thousands of rare words: every n-gram of each counts, so a held-out copy scores far above its words shuffled."""
    if cut:
        monkeypatch.setattr(automaton, "BLOCK_BYTES", cut)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rng = random.Random(12)
    texts = {i: " ".join(f"w{rng.randrange(6000)}" for _ in range(60)) for i in range(400) if i not in held}
    source = texts[next(iter(texts))].split()
    texts[held[0]] = " ".join(source)
    texts[held[1]] = " ".join(rng.sample(source, len(source)))
    texts[held[2]] = "never seen words"
    texts[held[3]] = None
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: r["score"] for r in automaton.score(df.repartition(3)).collect()}
    train = [t for i, t in texts.items() if i not in held]
    for i in [*held[:4], *list(texts)[:20]]:
        assert got[i] == pytest.approx(brute_ngram_scores(train, texts[i]))
    assert got[held[0]] > got[held[1]] + 40


def test_ngram_model_is_a_distribution():
    """Over all tokens and the unseen one, behind any history, whether the walk takes arcs or falls."""
    uni = np.array([5, 3, 1, 1])  # the last is the end
    d = 0.4
    rng = np.random.default_rng(3)
    for _ in range(20):
        two = np.array([rng.integers(0, c + 1) for c in uni])
        three = np.array([rng.integers(0, c + 1) for c in two])
        total = 0.0
        for w in range(5):
            # a text of x, y, w and the end: w's history (x, y) was followed by as many tokens as ``two`` and ``three`` sum to
            counts = [np.array([1, two.sum(), uni[w] if w < 4 else 0, 1]), np.array([1, three.sum(), two[w] if w < 4 else 0, 1]), np.array([0, 0, three[w] if w < 4 else 0, 0])]
            one = [automaton.automaton(np.arange(n), np.array([0, n]), [c[:n] for c in counts], int(uni.sum()), len(uni), d) for n in (2, 3)]
            for m, _ in one:
                m.fail[1, 0], m.arc[1, 0], m.arc[0, 0] = 0.0, 0.0, 0.0  # of the last token alone
            low, high = (m.walk(np.array([0, n]), 1)[0] for n, (m, _) in zip((2, 3), one))
            total += 10 ** (high - low)
        assert total == pytest.approx(1)


def test_packed_keys_and_shards():
    rng = np.random.default_rng(2)
    for keys in ([], [0], [0, 1], [2**64 - 1], rng.integers(0, 2**63, 5000).tolist()):
        keys = np.unique(np.array(keys, np.uint64))
        assert (automaton.unpack(automaton.pack(keys)) == keys).all()
        of = automaton.shard_of(keys, 512)
        assert (np.diff(of) >= 0).all() and (of >= 0).all() and (of < 512).all()


def test_a_block_that_asks_twice_gets_one_answer():
    def ask(block, keys, own):
        return {"shard": 0, "block": block} | {f"{c}{n}": x for n in range(3) for c, x in (("keys", automaton.pack(np.array(keys, np.uint64))), ("own", automaton.squeeze(np.array(own, np.uint32))))}

    def got(rows):
        return {(r["block"], tuple(np.frombuffer(automaton.spread(r["all2"]), np.int64).tolist())) for r in automaton.add_up(pa.Table.from_pylist(rows)).to_pylist()}

    rows = [ask(7, [1, 5], [1, 0]), ask(3, [5, 9], [2, 1])]
    assert got(rows) == {(7, (1, 2)), (3, (2, 1))}
    assert got([*rows, ask(7, [2, 5], [4, 1])]) == {(7, (1, 4, 3)), (3, (3, 1))}


def test_requests_are_gone_when_they_are_answered(spark, monkeypatch):
    """No shuffle file outlasts its step, though plans are still referred to; the requests lay beside all later steps before."""
    from pathlib import Path

    from quillspan.llm import store

    dirs = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in dirs for p in d.rglob("shuffle_*")}
    monkeypatch.setattr(store.gc, "collect", lambda: 0)
    begun, left, steps = files(), [], []

    def settled(df, name, **more):
        out = store.settle(df, name, **more)
        until = time.perf_counter() + 10
        while files() - begun and time.perf_counter() < until:
            time.sleep(0.1)
        left.append(files() - begun)
        steps.append(name)
        return out

    monkeypatch.setattr(automaton, "settle", settled)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b c", None, "", "b c d " * 50])], "doc_id long, text string")
    assert automaton.score(docs).count() == 4
    assert not any(left) and steps == ["blocks"] + ["answers"] * automaton.PASSES
    assert spark.conf.get(store.CLEANUP, "false") == "false"


@pytest.mark.parametrize("passes", [1, 3])
def test_passes_do_not_change_scores(spark, monkeypatch, passes):
    docs = spark.createDataFrame(real(), "doc_id long, text string")
    want = sorted(map(tuple, automaton.score(docs).collect()))
    monkeypatch.setattr(automaton, "PASSES", passes)
    assert sorted(map(tuple, automaton.score(docs).collect())) == want
