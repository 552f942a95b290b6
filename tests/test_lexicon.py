from __future__ import annotations

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from quillspan.functions import patterns
from quillspan.functions.arrays import cut, running
from quillspan.operators import lexicon
from quillspan.operators.detect import detect, matches
from quillspan.sources.rules import Rule

TERMS = ["aa", "aa b", "b aa", "a-a", "Aa", "San José", "José Ruiz", "San José Ruiz Díaz", "…", ".b", "b.", "Straße", "ΟΔΟΣ", "x_1", "C++", "++", "aa b aa b c", "b c", "b aa b", "日本", "(a", "\n"]
TEXTS = ["aa b aa b c d", "ñaa aa aaa a-a AA", "en SAN JOSÉ RUIZ DÍAZ y san josé ruiz", None, "", "a.b.b. .b b.", "STRASSE straße STRAẞE οδός", "x_1 x_1_ C++ c+++ ++", "日本 日本人 𝔘日本", "(a) (aa b)\n\naa\tb aa  b", "… …aa b aa b aa b aa b c"]


def alternation(terms, fold):
    return patterns.java(patterns.gazetteer(terms), fold=fold)


@pytest.mark.parametrize("fold", [True, False])
@pytest.mark.parametrize("room", [lexicon.BROADCAST_BYTES, 0])
def test_same_spans_as_the_alternation(spark, monkeypatch, fold, room):
    monkeypatch.setattr(lexicon, "BROADCAST_BYTES", room)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["aa", "b", "c", " ", " ", ".", "San José", "Ruiz", "Díaz", "++", "\n"]) for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")  # ids repeat
    terms = spark.createDataFrame([(t,) for t in [*TERMS, "aa", ""]] + [(None,)], "term string")
    rule = Rule("x:r", "gazetteer", "NAME", alternation(TERMS, fold))
    want = sorted((r["doc_id"], r["start"], r["end"]) for r in detect(docs, [rule], backend="fallback").collect())
    found = lexicon.find_terms(docs, terms, case_sensitive=not fold)
    got = found.collect()
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in got) == want and len(want) > 300
    if not fold:
        assert all(r["hit"] == r["term"] for r in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (room > 0)


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    terms = sorted({" ".join(word() for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(110_000)})
    assert len(terms) > 90_000
    texts = [" ".join(word() for _ in range(200)) for _ in range(50)] + [" ".join(rng.sample(terms, 40)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["end"]) for r in lexicon.detect_terms(docs, spark.createDataFrame([(t,) for t in terms], "term string"), "x:big", "NAME").collect())
    known, want = set(terms), []
    for d, text in enumerate(texts):
        words = [(m.start(), m.end()) for m in regex.finditer(r"\w+", text)]
        i = 0
        while i < len(words):
            n = next((n for n in (3, 2, 1) if i + n <= len(words) and text[words[i][0] : words[i + n - 1][1]] in known), 0)
            # at one place the longest in characters is the one of most words
            if n:
                want.append((d, words[i][0], words[i + n - 1][1]))
            i += n or 1
    assert got == sorted(want)


def test_large_rules_become_joins(spark, monkeypatch):
    """A rule of many terms gives what it would give as a pattern, beside the other rules."""
    from quillspan.sources import rules

    spec = lambda **more: {"version": 1, "lang": "es", "rules": [{"rule_id": "t", "layer": "gazetteer", "phi_type": "NAME", "terms": [t for t in TERMS if t.strip()], **more}, {"rule_id": "p", "layer": "regex_checksum", "phi_type": "ID", "pattern": "b+"}]}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for more in ({}, {"case_sensitive": True}, {"case_sensitive": True, "flags": ["ignorecase"]}):
        small = sorted(map(tuple, detect(docs, rules.parse_rules(spec(**more), "es").rules).collect()), key=repr)
        monkeypatch.setattr(lexicon, "MOST_ALTERNATION", 3)
        large = rules.parse_rules(spec(**more), "es").rules
        assert large[0].terms and not large[0].pattern
        assert sorted(map(tuple, detect(docs, large).collect()), key=repr) == small
        assert {tuple(r) for r in detect(docs, large[:1]).collect()} == {x for x in map(tuple, small) if tuple(x)[6] == "es:t"}
        monkeypatch.undo()


def test_no_terms_no_texts(spark):
    docs = spark.createDataFrame([(1, "aa")], "doc_id long, text string")
    terms = spark.createDataFrame([("aa",)], "term string")
    assert lexicon.find_terms(docs, terms.limit(0)).count() == lexicon.find_terms(docs.limit(0), terms).count() == 0


def test_running_sums_and_cuts(spark):
    rng = random.Random(6)
    rows = []
    for n in (0, 1, 2, 3, 4, 5, 16, 17, 100, 1000):
        text = "".join(rng.choice("aé日𝔘 \n") for _ in range(3 * n + 5))
        edges = sorted(rng.randint(0, len(text)) for _ in range(2 * n))
        rows.append((n, [rng.randint(0, 9) for _ in range(n)], text, edges[::2], edges[1::2]))
    frame = spark.createDataFrame(rows, "n int, v array<int>, text string, s array<int>, e array<int>")
    got = frame.select("n", running(F.col("v")).alias("sums"), cut(F.col("text"), F.col("s"), F.col("e")).alias("parts")).collect()
    for r, (n, v, text, s, e) in zip(sorted(got), rows, strict=True):
        assert r["sums"] == [sum(v[: i + 1]) for i in range(n)]
        assert r["parts"] == [text[a:b] for a, b in zip(s, e, strict=True)]


def test_time_grows_with_the_matches(spark):
    """16,000 matches in one text took a minute when each one copied the array before it."""
    text = "ab 12é " * 16_000
    frame = spark.createDataFrame([(text,)], "text string").select(matches(F.col("text"), "[0-9]+").alias("m"))
    frame.collect()
    began = time.perf_counter()
    found = frame.collect()[0]["m"]
    assert time.perf_counter() - began < 10  # on a busy machine; about half a second alone
    assert [(m["start"], m["end"], m["hit"]) for m in found] == [(7 * i + 3, 7 * i + 5, "12") for i in range(16_000)]


def test_rows_move_once_to_their_text(spark):
    """Matches moved three times, through windows and lists by chain, and that took most of the time at size."""
    docs = spark.createDataFrame([(1, "aa b aa"), (2, "B aa")], "doc_id long, text string")
    found = lexicon.find_terms(docs, spark.createDataFrame([("aa",), ("b aa",)], "term string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "row_number" not in plan and plan.count("RepartitionByExpression") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2, "aa", "aa"), (1, 3, 7, "b aa", "b aa"), (2, 0, 4, "B aa", "b aa")]


def test_sequences_do_not_cross_texts(monkeypatch):
    import pyarrow as pa

    known = pa.table({"first": ["a", "a", "ñ"], "n": pa.array([1, 3, 1], pa.int32()), "plain": ["a", "a b", "ñ"]})
    texts = [["A", " ", "b"], [], ["a"], [" ", "b", "a", " "], ["b", "Ñ", "a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(list("vwxyz")), pa.array(texts, pa.list_(pa.string()))], names=["row", "doc_id", "t"])
    want = [(0, 0, "A"), (0, 0, "A b"), (2, 0, "a"), (3, 2, "a"), (4, 1, "Ñ"), (4, 2, "a")]
    for stretch in (1, 4, 100):
        monkeypatch.setattr(lexicon, "STRETCH", stretch)
        for part in (batch, batch.slice(2)):
            rows = [r for b in lexicon._sequences(known, False)(iter([part])) for r in b.to_pylist()]
            assert sorted((r["row"], r["start"], r["hit"]) for r in rows) == [w for w in want if w[0] >= 5 - part.num_rows]
            assert all(r["plain"] == (r["hit"].lower() if r["hit"].isascii() else None) for r in rows)
