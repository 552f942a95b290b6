"""Golden geometries with hand-computed totals, random ones against a brute force, and order independence."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspan.model import LAYERS, MODES, SpanError
from quillspan.operators import intervals, scoring

GOLD = "doc_id string, span_index int, start int, end int, phi_type string, excluded boolean"
PRED = "doc_id string, span_index int, start int, end int, phi_type string, layer string, rule_id string"

CASES = {
    "d1": ([("NAME", 0, 4), ("NAME", 5, 10)], [("NAME", 0, 10, "tagger")]),
    "d2": ([("NAME", 0, 10)], [("NAME", 0, 4, "context_cue"), ("NAME", 4, 10, "tagger")]),
    "d3": ([("DATE", 100, 110), ("ID", 200, 210)], [("DATE", 105, 115, "regex_checksum"), ("ID", 195, 205, "regex_checksum")]),
    "d4": ([("NAME", 0, 5), ("NAME", 10, 15), ("NAME", 20, 25)], [("NAME", 0, 5, "context_cue"), ("NAME", 10, 15, "context_cue"), ("NAME", 10, 15, "tagger"), ("NAME", 20, 25, "tagger")]),
    "d5": ([("NAME", 0, 5)], [("LOCATION_AREA", 0, 5, "gazetteer")]),
    "d6": ([], [("NAME", 0, 5, "tagger"), ("AGE", 10, 12, "context_cue")]),
    "d7": ([("PROFESSION", 0, 5)], []),
    "d8": ([], []),
}


def frames(spark, cases):
    gold = [(d, i, s, e, t, False) for d, (g, _) in cases.items() for i, (t, s, e) in enumerate(g)]
    pred = [(d, i, s, e, t, layer, None if layer == "tagger" else f"es:{layer}") for d, (_, p) in cases.items() for i, (t, s, e, layer) in enumerate(p)]
    return spark.createDataFrame([(d,) for d in cases], "doc_id string"), spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED)


def test_golden_totals(spark):
    docs, gold, pred = frames(spark, CASES)
    record = scoring.score(docs, gold, pred)
    full, loose = record["modes"]["fully_covered"], record["modes"]["relaxed"]
    assert (full["leak"]["leaked"], full["leak"]["gold"]) == (4, 10)
    assert (loose["leak"]["leaked"], loose["leak"]["gold"]) == (2, 10)
    assert tuple(full["micro"].values()) == (4, 7, 6, pytest.approx(4 / 11), pytest.approx(0.4), pytest.approx(8 / 21))
    assert tuple(loose["micro"].values()) == (7, 4, 3, pytest.approx(7 / 11), pytest.approx(0.7), pytest.approx(14 / 21))
    assert (full["assignment_slack"], loose["assignment_slack"]) == (2, 1)
    assert (full["by_document"]["docs_with_leak"], full["by_document"]["docs_with_gold"]) == (3, 6)
    assert loose["by_document"]["docs_with_leak"] == 2
    assert full["duplicates"] == 1
    assert record["counts"] == {"documents": 8, "with_gold": 6, "without_gold": 2, "in_scope": 10, "excluded": 0, "excluded_share": 0.0, "predictions": 12}
    assert full["families"]["joint_only"] == 1 and "joint_only" not in loose["families"]
    assert record["fp_opportunity"] == {"documents": 2, "predictions": 2}


def test_empty_input(spark):
    docs, gold, pred = frames(spark, {})
    record = scoring.score(docs, gold, pred)
    assert record["headline"]["leak_rate"] is None
    assert record["modes"]["relaxed"]["micro"]["precision"] == 0.0
    assert record["modes"]["relaxed"]["macro"]["leak_rate"] is None


def brute(gold, pred, mode):
    """(covered set, assigned pairs) of one document."""
    covered = set()
    for gi, (t, s, e) in enumerate(gold):
        chars = {c for pt, ps, pe, _ in pred if pt == t for c in range(ps, pe)} & set(range(s, e))
        if len(chars) == e - s if mode == "fully_covered" else chars:
            covered.add(gi)
    first = {}
    for i, (t, s, e, _) in enumerate(pred):
        first.setdefault((t, s, e), i)
    pairs = []
    for gi, (t, s, e) in enumerate(gold):
        for (pt, ps, pe), pi in first.items():
            shared = min(e, pe) - max(s, ps)
            if pt == t and (ps <= s and e <= pe if mode == "fully_covered" else shared > 0):
                pairs.append((-shared, s, e, ps, pe, pi, gi))
    used_g, used_p, out = set(), set(), set()
    for *_, pi, gi in sorted(pairs):
        if gi not in used_g and pi not in used_p:
            used_g.add(gi)
            used_p.add(pi)
            out.add((gi, pi))
    return covered, out


@pytest.fixture(scope="module")
def random_cases():
    rng = random.Random(7)
    types = ("NAME", "DATE", "ID")
    return {
        f"r{k}": (
            [(rng.choice(types), s := rng.randrange(40), s + rng.randint(1, 7)) for _ in range(rng.randint(0, 3))],
            [(rng.choice(types), s := rng.randrange(42), s + rng.randint(1, 8), rng.choice(LAYERS)) for _ in range(rng.randint(0, 4))],
        )
        for k in range(600)
    }


@pytest.mark.parametrize("mode", ["fully_covered", "relaxed"])
def test_random_geometries(spark, random_cases, mode):
    _, gold, pred = frames(spark, random_cases)
    got_cover = {(r["doc_id"], r["span_index"]) for r in scoring.coverage(gold, pred, mode).where("covered").collect()}
    got_pairs = {(r["doc_id"], r["gold_index"], r["pred_index"]) for r in scoring.assign(gold, intervals.dedupe(pred), mode).collect()}
    want_cover, want_pairs = set(), set()
    for d, (g, p) in random_cases.items():
        cover, pairs = brute(g, p, mode)
        want_cover |= {(d, i) for i in cover}
        want_pairs |= {(d, *x) for x in pairs}
    assert got_cover == want_cover
    assert got_pairs == want_pairs
    n = gold.count()
    families = {r["category"]: r["n"] for r in scoring.complementarity_families(gold, pred, mode).collect()}
    assert sum(families.values()) == n and families["neither"] == n - len(want_cover)
    if mode == "relaxed":
        assert "joint_only" not in families
    layers = scoring.complementarity_layers(gold, pred, mode).collect()
    assert sum(r["n"] for r in layers) == n
    rules = scoring.by_rule(gold, pred, mode).collect()
    assert sum(r["fires"] for r in rules) == pred.where("rule_id is not null").count()


def test_shuffled_input_scores_the_same(spark):
    docs, gold, pred = frames(spark, CASES)
    assert scoring.score(docs, gold.orderBy(F.desc("start")), pred.orderBy(F.desc("end"))) == scoring.score(docs, gold, pred)


def test_refusals(spark):
    docs, gold, pred = frames(spark, CASES)
    with pytest.raises(SpanError):
        scoring.refuse_split_rules(pred.withColumn("rule_id", F.lit("es:x")))
    with pytest.raises(Exception, match="no layer"):
        scoring.check_layers(pred.withColumn("layer", F.lit(None).cast("string"))).collect()


def test_touching_merges_for_scores_and_not_for_masks(spark):
    spans = spark.createDataFrame([("a", 0, 0, 4, "NAME"), ("a", 1, 4, 8, "NAME"), ("a", 2, 6, 9, "DATE")], "doc_id string, span_index int, start int, end int, phi_type string")
    assert {(r["phi_type"], r["start"], r["end"]) for r in intervals.interval_union(spans).collect()} == {("NAME", 0, 8), ("DATE", 6, 9)}
    assert {(r["start"], r["end"], r["tag"]) for r in intervals.mask_union(spans).collect()} == {(0, 4, "[NAME]"), (4, 9, "[PHI]")}


@pytest.mark.parametrize("query", [scoring.headline, scoring.prf_overall, scoring.leak_rate, scoring.error_spans])
def test_chains_are_built_once(spark, query):
    _, gold, pred = frames(spark, CASES)
    count = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert 0 < count(query(gold, pred)) == count(scoring.chains(gold, pred))


@pytest.mark.parametrize("mode", MODES)
def test_rounds_give_the_greedy_assignment(spark, mode):
    rng = random.Random(5)
    dense = lambda n, most: [(f"d{rng.randrange(3)}", i, s := rng.randrange(60), s + 1 + rng.randrange(most), rng.choice(("NAME", "ID"))) for i in range(n)]
    plain = "doc_id string, span_index int, start int, end int, phi_type string"
    gold = spark.createDataFrame(dense(60, 9), plain)
    pred = intervals.dedupe(spark.createDataFrame(dense(90, 30), plain).withColumn("layer", F.lit("tagger")).withColumn("rule_id", F.lit(None).cast("string")))
    want = sorted(map(tuple, scoring.assign(gold, pred, mode).collect()))
    assert want
    for width in (4, 1000):
        assert sorted(map(tuple, scoring.assign_in_rounds(gold, pred, mode, width).collect())) == want
    # spans that each prefer the next one's partner are settled from one end, a pair a round
    chain = [("c", i, 10 * i, 10 * i + 9 + i, "NAME") for i in range(6)]
    gold, pred = spark.createDataFrame(chain, plain), spark.createDataFrame([("c", i, 10 * i + 5, 10 * i + 12 + i, "NAME") for i in range(6)], plain)
    pred = pred.withColumn("layer", F.lit("tagger")).withColumn("rule_id", F.lit(None).cast("string"))
    assert sorted(map(tuple, scoring.assign_in_rounds(gold, pred, mode).collect())) == sorted(map(tuple, scoring.assign(gold, pred, mode).collect()))
    assert scoring.assign_in_rounds(gold.limit(0), pred, mode).count() == 0
