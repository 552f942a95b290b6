from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.model import SpanError
from quillspan.operators import flags, intervals, masking, sampling, screen

TEXT = "Ana vive aquí.\nTel 555 Ana\n\nfin 😀 x\n"
SPANS = [("a", 0, 3, "NAME"), ("a", 19, 22, "CONTACT"), ("a", 20, 26, "NAME"), ("a", 8, 10, "DATE")]
LINES = masking.LINES


def masked(spark):
    docs = spark.createDataFrame([("a", TEXT), ("b", "no spans"), ("c", "")], "doc_id string, text string")
    return docs, masking.mask_documents(docs, spark.createDataFrame(SPANS, "doc_id string, start int, end int, phi_type string"))


def test_masked_text(spark):
    _, m = masked(spark)
    got = {r["doc_id"]: r["masked_text"] for r in m.collect()}
    assert got == {"a": "[NAME] vive[DATE]quí.\nTel [PHI]\n\nfin 😀 x\n".replace("vive[DATE]quí", "vive[DATE]quí"), "b": "no spans", "c": ""}


def test_geometry_leads_back(spark):
    _, m = masked(spark)
    text = m.where("doc_id = 'a'").first()["masked_text"]
    lines = masking.masked_lines(m).where("doc_id = 'a'").first()["lines"]
    assert [x["length"] for x in lines] == [len(x) for x in text.split("\n")]
    for row, line in zip(lines, text.split("\n"), strict=True):
        at = row["doc_offset"]
        col = 0
        for tag in row["tags"]:
            assert line[col : tag["col"]] == TEXT[at : tag["doc_start"]]
            col, at = tag["col"] + tag["len"], tag["doc_end"]
        assert line[col:] == TEXT[at : at + len(line) - col]
    assert lines[-1]["doc_offset"] == len(TEXT)


def test_context_window(spark):
    docs, _ = masked(spark)
    spans = spark.createDataFrame([("a", 15, 18)], "doc_id string, start int, end int")
    r = masking.context_windows(spans, docs, 5).first()
    assert (r["window"], r["at"], r["to"]) == (TEXT[10:23].replace("\n", " "), 5, 8)


def flag(**more):
    return {"line": 0, "start": 0, "end": 4, "phi_type": "NAME", **more}


@pytest.mark.parametrize(
    ("given", "reason"),
    [
        (flag(), None),
        (flag(score=0.5), None),
        (flag(line=9), "out_of_range"),
        (flag(line=-1), "out_of_range"),
        (flag(start=-1), "out_of_range"),
        (flag(end=99), "crosses_a_line"),
        (flag(start=4), "crosses_a_line"),
        (flag(phi_type="OTHER"), "undeclared_phi_type"),
        (flag(phi_type="nope"), "undeclared_phi_type"),
        (flag(start=4, end=6), "inside_a_mask_tag"),
        (flag(start=1, end=5), None),
        (flag(line=True), "malformed"),
        (flag(line="0"), "malformed"),
        (flag(start=0.5), "malformed"),
        (flag(phi_type=3), "malformed"),
        (flag(score=2), "malformed"),
        (flag(score=True), "malformed"),
        (flag(score="0.5"), "malformed"),
        (flag(more=1), "malformed"),
        ({"line": 0}, "malformed"),
        (7, "malformed"),
    ],
)
def test_flags(spark, given, reason):
    lines = spark.createDataFrame([("a", [(20, 100, [(5, 6, 105, 120)])])], f"doc_id string, lines {LINES}")
    answer = spark.createDataFrame([("a", json.dumps({"flags": [given]}))], "doc_id string, response string")
    r = flags.validate(answer, lines).collect()
    assert [x["reason"] for x in r] == [reason]
    if reason is None:
        assert (r[0]["start"], r[0]["end"], r[0]["score"]) == (100 + given["start"], 100 + given["end"], given.get("score", 1.0))


@pytest.mark.parametrize("text", ["", "[]", "no", '{"flags": {}}', '{"flags": [], "x": 1}', '{"flags": "x"}', None])
def test_payload_as_a_whole(spark, text):
    lines = spark.createDataFrame([("a", [(20, 100, [])])], f"doc_id string, lines {LINES}")
    got = flags.validate(spark.createDataFrame([("a", text)], "doc_id string, response string"), lines).collect()
    assert [x["reason"] for x in got] == ["malformed"]


def test_columns_behind_a_tag(spark):
    lines = spark.createDataFrame([("a", [(20, 100, [(5, 6, 105, 120)])])], f"doc_id string, lines {LINES}")
    answer = spark.createDataFrame([("a", json.dumps({"flags": [flag(start=11, end=13)]}))], "doc_id string, response string")
    r = flags.validate(answer, lines).first()
    assert (r["start"], r["end"]) == (120, 122)


ERRORS = "doc_id string, span_index int, phi_type string, kind string, start int, end int"


def pool():
    rows = []
    for doc, kind, n in (("d1", "NAME", 60), ("d2", "DATE", 30), ("d3", "ID", 8), ("d4", "PROFESSION", 1), ("d5", "OTHER", 9)):
        rows += [(doc, i, kind, "missed", 10 * i, 10 * i + 6) for i in range(n)]
    return rows


def test_allocation():
    counts = {"NAME": 60, "DATE": 30, "ID": 8, "PROFESSION": 1}
    got = sampling.allocate(counts, 40)
    assert sum(got.values()) == 40 and got["PROFESSION"] == 1 and all(got[t] <= counts[t] for t in got)
    assert sampling.allocate(counts, 3) == {"NAME": 1, "DATE": 1, "ID": 1}
    assert sampling.allocate(counts, 1000) == counts
    assert sampling.allocate({}, 5) == {}


@pytest.mark.parametrize("draw", [sampling.draw_hash, sampling.draw_compat])
def test_draws_ignore_order_and_repeats(spark, draw):
    rows = pool()
    random.Random(1).shuffle(rows)
    a = sorted(map(tuple, draw(spark.createDataFrame(rows, ERRORS), "es-carmen", 3).collect()))
    b = sorted(map(tuple, draw(spark.createDataFrame(pool() * 2, ERRORS).repartition(7), "es-carmen", 3).collect()))
    assert a == b and len(a) == 40 and not [x for x in a if x[2] == "OTHER"]
    other = sorted(map(tuple, draw(spark.createDataFrame(rows, ERRORS), "es-carmen", 4).collect()))
    assert a != other


@pytest.mark.parametrize("stretches", [1, 3, 400])
def test_compat_draw_is_that_of_one_sorted_list(spark, stretches):
    """By brute force: each type's errors sorted, and one generator's sample of them; ties and missing numbers included."""
    rng = random.Random(2)
    rows = list({(f"d{rng.randint(0, 30)}é"[: rng.randint(2, 4)], rng.choice([None, *range(3)]), t, "missed", s := rng.randint(0, 40), s + rng.randint(1, 4)) for t in ("NAME", "DATE", "ID") for _ in range(300)})
    rows += [("x", 1, "AGE", "spurious", 3, 4), ("x", 1, "OTHER", "missed", 3, 4)]
    for n in (40, 7, 2, 5000, 0):
        by: dict = {}
        for r in rows:
            if r[2] != "OTHER":
                by.setdefault(r[2], []).append(r)
        want, seed = [], sampling.sample_seed("es-carmen", 5)
        for t, q in sampling.allocate({t: len(v) for t, v in by.items()}, n).items():
            own = sorted(by[t], key=lambda r: (r[0], r[4], r[5], r[2], r[3], r[1] is None, r[1] or 0))
            want += random.Random(sampling._first_eight(f"{seed}\0{t}")).sample(own, min(q, len(own)))
        got = sampling.draw_compat(spark.createDataFrame(rows, ERRORS), "es-carmen", 5, n, stretches=stretches)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = sampling.draw_compat(spark.createDataFrame(rows[:0], ERRORS), "es-carmen", 5)
    assert plan.count() == 0


def test_stretches_are_found_by_halving(spark):
    """Every row looked through all bounds before."""
    import bisect

    for n in (0, 1, 2, 7, 8, 100):
        bounds = sorted((random.Random(n).randint(0, 50), i) for i in range(n))
        keys = [(k, i) for k in range(-1, 52) for i in (0, n // 2, n)]
        frame = spark.createDataFrame([(bounds[: n - m], list(k)) for k in keys for m in (0, n // 3)], "b array<struct<x:int,y:int>>, k array<int>")
        got = frame.select("b", "k", sampling._rank(F.col("b"), F.struct(F.get("k", F.lit(0)).alias("x"), F.get("k", F.lit(1)).alias("y")), n).alias("n")).collect()
        assert all(r["n"] == bisect.bisect_right([tuple(x) for x in r["b"]], tuple(r["k"])) for r in got)


def test_split_unions_do_not_hang_on_the_order_of_equal_spans(spark, monkeypatch):
    """Of equal spans one opens a chain; when a join had dealt them anew another could come first, and fell into the chain before."""
    rows = [("a", i, s, s + 3, kind) for i, (s, kind) in enumerate((s, k) for s in range(0, 200, 5) for k in ("NAME", "ID", "DATE") for _ in range(3))]
    rows += [("a", 1000 + i, 7, 7, "ID") for i in range(3)]
    spans = spark.createDataFrame(rows, "doc_id string, span_index int, start int, end int, phi_type string")
    want = sorted(map(tuple, intervals.mask_union(spans).collect()))
    dealt = intervals._with_carried
    for seed in range(3):
        monkeypatch.setattr(intervals, "_with_carried", lambda *a: dealt(*a).orderBy(F.rand(seed)))  # noqa: B023
        assert sorted(map(tuple, intervals.mask_union(spans, width=16).collect())) == want


def test_split_documents_give_the_same_unions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, s := rng.randint(0, 300), s + rng.choice([1, 2, 5, 90]), rng.choice(["NAME", "ID"])) for i in range(150)]
    rows += [("c", i, 10 * i, 10 * i + 10, "NAME") for i in range(40)] + [("d", 0, 0, 1000, "ID"), ("d", 1, 999, 1001, "ID"), ("d", 2, 1001, 1002, "NAME")]
    spans = spark.createDataFrame(rows, "doc_id string, span_index int, start int, end int, phi_type string")
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    for width in (1, 7, 64, 1 << 16):
        for touching in (True, False):
            assert same(intervals.interval_union(spans, touching=touching), intervals.interval_union(spans, touching=touching, width=width))
        assert same(intervals.mask_union(spans), intervals.mask_union(spans, width=width))
        want = Counter(x[0] for k, x in enumerate(rows) for y in rows[:k] if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
        assert {r["doc_id"]: r["pairs"] for r in intervals.overlapping_pairs(spans, width).collect()} == want
    joins = intervals.overlapping_pairs(spans)._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count("Join") == 1  # with a row a bucket


def test_seeds():
    assert sampling.sample_seed("es-carmen", 12) != sampling.sample_seed("es-carmen", 1)
    for bad in (("nowhere", 1), ("es-carmen", 0), ("es-carmen", True)):
        with pytest.raises(SpanError):
            sampling.sample_seed(*bad)
    with pytest.raises(SpanError):
        sampling.check_iteration(900, False)


def test_screen(spark):
    files = [
        ("data/x.txt", "", True, "blocked"),
        ("data/README.md", "", True, "allowed"),
        ("sealed/a", "", False, "sealed"),
        ("sealed/a2", "", True, "blocked"),
        ("data/y", "", False, "quarantined"),
        ("docs/a.md", "Chief complaint: x", True, "suspect"),
        ("docs/b.md", "[**x**]" * 5, True, "suspect"),
        ("docs/c.md", "[**x**]" * 4, True, "allowed"),
        ("run/errors.jsonl", "", True, "blocked"),
    ]
    got = {r["path"]: r["class"] for r in screen.screen_files(spark.createDataFrame([f[:3] for f in files], "path string, content string, visible boolean")).collect()}
    assert got == {f[0]: f[3] for f in files}


def test_screen_of_names_code_and_lists(spark):
    words = ("email", "pattern", "cue", "dni")
    ids = ["email_pattern", "es:dni_cue_2", "garcia_cue", "nacido_cue", "de:nacido_cue", "EmailCue", "", "cue_1999", "cue_añ", "email_" * 7 + "cue", "cue_a_b_c_d_e"]
    names = spark.createDataFrame([(i, "es") for i in ids], "rule_id string, lang string")
    got = {r["rule_id"]: r["reason"] for r in screen.strange_names(names, words, {"es": ("nacido",)}).collect()}
    assert got == {"garcia_cue": "unknown_word", "de:nacido_cue": "unknown_word", "EmailCue": "capital", "": "empty", "cue_1999": "number", "cue_añ": "not_ascii", "email_" * 7 + "cue": "long", "cue_a_b_c_d_e": "many_parts"}
    files = [
        ("results/a/b/c/d/metrics.json", "{}", True),
        ("tool.py", '"""Chief complaint"""\nx = 1  # history of present\n', True),
        ("tool2.py", 'x = "Chief complaint"\n', True),
        ("rules/es.yaml", "rules:\n  - rule_id: garcia_cue\n", True),
        ("rules/ca.yaml", "rules:\n  - rule_id: 'email_cue'\n", True),
        ("local.md", "Chief complaint", False),
    ]
    table = spark.createDataFrame(files, "path string, content string, visible boolean")
    screened = screen.screen_files(table, words=words)
    got = {r["path"]: (r["class"], r["reason"], r["listed"]) for r in screened.collect()}
    assert got["results/a/b/c/d/metrics.json"] == ("allowed", None, True)
    assert got["tool.py"] == ("allowed", None, False) and got["tool2.py"][0] == "suspect"
    assert got["rules/es.yaml"][:2] == ("suspect", "rule_id shape") and got["rules/ca.yaml"][0] == "allowed"
    why = "a reason of five words"
    allow = spark.createDataFrame([("tool2.py", "clinical", why), ("rules/es.yaml", "clinical", why), ("gone.md", "clinical", why)], "path string, sniff string, why string")
    parts = {r["path"]: r["part"] for r in screen.partition_suspect(screened, allow, table).collect()}
    assert parts == {"tool2.py": "known", "rules/es.yaml": "unexpected", "local.md": "unpublishable", "gone.md": "stale"}
    bad = [("*.md", "x", why), ("data/a", "x", why), ("sealed/a", "x", why), ("run/errors.jsonl", "x", why), ("a.md", "", why), ("a.md", "x", "too short"), (None, "x", why), ("d/", "x", why)]
    faults = screen.check_allowlist(spark.createDataFrame(bad, "path string, sniff string, why string")).collect()
    assert [r["fault"] for r in faults] == ["pattern", "sealed or data", "sealed or data", "denied", "no sniff", "no reason", "no path", "pattern"]
    with pytest.raises(Exception, match="allowlist"):
        screen.partition_suspect(screened, spark.createDataFrame(bad[:1], "path string, sniff string, why string"), table).collect()


def test_history(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "x.txt").write_text("x")
    (tmp_path / "kept.md").write_text("y")
    git("add", ".")
    git("commit", "-qm", "one")
    git("rm", "-q", "data/x.txt")
    git("commit", "-qm", "two")
    assert [r["path"] for r in screen.screen_history(screen.history(spark, str(tmp_path))).collect()] == ["data/x.txt"]


def test_tag_maps_are_refused_and_flags_sorted(spark):
    fine = [(0, 6, 0, 5), (8, 6, 7, 20)]
    cases = {"fine": (20, 0, fine), "none": (3, 0, []), "reversed": (20, 0, fine[::-1]), "overlap": (20, 0, [(0, 6, 0, 5), (5, 3, 7, 9)]), "long": (10, 0, fine), "empty": (20, 0, [(0, 6, 5, 5)]), "flat": (20, 0, [(0, 0, 0, 5)]), "early": (20, -1, fine)}
    schema = "k string, line struct<length:int,doc_offset:int,tags:array<struct<col:int,len:int,doc_start:int,doc_end:int>>>"
    for name, line in cases.items():
        row = spark.createDataFrame([(name, line)], schema).select(flags.checked_line(F.col("line")).alias("x"))
        if name in ("fine", "none"):
            assert row.first()["x"]["length"] == line[0]
        else:
            with pytest.raises(Exception, match="tags"):
                row.collect()
    rows = [("b", 1, 2, "ID"), ("a", 5, 6, "ID"), ("a", 1, 9, "ID"), ("a", 1, 9, "DATE")]
    got = flags.sort_flags(spark.createDataFrame(rows, "doc_id string, start int, end int, phi_type string")).collect()
    assert [tuple(r) for r in got] == sorted(rows)
