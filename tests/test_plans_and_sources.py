from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspan import model
from quillspan.model import SpanError
from quillspan.plans import rounds, splits
from quillspan.sources import brat, records
from quillspan.sources.rules import parse_rules
from quillspan.streaming import flows

RULES = parse_rules({"version": 1, "lang": "es", "rules": [{"rule_id": "n", "layer": "regex_checksum", "phi_type": "ID", "pattern": r"\d+"}]}, "es")


@pytest.fixture
def corpus(tmp_path):
    for name, text, ann in (
        ("p-1", "Ana, 44\n", "T1\tNOMBRE_SUJETO_ASISTENCIA 0 3\tAna\nT2\tEDAD_SUJETO_ASISTENCIA 5 7\t44\n"),
        ("p-2", "﻿Ana y Eva", "T1\tNOMBRE_SUJETO_ASISTENCIA 1 4\tAna\nT2\tSEXO_SUJETO_ASISTENCIA 7 10\tEva\n"),
        ("q", "nada", ""),
    ):
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
        (tmp_path / f"{name}.ann").write_text(ann, encoding="utf-8")
    return tmp_path


def test_brat(spark, corpus):
    docs, gold = brat.read_brat(spark, str(corpus), "es-meddocan", "dev")
    brat.load_corpus(docs, gold)
    assert {r["doc_id"]: r["had_bom"] for r in docs.collect()} == {"p-1": False, "p-2": True, "q": False}
    rows = {(r["doc_id"], r["start"], r["end"], r["phi_type"], r["excluded"]) for r in gold.collect()}
    assert rows == {("p-1", 0, 3, "NAME", False), ("p-1", 5, 7, "AGE", False), ("p-2", 0, 3, "NAME", False), ("p-2", 6, 9, None, True)}
    found, record = rounds.run_fold(docs, gold, RULES)
    assert record["counts"]["excluded"] == 1 and record["modes"]["fully_covered"]["leak"]["leaked"] == 3
    audit = splits.grouping_audit(docs, gold, splits.GROUPING["es-meddocan"]).collect()
    assert [(r["stem"], r["n_docs"], r["shared_name"], r["grouped"]) for r in audit] == [("p", 2, True, False)]


@pytest.mark.parametrize("line", ["R1\tx", "T1\tA 0 3;5 6\tx", "T1\tA x 3\ty", "T1\tA 3 3\ty", "T1\tUNKNOWN 0 3\tAna", "T1\tA 0 3"])
def test_bad_annotations(spark, corpus, line):
    (corpus / "q.ann").write_text(line + "\n")
    with pytest.raises(Exception):  # noqa: B017 - Spark wraps the refusal
        brat.read_brat(spark, str(corpus), "es-meddocan", "dev")[1].collect()


def test_unpaired_and_wrong_offsets(spark, corpus):
    (corpus / "q.ann").write_text("T1\tPAIS 0 3\tnad!\n")
    with pytest.raises(SpanError):
        brat.load_corpus(*brat.read_brat(spark, str(corpus), "es-meddocan", "dev"))
    (corpus / "q.txt").unlink()
    with pytest.raises(SpanError, match="no partner"):
        brat.read_brat(spark, str(corpus), "es-meddocan", "dev")[0].collect()


def test_folds(spark):
    docs = spark.createDataFrame([("a", None), ("b", "dev")], "doc_id string, split string")
    good = spark.createDataFrame([("a", "train"), ("b", "dev")], "doc_id string, split string")
    assert dict(map(tuple, brat.apply_split(docs, good).collect())) == {"a": "train", "b": "dev"}
    for rows in ([("a", "train")], [("a", "train"), ("b", "dev"), ("c", "dev")], [("a", "train"), ("b", "train")]):
        with pytest.raises(Exception):  # noqa: B017
            brat.apply_split(docs, spark.createDataFrame(rows, "doc_id string, split string")).collect()
    with pytest.raises(SpanError):
        brat.load_fold(docs, "test")
    with pytest.raises(SpanError):
        brat.load_fold(docs, "train")
    assert brat.fold_roots("/x", {"dev": "d", "test": "t"}) == {"dev": "/x/d"}
    faults = splits.verify(docs.na.fill("dev"), spark.createDataFrame([("a", "train"), ("c", "dev")], "doc_id string, split string"))
    assert dict(map(tuple, faults.collect())) == {"a": "moved", "b": "extra", "c": "missing"}


def test_cas(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"sofaString": "Frau Ey", "spans": [{"begin": 5, "end": 7, "kind": "NAME_PATIENT"}]}))
    docs, gold = brat.read_cas(spark, str(tmp_path), "de-grascco", "dev", {"NAME_PATIENT": "NAME"})
    assert gold.first()["surface"] == "Ey" and docs.first()["text"] == "Frau Ey"


def cas(text, *spans, more=()):
    sofa = {"%ID": 1, "%TYPE": "uima.cas.Sofa", "sofaNum": 1, "sofaID": "_InitialView", "mimeType": "text", "sofaString": text}
    token = {"%ID": 90, "%TYPE": "de.tudarmstadt.ukp.dkpro.core.api.segmentation.type.Token", "@sofa": 1, "begin": 0, "end": 2}
    phi = [{"%ID": 10 + i, "%TYPE": "webanno.custom.PHI", "@sofa": sofa, "begin": b, "end": e, "kind": k} for i, (b, e, k, sofa) in enumerate(spans)]
    return json.dumps({"%TYPES": {"webanno.custom.PHI": {"%NAME": "webanno.custom.PHI", "%SUPER_TYPE": "uima.tcas.Annotation"}}, "%FEATURE_STRUCTURES": [token, *phi[:1], sofa, *phi[1:], *more], "%VIEWS": {"_InitialView": {"%SOFA": 1}}}, ensure_ascii=False)


def test_cas_feature_structures(spark, tmp_path):
    """Sofas by their ids, wherever they stand; a first span that holds the byte-order mark; other layers left alone."""
    second = {"%ID": 7, "%TYPE": "uima.cas.Sofa", "sofaID": "other", "sofaString": "Dr. Ey"}
    (tmp_path / "a.txtphi-pii_2.0.json").write_text(cas("\ufeffARCOS Klinik, Beate 𝔘lm", (0, 13, "ORG", 1), (15, 20, "NAME", 1), (21, 24, "NAME", 1)), encoding="utf-8")
    (tmp_path / "b.json").write_text(cas("Klinik", (0, 6, "ORG", 1), (4, 6, "NAME", 7), more=[second]), encoding="utf-8")
    (tmp_path / "c.json").write_text(cas("leer"), encoding="utf-8")
    docs, gold = brat.read_cas(spark, str(tmp_path), "de-grascco", "dev", {"NAME": "NAME", "ORG": "ORGANISATION"})
    brat.load_corpus(docs, gold)
    assert {(r["doc_id"], r["text"], r["had_bom"]) for r in docs.collect()} == {("a", "ARCOS Klinik, Beate 𝔘lm", True), ("b", "Klinik", False), ("b/other", "Dr. Ey", False), ("c", "leer", False)}
    rows = {(r["doc_id"], r["span_index"], r["start"], r["end"], r["surface"], r["phi_type"]) for r in gold.collect()}
    assert rows == {("a", 0, 0, 12, "ARCOS Klinik", "ORGANISATION"), ("a", 1, 14, 19, "Beate", "NAME"), ("a", 2, 20, 23, "𝔘lm", "NAME"), ("b", 0, 0, 6, "Klinik", "ORGANISATION"), ("b/other", 0, 4, 6, "Ey", "NAME")}
    for bad in (cas("x", (0, 1, "NAME", 5)), cas("x", (0, 1, "NAME", None)), cas("x", (0, 1, "UNKNOWN", 1)), "{no json"):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad/x.json").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017 - Spark wraps the refusal
            brat.read_cas(spark, str(tmp_path / "bad"), "de-grascco", "dev", {"NAME": "NAME"})[1].collect()


def test_records_round_trip(spark, tmp_path):
    pred = spark.createDataFrame([("b", 1, 2, "ID", "tagger", "T", None, None), ("a", 5, 9, "ID", "gazetteer", "R", "es:x", 0.5)], "doc_id string, start int, end int, phi_type string, layer string, detector string, rule_id string, score double")
    records.write_spans(pred, str(tmp_path / "s"))
    first = [json.loads(x) for p in (tmp_path / "s").glob("part-*") for x in p.read_text().splitlines()]
    assert [list(r) for r in first] == [list(model.SPAN_FIELDS)] * 2 and first[0]["doc_id"] == "a"
    assert records.read_spans(spark, str(tmp_path / "s")).drop("agent_actions").exceptAll(pred).isEmpty()
    for change in ({"extra": 1}, {"start": True}, {"layer": None}, {"start": "1"}):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad/x.json").write_text(json.dumps(first[0] | change) + "\n")
        with pytest.raises(Exception):  # noqa: B017
            records.read_spans(spark, str(tmp_path / "bad")).collect()


def test_stopping():
    assert rounds.delta(5254) == 0.005 and rounds.delta(1000) == 0.026
    stop = lambda *r: rounds.should_stop(r, 5200).reason
    assert stop(0.5) is None and stop(0.5, 0.498, 0.497) == "converged"
    assert stop(0.5, 0.495, 0.493) is None  # exactly delta is not below it
    assert stop(*(1 - i / 10 for i in range(8))) == "ceiling"
    with pytest.raises(SpanError):
        stop(*range(9))
    block = {"llm_calls": 1, "prompt_tokens": 2, "completion_tokens": 3, "wall_seconds": 0.1}
    assert rounds.sum_costs([block] * 3) == {"llm_calls": 3, "completion_tokens": 9, "prompt_tokens": 6, "wall_seconds": 0.3}
    with pytest.raises(SpanError):
        rounds.sum_costs([block | {"x": 1}])
    assert rounds.sum_caching([None]) is None


def test_rounds_with_stub_author(spark):
    docs = spark.createDataFrame([("a", "12 Ana"), ("b", "7 Eva")], "doc_id string, text string")
    gold = spark.createDataFrame([("a", 0, 0, 2, "ID", False), ("b", 0, 2, 5, "NAME", False)], "doc_id string, span_index int, start int, end int, phi_type string, excluded boolean")
    answer = lambda masked: masked.select("doc_id", F.lit('{"flags": []}').alias("response"))
    found, verdict = rounds.run_rounds(docs, gold, lambda n, sample, judged: RULES, answer, "es-meddocan")
    assert verdict.reason == "converged" and len(found) == 3


def test_percentiles_take_the_nearest_rank(spark):
    df = spark.createDataFrame([(1, x) for x in range(10)] + [(2, 5)], "k int, n long")
    got = {(r["k"], r["p"]): r["value"] for r in splits.nearest_rank(df, ["k"], "n", (0.0, 0.5, 1.0)).collect()}
    assert got == {(1, 0.0): 0, (1, 0.5): 5, (1, 1.0): 9, (2, 0.0): 5, (2, 0.5): 5, (2, 1.0): 5}


def test_split_record(tmp_path, spark):
    docs = spark.createDataFrame([("a", "dev"), ("b", "train")], "doc_id string, split string")
    record = splits.build(docs, "es-carmen")
    splits.write_split(record, tmp_path / "s.json")
    assert splits.read_split(tmp_path / "s.json") == record
    with pytest.raises(FileExistsError):
        splits.write_split(record, tmp_path / "s.json")
    record["folds"]["dev"]["docs"] = ["b"]
    with pytest.raises(SpanError):
        splits.check_schema(record)
    with pytest.raises(SpanError):
        splits.reconcile_totals({"n": 3}, [{"n": 1}], {"n": 1})


def test_vocabulary():
    model.check_partition()
    with pytest.raises(SpanError):
        model.check_partition({"rules": ("gazetteer",)})
    with pytest.raises(SpanError):
        model.check_value("layer", "none")


def test_stream_gives_the_table_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"n {i} und {i + 7}") for i in range(40)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = flows.detect_stream(flows.read_documents(spark, str(tmp_path / "in"), "doc_id long, text string", 1), RULES.rules)
    flows.write_spans(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    from quillspan.operators.detect import detect

    want = sorted(map(str, detect(docs, RULES.rules).collect()))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_carmen(spark, tmp_path):
    for variant, text, notes in (("masked", "[NOMBRE] x", "T1\tN 0 8\t[NOMBRE]\n"), ("replaced", "Eva y x", "T1\tN 0 3\tEva\nT2\tN 4 5\tz\n")):
        folder = tmp_path / "ann" / variant / "anon"
        folder.mkdir(parents=True)
        (folder / "d-1.txt").write_text(text)
        (folder / "d-1.ann").write_text(notes)
    with pytest.raises(SpanError):
        brat.read_carmen(spark, str(tmp_path), "train", {"N": "NAME"})
    docs, gold, left_out = brat.read_carmen(spark, str(tmp_path), "train", {"N": "NAME"}, known_bad=[("replaced", "d-1", 1)])
    assert {(r["variant"], r["start"], r["end"], r["phi_type"]) for r in gold.collect()} == {("masked", 0, 8, "NAME"), ("replaced", 0, 3, "NAME")}
    assert [tuple(r) for r in left_out.collect()] == [("replaced", "d-1", 1)]
    assert {(r["variant"], r["doc_id"]) for r in docs.collect()} == {("masked", "d-1"), ("replaced", "d-1")}


def test_corpus_roots(spark, tmp_path, corpus):
    config = tmp_path / "paths.json"
    with pytest.raises(SpanError):
        brat.corpus_root("es-carmen", config)
    assert brat.corpus_root("es-carmen", config, sealed=True) is None
    (tmp_path / "open").mkdir()
    config.write_text(json.dumps({"corpora": {"es-carmen": "open", "de-grascco": "missing"}, "sealed": {"es-meddocan": "open"}}))
    assert brat.corpus_root("es-carmen", config) == str(tmp_path / "open")
    assert brat.corpus_root("es-carmen", config, sealed=True) is None
    assert brat.corpus_root("es-meddocan", config, sealed=True) == str(tmp_path / "open")
    for bad in ("de-grascco", "es-meddocan", "nowhere"):
        with pytest.raises(SpanError) as e:
            brat.corpus_root(bad, config)
        assert str(tmp_path) not in str(e.value)
    (tmp_path / "wrap" / "inner").mkdir(parents=True)
    assert brat.brat_dir(spark, str(tmp_path / "wrap")).endswith("/wrap/inner")
    assert brat.brat_dir(spark, f"file://{tmp_path}") == f"file://{tmp_path}"


def test_one_shot_arm(spark, tmp_path):
    docs = spark.createDataFrame([("a", "id 123 and 45"), ("b", "none")], "doc_id string, text string")
    gold = spark.createDataFrame([("a", 0, 3, 6, "ID", False)], "doc_id string, span_index int, start int, end int, phi_type string, excluded boolean")
    run = {"corpus": "es-meddocan", "detector": "R", "supervision": "sup-free", "porting": "port-oneshot", "split": "dev", "model_id": "none", "generated": "2026-01-02T03:04:05Z", "tree": "clean", "commit": "abc"}
    cost = {"llm_calls": 0, "prompt_tokens": 0, "completion_tokens": 0, "wall_seconds": 0.0}
    rule = {"rule_id": "n", "layer": "regex_checksum", "phi_type": "ID", "pattern": r"[0-9]+"}
    got = rounds.run_arm(docs, gold, lambda: {"version": 1, "lang": "es", "rules": [rule]}, "es", str(tmp_path), run, cost)
    assert got["scores"]["modes"]["fully_covered"]["leak"]["leak_rate"] == 0 and got["termination"]["reason"] == "not_applicable"
    arm = tmp_path / "results/es-meddocan/R/sup-free/port-oneshot"
    assert records.read_spans(spark, str(arm / "spans.jsonl")).count() == 2
    assert rounds.run_arm(docs, gold, lambda: {"lang": "es"}, "es", str(tmp_path / "x"), run, cost) is None
    assert not list((tmp_path / "x").rglob("metrics.json")) and list((tmp_path / "x").rglob("format_failure.json"))


def test_fold_types_and_tokens(spark):
    docs = spark.createDataFrame([("a", "dev", "x y z"), ("b", "dev", "x"), ("c", "train", "")], "doc_id string, split string, text string")
    gold = spark.createDataFrame([("a", "NAME", "N", False), ("a", "NAME", "N", False), ("b", None, "S", True), ("c", "ID", "I", False)], "doc_id string, phi_type string, subtype string, excluded boolean")
    assert {tuple(r) for r in splits.fold_types(docs, gold).collect()} == {("dev", "phi_type", "NAME", 2), ("dev", "excluded_type", "S", 1), ("train", "phi_type", "ID", 1)}
    assert {tuple(r) for r in splits.fold_tokens(docs, [0.0, 0.5]).collect()} == {("dev", 0.0, 1), ("dev", 0.5, 3), ("train", 0.0, 0), ("train", 0.5, 0)}
