"""The data source for corpus folders."""

from __future__ import annotations

import pytest

from quillspan.sources import brat, standoff

NOTE = "T1\tFECHAS 3 7\t2024\nT2\tSEXO_SUJETO_ASISTENCIA 0 2\ten"
ROWS = [("a", "dev", "en 2024", NOTE), ("b", "dev", "﻿en 2024", "T1\tPAIS 1 3\ten\r\n\r\nT2\tFECHAS 4 8\t2024"), ("c", "train", "", ""), ("d", "train", "ü😀\n" * 3, ""), ("e", "test", "sealed", "")]
SCHEMA = "doc_id string, split string, text string, ann string"


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "corpus")
    standoff.write_folder(spark.createDataFrame(ROWS, SCHEMA), path)
    return path


def test_round_trip_without_the_sealed_fold(spark, folder):
    got = {tuple(r) for r in standoff.read_folder(spark, folder, slices=5).collect()}
    assert got == {r for r in ROWS if r[1] != "test"}
    assert {r["doc_id"] for r in standoff.read_folder(spark, f"file://{folder}", folds="test,train", slices=3).collect()} == {"c", "d", "e"}


def test_filters_and_columns_reach_the_reader(spark, folder):
    docs = standoff.read_folder(spark, folder, slices=3)
    assert {r["doc_id"] for r in docs.where("split = 'dev'").collect()} == {"a", "b"}
    assert docs.where("split = 'test'").count() == 0
    names = spark.read.format("standoff").schema("doc_id string, split string").option("slices", 2).load(folder)
    assert sorted(tuple(r) for r in names.collect()) == [("a", "dev"), ("b", "dev"), ("c", "train"), ("d", "train")]
    assert {r["doc_id"] for r in docs.where("split = 'dev' and doc_id > 'a'").collect()} == {"b"}
    assert {r["doc_id"] for r in docs.where("split in ('dev', 'train', 'test')").collect()} == {"a", "b", "c", "d"}


def test_gold_of_a_folder(spark, folder):
    docs, gold = brat.parse_standoff(standoff.read_folder(spark, folder, slices=2), "es-meddocan")
    assert brat.bad_offsets(docs, gold).count() == 0
    got = sorted((r["doc_id"], r["span_index"], r["start"], r["end"], r["surface"], r["phi_type"], r["excluded"]) for r in gold.collect())
    assert got == [("a", 0, 3, 7, "2024", "DATE", False), ("a", 1, 0, 2, "en", None, True), ("b", 0, 0, 2, "en", "LOCATION_AREA", False), ("b", 1, 3, 7, "2024", "DATE", False)]
    assert {r["doc_id"]: (r["text"], r["had_bom"], r["split"]) for r in docs.collect()}["b"] == ("en 2024", True, "dev")


@pytest.mark.parametrize("extra", ["dev/x.txt", "dev/x.ann", "dev/deep/a.txt"])
def test_files_without_partner_and_repeated_ids_are_refused(spark, folder, extra):
    from pathlib import Path

    path = Path(folder) / extra
    path.parent.mkdir(exist_ok=True)
    path.write_text("x")
    with pytest.raises(Exception, match="no partner|stands twice"):
        standoff.read_folder(spark, folder, slices=4).collect()


def test_a_corpus_is_not_written_over_another(spark, folder):
    with pytest.raises(Exception, match="not written over"):
        spark.createDataFrame(ROWS, SCHEMA).write.format("standoff").mode("overwrite").save(folder)
