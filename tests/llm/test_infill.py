from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from quillspan.llm import infill, queries
from tests.llm.common import clashing, odd_texts, table

SF = "/root/testdata/sf0.001"
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
TRICKY = ["\x01", "\x02", "a\x01b\x02c\x03\x04", "\x02\x04\x01\x02\x03 x", "has <P> in it", "x<S", "<", "<<M", "S>abc <P", "𝔘😀é ab", "a" * 300, "\n" * 50, "one\n<M>", "$0 \\1 %s"]


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("make", [table, clashing])
def test_against_brute_force(spark, make):
    texts = [*odd_texts(), *TRICKY * 12, *[r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]]
    got = infill.digest_columns(infill.transform(make(spark, texts))).orderBy("doc_id").collect()
    forms = set()
    for i, (r, t) in enumerate(zip(got, texts, strict=True)):
        n, form, pre, mid, out = brute(i, t)
        forms.add((form, t in TRICKY))
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, pre, mid)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert len(forms) == 6  # every form, with and without odd characters


def test_null_ids_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "some words here"), (7, "twice the same"), (7, "twice the same"), (8, None)], "doc_id long, text string")
    got = infill.digest_columns(infill.transform(docs)).collect()
    assert len(got) == 4
    twice = [r for r in got if r["doc_id"] == 7]
    assert twice[0] == twice[1]
    bare = next(r for r in got if r["doc_id"] is None)
    assert bare["output_sha256"] == hashlib.sha256(brute(None, "some words here")[4].encode()).hexdigest()
    assert next(r for r in got if r["doc_id"] == 8)["form"] == "plain"
    assert infill.digest_columns(infill.transform(docs.limit(0))).count() == 0


def test_query_against_sql_and_no_shuffle(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    query = queries.op12_fill_in_middle(spark, SF)
    got = sorted(map(tuple, query.collect()), key=repr)
    assert got == sorted(con.sql(queries.ORACLES["op12_fill_in_middle"]).fetchall(), key=repr)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
