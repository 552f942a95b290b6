"""Every registered query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quillspan.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "lineitem", "orders", "benchmark", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, str(SF)).toPandas()
    columns = sorted(got.columns)
    if name not in registry.ORACLES:
        assert len(got) > 0
        return
    want = db.sql(registry.ORACLES[name]).df()
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_gazetteer_against_regex(spark):
    import regex

    pattern = regex.compile(r"(?i)(?<!\w)(?:the MIT License|stupid|loser|scum)(?!\w)")
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = {(d, *m.span()) for d, t in docs for m in pattern.finditer(t or "")}
    got = {(r["doc_id"], r["start"], r["end"]) for r in registry.QUERIES["detect_gazetteer"](spark, str(SF)).collect()}
    assert got == want and want


def test_masked_text_has_no_found_span(spark):
    text = {r["doc_id"]: r["masked_text"] for r in registry.QUERIES["mask_text"](spark, str(SF)).collect()}
    import re

    from quillspan.plans import oracles

    assert not [d for d, t in text.items() if re.search(oracles.EMAIL, t)]
