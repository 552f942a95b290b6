"""Results as a table, costs and caching, digest trees."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspan.plans import results, rounds, splits


def row(iteration, rate=0.5, cost=(1, 2, 3, 0.125), caching=("system", "5m", 4, 5), corpus="es-meddocan"):
    return (rate, *cost, *caching, corpus, "R", "sup-free", "port-loop", iteration)


def table(spark, rows):
    return spark.createDataFrame(rows, results.SCHEMA)


def test_a_round_written_again_replaces_itself_alone(spark, tmp_path):
    path = str(tmp_path / "results")
    results.write_rounds(table(spark, [row(1), row(2, 0.4), row(1, 0.9, corpus="de-grascco")]), path)
    results.write_rounds(table(spark, [row(2, 0.3)]), path)
    got = results.read_rounds(spark, path)
    assert {(r["corpus"], r["iteration"], r["leak_rate"]) for r in got.collect()} == {("es-meddocan", 1, 0.5), ("es-meddocan", 2, 0.3), ("de-grascco", 1, 0.9)}
    told = {(r["corpus"], r["iteration"]): r["gain"] for r in results.history(got).collect()}
    assert told == {("es-meddocan", 1): None, ("es-meddocan", 2): pytest.approx(0.2), ("de-grascco", 1): None}
    assert results.history(got.where("corpus = 'es-meddocan'"), 2).count() == 2


@pytest.mark.parametrize("rows,upto", [([1, 3], None), ([2], None), ([1, 1], None), ([1], 2)])
def test_gaps_are_refused(spark, rows, upto):
    with pytest.raises(Exception, match="no metrics"):
        results.history(table(spark, [row(i) for i in rows]), upto).collect()


@pytest.mark.parametrize("bad,message", [(row(1, corpus="x"), "not a corpus"), (row(0), "whole number"), (row(1, cost=(1, None, 3, 0.1)), "cost block"), (row(1, caching=("system", None, 1, 2)), "caching block")])
def test_rows_that_are_not_whole_are_refused(spark, tmp_path, bad, message):
    with pytest.raises(Exception, match=message):
        results.write_rounds(table(spark, [bad]), str(tmp_path / "results"))


def test_sums(spark):
    none = (None, None, None, None)
    got = results.sum_costs(table(spark, [row(1), row(2, cost=(0, 0, 0, 0.0005))])).first()
    assert [got[c] for c in results.COSTS] == [1, 2, 3, 0.126]
    got = results.sum_caching(table(spark, [row(1), row(2, caching=none), row(3), row(1, caching=none, corpus="de-grascco")])).orderBy("corpus").collect()
    assert [tuple(r)[4:] for r in got] == [(None, None, None, None, None), (True, "system", "5m", 8, 10)]
    for rows, message in (([row(1), row(2, caching=("user", "5m", 1, 1))], "differ"), ([row(1, caching=("user", None, 1, 1))], "lacks")):
        with pytest.raises(Exception, match=message):
            results.sum_caching(table(spark, rows)).collect()
    with pytest.raises(Exception, match="lacks"):
        results.sum_costs(table(spark, [row(1, cost=(1, 1, 1, None))])).collect()
    block = {"enabled": True, "boundary": "system", "ttl": "5m", "read_tokens": 4, "write_tokens": 5}
    assert rounds.sum_caching([block, None, block]) == block | {"read_tokens": 8, "write_tokens": 10}


def plain_tree(digests, leaf, step):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = defaultdict(list)
    for d, x in digests:
        rows[sha(d)[:leaf]].append(f"{d}\t{x}")
    out = level = {k: sha("\n".join(sorted(v))) for k, v in rows.items()}
    while leaf:
        leaf -= step
        above = defaultdict(list)
        for k, v in level.items():
            above[k[:leaf]].append(f"{k}\t{v}")
        level = {k: sha("\n".join(sorted(v))) for k, v in above.items()}
        out = out | level
    return out


def test_tree_depends_on_the_documents_alone(spark):
    rows = [(f"d{i}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(300)]
    made = lambda x, n: splits.manifest_tree(spark.createDataFrame(x, "doc_id string, digest string").repartition(n), 2, 1)
    first = made(rows, 3)
    want = plain_tree(rows, 2, 1)
    for tree in (first, made(rows[::-1], 7)):
        got = tree.collect()
        assert {r["node"]: r["digest"] for r in got} == want
        assert [r["n_docs"] for r in got if r["node"] == ""] == [300]
    other = [*rows[1:7], ("d7", "0"), *rows[8:], ("new", "1")]
    changes = {r["node"]: r["fault"] for r in splits.manifest_changes(first, made(other, 4), 2).collect()}
    touched = {hashlib.sha256(d.encode()).hexdigest()[:2] for d in ("d0", "d7", "new")}
    assert changes.keys() == touched
    assert splits.manifest_changes(first, first, 2).count() == 0
    assert made([], 2).count() == 0 or made([], 2).where(F.col("n_docs") > 0).count() == 0
