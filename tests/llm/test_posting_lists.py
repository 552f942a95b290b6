from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import posting_lists as P
from quillspan.llm import queries

SF = "/root/testdata/sf0.1"


def brute(ids, x, top=20, every=20):
    """query: the ids of the nearest rows, and every row's score."""
    x = np.asarray(x, float)
    out = {}
    for i in np.flatnonzero(np.asarray(ids) % every == 0):
        score = x @ x[i]
        rest = np.array([j for j in range(len(ids)) if ids[j] != ids[i]], int)
        order = rest[np.lexsort((np.asarray(ids)[rest], -score[rest]))][:top]
        out[ids[i]] = ([ids[j] for j in order], {ids[j]: score[j] for j in rest})
    return out


def check(rows, want, least, top=20):
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r)
    assert got.keys() == {q for q, (near, _) in want.items() if near}
    hit = total = 0
    for q, found in got.items():
        near, score = want[q]
        assert [r["rank"] for r in found] == list(range(1, len(near) + 1))
        assert len({r["vec_id"] for r in found}) == len(found)
        assert [(r["score"], -r["vec_id"]) for r in found] == sorted(((r["score"], -r["vec_id"]) for r in found), reverse=True)
        assert np.allclose([r["score"] for r in found], [score[r["vec_id"]] for r in found], rtol=1e-12, atol=1e-12)
        hit += len(set(near) & {r["vec_id"] for r in found})
        total += len(near)
    assert hit >= least * total


def frame(spark, ids, x, kind="float"):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_groups_of_uneven_norms(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12)) * 2
    x = (centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 12)) * 0.4) * rng.uniform(0.2, 3, (1500, 1))
    x = x.astype(np.float32).astype(float)
    ids = rng.permutation(4000)[:1500]
    docs = frame(spark, ids, x, kind).repartition(5).withColumn("q", F.lit("x")).withColumn("list", F.lit(1)).withColumn("cid", F.lit(2))
    check(P.neighbours(docs, size=32).collect(), brute(ids.tolist(), x), 0.9)


def test_one_list_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, size=(90, 3)).astype(float)
    x[0] = 1  # no zero vector among the queries
    x[~x.any(1)] = 1
    check(P.neighbours(frame(spark, range(90), x)).collect(), brute(list(range(90)), x), 1.0)


def test_many_copies_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)).astype(np.float32).astype(float)
    x[::3] = x[0]  # a third are copies
    monkeypatch.setattr(P, "BLOCK_BYTES", 30 * 64)  # regions of 30 vectors: lists and queries are cut into many blocks
    ids = rng.permutation(600)
    check(P.neighbours(frame(spark, ids, x).repartition(7), size=100).collect(), brute(ids.tolist(), x), 0.9)


def test_what_takes_no_part(spark):
    good = [(i, [float(i + 1), 1.0, -float(i)]) for i in range(45)]
    odd = [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 2.0]), (180, [float("nan"), 1.0, 1.0]), (200, [float("inf"), 1.0, 1.0]), (220, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(good + odd + good[:2], "vec_id long, embedding array<float>")
    check(P.neighbours(rows).collect(), brute([g[0] for g in good], [g[1] for g in good]), 1.0)
    assert P.neighbours(rows.limit(0)).count() == 0
    assert P.neighbours(rows.where("vec_id >= 100 and vec_id <> 220")).count() == 0
    assert P.neighbours(rows.where("vec_id = 20")).count() == 0
    assert P.neighbours(rows.where("vec_id % 20 = 1")).count() == 0
    few = P.neighbours(rows.where("vec_id in (20, 21, 22)")).collect()
    check(few, brute([20, 21, 22], [g[1] for g in good[20:23]]), 1.0)


def test_recall_of_the_query(spark):
    import duckdb

    e = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by 1").fetchall()
    check(queries.op13_nearest_vectors(spark, SF).collect(), brute([r[0] for r in e], [r[1] for r in e]), 0.9)


def test_index_parts():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 10))
    index = P.fit(x, 50, float((x * x).sum(1).max()))
    lifted = index.lifted(x)
    exact = ((lifted[:, None] - index.centroids[None]) ** 2).sum(2)
    ids, far = index.walk(lifted, P.BEAM)
    assert (ids[:, 0] == exact.argmin(1)).mean() > 0.98  # the walk finds the nearest centroid
    assert np.allclose(far[:, 0] ** 2, np.take_along_axis(exact, ids[:, :1], 1)[:, 0], rtol=1e-3)
    row, lists = index.lists_of(x)
    assert set(row) == set(range(2000)) and len(row) > 2000  # every vector is stored, those on borders more than once
    sizes = np.bincount(lists, minlength=50)
    assert sizes.max() < 4 * sizes.mean()
    assert P.regions(np.array([5, 0, 5, 5, 20, 1, 1]), 10).tolist() == [0, -1, 0, 1, 2, 3, 3]
    index.ratio = 1e9
    assert len(index.lists_for(x[:30])[0]) == 30 * 50  # a wide ratio reaches every list
    index.ratio = 1.0
    assert len(index.lists_for(x[:30])[0]) == 30
