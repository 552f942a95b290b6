from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillspan.llm import bpe, chunk_store, lengths, pieces, queries
from quillspan.llm.store import new_path
from tests.llm.common import clashing, odd_texts, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def real():
    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()]


def test_units_give_the_library_ids(library):
    texts = [*odd_texts(), *real()]
    small = bpe.UnitEncoder(bpe.default_path(), cache_units=500)
    for _ in range(2):
        got = [np.frombuffer(x, small.kind).tolist() for x in small.encode(pa.array(texts))]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert small.counts(pa.array(texts)).tolist() == [len(x) for x in got]


@pytest.mark.parametrize("make", [table, clashing])
def test_store_round_trip(spark, library, make):
    texts = [*odd_texts(), *real()[:60]]
    root = new_path(spark, "store")
    chunk_store.write_store(make(spark, texts).repartition(3), root)
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, chunk_store.read_store(spark, root).collect())) == want
    back = {r["doc_id"]: r["ids"] for r in chunk_store.read_ids(spark, root).collect()}
    assert back == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    chunks = spark.read.parquet(f"{root}/cut").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_damage_is_noticed(spark):
    root = new_path(spark, "store")
    chunk_store.write_store(table(spark), root)
    bad = spark.read.parquet(f"{root}/recipes").withColumn("n_ids", queries.F.lit(7).cast("long"))
    bad.write.parquet(f"{root}/worse")
    import shutil

    base = root.removeprefix("file://")
    shutil.rmtree(f"{base}/recipes")
    shutil.move(f"{base}/worse", f"{base}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        chunk_store.read_store(spark, root)


def test_empty_store(spark):
    root = new_path(spark, "store")
    chunk_store.write_store(table(spark, []), root)
    assert chunk_store.read_store(spark, root).count() == 0


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(2)
    a, b, c = (rng.integers(0, 50_000, n) for n in (4000, 300, 171))
    cut = lambda ids: {chunk_store.digest_of(ids[s:e].astype("<u2").tobytes()) for e, s in zip(chunk_store.cut_points(ids), [0, *chunk_store.cut_points(ids)])}
    shared = cut(np.concatenate([b, a])) & cut(np.concatenate([c, a]))
    assert len(shared) >= len(cut(a)) // 2
    assert all(n <= chunk_store.MOST for n in np.diff([0, *chunk_store.cut_points(np.zeros(9000, np.int64))]))


def test_streams_are_cut_alike_together_and_alone():
    rng = np.random.default_rng(6)
    streams = [rng.integers(0, 300, int(n)) for n in (0, 1, 15, 16, 17, 900, 5000, 20, 3000)]
    flat = np.concatenate(streams)
    assert chunk_store.cut_all(flat, np.cumsum([0, *map(len, streams)])) == [chunk_store.cut_points(x) for x in streams]


def test_combined_checksums():
    rng = np.random.default_rng(1)
    parts = [[rng.bytes(4 * int(n)) for n in rng.integers(0, 40, k)] for k in (0, 1, 5, 9)]
    flat = [x for p in parts for x in p]
    got = chunk_store.combine(np.array([zlib.crc32(x) for x in flat], np.uint32), np.array([len(x) for x in flat]), np.cumsum([0, *map(len, parts)]))
    assert got.tolist() == [zlib.crc32(b"".join(p)) for p in parts]


@pytest.mark.parametrize("make", [table, clashing])
def test_histogram_answers_every_limit(spark, library, make):
    texts = [*odd_texts(), *real()]
    got = lengths.length_histogram(make(spark, texts)).collect()
    by: dict = {}
    for i, t in enumerate(texts):
        by.setdefault(("en", "fr", None)[i % 3], []).append(len(library.encode(t or "", add_special_tokens=False).ids))
    assert {(r["grp"], r["n_tokens"]): r["n_docs"] for r in got} == {(g, k): n for g, x in by.items() for k, n in Counter(x).items()}
    for r in got:
        x, limit = by[r["grp"]], r["n_tokens"]
        assert r["docs_to"] == sum(v <= limit for v in x) and r["docs_from"] == sum(v >= limit for v in x)
        assert r["tokens_to"] == sum(v for v in x if v <= limit) and r["truncated_total"] == sum(min(v, limit) for v in x)
        assert r["quantile"] == r["docs_to"] / len(x)
    assert lengths.length_histogram(table(spark, [])).count() == 0


@pytest.mark.parametrize("make", [table, clashing])
def test_pieces_are_lossless_and_repeatable(spark, make):
    import sentencepiece

    texts = [*odd_texts(), " a", "\n", "\n\na", " \n ", "a▁b", *real()[:40]]
    df = make(spark, texts)
    encoded = pieces.encode_documents(df, keep_text=True)
    rows = pieces.decode_documents(encoded).orderBy("doc_id").collect()
    assert [r["decoded"] for r in rows] == [t or "" for t in texts]
    again = {r["doc_id"]: r["pieces"] for r in pieces.encode_documents(df.repartition(4)).collect()}
    assert again == {r["doc_id"]: r["pieces"] for r in rows}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    assert model.decode(rows[9]["pieces"]) == texts[9]
    assert rows[9]["pieces"] != rows[10]["pieces"]  # equal texts, other keys
    assert pieces.encode_documents(table(spark, [])).count() == 0


def test_samples_follow_the_lattice():
    """Frequencies of segmentations against all paths of a word's lattice."""
    model = pieces.Lattices(pieces.default_path(), 0.3)
    word = "then"
    paths: dict[tuple, float] = {}

    def walk(at: int, ids: tuple, weight: float) -> None:
        text = f" {word}".encode()
        if at == len(text):
            paths[ids] = weight
            return
        for end in range(at + 1, len(text) + 1):
            if (got := model.weight.get(text[at:end])) is not None:
                walk(end, (*ids, got[0]), weight * got[1])

    walk(0, (), 1.0)
    n = 20_000
    flat, bounds = model.sample(pa.array([word] * n), np.arange(n))
    seen = Counter(tuple(flat[a:b].tolist()) for a, b in zip(bounds, bounds[1:]))
    total = sum(paths.values())
    assert set(seen) <= set(paths)  # byte pieces are too light to be seen
    long = "é" * 40 + "then" * 30  # words over TOGETHER bytes are filtered on their own
    flat, _ = model.sample(pa.array([long]), np.array([1]))
    assert pieces.decode(flat.tolist()) == long
    for ids, weight in paths.items():
        p = weight / total
        assert abs(seen[ids] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_queries(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.QUERIES["op4_token_store"](spark, SF).count() == n
    rows = queries.QUERIES["op5_sampled_pieces"](spark, SF).collect()
    assert len(rows) == n and all(r["lossless"] for r in rows)
    assert sum(r["n_docs"] for r in queries.QUERIES["op3_token_counts"](spark, SF).collect()) == n


def test_any_limit(spark):
    rng = np.random.default_rng(1)
    sizes = {"a": rng.integers(0, 5000, 300).tolist(), None: [0, 0, 7, 7, 2048], "z": [3]}
    rows = [(g, n, c) for g, x in sizes.items() for n, c in Counter(x).items()]
    counts = spark.createDataFrame(rows, "grp string, n_tokens long, n_docs long")
    limits = [0, 1, 3, 4, 7, 100, 1023, 1024, 1025, 2048, 4999, 10**6]
    got = {(r["grp"], r["n_limit"]): (r["docs_from"], r["truncated_total"]) for r in lengths.at_limits(counts, limits).collect()}
    assert got == {(g, m): (sum(n >= m for n in x), sum(min(n, m) for n in x)) for g, x in sizes.items() for m in limits}
    assert lengths.at_limits(counts.where("false"), limits).count() == 0
