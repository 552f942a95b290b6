"""The pipeline's stages against brute force on their own inputs."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from quillspan.llm import kneser, mixing, pieces, secrets, tiles
from tests.llm.common import SCHEMA, table, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r["doc_id"]: r["kept"] for r in kneser.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        after = [r.asDict() for r in docs.collect()]
        ids = Counter(r["doc_id"] for r in after)
        if name == "quality classifier":
            assert set(ids) == {d for d, k in kept.items() if k} and len(ids) > 100
        elif name == "n-gram Jaccard join":
            assert ids == Counter(smallest_of_groups([(r["doc_id"], r["text"]) for r in before]))
        elif name == "secret scans":
            path = secrets.vocabulary_path()
            want = {r["doc_id"]: secrets.redact(r["text"], secrets.find_spans(r["text"], path)) for r in before}
            assert {r["doc_id"]: r["text"] for r in after} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name.startswith("mixing"):
            totals = Counter()
            for r in before:
                totals[r["source"]] += len(r["text"].encode().split())
            taken = Counter()
            for r in after:
                taken[r["source"]] += len(r["text"].encode().split())
            assert max(ids.values()) <= 3
            longest = max(len(r["text"].encode().split()) for r in before)
            assert all(abs(taken[s] - target) <= longest for s, _, target, *_ in mixing.plan_sources(dict(totals)))
        else:
            text = {r["doc_id"]: r["text"] for r in before}
            assert all(pieces.decode(r["pieces"]) == text[r["doc_id"]] for r in after) and len(after) == len(before)
            break
        assert docs.columns == columns


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "pieces"]


def smallest_of_groups(docs, k=5, percent=80):
    """By brute force: of each group of near copies the smallest id."""
    sets = []
    for d, t in docs:
        w = [x.lower() for x in words(t)]
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {d for d in root if find(d) == d}


def test_near_copies_of_five_word_shingles_go(spark):
    """One replaced word in the middle links from 49 words on, and not only from 59 on."""
    texts = []
    for n in (48, 49, 58, 59, 300):
        w = [f"t{n}w{i}" for i in range(n)]
        texts += [" ".join(w), " ".join([*w[: n // 2], "other", *w[n // 2 + 1 :]])]
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table(spark, texts), SF).collect()}
    assert got == {0, 1, 2, 4, 6, 8}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == smallest_of_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_whole_rows_are_dealt_out_once(spark):
    """Dropping near copies and repeats moves each text once between tasks; it was twice."""
    docs = spark.createDataFrame([(k % 9, " ".join(f"k{k % 9}w{i}" for i in range(20)), "x", "s", 9) for k in range(20)], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, SF)
        plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        got = Counter(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == Counter(set(map(tuple, docs.collect())))
    moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)", plan)
    # half aggregated rows are a first# of each column
    assert len(moved) > 1 and sum("text#" in columns or columns.count("first#") >= len(docs.columns) for columns in moved) == 1


def test_bounds_of_the_search_hold_at_80():
    """Linked sets share the kept shingles asked of each, lie in bands that meet, and no bitmap bound ends them."""
    rng, seen = np.random.default_rng(9), 0
    for _ in range(600):
        n = int(rng.integers(1, 1200))
        x = np.unique(rng.integers(0, 2**62, n)).astype(np.uint64)
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * 0.15], rng.integers(0, 2**62, int(rng.integers(0, n // 8 + 2))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not both or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        seen += 1
        shared = len(np.intersect1d(x[: tiles.kept_length(len(x), 80)], y[: tiles.kept_length(len(y), 80)]))
        for m in (len(x), len(y)):
            assert shared >= 1 + tiles.prefix_length(-(-80 * m // 100), 80) // 2
        low, high = sorted((len(x), len(y)))
        at, above = tiles.band_of(low), tiles.band_of(high)
        assert at == above or (at + 1 == above and 100 * low >= 80 * (2 << at))
        bits = []
        for s in (x, y):
            b = np.frombuffer(tiles.parity_bits(s), np.uint64)
            while len(b) * 64 > 1 << above:
                b = b[: len(b) // 2] ^ b[len(b) // 2 :]
            bits.append(b)
        differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert (len(x) + len(y) - differ) / 2 >= both
    assert seen > 100


def test_repeated_and_missing_ids(spark):
    """One row of each group stays, whatever its id; each row has its own epochs."""
    long = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "pqrst"}
    near = long["r"] + " more"
    rows = [(1, long["p"]), (1, long["q"]), (1, long["p"]), (None, long["p"]), (None, near), (7, long["r"]), (None, long["s"]), (None, long["s"]), (None, long["t"]), (None, ""), (None, None), (None, " \n"), (3, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == Counter([(1, long["p"]), (1, long["q"]), (7, long["r"]), (None, long["s"]), (None, long["t"]), (None, ""), (None, None), (None, " \n"), (3, "")])
    sizes = [*range(1, 40), 5, 5]
    many = spark.createDataFrame([(None, " ".join(f"s{k % 4}w{i}" for i in range(n)), "en", f"s{k % 4}", n) for k, n in enumerate(sizes)], SCHEMA)
    named = many.withColumn("row", corpus_pipeline.row_hash(many))
    want = mixing.mix(named, doc_id="row").groupBy("src").sum("epochs").collect()
    mixed = Counter(r["source"] for r in corpus_pipeline.mixture(spark, many, SF).collect())
    assert mixed == Counter({r["src"]: r["sum(epochs)"] for r in want})
    assert len({r["sum(epochs)"] for r in want}) > 1


def plain_mix(rows, sizes, sources):
    """Targets of the sources by the mix's own plan; the rows are told apart by all their values."""
    totals = Counter()
    for n, s in zip(sizes, sources, strict=True):
        totals[s] += n
    return {s: target for s, _, target, *_ in mixing.plan_sources(dict(totals))}


def test_rows_that_differ_in_where_a_null_is(spark):
    """Swapped nulls make different rows; each is kept, and taken for itself."""
    text = lambda k: " ".join(f"k{k}w{i}" for i in range(30))
    rows = [(1, text(0), "x", None, 9), (1, text(0), None, "x", 9), (2, text(1), "a", None, 9), (2, text(2), "a", None, 9), (2, text(2), "a", None, 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    first, second = (r["h"] for r in docs.limit(2).select(corpus_pipeline.row_hash(docs).alias("h")).collect())
    assert first != second
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len(kept) == 3 and set(kept) <= set(rows) and {r[1] for r in kept} == {r[1] for r in rows}
    mixed = Counter(tuple(r) for r in corpus_pipeline.mixture(spark, docs, SF).collect())
    assert set(mixed) <= set(rows)
    words_of = Counter()
    for r, n in mixed.items():
        words_of[r[3]] += 30 * n
    for source, target in plain_mix(rows, [30] * 5, [r[3] for r in rows]).items():
        assert abs(words_of[source] - target) <= 30
    assert mixed[rows[0]] <= 3 and mixed[rows[1]] <= 3 and mixed[rows[3]] <= 6


def test_rows_that_share_a_short_name(spark, monkeypatch):
    """Even if the 64 bits of all rows were the same, no row would be lost or taken for another."""
    text = lambda k: " ".join(f"k{k}w{i}" for i in range(20))
    rows = [(k, text(k), "x", f"s{k % 2}", 9) for k in range(8)] + [(3, text(3), "x", "s1", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter(tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    monkeypatch.setattr(corpus_pipeline, "row_hash", lambda d: corpus_pipeline.F.lit(5).cast("long"))
    assert Counter(tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want == Counter(set(rows))
    mixed = Counter(tuple(r) for r in corpus_pipeline.mixture(spark, docs, SF).collect())
    assert set(mixed) <= set(rows)
    words_of = Counter()
    for r, n in mixed.items():
        words_of[r[3]] += 20 * n
    for source, target in plain_mix(rows, [20] * 9, [r[3] for r in rows]).items():
        assert abs(words_of[source] - target) <= 20


def test_clashing_names_and_odd_types(spark):
    """Columns named as the stages name their own, and map, array and binary ones, come back as they were."""
    F = corpus_pipeline.F
    texts = [" ".join(f"k{k // 2}w{i}" for i in range(30)) + (" more" if k % 2 else "") for k in range(12)]
    extra = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("__row", "row", "Key", "key_", "epoch", "Epochs", "component_id", "taken", "upto", "size", "src")}
    extra |= {"m": F.when(F.col("doc_id") % 3 > 0, F.create_map(F.lit("a"), F.col("doc_id"), F.lit("b"), F.lit(None).cast("long"))), "l": F.array(F.col("doc_id"), F.lit(None)), "b": F.col("text").cast("binary"), "t": F.struct(F.lit(None).cast("int").alias("x"))}
    docs = table(spark, texts, **extra)
    before = {r["doc_id"]: r for r in docs.collect()}
    for stage, least in ((corpus_pipeline.near_duplicates, 6), (corpus_pipeline.secret_scan, 12), (corpus_pipeline.mixture, 3)):
        after = stage(spark, docs, SF)
        assert after.dtypes == docs.dtypes
        got = after.collect()
        assert len({r["doc_id"] for r in got}) >= least and all(r == before[r["doc_id"]] for r in got)
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).orderBy("doc_id").collect()] == [0, 2, 4, 6, 8, 10]
    empty = docs.limit(0)
    assert corpus_pipeline.near_duplicates(spark, empty, SF).count() == corpus_pipeline.mixture(spark, empty, SF).count() == 0
