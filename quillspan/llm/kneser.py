"""Quality classifier (operator 1): perplexity under a modified Kneser-Ney model of trusted text.

Of the documents labelled good, one in ``HELD`` (by a hash of doc_id) is held out for
the thresholds; of the others at most ``MOST_TRUSTED``, again by hash, are the
bounded sample that the model is trained on.  Their word n-grams up to order 3 give an
interpolated model with the three discounts of modified Kneser-Ney per order;
unigrams are interpolated with a uniform word, so unseen words have a probability.
Counts, discounts and weights are worked out as tables on the executors, which also
sort each shard of the model's key space; the driver sees counts of counts and the
packed shards, whose size the training sample bounds.  Scoring joins every document's
n-grams with the shards in turn and adds up log-probabilities, whole texts always.
A short text's log-perplexity says little, so it is drawn towards its language's
median as if ``SHRINK`` more words had that value.  Per language the threshold is a
quantile of these scores of the held-out trusted documents, raised by a
share of its distance from the median; documents above it are rejected.

A null or empty text (or one without words) has no perplexity and is rejected.  A
language with fewer than ``LEAST_TRUSTED`` trusted documents, or a null one, uses
the quantile over all languages; without any trusted document nothing but empty
texts is rejected.  Rows that repeat are judged alike.  Whole rows are scored as the
result is read; only scores of held-out documents are written before.  Other columns
may have any names: the operator's own columns take names that the input hasn't.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernels as K
from quillspan.llm.store import drop, settle

MOST_TRUSTED = 2000
LEAST_TRUSTED = 20
HELD = 4
QUANTILE = 0.995
SPREAD = 0.25
SHRINK = 20
SHARDS = 8

_BOS = np.uint64(0x1D8E4E27C47D124F)
_TWO = np.uint64(0x2545F4914F6CDD1D)
_THREE = np.uint64(0x9FB21C651E98DF25)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix(a * _TWO + b)


def triple_key(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return K.mix(pair_key(a, b) * _THREE + c)


def contexts(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word and the one before that; a mark before a text's first word."""
    h = w.hashes
    one, two = np.full(len(h), _BOS), np.full(len(h), _BOS)
    place = np.arange(len(h)) - np.repeat(w.first[:-1], w.counts)
    if len(h) > 1:
        one[1:] = np.where(place[1:] >= 1, h[:-1], _BOS)
        two[2:] = np.where(place[2:] >= 2, h[:-2], _BOS)
    return one, two


def discounts(n: Sequence[int]) -> list[float]:
    """D(0), D(1), D(2), D(3+) from how many n-grams were seen once, twice, three and four times."""
    if not n[0] or not n[1]:
        return [0.0, 0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return [min(max(x, 0.0), float(k)) for k, x in enumerate(d)]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(48)) % np.uint64(shards)).astype(np.int64)


@dataclass
class Shard:
    """Sorted keys of one slice of the key space; per key a direct probability and a weight for the next order down."""

    keys: list[np.ndarray]
    direct: list[np.ndarray]
    weight: list[np.ndarray]


@dataclass
class Model:
    shards: list[Shard]
    unseen: float

    def look_up(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join n-grams of one order with every shard in turn: direct probability (0 if absent) and weight (1 if absent)."""
        direct, weight = np.zeros(len(keys), np.float32), np.ones(len(keys), np.float32)
        of = shard_of(keys, len(self.shards))
        for s, shard in enumerate(self.shards):
            table = shard.keys[order]
            if not len(table):
                continue
            at = np.flatnonzero(of == s)
            place = np.minimum(np.searchsorted(table, keys[at]), len(table) - 1)
            hit = table[place] == keys[at]
            direct[at[hit]] = shard.direct[order][place[hit]]
            weight[at[hit]] = shard.weight[order][place[hit]]
        return direct, weight

    def log_probability(self, w: K.Words) -> np.ndarray:
        """Natural log-probability of each word of the texts."""
        h = w.hashes
        if not len(h):
            return np.empty(0)
        one, two = contexts(w)
        p1, _ = self.look_up(0, h)
        p1 = np.where(p1 > 0, p1, self.unseen)
        _, g2 = self.look_up(0, one)
        p2, _ = self.look_up(1, pair_key(one, h))
        _, g3 = self.look_up(1, pair_key(two, one))
        p3, _ = self.look_up(2, triple_key(two, one, h))
        return np.log(p3 + g3.astype(float) * (p2 + g2.astype(float) * p1))


def _discounted(table: DataFrame) -> tuple[DataFrame, list[float]]:
    """The table of n-grams (n: count) with each one's discount, and the four discounts."""
    seen = table.agg(*(F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    d = discounts([int(x or 0) for x in seen])
    return table.withColumn("d", F.element_at(F.array(*(F.lit(x) for x in d[1:])), F.least("n", F.lit(3)).cast("int"))), d


def estimate(trigrams: DataFrame, shards: int = SHARDS) -> Model:
    """The model from distinct trigrams and their counts: a, b, c (hashes; c is the word), n."""
    tri, _ = _discounted(trigrams)
    # lower orders count distinct words to the left
    bi, _ = _discounted(settle(trigrams.groupBy("b", "c").agg(F.count("*").alias("n")), "bigrams"))
    uni, d1 = _discounted(bi.groupBy("c").agg(F.count("*").alias("n")))
    total1, freed1, kinds = uni.agg(F.sum("n"), F.sum("d"), F.count("*")).first()
    uniform = freed1 / total1 / (kinds + 1) if kinds else 1.0
    none, one = F.lit(None).cast("long"), F.lit(1.0)

    def weights(table: DataFrame, *history: str) -> DataFrame:
        """Per history: its total, and what discounting leaves to the next order down."""
        return table.groupBy(*history).agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight"))

    w3, w2 = weights(tri, "a", "b"), weights(bi, "b")
    # an n-gram's own probability, and the weight that it has as a history: one row for each or both
    direct3 = tri.join(w3, ["a", "b"]).select("a", "b", "c", ((F.col("n") - F.col("d")) / F.col("total")).alias("direct"))
    direct2 = bi.join(w2, "b").select("b", "c", ((F.col("n") - F.col("d")) / F.col("total")).alias("direct"))
    direct1 = uni.select("c", ((F.col("n") - F.col("d")) / F.lit(total1 or 1) + F.lit(uniform)).alias("direct"))
    as_pair = w3.select(F.col("a").alias("b"), F.col("b").alias("c"), "weight")
    rows = (
        direct1.join(w2.select(F.col("b").alias("c"), "weight"), "c", "full").select(F.lit(0).alias("of"), none.alias("a"), none.alias("b"), "c", "direct", "weight")
        .unionByName(direct2.join(as_pair, ["b", "c"], "full").select(F.lit(1).alias("of"), none.alias("a"), "b", "c", "direct", "weight"))
        .unionByName(direct3.select(F.lit(2).alias("of"), "a", "b", "c", "direct", one.alias("weight")))
    )
    keyed = rows.select("of", "a", "b", "c", F.coalesce("direct", F.lit(0.0)).alias("direct"), F.coalesce("weight", one).alias("weight")).mapInArrow(K.tidy(_keyed(shards)), _KEYED)
    packed = keyed.groupBy("shard").applyInArrow(_pack, _PACKED).toArrow()  # a row for each shard
    empty = np.empty(0)
    out = [Shard([empty.astype(np.uint64)] * 3, [empty.astype(np.float32)] * 3, [empty.astype(np.float32)] * 3) for _ in range(shards)]
    for row in packed.to_pylist():
        for kind, dtype in (("keys", np.uint64), ("direct", np.float32), ("weight", np.float32)):
            setattr(out[row["shard"]], kind, [np.frombuffer(row[f"{kind}{k}"], dtype) for k in range(3)])
    return Model(out, float(uniform))


_KEYED = "shard int, of int, key long, direct float, weight float"
_PACKED = "shard int, " + ", ".join(f"{kind}{k} binary" for kind in ("keys", "direct", "weight") for k in range(3))


def _keyed(shards: int):
    """N-grams by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("of").to_numpy()
            a, b, c = (batch.column(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) for x in "abc")
            key = np.select([of == 0, of == 1], [c, pair_key(b, c)], triple_key(a, b, c))
            columns = [pa.array(shard_of(key, shards).astype(np.int32)), batch.column("of"), pa.array(key.astype(np.int64)), *(batch.column(x).cast(pa.float32()) for x in ("direct", "weight"))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "of", "key", "direct", "weight"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """One shard's sorted arrays."""
    of, key, direct, weight = (table.column(c).to_numpy() for c in ("of", "key", "direct", "weight"))
    out = {"shard": table.column("shard").slice(0, 1)}
    arrays: dict[str, list[bytes]] = {"keys": [], "direct": [], "weight": []}
    for k in range(3):
        at = np.flatnonzero(of == k)
        at = at[np.argsort(key[at].astype(np.uint64))]
        for kind, x in (("keys", key.astype(np.uint64)), ("direct", direct), ("weight", weight)):
            arrays[kind].append(x[at].tobytes())
    out |= {f"{kind}{k}": pa.array([x], pa.binary()) for kind, parts in arrays.items() for k, x in enumerate(parts)}
    return pa.table(out)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.chunks(batch, "text"):
            w = K.words(part.column("text"))
            one, two = contexts(w)
            _, first, n = np.unique(triple_key(two, one, w.hashes), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first].astype(np.int64)) for x in (two, one, w.hashes)), pa.array(n.astype(np.int64))], names=["a", "b", "c", "n"])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(HELD)) == 0


def train(docs: DataFrame, trusted: DataFrame, most: int = MOST_TRUSTED, shards: int = SHARDS) -> Model:
    """The model of the trusted documents that aren't held out; docs: doc_id, text; trusted: doc_id."""
    pool = trusted.where(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    chosen = settle(pool.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "trusted")
    # at most ``most`` ids
    text = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")
    counts = text.mapInArrow(K.tidy(_trigrams), "a long, b long, c long, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    return estimate(settle(counts, "trigrams"), shards)


_WORDS, _MEAN, _SCORE, _THRESHOLD = "__words", "__log_perplexity", "__score", "__threshold"


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table, columns that have the operator's own names renamed, and their names by the new ones."""
    own = {_WORDS, _MEAN, _SCORE, _THRESHOLD}
    names = {}
    for c in docs.columns:
        new = c
        while new != c and new in docs.columns or new in own:
            new = f"_{new}"
        names[new] = c
    return docs.toDF(*names), names


def _scorer(model, names: list[str], column: str):
    """The named columns, and behind them the number of words and the mean negative log-probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in K.chunks(batch, column):
                w = K.words(part.column(column))
                total = np.concatenate([[0.0], np.cumsum(m.log_probability(w))])
                n = w.counts
                mean = -(total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n.astype(np.int64)), pa.array(mean, mask=n == 0)], names=[*names, _WORDS, _MEAN])

    return run


def _scores(docs: DataFrame, carried: list[str], labels: DataFrame, most: int, quantile: float, spread: float, doc_id: str, text: str, lang: str) -> DataFrame:
    """The carried columns with the number of words, log-perplexity, score and threshold behind them."""
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    model = train(base, good, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(rows: DataFrame, names: list[str]) -> DataFrame:
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
        sent = rows.select(*names) if text in names else rows.select(*names, text)
        return sent.mapInArrow(K.tidy(_scorer(shared, names, text)), f"{kinds}, {_WORDS} long, {_MEAN} double")

    # thresholds need the held-out rows alone, without their texts; no table of all rows is written for them
    ids = good.where(held_out(F.col("doc_id"))).distinct().withColumnRenamed("doc_id", "held")
    judged = scored(docs.where(held_out(docs[doc_id].cast("long"))), [doc_id, lang]).where(F.col(_MEAN).isNotNull())
    held = settle(judged.select(F.col(doc_id).cast("long").alias("id"), F.col(lang).alias("lang"), _WORDS, _MEAN).join(ids, F.col("id") == F.col("held"), "left_semi"), "perplexity", clean=True)
    # perplexities on a grid, so that a quantile keeps a bounded histogram for each language
    middles = _by_language(held, F.percentile(F.round(_MEAN, 3), F.lit(0.5)))

    def score(of: str) -> Column:
        return (F.col(_MEAN) * F.col(_WORDS) + _pick(middles, of) * SHRINK) / (F.col(_WORDS) + SHRINK)

    highs = _by_language(held.withColumn("score", score("lang")), F.percentile(F.round("score", 3), F.lit(quantile)))
    threshold = _pick(highs, lang) + spread * (_pick(highs, lang) - _pick(middles, lang))
    drop(held)
    return scored(docs, carried).withColumn(_SCORE, score(lang)).withColumn(_THRESHOLD, threshold)


def kept() -> Column:
    return F.col(_MEAN).isNotNull() & F.coalesce(F.col(_SCORE) <= F.col(_THRESHOLD), F.lit(True))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    most: int = MOST_TRUSTED,
    quantile: float = QUANTILE,
    spread: float = SPREAD,
) -> DataFrame:
    """doc_id, lang, n_words, log_perplexity, score, threshold, kept; labels: doc_id, quality, toxic."""
    scored = _scores(docs, [doc_id, lang], labels, most, quantile, spread, doc_id, text, lang)
    return scored.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(lang).cast("string").alias("lang"),
        F.col(_WORDS).alias("n_words"),
        F.col(_MEAN).alias("log_perplexity"),
        F.col(_SCORE).alias("score"),
        F.col(_THRESHOLD).alias("threshold"),
        kept().alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST_TRUSTED, quantile: float = QUANTILE, spread: float = SPREAD) -> DataFrame:
    """The rows that are kept, with their columns as they were."""
    apart, names = _apart(docs)
    return _scores(apart, apart.columns, labels, most, quantile, spread, doc_id, text, lang).where(kept()).select(*(F.col(f"`{new}`").alias(c) for new, c in names.items()))


def _by_language(held: DataFrame, value: Column) -> dict[str | None, float]:
    """One number a language, and at None the one over all; languages with few documents have none."""
    rows = held.rollup("lang").agg(F.count("*").alias("n"), value.alias("x"), F.grouping("lang").alias("every")).collect()
    return {None if r["every"] else r["lang"]: r["x"] for r in rows if r["every"] or (r["lang"] is not None and r["n"] >= LEAST_TRUSTED)}


def _pick(by: dict[str | None, float], lang: str) -> Column:
    out = F.lit(by.get(None)).cast("double")
    for name, x in by.items():
        if name is not None:
            out = F.when(F.col(lang) == name, F.lit(x)).otherwise(out)
    return out
