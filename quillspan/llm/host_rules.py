"""Quality rules with host-level verdicts (operator 8).

Per document a few counts are taken in one pass over its text.  A document fails
the base rules with fewer than 10 words, or when over 20 % of its words lie in
5-word windows that the text has twice or more.  Failures are added up by host, a
beta prior is fitted to the hosts' rates by the method of moments, and a host
whose shrunk rate exceeds ``max_rate`` takes its remaining documents with it.

Null texts count as empty (no words; the base rules fail them).  A null host is a
host of its own.  Repeated rows are judged row by row.  Columns of the input other
than the three named ones are ignored, whatever they are called.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernels as K
from quillspan.llm.store import settle

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_RATE = 0.5
WINDOW = 5

_CHARS = np.ones(256, dtype=bool)
_CHARS[0x80:0xC0] = False
_CHARS[[9, 10, 11, 12, 13, 32]] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(w: K.Words, k: int = WINDOW) -> np.ndarray:
    """Per text, the words in k-word windows that the text has twice or more."""
    values, first = K.grams(w, k)
    n = len(w.counts)
    if not len(values):
        return np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    key = K.mix(values + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(values), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    place = np.arange(len(values)) - first[owner] + w.first[owner]
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    hit = place[twice]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + k, -1)
    return K.per_text(np.cumsum(edge[:-1]) > 0, w.first)


def _lines(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    whole = data.tobytes()
    out = np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(out)):
        lines = [x for x in whole[bounds[i] : bounds[i + 1]].split(b"\n") if x.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.chunks(batch, "text"):
            w = K.words(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("host"),
                    pa.array(w.counts.astype(np.int64)),
                    pa.array(K.per_text(_CHARS[w.data], w.bounds)),
                    pa.array(K.per_text(_SYMBOL[w.data], w.bounds)),
                    pa.array(_lines(w.data, w.bounds)),
                    pa.array(repeated_words(w)),
                ],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            )


def rule_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document the counts that the rules look at."""
    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[host].cast("string").alias("host"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(K.tidy(_measure), STATS)


def fails(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_rates(stats: DataFrame) -> DataFrame:
    """host, documents, failures, shrunk failure rate.

    The prior's mean is the overall rate; its strength comes from the variance of
    the hosts' rates around that mean (at least 1 pseudo-document, at most 1e6).
    """
    hosts = stats.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(F.sum("f") / F.sum("n"), F.avg(rate * rate) - F.avg(rate) * F.avg(rate)).first()
    m, v = (float(x or 0.0) for x in prior)
    strength = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1e6
    return hosts.select("host", "n", "f", ((F.col("f") + m * strength) / (F.col("n") + strength)).alias("rate"))


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_rate: float = MAX_RATE,
) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rejected, kept."""
    stats = settle(rule_counts(docs, doc_id, text, host).withColumn("base_failed", fails(min_words, max_repeat_percent)), "rules")
    bad = host_rates(stats).where(F.col("rate") > max_rate).select(F.col("host").alias("bad_host"), F.lit(True).alias("hit"))
    judged = stats.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    rejected = F.coalesce(F.col("hit"), F.lit(False))
    return judged.select(*stats.columns, rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))
