"""Token counts (operator 3): an exact histogram of encoded lengths with suffix sums.

Documents are aggregated by (group, length), each text encoded once; sums from the
long end then answer, for every length L taken as a context limit: how many documents
are at least so long, how many ids all documents up to L have, and how many ids
remain when each document is cut at L.  The number of rows is bounded by the number of
distinct lengths, and is far below that of documents.  ``at_limits`` answers any
other limit from the sums of the next length that occurs.

A null or empty text has 0 ids.  A null group is a group of its own.  Repeated rows
count each.  An empty table has an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import bpe
from quillspan.llm import kernels as K
from quillspan.llm.store import settle

BLOCK = 1024


def encoded_lengths(docs: DataFrame, text: str = "text", group: str = "lang", path: str | None = None) -> DataFrame:
    """grp, n_tokens and n_docs, already added up within each task."""
    where = path or bpe.default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(where)
        seen: dict[tuple[str | None, int], int] = {}
        for batch in batches:
            for part in K.chunks(batch, "text", 2 * K.CHUNK_BYTES):
                for key in zip(part.column("grp").to_pylist(), coder.counts(part.column("text")).tolist(), strict=True):
                    seen[key] = seen.get(key, 0) + 1
            if len(seen) > 100_000:
                yield _rows(seen)
                seen = {}
        if seen:
            yield _rows(seen)

    picked = docs.select(docs[group].cast("string").alias("grp"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(K.tidy(count), "grp string, n_tokens long, n_docs long")


def _rows(seen: dict) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array(np.array([k[1] for k in keys], np.int64)), pa.array(np.array([seen[k] for k in keys], np.int64))],
        names=["grp", "n_tokens", "n_docs"],
    )


def length_histogram(docs: DataFrame, text: str = "text", group: str = "lang", path: str | None = None) -> DataFrame:
    """Per group and length: n_docs, docs_to, docs_from, tokens_to, truncated_total, quantile.

    docs_to counts documents of at most that length and docs_from those of at least
    it; tokens_to adds the ids of the former; truncated_total is the sum of
    min(length, L); quantile is docs_to over all documents of the group.
    """
    counts = settle(encoded_lengths(docs, text, group, path).groupBy("grp", "n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")
    return with_suffix_sums(counts).drop("tokens_from")


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """Sums from the long end, in two levels (blocks of lengths, then lengths), so that no window holds a whole group."""
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocked = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", tokens)
    blocks = blocked.groupBy("grp", "block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    every = Window.partitionBy("grp")
    longer = every.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = blocks.select(
        F.col("grp").alias("g"),
        F.col("block").alias("b"),
        zero(F.sum("bd").over(longer)).alias("docs_longer"),
        zero(F.sum("bt").over(longer)).alias("tokens_longer"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("grp", "block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocked.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside))
    docs_from = F.col("docs_longer") + F.col("d")
    tokens_from = F.col("tokens_longer") + F.col("t")
    docs_to = F.col("all_docs") - docs_from + F.col("n_docs")
    return rows.join(sums, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))).select(
        F.col("grp"),
        "n_tokens",
        "n_docs",
        docs_to.alias("docs_to"),
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + F.col("tokens")).alias("tokens_to"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_total"),
        (docs_to / F.col("all_docs")).alias("quantile"),
    )


def at_limits(counts: DataFrame, limits: Sequence[int]) -> DataFrame:
    """grp, n_limit, docs_from, truncated_total for any limits, from grp, n_tokens, n_docs.

    Both come from the suffix sums of the smallest length that is at least the limit.
    """
    sums = with_suffix_sums(counts)
    tokens = F.sum(F.col("n_tokens") * F.col("n_docs"))
    at = [F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "docs_from", "tokens_from"))) for limit in limits]
    found = sums.groupBy("grp").agg(tokens.alias("all_tokens"), F.array(*(F.struct(F.lit(int(x)).cast("long").alias("n_limit"), a.alias("at")) for x, a in zip(limits, at, strict=True))).alias("each"))
    row = found.select("grp", "all_tokens", F.inline("each"))
    docs_from = F.coalesce(F.col("at.docs_from"), F.lit(0))
    return row.select("grp", "n_limit", docs_from.alias("docs_from"), (F.col("all_tokens") - F.coalesce(F.col("at.tokens_from"), F.lit(0)) + F.col("n_limit") * docs_from).alias("truncated_total"))
