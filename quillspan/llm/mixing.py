"""Mixing sources to target weights (operator 6) by subset-sum budget fitting.

Documents are counted by (source, exact length).  Each source's target is its
weight's share of all sizes, held to ``most_epochs`` times what the source has; the
excess goes to the others by weight until none is above.  A source takes whole
epochs of its documents, and for the rest of its target a number of documents of
each length: proportional quotas first, then a bounded-knapsack program over the
documents left closes the gap (at most ``MOST_SUM`` words of it are for the program to decide; a
source whose documents are longer may miss its target by up to its shortest document).
What reaches the driver is a row for each source.  Which documents of a length are taken follows a
seeded hash of doc_id, so reruns agree.

Null or empty texts have size 0 (they are taken as often as their source's whole
epochs, which changes no sum).  A null source is a source of its own, last in
order.  Rows that repeat are documents of their own.  An empty table gives an empty
mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (1.0, 2.0, 3.0)
MOST_EPOCHS = 3
SEED = 20260805
HOT = 4096
MOST_SUM = 1 << 17  #: words of a budget that the knapsack program decides, at most: it bounds its memory; the rest goes by quotas and whole documents
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS) -> list[float]:
    """The words each source is to give, by position; weights repeat along the list."""
    given = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(given[i] for i in free)
        share = left / whole
        over = [i for i in free if share * given[i] > most * sizes[i]]
        for i in over or free:
            out[i] = float(most * sizes[i]) if over else share * given[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if share * given[i] <= most * sizes[i]]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to the budget.

    Quotas in proportion use up most of it, and whole documents, longest first, what
    rounding leaves, down to a few times the longest length; for that rest a bounded
    knapsack (binary splits of the documents left, sets of reachable sums as bits of
    one integer) finds the nearest sum.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    take = np.zeros(len(lengths), dtype=np.int64)
    use = np.flatnonzero((lengths > 0) & (counts > 0))
    total = int((lengths[use] * counts[use]).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        take[use] = counts[use]
        return take
    # what is left for the program: a few of the longest documents, or the whole of a small budget
    reach = min(MOST_SUM, 2 * int(lengths[use].max()) + 2048)
    take[use] = counts[use] * max(0, budget - reach) // total
    gap = budget - int((take * lengths).sum())
    for i in use[np.argsort(-lengths[use], kind="stable")]:
        if gap <= reach:
            break
        more = min(int(counts[i] - take[i]), max(0, (gap - reach) // int(lengths[i])))
        take[i] += more
        gap -= more * int(lengths[i])
    left = counts - take
    items: list[tuple[int, int]] = []
    room = gap + int(lengths[use].min())
    for i in use[np.argsort(lengths[use], kind="stable")]:
        size, n, k = int(lengths[i]), int(min(left[i], room // max(1, int(lengths[i])))), 1
        while n > 0 and size <= room:
            k = min(k, n)
            items.append((i, k))
            n -= k
            k *= 2
    reached, stages, mask = 1, [], (1 << (room + 1)) - 1
    for i, k in items:
        stages.append(reached)
        reached |= (reached << (int(lengths[i]) * k)) & mask
        if reached >> gap & 1:
            items = items[: len(stages)]
            break
    low = (reached & ((1 << (gap + 1)) - 1)).bit_length() - 1
    high = reached >> gap
    up = (high & -high).bit_length() - 1 + gap if high else None
    at = up if up is not None and up - gap < gap - low else low
    for (i, k), before in zip(reversed(items), reversed(stages), strict=True):
        if not before >> at & 1:
            take[i] += k
            at -= int(lengths[i]) * k
    return take


def plan_sources(totals: dict[str | None, int], weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS) -> list[tuple[str | None, int, float, int, int]]:
    """From each source's words, in the sources' order: source, size, target, whole epochs, words of one more epoch."""
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
    sizes = [totals[s] for s in names]
    out = []
    for s, size, target in zip(names, sizes, targets(sizes, weights, most), strict=True):
        epochs = min(int(most), math.floor(target / size)) if size else 0
        out.append((s, size, target, epochs, round(target - epochs * size) if epochs < most else 0))
    return out


def _fit_source(frame: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram with the documents to take of each length."""
    frame = frame.sort_values("size", ignore_index=True)
    take = fit(frame["size"].to_numpy(), frame["c"].to_numpy(), int(frame["budget"].iloc[0]))
    return pd.DataFrame({"ps": frame["src"], "psize": frame["size"], "n": take, "c": frame["c"]})


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = SEED, sized: DataFrame | None = None) -> DataFrame:
    """doc_id, src, size, source_size, target, epochs: how often the mix takes each document.

    ``sized`` may give the table (doc_id, src, size) where it is at hand already.
    """
    from quillspan.llm.store import settle

    spark = docs.sparkSession
    if sized is None:
        sized = settle(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[source].cast("string").alias("src"), word_count(docs[text]).alias("size")), "sizes")
    histogram = settle(sized.groupBy("src", "size").agg(F.count("*").alias("c")), "lengths")
    # a row for each source: its words; what is taken of each length is fitted source by source
    totals = {r["src"]: r["t"] for r in histogram.groupBy("src").agg(F.sum(F.col("size") * F.col("c")).alias("t")).collect()}
    source_table = spark.createDataFrame(plan_sources(totals, weights, most), "s string, source_size long, target double, whole int, budget long")
    budgeted = histogram.join(source_table.select("s", "budget"), F.col("src").eqNullSafe(F.col("s"))).select("src", "size", "c", "budget")
    pick_table = settle(budgeted.groupBy("src").applyInPandas(_fit_source, "ps string, psize long, n long, c long"), "picks")
    rank_hash = F.xxhash64(F.lit(seed), "doc_id")
    # lengths of which all or none are taken need no ranking; the hot ones are ranked in buckets of the hash
    drawn = sized.join(pick_table, F.col("src").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("psize")), "left").withColumn(
        "bucket", F.pmod(F.shiftrightunsigned(rank_hash, 20), F.ceil(F.col("c") / HOT))
    )
    some = (F.col("n") > 0) & (F.col("n") < F.col("c"))
    buckets = drawn.where(some & (F.col("c") > HOT)).groupBy("src", "size", "bucket").agg(F.count("*").alias("m"))
    before = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(F.col("src").alias("bs"), F.col("size").alias("bsize"), F.col("bucket").alias("b"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("src", "size", "bucket").orderBy(rank_hash, "doc_id")
    ranked = (
        drawn.where(some)
        .withColumn("rank", F.row_number().over(inside))
        .join(offsets, F.col("src").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bsize")) & (F.col("bucket") == F.col("b")), "left")
        .select("doc_id", "src", "size", (F.col("rank") + F.coalesce("offset", F.lit(0)) <= F.col("n")).alias("extra"))
    )
    plain = drawn.where(~some | F.col("n").isNull()).select("doc_id", "src", "size", (F.coalesce("n", F.lit(0)) > 0).alias("extra"))
    both = plain.unionByName(ranked)
    return both.join(source_table, F.col("src").eqNullSafe(F.col("s"))).select(
        "doc_id", "src", "size", "source_size", "target", (F.col("whole") + F.col("extra").cast("int")).alias("epochs")
    )
