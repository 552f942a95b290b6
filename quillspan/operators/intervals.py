"""Interval algebra on half-open character spans, by document."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.model import MIXED_TAG

DOC_TYPE = ("doc_id", "phi_type")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Characters two spans share."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


#: A document is split by places only if told so; this many characters make a bucket then.
WIDTH = 1 << 16


def _carried(table: DataFrame, keys: Sequence[str], value: Column, by: str) -> DataFrame:
    """keys, by, carried: what an aggregate of all earlier buckets of a key comes to (``value`` looks at one bucket's ``__v``)."""
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return table.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(by).alias(f"_{by}"), value.over(before).alias("__carried"))


def _with_carried(rows: DataFrame, carried: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return rows.join(carried, same & (F.col(by) == F.col(f"_{by}"))).drop(*(f"__{k}" for k in keys), f"_{by}")


def with_island(spans: DataFrame, keys: Sequence[str], touching: bool, width: int | None = None) -> DataFrame:
    """Number the chains of spans that overlap (or touch) within each key.

    With ``width`` a key's spans are split by where they start, in buckets of so many
    characters: each bucket is a group of its own, and what goes over its borders, the
    farthest end and the number of chains so far, is carried from a row a bucket.
    """
    if width is None:
        ordered = Window.partitionBy(*keys).orderBy("start", "end")
        reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        opens = reach.isNull() | ((F.col("start") > reach) if touching else (F.col("start") >= reach))
        return spans.withColumn("__opens", opens.cast("int")).withColumn("island", F.sum("__opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")
    rows = spans.withColumn("__bucket", F.floor(F.col("start") / width))
    ordered = Window.partitionBy(*keys, "__bucket").orderBy("start", "end")
    ends = rows.groupBy(*keys, "__bucket").agg(F.max("end").alias("__v"))
    met = _with_carried(rows, _carried(ends, keys, F.max("__v"), "__bucket"), keys, "__bucket")
    reach = F.greatest("__carried", F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    opens = reach.isNull() | ((F.col("start") > reach) if touching else (F.col("start") >= reach))
    opened = met.withColumn("__opens", opens.cast("int")).drop("__carried")
    starts = opened.groupBy(*keys, "__bucket").agg(F.sum("__opens").alias("__v"))
    placed = _with_carried(opened, _carried(starts, keys, F.sum("__v"), "__bucket"), keys, "__bucket")
    # equal spans may come in another order than before the joins; the one that opens a chain counts first
    again = Window.partitionBy(*keys, "__bucket").orderBy("start", "end", F.desc("__opens")).rowsBetween(Window.unboundedPreceding, 0)
    island = F.coalesce("__carried", F.lit(0)) + F.sum("__opens").over(again)
    return placed.withColumn("island", island).drop("__opens", "__carried", "__bucket")


def interval_union(spans: DataFrame, keys: Sequence[str] = DOC_TYPE, touching: bool = True, width: int | None = None) -> DataFrame:
    """keys, start, end of the merged spans; touching ones merge unless told otherwise; ``width`` splits hot keys."""
    return with_island(spans, keys, touching, width).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def mask_union(spans: DataFrame, key: str = "doc_id", width: int | None = None) -> DataFrame:
    """key, start, end, n_types, tag of chains of strictly overlapping spans of any type."""
    chains = with_island(spans, [key], touching=False, width=width).groupBy(key, "island")
    out = chains.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct("phi_type").alias("n_types"), F.min("phi_type").alias("only"))
    tag = F.when(F.col("n_types") == 1, F.concat(F.lit("["), F.col("only"), F.lit("]"))).otherwise(F.lit(MIXED_TAG))
    return out.select(key, "start", "end", "n_types", tag.alias("tag"))


def overlapping_pairs(spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, pairs: how many pairs of spans overlap; no pair is made.

    Places are counted up: at each one the spans that end there are gone, and those
    that start there meet the ones still open and each other.  A document's places are
    split in buckets of ``width`` characters; the number of open spans is carried on.
    """
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("starts")), F.struct(F.col("end").alias("at"), F.lit(0).alias("starts"))))
    at = spans.select("doc_id", ends.alias("x")).groupBy("doc_id", "x.at").agg(F.sum("x.starts").alias("starts"), F.count("*").alias("n"))
    places = at.select("doc_id", F.col("at"), "starts", (F.col("n") - F.col("starts")).alias("ends"), F.floor(F.col("at") / width).alias("__bucket"))
    net = places.groupBy("doc_id", "__bucket").agg(F.sum(F.col("starts") - F.col("ends")).alias("__v"))
    met = _with_carried(places, _carried(net, ["doc_id"], F.sum("__v"), "__bucket"), ["doc_id"], "__bucket")
    before = Window.partitionBy("doc_id", "__bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    still = F.coalesce("__carried", F.lit(0)) + F.coalesce(F.sum(F.col("starts") - F.col("ends")).over(before), F.lit(0)) - F.col("ends")
    counted = met.withColumn("pairs", F.col("starts") * still + F.expr("starts * (starts - 1) div 2"))
    return counted.groupBy("doc_id").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def dedupe(spans: DataFrame) -> DataFrame:
    """The first of the spans that agree in document, start, end and type."""
    first = Window.partitionBy("doc_id", "start", "end", "phi_type").orderBy("span_index")
    return spans.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")


def dedupe_counts(spans: DataFrame) -> DataFrame:
    """doc_id, kept, dropped."""
    distinct = spans.groupBy("doc_id", "start", "end", "phi_type").agg(F.count("*").alias("n"))
    return distinct.groupBy("doc_id").agg(F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("dropped"))


def merge_recall_first(spans: DataFrame, priority: Sequence[str], strategy: str = "union") -> DataFrame:
    """Overlapping spans of any type become one: doc_id, start, end, phi_type, n_merged.

    ``union`` takes the type of the longest member, ties by the order of ``priority``
    (layers), then by place; ``fixed_priority`` asks the layer first.
    """
    rank = F.coalesce(*(F.when(F.col("layer") == layer, F.lit(-i)) for i, layer in enumerate(priority)), F.lit(-len(priority)))
    size = F.col("end") - F.col("start")
    best = F.struct(size, rank, -F.col("start"), -F.col("span_index")) if strategy == "union" else F.struct(rank, size, -F.col("start"), -F.col("span_index"))
    chains = with_island(spans, ["doc_id"], touching=False).groupBy("doc_id", "island")
    return chains.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("phi_type", best).alias("phi_type"), F.count("*").alias("n_merged")).drop("island")
