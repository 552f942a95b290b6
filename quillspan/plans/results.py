"""Results of rounds as one partitioned table: sink, history, costs and caching as aggregates.

A row is one round of an arm: the axes corpus, detector, supervision, porting and
iteration (the partitions), leak_rate, the cost block and the caching block.  Any
number of runs may write at once, each into its own partitions; a round that is written
again takes the place of the one before and nothing else moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.model import AXES

ARM = ("corpus", "detector", "supervision", "porting")
COSTS = ("llm_calls", "prompt_tokens", "completion_tokens", "wall_seconds")
CACHING = ("boundary", "ttl", "read_tokens", "write_tokens")
SCHEMA = "leak_rate double, llm_calls long, prompt_tokens long, completion_tokens long, wall_seconds double, boundary string, ttl string, read_tokens long, write_tokens long, corpus string, detector string, supervision string, porting string, iteration int"


def _refuse(bad: Column, message: str, kept: Column) -> Column:
    """The value, or a refusal when it is read."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(kept)


def checked(rows: DataFrame) -> DataFrame:
    """Rows whose axes hold values of their vocabularies and whose blocks are whole; any other is refused when read."""
    out = rows
    for axis in ARM:
        out = out.withColumn(axis, _refuse(~F.coalesce(F.col(axis).isin(*AXES[axis]), F.lit(False)), f"not a {axis}", F.col(axis)))
    given = [F.col(c).isNotNull() for c in CACHING]
    some, every = F.greatest(*given), F.least(*given)
    out = out.withColumn("iteration", _refuse(~F.coalesce(F.col("iteration") >= 1, F.lit(False)), "iteration must be a whole number from 1", F.col("iteration").cast("int")))
    out = out.withColumn("llm_calls", _refuse(~F.least(*(F.col(c).isNotNull() for c in COSTS)), "a cost block lacks a value", F.col("llm_calls")))
    return out.withColumn("boundary", _refuse(some & ~every, "a caching block lacks a value", F.col("boundary")))


def write_rounds(rows: DataFrame, path: str) -> None:
    """Rounds into their partitions, each as one file; the other partitions stay."""
    picked = checked(rows).selectExpr(*(f"cast({n} as {t}) {n}" for n, t in (x.split() for x in SCHEMA.split(", "))))
    picked.repartition(*ARM, "iteration").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*ARM, "iteration").parquet(path)


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def history(rounds: DataFrame, upto: int | None = None) -> DataFrame:
    """axes, iteration, leak_rate, gain (over the round before); a round that is missing below an arm's last (or below ``upto``) or stands twice is refused when read."""
    within = rounds if upto is None else rounds.where(F.col("iteration") <= upto)
    arm = Window.partitionBy(*ARM)
    order = arm.orderBy("iteration")
    last = F.max("iteration").over(arm) if upto is None else F.lit(upto)
    gap = (F.row_number().over(order) != F.col("iteration")) | (F.count("*").over(arm) != last)
    told = within.withColumn("gap", gap).withColumn("gain", F.lag("leak_rate").over(order) - F.col("leak_rate"))
    return told.select(*ARM, _refuse(F.col("gap"), "a round has no metrics", F.col("iteration")).alias("iteration"), "leak_rate", "gain")


def sum_costs(blocks: DataFrame, keys: Sequence[str] = ARM) -> DataFrame:
    """keys and the cost block added up (calls to rounds, or rounds to arms); a block that lacks a value is refused when read."""
    whole = F.bool_and(F.least(*(F.col(c).isNotNull() for c in COSTS)))
    added = blocks.groupBy(*keys).agg(whole.alias("whole"), *(F.sum(c).alias(c) for c in COSTS))
    return added.select(*keys, _refuse(~F.col("whole"), "a cost block lacks a value", F.col("llm_calls")).alias("llm_calls"), "prompt_tokens", "completion_tokens", F.round("wall_seconds", 3).alias("wall_seconds"))


def sum_caching(blocks: DataFrame, keys: Sequence[str] = ARM) -> DataFrame:
    """keys, enabled, boundary, ttl and tokens added up over the calls that were cached; null where none was.

    Cached calls of one key that disagree on boundary or lifetime, and blocks that lack a
    value, are refused when read.
    """
    given = [F.col(c).isNotNull() for c in CACHING]
    some, whole = F.greatest(*given), F.least(*given)
    added = blocks.groupBy(*keys).agg(
        F.bool_or(some).alias("enabled"),
        F.bool_and(whole | ~some).alias("whole"),
        *(F.min(c).alias(c) for c in CACHING[:2]),
        *(F.max(c).alias(f"last_{c}") for c in CACHING[:2]),
        *(F.sum(c).alias(c) for c in CACHING[2:]),
    )
    one = F.col("boundary").eqNullSafe(F.col("last_boundary")) & F.col("ttl").eqNullSafe(F.col("last_ttl"))
    boundary = F.when(~F.col("whole"), F.raise_error(F.lit("a caching block lacks a value"))).otherwise(_refuse(~one, "caching settings differ between calls", F.col("boundary")))
    return added.select(*keys, F.when(F.col("enabled"), True).alias("enabled"), boundary.alias("boundary"), "ttl", "read_tokens", "write_tokens")
