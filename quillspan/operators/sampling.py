"""Stratified, seeded samples of error spans."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.model import ERROR_FIELDS, ERRORS, NON_TARGET_TYPES, SpanError, check_value

# Sample size, characters of context, least of a type, base seed, first practice round.
N_SPANS, CONTEXT, LEAST_PER_TYPE, BASE_SEED, PRACTICE_FROM = 40, 120, 1, 20260805, 900
SCHEME = "error-sample/v1"  #: give the scheme of an earlier series to repeat its draws
KEY = ("doc_id", "start", "end", "phi_type", "kind", "span_index")


def _first_eight(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def sample_seed(corpus: str, iteration: int, scheme: str = SCHEME, base: int = BASE_SEED) -> int:
    check_value("corpus", corpus)
    if isinstance(iteration, bool) or not isinstance(iteration, int) or iteration < 1:
        raise SpanError("iteration must be a whole number from 1")
    return _first_eight("\0".join((scheme, str(base), corpus, str(iteration))))


def check_iteration(iteration: int, practice: bool) -> None:
    """Practice rounds are numbered from PRACTICE_FROM on, others below it."""
    if practice != (iteration >= PRACTICE_FROM):
        raise SpanError("practice rounds and numbered rounds don't mix")


def allocate(counts: Mapping[str, int], n: int, least: int = LEAST_PER_TYPE) -> dict[str, int]:
    """Largest-remainder shares of n with a reserve for each type, none above its count.

    If the reserves alone exceed n the rarest types go (ties by name).  Remainders are
    handed out by descending fraction, ties by name, round and round.
    """
    left = {t: c for t, c in counts.items() if c > 0}
    while left and sum(min(least, c) for c in left.values()) > n:
        del left[min(left, key=lambda t: (left[t], t))]
    out = {t: min(least, c) for t, c in left.items()}
    rest, pool = n - sum(out.values()), {t: c - out[t] for t, c in left.items()}
    total = sum(pool.values())
    if rest <= 0 or total == 0:
        return out
    exact = {t: rest * c / total for t, c in pool.items()}
    given = {t: min(int(x), pool[t]) for t, x in exact.items()}
    order = sorted(pool, key=lambda t: (-(exact[t] - int(exact[t])), t))
    spare = min(rest, total) - sum(given.values())
    while spare > 0:
        for t in order:
            if spare and given[t] < pool[t]:
                given[t] += 1
                spare -= 1
    return {t: out[t] + given[t] for t in out}


def eligible_errors(errors: DataFrame) -> DataFrame:
    return errors.select(*ERROR_FIELDS).where(~F.col("phi_type").isin(*NON_TARGET_TYPES)).distinct()


def _quota(pool: DataFrame, n: int) -> dict[str, int]:
    return allocate({r["phi_type"]: r["n"] for r in pool.groupBy("phi_type").agg(F.count("*").alias("n")).collect()}, n)


def _kept(drawn: DataFrame, pool: DataFrame) -> DataFrame:
    """The few rows of a draw as a table of its own; the pool that they came from is let go."""
    rows = drawn.select(*ERROR_FIELDS).collect()  # at most the quota, which the caller names
    pool.unpersist()
    return drawn.sparkSession.createDataFrame(rows, ERRORS)


def draw_hash(errors: DataFrame, corpus: str, iteration: int, n: int = N_SPANS, practice: bool = False, scheme: str = SCHEME) -> DataFrame:
    """Of each type the quota's number of spans with the smallest hash of seed and span: wholly distributed."""
    check_iteration(iteration, practice)
    pool = eligible_errors(errors).persist()  # counted first, then drawn from
    quota = _quota(pool, n)
    rank = F.row_number().over(Window.partitionBy("phi_type").orderBy(F.sha2(F.concat_ws("|", F.lit(str(sample_seed(corpus, iteration, scheme))), *(F.col(k).cast("string") for k in KEY)), 256)))
    most = F.coalesce(*(F.when(F.col("phi_type") == t, F.lit(q)) for t, q in sorted(quota.items())), F.lit(0))
    # the fixed bound lets each task leave all but n rows of a type before they are moved
    return _kept(pool.withColumn("__rank", rank).where((F.col("__rank") <= n) & (F.col("__rank") <= most)), pool)


#: Stretches that the sorted pool is cut into, about, to find rows by rank.
STRETCHES = 256


def _bounds(pool: DataFrame, total: int, stretches: int) -> dict[str, list[tuple]]:
    """Of each type places in the order of the pool, from a small sample by hash; they need not be even, only the same all along."""
    share = min(1.0, 8 * stretches / max(total, 1))
    seen = pool.where(F.pmod(F.xxhash64(*KEY), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("phi_type", "doc_id", "start", "end").collect()
    out: dict[str, list[tuple]] = {}
    for t in {r["phi_type"] for r in seen}:
        own = sorted((r["doc_id"].encode(), r["start"], r["end"], r["doc_id"]) for r in seen if r["phi_type"] == t)
        out[t] = [(d, s, e) for _, s, e, d in own[8::8]]
    return out


def _rank(bounds: Column, key: Column, most: int) -> Column:
    """How many of the sorted bounds (``most`` of them at most) don't lie behind the key: halved step by step, not looked through."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(most.bit_length())))).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def draw_compat(errors: DataFrame, corpus: str, iteration: int, n: int = N_SPANS, practice: bool = False, scheme: str = SCHEME, stretches: int = STRETCHES) -> DataFrame:
    """The draw of one Mersenne Twister per type over the sorted pool.

    The generator needs the pool's size alone: it names ranks.  The pool is cut into
    stretches of its order, whose counts tell where each rank lies, and only the
    stretches that hold one are sorted, each in a task of its own.
    """
    check_iteration(iteration, practice)
    spark, pool = errors.sparkSession, eligible_errors(errors).persist()
    sizes = {r["phi_type"]: r["n"] for r in pool.groupBy("phi_type").agg(F.count("*").alias("n")).collect()}
    quota, seed = allocate(sizes, n), sample_seed(corpus, iteration, scheme)
    ranks = {t: sorted(random.Random(_first_eight(f"{seed}\0{t}")).sample(range(sizes[t]), min(q, sizes[t]))) for t, q in quota.items()}
    bounds = _bounds(pool, sum(sizes.values()), stretches)
    table = spark.createDataFrame([(t, bounds.get(t, [])) for t in sizes], "t string, bounds array<struct<doc_id:string,start:int,end:int>>")
    place = _rank(F.col("bounds"), F.struct("doc_id", "start", "end"), max(map(len, bounds.values()), default=0))
    # a row for each type, and a stretch has a place in a list of about STRETCHES: both are small whatever the pool
    cut = pool.join(F.broadcast(table), F.col("phi_type") == F.col("t")).withColumn("stretch", place).drop("bounds", "t")
    counts = sorted((r["phi_type"], r["stretch"], r["n"]) for r in cut.groupBy("phi_type", "stretch").agg(F.count("*").alias("n")).collect())
    wanted, begin = [], dict.fromkeys(sizes, 0)
    for t, stretch, size in counts:
        wanted += [(t, stretch, r - begin[t] + 1) for r in ranks.get(t, ()) if begin[t] <= r < begin[t] + size]
        begin[t] += size
    if not wanted:
        return _kept(pool.limit(0), pool)
    asked = spark.createDataFrame(wanted, "phi_type string, stretch int, rank int")
    some = cut.join(F.broadcast(asked.select("phi_type", "stretch").distinct()), ["phi_type", "stretch"], "left_semi")
    order = Window.partitionBy("phi_type", "stretch").orderBy(*(F.asc_nulls_last(k) for k in KEY))
    return _kept(some.withColumn("rank", F.row_number().over(order)).join(F.broadcast(asked), ["phi_type", "stretch", "rank"], "left_semi"), pool)


def practice_pool(pool: DataFrame, reserved: DataFrame) -> DataFrame:
    """The pool without the spans that a numbered round has drawn."""
    return pool.join(reserved.select(*KEY), list(KEY), "left_anti")


def initial_error_pool(gold: DataFrame) -> DataFrame:
    """Before any round all gold in scope counts as missed."""
    return gold.where(~F.col("excluded")).withColumn("kind", F.lit("missed")).select(*ERROR_FIELDS)


def pool_summary(pool: DataFrame, drawn: DataFrame) -> DataFrame:
    """phi_type, in_pool, drawn, docs."""
    a = pool.groupBy("phi_type").agg(F.count("*").alias("in_pool"))
    b = drawn.groupBy("phi_type").agg(F.count("*").alias("drawn"), F.count_distinct("doc_id").alias("docs"))
    return a.join(b, "phi_type", "left").na.fill(0, ["drawn", "docs"])


def provenance(corpus: str, iteration: int, n: int, drawn: int, scheme: str = SCHEME) -> dict:
    return {"scheme": scheme, "base_seed": BASE_SEED, "seed": sample_seed(corpus, iteration, scheme), "corpus": corpus, "iteration": iteration, "n": n, "drawn": drawn, "practice": iteration >= PRACTICE_FROM}


