"""Array arithmetic in the JVM whose work grows with the array, not with its square.

A fold that appends to an array copies it at each step.  Here folds run inside blocks
of about sqrt(n) entries and over the blocks, and a value that a lambda looks at is
bound once by ``let``, or Spark would compute it anew for every entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTS = "array<int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(n: Column) -> Column:
    """0, 1, ... n-1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast(_INTS))


def _sums(values: Column) -> Column:
    """Running sums of a short array."""
    add = lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["out"], F.array(acc["t"] + x)).alias("out"))
    return F.aggregate(values, F.struct(F.lit(0).alias("t"), F.array().cast(_INTS).alias("out")), add)["out"]


def running(values: Column) -> Column:
    """Running sums of an array of ints: what stands up to and at each place."""

    def blocks(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        return let(width, lambda w: F.transform(places(F.ceil(F.size(v) / w)), lambda b: _sums(F.slice(v, b * w + 1, w))))

    def shifted(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.element_at(p, -1))
        return let(_sums(totals), lambda t: F.flatten(F.transform(parts, lambda p, b: F.transform(p, lambda x: x + F.coalesce(F.get(t, b - 1), F.lit(0))))))

    return let(values.cast(_INTS), lambda v: F.when(F.size(v) > 0, let(blocks(v), shifted)).otherwise(F.array().cast(_INTS)))


def cut(text: Column, starts: Column, ends: Column) -> Column:
    """The substrings at ascending ranges that don't overlap (code points, end exclusive).

    A string is walked from its start to reach a place in it, so ranges are cut out of
    blocks of the text, each of which holds about sqrt(n) of them.
    """

    def ranges(r: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(r["s"]))), F.lit(1)).cast("int")

        def block(w: Column) -> Callable[[Column], Column]:
            def one(b: Column) -> Column:
                first, last = F.get(r["s"], b * w), F.get(r["e"], F.least((b + 1) * w, F.size(r["s"])) - 1)
                own = F.struct(F.substring(r["t"], first + 1, last - first).alias("t"), first.alias("at"), F.slice(r["s"], b * w + 1, w).alias("s"), F.slice(r["e"], b * w + 1, w).alias("e"))
                return let(own, lambda o: F.transform(o["s"], lambda s, i: F.substring(o["t"], s - o["at"] + 1, F.get(o["e"], i) - s)))

            return one

        return F.flatten(let(width, lambda w: F.transform(places(F.ceil(F.size(r["s"]) / w)), block(w))))

    bound = F.struct(text.alias("t"), starts.cast(_INTS).alias("s"), ends.cast(_INTS).alias("e"))
    return let(bound, lambda r: F.when(F.size(r["s"]) > 0, ranges(r)).otherwise(F.array().cast("array<string>")))
