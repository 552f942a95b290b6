"""Masking: unions replaced by tags, the geometry of the masked lines, and the way back to document offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.arrays import cut, let, places, running
from quillspan.operators.intervals import mask_union

_TAGS = "array<struct<col:int,len:int,doc_start:int,doc_end:int>>"
LINES = f"array<struct<length:int,doc_offset:int,tags:{_TAGS}>>"
LINE_NUMBER = 7


def context_window(text: Column, start: Column, end: Column, n: int = 120) -> Column:
    """The span with n characters either side, line feeds as spaces, and its place in that window."""
    left = F.greatest(start - n, F.lit(0))
    window = F.translate(F.substring(text, left + 1, F.least(end + n, F.length(text)) - left), "\n", " ")
    return F.struct(window.alias("window"), (start - left).alias("at"), (end - left).alias("to"))


def context_windows(spans: DataFrame, docs: DataFrame, n: int = 120) -> DataFrame:
    """The span's columns with window, at and to."""
    joined = spans.join(docs.select("doc_id", "text"), "doc_id")
    return joined.withColumn("__w", context_window(F.col("text"), F.col("start"), F.col("end"), n)).select(*spans.columns, "__w.window", "__w.at", "__w.to")


def render_line(number: Column, line: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), LINE_NUMBER, "0"), F.lit(" | "), line)


_UNITS = "array<struct<start:int,end:int,tag:string>>"
_EXTENTS = "array<struct<mstart:int,mend:int,dstart:int,dend:int>>"


def _masked(x: Column) -> Column:
    """masked_text and tags of a struct (text, units): units are in order and don't overlap."""
    units = x["units"]
    before = F.transform(units, lambda u, i: F.coalesce(F.get(units, i - 1)["end"], F.lit(0)))
    starts = F.transform(units, lambda u: u["start"])
    steps = F.transform(units, lambda u, i: u["start"] - F.coalesce(F.get(units, i - 1)["end"], F.lit(0)) + F.length(u["tag"]))
    tag = lambda ends: lambda u, i: F.struct((F.get(ends, i) - F.length(u["tag"])).alias("mstart"), F.get(ends, i).alias("mend"), u["start"].alias("dstart"), u["end"].alias("dend"))
    tags = let(running(steps), lambda ends: F.transform(units, tag(ends)))
    woven = let(cut(x["text"], before, starts), lambda plain: F.transform(plain, lambda p, i: F.concat(p, F.get(units, i)["tag"])))
    tail = F.substring(x["text"], F.coalesce(F.try_element_at(units, F.lit(-1))["end"], F.lit(0)) + 1, F.length(x["text"]))
    return F.struct(F.concat(F.array_join(woven, ""), tail).alias("masked_text"), tags.cast(_EXTENTS).alias("tags"))


def mask_documents(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, masked_text, tags (masked and document extents); a document without spans stays as it is."""
    units = mask_union(spans).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("units"))
    joined = docs.select("doc_id", "text").join(units, "doc_id", "left").withColumn("units", F.coalesce(F.col("units").cast(_UNITS), F.array().cast(_UNITS)))
    done = joined.withColumn("__s", let(F.struct("text", "units"), _masked))
    return done.select("doc_id", F.col("__s.masked_text").alias("masked_text"), F.coalesce("__s.tags", F.array().cast(_EXTENTS)).alias("tags"), F.length("text").alias("n_chars"))


def to_document(column: Column, tags: Column) -> Column:
    """A masked column as a document offset: every tag that ends at or before it counts; one that begins there doesn't."""
    inside = F.filter(tags, lambda t: t["mend"] <= column)
    return column + F.aggregate(inside, F.lit(0), lambda a, t: a + (t["dend"] - t["dstart"]) - (t["mend"] - t["mstart"]))


def _line_of_tags(x: Column) -> Column:
    """The line of each tag: line feeds between tags, added up; a tag holds none."""
    before = F.transform(x["tags"], lambda t, i: F.coalesce(F.get(x["tags"], i - 1)["mend"], F.lit(0)))
    feeds = F.transform(cut(x["text"], before, F.transform(x["tags"], lambda t: t["mstart"])), lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    return running(feeds)


def _own(x: Column) -> Column:
    """For each line the places of its tags, by a walk over the tags that begin a line's run."""
    of, n = x["of"], F.size(x["of"])
    heads = F.filter(places(n), lambda i: (i == 0) | (F.get(of, i) != F.get(of, i - 1)))

    def runs(h: Column) -> Column:
        last = F.size(h) - 1

        def run(at: Column, k: Column) -> Column:
            upto = F.when(k < last, F.get(h, k + 1)).otherwise(n)
            skipped = F.when(k < last, F.get(of, F.get(h, k + 1))).otherwise(F.size(x["parts"])) - F.get(of, at) - 1
            return F.concat(F.array(F.sequence(at, upto - 1)), F.array_repeat(F.array().cast("array<int>"), skipped))

        return F.concat(F.array_repeat(F.array().cast("array<int>"), F.coalesce(F.get(of, F.lit(0)), F.size(x["parts"]))), F.flatten(F.transform(h, run)))

    return let(heads, runs)


def _lines(x: Column) -> Column:
    """length, doc_offset and tags of each line of a struct (tags, parts, ends, own, grown); sums stand behind each entry."""
    tag = lambda begin: lambda i: let(
        F.get(x["tags"], i), lambda t: F.struct((t["mstart"] - begin).alias("col"), (t["mend"] - t["mstart"]).alias("len"), t["dstart"].alias("doc_start"), t["dend"].alias("doc_end"))
    )

    def line(part: Column, k: Column) -> Column:
        begin = F.coalesce(F.get(x["ends"], k - 1), F.lit(0))
        gone = F.coalesce(F.get(x["grown"], F.coalesce(F.get(x["upto"], k - 1), F.lit(0)) - 1), F.lit(0))
        return F.struct(F.length(part).alias("length"), (begin + gone).alias("doc_offset"), F.transform(F.get(x["own"], k), tag(begin)).alias("tags"))

    return F.transform(x["parts"], line)


def masked_lines(masked: DataFrame) -> DataFrame:
    """doc_id, lines: length, doc_offset and tags of each line; only a line feed ends a line.

    Lines and tags are both in order: one pass over each, whatever their numbers.
    """
    base = F.struct(F.col("masked_text").alias("text"), F.col("tags").alias("tags"), F.split("masked_text", "\n", -1).alias("parts"))

    def geometry(b: Column) -> Column:
        ends = running(F.transform(b["parts"], lambda p: F.length(p) + 1))
        grown = running(F.transform(b["tags"], lambda t: (t["dend"] - t["dstart"]) - (t["mend"] - t["mstart"])))
        own = let(F.struct(_line_of_tags(b).alias("of"), b["parts"].alias("parts")), _own)
        known = lambda o: F.struct(b["tags"].alias("tags"), b["parts"].alias("parts"), ends.alias("ends"), grown.alias("grown"), o.alias("own"), running(F.transform(o, lambda i: F.size(i))).alias("upto"))
        return let(own, lambda o: let(known(o), _lines))

    return masked.select("doc_id", let(base, geometry).cast(LINES).alias("lines"))
