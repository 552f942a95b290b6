"""Fill-in-middle texts by escaped marker injection.

A delimiter is escaped out of the text, ``regexp_replace`` then appends it after every
unit, counting it counts the units, and ``substring_index`` takes the parts between
two ranks.  Taken parts lose the injected delimiters and are unescaped.  Every step is
a built-in function of one row: no shuffle, and whole texts however long.

Defined results: a null text counts as empty; an empty text, or one that holds a
marker already, stays as it is (form ``plain``, cuts null).  The draws hang on the
document's id alone, so reruns and repeated rows agree; a null id draws as the empty
string does.  Columns other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of documents that are rearranged, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
UNIT = "[A-Za-z]+|[^A-Za-z]"
SEED = "1:"

# The delimiter and the escape.  Neither's escaped form holds a delimiter or a letter.
_MARK, _ESCAPE = "\x01", "\x02"
_AS_ESCAPE, _AS_MARK = _ESCAPE + "\x03", _ESCAPE + "\x04"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def inject(text: Column, unit: str = UNIT) -> Column:
    """The text, escaped, with a delimiter after each unit; an escaped character is one unit."""
    escaped = _swap(_swap(text, _ESCAPE, _AS_ESCAPE), _MARK, _AS_MARK)
    return F.regexp_replace(escaped, f"{_ESCAPE}[\x03\x04]|{unit}", f"$0{_MARK}")


def count(injected: Column) -> Column:
    """How many units there are."""
    return (F.length(injected) - F.length(_swap(injected, _MARK, ""))).cast("long")


def plain(part: Column) -> Column:
    """A part of an injected text as it was."""
    return _swap(_swap(_swap(part, _MARK, ""), _AS_MARK, _MARK), _AS_ESCAPE, _ESCAPE)


def _upto(injected: Column, k: Column) -> Column:
    """What stands before the k-th delimiter, or behind the k-th one from the end if k is negative."""
    return F.call_function("substring_index", injected, F.lit(_MARK), k.cast("int"))


def between(injected: Column, n: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """The first ``low`` units, those from there to the ``high``-th, and the rest of ``n``, all still injected."""
    return _upto(injected, low), _upto(_upto(injected, high), low - high), _upto(injected, high - n - 1)


def draws(doc_id: Column, k: int, seed: str = SEED) -> list[Column]:
    """k numbers below 2^32: the first groups of eight digits of a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(k)]


def assemble(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The output of a form."""
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "plain", text).when(form == "spm", spm).otherwise(psm)


def restore(form: Column, output: Column) -> Column:
    """The text from an output and its form alone; a marker can't arise where parts meet, as each begins with its only ``<``."""
    middle = F.substring_index(output, MIDDLE, -1)
    front = F.substring_index(F.substring(output, len(PREFIX) + 1, 2**31 - 1), MIDDLE, 1)
    psm = F.concat(F.substring_index(front, SUFFIX, 1), middle, F.substring_index(front, SUFFIX, -1))
    spm = F.concat(F.substring_index(front, PREFIX, -1), middle, F.substring_index(front, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null if plain) and output of every document."""
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), 4, seed)
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(marker)
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    counted = rows.select("*", form.alias("form"), inject(F.col("text")).alias("injected")).select("*", count(F.col("injected")).alias("n"))
    cuts = counted.select("*", (h1 % (F.col("n") + 1)).alias("one"), (h2 % (F.col("n") + 1)).alias("two")).select("*", F.least("one", "two").alias("low"), F.greatest("one", "two").alias("high"))
    parts = between(F.col("injected"), F.col("n"), F.col("low"), F.col("high"))
    cut = lambda part: F.when(F.col("form") != "plain", plain(part))
    parted = cuts.select("doc_id", "n", "form", "text", *(cut(p).alias(name) for p, name in zip(parts, ("prefix", "middle", "suffix"), strict=True)))
    output = assemble(F.col("form"), F.col("text"), F.col("prefix"), F.col("middle"), F.col("suffix"))
    return parted.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def digest_columns(made: DataFrame) -> DataFrame:
    """doc_id, n, form, sizes of the cut parts, and digests of the output and of the text restored from it."""
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
