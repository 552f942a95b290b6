"""Validation of an auditor's flags against masked lines, and what is counted of them.

The payload is one JSON object {"flags": [...]}.  Checks run in a fixed order and the
first that fails names the refusal; what passes is translated to document offsets.
JSON is looked at value by value, as text, so a true is never a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.model import NON_TARGET_TYPES, PHI_TYPES

FLAG_KEYS = ("line", "start", "end", "phi_type", "score")
ALLOWED = tuple(t for t in PHI_TYPES if t not in NON_TARGET_TYPES)
_WHOLE = r"^-?(0|[1-9][0-9]*)$"
_NUMBER = r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$"


def _whole(v: Column) -> Column:
    return F.coalesce(v.rlike(_WHOLE) & v.try_cast("int").isNotNull(), F.lit(False))


def line_offset(column: Column, line: Column) -> Column:
    """A column of a masked line as a document offset."""
    before = F.filter(line["tags"], lambda t: t["col"] + t["len"] <= column)
    return line["doc_offset"] + column + F.aggregate(before, F.lit(0), lambda a, t: a + (t["doc_end"] - t["doc_start"]) - t["len"])


def checked_line(line: Column) -> Column:
    """A masked line whose tags are in order; anything else is refused when read, and never put in order.

    Tags lie within the line, ascending and apart, and each stands for some stretch of
    the document: offsets would be wrong without a sign of it otherwise.
    """
    tags = line["tags"]
    before = lambda i: F.coalesce(F.get(tags, i - 1)["col"] + F.get(tags, i - 1)["len"], F.lit(0))
    placed = F.transform(tags, lambda t, i: (t["col"] >= before(i)) & (t["len"] > 0) & (t["col"] + t["len"] <= line["length"]) & (t["doc_start"] >= 0) & (t["doc_start"] < t["doc_end"]))
    fine = (line["length"] >= 0) & (line["doc_offset"] >= 0) & F.forall(placed, lambda x: F.coalesce(x, F.lit(False)))
    return F.when(line.isNull() | F.coalesce(fine, F.lit(False)), line).otherwise(F.raise_error(F.lit("a masked line's tags are not in order")).cast("struct<length:int,doc_offset:int,tags:array<struct<col:int,len:int,doc_start:int,doc_end:int>>>"))


def sort_flags(flags: DataFrame) -> DataFrame:
    return flags.orderBy("doc_id", "start", "end", "phi_type")


def validate(responses: DataFrame, lines: DataFrame) -> DataFrame:
    """responses: doc_id, response.  doc_id, flag_index, reason, start, end, phi_type, score: reason null for flags that stand."""
    top = F.from_json("response", "map<string,string>")
    whole = F.json_object_keys("response")
    listed = F.from_json(top["flags"], "array<string>")
    good = whole.isNotNull() & (F.size(whole) == 1) & F.coalesce(whole[0] == "flags", F.lit(False)) & top["flags"].rlike(r"^\s*\[") & listed.isNotNull()
    flat = (
        responses.join(lines, "doc_id", "left")
        .withColumn("__good", F.coalesce(good, F.lit(False)))
        .select("doc_id", "lines", "__good", F.posexplode(F.when(F.col("__good"), listed).otherwise(F.array(F.lit(None).cast("string")))).alias("flag_index", "flag"))
    )
    # get_json_object gives strings without their quotes: a quoted number differs in the raw object
    raw = lambda k: F.get(F.regexp_extract_all("flag", F.lit(rf'"{k}"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}}\s]+)'), F.lit(1)), F.lit(0))
    f = flat.select("doc_id", "lines", "flag_index", "flag", "__good", F.json_object_keys("flag").alias("keys"), *(raw(k).alias(f"f_{k}") for k in FLAG_KEYS))
    keys = F.col("keys")
    known = (F.size(F.array_except(keys, F.array(*map(F.lit, FLAG_KEYS)))) == 0) & (F.size(F.array_intersect(keys, F.array(*map(F.lit, FLAG_KEYS[:4])))) == 4) & (F.size(keys) == F.size(F.array_distinct(keys)))
    score = F.col("f_score").try_cast("double")
    scored = F.when(F.array_contains(keys, "score"), F.col("f_score").rlike(_NUMBER) & score.between(0, 1)).otherwise(F.lit(True))
    formed = F.col("__good") & keys.isNotNull() & known & _whole(F.col("f_line")) & _whole(F.col("f_start")) & _whole(F.col("f_end")) & F.col("f_phi_type").startswith('"') & scored
    typed = f.select(
        "doc_id",
        "lines",
        "flag_index",
        F.coalesce(formed, F.lit(False)).alias("formed"),
        *(F.col(f"f_{k}").try_cast("int").alias(k) for k in ("line", "start", "end")),
        F.regexp_replace("f_phi_type", '^"|"$', "").alias("phi_type"),
        F.coalesce(score, F.lit(1.0)).alias("score"),
    ).withColumn("row", F.when((F.col("line") >= 0) & (F.col("line") < F.size("lines")), checked_line(F.get("lines", F.col("line")))))
    row = F.col("row")
    touched = F.exists(row["tags"], lambda t: (F.col("start") < t["col"] + t["len"]) & (t["col"] < F.col("end")))
    reason = (
        F.when(~F.col("formed"), "malformed")
        .when(row.isNull(), "out_of_range")
        .when((F.col("end") <= F.col("start")) | (F.col("end") > row["length"]), "crosses_a_line")
        .when(F.col("start") < 0, "out_of_range")
        .when(~F.col("phi_type").isin(*ALLOWED), "undeclared_phi_type")
        .when(touched, "inside_a_mask_tag")
    )
    judged = typed.withColumn("reason", reason)
    kept = lambda c: F.when(F.col("reason").isNull(), c)
    return judged.select(
        "doc_id", "flag_index", "reason", kept(line_offset(F.col("start"), row)).alias("start"), kept(line_offset(F.col("end"), row)).alias("end"), kept(F.col("phi_type")).alias("phi_type"), kept(F.col("score")).alias("score")
    )


def audit_report(audited: DataFrame, judged: DataFrame) -> DataFrame:
    """kind (type, refusal, documents), name, n: flags by type, refusals by reason, documents with and without flags."""
    stands = judged.where("reason is null")
    types = stands.groupBy(F.lit("type").alias("kind"), F.col("phi_type").alias("name")).agg(F.count("*").alias("n"))
    reasons = judged.where("reason is not null").groupBy(F.lit("refusal").alias("kind"), F.col("reason").alias("name")).agg(F.count("*").alias("n"))
    has = stands.select("doc_id").distinct().withColumn("has", F.lit(True))
    docs = audited.select("doc_id").distinct().join(has, "doc_id", "left").groupBy(F.lit("documents").alias("kind"), F.when(F.col("has"), "flagged").otherwise("unflagged").alias("name")).agg(F.count("*").alias("n"))
    return types.unionByName(reasons).unionByName(docs)


def mark_sample(sample: DataFrame, flags: DataFrame) -> DataFrame:
    """The sampled errors with flag_index, the lowest flag that overlaps each (null for none)."""
    f = flags.where("reason is null").select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("flag_index").alias("i"))
    met = sample.join(f, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left")
    return met.groupBy(*sample.columns).agg(F.min("i").alias("flag_index"))


def unmatched_flags(sample: DataFrame, flags: DataFrame) -> DataFrame:
    """Flags that overlap no sampled error."""
    s = sample.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
    return flags.where("reason is null").join(s, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
