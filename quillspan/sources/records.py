"""Prediction and error files: JSON lines with closed fields, in a stable order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.model import ERROR_FIELDS, ERRORS, PREDICTED, SPAN_FIELDS


def _read(spark: SparkSession, path: str, schema: str, fields: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """Every line must be one object with exactly these fields; coordinates must be whole numbers."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    closed = F.array_sort(keys) == F.array(*(F.lit(x) for x in sorted(fields)))
    whole = F.lit(True)
    for f in ("start", "end"):
        whole = whole & F.col("value").rlike(rf'"{f}"\s*:\s*[0-9]+\s*[,}}]')
    parsed = raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.coalesce(closed & whole, F.lit(False)).alias("ok"))
    present = F.lit(True)
    for f in needed:
        present = present & F.col(f"r.{f}").isNotNull()
    checked = parsed.select(F.when(F.col("ok") & present, F.col("r")).otherwise(F.raise_error(F.lit("a row's fields are not the closed set")).cast(parsed.schema["r"].dataType)).alias("r"))
    return checked.select("r.*")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, PREDICTED, SPAN_FIELDS, ("doc_id", "start", "end", "phi_type", "layer", "detector"))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, ERRORS, ERROR_FIELDS, ERROR_FIELDS)


def _write(df: DataFrame, path: str, single: bool) -> None:
    (df.coalesce(1) if single else df).write.option("ignoreNullFields", "false").json(path)


def write_spans(pred: DataFrame, path: str, single: bool = True) -> None:
    """The nine fields alone, sorted; one file unless told otherwise (at scale leave single off: files are in order)."""
    with_actions = pred if "agent_actions" in pred.columns else pred.withColumn("agent_actions", F.array().cast("array<struct<agent:string,action:string,call_id:string>>"))
    _write(with_actions.select(*SPAN_FIELDS).orderBy("doc_id", "start", "end", F.coalesce("rule_id", F.lit(""))), path, single)


def write_errors(errors: DataFrame, path: str, single: bool = True) -> None:
    _write(errors.select(*ERROR_FIELDS).orderBy("doc_id", "start", "end", "phi_type", "kind", "span_index"), path, single)
