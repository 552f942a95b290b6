"""Span tables derived by arithmetic from lineitem, so that every engine computes the same input.

A document is eight consecutive orders.  Lines with return flag N are gold, the others
predictions; start, length, type, layer and rule follow from the line's numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("NAME", "DATE", "ID")
LAYERS = ("regex_checksum", "context_cue", "gazetteer", "tagger")
LENGTH = 97


def spread(table: DataFrame) -> DataFrame:
    """A table that a scan would read in fewer tasks than there are cores (one row group, say), dealt over all of them.

    Any table of more splits than cores stays as it is, so nothing large is moved.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    splits = table._jdf.queryExecution().toRdd().getNumPartitions()
    return table.repartition(cores) if splits < cores else table


def _pick(values: tuple[str, ...], index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = (F.col("l_partkey") % LENGTH).cast("int")
    return t.select(
        F.floor(F.col("l_orderkey") / 8).cast("string").alias("doc_id"),
        ((F.col("l_orderkey") % 8 * 8 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey") % 10_000 * 1000 + F.col("l_suppkey") % 1000).cast("int").alias("span_index"),
        start.alias("start"),
        (start + 1 + (F.col("l_quantity").cast("int") % 9)).cast("int").alias("end"),
        _pick(TYPES, F.col("l_linenumber")).alias("phi_type"),
        _pick(LAYERS, F.col("l_suppkey")).alias("layer"),
        (F.col("l_suppkey") % 4).alias("lk"),
        (F.col("l_partkey") % 11 == 0).alias("excluded"),
        (F.col("l_returnflag") == "N").alias("is_gold"),
    )


def gold(spark: SparkSession, sf_dir: str, everything: bool = False) -> DataFrame:
    out = lines(spark, sf_dir).where("is_gold").select("doc_id", "span_index", "start", "end", "phi_type", "excluded")
    return out if everything else out.where("not excluded").drop("excluded")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("lk") < 3, F.concat(F.lit("es:r"), F.col("lk").cast("string"), F.lit("_"), (F.col("span_index") % 3).cast("string")))
    return lines(spark, sf_dir).where("not is_gold").withColumn("rule_id", rule).select("doc_id", "span_index", "start", "end", "phi_type", "layer", "rule_id")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id").distinct()


SQL = """
lines as (select cast(l_orderkey // 8 as varchar) doc_id, cast((l_orderkey % 8 * 8 + l_linenumber) * 10000000 + l_partkey % 10000 * 1000 + l_suppkey % 1000 as int) span_index,
  cast(l_partkey % 97 as int) "start", cast(l_partkey % 97 + 1 + cast(l_quantity as int) % 9 as int) "end",
  ['NAME','DATE','ID'][l_linenumber % 3 + 1] phi_type,
  ['regex_checksum','context_cue','gazetteer','tagger'][l_suppkey % 4 + 1] layer, l_suppkey % 4 lk,
  l_partkey % 11 = 0 excluded, l_returnflag = 'N' is_gold from lineitem),
gold as (select doc_id, span_index, "start", "end", phi_type from lines where is_gold and not excluded),
pred as (select doc_id, span_index, "start", "end", phi_type, layer,
  case when lk < 3 then 'es:r' || lk || '_' || (span_index % 3) end rule_id from lines where not is_gold)"""
