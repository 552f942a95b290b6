"""Detection, masking and running scores over streams of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillspan.operators.detect import detect
from quillspan.sources.rules import Rule


def read_documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def detect_stream(docs: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The same rows as over a table: detection looks at one document at a time."""
    return detect(docs, rules)


def rule_counts_stream(spans: DataFrame, at: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Spans per rule and event-time window, with a watermark."""
    return spans.withWatermark(at, late).groupBy(F.window(at, window), "rule_id").agg(F.count("*").alias("n_spans"))


def write_spans(spans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return spans.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def score_batches(docs: DataFrame, rules: Iterable[Rule], score: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Scores need whole documents: each micro-batch's spans go to ``score`` as a table."""
    rules = list(rules)
    return docs.writeStream.foreachBatch(lambda batch, n: score(detect(batch, rules), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
