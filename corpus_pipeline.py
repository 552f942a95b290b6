"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm import kneser, mixing, pieces, secrets, tiles
from quillspan.llm.store import new_path, settle

#: Near copies of the stage; op2 has 3 and 90 by its own contract.
STAGE_SHINGLE = 5
STAGE_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity is that of trusted text."""
    return kneser.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the table lacks, whatever their case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def _plain(docs: DataFrame) -> list[Column]:
    """All columns in types that can be hashed: maps and whatever holds parts as JSON that keeps nulls."""
    out = []
    for field in docs.schema:
        c = F.col(f"`{field.name.replace('`', '``')}`")
        whole = field.dataType.typeName() in ("array", "map", "struct", "variant")
        out.append(F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if whole else c)
    return out


def row_hash(docs: DataFrame) -> Column:
    """64 bits of all columns, each with whether it is null: a short name for a row, which different rows may share by chance."""
    return F.xxhash64(*(x for c in _plain(docs) for x in (c.isNull(), c)))


def row_key(docs: DataFrame) -> Column:
    """A SHA-256 digest of all columns, null-safe and with their lengths: rows share it only if they repeat."""
    parts = (c.cast("binary") if c_type == "binary" else c.cast("string").cast("binary") for c, c_type in zip(_plain(docs), (t for _, t in docs.dtypes), strict=True))
    coded = (F.coalesce(F.concat(F.concat(F.lit("+"), F.octet_length(p).cast("string"), F.lit(":")).cast("binary"), p), F.lit("-").cast("binary")) for p in parts)
    return F.unhex(F.sha2(F.concat(*coded), 256))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8) one row, of those with the smallest id; a row without words and id stays.

    Rows that repeat in all columns count once.  All columns come back as they are,
    whatever their names and types.
    """
    row, key, component = fresh(docs, "row", "key", "component_id")
    rows = docs.withColumn(row, row_hash(docs))
    groups = tiles.jaccard_components(rows, doc_id=row, k=STAGE_SHINGLE, percent=STAGE_PERCENT).select(F.col("doc_id").alias(row), F.col("component_id").alias(component))
    members = groups.distinct().join(rows.select(row, "doc_id").distinct(), row)
    first = F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias(row)
    stay = members.groupBy(component).agg(first).select(row)
    bare = F.col("doc_id").isNull() & (F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) == "")
    wide = rows.where(~bare).withColumn(key, row_key(docs))
    # both names of the rows that stay, so that whole rows are dealt out once, for dropping repeats, and join as they lie
    named = stay.join(wide.select(row, key).distinct(), row)
    once = wide.dropDuplicates([row, key]).join(named, [row, key], "left_semi")
    return once.select(*docs.columns).unionByName(rows.where(bare).select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark."""
    return secrets.redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows that repeat in all columns as often as all of them together.

    The mix knows rows by 64 bits.  What it takes of such a name, source and size is
    dealt out over the rows that share them, in proportion to how often each stands in
    the table, so that none is taken for another.
    """
    key, epochs, epoch = fresh(docs, "key", "epochs", "epoch")
    wide = docs.withColumn(key, row_key(docs))
    sized = settle(wide.select(row_hash(docs).alias("doc_id"), F.col("source").cast("string").alias("src"), mixing.word_count(F.col("text")).alias("size"), F.col(key).alias("key")), "rows")
    taken = mixing.mix(docs, sized=sized.select("doc_id", "src", "size")).groupBy("doc_id", "src", "size").agg(F.sum("epochs").alias("taken"))
    kinds = sized.groupBy("doc_id", "src", "size", "key").agg(F.count("*").alias("c"))
    same = Window.partitionBy("doc_id", "src", "size")
    upto = F.sum("c").over(same.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    counted = kinds.withColumn("upto", upto).withColumn("all", F.sum("c").over(same))
    both = counted.join(taken.withColumnsRenamed({"doc_id": "d", "src": "s", "size": "z"}), (F.col("doc_id") == F.col("d")) & F.col("src").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    share = F.expr("taken * upto div all - taken * (upto - c) div all").cast("int")
    often = both.select(F.col("key").alias(key), share.alias(epochs)).where(F.col(epochs) > 0)
    once = wide.dropDuplicates([key]).join(often, key)
    return once.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(epochs)))).select(*docs.columns)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of a sampled segmentation of its text."""
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", sampled_pieces),
]

#: Training a model and sampling segmentations aren't SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
