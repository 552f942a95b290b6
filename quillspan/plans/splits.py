"""Frozen splits: summaries, leakage between folds, digests, verification."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.model import SPLITS, SpanError
from quillspan.sources.scratch import written

# A document's stem, and the types that tell whether two documents describe one person.
STEM = r"^(.+)[-_]([0-9]+|[A-Za-z]+)$"
GROUPING = {
    "es-meddocan": {
        "name": ("NOMBRE_SUJETO_ASISTENCIA",),
        "record": ("ID_SUJETO_ASISTENCIA", "ID_ASEGURAMIENTO", "ID_CONTACTO_ASISTENCIAL"),
        "date": ("FECHAS",),
    }
}
PERCENTILES = (0.05, 0.5, 0.95)


def token_count(text):
    """Tokens between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")).cast("long")


def nearest_rank(sizes: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float] = PERCENTILES) -> DataFrame:
    """keys, p, value: the element at place min(n - 1, int(p * n)) of each group's sorted values.

    Values are counted first; the place is found in the counts' running sum.
    """
    from pyspark.sql import Window

    counts = sizes.groupBy(*keys, F.col(value).alias("__value")).agg(F.count("*").alias("__count"))
    order = Window.partitionBy(*keys).orderBy("__value")
    upto = F.sum("__count").over(order.rowsBetween(Window.unboundedPreceding, 0))
    run = counts.withColumn("__upto", upto).withColumn("__all", F.sum("__count").over(Window.partitionBy(*keys)))
    asked = run.withColumn("p", F.explode(F.array(*map(F.lit, shares))))
    place = F.least(F.col("__all") - 1, F.floor(F.col("p") * F.col("__all")))
    hit = asked.where((F.col("__upto") > place) & (F.col("__upto") - F.col("__count") <= place))
    return hit.select(*keys, "p", F.col("__value").alias("value"))


def fold_summary(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """split (null: all), docs, spans, in_scope, excluded, tokens."""
    spans = gold.groupBy("doc_id").agg(F.count("*").alias("s"), F.sum((~F.col("excluded")).cast("long")).alias("i"))
    base = docs.select("doc_id", "split", token_count(F.col("text")).alias("t")).join(spans, "doc_id", "left").na.fill(0, ["s", "i"])
    return base.rollup("split").agg(F.count("*").alias("docs"), F.sum("s").alias("spans"), F.sum("i").alias("in_scope"), (F.sum("s") - F.sum("i")).alias("excluded"), F.sum("t").alias("tokens"))


def fold_types(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """split, kind, name, n: spans in scope by phi_type, excluded ones by their own type (subtype)."""
    named = gold.join(docs.select("doc_id", "split"), "doc_id")
    kind = F.when(F.col("excluded"), "excluded_type").otherwise("phi_type")
    name = F.when(F.col("excluded"), F.col("subtype")).otherwise(F.col("phi_type"))
    return named.groupBy("split", kind.alias("kind"), name.alias("name")).agg(F.count("*").alias("n"))


def fold_tokens(docs: DataFrame, shares: Sequence[float] = PERCENTILES) -> DataFrame:
    """split, p, value: tokens of a document at places of each fold's order."""
    return nearest_rank(docs.select("split", token_count(F.col("text")).alias("n")), ["split"], "n", shares)


def with_stem(docs: DataFrame) -> DataFrame:
    return docs.withColumn("stem", F.when(F.col("doc_id").rlike(STEM), F.regexp_extract("doc_id", STEM, 1)).otherwise(F.col("doc_id")))


def stem_groups(docs: DataFrame, least: int = 2) -> DataFrame:
    """stem, n_docs of stems with at least that many documents."""
    return with_stem(docs).groupBy("stem").agg(F.count_distinct("doc_id").alias("n_docs")).where(F.col("n_docs") >= least)


def grouping_audit(docs: DataFrame, gold: DataFrame, roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """Candidate stems with, per role, whether all their documents share a surface; grouped when the name and a record or date are shared."""
    stems = with_stem(docs.select("doc_id"))
    groups = stem_groups(docs).select(F.col("stem").alias("g"), "n_docs")
    role = F.coalesce(*(F.when(F.col("subtype").isin(*types), F.lit(name)) for name, types in roles.items()))
    surfaces = gold.withColumn("role", role).where("role is not null").select("doc_id", "role", F.trim("surface").alias("surface")).distinct()
    members = stems.join(groups, F.col("stem") == F.col("g"))
    shared = surfaces.join(members, "doc_id").groupBy("stem", "n_docs", "role", "surface").agg(F.count("*").alias("k")).where("k = n_docs")
    flags = shared.groupBy("stem").agg(*(F.max((F.col("role") == r).cast("int")).alias(r) for r in roles))
    out = groups.withColumnRenamed("g", "stem").join(flags, "stem", "left").na.fill(0, list(roles))
    return out.select("stem", "n_docs", *((F.col(r) == 1).alias(f"shared_{r}") for r in roles), ((F.col("name") == 1) & ((F.col("record") == 1) | (F.col("date") == 1))).alias("grouped"))


def crossing_summary(docs: DataFrame) -> DataFrame:
    """folds (joined by +), stems: candidate stems by the folds their documents lie in."""
    each = with_stem(docs).groupBy("stem").agg(F.count_distinct("doc_id").alias("n"), F.array_join(F.array_sort(F.collect_set("split")), "+").alias("folds")).where("n > 1")
    return each.groupBy("folds").agg(F.count("*").alias("stems"))


def doc_digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def manifest_digest(digests: DataFrame) -> str:
    """One digest over all documents' in order of their ids, row by row on the driver: for small tables (``manifest_tree`` for large ones)."""
    out = hashlib.sha256()
    for r in digests.orderBy("doc_id").toLocalIterator():
        out.update(f"{r['doc_id']}\0{r['digest']}\n".encode())
    return out.hexdigest()


#: Hexadecimal places of a document's leaf: 16.7 million leaves, some hundred documents in each at 10^10.
LEAF, STEP = 6, 2


def manifest_tree(digests: DataFrame, leaf: int = LEAF, step: int = STEP) -> DataFrame:
    """node, n_docs, digest of a digest tree over all documents; node '' is the root, a leaf has ``leaf`` places.

    A document's leaf is the front of the SHA-256 of its id, so a row never holds more
    than a leaf's documents or 16^step nodes, and two trees can be compared node by node.
    Rows are joined in order of ids (of nodes above), so it depends on the documents
    alone.  ``manifest_digest`` is the sequential form for small tables.
    """
    entry = F.concat_ws("\t", F.col("doc_id"), F.col("digest"))
    joined = lambda rows: F.sha2(F.array_join(F.sort_array(F.collect_list(rows)), "\n"), 256).alias("digest")
    level, _ = written(digests.groupBy(F.substring(F.sha2("doc_id", 256), 1, leaf).alias("node")).agg(F.count("*").alias("n_docs"), joined(entry)), "leaves")
    out = level
    for places in range(leaf - step, -1, -step):
        above = F.substring(F.col("node"), F.lit(1), F.lit(places)).alias("node")
        level = level.select(above, "n_docs", F.concat_ws("\t", "node", "digest").alias("row")).groupBy("node").agg(F.sum("n_docs").alias("n_docs"), joined(F.col("row")))
        out = out.unionByName(level)
    return out


def manifest_changes(old: DataFrame, new: DataFrame, leaf: int = LEAF) -> DataFrame:
    """node, fault (changed, missing, extra): the leaves in which two trees differ; only documents there need be compared."""
    a, b = (t.where(F.length("node") == leaf).select("node", F.col("digest").alias(n)) for t, n in ((old, "was"), (new, "now")))
    fault = F.when(F.col("was").isNull(), "extra").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "node", "full_outer").select("node", fault.alias("fault")).where("fault is not null")


def build(docs: DataFrame, corpus: str, sealed_totals: Mapping[str, int] | None = None) -> dict:
    folds = {s: sorted(r["doc_id"] for r in docs.where(F.col("split") == s).select("doc_id").collect()) for s in SPLITS}
    return {"schema": 1, "corpus": corpus, "folds": {s: {"docs": x, "n": len(x)} for s, x in folds.items() if x}, "sealed_totals": dict(sealed_totals or {})}


def check_schema(record: dict) -> dict:
    if set(record) != {"schema", "corpus", "folds", "sealed_totals"} or record["schema"] != 1:
        raise SpanError("not a split record")
    seen: set[str] = set()
    for name, fold in record["folds"].items():
        if name not in SPLITS or set(fold) != {"docs", "n"} or fold["n"] != len(fold["docs"]) or len(set(fold["docs"])) != fold["n"]:
            raise SpanError(f"fold {name} is malformed")
        if seen & set(fold["docs"]):
            raise SpanError("folds are not disjoint")
        seen |= set(fold["docs"])
    return record


def write_split(record: dict, path: str | Path) -> None:
    with open(path, "x", encoding="utf-8") as f:  # never over an existing one
        json.dump(check_schema(record), f, indent=1, ensure_ascii=False)


def read_split(path: str | Path) -> dict:
    return check_schema(json.loads(Path(path).read_text(encoding="utf-8")))


def verify(docs: DataFrame, assigned: DataFrame) -> DataFrame:
    """doc_id, fault: missing (from the corpus), extra (in it alone), moved; empty if all is as recorded."""
    a = assigned.select("doc_id", F.col("split").alias("recorded"))
    both = docs.select("doc_id", "split").join(a, "doc_id", "full_outer")
    fault = F.when(F.col("split").isNull(), "missing").when(F.col("recorded").isNull(), "extra").when(F.col("split") != F.col("recorded"), "moved")
    return both.withColumn("fault", fault).where("fault is not null").select("doc_id", "fault")


def reconcile_totals(total: Mapping[str, int], present: Sequence[Mapping[str, int]], sealed: Mapping[str, int]) -> dict[str, int]:
    """What remains of each total after the readable folds must be what the sealed one records."""
    left = {k: v - sum(p.get(k, 0) for p in present) for k, v in total.items()}
    if any(left[k] != sealed.get(k, 0) for k in left):
        raise SpanError("totals don't reconcile with the sealed fold")
    return left
