"""Corpora as tables: standoff annotation files, CAS JSON, byte-order marks, types, offsets, folds."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.arrays import let
from quillspan.model import SEALED_SPLIT, SpanError, check_value

# The Spanish corpus's types and what they are mapped to, and the types that are kept but never scored.
MEDDOCAN_TYPES = {
    "NOMBRE_SUJETO_ASISTENCIA": "NAME",
    "NOMBRE_PERSONAL_SANITARIO": "NAME",
    "FECHAS": "DATE",
    "EDAD_SUJETO_ASISTENCIA": "AGE",
    "TERRITORIO": "LOCATION_AREA",
    "PAIS": "LOCATION_AREA",
    "CALLE": "LOCATION_STREET",
    "HOSPITAL": "ORGANISATION",
    "INSTITUCION": "ORGANISATION",
    "CENTRO_SALUD": "ORGANISATION",
    "CORREO_ELECTRONICO": "CONTACT",
    "NUMERO_TELEFONO": "CONTACT",
    "NUMERO_FAX": "CONTACT",
    "ID_SUJETO_ASISTENCIA": "ID",
    "ID_ASEGURAMIENTO": "ID",
    "ID_TITULACION_PERSONAL_SANITARIO": "ID",
    "ID_CONTACTO_ASISTENCIAL": "ID",
    "ID_EMPLEO_PERSONAL_SANITARIO": "ID",
    "PROFESION": "PROFESSION",
    "OTROS_SUJETO_ASISTENCIA": "OTHER",
}
MEDDOCAN_EXCLUDED = ("SEXO_SUJETO_ASISTENCIA", "FAMILIARES_SUJETO_ASISTENCIA")
BOM = "﻿"


def _refuse(message: str, detail: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message + ": "), detail.cast("string")))


def classify_type(subtype: Column, types: Mapping[str, str], excluded: Sequence[str]) -> Column:
    """(phi_type, excluded); a type in neither list is refused when read."""
    known = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    out = subtype.isin(*excluded) if excluded else F.lit(False)
    phi = F.when(out, F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(known, subtype), _refuse("unmapped type", subtype).cast("string")))
    return F.struct(phi.alias("phi_type"), out.alias("excluded"))


def strip_bom(text: Column) -> tuple[Column, Column]:
    """The text without a leading byte-order mark, and whether there was one: offsets then fall by 1."""
    had = text.startswith(BOM)
    return F.when(had, F.substring(text, 2, F.length(text))).otherwise(text), had


def parse_brat_line(line: Column) -> Column:
    """(id, subtype, start, end, surface) of T<n>, TYPE start end, surface between tabs; anything else is refused."""
    parts = F.split(line, "\t", -1)
    head = F.split(F.get(parts, F.lit(1)), " ", -1)
    start, end = (F.get(head, F.lit(i)).try_cast("int") for i in (1, 2))
    fine = (F.size(parts) == 3) & F.get(parts, F.lit(0)).rlike("^T[0-9]+$") & (F.size(head) == 3) & start.isNotNull() & end.isNotNull() & (start >= 0) & (start < end)
    made = F.struct(F.get(parts, F.lit(0)).alias("id"), F.get(head, F.lit(0)).alias("subtype"), start.alias("start"), end.alias("end"), F.get(parts, F.lit(2)).alias("surface"))
    return F.when(F.coalesce(fine, F.lit(False)), made).otherwise(_refuse("not a span annotation, at length", F.length(line)).cast("struct<id:string,subtype:string,start:int,end:int,surface:string>"))


def _stems(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """Names of the files with a suffix, without it: from the listing alone, so empty files count."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, out = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        name = found.next().getPath().getName()
        if name.endswith(suffix):
            out.append(name.removesuffix(suffix))
    return sorted(out)


def _files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """doc_id and value of the files with a suffix that aren't empty."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root)
    return read.select(F.regexp_extract("path", rf"([^/]+){suffix.replace('.', '[.]')}$", 1).alias("doc_id"), F.decode("content", "UTF-8").alias("value"))


def brat_dir(spark: SparkSession, root: str) -> str:
    """The folder that holds the files: a single wrapper folder is looked through.  Any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    inside = [x for x in files.listStatus(where) if not x.getPath().getName().startswith(".")] if files.exists(where) else []
    return inside[0].getPath().toString() if len(inside) == 1 and inside[0].isDirectory() else root


def corpus_root(corpus: str, config: str | Path, sealed: bool = False) -> str | None:
    """The folder of a corpus by a configuration's ``corpora`` block, or of its sealed fold by ``sealed`` alone.

    A corpus without a sealed entry has None.  Messages don't name the path.
    """
    check_value("corpus", corpus)
    config = Path(config)
    if not config.exists():
        if sealed:
            return None
        raise SpanError("there is no configuration of data paths")
    if config.suffix == ".json":
        blocks = json.loads(config.read_text(encoding="utf-8"))
    else:
        import yaml  # an optional reader; JSON always works

        blocks = yaml.safe_load(config.read_text(encoding="utf-8"))
    given = ((blocks or {}).get("sealed" if sealed else "corpora") or {}).get(corpus)
    if not given:
        if sealed:
            return None
        raise SpanError(f"no path is configured for {corpus}")
    path = Path(str(given)).expanduser()
    path = path if path.is_absolute() else config.parent / path
    if not path.is_dir():
        raise SpanError(f"the path configured for {corpus} is not a folder")
    return str(path)


CARMEN_VARIANTS = ("masked", "replaced")


def read_carmen(spark: SparkSession, root: str, split: str, types: Mapping[str, str], excluded: Sequence[str] = (), corpus: str = "es-carmen", known_bad: Sequence[tuple[str, str, int]] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and gold of both variants, each with its own offsets (column variant), and the spans left out.

    A variant's annotations lie in ann/<variant>/anon beside its texts.  ``known_bad``
    names spans (variant, doc_id, span_index) whose surface isn't at their offsets;
    those are left out of gold and given apart, any other such span is refused.
    """
    docs = gold = None
    for variant in CARMEN_VARIANTS:
        d, g = (x.withColumn("variant", F.lit(variant)) for x in read_brat(spark, f"{root.rstrip('/')}/ann/{variant}/anon", corpus, split, types, excluded))
        docs, gold = (d, g) if docs is None else (docs.unionByName(d), gold.unionByName(g))
    bad = bad_offsets(docs, gold, ("variant", "doc_id"))
    named = spark.createDataFrame(list(known_bad), "variant string, doc_id string, span_index int")
    keys = ["variant", "doc_id", "span_index"]
    if n := bad.join(named, keys, "left_anti").count():
        raise SpanError(f"{n} spans don't lie at their offsets")
    return docs, gold.join(named, keys, "left_anti"), bad.join(named, keys, "left_semi").select(keys)


def read_brat(spark: SparkSession, root: str, corpus: str, split: str, types: Mapping[str, str] = MEDDOCAN_TYPES, excluded: Sequence[str] = MEDDOCAN_EXCLUDED) -> tuple[DataFrame, DataFrame]:
    """Documents and gold spans of one fold's folder; a text or annotation without its partner is refused."""
    texts, notes = (_stems(spark, root, suffix) for suffix in (".txt", ".ann"))
    if alone := set(texts) ^ set(notes):
        raise SpanError(f"{len(alone)} files have no partner")
    if len(set(texts)) != len(texts):
        raise SpanError("a doc_id stands twice")
    names = spark.createDataFrame([(t,) for t in texts], "doc_id string")
    both = names.join(_files(spark, root, ".txt").withColumnRenamed("value", "raw"), "doc_id", "left").join(_files(spark, root, ".ann").withColumnRenamed("value", "ann"), "doc_id", "left")
    paired = both.na.fill("", ["raw", "ann"])
    return parse_standoff(paired.select("doc_id", F.lit(split).alias("split"), F.col("raw").alias("text"), "ann"), corpus, types, excluded)


def parse_standoff(files: DataFrame, corpus: str, types: Mapping[str, str] = MEDDOCAN_TYPES, excluded: Sequence[str] = MEDDOCAN_EXCLUDED) -> tuple[DataFrame, DataFrame]:
    """Documents and gold spans of texts and their annotation files (files: doc_id, split, text, ann)."""
    text, had = strip_bom(F.col("text"))
    docs = files.select(F.lit(corpus).alias("corpus"), "doc_id", text.alias("text"), "split", had.alias("had_bom"), F.create_map().cast("map<string,string>").alias("meta"), "ann")
    lines = docs.select("doc_id", "had_bom", F.posexplode(F.filter(F.split("ann", "\r?\n"), lambda x: F.trim(x) != "")).alias("span_index", "line"))
    parsed = lines.withColumn("a", parse_brat_line(F.col("line")))
    shift = F.col("had_bom").cast("int")
    gold = parsed.select(
        F.lit(corpus).alias("corpus"),
        "doc_id",
        "span_index",
        (F.col("a.start") - shift).alias("start"),
        (F.col("a.end") - shift).alias("end"),
        F.col("a.surface").alias("surface"),
        F.col("a.subtype").alias("subtype"),
        classify_type(F.col("a.subtype"), types, excluded).alias("c"),
    ).select("corpus", "doc_id", "span_index", "start", "end", "surface", "subtype", "c.phi_type", "c.excluded")
    return docs.drop("ann"), gold


# Names of the CAS JSON form and of the German corpus's layer.
CAS_STRUCTURES, CAS_SOFA, CAS_VIEW, PHI_LAYER = "%FEATURE_STRUCTURES", "uima.cas.Sofa", "_InitialView", "webanno.custom.PHI"
_FEATURES = "struct<`%ID`:bigint,`%TYPE`:string,`@sofa`:bigint,sofaID:string,sofaString:string,begin:int,end:int,kind:string>"
_PLAIN = "sofaString:string,spans:array<struct<begin:int,end:int,kind:string>>"


def _views(content: Column, layer: str) -> Column:
    """(view, text, spans) of each sofa in a CAS: structures name theirs by its id; a file of one text and its spans is one view."""
    read = F.from_json(content, f"struct<`{CAS_STRUCTURES}`:array<{_FEATURES}>,{_PLAIN}>", {"mode": "FAILFAST"})

    def views(x: Column) -> Column:
        structures = x[CAS_STRUCTURES]
        marked = F.filter(structures, lambda f: f["%TYPE"] == layer)
        own = lambda sofa: F.transform(F.filter(marked, lambda f: f["@sofa"] == sofa["%ID"]), lambda f: F.struct(f["begin"].alias("begin"), f["end"].alias("end"), f["kind"].alias("kind")))
        sofas = F.filter(structures, lambda f: f["%TYPE"] == CAS_SOFA)
        strays = F.exists(marked, lambda f: ~F.exists(sofas, lambda s: s["%ID"].eqNullSafe(f["@sofa"])))
        graph = F.transform(sofas, lambda s: F.struct(s["sofaID"].alias("view"), s["sofaString"].alias("text"), own(s).alias("spans")))
        graph = F.when(strays, F.from_json(_refuse("a span belongs to no text; length of the file", F.length(content)).cast("string"), _VIEWS)).otherwise(graph.cast(_VIEWS))
        plain = F.array(F.struct(F.lit(CAS_VIEW).alias("view"), x["sofaString"].alias("text"), x["spans"].alias("spans"))).cast(_VIEWS)
        return F.when(structures.isNull(), plain).otherwise(graph)

    return let(read, views)


_VIEWS = "array<struct<view:string,text:string,spans:array<struct<begin:int,end:int,kind:string>>>>"


def parse_cas(files: DataFrame, corpus: str, split: str, types: Mapping[str, str], excluded: Sequence[str] = (), layer: str = PHI_LAYER) -> tuple[DataFrame, DataFrame]:
    """Documents and gold spans of CAS JSON (files: doc_id, content); a second view of a file is a document of its own, doc_id/view.

    Offsets count a byte-order mark at the front of the text, which goes: a span that
    begins with the mark then begins at 0.
    """
    read = files.select("doc_id", F.explode(_views(F.col("content"), layer)).alias("v")).select(F.when(F.col("v.view") == CAS_VIEW, F.col("doc_id")).otherwise(F.concat_ws("/", "doc_id", "v.view")).alias("doc_id"), F.coalesce("v.text", F.lit("")).alias("sofa"), "v.spans")
    text, had = strip_bom(F.col("sofa"))
    docs = read.select(F.lit(corpus).alias("corpus"), "doc_id", text.alias("text"), F.lit(split).alias("split"), had.alias("had_bom"), F.create_map().cast("map<string,string>").alias("meta"))
    rows = read.select("doc_id", had.cast("int").alias("shift"), text.alias("text"), F.posexplode("spans").alias("span_index", "s"))
    start, end = (F.greatest(F.col(f"s.{x}") - F.col("shift"), F.lit(0)) for x in ("begin", "end"))
    gold = rows.select(F.lit(corpus).alias("corpus"), "doc_id", "span_index", start.alias("start"), end.alias("end"), F.substring(F.col("text"), start + 1, end - start).alias("surface"), F.col("s.kind").alias("subtype"), classify_type(F.col("s.kind"), types, excluded).alias("c"))
    return docs, gold.select("corpus", "doc_id", "span_index", "start", "end", "surface", "subtype", "c.phi_type", "c.excluded")


def read_cas(spark: SparkSession, root: str, corpus: str, split: str, types: Mapping[str, str], excluded: Sequence[str] = (), layer: str = PHI_LAYER) -> tuple[DataFrame, DataFrame]:
    """Documents and gold spans of a folder's CAS JSON files: <doc_id>.json, or <doc_id>.txt<name of the layer>.json."""
    read = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(root)
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)([.]txt[^/]*)?[.]json$", 1)
    return parse_cas(read.select(name.alias("doc_id"), F.col("value").alias("content")), corpus, split, types, excluded, layer)


def bad_offsets(docs: DataFrame, gold: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Spans whose stretch of text isn't their surface: keys and span_index only."""
    joined = gold.join(docs.select(*keys, "text"), list(keys), "left")
    fine = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text")) & (F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("surface"))
    return joined.where(~F.coalesce(fine, F.lit(False))).select(*keys, "span_index")


def apply_split(docs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Documents with their fold; a document or an assignment without its partner, or two that disagree, are refused."""
    given = assigned.select(F.col("doc_id").alias("__id"), F.col("split").alias("__split"))
    both = docs.join(given, F.col("doc_id") == F.col("__id"), "full_outer")
    fold = (
        F.when(F.col("__id").isNull(), _refuse("not in the split file", F.col("doc_id")).cast("string"))
        .when(F.col("doc_id").isNull(), _refuse("in the split file alone", F.col("__id")).cast("string"))
        .when(F.col("split").isNotNull() & (F.col("split") != F.col("__split")), _refuse("folds disagree on", F.col("doc_id")).cast("string"))
        .otherwise(F.col("__split"))
    )
    return both.withColumn("split", fold).select(*docs.columns)


def load_fold(docs: DataFrame, split: str) -> DataFrame:
    """One unsealed fold; the sealed one is refused by name, an empty one by count."""
    if split == SEALED_SPLIT:
        raise SpanError("the sealed fold can't be loaded")
    out = docs.where(F.col("split") == split)
    if out.isEmpty():
        raise SpanError(f"fold {split} has no document")
    return out


def load_corpus(docs: DataFrame, gold: DataFrame, assigned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The checked tables: unique ids, surfaces at their offsets, folds as assigned."""
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise SpanError("a doc_id stands twice")
    if n := bad_offsets(docs, gold).count():
        raise SpanError(f"{n} spans don't lie at their offsets")
    return (apply_split(docs, assigned) if assigned is not None else docs), gold


def fold_roots(root: str, folds: Mapping[str, str], sealed: Sequence[str] = (SEALED_SPLIT,)) -> dict[str, str]:
    """Folders of the folds that may be read; a sealed fold has no path here."""
    return {f: f"{root.rstrip('/')}/{p}" for f, p in folds.items() if f not in sealed}
