"""All queries of the span engine and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import patterns
from quillspan.functions.checksums import CHECKSUMS
from quillspan.model import CORPORA, DETECTORS, LAYERS
from quillspan.operators import detect, flags, intervals, lexicon, masking, sampling, scoring, screen
from quillspan.plans import oracles, results, rounds, splits, tables
from quillspan.sources import brat, records, standoff
from quillspan.sources.rules import Rule
from quillspan.sources.scratch import shared_path

Query = Callable[[SparkSession, str], DataFrame]

RULES = (
    Rule("en:email", "regex_checksum", "CONTACT", patterns.java(oracles.EMAIL)),
    Rule("en:address", "regex_checksum", "ID", patterns.java(oracles.ADDRESS)),
    Rule("en:card", "regex_checksum", "ID", patterns.java(oracles.CARD), checksum="luhn"),
    Rule("en:phone", "regex_checksum", "CONTACT", patterns.java(oracles.PHONE)),
    Rule("en:credential", "context_cue", "ID", patterns.java(oracles.CUE), group=1),
)
TERMS = Rule("en:insults", "gazetteer", "NAME", patterns.java(patterns.gazetteer(["loser", "stupid", "scum", "the MIT License"]), fold=True))
BY_ID = {r.rule_id: r for r in RULES}
SCREEN = (("access_key", "AKIA[A-Z0-9]{16}", 1), ("long_number", "[0-9]{16}", 1))
CORPUS = "es-meddocan"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _found(spark: SparkSession, sf_dir: str, *ids: str) -> DataFrame:
    return detect.detect(documents(spark, sf_dir), [BY_ID[i] for i in ids])


def _brief(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "end", "rule_id")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, *BY_ID)


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("doc_id", "start", "end", "rule_id", "phi_type")


def detect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).groupBy("rule_id", "phi_type").agg(F.count("*").alias("n_spans"), F.count_distinct("doc_id").alias("n_docs"))


def detect_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(detect.detect(documents(spark, sf_dir), [TERMS]))


def detect_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules again through Arrow and the regex module: the same rows as detect_all."""
    found = detect.detect(documents(spark, sf_dir), RULES, backend="fallback")
    return found.select("doc_id", "start", "end", "rule_id", "phi_type")


def detect_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of terms of one to three words, found in all documents."""
    return lexicon.find_terms(documents(spark, sf_dir), _terms(spark, sf_dir)).select("doc_id", "start", "end", "term")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon from a table: the words of the benchmark, each pair of them that stands side by side, and each three."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(words.alias("w"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return items.where(F.size("w") > 2).select(F.explode(F.flatten(F.array(*map(grams, (1, 2, 3))))).alias("term")).distinct()


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, "en:email").select("doc_id", "start", "end")
    return masking.context_windows(found, documents(spark, sf_dir)).select("doc_id", "start", "end", "window", "at", "to")


def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask_documents(documents(spark, sf_dir), _all(spark, sf_dir)).select("doc_id", "masked_text")


def line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = masking.mask_documents(documents(spark, sf_dir), _all(spark, sf_dir))
    rows = masking.masked_lines(masked).select("doc_id", F.posexplode("lines").alias("line", "x"))
    return rows.select("doc_id", "line", "x.length", "x.doc_offset", F.size("x.tags").alias("n_tags"))


def _responses(docs: DataFrame) -> DataFrame:
    """An auditor's answers made by rule: a flag in the first line, one out of range, one of a type that isn't allowed."""
    flag = lambda line, start, end, kind: F.concat(F.lit(f'{{"line": {line}, "start": '), start.cast("string"), F.lit(', "end": '), end.cast("string"), F.lit(f', "phi_type": "{kind}"}}'))
    n = F.col("doc_id") % 50
    parts = (flag(0, n, n + 4, "NAME"), flag(99999, n, n + 1, "NAME"), flag(0, n, n + 2, "OTHER"), flag(0, n + 3, n, "ID"), F.lit('{"line": true}'))
    return docs.select("doc_id", F.when(n == 7, F.lit("no JSON")).otherwise(F.concat(F.lit('{"flags": ['), F.concat_ws(", ", *parts), F.lit("]}"))).alias("response"))


def flag_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lines = masking.masked_lines(masking.mask_documents(docs, _all(spark, sf_dir)))
    return flags.sort_flags(flags.validate(_responses(docs), lines)).na.fill(-1, ["start", "end"])


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.audit_report(documents(spark, sf_dir), flag_validate(spark, sf_dir))


def screen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.screen_documents(documents(spark, sf_dir), SCREEN)


def token_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).select("lang", splits.token_count(F.col("text")).alias("n"))
    return splits.nearest_rank(sizes, ["lang"], "n")


def _fold(doc_id):
    return F.when(doc_id % 4 == 0, "dev").when(doc_id % 4 == 1, "test").otherwise("train")


def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("split", _fold(F.col("doc_id")))
    return splits.fold_summary(docs, _all(spark, sf_dir).withColumn("excluded", F.col("phi_type") == "ID"))


def fold_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("split", _fold(F.col("doc_id")))
    return splits.fold_types(docs, _all(spark, sf_dir).withColumn("excluded", F.col("phi_type") == "ID").withColumn("subtype", F.col("rule_id")))


def fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.fold_tokens(documents(spark, sf_dir).withColumn("split", _fold(F.col("doc_id"))))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standoff lines made of the documents: each one's first letters, some behind a byte-order mark."""
    number = F.col("doc_id")
    kind = F.element_at(F.array(*(F.lit(t) for t in NOTE_TYPES)), (number % len(NOTE_TYPES) + 1).cast("int"))
    shift, size = (number % 7 == 0).cast("int"), F.least(F.length("text"), (number % 5 + 1).cast("int"))
    text = F.when(number % 7 == 0, F.concat(F.lit(brat.BOM), "text")).otherwise(F.col("text"))
    surface = F.when(number % 11 == 0, F.lit("?")).otherwise(F.substring(F.col("text"), F.lit(1), size))
    line = F.concat(F.lit("T1\t"), kind, F.lit(" "), shift.cast("string"), F.lit(" "), (shift + size).cast("string"), F.lit("\t"), surface)
    return documents(spark, sf_dir).where(~F.substring("text", 1, 5).rlike(r"\s") & (F.length("text") > 0)).select("doc_id", text.alias("raw"), line.alias("line"))


NOTE_TYPES = ("FECHAS", "PAIS", "SEXO_SUJETO_ASISTENCIA", "HOSPITAL")


def _read_notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    notes = _notes(spark, sf_dir)
    text, had = brat.strip_bom(F.col("raw"))
    read = notes.select("doc_id", text.alias("text"), had.cast("int").alias("shift"), brat.parse_brat_line(F.col("line")).alias("a"))
    kind = brat.classify_type(F.col("a.subtype"), brat.MEDDOCAN_TYPES, brat.MEDDOCAN_EXCLUDED)
    spans = read.select("doc_id", F.lit(0).alias("span_index"), (F.col("a.start") - F.col("shift")).alias("start"), (F.col("a.end") - F.col("shift")).alias("end"), "a.surface", "a.subtype", kind.alias("c"))
    return read.select("doc_id", "text"), spans.select("doc_id", "span_index", "start", "end", "surface", "subtype", "c.phi_type", "c.excluded")


def parse_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standoff lines read: offsets behind byte-order marks, types mapped or excluded."""
    return _read_notes(spark, sf_dir)[1].select("doc_id", "start", "end", "phi_type", "excluded", "subtype")


def wrong_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans whose surface isn't at their offsets."""
    return brat.bad_offsets(*_read_notes(spark, sf_dir))


def read_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All found spans by way of CAS files: every third text behind a byte-order mark, which its first span holds."""
    found = _all(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "rule_id"))).alias("found"))
    docs = documents(spark, sf_dir).join(found, "doc_id", "left")
    mark = (F.col("doc_id") % 3 == 0).cast("int")
    span = lambda begin, end, kind: F.struct(F.lit(brat.PHI_LAYER).alias("%TYPE"), F.lit(1).alias("@sofa"), begin.cast("int").alias("begin"), end.cast("int").alias("end"), kind.alias("kind"), F.lit(None).cast("string").alias("sofaString"), F.lit(None).cast("int").alias("%ID"), F.lit(None).cast("string").alias("sofaID"))
    front = F.array(span(F.lit(0), F.least(F.length("text"), F.lit(4)) + mark, F.lit("front")))
    spans = F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,end:int,rule_id:string>>")), lambda f: span(f["start"] + mark, f["end"] + mark, f["rule_id"]))
    sofa = F.struct(F.lit(brat.CAS_SOFA).alias("%TYPE"), F.lit(None).cast("int").alias("@sofa"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("kind"), F.concat(F.repeat(F.lit(brat.BOM), mark), F.coalesce("text", F.lit(""))).alias("sofaString"), F.lit(1).alias("%ID"), F.lit(brat.CAS_VIEW).alias("sofaID"))
    content = F.to_json(F.struct(F.concat(front, F.array(sofa), spans).alias(brat.CAS_STRUCTURES)))
    types = {r.rule_id: r.phi_type for r in RULES} | {"front": "NAME"}
    _, gold = brat.parse_cas(docs.where(F.length("text") > 0).select(F.col("doc_id").cast("string"), content.alias("content")), "de-grascco", "dev", types)
    return gold.select("doc_id", "start", "end", "surface", "subtype", "phi_type")


def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All found spans by way of a corpus folder: texts and annotation files are written and read, every third text behind a byte-order mark."""
    note = lambda f, i: F.concat(F.lit("T"), (i + 1).cast("string"), F.lit("\t"), f["rule_id"], F.lit(" "), (f["start"] + F.col("mark")).cast("string"), F.lit(" "), (f["end"] + F.col("mark")).cast("string"), F.lit("\t"), f["surface"])
    docs = documents(spark, sf_dir).select(F.col("doc_id"), "text", (F.col("doc_id") % 3 == 0).cast("int").alias("mark"))
    found = _all(spark, sf_dir).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.struct("start", "end", "rule_id", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("surface")).alias("f"))
    notes = found.groupBy("doc_id").agg(F.sort_array(F.collect_list("f")).alias("found"))
    files = docs.join(notes, "doc_id", "left").select(F.col("doc_id").cast("string"), _fold(F.col("doc_id")).alias("split"), F.concat(F.repeat(F.lit(brat.BOM), F.col("mark")), F.coalesce("text", F.lit(""))).alias("text"), F.array_join(F.transform("found", note), "\n").alias("ann"))
    path = shared_path(spark, "corpus")
    standoff.write_folder(files, path)
    read = functools.partial(standoff.read_folder, spark, path, folds="train,dev,test", slices=spark.sparkContext.defaultParallelism)
    _, gold = brat.parse_standoff(read(), CORPUS, {r.rule_id: r.phi_type for r in RULES}, ())
    return gold.join(read(columns="doc_id string, split string"), "doc_id").select("doc_id", "split", "span_index", "start", "end", "surface", "subtype", "phi_type")


def sorted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All found spans with their place in the order of the files."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", F.coalesce("rule_id", F.lit("")))
    return detect.sort_spans(_all(spark, sf_dir)).select("doc_id", F.row_number().over(order).alias("place"), "start", "end", "rule_id")


def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of each masked document as an auditor sees it."""
    masked = masking.mask_documents(documents(spark, sf_dir), _all(spark, sf_dir))
    lines = masked.select("doc_id", F.posexplode(F.split("masked_text", "\n", -1)).alias("number", "x"))
    return lines.select("doc_id", "number", masking.render_line(F.col("number"), F.col("x")).alias("line"))


def way_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place in the document of each masked text's middle."""
    masked = masking.mask_documents(documents(spark, sf_dir), _all(spark, sf_dir))
    return masked.select("doc_id", masking.to_document(F.floor(F.length("masked_text") / 2).cast("int"), F.col("tags")).alias("at"))


def target_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of types that a sample may hold, here with one type called OTHER."""
    renamed = _errors(spark, sf_dir).withColumn("phi_type", F.when(F.col("phi_type") == "DATE", "OTHER").otherwise(F.col("phi_type")))
    return sampling.eligible_errors(renamed).groupBy("phi_type", "kind").agg(F.count("*").alias("n"))


def merge_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_recall_first(tables.pred(spark, sf_dir), LAYERS, "fixed_priority").groupBy("phi_type").agg(F.count("*").alias("n"), F.sum("n_merged").alias("merged"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of documents: a path by number, every third one not visible."""
    number = F.col("doc_id")
    path = F.concat(F.element_at(F.array(*(F.lit(p) for p in PATHS)), (number % len(PATHS) + 1).cast("int")), number.cast("string"), F.when(number % 2 == 0, ".md").otherwise(".jsonl"))
    return documents(spark, sf_dir).select(path.alias("path"), F.col("text").alias("content"), (number % 3 > 0).alias("visible"))


PATHS = ("docs/", "data/raw/", "sealed/", "notes/call_log/", "results/")


def screen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.screen_files(_paths(spark, sf_dir), SCREEN)


def screen_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspect files by what the allow-list expects; every fourth one has an entry, half of those for another hit."""
    files = _paths(spark, sf_dir)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    listed = files.where(F.col("path").startswith("docs/") | F.col("path").startswith("results/")).where(number % 4 == 0)
    allow = listed.select("path", F.when(number % 8 == 0, "long").otherwise("access").alias("sniff"), F.lit("one two three four five").alias("why"))
    left = files.where(number % 16 > 0)
    return screen.partition_suspect(screen.screen_files(left, SCREEN), allow, left)


def stem_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stem_groups(documents(spark, sf_dir).select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("doc_id")))


def crossing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id")
    docs = documents(spark, sf_dir).select(F.concat_ws("-", F.floor(number / 5).cast("string"), number.cast("string")).alias("doc_id"), _fold(number).alias("split"))
    return splits.crossing_summary(docs)


def split_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string"), _fold(F.col("doc_id")).alias("split"), F.col("doc_id").alias("n"))
    recorded = docs.where("n % 13 <> 0").withColumn("split", F.when(F.col("n") % 17 == 0, F.lit("elsewhere")).otherwise(F.col("split")))
    return splits.verify(docs, recorded)


def doc_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.doc_digests(documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")))


def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.manifest_tree(doc_digests(spark, sf_dir)).select("node", "n_docs", "digest")


def grouping_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents three by three as one person's: a word that all hold as the name, the source as the record, the language as the date."""
    stem = F.concat_ws("-", F.floor(F.col("doc_id") / 3).cast("string"), F.col("doc_id").cast("string"))
    docs = documents(spark, sf_dir).select(stem.alias("doc_id"), "text", "source", "lang")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0)))
    kinds = F.concat(F.transform(words, lambda w: F.struct(F.lit("word").alias("subtype"), w.alias("surface"))), F.array(*(F.struct(F.lit(c).alias("subtype"), F.col(c).alias("surface")) for c in ("source", "lang"))))
    gold = docs.where("text is not null").select("doc_id", F.inline(kinds).alias("subtype", "surface"))
    return splits.grouping_audit(docs, gold, {"name": ["word"], "record": ["source"], "date": ["lang"]})


def rule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of rules made of the parts, and why those that are refused are."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    turn = F.col("p_partkey") % 7
    tail = F.when(turn == 1, F.concat(F.lit("_"), F.col("p_retailprice").cast("int").cast("string"))).when(turn == 2, "_Extra").when(turn == 3, "_añejo").when(turn == 4, "_a_b_c_d").when(turn == 5, F.concat(F.lit("_v"), (F.col("p_partkey") % 100).cast("string"))).otherwise("")
    names = parts.select("p_partkey", F.concat(F.lit("en:"), F.regexp_replace("p_name", " ", "_"), tail).alias("rule_id"), F.lit("en").alias("lang"))
    return screen.strange_names(names, NAME_WORDS).select("p_partkey", "rule_id", "reason")


NAME_WORDS = ("cold", "small", "large", "hot", "widget", "bolt", "a", "b", "c", "d")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of arms and rounds made of the orders: one cost and caching block each; some arms and some calls aren't cached."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    cached = (cust % 10 != 3) & (key % 5 > 0)
    axis = lambda name, values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int")).alias(name)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        axis("corpus", CORPORA, cust),
        axis("detector", DETECTORS[:2], cust),
        F.lit("sup-free").alias("supervision"),
        F.lit("port-loop").alias("porting"),
        (F.floor(key / 3) % 4 + 1).cast("int").alias("iteration"),
        ((key * 7919) % 1000).alias("leaked"),
        F.lit(1).cast("long").alias("llm_calls"),
        (key % 1000).alias("prompt_tokens"),
        (cust % 100).alias("completion_tokens"),
        (key % 97 / 8).alias("wall_seconds"),
        *(F.when(cached, v).alias(n) for n, v in (("boundary", F.lit("system")), ("ttl", F.lit("5m")), ("read_tokens", key % 50), ("write_tokens", key % 7))),
    )


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls added up to rounds, written into the results and read from there."""
    calls, keys = _calls(spark, sf_dir), [*results.ARM, "iteration"]
    rates = calls.groupBy(*keys).agg((F.sum("leaked") / (F.count("*") * 1000)).alias("leak_rate"))
    rows = rates.join(results.sum_costs(calls, keys), keys).join(results.sum_caching(calls, keys).drop("enabled"), keys)
    path = shared_path(spark, "results")
    results.write_rounds(rows, path)
    return results.read_rounds(spark, path)


def read_metrics_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.history(_rounds(spark, sf_dir))


def sum_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.sum_costs(_rounds(spark, sf_dir))


def sum_caching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.sum_caching(_rounds(spark, sf_dir)).na.fill(-1, ["read_tokens", "write_tokens"]).na.fill(False, ["enabled"])


def span_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All found spans, written to prediction files and read from there."""
    path = shared_path(spark, "spans")
    records.write_spans(_all(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")), path, single=False)
    return records.read_spans(spark, path).select("doc_id", "start", "end", "phi_type", "layer", "detector", "rule_id")


def error_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the arithmetic spans, written to error files and read from there."""
    path = shared_path(spark, "errors")
    records.write_errors(_errors(spark, sf_dir), path, single=False)
    return records.read_errors(spark, path)


def termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rate = ((F.col("o_orderkey") * 7919 + F.col("o_custkey")) % 1000) / 20000.0 + 0.3
    series = orders.select(F.col("o_custkey").alias("series"), turn.cast("long").alias("round"), rate.alias("leak_rate"), (1000 + F.col("o_custkey") % 9000).alias("n_dev"))
    # all rounds, in series of at most as many as the ceiling
    within = series.withColumn("series", F.col("series") * 1000 + F.floor((F.col("round") - 1) / rounds.CEILING)).withColumn("round", (F.col("round") - 1) % rounds.CEILING + 1)
    return rounds.termination_table(within)


def _on_spans(f: Callable[..., DataFrame], *rest) -> Query:
    """A query on the arithmetic gold and predictions."""
    return lambda spark, sf_dir: f(tables.gold(spark, sf_dir), tables.pred(spark, sf_dir), *rest)


def _on_pred(f: Callable[..., DataFrame], *rest) -> Query:
    return lambda spark, sf_dir: f(tables.pred(spark, sf_dir), *rest)


def covered_length(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return scoring.covered_lengths(gold, pred).select("doc_id", "span_index", F.coalesce(F.try_element_at("lengths", F.lit("all")), F.lit(0)).cast("long").alias("n"))


def _assigned(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    return scoring.assign(gold, intervals.dedupe(pred), mode)


def _assigned_in_rounds(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    return scoring.assign_in_rounds(gold, intervals.dedupe(pred), mode)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.counts(tables.docs(spark, sf_dir), tables.gold(spark, sf_dir, True), tables.pred(spark, sf_dir))


def fp_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fp_opportunity(tables.docs(spark, sf_dir), tables.gold(spark, sf_dir, True), tables.pred(spark, sf_dir))


def _drawn(draw: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: draw(scoring.error_spans(tables.gold(spark, sf_dir), tables.pred(spark, sf_dir)), CORPUS, 2)


def practice_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = scoring.error_spans(tables.gold(spark, sf_dir), tables.pred(spark, sf_dir))
    return sampling.practice_pool(errors, sampling.draw_hash(errors, CORPUS, 2))


def check_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = tables.gold(spark, sf_dir), tables.pred(spark, sf_dir)
    return rounds.check_rules_report(pred, scoring.error_spans(gold, pred), gold)


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.error_spans(tables.gold(spark, sf_dir), tables.pred(spark, sf_dir))


def _pred_as_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pred(spark, sf_dir).select("doc_id", F.col("span_index").alias("flag_index"), F.lit(None).cast("string").alias("reason"), "start", "end", "phi_type")


def join_flags_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each missed span with the lowest prediction that overlaps it, of any type (-1 for none)."""
    return flags.mark_sample(_errors(spark, sf_dir).where("kind = 'missed'"), _pred_as_flags(spark, sf_dir)).na.fill(-1, ["flag_index"])


def unmatched_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed = _errors(spark, sf_dir).where("kind = 'missed'")
    return flags.unmatched_flags(missed, _pred_as_flags(spark, sf_dir)).select("doc_id", "flag_index", "start", "end")


def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _errors(spark, sf_dir)
    return sampling.pool_summary(errors, sampling.draw_hash(errors, CORPUS, 2))


def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.gold(spark, sf_dir, True).groupBy("phi_type", "excluded").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def initial_error_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.initial_error_pool(tables.gold(spark, sf_dir, True))


def apply_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string"), F.lit(None).cast("string").alias("split"))
    return brat.apply_split(docs, docs.withColumn("split", _fold(F.col("doc_id").cast("long"))))


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four check digits over numbers made of order keys."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 7919 % 100_000_000).alias("n"))
    eight = F.lpad(F.col("n").cast("string"), 8, "0")
    letter = F.substring(F.lit("TRWAGMYF"), (F.col("n") % 8 + 1).cast("int"), F.lit(1))
    made = orders.select("o_orderkey", F.concat(eight, letter).alias("dni"), F.concat(F.lit("Y-"), F.substring(eight, 2, 7), F.lit("."), letter).alias("nie"), F.concat(eight, F.col("o_orderkey").cast("string")).alias("digits"))
    check = lambda name, c: F.coalesce(CHECKSUMS[name](F.col(c)), F.lit(False)).alias(name)
    return made.select("o_orderkey", check("dni_mod23", "dni"), check("nie_mod23", "nie"), check("luhn", "digits"), check("mod10", "digits"))


QUERIES: dict[str, Query] = {
    "detect_counts": detect_counts,
    "detect_all": detect_all,
    "detect_regex": lambda s, d: _brief(_found(s, d, "en:email")),
    "detect_checksum_luhn": lambda s, d: _brief(_found(s, d, "en:card")),
    "detect_cue": lambda s, d: _brief(_found(s, d, "en:credential")),
    "detect_gazetteer": detect_gazetteer,
    "detect_fallback": detect_fallback,
    "detect_lexicon": detect_lexicon,
    "interval_union": _on_pred(intervals.interval_union),
    "mask_union": _on_pred(intervals.mask_union),
    "interval_union_split": _on_pred(lambda pred: intervals.interval_union(pred, width=16)),
    "mask_union_split": _on_pred(lambda pred: intervals.mask_union(pred, width=16)),
    "overlapping_pairs": _on_pred(intervals.overlapping_pairs),
    "dedupe": _on_pred(intervals.dedupe_counts),
    "merge_recall_first": _on_pred(intervals.merge_recall_first, LAYERS),
    "covered_length": _on_spans(covered_length),
    "leak_rate": _on_spans(scoring.leak_rate),
    "prf_overall": _on_spans(scoring.prf_overall),
    "headline": _on_spans(scoring.headline),
    "error_spans": _on_spans(scoring.error_spans),
    "counts": counts,
    "fp_opportunity": fp_opportunity,
    "sample_hash": _drawn(sampling.draw_hash),
    "sample_compat": _drawn(sampling.draw_compat),
    "practice_pool": practice_pool,
    "check_rules": check_rules,
    "join_flags_sample": join_flags_sample,
    "unmatched_flags": unmatched_flags,
    "pool_summary": pool_summary,
    "count_by_type": count_by_type,
    "initial_error_pool": initial_error_pool,
    "apply_split": apply_split,
    "checksums": checksums,
    "context_window": context_window,
    "mask_text": mask_text,
    "line_geometry": line_geometry,
    "flag_validate": flag_validate,
    "audit_report": audit_report,
    "screen_documents": screen_documents,
    "token_percentiles": token_percentiles,
    "fold_summary": fold_summary,
    "fold_types": fold_types,
    "fold_tokens": fold_tokens,
    "parse_notes": parse_notes,
    "wrong_offsets": wrong_offsets,
    "read_cas": read_cas,
    "read_corpus": read_corpus,
    "sorted_spans": sorted_spans,
    "rendered_lines": rendered_lines,
    "way_back": way_back,
    "target_errors": target_errors,
    "merge_by_priority": merge_by_priority,
    "screen_files": screen_files,
    "screen_parts": screen_parts,
    "stem_groups": stem_groups,
    "crossing_summary": crossing_summary,
    "split_verify": split_verify,
    "doc_digests": doc_digests,
    "termination": termination,
    "manifest_tree": manifest_tree,
    "grouping_audit": grouping_audit,
    "rule_names": rule_names,
    "read_metrics_history": read_metrics_history,
    "sum_costs": sum_costs,
    "sum_caching": sum_caching,
    "span_files": span_files,
    "error_files": error_files,
}

for _short, _mode in (("fully", "fully_covered"), ("relaxed", "relaxed")):
    QUERIES |= {
        f"coverage_{_short}": _on_spans(scoring.coverage, _mode),
        f"assign_{_short}": _on_spans(_assigned, _mode),
        f"assign_in_rounds_{_short}": _on_spans(_assigned_in_rounds, _mode),
        f"by_type_{_short}": _on_spans(scoring.by_type, _mode),
        f"macro_{_short}": _on_spans(scoring.macro, _mode),
        f"by_document_{_short}": _on_spans(scoring.by_document, _mode),
        f"slack_{_short}": _on_spans(scoring.assignment_slack, _mode),
        f"by_rule_{_short}": _on_spans(scoring.by_rule, _mode),
        f"complementarity_families_{_short}": _on_spans(scoring.complementarity_families, _mode),
        f"complementarity_families_by_type_{_short}": _on_spans(scoring.complementarity_families, _mode, True),
        f"complementarity_layers_{_short}": _on_spans(scoring.complementarity_layers, _mode, True),
        f"covered_by_layer_{_short}": _on_spans(scoring.covered_by_layer, _mode),
    }

ORACLES: dict[str, str] = {k: v for k, v in (oracles.ORACLES | oracles.sample_oracles(sampling.sample_seed(CORPUS, 2))).items() if k in QUERIES}
ORACLES |= {f"{name}_split": oracles.ORACLES[name] for name in ("interval_union", "mask_union")}
ORACLES |= {f"assign_in_rounds_{_short}": oracles.ORACLES[f"assign_{_short}"] for _short in ("fully", "relaxed")}
ORACLES["detect_fallback"] = oracles.ORACLES["detect_all"]
