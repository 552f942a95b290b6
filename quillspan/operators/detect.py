"""Rules over a table of documents: one scan, one row per match, no merging.

A rule's offsets come from two arrays, the matches and the pieces between them, so
the work stays in the JVM.  Rules that Java can't run go through Arrow to the regex
module and give the same rows.  Lexicons of many terms are joined (``lexicon``).
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import patterns
from quillspan.functions.arrays import let, running
from quillspan.functions.checksums import CHECKSUMS
from quillspan.operators import lexicon
from quillspan.sources.rules import Rule, check_patterns

_HIT = "array<struct<start:int,end:int,hit:string>>"
OUT = "start int, end int, phi_type string, layer string, rule_id string, score double"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, hit) of a pattern that can't match nothing; with group 1 the group ends the match."""
    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def hits(x: Column) -> Column:
        steps = F.transform(x["whole"], lambda w, i: F.length(F.get(x["gaps"], i)) + F.length(w))
        hit = lambda ends: F.transform(x["part"], lambda g, i: F.struct((F.get(ends, i) - F.length(g)).alias("start"), F.get(ends, i).alias("end"), g.alias("hit")))
        return F.when(F.size(x["gaps"]) == F.size(x["whole"]) + 1, let(running(steps), hit))

    whole_text = let(found, hits).cast(_HIT)
    # most texts have no match: one search, and the arrays only where it succeeds
    sure = patterns.required(pattern)
    there = text.contains(sure) & text.rlike(pattern) if sure else text.rlike(pattern)
    return F.when(there, whole_text).otherwise(F.array().cast(_HIT))


def _native(text: Column, rule: Rule) -> Column:
    found = F.filter(matches(text, rule.pattern, rule.group), lambda m: m["start"] < m["end"])
    if rule.checksum:
        found = F.filter(found, lambda m: CHECKSUMS[rule.checksum](m["hit"]))
    named = lambda m: F.struct(
        m["start"].alias("start"),
        m["end"].alias("end"),
        F.lit(rule.phi_type).alias("phi_type"),
        F.lit(rule.layer).alias("layer"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.score).cast("double").alias("score"),
    )
    return F.transform(found, named)


def _python_checks(name: str | None):
    from quillspan.functions import checks_py

    return getattr(checks_py, name) if name else None


def _fallback(docs: DataFrame, rules: list[Rule], doc_id: str, text: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        made = [(r, regex.compile(r.pattern.replace("(?dU", "(?", 1).replace("u)", ")", 1).replace("(?)", "", 1)), _python_checks(r.checksum)) for r in rules]
        for frame in frames:
            rows = []
            for key, value in zip(frame["doc_id"], frame["text"], strict=True):
                for r, pattern, check in made:
                    for m in pattern.finditer(value or ""):
                        s, e = m.span(r.group)
                        if s < e and (check is None or check(m.group(r.group))):
                            rows.append((key, s, e, r.phi_type, r.layer, r.rule_id, r.score))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "phi_type", "layer", "rule_id", "score"])

    picked = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInPandas(run, f"doc_id {kind}, {OUT}")


def detect(docs: DataFrame, rules: Iterable[Rule], doc_id: str = "doc_id", text: str = "text", detector: str = "R", backend: str = "auto") -> DataFrame:
    """doc_id, start, end, phi_type, layer, detector, rule_id, score: every match of every rule."""
    rules = list(rules)
    if backend == "auto":
        way = check_patterns(docs.sparkSession, rules)
    else:
        way = {r.rule_id: "join" if r.terms else backend for r in rules}
    native = [r for r in rules if way[r.rule_id] == "native"]
    other = [r for r in rules if way[r.rule_id] == "fallback"]
    large = [r for r in rules if way[r.rule_id] == "join"]
    parts = []
    if native or not other and not large:
        found = F.concat(*(_native(docs[text], r) for r in native)) if native else F.array().cast(f"array<struct<{OUT.replace(' ', ':').replace(',:', ',')}>>")
        parts.append(docs.select(docs[doc_id].alias("doc_id"), F.explode(found).alias("m")).select("doc_id", "m.*"))
    if other:
        parts.append(_fallback(docs, other, doc_id, text))
    for r in large:
        terms = docs.sparkSession.createDataFrame([(t,) for t in r.terms], "term string")
        parts.append(lexicon.detect_terms(docs, terms, r.rule_id, r.phi_type, r.layer, r.score, doc_id, text, case_sensitive=not r.fold))
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.select("doc_id", "start", "end", "phi_type", "layer", F.lit(detector).alias("detector"), "rule_id", "score")


def sort_spans(spans: DataFrame) -> DataFrame:
    return spans.orderBy("doc_id", "start", "end", F.coalesce("rule_id", F.lit("")))
