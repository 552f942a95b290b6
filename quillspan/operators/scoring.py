"""Scores of predicted spans against gold, as one verdict table and aggregates of it.

A gold span is *covered* when the union of same-type predictions covers it (wholly
in mode fully_covered, by a character in relaxed), and *matched* when a one-to-one
greedy assignment gives it a prediction.  Both ask only for spans that overlap, so
gold and predictions of a document and type are cut into chains of overlapping spans
with one shuffle; a row holds a chain, and its verdicts are worked out within the row.

gold: doc_id, span_index, start, end, phi_type (in scope).  pred: doc_id,
span_index, start, end, phi_type, layer, rule_id.  docs: doc_id.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.model import FAMILY_OF, MODES, SpanError
from quillspan.operators.intervals import DOC_TYPE, overlap, with_island
from quillspan.sources.scratch import remove, written

SPARSE = 8  #: gold spans of a type up to which it counts as sparse
HEADLINE = {"leak_rate": "fully_covered", "lower_bound": "relaxed", "prf": "relaxed"}
_PAIRS = "array<struct<gi:int,pi:int>>"


def in_scope(gold: DataFrame) -> DataFrame:
    return gold.where(~F.col("excluded"))


def check_layers(pred: DataFrame) -> DataFrame:
    """The predictions; a null layer, or a rule_id under two layers, is refused when they are read."""
    return pred.withColumn("layer", F.coalesce("layer", F.raise_error(F.lit("a prediction has no layer")).cast("string")))


def refuse_split_rules(pred: DataFrame) -> None:
    if not pred.where("rule_id is not null").groupBy("rule_id").agg(F.count_distinct("layer").alias("n")).where("n > 1").isEmpty():
        raise SpanError("a rule_id stands under two layers")


def eligible(g: Column, p: Column, mode: str) -> Column:
    """May this prediction, which overlaps the gold span, be assigned to it?"""
    return (p["start"] <= g["start"]) & (g["end"] <= p["end"]) if mode == "fully_covered" else F.lit(True)


def chains(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, phi_type, golds, preds: a row for each chain of overlapping spans, both arrays by start, end and index."""
    own = gold.select("doc_id", "phi_type", "start", "end", "span_index", F.lit(None).cast("string").alias("layer"), F.lit(None).cast("string").alias("rule_id"), F.lit(True).alias("is_gold"))
    rule = F.col("rule_id") if "rule_id" in pred.columns else F.lit(None).cast("string")
    layer = F.col("layer") if "layer" in pred.columns else F.lit(None).cast("string")
    both = own.unionByName(pred.select("doc_id", "phi_type", "start", "end", "span_index", layer.alias("layer"), rule.alias("rule_id"), F.lit(False).alias("is_gold")))
    found = with_island(both, DOC_TYPE, touching=False).groupBy(*DOC_TYPE, "island")
    span = F.struct("start", "end", "span_index", "layer", "rule_id")
    return found.agg(*(F.array_sort(F.collect_list(F.when(F.col("is_gold") == kind, span))).alias(name) for kind, name in ((True, "golds"), (False, "preds")))).drop("island")


def _distinct(preds: Column) -> Column:
    """The first of the predictions that agree in start and end."""
    same = lambda p, i: (F.get(preds, i - 1)["start"] == p["start"]) & (F.get(preds, i - 1)["end"] == p["end"])
    return F.filter(preds, lambda p, i: (i == 0) | ~same(p, i))


def _near(g: Column, preds: Column) -> Column:
    return F.filter(preds, lambda p: (g["start"] < p["end"]) & (p["start"] < g["end"]))


def _length(g: Column, preds: Column) -> Column:
    """Characters of a gold span that the union of predictions, given by start, covers."""
    begin = F.struct(g["start"].cast("int").alias("at"), F.lit(0).alias("n"))

    def add(acc: Column, p: Column) -> Column:
        end = F.least(p["end"], g["end"]).cast("int")
        return F.struct(F.greatest(acc["at"], end).alias("at"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(p["start"].cast("int"), acc["at"]))).alias("n"))

    return F.aggregate(preds, begin, add)["n"]


def _family(layer: Column) -> Column:
    return F.coalesce(*(F.when(layer == name, F.lit(f)) for name, f in FAMILY_OF.items()))


def _lengths(g: Column, near: Column, of) -> Column:
    """Array of (name, n): for each family or layer among the predictions the length that they cover alone."""
    names = F.filter(F.array_distinct(F.transform(near, lambda p: of(p["layer"]))), lambda x: x.isNotNull())
    return F.transform(names, lambda x: F.struct(x.alias("name"), _length(g, F.filter(near, lambda p: of(p["layer"]) == x)).alias("n")))


def covered_lengths(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, span_index, phi_type, start, end, lengths: a map from scope (all, family:f, layer:l) to the characters that its union covers."""

    def measured(g: Column) -> Column:
        near = _near(g, F.col("preds"))
        named = lambda kind, of: F.transform(_lengths(g, near, of), lambda x: F.struct(F.concat(F.lit(f"{kind}:"), x["name"]).alias("scope"), x["n"].alias("n")))
        every = F.filter(F.array(F.struct(F.lit("all").alias("scope"), _length(g, near).alias("n"))), lambda x: F.size(near) > 0)
        return F.struct(g["span_index"].alias("span_index"), g["start"].alias("start"), g["end"].alias("end"), F.map_from_entries(F.concat(every, named("family", _family), named("layer", lambda x: x))).alias("lengths"))

    rows = chains(gold, pred).select("doc_id", "phi_type", F.inline(F.transform("golds", measured)))
    return rows.select("doc_id", "span_index", "phi_type", "start", "end", "lengths")


def _covers(n: Column, size: Column, mode: str) -> Column:
    return n == size if mode == "fully_covered" else n > 0


def coverage(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """doc_id, span_index, covered."""
    return verdicts_light(gold, pred, mode).select("doc_id", "span_index", "covered")


def _assigned(golds: Column, preds: Column, mode: str) -> Column:
    """Array of (gi, pi) of a chain's greedy one-to-one assignment.

    Candidates are taken by overlap (most first), then gold start, gold end, prediction
    start, end and index, gold index; one is kept while neither side has been used.
    """

    def order(g: Column, p: Column) -> Column:
        shared = overlap(g["start"], g["end"], p["start"], p["end"])
        return F.struct((-shared).alias("o"), g["start"].alias("gs"), g["end"].alias("ge"), p["start"].alias("ps"), p["end"].alias("pe"), p["span_index"].cast("int").alias("pi"), g["span_index"].cast("int").alias("gi"))

    pairs = F.flatten(F.transform(golds, lambda g: F.transform(F.filter(_near(g, preds), lambda p: eligible(g, p, mode)), lambda p: order(g, p))))
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["gi"] == x["gi"]) | (y["pi"] == x["pi"]))
    return F.aggregate(F.array_sort(pairs), F.array().cast(_PAIRS), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(F.struct(x["gi"].alias("gi"), x["pi"].alias("pi"))))).otherwise(acc))


def assign(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """doc_id, gold_index, pred_index of the greedy one-to-one assignment, of distinct predictions."""
    taken = chains(gold, pred).select("doc_id", F.inline(_assigned(F.col("golds"), _distinct(F.col("preds")), mode)))
    return taken.select("doc_id", F.col("gi").alias("gold_index"), F.col("pi").alias("pred_index"))


_PAIR_ORDER = ("o", "gs", "ge", "ps", "pe", "pi", "gi")


def overlapping(gold: DataFrame, pred: DataFrame, mode: str, width: int) -> DataFrame:
    """doc_id, phi_type, key (o, gs, ge, ps, pe, pi, gi): the pairs that may be assigned, each once, in the order in which they are taken.

    Spans meet in the stretches of ``width`` characters that they touch, a pair only in
    the one where the later of its spans begins, so a hot document is dealt out too.
    """
    touched = lambda start, end: F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))).alias("at")
    g = gold.select("doc_id", "phi_type", F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("span_index").cast("int").alias("gi"), touched(F.col("start"), F.col("end")))
    p = pred.select("doc_id", "phi_type", F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("span_index").cast("int").alias("pi"), touched(F.col("start"), F.col("end")))
    met = g.join(p, [*DOC_TYPE, "at"]).where((F.col("gs") < F.col("pe")) & (F.col("ps") < F.col("ge")) & (F.floor(F.greatest("gs", "ps") / width) == F.col("at")))
    fits = (F.col("ps") <= F.col("gs")) & (F.col("ge") <= F.col("pe")) if mode == "fully_covered" else F.lit(True)
    return met.where(fits).select(*DOC_TYPE, F.struct((-overlap(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe"))).alias("o"), *_PAIR_ORDER[1:]).alias("key"))


def assign_in_rounds(gold: DataFrame, pred: DataFrame, mode: str, width: int = 256) -> DataFrame:
    """The rows of ``assign`` by rounds over a table of pairs, for chains too dense for one row.

    A pair that is the first in order of both its spans is one that the greedy walk
    takes, whatever lies elsewhere: each round takes all of these and removes what they
    touch, until no pair is left.  Pairs are written after each round, and deleted when
    the next is written.  Orders are total only within distinct predictions
    (``intervals.dedupe``).
    """
    spark = gold.sparkSession
    pairs, path = written(overlapping(gold, pred, mode, width), "pairs")
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        best = lambda side: pairs.groupBy(*DOC_TYPE, F.col(f"key.{side}").alias(side)).agg(F.min("key").alias("key"))  # noqa: B023, E731
        taken, _ = written(best("gi").select(*DOC_TYPE, "key").join(best("pi").select(*DOC_TYPE, "key"), [*DOC_TYPE, "key"]).select(*DOC_TYPE, "key.gi", "key.pi"), "taken")
        rounds.append(taken)
        rest = pairs.select("*", "key.gi", "key.pi")
        for side in ("gi", "pi"):
            rest = rest.join(taken.select(*DOC_TYPE, side), [*DOC_TYPE, side], "left_anti")
        done, (pairs, path) = path, written(rest.select(*DOC_TYPE, "key"), "pairs")
        remove(spark, done)
    remove(spark, path)
    empty = spark.createDataFrame([], "doc_id string, gi int, pi int")
    every = reduce(DataFrame.unionByName, (t.select("doc_id", "gi", "pi") for t in rounds)) if rounds else empty
    return every.select("doc_id", F.col("gi").alias("gold_index"), F.col("pi").alias("pred_index"))


def judged(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """doc_id, phi_type, golds (span_index, start, end, covered, families, layers, matched), preds (distinct: span_index, start, end, rules, matched), a row for each chain."""
    with_pairs = chains(gold, pred).withColumn("taken", _assigned(F.col("golds"), _distinct(F.col("preds")), mode))

    def gold_verdict(g: Column) -> Column:
        near, size = _near(g, F.col("preds")), g["end"] - g["start"]
        alone = lambda of: F.array_sort(F.transform(F.filter(_lengths(g, near, of), lambda x: _covers(x["n"], size, mode)), lambda x: x["name"]))
        return F.struct(
            g["span_index"].alias("span_index"),
            g["start"].alias("start"),
            g["end"].alias("end"),
            _covers(_length(g, near), size, mode).alias("covered"),
            alone(_family).alias("families"),
            alone(lambda x: x).alias("layers"),
            F.exists("taken", lambda t: t["gi"] == g["span_index"]).alias("matched"),
        )

    def pred_verdict(p: Column) -> Column:
        same = F.filter("preds", lambda q: (q["start"] == p["start"]) & (q["end"] == p["end"]) & q["rule_id"].isNotNull())
        rules = F.array_distinct(F.transform(same, lambda q: q["rule_id"]))
        return F.struct(p["span_index"].alias("span_index"), p["start"].alias("start"), p["end"].alias("end"), rules.alias("rules"), F.exists("taken", lambda t: t["pi"] == p["span_index"]).alias("matched"))

    return with_pairs.select("doc_id", "phi_type", F.transform("golds", gold_verdict).alias("golds"), F.transform(_distinct(F.col("preds")), pred_verdict).alias("preds"))


def verdicts(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """Per gold span: covered, matched, families and layers that cover it alone."""
    return judged(gold, pred, mode).select("doc_id", "phi_type", F.inline("golds"))


def distinct_verdicts(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """Distinct predictions with matched and the rules that gave them: the false positives are those that aren't matched."""
    return judged(gold, pred, mode).select("doc_id", "phi_type", F.inline("preds"))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def prf_columns(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; 0 where nothing is there to divide by."""
    return [_or_zero(_ratio(tp, tp + fp)).alias("precision"), _or_zero(_ratio(tp, tp + fn)).alias("recall"), _or_zero(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1")]


def totals(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """In one row: gold, and leaked, tp and fp of each mode (leaked_relaxed and so on).  Both modes are judged where a chain lies, so chains are built once."""
    measured = lambda g: F.struct(_length(g, _near(g, F.col("preds"))).alias("n"), (g["end"] - g["start"]).alias("size"))
    base = chains(gold, pred).select("golds", F.transform("golds", measured).alias("measured"), _distinct(F.col("preds")).alias("once"))
    both = base.withColumns({f"taken_{mode}": _assigned(F.col("golds"), F.col("once"), mode) for mode in MODES})

    def of(mode: str) -> dict[str, Column]:
        has = lambda side, span: F.exists(f"taken_{mode}", lambda t: t[side] == span["span_index"])
        return {
            f"leaked_{mode}": F.filter("measured", lambda x: ~_covers(x["n"], x["size"], mode)),
            f"tp_{mode}": F.filter("golds", lambda g: has("gi", g)),
            f"fp_{mode}": F.filter("once", lambda p: ~has("pi", p)),
        }

    counted = {"gold": F.col("golds")} | {k: v for mode in MODES for k, v in of(mode).items()}
    return both.agg(*(F.coalesce(F.sum(F.size(v)), F.lit(0)).alias(k) for k, v in counted.items()))


def _by_mode(totals: DataFrame, *names: str) -> DataFrame:
    """mode and the named numbers, a row for each mode, and gold."""
    rows = (F.struct(F.lit(mode).alias("mode"), *(F.col(f"{n}_{mode}").alias(n) for n in names), F.col("gold")) for mode in MODES)
    return totals.select(F.inline(F.array(*rows)))


def leak_rate(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """mode, leaked, gold, leak_rate: null without gold."""
    return _by_mode(totals(gold, pred), "leaked").select("mode", "leaked", "gold", _ratio(F.col("leaked"), F.col("gold")).alias("leak_rate"))


def verdicts_light(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    near = lambda g: _length(g, _near(g, F.col("preds")))
    seen = lambda g: F.struct(g["span_index"].alias("span_index"), g["start"].alias("start"), g["end"].alias("end"), _covers(near(g), g["end"] - g["start"], mode).alias("covered"))
    return chains(gold, pred).select("doc_id", "phi_type", F.inline(F.transform("golds", seen)))


def prf_overall(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """mode, tp, fp, fn, precision, recall, f1 over all types."""
    rows = _by_mode(totals(gold, pred), "tp", "fp").withColumn("fn", F.col("gold") - F.col("tp"))
    return rows.select("mode", "tp", "fp", "fn", *prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def _counts_by_type(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """phi_type, gold, leaked, tp, fp, fn: for types with gold and for those with false positives only."""
    return _type_counts(judged(gold, pred, mode))


def _type_counts(verdict: DataFrame) -> DataFrame:
    n = lambda c, test: F.sum(F.size(F.filter(c, test))).cast("long")
    found = verdict.groupBy("phi_type").agg(
        F.sum(F.size("golds")).cast("long").alias("gold"),
        n("golds", lambda g: ~g["covered"]).alias("leaked"),
        n("golds", lambda g: g["matched"]).alias("tp"),
        n("preds", lambda p: ~p["matched"]).alias("fp"),
    )
    return found.where("gold > 0 or fp > 0").withColumn("fn", F.col("gold") - F.col("tp"))


def by_type(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """Per type: gold, leaked, leak_rate, tp, fp, fn, precision, recall, f1, sparse."""
    return _by_type(_counts_by_type(gold, pred, mode))


def _by_type(counts: DataFrame) -> DataFrame:
    return counts.select(
        "phi_type", "gold", "leaked", _ratio(F.col("leaked"), F.col("gold")).alias("leak_rate"), "tp", "fp", "fn", *prf_columns(F.col("tp"), F.col("fp"), F.col("fn")), ((F.col("gold") > 0) & (F.col("gold") <= SPARSE)).alias("sparse")
    )


def macro(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """Means over types that have gold, null without any; n_types."""
    return _macro(by_type(gold, pred, mode))


def _macro(types: DataFrame) -> DataFrame:
    return types.where("gold > 0").agg(*(F.round(F.avg(c), 9).alias(c) for c in ("precision", "recall", "f1", "leak_rate")), F.count("*").alias("n_types"))


def by_document(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """docs_with_leak, docs_with_gold, rate."""
    return _by_document(verdicts_light(gold, pred, mode))


def _by_document(seen: DataFrame) -> DataFrame:
    each = seen.groupBy("doc_id").agg(F.max((~F.col("covered")).cast("int")).alias("leaks"))
    return each.agg(F.coalesce(F.sum("leaks"), F.lit(0)).cast("long").alias("docs_with_leak"), F.count("*").alias("docs_with_gold")).withColumn("rate", _ratio(F.col("docs_with_leak"), F.col("docs_with_gold")))


def assignment_slack(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    return verdicts(gold, pred, mode).agg(F.coalesce(F.sum((F.col("covered") & ~F.col("matched")).cast("long")), F.lit(0)).alias("slack"))


def by_rule(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """Per rule: layer, fires (emissions), tp and fp over its distinct spans; every rule that emits a span has the credit."""
    emitted = pred.where("rule_id is not null")
    fires = emitted.groupBy("rule_id").agg(F.min("layer").alias("layer"), F.count("*").alias("fires"))
    return _by_rule(distinct_verdicts(gold, pred, mode), fires)


def _by_rule(distinct: DataFrame, fires: DataFrame) -> DataFrame:
    own = distinct.select(F.explode("rules").alias("rule_id"), "matched")
    credit = own.groupBy("rule_id").agg(F.sum(F.col("matched").cast("long")).alias("tp"), F.sum((~F.col("matched")).cast("long")).alias("fp"))
    return fires.join(credit, "rule_id").select("rule_id", "layer", "fires", "tp", "fp")


def _category() -> Column:
    rules, tagger = F.array_contains("families", "rules"), F.array_contains("families", "tagger")
    return F.when(rules & tagger, "both").when(rules, "rules_only").when(tagger, "tagger_only").when(F.col("covered"), "joint_only").otherwise("neither")


def complementarity_families(gold: DataFrame, pred: DataFrame, mode: str, by_type: bool = False) -> DataFrame:
    """category, n: which families cover a gold span by themselves (phi_type in front if asked for)."""
    keys = ["phi_type"] * by_type + ["category"]
    return verdicts(gold, pred, mode).withColumn("category", _category()).groupBy(*keys).agg(F.count("*").alias("n"))


def complementarity_layers(gold: DataFrame, pred: DataFrame, mode: str, by_type: bool = False) -> DataFrame:
    """layers (joined by |, empty for none), covered, n."""
    keys = ["phi_type"] * by_type + ["layers", "covered"]
    return verdicts(gold, pred, mode).withColumn("layers", F.array_join("layers", "|")).groupBy(*keys).agg(F.count("*").alias("n"))


def covered_by_layer(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    return verdicts(gold, pred, mode).select(F.explode("layers").alias("layer")).groupBy("layer").agg(F.count("*").alias("n"))


def counts(docs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: documents, with_gold, without_gold, in_scope, excluded, excluded_share, predictions; gold with excluded."""
    keys = docs.select("doc_id").distinct()
    has = in_scope(gold).select("doc_id").distinct().withColumn("has", F.lit(1))
    d = keys.join(has, "doc_id", "left").agg(F.count("*").alias("documents"), F.count("has").alias("with_gold")).withColumn("k", F.lit(1))
    g = gold.agg(F.coalesce(F.sum((~F.col("excluded")).cast("long")), F.lit(0)).alias("in_scope"), F.coalesce(F.sum(F.col("excluded").cast("long")), F.lit(0)).alias("excluded")).withColumn("k", F.lit(1))
    p = pred.agg(F.count("*").alias("predictions")).withColumn("k", F.lit(1))
    return d.join(g, "k").join(p, "k").select(
        "documents", "with_gold", (F.col("documents") - F.col("with_gold")).alias("without_gold"), "in_scope", "excluded", _ratio(F.col("excluded"), F.col("in_scope") + F.col("excluded")).alias("excluded_share"), "predictions"
    )


def fp_opportunity(docs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """documents without gold, and the predictions in them."""
    free = docs.select("doc_id").distinct().join(in_scope(gold).select("doc_id").distinct(), "doc_id", "left_anti")
    n = pred.groupBy("doc_id").agg(F.count("*").alias("n"))
    return free.join(n, "doc_id", "left").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("predictions"))


def headline(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """leak_rate (fully_covered), lower_bound (relaxed), precision, recall and f1 (relaxed) in one row."""
    rates = (_ratio(F.col(f"leaked_{HEADLINE[name]}"), F.col("gold")).alias(name) for name in ("leak_rate", "lower_bound"))
    tp, fp = F.col(f"tp_{HEADLINE['prf']}"), F.col(f"fp_{HEADLINE['prf']}")
    return totals(gold, pred).select(*rates, *prf_columns(tp, fp, F.col("gold") - tp))


def error_spans(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Uncovered gold (fully_covered) and unmatched distinct predictions (relaxed): the six error fields."""
    once = chains(gold, pred).withColumn("once", _distinct(F.col("preds")))
    matched = once.withColumn("taken", _assigned(F.col("golds"), F.col("once"), "relaxed"))
    error = lambda x, kind: F.struct(x["span_index"].alias("span_index"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    missed = F.filter("golds", lambda g: ~_covers(_length(g, _near(g, F.col("preds"))), g["end"] - g["start"], "fully_covered"))
    wrong = F.filter("once", lambda p: ~F.exists("taken", lambda t: t["pi"] == p["span_index"]))
    errors = F.concat(F.transform(missed, lambda g: error(g, "missed")), F.transform(wrong, lambda p: error(p, "false_positive")))
    return matched.select("doc_id", "phi_type", F.inline(errors)).select("doc_id", "span_index", "phi_type", "kind", "start", "end")


def sort_errors(errors: DataFrame) -> DataFrame:
    return errors.orderBy("doc_id", "start", "end", "phi_type", "kind", "span_index")


def score(docs: DataFrame, gold: DataFrame, pred: DataFrame) -> dict:
    """The whole record as a nested dict; only aggregates reach the driver.

    Verdicts are worked out once for each mode and kept for all aggregates of it.
    """
    refuse_split_rules(check_layers(pred))
    inside = in_scope(gold)
    one = lambda df: (df.first() or [None]).asDict()
    rows = lambda df, key: {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}
    kept = {mode: judged(inside, pred, mode).persist() for mode in MODES}
    fires = pred.where("rule_id is not null").groupBy("rule_id").agg(F.min("layer").alias("layer"), F.count("*").alias("fires")).persist()
    try:
        types = {mode: _by_type(_type_counts(kept[mode])).persist() for mode in MODES}
        duplicates = dedupe_drop(pred)
        out = {"counts": one(counts(docs, gold, pred)), "fp_opportunity": one(fp_opportunity(docs, gold, pred)), "modes": {}}
        for mode in MODES:
            of_gold, of_type = kept[mode].select("doc_id", "phi_type", F.inline("golds")), types[mode]
            total = of_type.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "leaked", "tp", "fp", "fn"))).withColumn("mode", F.lit(mode))
            sums = one(total.select("gold", "leaked", _ratio(F.col("leaked"), F.col("gold")).alias("leak_rate"), "tp", "fp", "fn", *prf_columns(F.col("tp"), F.col("fp"), F.col("fn"))))
            cross = of_gold.groupBy(_category().alias("category"), F.array_join("layers", "|").alias("layers"), "covered", "matched").agg(F.count("*").alias("n")).collect()
            families, layers, by_layer = Counter(), Counter(), Counter()
            for r in cross:  # a row for each combination of layers
                families[r["category"]] += r["n"]
                layers[r["layers"], r["covered"]] += r["n"]
                by_layer.update({layer: r["n"] for layer in r["layers"].split("|") if layer})
            out["modes"][mode] = {
                "leak": {k: sums[k] for k in ("leaked", "gold", "leak_rate")},
                "micro": {k: sums[k] for k in ("tp", "fp", "fn", "precision", "recall", "f1")},
                "macro": one(_macro(of_type)),
                "by_type": rows(of_type, "phi_type"),
                "by_document": one(_by_document(of_gold)),
                "assignment_slack": sum(r["n"] for r in cross if r["covered"] and not r["matched"]),
                "by_rule": rows(_by_rule(kept[mode].select(F.inline("preds")), fires), "rule_id"),
                "families": dict(families),
                "layers": dict(layers),
                "covered_by_layer": dict(by_layer),
                "duplicates": duplicates,
            }
            types[mode].unpersist()
    finally:
        for table in (*kept.values(), fires):
            table.unpersist()
    modes = out["modes"]
    head = {k: modes[mode]["leak"]["leak_rate"] for k, mode in HEADLINE.items() if k != "prf"}
    out["headline"] = head | {k: modes[HEADLINE["prf"]]["micro"][k] for k in ("precision", "recall", "f1")}
    return out


def dedupe_drop(pred: DataFrame) -> int:
    distinct = pred.groupBy("doc_id", "start", "end", "phi_type").agg(F.count("*").alias("n"))
    return distinct.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
