"""Rounds of rule writing: the stopping rule, cost sums, and one round over a fold."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.model import SpanError
from quillspan.operators import detect, scoring
from quillspan.sources.rules import RuleSet

# Least improvement in spans and as a rate, rounds in a row, most rounds.
DELTA_SPANS, DELTA_FLOOR, IN_A_ROW, CEILING = 26, 0.005, 2, 8
CACHING_KEYS = frozenset({"enabled", "boundary", "ttl", "read_tokens", "write_tokens"})
COST_KEYS = frozenset({"llm_calls", "prompt_tokens", "completion_tokens", "wall_seconds"})


def delta(n_dev: int) -> float:
    if n_dev < 1:
        raise SpanError("a fold without gold has no delta")
    return max(DELTA_FLOOR, DELTA_SPANS / n_dev)


def improvements(rates: Sequence[float]) -> list[float]:
    return [a - b for a, b in zip(rates, rates[1:])]


@dataclass(frozen=True)
class Verdict:
    reason: str | None
    converged: bool
    iterations: int
    delta: float
    improvements: tuple[float, ...]


def should_stop(rates: Sequence[float], n_dev: int, in_a_row: int = IN_A_ROW, ceiling: int = CEILING) -> Verdict:
    """Converged when the last improvements are all below delta; that is asked before the ceiling."""
    if len(rates) > ceiling:
        raise SpanError("more rounds than the ceiling")
    d, gains = delta(n_dev), improvements(rates)
    done = len(gains) >= in_a_row and all(g < d for g in gains[-in_a_row:])
    reason = "converged" if done else "ceiling" if len(rates) == ceiling else None
    return Verdict(reason, done, len(rates), d, tuple(gains))


def not_applicable(n_dev: int | None = None) -> Verdict:
    """The record of an arm without rounds: one scored set of rules, no difference, and the threshold that would have held."""
    return Verdict("not_applicable", False, 1, 0.0 if n_dev is None else delta(n_dev), ())


@dataclass(frozen=True)
class PendingTermination:
    """A round's verdict that lacks its own leak rate: whoever scores the round completes it."""

    n_dev: int
    previous: tuple[float, ...] = ()

    def resolve(self, leak_rate: float) -> Verdict:
        return should_stop((*self.previous, leak_rate), self.n_dev)


def termination_table(rates: DataFrame, in_a_row: int = IN_A_ROW, ceiling: int = CEILING) -> DataFrame:
    """series, round, leak_rate, n_dev -> gain, below, stop, reason, for many series of rounds at once."""
    order = Window.partitionBy("series").orderBy("round")
    d = F.greatest(F.lit(DELTA_FLOOR), DELTA_SPANS / F.col("n_dev"))
    gained = rates.withColumn("gain", F.lag("leak_rate").over(order) - F.col("leak_rate")).withColumn("below", F.coalesce(F.col("gain") < d, F.lit(False)))
    recent = F.sum(F.col("below").cast("int")).over(order.rowsBetween(-(in_a_row - 1), 0))
    converged = (F.col("round") > in_a_row) & (recent == in_a_row)
    reason = F.when(converged, "converged").when(F.col("round") >= ceiling, "ceiling")
    return gained.withColumn("reason", reason).select("series", "round", "gain", "below", F.col("reason").isNotNull().alias("stop"), "reason")


def sum_costs(blocks: Iterable[dict]) -> dict:
    blocks = list(blocks)
    if any(set(b) != COST_KEYS for b in blocks):
        raise SpanError("a cost block's keys are not the closed set")
    return {k: round(sum(b[k] for b in blocks), 3) if k == "wall_seconds" else sum(b[k] for b in blocks) for k in sorted(COST_KEYS)}


def sum_caching(blocks: Iterable[dict | None]) -> dict | None:
    """Tokens of the calls that were cached added up, None without any; boundaries and lifetimes must agree, blocks must be whole."""
    given = [b for b in blocks if b is not None]
    if any(set(b) != CACHING_KEYS or None in b.values() for b in given):
        raise SpanError("a caching block's keys are not the closed set")
    if not given:
        return None
    if len({(b["boundary"], b["ttl"]) for b in given}) != 1:
        raise SpanError("caching settings differ between rounds")
    return {k: given[0][k] for k in ("enabled", "boundary", "ttl")} | {k: sum(b[k] for b in given) for k in ("read_tokens", "write_tokens")}


def run_fold(docs: DataFrame, gold: DataFrame, rules: RuleSet, detector: str = "R") -> tuple[DataFrame, dict]:
    """Detect over a fold and score: the predictions and the record."""
    found = detect.detect(docs, rules.rules, detector=detector)
    found = found.persist()  # detection runs once for all aggregates
    try:
        return found, scoring.score(docs, gold, numbered(found))
    finally:
        found.unpersist()


def numbered(found: DataFrame) -> DataFrame:
    return found.withColumn("span_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "rule_id")) - 1)


def run_arm(docs: DataFrame, gold: DataFrame, author: Callable[[], dict], lang: str, root: str, run: dict, cost: dict) -> dict | None:
    """The one-shot arm: the author's rules are read, run over the fold, scored and written; None if they can't be read.

    What an author gives that is no rule file leaves a failure record and no scores.
    """
    from quillspan.plans import ledger
    from quillspan.sources.records import write_spans
    from quillspan.sources.rules import parse_rules

    arm = {k: run[k] for k in ("corpus", "detector", "supervision", "porting")}
    given = author()
    try:
        rules = parse_rules(given, lang)
    except SpanError as e:
        ledger.write_failure(ledger.path_of("formatfailure", root, **arm), run, cost, str(e))
        return None
    found, record = run_fold(docs, gold, rules, run["detector"])
    n_dev = gold.where("not excluded").count()
    write_spans(found, str(ledger.path_of("spans", root, **arm)))
    return ledger.write_metrics(ledger.path_of("metrics", root, **arm), record, run, cost, ledger.termination_block(not_applicable(n_dev or None), n_dev))


def run_rounds(
    docs: DataFrame,
    gold: DataFrame,
    author: Callable[[int, DataFrame | None, DataFrame | None], RuleSet],
    auditor: Callable[[DataFrame], DataFrame] | None,
    corpus: str,
    ceiling: int = CEILING,
    keep: Callable[[int, DataFrame, dict, Verdict], None] | None = None,
) -> tuple[list[dict], Verdict]:
    """Author, detect, score, and from the second round on audit the masked fold, until the stopping rule fires.

    author(round, sample, flags) gives rules; auditor(masked) gives doc_id, response;
    keep(round, predictions, record, verdict) writes what a round leaves.
    """
    from quillspan.operators import flags, masking, sampling

    records: list[dict] = []
    rates: list[float] = []
    n_dev = gold.where("not excluded").count()
    sample = judged = None
    verdict = should_stop(rates, n_dev, ceiling=ceiling)
    while verdict.reason is None:
        turn = len(records) + 1
        found, record = run_fold(docs, gold, author(turn, sample, judged))
        records.append(record)
        rates.append(record["modes"]["fully_covered"]["leak"]["leak_rate"])
        verdict = should_stop(rates, n_dev, ceiling=ceiling)
        if keep:
            keep(turn, found, record, verdict)
        if verdict.reason is None:
            sample = sampling.draw_hash(scoring.error_spans(scoring.in_scope(gold), numbered(found)), corpus, turn + 1)
            if auditor:
                masked = masking.mask_documents(docs, found)
                judged = flags.validate(auditor(masked), masking.masked_lines(masked))
    return records, verdict


def check_rules_report(pred: DataFrame, sample: DataFrame, gold: DataFrame) -> DataFrame:
    """Author feedback per rule: sampled errors that a single prediction of it covers or touches, its matches, and those on no gold."""
    p = pred.where("rule_id is not null").select("doc_id", "phi_type", "start", "end", "rule_id").distinct()
    s = sample.where("kind = 'missed'").select(F.col("doc_id").alias("d"), F.col("phi_type").alias("t"), F.col("start").alias("s"), F.col("end").alias("e"))
    near = (F.col("doc_id") == F.col("d")) & (F.col("phi_type") == F.col("t")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))
    met = p.join(s, near).groupBy("rule_id", "d", "t", "s", "e").agg(F.max(((F.col("start") <= F.col("s")) & (F.col("e") <= F.col("end"))).cast("int")).alias("whole"))
    caught = met.groupBy("rule_id").agg(F.sum("whole").alias("caught"), F.sum(1 - F.col("whole")).alias("partial"))
    g = gold.select(F.col("doc_id").alias("d"), F.col("phi_type").alias("t"), F.col("start").alias("s"), F.col("end").alias("e"))
    stray = p.join(g, near, "left_anti").groupBy("rule_id").agg(F.count("*").alias("off_gold"))
    every = p.groupBy("rule_id").agg(F.count("*").alias("matches"))
    return every.join(caught, "rule_id", "left").join(stray, "rule_id", "left").na.fill(0, ["caught", "partial", "off_gold"])
