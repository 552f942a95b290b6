"""Large lexicons as a join: terms that would not fit one regular expression.

Texts fall into tokens, runs of word characters and single other characters.  A term
that is guarded at its edges begins and ends where tokens do, so it is a sequence of
tokens.  The lexicon is indexed by a term's first token and number of tokens: token
places meet the first tokens, then the sequences of the lengths that such terms have
meet the terms themselves.  Joins broadcast the lexicon's side only up to a size that
is measured, and shuffle beyond it.  Up to that size a task knows the lexicon, and
looks at whole columns of tokens for the sequences that go into the join: those that
are terms, and those with letters beyond ASCII, whose folding is left to the join.
Matches move once, to their text's other matches.  Of the matches of a text those stay that a
search from left to right would take: the longest at a place, then on behind it.

The rows are those of ``patterns.gazetteer`` over the same terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.arrays import let, running

#: Beyond so many terms a rule becomes a join.
MOST_ALTERNATION = 1000
#: Bytes of the lexicon's side of a join that are sent to all executors.
BROADCAST_BYTES = 32 << 20
#: Tokens that a task looks at in one go, about; no result depends on it.
STRETCH = 1 << 20
TOKEN = r"(?dU)\w+|[^\w]"


def folded(text: Column) -> Column:
    """Texts that match regardless of case are equal when folded (some others are too)."""
    return F.lower(F.upper(F.translate(text, "İ", "I")))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def index_terms(terms: DataFrame, term: str = "term", case_sensitive: bool = False) -> DataFrame:
    """term, plain (folded unless case counts), first (token), n (tokens) of the distinct terms; empty ones are left out."""
    plain = F.col("term") if case_sensitive else folded(F.col("term"))
    distinct = terms.select(terms[term].cast("string").alias("term")).where(F.length("term") > 0).distinct()
    return distinct.select("term", plain.alias("plain")).withColumn("t", _tokens(F.col("plain"))).select("term", "plain", F.get("t", F.lit(0)).alias("first"), F.size("t").alias("n"))


def _fitting(table: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(table) if n_bytes <= BROADCAST_BYTES else table


def _sequences(lexicon: pa.Table, case_sensitive: bool):
    """Of rows of tokens the sequences that may be terms: row, doc_id, start, hit, plain (null where the join has to fold)."""
    plains = {n: lexicon.filter(pc.equal(lexicon["n"], n)) for n in sorted(pc.unique(lexicon["n"]).to_pylist())}
    terms = {n: (pc.unique(of["first"]), pc.unique(of["plain"])) for n, of in plains.items()}

    def known(texts: pa.Array, among: pa.Array) -> np.ndarray:
        if case_sensitive:
            return pc.is_in(texts, value_set=among).to_numpy(zero_copy_only=False)
        # what is all ASCII folds to its small letters; of the rest only the join can tell
        found = pc.or_(pc.is_in(pc.ascii_lower(texts), value_set=among), pc.invert(pc.string_is_ascii(texts)))
        return found.to_numpy(zero_copy_only=False)

    def of(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = part.column("t").flatten()
        counts = pc.list_value_length(part.column("t")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        doc, until = np.repeat(np.arange(len(counts)), counts), np.repeat(ends, counts)
        chars = np.concatenate([[0], np.cumsum(pc.utf8_length(tokens).to_numpy(zero_copy_only=False))])
        start = (chars[:-1] - chars[ends - counts][doc]).astype(np.int32)
        kinds = tokens.dictionary_encode()
        kind = kinds.indices.to_numpy(zero_copy_only=False)
        for n, (firsts, whole) in terms.items():
            at = np.flatnonzero(known(kinds.dictionary, firsts)[kind] & (np.arange(n, n + len(kind)) <= until))
            hits = tokens.take(pa.array(at))
            if n > 1:
                hits = pc.binary_join_element_wise(hits, *(tokens.take(pa.array(at + i)) for i in range(1, n)), "")
            kept = known(hits, whole)
            at, which, hits = at[kept], pa.array(doc[at[kept]]), hits.filter(pa.array(kept))
            plain = hits if case_sensitive else pc.if_else(pc.string_is_ascii(hits), pc.ascii_lower(hits), None)
            yield pa.RecordBatch.from_arrays([part.column("row").take(which), part.column("doc_id").take(which), pa.array(start[at]), hits, plain], names=["row", "doc_id", "start", "hit", "plain"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(total):
                before = total[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(total, before + STRETCH, side="right")))
                yield from of(batch.slice(begin, end - begin))
                begin = end

    return run


def _joined_sequences(rows: DataFrame, lexicon: DataFrame, longest: int, fold) -> DataFrame:
    """The same for a lexicon that no task can hold: token places meet the first tokens of terms by a shuffle."""
    heads = lexicon.groupBy("first").agg(F.sort_array(F.collect_set("n")).alias("lengths"))

    def spots(b: Column) -> Column:
        """Each token with its place and those behind it, as many as the longest term has."""
        # not slice(), which looks at the whole array each time
        own = lambda i: F.transform(F.sequence(i, F.least(i + longest, F.size(b["t"])) - 1), lambda j: F.get(b["t"], j))
        return F.transform(b["s"], lambda s, i: F.struct(s.alias("start"), own(i).alias("t")))

    def placed(t: Column) -> Column:
        return let(running(F.transform(t, F.length)), lambda ends: spots(F.struct(t.alias("t"), F.transform(ends, lambda e, i: e - F.length(F.get(t, i))).alias("s"))))

    at = rows.select("row", "doc_id", F.explode(let(_tokens(F.col("text")), placed)).alias("x")).select("row", "doc_id", "x.*").withColumn("first", fold(F.get("t", F.lit(0))))
    begun = at.join(heads, "first").select("row", "doc_id", "start", F.explode(F.filter("lengths", lambda n: n <= F.size("t"))).alias("n"), "t")
    return begun.select("row", "doc_id", "start", F.array_join(F.slice("t", F.lit(1), F.col("n")), "").alias("hit"))


def find_terms(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text", term: str = "term", case_sensitive: bool = False) -> DataFrame:
    """doc_id, start, end, hit, term: where terms stand, as a left-to-right search for the longest would find them."""
    lexicon = index_terms(terms, term, case_sensitive)
    size, longest = lexicon.agg(F.sum(2 * F.octet_length("plain") + 32), F.max("n")).first()
    if not size:
        empty = docs.select(docs[doc_id].alias("doc_id")).limit(0)
        return empty.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("hit"), F.lit("").alias("term"))
    fold = (lambda x: x) if case_sensitive else folded

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_id].alias("doc_id"), docs[text].alias("text")).where(F.col("text").isNotNull())
    if size <= BROADCAST_BYTES:
        made = T.StructType([rows.schema["row"], rows.schema["doc_id"], T.StructField("start", T.IntegerType()), T.StructField("hit", T.StringType()), T.StructField("plain", T.StringType())])
        known = lexicon.select("first", "n", "plain").toArrow()
        grams = rows.select("row", "doc_id", _tokens(F.col("text")).alias("t")).mapInArrow(_sequences(known, case_sensitive), made)
    else:
        grams = _joined_sequences(rows, lexicon, longest, fold).withColumn("plain", F.lit(None).cast("string"))
    grams = grams.withColumn("plain", F.coalesce("plain", fold(F.col("hit"))))
    met = grams.join(_fitting(lexicon.select("plain", "term"), size), "plain").withColumn("end", F.col("start") + F.length("hit"))
    if not case_sensitive:  # folding joins a few more than a search without case would
        pattern = F.concat(F.lit("(?dUiu)^(?:"), F.regexp_replace("term", r"([^\w\s])", r"\\$1"), F.lit(")$"))
        # a pattern is compiled for each row that asks for one; what is all ASCII on both sides has met by its small letters
        plain = lambda c: F.octet_length(c) == F.length(c)
        met = met.where(F.when(F.col("hit") == F.col("term"), True).when(plain("hit") & plain("term"), True).otherwise(F.regexp_like("hit", pattern)))
    # rows move to their text's other rows here, and not again
    ordered = met.select("row", "doc_id", "start", "end", "hit", "term").repartition("row", "doc_id").sortWithinPartitions("row", "start", F.desc("end"), "term")
    return ordered.mapInArrow(_leftmost_longest, ordered.schema).select("doc_id", "start", "end", "hit", "term")


def _leftmost_longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spans that overlap those that a search from left to right takes; a text's spans come by start, the longest first, then by term."""
    text, reach = None, 0
    for batch in batches:
        kept = []
        for i, (row, start, end) in enumerate(zip(*(batch.column(c).to_numpy().tolist() for c in ("row", "start", "end")))):
            if row != text:
                text, reach = row, 0
            if start >= reach:
                kept.append(i)
                reach = end
        yield batch.take(pa.array(kept, pa.int64()))


def detect_terms(docs: DataFrame, terms: DataFrame, rule_id: str, phi_type: str, layer: str = "gazetteer", score: float | None = None, doc_id: str = "doc_id", text: str = "text", term: str = "term", case_sensitive: bool = False) -> DataFrame:
    """doc_id, start, end, phi_type, layer, rule_id, score: a gazetteer rule of any size."""
    found = find_terms(docs, terms, doc_id, text, term, case_sensitive)
    return found.select("doc_id", "start", "end", F.lit(phi_type).alias("phi_type"), F.lit(layer).alias("layer"), F.lit(rule_id).alias("rule_id"), F.lit(score).cast("double").alias("score"))
