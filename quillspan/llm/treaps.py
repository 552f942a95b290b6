"""Ranked lexical search over inverted treaps.

A first pass over all texts finds the terms that items ask for and the length of each
document; its table gives the totals and document frequencies that weights need.  The
second pass reads that table.  A task builds, for some thousand documents at a time,
a treap for each term: its postings, ordered by document and heaped by impact, so that
a subtree's root holds its largest impact.  All items walk the treaps of their terms
at once: an interval of documents whose roots' impacts can't reach an item's tenth
best score is left whole; any other is cut at its strongest root, around which
documents are scored in full.  The best scores so far are carried on within a task.

Items are taken in blocks of bounded size, so that what is sent to executors doesn't
grow with them; documents aren't moved but for each task's ten best of each item.

Terms and scores are those of the contract: 64-bit integers but for the logarithm.
Terms are found by hash and then compared byte by byte.

Defined results: a null or empty text has no terms; it isn't counted and never ranked.
Rows that repeat are documents of their own.  Equal scores go by ascending doc_id, a
null id last.  Items without terms, or with none that a document holds, give no rows;
an item row that repeats is answered again.  Other columns are neither read nor
returned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import kernels as K
from quillspan.llm.store import settle

TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
TOP = 10
ITEM_BYTES = 4 << 20  #: text of a block of items, about; a longer item is a block of its own
SHARD = 4096  #: documents whose treaps are built at once
SHARD_POSTINGS = 1 << 20
NEAR = 16  #: documents either side of a root that are scored with it
WIDE = 1 << 17  #: nodes that a step of the walk looks at, about

# Fixed values of the score.
SCALE, FULL, SLOPE, FLAT = 1000, 1_000_000_000, 90, 100

_LOWER = {i: i + 32 for i in range(65, 91)}
_IN_TERM = np.ones(256, bool)
_IN_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def terms_of(text: str | None) -> list[str]:
    """Terms of one text, plainly: for items, which are few."""
    return re.findall(TERM, (text or "").translate(_LOWER))


def weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = K._power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return K.mix((total[ends] - total[starts]) * down[starts]) if len(starts) else np.empty(0, np.uint64)


def _runs(solid: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; texts end them."""
    begin, stop = solid.copy(), solid.copy()
    if len(solid):
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(solid))]
        begin[cuts] = solid[cuts]
        stop[cuts - 1] = solid[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other."""
    if not len(starts):
        return np.empty(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))


class Vocabulary:
    """The distinct terms of a block of items, found in texts by array passes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        starts = ends - np.array([len(r) for r in raw], np.int64)
        hashes = _hashed(data, starts, ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.data, self.starts, self.sizes = hashes[self.order], data, starts, ends - starts

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, term) of the terms among runs of bytes."""
        hashes = _hashed(data, starts, ends)
        places, found = [], []
        at = np.searchsorted(self.hashes, hashes)
        for step in range(int(np.unique(self.hashes, return_counts=True)[1].max())):  # more than one step only where terms share a hash
            spot = np.minimum(at + step, len(self.hashes) - 1)
            place = np.flatnonzero((self.hashes[spot] == hashes) & (self.sizes[self.order[spot]] == ends - starts))
            term = self.order[spot[place]]
            sizes = self.sizes[term]
            differ = data[_spread(starts[place], sizes)] != self.data[_spread(self.starts[term], sizes)]
            same = np.add.reduceat(differ, np.cumsum(sizes) - sizes) == 0 if len(place) else np.empty(0, bool)
            places.append(place[same])
            found.append(term[same])
        return np.concatenate(places), np.concatenate(found)


_POSTED = "doc_id long, n long, terms array<int>, tfs array<long>"


def _posted(words: Vocabulary):
    """A row for each document: its length in terms, the asked terms in it and how often they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, "text"):
                data, bounds = K.raw(part.column("text"))
                data = _FOLD[data]
                starts, ends = _runs(_IN_TERM[data], bounds)
                place, term = words.find(data, starts, ends)
                owner = np.searchsorted(bounds, starts[place], side="right") - 1
                size = np.int64(len(words.sizes))
                key, tf = np.unique(owner * size + term, return_counts=True)
                offsets = np.searchsorted(key, np.arange(part.num_rows + 1) * size)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in ((key % size).astype(np.int32), tf.astype(np.int64))]
                n = np.diff(np.searchsorted(starts, bounds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])

    return K.tidy(run)


@dataclass
class Items:
    """A block of items: which terms each asks for (padded with -1), and the terms' weights."""

    asked: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_terms: int


@dataclass
class Treaps:
    """Postings of some documents, term by term; a node is a posting's place, and -1 stands for none."""

    keys: np.ndarray  #: term * documents + document, ascending
    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray  #: of each term
    n_docs: int


def build(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int) -> Treaps:
    """Treaps of all terms at once, level by level: of each run of postings that is left the strongest becomes a root and cuts it."""
    order = np.lexsort((doc, term))
    term, doc, impact = term[order], doc[order], impact[order]
    n = len(term)
    place = np.arange(n)
    # equal impacts are ordered at random, which keeps trees shallow
    by_force = np.lexsort((K.mix(place.astype(np.uint64)), impact))
    force = np.empty(n + 1, np.int64)
    force[by_force] = place
    force[n] = -1
    opens = np.ones(n + 1, bool)
    opens[1:n] = term[1:] != term[:-1]
    left, right, roots = np.full(n + 1, -1), np.full(n + 1, -1), np.full(n_terms, -1)
    rest = place
    while len(rest):
        heads = np.flatnonzero(opens[rest] | np.concatenate([[True], rest[1:] != rest[:-1] + 1]))
        root = by_force[np.maximum.reduceat(force[rest], heads)]
        low, high = rest[heads], rest[np.append(heads[1:], len(rest)) - 1]
        before = np.where(opens[low], n, low - 1)
        after = np.where(opens[high + 1], n, high + 1)
        # the later cut of the two at a run's ends, which is the weaker one, is its parent
        up_left = (before < n) & ((after == n) | (force[before] < force[after]))
        up_right = ~up_left & (after < n)
        right[before[up_left]] = root[up_left]
        left[after[up_right]] = root[up_right]
        top = ~up_left & ~up_right
        roots[term[root[top]]] = root[top]
        gone = np.zeros(n, bool)
        gone[root] = True
        rest = rest[~gone[rest]]
    return Treaps(term * np.int64(n_docs) + doc, np.append(doc, 0), np.append(impact, 0), left, right, roots, n_docs)


def _inside(t: Treaps, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The roots of what the subtrees hold of each row's interval."""
    nodes = nodes.copy()
    row, col = np.nonzero(nodes >= 0)
    while len(row):
        at = nodes[row, col]
        d = t.doc[at]
        under, over = d < low[row], d >= high[row]
        out = under | over
        row, col, at, under = row[out], col[out], at[out], under[out]
        at = np.where(under, t.right[at], t.left[at])
        nodes[row, col] = at
        on = at >= 0
        row, col = row[on], col[on]
    return nodes


class Best:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.item, self.score, self.doc, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.bar = np.ones(n_items, np.int64)  #: what a score must reach

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.bar[item]
        if not good.any():
            return
        parts = [np.concatenate([a, b[good]]) for a, b in zip((self.item, self.score, self.doc, self.null), (item, score, doc, null), strict=True)]
        order = np.lexsort((parts[2], parts[3], -parts[1], parts[0]))
        parts = [p[order] for p in parts]
        heads = np.flatnonzero(np.concatenate([[True], parts[0][1:] != parts[0][:-1]]))
        rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        keep = rank < self.top
        last = rank == self.top - 1
        self.bar[parts[0][last]] = parts[1][last]
        self.item, self.score, self.doc, self.null = (p[keep] for p in parts)


def _score(t: Treaps, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, score) of all documents of the intervals that hold a term of their row."""
    row, col = np.nonzero(terms >= 0)
    base = terms[row, col].astype(np.int64) * t.n_docs
    begin = np.searchsorted(t.keys, base + low[row])
    size = np.searchsorted(t.keys, base + high[row]) - begin
    posting = _spread(begin, size)
    width = int((high - low).max())
    cell = np.repeat(row * width, size) + t.doc[posting] - np.repeat(low[row], size)
    total = np.bincount(cell, t.impact[posting], len(low) * width)  # sums stay far below 2^53
    there = np.flatnonzero(total > 0)
    return there // width, low[there // width] + there % width, total[there].astype(np.int64)


def walk(t: Treaps, asked: np.ndarray, item: np.ndarray, best: Best, ids: np.ndarray, null: np.ndarray) -> int:
    """Let items walk the treaps of their terms at once; gives how many documents were scored."""
    nodes = np.where(asked >= 0, t.roots[asked], -1)
    low, high = np.zeros(len(item), np.int64), np.full(len(item), t.n_docs, np.int64)
    row = np.arange(len(item))
    bound = t.impact[nodes].sum(1)
    step = max(1, WIDE // asked.shape[1])
    scored = 0
    while True:
        live = bound >= best.bar[item[row]]
        row, low, high, nodes, bound = row[live], low[live], high[live], nodes[live], bound[live]
        if not len(row):
            return scored
        turn = np.zeros(len(row), bool)  # the intervals that promise most go first: they raise the bars
        turn[np.argpartition(-bound, step - 1)[:step] if len(row) > step else slice(None)] = True
        r, a, b, own = row[turn], low[turn], high[turn], nodes[turn]
        middle = t.doc[own[np.arange(len(r)), t.impact[own].argmax(1)]]
        near_low, near_high = np.maximum(a, middle - NEAR), np.minimum(b, middle + NEAR + 1)
        which, doc, score = _score(t, np.where(own >= 0, asked[r], -1), near_low, near_high)
        scored += len(doc)
        best.add(item[r[which]], score, ids[doc], null[doc])
        # what is left of either side
        r2, a2, b2 = np.concatenate([r, r]), np.concatenate([a, near_high]), np.concatenate([near_low, b])
        some = a2 < b2
        r2, a2, b2, own = r2[some], a2[some], b2[some], np.concatenate([own, own])[some]
        own = _inside(t, own, a2, b2)
        rest = ~turn
        row, low, high = np.concatenate([row[rest], r2]), np.concatenate([low[rest], a2]), np.concatenate([high[rest], b2])
        nodes, bound = np.concatenate([nodes[rest], own]), np.concatenate([bound[rest], t.impact[own].sum(1)])


_FOUND = "item int, doc_id long, score long"


def _searched(items: Items, top: int):
    """The best of a task's documents for each item."""
    counts = (items.asked >= 0).sum(1)
    order = np.argsort(counts, kind="stable")
    groups = [g for g in np.array_split(order, max(1, -(-int(counts.sum()) * 2 // WIDE))) if len(g)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.asked), top)
        for docs in _shards(batches):
            ids = docs.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            n = docs.column("n").to_numpy()
            size = docs.column("terms").value_lengths().to_numpy()
            term = docs.column("terms").flatten().to_numpy()
            tf = docs.column("tfs").flatten().to_numpy()
            if not len(term):
                continue
            place = np.lexsort((ids, null)).argsort()  # documents in the order of their ids
            m = FLAT - SLOPE + SLOPE * n * items.n_docs // items.n_terms
            owner = np.repeat(np.arange(len(n)), size)
            impact = items.weights[term] * (FULL * tf // (SCALE * tf + 8 * m[owner]))
            t = build(term.astype(np.int64), place[owner], impact, len(items.weights), len(n))
            back = np.argsort(place)
            for g in groups:
                asked = items.asked[g]
                walk(t, asked[:, : max(1, int(counts[g].max()))], g, best, ids[back], null[back])
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array(best.doc, mask=best.null), pa.array(best.score)], names=["item", "doc_id", "score"])

    return K.tidy(run)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by the shard: a bounded number of documents and, but for one document's, of postings."""
    held, rows, postings = [], 0, 0
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy())
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = min(at + SHARD - rows, int(np.searchsorted(ends, base + SHARD_POSTINGS - postings, side="right")), batch.num_rows)
            if to <= at and rows == 0:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                rows += to - at
                postings += int(ends[to - 1]) - base
                at = to
            if at < batch.num_rows or rows >= SHARD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _search_block(docs: DataFrame, block: list, kind: str, top: int) -> DataFrame | None:
    """item_id, rank, doc_id, score for a block of item rows."""
    spark = docs.sparkSession
    wanted = [sorted(set(terms_of(r["text"]))) for r in block]
    terms = sorted(set().union(*wanted))
    if not terms:
        return None
    number = {t: i for i, t in enumerate(terms)}
    posted = settle(docs.mapInArrow(_posted(Vocabulary(terms)), _POSTED), "lexical-postings")
    n_docs, n_terms = posted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_terms:
        return None
    df = np.zeros(len(terms), np.int64)
    for r in posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block at most
        df[r["t"]] = r["count"]
    asked = np.full((len(block), max(map(len, wanted))), -1, np.int64)
    for i, w in enumerate(wanted):
        asked[i, : len(w)] = [number[t] for t in w]
    items = Items(asked, np.array([weight(n_docs, int(d)) for d in df], np.int64), n_docs, n_terms)
    found = posted.where(F.size("terms") > 0).mapInArrow(_searched(items, top), _FOUND)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {kind}")
    best = found.withColumn("rank", place).where(F.col("rank") <= top)
    return best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` best documents, all documents ranked."""
    read = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    rows = items.select(items[item_id].alias("item_id"), items[item_text].alias("text"))
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16)).first()[0] or 0
    kind = rows.schema["item_id"].dataType.simpleString()
    n = max(1, -(-size // block_bytes))
    blocks = (rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k).collect() for k in range(n))
    parts = [p for p in (_search_block(read, b, kind, top) for b in blocks if b) if p is not None]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
