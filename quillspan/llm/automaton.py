"""LM scoring (operator 10): a backoff model with the n-grams of all words of the corpus.

All training documents give exact counts of their tokens (words, and an end after
each text) and of their bigrams and trigrams; a text begins behind an end.  There is
no alphabet: every n-gram of every word counts, however rare.  A history h that was
seen C(h) times is a state.  Its arc for a token w has the probability
(c(h w) + prior * P(w | h')) / (C(h) + prior), where h' is the history one word
shorter, and its failure arc the weight prior / (C(h) + prior); so each state's
probabilities add up to 1.  At the root a token has its count less a discount, and
unseen words share what the discounts free as one token, as in the base score.

Counts travel by shuffle and never gather in one place.  Documents are cut into
blocks of about ``BLOCK_BYTES``.  A block asks for its distinct n-grams, with their
counts in its training texts, in ``SHARDS`` slices of the key space (more for very
large inputs); a shard adds up what all blocks hold of its keys and answers each
with the totals, in the order asked.  The key space is asked in ``PASSES`` stretches, one
after the other, so that only one stretch's requests lie on disk at a time.  A
block's sorted keys and the answers by shard are the same sequence, so answers carry no keys.  From them each block builds the
part of the automaton that its texts pass, and walks every text once from left to
right: the state is carried along, a token without an arc takes failure arcs down to
a state that has one, and the weights on the way add up.

A null or empty text has the end as its only token.  A null doc_id's crc32 is that
of the empty text.  Repeated rows are scored each.  Without any training document
every score is 0.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernels as K
from quillspan.llm.kneser import pair_key, triple_key
from quillspan.llm.store import settle

FOLDS = 10
ADD = 0.1
ORDERS = 3
PRIORS = (64.0, 8.0)  #: weight of the shorter history, for bigrams and trigrams
BLOCK_BYTES = 16 << 20  #: no result depends on it
WALK_TOKENS = 1 << 18  #: tokens whose part of the automaton is built at a time; no result depends on it
SHARDS = 512
SHARD_BYTES = 1 << 25  #: text for each shard, at most
PASSES = 2  #: no result depends on it
END = np.uint64(0xE7037ED1A0B428DB)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a chunk (an end behind each text) and where each text's begin."""
    w = K.words(texts, lower=True)
    many = w.counts + 1
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(int(first[-1]), np.uint64)
    ends = np.zeros(len(out), dtype=bool)
    ends[first[1:] - 1] = True
    out[ends] = END
    out[~ends] = w.hashes
    return out, first


REQUESTS = "shard int, block long, " + ", ".join(f"keys{n} binary, own{n} binary" for n in range(ORDERS))
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ANSWERS = "shard int, block long, " + ", ".join(f"all{n} binary" for n in range(ORDERS)) + ", tokens long, kinds long, once long, twice long"


def block_tokens(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a block, and where each text's begin."""
    parts = [tokens(part.column("text")) for part in K.chunks(block, "text")]
    many = [np.diff(first) for _, first in parts]
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate(many))])


def ngrams(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Keys of each token's n-grams; a text begins behind an end.  A text's first token has no trigram (the last is 0 there)."""
    one = np.concatenate([[END], h[:-1]])
    two = np.concatenate([[END, END], h[:-2]])[: len(h)]
    three = triple_key(two, one, h)
    three[first[:-1]] = 0
    return [h, pair_key(one, h), three]


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys: bytes of their differences, plane by plane, without the high planes that are all zero."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 0
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + squeeze(planes)


def unpack(packed: bytes) -> np.ndarray:
    width, flat = packed[0], np.frombuffer(spread(packed[1:]), np.uint8)
    if not width:
        return np.empty(0, np.uint64)
    planes = flat.reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def squeeze(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def spread(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _cut(most: int):
    """The rows with the number of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in K.chunks(batch, "text", most):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, n)), *part.columns], names=["block", *part.schema.names])
                n += 1

    return run


def _ask(shards: int, most: int, begin: int, end: int):
    """A block's distinct n-grams of the shards from begin to end and how often each stands in its training texts, cut by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:]):
                for part in K.chunks(batch.slice(a, b - a), "text", most):
                    yield from asked(part, int(blocks[a]))

    def asked(part: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        h, first = block_tokens(part)
        train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), np.diff(first))
        columns: list[list[bytes]] = []
        for k in ngrams(h, first):
            of = shard_of(k, shards)
            here = (of >= begin) & (of < end)
            keys, place = np.unique(k[here], return_inverse=True)
            own = np.bincount(place, weights=train[here], minlength=len(keys)).astype(np.uint32)
            cuts = np.concatenate([[0], np.searchsorted(shard_of(keys, shards), np.arange(begin + 1, end)), [len(keys)]]).tolist()
            columns.append([pack(keys[x:y]) for x, y in zip(cuts, cuts[1:])])
            columns.append([squeeze(own[x:y]) for x, y in zip(cuts, cuts[1:])])
        arrays = [pa.array(np.arange(begin, end, dtype=np.int32)), pa.array(np.full(end - begin, block)), *(pa.array(c, pa.binary()) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in REQUESTS.split(", ")])

    return run


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Slices of the key space in order; shards is a power of two."""
    return (keys >> np.uint64(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)


def add_up(asked: pa.Table) -> pa.Table:
    """The answers of one shard: each block's keys with their counts over all blocks; the first row has figures of the tokens.

    A block whose rows were read in several parts has asked several times; it gets one answer, for all its keys.
    """
    blocks, of = np.unique(asked.column("block").to_numpy(), return_inverse=True)
    rows = [np.flatnonzero(of == b).tolist() for b in range(len(blocks))] if len(blocks) < len(of) else None
    out = {"shard": asked.column("shard").combine_chunks()[: len(blocks)], "block": pa.array(blocks)}
    figures = [0, 0, 0, 0]
    for n in range(ORDERS):
        keys = [unpack(x) for x in asked.column(f"keys{n}").to_pylist()]
        own = np.concatenate([np.frombuffer(spread(x), np.uint32) for x in asked.column(f"own{n}").to_pylist()])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=own, minlength=len(distinct)).astype(np.int64)
        if n == 0:
            figures = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
        if rows is None:
            each = np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])
            answers = [each[i] for i in np.argsort(of)]
        else:
            answers = [total[np.searchsorted(distinct, np.unique(np.concatenate([keys[i] for i in at])))] for at in rows]
        out[f"all{n}"] = pa.array([squeeze(x) for x in answers], pa.binary())
    for name, x in zip(("tokens", "kinds", "once", "twice"), figures, strict=True):
        out[name] = pa.array([x, *[0] * (len(blocks) - 1)], pa.int64())
    return pa.table(out)


@dataclass
class Automaton:
    """The states and arcs that a block's texts pass, found by the place of each token.

    A state of depth 2 stands for the two tokens before a place, one of depth 1 for the
    last of them, and the root, depth 0, for none.
    """

    arc: np.ndarray  #: log10 weight of the arc for each token out of the state of depth 0, 1, 2
    has: np.ndarray  #: whether that arc is there; the root has one for every token
    fail: np.ndarray  #: log10 weight of the failure arc of the state of depth 0, 1, 2 before each token
    after: np.ndarray  #: depth of the longest state that each token leads to

    def walk(self, first: np.ndarray, begin: int) -> np.ndarray:
        """log10 probability of each text: one pass from left to right that carries each text's state; all begin behind an end."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, shorter = first[:-1][order], -size[order]
        cost, state = np.zeros(len(order)), np.full(len(order), begin)
        for step in range(int(size.max(initial=0))):
            n = int(np.searchsorted(shorter, -step))  # the texts that are longer than so many tokens
            at, s = start[:n] + step, state[:n]
            for depth in (2, 1):
                falls = (s == depth) & ~self.has[depth, at]
                cost[:n] += np.where(falls, self.fail[depth, at], 0.0)
                s = np.where(falls, depth - 1, s)
            cost[:n] += self.arc[s, at]
            state[:n] = self.after[at]
        out = np.empty(len(order))
        out[order] = cost
        return out


def automaton(h: np.ndarray, first: np.ndarray, counts: list[np.ndarray], n_train: int, kinds: int, d: float) -> tuple[Automaton, int]:
    """The automaton of the texts' n-grams, and the depth of the state behind an end; counts: of each token's n-grams in the training texts."""
    c1, c2, c3 = (c.astype(float) for c in counts)
    begins = np.zeros(len(h), dtype=bool)
    begins[first[:-1]] = True
    # a history was followed by a token as often as it occurred; an end is the history of each text's first token
    ends = c1[first[1:] - 1][0] if len(h) else 0.0
    behind = np.where(begins, ends, np.concatenate([[0.0], c1[:-1]]))
    pair = np.where(begins, 0.0, np.concatenate([[0.0], c2[:-1]]))
    p1 = np.where(c1 > 0, c1 - d, d * kinds) / n_train
    p2 = (c2 + PRIORS[0] * p1) / (behind + PRIORS[0])
    p3 = (c3 + PRIORS[1] * p2) / (pair + PRIORS[1])
    every = np.ones(len(h), dtype=bool)
    fail = np.stack([np.zeros(len(h)), np.log10(PRIORS[0] / (behind + PRIORS[0])), np.log10(PRIORS[1] / (pair + PRIORS[1]))])
    after = np.where(c2 > 0, 2, np.where(c1 > 0, 1, 0))
    return Automaton(np.log10(np.stack([p1, p2, p3])), np.stack([every, c2 > 0, c3 > 0]), fail, after), int(ends > 0)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    split = picked.withColumn("held_out", fold == 0).select("doc_id", "held_out", "text")
    blocks = settle(split.mapInArrow(K.tidy(_cut(BLOCK_BYTES)), "block long, doc_id long, held_out boolean, text string"), "blocks")
    size = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, 1 << max(0, -(-size // SHARD_BYTES) - 1).bit_length())
    edges = [shards * i // PASSES for i in range(PASSES + 1)]
    asked = (blocks.mapInArrow(K.tidy(_ask(shards, BLOCK_BYTES, a, b)), REQUESTS) for a, b in zip(edges, edges[1:]))
    answers = reduce(DataFrame.unionByName, [settle(x.groupBy("shard").applyInArrow(add_up, ANSWERS), "answers", clean=True) for x in asked])
    figures = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds", "once", "twice"))).first()
    n_train, kinds, once, twice = (int(x) for x in figures)
    d = once / (once + 2 * twice) if once and twice else 0.5
    base_of = float(np.log10(n_train + ADD * (kinds + 1)))

    def measure(texts: pa.Table, totals: pa.Table) -> pa.Table:
        block = texts.combine_chunks().to_batches()[0]
        h, first = block_tokens(block)
        totals = totals.sort_by("shard")
        counts = []
        for n, k in enumerate(ngrams(h, first)):
            keys, place = np.unique(k, return_inverse=True)
            found = np.concatenate([np.frombuffer(spread(x), np.int64) for x in totals.column(f"all{n}").to_pylist()])
            if len(found) != len(keys):
                raise ValueError(f"{len(found)} answers for {len(keys)} n-grams of a block")
            counts.append(found[place])
        base, cost = np.zeros(block.num_rows), np.zeros(block.num_rows)
        if n_train:
            base = np.add.reduceat(np.log10(counts[0] + ADD) - base_of, first[:-1])
            # some texts at a time: a text's walk needs no other's
            at = 0
            while at < block.num_rows:
                to = max(at + 1, int(np.searchsorted(first, first[at] + WALK_TOKENS, side="right")) - 1)
                a, b = int(first[at]), int(first[to])
                model, begin = automaton(h[a:b], first[at : to + 1] - a, [c[a:b] for c in counts], n_train, kinds, d)
                cost[at:to] = model.walk(first[at : to + 1] - a, begin)
                at = to
        known = np.add.reduceat((counts[0] > 0).astype(np.int64), first[:-1])
        rows = [block.column("doc_id"), block.column("held_out"), np.diff(first), known, np.full(block.num_rows, n_train), base, cost]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in rows], names=[x.split()[0] for x in SCORES.split(", ")])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(measure, SCORES)
