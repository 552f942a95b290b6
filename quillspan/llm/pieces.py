"""SentencePiece encoding and decoding (operator 5): sampled segmentations, lossless both ways.

A text is cut before every space and line feed, and before a full stop or comma
behind a letter or digit; one space is put in front.  The
pieces of such a word's lattice are the vocabulary's pieces whose bytes match it;
no arc crosses a word's border, so a text's lattice is a chain of word lattices.  A
piece of rank r weighs (r + 1) ** -alpha; byte pieces, which match anywhere, weigh
next to nothing and spell what no other piece has.  The forward filter runs once for
each distinct word, over all new words of a chunk together.  Backward sampling then
runs over all words of the chunk, a step at a time: every word still open draws the
arc into its current node by inverse distribution from a number hashed out of
(seed, row key, word position, step).  So a row's segmentation depends on nothing
but its key and text, and reruns agree.

Decoding joins the pieces' bytes and takes off the space in front; it returns every
text exactly, white space and all.

A null or empty text has no pieces (decoding gives an empty text).  A null row key
counts as -1.  Repeated rows get equal pieces.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillspan.llm import kernels as K

SEED = 20260805
ALPHA = 1.0
CACHE_WORDS = 200_000
DECODED = 200  #: rows decoded at a time
BYTE_WEIGHT = 1e-9
TOGETHER = 64  #: bytes up to which words are filtered together
SCALE = 1e5  #: for each byte, on all paths alike: keeps sums of long words in range


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattices:
    """Word lattices in flat arrays: node -> arcs into it, with cumulative probabilities."""

    def __init__(self, path: str, alpha: float = ALPHA, most: int = CACHE_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alpha, self.most = alpha, most
        self.weight: dict[bytes, tuple[int, float]] = {}
        spelt = {}
        for i, text in enumerate(piece_bytes(path)):
            if model.is_byte(i):
                spelt[text] = (i, BYTE_WEIGHT)
            elif text and not {b" "[0], b"\n"[0]} & set(text[1:]):
                self.weight[text] = (i, (1.0 + max(0.0, -model.get_score(i))) ** -alpha)
        # a byte that is a piece of its own isn't spelt
        self.spelt = {b: got for b, got in spelt.items() if b not in self.weight}
        self.byte_ids = np.array([self.spelt.get(bytes([b]), (-1,))[0] for b in range(256)])
        # pieces and their beginnings, by length: hash, id (-1 for a beginning that is no piece), weight
        known: dict[bytes, tuple[int, float]] = {p[:k]: (-1, 0.0) for p in self.weight for k in range(1, len(p))} | self.weight
        names = list(known)
        self.longest = max(map(len, names))
        self.known = K.Table(4 * len(names))
        self.known.put(_hash_all(names), np.arange(len(names)))
        self.known_id, self.known_weight = np.array([known[x][0] for x in names]), np.array([known[x][1] for x in names])
        self.clear()

    def clear(self) -> None:
        self.node = K.Table(1 << 16)  # a word's hash -> its last node
        self._nodes = self._filled = 0
        # of each node its first arc; of each arc the share of paths up to it, its bytes and its piece
        self._flat = {"first": np.empty(0, np.int32), "upto": np.empty(0, np.float32), "back": np.empty(0, np.int16), "code": np.empty(0, np.int32)}

    def _store(self, first: np.ndarray, upto: np.ndarray, back: np.ndarray, code: np.ndarray) -> None:
        """Put nodes and arcs behind the others, into arrays that grow by half; first counts from these arcs' beginning."""
        for name, filled, values in (("first", self._nodes, first + self._filled), ("upto", self._filled, upto), ("back", self._filled, back), ("code", self._filled, code)):
            flat, need = self._flat[name], filled + len(values)
            if len(flat) < need:
                self._flat[name] = np.empty(need * 3 // 2, flat.dtype)
                self._flat[name][:filled] = flat[:filled]
            self._flat[name][filled:need] = values
        self._nodes += len(first)
        self._filled += len(upto)

    def _add_long(self, word: bytes) -> int:
        """Forward filter of one word of any length, rescaled on the way; returns its last node."""
        n = len(word)
        total = np.zeros(n + 1)
        total[0] = 1.0
        first, upto, backs, codes = [], [], [], []
        for end in range(1, n + 1):
            arcs = [(end - b, *got) for b in range(max(0, end - self.longest), end) if (got := self.weight.get(word[b:end]))]
            if (last := self.spelt.get(word[end - 1 : end])) is not None:
                arcs.append((1, *last))
            reach = np.array([total[end - back] * w for back, _, w in arcs])
            if reach.sum() < 1e-150:
                total *= 1e150
                reach *= 1e150
            total[end] = reach.sum()
            first.append(len(upto))
            upto += np.cumsum(reach / total[end]).tolist()
            upto[-1] = 2.0
            backs += [a[0] for a in arcs]
            codes += [a[1] for a in arcs]
        self._store(np.array(first), np.array(upto), np.array(backs), np.array(codes))
        return self._nodes - 1

    def _add_together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Forward filter of many words; returns their last nodes."""
        size = ends - starts
        base = self._nodes + np.cumsum(size) - size  # node base + k - 1 is behind a word's first k bytes
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        word = np.repeat(np.arange(len(size)), size)
        at = np.repeat(starts, size) + place
        room = np.repeat(size, size) - place
        up, down = K._power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        spelt = np.flatnonzero(self.byte_ids[data[at]] >= 0)
        arcs = [(word[spelt], place[spelt], np.ones(len(spelt), np.int64), self.byte_ids[data[at[spelt]]], np.full(len(spelt), BYTE_WEIGHT * SCALE))]
        open_ = np.arange(len(word))
        for length in range(1, self.longest + 1):
            open_ = open_[room[open_] >= length]
            if not len(open_):
                break
            spot = self.known.find(K.mix((sums[at[open_] + length] - sums[at[open_]]) * down[at[open_]]))
            open_, spot = open_[spot >= 0], spot[spot >= 0]
            real = self.known_id[spot] >= 0
            some, found = open_[real], spot[real]
            arcs.append((word[some], place[some], np.full(len(some), length), self.known_id[found], self.known_weight[found] * SCALE**length))
        of, begin, length, code, weight = (np.concatenate(x) for x in zip(*arcs, strict=True))
        end = begin + length
        order = np.argsort(end, kind="stable")
        of, begin, length, code, weight, end = (x[order] for x in (of, begin, length, code, weight, end))
        total = np.zeros((int(size.max()) + 1, len(size)))
        total[0] = 1.0
        share = np.empty(len(of))
        edges = np.searchsorted(end, np.arange(1, int(size.max()) + 2))
        for k in range(1, int(size.max()) + 1):
            i = slice(edges[k - 1], edges[k])
            reach = total[begin[i], of[i]] * weight[i]
            total[k] = np.bincount(of[i], weights=reach, minlength=len(size))
            share[i] = reach / total[k, of[i]]
        node = base[of] + end - 1 - self._nodes
        order = np.lexsort((-length, node))  # long pieces first: they are drawn most
        node, share, length, code = node[order], share[order], length[order], code[order]
        run = np.cumsum(share)
        head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        before = np.concatenate([[0.0], run])[head]
        upto = run - np.repeat(before, np.diff([*head, len(node)]))
        upto[np.append(head[1:], len(node)) - 1] = 2.0  # the last arc takes what is left
        self._store(head, upto, length, code)
        return base + size - 1

    def sample(self, texts: pa.Array, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and where each text's begin."""
        texts = pc.fill_null(texts, "")
        data, bounds = K.raw(pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, "")))
        begins = (data == 46) | (data == 44)
        begins[1:] &= K._ALNUM[data[:-1]]
        starts = np.flatnonzero(begins | (data == 32) | (data == 10))
        if not len(starts):
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(data))
        if len(self.node) > self.most:
            self.clear()
        up, down = K._power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        keys_of = K.mix((sums[ends] - sums[starts]) * down[starts])
        node, left = self.node.find(keys_of), ends - starts
        unknown = np.flatnonzero(node < 0)
        if len(unknown):
            distinct, at = np.unique(keys_of[unknown], return_index=True)
            at = unknown[at]
            size, last = left[at], np.empty(len(at), np.int64)
            short = np.flatnonzero(size <= TOGETHER)
            for some in np.array_split(short, -(-len(short) // 20_000)) if len(short) else []:
                last[some] = self._add_together(data, starts[at[some]], ends[at[some]])
            for i in np.flatnonzero(size > TOGETHER):
                last[i] = self._add_long(data[starts[at[i]] : ends[at[i]]].tobytes())
            self.node.put(distinct, last)
            node[unknown] = self.node.find(keys_of[unknown])
        owner = np.searchsorted(bounds, starts, side="right") - 1
        counts = np.bincount(owner, minlength=len(texts))
        place = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts)
        stream = K.mix(K.mix(keys.astype(np.uint64) + np.uint64(seed))[owner] + place.astype(np.uint64))
        first, upto, back, code = (self._flat[k] for k in ("first", "upto", "back", "code"))
        open_ = np.arange(len(node))
        steps = np.zeros(len(node), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        while len(open_):
            salt = np.uint64((len(drawn) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            u = (K.mix(stream[open_] + salt) >> np.uint64(12)) / float(1 << 52)
            arc = first[node[open_]].astype(np.int64)
            wait = np.flatnonzero(upto[arc] <= u)
            while len(wait):
                arc[wait] += 1
                wait = wait[upto[arc[wait]] <= u[wait]]
            drawn.append((open_, code[arc]))
            steps[open_] += 1
            node[open_] -= back[arc]
            left[open_] -= back[arc]
            open_ = open_[left[open_] > 0]
        # words are drawn from their end; put each word's pieces in reading order
        begin = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), np.int64)
        for k, (rows, codes) in enumerate(drawn):
            out[begin[rows] + steps[rows] - 1 - k] = codes
        total = np.concatenate([[0], np.cumsum(steps)])
        return out, total[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    """What each id decodes to."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [_bytes_of(model, i) for i in range(model.get_piece_size())]


def _bytes_of(model, i: int) -> bytes:
    if model.is_byte(i):
        return bytes([int(model.id_to_piece(i)[3:5], 16)])
    return b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace("▁", " ").encode()


def decode(ids: list[int], path: str | None = None) -> str:
    return b"".join(map(piece_bytes(path or default_path()).__getitem__, ids))[1:].decode()


def _hash_all(names: list[bytes]) -> np.ndarray:
    """The kernels' hash of each byte string."""
    data = np.frombuffer(b"".join(names), np.uint8)
    ends = np.cumsum([len(x) for x in names])
    starts = ends - np.array([len(x) for x in names])
    up, down = K._power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return K.mix((sums[ends] - sums[starts]) * down[starts])


@lru_cache(maxsize=2)
def lattices(path: str, alpha: float) -> Lattices:
    return Lattices(path, alpha)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, alpha: float = ALPHA, path: str | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id and pieces (array of ids); with keep_text the text too."""
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(where, alpha)
        for batch in batches:
            for part in K.chunks(batch, "text"):
                keys = part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
                flat, bounds = model.sample(part.column("text"), keys, seed)
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*columns, part.column("text")] if keep_text else columns, names=["doc_id", "pieces", "text"][: 2 + keep_text])

    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(K.tidy(run, lambda: lattices(where, alpha).clear()), "doc_id long, pieces array<int>" + ", text string" * keep_text)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows with the decoded text behind them."""
    where, names = path or default_path(), encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED):
                part = batch.slice(at, DECODED)
                out = [decode(ids, where) for ids in part.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(K.tidy(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", decoded string")
