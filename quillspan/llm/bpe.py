"""Encoding with a tokenizers file, unit by unit.

Byte-level BPE splits a text before it merges, and never puts a white-space
character that follows a visible one into the piece before it.  So a text's ids
are the ids of its units (a white-space run and the visible run behind it), one
after the other, and each distinct unit needs the library once.  Units are told
apart by 64-bit hashes of their bytes and their ids lie in one flat array, so a
chunk's ids are gathered in a few array passes.  Texts for which cutting isn't
certain (special-token strings, separators that libraries class differently) are
encoded whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quillspan.llm import kernels as K

CACHE_UNITS = 900_000
_UNIT = re.compile(r"\s*\S+|\s+")

_odd_space = np.zeros(256, dtype=bool)
_odd_space[[9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_plain_space = np.zeros(256, dtype=bool)
_plain_space[[10, 32]] = True
#: lead bytes of characters outside ASCII that are white space: U+0085 U+00A0; U+1680 U+2000.. U+3000
_maybe = np.zeros(256, dtype=bool)
_maybe[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = re.compile("[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class UnitEncoder:
    """ids of texts as little-endian bytes, ``width`` bytes an id."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.width = self.kind.itemsize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        heads = np.zeros(size, dtype=bool)
        for token, i in self.library.get_vocab().items():
            heads[i] = token[:1] in ("Ġ", "Ċ") and token not in self.special
        self.heads = heads
        self.most = cache_units
        self.clear()

    def clear(self) -> None:
        self.slot = K.Table(1 << 16)  # unit's hash -> its place in starts
        self.starts = np.zeros(1 << 16, np.int64)
        self.flat = np.empty(1 << 18, self.kind)
        self.filled = 0
        self._learn(np.array([1, 2], np.uint64), [",", "."], False)
        self.stops = {",": 0, ".": 1}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, units: list[str], headed: bool) -> None:
        """Give new units their slots.  ``headed`` ones begin with a space or line feed: many go in one call, told apart by their head."""
        for at in range(0, len(units), 4000):
            some = units[at : at + 4000]
            if headed:
                ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype=self.kind)
                cut = np.flatnonzero(self.heads[ids])
            if not headed or len(cut) != len(some):
                each = [np.frombuffer(x, self.kind) for x in self.whole(some)]
                ids = np.concatenate(each)
                cut = np.cumsum([0, *map(len, each)])[:-1]
            first, n = len(self.slot), len(some)
            if first + n + 1 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros(len(self.starts) + n, np.int64)])
            if self.filled + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(len(self.flat) + len(ids), self.kind)])
            self.starts[first : first + n] = self.filled + cut
            self.flat[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
            self.starts[first + n] = self.filled
            self.slot.put(hashes[at : at + 4000], np.arange(first, first + n))

    def _simple(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts whose white space is single spaces and line feeds between visible characters."""
        n = len(bounds) - 1
        bad = np.zeros(n, dtype=bool)
        if not len(data):
            return ~bad
        gap = _plain_space[data]
        odd = _odd_space[data]
        odd[1:] |= gap[1:] & gap[:-1]
        some = bounds[:-1] < bounds[1:]
        for edge in (bounds[:-1][some], bounds[1:][some] - 1):
            odd[edge] |= gap[edge]
        bad[K.per_text(odd, bounds) > 0] = True
        wide = np.unique(np.searchsorted(bounds, np.flatnonzero(_maybe[data]), side="right") - 1)
        for i in wide[~bad[wide]]:
            bad[i] = _WIDE.search(data[bounds[i] : bounds[i + 1]].tobytes().decode()) is not None
        return ~bad

    def _slots(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
        """Slots of the units of all texts that can be cut, how many each has; the others' ids."""
        w = K.words(texts, trim=True)
        simple = self._simple(w.data, w.bounds)
        flat = w.data.tobytes()
        for mark in self.special:
            found, mark = flat.find(mark.encode()), mark.encode()
            while found >= 0:
                simple[int(np.searchsorted(w.bounds, found, side="right")) - 1] = False
                found = flat.find(mark, found + 1)
        slow: list[bytes | None] = [None] * len(simple)
        for i in np.flatnonzero(~simple):
            text = flat[w.bounds[i] : w.bounds[i + 1]].decode()
            slow[i] = self._slow(text)
        take = np.repeat(simple, w.counts)
        starts, ends, owner = w.starts[take], w.ends[take], w.owner()[take]
        lead = starts - (starts > w.bounds[owner])  # the white-space byte in front, unless the text begins here
        kind = np.where(lead == starts, np.uint64(0), w.data[lead].astype(np.uint64) + np.uint64(1)) if len(starts) else np.empty(0, np.uint64)
        keys = K.mix(w.hashes[take] + kind * np.uint64(0x9FB21C651E98DF25))
        if len(self.slot) > self.most:
            self.clear()
        slots, tail = self.slot.find(keys), w.trimmed[take]
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            distinct, at = np.unique(keys[unknown], return_index=True)
            at = unknown[at]
            first = lead[at] == starts[at]
            for group, headed in ((~first, True), (first, False)):
                units = [flat[a:b].decode() for a, b in zip(lead[at[group]].tolist(), ends[at[group]].tolist(), strict=True)]
                self._learn(distinct[group], units, headed)
            slots[unknown] = self.slot.find(keys[unknown])
        # the full stop or comma behind a trimmed word is a unit of its own
        wide = np.repeat(slots, 1 + tail)
        behind = (np.cumsum(1 + tail) - 1)[tail]
        wide[behind] = np.where(w.data[ends[tail]] == 44, self.stops[","], self.stops["."])
        return wide, np.where(simple, w.counts + K.per_text(w.trimmed, w.first), 0), simple, slow

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; null counts as empty."""
        slots, many, _, slow = self._slots(texts)
        total = np.concatenate([[0], np.cumsum(self.starts[slots + 1] - self.starts[slots])])
        ends = np.cumsum(many)
        out = total[ends] - total[ends - many]
        for i, x in enumerate(slow):
            if x is not None:
                out[i] = len(x) // self.width
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        slots, many, _, slow = self._slots(texts)
        begin = self.starts[slots]
        size = self.starts[slots + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])].tobytes()
        ends = np.cumsum(many)
        cut = zip((total[ends - many] * self.width).tolist(), (total[ends] * self.width).tolist(), slow, strict=True)
        return [ids[a:b] if x is None else x for a, b, x in cut]

    def _slow(self, text: str) -> bytes:
        if any(m in text for m in self.special) or _WIDE.search(text):
            return self.whole([text])[0]
        units = _UNIT.findall(text)
        known = dict(zip(dict.fromkeys(units), self.whole(list(dict.fromkeys(units))), strict=True))
        return b"".join([known[u] for u in units])


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitEncoder(path)
