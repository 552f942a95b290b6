"""Document fingerprints (operator 9): randomised edit embedding, bit-sampled bands, verification.

All texts share one random walk.  Its pointer starts at a text's first character; at
step j the walk writes the character under the pointer, and a random function of
(j, character) says whether the pointer moves on.  So every character is written
twice on average, and two texts a few edits apart soon walk in step again behind
each edit: the Hamming distance of what they write, their embeddings, follows their
edit distance.  Whole texts are embedded, whatever their length.

Of an embedding the places 0 to 63 are kept with four hashed bits each, and of every
octave behind (64 to 127, 128 to 255 and so on) 64 places, spread over it, with one
hashed bit each.  These bits and the text's length are the fingerprint; it grows with
the logarithm of the length.  ``likeness`` estimates from them the share of steps at
which two embeddings agree, 0 to 1: mismatches in an octave, set off against bits
that agree by chance, count for all its steps.

Bands of sampled bits of a text's longest whole octaves find candidates: ``similar``
takes fingerprints that share a band and verifies each pair on all bits.  The
fingerprints of a text and its neighbours are compared the same way: ``bands_edited``
and ``bands_next`` count the bands in common, and ``near_*`` are the verified values.

A null text counts as empty.  Equal texts have equal fingerprints; the empty text's
is like itself 1, like others 0.  The next document is the one before it by doc_id,
the largest after the smallest; equal doc_ids stand in the order of their texts, null
doc_ids come after all others.  A lone document is its own next.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernels as K
from quillspan.llm.store import settle

SEED = 20260805
PLACES = 64  #: sampled places of an octave; the first octave has so many steps
PLANES = 4  #: hashed bits of each of the first places
OCTAVES = 40
BANDS = 16
BAND_BITS = 20
WALK_BYTES = 8 << 20  #: texts that walk side by side; no result depends on it
_LETTERS = 1024
_HEAD = 1 + PLANES  #: words of a fingerprint before those of the octaves behind the first


def octave_start(o: int) -> int:
    return PLACES << (o - 1) if o else 0


def _tables(seed: int = SEED) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    rng = np.random.default_rng(seed)
    near = rng.integers(0, 2, (4096, _LETTERS), dtype=np.uint8)
    far = rng.integers(0, 2, (1024, _LETTERS), dtype=np.uint8)
    places = [np.arange(PLACES)]
    for o in range(1, OCTAVES):
        within = (np.arange(PLACES) + rng.random(PLACES)) * (octave_start(o) / PLACES)
        places.append(octave_start(o) + within.astype(np.int64))
    return near, far, places, np.array([rng.choice(2 * PLACES, BAND_BITS, replace=False) for _ in range(BANDS)])


_NEAR, _FAR, _PLACES, _BAND_PLACES = _tables()
_CLASSES = np.arange(_LETTERS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def move_row(step: int) -> np.ndarray:
    """For each class of characters whether the shared walk moves on at this step."""
    return _NEAR[step % 4096] ^ _FAR[step // 4096 % 1024]


def bit_row(step: int) -> np.ndarray:
    """For each class of characters the hashed bits that it writes at this step."""
    return K.mix(_CLASSES ^ np.uint64(step * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) & np.uint64((1 << PLANES) - 1)


def classes(chars: np.ndarray) -> np.ndarray:
    return ((chars.astype(np.int64) * 0x9E3779B1 >> 7) & (_LETTERS - 1)).astype(np.int16)


def octaves_of(n: np.ndarray) -> np.ndarray:
    """How many octaves behind the first the walks over n characters reach, at two steps a character."""
    reach = np.maximum(np.asarray(n, np.int64) * 2 - 1, 0) // PLACES
    return np.ceil(np.log2(reach + 1.0)).astype(np.int64)


def prints(chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of words for each text: its length, the planes of the first places, then a word for each octave (as many as the longest text needs)."""
    n = np.diff(bounds)
    out = np.zeros((len(n), _HEAD + int(octaves_of(n).max(initial=0))), np.uint64)
    out[:, 0] = n
    letters = np.concatenate([classes(chars), np.zeros(PLACES + 1, np.int16)])
    rows = np.argsort(-n, kind="stable")
    at, end = bounds[:-1][rows].copy(), bounds[1:][rows]
    sampled = {int(p): (o, k) for o in range(out.shape[1] - _HEAD + 1) for k, p in enumerate(_PLACES[o])}
    step = 0
    while True:
        if step % PLACES == 0:
            open_ = at < end
            if not open_.all():
                at, end, rows = at[open_], end[open_], rows[open_]
            if not len(rows):
                return out
        c = letters[at]
        if step in sampled:
            o, k = sampled[step]
            bits = np.where(at < end, bit_row(step)[c], np.uint64(0))
            for plane in range(1 if o else PLANES):
                out[rows, _HEAD - 1 + o if o else 1 + plane] |= (bits >> np.uint64(plane) & np.uint64(1)) << np.uint64(k)
        at += move_row(step)[c]
        step += 1


def spell(rows: np.ndarray) -> list[str]:
    """Fingerprints as text: hexadecimal words, of the octaves as many as the length asks for."""
    many = _HEAD + octaves_of(rows[:, 0].astype(np.int64))
    return [r[:m].astype("<u8").tobytes().hex() for r, m in zip(rows, many.tolist(), strict=True)]


def parse(spelt: list[str]) -> np.ndarray:
    words = [np.frombuffer(bytes.fromhex(x), "<u8") for x in spelt]
    out = np.zeros((len(words), max([_HEAD, *map(len, words)])), np.uint64)
    for row, w in zip(out, words):
        row[: len(w)] = w
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of steps at which the embeddings agree, of fingerprints row by row."""
    a, b = _same_width(a, b)
    n, m = a[:, 0].astype(np.int64), b[:, 0].astype(np.int64)
    steps = 2 * np.maximum(n, m)
    apart, whole = np.zeros(len(a)), np.zeros(len(a))
    for o in range(a.shape[1] - _HEAD + 1):
        if o:
            differ, chance = a[:, _HEAD - 1 + o] ^ b[:, _HEAD - 1 + o], 2.0
        else:
            differ, chance = np.bitwise_or.reduce(a[:, 1:_HEAD] ^ b[:, 1:_HEAD], axis=1), 1 / (1 - 0.5**PLANES)
        seen = np.searchsorted(_PLACES[o], steps)  # places that either walk is taken to reach
        mask = np.where(seen < 64, (np.uint64(1) << np.minimum(seen, 63).astype(np.uint64)) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        share = np.minimum(1.0, chance * np.bitwise_count(differ & mask) / np.maximum(seen, 1))
        width = np.clip(steps - octave_start(o), 0, octave_start(o) or PLACES) * (seen > 0)
        apart += share * width
        whole += width
    out = 1 - apart / np.maximum(whole, 1)
    out[(n == 0) != (m == 0)] = 0.0
    return np.clip(out, 0.0, 1.0)


def bands(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprint (by row) has which bands: bits sampled from its longest two whole octaves, and the same one octave down."""
    whole = np.frexp(np.maximum(rows[:, 0].astype(np.int64) * 2 // PLACES, 0))[1]  # octaves that the text fills
    every = np.arange(len(rows))
    owner, keys = [], []
    for level, some in ((whole, every), (whole - 1, every[whole > 0])):
        top = level[some]
        both = np.stack([rows[some, np.maximum(_HEAD - 2 + top, 1)], rows[some, np.maximum(_HEAD - 3 + top, 2)]], axis=1)
        for k, at in enumerate(_BAND_PLACES):
            bits = (both[:, at // PLACES] >> (at % PLACES).astype(np.uint64)) & np.uint64(1)
            value = (bits << np.arange(BAND_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            keys.append(K.mix(value + (np.uint64(k) << np.uint64(32)) + (top.astype(np.uint64) << np.uint64(40))))
            owner.append(some)
    return np.concatenate(owner), np.concatenate(keys)


def bands_in_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (x, p), (y, q) = bands(a), bands(b)
    one, two = (K.mix(k + r.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) for r, k in ((x, p), (y, q)))
    return np.bincount(x[np.isin(one, two)], minlength=len(a))


class _Texts:
    """Code points of many texts."""

    def __init__(self, texts: pa.Array):
        data, byte_bounds = K.raw(texts)
        self.bytes, self.byte_bounds = data.tobytes(), byte_bounds
        self.chars = np.frombuffer(self.bytes.decode().encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.bounds = lead[byte_bounds]

    def text(self, i: int) -> str:
        return self.bytes[self.byte_bounds[i] : self.byte_bounds[i + 1]].decode()


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many characters of the following one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited long, bands_next long, role string, part int, place long, text string"


def _rows(ids: list, texts: list[str], own: np.ndarray, role: str, part: int, place: int, following: tuple[list[str], np.ndarray] | None) -> pa.RecordBatch:
    """following: the next documents' texts and fingerprints; without it rows that carry their text."""
    n = len(ids)
    columns = {"doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "fingerprint": pa.array(spell(own), pa.string())}
    if following:
        changed = [edited(a, b) for a, b in zip(texts, following[0], strict=True)]
        raw = _Texts(pa.array(changed, pa.string()))
        theirs = prints(raw.chars, raw.bounds)
        columns |= {
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            "edited_fingerprint": pa.array(spell(theirs), pa.string()),
            "near_edited": pa.array(likeness(own, theirs), pa.float64()),
            "near_next": pa.array(likeness(own, following[1]), pa.float64()),
            "bands_edited": pa.array(bands_in_common(own, theirs), pa.int64()),
            "bands_next": pa.array(bands_in_common(own, following[1]), pa.int64()),
            "text": pa.nulls(n, pa.string()),
        }
    else:
        columns |= {c: pa.nulls(n, pa.string()) for c in ("edited_sha256", "edited_fingerprint")} | {c: pa.nulls(n, pa.float64()) for c in ("near_edited", "near_next")} | {c: pa.nulls(n, pa.int64()) for c in ("bands_edited", "bands_next")} | {"text": pa.array(texts, pa.string())}
    columns |= {"role": pa.array([role] * n, pa.string()), "part": pa.array([part] * n, pa.int32()), "place": pa.array(range(place, place + n), pa.int64())}
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition: finished rows for all but its last document, and that one and the first with their texts."""
    part = TaskContext.get().partitionId()
    held: tuple[list, list[str], np.ndarray] | None = None
    place = 0
    for batch in batches:
        for piece in K.chunks(batch, "text", WALK_BYTES):
            raw = _Texts(piece.column("text"))
            ids, texts = piece.column("doc_id").to_pylist(), [raw.text(i) for i in range(piece.num_rows)]
            own = prints(raw.chars, raw.bounds)
            if held is None:
                yield _rows(ids[:1], texts[:1], own[:1], "first", part, 0, None)
            else:
                ids, texts, own = held[0] + ids, held[1] + texts, np.concatenate(_same_width(held[2], own))
            if len(ids) > 1:
                yield _rows(ids[:-1], texts[:-1], own[:-1], "done", part, place, (texts[1:], own[1:]))
                place += len(ids) - 1
            held = ids[-1:], texts[-1:], own[-1:]
    if held is not None:
        yield _rows(*held, "last", part, place, None)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, theirs = (parse(batch.column(c).to_pylist()) for c in ("fingerprint", "next_print"))
        if batch.num_rows:
            yield _rows(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), own, "done", 0, 0, (batch.column("next_text").to_pylist(), theirs))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_edited, bands_next for every row."""
    key = F.col("doc_id").desc_nulls_last()
    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    dealt = picked.repartitionByRange(key).sortWithinPartitions(key, "text")
    rows = settle(dealt.mapInArrow(K.tidy(_within), _OUT), "prints")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_edited", "bands_next"]
    # two rows a partition: its last document and the first of the next one that has any, joined by the partition's number
    ends = rows.where("role <> 'done'").select("role", "part", "doc_id", "fingerprint", "text")
    parts = sorted(r[0] for r in ends.where("role = 'first'").select("part").collect())  # a number for each task
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    following = ends.where("role = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    paired = ends.where("role = 'last'").join(after, "part").join(following, "next").select("doc_id", "text", "fingerprint", "next_text", "next_print")
    closed = paired.mapInArrow(_borders, _OUT)
    return rows.where("role = 'done'").select(names).unionByName(closed.select(names))


def similar(marked: DataFrame, least: float = 0.8, block: int = 512) -> DataFrame:
    """Pairs of distinct fingerprints (fingerprint_a, fingerprint_b, near) at least that alike among those that share a band.

    marked: fingerprint.  Equal fingerprints are one class.  Bands of many classes
    are cut into blocks and blocks are compared two at a time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                owner, keys = bands(parse(batch.column("fingerprint").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), batch.column("fingerprint").take(pa.array(owner))], names=["v", "fingerprint"])

    banded = settle(marked.select("fingerprint").distinct().mapInArrow(K.tidy(cut), "v long, fingerprint string").distinct(), "bands")
    many = banded.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("fingerprint", "v"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(j, own) * blocks + F.greatest(j, own))
    placed = banded.join(many, "v").select("v", F.explode(cells).alias("cell"), "fingerprint")

    def compare(table: pa.Table) -> pa.Table:
        names = sorted(set(table.column("fingerprint").to_pylist()))
        rows = parse(names)
        a, b, near = [], [], []
        for i in range(len(names) - 1):
            x = likeness(np.repeat(rows[i : i + 1], len(names) - 1 - i, axis=0), rows[i + 1 :])
            for j in np.flatnonzero(x >= least).tolist():
                a.append(names[i])
                b.append(names[i + 1 + j])
                near.append(float(x[j]))
        return pa.table({"fingerprint_a": pa.array(a, pa.string()), "fingerprint_b": pa.array(b, pa.string()), "near": pa.array(near, pa.float64())})

    return placed.groupBy("v", "cell").applyInArrow(compare, "fingerprint_a string, fingerprint_b string, near double").distinct()
