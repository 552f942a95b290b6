"""N-gram Jaccard join (operator 2): size-banded tiles, bitmap bounds, exact intersections.

A document is the set of its 3-word shingles (64-bit hashes).  Two documents link
when 100 * |A n B| >= 90 * |A u B|.  Equal sets fall into one class first and only
classes are compared.

Candidates.  Under any one order of all shingles, linked sets share one among their
first p = n - ceil(0.9 n) + 1, and share k among their first p + k - 1.  A class keeps
half as many again as p (its prefix), so it is looked at only if about p / 2 of these
stand in other components' prefixes too, and not at the most crowded p / 2 of those.  The order is by frequency over the whole
table, rare shingles first, then by hash, so that passages which many documents
share come last and don't make large groups.  Frequencies are those of a sketch of
fixed size, in steps of half a power of two; only the order, never a result, depends
on it.  A tile holds the classes that share a prefix shingle and a size band (powers
of two; sets just below a border also visit the band above).  Prefix shingles that
the same few classes share make one tile.  Tiles of more than BLOCK classes are cut
into blocks and every pair of blocks is a tile.

Bounds.  Each class has a parity bitmap of about its size in bits.  Of two parity
bitmaps that differ in h bits, the sets' overlap is at most (|A| + |B| - h) / 2; most
pairs end there.  What remains is decided by intersecting the sorted hash arrays.

Before that full search, two rounds over two min-hashes each link the bulk of every
group of near copies, and the full search then looks only at pairs from different
components.  In these rounds the tiles of more than SMALL classes carry the hash
arrays and decide their pairs on the spot, leaving out pairs that are connected by
then; smaller ones give a few spanning pairs.  So a group of m near copies gives
about m edges; no link between different components is ever skipped.  Tables between
the steps are deleted once they have been read, shuffle files as soon as their step ends.

Null and empty texts, and texts without words, have an empty set and no links.
Texts of 1 or 2 words have their whole sequence as the one shingle.  Rows that
repeat are in one class; a null doc_id keeps a null component unless it has links.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import kernels as K
from quillspan.llm.graph import components
from quillspan.llm.store import drop, settle, sweep

SHINGLE = 3
PERCENT = 90
BLOCK = 1024
SMALL = 16
PAIRS = 256  #: pairs decided at a time
SKETCH_BITS = 22  #: counters of the frequency sketch, as a power of two; a hint that no result depends on
SKETCH_BLOCK = 1 << 16
SEEDS = 4  #: min-hashes of a class, two for each of the first rounds
FILTER_BITS = 23

PROFILE = "doc_id long, n long, cid long, seeds array<long>, keys array<long>, bits binary"
_SEED_SALT = K.mix(np.arange(1, SEEDS + 1, dtype=np.uint64) * np.uint64(0x5DEECE66D))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    values, first = K.grams(K.words(texts, lower=True), k, short=True)
    return [np.unique(values[a:b]) for a, b in zip(first.tolist(), first.tolist()[1:])]


def class_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def kept_length(n: int, percent: int = PERCENT) -> int:
    """So many shingles are kept of the order: any linked set shares at least ``needed`` of them."""
    p = prefix_length(n, percent)
    return min(n, p + p // 2)


def needed(n: Column, percent: int = PERCENT) -> Column:
    """1 + p // 2 for the smallest set that may link with one of n shingles."""
    least = F.ceil(F.lit(percent) * n / 100)
    return 1 + F.floor((least - F.ceil(F.lit(percent) * least / 100) + 1) / 2)


def band_of(n: int) -> int:
    return max(8, n.bit_length() - 1)


def parity_bits(s: np.ndarray) -> bytes:
    """Parity bitmap of 2**(band + 1) bits: as wide as the band above needs; its halves xored suit the band itself."""
    width = 2 << band_of(len(s))
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sketcher(k: int):
    """How often the shingles of a task's texts fall on each counter, in compressed blocks of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part in K.chunks(batch, "text"):
                values, _ = K.grams(K.words(part.column("text"), lower=True), k, short=True)
                at, n = np.unique((values & np.uint64(len(counts) - 1)).astype(np.int32), return_counts=True)
                counts[at] += n.astype(np.uint32)
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        packed = [pa.compress(blocks[i].tobytes(), codec="zstd", asbytes=True) for i in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], names=["block", "counts"])

    return run


def _level(table: pa.Table) -> pa.Table:
    """One block's counters added up, as steps of half a power of two."""
    total = np.zeros(SKETCH_BLOCK, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(pa.decompress(x.as_py(), decompressed_size=4 * SKETCH_BLOCK, codec="zstd", asbytes=True), np.uint32)
    levels = np.round(2 * np.log2(total + 1.0)).astype(np.uint8)
    return pa.table({"block": table.column("block").slice(0, 1), "levels": pa.array([levels.tobytes()], pa.binary())})


def frequency_levels(texts: DataFrame, k: int) -> np.ndarray:
    """A byte for each counter of the sketch: the logarithm of how many shingles of the table fall on it."""
    parts = texts.select("text").mapInArrow(K.tidy(_sketcher(k)), "block int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    found = parts.groupBy("block").applyInArrow(_level, "block int, levels binary").toArrow()  # a byte for each counter
    for block, levels in zip(found.column("block").to_pylist(), found.column("levels").to_pylist(), strict=True):
        out[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK] = np.frombuffer(levels, np.uint8)
    return out


def prefix(s: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first of a sorted set's shingles by frequency, then hash."""
    of = levels[(s & np.uint64(len(levels) - 1)).astype(np.int64)]
    return s[np.argsort(of, kind="stable")[: kept_length(len(s), percent)]]


def _profiler(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for part in K.chunks(batch, "text"):
                ids, ns, cids, seeds, keys, bits = part.column("doc_id"), [], [], [], [], []
                for s in shingle_sets(part.column("text"), k):
                    n = len(s)
                    ns.append(n)
                    if not n:
                        for column in (cids, seeds, keys, bits):
                            column.append(None)
                        continue
                    cids.append(class_id(s))
                    seeds.append([int(K.mix(s ^ salt).min().astype(np.int64)) for salt in _SEED_SALT])
                    keys.append(prefix(s, levels, percent).astype(np.int64))
                    bits.append(parity_bits(s))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(ns, pa.int64()), pa.array(cids, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (seeds, keys)), pa.array(bits, pa.binary())],
                    names=["doc_id", "n", "cid", "seeds", "keys", "bits"],
                )

    return run


def _pick(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def jaccard_reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _pairs_in_tiles(mode: str, percent: int):
    """Of rows sorted by (band, key, cell, n): pairs of classes whose bitmaps allow a link.

    Mode ``all`` keeps all pairs of different components; ``spanning`` keeps, in each
    tile, those of a row with the tile's first row and with the two behind it;
    ``exact`` decides them by the rows' hash arrays and keeps links that connect;
    ``touch`` gives not pairs but the classes that stand in any (twice each).
    """
    spanning = mode == "spanning"

    def compare(rows: dict[str, np.ndarray], bits: list[bytes], hashes: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
        left, right, stars = [], [], []
        for band in np.unique(rows["band"]).tolist():
            at = np.flatnonzero(rows["band"] == band)
            width = 1 << band
            flat = []
            for i in at.tolist():
                b = np.frombuffer(bits[i], np.uint64)
                while len(b) * 64 > width:
                    b = b[: len(b) // 2] ^ b[len(b) // 2 :]
                flat.append(b)
            wide = np.array(flat)
            n, comp, cid, side, tile = (rows[c][at] for c in ("n", "comp", "cid", "side", "tile"))
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            own = np.arange(len(tile))  # the rows connected so far, in this tile
            head = np.repeat(first, np.diff([*first, len(tile)]))

            def test(a: np.ndarray, b: np.ndarray, n=n, comp=comp, side=side, wide=wide, cid=cid, own=own, at=at, tile=tile) -> None:
                small, big = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                ok = (comp[a] != comp[b]) & (100 * small >= percent * big) & ((side[a] | side[b]) == 3)
                a, b = a[ok], b[ok]
                for c in range(0, len(a), 200_000):
                    x, y = a[c : c + 200_000], b[c : c + 200_000]
                    differ = np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int64)
                    # overlap <= (n + m - differ) / 2 and percent * (n + m) <= (100 + percent) * overlap
                    fit = (100 + percent) * (n[x] + n[y] - differ) >= 2 * percent * (n[x] + n[y])
                    x, y = x[fit], y[fit]
                    if mode == "touch":
                        either = np.unique(cid[np.concatenate([x, y])])
                        left.append(either)
                        right.append(either)
                        continue
                    if hashes is None:
                        left.append(cid[x])
                        right.append(cid[y])
                        continue
                    for i, j in zip(x.tolist(), y.tolist(), strict=True):
                        if own[i] != own[j] and jaccard_reaches(np.frombuffer(hashes[at[i]], np.uint64), np.frombuffer(hashes[at[j]], np.uint64), percent):
                            span = slice(*np.searchsorted(tile, [tile[i], tile[i] + 1]))
                            part = own[span]
                            part[part == own[j]] = own[i]

            rest = np.arange(len(tile))
            stars.append((own, cid))
            if spanning:
                test(head, rest)
                for shift in (1, 2):
                    i = rest[: max(0, len(tile) - shift)]
                    test(i[tile[i] == tile[i + shift]], i[tile[i] == tile[i + shift]] + shift)
                continue
            i = rest[:-1]
            for shift in range(1, len(tile)):
                i = i[i < len(tile) - shift]
                i = i[(tile[i] == tile[i + shift]) & (100 * n[i] >= percent * n[i + shift])]  # sorted by n: once apart, always apart
                if not len(i):
                    break
                test(i, i + shift)
        if hashes is not None:  # of what is connected within a tile, one row stands for all
            for own, cid in stars:
                rows_in = np.flatnonzero(own != np.arange(len(own)))
                left.append(cid[own[rows_in]])
                right.append(cid[rows_in])
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *left]), np.concatenate([empty, *right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table) -> pa.RecordBatch:
            rows = {c: table.column(c).to_numpy() for c in ("band", "key", "cell", "n", "comp", "cid", "side")}
            new = (np.diff(rows["key"]) != 0) | (np.diff(rows["cell"]) != 0) | (np.diff(rows["band"]) != 0)
            rows["tile"] = np.concatenate([[0], np.cumsum(new)])
            a, b = compare(rows, table.column("bits").to_pylist(), table.column("hashes").to_pylist() if mode == "exact" else None)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            k, c, b = (table.column(x).to_numpy() for x in ("key", "cell", "band"))
            open_from = int(np.flatnonzero((k != k[-1]) | (c != c[-1]) | (b != b[-1]))[-1]) + 1 if (k[0], c[0], b[0]) != (k[-1], c[-1], b[-1]) else 0
            if open_from:
                yield done(table.slice(0, open_from).combine_chunks())
            held = table.slice(open_from).combine_chunks()
        if held is not None and held.num_rows:
            yield done(held)

    return run


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys that classes of different components share."""
    stats = keyed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return stats.where("low <> high").select("key")


def _met(keyed: DataFrame, keys: DataFrame, labelled: DataFrame, percent: int | None) -> DataFrame:
    """key, cid, m, settled: the classes at each shared key, and their number.

    With a percentage only classes with as many shared keys as a link needs are there,
    and each without its most crowded keys, one fewer than that: the keys that two
    linked classes share lose at most so many of the most crowded, so one is left.
    """
    # most keys end here: what remains is written before it is counted, so that all keys are dealt out once
    met = settle(keyed.select("key", "cid").join(keys, "key"), "meetings", clean=True)
    crowd = met.groupBy("key").agg(F.count("*").alias("m"))
    if percent is None:
        out = settle(met.join(crowd.where("m > 1"), "key"), "met", clean=True)
        drop(met)
        return out
    own = Window.partitionBy("cid")
    ranked = met.join(crowd, "key").join(labelled.select("cid", "n"), "cid").withColumn("of", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("m"), "key")))
    least = needed(F.col("n"), percent)
    left = settle(ranked.where((F.col("of") >= least) & (F.col("rank") >= least)).select("key", "cid"), "left", clean=True)
    out = settle(left.join(left.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"), "met", clean=True)
    drop(met)
    drop(left)
    return out


def _same_few(met: DataFrame) -> DataFrame:
    """Keys of at most SMALL classes, one for all keys that the same classes share."""
    few = met.where(F.col("m") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("cid")).alias("members"))
    sets = few.select("members").distinct()
    return sets.select(F.xxhash64("members").alias("key"), F.explode("members").alias("cid"), F.size("members").cast("long").alias("m"))


def _tile_pairs(met: DataFrame, classes: DataFrame, mode: str, percent: int) -> DataFrame:
    """Pairs (a, b) among classes that share a key; met: key, cid, m; classes: cid, n, comp, bits (mode exact: and hashes)."""
    carried = ["cid", "n", "comp", "bits"] + ["hashes"] * (mode == "exact")
    wide = met.select("key", "cid", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")).join(classes.select(carried), "cid")
    band = F.greatest(F.lit(8), F.floor(F.log2("n")).cast("int"))
    edge = F.call_function("shiftleft", F.lit(1).cast("long"), band + 1)
    # side 1: a visitor from the band below; side 3: at home.  Two visitors have met at home.
    home = F.struct(band.alias("band"), F.lit(3).alias("side"))
    above = F.struct((band + 1).alias("band"), F.lit(1).alias("side"))
    places = F.when(100 * F.col("n") >= percent * edge, F.array(home, above)).otherwise(F.array(home))
    block = F.pmod(F.xxhash64("cid", "key"), F.col("blocks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, block) * F.col("blocks") + F.greatest(j, block))
    cells = every if mode == "all" else F.array(block * F.col("blocks") + block)
    placed = wide.select("key", *carried, F.explode(places).alias("at"), cells.alias("cells")).select(
        F.col("at.band").alias("band"), F.col("at.side").alias("side"), "key", F.explode("cells").alias("cell"), *carried
    )
    dealt = placed.repartition("key", "band", "cell").sortWithinPartitions("band", "key", "cell", "n", "cid")
    return dealt.mapInArrow(K.tidy(_pairs_in_tiles(mode, percent)), "a long, b long").distinct()


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits in which each id sets one: what may be left out of a scan.

    Its size is fixed; with many more ids than bits it only lets more rows through.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = ids.select((bit / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("x")).groupBy("w").agg(F.bit_or("x").alias("x"))
    found = words.toArrow()  # at most 2**(FILTER_BITS - 6) rows of two numbers
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[found.column("w").to_numpy()] = found.column("x").to_numpy().astype(np.uint64)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cid and sorted hashes of the wanted classes' representatives (wanted: cid, doc_id)."""
    mask = docs.sparkSession.sparkContext.broadcast(_id_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = mask.value
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for part in K.chunks(batch, "text"):
                found = [(class_id(s), s.tobytes()) for s in shingle_sets(part.column("text"), k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["cid", "hashes"])

    scanned = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("h"), "text").mapInArrow(K.tidy(run), "cid long, hashes binary")
    return settle(scanned.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]), "sets", clean=True)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PAIRS) for b in batches for at in range(0, b.num_rows, PAIRS)):
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True)):
                keep[i] = jaccard_reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    joined = pairs.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb")), "b")
    return joined.select("a", "b", "ha", "hb").mapInArrow(K.tidy(_linked(percent)), "a long, b long")


def _round(picked: DataFrame, labelled: DataFrame, of: Column, k: int, percent: int, full: bool) -> DataFrame | None:
    """Links (a, b) found among classes of different components that share one of the keys; None if no key is shared."""
    keyed = labelled.select(F.explode(of).alias("key"), "cid", "comp")
    shared = settle(_shared(keyed), "shared", clean=True)
    if shared.isEmpty():
        drop(shared)
        return None
    met = _met(keyed, shared, labelled, percent if full else None)
    drop(shared)
    large = met.where(F.col("m") > SMALL)
    close = None
    if full:
        pairs = settle(_tile_pairs(large.unionByName(_same_few(met)), labelled, "all", percent), "pairs", clean=True)
    else:
        # hash arrays go to classes alone whose bitmaps allow a link in such a tile
        close = settle(_tile_pairs(large, labelled, "touch", percent).select(F.col("a").alias("cid")).distinct(), "close", clean=True)
        pairs = settle(_tile_pairs(_same_few(met), labelled, "spanning", percent), "pairs", clean=True)
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    ends = (ends if close is None else ends.unionByName(close)).distinct()
    wanted = settle(labelled.join(ends, "cid", "left_semi").select("cid", F.col("rep").alias("doc_id")), "wanted", clean=True)
    sets = _sets_of(picked, wanted, k)
    links = _verified(pairs, sets, percent)
    if close is not None:
        links = links.unionByName(_tile_pairs(large, labelled.join(close, "cid", "left_semi").join(sets, "cid"), "exact", percent))
    out = settle(links, "links", clean=True)
    for table in (met, pairs, wanted, sets, *([close] if close is not None else [])):
        drop(table)
    sweep(picked.sparkSession)
    return out


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    picked = _pick(docs, doc_id, text)
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(picked, k))
    profile = settle(picked.mapInArrow(K.tidy(_profiler(k, percent, levels)), PROFILE), "profile")
    rows = settle(profile.select("doc_id", "n", "cid"), "rows")
    sweep(docs.sparkSession)
    firsts = (F.first(c).alias(c) for c in ("n", "seeds", "keys", "bits"))
    classes = settle(profile.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), *firsts), "classes", clean=True)
    drop(profile)
    labelled, edges = classes.withColumn("comp", F.col("cid")), []
    for step in (0, 2, None):
        found = _round(picked, labelled, F.col("keys") if step is None else F.slice("seeds", step + 1, 2), k, percent, full=step is None)
        if found is None:
            continue
        edges.append(found)
        named = components(functools.reduce(DataFrame.unionByName, edges)).select(F.col("v").alias("cid"), "root")
        labelled = classes.join(named, "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")
    names = settle(labelled.select("cid", "rep", "comp"), "names", clean=True)
    drop(classes)
    sweep(docs.sparkSession)
    least = names.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = names.select("cid", "comp").join(least, "comp").select("cid", "component_id")
    return rows.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
