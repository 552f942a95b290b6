"""Token-ID output (operator 4): a content-addressed store of id chunks.

A document's ids (with the end id behind them) are cut where a rolling hash of the
last 16 ids hits a mask, so equal passages give equal chunks wherever they stand.
Layout below the store's root, all Parquet:

* ``cut/kind=chunk``: digest, payload (ids, little-endian) - each digest once;
* ``recipes``: one row per document in ascending doc_id order (files ascending too):
  part, pos, doc_id, start, n_ids, digests, lengths;
* ``manifest``: per part the number of documents and ids and the root of a Merkle
  tree over its recipes, and a row for the root over all parts (part -1).

Reading checks every payload against its digest, every recipe against the manifest
and every length, and takes a document's crc32 from its chunks' checksums by crc
combination, so payloads are never moved.

A null or empty text has the end id alone.  Rows that repeat are documents of their
own, in any order among equals.  A null doc_id comes last.  An empty table gives an
empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm import bpe
from quillspan.llm import kernels as K

END_ID = 2
WINDOW = 16
MASK_BITS = 9
LEAST, MOST = 128, 2048
SEEN = 400_000
DIGEST = 16

_CUT = "kind string, slot long, digest binary, payload binary, width int, doc_id long, n_ids long, digests binary, lengths binary"


def digest_of(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def cut_all(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each id stream of a flat array, counted from its own beginning.

    Content-defined, between LEAST and MOST ids long (a stream's last may be shorter).
    """
    n = len(ids)
    up, down = K._power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hits = np.empty(0, np.int64)
    if n > WINDOW:
        window = K.mix((total[WINDOW:] - total[:-WINDOW]) * down[: n - WINDOW + 1])
        hits = np.flatnonzero(window >> np.uint64(64 - MASK_BITS) == 0) + WINDOW
    first = np.searchsorted(hits, bounds[:-1] + WINDOW)  # a window that began in the text before says nothing
    last = np.searchsorted(hits, bounds[1:], side="right")
    places = hits.tolist()
    out = []
    for begin, end, i, j in zip(bounds.tolist(), bounds[1:].tolist(), first.tolist(), last.tolist()):
        ends, at, size = [], 0, end - begin
        for e in (p - begin for p in places[i:j]):
            while e - at > MOST:
                at += MOST
                ends.append(at)
            if e - at >= LEAST:
                ends.append(e)
                at = e
        while size - at > MOST:
            at += MOST
            ends.append(at)
        if at < size:
            ends.append(size)
        out.append(ends)
    return out


def cut_points(ids: np.ndarray) -> list[int]:
    return cut_all(ids, np.array([0, len(ids)]))[0]


def _cut(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        tail = np.array([end_id], dtype=coder.kind).tobytes()
        seen: set[bytes] = set()
        for batch in batches:
            for part in K.chunks(batch, "text", 2 * K.CHUNK_BYTES):
                chunks: dict[bytes, bytes] = {}
                recipes = []
                streams = [x + tail for x in coder.encode(part.column("text"))]
                bounds = np.cumsum([0, *map(len, streams)]) // coder.width
                cuts = cut_all(np.frombuffer(b"".join(streams), coder.kind), bounds)
                for doc, ids, ends in zip(part.column("doc_id").to_pylist(), streams, cuts, strict=True):
                    digests, at = [], 0
                    for e in ends:
                        payload = ids[at * coder.width : e * coder.width]
                        d = digest_of(payload)
                        digests.append(d)
                        if d not in seen:
                            seen.add(d)
                            chunks[d] = payload
                        at = e
                    recipes.append((doc, len(ids) // coder.width, b"".join(digests), np.diff([0, *ends]).astype("<u4").tobytes()))
                if len(seen) > SEEN:
                    seen.clear()
                yield _rows(chunks, recipes, coder.width)

    return run


def _rows(chunks: dict[bytes, bytes], recipes: list, width: int) -> pa.RecordBatch:
    c, r = len(chunks), len(recipes)
    slots = [int.from_bytes(d[:8], "little", signed=True) for d in chunks] + [int.from_bytes(digest_of(x[2] + str(x[0]).encode())[:8], "little", signed=True) for x in recipes]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["chunk"] * c + ["recipe"] * r, pa.string()),
            pa.array(slots, pa.int64()),
            pa.array([*chunks, *[None] * r], pa.binary()),
            pa.array([*chunks.values(), *[None] * r], pa.binary()),
            pa.array([width] * (c + r), pa.int32()),
            pa.array([None] * c + [x[0] for x in recipes], pa.int64()),
            pa.array([None] * c + [x[1] for x in recipes], pa.int64()),
            pa.array([None] * c + [x[2] for x in recipes], pa.binary()),
            pa.array([None] * c + [x[3] for x in recipes], pa.binary()),
        ],
        names=["kind", "slot", "digest", "payload", "width", "doc_id", "n_ids", "digests", "lengths"],
    )


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes pass; of a chunk's copies (all in this partition) the first passes."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = np.ones(batch.num_rows, dtype=bool)
        for i, d in enumerate(batch.column("digest").to_pylist()):
            if d is not None:
                keep[i] = d not in seen
                seen.add(d)
        yield batch.filter(pa.array(keep))


class _Merkle:
    """Root of a binary hash tree over leaves that come one by one."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level, node = 0, hashlib.blake2b(b"\0" + leaf, digest_size=DIGEST).digest()
        while self.stack and self.stack[-1][0] == level:
            node = hashlib.blake2b(b"\1" + self.stack.pop()[1] + node, digest_size=DIGEST).digest()
            level += 1
        self.stack.append((level, node))

    def root(self) -> bytes:
        node = b""
        for _, x in reversed(self.stack):
            node = hashlib.blake2b(b"\1" + x + node, digest_size=DIGEST).digest() if node else x
        return node


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (part, pos): a row for each part."""
    at, tree, docs, ids = None, _Merkle(), 0, 0
    out = []
    for batch in batches:
        for p, n, d, k in zip(*(batch.column(c).to_pylist() for c in ("part", "n_ids", "digests", "lengths")), strict=True):
            if p != at:
                if at is not None:
                    out.append((at, docs, ids, tree.root()))
                at, tree, docs, ids = p, _Merkle(), 0, 0
            tree.add(d + k)
            docs += 1
            ids += n
    if at is not None:
        out.append((at, docs, ids, tree.root()))
    yield pa.RecordBatch.from_pylist([dict(zip(("part", "n_docs", "n_ids", "root"), x, strict=True)) for x in out], pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("root", pa.binary())]))


def _manifest(recipes: DataFrame) -> list[tuple[int, int, int, bytes]]:
    """A row per part (as many as the recipes have partitions)."""
    rows = recipes.select("part", "pos", "n_ids", "digests", "lengths").repartition("part").sortWithinPartitions("part", "pos")
    found = rows.mapInArrow(_roots, "part int, n_docs long, n_ids long, root binary").collect()
    return sorted((r["part"], r["n_docs"], r["n_ids"], bytes(r["root"])) for r in found)


def write_store(docs: DataFrame, root: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> None:
    """Encode all documents and write chunks, recipes and manifest below ``root``."""
    spark = docs.sparkSession
    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    cut = picked.mapInArrow(K.tidy(_cut(path or bpe.default_path(), end_id)), _CUT)
    once = cut.repartition("slot").mapInArrow(_first_of_each, _CUT).drop("slot")
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{root}/cut")
    stored = spark.read.schema(_CUT.replace("slot long, ", "")).parquet(f"{root}/cut")
    ordered = (
        stored.where("kind = 'recipe'")
        .select("doc_id", "n_ids", "digests", "lengths")
        .repartitionByRange(F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "digests")
        .select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "doc_id", "n_ids", "digests", "lengths")
    )
    ordered.write.option("compression", "zstd").parquet(f"{root}/order")
    recipes = spark.read.schema(ordered.schema).parquet(f"{root}/order")
    roots = _manifest(recipes)
    tree = _Merkle()
    base, starts = 0, []
    for part, _, n, node in roots:
        starts.append((part, base))
        base += n
        tree.add(node)
    offsets = spark.createDataFrame(starts, "p int, base long")  # a row per partition
    run = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.join(F.broadcast(offsets), F.col("part") == F.col("p")).withColumn("start", F.col("base") + F.coalesce(F.sum("n_ids").over(run), F.lit(0)))
    placed.select("part", "pos", "doc_id", "start", "n_ids", "digests", "lengths").write.option("compression", "zstd").parquet(f"{root}/recipes")
    total = (-1, sum(r[1] for r in roots), base, tree.root())
    spark.createDataFrame([*roots, total], "part int, n_docs long, n_ids long, root binary").coalesce(1).write.parquet(f"{root}/manifest")


def _shift_tables(bits: int) -> np.ndarray:
    """tables[k][j][b]: crc32 of byte b at place j carried over 2**k zero bytes."""
    one = np.array([zlib.crc32(b"\0", i) ^ zlib.crc32(b"\0", 0) for i in [1 << b for b in range(32)]], dtype=np.uint32)

    def spread(columns: np.ndarray) -> np.ndarray:
        table = np.zeros((4, 256), dtype=np.uint32)
        for j in range(4):
            for b in range(8):
                table[j, 1 << b : 2 << b] = table[j, : 1 << b] ^ columns[8 * j + b]
        return table

    out, columns = [], one
    for _ in range(bits):
        out.append(spread(columns))
        columns = _carry(out[-1], columns)
    return np.array(out)


def _carry(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def combine(crc: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """crc32 of each row's pieces put together: crc32 and byte count of all pieces, and where each row's begin."""
    many = np.diff(bounds)
    out = np.zeros(len(many), dtype=np.uint32)
    if not len(crc):
        return out
    tables = _shift_tables(int(size.max()).bit_length())
    order = np.argsort(-many, kind="stable")
    for j in range(int(many.max())):
        rows = order[: int(np.searchsorted(-many[order], -j, side="left"))]
        value, length = out[rows], size[bounds[rows] + j]
        for k in range(len(tables)):
            on = (length >> k) & 1 == 1
            if on.any():
                value[on] = _carry(tables[k], value[on])
        out[rows] = value ^ crc[bounds[rows] + j]
    return out


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk its crc32 (as 32-bit ids) and number of ids; a payload that isn't its digest's is refused."""
    for batch in batches:
        crcs, sizes = [], []
        for d, p, w in zip(*(batch.column(c).to_pylist() for c in ("digest", "payload", "width")), strict=True):
            if digest_of(p) != d:
                raise ValueError(f"chunk {d.hex()} is damaged")
            ids = np.frombuffer(p, f"<u{w}")
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            sizes.append(len(ids))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], names=["digest", "crc", "size"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column("pieces")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds -= bounds[0]
        at, crc, size = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "crc", "size"))
        order = np.lexsort((at, np.repeat(np.arange(batch.num_rows), np.diff(bounds))))
        crcs = combine(crc[order].astype(np.uint32), 4 * size[order], bounds)
        n = np.diff(np.concatenate([[0], np.cumsum(size[order])])[bounds])
        if (n != batch.column("n_ids").to_numpy(zero_copy_only=False)).any():
            raise ValueError("a document's chunks don't add up to its length")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n), pa.array(crcs.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def verify(spark: SparkSession, root: str) -> None:
    """Raise unless the recipes give the manifest's roots."""
    kept = {r["part"]: (r["n_docs"], r["n_ids"], bytes(r["root"])) for r in spark.read.parquet(f"{root}/manifest").collect()}
    total, tree = kept.pop(-1), _Merkle()
    found = _manifest(spark.read.parquet(f"{root}/recipes"))
    for part, *rest in found:
        if kept.get(part) != tuple(rest):
            raise ValueError(f"recipes of part {part} differ from the manifest")
        tree.add(rest[-1])
    if total != (sum(r[1] for r in found), sum(r[2] for r in found), tree.root()):
        raise ValueError("the manifest's root differs")


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    verify(spark, root)
    chunks = spark.read.schema(_CUT.replace("slot long, ", "")).parquet(f"{root}/cut").where("kind = 'chunk'").select("digest", "payload", "width")
    sums = chunks.mapInArrow(_checked, "digest binary, crc long, size long")
    recipes = spark.read.parquet(f"{root}/recipes").select("part", "pos", "doc_id", "start", "n_ids", "digests")
    refs = recipes.select("part", "pos", "doc_id", "start", "n_ids", F.explode(F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1)).alias("at"), "digests").select(
        "part", "pos", "doc_id", "start", "n_ids", "at", F.substring("digests", F.col("at") * DIGEST + 1, F.lit(DIGEST)).alias("digest")
    )
    joined = refs.join(sums, "digest", "left").select("part", "pos", "doc_id", "start", "n_ids", F.struct("at", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("size", F.lit(0)).alias("size")).alias("piece"))
    whole = joined.groupBy("part", "pos", "doc_id", "start", "n_ids").agg(F.collect_list("piece").alias("pieces"))
    return whole.select("doc_id", "start", "n_ids", "pieces").mapInArrow(_gathered, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start and ids of each document, put together from the chunks."""
    chunks = spark.read.schema(_CUT.replace("slot long, ", "")).parquet(f"{root}/cut").where("kind = 'chunk'").select("digest", "payload", "width")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column("pieces").to_pylist():
                p.sort(key=lambda x: x["at"])
                out.append(np.concatenate([np.frombuffer(x["payload"], f"<u{x['width']}") for x in p]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    recipes = spark.read.parquet(f"{root}/recipes")
    refs = recipes.select("part", "pos", "doc_id", "start", "digests", F.explode(F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1)).alias("at")).withColumn(
        "digest", F.substring("digests", F.col("at") * DIGEST + 1, F.lit(DIGEST))
    )
    whole = refs.join(chunks, "digest").groupBy("part", "pos", "doc_id", "start").agg(F.collect_list(F.struct("at", "payload", "width")).alias("pieces"))
    return whole.select("doc_id", "start", "pieces").mapInArrow(join_up, "doc_id long, start long, ids array<int>")
