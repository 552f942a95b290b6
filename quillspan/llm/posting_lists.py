"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Fit (on a bounded sample): a tree of even two-way cuts gives centroids with about
equally many vectors each, and every centroid is linked to its nearest ones and to a
few places of the tree, a graph that fits in memory.  Index (all vectors): a walk on
the graph finds a vector's nearest centroids; one that lies on a border is stored in
the lists of all centroids that are about as near.  Search: the same walk finds the
lists of a query, those within a ratio of its nearest centroid's distance; the ratio
is measured on a bounded sample of queries against all vectors.  Lists that lie side
by side make up regions of bounded size, which meet their queries by a shuffle: a
query goes to a region once, with the numbers of its lists there, and gets one list of
the best back.  Lists longer than a region, and queries that crowd one, are cut into
blocks.  Inner products are taken exactly, and the best of all regions are merged per
query.

Largest inner products are nearest points once each vector gets one more component,
the root of what its squared norm lacks to the largest one.

Defined results: vectors that are null, empty, all zero, or hold a null, NaN or
infinite component, and rows without id, take no part; neither do vectors of another
length than the most frequent one.  Equal vectors are one class: it is searched once,
and stands in the index once with its smallest ids (one more than are asked for, so
that no answer can miss one).  Rows that repeat count once.  A query leaves out every
row of its own id.  Columns other than the id and the vector are neither read nor
returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import kernels as K
from quillspan.llm.store import settle

TOP = 20
EVERY = 20  #: queries are the rows whose id this divides
LIST = 128  #: vectors of a list, about
SAMPLE_BYTES = 32 << 20  #: of the sample that centroids are fitted on
PER_CENTROID = 8  #: sample vectors for each centroid, at least
DEGREE = 16  #: nearest centroids that each one is linked to
BEAM = 32  #: centroids that a walk keeps
CLOSURE = 1.03  #: a border vector stands in lists up to this many times as far as its nearest
REPLICAS = 3  #: lists of one vector, at most
RECALL = 0.95  #: share of true neighbours that the measured ratio must reach
TRIALS = 256  #: queries that the ratio is measured on, about
BLOCK_BYTES = 8 << 20  #: of the vectors, as doubles, of the lists that one group holds, and of its queries, about


def _dot_square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def usable(v: Column) -> Column:
    """Vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    centroids: np.ndarray  #: with the added component
    graph: np.ndarray
    entries: np.ndarray
    square: float  #: of the largest norm
    ratio: float = 1.0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with their added component."""
        rest = np.sqrt(np.maximum(self.square - (x * x).sum(1), 0.0))
        return np.concatenate([x, rest[:, None]], 1).astype(np.float32)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries as long as the longest vector; only their direction matters."""
        norm = np.sqrt((q * q).sum(1, keepdims=True))
        return np.concatenate([q * (np.sqrt(self.square) / norm), np.zeros((len(q), 1))], 1).astype(np.float32)

    def walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The centroids nearest to each row and their distances, nearest first: best-first search, all rows a step at a time."""
        n, k = len(x), len(self.centroids)
        beam, rows = min(beam, k), np.arange(len(x))[:, None]
        seen = np.zeros((n, k), bool)
        ids = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        fresh = np.repeat(self.entries[None, :], n, 0)
        while True:
            fresh = np.sort(fresh, 1)  # a centroid may come from two sides at once
            new = (fresh >= 0) & ~seen[rows, fresh]
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            seen[rows, np.where(new, fresh, fresh.max(1, keepdims=True))] |= new | seen[rows, fresh.max(1, keepdims=True)]
            r, c = np.nonzero(new)
            dist = np.full(fresh.shape, np.inf, np.float32)
            for at in range(0, len(r), 1 << 16):
                i, j = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
                gap = x[i] - self.centroids[fresh[i, j]]
                dist[i, j] = np.einsum("ij,ij->i", gap, gap)
            ids, far = np.concatenate([ids, np.where(new, fresh, -1)], 1), np.concatenate([far, dist], 1)
            open_ = np.concatenate([open_, new], 1)
            best = np.argsort(far, 1, kind="stable")[:, :beam]
            ids, far, open_ = (np.take_along_axis(a, best, 1) for a in (ids, far, open_))
            left = np.flatnonzero(open_.any(1))
            if not len(left):
                return ids, np.sqrt(far)
            # the few nearest that have not been expanded; rows that are done ask for nothing
            turn = open_ & (np.cumsum(open_, 1) <= 4)
            open_ &= ~turn
            order = np.argsort(~turn, 1, kind="stable")[:, : min(4, beam)]
            chosen = np.where(np.take_along_axis(turn, order, 1), np.take_along_axis(ids, order, 1), -1)
            fresh = np.where((chosen >= 0)[:, :, None], self.graph[chosen], -1).reshape(n, -1)

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of vectors: the nearest list, and up to ``REPLICAS`` in all of those about as near."""
        ids, far = self.walk(self.lifted(x), BEAM)
        taken = ((far <= CLOSURE * far[:, :1]) & (ids >= 0))[:, :REPLICAS]
        taken[:, 0] = True
        row, place = np.nonzero(taken)
        return row, ids[row, place]

    def lists_for(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of queries: every list within the ratio; the beam widens until it holds a list beyond."""
        x, left, beam = self.asked(q), np.arange(len(q)), BEAM
        rows, lists = [], []
        while len(left):
            ids, far = self.walk(x[left], beam)
            inside = (far <= self.ratio * far[:, :1]) & (ids >= 0)
            done = ~inside[:, -1] | (beam >= len(self.centroids))
            r, c = np.nonzero(inside & done[:, None])
            rows.append(left[r])
            lists.append(ids[r, c])
            left, beam = left[~done], beam * 2
        return np.concatenate(rows), np.concatenate(lists)


def balanced_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Means of k parts of equal size: sets are cut in two, across the line between their two halves' means, until k are left."""
    out = []

    def cut(rows: np.ndarray, k: int) -> None:
        own = x[rows]
        if k == 1:
            out.append(own.mean(0))
            return
        middle = own.mean(0)
        axis = own[np.argmax(((own - middle) ** 2).sum(1))] - middle
        place = int(len(rows) * (k // 2) / k)
        for _ in range(4):
            order = np.argsort(own @ axis, kind="stable")
            axis = own[order[place:]].mean(0) - own[order[:place]].mean(0)
        order = np.argsort(own @ axis, kind="stable")
        cut(rows[order[:place]], k // 2)
        cut(rows[order[place:]], k - k // 2)

    cut(np.arange(len(x)), k)
    return np.array(out, np.float32)


def link(centroids: np.ndarray) -> np.ndarray:
    """Each centroid's neighbours: the nearest ones, and those 1, 2, 4, ... places on in the tree's order, so that all are reached."""
    k = len(centroids)
    jumps = [1 << j for j in range(max(1, (k - 1).bit_length()))]
    far = np.stack([(np.arange(k) + s * j) % k for j in jumps for s in (1, -1)], 1)
    near = []
    norms = (centroids**2).sum(1)
    for at in range(0, k, 1024):
        d = norms[None, :] - 2 * centroids[at : at + 1024] @ centroids.T
        near.append(np.argsort(d, 1, kind="stable")[:, : DEGREE + 1] if k <= 4 * DEGREE else np.argpartition(d, DEGREE, 1)[:, : DEGREE + 1])
    return np.concatenate([np.concatenate(near), far], 1).astype(np.int64)


def fit(sample: np.ndarray, k: int, square: float) -> Index:
    """The index of a sample; ``square`` is the largest squared norm of all vectors."""
    index = Index(np.empty((0, 0)), np.empty((0, 0)), np.empty(0), square)
    means = balanced_centroids(index.lifted(sample), k)
    # lifted vectors lie on a sphere; there, means of tight and of loose parts compete on equal terms
    index.centroids = means * (np.sqrt(square) / np.maximum(np.sqrt((means**2).sum(1, keepdims=True)), 1e-30)).astype(np.float32)
    index.graph = link(index.centroids)
    index.entries = np.unique(np.linspace(0, k - 1, min(k, BEAM)).astype(np.int64))
    return index


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _ranks(groups: np.ndarray) -> np.ndarray:
    """The place of each row in its group; groups are sorted."""
    head = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(head, np.diff(np.append(head, len(groups))))


def best(q: np.ndarray, x: np.ndarray, first: np.ndarray, cid: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's ``top`` best, ties to the smaller first id; whole at ties of the last place."""
    out = []
    step = max(1, (1 << 22) // max(1, len(x)))
    for at in range(0, len(q), step):
        s = q[at : at + step] @ x.T
        if len(x) > top + 3:  # products by blocks differ in the last bits: some more are taken, then scored one by one
            s_min = np.partition(s, len(x) - top - 3, 1)[:, len(x) - top - 3]
            r, c = np.nonzero(s >= s_min[:, None])
        else:
            r, c = (a.ravel() for a in np.indices(s.shape))
        score = np.einsum("ij,ij->i", q[at + r], x[c])
        order = np.lexsort((cid[c], first[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        keep = _ranks(r) < top
        out.append((at + r[keep], c[keep], score[keep]))
    return tuple(np.concatenate(a) for a in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


@dataclass
class Vectors:
    """Classes of equal vectors (cid, first, ids, v), settled, and what is known of all of them."""

    classes: DataFrame
    n: int
    length: int
    square: float
    kind: str


def classes_of(rows: DataFrame, top: int) -> Vectors | None:
    """Classes of the usable vectors of (id, v); None if there are none.

    Only the smallest ``top + 1`` ids of a class can be in an answer; each task keeps
    no more before rows move, so a class of any number of copies stays small.
    """
    shape = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), F.max(_dot_square(F.col("v"))).alias("square"))
    most = shape.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not most:
        return None
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    few = rows.where(F.size("v") == most[0]["length"]).withColumn("place", place).where(F.col("place") <= top + 1)
    made = few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    kind = "f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "f8"
    table = settle(made.select(F.monotonically_increasing_id().alias("cid"), F.get("ids", F.lit(0)).alias("first"), "ids", "v"), "vector-classes")
    return Vectors(table, table.count(), most[0]["length"], float(most[0]["square"]), kind)


def _share(table: DataFrame, column: str, n: int, wanted: int) -> DataFrame:
    """About ``wanted`` of n rows, the same ones each time."""
    return table.where(F.pmod(F.xxhash64(F.lit(13), column), F.lit(1 << 20)) < F.lit(int(min(1.0, wanted / max(n, 1)) * (1 << 20)) + 1))


def fit_index(v: Vectors, size: int = LIST, sample_bytes: int = SAMPLE_BYTES) -> Index:
    """Centroids of a sample of at most ``sample_bytes`` (a few per cent more by chance): a list for each ``size`` vectors, while the sample gives each enough."""
    most = max(PER_CENTROID, sample_bytes // (4 * (v.length + 1)))
    k = max(1, min(-(-v.n // size), most // PER_CENTROID))
    rows = _share(v.classes.select("cid", F.transform("v", lambda x: x.cast("float")).alias("v")), "cid", v.n, min(most, 64 * k)).toArrow()
    sample = _vectors(rows.sort_by("cid").column("v").combine_chunks()) if rows.num_rows else np.empty((0, v.length), np.float32)
    if len(sample) < k:
        k = max(1, len(sample))
    if not len(sample):
        sample = np.zeros((1, v.length), np.float32)
    return fit(sample.astype(np.float64), k, v.square)


_ENTRY = "list int, cid long, first long, vec binary"
_PROBE = "region int, q long, lists array<int>, vec binary"
_MET = "q long, cid long, first long, score double"


def _stored(index: Index, kind: str):
    """Vectors under each of their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _vectors(part.column("v"))
                row, lists = index.lists_of(x.astype(np.float64))
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), part.column("cid").take(pick), part.column("first").take(pick), _rows(x, kind).take(pick)], names=["list", "cid", "first", "vec"])

    return K.tidy(run)


def _probing(index: Index, kind: str, region: np.ndarray):
    """Queries under each region where they probe lists, with those lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _vectors(part.column("v"))
                row, lists = index.lists_for(x.astype(np.float64))
                row, lists = row[region[lists] >= 0], lists[region[lists] >= 0]  # not those that are empty
                order = np.lexsort((lists, region[lists], row))
                row, lists = row[order], lists[order]
                key = row * np.int64(len(region)) + region[lists]
                heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
                pick = pa.array(row[heads])
                held = pa.ListArray.from_arrays(pa.array(np.append(heads, len(key)), pa.int32()), pa.array(lists, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(region[lists[heads]], pa.int32()), part.column("cid").take(pick), held, _rows(x, kind).take(pick)], names=["region", "q", "lists", "vec"])

    return K.tidy(run)


def _rows(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())


def post(v: Vectors, index: Index) -> DataFrame:
    """The index as a table: list, cid, first, vec; every class stands in one list or more."""
    return settle(v.classes.select("cid", "first", "v").mapInArrow(_stored(index, v.kind), _ENTRY), "posting-lists")


def _trial(asked: pa.Table, kind: str, top: int):
    """The best of a task's vectors for each of a few queries."""
    q = _matrix(asked.column("vec"), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _vectors(part.column("v")).astype(np.float64)
                first = part.column("first").to_numpy()
                row, col, score = best(q, x, first, first, top)
                new = [row, first[col], score, x[col]]
                held = new if held is None else [np.concatenate(a) for a in zip(held, new, strict=True)]
                order = np.lexsort((held[1], -held[2], held[0]))
                held = [a[order] for a in held]
                keep = _ranks(held[0]) < top
                held = [a[keep] for a in held]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2]), _rows(held[3], "f8")], names=["trial", "first", "score", "vec"])

    return K.tidy(run)


def measure_ratio(v: Vectors, index: Index, queries: DataFrame, n_queries: int, top: int = TOP, recall: float = RECALL, trials: int = TRIALS) -> float:
    """The smallest ratio with which a sample of queries reaches ``recall`` of its true neighbours among all vectors."""
    drawn = _share(queries.select("cid", "v"), "cid", n_queries, trials)
    asked = drawn.mapInArrow(_packed(v.kind), "cid long, vec binary").toArrow().sort_by("cid")
    if not asked.num_rows:
        return float("inf")
    near = v.classes.select("first", "v").mapInArrow(_trial(asked, v.kind, top), "trial long, first long, score double, vec binary")
    place = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "first"))
    found = near.withColumn("place", place).where(F.col("place") <= top).toArrow()
    q = index.asked(_matrix(asked.column("vec"), v.kind))
    trial = found.column("trial").to_numpy()
    row, lists = index.lists_of(_matrix(found.column("vec"), "f8"))
    nearest = np.array([np.sqrt(((index.centroids - x) ** 2).sum(1).min()) for x in q])
    far = np.sqrt(((index.centroids[lists] - q[trial[row]]) ** 2).sum(1))
    need = np.full(len(trial), np.inf)
    np.minimum.at(need, row, far / np.maximum(nearest[trial[row]], 1e-30))
    return float(np.quantile(need, recall, method="higher")) * (1 + 1e-6)


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("v")) if batch.num_rows else np.empty((0, 1), kind)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), _rows(x, kind)], names=["cid", "vec"])

    return run


def _meet(kind: str, top: int):
    """The best of a block of a region for each of its queries, each among the lists that it probes."""
    out = pa.schema([("q", pa.int64()), ("cid", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])

    def run(entries: pa.Table, probes: pa.Table) -> pa.Table:
        if not entries.num_rows or not probes.num_rows:
            return out.empty_table()
        entries = entries.sort_by("list")
        cid, first, lists = (entries.column(c).to_numpy() for c in ("cid", "first", "list"))
        x, q = _matrix(entries.column("vec"), kind), _matrix(probes.column("vec"), kind)
        probed = probes.column("lists").combine_chunks()
        wanted = probed.flatten().to_numpy()
        asker = np.repeat(np.arange(len(q)), probed.value_lengths().to_numpy())
        order = np.argsort(wanted, kind="stable")
        wanted, asker = wanted[order], asker[order]
        parts, waiting = [], 0
        for here in np.unique(lists):
            a, b = np.searchsorted(lists, [here, here + 1])
            askers = asker[slice(*np.searchsorted(wanted, [here, here + 1]))]
            row, col, score = best(q[askers], x[a:b], first[a:b], cid[a:b], top)
            parts.append((askers[row], a + col, score))
            waiting += len(row)
            if waiting > 1 << 20:
                parts, waiting = [merged(parts, first, cid, top)], 0
        row, col, score = merged(parts, first, cid, top)
        return pa.table([probes.column("q").to_numpy()[row], cid[col], first[col], score], schema=out)

    return run


def merged(parts: list, first: np.ndarray, cid: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` best of each query of several lists; a vector found in two of them counts once."""
    row, col, score = (np.concatenate(a) for a in zip(*parts, strict=True))
    order = np.lexsort((cid[col], first[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (cid[col[1:]] != cid[col[:-1]])
    row, col, score = row[once], col[once], score[once]
    keep = _ranks(row) < top if len(row) else once[:0]
    return row[keep], col[keep], score[keep]


def regions(sizes: np.ndarray, room: int) -> np.ndarray:
    """The region of each list: neighbours in the tree's order together while they have room; -1 for empty lists."""
    out = np.full(len(sizes), -1, np.int64)
    number, held = 0, 0
    for k in np.flatnonzero(sizes):
        if held and held + sizes[k] > room:
            number, held = number + 1, 0
        out[k] = number
        held += int(sizes[k])
    return out


def search_lists(entries: DataFrame, queries: DataFrame, v: Vectors, index: Index, top: int) -> DataFrame:
    """q, cid, first, score: the ``top`` best classes of each query (cid, v) among the lists that it probes."""
    spark = entries.sparkSession
    room = max(top, BLOCK_BYTES // (8 * v.length))
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in entries.groupBy("list").count().collect():  # a row for each centroid
        sizes[r["list"]] = r["count"]
    region = regions(sizes, room)
    parts = np.maximum(1, -(-sizes // room))
    where = spark.createDataFrame([(int(k), int(region[k]), int(parts[k])) for k in np.flatnonzero(sizes)], "list int, region int, parts int")
    probes = settle(queries.select("cid", "v").mapInArrow(_probing(index, v.kind, region), _PROBE), "probes")
    turns = probes.groupBy("region").agg(F.ceil(F.count("*") / room).cast("int").alias("turns"))
    cut = where.groupBy("region").agg(F.max("parts").alias("parts")).join(turns, "region")
    mine = lambda key, n: F.pmod(F.xxhash64(F.lit(5), key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # both small tables have a row for each centroid at most
    placed = entries.join(F.broadcast(where.select("list", "region")), "list").join(F.broadcast(cut), "region")
    left = placed.withColumn("part", mine("cid", "parts")).withColumn("turn", every("turns")).select("region", "part", "turn", "list", "cid", "first", "vec")
    right = probes.join(F.broadcast(cut), "region").withColumn("turn", mine("q", "turns")).withColumn("part", every("parts")).select("region", "part", "turn", "q", "lists", "vec")
    key = ("region", "part", "turn")
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_meet(v.kind, top), _MET)
    place = F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "cid"))  # found in two regions: one place
    return met.withColumn("place", place).where(F.col("place") <= top).select("q", "cid", "first", "score").distinct()


def neighbours(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, every: int = EVERY, size: int = LIST, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row whose id ``every`` divides, nearest first."""
    spark = table.sparkSession
    raw = table.select(table[vec_id].cast("long").alias("id"), table[vector].alias("v"))
    if raw.schema["v"].dataType.elementType.simpleString() not in ("float", "double"):
        raw = raw.withColumn("v", F.transform("v", lambda x: x.cast("double")))
    rows = raw.where(F.col("id").isNotNull() & usable(F.col("v")))
    known = classes_of(rows, top)
    if known is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asks = settle(rows.where(F.col("id") % every == 0).select("id", "v").join(known.classes.select("v", "cid"), "v").select("id", F.col("cid").alias("q")).distinct(), "asks")
    queries = settle(known.classes.join(asks.select(F.col("q").alias("cid")), "cid", "left_semi").select("cid", "v"), "query-vectors")
    index = fit_index(known, size)
    index.ratio = measure_ratio(known, index, queries, queries.count(), top, recall)
    entries = post(known, index)
    met = search_lists(entries, queries, known, index, top + 1)
    # copies come back: a class's smallest ids
    copies = known.classes.where(F.size("ids") > 1).select("cid", "ids")
    spread = met.join(copies, "cid", "left").select("q", "score", F.explode(F.coalesce("ids", F.array("first"))).alias("id"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    near = spread.withColumn("place", place).where(F.col("place") <= top + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near"))
    own = asks.join(near, "q").select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, top).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), "x.score")
