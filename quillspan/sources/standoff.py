"""Corpus folders as a data source: ``spark.read.format("standoff")`` and ``df.write.format("standoff")``, after ``register``.

A folder holds one folder for each fold, and there, at any depth, <doc_id>.txt and
<doc_id>.ann.  A partition is a slice of the ids by their checksum: its task lists the
folds, keeps its own slice of the names and opens those files, so that neither names
nor texts pass through the driver.  Columns: doc_id, split, text, ann; files are opened
only for the columns that are asked for (give ``.schema(...)``), folders only of the
folds that ``split`` filters leave.

Options: ``slices`` (tasks, 64), ``folds`` (comma-joined; the sealed fold is read only
if named there), ``overwrite`` of a writer is not offered: files that are there stay.
A text without annotations, or annotations without a text, stop the read, as does an
id that stands twice in a fold; the message counts and never names texts.  Empty files
are documents like any other.  Paths are those that Arrow's file systems open (local,
``file:``, ``hdfs:``, ``s3:`` and others); for any other store use ``brat.read_brat``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillspan.model import SEALED_SPLIT, SpanError

SCHEMA = "doc_id string, split string, text string, ann string"
SLICES = 64
BATCH_BYTES = 8 << 20
_FILES = {"text": ".txt", "ann": ".ann"}


def _open(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Slice(InputPartition):
    def __init__(self, number: int, of: int):
        super().__init__(number)
        self.number, self.of = number, of


class StandoffReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.names
        self.slices = int(options.get("slices", SLICES))
        folds = options.get("folds")
        self.folds = [x.strip() for x in folds.split(",")] if folds else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """``split`` against values decides which folders are listed; everything else is left to Spark."""
        for f in filters:
            asked = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if asked is None or f.attribute != ("split",):
                yield f
            else:
                self.folds = [x for x in asked if x in self.folds] if self.folds is not None else [x for x in asked if x != SEALED_SPLIT]

    def partitions(self) -> list[InputPartition]:
        return [Slice(i, self.slices) for i in range(self.slices)]

    def _folders(self, files, root: str) -> list[tuple[str, str]]:
        from pyarrow import fs

        if self.folds is not None:
            return [(x, f"{root}/{x}") for x in self.folds]
        inside = files.get_file_info(fs.FileSelector(root))
        return sorted((x.base_name, x.path) for x in inside if x.type == fs.FileType.Directory and x.base_name != SEALED_SPLIT and not x.base_name.startswith("."))

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = _open(self.path.rstrip("/"))
        for fold, folder in self._folders(files, root):
            found: dict[str, dict[str, str]] = {c: {} for c in _FILES}
            for info in files.get_file_info(fs.FileSelector(folder, recursive=True)):
                for c, suffix in _FILES.items():
                    stem = info.base_name.removesuffix(suffix)
                    if info.type == fs.FileType.File and stem != info.base_name and not stem.startswith(".") and zlib.crc32(stem.encode()) % partition.of == partition.number:
                        if stem in found[c]:
                            raise SpanError("a doc_id stands twice in a fold")
                        found[c][stem] = info.path
            if alone := found["text"].keys() ^ found["ann"].keys():
                raise SpanError(f"{len(alone)} files have no partner")
            yield from self._batches(files, fold, found)

    def _batches(self, files, fold: str, found: dict[str, dict[str, str]]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for stem in sorted(found["text"]):
            row = {"doc_id": stem, "split": fold}
            for c in _FILES:
                if c in self.columns:
                    with files.open_input_stream(found[c][stem]) as f:
                        row[c] = f.read().decode("utf-8")
                    held += len(row[c])
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in self.columns], names=list(self.columns))


class StandoffWriter(DataSourceArrowWriter):
    """A file is written beside its place and moved there, so a task that runs twice leaves whole files."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _open(self.path.rstrip("/"))
        made = set()
        for batch in iterator:
            for row in batch.to_pylist():
                folder = f"{root}/{row['split']}"
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                for c, suffix in _FILES.items():
                    aside = f"{folder}/.{uuid.uuid4().hex}"
                    with files.open_output_stream(aside) as f:
                        f.write((row[c] or "").encode("utf-8"))
                    files.move(aside, f"{folder}/{row['doc_id']}{suffix}")
        return WriterCommitMessage()


class Standoff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "standoff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return StandoffReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise SpanError("a corpus is not written over another")
        return StandoffWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session; filters reach Python sources only with this setting, which the reader needs."""
    spark.dataSource.register(Standoff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_folder(spark: SparkSession, path: str, folds: str | None = None, slices: int = SLICES, columns: str = SCHEMA) -> DataFrame:
    """doc_id, split, text, ann of a corpus folder, or fewer ``columns``: ids and folds come without opening a file."""
    register(spark)
    reader = spark.read.format("standoff").schema(columns).option("slices", slices)
    return (reader.option("folds", folds) if folds else reader).load(path)


def write_folder(docs: DataFrame, path: str) -> None:
    """docs: doc_id, split, text, ann (nulls give empty files)."""
    register(docs.sparkSession)
    docs.select("doc_id", "split", "text", "ann").write.format("standoff").mode("append").save(path)
