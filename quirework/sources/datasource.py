"""Tables of documents as a Spark data source, ``format("quirework")``.

A table is a folder: Parquet files, each with a range of keys (``page_id``
unless the option ``key`` names another), and a list of the files that are
current, with the least and the greatest key of each. Opening reads the list;
a range of keys leaves out files before a task is made for them, and is then
applied to rows: by the options ``low`` and ``high``, or, with ``push_filters``, by
filters that Spark pushes down. Use a table that was opened with that once in a
plan: Spark 4.1 keeps what it pushed last for all scans of one DataFrame, so two
different filters of it would read wrong rows. Without, any plan is right. Saving writes new files beside the old ones and puts a new list
in place of the old at its end, so a table is the old or the new one at any
time; a failed save leaves the old, and takes its own files away.

The tasks write and read the files themselves, by pyarrow: the path is a URI of a
file system that pyarrow knows and all executors share. Rows should be dealt out
by ranges of the key before they are saved (``saved()`` does so).
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

LIST = "_files.json"
#: Rows of a row group.
GROUP = 16_384


@dataclass
class Saved(WriterCommitMessage):
    """What a task has written: a file (none if it had no rows), its rows, and its least and greatest key (none if all are null)."""

    file: str | None
    rows: int = 0
    least: object = None
    greatest: object = None
    nulls: bool = False


@dataclass
class Files(InputPartition):
    file: str


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def current(path: str) -> dict | None:
    """The list of a table's files; none where no table was saved."""
    files, root = _place(path)
    try:
        with files.open_input_stream(f"{root}/{LIST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def _holds(entry: dict, f: Filter) -> bool:
    """Whether a file can hold rows that pass a filter on the key."""
    low, high = entry["least"], entry["greatest"]
    if low is None:
        return False
    match f:
        case EqualTo(_, v):
            return low <= v <= high
        case In(_, values):
            return any(low <= v <= high for v in values)
        case GreaterThan(_, v):
            return high > v
        case GreaterThanOrEqual(_, v):
            return high >= v
        case LessThan(_, v):
            return low < v
        case LessThanOrEqual(_, v):
            return low <= v
    return True


def _condition(f: Filter) -> ds.Expression:
    field = pc.field(f.attribute[0])
    match f:
        case EqualTo(_, v):
            return field == v
        case In(_, values):
            return field.isin(list(values))
        case GreaterThan(_, v):
            return field > v
        case GreaterThanOrEqual(_, v):
            return field >= v
        case LessThan(_, v):
            return field < v
        case _:
            return field <= f.value


class _Reader(DataSourceReader):
    def __init__(self, path: str, key: str, entries: list[dict], schema: StructType):
        self.path, self.key, self.entries, self.names = path, key, entries, schema.fieldNames()
        self.filters: list[Filter] = []

    def partitions(self) -> list[Files]:
        held = [e for e in self.entries if all(_holds(e, f) for f in self.filters)]
        return [Files(e["file"]) for e in held] or [Files("")]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, root = _place(self.path)
        condition = None
        for f in self.filters:
            condition = _condition(f) if condition is None else condition & _condition(f)
        table = ds.dataset(f"{root}/{partition.file}", filesystem=files, format="parquet")
        # One row group after the other: read ahead, a file would stand in memory whole.
        plain = ds.ParquetFragmentScanOptions(pre_buffer=False, use_buffered_stream=True)
        yield from table.to_batches(columns=self.names, filter=condition, batch_size=GROUP, batch_readahead=1, fragment_readahead=0, fragment_scan_options=plain, use_threads=False)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            plain = isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)
            if plain and f.attribute == (self.key,) and (not isinstance(f, In) or None not in f.value):
                self.filters.append(f)
            else:
                yield f


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, schema: StructType, overwrite: bool):
        self.path, self.key, self.schema, self.overwrite = path, key, schema.json(), overwrite
        self.version = f"v{uuid.uuid4().hex[:16]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Saved:
        files, root = _place(self.path)
        out, sink, told = None, None, Saved(None)
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    told.file = f"{self.version}/{uuid.uuid4().hex}.parquet"
                    files.create_dir(f"{root}/{self.version}", recursive=True)
                    sink = files.open_output_stream(f"{root}/{told.file}")
                    out = pq.ParquetWriter(sink, batch.schema, compression="zstd")
                out.write_table(pa.Table.from_batches([batch]), row_group_size=GROUP)
                keys = batch.column(batch.schema.get_field_index(self.key))
                found = pc.min_max(keys).as_py()
                told.rows += batch.num_rows
                told.nulls |= keys.null_count > 0
                if found["min"] is not None:
                    told.least = found["min"] if told.least is None else min(told.least, found["min"])
                    told.greatest = found["max"] if told.greatest is None else max(told.greatest, found["max"])
        finally:
            if out is not None:
                out.close()
                sink.close()
        return told

    def commit(self, messages: list[Saved | None]) -> None:
        files, root = _place(self.path)
        old = current(self.path)
        new = [{"file": m.file, "rows": m.rows, "least": m.least, "greatest": m.greatest, "nulls": m.nulls} for m in messages if m is not None and m.file]
        kept = [] if old is None or self.overwrite else old["files"]
        listed = {"key": self.key, "schema": json.loads(self.schema), "files": kept + new}
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{LIST}.{self.version}") as f:
            f.write(json.dumps(listed).encode())
        files.move(f"{root}/{LIST}.{self.version}", f"{root}/{LIST}")
        if self.overwrite and old is not None:
            for folder in {e["file"].split("/")[0] for e in old["files"]} - {e["file"].split("/")[0] for e in new}:
                with contextlib.suppress(OSError):
                    files.delete_dir(f"{root}/{folder}")

    def abort(self, messages: list[Saved | None]) -> None:
        files, root = _place(self.path)
        with contextlib.suppress(OSError):
            files.delete_dir(f"{root}/{self.version}")


class DocumentSource(DataSource):
    """Options: path; when saving key (page_id); when opening low and high, the least and greatest key wanted, and push_filters (false)."""

    @classmethod
    def name(cls) -> str:
        return "quirework"

    def _list(self) -> dict:
        if (found := current(self.options["path"])) is None:
            raise FileNotFoundError(f"no document table at {self.options['path']}")
        return found

    def schema(self) -> StructType:
        return StructType.fromJson(self._list()["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        found = self._list()
        kind = _PushingReader if self.options.get("push_filters") == "true" else _Reader
        reader = kind(self.options["path"], found["key"], found["files"], schema)
        stored = next(f["type"] for f in found["schema"]["fields"] if f["name"] == found["key"])
        told = (float if stored in ("float", "double") else int) if stored in ("byte", "short", "integer", "long", "float", "double") else str
        reader.filters = [f((found["key"],), told(self.options[o])) for o, f in (("low", GreaterThanOrEqual), ("high", LessThanOrEqual)) if o in self.options]
        return reader

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        key = self.options.get("key", "page_id")
        if key not in schema.fieldNames():
            raise ValueError(f"the key {key} is no column of what is saved")
        if not overwrite and (old := current(self.options["path"])) is not None and (old["key"] != key or StructType.fromJson(old["schema"]).simpleString() != schema.simpleString()):
            raise ValueError("rows of another schema or key can't be appended")
        return _Writer(self.options["path"], key, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session."""
    spark.dataSource.register(DocumentSource)


def saved(rows: DataFrame, path: str, key: str = "page_id", mode: str = "overwrite") -> DataFrame:
    """Saves rows, dealt out by ranges of the key, and opens what was saved."""
    register(rows.sparkSession)
    rows.repartitionByRange(key).sortWithinPartitions(key).write.format("quirework").mode(mode).option("key", key).save(path)
    return opened(rows.sparkSession, path)


def opened(spark: SparkSession, path: str, low: object = None, high: object = None, push_filters: bool = False) -> DataFrame:
    """The table in a folder, or its rows with keys from low to high, both included. push_filters: see above; turns Spark's setting for it on."""
    register(spark)
    options = {k: str(v) for k, v in (("low", low), ("high", high)) if v is not None}
    if push_filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        options["push_filters"] = "true"
    return spark.read.format("quirework").options(**options).load(path)
