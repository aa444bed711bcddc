"""A Python data source and sink: a folder of Arrow files that counts by its commits.

Writing: each task writes one file under a pending name; the driver's commit moves the files in and adds one numbered
list of them, by a rename, so readers see all of a write or nothing. A failed write is aborted: what its tasks left is
deleted, and nothing of it was ever listed (a task killed later may leave a pending file that nothing reads). A streaming batch that runs again finds its list and adds nothing.

Reading: one partition a file. With pushdown, comparisons of a column with a value reach the reader: files whose least and greatest
value rule it out are no partition, and rows are filtered as they are read. A stream's offset is the number of commits.

Options: path, a folder mounted on the driver and on all executors (file: or without a scheme); filters, true to push
filters down, for which spark.sql.python.filterPushdown.enabled has to be true.
"""

from __future__ import annotations

import json
import operator
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

#: The filters that are pushed down, with their comparison and whether a file of values from low to high may hold a row.
_PUSHED = {
    ds.EqualTo: (pc.equal, lambda low, high, v: low <= v <= high),
    ds.GreaterThan: (pc.greater, lambda low, high, v: high > v),
    ds.GreaterThanOrEqual: (pc.greater_equal, lambda low, high, v: high >= v),
    ds.LessThan: (pc.less, lambda low, high, v: low < v),
    ds.LessThanOrEqual: (pc.less_equal, lambda low, high, v: low <= v),
}


@dataclass
class Wrote(ds.WriterCommitMessage):
    file: str
    rows: int
    least: dict
    greatest: dict


class _File(ds.InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def _folder(options: dict) -> str:
    path = options["path"]
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"a mounted folder is needed: {path}")
    return path


def commits(folder: str) -> list[int]:
    at = os.path.join(folder, "commits")
    return sorted(int(f[:-5]) for f in os.listdir(at) if f.endswith(".json")) if os.path.isdir(at) else []


def _listed(folder: str, numbers: list[int]) -> list[dict]:
    found = []
    for n in numbers:
        with open(os.path.join(folder, "commits", f"{n}.json")) as f:
            found += json.load(f)
    return found


def _batches(path: str) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_file(path) as f:
        for i in range(f.num_record_batches):
            yield f.get_batch(i)


class Ledger(ds.DataSource):
    """spark.read, write, readStream or writeStream .format("ledger") with the option path."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> StructType:
        with open(os.path.join(_folder(self.options), "schema.json")) as f:
            return StructType.fromJson(json.load(f))

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return (FilteringReader if self.options.get("filters", "false").lower() == "true" else LedgerReader)(_folder(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceWriter:
        return LedgerWriter(_folder(self.options), schema, overwrite)

    def streamReader(self, schema: StructType) -> ds.DataSourceStreamReader:  # noqa: N802
        return LedgerStream(_folder(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> ds.DataSourceStreamWriter:  # noqa: N802
        return LedgerStreamWriter(_folder(self.options), schema, overwrite)


class LedgerReader(ds.DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.pushed = folder, []

    def _tests(self) -> list[tuple]:
        return [(*_PUSHED[getattr(ds, kind)], column, value) for kind, column, value in self.pushed]

    def partitions(self) -> list[ds.InputPartition]:
        files = _listed(self.folder, commits(self.folder))
        may = lambda f: all(c in f["least"] and holds(f["least"][c], f["greatest"][c], v) for _, holds, c, v in self._tests())
        return [_File(os.path.join(self.folder, f["file"])) for f in files if f["rows"] and may(f)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        for batch in _batches(partition.value) if partition.value else ():
            for compare, _, column, value in self._tests():
                batch = batch.filter(compare(batch.column(batch.schema.get_field_index(column)), value))
            if batch.num_rows:
                yield batch


class FilteringReader(LedgerReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _PUSHED and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.pushed.append((type(f).__name__, f.attribute[0], f.value))
            else:
                yield f


class _Writing:
    """What the batch and the streaming writer share."""

    def __init__(self, folder: str, schema: StructType, overwrite: bool):
        self.folder, self.kinds, self.overwrite, self.run = folder, schema.jsonValue(), overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        pending = os.path.join(self.folder, "pending", self.run)
        os.makedirs(pending, exist_ok=True)
        file, out, rows, least, greatest = os.path.join(pending, f"{uuid.uuid4().hex}.arrow"), None, 0, {}, {}
        for batch in self._kept(batches, file):
            out = out or pa.ipc.new_file(file, batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
            for column, kind in zip(batch.schema.names, batch.schema.types, strict=True):
                if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind):
                    ends = pc.min_max(batch.column(column)).as_py()
                    for held, value, better in ((least, ends["min"], operator.lt), (greatest, ends["max"], operator.gt)):
                        if value is not None and (column not in held or better(value, held[column])):
                            held[column] = value
        if out:
            out.close()
        return Wrote(file if out else "", rows, least, greatest)

    @staticmethod
    def _kept(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
        """The batches; a task whose input fails deletes its file."""
        try:
            yield from batches
        except BaseException:
            if os.path.exists(file):
                os.remove(file)
            raise

    def _publish(self, messages: list, number: int) -> None:
        os.makedirs(os.path.join(self.folder, "commits"), exist_ok=True)
        with open(os.path.join(self.folder, "schema.json.new"), "w") as f:
            json.dump(self.kinds, f)
        os.replace(f.name, os.path.join(self.folder, "schema.json"))
        files = []
        for m in messages:
            if m is not None and m.file:
                name = os.path.basename(m.file)
                os.replace(m.file, os.path.join(self.folder, name))
                files.append({"file": name, "rows": m.rows, "least": m.least, "greatest": m.greatest})
        with open(os.path.join(self.folder, "commits", f"{number}.new"), "w") as f:
            json.dump(files, f)
        os.replace(f.name, os.path.join(self.folder, "commits", f"{number}.json"))
        self._clear(messages)

    def _clear(self, messages: list) -> None:
        """Deletes what the tasks left pending; a stream's tasks wrote under another run than the driver's."""
        for run in {os.path.dirname(m.file) for m in messages if m is not None and m.file} | {os.path.join(self.folder, "pending", self.run)}:
            shutil.rmtree(run, ignore_errors=True)


class LedgerWriter(_Writing, ds.DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        before = commits(self.folder)
        old = _listed(self.folder, before) if self.overwrite else []
        self._publish(messages, before[-1] + 1 if before else 0)
        if self.overwrite:
            for n in before:
                os.remove(os.path.join(self.folder, "commits", f"{n}.json"))
            for f in old:
                os.remove(os.path.join(self.folder, f["file"]))

    def abort(self, messages: list) -> None:
        self._clear(messages)


class LedgerStreamWriter(_Writing, ds.DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        if batchId in commits(self.folder):
            self._clear(messages)  # a batch that runs again
        else:
            self._publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._clear(messages)


class LedgerStream(ds.DataSourceStreamReader):
    """Commits from the first on; an offset is the number of the next commit."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        found = commits(self.folder)
        return {"next": found[-1] + 1 if found else 0}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        numbers = [n for n in commits(self.folder) if start["next"] <= n < end["next"]]
        return [_File(os.path.join(self.folder, f["file"])) for f in _listed(self.folder, numbers)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.value) if partition.value else ()

    def commit(self, end: dict) -> None:
        pass
