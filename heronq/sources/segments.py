"""A connector in Python with a committing writer and filters that prune: a table as Parquet segments under a manifest.

A writing task makes one segment and reports its name and the range of the key column. Only the driver's commit makes segments
visible, by moving a manifest into place that names them, so a failed task or job leaves no rows, and a task tried again
none twice; an abort deletes what was reported. A reader takes the newest manifest, leaves out the segments whose key range no pushed
filter can meet, and reads each of the others in a task of its own; the engine applies all filters again.

Options: path (a folder that driver and executors share, as a URI); to write, key (a column whose values have an order); to read,
pushdown ("true" where spark.sql.python.filterPushdown.enabled is). Rows with a null
key are in segments like others: a segment of null keys alone has no range and meets no filter on the key.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "heronq_segments"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int = 0
    low: object = None
    high: object = None


class Segment(InputPartition):
    def __init__(self, name: str):
        self.name = name


def manifest(path: str) -> dict | None:
    """The newest manifest of a table, or None."""
    files, root = fs.FileSystem.from_uri(path)
    found = [f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("manifest-")]
    if not found:
        return None
    with files.open_input_file(max(found)) as f:
        return json.loads(f.read())


class SegmentWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.key, self.schema, self.overwrite = options["path"], options.get("key"), schema.json(), overwrite

    def write(self, batches) -> Written:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root)
        out, said = None, Written(None)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                said.name = f"segment-{uuid.uuid4().hex}.parquet"
                out = pq.ParquetWriter(posixpath.join(root, said.name), b.schema, filesystem=files)
            out.write_batch(b)
            said.rows += b.num_rows
            if self.key:
                ends = pc.min_max(b.column(b.schema.get_field_index(self.key)))
                for v, better in ((ends["min"].as_py(), min), (ends["max"].as_py(), max)):
                    side = "low" if better is min else "high"
                    if v is not None:
                        setattr(said, side, v if getattr(said, side) is None else better(getattr(said, side), v))
        if out is not None:
            out.close()
        return said

    def commit(self, messages) -> None:
        before = manifest(self.path)
        held = [] if self.overwrite or before is None else before["segments"]
        number = 0 if before is None else before["number"] + 1
        new = [[m.name, m.rows, m.low, m.high] for m in messages if m is not None and m.name]
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root)
        hidden = posixpath.join(root, f"_{uuid.uuid4().hex}")
        with files.open_output_stream(hidden) as f:
            f.write(json.dumps({"number": number, "schema": self.schema, "key": self.key, "segments": held + new}).encode())
        files.move(hidden, posixpath.join(root, f"manifest-{number:012d}.json"))

    def abort(self, messages) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                files.delete_file(posixpath.join(root, m.name))


#: Whether a segment whose keys go from low to high may have a row that a filter takes.
MAY_MEET = {
    EqualTo: lambda f, low, high: low <= f.value <= high,
    GreaterThan: lambda f, low, high: high > f.value,
    GreaterThanOrEqual: lambda f, low, high: high >= f.value,
    LessThan: lambda f, low, high: low < f.value,
    LessThanOrEqual: lambda f, low, high: low <= f.value,
    In: lambda f, low, high: any(low <= v <= high for v in f.value if v is not None),
}


class SegmentReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.pushed = path, []

    def partitions(self):
        known = manifest(self.path)
        kept = [s for s in (known["segments"] if known else []) if all(s[2] is not None and MAY_MEET[type(f)](f, s[2], s[3]) for f in self.pushed)]
        return [Segment(s[0]) for s in kept]

    def read(self, segment):
        if segment is None:  # how the engine asks where there are no partitions
            return
        files, root = fs.FileSystem.from_uri(self.path)
        for b in pq.ParquetFile(posixpath.join(root, segment.name), filesystem=files).iter_batches():
            yield b


class PruningReader(SegmentReader):
    """For sessions that push filters to Python sources; others refuse a reader that asks for them."""

    def pushFilters(self, filters):
        known = manifest(self.path)
        for f in filters:
            if type(f) in MAY_MEET and known is not None and f.attribute == (known["key"],):
                self.pushed.append(f)
            yield f  # segments hold other rows too: the engine filters again


class SegmentSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        known = manifest(self.options["path"])
        if known is None:
            raise ValueError(f"no table at {self.options['path']}")
        return StructType.fromJson(json.loads(known["schema"]))

    def reader(self, schema):
        return (PruningReader if self.options.get("pushdown") == "true" else SegmentReader)(self.options["path"])

    def writer(self, schema, overwrite):
        return SegmentWriter(self.options, schema, overwrite)
