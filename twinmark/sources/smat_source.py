"""``.smat`` matrices as a Spark data source: ``spark.read.format("smat")`` and ``df.write.format("smat")``.

A written matrix is a folder: ``part-00000`` holds the header line ``rows cols``, the parts behind it hold the
rows in order, and ``_layout.json`` says where each stretch of rows lies (file, first byte, last byte, first
row, rows).  A reader so knows the row number of every stretch before it reads: each stretch is one task,
each byte is read once, and what is read is checked against header and layout in the same pass.  The
folder is an ordinary text matrix to other readers; one that others wrote has no layout and is read by
``smat.read_smat``.

Options of the reader: ``path``; ``name``, the prefix of the columns (``name_0``, ``name_1`` ..., default
``value``); ``columns``, the numbers of those wanted ("0,3"; default all): only these are parsed into values.
Options of the writer: ``path``; ``sparse`` ("true" leaves values below 1e-12 out); ``stretch``, bytes of a
stretch.  The frame that is written has ``row_id`` (0, 1, ... over all tasks, in order: see ``write_matrix``)
and then its value columns.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


LAYOUT = "_layout.json"
#: Values nearer to 0 than this are left out of sparse rows.
TINY = 1e-12
#: Bytes after which a writer begins a new stretch, that is, about what one task reads.
STRETCH = 32 << 20
#: Rows of a record batch.
BATCH = 8192


def _open(path: str):
    """(file system, path on it) of a folder that the driver and all executors see."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def _layout(path: str) -> dict:
    system, root = _open(path)
    with system.open_input_stream(f"{root.rstrip('/')}/{LAYOUT}") as f:
        return json.loads(f.read())


class Stretch(InputPartition):
    def __init__(self, file: str, first: int, last: int, row: int, rows: int):
        self.file, self.first, self.last, self.row, self.rows = file, first, last, row, rows


class SmatReader(DataSourceReader):
    def __init__(self, path: str, columns: list[int], names: list[str]):
        self.path, self.columns, self.names = path, columns, names

    def partitions(self):
        """One task for each stretch; the header is checked against the layout (a few bytes are read)."""
        layout = _layout(self.path)
        system, root = _open(self.path)
        with system.open_input_stream(f"{root.rstrip('/')}/part-00000.txt") as f:
            header = f.read(64).split(b"\n")[0].split()
        if [int(x) for x in header] != [layout["rows"], layout["cols"]] or sum(s[4] for s in layout["stretches"]) != layout["rows"]:
            raise ValueError(f"{self.path}: the header does not match the layout")
        return [Stretch(*s) for s in layout["stretches"]] or [Stretch("", 0, 0, 0, 0)]

    def read(self, stretch: Stretch):
        import numpy as np
        import pyarrow as pa

        if not stretch.rows:
            return
        layout = _layout(self.path)
        system, root = _open(self.path)
        with system.open_input_file(f"{root.rstrip('/')}/{stretch.file}") as f:
            f.seek(stretch.first)
            lines = f.read(stretch.last - stretch.first).split(b"\n")[:-1]
        if len(lines) != stretch.rows:
            raise ValueError(f"{self.path}/{stretch.file}: {len(lines)} rows where the layout has {stretch.rows}")
        place = {c: i for i, c in enumerate(self.columns)}
        for at in range(0, len(lines), BATCH):
            some = lines[at:at + BATCH]
            values = np.zeros((len(self.columns), len(some)))
            for r, line in enumerate(some):
                for token in line.split():
                    col, _, value = token.partition(b":")
                    c = int(col)
                    if not 0 <= c < layout["cols"]:
                        raise ValueError(f"{self.path}/{stretch.file}: column {c} of {layout['cols']} in row {stretch.row + at + r}")
                    if c in place:
                        values[place[c], r] = float(value)
            ids = np.arange(stretch.row + at, stretch.row + at + len(some))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(v) for v in values]], self.names)


class Written(WriterCommitMessage):
    def __init__(self, partition: int, file: str, stretches: list, first: int, last: int, cols: int, bad: int):
        self.partition, self.file, self.stretches, self.first, self.last, self.cols, self.bad = partition, file, stretches, first, last, cols, bad


class SmatWriter(DataSourceArrowWriter):
    def __init__(self, path: str, cols: int, sparse: bool, stretch: int):
        self.path, self.cols, self.sparse, self.stretch = path, cols, sparse, stretch

    def write(self, batches):
        """One file of this task's rows, under a name of its own, so that a task that is run again harms nothing."""
        import uuid

        import numpy as np
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        file, at, row, start, stretches, first, last, bad = f"part-{part + 1:05d}-{uuid.uuid4().hex}.txt", 0, None, 0, [], -1, -1, 0
        with system.open_output_stream(f"{root.rstrip('/')}/{file}") as f:
            begun = 0
            for batch in batches:
                ids = batch.column(0).to_numpy()
                if len(ids) and ((np.diff(ids) != 1).any() or (last >= 0 and ids[0] != last + 1)):
                    raise ValueError("row_id must go up by one")
                values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
                bad += int(sum((~np.isfinite(v)).sum() for v in values))
                for r, own in enumerate(zip(*[v.tolist() for v in values])):
                    text = " ".join(f"{c}:{x!r}" for c, x in enumerate(own) if not self.sparse or abs(x) >= TINY).encode() + b"\n"
                    f.write(text)
                    at += len(text)
                    if first < 0:
                        first, row = int(ids[0]), int(ids[0])
                        begun = row
                    last = int(ids[r])
                    if at - start >= self.stretch:
                        stretches.append([file, start, at, begun, last + 1 - begun])
                        start, begun = at, last + 1
            if at > start:
                stretches.append([file, start, at, begun, last + 1 - begun])
        return Written(part, file, stretches, first, last, len(batch.columns) - 1 if first >= 0 else self.cols, bad)

    def commit(self, messages):
        """The header and the layout, once all rows are there; rows must follow one another over all tasks."""
        system, root = _open(self.path)
        root = root.rstrip("/")
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        full, expected = [m for m in done if m.first >= 0], 0
        for m in full:
            if m.first != expected:
                raise ValueError(f"row {m.first} follows row {expected - 1}: write rows in order of row_id, from 0")
            expected = m.last + 1
        if bad := sum(m.bad for m in full):
            self.abort(messages)
            raise ValueError(f"{bad} feature values are not finite")
        for m in done:
            if m.first < 0:
                system.delete_file(f"{root}/{m.file}")
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/part-00000.txt") as f:
            f.write(f"{expected} {self.cols}\n".encode())
        with system.open_output_stream(f"{root}/{LAYOUT}") as f:
            f.write(json.dumps({"rows": expected, "cols": self.cols, "stretches": [s for m in full for s in m.stretches]}).encode())

    def abort(self, messages):
        system, root = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root.rstrip('/')}/{m.file}")


class SmatDataSource(DataSource):
    @classmethod
    def name(cls):
        return "smat"

    def _columns(self) -> list[int]:
        cols = _layout(self.options["path"])["cols"]
        wanted = [int(c) for c in self.options["columns"].split(",")] if self.options.get("columns") else list(range(cols))
        if any(not 0 <= c < cols for c in wanted):
            raise ValueError(f"columns {wanted} of a matrix of {cols}")
        return wanted

    def schema(self):
        name = self.options.get("name", "value")
        return StructType([StructField("row_id", LongType()), *[StructField(f"{name}_{c}", DoubleType()) for c in self._columns()]])

    def reader(self, schema):
        return SmatReader(self.options["path"], self._columns(), schema.fieldNames())

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a matrix is written into a new folder (mode append)")
        if schema.fields[0].name != "row_id" or any(not isinstance(f.dataType, DoubleType) for f in schema.fields[1:]):
            raise ValueError("a matrix has row_id and then double columns")
        return SmatWriter(self.options["path"], len(schema.fields) - 1, self.options.get("sparse", "false") == "true", int(self.options.get("stretch", STRETCH)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SmatDataSource)


def write_matrix(df: DataFrame, path: str, cols: list[str], sparse: bool = False, stretch: int = STRETCH) -> None:
    """(row_id, *cols) as a matrix; the range sort puts the rows in order over all tasks."""
    register(df.sparkSession)
    rows = df.select(F.col("row_id").cast("long"), *[F.col(c).cast("double") for c in cols]).repartitionByRange("row_id").sortWithinPartitions("row_id")
    rows.write.format("smat").mode("append").option("path", path).option("sparse", str(sparse).lower()).option("stretch", stretch).save()


def read_matrix(spark: SparkSession, path: str, name: str, columns: list[int] | None = None) -> DataFrame:
    """(row_id, name_0 ..); absent cells are 0."""
    register(spark)
    reader = spark.read.format("smat").option("path", path).option("name", name)
    if columns is not None:
        reader = reader.option("columns", ",".join(map(str, columns)))
    return reader.load()


def has_layout(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` was written by this source."""
    try:
        _layout(path)
        return True
    except OSError:
        return False


__all__ = ["SmatDataSource", "has_layout", "read_matrix", "register", "write_matrix"]
