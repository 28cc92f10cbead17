"""NetCDF classic files (CDF-1 and CDF-2) as a Spark data source, named netcdf3.

A row is a place along the dimension `time`; columns are the variables with that one dimension. Reading is dealt to tasks by ranges of records, of which a task reads only its
own bytes; the option `columns` leaves out others. Writing streams each task's rows into a file of its own, with time as the record dimension; a folder of files reads
as one table. Values equal to a variable's _FillValue, and nan, are null.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import cf_time

#: Fixed values of the format: type numbers with their layout in a file, Spark's type, and the value that stands for nothing.
TYPES = {1: (">i1", "tinyint", -127), 3: (">i2", "smallint", -32767), 4: (">i4", "int", -2147483647), 5: (">f4", "float", 9.969209968386869e36), 6: (">f8", "double", 9.969209968386869e36)}
CHAR, DIMENSION, VARIABLE, ATTRIBUTE, STREAMING = 2, 10, 11, 12, 0xFFFFFFFF
ROWS, HEADER = 1 << 18, 1 << 16
EPOCH = "seconds since 1970-01-01 00:00:00"


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[int, ...]
    kind: int
    attributes: dict
    begin: int

    @property
    def layout(self) -> np.dtype:
        return np.dtype(TYPES[self.kind][0])


@dataclass(frozen=True)
class Header:
    records: int | None  # None: as many as the file holds
    dims: tuple[tuple[str, int], ...]
    attributes: dict
    variables: tuple[Variable, ...]

    def along(self, dimension: str = "time") -> list[Variable]:
        """Numeric variables over that dimension alone."""
        return [v for v in self.variables if v.kind in TYPES and len(v.dims) == 1 and self.dims[v.dims[0]][0] == dimension]

    def record_layout(self) -> tuple[int, dict[str, int]]:
        """Bytes of a record, and each record variable's place in it. Slabs are padded to four bytes unless there is only one."""
        own = [v for v in self.variables if v.dims and self.dims[v.dims[0]][1] == 0]
        size, places = 0, {}
        for v in own:
            n = 1
            for d in v.dims[1:]:
                n *= self.dims[d][1]
            width = n * (1 if v.kind == CHAR else v.layout.itemsize)
            places[v.name] = size
            size += width if len(own) == 1 else -(-width // 4) * 4
        return size, places


class _Bytes:
    """The header's parts, one after the other. Runs past the end raise EOFError."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise EOFError
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, form: str = ">I") -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def name(self) -> str:
        n = self.number()
        return self.take(-(-n // 4) * 4)[:n].decode()

    def count(self, tag: int) -> int:
        found, n = self.number(), self.number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("not a NetCDF classic header")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.count(ATTRIBUTE)):
            name, kind, n = self.name(), self.number(), self.number()
            width = 1 if kind == CHAR else np.dtype(TYPES[kind][0]).itemsize
            raw = self.take(-(-n * width // 4) * 4)[: n * width]
            out[name] = raw.decode(errors="replace") if kind == CHAR else np.frombuffer(raw, TYPES[kind][0]).tolist()
        return out


def parsed(raw: bytes) -> Header:
    b = _Bytes(raw)
    magic = b.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("not a NetCDF classic file")
    records = b.number()
    dims = tuple((b.name(), b.number()) for _ in range(b.count(DIMENSION)))
    attributes, variables = b.attributes(), []
    for _ in range(b.count(VARIABLE)):
        name = b.name()
        ids = tuple(b.number() for _ in range(b.number()))
        own, kind, _size = b.attributes(), b.number(), b.number()
        variables.append(Variable(name, ids, kind, own, b.number(">I" if magic[3] == 1 else ">Q")))
    return Header(None if records == STREAMING else records, dims, attributes, tuple(variables))


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def header_of(path: str) -> Header:
    fs, p = _opened(path)
    with fs.open_input_file(p) as f:
        n = HEADER
        while True:
            try:
                return parsed(f.read_at(min(n, f.size()), 0))
            except EOFError:
                if n >= f.size():
                    raise ValueError("the header is cut off") from None
                n *= 4


def files_at(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of the folder's .nc files by name."""
    from pyarrow import fs as pfs

    fs, p = _opened(path)
    info = fs.get_file_info(p)
    found = [info] if info.is_file else [f for f in fs.get_file_info(pfs.FileSelector(p)) if f.is_file and f.path.endswith(".nc")]
    if not found:
        raise FileNotFoundError(path)
    root = path if info.is_file else path.rstrip("/")
    return sorted((root if info.is_file else f"{root}/{f.base_name}", f.size) for f in found)


@dataclass
class Range(InputPartition):
    path: str
    size: int
    first: int
    last: int

    def __init__(self, path: str, size: int, first: int, last: int):
        self.path, self.size, self.first, self.last = path, size, first, last


def rows_in(header: Header, size: int) -> int:
    """How many places the dimension time has."""
    own = header.along()
    if not own:
        return 0
    n = header.dims[own[0].dims[0]][1]
    if n:
        return n
    width, _ = header.record_layout()
    return header.records if header.records is not None else (size - min(v.begin for v in own)) // max(width, 1)


class Reader(DataSourceReader):
    def __init__(self, path: str, schema, rows: int):
        self.path, self.schema, self.rows = path, schema, rows

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files_at(self.path):
            n = rows_in(header_of(path), size)
            out += [Range(path, size, k, min(k + self.rows, n)) for k in range(0, n, self.rows)]
        return out

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        header, schema = header_of(partition.path), to_arrow_schema(self.schema)
        width, places = header.record_layout()
        by_name, n = {v.name: v for v in header.along()}, partition.last - partition.first
        fs, p = _opened(partition.path)
        columns, records = [], None
        with fs.open_input_file(p) as f:
            for field in schema:
                v = by_name[field.name]
                if v.name in places:
                    if records is None:
                        start = min(x.begin - places[x.name] for x in by_name.values() if x.name in places)
                        raw = f.read_at(n * width, start + partition.first * width)
                        records = np.frombuffer(raw.ljust(n * width, b"\0"), np.dtype({"names": [x for x in places if x in by_name], "formats": [by_name[x].layout for x in places if x in by_name], "offsets": [places[x] for x in places if x in by_name], "itemsize": width}))
                    values = records[v.name]
                else:
                    size = v.layout.itemsize
                    values = np.frombuffer(f.read_at(n * size, v.begin + partition.first * size), v.layout)
                values = values.astype(v.layout.newbyteorder("="))
                fill = v.attributes.get("_FillValue", [TYPES[v.kind][2]])[0]
                columns.append(pa.array(values, field.type, mask=(values == np.array(fill, values.dtype)) | (np.isnan(values) if values.dtype.kind == "f" else False)))
        if n and columns:
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    name: str | None

    def __init__(self, name: str | None):
        self.name = name


def header_bytes(names: list[str], kinds: list[int], units: dict[str, str]) -> tuple[bytes, np.dtype]:
    """A CDF-2 header with time as record dimension and as many records as will follow, and the layout of a record."""
    word = lambda n: struct.pack(">I", n)
    padded = lambda raw: word(len(raw)) + raw + b"\0" * (-len(raw) % 4)
    widths = [np.dtype(TYPES[k][0]).itemsize for k in kinds]
    slabs = widths if len(names) == 1 else [-(-w // 4) * 4 for w in widths]
    starts = np.cumsum([0, *slabs]).tolist()

    def head(begin: int) -> bytes:
        out = b"CDF\x02" + word(STREAMING) + word(DIMENSION) + word(1) + padded(b"time") + word(0) + word(0) + word(0) + word(VARIABLE) + word(len(names))
        for name, kind, slab, at in zip(names, kinds, slabs, starts, strict=False):
            fill = np.array([TYPES[kind][2]], TYPES[kind][0]).tobytes()
            own = word(ATTRIBUTE) + word(1 + (name in units)) + padded(b"_FillValue") + word(kind) + word(1) + fill + b"\0" * (-len(fill) % 4)
            own += padded(b"units") + word(CHAR) + padded(units[name].encode()) if name in units else b""
            out += padded(name.encode()) + word(1) + word(0) + own + word(kind) + word(-(-slab // 4) * 4) + struct.pack(">Q", begin + at)
        return out

    begin = len(head(0))
    return head(begin), np.dtype({"names": names, "formats": [TYPES[k][0] for k in kinds], "offsets": starts[:-1], "itemsize": starts[-1]})


class Writer(DataSourceArrowWriter):
    """Each task streams its rows into a file under a folder of this write; commit moves the files into place."""

    def __init__(self, path: str, names: list[str], kinds: list[int], units: dict[str, str], overwrite: bool):
        self.path, self.names, self.kinds, self.units, self.overwrite = path.rstrip("/"), names, kinds, units, overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex[:12]}"

    def write(self, iterator) -> Written:
        head, layout = header_bytes(self.names, self.kinds, self.units)
        fs, staging = _opened(self.staging)
        name, out = f"part-{uuid.uuid4().hex}.nc", None
        try:
            for batch in iterator:
                if out is None:
                    fs.create_dir(staging)
                    out = fs.open_output_stream(f"{staging}/{name}")
                    out.write(head)
                rows = np.zeros(batch.num_rows, layout)
                for c, kind in zip(self.names, self.kinds, strict=True):
                    rows[c] = np.where(batch[c].is_null().to_numpy(zero_copy_only=False), np.array(TYPES[kind][2], TYPES[kind][0]), batch[c].fill_null(0).to_numpy(zero_copy_only=False))
                out.write(rows.tobytes())
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages) -> None:
        fs, root = _opened(self.path)
        _, staging = _opened(self.staging)
        if self.overwrite:
            for old, _ in files_at(self.path) if fs.get_file_info(root).type.name == "Directory" and any(f.endswith(".nc") for f in self._names(fs, root)) else []:
                fs.delete_file(_opened(old)[1])
        for k, m in enumerate(m for m in messages if m is not None and m.name):
            fs.move(f"{staging}/{m.name}", f"{root}/part-{k:05d}-{m.name[5:17]}.nc")
        self.abort(messages)

    @staticmethod
    def _names(fs, root: str) -> list[str]:
        from pyarrow import fs as pfs

        return [f.base_name for f in fs.get_file_info(pfs.FileSelector(root, allow_not_found=True))]

    def abort(self, messages) -> None:
        fs, staging = _opened(self.staging)
        if fs.get_file_info(staging).type.name == "Directory":
            fs.delete_dir(staging)


class NetCDF(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        found = {v.name: TYPES[v.kind][1] for v in header_of(files_at(self.options["path"])[0][0]).along()}
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or list(found)
        if unknown := [c for c in wanted if c not in found]:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        return ", ".join(f"`{c}` {found[c]}" for c in wanted)

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("rows", ROWS)))

    def writer(self, schema, overwrite: bool) -> Writer:
        codes = {t: k for k, (_, t, _) in TYPES.items()}
        bad = [f.name for f in schema if f.dataType.simpleString() not in codes]
        if bad:
            raise ValueError(f"NetCDF classic has no type for: {', '.join(bad)}")
        units = {k[6:]: v for k, v in self.options.items() if k.startswith("units.")}
        return Writer(self.options["path"], schema.names, [codes[f.dataType.simpleString()] for f in schema], units, overwrite)


def read_netcdf(spark: SparkSession, path: str, columns: list[str] | None = None, time: str | None = "time", rows: int = ROWS) -> DataFrame:
    """The table at a path; `time`, if it is a variable with units, as timestamps."""
    spark.dataSource.register(NetCDF)
    r = spark.read.format("netcdf3").option("path", path).option("rows", rows)
    df = (r.option("columns", ",".join(columns)) if columns else r).load()
    units = {v.name: v.attributes.get("units") for v in header_of(files_at(path)[0][0]).along()}
    if time in df.columns and units.get(time):
        df = df.withColumn(time, cf_time(f"`{time}`", units[time]))
    return df


def write_netcdf(df: DataFrame, path: str, time: str | None = "time", mode: str = "append") -> None:
    """A folder of files, one a task that has rows. Timestamps in `time` become seconds since 1970; other columns must be of a type that the format has (longs and decimals: cast them)."""
    df.sparkSession.dataSource.register(NetCDF)
    w = df.write.format("netcdf3").mode(mode).option("path", path)
    if time in df.columns and dict(df.dtypes)[time].startswith("timestamp"):
        w = df.withColumn(time, F.unix_micros(F.col(time).cast("timestamp")) / 1e6).write.format("netcdf3").mode(mode).option("path", path).option(f"units.{time}", EPOCH)
    w.save()
