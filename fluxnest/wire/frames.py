"""Messages in DataFrames: decoding and encoding of byte columns, merging at ingest, and framed files."""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schema.proto import MessageDef, Registry, SchemaError, struct_type
from . import columnar
from .arrays import to_values
from .codec import Codec, WireError
from .vector import VectorDecoder, decode_halving


class RecordType:
    """A message type bound to its Spark schema. needed limits decoding to some top-level fields."""

    def __init__(self, reg: Registry, message: MessageDef, flatten: bool = False, needed: set[str] | None = None):
        if needed is not None:
            message = MessageDef(message.name, tuple(f for f in message.fields if f.name in needed))
        self.reg, self.message, self.flatten = reg, message, flatten
        self.schema = struct_type(reg, message, flatten)

    @classmethod
    def from_proto(cls, path: str, message: str, import_paths: list[str] | None = None, **options) -> "RecordType":
        from ..schema.proto import compile_proto

        reg = compile_proto(path, import_paths or [])
        return cls(reg, reg.lookup(message), **options)

    @property
    def field_names(self) -> list[str]:
        return self.schema.fieldNames()

    def _decoder(self, runtime: bool):
        """A function of (byte array, strict) that gives the struct array and why those that are null are."""
        reg, message, flatten, kind = self.reg, self.message, self.flatten, to_arrow_type(self.schema)
        codec = Codec(reg, message, flatten)

        def by_rows(blobs: list[bytes | None], strict: bool) -> tuple[pa.Array, list[str | None]]:
            rows, why = [], []
            for raw in blobs:
                try:
                    rows.append(None if raw is None else codec.decode(raw))
                    why.append(None)
                except WireError as e:
                    if strict:
                        raise
                    rows.append(None)
                    why.append(str(e))
            return pa.array(rows, kind), why

        if not runtime:
            return lambda blobs, strict: by_rows(blobs.to_pylist(), strict)
        fast = VectorDecoder(reg, message, flatten)
        return lambda blobs, strict: decode_halving(blobs, fast, by_rows, strict)

    def decode(self, df: DataFrame, column: str, out: str = "msg", strict: bool = True, runtime: bool = True) -> DataFrame:
        """df with the struct out in place of the byte column. runtime=False decodes message by message.

        Null bytes give a null struct. In permissive mode bytes that are no message give a null struct and their
        reason in _corrupt; in strict mode they raise.
        """
        keep = [c for c in df.columns if c != column]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            decode = self._decoder(runtime)
            for b in batches:
                rows, why = decode(b.column(b.num_columns - 1), strict)
                cols = [*b.columns[:-1], rows] + ([] if strict else [pa.array(why, pa.string())])
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, out] + ([] if strict else ["_corrupt"]))

        schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, self.schema)] + ([] if strict else [T.StructField("_corrupt", T.StringType())]))
        return df.select(*keep, column).mapInArrow(run, schema)

    def encode(self, df: DataFrame, column: str, out: str = "payload") -> DataFrame:
        """df with the bytes out in place of the struct column; null structs give null. Row subsets are a filter before."""
        reg, message, flatten = self.reg, self.message, self.flatten
        keep = [c for c in df.columns if c != column]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fast = columnar.available() and columnar.plain(reg, message, flatten)
            codec = columnar.PlainEncoder(reg, message, flatten) if fast else Codec(reg, message, flatten)
            for b in batches:
                blobs = [None if r is None else codec.encode(r) for r in to_values(b.column(b.num_columns - 1))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(blobs, pa.binary())], names=[*keep, out])

        return df.select(*keep, column).mapInArrow(run, T.StructType([*df.select(*keep).schema.fields, T.StructField(out, T.BinaryType())]))

    def merged(self, custom: "RecordType") -> T.StructType:
        if clash := set(self.field_names) & set(custom.field_names):
            raise SchemaError(f"both messages have {', '.join(sorted(clash))}")
        return T.StructType(self.schema.fields + custom.schema.fields)


def decode_merged(df: DataFrame, base: RecordType, base_column: str, custom: RecordType, custom_column: str, out: str = "msg", strict: bool = True) -> DataFrame:
    """Two byte columns as one struct with the fields of both messages, in one pass; null bytes give null fields."""
    kind = base.merged(custom)
    keep = [c for c in df.columns if c not in (base_column, custom_column)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, arrow = base._decoder(True), custom._decoder(True), to_arrow_type(kind)
        for b in batches:
            (x, why), (y, more) = first(b.column(b.num_columns - 2), strict), second(b.column(b.num_columns - 1), strict)
            rows = pa.StructArray.from_arrays([*x.flatten(), *y.flatten()], fields=[arrow.field(i) for i in range(arrow.num_fields)])
            cols = [*b.columns[:-2], rows] + ([] if strict else [pa.array([p or q for p, q in zip(why, more)], pa.string())])
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, out] + ([] if strict else ["_corrupt"]))

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, kind)] + ([] if strict else [T.StructField("_corrupt", T.StringType())]))
    return df.select(*keep, base_column, custom_column).mapInArrow(run, schema)


def retag(blob: bytes, numbers: dict[int, int]) -> bytes:
    """Rewrite top-level field numbers of a message; nested bytes stay as they are."""
    from .codec import read_varint, skip, write_varint

    out, at = bytearray(), 0
    while at < len(blob):
        tag, body = read_varint(blob, at)
        end = skip(blob, body, tag & 7)
        out += write_varint(numbers.get(tag >> 3, tag >> 3) << 3 | tag & 7) + blob[body:end]
        at = end
    return bytes(out)


def retag_column(df: DataFrame, column: str, numbers: dict[int, int]) -> DataFrame:
    """df with the top-level field numbers of a byte column rewritten; null bytes stay null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [None if x is None else retag(x, numbers) for x in b.column(column).to_pylist()]
            yield b.set_column(b.schema.get_field_index(column), column, pa.array(blobs, b.schema.field(column).type))

    return df.mapInArrow(run, df.schema)


#: Bytes of a framed file that one task reads, about.
PART = 64 << 20
#: Tasks that read framed files at most; with more parts a task reads several.
TASKS = 100_000


def _file(path: str):
    """(file system, path) of an address in the shared folder."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_framed(df: DataFrame, column: str, path: str, part: int = PART) -> int:
    """Write a byte column as framed files, one a task, each with an index of offsets beside it; null bytes are left out. Returns the number of messages.

    A task writes under a name of its own; the driver moves only the files of tasks that counted, so tasks may run twice.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file(path)
        system.create_dir(root, recursive=True)
        name, n, at, marks = f"_{uuid.uuid4().hex}", 0, 0, [(0, 0)]
        with system.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                for x in b.column(0).to_pylist():
                    if x is not None:
                        out.write(struct.pack("<I", len(x)) + x)
                        at, n = at + 4 + len(x), n + 1
                        if at - marks[-1][0] >= part:
                            marks.append((at, n))
        with system.open_output_stream(f"{root}/{name}.index") as out:
            out.write(json.dumps([*marks, (at, n)]).encode())
        yield pa.RecordBatch.from_pydict({"name": [name], "n": [n]})

    done = df.select(column).mapInArrow(run, "name string, n bigint").collect()  # one row a task
    system, root = _file(path)
    for i, r in enumerate(done):
        system.move(f"{root}/{r.name}.index", f"{root}/_part-{i:05d}.index")
        system.move(f"{root}/{r.name}", f"{root}/part-{i:05d}")
    return sum(r.n for r in done)


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, payload) of files of length-prefixed messages: a 32-bit little-endian length, then so many bytes. A cut-off file raises.

    A file with an index is read in parts by several tasks, one without by one task, as a stream, whatever its size.
    """

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, at = _file(file)
                folder, _, name = at.rpartition("/")
                index = f"{folder}/_{name}.index"
                marks = [(0, 0), (length, None)]
                if system.get_file_info(index).type == fs.FileType.File:
                    with system.open_input_stream(index) as f:
                        marks = json.loads(f.read())
                rows += [(file, x[0], y[0], x[1]) for x, y in zip(marks, marks[1:]) if y[0] > x[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "start", "stop", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at, stop, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                system, name = _file(file)
                with system.open_input_file(name) as f:
                    f.seek(at)
                    source = io.BufferedReader(f, 1 << 20)
                    while at < stop:
                        rows, size = [], 0
                        while at < stop and len(rows) < 1000 and size < 1 << 24:
                            head = source.read(4)
                            if len(head) < 4:
                                raise WireError(f"{file}: cut-off length")
                            (length,) = struct.unpack("<I", head)
                            blob = source.read(length)
                            if len(blob) < length:
                                raise WireError(f"{file}: cut-off message")
                            rows.append(blob)
                            at, size = at + 4 + length, size + length
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(range(n, n + len(rows)), pa.int64()), pa.array(rows, pa.binary())], names=["file", "n", "payload"])
                        n += len(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    split = files.mapInArrow(parts, "file string, start bigint, stop bigint, n bigint")
    # As many tasks as parts: a number of its own keeps adaptive execution from joining these short rows into one task.
    return split.repartition(max(1, min(split.count(), TASKS))).mapInArrow(run, "file string, n bigint, payload binary")


def frame(blobs: Iterable[bytes]) -> bytes:
    """The framed form of messages."""
    return b"".join(struct.pack("<I", len(b)) + b for b in blobs)
