"""One object for a message type: decoding, merging, flattening, pipelines, Parquet and encoding, all DataFrame to DataFrame."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .functions import exprs
from .path.syntax import Field, parse_path
from .pipeline.run import pipeline
from .plans.config import Config, parse_config
from .plans.denorm import Col, DenormPlan, columns
from .schema import proto as p
from .sources.files import read_parquet, write_parquet
from .wire.frames import RecordType, decode_merged


class Transcoder:
    """A message type with, where given, an extension message and a flattening plan. It holds no data and may be shared.

    custom is the extension (a file or a registry's message); prune drops fields of empty messages; flatten gives
    well-known messages simple types.
    """

    def __init__(self, reg: p.Registry, message: p.MessageDef, *, custom: RecordType | None = None, custom_file: tuple[str, str] | None = None, denorm: list[Col] | None = None, prune: bool = False, flatten: bool = False):
        if custom is not None and custom_file is not None:
            raise p.ExclusiveOptionsError("give the custom message as a type or as a file, not as both")
        if prune:
            reg, message = p.prune_empty(reg, message)
        if custom_file is not None:
            custom = RecordType.from_proto(custom_file[0], custom_file[1], flatten=flatten)
        self.base, self.custom = RecordType(reg, message, flatten), custom
        struct = self.base.merged(custom) if custom else self.base.schema
        self.row = T.StructType([T.StructField("msg", struct)])
        self.plan = DenormPlan(self.row, [self._enums(c) for c in denorm], "msg", message=message.name if not custom else None) if denorm else None

    @classmethod
    def from_proto_file(cls, path: str, message: str, import_paths: list[str] | None = None, denorm_columns: list[str | Col] | None = None, **options) -> "Transcoder":
        reg = p.compile_proto(path, import_paths or [])
        return cls(reg, reg.lookup(message), denorm=columns(*denorm_columns) if denorm_columns else None, **options)

    @classmethod
    def from_config(cls, path: str, **options) -> "Transcoder":
        with open(path) as f:
            return cls.from_config_string(f.read(), os.path.dirname(os.path.abspath(path)), **options)

    @classmethod
    def from_config_string(cls, text: str, folder: str = ".", sources: dict[str, str] | None = None, **options) -> "Transcoder":
        """From YAML; files and import paths are relative to folder. sources holds the text of files that needn't exist."""
        c: Config = parse_config(text)
        at = lambda x: x if os.path.isabs(x) else os.path.join(folder, x)

        def compiled(ref) -> p.Registry:
            return p.parse_proto(sources[ref.file]) if ref.file in (sources or {}) else p.compile_proto(at(ref.file), [at(i) for i in ref.import_paths])

        reg = compiled(c.proto)
        if c.custom_message:
            other = compiled(c.custom_message)
            options["custom"] = RecordType(other, other.lookup(c.custom_message.message))
        return cls(reg, reg.lookup(c.proto.message), denorm=c.columns, **options)

    def _enums(self, c: Col) -> Col:
        """Fill in the names of enum_name calls from the schema."""

        def fill(e: exprs.Expr) -> exprs.Expr:
            if not isinstance(e, exprs.Call):
                return e
            e = replace(e, args=tuple(map(fill, e.args)))
            if e.func == "enum_name" and "names" not in e.params and isinstance(e.args[0], exprs.PathRef):
                names = [s.name for s in parse_path(e.args[0].path).steps if isinstance(s, Field)]
                return replace(e, params={**e.params, "names": p.enum_names(self.base.reg, self.base.message, names)})
            return e

        return c if c.expr is None else replace(c, expr=fill(c.expr))

    # ---- shapes

    @property
    def schema(self) -> T.StructType:
        return self.row["msg"].dataType

    @property
    def field_names(self) -> list[str]:
        return self.schema.fieldNames()

    def denorm_schema(self, spark: SparkSession) -> T.StructType:
        return self._planned().output_schema(spark.createDataFrame([], self.row))

    def fingerprint(self) -> str:
        return p.fingerprint(self.base.reg, self.base.message)

    def _planned(self) -> DenormPlan:
        if self.plan is None:
            raise p.SchemaError("this transcoder has no flattening plan")
        return self.plan

    # ---- data

    def decode(self, df: DataFrame, column: str = "payload", custom_column: str | None = None, strict: bool = True) -> DataFrame:
        """The nested rows of a byte column, or of a message column and its extension's column."""
        if custom_column is not None:
            if self.custom is None:
                raise p.SchemaError("this transcoder has no custom message")
            return decode_merged(df, self.base, column, self.custom, custom_column, "msg", strict)
        return self.base.decode(df, column, "msg", strict)

    def denorm(self, df: DataFrame, column: str = "payload", custom_column: str | None = None) -> DataFrame:
        """The flat rows of raw messages."""
        return self._planned().apply(self.decode(df, column, custom_column))

    def denorm_decoded(self, df: DataFrame) -> DataFrame:
        """The flat rows of nested rows under msg."""
        return self._planned().apply(df)

    def pipeline(self, df: DataFrame, program: str, keep: list[str] | None = None, column: str = "payload") -> DataFrame:
        """A pipeline's outputs a message."""
        return pipeline(self.decode(df, column), program, keep or [], "msg")

    def encode(self, df: DataFrame, column: str = "msg") -> DataFrame:
        return self.base.encode(df, column)

    def write_parquet(self, df: DataFrame, path: str, mode: str = "errorifexists") -> None:
        """Nested rows as a file's columns."""
        write_parquet(df.select("msg.*") if df.columns == ["msg"] else df, path, mode)

    def read_parquet(self, spark: SparkSession, path: str, leaves: list[int] | None = None) -> DataFrame:
        return read_parquet(spark, path, leaves)

