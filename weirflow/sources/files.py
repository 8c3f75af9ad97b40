"""Files: CSV, TSV, JSON, Parquet and Excel."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AdapterError
from ..functions.frames import ORDER, col, nan_to_null, ordered
from ..registry import register_adapter
from . import excel
from .base import Adapter, LoadMode, LoadResult, WriteRequest, newer_than

_FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "excel": "excel", "xlsx": "excel", "xls": "excel"}
#: Names of options of data-frame readers, in Spark's terms.
_OPTIONS = {"sep": "sep", "delimiter": "sep", "encoding": "encoding", "quotechar": "quote", "escapechar": "escape", "comment": "comment", "na_values": "nullValue", "lines": None, "orient": None, "index": None}


@register_adapter("file")
class FileAdapter(Adapter):
    """``params``: format, path, options. Modes: replace and append.

    NaN is missing, as null is. That costs the pushing of filters on floating columns to the scan;
    ``options: {nan_as_null: false}`` leaves columns as they are where a file holds no NaN.
    """

    def __init__(self, resource, spark=None):
        super().__init__(resource, spark)
        name = str(self.params.get("format", "")).lower()
        if name not in _FORMATS:
            raise AdapterError(f"resource {resource.name!r}: unknown format {name!r}; known: {', '.join(sorted(_FORMATS))}")
        self.format, self.path, self.options = _FORMATS[name], self.params.get("path"), dict(self.params.get("options") or {})
        if not self.path:
            raise AdapterError(f"resource {resource.name!r}: a path is needed")

    # -- paths, through Spark's file systems
    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def has_table(self, collection: str | None = None) -> bool:
        return self._exists(self.path)

    def _spark_options(self) -> dict[str, Any]:
        out = {}
        for key, value in self.options.items():
            target = _OPTIONS.get(key, key)
            if target and key not in ("dtype", "usecols", "schema", "skiprows", "nrows", "nan_as_null"):
                out[target] = value[0] if isinstance(value, list) and value else value
        return out

    # -- reading
    def _read(self, collection: str | None, since: tuple[str, Any] | None) -> DataFrame:
        if self.format == "excel":
            if not collection:
                raise AdapterError("an Excel source needs a collection (the sheet)")
            df = excel.read_sheet(self.spark, self.path, collection)
        else:
            if not self._exists(self.path) and not re.search(r"[*?\[{]", self.path):
                raise AdapterError(f"{self.path} doesn't exist")
            df = {"csv": self._text, "tsv": self._text, "json": self._json}.get(self.format, self._columnar)()
        if self.options.get("usecols"):
            df = df.select(*map(col, self.options["usecols"]))
        return newer_than(nan_to_null(df) if self.options.get("nan_as_null", True) else df, since)

    def _numbered(self, frame: DataFrame) -> DataFrame:
        """Parquet rows by their place in the file, and files by their part number (else by a hash
        of the name). Unlike a running number this doesn't keep filters from the scan."""
        if self.format != "parquet":
            return ordered(frame)
        name = F.col("_metadata.file_name")
        part = F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint"), F.xxhash64(name))
        return frame.withColumn(ORDER, F.pmod(part, F.lit(1 << 18)) * F.lit(1 << 34) + F.col("_metadata.row_index"))

    def _columnar(self) -> DataFrame:
        return self.spark.read.options(**self._spark_options()).format(self.format).load(self.path)

    def _text(self) -> DataFrame:
        reader = self.spark.read.option("header", True).option("enforceSchema", False)
        if self.format == "tsv":
            reader = reader.option("sep", "\t")
        if self.options.get("schema"):
            reader = reader.schema(self.options["schema"])
        else:
            reader = reader.option("inferSchema", True)
        df = reader.options(**self._spark_options()).csv(self.path)
        kinds = self.options.get("dtype") or {}
        kinds = dict.fromkeys(df.columns, kinds) if isinstance(kinds, str) else kinds
        names = {"str": "string", "object": "string", "int": "bigint", "int64": "bigint", "float": "double", "float64": "double", "bool": "boolean"}
        wanted = {c: names.get(str(k).lower(), str(k)) for c, k in kinds.items() if c in df.columns}
        if wanted and not self.options.get("schema"):  # types are read, not cast: leading zeros stay
            schema = T.StructType([T.StructField(f.name, T.StringType() if wanted.get(f.name) == "string" else f.dataType) for f in df.schema])
            df = self.spark.read.option("header", True).schema(schema).options(**({"sep": "\t"} if self.format == "tsv" else {}) | self._spark_options()).csv(self.path)
        out = df
        for f in df.schema:  # whole numbers are long, times have no zone
            if f.name in wanted:
                out = out.withColumn(f.name, col(f.name).cast(wanted[f.name]))
            elif isinstance(f.dataType, T.IntegerType):
                out = out.withColumn(f.name, col(f.name).cast("bigint"))
            elif isinstance(f.dataType, T.TimestampType):
                out = out.withColumn(f.name, col(f.name).cast("timestamp_ntz"))
        return out

    def _json(self) -> DataFrame:
        """Lines, an array of records, or an object whose first list holds the records."""
        head = self.spark.read.text(self.path).where(F.length(F.trim("value")) > 0).limit(2).collect()
        if not head:
            return self.spark.createDataFrame([], T.StructType([]))
        first = head[0]["value"].strip()
        lines = first.startswith("{") and first.endswith("}") and (len(head) == 1 or head[1]["value"].strip().startswith("{"))
        reader = self.spark.read.options(**self._spark_options())
        if lines and len(head) > 1:
            return reader.json(self.path)
        df = reader.option("multiLine", True).json(self.path)
        if first.startswith("["):
            return df
        for name in self._keys(first, df.columns):
            kind = df.schema[name].dataType
            if isinstance(kind, T.ArrayType):
                rows = df.select(F.explode(col(name)).alias("r"))
                return rows.select("r.*") if isinstance(kind.elementType, T.StructType) else rows.withColumnRenamed("r", name)
        return df

    @staticmethod
    def _keys(first: str, names: list[str]) -> list[str]:
        """Names in the order of the document's start; others after them."""
        return sorted(names, key=lambda n: (first.find(f'"{n}"') if f'"{n}"' in first else len(first), n))

    # -- writing
    def _write_batch(self, requests: Sequence[WriteRequest]) -> list[LoadResult]:
        for r in requests:
            if r.mode not in (LoadMode.REPLACE, LoadMode.APPEND):
                raise AdapterError(f"files can't be written in mode {r.mode}")
            if r.partition_by and self.format == "excel":
                raise AdapterError("sheets have no partitions")
        return [self._write(r) for r in requests]

    def _write(self, r: WriteRequest) -> LoadResult:
        there = self._exists(self.path)
        if self.format == "excel":
            n = excel.write_sheet(self.spark, self.path, r.collection or "Sheet1", r.frame, append=r.mode is LoadMode.APPEND)
            return LoadResult(r.collection or "", r.mode, n, n, created_table=not there)
        frame = r.frame
        if r.mode is LoadMode.APPEND and there:
            frame = self._aligned(frame)
        from pyspark.sql import Observation

        seen = Observation()
        frame = frame.observe(seen, F.count(F.lit(1)).alias("n"))
        if r.partition_by and r.mode is LoadMode.REPLACE and there and self.format in ("parquet", "orc"):
            # only the partitions that occur are replaced
            frame.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*r.partition_by).format(self.format).save(self.path)
        else:
            self._publish(frame, r, there)
        n = seen.get["n"]
        return LoadResult(r.collection or "", r.mode, n, n, created_table=not there)

    def _aligned(self, frame: DataFrame) -> DataFrame:
        """The frame in the columns that are there already, by name."""
        now = self._read(None, None)
        extra = [c for c in frame.columns if c not in now.columns]
        if extra and self.format in ("csv", "tsv"):
            raise AdapterError(f"append: columns {', '.join(extra)} aren't in {self.path}")
        return frame.select(*(col(f.name).cast(f.dataType).alias(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema), *map(col, extra))

    def _publish(self, frame: DataFrame, r: WriteRequest, there: bool) -> None:
        """Writes beside the target and renames, so readers never see half a file."""
        stage = f"{self.path.rstrip('/')}.stage-{uuid.uuid4().hex}"
        writer = frame.write.partitionBy(*r.partition_by) if r.partition_by else frame.write
        if self.format in ("csv", "tsv"):
            options = {"header": True} | ({"sep": "\t"} if self.format == "tsv" else {}) | self._spark_options()
            writer.options(**options).csv(stage)
        elif self.format == "json":
            writer.option("ignoreNullFields", False).json(stage)
        else:
            writer.format(self.format).save(stage)
        fs, target = self._fs(self.path)
        _, staged = self._fs(stage)
        if r.mode is LoadMode.APPEND and there:
            if fs.getFileStatus(target).isFile():  # a single file becomes a folder with it inside
                aside = self._fs(f"{stage}-old")[1]
                fs.rename(target, aside)
                fs.mkdirs(target)
                fs.rename(aside, self._fs(f"{self.path}/part-0-{uuid.uuid4().hex}.{self.format}")[1])
            files = fs.listFiles(staged, True)
            while files.hasNext():
                at = files.next().getPath()
                if at.getName().startswith("part-"):
                    below = at.getParent().toString().split(stage.split(":", 1)[-1])[-1].strip("/")
                    folder = self._fs(f"{self.path}/{below}")[1]
                    fs.mkdirs(folder)
                    fs.rename(at, self._fs(f"{self.path}/{below}/{at.getName()}")[1])
            fs.delete(staged, True)
            return
        old = self._fs(f"{stage}-old")[1]
        if there:
            fs.rename(target, old)
        if not fs.rename(staged, target):
            if there:
                fs.rename(old, target)
            raise AdapterError(f"{self.path} couldn't be published")
        if there:
            fs.delete(old, True)
