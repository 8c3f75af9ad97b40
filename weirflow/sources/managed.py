"""Managed tables: Parquet folders under one root, published by numbered manifests.

A manifest lists, for each table, its schema and the folders and files that make it up. A batch
writes its folders first and then one new manifest, created exclusively: readers see all of a
batch or none, a crash leaves the last manifest standing, and of two writers at once one fails.
Appending adds a folder, so it costs what is appended. Modes that match rows first look, by the
key columns alone, which files hold matches, and write only these anew; the others stay listed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AdapterError
from ..functions.frames import col
from ..registry import LOAD_STRATEGIES, register_load_strategy
from .base import Adapter, LoadMode, LoadResult, WriteRequest, declared_types, newer_than

FLAG = "__how"


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _into(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame in a table's columns, by name; columns that it lacks are null."""
    extra = [c for c in frame.columns if c not in schema.names]
    if extra:
        raise AdapterError(f"columns {', '.join(extra)} aren't in the table")
    return frame.select(*((col(f.name).cast(f.dataType) if f.name in frame.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def _single(frame: DataFrame, key: list[str], mode: str) -> None:
    if frame.groupBy(*map(col, key)).count().where("count > 1").limit(1).count():
        raise AdapterError(f"{mode}: keys {', '.join(key)} repeat in the frame")


#: A strategy maps (target or None, request) to rows with a column FLAG: kept, inserted, updated,
#: or closed. Rows of the target that are missing from the result are deleted.
Strategy = Callable[[DataFrame | None, WriteRequest], DataFrame]


@register_load_strategy("replace")
def replace(target: DataFrame | None, r: WriteRequest) -> DataFrame:
    """The frame alone; with ``partition_by`` the other partitions stay (null is a partition)."""
    if target is None:
        return r.frame.withColumn(FLAG, F.lit("inserted"))
    new = _into(r.frame, target.schema).withColumn(FLAG, F.lit("inserted"))
    if not r.partition_by:
        return new
    parts = r.frame.select(*(col(c).alias(f"__p{k}") for k, c in enumerate(r.partition_by))).distinct()
    other = target.join(parts, _all([col(c).eqNullSafe(F.col(f"__p{k}")) for k, c in enumerate(r.partition_by)]), "left_anti")
    return other.withColumn(FLAG, F.lit("kept")).unionByName(new)


@register_load_strategy("append")
def append(target: DataFrame | None, r: WriteRequest) -> DataFrame:
    new = r.frame if target is None else _into(r.frame, target.schema)
    return new.withColumn(FLAG, F.lit("inserted"))


@register_load_strategy("upsert")
def upsert(target: DataFrame | None, r: WriteRequest) -> DataFrame:
    """Updates the frame's columns of matching rows and inserts the others. Null keys never match."""
    _single(r.frame.where(_all([col(k).isNotNull() for k in r.key])), r.key, "upsert")
    if target is None:
        return r.frame.withColumn(FLAG, F.lit("inserted"))
    new = _into(r.frame, target.schema)
    s = new.select(*(col(c).alias(f"__s{k}") for k, c in enumerate(target.columns)), F.lit(True).alias("__hit"))
    t = target.withColumn("__old", F.lit(True))
    both = t.join(s, _all([col(k) == F.col(f"__s{target.columns.index(k)}") for k in r.key]), "full_outer")  # one shuffle of each side
    hit, old = F.col("__hit").isNotNull(), F.col("__old").isNotNull()
    return both.select(
        *((F.when(hit, F.col(f"__s{k}")).otherwise(col(c)).alias(c) if c in r.frame.columns else col(c)) for k, c in enumerate(target.columns)),
        F.when(hit & old, "updated").when(hit, "inserted").otherwise("kept").alias(FLAG),
    )


@register_load_strategy("delete")
def delete(target: DataFrame | None, r: WriteRequest) -> DataFrame:
    keys = r.frame.select(*(col(k).alias(f"__k{i}") for i, k in enumerate(r.key))).distinct()
    left = target.join(keys, _all([col(k) == F.col(f"__k{i}") for i, k in enumerate(r.key)]), "left_anti")
    return left.withColumn(FLAG, F.lit("kept"))


@register_load_strategy("scd2")
def scd2(target: DataFrame | None, r: WriteRequest) -> DataFrame:
    """Type-2 history: new and changed keys get an open version, changed ones close the last."""
    start, end, flag = r.scd.effective_from, r.scd.effective_to, r.scd.current_flag
    clash = {start, end, flag} & set(r.frame.columns)
    if clash:
        raise AdapterError(f"scd2: the frame may not hold {', '.join(sorted(clash))}")
    if r.frame.where(reduce(lambda a, b: a | b, [col(k).isNull() for k in r.key])).limit(1).count():
        raise AdapterError("scd2: keys may not be null")
    _single(r.frame, r.key, "scd2")
    now = F.lit(r.effective().isoformat(sep=" ")).cast("timestamp_ntz")
    opened = r.frame.withColumns({start: now, end: F.lit(None).cast("timestamp_ntz"), flag: F.lit(True)})
    if target is None:
        return opened.withColumn(FLAG, F.lit("inserted"))
    names = target.columns
    new = _into(opened, target.schema)
    s = new.select(*(col(c).alias(f"__s{k}") for k, c in enumerate(names)), F.lit(True).alias("__hit"))
    at = lambda c: F.col(f"__s{names.index(c)}")
    current = target.where(col(flag)).withColumn("__old", F.lit(True))
    both = current.join(s, _all([col(k) == at(k) for k in r.key]), "full_outer")
    hit, old = F.col("__hit").isNotNull(), F.col("__old").isNotNull()
    changed = hit & old & ~_all([col(c).eqNullSafe(at(c)) for c in r.scd.track])
    closed = {end: F.when(changed, now).otherwise(col(end)), flag: F.when(changed, False).otherwise(col(flag))}
    last = F.struct(*(closed.get(c, col(c)).alias(c) for c in names), F.when(changed, "closed").otherwise("kept").alias(FLAG))
    first = F.struct(*(at(c).alias(c) for c in names), F.lit("inserted").alias(FLAG))
    versions = F.filter(F.array(F.when(old, last), F.when(hit & (~old | changed), first)), lambda v: v.isNotNull())
    history = target.where(~F.coalesce(col(flag), F.lit(False))).withColumn(FLAG, F.lit("kept"))
    return history.unionByName(both.select(F.explode(versions).alias("v")).select("v.*"))


def _matches(r: WriteRequest, target: DataFrame) -> tuple[list[str], Callable[[Column, Column], Column]] | None:
    """Columns that tell which rows of the target a built-in mode can change, and how they compare;
    None for modes that may change any row."""
    mode = str(r.mode)
    if LOAD_STRATEGIES.get(mode) is not {"upsert": upsert, "delete": delete, "scd2": scd2, "replace": replace}.get(mode):
        return None
    if mode == "replace":
        return (r.partition_by, lambda a, b: a.eqNullSafe(b)) if r.partition_by and set(r.partition_by) <= set(target.columns) else None
    return (r.key, lambda a, b: a == b) if set(r.key) <= set(target.columns) else None


#: The manifest's entry of streams: the last batch of each.
_STREAMS = "_streams"


class ManagedAdapter(Adapter):
    """``params``: path (the root of the tables)."""

    def __init__(self, resource, spark=None):
        super().__init__(resource, spark)
        self.root = str(self.params.get("path") or self.params.get("database") or "").rstrip("/")
        if not self.root:
            raise AdapterError(f"resource {resource.name!r}: a path is needed")

    # -- manifests
    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifest(self, writes: bool = False) -> tuple[int, dict[str, Any]]:
        """The last manifest that is whole. A writer doesn't go on from one that isn't the last."""
        fs, folder = self._fs(f"{self.root}/_manifests")
        if not fs.exists(folder):
            return 0, {}
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        for number in sorted((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), reverse=True):
            path = f"{self.root}/_manifests/{number:012d}.json"
            stream = fs.open(self._fs(path)[1])
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return number, json.loads(text)
            except ValueError:
                if writes:
                    raise AdapterError(f"{path} isn't whole: a writer is publishing it, or has failed in doing so and it is to be deleted") from None
        return 0, {}

    def _commit(self, number: int, tables: dict[str, Any]) -> None:
        """Publishes a manifest: its file is made only if it isn't there, which one writer achieves.

        An object store has to make files so (conditional writes) for writers to exclude each other.
        """
        fs, target = self._fs(f"{self.root}/_manifests/{number:012d}.json")
        data = json.dumps(tables).encode()
        try:
            if fs.getUri().getScheme() == "file":  # the file system of this machine, whose Hadoop client only looks first
                folder = target.getParent()
                fs.mkdirs(folder)
                with open(target.toUri().getPath(), "xb") as out:
                    out.write(data)
            else:
                stream = fs.create(target, False)
                stream.write(bytearray(data))
                stream.close()
        except (FileExistsError, Py4JJavaError) as e:
            raise AdapterError(f"{self.root}: another writer published first") from e

    def has_table(self, collection: str) -> bool:
        return collection in self._manifest()[1] and collection != _STREAMS

    def _table(self, entry: dict[str, Any]) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        if not entry["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in entry["parts"]))

    def _split(self, entry: dict[str, Any], target: DataFrame, r: WriteRequest) -> tuple[DataFrame, list[str]]:
        """The part of a table that a request can change, and the files of the rest."""
        found = _matches(r, target)
        if found is None:
            return target, []
        columns, same = found
        keys = r.frame.select(*(col(c).alias(f"__m{k}") for k, c in enumerate(columns))).distinct()
        place = target.select(*map(col, columns), F.col("_metadata.file_path").alias("__file"))
        hit = place.join(keys, _all([same(col(c), F.col(f"__m{k}")) for k, c in enumerate(columns)]), "left_semi").select("__file").distinct()
        name = lambda path: tuple(path.split("/")[-2:])  # noqa: E731  folders have names of their own
        touched = {name(x["__file"]) for x in hit.collect()}
        every = self._files(entry["parts"])
        rest = [f for f in every if name(f) not in touched]
        if not rest:
            return target, []
        return self._table(entry | {"parts": [f for f in every if f not in set(rest)]}), rest

    def _files(self, parts: Sequence[str]) -> list[str]:
        """Parts with folders as the files that they hold, relative to the root."""
        out = []
        for part in parts:
            fs, at = self._fs(f"{self.root}/{part}")
            if fs.getFileStatus(at).isDirectory():
                out += sorted(f"{part}/{s.getPath().getName()}" for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
            else:
                out.append(part)
        return out

    # -- adapter
    def _read(self, collection: str | None, since: tuple[str, Any] | None) -> DataFrame:
        if not collection:
            raise AdapterError("a collection (the table) is needed")
        tables = self._manifest()[1]
        if collection not in tables or collection == _STREAMS:
            raise AdapterError(f"there is no table {collection!r}")
        return newer_than(self._table(tables[collection]), since)

    def write_once(self, requests: Sequence[WriteRequest], stream: str, batch: int) -> list[LoadResult]:
        """The manifest says which batch of a stream came last, so a batch that is tried again
        after it was published does nothing."""
        self._permit("write")
        return self._write_batch(requests, (stream, batch))

    def _write_batch(self, requests: Sequence[WriteRequest], once: tuple[str, int] | None = None) -> list[LoadResult]:
        number, tables = self._manifest(writes=True)
        tables, results, made = dict(tables), [], []
        if once:
            seen = tables.get(_STREAMS, {}).get(once[0])
            if seen is not None and once[1] <= seen:
                return []
            tables[_STREAMS] = {**tables.get(_STREAMS, {}), once[0]: once[1]}
        try:
            for r in requests:
                if not r.collection or r.collection == _STREAMS:
                    raise AdapterError("a collection (the table) is needed")
                results.append(self._staged(r, tables, made))
            self._commit(number + 1, tables)
        except BaseException:
            for part in made:
                fs, at = self._fs(f"{self.root}/{part}")
                fs.delete(at, True)
            raise
        return results

    def _staged(self, r: WriteRequest, tables: dict[str, Any], made: list[str]) -> LoadResult:
        """Modes that match rows read the frame several times, so it is kept meanwhile."""
        if r.mode is LoadMode.APPEND or (r.mode is LoadMode.REPLACE and not r.partition_by):
            return self._stage(r, tables, made)
        r.frame = r.frame.persist(StorageLevel.MEMORY_AND_DISK)
        kept = r.frame
        try:
            return self._stage(r, tables, made)
        finally:
            kept.unpersist()

    def _stage(self, r: WriteRequest, tables: dict[str, Any], made: list[str]) -> LoadResult:
        entry = tables.get(r.collection)
        target = self._table(entry) if entry else None
        if entry is None:
            r.frame = declared_types(r.frame, r.contract)
        if r.mode is LoadMode.DELETE and target is None:
            return LoadResult(r.collection, r.mode, r.frame.count())
        rest: list[str] = []
        if target is not None and entry["parts"] and r.mode is not LoadMode.APPEND:
            target, rest = self._split(entry, target, r)
        rows = LOAD_STRATEGIES.get(str(r.mode))(target, r)
        counts = Observation()
        rows = rows.observe(counts, *(F.count_if(F.col(FLAG) == h).alias(h) for h in ("kept", "inserted", "updated", "closed")))
        part = f"{r.collection}/{uuid.uuid4().hex}"
        made.append(part)
        try:
            rows.drop(FLAG).write.parquet(f"{self.root}/{part}")
        except PySparkException as e:
            raise AdapterError(f"{r.collection} can't be written: {str(e).splitlines()[0]}") from e
        n = counts.get
        schema = entry["schema"] if entry else json.loads(rows.drop(FLAG).schema.json())
        parts = [*entry["parts"], part] if entry and r.mode is LoadMode.APPEND else [*rest, part]
        before = target.count() if target is not None and r.mode in (LoadMode.REPLACE, LoadMode.DELETE) else 0
        gone = before - n["kept"] if r.mode in (LoadMode.REPLACE, LoadMode.DELETE) else 0
        tables[r.collection] = {"schema": schema, "parts": parts, "primary_key": entry.get("primary_key", []) if entry else r.contract.primary_key if r.contract else []}
        came = n["inserted"] + n["updated"] if r.mode not in (LoadMode.DELETE, LoadMode.SCD2) else r.frame.count()
        return LoadResult(r.collection, r.mode, came, n["inserted"], n["updated"] + n["closed"], gone, entry is None)

    def vacuum(self) -> int:
        """Deletes folders that the last manifest doesn't name, and in those of which it names some
        files the others; only when nobody reads older versions. Gives the number of folders."""
        _, tables = self._manifest()
        named = {p for name, t in tables.items() if name != _STREAMS for p in t["parts"]}
        partly = {p.rsplit("/", 1)[0] for p in named if p.count("/") > 1}
        fs, root = self._fs(self.root)
        dropped = 0
        for table in fs.listStatus(root):
            name = table.getPath().getName()
            for part in fs.listStatus(table.getPath()) if table.isDirectory() and not name.startswith("_") else []:
                place = f"{name}/{part.getPath().getName()}"
                if place in partly:
                    for file in fs.listStatus(part.getPath()):
                        if f"{place}/{file.getPath().getName()}" not in named:
                            fs.delete(file.getPath(), False)
                elif place not in named:
                    fs.delete(part.getPath(), True)
                    dropped += 1
        return dropped
