"""Relational databases: SQLite by the standard library, others by JDBC.

Rows are staged beside the target, and plain SQL moves them within one transaction, which covers
all of a batch. Matching is by ``=``, so null keys never match.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date, datetime
from decimal import Decimal
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import AdapterError
from ..functions.frames import is_number, is_time, nan_to_null
from ..quality.contracts import DataframeContract
from ..registry import register_adapter
from .base import Adapter, LoadMode, LoadResult, WriteRequest, declared_types, newer_than
from .managed import ManagedAdapter


# ---------------------------------------------------------------- statements
class Statements:
    """SQL of the load modes. ``t`` is the target, ``s`` the staged rows."""

    def __init__(self, quote: str = '"', true: str = "1", false: str = "0"):
        self.a, self.b = (quote, quote) if len(quote) == 1 else (quote[0], quote[1])
        self.true, self.false = true, false

    def q(self, name: str) -> str:
        return f"{self.a}{name.replace(self.b, self.b * 2)}{self.b}"

    def table(self, name: str) -> str:
        return ".".join(self.q(p) for p in name.split("."))

    def names(self, columns: Sequence[str]) -> str:
        return ", ".join(map(self.q, columns))

    def match(self, keys: Sequence[str], s: str, t: str) -> str:
        return " AND ".join(f"{s}.{self.q(k)} = {t}.{self.q(k)}" for k in keys)

    def same(self, columns: Sequence[str], s: str, t: str) -> str:
        return " AND ".join(f"({s}.{self.q(c)} = {t}.{self.q(c)} OR ({s}.{self.q(c)} IS NULL AND {t}.{self.q(c)} IS NULL))" for c in columns)

    def insert_all(self, t: str, s: str, columns: Sequence[str]) -> str:
        return f"INSERT INTO {t} ({self.names(columns)}) SELECT {self.names(columns)} FROM {s}"

    def delete_matching(self, t: str, s: str, keys: Sequence[str], nulls: bool = False) -> str:
        how = self.same if nulls else self.match
        return f"DELETE FROM {t} WHERE EXISTS (SELECT 1 FROM {s} WHERE {how(keys, s, t)})"

    def update_matching(self, t: str, s: str, keys: Sequence[str], columns: Sequence[str]) -> str:
        sets = ", ".join(f"{self.q(c)} = (SELECT {s}.{self.q(c)} FROM {s} WHERE {self.match(keys, s, t)})" for c in columns)
        return f"UPDATE {t} SET {sets} WHERE EXISTS (SELECT 1 FROM {s} WHERE {self.match(keys, s, t)})"

    def insert_missing(self, t: str, s: str, keys: Sequence[str], columns: Sequence[str]) -> str:
        return f"INSERT INTO {t} ({self.names(columns)}) SELECT {self.names(columns)} FROM {s} WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {self.match(keys, s, t)})"

    def close_changed(self, t: str, s: str, r: WriteRequest, now: str) -> str:
        flag, end = self.q(r.scd.current_flag), self.q(r.scd.effective_to)
        return f"UPDATE {t} SET {end} = {now}, {flag} = {self.false} WHERE {flag} = {self.true} AND EXISTS (SELECT 1 FROM {s} WHERE {self.match(r.key, s, t)} AND NOT ({self.same(r.scd.track, s, t)}))"

    def open_versions(self, t: str, s: str, r: WriteRequest, columns: Sequence[str], now: str) -> str:
        flag = self.q(r.scd.current_flag)
        listed = self.names([*columns, r.scd.effective_from, r.scd.current_flag])
        return f"INSERT INTO {t} ({listed}) SELECT {self.names(columns)}, {now}, {self.true} FROM {s} WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {t}.{flag} = {self.true} AND {self.match(r.key, s, t)})"

    def duplicates(self, s: str, keys: Sequence[str]) -> str:
        known = " AND ".join(f"{self.q(k)} IS NOT NULL" for k in keys)
        return f"SELECT COUNT(*) FROM (SELECT {self.names(keys)} FROM {s} WHERE {known} GROUP BY {self.names(keys)} HAVING COUNT(*) > 1) d"


class Session:
    """One transaction."""

    def execute(self, sql: str) -> int:
        raise NotImplementedError

    def value(self, sql: str) -> Any:
        raise NotImplementedError


class SqlAdapter(Adapter):
    """What SQLite and JDBC share."""

    sql = Statements()

    @contextmanager
    def _session(self) -> Iterator[Session]:
        raise NotImplementedError

    def _columns(self, session: Session, table: str) -> list[str] | None:
        raise NotImplementedError

    def _create(self, session: Session, table: str, schema: T.StructType, contract: DataframeContract | None) -> None:
        lines = []
        for f in schema:
            rule = contract.columns.get(f.name) if contract else None
            key = bool(contract and f.name in contract.primary_key)
            lines.append(f"{self.sql.q(f.name)} {self._type(f.dataType, key)}" + " NOT NULL" * (key or bool(rule and not rule.nullable)))
        if contract and contract.primary_key and all(k in schema.names for k in contract.primary_key):
            lines.append(f"PRIMARY KEY ({self.sql.names(contract.primary_key)})")
        session.execute(f"CREATE TABLE {self.sql.table(table)} ({', '.join(lines)})")

    def _type(self, kind: T.DataType, key: bool = False) -> str:
        if isinstance(kind, T.BooleanType):
            return "BOOLEAN"
        if isinstance(kind, T.IntegralType):
            return "BIGINT"
        if isinstance(kind, T.DecimalType):
            return f"DECIMAL({kind.precision}, {kind.scale})"
        if is_number(kind):
            return "DOUBLE PRECISION"
        if is_time(kind):
            return "TIMESTAMP"
        return "VARCHAR(512)" if key else self.text_type

    text_type = "TEXT"

    def _moment(self, when: datetime) -> str:
        return f"{{ts '{when.isoformat(sep=' ')}'}}"

    @contextmanager
    def _staged(self, session: Session, r: WriteRequest) -> Iterator[tuple[str, int]]:
        """Name of a table with the request's rows, and how many they are."""
        raise NotImplementedError

    def _write_batch(self, requests: Sequence[WriteRequest]) -> list[LoadResult]:
        for r in requests:
            if not r.collection:
                raise AdapterError("a collection (the table) is needed")
        with self._session() as session:
            return [self._apply(session, r) for r in requests]

    def _apply(self, session: Session, r: WriteRequest) -> LoadResult:
        q, t = self.sql, self.sql.table(r.collection)
        now_there = self._columns(session, r.collection)
        made = now_there is None
        if made and r.mode is LoadMode.DELETE:
            return LoadResult(r.collection, r.mode, r.frame.count())
        if made:
            r.frame = declared_types(r.frame, r.contract)
            schema = r.frame.schema
            if r.mode is LoadMode.SCD2:
                schema = T.StructType([*schema, T.StructField(r.scd.effective_from, T.TimestampNTZType()), T.StructField(r.scd.effective_to, T.TimestampNTZType()), T.StructField(r.scd.current_flag, T.BooleanType())])
            self._create(session, r.collection, schema, r.contract)
            now_there = schema.names
        columns = list(r.frame.columns)
        extra = [c for c in columns if c not in now_there]
        if extra and r.mode is not LoadMode.DELETE:
            raise AdapterError(f"columns {', '.join(extra)} aren't in {r.collection}")
        out = LoadResult(r.collection, r.mode, created_table=made)
        with self._staged(session, r) as (s, out.rows_in):
            if r.mode in (LoadMode.UPSERT, LoadMode.SCD2) and session.value(q.duplicates(s, r.key)):
                raise AdapterError(f"{r.mode}: keys {', '.join(r.key)} repeat in the frame")
            if r.mode is LoadMode.REPLACE:
                out.deleted = session.execute(q.delete_matching(t, s, r.partition_by, nulls=True) if r.partition_by else f"DELETE FROM {t}")
                out.inserted = session.execute(q.insert_all(t, s, columns))
            elif r.mode is LoadMode.APPEND:
                out.inserted = session.execute(q.insert_all(t, s, columns))
            elif r.mode is LoadMode.DELETE:
                out.deleted = session.execute(q.delete_matching(t, s, r.key))
            elif r.mode is LoadMode.UPSERT:
                rest = [c for c in columns if c not in r.key]
                out.updated = session.execute(q.update_matching(t, s, r.key, rest)) if rest else 0
                out.inserted = session.execute(q.insert_missing(t, s, r.key, columns))
            else:
                nulls = " OR ".join(f"{q.q(k)} IS NULL" for k in r.key)
                if session.value(f"SELECT COUNT(*) FROM {s} WHERE {nulls}"):
                    raise AdapterError("scd2: keys may not be null")
                now = self._moment(r.effective())
                out.updated = session.execute(q.close_changed(t, s, r, now))
                out.inserted = session.execute(q.open_versions(t, s, r, columns, now))
        return out


# ---------------------------------------------------------------- SQLite
def _affinity(declared: str | None) -> str:
    name = (declared or "").upper()
    if "BOOL" in name:
        return "boolean"
    if "INT" in name:
        return "bigint"
    if any(x in name for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return "double"
    return "timestamp_ntz" if "TIMESTAMP" in name or name == "DATETIME" else "string"


class _RowRange(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.kinds, self.options = [f.dataType for f in schema], options

    def partitions(self) -> list[InputPartition]:
        if "dbtable" not in self.options:
            return [_RowRange(None, None)]
        with sqlite3.connect(self.options["path"]) as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {self.options['dbtable']}").fetchone()
            except sqlite3.Error:
                return [_RowRange(None, None)]
        if low is None:
            return []
        n = max(1, min(int(self.options.get("numpartitions", 8)), (high - low) // 50_000 + 1))
        step = -(-(high - low + 1) // n)
        return [_RowRange(low + k * step, min(high, low + (k + 1) * step - 1)) for k in range(n)]

    def read(self, partition: _RowRange):
        sql = self.options.get("query") or f"SELECT * FROM {self.options['dbtable']}"
        if partition.low is not None:
            sql += f" WHERE rowid BETWEEN {partition.low} AND {partition.high}"
        connection = sqlite3.connect(self.options["path"])
        try:
            for row in connection.execute(sql):
                yield tuple(self._value(v, k) for v, k in zip(row, self.kinds, strict=True))
        finally:
            connection.close()

    @staticmethod
    def _value(v: Any, kind: T.DataType) -> Any:
        if v is None:
            return None
        if isinstance(kind, T.StringType):
            return v if isinstance(v, str) else str(v)
        if isinstance(kind, T.DoubleType):
            return float(v)
        if isinstance(kind, T.BooleanType):
            return bool(v)
        return datetime.fromisoformat(v) if isinstance(kind, T.TimestampNTZType) and isinstance(v, str) else v


class SqliteSource(DataSource):
    """``spark.read.format("weirflow_sqlite")``: options path, and dbtable or query."""

    @classmethod
    def name(cls) -> str:
        return "weirflow_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(self.options["path"]) as c:
            if "dbtable" in self.options:
                found = [(r[1], _affinity(r[2])) for r in c.execute(f"PRAGMA table_info({self.options['dbtable']})")]
            else:
                cursor = c.execute(self.options["query"])
                names, first = [d[0] for d in cursor.description], cursor.fetchone()
                kinds = {int: "bigint", float: "double"}
                found = [(n, kinds.get(type(v), "string")) for n, v in zip(names, first or [None] * len(names), strict=True)]
        return ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in found)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(schema, dict(self.options))


class _SqliteSession(Session):
    def __init__(self, connection: sqlite3.Connection):
        self.connection = connection

    def execute(self, sql: str) -> int:
        try:
            return max(0, self.connection.execute(sql).rowcount)
        except sqlite3.Error as e:
            raise AdapterError(f"{e}: {sql}") from e

    def value(self, sql: str) -> Any:
        return self.connection.execute(sql).fetchone()[0]


def _plain(v: Any) -> Any:
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, date):
        return v.isoformat()
    return float(v) if isinstance(v, Decimal) else v


class SqliteAdapter(SqlAdapter):
    """``params``: path or database, query. The file must be where the executors see it."""

    def __init__(self, resource, spark=None):
        super().__init__(resource, spark)
        uri = self.params.get("uri") or self.params.get("url") or ""
        self.path = self.params.get("path") or self.params.get("database") or uri.removeprefix("jdbc:").removeprefix("sqlite:").removeprefix("//")
        if not self.path:
            raise AdapterError(f"resource {resource.name!r}: a path is needed")

    def has_table(self, collection: str) -> bool:
        with sqlite3.connect(self.path) as c:
            return c.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", [collection]).fetchone() is not None

    def _read(self, collection: str | None, since: tuple[str, Any] | None) -> DataFrame:
        if not collection:
            raise AdapterError("a collection (the table) is needed")
        self.spark.dataSource.register(SqliteSource)
        reader = self.spark.read.format("weirflow_sqlite").option("path", self.path)
        if self.params.get("query"):
            return newer_than(nan_to_null(reader.option("query", self.params["query"]).load()), since)
        if not self.has_table(collection):
            raise AdapterError(f"there is no table {collection!r}")
        if since is not None and since[1] is not None:
            with sqlite3.connect(self.path) as c:
                names = {r[1]: _affinity(r[2]) for r in c.execute(f"PRAGMA table_info({self.sql.q(collection)})")}
            if since[0] in names:
                value = since[1] if names[since[0]] in ("bigint", "double") else "'" + str(_plain(since[1])).replace("'", "''") + "'"
                value = float(value) if isinstance(value, str) and names[since[0]] in ("bigint", "double") else value
                where = f"(SELECT rowid, * FROM {self.sql.q(collection)} WHERE {self.sql.q(since[0])} > {value})"
                kept = ", ".join(map(self.sql.q, names))
                return nan_to_null(reader.option("query", f"SELECT {kept} FROM {where}").schema(", ".join(f"`{n}` {k}" for n, k in names.items())).load())
        return nan_to_null(reader.option("dbtable", self.sql.q(collection)).load())

    @contextmanager
    def _session(self) -> Iterator[Session]:
        connection = sqlite3.connect(self.path, isolation_level=None)
        connection.execute("BEGIN IMMEDIATE")
        try:
            yield _SqliteSession(connection)
            connection.execute("COMMIT")
        except BaseException:
            connection.execute("ROLLBACK")
            raise
        finally:
            connection.close()

    def _columns(self, session: _SqliteSession, table: str) -> list[str] | None:
        return [r[1] for r in session.connection.execute(f"PRAGMA table_info({self.sql.q(table)})")] or None

    def _moment(self, when: datetime) -> str:
        return f"'{when.isoformat(sep=' ')}'"

    @contextmanager
    def _staged(self, session: _SqliteSession, r: WriteRequest) -> Iterator[tuple[str, int]]:
        name = self.sql.q(f"stage_{uuid.uuid4().hex}")
        columns = ", ".join(f"{self.sql.q(f.name)} {self._type(f.dataType)}" for f in r.frame.schema)
        session.execute(f"CREATE TEMP TABLE {name} ({columns})")
        insert = f"INSERT INTO {name} VALUES ({', '.join('?' * len(r.frame.columns))})"
        n, chunk = 0, []
        for row in r.frame.toLocalIterator():  # a partition at a time
            chunk.append(tuple(map(_plain, row)))
            if len(chunk) >= (r.chunksize or 10_000):
                session.connection.executemany(insert, chunk)
                n, chunk = n + len(chunk), []
        session.connection.executemany(insert, chunk)
        yield name, n + len(chunk)
        session.execute(f"DROP TABLE {name}")


# ---------------------------------------------------------------- JDBC
_URLS = {
    "postgres": ("postgresql", 5432),
    "postgresql": ("postgresql", 5432),
    "mysql": ("mysql", 3306),
    "mssql": ("sqlserver", 1433),
    "derby": ("derby", None),
}


def jdbc_url(uri: str) -> tuple[str, dict[str, str]]:
    """A JDBC URL, and the user and password that a URI names; ``postgresql://me:pw@host/db`` and
    URIs with a client library's name (``mysql+x://``) will do, with or without ``jdbc:``."""
    plain = uri.removeprefix("jdbc:")
    scheme, found, rest = plain.partition("://")
    if not found:
        return "jdbc:" + plain, {}
    scheme = scheme.split("+")[0].lower()
    scheme = {"postgres": "postgresql", "mssql": "sqlserver"}.get(scheme, scheme)
    place, slash, tail = rest.partition("/")
    who, at, host = place.rpartition("@")
    user, _, password = who.partition(":")
    known = {k: unquote(v) for k, v in (("user", user), ("password", password)) if v} if at else {}
    if scheme == "sqlserver" and tail:
        name, _, more = tail.partition("?")
        return f"jdbc:sqlserver://{host};databaseName={name}" + "".join(f";{x}" for x in more.split("&") if x and not x.startswith("driver=")), known
    return f"jdbc:{scheme}://{host}{slash}{tail}", known


class _JdbcSession(Session):
    def __init__(self, connection):
        self.connection = connection

    def execute(self, sql: str) -> int:
        statement = self.connection.createStatement()
        try:
            return max(0, statement.executeUpdate(sql))
        except Exception as e:
            raise AdapterError(f"{str(e).splitlines()[0]}: {sql}") from e
        finally:
            statement.close()

    def value(self, sql: str) -> Any:
        statement = self.connection.createStatement()
        try:
            rows = statement.executeQuery(sql)
            rows.next()
            return rows.getLong(1)
        finally:
            statement.close()


class JdbcAdapter(SqlAdapter):
    """``params``: uri or url, or engine, user, password, host, port, database; query; options.

    ``options`` go to Spark's reader, which splits a table by partitionColumn, lowerBound,
    upperBound and numPartitions.
    """

    def __init__(self, resource, spark=None):
        super().__init__(resource, spark)
        p, engine = self.params, str(self.params.get("engine", "")).lower()
        url = p.get("uri") or p.get("url")
        known: dict[str, str] = {}
        if engine == "access":
            place = str(url or p.get("path") or "")
            if not place:
                raise AdapterError(f"resource {resource.name!r}: a uri or a path is needed")
            self.url = place if place.startswith("jdbc:") else f"jdbc:ucanaccess://{place}"
        elif url:
            self.url, known = jdbc_url(url)
        elif engine in _URLS and p.get("database"):
            kind, port = _URLS[engine]
            if engine == "derby":
                self.url = f"jdbc:derby:{p['database']};create=true"
            elif engine == "mssql":
                self.url = f"jdbc:sqlserver://{p.get('host', 'localhost')}:{p.get('port', port)};databaseName={p['database']}"
            else:
                self.url = f"jdbc:{kind}://{p.get('host', 'localhost')}:{p.get('port', port)}/{p['database']}"
        else:
            raise AdapterError(f"resource {resource.name!r}: a url, or a known engine with a database, is needed")
        self.engine = engine or self.url.split(":")[1]
        self.options = {"url": self.url} | known | {k: str(p[k]) for k in ("user", "password", "driver") if p.get(k)} | {k: str(v) for k, v in (p.get("options") or {}).items()}
        self.sql = Statements("`" if self.engine == "mysql" else "[]" if self.engine in ("mssql", "sqlserver") else '"', "1" if self.engine in ("mysql", "mssql", "sqlserver") else "true", "0" if self.engine in ("mysql", "mssql", "sqlserver") else "false")
        if self.engine == "derby":
            self.text_type = "VARCHAR(32672)"
            self.options.setdefault("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver")

    def _connection(self):
        jvm = self.spark._jvm
        properties = jvm.java.util.Properties()
        for k in ("user", "password"):
            if self.options.get(k):
                properties.setProperty(k, self.options[k])
        if self.options.get("driver"):
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        return jvm.java.sql.DriverManager.getConnection(self.url, properties)

    @contextmanager
    def _session(self) -> Iterator[Session]:
        connection = self._connection()
        connection.setAutoCommit(False)
        try:
            yield _JdbcSession(connection)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _columns(self, session: _JdbcSession, table: str) -> list[str] | None:
        schema, _, name = table.rpartition(".")
        rows = session.connection.getMetaData().getColumns(None, schema or None, name, None)
        out = []
        while rows.next():
            out.append(rows.getString("COLUMN_NAME"))
        return out or None

    def has_table(self, collection: str) -> bool:
        with self._session() as session:
            return self._columns(session, collection) is not None

    def _read(self, collection: str | None, since: tuple[str, Any] | None) -> DataFrame:
        if not collection:
            raise AdapterError("a collection (the table) is needed")
        reader = self.spark.read.format("jdbc").options(**self.options).option("preferTimestampNTZ", True)
        reader = reader.option("query", self.params["query"]) if self.params.get("query") else reader.option("dbtable", self.sql.table(collection))
        return newer_than(nan_to_null(reader.load()), since)

    @contextmanager
    def _staged(self, session: _JdbcSession, r: WriteRequest) -> Iterator[tuple[str, int]]:
        plain = f"WF_STAGE_{uuid.uuid4().hex[:12].upper()}"
        name = self.sql.q(plain)
        aside = self._connection()
        try:
            columns = ", ".join(f"{self.sql.q(f.name)} {self._type(f.dataType)}" for f in r.frame.schema)
            _JdbcSession(aside).execute(f"CREATE TABLE {name} ({columns})")
            r.frame.write.format("jdbc").options(**self.options).option("dbtable", name).option("batchsize", r.chunksize or 10_000).mode("append").save()
            yield name, session.value(f"SELECT COUNT(*) FROM {name}")
            session.execute(f"DROP TABLE {name}")  # with the transaction
        except BaseException:
            session.connection.rollback()  # lets go of the staged rows
            _JdbcSession(aside).execute(f"DROP TABLE {name}")
            raise
        finally:
            aside.close()


@register_adapter("db")
def database(resource, spark=None) -> Adapter:
    """The adapter of a database resource by its engine."""
    engine = str(resource.params.get("engine", "")).lower()
    url = str(resource.params.get("uri") or resource.params.get("url") or "")
    if engine in ("managed", "parquet"):
        return ManagedAdapter(resource, spark)
    if engine == "sqlite" or url.removeprefix("jdbc:").startswith("sqlite:"):
        return SqliteAdapter(resource, spark)
    return JdbcAdapter(resource, spark)
