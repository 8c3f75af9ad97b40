import sqlite3
from datetime import date, datetime

import pytest

from weirflow.config.format import Resource, Scd
from weirflow.errors import AdapterError, PermissionDeniedError
from weirflow.quality import DataframeContract
from weirflow.sources import WriteRequest, create_adapter
from weirflow.sources.base import newer_than

SPEC = Scd(track=["name"], effective_from="vf", effective_to="vt", current_flag="cur")


@pytest.fixture
def adapter(spark, tmp_path):
    def make(kind="file", allow=("read", "write"), **params):
        return create_adapter(Resource(name="r", adapter=kind, params=params, allow=list(allow)), spark)

    return make


@pytest.fixture(params=["managed", "sqlite", "derby"])
def database(request, adapter, tmp_path):
    where = {"path": str(tmp_path / "tables")} if request.param == "managed" else {"path": str(tmp_path / "x.db")} if request.param == "sqlite" else {"database": f"memory:d{id(tmp_path)}"}
    return adapter("db", engine=request.param, **where)


def missing(database):
    """Null, but for Derby: Spark's dialect for it can't write null texts into VARCHAR."""
    return "-" if getattr(database, "engine", "") == "derby" else None


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# ---------------------------------------------------------------- files
@pytest.mark.parametrize("kind", ["csv", "tsv", "json", "parquet", "orc", "excel"])
def test_file_round_trips(adapter, frame, tmp_path, kind):
    a = adapter(format=kind, path=str(tmp_path / f"x.{kind}"))
    sheet = {"collection": "S"} if kind == "excel" else {}
    df = frame("c long, v string, x double", (1, "a,b", 1.5), (2, 'q"t', None), (3, None, 2.0))
    out = a.write(df, **sheet)
    assert (out.rows_in, out.inserted, out.created_table) == (3, 3, True)
    read = a.read(*sheet.values())
    assert read.columns == ["c", "v", "x"] and rows(read, "c", "x") == [(1, 1.5), (2, None), (3, 2.0)]
    assert rows(a.read(*sheet.values(), since=("c", 1)), "c") == [(2,), (3,)]
    assert rows(a.read(*sheet.values(), since=("zzz", 1)), "c") == [(1,), (2,), (3,)]
    a.write(frame("v string, c long, x double", ("d", 4, 0.5)), mode="append", **sheet)
    assert rows(a.read(*sheet.values()), "c", "v")[-1] == (4, "d") and a.read(*sheet.values()).count() == 4
    a.write(df.where("c = 1"), **sheet)
    assert rows(a.read(*sheet.values()), "c", "v") == [(1, "a,b")]


def test_modes_that_files_do_not_have(adapter, frame, tmp_path):
    a = adapter(format="csv", path=str(tmp_path / "x.csv"))
    df = frame("k long, name string", (1, "a"))
    for how in ({"mode": "upsert", "key": ["k"]}, {"mode": "delete", "key": ["k"]}, {"mode": "scd2", "key": ["k"], "scd": SPEC}):
        with pytest.raises(AdapterError, match="can't be written"):
            a.write(df, **how)


def test_bad_resources(adapter, tmp_path):
    for kind, params in (("file", {"format": "pdf", "path": "x"}), ("file", {"format": "csv"}), ("nope", {}), ("db", {"engine": "sqlite"}), ("db", {"engine": "access"}), ("db", {"engine": "managed"}), ("db", {"engine": "postgres"})):
        with pytest.raises(AdapterError):
            adapter(kind, **params)
    with pytest.raises(AdapterError, match="doesn't exist"):
        adapter(format="csv", path=str(tmp_path / "none.csv")).read()


def test_permissions(adapter, frame, tmp_path):
    with pytest.raises(PermissionDeniedError):
        adapter(allow=["read"], format="csv", path=str(tmp_path / "x")).write(frame("a long", (1,)))
    with pytest.raises(PermissionDeniedError):
        adapter(allow=["write"], format="csv", path=str(tmp_path / "x")).read()


def test_csv_options(adapter, tmp_path):
    at = tmp_path / "x.csv"
    at.write_text("id;when;zip\n1;2024-01-02 03:04:05;007\n2;NA;010\n")
    df = adapter(format="csv", path=str(at), options={"sep": ";", "na_values": "NA", "dtype": {"zip": "str"}, "usecols": ["id", "when", "zip"]}).read()
    assert df.dtypes == [("id", "bigint"), ("when", "timestamp_ntz"), ("zip", "string")]
    assert rows(df, "id", "when", "zip") == [(1, datetime(2024, 1, 2, 3, 4, 5), "007"), (2, None, "010")]


@pytest.mark.parametrize(("text", "want"), [('[{"a": 1, "b": "x"}, {"a": 2}]', [(1,), (2,)]), ('{"meta": 1, "items": [{"a": 1}, {"a": 2}], "more": [3]}', [(1,), (2,)]), ('{"a": 1}\n{"a": 2}\n', [(1,), (2,)]), ('{"a": 5, "b": "x"}', [(5,)]), ('[\n {"a": 1},\n {"a": 3}\n]\n', [(1,), (3,)])])
def test_json_shapes(adapter, tmp_path, text, want):
    (tmp_path / "x.json").write_text(text)
    assert rows(adapter(format="json", path=str(tmp_path / "x.json")).read(), "a") == want


def test_empty_json(adapter, tmp_path):
    (tmp_path / "x.json").write_text("")
    df = adapter(format="json", path=str(tmp_path / "x.json")).read()
    assert df.columns == [] and df.count() == 0


def test_nan_is_missing(adapter, spark, tmp_path):
    at = str(tmp_path / "x.parquet")
    spark.createDataFrame([(1, float("nan")), (2, 1.0)], "a long, x double").write.parquet(at)
    assert rows(adapter(format="parquet", path=at).read(), "a", "x") == [(1, None), (2, 1.0)]
    kept = adapter(format="parquet", path=at, options={"nan_as_null": False}).read().where("x > 0.5 and a = 2")
    assert "GreaterThan(x,0.5)" in kept._jdf.queryExecution().executedPlan().toString()


def test_numbered_parquet_rows_still_push_filters(adapter, spark, tmp_path):
    at = str(tmp_path / "x.parquet")
    spark.range(50).repartition(3).write.parquet(at)
    df = adapter(format="parquet", path=at).read(numbered=True)
    assert df.select("__ord").distinct().count() == 50
    plan = df.where("id > 40")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,40)" in plan


def test_partitioned_files_are_replaced_by_partition(adapter, frame, tmp_path):
    a = adapter(format="parquet", path=str(tmp_path / "p"))
    a.write(frame("k long, day string", (1, "a"), (2, "b")), partition_by=["day"])
    a.write(frame("k long, day string", (3, "b")), partition_by=["day"])
    assert rows(a.read(), "k", "day") == [(1, "a"), (3, "b")]


def test_excel_sheets(adapter, frame, tmp_path):
    a = adapter(format="excel", path=str(tmp_path / "b.xlsx"))
    a.write(frame("t timestamp_ntz, b boolean, s string, n double", (datetime(2024, 5, 6, 12), True, "<&> x", 1.25)), "One")
    a.write(frame("a long", (1,)), "Two")
    one = a.read("One")
    assert tuple(one.first()) == (datetime(2024, 5, 6, 12), True, "<&> x", 1.25) and rows(a.read("Two"), "a") == [(1,)]
    with pytest.raises(AdapterError, match="needs a collection"):
        a.read()
    with pytest.raises(AdapterError, match="no sheet"):
        a.read("Three")


def test_newer_than_compares_by_type(frame):
    df = frame("n long, t timestamp_ntz, s string", (1, datetime(2024, 1, 1), "a"), (2, datetime(2024, 1, 2), "b"))
    for since in (("n", "1"), ("t", "2024-01-01"), ("t", datetime(2024, 1, 1)), ("s", "a")):
        assert rows(newer_than(df, since), "n") == [(2,)]
    assert newer_than(df, ("n", None)) is df and newer_than(df, None) is df


# ---------------------------------------------------------------- databases
def test_load_modes(database, frame):
    two = frame("k long, v long", (1, 10), (2, 20))
    out = database.write(two, "t", mode="replace")
    assert out.created_table and out.inserted == 2
    out = database.write(frame("v long, k long", (99, 2), (30, 3)), "t", mode="upsert", key=["k"])
    assert (out.inserted, out.updated) == (1, 1) and rows(database.read("t"), "k", "v") == [(1, 10), (2, 99), (3, 30)]
    out = database.write(frame("k long", (1,), (7,), (None,)), "t", mode="delete", key="k")
    assert out.deleted == 1 and rows(database.read("t"), "k") == [(2,), (3,)]
    database.write(frame("k long, v long", (2, 5)), "t", mode="append")
    assert rows(database.read("t"), "k", "v") == [(2, 5), (2, 99), (3, 30)]
    out = database.write(frame("k long, v long", (8, 8)), "t")
    assert (out.deleted, out.inserted, out.created_table) == (3, 1, False) and rows(database.read("t"), "k", "v") == [(8, 8)]
    assert database.has_table("t") and not database.has_table("u")


def test_upsert_leaves_other_columns_and_null_keys(database, frame):
    database.write(frame("k long, a long, b string", (1, 1, "X"), (None, 3, "Z")), "t")
    database.write(frame("k long, a long", (1, 2), (None, 9)), "t", mode="upsert", key=["k"])
    assert rows(database.read("t"), "k", "a", "b") == sorted([(1, 2, "X"), (None, 3, "Z"), (None, 9, None)], key=str)
    with pytest.raises(AdapterError, match="repeat"):
        database.write(frame("k long, a long", (5, 1), (5, 2)), "t", mode="upsert", key=["k"])


def test_partitions_are_replaced(database, frame):
    null = missing(database)
    database.write(frame("k long, day string", (1, "a"), (2, "b"), (3, null)), "t")
    out = database.write(frame("k long, day string", (4, "b"), (5, null)), "t", partition_by=["day"])
    assert (out.inserted, out.deleted) == (2, 2) and rows(database.read("t"), "k", "day") == [(1, "a"), (4, "b"), (5, null)]


def test_history(database, frame):
    null = missing(database)
    load = lambda day, *r: database.write(frame("k long, name string", *r), "t", mode="scd2", key=["k"], scd=SPEC, as_of=day)
    assert load("2024-01-01", (1, "a"), (2, "b"), (3, null)).inserted == 3
    out = load(date(2024, 2, 1), (1, "a"), (2, "B2"), (3, null), (4, "d"))
    assert (out.inserted, out.updated) == (2, 1)
    first, second = datetime(2024, 1, 1), datetime(2024, 2, 1)
    assert rows(database.read("t"), "k", "name", "vf", "vt", "cur") == sorted([(1, "a", first, None, True), (2, "b", first, second, False), (3, null, first, None, True), (2, "B2", second, None, True), (4, "d", second, None, True)], key=str)
    again = load("2024-03-01", (1, "a"), (2, "B2"))
    assert (again.inserted, again.updated) == (0, 0) and database.read("t").count() == 5
    for r in ((None, "x"),), ((7, "x"), (7, "y")):
        with pytest.raises(AdapterError):
            load("2024-04-01", *r)


def test_a_batch_is_all_or_nothing(database, frame):
    good, bad = WriteRequest(frame("k long", (1,)), "a"), WriteRequest(frame("k long, name string", (None, "x")), "b", "scd2", ["k"], scd=SPEC)
    with pytest.raises(AdapterError):
        database.write_batch([good, bad])
    assert not database.has_table("a") and not database.has_table("b")


def test_one_batch_may_write_a_table_twice(database, frame):
    out = database.write_batch([WriteRequest(frame("k long, v long", (1, 1), (2, 2)), "t"), WriteRequest(frame("k long, v long", (2, 3), (4, 4)), "t", "upsert", ["k"]), WriteRequest(frame("k long", (1,)), "t", "delete", ["k"])])
    assert [r.created_table for r in out] == [True, False, False] and rows(database.read("t"), "k", "v") == [(2, 3), (4, 4)]


def test_since_and_missing_tables(database, frame):
    database.write(frame("k long, t timestamp_ntz", (1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))), "t")
    assert rows(database.read("t", since=("k", 1)), "k") == [(2,)] and rows(database.read("t", since=("t", "2024-01-01 00:00:00")), "k") == [(2,)]
    for bad in (None, "zzz"):
        with pytest.raises(Exception):  # noqa: B017
            database.read(bad).count()
    assert database.write(frame("k long", (1,)), "zzz", mode="delete", key="k").deleted == 0


def test_contracts_make_the_types(database, frame):
    contract = DataframeContract.model_validate({"columns": {"id": {"dtype": "integer", "nullable": False}, "amt": {"dtype": "float"}, "label": {"dtype": "string"}}, "primary_key": ["id"]})
    database.write(frame("id string, amt int, label string", ("1", 2, "x")), "t", contract=contract)
    kinds = dict(database.read("t").dtypes)
    assert kinds["id"] == "bigint" and kinds["label"].startswith(("string", "varchar"))
    assert [int(r[0]) for r in rows(database.read("t"), "id")] == [1]


def test_columns_that_a_table_lacks(database, frame):
    database.write(frame("k long", (1,)), "t")
    with pytest.raises(AdapterError, match="aren't in"):
        database.write(frame("k long, z long", (2, 2)), "t", mode="append")
    for how in ({"mode": "upsert"}, {"mode": "upsert", "key": ["zzz"]}, {"mode": "replace", "partition_by": ["zzz"]}):
        with pytest.raises(AdapterError):
            database.write(frame("k long", (1,)), "t", **how)


def test_sqlite_keys_and_queries(adapter, frame, tmp_path):
    at = str(tmp_path / "x.db")
    with sqlite3.connect(at) as c:
        c.execute("CREATE TABLE p (id INTEGER PRIMARY KEY, cost REAL, at TEXT)")
        c.executemany("INSERT INTO p VALUES (?, ?, ?)", [(k, k / 2, f"2024-01-{k:02d}") for k in range(1, 10)])
    a = adapter("db", engine="sqlite", path=at)
    a.write(frame("id long, cost double", (3, 0.0)), "p", mode="upsert", key="id")
    a.write(frame("id long, cost double", (50, 1.0)), "p")
    with sqlite3.connect(at) as c:
        assert [r[5] for r in c.execute("PRAGMA table_info(p)")] == [1, 0, 0]  # the key survives a replace
    q = adapter("db", uri=f"sqlite:///{at}", query="SELECT id * 2 AS twice FROM p")
    assert rows(q.read("p"), "twice") == [(100,)]


@pytest.mark.parametrize(
    ("params", "url", "user"),
    [
        ({"engine": "postgres", "uri": "postgresql://me:p%40w@db:5432/billing"}, "jdbc:postgresql://db:5432/billing", ("me", "p@w")),
        ({"engine": "postgresql", "url": "jdbc:postgresql://db/x?ssl=true", "user": "u"}, "jdbc:postgresql://db/x?ssl=true", ("u", None)),
        ({"engine": "mysql", "uri": "mysql+pymysql://me@db/x"}, "jdbc:mysql://db/x", ("me", None)),
        ({"engine": "mssql", "uri": "mssql+pyodbc://me:pw@db:1433/x?driver=ODBC"}, "jdbc:sqlserver://db:1433;databaseName=x", ("me", "pw")),
        ({"engine": "mssql", "host": "db", "database": "x", "user": "me", "password": "pw"}, "jdbc:sqlserver://db:1433;databaseName=x", ("me", "pw")),
        ({"engine": "postgres", "host": "db", "port": 99, "database": "x"}, "jdbc:postgresql://db:99/x", (None, None)),
        ({"engine": "access", "uri": "/data/c.accdb"}, "jdbc:ucanaccess:///data/c.accdb", (None, None)),
    ],
)
def test_connection_settings(adapter, params, url, user):
    a = adapter("db", **params)
    assert a.url == url and (a.options.get("user"), a.options.get("password")) == user


def test_only_files_with_matches_are_written_anew(adapter, spark, tmp_path):
    a = adapter("db", engine="managed", path=str(tmp_path / "m"))
    a.write(spark.range(0, 100).selectExpr("id as k", "id * 2 as v", "cast(id / 50 as int) as half").repartitionByRange(4, "k"), "t")
    parts = lambda: a._manifest()[1]["t"]["parts"]
    out = a.write(spark.range(98, 103).selectExpr("id as k", "-id as v"), "t", mode="upsert", key=["k"])
    assert (out.inserted, out.updated) == (3, 2) and len(parts()) == 4 and a.read("t").count() == 103
    before = parts()
    out = a.write(spark.range(10, 12).selectExpr("id as k"), "t", mode="delete", key="k")
    assert out.deleted == 2 and a.read("t").count() == 101 and len(set(before) & set(parts())) == 2
    a.write(spark.range(5).selectExpr("id + 500 as k", "id as v", "1 as half"), "t", partition_by=["half"])
    assert rows(a.read("t").where("half = 1"), "k") == [(k,) for k in range(500, 505)] and a.read("t").where("half = 0").count() == 48
    a.vacuum()
    assert a.read("t").count() == 48 + 5 + 3
    out = a.write(spark.range(900, 901).selectExpr("id as k"), "t", mode="delete", key="k")
    assert out.deleted == 0 and a.read("t").count() == 56


def test_managed_manifests(adapter, frame, spark, tmp_path):
    a = adapter("db", engine="managed", path=str(tmp_path / "m"))
    for k in range(3):
        a.write(frame("k long", (k,)), "t", mode="append")
    before = a.read("t")
    a.write(frame("k long", (9,)), "t")
    assert rows(before, "k") == [(0,), (1,), (2,)] and rows(a.read("t"), "k") == [(9,)]  # readers keep their version
    assert a.vacuum() == 3 and rows(a.read("t"), "k") == [(9,)]
