import math

import pytest

from weirflow.errors import TransformError


def test_sort_puts_nulls_last_both_ways(frame, run):
    df = frame("a int, b int", (2, 1), (None, 2), (1, 3), (2, 0))
    assert run("sort", {"a": "asc", "b": "desc"}, df) == [(1, 3), (2, 1), (2, 0), (None, 2)]
    assert run("sort", {"by": {"a": "desc"}}, df)[-1] == (None, 2)
    with pytest.raises(TransformError):
        run("sort", {"z": "asc"}, df)


def test_dedupe(frame, run):
    df = frame("k string, v int", ("x", 1), ("x", 2), (None, 3), (None, 4), ("y", 5))
    assert sorted(run("dedupe", {"on": "k"}, df), key=lambda r: r[1]) == [("x", 1), (None, 3), ("y", 5)]
    assert sorted(run("dedupe", {"on": ["k"], "keep": "last"}, df), key=lambda r: r[1]) == [("x", 2), (None, 4), ("y", 5)]
    assert run("dedupe", {"on": "k", "keep": False}, df) == [("y", 5)]
    assert sorted(run("dedupe", {"on": "k", "order_by": {"v": "desc"}}, df), key=lambda r: r[1]) == [("x", 2), (None, 4), ("y", 5)]
    assert sorted(run("dedupe", {"on": "k", "keep": "last", "order_by": {"v": "desc"}}, df), key=lambda r: r[1]) == [("x", 1), (None, 3), ("y", 5)]
    assert sorted(run("dedupe", {}, frame("k int", (1,), (1,), (None,), (None,))), key=str) == [(1,), (None,)]


def test_group(frame, run):
    df = frame("k string, v long", ("x", 1), ("x", 2), ("y", 3), (None, 4), (None, None))
    assert dict(run("group", {"by": "k", "agg": {"v": "sum"}}, df)) == {"x": 3, "y": 3, None: 4}
    assert dict(run("group", {"by": ["k"], "agg": {"v": "first"}}, df)) == {"x": 1, "y": 3, None: 4}
    assert dict(run("group", {"by": ["k"], "agg": {"v": "last"}}, df)) == {"x": 2, "y": 3, None: 4}
    for params in ({"by": "k"}, {"by": "k", "agg": {}}, {"by": "k", "agg": {"k": "count"}}, {"by": "k", "agg": {"v": "nope"}}, {"by": "z", "agg": {"v": "sum"}}):
        with pytest.raises(TransformError):
            run("group", params, df)


@pytest.mark.parametrize(
    ("fn", "some", "nothing"),
    [("sum", 6.0, 0.0), ("mean", 2.0, None), ("count", 3, 0), ("size", 4, 2), ("min", 1.0, None), ("max", 3.0, None), ("median", 2.0, None), ("std", 1.0, None), ("var", 1.0, None), ("nunique", 3, 0), ("prod", 6.0, 1.0), ("first", 1.0, None), ("last", 3.0, None), ("sem", 1 / math.sqrt(3), None), ("skew", 0.0, None)],
)
def test_aggregates_of_some_and_of_nothing(frame, run, fn, some, nothing):
    df = frame("k string, v double", ("a", None), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", None), ("b", None))
    got = dict(run("group", {"by": "k", "agg": {"v": fn}}, df))
    assert got["a"] == pytest.approx(some) and got["b"] == nothing


def test_any_and_all(frame, run):
    df = frame("k string, v boolean, w boolean", ("a", True, True), ("a", False, True), ("b", None, None))
    assert sorted(run("group", {"by": "k", "agg": {"v": "any", "w": "all"}}, df)) == [("a", True, True), ("b", False, True)]


def test_window(frame, run):
    df = frame("g string, d long, v long", ("a", 1, 10), ("a", 2, 20), ("b", 1, 30))
    out = run("window", {"partition_by": ["g"], "order_by": {"d": "asc"}, "add": {"rn": {"fn": "row_number"}, "cs": {"fn": "cumsum", "column": "v"}, "c": {"fn": "cumcount"}}}, df)
    assert sorted(out) == [("a", 1, 10, 1, 10, 0), ("a", 2, 20, 2, 30, 1), ("b", 1, 30, 1, 30, 0)]


def test_running_functions_skip_nulls_and_ranks_ignore_the_order(frame, run):
    df = frame("g string, d long, v long", (None, 3, 5), (None, 1, None), (None, 2, 7), (None, 4, 5))
    add = {"s": {"fn": "cumsum", "column": "v"}, "hi": {"fn": "cummax", "column": "v"}, "lo": {"fn": "cummin", "column": "v"}, "r": {"fn": "rank", "column": "v"}, "dr": {"fn": "dense_rank", "column": "v"}}
    out = {r[1]: r[3:] for r in run("window", {"partition_by": "g", "order_by": {"d": "asc"}, "add": add}, df)}
    assert out == {1: (None, None, None, None, None), 2: (7, 7, 7, 3.0, 2.0), 3: (12, 7, 5, 1.0, 1.0), 4: (17, 7, 5, 1.0, 1.0)}


def test_window_without_order_takes_the_rows_as_they_come(frame, run):
    df = frame("v long", (3,), (1,), (2,))
    assert run("window", {"add": {"n": {"fn": "row_number"}}}, df) == [(3, 1), (1, 2), (2, 3)]
    assert run("window", {"order_by": {"v": "desc"}, "sort": True, "add": {"n": {"fn": "row_number"}}}, df) == [(3, 1), (2, 2), (1, 3)]
    for add in ({"n": {"fn": "rank"}}, {"n": {"fn": "cumsum"}}, {"n": {"fn": "lag", "column": "v"}}, {"n": {"fn": "cumsum", "column": "z"}}, {}):
        with pytest.raises(TransformError):
            run("window", {"add": add}, df)


def test_windows_over_everything_agree_with_one_partition(spark, run):
    import random

    rng = random.Random(3)
    rows = [(k, rng.choice([None, *range(9)]), float(rng.randint(0, 5)), rng.choice("abc")) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, v int, x double, s string").repartition(7)
    add = {"n": {"fn": "row_number"}, "c": {"fn": "cumcount"}, "sum": {"fn": "cumsum", "column": "v"}, "hi": {"fn": "cummax", "column": "s"}, "lo": {"fn": "cummin", "column": "v"}, "r": {"fn": "rank", "column": "v"}, "d": {"fn": "dense_rank", "column": "v"}, "q": {"fn": "rank", "column": "s"}}
    order = {"x": "desc", "id": "asc"}
    whole = run("window", {"order_by": order, "add": add}, df, rows=False)
    one = run("window", {"partition_by": "k", "order_by": order, "add": add}, df.selectExpr("*", "1 as k"), rows=False).drop("k")
    assert whole.columns == one.columns and whole.dtypes == one.dtypes
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, one.collect()))
    assert run("window", {"order_by": order, "add": add}, df.limit(0)) == []


def test_filter_action(frame, run):
    df = frame("v long", (1,), (5,))
    assert run("filter", {"v": {"op": ">", "value": 2}}, df) == [(5,)]
    assert run("filter", {"root": {"v": {"op": "<", "value": 2}}}, df) == [(1,)]


def test_later_steps_see_a_sorted_order(frame, run):
    df = run("sort", {"v": "desc"}, frame("k string, v long", ("a", 1), ("a", 3), ("a", 2)), rows=False)
    assert run("dedupe", {"on": "k"}, df) == [("a", 3)]


def test_single_keys_of_hot_and_null_keys(spark, run, frame):
    """Keys that are single stay with their rows; one key holds most rows and is counted before it is dealt."""
    rows = [(1, "a")] * 500 + [(None, "n"), (2, "b"), (3, "c"), (3, "c")]
    df = spark.createDataFrame(rows, "k long, v string").repartition(6)
    assert sorted(run("dedupe", {"on": "k", "keep": False}, df), key=str) == [(2, "b"), (None, "n")]
    assert sorted(run("dedupe", {"keep": False}, df), key=str) == [(2, "b"), (None, "n")]
    plan = run("dedupe", {"on": "k", "keep": False}, df, rows=False)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
