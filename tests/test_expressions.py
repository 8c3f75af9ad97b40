import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weirflow import register_expression
from weirflow.errors import ExpressionError
from weirflow.functions.expression import compile_expression, vectorised
from weirflow.functions.predicate import compile_predicate


def ids(df, tree):
    return sorted(r["id"] for r in df.where(compile_predicate(df, tree)).collect())


def value(df, tree):
    return [r[0] for r in df.select(compile_expression(df, tree).alias("v")).collect()]


@pytest.fixture
def people(frame):
    return frame("id long, age int, name string, born timestamp_ntz", (1, 10, "ann", None), (2, None, "bob", None), (3, 30, None, None), (4, 40, "Al.x", None))


def test_null_operands_are_false_but_unequal(people):
    assert ids(people, {"age": {"op": ">", "value": 5}}) == [1, 3, 4]
    assert ids(people, {"age": {"op": "!=", "value": 10}}) == [2, 3, 4]
    assert ids(people, {"age": {"op": "==", "value": "30"}}) == [3]
    assert ids(people, {"NOT": {"age": {"op": ">", "value": 20}}}) == [1, 2]
    assert ids(people, {"NOT": {"NOT": {"age": {"op": ">", "value": 20}}}}) == [3, 4]
    assert ids(people, {"NOT": {"name": {"op": "contains", "value": "b"}}}) == [1, 3, 4]
    assert ids(people, {"NOT": {"age": {"op": "between", "value": [10, 30]}}}) == [2, 4]


def test_members_and_texts(people):
    assert ids(people, {"age": {"op": "in", "value": [10, "40", 40]}}) == [1, 4]
    assert ids(people, {"age": {"op": "not_in", "value": [10]}}) == [2, 3, 4]
    assert ids(people, {"age": {"op": "in", "value": []}}) == [] and ids(people, {"age": {"op": "not_in", "value": []}}) == [1, 2, 3, 4]
    assert ids(people, {"name": {"op": "contains", "value": "."}}) == [4]
    assert ids(people, {"name": {"op": "startswith", "value": "a"}}) == [1] and ids(people, {"name": {"op": "endswith", "value": "b"}}) == [2]
    assert ids(people, {"age": {"op": "between", "value": ["10", 30]}}) == [1, 3]
    assert ids(people, {"name": {"op": "isnull"}}) == [3] and ids(people, {"name": {"op": "notnull"}}) == [1, 2, 4]


def test_empty_connectives(people):
    assert ids(people, {"AND": []}) == [1, 2, 3, 4] and ids(people, {"OR": []}) == []
    assert ids(people, {"OR": [{"age": {"op": "<", "value": 20}}, {"AND": [{"age": {"op": ">", "value": 35}}, {"name": {"op": "notnull"}}]}]}) == [1, 4]


def test_pipe_operands(frame):
    df = frame("id long, amount double", (1, 10.0), (2, 50.0), (3, 30.0), (4, 90.0))
    assert ids(df, {"amount": {"op": ">=", "value": "${pipe:amount|mean}"}}) == [2, 4]
    assert ids(df, {"id": {"op": "in", "value": "${pipe:id|unique}"}}) == [1, 2, 3, 4]
    assert ids(df, {"amount": {"op": ">", "value": "${pipe:id}"}}) == [1, 2, 3, 4]
    assert ids(df, {"id": {"op": "in", "value": ["${pipe:id|max}", 1]}}) == [1, 4]
    assert ids(df, {"id": {"op": "==", "value": "${pipe:id|last}"}}) == [4]
    assert sum(value(df, {"/": [{"col": "amount"}, {"pipe": "amount|sum"}]})) == pytest.approx(1)
    for bad in ("${pipe:amount|bogus}", "${pipe:zzz|max}", "${pipe:id|unique}"):
        with pytest.raises(ExpressionError):
            ids(df, {"amount": {"op": ">=", "value": bad}})


@pytest.mark.parametrize("tree", [{"zzz": {"op": "==", "value": 1}}, {"age": {"op": "~", "value": 1}}, {"age": {"op": "in", "value": 3}}, {"age": {"op": "between", "value": [1]}}, {"age": {"op": ">", "value": "x"}}, {"name": {"op": ">", "value": 1}}, {"age": 3}, {"age": {"op": "=="}, "name": {"op": "isnull"}}, {"AND": {}}, {"name": {"op": "contains", "value": "${pipe:name}"}}])
def test_bad_predicates(people, tree):
    with pytest.raises(ExpressionError):
        ids(people, tree)


def test_unequal_kinds_never_match(people):
    assert ids(people, {"age": {"op": "==", "value": "x"}}) == [] and ids(people, {"age": {"op": "!=", "value": "x"}}) == [1, 2, 3, 4]


def test_filters_reach_the_scan(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 7 as k", "cast(id as string) as s").write.parquet(at)
    df = spark.read.parquet(at)
    tree = {"AND": [{"id": {"op": ">", "value": "90"}}, {"OR": [{"k": {"op": "in", "value": [1, 2]}}, {"s": {"op": "!=", "value": "95"}}]}]}
    plan = df.where(compile_predicate(df, tree))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThan(id,90)" in pushed and "In(k, [1,2])" in pushed and "EqualNullSafe(s,95)" in pushed


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=6), st.sampled_from(["==", "!=", ">", ">=", "<", "<="]), st.integers(-3, 3), st.booleans())
def test_comparisons_agree_with_a_mask(spark, values, op, bound, negate):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v int")
    s = pd.Series(values, dtype=float)
    mask = {"==": s == bound, "!=": s != bound, ">": s > bound, ">=": s >= bound, "<": s < bound, "<=": s <= bound}[op]
    tree = {"v": {"op": op, "value": bound}}
    assert ids(df, {"NOT": tree} if negate else tree) == [k for k, m in enumerate(mask) if m != negate]


def test_arithmetic(frame):
    df = frame("a long, b long, s string", (2, 4, "x"), (-7, 3, "y"), (7, -3, None))
    assert value(df, {"*": [{"col": "a"}, {"col": "b"}]}) == [8, -21, -21]
    assert value(df, {"+": [{"col": "a"}, {"col": "b"}, {"lit": 1}]}) == [7, -3, 5]
    assert value(df, {"%": [{"col": "a"}, {"col": "b"}]}) == [2, 2, -2]
    assert value(df, {"+": [{"col": "s"}, {"lit": "!"}]}) == ["x!", "y!", None]
    assert value(df, {"/": [{"col": "a"}, {"lit": 0}]}) == [float("inf"), float("-inf"), float("inf")]
    assert value(df, {"/": [{"lit": 0}, {"lit": 0}]}) == [None, None, None]
    assert value(df, {"%": [{"col": "a"}, {"lit": 0}]}) == [None, None, None]
    assert value(df, {"-": [{"col": "a"}, {"lit": None}]}) == [None, None, None]


def test_functions(frame):
    df = frame("x double, s string, n int", (2.5, "Ab", 1), (3.5, None, None), (-2.5, "c", 2))
    assert value(df, {"round": [{"col": "x"}]}) == [2.0, 4.0, -2.0]
    assert value(df, {"round": [{"lit": 1.25}, {"lit": 1}]}) == [1.2] * 3
    assert value(df, {"abs": {"col": "x"}}) == [2.5, 3.5, 2.5]
    assert value(df, {"coalesce": [{"col": "s"}, {"lit": "-"}]}) == ["Ab", "-", "c"]
    assert value(df, {"concat": [{"col": "s"}, {"lit": ":"}, {"col": "n"}]}) == ["Ab:1", None, "c:2"]
    assert value(df, {"lower": {"col": "s"}}) == ["ab", None, "c"] and value(df, {"upper": {"col": "s"}}) == ["AB", None, "C"]
    assert value(df, {"length": {"col": "s"}}) == [2, None, 1]


def test_nullif(frame):
    df = frame("x double, s string", (0.0, "a"), (-0.0, None), (2.0, "b"), (None, "a"))
    assert value(df, {"nullif": [{"col": "x"}, {"lit": 0}]}) == [None, None, 2.0, None]
    assert value(df, {"nullif": [{"col": "s"}, {"lit": "a"}]}) == [None, None, "b", None]


@pytest.mark.parametrize("tree", [{"col": "zzz"}, {"+": [{"col": "n"}]}, {"nope": [1]}, {"+": [{"col": "n"}, {"col": "s"}]}, {"*": [{"col": "s"}, {"lit": 2}]}, {"a": 1, "b": 2}, {"pipe": "n|unique"}, {"coalesce": []}, {"round": [{"col": "n"}, {"lit": "x"}]}])
def test_bad_expressions(frame, tree):
    with pytest.raises(ExpressionError):
        value(frame("n int, s string", (1, "a")), tree)


def test_registered_functions(frame):
    @register_expression("twice")
    def twice(x):
        return x * 2

    @register_expression("shout")
    @vectorised("string")
    def shout(s: pd.Series) -> pd.Series:
        return s.str.upper() + "!"

    df = frame("n int, s string", (1, "a"))
    assert value(df, {"twice": {"col": "n"}}) == [2] and value(df, {"shout": {"col": "s"}}) == ["A!"]
