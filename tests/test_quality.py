import pytest

from weirflow.errors import ContractError, ExpectationError
from weirflow.quality import DataframeContract, Expectation, check_contract, check_expectations
from weirflow.quality.contracts import contract_problems


def contract(**body):
    return DataframeContract.model_validate(body)


def test_strict_contract(frame):
    c = contract(columns={"id": {"dtype": "integer", "nullable": False, "unique": True}, "amt": {"dtype": "number", "checks": [{">=": 0}]}}, primary_key=["id"], strict=True)
    check_contract(frame("id long, amt double", (1, 1.0), (2, 2.0)), c)
    with pytest.raises(ContractError) as e:
        check_contract(frame("id long, amt double", (1, 1.0), (1, -1.0)), c)
    assert "id: 1 repeated values" in str(e.value) and "amt: 1 values against >= 0" in str(e.value) and "primary key id: 1 repeated rows" in str(e.value)
    check_contract(frame("id long, amt double", (1, -1.0)), c, "warn")
    check_contract(frame("x long", (1,)), c, "off")


def test_schema_problems_need_no_data(frame):
    c = contract(columns={"a": {"dtype": "string"}, "b": {"dtype": "date"}, "c": {}, "d": {"dtype": "odd"}, "e": {"required": False}}, primary_key=["k"], strict=True)
    found = contract_problems(frame("a long, b timestamp_ntz, d int, z int", (1, None, 1, 1)), c)
    assert found == ["a: is bigint, not string", "column 'c' is missing", "d: unknown dtype 'odd'", "columns that aren't in the contract: z", "primary key column 'k' is missing"]


@pytest.mark.parametrize(("dtype", "good", "bad"), [("integer", "smallint", "double"), ("float", "float", "int"), ("number", "decimal(9,2)", "string"), ("string", "string", "int"), ("boolean", "boolean", "int"), ("date", "timestamp", "string"), ("datetime", "date", "int"), ("category", None, "string")])
def test_type_families(spark, dtype, good, bad):
    c = contract(columns={"x": {"dtype": dtype}})
    if good:
        assert contract_problems(spark.createDataFrame([], f"x {good}"), c) == []
    assert len(contract_problems(spark.createDataFrame([], f"x {bad}"), c)) == 1


def test_values(frame):
    df = frame("s string, n int", ("a", 1), ("b", None), (None, 3), ("c", 4))
    c = contract(columns={"s": {"nullable": False, "allowed": ["a", "b"]}, "n": {"checks": [{"!=": 3}, {"<": "4"}, {"~": 1}]}})
    assert contract_problems(df, c) == ["n: unknown check '~'", "s: 1 nulls", "s: 1 values that aren't allowed", "n: 1 values against != 3", "n: 1 values against < 4"]


def test_foreign_keys(frame):
    orders, people = frame("id long", (1,), (2,), (None,), (9,)), frame("k long", (1,), (2,))
    c = contract(foreign_keys={"id": "people.k"})
    assert contract_problems(orders, c, {"people": people}.get) == ["foreign key id: 1 rows without people.k"]
    assert contract_problems(orders, c, {}.get) == [] and contract_problems(orders, contract(foreign_keys={"id": "people.z"}), {"people": people}.get) != []


def expectation(on_failure="fail", **body):
    return Expectation.model_validate({"name": "e", "assert": body, "on_failure": on_failure})


@pytest.mark.parametrize(("body", "holds"), [({"row_count": {">=": 2}}, True), ({"row_count": {"<": 2}}, False), ({"column": "x", "not_null": True}, False), ({"column": "x", "unique": True}, True), ({"column": "x", "min": 1}, True), ({"column": "x", "min": 2}, False), ({"column": "x", "max": "0.5"}, False), ({"column": "x", "allowed": [1.0]}, True), ({"column": "x", "allowed": []}, False), ({"column": "x", "null_rate_below": 0.5}, False), ({"column": "x", "null_rate_below": 0.6}, True)])
def test_expectations(frame, body, holds):
    df = frame("x double", (1.0,), (None,))
    if holds:
        assert check_expectations(df, [expectation(**body)]) == []
    else:
        assert len(check_expectations(df, [expectation("warn", **body)])) == 1
        with pytest.raises(ExpectationError, match="expectation e"):
            check_expectations(df, [expectation(**body)])


def test_expectations_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert check_expectations(df, [expectation(column="x", null_rate_below=0.1, not_null=True)]) == []
    for body in ({"column": "zzz", "unique": True}, {"row_count": {"~": 1}}):
        with pytest.raises(ExpectationError):
            check_expectations(df, [expectation(**body)])
