"""Expression trees of ``derive`` compiled to columns."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError, RegistryError
from ..registry import EXPRESSIONS, register_expression
from . import pipe
from .frames import col, is_number, require, type_of

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Expression:
    """Compiles trees against a frame."""

    def __init__(self, df: DataFrame):
        self.df = df

    def compile(self, node: Any) -> Column:
        if not isinstance(node, dict):
            return self._plain(node)
        if len(node) != 1:
            raise ExpressionError(f"an expression has one key: {node!r}")
        ((key, body),) = node.items()
        if key == "col":
            require(self.df, [body], "expression")
            return col(body)
        if key == "lit":
            return F.lit(body)
        if key == "pipe":
            found = pipe.operand(self.df, "${pipe:" + str(body) + "}")
            if found is None or isinstance(found, DataFrame):
                raise ExpressionError(f"a list can't be used in an expression: {body!r}")
            return found
        args = body if isinstance(body, list) else [body]
        if key in _ARITHMETIC:
            if len(args) < 2:
                raise ExpressionError(f"{key} takes two operands or more")
            return reduce(lambda a, b: _ARITHMETIC[key](self, a, b), map(self.compile, args))
        try:
            fn = EXPRESSIONS.get(key)
        except RegistryError as e:
            raise ExpressionError(str(e)) from None
        if getattr(fn, "takes_literals", False):
            return fn(self.compile(args[0]), *[a["lit"] if isinstance(a, dict) and "lit" in a else a for a in args[1:]]) if args else fn()
        return fn(*map(self.compile, args))

    def _plain(self, value: Any) -> Column:
        found = pipe.operand(self.df, value)
        if isinstance(found, DataFrame):
            raise ExpressionError("a list can't be used in an expression")
        return F.lit(value) if found is None else found

    def _kinds(self, a: Column, b: Column) -> tuple[T.DataType, T.DataType]:
        return type_of(self.df, a), type_of(self.df, b)

    def _numbers(self, op: str, a: Column, b: Column) -> None:
        for kind in self._kinds(a, b):
            if not is_number(kind) and not isinstance(kind, T.NullType | T.BooleanType):
                raise ExpressionError(f"{op} can't take {kind.simpleString()}")

    def add(self, a: Column, b: Column) -> Column:
        kinds = self._kinds(a, b)
        texts = [isinstance(k, T.StringType) for k in kinds]
        if all(texts):
            return F.concat(a, b)
        if any(texts):
            raise ExpressionError("+ can't mix text and other types; use concat")
        self._numbers("+", a, b)
        return a + b

    def subtract(self, a: Column, b: Column) -> Column:
        self._numbers("-", a, b)
        return a - b

    def multiply(self, a: Column, b: Column) -> Column:
        self._numbers("*", a, b)
        return a * b

    def divide(self, a: Column, b: Column) -> Column:
        """True division; by zero it is infinite, and zero by zero is missing."""
        self._numbers("/", a, b)
        x, y = a.cast("double"), b.cast("double")
        inf = float("inf")
        return F.when(y == 0, F.when(x > 0, F.lit(inf)).when(x < 0, F.lit(-inf))).otherwise(F.try_divide(x, y))

    def modulo(self, a: Column, b: Column) -> Column:
        """The sign is the divisor's; by zero it is missing."""
        self._numbers("%", a, b)
        rest = F.try_mod(a, b)
        return F.when(b != 0, F.try_mod(rest + b, b))


_ARITHMETIC = {"+": Expression.add, "-": Expression.subtract, "*": Expression.multiply, "/": Expression.divide, "%": Expression.modulo}


def compile_expression(df: DataFrame, tree: Any) -> Column:
    return Expression(df).compile(tree)


@register_expression("round")
def _round(x: Column, digits: int = 0) -> Column:
    """Half to even."""
    if not isinstance(digits, int):
        raise ExpressionError("round takes a whole number of digits")
    return F.bround(x, digits)


_round.takes_literals = True


@register_expression("abs")
def _abs(x: Column) -> Column:
    return F.abs(x)


@register_expression("coalesce")
def _coalesce(*xs: Column) -> Column:
    if not xs:
        raise ExpressionError("coalesce takes an argument or more")
    return F.coalesce(*xs)


@register_expression("nullif")
def _nullif(x: Column, y: Column) -> Column:
    """The first, or missing where both are equal."""
    return F.nullif(x, y)


@register_expression("concat")
def _concat(*xs: Column) -> Column:
    return F.concat(*(x.cast("string") for x in xs))


@register_expression("lower")
def _lower(x: Column) -> Column:
    return F.lower(x.cast("string"))


@register_expression("upper")
def _upper(x: Column) -> Column:
    return F.upper(x.cast("string"))


@register_expression("length")
def _length(x: Column) -> Column:
    return F.length(x.cast("string")).cast("long")


def vectorised(return_type: str):
    """Wraps a function over pandas Series as an expression function (an Arrow UDF)."""

    def wrap(fn):
        from pyspark.sql.functions import pandas_udf

        return pandas_udf(fn, return_type)

    return wrap
