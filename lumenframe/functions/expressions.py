"""Arithmetic expressions over column names, as users write them for data frames.

The text is read by Python's own parser and mapped node by node to columns;
nothing else than the listed operators, numbers and column names is accepted.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import as_double, is_numeric, dtype, require_columns

_QUOTED_NAME = re.compile(r"`([^`]+)`")


def _double(x: Column) -> Column:
    return x.cast("double")


_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(_double(a), _double(b)),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(_double(a), _double(b))),
    # The remainder has the divisor's sign; a power that is not a real number is missing.
    ast.Mod: lambda a, b: F.when(b != 0, F.when((a % b != 0) & ((a % b < 0) != (b < 0)), a % b + b).otherwise(a % b)),
    ast.Pow: lambda a, b: F.nanvl(F.pow(a, b), F.lit(None).cast("double")),
    ast.BitAnd: lambda a, b: a & b,
    ast.BitOr: lambda a, b: a | b,
}
_COMPARE = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def arithmetic(df: DataFrame, text: str) -> Column:
    """A column for ``text``; division by zero gives null."""
    names: dict[str, str] = {}

    def hide(match: re.Match) -> str:
        key = f"__quoted_{len(names)}"
        names[key] = match.group(1)
        return key

    try:
        tree = ast.parse(_QUOTED_NAME.sub(hide, text).strip(), mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"Feature creation failed: {error.msg}") from error

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Name(id=name):
                column = names.get(name, name)
                require_columns(df, column)
                if not is_numeric(dtype(df, column)):
                    return F.col("`" + column + "`")
                return as_double(df, column)
            case ast.Constant(value=bool() | int() | float() as number):
                return F.lit(float(number)) if not isinstance(number, bool) else F.lit(number)
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -build(inner)
            case ast.UnaryOp(op=ast.UAdd(), operand=inner):
                return build(inner)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](build(a), build(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](build(a), build(b))
        raise ValueError(f"Feature creation failed: '{ast.unparse(node)}' is not supported.")

    return build(tree)
