"""Formula and condition text of a rule as a Spark column.

Rule authors write arithmetic and comparisons in Python notation. The text is parsed by the standard
``ast`` module and only the node kinds below are accepted, so no text is ever executed.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """The text uses something outside the accepted notation, or a name the row does not have."""


_ARITHMETIC = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: F.try_divide,
    ast.Mod: F.try_mod,
    ast.Pow: F.pow,
}
_COMPARE = {
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
    ast.Lt: operator.lt,
    ast.LtE: operator.le,
    ast.Gt: operator.gt,
    ast.GtE: operator.ge,
}
_CALLS = {
    "min": F.least,
    "max": F.greatest,
    "abs": F.abs,
    "round": F.round,
    "float": lambda c: c.cast("double"),
    "int": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)),
}


def parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, AttributeError) as error:
        raise FormulaError(f"cannot read {text!r}") from error


def names_in(text: str) -> set[str]:
    """Names the text refers to; an attribute such as ``customer.annual_income`` counts by its last part."""
    found = set()
    for node in ast.walk(parse(text)):
        if isinstance(node, ast.Attribute):
            found.add(node.attr)
        elif isinstance(node, ast.Name):
            found.add(node.id)
    return found - set(_CALLS) - {"customer"}


def formula(text: str, names: Mapping[str, Column]) -> Column:
    """Column for ``text``; division by zero and other arithmetic failures give null."""
    return _build(parse(text), names)


def _build(node: ast.expr, names: Mapping[str, Column]) -> Column:
    if isinstance(node, ast.Constant) and isinstance(node.value, (bool, str)):
        return F.lit(node.value)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        if node.id not in names:
            raise FormulaError(f"unknown name {node.id!r}")
        return names[node.id]
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "customer":
        return _build(ast.Name(id=node.attr), names)
    if isinstance(node, ast.UnaryOp):
        inner = _build(node.operand, names)
        if isinstance(node.op, ast.USub):
            return -inner
        if isinstance(node.op, ast.UAdd):
            return inner
        if isinstance(node.op, ast.Not):
            return ~inner
    if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
        return _ARITHMETIC[type(node.op)](_number(node.left, names), _number(node.right, names))
    if isinstance(node, ast.BoolOp):
        parts = [_build(value, names) for value in node.values]
        joined = parts[0]
        for part in parts[1:]:
            joined = joined & part if isinstance(node.op, ast.And) else joined | part
        return joined
    if isinstance(node, ast.Compare):
        return _compare(node, names)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
        return _CALLS[node.func.id](*[_build(arg, names) for arg in node.args])
    raise FormulaError(f"{ast.unparse(node)!r} is not allowed")


def _number(node: ast.expr, names: Mapping[str, Column]) -> Column:
    """An operand as a number; text that is none gives null instead of failing the job."""
    return _build(node, names).try_cast("double")


def _is(node: ast.expr, kind: type | tuple[type, ...]) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, kind) and not isinstance(node.value, bool)


def _sides(op: ast.cmpop, left: ast.expr, right: ast.expr, names: Mapping[str, Column]) -> tuple[Column, Column]:
    """Both sides of a comparison: numbers when ordered or compared with a number, else as they are."""
    ordered = not isinstance(op, (ast.Eq, ast.NotEq)) and not (_is(left, str) or _is(right, str))
    if ordered or _is(left, (int, float)) or _is(right, (int, float)):
        return _number(left, names), _number(right, names)
    return _build(left, names), _build(right, names)


def _compare(node: ast.Compare, names: Mapping[str, Column]) -> Column:
    joined = None
    left = node.left
    for op, right in zip(node.ops, node.comparators, strict=True):
        if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple)):
            test = _build(left, names).isin(*[_build(item, names) for item in right.elts])
            test = ~test if isinstance(op, ast.NotIn) else test
        elif type(op) in _COMPARE:
            test = _COMPARE[type(op)](*_sides(op, left, right, names))
        else:
            raise FormulaError(f"{ast.unparse(node)!r} is not allowed")
        joined = test if joined is None else joined & test
        left = right
    return joined
