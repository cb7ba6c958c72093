"""Arithmetic texts as columns, and tools for lists of named values. Python's own grammar reads the text; nothing of it is run."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a sign between or before two terms means; ``^`` is exclusive or, as in the grammar, and ``**`` a power.
SIGNS: dict[type, Callable[..., Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a / b,
    ast.Pow: F.pow,
    ast.BitXor: lambda a, b: a.cast("bigint").bitwiseXOR(b.cast("bigint")),
    ast.USub: lambda a: -a,
}


def formula(text: str) -> Column:
    """``text`` as a column of whole numbers, column names, ``+ - * / ** ^``, signs and brackets. Anything else is an error, as is a text that does not parse."""
    try:
        return _column(ast.parse(text.strip(), mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"no formula: {text}") from e


def _column(node: ast.expr) -> Column:
    if isinstance(node, ast.Constant) and type(node.value) is int:
        return F.lit(node.value)
    if isinstance(node, ast.Name):
        return F.col(node.id)
    sign, terms = (node.op, [node.left, node.right]) if isinstance(node, ast.BinOp) else (node.op, [node.operand]) if isinstance(node, ast.UnaryOp) else (None, [])
    if type(sign) not in SIGNS:
        raise ValueError(f"not in a formula: {ast.unparse(node)}")
    return SIGNS[type(sign)](*map(_column, terms))


def by_key(items: Column, key: str, value: str | None = None) -> Column:
    """A map of an array of structs from ``key`` to ``value``, or to the whole struct; items without either are left out, of equal keys the last one stays."""
    held = F.filter(items, lambda x: x[key].isNotNull() if value is None else x[key].isNotNull() & x[value].isNotNull())
    last = F.filter(held, lambda x, i: ~F.exists(F.slice(held, i + 2, F.size(held) + 1), lambda y: y[key] == x[key]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x[key], x if value is None else x[value])))


def either(condition: Column, yes: Column, no: Column) -> Column:
    """``yes`` where the condition holds, ``no`` where it does not or is null."""
    return F.when(condition, yes).otherwise(no)
