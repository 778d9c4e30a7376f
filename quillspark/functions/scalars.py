"""Scalar feature operators: name, arity and the Column each one builds.

Values follow IEEE arithmetic (division by zero gives an infinity, a logarithm of zero times its sign NaN), which
plain Spark expressions don't under ANSI mode; NULL stays NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the largest float32.
FLOAT32_MAX = 3.4028234663852886e38


@dataclass(frozen=True)
class Operator:
    """``sign`` joins the arguments of a binary operator in names; a unary one is written as a call."""

    name: str
    arity: int
    build: Callable[..., Column]
    sign: str = ""


def reciprocal(x: Column) -> Column:
    infinity = F.when(x.cast("string") == "-0.0", float("-inf")).otherwise(float("inf"))
    return F.when(x == 0, infinity).otherwise(F.lit(1.0) / F.when(x != 0, x))


def signed_sqrt(x: Column) -> Column:
    return F.sqrt(F.abs(x)) * F.signum(x) + F.lit(0.0)


def signed_log(x: Column) -> Column:
    return F.when((x == 0) | F.isnan(x), float("nan")).otherwise(F.ln(F.abs(x)) * F.signum(x))


def clamp_float32(x: Column) -> Column:
    high, low = F.lit(FLOAT32_MAX), F.lit(-FLOAT32_MAX)
    return F.when(F.isnan(x), x).when(x > high, high).when(x < low, low).otherwise(x).cast("float")


#: The operators that generation draws from, in the order of their weights.
DRAWN = [
    Operator("multiply", 2, lambda a, b: a * b, "*"),
    Operator("add", 2, lambda a, b: a + b, "+"),
    Operator("subtract", 2, lambda a, b: a - b, "-"),
    Operator("abs", 1, F.abs),
    Operator("square", 1, lambda a: a * a),
]
#: Further operators, which a caller may add to those drawn.
FURTHER = [
    Operator("identity", 1, lambda a: a),
    Operator("cube", 1, lambda a: a * a * a),
    Operator("reciprocal", 1, reciprocal),
    Operator("signed_sqrt", 1, signed_sqrt),
    Operator("signed_log", 1, signed_log),
    Operator("clamp_float32", 1, clamp_float32),
]
REGISTRY: dict[str, Operator] = {o.name: o for o in [*DRAWN, *FURTHER]}


def register(operator: Operator) -> None:
    """Makes an operator of one's own known by name."""
    if operator.arity not in (1, 2):
        raise ValueError("an operator takes one or two columns")
    REGISTRY[operator.name] = operator
