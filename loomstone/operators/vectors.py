"""Vector arithmetic on array columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _with(value: Column, f) -> Column:
    """f(value), with the value computed once: inside a lambda an outer expression is computed for every element."""
    return F.transform(F.array(value), f)[0]


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, e: s + e)


def _shifted(v: Column, f) -> Column:
    """f of v less its maximum."""
    return _with(v, lambda u: _with(F.array_max(u), lambda top: f(F.transform(u, lambda x: x - top))))


def softmax(v: Column) -> Column:
    scaled = lambda e: _with(_sum(e), lambda s: F.transform(e, lambda x: x / s))
    return _shifted(v, lambda u: _with(F.transform(u, F.exp), scaled))


def log_softmax(v: Column) -> Column:
    less = lambda u: _with(F.log(_sum(F.transform(u, F.exp))), lambda norm: F.transform(u, lambda x: x - norm))
    return _shifted(v, lambda u: _with(u, less))


def cross_entropy(v: Column, target: Column) -> Column:
    return -F.element_at(log_softmax(v), target + 1)


def rms_norm(v: Column, eps: float = 1e-5) -> Column:
    size = lambda u: F.sqrt(_sum(F.transform(u, lambda x: x * x)) / F.size(u) + F.lit(eps))
    return _with(v, lambda u: _with(size(u), lambda s: F.transform(u, lambda x: x / s)))


def rotate_pairs(v: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotates each adjacent pair (2j, 2j + 1) by position * theta^(-2j / size)."""

    def rotated(u: Column, n: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            angle = position * F.pow(F.lit(theta), -(2.0 * F.floor(i / 2)) / n)
            other = F.get(u, F.when(i % 2 == 0, i + 1).otherwise(i - 1).cast("int"))
            return x * F.cos(angle) + F.when(i % 2 == 0, -other).otherwise(other) * F.sin(angle)

        return F.transform(u, at)

    return _with(v, lambda u: _with(F.size(u), lambda n: rotated(u, n)))


def swish_gate(gate: Column, up: Column) -> Column:
    return F.zip_with(gate, up, lambda g, u: g / (F.lit(1.0) + F.exp(-g)) * u)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))
