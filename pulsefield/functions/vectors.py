"""Fixed-length vectors and flat row-major matrices as plain column arithmetic, which stays inside generated code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list[Column]


def vec(col: Column | str, d: int) -> Vec:
    c = F.col(col) if isinstance(col, str) else col
    return [c[i] for i in range(d)]


def pack(v: Vec) -> Column:
    return F.array(*v)


def plus(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b, strict=True)]


def minus(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b, strict=True)]


def total(xs) -> Column:
    return reduce(add, xs)


def dot(a: Vec, b: Vec) -> Column:
    return total(x * y for x, y in zip(a, b, strict=True))


def times(m: Vec, v: Vec) -> Vec:
    d = len(v)
    return [dot(m[i * d : (i + 1) * d], v) for i in range(len(m) // d)]


def product(a: Vec, b: Vec, d: int) -> Vec:
    return [total(a[i * d + k] * b[k * d + j] for k in range(d)) for i in range(d) for j in range(d)]


def quadratic(m: Vec, v: Vec) -> Column:
    return dot(v, times(m, v))


def minor(m: Vec, d: int, i: int, j: int) -> Vec:
    return [m[r * d + c] for r in range(d) for c in range(d) if r != i and c != j]


def det(m: Vec, d: int) -> Column:
    if d == 1:
        return m[0]
    return total((m[j] if j % 2 == 0 else -m[j]) * det(minor(m, d, 0, j), d - 1) for j in range(d))


def inverse(m: Vec, d: int) -> Vec:
    whole = det(m, d)
    if d == 1:
        return [1 / whole]
    return [(1 if (i + j) % 2 == 0 else -1) * det(minor(m, d, j, i), d - 1) / whole for i in range(d) for j in range(d)]


def weighted(alpha: Column, values: Column, corners: int, width: int) -> Vec:
    """Barycentric sums of per-corner vectors that stand in one flat array, corners in fixed order."""
    return [total(alpha[k] * values[k * width + i] for k in range(corners)) for i in range(width)]
