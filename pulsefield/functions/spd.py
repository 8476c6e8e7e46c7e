"""Symmetric positive definite matrices: floors, inverses and square roots, in numpy and as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARRAY = T.ArrayType(T.DoubleType(), False)


def clamp_spd(sigma: np.ndarray, floor) -> tuple[np.ndarray, np.ndarray]:
    """Symmetrised matrices (n, d, d) with eigenvalues of at least floor (one or n), and the ids that had to change.

    A matrix that already meets its floor is returned as its symmetric part, bit for bit.
    """
    s = np.asarray(sigma, float)
    one = s.ndim == 2
    s = s[None] if one else s
    floors = np.broadcast_to(np.asarray(floor, float), len(s))
    if not (floors > 0).all():
        raise ValueError("clamp_spd: floors must be > 0")
    s = 0.5 * (s + s.transpose(0, 2, 1))
    w, q = np.linalg.eigh(s) if len(s) else (np.zeros((0, s.shape[1])), s)
    low = w.min(1, initial=np.inf) < floors
    out = s.copy()
    out[low] = np.einsum("nij,nj,nkj->nik", q[low], np.maximum(w[low], floors[low, None]), q[low])
    return (out[0] if one else out), np.flatnonzero(low)


def spd_parts(sigma: np.ndarray) -> dict[str, np.ndarray]:
    """inv, sqrt, inv_sqrt and det of a stack of SPD matrices, and their least eigenvalues."""
    w, q = np.linalg.eigh(sigma)
    of = lambda v: np.einsum("nij,nj,nkj->nik", q, v, q)
    safe = np.where(w > 0, w, np.nan)
    return {"low": w.min(1), "inv": of(1 / safe), "sqrt": of(np.sqrt(safe)), "inv_sqrt": of(1 / np.sqrt(safe)), "det": w.prod(1)}


def min_eigenvalue(s: Column, d: int) -> Column:
    """Least eigenvalue of a flat symmetric column; closed form up to two dimensions."""
    if d == 1:
        return s[0]
    if d == 2:
        b = (s[1] + s[2]) / 2
        return (s[0] + s[3] - F.sqrt((s[0] - s[3]) * (s[0] - s[3]) + 4 * b * b)) / 2
    return _eigen("low", d)(s)[0]


def _eigen(what: str, d: int):
    """An Arrow UDF for three and more dimensions."""

    @F.pandas_udf(ARRAY)
    def f(col):
        import pandas as pd

        x = np.stack(col.to_numpy()).reshape(-1, d, d) if len(col) else np.zeros((0, d, d))
        got = spd_parts(0.5 * (x + x.transpose(0, 2, 1)))[what] if len(x) else x
        return pd.Series(list(got.reshape(len(x), -1)))

    return f


def with_parts(df: DataFrame, sigma: str, d: int, prefix: str = "sigma_") -> DataFrame:
    """df with sigma symmetrised and flat columns inv, sqrt, inv_sqrt and the scalar det of it."""
    if d <= 2:
        s = F.col(sigma)
        if d == 1:
            a = s[0]
            return df.withColumns({prefix + "inv": F.array(1 / a), prefix + "sqrt": F.array(F.sqrt(a)), prefix + "inv_sqrt": F.array(1 / F.sqrt(a)), prefix + "det": a})
        df = df.withColumn(sigma, F.when(s.isNotNull(), F.array(s[0], (s[1] + s[2]) / 2, (s[1] + s[2]) / 2, s[3])))
        a, b, c = s[0], s[1], s[3]
        det = a * c - b * b
        root = F.sqrt(det)
        trace = F.sqrt(a + c + 2 * root)
        up = lambda x: F.when(s.isNotNull(), x)
        return df.withColumns(
            {
                prefix + "inv": up(F.array(c / det, -b / det, -b / det, a / det)),
                prefix + "sqrt": up(F.array((a + root) / trace, b / trace, b / trace, (c + root) / trace)),
                prefix + "inv_sqrt": up(F.array((c + root) / (trace * root), -b / (trace * root), -b / (trace * root), (a + root) / (trace * root))),
                prefix + "det": det,
            }
        )
    return df.withColumns({prefix + k: _eigen(k, d)(F.col(sigma)) for k in ("inv", "sqrt", "inv_sqrt")} | {prefix + "det": _eigen("det", d)(F.col(sigma))[0]})


def clamp_column(df: DataFrame, sigma: str, floor: Column | float, d: int) -> DataFrame:
    """df with sigma's eigenvalues raised to floor and a column modified; rows that meet it keep their symmetric part."""
    s, f = F.col(sigma), floor if isinstance(floor, Column) else F.lit(float(floor))
    if d == 1:
        return df.withColumn("modified", s[0] < f).withColumn(sigma, F.array(F.greatest(s[0], f)))
    if d == 2:
        df = df.withColumn(sigma, F.array(s[0], (s[1] + s[2]) / 2, (s[1] + s[2]) / 2, s[3]))
        a, b, c = s[0], s[1], s[3]
        gap = F.sqrt((a - c) * (a - c) + 4 * b * b)
        lo, hi = (a + c - gap) / 2, (a + c + gap) / 2
        # With eigenvalues raised, f(S) = p S + q I, where p and q interpolate f at both eigenvalues.
        p = F.when(gap > 0, (F.greatest(hi, f) - F.greatest(lo, f)) / gap).otherwise(0.0)
        q = F.greatest(lo, f) - p * lo
        df = df.withColumn("modified", lo < f)
        return df.withColumn(sigma, F.when(F.col("modified"), F.array(p * a + q, p * b, p * b, p * c + q)).otherwise(s))

    @F.pandas_udf(T.StructType([T.StructField("s", ARRAY), T.StructField("m", T.BooleanType())]))
    def raise_to(col, low):
        import pandas as pd

        x = np.stack(col.to_numpy()).reshape(-1, d, d)
        out, ids = clamp_spd(x, low.to_numpy())
        m = np.zeros(len(x), bool)
        m[ids] = True
        return pd.DataFrame({"s": list(out.reshape(len(x), -1)), "m": m})

    df = df.withColumn("__c", raise_to(s, f))
    return df.withColumns({sigma: F.col("__c.s"), "modified": F.col("__c.m")}).drop("__c")
