"""Determinant, inverse and eigenvalues of matrix columns, as Arrow functions over numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _squares(nrow: pd.Series, ncol: pd.Series, data: pd.Series):
    for n, m, x in zip(nrow, ncol, data):
        yield None if x is None or n != m or len(x) != n * m else np.asarray(x, float).reshape(n, m)


def _each(f):
    def apply(nrow: pd.Series, ncol: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else f(a) for a in _squares(nrow, ncol, data)], dtype="object")

    return apply


def _inverse(a):
    try:
        return np.linalg.inv(a).ravel()
    except np.linalg.LinAlgError:
        return None


def _eigen(a):
    """Real and imaginary part of each eigenvalue, row by row, in order."""
    v = np.linalg.eigvals(a)
    v = v[np.lexsort((v.imag, v.real))]
    return np.stack([v.real, v.imag], 1).ravel()


_ARRAY = T.ArrayType(T.DoubleType())
_det = F.pandas_udf(_each(lambda a: float(np.linalg.det(a))), T.DoubleType())
_inv = F.pandas_udf(_each(_inverse), _ARRAY)
_eig = F.pandas_udf(_each(_eigen), _ARRAY)


def det(m):
    return _det(m["nrow"], m["ncol"], m["data"])


def inverse(m):
    """Row-major inverse; NULL for a singular matrix or one that is not square."""
    return _inv(m["nrow"], m["ncol"], m["data"])


def eigenvalues(m):
    return _eig(m["nrow"], m["ncol"], m["data"])
