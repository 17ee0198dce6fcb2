"""Matrices as struct<nrow, ncol, data> columns, data row by row; each operator is a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(nrow, ncol, data: Column) -> Column:
    as_int = lambda x: x.cast("int") if isinstance(x, Column) else F.lit(x).cast("int")
    return F.struct(as_int(nrow).alias("nrow"), as_int(ncol).alias("ncol"), data.cast("array<double>").alias("data"))


def row_vector(data: Column) -> Column:
    return matrix(1, F.size(data), data)


def _same(a: Column, f) -> Column:
    return matrix(a["nrow"], a["ncol"], F.transform(a["data"], f))


def elementwise(a: Column, b: Column, f) -> Column:
    """f of elements; a 1 by 1 matrix meets every element; other shapes must agree, else NULL."""
    one = lambda m: (m["nrow"] == 1) & (m["ncol"] == 1)
    return (
        F.when(one(b), matrix(a["nrow"], a["ncol"], F.transform(a["data"], lambda x: f(x, b["data"][0]))))
        .when(one(a), matrix(b["nrow"], b["ncol"], F.transform(b["data"], lambda x: f(a["data"][0], x))))
        .when(
            (a["nrow"] == b["nrow"]) & (a["ncol"] == b["ncol"]),
            matrix(a["nrow"], a["ncol"], F.zip_with(a["data"], b["data"], f)),
        )
    )


def add(a, b):
    return elementwise(a, b, lambda x, y: x + y)


def subtract(a, b):
    return elementwise(a, b, lambda x, y: x - y)


def times(a, b):
    return elementwise(a, b, lambda x, y: x * y)


def divide(a, b):
    """IEEE: x / 0 is an infinity, 0 / 0 is NaN."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    over_zero = lambda x: F.when(x > 0, inf).when(x < 0, -inf).otherwise(nan)
    return elementwise(a, b, lambda x, y: F.when(y != 0, x / F.when(y != 0, y)).otherwise(over_zero(x)))


def compare(a, b, f):
    """1 where f holds of elements, else 0."""
    return elementwise(a, b, lambda x, y: F.when(f(x, y), 1.0).otherwise(0.0))


def mask(a, b):
    """a where b is not 0, else 0; of equal shapes."""
    return elementwise(a, b, lambda x, y: F.when(y != 0, x).otherwise(0.0))


def power(a: Column, n) -> Column:
    return _same(a, lambda x: F.pow(x, F.lit(n)))


def negate(a: Column) -> Column:
    return _same(a, lambda x: -x)


def logical_and(a: Column, b: Column) -> Column:
    """1 where both are not 0, else 0; of equal shapes."""
    return elementwise(a, b, lambda x, y: F.when((x != 0) & (y != 0), 1.0).otherwise(0.0))


def logical_or(a: Column, b: Column) -> Column:
    """1 where either is not 0, else 0; of equal shapes."""
    return elementwise(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0))


def logical_not(a: Column) -> Column:
    """The first element alone decides: 1 everywhere where it is 0, else 0."""
    return _same(a, lambda _: F.when(a["data"][0] == 0, 1.0).otherwise(0.0))


#: Functions of one element by name; log is that of base ten. Outside of their range they give NaN.
FUNCTIONS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "exp": F.exp, "ln": lambda x: F.coalesce(F.ln(x), F.lit(float("nan"))), "log": lambda x: F.coalesce(F.log10(x), F.lit(float("nan"))),
    "sqrt": F.sqrt, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "abs": F.abs,
}


def apply(a: Column, f) -> Column:
    """A function of columns, such as F.sin, or one of FUNCTIONS by its name, of each element."""
    return _same(a, FUNCTIONS[f] if isinstance(f, str) else f)


def atan2(a: Column, b: Column) -> Column:
    return elementwise(a, b, F.atan2)


def modulo(a: Column, b: Column) -> Column:
    """What is left of a division, with the sign of what is divided; NaN by 0."""
    return elementwise(a, b, lambda x, y: F.when(y != 0, x % F.when(y != 0, y)).otherwise(F.lit(float("nan"))))


def element(a: Column, row: int, column: int | None = None) -> Column:
    """Element at a place, from 0; with one index of the first row; NULL outside."""
    if column is None:
        row, column = 0, row
    inside = (F.lit(row) < a["nrow"]) & (F.lit(column) < a["ncol"])
    return F.when(inside, F.get(a["data"], F.lit(row) * a["ncol"] + column))


def _by_column(a: Column, of) -> Column:
    """A function of each column's elements; of a vector, of all."""
    vector = (a["nrow"] == 1) | (a["ncol"] == 1)
    column = lambda j: F.transform(F.sequence(F.lit(0), a["nrow"] - 1), lambda i: a["data"][i * a["ncol"] + j])
    many = F.transform(F.sequence(F.lit(0), a["ncol"] - 1), lambda j: of(column(j)))
    return F.when(vector, matrix(1, 1, F.array(of(a["data"])))).otherwise(matrix(1, a["ncol"], many))


def least(a: Column) -> Column:
    """Smallest element of each column; of a vector, of all."""
    return _by_column(a, F.array_min)


def most(a: Column) -> Column:
    return _by_column(a, F.array_max)


def transpose(a: Column) -> Column:
    n = a["nrow"] * a["ncol"]
    at = lambda i: a["data"][((i % a["nrow"]) * a["ncol"] + F.floor(i / a["nrow"])).cast("int")]
    return matrix(a["ncol"], a["nrow"], F.transform(F.sequence(F.lit(0), n - 1), at))


def multiply(a: Column, b: Column) -> Column:
    """Matrix product; NULL where the inner sizes differ."""
    def cell(i):
        row, col = F.floor(i / b["ncol"]).cast("int"), i % b["ncol"]
        return F.aggregate(
            F.sequence(F.lit(0), a["ncol"] - 1),
            F.lit(0.0),
            lambda s, k: s + a["data"][row * a["ncol"] + k] * b["data"][k * b["ncol"] + col],
        )

    cells = F.transform(F.sequence(F.lit(0), a["nrow"] * b["ncol"] - 1), cell)
    return F.when(a["ncol"] == b["nrow"], matrix(a["nrow"], b["ncol"], cells))


def resize(a: Column, nrow: int, ncol: int) -> Column:
    """Another shape, filled by the elements in turn."""
    return matrix(nrow, ncol, F.transform(F.sequence(F.lit(0), F.lit(nrow * ncol - 1)), lambda i: a["data"][i % F.size(a["data"])]))


def span(first: int, last: int) -> Column:
    """Integers from first to last, up or down."""
    return row_vector(F.sequence(F.lit(first), F.lit(last)))


def join(*parts: Column) -> Column:
    """One row of all elements."""
    return row_vector(F.flatten(F.array(*[p["data"] for p in parts])))


def where(a: Column) -> Column:
    """Indexes, from 0, of elements that are not 0."""
    n = F.size(a["data"])
    return row_vector(F.filter(F.sequence(F.lit(0), n - 1), lambda i: a["data"][i] != 0))


def column_sums(a: Column) -> Column:
    """Sum of each column; of a vector, of all elements."""
    vector = (a["nrow"] == 1) | (a["ncol"] == 1)
    total = F.aggregate(a["data"], F.lit(0.0), lambda s, x: s + x)
    by = F.transform(
        F.sequence(F.lit(0), a["ncol"] - 1),
        lambda j: F.aggregate(F.sequence(F.lit(0), a["nrow"] - 1), F.lit(0.0), lambda s, i: s + a["data"][i * a["ncol"] + j]),
    )
    return F.when(vector, matrix(1, 1, F.array(total))).otherwise(matrix(1, a["ncol"], by))


def trace(a: Column) -> Column:
    n = F.least(a["nrow"], a["ncol"])
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + a["data"][i * a["ncol"] + i])


def eye(n: int) -> Column:
    return matrix(n, n, F.array(*[F.lit(1.0 if i // n == i % n else 0.0) for i in range(n * n)]))
