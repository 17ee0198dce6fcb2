"""Matrix expressions, bound to embeddings as 1 by 64 and 8 by 8 matrices of rounded numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import matrix as M
from tidewell.operators import tiles
from tidewell.registry import query
from tidewell.sources.tables import table

_SQL_V = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100) AS BIGINT)) AS v FROM embeddings)"


def _vectors(spark, d):
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 100))
    return table(spark, d, "embeddings").select("vec_id", v.alias("v"))


def _listed(m):
    return F.array_join(F.transform(m["data"], lambda x: x.cast("long").cast("string")), ",")


@query(
    "mx_elementwise",
    f"""SELECT vec_id, array_to_string(list_transform(v, lambda x: x + x * x - 3), ',') AS sums, array_to_string(list_transform(v, lambda x: -x), ',') AS negated,
        array_to_string(list_transform(v, lambda x: CASE WHEN x >= 5 THEN x ELSE 0 END), ',') AS masked FROM {_SQL_V}""",
)
def mx_elementwise(spark, d):
    v = M.row_vector(F.col("v"))
    scalar = lambda x: M.matrix(1, 1, F.array(F.lit(x)))
    sums = M.subtract(M.add(v, M.times(v, v)), scalar(3.0))
    masked = M.mask(v, M.compare(v, scalar(5.0), lambda x, y: x >= y))
    return _vectors(spark, d).select("vec_id", _listed(sums).alias("sums"), _listed(M.negate(v)).alias("negated"), _listed(masked).alias("masked"))


@query(
    "mx_multiply",
    f"""SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda i: CAST(list_sum(list_transform(range(0, 8), lambda k: v[(i // 8) * 8 + k + 1] * v[k * 8 + i % 8 + 1])) AS BIGINT)), ',') AS product,
        CAST(list_sum(list_transform(range(0, 8), lambda i: v[i * 9 + 1])) AS BIGINT) AS trace FROM {_SQL_V}""",
)
def mx_multiply(spark, d):
    m = M.matrix(8, 8, F.col("v"))
    return _vectors(spark, d).select("vec_id", _listed(M.multiply(m, m)).alias("product"), M.trace(m).cast("long").alias("trace"))


@query(
    "mx_shape",
    f"""SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda i: v[(i % 8) * 8 + i // 8 + 1]), ',') AS transposed,
        array_to_string(list_transform(range(0, 8), lambda j: CAST(list_sum(list_transform(range(0, 8), lambda i: v[i * 8 + j + 1])) AS BIGINT)), ',') AS sums,
        array_to_string(list_filter(range(0, 64), lambda i: v[i + 1] <> 0), ',') AS places, array_to_string(v || v[1:36], ',') AS resized FROM {_SQL_V}""",
)
def mx_shape(spark, d):
    m = M.matrix(8, 8, F.col("v"))
    return _vectors(spark, d).select(
        "vec_id", _listed(M.transpose(m)).alias("transposed"), _listed(M.column_sums(m)).alias("sums"),
        _listed(M.where(m)).alias("places"), _listed(M.resize(m, 10, 10)).alias("resized"),
    )


@query(
    "mx_gram_long",
    f"""WITH c AS (SELECT vec_id AS i, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM {_SQL_V})
        SELECT a.j AS i, b.j AS j, CAST(sum(a.x * b.x) AS DOUBLE) AS value FROM c a JOIN c b ON a.i = b.i GROUP BY 1, 2 HAVING sum(a.x * b.x) <> 0""",
)
def mx_gram_long(spark, d):
    """The transposed matrix of all embeddings times itself, a row a cell."""
    cells = tiles.cells(_vectors(spark, d), "vec_id", "v")
    return tiles.multiply(tiles.transpose(cells), cells)


@query(
    "mx_square_long",
    f"""WITH m AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CAST(list_sum(list_transform(range(0, 8), lambda k: v[(i // 8) * 8 + k + 1] * v[k * 8 + i % 8 + 1])) AS DOUBLE)) AS p FROM {_SQL_V}),
        c AS (SELECT vec_id, unnest(p) AS value, generate_subscripts(p, 1) - 1 AS n FROM m)
        SELECT vec_id, n // 8 AS i, n % 8 AS j, value FROM c WHERE value <> 0""",
)
def mx_square_long(spark, d):
    """Each embedding as a matrix of eight rows, times itself: what mx_multiply gives, a row a cell, by tiles of five."""
    cells = tiles.cells(_vectors(spark, d), "vec_id", "v")
    square = cells.select(F.col("i").alias("vec_id"), F.floor(F.col("j") / 8).alias("i"), (F.col("j") % 8).cast("long").alias("j"), "value")
    return tiles.multiply(square, square, ["vec_id"], tile=5)
