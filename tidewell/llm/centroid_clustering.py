"""Exact Lloyd clustering of integer vectors by exponion search.

Vectors of DIMENSIONS finite components become integers floor(SCALE * x). The first
centroids are the vectors whose ids have the smallest hashes. A round assigns every
vector to its nearest centroid and moves each centroid to the floor of its vectors' mean.

A vector keeps its cluster a, an upper bound of the distance to a's centroid and a lower
bound of the distance to any other, which move with the centroids. Where the upper bound is
under the lower one, or under half the distance s from a's centroid to its nearest
neighbour, nothing is computed. Else the upper bound is made exact; if that doesn't
help, the centroids in the ball of radius 2 * upper + s around a's centroid are scanned, found
in the list of a's neighbours sorted by distance: the two nearest are among them. The
radius is inclusive and bounds are rounded outward, so that equally distant centroids
are always scanned, and of those the smaller number wins. Distances are compared as
integers.

A round is a pass over the written vectors and bounds, whose result is written in turn;
the one before is then deleted, so that about two copies exist. Centroids move by the sums
of vectors that came and left, in integers: the driver gets a row a centroid and component.
Once no vector moves, further rounds would change nothing and are left out.

Nulls: vectors that are null, of another length, or with a null or non-finite component are
left out. Rows of null id are clustered, but start no centroid. Rows that repeat an id count
each; of equal ids the smaller vector starts a centroid first. Fewer vectors than
centroids give as many centroids; centroids may be equal, and then those of greater
number stay empty and where they are. An empty table gives an empty result. Components
over LARGEST in size, whose distances would not fit 64 bits, raise an error. Columns other
than vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, scratch

DIMENSIONS, SCALE = 64, 1024
CENTROIDS, ROUNDS, SEED = 8, 10, 3
#: Integers beyond this, whose squared distances might exceed 64 bits, are refused.
LARGEST = 1 << 27
#: By how much bounds are rounded outward, as part of the value; doubles are off by some 1e-15 of it after the rounds.
MARGIN = 1e-9
#: Vectors whose distances are computed at a time.
AT_ONCE = 4096


def as_integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the vectors that are whole and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.filter((F.size("embedding") == dimensions) & F.forall("embedding", finite))
    large = F.exists("v", lambda x: F.abs(x) > LARGEST)
    scaled = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("double"))
    whole = kept.select("vec_id", scaled.alias("v"))
    refused = F.raise_error(F.lit(f"a vector has a component over {LARGEST} in size"))
    return whole.select("vec_id", F.when(large, refused).otherwise(F.col("v")).cast("array<long>").alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """Vectors of the k ids with the smallest SHA-256 of "seed:id", in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id is not null").select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def _squared(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to a row, or to rows one by one."""
    off = x - to
    return np.einsum("ij,ij->i", off, off)


@dataclass
class Geometry:
    """Centroids, and of each the others in order of distance."""

    centroids: np.ndarray  # int64, a row a centroid

    def __post_init__(self):
        k = len(self.centroids)
        between = np.sqrt(np.array([_squared(self.centroids, c) for c in self.centroids]).reshape(k, k).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        between *= 1 - MARGIN
        self.order = np.argsort(between, axis=1, kind="stable")[:, : k - 1]
        self.away = np.take_along_axis(between, self.order, 1)
        #: to the nearest other centroid, from below and from above
        self.nearest = self.away[:, 0] if k > 1 else np.full(k, np.inf)
        self.at_most = self.nearest * (1 + 3 * MARGIN)


def first_search(geometry: Geometry, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster and bounds of vectors that have none yet."""
    distances = np.array([_squared(x, c) for c in geometry.centroids]).T
    a = distances.argmin(1)  # the first of equals
    mine = distances[np.arange(len(x)), a]
    distances[np.arange(len(x)), a] = np.iinfo(np.int64).max
    other = np.sqrt(distances.min(1).astype(np.float64)) if len(geometry.centroids) > 1 else np.full(len(x), np.inf)
    return a, np.sqrt(mine.astype(np.float64)) * (1 + MARGIN), other * (1 - MARGIN)


def exponion_search(
    geometry: Geometry, moved: np.ndarray, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and bounds after the centroids moved so far (an upper bound each), and the number of distances computed."""
    k = len(moved)
    a, computed = a.copy(), 0
    # what the others moved at most
    by = np.argsort(moved)[::-1]
    others = np.where(np.arange(k) == by[0], moved[by[1]] if k > 1 else 0.0, moved[by[0]])
    upper = (upper + moved[a]) * (1 + MARGIN)
    lower = (lower - others[a]) - (np.abs(lower) + others[a]) * MARGIN if k > 1 else lower
    safe = np.maximum(lower, geometry.nearest[a] / 2)
    at = np.flatnonzero(upper >= safe)
    mine = _squared(x[at], geometry.centroids[a[at]])
    computed += len(at)
    upper[at] = np.sqrt(mine.astype(np.float64)) * (1 + MARGIN)
    open_ = upper[at] >= safe[at]
    at, mine = at[open_], mine[open_]
    around = a[at]
    for c in np.unique(around):
        rows, best = at[around == c], mine[around == c]
        radius = (2 * upper[rows] + geometry.at_most[c]) * (1 + MARGIN)
        reach = np.searchsorted(geometry.away[c], radius, "right")  # the ball is closed
        number, second = np.full(len(rows), c), np.full(len(rows), np.iinfo(np.int64).max)
        for t in range(int(reach.max(initial=0))):
            scan = np.flatnonzero(reach > t)
            j = int(geometry.order[c, t])
            found = _squared(x[rows[scan]], geometry.centroids[j])
            computed += len(scan)
            better = (found < best[scan]) | (found == best[scan]) & (j < number[scan])
            second[scan] = np.minimum(second[scan], np.where(better, best[scan], found))
            best[scan] = np.where(better, found, best[scan])
            number[scan] = np.where(better, j, number[scan])
        a[rows] = number
        upper[rows] = np.sqrt(best.astype(np.float64)) * (1 + MARGIN)
        lower[rows] = np.sqrt(second.astype(np.float64)) * (1 - MARGIN) if k > 1 else np.inf
    return a, upper, lower, computed


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy().astype(np.int64).reshape(len(v), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


_STATE = ["a", "was", "upper", "lower"]


def _assigner(geometry: Geometry, moved: np.ndarray | None):
    """Function that gives vec_id, v, a, was, upper, lower: the cluster, that of the round before (-1 in the first), and bounds."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _matrix(batch)
            if moved is None:
                was = np.full(len(x), -1, np.int32)
                a, upper, lower = first_search(geometry, x)
            else:
                was = batch.column("a").to_numpy()
                a, upper, lower, _ = exponion_search(geometry, moved, x, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            state = [pa.array(a.astype(np.int32)), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *state], ["vec_id", "v", *_STATE])

    return assign


def _changes(k: int):
    """Function that gives, a row a cluster and component that changed: the sum of what came less what left, and the count likewise."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, np.zeros(k, np.int64)
        for batch in _slices(batches):
            x = _matrix(batch)
            total = np.zeros((k, x.shape[1]), np.int64) if total is None else total
            for column, sign in (("a", 1), ("was", -1)):
                of = batch.column(column).to_numpy()
                for c in np.unique(of[of >= 0]):
                    total[c] += sign * x[of == c].sum(0)
                    count[c] += sign * int((of == c).sum())
        if total is not None:
            c, i = np.divmod(np.arange(total.size), total.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(total.reshape(-1)), pa.array(count[c])], ["c", "i", "total", "n"])

    return sums


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class Clustering:
    """Final centroids, and the vectors (vec_id, v) with their last cluster a."""

    centroids: np.ndarray
    assigned: DataFrame


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> Clustering:
    """Clusters integer vectors (vec_id, v), written before."""
    spark, centroids = vectors.sparkSession, first_centroids(vectors, k, seed)
    if not len(centroids):
        return Clustering(centroids, vectors.limit(0).withColumn("a", F.lit(0)))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    ddl = f"vec_id {kind}, v array<long>, a int, was int, upper double, lower double"
    k = len(centroids)
    total, count = np.zeros(centroids.shape, np.int64), np.zeros(k, np.int64)
    state, before, moved = vectors, None, None
    for r in range(rounds + 1):
        path = scratch(spark, "clusters")
        state.mapInArrow(_assigner(Geometry(centroids), moved), ddl).write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(ddl).parquet(path)
        if before:
            _delete(spark, before)
        before = path
        if r == rounds:
            break
        rows = state.filter("a <> was").select("v", "a", "was").mapInArrow(_changes(k), "c long, i long, total long, n long")
        rows = rows.groupBy("c", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # k * DIMENSIONS at most
        if not rows:
            break
        for x in rows:
            total[x.c, x.i] += x.total
            count[x.c] += x.n if x.i == 0 else 0
        moved_to = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
        moved = np.sqrt(_squared(moved_to, centroids).astype(np.float64)) * (1 + MARGIN)
        centroids = moved_to
    return Clustering(centroids, state)


def _measure(centroids: np.ndarray):
    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            a = batch.column("a").to_numpy()
            found = _squared(_matrix(batch), centroids[a])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("a"), pa.array(found)], ["vec_id", "cluster", "distance"])

    return distances


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def _by_cluster(values: list, cluster_: Column) -> Column:
    """Value of each cluster's number; k values."""
    return F.element_at(F.array(*map(F.lit, values)), cluster_ + 1)


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the kept vectors (vec_id, embedding)."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    whole = materialize(as_integers(vectors), "vectors")
    found = cluster(whole, k, rounds, seed)
    if not len(found.centroids):
        empty = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty.format(kind))
    measured = found.assigned.select("vec_id", "v", "a").mapInArrow(_measure(found.centroids), f"vec_id {kind}, cluster int, distance long")
    measured = materialize(measured, "distances")
    sums = {r.cluster: r.x for r in measured.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}  # k rows
    inertia = [sums.get(c, 0) for c in range(len(found.centroids))]
    return measured.select(
        "vec_id",
        "cluster",
        "distance",
        _by_cluster(inertia, F.col("cluster")).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        _by_cluster([digest(c) for c in found.centroids], F.col("cluster")).alias("centroid_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql_round(r: int) -> str:
    """Assignment of round r to the centroids c{r} (c, x), and the centroids after it."""
    assigned = f"""
a{r} AS MATERIALIZED (
  SELECT row, c, d FROM (
    SELECT row, c, list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{r})
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"""
    if r == ROUNDS:
        return assigned
    return f"""{assigned},
m{r} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r} JOIN kept USING (row)) GROUP BY c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT b.c, coalesce(m.x, b.x) AS x FROM c{r} b LEFT JOIN m{r} m ON b.c = m.c)"""


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v AS x
  FROM kept WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT {CENTROIDS}),{",".join(map(_sql_round, range(ROUNDS + 1)))}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (row) JOIN c{ROUNDS} c ON a.c = c.c
"""
