"""Matrices in long form, a row a cell: products by a join of tiles, for what does not fit one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 64


def _tiled(cells: DataFrame, by: list[str], rows: str, columns: str, name: str, tile: int) -> DataFrame:
    """A row a tile that has cells: its place, and its cells (tile * tile at most) as arrays."""
    cell = F.struct((F.col("i") % tile).cast("int").alias("i"), (F.col("j") % tile).cast("int").alias("j"), F.col("value").cast("double").alias("value"))
    keyed = cells.select(*by, F.floor(F.col("i") / tile).alias(rows), F.floor(F.col("j") / tile).alias(columns), cell.alias("cell"))
    return keyed.groupBy(*by, rows, columns).agg(F.collect_list("cell").alias(name))


def _product(by: list[str], tile: int):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dense(column: pa.ListArray, k: int) -> np.ndarray:
            cells = column[k].values
            out = np.zeros((tile, tile))
            i, j, value = (cells.field(n).to_numpy(zero_copy_only=False) for n in range(3))
            np.add.at(out, (i, j), value)
            return out

        for batch in batches:
            for k in range(batch.num_rows):
                found = dense(batch.column("a"), k) @ dense(batch.column("b"), k)
                i, j = np.nonzero(found)
                top, left = batch.column("r")[k].as_py() * tile, batch.column("c")[k].as_py() * tile
                keys = [pa.array([batch.column(g)[k].as_py()] * len(i), batch.schema.field(g).type) for g in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(i + top), pa.array(j + left), pa.array(found[i, j])], [*by, "i", "j", "value"])

    return multiply


def multiply(a: DataFrame, b: DataFrame, by: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """by, i, j, value: the product of two matrices (by, i, j, value), whose cells that are not there are 0.

    Tiles of the two meet by the block of a's columns and b's rows, their products are
    dense, and sums of cells go by place with partial sums before the shuffle. by tells
    several matrices apart. Cells that repeat a place add up; cells that are 0 are not returned.
    Indices are whole numbers from 0 on.
    """
    by = by or []
    joined = _tiled(a, by, "r", "k", "a", tile).join(_tiled(b, by, "k", "c", "b", tile), [*by, "k"])
    kinds = "".join(f"{g} {a.schema[g].dataType.simpleString()}, " for g in by)
    cells = joined.mapInArrow(_product(by, tile), f"{kinds}i long, j long, value double")
    return cells.groupBy(*by, "i", "j").agg(F.sum("value").alias("value")).filter("value <> 0")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(*[F.col(c).alias({"i": "j", "j": "i"}.get(c, c)) for c in a.columns])


def cells(rows: DataFrame, index: str, values: str) -> DataFrame:
    """i, j, value of rows that hold an array each."""
    return rows.select(F.col(index).cast("long").alias("i"), F.posexplode(values).alias("j", "value")).filter("value <> 0")
