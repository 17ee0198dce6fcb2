"""A Merkle manifest of a dataset, with an authentication path of every row, by fractal traversal.

Each row is a leaf, the digest of its columns. The leaves of a source, ascending by
doc_id, are hashed up in runs of ARITY until one node, the source's subroot, remains;
the subroots, ordered by source, are hashed up likewise to the root.

Leaves get their places by ranges and offsets, so that no task holds a source. A block
is an aligned part of a source's leaves, a whole subtree of BLOCK_LEVELS levels. A first
pass hashes each block up with a stack of open runs and gives its node and the run
below it. The nodes above the blocks, and above the sources, are made level by level
in DataFrame operations; from them each block gets the upper part of its paths.

A second pass traverses each block's leaves in order, under two stacked subtrees: the
block's top run, and the existing subtree of ARITY^LOW leaves beneath it. While the
paths of the existing subtree's leaves are emitted, one a step, the leaves that come
in, one a step, grow the desired subtree, which takes its place when it is used up.
So a task holds two small subtrees, however many leaves it passes, and appends the
block's upper path to each path. Texts are neither sorted nor shuffled, only digests.

A path is the rest of each run that the leaf's ancestors are in, from the leaves to
the root, and the place in that run; verify() folds it with DataFrame functions alone.

Nulls: a null value hashes as "-"; null sources are a source of their own, first in
order; rows of null doc_id come first in their source. Rows that repeat a doc_id are
ordered by digest; equal rows are leaves of their own, whose paths differ where they
fall into different runs. A null text differs from an empty one; texts are hashed
whole, however long. A single row is its own root, with an empty path. An empty table
gives an empty result. Columns that are not hashed are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewell.llm.common import materialize, small

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LOW, BLOCK_LEVELS = 16, 2, 3
DIGITS = 64  # of a digest
#: Paths to an Arrow batch.
AT_ONCE = 256


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each "-" if null, else its UTF-8 byte count, ":" and itself."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, values)), 256)


def _height(n: Column) -> Column:
    """Levels above n leaves."""
    return sum(((n > F.lit(ARITY**k)).cast("int") for k in range(1, 15)), (n > 1).cast("int"))


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with at (0, 1, ... in each key, in the given order) and n (rows of the key), by ranges and their offsets."""
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ranged = materialize(ranged.withColumn("row", F.monotonically_increasing_id()), "ranged")
    part = F.shiftrightunsigned("row", 33)
    runs = ranged.groupBy(F.col(key).alias("r_key"), part.alias("part")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("size"))
    by = Window.partitionBy("r_key")  # a row a range that the key is in
    before = F.coalesce(F.sum("size").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("r_key", "part", (F.col("first") - before).alias("base"), F.sum("size").over(by).alias("n")), "runs")
    joined = ranged.join(small(runs), (F.col(key) == F.col("r_key")) & (part == F.col("part")))
    return joined.select(*rows.columns, (F.col("row") - F.col("base")).alias("at"), "n")


def _parent(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


class Subtree:
    """A subtree that grows by a leaf at a time; levels[k] has its nodes k levels above the leaves."""

    def __init__(self, height: int, rows: int = ARITY**LOW):
        self.height, self.most = height, rows
        self.levels: list[list[str]] = [[] for _ in range(height + 1)]

    def add(self, leaf: str) -> None:
        levels = self.levels
        levels[0].append(leaf)
        for k in range(self.height):
            if len(levels[k]) % ARITY:
                break
            levels[k + 1].append(_parent(levels[k][-ARITY:]))

    def close(self) -> None:
        """Hashes up the runs that are still open."""
        for k in range(self.height):
            done = len(self.levels[k + 1]) * ARITY
            if done < len(self.levels[k]):
                self.levels[k + 1].append(_parent(self.levels[k][done:]))

    def path(self, i: int) -> list[tuple[int, str]]:
        """Of leaf i: its place in, and the rest of, each run below the subtree's own node."""
        out = []
        for level in self.levels[: self.height]:
            start, place = i - i % ARITY, i % ARITY
            out.append((place, "".join(level[start:i] + level[i + 1 : start + ARITY])))
            i //= ARITY
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """(tree, block) and a part of its rows, in order; the parts of a block come one after the other."""
    for batch in batches:
        held: list[dict] = []
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield (held[0]["tree"], held[0]["block"]), held
                held = []
            held.append(row)
        if held:
            yield (held[0]["tree"], held[0]["block"]), held


_NODES = "tree string, i long, node string, height int, run array<string>"


class _Treehash:
    """Open runs of a block's levels; no more than ARITY nodes of each are held."""

    def __init__(self, height: int):
        self.open: list[list[str]] = [[] for _ in range(height + 1)]
        self.top: list[str] = []

    def add(self, leaf: str, level: int = 0) -> None:
        self.open[level].append(leaf)
        if level < len(self.open) - 1 and len(self.open[level]) == ARITY:
            self._up(level)

    def _up(self, level: int) -> None:
        self.top, self.open[level] = self.open[level], []
        self.add(_parent(self.top), level + 1)

    def node(self) -> str:
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._up(level)
        return self.open[-1][0]


def _block_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _NODES: node of each block, and the run below it (empty if the block is a lone leaf)."""
    key, hashed, height, out = None, None, 0, []

    def done() -> dict:
        node = hashed.node()
        return {"tree": key[0], "i": key[1], "node": node, "height": height, "run": hashed.top}

    schema = pa.schema([("tree", pa.string()), ("i", pa.int64()), ("node", pa.string()), ("height", pa.int32()), ("run", pa.list_(pa.string()))])
    for at, rows in _blocks(batches):
        if at != key:
            if key is not None:
                out.append(done())
            key, height = at, rows[0]["height"]
            hashed = _Treehash(min(height, BLOCK_LEVELS))
        for row in rows:
            hashed.add(row["leaf"])
        if len(out) >= AT_ONCE:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if key is not None:
        yield pa.RecordBatch.from_pylist([*out, done()], schema)


def _steps(nodes: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """From the nodes (tree, i, node, height) of one level, base levels above the leaves: tree, top (its last node); and
    tree, i, steps (level, place, siblings) from there to the top."""
    most = nodes.agg(F.max("height")).first()[0] or 0
    paths = nodes.select("tree", "i", "height", F.array().cast("array<struct<place:int,siblings:string>>").alias("steps"))
    level = nodes.select("tree", "i", "node", "height")
    tops = level.filter(F.col("height") <= base).select("tree", F.col("node").alias("top"))
    for k in range(base, most):
        live = level.filter(F.col("height") > k)
        runs = live.groupBy("tree", F.shiftright("i", 4).alias("up")).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]), "").alias("run"),
            F.first("height").alias("height"),
        )  # ARITY nodes at most
        runs = materialize(runs, "runs")
        level = runs.select("tree", F.col("up").alias("i"), F.sha2("run", 256).alias("node"), "height")
        tops = tops.union(level.filter(F.col("height") == k + 1).select("tree", F.col("node").alias("top")))
        mine = F.shiftright("i", 4 * (k - base))
        paths = paths.join(
            small(runs.select(F.col("tree").alias("u_tree"), "up", "run")),
            (F.col("tree") == F.col("u_tree")) & (F.shiftright(mine, 4) == F.col("up")),
            "left",
        )
        place = (mine % ARITY).cast("int")
        rest = F.concat(F.substr("run", F.lit(1), place * DIGITS), F.substr("run", (place + 1) * DIGITS + 1))
        step = F.array(F.struct(place.alias("place"), rest.alias("siblings")))
        paths = paths.select("tree", "i", "height", F.when(F.col("run").isNull(), F.col("steps")).otherwise(F.concat("steps", step)).alias("steps"))
    return materialize(tops, "tops"), materialize(paths.drop("height"), "paths")


class _Traversal:
    """Authentication paths of blocks that come in order, each behind its header."""

    def __init__(self, schema: pa.Schema, carry: list[str]):
        self.schema, self.carry, self.rows = schema, carry, []

    def begin(self, header: dict) -> None:
        self.header, self.subtree = header, 0
        self.upper = [(s["place"], s["siblings"]) for s in header["steps"]]
        # of a tree no higher than a subtree, the block's run is a level of the subtree itself
        self.top = header["run"] if header["height"] > LOW else []
        self.existing, self.out = None, 0
        self._desire()

    def _desire(self) -> None:
        self.desired, self.coming = Subtree(min(self.header["height"], LOW)), []

    def add(self, row: dict) -> None:
        """A leaf comes in, and the next path, if any, goes out."""
        self.desired.add(row["leaf"])
        self.coming.append(row)
        self._emit()
        if len(self.coming) == self.desired.most:
            self._swap()

    def _emit(self) -> None:
        if self.existing is None or self.out == len(self.held):
            return
        row, path = self.held[self.out], self.existing.path(self.out)
        if self.top:
            at = self.subtree - 1
            path.append((at, "".join(self.top[:at] + self.top[at + 1 :])))
        path += self.upper
        self.rows.append([row[c] for c in self.carry] + [self.header["subroot"], self.header["root"], [p for p, _ in path], [s for _, s in path]])
        self.out += 1

    def _swap(self) -> None:
        """The desired subtree, now complete, takes the place of the existing one, whose paths are all out."""
        self.existing, self.held, self.out = self.desired, self.coming, 0
        self.subtree += 1
        self._desire()

    def end(self) -> Iterator[None]:
        """The paths that are left, a step each."""
        while self.existing is not None and self.out < len(self.held):
            self._emit()
            yield
        if self.coming:
            self.desired.close()
            self._swap()
            while self.out < len(self.held):
                self._emit()
                yield

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows))
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _traverse(schema: pa.Schema, carry: list[str]):
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, open_ = _Traversal(schema, carry), False
        for _, rows in _blocks(batches):
            for row in rows:
                if row["at"] < 0:
                    if open_:
                        for _ in walk.end():
                            if len(walk.rows) >= AT_ONCE:
                                yield walk.batch()
                    walk.begin(row)
                    open_ = True
                    continue
                walk.add(row)
                if len(walk.rows) >= AT_ONCE:
                    yield walk.batch()
        if open_:
            for _ in walk.end():
                if len(walk.rows) >= AT_ONCE:
                    yield walk.batch()
            if walk.rows:
                yield walk.batch()

    return paths


def manifest(docs: DataFrame, shown: Column | None = None) -> DataFrame:
    """doc_id, leaf, shown, subroot, root, places, siblings of every row of docs.

    places and siblings are the authentication path: for each level the place in the
    run and the run's other nodes, left to right. shown is a text, as a verifier
    gets to see it, in an expression of the columns of docs; the column of that name is the
    leaf it gives, null where it is the leaf itself (always, if none is given).
    """
    values = [F.col(c) for c in COLUMNS]
    leaf = leaf_digest(values)
    other = F.lit(None).cast("string") if shown is None else F.when(~shown.eqNullSafe(F.col("text")), leaf_digest([*values[:-1], shown]))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))  # null sorts first
    leaves = docs.select("doc_id", tree.alias("tree"), leaf.alias("leaf"), other.alias("shown"))
    # equal rows are told apart, so that ranges can part them
    leaves = materialize(leaves.withColumn("copy", F.monotonically_increasing_id()), "leaves")
    leaves = placed(leaves, "tree", ["doc_id", "leaf", "copy"])
    leaves = leaves.select(
        "doc_id", "tree", F.shiftright("at", 4 * BLOCK_LEVELS).alias("block"), "at", "leaf", "shown", _height(F.col("n")).alias("height")
    )
    leaves = materialize(leaves, "placed")

    by = ("tree", "block")
    sent = leaves.select(*by, "at", "leaf", "height").repartition(*by).sortWithinPartitions(*by, "at")
    nodes = materialize(sent.mapInArrow(_block_nodes, _NODES), "nodes")
    tops, upper = _steps(nodes, BLOCK_LEVELS)
    forest = placed(tops.select(F.lit("").alias("all"), "tree", "top"), "all", ["tree"])
    forest = materialize(forest.select(F.col("all").alias("tree"), F.col("at").alias("i"), F.col("top").alias("node"), _height(F.col("n")).alias("height"), F.col("tree").alias("of")), "forest")
    root, over = _steps(forest, 0)
    sources = forest.join(over.select("i", F.col("steps").alias("over")), "i").select(F.col("of").alias("f_tree"), "over", F.col("node").alias("subroot"))
    top = root.first()  # one row, if there is any
    sources = materialize(sources.withColumn("root", F.lit(top and top.top).cast("string")), "sources")

    headers = nodes.join(upper, ["tree", "i"]).withColumnRenamed("i", "block")
    flat = sources.select("f_tree", "subroot", "root", F.to_json("over").alias("over"))
    headers = headers.join(small(flat), F.col("tree") == F.col("f_tree"))
    steps = F.concat("steps", F.from_json("over", "array<struct<place:int,siblings:string>>"))
    headers = headers.select(*by, F.lit(-1).cast("long").alias("at"), "height", "run", steps.alias("steps"), "subroot", "root")

    stream = leaves.drop("height").unionByName(headers, allowMissingColumns=True).repartition(*by).sortWithinPartitions(*by, "at")
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = T.StructType.fromDDL(f"doc_id {kind}, leaf string, shown string, subroot string, root string, places array<int>, siblings array<string>")
    return stream.mapInArrow(_traverse(to_arrow_schema(result), ["doc_id", "leaf", "shown"]), result)


def folded(leaf: Column, places: Column, siblings: Column) -> Column:
    """The root that a leaf and its authentication path give."""

    def up(node: Column, step: Column) -> Column:
        cut = step["place"] * DIGITS
        return F.sha2(F.concat(F.substr(step["rest"], F.lit(1), cut), node, F.substr(step["rest"], cut + 1)), 256)

    steps = F.zip_with(places, siblings, lambda place, rest: F.struct(place.alias("place"), rest.alias("rest")))
    return F.aggregate(steps, leaf, up)


def verify(proofs: DataFrame) -> DataFrame:
    """proofs (of manifest()) with folded_root, from the shown leaf, and verified."""
    root = folded(F.coalesce("shown", "leaf"), F.col("places"), F.col("siblings"))
    return proofs.withColumn("folded_root", root).withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forged = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    shown = F.when(forged, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256")
    return verify(manifest(docs, shown)).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def _sql_level(k: int, trees: str) -> str:
    """Level k + 1 of the trees' nodes l{k} (tree, i, h, n), and the siblings at level k."""
    return f"""
{trees}r{k} AS MATERIALIZED (SELECT tree, i // 16 AS up, string_agg(h, '' ORDER BY i) AS run, any_value(n) AS n FROM {trees}l{k} GROUP BY tree, i // 16),
{trees}l{k + 1} AS MATERIALIZED (SELECT tree, up AS i, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h, (n + 15) // 16 AS n FROM {trees}r{k})"""


def _sql_fold(k: int, trees: str, before: str) -> str:
    """Walks (tree, i, proof, folded) of before through level k."""
    return f"""
{trees}w{k} AS (
  SELECT w.* REPLACE (
           w.proof || CASE WHEN r.n > 1 THEN substr(r.run, 1, 64 * (w.i % 16)) || substr(r.run, 64 * (w.i % 16) + 65) ELSE '' END AS proof,
           CASE WHEN r.n > 1 THEN sha256(substr(r.run, 1, 64 * (w.i % 16)) || w.folded || substr(r.run, 64 * (w.i % 16) + 65)) ELSE w.folded END AS folded,
           w.i // 16 AS i)
  FROM {before} w JOIN {trees}r{k} r ON w.tree IS NOT DISTINCT FROM r.tree AND w.i // 16 = r.up)"""


SQL_LEVELS = 5
SQL = f"""
WITH crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
         lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [3988292384::BIGINT for x in range(8)]),
                                       lambda v, p: CASE WHEN v % 2 = 1 THEN xor(v // 2, p) ELSE v // 2 END)) AS v
  FROM (SELECT DISTINCT doc_id FROM documents)),
parts AS (
  SELECT d.doc_id, source, coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || CAST(d.doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
         text, coalesce(xor(v, 4294967295::BIGINT) % 5 = 0, FALSE) AS forged
  FROM documents d LEFT JOIN crc c ON d.doc_id = c.doc_id),
hashed AS (
  SELECT doc_id, source AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         CASE WHEN forged THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-')) END AS shown
  FROM parts),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
l0 AS (SELECT tree, i, h, n FROM leaves),{",".join(_sql_level(k, "") for k in range(SQL_LEVELS))},
sources AS MATERIALIZED (
  SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM l{SQL_LEVELS}),
fl0 AS (SELECT 0 AS tree, i, subroot AS h, n FROM sources),{",".join(_sql_level(k, "f") for k in range(2))},
start AS (SELECT doc_id, tree, i, h AS leaf, '' AS proof, coalesce(shown, h) AS folded FROM leaves),
{",".join(_sql_fold(k, "", f"w{k - 1}" if k else "start") for k in range(SQL_LEVELS))},
middle AS (SELECT doc_id, leaf, proof, folded, subroot, s.i, 0 AS tree FROM w{SQL_LEVELS - 1} w JOIN sources s ON w.tree IS NOT DISTINCT FROM s.source),
{",".join(_sql_fold(k, "f", f"fw{k - 1}" if k else "middle") for k in range(2))}
SELECT doc_id, leaf, subroot, (SELECT h FROM fl2) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM fl2) AS verified
FROM fw1
"""
