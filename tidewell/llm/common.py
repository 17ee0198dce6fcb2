"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session has none, a local master (tests, a laptop) gets a temporary
    folder; a cluster raises, as its executors would write where no one else reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/tidewell/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: the plan ends there,
    and a lost executor costs no recomputation of what came before."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What small() lets be sent to every executor.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The frame (of flat columns, already written), to be broadcast if its values measure at most so many bytes."""
    sizes = [
        F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8)
        for f in df.schema.fields
    ]
    measured = df.agg(F.sum(sum(sizes, F.lit(32)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if measured <= max_bytes else df


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id's text, modulo 5, is 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % 5 == 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, for hashes whose bits must all vary."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words; remembers at most `limit` of them."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        self.limit, self.of, self._known = limit, xxhash.xxh3_64_intdigest, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known, of = self._known, self.of
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = of(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Tokens:
    """Words of many texts at once, as byte ranges of one buffer, with 64-bit hashes.

    data: the texts' UTF-8 bytes end to end; bounds: where each text begins in
    them; starts, ends: the words' byte ranges; first: index of each text's first
    word, with the number of words at the end; hashes: of the words.
    """

    def __init__(self, texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
            if isinstance(texts, pa.ChunkedArray):
                texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
        if len(texts):
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        else:
            offsets = np.zeros(1, np.int64)
        n = int(offsets[-1] - offsets[0])
        self.data = np.frombuffer(texts.buffers()[2], np.uint8, n, int(offsets[0])) if n else np.empty(0, np.uint8)
        self.bounds = offsets - offsets[0]
        space = _SPACE[self.data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = self.bounds[1:-1]
        before[inner[inner < n]] = True
        after[inner[inner > 0] - 1] = True
        word = ~space
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.hashes = self.hashed()

    def hashed(self, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """64-bit hashes of the words; another odd factor gives others."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, np.dtype("<u8"), padded, strides=(1,))
        sizes = self.ends - self.starts
        out = mix64(sizes.astype(np.uint64))
        at, size, which = self.starts, sizes, slice(None)
        while len(at):
            with np.errstate(over="ignore"):
                x = out[which] ^ (eight[at] & _MASKS[np.minimum(size, 8)])
                x *= np.uint64(factor)
                x ^= x >> np.uint64(32)
                out[which] = x
            more = np.flatnonzero(size > 8)
            which = more if isinstance(which, slice) else which[more]
            at, size = at[more] + 8, size[more] - 8
        return mix64(out)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its text, its position there, and the number of that text's words."""
        counts = np.diff(self.first)
        of = np.repeat(np.arange(len(counts)), counts)
        return of, np.arange(len(self.starts)) - np.repeat(self.first[:-1], counts), np.repeat(counts, counts)


    def joined(self, kept: np.ndarray | None = None) -> list[bytes]:
        """Of each text its words (those of the mask kept), joined by one space, in UTF-8."""
        of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        kept = np.arange(len(self.starts)) if kept is None else np.flatnonzero(kept)
        # bytes that stay: kept words, and one byte after each that is not its text's last kept word, as a space
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts[kept]] = 1
        edge[self.ends[kept]] -= 1
        stay = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        follows = kept[:-1][of[kept[1:]] == of[kept[:-1]]]
        data = self.data.copy()
        data[self.ends[follows]] = 0x20
        stay[self.ends[follows]] = True
        out = data[stay].tobytes()
        cuts = np.concatenate([[0], np.cumsum(stay)])[self.bounds]
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def by_bytes(batch, column: str, most: int = 4 << 20):
    """Slices of an Arrow batch whose values of a text column measure about so many bytes at most; a row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (polynomial modulo 2^64, mixed)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        base = np.uint64(0x9E3779B97F4A7C15)
        for i in range(k):
            out *= base
            out += words[i : i + n]
    return mix64(out)


def ranges_cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Boolean mask over n positions: which lie in [s, s + length) of any start."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1]
    edge = edge - np.bincount(np.minimum(starts + length, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:-1]) > 0
