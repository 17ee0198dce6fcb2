"""Exact substring deduplication by fixed-block anchors.

A window is WINDOW consecutive words of one document. Every word that lies in a
window whose words also start in a document of smaller doc_id is removed.

Documents are dealt into chunks by a hash of id and text (many may lack an id). Blocks of BLOCK words at
positions 0, BLOCK, 2 BLOCK... are the reference blocks; every run of BLOCK words
is a probe. As 2 BLOCK - 1 = WINDOW, each occurrence of a window holds a whole
reference block. So:

1. a chunk sends its distinct probe hashes, those of reference blocks marked, to
   the hash buckets; a bucket tells a chunk which of its probes meet a reference
   block of another chunk, and which of its reference blocks meet a probe;
2. each chunk extends those anchors: the windows over an anchor are candidates.
   It sends their hashes with its smallest doc_id for each; the bucket of a hash
   finds the smallest of all and tells the chunks that hold a larger one;
3. each chunk merges the covered windows into maximal repeats and cuts them.

A chunk sends a hash once however often it occurs, so a passage in a third of
all documents costs its bucket one entry a chunk. No pair of documents is ever
formed. Block hashes choose candidates only; they have SPARE bits more than the
corpus has words need, so that a share of 2^-SPARE of the windows are candidates in
vain, at any size. Windows are compared by two independent hashes of 64 bits each:
128 bits tell 10^14 windows apart with a chance of error under 10^-10. A message is
a row for each chunk and bucket that a hash falls in, at worst a row a hash.

Nulls: a null text has no words. A document with a null doc_id keeps all its
words and is no source for others. Rows that repeat a doc_id are not smaller than
each other. Empty tables give empty results. Further columns are not read. A doc_id
that is no whole number raises a TypeError, as documents are numbered by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import Tokens, ranges_cover, window_hashes

WINDOW = 13
BLOCK = 7
#: Characters of text that a chunk has about, and whose hashes a bucket has.
CHUNK_CHARS, BUCKET_CHARS = 6_000_000, 12_000_000
SPARE = 12
#: Factor of the second of the two hashes of a word.
_SECOND = 0xD6E8FEB86659FD93

_SENT = "bucket int, chunk int, hashes binary, extra binary"
_TOLD = "chunk int, hashes binary, extra binary"


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted uint64 as the bytes of their gaps, low bytes first, so that equal high bytes compress."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(gaps, dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


class _Chunk:
    """A chunk's documents: tokens, where blocks and windows start, and their hashes (of windows two)."""

    def __init__(self, table: pa.Table, bits: int = 64):
        self.ids = table["doc_id"].to_numpy(zero_copy_only=False) if table["doc_id"].null_count == 0 else None
        valid = np.array(table["doc_id"].is_valid())
        if self.ids is None:
            self.ids = np.array(table["doc_id"].fill_null(0))
        self.valid, self.ids = valid, self.ids.astype(np.int64)
        self.tokens = Tokens(table["text"])
        self.of, self.place, size = self.tokens.places()
        usable = valid[self.of] & (size >= WINDOW)
        h, n = self.tokens.hashes, len(self.of)
        self.block_at = np.flatnonzero(usable & (self.place + BLOCK <= size))
        self.window_at = np.flatnonzero(usable & (self.place + WINDOW <= size))
        self.blocks = (window_hashes(h, BLOCK) >> np.uint64(64 - bits))[self.block_at] if n >= BLOCK else np.empty(0, np.uint64)
        self.windows = window_hashes(h, WINDOW)[self.window_at] if n >= WINDOW else np.empty(0, np.uint64)
        self.seconds = window_hashes(self.tokens.hashed(_SECOND), WINDOW)[self.window_at] if n >= WINDOW else self.windows


def _grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of pairs of hashes, where in it each distinct pair begins, and the number of its pair by place in the order."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _least_of_group(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id among the equal pairs of hashes, for each."""
    order, starts, group = _grouped(first, second)
    out = np.empty(len(ids), np.int64)
    if len(ids):
        out[order] = np.minimum.reduceat(ids[order], starts)[group]
    return out


def _split(chunk: int, buckets: int, hashes: np.ndarray, bits: int, *extra: np.ndarray) -> pa.Table:
    """Rows by bucket of sorted hashes and what goes with them; the bucket is a range of the hash's top bits."""
    at = np.searchsorted(hashes, np.array([(b << bits) // buckets for b in range(buckets)], np.uint64))
    ends = np.append(at[1:], len(hashes))
    full = np.flatnonzero(ends > at)
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array(np.full(len(full), chunk), pa.int32()),
            "hashes": pa.array([_pack(hashes[at[b] : ends[b]]) for b in full], pa.binary()),
            "extra": pa.array([b"".join(_planes(x[at[b] : ends[b]]) for x in extra) for b in full], pa.binary()),
        }
    )


def _told(of: dict[int, tuple[np.ndarray, ...]]) -> pa.Table:
    """Rows by chunk of sorted hashes, and their second hashes where there are any."""
    return pa.table(
        {
            "chunk": pa.array(list(of), pa.int32()),
            "hashes": pa.array([_pack(x[0]) for x in of.values()], pa.binary()),
            "extra": pa.array([b"".join(map(_planes, x[1:])) for x in of.values()], pa.binary()),
        }
    )


def _probes(chunk: int, buckets: int, bits: int, table: pa.Table) -> pa.Table:
    """Step 1, in a chunk: its distinct block hashes; the lowest bit says whether it is a reference block here."""
    c = _Chunk(table, bits)
    marked = (c.place[c.block_at] % BLOCK == 0).astype(np.uint64)
    found = np.sort((c.blocks << np.uint64(1)) | marked)
    last = np.append(found[1:] >> np.uint64(1) != found[:-1] >> np.uint64(1), True) if len(found) else np.empty(0, bool)
    return _split(chunk, buckets, found[last], bits + 1)


def _match_blocks(table: pa.Table) -> pa.Table:
    """Step 1, in a bucket: which hashes of a chunk meet one of another chunk, one of the two a reference block."""
    chunks = table["chunk"].to_numpy()
    parts = [_unpack(x.as_py()) for x in table["hashes"]]
    n = np.array([len(x) for x in parts])
    both = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    owner = np.repeat(chunks, n)
    h, mark = both >> np.uint64(1), (both & np.uint64(1)).astype(bool)
    order = np.argsort(h, kind="stable")
    h, mark, owner = h[order], mark[order], owner[order]
    if not len(h):
        return _told({})
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    marks = np.add.reduceat(mark.astype(np.int64), first)
    # a chunk holds a hash once: met if others are there, and a mark is there or its own
    met = np.repeat((size > 1) & (marks > 0), size)
    met &= mark | (np.repeat(marks, size) > mark)
    h, owner = h[met], owner[met]
    by = np.argsort(owner, kind="stable")
    h, owner = h[by], owner[by]
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, int)
    return _told({int(owner[a]): (x,) for a, x in zip(cut, np.split(h, cut[1:]))})


def _all(table: pa.Table) -> np.ndarray:
    parts = [_unpack(x.as_py()) for x in table["hashes"]]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _all_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The windows told to a chunk, in order: both hashes."""
    none = [np.empty(0, np.uint64)]
    first = np.concatenate([_unpack(x.as_py()) for x in table["hashes"]] or none)
    second = np.concatenate([_from_planes(x.as_py()).view(np.uint64) for x in table["extra"]] or none)
    order = np.lexsort((second, first))
    return first[order], second[order]


def _within(values: np.ndarray, in_sorted: np.ndarray) -> np.ndarray:
    if not len(in_sorted):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(in_sorted, values), len(in_sorted) - 1)
    return in_sorted[at] == values


def _pairs_within(first: np.ndarray, second: np.ndarray, told: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = told
    out = np.zeros(len(first), bool)
    if not len(a):
        return out
    at = np.searchsorted(a, first)
    open_ = np.flatnonzero(at < len(a))
    while len(open_):  # once, but where first hashes are equal by chance
        open_ = open_[a[at[open_]] == first[open_]]
        same = b[at[open_]] == second[open_]
        out[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(a)]
    return out


def _shared(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sorted hashes that several documents of the chunk hold; `of` is the document, in order."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], of[order]
    return np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])


def _candidates(table: pa.Table, bits: int, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of the chunk over anchors: smallest doc_id and both hashes, in order of the first."""
    c = _Chunk(table, bits)
    anchors = np.union1d(told, _shared(c.blocks, c.of[c.block_at]))
    near = np.zeros(len(c.of) + 1, np.int64)
    near[c.block_at[_within(c.blocks, anchors)] + 1] = 1
    near = np.cumsum(near)
    over = near[c.window_at + WINDOW - BLOCK + 1] > near[c.window_at]
    first, second, ids = c.windows[over], c.seconds[over], c.ids[c.of[c.window_at[over]]]
    order, starts, _ = _grouped(first, second)
    at = order[starts]
    return first[at], np.minimum.reduceat(ids[order], starts) if len(at) else ids, second[at]


def _first_owner(table: pa.Table) -> pa.Table:
    """Step 2, in a bucket: tells each chunk its windows that a smaller doc_id elsewhere holds."""
    parts = []
    for chunk, hashes, extra in zip(table["chunk"], table["hashes"], table["extra"]):
        data = extra.as_py()
        ids, second = _from_planes(data[: len(data) // 2]), _from_planes(data[len(data) // 2 :]).view(np.uint64)
        parts.append((chunk.as_py(), _unpack(hashes.as_py()), ids, second))
    least = _least_of_group(*(np.concatenate([x[k] for x in parts]) for k in (1, 3, 2)))
    out, start = {}, 0
    for chunk, first, own, second in parts:
        later = least[start : start + len(first)] < own
        start += len(first)
        if later.any():
            out[chunk] = first[later], second[later]
    return _told(out)


def _cut(table: pa.Table, told: tuple[np.ndarray, np.ndarray], with_text: bool) -> pa.Table:
    """Step 3, in a chunk: covered windows merge into maximal repeats, which are cut."""
    c = _Chunk(table)
    t, n, owner = c.tokens, len(c.of), c.of[c.window_at]
    hit = _pairs_within(c.windows, c.seconds, told)
    shared = _shared(c.windows, owner)
    if len(shared):  # within the chunk: all but the document of smallest id
        inside = np.flatnonzero(_within(c.windows, shared))
        own = c.ids[owner[inside]]
        hit[inside] |= _least_of_group(c.windows[inside], c.seconds[inside], own) < own
    covered = ranges_cover(c.window_at[hit], WINDOW, n)
    counts = np.diff(t.first)
    removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[t.first])
    texts = t.joined(~covered)
    spans = [[]] * len(counts)
    if with_text:
        spans = []
        for a, b in zip(t.first[:-1], t.first[1:]):
            e = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
            spans.append([{"start": int(x), "end": int(y)} for x, y in e.reshape(-1, 2)])
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
            "kept_text": pa.array([x.decode("utf-8", "replace") if with_text else None for x in texts], pa.string()),
            "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        }
    )


_RESULT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, repeats array<struct<start:int,end:int>>"
)


def deduplicate(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text and repeats (word ranges cut) of every document.

    The texts are shuffled once, by chunk: the three steps read the same exchange.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = (max(4, -(-size // x)) for x in (chunk_chars, chunk_chars * BUCKET_CHARS // CHUNK_CHARS))
    bits = min(63, max(size, 1).bit_length() + SPARE)  # a word has two bytes with its space, at least
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
    ).repartition(chunks, "chunk")

    def probe(key, table):
        return _probes(key[0].as_py(), buckets, bits, table)

    def match(key, table):
        return _match_blocks(table)

    def extend(key, table, told):
        first, ids, second = _candidates(table, bits, _all(told))
        return _split(key[0].as_py(), buckets, first, 64, ids, second)

    def first(key, table):
        return _first_owner(table)

    def cut(key, table, told):
        return _cut(table, _all_pairs(told), with_text)

    by = lambda df, key: df.repartition(chunks if key == "chunk" else buckets, key).groupBy(key)
    anchors = by(dealt.groupBy("chunk").applyInArrow(probe, _SENT), "bucket").applyInArrow(match, _TOLD)
    windows = dealt.groupBy("chunk").cogroup(by(anchors, "chunk")).applyInArrow(extend, _SENT)
    later = by(windows, "bucket").applyInArrow(first, _TOLD)
    return dealt.groupBy("chunk").cogroup(by(later, "chunk")).applyInArrow(cut, _RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs, with_text=False).drop("kept_text", "repeats")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
runs AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS first FROM runs GROUP BY 1),
cut AS (
  SELECT doc_id, list(DISTINCT q) AS gone
  FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM runs JOIN firsts USING (s) WHERE first < doc_id) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
