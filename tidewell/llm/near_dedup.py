"""Near-duplicates by improved consistent weighted sampling.

A document is a weighted set of its five-word shingles: term frequency times a damped
inverse document frequency, (1 + ln(1 / share))^DAMPING, where share is the part of
all documents that hold the shingle, and shares under MIN_SHARE count as that. The
shares of the frequent shingles are exact: those that may be frequent are found by
lossy counting over all documents, then counted over all documents.

SAMPLES consistent weighted samples make a signature. Of the documents with equal
words one represents the others; such a node has a number. Signatures are banded:
BANDS bands of ROWS samples, each sample in two bands. First the members of a band's
bucket are proposed to its hubs, the members most like the bucket's commonest values,
if the two agree on WEAK of the samples; what is verified makes first classes. In buckets
that still hold several classes, members get signatures of WIDE samples and travel
with their weighted sets, and all pairs of different classes that agree on LIKE of
the wide samples are verified where they meet, the likest first; a link joins two
classes at once, so that no more of their pairs are looked at. A pair is looked at in
the first bucket alone that it shares. So a group of near-copies costs a few pairs a
member, and what comes out are links; of texts just under the similarity, all pairs
that no class joins are compared. Larger buckets meet in pairs of blocks of BLOCK.

Proposed pairs are verified by their exact weighted Jaccard similarity, computed
from the whole texts. The verified links make classes by alternating large-star
and small-star steps, each written to the shared folder, until nothing changes.

A pair of similarity 0.8 shares no band with probability 4e-6 (by simulation), and
agrees on less than LIKE of the wide samples with probability 5e-5 (binomial); more
similar pairs more rarely. No other pair is lost.

Nulls: texts without words (null, empty, blank) and rows with a null doc_id are
like nothing; their class is their own id. Texts of one to four words are a single
shingle. doc_id may be of any type that has an order. Rows that repeat a doc_id are
one document whose class is the smallest of their classes, also where their texts
differ. Empty tables give empty results. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Tokens, by_bytes, materialize, mix64, small, window_hashes

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES, WIDE = 64, 256
ROWS = 4
BANDS = 32
MIN_SHARE, DAMPING = 0.01, 0.25
#: The lossy count drops shingles in under so large a share of a chunk's documents, so that it misses that share of all
#: documents at most, however they are dealt to tasks; documents and shingles to a chunk.
LOSS, CHUNK_DOCS, CHUNK_SHINGLES = 0.0025, 4096, 4_000_000
#: Shares of equal samples: to be proposed to a hub, and not to be a hub oneself.
WEAK, NEAR = 0.6, 0.72
#: Hubs that a member less like them than NEAR is proposed to; the pairs of all members are looked at later.
HUBS = 3
#: Share of equal wide samples to be verified.
LIKE = 0.7
#: Members of a bucket that meet in one task: for hubs, and for pairs of members; bytes of sets and members to a group of
#: small buckets.
SPLIT, BLOCK, GROUP_BYTES, GROUP_ROWS = 20_000, 1_000, 8 << 20, 2_000


@dataclass
class Shingles:
    """Distinct shingles of many texts, by text and hash: text number, hash, how often it occurs there."""

    of: np.ndarray
    x: np.ndarray
    n: np.ndarray

    def starts(self, texts: np.ndarray) -> np.ndarray:
        """Where the texts of these numbers, in order, begin."""
        return np.searchsorted(self.of, texts)

    def of_texts(self, mask: np.ndarray) -> Shingles:
        keep = mask[self.of]
        return Shingles(self.of[keep], self.x[keep], self.n[keep])


def shingles(tokens: Tokens) -> Shingles:
    """Hashes of the runs of SHINGLE words; of all words of a text that has fewer."""
    of, place, size = tokens.places()
    parts = []
    for k in range(1, SHINGLE + 1):
        at = np.flatnonzero((size >= k) & (place + k <= size) if k == SHINGLE else (size == k) & (place == 0))
        if len(at):
            parts.append((of[at], window_hashes(tokens.hashes, k)[at]))
    if not parts:
        return Shingles(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    of, x = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((x, of))
    of, x = of[order], x[order]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (of[1:] != of[:-1])))
    return Shingles(of[first], x[first], np.diff(np.append(first, len(x))))


def _lossy_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles (and, without one, the documents) with the number of documents that hold them, but the rare ones of each chunk."""
    held, docs, size = [], 0, 0

    def count() -> Iterator[pa.RecordBatch]:
        x, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        often = n >= LOSS * docs
        x, n = x[often].view(np.int64), n[often]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs], pa.int64())], ["shingle", "n"])
        for at in range(0, len(x), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65_536]), pa.array(n[at : at + 65_536])], ["shingle", "n"])

    for batch in batches:
        for part in by_bytes(batch, "text"):
            s = shingles(Tokens(part.column("text")))
            held.append(s.x)
            docs += int(np.count_nonzero(np.append(True, s.of[1:] != s.of[:-1]))) if len(s.of) else 0
            size += len(s.x)
            if docs >= CHUNK_DOCS or size >= CHUNK_SHINGLES:
                yield from count()
                held, docs, size = [], 0, 0
    yield from count()


class _ExactCounts:
    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(self.wanted), np.int64)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                x = shingles(Tokens(part.column("text"))).x
                at = np.minimum(np.searchsorted(self.wanted, x), len(self.wanted) - 1)
                total += np.bincount(at[self.wanted[at] == x], minlength=len(self.wanted))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(self.wanted[seen].view(np.int64)), pa.array(total[seen])], ["shingle", "n"])


@dataclass
class Weights:
    """Weight of a shingle by its share of documents: of the frequent ones, and of all others."""

    frequent: np.ndarray  # uint64, in order
    weight: np.ndarray  # float32
    rest: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.rest, np.float32)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, x), len(self.frequent) - 1)
            known = self.frequent[at] == x
            out[known] = self.weight[at[known]]
        return out


def shingle_weights(docs: DataFrame) -> Weights:
    """Weights from counts over all documents.

    The driver gets those alone that the lossy count gives half of MIN_SHARE at least, among
    which are all of MIN_SHARE and more, as LOSS is less than half of it. As shares sum to
    the mean number of distinct shingles of a document, they are at most 2 / MIN_SHARE times
    that number.
    """
    ddl = "shingle long, n long"
    texts = docs.select("text")
    counts = materialize(texts.mapInArrow(_lossy_counts, ddl).groupBy("shingle").agg(F.sum("n").alias("n")), "counts")
    n = (counts.filter("shingle is null").first() or (None, 0))[1] or 0
    rest = float((1 + np.log(1 / MIN_SHARE)) ** DAMPING)
    some = counts.filter(F.col("shingle").isNotNull() & (F.col("n") >= MIN_SHARE / 2 * n)).select("shingle").collect()
    if not some:
        return Weights(np.empty(0, np.uint64), np.empty(0, np.float32), rest)
    wanted = np.sort(np.array([r.shingle for r in some], np.int64).view(np.uint64))
    rows = texts.mapInArrow(_ExactCounts(wanted), ddl).groupBy("shingle").agg(F.sum("n").alias("n")).collect()  # of those alone
    x = np.array([r.shingle for r in rows], np.int64).view(np.uint64)
    share = np.clip(np.array([r.n for r in rows]) / n, MIN_SHARE, 1.0)
    order = np.argsort(x)
    return Weights(x[order], ((1 + np.log(1 / share)) ** DAMPING).astype(np.float32)[order], rest)


def weighted_sets(tokens: Tokens, weights: Weights) -> tuple[Shingles, np.ndarray]:
    s = shingles(tokens)
    return s, (s.n * weights(s.x)).astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets as (distinct hashes in order, their weights)."""
    (xa, wa), (xb, wb) = a, b
    if not len(xa) or not len(xb):
        return 0.0
    at = np.minimum(np.searchsorted(xb, xa), len(xb) - 1)
    same = xb[at] == xa
    low = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    high = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - low
    return low / high if high > 0 else 0.0


class Sampler:
    """Consistent weighted samples of each of many weighted sets at a time.

    The gamma and uniform variates of a shingle and a sample are drawn from fixed
    tables by bits of its hash, so that they are the same wherever it occurs.
    """

    def __init__(self, samples: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2.0, 1.0, 1 << 12).astype(np.float32)
        self.beta = rng.uniform(0, 1, 1 << 12).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)

    def __call__(self, x: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """x, w: the sets end to end, each beginning at one of starts. Returns uint32, a row a set."""
        out = np.empty((len(starts), len(self.odd)), np.uint32)
        if not len(starts):
            return out
        log_w = np.log(w).astype(np.float32)
        sizes = np.diff(np.append(starts, len(x)))
        mixed, place = mix64(x), np.arange(len(x))
        for k in range(len(self.odd)):
            with np.errstate(over="ignore"):
                u = mixed * self.odd[k]
            r = self.r[(u >> np.uint64(52)).astype(np.int64)]
            beta = self.beta[((u >> np.uint64(40)) & np.uint64(0xFFF)).astype(np.int64)]
            t = np.floor(log_w / r + beta)
            a = self.log_c[((u >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
            least = np.repeat(np.minimum.reduceat(a, starts), sizes)
            at = np.minimum.reduceat(np.where(a == least, place, len(x)), starts)
            with np.errstate(over="ignore"):
                out[:, k] = mix64(x[at] + t[at].astype(np.int64).astype(np.uint64) + np.uint64(k)) & np.uint64(0xFFFFFFFF)
        return out


AT_ONCE = 60_000  # shingles that are sampled at a time


def _signatures(s: Shingles, w: np.ndarray, texts: np.ndarray, sample: Sampler) -> np.ndarray:
    """uint32 by text and sample, of texts (numbers, in order) that have shingles; s holds no others."""
    starts = np.append(s.starts(texts), len(s.x))
    out = np.empty((len(texts), len(sample.odd)), np.uint32)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + AT_ONCE, "right")) - 1)
        a, b = starts[at], starts[to]
        out[at:to] = sample(s.x[a:b], w[a:b], starts[at:to] - a)
        at = to
    return out


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


class _Signer:
    """doc_id, digest of the words and signature of each document with words."""

    def __init__(self, weights: Weights):
        self.weights = weights

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, known = Sampler(SAMPLES), {}
        for batch in batches:
            for part in by_bytes(batch, "text"):
                tokens = Tokens(part.column("text"))
                digests = [_digest(x) if x else None for x in tokens.joined()]
                usable = np.array(part.column("doc_id").is_valid()) & np.array([x is not None for x in digests])
                if len(known) > 50_000:
                    known.clear()
                fresh: dict[bytes, int] = {}
                for k in np.flatnonzero(usable):
                    if digests[k] not in known:
                        fresh.setdefault(digests[k], int(k))
                mask = np.zeros(len(digests), bool)
                mask[list(fresh.values())] = True
                s = shingles(tokens).of_texts(mask)
                at = np.flatnonzero(mask)
                for k, row in zip(at, _signatures(s, (s.n * self.weights(s.x)).astype(np.float32), at, sample)):
                    known[digests[k]] = row.tobytes()
                rows = np.flatnonzero(usable)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows)),
                        pa.array([digests[k] for k in rows], pa.binary()),
                        pa.array([known[digests[k]] for k in rows], pa.binary()),
                    ],
                    ["doc_id", "digest", "signature"],
                )


def _of_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text of the rows (node, digest, text) whose words have the digest: rows that repeat an id may have other texts."""
    for batch in batches:
        for part in by_bytes(batch, "text"):
            digests = [_digest(x) for x in Tokens(part.column("text")).joined()]
            same = pa.array([a == b for a, b in zip(digests, part.column("digest").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(c).filter(same) for c in ("node", "text")], ["node", "text"])


class _Describer:
    """node, brief (the low bytes of WIDE samples), and the weighted set as x and w."""

    def __init__(self, weights: Weights):
        self.weights = weights

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampler(WIDE)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                s, w = weighted_sets(Tokens(part.column("text")), self.weights)
                rows = _signatures(s, w, np.arange(part.num_rows), sample).astype(np.uint8)
                ends = np.append(s.starts(np.arange(part.num_rows)), len(s.x))
                cut = lambda of: pa.array([of[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([r.tobytes() for r in rows], pa.binary()), cut(s.x), cut(w)],
                    ["node", "brief", "x", "w"],
                )


def _band_columns() -> np.ndarray:
    """Samples of each band: SAMPLES / ROWS disjoint bands, and as many again that take one sample from each fourth."""
    plain = np.arange(SAMPLES).reshape(-1, ROWS)
    return np.concatenate([plain, np.arange(SAMPLES).reshape(ROWS, -1).T])[:BANDS]


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """uint64 by document and band."""
    keys = np.empty((len(signatures), BANDS), np.uint64)
    for b, cols in enumerate(_band_columns()):
        key = np.full(len(signatures), b, np.uint64)
        for c in cols:
            with np.errstate(over="ignore"):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, c].astype(np.uint64))
        keys[:, b] = key
    return keys


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        s = _matrix(batch.column(1), np.uint32)
        keys = _band_keys(s).view(np.int64)
        ids = batch.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1)), pa.array(np.repeat(ids, BANDS))], ["bucket", "node"]
        )


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A row a value of a binary column whose values have the same size."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1) if values else np.empty((0, 1), kind)


def hub_pairs(ids: np.ndarray, signatures: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a bucket's hubs and the members like them.

    A hub is the member that agrees most with the commonest value of each sample,
    which is the text that the others were made from, or the one nearest to it.
    Those that agree with it on NEAR of the samples leave; among the rest the next
    hub is sought, as long as one finds anything. A member that agrees on WEAK only
    is proposed to HUBS hubs; the pairs' turn comes later.
    """
    order = np.argsort(ids, kind="stable")
    ids, signatures = ids[order], signatures[order]
    out: list[tuple[int, int]] = []
    left, asked = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    while len(left) > 1:
        s = signatures[left]
        if len(left) > 2:
            counts = np.zeros((SAMPLES, 256), np.int64)
            for k in range(SAMPLES):
                counts[k] = np.bincount(s[:, k], minlength=256)
            hub = int(np.argmax((s == counts.argmax(1).astype(np.uint8)).sum(1)))
        else:
            hub = 0
        like = (s == s[hub]).mean(1)
        like[hub] = 0
        near = np.flatnonzero((like >= NEAR) | (like >= WEAK) & (asked[left] < HUBS))
        asked[left[near]] += 1
        out += [(int(ids[left[hub]]), int(ids[left[k]])) for k in near]
        gone = like >= NEAR
        if not gone.any():
            break
        gone[hub] = True
        left = left[~gone]
    return out


def unlike(briefs: np.ndarray, brief: np.ndarray) -> np.ndarray:
    """How many bytes of each row of uint64 differ from those of one."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    x = briefs ^ brief
    x = (((x & low) + low) | x) & ~low  # the top bit of each byte that is not 0
    return np.bitwise_count(x).sum(1, dtype=np.int64)


class Classes:
    """Classes of a bucket's members, joined as links are found."""

    def __init__(self, labels: np.ndarray):
        _, first, self.of, counts = np.unique(labels, return_index=True, return_inverse=True, return_counts=True)
        self.of = self.of.copy()
        self.largest = int(np.argmax(counts))

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.of[a], self.of[b]))
        keep, gone = (self.largest, low + high - self.largest) if self.largest in (low, high) else (low, high)
        self.of[self.of == gone] = keep


def gather(
    briefs: np.ndarray, keys: np.ndarray, band: int, labels: np.ndarray, similarity, least: float, sides: np.ndarray | None = None
) -> list[tuple[int, int, float]]:
    """Links (member, member, similarity) of a bucket that join its classes, by all pairs of different classes (and sides, if given).

    Pairs that share an earlier band's bucket are left to that, and pairs that differ in
    more than 1 - LIKE of the wide samples are not looked at. The largest class is asked by
    all others; of two that are not of it the later asks.
    """
    classes, keys, number = Classes(labels), keys[:, :band], np.arange(len(labels))
    largest, most, out = classes.of == classes.largest, (1 - LIKE) * WIDE, []
    half = briefs.shape[1] // 2
    for m in np.flatnonzero(~largest):
        asked = (classes.of != classes.of[m]) & (largest | (number < m))
        if sides is not None:
            asked &= sides != sides[m]
        others = np.flatnonzero(asked)
        # by half of the samples first: most pairs differ too much in these alone
        far = unlike(briefs[others, :half], briefs[m, :half])
        others, far = others[far <= most], far[far <= most]
        far = far + unlike(briefs[others, half:], briefs[m, half:])
        others, far = others[far <= most], far[far <= most]
        if band and len(others):
            new = ~(keys[others] == keys[m]).any(1)
            others, far = others[new], far[new]
        for o in others[np.argsort(far, kind="stable")].tolist():
            if classes.of[o] != classes.of[m] and (found := similarity(o, int(m))) >= least:
                out.append((o, int(m), found))
                classes.join(o, int(m))
    return out


def _by_bucket(table: pa.Table) -> Iterator[np.ndarray]:
    """Rows of each bucket of two or more."""
    buckets = table["bucket"].to_numpy()
    order = np.argsort(buckets, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1):
        if len(part) > 1:
            yield part


def _pairs(found: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.sort(found, 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], ["a", "b"])


def _propose_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches))
    ids, briefs = table["node"].to_numpy(), _matrix(table["brief"], np.uint8)
    for part in _by_bucket(table):
        yield _pairs(np.array(hub_pairs(ids[part], briefs[part]), np.int64).reshape(-1, 2))


def _gatherer(least: float):
    """Function that gives the links of all buckets of a group of buckets."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, labels, buckets = (table[c].to_numpy() for c in ("node", "label", "bucket"))
        sides = table["side"].to_numpy() if "side" in table.column_names else None
        briefs, signatures = _matrix(table["brief"], np.uint64), _matrix(table["signature"], np.uint32)
        xs, ws = table["x"].combine_chunks(), table["w"].combine_chunks()

        def weighted_set(k: int) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(xs[k].as_buffer(), np.uint64), np.frombuffer(ws[k].as_buffer(), np.float32)

        for part in _by_bucket(table):
            part = part[np.argsort(ids[part], kind="stable")]
            keys = _band_keys(signatures[part])
            band = int(np.flatnonzero(keys[0] == buckets[part[:1]].view(np.uint64))[0])
            exact = lambda i, j: weighted_jaccard(weighted_set(int(part[i])), weighted_set(int(part[j])))  # noqa: B023, E731
            found = gather(briefs[part], keys, band, labels[part], exact, least, None if sides is None else sides[part])
            a, b, similarity = ([x[k] for x in found] for k in range(3))
            low, high = np.sort(ids[part][np.array([a, b], np.int64).reshape(2, -1)], 0)
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(similarity, pa.float64())], _LINK)

    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (leader, member) that agree on WEAK of the samples."""
    for batch in batches:
        if batch.num_rows:
            mine, lead = (
                _matrix(batch.column(c), np.uint8)
                for c in ("brief", "lead_brief")
            )
            near = pa.array((mine == lead).mean(1) >= WEAK)
            cols = [batch.column(c).filter(near) for c in ("leader", "node")]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, brief: the low bytes of the signature."""
    for batch in batches:
        brief = [r.tobytes() for r in _matrix(batch.column("signature"), np.uint32).astype(np.uint8)] if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(brief, pa.binary())], ["node", "brief"])


def bucket_members(nodes: DataFrame) -> DataFrame:
    """bucket, node of the nodes (node, signature) that share a bucket with another."""
    bands = materialize(nodes.select("node", "signature").mapInArrow(_bands, "bucket long, node long"), "bands")
    company = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return materialize(bands.join(company, "bucket"), "members")


def star_pairs(members: DataFrame) -> DataFrame:
    """a, b: pairs of each bucket's smallest node and a member like it, in a join that Spark splits."""
    leaders = members.groupBy("bucket").agg(F.min(F.struct("node", "brief")).alias("x"))
    leaders = leaders.select("bucket", F.col("x.node").alias("leader"), F.col("x.brief").alias("lead_brief"))
    with_leader = members.join(leaders, "bucket").filter("node <> leader")
    return with_leader.mapInArrow(_compare, "a long, b long")


def blocks(large: DataFrame, size: int) -> DataFrame:
    """Rows of the large buckets (bucket, node, label), dealt into pairs (lo, hi) of blocks of about size rows.

    The bucket's commonest class has blocks of its own, which meet the others' blocks
    but not each other; every other pair of rows meets. side is the row's block.
    """
    counts = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"))
    n_top = F.ceil(F.col("top.c") / size).cast("int")
    n_rest = F.ceil((F.col("n") - F.col("top.c")) / size).cast("int")
    # a row a large bucket
    rows = large.join(small(materialize(top.select("bucket", F.col("top.label").alias("most"), n_top.alias("n_top"), n_rest.alias("n_rest")), "tops")), "bucket")
    is_top, deal = F.col("label") == F.col("most"), F.xxhash64("node")
    rows = rows.withColumn(
        "side", F.when(is_top, F.col("n_rest") + F.pmod(deal, "n_top")).otherwise(F.pmod(deal, "n_rest")).cast("int")
    ).filter("n_rest > 0")
    last = F.when(is_top, F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_top")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select(
        "bucket", "node", "label", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi")
    )


_PAIRS, _LINKS, _LINK = "a long, b long", "a long, b long, similarity double", ["a", "b", "similarity"]


def _in_groups(rows: DataFrame, f, ddl: str, groups: int) -> DataFrame:
    """f over groups of many small buckets each."""
    keyed = rows.withColumn("group", F.pmod("bucket", F.lit(max(16, groups))).cast("int"))
    return keyed.groupBy("group").applyInArrow(f, ddl)


def hub_proposals(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: distinct pairs of a bucket's hubs and members like them.

    Buckets of over SPLIT never meet in one task: their members are proposed to the
    smallest node, and to the hubs of the part that they are dealt to.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.filter(F.col("n") > SPLIT), "large")
    briefs = nodes.select("node", "signature").mapInArrow(_short, "node long, brief binary")
    full = materialize(members.join(briefs, "node"), "full")
    groups = full.count() // 20_000
    if large.isEmpty():
        return _in_groups(full, _propose_hubs, _PAIRS, groups).distinct()
    hot = full.join(small(large), "bucket")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SPLIT))
    dealt = hot.withColumn("bucket", F.xxhash64("bucket", part)).drop("n")
    rest = full.join(small(large.select("bucket")), "bucket", "left_anti").unionByName(dealt)
    return _in_groups(rest, _propose_hubs, _PAIRS, groups).union(star_pairs(hot.drop("n"))).distinct()


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, node, label, n: members of the buckets that hold several classes (node, root)."""
    labelled = members.select("bucket", "node").join(roots.withColumnRenamed("root", "label"), "node", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
    return materialize(labelled.join(mixed.filter("x <> y").select("bucket", "n"), "bucket").select("bucket", "node", "label", "n"), "open")


def gathered_links(members: DataFrame, described: DataFrame, similarity: float) -> DataFrame:
    """a, b, similarity: links of members (bucket, node, label, n) that join the classes of their buckets.

    described: node, brief, signature, x, w. Buckets of over BLOCK members never meet in
    one task, but in pairs of blocks.
    """
    f = _gatherer(similarity)
    few = members.filter(F.col("n") <= BLOCK).drop("n")
    many = members.filter(F.col("n") > BLOCK).drop("n")
    sizes = described.select("node", (12 + F.octet_length("x") + F.octet_length("w")).alias("size"))
    size, n = few.join(sizes, "node").agg(F.sum("size"), F.count(F.lit(1))).first()
    out = _in_groups(few.join(described, "node"), f, _LINKS, max((size or 0) // GROUP_BYTES, n // GROUP_ROWS))
    if not many.isEmpty():
        met = blocks(many, BLOCK).join(described, "node")
        by = ("bucket", "lo", "hi")
        out = out.union(met.filter("lo = hi").drop("side").groupBy(*by).applyInArrow(f, _LINKS))
        out = out.union(met.filter("lo < hi").groupBy(*by).applyInArrow(f, _LINKS))
    return materialize(out, "gathered")


class _Verifier:
    KEPT = 8_000_000  # shingles

    def __init__(self, weights: Weights):
        self.weights = weights

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0
        for whole in batches:
            for batch in by_bytes(whole, "text_a"):
                if size > self.KEPT:
                    known.clear()
                    size = 0
                for node, text in (("a", "text_a"), ("b", "text_b")):
                    nodes = batch.column(node).to_numpy()
                    new, at = np.unique(nodes, return_index=True)
                    at = at[[x not in known for x in new.tolist()]]
                    s, w = weighted_sets(Tokens(batch.column(text).take(pa.array(at))), self.weights)
                    ends, size = np.append(s.starts(np.arange(len(at))), len(s.x)), size + len(s.x)
                    for k, x in enumerate(nodes[at].tolist()):
                        known[x] = s.x[ends[k] : ends[k + 1]].copy(), w[ends[k] : ends[k + 1]].copy()
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                found = [weighted_jaccard(known[x], known[y]) for x, y in zip(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], _LINK)


@dataclass
class Corpus:
    """docs (doc_id, text), its nodes (node, doc_id, digest, signature) and weights."""

    docs: DataFrame
    nodes: DataFrame
    weights: Weights

    def texts(self, nodes: DataFrame) -> DataFrame:
        """node, text of some nodes (written)."""
        known = materialize(self.nodes.select("node", "doc_id", "digest").join(small(nodes), "node", "left_semi"), "wanted")
        rows = self.docs.join(small(known), "doc_id").select("node", "digest", "text")
        return materialize(rows.mapInArrow(_of_node, "node long, text string").dropDuplicates(["node"]), "texts")

    def verify(self, pairs: DataFrame, similarity: float) -> DataFrame:
        """a, b, similarity of the pairs (written) that reach it, from the whole texts."""
        ends = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
        texts = self.texts(ends)
        joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(
            texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"
        )
        found = joined.mapInArrow(_Verifier(self.weights), _LINKS)
        return materialize(found.filter(F.col("similarity") >= similarity), "links")


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of the links (a, b), by alternating stars until none changes."""
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges"
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .filter("u != v")
            .distinct()
        )
        edges = materialize(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(tops)


def linked_pairs(corpus: Corpus, members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, similarity: verified links that join all nodes of a bucket that are like each other."""
    links = corpus.verify(materialize(hub_proposals(members, corpus.nodes), "proposed"), similarity)
    left = open_members(members, materialize(components(links), "roots"))
    if left.isEmpty():
        return links
    texts = corpus.texts(materialize(left.select("node").distinct(), "open_nodes"))
    described = texts.mapInArrow(_Describer(corpus.weights), "node long, brief binary, x binary, w binary")
    described = materialize(described.join(corpus.nodes.select("node", "signature"), "node"), "described")
    return links.union(gathered_links(left, described, similarity))


def numbered(docs: DataFrame, weights: Weights) -> tuple[DataFrame, DataFrame]:
    """copies: doc_id, digest of all documents with words; nodes: node, doc_id (smallest), digest, signature of each distinct one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(docs.mapInArrow(_Signer(weights), f"doc_id {kind}, digest binary, signature binary"), "signed")
    firsts = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "signature")).alias("x"))
    nodes = firsts.select(F.monotonically_increasing_id().alias("node"), "x.doc_id", "digest", "x.signature")
    return signed.select("doc_id", "digest"), materialize(nodes, "nodes")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), one row a row of docs."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    weights = shingle_weights(docs)
    copies, nodes = numbered(docs, weights)
    links = linked_pairs(Corpus(docs, nodes, weights), bucket_members(nodes), similarity)
    copies = materialize(copies.join(nodes.select("digest", "node"), "digest").select("doc_id", "node").distinct(), "copies")
    # a doc_id that stands for several texts joins their classes
    several = copies.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z").select("doc_id", "a")
    several = copies.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a != b")
    roots = materialize(components(links.select("a", "b").union(several)), "roots")
    named = nodes.select("node", "doc_id").join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = roots.join(named, "root").select(F.col("node").alias("r_node"), "class_id")
    per_doc = (
        copies.join(nodes.select("node", F.col("doc_id").alias("first")), "node")
        .join(classes, F.col("node") == F.col("r_node"), "left")
        .groupBy(F.col("doc_id").alias("c_id"))
        .agg(F.min(F.coalesce("class_id", "first")).alias("class_id"))
    )
    joined = docs.select("doc_id").join(per_doc, F.col("doc_id") == F.col("c_id"), "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those whose class has a smaller doc_id. Rows of one doc_id stay or go together; null ids stay."""
    gone = near_duplicates(docs, similarity).filter("doc_id != class_id").select("doc_id").distinct()
    return docs.join(small(materialize(gone, "gone")), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
