"""Near-duplicates by SimHash fingerprints, linked through anchor points of a covering code.

A fingerprint has 64 bits; one is set if it is set in over half of the hashes of the
document's shingles (SHINGLE words, repeats included). Fingerprints that differ in
BITS bits or fewer are linked, and components of links are classes.

The 64 bits are cut into segments. Two fingerprints within BITS differ in at most t =
BITS // segments bits of some segment. The anchors of a segment are the words of a
covering code: a product of perfect Hamming codes of 15 bits, and of all words on the
bits that are left, so that every value is within radius r (a bit a factor) of an anchor.
A fingerprint is at home at its nearest anchor, and a guest at every anchor within r + t:
of two within t in the segment, each is a guest, at least, where the other is at home. At
an anchor those at home are compared with all, in full.

Equal fingerprints are folded before. At an anchor a class grows from a member by
search: a member that is at home there is compared with those that the class has
not reached, so that a large group of copies costs few comparisons a member, and what
comes out is a spanning tree. Anchors with over BLOCK members at home, which bounds their guests too, never
meet in one task: there, members are first linked to the commonest fingerprint and within parts;
after that only members of different classes meet, in pairs of blocks.

More segments mean shorter keys and fewer rows a fingerprint: three up to MANY
fingerprints, two beyond; the links are the same.

Nulls: a text without words (null, empty, blank) has fingerprint zero and is linked like
any other. A text of fewer words than a shingle is one shingle. Rows that repeat a doc_id are
rows of their own, each with its text's fingerprint. A null doc_id doesn't name a component: if all
ids of a component are null, component_id is. Texts are hashed whole, however long. An empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Tokens, by_bytes, materialize, small
from tidewell.llm.near_dedup import blocks, components

SHINGLE, BITS, SEED = 4, 4, 42
#: Distinct fingerprints beyond which two segments are taken.
MANY = 1 << 24
#: Members at home at an anchor that meet in one task; rows to a group of anchors.
BLOCK, GROUP_ROWS = 20_000, 400_000
#: Texts whose fingerprints a task remembers.
KNOWN = 50_000


def _fingerprint(words: bytes, hashed) -> int:
    """Of words joined by single spaces."""
    if not words:
        return 0
    data = np.frombuffer(words, np.uint8)
    spaces = np.flatnonzero(data == 0x20)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(data))
    n = max(1, len(starts) - SHINGLE + 1)
    cuts = zip(starts[:n].tolist(), ends[-n:].tolist())
    hashes = np.fromiter((hashed(words[a:b], SEED) for a, b in cuts), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, fp (the fingerprint as a signed number)."""
    import xxhash

    known: dict[bytes, int] = {}
    for batch in batches:
        for part in by_bytes(batch, "text"):
            tokens = Tokens(part.column("text"))
            upper = (tokens.data >= 0x41) & (tokens.data <= 0x5A)
            tokens.data = np.where(upper, tokens.data + 32, tokens.data).astype(np.uint8)
            found = []
            for words in tokens.joined():
                key = xxhash.xxh3_128_digest(words)
                if key not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[key] = _fingerprint(words, xxhash.xxh64_intdigest)
                found.append(known[key])
            fps = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


HAMMING = 15  # bits of a perfect code of radius 1 with 4 parity bits


class CoveringCode:
    """Anchors of a segment: the values whose syndrome is 0.

    Bit i of a factor of 15 has syndrome i + 1 in the factor's own 4 bits, free bits have 0. A value's
    anchors within a distance are itself with those bits flipped whose syndromes sum to its own.
    """

    def __init__(self, start: int, size: int, threshold: int):
        self.start, self.size = start, size
        self.radius = size // HAMMING
        columns = [(i % HAMMING + 1) << (4 * (i // HAMMING)) if i < self.radius * HAMMING else 0 for i in range(size)]
        self.columns = np.array(columns, np.uint64)
        flips: list[list[tuple[int, int]]] = [[] for _ in range(1 << 4 * self.radius)]
        for weight in range(self.radius + threshold + 1):
            for bits in combinations(range(size), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= columns[b]
                flips[syndrome].append((sum(1 << b for b in bits), weight))
        #: of each syndrome the flips that lead to an anchor, the nearest anchor's first
        self.flips = [np.array([f for f, _ in found], np.uint64) for found in flips]
        assert all(found and found[0][1] <= self.radius for found in flips)

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each fingerprint (uint64) every anchor in reach: the fingerprint's number, the anchor, and whether it is at home there."""
        values = (fps >> np.uint64(self.start)) & np.uint64((1 << self.size) - 1)
        syndromes = np.zeros(len(fps), np.uint64)
        for b in range(self.size):
            syndromes ^= np.where(values >> np.uint64(b) & np.uint64(1), self.columns[b], np.uint64(0))
        numbers, anchors, homes = [], [], []
        for s in np.unique(syndromes):
            at, flips = np.flatnonzero(syndromes == s), self.flips[int(s)]
            numbers.append(np.repeat(at, len(flips)))
            anchors.append((values[at][:, None] ^ flips).reshape(-1))
            homes.append(np.tile(np.arange(len(flips)) == 0, len(at)))
        if not numbers:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        return np.concatenate(numbers), np.concatenate(anchors), np.concatenate(homes)


def codes(segments: int) -> list[CoveringCode]:
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [CoveringCode(a, b - a, BITS // segments) for a, b in zip(cuts, cuts[1:])]


_MEMBERS = "bucket long, node long, home boolean"


def _dealer(segments: int):
    """Function that deals fingerprints (node) to anchors; a bucket is a segment and an anchor."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codes(segments)
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for at in range(0, len(nodes), 4096):
                part = nodes[at : at + 4096]
                for k, code in enumerate(of):
                    number, anchor, home = code.anchors(part.view(np.uint64))
                    bucket = ((np.uint64(k) << np.uint64(56)) | anchor).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(part[number]), pa.array(home)], ["bucket", "node", "home"])

    return deal


def grow(fps: np.ndarray, home: np.ndarray, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (numbers of members) that join all members of an anchor that a chain of links through those at home joins.

    With labels, members of one class are joined already; with sides, only members of different sides meet.
    """
    out: list[tuple[int, int]] = []
    if labels is None:
        rest = np.arange(len(fps))  # those that no searched class has at home
        todo = home.copy()
        for first in np.flatnonzero(home):
            if not todo[first]:
                continue
            queue, todo[first] = [int(first)], False
            apart, mine = rest[rest != first], [int(first)]
            while queue:
                m = queue.pop()
                near = np.bitwise_count(fps[apart] ^ fps[m]) <= BITS
                found = apart[near]
                if len(found):
                    out += [(m, int(x)) for x in found]
                    apart = apart[~near]
                    more = found[home[found] & todo[found]]
                    todo[more] = False
                    queue += more.tolist()
                    mine += more.tolist()
            if len(mine) > 1:
                gone = np.zeros(len(fps), bool)
                gone[mine] = True
                rest = rest[~gone[rest]]
            else:
                rest = rest[rest != first]
        return out
    of = np.unique(labels, return_inverse=True)[1]
    for m in np.flatnonzero(home):
        other = of != of[m]
        if sides is not None:
            other &= sides != sides[m]
        others = np.flatnonzero(other)
        near = others[np.bitwise_count(fps[others] ^ fps[m]) <= BITS]
        for x in near.tolist():
            if of[x] != of[m]:
                out.append((int(m), x))
                of[of == of[x]] = of[m]
    return out


_LINKS = "a long, b long"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all anchors of a group."""
    table = pa.Table.from_batches(list(batches))
    nodes, buckets, home = (table[c].to_numpy() for c in ("node", "bucket", "home"))
    labels, sides = ((table[c].to_numpy() if c in table.column_names else None) for c in ("label", "side"))
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order])) + 1
    starts, ends = np.append(0, edges), np.append(edges, len(order))
    # an anchor with someone at home and someone else
    with_home = np.logical_or.reduceat(home[order], starts) & (ends - starts > 1) if len(order) else np.empty(0, bool)
    fps, a, b = nodes.view(np.uint64), [], []
    for start, end in zip(starts[with_home].tolist(), ends[with_home].tolist()):
        part = order[start:end]
        if end - start == 2 and labels is None:
            if int(fps[part[0]] ^ fps[part[1]]).bit_count() <= BITS:
                a.append(nodes[part[:1]])
                b.append(nodes[part[1:]])
            continue
        own = (None if x is None else x[part] for x in (labels, sides))
        found = np.array(grow(fps[part], home[part], *own), np.int64).reshape(-1, 2)
        a.append(nodes[part[found[:, 0]]])
        b.append(nodes[part[found[:, 1]]])
    ends_ = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b)]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends_], ["a", "b"])


def _in_groups(members: DataFrame, groups: int) -> DataFrame:
    keyed = members.withColumn("group", F.pmod(F.xxhash64("bucket"), F.lit(max(16, groups))).cast("int"))
    return keyed.groupBy("group").applyInArrow(_links, _LINKS)


def links(nodes: DataFrame, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """a, b: links that join what is within BITS, of distinct fingerprints (node, copies), written before."""
    n = nodes.count()
    segments = segments or (3 if n <= MANY else 2)
    members = nodes.select("node").mapInArrow(_dealer(segments), _MEMBERS)
    per_node = sum(np.mean([len(f) for f in c.flips]) for c in codes(segments))
    groups = int(n * per_node // GROUP_ROWS)
    at_home = members.filter("home").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large = materialize(at_home, "large")
    if large.isEmpty():
        return materialize(_in_groups(members, groups), "links")
    hot = materialize(members.join(small(large), "bucket"), "hot")
    few = members.join(small(large.select("bucket")), "bucket", "left_anti")
    # in parts, and to the commonest fingerprint
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block))
    parts = hot.withColumn("bucket", F.xxhash64("bucket", part)).drop("n")
    leaders = hot.filter("home").join(nodes, "node").groupBy("bucket").agg(F.max(F.struct("copies", "node"))["node"].alias("leader"))
    star = hot.join(small(materialize(leaders, "leaders")), "bucket").filter(
        (F.bit_count(F.col("node").bitwiseXOR(F.col("leader"))) <= BITS) & (F.col("node") != F.col("leader"))
    )
    found = _in_groups(few.unionByName(parts), groups).union(star.select(F.col("leader").alias("a"), F.col("node").alias("b")))
    found = materialize(found, "links")
    roots = materialize(components(found), "roots")
    labelled = hot.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialize(labelled.select("bucket", "node", "label", "home"), "labelled")
    met = blocks(labelled.drop("home"), block).join(labelled.select("bucket", "node", "home"), ["bucket", "node"])
    by = ("bucket", "lo", "hi")
    met = materialize(met, "met")
    more = met.filter("lo = hi").drop("side").groupBy(*by).applyInArrow(_links, _LINKS)
    more = more.union(met.filter("lo < hi").groupBy(*by).applyInArrow(_links, _LINKS))
    return found.union(materialize(more, "links"))


def near_duplicates(docs: DataFrame, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (smallest doc_id of the component), one row a row of docs."""
    rows = materialize(fingerprints(docs), "fingerprints")
    nodes = rows.groupBy(F.col("fp").alias("node")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    nodes = materialize(nodes, "nodes")
    roots = materialize(components(links(nodes.select("node", "copies"), segments, block)), "roots")
    joined = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = materialize(joined, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(named.join(least, "root").select("node", "component_id"), "components")
    return rows.join(small(of), F.col("fp") == F.col("node")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
