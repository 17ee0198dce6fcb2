"""Manifest, clustering and SimHash against plain versions: odd rows, ties, repeated rows, empty tables, planted cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import centroid_clustering as C
from tidewell.llm import merkle_manifest as M
from tidewell.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, at string, block string, root string"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "r") for r in rows], SCHEMA)


# 11


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return _hash(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash(*last[k : k + 16]) for k in range(0, len(last), 16)])
    return levels


def _siblings(levels, i):
    out = []
    for level in levels[:-1]:
        start = i - i % 16
        out.append((i % 16, level[start:i] + level[i + 1 : start + 16]))
        i //= 16
    return out


def _plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars). Returns rows of the query, as a sorted list."""
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, _leaf(*r), r))
    trees = {s: sorted(v, key=lambda x: x[:3]) for s, v in by.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: _levels([x[2] for x in v]) for s, v in trees.items()}
    top = _levels([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(trees[s]):
            steps = _siblings(levels[s], i) + _siblings(top, k)
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if forged and r[1] is not None else r[1]
            node = _leaf(r[0], text, *r[2:])
            for place, rest in steps:
                node = _hash(*rest[:place], node, *rest[place:])
            proof = _hash(*[x for _, rest in steps for x in rest])
            out.append((r[0], leaf, levels[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def _manifest(docs):
    forged = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    got = M.verify(M.manifest(docs, F.when(forged, F.translate("text", M.UPPER, M.LOWER)).otherwise(F.col("text"))))
    proof = F.sha2(F.array_join("siblings", ""), 256)
    rows = got.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()
    return sorted(map(tuple, rows), key=str)


def _rows(sizes, seed=1):
    rng, out = random.Random(seed), []
    for source, n in sizes.items():
        out += [(len(out) + k, f"Text {k} É" if k % 3 else f"text {k}", rng.choice(["en", None]), source, rng.choice([None, k])) for k in range(n)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(
    "sizes",
    [{"one": 1}, {"b": 16, "a": 17, None: 1, "é": 255}, {"x": 256, "y": 257}, {"big": 4097, "": 2}, {"huge": 9000}, {f"s{k}": 1 + k % 3 for k in range(40)}],
    ids=range(6),
)
def test_manifest_is_the_plain_one(spark, sizes):
    rows = _rows(sizes)
    assert _manifest(_docs(spark, rows)) == _plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    odd = [(None, None, None, None, None), (None, "A", "en", "s", 1), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, None, "en", "s", 0), (2, LONG, "en", "s", 9)]
    rows = odd + [(7, "same", "en", "s", 4)] * 700 + [(None, "null id", "en", "s", 4)] * 40
    got = _manifest(_docs(spark, rows))
    assert got == _plain_manifest(rows)
    assert M.manifest(_docs(spark, [])).count() == 0


def test_manifest_shows_what_was_changed(spark):
    rows = _rows({"a": 300, "b": 20})
    docs = _docs(spark, rows)
    assert M.verify(M.manifest(docs)).filter("not verified").count() == 0
    forged = M.verify(M.manifest(docs, F.when(F.col("doc_id") == 5, F.lit("other")).otherwise(F.col("text"))))
    assert [r.doc_id for r in forged.filter("not verified").collect()] == [5]


def test_traversal_holds_two_subtrees():
    """However long the block, no more than two subtrees' rows are held before a path goes out."""
    import pyarrow as pa

    schema = pa.schema([("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("places", pa.list_(pa.int32())), ("siblings", pa.list_(pa.string()))])
    leaves = [_hash(str(k)) for k in range(4096)]
    levels = _levels(leaves)
    walk = M._Traversal(schema, ["leaf"])
    walk.begin({"height": 3, "run": levels[2], "steps": [], "subroot": "s", "root": "r"})
    most = 0
    for leaf in leaves:
        walk.add({"leaf": leaf})
        held = len(walk.coming) + (len(walk.held) - walk.out if walk.existing else 0)
        most = max(most, held)
    list(walk.end())
    assert most <= 2 * 256 and [r[0] for r in walk.rows] == leaves
    for i in (0, 15, 16, 300, 4095):
        want = _siblings(levels, i)
        assert walk.rows[i][3:] == [[p for p, _ in want], ["".join(x) for _, x in want]]


# 12


def _plain_clusters(rows, k=8, rounds=10):
    """rows: (vec_id, embedding). Sorted rows of the query."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = np.array([v for _, v in starts], np.int64)
    x = np.array([v for _, v in kept], np.int64)
    for r in range(rounds + 1):
        d = ((x[:, None] - centroids[None]) ** 2).sum(2)
        a = d.argmin(1)
        if r < rounds:
            for c in range(len(centroids)):
                if (a == c).any():
                    centroids[c] = x[a == c].sum(0) // (a == c).sum()
    mine = d.min(1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    out = [(i, int(c), int(m), int(mine[a == c].sum()), int(mine.sum()), sha[c]) for (i, _), c, m in zip(kept, a, mine)]
    return sorted(out, key=str)


def _vectors(spark, rows):
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, a int, v double")
    return sorted(map(tuple, C.clusters(table.repartition(3)).collect()), key=str)


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "one", "equal"])
def test_clusters_are_lloyds(spark, kind):
    rng = np.random.default_rng(3)
    n = {"few": 5, "one": 1}.get(kind, 400)
    v = rng.normal(size=(n, 64))
    if kind == "ties":  # few distinct values, so that many distances are equal
        v = rng.integers(0, 2, (n, 64)) * np.repeat([1.0, 0.0], [4, 60]) / 16
    if kind == "equal":
        v[:] = v[0]
    rows = [(k, x) for k, x in enumerate(v.astype(np.float32).tolist())]
    if kind == "spread":
        odd = [None, [], [0.0] * 63, [0.0] * 65, [None] + [0.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [-0.0] * 64]
        rows += [(1000 + k, x) for k, x in enumerate(odd)] + [(None, rows[0][1])] * 3 + [(7, rows[9][1]), (7, rows[7][1])]
    assert _vectors(spark, rows) == _plain_clusters(rows)


def test_clusters_of_nothing(spark):
    assert _vectors(spark, []) == [] and _vectors(spark, [(1, None), (2, [1.0])]) == []
    with pytest.raises(Exception, match="component over"):
        _vectors(spark, [(1, [3e6] * 64)])


@pytest.mark.parametrize("seed", range(12))
def test_exponion_search_is_exact_and_saves_distances(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 24))
    middles = rng.integers(-3000, 3000, (k, 8))
    x = middles[rng.integers(0, k, 3000)] + rng.integers(-150, 150, (3000, 8)) * (seed % 3 > 0)
    centroids = middles + rng.integers(-80, 80, (k, 8)) * (seed % 2)
    if k > 3:
        centroids[2] = centroids[1]
    a, upper, lower = C.first_search(C.Geometry(centroids), x)
    total = 0
    for r in range(8):
        moved_to = centroids + rng.integers(-60, 60, (k, 8)) // (r + 1)
        if r == 4 and k > 2:
            moved_to[k - 1] = moved_to[0]
        moved = np.sqrt(((moved_to - centroids) ** 2).sum(1).astype(float)) * (1 + C.MARGIN)
        centroids = moved_to
        a, upper, lower, computed = C.exponion_search(C.Geometry(centroids), moved, x, a, upper, lower)
        d = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (a == d.argmin(1)).all()
        mine = np.sqrt(d.min(1).astype(float))
        d[np.arange(len(x)), a] = np.iinfo(np.int64).max
        assert (upper >= mine).all() and (k == 1 or (lower <= np.sqrt(d.min(1).astype(float))).all())
        total += computed
    assert k < 6 or total < 8 * len(x) * k / 2


# 13


def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _plain_classes(fps):
    """Of each fingerprint the smallest that a chain of links reaches."""
    fps = sorted(set(fps))
    of = {f: f for f in fps}
    for f in fps:
        if of[f] == f:
            queue = [f]
            while queue:
                x = queue.pop()
                for y in fps:
                    if of[y] == y and y > f and (x ^ y).bit_count() <= 4:
                        of[y] = f
                        queue.append(y)
    return of


def _plain_simhash(rows):
    fps = [(i, _plain_fingerprint(t)) for i, t in rows]
    of, least = _plain_classes([f for _, f in fps]), {}
    for i, f in fps:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    return sorted([(i, f"{f:016x}", least.get(of[f])) for i, f in fps], key=str)


def _simhash(docs, **kw):
    return sorted(map(tuple, S.near_duplicates(docs, **kw).collect()), key=str)


@pytest.mark.parametrize("kw", [{}, {"segments": 2}, {"segments": 2, "block": 2}, {"block": 5}], ids=str)
def test_simhash_is_the_plain_one(spark, kw):
    rng = random.Random(9)
    base = [" ".join(rng.choice(LONG.split()[:400]) for _ in range(60)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(150):  # edits of one or two words, so that fingerprints are near and just not near
        words = rng.choice(base[:4]).split()
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "Z"])
        rows.append((100 + k, " ".join(words)))
    rows += [(None, None), (900, ""), (901, " \t"), (902, "One two"), (903, "one TWO"), (904, LONG), (904, base[0]), (None, "only a null id here"), (905, "é É \x00 \x85 日本 a b")]
    docs = _docs(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = _simhash(docs, **kw)
    assert got == _plain_simhash(rows)
    assert S.near_duplicates(_docs(spark, []), **kw).count() == 0


def test_fingerprint_is_sparks_own_hash(spark):
    text = "the quick brown fox jumps over the lazy dog"
    words = text.split()
    shingles = [" ".join(words[k : k + 4]) for k in range(6)]
    h = [r.h & (2**64 - 1) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 6)
    assert S._fingerprint(text.encode(), xxhash.xxh64_intdigest) == want == _plain_fingerprint(text)


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_covering_code_brings_near_values_together(segments):
    """Whatever bits differ, up to four, one of the two is a guest, or at home, where the other is at home."""
    rng = random.Random(segments)
    of = S.codes(segments)
    a = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    b = np.array([int(x) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for x in a], np.uint64)
    met = np.zeros(len(a), bool)
    for code in of:
        (na, aa, ha), (nb, ab, _) = code.anchors(a), code.anchors(b)
        assert (np.bincount(na, ha, minlength=len(a)) == 1).all()  # at home once
        guests = defaultdict(set)
        for n, x in zip(nb.tolist(), ab.tolist()):
            guests[n].add(x)
        for n, x in zip(na[ha].tolist(), aa[ha].tolist()):
            met[n] |= x in guests[n]
    assert met.all()


@pytest.mark.parametrize("seed", range(20))
def test_grow_joins_what_is_linked(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 60))
    fps = np.zeros(n, np.uint64)
    for _ in range(int(rng.integers(3, 12))):
        flip = rng.random(n) < 0.4
        fps ^= np.where(flip, np.uint64(1) << np.uint64(rng.integers(0, 64)), np.uint64(0))
    home = rng.random(n) < 0.6

    def joined(pairs):
        of = np.arange(n)
        for x, y in pairs:
            of[of == of[y]] = of[x]
        return [np.flatnonzero(of == of[k])[0] for k in range(n)]

    near = [(x, y) for x in range(n) for y in range(n) if x != y and home[x] and np.bitwise_count(fps[x] ^ fps[y]) <= 4]
    found = S.grow(fps, home)
    assert all(np.bitwise_count(fps[x] ^ fps[y]) <= 4 for x, y in found) and joined(found) == joined(near)
    labels = np.array([k // 2 for k in range(n)])
    of_class = [(x, y) for x in range(n) for y in range(n) if labels[x] == labels[y]]
    assert joined([*S.grow(fps, home, labels), *of_class]) == joined([*near, *of_class])
