"""n-gram, SIFT4 and weighted distances against plain versions, over classes of pairs: empty, single, equal, long, of other scripts, of shifted sizes."""

import random

import pandas as pd
import pytest

from tidewell.functions import similarity as S


def _pairs():
    rng = random.Random(11)
    text = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(n))
    out = [("", ""), ("", "a"), ("a", ""), ("a", "a"), ("a", "b"), ("ab", "a"), ("上海市" + text(8), "上海" + text(8)), (text(63), text(65)), (text(24), text(24)), (text(130), text(128)), ("\n\n", "\na")]
    out += [(text(n, "ab"), text(m, "ab")) for n in range(6) for m in range(6)]
    for _ in range(60):
        x = text(rng.randint(0, 14), "abcé")
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            if y and rng.random() < 0.5:
                k = rng.randrange(len(y))
                y[k : k + 2] = reversed(y[k : k + 2])
            else:
                y.insert(rng.randint(0, len(y)), rng.choice("abz\n"))
        out.append((x, "".join(y)))
    return out


def _run(udf, pairs):
    a, b = zip(*pairs)
    return udf.func(pd.Series(a), pd.Series(b)).tolist()


def _plain_ngram(a, b, n):
    if not a or not b:
        return 1.0
    longest = max(len(a), len(b))
    if len(a) < n or len(b) < n:
        return 1 - sum(x == y for x, y in zip(a, b)) / longest
    sa, sb = "\n" * (n - 1) + a, "\n" * (n - 1) + b
    rows = [[0.0] * (len(a) + 1), [float(k) for k in range(len(a) + 1)]]  # the rows before the first two
    for j in range(len(b)):
        gram, row = sb[j : j + n], list(rows[-2])
        row[0] = j + 1.0
        for i in range(len(a) + 1):
            mine = [sa[i - 1 + k] for k in range(n)]  # at -1 the last character comes first
            differ = sum(x != y for x, y in zip(mine, gram))
            affixes = sum(x == y == "\n" for x, y in zip(mine, gram))
            row[i] = min(row[i - 1] + 1, rows[-1][i] + 1, rows[-1][i - 1] + differ / (n - affixes))
        rows.append(row)
    return rows[-1][-1] / longest


@pytest.mark.parametrize("n", [2, 3, 4])
def test_ngram_distance(n):
    pairs = [p for p in _pairs() if "\n" not in p[0] + p[1]]
    for (a, b), got in zip(pairs, _run(S.ngram_distance(n), pairs)):
        assert got == pytest.approx(_plain_ngram(a, b, n), abs=1e-12), (a, b)
    assert _run(S.ngram_distance(2), [(None, "a"), ("a", None), ("ab", "ab")]) == [None, None, 0.0]


def test_weighted_levenshtein():
    insert, delete, change = {"a": 0.25, "é": 3.0}, {"b": 2.5}, {("a", "b"): 0.1, ("c", "é"): 7.0}

    def plain(a, b):
        d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = [0.0] if i == j == 0 else []
                if i:
                    ways.append(d[i - 1][j] + delete.get(a[i - 1], 1.0))
                if j:
                    ways.append(d[i][j - 1] + insert.get(b[j - 1], 1.0))
                if i and j:
                    ways.append(d[i - 1][j - 1] + (0.0 if a[i - 1] == b[j - 1] else change.get((a[i - 1], b[j - 1]), 1.0)))
                d[i][j] = min(ways)
        return d[-1][-1]

    pairs = _pairs()
    for (a, b), got in zip(pairs, _run(S.weighted_levenshtein(insert, delete, change), pairs)):
        assert got == pytest.approx(plain(a, b), abs=1e-9), (a, b)


def _walk(s, t, offset):
    """Agreeing places of the greedy walk, in order; the walk ends where a text does."""
    at, out = (0, 0), []
    while at[0] < len(s) and at[1] < len(t):
        i, j = at
        if s[i] == t[j]:
            out.append(at)
            at = (i + 1, j + 1)
        else:
            here = min(i, j)
            ahead = [(here + k, here) for k in range(offset)], [(here, here + k) for k in range(offset)]
            tries = [p for both in zip(*ahead) for p in both]
            at = next(((i, j) for i, j in tries if i < len(s) and j < len(t) and s[i] == t[j]), (here + 1, here + 1))
        if max(at[0] - len(s), at[1] - len(t)) >= 0:
            at = (min(at), min(at))
    return out


def _plain_sift4(s, t, offset):
    """Walk first, then replay the agreements to count the transpositions."""
    if not s or not t:
        return max(len(s), len(t))
    places, earlier, swaps = _walk(s, t, offset), [], 0
    for i, j in places:
        # the first earlier agreement that is not wholly before this one; those before both of its places are done with
        n = next((n for n, e in enumerate(earlier) if i <= e[0] or j <= e[1]), len(earlier))
        crossed = earlier[n] if n < len(earlier) else None
        earlier = [e for e in earlier[:n] if i <= e[1] or j <= e[0]] + earlier[n:]
        new = crossed is not None and abs(j - i) >= abs(crossed[1] - crossed[0])
        if crossed is not None and (new or not crossed[2]):
            swaps += 1
            crossed[2] = crossed[2] or not new
        earlier.append([i, j, new])
    return round(max(len(s), len(t)) - (len(places) - swaps))


@pytest.mark.parametrize("offset", [0, 1, 5, 20])
def test_sift4(offset):
    pairs = _pairs()
    assert _run(S.sift4(offset), pairs) == [_plain_sift4(a, b, offset) for a, b in pairs]


def _plain_jaro_winkler(a, b):
    reach, left, mine = max(max(len(a), len(b)) // 2 - 1, 0), dict(enumerate(b)), []
    for i, x in enumerate(a):
        j = min((j for j in left if left[j] == x and abs(i - j) <= reach), default=None)
        if j is not None:
            mine.append(left.pop(j))
    theirs = [x for j, x in enumerate(b) if j not in left]
    if not mine:
        return 0.0
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(mine, theirs)) // 2) / m) / 3
    prefix = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return jaro if jaro <= 0.7 else jaro + min(0.1, 1 / max(len(a), len(b))) * prefix * (1 - jaro)


def test_batched_lcs_and_jaro_winkler():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    pairs = _pairs() + [("\0", ""), ("\0a", "a\0")]
    assert _run(S.lcs_length, pairs) == [lcs(a, b) for a, b in pairs]
    for (a, b), got in zip(pairs, _run(S.jaro_winkler, pairs)):
        assert got == pytest.approx(_plain_jaro_winkler(a, b), abs=1e-12), (a, b)


def test_sift4_parameters():
    assert S.Sift4(tokenizer=S.words_of)("the quick brown fox", "the brown quick fox") == 1
    assert S.Sift4(tokenizer=S.letters_of)("abc", "ABC") == 0
    assert S.Sift4()("This is the first string", "And this is another string") == 11
    # halves to even: 4 - 1.5 and 5 - 1.5
    half = {"evaluate": lambda common, transposed: 1.5}
    assert S.Sift4(**half)("abcd", "abcd") == 2 and S.Sift4(**half)("abcde", "abcde") == 4
    costly = S.Sift4(transposition_cost=lambda i, j: abs(j - i) / 9 + 1)
    assert costly("abcdef", "bacdef") >= S.Sift4()("abcdef", "bacdef")
    assert S.Sift4(length_worth=lambda n: n - 1 / (n + 1) if n >= 1 else n)("abcd", "abcd") == 0
    assert S.Sift4(matches=lambda x, y: x.lower() == y.lower())("ABC", "abc") == 0


def test_in_spark(spark):
    rows = spark.createDataFrame([(1, "kitten", "sitting"), (2, None, "x"), (3, "", "")], "id int, a string, b string")
    got = {r.id: r for r in rows.select("id", S.ngram_distance(2)("a", "b").alias("n"), S.weighted_levenshtein()("a", "b").alias("w"), S.sift4()("a", "b").alias("s")).collect()}
    assert got[1].w == 3.0 and got[1].n == pytest.approx(_plain_ngram("kitten", "sitting", 2)) and got[1].s == _plain_sift4("kitten", "sitting", 5)
    assert got[2].n is got[2].w is got[2].s is None and (got[3].n, got[3].w, got[3].s) == (1.0, 0.0, 0)
