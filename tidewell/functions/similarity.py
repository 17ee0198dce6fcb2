"""String similarity. Columns where Spark has the pieces, Arrow functions for the rest."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: what a lambda names from outside is computed at each of its calls."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(text: Column, k: int) -> Column:
    """Each run of k characters, in order, after collapsing white space."""

    def of(clean: Column) -> Column:
        n = F.char_length(clean)
        runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(clean, i, F.lit(k)))
        return F.when(n >= k, runs).otherwise(F.array().cast("array<string>"))

    return _once(F.regexp_replace(text, r"\s+", " "), of)


def shingle_counts(text: Column, k: int) -> Column:
    """Map of each run of k characters to its count, after collapsing white space."""

    def of(runs: Column) -> Column:
        return _once(
            F.array_distinct(runs),
            lambda distinct: F.map_from_arrays(distinct, F.transform(distinct, lambda g: F.size(runs) - F.size(F.array_remove(runs, g)))),
        )

    return _once(_runs(text, k), of)


def shingle_set(text: Column, k: int) -> Column:
    return F.array_distinct(_runs(text, k))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of shingles; 0 if there are none."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    low = F.least(F.size(a), F.size(b))
    return F.when(low > 0, F.size(F.array_intersect(a, b)) / low).otherwise(0.0)


def _get(m: Column, k: Column) -> Column:
    return F.coalesce(F.try_element_at(m, k), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Of two shingle counts; 0 if either is empty."""
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + _get(a, k) * _get(b, k))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def qgram_distance(a: Column, b: Column) -> Column:
    """Sum of the differences of two shingle counts."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.aggregate(keys, F.lit(0), lambda s, k: s + F.abs(_get(a, k) - _get(b, k)))


def normalized_levenshtein(a: Column, b: Column) -> Column:
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n > 0, F.levenshtein(a, b) / n).otherwise(0.0)


def _pairs(f):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)])

    return apply


#: Cells of the tables that are filled at a time.
_CELLS = 2_000_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points by text, padded at the right, and the lengths."""
    sizes = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), max(int(sizes.max(initial=0)), 1)), np.uint32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def _in_tables(fill, whole: bool = True):
    """Function of two series of texts: distances of pairs (whole numbers or not), those of like length together in
    tables of about _CELLS cells."""

    def distances(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.tolist(), b.tolist()
        out = np.full(len(a), np.nan)
        known = [k for k in range(len(a)) if a[k] is not None and b[k] is not None]
        size = {k: (len(a[k]) + 2) * (len(b[k]) + 2) for k in known}
        known.sort(key=size.__getitem__)
        at = 0
        while at < len(known):
            to, long, wide = at, 0, 0
            while to < len(known):
                x, y = max(long, len(a[known[to]]) + 2), max(wide, len(b[known[to]]) + 2)
                if to > at and (to - at + 1) * x * y > _CELLS:
                    break
                long, wide, to = x, y, to + 1
            part = known[at:to]
            out[part] = fill(*_codes([a[k] for k in part]), *_codes([b[k] for k in part]))
            at = to
        found = pd.array(np.nan_to_num(out), "Int64") if whole else out.astype(object)
        return pd.Series(found).where(~np.isnan(out), None)

    return distances


def _row(best: np.ndarray, first: int) -> np.ndarray:
    """A table's row from what its cells cost without an insertion: best by pair and column from 1, first at column 0."""
    n, width = best.shape
    row = np.concatenate([np.full((n, 1), first), best], 1)
    steps = np.arange(width + 1)
    return np.minimum.accumulate(row - steps, 1) + steps


def _damerau(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """True Damerau-Levenshtein distance: transposed characters may have others between them."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    j = np.arange(1, lb + 1)
    d = np.empty((n, la + 1, lb + 1), np.int64)
    d[:, 0] = np.arange(lb + 1)
    seen = np.zeros((n, lb), np.int64)  # the last row before whose character is the column's
    pair = np.arange(n)[:, None]
    for i in range(1, la + 1):
        same = b == a[:, i - 1 : i]
        match = np.maximum.accumulate(np.where(same, j, 0), 1)
        col = np.concatenate([np.zeros((n, 1), np.int64), match[:, :-1]], 1)
        last = d[:, i - 1]
        best = np.minimum(last[:, :-1] + ~same, last[:, 1:] + 1)
        swapped = d[pair, np.maximum(seen - 1, 0), np.maximum(col - 1, 0)] + (i - seen - 1) + 1 + (j - col - 1)
        best = np.where((seen > 0) & (col > 0), np.minimum(best, swapped), best)
        d[:, i] = _row(best, i)
        seen = np.where(same, i, seen)
    return d[np.arange(n), n_a, n_b]


def _lcs(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence."""
    each = np.arange(len(a))
    inside = np.arange(b.shape[1]) < n_b[:, None]
    last = np.zeros((len(a), b.shape[1] + 1), np.int64)
    out = np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        same = (b == a[:, i : i + 1]) & inside
        last[:, 1:] = np.maximum.accumulate(np.maximum(last[:, 1:], last[:, :-1] + same), 1)
        out = np.where(n_a == i + 1, last[each, n_b], out)
    return out


lcs_length = F.pandas_udf(_in_tables(_lcs), T.LongType())
damerau = F.pandas_udf(_in_tables(_damerau), T.LongType())


def metric_lcs(a: Column, b: Column) -> Column:
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n > 0, 1 - lcs_length(a, b) / n).otherwise(0.0)


def _osa(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    last = np.tile(np.arange(lb + 1), (n, 1))
    before, out = last, last[np.arange(n), n_b]
    for i in range(1, la + 1):
        cost = (b != a[:, i - 1 : i]).astype(np.int64)
        best = np.minimum(last[:, 1:] + 1, last[:, :-1] + cost)
        if i > 1 and lb > 1:
            swap = (a[:, i - 1 : i] == b[:, :-1]) & (a[:, i - 2 : i - 1] == b[:, 1:])
            best[:, 1:] = np.where(swap, np.minimum(best[:, 1:], before[:, : lb - 1] + cost[:, 1:]), best[:, 1:])
        before, last = last, _row(best, i)
        out = np.where(n_a == i, last[np.arange(n), n_b], out)
    return out


osa = F.pandas_udf(_in_tables(_osa), T.LongType())

#: Fixed values of the boost for a common prefix: from which similarity on, and its weight.
JARO_THRESHOLD, JARO_WEIGHT = 0.7, 0.1


def _jaro_winkler(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaro similarity, raised for a common prefix of any length where it exceeds the threshold."""
    pairs, la, lb = len(a), a.shape[1], b.shape[1]
    each, places = np.arange(pairs), np.arange(lb)
    longest = np.maximum(n_a, n_b)
    reach = np.maximum(longest // 2 - 1, 0)[:, None]
    free = places < n_b[:, None]
    mine = np.zeros((pairs, la), bool)
    for i in range(la):
        fits = free & (b == a[:, i : i + 1]) & (abs(places - i) <= reach) & (i < n_a)[:, None]
        mine[:, i] = fits.any(1)
        free[each, fits.argmax(1)] &= ~mine[:, i]
    theirs = ~free & (places < n_b[:, None])
    m = mine.sum(1)
    most = int(m.max(initial=0))
    # the matched characters of each text in its own order
    x, y = (np.take_along_axis(t, np.argsort(~f, 1, kind="stable"), 1)[:, :most] for t, f in ((a, mine), (b, theirs)))
    swapped = ((x != y) & (np.arange(most) < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / n_a + m / n_b + (m - swapped) / m) / 3, 0.0)
        low = min(la, lb)
        apart = (a[:, :low] != b[:, :low]) | (np.arange(low) >= np.minimum(n_a, n_b)[:, None])
        prefix = np.where(apart.any(1), apart.argmax(1), low)
        raised = jaro + np.minimum(JARO_WEIGHT, 1 / longest) * prefix * (1 - jaro)
    return np.where(jaro > JARO_THRESHOLD, raised, jaro)


jaro_winkler = F.pandas_udf(_in_tables(_jaro_winkler, whole=False), T.DoubleType())


#: Fixed value: what stands before a text so that its first characters make whole n-grams.
AFFIX = ord("\n")


def ngram_distance(n: int = 2):
    """Column function of the n-gram distance of two texts: an edit distance over n-grams, whose substitutions cost the
    part of their characters that differ, over the longer length.

    Texts are preceded by n - 1 affixes, and common affixes don't count. If either text is
    empty it is 1; if either is shorter than n, the part of equal places is taken from 1.
    Column 0 of the table is filled as the others are, where an index before the first is the last:
    its left neighbour is the last cell of the row two before, its diagonal one the
    last cell of the row before.
    """

    def fill(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        pairs, la, lb = len(a), a.shape[1], b.shape[1]
        longest = np.maximum(np.maximum(n_a, n_b), 1)
        each = np.arange(pairs)
        low = min(la, lb)
        places = np.arange(low) < np.minimum(n_a, n_b)[:, None]
        equal = ((a[:, :low] == b[:, :low]) & places).sum(1)
        out = np.where((n_a == 0) | (n_b == 0), 1.0, 1 - equal / longest)
        if n == 1:
            front = np.empty((pairs, 0), a.dtype)
        else:
            front = np.full((pairs, n - 1), AFFIX, a.dtype)
        sa, sb = np.concatenate([front, a], 1), np.concatenate([front, b], 1)
        # the n-gram of place i, and at place -1 the one that begins with the last character
        grams_a = np.stack([sa[:, k : k + la] for k in range(n)], 2)
        wrapped = np.concatenate([sa[each, n_a + n - 2][:, None], sa[:, : n - 1]], 1)[:, None]
        grams_a = np.concatenate([wrapped, grams_a], 1)
        last = np.tile(np.arange(la + 1, dtype=np.float64), (pairs, 1))
        before = np.zeros((pairs, la + 1))
        steps = np.arange(la + 1)
        for j in range(1, lb + 1):
            same = grams_a == sb[:, None, j - 1 : j - 1 + n]
            cost = (~same).sum(2) / (n - (same & (grams_a == AFFIX)).sum(2))
            diagonal = np.concatenate([last[each, n_a][:, None], last[:, :-1]], 1)
            best = np.minimum(last + 1, diagonal + cost)
            best[:, 0] = np.minimum(best[:, 0], before[each, n_a] + 1)
            row = np.minimum.accumulate(best - steps, 1) + steps
            before, last = last, row
            out = np.where((n_b == j) & (n_a >= n) & (j >= n), row[each, n_a] / longest, out)
        return out

    return F.pandas_udf(_in_tables(fill, whole=False), T.DoubleType())


def weighted_levenshtein(
    insert: dict[str, float] | None = None, delete: dict[str, float] | None = None, substitute: dict[tuple[str, str], float] | None = None
):
    """Column function of an edit distance with costs by character (1 where none is given; equal characters cost nothing)."""
    known = {k: (np.array(sorted(map(ord, t or {})), np.int64), t or {}) for k, t in (("insert", insert), ("delete", delete))}
    shift = 1 << 21
    pairs_ = {ord(x) * shift + ord(y): c for (x, y), c in (substitute or {}).items()}
    keys = np.array(sorted(pairs_), np.int64)
    costs = np.array([pairs_[k] for k in keys], np.float64)

    def looked_up(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.ones(x.shape)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, values[at], 1.0)

    def of(kind: str, x: np.ndarray) -> np.ndarray:
        codes, table = known[kind]
        return looked_up(codes, np.array([table[chr(c)] for c in codes], np.float64), x)

    def fill(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        a, b = a.astype(np.int64), b.astype(np.int64)
        each = np.arange(len(a))
        added = np.concatenate([np.zeros((len(a), 1)), np.cumsum(of("insert", b), 1)], 1)
        gone = of("delete", a)
        last = added
        out = last[each, n_b]
        for i in range(a.shape[1]):
            x = a[:, i : i + 1]
            change = np.where(x == b, 0.0, looked_up(keys, costs, x * shift + b))
            best = np.concatenate([last[:, :1] + gone[:, i : i + 1], np.minimum(last[:, :-1] + change, last[:, 1:] + gone[:, i : i + 1])], 1)
            last = np.minimum.accumulate(best - added, 1) + added
            out = np.where(n_a == i + 1, last[each, n_b], out)
        return out

    return F.pandas_udf(_in_tables(fill, whole=False), T.DoubleType())


def words_of(text: str) -> list[str]:
    return text.split()


def letters_of(text: str) -> list[int]:
    """How often each letter from a to z occurs, in lower case."""
    low = text.lower()
    return [low.count(chr(c)) for c in range(ord("a"), ord("z") + 1)]


class Sift4:
    """Distance of two token lists by one pass that looks ahead up to `offset` tokens, and takes off transpositions.

    tokenizer: of a text (default: its characters); matches(x, y): whether two tokens
    agree; match_worth(x, y): what an agreement counts; length_worth(n): what a run of
    agreements counts; transposition_cost(i, j): what one between places i and j costs;
    evaluate(common, transposed): what is taken from the longer length. The distance is
    rounded, halves to even.
    """

    def __init__(self, offset: int = 5, limit: int = 0, tokenizer=list, matches=None, match_worth=None, length_worth=None, transposition_cost=None, evaluate=None):
        self.offset, self.limit, self.tokenizer = offset, limit, tokenizer
        self.matches = matches or (lambda x, y: x == y)
        self.match_worth = match_worth or (lambda x, y: 1)
        self.length_worth = length_worth or (lambda n: n)
        self.transposition_cost = transposition_cost or (lambda i, j: 1)
        self.evaluate = evaluate or (lambda common, transposed: common - transposed)

    def __call__(self, a: str, b: str) -> int:
        x, y = self.tokenizer(a), self.tokenizer(b)
        if not x or not y:
            return max(len(x), len(y))
        i = j = 0
        common = run = transposed = 0.0
        crossed: list[list] = []  # agreements so far: their places, and whether they count as transposed
        while i < len(x) and j < len(y):
            if self.matches(x[i], y[j]):
                run += self.match_worth(x[i], y[j])
                transposed += self._crossing(crossed, i, j)
            else:
                common, run = common + self.length_worth(run), 0.0
                i = j = min(i, j)
                for k in range(max(self.offset, 0)):
                    # the nearest agreement ahead, in the first text before the second
                    if i + k < len(x) and self.matches(x[i + k], y[j]):
                        i, j = i + k - 1, j - 1
                        break
                    if j + k < len(y) and self.matches(x[i], y[j + k]):
                        i, j = i - 1, j + k - 1
                        break
            i, j = i + 1, j + 1
            if self.limit and max(i, j) - self.evaluate(common, transposed) >= self.limit:
                return round(max(i, j) - self.evaluate(common, transposed))
            if i >= len(x) or j >= len(y):
                common, run = common + self.length_worth(run), 0.0
                i = j = min(i, j)
        common += self.length_worth(run)
        return round(max(len(x), len(y)) - self.evaluate(common, transposed))

    def _crossing(self, crossed: list[list], i: int, j: int) -> float:
        """Cost of the transpositions that the agreement of i and j makes."""
        cost, is_transposed, at = 0.0, False, 0
        while at < len(crossed):
            p, q, counted = crossed[at]
            if i <= p or j <= q:
                is_transposed = abs(j - i) >= abs(q - p)
                if is_transposed:
                    cost = self.transposition_cost(i, j)
                elif not counted:
                    crossed[at][2] = True
                    cost = self.transposition_cost(p, q)
                break
            if i > q and j > p:
                del crossed[at]
            else:
                at += 1
        crossed.append([i, j, is_transposed])
        return cost


def sift4(offset: int = 5, **how):
    """Column function of the SIFT4 distance; how: as Sift4."""
    return F.pandas_udf(_pairs(Sift4(offset, **how)), T.LongType())
