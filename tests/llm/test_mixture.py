"""Pareto order sampling: inclusion chances by document, hot sources, the search for the end."""

from collections import Counter

from tests.llm.test_operators import _docs
from tidewell.llm import mixture


def _chances(sizes, target):
    """Copies wanted of each size, by the definition: in proportion to 8 + digits, at most 3."""
    weights = {n: 8 + len(f"{n:b}") for n in sizes}
    capped = set()
    while True:
        mass = sum(weights[n] * n * k for n, k in sizes.items() if n not in capped)
        level = (target - sum(3 * n * k for n, k in sizes.items() if n in capped)) / mass if mass else 0
        over = {n for n in sizes if n not in capped and level * weights[n] >= 3}
        if not over:
            return {n: 3.0 if n in capped else level * weights[n] for n in sizes}
        capped |= over


def test_longer_documents_are_likelier(spark):
    """Frequencies of copies follow the chances, which differ within a source."""
    sizes = [(1, 3000), (6, 3000), (40, 1500), (300, 700)]
    rows = [(10_000 * k + i, "w " * n, s) for s in ("a", "b", "c") for k, (n, m) in enumerate(sizes) for i in range(m)]
    got = mixture.mix(_docs(spark, [(3 * i + "abc".index(s), t, s) for i, t, s in rows])).collect()
    for s in "abc":
        of = [r for r in got if r.source == s]
        want = _chances(dict(sizes), of[0].target)
        assert len(set(want.values())) == 4
        seen, number = Counter(), Counter()
        for r in of:
            seen[r.size] += r.copies
            number[r.size] += 1
        assert all(abs(seen[n] / number[n] - c) < 0.06 for n, c in want.items())
        assert abs(sum(r.taken for r in of) - of[0].target) <= 6


def test_the_search_by_digits_gives_the_same(spark, monkeypatch):
    """Few draws are ever put in order, however many a source has; one with most rows, ties and capped sources among them."""
    rows = [(i, "w " * (1 + i * i % 37), "hot" if i % 3 else f"s{i % 5}") for i in range(900)] + [(None, f"x {i % 4}", "hot") for i in range(50)]
    docs = _docs(spark, rows)
    want = Counter(map(tuple, mixture.mix(docs).collect()))
    monkeypatch.setattr(mixture, "FEW", 2)
    assert Counter(map(tuple, mixture.mix(docs).collect())) == want


def test_a_long_document_does_not_leave_room(spark):
    """Those beyond it that fit are taken."""
    rows = [(i, "w " * (5000 if i % 10 == 0 else 20), s) for i, s in enumerate(["a", "b"] * 50)]
    got = mixture.mix(_docs(spark, rows)).collect()
    for s in "ab":
        of = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 2500
