"""Bootstrapped personal data: what it discovers, how exactly, and redaction of odd documents."""

import random
import time

from tests.llm.test_operators import _docs, _spans
from tidewell.llm import pii


def _phone(rng):
    return f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"


def test_recall_and_precision_on_planted_identifiers(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, want, k = [], {}, 0

    def add(before, value, after, kind):
        nonlocal k
        head = " ".join(word() for _ in range(rng.randint(0, 30)))
        text = f"{head}{before}{value}{after} {word()}"
        rows.append((k, text))
        if kind:
            want[k] = f"{kind}:{len(head) + len(before)}:{len(head) + len(before) + len(value)}"
        k += 1

    for _ in range(20):  # seeds: base expressions find these
        add(" please call us on ", "+1 " + _phone(rng), " today", None)
        add("\nFax: ", "+44 20 7946 " + str(rng.randint(1000, 9999)), "", None)
        add(" write to ", f"{word()}@{word()}.example.org", "", None)
        add(" server at ", f"10.{rng.randint(0, 255)}.7.{rng.randint(0, 255)}", " answers", None)
    base = {i: t for i, t in rows}
    for _ in range(15):  # what the base expressions don't know, in the same surroundings
        add(" please call us on ", _phone(rng), " today", "phone")
        add("\nFax: ", f"020 7946 {rng.randint(1000, 9999)}", "", "phone")
        add(" write to ", f"{word()}@{word()}", "", "email")
    for _ in range(40):  # numbers elsewhere, and others before which the same word stands
        add(" the price of ", f"{rng.randint(10**7, 10**8)}", " pounds", None)
        add(" write to ", word(), " then", None)
        add(" in the year ", str(rng.randint(1000, 2024)), "", None)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(_docs(spark, rows)).collect()}
    found = {i: s for i, s in got.items() if s and i not in base}
    assert all(got[i] == ",".join(_spans(t)) for i, t in base.items())
    right = sum(want.get(i) == s for i, s in found.items())
    assert right / len(want) >= 0.95 and right / len(found) >= 0.95


def test_rounds_go_on_to_a_fixed_point(spark):
    """Each round's finds make the next surroundings known: a chain of as many rounds as there are words."""
    words, rows, k = ["alpha", "beta", "gamma", "delta", "omega"], [], 0
    values = [[f"{rank}00 555 {n}77{rank}" for n in range(10, 20)] for rank in range(1, 6)]
    for n in range(10):
        rows.append((100 + n, f"{words[0]} +1 200 300 40{n}0 x{n}"))
    for rank, word in enumerate(words):
        for n, v in enumerate(values[rank]):
            rows.append((1000 * (rank + 1) + n, f"{word} {v} y{n} z"))
            if rank + 1 < len(words):
                rows.append((1000 * (rank + 1) + 100 + n, f"{words[rank + 1]} {v} q{n} z"))
    got = {r.doc_id: r.spans for r in pii.find_personal_data(_docs(spark, rows)).collect()}
    assert all(got[i].startswith("phone:") for i, _ in rows)


def test_rounds_go_on_while_scores_rise(spark):
    """A round that finds nothing new, but is surer of what it found, makes the next pattern confident."""
    rows = [(n, f"alpha +1 200 300 40{n}0 x{n}") for n in range(7)]
    shapes = ["200 4001", "(200) 4002", "200-400-3", "2.00 4004", "20 04 005", "(200)-4006"]
    for n, v in enumerate(shapes):
        rows += [(100 + n, f"alpha {v} y{n} z"), (200 + n, f"beta {v} q{n} z")]
    rows += [(300, "beta 555 0001 v w"), (301, "beta 55-50-002 u t")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(_docs(spark, rows)).collect()}
    assert all(got[i].startswith("phone:") for i, _ in rows)


def test_neighbours_of_any_length(spark):
    long = "w" * 5000
    rows = [(i, f"{long} +1 (200) 555-10{i:02}") for i in range(10)] + [(50, f"{long} (200) 555-2222"), (51, f"{'w' * 4999} (200) 555-3333")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(_docs(spark, rows)).collect()}
    assert got[50] == "phone:5001:5015" and got[51] == ""


def test_redact_keeps_columns_of_any_name(spark):
    names = ("digest", "found", "row", "spans", "p_id", "p_digest", "cuts", "clean", "end", "start", "value", "kind")
    row = (1, "mail a@b.cc or c@d.ee now", *names)
    docs = spark.createDataFrame([row, row, (None, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = pii.redact(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "mail [EMAIL] or [EMAIL] now", *names)] * 2 + [(None, None, *names)], key=str)


def test_redact_against_brute_force(spark):
    rng, rows = random.Random(8), []
    for i in range(30):
        parts = [rng.choice(["é日 ", "a@b.cc", " +1 200 300 4000 ", "1.2.3.4", "x" * rng.randint(1, 3000), "😀 ", "\n"]) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(parts)))
    docs = _docs(spark, rows)
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, text in rows:
        of = sorted((int(a), -int(b), pii.KINDS.index(k)) for k, a, b in (s.split(":") for s in spans[i].split(",") if s))
        out, at = [], 0
        for a, b, k in of:
            if a >= at:
                out += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, -b)
        assert got[i] == "".join([*out, text[at:]])


def test_redact_takes_linear_time(spark):
    def seconds(n):
        docs = _docs(spark, [(1, "lorem ipsum dolor sit amet a@b.cc " * n)])
        began = time.monotonic()
        assert pii.redact(docs).first().text == "lorem ipsum dolor sit amet [EMAIL] " * n
        return time.monotonic() - began

    seconds(10)
    assert seconds(20_000) < 8 * max(seconds(5_000), 3)
