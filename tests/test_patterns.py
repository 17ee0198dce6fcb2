"""Pattern joins against plain `in`."""

import random
import re

import numpy as np
import pytest

from tidewell.operators import patterns


def test_containing_is_in(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé日 \n.") for _ in range(n))
    texts = [(k, word(rng.choice([0, 1, 2, 5, 60]))) for k in range(80)] + [(900, None), (901, "ab" * 3000)]
    found = [(k, word(rng.choice([1, 2, 3, 4, 6]))) for k in range(60)] + [(70, ""), (71, None), (72, "ab"), (73, "ab"), (74, "b" * 40), (75, "a.b")]
    got = patterns.containing(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(found, "pattern_id long, pattern string"))
    want = sorted((t, p) for t, text in texts for p, x in found if text is not None and x and x in text)
    assert sorted(map(tuple, got.collect())) == want and want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    none = spark.createDataFrame([], "pattern_id long, pattern string")
    assert patterns.containing(spark.createDataFrame(texts, "text_id long, text string"), none).count() == 0


def test_affected_tests(spark):
    tests = [("t1", "matc/tests", "nothing"), ("t2", "other", "uses MATC here"), ("t3", "other", "calls Parser(x)"), ("t4", "other", "parser2 _parser parsers"), ("t5", "other", None), ("t6", None, "eval.c+ now"), ("t7", "matcx", "none")]
    units = [("u1", "matc", "parser"), ("u2", "", "eval.c"), ("u3", "no", "")]
    got = patterns.affected_tests(spark.createDataFrame(tests, "test string, dir string, text string"), spark.createDataFrame(units, "unit string, subsystem string, stem string"))
    want = {}
    for unit, subsystem, stem in units:
        for test, folder, text in tests:
            folder, low = (folder or "").lower(), (text or "").lower()
            if text is None:
                want[unit, test] = "unresolved"
            elif subsystem and (folder == subsystem or folder.startswith(subsystem + "/")):
                want[unit, test] = "colocated"
            elif subsystem and subsystem in low:
                want[unit, test] = "subsystem"
            elif stem and re.search(rf"(?<![a-z0-9_]){re.escape(stem)}(?![a-z0-9_])", low):
                want[unit, test] = "stem"
    assert {(r.unit, r.test): r.why for r in got.collect()} == want


@pytest.mark.parametrize("sent", [patterns.BROADCAST_BYTES, -1])
def test_units_of_the_same_names_are_judged_once(spark, monkeypatch, sent):
    monkeypatch.setattr(patterns, "BROADCAST_BYTES", sent)
    texts = [None, "calls parser", "parsers", "in MATC"]
    tests = [(k, f"d{k % 3}/x", texts[k % 4]) for k in range(20)] + [(0, "d0", "parser"), (1, "d0", None)]
    units = [(k, ["matc", "d1", None][k % 3], ["Parser", "s"][k % 2]) for k in range(30)] + [(0, "", "calls")]
    got = patterns.affected_tests(spark.createDataFrame(tests, "test long, dir string, text string"), spark.createDataFrame(units, "unit long, subsystem string, stem string"))
    rank, want = ("unresolved", "colocated", "subsystem", "stem"), {}
    for unit, subsystem, stem in units:
        subsystem, stem = (subsystem or "").lower(), stem.lower()
        for test, folder, text in tests:
            low = (text or "").lower()
            named = subsystem and (folder == subsystem or folder.startswith(subsystem + "/")), subsystem and subsystem in low, re.search(rf"(?<![a-z0-9_]){stem}(?![a-z0-9_])", low)
            if found := [k for k, yes in enumerate((text is None, *named)) if yes]:
                want[unit, test] = min(found[0], want.get((unit, test), 9))
    assert sorted(map(tuple, got.collect())) == sorted((u, t, rank[k]) for (u, t), k in want.items())
    assert "Aggregate" not in got._jdf.queryExecution().toString()  # nothing is grouped by unit and test


def test_found_texts_go_to_the_patterns_when_only_these_are_many(spark, monkeypatch):
    texts = spark.createDataFrame([(k, "abc" if k % 2 else "xyz") for k in range(10)], "text_id long, text string")
    many = spark.range(400).selectExpr("id AS pattern_id", "'abc' AS pattern")
    monkeypatch.setattr(patterns, "BROADCAST_BYTES", 1000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = patterns.containing(texts, many)
        assert got.count() == 2000
        assert "SortMergeJoin" not in got._jdf.queryExecution().toString()  # a hot pattern would be one task's
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_grams_are_runs_of_bytes(monkeypatch):
    data = np.frombuffer("añb日本añb日本語😀".encode(), np.uint8)
    for piece in (patterns.PIECE, 3):
        monkeypatch.setattr(patterns, "PIECE", piece)
        for size in (1, 2, 3, 4, 40):
            want = {int.from_bytes(bytes([size]) + data[k : k + size].tobytes()) for k in range(len(data) - size + 1)}
            assert patterns._distinct_codes(data, size, None).tolist() == sorted(want)
            slots = np.zeros(patterns.SLOTS, bool)
            slots[[c % patterns.SLOTS for c in sorted(want)[::2]]] = True
            assert patterns._distinct_codes(data, size, slots).tolist() == sorted(c for c in want if slots[c % patterns.SLOTS])


def test_texts_are_read_without_expressions_and_rows_are_dealt(spark):
    words = ["ñ", "日本", "a", "bc", "日b", "x😀", "cañ", "", " ", "語" * 9]
    rng = random.Random(2)
    texts = [(k, None if k == 5 else "".join(rng.choice(words) for _ in range(k % 12))) for k in range(60)]
    names = [(k, w) for k, w in enumerate([*words, None, "本ñ", "bcañ日本", "ab", "ñ"])]
    got = patterns.containing(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "pattern_id long, pattern string"))
    assert sorted(map(tuple, got.collect())) == sorted((t, p) for t, text in texts for p, w in names if text is not None and w and w in text)
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()  # not the tasks that a small file has
    plan = patterns._found(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "id long, pattern string"))
    assert "regexp" not in plan._jdf.queryExecution().optimizedPlan().toString()


def _joined(monkeypatch, key):
    """Rows of both sides and of the result of each join by the key, as they come."""
    seen, plain = [], patterns._matched

    def spied(found, many, by, *more):
        got = plain(found, many, by, *more)
        if by == key:
            seen.append((found.count(), many.count(), got.count()))
        return got

    monkeypatch.setattr(patterns, "_matched", spied)
    return seen


def test_units_and_tests_are_joined_as_blocks(spark, monkeypatch):
    seen = _joined(monkeypatch, "kind")
    tests = spark.range(1300).selectExpr("id * 7 AS test", "'d' AS dir", "CASE WHEN id % 10 > 0 THEN 'calls parser' END AS text")
    got = patterns.affected_tests(tests, spark.range(1100).selectExpr("id AS unit", "'' AS subsystem", "'parser' AS stem"))
    assert got.distinct().count() == got.count() == 1300 * 1100
    assert {(r.why, r.test % 70 == 0) for r in got.select("why", "test").distinct().collect()} == {("stem", False), ("unresolved", True)}
    assert seen and max(map(max, seen)) < 60  # a row a unit and test would be 1,430,000
    last = got._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert last.count("Generate explode") == 2 and "Join" not in last  # rows come after the last shuffle


def test_found_texts_are_sent_as_blocks(spark, monkeypatch):
    seen = _joined(monkeypatch, "pattern")
    texts = spark.range(3000).selectExpr("id AS text_id", "CASE id % 3 WHEN 0 THEN 'abc' WHEN 1 THEN 'xyz abc' ELSE 'xyz' END AS text")
    got = patterns.containing(texts, spark.range(2000).selectExpr("id AS pattern_id", "CASE id % 2 WHEN 0 THEN 'abc' ELSE 'xyz' END AS pattern"))
    assert got.distinct().count() == got.count() == 2000 * 2000
    assert seen and max(map(max, seen)) < 100  # 4,000 found texts, 2,000 patterns
    assert patterns._size(texts, "text_id") >= 3000 * 100  # a row sent takes far more than its values


def test_blocks_hold_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 8)
    rows = [("ab"[k % 2] if k < 50 else "c", k % 40, f"t{k % 45}") for k in range(95)]
    blocks, size = patterns._blocks(spark.createDataFrame(rows, "k string, n int, id string").coalesce(1), ["k"], "id")
    got = blocks.collect()
    assert sorted((r.k, x) for r in got for x in r.id) == sorted((k, x) for k, _, x in rows)
    assert max(len(r.id) for r in got) <= 8 and len(got) < 30 and size >= 95 * 3 + len(got) * 100
