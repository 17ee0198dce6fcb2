"""The pipeline's stages, one after the other, each against a brute-force version of its own."""

import math
import re
from collections import Counter

import duckdb

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import WORD, _classes, _docs, _plain_stats, _spans
from tidewell.llm import mixture, near_dedup


def _measures(text):
    """What the rules look at, in their order, straight from the text."""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup, repeat, failed = _plain_stats(text)
    of = max(n, 1)
    plain = sum(w.strip(".,;:!?\"'()-").isalpha() and w[-2:] not in ("!!", "??") for w in words)
    ended = sum(bool(re.search(r"[.!?:;,\"')][ \t\r]*$", x)) for x in text.split("\n"))
    values = (
        symbols / of, sum(map(str.isupper, text)) / max(chars - symbols, 1), repeat / of, dup / max(len(lines), 1),
        sum(a == b for a, b in zip(words, words[1:])) / of, (text.count("!") + text.count("?")) / of, abs(chars / of - 6),
        1 - plain / of, 1 - ended / max(len(lines), 1), 20 / of,
    )
    return values, failed


#: At most good, above bad, of each measure.
LIMITS = ((0.02, 0.10), (0.20, 0.45), (0.05, 0.30), (0.10, 0.30), (0.02, 0.10), (0.05, 0.30), (4.0, 14.0), (0.15, 0.35), (0.50, 0.90), (0.5, 1.0))


def _good(texts):
    """Expectation-maximisation document by document. Returns which are kept."""
    found = [_measures(t) for t in texts]
    votes = [[1 if v <= g else -1 if v > b else 0 for v, (g, b) in zip(values, LIMITS)] for values, _ in found]
    good = [0.01 if -1 in v else 0.99 for v in votes]
    for _ in range(50):
        tables = []
        for weights in (good, [1 - p for p in good]):
            table = []
            for rule in range(len(LIMITS)):
                seen = {x: 0.5 + sum(w for w, v in zip(weights, votes) if v[rule] == x) for x in (-1, 0, 1)}
                table.append({x: c / sum(seen.values()) for x, c in seen.items()})
            tables.append(table)
        for on_good, on_bad in zip(*tables):
            on_bad[-1] = max(on_bad[-1], on_good[-1])
            total = sum(on_bad.values())
            on_bad.update({x: c / total for x, c in on_bad.items()})
        prior = min(max(sum(good) / len(good), 0.05), 0.95)
        gaps = [math.log((1 - prior) / prior) + sum(math.log(b[x] / a[x]) for a, b, x in zip(*tables, v)) for v in votes]
        new = [1 / (1 + math.exp(min(max(g, -500), 500))) for g in gaps]
        done = max(abs(a - b) for a, b in zip(good, new)) < 1e-7
        good = new
        if done:
            break
    return [not failed and p >= 0.5 for (_, failed), p in zip(found, good)]


def _items(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _contaminated(texts, items):
    windows = set()
    for words in map(_items, items):
        n = min(len(words), 13)
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1) if n}
    out = []
    for words in map(_items, texts):
        hit = set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        out.append(bool(hit) and 20 * len(hit) >= len(words))
    return out


def _redacted(text):
    spans = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in _spans(text)))
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "personal_data", "source_mixture"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        weights = near_dedup.shingle_weights(docs) if name == "near_dedup" else None
        classes = _classes(docs, weights) if weights else {}
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        got = docs.collect()
        texts = [r.text for r in before]
        if name == "quality_rules":
            want = [r for r, keep in zip(before, _good(texts)) if keep]
        elif name == "near_dedup":
            want = [r for r in before if classes[r.doc_id] == r.doc_id]
        elif name == "decontamination":
            want = [r for r, bad in zip(before, _contaminated(texts, items)) if not bad]
        elif name == "personal_data":
            want = [r.asDict() | {"text": (t := _redacted(r.text)), "n_chars": len(t)} for r in before]
            want = [tuple(r.values()) for r in want]
        else:
            con = duckdb.connect()
            con.register("documents", spark.createDataFrame(before).toArrow())
            mixed = con.sql(f"SELECT d.doc_id, d.text, d.lang, d.source, n_chars, size, source_size, target, copies, taken FROM ({mixture.SQL}) m JOIN documents d USING (doc_id) WHERE copies > 0")
            want = mixed.fetchall()
        assert 0 < len(want) <= len(before)
        assert Counter(map(tuple, got)) == Counter(map(tuple, want)), name
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS)


def test_odd_rows(spark, tmp_path):
    """Nulls, blanks, repeated rows, ties, a very long text and further columns go through without a crash."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000)) + "."
    good = "The quick brown fox jumps over the lazy dog near the river, and then it rests under a tall old tree for a while. "
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (5, long), (5, long), (None, good + "Again it runs."), (None, None), (6, good), (7, good), (8, good + "Mail a@b.cc.")]
    _docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {4, None, 6, 8} and all(r.copies >= 1 for r in got)
    assert not any("a@b.cc" in r.text for r in got)


def test_empty(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
