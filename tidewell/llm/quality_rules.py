"""Quality rules by weak supervision.

Each rule looks at one document and votes good (+1), bad (-1) or abstains (0).
Expectation-maximisation over the counts of vote patterns (at most 3^rules rows,
however large the corpus) estimates for each rule how often it votes what on
good and on bad documents; the posterior probability that a document is good
takes the place of "all rules must pass".

Nulls: a null text counts as empty (no words, base_failed). A null doc_id is
carried along. An empty table gives an empty result. Only doc_id and text are
read, so further columns do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WORD_RE, WordHashes, materialize, window_hashes

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: base_failed when 100 * n_repeat_words > REPEAT_PERCENT * n_words.
REPEAT_PERCENT = 30

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_letters long, n_same_next long, n_marks long, n_plain long, n_ended long"
)

#: What may stand around the letters of a plain word, and what ends a line of prose.
_AROUND = ".,;:!?\"'()-"
_ENDED = re.compile(r"[.!?:;,\"')][ \t\r]*$", re.MULTILINE)

#: (rule, measure, good at most, bad above): between the two it abstains.
RULES = (
    ("symbols", lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)), 0.02, 0.10),
    ("capitals", lambda: F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)), 0.20, 0.45),
    ("repeats", lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)), 0.05, 0.30),
    ("lines", lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.10, 0.30),
    ("stutter", lambda: F.col("n_same_next") / F.greatest(F.col("n_words"), F.lit(1)), 0.02, 0.10),
    ("marks", lambda: F.col("n_marks") / F.greatest(F.col("n_words"), F.lit(1)), 0.05, 0.30),
    ("word_length", lambda: F.abs(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) - 6), 4.0, 14.0),
    ("plain_words", lambda: 1 - F.col("n_plain") / F.greatest(F.col("n_words"), F.lit(1)), 0.15, 0.35),
    ("line_ends", lambda: 1 - F.col("n_ended") / F.greatest(F.col("n_lines"), F.lit(1)), 0.50, 0.90),
    ("length", lambda: 20 / F.greatest(F.col("n_words"), F.lit(1)), 0.5, 1.0),
)


def _stats(text: str, hashes: WordHashes) -> tuple[int, ...]:
    words = WORD_RE.findall(text)
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if WORD_RE.search(line):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    same = repeat = 0
    if n:
        h = hashes(words)
        same = int(np.count_nonzero(h[1:] == h[:-1]))
        if n > WINDOW:
            w = window_hashes(h, WINDOW)
            ordered = np.sort(w)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                at = np.flatnonzero(np.isin(w, twice))
                edge = np.zeros(n + 1, np.int64)
                edge[at] += 1
                edge[at + WINDOW] -= 1
                repeat = int(np.count_nonzero(np.cumsum(edge[:-1])))
    chars = sum(map(len, words))
    upper = sum(map(str.isupper, text))
    plain = sum(w.strip(_AROUND).isalpha() and w[-2:] not in ("!!", "??") for w in words)
    marks = text.count("!") + text.count("?")
    return n, chars, symbols, dup, repeat, lines, upper, max(chars - symbols, 0), same, marks, plain, len(_ENDED.findall(text))


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    names = [x.split()[0] for x in STATS.split(", ")]
    for batch in batches:
        rows = [_stats(t.as_py() or "", hashes) for t in batch.column(1)]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["row", *names]
        )


def text_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """row (a struct of the columns to keep) and the counts that the rules look at."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_map, f"row {rows.schema['row'].dataType.simpleString()}, {STATS}")


def votes(stats: DataFrame) -> DataFrame:
    """Adds v_<rule>: 1 good, -1 bad, 0 abstains."""
    return stats.withColumns(
        {
            f"v_{name}": F.when(measure() > bad, -1).when(measure() <= good, 1).otherwise(0)
            for name, measure, good, bad in RULES
        }
    )


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, smooth: float = 0.5):
    """EM over vote patterns. Returns (prior of good, log P(vote | good), log P(vote | bad)).

    patterns: rows of votes in {-1, 0, 1}; counts: documents of each pattern. It
    starts from "any bad vote means bad". A rule's bad vote is held to be at least
    as likely on bad documents as on good ones, which keeps the two classes from
    changing places.
    """
    counts = counts.astype(float)
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], -1).astype(float)  # pattern, rule, vote
    good = np.where((patterns == -1).any(1), 0.01, 0.99)
    prior = 0.5
    for _ in range(rounds):
        tables = []
        for weight in (good * counts, (1 - good) * counts):
            seen = np.tensordot(weight, one_hot, (0, 0)) + smooth
            tables.append(seen / seen.sum(1, keepdims=True))
        on_good, on_bad = tables
        on_bad[:, 0] = np.maximum(on_bad[:, 0], on_good[:, 0])
        on_bad /= on_bad.sum(1, keepdims=True)
        prior = float(np.clip((good * counts).sum() / max(counts.sum(), 1), 0.05, 0.95))
        on_good, on_bad = np.log(on_good), np.log(on_bad)
        new = posterior(patterns, prior, on_good, on_bad)
        done = np.abs(new - good).max(initial=0) < 1e-7
        good = new
        if done:
            break
    return prior, on_good, on_bad


def posterior(patterns: np.ndarray, prior: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    """Probability of good for each pattern of votes."""
    rule = np.arange(patterns.shape[1])
    gap = (on_bad[rule, patterns + 1] - on_good[rule, patterns + 1]).sum(1) + np.log((1 - prior) / prior)
    return 1 / (1 + np.exp(np.clip(gap, -500, 500)))


def rate(docs: DataFrame, keep: list[str], keep_at: float = 0.5, text_col: str = "text") -> DataFrame:
    """row (a struct of the columns to keep), the counts, every rule's vote, p_good, base_failed and kept.

    One pass over the texts: the counts and votes are written with the columns to
    keep; the counts of vote patterns alone go to the driver. Nothing else is shuffled.
    """
    spark = docs.sparkSession
    cols = [f"v_{r[0]}" for r in RULES]
    voted = materialize(votes(text_stats(docs, keep, text_col)), "votes")
    seen = voted.groupBy(*cols).count().collect()
    patterns = np.array([[r[c] for c in cols] for r in seen], int).reshape(-1, len(cols))
    p = np.empty(0)
    if len(seen):
        p = posterior(patterns, *fit(patterns, np.array([r["count"] for r in seen])))
    code = lambda row: int(sum((v + 1) * 3**i for i, v in enumerate(row)))
    known = spark.createDataFrame([(code(x), float(y)) for x, y in zip(patterns, p)], "pattern int, p_good double")
    of = sum(((F.col(c) + 1) * 3**i for i, c in enumerate(cols)), F.lit(0)).cast("int")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (
        voted.withColumn("pattern", of)
        .join(F.broadcast(known), "pattern", "left")  # at most 3^rules rows
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= keep_at))
        .drop("pattern")
    )


def score_documents(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """doc_id, the counts, votes, p_good, base_failed and kept of every document."""
    return rate(docs, ["doc_id"], keep_at).withColumn("doc_id", F.col("row.doc_id")).drop("row")


def keep_good(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """docs, as they are, that the rules keep."""
    return rate(docs, docs.columns, keep_at).filter("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
