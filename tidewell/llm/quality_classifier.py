"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: words, character
n-grams of the words with end marks, and word pairs that repeat one word, each
hashed into a fixed number of rows. A softmax over the two labels ends the
model. It is trained by plain numpy stochastic gradient descent on a bounded
sample of labelled documents (max_docs, drawn by a hash of the id, so that a
rerun learns the same).

As the model is linear after the embeddings, a trained row is worth one number:
its vector times the difference of the two output vectors. Scoring needs only
those, in one pass without a shuffle.

Nulls: a null text is scored like an empty one, by the bias alone. Rows of the
labels with a null id or label are not learned from; of labels that repeat an id and
differ the larger counts. Rows that repeat an id are learned from and scored each.
Texts are scored whole, however long. An empty table gives an empty result; without
labels every score is 0.5. Ids may be of any type that both tables have. Further
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WORD_RE, held_out

BUCKETS = 1 << 17
GRAMS = (3, 4)
#: Features of longer words (texts without spaces are such) are not kept for the next time.
KEPT_WORD = 48


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    marked = f"<{word}>"
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in GRAMS:
        out += [
            zlib.crc32(b"g" + marked[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS
            for i in range(len(marked) - n + 1)
        ]
    return out


#: A word that follows itself.
SAME = zlib.crc32(b"pair same") % BUCKETS


@dataclass
class Model:
    worth: np.ndarray  # float32 by bucket
    bias: float


class _Texts:
    """Features of texts as (buckets, counts)."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.known = limit, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = WORD_RE.findall(text)
        if len(self.known) > self.limit:
            self.known.clear()
        parts = []
        for w in words:
            f = self.known.get(w)
            if f is None:
                f = np.array(word_features(w), np.int32)
                if len(w) <= KEPT_WORD:
                    self.known[w] = f
            parts.append(f)
        same = sum(a == b for a, b in zip(words, words[1:]))
        if same:
            parts.append(np.full(same, SAME, np.int32))
        if not parts:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        rows, n = np.unique(np.concatenate(parts), return_counts=True)
        return rows, n.astype(np.float32)


def learn(
    texts: list[str], labels: list[int], dim: int = 8, epochs: int = 5, steps: int = 8000, rate: float = 0.5, seed: int = 7
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors by bucket, output vectors and bias by label: stochastic gradient descent, one document at a time, rate
    falling to 0, for at least so many epochs and steps."""
    y = np.asarray(labels, int)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    features = _Texts()
    docs = [features(t) for t in texts]
    epochs = max(epochs, -(-steps // len(docs)))
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            now = rate * (1 - step / steps)
            step += 1
            rows, n = docs[i]
            share = n / max(n.sum(), 1)
            hidden = share @ vectors[rows] if len(rows) else np.zeros(dim, np.float32)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= now * np.outer(hidden, p)
            bias -= 0.1 * now * p
            if len(rows):
                # the mean's gradient by row, scaled up: a row is a small part of a long document
                vectors[rows] -= (now * np.sqrt(share))[:, None] * back
    return vectors, out, bias


def train(texts: list[str], labels: list[int], **how) -> Model:
    """What learn() gives, folded to a number a bucket; labels of one kind alone give a bias."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 4.0 * (2 * labels[0] - 1) if labels else 0.0)
    vectors, out, bias = learn(texts, labels, **how)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class _Scorer:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth, bias, known = self.model.worth, self.model.bias, {}
        same_worth = float(worth[SAME])
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = WORD_RE.findall(text.as_py() or "")
                if len(known) > 400_000:
                    known.clear()
                for w in set(words).difference(known):
                    f = word_features(w)
                    known[w] = complex(float(worth[f].sum()), len(f))
                total = sum(map(known.__getitem__, words))
                same = sum(map(str.__eq__, words, words[1:]))
                n = total.imag + same
                z = bias + ((total.real + same * same_worth) / n if n else 0.0)
                out.append(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:1], *batch.columns[2:], pa.array(out, pa.float64())], ["doc_id", "held_out", "score"]
            )


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_chars: int = 50_000_000) -> Model:
    """Learns from at most max_docs labelled documents that are not held out.

    The labels are sampled first, and only the sampled ids meet the texts, so
    the texts are not shuffled. max_chars bounds what is learned from: a document that would
    exceed it is passed over, and those after it that fit are taken.
    """
    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    ids = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(order, "doc_id")
        .limit(max_docs)
        .collect()
    )
    kind = labels.schema["doc_id"].dataType.simpleString()
    known = spark.createDataFrame([(r.doc_id, r.quality) for r in ids], f"doc_id {kind}, quality int")
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("h", F.xxhash64("doc_id"))
    texts, labels_, size = [], [], 0
    for row in sample.orderBy("h", "doc_id", F.md5("text")).toLocalIterator():
        if size + len(row.text or "") > max_chars:
            continue
        size += len(row.text or "")
        texts.append(row.text or "")
        labels_.append(row.quality)
    return train(texts, labels_)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (score of at least 0.3)."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return (
        docs.select("doc_id", "text", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"))
        .mapInArrow(_Scorer(model), f"doc_id {kind}, held_out boolean, score double")
        .withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
