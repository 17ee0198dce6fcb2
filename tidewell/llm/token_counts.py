"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the vocabulary's word mark before it. Its tokens are
the unigram segmentation of highest score (fewest tokens among equals) into the
pieces of a public vocabulary. Pre-tokens are inserted in a trie; the forward
score of a prefix depends on that prefix alone, so it is computed once, when its
node is made, and shared by all pre-tokens that begin with it. The count at a
pre-token's last node is stored as a terminal.

A piece's score is -log(rank + RANK_SHIFT), Zipf's law over the order of the
vocabulary; characters that no piece covers cost BYTE_PENALTY and as many tokens
as they have UTF-8 bytes. Nothing is trained.

Nulls: a null text has 0 words and 0 tokens; so has an empty one. A null doc_id
is carried along. Rows are independent: repeated rows are repeated in the
result, an empty table gives an empty one, further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WORD_RE

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MARK = "▁"
RANK_SHIFT = 10.0
BYTE_PENALTY = 25.0


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> score, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): -math.log(i + RANK_SHIFT)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class PretokenTrie:
    """Trie whose nodes hold the best forward score of their prefix and its token count.

    It starts anew beyond max_nodes, which costs sharing, not correctness. Pre-tokens
    of over max_length characters are scored along the same recurrence, but not kept.
    """

    def __init__(self, scores: dict[str, float], max_nodes: int = 300_000, max_length: int = 1000):
        self.scores, self.max_nodes, self.max_length = scores, max_nodes, max_length
        self.longest = max(map(len, scores), default=1)
        self._clear()

    def _clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, pretoken: str) -> int:
        found = self.terminal.get(pretoken)
        if found is None:
            if len(pretoken) > self.max_length:
                return self._pass(pretoken)
            if len(self.score) > self.max_nodes:
                self._clear()
            found = self.terminal[pretoken] = self._insert(pretoken)
        return found

    def _pass(self, text: str) -> int:
        """Tokens of a long text; of the scores only as many as a piece is long are held."""
        scores, size = self.scores, self.longest + 1
        held = [(0.0, 0)] * size
        for end, char in enumerate(text, 1):
            ways = []
            for start in range(max(0, end - self.longest), end):
                piece = scores.get(text[start:end])
                if piece is not None:
                    s, n = held[start % size]
                    ways.append((s + piece, -(n + 1)))
            if char not in scores:
                s, n = held[(end - 1) % size]
                cost = len(char.encode("utf-8", "surrogatepass"))
                ways.append((s - BYTE_PENALTY * cost, -(n + cost)))
            s, n = max(ways)
            held[end % size] = s, -n
        return held[len(text) % size][1]

    def _insert(self, text: str) -> int:
        scores, path, node = self.scores, [0], 0
        for end, char in enumerate(text, 1):
            child = self.children[node].get(char)
            if child is None:
                best, fewest = -math.inf, 0
                for start in range(max(0, end - self.longest), end):
                    piece = scores.get(text[start:end])
                    if piece is not None:
                        at = path[start]
                        s, n = self.score[at] + piece, self.tokens[at] + 1
                        if s > best or s == best and n < fewest:
                            best, fewest = s, n
                if char not in scores:
                    size = len(char.encode("utf-8", "surrogatepass"))
                    s, n = self.score[node] - BYTE_PENALTY * size, self.tokens[node] + size
                    if s > best or s == best and n < fewest:
                        best, fewest = s, n
                child = self.children[node][char] = len(self.score)
                self.children.append({})
                self.score.append(best)
                self.tokens.append(fewest)
            node = child
            path.append(node)
        return self.tokens[node]


class _Counter:
    """Counts words and tokens of Arrow batches."""

    KEPT = 400_000  # words whose counts are held

    def __init__(self, scores: dict[str, float]):
        self.scores = scores

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = PretokenTrie(self.scores), {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = WORD_RE.findall(text.as_py() or "")
                if len(known) > self.KEPT:
                    known.clear()
                new = set(words).difference(known)
                for w in new:
                    known[w] = trie.count(WORD_MARK + w)
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
                for w in new:
                    if len(w) > trie.max_length:
                        del known[w]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text. No shuffle: each document is counted where it is read.

    The vocabulary is read on the driver and sent with the tasks; its size is that of the file.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _Counter(load_vocabulary(vocabulary)), f"doc_id {kind}, n_words long, n_tokens long"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
