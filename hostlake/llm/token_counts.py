"""Operator 8: token counts by dynamic programming shared in a trie.

A pre-token is a word with its preceding blank. Its tokens are those of the likeliest segmentation into
pieces of an existing vocabulary, each piece with a unigram score; characters that no piece covers are
spelt in bytes. The best score of a prefix does not depend on what follows, so distinct pre-tokens are put
in a trie and the forward step is made once per trie node, that is once per shared prefix; the node keeps
the score and the count of the best segmentation, and a pre-token's count is that of its last node. A
document's count is the sum over its pre-tokens.

The vocabulary is read from a file; nothing about it is trained. A file that only ranks its pieces gives
piece of rank r the score -log((r + 1) H), a Zipf law, H being the harmonic number that makes it sum to 1.

There is no shuffle: each worker keeps a trie of what it has seen, emptied at a bound, which changes no
result. Rows: NULL and empty texts have no pre-tokens; repeated rows are counted each; other columns pass
through, those called like results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hostlake.llm.common import arrow_append, worker_state

BLANK = "▁"
MAX_NODES = 300_000
MAX_WORDS = 1 << 17


def read_pieces(path: str) -> tuple[dict[str, float], float]:
    """Scores of the pieces, and that of one byte of a character without a piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    harmonic = sum(1 / (r + 1) for r in range(len(pieces)))
    scores = {p: -math.log((r + 1) * harmonic) for r, p in enumerate(pieces)}
    # A byte piece ranks behind all others.
    return scores, -math.log((len(pieces) + 1) * harmonic)


class CountingTrie:
    """Best scores and token counts of all prefixes of the pre-tokens put in."""

    def __init__(self, pieces: dict[str, float], byte_score: float, max_nodes: int = MAX_NODES):
        self.pieces, self.byte_score, self.max_nodes = pieces, byte_score, max_nodes
        self.longest = max(map(len, pieces), default=0)
        self.empty()

    def empty(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def terminal(self, word: str) -> int:
        """The count of a pre-token; of segmentations of equal score the one of fewer tokens counts."""
        if len(self.score) >= self.max_nodes:
            self.empty()
        child, score, count, pieces = self.child, self.score, self.count, self.pieces
        path = [0]
        node = 0
        for depth, letter in enumerate(word, 1):
            below = child.get((node, letter))
            if below is None:
                spelt = len(letter.encode())
                best, tokens = score[node] + spelt * self.byte_score, count[node] + spelt
                for start in range(max(0, depth - self.longest), depth):
                    own = pieces.get(word[start:depth])
                    if own is not None:
                        at = path[start]
                        total = score[at] + own
                        if total > best or (total == best and count[at] + 1 < tokens):
                            best, tokens = total, count[at] + 1
                below = child[node, letter] = len(score)
                score.append(best)
                count.append(tokens)
            node = below
            path.append(node)
        return count[node]


class Counter(dict):
    def __init__(self, trie: CountingTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self[word] = self.trie.terminal(BLANK + word)
        return n

    def document(self, text: str) -> tuple[int, int]:
        words = text.split()
        return len(words), sum(map(self.__getitem__, words))


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", without: Sequence[str] = ()) -> DataFrame:
    """docs with n_pretokens and n_tokens of each whole text."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary))  # as large as the vocabulary

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        count = worker_state(("count", vocabulary), lambda: Counter(CountingTrie(*pieces.value))).document
        found = [count(t) if t else (0, 0) for t in batch.column(text).to_pylist()]
        return [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]

    return arrow_append(docs, [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())], compute, without)
