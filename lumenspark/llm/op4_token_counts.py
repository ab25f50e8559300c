"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with one root for pieces that begin a word and one for pieces that continue it. Every node has
a failure link and the number of pieces popped on the way along it, computed once; matching a word then reads each
character once, adds up popped counts and never builds a piece. With the whole vocabulary, a word whose beginning no piece
matches starts with the bare BEGIN piece, and a character outside the vocabulary counts its byte pieces. Without those
pieces, a word that can't be matched counts as one unknown token.
Words are runs of characters other than white space; the counts of recent ones are kept.

Cases: a null or empty text, or one of white space only, has no words and no tokens; repeated documents get equal counts;
an empty table gives no rows; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenspark.llm.batches import Recent, distinct_pieces, map_arrays

BEGIN = "▁"
SLICE = 4_000_000


class LongestMatch:
    """Counts greedy longest-match pieces. `pieces` that start with BEGIN begin words, all others continue them.

    `bare`: BEGIN is a piece of its own, taken where no longer one matches. `with_bytes` (only with `bare`): the vocabulary
    has all byte pieces.
    """

    def __init__(self, pieces: Iterable[str], bare: bool = False, with_bytes: bool = False):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: root of beginnings, 1: root of continuations
        final = [False, False]
        for p in pieces:
            node, rest = (0, p[len(BEGIN) :]) if p.startswith(BEGIN) else (1, p)
            if not rest:
                continue
            for c in rest:
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    final.append(False)
            final[node] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        if bare:
            self.fail[0], self.popped[0] = 1, 1
        self.with_bytes = bare and with_bytes
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], n
                    elif self.with_bytes:
                        self.fail[v], self.popped[v] = 1, n + len(c.encode("utf-8", "replace"))
                queue.append(v)
        self.known = Recent(128_000_000)

    def word(self, word: str) -> int:
        """Number of pieces, 0 if the word can't be matched."""
        node, n, go, fail, popped = 0, 0, self.next, self.fail, self.popped
        for c in word:
            while (to := go[node].get(c)) is None:
                if fail[node] < 0:
                    if not self.with_bytes:
                        return 0
                    n += len(c.encode("utf-8", "replace"))
                    to = 1
                    break
                n += popped[node]
                node = fail[node]
            node = to
        while node != 1:
            if fail[node] < 0:
                return 0
            n += popped[node]
            node = fail[node]
        return n

    def counts(self, texts: pa.Array) -> list[np.ndarray]:
        """n_words, n_tokens and n_unknown of each text."""
        words, places, ends = distinct_pieces(pc.utf8_split_whitespace(pc.fill_null(texts, "")))
        known = np.array(self.known.find(words, lambda some: [self.word(w) if w else -1 for w in some], lambda n: 32))
        found = known[places]  # -1 stands for the empty strings at the ends of a text
        begins = np.concatenate([[0], ends[:-1]])
        unknown = np.add.reduceat(found == 0, begins, dtype=np.int64)
        return [np.add.reduceat(found >= 0, begins, dtype=np.int64), np.add.reduceat(np.maximum(found, 0), begins, dtype=np.int64) + unknown, unknown]


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without its control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def has_bytes(path: str) -> bool:
    """Whether a sentencepiece model has a piece for each byte."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(m.is_byte(i) for i in range(m.get_piece_size())) == 256


_matchers: dict[tuple[str, bool], LongestMatch] = {}


def matcher(path: str, whole: bool = False) -> LongestMatch:
    if (path, whole) not in _matchers:
        pieces = vocabulary(path)
        _matchers[path, whole] = LongestMatch(pieces, whole and BEGIN in pieces, whole and has_bytes(path))
    return _matchers[path, whole]


FIELDS = [T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")]


def count_tokens(docs: DataFrame, model: str, whole: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown, one row per document.

    `whole` takes the bare BEGIN piece and the byte pieces, too; else words that need them are unknown.
    """
    return map_arrays(docs, ["doc_id"], "text", FIELDS, lambda texts: matcher(model, whole).counts(texts), SLICE)
