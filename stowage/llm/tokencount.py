"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links: when no child fits the next character, the automaton pops the
pieces that greedy longest-match would cut from what it has read and goes to the state of the rest.
Only their number is kept with each state, so a word is counted in one pass and no piece is ever built.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame

from stowage.llm.common import BoundedCache, per_text

START = "▁"


class LongestMatch:
    """Counts greedy longest-match pieces of words. A character outside all pieces, or one that no piece
    alone covers, counts as its UTF-8 bytes (byte fallback), so that every word has a count."""

    def __init__(self, pieces: Iterable[str], start: str = START):
        self.start = start
        vocabulary = {p for p in pieces if p}
        characters = {c for p in vocabulary for c in p}
        cost = {c: 1 if c in vocabulary else self._bytes(c) for c in characters} | dict.fromkeys(vocabulary, 1)
        self.children: list[dict[str, int]] = [{}]
        ends = [0]  # what the state's whole string costs as one unit, 0: it is none
        for unit, n in cost.items():
            at = 0
            for c in unit:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    ends.append(0)
                at = nxt
            ends[at] = n
        self.fail = [0] * len(self.children)
        self.popped = [0] * len(self.children)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, child in self.children[parent].items():
                queue.append(child)
                if ends[child]:
                    self.popped[child] = ends[child]
                    continue
                # The parent's string is cut as it stands until c fits; single characters always fit.
                at, popped = self.fail[parent], self.popped[parent]
                while c not in self.children[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                self.fail[child], self.popped[child] = self.children[at][c], popped

    def _bytes(self, c: str) -> int:
        return 0 if c == self.start else len(c.encode("utf-8", "surrogatepass"))

    def count(self, word: str) -> int:
        children, fail, popped = self.children, self.fail, self.popped
        at = total = 0
        for c in self.start + word:
            while True:
                nxt = children[at].get(c)
                if nxt is not None:
                    at = nxt
                    break
                if not at:  # a character of no piece
                    total += self._bytes(c)
                    break
                total += popped[at]
                at = fail[at]
        while at:
            total += popped[at]
            at = fail[at]
        return total


@functools.lru_cache(2)
def sentencepiece_vocabulary(path: str) -> LongestMatch:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return LongestMatch(model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens), one row per row of ``df``: the words of the whole text (between
    white space) and the greedy longest-match pieces of each word after a word-start mark, by the
    vocabulary of the sentencepiece model at ``path`` on every node. A null or empty text has 0 of both.
    A null id stays null; repeated rows give repeated rows; an empty table gives none. Other columns are
    ignored.
    """

    def make():
        counted = BoundedCache(sentencepiece_vocabulary(path).count, 500_000)

        def work(texts: list[str]) -> list[list]:
            words = [t.split() for t in texts]
            return [[len(w) for w in words], [sum(map(counted.__getitem__, w)) for w in words]]

        return work

    return per_text(df, id_col, text_col, "n_words long, n_tokens long", make)
