"""Byte-level BPE by rank files: a segment tree over byte positions finds each merge.

Leaf i holds the rank of the pair that starts at live byte position i, and an inner node the smallest
(rank, position) below it, so that the root names the leftmost pair of the lowest rank. A merge changes
the leaves of the pair, of its right end and of its live left neighbour: three point updates of
logarithmic cost. Short pieces are merged many at a time, one tree a row of a numpy matrix.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from stowage.llm.common import per_text

NONE = np.int64(2**62)
BATCH_BYTES = 64  # pieces up to this length are merged in batches
CACHED_PIECES = 500_000
_SIZES = (2, 4, 8, 16, 32, 64)
_SIZE_OF = [next(size for size in _SIZES if size >= n) for n in range(BATCH_BYTES + 1)]

# Texts of these characters only: here Python's re splits as the pattern's Unicode classes do.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ‐-‧‰-⁞]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"


class ByteBPE:
    """``ranks``: token bytes to id; lower ids merge first. ``pattern`` splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.slow = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        quick = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTER}0-9]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", "[0-9]")
        self.quick = None if r"\p" in quick else re.compile(quick)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.int64(2**62))
        self.pair_ranks = np.append(np.array([pairs[k] for k in keys.tolist()], np.int64), NONE)
        self.rank_bytes = [np.int32(i).tobytes() for i in range(len(self.tokens))]
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        return _load(path, pattern)

    def split(self, text: str) -> list[str]:
        if self.quick is not None and _PLAIN.fullmatch(text):
            return self.quick.findall(text)
        return self.slow.findall(text)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece, by one segment tree over its byte positions."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none = (int(NONE), 0)
        ids = [int(self.of_byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        tree = [none] * (2 * size)

        def pair(i: int) -> tuple[int, int]:
            return (pairs.get(ids[i] << 20 | ids[after[i]], none[0]), i) if after[i] < n else none

        for i in range(n):
            tree[size + i] = pair(i)
        for v in range(size - 1, 0, -1):
            tree[v] = min(tree[2 * v], tree[2 * v + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            v = size + i
            tree[v] = value
            while v > 1:
                v >>= 1
                least = min(tree[2 * v], tree[2 * v + 1])
                if tree[v] == least:
                    break
                tree[v] = least

        while tree[1][0] != none[0]:
            rank, i = tree[1]
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            if after[gone] < n:
                before[after[gone]] = i
            put(gone, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_batch(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of 2 to ``size`` bytes (a power of two), one after another, and where each
        piece's end: a segment tree a row."""
        m = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        spots = np.arange(size)
        ids = self.of_byte[raw]
        after = np.minimum(np.broadcast_to(spots + 1, (m, size)), size).copy()
        before = np.broadcast_to(spots - 1, (m, size)).copy()
        tree = np.full((m, 2 * size), NONE)  # rank << 8 | position
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        rank[spots[None, 1:] >= lengths[:, None]] = NONE
        tree[:, size : 2 * size - 1] = np.where(rank == NONE, NONE, (rank << 8) | spots[:-1])
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        dead = np.zeros((m, size), bool)

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            v = at + size
            tree[rows, v] = value
            while len(v) and v[0] > 1:
                v = v >> 1
                tree[rows, v] = np.minimum(tree[rows, 2 * v], tree[rows, 2 * v + 1])

        def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            nxt = after[rows, at]
            ok = nxt < lengths[rows]
            found = np.full(len(rows), NONE)
            r = self._rank(ids[rows[ok], at[ok]], ids[rows[ok], nxt[ok]])
            found[ok] = np.where(r == NONE, NONE, (r << 8) | at[ok])
            return found

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            top = tree[rows, 1]
            at = top & 255
            gone = after[rows, at]
            ids[rows, at] = top >> 8
            nxt = after[rows, gone]
            after[rows, at] = nxt
            inside = nxt < lengths[rows]
            before[rows[inside], nxt[inside]] = at[inside]
            dead[rows, gone] = True
            put(rows, gone, np.full(len(rows), NONE))
            put(rows, at, pair(rows, at))
            left = before[rows, at]
            has = left >= 0
            put(rows[has], left[has], pair(rows[has], left[has]))
            rows = rows[tree[rows, 1] < NONE]
        live = ~dead & (spots[None, :] < lengths[:, None])
        return ids[live], np.cumsum(live.sum(axis=1))

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into the cache, as bytes of int32."""
        if len(self.known) + len(pieces) > CACHED_PIECES:
            self.known.clear()
        rest: dict[int, tuple[list[str], list[bytes]]] = {size: ([], []) for size in _SIZES}
        known, ranks, ids_of = self.known, self.ranks, self.rank_bytes
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            rank = ranks.get(data)
            if rank is not None:
                known[piece] = ids_of[rank]
            elif len(data) > BATCH_BYTES:
                known[piece] = np.array(self.merge_long(data), np.int32).tobytes()
            else:
                names, group = rest[_SIZE_OF[len(data)]]
                names.append(piece)
                group.append(data)
        for size, (names, group) in rest.items():
            for i in range(0, len(group), 8192):
                flat, ends = self.merge_batch(group[i : i + 8192], size)
                coded, at = flat.astype(np.int32).tobytes(), 0
                for piece, end in zip(names[i : i + 8192], (4 * ends).tolist(), strict=True):
                    known[piece] = coded[at:end]
                    at = end

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        out, i = [], 0
        while i < len(texts):  # runs of a few MB, whose pieces fit in the cache beside each other
            end, size = i, 0
            while end < len(texts) and (end == i or size + len(texts[end]) <= 1 << 20):
                size += len(texts[end])
                end += 1
            split = [self.split(t) for t in texts[i:end]]
            new = set().union(*split) - self.known.keys()
            if new:
                known = len(self.known)
                self.learn(new)
                if len(self.known) < known + len(new):  # the cache was emptied
                    self.learn(set().union(*split) - self.known.keys())
            get = self.known.__getitem__
            out += [np.frombuffer(b"".join(map(get, s)), np.int32) for s in split]
            i = end
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(4)
def _load(path: str, pattern: str) -> ByteBPE:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBPE(ranks, pattern)


def bpe_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text. A null or empty text has none."""

    def make():
        bpe = ByteBPE.load(path, pattern)
        return lambda texts: [[ids.tolist() for ids in bpe.encode_many(texts)]]

    return per_text(df, id_col, text_col, "ids array<int>", make)


def bpe_digest(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``df``: each whole text is
    encoded, and the ids are decoded again. A null text counts as empty: no tokens, and the digest of
    nothing. A null id stays null; repeated rows give repeated rows; an empty table gives none. Other
    columns are ignored. The rank file lies at ``path`` on every node.
    """

    def make():
        bpe = ByteBPE.load(path, pattern)

        def work(texts: list[str]) -> list[list]:
            counts, coded, decoded = [], [], []
            for ids in bpe.encode_many(texts):
                ids = ids.tolist()
                counts.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [counts, coded, decoded]

        return work

    return per_text(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
