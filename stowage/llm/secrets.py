"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

One model is trained on samples labelled as random strings, the other on ordinary ones. A run of token
characters is a secret if the first explains it so much better that the ratio passes a learnt threshold.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import column, per_text
from stowage.llm.kernels import flat, slices

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(256, 255, np.uint8)
_CODE[list(_ALPHABET)] = np.arange(len(_ALPHABET))

# Words of ordinary identifiers.
_WORDS = """account action active address amount api app array auth base batch begin block body buffer build byte
cache call catalog change channel char check child class clear client close cluster code column command commit config
connect content context control copy count create current customer data database date default delete detail device
document domain driver edit element email enable end entry error event example export field file filter find first
folder font format frame function global group handler header height history home host http image import index info
input insert instance internal item join key label language last layout length level library line link list loader
local location log login manager map match max member memory menu message method min mode model module name network
node number object option order output owner package page param parent parse password path pattern payment plan point
policy position price process product profile project property query queue read record reference region remove report
request reset resource response result return role root route row rule schema screen search section select""".split()


def labelled_samples(each: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled samples to train with where the caller has none: (string, 1) for random strings over the
    alphabets of keys, (string, 0) for identifiers, numbers and other runs of ordinary text."""
    draw = random.Random(seed)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = [digits + lower + upper, digits + lower + upper + "+/", digits + lower + upper + "-_", digits + upper, digits + lower, digits + "abcdef", lower + upper]
    joins = ["_", "-", "/", "", "__", "camel"]
    out = []
    for i in range(each):
        out.append(("".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(16, 48))), 1))
        words, join = draw.choices(_WORDS, k=draw.randint(1, 8)), joins[i % len(joins)]
        text = words[0] + "".join(w.capitalize() for w in words[1:]) if join == "camel" else join.join(words)
        text = text.upper() if i % 7 == 0 else text
        out.append((text + (f"{join if join != 'camel' else ''}{draw.randint(1, 2030)}" if i % 3 == 0 else ""), 0))
        out.append(("".join(draw.choices(digits + "-/" * (i % 4 == 0), k=draw.randint(1, 40))), 0))
    out += [(c * n, 0) for c in "-=_+/0aAxX" for n in range(2, 60, 4)]
    return out


def ordinary_runs(df: DataFrame, text_col: str = "text", docs: int = 2000, runs: int = 20_000) -> list[tuple[str, int]]:
    """Labelled samples from the corpus: (run, 0) for at most ``runs`` distinct runs of letters, up to 200,
    that no pattern touches, in at most ``docs`` distinct texts, and for the same in capitals, which texts
    seldom show; both are the first by a hash. Runs with digits may be secrets and are no samples."""
    texts = df.select(F.col(text_col).cast("string").alias("body")).where("body <> ''").withColumn("mark", F.xxhash64("body"))
    last = texts.select("mark").distinct().orderBy("mark").limit(docs).agg(F.max("mark")).first()[0]
    if last is None:
        return []

    def found(stream):
        for batch in stream:
            seen: set[str] = set()
            for text in column(batch, "body").to_pylist():
                base = base_spans(text)
                seen |= {m[0] for m in _RUN.finditer(text) if len(m[0]) <= 200 and m[0].isalpha() and not any(s < m.end() and m.start() < e for s, _, e in base)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["run"])

    taken = texts.where(F.col("mark") <= last).select("body").mapInArrow(found, "run string").distinct()
    found_runs = [r["run"] for r in taken.orderBy(F.xxhash64("run"), "run").limit(runs).collect()]
    return [(x, 0) for r in found_runs for x in dict.fromkeys((r, r.upper()))]


class Markov:
    """Two character models of order 2, trained from (string, label) samples: each order is smoothed by
    the one below it, down to one flat choice of characters. A run counts as random if its log-likelihood
    ratio, summed over its characters, is above a threshold: the one that makes the cost of the samples
    least, where a false alarm costs as much as ``alarm`` misses. So a run has to be as long as it takes
    to tell, and there is no other rule."""

    def __init__(self, samples: Iterable[tuple[str, int]], weight: float = 4.0, alarm: int = 100):
        samples = list(samples)
        n = len(_ALPHABET)
        grams = [np.zeros((n + 1, n + 1, n)) for _ in range(2)]  # the last row of an axis: before the run
        texts = pa.array([t for t, _ in samples], pa.string())
        labels = np.array([y for _, y in samples], np.int64)
        before, last, row, _ = _grams(*flat(texts))
        for y in (0, 1):
            own = labels[row] == y
            np.add.at(grams[y], (before[0][own], before[1][own], last[own]), 1)

        def logs(counts: np.ndarray) -> np.ndarray:
            chance = np.full(n, 1 / n)
            for held in (counts.sum(axis=(0, 1)), counts.sum(axis=0), counts):
                chance = (held + weight * chance) / (held.sum(axis=-1, keepdims=True) + weight)
            return np.log(chance)

        self.ratio = (logs(grams[1]) - logs(grams[0])).astype(np.float32)
        scores = np.zeros(len(samples))
        np.add.at(scores, row, self.ratio[before[0], before[1], last])
        self.threshold = self._cut(scores, labels, alarm)

    @staticmethod
    def _cut(scores: np.ndarray, labels: np.ndarray, alarm: int) -> float:
        """Between the two scores where the cost of what is wrong is least."""
        order = np.argsort(scores, kind="stable")
        ordered, y = scores[order], labels[order]
        cost = np.concatenate([[0], np.cumsum(np.where(y == 1, 1, -alarm))])  # of calling the first i ordinary
        ends = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)
        at = int(np.argmin(np.where(np.append(ends, True), cost, np.inf)))
        below, above = (ordered[at - 1] if at else -np.inf), (ordered[at] if at < len(ordered) else np.inf)
        return float(below if np.isinf(above) else above - 1 if np.isinf(below) else (below + above) / 2)

    def random_runs(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(text's number, start, end) in bytes of the runs that look random."""
        for first, _, data, offsets in slices(texts, 1 << 18):
            before, last, row, starts = _grams(data, offsets)
            if not len(last):
                continue
            runs = np.flatnonzero(np.append(True, (starts[1:] != starts[:-1])))
            scores = np.add.reduceat(self.ratio[before[0], before[1], last], runs, dtype=np.float64)
            sizes = np.diff(np.append(runs, len(last)))
            for i in np.flatnonzero(scores > self.threshold).tolist():
                own = int(row[runs[i]])
                at = int(starts[runs[i]] - offsets[own])
                yield first + own, at, at + int(sizes[i])

    def random_looking(self, text: str) -> bool:
        return any(e - s == len(text) for _, s, e in self.random_runs(pa.array([text])))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of a run, in order: the codes of the two before it (or of none) and its own; its
    text's number; where its run starts."""
    code = _CODE[data]
    inside = code < len(_ALPHABET)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    one = np.full(len(code), len(_ALPHABET), np.uint8)
    one[1:] = code[:-1]
    one[begins] = len(_ALPHABET)
    two = np.full(len(code), len(_ALPHABET), np.uint8)
    two[1:] = one[:-1]
    two[begins] = len(_ALPHABET)
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(begins)[np.cumsum(begins[at]) - 1] if len(at) else at
    return (two[at], one[at]), code[at], np.searchsorted(offsets, at, "right") - 1, starts


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, of the patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def all_spans(texts: list[str], model: Markov) -> list[list[tuple[int, int, int]]]:
    """For each text the spans of the patterns, and the runs that the models call random and no pattern
    touches."""
    found = [base_spans(t) for t in texts]
    base = [list(f) for f in found]
    for i, s, e in model.random_runs(pa.array(texts, pa.string())):
        raw = texts[i].encode()
        start = len(raw[:s].decode())
        end = start + e - s
        if not any(a < end and start < b for a, _, b in base[i]):
            found[i].append((start, 3, end))
    return [sorted(f) for f in found]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _trained(df: DataFrame, text_col: str, samples: list[tuple[str, int]] | None):
    """Gives, on a worker, the models trained from the samples or, without any, from the default ones."""
    model = Markov(samples if samples else labelled_samples() + ordinary_runs(df, text_col))
    sent = df.sparkSession.sparkContext.broadcast(model)
    return lambda: sent.value


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov), one row per row of ``df``.

    ``samples``: labelled (string, 1 random or 0 ordinary) to train the models with; by default
    labelled_samples and the ordinary_runs of ``df``. Spans of the method are runs of A-Z, a-z, 0-9 and
    ``+/_=-``, of any length and kind, that the models call random. A null or empty text
    has no spans: counts 0, the digest of nothing, an empty ``spans``. Spans of one start come in the
    order of the kinds. A null id stays null; repeated rows give repeated rows; an empty table gives
    none. Other columns are ignored.
    """

    make_model = _trained(df, text_col, samples)

    def make():
        model = make_model()

        def work(texts: list[str]) -> list[list]:
            found = all_spans(texts, model)
            base = [[s for s in f if s[1] < 3] for f in found]
            counts = [[sum(s[1] == k for s in f) for f in found] for k in range(4)]
            digests = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]
            return [*counts[:3], digests, [_joined(f) for f in found], counts[3]]

        return work

    return per_text(df, id_col, text_col, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long", make)


def mask_secrets(df: DataFrame, text_col: str = "text", mask: str = "[secret]", samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """The same rows with each secret in the text replaced by ``mask``; overlapping spans are one. Null
    texts stay null, and texts without a secret stay as they are."""

    make_model, models = _trained(df, text_col, samples), []

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        if not models:
            models.append(make_model())  # once a task

        def clean(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
            out, at = [], 0
            for start, _, end in spans:
                if start >= at:
                    out += [text[at:start], mask]
                at = max(at, end)
            return "".join(out) + text[at:] if spans else text

        held = texts.to_pylist()
        return pa.array([clean(t, s) for t, s in zip(held, all_spans([t or "" for t in held], models[0]), strict=True)], pa.string())

    return df.withColumn(text_col, masked(F.col(text_col)))
