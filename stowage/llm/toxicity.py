"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their character 5-grams, so that inflected forms meet. The vocabulary is what tells
the labels apart in a bounded sample of labelled rows; the same rows, as TF-IDF vectors, are the
examples. They are held in a block-max inverted index: examples of alike vectors share a block, and a
block is scored only if the sum of its terms' largest weights can still beat the k-th neighbour. How many
documents have a term is counted over all documents. The neighbours vote with their cosine, and the vote is calibrated on the examples, each left out in turn.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import BoundedCache, column, per_text, prepared, released, written
from stowage.llm.kernels import gather, minhash, shingle_sets, spans

GRAM = 5
LONG = 100
BLOCK = 64
SIGNATURE = 32


def terms_of(chunk: str) -> tuple[str, ...]:
    """The terms of a run without white space: its lower-case words and their 5-grams."""
    return tuple(t for w in words_of(chunk) if w for t in (w, *_grams(f"^{w}$")))


def words_of(chunk: str) -> list[str]:
    """The word of a run without white space. One of more than LONG characters counts as the words between
    its characters that are no letters or digits."""
    start, end = 0, len(chunk)
    while start < end and not chunk[start].isalnum():
        start += 1
    while end > start and not chunk[end - 1].isalnum():
        end -= 1
    word = chunk[start:end].lower()
    return [word] if len(word) <= LONG else "".join(c if c.isalnum() else " " for c in word).split()


def _grams(marked: str) -> set[str]:
    return {marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)}


class Index:
    """Examples of norm 1 or 0 in a block-max inverted index. Each term has a posting list (examples,
    weights) and, for each block of examples that holds it, its largest weight there."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, ids: np.ndarray, labels: np.ndarray):
        self.ids, self.labels = ids, labels
        rows = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        order = np.lexsort((rows, terms))
        terms, self.rows, self.weights = terms[order], rows[order], weights[order]
        self.starts = np.searchsorted(terms, np.arange(n_terms + 1))
        blocks = self.rows // BLOCK
        new = np.append(True, (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])) if len(terms) else np.zeros(0, bool)
        self.maxima = np.maximum.reduceat(self.weights, np.flatnonzero(new)) if len(terms) else self.weights
        self.blocks, self.block_starts = blocks[new], np.searchsorted(terms[new], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, left_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest, only those above 0, ties to the smaller row. Exact: blocks go
        by falling bound, the sum of their terms' largest weights, and those whose bound is below the k-th
        cosine so far are never scored."""
        sizes = self.block_starts[terms + 1] - self.block_starts[terms]
        at = gather(np.arange(len(self.blocks)), self.block_starts[terms], sizes)
        bounds = np.bincount(self.blocks[at], self.maxima[at] * np.repeat(values, sizes), minlength=-(-len(self.ids) // BLOCK)) * (1 + 1e-9)
        order = np.argsort(-bounds, kind="stable")
        sizes = self.starts[terms + 1] - self.starts[terms]
        at = gather(np.arange(len(self.rows)), self.starts[terms], sizes)
        held, parts = self.rows[at], self.weights[at] * np.repeat(values, sizes)
        rows, found, first = np.zeros(0, np.int64), np.zeros(0), 0
        last = -(-k // BLOCK) + 1
        while first < len(order) and bounds[order[first]] > 0:
            asked = np.zeros(len(order), bool)
            asked[order[first:last]] = True
            if len(found) == k:
                asked &= bounds >= found[-1]
            mine = asked[held // BLOCK]
            scores = np.bincount(held[mine], parts[mine], minlength=len(self.ids))
            more = np.flatnonzero(scores > 0)
            more = more[more != left_out]
            rows, found = np.concatenate([rows, more]), np.concatenate([found, scores[more]])
            best = np.lexsort((rows, -found))[:k]
            rows, found = rows[best], found[best]
            first, last = last, len(order)
        return rows, found


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: Index
    k: int
    prior: float  # the weight of the vote for "not toxic" that every text starts with
    steps: np.ndarray  # votes, ascending, and the calibrated score from each on
    scores: np.ndarray

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt(np.square(values).sum())
        return terms, values / norm if norm else values

    def vote(self, terms: np.ndarray, values: np.ndarray, left_out: int = -1) -> tuple[float, np.ndarray]:
        rows, cosines = self.index.nearest(terms, values, self.k, left_out)
        return (float((cosines * self.index.labels[rows]).sum() / (cosines.sum() + self.prior)) if len(rows) else 0.0), rows

    def score(self, vote: float) -> float:
        return float(self.scores[max(0, np.searchsorted(self.steps, vote + 1e-9, "right") - 1)])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the steps of the non-decreasing function nearest to (x, y)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, first x
    for i in order:
        if pools and pools[-1][2] == x[i]:
            m, w, f = pools.pop()
            pools.append([(m * w + y[i] * weight[i]) / (w + weight[i]), w + weight[i], f])
        else:
            pools.append([float(y[i]), float(weight[i]), float(x[i])])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, _ = pools.pop()
            m0, w0, f0 = pools[-1]
            pools[-1] = [(m * w + m0 * w0) / (w + w0), w + w0, f0]
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


def _unlike(signed: list[tuple[int, bytes | None]]) -> list[int]:
    """The ids, ascending, of rows whose MinHash signature shares under a third of its symbols with that
    of each row that is taken before."""
    kept, held = [], np.zeros((len(signed), SIGNATURE), np.uint16)
    n = 0
    for i, sig in sorted(signed, key=lambda r: r[0]):
        if sig is not None:
            own = np.frombuffer(sig, np.uint16)
            if n and ((held[:n] == own).sum(axis=1) * 3 >= SIGNATURE).any():
                continue
            held[n] = own
            n += 1
        kept.append(i)
    return kept


def _held_out(id_col) -> F.Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 2048, vocabulary: int = 1024, sketch_bits: int = 20, k: int = 25, least_chi: float = 28.0) -> ToxicityModel:
    """Fits the model on at most ``per_label`` rows of each label, the first by a hash of their id, among
    rows whose crc32(id as text) mod 5 is not 0. A repeated label row counts once, the larger label; of the
    texts of a repeated id the smallest counts; null ids and labels are left out. The driver gets the
    sample's ids and vectors, 2**sketch_bits term counts and ``vocabulary`` terms, all bounded by
    parameters; a term's chi-squared is ``least_chi`` at least. How many documents have a term is counted
    over all of ``docs``. Without a label of either kind, or any example, every text scores 0."""
    spark = prepared(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")).where(~_held_out(F.col("id")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    picked = [marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label) for y in (0, 1)]
    rows = [(r["id"], r["y"]) for p in picked for r in p.collect()]
    rates = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    label = dict(rows)
    empty = ToxicityModel({}, np.ones(1), Index([], 1, np.zeros(0, np.int64), np.zeros(0)), k, 1.0, np.array([0.0]), np.array([0.0]))
    if len(set(label.values())) < 2:
        return empty
    drawn = texts.join(F.broadcast(spark.createDataFrame(rows, "id long, y int")), "id").groupBy("id", "y").agg(F.min("body").alias("body"))
    drawn = written(drawn, "labelled")

    def signatures(stream):
        for batch in stream:
            signed = [minhash(s, SIGNATURE).tobytes() if len(s) else None for s in shingle_sets(column(batch, "body"), 2)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(signed, pa.binary())], names=["id", "sig"])

    # Copies of one text would pass its chance words off as signs of its label: one of each group stays.
    single = _unlike([(r["id"], r["sig"]) for r in drawn.mapInArrow(signatures, "id long, sig binary").collect()])
    label = {i: label[i] for i in single}
    sample = drawn.join(F.broadcast(spark.createDataFrame([(i,) for i in single], "id long")), "id")
    if len(set(label.values())) < 2:
        return empty

    def seen(batch, cache) -> list[set[str]]:
        return [set().union(*(cache[c] if len(c) <= LONG else terms_of(c) for c in set((x or "").split()))) for x in column(batch, "body").to_pylist()]

    def sketch(stream):
        cache, counts = BoundedCache(terms_of, 100_000), np.zeros((2, 1 << sketch_bits), np.int64)
        for batch in stream:
            for y, terms in zip(column(batch, "y").to_pylist(), seen(batch, cache), strict=True):
                counts[y, np.array(list({zlib.crc32(t.encode()) & ((1 << sketch_bits) - 1) for t in terms}), np.int64)] += 1
        at = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "clean", "toxic"])

    def strength(toxic: np.ndarray, clean: np.ndarray, n: tuple[int, int]) -> np.ndarray:
        """Signed chi-squared of a term and the label, above 0 where the term points to toxicity."""
        a, b = toxic.astype(float), clean.astype(float)
        c, d = n[1] - a, n[0] - b
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = (a * d - b * c) ** 2 * (a + b + c + d) / ((a + b) * (c + d) * (a + c) * (b + d))
        return np.where(np.isfinite(chi), chi, 0) * np.sign(a * n[0] - b * n[1])

    n = tuple(sum(v == y for v in label.values()) for y in (0, 1))
    few = max(2, min(5, n[1] // 20))
    sums = sample.mapInArrow(sketch, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= few).toArrow()
    buckets = sums["bucket"].to_numpy()
    rank = np.argsort(-strength(sums["toxic"].to_numpy(), sums["clean"].to_numpy(), n), kind="stable")[: 4 * vocabulary]
    chosen = set(buckets[rank].tolist())

    def exact(stream):
        cache, counts = BoundedCache(terms_of, 100_000), {}
        for batch in stream:
            for y, terms in zip(column(batch, "y").to_pylist(), seen(batch, cache), strict=True):
                for t in terms:
                    if zlib.crc32(t.encode()) & ((1 << sketch_bits) - 1) in chosen:
                        counts.setdefault(t, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["term", "clean", "toxic"])

    found = sample.mapInArrow(exact, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= few)
    # chi-squared in SQL, so that only the best terms reach the driver
    a, b, c, d = F.col("toxic"), F.col("clean"), F.lit(n[1]) - F.col("toxic"), F.lit(n[0]) - F.col("clean")
    chi = F.lit(float(sum(n))) * F.pow((a * d - b * c).cast("double"), 2) / ((a + b) * (c + d) * F.lit(float(n[1])) * F.lit(float(n[0])))
    # A term that meets the label by chance (a million are tried) would make clean texts neighbours of toxic ones.
    odds = (a + 0.5) * (n[0] + 1) >= 4 * (b + 0.5) * (n[1] + 1)
    best = found.where((c + d > 0) & odds).withColumn("chi", chi).where(F.col("chi") >= least_chi).orderBy(F.desc("chi"), "term").limit(vocabulary).collect()
    words = {r["term"]: i for i, r in enumerate(best)}
    if not words:
        return empty
    def vectors(stream):
        count = _counter(words)
        for batch in stream:
            held = count(column(batch, "body"))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([t for t, _ in held], pa.list_(pa.int64())), pa.array([c for _, c in held], pa.list_(pa.int64()))], names=["id", "terms", "counts"])

    got = sample.mapInArrow(vectors, "id long, terms array<long>, counts array<long>").collect()
    kept = np.append(_unlike_terms(got, label, len(words)), True)
    place = np.cumsum(kept) - 1
    words = {t: int(place[i]) for t, i in words.items() if kept[i]}
    model = ToxicityModel(words, _idf(docs, text_col, words), empty.index, k, 0.5, np.array([0.0]), np.array([0.0]))
    sparse = []
    for r in got:
        terms, counts = np.array(r["terms"], np.int64), np.array(r["counts"], np.int64)
        stay = kept[terms] if len(terms) else np.zeros(0, bool)
        sparse.append((r["id"], *model.vector(place[terms[stay]], counts[stay])))
    # Alike vectors come together: by their heaviest terms, then by id.
    sparse.sort(key=lambda s: (s[1][np.argsort(-s[2], kind="stable")[:3]].tolist(), s[0]))
    y = np.array([label[s[0]] for s in sparse], np.float64)
    model.index = Index([(t, w) for _, t, w in sparse], len(words) + 1, np.array([s[0] for s in sparse], np.int64), y)
    votes = np.round([model.vote(t, v, left_out=i)[0] if len(t) else 0.0 for i, (_, t, v) in enumerate(sparse)], 6)
    # Each label weighs what it has in all labelled rows, not in the sample.
    weight = np.where(y == 1, rates[1] / max(1, n[1]), rates[0] / max(1, n[0]))
    model.steps, model.scores = isotonic(votes, y, weight)
    return model


def _unlike_terms(rows: list, label: dict[int, int], n: int) -> np.ndarray:
    """Which of ``n`` terms stay: not those of which nine in ten toxic examples have another term that
    points to toxicity more purely. Parts of a word that tells, which clean words have too, go."""
    has = np.zeros((len(rows), n), np.float32)
    for i, r in enumerate(rows):
        has[i, [t for t in r["terms"] if t < n]] = 1
    y = np.array([label[r["id"]] for r in rows])
    toxic, clean = has[y == 1], has[y == 0].sum(axis=0)
    count, both = toxic.sum(axis=0), toxic.T @ toxic
    purer = clean[:, None] * count[None, :] < clean[None, :] * count[:, None]  # [a, b]: a is purer than b
    return ~(purer & (both >= 0.9 * count[None, :])).any(axis=0)


def _counter(vocabulary: dict[str, int]):
    """A function from texts to the (terms, counts) of each, terms ascending. Behind the vocabulary comes
    one more term, which every word counts as, so that a long text's few terms weigh less than a short
    one's. Each distinct run of some megabytes of texts is looked at once, and taken apart only if it has
    the letters of a term or characters whose lower case takes more than a table."""
    every = len(vocabulary)
    parts = "|".join(sorted({re.escape(t.strip("^$")) for t in vocabulary}))
    odd = r"[^\x00-\x{24F}]|\x{130}"

    def learn(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes, made = np.zeros(len(runs), np.int64), []
        words = (pc.binary_length(runs).to_numpy(zero_copy_only=False) > 0).astype(np.int64)  # none in what white space at an end splits off
        for i in np.flatnonzero(pc.greater(pc.utf8_length(runs), LONG).to_numpy(zero_copy_only=False)).tolist():
            words[i] = len(words_of(runs[i].as_py()))
        if parts:
            low = pc.utf8_lower(runs)
            for i in np.flatnonzero(pc.match_substring_regex(low, f"{parts}|{odd}").to_numpy(zero_copy_only=False)).tolist():
                found = [vocabulary[t] for t in terms_of(runs[i].as_py()) if t in vocabulary]
                sizes[i] = len(found)
                made += found
        return np.array(made, np.int64), sizes, words

    def count(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        lists = pc.utf8_split_whitespace(texts)
        runs = lists.flatten().dictionary_encode()
        terms, sizes, words = learn(runs.dictionary)
        starts = np.cumsum(sizes) - sizes
        number = runs.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy(zero_copy_only=False)))
        words_in = np.bincount(row, words[number], minlength=len(texts)).astype(np.int64)
        some = np.flatnonzero(sizes[number])  # most runs have no term
        number, row = number[some], row[some]
        pair, counts = np.unique(np.repeat(row, sizes[number]) * np.int64(every + 1) + gather(terms, starts[number], sizes[number]), return_counts=True)
        full = np.flatnonzero(words_in)
        pair, counts = np.append(pair, full * np.int64(every + 1) + every), np.append(counts, words_in[full])
        order = np.argsort(pair)
        pair, counts = pair[order], counts[order]
        cuts = np.searchsorted(pair, np.arange(1, len(texts)) * (every + 1))
        return list(zip(np.split(pair % (every + 1), cuts), np.split(counts, cuts), strict=True))

    return lambda texts: [x for a, b in spans(texts) for x in count(pc.fill_null(texts.slice(a, b - a), ""))]


def _idf(docs: DataFrame, text_col: str, vocabulary: dict[str, int]) -> np.ndarray:
    """log(1 + documents / documents with the term), over all documents."""

    def tally(stream):
        count, held = _counter(vocabulary), np.zeros(len(vocabulary) + 2, np.int64)
        for batch in stream:
            held[-1] += batch.num_rows
            for terms, _ in count(column(batch, "body")):
                held[terms] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("body")).mapInArrow(released(tally), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(vocabulary) + 2)
    for r in found:
        counts[r["term"]] = r["n"]
    return np.log(1 + counts[-1] / np.maximum(1, counts[:-1]))


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted, vote, evidence), one row per row of ``docs``: the calibrated
    score of each whole text, and the ids of its nearest examples.

    A null or empty text has no neighbours, and the score of a text without one. A null id stays null and
    counts as the text '' for held_out. Repeated rows give repeated rows, an empty table none. Other
    columns are ignored.
    """
    make = _judge(docs, model)
    rows = per_text(docs, id_col, text_col, "score double, vote double, evidence array<long>", lambda: make(evidence))
    return rows.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "vote", "evidence")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text toxicity() does not predict to be toxic, with all their columns.
    Each row is judged on its own text, whatever its id."""
    make, works = _judge(docs, model), []

    @F.arrow_udf("boolean")
    def civil(texts: pa.Array) -> pa.Array:
        if not works:
            works.append(make(0))  # once a task
        return pa.array([s < 0.5 for s in works[0](["" if t is None else t for t in texts.to_pylist()])[0]], pa.bool_())

    return docs.where(civil(F.col(text_col).cast("string")))


def _judge(docs: DataFrame, model: ToxicityModel):
    """Makes, on a worker, the function from texts to their scores, votes and evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(evidence: int):
        held = sent.value
        count = _counter(held.vocabulary)

        @functools.lru_cache(20_000)
        def judged(terms: bytes, counts: bytes) -> tuple[float, float, list[int]]:
            vote, rows = held.vote(*held.vector(np.frombuffer(terms, np.int64), np.frombuffer(counts, np.int64)))
            return held.score(vote), vote, held.index.ids[rows[:evidence]].tolist()

        def work(texts: list[str]) -> list[list]:
            made = [judged(t.tobytes(), c.tobytes()) if len(t) else (held.score(0.0), 0.0, []) for t, c in count(pa.array(texts, pa.string()))]
            return [[m[i] for m in made] for i in range(3)]

        return work

    return make
